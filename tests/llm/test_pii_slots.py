"""Personal data of forms that no digit rule knows, in the slots of patterns that seeds induce."""

import pytest
from quarry.llm import pii

FORMS = {
    "email": ("jane.doe at example dot org", "@jane_doe", "agent-707", "AB-123-XY"),
    "phone": ("020 7946 0958",),
    "card": ("1234 5678 9012 3456",),
}


def rows():
    text = {"email": "Please send the form to {} before noon today", "phone": "In urgent cases call {} during office hours", "card": "The fee was charged to {} last week again"}
    seeds = [(k, text["email"].format(f"user{k}@mail.example.org")) for k in range(40)]
    seeds += [(100 + k, text["phone"].format(f"+49 30 1234{k:03d}")) for k in range(40)]
    seeds += [(200 + k, text["card"].format(n)) for k, n in enumerate(n for n in (f"41111111111{x:05d}" for x in range(900)) if pii.luhn(n)) if k < 40]
    new = [(kind, form) for kind, forms in FORMS.items() for form in forms]
    out = [(300 + k, text[kind].format(form)) for k, (kind, form) in enumerate(new)]
    ordinary = [(400 + k, f"They walked slowly into {w} after dark") for k, w in enumerate(("town", "work", "school"))]
    mixed = [(500 + k, f"We want to write {f'user{k}@mail.example.org' if k < 6 else f'plain{chr(97 + k)}'} more often") for k in range(20)]
    return seeds + out + ordinary + mixed, new


@pytest.mark.parametrize("block_patterns", [200_000, 2])
def test_slots(spark, block_patterns):
    table, new = rows()
    text = dict(table)
    found = {r["doc_id"]: r["more"] for r in pii.spans(spark.createDataFrame(table, "doc_id long, text string"), block_patterns=block_patterns).collect()}
    for k, (kind, form) in enumerate(new):
        assert (kind, form) in [(m["kind"], text[300 + k][m["start"] : m["end"]]) for m in found[300 + k]]
    assert not any(found[i] for i in found if i >= 400)  # ordinary words, and a slot that mostly holds them


def test_recall_and_precision_on_planted_identifiers(spark):
    """Seeds that the base knows in six contexts, identifiers that it doesn't know in the same ones, ordinary words elsewhere."""
    import random

    r = random.Random(3)
    contexts = ("the customer wrote from {} on monday", "please reply to {} as soon as possible", "my new contact is {} since last year", "we sent the invoice to {} by mistake", "the account of {} was closed", "forward this to {} before friday")
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    forms = (lambda: f"{word(5)} at {word(6)} dot org", lambda: f"@{word(7)}", lambda: f"{word(4)}-{r.randint(10, 99)}/{word(3)}", lambda: f"id{r.randint(10000, 99999)}")
    rows = [(k, r.choice(contexts).format(f"{word(6)}@{word(5)}.example.org")) for k in range(240)]
    planted = {1000 + k: r.choice(forms)() for k in range(60)}
    rows += [(k, r.choice(contexts).format(x)) for k, x in planted.items()]
    rows += [(2000 + k, f"{word(4)} walked to {word(6)} and saw {word(5)} near {word(7)} in {r.randint(1000, 1999)}") for k in range(200)]
    text = dict(rows)
    found = {(r["doc_id"], text[r["doc_id"]][m["start"] : m["end"]]) for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for m in r["more"]}
    right = found & set(planted.items())
    print(f"recall {len(right) / len(planted):.3f}, precision {len(right) / max(len(found), 1):.3f}")
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.9 * len(found)


def test_long_words_stand_in_contexts():
    assert pii._context(f"{'x' * 500} {'Y' * 300} 12345 {'z' * 200}", 802, 807) == [f"L:{'x' * 500} {'y' * 300}", f"B:{'y' * 300}|{'z' * 200}"]
