"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, decontamination, language_model, license, mixing, neardup, pii, quality, search, suffixes, toxicity, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license": license.op2_license,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_search": search.op7_search,
    "op8_pii": pii.op8_pii,
    "op9_neardup": neardup.op9_neardup,
    "op10_language_model": language_model.op10_language_model,
    "op11_whitening": whitening.op11_whitening,
    "op12_warc": warc.op12_warc,
    "op13_audit": audit.op13_audit,
}
SQL = {"op2_license": license.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op5_decontamination": decontamination.OP5_SQL, "op7_search": search.OP7_SQL, "op9_neardup": neardup.OP9_SQL, "op12_warc": warc.OP12_SQL, "op13_audit": audit.OP13_SQL}
