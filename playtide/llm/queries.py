"""The queries of this subpackage, one per operator, and the SQL where SQL can express them."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_quality_rules": "quality_rules",
    "op2_language_id": "language_id",
    "op3_orc_tokens": "orc_tokens",
    "op4_simhash_dedup": "simhash",
    "op5_bin_completion": "packing",
    "op6_substring_dedup": "substrings",
    "op7_bpe_replay": "bpe_replay",
    "op8_jpeg_media": "jpeg",
    "op9_suffix_tree_lm": "context_lm",
    "op10_warc_merge": "warc",
    "op11_fim": "fim",
    "op12_mixing": "mixing",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"playtide.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from playtide.llm.collocations import ORACLE as op13
    from playtide.llm.fim import ORACLE as op11
    from playtide.llm.substrings import ORACLE as op6
    from playtide.llm.warc import ORACLE as op10

    return {"op6_substring_dedup": op6, "op10_warc_merge": op10, "op11_fim": op11, "op13_collocations": op13}
