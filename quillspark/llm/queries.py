"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module.  Each module has ``query(spark, sf_dir)`` and, where SQL can express it, ``ORACLE``.
MODULES = {
    "op1_langid": "langid",
    "op2_jaccard": "ngram_jaccard",
    "op3_mixing": "mixing",
    "op4_substrings": "substring_dedup",
    "op5_tokens": "token_output",
    "op6_toxicity": "toxicity",
    "op7_decontaminate": "decontaminate",
    "op8_html": "html_extract",
    "op9_topk": "topk",
    "op10_chat": "chat",
    "op11_branches": "branch_merge",
    "op12_conversations": "conversation_repair",
    "op13_urls": "url_filter",
}

_loaded = {name: importlib.import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
QUERIES = {name: module.query for name, module in _loaded.items()}
ORACLES = {name: module.ORACLE for name, module in _loaded.items() if getattr(module, "ORACLE", None)}
