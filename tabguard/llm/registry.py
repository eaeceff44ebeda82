"""All registered queries of this subpackage and the pipeline."""

from __future__ import annotations

import importlib

from tabguard.llm.common import QUERIES, SQL

MODULES = ["licenses", "quality", "privacy", "bpe", "token_counts", "substrings", "neighbours", "simhash", "toxicity", "decontamination", "ranked", "chat", "phrases"]


def load():
    for module in MODULES:
        importlib.import_module(f"tabguard.llm.{module}")
    return dict(QUERIES), dict(SQL)
