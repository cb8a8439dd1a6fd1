"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = "packing simhash html_text langid embeddings bpe toxicity exact_dedup token_cache warc".split()


def queries() -> dict[str, Callable]:
    found = {}
    for m in MODULES:
        module = import_module(f"tessera.llm.{m}")
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return found | {"pipeline": lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)}


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        module = import_module(f"tessera.llm.{m}")
        names = {k.split("_")[0].upper(): k for k in vars(module) if k.startswith("op") and k[2:3].isdigit()}
        out |= {names[k[:-4]]: v for k, v in vars(module).items() if k.endswith("_SQL") and k[:-4] in names}
    return out
