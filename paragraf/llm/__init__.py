"""Training-data operators; nothing else in the package imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "bpe", "fingerprints", "token_counts", "packing", "url_filter", "chat", "neighbours", "substring", "toxicity", "alignment", "mixing", "whitening")


def queries() -> dict:
    """name -> callable(spark, sf_dir) of every operator here."""
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL where SQL can express the operator."""
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").SQL
    return found
