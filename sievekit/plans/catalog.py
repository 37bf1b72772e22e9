"""All registered queries: key -> (spark_fn(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1)
def all_queries() -> dict:
    from sievekit.plans import catalog_custom, catalog_filetype, catalog_judge, catalog_ops, catalog_regex, catalog_scores, catalog_stream

    out: dict = {}
    for mod in (catalog_regex, catalog_ops, catalog_scores, catalog_filetype, catalog_custom, catalog_judge, catalog_stream):
        out.update(mod.build())
    return out
