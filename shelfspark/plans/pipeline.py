"""User-facing API: profile a dataset, build recommendations, evaluate, store and serve.

``profile(tables)`` returns the profile frames; ``recommend(tables, ...)``
builds the three result kinds with the chosen variants and (optionally)
writes them as a run. Variant names follow ``model_options()``; an unknown
name raises ``ValueError`` (it is not silently replaced by the default).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from shelfspark.operators import baskets, content, evaluate, factorization, item_cf, popular, profile as prof, rerank
from shelfspark.sources import results
from shelfspark.sources.tables import RetailTables, category_key, extension_warnings, segment_key

PERSONALIZED_DISPATCH = {
    "als_neural_hybrid": rerank.personalized_als_neural_hybrid,
    "als_only": factorization.personalized_als_only,
    "bpr": factorization.personalized_bpr,
    "content_based": content.content_topk,
}
DEFAULT_PERSONALIZED = "als_neural_hybrid"
FBT_DISPATCH = baskets.FBT_DISPATCH
DEFAULT_FBT = baskets.DEFAULT_FBT
POPULAR_DISPATCH = popular.POPULAR_DISPATCH
DEFAULT_POPULAR = popular.DEFAULT_POPULAR


def model_options() -> dict[str, list[dict]]:
    """Variant names per result kind, with the default flagged."""
    def opts(d, default):
        return [{"name": n, "default": n == default} for n in d]
    return {"personalized": opts(PERSONALIZED_DISPATCH, DEFAULT_PERSONALIZED),
            "fbt": opts(FBT_DISPATCH, DEFAULT_FBT),
            "popular": opts(POPULAR_DISPATCH, DEFAULT_POPULAR)}


def resolve_variant(kind: str, name: str | None) -> str:
    table = {"personalized": (PERSONALIZED_DISPATCH, DEFAULT_PERSONALIZED), "fbt": (FBT_DISPATCH, DEFAULT_FBT),
             "popular": (POPULAR_DISPATCH, DEFAULT_POPULAR)}[kind]
    if name is None:
        return table[1]
    if name not in table[0]:
        raise ValueError(f"unknown {kind} variant {name!r}; choose one of {sorted(table[0])}")
    return name


def profile(tables: RetailTables) -> dict[str, DataFrame | list[str]]:
    """Profile frames (E1–E9) plus the retail schema warnings."""
    out: dict = dict(prof.run_eda(tables))
    if category_key(tables.products) is None:
        out.pop("category_breakdown", None)
    if segment_key(tables.customers) is None:
        out.pop("segment_breakdown", None)
    out["warnings"] = extension_warnings(tables.products, tables.customers)
    return out


def recommend(tables: RetailTables, personalized: str | None = None, fbt: str | None = None,
              popular_variant: str | None = None, k: int = 10, evaluate_run: bool = True,
              out_base: str | None = None, run_id: str | None = None) -> dict[str, DataFrame]:
    """Build personalized, FBT and popular lists (and the evaluation), optionally writing them as a run."""
    p_name = resolve_variant("personalized", personalized)
    f_name = resolve_variant("fbt", fbt)
    q_name = resolve_variant("popular", popular_variant)
    seg = segment_key(tables.customers)
    out = {
        "personalized": PERSONALIZED_DISPATCH[p_name](tables, k=k) if p_name != "content_based"
        else content.content_topk(tables, k=k),
        "fbt": FBT_DISPATCH[f_name](tables, k=k),
        "popular": POPULAR_DISPATCH[q_name](tables, segment_col=seg, top_k_=k),
    }
    if evaluate_run:
        rec = PERSONALIZED_DISPATCH[p_name]
        out["metrics"] = evaluate.evaluate(tables, lambda t: rec(t, k=max(evaluate.TOP_K_VALUES)))
    if out_base:
        run_id = run_id or uuid.uuid4().hex
        for name in ("personalized", "fbt", "popular"):
            results.write_result(out[name], out_base, name, run_id)
        if "metrics" in out:
            results.append_metrics(results.metrics_rows(run_id, out["metrics"]), out_base)
        out["run_id"] = run_id  # type: ignore[assignment]
    return out


__all__ = ["profile", "recommend", "model_options", "resolve_variant", "item_cf"]
