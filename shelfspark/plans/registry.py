"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the whole test-data tables through ``shelfspark.sources.tables``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import (baskets, bpr, content, evaluate, factorization, features, interactions, item_cf,
                                  neural, popular, profile, rerank, strata)
from shelfspark.session import size_shuffles, stored
from shelfspark.sources import keyed, results
from shelfspark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query; every registered query runs with the session time zone pinned to UTC
    (whole-day differences between naive timestamps must not cross a DST change) and shuffles cut by the rows of the facts."""
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            size_shuffles(spark, T.fact_rows(spark, sf))
            return fn(spark, sf)
        QUERIES[name] = run
        return run
    return deco


def _core(spark: SparkSession, sf: str) -> T.RetailTables:
    return T.tpch_tables(spark, sf, optional=False)


# ---------------------------------------------------------------- popularity (Q1–Q4)

@register("popular_recency")
def q_popular_recency(spark, sf):
    return popular.popular_recency(_core(spark, sf), segments=False)


@register("popular_recency_by_segment")
def q_popular_recency_by_segment(spark, sf):
    return popular.popular_recency(_core(spark, sf), overall=False)


@register("popular_trending")
def q_popular_trending(spark, sf):
    return popular.popular_trending(_core(spark, sf), segments=False)


@register("popular_trending_by_segment")
def q_popular_trending_by_segment(spark, sf):
    return popular.popular_trending(_core(spark, sf), overall=False)


def _all(spark: SparkSession, sf: str) -> T.RetailTables:
    return T.tpch_tables(spark, sf, optional=True)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines differ in the last bits of float sums)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


# ---------------------------------------------------------------- sources / validation

@register("load_transactions")
def q_load_transactions(spark, sf):
    return T.tpch_transactions(spark, sf)


@register("volume_gate")
def q_volume_gate(spark, sf):
    return T.volume_gate(_core(spark, sf))


@register("schema_warnings")
def q_schema_warnings(spark, sf):
    return T.schema_warnings(spark, _core(spark, sf))


# ---------------------------------------------------------------- profile

@register("eda_summary")
def q_eda_summary(spark, sf):
    return round_doubles(profile.eda_summary(_core(spark, sf)))


@register("eda_sparsity")
def q_eda_sparsity(spark, sf):
    return round_doubles(profile.eda_sparsity(_core(spark, sf)))


@register("eda_top_products")
def q_eda_top_products(spark, sf):
    return profile.eda_top_products(_core(spark, sf))


@register("eda_weekly")
def q_eda_weekly(spark, sf):
    return profile.eda_weekly(_core(spark, sf))


@register("eda_price_histogram")
def q_eda_price_histogram(spark, sf):
    return profile.eda_price_histogram(_core(spark, sf))


@register("eda_basket_size")
def q_eda_basket_size(spark, sf):
    return profile.eda_basket_size(_core(spark, sf))


@register("eda_category")
def q_eda_category(spark, sf):
    return profile.category_breakdown(_core(spark, sf))


@register("eda_segment")
def q_eda_segment(spark, sf):
    return profile.segment_breakdown(_core(spark, sf))


@register("eda_optional_tables")
def q_eda_optional_tables(spark, sf):
    return profile.optional_tables_present(_all(spark, sf))


# ---------------------------------------------------------------- features

@register("feat_behavioral")
def q_feat_behavioral(spark, sf):
    return round_doubles(features.behavioral(T.tpch_transactions(spark, sf)))


@register("feat_temporal")
def q_feat_temporal(spark, sf):
    return features.temporal(T.tpch_transactions(spark, sf))


@register("feat_session_affinity")
def q_feat_session_affinity(spark, sf):
    return features.session_affinity(T.tpch_sessions(spark, sf))


@register("feat_net_demand")
def q_feat_net_demand(spark, sf):
    return round_doubles(features.net_demand(T.tpch_transactions(spark, sf), T.tpch_returns(spark, sf)))


@register("feat_search_intent")
def q_feat_search_intent(spark, sf):
    return features.search_intent(T.tpch_search_logs(spark, sf))


@register("feat_promo_rate")
def q_feat_promo_rate(spark, sf):
    return round_doubles(features.promo_rate(T.tpch_transactions(spark, sf), T.tpch_promotions(spark, sf)))


@register("feat_category_freq")
def q_feat_category_freq(spark, sf):
    return round_doubles(features.category_freq(T.tpch_products(spark, sf)))


@register("side_features_customer")
def q_side_features_customer(spark, sf):
    cust, _, _, _ = features.side_features(_all(spark, sf))
    return round_doubles(cust)


@register("side_features_product")
def q_side_features_product(spark, sf):
    _, _, prod, _ = features.side_features(_all(spark, sf))
    return round_doubles(prod)


# ---------------------------------------------------------------- frequently bought together
# Rules are mined at three item levels of the same code: products, brands and
# categories (product attributes stand in for the item).

@register("baskets")
def q_baskets(spark, sf):
    return baskets.basket_items(_core(spark, sf))


@register("frequent_pairs")
def q_frequent_pairs(spark, sf):
    return baskets.frequent_pairs(_core(spark, sf), level="brand")


@register("association_rules")
def q_association_rules(spark, sf):
    pairs = baskets.frequent_pairs(_core(spark, sf), level="brand")
    return round_doubles(baskets.rules_from_pairs(pairs, "lift"))


@register("fbt_lift")
def q_fbt_lift(spark, sf):
    return baskets.fbt_apriori_lift(_core(spark, sf), level="brand")


@register("fbt_lift_product")
def q_fbt_lift_product(spark, sf):
    return baskets.fbt_apriori_lift(_core(spark, sf))


@register("fbt_confidence")
def q_fbt_confidence(spark, sf):
    return baskets.fbt_apriori_confidence(_core(spark, sf), level="category")


@register("fbt_fpgrowth")
def q_fbt_fpgrowth(spark, sf):
    return baskets.fbt_fpgrowth(_core(spark, sf), level="brand")


@register("cooccurrence")
def q_cooccurrence(spark, sf):
    return baskets.cooccurrence(_core(spark, sf))


@register("fbt_cooccurrence")
def q_fbt_cooccurrence(spark, sf):
    return baskets.fbt_cooccurrence(_core(spark, sf))


# ---------------------------------------------------------------- personalized: interactions, item-CF, content

@register("user_item_counts")
def q_user_item_counts(spark, sf):
    return interactions.user_item_counts(T.tpch_transactions(spark, sf))


@register("item_similarity")
def q_item_similarity(spark, sf):
    counts = interactions.user_item_counts(T.tpch_transactions(spark, sf))
    return round_doubles(item_cf.item_similarity(counts))


@register("item_cf_topk")
def q_item_cf_topk(spark, sf):
    # every customer ranked by item-CF (the serving gate limits it to sparse customers)
    return item_cf.item_cf_topk(T.tpch_transactions(spark, sf), max_items=None)


@register("content_vectors")
def q_content_vectors(spark, sf):
    vec, _, _ = content.content_vectors(_core(spark, sf))
    return round_doubles(vec)


@register("content_topk")
def q_content_topk(spark, sf):
    return content.content_topk(_core(spark, sf))


# ---------------------------------------------------------------- evaluation (V1–V4)

@register("holdout_test")
def q_holdout_test(spark, sf):
    _, test = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    return test


@register("holdout_train")
def q_holdout_train(spark, sf):
    train, _ = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    return train


@register("eval_popularity_baseline")
def q_eval_popularity_baseline(spark, sf):
    train, test = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    return round_doubles(evaluate.baseline_metrics(train, test).withColumn("list", F.lit("popularity_baseline"))
                         .select("list", "k", "precision", "recall", "hit_rate", "n_customers"))


@register("eval_item_cf")
def q_eval_item_cf(spark, sf):
    return round_doubles(evaluate.evaluate(
        _core(spark, sf), lambda t: item_cf.item_cf_topk(t.transactions, max_items=None)))


@register("eval_content_based")
def q_eval_content_based(spark, sf):
    return round_doubles(evaluate.evaluate(_core(spark, sf), content.content_topk))


# ---------------------------------------------------------------- matrix factorization (P2, P5, P9) — rows-only checks

@register("als_topk")
def q_als_topk(spark, sf):
    return factorization.personalized_als_only(_core(spark, sf))


@register("als_hybrid_topk")
def q_als_hybrid_topk(spark, sf):
    return rerank.personalized_als_neural_hybrid(_all(spark, sf))


@register("negative_samples")
def q_negative_samples(spark, sf):
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    return inter.to_original(rerank.negative_samples(inter))


@register("bpr_topk")
def q_bpr_topk(spark, sf):
    return factorization.personalized_bpr(_all(spark, sf))


# ---------------------------------------------------------------- serving and export

@register("serve_personalized")
def q_serve_personalized(spark, sf):
    t = _core(spark, sf)
    # the reference's sparse-customer item-CF lists; every other customer is served the popular fallback
    lists = item_cf.item_cf_topk(t.transactions)
    return results.serve_personalized(t.customers, lists, popular.popular_recency(t, segments=False))


@register("serve_fbt")
def q_serve_fbt(spark, sf):
    t = _core(spark, sf)
    return results.serve_fbt(t.products, baskets.fbt_cooccurrence(t))


@register("serve_popular")
def q_serve_popular(spark, sf):
    t = _core(spark, sf)
    segs = t.customers.select("segment").union(
        t.customers.select(F.concat(F.col("segment"), F.lit("-unknown")).alias("segment")))
    return results.serve_popular(segs, popular.popular_recency(t))


@register("export_flat")
def q_export_flat(spark, sf):
    return results.export_flat(baskets.fbt_cooccurrence(_core(spark, sf)), "item", "recommended")


# ---------------------------------------------------------------- blend, ALS evaluation, run bookkeeping

@register("minmax_blend")
def q_minmax_blend(spark, sf):
    """P6/F12 blend arithmetic on two real per-(customer, product) signals: purchase rows and recency weight."""
    t = _core(spark, sf)
    txn = t.transactions.where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    now = txn.select(F.max("timestamp")).scalar()
    sig = txn.groupBy("customer_id", "product_id").agg(
        F.count(F.lit(1)).cast("double").alias("mf_score"),
        F.sum(popular.recency_weight(F.col("timestamp"), now)).alias("nn_score"))
    return rerank.blend(sig)


@register("eval_als")
def q_eval_als(spark, sf):
    return round_doubles(evaluate.evaluate(_core(spark, sf), lambda t: factorization.personalized_als_only(t)))


def _stamp(when: str):
    return F.lit(when).cast("timestamp_ntz")


@register("run_metrics")
def q_run_metrics(spark, sf):
    train, test = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    m = evaluate.baseline_metrics(train, test).withColumn("list", F.lit("popularity_baseline"))
    return results.metrics_rows("sf-run", m, _stamp("2025-01-01 12:00:00"))


@register("latest_run")
def q_latest_run(spark, sf):
    train, test = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    m = evaluate.baseline_metrics(train, test).withColumn("list", F.lit("popularity_baseline"))
    runs = results.metrics_rows("run-a", m, _stamp("2025-01-01 12:00:00")).unionByName(
        results.metrics_rows("run-b", m, _stamp("2025-01-01 12:00:01")))
    return results.latest_run(runs)


def _scratch(spark, name: str) -> str:
    """A folder of its own under the shared checkpoint folder, which goes when the session's file system closes."""
    import uuid

    from shelfspark.session import delete_on_exit, ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


@register("result_tables_roundtrip")
def q_result_tables_roundtrip(spark, sf):
    """Write the popular lists as a run under the shared checkpoint folder and read that run back."""
    base = _scratch(spark, "results")
    results.write_result(popular.popular_recency(_core(spark, sf)), base, "popular", "r1")
    return results.read_result(spark, base, "popular", "r1").drop("run_id")


@register("load_tables")
def q_load_tables(spark, sf):
    """Every logical table of the test-data mapping with its row count (one aggregation each)."""
    t = _all(spark, sf)
    parts = [F.struct(F.lit(n).alias("table"), df.select(F.count(F.lit(1)).cast("bigint")).scalar().alias("n_rows"))
             for n, df in t.as_dict().items()]
    return spark.range(1).select(F.explode(F.array(*parts)).alias("t")).select("t.*")


@register("rank_metrics")
def q_rank_metrics(spark, sf):
    """V2 on its own: each held-out customer is served the train-split recency list of their segment."""
    t = _core(spark, sf)
    train, test = evaluate.holdout_split(t.transactions)
    lists = popular.popular_recency(t.with_transactions(train), overall=False)
    seg = t.customers.select("customer_id", F.concat(F.lit("segment:"), F.col("segment")).alias("list_key"))
    recs = (test.select("customer_id").distinct().join(seg, "customer_id")
            .join(lists.select("list_key", "rank", "product_id"), "list_key"))
    return round_doubles(evaluate.ranked_metrics(recs, test))


@register("rerank_train")
def q_rerank_train(spark, sf):
    """Fit the re-rank scorer; report per label the rows and mean predicted probability of a purchase."""
    t = _all(spark, sf)
    inter = factorization.Interactions(t.transactions)
    scorer = rerank.train_scorer(inter, t)
    pos = inter.counts.select("uid", "iid").withColumn("label", F.lit(1.0))
    rows = stored(pos.unionByName(rerank.negative_samples(inter).withColumn("label", F.lit(0.0))), "labelled")
    scored = rows.join(neural.score(rows.select("uid", "iid").distinct(), scorer), ["uid", "iid"])
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(1 / (1 + F.exp(-F.col("nn_score")))).alias("mean_p_purchase"))


# ---------------------------------------------------------------- rules and pairs on products; gated item-CF; sub-day times

@register("frequent_pairs_product")
def q_frequent_pairs_product(spark, sf):
    return baskets.frequent_pairs(_core(spark, sf), min_count=2)


@register("association_rules_product")
def q_association_rules_product(spark, sf):
    return round_doubles(baskets.rules_from_pairs(baskets.frequent_pairs(_core(spark, sf), min_count=2), "confidence", 0.05))


@register("fbt_lift_product_min2")
def q_fbt_lift_product_min2(spark, sf):
    return baskets.fbt_apriori(_core(spark, sf), "lift", min_count=2)


#: A gate that selects part of the customers of the test data, so that both branches of the gated paths have rows.
GATE = 25


@register("item_cf_topk_gated")
def q_item_cf_topk_gated(spark, sf):
    return item_cf.item_cf_topk(T.tpch_transactions(spark, sf), max_items=GATE)


@register("serve_personalized_gated")
def q_serve_personalized_gated(spark, sf):
    t = _core(spark, sf)
    return results.serve_personalized(t.customers, item_cf.item_cf_topk(t.transactions, max_items=GATE),
                                      popular.popular_recency(t, segments=False))


@register("feat_temporal_events")
def q_feat_temporal_events(spark, sf):
    return features.temporal(T.events_transactions(spark, sf))


@register("holdout_events")
def q_holdout_events(spark, sf):
    _, test = evaluate.holdout_split(T.events_transactions(spark, sf))
    return test


# ---------------------------------------------------------------- models on fixed inputs, which SQL can state exactly

def _fixed_factors(ids, col: str, original: str, rank: int = 4):
    """Factors as a plain function of the original id and the component."""
    comp = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)),
                       lambda k: F.pmod(F.col(original) * 31 + (k + 1) * 17 + F.col(original) * k * 7, F.lit(101)) / 101.0 - 0.5)
    return ids.select(F.col(col).alias("id"), comp.alias("features"))


def _fixed_model(inter):
    users = inter.counts.select("uid", "customer_id").distinct()
    items = inter.counts.select("iid", "product_id").distinct()
    single = lambda df: df.select("id", F.col("features").cast("array<float>").alias("features"))
    return factorization.FactorModel(4, single(_fixed_factors(users, "uid", "customer_id")), single(_fixed_factors(items, "iid", "product_id")))


@register("mf_shortlist_fixed")
def q_mf_shortlist_fixed(spark, sf):
    """P5 with factors fixed by formula."""
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    short = factorization.mf_shortlist(_fixed_model(inter), inter, k=2)
    return inter.to_original(short).select("customer_id", F.col("mf_rank").cast("int").alias("mf_rank"), "product_id", F.round("mf_score", 5).alias("mf_score"))


@register("bpr_one_epoch")
def q_bpr_one_epoch(spark, sf):
    """One epoch from factors and draws fixed by formula; the new customer and product factors."""
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    pos = inter.counts.select("uid", "iid", "customer_id", "product_id")
    draws = pos.select("uid", (F.col("customer_id") * 7 + F.col("product_id") * 13).cast("long").alias("h"), F.col("iid").alias("tag"))
    triples = inter.unowned().draw(draws).select("uid", F.col("tag").alias("iid"), F.col("iid").alias("jid"))
    users, items = pos.select("uid", "customer_id").distinct(), pos.select("iid", "product_id").distinct()
    new = factorization.bpr_epoch(triples, _fixed_factors(users, "uid", "customer_id"), _fixed_factors(items, "iid", "product_id"), lr=0.1, reg=0.01)
    names = (users.select(F.lit(0).alias("side"), F.col("uid").alias("id"), F.col("customer_id").alias("original"))
             .unionByName(items.select(F.lit(1).alias("side"), F.col("iid").alias("id"), F.col("product_id").alias("original"))))
    return new.join(names, ["side", "id"]).select("side", "original", *[F.round(F.col("features")[k], 6).alias(f"f{k}") for k in range(4)])


@register("negative_sample_counts")
def q_negative_sample_counts(spark, sf):
    """N1 by customer: negatives drawn (four for each product bought), and how many of them are owned (none)."""
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    neg = rerank.negative_samples(inter)
    owned = inter.counts.select("uid", "iid", F.lit(1).alias("o"))
    told = neg.join(owned, ["uid", "iid"], "left").groupBy("uid").agg(F.count(F.lit(1)).alias("n_negatives"), F.count("o").alias("n_owned"))
    return told.join(inter.user_map, "uid").select("customer_id", "n_negatives", "n_owned")


@register("csv_transactions")
def q_csv_transactions(spark, sf):
    """The tables written as CSV, as users give them, then loaded, checked and typed; the facts by day."""
    base, t = _scratch(spark, "csv"), _core(spark, sf)
    paths = {}
    for name, df in t.as_dict().items():
        paths[name] = f"{base}/{name}"
        df.write.option("header", True).csv(paths[name])
    txn = T.load_tables(spark, paths).transactions
    return (txn.groupBy(F.to_date("timestamp").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("quantity"), 6).alias("quantity"), F.round(F.sum("price"), 6).alias("price"),
                 F.count_distinct("customer_id").alias("n_customers")))


@register("bpr_stratum")
def q_bpr_stratum(spark, sf):
    """One turn of the block rotation (4 blocks, turn 1), a batch a cell, from factors and draws fixed by formula."""
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    pos, blocks = inter.counts.select("uid", "iid", "customer_id", "product_id"), 4
    users, items = pos.select("uid", "customer_id").distinct(), pos.select("iid", "product_id").distinct()
    state = (strata.side_rows(_fixed_factors(users, "uid", "customer_id"), "id", "features", strata.CUSTOMER, blocks)
             .unionByName(strata.side_rows(_fixed_factors(items, "iid", "product_id"), "id", "features", strata.PRODUCT, blocks)))

    def step(cell):
        owned = strata.Owned(cell.u, cell.i, len(cell.uid), len(cell.iid))
        able = owned.free[cell.u] > 0
        u, i, j = cell.u[able], cell.i[able], np.empty(int(able.sum()), np.int64)
        for a in range(0, len(u), bpr.PIECE):
            at, it = u[a:a + bpr.PIECE], i[a:a + bpr.PIECE]
            r = (cell.uid[at].astype("int64") * 7 + cell.iid[it] * 13) % owned.free[at]
            j[a:a + bpr.PIECE] = owned.unowned(at, r)
        bpr.step(cell.users, cell.items, u, i, j, 0.1, 0.01)

    new = strata.Strata(pos, blocks).meet(state, 1, step)
    names = (users.select(F.lit(0).alias("side"), F.col("uid").alias("id"), F.col("customer_id").alias("original"))
             .unionByName(items.select(F.lit(1).alias("side"), F.col("iid").alias("id"), F.col("product_id").alias("original"))))
    return new.join(names, ["side", "id"]).select("side", "original", *[F.round(F.col("state")[k], 6).alias(f"f{k}") for k in range(4)])


#: A network of two-number embeddings and hidden layers of 3 and 2, its weights fixed by formula.
TINY = neural.Shape(2, 0, 0, (3, 2))
TINY_NET = [((k * 37 + 11) % 101) / 101 - 0.5 for k in range(TINY.size())]


@register("scorer_gradients")
def q_scorer_gradients(spark, sf):
    """The loss of each customer's purchases (labels by formula) and its gradient by the embedding, summed over the cells of all turns."""
    inter = factorization.Interactions(T.tpch_transactions(spark, sf))
    pos, blocks = inter.counts.select("uid", "iid", "customer_id", "product_id"), 4
    users, items = pos.select("uid", "customer_id").distinct(), pos.select("iid", "product_id").distinct()
    state = (strata.side_rows(_fixed_factors(users, "uid", "customer_id", 2), "id", "features", strata.CUSTOMER, blocks)
             .unionByName(strata.side_rows(_fixed_factors(items, "iid", "product_id", 2), "id", "features", strata.PRODUCT, blocks)))

    def step(cell):
        if not len(cell.u):
            return None
        told = []
        for a in range(0, len(cell.u), bpr.PIECE):  # by customer, so a customer has a row in few pieces
            u, i = cell.u[a:a + bpr.PIECE], cell.i[a:a + bpr.PIECE]
            y = ((cell.uid[u] + cell.iid[i]) % 2).astype(float)
            x = np.concatenate([cell.users[u], cell.items[i]], axis=1)
            _, by_input, _ = neural.backward(TINY, np.array(TINY_NET), x, y)
            z, _, _ = neural.forward(TINY, np.array(TINY_NET), x)
            row, total, _ = strata.added(u, np.column_stack([by_input[:, :2], np.logaddexp(0, z) - y * z]))
            told.append((strata.REPORT, np.column_stack([cell.uid[row], total])))
        return told

    cut = strata.Strata(pos, blocks)
    told = [cut.meet(state, s, step).where(F.col("side") == strata.REPORT) for s in range(blocks)]
    rows = functools.reduce(DataFrame.unionByName, told).select(F.col("state")[0].cast("int").alias("uid"), *[F.col("state")[k + 1].alias(c) for k, c in enumerate(("g0", "g1", "loss"))])
    return (rows.groupBy("uid").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("g0", "g1", "loss")]).join(users, "uid")
            .select("customer_id", "g0", "g1", "loss"))


# ---------------------------------------------------------------- tables by key (S9, S12-S14), export and stored metrics

#: Lists that a second write replaces.
REPLACED = ("segment:AUTOMOBILE", "segment:BUILDING", "segment:MACHINERY")


@register("upsert_keys")
def q_upsert_keys(spark, sf):
    """The popular lists as a run, then a second write that replaces three lists by their trending ones, twice (a retry)."""
    t, base = _core(spark, sf), _scratch(spark, "keyed")
    kept = keyed.KeyedTable(spark, base, "popular", "r1", "list_key", buckets=4)
    kept.replace(popular.popular_recency(t))
    new = popular.popular_trending(t, overall=False).where(F.col("list_key").isin(*REPLACED))
    for _ in range(2):
        kept.upsert(new)
    return keyed.KeyedTable(spark, base, "popular", "r1", "list_key", buckets=4).read()


#: What the lookups ask for: some customers, products and segments, known ones and unknown ones.
ASKED_IDS, ASKED_SEGMENTS = (-1, 1, 2, 4, 5, 7, 8, 10, 11), ("BUILDING", "HOUSEHOLD", "NONE")


def _asked(spark, name, values):
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


@register("lookup_personalized")
def q_lookup_personalized(spark, sf):
    """S12 by key: a few customers out of the stored lists of all."""
    t, base = _core(spark, sf), _scratch(spark, "keyed")
    lists = keyed.KeyedTable(spark, base, "personalized", "r1", "customer_id")
    lists.replace(item_cf.item_cf_topk(t.transactions, max_items=GATE))
    top = keyed.KeyedTable(spark, base, "popular", "r1", "list_key")
    top.replace(popular.popular_recency(t, segments=False))
    return keyed.get_personalized(_asked(spark, "customer_id", ASKED_IDS).select(F.col("customer_id").cast("long").alias("customer_id")), lists, top)


@register("lookup_fbt")
def q_lookup_fbt(spark, sf):
    """S13 by key: a few products out of the stored lists of all."""
    t, base = _core(spark, sf), _scratch(spark, "keyed")
    lists = keyed.KeyedTable(spark, base, "fbt", "r1", "item")
    lists.replace(baskets.fbt_cooccurrence(t))
    return keyed.get_fbt(_asked(spark, "product_id", ASKED_IDS).select(F.col("product_id").cast("long").alias("product_id")), lists)


@register("lookup_popular")
def q_lookup_popular(spark, sf):
    """S14 by key: a few segments, one of them unknown."""
    t, base = _core(spark, sf), _scratch(spark, "keyed")
    lists = keyed.KeyedTable(spark, base, "popular", "r1", "list_key")
    lists.replace(popular.popular_recency(t))
    return keyed.get_popular(_asked(spark, "segment", ASKED_SEGMENTS), lists)


@register("export_personalized")
def q_export_personalized(spark, sf):
    """S15 of the personalized table."""
    return results.export_flat(item_cf.item_cf_topk(T.tpch_transactions(spark, sf), max_items=GATE), "customer_id", "product_id")


@register("export_popular")
def q_export_popular(spark, sf):
    """S15 of the popular table."""
    return results.export_flat(popular.popular_recency(_core(spark, sf)), "list_key", "product_id")


@register("stored_metrics")
def q_stored_metrics(spark, sf):
    """Two runs' metrics appended to the stored table, one run read back."""
    train, test = evaluate.holdout_split(T.tpch_transactions(spark, sf))
    m = evaluate.baseline_metrics(train, test).withColumn("list", F.lit("popularity_baseline"))
    base = _scratch(spark, "results")
    for run_id in ("run-a", "run-b"):
        results.append_metrics(results.metrics_rows(run_id, m, _stamp("2025-01-01 12:00:00")), base)
    return results.read_metrics(spark, base, "run-b")
