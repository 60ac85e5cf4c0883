"""DuckDB twins of the registered queries (test oracle, not used by the engine).

Each statement reads the raw test-data views and restates the operator's
semantics in plain SQL; columns are named exactly like the Spark output.
"""

# Logical tables over the raw test data, shared by every statement.
TXN = """txn AS (
  SELECT l_orderkey AS transaction_id, o_custkey AS customer_id, l_partkey AS product_id,
         l_quantity AS quantity, l_extendedprice / l_quantity AS price, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CUST = "cust AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer)"
PROD = """prod AS (SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
                  p_retailprice AS price FROM part)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def topk(src: str, keys: str, k: int = 10, score: str = "score", item: str = "product_id",
         select: str = "*") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return (f"SELECT {select} FROM (SELECT *, CAST(row_number() OVER ({part}ORDER BY round({score}, 6) DESC, "
            f"{item}) AS INTEGER) AS rank FROM {src}) WHERE rank <= {k}")


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- popularity
_REC_W = "CASE WHEN ts IS NULL THEN 1.0 ELSE exp(-ln(2) * greatest(0, date_sub('day', ts, n.now)) / 30.0) END"
SQL["popular_recency"] = with_(TXN, "n AS (SELECT max(ts) AS now FROM txn)", f"""s AS (
  SELECT product_id, coalesce(sum(quantity * {_REC_W}), 0) AS score
  FROM txn, n WHERE product_id IS NOT NULL GROUP BY product_id)""") + topk(
    "s", "", select="'overall' AS list_key, rank, product_id, round(score, 6) AS score")

SQL["popular_recency_by_segment"] = with_(TXN, CUST, "n AS (SELECT max(ts) AS now FROM txn)", f"""s AS (
  SELECT c.segment, t.product_id, coalesce(sum(t.quantity * {_REC_W}), 0) AS score
  FROM txn t JOIN cust c ON t.customer_id = c.customer_id, n
  WHERE c.segment IS NOT NULL AND t.product_id IS NOT NULL GROUP BY c.segment, t.product_id)""") + topk(
    "s", "segment", select="'segment:' || segment AS list_key, rank, product_id, round(score, 6) AS score")

_VEL = """coalesce(sum(CASE WHEN ts > n.now - INTERVAL 7 DAY THEN quantity END), 0) AS recent,
  coalesce(sum(CASE WHEN ts > n.now - INTERVAL 14 DAY AND ts <= n.now - INTERVAL 7 DAY THEN quantity END), 0) AS prior"""
SQL["popular_trending"] = with_(TXN, "n AS (SELECT max(ts) AS now FROM txn)", f"""a AS (
  SELECT product_id, {_VEL} FROM txn, n WHERE ts IS NOT NULL AND product_id IS NOT NULL GROUP BY product_id),
s AS (SELECT product_id, (recent - prior) / (prior + 1) AS score FROM a)""") + topk(
    "s", "", select="'overall' AS list_key, rank, product_id, round(score, 6) AS score")

SQL["popular_trending_by_segment"] = with_(TXN, CUST, "n AS (SELECT max(ts) AS now FROM txn)", f"""a AS (
  SELECT c.segment, t.product_id, {_VEL.replace('ts >', 't.ts >').replace('ts <=', 't.ts <=')}
  FROM txn t JOIN cust c ON t.customer_id = c.customer_id, n
  WHERE t.ts IS NOT NULL AND c.segment IS NOT NULL AND t.product_id IS NOT NULL GROUP BY c.segment, t.product_id),
s AS (SELECT segment, product_id, (recent - prior) / (prior + 1) AS score FROM a)""") + topk(
    "s", "segment", select="'segment:' || segment AS list_key, rank, product_id, round(score, 6) AS score")

# ---------------------------------------------------------------- optional tables over the raw data
SESS = """sess AS (SELECT event_id AS session_id, user_id AS customer_id,
   CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, ts
   FROM events WHERE event_type IN ('view', 'click'))"""
RET = """ret AS (SELECT l_orderkey AS transaction_id, l_partkey AS product_id, o_custkey AS customer_id,
   CAST(l_shipdate AS DATE) AS return_date
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""
SRCH = """srch AS (SELECT user_id AS customer_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS query,
   ts FROM events)"""
PROMO = "promo AS (SELECT DISTINCT p_partkey AS product_id FROM part WHERE p_size <= 12)"

# ---------------------------------------------------------------- sources / validation
SQL["load_transactions"] = with_(TXN) + """SELECT transaction_id, customer_id, product_id, quantity, price,
  ts AS "timestamp" FROM txn"""

SQL["volume_gate"] = with_(TXN) + """SELECT *, value >= minimum AS passed FROM (
  SELECT 1 AS check_order, 'transaction_rows' AS "check", (SELECT count(*) FROM txn) AS value, CAST(50 AS BIGINT) AS minimum
  UNION ALL SELECT 2, 'unique_customers', (SELECT count(DISTINCT c_custkey) FROM customer), 5
  UNION ALL SELECT 3, 'unique_products', (SELECT count(DISTINCT p_partkey) FROM part), 5)"""

# ---------------------------------------------------------------- profile
SQL["eda_summary"] = with_(TXN) + """SELECT count(*) AS n_transactions,
  (SELECT count(DISTINCT c_custkey) FROM customer) AS n_customers,
  (SELECT count(DISTINCT p_partkey) FROM part) AS n_products,
  count(DISTINCT customer_id) AS n_customers_with_transactions,
  count(DISTINCT product_id) AS n_products_with_transactions,
  date_sub('day', min(ts), max(ts)) AS date_span_days,
  round(count(customer_id)::DOUBLE / count(DISTINCT customer_id), 6) AS avg_transactions_per_customer,
  round(avg(quantity), 6) AS avg_quantity, round(avg(price), 6) AS avg_price FROM txn"""

SQL["eda_sparsity"] = with_(TXN, "p AS (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id, product_id FROM txn))",
                            "c AS (SELECT count(DISTINCT c_custkey) AS n FROM customer)",
                            "q AS (SELECT count(DISTINCT p_partkey) AS n FROM part)") + """
SELECT p.n AS n_interactions, round(CASE WHEN c.n = 0 OR q.n = 0 THEN 1.0
  ELSE 1.0 - p.n::DOUBLE / (c.n::DOUBLE * q.n::DOUBLE) END, 6) AS sparsity FROM p, c, q"""

SQL["eda_top_products"] = with_(TXN, """s AS (SELECT product_id, count(*) AS "count" FROM txn
  WHERE product_id IS NOT NULL GROUP BY 1)""") + topk("s", "", score='"count"', select='rank, product_id, "count"')

SQL["eda_weekly"] = with_(TXN, """w AS (SELECT CAST(ts AS DATE) + CAST((7 - isodow(ts)) % 7 AS INTEGER) AS period,
  count(*) AS n FROM txn WHERE ts IS NOT NULL GROUP BY 1)""",
  "s AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE) AS period FROM w)") + \
  'SELECT s.period, coalesce(w.n, 0) AS "count" FROM s LEFT JOIN w USING (period)'

SQL["eda_price_histogram"] = with_(
    TXN,
    "st AS (SELECT min(price) AS lo, max(price) AS hi, count(DISTINCT price) AS nu FROM txn WHERE price IS NOT NULL)",
    """e AS (SELECT *, least(10, nu) AS nb,
   CASE WHEN lo = hi THEN lo - CASE WHEN lo <> 0 THEN abs(lo) * 0.001 ELSE 0.001 END ELSE lo END AS lo_e,
   CASE WHEN lo = hi THEN hi + CASE WHEN hi <> 0 THEN abs(hi) * 0.001 ELSE 0.001 END ELSE hi END AS hi_e FROM st)""",
    """e2 AS (SELECT *, (hi_e - lo_e) / nb AS step,
   CASE WHEN lo = hi THEN lo_e ELSE lo - (hi - lo) * 0.001 END AS first_edge FROM e)""",
    """b0 AS (SELECT t.price, CAST(least(greatest(ceil((t.price - lo_e) / step), 1), nb) AS BIGINT) AS b0, e2.*
   FROM txn t, e2 WHERE t.price IS NOT NULL)""",
    """b AS (SELECT b0 - CASE WHEN b0 > 1 AND price <= (b0 - 1) * step + lo_e THEN 1 ELSE 0 END
   + CASE WHEN b0 < nb AND price > b0 * step + lo_e THEN 1 ELSE 0 END AS bin FROM b0)""",
    "c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)",
    "s AS (SELECT CAST(unnest(generate_series(1, nb)) AS BIGINT) AS bin, * EXCLUDE (nb), nb FROM e2)",
) + """SELECT s.bin, round(CASE WHEN s.bin = 1 THEN first_edge ELSE (s.bin - 1) * step + lo_e END, 6) AS range_lo,
  round(CASE WHEN s.bin = nb THEN hi_e ELSE s.bin * step + lo_e END, 6) AS range_hi,
  coalesce(c.n, 0) AS "count",
  format('{:.2f}-{:.2f}', round(CASE WHEN s.bin = 1 THEN first_edge ELSE (s.bin - 1) * step + lo_e END, 3),
         round(CASE WHEN s.bin = nb THEN hi_e ELSE s.bin * step + lo_e END, 3)) AS range FROM s LEFT JOIN c ON s.bin = c.bin"""

SQL["eda_basket_size"] = with_(TXN) + """SELECT basket_size, count(*) AS "count" FROM (
  SELECT transaction_id, count(*) AS basket_size FROM txn WHERE transaction_id IS NOT NULL GROUP BY 1) GROUP BY 1"""

SQL["eda_category"] = with_(TXN, PROD) + """SELECT p.category, count(*) AS "count"
  FROM txn t JOIN prod p ON t.product_id = p.product_id WHERE p.category IS NOT NULL GROUP BY 1"""

SQL["eda_segment"] = with_(TXN, CUST) + """SELECT c.segment, count(*) AS "count"
  FROM txn t JOIN cust c ON t.customer_id = c.customer_id WHERE c.segment IS NOT NULL GROUP BY 1"""

# ---------------------------------------------------------------- features
_BEH = """beh AS (SELECT customer_id, coalesce(sum(price * quantity), 0) AS total_spend,
   count(DISTINCT transaction_id) AS n_orders, count(DISTINCT product_id) AS n_distinct_products
   FROM txn WHERE customer_id IS NOT NULL GROUP BY 1)"""
_TMP = """tmp AS (SELECT customer_id, max(ts) AS last_purchase,
   date_sub('day', max(ts), (SELECT max(ts) FROM txn WHERE ts IS NOT NULL AND customer_id IS NOT NULL)) AS recency_days
   FROM txn WHERE ts IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1)"""
_NET = """net AS (SELECT coalesce(s.product_id, r.product_id) AS product_id,
   coalesce(units_sold, 0) AS units_sold, coalesce(units_returned, 0) AS units_returned,
   coalesce(units_sold, 0) - coalesce(units_returned, 0) AS net_demand
   FROM (SELECT product_id, coalesce(sum(quantity), 0) AS units_sold FROM txn WHERE product_id IS NOT NULL GROUP BY 1) s
   FULL OUTER JOIN (SELECT product_id, count(*)::DOUBLE AS units_returned FROM ret WHERE product_id IS NOT NULL GROUP BY 1) r
   ON s.product_id = r.product_id)"""
_PR = """pr AS (SELECT customer_id, sum(CASE WHEN product_id IN (SELECT product_id FROM promo) THEN 1 ELSE 0 END)::DOUBLE
   / count(*) AS promo_purchase_rate FROM txn WHERE customer_id IS NOT NULL GROUP BY 1)"""
_SI = "si AS (SELECT customer_id, count(query) AS n_searches FROM srch WHERE customer_id IS NOT NULL GROUP BY 1)"
_SA = """sa AS (SELECT customer_id, product_id, count(*) AS session_views FROM sess
   WHERE customer_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)"""
_CF = """cf AS (SELECT p.product_id, f.freq AS category_freq FROM prod p LEFT JOIN (
   SELECT category, count(*)::DOUBLE / (SELECT count(*) FROM prod WHERE category IS NOT NULL) AS freq
   FROM prod WHERE category IS NOT NULL GROUP BY 1) f ON p.category = f.category)"""

SQL["feat_behavioral"] = with_(TXN, _BEH) + """SELECT customer_id, round(total_spend, 6) AS total_spend, n_orders,
  n_distinct_products FROM beh"""
SQL["feat_temporal"] = with_(TXN, _TMP) + "SELECT customer_id, last_purchase, recency_days FROM tmp"
SQL["feat_session_affinity"] = with_(SESS, _SA) + "SELECT * FROM sa"
SQL["feat_net_demand"] = with_(TXN, RET, _NET) + """SELECT product_id, round(units_sold, 6) AS units_sold,
  round(units_returned, 6) AS units_returned, round(net_demand, 6) AS net_demand FROM net"""
SQL["feat_search_intent"] = with_(SRCH, _SI) + "SELECT * FROM si"
SQL["feat_promo_rate"] = with_(TXN, PROMO, _PR) + """SELECT customer_id, round(promo_purchase_rate, 6)
  AS promo_purchase_rate FROM pr"""
SQL["feat_category_freq"] = with_(PROD, _CF) + "SELECT product_id, round(category_freq, 6) AS category_freq FROM cf"


def _std_select(key: str, cols: list[str]) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    outs = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} < 1e-9 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in cols)
    return f"st AS (SELECT {stats} FROM raw)\nSELECT {key}, {outs} FROM raw, st"


_CUST_COLS = ["total_spend", "n_orders", "n_distinct_products", "recency_days", "n_searches",
              "promo_purchase_rate", "session_views"]
SQL["side_features_customer"] = with_(
    TXN, SESS, SRCH, PROMO, _BEH, _TMP, _PR, _SI, _SA,
    "base AS (SELECT DISTINCT customer_id FROM txn WHERE customer_id IS NOT NULL)",
    "sv AS (SELECT customer_id, sum(session_views) AS session_views FROM sa GROUP BY 1)",
    """raw AS (SELECT b.customer_id,
   coalesce(beh.total_spend, 0)::DOUBLE AS total_spend, coalesce(beh.n_orders, 0)::DOUBLE AS n_orders,
   coalesce(beh.n_distinct_products, 0)::DOUBLE AS n_distinct_products,
   coalesce(tmp.recency_days, 0)::DOUBLE AS recency_days, coalesce(si.n_searches, 0)::DOUBLE AS n_searches,
   coalesce(pr.promo_purchase_rate, 0)::DOUBLE AS promo_purchase_rate,
   coalesce(sv.session_views, 0)::DOUBLE AS session_views
   FROM base b LEFT JOIN beh USING (customer_id) LEFT JOIN tmp USING (customer_id)
   LEFT JOIN si USING (customer_id) LEFT JOIN pr USING (customer_id) LEFT JOIN sv USING (customer_id))""",
    _std_select("customer_id", _CUST_COLS)[:_std_select("customer_id", _CUST_COLS).index("\nSELECT")],
) + _std_select("customer_id", _CUST_COLS)[_std_select("customer_id", _CUST_COLS).index("\nSELECT") + 1:]

_PROD_COLS = ["units_sold", "price", "category_freq", "net_demand"]
SQL["side_features_product"] = with_(
    TXN, PROD, RET, _NET, _CF,
    """raw AS (SELECT s.product_id, coalesce(s.units_sold, 0)::DOUBLE AS units_sold,
   coalesce(pp.price, 0)::DOUBLE AS price, coalesce(cfm.category_freq, 0)::DOUBLE AS category_freq,
   coalesce(net.net_demand, 0)::DOUBLE AS net_demand
   FROM (SELECT product_id, coalesce(sum(quantity), 0) AS units_sold FROM txn WHERE product_id IS NOT NULL GROUP BY 1) s
   LEFT JOIN (SELECT product_id, max(price) AS price FROM prod GROUP BY 1) pp USING (product_id)
   LEFT JOIN (SELECT product_id, max(category_freq) AS category_freq FROM cf GROUP BY 1) cfm USING (product_id)
   LEFT JOIN net USING (product_id))""",
    _std_select("product_id", _PROD_COLS)[:_std_select("product_id", _PROD_COLS).index("\nSELECT")],
) + _std_select("product_id", _PROD_COLS)[_std_select("product_id", _PROD_COLS).index("\nSELECT") + 1:]

# ---------------------------------------------------------------- frequently bought together
_NB = "nb AS (SELECT count(DISTINCT transaction_id) AS n FROM txn WHERE transaction_id IS NOT NULL)"


def _basket_items(level: str) -> str:
    lines = ("SELECT DISTINCT transaction_id, product_id FROM txn "
             "WHERE transaction_id IS NOT NULL AND product_id IS NOT NULL")
    if level == "product_id":
        return f"b AS (SELECT transaction_id, product_id AS item FROM ({lines}))"
    return (f"b AS (SELECT DISTINCT t.transaction_id, p.{level} AS item FROM ({lines}) t "
            f"JOIN prod p ON t.product_id = p.product_id WHERE p.{level} IS NOT NULL)")


def _pairs(level: str, support: str = "count(*) >= 2 AND 100 * count(*) >= (SELECT n FROM nb)") -> list[str]:
    return [TXN, PROD, _NB, _basket_items(level),
            f"fi AS (SELECT item, count(*) AS n_item FROM b GROUP BY item HAVING {support})",
            "kb AS (SELECT * FROM b WHERE item IN (SELECT item FROM fi))",
            f"""fp AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM kb x JOIN kb y
   ON x.transaction_id = y.transaction_id AND x.item < y.item GROUP BY 1, 2 HAVING {support})""",
            """pairs AS (SELECT fp.item_a, fp.item_b, fp.n_ab, a.n_item AS n_a, c.n_item AS n_b, nb.n
   FROM fp JOIN fi a ON fp.item_a = a.item JOIN fi c ON fp.item_b = c.item, nb)"""]


def _rules(metric: str, keep: str | None = None) -> str:
    keep = keep or ("n * n_ab * 10 >= 10 * n_ante * n_cons" if metric == "lift" else "n_ab * 10 >= 3 * n_ante")
    return f"""rules AS (SELECT antecedent, consequent, n_ab, n_ab::DOUBLE / n AS support,
   n_ab::DOUBLE / n_ante AS confidence, (n * n_ab)::DOUBLE / (n_ante * n_cons)::DOUBLE AS lift FROM (
   SELECT item_a AS antecedent, item_b AS consequent, n_ab, n_a AS n_ante, n_b AS n_cons, n FROM pairs
   UNION ALL SELECT item_b, item_a, n_ab, n_b, n_a, n FROM pairs) WHERE {keep})"""


def _cooc(only_missing: bool) -> str:
    where = "WHERE x.item IN (SELECT item FROM missing) " if only_missing else ""
    return f"""co AS (SELECT x.item, y.item AS recommended, count(*)::DOUBLE AS score, 'cooccurrence' AS source
   FROM b x JOIN b y ON x.transaction_id = y.transaction_id AND x.item <> y.item {where}GROUP BY 1, 2)"""


_FBT_OUT = ("SELECT item, rank, recommended, round(score, 6) AS score, source FROM (SELECT *, CAST(row_number() "
            "OVER (PARTITION BY item ORDER BY round(score, 6) DESC, recommended) AS INTEGER) AS rank FROM u) "
            "WHERE rank <= 10")


def _fbt(level: str, metric: str, *support: str) -> str:
    return with_(*_pairs(level, *support), _rules(metric),
                 f"ranked AS (SELECT antecedent AS item, consequent AS recommended, {metric} AS score, "
                 f"'rule_{metric}' AS source FROM rules)",
                 "missing AS (SELECT DISTINCT item FROM b WHERE item NOT IN (SELECT antecedent FROM rules))",
                 _cooc(True), "u AS (SELECT * FROM ranked UNION ALL SELECT * FROM co)") + _FBT_OUT


SQL["baskets"] = with_(TXN, _basket_items("product_id")) + "SELECT transaction_id, item FROM b"
SQL["frequent_pairs"] = with_(*_pairs("brand")) + "SELECT * FROM pairs"
SQL["association_rules"] = with_(*_pairs("brand"), _rules("lift")) + """SELECT antecedent, consequent, n_ab,
  round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules"""
SQL["fbt_lift"] = _fbt("brand", "lift")
SQL["fbt_lift_product"] = _fbt("product_id", "lift")
SQL["fbt_confidence"] = _fbt("category", "confidence")
SQL["fbt_fpgrowth"] = _fbt("brand", "lift")
_TWO = "count(*) >= 2"
SQL["frequent_pairs_product"] = with_(*_pairs("product_id", _TWO)) + "SELECT * FROM pairs"
SQL["association_rules_product"] = with_(*_pairs("product_id", _TWO), _rules("confidence", "n_ab * 20 >= n_ante")) + """
SELECT antecedent, consequent, n_ab, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules"""
SQL["fbt_lift_product_min2"] = _fbt("product_id", "lift", _TWO)
SQL["cooccurrence"] = with_(TXN, _basket_items("product_id"), _cooc(False)) + \
    "SELECT item, recommended AS other, CAST(score AS BIGINT) AS n FROM co"
SQL["fbt_cooccurrence"] = with_(TXN, _basket_items("product_id"), _cooc(False), "u AS (SELECT * FROM co)") + _FBT_OUT

# ---------------------------------------------------------------- personalized: interactions, item-CF, content
OWNED = """owned AS (SELECT customer_id, product_id, count(*) AS cnt FROM txn
   WHERE customer_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)"""
_NORMS = "nrm AS (SELECT product_id, sqrt(sum(cnt * cnt)) AS norm FROM owned GROUP BY 1)"
_SIM = """sim AS (SELECT d.item_i, d.item_j, d.dot / (a.norm * b.norm) AS sim FROM (
   SELECT x.product_id AS item_i, y.product_id AS item_j, sum(x.cnt * y.cnt) AS dot
   FROM owned x JOIN owned y ON x.customer_id = y.customer_id GROUP BY 1, 2) d
   JOIN nrm a ON a.product_id = d.item_i JOIN nrm b ON b.product_id = d.item_j)"""

SQL["user_item_counts"] = with_(TXN, OWNED) + "SELECT * FROM owned"
SQL["item_similarity"] = with_(TXN, OWNED, _NORMS, _SIM) + "SELECT item_i, item_j, round(sim, 6) AS sim FROM sim"
SQL["item_cf_topk"] = with_(TXN, OWNED, _NORMS, _SIM, """sc AS (SELECT o.customer_id, s.item_j AS product_id,
   sum(s.sim) AS score FROM owned o JOIN sim s ON o.product_id = s.item_i GROUP BY 1, 2)""",
   """f AS (SELECT * FROM sc WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM owned o
   WHERE o.customer_id = sc.customer_id AND o.product_id = sc.product_id))""") + topk(
    "f", "customer_id", select="customer_id, rank, product_id, round(score, 6) AS score")

_VEC = [
    "sold AS (SELECT DISTINCT product_id FROM txn WHERE product_id IS NOT NULL)",
    """base AS (SELECT s.product_id, coalesce(CAST(p.category AS VARCHAR), '__missing__') AS category,
   coalesce(CAST(p.brand AS VARCHAR), '__missing__') AS brand, p.price FROM sold s LEFT JOIN prod p
   ON s.product_id = p.product_id)""",
    """filled AS (SELECT product_id, category, brand, coalesce(price, (SELECT avg(price) FROM base)) AS price
   FROM base)""",
    "st AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM filled)",
    """vec AS (SELECT product_id, category, brand, (price - m) / (s + 1e-9) AS price_z FROM filled, st)""",
    "vec2 AS (SELECT *, sqrt(2.0 + price_z * price_z) AS norm FROM vec)",
]
SQL["content_vectors"] = with_(TXN, PROD, *_VEC) + """SELECT product_id, category, brand,
  round(price_z, 6) AS price_z, round(norm, 6) AS norm FROM vec2"""
SQL["content_topk"] = with_(
    TXN, PROD, *_VEC, OWNED,
    """x AS (SELECT o.customer_id, o.cnt / v.norm AS w, v.category, v.brand, v.price_z
   FROM owned o JOIN vec2 v USING (product_id))""",
    "ac AS (SELECT customer_id, category, sum(w) AS a_category FROM x GROUP BY 1, 2)",
    "ab AS (SELECT customer_id, brand, sum(w) AS a_brand FROM x GROUP BY 1, 2)",
    "cw AS (SELECT customer_id, sum(w * price_z) AS W FROM x GROUP BY 1)",
    """pn AS (SELECT customer_id, sqrt(sum(sq)) AS pnorm FROM (SELECT customer_id, W * W AS sq FROM cw
   UNION ALL SELECT customer_id, a_category * a_category FROM ac
   UNION ALL SELECT customer_id, a_brand * a_brand FROM ab) GROUP BY 1)""",
    """cand AS (SELECT c.customer_id, v.product_id,
   coalesce((c.W * v.price_z + coalesce(ac.a_category, 0) + coalesce(ab.a_brand, 0)) / (v.norm * pn.pnorm), 0) AS score
   FROM cw c JOIN pn USING (customer_id) CROSS JOIN vec2 v
   LEFT JOIN ac ON ac.customer_id = c.customer_id AND ac.category = v.category
   LEFT JOIN ab ON ab.customer_id = c.customer_id AND ab.brand = v.brand
   WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = c.customer_id AND o.product_id = v.product_id))""",
) + """SELECT customer_id, rank, product_id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY customer_id ORDER BY score DESC, product_id) AS INTEGER) AS rank FROM cand) WHERE rank <= 10"""

# ---------------------------------------------------------------- evaluation
FULL = TXN.replace("txn AS (", "full_txn AS (", 1)
_HOLD = [
    FULL,
    """ls AS (SELECT customer_id, product_id, max(ts) AS last_seen FROM full_txn
   WHERE customer_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)""",
    """rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_seen ASC NULLS LAST, product_id) AS pos,
   count(*) OVER (PARTITION BY customer_id) AS n FROM ls)""",
    """test AS (SELECT customer_id, product_id FROM rk
   WHERE n >= 2 AND pos > n - least(greatest(1, (2 * n + 5) // 10), n - 1))""",
    """txn AS (SELECT * FROM full_txn t WHERE customer_id IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM test x WHERE x.customer_id = t.customer_id AND x.product_id = t.product_id))""",
]
SQL["holdout_test"] = with_(*_HOLD) + "SELECT * FROM test"
SQL["holdout_train"] = with_(*_HOLD) + """SELECT transaction_id, customer_id, product_id, quantity, price,
  ts AS "timestamp" FROM txn"""


def _metrics(recs_cte: str, label: str) -> str:
    return f"""SELECT '{label}' AS list, k, round(avg(hits / k), 6) AS precision, round(avg(hits / n_rel), 6) AS recall,
  round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n_customers FROM (
  SELECT rel.n_rel::DOUBLE AS n_rel, kk.k::DOUBLE AS k0, kk.k,
    coalesce((SELECT count(*) FROM test t JOIN {recs_cte} r ON t.customer_id = r.customer_id
      AND t.product_id = r.product_id WHERE t.customer_id = rel.customer_id AND r.rank <= kk.k), 0)::DOUBLE AS hits
  FROM (SELECT customer_id, count(*) AS n_rel FROM test GROUP BY 1) rel, (SELECT 5 AS k UNION ALL SELECT 10) kk)
  GROUP BY k"""


_BASE_RECS = ("""bl AS (SELECT rank, product_id FROM (SELECT *, CAST(row_number() OVER (ORDER BY round(score, 6) DESC,
   product_id) AS INTEGER) AS rank FROM (SELECT product_id, coalesce(sum(quantity), 0) AS score FROM txn
   WHERE product_id IS NOT NULL GROUP BY 1)) WHERE rank <= 10)""",
              "blr AS (SELECT t.customer_id, b.product_id, b.rank FROM (SELECT DISTINCT customer_id FROM test) t, bl b)")
SQL["eval_popularity_baseline"] = with_(*_HOLD, *_BASE_RECS) + _metrics("blr", "popularity_baseline")


def _eval(model_ctes: list[str], recs_select: str) -> str:
    return with_(*_HOLD, *_BASE_RECS, *model_ctes, f"recs AS ({recs_select})") + \
        _metrics("recs", "model") + "\nUNION ALL\n" + _metrics("blr", "popularity_baseline")


_ICF_RECS = topk("f", "customer_id", select="customer_id, rank, product_id")
SQL["eval_item_cf"] = _eval([OWNED, _NORMS, _SIM, """sc AS (SELECT o.customer_id, s.item_j AS product_id,
   sum(s.sim) AS score FROM owned o JOIN sim s ON o.product_id = s.item_i GROUP BY 1, 2)""",
   """f AS (SELECT * FROM sc WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM owned o
   WHERE o.customer_id = sc.customer_id AND o.product_id = sc.product_id))"""], _ICF_RECS)

_CB = SQL["content_topk"]
_CB_CTES = _CB[len("WITH "):_CB.index("SELECT customer_id, rank, product_id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (\n  PARTITION BY customer_id ORDER BY score DESC")].rstrip().rstrip(",")
SQL["eval_content_based"] = with_(*_HOLD, *_BASE_RECS, PROD, _CB_CTES.split(TXN + ",\n", 1)[1].split(PROD + ",\n", 1)[1],
    """recs AS (SELECT customer_id, rank, product_id FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY customer_id ORDER BY score DESC, product_id) AS INTEGER) AS rank FROM cand) WHERE rank <= 10)""") + \
    _metrics("recs", "model") + "\nUNION ALL\n" + _metrics("blr", "popularity_baseline")

# ---------------------------------------------------------------- serving / export
_POP_CTES = [TXN, "n AS (SELECT max(ts) AS now FROM txn)", f"""s AS (
  SELECT product_id, coalesce(sum(quantity * {_REC_W}), 0) AS score
  FROM txn, n WHERE product_id IS NOT NULL GROUP BY product_id)""",
    "pop AS (" + topk("s", "", select="rank, product_id") + ")"]
SQL["serve_personalized"] = with_(*_POP_CTES, CUST, OWNED, _NORMS, _SIM,
    "sparse AS (SELECT customer_id FROM owned GROUP BY 1 HAVING count(*) <= 2)",
    """sc AS (SELECT o.customer_id, s.item_j AS product_id, sum(s.sim) AS score
   FROM (SELECT * FROM owned WHERE customer_id IN (SELECT customer_id FROM sparse)) o
   JOIN sim s ON o.product_id = s.item_i GROUP BY 1, 2)""",
    """f AS (SELECT * FROM sc WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM owned o
   WHERE o.customer_id = sc.customer_id AND o.product_id = sc.product_id))""",
    "pl AS (" + topk("f", "customer_id", select="customer_id, rank, product_id") + ")",
    "req AS (SELECT DISTINCT customer_id FROM cust)") + """
SELECT customer_id, rank, product_id, 'personalized' AS source FROM pl WHERE customer_id IN (SELECT customer_id FROM req)
UNION ALL
SELECT r.customer_id, p.rank, p.product_id, 'popularity_fallback' AS source FROM req r, pop p
WHERE r.customer_id NOT IN (SELECT customer_id FROM pl)"""

_FBT_CO = with_(TXN, _basket_items("product_id"), _cooc(False), "u AS (SELECT * FROM co)")[len("WITH "):].rstrip()
SQL["serve_fbt"] = with_(_FBT_CO, PROD, "fl AS (" + _FBT_OUT + ")") + """SELECT item AS product_id, rank,
  recommended AS recommended_id FROM fl WHERE item IN (SELECT product_id FROM prod)"""
SQL["export_flat"] = with_(_FBT_CO, "fl AS (" + _FBT_OUT + ")") + """SELECT item, string_agg(CAST(recommended AS VARCHAR),
  ', ' ORDER BY rank) AS recommendations FROM fl GROUP BY item"""
_POP_ALL = [TXN, CUST, "n AS (SELECT max(ts) AS now FROM txn)", f"""s AS (
  SELECT product_id, coalesce(sum(quantity * {_REC_W}), 0) AS score
  FROM txn, n WHERE product_id IS NOT NULL GROUP BY product_id)""",
    "po AS (" + topk("s", "", select="'overall' AS list_key, rank, product_id") + ")",
    f"""ss AS (SELECT c.segment, t.product_id, coalesce(sum(t.quantity * {_REC_W}), 0) AS score
  FROM txn t JOIN cust c ON t.customer_id = c.customer_id, n
  WHERE c.segment IS NOT NULL AND t.product_id IS NOT NULL GROUP BY c.segment, t.product_id)""",
    "ps AS (" + topk("ss", "segment", select="'segment:' || segment AS list_key, rank, product_id") + ")",
    "lists AS (SELECT * FROM po UNION ALL SELECT * FROM ps)",
    """req AS (SELECT DISTINCT segment, 'segment:' || segment AS list_key FROM (
   SELECT segment FROM cust UNION ALL SELECT segment || '-unknown' FROM cust))"""]
SQL["serve_popular"] = with_(*_POP_ALL) + """SELECT r.segment, l.rank, l.product_id, 'segment' AS source
  FROM req r JOIN lists l ON r.list_key = l.list_key
UNION ALL
SELECT r.segment, l.rank, l.product_id, 'overall_fallback' AS source FROM req r, lists l
  WHERE l.list_key = 'overall' AND r.list_key NOT IN (SELECT list_key FROM lists)"""

SQL["schema_warnings"] = """SELECT * FROM (
  SELECT 'products' AS "table", 'category' AS "column", true AS present, (SELECT count(*) FROM part) AS n_rows,
    (SELECT count(p_type) FROM part) AS n_non_null, CAST(NULL AS VARCHAR) AS warning
  UNION ALL SELECT 'products', 'brand', true, (SELECT count(*) FROM part), (SELECT count(p_brand) FROM part), NULL
  UNION ALL SELECT 'customers', 'segment', true, (SELECT count(*) FROM customer),
    (SELECT count(c_mktsegment) FROM customer), NULL)"""
SQL["eda_optional_tables"] = """SELECT * FROM (
  SELECT 'sessions' AS "table", true AS present,
    (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS n_rows
  UNION ALL SELECT 'returns', true, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R')
  UNION ALL SELECT 'search_logs', true, (SELECT count(*) FROM events)
  UNION ALL SELECT 'promotions', true, (SELECT count(*) FROM part WHERE p_size <= 12))"""

SQL["minmax_blend"] = with_(TXN, "n AS (SELECT max(ts) AS now FROM txn)", f"""s AS (
  SELECT customer_id, product_id, count(*)::DOUBLE AS mf, sum({_REC_W}) AS nn
  FROM txn, n WHERE customer_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)""",
  """m AS (SELECT *, min(mf) OVER w AS mf_lo, max(mf) OVER w AS mf_hi, min(nn) OVER w AS nn_lo,
   max(nn) OVER w AS nn_hi FROM s WINDOW w AS (PARTITION BY customer_id))""",
  """b AS (SELECT customer_id, product_id,
   (CASE WHEN mf_hi - mf_lo < 1e-9 THEN 0.0 ELSE (mf - mf_lo) / (mf_hi - mf_lo) END) * 0.5
   + (CASE WHEN nn_hi - nn_lo < 1e-9 THEN 0.0 ELSE (nn - nn_lo) / (nn_hi - nn_lo) END) * 0.5 AS score FROM m)""") + topk(
    "b", "customer_id", select="customer_id, rank, product_id, round(score, 6) AS score")
SQL["result_tables_roundtrip"] = SQL["popular_recency"].replace(
    "SELECT 'overall' AS list_key, rank, product_id, round(score, 6) AS score FROM", "SELECT * FROM (SELECT 'overall' AS list_key, rank, product_id, round(score, 6) AS score FROM") + ") UNION ALL " + SQL["popular_recency_by_segment"][len("WITH "):].join(["SELECT * FROM (WITH ", ")"])

SQL["load_tables"] = """SELECT * FROM (
  SELECT 'transactions' AS "table", (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS n_rows
  UNION ALL SELECT 'customers', (SELECT count(*) FROM customer)
  UNION ALL SELECT 'products', (SELECT count(*) FROM part)
  UNION ALL SELECT 'sessions', (SELECT count(*) FROM events WHERE event_type IN ('view', 'click'))
  UNION ALL SELECT 'returns', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R')
  UNION ALL SELECT 'search_logs', (SELECT count(*) FROM events)
  UNION ALL SELECT 'promotions', (SELECT count(*) FROM part WHERE p_size <= 12))"""

SQL["rank_metrics"] = with_(*_HOLD, CUST, "n AS (SELECT max(ts) AS now FROM txn)", f"""ss AS (
  SELECT c.segment, t.product_id, coalesce(sum(t.quantity * {_REC_W}), 0) AS score
  FROM txn t JOIN cust c ON t.customer_id = c.customer_id, n
  WHERE c.segment IS NOT NULL AND t.product_id IS NOT NULL GROUP BY c.segment, t.product_id)""",
    "ps AS (" + topk("ss", "segment", select="segment, rank, product_id") + ")",
    """recs AS (SELECT c.customer_id, p.rank, p.product_id FROM (SELECT DISTINCT customer_id FROM test) x
   JOIN cust c ON c.customer_id = x.customer_id JOIN ps p ON p.segment = c.segment)""") + \
    _metrics("recs", "model").replace("SELECT 'model' AS list, k,", "SELECT k,")


# ---------------------------------------------------------------- gated item-CF, sub-day times
_GATED = "owned WHERE customer_id IN (SELECT customer_id FROM owned GROUP BY 1 HAVING count(*) <= 25)"
SQL["item_cf_topk_gated"] = SQL["item_cf_topk"].replace("FROM owned o JOIN sim", f"FROM (SELECT * FROM {_GATED}) o JOIN sim")
SQL["serve_personalized_gated"] = SQL["serve_personalized"].replace("HAVING count(*) <= 2)", "HAVING count(*) <= 25)")
_EV = """txn AS (SELECT event_id AS transaction_id, user_id AS customer_id,
   CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, 1.0 AS quantity, value AS price, ts
   FROM events WHERE event_type = 'purchase')"""
SQL["feat_temporal_events"] = SQL["feat_temporal"].replace(TXN, _EV)
SQL["holdout_events"] = SQL["holdout_test"].replace(TXN, _EV)

# ---------------------------------------------------------------- run bookkeeping with a given time
SQL["run_metrics"] = with_(*_HOLD, *_BASE_RECS, "m AS (" + _metrics("blr", "popularity_baseline") + ")") + """
SELECT 'sf-run' AS run_id, TIMESTAMP '2025-01-01 12:00:00' AS computed_at, list, k, x.metric, x.value FROM m,
  LATERAL (SELECT 'precision' AS metric, precision AS value UNION ALL SELECT 'recall', recall UNION ALL SELECT 'hit_rate', hit_rate) x"""
SQL["latest_run"] = "SELECT 'run-b' AS run_id, TIMESTAMP '2025-01-01 12:00:01' AS computed_at"

# ---------------------------------------------------------------- models on fixed inputs
_F = lambda c, k: f"((({c} * 31 + {k + 1} * 17 + {c} * {k} * 7) % 101) / 101.0::DOUBLE - 0.5)"
SQL["mf_shortlist_fixed"] = with_(TXN, OWNED,
    "u AS (SELECT customer_id FROM owned GROUP BY 1 HAVING count(*) >= 3)", "i AS (SELECT DISTINCT product_id FROM owned)",
    f"""s AS (SELECT customer_id, product_id, {" + ".join(f"{_F('customer_id', k)}::FLOAT::DOUBLE * {_F('product_id', k)}::FLOAT::DOUBLE" for k in range(4))} AS score
   FROM u, i WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = u.customer_id AND o.product_id = i.product_id))""") + topk(
    "s", "customer_id", select="customer_id, rank AS mf_rank, product_id, round(score, 5) AS mf_score")
_DOT = " + ".join(f"p{k} * (q{k} - r{k})" for k in range(4))
_MEAN = ", ".join(f"avg(g{k}) AS g{k}" for k in range(4))
SQL["bpr_one_epoch"] = with_(TXN, OWNED,
    "i AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS x FROM (SELECT DISTINCT product_id FROM owned))",
    "o AS (SELECT customer_id, product_id, x, x - (row_number() OVER (PARTITION BY customer_id ORDER BY x) - 1) AS gap FROM owned JOIN i USING (product_id))",
    "c AS (SELECT customer_id, (SELECT count(*) FROM i) - count(*) AS free FROM o GROUP BY 1)",
    "d AS (SELECT customer_id, product_id, (customer_id * 7 + product_id * 13) % free AS r FROM o JOIN c USING (customer_id) WHERE free > 0)",
    """n AS (SELECT d.customer_id, d.product_id, d.r + (SELECT count(*) FROM o WHERE o.customer_id = d.customer_id AND o.gap <= d.r) AS x FROM d)""",
    "t AS (SELECT n.customer_id, n.product_id, i.product_id AS neg FROM n JOIN i USING (x))",
    "f AS (SELECT *, " + ", ".join(f"{_F('customer_id', k)} AS p{k}, {_F('product_id', k)} AS q{k}, {_F('neg', k)} AS r{k}" for k in range(4)) + " FROM t)",
    f"s AS (SELECT *, 1.0 / (1.0 + exp({_DOT})) AS g FROM f)",
    "m AS (SELECT 0 AS side, customer_id AS original, " + ", ".join(f"g * (q{k} - r{k}) - 0.01 * p{k} AS g{k}" for k in range(4)) + " FROM s"
    " UNION ALL SELECT 1, product_id, " + ", ".join(f"g * p{k} - 0.01 * q{k}" for k in range(4)) + " FROM s"
    " UNION ALL SELECT 1, neg, " + ", ".join(f"-g * p{k} - 0.01 * r{k}" for k in range(4)) + " FROM s)",
    f"a AS (SELECT side, original, count(*) AS n, {_MEAN} FROM m GROUP BY 1, 2)",
    "e AS (SELECT DISTINCT 0 AS side, customer_id AS original FROM owned UNION ALL SELECT 1, product_id FROM i)") + "SELECT side, original, " + ", ".join(
    f"round({_F('original', k)} + coalesce(0.1 * n / (1 + 0.1 * n) * g{k}, 0), 6) AS f{k}" for k in range(4)) + " FROM e LEFT JOIN a USING (side, original)"
SQL["negative_sample_counts"] = with_(TXN, OWNED, "n AS (SELECT count(DISTINCT product_id) AS n FROM owned)") + """
SELECT customer_id, 4 * count(*) AS n_negatives, 0 AS n_owned FROM owned, n GROUP BY customer_id, n.n HAVING count(*) < n.n"""
SQL["csv_transactions"] = with_(TXN) + """SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, round(sum(quantity), 6) AS quantity,
  round(sum(price), 6) AS price, count(DISTINCT customer_id) AS n_customers FROM txn GROUP BY 1"""


def _tiny(k):
    return repr(((k * 37 + 11) % 101) / 101 - 0.5)


# one turn of a block rotation: customers and products numbered in order, 4 blocks, product block one after the customer's
_NUMBERED = ("c AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS u FROM (SELECT DISTINCT customer_id FROM owned))",
             "i AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS x FROM (SELECT DISTINCT product_id FROM owned))")
SQL["bpr_stratum"] = with_(TXN, OWNED, *_NUMBERED,
    "b AS (SELECT product_id, x, x % 4 AS blk, x // 4 AS place FROM i)",
    "nb AS (SELECT blk, count(*) AS n FROM b GROUP BY 1)",
    "o AS (SELECT customer_id, u, product_id, x, blk, place, place - (row_number() OVER (PARTITION BY u ORDER BY place) - 1) AS gap FROM owned JOIN c USING (customer_id) JOIN b USING (product_id) WHERE blk = (u % 4 + 1) % 4)",
    "fr AS (SELECT u, any_value(nb.n) - count(*) AS free FROM o JOIN nb USING (blk) GROUP BY u)",
    "d AS (SELECT customer_id, u, product_id, blk, (u * 7 + x * 13) % free AS r FROM o JOIN fr USING (u) WHERE free > 0)",
    "n AS (SELECT customer_id, product_id, blk, d.r + (SELECT count(*) FROM o WHERE o.u = d.u AND o.gap <= d.r) AS place FROM d)",
    "t AS (SELECT n.customer_id, n.product_id, b.product_id AS neg FROM n JOIN b USING (blk, place))",
    "f AS (SELECT *, " + ", ".join(f"{_F('customer_id', k)} AS p{k}, {_F('product_id', k)} AS q{k}, {_F('neg', k)} AS r{k}" for k in range(4)) + " FROM t)",
    f"s AS (SELECT *, 1.0 / (1.0 + exp({_DOT})) AS g FROM f)",
    "m AS (SELECT 0 AS side, customer_id AS original, " + ", ".join(f"g * (q{k} - r{k}) - 0.01 * p{k} AS g{k}" for k in range(4)) + " FROM s"
    " UNION ALL SELECT 1, product_id, " + ", ".join(f"g * p{k} - 0.01 * q{k}" for k in range(4)) + " FROM s"
    " UNION ALL SELECT 1, neg, " + ", ".join(f"-g * p{k} - 0.01 * r{k}" for k in range(4)) + " FROM s)",
    f"a AS (SELECT side, original, count(*) AS n, {_MEAN} FROM m GROUP BY 1, 2)",
    "e AS (SELECT 0 AS side, customer_id AS original FROM c UNION ALL SELECT 1, product_id FROM i)") + "SELECT side, original, " + ", ".join(
    f"round({_F('original', k)} + coalesce(0.1 * n / (1 + 0.1 * n) * g{k}, 0), 6) AS f{k}" for k in range(4)) + " FROM e LEFT JOIN a USING (side, original)"

# weights in order: 4 x 3, 3, 3 x 2, 2, 2, 1
SQL["scorer_gradients"] = with_(TXN, OWNED, *_NUMBERED,
    "x AS (SELECT customer_id, CAST((u + x) % 2 AS DOUBLE) AS y, " + ", ".join(f"{_F('customer_id', k)} AS x{k}, {_F('product_id', k)} AS x{k + 2}" for k in range(2))
    + " FROM owned JOIN c USING (customer_id) JOIN i USING (product_id))",
    "l1 AS (SELECT *, " + ", ".join("greatest(0, " + " + ".join(f"x{k} * ({_tiny(k * 3 + a)})" for k in range(4)) + f" + ({_tiny(12 + a)})) AS h{a}" for a in range(3)) + " FROM x)",
    "l2 AS (SELECT *, " + ", ".join("greatest(0, " + " + ".join(f"h{a} * ({_tiny(15 + a * 2 + b)})" for a in range(3)) + f" + ({_tiny(21 + b)})) AS k{b}" for b in range(2)) + " FROM l1)",
    f"l3 AS (SELECT *, k0 * ({_tiny(23)}) + k1 * ({_tiny(24)}) + ({_tiny(25)}) AS z FROM l2)",
    "dz AS (SELECT *, 1.0 / (1.0 + exp(-z)) - y AS dz FROM l3)",
    "d2 AS (SELECT *, " + ", ".join(f"CASE WHEN k{b} > 0 THEN dz * ({_tiny(23 + b)}) ELSE 0 END AS e{b}" for b in range(2)) + " FROM dz)",
    "d1 AS (SELECT *, " + ", ".join(f"CASE WHEN h{a} > 0 THEN " + " + ".join(f"e{b} * ({_tiny(15 + a * 2 + b)})" for b in range(2)) + f" ELSE 0 END AS d{a}" for a in range(3)) + " FROM d2)") + (
    "SELECT customer_id, " + ", ".join("round(sum(" + " + ".join(f"d{a} * ({_tiny(k * 3 + a)})" for a in range(3)) + f"), 6) AS g{k}" for k in range(2))
    + ", round(sum(ln(1 + exp(z)) - y * z), 6) AS loss FROM d1 GROUP BY customer_id")

_REPLACED = "('segment:AUTOMOBILE', 'segment:BUILDING', 'segment:MACHINERY')"
SQL["upsert_keys"] = (f"SELECT list_key, rank, product_id, score FROM ({SQL['popular_recency']}) UNION ALL "
                      f"SELECT list_key, rank, product_id, score FROM ({SQL['popular_recency_by_segment']}) WHERE list_key NOT IN {_REPLACED} UNION ALL "
                      f"SELECT list_key, rank, product_id, score FROM ({SQL['popular_trending_by_segment']}) WHERE list_key IN {_REPLACED}")
_ASKED = "(-1, 1, 2, 4, 5, 7, 8, 10, 11)"
SQL["lookup_personalized"] = (f"SELECT customer_id, rank, product_id, source FROM ({SQL['serve_personalized_gated']}) WHERE customer_id IN {_ASKED} UNION ALL "
                              f"SELECT -1, rank, product_id, 'popularity_fallback' FROM ({SQL['popular_recency']})")
SQL["lookup_fbt"] = f"SELECT * FROM ({SQL['serve_fbt']}) WHERE product_id IN {_ASKED}"
SQL["lookup_popular"] = (f"SELECT segment, rank, product_id, source FROM ({SQL['serve_popular']}) WHERE segment IN ('BUILDING', 'HOUSEHOLD') UNION ALL "
                         f"SELECT 'NONE', rank, product_id, 'overall_fallback' FROM ({SQL['popular_recency']})")
SQL["export_personalized"] = (f"SELECT customer_id, string_agg(CAST(product_id AS VARCHAR), ', ' ORDER BY rank) AS recommendations "
                              f"FROM ({SQL['item_cf_topk_gated']}) GROUP BY customer_id")
SQL["export_popular"] = ("SELECT list_key, string_agg(CAST(product_id AS VARCHAR), ', ' ORDER BY rank) AS recommendations FROM ("
                         f"SELECT list_key, rank, product_id FROM ({SQL['popular_recency']}) UNION ALL SELECT list_key, rank, product_id FROM ({SQL['popular_recency_by_segment']})) GROUP BY list_key")
SQL["stored_metrics"] = f"SELECT * REPLACE ('run-b' AS run_id) FROM ({SQL['run_metrics']})"
