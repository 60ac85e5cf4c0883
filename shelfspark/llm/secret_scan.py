"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are found by three patterns over the whole text. Weak candidates - named identifiers,
token-like strings, endpoints - mean little alone. They are reported only when complementary parts co-occur: each
access identifier, strong or weak, opens a scope of REACH code points to both sides, and an interval join (by blocks of
positions, so only neighbours meet) looks up which secrets and endpoints start inside it.

  weak_id      reported when a secret (assign, hex or weak_secret) starts in its scope
  weak_secret  reported when it starts in the scope of an identifier (access or weak_id)
  endpoint     reported when it starts in the scope of an identifier that has a secret in its scope

Spans of one kind never overlap and have a least length, so a block holds a bounded number of them and the join
is linear in the text. The text is read once; what then shuffles are match positions. A null text counts as empty;
null and repeated ids are rows like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, written


def either_case(words: str) -> str:
    """The pattern with each letter in either case, without flags (engines fold case differently)."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group whose length counts, least length); the first three are the base kinds, fixed by contract.
KINDS = [
    ("assign", f"({either_case('password|passwd|secret|token|api_?key')}){VALUE}", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("weak_id", f"({either_case('client_?id|key_?id|username|user|login|account')}){VALUE}", 2, 4),
    ("weak_secret", "[A-Za-z0-9+/_=-]{20,}", 0, 20),
    ("endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\x20\x09-\x0D"'<>]+""", 0, 8),
]
NAMES = [k[0] for k in KINDS]
BASE, ACCESS, IDS, SECRETS, ENDPOINT = (0, 1, 2), 1, (1, 3), (0, 2, 4), 5
REACH = 256


def _matches(t: Column, kind: int) -> Column:
    """[(kind, i, gap before the match, match)]; the gaps come from splitting by the same pattern."""
    pattern = F.lit(KINDS[kind][1])
    found = F.regexp_extract_all(t, pattern, F.lit(0))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,m:string>>")
    gaps = F.split(t, KINDS[kind][1], -1)
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("m")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), x["m"].alias("m")))
    return F.when(F.size(found) > 0, F.filter(zipped, lambda x: x["m"].isNotNull())).otherwise(none)


def find_parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows as (id, tag), and the candidate spans of all kinds as (tag, kind, start, end, m)."""
    t = text_or_empty(text_col)
    rows = written(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tag"),
                             F.concat(*[_matches(t, k) for k in range(len(KINDS))]).alias("found")), "secrets")
    w = Window.partitionBy("tag", "kind").orderBy("i")
    at = rows.select("tag", F.inline("found")).select(
        "tag", "kind", "m", F.sum(F.col("gap") + F.char_length("m")).over(w).cast("long").alias("end"))
    value = F.col("m")
    for kind in (0, 3):
        value = F.when(F.col("kind") == kind, F.regexp_extract("m", KINDS[kind][1], 2)).otherwise(value)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    mixed = (F.col("kind") != 4) | (F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Za-z]"))
    parts = (at.where((F.char_length(value) >= least) & mixed)
             .select("tag", "kind", (F.col("end") - F.char_length("m")).alias("start"), "end", "m"))
    return rows.select("id", "tag"), parts


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(tag, id_kind, id_start, kind, start, end, whole): the parts that start in each identifier's scope; ``whole``
    says that the scope holds a secret."""
    block = 2 * reach
    scopes = (parts.where(F.col("kind").isin(*IDS))
              .select("tag", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("end").alias("id_end"))
              .withColumn("block", F.explode(F.sequence(
                  F.floor(F.greatest(F.col("id_start") - reach, F.lit(0)) / block), F.floor((F.col("id_end") + reach) / block)))))
    others = (parts.where(F.col("kind").isin(*SECRETS, ENDPOINT))
              .select("tag", "kind", "start", "end", F.floor(F.col("start") / block).alias("block")))
    pairs = scopes.join(others, ["tag", "block"]).where(
        (F.col("start") >= F.col("id_start") - reach) & (F.col("start") < F.col("id_end") + reach)
        # a part inside the identifier's own span is not another part
        & ((F.col("start") >= F.col("id_end")) | (F.col("end") <= F.col("id_start"))))
    w = Window.partitionBy("tag", "id_kind", "id_start")
    return pairs.withColumn("whole", F.max(F.col("kind").isin(*SECRETS)).over(w)).drop("block")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, tag), and the reported spans as (tag, kind, start, end): base ones and linked weak ones."""
    rows, parts = find_parts(df, id_col, text_col)
    parts = written(parts.drop("m"), "secret-parts")
    links = link(parts, reach)
    span = ["tag", "kind", "start", "end"]
    ids = parts.where(F.col("kind") == 3).join(
        links.where("whole").select("tag", F.col("id_kind").alias("kind"), F.col("id_start").alias("start")).distinct(),
        ["tag", "kind", "start"]).select(*span)
    weak = links.where((F.col("kind") == 4) | ((F.col("kind") == ENDPOINT) & F.col("whole"))).select(*span).distinct()
    return rows, parts.where(F.col("kind").isin(*BASE)).select(*span).unionByName(ids).unionByName(weak)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``df``."""
    rows, spans = scan(df, id_col, text_col, reach)
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("kind") + 1)
    named = spans.select("tag", "kind", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s")).alias("x"))
    base = F.col("kind").isin(*BASE)
    lists = named.groupBy("tag").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(base, F.col("x")))).alias("b"), F.sort_array(F.collect_list("x")).alias("a"))
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["s"]), ","), F.lit(""))
    return rows.join(lists, "tag", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n{k}", F.lit(0).cast("long")).alias(f"n_{NAMES[k]}") for k in BASE],
        F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.col("a")).alias("spans"))


def oracle() -> str:
    """DuckDB statement for ``report`` over documents."""
    q = lambda s: s.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT tag, {k} AS kind, unnest(regexp_extract_all(t, '{q(p)}')) AS m, unnest(regexp_split_to_array(t, '{q(p)}')) AS gap,"
        f" unnest(range(len(regexp_split_to_array(t, '{q(p)}')))) AS i FROM d" for k, (_, p, _, _) in enumerate(KINDS))
    value = f"CASE kind WHEN 0 THEN regexp_extract(m, '{q(KINDS[0][1])}', 2) WHEN 3 THEN regexp_extract(m, '{q(KINDS[3][1])}', 2) ELSE m END"
    least = f"[{', '.join(str(k[3]) for k in KINDS)}][kind + 1]"
    names = f"[{', '.join(repr(n) for n in NAMES)}][kind + 1]"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS tag, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({kinds}),
y AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY tag, kind ORDER BY i) AS e FROM x WHERE m IS NOT NULL),
p AS MATERIALIZED (SELECT tag, kind, e - length(m) AS s, e FROM y WHERE length({value}) >= {least}
      AND (kind <> 4 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')))),
l AS (SELECT i.tag, i.kind AS ik, i.s AS id_start, o.kind, o.s, o.e,
             max(o.kind IN (0, 2, 4)) OVER (PARTITION BY i.tag, i.kind, i.s) AS whole
      FROM p i JOIN p o ON i.tag = o.tag AND i.kind IN (1, 3) AND o.kind IN (0, 2, 4, 5) AND o.s >= i.s - {REACH}
           AND o.s < i.e + {REACH} AND (o.s >= i.e OR o.e <= i.s)),
r AS (SELECT tag, kind, s, e FROM p WHERE kind < 3
      UNION SELECT p.tag, p.kind, p.s, p.e FROM p JOIN l ON p.tag = l.tag AND p.kind = 3 AND l.ik = 3 AND p.s = l.id_start AND l.whole
      UNION SELECT tag, kind, s, e FROM l WHERE kind = 4 OR (kind = 5 AND whole)),
n AS (SELECT tag, kind, s, {names} || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS z FROM r),
g AS (SELECT tag, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg(z, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg(z, ',' ORDER BY s, kind) AS a FROM n GROUP BY tag)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (tag)
"""
