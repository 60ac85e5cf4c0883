"""Mixing sources to target weights, with soft membership.

A classifier learnt from a labelled table gives each document its posteriors p over the domains. Document i, of n_i tokens
(words), gets the rate base + e_i with e_i >= 0; the expected tokens of domain d are T_d = sum over i of
(base + e_i) * n_i * p_id. The rates minimise the weighted squares (T - target)' M^-1 (T - target), M being the sum of
n_i * p_i p_i': projected gradient, in which a step changes e_i by p_i . M^-1 (T - target), has unit step length, and every step lowers
the sum. A step is one pass over the narrow table of tokens and posteriors; only T, a number per domain, reaches the
driver, and a document's rate follows from its own posteriors and the steps so far, so nothing is joined back.

Targets are weights; the total is the least at which no domain has to shrink below its base, so with base 1 every document
stays once and scarce domains repeat. A fraction of a copy is drawn by a hash of id and text.

Domains and their labelled counts come from the whole labelled table. The classifier is a softmax over hashed words and a few counts,
fitted on at most SAMPLE labelled rows, an equal quota of each domain (smallest id hashes; the first TRAIN_CHARS characters of a text; a
documented bound), with the domains' true shares put back into the biases, and used on whole texts. Null and empty texts have no tokens and get the base
rate. Null labels are not learnt from; without labels, or with one domain, all documents have one domain and the base rate; more than MOST_DOMAINS domains are an error. Ties,
repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from shelfspark.llm.common import packed, text_or_empty, tidy, written
from shelfspark.llm.text_hash import again, mix, row_chunks, words

SAMPLE, TRAIN_CHARS, BUCKETS, MOST_DOMAINS, STEPS, PASSES, ENOUGH = 8192, 32_768, 4096, 64, 200, 24, 1e-4
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 9, 10, 11, 12, 13, 32]] = False
COUNTS, ROWS = 5, 512  # dense features; rows whose word buckets are held at a time


class Model(NamedTuple):
    domains: list[str]
    weights: np.ndarray  # (BUCKETS + COUNTS + 1, domains)


def _features(data: np.ndarray, offs: np.ndarray):
    """For each row: word count and dense counts; for each word: its row and bucket."""
    w = words(data, offs, lower=True)
    n = np.diff(w.first)
    row = np.repeat(np.arange(len(n)), n)
    size = np.maximum(np.diff(offs), 1)
    total = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), offs)) / size
    same = again(row, w.hash, len(n)) / np.maximum(n, 1)  # words that occur again in their row
    dense = np.stack([4 * total(_MARK[data]), 4 * total((data >= 48) & (data < 58)), 4 * total(data >= 128), same,
                      np.log1p(n) / 8, np.ones(len(n))], axis=1)
    return n, dense, row, (mix(w.hash) % np.uint64(BUCKETS)).astype(np.int64)


def _bags(n, row, bucket):
    """In blocks of rows (from, to): how often each row has words of each bucket, over the root of its length."""
    words_of = np.searchsorted(row, np.arange(len(n) + 1))
    for a in range(0, len(n), ROWS):
        b = min(len(n), a + ROWS)
        at = slice(words_of[a], words_of[b])
        bags = np.bincount((row[at] - a) * BUCKETS + bucket[at], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS).astype(np.float32)
        yield a, b, bags / np.sqrt(np.maximum(n[a:b], 1), dtype=np.float32)[:, None]


def _logits(model: Model, n, dense, row, bucket) -> np.ndarray:
    z = dense @ model.weights[BUCKETS:]
    for a, b, bags in _bags(n, row, bucket):
        z[a:b] += bags @ model.weights[:BUCKETS].astype(np.float32)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str]) -> Model:
    """Softmax regression by gradient descent with momentum estimates, on the rows given."""
    domains = sorted(set(labels))
    y = np.array([domains.index(x) for x in labels])
    dense = np.zeros((len(texts), COUNTS + 1))
    all_bags = np.zeros((len(texts), BUCKETS), np.float32)  # made once: at most SAMPLE rows; the words themselves go block by block
    for first, last, data, offs in row_chunks(pa.array(texts, pa.string())):
        n, dense[first:last], row, bucket = _features(data, offs)
        for a, b, bags in _bags(n, row, bucket):
            all_bags[first + a:first + b] = bags
    model = Model(domains, np.zeros((BUCKETS + COUNTS + 1, len(domains))))
    w, m, v = model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights)
    hot = np.eye(len(domains))[y]
    for step in range(1, STEPS + 1):
        z = dense @ w[BUCKETS:] + all_bags @ w[:BUCKETS].astype(np.float32)
        g = (_softmax(z) - hot) / len(y)
        grad = np.concatenate([(g.T.astype(np.float32) @ all_bags).T, dense.T @ g]) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return model


def _fit_rows(batches):
    texts, labels, counts = [], [], {}
    for b in batches:
        texts += b.column("t").to_pylist()
        labels += b.column("y").to_pylist()
        counts |= dict(zip(b.column("y").to_pylist(), b.column("n").to_pylist(), strict=True))
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))  # the fit must not depend on arrival
    model = fit([texts[i] for i in order], [labels[i] for i in order]) if texts else Model([], np.zeros((0, 0)))
    if texts:  # the quotas make domains alike in number; the bias gets their shares back
        drawn, n = (np.array([c[d] for d in model.domains], float) for c in (Counter(labels), counts))
        model.weights[-1] += np.log(n / n.sum()) - np.log(drawn / drawn.sum())
    yield pa.RecordBatch.from_pydict({"domain": pa.array(model.domains, pa.string()),
                                      "weights": pa.array([model.weights[:, d].tobytes() for d in range(len(model.domains))], pa.binary())})


def learn(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``labelled`` (id, domain), of every domain that labels a row of ``df``. Only the sampled ids are
    broadcast, only their texts move."""
    known = labelled.select(F.col(id_col).alias("id"), F.col("domain").cast("string").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    known = written(known.join(df.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"), "labels")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).take(MOST_DOMAINS + 1)}
    if len(n) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    picked = None
    for y in sorted(n):
        some = (known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max(1, sample // len(n)))
                .select("id", "y", F.lit(n[y]).cast("long").alias("n")))
        picked = some if picked is None else picked.unionByName(some)
    got = []
    if picked is not None:
        picked = written(picked, "label-sample")
        rows = (df.select(F.col(id_col).alias("id"), F.substring(text_or_empty(text_col), 1, TRAIN_CHARS).alias("t"))
                .join(F.broadcast(picked), "id")
                .groupBy("id", "y", "n").agg(F.min("t").alias("t")).select("t", "y", "n"))  # one row per id, so the bound holds for rows
        got = sorted(rows.repartition(1).mapInArrow(tidy(_fit_rows), "domain string, weights binary").collect())
    if not got:
        return Model(["all"], np.zeros((BUCKETS + COUNTS + 1, 1)))
    return Model([r["domain"] for r in got], np.stack([np.frombuffer(r["weights"]) for r in got], axis=1))


def _posteriors(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(model.domains)))]
    for _, _, data, offs in row_chunks(column):
        f = _features(data, offs)
        n.append(f[0])
        p.append(_softmax(_logits(model, *f)))
    return np.concatenate(n), np.concatenate(p)


def extra(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """e after the steps taken so far, from a document's posteriors alone."""
    e = np.zeros(len(p))
    for g in steps:
        e = np.maximum(0.0, e - p @ g)
    return e


def _narrow(model):
    def run(batches):
        for b in batches:
            n, p = _posteriors(b.column("t"), model.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["id", "u", "n", "p"])
    return run


def _sums(d: int, steps: list[np.ndarray], base: float, square: bool):
    """Partial sums of T and, if asked for, of M, as (slot, value)."""
    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(-1, d)
            n = b.column("n").to_numpy().astype(float)
            out = ((base + extra(p, steps)) * n) @ p
            out = np.concatenate([out, ((p * n[:, None]).T @ p).ravel()]) if square else out
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out, pa.float64())], ["slot", "value"])
    return run


class Mix(NamedTuple):
    model: Model
    steps: list[np.ndarray]
    base: float
    target: np.ndarray  # tokens
    reached: np.ndarray
    objective: list[float]
    table: DataFrame  # (id, u, n, p) of every row the rates were fitted on
    settled: bool  # the targets are reached, or no step lowers the sum any more


def fit_rates(df: DataFrame, model: Model, power: float = 0.5, weights: dict[str, float] | None = None, base: float = 1.0,
              text_col: str = "text", id_col: str = "doc_id") -> Mix:
    """Rates for target weights: those given, or each domain's share to the ``power``. At most PASSES steps; ``settled`` says whether
    they sufficed."""
    if weights is not None and (unknown := set(weights) - set(model.domains)):
        raise ValueError(f"targets for unknown domains: {sorted(unknown)}")
    shared = df.sparkSession.sparkContext.broadcast(model)
    d = len(model.domains)
    t = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), t).alias("u"), t.alias("t"))
    table = written(rows.mapInArrow(tidy(_narrow(shared)), f"id {rows.schema['id'].dataType.simpleString()}, u long, n long, p array<double>"), "posteriors")

    def sums(steps, square=False):
        rows = table.select("n", "p").mapInArrow(_sums(d, steps, base if steps or base else 1.0, square), "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(d + d * d * square)
        for r in rows:
            out[r["slot"]] = r["value"]
        return out

    first = sums([], True)
    now, m = first[:d], first[d:].reshape(d, d)
    total = now.sum()
    share = now / total if total else np.full(d, 1 / d)
    aim = np.array([weights.get(x, 0.0) for x in model.domains]) if weights else share ** power
    aim = aim / aim.sum()
    # the least total at which no domain shrinks; a domain without a target cannot bound it
    target = aim * total * max([1.0, *(share[aim > 0] / aim[aim > 0])]) if base else aim * total
    now = now if base else np.zeros(d)
    inverse = np.linalg.inv(m + np.eye(d) * (1e-9 * max(1.0, np.trace(m))))
    steps, objective = [], [float((now - target) @ inverse @ (now - target))]
    settled = objective[-1] == 0
    while len(steps) < PASSES and not settled:
        steps.append(inverse @ (now - target))
        now = sums(steps)
        objective.append(float((now - target) @ inverse @ (now - target)))
        settled = np.abs(now - target).max() <= ENOUGH * target.sum() or objective[-2] - objective[-1] <= 1e-9 * objective[0]
    return Mix(model, steps, base, target, now, objective, table, bool(settled))


def _outcome(names, steps, base, n, p) -> list[pa.Array]:
    """Tokens, likeliest domain and rate."""
    rate = np.where(n > 0, base + extra(p, steps), base)
    return [pa.array(n, pa.int64()), pa.array([names[k] for k in p.argmax(axis=1)], pa.string()), pa.array(rate, pa.float64())]


OUTCOME = [StructField("n_tokens", LongType()), StructField("domain", StringType()), StructField("rate", DoubleType())]


def _rates(model, steps, base, passed: list[str]):
    def run(batches):
        for b in batches:
            n, p = _posteriors(b.column("t"), model.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *_outcome(model.value.domains, steps, base, n, p)], [*passed, "n_tokens", "domain", "rate"])
    return run


def _known_rates(names, steps, base):
    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), *_outcome(names, steps, base, b.column("n").to_numpy(), p)],
                                             ["id", "u", "n_tokens", "domain", "rate"])
    return run


def _copies(out: DataFrame) -> DataFrame:
    draw = F.pmod("u", F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")).drop("u")


def _with_rates(rows: DataFrame, mix_: Mix, passed: list[str]) -> DataFrame:
    """``rows`` (with the text as t and a hash as u): the passed columns, tokens, likeliest domain, rate and copies."""
    shared = rows.sparkSession.sparkContext.broadcast(mix_.model)
    kinds = StructType([rows.schema[c] for c in [*passed, "u"]] + OUTCOME)
    return _copies(rows.mapInArrow(tidy(_rates(shared, mix_.steps, mix_.base, [*passed, "u"])), kinds))


def fitted_rates(mix_: Mix, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, domain, rate, copies) of every row the rates were fitted on, from what that pass stored: no text is read again."""
    kinds = StructType([mix_.table.schema["id"], mix_.table.schema["u"], *OUTCOME])
    return _copies(mix_.table.mapInArrow(_known_rates(mix_.model.domains, mix_.steps, mix_.base), kinds)).withColumnRenamed("id", id_col)


def rate_rows(df: DataFrame, mix_: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, domain, rate, copies), one row per row of ``df``."""
    t = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), t.alias("t"), F.xxhash64(F.col(id_col), t).alias("u"))
    return _with_rates(rows, mix_, ["id"]).withColumnRenamed("id", id_col)


def mix_rows(df: DataFrame, mix_: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as its copies say."""
    cols, t = df.columns, text_or_empty(text_col)
    rows = df.select(packed(df), t.alias("t"), F.xxhash64(F.col(id_col), t).alias("u"))
    out = _with_rates(rows, mix_, ["row"]).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
