"""Quality classification by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled web text (any documents; their labels are never read) are all it learns from: negative labels are not
used. The share of positives in the unlabelled text, the class prior, is estimated first: a classifier of positives
against unlabelled, fitted on one half, ranks the other half, and the prior is the least ratio of unlabelled to positive
rows above any score, with a margin for the number of rows. Then a logistic score minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where R+ and R- are the mean losses as positive and as negative; while the second part is below zero the step
goes up along it, so the fit cannot drive it down by memorising. Features are shares of a text's bytes and words (marks, capitals,
repeated words, pairs and runs of words ...) in steps, and hashed words.

The fit takes at most SAMPLE positives and SAMPLE unlabelled rows, of the smallest hashes, one row per id, of texts of up to TRAIN_CHARS
characters (a documented bound); every text is scored whole, in one pass without a shuffle. A null or empty text
has no words and gets a score from the bias and the steps at 0. Null labels or ids are not learnt from; a row labelled twice is trusted if all its labels are positive; ties in hashes go to the
smaller id; without positives or without unlabelled rows every score is 0.5; repeated rows and extra columns change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, tidy, written
from shelfspark.llm.text_hash import again, grams, mix, row_chunks, words

SAMPLE, TRAIN_CHARS, BUCKETS, STEPS, RIDGE = 6144, 32_768, 256, 300, 1e-3
RISES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)
_SPACES = (0x20, *range(0x09, 0x0E))
_PLAIN = {*_SPACES, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
_ENDS = b".,;:!?'\"()-"


def _mask(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*members]] = True
    return out


#: Classes of bytes whose shares are features.
_CLASSES = [_mask(set(range(128)) - _PLAIN), _mask(set(range(128)) - _PLAIN - set(_ENDS)), _mask(range(48, 58)), _mask(range(65, 91)), _mask(range(128, 256)),
            _mask([0x0A]), _mask(b"!?"), _mask(b"|")]
_ODD_MARK = _CLASSES[1]


class Model(NamedTuple):
    weights: np.ndarray  # of the features and, last, of the bias
    prior: float


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    w = words(data, offs, lower=True)
    n, size, rows = np.diff(w.first), np.maximum(np.diff(offs), 1), len(offs) - 1
    row = np.repeat(np.arange(rows), n)
    shares = [np.diff(np.searchsorted(np.flatnonzero(c[data]), offs)) / size for c in _CLASSES]
    per_word = lambda hit, at=row: np.bincount(at[hit], minlength=rows) / np.maximum(n, 1)
    shares.append(again(row, w.hash, rows) / np.maximum(n, 1))
    for m in (2, 4):
        g = grams(w.hash, m) if len(row) >= m else w.hash[:0]
        whole = row[:len(g)] == row[m - 1:m - 1 + len(g)]
        shares.append(again(row[:len(g)][whole], g[whole], rows) / np.maximum(n, 1))
    shares.append(per_word((w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1]), row[1:]))  # as the word before
    shares.append(per_word(_ODD_MARK[data[w.end - 1]] if len(row) else np.zeros(0, bool)))  # ends in a mark that ends no sentence
    shares.append(per_word((w.end - w.start == 1) & _ODD_MARK[data[w.start]] if len(row) else np.zeros(0, bool)))  # is a mark
    shares.append(np.bincount(row, np.minimum(w.end - w.start, 64), minlength=rows) / np.maximum(n, 1) / 32)
    shares.append(np.minimum(np.log1p(n) / 12, 1))
    x = np.stack(shares, axis=1)
    steps = np.concatenate([np.clip((x - a) / 0.1, 0, 1) for a in RISES], axis=1)
    lexical = np.bincount(row * BUCKETS + (mix(w.hash) % np.uint64(BUCKETS)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    lexical = np.sqrt(lexical / np.maximum(n, 1)[:, None])
    return np.concatenate([steps, lexical, np.ones((rows, 1))], axis=1)


def _features_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([features(data, offs) for _, _, data, offs in row_chunks(pa.array(texts, pa.string()))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under logistic loss: prior * R+(positives), and R-(unlabelled) - prior * R-(positives)."""
    return prior * float(np.logaddexp(0, -z_pos).mean()), float(np.logaddexp(0, z_unl).mean()) - prior * float(np.logaddexp(0, z_pos).mean())


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    """Weights by gradient descent with momentum estimates on the non-negative risk."""
    w = np.zeros(pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = pos @ w, unl @ w
        negative = unl.T @ sigmoid(zu) / len(unl) - prior * (pos.T @ sigmoid(zp)) / len(pos)
        if risks(zp, zu, prior)[1] >= 0:
            g = negative - prior * (pos.T @ sigmoid(-zp)) / len(pos)
        else:
            g = -negative
        g[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled rows."""
    half_p, half_u = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    if min(half_p.sum(), (~half_p).sum(), half_u.sum(), (~half_u).sum()) == 0:
        return 0.5
    w = minimise(pos[half_p], unl[half_u], 0.5, STEPS // 2)  # at a prior of one half: which rows look positive
    zp, zu = np.sort(pos[~half_p] @ w), np.sort(unl[~half_u] @ w)
    at = np.unique(zp[:max(1, len(zp) * 9 // 10)])  # thresholds that keep at least a tenth of the positives
    keeps_p, keeps_u = (1 - np.searchsorted(z, at) / len(z) for z in (zp, zu))
    margin = np.sqrt(np.log(40) / 2)
    bound = (keeps_u + margin / np.sqrt(len(zu)) + margin / np.sqrt(len(zp))) / keeps_p
    return float(np.clip((keeps_u / keeps_p)[bound.argmin()], 0.01, 0.99))


def fit(positives: list[str], unlabelled: list[str]) -> Model:
    if not positives or not unlabelled:
        return Model(np.zeros(0), 0.5)
    pos, unl = _features_of(positives), _features_of(unlabelled)
    prior = estimate_prior(pos, unl)
    return Model(minimise(pos, unl, prior), prior)


def _fit_rows(batches):
    texts: tuple[list[str], list[str]] = ([], [])
    for b in batches:
        for text, trusted in zip(b.column("t").to_pylist(), b.column("trusted").to_pylist(), strict=True):
            texts[trusted].append(text)
    unlabelled, positives = (sorted(x, key=lambda t: (zlib.crc32(t.encode()), t)) for x in texts)  # the fit must not depend on arrival
    model = fit(positives, unlabelled)
    yield pa.RecordBatch.from_arrays([pa.array([model.prior]), pa.array([model.weights.tobytes()], pa.binary())], ["prior", "weights"])


def learn(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` trusted positives and as many unlabelled rows. Only their texts move, to one task."""
    trusted = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id"))
               .agg(F.min(label).alias("y")).where("y > 0").select("id"))
    rows = (df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
            .where(F.col("id").isNotNull() & (F.char_length("t") <= TRAIN_CHARS)))
    # the sample is drawn among ids, without texts; then the texts of the ids drawn are fetched by a bounded broadcast
    first = lambda of, salt: of.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(sample)
    drawn = written(first(trusted, 1).withColumn("trusted", F.lit(1))
                    .unionByName(first(rows.select("id").distinct(), 2).withColumn("trusted", F.lit(0))), "sample")
    texts = rows.join(F.broadcast(drawn), "id").groupBy("id", "trusted").agg(F.min("t").alias("t"))  # one row per id, so the bound holds
    got = texts.select("t", "trusted").repartition(1).mapInArrow(_fit_rows, "prior double, weights binary").collect()
    return Model(np.frombuffer(got[0]["weights"]), got[0]["prior"]) if got else Model(np.zeros(0), 0.5)


def _scores(model):
    def run(batches):
        w = model.value.weights
        for b in batches:
            out = [np.zeros(0)]
            for _, _, data, offs in row_chunks(b.column("t")):
                for a in range(0, len(offs) - 1, 1024):  # features of at most 1,024 rows at a time
                    cut = offs[a:a + 1025]
                    out.append(sigmoid(features(data[cut[0]:cut[-1]], cut - cut[0]) @ w) if len(w) else np.full(len(cut) - 1, 0.5))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(out))], ["id", "score"])
    return run


def score_rows(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per row of ``df``: the chance that the text is of good quality."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    return (rows.mapInArrow(tidy(_scores(shared)), f"id {rows.schema['id'].dataType.simpleString()}, score double")
            .withColumnRenamed("id", id_col))


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
