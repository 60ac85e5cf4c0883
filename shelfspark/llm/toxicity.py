"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's score is a logistic function of the weights of its words and of their beginnings; a document is toxic when any sentence is: 1 minus
the product of the sentences' complements. The weights fit the documents' labels by gradient descent on the noisy-or
likelihood, over a bounded sample: SAMPLE labelled rows of each label, those with the smallest id hashes, of texts up to
TRAIN_CHARS characters (a documented bound; every text is scored whole). Scoring is one pass without a shuffle, and the
sentence scores locate the offending sentences.

A null or empty text has no sentence and scores 0. Labels that are null or whose row is missing are not learnt from; a
row labelled twice counts as toxic if any label says so. Without rows of both labels every score is 0. Repeated rows,
null ids and extra columns change nothing; ties in id hashes go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from shelfspark.llm.common import packed, text_or_empty, tidy, written

SAMPLE, TRAIN_CHARS, LEAST_DOCS, LEAST_CHI2, RIDGE, STEPS = 4096, 32_768, 4, 10.83, 2e-4, 300
MAX_WORDS, LONG_TEXT = 200_000, 1 << 20
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")


def tokens(text: str):
    """Words in lower case, and the marks that end a sentence."""
    found = TOKEN.findall(text) if len(text) < LONG_TEXT else (m[0] for m in TOKEN.finditer(text))
    return map(str.lower, found)


def features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings, which inflected forms share."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 4 else (word, word + "*")


def _telling(docs: list[set[str]], y: np.ndarray) -> dict[str, int]:
    """Numbers of the features whose presence goes with the label: chi-square at LEAST_CHI2 or more, LEAST_DOCS texts."""
    with_toxic, with_any = Counter(), Counter()
    for found, label in zip(docs, y, strict=True):
        with_any.update(found)
        if label:
            with_toxic.update(found)
    n, toxic, kept = len(y), y.sum(), []
    for f, k in with_any.items():
        if LEAST_DOCS <= k < n:
            a = with_toxic[f]
            chi2 = n * (a * n - k * toxic) ** 2 / (k * (n - k) * toxic * (n - toxic))
            if chi2 >= LEAST_CHI2:
                kept.append(f)
    return {f: i for i, f in enumerate(sorted(kept))}


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> dict[str, float]:
    """Feature weights, and the bias under the empty word. ``weights``: of a clean and of a toxic document."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {}
    number = _telling([{f for t in set(tokens(text)) - STOPS for f in features(t)} for text in texts], y)
    k = len(number)
    sent, feature, of, n = [], [], [], 0
    for d, text in enumerate(texts):
        words = 0
        for t in tokens(text):
            if t not in STOPS:
                if not words:
                    of.append(d)
                    n += 1
                words += 1
                for f in features(t):
                    if f in number:
                        sent.append(n - 1)
                        feature.append(number[f])
            else:
                words = 0
    if not n:
        return {}
    sent, feature, of = np.array(sent, np.int64), np.array(feature, np.int64), np.array(of)
    w = np.zeros(k + 1)
    w[k] = np.log(0.1 / 0.9) - np.log(max(1.0, n / len(y)))  # at first a document is toxic with a chance of about 0.1
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    of_weight = np.where(y > 0, weights[1], weights[0])
    total = of_weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(sent, w[feature], minlength=n) + w[k]
        soft = np.logaddexp(0, z)
        clean = -np.bincount(of, soft, minlength=len(y))  # log of the chance that no sentence is toxic
        rest = np.maximum(-np.expm1(np.minimum(clean, -1e-9)), 1e-9)
        by_z = np.exp(z - soft) * (of_weight * np.where(y > 0, -np.exp(clean) / rest, 1.0))[of]
        g = np.append(np.bincount(feature, by_z[sent], minlength=k)[:k], by_z.sum()) / total
        g[:k] += RIDGE * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return {"": float(w[k])} | {f: float(w[i]) for f, i in number.items()}


class Words(dict):
    """A word's weight, summed over its features when first asked for; emptied when full."""

    def __init__(self, model: dict[str, float]):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        z = self[word] = sum(self.model.get(f, 0.0) for f in features(word))
        return z


def sentence_scores(text: str, model: Words):
    """(log-odds, words) of each sentence in turn; a sentence without words is left out."""
    bias = model.model[""]
    z, words = bias, 0
    for t in tokens(text):
        if t in STOPS:
            if words:
                yield z, words
            z, words = bias, 0
        else:
            words += 1
            z += model[t]
    if words:
        yield z, words


def score(text: str, model: Words) -> float:
    """The noisy-or of the sentence scores."""
    if not model.model:
        return 0.0
    z = np.fromiter((z for z, _ in sentence_scores(text, model)), float)
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def offending(text: str, model: Words) -> list[dict]:
    """Code point spans, with scores, of the sentences that are toxic by themselves (0.5 or more)."""
    if not model.model:
        return []
    at, out = (m for m in TOKEN.finditer(text) if m[0] not in STOPS), []
    for z, words in sentence_scores(text, model):
        first = last = next(at)
        for _ in range(words - 1):
            last = next(at)
        if z >= 0:
            out.append({"start": first.start(), "end": last.end(), "score": float(1 / (1 + np.exp(-z)))})
    return out


def _fit_rows(batches):
    texts, labels, shares = [], [], {}
    for b in batches:
        texts += b.column("t").to_pylist()
        labels += b.column("y").to_pylist()
        shares |= dict(zip(b.column("y").to_pylist(), b.column("n").to_pylist(), strict=True))
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))  # the fit must not depend on arrival
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    weight = tuple(shares.get(k, 0) / max(1, labels.count(k)) for k in (0, 1))
    model = fit(texts, labels, weight) if texts else {}
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(model), pa.string()), "weight": pa.array(list(model.values()), pa.float64())})


def learn(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> dict[str, float]:
    """Fit on at most ``sample`` rows of each label. The sampled ids are broadcast, so no text moves but theirs."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg((F.max(label) > 0).cast("int").alias("y")))
    known = written(known, "labels")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(n):
        some = (known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
                .select("id", "y", F.lit(n[y]).cast("long").alias("n")))
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return {}
    picked = written(picked, "label-sample")
    rows = (df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
            .where(F.char_length("t") <= TRAIN_CHARS).join(F.broadcast(picked), "id")
            .groupBy("id", "y", "n").agg(F.min("t").alias("t")).select("t", "y", "n"))  # one row per id, so the bound holds for rows
    return {r["word"]: r["weight"] for r in rows.repartition(1).mapInArrow(tidy(_fit_rows), "word string, weight double").collect()}


def _scorer(model, spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        weights = Words(model.value)
        for batch in batches:
            texts = batch.column(1)
            cols = {"id": batch.column(0), "score": pa.array([score(t.as_py(), weights) for t in texts], pa.float64())}
            if spans:
                cols["sentences"] = pa.array([offending(t.as_py(), weights) for t in texts], kind)
            yield pa.RecordBatch.from_pydict(cols)
    return run


def score_rows(df: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
               spans: bool = False) -> DataFrame:
    """(id, score), and with ``spans`` the offending sentences as code point spans with their scores."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most the words of the bounded sample
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    out = "score double" + ", sentences array<struct<start:int,end:int,score:double>>" * spans
    return rows.mapInArrow(tidy(_scorer(shared, spans)), f"id {rows.schema['id'].dataType.simpleString()}, {out}").withColumnRenamed("id", id_col)


def _scored_rows(model, text_col: str):
    def run(batches):
        weights = Words(model.value)
        for batch in batches:  # the text is read inside the row, so that it travels once
            scores = [score(t.as_py() or "", weights) for t in batch.column("row").field(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])
    return run


def drop_toxic(df: DataFrame, model: dict[str, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below the threshold, with its columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(packed(df))
    scored = rows.mapInArrow(tidy(_scored_rows(shared, text_col)), StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return scored.where(F.col("score") < threshold).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
