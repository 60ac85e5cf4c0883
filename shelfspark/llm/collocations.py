"""Phrase collocation mining by Toivonen's method.

A phrase is 1 to LONGEST consecutive words inside one piece (text between marks and line ends) of one language. Its count
includes overlapping occurrences. Frequent phrases are those counted at least ``least`` times; a part of a phrase is
at least as frequent as the phrase.

1. A sample of documents (one of SAMPLE_OF, by content hash; proposals only, no result rests on it) is mined at a lowered threshold. What passes is proposed.
2. One full pass counts, over all documents, the proposed phrases and their negative border, exactly: every word, and every longer
   phrase whose two parts one word shorter are both proposed.
3. A frequent phrase of the border that was not proposed is a border failure; it triggers an expansion pass, which counts every longer
   phrase of frequent words that holds a failure. That closes the frequent phrases: of one not counted in the full pass, the shortest part that was not
   proposed is in the border and is frequent, so it is a failure.
4. A last pass reads the frequent phrases' texts and counts them by text, per language.

Membership of a part is tested in a Bloom bitmap of at most MAX_BITS bits, so what is broadcast is bounded; a false positive only counts one
more phrase, exactly as well. Counts are added up in each task before they are shuffled, packed and binned by hash, so a common word
or line costs one number per flush. While candidates are sought a phrase is its language's and words' 64-bit hash.

A null or empty text has no words; a null language is named by ``unnamed``; empty tables give no rows; repeated rows count as often as they
occur; ties in score go to the larger count, then to the phrase in UTF-8 order; very long texts go in runs of words; ids and extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.bitfilter import bitmap, size_bits
from shelfspark.llm.common import text_or_empty, written
from shelfspark.llm.packed import PACKED, Packer, bin_count, by_bin, runs, text_bytes
from shelfspark.llm.text_hash import hash_spans, mix, row_chunks

LONGEST, LEAST, SAMPLE_OF, LOWERED, MAX_BITS = 5, 100, 16, 0.7, 1 << 28
FLUSH_KEYS, MOST_TEXTS, STRETCH = 4 << 20, 1 << 20, 1 << 22
COUNT = np.dtype([("key", "<u8"), ("n", "<i8")])
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes in stretches of about STRETCH, cut where a piece ends, with the row of each byte run: (bytes, offsets, first row).

    A piece longer than a stretch stays whole.
    """
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + STRETCH)
        if to < n:
            row_end, step = int(offs[np.searchsorted(offs, to, "left")]), 4096
            while to < row_end:
                stop = np.flatnonzero(_KIND[data[to:min(to + step, row_end)]] == 2)
                if len(stop):
                    to += int(stop[0])
                    break
                to, step = min(to + step, row_end), 2 * step
        rows = np.arange(np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, to, "left"))
        yield _LOWER[data[at:to]], np.clip(offs[rows[0]:rows[-1] + 2] - at, 0, to - at), rows
        at = to


class Grams:
    """The words of a stretch, and the keys of the phrases that start at each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, seed: np.ndarray):
        """``seed``: a 64-bit number for the language of each row."""
        kind = _KIND[data]
        word = kind == 0
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        cuts = offs[(offs > 0) & (offs < len(data))]
        begin[cuts] = word[cuts]
        stop[cuts - 1] = word[cuts - 1]
        self.data, self.start, self.end = data, np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] + self.row if len(self.start) else self.row
        self.hash = hash_spans(data, self.start, self.end)
        self.first = mix(self.hash ^ seed[self.row])

    def longer(self, key: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Keys of the phrases of ``m`` words at ``at`` from those of one word less."""
        return mix(key * _ODD + self.hash[at + m - 1])

    def keys(self, inside, longest: int = LONGEST, tested: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, keys) of the phrases of m words whose two parts one word shorter are ``inside(keys)``; every word.

        Parts of more than ``tested`` words pass untested.
        """
        at, key = np.arange(len(self.first)), self.first
        yield 1, at, key
        for m in range(2, longest + 1):
            if m - 1 <= tested:
                held = inside(key)
                at, key = at[held], key[held]
            both = (at[1:] == at[:-1] + 1) & (self.piece[at[1:] + m - 2] == self.piece[at[:-1]])
            at, key = at[:-1][both], key[:-1][both]
            key = self.longer(key, at, m)
            yield m, at, key

    def holding(self, inside, failed, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, keys) of the phrases of m words, every word inside, that hold a shorter phrase that ``failed``."""
        at, holds = None, None
        for m, places, key in self.keys(inside, longest, tested=1):
            if at is not None:
                left = np.searchsorted(at, places)
                kept = holds[left] | holds[left + 1]
                yield m, places[kept], key[kept]
                holds = kept | failed(key)
            else:
                holds = failed(key)
            at = places

    def text(self, at: int, m: int) -> bytes:
        s = self.data[self.start[at]:self.end[at + m - 1]].tobytes()
        return b" ".join(s.split()) if b"  " in s or b"\t" in s else s


class Bits:
    """A Bloom bitmap, as each worker holds it: two slots for a key."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for slot in (key & self.mask, (key >> np.uint64(32)) & self.mask):
            out &= (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def bits_of(keys: DataFrame, n: int) -> np.ndarray:
    """The bitmap of a table of ``n`` keys: built on the executors, at most MAX_BITS bits on the driver."""
    size = size_bits(n, MAX_BITS, 24)
    slots = keys.select(F.explode(F.array(*[F.pmod(F.shiftright("key", by), F.lit(size)) + 1 for by in (0, 32)])).alias("slot"))
    out = np.zeros(size // 8, np.uint8)
    for r in bitmap(slots).collect():
        out[r["bucket"] * 4096 - 4096:r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[Grams, np.ndarray]]:
    """The grams of each stretch of a batch (t, lang), and the row of the batch that each row of the stretch is."""
    langs = batch.column("lang").dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], np.uint64)
    seed = seeds[langs.indices.to_numpy()]
    for i, _, data, offs in row_chunks(batch.column("t")):
        for part, cut, rows in stretches(data, offs):
            yield Grams(part, cut, seed[i + rows]), i + rows


def _counted(parts: list[np.ndarray]) -> np.ndarray:
    key = np.sort(np.concatenate(parts))
    at, n = runs(key)
    out = np.empty(len(at), COUNT)
    out["key"], out["n"] = key[at], n
    return out


def _count(bins: int, lengths, inside=None, tested: int = LONGEST, failed=None):
    """Packed counts of the phrases of ``lengths`` words whose parts are ``inside`` (None: all); or, with ``failed``, of those that hold a
    failure and whose words are inside."""
    def run(batches):
        now = Bits(inside.value) if inside else lambda key: np.ones(len(key), bool)
        fails = Bits(failed.value) if failed else None
        packer, parts, size = Packer(bins), [], 0
        for batch in batches:
            for grams, _ in _grams(batch):
                found = grams.keys(now, max(lengths), tested) if fails is None else grams.holding(now, fails, max(lengths))
                for m, _, key in found:
                    if m in lengths:
                        parts.append(key)
                        size += len(key)
                if size >= FLUSH_KEYS:
                    counted = _counted(parts)
                    yield from packer.add(counted["key"], counted)
                    parts, size = [], 0
        if size:
            counted = _counted(parts)
            yield from packer.add(counted["key"], counted)
        yield from packer.flush()
    return run


def _added(least: int):
    def run(values: np.ndarray) -> dict:
        values = values[np.argsort(values["key"], kind="stable")]
        at, _ = runs(values["key"])
        n = np.add.reduceat(values["n"], at) if len(at) else values["n"]
        often = n >= least
        return {"key": values["key"][at][often].view(np.int64), "n": n[often]}
    return run


MOVED = "bin long, lang string, counts binary, texts binary"


class Texts:
    """The phrases that a task has met: text and language when first met, counts by key."""

    def __init__(self, bins: int):
        self.bins, self.n_words = bins, {}
        self._clear()

    def _clear(self):
        self.known, self.langs, self.texts, self.parts = np.zeros(0, np.uint64), [], [], []
        self.number = np.zeros(0, np.int64)  # of each known key, in the order of first meeting

    def add(self, grams: Grams, names: list[str], m: int, at: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        first, n = runs(key[order])
        key, place = key[order[first]], at[order[first]]
        counted = np.empty(len(key), COUNT)
        counted["key"], counted["n"] = key, n
        self.parts.append(counted)
        new = ~np.isin(key, self.known, assume_unique=True)
        number = len(self.texts) + np.arange(int(new.sum()))
        self.langs.extend(names[r] for r in grams.row[place[new]].tolist())
        self.texts.extend(grams.text(p, m) for p in place[new].tolist())
        known = np.concatenate([self.known, key[new]])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], np.concatenate([self.number, number])[order]

    def flush(self) -> Iterator[pa.RecordBatch]:
        """A row for each bin and language: counts, and the texts, a line each."""
        values = np.concatenate([np.zeros(0, COUNT), *self.parts])
        values = values[np.argsort(values["key"], kind="stable")]
        at, _ = runs(values["key"])
        n = np.add.reduceat(values["n"], at) if len(at) else values["n"]
        to: dict[tuple[int, str], list[int]] = {}
        for k, (b, x) in enumerate(zip(((self.known >> np.uint64(24)) % np.uint64(self.bins)).tolist(), self.number.tolist(), strict=True)):
            to.setdefault((b, self.langs[x]), []).append(k)
        rows = [(b, lang, n[np.array(ks)].astype(np.int64).tobytes(), b"\n".join(self.texts[self.number[k]] for k in ks)) for (b, lang), ks in to.items()]
        # the number of a language's words travels under an empty text, a bin chosen by its name
        rows += [(len(lang.encode()) % self.bins, lang, np.int64(k).tobytes(), b"") for lang, k in self.n_words.items()]
        self._clear()
        self.n_words = {}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)]
                                         if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary())],
                                         ["bin", "lang", "counts", "texts"])


def _texts(inside, longest: int, bins: int):
    """The phrases that are inside, and the number of words of each language, packed per task."""
    def run(batches):
        held, met = Bits(inside.value), Texts(bins)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for grams, rows in _grams(batch):
                names = [langs[r] for r in rows]
                for r, k in zip(names, np.bincount(grams.row, minlength=len(rows)).tolist(), strict=True):
                    met.n_words[r] = met.n_words.get(r, 0) + k
                for m, at, key in grams.keys(held, longest):
                    found = held(key)
                    met.add(grams, names, m, at[found], key[found])
                if len(met.texts) >= MOST_TEXTS or len(met.parts) >= 1024:
                    yield from met.flush()
        yield from met.flush()
    return run


def _by_text(least: int):
    def run(table: pa.Table) -> pa.Table:
        n: dict[tuple[str, bytes], int] = {}
        for lang, counts, texts in zip(*(table.column(c).to_pylist() for c in ("lang", "counts", "texts")), strict=True):
            for text, k in zip(texts.split(b"\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                n[lang, text] = n.get((lang, text), 0) + k
        often = [(lang, text.decode(), k) for (lang, text), k in n.items() if k >= least or not text]
        return pa.table({"lang": pa.array([x[0] for x in often], pa.string()), "phrase": pa.array([x[1] for x in often], pa.string()),
                         "n": pa.array([x[2] for x in often], pa.int64())})
    return run


def frequent_phrases(df: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang",
                     unnamed: str = "und", sample_of: int = SAMPLE_OF) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, n) of every phrase counted ``least`` times or more, and (lang, n) of all words."""
    spark = df.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(unnamed))
    rows = df.select(text_or_empty(text_col).alias("t"), lang.alias("lang"))
    bins = bin_count(text_bytes(rows, "t"))

    def counts(of: DataFrame, at_least: int, lengths, inside=None, tested=longest, failed=None) -> DataFrame:
        shared = [x and spark.sparkContext.broadcast(x.bits) for x in (inside, failed)]
        packed = of.mapInArrow(_count(bins, lengths, shared[0], tested, shared[1]), PACKED)
        return written(by_bin(packed, COUNT, _added(at_least), "key long, n long"), "phrase-counts")

    def bits(keys: DataFrame) -> Bits:
        return Bits(bits_of(keys, keys.count()))

    # 1. proposals, from a sample: words and pairs, then what the pairs allow
    sample = rows.where(F.pmod(F.xxhash64("t", "lang", F.lit(7)), F.lit(sample_of)) == 0)
    low = max(2, int(LOWERED * least / sample_of))
    proposed = counts(sample, low, (1, 2)).select("key")
    if longest > 2:
        proposed = proposed.unionByName(counts(sample, low, tuple(range(3, longest + 1)), bits(proposed), tested=2).select("key"))
    # 2. the full pass over proposals and negative border
    inside = bits(proposed)
    frequent = counts(rows, least, tuple(range(1, longest + 1)), inside)
    # 3. border failures, and the phrases that hold them
    failed = _outside(frequent, inside, spark)
    n_failed = failed.count()
    if n_failed and longest > 1:
        more = counts(rows, least, tuple(range(2, longest + 1)), bits(frequent.select("key")), failed=Bits(bits_of(failed, n_failed)))
        frequent = frequent.select("key").unionByName(more.select("key")).distinct()
    # 4. the texts
    held = spark.sparkContext.broadcast(bits(frequent.select("key")).bits)
    texts = rows.mapInArrow(_texts(held, longest, bins), MOVED)
    texts = written(texts.groupBy("bin").applyInArrow(_by_text(least), "lang string, phrase string, n long"), "phrases")
    phrases = texts.where("phrase <> ''").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("m"), "n")
    return phrases, texts.where("phrase = '' and n > 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _outside(keys: DataFrame, inside: Bits, spark) -> DataFrame:
    """The keys that are not in the bitmap."""
    shared = spark.sparkContext.broadcast(inside.bits)

    def run(batches):
        held = Bits(shared.value)
        for b in batches:
            out = ~held(b.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(out))], ["key"])
    return keys.select("key").mapInArrow(run, "key long")


def collocations(df: DataFrame, top: int = 2000, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang",
                 unnamed: str = "und") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    The score is floor(1000 a n / (l r)) of the cut for which it is lowest (ties: the leftmost); a phrase that a longer candidate as frequent
    holds is left out. All arithmetic is exact.
    """
    phrases, totals = frequent_phrases(df, least, longest, text_col, lang_col, unnamed)
    cand = phrases.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    held = (cand.where("m > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("m") - 1), joined(F.lit(2), F.col("m") - 1))).alias("phrase"), "a")
            .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    open_ = cand.join(held, ["lang", "phrase"], "left").where("within is null or within < a")
    cuts = open_.select("lang", "phrase", "m", "w", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("x"), joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("y"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = (cuts.withColumn("top", (whole("a") * whole("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn("bottom", whole("l") * whole("r"))
            .withColumn("score", F.expr("top div bottom")))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return (scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
