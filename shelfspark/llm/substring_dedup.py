"""Substring dedup by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; windows are suffixes cut at that depth. Suffixes are split into
groups by a prefix chosen by content: of the word PREFIX-grams that start in a window, the one of smallest hash (the
leftmost of equal ones) is its anchor. Equal windows have the same anchor at the same place, and neighbouring windows
mostly share theirs, so they travel together as one segment of text instead of one row each.

1. Anchors of all documents are binned by hash; only those that occur more than once can hold a repeat.
2. Segments around such anchors are binned by their prefix. Step 1 also adds up the bytes of the segments of each prefix; where
   they pass BIN_BYTES the prefix is lengthened to the whole window: such windows travel one by one, binned by 128 bits of
   their word hashes, so that no prefix, however common, makes a bin that does not fit in memory.
3. In a bin the subtrees below each prefix grow level by level, STEP words at a time; a node with one leaf is dropped at
   once. What is left at full depth are the deep internal nodes: sets of equal windows. All of a set but
   the earliest (smaller id, then earlier start) are repeats.
4. The words that repeats cover are removed.

Before a shuffle each flush of a task does steps 1 and 3 for itself (and, of lengthened prefixes, finds equal windows): what repeats inside it is told at once, and only its
earliest copy moves on. So a passage that a third of all documents share sends one segment per flush, not one per document.
Texts move only for documents with a repeated anchor, or a repeat, found by a bounded Bloom bitmap.

Null and empty texts have no words; texts shorter than a window keep all; a null id, or one that is no integer, is later than any other. Rows with
equal id and equal text are the same document and are judged alike; different texts under one id order by content hash.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.bitfilter import flag, key_bits, size_bits
from shelfspark.llm.common import text_or_empty, tidy, written
from shelfspark.llm.packed import BIN_BYTES, bin_count, runs, text_bytes
from shelfspark.llm.text_hash import Words, grams, mix, row_chunks, words

WINDOW, PREFIX, STEP, FLUSH_BYTES, ANCHOR_FLUSH, TOLD = 20, 8, 4, 8 << 20, 16 << 20, 4096
ANCHOR = np.dtype([("key", "<u8"), ("rk", "<i8"), ("pos", "<u4"), ("known", "u1"), ("bytes", "<u4")])  # bytes: of its segments
HEAD = np.dtype([("key", "<u8"), ("id", "<i8"), ("rk", "<i8"), ("pos", "<u4"), ("anchor", "<u2"), ("windows", "<u2"), ("bytes", "<u4")])
WHOLE = np.dtype([("key", "<u8"), ("check", "<u8"), ("id", "<i8"), ("rk", "<i8"), ("pos", "<u4")])  # a window under its lengthened prefix
REPEAT = np.dtype([("rk", "<i8"), ("a", "<u4"), ("b", "<u4")])


def anchors(w: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first window, anchor, number of windows) of each run of windows with one anchor, windows and anchors as
    word numbers of the chunk; and the hash of the prefix at each word."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    gram = grams(w.hash, prefix)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(gram, window - prefix + 1).argmin(axis=1)
    whole = row[:n] == row[window - 1:]
    starts = np.flatnonzero(whole)
    cut = np.r_[True, (at[starts][1:] != at[starts][:-1]) | (row[starts][1:] != row[starts][:-1])][:len(starts)]
    begin = np.flatnonzero(cut)
    count = np.diff(np.r_[begin, len(starts)])
    first = starts[begin]
    return np.stack([row[first], first, at[first], count], axis=1), gram


def _rows(batch: pa.RecordBatch, window: int, prefix: int):
    """For each chunk of rows: words, runs of windows, gram hashes, and the index of the chunk's first row."""
    for i, j, data, offs in row_chunks(batch.column("t")):
        w = words(data, offs)
        run, gram = anchors(w, window, prefix)
        if len(run):
            yield i, w, run, gram


def _bins(key: np.ndarray, bins: int) -> np.ndarray:
    return (key >> np.uint64(20)) % np.uint64(bins)


def _spread(done: np.ndarray, bins: int) -> np.ndarray:
    """Bins for what a flush has told: even slices of TOLD entries or more, from a bin on that differs by flush."""
    first = int(mix(done["rk"].astype(np.uint64).sum(keepdims=True))[0] % np.uint64(bins))
    return (first + np.arange(len(done)) // max(TOLD, -(-len(done) // bins))) % bins


def _emit(count: int, bins: np.ndarray, ship: np.ndarray, done: np.ndarray, texts=None, whole=None):
    """Batches (bin, payload, texts, done, whole): a row for each of the ``count`` bins with something to ship, and rows of their own for
    what is already told, spread over all bins, and for windows of lengthened prefixes."""
    order = np.argsort(bins, kind="stable")
    at, n = runs(bins[order])
    payload = [ship[order[a:a + k]].tobytes() for a, k in zip(at, n, strict=True)]
    text = [b"\n".join(texts[x] for x in order[a:a + k]) for a, k in zip(at, n, strict=True)] if texts is not None else [b""] * len(at)
    spread = _spread(done, count)
    cut, size = runs(spread)
    whole = np.zeros(0, WHOLE) if whole is None else whole
    to = _bins(whole["key"], count)
    by_bin = np.argsort(to, kind="stable")
    begin, many = runs(to[by_bin])
    which = np.r_[bins[order][at].astype(np.int64), spread[cut], to[by_bin][begin].astype(np.int64)]
    none = [b""] * (len(cut) + len(begin))
    told = [b""] * len(at) + [done[a:a + k].tobytes() for a, k in zip(cut, size, strict=True)] + [b""] * len(begin)
    long = [b""] * (len(at) + len(cut)) + [whole[by_bin[a:a + k]].tobytes() for a, k in zip(begin, many, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(payload + none, pa.binary()), pa.array(text + none, pa.large_binary()).cast(pa.binary()),
                                      pa.array(told, pa.binary()), pa.array(long, pa.binary())], ["bin", "payload", "texts", "done", "whole"])


MOVED = "bin long, payload binary, texts binary, done binary, whole binary"


def _added(n_bytes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at ``at``, no larger than the field holds."""
    return np.minimum(np.add.reduceat(n_bytes.astype(np.int64), at), (1 << 32) - 1) if len(at) else n_bytes[:0]


def _distinct(a: np.ndarray) -> np.ndarray:
    """Anchors in order of key, row and place, each once; a known one stands for its unknown twin, bytes are added."""
    a = a[np.lexsort((255 - a["known"], a["pos"], a["rk"], a["key"]))]
    same = (a["key"][1:] == a["key"][:-1]) & (a["rk"][1:] == a["rk"][:-1]) & (a["pos"][1:] == a["pos"][:-1])
    at = np.flatnonzero(np.r_[True, ~same][:len(a)])
    out = a[at]
    out["bytes"] = _added(a["bytes"], at)
    return out


def _anchor_flush(parts: list[np.ndarray], bins: int):
    a = _distinct(np.concatenate(parts))
    at, n = runs(a["key"])
    many = np.repeat(n > 1, n)
    ship = a[at]
    ship["known"], ship["bytes"] = n > 1, _added(a["bytes"], at)
    done = np.zeros(int(many.sum()), REPEAT)
    done["rk"], done["a"] = a["rk"][many], a["pos"][many]
    return _emit(bins, _bins(ship["key"], bins), ship, done)


def _find_anchors(window: int, prefix: int, bins: int):
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            rks = batch.column("rk").to_numpy()
            for i, w, run_, gram in _rows(batch, window, prefix):
                a = np.zeros(len(run_), ANCHOR)
                a["key"], a["rk"] = gram[run_[:, 2]], rks[i + run_[:, 0]]
                a["pos"] = run_[:, 2] - w.first[run_[:, 0]]
                a["bytes"] = w.end[run_[:, 1] + run_[:, 3] + window - 2] - w.start[run_[:, 1]] + HEAD.itemsize
                parts.append(a)
                size += a.nbytes
                if size >= ANCHOR_FLUSH:
                    yield from _anchor_flush(parts, bins)
                    parts, size = [], 0
        if parts:
            yield from _anchor_flush(parts, bins)
    return run


def _repeated_anchors(table: pa.Table, most: int = BIN_BYTES) -> pa.Table:
    """Places of repeated anchors; and, under a null rk, the keys whose segments have more than ``most`` bytes."""
    told = np.frombuffer(b"".join(table.column("done").to_pylist()), REPEAT)
    a = _distinct(np.frombuffer(b"".join(table.column("payload").to_pylist()), ANCHOR))
    at, n = runs(a["key"])
    new = np.repeat(n > 1, n) & (a["known"] == 0)
    large = a["key"][at][_added(a["bytes"], at) > most].view(np.int64)
    rk, pos = np.r_[told["rk"], a["rk"][new]], np.r_[told["a"], a["pos"][new]].astype(np.int64)
    return pa.table({"rk": pa.concat_arrays([pa.array(rk), pa.nulls(len(large), pa.int64())]), "pos": np.r_[pos, large]})


def repeats(head: np.ndarray, texts: bytes, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window in it) of every window that is equal to an earlier one, by subtrees grown ``step`` words at a time."""
    none = np.zeros(0, np.int64)
    if not len(head):
        return none, none
    offs = np.r_[0, np.cumsum(head["bytes"].astype(np.int64) + 1)]
    offs[-1] -= 1
    w = words(np.frombuffer(texts, np.uint8), offs)
    n = head["windows"].astype(np.int64)
    seg = np.repeat(np.arange(len(head)), n)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    start = w.first[seg] + k
    place = head["anchor"].astype(np.int64)[seg] - k  # of the prefix within the window
    node = mix(head["key"][seg] + mix(place.astype(np.uint64)))
    leaf = np.arange(len(seg))
    for depth in range(0, window, step):
        label = np.zeros(len(leaf), np.uint64)
        for d in range(depth, min(window, depth + step)):
            label = mix(label + w.hash[start[leaf] + d])
        order = np.lexsort((label, node))
        node, label, leaf = node[order], label[order], leaf[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (label[1:] != label[:-1])][:len(leaf)]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(leaf)])
        child = np.repeat(np.arange(len(at), dtype=np.uint64), size)
        branch = np.repeat(size > 1, size)
        node, leaf = child[branch], leaf[branch]
    if not len(leaf):
        return none, none
    pos = head["pos"].astype(np.int64)[seg[leaf]] + k[leaf]
    ids, rk = head["id"][seg[leaf]], head["rk"][seg[leaf]]
    order = np.lexsort((rk, pos, ids, node))
    node, leaf, pos, ids, rk = node[order], leaf[order], pos[order], ids[order], rk[order]
    first = np.r_[True, node[1:] != node[:-1]]
    group = np.cumsum(first) - 1
    earliest = np.flatnonzero(first)[group]
    # the same window of the same row, met twice, is not later than itself
    later = (ids != ids[earliest]) | (pos != pos[earliest]) | (rk != rk[earliest])
    return seg[leaf[later]], k[leaf[later]]


def _as_runs(head: np.ndarray, seg: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Repeats as runs of windows [a, b] of a row."""
    order = np.lexsort((k, seg))
    seg, k = seg[order], k[order]
    new = np.r_[True, (seg[1:] != seg[:-1]) | (k[1:] != k[:-1] + 1)][:len(seg)]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(seg)])
    out = np.zeros(len(at), REPEAT)
    out["rk"] = head["rk"][seg[at]]
    out["a"] = head["pos"][seg[at]] + k[at]
    out["b"] = out["a"] + size - 1
    return out


def _whole(w: Words, first: np.ndarray, count: np.ndarray, ids: np.ndarray, rks: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """The windows of runs (first window, number of windows; id, key and place in the row) under 128 bits of all their words."""
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first, count) + k
    out = np.zeros(len(start), WHOLE)
    key, check = np.zeros(len(start), np.uint64), np.ones(len(start), np.uint64)
    for d in range(window):
        h = w.hash[start + d]
        key, check = mix(key + h), mix(check ^ mix(h + np.uint64(0x9E3779B97F4A7C15)))
    out["key"], out["check"] = key, check
    out["id"], out["rk"], out["pos"] = np.repeat(ids, count), np.repeat(rks, count), np.repeat(pos, count) + k
    return out


def _whole_repeats(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each set of equal windows, and the others as runs of windows of a row."""
    whole = whole[np.lexsort((whole["rk"], whole["pos"], whole["id"], whole["check"], whole["key"]))]
    first = np.r_[True, (whole["key"][1:] != whole["key"][:-1]) | (whole["check"][1:] != whole["check"][:-1])][:len(whole)]
    earliest = whole[first]
    of = earliest[np.cumsum(first) - 1]
    # the same window of the same row, met twice, is not later than itself
    later = np.unique(whole[(whole["id"] != of["id"]) | (whole["pos"] != of["pos"]) | (whole["rk"] != of["rk"])][["rk", "pos"]])
    rk, pos = later["rk"], later["pos"].astype(np.int64)
    at = np.flatnonzero(np.r_[True, (rk[1:] != rk[:-1]) | (pos[1:] != pos[:-1] + 1)][:len(rk)])
    out = np.zeros(len(at), REPEAT)
    out["rk"], out["a"] = rk[at], pos[at]
    out["b"] = out["a"] + np.diff(np.r_[at, len(rk)]) - 1
    return earliest, out


def _segment_flush(heads: list, texts: list[bytes], wholes: list[np.ndarray], bins: int, window: int):
    head = np.array(heads, HEAD)
    seg, k = repeats(head, b"\n".join(texts), window)
    whole, more = _whole_repeats(np.concatenate([np.zeros(0, WHOLE), *wholes]))
    done = np.concatenate([_as_runs(head, seg, k), more])
    # a segment all of whose windows repeat earlier ones of this flush has nothing new for its bin
    moves = np.bincount(seg, minlength=len(head)) < head["windows"]
    kept = np.flatnonzero(moves)
    return _emit(bins, _bins(head["key"][kept], bins), head[kept], done, [texts[x] for x in kept], whole)


def _cut_segments(window: int, prefix: int, bins: int, large: np.ndarray | None = None):
    """``large``: the prefixes, sorted, that are lengthened to whole windows."""
    large = np.zeros(0, np.uint64) if large is None else large

    def run(batches):
        heads, texts, wholes, size = [], [], [], 0
        for batch in batches:
            rks, ids, wanted = batch.column("rk"), batch.column("ord"), batch.column("pos")
            for i, w, run_, gram in _rows(batch, window, prefix):
                places, longer = {}, []
                raw = w.data.tobytes()
                is_large = np.isin(gram[run_[:, 2]], large).tolist() if len(large) else [False] * len(run_)
                for (row, first, at, count), lengthen in zip(run_.tolist(), is_large, strict=True):
                    if row not in places:
                        places = {row: set(wanted[i + row].as_py())}
                    base = int(w.first[row])
                    if at - base not in places[row]:
                        continue
                    if lengthen:
                        longer.append((first, count, ids[i + row].as_py(), rks[i + row].as_py(), first - base))
                        continue
                    text = raw[w.start[first]:w.end[first + count + window - 2]]
                    heads.append((gram[at], ids[i + row].as_py(), rks[i + row].as_py(), first - base, at - first, count, len(text)))
                    texts.append(text)
                    size += len(text) + HEAD.itemsize
                    if size >= FLUSH_BYTES:
                        yield from _segment_flush(heads, texts, wholes, bins, window)
                        heads, texts, wholes, size = [], [], [], 0
                if longer:
                    wholes.append(_whole(w, *np.array(longer, np.int64).T, window))
                    size += wholes[-1].nbytes
                    if size >= FLUSH_BYTES:
                        yield from _segment_flush(heads, texts, wholes, bins, window)
                        heads, texts, wholes, size = [], [], [], 0
        if heads or wholes:
            yield from _segment_flush(heads, texts, wholes, bins, window)
    return run


def _repeats_of_bin(window: int):
    def run(table: pa.Table) -> pa.Table:
        told = np.frombuffer(b"".join(table.column("done").to_pylist()), REPEAT)
        head = np.frombuffer(b"".join(table.column("payload").to_pylist()), HEAD)
        texts = b"\n".join(t for t, p in zip(table.column("texts").to_pylist(), table.column("payload").to_pylist(), strict=True) if p)
        new = _as_runs(head, *repeats(head, texts, window))
        _, more = _whole_repeats(np.frombuffer(b"".join(table.column("whole").to_pylist()), WHOLE))
        both = np.concatenate([told, new, more])
        return pa.table({"rk": both["rk"], "a": both["a"].astype(np.int64), "b": both["b"].astype(np.int64)})
    return run


def _remove(window: int):
    def run(batches):
        for batch in batches:
            n, gone, left = [], [], []
            for text, spans in zip(batch.column("t"), batch.column("spans"), strict=True):
                w = text.as_py().encode().split()  # bytes: ASCII white space only
                n.append(len(w))
                if spans.is_valid:
                    cover = np.zeros(len(w) + 1, np.int64)
                    a, b = (spans.values.field(x).to_numpy() for x in ("a", "b"))
                    np.add.at(cover, a, 1)
                    np.add.at(cover, b + window, -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    kept = [x for x, ok in zip(w, stays.tolist(), strict=True) if ok]
                else:
                    kept = w
                gone.append(len(w) - len(kept))
                left.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary())],
                                             ["id", "n_words", "n_removed", "kept"])
    return run


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """The rows as (id, rk, t), and the runs of windows [a, b] to be removed as (rk, a, b)."""
    most = BIN_BYTES
    t = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), t).alias("rk"), t.alias("t"))
    size = text_bytes(rows, "t")
    bins = bin_count(size)
    found = rows.select("rk", "t").mapInArrow(tidy(_find_anchors(window, prefix, bins)), MOVED)
    shared = found.groupBy("bin").applyInArrow(lambda table: _repeated_anchors(table, most), "rk long, pos long")
    shared = written(shared.groupBy("rk").agg(F.collect_set("pos").alias("pos")), "anchors")  # no more than a row's words
    # each large prefix has BIN_BYTES of segments, so they are fewer than one for every few megabytes of text
    large = np.sort(np.array([x for r in shared.where("rk is null").collect() for x in r["pos"]], np.int64).view(np.uint64))
    shared = shared.where("rk is not null")
    some = _rows_in(rows, shared).withColumn("ord", F.coalesce(F.expr("try_cast(id as bigint)"), F.lit((1 << 63) - 1)))
    cut = some.select("rk", "t", "ord", "pos").mapInArrow(tidy(_cut_segments(window, prefix, 4 * bins, large)), MOVED)
    out = written(cut.groupBy("bin").applyInArrow(_repeats_of_bin(window), "rk long, a long, b long"), "repeats")
    return rows, out


def _rows_in(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows whose rk is in ``keyed``, joined with it; other rows are kept from the shuffle by a bitmap."""
    bits = size_bits(keyed.count())
    return flag(rows, F.col("rk"), [(key_bits(keyed, F.col("rk"), bits), bits)], "hit").where("hit").drop("hit").join(keyed, "rk")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   prefix: int = PREFIX) -> DataFrame:
    """(id, n_words, n_removed, kept): ``kept`` holds the words that stay, joined by one space, in UTF-8."""
    rows, runs_ = find_repeats(df, id_col, text_col, window, prefix)
    spans = written(runs_.groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    bits = size_bits(spans.count())
    flagged = flag(rows, F.col("rk"), [(key_bits(spans, F.col("rk"), bits), bits)], "hit")
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans")
    judged = (flagged.where("not hit").select("id", "t", none)
              .unionByName(flagged.where("hit").join(spans, "rk", "left").select("id", "t", "spans")))
    kind = rows.schema["id"].dataType.simpleString()
    out = judged.mapInArrow(tidy(_remove(window)), f"id {kind}, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)
