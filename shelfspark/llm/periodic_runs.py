"""Periodic run detection: a suffix automaton whose link tree is a link-cut tree.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, 2q) that no neighbouring word
extends with period q. Words are appended to the automaton one by one. A state's colour is the place where its words last ended; an access
from the state of the new prefix to the root recolours that path. The path falls into segments of one old colour: a segment that
ended d words earlier, whose suffixes have more than a and at most b words, with a < d <= b, shows a square of period d that ends here;
its suffix of b words is the longest that also ended d words earlier, so the stretch of b + d words has smallest period d and goes no
further to the left. The last end of a (start, period) gives the run.

Words that no run can hold stay out of the automaton: every word of a run lies in a GRAM-gram that occurs twice inside the run, so
only stretches covered by such repeats ("islands") are searched. They are found by hashes, which can only let more words in; the
automaton compares words themselves.

``find_runs`` is one pass without a shuffle: a row's work stays in its task, and memory follows its longest island (about
LEAN bytes a word). Null and empty texts have no words and no runs; a null id is kept; repeated rows are judged each for itself; ties do not matter, as all runs
are returned, by start, then period; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty
from shelfspark.llm.packed import runs as equal_runs
from shelfspark.llm.text_hash import Words, grams, mix, row_chunks, words

LEAST, GRAM, LEAN = 12, 6, 100
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs_of(seq: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers from 0 on, by start, then period."""
    size = 2 * len(seq) + 2
    numbers = lambda: array("i", bytes(4 * size))
    # states: suffix link, longest length; the first transition, and others in a dictionary
    link, length, word, onto, more = numbers(), numbers(), array("i", [-1]) * size, numbers(), {}
    # link-cut tree: a splay tree for each path, ``up`` of its root is the path's parent; ``ended`` of its root is the path's colour
    left, right, up, ended = numbers(), numbers(), numbers(), numbers()
    found: dict[tuple[int, int], int] = {}

    def rotate(x):
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[x], up[y] = z, x
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def splay(x):
        top = 0
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                rotate(y if (left[z] == y) == (left[y] == x) else x)
                top = z
            else:
                top = y
            rotate(x)
            y = up[x]
        if top:
            ended[x] = ended[top]

    states = tail = root = 1
    for i, c in enumerate(seq, 1):
        states += 1
        now, p, q = states, tail, 0
        length[now] = i
        while p:
            if word[p] == c:
                q = onto[p]
                break
            if word[p] < 0:
                word[p], onto[p] = c, now
            elif p not in more:
                more[p] = {c: now}
            else:
                q = more[p].get(c, 0)
                if q:
                    break
                more[p][c] = now
            p = link[p]
        parent = q or root
        if q and length[q] != length[p] + 1:
            states += 1
            parent = copy = states
            length[copy], link[copy], word[copy], onto[copy] = length[p] + 1, link[q], word[q], onto[q]
            if q in more:
                more[copy] = dict(more[q])
            link[q] = copy
            splay(q)  # the copy stands just above q on q's path
            above = left[copy] = left[q]
            if above:
                up[above] = copy
            left[q], up[copy] = copy, q
            while p:
                if word[p] == c:
                    if onto[p] != q:
                        break
                    onto[p] = copy
                elif p in more and more[p].get(c) == q:
                    more[p][c] = copy
                else:
                    break
                p = link[p]
        link[now] = up[now] = parent
        tail = now
        # access: a segment of the path at a time, from the new prefix to the root
        x, below = now, 0
        while x:
            splay(x)
            at = ended[x]
            if right[x]:
                ended[right[x]] = at
            right[x] = below
            w = up[x]
            if at:
                d, b = i - at, length[x]
                if length[w] < d <= b and d + b >= least:
                    found[i - d - b, d] = i
            below, x = x, w
        ended[below] = i
    return sorted((start, end - start, d) for (start, d), end in found.items())


def islands(w: Words, least: int = LEAST, gram: int = GRAM) -> np.ndarray:
    """(row, first word, end word) of the stretches, within rows, that can hold runs: covered by repeated grams, in two rounds, the
    second of which asks for repeats inside the stretch itself."""
    n = len(w.hash)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    key, group = grams(w.hash, gram), row
    for _ in range(2):
        at = np.flatnonzero((group[:n - gram + 1] == group[gram - 1:]) & (group[:n - gram + 1] >= 0))
        label = mix(key[at] + group[at].astype(np.uint64) * _ODD)
        order = np.argsort(label)
        first, size = equal_runs(label[order])
        again = at[order[np.repeat(size > 1, size)]]
        cover = np.zeros(n + 1, np.int64)
        cover[again] += 1
        cover[again + gram] -= 1
        inside = np.cumsum(cover[:-1]) > 0
        begin = inside & np.r_[True, ~inside[:-1] | (row[1:] != row[:-1])]
        number = np.cumsum(begin) - 1
        group = np.where(inside, number, -1)
        if not inside.any():
            return none
    a = np.flatnonzero(begin)
    size = np.bincount(number[inside], minlength=len(a))
    a, size = a[size >= least], size[size >= least]
    return np.stack([row[a], a, a + size], axis=1)


def _runs_of_rows(column: pa.Array, least: int):
    """For each text of a column: its words, and its runs."""
    for i, j, data, offs in row_chunks(column):
        w = words(data, offs)
        raw = data.tobytes()
        found: dict[int, list] = {}
        for r, a, b in islands(w, least, least // 2).tolist():
            numbers: dict[bytes, int] = {}
            seq = [numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
            base = a - int(w.first[r])
            found.setdefault(r, []).extend((start + base, length, period) for start, length, period in runs_of(seq, least))
        for r in range(j - i):
            yield raw[offs[r]:offs[r + 1]].split(), found.get(r, [])  # bytes: ASCII white space only


def collapse(text_words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return text_words
    cover = np.zeros(len(text_words) + 1, np.int64)
    start, length, period = np.array(found, np.int64).T
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return [x for x, ok in zip(text_words, (np.cumsum(cover[:-1]) == 0).tolist(), strict=True) if ok]


def _find(least: int):
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            n, found, kept = [], [], []
            for text_words, its in _runs_of_rows(batch.column("t"), least):
                n.append(len(text_words))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in its])
                kept.append(b" ".join(collapse(text_words, its)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())],
                                             ["id", "n_words", "runs", "kept"])
    return run


def find_runs(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, kept): the runs of every row as (start, length, period), and the words left when each run
    is collapsed to its first period, joined by one space, in UTF-8."""
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    out = rows.mapInArrow(_find(least), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, "
                          "runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
