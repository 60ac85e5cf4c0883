"""Packed shuffles: values are binned by hash and travel as binary arrays, a row for each bin and flush instead of one
for each value. A bin is sized to be handled in memory: BIN_BYTES of text stand behind each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import give_back

BIN_BYTES, FLUSH_BYTES = 16 << 20, 16 << 20


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def bin_count(n_bytes: int, least: int = 16) -> int:
    return max(least, -(-n_bytes // BIN_BYTES))


class Packer:
    """Gathers structured arrays with their bins; gives record batches (bin, payload) when there is enough."""

    def __init__(self, bins: int, distinct: bool = False):
        self.bins, self.parts, self.size, self.distinct = bins, [], 0, distinct

    def add(self, key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``key``: 64-bit hashes that choose the bins of ``values``."""
        if len(values):
            self.parts.append(((key >> np.uint64(24)) % np.uint64(self.bins), values))
            self.size += values.nbytes
            if self.size >= FLUSH_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bins = np.concatenate([b for b, _ in self.parts])
        values = np.concatenate([v for _, v in self.parts])
        self.parts, self.size = [], 0
        if self.distinct:  # equal values, as copies give them, travel once a flush
            values, at = np.unique(values, return_index=True)
            bins = bins[at]
        order = np.argsort(bins, kind="stable")
        bins, values = bins[order], values[order]
        cut = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        ends = np.r_[cut[1:], len(bins)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bins[cut].astype(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
            ["bin", "payload"])


PACKED = "bin long, payload binary"


def by_bin(packed: DataFrame, dtype: np.dtype, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(values) -> dict of arrays`` to all the values of each bin."""
    def run(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table.column("payload").to_pylist()), dtype)
        out = pa.table(fn(values))
        del values
        give_back()
        return out
    return packed.groupBy("bin").applyInArrow(run, schema)


def runs(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    return start, np.diff(np.r_[start, len(sorted_key)])
