"""N-gram Jaccard join by parity sketches.

A text's set is its distinct word n-grams, each a 64-bit hash. Sets link when 100 * intersection >= percent * union, so
the symmetric difference of a linked pair is at most r = a * (100 - percent) / percent, a being the smaller size.

Sizes fall in bands of ratio BAND; a pair belongs to its smaller set's band, and a set takes part in its own band and, if
it can be a pair's larger set there, in the band below. In a band the hash range is cut into r + 1 blocks, and the XOR
of a set's hashes in each block is its sketch. An element moves one block only, so two linked sets agree in at least one
block (pigeonhole): sets are joined on equal (band, block, XOR). Small sets can have nothing but empty blocks in common,
so sets with few blocks and an empty one repeat this under other cuts. A second sketch, one parity bit for each of 8r
hash classes (1,024 at least), follows: its Hamming distance never exceeds the symmetric difference, so a candidate pair beyond r goes
without its texts being read. What is left is verified on the texts.

Sets with equal content are one node from the start. Of all the nodes that it shares a key with, each is paired with the smallest
first; the pairs that verify give components. Keys that still hold several components pair each node with HUBS others, those whose own
hashes are smallest, so that keys with the same holders draw the same pairs; and what components remain in a key after that pair across, all
of them, in tiles of at most TILE nodes. Only components are computed: pairs inside one are not verified, and neither linked pairs
nor numbers of links come out. So copies cost no quadratic work and no link between different components is
lost.

Keys travel packed and binned by hash (packed.py); texts are read again only for nodes with a pair left, found by a
bounded Bloom bitmap. Null and empty texts have empty sets, linked with nothing; a text with fewer words than n has its whole
sequence as one element. Repeated rows link like any equal texts; null ids count as larger than any; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.bitfilter import flag, key_bits, size_bits
from shelfspark.llm.common import join_groups, packed as packed_row, text_or_empty, tidy, written
from shelfspark.llm.components import components
from shelfspark.llm.packed import PACKED, Packer, bin_count, by_bin, runs, text_bytes
from shelfspark.llm.text_hash import grams, mix, row_chunks, words

BAND, CUTS, FEW_BLOCKS, TILE, HUBS, LEAST_BITS = 1.5, 6, 24, 2048, 2, 1024
KEY = np.dtype([("key", "<u8"), ("node", "<i8")])


class Bands:
    """Sizes and block counts; all integers, so every task agrees."""

    def __init__(self, percent: int, ratio: float = BAND):
        self.percent, starts = percent, [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
        self.starts = np.array(starts, np.int64)

    def of(self, n: int) -> range:
        """The bands that a set of ``n`` elements takes part in."""
        least = -(-n * self.percent // 100)
        return range(int(np.searchsorted(self.starts, max(1, least), "right")) - 1, int(np.searchsorted(self.starts, n, "right")))

    def most(self, band: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set is in the band."""
        return int((self.starts[band + 1] - 1) * (100 - self.percent) // self.percent)

    def bits(self, band: int) -> int:
        return max(LEAST_BITS, -(-8 * self.most(band) // 64) * 64)


def sets_of(column: pa.Array, n: int):
    """The sorted distinct gram hashes of each text of an Arrow column."""
    for i, j, data, offs in row_chunks(column):
        w = words(data, offs, lower=True)
        for r in range(j - i):
            yield np.unique(grams(w.hash[w.first[r]:w.first[r + 1]], n))


def node_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    total = np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, keepdims=True) + np.uint64(len(s))
    return int(mix(total).view(np.int64)[0])


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: (band, cut, block, XOR) mixed to 64 bits."""
    keys = []
    for band in bands.of(len(s)):
        blocks = bands.most(band) + 1
        for cut in range(CUTS if blocks <= FEW_BLOCKS else 1):
            h = s if cut == 0 else np.sort(mix(s + np.uint64(cut)))
            at, n = runs(_block(h, blocks))
            xor = np.bitwise_xor.reduceat(h, at) if len(at) else h
            place = _block(h[at], blocks)
            keys.append(mix(xor ^ mix(place + np.uint64((band << 32) + (cut << 24)))))
            if len(at) == blocks:
                break
    return np.concatenate(keys)


def parity(s: np.ndarray, bands: Bands) -> dict[int, bytes]:
    """The parity bits of a set for each of its bands."""
    out = {}
    for band in bands.of(len(s)):
        at = (mix(s) % np.uint64(bands.bits(band))).astype(np.int64)
        out[band] = np.packbits(np.bincount(at, minlength=bands.bits(band)) & 1).tobytes()
    return out


def _signatures(n: int, bands: Bands):
    kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())]))

    def run(batches):
        for b in batches:
            size, node, sketch = [], [], []
            for s in sets_of(b.column("t"), n):
                size.append(len(s))
                node.append(node_of(s) if len(s) else None)
                sketch.append([{"band": k, "bits": v} for k, v in parity(s, bands).items()] if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                                              pa.array(sketch, kind)], ["id", "rk", "node", "n", "sketch"])
    return run


def _keys(n: int, bands: Bands, bins: int):
    def run(batches):
        packer = Packer(bins, distinct=True)
        for b in batches:
            for s in sets_of(b.column("t"), n):
                if len(s):
                    key = block_keys(s, bands)
                    value = np.empty(len(key), KEY)
                    value["key"], value["node"] = key, node_of(s)
                    yield from packer.add(key, value)
        yield from packer.flush()
    return run


def _shared(values: np.ndarray) -> dict:
    """The holders of every key that two or more nodes hold, with the smallest of them."""
    values = np.unique(values)
    at, n = runs(values["key"])
    many = np.repeat(n > 1, n)
    hub = np.repeat(values["node"][at], n) if len(at) else values["node"]
    values = values[many]
    return {"key": values["key"].view(np.int64), "node": values["node"], "hub": hub[many]}


def may_link(bands: Bands, n: int, m: int, a: dict[int, bytes], b: dict[int, bytes]) -> bool:
    """Sizes and parity sketches of two sets allow a link."""
    lo, hi = min(n, m), max(n, m)
    if 100 * lo < bands.percent * hi:
        return False
    band = bands.of(lo)[-1]
    x, y = np.frombuffer(a[band], np.uint64), np.frombuffer(b[band], np.uint64)
    return int(np.bitwise_count(x ^ y).sum()) <= (lo + hi) * (100 - bands.percent) // (100 + bands.percent)


def _sketches(x) -> dict[int, bytes]:
    return {s["band"]: s["bits"] for s in x}


def _filter_pairs(bands: Bands):
    def run(batches):
        for b in batches:
            ok = [may_link(bands, n, m, _sketches(x), _sketches(y)) for n, m, x, y in
                  zip(*(b.column(c).to_pylist() for c in ("un", "vn", "us", "vs")), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return run


def _across(bands: Bands):
    """Pairs of different components whose sketches allow a link, in each tile of a bin of keys."""
    def tile(left, right):
        for band in {s["band"] for r in right for s in r["sketch"]}:
            mine = [(r, _sketches(r["sketch"])) for r in right]
            mine = [(r, np.frombuffer(x[band], np.uint64)) for r, x in mine if band in x]
            node, comp, n = (np.array([r[c] for r, _ in mine]) for c in ("node", "comp", "n"))
            bits = np.stack([x for _, x in mine])
            for r in left:
                own = _sketches(r["sketch"]).get(band)
                if own is None:
                    continue
                lo, hi = np.minimum(n, r["n"]), np.maximum(n, r["n"])
                ok = (comp != r["comp"]) & (100 * lo >= bands.percent * hi)
                if ok.any():
                    distance = np.bitwise_count(bits[ok] ^ np.frombuffer(own, np.uint64)).sum(axis=1)
                    near = distance <= ((lo + hi)[ok] * (100 - bands.percent)) // (100 + bands.percent)
                    for x in node[ok][near]:
                        yield min(r["node"], int(x)), max(r["node"], int(x))

    def run(table: pa.Table) -> pa.Table:
        tiles = {}
        for r in table.select(["key", "i", "j", "side", "node", "comp", "n", "sketch"]).to_pylist():
            tiles.setdefault((r["key"], r["i"], r["j"]), ([], []))[r["side"] == 2].append(r)
        found = sorted({pair for (_, i, j), (left, right) in tiles.items() for pair in tile(left, right if i != j else left)})
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})
    return run


def _verify(n: int, percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for s, t in zip(sets_of(b.column("ut"), n), sets_of(b.column("vt"), n), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return run


class NgramJoin:
    """The join over one table. ``rows``: (id, rk, node, n) of every row; ``comps``: (node, comp) of every linked node."""

    def __init__(self, df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.bands, self.text = n, Bands(percent), None
        t = text_or_empty(text_col)
        # rk names a row by its content, so that a row is found again without an id of its own
        self.df = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), t).alias("rk"), t.alias("t"))
        kind = self.df.schema["id"].dataType.simpleString()
        self.rows = written(self.df.mapInArrow(tidy(_signatures(n, self.bands)), f"id {kind}, rk long, node long, n long, "
                                               "sketch array<struct<band:int,bits:binary>>"), "sets")
        self.comps = self._components()

    def _components(self) -> DataFrame:
        bins = bin_count(text_bytes(self.df, "t"))
        keys = self.df.select("t").mapInArrow(tidy(_keys(self.n, self.bands, bins)), PACKED)
        shared = written(by_bin(keys, KEY, _shared, "key long, node long, hub long"), "shared-keys")
        star = shared.where("hub <> node").groupBy(F.col("node").alias("v")).agg(F.min("hub").alias("u")).select("u", "v")
        nodes = written(shared.select("node").distinct().join(
            self.rows.where("node is not null").groupBy("node").agg(F.min("rk").alias("rk"), F.min("n").alias("n"), F.min("sketch").alias("sketch")),
            "node"), "nodes")
        star = written(self._sketched(star, nodes), "star")
        links = written(self._verified(star, nodes), "links")
        comps, tried = components(links), star
        for exact in (False, True):
            held = self._mixed(shared, comps, nodes)
            found = self._tiled(held) if exact else self._sketched(self._hubs(held), nodes)
            more = written(found.join(tried, ["u", "v"], "left_anti"), "across")
            new = written(self._verified(more, nodes), "links")
            links, tried = links.unionByName(new), tried.unionByName(more)
            comps = self._merged(comps, new)
        return comps

    def _merged(self, comps: DataFrame, new: DataFrame) -> DataFrame:
        """The components after more links: only the graph of components is searched again."""
        if not new.take(1):
            return comps
        name = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(x + "c"))
        edges = (new.join(name("u"), "u", "left").join(name("v"), "v", "left")
                 .select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")).where("u <> v"))
        onto = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("onto"))
        every = comps.unionByName(onto.select(F.col("comp").alias("node"), "comp")).distinct()
        return written(every.join(onto, "comp", "left").select("node", F.coalesce("onto", "comp").alias("comp"))
                       .groupBy("node").agg(F.min("comp").alias("comp")), "components")

    def _mixed(self, shared: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
        """The holders, with component, size and sketch, of the keys that still hold several components."""
        labelled = shared.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = (labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m"))
                 .where("a <> b").select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
        return written(labelled.join(mixed, "key").join(nodes.select("node", "n", "sketch"), "node"), "mixed")

    def _hubs(self, held: DataFrame) -> DataFrame:
        """Every holder of a key with HUBS others drawn by hash, where components differ. What links in a family of near
        copies mostly shows up here, so that few pairs are left for the exact round."""
        drawn = held.groupBy("key").agg(F.array(*[
            F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"),
                           F.col("n").alias("hub_n")))
            for k in range(HUBS)]).alias("hubs")).select("key", F.explode(F.array_distinct("hubs")).alias("x")).select("key", "x.hub", "x.hub_comp", "x.hub_n")
        sizes = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * self.bands.percent
        return (held.select("key", "node", "comp", "n").join(drawn, "key").where((F.col("comp") != F.col("hub_comp")) & sizes)
                .select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct())

    def _tiled(self, held: DataFrame) -> DataFrame:
        """All pairs of different components that share a key and whose sketches allow a link."""
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        # a node meets every tile: as the left side with the tiles after its own, as the right side with those before
        met = held.withColumn("own", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        met = met.select("node", "comp", "n", "sketch", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
        met = written(met, "across-tiles")
        bins = max(1, met.count() // TILE)  # a bin holds some tiles, a tile at most two times TILE nodes or so
        return (met.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins))).groupBy("bin")
                .applyInArrow(_across(self.bands), "u long, v long").distinct())

    def _sketched(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(x + "n"), F.col("sketch").alias(x + "s"))
        return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(tidy(_filter_pairs(self.bands)), "u long, v long")

    def _verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that link, by their texts. Rows outside the bitmap of the rows wanted never shuffle."""
        wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = written(wanted.join(nodes.select("node", "rk"), "node"), "wanted")
        bits = size_bits(wanted.count())
        texts = flag(self.df.select("rk", "t"), F.col("rk"), [(key_bits(wanted, F.col("rk"), bits), bits)], "hit").where("hit")
        # repeated rows have one rk: one text of each is enough
        texts = texts.select("rk", "t").join(wanted, "rk").groupBy("node").agg(F.first("t").alias("t"))
        side = lambda x: texts.select(F.col("node").alias(x), F.col("t").alias(x + "t"))
        return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "ut", "vt").mapInArrow(
            tidy(_verify(self.n, self.bands.percent)), "u long, v long")

    def report(self) -> DataFrame:
        """(id, rk, n, first): ``first`` is the smallest (id, rk) that links reach; nulls last."""
        order = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk")
        some = self.rows.where("node is not null")
        classes = written(some.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")), "classes")
        joined = classes.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = joined.groupBy("comp").agg(F.min("first").alias("first"))
        named = written(joined.drop("first").join(least, "comp").select("node", "first", "size"), "classes")
        found = join_groups(some.select("id", "rk", "n", "node"), named, "node", "size", some.count())
        alone = self.rows.where("node is null").select("id", "rk", "n", order.alias("first"))
        return found.select("id", "rk", "n", "first").unionByName(alone)


def link_documents(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``df``."""
    out = NgramJoin(df, n, percent, id_col, text_col).report()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest id (then content hash), once."""
    report = NgramJoin(df, n, percent, id_col, text_col).report()
    told = report.groupBy("rk").agg(F.max(F.col("first.rk") != F.col("rk")).alias("goes"), (F.count(F.lit(1)) > 1).alias("twins"),
                                    F.max("n").alias("n"))
    told = written(told.where("goes or (twins and n > 0)").select("rk", "goes"), "gone")
    bits = size_bits(told.count())
    cols = df.columns
    keyed = df.select(packed_row(df), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("rk"))
    flagged = flag(keyed, F.col("rk"), [(key_bits(told, F.col("rk"), bits), bits)], "hit")
    hits = flagged.where("hit").join(told, "rk", "left")
    kept = (flagged.where("not hit").select("row").unionByName(hits.where("goes is null").select("row"))
            .unionByName(hits.where("not goes").groupBy("rk").agg(F.first("row").alias("row")).select("row")))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
