"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into `distance // 2 + 1` segments, so that of two fingerprints within
`distance` bits one segment differs by at most one bit. Every segment is indexed once for each of
its bits with that bit as a wildcard; fingerprints that meet in a variant are compared in full.

Equal fingerprints are one node. A variant that many nodes share is dealt out in blocks, each pair
of blocks to a task of its own, so no task holds a whole hot variant; a task returns at most one
link per node (a forest of its links), never all pairs. Components come from repeated star
contraction, with each round's links written to the shared folder.

Nulls and texts without words have fingerprint zero and link like others; documents of fewer words
than a shingle are one shingle; repeated rows and ids get a row each; a null id gets a row, and
counts for a component's smallest id only where all ids are null; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import alone, importable, pieces, stored, utf8

BITS = 64
#: Members of a variant that are compared in one block.
BLOCK = 2048
#: Rows that a task compares at once.
CHUNK = 200_000
#: Bands of least hashes, and the hashes in each: 0.997 of the pairs at a similarity of 0.8 share a band.
BANDS, ROWS = 8, 3
MASKS, FACTORS = np.random.default_rng(42).integers(1, (1 << 64) - 1, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n = len(h)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_words(words: list[bytes], width: int) -> int:
    """The fingerprint of the shingles."""
    return majority(shingle_hashes(words, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): signed 64-bit fingerprints of the lower-cased (A-Z) words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in pieces(batches, "t"):
            at, data = utf8(batch.column("t"))
            fps = [fingerprint_words(data[a:b].tobytes().lower().split(), width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def variants(distance: int) -> list[tuple[int, int]]:
    """(mask of the kept bits, mask of the wildcard) of each variant."""
    parts = distance // 2 + 1
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(((1 << b) - (1 << a)) & ~(1 << i), 1 << i) for a, b in zip(cuts, cuts[1:]) for i in range(a, b)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches over links between places a and b."""
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return nodes[root]


def compare(key: np.ndarray, fp: np.ndarray, block: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) among rows of equal keys; rows come in order of their keys. Of a pair of blocks, only rows of unlike blocks meet."""
    nodes, place = np.unique(fp, return_inverse=True)
    found_a, found_b = [], []
    live, step = np.arange(len(key)), 1
    while True:
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        near = np.bitwise_count(fp[live] ^ fp[live + step]) <= distance
        near &= (block[live] != block[live + step]) | (block[live] < 0)
        found_a.append(place[live[near]])
        found_b.append(place[live[near] + step])
        if step % 256 == 0:  # keep what is held in proportion to the rows
            root = forest(nodes, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [np.arange(len(nodes))], [np.searchsorted(nodes, root)]
        step += 1
    if not found_a:
        return nodes[:0], nodes[:0]
    root = forest(nodes, np.concatenate(found_a), np.concatenate(found_b))
    linked = root != nodes
    return nodes[linked], root[linked]


def links(nodes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all fp of `nodes` (distinct) within `distance` bits, over others where need be."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(keep))).alias("kept")) for i, (keep, _) in enumerate(variants(distance))])).alias("k")
    rows = nodes.select("fp", each).select("fp", F.xxhash64("k.v", "k.kept").alias("key"))
    # hot variants only, so this is small beside the rows; Spark picks the join by its true size
    hot = stored(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n")), "hot")
    many = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j).cast("long") * F.col("n") + F.greatest(own, j)))
    # within its own pair (b, b) a block's rows all meet; in (b, c) only rows of b with rows of c
    n = F.col("n")
    dealt = many.select("fp", "key", n, own.alias("own"), F.explode(pairs).alias("pair")).select(
        "fp", F.xxhash64("key", "pair").alias("key"), F.when(n.isNull() | (F.floor(F.col("pair") / n) == F.pmod(F.col("pair"), n)), -1).otherwise(F.col("own")).alias("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        def out(t: pa.Table) -> pa.RecordBatch:
            key, fp, side = (t.column(x).to_numpy() for x in ("key", "fp", "block"))
            a, b = compare(key, fp.view(np.uint64), side, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if whole:
                    yield out(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    met = dealt.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of all linked nodes by large-star and small-star rounds (Kiveris and others, 2014), until nothing moves; an error if that takes over `rounds` of them."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    for _ in range(rounds):
        # least neighbours are stored apart from the joins, so that Spark can split the joins at nodes with many links
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "low")  # other nodes keep their links
        large = edges.join(low.toDF("of", "m"), F.col("b") == F.col("of"), "left").select("a", F.coalesce("m", "b").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == last and now[0] == now[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id): components of documents over fingerprints that differ by at most `distance` bits."""
    own = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    joined = components(links(nodes.select("fp"), distance))
    ends = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ends = stored(ends, "ends")
    least = stored(ends.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = stored(ends.join(least, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key of each band: sets of similarity s have one of them in common with a probability of 1 - (1 - s ** ROWS) ** BANDS."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.min([((shingles[i : i + (1 << 14), None] ^ MASKS) * FACTORS).min(0) for i in range(0, len(shingles), 1 << 14)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shingled(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, content, fp, node, bands, shingles): node tells different sets of shingles apart by a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in pieces(batches, "t", 1 << 20):
            at, data = utf8(batch.column("t"))
            fps, node, bands, sets = [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                h = shingle_hashes(data[a:b].tobytes().lower().split(), width)
                own = np.unique(h)
                fps.append(majority(h))
                sets.append(own.tobytes())
                node.append(xxhash.xxh64_intdigest(sets[-1], 42))
                bands.append(band_keys(own))
            longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, node))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "content", "fp", "node", "bands", "shingles"])

    importable(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.octet_length(text)).alias("content"), text.alias("t"))
    return rows.mapInArrow(run, f"id {kind}, content long, fp long, node long, bands array<long>, shingles binary")


def alike(sets: list[np.ndarray], block: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs of similarity `least` or more that join all such; of a pair of blocks, only sets of unlike blocks meet."""
    root = list(range(len(sets)))
    out = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if root[i] == root[j] or (block[i] == block[j] >= 0) or min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= least * (len(x) + len(y) - both) - 1e-9:
                out.append((i, j))
                old, new = root[i], root[j]
                root[: i + 1] = [new if r == old else r for r in root[: i + 1]]
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, distance: int = 4, block: int = 1024) -> DataFrame:
    """(id, content, root): components of rows over sets of shingles whose Jaccard similarity is `least` or more.

    Sets meet where they share a band of minima, or where their fingerprints are in one component of
    near_duplicates; groups of the same members meet once. Each link is checked on whole sets.
    """
    own = stored(shingled(docs, id_col, text_col, width).drop("shingles"), "nodes")
    fps = own.select("fp").distinct()
    joined = components(links(fps, distance)).withColumnRenamed("node", "fp")
    by_fp = own.select("node", "fp").join(joined, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))
    keys = stored(own.select("node", F.explode("bands").alias("key")).unionByName(by_fp).distinct(), "keys")
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("low")).where("size > 1")
    groups = groups.groupBy("size", "members", "low").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / block).cast("int").alias("n"))
    met = stored(keys.join(groups, "key"), "met")
    # shingles take more room than texts: those of texts that meet others are made anew, once per set
    chosen = own.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("content").alias("_chosen")).select("_chosen")
    text = F.coalesce(F.col(text_col), F.lit(""))
    needed = docs.select(id_col, text_col).join(stored(chosen, "chosen"), F.xxhash64(text, F.octet_length(text)) == F.col("_chosen"), "left_semi")
    sets = shingled(needed, id_col, text_col, width).select("node", "shingles").dropDuplicates(["node"])
    n, place = F.col("n"), F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(place, j).cast("long") * n + F.greatest(place, j))
    dealt = met.join(sets, "node").select("node", "shingles", "key", "n", place.alias("own"), F.explode(pairs).alias("pair"))
    inner = F.floor(F.col("pair") / n) == F.pmod(F.col("pair"), n)
    dealt = dealt.select("node", F.xxhash64("key", "pair").alias("key"), F.when(inner, -1).otherwise(F.col("own")).alias("block"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held: list[tuple[int, int, bytes]] = []
        last = None

        def out() -> pa.RecordBatch:
            found = alike([np.frombuffer(x[2], np.uint64) for x in held], [x[1] for x in held], least)
            return pa.RecordBatch.from_arrays([pa.array([held[p[i]][0] for p in found], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            for node, key, side, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last:
                    if len(held) > 1:
                        yield out()
                    held.clear()
                    last = key
                held.append((node, side, raw))
        if len(held) > 1:
            yield out()

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()
    ends = own.select("id", "content", "node").join(components(found), "node", "left")
    return ends.select(F.col("id").alias(id_col), "content", F.coalesce("root", "node").alias("root"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
