"""Language-model scoring with a probabilistic suffix tree.

A text is its lower-cased (A-Z) words, joined by single spaces, and one end; the tree predicts it
byte by byte. Contexts are the up to `depth` bytes before. One counting pass over all training
texts gives every (depth + 1)-gram; shorter contexts come by summing. A context is kept if it occurs
`least` times or more and what it says differs from what its suffix says by a gain in log-likelihood
of `gain` nats or more; suffixes of kept contexts stay too. So the tree grows with the corpus.
Next-byte distributions are smoothed towards those of the suffix, the empty context's by one half. A
byte is scored in the state of the longest kept suffix of what precedes it.

The kept tree is a stored table. It is cut by the last two bytes of contexts into parts of at most
`most` contexts (or one pair of bytes); each part, with the contexts of under two bytes, is
broadcast in a pass of its own over the texts, which scores the bytes whose context it holds.

The unigram base needs the count of every training word: all are counted by shuffle; the `top` most
frequent (a fixed number) are looked up in memory and the others by join.

Null and blank texts are one end token. Repeated rows and null ids give a row each (null ids are
held out). Without training texts every count is 0. Other columns are dropped.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import KEPT, importable, pieces, stored, utf8

END = 10  # the byte after a text, and before it
#: Distinct words or grams that a task holds before it hands its counts on.
HELD = 2_000_000
#: Most entries of the table of the first steps down the tree, which fits in a cache.
NEAR = 1 << 20


def normal(at: np.ndarray, data: np.ndarray) -> list[list[bytes]]:
    return [data[a:b].tobytes().lower().split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def stream(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, `depth` end marks before each; where each text's own bytes begin; and which bytes are its own."""
    pad = bytes([END]) * depth
    parts = [b" ".join(w) for w in words]
    b = np.frombuffer(b"".join([pad + p + b"\n" for p in parts]), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    begin = np.cumsum(size + depth) - size
    own = np.ones(len(b), bool)
    for d in range(1, depth + 1):
        own[begin - d] = False
    return b, begin, own


def windows(b: np.ndarray, depth: int) -> np.ndarray:
    """Each byte, in the lowest place, with the `depth` before it."""
    held = np.concatenate([np.zeros(7, np.uint8), b])
    return np.ndarray(len(b), ">u8", held, strides=(1,)).astype(np.int64) & ((1 << (8 * (depth + 1))) - 1)


def summed(keys: np.ndarray, counts: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of ascending keys as one: a stable sort only merges them."""
    if not len(keys):
        return k, n
    both = np.concatenate([keys, k])
    order = both.argsort(kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=both[0] - 1))
    return both[first], np.add.reduceat(np.concatenate([counts, n])[order], first)


def gram_counts(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(gram, n): every depth + 1 bytes, the last in the lowest place, summed over docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in pieces(batches, text_col):
            b, _, own = stream(normal(*utf8(batch.column(0))), depth)
            keys, counts = summed(keys, counts, *np.unique(windows(b, depth)[own], return_counts=True))
            if len(keys) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over docs; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in pieces(batches, text_col):
            for words in normal(*utf8(batch.column(0))):
                counts.update(words)
                counts[b""] += 1
            if len(counts) > HELD // 8:
                yield out()
                counts.clear()
        yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Kept contexts (depth, bytes with the latest in the lowest place), and the counts of what follows each."""

    rows: DataFrame  # depth, context, next, n
    depth: int
    strength: float


@dataclass
class Part:
    """Contexts whose last two bytes are within the cells from low to high, and all of under two bytes."""

    name: str
    low: int
    high: int
    depth: int
    strength: float
    rows: tuple[np.ndarray, ...]  # depth, context, next, n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of each byte, child of a node by an older symbol or -1, log10 probability of a symbol after a node)."""
        seen = np.unique(self.rows[2][self.rows[0] == 0])
        symbol = np.full(256, len(seen), np.int32)  # the last stands for all bytes not seen
        symbol[seen] = np.arange(len(seen))
        size = len(seen) + 1
        unseen = 257 - size
        where = [np.unique(self.rows[1][self.rows[0] == d]) for d in range(self.depth + 1)]
        first = np.cumsum([0, 1, *[len(w) for w in where[1:]]])
        child = np.full((first[-1], size), -1, np.int32)
        p = np.zeros((first[-1], size), np.float32)
        root = np.full(size, 0.5)
        root[-1] = 0.5 * max(unseen, 1)
        at_root = self.rows[0] == 0
        np.add.at(root, symbol[self.rows[2][at_root]], self.rows[3][at_root])
        p[0] = root / root.sum()
        for d in range(1, self.depth + 1):
            nodes = where[d]
            if not len(nodes):
                continue
            up = nodes & ((1 << (8 * (d - 1))) - 1)
            parent = np.zeros(len(nodes), np.int64) if d == 1 else first[d - 1] + np.searchsorted(where[d - 1], up)
            own = first[d] + np.arange(len(nodes))
            child[parent, symbol[nodes >> (8 * (d - 1))]] = own
            _, context, nxt, n = (x[self.rows[0] == d] for x in self.rows)
            at = np.searchsorted(nodes, context)
            total = np.bincount(at, n, len(nodes)) + self.strength
            p[own] = p[parent] * (self.strength / total)[:, None].astype(np.float32)
            np.add.at(p, (own[at], symbol[nxt]), (n / total[at]).astype(np.float32))
        p[:, -1] /= max(unseen, 1)  # one of the bytes not seen
        return symbol, child, np.log10(p, out=p)


def first_steps(child: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """(the node that the latest symbols lead to, by their number; how many they are): ~node where the way ended before the last of them."""
    size, taken = child.shape[1], 0
    node = np.zeros(1, np.int32)
    while taken < depth and len(node) * size <= NEAR:
        nxt = np.where(node[:, None] >= 0, child[np.maximum(node, 0)], -1)
        ended = np.where(node >= 0, ~node, node)
        node, taken = np.where(nxt >= 0, nxt, ended[:, None]).T.ravel(), taken + 1
    return node, taken


#: Tables of the last part that a worker met: its tasks share them.
TABLES: dict[str, tuple] = {}
KEPT.append(TABLES)


def tables_of(part: Part) -> tuple:
    if part.name not in TABLES:
        TABLES.clear()
        symbol, child, logp = part.tables()
        TABLES[part.name] = (symbol, child, logp, *first_steps(child, part.depth))
    return TABLES[part.name]


def fit(docs: DataFrame, text_col: str = "text", depth: int = 6, least: int = 512, gain: float = 15.0, strength: float = 4.0) -> Tree:
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6: a context and the byte after it lie in 63 bits")
    level = stored(gram_counts(docs, text_col, depth).select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("next"), "n"), "grams")
    sized = {}
    for d in range(depth, -1, -1):
        sums = level.groupBy("context").agg(F.sum("n").alias("all"))
        sized[d] = stored(level.join(sums.where(F.col("all") >= least) if d else sums, "context"), f"level{d}")
        if d:
            level = level.withColumn("context", F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1)).groupBy("context", "next").agg(F.sum("n").alias("n"))
            level = stored(level, f"grams{d - 1}")
    keep = None
    kept = [sized[0].select(F.lit(0).alias("depth"), "context", "next", "n")]
    for d in range(depth, 0, -1):
        mask = (1 << (8 * (d - 1))) - 1
        up = sized[d - 1].select(F.col("context").alias("up"), "next", F.col("n").alias("un"), F.col("all").alias("uall"))
        told = sized[d].withColumn("up", F.col("context").bitwiseAND(mask)).join(up, ["up", "next"])
        tested = told.groupBy("context").agg(F.sum(F.col("n") * F.log(F.col("n") * F.col("uall") / (F.col("all") * F.col("un")))).alias("g")).where(F.col("g") >= gain).select("context")
        keep = stored((tested if keep is None else tested.unionByName(keep)).distinct(), f"keep{d}")
        kept.append(sized[d].join(keep, "context", "left_semi").select(F.lit(d).alias("depth"), "context", "next", "n"))
        keep = keep.select(F.col("context").bitwiseAND(mask).alias("context")).distinct()
    all_kept = kept[0]
    for x in kept[1:]:
        all_kept = all_kept.unionByName(x)
    return Tree(stored(all_kept, "tree"), depth, strength)


def parts_of(tree: Tree, most: int) -> Iterator[Part]:
    """The tree in parts of `most` contexts, each collected when it is asked for."""
    cell = F.col("context").bitwiseAND(0xFFFF)
    sizes = tree.rows.where("depth >= 2").select("depth", "context").distinct().groupBy(cell.alias("cell")).count().orderBy("cell").collect()  # 65536 rows at most
    cuts, held = [0], 0
    for r in sizes:
        if held and held + r["count"] > most:
            cuts.append(r.cell)
            held = 0
        held += r["count"]
    for low, high in zip(cuts, [*cuts[1:], 1 << 16]):
        t = tree.rows.where((F.col("depth") < 2) | ((cell >= low) & (cell < high))).toArrow()
        yield Part(uuid.uuid4().hex, low, high - 1, tree.depth, tree.strength, tuple(t.column(c).to_numpy().astype(k) for c, k in (("depth", np.int8), ("context", np.int64), ("next", np.uint8), ("n", np.int64))))


def score_bytes(words: list[list[bytes]], part: Part) -> np.ndarray:
    """Log10 probability of those bytes of each text whose context is the part's."""
    symbol, child, logp, near, taken = tables_of(part)
    size = child.shape[1]
    child, logp = child.ravel(), logp.ravel()
    b, begin, own = stream(words, max(part.depth, 2))
    s = symbol[b]
    code = np.zeros(len(s), np.int32)  # the latest symbol before a byte in the lowest place
    for d in range(1, taken + 1):
        code[d:] += s[:-d] * np.int32(size ** (d - 1))
    at = np.flatnonzero(own)
    if part.low > 0 or part.high < 0xFFFF:
        cell = b[at - 1].astype(np.int32) | (b[at - 2].astype(np.int32) << 8)
        at = at[(cell >= part.low) & (cell <= part.high)]
    known = near.take(code.take(at))  # where the first steps led; below zero if no more are left
    node = np.where(known < 0, ~known, known).astype(np.int64)
    live = np.flatnonzero(known >= 0)
    here, now = at.take(live), node.take(live)
    for d in range(taken + 1, part.depth + 1):
        nxt = child.take(now * size + s.take(here - d))
        on = np.flatnonzero(nxt >= 0)
        live, here, now = live.take(on), here.take(on), nxt.take(on).astype(np.int64)
        node[live] = now
    sums = np.concatenate([[0.0], np.cumsum(logp.take(node * size + s.take(at)), dtype=np.float64)])
    cuts = np.searchsorted(at, [*begin.tolist(), len(b)])
    return np.diff(sums[cuts])


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", top: int = 1 << 16, most: int = 150_000, **settings) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score); `train` marks the rows to learn from."""
    importable(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), train.alias("train"))
    learned = texts.where("train")
    tree = fit(learned, "t", **settings)
    counts = stored(word_counts(learned, "t"), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = counts.orderBy(F.desc("n"), "word").limit(top).toArrow()
    words = docs.sparkSession.sparkContext.broadcast(dict(zip(hot.column("word").to_pylist(), np.log10(hot.column("n").to_numpy() + 0.5).tolist())))
    kind = dict(docs.dtypes)[id_col]

    def base(batches: Iterator[pa.RecordBatch], part) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in pieces(batches, "t", 1 << 18):
            split = normal(*utf8(batch.column("t")))
            by_tree = score_bytes(split, part.value)
            n, n_hot, sums, rest = [], [], [], []
            for w in split:
                w.append(b"")
                got = list(map(known.get, w))
                tail: list[bytes] = []
                if None in got:
                    tail = [x for x, g in zip(w, got) if g is None]
                    got = [g for g in got if g is not None]
                n.append(len(w))
                n_hot.append(len(got))
                sums.append(math.fsum(got))
                rest.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(sums, pa.float64()), pa.array(by_tree, pa.float64()), pa.array(rest, pa.list_(pa.binary()))], names)

    def again(batches: Iterator[pa.RecordBatch], part) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 1 << 18):
            more = score_bytes(normal(*utf8(batch.column("t"))), part.value)
            yield batch.set_column(names.index("score"), "score", pa.array(batch.column("score").to_numpy() + more))

    schema = f"id {kind}, t string, n long, hot long, sum double, score double, rest array<binary>"
    names = [x.split()[0] for x in schema.split(", ")]
    found = None
    for part in parts_of(tree, most):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        run = base if found is None else again
        before = texts.select("id", "t") if found is None else stored(found, "scored")
        found = before.mapInArrow(lambda x, run=run, shared=shared: run(x, shared), schema)
    parts = stored(found.drop("t").withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_sum"))
    out = parts.drop("rest").join(tail, "row", "left")
    total_score = F.col("sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n") * math.log10(total + 0.5 * (kinds + 1))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("hot") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), total_score.alias("base_score"), "score")
