"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed 3- and 4-byte subwords (A-Z lower-cased, a space
put before and after), and a linear softmax over that mean gives the language. Both are trained by
stochastic gradient descent in numpy on a bounded sample, `per_language` texts of each label, whose
subword counts (never texts) come to the driver. A part of the sample is held back to calibrate the
softmax's temperature and the score under which a prediction is rejected: the most that loses no
right prediction there, and `most_cutoff` at most.

Texts that are null or have no letter are `und`, with score 0, and rejected. Repeated rows and null
ids give a row each. Without labelled texts all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import alone, importable, pieces, private, stored, utf8

BUCKETS = 1 << 16
#: Bytes of text looked at together: their subwords and logits take about 60 times as much.
PIECE = 1 << 18
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (BUCKETS + 1, labels): each subword's share of the logits; the last row is zero
    bias: np.ndarray
    temperature: float
    cutoff: float


def subwords(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and where each text's begin. BUCKETS stands for none."""
    space = b" "
    joined = np.frombuffer(b"".join([space + data[a:b].tobytes() + space for a, b in zip(at[:-1].tolist(), at[1:].tolist())]) + bytes(4), np.uint8)
    b = LOWERED[joined].astype(np.uint32)
    starts = np.cumsum(np.diff(at) + 2) - (np.diff(at) + 2)
    ends = starts + np.diff(at) + 2
    n = len(b) - 4
    three = b[:n] | (b[1 : n + 1] << 8) | (b[2 : n + 2] << 16)
    four = three | (b[3 : n + 3] << 24)
    out = np.empty((n, 2), np.int32)
    out[:, 0] = (three * np.uint32(2654435761)) >> 16
    out[:, 1] = ((four ^ (four >> 15)) * np.uint32(2246822519)) >> 16
    for back, column in ((1, 0), (2, 0), (1, 1), (2, 1), (3, 1)):
        out[np.maximum(ends - back, 0), column] = BUCKETS
    return out, starts


def has_letter(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, bool)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        part = data[a:b]
        out[i] = ASCII_LETTER[part[:64]].any() or ASCII_LETTER[part].any() or ((part >= 0x80).any() and any(map(str.isalpha, part.tobytes().decode("utf-8"))))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logits(model: Model, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    grams, starts = subwords(at, data)
    sums = np.zeros((len(grams), model.table.shape[1]), np.float32)
    for c in (0, 1):
        sums += model.table[grams[:, c]]
    counts = np.add.reduceat((grams < BUCKETS).sum(1), starts)
    return np.add.reduceat(sums, starts, axis=0, dtype=np.float64) / np.maximum(counts, 1)[:, None] + model.bias


def sample(docs: DataFrame, keys: Column, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, the same ones on each run: those with the least hashes of keys."""
    of, part = private(docs, "of", "share")
    share = docs.groupBy(F.col(label).alias(of)).agg((F.lit(float(per_label)) / F.count("*")).alias(part))
    share = stored(share, "share")  # a row for each label: its true size lets Spark leave the texts where they are
    chance = F.pmod(F.xxhash64(keys, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(share, F.col(label) == F.col(of)).where(chance < F.col(part)).drop(of, part)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, size: int = 16, epochs: int = 6, rate: float = 0.5, most_cutoff: float = 0.5, seed: int = 1) -> Model:
    """Train on a sample of the labelled rows of docs."""
    importable(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(label_col).alias("label")).where("label IS NOT NULL AND t IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in pieces(batches, "t", PIECE):
            at, data = utf8(batch.column("t"))
            letters = has_letter(at, data)
            grams, starts = subwords(at, data)
            rows = []
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(grams)])):
                where, n = np.unique(grams[a:b], return_counts=True)
                if letters[i] and len(where := where[keep := where < BUCKETS]):
                    rows.append((batch.column("label")[i].as_py(), where.astype("<i4").tobytes(), (n[keep] / n[keep].sum()).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["label", "place", "weight"])

    rows = sample(known, F.col("id"), "label", per_language).select("t", "label").mapInArrow(count, "label string, place binary, weight binary").collect()
    labels = sorted({r.label for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    data = sorted((labels.index(r.label), bytes(r.place), bytes(r.weight)) for r in rows)
    data = [(y, np.frombuffer(p, "<i4"), np.frombuffer(w, "<f4")) for y, p, w in data]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    back, used = order[: len(data) // 5], order[len(data) // 5 :]
    if not len(back):
        back = used
    e = rng.uniform(-1 / size, 1 / size, (BUCKETS + 1, size))
    w, bias = rng.uniform(-1, 1, (len(labels), size)), np.zeros(len(labels))
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            y, place, weight = data[i]
            lr = rate * max(0.05, 1 - steps / (epochs * len(used)))
            v = weight @ e[place]
            g = softmax(w @ v + bias)
            g[y] -= 1
            back_v = w.T @ g
            w -= lr * np.outer(g, v)
            bias -= lr * 0.1 * g
            e[place] -= lr * 0.2 * np.outer(np.minimum(weight / weight.mean(), 5), back_v)
            steps += 1
    table = (e @ w.T).astype(np.float32)
    table[BUCKETS] = 0
    x = np.array([data[i][2] @ table[data[i][1]] + bias for i in back])
    y = np.array([data[i][0] for i in back])
    loss = lambda t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(x / temperature)
    right = p.argmax(1) == y
    return Model(labels, table, bias, temperature, float(min(most_cutoff, p.max(1)[right].min() * 0.999)) if right.any() else most_cutoff)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the language, its score and whether it is accepted, under `names`; columns of docs that have these names are replaced, so give others to keep them."""
    importable(docs.sparkSession)
    docs = docs.drop(*names)
    at_text = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        m = shared.value
        for batch in pieces(batches, at_text, PIECE):
            at, data = utf8(batch.column(at_text))
            known = has_letter(at, data) & bool(m.labels)
            lang, score = np.full(len(known), "und", object), np.zeros(len(known))
            if known.any():
                p = softmax(logits(m, at, data) / m.temperature)
                lang[known] = np.array(m.labels, object)[p.argmax(1)][known]
                score[known] = p.max(1)[known]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(known & (score >= m.cutoff))], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields])
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def held_out(key: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder; null keys are held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(of)) == remainder, F.lit(True))
