"""Toxicity with noisy-channel deobfuscation.

What a writer meant is restored from what they typed: a token with digits or symbols for letters,
separators between letters, or doubled letters is a lattice of the letters each character may stand
for, decoded by Viterbi search under a character model (a letter after three others) counted over the
words of all documents. A run of tokens of one letter, or of up to three that are no frequent word, is
one lattice too, in which each space may be dropped or kept as the edge of a word. The score is a
logistic regression on the restored words, and on the runs of 4 to 6 letters in them (GRAMS), that are
significantly more common in toxic texts: words of a family that was never seen whole still count.
Both are learned from a bounded sample of `per_label` labelled rows of each label; predictions
for each quarter of these by the others settle how much weights are held back and what a toxic row
weighs. It runs over whole texts.

Words of letters whose letters, each taken once where doubled, are those of no word that counts are
left as typed. Numbers are no words; tokens of stand-ins alone are if one of these is a symbol. Null
and empty texts, and texts without words, get the score of no evidence. Repeated rows and null ids
give a row each. Without labels every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import importable, pieces, stored, utf8
from .language import LOWERED, sample

LETTERS = 28  # a to z, any other letter, and the word's edge
OTHER, EDGE = 26, 27
#: Letters that a character may stand for.
STANDS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SEPARATORS = set(".,-_*'~^`#%&:/\\=\"")
TRAILING = ".,;:!?*#%&$|\"'()[]{}<>~^`-_+=/\\"
LEADING = ".,;:?*#%&\"'()[]{}<>~^`-_=/\\!|+"
DOUBLED = re.compile(r"(.)\1+")
#: Costs of the channel, in natural logarithms: a symbol for a letter, a separator or space put in, a letter repeated.
SWAP, PUT, AGAIN = 0.5, 0.3, 0.7
MEMO = 200_000
GRAMS = (4, 5, 6)
#: Letters of words that may be parts of a word that spaces cut, and the share of all words from which on these are words of their own.
SHORT, COMMON = 3, 1e-5
#: Tried on quarters of the learning rows that others are fitted on: what holds weights back, and what a toxic row weighs. SURE: the score that counts as toxic.
STEPS = [(back, heavy) for back in (0.3, 1.0) for heavy in (3.0, 10.0, 30.0)]
SURE = 0.7


@dataclass
class CharacterModel:
    logp: np.ndarray  # natural logarithms, by three letters before and one
    common: frozenset[str]  # frequent words of up to SHORT letters


def place(ch: str) -> int:
    return ord(ch) - 97 if "a" <= ch <= "z" else OTHER


def collapsed(word: str) -> str:
    return DOUBLED.sub(r"\1", word)


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Letters after three others, counted over all words of docs, smoothed by one half; and the frequent short words (1 / COMMON at most)."""
    importable(docs.sparkSession)
    kind = np.full(256, EDGE, np.int32)
    kind[97:123] = np.arange(26)
    kind[0xC0:] = OTHER  # the first byte of other characters; those that go on are left out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, short, n = np.zeros(LETTERS**4, np.int64), Counter(), 0
        for batch in pieces(batches, text_col):
            at, data = utf8(batch.column(0))
            b = LOWERED[data[at[0] : at[-1]]]
            ends = np.zeros(len(b) + 1, bool)
            ends[at - at[0]] = True
            k = np.where(ends[:-1], EDGE, kind[b])[(b & 0xC0) != 0x80] if len(b) else np.zeros(0, np.int32)
            k = np.concatenate([[EDGE] * 3, k, [EDGE] * 2])
            k = k[np.concatenate([[True] * 3, (k[3:] != EDGE) | (k[2:-1] != EDGE)])]  # one edge between words
            counts += np.bincount(((k[:-3] * LETTERS + k[1:-2]) * LETTERS + k[2:-1]) * LETTERS + k[3:], minlength=LETTERS**4)
            raw = b.tobytes()
            for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()):
                words = raw[x:y].split()
                n += len(words)
                short.update([w for w in words if len(w) <= SHORT])
        at = np.flatnonzero(counts)
        words = [w.decode("utf-8", "replace") for w in short]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *[-1] * (len(words) + 1)], pa.int64()), pa.array([*[None] * len(at), *words, None], pa.string()), pa.array([*counts[at].tolist(), *short.values(), n], pa.int64())], ["gram", "word", "n"])

    found = stored(docs.select(text_col).mapInArrow(run, "gram long, word string, n long").groupBy("gram", "word").agg(F.sum("n").alias("n")), "characters")
    counts = np.full(LETTERS**4, 0.5)
    t = found.where("gram >= 0").select("gram", "n").toArrow()  # LETTERS ** 4 rows at most
    counts[t.column("gram").to_numpy()] += t.column("n").to_numpy()
    counts = counts.reshape(-1, LETTERS)
    total = found.where("gram < 0 AND word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = found.where((F.col("gram") < 0) & F.col("word").isNotNull() & (F.col("n") >= max(2.0, COMMON * total))).select("word").collect()  # 1 / COMMON rows at most
    return CharacterModel(np.log(counts / counts.sum(1, keepdims=True)).ravel(), frozenset(r.word for r in common))


def features(words: Iterable[str], known: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    """Words, and the runs of letters in them, marked. known: those of words met before."""
    known = {} if known is None else known
    out: set[str] = set()
    for w in words:
        own = known.get(w)
        if own is None:
            own = known[w] = (w, *{f"~{w[i : i + n]}" for n in GRAMS for i in range(len(w) - n + 1)})
        out.update(own)
    return out


class Finder:
    """Which of some features a text of words has: an automaton over its letters, so that words need not be cut."""

    def __init__(self, wanted: Iterable[str]):
        self.machine, self.empty = ahocorasick.Automaton(), True
        for x in wanted:
            self.machine.add_word(x[1:] if x.startswith("~") else f" {x} ", x)
            self.empty = False
        if not self.empty:
            self.machine.make_automaton()

    def all(self, words: Iterable[str]) -> set[str]:
        return set() if self.empty else {x for _, x in self.machine.iter(f" {' '.join(words)} ")}

    def any(self, word: str) -> bool:
        return not self.empty and next(self.machine.iter(f" {word} "), None) is not None


class Reader:
    """Restores words; with `wanted` features only such as may have one of them."""

    def __init__(self, lm: CharacterModel, wanted: set[str] | None = None):
        self.logp, self.common = lm.logp.tolist(), lm.common
        self.memo: dict[str, str] = {}
        # parts that letters with nothing doubled must have
        self.part = None if wanted is None else Finder({"~" + collapsed(w.removeprefix("~")) for w in wanted})

    def decode(self, token: str) -> str:
        """The likeliest letters, and spaces, behind the token."""
        states: dict[tuple[int, str], tuple[float, tuple]] = {((EDGE * LETTERS + EDGE) * LETTERS + EDGE, ""): (0.0, ())}
        logp, wrap = self.logp, LETTERS * LETTERS
        for ch in token:
            after: dict[tuple[int, str], tuple[float, tuple]] = {}

            def put(state, cost, path):
                if state not in after or after[state][0] < cost:
                    after[state] = (cost, path)

            letters = [(ch, 0.0)] if ch.isalpha() else []
            letters += [(x, SWAP) for x in STANDS.get(ch, "")]
            skipped = ch == " " or ch in SEPARATORS or (ch not in STANDS and not ch.isalpha())
            for (before, last), (score, path) in states.items():
                for x, cost in letters:
                    k = place(x)
                    put((before % wrap * LETTERS + k, x), score + logp[before * LETTERS + k] - cost, (path, x))
                    if x == last:
                        put((before, last), score - AGAIN, path)
                if skipped:
                    put((before, last), score - PUT, path)
                if ch == " " and before % LETTERS != EDGE:
                    put((before % wrap * LETTERS + EDGE, ""), score + logp[before * LETTERS + EDGE], (path, " "))
            states = after
        score, path = max(((s + (logp[before * LETTERS + EDGE] if before % LETTERS != EDGE else 0.0), p) for (before, _), (s, p) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """The restored word of a lower-case token; '' if it has none."""
        found = self.memo.get(token)
        if found is None:
            core = token.rstrip(TRAILING).lstrip(LEADING)
            if core.isalpha():
                keep = not DOUBLED.search(core) or (self.part is not None and not self.part.any(collapsed(core)))
                found = core if keep else self.decode(core)
            elif not any(map(str.isalpha, core)) and not (len(core) > 2 and any(c in STANDS and not c.isdigit() for c in core) and all(c in STANDS or c in SEPARATORS for c in core)):
                found = ""
            else:
                found = self.decode(core)
            if len(token) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[token] = found
        return found

    def words(self, text: str) -> Counter:
        """Restored words and their counts."""
        tokens = text.lower().split()
        out: Counter = Counter()
        for token, n in Counter(tokens).items():
            out[self.word(token)] += n
        run: list[str] = []
        for token in [*tokens, ""]:
            core = token.rstrip(TRAILING).lstrip(LEADING) or (token if token in STANDS else "")
            if core and (len(core) == 1 or (len(core) <= SHORT and core not in self.common)):
                run.append(core)
                continue
            if len(run) > 1:
                joined = "".join(run)
                if len(joined) > SHORT and not joined.isdigit() and (self.part is None or not joined.isalpha() or self.part.any(collapsed(joined))):
                    out.update(self.decode(" ".join(run)).split())
            run = []
        del out[""]
        return out


def fit(docs: DataFrame, labels: DataFrame, lm: CharacterModel, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 5000, least: int = 4, z: float = 4.0) -> dict[str, float]:
    """Weights of features; '' is the bias. labels: (id, label 0 or 1)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(stored(sample(known, F.col("id"), "y", per_label), "labelled"), "id")
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(shared.value), {}
        for batch in pieces(batches, "t"):
            if len(known) > MEMO:
                known.clear()
            words = [list(features(reader.words(t), known)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(words, pa.list_(pa.string()))], ["id", "y", "words"])

    seen = stored(rows.select("id", "t", "y").mapInArrow(listed, "id string, y int, words array<string>"), "seen")
    totals = {r.y: r.n for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        return {"": -math.inf}
    pairs = seen.select("id", "y", F.explode("words").alias("word"))
    by = pairs.groupBy("word").agg(F.sum("y").alias("k1"), F.sum(1 - F.col("y")).alias("k0"))
    p1, p0 = F.col("k1") / n1, F.col("k0") / max(n0, 1)
    p = (F.col("k1") + F.col("k0")) / (n1 + n0)
    keen = by.where((F.col("k1") >= least) & ((p1 - p0) > z * F.sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / max(n0, 1))))).select("word")
    facts = seen.select("id", "y").join(pairs.join(keen, "word").groupBy("id").agg(F.collect_set("word").alias("have")), "id", "left").collect()  # per_label of each label, keen words only
    facts = sorted((r.id, r.y, tuple(sorted(r.have or ()))) for r in facts)
    names = sorted({w for f in facts for w in f[2]})
    index = {w: i for i, w in enumerate(names)}
    y = np.array([f[1] for f in facts], float)
    row = np.array([i for i, f in enumerate(facts) for _ in f[2]], int)
    col = np.array([index[w] for f in facts for w in f[2]], int)
    fold = np.array([zlib.crc32(str(f[0]).encode()) % 4 for f in facts], int)
    best = (-1.0, -math.inf, *STEPS[0])
    if all(4 <= y[fold == k].sum() <= (fold == k).sum() - 4 for k in range(4)):
        for back, heavy in STEPS:
            x = np.zeros(len(y))
            for k in range(4):
                w, bias = regression(row, col, y, len(names), np.where(fold == k, 0.0, 1.0), back, heavy, 60)
                x[fold == k] = 1 / (1 + np.exp(-(bias + np.bincount(row, w[col], len(y)))))[fold == k]
            hit = x >= SURE
            f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum())
            loss = np.where(y == 1, np.log(np.maximum(x, 1e-12)), np.log(np.maximum(1 - x, 1e-12))).mean()
            best = max(best, (round(f1, 6), loss, back, heavy))
    w, bias = regression(row, col, y, len(names), np.ones(len(y)), *best[2:])
    return {"": bias} | dict(zip(names, w.tolist()))


def regression(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, weight: np.ndarray, back: float, heavy: float, turns: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on features that are there or not; `back` holds weights back, a toxic row weighs `heavy`."""
    weight = weight * np.where(y == 1, heavy, 1.0)
    w, bias = np.zeros(n), math.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5))
    grad2, bias2 = np.full(n, 1e-8), 1e-8
    for _ in range(turns):
        g = (1 / (1 + np.exp(-(bias + np.bincount(row, w[col], len(y))))) - y) * weight
        gw = np.bincount(col, g[row], n) + back * w
        gb = g.sum()
        grad2 += gw * gw
        bias2 += gb * gb
        w -= 0.5 * gw / np.sqrt(grad2)
        bias -= 0.5 * gb / math.sqrt(bias2)
    return w, bias


def scores(docs: DataFrame, lm: CharacterModel, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, found): found are the features that spoke for the score."""
    shared = docs.sparkSession.sparkContext.broadcast((lm, weights))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, w = shared.value
        reader, finder = Reader(lm, set(w) - {""}), Finder(set(w) - {""})
        for batch in pieces(batches, "t"):
            score, found = [], []
            for t in batch.column("t").to_pylist():
                have = sorted(finder.all(reader.words(t or "")))
                x = w[""] + sum(w[k] for k in have)
                score.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
                found.append([k for k in have if w[k] > 0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["id", "score", "found"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double, found array<string>").withColumnRenamed("id", id_col)
