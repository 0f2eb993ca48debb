"""BPE encoding and decoding with a tokenization automaton.

The automaton over tokens has as states what may follow the token just read. It starts with one
state that loops on every byte. Each merge (u, v -> w), in order, applies the merge gadget: the state
behind u is split, its copy loses the arc v (so u v can no longer be spelled), every state with an arc
u gets an arc w, and w leads where v led. A token's arcs all lead to one state, so the split-off
copies are kept as differences: `origin` (the state copied, and when) and `cut` (the arc lost, and
when). A word has just one path that spells it: its tokenization, and so has each prefix of it.

That automaton is compiled into one over bytes, by reading each token as its bytes (the usual subset
construction): states are numbered, arcs lie in arrays, and each state emits the one token that ends
there. The driver compiles what the labels of the vocabulary need and broadcasts it; a word takes one
look-up in the table for each byte. Decoding emits the labels of the arcs that the ids name.

Nulls are empty texts; empty texts have no tokens; repeated rows and null ids are encoded row by
row; other columns are dropped. Long words cost time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import KEPT, alone, importable, pieces

LETTER, NUMBER, SPACE, END, OTHER = 1, 2, 3, 4, 0
#: White space in Unicode, and the endings that split off after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Words kept with their ids in each worker.
MEMO = 80_000
#: States of the automaton that a worker holds.
LIMIT = 220_000


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import unicodedata

    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def split(texts: list[str]) -> tuple[list[bytes], list[int]]:
    """Words of byte-level BPE in UTF-8, as its splitting pattern cuts them, found with array operations over many texts; where each text's words begin, and where the last end."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
    joined = "\0".join([*texts, ""])
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(c)
    k = kinds()[c]
    k[ends] = END
    start = np.ones(n, bool)
    np.not_equal(k[1:], k[:-1], out=start[1:])
    start[ends] = True
    after = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & (k[1:] != END)) + 1  # what follows white space
    start[after - 1] = True
    start[after[c[after - 1] == 0x20]] = False
    for i in np.flatnonzero((c == 0x27) & start).tolist():
        if k[i + 1] == LETTER:
            two = chr(c[i + 1]) + (chr(c[i + 2]) if k[i + 2] == LETTER else "")
            long = 1 if two[0] in SHORT else 2 if two in LONG else 0
            if long:
                start[i + 1] = False
                start[i + 1 + long] = True
    at = np.flatnonzero(start)
    raw = joined.encode("utf-8")
    if len(raw) != n:
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        cuts = (np.cumsum(width) - width)[at]
    else:
        cuts = at
    last = np.searchsorted(at, ends)  # the end marks among the words
    cuts = cuts.tolist()
    words = [raw[x:y] for x, y in zip(cuts, [*cuts[1:], len(raw)])]
    return words, [0, *(last + 1).tolist()]


@dataclass
class Compiled:
    """The automaton as arrays: what the gadgets did, and the arcs over bytes. It is as large as the vocabulary makes it."""

    digest: str
    special: dict[str, int]
    size: np.ndarray  # bytes of each id's label
    flat: np.ndarray  # all labels, one after another
    merges: np.ndarray  # (u, v, w) in order
    arcs: np.ndarray  # state * 256 + byte, rising
    target: np.ndarray
    emitted: np.ndarray  # by state: the token that ends there
    cuts: np.ndarray  # by state: where its parts begin, and where the last ends
    parts: np.ndarray  # a trie node, and one more than the token before it in the lowest 24 bits


class Labels:
    """What arcs emit: all that decoding needs of the automaton."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat = size, flat
        self.place = np.cumsum(self.size) - self.size

    def decode_all(self, many: list[bytes]) -> list[bytes]:
        """The labels of the arcs that each list of ids names, one after another."""
        ids = np.frombuffer(b"".join(many), "<u4")
        size = self.size[ids]
        to = np.cumsum(size)
        flat = self.flat[np.repeat(self.place[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)].tobytes()
        ends = np.concatenate([[0], to])[np.cumsum([len(x) // 4 for x in many])].tolist() if many else []
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Gadgets:
    """The automaton over tokens, one merge gadget after another."""

    def __init__(self, single: list[int], merges: np.ndarray, size: int):
        self.born = array("i", [-1]) * size  # the merge that made each token; 0 for those of one byte
        self.first, self.second = array("i", [-1]) * size, array("i", [-1]) * size
        self.cut: dict[int, int] = {}
        for i in single:
            self.born[i] = 0
        for time, (u, v, w) in enumerate(merges.tolist(), 1):
            if self.born[w] >= 0:
                raise ValueError(f"token {w} comes of two merges")
            self.cut[u << 24 | v] = time  # the split-off copy of the state behind u has no arc v
            self.first[w], self.second[w] = u, v  # w leads where v led, and starts where u starts
            self.born[w] = time

    def arc(self, x: int, y: int, time: int = 1 << 60) -> bool:
        """Whether the state behind x has an arc y after `time` merges."""
        born, cut, first, second = self.born, self.cut, self.first, self.second
        while True:
            if cut.get(x << 24 | y, time + 1) <= time:
                return False
            a, b = born[x], born[y]
            if not a and not b:
                return True
            if a == b:  # x leads where its second half led, and reads itself if that read its first half
                y, x, time = first[x], second[x], a - 1
            elif a > b:  # the state behind x was copied from that behind its second half
                x, time = second[x], a - 1
            else:  # y's arc came to the states that read its first half
                y, time = first[y], b


class Automaton:
    """The automaton over bytes. A state is what the bytes read so far leave open: the parts of tokens that
    may go on (a node of the trie of labels), each with the token before it, and the token that ends here,
    of which there is just one. Its arcs are a table; arcs that no label of the vocabulary needs are added
    when a word first takes them, and forgotten when there are over LIMIT states."""

    def __init__(self, compiled: Compiled):
        self.special = compiled.special
        self.size = compiled.size.tolist()
        flat, single, at = compiled.flat.tobytes(), [], 0
        self.trie: dict[int, int] = {}
        self.token, self.inner = [-1], bytearray(1)  # whether a node has children
        aside = set(self.special.values())
        for i, n in enumerate(self.size):
            node = 0
            if i not in aside:
                for b in flat[at : at + n]:
                    below = self.trie.get(node << 8 | b)
                    if below is None:
                        below = self.trie[node << 8 | b] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(0)
                        self.inner[node] = 1
                    node = below
            if node:
                self.token[node] = i
            if n == 1 and i not in aside:
                single.append(i)
            at += n
        self.gadgets = Gadgets(single, compiled.merges, len(self.size))
        self.base, self.start = compiled, None
        self.known: dict[int, bool] = {}
        self.words = Memo(self)
        self.reset()

    def reset(self) -> None:
        if self.start is None:
            c = self.base
            cuts, parts = c.cuts.tolist(), c.parts.tolist()
            parts = [tuple(parts[a:b]) for a, b in zip(cuts, cuts[1:])]
            self.start = dict(zip(c.arcs.tolist(), c.target.tolist())), c.emitted.tolist(), parts, {x: i for i, x in enumerate(parts)}
        self.step, self.emitted, self.parts, self.number = (x.copy() for x in self.start)

    def add(self, state: int, byte: int) -> int:
        """The arc that the gadgets imply."""
        below_of, token_of, inner, known = self.trie.get, self.token, self.inner, self.known
        parts, token = [], -1
        for part in self.parts[state]:
            below = below_of(part >> 16 & -256 | byte)
            if below is None:
                continue
            before = part & 0xFFFFFF
            if token < 0:
                y = token_of[below]
                if y >= 0:
                    if not before:
                        token = y
                    else:
                        pair = before << 24 | y
                        ok = known.get(pair)
                        if ok is None:
                            if len(known) > LIMIT:
                                known.clear()
                            ok = known[pair] = self.gadgets.arc(before - 1, y)
                        if ok:
                            token = y
            if inner[below]:
                parts.append(below << 24 | before)
        if token < 0:
            raise ValueError(f"no token can end after byte {byte}")
        parts.append(token + 1)
        key = tuple(parts)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.parts)
            self.parts.append(key)
            self.emitted.append(token)
        self.step[state << 8 | byte] = to
        return to

    def run(self, word: bytes) -> list[int]:
        """The state after each byte of the word: one look-up in the table for each."""
        arc, out, state = self.step.get, [], 0
        for b in word:
            to = arc(state << 8 | b)
            state = self.add(state, b) if to is None else to
            out.append(state)
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The ids on the one path that spells the word, read off from its end."""
        if len(self.parts) > LIMIT:
            self.reset()
        states, emitted, size, i, path = self.run(word), self.emitted, self.size, len(word), []
        while i:
            token = emitted[states[i - 1]]
            path.append(token)
            i -= size[token]
        path.reverse()
        return path

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Strings of special tokens get their ids."""
        parts, special, owner = [], [], []
        for i, t in enumerate(texts):
            at = 0
            while cut := min(((p, s) for s in self.special if (p := t.find(s, at)) >= 0), default=None):
                parts.append(t[at : cut[0]])
                special.append(np.uint32(self.special[cut[1]]).tobytes())
                owner.append(i)
                at = cut[0] + len(cut[1])
            parts.append(t[at:] if at else t)
            special.append(b"")
            owner.append(i)
        words, starts = split(parts)
        memo = self.words
        ids = [memo[w] for w in words]
        out: list[bytes] = [b""] * len(texts)
        for k, i in enumerate(owner):
            out[i] += b"".join(ids[starts[k] : starts[k + 1] - 1]) + special[k]
        return out


class Memo(dict):
    """Ids of words. What is old and not asked for again goes."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            path = self.automaton.encode_word(word)
            ids = struct.pack(f"<{len(path)}I", *path)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.old.clear()
                self.old |= self
                self.clear()
            self[word] = ids
        return ids


def compiled_of(special: dict[str, int], label: dict[int, bytes], merges: list[tuple[int, int, int]], digest: str) -> Compiled:
    """The automaton over the labels of a vocabulary, from its one starting state on."""
    ids = [label.get(i, b"") for i in range(max(label, default=-1) + 1)]
    c = Compiled(digest, special, np.array([len(x) for x in ids], np.int64), np.frombuffer(b"".join(ids), np.uint8), np.array(merges, np.int64).reshape(-1, 3), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([-1]), np.array([0, 1]), np.array([0]))
    a = Automaton(c)
    for i in sorted(label):
        if i not in special.values():
            a.run(label[i])
    arcs = np.array(sorted(a.step), np.int64)
    c.arcs, c.target, c.emitted = arcs, np.array([a.step[x] for x in arcs.tolist()], np.int64), np.array(a.emitted, np.int64)
    c.cuts = np.concatenate([[0], np.cumsum([len(x) for x in a.parts])])
    c.parts = np.array([y for x in a.parts for y in x], np.int64)
    return c


@lru_cache(2)
def compile_vocabulary(path: str) -> Compiled:
    """The automaton of a vocabulary file that the driver can read."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    names, vocab = byte_names(), spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    label = {i: bytes(names[x] for x in t) for t, i in vocab.items() if t not in special} | {i: t.encode() for t, i in special.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return compiled_of(special, label, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], hashlib.sha256(raw).hexdigest())


#: Automata by the digests of their vocabularies, kept until the worker runs another operator.
BUILT: dict[str, Automaton] = {}
KEPT.append(BUILT)


def automaton(compiled: Compiled) -> Automaton:
    alone(BUILT)
    if compiled.digest not in BUILT:
        BUILT.clear()
        BUILT[compiled.digest] = Automaton(compiled)
    return BUILT[compiled.digest]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): ids packed as little-endian unsigned 32-bit integers; with `decoded` also what they decode to, in the same worker. `path` is read on the driver; the workers get the compiled automaton."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compile_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value)
        labels = Labels(shared.value.size, shared.value.flat) if decoded else None
        for batch in pieces(batches, "t", 1 << 20):
            ids = a.encode_all(batch.column(1).fill_null("").to_pylist())
            out = {"id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = texts_of(labels, ids)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def texts_of(labels: Labels, ids: list[bytes]) -> pa.Array:
    return pa.array([x.decode("utf-8", "replace") for x in labels.decode_all(ids)], pa.string())


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """encoded with a column `decoded`."""
    importable(encoded.sparkSession)
    compiled = compile_vocabulary(path)
    shared = encoded.sparkSession.sparkContext.broadcast((compiled.size, compiled.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Labels(*shared.value)
        for batch in pieces(batches, "ids", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts_of(a, batch.column(1).fill_null(b"").to_pylist())], ["id", "ids", "decoded"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def id_count(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
