"""Token ids as binary files: blocks of ids transposed into planes, and a chunk index.

Texts are dealt out by ranges of their id and encoded in order by the tokenizers library; ids run on
from text to text and are cut into blocks of `block` ids. A block's 32-bit ids are transposed into
byte planes (all first bytes, all second bytes, ...) or bit planes (all lowest bits, ...); planes
above the block's largest id are left out, and each other plane is compressed with zstandard.

    file    = frame*  footer  (length of the footer: 4 bytes, little-endian)  MAGIC  line end
    frame   = the planes of one block, lowest first, each a zstandard frame;  line end
    footer  = length of the index (4 bytes, little-endian), the index in JSON, documents in zstandard
    index   = planes ("byte" or "bit"), block, partition, file (its number in the partition), base
              (ids of the partition before this file), chunks: [[offset, ids, [bytes of each plane]]]
    documents = for each document that has ids in the file: id (8 bytes), whether it is null (1 byte),
              its ids in this file (8 bytes), whether earlier and later files hold some too (1 byte each);
              each field for all documents before the next

Spark's text writer stores them, one frame a row with a line end as row separator, so a task that is
run again leaves no half file, and any store that Spark writes to will do. A file holds `chunks`
blocks, so a long text goes on in the next file. Files are read whole, `chunks` blocks at a time.

A null text is empty and has only the end id. Rows with a null id come last, rows of one id in the
order of their texts' hashes; repeated rows each have their place. An empty table gives no files with
content, which read as no documents. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import byte_names
from .common import KEPT, alone, importable, pieces, stored

MAGIC = b"TLPLANES1"
#: A text may be cut before a space or line end that follows neither: no match of a byte-level pre-tokenizer runs from other characters into white space.
PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
#: Where a cut before every space or line end would divide white space.
RUN = re.compile(r"\s[ \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Letters at a piece's start (after a line end) that a byte-level pre-tokenizer keeps as one: what follows is surely no letter.
STEM = re.compile(r"(\n?)([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]++)(?=[\x00-\x40\x5B-\x60\x7B-\x7F]|\Z)")
ID = attrgetter("id")
#: Pieces whose ids a worker remembers in each of two generations; characters of a text that are encoded at a time.
MEMO, SLICE = 250_000, 1 << 20
SEGMENTS = pa.schema([("partition", pa.int64()), ("file", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("before", pa.bool_()), ("after", pa.bool_()), ("total", pa.int64())])
ENCODERS: dict[str, "Encoder"] = {}
KEPT.append(ENCODERS)


class Encoder:
    """Ids of texts as the library gives them, without added special tokens, truncation or padding.

    Where the tokenizer allows it, texts are cut at white space, and the library encodes each
    different piece once, many in one call; ids are dealt out by the bytes their tokens stand for.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(model)
        pre = told.get("pre_tokenizer") or {}
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) and not re.search(r"\s", x["content"]) for x in told.get("added_tokens", []))
        self.by_piece = plain and told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
        vocabulary = self.library.get_vocab()
        special = {x["content"] for x in told.get("added_tokens", [])}
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.encode()) if token in special else len(token)
        # what a special token begins with may not be taken for letters
        self.by_stem = self.by_piece and not any(x[:1].isalpha() for x in special)
        names = {b: x for x, b in byte_names().items()}
        self.shown = [names[b] for b in range(256)]
        self.line = self.ids("\n")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text's pieces: one that begins with a space and is no white space after it without that space, one that begins with a line end as it is, others after a space."""
        if text and not (RUN.search(text) or text[0].isspace() or text[-1].isspace()):
            out = text.replace("\n", " \n").split(" ")
            out[0] = " " + out[0]
            return out
        return [x[1:] if x[0] == " " and not x[1:2].isspace() and len(x) > 1 else x if x[0] == "\n" else " " + x for x in PIECE.findall(text)]

    def learn(self, new: set[str]) -> None:
        """Ids of pieces: of letters alone by the library's model, of what follows them as a text; other pieces that start and end like a word in a text are encoded as one text."""
        run, plain, stems, parts, memo, older = [], [], [], [], self.memo, self.older
        for x in sorted(new):
            if self.by_stem and x.isascii() and x.isalpha():
                plain.append(x)
            elif self.by_stem and (m := STEM.match(x)):
                parts.append(m)
                if m[1] or not (m[2] in memo or m[2] in older):
                    stems.append(m[0])
            elif x[0] == " " or x[-1].isspace():
                memo[x] = self.ids(x[1:] if x[0] == " " else x if x[0] == "\n" else " " + x)
            else:
                run.append(x)
        memo.update(self.letters(plain))
        stems = self.letters(stems)
        for m in parts:
            rest = m.string[m.end() :]
            if rest not in self.rests:
                if len(self.rests) > MEMO // 4:
                    self.rests.clear()
                self.rests[rest] = self.ids(rest)
            ids = stems.get(m[0]) or memo.get(m[0]) or older[m[0]]
            memo[m.string] = (self.line + ids if m[1] else ids) + self.rests[rest]
        for i in range(0, len(run), 10_000):
            part = [x if x[0] == "\n" else " " + x for x in run[i : i + 10_000]]
            ids = np.frombuffer(self.ids("".join(part)), "<u4")
            cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x.encode()) for x in part])) + 1
            data, at = ids.tobytes(), 0
            for x, cut in zip(run[i : i + 10_000], (4 * cuts).tolist()):
                self.memo[x] = data[at:cut]
                at = cut

    def letters(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of letters, by the library's model: after a space, or, where a line end is before them, by themselves and without it."""
        # letters hold no line end, so one stands between them
        shown = "\n".join([x[1:] if x[0] == "\n" else " " + x for x in stems]).encode().decode("latin-1").translate(self.shown).split(self.shown[10])
        tokenize, ids, ends = self.library.model.tokenize, [], []
        for x in shown if stems else ():
            ids.extend(map(ID, tokenize(x)))
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return {x: data[i:j] for x, i, j in zip(stems, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [self.ids(x) for x in texts]
        cut = [self.cut(x) for x in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        if new := set().union(*cut).difference(self.memo):
            unknown = new.difference(self.older)
            self.memo.update((x, self.older[x]) for x in new - unknown)
            self.learn(unknown)
        return [b"".join(map(self.memo.__getitem__, x)) for x in cut]

    def slices(self, text: str) -> Iterator[str]:
        """The text, or parts of a long one that are encoded as in it."""
        at = 0
        while self.by_piece and len(text) - at > SLICE and (m := CUT.search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte or bit planes of 32-bit ids, lowest first, up to the largest id's highest."""
    flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [flat[:, i].tobytes() for i in range(max(1, -(-top // 8)))]
    bits = np.unpackbits(flat, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(max(1, top))]


def joined(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of these planes."""
    if kind == "byte":
        flat = np.zeros((n, 4), np.uint8)
        for i, x in enumerate(parts):
            flat[:, i] = np.frombuffer(x, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, x in enumerate(parts):
            bits[:, i] = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little", count=n)
        flat = np.packbits(bits, axis=1, bitorder="little")
    return flat.view("<u4").ravel()


class Writer:
    """Rows of a partition's files: frames, then a footer in the place of each file's last row."""

    def __init__(self, partition: int, kind: str, block: int, chunks: int, level: int):
        self.partition, self.kind, self.block, self.most = partition, kind, block, chunks
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.file, self.base = bytearray(), 0, 0
        self.opened()

    def opened(self) -> None:
        self.offset, self.chunks, self.docs = 0, [], []
        self.n = 0  # ids of this file, those held included

    def frame(self) -> bytes:
        ids = np.frombuffer(bytes(self.held[: 4 * self.block]), "<u4")
        del self.held[: 4 * self.block]
        parts = [self.zstd.compress(x) for x in planes(ids, self.kind)]
        row = b"".join(parts)
        self.chunks.append([self.offset, len(ids), [len(x) for x in parts]])
        self.offset += len(row) + 1
        return row

    def footer(self) -> bytes:
        index = json.dumps({"planes": self.kind, "block": self.block, "partition": self.partition, "file": self.file, "base": self.base, "chunks": self.chunks}).encode()
        fields = list(zip(*self.docs))
        documents = b"".join(np.array(x, t).tobytes() for x, t in zip(fields, ("<i8", "u1", "<i8", "u1", "u1")))
        body = struct.pack("<I", len(index)) + index + self.zstd.compress(documents)
        row = body + struct.pack("<I", len(body)) + MAGIC
        self.file, self.base = self.file + 1, self.base + self.n
        self.opened()
        return row

    def add(self, doc_id: int | None, parts: Iterator[bytes]) -> Iterator[bytes]:
        """A document's ids."""
        who, here, before = (doc_id or 0, doc_id is None), 0, False
        for part in parts:
            at = 0
            while at < len(part):
                room = 4 * self.block * (self.most - len(self.chunks)) - len(self.held)  # of this file
                if not room:
                    if here:
                        self.docs.append((*who, here, before, True))
                        here, before = 0, True
                    yield self.footer()
                    continue
                take = part[at : at + min(room, 4 * self.block - len(self.held))]
                self.held += take
                at, here, self.n = at + len(take), here + len(take) // 4, self.n + len(take) // 4
                if len(self.held) == 4 * self.block:
                    yield self.frame()
        if here:
            self.docs.append((*who, here, before, False))

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self.frame()
        if self.docs:
            yield self.footer()


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, kind: str = "byte", block: int = 1 << 16, chunks: int = 255, level: int = 3) -> None:
    """Write each text's ids and `end`, in ascending order of id, to files of `chunks` blocks at most under path. The driver reads the tokenizer's file."""
    importable(docs.sparkSession)
    if kind not in ("byte", "bit"):
        raise ValueError(f"planes are of bytes or bits, not {kind!r}")
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    model, key = docs.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(ENCODERS)
        if key not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[key] = Encoder(model.value)
        encoder, out = ENCODERS[key], Writer(TaskContext.get().partitionId(), kind, block, chunks, level)

        def rows() -> Iterator[bytes]:
            for batch in batches:
                for piece in pieces(iter([batch]), 1, 1 << 20):
                    ids, texts = (c.to_pylist() for c in piece.columns)
                    if len(texts) == 1:
                        yield from out.add(ids[0], chain((encoder.encode([s])[0] for s in encoder.slices(texts[0])), (last,)))
                        continue
                    for i, x in zip(ids, encoder.encode(texts)):
                        yield from out.add(i, iter((x + last,)))
            yield from out.close()

        for row in rows():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_last("id"), "hash", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    frames = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("maxRecordsPerFile", chunks + 1).option("lineSep", "\n").text(path)


def opened(content: bytes) -> tuple[dict, list[np.ndarray]]:
    """A file's index and its documents' fields."""
    if not content.endswith(MAGIC + b"\n"):
        raise ValueError("not a file of id planes, or its end is missing")
    at = len(content) - len(MAGIC) - 5
    body = content[at - struct.unpack_from("<I", content, at)[0] : at]
    n = struct.unpack_from("<I", body)[0]
    data = zstandard.ZstdDecompressor().decompress(body[4 + n :])
    count, fields, at = len(data) // 19, [], 0
    for t in ("<i8", "u1", "<i8", "u1", "u1"):
        fields.append(np.frombuffer(data, t, count, at))
        at += fields[-1].nbytes
    return json.loads(body[4 : 4 + n]), fields


def chunk(content: bytes, index: dict, k: int) -> np.ndarray:
    """The ids of a file's k-th block, by its entry in the index."""
    at, n, lengths = index["chunks"][k]
    parts = []
    for size in lengths:
        parts.append(zstandard.ZstdDecompressor().decompress(content[at : at + size]))
        at += size
    return joined(parts, n, index["planes"])


def documents(content: bytes) -> Iterator[tuple[int, int | None, np.ndarray, bool, bool]]:
    """(place in the file, id, ids, whether earlier files hold more, whether later ones do) of each document."""
    index, fields = opened(content)
    k, held, place = 0, np.zeros(0, "<u4"), 0
    for i, null, n, before, after in zip(*(x.tolist() for x in fields)):
        parts, have = [held], len(held)
        while have < n:
            parts.append(chunk(content, index, k))
            have, k = have + len(parts[-1]), k + 1
        ids = np.concatenate(parts)
        yield place, None if null else i, ids[:n], bool(before), bool(after)
        held, place = ids[n:], place + n


def files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.where("length > 0").select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(partition, file, at, doc_id, ids, before, after): each file's documents, ids as little-endian 32-bit integers."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["partition", "file", "at", "doc_id", "ids", "before", "after"]
        types = [pa.int64()] * 4 + [pa.binary(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                index, rows, held = opened(content)[0], [], 0
                for at, i, ids, before, after in documents(content):
                    rows.append((index["partition"], index["file"], index["base"] + at, i, ids.tobytes(), before, after))
                    held += ids.nbytes
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files(spark, path).mapInArrow(run, "partition long, file long, at long, doc_id long, ids binary, before boolean, after boolean")


def shifted(crc: int, n_bytes: int) -> int:
    """A CRC-32 remainder times x to the power of 8 * n_bytes, modulo the polynomial: what bytes after it make of it."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(32):
            if a & (0x80000000 >> i):
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power = 0x00800000  # x to the power of 8
    while n_bytes:
        if n_bytes & 1:
            crc = times(crc, power)
        power, n_bytes = times(power, power), n_bytes >> 1
    return crc


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: ids before it in all files, its ids, and their CRC-32."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                index = opened(content)[0]
                total = index["base"] + sum(x[1] for x in index["chunks"])
                rows = [(index["partition"], index["file"], index["base"] + at, i, len(ids), zlib.crc32(ids), before, after, total) for at, i, ids, before, after in documents(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEGMENTS)], schema=SEGMENTS)

    def whole(crcs: list, sizes: list) -> int:
        out = 0
        for crc, n in zip(crcs, sizes):
            out = shifted(out, 4 * n) ^ crc
        return out

    found = files(spark, path).mapInArrow(run, "partition long, file long, at long, doc_id long, n long, crc long, before boolean, after boolean, total long")
    found = stored(found, "documents")
    # one row a partition: its ids, and those of the partitions before it
    bases = found.groupBy("partition").agg(F.max("total").alias("total"))
    bases = bases.select("partition", (F.sum("total").over(Window.orderBy("partition")) - F.col("total")).alias("base"))
    one = found.where("NOT before AND NOT after").select("partition", "at", "doc_id", "n", "crc")
    # a document in several files: its first part starts it, and the others follow in order
    part = found.where("before OR after").withColumn("first", F.max(F.when(~F.col("before"), F.col("at"))).over(Window.partitionBy("partition").orderBy("at")))
    part = part.groupBy("partition", "first").agg(F.first("doc_id", True).alias("doc_id"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))
    joined_up = F.udf(whole, "long", useArrow=False)(F.col("parts.crc"), F.col("parts.n"))
    part = part.select("partition", F.col("first").alias("at"), "doc_id", "n", joined_up.alias("crc"))
    return one.unionByName(part).join(bases, "partition").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
