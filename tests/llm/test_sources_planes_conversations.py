import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from data import docs, prose, rows
from pyspark.sql import types as T

from transitlake.llm import conversations, divergence, queries, tokenfiles
from transitlake.llm.common import scratch

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow_divergence(rows, least, top):
    df, n = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w).decode() for w in TERM.findall((text or "").encode())]
        df.update((lang or "", w) for w in set(words))
        n.update((lang or "", source or "", w) for w in words)
    groups = {(la or "", s or "") for _, la, s in rows}
    out = []
    for la in {g[0] for g in groups}:
        kept = sorted(w for (x, w), c in df.items() if x == la and c >= least)
        sources = sorted(s for x, s in groups if x == la)

        def p(count):
            total = sum(count(w) for w in kept)
            return {w: 1 + 10**9 * (count(w) + 5) // (total + 5 * len(kept)) for w in kept}

        q = p(lambda w: sum(n[la, s, w] for s in sources))
        by = {s: p(lambda w, s=s: n[la, s, w]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(by[s][w] - by[o][w]) for w in kept), o) for o in sources if o != s)
            terms = sorted((q[w] - by[s][w], w) for w in kept if n[la, s, w] and by[s][w] > q[w])[:top]
            out += [(la, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(60)] + [None, "", "42 !?", "ÉÀ Stone straße", "the the the"]
    some = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "Z"])) for i in range(400)]
    some += [(500, "1 2 3", "xx", "only"), (501, "", "xx", "other"), (502, None, "yy", "alone")]
    got = divergence.divergence(docs(spark, some), least=5, top=7).collect()
    assert sorted(tuple(r) for r in got) == slow_divergence([r[1:] for r in some], 5, 7)


def test_divergence_flushes_and_slices_lose_nothing(spark, monkeypatch):
    rng = random.Random(12)
    some = [(rng.choice(["en", "de"]), rng.choice("abc"), rng.choice(["one Two", "two three", prose(rng, 40)])) for _ in range(300)]
    for x, v in (("MEMO", 7), ("TERMS", 9), ("SLICE", 20)):
        monkeypatch.setattr(divergence, x, v)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some[i : i + 50])], ["lang", "source", "text"]) for i in range(0, 300, 50)]
    sent = [r for b in divergence.collapse(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in sent) == 300
    sent.sort(key=lambda r: (r["lang"], r["key"], r["text"] is None))
    found = collections.Counter()
    for b in divergence.weigh(iter([pa.RecordBatch.from_pylist(sent, divergence.ROWS)])):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    want = collections.Counter((la, s, w) for la, s, t in some for w in re.findall("[a-z]+", t.lower()))
    assert found == want


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


def slow_files(rows, library, end=2):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    at, out = 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(queries.vocabulary())
    out.no_padding()
    out.no_truncation()
    return out


@pytest.mark.parametrize("kind,block,chunks", [("byte", 1 << 16, 255), ("byte", 100, 3), ("bit", 64, 2), ("bit", 7, 1)])
def test_id_planes_against_the_library(spark, library, kind, block, chunks):
    some = rows()
    path = scratch(spark, "ids")
    tokenfiles.write(docs(spark, some), path, queries.vocabulary(), kind=kind, block=block, chunks=chunks)
    got = sorted((tuple(r) for r in tokenfiles.digests(spark, path).collect()), key=lambda r: r[1])
    want = slow_files([r[:2] for r in some], library)
    assert [(r[0], r[1]) for r in got if r[0] not in (7, None)] == [(r[0], r[1]) for r in want if r[0] not in (7, None)]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    parts = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: (r.partition, r.file, r.at))
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts])
    assert len(ids) == sum(r[2] for r in want)
    at = {r[1]: r for r in got}
    assert all(zlib.crc32(ids[s : s + r[2]].tobytes()) == r[3] for s, r in at.items())


def test_pieces_are_encoded_as_whole_texts(library):
    rng = random.Random(4)
    with open(queries.vocabulary(), encoding="utf-8") as f:
        encoder = tokenfiles.Encoder(f.read())
    assert encoder.by_piece
    odd = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "　", "'s", "'LL", "<|endoftext|>", "<|endo", "é", "日本", "🎉", "a", "Stone", "12", "²", ".", "###", "_", "́", "﻿"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, " " * 3000, "a b\n" * 2000]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    old, tokenfiles.SLICE = tokenfiles.SLICE, 11
    try:
        assert [b"".join(encoder.encode(list(encoder.slices(x)))) for x in texts] == want
    finally:
        tokenfiles.SLICE = old


def test_planes_of_any_ids_come_back():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(5, "<u4"), rng.integers(0, 2**32, 1000).astype("<u4"), np.array([2**32 - 1], "<u4"), np.arange(300, dtype="<u4")):
        for kind in ("byte", "bit"):
            assert (tokenfiles.joined(tokenfiles.planes(ids, kind), len(ids), kind) == ids).all()


def test_crc_of_parts_is_that_of_the_whole():
    data = random.Random(1).randbytes(1000)
    for cut in (0, 1, 4, 500, 999, 1000):
        assert tokenfiles.shifted(zlib.crc32(data[:cut]), 1000 - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def test_id_planes_of_no_rows(spark):
    path = scratch(spark, "ids")
    tokenfiles.write(docs(spark, []), path, queries.vocabulary())
    assert tokenfiles.digests(spark, path).count() == 0
    assert tokenfiles.read(spark, path).count() == 0


def slow_search(codes):
    """Cheapest completion first, of all prefixes that could be one, then by audit."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, marks = heapq.heappop(heap)
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", marks):
            return cost, audit
        new = [("I", 2, i, x) for x in "ua"]
        if i < len(codes):
            fault, initial = divmod(codes[i], 4)
            new.append(("D", 3, i + 1, ""))
            if fault in (0, 3):
                new += [("K", fault // 3, i + 1, "sua?"[initial]), *[("R", 2 + fault // 3, i + 1, x) for x in "ua"]]
        for e, c, j, x in new:
            if re.fullmatch("s?(ua)*u?", marks + x):
                heapq.heappush(heap, (cost + c, audit + e, j, marks + x))


def test_search_against_all_edits():
    rng = random.Random(8)
    for n in range(3):
        for codes in itertools.product(range(16), repeat=n):
            assert conversations.search(bytes(codes)) == slow_search(codes), codes
    for _ in range(400):
        codes = [rng.choice([0, 1, 2, 3, 1, 2, 1, 2, 13, 14, 4, 9, 12]) for _ in range(rng.randint(3, 6))]
        assert conversations.search(bytes(codes)) == slow_search(codes), codes


def test_search_of_long_conversations_is_quick():
    cost, audit = conversations.search(bytes([1, 2, 2, 1, 1, 13, 6, 3] * 5000))
    assert len(audit) >= 40000 and cost > 0


def slow_repair(rows):
    def crc(c, t):
        return zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20

    out = []
    for conv in {r[0] for r in rows}:
        own, code, seen = [], [], set()
        for c, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind, role, text = crc(c, turn), role if role is not None else " ", text if text is not None else " "
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            code.append(4 * fault + ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3))
        turns = [t for t, *_ in own if t is not None]
        cost, audit = slow_search(code)
        lines, todo = [], iter(own)
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else next(todo)
            if e != "D":
                lines.append([role if e == "K" else None, text])
        for i, line in enumerate(lines):
            line[0] = line[0] or ("assistant" if i and lines[i - 1][0][0] == "u" else "user")
        initials = ["sua?"[x % 4] for x in code]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, *(sum(x // 4 == f for x in code) for f in (1, 2, 3)), illegal, cost, audit, sha))
    return sorted(out, key=repr)


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *[T.StructField(x, T.StringType()) for x in ("role", "text", "own", "code", "audit", "gone", "c", "copy", "h1")]])


def test_repair_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for conv in range(150):
        for turn in sorted(rng.sample(range(12), rng.randint(1, 6))):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), rng.choice(["Yes.", "No!", "what", " ", "", None, "Ünï 日本?", "end. \n\t", "x.\x85"])))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (900, None, "user", "Hi."), (900, 4, "assistant", "Ok."), (901, -(2**62), "user", "a."), (901, 2**62, "assistant", "b.")]
    rows += [(902, t, "user" if t % 2 == 0 else "assistant", "same.") for t in range(5)]
    frame = spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], TURNS)
    got = conversations.repair(conversations.damaged(frame)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_repair(rows)


def test_repair_of_rows_as_they_are_and_of_none(spark):
    frame = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in conversations.repair(conversations.undamaged(frame)).collect()}
    assert got == {1: (0, "KKK"), 2: (3, "D")}
    assert conversations.repair(conversations.damaged(frame.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op11_divergence"])
def test_source_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_toxic_texts_held_out(spark):
    """Of held-out toxic documents nine in ten are found, and those found are toxic."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = got.agg(F.sum("toxic").alias("toxic"), F.sum("predicted").alias("found"), F.sum(F.col("toxic") * F.col("predicted")).alias("right")).first()
    assert n.right >= 0.9 * n.toxic and n.right >= 0.95 * n.found


def test_letters_are_encoded_by_the_librarys_model_alone(monkeypatch):
    pytest.importorskip("tokenizers")
    with open(queries.vocabulary(), encoding="utf-8") as f:
        e = tokenfiles.Encoder(f.read())
    words = ["zyxorâble", "zyxorable", "Ünterzyx", "zyxorable,", "zyxorable!?", "\nZyxorable", "\nZyxorable,", "zyx'ro", "zyxª", "zyx́o", "zyx<|endoftext|>o", "zyx日", "\nzyx o", "zyx2o"]
    texts = ["a " + " ".join(words).replace(" \n", "\n"), "a " + " ".join(reversed(words)).replace(" \n", "\n") + " z"]
    want = [e.ids(x) for x in texts]
    asked, real = [], e.ids
    monkeypatch.setattr(e, "ids", lambda x: (asked.append(x), real(x))[1])
    assert e.encode(texts) == want and e.encode(texts) == want
    assert not any("orable" in x or "orâble" in x or "nterzyx" in x for x in asked)
    monkeypatch.setattr(tokenfiles, "MEMO", 2)  # what is remembered goes between calls
    again = [e.encode([x])[0] for x in texts * 3]
    assert again == want * 3
