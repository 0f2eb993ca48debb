import itertools
import random

import numpy as np
import pytest
import xxhash
from data import docs, prose, rows

from transitlake.llm import bpe, common, language, queries, simhash, suffixes, warc
from transitlake.llm.common import scratch


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, distance):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= distance:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 90) for _ in range(12)]
    more = [(100 + i, " ".join(w if rng.random() > 0.01 else "swap" for w in rng.choice(base).split())) for i in range(150)]
    got = simhash.near_duplicates(docs(spark, more)).collect()
    fps = {r.doc_id: r.fp % 2**64 for r in got}
    assert fps == {i: slow_print(t) for i, t in more}
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps, 4)


def test_simhash_hot_blocks_lose_no_link(spark):
    rng = random.Random(6)
    seed = rng.getrandbits(64)
    fps = {seed ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = simhash.components(simhash.links(nodes, 4, block=16)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    groups = {}
    for x in fps:
        groups.setdefault(root.get(x, x), set()).add(x)
    want = {}
    for x, r in slow_components({x: x for x in fps}, 4).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 301)
    pairs = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(names, names[1:])]
    table = spark.createDataFrame(pairs, "a long, b long")
    assert {r.root for r in simhash.components(table).collect()} == {min(names)}
    with pytest.raises(RuntimeError):
        simhash.components(table, rounds=2)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].fp == by[1].fp == by[2].fp == 0 and by[2].component_id == 0
    assert by[11].component_id == by[12].component_id == 7 and by[None].component_id == 8
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_warc_round_trip(spark):
    many = [(5, "u5", "<p>same</p>"), (2, "http://a/ b\n", "<p>same</p>"), (9, None, None), (10, "", ""), (3, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\né日"), (3, "x", "other"), (2, "again", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (11, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in many], "page_id long, url string, html string, digest string, n int")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path, file_bytes=9_000_000)
    got = warc.resolved(warc.read_archives(spark, path)).collect()
    assert len(got) == len(many)
    said = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    n = len("<p>same</p>")
    assert said == sorted([("2", n, "response", None), ("2", n, "response", None), ("5", n, "revisit", "2"), ("None", n, "revisit", "2"), ("9", 0, "response", None), ("10", 0, "revisit", "9"), ("3", len(many[4][2].encode()), "response", None), ("3", 5, "response", None), ("None", 5, "response", None), ("11", 3_000_000, "response", None)])
    texts = {bytes(r.payload).decode() for r in warc.read_archives(spark, path, payloads=True).collect() if r.record_type == "response"}
    assert texts == {t or "" for _, _, t in many}
    blank = [(1, "u", ""), (2, "u", "")]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(blank, "page_id long, url string, html string"), path, min_bytes=1)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}
    empty = scratch(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_bpe_against_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    slow = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = "ab'sredvlmtn \t\n.,!1２é日́🎉\x1c\x85\xa0　"
    texts = [None, "", "it's a 'll test''s \n\n y'very 'rex <|endoftext|>hi <|endoftext|>", "ab" * 5000, " " * 4000, *("".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(800))]
    done = bpe.decode(bpe.encode(docs(spark, list(enumerate(texts))), path), path).collect()
    assert len(done) == len(texts)
    for r in done:
        want = slow.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == slow.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), path).count() == 0
    assert bpe.decode(bpe.encode(docs(spark), path), path).count() == len(rows())


def test_bpe_decodes_where_it_encodes(spark):
    path = queries.vocabulary()
    apart = bpe.decode(bpe.encode(docs(spark), path), path)
    once = bpe.encode(docs(spark), path, decoded=True)
    assert once.columns == apart.columns and sorted(once.collect(), key=str) == sorted(apart.collect(), key=str)
    assert queries.token_digests(docs(spark), path)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_operators_let_go_of_what_others_keep_in_a_worker(spark, monkeypatch):
    table, seen = docs(spark), []
    kind = type(table)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: (seen.append(f), real(self, f, *a, **k))[1])
    path = queries.vocabulary()
    simhash.similar(table), simhash.fingerprints(table), language.predict(table, language.fit(table)), suffixes.deduplicate(table), bpe.encode(table, path)
    assert len(seen) >= 10
    for f in seen:
        kept = {"an automaton": 1}
        monkeypatch.setattr(common, "KEPT", [kept, {}])
        list(f(iter([])))
        assert not kept, f
    own = {"an automaton": 1}
    monkeypatch.setattr(common, "KEPT", [own, {}])
    common.alone(own)
    assert own


def merged_in_order(ids, rank):
    while best := min((rank[p] for p in zip(ids, ids[1:]) if p in rank), default=None):
        i = next(i for i, p in enumerate(zip(ids, ids[1:])) if rank.get(p) == best)
        ids[i : i + 2] = [best[1]]
    return ids


def test_automaton_agrees_with_merging_in_order():
    c = bpe.compile_vocabulary(queries.vocabulary())
    a = bpe.automaton(c)
    assert (np.diff(c.arcs) > 0).all() and len(c.arcs) == len(c.target) and c.target.max() < len(c.emitted) == len(c.cuts) - 1
    rank = {(u, v): (time, w) for time, (u, v, w) in enumerate(c.merges.tolist())}
    at = np.cumsum(c.size) - c.size
    byte = {int(c.flat[at[i]]): i for i in np.flatnonzero(c.size == 1).tolist()}
    rng = random.Random(2)
    for _ in range(500):
        word = bytes(rng.choice(b"theinraos tion") for _ in range(rng.randint(1, 24)))
        assert a.encode_word(word) == merged_in_order([byte[b] for b in word], rank)


def test_states_are_those_of_the_gadgets():
    """A literal construction, state by state, on small merge lists."""
    rng, done = random.Random(4), 0
    for _ in range(150):
        label, merges, seen = {i: bytes([97 + i]) for i in range(3)}, [], set()
        for _ in range(rng.randint(1, 9)):
            u, v = rng.choice(list(label)), rng.choice(list(label))
            if label[u] + label[v] in label.values() or (u, v) in seen:
                continue
            seen.add((u, v))
            merges.append((u, v, len(label)))
            label[len(label)] = label[u] + label[v]
        rank = {(u, v): (time, w) for time, (u, v, w) in enumerate(merges)}
        if any(merged_in_order([b - 97 for b in label[w]], rank) != [w] for _, _, w in merges):
            continue  # a token that its own bytes don't give
        done += 1
        arcs = {0: {0: 0, 1: 0, 2: 0}}  # state -> token -> state
        for u, v, w in merges:
            reached = {x[u] for x in arcs.values() if u in x}
            copies = {p: len(arcs) + i for i, p in enumerate(sorted(p for p in reached if v in arcs[p]))}
            for p, new in copies.items():
                arcs[new] = {t: q for t, q in arcs[p].items() if t != v}
            led = {p: arcs[p][v] for p in copies}
            for x in arcs.values():
                if x.get(u) in copies:
                    x[w] = led[x[u]]
                    x[u] = copies[x[u]]
        c = bpe.compiled_of({}, label, merges, str(rng.random()))
        a = bpe.Automaton(c)
        for x, y in itertools.product(label, label):
            assert a.gadgets.arc(x, y) == any(y in arcs[q[x]] for q in arcs.values() if x in q)
        for n in range(1, 9):
            for _ in range(40):
                word = bytes(rng.choice(b"abc") for _ in range(n))
                want = merged_in_order([b - 97 for b in word], rank)
                assert a.encode_word(word) == want
                q = 0
                for t in want:
                    assert t in arcs[q]
                    q = arcs[q][t]
    assert done >= 30


def test_all_code_points_are_encoded_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    slow, a = tokenizers.Tokenizer.from_file(path), bpe.automaton(bpe.compile_vocabulary(path))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a".join(map(chr, points[i : i + 997])) for i in range(0, len(points), 997)]
    want = slow.encode_batch(texts, add_special_tokens=False)
    for i in range(0, len(texts), 100):
        for got, w in zip(a.encode_all(texts[i : i + 100]), want[i : i + 100]):
            assert np.frombuffer(got, "<u4").tolist() == w.ids
