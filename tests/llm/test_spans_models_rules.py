import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from data import docs, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline
from transitlake.llm import contamination, language, licenses, quality, queries, simhash, suffixes, suffixtree, toxicity

SF = "/root/testdata/sf0.001"


def slow_spans(texts, n):
    first = {}
    for i, t in sorted(texts):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], i)
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "settings"), [(50, {"chunk": 500}), (50, {"gather": 2000}), (50, {"bound": 2}), (50, {"bound": 0, "gather": 3000}), (300, {}), (600, {"bound": 1})])
def test_suffixes_against_brute_force(spark, length, settings):
    rng = random.Random(8)
    base = [prose(rng, 40) for _ in range(6)] + ["ab" * 90, "a" * 200, "é日" * 60]
    texts = [" ".join(rng.choice(base)[: rng.randint(20, 300)] for _ in range(rng.randint(1, 4))) for _ in range(60)] + [None, ""] + base[:3] * 2
    big = "".join(rng.choices("abcdefghijklmnop ", k=1300))
    texts += [big + prose(rng, 30), "zz" + big, prose(rng, 10) + big[:900]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = suffixes.deduplicate(docs(spark, list(enumerate(texts))).repartition(3), length=length, **settings).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = slow_spans([(i, (t or "").encode()) for i, t in enumerate(texts)], length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffixes_repeated_in_one_document(spark):
    rng = random.Random(21)
    s, m, e = ("".join(rng.choices("abcdefghijklmnop ", k=300)) for _ in range(3))
    texts = [(0, s[:150]), (1, s + m + s), (2, m[100:190]), (3, e[20:110]), (4, (e + "|") * 5), (4, "x" + e), (5, s[40:] + e[:200])]
    got = suffixes.deduplicate(docs(spark, texts)).collect()
    raw = [(i, t.encode()) for i, t in texts]
    for r in got:
        one = [(i, t) for i, t in raw if i != r.doc_id or t == r.text.encode()]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == slow_spans(one, 50)[r.doc_id]
    assert {r.doc_id: r.n_removed for r in got}[1] == 300


def test_suffix_order_is_right():
    rng = np.random.default_rng(3)
    for size in (2, 3, 30):
        t = np.concatenate([np.append(rng.integers(1, size + 1, rng.integers(1, 80)), 0) for _ in range(20)]).astype(np.uint8)
        order = suffixes.two_stage_order(t, 16)
        assert sorted(order.tolist()) == list(range(len(t)))
        cut = [bytes(t[i : i + 16]).split(b"\0")[0] for i in order]
        assert cut == sorted(cut)


def test_suffixes_edges(spark):
    got = suffixes.deduplicate(docs(spark), decoded=True).collect()
    assert len(got) == len(rows())
    assert suffixes.deduplicate(docs(spark, [])).count() == 0
    clash = docs(spark).withColumnsRenamed({"key": "starts", "hash": "ends", "fp": "least", "words": "n_bytes", "n": "_kept"}).withColumn("spans", F.lit(1))
    wide = suffixes.deduplicate(clash)
    assert wide.columns[: len(clash.columns)] == clash.columns and wide.where("starts = 'clash' AND n_bytes = 'clash' AND _kept = 'clash' AND spans = 1").count() == len(rows())
    by = [r for r in got if r.doc_id == 12]
    assert all(r.kept == "" and r.n_spans == 1 for r in by)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id is None)


def test_patience_alignment():
    assert licenses.align("x a b y c".split(), "a b c".split()) == [(1, 0), (2, 1), (4, 2)]
    assert licenses.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    known = [(n, licenses.words_of(t.encode())) for n, ts in licenses.TEMPLATES.items() for t in ts]
    notice = licenses.TEMPLATES["GPL-3.0"][0]
    text = "public license work " * 5 + notice + " and the rest. " * 30 + notice.upper().replace("GNU", "gnu, old,")
    found = licenses.scan_words(licenses.words_of(text.encode()), known, 0.8)
    assert [f[0] for f in found] == ["GPL-3.0"] * 2 and found[0][1] == 1.0


def test_alignment_against_the_longest_common_subsequence():
    """A plain aligner: patience pairs are a common subsequence, no longer than the longest; and as long where words are unique."""
    rng = random.Random(7)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for n in range(200):
        if n % 2:
            t = [str(i) for i in range(rng.randint(3, 30))]
        else:
            t = [rng.choice("abcde") for _ in range(rng.randint(3, 30))]
        a = [w for w in t if rng.random() > 0.2]
        for _ in range(rng.randint(0, 6)):
            a.insert(rng.randint(0, len(a)), "new" + str(rng.random()))
        pairs = licenses.align(a, t)
        assert all(a[i] == t[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest(a, t)
        if n % 2:
            assert len(pairs) == longest(a, t)


def test_licenses_lacking_words_and_ties():
    known = [(n, licenses.words_of(t.encode())) for n, ts in licenses.TEMPLATES.items() for t in ts]
    scan = lambda t: licenses.scan_words(licenses.words_of(t.encode()), known, 0.8)
    assert [f[:2] for f in scan("released released released " * 3 + "x Released under the MIT y")] == [("MIT", 0.8)]
    assert [f[0] for f in scan(licenses.TEMPLATES["CC-BY-SA-4.0"][0])] == ["CC-BY-SA-4.0"]
    same = [("B", [b"one", b"two"]), ("A", [b"one", b"two"])]
    assert licenses.scan_words([b"one", b"two"], same, 0.8) == [("A", 1.0, 0, 2)]


def test_licenses_find_each_planted_line(spark):
    lines = {ts[0]: n for n, ts in licenses.TEMPLATES.items()}
    got = {r.doc_id: r.licenses for r in queries.op5_licenses(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = {n for line, n in lines.items() if line in (r.text or "")}
        assert want <= set(got[r.doc_id].split(",")) - {""} or not want
        assert bool(want) == bool(got[r.doc_id])
    assert licenses.scan(docs(spark)).count() == len(rows())
    assert licenses.scan(docs(spark, [])).count() == 0


def test_language_learns(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(table.where(~out), per_language=150)
    got = language.predict(table.where(out), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(r.accepted for r in got if r.lang == r.lang_pred and r.n_chars > 200)
    edge = {r.doc_id: r for r in language.predict(docs(spark), model).collect()}
    assert edge[0].lang_pred == edge[1].lang_pred == edge[2].lang_pred == "und" and edge[2].score == 0 and not edge[2].accepted
    assert edge[5].lang_pred != "und" and all(0 <= r.score <= 1 for r in edge.values())
    assert language.predict(docs(spark, []), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs(spark), language.fit(docs(spark, []))).collect()} == {"und"}


def test_lm_base_is_exact_and_tree_is_a_distribution(spark):
    texts = [(i, t) for i, t in enumerate([*(prose(random.Random(i), 30) for i in range(80)), None, "", "UNSEEN words É"])]
    keep = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in texts if keep(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = suffixtree.scores(docs(spark, texts), ~language.held_out(F.col("doc_id"), 5, 1), top=5, gain=1.0, least=5).collect()
    assert len(got) == len(texts)
    for r in got:
        w = tokens(texts[r.doc_id][1])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    prose_rows = [r for r in got if r.n_tokens > 20]
    assert sum(r.score for r in prose_rows) > sum(r.base_score for r in prose_rows)
    assert suffixtree.scores(docs(spark, []), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        suffixtree.fit(docs(spark, texts), depth=7)


def slow_tree(train, depth, least, gain, strength):
    """Kept contexts and a function for the log10 probability of a text, spelled out."""
    counts = {}
    for t in train:
        b = b"\n" * depth + b" ".join(t) + b"\n"
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                counts.setdefault(b[i - d : i], Counter())[b[i]] += 1
    kept = {b""}
    for s, n in counts.items():
        if s and sum(n.values()) >= least:
            up = counts[s[1:]]
            g = sum(k * math.log(k * sum(up.values()) / (sum(n.values()) * up[x])) for x, k in n.items())
            if g >= gain:
                kept |= {s[i:] for i in range(len(s) + 1)}
    seen = set(counts.get(b"", {}))

    def p(s, x):
        n = counts.get(s, Counter())
        if not s:
            return (n[x] + 0.5) / (sum(n.values()) + 0.5 * (len(seen) + max(256 - len(seen), 1)))
        return (n[x] + strength * p(s[1:], x)) / (sum(n.values()) + strength)

    def score(t):
        b, total = b"\n" * depth + b" ".join(t) + b"\n", 0.0
        for i in range(depth, len(b)):
            s = next(b[i - d : i] for d in range(depth, -1, -1) if b[i - d : i] in kept)
            total += math.log10(p(s, b[i]))
        return total

    return kept, score


@pytest.mark.parametrize("most", [10**6, 40])
def test_tree_against_brute_force(spark, most):
    texts = [(i, prose(random.Random(i), 25)) for i in range(30)] + [(50, "UNSEEN words É")]
    words = lambda t: t.encode().lower().split()
    train = [words(t) for i, t in texts if i < 25]
    kept, score = slow_tree(train, 3, 8, 2.0, 4.0)
    tree = suffixtree.fit(docs(spark, [x for x in texts if x[0] < 25]), depth=3, least=8, gain=2.0)
    found = {(r.depth, r.context) for r in tree.rows.select("depth", "context").distinct().collect()}
    assert found == {(len(s), int.from_bytes(s, "big")) for s in kept} and len(kept) > 100
    assert (len(list(suffixtree.parts_of(tree, most))) > 1) == (most == 40)
    got = suffixtree.scores(docs(spark, texts), F.col("doc_id") < 25, depth=3, least=8, gain=2.0, most=most).collect()
    for r in got:
        assert r.score == pytest.approx(score(words(dict(texts)[r.doc_id])), rel=1e-4)


@pytest.mark.parametrize("name", ["op2_warc", "op8_quality", "op9_decontamination"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(tuple(map(str, (r[c] for c in order))) for r in got.collect()) == sorted(tuple(map(str, (r[want.columns.index(c)] for c in order))) for r in want.fetchall())


def test_quality_edges(spark):
    got = quality.quality(docs(spark), host=F.col("source")).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == by[0].word_chars == 0 and by[0].base_failed and not by[0].kept
    assert by[16].n_repeat_words == 4000 and by[18].n_repeat_words == 15
    assert quality.quality(docs(spark, []), host=F.col("source")).count() == 0
    bad = [(i, "short", "en", "bad") for i in range(200)] + [(1000, prose(random.Random(1), 50), "en", "bad"), (1001, prose(random.Random(2), 50), "en", "one")] + [(2000 + i, prose(random.Random(i), 50), "en", f"h{i % 4}") for i in range(400)]
    by = {r.doc_id: r for r in quality.quality(docs(spark, bad), host=F.col("source")).collect()}
    assert by[1000].host_failed and not by[1000].kept and by[1001].kept


def test_short_items_and_edges_of_contamination(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, "..."), (4, prose(random.Random(4), 20)), (5, "the the the the the the the the the the the the the")], "item_id long, text string")
    many = [*[r[:2] for r in rows()], (50, "ONE, two three! and ONE two. Three one"), (51, "x " * 30 + prose(random.Random(4), 20)[:-3])]
    got = {r.doc_id: r for r in contamination.contamination(docs(spark, many), items).collect() if r.doc_id is not None}
    assert (got[50].n_hit, got[50].items) == (6, [1]) and (got[4].n_hit, got[4].items) == (3, [1])
    assert got[18].items == [5] and got[18].n_hit == 15 and got[51].items == [4]
    assert got[0].n_words == 0 and got[1].n_hit == 0
    assert contamination.contamination(docs(spark, []), items).count() == 0
    assert contamination.contamination(docs(spark), items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_obfuscated_words_are_restored_and_scored(spark):
    rng = random.Random(9)
    clean = [prose(rng, 40) for _ in range(120)]
    toxic = [t + " you idiot and pathetic clown" for t in clean[:40]]
    texts = [(i, t) for i, t in enumerate([*clean, *toxic])]
    labels = spark.createDataFrame([(i, int(i >= 120)) for i, _ in texts], "doc_id long, toxic int")
    table = docs(spark, texts)
    lm = toxicity.character_model(table)
    reader = toxicity.Reader(lm)
    assert [reader.word(w) for w in ("1d10t!!", "id.i.ot", "idiiiiot", "iddiot", "p@thetic", "river", "42")] == ["idiot", "idiot", "idiot", "idiot", "pathetic", "river", ""]
    for typed, meant in {"y o u i d i o t": "you idiot", "y 0 u 1 d 1 o t": "you idiot", "p a t h e t i c c l o w n": "pathetic clown", "the id iot walk": "idiot", "the cl 0wn walk": "clown"}.items():
        assert set(meant.split()) <= set(reader.words(typed)), (typed, reader.words(typed))
    weights = toxicity.fit(table, labels, lm)
    new = [(900, "the river 1d10t walk cl0wn p@th3tic light"), (901, "the river i d i o t walk c-l-o-w-n light pathetiiiic"), (902, clean[5]), (903, None), (904, "")]
    got = {r.doc_id: r.score for r in toxicity.scores(docs(spark, new), lm, weights).collect()}
    assert got[900] >= 0.7 and got[901] >= 0.7 and max(got[902], got[903], got[904]) < 0.5
    assert toxicity.scores(docs(spark), lm, weights).count() == len(rows())
    assert toxicity.scores(docs(spark, []), lm, weights).count() == 0
    assert toxicity.fit(docs(spark, []), labels, lm) == {"": -math.inf}


def test_lattice_against_all_paths(spark):
    lm = toxicity.character_model(docs(spark, [(i, prose(random.Random(i), 60)) for i in range(20)]))
    reader = toxicity.Reader(lm)
    E, L = toxicity.EDGE, toxicity.LETTERS
    logp = lm.logp.reshape(L, L, L, L)
    rng = random.Random(12)
    for _ in range(60):
        token = "".join(rng.choice("aoe10@s. l-") for _ in range(rng.randint(1, 6))).strip()
        paths = [(0.0, "")]
        for ch in token:
            grown = []
            for cost, text in paths:
                for x, c in ([(ch, 0.0)] if ch.isalpha() else []) + [(x, toxicity.SWAP) for x in toxicity.STANDS.get(ch, "")]:
                    grown.append((cost - c, text + x))
                    if text and text[-1] == x:
                        grown.append((cost - toxicity.AGAIN, text))
                if ch in toxicity.SEPARATORS or ch == " ":
                    grown.append((cost - toxicity.PUT, text))
                if ch == " " and text and text[-1] != " ":
                    grown.append((cost, text + " "))
            paths = grown

        def worth(path):
            k = [E, E, E, *[E if x == " " else toxicity.place(x) for x in path[1]]]
            k += [] if k[-1] == E else [E]
            return path[0] + sum(logp[tuple(k[i : i + 4])] for i in range(len(k) - 3))

        best = max(map(worth, paths))
        got = reader.decode(token)
        assert max(worth(p) for p in paths if p[1] == got) == pytest.approx(best), token


def test_pipeline_stages(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in got]
    assert 0 < len(ids) <= start.count() and len(ids) == len(set(ids))
    edge = docs(spark).withColumnsRenamed({"key": "score", "hash": "accepted", "fp": "lang_pred", "words": "n_removed", "n": "content"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, SF)
        assert out.columns == edge.columns and 0 < out.count() == out.where("score = 'clash' AND accepted = 'clash' AND lang_pred = 'clash' AND n_removed = 'clash' AND content = 'clash' OR score IS NULL").count() <= len(rows())
        assert stage(spark, edge.limit(0), SF).count() == 0
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    judged = corpus_pipeline.decontaminate(spark, docs(spark, [(None, item), (None, "a clean text"), (7, item), (7, "clean too")]), SF)
    assert sorted(r.text for r in judged.collect()) == ["a clean text", "clean too"]
    kept = corpus_pipeline.drop_near_duplicates(spark, edge, SF)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (7, 11, 12)) == [7]


def test_pipeline_near_duplicates_are_those_of_similar_shingles(spark):
    rng = random.Random(5)
    line = " ".join(f"l{i}" for i in range(12))
    texts = []
    for k in range(60):  # pairs about a similarity of 0.8, and chains of three
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for step in range(3 if k % 3 == 0 else 2):
            texts.append((len(texts), " ".join(words)))
            for _ in range(rng.choice([1, 3, 4, 5, 8])):
                words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    # mostly one repeated line: equal votes, unlike shingles
    texts += [(500 + k, " ".join([line] * 40 + [f"u{k}x{i}" for i in range(60)])) for k in range(4)]
    texts += [(600, "one id with a first text"), (600, "and quite another second text of that id"), (601, "a b c d e f"), (601, "A b c d e f")]
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split()) for _, t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = sorted(min(texts[i][0] for i in range(len(texts)) if root[i] == r) for r in set(root))
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), SF).collect()
    assert sorted(r.doc_id for r in got) == want and {500, 501, 502, 503} <= set(want) and want.count(600) == 2
    sims = simhash.alike([np.arange(100, dtype=np.uint64), np.arange(11, 100, dtype=np.uint64), np.arange(30, 130, dtype=np.uint64)], [-1] * 3, 0.8)
    assert sims == [(1, 0)]


def test_bands_meet_at_similarity_of_0_8():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(500):
        x = rng.integers(0, 1 << 63, 220).astype(np.uint64)
        a, b = np.unique(x[:200]), np.unique(np.concatenate([x[:178], x[200:222]]))  # 178 of 220: 0.809
        met += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert met >= 490


def test_grams_and_first_steps_of_a_suffix_tree():
    import numpy as np
    from transitlake.llm import suffixtree

    b = np.random.default_rng(1).integers(97, 103, 3000).astype(np.uint8)
    for depth in (1, 6):
        want = np.zeros(len(b), np.int64)
        for d in range(depth + 1):
            want[d:] |= b[: len(b) - d].astype(np.int64) << (8 * d)
        assert np.array_equal(suffixtree.windows(b, depth), want)
    k, n = np.unique(want, return_counts=True)
    parts = [np.unique(x, return_counts=True) for x in (want[:1000], want[1000:])]
    got = suffixtree.summed(*parts[0], *parts[1])
    assert np.array_equal(got[0], k) and np.array_equal(got[1], n)
    child = np.array([[1, -1, 2], [-1, 3, -1], [-1, -1, -1], [4, -1, -1], [-1, -1, -1]], np.int32)
    near, taken = suffixtree.first_steps(child, 4)
    assert taken == 4
    for code in range(3**4):
        node, ended = 0, False
        for d in range(4):
            step = child[node, code // 3**d % 3]
            ended = ended or step < 0
            node = node if ended else step
        assert near[code] == (~node if ended else node)
