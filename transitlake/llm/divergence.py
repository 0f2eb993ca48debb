"""How the sources of each language differ in their use of words.

Duplicate-text collapse: rows of one language and text meet as one text with a multiplicity for each
source, the text is cut into terms once, and its terms' document frequencies and counts are added
with those multiplicities. A map task sends each text it meets once, and later rows of it as counts;
a text's rows are told apart by language and a 128-bit hash. Pairs of sources are then summed from
the terms that occur in either (`pair_values`), not over the vocabulary.

A null text, language or source is read as ''. An empty table gives no rows; a language none of
whose terms reaches `least` documents has pairs of value 0 and no terms. Repeated rows count each.
Columns other than text, lang and source are not read, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import importable, stored

#: Bytes as terms see them: A-Z in lower case, ASCII that is no letter as space.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Texts (or groups' terms) that a task remembers before it hands on what it has counted.
MEMO, TERMS = 200_000, 400_000
#: Bytes of a text that are cut into terms at a time.
SLICE = 4 << 20
SCALE, PRIOR = 1_000_000_000, 5
ROWS = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("text", pa.string())])
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("n", pa.int64())])


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as (lang, key, source, n, text): a text the first time the task meets it, later rows of it as counts without a text."""
    sent: set[tuple] = set()
    more: Counter = Counter()

    def rest() -> Iterator[pa.RecordBatch]:
        if more:
            yield pa.RecordBatch.from_pylist([{"lang": la, "key": k, "source": s, "n": n, "text": None} for (la, k, s), n in more.items()], ROWS)
        more.clear()
        sent.clear()

    for batch in batches:
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        rows: list[tuple] = []
        for la, s, text in zip(langs, sources, texts):
            key = xxhash.xxh3_128_digest(text)
            if (la, key) in sent:
                more[la, key, s] += 1
            else:
                sent.add((la, key))
                rows.append((la, key, s, 1, text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)
        if len(sent) + len(more) > MEMO:
            yield from rest()
    yield from rest()


def term_counts(text: str) -> Counter:
    """How often each term occurs, by slices of a long text that end between terms."""
    data = text.encode().translate(FOLD)
    if len(data) <= SLICE:
        return Counter(data.split())
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, key), the one with a text first, as (lang, source, term, df, n), partly summed."""
    df: dict[tuple, Counter] = {}
    n: dict[tuple, Counter] = {}
    last, terms, held = None, Counter(), 0

    def summed() -> Iterator[pa.RecordBatch]:
        for (la, s), c in n.items():
            words = list(c)
            cols = [pa.array([la] * len(words), pa.string()), pa.array([s] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([df[la, s][w] for w in words], pa.int64()), pa.array(list(c.values()), pa.int64())]
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in cols], schema=COUNTS)
        df.clear()
        n.clear()

    for batch in batches:
        for la, key, s, times, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (la, key) != last:
                last, terms = (la, key), term_counts(text)
            if (la, s) not in n:
                n[la, s], df[la, s] = Counter(), Counter()
            a, b = n[la, s], df[la, s]
            before = len(a)
            for w, c in terms.items():
                a[w] += c * times
                b[w] += times
            held += len(a) - before
            if held > TERMS:
                yield from summed()
                held = 0
    yield from summed()


def kept_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, n): how often each term of at least `least` documents of its language occurs in each source that has it."""
    importable(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = read.mapInArrow(collapse, "lang string, key binary, source string, n long, text string")
    rows = rows.repartition("lang", "key").sortWithinPartitions("lang", "key", F.col("text").isNull())
    found = rows.mapInArrow(weigh, "lang string, source string, term string, df long, n long").repartition("lang", "term")
    found = found.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return found.withColumn("all", F.sum("df").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= least).select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", above, (total + F.lit(PRIOR) * terms).cast("decimal(20,0)")) + F.lit(1)


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, terms, total, n_terms, floor) of every group that occurs: its language's terms, its count over them, how many of them it has, and the share of one it lacks (null without terms)."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    out = groups.join(terms, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["terms", "total", "n_terms"])
    return out.withColumn("floor", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum over all terms of how far the shares of two sources are apart.

    A term that only one source has differs from the other's floor; a term that neither has, by the
    difference of their floors, times how many such terms there are. So the sum needs, for each
    source, its number and sum of shares, the shares that lie below another's floor, and, for each
    pair, a correction for terms that both have.
    """
    both = shares.alias("a").join(shares.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    gap = F.abs(F.col("a.p") - F.col("b.p")) - F.abs(F.col("a.p") - F.col("b.floor")) - F.abs(F.col("a.floor") - F.col("b.p")) + F.abs(F.col("a.floor") - F.col("b.floor"))
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("low"), F.col("b.source").alias("high")).agg(F.sum(gap).alias("common"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    below = levels.alias("h").join(groups.alias("g"), (F.col("h.lang") == F.col("g.lang")) & (F.col("h.source") != F.col("g.source")) & (F.col("h.p") < F.col("g.floor")))
    below = below.groupBy(F.col("h.lang").alias("lang"), F.col("h.source").alias("source"), F.col("g.source").alias("item")).agg(F.sum(F.col("m") * (F.col("g.floor") - F.col("h.p"))).alias("below"))
    summed = groups.join(shares.groupBy("lang", "source").agg(F.sum("p").alias("p")), ["lang", "source"], "left").na.fill(0, ["p"])
    pairs = summed.alias("a").join(summed.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    alone = F.col("a.p") - F.col("a.n_terms") * F.col("b.floor") + F.col("b.p") - F.col("b.n_terms") * F.col("a.floor")
    neither = (F.col("a.terms") - F.col("a.n_terms") - F.col("b.n_terms")) * F.abs(F.col("a.floor") - F.col("b.floor"))
    pairs = pairs.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), (alone + neither).alias("base"))
    pairs = pairs.withColumns({"low": F.least("source", "item"), "high": F.greatest("source", "item")})
    pairs = pairs.join(both, ["lang", "low", "high"], "left").join(below, ["lang", "source", "item"], "left")
    back = below.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("below").alias("back"))
    pairs = pairs.join(back, ["lang", "source", "item"], "left")
    return pairs.select("lang", "source", "item", F.coalesce(sum((2 * F.coalesce(c, F.lit(0)) for c in (F.col("below"), F.col("back"))), F.col("base") + F.coalesce("common", F.lit(0))), F.lit(0)).alias("value"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source is (`pair`), and the `top` terms that a source has more of than its language (`term`)."""
    kept = stored(kept_terms(docs, least), "terms")
    groups = stored(sizes(docs, kept), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "floor", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    shares = stored(shares, "shares")
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("total"))
    usual = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(langs, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    terms = shares.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pair_values(shares, groups).withColumn("rank", F.row_number().over(order))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
