"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprint keeps the least k-word hash of every `window - k + 1` consecutive ones, so two
texts that share `window` words share a fingerprint hash, whatever surrounds them. Fingerprints of
documents and of benchmark items are joined to find documents that may share a window; for those
alone, all windows are joined with the items' windows and compared as text, and the hits are
extended to the union of the words they cover.

Items of fewer words than a window are one window of their own length: all word runs of the lengths
that occur (under `window` different ones) are hashed too. Null texts and texts without words have
no windows. Repeated rows and null ids give a row each; rows of one id and different texts are
judged apart. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, stored

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK)
    return F.filter(words, lambda x: x != "")


def runs(words: Column, size: Column, n: int, value) -> Column:
    """value(place) of each run of n words."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), value)).otherwise(F.array().cast("array<long>"))


def gram(words: Column, n: int):
    return lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)])


def fingerprint(df: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """df (with words and n_words) with `prints`: least hashes of k words, and all runs of the short lengths."""
    words, size, step = F.col("words"), F.col("n_words"), window - k + 1
    df = df.withColumn("grams", F.when(size >= window, runs(words, size, k, gram(words, k))).otherwise(F.array().cast("array<long>")))
    grams = F.col("grams")
    least = runs(grams, F.size("grams"), step, lambda i: F.least(*[F.get(grams, i + j) for j in range(step)]))
    kept = F.array_distinct(least)
    for n in short:
        kept = F.array_union(kept, runs(words, size, n, gram(words, n)))
    return df.withColumn("prints", kept).drop("grams")


def windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df exploded to (place, length, run): every run of each length, as text."""
    words, size = F.col("words"), F.col("n_words")

    def of(n: int) -> Column:
        def one(i: Column) -> Column:
            return F.struct(i.alias("place"), F.lit(n).alias("length"), F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]).alias("run"))

        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), one)).otherwise(F.array().cast("array<struct<place:int,length:int,run:string>>"))

    each = [of(n) for n in lengths]
    return df.withColumn("w", F.explode(F.concat(*each))).select(*[c for c in df.columns if c not in ("words", "n_words")], "w.place", "w.length", "w.run")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, hash_col: str | None = None) -> DataFrame:
    """(id, n_words, n_hit, items): words, words inside any item's window, and the items with windows in the text; under `hash_col`, if given, the text's 64-bit hash, which tells rows of one id apart."""
    items = benchmark.select(F.col(item_col).alias("item"), item_words(F.col(item_text)).alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    items = stored(items, "items")
    short = [r[0] for r in items.where(F.col("n_words") < window).select("n_words").distinct().orderBy("n_words").collect()]  # under `window` numbers
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = texts.select("id", F.xxhash64("text").alias("same"), item_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    prints = stored(fingerprint(marked, window, k, short).drop("words"), "prints")
    long = fingerprint(items.where(F.col("n_words") >= window), window, k, []).select(F.explode("prints").alias("p"))
    for n in short:
        long = long.unionByName(items.where(F.col("n_words") == n).select(gram(F.col("words"), n)(F.lit(0)).alias("p")))
    wanted = stored(long.distinct(), "wanted")
    found = prints.select("id", "same", F.explode("prints").alias("p")).join(wanted, "p", "left_semi").select("id", "same").distinct()
    found = stored(found.select(F.col("id").alias("f_id"), F.col("same").alias("f_same")), "found")

    again = texts.withColumn("same", F.xxhash64("text")).join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("same") == F.col("f_same")), "left_semi")
    again = again.select("id", "same", item_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    lengths = [*short, window]
    theirs = windows(items.where(F.col("n_words") >= window), [window])
    for n in short:
        theirs = theirs.unionByName(windows(items.where(F.col("n_words") == n), [n]))
    theirs = stored(theirs.select("item", "length", "run").distinct(), "windows")
    hits = windows(again, lengths).join(theirs, ["length", "run"]).select("id", "same", "place", "length", "item")
    # both lists are bounded by the text's length and by the number of items
    hits = hits.groupBy("id", "same").agg(F.array_sort(F.collect_set(F.struct("place", "length"))).alias("spans"), F.collect_set("item").alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def extend(a: Column, s: Column) -> Column:
        end = s["place"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["hit"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["place"]))).alias("hit"))

    hits = hits.select(F.col("id").alias("h_id"), F.col("same").alias("h_same"), F.aggregate("spans", start, extend)["hit"].alias("n_hit"), "items")
    hits = stored(hits, "hits")
    out = prints.select("id", "same", "n_words").join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("same") == F.col("h_same")), "left")
    return out.select(F.col("id").alias(id_col), *([F.col("same").alias(hash_col)] if hash_col else []), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>")).alias("items"))


def contaminated() -> Column:
    """The contract's rule: any hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
