"""Quality rules by document and by host, in DataFrame operations only.

Each rule marks documents. Its failures are summed by host (pre-aggregated, so a hot host costs no
more than another), and each host's rate is shrunk towards the rate of all by a beta prior fitted to
the hosts' rates by moments: a host of few documents says little by itself. A host fails if any
shrunk rate is over `most`; its verdict is joined back to its documents.

A null text has no words and fails the length rule. A null host is the host "". Repeated rows and
null ids give a row each, and count each. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_BREAK, stored

SYMBOLS = "[#*$%&|<>]"
SPAN = 5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string") if host is not None else F.lit(""), F.lit("")).alias("host"), text.alias("text"))
    df = df.withColumns({"words": F.filter(F.split("text", WORD_BREAK), lambda x: x != ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    words = F.col("words")
    df = df.withColumns({"n_words": F.size("words"), "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "word_chars": F.length(F.array_join("words", "")), "n_symbols": F.regexp_count("text", F.lit(SYMBOLS))}).drop("text", "lines")
    grams = F.when(F.col("n_words") > SPAN, F.transform(F.sequence(F.lit(0), F.col("n_words") - SPAN), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SPAN)])))
    df = df.withColumn("grams", grams).drop("words")
    # only texts in which a window comes twice are sorted
    order = F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("order", order).drop("grams")
    o = F.col("order")
    like = lambda x, at: F.coalesce(F.get(o, at)["g"] == x["g"], F.lit(False))
    twice = F.filter("order", lambda x, i: like(x, i + 1) | like(x, i - 1))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((p + SPAN).alias("end"), (a["n"] + p + SPAN - F.greatest(a["end"], p)).alias("n")))["n"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return df.select("id", "host", *[F.col(x).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def rules() -> dict[str, Column]:
    """Whether a document fails each rule."""
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("word_chars"),
        "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, rule, n, failed, rate, shrunk) for each host and rule."""
    marks = rules()
    by = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(x.cast("long")).alias(k) for k, x in marks.items()])
    long = by.select("host", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in marks])).alias("r")).select("host", "n", "r.rule", "r.failed")
    long = long.withColumn("rate", F.col("failed") / F.col("n"))
    prior = long.groupBy("rule").agg((F.sum("failed") / F.sum("n")).alias("mean"), F.var_pop("rate").alias("var"))
    spread = F.col("mean") * (1 - F.col("mean"))
    # no spread between hosts: as strong as a thousand documents; more than a beta can have: as weak as one
    strength = F.when(F.col("var") <= spread / 1001, 1000.0).otherwise(F.greatest(F.lit(1.0), F.try_divide(spread, F.col("var")) - 1))
    prior = prior.select("rule", "mean", strength.alias("strength"))
    return long.join(prior, "rule").withColumn("shrunk", (F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, most: float = 0.5) -> DataFrame:
    """(id, the measures, base_failed, host_failed, kept)."""
    measured = stored(measures(docs, id_col, text_col, host), "measures")
    bad = host_rates(measured).groupBy("host").agg((F.max("shrunk") > most).alias("host_failed"))
    marks = rules()
    out = measured.join(bad, "host").withColumn("base_failed", marks["short"] | marks["repeats"])
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
