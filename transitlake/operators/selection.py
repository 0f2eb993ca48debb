"""Exact medians and quantiles of whole columns without a task that holds one.

Each pass counts a column's values in equal bins between two bounds and keeps the bin that holds the
wanted rank, until few enough values are left to be sorted; values that are all the same end it at
once. The driver sees the bins' counts, never values but the last few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C


def quantiles(df: DataFrame, columns: list[str], share: float = 0.5, by: str | None = None, bins: int = 1024, few: int = 1 << 12) -> dict:
    """{column: value}, or {(group, column): value} with `by` (a column of few values): between the two values nearest to `share` of the way, as percentile() has it; None without a number. NaN and infinities count as nulls."""
    parts = [F.struct(F.lit(i).alias("i"), C.finite(F.col(x)).alias("v")) for i, x in enumerate(columns)]
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    x = df.select(group.alias("g"), F.explode(F.array(*parts)).alias("x")).select("g", "x.i", "x.v").where("v IS NOT NULL")
    wanted, out = [], {}
    for r in x.groupBy("g", "i").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # one row a column (and group)
        place = share * (r.n - 1)
        for rank in {int(place), min(int(place) + 1, r.n - 1)}:
            wanted.append({"g": r.g, "i": r.i, "rank": rank, "before": 0, "n": r.n, "low": r.low, "high": r.high})
        out[r.g, r.i] = (int(place), min(int(place) + 1, r.n - 1), place - int(place))
    found: dict[tuple, float] = {}
    spark, schema = df.sparkSession, "t int, g string, i int, low double, high double"

    def between(open_: list[dict]) -> DataFrame:
        """The values of each open interval."""
        bounds = spark.createDataFrame([(k, w["g"], w["i"], w["low"], w["high"]) for k, w in enumerate(open_)], schema)
        bounds = bounds.withColumnsRenamed({"g": "_g", "i": "_i"})
        return x.join(F.broadcast(bounds), F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")) & F.col("v").between(F.col("low"), F.col("high")))  # two rows a column

    while wanted:
        for w in [w for w in wanted if w["low"] == w["high"]]:
            found[w["g"], w["i"], w["rank"]] = w["low"]
        wanted = [w for w in wanted if w["low"] < w["high"]]
        last = [w for w in wanted if w["n"] <= few]
        if last:
            for r in between(last).groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():  # `few` values at most
                w = last[r.t]
                found[w["g"], w["i"], w["rank"]] = r.v[w["rank"] - w["before"]]
        wanted = [w for w in wanted if w["n"] > few]
        if not wanted:
            break
        span = F.col("high") / 2 - F.col("low") / 2  # the lowest value is in the first bin and the highest in the last, so an interval always shrinks
        place = F.when(span > 0, F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / F.when(span > 0, span) * bins), F.lit(bins - 1))).otherwise((F.col("v") == F.col("high")).cast("long"))
        counts: dict[int, list] = {}
        for r in between(wanted).groupBy("t", place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # `bins` rows an interval
            counts.setdefault(r.t, []).append((r.low, r.high, r.n))
        for t, w in enumerate(wanted):
            for low, high, n in sorted(counts[t]):
                if w["before"] + n > w["rank"]:
                    w.update(low=low, high=high, n=n)
                    break
                w["before"] += n
    done = {k: found[(*k, a)] * (1 - f) + found[(*k, b)] * f for k, (a, b, f) in out.items()}
    if by:
        return {(g, columns[i]): v for (g, i), v in done.items()}
    return {c: done.get((None, i)) for i, c in enumerate(columns)}
