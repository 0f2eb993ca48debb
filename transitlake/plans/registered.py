"""Registered queries of the library, bound to the tables under test, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog, labels, search, series, validation
from ..sources import tables

K = series.K
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = """obs AS (SELECT CAST(floor(user_id / 15) AS BIGINT) AS tic_id, 1 AS sector, event_id AS cadence, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS time,
  100000 + value AS pdcsap_flux, 100000 + 1.01::DOUBLE * value AS sap_flux, CASE event_type WHEN 'error' THEN 1 << CAST(event_id % 15 AS INT) ELSE 0 END AS quality,
  100 + (event_id % 7) * 0.001::DOUBLE AS centroid_col, 100 + (event_id % 11) * 0.001::DOUBLE AS centroid_row FROM events)"""
INJ = OBS + """,
inj0 AS (SELECT *, 1.5::DOUBLE + (tic_id % 10) * 0.35::DOUBLE AS period, 0.4::DOUBLE AS t0, 0.2::DOUBLE AS duration FROM obs),
inj1 AS (SELECT *, time - t0 + period / 2 AS u FROM inj0), inj2 AS (SELECT *, u - floor(u / period) * period - period / 2 AS ph FROM inj1),
inj3 AS (SELECT *, CASE WHEN abs(ph) < 0.1::DOUBLE THEN pdcsap_flux * (1 - 0.003::DOUBLE) ELSE pdcsap_flux END AS flux, floor((time - t0) / period + 0.5::DOUBLE) AS event FROM inj2),
s AS (SELECT *, flux / median(flux) OVER (PARTITION BY tic_id) AS x, abs(ph) < 0.1::DOUBLE AS i, abs(ph) < 0.5::DOUBLE AS near FROM inj3)"""

CAND = {
    "tic_id": "o_custkey", "sector": "1", "candidate_id": "o_orderkey", "period_days": "0.5e0 + (o_orderkey % 97) / 8e0", "duration_days": "0.05e0 + (o_orderkey % 13) / 1e2", "depth_ppm": "(o_orderkey % 251) * 1e2",
    "depth_err_ppm": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 29) * 5e0 END", "snr": "qty / (2.5e0 * n)", "sde": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 4 + (o_orderkey % 31) / 3e0 END", "n_transits": "n",
    "secondary_sigma": "(qty % 80) / 1e1", "secondary_ratio": "(o_orderkey % 9) / 5e1", "odd_even_sigma": "(o_orderkey % 53) / 1e1", "centroid_sigma": "(o_custkey % 61) / 1e1", "crowding": "(o_orderkey % 11) / 2e1",
    "data_quality": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 10) / 9e0 END", "red_noise": "(o_orderkey % 17) / 4e1", "label_text": "o_orderpriority", "state": "o_orderstatus",
    "radius_ratio": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey % 23) / 1e2 END", "v_shape_score": "(o_orderkey % 19) / 2e1", "corrected_depth_ppm": "(o_orderkey % 251) * 1e2 * (1 + (o_custkey % 3))", "status": "CASE o_orderstatus WHEN 'F' THEN 'STRONG_DETECTION' WHEN 'O' THEN 'NO_DETECTION' ELSE 'WEAK_DETECTION' END",
    **{f"p_{i}": f"((o_orderkey * {i + 3} + o_custkey) % 23) / 23e0" for i in range(7)},
}
CAND_SQL = "base AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, qty, n FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey), cand AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CAND.items()) + " FROM base)"


def register(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a dip, normalised, and the ephemeris in columns."""
    obs = tables.observations(spark, sf_dir)
    s = tables.inject(obs, tables.true_period(F.col("tic_id")))
    return series.normalise(s).withColumns({"period": F.col("true_period"), "t0": F.col("true_t0"), "duration": F.col("true_duration")})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as a candidate table."""
    lines = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("qty"), F.count("*").alias("n"))
    return tables.read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(*[f"{v} AS {k}" for k, v in CAND.items()])


@register(f"WITH {OBS} SELECT tic_id, 1 AS sector, 1 << b AS bit, count(*) AS n FROM obs, range(15) t(b) WHERE quality & (1 << b) <> 0 GROUP BY ALL")
def quality_flag_counts(spark, sf_dir):
    return rounded(series.flag_counts(tables.observations(spark, sf_dir)))


@register(f"WITH {OBS}, m AS (SELECT tic_id, count(CASE WHEN pdcsap_flux > 0 THEN 1 END) / count(*) AS share, median(CASE WHEN pdcsap_flux > 0 THEN pdcsap_flux END) AS med, mad(CASE WHEN pdcsap_flux > 0 THEN pdcsap_flux END) AS d FROM obs GROUP BY tic_id) SELECT tic_id, 1 AS sector, CASE WHEN share >= 0.5 AND med > 0 AND d > 0 THEN 'PDCSAP' ELSE 'SAP' END AS source, CASE WHEN share >= 0.5 AND med > 0 AND d > 0 THEN NULL ELSE 'PDCSAP_UNAVAILABLE_OR_INVALID_USED_SAP' END AS warning FROM m")
def flux_choice(spark, sf_dir):
    return rounded(series.choose_flux(tables.observations(spark, sf_dir)))


@register(f"""WITH {OBS}, n AS (SELECT *, pdcsap_flux / median(pdcsap_flux) OVER (PARTITION BY tic_id) AS x FROM obs), k AS (SELECT * FROM n WHERE quality & 32766 & {series.MASKS['conservative']} = 0),
m AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sig FROM k GROUP BY tic_id) SELECT tic_id, 1 AS sector, cadence, round(x, 6) AS flux_norm, x > med + 7 * sig AS high_outlier, x < med - 15 * sig AS low_outlier FROM k JOIN m USING (tic_id)""")
def clean_series(spark, sf_dir):
    return rounded(series.clean(tables.observations(spark, sf_dir)).select(*K, "cadence", "flux_norm", "high_outlier", "low_outlier"))


@register(f"""WITH {OBS}, d AS (SELECT tic_id, time, time - lag(time) OVER (PARTITION BY tic_id ORDER BY time) AS dt FROM obs), m AS (SELECT tic_id, max(time) - min(time) AS baseline, median(dt) AS md, max(dt) AS largest_gap FROM d GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(any_value(baseline), 6) AS baseline, round(any_value(md), 6) AS median_dt_days, round(any_value(largest_gap), 6) AS largest_gap, CAST(sum(CASE WHEN dt > 5 * md THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps FROM d JOIN m USING (tic_id) GROUP BY tic_id""")
def gap_metrics(spark, sf_dir):
    return rounded(series.gap_metrics(tables.observations(spark, sf_dir)))


@register(f"""WITH {OBS}, n AS (SELECT *, pdcsap_flux / median(pdcsap_flux) OVER (PARTITION BY tic_id) AS x FROM obs), k AS (SELECT * FROM n WHERE quality & {series.MASKS['conservative']} = 0),
m AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sig FROM k GROUP BY tic_id), f AS (SELECT k.*, x > med + 7 * sig AS h, x < med - 15 * sig AS l FROM k JOIN m USING (tic_id)),
a AS (SELECT tic_id, count(*) AS n_kept, CAST(sum(h::INT) AS BIGINT) AS n_high, CAST(sum(l::INT) AS BIGINT) AS n_low FROM f GROUP BY tic_id), g AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sig, count(*) AS n_final FROM f WHERE NOT h GROUP BY tic_id),
r AS (SELECT tic_id, sqrt(avg((x - med) ^ 2)) * 1e6 AS rms FROM f JOIN g USING (tic_id) WHERE NOT h GROUP BY tic_id), w AS (SELECT tic_id, count(*) AS n_raw, count(CASE WHEN pdcsap_flux > 0 THEN 1 END) AS n_finite, median(pdcsap_flux) AS mf FROM obs GROUP BY tic_id)
SELECT tic_id, 1 AS sector, n_raw, n_finite, round(mf, 4) AS median_flux, n_kept, n_high, n_low, n_final, round(rms, 4) AS rms_ppm, round(sig * 1e6, 4) AS noise_ppm, round(1 - n_final / n_raw, 4) AS removed_fraction, CASE WHEN n_final < 500 THEN 'TOO_FEW_CLEAN_POINTS' ELSE 'OK' END AS status FROM w JOIN a USING (tic_id) JOIN g USING (tic_id) JOIN r USING (tic_id)""")
def quality_summary(spark, sf_dir):
    return rounded(series.quality_summary(tables.observations(spark, sf_dir)), 4)


TREND = """d AS (SELECT *, time - lag(time) OVER (PARTITION BY tic_id ORDER BY time) AS dt FROM s), m AS (SELECT tic_id, greatest(5, CAST(round_even(1 / median(dt), 0) AS INT)) AS w FROM d GROUP BY tic_id), q AS (SELECT tic_id, w + (w + 1) % 2 AS w FROM m),
o AS (SELECT s.*, w, row_number() OVER (PARTITION BY tic_id ORDER BY time) AS rn FROM s JOIN q USING (tic_id)),
t AS (SELECT a.tic_id, a.cadence, any_value(a.x) AS x, median(b.x) AS trend FROM o a JOIN o b ON a.tic_id = b.tic_id AND b.rn BETWEEN a.rn - a.w // 2 AND a.rn + a.w // 2 GROUP BY a.tic_id, a.cadence)"""


@register(f"WITH {INJ}, {TREND} SELECT tic_id, 1 AS sector, cadence, round(trend, 6) AS trend, round((x / trend) / median(x / trend) OVER (PARTITION BY tic_id), 6) AS flux_detrended FROM t")
def rolling_detrend(spark, sf_dir):
    return rounded(series.detrend(injected(spark, sf_dir)).select(*K, "cadence", "trend", "flux_detrended"))


@register(f"""WITH {INJ}, v AS (SELECT tic_id, cadence, time, CASE WHEN cadence % 4 = 0 THEN NULL ELSE x END AS v FROM s), g AS (SELECT *, last_value(CASE WHEN v IS NULL THEN NULL ELSE time END IGNORE NULLS) OVER a AS t1, last_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NULL THEN NULL ELSE time END IGNORE NULLS) OVER b AS t2, first_value(v IGNORE NULLS) OVER b AS v2 FROM v
WINDOW a AS (PARTITION BY tic_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY tic_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT tic_id, cadence, round(CASE WHEN v1 IS NULL THEN v2 WHEN v2 IS NULL OR t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * (time - t1) / (t2 - t1) END, 6) AS v FROM g""")
def interpolation(spark, sf_dir):
    s = injected(spark, sf_dir).withColumn("v", F.when(F.col("cadence") % 4 == 0, None).otherwise(F.col("flux_norm")))
    return rounded(series.interpolate(s, "v").select("tic_id", "cadence", "v"))


@register(f"WITH {INJ}, e AS (SELECT tic_id, event, count(*) AS c FROM s WHERE i GROUP BY tic_id, event) SELECT tic_id, 1 AS sector, count(*) AS n_transits, CAST(sum((c >= 3)::INT) AS BIGINT) AS n_full FROM e GROUP BY tic_id")
def transit_counts(spark, sf_dir):
    return rounded(series.transit_counts(injected(spark, sf_dir)))


@register(f"""WITH {INJ}, a AS (SELECT tic_id, count(CASE WHEN i THEN 1 END) AS n_in, count(CASE WHEN NOT i THEN 1 END) AS n_out, count(CASE WHEN near AND NOT i THEN 1 END) AS n_near, median(CASE WHEN i THEN x END) AS mi, median(CASE WHEN NOT i THEN x END) AS mo, mad(CASE WHEN NOT i THEN x END) * 1.4826 AS sg, mad(CASE WHEN near AND NOT i THEN x END) * 1.4826 AS sl FROM s GROUP BY tic_id)
SELECT tic_id, 1 AS sector, n_in, round(CASE WHEN n_in >= 3 AND n_out >= 20 THEN mo - mi END, 5) AS depth, round(CASE WHEN n_in >= 3 AND n_out >= 20 THEN (mo - mi) / sg * sqrt(n_in) END, 5) AS snr, round(CASE WHEN n_in >= 3 AND n_out >= 20 THEN (mo - mi) / CASE WHEN n_near >= 20 THEN sl ELSE sg END * sqrt(n_in) END, 5) AS local_snr FROM a""")
def depth_snr(spark, sf_dir):
    return rounded(series.depth_snr(injected(spark, sf_dir), "flux_norm"), 5)


EVENTS = """ev AS (SELECT tic_id, event, count(CASE WHEN i THEN 1 END) AS n_in, count(CASE WHEN NOT i THEN 1 END) AS n_out, median(CASE WHEN i THEN x END) AS mi, median(CASE WHEN NOT i THEN x END) AS mo, mad(CASE WHEN NOT i THEN x END) * 1.4826 AS noise FROM s WHERE near GROUP BY tic_id, event),
ed AS (SELECT tic_id, event, n_in, n_out, CASE WHEN n_in >= 3 AND n_out >= 6 THEN mo - mi END AS depth, CASE WHEN n_in >= 3 AND n_out >= 6 THEN noise / sqrt(n_in) END AS err, CASE WHEN n_in >= 3 AND n_out >= 10 THEN 'ok' WHEN n_in >= 3 AND n_out >= 6 THEN 'partial' ELSE 'partial_or_sparse' END AS coverage FROM ev)"""


@register(f"WITH {INJ}, {EVENTS} SELECT tic_id, 1 AS sector, CAST(event AS BIGINT) AS event, n_in, n_out, round(depth, 6) AS depth, round(err, 6) AS err, coverage FROM ed")
def event_depths(spark, sf_dir):
    return rounded(series.event_depths(injected(spark, sf_dir), "flux_norm"))


@register(f"""WITH {INJ}, {EVENTS}, z AS (SELECT *, event - floor(event / 2) * 2 = 1 AS odd FROM ed WHERE depth IS NOT NULL), g AS (SELECT tic_id, median(CASE WHEN odd THEN depth END) AS mo, median(CASE WHEN NOT odd THEN depth END) AS me, count(CASE WHEN odd THEN 1 END) AS no, count(CASE WHEN NOT odd THEN 1 END) AS ne,
median(CASE WHEN odd THEN err END) AS eo, median(CASE WHEN NOT odd THEN err END) AS ee, 1.4826 * mad(CASE WHEN odd THEN depth END) AS so, 1.4826 * mad(CASE WHEN NOT odd THEN depth END) AS se FROM z GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(CASE WHEN no > 0 AND ne > 0 THEN coalesce(abs(mo - me) / nullif(sqrt(greatest(so / sqrt(no), eo) ^ 2 + greatest(se / sqrt(ne), ee) ^ 2), 0), 0) ELSE 0 END, 4) AS odd_even_sigma FROM g""")
def odd_even_test(spark, sf_dir):
    return rounded(series.odd_even(series.event_depths(injected(spark, sf_dir), "flux_norm")), 4)


@register(f"""WITH {INJ}, {EVENTS}, p AS (SELECT tic_id, depth, row_number() OVER (PARTITION BY tic_id ORDER BY event) - 1 AS i, count(*) OVER (PARTITION BY tic_id) AS n FROM ed WHERE depth IS NOT NULL), d AS (SELECT tic_id, r, {series.DRAW} (SELECT tic_id, i, n, r FROM p, range(500) q(r) WHERE n > 1)))))))),
m AS (SELECT d.tic_id, r, median(depth) AS m FROM d JOIN p ON d.tic_id = p.tic_id AND d.place = p.i GROUP BY d.tic_id, r) SELECT tic_id, 1 AS sector, round(stddev_samp(m), 7) AS err FROM m GROUP BY tic_id""")
def bootstrap_depth_error(spark, sf_dir):
    return rounded(series.bootstrap_depth(series.event_depths(injected(spark, sf_dir), "flux_norm")), 7)


@register(f"""WITH {INJ}, g AS (SELECT tic_id, x, ph / period AS c, duration / period AS w, 0.15::DOUBLE + k * 0.005::DOUBLE AS phase FROM s, range(141) r(k)), d AS (SELECT *, abs((c - phase + 0.5::DOUBLE) - floor(c - phase + 0.5::DOUBLE) - 0.5::DOUBLE) AS dist FROM g),
e AS (SELECT tic_id, phase, x, dist < 0.5::DOUBLE * w AS i, dist < greatest(3 * w, 0.04::DOUBLE) AND dist >= 0.5::DOUBLE * w AND abs(c) > 2 * w AS o FROM d), a AS (SELECT tic_id, phase, count(CASE WHEN i THEN 1 END) AS n_in, count(CASE WHEN o THEN 1 END) AS n_out, median(CASE WHEN i THEN x END) AS mi, median(CASE WHEN o THEN x END) AS mo, 1.4826 * mad(CASE WHEN o THEN x END) AS noise FROM e WHERE i OR o GROUP BY tic_id, phase)
SELECT tic_id, 1 AS sector, round(greatest(z, 0), 4) AS secondary_sigma, round(phase, 4) AS secondary_phase, round(depth, 6) AS secondary_depth FROM (SELECT tic_id, phase, z, mo - mi AS depth, row_number() OVER (PARTITION BY tic_id ORDER BY z DESC, phase) AS k FROM (SELECT *, round((mo - mi) / nullif(noise, 0) * sqrt(n_in), 9) AS z FROM a WHERE n_in >= 3 AND n_out >= 10) WHERE z IS NOT NULL) WHERE k = 1""")
def secondary_test(spark, sf_dir):
    return series.secondary(injected(spark, sf_dir), "flux_norm").select(F.col("tic_id"), F.col("sector").cast("long").alias("sector"), F.round("secondary_sigma", 4).alias("secondary_sigma"), F.round("secondary_phase", 4).alias("secondary_phase"), F.round("secondary_depth", 6).alias("secondary_depth"))


@register(f"""WITH {INJ}, a AS (SELECT tic_id, count(CASE WHEN i THEN 1 END) AS n, median(CASE WHEN i THEN centroid_col END) - median(CASE WHEN NOT i THEN centroid_col END) AS dc, median(CASE WHEN i THEN centroid_row END) - median(CASE WHEN NOT i THEN centroid_row END) AS dr, 1.4826 * mad(CASE WHEN NOT i THEN centroid_col END) AS sc, 1.4826 * mad(CASE WHEN NOT i THEN centroid_row END) AS sr FROM s GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(sqrt(dc ^ 2 + dr ^ 2), 6) AS shift, round(sqrt((dc * sqrt(n) / sc) ^ 2 + (dr * sqrt(n) / sr) ^ 2), 6) AS sigma FROM a""")
def centroid_test(spark, sf_dir):
    return rounded(series.centroid_shift(injected(spark, sf_dir)))


@register(f"WITH {INJ}, y AS (SELECT tic_id, time, x - median(x) OVER (PARTITION BY tic_id) AS y FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY time) AS n FROM y), c AS (SELECT a.tic_id, b.n - a.n AS k, sum(a.y * b.y) AS p FROM r a JOIN r b ON a.tic_id = b.tic_id AND b.n BETWEEN a.n AND a.n + 20 GROUP BY ALL) SELECT c.tic_id, 1 AS sector, round(median(abs(c.p / z.p)), 6) AS red_noise FROM c JOIN c z ON z.tic_id = c.tic_id AND z.k = 0 WHERE c.k > 0 GROUP BY c.tic_id")
def red_noise_proxy(spark, sf_dir):
    return rounded(series.red_noise(injected(spark, sf_dir), "flux_norm"))


@register(f"""WITH {INJ}, a AS (SELECT tic_id, time, x, duration, row_number() OVER w - 1 AS pos, time - lag(time) OVER w AS dt FROM s WINDOW w AS (PARTITION BY tic_id ORDER BY time)), z AS (SELECT tic_id, count(*) AS n, greatest(3, CAST(round_even(any_value(duration) / median(dt), 0) AS INT)) AS size FROM a GROUP BY tic_id),
m AS (SELECT tic_id, pos // size AS k, avg(x) AS x, any_value(size) AS size FROM a JOIN z USING (tic_id) WHERE n >= 100 AND size < n // 5 GROUP BY tic_id, k HAVING count(*) = any_value(size)), u AS (SELECT tic_id, 1.4826 * mad(x) AS s1 FROM s GROUP BY tic_id), v AS (SELECT tic_id, 1.4826 * mad(x) AS sb, any_value(size) AS size FROM m GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(coalesce(least(greatest(sb * sqrt(size) / nullif(s1, 0), 1), 5), 1), 5) AS beta FROM u LEFT JOIN v USING (tic_id)""")
def red_noise_beta(spark, sf_dir):
    return rounded(series.red_noise_beta(injected(spark, sf_dir), "flux_norm"), 5)


@register(f"WITH {INJ}, b AS (SELECT tic_id, CAST(least(greatest(floor((ph / period + 0.5::DOUBLE) * 50), 0), 49) AS BIGINT) AS bin, x FROM s) SELECT tic_id, 1 AS sector, bin, count(*) AS n, round(median(x), 6) AS median FROM b GROUP BY tic_id, bin HAVING count(*) >= 3")
def folded_medians(spark, sf_dir):
    return rounded(series.phase_bins(injected(spark, sf_dir), "flux_norm"))


# the default search: 4000 periods from 0.2 days to the baseline's half (13.5 at most), 12 durations, 240 bins
SEARCH = f"""{INJ}, q0 AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sigma, min(time) AS t1, least(13.5::DOUBLE, (max(time) - min(time)) / 2) AS hi FROM s GROUP BY tic_id), y AS (SELECT s.tic_id, x - med AS y, time - t1 AS t, hi FROM s JOIN q0 USING (tic_id)),
g AS (SELECT tic_id, trial, y, t, 0.2::DOUBLE + trial * ((hi - 0.2::DOUBLE) / 3999) AS period FROM y, range(4000) r(trial)), b AS (SELECT tic_id, trial, any_value(period) AS period, CAST(least(floor((t - floor(t / period) * period) / period * 240), 239) AS INT) AS bin, sum(y) / count(*) AS m FROM g GROUP BY tic_id, trial, CAST(least(floor((t - floor(t / period) * period) / period * 240), 239) AS INT)),
sp AS (SELECT tic_id, trial, k AS bin FROM (SELECT DISTINCT tic_id, trial FROM b), range(240) r(k)), de AS (SELECT tic_id, trial, bin, coalesce(m, 0) AS m FROM sp LEFT JOIN b USING (tic_id, trial, bin)), dup AS (SELECT tic_id, trial, bin AS i, m FROM de UNION ALL SELECT tic_id, trial, bin + 240, m FROM de),
cu AS (SELECT tic_id, trial, i, sum(m) OVER (PARTITION BY tic_id, trial ORDER BY i) AS c FROM dup), li AS (SELECT tic_id, trial, list_prepend(0::DOUBLE, list(c ORDER BY i)) AS c FROM cu GROUP BY tic_id, trial), pe AS (SELECT tic_id, trial, any_value(period) AS period FROM b GROUP BY tic_id, trial),
tr AS (SELECT tic_id, trial, period, d, 0.02::DOUBLE + 0.28::DOUBLE * d / 11 AS duration, CAST(greatest(1, least(round_even((0.02::DOUBLE + 0.28::DOUBLE * d / 11) / period * 240, 0), 80)) AS INT) AS width, c FROM li JOIN pe USING (tic_id, trial), range(12) r(d)),
bx AS (SELECT tic_id, trial, period, d, duration, width, list_min(list_transform(range(0, 240), lambda i: round((c[i + 1 + width] - c[i + 1]) / width, 12))) AS mean FROM tr), sc AS (SELECT tic_id, trial, period, d, duration, width, -mean AS depth, CASE WHEN mean < 0 THEN -mean / sigma * sqrt(width) ELSE 0 END AS score FROM bx JOIN q0 USING (tic_id)),
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tic_id, trial ORDER BY score DESC, d) AS k FROM sc) WHERE k = 1)"""
BEST = f"""{SEARCH}, mm AS (SELECT tic_id, median(score) AS med, 1.4826 * mad(score) AS spread, min(period) AS lo, max(period) AS hi FROM pp GROUP BY tic_id), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY round(score, 9) DESC, trial) AS kk FROM pp) WHERE kk = 1),
hm AS (SELECT t.tic_id, t.score AS top, h FROM (SELECT *, unnest([period / 2, period / 3, period * 2, period * 3]) AS h FROM tp) t JOIN mm USING (tic_id) WHERE h >= lo AND h <= hi), nr AS (SELECT tic_id, top, score FROM (SELECT hm.tic_id, top, pp.score, row_number() OVER (PARTITION BY hm.tic_id, h ORDER BY round(abs(pp.period - h), 9), pp.trial) AS kn FROM hm JOIN pp USING (tic_id)) WHERE kn = 1),
bs AS (SELECT tp.tic_id, tp.period, tp.duration, tp.score, (tp.score - med) / nullif(spread, 0) AS sde, coalesce(al.a, false) AND (tp.score - med) / nullif(spread, 0) >= 8 AS alias FROM tp JOIN mm USING (tic_id) LEFT JOIN (SELECT tic_id, bool_or(score > 0.8 * top) AS a FROM nr GROUP BY tic_id) al USING (tic_id))"""


def scored(spark, sf_dir, **settings):
    return search.periodogram(injected(spark, sf_dir), "flux_norm", **settings)


def strongest(spark, sf_dir, **settings):
    """The best box of each target: its trials are neither returned nor shuffled."""
    return search.strongest(injected(spark, sf_dir), "flux_norm", **settings)


@register(f"WITH {SEARCH} SELECT tic_id, 1 AS sector, trial, round(period, 6) AS period, round(duration, 6) AS duration, CAST(width AS BIGINT) AS width, round(depth, 6) AS depth, round(score, 5) AS score FROM pp")
def box_search(spark, sf_dir):
    """The best box of each of 4000 trial periods."""
    return rounded(scored(spark, sf_dir).drop("t0").withColumn("score", F.round("score", 5)))


@register(f"WITH {BEST} SELECT tic_id, 1 AS sector, round(period, 6) AS period, round(duration, 6) AS duration, round(score, 4) AS score, round(sde, 4) AS sde, alias FROM bs")
def best_box(spark, sf_dir):
    b = strongest(spark, sf_dir)
    return b.select("tic_id", F.col("sector").cast("long").alias("sector"), F.round("period", 6).alias("period"), F.round("duration", 6).alias("duration"), F.round("score", 4).alias("score"), F.round("sde", 4).alias("sde"), "alias")


@register()
def best_robust_box(spark, sf_dir):
    return strongest(spark, sf_dir, method="robust_box").select("tic_id", "sector", "period", "duration", "score", "sde", "alias")


@register()
def best_least_squares_box(spark, sf_dir):
    return strongest(spark, sf_dir, method="bls", mode="frequency").select("tic_id", "sector", "period", "duration", "score", "sde", "alias")


GUARD = f"""{CAND_SQL}, g0 AS (SELECT *, secondary_sigma >= 5 AND secondary_ratio >= 0.05 AS h1, secondary_sigma >= 5 AND NOT (secondary_sigma >= 5 AND secondary_ratio >= 0.05) AS h2, odd_even_sigma >= 3 AS h3, centroid_sigma >= 5 AS h4, centroid_sigma >= 3 AND centroid_sigma < 5 AND crowding >= 0.25 AS h5, crowding >= 0.4 AS h6, coalesce(data_quality <= 0.35, false) AS h7, snr < 6 AS h8 FROM cand),
g1 AS (SELECT *, least(p_0, CASE WHEN h1 THEN 0.18 ELSE 9 END, CASE WHEN h2 THEN 0.35 ELSE 9 END, CASE WHEN h3 THEN 0.25 ELSE 9 END, CASE WHEN h4 THEN 0.25 ELSE 9 END, CASE WHEN h6 THEN 0.38 ELSE 9 END, CASE WHEN h7 THEN 0.22 ELSE 9 END, CASE WHEN h8 THEN 0.18 ELSE 9 END) AS r_0, greatest(p_1, CASE WHEN h1 THEN 0.82 ELSE 0 END, CASE WHEN h2 THEN 0.6 ELSE 0 END, CASE WHEN h3 THEN 0.72 ELSE 0 END) AS r_1,
greatest(p_2, CASE WHEN h4 THEN 0.82 ELSE 0 END, CASE WHEN h5 THEN 0.65 ELSE 0 END, CASE WHEN h6 THEN 0.62 ELSE 0 END) AS r_2, p_3 AS r_3, greatest(p_4, CASE WHEN h7 THEN 0.7 ELSE 0 END) AS r_4, greatest(p_5, CASE WHEN h8 THEN 0.55 ELSE 0 END) AS r_5, p_6 AS r_6 FROM g0),
g2 AS (SELECT *, r_0 + r_1 + r_2 + r_3 + r_4 + r_5 + r_6 AS tot FROM g1), g3 AS (SELECT *, [round(CASE WHEN tot > 0 THEN v / tot ELSE 1 / 7 END, 12) FOR v IN [r_0, r_1, r_2, r_3, r_4, r_5, r_6]] AS a FROM g2),
g4 AS (SELECT *, list_max(a) AS top, {catalog.CLASSES}[list_position(a, list_max(a))] AS name, list_reverse_sort(a) AS o FROM g3),
dec AS (SELECT *, CASE WHEN top < 0.45 AND name <> '{catalog.NOTHING}' THEN '{catalog.UNCERTAIN}' ELSE name END AS final_class, CASE WHEN top < 0.45 AND name <> '{catalog.NOTHING}' THEN greatest(top, a[7], 0.45) ELSE top END AS confidence, o[1] - o[2] AS margin FROM g4)"""


def decided(spark, sf_dir):
    return catalog.decide(catalog.guardrails(candidates(spark, sf_dir)))


@register(f"WITH {GUARD} SELECT tic_id, candidate_id, final_class, round(confidence, 6) AS confidence, round(margin, 6) AS margin, concat_ws(';', CASE WHEN h1 THEN 'guardrail_strong_secondary_eclipse' END, CASE WHEN h2 THEN 'guardrail_possible_secondary_eclipse' END, CASE WHEN h3 THEN 'guardrail_odd_even_depth_mismatch' END, CASE WHEN h4 THEN 'guardrail_significant_centroid_shift' END, CASE WHEN h5 THEN 'guardrail_marginal_centroid_plus_crowding' END, CASE WHEN h6 THEN 'guardrail_low_crowdsap_or_high_crowding' END, CASE WHEN h7 THEN 'guardrail_low_data_quality' END, CASE WHEN h8 THEN 'guardrail_low_snr' END) AS guard_warnings FROM dec")
def guarded_classes(spark, sf_dir):
    return rounded(decided(spark, sf_dir).select("tic_id", "candidate_id", "final_class", "confidence", "margin", "guard_warnings"))


LIGHT = "CASE WHEN candidate_id % 4 <> 0 THEN 0.3e0 + (candidate_id % 8) / 1e1 END"


@register(f"WITH {GUARD.replace('crowding >= 0.4 AS h6', f'crowding >= 0.4 OR coalesce({LIGHT} <= 0.6, false) AS h6')} SELECT tic_id, candidate_id, final_class, round(confidence, 6) AS confidence, h6 AS crowded FROM dec")
def crowded_classes(spark, sf_dir):
    """Classes where the share of the target's own light is known for most."""
    c = candidates(spark, sf_dir).withColumn("crowdsap", F.expr(LIGHT))
    out = catalog.decide(catalog.guardrails(c))
    return rounded(out.select("tic_id", "candidate_id", "final_class", "confidence", F.contains("guard_warnings", F.lit("low_crowdsap")).alias("crowded")))


GUARD_WARNINGS = "concat_ws(';', CASE WHEN h1 THEN 'guardrail_strong_secondary_eclipse' END, CASE WHEN h2 THEN 'guardrail_possible_secondary_eclipse' END, CASE WHEN h3 THEN 'guardrail_odd_even_depth_mismatch' END, CASE WHEN h4 THEN 'guardrail_significant_centroid_shift' END, CASE WHEN h5 THEN 'guardrail_marginal_centroid_plus_crowding' END, CASE WHEN h6 THEN 'guardrail_low_crowdsap_or_high_crowding' END, CASE WHEN h7 THEN 'guardrail_low_data_quality' END, CASE WHEN h8 THEN 'guardrail_low_snr' END)"
PRIORITY = f"""{GUARD}, pr AS (SELECT *, least(greatest(confidence, 0), 1) AS conf, confidence < 0.5 OR margin < 0.15 AS needs_review, round(100 * confidence + 4 * least(snr, 30) + 5 * least(n_transits, 6) + 20 * coalesce(data_quality, 0.6) + CASE final_class {' '.join(f"WHEN '{k}' THEN {v}" for k, v in catalog.OFFSETS.items())} ELSE 0 END - 8 * greatest(secondary_sigma - 3, 0) - 7 * greatest(odd_even_sigma - 2, 0) - 7 * greatest(centroid_sigma - 2, 0) - 25 * greatest(crowding - 0.25, 0), 6) AS priority_score FROM dec),
ac AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, tic_id, candidate_id) AS priority_rank, confidence >= 0.75 AND secondary_sigma < 4 AND odd_even_sigma < 3 AND centroid_sigma < 3 AS fine FROM pr)"""


@register(f"""WITH {PRIORITY} SELECT tic_id, candidate_id, final_class, round(conf, 6) AS confidence, round(greatest(duration_days, 1e-6) * 24, 6) AS duration_hours, needs_review,
concat_ws(';', nullif({GUARD_WARNINGS}, ''), CASE WHEN secondary_sigma >= 5 THEN 'SECONDARY_RISK' END, CASE WHEN odd_even_sigma >= 3 THEN 'ODD_EVEN_RISK' END, CASE WHEN centroid_sigma >= 3 THEN 'CENTROID_RISK' END, CASE WHEN crowding >= 0.3 THEN 'CROWDING_RISK' END) AS risk_summary, priority_score,
CASE WHEN needs_review THEN 'MANUAL_REVIEW_REQUIRED__' ELSE '' END || CASE WHEN final_class = '{catalog.PLANET}' AND fine AND crowding >= 0.25 THEN 'HIGH_PRIORITY_PLANET_CANDIDATE__CHECK_GAIA_TPF_CONTAMINATION' WHEN final_class = '{catalog.PLANET}' AND fine THEN 'HIGH_PRIORITY_PLANET_CANDIDATE__VISUAL_REVIEW_AND_FOLLOWUP' WHEN final_class = '{catalog.PLANET}' THEN 'PLANET_CANDIDATE__NEEDS_ADDITIONAL_VETTING' WHEN final_class = '{catalog.BINARY}' THEN 'LIKELY_ECLIPSING_BINARY__VERIFY_PERIOD_ALIAS_AND_SECONDARY' WHEN final_class = '{catalog.BLEND}' THEN 'LIKELY_BLEND__INSPECT_CENTROIDS_TPF_AND_NEARBY_SOURCES' WHEN final_class = '{catalog.UNCERTAIN}' AND snr >= 7 THEN 'UNCERTAIN_TRANSIT_LIKE_SIGNAL__KEEP_FOR_REVIEW' WHEN final_class = '{catalog.SYSTEMATIC}' THEN 'LIKELY_SYSTEMATIC_OR_LOW_QUALITY__LOW_PRIORITY' ELSE 'NO_ACTION_OR_LOW_PRIORITY' END AS recommended_action, priority_rank FROM ac""")
def final_catalog(spark, sf_dir):
    c = catalog.harmonise(decided(spark, sf_dir))
    return rounded(c.select("tic_id", "candidate_id", "final_class", "confidence", "duration_hours", "needs_review", "risk_summary", "priority_score", "recommended_action", "priority_rank"))


FAULTS = {"final_class": "CASE WHEN candidate_id % 11 = 0 THEN 'SOMETHING_ELSE' WHEN candidate_id % 17 = 0 THEN NULL ELSE final_class END", "confidence": "CASE WHEN candidate_id % 13 = 0 THEN 1.5e0 ELSE confidence END", "tic_id": "CASE WHEN candidate_id % 19 = 0 THEN NULL ELSE tic_id END", "depth_ppm": "CASE WHEN candidate_id % 7 = 0 THEN 0e0 ELSE depth_ppm END", "priority_rank": "CASE WHEN candidate_id % 23 = 0 THEN 1 ELSE priority_rank END", "period_days": "CASE WHEN candidate_id % 29 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN candidate_id % 31 = 0 THEN -1e0 ELSE period_days END", "effective_snr": "CAST(NULL AS DOUBLE)"}


@register(f"""WITH {PRIORITY}, fa AS (SELECT {FAULTS['final_class']} AS final_class, {FAULTS['confidence'].replace('confidence END', 'conf END')} AS confidence, {FAULTS['tic_id']} AS tic_id, CASE WHEN candidate_id % 7 = 0 THEN 0e0 ELSE greatest(depth_ppm, 1e-6) END AS depth_ppm, {FAULTS['priority_rank']} AS priority_rank, {FAULTS['period_days'].replace('ELSE period_days', 'ELSE greatest(period_days, 1e-6)')} AS period_days FROM ac),
n AS (SELECT unnest([{{'issue': 'UNKNOWN_CLASS', 'n': (SELECT count(*) FROM fa WHERE final_class IS NULL OR final_class NOT IN {tuple(catalog.CLASSES)})}}, {{'issue': 'CONFIDENCE_RANGE', 'n': (SELECT count(*) FROM fa WHERE confidence < 0 OR confidence > 1)}}, {{'issue': 'NO_TARGET', 'n': (SELECT count(*) FROM fa WHERE tic_id IS NULL)}},
{{'issue': 'DEPTH_PPM_RANGE', 'n': (SELECT count(*) FROM fa WHERE depth_ppm <= 0)}}, {{'issue': 'PERIOD_DAYS_RANGE', 'n': (SELECT count(*) FROM fa WHERE isfinite(period_days) AND period_days <= 0)}}, {{'issue': 'PERIOD_DAYS_NOT_FINITE', 'n': (SELECT count(*) FROM fa WHERE NOT isfinite(period_days))}}, {{'issue': 'EFFECTIVE_SNR_ALL_NULL', 'n': (SELECT CAST(count(*) > 0 AS BIGINT) FROM fa)}}, {{'issue': 'RANK_NOT_CONTIGUOUS', 'n': (SELECT CAST(count(DISTINCT priority_rank) <> count(*) OR min(priority_rank) <> 1 OR max(priority_rank) <> count(*) AS BIGINT) FROM fa)}}], recursive := true)) SELECT issue, n FROM n WHERE n > 0""")
def catalog_issues(spark, sf_dir):
    """The contract's check over a catalog with planted faults."""
    c = catalog.harmonise(decided(spark, sf_dir))
    return catalog.schema_issues(c.withColumns({k: F.expr(v) for k, v in FAULTS.items()}))


@register(f"WITH {PRIORITY} SELECT {FAULTS['final_class'].replace(' WHEN candidate_id % 17 = 0 THEN NULL', '')} AS name, count(*) AS n FROM ac WHERE candidate_id % 11 = 0 GROUP BY 1")
def unknown_classes(spark, sf_dir):
    c = decided(spark, sf_dir).withColumn("final_class", F.expr(FAULTS["final_class"].replace(" WHEN candidate_id % 17 = 0 THEN NULL", "")))
    return catalog.unknown_classes(c)


@register(f"WITH {PRIORITY} SELECT final_class, count(*) AS n, count(DISTINCT tic_id) AS targets, round(avg(conf), 6) AS confidence, round(max(snr), 6) AS best_snr FROM ac GROUP BY GROUPING SETS ((final_class), ())")
def catalog_summary(spark, sf_dir):
    return rounded(catalog.summary(catalog.harmonise(decided(spark, sf_dir), ranks=False)))


@register(f"WITH {PRIORITY} SELECT priority_rank, tic_id, candidate_id, priority_score FROM ac ORDER BY priority_rank LIMIT 10")
def catalog_top(spark, sf_dir):
    return rounded(catalog.top(catalog.harmonise(decided(spark, sf_dir))).select("priority_rank", "tic_id", "candidate_id", "priority_score"))


@register(f"WITH {CAND_SQL}, t AS (SELECT c_custkey AS tic_id FROM customer) SELECT t.tic_id, count(candidate_id) AS n_candidates, round(max(snr), 6) AS best_snr, round(max(data_quality), 6) AS best_confidence FROM t LEFT JOIN cand USING (tic_id) GROUP BY t.tic_id")
def target_summary(spark, sf_dir):
    targets = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tic_id"))
    found = candidates(spark, sf_dir).withColumns({"unc_effective_snr": F.lit(None).cast("double"), "final_confidence": F.col("data_quality")})
    return rounded(catalog.target_summary(targets, found, ["tic_id"]))


@register(f"""WITH {CAND_SQL}, k AS (SELECT *, candidate_id % 4 = 0 AS v, candidate_id % 3 <> 0 AS m FROM cand) SELECT tic_id, candidate_id, round(CASE WHEN v THEN p_1 END, 6) AS model_p, round(CASE WHEN m THEN p_2 END, 6) AS table_p, round(CASE WHEN v AND m AND p_0 + p_1 + p_2 + p_3 = 0 THEN 0.5 WHEN v AND m THEN (0.5 * p_1 + 0.5 * p_2) / nullif(0.5 * (p_0 + p_3) + 0.5 * p_1 + 0.5 * p_2, 0) END, 6) AS both FROM k""")
def attached_predictions(spark, sf_dir):
    """Predictions of two models joined to their candidates, those of the first winning; and class probabilities of both blended."""
    c, k = candidates(spark, sf_dir), ["tic_id", "candidate_id"]
    views = c.where("candidate_id % 4 = 0").select(*k, F.col("p_1").alias("model_p"))
    table = c.where("candidate_id % 3 <> 0").select(*k, F.col("p_0").alias("model_p"), F.col("p_2").alias("table_p"))
    out = catalog.attach_predictions(c.select(*k, "p_0", "p_3"), k, views, table)
    a = out.withColumns({"a_0": F.col("p_0"), "b_0": F.lit(0.0), "a_1": F.col("model_p"), "a_2": F.lit(0.0), "b_2": F.col("table_p"), "b_3": F.col("p_3")})
    mixed = catalog.blend_classes(a, "a_", "b_")
    return rounded(mixed.select(*k, "model_p", "table_p", F.when(F.col("model_p").isNotNull() & F.col("table_p").isNotNull(), F.try_divide(F.col("p_1") + F.col("p_2"), F.col("p_0") + F.col("p_1") + F.col("p_2") + F.col("p_3"))).alias("both")))


@register(f"""WITH {CAND_SQL}, v AS (SELECT * EXCLUDE (status), CASE WHEN n_transits >= 3 AND snr >= 10 AND coalesce(sde >= 8, true) THEN 'STRONG_DETECTION' WHEN n_transits >= 2 AND snr >= 7 AND coalesce(sde >= 6, true) THEN 'WEAK_DETECTION' ELSE 'NO_DETECTION' END AS status FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY CASE status WHEN 'STRONG_DETECTION' THEN 2 WHEN 'WEAK_DETECTION' THEN 1 ELSE 0 END DESC, snr DESC, coalesce(sde, -999) DESC, candidate_id) AS rank FROM v) SELECT tic_id, candidate_id, status, rank FROM r WHERE rank <= 3""")
def ranked_candidates(spark, sf_dir):
    c = candidates(spark, sf_dir)
    c = c.withColumn("status", search.status(F.col("snr"), F.col("sde"), F.col("n_transits")))
    return rounded(catalog.rank_candidates(c).select("tic_id", "candidate_id", "status", "rank"))


RULES = f"""{CAND_SQL}, a AS (SELECT *, round(least(greatest(0.45 / (1 + exp(-(snr - 8) / 2)) + CASE WHEN sde IS NOT NULL THEN 0.25 / (1 + exp(-(sde - 7) / 1.5)) ELSE 0.12 END + 0.20 * least(n_transits / 3, 1) + 0.10 * coalesce(data_quality, 0.5), 0), 1), 10) AS strength,
round(least(CASE WHEN secondary_sigma >= 5 AND secondary_ratio >= 0.05 THEN 0.45e0 ELSE 0 END + CASE WHEN secondary_sigma >= 5 AND secondary_ratio < 0.05 THEN 0.25e0 ELSE 0 END + CASE WHEN odd_even_sigma >= 3 THEN 0.35e0 ELSE 0 END + CASE WHEN depth_ppm > 15000 THEN 0.20e0 ELSE 0 END + CASE WHEN radius_ratio > 0.18e0 THEN 0.20e0 ELSE 0 END + CASE WHEN v_shape_score < 0.45e0 THEN 0.12e0 ELSE 0 END, 1e0), 10) AS s_1,
round(least(CASE WHEN centroid_sigma >= 5 THEN 0.55e0 ELSE 0 END + CASE WHEN centroid_sigma >= 3 AND centroid_sigma < 5 THEN 0.25e0 ELSE 0 END + CASE WHEN crowding > 0.3e0 THEN 0.30e0 ELSE 0 END + CASE WHEN crowding > 0.15e0 AND crowding <= 0.3e0 THEN 0.15e0 ELSE 0 END + CASE WHEN corrected_depth_ppm > 2 * depth_ppm AND corrected_depth_ppm > 5000 THEN 0.15e0 ELSE 0 END, 1e0), 10) AS s_2,
round(CASE WHEN red_noise > 0.25 THEN 0.25e0 ELSE 0 END + CASE WHEN v_shape_score < 0.2e0 AND duration_days > 0.12e0 * period_days THEN 0.25e0 ELSE 0 END + CASE WHEN status = 'NO_DETECTION' THEN 0.1e0 ELSE 0 END, 10) AS s_3,
round(least(CASE WHEN coalesce(data_quality, 0.5e0) < 0.45e0 THEN 0.35e0 ELSE 0 END + CASE WHEN n_transits < 2 THEN 0.25e0 ELSE 0 END + CASE WHEN depth_ppm <= 0 THEN 0.35e0 ELSE 0 END, 1e0), 10) AS s_4 FROM cand), b AS (SELECT *, round(least(greatest(strength * (1 - 0.75e0 * greatest(s_1, s_2, s_3, s_4)), 0), 1), 10) AS s_0 FROM a),
c AS (SELECT *, [s_0, s_1, s_2, s_3, s_4] AS l FROM b), d AS (SELECT *, list_max(l) AS top, {catalog.CLASSES}[list_position(l, list_max(l))] AS name, list_reverse_sort(l)[2] AS second FROM c)"""


@register(f"""WITH {RULES} SELECT tic_id, candidate_id, round(s_0, 6) AS s_0, round(s_1, 6) AS s_1, round(s_2, 6) AS s_2, round(s_3, 6) AS s_3, round(s_4, 6) AS s_4, CASE WHEN top < 0.45e0 THEN CASE WHEN strength >= 0.35 THEN '{catalog.UNCERTAIN}' ELSE '{catalog.NOTHING}' END WHEN name = '{catalog.PLANET}' AND top - second < 0.12e0 THEN '{catalog.UNCERTAIN}' ELSE name END AS rule_class,
round(CASE WHEN top < 0.45e0 THEN CASE WHEN strength >= 0.35 THEN 0.45e0 ELSE greatest(strength, 1 - strength) END WHEN name = '{catalog.PLANET}' AND top - second < 0.12e0 THEN s_0 ELSE top END, 6) AS rule_confidence,
concat_ws(';', CASE WHEN snr >= 10 THEN 'strong_transit_snr' WHEN snr >= 7 THEN 'moderate_transit_snr' END, CASE WHEN secondary_sigma >= 5 AND secondary_ratio >= 0.05 THEN 'significant_secondary_eclipse' WHEN secondary_sigma >= 5 THEN 'possible_secondary_eclipse' END, CASE WHEN odd_even_sigma >= 3 THEN 'odd_even_depth_mismatch' END, CASE WHEN depth_ppm > 15000 THEN 'very_deep_event' END, CASE WHEN radius_ratio > 0.18e0 THEN 'large_radius_ratio' END, CASE WHEN v_shape_score < 0.45e0 THEN 'triangular_or_poorly_flat_bottom_event' END,
CASE WHEN centroid_sigma >= 5 THEN 'significant_centroid_shift' WHEN centroid_sigma >= 3 THEN 'marginal_centroid_shift' END, CASE WHEN crowding > 0.3e0 THEN 'high_crowding_risk' WHEN crowding > 0.15e0 THEN 'moderate_crowding_risk' END, CASE WHEN corrected_depth_ppm > 2 * depth_ppm AND corrected_depth_ppm > 5000 THEN 'large_dilution_correction' END, CASE WHEN red_noise > 0.25 THEN 'red_noise_or_quasiperiodic_variability' END,
CASE WHEN v_shape_score < 0.2e0 AND duration_days > 0.12e0 * period_days THEN 'broad_dip_relative_to_period' END, CASE WHEN coalesce(data_quality, 0.5e0) < 0.45e0 THEN 'low_data_quality' END, CASE WHEN n_transits < 2 THEN 'few_full_transits' END, CASE WHEN depth_ppm <= 0 THEN 'non_positive_depth' END) AS rule_evidence FROM d""")
def rule_classes(spark, sf_dir):
    return rounded(catalog.rule_scores(candidates(spark, sf_dir)).select("tic_id", "candidate_id", *[f"s_{i}" for i in range(5)], "rule_class", "rule_confidence", "rule_evidence"))


@register(f"""WITH {GUARD}, u AS (SELECT *, 1 + least(red_noise, 1) AS beta, coalesce(depth_err_ppm, depth_ppm / greatest(snr, 1)) * (1 + least(red_noise, 1)) AS err FROM dec), w AS (SELECT *, 0.45 / (1 + exp(-(snr / beta - 7) / 2)) + 0.25 * coalesce(1 / (1 + exp(-(sde - 6) / 1.5)), 0.5) + 0.2 * least(n_transits / 3, 1) + 0.1 * coalesce(data_quality, 0.7) AS det,
1 - 0.7 * least(coalesce(err / nullif(depth_ppm, 0), 1), 1) - 0.075 AS par, 0.75 * confidence + 0.25 * least(margin / 0.35, 1) AS cls FROM u), f AS (SELECT *, round(0.35 * least(det, 1) + 0.3 * least(greatest(par, 0), 1) + 0.35 * least(cls, 1), 9) AS fin FROM w)
SELECT tic_id, candidate_id, round(err, 5) AS unc_depth_err_ppm, round(fin, 5) AS unc_final_confidence, CASE WHEN fin >= 0.8 THEN 'HIGH' WHEN fin >= 0.6 THEN 'MEDIUM' WHEN fin >= 0.4 THEN 'LOW' ELSE 'VERY_LOW' END AS unc_level FROM f""")
def catalog_uncertainty(spark, sf_dir):
    return rounded(catalog.uncertainty_proxy(decided(spark, sf_dir)).select("tic_id", "candidate_id", "unc_depth_err_ppm", "unc_final_confidence", "unc_level"), 5)


LABELLED = f"{GUARD}, lab AS (SELECT *, CASE label_text WHEN '1-URGENT' THEN '{catalog.PLANET}' WHEN '2-HIGH' THEN '{catalog.BINARY}' WHEN '3-MEDIUM' THEN '{catalog.BLEND}' WHEN '5-LOW' THEN '{catalog.NOTHING}' END AS label FROM dec)"
LABEL_MAP = {"1-URGENT": catalog.PLANET, "2-HIGH": catalog.BINARY, "3-MEDIUM": catalog.BLEND, "5-LOW": catalog.NOTHING}


def labelled(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv])
    return decided(spark, sf_dir).withColumn("label", F.element_at(m, F.col("label_text")))


@register(f"WITH {LABELLED}, x AS (SELECT snr >= 7 AS d, coalesce(label <> '{catalog.NOTHING}', false) AS r FROM lab), c AS (SELECT count(CASE WHEN d AND r THEN 1 END) AS tp, count(CASE WHEN d AND NOT r THEN 1 END) AS fp, count(CASE WHEN NOT d AND NOT r THEN 1 END) AS tn, count(CASE WHEN NOT d AND r THEN 1 END) AS fn FROM x) SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def detection_metrics(spark, sf_dir):
    return rounded(validation.detection(labelled(spark, sf_dir), F.col("snr") >= 7, F.col("label") != catalog.NOTHING))


REPORT = f"{LABELLED}, q AS (SELECT label AS t, final_class AS p FROM lab WHERE label IS NOT NULL), ls AS (SELECT t AS label FROM q UNION SELECT p FROM q), rep AS (SELECT label, (SELECT count(*) FROM q WHERE t = label) AS support, (SELECT count(*) FROM q WHERE p = label) AS predicted_n, (SELECT count(*) FROM q WHERE t = label AND p = label) AS hits FROM ls), rf AS (SELECT *, coalesce(hits / nullif(predicted_n, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + predicted_n, 0), 0) AS f1 FROM rep)"


@register(f"WITH {REPORT} SELECT label, support, predicted_n, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rf")
def class_report(spark, sf_dir):
    return rounded(validation.class_report(labelled(spark, sf_dir), "label", "final_class"))


@register(f"WITH {REPORT} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rf")
def classification_metrics(spark, sf_dir):
    return rounded(validation.classification(labelled(spark, sf_dir), "label", "final_class"))


@register(f"""WITH {CAND_SQL}, x AS (SELECT unnest(['period', 'depth']) AS parameter, unnest([period_days, depth_ppm]) AS p, unnest([period_days * (1 + (candidate_id % 7) / 1e2), depth_ppm + (candidate_id % 19) * 1e1]) AS t FROM cand), e AS (SELECT parameter, abs(p - t) AS e, abs(p - t) / nullif(abs(t), 0) AS r FROM x)
SELECT parameter, count(*) AS n, round(avg(e), 5) AS mae, round(median(e), 5) AS median_abs, round(sqrt(avg(e * e)), 5) AS rmse, round(median(r), 5) AS median_rel, round(avg(coalesce(r <= 0.01, false)::INT), 5) AS within_1, round(avg(coalesce(r <= 0.05, false)::INT), 5) AS within_5, round(avg(coalesce(r <= 0.1, false)::INT), 5) AS within_10 FROM e GROUP BY parameter""")
def parameter_metrics(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumns({"true_p": F.expr("period_days * (1 + (candidate_id % 7) / 1e2)"), "true_d": F.expr("depth_ppm + (candidate_id % 19) * 1e1")})
    return rounded(validation.parameters(c, {"period": ("period_days", "true_p"), "depth": ("depth_ppm", "true_d")}), 5)


@register(f"WITH {LABELLED}, x AS (SELECT least(floor(confidence * 5), 4) AS bin, confidence AS c, coalesce(label = final_class, false)::INT AS y FROM lab), b AS (SELECT bin, count(*) AS n, avg(c) AS confidence, avg(y) AS accuracy FROM x GROUP BY bin) SELECT CAST(bin AS BIGINT) AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(n / sum(n) OVER () * abs(confidence - accuracy), 6) AS ece_part FROM b")
def reliability_bins(spark, sf_dir):
    return rounded(validation.reliability(labelled(spark, sf_dir), "confidence", F.coalesce(F.col("label") == F.col("final_class"), F.lit(False))))


@register(f"WITH {CAND_SQL}, r AS (SELECT min(depth_ppm) AS x0, max(depth_ppm) AS x1, min(red_noise) AS y0, max(red_noise) AS y1 FROM cand), b AS (SELECT CAST(greatest(ceil((depth_ppm - x0) / ((x1 - x0) / 5)) - 1, 0) AS BIGINT) AS x_bin, CAST(greatest(ceil((red_noise - y0) / ((y1 - y0) / 5)) - 1, 0) AS BIGINT) AS y_bin, (snr >= 10)::INT AS h FROM cand, r) SELECT x_bin, y_bin, count(*) AS n, round(avg(h), 6) AS rate FROM b GROUP BY ALL")
def recovery_heatmap(spark, sf_dir):
    return rounded(validation.recovery_map(candidates(spark, sf_dir), "depth_ppm", "red_noise", F.col("snr") >= 10))


@register(f"WITH {LABELLED} SELECT coalesce(label, 'UNLABELED') AS value, count(*) AS n FROM lab GROUP BY 1")
def label_counts(spark, sf_dir):
    return validation.counts(labelled(spark, sf_dir), "label")


@register(f"WITH {LABELLED}, b AS (SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY 1) SELECT label, n, round((1 / n) / avg(1 / n) OVER (), 6) AS weight FROM b")
def class_weights(spark, sf_dir):
    return rounded(validation.class_weights(labelled(spark, sf_dir), "label"))


@register(f"WITH {CAND_SQL}, x AS (SELECT unnest(['snr', 'sde', 'data_quality']) AS c, unnest([snr, sde, data_quality]) AS v FROM cand), m AS (SELECT c, coalesce(median(v), 0) AS med FROM x GROUP BY c) SELECT c AS column, round(any_value(med), 6) AS median, round(avg(coalesce(v, med)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(v, med)) > 0 THEN stddev_pop(coalesce(v, med)) ELSE 1 END, 6) AS std FROM x JOIN m USING (c) GROUP BY c".replace("c AS column", 'c AS "column"'))
def scalar_scaler(spark, sf_dir):
    return rounded(validation.scaler(candidates(spark, sf_dir), ["snr", "sde", "data_quality"]))


@register(f"WITH {LABELLED}, r AS (SELECT label, candidate_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(candidate_id AS VARCHAR)), candidate_id) AS k FROM lab WHERE label IS NOT NULL) SELECT label, candidate_id FROM r WHERE k <= 20")
def balanced_sample(spark, sf_dir):
    return rounded(validation.balanced_sample(labelled(spark, sf_dir), "label", F.col("candidate_id"), 20).select("label", "candidate_id"))


@register(f"WITH {CAND_SQL} SELECT candidate_id, tic_id FROM cand WHERE tic_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pending_targets(spark, sf_dir):
    done = tables.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("tic_id"))
    return rounded(catalog.pending(candidates(spark, sf_dir).select("candidate_id", "tic_id"), done, ["tic_id"]))


NAMES = [a for xs in labels.ALIASES.values() for a in xs] + [c.lower() for c in catalog.CLASSES] + ["what is this", ""]
NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
CLASS_SQL = "CASE " + " ".join(f"WHEN k IN ({', '.join(repr(a) for a in [*xs, c.lower()])}) THEN '{c}'" for c, xs in labels.ALIASES.items()) + " END"


@register(f"WITH p AS (SELECT p_partkey, ' ' || upper(replace({NAMES_SQL}[1 + p_partkey % {len(NAMES)}], '_', CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '_' END)) AS name, p_retailprice * 2000 AS bjd FROM part), q AS (SELECT *, lower(translate(trim(name), ' -/', '___')) AS k FROM p) SELECT p_partkey, k AS label_key, round(CASE WHEN bjd > 2400000 THEN bjd - 2457000 ELSE bjd END, 4) AS epoch, {CLASS_SQL} AS label FROM q")
def metadata_normalised(spark, sf_dir):
    """Every name of every class, in three spellings."""
    p = tables.read(spark, sf_dir, "part")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (1 + F.col("p_partkey") % len(NAMES)).cast("int"))
    name = F.concat(F.lit(" "), F.upper(F.replace(name, F.lit("_"), F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, "-").otherwise("_"))))
    return p.select("p_partkey", labels.key_of(name).alias("label_key"), F.round(labels.epoch((F.col("p_retailprice") * 2000).cast("double")), 4).alias("epoch"), labels.normalise_label(name).alias("label"))


DISP = [w for words, *_ in labels.DISPOSITIONS["kepler-dr25"] for w in words] + ["eclipsing binary", "quiet", "apc", "nan", "who knows"]
DISP_SQL = "[" + ", ".join(f"'{x}'" for x in DISP) + "]"


@register(f"""WITH p AS (SELECT p_partkey, replace({DISP_SQL}[1 + p_partkey % {len(DISP)}], '_', ' ') AS w, p_size FROM part), q AS (SELECT *, CASE WHEN w <> 'nan' THEN replace(lower(w), ' ', '_') END AS k FROM p)
SELECT p_partkey AS kepid, 'kepler-dr25' AS source, CASE WHEN k IN ('confirmed', 'candidate', 'planet_candidate', 'pc', 'apc') THEN '{catalog.PLANET}' WHEN k IN ('afp', 'astrophysical_false_positive', 'eclipsing_binary') THEN '{catalog.BINARY}' WHEN k IN ('ntp', 'non_transiting_phenomenon', 'false_alarm') THEN '{catalog.SYSTEMATIC}' WHEN k = 'quiet' THEN '{catalog.NOTHING}' END AS canonical_label,
CASE WHEN k IN ('confirmed', 'candidate', 'planet_candidate', 'pc', 'apc') THEN 'planet_like' WHEN k <> 'who_knows' THEN 'false_positive_or_other' END AS binary_label, CASE WHEN k IN ('false_positive', 'fp') THEN 'kepler_false_positive_subtype_not_assumed' ELSE '' END AS label_notes,
p_size / 4e0 AS period_days, round(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 2454833 + p_size END - CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2454833 END, 4) + 0e0 AS epoch_time, 'BKJD' AS epoch_time_system, round(p_size / 10e0 / 24, 6) AS duration_days, CASE WHEN k IN ('confirmed', 'candidate', 'planet_candidate', 'pc', 'apc') THEN 1e0 WHEN k <> 'who_knows' THEN 0e0 END AS is_planet FROM q""")
def public_metadata(spark, sf_dir):
    """A public table of another mission, standardised: dispositions, ids, ephemeris, epoch system."""
    p = tables.read(spark, sf_dir, "part")
    word = F.replace(F.element_at(F.array(*map(F.lit, DISP)), (1 + F.col("p_partkey") % len(DISP)).cast("int")), F.lit("_"), F.lit(" "))
    raw = p.select(F.col("p_partkey").alias("kepid"), word.alias(" koi_disposition "), (F.col("p_size") / 4).alias("[koi_period]"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(2454833 + F.col("p_size")).alias("koi_time0bk"), (F.col("p_size") / 10).cast("string").alias("koi_duration"))
    out = labels.standardise(raw, "kepler")
    return out.select(F.col("kepid").cast("long").alias("kepid"), "source", "canonical_label", "binary_label", "label_notes", "period_days", F.round(F.col("epoch_time").cast("double"), 4).alias("epoch_time"), "epoch_time_system", F.round("duration_days", 6).alias("duration_days"), labels.binary_label(F.col("binary_label"), F.col("canonical_label")).alias("is_planet"))


@register("SELECT c_custkey AS tic_id, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'a/tess2018206045859-s0001-' || lpad(CAST(c_custkey AS VARCHAR), 16, '0') || '-0120-s_lc.fits' ELSE 'b/TIC ' || c_custkey || '.fits' END END AS path, 'tic_' || c_custkey || '_s1_' || (c_custkey % 5) AS target_key FROM customer")
def target_files(spark, sf_dir):
    """Labelled targets and the files whose names hold their numbers."""
    c = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tic_id"))
    name = F.when(F.col("tic_id") % 2 == 0, F.concat(F.lit("a/tess2018206045859-s0001-"), F.lpad(F.col("tic_id").cast("string"), 16, "0"), F.lit("-0120-s_lc.fits"))).otherwise(F.concat(F.lit("b/TIC "), F.col("tic_id").cast("string"), F.lit(".fits")))
    files = c.where("tic_id % 3 <> 0").select(name.alias("path"))
    files = files.unionByName(files.select(F.concat("path", F.lit(".copy.fits")).alias("path")))
    return labels.files_of(c, files).select("tic_id", "path", labels.target_key(F.col("path"), F.col("tic_id"), F.lit(1), F.col("tic_id") % 5).alias("target_key"))


@register("SELECT s_suppkey, round(CAST(s_acctbal AS DOUBLE), 4) AS s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 50")
def target_list(spark, sf_dir):
    s = tables.read(spark, sf_dir, "supplier")
    return labels.target_list(s, "s_suppkey", "s_acctbal", 50).select("s_suppkey", F.round(F.col("s_acctbal").cast("double"), 4).alias("s_acctbal"))


@register(f"""WITH {REPORT}, x AS (SELECT status IN ('STRONG_DETECTION', 'WEAK_DETECTION') AS d, coalesce(label <> '{catalog.NOTHING}', false) AS r, coalesce(label = final_class, false)::INT AS y, least(floor(confidence * 5), 4) AS bin, confidence FROM lab), e AS (SELECT sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT count(*) AS n, avg(confidence) AS c, avg(y) AS a FROM x GROUP BY bin)),
f AS (SELECT count(CASE WHEN d AND r THEN 1 END)::DOUBLE AS tp, count(CASE WHEN d AND NOT r THEN 1 END)::DOUBLE AS fp, count(CASE WHEN NOT d AND NOT r THEN 1 END)::DOUBLE AS tn, count(CASE WHEN NOT d AND r THEN 1 END)::DOUBLE AS fn FROM x), m AS (SELECT sum(hits) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced, avg(f1) AS macro, sum(f1 * support) / sum(support) AS weighted FROM rf)
SELECT unnest(['detection', 'detection', 'detection', 'detection', 'detection', 'detection', 'detection', 'detection', 'classes', 'classes', 'classes', 'classes', 'calibration']) AS part, unnest(['tp', 'fp', 'tn', 'fn', 'precision', 'recall', 'specificity', 'f1', 'accuracy', 'balanced_accuracy', 'macro_f1', 'weighted_f1', 'ece']) AS metric,
unnest([tp, fp, tn, fn, round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), round(tn / (tn + fp), 6), round(2 * tp / (2 * tp + fp + fn), 6), round(accuracy, 6), round(balanced, 6), round(macro, 6), round(weighted, 6), round(ece, 6)]) AS value FROM f, e, m""")
def validation_report(spark, sf_dir):
    return rounded(validation.report(labelled(spark, sf_dir)))


@register(f"WITH {LABELLED}, c AS (SELECT unnest({catalog.CLASSES}) AS truth, unnest(range(7)) AS place) SELECT place, truth, " + ", ".join(f"count(CASE WHEN final_class = '{k}' THEN 1 END) AS \"{k}\"" for k in catalog.CLASSES) + " FROM c LEFT JOIN lab ON label = truth GROUP BY place, truth")
def confusion_matrix(spark, sf_dir):
    return rounded(validation.confusion(labelled(spark, sf_dir), "label", "final_class", catalog.CLASSES))


@register(f"WITH {GUARD} SELECT CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM dec WHERE confidence BETWEEN 0 AND 1 GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return rounded(validation.chart_bins(decided(spark, sf_dir), "confidence"))


@register(f'WITH {CAND_SQL}, x AS (SELECT unnest([{", ".join(repr(f"p_{i}") for i in range(7))}]) AS class, unnest([{", ".join(f"p_{i}" for i in range(7))}]) AS v FROM cand) SELECT class AS "class", round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, var_pop(v) < 1e-6 AS collapsed FROM x GROUP BY class')
def prediction_diversity(spark, sf_dir):
    return rounded(validation.diversity(candidates(spark, sf_dir), [f"p_{i}" for i in range(7)]))
