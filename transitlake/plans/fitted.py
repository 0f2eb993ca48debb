"""Registered queries of fits, views and models, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, fitting, injection, models, series, validation, vetting
from ..sources import tables
from .registered import INJ, SQL, K, candidates, injected, labelled, register, rounded, strongest
from ..operators import search

FEATURES = ["period_days", "duration_days", "depth_ppm", "snr", "sde", "n_transits", "secondary_sigma", "odd_even_sigma", "centroid_sigma", "crowding", "data_quality", "red_noise"]


@register(f"""WITH {INJ}, pb AS (SELECT tic_id, least(greatest(floor((ph / period + 0.5::DOUBLE) * 241), 0), 240) AS bin, count(*) AS n, median(x) AS m0, any_value(period) AS p FROM s GROUP BY ALL), pr AS (SELECT *, CASE WHEN n >= 3 THEN m0 END AS m, ((bin + 0.5::DOUBLE) / 241 - 0.5::DOUBLE) * p AS pos FROM pb),
o AS (SELECT tic_id, sum(n) AS points, count(m) AS filled, coalesce(median(CASE WHEN abs(pos) > greatest(0.3::DOUBLE, 0.05::DOUBLE * p) THEN m END), median(m)) AS base, coalesce(median(CASE WHEN abs(pos) < greatest(0.1::DOUBLE, 2 * p / 241) THEN m END), min(m)) AS low FROM pr GROUP BY tic_id),
w AS (SELECT tic_id, any_value(points) AS points, any_value(filled) AS filled, any_value(base) AS base, any_value(low) AS low, any_value(p) AS p, count(CASE WHEN m < base - 0.5 * (base - low) THEN 1 END) AS under, max(CASE WHEN m < base - 0.5 * (base - low) THEN pos END) - min(CASE WHEN m < base - 0.5 * (base - low) THEN pos END) AS width FROM pr JOIN o USING (tic_id) GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(CASE WHEN points >= 50 AND filled >= 20 AND base > low AND under >= 2 AND width > 0 AND width <= 0.5 * p THEN width ELSE 0.2::DOUBLE END, 6) AS duration_profile, CASE WHEN points >= 50 AND filled >= 20 AND base > low AND under >= 2 AND width > 0 AND width <= 0.5 * p THEN 'half_depth_profile' ELSE 'fallback_initial' END AS method FROM w""")
def folded_duration(spark, sf_dir):
    return rounded(fitting.profile_duration(injected(spark, sf_dir), "flux_norm"))


@register(f"""WITH {INJ}, g AS (SELECT tic_id, time, x, period, t0, c, period * (1 - 0.002::DOUBLE + 0.004::DOUBLE * floor(c / 25) / 24) AS p, t0 - 0.5::DOUBLE * duration + duration * (c % 25) / 24 AS e FROM s, range(625) r(c)), f AS (SELECT *, time - e + p / 2 AS v FROM g), h AS (SELECT *, abs(v - floor(v / p) * p - p / 2) AS d FROM f),
a AS (SELECT tic_id, c, any_value(p) AS p, any_value(e) AS e, count(CASE WHEN d < 0.1::DOUBLE THEN 1 END) AS n_in, count(CASE WHEN d >= 0.5::DOUBLE THEN 1 END) AS n_out, median(CASE WHEN d < 0.1::DOUBLE THEN x END) AS mi, median(CASE WHEN d >= 0.5::DOUBLE THEN x END) AS mo, 1.4826 * mad(CASE WHEN d >= 0.5::DOUBLE THEN x END) AS noise FROM h GROUP BY tic_id, c),
b AS (SELECT *, round((mo - mi) / noise * sqrt(n_in), 9) AS snr FROM a WHERE n_in >= 3 AND n_out >= 20 AND noise > 0), q AS (SELECT *, row_number() OVER (PARTITION BY tic_id ORDER BY snr DESC, c) AS k FROM b)
SELECT tic_id, 1 AS sector, round(p, 6) AS period_refined, round(e, 6) AS t0_refined, round(snr, 4) AS refinement_snr FROM q WHERE k = 1""")
def ephemeris_grid(spark, sf_dir):
    r = fitting.refine_ephemeris(injected(spark, sf_dir), "flux_norm")
    return rounded(r.withColumn("refinement_snr", F.round("refinement_snr", 4)))


@register(f"""WITH {INJ}, dd AS (SELECT tic_id, median(CASE WHEN NOT i THEN x END) - median(CASE WHEN i THEN x END) AS depth FROM s GROUP BY tic_id), a AS (SELECT tic_id, count(*) AS n, median(CASE WHEN abs(ph) < 0.05::DOUBLE THEN x END) AS c, count(CASE WHEN abs(ph) < 0.05::DOUBLE THEN 1 END) AS nc, median(CASE WHEN abs(ph) >= 0.05::DOUBLE AND abs(ph) < 0.1::DOUBLE THEN x END) AS h, count(CASE WHEN abs(ph) >= 0.05::DOUBLE AND abs(ph) < 0.1::DOUBLE THEN 1 END) AS nh,
median(CASE WHEN ph >= -0.1::DOUBLE AND ph < 0 THEN x END) AS l, count(CASE WHEN ph >= -0.1::DOUBLE AND ph < 0 THEN 1 END) AS nl, median(CASE WHEN ph > 0 AND ph <= 0.1::DOUBLE THEN x END) AS r, count(CASE WHEN ph > 0 AND ph <= 0.1::DOUBLE THEN 1 END) AS nr FROM s GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(CASE WHEN n >= 50 AND depth > 0 AND nc >= 3 AND nh >= 3 THEN (1 - h) / nullif(1 - c, 0) END, 5) AS v_shape_score, round(CASE WHEN n >= 50 AND depth > 0 AND nl >= 3 AND nr >= 3 THEN abs(l - r) / depth END, 5) AS transit_asymmetry FROM a JOIN dd USING (tic_id)""")
def transit_shape(spark, sf_dir):
    s = injected(spark, sf_dir)
    return rounded(fitting.shape(s, "flux_norm", series.depth_snr(s, "flux_norm")), 5)


@register(f"""WITH {INJ}, t AS (SELECT *, (time - t0) / period AS turn, least(greatest(4 * (duration / period), 0.03::DOUBLE), 0.2::DOUBLE) AS h, event - 2 * floor(event / 2) = 1 AS odd FROM s), u AS (SELECT *, turn - 0.0::DOUBLE + 0.5::DOUBLE AS a0, turn - 0.5::DOUBLE + 0.5::DOUBLE AS a5 FROM t), d AS (SELECT *, a0 - floor(a0 / 1.0::DOUBLE) * 1.0::DOUBLE - 0.5::DOUBLE AS d0, a5 - floor(a5 / 1.0::DOUBLE) * 1.0::DOUBLE - 0.5::DOUBLE AS d5 FROM u), e AS (SELECT *, abs(d0) > greatest(2 * h, 3 * duration / period) AS far FROM d),
m AS (SELECT tic_id, coalesce(median(CASE WHEN far THEN x END), median(x)) AS xm, count(CASE WHEN far THEN 1 END) AS nf, median(centroid_col) AS cm, median(centroid_row) AS rm, stddev_pop(centroid_col) AS cs, stddev_pop(centroid_row) AS rs FROM e GROUP BY tic_id), k AS (SELECT tic_id, CASE WHEN any_value(nf) >= 20 THEN median(CASE WHEN far THEN abs(x - xm) END) ELSE median(abs(x - xm)) END AS xd, median(abs(centroid_col - cm)) AS cd, median(abs(centroid_row - rm)) AS rd FROM e JOIN m USING (tic_id) GROUP BY tic_id),
z AS (SELECT tic_id, d0, d5, h, odd, greatest(least((x - xm) / CASE WHEN xd > 0 THEN xd * 1.4826::DOUBLE ELSE 1e-6 END, 20), -20) AS f, greatest(least((centroid_col - cm) / CASE WHEN cd > 0 THEN cd * 1.4826::DOUBLE WHEN cs > 0 THEN cs ELSE 1 END, 20), -20) AS cz, greatest(least((centroid_row - rm) / CASE WHEN rd > 0 THEN rd * 1.4826::DOUBLE WHEN rs > 0 THEN rs ELSE 1 END, 20), -20) AS rz FROM e JOIN m USING (tic_id) JOIN k USING (tic_id)),
v AS (SELECT tic_id, 'global_flux' AS view, d0 AS d, 0.5::DOUBLE AS h, 1001 AS n, f AS z FROM z UNION ALL SELECT tic_id, 'local_flux', d0, h, 401, f FROM z UNION ALL SELECT tic_id, 'secondary_flux', d5, h, 401, f FROM z UNION ALL SELECT tic_id, CASE WHEN odd THEN 'odd_flux' ELSE 'even_flux' END, d0, h, 401, f FROM z UNION ALL SELECT tic_id, 'centroid_col_local', d0, h, 401, cz FROM z UNION ALL SELECT tic_id, 'centroid_row_local', d0, h, 401, rz FROM z)
SELECT tic_id, 1 AS sector, view, bin, round(median(z), 4) AS value FROM (SELECT *, CAST(least(greatest(floor((d + h) / (2 * h) * n), 0), n - 1) AS BIGINT) AS bin FROM v) GROUP BY ALL""")
def folded_views(spark, sf_dir):
    return rounded(fitting.folded_views(injected(spark, sf_dir), "flux_norm"), 4)


@register("SELECT tic_id, sector, period, true_period, abs(period - true_period) / true_period <= 0.05 OR abs(2 * period - true_period) / true_period <= 0.05 AS recovered FROM (SELECT tic_id, sector, period, round(1.5::DOUBLE + (tic_id % 10) * 0.35::DOUBLE, 6) AS true_period FROM (" + SQL["best_box"] + "))")
def injection_recovery(spark, sf_dir):
    best = strongest(spark, sf_dir).select(*K, F.round("period", 6).alias("period")).withColumn("true_period", F.round(tables.true_period(F.col("tic_id")), 6))
    return rounded(fitting.recovery(best).select(*K, "period", "true_period", "recovered"))


def trained(spark, sf_dir):
    """Labelled candidates with held_out, and a model of the others."""
    given = labelled(spark, sf_dir).where("label IS NOT NULL").select("tic_id", "candidate_id", "label", *FEATURES)
    rows = tables.kept(models.hold_out(given, "label", F.col("candidate_id")), "labelled")
    return rows, models.train(rows.where("NOT held_out"), FEATURES)


@register()
def model_classes(spark, sf_dir):
    """Every candidate's class by the model, blended with the rules and bent by the evidence."""
    _, model = trained(spark, sf_dir)
    scored_rows = models.blend(catalog.rule_scores(models.predict(model, candidates(spark, sf_dir))))
    return catalog.decide(catalog.guardrails(scored_rows)).select("tic_id", "candidate_id", "model_class", "final_class", "confidence", "guard_warnings")


@register()
def model_counterfactuals(spark, sf_dir):
    rows, model = trained(spark, sf_dir)
    return models.counterfactuals(model, rows.where("held_out"), FEATURES, ["tic_id", "candidate_id"])


@register()
def vector_anomalies(spark, sf_dir):
    return models.anomalies(tables.read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "anomaly_score", "is_anomalous")


def cleaned(spark, sf_dir):
    """Injected observations by the flux chosen for each target, without high outliers, and what cleaning left."""
    obs = tables.inject(tables.observations(spark, sf_dir), tables.true_period(F.col("tic_id")))
    points, summary = series.cleaned(obs, "pdcsap")
    return points, tables.kept(summary.withColumn("crowdsap", 0.85 + (F.col("tic_id") % 10) / 100), "summary")


@register()
def end_to_end_catalog(spark, sf_dir):
    """Observations to the ranked catalog: cleaning, two searches over three detrendings, fits, evidence, rules, uncertainty."""
    clean, summary = cleaned(spark, sf_dir)
    found, variants = search.detect_twice(clean, {"0.50d": 0.5, "1.00d": 1.0, "2.00d": 2.0})
    return vetting.final_catalog(found, variants, summary)


@register()
def injection_grid(spark, sf_dir):
    """The grid of 37 signals put into every target and searched for, scored by kind."""
    return validation.injection_summary(tables.kept(injection.run(tables.observations(spark, sf_dir), injection.specs(spark)), "injections"))


@register(f"""WITH {INJ}, a AS (SELECT tic_id, median(CASE WHEN abs(ph) >= 0.5::DOUBLE THEN x END) AS m FROM s GROUP BY tic_id) SELECT s.tic_id, 1 AS sector, round(sqrt(avg((x - m) ^ 2)) * 1e6, 3) AS out_rms_ppm FROM s JOIN a USING (tic_id) WHERE abs(ph) >= 0.5::DOUBLE GROUP BY s.tic_id""")
def out_of_transit_rms(spark, sf_dir):
    return rounded(vetting.out_rms(injected(spark, sf_dir), "flux_norm"), 3)


@register(f"""WITH {INJ}, z AS (SELECT tic_id, x, CASE WHEN i THEN 'i' ELSE 'o' END AS side, row_number() OVER (PARTITION BY tic_id, i ORDER BY time, x) - 1 AS i, count(*) OVER (PARTITION BY tic_id, i) AS n FROM (SELECT * FROM s WHERE i OR abs(ph) >= 0.5::DOUBLE)),
d AS (SELECT tic_id, side, r, {series.DRAW} (SELECT tic_id, side, i, n, r FROM z, range(300) q(r))))))))), e AS (SELECT d.tic_id, r, median(CASE WHEN d.side = 'o' THEN x END) - median(CASE WHEN d.side = 'i' THEN x END) AS depth FROM d JOIN z ON z.tic_id = d.tic_id AND z.side = d.side AND z.i = d.place GROUP BY d.tic_id, r), c AS (SELECT tic_id, count(CASE WHEN side = 'i' THEN 1 END) AS ni, count(CASE WHEN side = 'o' THEN 1 END) AS no FROM z GROUP BY tic_id)
SELECT tic_id, 1 AS sector, round(stddev_samp(depth) * 1e6, 3) AS boot_err_ppm FROM e JOIN c USING (tic_id) WHERE ni >= 3 AND no >= 20 GROUP BY tic_id""")
def residual_bootstrap(spark, sf_dir):
    return rounded(vetting.residual_bootstrap(injected(spark, sf_dir), "flux_norm"), 3)


@register(f"""WITH {INJ}, p AS (SELECT *, abs(ph / period) AS c, 0.2::DOUBLE / (2 * period) AS half, 0.15::DOUBLE * 0.2::DOUBLE / (2 * period) AS ramp FROM s), m AS (SELECT *, CASE WHEN c < half - ramp THEN 1 - 0.003::DOUBLE WHEN c < half THEN 1 - 0.003::DOUBLE * greatest(least((half - c) / ramp, 1), 0) ELSE 1 END AS model FROM p) SELECT tic_id, 1 AS sector, round(sum(((x - model) / 0.0005::DOUBLE) ^ 2), 3) AS chi2, count(*) AS n FROM m GROUP BY tic_id""")
def trapezoid_fit(spark, sf_dir):
    s = injected(spark, sf_dir)
    model = fitting.trapezoid(F.col("time"), F.col("period"), F.col("t0"), F.col("duration"), F.sqrt(F.lit(0.003)))
    return rounded(fitting.chi_square(s, "flux_norm", model, F.lit(0.0005)), 3)


@register("""WITH x AS (SELECT s_suppkey, 3000 + (s_suppkey % 60) * 100e0 AS teff, 0.05 + (s_suppkey % 7) / 1e2 AS r, 0.7 + (s_suppkey % 5) / 2e1 AS light, 0.5 + (s_suppkey % 11) / 1e1 AS rad, 0.5 + (s_suppkey % 13) / 1e1 AS period FROM supplier), y AS (SELECT *, (least(greatest(teff, 3500), 8000) - 3500) / 4500 AS u, r * r / light AS depth, pow(6.674e-11 * rad * 1.989e30 * pow(period * 86400, 2) / (4 * pow(3.141592653589793::DOUBLE, 2)), 1 / 3e0) / (rad * 6.957e8) AS ax FROM x),
z AS (SELECT *, CASE WHEN ax >= 2 THEN ax ELSE 10 END AS a, sqrt(pow(2 * r * 0.002 / light, 2) + pow(r * r * 0.03 / (light * light), 2)) AS de FROM y) SELECT s_suppkey, round(0.5 - 0.3 * u, 6) AS u1, round(0.25 - 0.15 * u, 6) AS u2, round(a, 6) AS axis, round(depth, 9) AS depth, round(sqrt(depth) * rad * 109.076, 6) AS radius, round(109.076 * sqrt(pow(rad * de / (2 * sqrt(depth)), 2) + pow(sqrt(depth) * 0.05 * rad, 2)), 6) AS radius_err FROM z""")
def planet_geometry(spark, sf_dir):
    k = F.col("s_suppkey")
    s = tables.read(spark, sf_dir, "supplier").select("s_suppkey", (3000 + (k % 60) * 100.0).alias("teff"), (0.05 + (k % 7) / 100).alias("r"), (0.7 + (k % 5) / 20).alias("light"), (0.5 + (k % 11) / 10).alias("rad"), (0.5 + (k % 13) / 10).alias("period"))
    u1, u2 = fitting.limb_darkening(F.col("teff"))
    depth, radius, err = fitting.planet_radius(F.col("r"), F.lit(0.002), F.col("light"), F.col("rad"))
    return s.select("s_suppkey", F.round(u1, 6).alias("u1"), F.round(u2, 6).alias("u2"), F.round(fitting.scaled_axis(F.col("period"), F.col("rad"), F.col("rad")), 6).alias("axis"), F.round(depth, 9).alias("depth"), F.round(radius, 6).alias("radius"), F.round(err, 6).alias("radius_err"))
