"""Registered queries of runs over many targets, and their DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import batch, examples, labels, models, series
from ..sources import tables
from . import fitted  # its folded views are the SQL of examples
from .registered import CAND, INJ, K, OBS, SQL, candidates, injected, labelled, register, rounded, CAND_SQL, LABELLED

TARGETS = "t AS (SELECT c_custkey - 1 AS tic_id, 1 AS sector FROM customer)"
FILES = "f AS (SELECT page_id AS tic_id, 'page_' || page_id || '.fits' AS path, CASE WHEN page_id % 5 = 3 THEN 'UNREADABLE: ' || coalesce(CAST(length(html) AS VARCHAR), 'empty') ELSE 'OK' END AS status FROM pages)"
MANIFEST = f"{TARGETS}, {FILES}, g AS (SELECT tic_id, count(CASE WHEN status = 'OK' THEN 1 END) AS n, min(CASE WHEN status <> 'OK' THEN status END) AS e FROM f GROUP BY tic_id), man AS (SELECT t.tic_id, coalesce(n, 0) AS n_files, CASE WHEN n > 0 THEN 'ok' WHEN n = 0 THEN 'download_failed' ELSE 'no_lightcurve' END AS availability, CASE WHEN n = 0 THEN e END AS error FROM t LEFT JOIN g USING (tic_id))"
#: Some targets have a third of their points, some no centroid.
THIN = " WHERE NOT (CAST(floor(user_id / 15) AS BIGINT) % 4 = 1 AND event_id % 3 <> 0)"


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("tic_id"), F.lit(1).alias("sector"))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "pages")
    bad = F.concat(F.lit("UNREADABLE: "), F.coalesce(F.length("html").cast("string"), F.lit("empty")))
    return p.select(F.col("page_id").alias("tic_id"), F.format_string("page_%d.fits", "page_id").alias("path"), F.when(F.col("page_id") % 5 == 3, bad).otherwise("OK").alias("status"))


@register(f"WITH {MANIFEST} SELECT * FROM man")
def availability_manifest(spark, sf_dir):
    """Which of the targets have a light curve."""
    return rounded(batch.availability(targets_of(spark, sf_dir), files_of(spark, sf_dir)).drop("sector"))


@register(f"WITH {MANIFEST}, k AS (SELECT unnest(['ok', 'no_lightcurve', 'download_failed']) AS availability) SELECT availability, count(tic_id) AS targets, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS files FROM k LEFT JOIN man USING (availability) GROUP BY availability")
def availability_counts(spark, sf_dir):
    return rounded(batch.availability_counts(batch.availability(targets_of(spark, sf_dir), files_of(spark, sf_dir))))


@register(f"WITH {OBS}, {MANIFEST} SELECT tic_id, count(*) AS n_points, round(median(pdcsap_flux), 6) AS median_flux FROM obs JOIN man USING (tic_id) WHERE availability = 'ok' GROUP BY tic_id")
def available_points(spark, sf_dir):
    """Points dealt to directories by target, and those of available targets read back."""
    path = tables.scratch(spark, "points")
    batch.save_points(tables.observations(spark, sf_dir), path)
    points = batch.scan(spark, path, batch.availability(targets_of(spark, sf_dir), files_of(spark, sf_dir)))
    return rounded(points.groupBy("tic_id").agg(F.count("*").alias("n_points"), F.median("pdcsap_flux").alias("median_flux")))


def dips(points: DataFrame) -> DataFrame:
    """Candidates of targets at the periods that are known for them; one without a centroid fails."""
    s = series.normalise(points).withColumns({"period": F.col("true_period"), "t0": F.col("true_t0"), "duration": F.col("true_duration")})

    def centroid(t: pa.Table) -> pa.Table:
        middle = pc.mean(t.column("centroid_col")).as_py()
        if middle is None:
            raise ValueError("no centroid")
        return pa.table({"centroid": [middle]})

    good, bad = batch.attempted(s.select(*K, "centroid_col"), K, centroid, "centroid double")
    found = series.depth_snr(s, "flux_norm").join(good, K).where("snr >= 7").select(*K, "depth", "snr", F.lit(None).cast("string").alias("error"))
    return found.unionByName(bad, allowMissingColumns=True)


@register(f"""WITH {INJ.replace("FROM events)", f"FROM events{THIN})")}, {TARGETS}, {FILES}, k AS (SELECT tic_id, x, quality & {series.MASKS["conservative"]} = 0 AS good FROM s), m AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sig FROM k WHERE good GROUP BY tic_id),
q AS (SELECT tic_id, count(*) AS n_raw, count(CASE WHEN good AND NOT x > med + 7 * sig THEN 1 END) AS n_final FROM k JOIN m USING (tic_id) GROUP BY tic_id), b AS (SELECT tic_id, min(status) AS why FROM f WHERE status <> 'OK' GROUP BY tic_id),
a AS (SELECT tic_id, count(CASE WHEN i THEN 1 END) AS n_in, count(CASE WHEN NOT i THEN 1 END) AS n_out, median(CASE WHEN NOT i THEN x END) - median(CASE WHEN i THEN x END) AS depth, mad(CASE WHEN NOT i THEN x END) * 1.4826 AS sg FROM s GROUP BY tic_id),
l AS (SELECT t.tic_id, t.sector, coalesce(n_raw, 0) AS n_raw, coalesce(n_final, 0) AS n_final, why, coalesce(n_in >= 3 AND n_out >= 20 AND depth / sg * sqrt(n_in) >= 7, false) AS dip FROM t LEFT JOIN q USING (tic_id) LEFT JOIN b USING (tic_id) LEFT JOIN a USING (tic_id)),
r AS (SELECT *, CASE WHEN n_raw = 0 AND why IS NOT NULL THEN 'UNREADABLE' WHEN n_raw = 0 THEN 'NO_OBSERVATIONS' WHEN n_final = 0 THEN 'NO_VALID_POINTS_AFTER_MASKING' WHEN n_final < 500 THEN 'TOO_FEW_CLEAN_POINTS' WHEN tic_id % 10 = 6 THEN 'FAILED' WHEN NOT dip THEN 'NO_CANDIDATES' ELSE 'OK' END AS status FROM l)
SELECT tic_id, sector, n_raw, n_final, CAST(status = 'OK' AS BIGINT) AS n_candidates, CASE WHEN n_raw = 0 THEN 'load' WHEN n_final < 500 THEN 'clean' WHEN status = 'FAILED' THEN 'search' ELSE 'done' END AS stage, status, CASE WHEN status = 'UNREADABLE' THEN why WHEN status = 'FAILED' THEN 'ValueError: no centroid' WHEN n_raw > 0 AND n_final < 500 THEN n_final || ' of ' || n_raw || ' points left' END AS reason FROM r""")
def batch_ledger(spark, sf_dir):
    """The ledger of a run over all targets, of which half had been done before."""
    e = tables.observations(spark, sf_dir).where(~((F.col("tic_id") % 4 == 1) & (F.col("cadence") % 3 != 0)))
    obs = tables.inject(e, tables.true_period(F.col("tic_id"))).withColumn("centroid_col", F.when(F.col("tic_id") % 10 != 6, F.col("centroid_col")))
    targets, files, path = targets_of(spark, sf_dir), files_of(spark, sf_dir), tables.scratch(spark, "batch")
    batch.run(targets.where("tic_id % 2 = 0"), obs, path, dips, files)
    ledger, _ = batch.run(targets, obs, path, dips, files)
    return rounded(ledger.drop("run"))


#: Labels with and without a target, a name, a file and an ephemeris.
LABELS = "lb AS (SELECT p_partkey AS source_row, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 150 END AS tic_id, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS label, CASE WHEN p_partkey % 3 <> 0 THEN 1.5e0 + (p_partkey % 150 % 10) * 0.35e0 END AS period, CASE WHEN p_partkey % 7 <> 0 THEN 0.4e0 END AS t0, 0.2e0 AS duration FROM part)"


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = tables.read(spark, sf_dir, "part")
    return p.select(
        k.alias("source_row"), F.when(k % 13 != 0, k % 150).alias("tic_id"), F.when(k % 11 == 0, " ").when(k % 17 == 0, None).otherwise(F.col("p_type")).alias("label"),
        F.when(k % 3 != 0, 1.5 + (k % 150 % 10) * 0.35).alias("period"), F.when(k % 7 != 0, F.lit(0.4)).alias("t0"), F.lit(0.2).alias("duration"), F.lit(None).cast("double").alias("depth"),
    )


@register(f"WITH {FILES}, {LABELS} SELECT source_row, lb.tic_id, CASE WHEN trim(label) <> '' THEN trim(label) END AS label, path, CASE WHEN lb.tic_id IS NULL OR label IS NULL OR trim(label) = '' THEN 'missing_tic_or_label' WHEN path IS NULL THEN 'missing_lightcurve' WHEN status <> 'OK' THEN 'unreadable' WHEN period > 0 AND t0 IS NOT NULL THEN 'ephemeris' ELSE 'search' END AS plan FROM lb LEFT JOIN f ON f.tic_id = lb.tic_id")
def label_plan(spark, sf_dir):
    """What is to be done for each labelled row."""
    return rounded(batch.planned(labels_of(spark, sf_dir), files_of(spark, sf_dir)).select("source_row", "tic_id", "label", "path", "plan"))


@register()
def label_features(spark, sf_dir):
    """Features of labelled targets, from their ephemeris or from a search of their series. Labels: one for each target of two sorts."""
    obs = tables.inject(tables.observations(spark, sf_dir), tables.true_period(F.col("tic_id")))
    ids = obs.select("tic_id").distinct()
    rows = ids.select(F.col("tic_id").alias("source_row"), "tic_id", F.when(F.col("tic_id") % 5 == 4, "").otherwise("planet").alias("label"), F.when(F.col("tic_id") % 2 == 0, tables.true_period(F.col("tic_id"))).alias("period"), F.lit(0.4).alias("t0"), F.lit(0.2).alias("duration"), F.lit(None).cast("double").alias("depth"))
    files = ids.where("tic_id % 7 <> 3").select("tic_id", F.format_string("%d.fits", "tic_id").alias("path"), F.lit("OK").alias("status"))
    features, manifest = batch.labelled(rows, files, obs)
    return manifest.join(features.groupBy("source_row").agg(F.max("fit_snr").alias("fit_snr"), F.max("class_predicted_class").alias("rule_class")), "source_row", "left").select("source_row", "tic_id", "label", "status", "n_rows", F.round("fit_snr", 6).alias("fit_snr"), "rule_class")


#: What the table's columns are worth to a model.
USED = ["depth_ppm", "snr", "sde", "secondary_sigma", "crowding", "period_days", "n_transits"]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a column of text, one of nulls, one of numbers as text, and one that its name excludes."""
    c = labelled(spark, sf_dir).select("candidate_id", "label", *USED)
    return c.withColumns({"remark": F.lit("none"), "empty": F.lit(None).cast("double"), "as_text": F.col("snr").cast("string"), "snr_status": F.col("snr"), "endless": F.lit(float("inf"))})


@register(f"WITH {LABELLED} SELECT unnest(['snr', 'depth_ppm', 'sde', 'secondary_sigma', 'crowding', 'period_days', 'n_transits', 'as_text']) AS feature, unnest(range(8)) AS place, (SELECT count(*) FROM lab) AS rows")
def inferred_features(spark, sf_dir):
    """Which columns a model may learn from: two preferred ones first, then others in their order."""
    df = wide(spark, sf_dir)
    names = models.infer_features(df, preferred=["snr", "depth_ppm", "absent", "empty"])
    return rounded(spark.createDataFrame(list(enumerate(names)), "place long, feature string").crossJoin(df.agg(F.count("*").alias("rows"))))  # a row a column


@register(f"WITH {LABELLED} SELECT label, count(*) AS n, round(avg(snr), 6) AS snr, round(avg(sde), 6) AS sde, 'FEATURE_WITHOUT_VALUES:empty;FEATURE_WITHOUT_VALUES:absent' AS warnings FROM lab WHERE label IS NOT NULL GROUP BY label")
def model_rows(spark, sf_dir):
    """What a model learns from: rows of known classes, features as numbers, those without any left out."""
    df = wide(spark, sf_dir).withColumn("label", F.when(F.col("label").isNull(), "no such class").otherwise(F.lower("label")))
    rows, used, warned = models.model_frame(df, ["snr", "sde", "empty", "absent"])
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in used]).withColumn("warnings", F.lit(";".join(warned))))


@register(f"""WITH {OBS}, o AS (SELECT * EXCLUDE (pdcsap_flux, sap_flux), CASE WHEN tic_id % 5 IN (2, 3) AND cadence % 10 < 7 THEN NULL ELSE pdcsap_flux END AS p, CASE WHEN tic_id % 5 = 3 AND cadence % 10 < 8 THEN -1e0 ELSE sap_flux END AS q FROM obs),
v AS (SELECT tic_id, count(*) AS n_raw, count(CASE WHEN p > 0 THEN 1 END) >= 0.5 * count(*) AND median(CASE WHEN p > 0 THEN p END) > 0 AND mad(CASE WHEN p > 0 THEN p END) > 0 AS vp, count(CASE WHEN q > 0 THEN 1 END) >= 0.5 * count(*) AND median(CASE WHEN q > 0 THEN q END) > 0 AND mad(CASE WHEN q > 0 THEN q END) > 0 AS vq FROM o GROUP BY tic_id),
f AS (SELECT tic_id, quality, CASE WHEN vp THEN p ELSE q END AS flux FROM o JOIN v USING (tic_id) WHERE vp OR vq), n AS (SELECT tic_id, quality, CASE WHEN flux > 0 THEN flux END / median(CASE WHEN flux > 0 THEN flux END) OVER (PARTITION BY tic_id) AS x FROM f), k AS (SELECT * FROM n WHERE x > 0 AND quality & {series.MASKS["conservative"]} = 0),
m AS (SELECT tic_id, median(x) AS med, 1.4826 * mad(x) AS sig FROM k GROUP BY tic_id), l AS (SELECT tic_id, count(CASE WHEN NOT x > med + 7 * sig THEN 1 END) AS n_final FROM k JOIN m USING (tic_id) GROUP BY tic_id), z AS (SELECT v.*, coalesce(n_final, 0) AS n_final, CASE WHEN vp THEN 'PDCSAP' WHEN vq THEN 'SAP' ELSE 'NONE' END AS flux_source FROM v LEFT JOIN l USING (tic_id))
SELECT tic_id, 1 AS sector, flux_source, n_raw, n_final, round(CASE WHEN flux_source <> 'NONE' THEN 1 - n_final / n_raw END, 6) AS removed_fraction, CASE WHEN flux_source = 'NONE' THEN 'NO_VALID_FLUX' WHEN n_final = 0 THEN 'NO_VALID_POINTS_AFTER_MASKING' WHEN n_final < 500 THEN 'TOO_FEW_CLEAN_POINTS' ELSE 'OK' END AS status,
concat_ws(';', CASE WHEN flux_source = 'SAP' THEN 'PDCSAP_UNAVAILABLE_OR_INVALID_USED_SAP' END, CASE WHEN flux_source <> 'NONE' AND 1 - n_final / n_raw > 0.6 THEN 'HIGH_REMOVED_FRACTION' END) AS warnings FROM z""")
def preprocessed_targets(spark, sf_dir):
    """Which flux each target is searched by, and what cleaning leaves of it."""
    c = F.col
    o = tables.observations(spark, sf_dir).withColumns({"pdcsap_flux": F.when((c("tic_id") % 5).isin(2, 3) & (c("cadence") % 10 < 7), None).otherwise(c("pdcsap_flux")), "sap_flux": F.when((c("tic_id") % 5 == 3) & (c("cadence") % 10 < 8), -1.0).otherwise(c("sap_flux"))})
    return rounded(series.preprocessed(o)[1])


#: The numbers beside views that the candidate table has, as it calls them.
HELD = {n: n if n in CAND else examples.OWN[n] for n in examples.SCALARS if n in CAND or examples.OWN.get(n) in CAND} | {"depth_fraction": "depth_ppm / 1e6"}


@register(f"WITH {CAND_SQL} SELECT candidate_id, " + ", ".join(f"round(CAST({HELD.get(n, 'NULL')} AS DOUBLE), 6) AS {n}" for n in examples.SCALARS) + " FROM cand")
def view_scalars(spark, sf_dir):
    """The numbers beside a candidate's views, from a catalog under other names and without some of them."""
    return rounded(examples.scalar_row(candidates(spark, sf_dir)).select("candidate_id", *examples.SCALARS))


VIEWS = ["global_flux", *examples.LOCAL]


@register(f"""WITH f AS ({SQL["folded_views"].replace("round(median(z), 4)", "CAST(median(z) AS FLOAT)")}), t AS (SELECT DISTINCT tic_id, sector FROM f), n AS (SELECT unnest({VIEWS!r}) AS view, unnest([1001, 401, 401, 401, 401, 401, 401]) AS size)
SELECT tic_id, sector, view, CAST(size AS BIGINT) AS size, count(bin) AS filled, CAST(coalesce(sum(bin), 0) AS BIGINT) AS places, round(coalesce(min(value), 0)::DOUBLE, 4) AS low, round(coalesce(max(value), 0)::DOUBLE, 4) AS high FROM t CROSS JOIN n LEFT JOIN f USING (tic_id, sector, view) GROUP BY ALL""")
def view_examples(spark, sf_dir):
    """Examples of every target, written and read back: what each view holds."""
    s = injected(spark, sf_dir)
    path = tables.scratch(spark, "examples")
    examples.save_examples(examples.examples(s, s.select(*K).distinct(), "flux_norm"), path)
    views = F.concat(F.array(F.struct(F.col("global_value").alias("value"), F.col("global_mask").alias("mask"))), F.arrays_zip(F.col("local_value").alias("value"), F.col("local_mask").alias("mask")))
    df = examples.read_examples(spark, path).select(*K, F.posexplode(views).alias("place", "v")).withColumn("view", F.get(F.array(*map(F.lit, VIEWS)), "place"))
    bins = F.filter(F.sequence(F.lit(0), F.size("v.mask") - 1), lambda i: F.get("v.mask", i) == 1)
    held = F.transform("bins", lambda i: F.get("v.value", i).cast("double"))
    df = df.withColumn("bins", bins).withColumn("held", held)
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, i: a + i)
    return rounded(df.select(*K, "view", F.size("v.value").alias("size"), F.size("bins").alias("filled"), total.alias("places"), F.coalesce(F.array_min("held"), F.lit(0.0)).alias("low"), F.coalesce(F.array_max("held"), F.lit(0.0)).alias("high")), 4)


@register()
def label_examples(spark, sf_dir):
    """Examples of labelled targets, and what became of each labelled row: some have no file, no ephemeris, one label of two or none."""
    c = F.col
    obs = tables.inject(tables.observations(spark, sf_dir), tables.true_period(c("tic_id")))
    ids = obs.select("tic_id").distinct()
    rows = ids.select(
        c("tic_id").alias("source_row"), "tic_id", F.when(c("tic_id") % 3 != 0, "PLANETARY_TRANSIT_CANDIDATE").alias("canonical_label"), F.when(c("tic_id") % 2 == 0, "planet").alias("binary_label"),
        F.when(c("tic_id") % 5 != 4, tables.true_period(c("tic_id"))).alias("period"), F.lit(0.4).alias("t0"), F.lit(0.2).alias("duration"), F.lit(None).cast("double").alias("depth"),
    )
    files = ids.where("tic_id % 7 <> 3").select("tic_id", F.format_string("%d.fits", "tic_id").alias("path"), F.lit("OK").alias("status"))
    made, manifest = examples.labelled_examples(rows, files, obs)
    filled = F.aggregate("global_mask", F.lit(0.0), lambda a, x: a + x)
    facts = made.select("source_row", "canonical_label", "binary_label", filled.alias("filled"), F.round("seen_fit_snr", 6).alias("fit_snr"), F.size("scalars").alias("n_scalars"), c("seen_class_predicted_class").alias("rule_class"))
    return manifest.join(facts, "source_row", "left")
