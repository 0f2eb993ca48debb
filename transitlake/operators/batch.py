"""Runs over many targets: what is available, a ledger of every target's fate, resuming, and features for labels.

A ledger has one row for each target that was asked for, whatever became of it: each stage extends it
by a left join, so a target that fails stays, with the stage and the reason. Results and the ledger
are appended run by run, results first, under the run's name: rows of a run that never reached its
ledger are not read, and a second run anti-joins the ledger and does only what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..sources.tables import kept
from . import catalog, labels as L, search, series as S, vetting
from .series import K

#: Directories that a table of points is dealt to by target, so that a scan reads those of its targets.
PARTS = 64


def availability(targets: DataFrame, files: DataFrame, id_col: str = "tic_id") -> DataFrame:
    """targets with n_files and availability: `ok` if a file of theirs was read, `download_failed` if there are only failures, else `no_lightcurve`; error is the first failure's. files: (tic_id, status) with OK for one that was read."""
    c = F.col
    by = files.groupBy(c("tic_id").alias("_target")).agg(F.count(F.when(c("status") == "OK", 1)).alias("n_files"), F.min(F.when(c("status") != "OK", c("status"))).alias("_error"), F.count("*").alias("_all"))
    out = targets.join(by, c(id_col) == c("_target"), "left")
    status = F.when(c("n_files") > 0, "ok").when(c("_all") > 0, "download_failed").otherwise("no_lightcurve")
    return out.withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "availability": status, "error": F.when(status == "download_failed", c("_error"))}).drop("_target", "_all", "_error")


def availability_counts(manifest: DataFrame) -> DataFrame:
    """(availability, targets, files) of each of the three kinds, those that don't occur with 0."""
    kinds = manifest.sparkSession.createDataFrame([("ok",), ("no_lightcurve",), ("download_failed",)], "availability string")
    by = manifest.groupBy("availability").agg(F.count("*").alias("targets"), F.sum("n_files").alias("files"))
    return kinds.join(by, "availability", "left").na.fill(0, ["targets", "files"])


def part_of(tic: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(tic), F.lit(parts)).cast("int")


def save_points(obs: DataFrame, path: str, parts: int = PARTS) -> None:
    """Points in a directory for each `part` of targets."""
    obs.withColumn("part", part_of(F.col("tic_id"), parts)).repartition("part").write.partitionBy("part").parquet(path)


def scan(spark: SparkSession, path: str, manifest: DataFrame, parts: int = PARTS) -> DataFrame:
    """Points of the targets that are available: their parts are known only when the manifest is, so the scan is pruned as it runs."""
    wanted = manifest.where("availability = 'ok'").select("tic_id").distinct().withColumn("part", part_of(F.col("tic_id"), parts))
    wanted = kept(wanted, "wanted").where(F.col("part") < parts)  # stored, so its size is known; compared, so that the planner expects it to select
    return spark.read.parquet(path).join(wanted, ["tic_id", "part"], "left_semi").drop("part")


def preflight(targets: DataFrame, obs: DataFrame, files: DataFrame | None = None, least: int = 500) -> DataFrame:
    """targets (K) with n_raw, n_final, stage, status and reason: whether each can be searched. A target without points is missing, or unreadable if its file (tic_id, status) says so; one with under `least` points after cleaning, or none, stops at cleaning."""
    c = F.col
    out = targets.select(*K).distinct()
    facts = S.quality_summary(obs.join(out, K, "left_semi")).select(*K, "n_raw", "n_final")
    out = out.join(facts, K, "left").na.fill(0, ["n_raw", "n_final"])
    if files is not None:
        bad = files.where("status <> 'OK'").groupBy("tic_id").agg(F.min("status").alias("_file"))
        out = out.join(bad, "tic_id", "left")
    else:
        out = out.withColumn("_file", F.lit(None).cast("string"))
    status = F.when((c("n_raw") == 0) & c("_file").isNotNull(), "UNREADABLE").when(c("n_raw") == 0, "NO_OBSERVATIONS").when(c("n_final") == 0, "NO_VALID_POINTS_AFTER_MASKING").when(c("n_final") < least, "TOO_FEW_CLEAN_POINTS").otherwise("OK")
    stage = F.when(c("n_raw") == 0, "load").when(c("n_final") < least, "clean").otherwise("search")
    reason = F.when(status == "UNREADABLE", c("_file")).when(stage == "clean", F.concat_ws(" ", c("n_final").cast("string"), F.lit("of"), c("n_raw").cast("string"), F.lit("points left")))
    return out.withColumns({"stage": stage, "status": status, "reason": reason}).drop("_file")


def attempted(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], pa.Table], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of an Arrow kernel over groups: a group that it fails on is a row (keys, error), and the others have theirs. schema names what the kernel returns besides the keys."""
    kinds = dict(df.dtypes)
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}

    def run(t: pa.Table) -> pa.Table:
        own = lambda n: [pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in keys]
        try:
            out = kernel(t)
            return pa.Table.from_arrays([*own(out.num_rows), *(out.column(n).cast(t) for n, t in types.items()), pa.nulls(out.num_rows, pa.string())], [*keys, *types, "_error"])
        except Exception as error:  # of any kind: it is the group's result
            return pa.Table.from_arrays([*own(1), *(pa.nulls(1, t) for t in types.values()), pa.array([f"{type(error).__name__}: {error}"])], [*keys, *types, "_error"])

    done = kept(df.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {schema}, _error string"), "attempted")
    return done.where("_error IS NULL").drop("_error"), done.where("_error IS NOT NULL").select(*keys, F.col("_error").alias("error"))


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not be there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def results(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(ledger, candidates) of all runs under path that reached their ledger; None before the first."""
    ledger = written(spark, f"{path}/ledger")
    if ledger is None:
        return None, None
    rows = written(spark, f"{path}/candidates")
    return ledger, rows if rows is None else rows.join(ledger.select("run").distinct(), "run", "left_semi")


def run(targets: DataFrame, obs: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], files: DataFrame | None = None, least: int = 500, stop: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ledger, candidates) of the targets (K), those of earlier runs included.

    process gets the points of targets that can be searched and returns candidates with the columns K,
    and a column error, if it has any, which is null but for targets that failed (their other columns
    are not read). Only targets without a row in the ledger are looked at: without any, nothing is
    read but the ledger. With `stop`, a failure of this run raises when the ledger is written.
    """
    spark, c = targets.sparkSession, F.col
    ledger, _ = results(spark, path)
    todo = targets.select(*K).distinct()
    if ledger is not None:
        todo = catalog.pending(todo, ledger, K)
    todo = kept(todo, "todo")
    if todo.isEmpty():
        return results(spark, path)
    name = uuid.uuid4().hex
    before = kept(preflight(todo, obs, files, least), "preflight")
    found = process(obs.join(before.where("status = 'OK'").select(*K), K, "left_semi"))
    if "error" not in found.columns:
        found = found.withColumn("error", F.lit(None).cast("string"))
    found = kept(found, "found")
    found.where("error IS NULL").drop("error").withColumn("run", F.lit(name)).write.mode("append").parquet(f"{path}/candidates")
    per = found.groupBy(*K).agg(F.count(F.when(c("error").isNull(), 1)).alias("n_candidates"), F.min("error").alias("error"))
    out = before.join(per, K, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    failed = c("error").isNotNull()
    out = out.withColumns({
        "stage": F.when(c("status") != "OK", c("stage")).when(failed, "search").otherwise("done"), "reason": F.when(failed, c("error")).otherwise(c("reason")), "run": F.lit(name),
        "status": F.when(c("status") != "OK", c("status")).when(failed, "FAILED").when(c("n_candidates") == 0, "NO_CANDIDATES").otherwise("OK"),
    })
    out.select(*K, "n_raw", "n_final", "n_candidates", "stage", "status", "reason", "run").write.mode("append").parquet(f"{path}/ledger")
    ledger, candidates = results(spark, path)
    if stop and (bad := failures(ledger.where(c("run") == name)).orderBy(*K).first()):
        raise RuntimeError(f"target {bad.tic_id}, sector {bad.sector}: {bad.status} {bad.reason or ''}".strip())
    return ledger, candidates


def failures(ledger: DataFrame) -> DataFrame:
    """The failure log: (K, stage, status, reason) of targets that did not get through."""
    return ledger.where("status NOT IN ('OK', 'NO_CANDIDATES')").select(*K, "stage", "status", "reason")


def counted(ledger: DataFrame) -> DataFrame:
    """(status, targets, candidates) of each status, and under null for all: one row even of an empty ledger."""
    facts = [F.count("*").alias("targets"), F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("candidates")]
    return ledger.groupBy("status").agg(*facts).unionByName(ledger.agg(F.lit(None).cast("string").alias("status"), *facts))


def planned(labels: DataFrame, files: DataFrame, label_col: str = "label", most: int = 1, ignore: bool = False) -> DataFrame:
    """What is to be done for each row of labels: (source_row, tic_id, label, path, period, t0, duration, depth, plan).

    plan is missing_tic_or_label, missing_lightcurve, unreadable, ephemeris (the row has a period, an
    epoch and a duration, unless they are to be ignored) or search. labels: source_row, tic_id, the
    label and ephemeris columns (of `labels.seeded`); files: (path, tic_id, status). A label has its first `most` files.
    """
    c = F.col
    from pyspark.sql import Window

    own = files.select(c("tic_id").alias("_target"), "path", "status").withColumn("_k", F.row_number().over(Window.partitionBy("_target").orderBy("path"))).where(c("_k") <= most).drop("_k")
    rows = labels.select("source_row", C.finite(c("tic_id")).cast("long").alias("tic_id"), L.first_text(c(label_col).cast("string")).alias("label"), *[C.finite(c(x)).alias(x) for x in ("period", "t0", "duration", "depth")])
    rows = rows.join(own, c("tic_id") == c("_target"), "left").drop("_target")
    given = (c("period") > 0) & c("t0").isNotNull() & (c("duration") > 0) & F.lit(not ignore)
    plan = F.when(c("tic_id").isNull() | c("label").isNull(), "missing_tic_or_label").when(c("path").isNull(), "missing_lightcurve").when(c("status") != "OK", "unreadable").when(F.coalesce(given, F.lit(False)), "ephemeris").otherwise("search")
    return rows.withColumns({"plan": plan, "depth": F.when(c("depth") > 0, c("depth")).otherwise(1e-3)})


def cleaned(going: DataFrame, obs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what cleaning leaves of each series, its status, the cleaned points of those that have enough) of the targets that are going, over one scan of the points."""
    c = F.col
    mine = kept(obs.join(going.select("tic_id").distinct(), "tic_id", "left_semi"), "points")
    points, summary = S.cleaned(mine)
    summary = kept(summary, "summary")
    state = summary.select(*K, F.when(c("n_final") == 0, "NO_VALID_POINTS_AFTER_MASKING").when(c("n_final") < least, "TOO_FEW_CLEAN_POINTS").otherwise("OK").alias("cleaning"))
    points = points.join(state.where("cleaning = 'OK'").select(*K), K, "left_semi")
    return summary, state, kept(points.select(*S.POINTS), "cleaned")


def seeds(going: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates by the ephemeris of rows that are going, one for each series of theirs that cleaning left enough of. Their ids are below zero: -1 less source_row."""
    c = F.col
    return going.join(state.where("cleaning = 'OK'").select(*K), "tic_id").select(
        *K, (-1 - c("source_row")).alias("candidate_id"), F.lit("seeded").alias("variant"), "period", "t0", "duration", c("depth").alias("depth_fraction"), F.lit("curated_ephemeris_seed").alias("method"), F.lit("STRONG_DETECTION").alias("status"),
        F.lit(None).cast("double").alias("sde"), F.lit(False).alias("alias"), F.lit(None).cast("double").alias("local_snr"), F.lit(0).cast("long").alias("n_transits"), F.lit(0).cast("long").alias("n_full"),
    )


def labelled(labels: DataFrame, files: DataFrame, obs: DataFrame, label_col: str = "label", every: bool = False, ignore: bool = False, least: int = 500, replicates: int = 80, **settings) -> tuple[DataFrame, DataFrame]:
    """(features, manifest) of labelled targets: two branches over one cleaned and detrended scan of the points.

    Rows with an ephemeris seed a candidate from it; for others the search's best candidate stands (by
    the largest of fit_snr and local_snr; with `every`, all of them). Both branches are fitted, vetted
    and classed together. features carries source_row, label and feature_source (curated_ephemeris or
    detected_candidate); manifest has one row for each of labels' rows and files, with its status:
    those of `planned` that stop there, the status of cleaning, no_detected_candidate, ok_ephemeris or ok_detected.
    """
    c = F.col
    plan = kept(planned(labels, files, label_col, ignore=ignore), "planned")
    going = plan.where("plan IN ('ephemeris', 'search')")
    summary, state, clean = cleaned(going, obs, least)
    seeded = going.where("plan = 'ephemeris'")
    searched = clean.join(going.where("plan = 'search'").select("tic_id").distinct(), "tic_id", "left_semi")
    found, series_found = search.detect_twice(searched, {"detected": 1.0}, **settings)
    series_seeded = S.detrend(clean.join(seeded.select("tic_id").distinct(), "tic_id", "left_semi")).withColumn("variant", F.lit("seeded"))
    given = seeds(seeded, state)
    both = given.unionByName(found.select(*[c(x).cast(t).alias(x) for x, t in given.dtypes]))  # seeds below zero, detected from 1
    facts = kept(vetting.measured(both, kept(series_seeded.unionByName(series_found.select(*series_seeded.columns)), "variants"), summary, replicates=replicates), "features")
    score = F.greatest(*[F.coalesce(C.finite(c(x)), F.lit(float("-inf"))) for x in ("fit_snr", "local_snr")])
    from pyspark.sql import Window

    best = facts.where("candidate_id > 0").withColumn("_k", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc(score), "candidate_id")))
    best = (best if every else best.where("_k = 1")).drop("_k")
    a = facts.where("candidate_id < 0").withColumn("source_row", -1 - c("candidate_id")).join(seeded.select("source_row", "label", "path"), "source_row").withColumn("feature_source", F.lit("curated_ephemeris"))
    b = best.join(going.where("plan = 'search'").select("source_row", "tic_id", "label", "path"), "tic_id").withColumn("feature_source", F.lit("detected_candidate"))
    features = kept(a.unionByName(b), "labelled")
    n = features.groupBy("source_row").agg(F.count("*").alias("n_rows"))
    worst = state.groupBy("tic_id").agg(F.max(F.when(c("cleaning") != "OK", c("cleaning"))).alias("cleaning"))
    out = plan.join(n, "source_row", "left").join(worst, "tic_id", "left")
    status = F.when(~c("plan").isin("ephemeris", "search"), c("plan")).when((c("n_rows") > 0) & (c("plan") == "ephemeris"), "ok_ephemeris").when(c("n_rows") > 0, "ok_detected").otherwise(F.coalesce("cleaning", F.when(c("plan") == "search", "no_detected_candidate").otherwise("no_points")))
    return features, out.select("source_row", "tic_id", "label", "path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))
