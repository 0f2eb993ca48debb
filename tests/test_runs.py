"""Runs over many targets, exact quantiles, resampling, long series."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import batch, models, search, selection, series, validation
from transitlake.operators.series import K
from transitlake.plans import fitted, registered  # noqa: F401 (both register their own)
from transitlake.sources import archives, tables

SF = "/root/testdata/sf0.001"


def made(spark, n, targets=1, seed=1, depth=0.0, period=2.0):
    """Brightness of a few targets, of n points each over 27 days."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(targets):
        t = np.sort(rng.uniform(0, 27, n))
        x = 1e5 * (1 + 1e-3 * rng.normal(size=n))
        x[np.abs((t - 0.4 + period / 2) % period - period / 2) < 0.1] *= 1 - depth
        rows += [(k, 1, i, float(a), float(b), float(b), 0, 100.0, 100.0) for i, (a, b) in enumerate(zip(t, x))]
    return spark.createDataFrame(rows, "tic_id long, sector int, cadence long, time double, pdcsap_flux double, sap_flux double, quality int, centroid_col double, centroid_row double")


def test_filling_a_long_series_is_linear(spark):
    s = spark.range(100_000).select(F.lit(1).alias("tic_id"), F.lit(1).alias("sector"), F.col("id").cast("double").alias("time"), F.when(F.col("id") % 5 == 2, F.col("id") * 2.0).alias("v"))
    began = time.time()
    got = series.interpolate(s, "v").agg(F.sum("v").alias("v"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    assert time.time() - began < 20
    assert got.n == 100_000 and got.low == 4.0 and got.high == 2.0 * 99_997
    want = np.interp(np.arange(100_000), np.arange(2, 100_000, 5), 2.0 * np.arange(2, 100_000, 5)).sum()
    assert got.v == pytest.approx(want)


def test_filling_keeps_values_that_share_a_time(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 1, 1.0, 5.0), (1, 1, 1.0, 7.0), (1, 1, 1.0, None), (1, 1, 2.0, None), (1, 1, 3.0, 9.0), (2, 1, 0.0, None)], "tic_id int, sector int, time double, v double")
    got = sorted((r.tic_id, r.time, r.v) for r in series.interpolate(s, "v").where("v IS NOT NULL").collect())
    assert [x for x in got if x[1] != 1.0] == [(1, 0.0, 1.0), (1, 2.0, pytest.approx(8.0, abs=1.0)), (1, 3.0, 9.0)]
    assert {5.0, 7.0} <= {v for _, t, v in got if t == 1.0} <= {5.0, 7.0}


@pytest.mark.parametrize("n", [8, 200, 1000])
def test_resampling_is_with_replacement(n):
    x = np.random.default_rng(n).normal(size=n)
    own = series.resampled(x, 2000)
    true = np.median(np.random.default_rng(0).choice(x, (2000, n)), axis=1)
    assert 0.85 < own.std(ddof=1) / true.std(ddof=1) < 1.15
    places = series.drawn(np.arange(500), n)
    assert places.min() >= 0 and places.max() == n - 1
    share = np.mean([len(set(p)) / n for p in places])  # of a sample's places, the share that differ
    assert share == pytest.approx(1 - (1 - 1 / n) ** n, abs=0.02)
    assert abs(np.bincount(places.ravel(), minlength=n) / 500 - 1).mean() < 0.06


def test_error_of_a_depth_is_that_of_medians(spark):
    s = made(spark, 2000, depth=0.003).withColumns({"flux_norm": F.col("pdcsap_flux") / 1e5, "period": F.lit(2.0), "t0": F.lit(0.4), "duration": F.lit(0.2)})
    from transitlake.operators import vetting

    got = vetting.residual_bootstrap(s, "flux_norm").first().boot_err_ppm
    n = series.depth_snr(s, "flux_norm").first().n_in
    assert got == pytest.approx(1.2533 * 1000 / n**0.5, rel=0.25)


def test_red_noise_blocks_are_as_long_as_a_dip(spark):
    s = made(spark, 3000).withColumns({"flux_norm": F.col("pdcsap_flux") / 1e5 + 5e-3 * F.sin(F.col("time") * 12), "duration": F.lit(0.2)})
    wavy = series.red_noise_beta(s, "flux_norm").first().beta
    assert wavy > 2
    assert series.red_noise_beta(s.limit(90), "flux_norm").first().beta == 1
    assert series.red_noise_beta(s.withColumn("duration", F.lit(20.0)), "flux_norm").first().beta == 1
    assert series.red_noise_beta(s.withColumn("duration", F.lit(None).cast("double")), "flux_norm").first().beta == 1


@pytest.mark.parametrize("method", search.METHODS)
def test_strongest_is_the_best_of_all_trials(spark, method):
    s = made(spark, 400, targets=3, depth=0.01).withColumn("x", F.col("pdcsap_flux") / 1e5)
    given = dict(method=method, periods=300, bins=60)
    want = sorted(search.best_period(search.periodogram(s, "x", **given)).collect())
    for most in (series.MOST, 100):
        got = sorted(search.strongest(s, "x", most=most, **given).select(*K, "period", "duration", "width", "depth", "score", "t0", "sde", "alias").collect())
        assert len(got) == len(want) == 3
        for a, b in zip(got, want):
            assert list(a) == [pytest.approx(v) if isinstance(v, float) else v for v in b]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    columns = {"wide": np.exp(rng.normal(0, 9, 5000)), "ties": rng.integers(0, 3, 5000).astype(float), "same": np.full(5000, 7.5), "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324], 5000)}
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in zip(*columns.values())]
    rows += [(float("nan"), float("inf"), None, None)]
    df = spark.createDataFrame(rows, "wide double, ties double, same double, huge double").withColumn("none", F.lit(None).cast("double"))
    plain = df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) for c in columns])
    for share in (0.5, 0.99):
        want = plain.agg(*[F.percentile(c, F.lit(share)).alias(c) for c in columns]).first()
        for few in (16, 1 << 12):
            got = selection.quantiles(df, [*columns, "none"], share, bins=128, few=few)
            assert got["none"] is None
            assert {c: got[c] for c in columns} == {c: pytest.approx(want[c], rel=1e-12) for c in columns}
    by = selection.quantiles(df.withColumn("g", F.when(F.col("ties") == 1, "one").otherwise(None)), ["wide"], by="g", few=8)
    assert set(by) == {("one", "wide"), (None, "wide")}
    assert by["one", "wide"] == pytest.approx(plain.where("ties = 1").agg(F.median("wide")).first()[0])


def test_quantiles_of_no_rows(spark):
    assert selection.quantiles(spark.createDataFrame([], "x double"), ["x"]) == {"x": None}
    assert validation.scaler(spark.createDataFrame([(None,)], "x double"), ["x"]).first().asDict() == {"column": "x", "median": 0.0, "mean": 0.0, "std": 1.0}


def counting(points):
    """Targets with bright points are candidates; one of them can't be worked on."""
    counting.calls += 1
    one = points.groupBy(*K).agg(F.max("pdcsap_flux").alias("top"))
    return one.where("tic_id <> 3").withColumn("error", F.when(F.col("tic_id") == 2, "broken"))


def test_a_run_keeps_every_target_and_resumes(spark):
    counting.calls = 0
    obs = made(spark, 600, targets=5).where("tic_id <> 4 OR cadence < 40")
    targets = spark.createDataFrame([(i, 1) for i in range(8)], "tic_id long, sector int")
    files = spark.createDataFrame([(6, "UNREADABLE: cut"), (0, "OK")], "tic_id long, status string")
    path = tables.scratch(spark, "runs")
    first, rows = batch.run(targets.where("tic_id < 2"), obs, path, counting, files)
    assert {r.tic_id: r.status for r in first.collect()} == {0: "OK", 1: "OK"} and rows.count() == 2
    ledger, rows = batch.run(targets, obs, path, counting, files)
    assert counting.calls == 2
    got = {r.tic_id: (r.stage, r.status, r.reason, r.n_candidates) for r in ledger.collect()}
    assert got == {
        0: ("done", "OK", None, 1), 1: ("done", "OK", None, 1), 2: ("search", "FAILED", "broken", 0), 3: ("done", "NO_CANDIDATES", None, 0), 4: ("clean", "TOO_FEW_CLEAN_POINTS", "40 of 40 points left", 0),
        5: ("load", "NO_OBSERVATIONS", None, 0), 6: ("load", "UNREADABLE", "UNREADABLE: cut", 0), 7: ("load", "NO_OBSERVATIONS", None, 0),
    }
    assert sorted(r.tic_id for r in rows.collect()) == [0, 1]
    again, rows = batch.run(targets, obs, path, counting, files)
    assert counting.calls == 2 and again.count() == 8 and rows.count() == 2  # nothing was left to do
    # rows of a run that never reached its ledger are not read
    rows.limit(1).withColumn("run", F.lit("lost")).write.mode("append").parquet(f"{path}/candidates")
    assert batch.results(spark, path)[1].count() == 2
    assert sorted(r.tic_id for r in batch.failures(ledger).collect()) == [2, 4, 5, 6, 7]
    assert {r.status: (r.targets, r.candidates) for r in batch.counted(ledger).collect()}[None] == (8, 2)
    out = tables.scratch(spark, "sinks")
    archives.save_outputs(out, failures=batch.failures(ledger.limit(0)), summary=batch.counted(ledger.limit(0)))
    assert spark.read.parquet(f"{out}/failures").columns == [*K, "stage", "status", "reason"]
    assert spark.read.parquet(f"{out}/summary").first().targets == 0


def test_a_run_may_stop_at_a_failure(spark):
    counting.calls = 0
    obs, path = made(spark, 600, targets=3), tables.scratch(spark, "runs")
    targets = spark.createDataFrame([(i, 1) for i in range(3)], "tic_id long, sector int")
    with pytest.raises(RuntimeError, match="target 2"):
        batch.run(targets, obs, path, counting, stop=True)
    ledger, rows = batch.results(spark, path)
    assert ledger.count() == 3 and rows.count() == 2  # what was done stays
    assert batch.results(spark, tables.scratch(spark, "nowhere")) == (None, None)


def test_a_scan_reads_available_targets_only(spark):
    obs, path = made(spark, 50, targets=40), tables.scratch(spark, "points")
    batch.save_points(obs, path, parts=16)
    targets = spark.createDataFrame([(3,), (9,), (77,)], "tic_id long")
    files = spark.createDataFrame([(3, "OK"), (9, "HTTP 404"), (3, "HTTP 404")], "tic_id long, status string")
    manifest = batch.availability(targets, files)
    assert {r.tic_id: (r.n_files, r.availability, r.error) for r in manifest.collect()} == {3: (1, "ok", None), 9: (0, "download_failed", "HTTP 404"), 77: (0, "no_lightcurve", None)}
    read = batch.scan(spark, path, manifest, parts=16)
    assert "dynamicpruning" in read._jdf.queryExecution().toString().lower()
    assert [(r.tic_id, r["count"]) for r in read.groupBy("tic_id").count().collect()] == [(3, 50)]
    none = batch.scan(spark, path, batch.availability(targets.limit(0), files), parts=16)
    assert none.count() == 0
    assert {r.availability: r.targets for r in batch.availability_counts(manifest.limit(0)).collect()} == {"ok": 0, "no_lightcurve": 0, "download_failed": 0}


def test_labels_become_features(spark):
    obs = made(spark, 900, targets=5, depth=0.01).where("tic_id <> 4 OR cadence < 40")
    flat = made(spark, 900, targets=1, seed=9).withColumn("tic_id", F.lit(5).cast("long"))
    rows = [(0, 0, "planet", 2.0, 0.4, 0.2, None), (1, 1, "eb", None, None, None, None), (2, 2, None, 2.0, 0.4, 0.2, None), (3, None, "planet", 2.0, 0.4, 0.2, None), (4, 3, "planet", 2.0, 0.4, 0.2, 9e-3), (5, 4, "planet", 2.0, 0.4, 0.2, None), (6, 8, "planet", 2.0, 0.4, 0.2, None), (7, 5, "noise", 0.0, 0.4, 0.2, None), (8, 1, "planet", 2.0, 0.4, 0.2, None)]
    labels = spark.createDataFrame(rows, "source_row long, tic_id long, label string, period double, t0 double, duration double, depth double")
    files = spark.createDataFrame([(i, f"{i}.fits", "UNREADABLE: x" if i == 3 else "OK") for i in range(6)], "tic_id long, path string, status string")
    features, manifest = batch.labelled(labels, files, obs.unionByName(flat), periods=300)
    status = {r.source_row: r.status for r in manifest.collect()}
    assert status == {0: "ok_ephemeris", 1: "ok_detected", 2: "missing_tic_or_label", 3: "missing_tic_or_label", 4: "unreadable", 5: "TOO_FEW_CLEAN_POINTS", 6: "missing_lightcurve", 7: "no_detected_candidate", 8: "ok_ephemeris"}
    got = {r.source_row: r for r in features.collect()}
    assert {k: r.feature_source for k, r in got.items()} == {0: "curated_ephemeris", 1: "detected_candidate", 8: "curated_ephemeris"}
    assert got[1].label == "eb" and got[8].label == "planet"
    for r in got.values():
        assert r.fit_snr > 7 and r.fit_depth_ppm == pytest.approx(10000, rel=0.15)
    assert min(abs(got[1].fit_period_days / 2 - k) for k in (0.5, 1, 2)) < 0.02
    again, _ = batch.labelled(labels.where("source_row = 0"), files, obs, ignore=True, periods=300)
    assert [r.feature_source for r in again.collect()] == ["detected_candidate"]


def test_features_are_found_by_what_columns_hold(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None, "2.5", 3.0, 1, [1.0]), (2, "b", None, None, "x", 4.0, 2, None)], "tic_id long, label string, depth double, empty double, as_text string, fit_status double, n int, list array<double>")
    assert models.infer_features(df) == ["depth", "as_text", "n"]
    assert models.infer_features(df, preferred=["n", "fit_status", "empty", "absent"]) == ["n", "fit_status", "depth", "as_text"]
    assert models.infer_features(df, preferred=["n"], extra=False) == ["n"]
    rows, used, warned = models.model_frame(df.withColumn("label", F.when(F.col("tic_id") == 1, "Planet Candidate").otherwise("?")), ["depth", "empty", "as_text", "absent"])
    assert used == ["depth", "as_text"] and warned == ["FEATURE_WITHOUT_VALUES:empty", "FEATURE_WITHOUT_VALUES:absent"]
    assert [r.asDict() for r in rows.collect()] == [{"label": "PLANETARY_TRANSIT_CANDIDATE", "depth": 1.0, "as_text": 2.5}]


def test_best_boxes_neither_return_nor_shuffle_trials(spark):
    plan = lambda name: registered.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("best_robust_box", "best_box", "best_least_squares_box", "injection_recovery"):
        kernels = [x for x in plan(name).splitlines() if "FlatMapGroupsInArrow" in x]
        assert any("sde#" in x for x in kernels), name  # a series gives its best box, not its 4000 trials


@pytest.mark.parametrize("method", search.METHODS)
def test_series_of_the_same_times_are_searched_together(spark, method):
    s = made(spark, 300, targets=1).withColumn("x", F.col("pdcsap_flux") / 1e5)
    many = s.crossJoin(spark.range(5).withColumnRenamed("id", "signal")).withColumn("x", F.col("x") * (1 + F.col("signal") * 1e-4 * F.rand(3)))
    many = many.where("signal < 4 OR cadence % 2 = 0").localCheckpoint()
    keys = [*K, "signal"]
    groups = search.prepared(many, "x", keys, 0.2, 13.5, 2, 1000).groupBy("times", "part").agg(F.countDistinct("signal").alias("n"))
    assert sorted(r.n for r in groups.collect()) == [1, 1, 3]  # three of 300 points to a group of 1000
    rng = np.random.default_rng(2)
    t, y, trials = np.sort(rng.uniform(0, 30, 300)), rng.normal(0, 1e-3, (5, 300)), search.steps(0.2, 13.5, 100, "linear")
    sigma = rng.uniform(1e-3, 2e-3, 5)
    parts = [search.boxes(sums, n, np.repeat(trials[at], 5), np.tile(sigma, len(trials[at])), method, search.DURATIONS, 0.2) for at, sums, n in search.binned(t, y, trials, 60)]
    for j in range(5):
        alone = [search.boxes(sums, n, trials[at], float(sigma[j]), method, search.DURATIONS, 0.2) for at, sums, n in search.binned(t, y[j], trials, 60)]
        for a, b in zip(zip(*parts), zip(*alone)):
            assert np.array_equal(np.concatenate(a).reshape(-1, 5)[:, j], np.concatenate(b))


def test_a_summary_of_stored_points_is_that_of_their_series(spark):
    obs = made(spark, 300, targets=2).withColumn("quality", F.when(F.col("cadence") % 9 == 0, 1 << 5).otherwise(0))
    stored = series.clean(obs).select(*series.POINTS, *series.FLAGS).localCheckpoint()
    both = [sorted(series.quality_summary(obs, x).withColumn("rms_ppm", F.round("rms_ppm", 6)).collect()) for x in (stored, None)]  # a mean's last bit depends on the order
    assert both[0] == both[1]


def test_copies_for_signals_are_made_in_many_tasks(spark):
    from transitlake.operators import injection

    obs = made(spark, 400, targets=1).coalesce(1)
    dealt = injection.injected(series.dealt(obs, [*K, "cadence"]), injection.specs(spark, 1))
    rows = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 8 and sum(r[1] for r in rows) == 1200
