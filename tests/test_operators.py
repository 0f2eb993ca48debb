"""Inline goldens and edge cases of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.functions import columns as C
from transitlake.operators import catalog, fitting, injection, labels, search, series, validation, vetting
from transitlake.plans import registered

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_mask_and_phase(spark):
    times = [0.0, 1.0, 2.0, 3.0, 3.05, 4.5]
    df = spark.createDataFrame([(t,) for t in times], "time double")
    got = [r[0] for r in df.orderBy("time").select(C.transit_mask(F.col("time"), F.lit(3.0), F.lit(0.0), F.lit(0.2))).collect()]
    assert got == [True, False, False, True, True, False]
    assert one(spark, C.transit_mask(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.2)))[0] is False
    assert one(spark, C.phase_days(F.lit(-0.25), F.lit(1.0), F.lit(0.0)))[0] == pytest.approx(-0.25)


def test_null_and_nan(spark):
    r = one(spark, C.finite(F.lit(float("nan"))), C.finite(F.lit(float("inf"))), C.clip(F.lit(None).cast("double"), 0, 1), C.logistic(F.lit(None).cast("double"), 1, 1), C.ratio(F.lit(1.0), F.lit(0.0)))
    assert list(r) == [None, None, None, 0.0, None]


def test_labels(spark):
    names = {"PC": catalog.PLANET, "Eclipsing Binary": catalog.BINARY, "no-signal": catalog.NOTHING, "": None, "what": None}
    for k, v in names.items():
        assert one(spark, labels.normalise_label(F.lit(k)))[0] == v
    assert list(one(spark, *labels.disposition(F.lit("FP")))) == [None, "false_positive_or_other", "toi_false_positive_subtype_not_assumed"]
    assert list(one(spark, *labels.disposition(F.lit("Astrophysical False Positive"), "kepler"))) == [catalog.BINARY, "false_positive_or_other", ""]
    assert list(one(spark, *labels.disposition(F.lit("Ambiguous"))))[0] == catalog.UNCERTAIN and one(spark, labels.disposition(F.lit("quiet"), "tess_dv")[1])[0] == "false_positive_or_other"
    with pytest.raises(ValueError):
        labels.source_of("elsewhere")
    assert sum(map(len, labels.ALIASES.values())) == len({a for xs in labels.ALIASES.values() for a in xs}) and one(spark, labels.normalise_label(F.lit(" Marginal ")))[0] == catalog.UNCERTAIN
    yes = lambda x, y=None: one(spark, labels.binary_label(F.lit(x), F.lit(y)))[0]
    assert [yes("PC"), yes("0"), yes("?"), yes(None, catalog.PLANET), yes(None, catalog.BLEND), yes(None)] == [1.0, 0.0, None, 1.0, 0.0, None]
    assert one(spark, labels.epoch(F.lit(2458900.25)))[0] == pytest.approx(1900.25)
    assert one(spark, labels.first_text(F.lit(" "), F.lit("nan"), F.lit("x ")))[0] == "x"
    assert one(spark, labels.sector_of(F.lit("sector 12 a")), labels.sector_of(F.lit("none")))[0] == 12


def test_statuses(spark):
    s = lambda snr, sde, n: one(spark, search.status(F.lit(snr), F.lit(sde).cast("double"), F.lit(n)))[0]
    assert [s(11.0, 9.0, 3), s(8.0, 6.0, 2), s(5.0, 9.0, 3), s(11.0, None, 3)] == ["STRONG_DETECTION", "WEAK_DETECTION", "NO_DETECTION", "STRONG_DETECTION"]


def test_quality_modes(spark):
    obs = spark.createDataFrame([(1, 1, q) for q in (0, 1, 2, 32)], "tic_id long, sector int, quality int")
    assert [series.quality_filter(obs, m).count() for m in ("none", "minimal", "conservative", "strict")] == [4, 3, 2, 1]
    with pytest.raises(ValueError):
        series.quality_filter(obs, "odd")


def test_injected_period_is_found(spark):
    for r in registered.best_box(spark, SF).collect():
        true = 1.5 + (r.tic_id % 10) * 0.35
        assert min(abs(r.period / (true * k) - 1) for k in (1, 2, 1 / 2, 3, 1 / 3, 3 / 2)) < 0.05 and r.score > 0


def test_catalog_contract(spark):
    c = catalog.harmonise(registered.decided(spark, SF)).withColumn("effective_snr", F.col("snr")).cache()
    assert catalog.schema_issues(c).count() == 0
    assert catalog.schema_issues(c.limit(0)).count() == 0
    assert catalog.schema_issues(c.drop("tic_id")).first().issue == "MISSING_TIC_ID"
    bad = c.withColumn("confidence", F.lit(2.0)).withColumn("final_class", F.lit("X"))
    assert {r.issue for r in catalog.schema_issues(bad).collect()} == {"CONFIDENCE_RANGE", "UNKNOWN_CLASS"}
    odd = c.withColumns({"depth_ppm": F.lit(None).cast("double"), "effective_snr": F.when(F.col("priority_rank") == 1, float("inf")).otherwise(F.col("snr"))})
    assert {r.issue: r.n for r in catalog.schema_issues(odd).collect()} == {"DEPTH_PPM_ALL_NULL": 1, "EFFECTIVE_SNR_NOT_FINITE": 1}
    assert {r.issue for r in catalog.schema_issues(c.drop("sector", "depth_ppm")).collect()} == {"MISSING_SECTOR", "MISSING_DEPTH_PPM"}


def test_probabilities_sum_to_one(spark):
    df = catalog.guardrails(registered.candidates(spark, SF))
    total = sum(F.col(f"q_{i}") for i in range(7))
    assert df.where(F.abs(total - 1) > 1e-9).count() == 0


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "d boolean, r boolean")
    row = validation.detection(df, F.col("d"), F.col("r")).first()
    assert (row.tp, row.precision, row.f1) == (0, None, None)


def test_pending(spark):
    targets = spark.createDataFrame([(1,), (2,), (2,)], "tic_id long")
    assert [r.tic_id for r in catalog.pending(targets, targets.where("tic_id = 2"), ["tic_id"]).collect()] == [1]


def test_public_tables(spark):
    toi = spark.createDataFrame([(123, "PC", 2.75, 2458900.25, 3.6, 850.0), (124, "FP", None, None, None, None), (125, None, 1.0, 1900.0, 2.4, 1.0)], "tid long, tfopwg_disp string, pl_orbper double, pl_tranmid double, pl_trandurh double, pl_trandep double")
    rows = {r.tic_id: r for r in labels.standardise(toi, "toi").collect()}
    assert (rows[123].canonical_label, rows[123].epoch_time, rows[123].epoch_time_system, rows[123].epoch_time_bjd) == (catalog.PLANET, pytest.approx(1900.25), "BTJD", 2458900.25)
    assert rows[123].duration_days == pytest.approx(0.15) and rows[124].binary_label == labels.UNLIKE and rows[125].canonical_label is None
    seeds = labels.seeded(toi).collect()
    assert [(r.tic_id, r.t0, r.depth) for r in seeds] == [(123, pytest.approx(1900.25), pytest.approx(850e-6)), (125, 1900.0, pytest.approx(1e-6))]
    assert [r.tid for r in labels.query_metadata(toi, ["tid"], "pl_orbper > 2", 5).collect()] == [123]
    paths = {"x/tess2018206045859-s0001-0000000025155310-0120-s_lc.fits": 25155310, "TIC 42.fits": 42, "a/lc_77.fits.gz": 77, "none.fits": None}
    for path, target in paths.items():
        assert one(spark, labels.target_of_path(F.lit(path)))[0] == target
    key = one(spark, labels.target_key(F.lit("a/b.fits"), F.lit(None).cast("long"), F.lit(1), F.lit(0)))[0]
    assert key.startswith("fits_b_") and len(key) == 17


def test_facts_come_from_the_first_column_that_exists(spark):
    df = spark.createDataFrame([(1, 2, 0, catalog.PLANET, 0.82, 3.1, 0.1, 900.0, 12.0, 0.2, 0.1, 0.5, 0.05, 0.9, 5.0)], "tic_id long, sector int, candidate_id int, final_predicted_class string, final_confidence double, fit_period_days double, fit_duration_days double, fit_depth_ppm double, fit_snr double, vet_secondary_sigma double, vet_odd_even_sigma double, vet_centroid_shift_sigma double, vet_crowding_risk double, vet_data_quality_score double, period_days double")
    r = catalog.harmonise(df).first()
    assert (r.period_days, r.duration_hours, r.priority_rank, r.final_class) == (3.1, pytest.approx(2.4), 1, catalog.PLANET) and "HIGH_PRIORITY" in r.recommended_action
    assert catalog.schema_issues(catalog.harmonise(df)).count() == 0
    bad = catalog.harmonise(df.withColumns({"final_predicted_class": F.lit("X"), "fit_depth_ppm": F.lit(None).cast("double")})).withColumns({"depth_ppm": F.lit(0.0), "confidence": F.lit(2.0)})
    assert {x.issue for x in catalog.schema_issues(bad).collect()} == {"UNKNOWN_CLASS", "CONFIDENCE_RANGE", "DEPTH_PPM_RANGE"}
    twice = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.6)], "tic_id long, candidate_id int, p double")
    with pytest.raises(Exception, match="two rows of facts"):
        catalog.attach(df, twice, ["tic_id", "candidate_id"]).collect()
    assert catalog.union(df.select("tic_id"), df.select("candidate_id")).columns == ["tic_id", "candidate_id"]


def test_long_series_are_searched_without_groups(spark):
    s = registered.injected(spark, SF)
    for method in search.METHODS:
        options = {"method": method, "periods": 40, "low": 1.0, "high": 5.0, "durations": [0.1, 0.2, 0.3], "bins": 60}
        near = {r.trial: r for r in search.periodogram(s, "flux_norm", **options).collect()}
        far = {r.trial: r for r in search.periodogram(s, "flux_norm", most=10, **options).collect()}
        assert near.keys() == far.keys() and len(near) > 30
        for i, r in near.items():
            assert (r.width, r.duration) == (far[i].width, far[i].duration) and (r.period, r.depth, r.score, r.t0) == pytest.approx((far[i].period, far[i].depth, far[i].score, far[i].t0), rel=1e-6, abs=1e-12)


def test_long_series_are_vetted_and_refined_without_groups(spark):
    s = registered.injected(spark, SF).withColumn("flux_norm", F.when(F.col("time") % 1 > 0.02, F.col("flux_norm"))).cache()
    for run in (lambda **o: series.secondary(s, "flux_norm", **o), lambda **o: fitting.refine_ephemeris(s, "flux_norm", periods=3, epochs=5, **o)):
        near, far = ([tuple(r) for r in run(**o).orderBy(*series.K).collect()] for o in ({}, {"most": 10}))
        assert len(near) == len(far) > 0
        assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(near, far))
    bare = s.withColumn("period", F.lit(None).cast("double"))
    for o in ({}, {"most": 10}):
        assert series.secondary(bare, "flux_norm", **o).isEmpty() and series.secondary(s.limit(0), "flux_norm", **o).isEmpty()
        assert fitting.refine_ephemeris(s.limit(0), "flux_norm", periods=2, epochs=2, **o).isEmpty()
        assert [r.refinement_snr for r in fitting.refine_ephemeris(bare, "flux_norm", periods=2, epochs=2, **o).collect()] == [None]


def test_trends_of_many_widths_and_thin_frames(spark):
    rows = [(k, 1, i, i * (0.02 + 0.001 * k), float((7 * i * i + k) % 31) if not 40 <= i < 60 else None) for k in range(40) for i in range(100)]
    s = spark.createDataFrame(rows + [(99, 1, i, float(i), float(i)) for i in range(3)], "tic_id long, sector int, cadence int, time double, x double")
    got = {(r.tic_id, r.cadence): r.trend for r in series.rolling_trend(s, "x", 0.3, piece=17).collect()}
    assert [got[99, i] for i in range(3)] == [1.0] * 3 and None not in got.values()
    for k in (0, 7, 39):
        n = max(5, round(0.3 / (0.02 + 0.001 * k)))
        n += 1 - n % 2
        x = [r[4] for r in rows if r[0] == k]
        want = []
        for i in range(100):
            seen = sorted(v for v in x[max(0, i - n // 2) : i + n // 2 + 1] if v is not None)
            want.append((seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2 if len(seen) >= max(3, n // 5) else None)
        known = [i for i, v in enumerate(want) if v is not None]
        for i, v in enumerate(want):
            if v is None:
                a, b = max(j for j in known if j < i), min(j for j in known if j > i)
                v = want[a] + (want[b] - want[a]) * (i - a) / (b - a)
            assert got[k, i] == pytest.approx(v)


def test_uncertainty_and_stability(spark):
    df = spark.createDataFrame([(1000.0, 50.0, 12.0, 8.0, 3, 0.9, 0.4), (None, None, 8.0, None, 0, None, None)], "fit_depth_ppm double, fit_depth_err_ppm double, fit_snr double, sde double, n_full int, confidence double, margin double")
    a, b = vetting.uncertainty(df).collect()
    assert a.unc_depth_err_ppm == 50 and 0.6 < a.unc_final_confidence <= 1 and a.unc_confidence_level in ("HIGH", "MEDIUM")
    assert b.unc_depth_err_ppm is None and b.unc_parameter_confidence == pytest.approx(min(0.5, 1 - 0.7 - 0.3 * 0.25)) and "DEPTH_UNCERTAINTY_UNAVAILABLE" in b.unc_warnings and "FEW_FULL_TRANSITS" in b.unc_warnings
    q = lambda *x: one(spark, vetting.data_quality(*[F.lit(v).cast("double") for v in x]))[0]
    assert [q(0, 500, 27), q(1, 500, 27), q(None, 9000, 5)] == [1.0, pytest.approx(0.65), pytest.approx(0.4)]


def test_grid_of_signals(spark):
    grid = injection.specs(spark)
    assert grid.count() == 37 and {(r.label, r["count"]) for r in grid.groupBy("label").count().collect()} == {(catalog.PLANET, 16), (catalog.BINARY, 12), (catalog.BLEND, 9)}
    assert injection.specs(spark, 2).groupBy("label").count().where("count <> 2").count() == 0


def test_status_tells_what_was_detected(spark):
    df = spark.createDataFrame([("NO_STRONG_DETECTION",), ("NO_DETECTION",), ("WEAK_DETECTION",), ("STRONG_DETECTION",), (None,)], "status string")
    assert [r[0] for r in df.select(validation.detected(df.columns)).collect()] == [False, False, True, True, False]
    df = spark.createDataFrame([(7.0,), (6.0,), (None,)], "snr double")
    assert [r[0] for r in df.select(validation.detected(df.columns)).collect()] == [True, False, False]


def test_filters_on_classes_stay_above_the_decision(spark):
    decided = registered.decided(spark, SF)
    plan = catalog.unknown_classes(decided.withColumn("final_class", F.concat("final_class", F.lit("?"))))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "Filter" in above and len(above) < 2000 and "lambda" not in plan


def test_decision_of_ties_nulls_and_nothing(spark):
    rows = [(1, [0.4, 0.4, 0.0, 0.0, 0.0, 0.0, 0.2]), (2, [0.0] * 7), (3, [None, 0.0, 0.0, 0.0, 0.0, 0.9, 0.1]), (4, [0.2, 0.2, 0.0, 0.0, 0.0, 0.0, 0.6])]
    df = spark.createDataFrame(rows, "candidate_id int, p array<double>").select("candidate_id", *[F.col("p")[i].alias(f"p_{i}") for i in range(7)])
    quiet = {"secondary_sigma": 0.0, "secondary_ratio": 0.0, "odd_even_sigma": 0.0, "centroid_sigma": 0.0, "crowding": 0.0, "data_quality": 1.0, "snr": 9.0}
    out = catalog.decide(catalog.guardrails(df.withColumns({k: F.lit(v) for k, v in quiet.items()})))
    got = {r.candidate_id: (r.final_class, r.confidence, r.margin) for r in out.collect()}
    assert got[1] == (catalog.UNCERTAIN, 0.45, 0.0) and got[2] == (catalog.UNCERTAIN, 0.45, 0.0)
    assert got[3] == (catalog.NOTHING, 0.9, 0.8) and got[4][0] == catalog.UNCERTAIN and got[4][2] == pytest.approx(0.4)


def test_summary_ranks_nothing(spark):
    plan = registered.QUERIES["catalog_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_step" not in plan


def test_medians_by_place():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 20, 21, 1000):
        x = np.round(rng.normal(size=n), 2)
        assert series.placed_median(np.sort(x)) == series.partial_median(x) == float(np.median(x))


@pytest.mark.parametrize("method", search.METHODS)
def test_boxes_without_places(method):
    rng = np.random.default_rng(4)
    t, y = np.sort(rng.uniform(0, 20, 400)), np.round(rng.normal(0, 1e-3, 400), 4)
    trials = search.steps(0.2, 10.0, 150, "linear")
    for at, sums, n in search.binned(t, y, trials, 60):
        one = np.floor(np.minimum((t[:, None] - np.floor(t[:, None] / trials[at]) * trials[at]) / trials[at] * 60, 59)).astype(int)
        assert (n == [np.bincount(k, minlength=60) for k in one.T]).all()
        assert (sums == [np.bincount(k, y, 60) for k in one.T]).all()  # the same sums to the bit, in whatever order the trials lie
        placed = search.boxes(sums, n, trials[at], 1e-3, method, search.DURATIONS, 0.2)
        for a, b in zip(placed[:4], search.boxes(sums, n, trials[at], 1e-3, method, search.DURATIONS, 0.2, False)):
            assert (a == b).all()
        for i in np.flatnonzero(np.isfinite(placed[0])):  # a period's best box doesn't depend on its neighbours
            alone = search.boxes(sums[i : i + 1], n[i : i + 1], trials[at][i : i + 1], 1e-3, method, search.DURATIONS, 0.2)
            assert [x[0] for x in alone] == [x[i] for x in placed]


def test_cleaned_points_are_stored(spark):
    from transitlake.plans import fitted

    points, summary = fitted.cleaned(spark, SF)
    assert all("/cleaned-" in f for f in points.inputFiles()) and all("/summary-" in f for f in summary.inputFiles())  # a detrending's plan ends here
    assert points.count() > 500 and summary.count() == 1


def test_a_report_works_out_its_rows_once(spark):
    df = spark.range(60).selectExpr("IF(id % 3 = 0, 'A', 'B') AS label", "IF(id % 4 = 0, 'A', 'B') AS final_class", "id / 60 AS confidence", "id / 4 AS snr", "id AS unread", "id + 1.0 AS p", "id + 2.0 AS t")
    r = validation.report(df, pairs={"x": ("p", "t")})
    assert "Range" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.part, x.metric): x.value for x in r.collect()}
    assert got["parameters", "x:mae"] == 1 and got["classes", "accuracy"] == pytest.approx(35 / 60) and got["detection", "tp"] == 32
    bare = {x.metric for x in validation.report(spark.range(0)).collect() if x.part == "warning"}
    assert bare == {"EMPTY_CATALOG", "NO_LABELS"}
