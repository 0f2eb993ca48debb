"""Series in Arrow groups against the same over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import injection, search, series, single, vetting
from transitlake.operators.series import K
from transitlake.plans import fitted

from test_runs import SF, made


def same(a, b, keys):
    """Rows of two tables are alike but for the last bits of sums."""
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (sorted((r.asDict() for r in x.select(*sorted(a.columns)).collect()), key=lambda r: [str(r[k]) for k in keys]) for x in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x == {k: pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True) if isinstance(v, float) else v for k, v in y.items()}


def odd(spark, n=600):
    """Targets with a dip, poor quality, a bad preferred flux, no flux at all, and few points."""
    c, obs = F.col, made(spark, n, targets=5, depth=0.004)
    obs = obs.where("tic_id <> 4 OR cadence < 4").withColumn("quality", F.when(c("cadence") % 9 == 0, 1 << 5).when(c("cadence") % 31 == 0, None).otherwise(0))
    bad = (c("tic_id") == 3) | (c("tic_id") == 2) & (c("cadence") % 3 < 2)
    obs = obs.withColumns({"pdcsap_flux": F.when(bad, float("nan")).when(c("cadence") % 50 != 0, c("pdcsap_flux") * F.when(c("cadence") == 77, 1.3).otherwise(1)), "sap_flux": F.when(c("tic_id") != 3, c("sap_flux") * 1.1)})
    return obs.withColumns({"centroid_col": 100 + c("cadence") % 7 / 1000, "centroid_row": F.when(c("cadence") % 20 != 0, 100 + c("cadence") % 11 / 1000)})


@pytest.mark.parametrize("preferred", [None, "pdcsap", "sap"])
def test_cleaning_by_series_is_that_of_tables(spark, preferred):
    obs = odd(spark)
    near, far = series.cleaned(obs, preferred), series.cleaned(obs, preferred, most=3)
    for a, b, keys in zip(near, far, (["tic_id", "cadence"], K)):
        same(a, b, keys)
    if preferred:
        assert {r.tic_id: r.flux_source for r in near[1].collect()}[3] == "NONE"


@pytest.mark.parametrize("outside", [None, 1.5])
def test_detrending_by_series_is_that_of_tables(spark, outside):
    s = series.cleaned(odd(spark), "pdcsap")[0].withColumns({"period": F.lit(2.0), "t0": F.lit(0.4), "duration": F.lit(0.2)})
    given = dict(windows={"a": 0.5, "b": 2.0}, outside=outside)
    same(series.variants(s, **given), series.variants(s, **given, most=3), ["tic_id", "cadence", "variant"])


def test_detection_and_measures_by_series_are_those_of_tables(spark):
    clean, summary = series.cleaned(odd(spark, 500), "pdcsap")
    clean, settings = clean.where("tic_id < 3"), dict(periods=200, bins=60)
    windows = {"0.50d": 0.5, "1.00d": 1.0}
    found, variants = search.detect_twice(clean, windows, **settings)
    other, _ = search.detect_twice(clean, windows, **settings, most=400)  # the target with two thirds of its flux gone has fewer
    keys = [*K, "candidate_id"]
    same(found, other, keys)
    assert search.passed(found).count() > 3
    given = dict(periods=5, epochs=5, replicates=40)
    same(vetting.measured(found, variants, summary, **given), vetting.measured(found, variants, summary, **given, most=400), keys)


def test_the_whole_chain_takes_few_jobs(spark):
    """Each measure shuffled the points anew, in 245 jobs at sf0.01: on few targets the jobs are the cost, on many the passes over all points."""
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    try:
        fitted.end_to_end_catalog(spark, SF).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("chain")) < 120


def test_signals_are_searched_and_measured_in_few_jobs(spark):
    """Copies of the points were stored before they were cleaned, and read for each fact: 37 times all points."""
    sc, obs = spark.sparkContext, made(spark, 600, targets=2)
    sc.setJobGroup("signals", "signals")
    try:
        rows = injection.run(obs, injection.specs(spark, 1), periods=200, bins=60, replicates=20).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("signals")) < 120
    assert sorted((r.tic_id, r.label) for r in rows) == sorted((i, label) for i in range(2) for label in injection.GRID)
    deep = [r for r in rows if r.label == injection.BINARY]
    assert all(r.detected and r.fit_depth_ppm == pytest.approx(12000, rel=0.15) for r in deep)


def test_medians_by_mask_are_those_of_what_they_take():
    rng = np.random.default_rng(4)
    x = np.sort(rng.normal(size=200))
    x[190:] = np.nan
    inside, outside = rng.random((40, 200)) < 0.03, rng.random((40, 200)) < 0.2
    rows, n, a, b, noise = single.contrasts(x, inside, outside, 20)
    got = {r: v for r, *v in zip(rows.tolist(), n, a, b, noise)}
    for r in range(40):
        y, z = x[inside[r]], x[outside[r]]
        kept, left = y[~np.isnan(y)], z[~np.isnan(z)]
        assert (r in got) == (len(y) >= 3 and len(z) >= 20)
        if r in got:
            assert got[r] == [len(y), np.median(kept), np.median(left), np.median(np.abs(left - np.median(left))) * single.MAD]
