"""Examples of folded views: against a plain numpy build, labels to examples, round trips."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import examples
from transitlake.operators.series import K

from test_runs import made


def plain_views(t, x, col, period, t0, duration, wide, local):
    """The global view, that around the dip, that of odd events and that of a centroid, by loops: dictionaries of bin to median."""
    h = min(max(4 * duration / period, 0.03), 0.2)
    turn = ((t - t0) / period + 0.5) % 1 - 0.5
    out = np.abs(turn) > max(2 * h, 3 * duration / period)
    mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v)))
    base = np.median(x[out])
    z = np.clip((x - base) / (1.4826 * np.median(np.abs(x[out] - base))), -20, 20)
    odd = np.floor((t - t0) / period + 0.5) % 2 == 1

    def binned(d, v, half, n):
        place = np.clip(np.floor((d + half) / (2 * half) * n), 0, n - 1).astype(int)
        return {b: np.median(v[place == b]) for b in set(place.tolist())}

    return binned(turn, z, 0.5, wide), binned(turn, z, h, local), binned(turn[odd], z[odd], h, local), binned(turn, np.clip((col - np.median(col)) / mad(col), -20, 20), h, local)


def test_examples_against_a_plain_build(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 27, 900))
    x = 1 + 1e-3 * rng.normal(size=900)
    x[np.abs((t - 0.4 + 1) % 2 - 1) < 0.1] -= 0.01
    col = 100 + rng.normal(size=900)
    rows = [(7, 1, float(a), float(b), float(c), None, 2.0, 0.4, 0.2) for a, b, c in zip(t, x, col)]
    s = spark.createDataFrame(rows, "tic_id long, sector int, time double, x double, centroid_col double, centroid_row double, period double, t0 double, duration double")
    candidates = spark.createDataFrame([(7, 1, 9.5, "a"), (8, 1, None, "b")], "tic_id long, sector int, snr double, note string")
    got = {r.tic_id: r for r in examples.examples(s, candidates, "x", 101, 41).collect()}
    one, none = got[7], got[8]
    for value, mask, want in zip([one.global_value, one.local_value[0], one.local_value[2], one.local_value[4]], [one.global_mask, one.local_mask[0], one.local_mask[2], one.local_mask[4]], plain_views(t, x, col, 2.0, 0.4, 0.2, 101, 41)):
        assert {i for i, m in enumerate(mask) if m} == set(want) and set(mask) <= {0.0, 1.0}
        for i, v in enumerate(value):
            assert v == pytest.approx(want.get(i, 0.0), rel=1e-5, abs=1e-5)
    assert not any(one.local_mask[5]) and [len(v) for v in one.local_value] == [41] * 6  # no centroid of that axis
    assert one.scalars[examples.SCALARS.index("snr")] == 9.5 and sum(v is not None for v in one.scalars) == 1 and one.note == "a"
    assert none.global_value == [0.0] * 101 and not any(none.global_mask) and none.local_value == [[0.0] * 41] * 6
    assert examples.examples(s.limit(0), candidates.limit(0), "x", 101, 41).isEmpty()


def test_numbers_are_matched_by_name(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    old = spark.createDataFrame([(1, [1.0, 2.0, None], ["snr", "retired", "sde"], "planet")], "tic_id long, scalars array<float>, scalar_names array<string>, canonical_label string")
    new = spark.createDataFrame([(2, [5.0, 6.0], ["depth_ppm", "snr"])], "tic_id long, scalars array<float>, scalar_names array<string>")
    examples.save_examples(old, path + "/old")
    examples.save_examples(new, path + "/new")
    got = {r.tic_id: r for r in examples.read_examples(spark, [path + "/old", path + "/new"], ("snr", "sde", "depth_ppm")).collect()}
    assert got[1].scalars == [1.0, None, None] and got[2].scalars == [6.0, None, 5.0]
    assert got[1].scalar_names == ["snr", "sde", "depth_ppm"] and got[1].canonical_label == "planet" and got[2].canonical_label is None and got[2].binary_label is None
    assert len(examples.SCALARS) == 25 and examples.read_examples(spark, path + "/old").first().scalars[4] == 1.0


def test_numbers_of_a_catalog(spark):
    df = spark.createDataFrame([(1, 500.0, float("nan"), 3.0, 4.0, "x")], "tic_id long, depth_ppm double, snr double, crowding double, vet_odd_even_sigma double, note string").withColumn("odd_even_sigma", F.lit(9.0))
    r = examples.scalar_row(df).first()
    assert r.depth_fraction == 500e-6 and r.snr is None and r.vet_crowding_risk == 3.0 and r.vet_odd_even_sigma == 4.0 and r.sde is None and r.note == "x"


def test_labels_become_examples(spark):
    obs = made(spark, 900, targets=4, depth=0.01).where("tic_id <> 3 OR cadence < 40")
    rows = [(0, 0, "planet", None, 2.0, 0.4, 0.2, None), (1, 1, None, "no", 2.0, 0.4, 0.2, 9e-3), (2, 2, "eb", "no", None, 0.4, 0.2, None), (3, 3, "eb", None, 2.0, 0.4, 0.2, None), (4, 9, "eb", None, 2.0, 0.4, 0.2, None), (5, 0, " ", None, 2.0, 0.4, 0.2, None), (6, None, "eb", None, 2.0, 0.4, 0.2, None), (7, 5, "eb", None, 2.0, 0.4, 0.2, None)]
    labels = spark.createDataFrame(rows, "source_row long, tic_id long, canonical_label string, binary_label string, period double, t0 double, duration double, depth double")
    files = spark.createDataFrame([(i, f"{i}.fits", "UNREADABLE: x" if i == 5 else "OK") for i in range(6)], "tic_id long, path string, status string")
    got, manifest = examples.labelled_examples(labels, files, obs, 101, 41)
    assert {r.source_row: r.status for r in manifest.collect()} == {0: "ok", 1: "ok", 2: "missing_ephemeris", 3: "TOO_FEW_CLEAN_POINTS", 4: "missing_lightcurve", 7: "unreadable"}
    by = {r.source_row: r for r in got.collect()}
    assert set(by) == {0, 1} and (by[0].canonical_label, by[0].binary_label, by[1].canonical_label, by[1].binary_label) == ("planet", None, None, "no")
    for r in by.values():
        numbers = dict(zip(r.scalar_names, r.scalars))
        assert numbers["period_days"] == 2.0 and numbers["fit_depth_ppm"] == pytest.approx(10000, rel=0.15) and numbers["snr"] is None and numbers["fit_snr"] > 7
        assert len(r.global_value) == 101 and len(r.local_value) == 6 and r.local_value[0][20] < -3 and r.path == f"{r.tic_id}.fits"
        assert abs(np.mean([v for v, m in zip(r.local_value[1], r.local_mask[1]) if m])) < 2  # no second dip
    none, left = examples.labelled_examples(labels.limit(0), files, obs, 101, 41)
    assert none.isEmpty() and left.isEmpty()
