"""Models of candidate tables and vectors: quality floors, shares, round trips, edge cases."""

import tempfile

import pytest
from pyspark.sql import functions as F

from transitlake.operators import catalog, fitting, models
from transitlake.plans import fitted, registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Candidates whose class follows from two columns; one feature has no value at all."""
    c = registered.candidates(spark, SF).withColumn("nothing", F.lit(None).cast("double"))
    label = F.when(F.col("secondary_sigma") >= 4, catalog.BINARY).when(F.col("centroid_sigma") >= 3, catalog.BLEND).otherwise(catalog.PLANET)
    return models.hold_out(c.withColumn("label", label), "label", F.col("candidate_id")).cache()


FEATURES = ["secondary_sigma", "centroid_sigma", "snr", "sde", "nothing"]


@pytest.fixture(scope="module")
def model(rows):
    return models.train(rows.where("NOT held_out"), FEATURES, trees=20)


def test_held_out_accuracy(rows, model):
    share = rows.agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.2 < share < 0.3
    got = models.predict(model, rows.where("held_out")).agg(F.avg((F.col("model_class") == F.col("label")).cast("int")), F.max(F.abs(sum(F.col(f"p_{i}") for i in range(7)) - 1))).first()
    assert got[0] > 0.9 and got[1] < 1e-9


def test_forest_tasks_are_made_by_rows(rows, monkeypatch):
    seen = []
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models, "HELD", 100, raising=False)
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) or fit(self, df))
    models.train(rows, FEATURES, trees=2)
    (held,) = seen
    assert sum(held) == rows.count() > 1000 and max(held) <= 200  # however few the classes are
    own = models.train(rows.where(F.col("label") == catalog.BINARY), FEATURES, trees=2)
    assert models.predict(own, rows).select("model_class").distinct().collect() == [(catalog.BINARY,)]


def test_model_round_trip(rows, model):
    path = tempfile.mkdtemp(prefix="spark-") + "/model"
    models.save(model, path)
    again = models.predict(models.load(path), rows).select("candidate_id", "model_class")
    assert again.exceptAll(models.predict(model, rows).select("candidate_id", "model_class")).isEmpty()


def test_importance_and_counterfactuals(spark, rows, model):
    top = models.importance(model, spark).orderBy(F.desc("importance")).limit(2)
    assert {r.feature for r in top.collect()} == {"secondary_sigma", "centroid_sigma"}
    c = models.counterfactuals(model, rows.where("held_out"), FEATURES, ["candidate_id"])
    assert {r.group for r in c.select("group").distinct().collect()} == {"centroid", "vetting"}
    binaries = c.join(rows.where(F.col("label") == catalog.BINARY).select("candidate_id"), "candidate_id").where("group = 'vetting'")
    assert binaries.agg(F.avg(F.col("load_bearing").cast("int"))).first()[0] > 0.8


def test_boosted_trees(spark, rows, model):
    held = rows.where("held_out")
    boosted = models.train(rows.where("NOT held_out"), FEATURES, kind="boosted", rounds=6)
    right = lambda m: models.predict(m, held).agg(F.avg((F.col("model_class") == F.col("label")).cast("int")), F.max(F.abs(sum(F.col(f"p_{i}") for i in range(7)) - 1)), F.min(sum((F.col(f"p_{i}") < 0).cast("int") for i in range(7)))).first()
    got, floor = right(boosted), right(model)
    assert got[0] >= floor[0] and got[0] > 0.97 and got[1] < 1e-9 and got[2] == 0
    path = tempfile.mkdtemp(prefix="spark-") + "/model"
    models.save(boosted, path)
    columns = ["candidate_id", "model_class", *[f"p_{i}" for i in range(7)]]
    assert models.predict(models.load(path), held).select(columns).exceptAll(models.predict(boosted, held).select(columns)).isEmpty()
    assert {r.feature for r in models.importance(boosted, spark).orderBy(F.desc("importance")).limit(2).collect()} == {"secondary_sigma", "centroid_sigma"}
    assert models.predict(boosted, held.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        models.train(rows, FEATURES, kind="other")


def test_folds_are_stratified(spark):
    kinds = ["a"] * 23 + ["b"] * 11 + ["c"] * 4
    df = spark.createDataFrame([(i, k, r) for i, k in enumerate(kinds) for r in range(1 + i % 3)], "tic long, label string, r int")
    got, n = models.stratified(df, "label", "tic")
    assert n == 4 and got.count() == df.count()  # the smallest class has four targets
    per = got.dropDuplicates(["tic"]).groupBy("label").pivot("fold").count().na.fill(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 and len(r) == 5 for r in per)
    assert got.groupBy("tic").agg(F.countDistinct("fold").alias("k")).where("k > 1").isEmpty()
    mixed, n = models.stratified(df.union(spark.createDataFrame([(0, "b", 9), (None, "b", 9)], df.schema)), "label", "tic", 3)
    assert n == 3 and mixed.where("tic = 0").select("fold").distinct().count() == 1 and mixed.where("tic IS NULL").count() == 1
    for few in (df.where("label = 'a'"), df.where("label = 'a' OR tic = 23"), df.limit(0)):
        with pytest.raises(ValueError):
            models.stratified(few, "label", "tic")


def test_out_of_fold_calibration(rows):
    scored = models.out_of_fold(rows, FEATURES, "tic_id", folds=2, trees=5)
    assert scored.count() == rows.count() and scored.select("fold").distinct().count() == 2
    sigmoids = models.calibration(scored)
    assert len(sigmoids) == 3 and all(slope > 0 for slope, _ in sigmoids.values())
    total = sum(F.col(f"p_{i}") for i in range(7))
    assert models.calibrate(scored, sigmoids).where(F.abs(total - 1) > 1e-9).isEmpty()


def test_small_classes_are_not_held_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    assert models.hold_out(df, "label", F.col("id")).where("held_out").isEmpty()
    assert models.hold_out(df.limit(0), "label", F.col("id")).isEmpty()


def test_anomalies(spark):
    flat = [(i, [float(i % 3), 0.0, 1.0 + i % 3, 0.5], 1.0) for i in range(60)] + [(99, [0.0, 5.0, 0.0, 5.0], 9.0), (100, [2.0] * 4, 1.0)]
    df = spark.createDataFrame(flat, "id long, v array<double>, sde double")
    got = {r.id: r for r in models.anomalies(df, "v", 2, F.col("sde")).collect()}
    assert got[99].is_anomalous and got[99].anomaly_score == max(r.anomaly_score for r in got.values())
    assert models.anomalies(df.withColumn("sde", F.lit(9.0)), "v", 2, F.col("sde")).count() == len(flat)


def test_packed_views(spark):
    s = registered.injected(spark, SF)
    packed = fitting.packed_views(fitting.folded_views(s, "flux_norm", 51, 21), {"global_flux": 51} | {v: 21 for v in ("local_flux", "secondary_flux", "odd_flux", "even_flux", "centroid_col_local", "centroid_row_local")})
    got = packed.selectExpr("view", "size(value) AS n", "aggregate(mask, 0D, (a, x) -> a + x) AS filled", "value[size(value) div 2] AS middle").collect()
    assert {(r.view, r.n) for r in got} >= {("global_flux", 51), ("odd_flux", 21)} and all(r.filled > 0 for r in got)
    assert next(r.middle for r in got if r.view == "local_flux") < -1
    assert fitting.folded_views(s.limit(0), "flux_norm").isEmpty()


def test_recovery(spark):
    df = spark.createDataFrame([(3.0, 3.1), (1.5, 3.1), (2.0, 3.1), (None, 3.0)], "period double, true_period double")
    assert [r.recovered for r in fitting.recovery(df).collect()] == [True, True, False, False]


def test_thin_series_fall_back(spark):
    s = registered.injected(spark, SF).limit(20)
    assert [r.method for r in fitting.profile_duration(s, "flux_norm").collect()] == ["fallback_initial"]
    assert [r.refinement_snr for r in fitting.refine_ephemeris(s.limit(5), "flux_norm", periods=3, epochs=3).collect()] == [None]


def test_registered_models(spark):
    assert fitted.model_classes(spark, SF).count() == registered.candidates(spark, SF).count()
    assert fitted.vector_anomalies(spark, SF).where("anomaly_score IS NULL").isEmpty()
    assert fitted.model_counterfactuals(spark, SF).where("load_bearing IS NULL").isEmpty()
