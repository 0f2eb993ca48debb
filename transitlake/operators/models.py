"""Class models of candidate tables on MLlib, and anomaly scores of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, IndexToString, Normalizer, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C
from ..sources.tables import kept
from .catalog import CLASSES
from .selection import quantiles

#: Parts of feature names by group, and what stands for "no evidence" in it (None: not known, so the model fills it).
GROUPS = {"centroid": (["cent", "pos", "shift"], 0.0), "vetting": (["odd", "even", "sec", "eclipse"], 0.0), "stellar": (["rad", "mass", "teff", "logg"], None), "crowding": (["crowd", "dilution"], 0.0)}
#: Rows of which a task of a forest holds the counts of every tree.
HELD = 100_000
#: Features of which another value says nothing: all light is the target's.
NEUTRAL = {"crowdsap": 1.0}


def shuffled(key: Column) -> Column:
    """An order by the key's hash that is alike on each run."""
    return F.xxhash64(key)


def placed(df: DataFrame, label: str, key: Column) -> DataFrame:
    """df with _rank, the place of each row within its label in the order of its key's hash, and _n, the label's rows."""
    # rows are numbered within 65536 steps of the hash, and the steps by what comes before them: no task holds a label
    df = df.withColumn("_step", F.shiftright(shuffled(key), 48))
    steps = df.groupBy(label, "_step").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label)
    steps = steps.select(F.col(label).alias("_of"), F.col("_step").alias("_at"), (F.sum("_c").over(w.orderBy("_step")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy(label, "_step").orderBy(shuffled(key), key))
    ranked = df.withColumn("_own", own).join(steps, F.col(label).eqNullSafe(F.col("_of")) & (F.col("_step") == F.col("_at")))
    return ranked.withColumn("_rank", F.col("_own") + F.col("_before")).drop("_step", "_own", "_of", "_at", "_before")


def hold_out(df: DataFrame, label: str, key: Column, share: float = 0.25) -> DataFrame:
    """df with held_out: the first quarter of each label by hash; none if a label has under two rows or the test would be smaller than the labels are many."""
    counts = df.groupBy(label).count().agg(F.min("count").alias("least"), F.sum("count").alias("n"), F.count("*").alias("k"))
    fits = F.col("least").isNotNull() & (F.col("least") >= 2) & (F.ceil(share * F.col("n")) >= F.col("k"))
    return placed(df, label, key).crossJoin(F.broadcast(counts)).withColumn("held_out", fits & (F.col("_rank") <= F.ceil(share * F.col("_n")))).drop("_rank", "_n", "least", "n", "k")  # one row of counts


def fold_of(key: Column, folds: int) -> Column:
    """A fold by the key's hash: with a target's id, no target is on two sides."""
    return F.pmod(shuffled(key), F.lit(folds)).cast("int")


def stratified(df: DataFrame, label: str, key: str, most: int = 5) -> tuple[DataFrame, int]:
    """(df with fold, from 0; how many folds): each class's keys are dealt out evenly, so every fold has as much of a class as any other, give or take one key.

    There are as many folds as the smallest class has keys, `most` at most; under two classes, or two keys of one, it is an error.
    Rows of one key share a fold: with a target's id, no target is on two sides; a key of several classes is dealt with the first in order.
    """
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_class"))
    counts = dict(keys.groupBy("_class").count().collect())  # one row for each class
    if len(counts) < 2 or min(counts.values()) < 2:
        raise ValueError("folds need two classes and two keys of each")
    folds = min(most, min(counts.values()))
    dealt = placed(keys, "_class", F.col("_key")).select(F.col("_key").alias("_of"), F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int").alias("fold"))
    return df.drop("fold").join(dealt, F.col(key).eqNullSafe(F.col("_of"))).drop("_of"), folds


def train(df: DataFrame, features: list[str], label: str = "label", trees: int = 220, least: int = 2, seed: int = 42, kind: str = "forest", rounds: int = 40) -> PipelineModel:
    """A model over features filled with their medians (0 if a column has no value) and marks of what was missing. Rows without a label are left out.

    kind: `forest`, in which classes weigh alike, or `boosted`, gradient-boosted trees of each class against the others
    (`rounds` of them; classes weigh as they are many), whose probabilities are scaled to 1. One class alone is certain.
    """
    if kind not in ("forest", "boosted"):
        raise ValueError(f"no kind of model is called {kind!r}")
    rows = kept(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label])), "training")  # read several times
    middle = {f: v or 0.0 for f, v in quantiles(rows, features).items()}
    filled = ", ".join(f"coalesce(CASE WHEN NOT isnan(CAST(`{f}` AS DOUBLE)) THEN CAST(`{f}` AS DOUBLE) END, {middle[f]!r}D) AS `_f_{f}`, CAST(`{f}` IS NULL AS DOUBLE) AS `_m_{f}`" for f in features)
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"_{k}_{f}" for f in features for k in "fm"], outputCol="_features")
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    labels = index.labels
    if kind == "forest":
        counts = dict(rows.groupBy(label).count().collect())  # one row for each class
        weight = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1 / n)]), F.col(label))  # a join would deal rows out by class, to as many tasks
        ready = assemble.transform(fill.transform(index.transform(rows.withColumn("_weight", weight)))).select("_features", "_label", "_weight")
        # a row is held with a count for each tree, many times what is read of it, so tasks are made by rows
        ready = ready.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(counts.values()) // HELD)))
        forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_class", probabilityCol="_probability", rawPredictionCol="_raw", numTrees=trees, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed).fit(ready)
        return PipelineModel([fill, assemble, forest, IndexToString(inputCol="_class", outputCol="model_class", labels=labels)])
    ready = kept(assemble.transform(fill.transform(index.transform(rows))).select("_features", "_label"), "boosting")
    own = [
        GBTClassifier(featuresCol="_features", labelCol="_own", predictionCol=f"_class_{i}", maxIter=rounds, minInstancesPerNode=least, seed=seed)
        .setProbabilityCol(f"_probability_{i}").setRawPredictionCol(f"_raw_{i}").fit(ready.withColumn("_own", (F.col("_label") == i).cast("double")))
        for i in range(len(labels))
    ]
    # each gives (others, own): the second ones are taken and scaled to 1
    together = [VectorAssembler(inputCols=[f"_probability_{i}" for i in range(len(labels))], outputCol="_both"), VectorSlicer(inputCol="_both", outputCol="_own", indices=[2 * i + 1 for i in range(len(labels))]), Normalizer(inputCol="_own", outputCol="_probability", p=1.0)]
    names = StringIndexerModel.from_labels(labels, inputCol="_unused", outputCol="_named", handleInvalid="keep")  # carries the labels; its input doesn't exist
    return PipelineModel([fill, assemble, *own, *together, names])


def labels_of(model: PipelineModel) -> list[str]:
    last = model.stages[-1]
    return list(last.getLabels() if isinstance(last, IndexToString) else last.labels)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p_0 to p_6, the probabilities of the canonical classes in their order (0 for classes that were not learned), and model_class."""
    labels = labels_of(model)
    out = model.transform(df.drop("model_class", *[f"p_{i}" for i in range(len(CLASSES))])).withColumn("_p", vector_to_array("_probability"))
    out = out.withColumns({f"p_{i}": F.get("_p", F.lit(labels.index(k))) if k in labels else F.lit(0.0) for i, k in enumerate(CLASSES)})
    if "model_class" not in out.columns:
        best = F.array_position("_p", F.array_max("_p")) - 1
        out = out.withColumn("model_class", F.get(F.array(*map(F.lit, labels)), best.cast("int")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def blend(df: DataFrame, weight: float = 0.25) -> DataFrame:
    """df with class probabilities drawn towards the rule scores s_0 to s_4: what they leave open counts a quarter for UNCERTAIN, and all are scaled to 1 first; rows without a rule score over 0 stay."""
    score = [F.greatest(F.coalesce(C.finite(F.col(f"s_{i}")), F.lit(0.0)), F.lit(0.0)) for i in range(5)]
    some = F.greatest(*score)
    rule = [*score, F.lit(0.0), F.greatest(F.lit(0.0), 1 - some) * 0.25]  # in the order of CLASSES
    total = reduce(lambda a, b: a + b, rule)
    return df.withColumns({f"p_{i}": F.when(some > 0, (1 - weight) * F.col(f"p_{i}") + weight * r / total).otherwise(F.col(f"p_{i}")) for i, r in enumerate(rule)})


def out_of_fold(df: DataFrame, features: list[str], key: str, label: str = "label", folds: int = 5, **options) -> DataFrame:
    """Each labelled row with probabilities from a model that has seen none of its fold's keys; folds as `stratified` deals them."""
    rows, n = stratified(df.where(F.col(label).isNotNull()), label, key, folds)
    rows = kept(rows, "folds")
    done = [predict(train(rows.where(F.col("fold") != i), features, label, **options), rows.where(F.col("fold") == i)) for i in range(n)]
    return reduce(DataFrame.unionByName, done)


def calibration(scored: DataFrame, label: str = "label") -> dict[int, tuple[float, float]]:
    """(slope, offset) of a sigmoid for each class with three rows on either side, from out-of-fold probabilities."""
    found = {}
    counts = dict(scored.groupBy(label).count().collect())  # one row for each class
    for i, k in enumerate(CLASSES):
        if 3 <= counts.get(k, 0) <= sum(counts.values()) - 3:
            ready = VectorAssembler(inputCols=[f"p_{i}"], outputCol="_x").transform(scored.select(f"p_{i}", (F.col(label) == k).cast("double").alias("_y")))
            fit = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-3).fit(ready)
            found[i] = (float(fit.coefficients[0]), float(fit.intercept))
    return found


def calibrate(df: DataFrame, sigmoids: dict[int, tuple[float, float]]) -> DataFrame:
    """df with p_i through their sigmoids, scaled to 1."""
    q = [1 / (1 + F.exp(-(sigmoids[i][0] * F.col(f"p_{i}") + sigmoids[i][1]))) if i in sigmoids else F.col(f"p_{i}") for i in range(len(CLASSES))]
    total = reduce(lambda a, b: a + b, q)
    return df.withColumns({f"p_{i}": F.when(total > 0, x / total).otherwise(F.col(f"p_{i}")) for i, x in enumerate(q)})


def counterfactuals(model: PipelineModel, df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, group, new_class, load_bearing): does the class change when a group's features say nothing? All groups go through the model at once."""
    parts = []
    for group, (marks, neutral) in GROUPS.items():
        own = [f for f in features if any(m in f for m in marks)]
        if own:
            parts.append(df.withColumns({f: F.lit(next((v for k, v in NEUTRAL.items() if k in f), neutral)).cast("double") for f in own}).withColumn("group", F.lit(group)))
    before = predict(model, df).select(*keys, F.col("model_class").alias("_before"))
    after = predict(model, reduce(DataFrame.unionByName, parts)).select(*keys, "group", F.col("model_class").alias("new_class"))
    return after.join(before, keys).select(*keys, "group", "new_class", (F.col("new_class") != F.col("_before")).alias("load_bearing"))


def importance(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance) of the model's inputs, marks of missing values included; of boosted trees, the mean over classes."""
    names = [n.replace("_f_", "", 1) if n.startswith("_f_") else "missing_" + n.removeprefix("_m_") for n in model.stages[1].getInputCols()]
    found = [x.featureImportances.toArray() for x in model.stages if hasattr(x, "featureImportances")]
    return spark.createDataFrame(list(zip(names, map(float, sum(found) / len(found)))), "feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def anomalies(df: DataFrame, vector: str, parts: int = 8, strength: Column | None = None, least: float = 6.0, quantile: float = 0.99) -> DataFrame:
    """df with anomaly_score and is_anomalous: mean squared error of a low-rank reconstruction of each vector scaled to 0..1. It is fitted on rows whose strength is under `least` (all, if none is); the threshold is a percentile of their errors."""
    low, high = F.array_min(vector), F.array_max(vector)
    span = F.when(high - low < 1e-8, 1.0).otherwise((high - low).cast("double"))
    rows = df.withColumns({"_low": low.cast("double"), "_span": span}).withColumn("_x", array_to_vector(F.transform(vector, lambda v: (v.cast("double") - F.col("_low")) / F.col("_span"))))
    quiet = rows if strength is None else rows.where(strength < least)
    quiet = rows if strength is not None and quiet.isEmpty() else quiet
    centre = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(quiet)
    shape = PCA(k=parts, inputCol="_c", outputCol="_y").fit(centre.transform(quiet))
    squares = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)
    # the parts are orthonormal, so what they leave is the difference of the squares
    score = lambda d: shape.transform(centre.transform(d)).withColumn("anomaly_score", F.greatest((squares("_c") - squares("_y")) / F.size(vector), F.lit(0.0)))
    most = quantiles(score(quiet), ["anomaly_score"], quantile)["anomaly_score"]
    return score(rows).withColumn("is_anomalous", F.col("anomaly_score") > F.lit(most)).drop("_low", "_span", "_x", "_c", "_y")


#: Parts of names that are no features.
NOT_FEATURES = ("label", "status", "warning", "error", "class", "method", "source", "path", "file", "note", "_id", "tic_id", "sector", "source_row", "run")


def infer_features(df: DataFrame, label: str = "label", preferred: list[str] = (), extra: bool = True) -> list[str]:
    """Columns to learn from: the preferred ones that exist, then any other that holds a number, but for the label, ids and names that tell of a status, class or place. One pass over all columns; a preferred column without a number stays out."""
    names = [c for c, kind in df.dtypes if c != label and not kind.startswith(("array", "map", "struct", "binary"))]
    names = [c for c in names if c in preferred or extra and not any(x in c.lower() for x in NOT_FEATURES)]
    if not names:
        return []
    number = lambda n: C.finite(F.expr(f"try_cast(`{n}` AS DOUBLE)"))
    some = df.agg(*[F.max(number(n).isNotNull()).alias(f"c{i}") for i, n in enumerate(names)]).first()
    have = [n for i, n in enumerate(names) if some[i]]
    return [n for n in preferred if n in have] + [n for n in have if n not in preferred]


def model_frame(df: DataFrame, features: list[str], label: str = "label", keep: list[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """(frame, features, warnings): rows whose label is a class, as its canonical name, with each feature as a finite double or null (null too where the column is absent); features without any number are left out, with a warning each."""
    from .labels import normalise_label

    value = lambda n: C.finite(F.expr(f"try_cast(`{n}` AS DOUBLE)")) if n in df.columns else F.lit(None).cast("double")
    rows = df.select(*keep, normalise_label(F.col(label)).alias(label), *[value(n).alias(n) for n in features]).where(F.col(label).isNotNull())
    counts = rows.agg(*[F.count(n).alias(f"c{i}") for i, n in enumerate(features)]).first() if features else []
    used = [n for n, c in zip(features, counts) if c]
    return rows.drop(*[n for n in features if n not in used]), used, [f"FEATURE_WITHOUT_VALUES:{n}" for n in features if n not in used]
