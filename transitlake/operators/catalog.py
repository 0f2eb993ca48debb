"""Operators on candidate tables: policy, priority, ranking, validation, summaries, resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C

#: Canonical classes, in the order in which ties are settled.
CLASSES = ["PLANETARY_TRANSIT_CANDIDATE", "ECLIPSING_BINARY", "BLEND_OR_CONTAMINATED_SIGNAL", "STELLAR_VARIABILITY", "INSTRUMENTAL_OR_LOW_QUALITY_SYSTEMATIC", "NO_SIGNIFICANT_SIGNAL", "UNCERTAIN_TRANSIT_LIKE_SIGNAL"]
PLANET, BINARY, BLEND, VARIABLE, SYSTEMATIC, NOTHING, UNCERTAIN = CLASSES
#: What each class adds to a candidate's priority.
OFFSETS = {PLANET: 50, UNCERTAIN: 10, BINARY: -20, BLEND: -25, NOTHING: -80, SYSTEMATIC: -60}
#: The columns that a catalog must have, and the bounds of its numbers: (least, most, whether least itself will do).
REQUIRED = ["tic_id", "sector", "candidate_id", "priority_rank", "priority_score", "final_class", "confidence", "recommended_action", "period_days", "duration_hours", "depth_ppm", "effective_snr"]
BOUNDS = {"confidence": (0, 1, True), "period_days": (0, None, False), "duration_hours": (0, None, False), "depth_ppm": (0, None, False), "effective_snr": (0, None, True), "priority_rank": (0, None, False)}


def renormalise(p: list[Column]) -> list[Column]:
    """Shares of the parts that are over 0; alike if none is."""
    pos = [F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) for x in p]
    total = reduce(lambda a, b: a + b, pos)
    return [F.when(total > 0, x / total).otherwise(1.0 / len(p)) for x in pos]


def guardrails(df: DataFrame, prefix: str = "p_") -> DataFrame:
    """df with class probabilities bent by physical evidence, and the warnings of what did."""
    c, p = F.col, {k: F.col(f"{prefix}{i}") for i, k in enumerate(CLASSES)}
    strong_binary = (c("secondary_sigma") >= 5) & (c("secondary_ratio") >= 0.05)
    crowded = c("crowding") >= 0.4
    if "crowdsap" in df.columns:
        crowded = F.coalesce(crowded, F.lit(False)) | F.coalesce(C.finite(c("crowdsap")) <= 0.6, F.lit(False))
    #: Fixed values: (warning, when, class that is raised, to at least, planet at most).
    rules = [
        ("guardrail_strong_secondary_eclipse", strong_binary, BINARY, 0.82, 0.18),
        ("guardrail_possible_secondary_eclipse", (c("secondary_sigma") >= 5) & ~F.coalesce(c("secondary_ratio") >= 0.05, F.lit(False)), BINARY, 0.60, 0.35),
        ("guardrail_odd_even_depth_mismatch", c("odd_even_sigma") >= 3, BINARY, 0.72, 0.25),
        ("guardrail_significant_centroid_shift", c("centroid_sigma") >= 5, BLEND, 0.82, 0.25),
        ("guardrail_marginal_centroid_plus_crowding", (c("centroid_sigma") >= 3) & (c("centroid_sigma") < 5) & (c("crowding") >= 0.25), BLEND, 0.65, None),
        ("guardrail_low_crowdsap_or_high_crowding", crowded, BLEND, 0.62, 0.38),
        ("guardrail_low_data_quality", c("data_quality") <= 0.35, SYSTEMATIC, 0.70, 0.22),
        ("guardrail_low_snr", c("snr") < 6, NOTHING, 0.55, 0.18),
    ]
    # a class is only ever raised, the planet only ever lowered, so the order of the rules doesn't matter
    for k in CLASSES:
        raised = [F.when(when, F.lit(least)) for _, when, up, least, _ in rules if up == k]
        lowered = [F.when(when, F.lit(most)) for _, when, _, _, most in rules if k == PLANET and most is not None]
        p[k] = F.greatest(p[k], *raised) if raised else F.least(p[k], *lowered) if lowered else p[k]
    bent = {f"_g_{i}": F.greatest(F.coalesce(p[k], F.lit(0.0)), F.lit(0.0)) for i, k in enumerate(CLASSES)}
    df = df.withColumns(bent | {"guard_warnings": F.concat_ws(";", C.present(*[(r[1], r[0]) for r in rules]))})
    df = df.withColumn("_g", reduce(lambda a, b: a + b, map(c, bent)))  # once, not in each class
    return df.withColumns({f"q_{i}": F.when(c("_g") > 0, c(x) / c("_g")).otherwise(1.0 / len(bent)) for i, x in enumerate(bent)}).drop("_g", *bent)


def decide(df: DataFrame, prefix: str = "q_") -> DataFrame:
    """df with final_class, confidence and margin: the first largest probability; under 0.45 it is uncertain."""
    df = df.withColumn("_a", F.array(*[F.round(F.col(f"{prefix}{i}"), 12) for i in range(len(CLASSES))]))
    df = df.withColumns({"_top": F.array_max("_a"), "_order": F.sort_array("_a", asc=False)})
    df = df.withColumn("_name", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("_a", F.col("_top")).cast("int")))
    top, name = F.col("_top"), F.col("_name")
    weak = (top < 0.45) & (name != NOTHING)
    told = {"final_class": F.when(weak, UNCERTAIN).otherwise(name), "confidence": F.when(weak, F.greatest(top, F.col("_a")[6], F.lit(0.45))).otherwise(top), "margin": F.col("_order")[0] - F.col("_order")[1]}
    # one struct a row: a filter on what is told stays above, and doesn't repeat the whole expression for each mention of a class
    df = df.drop(*told).select("*", F.inline(F.array(F.struct(*[x.alias(k) for k, x in told.items()]))))
    return df.drop("_a", "_top", "_order", "_name")


def rule_scores(df: DataFrame) -> DataFrame:
    """df with the five rule scores, the class they speak for, and their evidence. Columns that df lacks (radius_ratio, v_shape_score, corrected_depth_ppm, period_days, duration_days, status, n_full) say nothing."""
    c = F.col
    have = lambda x: C.finite(c(x)) if x in df.columns else F.lit(None).cast("double")
    n = lambda x, d=0.0: F.coalesce(have(x), F.lit(d))
    full = "n_full" if "n_full" in df.columns else "n_transits"
    status = c("status") if "status" in df.columns else F.lit(None).cast("string")
    sec, dq, depth, v = n("secondary_sigma"), n("data_quality", 0.5), have("depth_ppm"), have("v_shape_score")
    strong = (sec >= 5) & (n("secondary_ratio") >= 0.05)
    #: What each fact adds to a class, and what it is called.
    facts = {
        1: [(strong, 0.45, "significant_secondary_eclipse"), ((sec >= 5) & ~strong, 0.25, "possible_secondary_eclipse"), (n("odd_even_sigma") >= 3, 0.35, "odd_even_depth_mismatch"), (depth > 15000, 0.20, "very_deep_event"), (have("radius_ratio") > 0.18, 0.20, "large_radius_ratio"), (v < 0.45, 0.12, "triangular_or_poorly_flat_bottom_event")],
        2: [(n("centroid_sigma") >= 5, 0.55, "significant_centroid_shift"), ((n("centroid_sigma") >= 3) & (n("centroid_sigma") < 5), 0.25, "marginal_centroid_shift"), (have("crowding") > 0.30, 0.30, "high_crowding_risk"), ((have("crowding") > 0.15) & (have("crowding") <= 0.30), 0.15, "moderate_crowding_risk"), ((have("corrected_depth_ppm") > 2 * depth) & (have("corrected_depth_ppm") > 5000), 0.15, "large_dilution_correction")],
        3: [(have("red_noise") > 0.25, 0.25, "red_noise_or_quasiperiodic_variability"), ((v < 0.20) & (have("period_days") > 0) & (have("duration_days") > 0.12 * have("period_days")), 0.25, "broad_dip_relative_to_period"), (status == "NO_DETECTION", 0.10, None)],
        4: [(dq < 0.45, 0.35, "low_data_quality"), (n(full) < 2, 0.25, "few_full_transits"), (depth <= 0, 0.35, "non_positive_depth")],
    }
    held = lambda k: F.coalesce(k, F.lit(False))
    score = lambda parts: F.least(reduce(lambda a, b: a + b, [F.when(held(k), x).otherwise(0.0) for k, x, _ in parts]), F.lit(1.0))
    strength = 0.45 * C.logistic(have("snr"), 8, 2) + F.when(have("sde").isNotNull(), 0.25 * C.logistic(have("sde"), 7, 1.5)).otherwise(0.12) + 0.20 * F.least(n(full) / 3, F.lit(1.0)) + 0.10 * dq
    snr = n("snr")
    evidence = [(snr >= 10, "strong_transit_snr"), ((snr >= 7) & (snr < 10), "moderate_transit_snr"), *[(held(k), name) for parts in facts.values() for k, _, name in parts if name]]
    df = df.withColumns({"strength": F.round(C.clip(strength, 0, 1), 10), "rule_evidence": F.concat_ws(";", C.present(*evidence)), "rule_warnings": F.when(snr < 7, "low_snr").otherwise("")} | {f"s_{i}": F.round(score(parts), 10) for i, parts in facts.items()})
    df = df.withColumn("s_0", F.round(C.clip(c("strength") * (1 - 0.75 * F.greatest("s_1", "s_2", "s_3", "s_4")), 0, 1), 10))
    arr = F.array(*[c(f"s_{i}") for i in range(5)])
    top, second = F.array_max(arr), F.sort_array(arr, asc=False)[1]
    name = F.element_at(F.array(*map(F.lit, CLASSES[:5])), F.array_position(arr, top).cast("int"))
    weak, close = top < 0.45, (name == PLANET) & (top - second < 0.12)
    out = F.when(weak, F.when(c("strength") >= 0.35, UNCERTAIN).otherwise(NOTHING)).when(close, UNCERTAIN).otherwise(name)
    sure = F.when(weak, F.when(c("strength") >= 0.35, 0.45).otherwise(F.greatest(c("strength"), 1 - c("strength")))).when(close, c("s_0")).otherwise(top)
    return df.withColumns({"rule_class": out, "rule_confidence": sure})


def priority(df: DataFrame) -> Column:
    c = F.col
    n = lambda x, d=0.0: F.coalesce(c(x), F.lit(float(d)))
    offset = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in (kv[0], float(kv[1]))]), c("final_class")), F.lit(0.0))
    over = lambda x, t: F.greatest(n(x) - t, F.lit(0.0))
    return 100 * n("confidence") + 4 * F.least(n("snr"), F.lit(30.0)) + 5 * F.least(n("n_transits"), F.lit(6.0)) + 20 * n("data_quality", 0.6) + offset - 8 * over("secondary_sigma", 3) - 7 * over("odd_even_sigma", 2) - 7 * over("centroid_sigma", 2) - 25 * over("crowding", 0.25)


def action() -> Column:
    """What to do with a candidate."""
    c = F.col
    n = lambda x: F.coalesce(c(x), F.lit(0.0))
    fine = (n("confidence") >= 0.75) & (n("secondary_sigma") < 4) & (n("odd_even_sigma") < 3) & (n("centroid_sigma") < 3)
    planet = c("final_class") == PLANET
    ladder = (
        F.when(planet & fine & (n("crowding") >= 0.25), "HIGH_PRIORITY_PLANET_CANDIDATE__CHECK_GAIA_TPF_CONTAMINATION")
        .when(planet & fine, "HIGH_PRIORITY_PLANET_CANDIDATE__VISUAL_REVIEW_AND_FOLLOWUP")
        .when(planet, "PLANET_CANDIDATE__NEEDS_ADDITIONAL_VETTING")
        .when(c("final_class") == BINARY, "LIKELY_ECLIPSING_BINARY__VERIFY_PERIOD_ALIAS_AND_SECONDARY")
        .when(c("final_class") == BLEND, "LIKELY_BLEND__INSPECT_CENTROIDS_TPF_AND_NEARBY_SOURCES")
        .when((c("final_class") == UNCERTAIN) & (n("snr") >= 7), "UNCERTAIN_TRANSIT_LIKE_SIGNAL__KEEP_FOR_REVIEW")
        .when(c("final_class") == SYSTEMATIC, "LIKELY_SYSTEMATIC_OR_LOW_QUALITY__LOW_PRIORITY")
        .otherwise("NO_ACTION_OR_LOW_PRIORITY")
    )
    return F.when(c("needs_review"), F.concat(F.lit("MANUAL_REVIEW_REQUIRED__"), ladder)).otherwise(ladder)


#: Under which columns each fact of the catalog may come; the first column that exists is taken.
FACTS = {
    "final_class": ["final_predicted_class", "class_predicted_class", "predicted_class", "final_class"], "confidence": ["unc_final_confidence", "final_confidence", "ai_confidence", "class_confidence", "confidence"], "confidence_level": ["unc_confidence_level", "confidence_level"],
    "period_days": ["unc_period_days", "fit_period_days", "period_days"], "period_err_days": ["unc_period_err_days", "fit_period_err_days", "period_uncertainty_rough"], "epoch_time": ["unc_epoch_time", "fit_epoch_time", "epoch_time"], "epoch_err_days": ["unc_epoch_err_days", "fit_epoch_err_days"],
    "duration_days": ["unc_duration_days", "fit_duration_days", "duration_days"], "duration_err_days": ["unc_duration_err_days", "fit_duration_err_days"], "depth_ppm": ["unc_depth_ppm", "fit_depth_ppm", "depth_ppm"], "depth_err_ppm": ["unc_depth_err_ppm", "fit_depth_err_ppm", "depth_err_ppm"],
    "snr": ["unc_snr", "fit_snr", "local_snr", "snr"], "effective_snr": ["unc_effective_snr", "fit_snr", "local_snr", "snr"], "flux_source": ["flux_source", "selected_flux_source"], "crowdsap": ["vet_crowdsap", "crowdsap"], "crowding": ["vet_crowding_risk", "crowding_risk", "crowding"],
    "secondary_sigma": ["vet_secondary_sigma", "secondary_sigma"], "odd_even_sigma": ["vet_odd_even_sigma", "odd_even_sigma"], "centroid_sigma": ["vet_centroid_shift_sigma", "centroid_shift_sigma", "centroid_sigma"], "data_quality": ["vet_data_quality_score", "data_quality_score", "data_quality"],
    "evidence_summary": ["class_evidence", "evidence", "rule_evidence"],
}
TEXTS = ["final_class", "confidence_level", "flux_source", "evidence_summary"]
WARNINGS = ["warnings", "fit_warnings", "vet_warnings", "class_warnings", "unc_warnings", "final_classifier_warnings", "guard_warnings"]
#: The first columns of the catalog, in order.
ORDER = ["tic_id", "sector", "candidate_id", "priority_rank", "priority_score", "final_class", "confidence", "confidence_level", "recommended_action", "needs_review", "period_days", "period_err_days", "epoch_time", "epoch_err_days", "duration_hours", "duration_err_hours", "depth_ppm", "depth_err_ppm", "snr", "effective_snr", "n_transits", "n_full", "method", "flux_source", "crowdsap", "crowding", "secondary_sigma", "odd_even_sigma", "centroid_sigma", "data_quality", "evidence_summary", "risk_summary"]


def ranked(df: DataFrame, name: str, score: str, *ties: str) -> DataFrame:
    """df with a rank from 1 on over all rows, by falling score. Rows are numbered within steps of a hundredth of the score, and the steps by what lies above them, so no task holds all rows."""
    df = df.withColumn("_step", F.coalesce(F.floor(F.col(score) * 100), F.lit(-(1 << 62))))
    steps = df.groupBy("_step").agg(F.count("*").alias("_n"))  # a row for each step
    above = steps.withColumn("_above", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_step").orderBy(F.desc(score), *ties))
    return df.withColumn("_own", own).join(above, "_step").withColumn(name, (F.col("_own") + F.col("_above")).cast("int")).drop("_step", "_own", "_above")


def harmonise(df: DataFrame, ranks: bool = True) -> DataFrame:
    """The ranked catalog (without `ranks`, the same but for its rank): facts from the first column that has them, whatever its values; hours, risk flags, review, action, priority, one rank over all; the catalog's columns first, all others kept."""
    c = F.col
    taken = {}
    for name, names in FACTS.items():
        found = C.first_existing(df.columns, names)
        x = c(found).cast("string") if found and name in TEXTS else C.finite(c(found)) if found else F.lit(None).cast("string" if name in TEXTS else "double")
        taken[name] = F.coalesce(x, F.lit(UNCERTAIN if name == "final_class" else "")) if name in TEXTS else x
    for name, low, high in (("confidence", 0, 1), ("period_days", 1e-6, None), ("duration_days", 1e-6, None), ("depth_ppm", 1e-6, None), ("snr", 0, None), ("effective_snr", 0, None)):
        taken[name] = C.clip(taken[name], low, high)
    df = df.withColumns(taken)
    for name in ("n_transits", "n_full", "method", "margin"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string" if name == "method" else "double"))
    warned = [F.when(~F.lower(F.trim(c(w).cast("string"))).isin("", "nan"), c(w).cast("string")) for w in WARNINGS if w in df.columns]
    risks = [F.when(c("secondary_sigma") >= 5, "SECONDARY_RISK"), F.when(c("odd_even_sigma") >= 3, "ODD_EVEN_RISK"), F.when(c("centroid_sigma") >= 3, "CENTROID_RISK"), F.when(c("crowding") >= 0.3, "CROWDING_RISK")]
    unsure = F.coalesce(c("epistemic") > 0.1, F.lit(False)) if "epistemic" in df.columns else F.lit(False)
    df = df.withColumns({"duration_hours": c("duration_days") * 24, "duration_err_hours": c("duration_err_days") * 24, "needs_review": F.coalesce(c("confidence") < 0.5, F.lit(False)) | F.coalesce(c("margin") < 0.15, F.lit(False)) | unsure, "risk_summary": F.concat_ws(";", F.array_distinct(F.array_compact(F.array(*warned, *risks))))})
    df = df.withColumn("priority_score", F.round(priority(df), 6)).withColumn("recommended_action", action())
    if ranks:
        df = ranked(df, "priority_rank", "priority_score", "tic_id", *(["sector"] if "sector" in df.columns else []), "candidate_id")
    front = [x for x in ORDER if x in df.columns]
    return df.select(*front, *[x for x in df.columns if x not in front])


def schema_issues(df: DataFrame) -> DataFrame:
    """(issue, n) of rows that break the catalog's contract: unknown classes, no target, numbers out of bounds or not finite. A missing column, a column of numbers without any, and ranks that are not 1 to n (where all rows have one) are one issue each. An empty catalog has none."""
    spark = df.sparkSession
    missing = [(f"MISSING_{c.upper()}", 1) for c in REQUIRED if c not in df.columns]
    if missing:
        return spark.createDataFrame(missing, "issue string, n long")
    c = F.col
    counted = lambda when: F.coalesce(F.sum(F.coalesce(when, F.lit(False)).cast("int")), F.lit(0)).cast("long")
    facts = {"UNKNOWN_CLASS": counted(~F.coalesce(c("final_class"), F.lit("")).isin(CLASSES)), "NO_TARGET": counted(c("tic_id").isNull())}
    for name, (least, most, closed) in BOUNDS.items():
        x = C.finite(c(name))
        out = x < least if closed else x <= least
        facts[f"{name.upper()}_RANGE"] = counted(out if most is None else out | (x > most))
        facts[f"{name.upper()}_NOT_FINITE"] = counted(c(name).isNotNull() & x.isNull())
        facts[f"{name.upper()}_ALL_NULL"] = ((F.count("*") > 0) & (F.count(x) == 0)).cast("long")
    rank = c("priority_rank")
    broken = (F.count("*") > 0) & (F.count(rank) == F.count("*")) & ((F.min(rank) != 1) | (F.max(rank) != F.count("*")) | (F.countDistinct(rank) != F.count("*")))
    facts["RANK_NOT_CONTIGUOUS"] = F.coalesce(broken, F.lit(False)).cast("long")
    one = df.agg(*[v.alias(k) for k, v in facts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), c(k).alias("n")) for k in facts])).alias("x")).select("x.*").where("n > 0")


def unknown_classes(df: DataFrame, column: str = "final_class") -> DataFrame:
    """(name, n) of classes that are not canonical ones."""
    return df.where(~F.coalesce(F.col(column), F.lit("")).isin(CLASSES)).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def union(*catalogs: DataFrame) -> DataFrame:
    """Catalogs with columns of their own, one after another; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)


def top(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n of a ranked catalog: a review table."""
    return df.orderBy("priority_rank").limit(n)


def summary(df: DataFrame) -> DataFrame:
    """(final_class, n, targets, confidence, best_snr) for each class, and under null for all."""
    facts = [F.count("*").alias("n"), F.countDistinct("tic_id").alias("targets"), F.avg("confidence").alias("confidence"), F.max("snr").alias("best_snr")]
    return df.groupBy("final_class").agg(*facts).unionByName(df.agg(F.lit(None).cast("string").alias("final_class"), *facts))


def target_summary(targets: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """targets with n_candidates, best_snr and best_confidence from the first columns of the catalog that have any number."""
    from .labels import first_numeric

    snr, sure = first_numeric(df, ["unc_effective_snr", "fit_snr", "local_snr", "snr"]), first_numeric(df, ["unc_final_confidence", "final_confidence", "class_confidence", "confidence"])
    by = df.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.max(snr).alias("best_snr"), F.max(sure).alias("best_confidence"))
    return targets.join(by, keys, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def attach(df: DataFrame, facts: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """df with the columns of facts, one row of it for each of df's keys at most; two are an error."""
    again = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    once = facts.join(again, keys).withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(F.lit("two rows of facts for one candidate")).cast("int"))).where("_n = 1").drop("_n")
    return df.join(once.withColumnsRenamed({c: f"{prefix}{c}" for c in facts.columns if c not in keys}), keys, "left")


def attach_predictions(df: DataFrame, keys: list[str], views: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """df with the predictions of a model of folded views and of a model of the table; where both are given, those of the views win, column by column."""
    if views is None or table is None:
        given = views if views is not None else table
        return df if given is None else attach(df, given, keys)
    both = [c for c in views.columns if c not in keys and c in table.columns]
    return attach(attach(df, views, keys), table.drop(*both), keys)


def blend_classes(df: DataFrame, first: str, second: str, weight: float = 0.5, out: str = "p_") -> DataFrame:
    """df with class probabilities between those under two prefixes (a class that one lacks is 0 there), scaled to 1; alike if all are 0."""
    names = [i for i in range(len(CLASSES)) if f"{first}{i}" in df.columns or f"{second}{i}" in df.columns]
    part = lambda p, i: F.coalesce(F.col(f"{p}{i}"), F.lit(0.0)) if f"{p}{i}" in df.columns else F.lit(0.0)
    mixed = renormalise([weight * part(first, i) + (1 - weight) * part(second, i) for i in names])
    return df.withColumns({f"{out}{i}": x for i, x in zip(names, mixed)})


def rank_candidates(df: DataFrame, most: int = 3) -> DataFrame:
    """The best candidates of each target, numbered anew from 1."""
    worth = F.when(F.col("status") == "STRONG_DETECTION", 2).when(F.col("status") == "WEAK_DETECTION", 1).otherwise(0)
    w = Window.partitionBy("tic_id").orderBy(F.desc(worth), F.desc(F.coalesce("snr", F.lit(-999.0))), F.desc(F.coalesce("sde", F.lit(-999.0))), "candidate_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def pending(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a row in done."""
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def uncertainty_proxy(df: DataFrame) -> DataFrame:
    """df with errors and a confidence level from catalog columns alone."""
    c = F.col
    beta = 1 + C.clip(F.coalesce(c("red_noise"), F.lit(0.0)), 0, 1)
    err = F.coalesce(c("depth_err_ppm"), C.ratio(c("depth_ppm"), F.greatest(c("snr"), F.lit(1.0)))) * beta
    rel = C.ratio(err, c("depth_ppm"))
    eff = c("snr") / beta
    detection = 0.45 * C.logistic(eff, 7, 2) + 0.25 * F.coalesce(F.when(c("sde").isNotNull(), C.logistic(c("sde"), 6, 1.5)), F.lit(0.5)) + 0.20 * F.least(F.coalesce(c("n_transits"), F.lit(0)) / 3, F.lit(1.0)) + 0.10 * F.coalesce(c("data_quality"), F.lit(0.7))
    parameter = 1 - 0.7 * F.least(F.coalesce(rel, F.lit(1.0)), F.lit(1.0)) - 0.3 * 0.25
    classification = 0.75 * c("confidence") + 0.25 * F.least(c("margin") / 0.35, F.lit(1.0))
    final = F.round(C.clip(0.35 * C.clip(detection, 0, 1) + 0.30 * C.clip(parameter, 0, 1) + 0.35 * C.clip(classification, 0, 1), 0, 1), 9)
    level = F.when(final >= 0.8, "HIGH").when(final >= 0.6, "MEDIUM").when(final >= 0.4, "LOW").otherwise("VERY_LOW")
    return df.withColumns({"unc_depth_err_ppm": err, "unc_final_confidence": final, "unc_level": level})
