"""Examples for models of folded views: seven views of a candidate, 25 numbers beside them, its labels.

An example is one row: global_value and global_mask (arrays of float32), local_value and local_mask (an
array of them for each of LOCAL), scalars with scalar_names, and whatever its candidate has. Bins and
views without a point are zero and masked. Examples are written as Parquet and read back with their
numbers matched by name, so tables of other versions can be read together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..sources.tables import kept
from . import batch, fitting, labels as L, vetting
from .series import K, detrend

#: The views about or away from a dip, and the numbers beside the views, in their order.
LOCAL = ("local_flux", "secondary_flux", "odd_flux", "even_flux", "centroid_col_local", "centroid_row_local")
SCALARS = (
    "period_days", "duration_days", "depth_fraction", "depth_ppm", "snr", "local_snr", "sde", "n_transits", "n_full_transits", "n_in_transit_points",
    "fit_period_days", "fit_duration_days", "fit_depth_fraction", "fit_depth_ppm", "fit_snr", "fit_n_events", "fit_n_good_events", "fit_event_depth_scatter_ppm",
    "vet_crowdsap", "vet_crowding_risk", "vet_odd_even_sigma", "vet_secondary_sigma", "vet_centroid_shift_sigma", "vet_red_noise_proxy", "vet_data_quality_score",
)
#: What this library calls them, where a table doesn't have their own names.
OWN = {
    "n_full_transits": "n_full", "fit_event_depth_scatter_ppm": "fit_event_scatter_ppm", "vet_crowdsap": "crowdsap", "vet_crowding_risk": "crowding", "vet_odd_even_sigma": "odd_even_sigma",
    "vet_secondary_sigma": "secondary_sigma", "vet_centroid_shift_sigma": "centroid_sigma", "vet_red_noise_proxy": "red_noise", "vet_data_quality_score": "data_quality",
}


def scalar(df: DataFrame, name: str) -> Column:
    """One of the numbers as a finite double: under its own name, under this library's, a fraction by its parts per million; null if the table has none of them."""
    have = C.first_existing(df.columns, [name, OWN.get(name, name)])
    if have:
        return C.finite(F.col(have))
    per_million = name.replace("_fraction", "_ppm")
    if per_million != name and per_million in df.columns:
        return C.finite(F.col(per_million)) / 1e6
    return F.lit(None).cast("double")


def scalar_row(df: DataFrame) -> DataFrame:
    """df with the 25 numbers as columns, in their order after its others."""
    return df.select(*[c for c in df.columns if c not in SCALARS], *[scalar(df, n).alias(n) for n in SCALARS])


def examples(series: DataFrame, candidates: DataFrame, value: str = "flux_detrended", wide: int = 1001, local: int = 401, keys: list[str] = K) -> DataFrame:
    """An example for each candidate (a row for each of the keys). series carries the keys and the ephemeris; candidates without a point in it have views that are masked throughout."""
    packed = fitting.packed_views(fitting.folded_views(series, value, wide, local, keys), {"global_flux": wide} | dict.fromkeys(LOCAL, local), keys)
    seven = packed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("view", F.struct("value", "mask")))).alias("_views"))  # seven at most

    def part(view: str, name: str, n: int) -> Column:
        return F.coalesce(F.element_at("_views", view)[name], F.array_repeat(F.lit(0.0).cast("float"), n))

    rows = candidates.select(*[c for c in candidates.columns if c not in SCALARS], F.array(*[scalar(candidates, n).cast("float") for n in SCALARS]).alias("scalars"), F.array(*map(F.lit, SCALARS)).alias("scalar_names"))
    out = rows.join(seven, keys, "left")
    arrays = {f"global_{x}": part("global_flux", x, wide) for x in ("value", "mask")} | {f"local_{x}": F.array(*[part(v, x, local) for v in LOCAL]) for x in ("value", "mask")}
    return out.withColumns(arrays).drop("_views")


def save_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_examples(spark: SparkSession, paths: str | list[str], names: tuple[str, ...] = SCALARS) -> DataFrame:
    """Examples under the paths, with these numbers: matched by name, null where an example doesn't have them. Labels that a table lacks are null."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    df = L.add_missing(df, canonical_label=F.lit(None).cast("string"), binary_label=F.lit(None).cast("string"))
    wanted = F.array(*map(F.lit, names))
    own = F.transform(wanted, lambda n: F.get("scalars", (F.array_position("scalar_names", n) - 1).cast("int")))
    return df.withColumn("scalars", own).withColumn("scalar_names", wanted)


def labelled_examples(labels: DataFrame, files: DataFrame, obs: DataFrame, wide: int = 1001, local: int = 401, least: int = 500, replicates: int = 50) -> tuple[DataFrame, DataFrame]:
    """(examples, manifest) of labelled targets with an ephemeris: cleaned, detrended, fitted from it, vetted and classed, then folded by the fit.

    labels: source_row, tic_id, canonical_label and binary_label (either may be null), period, t0, duration, depth; files: (path, tic_id, status).
    Rows without a target or any label are left out. Others have a row in manifest (source_row, tic_id, path, status):
    missing_lightcurve, unreadable, missing_ephemeris, the status of cleaning, no_points if nothing could be fitted, or ok.
    """
    c = F.col
    said = {x: L.first_text(c(x).cast("string")) for x in ("canonical_label", "binary_label")}
    rows = labels.withColumns(said).withColumn("label", F.coalesce("canonical_label", "binary_label"))
    plan = kept(batch.planned(rows, files).where("plan <> 'missing_tic_or_label'"), "planned")
    going = plan.where("plan = 'ephemeris'")
    summary, state, clean = batch.cleaned(going, obs, least)
    given = batch.seeds(going, state)
    series = kept(detrend(clean).withColumn("variant", F.lit("seeded")), "variants")
    facts = kept(vetting.measured(given, series, summary, replicates=replicates), "features")
    keys = [*K, "candidate_id"]
    by_fit = facts.select(*keys, c("fit_period_days").alias("period"), c("fit_epoch_time").alias("t0"), c("fit_duration_days").alias("duration"))
    # the seed's own numbers stand beside those of its fit; it was not searched for, so it has no score
    own = given.select(*keys, c("period").alias("period_days"), c("duration").alias("duration_days"), "depth_fraction", (c("depth_fraction") * 1e6).alias("depth_ppm"), F.lit(0).alias("n_in_transit_points"))
    known = facts.drop("period_days", "duration_days", "depth_ppm", "snr", "radius_ratio").join(own, keys)
    told = ["class_predicted_class", "fit_snr", "secondary_sigma", "odd_even_sigma", "centroid_sigma", "crowding", "data_quality"]
    seen = known.select(*keys, *[c(x).alias(f"seen_{x}") for x in told])
    made = examples(series.join(by_fit, K), known, wide=wide, local=local, keys=keys)
    made = made.select(*keys, (-1 - c("candidate_id")).alias("source_row"), "global_value", "global_mask", "local_value", "local_mask", "scalars", "scalar_names").join(seen, keys).drop("candidate_id")
    texts = rows.select("source_row", "canonical_label", "binary_label").join(going.select("source_row", "path"), "source_row")
    made = kept(made.join(texts, "source_row"), "examples")
    worst = state.groupBy("tic_id").agg(F.max(F.when(c("cleaning") != "OK", c("cleaning"))).alias("cleaning"))
    out = plan.join(made.select("source_row", F.lit(True).alias("_made")).distinct(), "source_row", "left").join(worst, "tic_id", "left")
    status = F.when(c("plan") == "search", "missing_ephemeris").when(c("plan") != "ephemeris", c("plan")).when(c("_made"), "ok").otherwise(F.coalesce("cleaning", F.lit("no_points")))
    return made, out.select("source_row", "tic_id", "path", status.alias("status"))
