"""Labels and public metadata, normalised."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as C
from .catalog import BINARY, BLEND, CLASSES, NOTHING, PLANET, SYSTEMATIC, UNCERTAIN, VARIABLE

#: Names that public label tables use for each class.
ALIASES = {
    PLANET: ["planet", "planet_candidate", "planetary_transit", "planetary_transit_candidate", "confirmed_planet", "known_planet", "candidate", "planet_like", "pc", "apc", "cp", "kp", "toi_pc", "transit", "exoplanet"],
    BINARY: ["eb", "eclipsing_binary", "binary", "detached_eb", "contact_binary", "eclipse"],
    BLEND: ["blend", "blended", "background_eb", "beb", "contaminated", "contamination", "background_eclipsing_binary"],
    VARIABLE: ["stellar_variability", "variable", "starspot", "rotation", "rotational_variability", "pulsator", "flare"],
    SYSTEMATIC: ["systematic", "instrumental", "low_quality", "artifact", "false_alarm", "fa", "false_positive", "false_positive_or_other", "fp"],
    NOTHING: ["no_signal", "noise", "quiet", "none", "negative"],
    UNCERTAIN: ["uncertain", "unknown", "ambiguous", "marginal"],
}
#: What each source's dispositions mean: (words, class, is a planet, note).
DISPOSITIONS = {
    "tess-toi": [(["pc", "apc", "cp", "kp", "known_planet", "confirmed", "candidate", "planet_candidate"], PLANET, True, ""), (["fp", "false_positive", "false_positive_or_other", "fa", "false_alarm"], None, False, "toi_false_positive_subtype_not_assumed")],
    "kepler-dr25": [(["confirmed", "candidate", "planet_candidate", "pc"], PLANET, True, ""), (["false_positive", "fp"], None, False, "kepler_false_positive_subtype_not_assumed"), (["afp", "astrophysical_false_positive"], BINARY, False, ""), (["ntp", "non_transiting_phenomenon", "false_alarm"], SYSTEMATIC, False, "")],
    "tess-dv": [(["planet_candidate", "pc", "candidate", "threshold_crossing_event_planet_candidate"], PLANET, True, ""), (["false_positive", "fp", "false_alarm", "fa"], None, False, "dv_false_positive_subtype_not_assumed")],
}
#: Other names of the sources.
SOURCES = {"toi": "tess-toi", "tess_project_candidates": "tess-toi", "tess-project-candidates": "tess-toi", "kepler": "kepler-dr25", "kepler_dr25": "kepler-dr25", "tess_dv": "tess-dv"}
#: Columns that hold the disposition, in the order in which they are asked.
ANY_DISPOSITION = ["disposition", "disp", "label", "canonical_label"]
DISPOSITION = {"tess-toi": ["tfopwg_disp", "toi_disposition", "toi_disp"], "kepler-dr25": ["koi_disposition", "koi_pdisposition", "av_training_set", "tce_label"], "tess-dv": ["dv_disposition", "tce_disposition", "tfopwg_disp"]}
#: Columns that hold each number, in the order in which they are asked.
NUMBERS = {
    "tic_id": ["tic_id", "tid", "toi_tic", "tic"], "kepid": ["kepid", "kep_id", "kic", "target_id"], "period_days": ["period_days", "pl_orbper", "koi_period", "tce_period", "toi_period"],
    "epoch_time": ["epoch_time", "pl_tranmid", "koi_time0bk", "tce_time0bk", "toi_epoch"], "depth_ppm": ["depth_ppm", "koi_depth", "tce_depth", "toi_depth", "pl_trandep"],
}
DAYS, HOURS = ["duration_days"], ["duration_hours", "pl_trandurh", "koi_duration", "tce_duration", "toi_duration"]
#: Words for a planet and for anything else in tables of two labels.
YES, NO = ["1", "true", "planet", "planet_like", "pc", "candidate"], ["0", "false", "false_positive", "false_positive_or_other", "fp", "other"]
JULIAN, TESS_ZERO, KEPLER_ZERO = 2400000.0, 2457000.0, 2454833.0
LIKE, UNLIKE = "planet_like", "false_positive_or_other"


def key_of(x: Column) -> Column:
    return F.lower(F.translate(F.trim(x), " -/", "___"))


def normalise_label(x: Column) -> Column:
    """The canonical class of a name; null if it is blank or unknown."""
    names = {c.lower(): c for c in CLASSES} | {a: c for c, others in ALIASES.items() for a in others}
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), key_of(x))


def source_of(name: str) -> str:
    low = name.strip().lower()
    source = SOURCES.get(low, low)
    if source not in DISPOSITIONS:
        raise ValueError(f"unknown source {name!r}")
    return source


def disposition(x: Column, source: str = "tess-toi") -> tuple[Column, Column, Column]:
    """(canonical class, planet_like or false_positive_or_other, note); words that the source doesn't use are taken as names of classes."""
    k = F.lower(F.translate(F.trim(x), " -", "__"))
    ladder = DISPOSITIONS[source_of(source)]
    known = k.isin([w for words, *_ in ladder for w in words])
    alias = normalise_label(x)
    kind = F.when(~known, alias)
    binary = F.when(~known & alias.isNotNull(), F.when(alias == PLANET, LIKE).otherwise(UNLIKE))
    note = F.lit("")
    for words, name, planet, said in ladder:
        hit = k.isin(words)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        binary = F.when(hit, LIKE if planet else UNLIKE).otherwise(binary)
        note = F.when(hit, said).otherwise(note)
    return kind, binary, note


def binary_label(x: Column, canonical: Column | None = None) -> Column:
    """1.0 for a planet, 0.0 for anything else, null if that isn't known; where there is no label, the canonical class tells."""
    k = F.lower(F.trim(x.cast("string")))
    said = F.when(k.isin(YES), 1.0).when(k.isin(NO), 0.0)
    return said if canonical is None else F.when(x.isNull(), F.when(canonical.isNotNull(), (canonical == PLANET).cast("double"))).otherwise(said)


def epoch(x: Column, zero: float = TESS_ZERO) -> Column:
    return F.when(x > JULIAN, x - zero).otherwise(x)


def first_text(*xs: Column) -> Column:
    """The first that is not blank or 'nan'."""
    return F.coalesce(*[F.when(~F.lower(F.trim(x)).isin("", "nan"), F.trim(x)) for x in xs])


def first_numeric(df: DataFrame, names: Iterable[str]) -> Column:
    """The first of the columns that has any number, for all rows; null if none has. One pass over the columns that exist."""
    have = [n for n in names if n in df.columns]
    number = lambda n: C.finite(F.expr(f"try_cast(`{n}` AS DOUBLE)"))
    if not have:
        return F.lit(None).cast("double")
    counts = df.agg(*[F.count(number(n)).alias(n) for n in have]).first()
    return next((number(n) for n in have if counts[n]), F.lit(None).cast("double"))


def add_missing(df: DataFrame, **columns: Column) -> DataFrame:
    """df with those of the columns that it doesn't have."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def clean_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """df with its column names stripped of blanks and brackets, and renamed (whatever their case) by `names`."""
    out = []
    for c in df.columns:
        bare = c.strip().strip("[]").strip()
        out.append((names or {}).get(bare.lower(), bare))
    return df.toDF(*out)


def standardise(df: DataFrame, source: str) -> DataFrame:
    """Public metadata with source, canonical_label, binary_label, label_notes, ids, ephemeris and the epoch's zero point, all other columns kept."""
    source = source_of(source)
    df = clean_names(df)
    asked = [c for c in dict.fromkeys([*DISPOSITION[source], *ANY_DISPOSITION]) if c in df.columns]
    raw = first_text(*[F.col(c).cast("string") for c in asked]) if asked else F.lit(None).cast("string")
    kind, binary, note = disposition(raw, source)
    numbers = {k: first_numeric(df, names) for k, names in NUMBERS.items()}
    days, hours = first_numeric(df, DAYS), first_numeric(df, HOURS)
    have_days = any(c in df.columns for c in DAYS)
    out = df.withColumns({"_kind": kind, "_binary": binary, "_note": note})
    out = add_missing(out, **numbers, duration_days=days if have_days else hours / 24)
    out = out.withColumns({"source": F.lit(source), "canonical_label": F.col("_kind"), "binary_label": F.col("_binary"), "label_notes": F.col("_note")}).drop("_kind", "_binary", "_note")
    bjd, zero, system = {"tess-toi": ("pl_tranmid", TESS_ZERO, "BTJD"), "kepler-dr25": ("koi_time0", KEPLER_ZERO, "BKJD")}.get(source, (None, 0.0, None))
    if bjd in df.columns:
        out = add_missing(out, epoch_time_bjd=C.finite(F.expr(f"try_cast(`{bjd}` AS DOUBLE)")))
    if system:
        out = out.withColumns({"epoch_time": epoch(F.col("epoch_time"), zero), "epoch_time_system": F.lit(system)})
    return out


def read_metadata(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A public metadata table, CSV or Parquet by its name, standardised."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    return standardise(raw, source)


def query_metadata(df: DataFrame, columns: list[str] | None = None, where: str | None = None, top: int | None = None) -> DataFrame:
    """Chosen columns of the rows that meet a condition, the first `top` of them."""
    out = df.where(where) if where else df
    out = out.select(*columns) if columns else out
    return out.limit(top) if top else out


def seeded(df: DataFrame, depth: float = 1000.0) -> DataFrame:
    """Candidates from ephemerides in a catalog: rows with an id, a period, an epoch and a duration, as if they had been detected."""
    days = first_numeric(df, DAYS) if any(c in df.columns for c in DAYS) else first_numeric(df, HOURS) / 24
    given = df.select(
        first_numeric(df, NUMBERS["tic_id"]).cast("long").alias("tic_id"), first_numeric(df, NUMBERS["period_days"]).alias("period"), epoch(first_numeric(df, NUMBERS["epoch_time"])).alias("t0"),
        days.alias("duration"), (F.coalesce(first_numeric(df, NUMBERS["depth_ppm"]), F.lit(depth)) / 1e6).alias("depth"), F.lit("STRONG_DETECTION").alias("status"), F.lit("catalog_ephemeris").alias("method"),
    )
    return given.where("tic_id IS NOT NULL AND period > 0 AND t0 IS NOT NULL AND duration > 0")


def target_list(df: DataFrame, id_col: str, priority: str, most: int) -> DataFrame:
    """The targets of highest priority; nulls last, those without an id left out."""
    return df.where(F.col(id_col).isNotNull()).orderBy(F.desc_nulls_last(priority), id_col).limit(most)


def target_of_path(x: Column) -> Column:
    """The target id in a file name: a run of 16 digits, else the last run that follows `tic` or stands alone."""
    name = F.regexp_extract(x, r"([^/]*)$", 1)
    wide, bare = F.regexp_extract(name, r"(?<!\d)(\d{16})(?!\d)", 1), F.regexp_extract(name, r"(?i)tic[ _-]*0*(\d+)", 1)
    return F.when(wide != "", wide.try_cast("long")).when(bare != "", bare.try_cast("long")).otherwise(F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).try_cast("long"))


def files_of(labels: DataFrame, files: DataFrame, most: int = 1, id_col: str = "tic_id", path_col: str = "path") -> DataFrame:
    """labels with the first `most` paths (in order) whose names hold their target; labels without a file keep a null path."""
    from pyspark.sql import Window

    found = files.select(F.col(path_col).alias("path"), target_of_path(F.col(path_col)).alias("_target")).where("_target IS NOT NULL").distinct()
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("_target").orderBy("path"))).where(F.col("_k") <= most).drop("_k")
    return labels.join(found, F.col(id_col) == F.col("_target"), "left").drop("_target")


def target_key(path: Column, tic: Column, sector: Column, index: Column) -> Column:
    """tic_{id}_s{sector}_{index}, or fits_{stem}_{ten digits of the path's SHA-1} where there is no id."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.when(tic.isNotNull(), F.format_string("tic_%d_s%s_%d", tic, F.coalesce(sector.cast("string"), F.lit("unknown")), index)).otherwise(F.concat(F.lit("fits_"), stem, F.lit("_"), F.substring(F.sha1(path), 1, 10)))


def sector_of(x: Column) -> Column:
    return F.regexp_extract(x, r"\d+", 0).try_cast("int")


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.dropna(subset=columns)


def hours_to_days(days: Column | None, hours: Column | None) -> Column:
    return C.finite(days) if days is not None else C.finite(hours) / 24
