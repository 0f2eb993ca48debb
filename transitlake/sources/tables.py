"""Canonical tables from parquet: the observation table and its injected form, and tables under test."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

OBSERVATIONS = ["tic_id", "sector", "cadence", "time", "pdcsap_flux", "sap_flux", "quality", "centroid_col", "centroid_row"]
#: Names under which archives publish each column, first match first.
ALIASES = {"time": ["TIME"], "quality": ["QUALITY"], "centroid_col": ["MOM_CENTR1", "CENTR1", "POS_CORR1"], "centroid_row": ["MOM_CENTR2", "CENTR2", "POS_CORR2"], "sap_flux": ["SAP_FLUX"], "pdcsap_flux": ["PDCSAP_FLUX"]}


SHIPPED: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"package-{uuid.uuid4().hex}.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(x for x in files if x.endswith(".py")):
                z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    SHIPPED.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names. Where that is unset, a temporary folder in local mode, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("transitlake.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("transitlake.scratch", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, worked out once: written to scratch and read back, so its plan ends here, a lost executor costs nothing of it, and what follows is planned on true sizes."""
    path = scratch(df.sparkSession, name)
    plain = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rename the first alias that exists, whatever its case, to each canonical name; absent ones become null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, others in aliases.items():
        found = next((have[a.lower()] for a in [name, *others] if a.lower() in have), None)
        out.append(F.col(found).alias(name) if found else F.lit(None).cast("double").alias(name))
    used = {have[a.lower()] for n, o in aliases.items() for a in [n, *o] if a.lower() in have}
    return df.select(*[c for c in df.columns if c not in used], *out)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as brightness series: about a thousand points for each target."""
    e = read(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select(
        F.floor(F.col("user_id") / 15).alias("tic_id"), F.lit(1).alias("sector"), F.col("event_id").alias("cadence"), (micros / 86400e6).alias("time"),
        (100000 + F.col("value")).alias("pdcsap_flux"), (100000 + 1.01 * F.col("value")).alias("sap_flux"),
        F.when(F.col("event_type") == "error", F.call_function("shiftleft", F.lit(1), (F.col("event_id") % 15).cast("int"))).otherwise(0).alias("quality"),
        (100 + (F.col("event_id") % 7) * 0.001).alias("centroid_col"), (100 + (F.col("event_id") % 11) * 0.001).alias("centroid_row"),
    )


def true_period(tic: Column) -> Column:
    return 1.5 + (tic % 10) * 0.35


def inject(obs: DataFrame, period: Column, depth: float = 0.003, duration: float = 0.2, t0: float = 0.4, flux: str = "pdcsap_flux") -> DataFrame:
    """flux times (1 - depth) inside the windows of a periodic signal; the truth stays in columns."""
    from ..functions.columns import transit_mask

    hit = transit_mask(F.col("time"), period, F.lit(t0), F.lit(duration))
    return obs.withColumn(flux, F.when(hit, F.col(flux) * (1 - depth)).otherwise(F.col(flux))).withColumns({"true_period": period, "true_t0": F.lit(t0), "true_depth": F.lit(depth), "true_duration": F.lit(duration)})
