"""Light curves from FITS files, star catalogs from CSV, and the tables that runs leave behind."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog
from .tables import ALIASES

BLOCK = 2880
#: Numpy types of table formats.
FORMATS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
COLUMNS = [*ALIASES, "cadence"]
HEADER = {"tic_id": ("TICID", int), "sector": ("SECTOR", int), "crowdsap": ("CROWDSAP", float), "flfrcsap": ("FLFRCSAP", float), "stellar_radius": ("RADIUS", float)}
#: Columns of headerless star catalogs by place.
CTL = {0: "ID", 1: "priority", 2: "splists", 3: "objID"}
TIC = {0: "ID", 13: "ra", 14: "dec", 60: "Tmag", 64: "Teff", 66: "logg", 70: "rad", 72: "mass", 74: "rho", 77: "lum", 79: "d", 87: "priority", 124: "objID"}


def header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The cards of the header at `at`, and where it ends."""
    cards = {}
    while at + 80 <= len(data):
        card = data[at : at + 80].decode("ascii", "replace")
        at += 80
        if card.startswith("END") and not card[3:].strip():
            return cards, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            text = re.match(r"\s*'((?:[^']|'')*)'|\s*([^/]*)", card[10:])
            cards[card[:8].strip()] = (text[1] if text[1] is not None else text[2]).strip()
    raise ValueError("no end of header")


def light_curve(data: bytes) -> tuple[dict[str, str], dict[str, np.ndarray]]:
    """All header cards and the columns of one number a row of the first binary table that has a time."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    found, at = {}, 0
    while at < len(data):
        cards, at = header(data, at)
        size = abs(int(cards.get("BITPIX", 8))) // 8 if int(cards.get("NAXIS", 0)) else 0
        for i in range(1, int(cards.get("NAXIS", 0)) + 1):
            size *= int(cards[f"NAXIS{i}"])
        found |= {k: v for k, v in cards.items() if k not in found or not found[k]}
        if cards.get("XTENSION") == "BINTABLE" and "ZTABLE" not in cards:
            width, n, place, out = int(cards["NAXIS1"]), int(cards["NAXIS2"]), 0, {}
            raw = np.frombuffer(data, np.uint8, width * n, at).reshape(n, width)
            for i in range(1, int(cards["TFIELDS"]) + 1):
                count, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
                count = int(count or 1)
                wide = {"A": 1, "P": 8, "Q": 16, "C": 8, "M": 16}.get(code) or np.dtype(FORMATS.get(code, "u1")).itemsize
                if count == 1 and code in FORMATS and code != "L":
                    v = raw[:, place : place + wide].copy().view(FORMATS[code])[:, 0].astype(float)
                    if f"TNULL{i}" in cards:
                        v[v == float(cards[f"TNULL{i}"])] = np.nan
                    out[cards.get(f"TTYPE{i}", "").upper()] = v * float(cards.get(f"TSCAL{i}", 1)) + float(cards.get(f"TZERO{i}", 0))
                place += -(-count // 8) if code == "X" else count * wide
            if "TIME" in out:
                return found, out
        at += -(-(size + int(cards.get("PCOUNT", 0)) * (size > 0)) // BLOCK) * BLOCK
    raise ValueError("no table with a time")


def decoded(data: bytes | None) -> tuple:
    """(status, header values, series by COLUMNS); what can't be read gives a status and no points."""
    try:
        cards, columns = light_curve(bytes(data or b""))
        pick = lambda names: next((columns[n] for n in names if n in columns), None)
        n = len(columns["TIME"])
        series = [pick([k.upper(), *others]) for k, others in {**ALIASES, "cadence": ["CADENCENO"]}.items()]
        meta = [kind(cards[k]) if cards.get(k) else None for k, kind in HEADER.values()]
        return ("OK", *meta, [np.full(n, np.nan) if s is None else s for s in series])
    except (ValueError, KeyError, OSError, EOFError, TypeError) as error:
        return (f"UNREADABLE: {type(error).__name__}", *[None] * len(HEADER), [np.zeros(0)] * len(COLUMNS))


def read_fits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, files): a row for each cadence of all FITS files under path, and (path, status, n) for each file. Absent columns and values that are no number are null; compressed tables (fz) count as unreadable. Spark's scan skips files without a byte, so these have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.fits*").load(path).select("path", "content")
    texts = {"path": pa.string(), "status": pa.string()}
    types = {n: texts.get(n, pa.int64() if n in ("tic_id", "sector", "n") else pa.float64()) for n in ("path", "status", "n", *HEADER, *COLUMNS)}

    def points_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points of each file, some thousands at a time; a file without any has one row with its status."""
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                status, *meta, series = decoded(content.as_py())
                n = len(series[0])
                for i in range(0, max(n, 1), 1 << 14):
                    part = [x[i : i + (1 << 14)] for x in series] if n else [np.full(1, np.nan)] * len(COLUMNS)
                    fixed = [name, status if not i else None, n, *meta]
                    arrays = [pa.array([v] * len(part[0]), t) for v, t in zip(fixed, types.values())]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.float64(), from_pandas=True) for x in part)], list(types))

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long' if t == pa.int64() else 'double'}" for n, t in types.items())
    done = files.mapInArrow(points_of, schema)
    kinds = {"quality": "int", "cadence": "long"}
    points = done.where("n > 0").select("path", *HEADER, *[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in COLUMNS])
    return points, done.where("status IS NOT NULL").groupBy("path").agg(F.first("status").alias("status"), F.first("n").cast("int").alias("n"))


def star_catalog(spark: SparkSession, path: str, kind: str = "auto", names: list[str] | None = None) -> DataFrame:
    """A headerless target catalog (gz too) by the places of its columns; an extended one (xctl) by the names given, or by its header."""
    if kind == "auto":
        low = path.lower()
        kind = "xctl" if "xctl" in low else "ctl" if "ctl" in low else "tic"
    if kind not in ("ctl", "tic", "xctl"):
        raise ValueError(f"unknown catalog {kind!r}")
    df = spark.read.csv(path, header=kind == "xctl" and names is None)
    if kind == "xctl":
        return df.toDF(*names) if names else df
    places = CTL if kind == "ctl" else TIC
    texts = {"splists"}
    value = lambda i, n: F.col(f"_c{i}") if n in texts else F.expr(f"try_cast(_c{i} AS {'bigint' if n == 'ID' else 'double'})")
    return df.select(*[(value(i, n) if f"_c{i}" in df.columns else F.lit(None).cast("double")).alias(n) for i, n in places.items()])


def save_series(series: DataFrame, path: str) -> None:
    """A cleaned series, a directory for each sector."""
    series.write.mode("overwrite").partitionBy("sector").parquet(path)


def save_outputs(path: str, **tables: DataFrame) -> None:
    """A table under path for each name; empty ones leave their schema."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_catalog(df: DataFrame, path: str) -> None:
    """A catalog that meets its contract; otherwise an error, and nothing is written."""
    issues = [r.issue for r in catalog.schema_issues(df).collect()]  # one row for each rule
    if issues:
        raise ValueError("catalog breaks its contract: " + ", ".join(sorted(issues)))
    df.write.mode("overwrite").parquet(path)


def save_labelled(df: DataFrame, path: str, counted: list[str]) -> None:
    """Rows in the order of their ids, and how many rows each value of the counted columns has."""
    order = [c for c in ("source_row", "tic_id", "path", "candidate_id") if c in df.columns]
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(f"{path}/rows")
    marked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("UNLABELED")).alias("value")) for c in counted])).alias("x"))
    marked.groupBy("x.column", "x.value").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def aligned(df: DataFrame, scalars: list[str]) -> DataFrame:
    """df with exactly these scalars, in this order after its other columns; absent ones are null."""
    return df.select(*[c for c in df.columns if c not in scalars], *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in scalars])
