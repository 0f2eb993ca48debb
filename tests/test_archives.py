"""FITS files, star catalogs and sinks, from bytes built here."""

import gzip
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import catalog
from transitlake.plans import registered
from transitlake.sources import archives

SF = "/root/testdata/sf0.001"


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80)


def block(cards):
    text = "".join(cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // archives.BLOCK) * archives.BLOCK).encode()


def fits(n=4):
    table = np.zeros(n, [("TIME", ">f8"), ("SAP_FLUX", ">f4"), ("QUALITY", ">i4"), ("CADENCENO", ">i4")])
    table["TIME"], table["SAP_FLUX"], table["QUALITY"], table["CADENCENO"] = np.arange(n) + 0.5, [1, np.nan, 3, 4][:n], [0, 8, 0, 16384][:n], range(n)
    data = table.tobytes()
    fields = [x for i, (k, f) in enumerate([("TIME", "D"), ("SAP_FLUX", "E"), ("QUALITY", "J"), ("CADENCENO", "J")], 1) for x in (card(f"TTYPE{i}", f"'{k}'"), card(f"TFORM{i}", f"'{f}'"))]
    first = block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), card("TICID", 77), card("SECTOR", 5), card("RADIUS", 1.25)])
    second = block([card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", table.itemsize), card("NAXIS2", n), card("PCOUNT", 0), card("TFIELDS", 4), card("CROWDSAP", 0.9), *fields])
    return first + second + data.ljust(-(-len(data) // archives.BLOCK) * archives.BLOCK, b"\0")


def test_fits_files(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    os.mkdir(f"{path}/deep")
    for name, data in {"a.fits": fits(), "deep/b.fits.gz": gzip.compress(fits(2)), "c.fits": b"junk", "d.fits": b"", "e.txt": fits()}.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    # d.fits has no byte: Spark's scan skips it
    points, files = archives.read_fits(spark, path)
    assert sorted((os.path.basename(r.path), r.status[:2], r.n) for r in files.collect()) == [("a.fits", "OK", 4), ("b.fits.gz", "OK", 2), ("c.fits", "UN", 0)]
    got = points.where("path LIKE '%a.fits'").orderBy("time").collect()
    assert [(r.time, r.sap_flux, r.quality, r.cadence) for r in got] == [(0.5, 1.0, 0, 0), (1.5, None, 8, 1), (2.5, 3.0, 0, 2), (3.5, 4.0, 16384, 3)]
    assert (got[0].tic_id, got[0].sector, got[0].crowdsap, got[0].stellar_radius, got[0].flfrcsap, got[0].pdcsap_flux, got[0].centroid_col) == (77, 5, 0.9, 1.25, None, None, None)


def test_star_catalogs(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    with gzip.open(f"{path}/ctl.csv.gz", "wt") as f:
        f.write("12345,0.9,list,7\nbad,,,\n")
    got = archives.star_catalog(spark, f"{path}/ctl.csv.gz").orderBy(F.desc_nulls_last("priority")).collect()
    assert [(r.ID, r.priority, r.splists) for r in got] == [(12345, 0.9, "list"), (None, None, None)]
    with open(f"{path}/tic_1.csv", "w") as f:
        f.write(",".join(str(i) for i in range(125)) + "\n")
    r = archives.star_catalog(spark, f"{path}/tic_1.csv", "tic").first()
    assert (r.ID, r.ra, r.Tmag, r.rad, r.objID) == (0, 13.0, 60.0, 70.0, 124.0)
    with pytest.raises(ValueError):
        archives.star_catalog(spark, path, "odd")


def test_sinks(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    c = catalog.harmonise(registered.decided(spark, SF)).withColumn("effective_snr", F.col("snr"))
    archives.save_catalog(c, f"{path}/catalog")
    assert spark.read.parquet(f"{path}/catalog").count() == c.count()
    with pytest.raises(ValueError):
        archives.save_catalog(c.withColumn("confidence", F.lit(2.0)), f"{path}/bad")
    assert not os.path.exists(f"{path}/bad")
    archives.save_outputs(path, failures=c.limit(0))
    assert spark.read.parquet(f"{path}/failures").columns == c.columns
    archives.save_labelled(c, f"{path}/labelled", ["final_class"])
    assert spark.read.parquet(f"{path}/labelled/counts").agg(F.sum("n")).first()[0] == c.count()
    assert archives.aligned(c, ["snr", "confidence"]).columns[-2:] == ["snr", "confidence"]
