"""Operators on observation tables, keyed by target: cleaning, detrending, measuring, vetting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C
from ..sources.tables import importable, kept as stored
from . import single
from .single import MAD, drawn, mixed, partial_median, placed_median, resampled  # noqa: F401 (others take them from here)

K = ["tic_id", "sector"]
#: Points of a series that one task may hold.
MOST = 1 << 18
#: Quality bits by preset.
MASKS = {"none": 0, "minimal": 2 | 4 | 8 | 64 | 2048 | 4096 | 8192 | 16384, "conservative": 2 | 4 | 8 | 64 | 2048 | 4096 | 8192 | 16384 | 32 | 128 | 256 | 512 | 1024, "strict": 32767}


def robust(df: DataFrame, keys: list[str], column: str, name: str = "") -> DataFrame:
    """(keys, median, sigma): the median and 1.4826 times the median deviation from it, nulls skipped."""
    med, sig = f"{name}median", f"{name}sigma"
    centre = df.groupBy(*keys).agg(F.median(column).alias(med))
    spread = df.select(*keys, column).join(centre, keys).groupBy(*keys).agg(F.first(med).alias(med), (F.median(F.abs(F.col(column) - F.col(med))) * MAD).alias(sig))
    return spread


def quality_filter(obs: DataFrame, mode: str = "conservative") -> DataFrame:
    if mode not in MASKS:
        raise ValueError(f"unknown quality mode {mode!r}")
    return obs.where(F.col("quality").bitwiseAND(MASKS[mode]) == 0)


def flag_counts(obs: DataFrame) -> DataFrame:
    """(keys, bit, n) of the bits that occur."""
    bits = F.array(*[F.lit(1 << i) for i in range(15)])
    return obs.withColumn("bit", F.explode(bits)).where(F.col("quality").bitwiseAND(F.col("bit")) != 0).groupBy(*K, "bit").agg(F.count("*").alias("n"))


def flux_validity(obs: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    """(keys, valid): at least half finite and positive, a positive median, and some spread."""
    x = C.finite(F.col(column))
    good = F.when(x > 0, x)
    base = obs.select(*K, good.alias("x"))
    share = base.groupBy(*K).agg((F.count("x") / F.count("*")).alias("share"))
    return share.join(robust(base, K, "x"), K).select(*K, ((F.col("share") >= least) & (F.col("median") > 0) & (F.col("sigma") > 0)).alias("valid"))


def choose_flux(obs: DataFrame, preferred: str = "pdcsap") -> DataFrame:
    """(keys, source, warning): the preferred flux if valid for the target, else the other, else NONE."""
    p = flux_validity(obs, "pdcsap_flux").withColumnRenamed("valid", "p")
    s = flux_validity(obs, "sap_flux").withColumnRenamed("valid", "s")
    first, other = ("p", "s") if preferred == "pdcsap" else ("s", "p")
    names = {"p": "PDCSAP", "s": "SAP"}
    warn = {"p": "PDCSAP_UNAVAILABLE_OR_INVALID_USED_SAP", "s": "SAP_INVALID_USED_PDCSAP"}
    both = p.join(s, K)
    source = F.when(F.col(first), names[first]).when(F.col(other), names[other]).otherwise("NONE")
    return both.select(*K, source.alias("source"), F.when(~F.col(first) & F.col(other), warn[first]).alias("warning"))


def normalise(obs: DataFrame, flux: str = "pdcsap_flux") -> DataFrame:
    """obs with flux_norm, divided by the target's median of positive flux; and flux_norm_err, if there is an error of the flux, by the same."""
    good = F.when(C.finite(F.col(flux)) > 0, F.col(flux))
    middle = F.median(good).over(Window.partitionBy(*K))
    err = {"flux_norm_err": C.finite(F.col(f"{flux}_err")) / middle} if f"{flux}_err" in obs.columns else {}
    return obs.withColumns({"flux_norm": good / middle} | err)


def clean(obs: DataFrame, mode: str = "conservative", high: float = 7.0, low: float = 15.0) -> DataFrame:
    """Kept cadences, with flags of outliers, which are left in."""
    kept = normalise(obs)
    kept = (quality_filter(kept, mode) if "quality" in obs.columns else kept).where("time IS NOT NULL AND flux_norm > 0")
    stats = robust(kept, K, "flux_norm")
    up = F.col("flux_norm") > F.col("median") + high * F.col("sigma")
    down = F.col("flux_norm") < F.col("median") - low * F.col("sigma")
    return kept.join(stats, K).withColumns({"high_outlier": up, "low_outlier": down})


def without_outliers(cleaned: DataFrame, remove_low: bool = False) -> DataFrame:
    """High outliers are dropped, low ones (a deep dip may be one) only if asked for."""
    keep = ~F.col("high_outlier")
    return cleaned.where(keep & ~F.col("low_outlier") if remove_low else keep)


#: What is stored of cleaned points; their outliers are told by FLAGS.
POINTS, FLAGS = [*K, "cadence", "time", "flux_norm", "quality", "centroid_col", "centroid_row"], ["high_outlier", "low_outlier"]


def clean_warnings(summary: DataFrame, obs_columns: list[str], most: float = 0.6) -> DataFrame:
    """summary with warnings: a quality column that isn't there, or too many points gone."""
    missing = F.lit("quality" not in obs_columns)
    return summary.withColumn("warnings", C.present((missing, "QUALITY_COLUMN_MISSING"), (F.col("removed_fraction") > most, "HIGH_REMOVED_FRACTION")))


def gap_metrics(obs: DataFrame) -> DataFrame:
    """(keys, baseline, median_dt_days, n_gaps, largest_gap)."""
    step = obs.select(*K, "time", (F.col("time") - F.lag("time").over(Window.partitionBy(*K).orderBy("time"))).alias("dt"))
    one = step.groupBy(*K).agg((F.max("time") - F.min("time")).alias("baseline"), F.median("dt").alias("median_dt_days"), F.max("dt").alias("largest_gap"))
    gaps = step.join(one.select(*K, "median_dt_days"), K).groupBy(*K).agg(F.sum(F.when(F.col("dt") > 5 * F.col("median_dt_days"), 1).otherwise(0)).alias("n_gaps"))
    return one.join(gaps, K)


def quality_summary(obs: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """(keys, n_raw, n_finite, n_kept, n_final, removed_fraction, median_flux, noise_ppm, rms_ppm, n_high, n_low, status). cleaned: what `clean` made of obs, where that is stored already."""
    raw = obs.groupBy(*K).agg(F.count("*").alias("n_raw"), F.count(F.when(C.finite(F.col("time")).isNotNull() & (C.finite(F.col("pdcsap_flux")) > 0), 1)).alias("n_finite"), F.median("pdcsap_flux").alias("median_flux"))
    c = clean(obs) if cleaned is None else cleaned
    out = c.groupBy(*K).agg(F.count("*").alias("n_kept"), F.sum(F.col("high_outlier").cast("int")).alias("n_high"), F.sum(F.col("low_outlier").cast("int")).alias("n_low"))
    final = c.where("NOT high_outlier").drop("median", "sigma")
    stats = robust(final, K, "flux_norm")
    rms = final.join(stats, K).groupBy(*K).agg(F.count("*").alias("n_final"), (F.sqrt(F.avg(F.pow(F.col("flux_norm") - F.col("median"), F.lit(2)))) * 1e6).alias("rms_ppm"), (F.first("sigma") * 1e6).alias("noise_ppm"))
    both = raw.join(out, K, "left").join(rms, K, "left")
    return both.withColumn("removed_fraction", 1 - F.coalesce("n_final", F.lit(0)) / F.col("n_raw")).withColumn("status", F.when(F.coalesce("n_final", F.lit(0)) == 0, "NO_VALID_POINTS_AFTER_MASKING").when(F.col("n_final") < 500, "TOO_FEW_CLEAN_POINTS").otherwise("OK"))


def preprocessed(obs: DataFrame, preferred: str = "pdcsap", mode: str = "conservative", least: int = 500) -> tuple[DataFrame, DataFrame]:
    """(clean, summary): each target's chosen flux, cleaned, without high outliers; and what cleaning left of every target, with flux_source, status and warnings.

    The flux that is not preferred stands in for one that is no good, with a warning; a target without
    either has the status NO_VALID_FLUX and no points. Points lost for quality, and a quality column
    that isn't there, are warned of too.
    """
    c = F.col
    chosen = choose_flux(obs, preferred).select(*K, c("source").alias("flux_source"), c("warning").alias("_warned"))
    flux = F.when(c("flux_source") == "PDCSAP", C.finite(c("pdcsap_flux"))).when(c("flux_source") == "SAP", C.finite(c("sap_flux")))
    s = obs.join(chosen, K).where("flux_source <> 'NONE'").withColumn("pdcsap_flux", flux).drop("_warned")
    clean_ = without_outliers(clean(s, mode)).drop("median", "sigma", "high_outlier", "low_outlier")
    n = obs.groupBy(*K).agg(F.count("*").alias("n_raw"))
    left = s.groupBy(*K).agg(F.count("*").alias("_n")).join(clean_.groupBy(*K).agg(F.count("*").alias("n_final")), K, "left")
    out = chosen.join(n, K).join(left, K, "left").na.fill(0, ["n_final"])
    status = F.when(c("flux_source") == "NONE", "NO_VALID_FLUX").when(c("n_final") == 0, "NO_VALID_POINTS_AFTER_MASKING").when(c("n_final") < least, "TOO_FEW_CLEAN_POINTS").otherwise("OK")
    out = out.withColumns({"removed_fraction": F.when(c("flux_source") != "NONE", 1 - c("n_final") / c("n_raw")), "status": status})
    out = clean_warnings(out, obs.columns).withColumn("warnings", F.concat_ws(";", "_warned", "warnings"))
    return clean_, out.select(*K, "flux_source", "n_raw", "n_final", "removed_fraction", "status", "warnings")


#: What `cleaned` says of each series.
SUMMARY = "n_raw long, n_finite long, median_flux double, n_kept long, n_high long, n_low long, n_final long, rms_ppm double, noise_ppm double, baseline double, median_dt_days double, n_gaps long, largest_gap double, flux_source string"


def cleaned(obs: DataFrame, preferred: str | None = None, mode: str = "conservative", high: float = 7.0, low: float = 15.0, most: int = MOST, long: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(POINTS of each series without high outliers, `quality_summary` with `gap_metrics`), stored: over one shuffle of the points.

    With `preferred`, the points are of each target's chosen flux as in `preprocessed`, and the summary has flux_source too. Series of up to `most`
    points are cleaned in an Arrow group each, longer ones by `clean`.
    """
    importable(obs.sparkSession)
    kinds, facts = dict(obs.dtypes), [x.split()[0] for x in SUMMARY.split(", ")]
    fluxes = ["pdcsap_flux", "sap_flux"] if preferred else ["pdcsap_flux"]
    own = [k for k in POINTS if k != "flux_norm"]
    near, far = parted(obs.select(*own, *fluxes).where(" AND ".join(f"{k} IS NOT NULL" for k in K)), K, most, long)

    def kernel(t: pa.Table) -> pa.Table:
        flux = {f: t.column(f).to_numpy().astype(float) for f in fluxes}
        time, quality = t.column("time").to_numpy().astype(float), t.column("quality")
        usable = ((quality.fill_null(0).to_numpy() & MASKS[mode]) == 0) & quality.is_valid().to_numpy()
        first = flux["pdcsap_flux"]
        x, keep, up, down = single.tidied(time, first, usable, high, low)
        raw = t.column("pdcsap_flux").drop_null().to_numpy()
        row = {k: t.column(k)[0].as_py() for k in K} | {"n_raw": t.num_rows, "n_finite": int((np.isfinite(time) & np.isfinite(first) & (first > 0)).sum()), "median_flux": placed_median(np.sort(raw)) if len(raw) else None}
        row |= single.cleaning_facts(t.num_rows, x, keep, up, down) | single.gaps(time)
        if preferred:
            order = ["pdcsap_flux", "sap_flux"] if preferred == "pdcsap" else ["sap_flux", "pdcsap_flux"]
            chosen = next((f for f in order if single.valid_flux(flux[f])), None)
            row["flux_source"] = {"pdcsap_flux": "PDCSAP", "sap_flux": "SAP"}.get(chosen, "NONE")
            if chosen == "sap_flux":
                x, keep, up, down = single.tidied(time, flux[chosen], usable, high, low)
            elif chosen is None:
                keep = np.zeros(len(time), bool)
        at = np.flatnonzero(keep & ~up)
        points = t.select(own).take(pa.array(at))
        points = points.append_column("flux_norm", pa.array(x[at]))
        told = pa.Table.from_pylist([row], pa.schema([t.schema.field(k) for k in K] + types))  # what is said of the series, a row without a point
        return pa.concat_tables([told, points], promote_options="default").select([*own, "flux_norm", *facts])

    types = [pa.field(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in SUMMARY.split(", ")]
    done = stored(dealt(near, K).groupBy(*K).applyInArrow(kernel, ", ".join(f"{k} {kinds[k]}" for k in own) + ", flux_norm double, " + SUMMARY), "cleaned")
    points, summary = done.where("n_raw IS NULL").select(*POINTS), done.where("n_raw IS NOT NULL").select(*K, *facts)
    if far is not None:
        far = stored(far, "long")
        if preferred:
            left, told = preprocessed(far, preferred, mode)
        else:
            left, told = without_outliers(clean(far, mode, high, low)), far.select(*K).distinct().withColumn("flux_source", F.lit(None).cast("string"))
        points = points.unionByName(stored(left.select(*POINTS), "cleaned"))
        summary = summary.unionByName(stored(quality_summary(far).join(gap_metrics(far), K).join(told.select(*K, "flux_source"), K).select(*summary.columns), "summary"))
    left = F.coalesce("n_final", F.lit(0))
    summary = summary.withColumn("removed_fraction", 1 - left / F.col("n_raw")).withColumn("status", F.when(left == 0, "NO_VALID_POINTS_AFTER_MASKING").when(F.col("n_final") < 500, "TOO_FEW_CLEAN_POINTS").otherwise("OK"))
    return points, summary if preferred else summary.drop("flux_source")


def rolling_trend(series: DataFrame, value: str, days: float = 1.0, keys: list[str] = K, piece: int = 8192) -> DataFrame:
    """series with `trend`: a centred rolling median over about `days`, odd in points by each target's cadence, of a fifth of its points (three at least); drawn by index where there are fewer; the median of all where the series has under five points or nothing to draw from.

    A task gets `piece` points of a target in order of time, and those within half a width of them.
    """
    w = Window.partitionBy(*keys).orderBy("time")
    step = series.withColumn("_dt", F.col("time") - F.lag("time").over(w)).groupBy(*keys).agg(F.median("_dt").alias("_m"), F.count("*").alias("_n"), F.median(value).alias("_whole"))
    raw = F.greatest(F.lit(5), F.bround(F.lit(float(days)) / F.when(F.col("_m") > 0, F.col("_m"))).cast("int"))
    width = step.select(*keys, "_n", "_whole", F.coalesce(raw + (raw + 1) % 2, F.lit(0)).alias("_w"))
    placed = series.join(width, keys).withColumn("_at", F.row_number().over(w) - 1)
    half = F.expr("_w div 2")
    piece_of = lambda x: F.floor(x / piece).cast("long")
    near = F.sequence(piece_of(F.greatest(F.col("_at") - half, F.lit(0))), piece_of(F.least(F.col("_at") + half, F.col("_n") - 1)))
    dealt = placed.select(*keys, "_at", "_w", C.finite(F.col(value)).alias("_x"), F.explode(near).alias("_piece"))

    def medians(t: pa.Table) -> pa.Table:
        at, x, n = t.column("_at").to_numpy(), t.column("_x").to_numpy(zero_copy_only=False).astype(float), t.column("_w")[0].as_py()
        order = np.argsort(at)
        at, x, mine = at[order], x[order], t.column("_piece")[0].as_py()
        own = np.flatnonzero(at // piece == mine)
        out = single.running_median(x, own, n)
        rows = t.take(pa.array(order[own])).select([*keys, "_at"])
        return rows.append_column("_trend", pa.array(out, from_pandas=True))

    kinds = dict(dealt.dtypes)
    found = dealt.groupBy(*keys, "_piece").applyInArrow(medians, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", _at {kinds['_at']}, _trend double")
    drawn = interpolate(placed.drop("_piece").join(found, [*keys, "_at"]), "_trend", keys, "_at")
    return drawn.withColumn("trend", F.when(F.col("_n") < 5, F.col("_whole")).otherwise(F.coalesce("_trend", "_whole"))).drop("_n", "_w", "_at", "_whole", "_trend")


def interpolate(series: DataFrame, value: str, keys: list[str] = K, by: str = "time") -> DataFrame:
    """series with nulls of `value` filled on a line in time (or another column) between neighbours, and by the nearest at the ends. Two running windows, one in each direction: linear in the points of a series."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(by).alias("time"), F.col(value).alias("v")))
    seen = lambda order: F.last(known, True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    s = series.withColumn("_a", seen(F.asc(by))).withColumn("_b", seen(F.desc(by)))
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["time"] == b["time"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(by) - a["time"]) / (b["time"] - a["time"]))
    return s.withColumn(value, F.coalesce(F.col(value), line)).drop("_a", "_b")


def detrend(series: DataFrame, value: str = "flux_norm", days: float = 1.0, masked: Column | None = None) -> DataFrame:
    """series with flux_detrended; with a mask, the trend is fitted outside it and drawn across."""
    if masked is None:
        t = rolling_trend(series, value, days)
    else:
        outside = rolling_trend(series.where(~masked), value, days).select(*K, "cadence", "trend")
        t = interpolate(series.join(outside, [*K, "cadence"], "left"), "trend")
    x = F.col(value) / F.col("trend")
    return t.withColumn("flux_detrended", x / F.median(x).over(Window.partitionBy(*K)))


def variants(series: DataFrame, windows: dict[str, float], value: str = "flux_norm", outside: float | None = None, most: int = MOST, long: bool | None = None) -> DataFrame:
    """`detrend` of each series by each width (name: days), with a column `variant`; with `outside`, the trend is fitted out of windows so many durations wide, of the ephemeris that series carries.

    Series of up to `most` points are one Arrow group each for all widths, so that points are shuffled once.
    """
    importable(series.sparkSession)
    near, far = parted(series, K, most, long)
    names = [x for x in series.columns if x not in ("trend", "flux_detrended", "variant")]
    order = [(x, "ascending") for x in ("time", "cadence") if x in names]

    def kernel(t: pa.Table) -> pa.Table:
        t = t.select(names).sort_by(order)
        time, x = t.column("time").to_numpy(), t.column(value).to_numpy().astype(float)
        masked = None
        if outside is not None:
            period, t0, duration = (t.column(c)[0].as_py() for c in ("period", "t0", "duration"))
            masked = single.window(single.phase_days(time, period, t0), period, duration, outside)
        out = []
        for name, days in windows.items():
            trend, flat = single.detrended(time, x, days, masked)
            out.append(t.append_column("trend", pa.array(trend, from_pandas=True)).append_column("flux_detrended", pa.array(flat, from_pandas=True)).append_column("variant", pa.array([name] * t.num_rows, pa.string())))
        return pa.concat_tables(out)

    done = dealt(near.select(*names), K).groupBy(*K).applyInArrow(kernel, ", ".join(f"`{k}` {v}" for k, v in near.select(*names).dtypes) + ", trend double, flux_detrended double, variant string")
    if far is None:
        return done
    masked = None if outside is None else in_window(outside)
    for name, days in windows.items():
        done = done.unionByName(detrend(far.select(*names), value, days, masked).withColumn("variant", F.lit(name)).select(*done.columns))
    return done


def in_window(width: float) -> Column:
    return C.transit_mask(F.col("time"), F.col("period"), F.col("t0"), F.col("duration"), width)


def transit_counts(series: DataFrame, keys: list[str] = K) -> DataFrame:
    """(keys, n_transits, n_full): events with a point inside, and with three."""
    e = series.where(in_window(1.0)).groupBy(*keys, C.event_number(F.col("time"), F.col("period"), F.col("t0")).alias("event")).agg(F.count("*").alias("c"))
    return e.groupBy(*keys).agg(F.count("*").alias("n_transits"), F.sum((F.col("c") >= 3).cast("int")).alias("n_full"))


def depth_snr(series: DataFrame, value: str, keys: list[str] = K) -> DataFrame:
    """(keys, n_in, depth, snr, local_snr); local noise from within five widths if that has twenty points."""
    x = F.col(value)
    s = series.select(*keys, x.alias("x"), in_window(1.0).alias("i"), in_window(5.0).alias("near"))
    one = s.groupBy(*keys).agg(F.sum(F.col("i").cast("int")).alias("n_in"), F.sum((~F.col("i")).cast("int")).alias("n_out"), F.sum((F.col("near") & ~F.col("i")).cast("int")).alias("n_near"), F.median(F.when(F.col("i"), F.col("x"))).alias("m_in"), F.median(F.when(~F.col("i"), F.col("x"))).alias("m_out"), F.median(F.when(F.col("near") & ~F.col("i"), F.col("x"))).alias("m_near"))
    two = s.join(one, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n_in", "n_out", "n_near", "m_in", "m_out")], (F.median(F.when(~F.col("i"), F.abs(F.col("x") - F.col("m_out")))) * MAD).alias("sg"), (F.median(F.when(F.col("near") & ~F.col("i"), F.abs(F.col("x") - F.col("m_near")))) * MAD).alias("sl"))
    local = F.when(F.col("n_near") >= 20, F.col("sl")).otherwise(F.col("sg"))
    ok = (F.col("n_in") >= 3) & (F.col("n_out") >= 20)
    depth = F.col("m_out") - F.col("m_in")
    return two.select(*keys, "n_in", F.when(ok, depth).alias("depth"), F.when(ok, C.ratio(depth, F.col("sg")) * F.sqrt("n_in")).alias("snr"), F.when(ok, C.ratio(depth, local) * F.sqrt("n_in")).alias("local_snr"))


def event_depths(series: DataFrame, value: str, width: float = 5.0, keys: list[str] = K) -> DataFrame:
    """(keys, event, n_in, n_out, depth, err, coverage) of each event, from points within `width` durations of it."""
    ev = C.event_number(F.col("time"), F.col("period"), F.col("t0"))
    s = series.where(in_window(width)).select(*keys, ev.alias("event"), F.col(value).alias("x"), in_window(1.0).alias("i"))
    k = [*keys, "event"]
    one = s.groupBy(*k).agg(F.sum(F.col("i").cast("int")).alias("n_in"), F.sum((~F.col("i")).cast("int")).alias("n_out"), F.median(F.when(F.col("i"), F.col("x"))).alias("m_in"), F.median(F.when(~F.col("i"), F.col("x"))).alias("m_out"))
    two = s.join(one, k).groupBy(*k).agg(*[F.first(c).alias(c) for c in ("n_in", "n_out", "m_in", "m_out")], (F.median(F.when(~F.col("i"), F.abs(F.col("x") - F.col("m_out")))) * MAD).alias("noise"))
    ok = (F.col("n_in") >= 3) & (F.col("n_out") >= 6)
    cover = F.when((F.col("n_in") >= 3) & (F.col("n_out") >= 10), "ok").when(ok, "partial").otherwise("partial_or_sparse")
    return two.select(*k, "n_in", "n_out", F.when(ok, F.col("m_out") - F.col("m_in")).alias("depth"), F.when(ok, F.col("noise") / F.sqrt("n_in")).alias("err"), cover.alias("coverage"))


def odd_even(events: DataFrame, keys: list[str] = K) -> DataFrame:
    """(keys, odd_even_sigma): difference of median depths by parity over its error; 0 if a side is empty."""
    e = events.where("depth IS NOT NULL").withColumn("odd", F.pmod(F.col("event"), F.lit(2)) == 1)
    d, odd, err = F.col("depth"), F.col("odd"), F.col("err")
    one = e.groupBy(*keys).agg(F.median(F.when(odd, d)).alias("mo"), F.median(F.when(~odd, d)).alias("me"), F.median(d).alias("ma"), F.count(F.when(odd, 1)).alias("no"), F.count(F.when(~odd, 1)).alias("ne"), F.median(F.when(odd, err)).alias("eo"), F.median(F.when(~odd, err)).alias("ee"))
    two = e.join(one, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("mo", "me", "no", "ne", "eo", "ee")], (F.median(F.when(odd, F.abs(d - F.col("mo")))) * MAD).alias("so"), (F.median(F.when(~odd, F.abs(d - F.col("me")))) * MAD).alias("se"), (F.median(F.abs(d - F.col("ma"))) * MAD).alias("sa"))
    o = F.greatest(F.col("so") / F.sqrt("no"), F.col("eo"))
    v = F.greatest(F.col("se") / F.sqrt("ne"), F.col("ee"))
    below = F.when(o.isNull() | v.isNull(), F.col("sa")).otherwise(F.sqrt(o * o + v * v))
    return two.select(*keys, F.when((F.col("no") > 0) & (F.col("ne") > 0), F.coalesce(C.ratio(F.abs(F.col("mo") - F.col("me")), below), F.lit(0.0))).otherwise(0.0).alias("odd_even_sigma"))


def any_long(series: DataFrame, keys: list[str], most: int) -> bool:
    """Whether a series has more than `most` points: a count by key. Where none has, plans have no branch for them."""
    return not series.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty()


def parted(series: DataFrame, keys: list[str], most: int, long: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
    """`by_length`, and None for the longer ones if there are none; `long` says so where that is known."""
    if long is None:
        long = any_long(series, keys, most)
    return by_length(series, keys, most) if long else (series, None)


def by_length(series: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The series of up to `most` points, which one task may hold, and the longer ones."""
    s = series.join(series.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    return s.where(F.col("_n") <= most).drop("_n"), s.where(F.col("_n") > most).drop("_n")


def dealt(ready: DataFrame, keys: list[str]) -> DataFrame:
    """Series in several times as many tasks as cores: they are few bytes but much work, so that tasks made by size would be few and uneven."""
    return ready.repartition(8 * ready.sparkSession.sparkContext.defaultParallelism, *keys)


def secondary(series: DataFrame, value: str, keys: list[str] = K, most: int = MOST) -> DataFrame:
    """(keys, secondary_sigma, secondary_phase, secondary_depth): the strongest dip at another phase, 0.15 to 0.85 by 0.005, the first of equal ones; series of under fifty points have none.

    Series of up to `most` points go to an Arrow kernel, so that points are shuffled once; longer ones meet their phases before the shuffle.
    """
    importable(series.sparkSession)
    cycle = C.phase_days(F.col("time"), F.col("period"), F.col("t0")) / F.col("period")
    s = series.select(*keys, C.finite(F.col(value)).alias("x"), cycle.alias("c"), (F.col("duration") / F.col("period")).alias("w")).where("c IS NOT NULL AND w IS NOT NULL")
    near, far = by_length(s, keys, most)
    kinds = dict(s.dtypes)

    def kernel(t: pa.Table) -> pa.Table:
        x, c, w = (t.column(n).to_numpy() for n in ("x", "c", "w"))
        order = np.argsort(x, kind="stable")  # so that what a mask takes is sorted, and its median a place
        rows = single.phases(x[order], c[order], w[0])
        own = [pa.array([t.column(k)[0].as_py()] * len(rows), t.schema.field(k).type) for k in keys]
        types = [pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([*own, *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(types))], [*keys, "phase", "n_in", "m_in", "m_out", "noise"])

    done = dealt(near, keys).groupBy(*keys).applyInArrow(kernel, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", phase double, n_in long, m_in double, m_out double, noise double")
    grid = F.transform(F.sequence(F.lit(0), F.lit(140)), lambda i: 0.15 + i * 0.005)
    far = far.withColumn("phase", F.explode(grid))
    dist = F.abs(C.floor_mod(F.col("c") - F.col("phase") + 0.5, F.lit(1.0)) - 0.5)
    far = far.withColumns({"i": dist < 0.5 * F.col("w"), "o": (dist < F.greatest(3 * F.col("w"), F.lit(0.04))) & (dist >= 0.5 * F.col("w")) & (F.abs(F.col("c")) > 2 * F.col("w"))}).where("i OR o")
    k = [*keys, "phase"]
    one = far.groupBy(*k).agg(F.count(F.when(F.col("i"), 1)).alias("n_in"), F.count(F.when(F.col("o"), 1)).alias("n_out"), F.median(F.when(F.col("i"), F.col("x"))).alias("m_in"), F.median(F.when(F.col("o"), F.col("x"))).alias("m_out"))
    two = far.join(one.where("n_in >= 3 AND n_out >= 10"), k).groupBy(*k).agg(*[F.first(c).alias(c) for c in ("n_in", "m_in", "m_out")], (F.median(F.when(F.col("o"), F.abs(F.col("x") - F.col("m_out")))) * MAD).alias("noise"))
    two = done.unionByName(two)
    sig = C.ratio(F.col("m_out") - F.col("m_in"), F.col("noise")) * F.sqrt("n_in")
    best = two.select(*keys, "phase", F.round(sig, 9).alias("sig"), (F.col("m_out") - F.col("m_in")).alias("depth")).where("sig IS NOT NULL").groupBy(*keys).agg(F.max(F.struct(F.col("sig"), (-F.col("phase")).alias("p"), "depth")).alias("b"))
    enough = series.groupBy(*keys).agg(F.count(value).alias("_c")).where("_c >= 50").drop("_c")
    return best.join(enough, keys, "left_semi").select(*keys, F.greatest(F.col("b.sig"), F.lit(0.0)).alias("secondary_sigma"), (-F.col("b.p")).alias("secondary_phase"), F.col("b.depth").alias("secondary_depth"))


def centroid_shift(series: DataFrame, keys: list[str] = K) -> DataFrame:
    """(keys, shift, sigma): offset of the centroid inside windows, over its error, both axes in quadrature."""
    s = series.withColumn("i", in_window(1.0))
    out = None
    for axis in ("col", "row"):
        x = F.col(f"centroid_{axis}")
        one = s.groupBy(*keys).agg(F.median(F.when(F.col("i"), x)).alias("mi"), F.median(F.when(~F.col("i"), x)).alias("mo"), F.count(F.when(F.col("i"), 1)).alias("n"))
        two = s.join(one, keys).groupBy(*keys).agg((F.first("mi") - F.first("mo")).alias(f"d_{axis}"), C.ratio(F.abs(F.first("mi") - F.first("mo")) * F.sqrt(F.first("n")), F.median(F.when(~F.col("i"), F.abs(x - F.col("mo")))) * MAD).alias(f"z_{axis}"))
        out = two if out is None else out.join(two, keys)
    return out.select(*keys, F.sqrt(F.pow("d_col", F.lit(2)) + F.pow("d_row", F.lit(2))).alias("shift"), F.sqrt(F.pow(F.coalesce("z_col", F.lit(0.0)), F.lit(2)) + F.pow(F.coalesce("z_row", F.lit(0.0)), F.lit(2))).alias("sigma"))


def red_noise(series: DataFrame, value: str, lags: int = 20, keys: list[str] = K) -> DataFrame:
    """(keys, red_noise): median over lags of the absolute autocorrelation."""
    y = F.col(value) - F.median(value).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy("time")
    s = series.select(*keys, "time", y.alias("y"))
    s = s.select(*keys, "y", *[F.lag("y", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = s.groupBy(*keys).agg(F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col("y") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    each = sums.select(*keys, F.explode(F.array(*[F.abs(C.ratio(F.col(f"s{k}"), F.col("yy"))) for k in range(1, lags + 1)])).alias("r"))
    return each.groupBy(*keys).agg(F.median("r").alias("red_noise"))


def red_noise_beta(series: DataFrame, value: str, keys: list[str] = K) -> DataFrame:
    """(keys, beta): spread of means of whole blocks of points, of about a `duration` each (three points at least), over what white noise would give, within 1 to 5; 1 under 100 points, if a block is a fifth of the series, or where nothing spreads."""
    w = Window.partitionBy(*keys).orderBy("time")
    s = series.select(*keys, "time", "duration", C.finite(F.col(value)).alias("x")).where("x IS NOT NULL AND time IS NOT NULL")
    s = s.withColumns({"at": F.row_number().over(w) - 1, "dt": F.col("time") - F.lag("time").over(w)})
    size = s.groupBy(*keys).agg(F.count("*").alias("n"), F.median("dt").alias("dt"), F.first("duration").alias("duration"))
    block = F.greatest(F.lit(3), F.bround(C.ratio(F.col("duration"), F.when(F.col("dt") > 0, F.col("dt")))).cast("int"))
    size = size.select(*keys, "n", F.when((F.col("duration") > 0) & (F.col("dt") > 0), block).alias("size"))
    means = s.drop("dt", "duration").join(size.where("n >= 100 AND size < n div 5"), keys).groupBy(*keys, F.expr("at div size").alias("block")).agg(F.avg("x").alias("x"), F.count("*").alias("c"), F.first("size").alias("size")).where("c = size")
    a = robust(s, keys, "x").select(*keys, F.col("sigma").alias("s1"))
    b = robust(means, keys, "x").select(*keys, F.col("sigma").alias("sb"))
    both = a.join(size, keys).join(b, keys, "left")
    return both.select(*keys, F.coalesce(C.clip(C.ratio(F.col("sb") * F.sqrt("size"), F.col("s1")), 1, 5), F.lit(1.0)).alias("beta"))


def phase_bins(series: DataFrame, value: str, bins: int = 50, least: int = 3, keys: list[str] = K) -> DataFrame:
    """(keys, bin, n, median) of the folded series."""
    cycle = C.phase_days(F.col("time"), F.col("period"), F.col("t0")) / F.col("period") + 0.5
    b = F.least(F.greatest(F.floor(cycle * bins), F.lit(0)), F.lit(bins - 1))
    return series.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.median(value).alias("median")).where(F.col("n") >= least)


#: SQL's form of a draw, for the tests of queries: the place of r and i among n.
DRAW = """CAST((xor(a5, a5 >> 16) * CAST(n AS UBIGINT)) >> 32 AS BIGINT) AS place FROM (SELECT *, (xor(a4, a4 >> 13) * 3266489909) & 4294967295 AS a5 FROM (SELECT *, (xor(a3, a3 >> 16) * 2246822507) & 4294967295 AS a4 FROM (SELECT *, (xor(a2, a2 >> 16) + CAST(r AS UBIGINT) * 2654435761) & 4294967295 AS a3
FROM (SELECT *, (xor(a1, a1 >> 13) * 3266489909) & 4294967295 AS a2 FROM (SELECT *, (xor(a0, a0 >> 16) * 2246822507) & 4294967295 AS a1 FROM (SELECT *, CAST(i AS UBIGINT) AS a0 FROM"""


def bootstrap_depth(events: DataFrame, replicates: int = 500, keys: list[str] = K) -> DataFrame:
    """(keys, err): spread of medians of events drawn with replacement, one Arrow group a candidate; none for one event."""
    importable(events.sparkSession)
    kinds = dict(events.dtypes)

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by("event")
        x = t.column("depth").to_numpy()
        own = [t.column(k).slice(0, 1) for k in keys]
        return pa.Table.from_arrays([*own, pa.array([float(np.std(resampled(x, replicates), ddof=1)) if len(x) > 1 else None], pa.float64())], [*keys, "err"])

    e = events.select(*keys, "event", C.finite(F.col("depth")).alias("depth")).where("depth IS NOT NULL")
    return e.groupBy(*keys).applyInArrow(kernel, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", err double").where("err IS NOT NULL")
