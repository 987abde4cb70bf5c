"""Queries on records and correlations: normalising, channels, quality, dispersion, interferograms and noise removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.operators import arrays, interferometry, signal
from strataspark.sources.fixtures import table

from .registry import query


def _traces(spark, sf_dir):
    return table(spark, sf_dir, "traces").select("sta_key", "day", "label", F.col("data").cast("array<double>").alias("data"))


@query("daily_normalise", "select sta_key, day, round(list_sum(list_transform(range(1, 65), lambda i: cast(data[i] as double) / (65 - i) * 60)), 5) as total, round(cast(data[64] as double) * 60, 6) as last from traces")
def daily_normalise(spark, sf_dir):
    """Correlations over the number of samples that each lag has, times a full day's."""
    n = F.zip_with("data", F.sequence(F.lit(64), F.lit(1)), lambda d, w: d / w * 60)
    return _traces(spark, sf_dir).select("sta_key", "day", F.round(arrays.total(n), 5).alias("total"), F.round(F.element_at(n, -1), 6).alias("last"))


@query("channel_days", """with t as (select user_id as sta, cast(ts as date) as day, count(distinct event_type) as n, min(event_type) as kind from events group by all), p as (select a.sta as sta1, a.sta + 1 as sta2, a.day, a.n as n1, b.n as n2, a.kind as kind1, b.kind as kind2 from t a join t b on b.sta = a.sta + 1 and b.day = a.day),
  f as (select *, row_number() over (partition by sta1, month(day) order by day) as k from p where n1 >= 2 and n2 >= 2), g as (select sta1, day as first, kind1, kind2 from f where k = 1)
  select p.sta1, p.sta2, g.kind1, g.kind2, count(*) as days from p join g on p.sta1 = g.sta1 and p.day >= g.first and p.kind1 = g.kind1 and p.kind2 = g.kind2 group by all""")
def channel_days(spark, sf_dir):
    """Days of neighbouring stations with the kinds of channels that the first day on which both have two or more fixes for the month."""
    e = table(spark, sf_dir, "events")
    t = e.groupBy(F.col("user_id").alias("sta"), F.to_date("ts").alias("day")).agg(F.count_distinct("event_type").alias("n"), F.min("event_type").alias("kind"))
    b = t.select((F.col("sta") - 1).alias("sta1"), F.col("sta").alias("sta2"), "day", F.col("n").alias("n2"), F.col("kind").alias("kind2"))
    p = t.select(F.col("sta").alias("sta1"), "day", F.col("n").alias("n1"), F.col("kind").alias("kind1")).join(b, ["sta1", "day"])
    g = p.where("n1 >= 2 and n2 >= 2").groupBy("sta1", F.month("day").alias("m")).agg(F.min_by(F.struct("day", "kind1", "kind2"), "day").alias("g")).select("sta1", "m", F.col("g.day").alias("first"), F.col("g.kind1").alias("kind1"), F.col("g.kind2").alias("kind2"))
    x = p.withColumn("m", F.month("day")).join(g, ["sta1", "m", "kind1", "kind2"]).where("day >= first")
    return x.groupBy("sta1", "sta2", "kind1", "kind2").agg(F.count("*").alias("days"))


@query("stack_quality", """with k as (select sta_key, cast(floor(day / 10) as bigint) as month, count(distinct label) as kinds, max(list_max(data)) as top, count(*) as n from traces group by all), s as (select sta_key, abs(lon - round(lon * 40) / 40) as off from stations)
  select k.sta_key, month, n, kinds from k join s using (sta_key) where off <= 0.001 and top <= 0.6 and n >= 2""")
def stack_quality(spark, sf_dir):
    """Months of stations that may be stacked: position as in the catalog, no NaN, no outsize maximum, more than one day."""
    t = _traces(spark, sf_dir).withColumn("bad", F.exists("data", lambda x: F.isnan(x)))
    k = t.groupBy("sta_key", F.floor(F.col("day") / 10).alias("month")).agg(F.count_distinct("label").alias("kinds"), F.max(F.array_max("data")).alias("top"), F.count("*").alias("n"), F.bool_or("bad").alias("bad"))
    s = table(spark, sf_dir, "stations").select("sta_key", F.abs(F.col("lon") - F.round(F.col("lon") * 40) / 40).alias("off"))
    return k.join(s, "sta_key").where("not bad and off <= 0.001 and top <= 0.6D and n >= 2").select("sta_key", "month", "n", "kinds")


@query("record_alignment", """with s as (select event_id, cast(date_diff('microsecond', date_trunc('day', ts), ts) as bigint) as us from events) select event_id, cast(round(us / 7000000.0) as bigint) as sample, us - cast(round(us / 7000000.0) as bigint) * 7000000 as shift_us from s""")
def record_alignment(spark, sf_dir):
    """The nearest sample of a day's grid of seven seconds to each record's start, and how far the record must be moved."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    k = F.round(us / 7000000.0).cast("bigint")
    return e.select("event_id", k.alias("sample"), (us - k * 7000000).alias("shift_us"))


@query("decimated_traces", "select sta_key, day, cast(16 as int) as n, round(0.5 + (sta_key % 7) / 10.0, 6) as middle from traces")
def decimated_traces(spark, sf_dir):
    """Records at a quarter of their rate; a steady record keeps its value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.repeat((0.5 + (b["sta_key"].to_numpy() % 7) / 10.0)[:, None], 64, axis=1)
                y = interferometry.decimated(x, 4)
                yield b[["sta_key", "day"]].assign(n=y.shape[1], middle=np.round(y[:, 8], 6))

    return _traces(spark, sf_dir).select("sta_key", "day").mapInPandas(run, "sta_key long, day long, n int, middle double")


def _pulses(at: np.ndarray, n: int, period: float, width: float) -> np.ndarray:
    """Rows of a wave packet around at."""
    t = np.arange(n) - at[:, None]
    return np.exp(-((t / width) ** 2)) * np.cos(2 * np.pi * t / period)


@query("frequency_time_analysis", """with t as (select sta_key, day, 90 + cast((sta_key * 7 + day) % 40 as int) as arrival from traces), b as (select unnest([8.0, 10.0, 12.0]) as band) select sta_key, day, band, round(300.0 / arrival, 3) as "group" from t cross join b""")
def frequency_time_analysis(spark, sf_dir):
    """Group velocities in three bands of wave packets that arrive at known times, for all records of a batch in one transform a band."""
    bands = np.array([8.0, 10.0, 12.0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in arrays.in_parts(batches):
            at = 90.0 + (b["sta_key"].to_numpy() * 7 + b["day"].to_numpy()) % 40
            f = interferometry.frequency_times(_pulses(at, 256, 10.0, 8.0), 1.0, np.full(len(b), 300.0), bands)
            yield pd.DataFrame({"sta_key": np.repeat(b["sta_key"].to_numpy(), 3), "day": np.repeat(b["day"].to_numpy(), 3), "band": np.tile(bands, len(b)), "group": np.round(f["group"].ravel(), 3)})

    return _traces(spark, sf_dir).select("sta_key", "day").mapInPandas(run, "sta_key long, day long, band double, group double")


@query("phase_matched_analysis")
def phase_matched_analysis(spark, sf_dir):
    """Group velocities of a dispersed wave under another, stronger packet, before and after a phase-matched filter; what the wave was made with is known."""
    periods = np.array([8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0])
    group = 2.9 + 0.02 * periods

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["sta_key"]:
                d, n = 400.0 + 5 * (key % 40), 1024
                x = interferometry.dispersed(n, 1.0, d, periods, group, 0.45, 0.2)
                x = x + _pulses(np.array([d / 1.9]), n, 12.0, 15.0)[0] * 3 * np.abs(x).max()
                both = np.stack([x, interferometry.phase_matched(x, 1.0, d, periods, group, 40.0)])
                f = interferometry.frequency_times(both, 1.0, np.array([d, d]), periods[1:5])["group"]
                rows += [(key, p, g, round(float(u), 4), round(float(v), 4)) for p, g, u, v in zip(periods[1:5], group[1:5], *f, strict=True)]
            yield pd.DataFrame(rows, columns=["sta_key", "band", "made_with", "before", "after"])

    return table(spark, sf_dir, "stations").select("sta_key").mapInPandas(run, "sta_key long, band double, made_with double, before double, after double")


@query("interferograms", """with t as (select sta_key, day, list_transform(range(1, 33), lambda i: (cast(data[32 + i] as double) + cast(data[33 - i] as double)) / 2) as s from traces), p as (select a.sta_key, a.day, a.s as x, b.s as y from t a join t b on b.day = a.day and b.sta_key = a.sta_key + 1)
  select sta_key, day, round(list_sum(list_transform(range(1, 7), lambda i: x[i] * y[7 - i])), 6) as ell5, round(list_sum(list_transform(range(1, 33), lambda i: x[i] * y[i])), 6) as hyp0, round(list_sum(list_transform(range(1, 30), lambda i: x[i] * y[i + 3])), 6) as hyp3 from p""")
def interferograms(spark, sf_dir):
    """Three-station interferograms of symmetric records: convolved for a source on the ellipse, correlated for one on the hyperbola."""
    d = F.col("data")
    s = _traces(spark, sf_dir).select("sta_key", "day", F.zip_with(F.slice(d, 33, 32), F.reverse(F.slice(d, 1, 32)), lambda p, n: (p + n) / 2).alias("s"))
    p = s.withColumnRenamed("s", "x").join(s.select((F.col("sta_key") - 1).alias("sta_key"), "day", F.col("s").alias("y")), ["sta_key", "day"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = np.stack(b["x"].to_list()), np.stack(b["y"].to_list())
                fx, fy = np.fft.rfft(x, 64), np.fft.rfft(y, 64)
                ell, hyp = np.fft.irfft(fx * fy, 64), np.fft.irfft(np.conj(fx) * fy, 64)
                yield b[["sta_key", "day"]].assign(ell5=np.round(ell[:, 5], 6), hyp0=np.round(hyp[:, 0], 6), hyp3=np.round(hyp[:, 3], 6))

    return p.mapInPandas(run, "sta_key long, day long, ell5 double, hyp0 double, hyp3 double")


@query("phase_shift_stack", "select sta_key, count(*) as n, cast(50 + sta_key % 20 as int) as arrival from traces group by sta_key")
def phase_shift_stack(spark, sf_dir):
    """Interferograms of several sources, each late by its path difference, moved back, weighted by the inverse of their noise and stacked by station: the stack's largest value is where the waves line up."""
    periods, velocity = np.array([5.0, 10.0, 40.0]), np.array([3.0, 3.0, 3.0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in arrays.in_parts(batches):
            difference = 3.0 * (b["day"].to_numpy() % 11)
            x = _pulses(50 + b["sta_key"].to_numpy() % 20 + difference / 3.0, 192, 10.0, 8.0)
            y = interferometry.phase_shifted(x, 1.0, difference, periods, velocity, 0.0)
            noise = np.sqrt((y[:, 120:] ** 2).mean(axis=1)) + 1e-3
            yield b[["sta_key", "day"]].assign(data=list(y / noise[:, None]))

    s = arrays.element_sum(_traces(spark, sf_dir).select("sta_key", "day").mapInPandas(run, "sta_key long, day long, data array<double>"), ["sta_key"])
    return s.select("sta_key", F.col("n").cast("bigint").alias("n"), (F.array_position("data", F.array_max("data")) - 1).cast("int").alias("arrival"))


@query("noise_removal", """with m as (select sta_key, count(*) as days from traces group by sta_key having count(*) >= 2) select sta_key, days, case sta_key % 3 when 0 then 'Z2-1' when 1 then 'ZP' else 'ZP-21' end as method, 0.0 as left_over from m""")
def noise_removal(spark, sf_dir):
    """Vertical records made of what the other channels predict, without it: nothing is left. The method goes by the channels that aren't all zero."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        key, z = int(p["sta_key"].iloc[0]), np.stack(p["data"].to_list())
        channels = {"P": z[:, ::-1] * (key % 3 != 0), "H": np.roll(z, 3, axis=1) * (key % 3 != 1)}
        used = [c for c in channels.values() if c.any()]
        method = "ZP-21" if len(used) == 2 else "ZP" if channels["P"].any() else "Z2-1"
        # what tilt and pressure add: a channel through a filter of its own
        made = np.fft.irfft(np.fft.rfft(used[0], 64) * np.exp(-0.1 * np.arange(33)), 64)
        left = interferometry.noise_removed(made, used, 64)
        return pd.DataFrame({"sta_key": [key], "days": [len(p)], "method": [method], "left_over": [abs(round(float(np.sqrt((left**2).mean())), 6))]})

    t = _traces(spark, sf_dir)
    enough = t.groupBy("sta_key").agg(F.count("*").alias("n")).where("n >= 2").select("sta_key")
    return t.join(enough, "sta_key").select("sta_key", "day", "data").groupBy("sta_key").applyInPandas(run, "sta_key long, days long, method string, left_over double")


@query("receiver_functions", "select sta_key, day, cast(4 + (sta_key + day) % 9 as int) as arrival, round(0.3 + 0.1 * (sta_key % 4), 1) as amplitude from traces")
def receiver_functions(spark, sf_dir):
    """Iterative deconvolution of radial records, the vertical one and a part of it at a known delay, by the vertical: the later arrival and its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, day, data in zip(b["sta_key"], b["day"], b["data"], strict=True):
                z = np.zeros(128)
                z[:64] = signal.taper(np.asarray(data))
                rf, _ = signal.deconvolve(z + (0.3 + 0.1 * (key % 4)) * np.roll(z, 4 + (key + day) % 9), z, 0.5, width=12.0)
                at = 3 + int(np.abs(rf[3:32]).argmax())
                rows.append((key, day, at, round(float(rf[at] / rf[0]), 1)))
            yield pd.DataFrame(rows, columns=["sta_key", "day", "arrival", "amplitude"])

    return _traces(spark, sf_dir).mapInPandas(run, "sta_key long, day long, arrival int, amplitude double")


@query("moved_out", """with r as (select (sqrt(1 / (3.7 * 3.7) - 0.06 * 0.06) - sqrt(1 / (6.5 * 6.5) - 0.06 * 0.06)) / (sqrt(1 / (3.7 * 3.7) - 0.045 * 0.045) - sqrt(1 / (6.5 * 6.5) - 0.045 * 0.045)) as stretch)
  select sta_key, cast(100 + sta_key % 30 as int) as before, cast(round((100 + sta_key % 30) * stretch) as int) as after from stations cross join r""")
def moved_out(spark, sf_dir):
    """Conversions of a steep ray stretched to the reference slowness: in an even earth model, all delays grow by the same factor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vp, vs = np.full(480, 6.5), np.full(480, 3.7)
        for b in batches:
            rows = []
            for key in b["sta_key"]:
                rf = _pulses(np.array([100.0 + key % 30]), 256, 1e9, 4.0)[0]
                rows.append((key, int(rf.argmax()), int(signal.move_out(rf, 0.2, 0.045, vp, vs, 0.5).argmax())))
            yield pd.DataFrame(rows, columns=["sta_key", "before", "after"])

    return table(spark, sf_dir, "stations").select("sta_key").mapInPandas(run, "sta_key long, before int, after int")


@query("first_days", "select sta_key, min(day) as first, max(day) as last, count(*) as days, cast(max(day) - min(day) + 1 - count(*) as bigint) as missing from traces group by sta_key")
def first_days(spark, sf_dir):
    """First and last day of each station, and how many days between are missing."""
    w = Window.partitionBy("sta_key").orderBy("day")
    t = _traces(spark, sf_dir).select("sta_key", "day").withColumn("gap", F.col("day") - F.lag("day").over(w) - 1)
    return t.groupBy("sta_key").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"), F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("missing"))
