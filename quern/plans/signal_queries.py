"""Signals: the embeddings as short signals of 64 values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from .base import rounded, table
from .catalog import query

E = "e as (select vec_id, embedding::double[] as x, list_reverse(embedding::double[]) as y from embeddings)"


def _signals(spark, sf):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", x.alias("x"), F.reverse(x).alias("y"))


@query("s50_described_signals", f"with {E} select vec_id, len(x)::int as n, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 9) as rms, round(list_max(list_transform(x, lambda v: abs(v))), 9) as peak from e")
def s50(spark, sf):
    d = signals.describe(F.col("x"))
    return rounded(_signals(spark, sf).select("vec_id", d["n"].alias("n"), d["rms"].alias("rms"), d["peak"].alias("peak")))


@query("r16_signal_difference", f"""with {E}, d as (select vec_id, list_transform(list_zip(x, y), lambda p: p[2] - p[1]) as d from e)
select vec_id, list_sum(list_transform(d, lambda v: abs(v))) = 0 as exact, round(list_max(list_transform(d, lambda v: abs(v))), 9) as max_absolute, round(list_sum(list_transform(d, lambda v: abs(v))) / len(d), 9) as mean_absolute,
  round(sqrt(list_sum(list_transform(d, lambda v: v * v)) / len(d)), 9) as rms from d""")
def r16(spark, sf):
    return rounded(_signals(spark, sf).select("vec_id", signals.difference(F.col("x"), F.col("y")).alias("d")).select("vec_id", "d.*"))


@query("w21_segment_energy", f"""with {E}, s as (select vec_id, i, x[i * 16 + 1:i * 16 + 16] as w from e, unnest(generate_series(0, 3)) u(i))
select vec_id, i::int as at, round(greatest(list_sum(list_transform(w, lambda v: v * v)) - list_sum(w) * list_sum(w) / 16, 0), 7) as energy from s""")
def w21(spark, sf):
    rows = _signals(spark, sf).select("vec_id", signals.running_sums(F.col("x")).alias("s"), signals.running_sums(F.transform("x", lambda v: v * v)).alias("q"), F.explode(F.array(*map(F.lit, range(4)))).alias("at"))
    return rounded(rows.select("vec_id", "at", signals.segment_energy(F.col("s"), F.col("q"), F.col("at") * 16, F.lit(16)).alias("energy")), 7)


@query("r20_median_filter", f"""with {E}, p as (select vec_id, i, x from e, unnest(generate_series(0, 63)) u(i)),
w as (select vec_id, i, list_sort(list_transform(generate_series(i - 2, i + 2), lambda j: x[case when j < 0 then -j when j >= 64 then 126 - j else j end + 1])) as w from p) select vec_id, i::int as at, round(w[3], 9) as value from w""")
def r20(spark, sf):
    return rounded(_signals(spark, sf).select("vec_id", F.posexplode(signals.median_filter(F.col("x"), 5)).alias("at", "value")))


@query("r17_r22_spectra", f"""with {E}, f as (select vec_id, t, list_transform(generate_series(t * 8 - 8, t * 8 + 7), lambda j: x[case when j < 0 then -j when j >= 64 then 126 - j else j end + 1]) as w from e, unnest(generate_series(0, 8)) u(t)),
h as (select vec_id, t, list_transform(generate_series(0, 15), lambda n: w[n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 16))) as w from f),
b as (select vec_id, t, k, list_sum(list_transform(generate_series(0, 15), lambda n: w[n + 1] * cos(2 * pi() * k * n / 16))) as re, list_sum(list_transform(generate_series(0, 15), lambda n: w[n + 1] * sin(2 * pi() * k * n / 16))) as im from h, unnest(generate_series(0, 8)) u(k))
select vec_id, k::int as bin, t::int as frame, round(sqrt(re * re + im * im), 6) as magnitude from b""")
def r17(spark, sf):
    rows = _signals(spark, sf).select("vec_id", F.posexplode(signals.stft(F.col("x"), 16, 8)).alias("bin", "m"))
    return rounded(rows.select("vec_id", "bin", F.posexplode("m").alias("frame", "magnitude")), 6)


@query("r06_lower_hull", f"""with {E}, p as (select vec_id, (i + list_position(x[i + 1:i + 10], list_min(x[i + 1:i + 10])) - 1)::bigint as place from e, unnest(generate_series(0, 54)) u(i))
select distinct vec_id, place from p union select vec_id, 0 from e union select vec_id, 63 from e""")
def r06(spark, sf):
    return _signals(spark, sf).select("vec_id", F.explode(signals.hull(F.col("x"), 10)).alias("place"))


@query("r02_aligned_signals", f"""with {E}, g as (select vec_id, lag, x[greatest(lag, 0) + 1:64 - greatest(-lag, 0)] as a, y[greatest(-lag, 0) + 1:64 - greatest(lag, 0)] as b from e, unnest(generate_series(-8, 8)) u(lag)),
m as (select *, len(a) as n, list_sum(a) / len(a) as ma, list_sum(b) / len(b) as mb from g),
c as (select vec_id, lag, n, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - ma) * (p[2] - mb))) / sqrt(list_sum(list_transform(a, lambda v: (v - ma) * (v - ma))) * list_sum(list_transform(b, lambda v: (v - mb) * (v - mb)))) as r from m)
select vec_id, lag::int as lag, round(r, 9) as correlation, n::int as overlap from c qualify row_number() over (partition by vec_id order by round(abs(r), 11) desc, lag) = 1""")
def r02(spark, sf):
    return rounded(_signals(spark, sf).select("vec_id", signals.aligned(F.col("x"), F.col("y"), 8, 40).alias("a")).select("vec_id", "a.*"))


@query("r07_r08_profile_fingerprint")
def r08(spark, sf):
    return rounded(_signals(spark, sf).select("vec_id", F.posexplode(signals.profile_fingerprint(F.col("x"), 10)).alias("at", "value")))


@query("r09_separated_parts")
def r09(spark, sf):
    parts = signals.separated(F.col("x"), 16, 4, 3)
    return rounded(_signals(spark, sf).select("vec_id", parts.alias("p")).select("vec_id", F.col("p")[0].alias("harmonic"), F.col("p")[1].alias("percussive"), F.col("p")[2].alias("whole")))


@query("r21_feature_means")
def r21(spark, sf):
    return rounded(_signals(spark, sf).select("vec_id", F.posexplode(signals.feature_means(F.col("x"), 16, 4, 3)).alias("channel", "mean")))
