"""Samples, silence, loudness and dynamics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sampleloom.operators import dynamics, loudness, samples, silence
from sampleloom.operators.dither import dithered
from sampleloom.queries.tables import BLOCK, CHUNKS_SQL, chunks
from sampleloom.registry import query

THRESHOLD_DB, MIN_FRAMES = -26.0, 4
_KEYS = ("track",)

_RUNS_SQL = f"""
WITH {CHUNKS_SQL}, flagged AS (
  SELECT track, pos, abs(v) < CAST(pow(10, {THRESHOLD_DB} / 20) AS REAL) AS quiet FROM samples
), islands AS (
  SELECT track, pos, pos - row_number() OVER (PARTITION BY track ORDER BY pos) AS g FROM flagged WHERE quiet
), runs AS (SELECT track, min(pos) AS from_sample, max(pos) + 1 AS to_sample FROM islands GROUP BY track, g)"""


@query("silence_spans", _RUNS_SQL + f" SELECT * FROM runs WHERE to_sample - from_sample >= {MIN_FRAMES}")
def silence_spans(spark, d):
    return silence.silence_spans(chunks(spark, d), THRESHOLD_DB, MIN_FRAMES, _KEYS)


@query(
    "silence_totals",
    _RUNS_SQL
    + f""", l AS (SELECT track, to_sample - from_sample AS n FROM runs)
SELECT track, count(*) FILTER (n >= {MIN_FRAMES}) AS spans, coalesce(sum(n) FILTER (n >= {MIN_FRAMES}), 0)::BIGINT AS total_samples,
       count(*) FILTER (n < {MIN_FRAMES}) AS dropped, coalesce(sum(n) FILTER (n < {MIN_FRAMES}), 0)::BIGINT AS dropped_samples FROM l GROUP BY track""",
)
def silence_totals(spark, d):
    return silence.silence_totals(chunks(spark, d), THRESHOLD_DB, MIN_FRAMES, _KEYS)


_ENERGY_SQL = f"""
WITH {CHUNKS_SQL}, energy AS (
  SELECT track, pos // {BLOCK} AS block, sum(CAST(round(v::DOUBLE * v::DOUBLE * 1e12) AS BIGINT))::BIGINT AS energy
  FROM samples GROUP BY 1, 2 HAVING count(*) = {BLOCK}
)"""


def _power_sql(blocks: int, name: str) -> str:
    return f""", {name} AS (SELECT track, block, e / (1e12 * {blocks} * {BLOCK}) AS power FROM (
  SELECT track, block, sum(energy) OVER w AS e, count(*) OVER w AS m FROM energy
  WINDOW w AS (PARTITION BY track ORDER BY block ROWS BETWEEN {blocks - 1} PRECEDING AND CURRENT ROW)) WHERE m = {blocks})"""


def _energy(spark, d):
    return loudness.block_energy(chunks(spark, d), BLOCK, _KEYS)


@query("block_energy", _ENERGY_SQL + " SELECT track, block, energy FROM energy")
def block_energy(spark, d):
    return _energy(spark, d).select("track", "block", "energy")


@query("window_power", _ENERGY_SQL + _power_sql(4, "powers") + " SELECT track, block, round(power, 9) AS power FROM powers")
def window_power(spark, d):
    return loudness.window_power(_energy(spark, d), loudness.MOMENTARY, BLOCK, keys=_KEYS).select("track", "block", F.round("power", 9).alias("power"))


_GATE = loudness.ABSOLUTE_GATE


@query(
    "integrated_loudness",
    _ENERGY_SQL
    + _power_sql(4, "powers")
    + f""", a AS (SELECT *, avg(power) OVER (PARTITION BY track) / 10 AS floor FROM powers WHERE power > {_GATE!r})
SELECT track, round(-0.691 + 10 * log10(avg(power)), 6) AS lufs FROM a WHERE power > floor GROUP BY track""",
)
def integrated_loudness(spark, d):
    powers = loudness.window_power(_energy(spark, d), loudness.MOMENTARY, BLOCK, keys=_KEYS)
    return loudness.integrated(powers, _KEYS).select("track", F.round("lufs", 6).alias("lufs"))


@query(
    "loudness_range",
    _ENERGY_SQL
    + _power_sql(30, "powers")
    + f""", a AS (SELECT *, avg(power) OVER (PARTITION BY track) / 100 AS floor FROM powers WHERE power > {_GATE!r}),
r AS (SELECT track, power, row_number() OVER (PARTITION BY track ORDER BY power) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM a WHERE power >= floor)
SELECT track, round(CASE WHEN max(n) < 2 THEN 0 ELSE 10 * log10(max(power) FILTER (i = floor(0.95 * (n - 1) + 0.5)) / max(power) FILTER (i = floor(0.10 * (n - 1) + 0.5))) END, 6) AS lra
FROM r GROUP BY track""",
)
def loudness_range(spark, d):
    powers = loudness.window_power(_energy(spark, d), loudness.SHORT_TERM, BLOCK, keys=_KEYS)
    return loudness.loudness_range(powers, _KEYS).select("track", F.round("lra", 6).alias("lra"))


@query("sample_peak", f"WITH {CHUNKS_SQL} SELECT track, max(abs(v))::DOUBLE AS peak, round(20 * log10(max(abs(v))::DOUBLE), 6) AS peak_db FROM samples GROUP BY track")
def sample_peak(spark, d):
    peak = loudness.sample_peak(chunks(spark, d), _KEYS).select("track", F.col("peak").cast("double").alias("peak"))
    return peak.withColumn("peak_db", F.round(samples.db_of(F.col("peak")), 6))


@query(
    "gain_quantize",
    f"""WITH {CHUNKS_SQL}, g AS (SELECT track, v * CAST(pow(10, 9.0 / 20) AS REAL) AS v FROM samples),
q AS (SELECT track, v, CAST(greatest(-32768, least(32767, floor(v::DOUBLE * 32768 + 0.5))) AS BIGINT) AS q FROM g)
SELECT track, sum(q)::BIGINT AS total, min(q) AS lo, max(q) AS hi, count(*) FILTER (abs(v) > 1) AS overs FROM q GROUP BY track""",
)
def gain_quantize(spark, d):
    """Gain, then 16-bit integers, with the overs counted before."""
    loud = chunks(spark, d).withColumn("pcm", samples.gain(F.col("pcm"), 9.0))
    q = loud.select("track", samples.overs(F.col("pcm")).alias("o"), F.flatten(samples.quantize(F.col("pcm"), 16)).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v)
    return q.groupBy("track").agg(
        F.sum(total).alias("total"), F.min(F.array_min("q")).cast("long").alias("lo"), F.max(F.array_max("q")).cast("long").alias("hi"), F.sum("o").alias("overs")
    )


@query(
    "convert_widen",
    f"""WITH {CHUNKS_SQL}, q AS (SELECT track, CAST(greatest(-128, least(127, floor(v::DOUBLE * 128 + 0.5))) AS INTEGER) AS q FROM samples)
SELECT track, sum(q * 256)::BIGINT AS widened, sum(CAST(round(CAST(CAST(q AS REAL) * CAST(1.0 / 128 AS REAL) AS DOUBLE) * 1e6) AS BIGINT))::BIGINT AS micro FROM q GROUP BY track""",
)
def convert_widen(spark, d):
    """8-bit integers widened to 16 bits, and back to float."""
    q = chunks(spark, d).select("track", samples.quantize(F.col("pcm"), 8).alias("q"))
    wide, floats = F.flatten(samples.widen(F.col("q"), 8, 16)), F.flatten(samples.to_float(F.col("q"), 8))
    zero = F.lit(0).cast("long")
    return q.groupBy("track").agg(
        F.sum(F.aggregate(wide, zero, lambda a, v: a + v)).alias("widened"),
        F.sum(F.aggregate(floats, zero, lambda a, v: a + F.round(v.cast("double") * 1e6).cast("long"))).alias("micro"),
    )


@query(
    "mix_to_mono",
    f"""WITH {CHUNKS_SQL}, f AS (SELECT vec_id, unnest(embedding[1:32]) AS l, unnest(embedding[33:64]) AS r FROM chunks)
SELECT vec_id, sum(CAST(round(CAST(l::DOUBLE * {samples.mix_matrix(0x3, 1)[0][0]!r} + r::DOUBLE * {samples.mix_matrix(0x3, 1)[0][1]!r} AS REAL)::DOUBLE * 1e6) AS BIGINT))::BIGINT AS micro FROM f GROUP BY vec_id""",
)
def mix_to_mono(spark, d):
    """A chunk read as two channels of 32 frames, folded to one."""
    rows = chunks(spark, d).select("vec_id", F.get("pcm", F.lit(0)).alias("x"))
    stereo = F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))
    mono = F.flatten(samples.mix(stereo, samples.mix_matrix(0x3, 1)))
    return rows.select("vec_id", F.aggregate(mono, F.lit(0).cast("long"), lambda a, v: a + F.round(v.cast("double") * 1e6).cast("long")).alias("micro"))


_MOD = "18446744073709551616::UHUGEINT"


def _times(x: str, by: int) -> str:
    return f"CAST(({x})::UHUGEINT * {by}::UHUGEINT % {_MOD} AS UBIGINT)"


def _split_sql(name: str, source: str, z: str, out: str) -> str:
    """splitmix64 after the addition, a step per CTE."""
    return f"""{name}1 AS (SELECT *, {_times(f"xor({z}, {z} >> 30)", 13787848793156543929)} AS {out}1 FROM {source}),
{name}2 AS (SELECT *, {_times(f"xor({out}1, {out}1 >> 27)", 10723151780598845931)} AS {out}2 FROM {name}1),
{name} AS (SELECT *, xor({out}2, {out}2 >> 31) AS {out} FROM {name}2)"""


@query(
    "dither_tpdf",
    f"""WITH {CHUNKS_SQL}, base AS (
  SELECT track, v, CAST((xor(42::UBIGINT, 11400714819323198485::UBIGINT)::UHUGEINT + (2 * pos)::UHUGEINT + 11400714819323198485::UHUGEINT) % {_MOD} AS UBIGINT) AS z0,
         CAST((xor(42::UBIGINT, 11400714819323198485::UBIGINT)::UHUGEINT + (2 * pos + 1)::UHUGEINT + 11400714819323198485::UHUGEINT) % {_MOD} AS UBIGINT) AS z1 FROM samples
), {_split_sql("a", "base", "z0", "u0")}, {_split_sql("b", "a", "z1", "u1")}, noisy AS (
  SELECT track, CAST(greatest(-128, least(127, floor(v::DOUBLE * 128 + ((u0 >> 11)::DOUBLE * pow(2, -53) - (u1 >> 11)::DOUBLE * pow(2, -53)) + 0.5))) AS BIGINT) AS q FROM b)
SELECT track, sum(q)::BIGINT AS total, sum(q * q)::BIGINT AS squares FROM noisy GROUP BY track""",
)
def dither_tpdf(spark, d):
    """8-bit quantisation with triangular noise that depends on seed, channel and position alone."""
    rows = dithered(chunks(spark, d).select("track", "pos", "pcm"), bits=8, seed=42).select("track", F.flatten("pcm").alias("q"))
    zero = F.lit(0).cast("long")
    return rows.groupBy("track").agg(F.sum(F.aggregate("q", zero, lambda a, v: a + v)).alias("total"), F.sum(F.aggregate("q", zero, lambda a, v: a + v * v)).alias("squares"))


_PEAKS_SQL = f"WITH {CHUNKS_SQL}, peaks AS (SELECT track, vec_id, max(abs(v))::DOUBLE AS peak, row_number() OVER (PARTITION BY track ORDER BY vec_id) AS k FROM samples GROUP BY track, vec_id)"


def _peaks(spark, d):
    rows = chunks(spark, d)
    return rows.select("track", "vec_id", F.floor(F.col("pos") / 64).alias("k"), F.array_max(samples.frame_peaks(F.col("pcm"))).cast("double").alias("peak"))


@query(
    "compressor_curve",
    _PEAKS_SQL
    + """, o AS (SELECT track, vec_id, 20 * log10(least(peak * 8, 2)) + 20 AS over FROM peaks WHERE peak > 0)
SELECT track, vec_id, round(CASE WHEN over <= -3 THEN 0 WHEN over >= 3 THEN over * (1 / 2.5 - 1) ELSE (1 / 2.5 - 1) * (over + 3) * (over + 3) / 12 END, 6) AS reduction_db FROM o""",
)
def compressor_curve(spark, d):
    return _peaks(spark, d).where("peak > 0").select("track", "vec_id", F.round(dynamics.static_curve(F.col("peak") * 8), 6).alias("reduction_db"))


@query(
    "limiter_envelope",
    _PEAKS_SQL
    + f""", m AS (SELECT track, k, least(1.0, 0.25 / max(peak) OVER (PARTITION BY track ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS m FROM peaks),
u AS (SELECT track, k, max(CASE WHEN m < 1 THEN ln(1 - m) - k * ln(0.9) END) OVER (PARTITION BY track ORDER BY k) AS u FROM m)
SELECT track, k - 1 AS k, round(1 - coalesce(exp(u + k * ln(0.9)), 0), 6) AS gain FROM u""",
)
def limiter_envelope(spark, d):
    """Look-ahead minimum, then exponential release in closed form, per chunk peak."""
    rows = _peaks(spark, d)
    return dynamics.release_envelope(rows, ("track",), "k", F.col("peak"), ceiling=0.25, look_ahead=3, release=0.1).select("track", "k", F.round("gain", 6).alias("gain"))


@query(
    "attack_positions",
    f"""WITH {CHUNKS_SQL}, e AS (
  SELECT track, pos // 8 AS k, sum(CAST(round(v::DOUBLE * v::DOUBLE * 1e12) AS BIGINT))::BIGINT AS e FROM samples GROUP BY 1, 2
), j AS (SELECT track, k, e > 3 * greatest(coalesce(lag(e) OVER (PARTITION BY track ORDER BY k), 0), 8000000) AS jump FROM e),
f AS (SELECT track, k, k - lag(k) OVER (PARTITION BY track ORDER BY k) - 1 AS since FROM j WHERE jump)
SELECT track, k FROM f WHERE coalesce(since, 2) >= 2""",
)
def attack_positions(spark, d):
    """Sub-windows of 8 samples whose energy jumps to three times the one before, two apart at least."""
    return dynamics.attacks(chunks(spark, d), window=8, ratio=3.0, floor=1e-6, refractory=2, keys=("track",)).select("track", "k")


@query(
    "rechunk_frames",
    f"""WITH {CHUNKS_SQL} SELECT track, pos // 48 AS frame, count(*) AS n, sum(CAST(round(v::DOUBLE * 1e9) AS BIGINT) * (pos % 48 + 1))::BIGINT AS mark FROM samples GROUP BY 1, 2""",
)
def rechunk_frames(spark, d):
    """Chunks of 64 recut into frames of 48; a weighted sum shows that each sample is in its place."""
    from sampleloom.operators.frames import rechunk

    frames = rechunk(chunks(spark, d), 48, ("track",))
    x = F.get("pcm", F.lit(0))
    mark = F.aggregate(F.transform(x, lambda v, i: F.round(v.cast("double") * 1e9).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return frames.select("track", F.floor(F.col("pos") / 48).alias("frame"), F.col("n").cast("long").alias("n"), mark.alias("mark"))


@query("box_average", _PEAKS_SQL + """ SELECT track, k - 1 AS k, sum(CAST(floor(peak * 1099511627776) AS BIGINT)) OVER (PARTITION BY track ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)::BIGINT AS box FROM peaks""")
def box_average(spark, d):
    """Running box over fixed-point values (unit 2^-40): exact whatever the order of rows."""
    frame = Window.partitionBy("track").orderBy("k").rowsBetween(-3, 0)
    return _peaks(spark, d).select("track", "k", F.sum(F.floor(F.col("peak") * (1 << 40)).cast("long")).over(frame).alias("box"))
