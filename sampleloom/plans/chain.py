"""The processing chain: a specification becomes the fewest nodes that meet it, and the nodes run on chunks.

Order: convert, resample, mix, gain, dynamics, limiter, dither.  A node is there
only if it changes something; a limiter only if the level path can exceed full
scale and the output cannot hold that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.operators import dither, dynamics, filters, samples
from sampleloom.operators.segments import map_segments

_OUT = "pos bigint, n int, discont boolean, pcm array<array<float>>"
SEGMENT = 1 << 18


@dataclass(frozen=True)
class Spec:
    """What goes in and what should come out; 0 keeps the source's value."""

    rate: int
    layout: int
    sample_type: str = "int"
    bit_depth: int = 16
    out_rate: int = 0
    out_channels: int = 0
    out_bits: int = 0
    gain_db: float = 0.0
    dynamics: str = "off"
    quality: str = "hq"
    dither: bool = True
    seed: int = 0


@dataclass(frozen=True)
class Node:
    name: str
    version: str
    #: Frames of real audio this node needs before a splice, at its own rate.
    horizon: int = 0


class Chain:
    def __init__(self, spec: Spec):
        self.spec = spec
        channels = len(samples.speakers_of(spec.layout))
        self.matrix = samples.mix_matrix(spec.layout, spec.out_channels) if spec.out_channels and spec.out_channels != channels else None
        if self.matrix and spec.out_channels > 2:
            raise ValueError("mixing goes to mono or stereo only")
        rate = spec.out_rate or spec.rate
        changes = bool(spec.gain_db or self.matrix or spec.dynamics != "off" or rate != spec.rate)
        nodes = []
        if spec.sample_type == "int" and (changes or spec.out_bits == 0):
            nodes.append(Node("convert", "convert-1"))
        if rate != spec.rate:
            up, down = filters.ratio(spec.rate, rate)
            nodes.append(Node("resample", f"resample-{spec.quality}-1", filters.resample_bank(up, down, spec.quality).shape[1]))
        if self.matrix:
            nodes.append(Node("mix", "mix-1"))
        if spec.gain_db:
            nodes.append(Node("gain", "gain-1"))
        if spec.dynamics == "voice":
            nodes.append(Node("dynamics", "voice-1", dynamics.horizon_frames([dynamics.RELEASE_S], rate)))
        level = samples.gain_factor(spec.gain_db) * (samples.max_matrix_gain(self.matrix) if self.matrix else 1.0)
        if spec.out_bits and (level > 1 or spec.dynamics != "off" or rate != spec.rate):
            nodes.append(Node("limiter", "limiter-2", dynamics.horizon_frames([dynamics.LIMITER_RELEASE_S], rate)))
        if spec.out_bits:
            narrower = changes or spec.sample_type == "float" or spec.out_bits < spec.bit_depth
            if narrower:
                nodes.append(Node("dither", "tpdf-1") if spec.dither else Node("quantize", "quantize-1"))
            elif spec.out_bits > spec.bit_depth:
                nodes.append(Node("widen", "widen-1"))
        self.nodes = tuple(nodes)

    @property
    def names(self) -> list[str]:
        return [n.name for n in self.nodes]

    @property
    def versions(self) -> list[str]:
        """Every node that affects samples, in order: part of a result's key."""
        return [n.version for n in self.nodes]

    @property
    def horizon(self) -> int:
        """The sum of the nodes' horizons, not their maximum: each sees what the one before still remembers."""
        return sum(n.horizon for n in self.nodes)

    def output_samples(self, n: int) -> int:
        up, down = filters.ratio(self.spec.rate, self.spec.out_rate or self.spec.rate)
        return -(-n * up // down)

    def run(self, chunks: DataFrame, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
        """Chunks through the nodes: array expressions where they suffice, kernels over segments with a halo elsewhere."""
        spec, rate = self.spec, self.spec.out_rate or self.spec.rate
        for node in self.nodes:
            pcm = F.col("pcm")
            if node.name == "convert":
                chunks = chunks.withColumn("pcm", samples.to_float(pcm, spec.bit_depth)) if "int" in dict(chunks.dtypes)["pcm"] else chunks
            elif node.name == "resample":
                chunks = filters.resample(chunks, spec.rate, rate, spec.quality, SEGMENT, keys)
            elif node.name == "mix":
                chunks = chunks.withColumn("pcm", samples.mix(pcm, self.matrix))
            elif node.name == "gain":
                chunks = chunks.withColumn("pcm", samples.gain(pcm, spec.gain_db))
            elif node.name in ("dynamics", "limiter"):
                kernel = _compressing(rate) if node.name == "dynamics" else _limiting(rate)
                chunks = map_segments(chunks, max(SEGMENT, 4 * node.horizon), node.horizon + filters.TRUE_PEAK_TAPS, int(rate * dynamics.LOOK_AHEAD_S) + 1 + filters.TRUE_PEAK_TAPS, kernel, _OUT, keys)
            elif node.name == "dither":
                chunks = dither.dithered(chunks.select(*keys, "pos", "n", "discont", "pcm"), spec.out_bits, spec.seed)
            elif node.name == "quantize":
                chunks = chunks.withColumn("pcm", samples.quantize(pcm, spec.out_bits))
            else:
                chunks = chunks.withColumn("pcm", samples.widen(pcm, spec.bit_depth, spec.out_bits))
        return chunks


def _pieces(planes: np.ndarray, first: int):
    for a in range(0, planes.shape[1], 4096):
        part = planes[:, a : a + 4096]
        yield {"pos": first + a, "n": part.shape[1], "discont": False, "pcm": part}


def _compressing(rate: int):
    return lambda planes, start, lo, hi: _pieces(dynamics.compress(planes, rate)[0][:, lo - start : hi - start].astype(np.float32), lo)


def _limiting(rate: int):
    return lambda planes, start, lo, hi: _pieces(dynamics.limit(planes, rate)[:, lo - start : hi - start], lo)


#: Default bit rates (bit/s) for stereo of the lossy outputs, and the frame length of each output.
BITRATES = {"opus": 128000, "vorbis": 160000, "mp3": 192000, "aac": 160000, "he-aac": 64000}
FRAMES = {"wav": 4096, "aiff": 4096, "flac": 4096, "alac": 4096, "wavpack": 22050, "ape": 73728, "opus": 960, "vorbis": 1024, "mp3": 1152, "aac": 1024, "he-aac": 2048}


def plan_transcode(requests: DataFrame) -> DataFrame:
    """Add out_rate, out_channels, out_bits, out_samples, out_bitrate, out_bytes and error, from headers alone.

    ``requests`` has fmt, rate, channels, bit_depth, samples, want_rate,
    want_channels, want_bits and bitrate (0: keep, or the default).  Lossy
    outputs fold what is wider than stereo, lossless ones refuse a fold that was
    not asked for; Opus is at 48 kHz.
    """
    from sampleloom.core.errors import error
    from sampleloom.core.positions import ceil_div
    from sampleloom.plans.planner import OUTPUTS, is_lossy

    lossy = is_lossy(F.col("fmt"))
    table = lambda d, key: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[key]
    rate = F.when(F.col("fmt") == "opus", 48000).when(F.col("want_rate") > 0, F.col("want_rate")).otherwise(F.col("rate"))
    channels = F.when(F.col("want_channels") > 0, F.col("want_channels")).when(lossy & (F.col("channels") > 2), 2).otherwise(F.col("channels"))
    rows = requests.withColumns({"out_rate": rate, "out_channels": channels})
    rows = rows.withColumn("out_bits", F.when(lossy, F.lit(0)).when(F.col("want_bits") > 0, F.col("want_bits")).otherwise(F.col("bit_depth")))
    rows = rows.withColumn("out_samples", ceil_div(F.col("samples") * F.col("out_rate"), F.col("rate")))
    default = F.floor(table(BITRATES, F.col("fmt")) * F.col("out_channels") / 2).cast("long")
    coded = F.when(F.col("bitrate") > 0, F.col("bitrate").cast("long")).otherwise(default)
    plain = (F.col("out_rate") * F.col("out_channels") * F.col("out_bits")).cast("long")
    rows = rows.withColumn("out_bitrate", F.when(lossy, coded).otherwise(plain))
    frames = ceil_div(F.col("out_samples"), table(FRAMES, F.col("fmt")))
    rows = rows.withColumn("out_bytes", F.when(lossy, ceil_div(F.col("out_bitrate") * F.col("out_samples"), F.col("out_rate") * 8) + frames * 4).otherwise(F.col("out_samples") * F.col("out_channels") * ceil_div(F.col("out_bits"), F.lit(8)) + 44))
    problem = (
        F.when(~F.col("fmt").isin(*OUTPUTS), error("unsupported-format", "no such output"))
        .when(~lossy & (F.col("bitrate") > 0), error("invalid-request", "a lossless output has no bit rate"))
        .when(F.col("out_channels") > 8, error("invalid-request", "too many channels"))
        .when((F.col("want_channels") > 2) & (F.col("want_channels") != F.col("channels")), error("invalid-request", "mixing goes to mono or stereo only"))
    )
    return rows.withColumn("error", problem)


def two_pass_gain(measured: DataFrame, target_lufs: float = -18.0, ceiling_db: float = 24.0) -> DataFrame:
    """Add gain_db: what brings each measured track to the target, within the ceiling; silent tracks are left as they are."""
    want = F.lit(target_lufs) - F.col("lufs")
    return measured.withColumn("gain_db", F.when(F.col("lufs") > float("-inf"), F.greatest(F.lit(-ceiling_db), F.least(want, F.lit(ceiling_db)))).otherwise(0.0))


def member_spec(rate: int, layout: int, sample_type: str, bit_depth: int, to_rate: int, to_channels: int, to_type: str, to_bits: int, quality: str = "hq") -> Spec:
    """What brings a timeline's member to the timeline's format.

    Dither is always triangular: it depends on the position alone, so a member
    that is started in its middle gives the samples of a whole run.
    """
    return Spec(rate, layout, sample_type, bit_depth, to_rate, to_channels, 0 if to_type == "float" else to_bits, quality=quality)
