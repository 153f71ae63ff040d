"""Media files as tables of sources, tracks, packets and chunks; chunks back to files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from sampleloom.core.arrow import table
from sampleloom.core.errors import error
from sampleloom.core.schemas import CHUNKS, PACKETS, SOURCES, STANDARD_CHUNK, TRACKS, struct
from sampleloom.sources import alac, containers, flac, mux, pcm, wavpack

MAX_BYTES = 1 << 30


def read_sources(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below a path (any file system of Spark), larger ones left out (see ``refused_sources``; Spark lists no empty ones), with their identity ``length-mtime``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    mtime = F.unix_micros("modificationTime") * 1000
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.select(F.sha2("path", 256).alias("source_id"), "path", ext.alias("ext"), "length", mtime.alias("mtime_ns"), F.concat_ws("-", F.col("length").cast("string"), mtime.cast("string")).alias("identity"), "content")


def refused_sources(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """source_id, path, length, error of the files that ``read_sources`` leaves out for their size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > max_bytes)
    problem = error("payload-too-large", F.concat(F.lit("file has "), F.col("length").cast("string"), F.lit(f" bytes, the limit is {max_bytes}")))
    return files.select(F.sha2("path", 256).alias("source_id"), "path", "length", problem.alias("error"))


def unreadable_sources(sources: DataFrame) -> DataFrame:
    """source_id, path, error of the files of which ``probe`` makes no track."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for source, path, ext, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                try:
                    containers.open_bytes(content.as_py(), ext)
                except pcm.Malformed as e:
                    found.append((source, path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["source_id", "path", "message"])

    rows = sources.select("source_id", "path", "ext", "content").mapInArrow(run, "source_id string, path string, message string")
    return rows.select("source_id", "path", error("unsupported-format", F.col("message")).alias("error"))


def _rows(kind: str, source: str, data: bytes, ext: str) -> Iterator[dict]:
    track, packets = containers.open_bytes(data, ext)
    if kind == "tracks":
        yield {
            "source_id": source, "track_id": 0, "container": track.container, "codec": track.codec, "codec_config": track.config, "rate": track.rate, "channels": track.channels,
            "layout": track.layout, "sample_type": track.sample_type, "bit_depth": track.bit_depth, "source_bit_depth": track.source_bit_depth, "samples": track.samples if track.samples >= 0 else None,
            "delay": track.delay, "padding": track.padding, "samples_exact": track.samples >= 0, "is_default": True,
        }
        return
    for seq, (pts, dur, sync, at, size, *held) in enumerate(packets):
        body = held[0] if held else data[at : at + size]
        if kind == "packets":
            yield {"source_id": source, "track_id": 0, "seq": seq, "pts": pts, "dur": dur, "sync": sync, "data": body}
        else:
            planes = _decode(track, body)
            yield {"source_id": source, "track_id": 0, "pos": pts, "n": planes.shape[1], "discont": False, "pcm": planes}


def _decode(track: pcm.Track, packet: bytes) -> np.ndarray:
    """Float planes of one packet; PCM, FLAC, ALAC and WavPack packets stand alone."""
    if track.codec == "pcm":
        planes = pcm.decode(track, packet)
    elif track.codec == "flac":
        planes = flac.decode_frame(packet, track)[0]
    elif track.codec == "alac":
        config = alac.Config.parse(track.config)
        planes, track.bit_depth = alac.decode_frame(packet, config), config.bits
    elif track.codec == "wavpack":
        planes = wavpack.decode_packet(packet) >> (-track.bit_depth % 8)
    else:
        raise pcm.Malformed(f"no decoder for {track.codec}")
    return planes if planes.dtype == np.float32 else (planes / np.float32(1 << track.bit_depth - 1)).astype(np.float32)


_SCHEMAS = {"tracks": TRACKS, "packets": PACKETS, "chunks": CHUNKS}


def _parsing(kind: str, strict: bool):
    arrow = to_arrow_schema(struct(_SCHEMAS[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, ext, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows: list[dict] = []
                try:
                    for row in _rows(kind, source, content.as_py(), ext):
                        rows.append(row)
                        if len(rows) >= 64:
                            yield from table(rows, arrow).to_batches()
                            rows = []
                except pcm.Malformed:
                    if strict:
                        raise
                if rows:
                    yield from table(rows, arrow).to_batches()

    return run


def _table(sources: DataFrame, kind: str, strict: bool) -> DataFrame:
    return sources.select("source_id", "ext", "content").mapInArrow(_parsing(kind, strict), _SCHEMAS[kind])


def probe(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Track rows from headers alone; files that cannot be read give none (see ``unreadable_sources``), or fail the job if ``strict``."""
    return _table(sources, "tracks", strict)


def packets(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Packet rows; nothing is decoded (but for the lengths of FLAC frames)."""
    return _table(sources, "packets", strict)


def decode_chunks(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Chunk rows of the PCM, FLAC, ALAC and WavPack files; what a file gave before it broke off is kept."""
    return _table(sources, "chunks", strict)


def _write_alac(planes: np.ndarray, rate: int, bits: int) -> bytes:
    config = alac.Config(4096, bits, len(planes), rate)
    track = pcm.Track("mp4", "alac", rate, len(planes), "int", bits, config=config.cookie())
    n = planes.shape[1]
    return mux.mux_mp4(track, [(alac.encode_frame(planes[:, a : a + 4096], config), min(4096, n - a)) for a in range(0, n, 4096)])


ENCODERS = {"wav": pcm.write_wav, "aiff": pcm.write_aiff, "flac": flac.write, "alac": _write_alac, "wavpack": wavpack.write}


def encode_files(chunks: DataFrame, rate: int, fmt: str = "wav", bits: int = 16) -> DataFrame:
    """source_id, track_id, data: one file per track; integers by rounding half up, as everywhere."""
    if fmt not in ENCODERS:
        raise ValueError(f"no encoder for {fmt}")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        from sampleloom.operators.dither import quantize

        pos = group["pos"].to_numpy()
        parts = [group["pcm"][int(k)].values for k in np.argsort(pos, kind="stable")]
        planes = np.concatenate([np.array([c.values.to_numpy(zero_copy_only=False) for c in p], dtype=np.float32) for p in parts], axis=1)
        whole = np.array([quantize(c, bits)[0] for c in planes])
        return pa.table({"source_id": [key[0].as_py()], "track_id": pa.array([key[1].as_py()], pa.int32()), "data": [ENCODERS[fmt](whole, rate, bits)]})

    return chunks.groupBy("source_id", "track_id").applyInArrow(run, "source_id string, track_id int, data binary")


class MediaDataSource(DataSource):
    """``spark.read.format("sampleloom-pcm")``: chunks of WAVE and AIFF files on a mounted file system.

    Each file is cut into ranges of frames that are read on their own, and
    filters on ``pos`` skip ranges without opening them.  Writing takes rows of
    (name, data) and puts each into a file of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "sampleloom-pcm"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema):
        return _PcmReader(self.options)

    def writer(self, schema, overwrite):
        return _FileWriter(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class _PcmReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.frames = options["path"], int(options.get("frames", 1 << 20))
        self.lo, self.hi = 0, 1 << 62

    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

        for f in filters:
            if getattr(f, "attribute", None) == ("pos",):
                if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                    self.lo = max(self.lo, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.hi = min(self.hi, f.value)
            yield f  # Spark checks them again: ranges are only skipped whole

    def partitions(self):
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs)
        out = []
        for name in names:
            with open(name, "rb") as f:
                head = f.read(1 << 16)
            if containers.sniff(head) in ("wav", "aiff"):
                total = os.path.getsize(name)
                out += [_Range(name, a, a + self.frames) for a in range(0, total, self.frames) if a <= self.hi and a + self.frames > self.lo]
        return out

    def read(self, part):
        import hashlib
        import mmap

        with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            track = (pcm.parse_wav if data[:1] == b"R" else pcm.parse_aiff)(data)
            frame = track.width * track.channels
            for pos in range(part.lo, min(part.hi, track.samples), STANDARD_CHUNK):
                n = min(STANDARD_CHUNK, track.samples - pos, part.hi - pos)
                if pos + n <= self.lo or pos > self.hi:
                    continue
                at = track.data_at + pos * frame
                planes = _decode(track, data[at : at + n * frame])
                yield hashlib.sha256(part.path.encode()).hexdigest(), 0, pos, n, False, planes.tolist()


class _FileWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            target = os.path.join(self.path, os.path.basename(row[0]))
            with open(f"{target}.{os.getpid()}.part", "wb") as f:
                f.write(row[1])
            os.replace(f.name, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass


def register(spark: SparkSession) -> None:
    """Register the data source, and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaDataSource)


__all__ = ["MediaDataSource", "SOURCES", "decode_chunks", "encode_files", "packets", "probe", "read_sources", "refused_sources", "register", "unreadable_sources"]
