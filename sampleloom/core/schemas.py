"""The tables that operators share."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT = "rate int, channels int, layout int, sample_type string, bit_depth int"
SOURCES = "source_id string, path string, ext string, length bigint, mtime_ns bigint, identity string"
TRACKS = (
    "source_id string, track_id int, container string, codec string, codec_config binary, " + FORMAT + ", source_bit_depth int, "
    "samples bigint, delay bigint, padding bigint, samples_exact boolean, is_default boolean"
)
PACKETS = "source_id string, track_id int, seq bigint, pts bigint, dur bigint, sync boolean, data binary"
CHUNKS = "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<float>>"
INT_CHUNKS = "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<int>>"
CHAPTERS = "start_ns bigint, end_ns bigint, title string"

#: Frames of a standard chunk.
STANDARD_CHUNK = 4096

#: Speaker positions by bit, as in the WAVE channel mask.
SPEAKERS = ("FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC", "BC", "SL", "SR", "TC", "TFL", "TFC", "TFR", "TBL", "TBC", "TBR")
#: The usual mask for 1 to 8 channels.
DEFAULT_LAYOUTS = {1: 0x4, 2: 0x3, 3: 0x7, 4: 0x33, 5: 0x37, 6: 0x3F, 7: 0x70F, 8: 0x63F}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
