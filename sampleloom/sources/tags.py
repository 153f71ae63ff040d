"""Tags and chapters of files: ID3v2, APEv2, MP4 atoms, Vorbis comments and RIFF INFO, all under one set of keys."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sampleloom.sources.containers import _find, boxes, id3v2_bytes, open_bytes, sniff
from sampleloom.sources.pcm import Malformed

#: Our keys for the fields of each scheme.
ID3 = {"TIT2": "TITLE", "TPE1": "ARTIST", "TPE2": "ALBUMARTIST", "TALB": "ALBUM", "TRCK": "TRACKNUMBER", "TPOS": "DISCNUMBER", "TDRC": "DATE", "TYER": "DATE", "TCON": "GENRE", "TCOM": "COMPOSER", "TSRC": "ISRC"}
ATOMS = {b"\xa9nam": "TITLE", b"\xa9ART": "ARTIST", b"aART": "ALBUMARTIST", b"\xa9alb": "ALBUM", b"\xa9day": "DATE", b"\xa9gen": "GENRE", b"\xa9wrt": "COMPOSER", b"\xa9cmt": "COMMENT"}
INFO = {"INAM": "TITLE", "IART": "ARTIST", "IPRD": "ALBUM", "ICRD": "DATE", "IGNR": "GENRE", "ICMT": "COMMENT", "ITRK": "TRACKNUMBER"}
_TEXT = ("latin-1", "utf-16", "utf-16-be", "utf-8")

Tags = dict[str, list[str]]
SCHEMA = "source_id string, tags map<string,array<string>>, chapters array<struct<start_ns:bigint,end_ns:bigint,title:string>>, has_art boolean"


def _add(tags: Tags, key: str, *values: str) -> None:
    tags.setdefault(key.upper(), []).extend(v for v in values if v)


def id3v2(data: bytes) -> tuple[Tags, bool]:
    """Text frames of a leading ID3v2.3 or 2.4 tag, and whether it holds a picture."""
    tags: Tags = {}
    size, art = id3v2_bytes(data), False
    if not size or data[3] not in (3, 4):
        return tags, art
    at, end = 10, min(size, len(data))
    if data[5] & 64:
        n = struct.unpack_from(">I", data, at)[0]
        at += n + 4 if data[3] == 3 else sum((b & 127) << 7 * (3 - k) for k, b in enumerate(data[at : at + 4]))
    while at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        n = struct.unpack(">I", raw)[0] if data[3] == 3 else sum((b & 127) << 7 * (3 - k) for k, b in enumerate(raw))
        body = data[at + 10 : min(at + 10 + n, end)]
        at += 10 + n
        art = art or name == "APIC"
        if name[0] == "T" and body and body[0] < 4:
            values = body[1:].decode(_TEXT[body[0]], "replace").rstrip("\0").split("\0")
            if name == "TXXX" and len(values) > 1:
                _add(tags, values[0], *values[1:])
            elif name in ID3:
                _add(tags, ID3[name], *values)
    return tags, art


def apev2(data: bytes) -> tuple[Tags, bool]:
    """Items of an APEv2 tag at the end of a file (in front of an ID3v1 tag, if there is one)."""
    tags: Tags = {}
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    foot, art = end - 32, False
    if foot < 0 or data[foot : foot + 8] != b"APETAGEX":
        return tags, art
    _, size, count, flags = struct.unpack_from("<IIII", data, foot + 8)
    at = end - size
    for _ in range(min(count, 10_000)):
        if at < 0 or at + 8 > foot:
            break
        n, kind = struct.unpack_from("<II", data, at)
        stop = data.index(b"\0", at + 8, foot)
        key = data[at + 8 : stop].decode("ascii", "replace")
        value = data[stop + 1 : stop + 1 + n]
        at = stop + 1 + n
        if kind >> 1 & 3 == 0:
            _add(tags, {"TRACK": "TRACKNUMBER", "YEAR": "DATE"}.get(key.upper(), key), *value.decode("utf-8", "replace").split("\0"))
        art = art or key.lower().startswith("cover art")
    return tags, art


def mp4(data: bytes) -> tuple[Tags, list[tuple[int, int, str]], bool]:
    """Atoms of an ``ilst`` and the chapters of a ``chpl`` (starts in units of 100 ns, no ends)."""
    tags: Tags = {}
    chapters: list[tuple[int, int, str]] = []
    art = False
    meta = _find(data, 0, len(data), b"moov", b"udta", b"meta")
    items = _find(data, meta[0] + 4, meta[1], b"ilst") if meta else None
    for kind, a, b in boxes(data, *items) if items else ():
        value = _find(data, a, b, b"data")
        art = art or kind == b"covr"
        if value is None:
            continue
        body = data[value[0] + 8 : value[1]]
        if kind in ATOMS:
            _add(tags, ATOMS[kind], body.decode("utf-8", "replace"))
        elif kind in (b"trkn", b"disk") and len(body) >= 4:
            _add(tags, "TRACKNUMBER" if kind == b"trkn" else "DISCNUMBER", str(struct.unpack_from(">H", body, 2)[0]))
        elif kind == b"----":
            name = _find(data, a, b, b"name")
            if name:
                _add(tags, data[name[0] + 4 : name[1]].decode("utf-8", "replace"), body.decode("utf-8", "replace"))
    list_ = _find(data, 0, len(data), b"moov", b"udta", b"chpl")
    if list_:
        at, end = list_[0] + 9, list_[1]
        for _ in range(data[list_[0] + 8]):
            if at + 9 > end:
                break
            start, n = struct.unpack_from(">QB", data, at)
            chapters.append((start * 100, 0, data[at + 9 : at + 9 + n].decode("utf-8", "replace")))
            at += 9 + n
    return tags, chapters, art


def read_tags(data: bytes, ext: str = "") -> tuple[Tags, list[tuple[int, int, str]], bool]:
    """Tags, chapters and whether there is cover art; what the container itself says wins over tags around it."""
    tags, art = id3v2(data)
    behind, more = apev2(data)
    art, chapters = art or more, []
    for k, v in behind.items():
        tags.setdefault(k, v)
    if sniff(data, ext) == "mp4":
        own, chapters, more = mp4(data)
        art = art or more
    else:
        try:
            own = {INFO.get(k, k): v for k, v in open_bytes(data, ext)[0].tags.items()}
        except Malformed:
            own = {}
        art = art or "METADATA_BLOCK_PICTURE" in own
    return tags | own, chapters, art


def tags_of(sources: DataFrame) -> DataFrame:
    """A row per source: tags, chapters, has_art; files without any have empty ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from sampleloom.core.schemas import struct as schema_of

    arrow = to_arrow_schema(schema_of(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, ext, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    tags, chapters, art = read_tags(content.as_py(), ext)
                except (struct.error, IndexError, ValueError, UnicodeError):
                    tags, chapters, art = {}, [], False
                rows.append({"source_id": source, "tags": list(tags.items()), "chapters": [{"start_ns": a, "end_ns": b, "title": t} for a, b, t in chapters], "has_art": art})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sources.select("source_id", "ext", "content").mapInArrow(run, SCHEMA)
