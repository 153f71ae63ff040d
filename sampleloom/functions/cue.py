"""CUE sheets: parsing of times in SQL expressions, and of whole sheets to nested rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAMES_PER_SECOND = 75
SHEET = (
    "path string, catalog string, title string, performer string, tracks array<struct<file:string,file_type:string,number:int,type:string,title:string,"
    "performer:string,isrc:string,flags:array<string>,pregap:bigint,postgap:bigint,indexes:array<struct<number:int,frame:bigint>>>>, error string"
)


def parse_time(text: Column) -> Column:
    """Frames of MM:SS:FF; null where it is not a time."""
    part = lambda k: F.split_part(text, F.lit(":"), F.lit(k)).try_cast("long")
    good = text.rlike(r"^\d{1,4}:[0-5]\d:([0-6]\d|7[0-4])$")
    return F.when(good, (part(1) * 60 + part(2)) * FRAMES_PER_SECOND + part(3))


def words_of(line: str) -> list[str]:
    """Words of a command line; a quoted word may hold spaces and keeps its case."""
    out, k = [], 0
    while k < len(line):
        if line[k] in " \t":
            k += 1
        elif line[k] == '"':
            end = line.find('"', k + 1)
            end = len(line) if end < 0 else end
            out.append(line[k + 1 : end])
            k = end + 1
        else:
            end = k
            while end < len(line) and line[end] not in " \t":
                end += 1
            out.append(line[k:end])
            k = end
    return out


def frames_of(text: str) -> int:
    minutes, seconds, frames = (int(x) for x in text.split(":"))
    if not (0 <= seconds < 60 and 0 <= frames < FRAMES_PER_SECOND and minutes >= 0):
        raise ValueError(f"bad time {text}")
    return (minutes * 60 + seconds) * FRAMES_PER_SECOND + frames


def parse_sheet(text: str) -> dict:
    """A sheet as a dictionary of the fields of SHEET (without path); raises ValueError where it is malformed."""
    sheet: dict = {"catalog": None, "title": None, "performer": None, "tracks": []}
    file, track = (None, None), None
    for line in text.lstrip("﻿").splitlines():
        words = words_of(line.strip())
        if not words:
            continue
        command, rest = words[0].upper(), words[1:]
        if command == "REM":
            continue
        if command == "FILE" and rest:
            file, track = (rest[0], rest[1].upper() if len(rest) > 1 else None), None
        elif command == "TRACK" and len(rest) > 1:
            if file[0] is None:
                raise ValueError("TRACK before FILE")
            track = {"file": file[0], "file_type": file[1], "number": int(rest[0]), "type": rest[1].upper(), "title": None, "performer": sheet["performer"]}
            track |= {"isrc": None, "flags": [], "pregap": None, "postgap": None, "indexes": []}
            sheet["tracks"].append(track)
        elif command == "INDEX" and len(rest) > 1:
            if track is None:
                raise ValueError("INDEX before TRACK")
            track["indexes"].append({"number": int(rest[0]), "frame": frames_of(rest[1])})
        elif command in ("PREGAP", "POSTGAP") and track is not None and rest:
            track[command.lower()] = frames_of(rest[0])
        elif command == "FLAGS" and track is not None:
            track["flags"] = [x.upper() for x in rest]
        elif command == "ISRC" and track is not None and rest:
            track["isrc"] = rest[0]
        elif command in ("TITLE", "PERFORMER") and rest:
            (sheet if track is None else track)[command.lower()] = rest[0]
        elif command == "CATALOG" and rest:
            sheet["catalog"] = rest[0]
    return sheet


def parse_sheets(files: DataFrame) -> DataFrame:
    """One row per row of ``files(path, text)``; a malformed sheet gives its error instead of failing the job."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from sampleloom.core.schemas import struct

    kinds = to_arrow_schema(struct(SHEET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": path, **parse_sheet(text or ""), "error": None})
                except ValueError as e:
                    rows.append({"path": path, "catalog": None, "title": None, "performer": None, "tracks": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds.names} for r in rows], schema=kinds)

    return files.select("path", "text").mapInArrow(run, SHEET)


def track_starts(sheets: DataFrame) -> DataFrame:
    """path, file, number, title, start_frame: INDEX 01 of each track."""
    rows = sheets.select("path", F.explode("tracks").alias("t"))
    first = F.get(F.filter("t.indexes", lambda i: i["number"] == 1), F.lit(0))["frame"]
    return rows.select("path", "t.file", "t.number", "t.title", first.alias("start_frame"))


def track_cuts(starts: DataFrame, rate: int) -> DataFrame:
    """path, file, cut: where to split each file, in samples; a leading 0 is no cut, and a single track gives none."""
    rows = starts.where("start_frame > 0")
    return rows.select("path", "file", F.expr(f"(start_frame * {rate}) div {FRAMES_PER_SECOND}").alias("cut"))
