"""A live playlist as a streaming source.

The offset is the next media sequence.  Reading starts three segments behind the
edge, segments below the cursor are not read again, and a playlist that lies
wholly below the cursor was restarted: the source goes on three segments behind
its new edge, and the first of them is marked as a discontinuity.  Segments that
were offered are held until they are committed, so a batch that is tried again
is the same even if they have left the playlist.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BEHIND = 3
LEAST_RELOAD_S = 0.2
RETRIES, FIRST_BACKOFF_S, LAST_BACKOFF_S = 3, 0.25, 8.0
MAX_LINES = 100_000
SCHEMA = "sequence bigint, uri string, seconds double, discontinuity boolean"


@dataclass
class Playlist:
    target: float = 0.0
    sequence: int = 0
    ended: bool = False
    init_uri: str | None = None
    variants: list[dict] = field(default_factory=list)
    #: uri, seconds, discontinuity
    segments: list[tuple[str, float, bool]] = field(default_factory=list)


_ATTRIBUTE = re.compile(r'([A-Z0-9-]+)=("[^"]*"|[^,]*)')


def attributes(text: str) -> dict[str, str]:
    return {k: v.strip('"') for k, v in _ATTRIBUTE.findall(text)}


def parse_playlist(text: str) -> Playlist:
    """A master or media playlist; ValueError if it is neither, or too long."""
    lines = text.lstrip("﻿").splitlines()
    if not lines or lines[0].strip() != "#EXTM3U":
        raise ValueError("not a playlist")
    if len(lines) > MAX_LINES:
        raise ValueError("playlist too long")
    out, seconds, broken, variant = Playlist(), None, False, None
    for line in map(str.strip, lines[1:]):
        tag, _, value = line.partition(":")
        if not line:
            continue
        if not line.startswith("#"):
            if variant is not None:
                out.variants.append(variant | {"uri": line})
            elif seconds is not None:
                out.segments.append((line, seconds, broken))
            seconds, broken, variant = None, False, None
        elif tag == "#EXTINF":
            seconds = float(value.split(",")[0])
        elif tag == "#EXT-X-TARGETDURATION":
            out.target = float(value)
        elif tag == "#EXT-X-MEDIA-SEQUENCE":
            out.sequence = int(value)
        elif tag == "#EXT-X-DISCONTINUITY":
            broken = True
        elif tag == "#EXT-X-ENDLIST":
            out.ended = True
        elif tag == "#EXT-X-MAP":
            out.init_uri = attributes(value).get("URI")
        elif tag == "#EXT-X-STREAM-INF":
            variant = attributes(value)
    return out


def format_lock(playlist: Playlist) -> str | None:
    """The codecs on which all variants of a master playlist agree; ValueError if they do not, since a decoder is built once."""
    found = {v.get("CODECS", "") for v in playlist.variants}
    if len(found) > 1:
        raise ValueError(f"variants disagree on their codecs: {', '.join(sorted(found))}")
    return found.pop() if found else None


def reload_s(playlist: Playlist, override: float = 0.0) -> float:
    """Seconds between reloads: what was asked for, else the target duration, but never too short; for a processing-time trigger."""
    return max(override if override > 0 else playlist.target, LEAST_RELOAD_S)


def backoff_s(attempt: int) -> float:
    return min(FIRST_BACKOFF_S * 2**attempt, LAST_BACKOFF_S)


def fetch(path: str) -> str:
    """The text of a playlist on a mounted path, tried again a few times with growing pauses."""
    for attempt in range(RETRIES + 1):
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except OSError:
            if attempt == RETRIES:
                raise
            time.sleep(backoff_s(attempt))
    raise AssertionError


class LivePlaylist(DataSource):
    """``spark.readStream.format("sampleloom-live").load(path)``; options: behind."""

    @classmethod
    def name(cls) -> str:
        return "sampleloom-live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)


class _Segments(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.behind = options["path"], int(options.get("behind", BEHIND))
        #: Segments that were offered and are not committed, by epoch and sequence.
        self.held: dict[tuple[int, int], tuple[str, float, bool]] = {}
        self.epoch, self.edge = 0, -1

    def _load(self) -> Playlist:
        p = parse_playlist(fetch(self.path))
        format_lock(p)
        edge = p.sequence + len(p.segments)
        if p.segments and edge < self.edge:
            self.epoch += 1
        if p.segments:
            self.edge = edge
        for k, segment in enumerate(p.segments, p.sequence):
            self.held.setdefault((self.epoch, k), segment)
        return p

    def initialOffset(self) -> dict:
        p = self._load()
        first = p.sequence if p.ended else p.sequence + max(len(p.segments) - self.behind, 0)
        return {"sequence": first, "epoch": self.epoch}

    def latestOffset(self) -> dict:
        self._load()
        return {"sequence": max(self.edge, 0), "epoch": self.epoch}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.epoch, before = max(self.epoch, end["epoch"]), start["sequence"]
        if (end["epoch"], end["sequence"] - 1) not in self.held:
            self._load()  # a batch of an earlier run of the query
        rows = []
        own = sorted((k, s) for (epoch, k), s in self.held.items() if epoch == end["epoch"] and k < end["sequence"])
        if end["epoch"] > start["epoch"] or end["sequence"] < before:
            rows = [(k, uri, seconds, broken or not i) for i, (k, (uri, seconds, broken)) in enumerate(own[-self.behind :])]
        else:
            rows = [(k, *s) for k, s in own if k >= before]
        return [_Segments(rows)]

    def read(self, part) -> Iterator[tuple]:
        yield from part.rows

    def commit(self, end: dict) -> None:
        done = (end["epoch"], end["sequence"])
        self.held = {at: s for at, s in self.held.items() if at >= done}


def register(spark) -> None:
    spark.dataSource.register(LivePlaylist)
