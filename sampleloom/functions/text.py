"""Text functions on columns: tags, gains, names, canonical queries, playlists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLAY_GAIN_REFERENCE = -18.0
R128_REFERENCE = -23.0


def parse_gain(value: Column) -> Column:
    """Decibels of a tag such as ``-3.10 dB``; null if it is not a finite number."""
    number = F.regexp_replace(F.trim(value), r"(?i)\s*db$", "").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def format_gain(db: Column) -> Column:
    """Six characters and the unit, so a value can be written over another in place."""
    return F.format_string("%+06.2f dB", F.greatest(F.least(db, F.lit(99.99)), F.lit(-99.99)))


def format_peak(linear: Column) -> Column:
    return F.format_string("%.6f", F.greatest(F.least(linear, F.lit(9.999999)), F.lit(0.0)))


def gain_of(tags: Column, kind: str = "TRACK") -> Column:
    """Gain of a tag map, from the decibel tag or else from the fixed-point tag (1/256 dB against another reference)."""
    first = lambda key: F.get(tags[key], F.lit(0))
    fixed = F.trim(first(f"R128_{kind}_GAIN")).try_cast("int") / 256.0 + (REPLAY_GAIN_REFERENCE - R128_REFERENCE)
    return F.coalesce(parse_gain(first(f"REPLAYGAIN_{kind}_GAIN")), fixed)


def resolve_gain(mode: Column, fixed: Column, tags: Column, ceiling: float = 12.0) -> Column:
    """Decibels to apply, the ceiling at most: ``fixed``, or the gain of the tags (``album`` falls back to the track's), 0 without one."""
    track, album = gain_of(tags), gain_of(tags, "ALBUM")
    gain = F.when(mode == "fixed", fixed).when(mode == "track", track).when(mode == "album", F.coalesce(album, track))
    return F.least(F.coalesce(gain, F.lit(0.0)), F.lit(ceiling))


def valid_tag_key(key: Column) -> Column:
    """Printable ASCII without the equals sign, one character at least."""
    return key.rlike(r"^[\x20-\x3C\x3E-\x7D]+$")


def without_replay_gain(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, _: ~F.upper(k).rlike("^(REPLAYGAIN_|R128_)"))


def merge_tags(container: Column, mapped: Column) -> Column:
    """Tags of both maps; the mapper's win key by key."""
    return F.map_zip_with(container, mapped, lambda _, a, b: F.coalesce(b, a))


def safe_file_name(title: Column, max_bytes: int = 120) -> Column:
    """Separators become dashes, control characters go, the rest is cut to ``max_bytes`` whole characters and trimmed of dots and spaces."""
    s = F.regexp_replace(F.regexp_replace(title, r"[/\\\x00]", "-"), r"[\x00-\x1F]", "")
    sizes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda n: F.octet_length(F.substring(s, F.lit(1), n)))
    fits = F.size(F.filter(sizes, lambda b: b <= max_bytes))
    cut = F.when(F.octet_length(s) <= max_bytes, s).otherwise(F.substring(s, F.lit(1), fits))
    out = F.trim(F.regexp_replace(cut, r"^\.+|\.+$", ""))
    return F.when(out == "", "untitled").otherwise(out)


def piece_name(number: Column, title: Column, ext: str) -> Column:
    head = F.format_string("%02d", number)
    return F.when(F.coalesce(title, F.lit("")) == "", F.concat(head, F.lit("." + ext))).otherwise(F.concat(head, F.lit(" - "), safe_file_name(title), F.lit("." + ext)))


def percent_encode(text: Column) -> Column:
    """RFC 3986: everything but letters, digits and ``-._~``, with upper-case hex."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column, drop: str = "sig") -> Column:
    """Parameters of a raw query text, encoded, sorted by key and value, without the signature."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.split_part(p, F.lit("="), F.lit(1)) != drop))
    coded = F.transform(
        pairs,
        lambda p: F.struct(
            percent_encode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            percent_encode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(coded), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def parse_identity(identity: Column) -> tuple[Column, Column]:
    """Size and modification time (ns) of ``size-mtime``; null where it is not one."""
    good = identity.rlike(r"^\d+-\d+$")
    return F.when(good, F.split_part(identity, F.lit("-"), F.lit(1)).try_cast("long")), F.when(good, F.split_part(identity, F.lit("-"), F.lit(2)).try_cast("long"))


def valid_ulid(text: Column) -> Column:
    return text.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def playlist_attribute(line: Column, name: str) -> Column:
    """The value of one attribute of an attribute list; quoted values may hold commas."""
    raw = F.regexp_extract(line, rf'(?:^|[:,])\s*{name}=("[^"]*"|[^,]*)', 1)
    return F.when(raw != "", F.regexp_replace(raw, '^"|"$', ""))


def media_playlist(uris_and_seconds: Column, init_uri: str) -> Column:
    """A finished media playlist of an array of structs (uri, seconds) in order."""
    longest = F.aggregate(uris_and_seconds, F.lit(0.0), lambda m, s: F.greatest(m, s["seconds"]))
    lines = F.transform(uris_and_seconds, lambda s: F.concat(F.lit("#EXTINF:"), F.format_string("%.5f", s["seconds"]), F.lit(",\n"), s["uri"], F.lit("\n")))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), F.floor(longest + 0.999999).cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-INDEPENDENT-SEGMENTS\n"))
    return F.concat(head, F.lit(f'#EXT-X-MAP:URI="{init_uri}"\n'), F.array_join(lines, ""), F.lit("#EXT-X-ENDLIST\n"))


def master_playlist(variants: Column) -> Column:
    """A master playlist of an array of structs (bandwidth, codecs, uri)."""
    lines = F.transform(variants, lambda v: F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), v["bandwidth"].cast("string"), F.lit(',CODECS="'), v["codecs"], F.lit('"\n'), v["uri"], F.lit("\n")))
    return F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-INDEPENDENT-SEGMENTS\n"), F.array_join(lines, ""))


def _windows_1252() -> tuple[str, str]:
    """Latin-1 control characters and what Windows-1252 has in their place."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs if c)


_C1, _C1_TEXT = _windows_1252()


def from_windows_1252(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), _C1, _C1_TEXT)


def to_windows_1252(text: Column) -> Column:
    return F.encode(F.translate(text, _C1_TEXT, _C1), "ISO-8859-1")


def decode_text(data: Column) -> Column:
    """Text of bytes: by byte order mark, else UTF-8 if valid, else Windows-1252."""
    hexed = F.hex(F.substring(data, 1, 3))
    utf8 = F.decode(data, "UTF-8")
    return (
        F.when(hexed.startswith("EFBBBF"), F.decode(F.substring(data, 4, 1 << 30), "UTF-8"))
        .when(hexed.startswith("FFFE") | hexed.startswith("FEFF"), F.decode(data, "UTF-16"))
        .when(F.is_valid_utf8(data.cast("string")), utf8)
        .otherwise(from_windows_1252(data))
    )
