"""Recognising media bytes, identities, signatures and checksums."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.sources.bits import crc16

#: Container, offset and bytes (hex) of its signature, in the order they are tried.
SIGNATURES = (
    ("flac", 0, "664C6143"),
    ("wav", 0, "52494646"),
    ("wav", 0, "52463634"),
    ("aiff", 0, "464F524D"),
    ("ogg", 0, "4F676753"),
    ("mp4", 4, "66747970"),
    ("mka", 0, "1A45DFA3"),
    ("ape", 0, "4D414320"),
    ("wavpack", 0, "7776706B"),
    ("asf", 0, "3026B2758E66CF11A6D900AA0062CE6C"),
)
#: Container of a file extension, used when the bytes do not decide.
EXTENSION_HINTS = {"flac": "flac", "wav": "wav", "aif": "aiff", "aiff": "aiff", "ogg": "ogg", "oga": "ogg", "opus": "ogg", "m4a": "mp4", "m4b": "mp4", "mp4": "mp4",
                   "mka": "mka", "webm": "mka", "aac": "adts", "ape": "ape", "wv": "wavpack", "wma": "asf", "asf": "asf", "mp3": "mp3"}


def _byte(data: Column, at: int) -> Column:
    """The unsigned byte at an offset; null past the end."""
    piece = F.substring(data, at + 1, 1)
    return F.when(F.octet_length(piece) == 1, F.conv(F.hex(piece), 16, 10).cast("int"))


def id3v2_size(head: Column) -> Column:
    """Bytes of a leading ID3v2 tag with its header (and footer), 0 if there is none; sizes have seven bits a byte."""
    size = sum((_byte(head, 6 + k).bitwiseAND(F.lit(127)) * (1 << (7 * (3 - k))) for k in range(4)), F.lit(0))
    footer = F.when(_byte(head, 5).bitwiseAND(F.lit(16)) != 0, 10).otherwise(0)
    return F.when(F.hex(F.substring(head, 1, 3)) == "494433", size + 10 + footer).otherwise(0)


def sniff(data: Column, ext: Column | None = None) -> Column:
    """Container of the bytes: signatures first, MPEG syncs last (they match by chance), the extension only if nothing does."""
    head = F.substring(data, id3v2_size(data) + F.lit(1), F.lit(20))
    out = None
    for name, at, magic in SIGNATURES:
        hit = F.hex(F.substring(head, at + 1, len(magic) // 2)) == magic
        if name == "wav":
            hit = hit & (F.hex(F.substring(head, 9, 4)) == "57415645")
        if name == "aiff":
            hit = hit & F.hex(F.substring(head, 9, 4)).isin("41494646", "41494643")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    sync = (_byte(head, 0) == 255) & (_byte(head, 1) >= 224)
    layer = F.shiftright(_byte(head, 1), 1).bitwiseAND(F.lit(3))
    out = out.when((_byte(head, 0) == 255) & (_byte(head, 1).bitwiseAND(F.lit(246)) == 240), "adts")
    out = out.when(sync & (layer != 0), "mp3")
    if ext is None:
        return out
    hints = F.create_map(*[F.lit(x) for pair in EXTENSION_HINTS.items() for x in pair])
    return F.coalesce(out, hints[F.lower(F.ltrim(ext, F.lit(".")))])


@F.pandas_udf(T.StringType())
def hmac_sha256(key: pd.Series, message: pd.Series) -> pd.Series:
    """Lower-case hex of the HMAC; Spark has no such function."""
    return pd.Series([None if k is None or m is None else hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(key, message)])


SIGNATURE_LEEWAY_S, SIGNATURE_LEAST_S = 60, 6 * 3600


def signature_ttl(duration_s: Column) -> Column:
    """Seconds a signature lasts: six hours, or twice the duration if that is longer."""
    return F.greatest(F.lit(SIGNATURE_LEAST_S).cast("double"), 2 * duration_s)


def sign(path: Column, canonical: Column, expires: Column, key: Column) -> Column:
    return hmac_sha256(key, F.concat_ws("\n", path, canonical, expires.cast("string")))


def verify(path: Column, canonical: Column, expires: Column, signature: Column, key: Column, now: Column) -> Column:
    """Null if the signature holds, else an error code."""
    return F.when(sign(path, canonical, expires, key) != signature, "signature-invalid").when(now > expires + SIGNATURE_LEEWAY_S, "signature-expired")


@F.pandas_udf(T.IntegerType())
def crc16_of(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else crc16(d) for d in data], dtype="Int32")


def mint_ulid(time_ms: int, entropy: int) -> str:
    """26 characters of Crockford's base 32: 48 bits of time, 80 of entropy."""
    value = (time_ms & (1 << 48) - 1) << 80 | entropy & (1 << 80) - 1
    return "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[value >> 5 * k & 31] for k in range(25, -1, -1))
