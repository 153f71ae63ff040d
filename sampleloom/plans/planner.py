"""Choosing the cheapest way to satisfy a request from metadata, and naming its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_PREFIX = "sampleloom-cache-1"
MAX_BOUNDED = 4096
#: Outputs, whether they can be streamed, whether they lose information.
OUTPUTS = {
    "wav": (True, False), "opus": (True, True), "vorbis": (True, True), "aiff": (False, False), "flac": (True, False), "mp3": (True, True),
    "aac": (True, True), "he-aac": (True, True), "alac": (True, False), "wavpack": (True, False), "ape": (False, False),
}
#: Output format of a file extension.
EXTENSIONS = {
    "wav": "wav", "aif": "aiff", "aiff": "aiff", "flac": "flac", "mp3": "mp3", "m4a": "aac", "aac": "aac", "opus": "opus", "ogg": "vorbis", "oga": "flac",
    "wv": "wavpack", "ape": "ape", "mka": "flac", "webm": "opus",
}


def _looked_up(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def output_of_extension(ext: Column) -> Column:
    return _looked_up(F.lower(F.ltrim(ext, F.lit("."))), EXTENSIONS)


def is_lossy(fmt: Column) -> Column:
    return _looked_up(fmt, {k: v[1] for k, v in OUTPUTS.items()})


def fold_to_stereo(fmt: Column, channels: Column) -> Column:
    """Channels of the output: lossy outputs fold what is wider than stereo, lossless ones refuse (null)."""
    return F.when(channels <= 2, channels).when(is_lossy(fmt), F.lit(2))


def direct_playable(requests: DataFrame) -> Column:
    """True when the stored bytes answer the request: nothing is asked that changes them, and they keep to the bit rate cap."""
    r = lambda c: F.col(c)
    keeps = (
        (r("from_sample") == 0)
        & (r("bitrate") == 0)
        & ((r("format") == "auto") | (r("format") == r("container")))
        & ((r("want_rate") == 0) | (r("want_rate") == r("rate")))
        & ((r("want_channels") == 0) | (r("want_channels") == r("channels")))
        & ((r("want_bits") == 0) | ((r("sample_type") == "int") & (r("want_bits") == r("bit_depth"))))
        & (r("gain_db") == 0)
    )
    measured = F.col("bytes") * 8 * F.col("rate") <= F.col("max_kbps") * 1000 * F.col("samples")
    return keeps & ((r("max_kbps") == 0) | ((r("samples") > 0) & measured))


def ladder(direct: Column, remux: Column, cut: Column) -> Column:
    """The first way that works, from the cheapest on."""
    return F.when(direct, "direct").when(remux, "remux").when(cut, "cut").otherwise("transcode")


def needs_limiter(gain_db: Column, matrix_gain: Column, lossless_float: Column) -> Column:
    """A limiter goes in when the level path can exceed full scale and the output cannot hold it."""
    return ((gain_db > 0) | (matrix_gain > 1)) & ~lossless_float


def cache_key(identity: Column, params: Column, versions: Column) -> Column:
    """SHA-256 of a canonical text; versions are an array in order, duplicates removed."""
    listed = F.concat(F.array_join(F.array_distinct(versions), ","), F.lit(","))
    return F.sha2(F.concat_ws("\n", F.lit(CACHE_PREFIX), identity, params, listed), 256)


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def timeline_digest(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest: base64url of the SHA-256 of the members' canonical JSON in order."""
    one = F.concat(F.lit('{"src":"'), F.col("src"), F.lit('","from":'), F.col("from_sample").cast("string"), F.lit(',"to":'), F.col("to_sample").cast("string"), F.lit("}"))
    rows = members.select(*keys, F.struct("idx", one.alias("j")).alias("m"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["j"]), ","), F.lit("]"))
    return rows.groupBy(*keys).agg(base64url(F.unhex(F.sha2(text, 256))).alias("digest"))


def evict(entries: DataFrame, keys: list[str], budget: int, max_age: Column | None = None, pinned: Column | None = None) -> DataFrame:
    """Entries to remove, oldest access first, until the rest keeps to ``budget`` bytes (0: any number) and none is too old.

    An entry goes when it and everything accessed after it exceed the budget,
    or when ``max_age`` holds.  Pinned entries stay, but their bytes count.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("last_access"), F.desc("entry_id")).rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.lit(0).cast("long")
    if pinned is None:
        rows = entries.withColumn("kept_bytes", F.sum("size").over(newest))
    else:
        held = F.sum(F.when(pinned, F.col("size")).otherwise(nothing)).over(Window.partitionBy(*keys))
        rows = entries.withColumn("kept_bytes", F.sum(F.when(pinned, nothing).otherwise(F.col("size"))).over(newest) + held).where(~pinned)
    over = F.col("kept_bytes") > budget if budget else F.lit(False)
    return rows.where(over if max_age is None else over | max_age)


def cache_stats(entries: DataFrame, lookups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entries, bytes, hits, misses: the shape of each store; ``lookups`` has a boolean ``hit``."""
    shape = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))
    asked = lookups.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    both = shape.join(asked, keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("entries", "bytes", "hits", "misses")])


def bounded_map(uses: DataFrame, keys: list[str], entry: str, used: str, capacity: int = MAX_BOUNDED) -> DataFrame:
    """What a map of ``capacity`` entries holds after these uses, when the least recently used one makes room: the last used."""
    last = uses.groupBy(*keys, entry).agg(F.max(used).alias(used))
    order = Window.partitionBy(*keys).orderBy(F.desc(used), F.desc(entry))
    return last.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= capacity).drop("__r")


def trim_sidecars(blobs: DataFrame, keys: list[str], budget: int, largest: int) -> DataFrame:
    """Index sidecars to delete, with ``reason``: leftovers and oversized ones at once, then the oldest beyond the budget.

    ``blobs`` has name, size and mtime; what goes at once does not count against the others.
    """
    junk = F.col("name").endswith(".tmp") | (F.col("size") > largest)
    newest = Window.partitionBy(*keys).orderBy(F.desc("mtime"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.sum(F.when(junk, F.lit(0).cast("long")).otherwise(F.col("size"))).over(newest)
    reason = F.when(junk, "leftover").when(F.col("__kept") > budget, "budget")
    return blobs.withColumn("__kept", kept).withColumn("reason", reason).drop("__kept").where("reason IS NOT NULL")


def capable(names: Column, available: Column) -> Column:
    """The preferred names that are available, in order of preference."""
    return F.filter(names, lambda n: F.array_contains(available, n))


def claim_oldest(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The oldest queued job of each queue."""
    return jobs.where("state = 'queued'").groupBy(*keys).agg(F.min("job_id").alias("job_id"))


def live_edge(segments: DataFrame, keys: list[str], behind: int = 3) -> DataFrame:
    """The last ``behind`` segments of each playlist, in order of their sequence."""
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return segments.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= behind).drop("__r")


def diff_roots(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change (added, removed or changed) between two tables of name and path."""
    both = old.select("name", F.col("path").alias("old_path")).join(new.select("name", F.col("path").alias("new_path")), "name", "full")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "removed").when(F.col("old_path") != F.col("new_path"), "changed")
    return both.select("name", change.alias("change")).where("change IS NOT NULL")


def histogram(rows: DataFrame, keys: list[str], value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative bucket counts, as a metrics endpoint exposes them (the last bound is infinity)."""
    bounded = [F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*keys).agg(*bounded, F.count(value).alias("le_inf"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: index floor(f * (n - 1) + 0.5) of the sorted values."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda f: F.max(F.when(F.col("__r") == F.floor(f * (F.col("__n") - 1) + 0.5), F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(f).alias(name) for name, f in fractions.items()])
