"""Documents of the service as columns: probes, silence maps, job states, descriptors, metrics, lyrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.plans.planner import base64url

#: Job types and the states a job may go to.
JOB_TYPES = ("transcode", "analyze", "timeline", "merge", "split")
JOB_STATES = {"queued": ("running", "canceled"), "running": ("done", "failed", "canceled", "queued"), "done": (), "failed": (), "canceled": ()}
DESCRIPTOR_FIELDS = "ver int, src string, id string, tl string, format string, bitrate int, bits int, rate int, ch int, gain double, dynamics string, segDur double, `from` bigint, `to` bigint, crossfadeSeconds double"


def encode_descriptor(fields: Column) -> Column:
    """A struct as base64url of its JSON; null fields are left out."""
    return base64url(F.encode(F.to_json(fields), "UTF-8"))


def decode_descriptor(text: Column) -> Column:
    """The struct of a descriptor; null where it is not one."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int")))
    return F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), DESCRIPTOR_FIELDS)


def probe_json(tracks: DataFrame) -> DataFrame:
    """source_id, document: the probe of each source as JSON, its tracks in order."""
    seconds = F.when(F.col("samples") >= 0, F.round(F.col("samples") / F.col("rate"), 6))
    track = F.struct(
        F.col("track_id").alias("id"), "codec", "rate", "channels", "layout", F.col("sample_type").alias("sampleType"), F.col("bit_depth").alias("bitDepth"), "samples",
        seconds.alias("durationSeconds"), F.col("is_default").alias("default"),
    )
    rows = tracks.groupBy("source_id", "container").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    return rows.select("source_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "container", "tracks")).alias("document"))


def silence_map_json(spans: DataFrame, totals: DataFrame, keys: list[str], threshold_db: float, min_seconds: float, rate: int) -> DataFrame:
    """keys, document: spans in order with their seconds, and what was dropped."""
    at = lambda c: F.round(F.col(c) / rate, 6)
    span = F.struct(F.col("from_sample").alias("fromSample"), F.col("to_sample").alias("toSample"), at("from_sample").alias("fromSeconds"), at("to_sample").alias("toSeconds"))
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = totals.withColumnRenamed("spans", "n_spans").join(listed, keys, "left")
    empty = F.array().cast(listed.schema["spans"].dataType)
    document = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit(threshold_db).alias("thresholdDb"), F.lit(min_seconds).alias("minSeconds"), F.lit(rate).alias("rate"), F.coalesce("spans", empty).alias("spans"),
        "dropped", at("dropped_samples").alias("droppedSeconds"), at("total_samples").alias("totalSeconds"),
    )
    return rows.select(*keys, F.to_json(document).alias("document"))


def next_state(state: Column, wanted: Column) -> Column:
    """The wanted state if the job may go there, else null."""
    allowed = F.create_map(*[x for s, to in JOB_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    return F.when(F.array_contains(allowed[state], wanted), wanted)


def replay_jobs(events: DataFrame) -> DataFrame:
    """job_id, state after its events (job_id, at, state) in order: the last one that was allowed when it came.

    States form a chain of at most a few steps, so an aggregate over the sorted events of one job holds no more than these.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("at", "state")))
    allowed = F.create_map(*[x for s, to in JOB_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    step = lambda s, e: F.when(F.array_contains(allowed[s], e["state"]), e["state"]).otherwise(s)
    return events.groupBy("job_id").agg(sorted_.alias("e")).select("job_id", F.aggregate("e", F.lit("queued"), step).alias("state"))


def expired_uploads(uploads: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Uploads that nobody fetched within their time to live."""
    return uploads.where((F.col("received_s") + ttl_seconds < now) & ~F.col("consumed"))


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """One row, text: metrics(name, kind, labels map, value) in the exposition format, sorted by name and labels."""
    label = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(label, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    rows = metrics.select("name", "kind", line.alias("line")).groupBy("name", "kind").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    part = F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return rows.select("name", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda p: p["part"]), "").alias("text"))


def synced_lyrics(lines: Column) -> Column:
    """Timed lines of an LRC text: array of structs (ms, text) in order of time; a line may carry several times."""
    stamps = lambda s: F.regexp_extract_all(s, F.lit(r"\[(\d+:\d{1,2}(?:[.:]\d{1,3})?)\]"), 1)

    def ms(stamp: Column) -> Column:
        minutes, rest = F.split_part(stamp, F.lit(":"), F.lit(1)).cast("long"), F.regexp_replace(stamp, r"^\d+:", "")
        seconds, fraction = F.regexp_extract(rest, r"^(\d+)", 1).cast("long"), F.regexp_extract(rest, r"[.:](\d+)$", 1)
        return (minutes * 60 + seconds) * 1000 + F.when(fraction == "", 0).otherwise(F.rpad(fraction, 3, "0").cast("long"))

    timed = F.transform(F.split(lines, r"\r?\n"), lambda s: F.transform(stamps(s), lambda t: F.struct(ms(t).alias("ms"), F.trim(F.regexp_replace(s, r"\[\d+:\d{1,2}(?:[.:]\d{1,3})?\]", "")).alias("text"))))
    return F.array_sort(F.flatten(timed))


def seek_index(packets: DataFrame, keys: list[str], every: int) -> DataFrame:
    """A thinned seek table: the first sync packet in each stretch of ``every`` samples; kept beside a file under its identity."""
    w = Window.partitionBy(*keys, F.floor(F.col("pts") / every)).orderBy("pts")
    return packets.where("sync").withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, "pts", "seq")
