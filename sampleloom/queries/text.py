"""Tags, gains, names, queries, identities and byte sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.functions import media
from sampleloom.functions import text as fn
from sampleloom.queries.tables import table
from sampleloom.registry import query


def _parts(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part")
    gain = F.round((F.col("p_retailprice") % 40) - 20, 2)
    tag = F.when(k % 5 == 0, F.lit("n/a")).when(k % 5 == 1, F.concat(gain.cast("string"), F.lit(" dB"))).when(k % 5 == 2, F.concat(F.lit(" "), gain.cast("string"), F.lit("DB "))).otherwise(gain.cast("string"))
    fixed = F.when(k % 2 == 0, (k % 4000 - 2000).cast("string"))
    tags = F.map_filter(F.create_map(F.lit("REPLAYGAIN_TRACK_GAIN"), F.array(tag), F.lit("R128_TRACK_GAIN"), F.array(fixed), F.lit("TITLE"), F.array("p_name")), lambda _, v: F.get(v, F.lit(0)).isNotNull())
    return rows.select(k.alias("id"), gain.alias("gain"), tag.alias("tag"), tags.alias("tags"), "p_name", "p_type", "p_size")


@query(
    "gain_resolve",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN round((p_retailprice % 40) - 20, 2) WHEN p_partkey % 2 = 0 THEN (p_partkey % 4000 - 2000) / 256.0 + 5 END AS gain_db FROM part""",
)
def gain_resolve(spark, d):
    """Gains from textual tags, or else from fixed-point tags."""
    return _parts(spark, d).select("id", fn.gain_of(F.col("tags")).alias("gain_db"))


@query(
    "gain_format",
    """SELECT p_partkey AS id, printf('%+06.2f dB', least(greatest(round((p_retailprice % 40) - 20, 2) * 8, -99.99), 99.99)) AS text, printf('%.6f', least(greatest(p_size / 4.0 - 1, 0), 9.999999)) AS peak FROM part""",
)
def gain_format(spark, d):
    """Gains and peaks of fixed width, beyond their ranges too."""
    return _parts(spark, d).select("id", fn.format_gain(F.col("gain") * 8).alias("text"), fn.format_peak(F.col("p_size") / 4.0 - 1).alias("peak"))


@query(
    "gain_request",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN least(p_size / 2.0 - 5, 12) WHEN 1 THEN least(coalesce(track, 0), 12) WHEN 2 THEN least(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size / 5.0 END, track, 0), 12) ELSE 0 END AS gain_db
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 <> 0 THEN round((p_retailprice % 40) - 20, 2) WHEN p_partkey % 2 = 0 THEN (p_partkey % 4000 - 2000) / 256.0 + 5 END AS track FROM part)""",
)
def gain_request(spark, d):
    """The gain of a request: a fixed value, the track's tag, or the album's and else the track's; none below a missing tag."""
    album = F.when(F.col("id") % 3 == 0, F.array((F.col("p_size") / 5.0).cast("string")))
    tags = F.map_filter(F.map_concat("tags", F.create_map(F.lit("REPLAYGAIN_ALBUM_GAIN"), album)), lambda _, v: v.isNotNull())
    mode = F.element_at(F.array(*map(F.lit, ("fixed", "track", "album", "off"))), (F.col("id") % 4 + 1).cast("int"))
    return _parts(spark, d).select("id", fn.resolve_gain(mode, F.col("p_size") / 2.0 - 5, tags).alias("gain_db"))


@query(
    "tag_summary",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'R128_TRACK_GAIN,' ELSE '' END || 'REPLAYGAIN_TRACK_GAIN,TITLE' AS keys, 'TITLE' AS kept, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS title FROM part""",
)
def tag_summary(spark, d):
    """Sorted keys; the map without gain tags; a mapper's tags laid over the container's."""
    mapped = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("TITLE"), F.array("p_type"))).otherwise(F.create_map().cast("map<string,array<string>>"))
    merged = fn.merge_tags(F.col("tags"), mapped)
    return _parts(spark, d).select(
        "id",
        F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("keys"),
        F.array_join(F.map_keys(fn.without_replay_gain(F.col("tags"))), ",").alias("kept"),
        F.get(merged["TITLE"], F.lit(0)).alias("title"),
    )


@query(
    "piece_names",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN printf('%02d', p_size) || '.flac' ELSE printf('%02d', p_size) || ' - ' || replace(p_type || '/' || p_name, '/', '-') || '..flac' END AS name FROM part""",
)
def piece_names(spark, d):
    title = F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("..\x01"), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit(". ")))
    return _parts(spark, d).select("id", fn.piece_name(F.col("p_size"), title, "flac").alias("name"))


@query(
    "canonical_query",
    """WITH q AS (SELECT page_id, CASE WHEN contains(url, '?') THEN split_part(split_part(url, '?', 2), '#', 1) ELSE '' END || '&z=a b&sig=xx&a=' || (page_id % 7) || '*~' AS query FROM pages),
p AS (SELECT page_id, unnest(string_split(query, '&')) AS p FROM q)
SELECT page_id, string_agg(split_part(p, '=', 1) || '=' || replace(replace(substr(p, strpos(p, '=') + 1), ' ', '%20'), '*', '%2A'), '&' ORDER BY split_part(p, '=', 1), p) AS canonical FROM p WHERE p <> '' AND split_part(p, '=', 1) <> 'sig' GROUP BY page_id""",
)
def canonical_query(spark, d):
    """Query parameters sorted and percent-encoded, without the signature."""
    rows = table(spark, d, "pages")
    raw = F.when(F.contains("url", F.lit("?")), F.split_part(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("#"), F.lit(1))).otherwise("")
    full = F.concat(raw, F.lit("&z=a b&sig=xx&a="), (F.col("page_id") % 7).cast("string"), F.lit("*~"))
    return rows.select("page_id", fn.canonical_query(full).alias("canonical"))


@query(
    "identity_parse",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS size, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 1000 END AS mtime_ns, o_orderkey % 3 = 0 AS good_ulid FROM orders",
)
def identity_parse(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 != 0, F.concat_ws("-", F.col("o_custkey").cast("string"), (k * 1000).cast("string"))).otherwise(F.concat(k.cast("string"), F.lit("-x")))
    size, mtime = fn.parse_identity(text)
    ulid = F.concat(F.when(k % 3 == 0, "01").otherwise("8I"), F.lpad(F.upper(F.hex(k)), 24, "0"))
    return table(spark, d, "orders").select(k.alias("id"), size.alias("size"), mtime.alias("mtime_ns"), fn.valid_ulid(ulid).alias("good_ulid"))


_HEADS = (("664C6143", "flac"), ("5249464600000000574156456", "wav"), ("4F67675300", "ogg"), ("0000002066747970", "mp4"), ("FFFB9000", "mp3"), ("FFF15080", "adts"), ("49443304000000000002AAAA4D414320", "ape"), ("00000000", None))


@query(
    "sniff_containers",
    "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'flac' WHEN 1 THEN 'wav' WHEN 2 THEN 'ogg' WHEN 3 THEN 'mp4' WHEN 4 THEN 'mp3' WHEN 5 THEN 'adts' WHEN 6 THEN 'ape' ELSE CASE WHEN page_id % 16 = 7 THEN 'wavpack' END END AS container FROM pages",
)
def sniff_containers(spark, d):
    """Containers by the first bytes, behind a tag, and by extension as a last resort."""
    heads = F.array(*[F.unhex(F.lit(h if len(h) % 2 == 0 else h[:-1])) for h, _ in _HEADS])
    data = F.concat(F.get(heads, (F.col("page_id") % 8).cast("int")), F.encode(F.substring("html", 1, 30), "UTF-8"))
    ext = F.when(F.col("page_id") % 16 == 7, ".WV").otherwise(".bin")
    return table(spark, d, "pages").select("page_id", media.sniff(data, ext).alias("container"))


@query("text_decode", "SELECT doc_id, text FROM documents")
def text_decode(spark, d):
    """Whole texts stored as UTF-8, with a byte order mark, as UTF-16 and as Windows-1252 (where it holds them) come back alike."""
    head = F.col("text")
    latin = ~head.rlike("[^\\x00-\\xFF]")
    mark = F.unhex(F.lit("EFBBBF"))
    k = F.col("doc_id") % 4
    data = F.when(k == 0, F.concat(mark, F.encode(head, "UTF-8"))).when(k == 1, F.encode(head, "UTF-16")).when((k == 2) & latin & ~F.is_valid_utf8(fn.to_windows_1252(head).cast("string")), fn.to_windows_1252(head)).otherwise(F.encode(head, "UTF-8"))
    return table(spark, d, "documents").select("doc_id", fn.decode_text(data).alias("text"))


@query(
    "attribute_list",
    "SELECT p_partkey AS id, p_size * 1000 AS bandwidth, p_type || ',x' AS codecs, p_brand AS name FROM part",
)
def attribute_list(spark, d):
    """Attributes of a playlist line, quoted commas included."""
    line = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("p_size") * 1000).cast("string"), F.lit(',CODECS="'), F.col("p_type"), F.lit(',x",NAME='), F.col("p_brand"))
    a = lambda name: fn.playlist_attribute(line, name)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), a("BANDWIDTH").cast("int").alias("bandwidth"), a("CODECS").alias("codecs"), a("NAME").alias("name"))


@query("signed_urls")
def signed_urls(spark, d):
    """A signature per page and whether it still holds an hour later and a day later (no SQL form: HMAC)."""
    rows = table(spark, d, "pages").withColumn("expires", (F.lit(1_700_000_000) + media.signature_ttl(F.col("page_id").cast("double"))).cast("long"))
    rows = rows.withColumn("sig", media.sign(F.col("url"), fn.canonical_query(F.lit("b=2&a=1")), F.col("expires"), F.lit("key")))
    check = lambda at: media.verify(F.col("url"), F.lit("a=1&b=2"), F.col("expires"), F.col("sig"), F.lit("key"), F.lit(1_700_000_000 + at))
    return rows.select("page_id", "sig", check(3600).alias("soon"), check(86400).alias("late"))
