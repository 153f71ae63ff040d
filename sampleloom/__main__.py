"""Command line: probe, analyze, encode and split files on a local session or a cluster's."""

from __future__ import annotations

import argparse
import json
import sys

#: Exit status of a command whose input gave nothing.
NOTHING = 3


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sampleloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("probe", "headers as JSON, one line a file"), ("analyze", "loudness, peaks and silence as JSON, one line a file")):
        c = sub.add_parser(name, help=text)
        c.add_argument("path")
        if name == "analyze":
            c.add_argument("--threshold-db", type=float, default=-50.0)
            c.add_argument("--min-seconds", type=float, default=0.5)
    for name, text in (("encode", "every file in another format"), ("split", "every file in pieces at the given samples")):
        c = sub.add_parser(name, help=text)
        c.add_argument("path")
        c.add_argument("out")
        c.add_argument("--format", default="flac", choices=("wav", "aiff", "flac", "alac"))
        c.add_argument("--bits", type=int, default=16)
        if name == "split":
            c.add_argument("--at", type=int, nargs="+", required=True)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sampleloom.functions.documents import probe_json
    from sampleloom.operators import filters, silence
    from sampleloom.plans import timeline
    from sampleloom.sources import media

    spark = spark or SparkSession.builder.appName("sampleloom").getOrCreate()
    sources = media.read_sources(spark, args.path)
    tracks = media.probe(sources)
    names = sources.select("source_id", "path")
    if args.command == "probe":
        rows = probe_json(tracks).join(names, "source_id").orderBy("path").collect()
        for r in rows:
            print(json.dumps({"path": r["path"]} | json.loads(r["document"])))
        return 0 if rows else NOTHING
    rates = [r["rate"] for r in tracks.select("rate").distinct().collect()]  # as many as there are sample rates
    chunks, found = media.decode_chunks(sources), 0
    if args.command != "analyze":
        media.register(spark)
    for rate in sorted(rates):
        own = tracks.where(F.col("rate") == rate).select("source_id")
        mine = chunks.join(own, "source_id", "left_semi")
        if args.command == "analyze":
            spans = silence.silence_totals(mine, args.threshold_db, max(1, round(args.min_seconds * rate)))
            rows = filters.measure(mine, rate).join(spans, ["source_id", "track_id"], "left").join(names, "source_id").orderBy("path").collect()
            for r in rows:
                print(json.dumps({k: None if v == float("-inf") else v for k, v in r.asDict().items() if k != "source_id"} | {"rate": rate}))
            found += len(rows)
            continue
        if args.command == "encode":
            pieces = [(0, -1)]
        else:
            cuts = sorted(set(args.at))
            pieces = list(zip([0, *cuts], [*cuts, -1], strict=True))
        ext = {"alac": "m4a", "aiff": "aiff"}.get(args.format, args.format)
        for k, (lo, hi) in enumerate(pieces, 1):
            files = media.encode_files(timeline.slice_rows(mine, lo, hi), rate, args.format, args.bits).join(names, "source_id")
            stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
            name = F.concat(stem, F.lit(f".{ext}" if len(pieces) == 1 else f"-{k:02d}.{ext}"))
            files.select(name.alias("name"), "data").write.format("sampleloom-pcm").mode("append").save(args.out)
        found += 1
    return 0 if found else NOTHING


if __name__ == "__main__":
    sys.exit(main())
