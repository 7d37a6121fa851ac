"""Command line: load a folder of files, list documents in force, run a query, run a drained ingestion stream."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnlake", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="parse and chunk a folder of files into a snapshot")
    load.add_argument("folder")
    load.add_argument("store")
    load.add_argument("--tenant", required=True)
    listed = sub.add_parser("list", help="documents of a store")
    listed.add_argument("store")
    query = sub.add_parser("query", help="run a listed query over a data folder")
    query.add_argument("name")
    query.add_argument("data")
    query.add_argument("--out", help="write Parquet here instead of showing rows")
    stream = sub.add_parser("stream", help="ingest the JSON submissions of a folder, then stop")
    stream.add_argument("folder")
    stream.add_argument("out")
    stream.add_argument("checkpoint")
    args = parser.parse_args(argv)

    from tarnlake.engine import Engine
    from tarnlake.plans import catalog
    from tarnlake.session import build_session
    from tarnlake.sources import files, parsing, tables
    from tarnlake.streaming import ingest_stream

    spark = build_session()
    if args.command == "load":
        parsed = parsing.parsed(files.corpus(spark, args.folder)).join(files.corpus(spark, args.folder).select("path", "doc_id"), "path")
        good = parsed.filter(F.col("error").isNull()).select(F.lit(args.tenant).alias("tenant_id"), "doc_id", F.lit(1).alias("version"), "title", "text", "media_type")
        name = tables.swap_in({"documents": good, "chunks": Engine(spark).chunk(good.select("tenant_id", "doc_id", "version", "text")), "rejected": parsed.filter(F.col("error").isNotNull()).drop("text")}, args.store)
        counts = {t: tables.read_table(spark, args.store, t).count() for t in ("documents", "chunks", "rejected")}
        print(name, *(f"{k}={v}" for k, v in counts.items()))
    elif args.command == "list":
        tables.read_table(spark, args.store, "documents").select("tenant_id", "doc_id", "version", "title").orderBy("tenant_id", "doc_id").show(100, truncate=False)
    elif args.command == "query":
        df = catalog.queries()[args.name](spark, args.data)
        df.write.mode("errorifexists").parquet(args.out) if args.out else df.show(20, truncate=60)
    else:
        ingest_stream.start(ingest_stream.submissions(spark, args.folder), args.out, args.checkpoint).awaitTermination()
        ingest_stream.job_states(spark, args.out).groupBy("state").count().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
