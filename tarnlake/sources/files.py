"""Files as sources: document folders, result records as JSON lines, dataset manifests."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "html", "htm", "pdf", "docx")
FORMAT = 1


def corpus(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files below a folder: doc_id (path within it), path, content, declared (null)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    qualified = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    root = re.sub("^file:/*", "/", qualified).rstrip("/") + "/"
    bare = F.regexp_replace("path", "^file:/*", "/")
    inside = F.when(F.startswith(bare, F.lit(root)), F.substring(bare, F.lit(len(root) + 1), F.char_length(bare))).otherwise(bare)
    return files.select(inside.alias("doc_id"), "path", "content", F.lit(None).cast("string").alias("declared"))


def write_records(records: DataFrame, folder: str, settings: dict) -> None:
    """Records as JSON lines, and a header file with format and settings; a null stays a key."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/rows")
    header = json.dumps({"format": FORMAT, "settings": settings}, sort_keys=True)
    records.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")


def read_records(spark: SparkSession, folder: str, schema: str, settings: dict | None = None) -> DataFrame:
    """Records of a folder; another format or other settings are an error, torn lines are left out."""
    header = json.loads(spark.read.text(f"{folder}/header").first()["value"])
    if header.get("format") != FORMAT:
        raise ValueError(f"records have format {header.get('format')}, not {FORMAT}")
    if settings is not None and header["settings"] != settings:
        raise ValueError("records were made with other settings")
    rows = spark.read.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").option("mode", "PERMISSIVE").json(f"{folder}/rows")
    return rows.filter(F.col("_torn").isNull()).drop("_torn")


def write_report(tables: dict[str, DataFrame], folder: str, most_rows: int = 10_000) -> None:
    """Small result tables as JSON (one array of rows per table) and as one Markdown report, for people and plots.

    Curves and summaries have a row per grid place or configuration; a table of more than ``most_rows`` rows is an
    error and belongs into a data file.
    """
    spark = next(iter(tables.values())).sparkSession
    report = []
    for name, df in tables.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        spark.createDataFrame([(json.dumps(rows, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")
        shown = ["| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|").replace("\n", " ") for c in df.columns) + " |" for r in rows]
        report += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *shown, ""]
    spark.createDataFrame([("\n".join(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.md")


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` without a record yet, so that a run can be taken up again."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


MANIFEST = (
    "name string, lang string, description string, queries array<struct<id: string, text: string, relevant_docs: array<string>, "
    "category: string, note: string, evidence: array<string>, answer: string, status: string>>"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a dataset manifest, with its defaults filled in."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    q = rows.select("name", "lang", F.explode("queries").alias("q")).select("name", "lang", "q.*").withColumnRenamed("id", "query_id")
    empty = F.array().cast("array<string>")
    return q.withColumns({
        "relevant_docs": F.coalesce("relevant_docs", empty),
        "evidence": F.coalesce("evidence", empty),
        "category": F.coalesce("category", F.when(F.size(F.coalesce("relevant_docs", empty)) > 0, "answerable").otherwise("unanswerable")),
        "status": F.coalesce("status", F.lit("draft")),
    })


def manifest_errors(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Every rule a manifest breaks: query_id, problem.  ``documents``: doc_id, text."""
    def plain(c):  # noqa: ANN001, ANN202
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    repeated = queries.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("repeated id").alias("problem"))
    status = queries.filter(~F.col("status").isin("draft", "verified", "rejected")).select("query_id", F.concat(F.lit("unknown status "), "status").alias("problem"))
    labels = queries.select("query_id", F.explode("relevant_docs").alias("doc_id"))
    lost = labels.join(documents, "doc_id", "left_anti").select("query_id", F.concat(F.lit("no document "), "doc_id").alias("problem"))
    quotes = queries.filter("status <> 'rejected'").select("query_id", F.explode("evidence").alias("quote"))
    texts = labels.join(documents, "doc_id").select("query_id", plain(F.col("text")).alias("body"))
    held = quotes.withColumn("plain", plain(F.col("quote"))).join(texts, "query_id", "left").groupBy("query_id", "quote").agg(F.max(F.coalesce(F.contains("body", "plain"), F.lit(False))).alias("ok"))
    missing = held.filter(~F.col("ok")).select("query_id", F.concat(F.lit("quote not found: "), F.substring("quote", 1, 60)).alias("problem"))
    return reduce(DataFrame.unionByName, [repeated, status, lost, missing])
