"""Table functions for SQL: chunks, sentences and claims of a text."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tarnlake.operators.textops import chunk_spans
from tarnlake.session import prepare


class ChunksOf:
    def eval(self, text: str, target: int, overlap: int, least: int):  # noqa: ANN201
        for k, (a, b) in enumerate(chunk_spans(text or "", target, overlap, least)):
            yield k, text[a:b], a, b


class CitationsOf:
    def eval(self, sentence: str):  # noqa: ANN201
        block = re.search(r"(?:\s*\[[^\[\]]+\])+\s*$", sentence or "")
        for k, name in enumerate(re.findall(r"\[([^\[\]]+)\]", block.group()) if block else ()):
            yield k, name


def register_all(spark: SparkSession) -> None:
    """Make ``chunks_of(text, target, overlap, least)`` and ``citations_of(sentence)`` known to SQL."""
    prepare(spark)
    spark.udtf.register("chunks_of", udtf(ChunksOf, returnType="ordinal int, chunk string, span_start int, span_end int"))
    spark.udtf.register("citations_of", udtf(CitationsOf, returnType="place int, chunk_id string"))
