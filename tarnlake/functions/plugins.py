"""Functions that users may put in: embedders, rerankers, scorers, generators, by name.

A plug-in is a Python function over lists; it runs in Arrow batches.  The defaults need no model: a
hashed bag-of-words embedder, a reranker by shared words, token overlap as the scorer and the extractive
generator.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.text import OVERLAP_STOPWORDS
from tarnlake.session import prepare

KINDS = ("embedder", "reranker", "scorer", "generator")
_known: dict[tuple[str, str], Callable[..., Any]] = {}
_WORD = re.compile(r"\w+")


def register(kind: str, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Decorator that makes a function known under a kind and a name."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")

    def keep(f: Callable[..., Any]) -> Callable[..., Any]:
        _known[kind, name] = f
        return f

    return keep


def get(kind: str, name: str) -> Callable[..., Any]:
    try:
        return _known[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name!r}; known: {sorted(n for k, n in _known if k == kind)}") from None


@register("embedder", "hashed")
def hashed(texts: list[str | None], dim: int = 64) -> list[list[float] | None]:
    """Unit vectors of signed word hashes; null and wordless texts have none."""
    out: list[list[float] | None] = []
    for text in texts:
        v = [0.0] * dim
        for w in _WORD.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm else None)
    return out


@register("scorer", "overlap")
def overlap(pairs: list[tuple[str | None, str | None]]) -> list[float]:
    """Share of the second text's content words found in the first."""
    stop = set(OVERLAP_STOPWORDS)
    scores = []
    for premise, hypothesis in pairs:
        words = set(_WORD.findall((hypothesis or "").lower())) - stop
        scores.append(len(words & set(_WORD.findall((premise or "").lower()))) / len(words) if words else 0.0)
    return scores


register("reranker", "overlap")(lambda pairs: overlap([(passage, query) for query, passage in pairs]))


def embedded(rows: DataFrame, text: str = "text", name: str = "hashed", dim: int = 64, out: str = "embedding") -> DataFrame:
    """Adds unit vectors of a text column; a wrong dimension is an error."""
    prepare(rows.sparkSession)
    f = get("embedder", name)

    def run(texts: pa.Array) -> pa.Array:
        vectors = f(texts.to_pylist(), dim)
        if any(v is not None and len(v) != dim for v in vectors):
            raise ValueError(f"the embedder does not give {dim} numbers")
        return pa.array(vectors, pa.list_(pa.float64()))

    return rows.withColumn(out, F.arrow_udf(run, T.ArrayType(T.DoubleType()))(F.col(text)))


def backfilled(rows: DataFrame, text: str = "text", out: str = "embedding", **options: Any) -> DataFrame:
    """Vectors where there are none; rows that have one are left as they are and are not computed."""
    have = rows.filter(F.col(out).isNotNull())
    made = embedded(rows.filter(F.col(out).isNull()).drop(out), text, out=out, **options)
    element = rows.schema[out].dataType.elementType
    return have.unionByName(made.withColumn(out, F.transform(out, lambda x: x.cast(element))).select(rows.columns))


def pair_scores(first: Column, second: Column, kind: str = "scorer", name: str = "overlap") -> Column:
    """Scores of pairs of texts by a registered scorer or reranker, in Arrow batches."""
    f = get(kind, name)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float(s) for s in f(list(zip(a.to_pylist(), b.to_pylist(), strict=True)))], pa.float64())

    return F.arrow_udf(run, T.DoubleType())(first, second)
