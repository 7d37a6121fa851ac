"""Text operators on passages and answers: span-exact chunks, sentences and claims, premise windows, extractive answers.

Chunking needs a greedy pass over segments and runs in Arrow batches; everything else is column
expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.session import prepare

# Defaults of the chunker.
TARGET, OVERLAP, LEAST = 1200, 150, 120
_PARAGRAPH_GAP = re.compile(r"\s*\n\s*\n\s*")
_AFTER_SENTENCE = re.compile(r"[.!?…][\"')\]]*(\s+)")

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "vb vs bkz örn md bnd fıkr no sn dr av prof doç yrd sk mah cad apt bkn yy krş etc cf inc ltd co mr mrs ms fig vol p pp art sec".split()
    + [r"e\.g", r"i\.e"]
)
# Conjunctions that may join two claims after a comma.
CONJUNCTIONS = "ve ancak fakat ayrıca and but however moreover".split()
LEAST_CLAUSE = 25
# Fixed value: what lies between the units of a premise.
UNIT_GAP = r"(?u)(?<=[.!?…;:])\s+(?=[\w(\[«\"“])|\n+"
_HIDDEN = ""


def segments(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of every paragraph; closing quotes and brackets stay with their sentence."""
    out: list[tuple[int, int]] = []
    begin = 0
    for end, after in [*((m.start(), m.end()) for m in _PARAGRAPH_GAP.finditer(text)), (len(text), len(text))]:
        for m in _AFTER_SENTENCE.finditer(text, begin, end):
            out.append((begin, m.start(1)))
            begin = m.end()
        out.append((begin, end))
        begin = after
    return [(x, y) for x, y in out if text[x:y].strip()]


def chunk_spans(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """Spans of overlapping chunks: as many whole segments as fit the target.

    Each chunk after the first starts again within the last ``overlap`` characters of the one before,
    or at least one segment back where that one held several.  A segment beyond the target is cut hard;
    a last chunk under ``least`` joins the one before it.
    """
    if target <= 0 or not 0 <= overlap < target or least < 0:
        raise ValueError("sizes do not fit together")
    parts = segments(text or "")
    starts, ends = [a for a, _ in parts], [b for _, b in parts]
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(parts):
        # the last segment whose end lies within the target
        stop = max(at + 1, bisect_left(ends, starts[at] + target + 1, at))
        begin, end = starts[at], ends[stop - 1]
        if end - begin > target:
            out += [(k, min(k + target, end)) for k in range(begin, end, target)]
            at = stop
            continue
        out.append((begin, end))
        if stop < len(parts) and overlap:
            back = max(at + 1, bisect_left(starts, end - overlap, at, stop))
            at = back if back < stop else max(stop - 1, at + 1) if stop - 1 > at else stop
        else:
            at = stop
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        last = out.pop()
        out[-1] = (out[-1][0], max(out[-1][1], last[1]))
    return out


_CHUNKS = "array<struct<chunk: string, span_start: int, span_end: int>>"
_CHUNK_TYPE = pa.list_(pa.struct([("chunk", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())]))


def with_chunks(rows: DataFrame, text: str = "text", target: str | None = None, overlap: str | None = None, least: str | None = None) -> DataFrame:
    """Every row with an array ``chunks`` (chunk, span_start, span_end) of its text.

    ``target``, ``overlap`` and ``least`` name integer columns with each row's own limits.
    """
    prepare(rows.sparkSession)
    kept = [c for c in rows.columns if c != "chunks"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sizes = [b.column(c).to_pylist() if c else [d] * n for c, d in ((target, TARGET), (overlap, OVERLAP), (least, LEAST))]
            made = []
            for t, x, o, m in zip(b.column(text).to_pylist(), *sizes, strict=True):
                spans = chunk_spans(t, x or TARGET, o or 0, m or 0) if t else []
                made.append([{"chunk": t[a:e], "span_start": a, "span_end": e} for a, e in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, _CHUNK_TYPE)], names=[*kept, "chunks"])

    return rows.mapInArrow(run, f"{fields}, chunks {_CHUNKS}")


def chunked(rows: DataFrame, text: str = "text", target: str | None = None, overlap: str | None = None, least: str | None = None) -> DataFrame:
    """One row per chunk: the other columns with ordinal, chunk, span_start and span_end."""
    limits = [c for c in (target, overlap, least) if c]
    kept = [c for c in rows.columns if c not in (text, *limits, "ordinal", "chunk", "span_start", "span_end")]
    made = with_chunks(rows.select(*kept, text, *limits), text, target, overlap, least)
    return made.select(*kept, F.posexplode("chunks").alias("ordinal", "_c")).select(*kept, "ordinal", "_c.chunk", "_c.span_start", "_c.span_end")


def chunk_faults(text: Column, chunks: Column, target: Column) -> Column:
    """Of a text's chunks: how many do not give back their span, how many pass the target (the last may), and the characters in none."""
    given = lambda c: F.substring(text, c["span_start"] + 1, c["span_end"] - c["span_start"])
    n = F.size(chunks)
    starts = F.concat(F.transform(chunks, lambda c: c["span_start"]), F.array(F.char_length(text)))
    ends = F.concat(F.array(F.lit(0)), F.transform(chunks, lambda c: c["span_end"]))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.substring(text, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))))
    return F.struct(
        F.size(F.filter(chunks, lambda c: given(c) != c["chunk"])).alias("broken"),
        F.size(F.filter(F.slice(chunks, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda c: c["span_end"] - c["span_start"] > target)).alias("too_long"),
        F.char_length(F.regexp_replace(F.array_join(gaps, ""), r"(?U)\s+", "")).alias("lost"),
    )


# A full stop that ends no sentence: of an abbreviation, within or after e.g. and i.e., between digits, or after a lone
# digit that a small letter follows.
_INNER_STOP = (
    r"(?<=\b(?:" + "|".join(ABBREVIATIONS) + r"))\.|(?<=\b[ei])\.(?=[ge]\.)|(?<=\d)\.(?=\d)|(?-i:(?<=\b\d)\.(?=\s+[a-zçğıöşü]))"
)
_SENTENCE = rf"(?siu)(?=.)(?:[^.!?…]++|{_INNER_STOP})*+(?:[.!?…](?:\s*\[[^\[\]]+\])*|$)"


def marked_sentences(text: Column) -> Column:
    """Sentences with their trailing citations: one scan for end marks that passes over the stops that end no sentence."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) > 0)


def citations_of(sentence: Column) -> Column:
    """Ids in the trailing block of square brackets."""
    block = F.regexp_extract(sentence, r"((?:\s*\[[^\[\]]+\])+)\s*$", 1)
    return F.regexp_extract_all(block, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))


def without_citations(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, r"(?:\s*\[[^\[\]]+\])+\s*$", ""))


def clauses(sentence: Column) -> Column:
    """Claims joined by a comma and a conjunction, where each stands on its own; else the sentence."""
    parts = F.filter(F.transform(F.split(sentence, r"(?iu),\s+(?:" + "|".join(CONJUNCTIONS) + r")\s+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    whole = (F.size(parts) < 2) | F.exists(parts, lambda p: F.char_length(p) < LEAST_CLAUSE)
    ended = F.transform(parts, lambda p: F.when(p.rlike(r"[.!?…]$"), p).otherwise(F.concat(p, F.lit("."))))
    return F.when(whole, F.array(sentence)).otherwise(ended)


def drafted_claims(answers: DataFrame, key: str = "query_id", text: str = "answer") -> DataFrame:
    """Claims of every answer in order, with the citations of their sentence."""
    rows = answers.select(key, F.posexplode(marked_sentences(F.col(text))).alias("s_no", "sentence"))
    rows = rows.select(key, "s_no", without_citations(F.col("sentence")).alias("prose"), citations_of(F.col("sentence")).alias("citations")).filter(F.length("prose") > 0)
    rows = rows.select(key, "s_no", "citations", F.posexplode(clauses(F.col("prose"))).alias("c_no", "claim"))
    w = Window.partitionBy(key).orderBy("s_no", "c_no")
    return rows.select(key, F.row_number().over(w).alias("claim_no"), "claim", "citations")


def premise_windows(premise: Column, size: int = 2) -> Column:
    """Every run of ``size`` neighbouring sentences or lines."""
    units = F.split(premise, UNIT_GAP)
    units = F.filter(F.transform(units, lambda u: F.trim(F.regexp_replace(u, r"\s+", " "))), lambda u: F.length(u) > 0)
    n = F.size(units)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(units, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(units, " "))).otherwise(many)


def windowed_overlap(premise: Column, hypothesis: Column, size: int = 2) -> Column:
    """Best overlap of the hypothesis with any window of the premise."""
    scores = F.transform(premise_windows(premise, size), lambda w: T.overlap_score(w, hypothesis))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def extracted_answers(queries: DataFrame, passages: DataFrame, most: int = 4) -> DataFrame:
    """The sentences of a query's passages that share most words with it, each citing its chunk.

    ``queries``: query_id, text.  ``passages``: query_id, chunk_id, passage.  Order: share of the
    sentence's words found in the query, then chunk and sentence; sentences that share none are left out.
    """
    rows = passages.select("query_id", "chunk_id", F.explode(marked_sentences(F.col("passage"))).alias("sentence"))
    bare = F.trim(F.regexp_replace("sentence", r"\s+", " "))
    rows = rows.withColumn("sentence", bare).filter(F.col("sentence").rlike(r"[.!?…]$") & ~F.col("sentence").startswith("#"))
    joined = rows.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    words = T.lexemes(F.col("sentence"))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, T.lexemes(F.col("query")))) / F.size(words)).otherwise(0.0)
    scored = joined.select("query_id", "chunk_id", "sentence", share.alias("share")).filter(F.col("share") > 0).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("share"), "chunk_id", "sentence")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def on_evidence(claim: Column, quote: Column) -> Column:
    """Containment either way, a final full stop aside, or a Jaccard index of at least 0.6."""
    a, b = F.rtrim(T.normalised(claim), F.lit(".")), F.rtrim(T.normalised(quote), F.lit("."))
    held = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    return held | (T.jaccard(claim, quote) >= 0.6)


def in_context(text: Column, quote: Column, margin: int = 220) -> Column:
    """The quote with its surroundings, marked, with ellipses where text is left out; null where it is absent."""
    at = F.instr(text, quote)
    begin = F.greatest(at - margin, F.lit(1))
    end = at + F.char_length(quote)
    before = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(text, begin, at - begin))
    after = F.concat(F.substring(text, end, F.lit(margin)), F.when(end + margin <= F.char_length(text), "…").otherwise(""))
    return F.when(at > 0, F.concat(before, F.lit("»"), quote, F.lit("«"), after))
