"""Cutting oversized texts at natural boundaries, with overlap (problem 6): recursive bisection.

A text longer than its limit is cut at the strongest boundary near its middle (blank line, then line
break, sentence end, clause mark, white space), and each half that is still longer than the limit less
the overlap is cut again.  Where nothing lies near the middle, the nearest boundary of the span is taken,
and only a span without any is cut at its middle (a hard cut).  Every piece but the first then starts at
least ``overlap`` characters earlier, at the start of a word where the limit leaves room for it, so no
piece passes the limit and joining the cores gives back the text.

A stretch without white space or end marks that is longer than the limit can only be divided by cuts
inside it, so what the cuts that stand at no natural boundary lie in tells whether a text is unbroken.

Only texts above the limit leave the JVM.  One Arrow pass, no shuffle; whole texts of any length.

Defined results: null or short texts are one piece or none and no case; a limit that is null or not
positive leaves the text whole; an overlap of half the limit or more is reduced to the largest value
under half the limit; repeated rows give equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import prepare

# Kinds of boundary from strong to weak; the cut falls after the match.
_BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”」』）]*"),
    re.compile(r"[;:,،；：，、]\s*(?=\s)\s+|[；：，、]"),
    re.compile(r"\s+"),
)
_STRETCH = re.compile(r"[^\s.!?…。！？]+")


def cut_stretch(text: str, cuts: list[int]) -> int:
    """Length of the longest stretch free of white space and of the marks . ! ? … 。 ！ ？ that a cut divides; 0 where none does."""
    longest = done = 0
    for at in sorted(cuts):
        if at < done:
            continue  # inside the stretch measured last
        right = _STRETCH.match(text, at)
        left = _STRETCH.match(text[done:at][::-1])
        if right and left:
            longest = max(longest, left.end() + right.end() - at)
            done = right.end()
        else:
            done = at
    return longest


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start, end, core_start, strength of the cut before it): strength 0 is a hard cut, 5 a blank line."""
    n = len(text)
    if limit is None or limit <= 0 or n <= limit:
        return [(0, n, 0, 6)] if n else []
    overlap = max(0, min(overlap or 0, (limit - 1) // 2))
    room = limit - overlap
    marks = [[m.end() for m in rx.finditer(text) if 0 < m.end() < n] for rx in _BOUNDARIES]
    cuts: dict[int, int] = {}
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        # the first piece gets no overlap, so it may fill the limit
        if hi - lo <= (limit if lo == 0 else room):
            continue
        middle = (lo + hi) // 2
        reach = max(1, min((hi - lo) // 4, hi - lo - 1))
        at, strength = middle, 0
        for level, places in enumerate(marks):
            k = bisect_left(places, middle)
            near = [p for p in places[max(0, k - 1) : k + 1] if lo < p < hi and abs(p - middle) <= reach]
            if near:
                at, strength = min(near, key=lambda p: (abs(p - middle), p)), 5 - level
                break
        else:
            # nothing near the middle: the nearest boundary of any kind inside the span
            far = [(abs(p - middle), p, level) for level, ps in enumerate(marks) for k in (bisect_left(ps, middle),) for p in ps[max(0, k - 1) : k + 1] if lo < p < hi]
            if far:
                _, at, level = min(far)
                strength = 5 - level
        cuts[at] = strength
        todo.append((lo, at))
        todo.append((at, hi))
    edges = [0, *sorted(cuts), n]
    words = marks[-1]  # places after white space

    def begin(core: int, end: int) -> int:
        """Start of the piece with its overlap, moved back to a word's start where the limit allows it."""
        start = max(0, core - overlap)
        if not overlap or not core or not start:
            return start
        k = bisect_left(words, start + 1) - 1
        near = words[k] if k >= 0 else 0
        return near if end - near <= limit else start

    return [(begin(a, b), b, a, cuts.get(a, 6)) for a, b in zip(edges, edges[1:], strict=False)]


_PIECES = "array<struct<start: int, end: int, core: int, strength: int>>"


def split_oversized(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every text longer than its limit.

    ``rows``: src, item_id, owner, text.  ``limits``: owner, target_chars, overlap_chars (one row per
    owner; the join is broadcast only where Spark knows the table to be small).
    Result: src, item_id, n_chars, target_chars, overlap_chars, pieces, hard_cuts, and longest, the longest
    stretch without natural boundary that a cut divides: every stretch above the limit is among them.
    """
    prepare(rows.sparkSession)
    plan = limits.groupBy("owner").agg(F.max("target_chars").alias("target_chars"), F.max("overlap_chars").alias("overlap_chars"))
    big = rows.join(plan, "owner").filter((F.col("target_chars") > 0) & (F.char_length("text") > F.col("target_chars")))
    big = big.select("src", "item_id", "text", "target_chars", "overlap_chars")
    item_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("core", pa.int32()), ("strength", pa.int32())]))
    names = ["src", "item_id", "n_chars", "target_chars", "overlap_chars", "pieces", "hard_cuts", "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            limit, overlap = b.column("target_chars").to_pylist(), b.column("overlap_chars").to_pylist()
            pieces = [bisect_text(t, n, o) for t, n, o in zip(texts, limit, overlap, strict=True)]
            longest = [cut_stretch(t, [p[2] for p in ps[1:]]) for t, ps in zip(texts, pieces, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("src"),
                    b.column("item_id"),
                    pa.array([len(t) for t in texts], pa.int32()),
                    b.column("target_chars"),
                    b.column("overlap_chars"),
                    pa.array([[dict(zip(("start", "end", "core", "strength"), p, strict=True)) for p in ps] for ps in pieces], item_type),
                    pa.array([sum(p[3] == 0 for p in ps) for ps in pieces], pa.int32()),
                    pa.array(longest, pa.int32()),
                ],
                names=names,
            )

    return big.mapInArrow(run, f"src string, item_id string, n_chars int, target_chars int, overlap_chars int, pieces {_PIECES}, hard_cuts int, longest int")
