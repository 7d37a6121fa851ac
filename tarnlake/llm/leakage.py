"""Evaluation passages that leak into documents (problem 8): a prefix-filtered set join with exact verification.

A document leaks an item where it holds at least ``share`` of the passage's words in one stretch with
at most one word in ``per_change`` changed.  Texts are read as words without case, accents, punctuation,
white space and markup.

Such a stretch holds an unchanged run of a length that follows from the words needed and the changes
allowed (``guaranteed_run``: six words from 18 needed words on, five from 10, four or fewer below).  So
shingles of five words, or of as many as the run has, lose nothing:

1. every document is read once, for all items: the places of its shingles that are in the items' filter
   (a bitmap of fixed size) are kept, and its words as hashes;
2. shingles are ordered by rarity, that is by the number of documents that hold them;
3. every unchanged run covers some window of neighbouring shingles of the item, so the window's rarest
   shingle is a prefix that must be shared; only these are joined, and candidates then pass bounds on
   length and on the places of the shared shingles;
4. exact containment is verified along the diagonals of the candidate, with room for words that were
   split or joined (a mark that slipped into a word, a lost apostrophe).  At least ``telling`` of the words
   of the stretch that tell this item from others (those of few items, counted over all items) must stand
   unchanged: where names and figures are all different, the text is on the same subject but does not hold
   the passage.

What is broadcast grows with the item table, never with the documents, and is bounded: candidates are
verified against blocks of at most ``block_items`` items and ``block_words`` words, over the documents that
share a shingle with any item.  Blocks change the work, not the rows.  Documents are never collected.

Defined results: null texts and passages without words leak nothing; repeated ids give one row; passages
equal in several items are reported for each item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.markup import extract
from tarnlake.session import checkpointed, prepare, spread

SHINGLE = 5
SHARE = 0.4
PER_CHANGE = 8
FEW_ITEMS = 0.02  # a word of at most this share of all items (or of three) tells items apart
TELLING = 0.5
MOST_BITS = 1 << 28  # size of the filter: 32 MB at most
_MARKED = re.compile(r"[<&`\[{$\\]|\*[^\s)]|__|~~|''")
_NOT_WORD = re.compile(r"[^\w\s]|_")
_MARKS = re.compile("[\u0300-\u036f]+")
_LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010]\n\s*(?=[^\W\d_])")


def folded_words(text: str) -> list[str]:
    """Words without case, accents and punctuation; markup and line-end hyphens aside."""
    if _MARKED.search(text):
        text = extract(text)[0]
    if "-\n" in text or "\u2010\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("\u0131", "i").replace("\u00df", "ss")
    return _NOT_WORD.sub(" ", text).split()


def needed(n_words: int, share: float = SHARE) -> int:
    """Words of the shortest stretch that counts."""
    return max(1, int(np.ceil(share * n_words - 1e-9)))


@lru_cache(maxsize=4096)
def guaranteed_run(m: int, per_change: int = PER_CHANGE) -> int:
    """Words of the unchanged run that every stretch of m or more words holds.

    n words with c changes hold a run of (n - c) / (c + 1) words.  A stretch of 2 m words or more falls into two
    of which one keeps to the bound, so lengths up to 2 m - 1 decide.
    """
    return min(-(-(n - n // per_change) // (n // per_change + 1)) for n in range(m, 2 * m))


class _Hashes(dict):
    """Word to 63-bit hash, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    get = _HASHES.__getitem__
    return np.fromiter(map(get, folded_words(text)), dtype=np.int64)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the shingle at each place."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def shingle_size(n_words: int, share: float = SHARE, per_change: int = PER_CHANGE) -> int:
    """Words of an item's shingles: five, or as many as its guaranteed run has."""
    return min(SHINGLE, guaranteed_run(needed(n_words, share), per_change))


def prefix_places(words: np.ndarray, held_by: np.ndarray, share: float = SHARE, per_change: int = PER_CHANGE) -> np.ndarray:
    """For each shingle of an item, whether it is a prefix: the rarest of some window that fits the guaranteed run.

    ``held_by`` is the number of documents that hold each shingle; ties go by hash and place.
    """
    size = shingle_size(len(words), share, per_change)
    h = shingle_hashes(words, size)
    width = guaranteed_run(needed(len(words), share), per_change) - size + 1
    chosen = np.ones(len(h), dtype=bool)
    if 1 < width < len(h):
        rank = np.empty(len(h), dtype=np.int64)
        rank[np.lexsort((h, held_by))] = np.arange(len(h))
        windows = np.lib.stride_tricks.sliding_window_view(rank, width)
        chosen[:] = False
        chosen[windows.argmin(axis=1) + np.arange(len(windows))] = True
    return chosen


class ItemIndex:
    """Words, shingles and prefixes of a block of items, given as (id, words, telling words, documents per shingle)."""

    def __init__(self, items: list[tuple], share: float = SHARE, per_change: int = PER_CHANGE) -> None:
        self.ids = [i for i, *_ in items]
        self.words = [np.asarray(w, dtype=np.int64) for _, w, _, _ in items]
        self.telling = [np.isin(w, np.asarray(t, dtype=np.int64)) for w, (_, _, t, _) in zip(self.words, items, strict=True)]
        self.needed = [needed(len(w), share) for w in self.words]
        hashes = [shingle_hashes(w, shingle_size(len(w), share, per_change)) for w in self.words]
        prefix = [prefix_places(w, np.asarray(n, dtype=np.int64), share, per_change) for w, (_, _, _, n) in zip(self.words, items, strict=True)]
        sizes = [len(h) for h in hashes]
        flat = np.concatenate([np.zeros(0, np.int64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])[order]
        self.prefix = np.concatenate([np.zeros(0, bool), *prefix])[order]


def _told_apart(doc: np.ndarray, item: np.ndarray, telling: np.ndarray, least: float = TELLING) -> bool:
    """At least the given share of the stretch's telling words stand in the document's part."""
    mine = item[telling]
    return int(np.isin(mine, doc).sum()) >= least * len(mine)


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, per_change: int = PER_CHANGE, least: int = 1) -> tuple[int, int, int, int]:
    """Longest stretch on the given diagonals: (words, changes, place in the document, place in the item).

    Diagonals whose matches cannot make ``least`` words are passed over.

    A word that is split or joined in the document counts as changed and moves the rest to a neighbouring
    diagonal, so besides each diagonal the best path over the diagonals around it is tried.
    """
    best = (0, 0, 0, 0)
    n_item, n_doc = len(item), len(doc)
    for d in diagonals.tolist():
        lo, hi = max(0, -d), min(n_item, n_doc - d)
        if hi - lo > best[0]:
            same = doc[lo + d : hi + d] == item[lo:hi]
            if int(same.sum()) * per_change >= least * (per_change - 1):
                best = max(best, _longest(same, lo, np.arange(lo, hi) + d, per_change), key=lambda x: x[0])
    band = np.arange(-SHIFT, SHIFT + 1)
    for d in diagonals.tolist():
        at = np.arange(n_item)[None, :] + (d + band)[:, None]
        inside = (at >= 0) & (at < n_doc)
        same = np.zeros(at.shape, dtype=bool)
        same[inside] = doc[at[inside]] == np.broadcast_to(item, at.shape)[inside]
        # no path can hold more words than have a match on some diagonal
        reached = int(same.any(axis=0).sum())
        if reached * per_change < least * (per_change - 1) or reached * per_change <= best[0] * (per_change - 1) or same[SHIFT].sum() == reached:
            continue
        path = _best_path(same)
        along = same[path, np.arange(n_item)]
        places = np.clip(at[path, np.arange(n_item)], 0, max(0, n_doc - 1))
        best = max(best, _longest(along, 0, places, per_change), key=lambda x: x[0])
    return best


SHIFT = 2  # words by which a stretch may move off its diagonal


def _longest(same: np.ndarray, first: int, places: np.ndarray, per_change: int) -> tuple[int, int, int, int]:
    """Longest run with at most one change in per_change words: (words, changes, place in the document, place in the item).

    A match scores 1 and a change 1 - per_change, so a run keeps to the bound exactly where its sum is not
    negative; for each end the earliest start whose prefix sum is no higher gives the longest one.
    """
    if not len(same):
        return (0, 0, 0, 0)
    prefix = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - per_change))))
    low = np.minimum.accumulate(prefix)
    length = np.arange(len(prefix)) - np.searchsorted(-low, -prefix, side="left")
    end = int(length.argmax())
    n = int(length[end])
    if not n:
        return (0, 0, 0, 0)
    a = end - n
    return (n, int(n - same[a:end].sum()), int(places[a]), first + a)


def _best_path(same: np.ndarray) -> np.ndarray:
    """Diagonal of each item word on the path with most matches; a change of diagonal costs its word."""
    k, n = same.shape
    score = np.zeros(k, dtype=np.int64)
    back = np.empty((n, k), dtype=np.int64)
    stay = np.arange(k)
    for i in range(n):
        top = int(score.argmax())
        jump = score[top] > score + same[:, i]
        back[i] = np.where(jump, top, stay)
        score = np.where(jump, score[top], score + same[:, i])
    path = np.empty(n, dtype=np.int64)
    at = int(score.argmax())
    for i in range(n - 1, -1, -1):
        path[i] = at
        at = int(back[i, at])
    return path


def _item_words(items: DataFrame) -> DataFrame:
    """item_id and words (as hashes) of every passage that has words; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(w := word_hashes(p))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.int64()))], names=["item_id", "words"])

    listed = items.filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    return listed.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").distinct().mapInArrow(run, "item_id bigint, words array<bigint>")


def _shingled(items: DataFrame, share: float, per_change: int) -> DataFrame:
    """item_id, n_words, place, size and h of every shingle of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w.values.to_numpy(zero_copy_only=False) for w in b.column("words")]
            sizes = [shingle_size(len(w), share, per_change) for w in words]
            hashes = [shingle_hashes(w, k) for w, k in zip(words, sizes, strict=True)]
            n = [len(h) for h in hashes]
            index = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("item").take(pa.array(index)),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *(np.arange(x) for x in n)]), pa.int32()),
                    pa.array(np.repeat(np.array(sizes, dtype=np.int32), n), pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]), pa.int64()),
                ],
                names=["item", "place", "size", "h"],
            )

    return items.select("item", "words").mapInArrow(run, "item bigint, place int, size int, h bigint")


def _filter_of(shingles: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the items' shingle hashes, about 16 bits to a shingle and MOST_BITS at most, and the sizes in use."""
    seen = shingles.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # sizes are 1 to 5
    bits = min(MOST_BITS, max(1 << 16, 1 << int(16 * (seen["n"] or 0)).bit_length()))
    at = F.pmod("h", F.lit(bits))
    words = shingles.select(F.shiftright(at, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}L) % 64 as int))").alias("bit"))
    filled = words.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows of two numbers
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[filled.column("slot").to_numpy()] = filled.column("bits").to_numpy()
    return bitmap.view(np.uint64), sorted(seen["sizes"] or [])


def _in_filter(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = hashes & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _match_documents(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """Documents that hold a shingle of the items' filter: doc_id, words, places, hashes.  The one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, used = shared.value
        for batch in batches:
            ids, words, places, hashes = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                w = word_hashes(text)
                found = []
                for size in used:
                    h = shingle_hashes(w, size)
                    at = np.flatnonzero(_in_filter(h, bits))
                    if len(at):
                        found.append((at, h[at]))
                if found:
                    ids.append(doc_id)
                    words.append(w)
                    places.append(np.concatenate([x for x, _ in found]).astype(np.int32))
                    hashes.append(np.concatenate([x for _, x in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(words, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "words", "places", "hashes"],
            )

    return docs.mapInArrow(run, "doc_id bigint, words array<bigint>, places array<int>, hashes array<bigint>")


def _prepared(items: DataFrame, shingles: DataFrame, matched: DataFrame) -> DataFrame:
    """Every item with its telling words and the number of documents that hold each of its shingles."""
    total = items.agg(F.count_distinct("item_id").alias("n")).first()["n"]
    each = items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("word"))
    few = each.groupBy("word").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") <= max(3, int(FEW_ITEMS * total)))
    telling = each.join(few.select("word"), "word", "left_semi").groupBy("item").agg(F.collect_list("word").alias("telling"))
    held = matched.select(F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = shingles.join(held, "h", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    rows = items.join(telling, "item", "left").join(counts, "item", "left")
    none = F.array().cast("array<bigint>")
    return rows.select("item", "item_id", "words", F.coalesce("telling", none).alias("telling"), F.coalesce(F.col("c.n"), none).alias("held_by"))


def _verify(matched: DataFrame, index: ItemIndex, per_change: int, telling: float) -> DataFrame:
    shared = matched.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c) for c in ("doc_id", "words", "places", "hashes")]
            for doc_id, w, p, h in zip(columns[0].to_pylist(), *(c for c in columns[1:]), strict=True):
                doc = w.values.to_numpy(zero_copy_only=False)
                places = p.values.to_numpy(zero_copy_only=False).astype(np.int64)
                hashes = h.values.to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(idx.hashes, hashes, "left"), np.searchsorted(idx.hashes, hashes, "right")
                count = hi - lo
                if not count.any():
                    continue
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                item, diagonal = idx.owner[at], np.repeat(places, count) - idx.place[at]
                # the join: only prefix shingles make candidates
                for c in np.unique(item[idx.prefix[at]]).tolist():
                    words, m = idx.words[c], idx.needed[c]
                    if len(doc) < m:
                        continue  # length bound
                    # bound by place: there is room for m words around the shared shingle
                    diagonals = np.unique(diagonal[item == c])
                    room = np.minimum(len(words), len(doc) - diagonals) - np.maximum(0, -diagonals)
                    diagonals = diagonals[room + SHIFT >= m]
                    if not len(diagonals):
                        continue
                    n, changes, start, begin = best_stretch(doc, words, diagonals, per_change, m)
                    if n >= m and _told_apart(doc[max(0, start - SHIFT) : start + n + SHIFT], words[begin : begin + n], idx.telling[c][begin : begin + n], telling):
                        rows.append((doc_id, idx.ids[c], n, changes, start, n / len(words)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "item_id", "words", "changes", "start_word", "share"],
            )

    return matched.mapInArrow(run, "doc_id bigint, item_id bigint, words int, changes int, start_word int, share double")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    per_change: int = PER_CHANGE,
    telling: float = TELLING,
    block_items: int = 20_000,
    block_words: int = 2_000_000,
) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, words, changes, start_word, share.

    ``docs``: doc_id, text.  ``items``: item_id, passage; read block by block, so the driver holds at
    most block_items passages and about block_words words at a time.  ``telling`` 0 asks for words and changes only.
    """
    prepare(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    listed = checkpointed(_item_words(items).withColumn("item", F.monotonically_increasing_id()))
    shingles = _shingled(listed, share, per_change)
    bitmap, sizes = _filter_of(shingles)
    matched = checkpointed(_match_documents(docs, bitmap, sizes))
    result: DataFrame | None = None
    block: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal result, block, size
        part = _verify(matched, ItemIndex(block, share, per_change), per_change, telling)
        result = part if result is None else result.unionByName(part)
        block, size = [], 0

    for row in _prepared(listed, shingles, matched).sort("item_id", "item").toLocalIterator():
        block.append((row["item_id"], row["words"], row["telling"], row["held_by"]))
        size += len(row["words"])
        if len(block) >= block_items or size >= block_words:
            close()
    if block or result is None:
        close()
    best = F.max_by(F.struct("words", "changes", "start_word", "share"), F.struct("words", -F.col("changes"), -F.col("start_word"))).alias("m")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")
