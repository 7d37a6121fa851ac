"""Sentence alignment in bilingual articles (problem 3).

1. Sentences are numbered through the paragraphs of each article; articles that stand in one language
   only drop out in the join of both sides.
2. A first alignment by length: dynamic programming over one-to-one, merged, added and omitted
   sentences with a length-ratio cost; one-to-one links whose figures agree are the confident pairs.
3. Word-translation probabilities are trained on all confident pairs with expectation-maximisation
   (the first IBM model), as joins and group-bys over the pairs' word links; nothing is sampled and the
   table is never broadcast.
4. Each article gets the part of the table its own words need, by joins; lexical scores then drive a
   second dynamic programme, and sentences it leaves over are paired across the order where both sides
   agree.

Defined results: repeated rows count once; null or empty paragraphs hold no sentence; a null title
changes nothing; articles with several different rows in one language keep the first by content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import checkpointed, prepare, spread

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WORDS = r"(?U)[\p{L}\p{N}]+(?:[.,]\p{N}+)*"
_PARAGRAPH_NO = re.compile(r"^\(\d+\)\s*")
ROUNDS = 4
LEAST = 0.55  # similarity of a link that counts
PART = 0.75  # coverage of a sentence that is merged into a longer one
KEEP = 0.02  # translations below this probability are dropped
MOST_ENTRIES = 300_000  # translations that may be broadcast


def article_sentences(articles: DataFrame, lang: str) -> DataFrame:
    """prefix, article_key and the array of sentences of one language."""
    own = articles.filter((F.col("lang") == lang) & F.col("paragraphs").isNotNull() & F.col("prefix").isNotNull() & F.col("article_key").isNotNull())
    one = own.groupBy("prefix", "article_key").agg(F.min("paragraphs").alias("paragraphs"))
    pieces = F.flatten(F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), lambda p: F.split(F.trim(p), r"(?<=\.)\s+")))
    return one.select("prefix", "article_key", F.filter(pieces, lambda s: F.length(F.trim(s)) > 0).alias(f"{lang}_sents"))


def paired_articles(articles: DataFrame, left: str = "tr", right: str = "en") -> DataFrame:
    return article_sentences(articles, left).join(article_sentences(articles, right), ["prefix", "article_key"])


def _figures(sentence: str) -> set[str]:
    return {re.sub("[.,]", "", x) for x in _NUMBER.findall(_PARAGRAPH_NO.sub("", sentence))}


def _length_cost(a: int, b: int, ratio: float) -> float:
    """Cost of pairing a and b characters: squared deviation from the ratio, in units of its spread."""
    if a == 0 and b == 0:
        return 0.0
    mean = (a * ratio + b) / 2
    return min(12.0, (b - a * ratio) ** 2 / (6.8 * max(mean, 1.0)) / 2)


# Costs of the kinds of links (left sentences, right sentences).
_BEADS = {(1, 1): 0.1, (1, 0): 4.5, (0, 1): 4.5, (2, 1): 2.4, (1, 2): 2.4}


def align_by_length(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Confident one-to-one links (0-based) from lengths and figures."""
    la, lb = [len(_PARAGRAPH_NO.sub("", s)) for s in left], [len(_PARAGRAPH_NO.sub("", s)) for s in right]
    fa, fb = [_figures(s) for s in left], [_figures(s) for s in right]
    n, m = len(left), len(right)
    ratio = sum(lb) / max(1, sum(la))
    best = np.full((n + 1, m + 1), np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if not np.isfinite(best[i, j]):
                continue
            for (da, db), base in _BEADS.items():
                if i + da > n or j + db > m:
                    continue
                cost = base
                if da and db:
                    a, b = set().union(*fa[i : i + da]), set().union(*fb[j : j + db])
                    cost += _length_cost(sum(la[i : i + da]), sum(lb[j : j + db]), ratio) + 3.0 * len(a ^ b) - 3.0 * len(a & b)
                if best[i, j] + cost < best[i + da, j + db]:
                    best[i + da, j + db] = best[i, j] + cost
                    back[i + da, j + db] = (i, j)
    links = []
    i, j = n, m
    while (i, j) != (0, 0):
        pi, pj = back[i, j]
        if i - pi == 1 and j - pj == 1 and fa[pi] == fb[pj] and 0.45 < (lb[pj] + 5) / (la[pi] * ratio + 5) < 2.2:
            links.append((pi, pj))
        i, j = pi, pj
    return links[::-1]


def confident_pairs(pairs: DataFrame, left: str = "tr", right: str = "en") -> DataFrame:
    """left_sent and right_sent texts of the confident one-to-one links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_out, b_out = [], []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, j in align_by_length(x, y):
                    a_out.append(x[i])
                    b_out.append(y[j])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.string()), pa.array(b_out, pa.string())], names=["left_sent", "right_sent"])

    return pairs.select(f"{left}_sents", f"{right}_sents").mapInArrow(run, "left_sent string, right_sent string")


def _tokens(column: str):  # noqa: ANN202
    bare = F.regexp_replace(F.lower(F.col(column)), r"^\(\d+\)\s*", "")
    words = F.array_distinct(F.regexp_extract_all(bare, F.lit(_WORDS), F.lit(0)))
    return F.filter(words, lambda w: ~w.rlike(r"^\d"))  # figures are compared as such


def train_translations(confident: DataFrame, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """e (left word), f (right word), p: symmetric translation strength.

    Equal sentence pairs are counted before their words are linked.  Each round is one join and two
    aggregations over the links; weak translations are dropped after the first round.
    """
    counted = (
        confident.select(F.array_sort(_tokens("left_sent")).alias("es"), F.array_sort(_tokens("right_sent")).alias("fs"))
        .filter((F.size("es") > 0) & (F.size("fs") > 0))
        .groupBy("es", "fs")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pair", F.xxhash64("es", "fs"))
    )
    links = counted.select("pair", "n", F.explode("es").alias("e"), "fs").select("pair", "n", "e", F.explode("fs").alias("f"))
    links = checkpointed(links)
    # the first round from equal probabilities needs no table
    counts = counted.select("n", F.explode("es").alias("e"), "fs").select(
        "e", F.explode("fs").alias("f"), (F.col("n") / F.size("fs")).alias("c")
    )
    counts = counts.groupBy("e", "f").agg(F.sum("c").alias("c"))
    for turn in range(rounds):
        # totals by aggregation and join, not by a window: a frequent word may meet the whole vocabulary
        totals = counts.groupBy("f").agg(F.sum("c").alias("c_f"))
        table = counts.join(totals, "f").select("e", "f", (F.col("c") / F.col("c_f")).alias("t")).filter(F.col("t") > (keep / 4 if turn == 0 else keep / 8))
        if turn == rounds - 1:
            break
        joined = links.join(table, ["e", "f"])
        per_word = Window.partitionBy("pair", "e")
        counts = joined.withColumn("c", F.col("n") * F.col("t") / F.sum("t").over(per_word)).groupBy("e", "f").agg(F.sum("c").alias("c"))
        counts = checkpointed(counts)
    total_e = counts.groupBy("e").agg(F.sum("c").alias("c_e"))
    total_f = counts.groupBy("f").agg(F.sum("c").alias("c_f"))
    both = counts.join(total_e, "e").join(total_f, "f").withColumn("p", F.col("c") / F.sqrt(F.col("c_e") * F.col("c_f")))
    return both.filter(F.col("p") > keep).select("e", "f", "p")


def _score_words(sentence: str) -> tuple[list[str], set[str]]:
    bare = _PARAGRAPH_NO.sub("", sentence.lower())
    words = [w for w in dict.fromkeys(re.findall(r"[^\W_]+(?:[.,]\d+)*", bare)) if not w[0].isdigit()]
    return words, _figures(sentence)


def score_matrix(
    left: list[str], right: list[str], lexicon: dict[str, dict[str, float]], best_l: dict[str, float], best_r: dict[str, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Coverage of each left sentence by each right one and the reverse, both [left, right].

    What a word gives is measured against the strongest translation it has anywhere (best_l, best_r), and
    a word counts by how well it tells the sentences of its own article apart.  Figures count as words
    that only equal figures cover.
    """
    lw, rw = [_score_words(s) for s in left], [_score_words(s) for s in right]

    def table_of(side: list[tuple[list[str], set[str]]], part: int, best: dict[str, float]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Place of each word (or figure), its weight, and which sentence holds which."""
        held: dict[str, int] = {}
        for sentence in side:
            for w in sentence[part]:
                held[w] = held.get(w, 0) + 1
        place = {w: k for k, w in enumerate(sorted(held))}
        n = len(side)
        # words without a clear translation tell little
        weight = np.array([math.log(1.3 + n / held[w]) * (1.0 if w[0].isdigit() else min(1.0, 4 * best.get(w, 0.0))) for w in place])
        member = np.zeros((n, len(place)), dtype=bool)
        for i, sentence in enumerate(side):
            member[i, [place[w] for w in sentence[part]]] = True
        return place, weight, member

    words_l, weight_l, in_l = table_of(lw, 0, best_l)
    words_r, weight_r, in_r = table_of(rw, 0, best_r)
    figures_l, fig_weight_l, fig_l = table_of(lw, 1, best_l)
    figures_r, fig_weight_r, fig_r = table_of(rw, 1, best_r)
    given = np.zeros((len(words_l), len(words_r)))
    for e, k in words_l.items():
        for f, q in lexicon.get(e, {}).items():
            if f in words_r:
                given[k, words_r[f]] = q
    strongest_l = np.array([best_l.get(w, 1.0) for w in words_l])
    strongest_r = np.array([best_r.get(w, 1.0) for w in words_r])
    got, back = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    if given.any():
        for j in range(len(right)):
            top = given[:, in_r[j]].max(axis=1, initial=0.0)
            got[:, j] = in_l @ (weight_l * np.minimum(1.0, 1.4 * top / strongest_l))
        for i in range(len(left)):
            reached = given[in_l[i]].max(axis=0, initial=0.0)
            back[i] = in_r @ (weight_r * np.minimum(1.0, 1.4 * reached / strongest_r))
    both = [w for w in figures_l if w in figures_r]
    at_l, at_r = [figures_l[w] for w in both], [figures_r[w] for w in both]
    same_l = (fig_l[:, at_l] * fig_weight_l[at_l]) @ fig_r[:, at_r].T.astype(float) if both else 0.0
    same_r = fig_l[:, at_l].astype(float) @ (fig_r[:, at_r] * fig_weight_r[at_r]).T if both else 0.0
    lexical_l = in_l @ weight_l
    total_l = lexical_l + 1.5 * (fig_l @ fig_weight_l)
    total_r = in_r @ weight_r + 1.5 * (fig_r @ fig_weight_r)
    # equal figures alone may be chance: without words to bear them out they count half
    bare = np.where((lexical_l[:, None] > 0) & (got < 0.2 * lexical_l[:, None]), 0.5, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cover_l = np.where(total_l[:, None] > 0, bare * (got + 1.5 * same_l) / total_l[:, None], 0.0)
        cover_r = np.where(total_r[None, :] > 0, bare * (back + 1.5 * same_r) / total_r[None, :], 0.0)
    return cover_l, cover_r


def align_lexically(
    left: list[str],
    right: list[str],
    lexicon: dict[str, dict[str, float]],
    best_l: dict[str, float],
    best_r: dict[str, float],
    least: float = LEAST,
) -> list[tuple[int, int]]:
    """Pairs (0-based) of sentences that share content, reordering and merges included."""
    n, m = len(left), len(right)
    if not n or not m:
        return []
    cl, cr = score_matrix(left, right, lexicon, best_l, best_r)
    sim = np.sqrt(np.maximum(cl, 0) * np.maximum(cr, 0))
    part_l, part_r = np.maximum(cl, 0), np.maximum(cr, 0)
    # dynamic programme: gain of a link is its similarity above the least one that counts
    best = np.full((n + 1, m + 1), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(n + 1):
        for j in range(m + 1):
            here = best[i, j]
            if here == -np.inf:
                continue
            moves = [(i + 1, j, 0.0), (i, j + 1, 0.0)]
            if i < n and j < m:
                moves.append((i + 1, j + 1, sim[i, j] - least))
            if i + 1 < n and j < m:  # two left sentences merged into one right one
                moves.append((i + 2, j + 1, part_l[i, j] + part_l[i + 1, j] - 2 * (least + 0.1)))
            if i < n and j + 1 < m:
                moves.append((i + 1, j + 2, part_r[i, j] + part_r[i, j + 1] - 2 * (least + 0.1)))
            for a, b, gain in moves:
                if a <= n and b <= m and here + gain > best[a, b] + 1e-12:
                    best[a, b] = here + gain
                    back[a, b] = (i, j)
    links: set[tuple[int, int]] = set()
    i, j = n, m
    while (i, j) != (0, 0):
        pi, pj = back[i, j]
        if i > pi and j > pj:
            for x in range(pi, i):
                for y in range(pj, j):
                    links.add((x, y))
        i, j = pi, pj
    # a merged link stays only where each part has its own share of the content
    for x, y in sorted(links):
        if sim[x, y] < least and max(part_l[x, y], part_r[x, y]) < PART:
            links.discard((x, y))
    # across the order: better partners than the programme could give, mutually best first
    strength = np.maximum(np.minimum(cl, cr), sim)
    order = sorted(((strength[x, y], x, y) for x in range(n) for y in range(m)), reverse=True)
    used_l, used_r = {x for x, _ in links}, {y for _, y in links}
    for s, x, y in order:
        if s < least:
            break
        weak_l = all(strength[x, b] < 0.75 * s for a, b in links if a == x)
        weak_r = all(strength[a, y] < 0.75 * s for a, b in links if b == y)
        if (x, y) in links or not (weak_l and weak_r):
            continue
        for a, b in [lk for lk in links if lk[0] == x or lk[1] == y]:
            links.discard((a, b))
        links.add((x, y))
        used_l, used_r = {a for a, _ in links}, {b for _, b in links}
    # what is left over may be part of a merged sentence elsewhere
    for x in range(n):
        if x not in used_l and m:
            y = int(part_l[x].argmax())
            if part_l[x, y] >= PART:
                links.add((x, y))
    for y in range(m):
        if y not in used_r and n:
            x = int(part_r[:, y].argmax())
            if part_r[x, y] >= PART:
                links.add((x, y))
    return sorted(links)


def _aligned(sentences_a: list[str], sentences_b: list[str], table: dict, best_l: dict, best_r: dict) -> list[tuple[int, int]]:
    return [(i + 1, j + 1) for i, j in align_lexically(sentences_a or [], sentences_b or [], table, best_l, best_r)]


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
        names=["prefix", "article_key", "left_no", "right_no"],
    )


_PAIR_SCHEMA = "prefix string, article_key string, left_no int, right_no int"


def _align_with_all(pairs: DataFrame, lexicon: DataFrame, left: str, right: str) -> DataFrame:
    """Alignment with the whole table of translations at hand in every task; no shuffle."""
    found = lexicon.toArrow()  # its size was checked
    shared = pairs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, dict[str, float]] = {}
        best_l: dict[str, float] = {}
        best_r: dict[str, float] = {}
        for e, f, p in zip(*(shared.value.column(c).to_pylist() for c in ("e", "f", "p")), strict=True):
            table.setdefault(e, {})[f] = p
            best_l[e] = max(p, best_l.get(e, 0.0))
            best_r[f] = max(p, best_r.get(f, 0.0))
        for batch in batches:
            yield _pair_rows([(k, n, *link) for k, n, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for link in _aligned(a, b, table, best_l, best_r)])

    return pairs.select("prefix", "article_key", f"{left}_sents", f"{right}_sents").mapInArrow(run, _PAIR_SCHEMA)


def _align_with_local(pairs: DataFrame, lexicon: DataFrame, left: str, right: str) -> DataFrame:
    """Alignment where each article is joined with the part of the table that its words need."""
    key = ["prefix", "article_key"]
    left_words = pairs.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(f"{left}_sents", lambda s: _word_list(s))))).alias("e"))
    right_words = pairs.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(f"{right}_sents", lambda s: _word_list(s))))).alias("f"))
    best_e, best_f = lexicon.groupBy("e").agg(F.max("p").alias("p")), lexicon.groupBy("f").agg(F.max("p").alias("p"))
    none = F.lit(None).cast("string")
    local = left_words.join(lexicon, "e").join(right_words, [*key, "f"]).select(*key, "e", "f", "p")
    left_best = left_words.join(best_e, "e").select(*key, "e", none.alias("f"), "p")
    right_best = right_words.join(best_f, "f").select(*key, none.alias("e"), "f", "p")
    local = local.unionByName(left_best).unionByName(right_best)
    local = local.groupBy(*key).agg(F.collect_list(F.struct("e", "f", "p")).alias("lexicon"))
    ready = pairs.join(local, key, "left").select(*key, F.col(f"{left}_sents").alias("a"), F.col(f"{right}_sents").alias("b"), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for prefix, article, a, b, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table: dict[str, dict[str, float]] = {}
                best_l = {x["e"]: x["p"] for x in entries or () if x["f"] is None}
                best_r = {x["f"]: x["p"] for x in entries or () if x["e"] is None}
                for x in entries or ():
                    if x["e"] is not None and x["f"] is not None:
                        table.setdefault(x["e"], {})[x["f"]] = x["p"]
                rows.extend((prefix, article, *link) for link in _aligned(a, b, table, best_l, best_r))
            yield _pair_rows(rows)

    return ready.mapInArrow(run, _PAIR_SCHEMA)


def align_articles(articles: DataFrame, left: str = "tr", right: str = "en", rounds: int = ROUNDS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """prefix, article_key, left_no, right_no: numbers from 1 of sentences that share content.

    The table of translations is broadcast where a count shows at most ``most_entries`` pairs of words; beyond that each
    article is joined with the part it needs.  Both ways give the same rows.
    """
    prepare(articles.sparkSession)
    pairs = checkpointed(paired_articles(articles, left, right))
    lexicon = checkpointed(train_translations(confident_pairs(pairs, left, right), rounds))
    small = lexicon.limit(most_entries + 1).count() <= most_entries
    return (_align_with_all if small else _align_with_local)(spread(pairs), lexicon, left, right)


def _word_list(sentence):  # noqa: ANN001, ANN202
    bare = F.regexp_replace(F.lower(sentence), r"^\(\d+\)\s*", "")
    return F.regexp_extract_all(bare, F.lit(_WORDS), F.lit(0))
