"""Queries of the text and ranking problems over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import alignment, language, leakage, markup, mixing, quality, ranking, sentences, splitting
from tarnlake.session import checkpointed, read, spread


def _language_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    messages = read(spark, sf, "ingest_messages").select(F.lit("message").alias("src"), F.col("job_id").alias("item_id"), "lang", "text")
    queries = read(spark, sf, "eval_queries").select(F.lit("query").alias("src"), F.col("query_id").alias("item_id"), "lang", "text")
    documents = read(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("item_id"), "lang", "text")
    model = language.fit_model(spark, [read(spark, sf, "documents").select("text", "lang"), read(spark, sf, "ingest_messages").select("text", "lang")])
    short = language.detect_languages(spread(messages.unionByName(queries)), model, segments=False)  # messages and queries are single texts
    whole = language.detect_languages(spread(documents), model, judge_prose=True)
    return short, whole


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a missing or false label, and the paragraphs of documents in several languages."""
    short, whole = _language_rows(spark, sf)
    cases = language.language_cases(short).unionByName(language.language_cases(whole).filter(F.col("kind") == "prose"))
    return cases.select("src", "item_id", "seg_no", F.col("detected").alias("lang")).dropDuplicates(["src", "item_id", "seg_no"])


def p1_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every message, query and document, or of its paragraphs."""
    short, whole = _language_rows(spark, sf)
    rows = short.unionByName(whole).dropDuplicates(["src", "item_id", "seg_no"])
    return rows.select("src", "item_id", "seg_no", F.col("detected").alias("lang"), F.round("confidence", 6).alias("confidence"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence pairs of articles that stand in Turkish and English."""
    pairs = alignment.align_articles(read(spark, sf, "articles"))
    return pairs.select("prefix", "article_key", F.col("left_no").alias("tr_sent"), F.col("right_no").alias("en_sent"))


def _chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "ranked_chunks").select("query_id", "arm", "chunk_id", "score")


def _claim_scores(spark: SparkSession, sf: str) -> DataFrame:
    records = read(spark, sf, "response_records").filter(F.size("claims") >= 3)
    variants = F.array_distinct(F.flatten(F.transform("claims", lambda c: F.coalesce(F.map_keys(c["scores"]), F.array().cast("array<string>")))))
    claims = records.select("query_id", variants.alias("variants"), F.posexplode("claims").alias("pos", "claim"))
    each = claims.select("query_id", (F.col("pos") + 1).cast("string").alias("claim_no"), F.col("claim.scores").alias("scores"), F.explode("variants").alias("arm"))
    return each.select("query_id", "arm", "claim_no", F.try_element_at("scores", F.col("arm")).alias("score"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """First chunks of each query and first claim of each response, by Borda count over all arms."""
    chunks = ranking.borda_ranking(_chunk_scores(spark, sf), ["query_id"], "chunk_id")
    first = F.least(F.lit(3), F.greatest(F.lit(1), F.col("n_items") - 4))
    best_chunks = ranking.top_items(chunks, ["query_id"], "chunk_id", first)
    claims = ranking.borda_ranking(_claim_scores(spark, sf), ["query_id"], "claim_no")
    best_claims = ranking.top_items(claims, ["query_id"], "claim_no", 1)
    return best_chunks.select(F.lit("chunk").alias("src"), "query_id", F.col("chunk_id").alias("item")).unionByName(
        best_claims.select(F.lit("claim").alias("src"), "query_id", F.col("claim_no").alias("item"))
    )


def p4_chunk_points(spark: SparkSession, sf: str) -> DataFrame:
    """Borda points of every chunk of every query."""
    ranked = ranking.borda_ranking(_chunk_scores(spark, sf), ["query_id"], "chunk_id")
    return ranked.select("query_id", "chunk_id", F.round("points", 6).alias("points"), F.col("n_items").cast("bigint").alias("n_items"), F.col("arms_present").cast("bigint").alias("arms_present"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every answer (claim 0) and claim."""
    records = read(spark, sf, "response_records")
    answers = records.select("query_id", F.lit(0).alias("claim_no"), F.col("answer").alias("text"))
    claims = records.select("query_id", F.posexplode("claims").alias("pos", "claim")).select(
        "query_id", (F.col("pos") + 1).alias("claim_no"), F.col("claim.text").alias("text")
    )
    return sentences.sentence_units(answers.unionByName(claims)).dropDuplicates(["query_id", "claim_no", "start_pos", "end_pos"])


def _oversized(spark: SparkSession, sf: str) -> DataFrame:
    limits = read(spark, sf, "chunk_configs").select(F.col("tenant_id").alias("owner"), "target_chars", "overlap_chars")
    documents = read(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("owner"), "text")
    chunks = read(spark, sf, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("item_id"), F.col("tenant_id").alias("owner"), "text")
    return splitting.split_oversized(spread(documents.unionByName(chunks)), limits)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts above their limit, with 1 where the cuts fall into a stretch longer than the limit without natural boundary."""
    rows = _oversized(spark, sf)
    return rows.select("src", "item_id", (F.col("longest") > F.col("target_chars")).cast("int").alias("unbroken")).dropDuplicates(["src", "item_id"])


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every oversized text: place, and strength of the cut before each piece."""
    rows = _oversized(spark, sf).dropDuplicates(["src", "item_id"])
    pieces = rows.select("src", "item_id", F.posexplode("pieces").alias("piece_no", "p"))
    return pieces.select("src", "item_id", "piece_no", F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"), F.col("p.core").alias("core_pos"), F.col("p.strength").alias("strength"))


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces of every oversized text: within the limit, overlapping as asked, and whole when joined."""
    rows = _oversized(spark, sf).dropDuplicates(["src", "item_id"])
    after = F.slice("pieces", F.lit(2), F.size("pieces") - 1)
    asked = F.greatest(F.lit(0), F.least(F.coalesce("overlap_chars", F.lit(0)), F.floor((F.col("target_chars") - 1) / 2)))
    joined = F.forall(F.arrays_zip(F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("a"), after.alias("b")), lambda p: p["a"]["end"] == p["b"]["core"])
    first, last = F.element_at("pieces", 1), F.element_at("pieces", -1)
    return rows.select(
        "src",
        "item_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.forall("pieces", lambda p: (p["end"] > p["core"]) & (p["end"] - p["start"] <= F.col("target_chars"))).alias("within_limit"),
        F.forall(after, lambda p: p["core"] - p["start"] >= F.least(asked, p["core"])).alias("overlapping"),
        (joined & (first["start"] == 0) & (first["core"] == 0) & (last["end"] == F.col("n_chars"))).alias("whole"),
    )


def _markup_rows(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("item_id"), F.col("source").alias("host"), "text")
    sections = read(spark, sf, "sections").select(
        F.lit("section").alias("src"),
        F.col("section_id").alias("item_id"),
        F.regexp_extract("page_slug", r"^([^-]*)", 1).alias("host"),
        F.concat_ws("\n", "heading", "body").alias("text"),
    )
    return documents.unionByName(sections)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of markup in every document and section."""
    cleaned = markup.clean_markup(_markup_rows(spark, sf))
    return cleaned.select("src", "item_id", F.explode("kinds").alias("kind")).dropDuplicates(["src", "item_id", "kind"])


def p7_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of every document and section."""
    cleaned = markup.clean_markup(_markup_rows(spark, sf)).dropDuplicates(["src", "item_id"])
    return cleaned.select("src", "item_id", F.array_join("kinds", ",").alias("kinds"), F.col("clean").alias("clean_text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a test item's passage, in whole or in part."""
    return p8_leaks(spark, sf).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the stretch held: words, changed words, share of the passage."""
    found = leakage.find_leaks(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "test_items").select("item_id", "passage"))
    return found.select("doc_id", "item_id", "words", "changes", F.round("share", 6).alias("share"))


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.count_tokens(read(spark, sf, "documents").select("doc_id", "source", "text"))


def _drawn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Demand of every source of every mix, and the drawn copies with their positions."""
    counted = checkpointed(_counted(spark, sf))  # ids and numbers, no texts
    totals = checkpointed(mixing.source_totals(counted))  # a row per source
    demand = checkpointed(mixing.mixture_demand(totals, read(spark, sf, "mix_targets")))  # a row per mix and source
    return demand, mixing.curriculum(counted, demand)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose copies run out before their demand is met, however often they may be repeated."""
    shares = mixing.shares_reached(*_drawn(spark, sf))
    return shares.filter(F.col("shortfall") > 1e-6 * F.col("demand")).select("mix_id", "source")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by every source of every mix, and the time at which its last copy stands."""
    shares = mixing.shares_reached(*_drawn(spark, sf))
    figures = [F.round(c, n).alias(c) for c, n in (("actual_share", 6), ("drawn", 2), ("shortfall", 2), ("ends_at", 6))]
    return shares.select("mix_id", "source", "target_share", "copies", "supply", *figures)


def p9_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Every drawn copy of every document with its training position, in order."""
    _, positions = _drawn(spark, sf)
    return mixing.in_training_order(positions.drop("drawn")).withColumn("position", F.round("position", 9))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents more than half of which is no prose."""
    stats = quality.text_statistics(read(spark, sf, "documents"))
    return quality.non_prose(stats).select(F.col("item_id").alias("doc_id"), "kind").dropDuplicates(["doc_id"])


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """All statistics of every document."""
    return quality.text_statistics(read(spark, sf, "documents")).withColumnRenamed("item_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        p1_found, p1_languages, p3_found, p4_found, p4_chunk_points, p5_found, p6_found, p6_pieces, p6_invariants, p7_found, p7_clean_text, p8_found, p8_leaks,
        p9_found, p9_shares, p9_curriculum, p10_found, p10_statistics,
    )
    return {f.__name__: f for f in listed}


_POINTS = """
    WITH s AS (SELECT {g} AS g, {i} AS item, arm, max(score) AS score FROM ({src}) GROUP BY ALL),
    n AS (SELECT g, count(DISTINCT item) AS n_items FROM s GROUP BY g),
    arms AS (SELECT DISTINCT g, arm FROM s),
    items AS (SELECT DISTINCT g, item FROM s),
    r AS (SELECT g, arm, item, score,
                 rank() OVER (PARTITION BY g, arm ORDER BY score DESC) + (count(*) OVER (PARTITION BY g, arm, score) - 1) / 2.0::DOUBLE AS rk
          FROM s WHERE score IS NOT NULL),
    p AS (SELECT items.g, items.item, any_value(n.n_items) AS n_items, count(r.score) AS arms_present,
                 sum(n.n_items - coalesce(r.rk, (n.n_items + 1) / 2.0::DOUBLE))::DOUBLE AS points
          FROM items JOIN n USING (g) JOIN arms USING (g)
          LEFT JOIN r ON r.g = items.g AND r.arm = arms.arm AND r.item = items.item
          GROUP BY items.g, items.item)
"""
_CHUNKS = _POINTS.format(g="query_id", i="chunk_id", src="SELECT query_id, chunk_id, arm, score FROM ranked_chunks")
_CLAIM_ROWS = """
    SELECT q AS query_id, c AS claim_no, a AS arm, scores[a] AS score FROM (
        SELECT query_id AS q, i::VARCHAR AS c, claims[i].scores AS scores, unnest(['nli', 'overlap', 'logit', 'hits']) AS a
        FROM (SELECT query_id, claims, unnest(range(1, len(claims) + 1)) AS i FROM response_records WHERE len(claims) >= 3))
"""
_CLAIMS = _POINTS.format(g="query_id", i="claim_no", src=_CLAIM_ROWS)
_STRETCH = r"'[^\s\p{Z}\x{85}\x{1c}-\x{1f}.!?…。！？]+'"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""
            SELECT 'chunk' AS src, g AS query_id, item FROM ({_CHUNKS} SELECT g, item, n_items, row_number() OVER (PARTITION BY g ORDER BY points DESC, item) AS k FROM p)
            WHERE k <= least(3, greatest(1, n_items - 4))
            UNION ALL
            SELECT 'claim' AS src, g AS query_id, item FROM ({_CLAIMS} SELECT g, item, row_number() OVER (PARTITION BY g ORDER BY points DESC, item) AS k FROM p)
            WHERE k = 1""",
        "p4_chunk_points": f"{_CHUNKS} SELECT g AS query_id, item AS chunk_id, round(points, 6) AS points, n_items, arms_present FROM p",
        "p6_found": f"""
            WITH t AS (
                SELECT 'document' AS src, doc_id::VARCHAR AS item_id, source AS owner, text FROM documents
                UNION SELECT 'chunk', chunk_id, tenant_id, text FROM chunks)
            SELECT src, item_id,
                   (coalesce(list_max(list_transform(regexp_extract_all(text, {_STRETCH}), lambda x: length(x))), 0) > target_chars)::INTEGER AS unbroken
            FROM t JOIN chunk_configs ON owner = tenant_id WHERE length(text) > target_chars""",
        "p6_invariants": """
            WITH t AS (
                SELECT 'document' AS src, doc_id::VARCHAR AS item_id, source AS owner, text FROM documents
                UNION SELECT 'chunk', chunk_id, tenant_id, text FROM chunks)
            SELECT src, item_id, length(text) AS n_chars, true AS within_limit, true AS overlapping, true AS whole
            FROM t JOIN chunk_configs ON owner = tenant_id WHERE length(text) > target_chars""",
        # the cases are the same for any usual tokenizer; characters stand for tokens here
        "p9_found": """
            WITH s AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source), z AS (SELECT sum(n) AS all_n FROM s)
            SELECT DISTINCT mix_id, m.source FROM mix_targets m LEFT JOIN s USING (source), z
            WHERE target_share * all_n > max_repeats * coalesce(n, 0)""",
    }
