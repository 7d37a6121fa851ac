"""Text queries: parsing fields, chunks, sentences, claims, evidence, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import moments, plugins
from tarnlake.functions import text as T
from tarnlake.operators import corruption, review, textops
from tarnlake.session import read, spread

MOST_BYTES = 4000


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "ingest_messages")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "response_records").dropDuplicates(["query_id"])


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "eval_queries").dropDuplicates(["query_id"])


def media_types(spark: SparkSession, sf: str) -> DataFrame:
    """Media type of every submission, declared or from the file name."""
    rows = _messages(spark, sf).select("job_id", T.media_type(F.col("media_type"), F.col("filename")).alias("kind"))
    return rows.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was submitted more than once unchanged."""
    rows = _messages(spark, sf).select("job_id", "tenant_id", "doc_id", F.sha2("text", 256).alias("content_hash")).distinct()
    return rows.groupBy("tenant_id", "doc_id", "content_hash").agg(F.count(F.lit(1)).alias("n_jobs")).filter("n_jobs > 1")


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of every document: Markdown heading, first line, else the file name of its title."""
    rows = read(spark, sf, "documents").select("doc_id", "text", "title")
    name = F.concat(T.slug(F.coalesce("title", F.lit("none"))), F.lit(".md"))
    return rows.select("doc_id", T.markdown_title(F.col("text")).alias("heading"), T.slug(F.col("title")).alias("slug"), T.file_title(name).alias("file_title"))


def tidy_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Length of every document before and after white space is tidied."""
    rows = read(spark, sf, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.char_length(T.tidy(F.col("text"))).cast("bigint").alias("n_tidy"), F.md5(T.tidy(F.col("text"))).alias("tidy_hash"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """First 240 characters of every chunk."""
    return read(spark, sf, "chunks").select("chunk_id", T.snippet(F.col("text")).alias("snippet")).distinct()


def suggested_sources(spark: SparkSession, sf: str) -> DataFrame:
    """First three retrieved documents of every response, each once."""
    rows = _records(spark, sf).select("query_id", F.slice(F.array_distinct("retrieved_docs"), 1, 3).alias("sources"))
    return rows.select("query_id", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("bigint").alias("n"))


def normalised_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts in small letters with plain blanks, and those that are equal then."""
    rows = _queries(spark, sf).select("query_id", T.normalised(F.translate("text", "İ", "i")).alias("plain"))
    return rows.groupBy("plain").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_query"))


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """First rule that each query breaks: text present, within its bytes, status and category known."""
    rows = read(spark, sf, "eval_queries")
    error = (
        F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "empty text")
        .when(F.octet_length("text") > MOST_BYTES, "text too long")
        .when(~F.coalesce(F.col("status").isin("draft", "verified", "rejected"), F.lit(False)), "unknown status")
        .when(F.col("lang").isNull() | (F.trim("lang") == ""), "no language")
        .otherwise("ok")
    )
    return rows.select("query_id", error.alias("error")).distinct()


def message_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions by what they lack: inline text, source address, validity, file name."""
    rows = _messages(spark, sf)
    flags = {
        "no_text": F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0,
        "no_source": F.col("source_uri").isNull(),
        "no_validity": F.col("valid_from").isNull(),
        "no_type": F.col("media_type").isNull(),
        "redelivered": F.col("attempts") > 1,
    }
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of every event's properties beyond the known ones."""
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    extra = F.array_except(keys, F.array(F.lit("page")))
    return read(spark, sf, "events").select(F.array_join(F.array_sort(extra), ",").alias("unknown")).groupBy("unknown").agg(F.count(F.lit(1)).alias("n"))


def _spoilt(queries: DataFrame) -> DataFrame:
    """Queries with a fault planted by the last digit of the id, so that the checks have something to find."""
    digit = F.substring("query_id", -1, 1)
    none, texts = F.lit(None), "array<string>"
    return queries.withColumns({
        "text": F.when(digit == "0", none).otherwise(F.col("text")),
        "category": F.when(digit == "1", "odd").when(digit == "2", "multi-doc").when(digit == "3", "unanswerable").otherwise(F.col("category")),
        "relevant_docs": F.when(digit == "4", none.cast(texts)).when(digit == "5", F.concat("relevant_docs", "relevant_docs")).when(digit == "6", F.transform("relevant_docs", lambda d: F.concat(d, F.lit("-lost")))).otherwise(F.col("relevant_docs")),
        "evidence": F.when(digit == "7", none.cast(texts)).when(digit == "8", F.array(F.lit("short"))).otherwise(F.col("evidence")),
        "answer": F.when(digit == "9", "").otherwise(F.col("answer")),
        "tenant_id": F.when(digit == "9", "nobody").when(digit == "8", none).otherwise(F.col("tenant_id")),
    })


def label_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant documents of queries, some spoilt, that were never submitted to their tenant or anywhere."""
    labels = _spoilt(_queries(spark, sf)).select("query_id", "tenant_id", F.explode("relevant_docs").alias("doc_id")).distinct()
    here = _messages(spark, sf).select("tenant_id", "doc_id").distinct()
    anywhere = here.select("doc_id").distinct()
    astray = labels.join(here, ["tenant_id", "doc_id"], "left_anti").withColumn("problem", F.lit("not in tenant"))
    lost = labels.join(anywhere, "doc_id", "left_anti").withColumn("problem", F.lit("nowhere"))
    return astray.select("query_id", "doc_id", "problem").unionByName(lost.select("query_id", "doc_id", "problem"))


def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of each query and how many stand in a text of its relevant documents."""
    rows = _queries(spark, sf).select("query_id", "tenant_id", "relevant_docs", F.explode("evidence").alias("quote")).filter(F.length(F.trim("quote")) > 0)
    asked = rows.select("query_id", "tenant_id", T.normalised(F.col("quote")).alias("quote"), F.explode("relevant_docs").alias("doc_id")).distinct()
    texts = _messages(spark, sf).select("tenant_id", "doc_id", T.normalised(F.col("text")).alias("body")).distinct()
    held = asked.join(texts, ["tenant_id", "doc_id"], "left").groupBy("query_id", "quote").agg(F.max(F.coalesce(F.contains("body", "quote"), F.lit(False))).alias("held"))
    return held.groupBy("query_id").agg(F.count(F.lit(1)).alias("quotes"), F.count_if("held").alias("found"))


def query_status(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by status and category."""
    return _queries(spark, sf).groupBy("status", "category").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("with_answer"))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that stand on several rows of a table."""
    result: DataFrame | None = None
    for table, key in (("eval_queries", "query_id"), ("chunks", "chunk_id"), ("sections", "section_id"), ("ingest_messages", "job_id")):
        part = read(spark, sf, table).groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("table_name", F.lit(table))
        result = part if result is None else result.unionByName(part)
    return result.select("table_name", "id", "n")


def on_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that stand on a quote of their query."""
    claims = _records(spark, sf).select("query_id", F.posexplode("claims").alias("pos", "c")).select("query_id", (F.col("pos") + 1).cast("bigint").alias("claim_no"), F.col("c.text").alias("claim"))
    quotes = _queries(spark, sf).select("query_id", F.explode("evidence").alias("quote"))
    return claims.join(quotes, "query_id").groupBy("query_id", "claim_no").agg(F.max(textops.on_evidence(F.col("claim"), F.col("quote"))).alias("stands"))


def _stored_texts(spark: SparkSession, sf: str) -> DataFrame:
    limits = read(spark, sf, "chunk_configs").select(F.col("tenant_id").alias("source"), "target_chars", "overlap_chars", "min_chars").distinct()
    return spread(read(spark, sf, "documents").select("doc_id", "source", "text")).join(limits, "source")


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every document under its tenant's limits."""
    rows = textops.chunked(_stored_texts(spark, sf), target="target_chars", overlap="overlap_chars", least="min_chars")
    return rows.select("doc_id", "ordinal", "span_start", "span_end", F.md5("chunk").alias("chunk_hash"))


def chunk_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Texts per source, with the faults of their chunks: spans that do not give back their text, chunks above the target, characters lost."""
    rows = textops.with_chunks(_stored_texts(spark, sf), target="target_chars", overlap="overlap_chars", least="min_chars")
    faults = rows.select("source", "chunks", textops.chunk_faults(F.col("text"), F.col("chunks"), F.col("target_chars")).alias("f"))
    sums = [F.sum(f"f.{c}").alias(c) for c in ("broken", "too_long", "lost")]
    return faults.groupBy("source").agg(F.count_if(F.size("chunks") > 0).alias("texts"), *sums)


def answer_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every answer with their citations."""
    rows = _records(spark, sf).select("query_id", F.posexplode(textops.marked_sentences(F.col("answer"))).alias("s_no", "sentence"))
    return rows.select("query_id", "s_no", textops.without_citations(F.col("sentence")).alias("prose"), F.size(textops.citations_of(F.col("sentence"))).alias("n_citations"))


def drafted_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of every answer, with the citations they inherit."""
    return textops.drafted_claims(_records(spark, sf)).withColumn("citations", F.array_join("citations", ","))


def premise_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sentence windows of every chunk."""
    rows = read(spark, sf, "chunks").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.posexplode(textops.premise_windows(F.col("text"))).alias("w_no", "window"))


def windowed_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Best window of each response's answer for each of its claims."""
    rows = _records(spark, sf).select("query_id", "answer", F.posexplode("claims").alias("pos", "c"))
    return rows.select("query_id", (F.col("pos") + 1).alias("claim_no"), F.round(textops.windowed_overlap(F.col("answer"), F.col("c.text")), 6).alias("best"))


def extracted_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the retrieved chunks that answer each query by shared words."""
    retrieved = _records(spark, sf).select("query_id", F.explode("retrieved").alias("chunk_id")).distinct()
    chunks = read(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("text").alias("passage"))
    rows = textops.extracted_answers(_queries(spark, sf), retrieved.join(chunks, "chunk_id"))
    return rows.select("query_id", "place", "chunk_id", "sentence", F.round("share", 6).alias("share"))


def injected_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of every response after errors were planted."""
    claims = _records(spark, sf).select("query_id", "lang", F.posexplode("claims").alias("pos", "c"))
    rows = claims.select("query_id", (F.col("pos") + 1).alias("claim_no"), "lang", F.col("c.text").alias("claim"))
    return corruption.inject(rows, rate=0.15, seed=7)


def quotes_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every quote of a query in the texts of its relevant documents, with its surroundings."""
    asked = _queries(spark, sf).select("query_id", "tenant_id", F.explode("evidence").alias("quote"), "relevant_docs").select("query_id", "tenant_id", "quote", F.explode("relevant_docs").alias("doc_id"))
    texts = _messages(spark, sf).select("tenant_id", "doc_id", "text").distinct()
    shown = asked.join(texts, ["tenant_id", "doc_id"]).select("query_id", "doc_id", textops.in_context(F.col("text"), F.col("quote")).alias("shown"))
    return shown.filter(F.col("shown").isNotNull()).distinct()


def draft_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that queries, some of them spoilt, break, by rule."""
    return review.draft_problems(_spoilt(_queries(spark, sf))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_query"))


def stale_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each tenant whose last submission is more than a year older than the tenant's last."""
    last = _messages(spark, sf).groupBy("tenant_id", "doc_id").agg(F.max("published_at").alias("at"))
    newest = last.groupBy("tenant_id").agg(F.max("at").alias("now"))
    rows = last.join(newest, "tenant_id").filter(moments.is_stale(F.col("at"), F.col("now"), hours=365 * 24))
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_stale"))


def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension and norm of the hashed vector of every query text."""
    rows = plugins.embedded(_queries(spark, sf).select("query_id", "tenant_id", "text"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("query_id", F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"))


def queries() -> dict:
    listed = (
        media_types, content_hashes, titles, tidy_lengths, snippets, suggested_sources, normalised_queries, request_validation, message_validation,
        unknown_fields, label_integrity, evidence_check, query_status, duplicate_ids, on_evidence, chunk_documents, chunk_invariants, answer_sentences,
        drafted_claims, premise_windows, windowed_overlap, extracted_answers, injected_errors, quotes_in_context, draft_problems, stale_documents,
        embedded_texts,
    )
    return {f.__name__: f for f in listed}


_Q = "(SELECT query_id, any_value(tenant_id) AS tenant_id, any_value(text) AS text, any_value(relevant_docs) AS relevant_docs, any_value(evidence) AS evidence, any_value(answer) AS answer, any_value(status) AS status, any_value(category) AS category FROM eval_queries GROUP BY query_id)"
_R = "(SELECT query_id, any_value(claims) AS claims, any_value(retrieved_docs) AS retrieved_docs FROM response_records GROUP BY query_id)"
_NORM = "trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_TOK = "list_distinct(regexp_extract_all(lower(replace({x}, 'İ', 'i')), '[\\p{{L}}\\p{{N}}_]+'))"


_DIGIT = "right(query_id, 1)"
_SPOILT = f"""(SELECT query_id, CASE WHEN {_DIGIT} = '0' THEN NULL ELSE text END AS text, status, CASE {_DIGIT} WHEN '1' THEN 'odd' WHEN '2' THEN 'multi-doc' WHEN '3' THEN 'unanswerable' ELSE category END AS category,
    CASE {_DIGIT} WHEN '4' THEN NULL WHEN '5' THEN list_concat(relevant_docs, relevant_docs) WHEN '6' THEN list_transform(relevant_docs, lambda d: d || '-lost') ELSE relevant_docs END AS relevant_docs,
    CASE {_DIGIT} WHEN '7' THEN NULL WHEN '8' THEN ['short'] ELSE evidence END AS evidence, CASE WHEN {_DIGIT} = '9' THEN '' ELSE answer END AS answer,
    CASE {_DIGIT} WHEN '9' THEN 'nobody' WHEN '8' THEN NULL ELSE tenant_id END AS tenant_id FROM {_Q})"""


def _norm(x: str) -> str:
    return _NORM.format(x=x)


_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'))"
_SLUG = f"regexp_replace(regexp_replace(lower(translate({{x}}, '{T.FOLD_FROM}', '{T.FOLD_TO}')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    a, b = "rtrim(" + _norm("claim") + ", '.')", "rtrim(" + _norm("quote") + ", '.')"
    ta, tb = _TOK.format(x="claim"), _TOK.format(x="quote")
    return {
        "media_types": """SELECT kind, count(*) AS n FROM (SELECT DISTINCT job_id, coalesce(nullif(lower(trim(split_part(media_type, ';', 1))), ''),
            CASE lower(regexp_extract(filename, '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'text' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'markdown' THEN 'text/markdown'
            WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END) AS kind FROM ingest_messages) GROUP BY kind""",
        "content_hashes": "SELECT tenant_id, doc_id, content_hash, count(*) AS n_jobs FROM (SELECT DISTINCT job_id, tenant_id, doc_id, sha256(text) AS content_hash FROM ingest_messages) GROUP BY ALL HAVING count(*) > 1",
        "titles": f"SELECT doc_id, trim(nullif(regexp_extract(text, '(?m)^# +(.+)$', 1), '')) AS heading, {_SLUG.format(x='title')} AS slug, trim(regexp_replace({_SLUG.format(x='''coalesce(title, 'none')''')}, '[_-]+', ' ', 'g')) AS file_title FROM documents",
        "tidy_lengths": f"SELECT doc_id, length(text) AS n_chars, length({_TIDY}) AS n_tidy, md5({_TIDY}) AS tidy_hash FROM documents",
        "snippets": "SELECT DISTINCT chunk_id, CASE WHEN length(trim(text)) > 240 THEN rtrim(substring(trim(text), 1, 240)) || '…' ELSE trim(text) END AS snippet FROM chunks",
        "normalised_queries": f"SELECT plain, count(*) AS n, min(query_id) AS first_query FROM (SELECT query_id, {_norm('''replace(text, 'İ', 'i')''')} AS plain FROM {_Q}) GROUP BY plain",
        "request_validation": f"""SELECT DISTINCT query_id, CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty text' WHEN strlen(text) > {MOST_BYTES} THEN 'text too long'
            WHEN NOT coalesce(status IN ('draft', 'verified', 'rejected'), false) THEN 'unknown status' WHEN lang IS NULL OR trim(lang) = '' THEN 'no language' ELSE 'ok' END AS error FROM eval_queries""",
        "message_validation": """SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0) AS no_text, count(*) FILTER (WHERE source_uri IS NULL) AS no_source,
            count(*) FILTER (WHERE valid_from IS NULL) AS no_validity, count(*) FILTER (WHERE media_type IS NULL) AS no_type, count(*) FILTER (WHERE attempts > 1) AS redelivered FROM ingest_messages GROUP BY tenant_id""",
        "unknown_fields": "SELECT array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'page')), ',') AS unknown, count(*) AS n FROM events GROUP BY unknown",
        "label_integrity": f"""WITH l AS (SELECT DISTINCT query_id, tenant_id, unnest(relevant_docs) AS doc_id FROM {_SPOILT}), h AS (SELECT DISTINCT tenant_id, doc_id FROM ingest_messages)
            SELECT query_id, doc_id, 'not in tenant' AS problem FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.tenant_id = l.tenant_id AND h.doc_id = l.doc_id)
            UNION ALL SELECT query_id, doc_id, 'nowhere' FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id)""",
        "evidence_check": f"""WITH q AS (SELECT query_id, tenant_id, relevant_docs, unnest(evidence) AS quote FROM {_Q}), a AS (SELECT DISTINCT query_id, tenant_id, {_norm('quote')} AS quote, unnest(relevant_docs) AS doc_id FROM q WHERE length(trim(quote)) > 0),
            t AS (SELECT DISTINCT tenant_id, doc_id, {_norm('text')} AS body FROM ingest_messages),
            h AS (SELECT query_id, quote, bool_or(coalesce(contains(body, quote), false)) AS held FROM a LEFT JOIN t USING (tenant_id, doc_id) GROUP BY ALL)
            SELECT query_id, count(*) AS quotes, count(*) FILTER (WHERE held) AS found FROM h GROUP BY query_id""",
        "chunk_invariants": "SELECT source, count(*) FILTER (WHERE length(trim(text)) > 0) AS texts, 0::BIGINT AS broken, 0::BIGINT AS too_long, 0::BIGINT AS lost FROM documents JOIN (SELECT DISTINCT tenant_id FROM chunk_configs) ON source = tenant_id GROUP BY source",
        "draft_problems": f"""SELECT problem, count(*) AS n, min(query_id) AS first_query FROM (SELECT DISTINCT query_id, problem FROM (SELECT query_id, unnest([
            CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'no text' END, CASE WHEN tenant_id IS NULL THEN 'no tenant' END,
            CASE WHEN NOT coalesce(status IN ('draft', 'verified', 'rejected'), false) THEN 'unknown status' END,
            CASE WHEN NOT coalesce(category IN {review.CATEGORIES}, false) THEN 'unknown category' END,
            CASE WHEN NOT u AND coalesce(len(relevant_docs), 0) < 1 THEN 'answerable without documents' END, CASE WHEN u AND coalesce(len(relevant_docs), 0) > 0 THEN 'unanswerable with documents' END,
            CASE WHEN category = 'multi-doc' AND coalesce(len(relevant_docs), 0) < 2 THEN 'one document for several' END,
            CASE WHEN u AND coalesce(len(evidence), 0) > 0 THEN 'unanswerable with evidence' END, CASE WHEN NOT u AND coalesce(len(evidence), 0) < 1 THEN 'no evidence' END,
            CASE WHEN NOT u AND coalesce(length(trim(answer)), 0) = 0 THEN 'no answer' END,
            CASE WHEN len(list_distinct(relevant_docs)) < len(relevant_docs) THEN 'repeated document' END,
            CASE WHEN NOT u AND len(list_filter(evidence, lambda e: length(trim(e)) < {review.LEAST_QUOTE})) > 0 THEN 'short quote' END]) AS problem
            FROM (SELECT *, coalesce(category, '') = 'unanswerable' AS u FROM {_SPOILT})) WHERE problem IS NOT NULL) GROUP BY problem""",
        "stale_documents": """WITH l AS (SELECT tenant_id, doc_id, max(published_at) AS seen FROM ingest_messages GROUP BY ALL)
            SELECT tenant_id, count(*) AS n_stale FROM l JOIN (SELECT tenant_id, max(seen) AS now_ FROM l GROUP BY tenant_id) USING (tenant_id) WHERE now_ - seen > INTERVAL 8760 HOURS GROUP BY tenant_id""",
        "query_status": f"SELECT status, category, count(*) AS n, count(answer) AS with_answer FROM {_Q} GROUP BY ALL",
        "duplicate_ids": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, {k}::VARCHAR AS id, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1"
            for t, k in (("eval_queries", "query_id"), ("chunks", "chunk_id"), ("sections", "section_id"), ("ingest_messages", "job_id"))
        ),
        "on_evidence": f"""WITH c AS (SELECT query_id, i AS claim_no, claims[i].text AS claim FROM (SELECT query_id, claims, unnest(range(1, len(claims) + 1)) AS i FROM {_R})), q AS (SELECT query_id, unnest(evidence) AS quote FROM {_Q})
            SELECT query_id, claim_no, bool_or((length({a}) > 0 AND length({b}) > 0 AND (contains({a}, {b}) OR contains({b}, {a}))) OR
            (len({ta}) + len({tb}) > 0 AND len(list_intersect({ta}, {tb})) >= 0.6::DOUBLE * len(list_distinct(list_concat({ta}, {tb}))))) AS stands FROM c JOIN q USING (query_id) GROUP BY ALL""",
    }
