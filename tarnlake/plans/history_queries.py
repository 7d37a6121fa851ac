"""Problem 2 over ingest_messages: the version history of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import history
from tarnlake.session import read

MOMENT = "2024-06-01 00:00:00"


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with the period each was valid and the first submission that carried its content."""
    versions = history.attribute_history(read(spark, sf, "ingest_messages"))
    return versions.select("tenant_id", "doc_id", "version", "valid_from", "valid_to", "job_id")


def p2_store(spark: SparkSession, sf: str) -> DataFrame:
    """The checkpoint-delta store itself: how many attributes each version's row holds."""
    store = history.build_store(read(spark, sf, "ingest_messages"))
    return store.select(
        "tenant_id",
        "doc_id",
        "version",
        history.as_text(F.col("valid_from")).alias("valid_from"),
        history.as_text(F.col("valid_to")).alias("valid_to"),
        "is_checkpoint",
        F.array_join(F.array_sort(F.map_keys("patch")), ",").alias("changed"),
    )


def p2_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of every document as they stood at one moment, read from the store and its value table."""
    messages = read(spark, sf, "ingest_messages")
    rows = history.as_of(history.build_store(messages), history.attribute_values(messages), F.lit(MOMENT))
    return rows.select("tenant_id", "doc_id", "version", history.squeezed(F.col("title")).alias("title"), history.squeezed(F.col("text")).alias("text"))


def p2_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The history when what was published after a moment is appended to a store built before it."""
    messages = read(spark, sf, "ingest_messages")
    late = F.col("published_at") > F.lit(MOMENT).cast("timestamp_ntz")
    early, new = messages.filter(F.coalesce(~late, F.lit(True))), messages.filter(late)
    versions = history.reconstruct(history.append(history.build_store(early), early, new))
    return versions.select("tenant_id", "doc_id", "version", history.as_text(F.col("valid_from")).alias("valid_from"), history.as_text(F.col("valid_to")).alias("valid_to"), "job_id")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_store": p2_store, "p2_as_of": p2_as_of, "p2_appended": p2_appended}


# The fold as a recursion over the submissions of all documents at once; a document's versions are a list.
_SQUEEZED = "trim(regexp_replace(coalesce({c}, ''), '[\\s\\x0b\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'))"
_HISTORY = f"""r AS (SELECT DISTINCT tenant_id, doc_id, job_id, valid_from AS vf, coalesce(correction, false) AS fix, published_at AS p, {_SQUEEZED.format(c='title')} AS title, {_SQUEEZED.format(c='text')} AS body
      FROM ingest_messages WHERE tenant_id IS NOT NULL AND doc_id IS NOT NULL AND published_at IS NOT NULL),
    m AS (SELECT *, md5(title) || md5(body) AS c, row_number() OVER (PARTITION BY tenant_id, doc_id ORDER BY p, job_id) AS n FROM r),
    f AS (SELECT tenant_id, doc_id, 0::BIGINT AS n, []::STRUCT(s TIMESTAMP, c VARCHAR)[] AS v FROM m GROUP BY ALL
          UNION ALL
          SELECT tenant_id, doc_id, n, list_filter(w, lambda x, i: i = 1 OR w[i - 1].c <> x.c) AS v FROM (
              SELECT tenant_id, doc_id, n, CASE
                  WHEN fix AND k = 0 THEN v
                  WHEN fix OR (k > 0 AND v[k].s = t) THEN v[1:k - 1] || [{{'s': v[k].s, 'c': c}}] || v[k + 1:]
                  WHEN k > 0 AND v[k].c = c THEN v
                  ELSE v[1:k] || [{{'s': t, 'c': c}}] || v[k + 1:] END AS w
              FROM (SELECT f.tenant_id, f.doc_id, m.n, m.c, m.fix, f.v, coalesce(m.vf, m.p) AS t,
                           CASE WHEN m.fix AND m.vf IS NULL THEN len(f.v) ELSE len(list_filter(f.v, lambda x: x.s <= coalesce(m.vf, m.p))) END AS k
                    FROM f JOIN m ON m.tenant_id = f.tenant_id AND m.doc_id = f.doc_id AND m.n = f.n + 1))),
    z AS (SELECT tenant_id, doc_id, arg_max(v, n) AS v FROM f GROUP BY ALL),
    h AS (SELECT tenant_id, doc_id, i AS version, v[i].s AS s, v[i + 1].s AS e, v[i].c AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM z)),
    j AS (SELECT tenant_id, doc_id, c, arg_min(job_id, n) AS job_id, md5(any_value(title)) AS th, md5(any_value(body)) AS bh, any_value(title) AS title, any_value(body) AS body FROM m GROUP BY ALL)"""


def _versions(more: str) -> str:
    return f"""WITH RECURSIVE {_HISTORY}
    SELECT tenant_id, doc_id, version::INTEGER AS version, strftime(s, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(e, '%Y-%m-%d %H:%M:%S'), '9999-12-31 23:59:59') AS valid_to, {more}
    FROM h JOIN j USING (tenant_id, doc_id, c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _versions("job_id"),
        "p2_appended": _versions("job_id"),
        "p2_store": f"""SELECT tenant_id, doc_id, version, valid_from, valid_to, version % 8 = 1 AS is_checkpoint,
                'job_id' || CASE WHEN version % 8 = 1 OR bh <> lag(bh) OVER w THEN ',text' ELSE '' END || CASE WHEN version % 8 = 1 OR th <> lag(th) OVER w THEN ',title' ELSE '' END AS changed
            FROM ({_versions("th, bh")}) WINDOW w AS (PARTITION BY tenant_id, doc_id ORDER BY version)""",
        "p2_as_of": f"""WITH RECURSIVE {_HISTORY} SELECT tenant_id, doc_id, version::INTEGER AS version, title, body AS text FROM h JOIN j USING (tenant_id, doc_id, c)
            WHERE s <= TIMESTAMP '{MOMENT}' AND (e IS NULL OR e > TIMESTAMP '{MOMENT}')""",
    }
