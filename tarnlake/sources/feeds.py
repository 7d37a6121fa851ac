"""Structured public texts as sources: article feeds, encyclopedia sections, statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Back-matter headings that end an article's content.
BACK_MATTER = ("references", "see also", "external links", "notes", "further reading", "bibliography", "sources", "citations", "footnotes")

_ENTRY = (
    "struct<id: string, title: string, summary: string, published: string, "
    "author: array<struct<name: string>>>"
)


def atom_entries(feeds: DataFrame) -> DataFrame:
    """Entries of Atom feeds (column xml): id without version, version, title, abstract, authors, published."""
    cut = F.regexp_extract_all("xml", F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))
    entry = F.from_xml(F.col("entry"), _ENTRY, {"rowTag": "entry"})
    rows = feeds.select(F.explode(cut).alias("entry")).select(entry.alias("e"))

    def plain(c):  # noqa: ANN001, ANN202
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    name = F.regexp_extract("e.id", r"([^/]+?)(?:v(\d+))?$", 1)
    return rows.select(
        name.alias("entry_id"),
        F.regexp_extract("e.id", r"v(\d+)$", 1).try_cast("int").alias("version"),
        plain(F.col("e.title")).alias("title"),
        plain(F.col("e.summary")).alias("abstract"),
        F.transform("e.author", lambda a: a["name"]).alias("authors"),
        F.to_timestamp("e.published").alias("published"),
    )


def page_sections(pages: DataFrame, most_chars: int = 20_000) -> DataFrame:
    """Sections of pages in wiki headings: slug, sec_no, level, heading, body.

    Back matter is dropped with everything below it, empty sections too, and a page is cut at the
    section that passes ``most_chars``.
    """
    parts = F.split("text", r"\n(?==+[^=\n]+=+[ \t]*(?:\n|$))")
    rows = pages.select("slug", F.posexplode(parts).alias("sec_no", "part"))
    head = F.regexp_extract("part", r"^(=+)\s*([^=\n]+?)\s*=+", 2)
    rows = rows.select(
        "slug",
        "sec_no",
        F.greatest(F.length(F.regexp_extract("part", r"^(=+)[^=\n]", 1)), F.lit(1)).alias("level"),
        head.alias("heading"),
        F.trim(F.regexp_replace("part", r"^=+[^=\n]+=+[ \t]*\n?", "")).alias("body"),
    )
    ended = F.lower("heading").isin(*BACK_MATTER)
    w = Window.partitionBy("slug").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the level of the latest back-matter heading stays open until a heading of its level or above follows
    mark = F.when(ended, F.struct("sec_no", F.col("level").alias("open_level")))
    rows = rows.withColumn("mark", F.last(mark, ignorenulls=True).over(w))
    closed = F.max(F.when(~ended & (F.col("level") <= F.coalesce(F.col("mark.open_level"), F.lit(0))), F.col("sec_no"))).over(w)
    inside = F.col("mark").isNotNull() & (F.col("level") > F.col("mark.open_level")) & (F.coalesce(closed, F.lit(-1)) < F.col("mark.sec_no"))
    rows = rows.withColumn("dropped", ended | inside).filter(~F.col("dropped") & (F.length("body") > 0)).drop("mark", "dropped")
    size = F.sum(F.char_length("body")).over(w)
    return rows.withColumn("upto", size).filter(F.col("upto") - F.char_length("body") < most_chars).drop("upto")


def statute_articles(statutes: DataFrame) -> DataFrame:
    """Articles of statutes (slug, text): article_no, provisional, title, body.

    An article starts at a line with its number ("Madde 5 -", "Geçici Madde 1 -", "ARTICLE 5 -"); the
    short line before it is its title.  Numbers that stand twice keep their order by place.
    """
    rows = statutes.select("slug", F.posexplode(F.split("text", r"\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter(F.length("line") > 0)
    start = r"(?iu)^(geçici\s+|provisional\s+)?(?:madde|article)\s+(\d+)\s*[-–—.:)]*\s*"
    w = Window.partitionBy("slug").orderBy("line_no")
    is_start = F.col("line").rlike(start)
    rows = rows.withColumns({
        "is_start": is_start,
        "title_of_next": F.coalesce(F.lead(is_start).over(w), F.lit(False)) & ~is_start & (F.char_length("line") <= 120) & ~F.col("line").rlike(r"[.;:]$"),
        "before": F.lag("line").over(w),
    })
    rows = rows.withColumn("title", F.when(F.col("is_start") & F.coalesce(F.lag("title_of_next").over(w), F.lit(False)), F.col("before")))
    rows = rows.filter(~F.col("title_of_next")).withColumn("place", F.sum(F.col("is_start").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    found = rows.filter("place > 0").groupBy("slug", "place").agg(F.max("title").alias("title"), body.alias("whole"))
    first = F.regexp_extract("whole", start, 2).cast("int")
    return found.select(
        "slug",
        "place",
        first.alias("article_no"),
        (F.length(F.regexp_extract("whole", start, 1)) > 0).alias("provisional"),
        "title",
        F.regexp_replace("whole", start, "").alias("body"),
    )
