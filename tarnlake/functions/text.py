"""Text functions as column expressions (JVM side), and the analyzers of lexical search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content for overlap scores.
OVERLAP_STOPWORDS = (
    "the a an of to in for and or by is are this that be as at it on with "
    "ve veya ile bir bu şu için olarak de da ki"
).split()

TOKEN = r"[\p{L}\p{N}_]+"

# Letters that folding maps to plain ones.
FOLD_FROM = "çğışöüâîûéèêëáàäãåíìïóòôõúùñýÿœæßÇĞİŞÖÜÂÎÛÉÈÊÁÀÄÃÅÍÌÓÒÔÕÚÙÑ"
FOLD_TO = "cgisouaiueeeeaaaaaiiioooouunyyoasCGISOUAIUEEEAAAAAIIOOOOUUN"


def tokens(text: Column) -> Column:
    """Small-letter word tokens in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.translate(text, "İ", "i")), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def lexemes(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(text))


def content_words(text: Column) -> Column:
    """Distinct tokens without stopwords."""
    return F.array_except(lexemes(text), F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS]))


def overlap_score(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' content words found in the premise; 0 where either is empty."""
    h, p = content_words(hypothesis), content_words(premise)
    return F.when((F.size(h) > 0) & (F.length(F.trim(F.coalesce(premise, F.lit("")))) > 0), F.size(F.array_intersect(h, p)) / F.size(h)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 where both are empty."""
    x, y = lexemes(a), lexemes(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def normalised(text: Column) -> Column:
    """Small letters, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def tidy(text: Column) -> Column:
    """Line ends as \\n, no blanks before them, at most one blank line, trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def folded(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def slug(text: Column) -> Column:
    """Plain letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(folded(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def file_title(filename: Column) -> Column:
    """File name without folder and extension, marks as blanks."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(stem, r"[_-]+", " "))


def markdown_title(text: Column) -> Column:
    """First level-one heading; null where there is none."""
    found = F.regexp_extract(text, r"(?m)^# +(.+)$", 1)
    return F.when(F.length(found) > 0, F.trim(found))


def text_title(text: Column, filename: Column) -> Column:
    """First line if it has 1 to 120 characters, else the file name."""
    first = F.trim(F.split(F.trim(text), "\n")[0])
    return F.when(F.length(first).between(1, 120), first).otherwise(file_title(filename))


def media_type(declared: Column, filename: Column) -> Column:
    """Declared type without its parameters, else by extension; null where neither tells."""
    # Extensions and their types.
    known = {
        "txt": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html",
        "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    }
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    said = F.lower(F.trim(F.split(declared, ";")[0]))
    extension = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    return F.coalesce(F.when(F.length(said) > 0, said), F.try_element_at(table, extension))


def snippet(text: Column, size: int = 240) -> Column:
    """Trimmed text, cut to ``size`` characters with an ellipsis."""
    bare = F.trim(text)
    return F.when(F.char_length(bare) > size, F.concat(F.rtrim(F.substring(bare, 1, size)), F.lit("…"))).otherwise(bare)


def text_config(lang: Column) -> Column:
    """Analyzer of a language label: turkish, english or simple."""
    head = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(head == "tr", "turkish").when(head == "en", "english").otherwise("simple")


# Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "xx", "zxx", "mis", "?")


def names_language(lang: Column) -> Column:
    """Whether a label names a language; never null."""
    return F.coalesce(~F.lower(F.trim(lang)).isin(*NO_LANGUAGE), F.lit(False))
