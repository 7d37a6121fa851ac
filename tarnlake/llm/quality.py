"""Per-document text statistics and the split of prose from lists, tables and junk (problem 10).

One Arrow pass per document, no shuffle.  Each document yields counts (words, mean word length,
symbol share, share of lines that end in punctuation, share of common words), repetition figures
(share of repeated lines and paragraphs, character share of the most frequent word pairs and
triples) and the share of its characters that stand in prose, boilerplate, list entries, table rows and
junk.  The kind follows from both: what the lines look like as prose is boilerplate where the repetition
figures speak against it, namely the further copies of sentences that make up a tenth of the prose and
stand there COPIES times or more, and whole lines or texts that one pair of words dominates.

Defined results: null text gives null figures and kind; empty or blank text gives zeros and a null
kind; a text that is all markup is prose.  Whole texts are read whatever their length.  Repeated ids give
repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.session import prepare, spread

# Frequent function words of the collection's languages.
COMMON_WORDS = frozenset(
    """
    the of and to in is for by be on with are that this not as at from may
    ve ile bir bu için en olarak daha tarafından veya gün içinde hâlinde her çok ise göre kadar fakat ancak ay hafta süre kişi üzerinden yalnızca
    der die das und in den von zu mit für nicht wer auf werden dem über muss
    le la les et de des du est que pour dans sur une par qui au
    el los las y del que en para por un una con se quien
    il lo gli di che per della non chi entro sono e i
    o os as e do da dos das em não quem num à um
    het een van voor niet wie moet op te dat worden aan
    və bu üçün bir da hər ilə yalnız görə
    и в на не что для кто о по только когда этого
    في من على إلى أن لا عن التي ما إلا إذا ذلك
    है के को की में से ने और का नहीं जो पर
    """.split()
)

_WORD_EDGE = ".,;:!?…\"'“”„«»()[]{}<>*_~`|"
_SENTENCE_END = re.compile(r"[.!?。！？।؟…:;](?:[\"”“’»」』)\]*_~}`']|\[[^\]\n]*\]|</?\w+ ?/?>)*$")
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>\n]{0,300}>|<!--.*?-->")
_MARKUP_LINE = re.compile(
    r"(?:#{1,6} .*|={1,6} .* ={1,6}|[=\-~_*]{3,}|\\(?:begin|end|sub|section|chapter|item)\b.*|```.*|\{\|.*|\|\}|\|-|!\s*\w.*!!.*|\|[\s:|\-]+\|?|\{\{.*\}\}|<h\d[^<>]*>[^<]*</h\d>)$",
    re.IGNORECASE,
)
_BULLET = re.compile(r"(?:[–—•*\-·▪◦]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\d+(?:\.\d+)+\.?)\s+")
_LEADER = re.compile(r"\.{3,}\s*\d+$|…{2,}\s*\d+$")
_MOJIBAKE = re.compile("[\x80-\x9f�Ã¤±¼¶ŸÅ]")
_WIDE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_VOWEL_SIGN = re.compile("[\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]")
_MACHINE = re.compile(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b0x[0-9a-fA-F]+\b|^[0-9a-f]{8}\s+(?:[0-9a-f]{2}\s+){3}|^\s+at [\w.$]+\(|^[{\[].*[\]}],?$")
_LETTER = re.compile(r"[^\W\d_]")
_VOWEL = re.compile("[aeiouyıöüâêîôûáéíóúàèìòùãõäəëïœæåаеёиоуыэюя]", re.IGNORECASE)
_INNER_END = re.compile(r"[a-zà-ÿğışçöüəа-я\d][.!?] [A-ZÀ-ÝĞİŞÇÖÜƏА-Я]")
_GAPS = re.compile(r"\s{2,}")
_BLANK_LINES = re.compile(r"\n[^\S\n]*\n")

_UNIT = re.compile(r"[^.!?。！？।؟…\n]+")

KINDS = ("prose", "boilerplate", "list", "table", "junk")
COPIES = 5  # a sentence with fewer copies is no boilerplate
DOMINANT = 0.5  # share of a line's or text's characters in one repeated pair of words


def _cells(line: str) -> int:
    """Number of short cells in a line, 1 where it holds no table row."""
    for sep, least in (("\t", 2), ("│", 2), ("|", 3)):
        if sep in line:
            n = line.count(sep) + 1
            if n >= least:
                return n
    for sep in (",", ";"):
        n = line.count(sep)
        if n >= 2 and line.count(sep + " ") * 2 < n and len(line) < 60 * (n + 1):
            return n + 1
    return len(_GAPS.split(line)) if "  " in line else 1


def _senseless(line: str) -> bool:
    """True for noise, encoded or broken characters, random letters, endless repetition, machine output."""
    n = len(line)
    packed = n - line.count(" ")
    if packed == 0:
        return False
    if _WIDE.search(line):
        return len(_LETTER.findall(line)) + len(_WIDE.findall(line)) < 0.4 * packed
    letters = len(_LETTER.findall(line))
    if packed >= 8 and letters < 0.5 * packed:
        return True
    if len(_MOJIBAKE.findall(line)) > 0.05 * packed + 1 or _MACHINE.search(line):
        return True
    words = line.split()
    if packed > 40 * len(words):
        return True
    if len(words) >= 12:
        single = sum(len(w) == 1 for w in words)
        if single > 0.6 * len(words):
            return True
    if letters >= 20 and line.isascii() | bool(re.search("[a-zA-Z]", line)):
        latin = len(re.findall("[a-zA-Z]", line))
        if latin > 0.5 * letters and len(_VOWEL.findall(line)) < 0.26 * letters:
            return True
    return False


def _dominated(words: list[str]) -> bool:
    """True where one pair of words, repeated, makes up most of the characters."""
    return len(words) >= 12 and _top_share(words, 2, sum(map(len, words))) >= DOMINANT


def boilerplate_chars(lines: list[str]) -> int:
    """Characters in the further copies of sentences that recur and make up a good part of the lines."""
    units = [u for line in lines for u in map(str.strip, _UNIT.findall(line)) if u]
    if len(units) < COPIES:
        return 0
    least = 0.1 * sum(map(len, units))
    return sum(len(u) * (k - 1) for u, k in Counter(units).items() if k >= COPIES and k * len(u) >= least)


def classify_lines(text: str, common_share: float) -> tuple[int, int, int, int, int]:
    """Characters of a text in prose, boilerplate, list entries, table rows and junk; headings and markup lines count as none."""
    prose = boilerplate = listed = table = junk = 0
    prose_lines: list[str] = []
    suspect = common_share < 0.04 or len(_MOJIBAKE.findall(text)) > 0.03 * len(text)
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    entries: list[tuple[int, int, bool, str]] = []  # the current run of short lines: length, words, goes on from the line before, text
    rows: list[str] = []

    def close_entries(by_sentence: bool = False) -> None:
        nonlocal prose, listed
        size = sum(e[0] for e in entries)
        k = len(entries)
        # hard-wrapped prose: lines of several words that go on in small letters until a sentence ends
        wrapped = by_sentence and sum(e[1] for e in entries) >= 4 * k and 3 * sum(e[2] for e in entries) >= k
        if k >= 3 and not wrapped:
            listed += size
        else:
            prose += size
            prose_lines.extend(e[3] for e in entries)
        entries.clear()

    def close_rows() -> None:
        nonlocal prose, table
        size = sum(map(len, rows))
        if len(rows) >= 2:
            table += size
        else:
            prose += size
            prose_lines.extend(rows)
        rows.clear()

    for line in lines:
        if not suspect and len(line) > 40 and 5 <= line.count(" ") < len(line) / 3 and "\t" not in line and _SENTENCE_END.search(line):
            if entries:
                close_entries(True)
            if rows:
                close_rows()
            prose += len(line)
            prose_lines.append(line)
            continue
        bare = _TAG.sub("", line).strip() if "<" in line else line
        if not bare or _MARKUP_LINE.match(line):
            continue
        n = len(bare)
        ended = bool(_SENTENCE_END.search(bare))
        marker = _BULLET.match(bare)
        entry = bare[marker.end() :] if marker else bare
        n_words = entry.count(" ") + 1
        packed = n - bare.count(" ")
        if packed >= 8 and sum(map(str.isalnum, bare)) < 0.35 * packed and not _LEADER.search(bare):
            if entries:
                close_entries()
            if rows:
                close_rows()
            junk += n
            continue
        cells = _cells(bare)
        if cells >= 3 or (cells == 2 and ("\t" in bare or "│" in bare)):
            if not _MACHINE.search(bare) and n < 60 * cells:
                if entries:
                    close_entries()
                rows.append(bare)
                continue
        if _LEADER.search(bare):
            if rows:
                close_rows()
            entries.append((n, n_words, False, bare))
            continue
        if _senseless(bare):
            if entries:
                close_entries()
            if rows:
                close_rows()
            junk += n
            continue
        inner_end = _INNER_END.search(bare)
        if n_words <= 8 and n <= 90 and not inner_end and not _WIDE.search(bare) and (not ended or bare.endswith((":", ";")) or (marker and n_words <= 6)):
            if rows:
                close_rows()
            entries.append((n, n_words, not marker and bare[0].islower(), bare))
            continue
        if entries:
            close_entries(ended or bool(inner_end))
        if rows:
            close_rows()
        prose += n
        prose_lines.append(bare)
    close_entries()
    close_rows()
    if prose:
        for line in prose_lines:
            if _dominated(line.lower().split()):
                boilerplate += len(line)
        boilerplate = min(prose, max(boilerplate, boilerplate_chars(prose_lines)))
    return prose - boilerplate, boilerplate, listed, table, junk


def _top_share(words: list[str], size: int, total: int) -> float:
    if len(words) <= size or not total:
        return 0.0
    grams = Counter(zip(*(words[i:] for i in range(size)), strict=False))
    gram, count = max(grams.items(), key=lambda kv: (kv[1], kv[0]))
    return min(1.0, count * sum(map(len, gram)) / total) if count > 1 else 0.0


def text_profile(text: str) -> tuple:
    """All figures of one text, in the order of SCHEMA without the id."""
    n = len(text)
    words = text.split()
    n_words = len(words)
    packed = sum(map(len, words))
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    paragraphs = [p for p in (" ".join(x.split()) for x in _BLANK_LINES.split(text)) if p]
    lowered = text.lower().split()
    common = sum(w.strip(_WORD_EDGE) in COMMON_WORDS for w in lowered)
    letters_digits = sum(map(str.isalnum, text))
    if not text.isascii():
        letters_digits += len(_VOWEL_SIGN.findall(text))
    ends = sum(1 for s in lines if _SENTENCE_END.search(s))
    common_share = common / n_words if n_words else 0.0
    pair_share, triple_share = _top_share(lowered, 2, packed), _top_share(lowered, 3, packed)
    prose, boilerplate, listed, table, junk = classify_lines(text, common_share)
    if n_words >= 12 and pair_share >= DOMINANT and not listed and not table:  # also where each line holds few words
        prose, boilerplate = 0, boilerplate + prose
    total = prose + boilerplate + listed + table + junk
    kind = None
    if total:
        kind = "prose" if 2 * prose >= total else max(((listed, "list"), (table, "table"), (junk, "junk"), (boilerplate, "boilerplate")))[1]
    elif packed:
        kind = "prose"
    return (
        n,
        n_words,
        packed / n_words if n_words else 0.0,
        (packed - letters_digits) / packed if packed else 0.0,
        ends / len(lines) if lines else 0.0,
        common_share,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        pair_share,
        triple_share,
        prose / total if total else 0.0,
        boilerplate / total if total else 0.0,
        listed / total if total else 0.0,
        table / total if total else 0.0,
        junk / total if total else 0.0,
        kind,
    )


FIGURES = (
    "n_chars int, n_words int, mean_word_len double, symbol_ratio double, end_punct_share double, common_word_share double, "
    "dup_line_share double, dup_paragraph_share double, top_pair_share double, top_triple_share double, "
    "prose_share double, boilerplate_share double, list_share double, table_share double, junk_share double, kind string"
)
_TYPES = [pa.int32(), pa.int32(), *[pa.float64()] * 13, pa.string()]
_NAMES = [f.split()[0] for f in FIGURES.split(", ")]


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        rows = [text_profile(t.as_py()) if t.is_valid else (None,) * len(_TYPES) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["item_id", *_NAMES]
        )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and kind of every row: item_id plus the columns of FIGURES."""
    prepare(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    id_type = wanted.schema["item_id"].dataType.simpleString()
    return spread(wanted).mapInArrow(_profile_batches, f"item_id {id_type}, {FIGURES}")


def non_prose(stats: DataFrame) -> DataFrame:
    """The rows more than half of which is no prose; boilerplate is a sort of junk (machine output)."""
    kind: Column = F.when(F.col("kind") == "boilerplate", "junk").otherwise(F.col("kind"))
    return stats.filter(F.col("kind") != "prose").withColumn("kind", kind)
