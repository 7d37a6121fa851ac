"""Markup residue in texts (problem 7): clean text, and which kinds of markup had to be turned for it.

Consensus host paths: every HTML text's containers are scored (text against links, by tag and class), and
every page votes for or against each of its generalised tag-class paths (digits in class names read as #).
Spark counts the votes per host; a path wins unless more pages are against it than for it.  Texts are then
extracted again along the winning paths of their host, so link bars, menus and the like fall away.

The extraction reads code, LaTeX, HTML, wiki and Markdown in this order and notes a kind where it turns
something of it; headings become lines with leading #, list items lines with "- ", code blocks stay as
fenced blocks, formulas as $...$.

Texts without any marker character never leave the JVM; their clean text is the text itself.  Votes are
few, so they go to the texts and not the texts to the votes: the losing paths are broadcast after a count,
and beyond MOST_PATHS of them every host is split into salted parts for a shuffle join.

Defined results: null text has no kinds and null clean text; code inside code blocks shows no kind and is
kept letter for letter; text that is cut off inside a tag or block is read to its end; a page of which the
vote leaves nothing keeps all of its text; a null host is a host of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import checkpointed, prepare

# HTML tag names.
TAGS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del "
    "details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "kbd label legend li link main map mark math meta nav noscript object ol option p param pre q ref references s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr nowiki "
    "syntaxhighlight gallery"
)
_TAG = re.compile(r"</?(?:" + "|".join(TAGS.split()) + r")(?:\s[^<>]*)?/?>|<!--.*?(?:-->|\Z)|<!doctype[^>]*>", re.IGNORECASE | re.DOTALL)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_CODE = re.compile(
    r"(?P<fence>^[ \t]*(?P<ticks>`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*(?P=ticks)[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>.*?(?:</pre>|\Z))"
    r"|(?P<code><(?P<cname>code|syntaxhighlight|nowiki|source)\b[^>]*>.*?(?:</(?P=cname)>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}.*?(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<tick>(?<!`)`(?!`)[^`\n]+`(?!`))",
    re.DOTALL | re.MULTILINE | re.IGNORECASE,
)
_MARKDOWN = (
    re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.MULTILINE),
    re.compile(r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+?(?<=\S)~~"),
    re.compile(r"(?<![\w*(])\*(?=[^\s*)])[^*\n]+?(?<=[^\s*(])\*(?![\w*)])"),
    re.compile(r"!?\[[^\[\]\n]*\]\((?:[a-z][a-z0-9+.-]*:|#|/|\.|[\w/-]+\.\w)[^()\s]*(?:\s+\"[^\"\n]*\")?\)"),
    re.compile(r"\[\^[^\]\s]+\]"),
    re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.MULTILINE),
    re.compile(r"^[^\s=\-|<{][^\n]*\n={3,}[ \t]*$", re.MULTILINE),
    re.compile(r"^[^\s=\-|<{\d][^\n|]*\n-{4,}[ \t]*$", re.MULTILINE),
)
_WIKI = (
    re.compile(r"^={2,6}[ \t]*[^=\s][^\n]*?[ \t]*={2,6}[ \t]*$", re.MULTILINE),
    re.compile(r"\[\[[^\[\]\n]+(?:\]\]|\n|\Z)"),
    re.compile(r"\{\{[^{}\n]+(?:\}\}|\n|\Z)"),
    re.compile(r"^\{\||^\|\}|^\|-(?!-)[^|\n]*$", re.MULTILINE),
    re.compile(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+[ \t][^\[\]\n]*\](?!\()"),
    re.compile(r"(?<!')'{2,5}(?=[^\s'])[^'\n]*(?:'(?!')[^'\n]*)*?(?<=[^\s'])'{2,5}(?!')"),
)
_LATEX = (
    re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    re.compile(r"\$\$[^$]+(?:\$\$|\Z)"),
    re.compile(r"(?<![\w$\\])\$(?=[^\s\d$])[^$\n]*?(?<![\s$])\$(?![\w$])"),
    re.compile(r"(?<![\w$\\])\$[^$\n]*(?:\\[a-zA-Z]+|[_^]\{?\w)[^$\n]*\$(?![\w$])"),
    re.compile(r"\\\[[^\n]|\\\([^\n]"),
    re.compile(r"\{\\[a-zA-Z]+[ {]"),
    re.compile(r"^[ \t]*\\(?:item|maketitle|noindent|newpage|par)\b", re.MULTILINE),
)
#: Java pattern of the marker characters; texts without a match hold no markup.
MARKER = r"[<&`\[{$\\]|\*[^\s)]|__|~~|''|(?m)^ {0,3}#{1,6}\s|(?m)^={2,}|(?m)^-{3,}|(?m)^\s*\|"

KINDS = ("html", "markdown", "wiki", "latex")
MOST_PATHS = 200_000  # losing paths that may be broadcast


def _has_entity(text: str) -> bool:
    return "&" in text and any(m.group(1)[0] == "#" or m.group(1) + ";" in html5 for m in _ENTITY.finditer(text))


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("article aside blockquote body dd div dl dt fieldset figure footer form header li main nav ol p pre section table td th tr ul h1 h2 h3 h4 h5 h6 title".split())
_HIDDEN = frozenset("script style noscript template head".split())
_POOR = frozenset("nav footer aside form button select".split())


# Private-use characters stand for structure while a text is read, so that one kind's output is not taken for another's markup.
_OPEN, _SHUT, _HEAD, _ITEM, _FENCE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_PRIVATE = re.compile("[\ue000-\ue004]")


class _Walker(HTMLParser):
    """Reads an HTML text into pieces (path, text, linked characters) in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.pieces: list[list] = []
        self.hidden = 0
        self.link = 0
        self.pre = 0

    def path(self) -> str:
        return ">".join(step for tag, step in self.stack if tag in _BLOCKS)

    def _piece(self, text: str, linked: bool = False) -> None:
        p = self.path()
        if self.pieces and self.pieces[-1][0] == p and not self.pieces[-1][3]:
            self.pieces[-1][1] += text
            self.pieces[-1][2] += len(text) if linked else 0
        else:
            self.pieces.append([p, text, len(text) if linked else 0, False])

    def _close(self) -> None:
        if self.pieces:
            self.pieces[-1][3] = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._piece("\n")
            elif tag == "img":
                alt = dict(attrs).get("alt")
                if alt and not self.hidden:
                    self._piece(alt)
            return
        if tag == "p" and any(t == "p" for t, _ in self.stack):
            self.handle_endtag("p")
        if tag == "li" and self.stack and self.stack[-1][0] == "li":
            self.handle_endtag("li")
        name = dict(attrs).get("class") or ""
        step = tag + "".join("." + re.sub(r"\d+", "#", c) for c in name.split())
        if tag in _BLOCKS:
            self._close()
        self.stack.append((tag, step))
        self.hidden += tag in _HIDDEN
        self.link += tag == "a"
        if tag == "pre":
            self.pre += 1
            self._piece(f"\n{_FENCE}\n")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._piece(_HEAD * int(tag[1]) + " ")
        elif tag == "li":
            self._piece(_ITEM)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            if tag == "pre" and self.stack[-1][0] == "pre":
                self.pre -= 1
                self._piece(f"\n{_FENCE}\n")
            t, _ = self.stack.pop()
            self.hidden -= t in _HIDDEN
            self.link -= t == "a"
            if t in _BLOCKS:
                self._close()
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            self._piece(data if self.pre else re.sub(r"[^\S\n]+", " ", data), bool(self.link))


def _walk(text: str) -> list[list]:
    walker = _Walker()
    walker.feed(text)
    walker.close()
    return walker.pieces


def container_scores(text: str) -> dict[str, float]:
    """Score of each generalised container path of an HTML text: plain characters less linked ones, poor containers negative."""
    scores: dict[str, float] = {}
    for path, piece, linked, _ in _walk(text):
        size = len(piece.strip())
        if not size or not path:
            continue
        value = size - 3.0 * linked
        if any(step.split(".")[0] in _POOR for step in path.split(">")):
            value = -float(size)
        scores[path] = scores.get(path, 0.0) + value
    return scores


def _html_text(text: str, losing: frozenset[str]) -> str:
    pieces = [p for p in _walk(text) if p[0] not in losing]
    if not pieces:
        pieces = _walk(text)  # the vote leaves nothing of this page, so all of it is kept
    out = []
    for _, piece, _, closed in pieces:
        out.append(piece)
        if closed:
            out.append("\n")
    return "".join(out)


def _entities(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _until_still(pattern: str, to: str, text: str) -> str:
    """Replaces from the inside out, however deep the nesting."""
    n = 1
    while n:
        text, n = re.subn(pattern, to, text)
    return text


def _wiki_text(text: str) -> str:
    text = re.sub(r"^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*={2,6}[ \t]*$", lambda m: _HEAD * len(m.group(1)) + " " + m.group(2), text, flags=re.MULTILINE)
    text = _until_still(r"\{\{[^{}]*\}\}\n?", "", text)  # templates may nest
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+[ \t]+([^\[\]\n]*)\](?!\()", r"\1", text)
    text = re.sub(r"(?<!')'{2,5}(?=[^\s'])([^\n]*?)(?<=[^\s'])'{2,5}(?!')", r"\1", text)
    text = re.sub(r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?", "", text, flags=re.MULTILINE)
    text = re.sub(r"^[!|][ \t]*([^\n]*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", "\t", m.group(1)), text, flags=re.MULTILINE)
    return re.sub(r"^\*{1,4}[ \t]+(?=\S)|^\*{1,4}(?=\[\[)", _ITEM, text, flags=re.MULTILINE)


def _markdown_text(text: str) -> str:
    text = re.sub(r"^([^\s=\-|<{][^\n]*)\n={3,}[ \t]*$", _HEAD + r" \1", text, flags=re.MULTILINE)
    text = re.sub(r"^([^\s=\-|<{\d][^\n|]*)\n-{4,}[ \t]*$", _HEAD * 2 + r" \1", text, flags=re.MULTILINE)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[\^[^\]\s]+\]:?", "", text)
    text = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*", r"\1", text)
    text = re.sub(r"(?<!\w)__(?=\S)([^_\n]+?)(?<=\S)__(?!\w)", r"\1", text)
    text = re.sub(r"~~(?=\S)([^~\n]+?)(?<=\S)~~", r"\1", text)
    text = re.sub(r"(?<![\w*(])\*(?=[^\s*)])([^*\n]+?)(?<=[^\s*(])\*(?![\w*)])", r"\1", text)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\n?", "", text, flags=re.MULTILINE)
    text = re.sub(r"^[ \t]*\|([^\n]*)\|[ \t]*$", lambda m: re.sub(r"[ \t]*\|[ \t]*", "\t", m.group(1)).strip(), text, flags=re.MULTILINE)
    return re.sub(r"^[ \t]*[*+][ \t]+", "- ", text, flags=re.MULTILINE)


def _latex_text(text: str) -> str:
    level = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    text = re.sub(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}", lambda m: _HEAD * level[m.group(1)] + " " + m.group(2), text)
    text = re.sub(r"\\begin\{(?:equation|align|displaymath|math)\*?\}(.*?)\\end\{(?:equation|align|displaymath|math)\*?\}", lambda m: "$" + m.group(1).strip() + "$", text, flags=re.DOTALL)
    text = re.sub(r"\\\[(.*?)\\\]", lambda m: "$" + m.group(1).strip() + "$", text, flags=re.DOTALL)
    text = re.sub(r"\\\((.*?)\\\)", lambda m: "$" + m.group(1).strip() + "$", text, flags=re.DOTALL)
    text = re.sub(r"\$\$([^$]+)\$\$", lambda m: "$" + m.group(1).strip() + "$", text)
    text = re.sub(r"\{\\(?:displaystyle|textstyle)\s+((?:[^{}]|\{[^{}]*\})*)\}", lambda m: "$" + m.group(1).strip() + "$", text)
    text = re.sub(r"^[ \t]*\\item\b[ \t]*", _ITEM, text, flags=re.MULTILINE)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}[ \t]*\n?", "", text)
    text = re.sub(r"\\(?:cite|ref|label|footnotemark)[a-z]*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    parts = re.split(r"(\$[^$\n]*\$)", text)  # formulas keep their commands
    for k in range(0, len(parts), 2):
        parts[k] = _until_still(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", parts[k])
    return "".join(parts)


_FORMULA = re.compile(r"\$[^$\n]*\$")


def extract(text: str, losing: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """Clean text, read along the paths that do not lose, and the kinds of markup that were turned."""
    kinds: set[str] = set()
    kept: list[str] = []

    def put(body: str) -> str:
        kept.append(body)
        return f"{_OPEN}{len(kept) - 1}{_SHUT}"

    def code(m: re.Match) -> str:
        body = m.group()
        kinds.add("markdown" if m.group("fence") or m.group("tick") else "latex" if m.group("verb") else "html")
        if m.group("tick"):
            return put(body.strip("`"))
        if m.group("fence"):
            body = re.sub(r"^[ \t]*(?:`{3,}|~{3,})[^\n]*\n?|\n?[ \t]*(?:`{3,}|~{3,})[ \t]*$", "", body)
        elif m.group("verb"):
            body = re.sub(r"^\\begin\{[^{}]*\}\n?|\n?\\end\{[^{}]*\}$", "", body)
        else:
            body = html.unescape(re.sub(r"</?(?:pre|code|syntaxhighlight|nowiki|source)\b[^>]*>", "", body, flags=re.IGNORECASE))
        whole = put("```\n" + body.strip("\n") + "\n```")
        return f"\n{whole}\n" if "\n" in m.group() or not m.group("code") else f" {whole} "

    def back(t: str) -> str:
        return re.sub(f"{_OPEN}(\\d+){_SHUT}", lambda m: back(kept[int(m.group(1))]), t)

    text = _PRIVATE.sub(" ", text)
    if "`" in text or "<" in text or "~~~" in text or "\\begin" in text:
        text = _CODE.sub(code, text)
    tagged = "<" in text and _TAG.search(text) is not None
    bare = _TAG.sub(" ", text) if tagged else text
    if any(rx.search(bare) for rx in _LATEX):
        kinds.add("latex")
        text = _FORMULA.sub(lambda m: put(m.group()), _latex_text(text))
    if tagged or _has_entity(text):
        kinds.add("html")
        escaped = "&" in text
        text = _html_text(text, losing) if tagged else _entities(text)
        if escaped:  # tags that stood escaped in the text
            text = _TAG.sub("", _entities(text))
    if any(rx.search(text) for rx in _WIKI):
        kinds.add("wiki")
        text = _wiki_text(text)
    if any(rx.search(text) for rx in _MARKDOWN):
        kinds.add("markdown")
        text = _markdown_text(text)
    if not kinds:
        return text, []
    text = back(text.replace(_HEAD, "#").replace(_ITEM, "- ").replace(_FENCE, "```"))
    text = re.sub(r"[ \t\xa0]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), [k for k in KINDS if k in kinds]


def host_votes(rows: DataFrame) -> DataFrame:
    """Votes on every generalised path per host, one a page: host, path, votes_for, votes_against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str | None, str], list[int]] = {}
            for host, text in zip(b.column("host").to_pylist(), b.column("text").to_pylist(), strict=True):
                if _TAG.search(text):
                    for path, value in container_scores(text).items():
                        votes.setdefault((host, path), [0, 0])[value < 0] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in votes], pa.string()),
                    pa.array([k[1] for k in votes], pa.string()),
                    pa.array([v[0] for v in votes.values()], pa.int64()),
                    pa.array([v[1] for v in votes.values()], pa.int64()),
                ],
                names=["host", "path", "votes_for", "votes_against"],
            )

    html_rows = rows.filter(F.col("text").contains("<")).select("host", "text")
    votes = html_rows.mapInArrow(run, "host string, path string, votes_for bigint, votes_against bigint")
    return votes.groupBy("host", "path").agg(F.sum("votes_for").alias("votes_for"), F.sum("votes_against").alias("votes_against"))


def with_losing_paths(rows: DataFrame, votes: DataFrame, most_paths: int = MOST_PATHS, parts: int = 64) -> DataFrame:
    """Rows with an array of the paths that lose in their host (null: none does)."""
    lost = votes.filter(F.col("votes_against") > F.col("votes_for")).select(F.coalesce("host", F.lit("")).alias("_host"), "path")
    by_host = lost.groupBy("_host").agg(F.array_sort(F.collect_set("path")).alias("losing"))
    rows = rows.withColumn("_host", F.coalesce("host", F.lit("")))
    if lost.limit(most_paths + 1).count() <= most_paths:
        return rows.join(F.broadcast(by_host), "_host", "left").drop("_host")
    salted = by_host.withColumn("_part", F.explode(F.array(*map(F.lit, range(parts)))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).join(salted, ["_host", "_part"], "left").drop("_host", "_part")


def clean_markup(rows: DataFrame) -> DataFrame:
    """Kinds and clean text of every row: src, item_id, kinds, clean.

    ``rows``: src, item_id (bigint), host, text.
    """
    prepare(rows.sparkSession)
    rows = rows.select("src", "item_id", "host", "text")
    marked = F.col("text").rlike(MARKER)
    candidates = rows.filter(marked)
    votes = checkpointed(host_votes(candidates))  # a row per host and path
    joined = with_losing_paths(candidates, votes).select("src", "item_id", "text", "losing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost = [frozenset(x or ()) for x in b.column("losing").to_pylist()]
            found = [extract(t, x) for t, x in zip(b.column("text").to_pylist(), lost, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("src"), b.column("item_id"), pa.array([k for _, k in found], pa.list_(pa.string())), pa.array([c for c, _ in found], pa.string())],
                names=["src", "item_id", "kinds", "clean"],
            )

    cleaned = joined.mapInArrow(run, "src string, item_id bigint, kinds array<string>, clean string")
    plain = rows.filter(F.coalesce(~marked, F.lit(True))).select("src", "item_id", F.array().cast("array<string>").alias("kinds"), F.col("text").alias("clean"))
    return cleaned.unionByName(plain)
