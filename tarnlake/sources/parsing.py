"""Bytes to text: decoding, and parsers for plain text, Markdown, HTML, DOCX and PDF."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.session import prepare

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedMediaType(ValueError):
    """No parser for a media type."""


def decode(data: bytes) -> str:
    """UTF-8 with or without mark, else Windows Turkish, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1254"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class _Page(HTMLParser):
    _hidden = frozenset(("script", "style", "noscript"))
    _inline = frozenset("a abbr b bdi cite code em i kbd mark q s small span strong sub sup u var font tt".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = [""]
        self.title = self.heading = ""
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            self.blocks[-1] += " " if tag == "br" else ""
            return
        self.inside.append(tag)
        if tag not in self._inline:
            self.blocks.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        if tag not in self._inline:
            self.blocks.append("")

    def handle_data(self, data: str) -> None:
        if self._hidden & set(self.inside):
            return
        if "title" in self.inside:
            self.title += data
            return
        if "h1" in self.inside:
            self.heading += data
        self.blocks[-1] += data


def parse_html(text: str) -> tuple[str, str | None]:
    """Block texts joined by blank lines, and the title (of the page, else its first heading)."""
    page = _Page()
    page.feed(text)
    page.close()
    blocks = [b for b in (" ".join(x.split()) for x in page.blocks) if b]
    title = " ".join((page.title or page.heading).split())
    return "\n\n".join(blocks), title or None


def parse_docx(data: bytes) -> tuple[str, str | None]:
    """Paragraphs, and table rows with tabs between cells; the title from the document's properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        title = None
        if "docProps/core.xml" in z.namelist():
            found = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
            title = found.text if found is not None else None

    def words(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    parts: list[str] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            parts.append(words(node))
        elif node.tag == f"{_W}tbl":
            parts += ["\t".join(words(c) for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return "\n\n".join(p for p in parts if p), title


def parse_pdf(data: bytes) -> tuple[str, str | None]:
    """Page texts joined by blank lines; needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise UnsupportedMediaType("application/pdf needs pypdf") from missing
    reader = PdfReader(io.BytesIO(data))
    text = "\n\n".join(p.extract_text() or "" for p in reader.pages)
    return text, reader.metadata.title if reader.metadata else None


def parse(data: bytes, media_type: str | None, filename: str = "") -> tuple[str, str]:
    """Text and title of a file of a known media type."""
    if media_type == "text/html":
        text, title = parse_html(decode(data))
    elif media_type == DOCX:
        text, title = parse_docx(data)
    elif media_type == "application/pdf":
        text, title = parse_pdf(data)
    elif media_type in ("text/plain", "text/markdown"):
        text = tidy(decode(data))
        first = text.split("\n", 1)[0].strip()
        if media_type == "text/markdown":
            head = re.search(r"^# +(.+)$", text, re.MULTILINE)
            title = head.group(1).strip() if head else None
        else:
            title = first if 1 <= len(first) <= 120 else None
    else:
        raise UnsupportedMediaType(str(media_type))
    stem = re.sub(r"[_-]+", " ", filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip()
    return tidy(text), (title or "").strip() or stem


def parsed(files: DataFrame) -> DataFrame:
    """path, content, declared -> path, media_type, title, text, error; a file that fails carries its error and no text."""
    prepare(files.sparkSession)
    rows = files.select("path", "content", T.media_type(F.col("declared"), F.col("path")).alias("media_type"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    text, title = parse(data or b"", kind, path)
                    out.append((path, kind, title, text, None if text else "no text"))
                except Exception as failed:  # noqa: BLE001  one bad file must not fail the batch
                    out.append((path, kind, None, None, f"{type(failed).__name__}: {failed}"[:2000]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "media_type", "title", "text", "error"])

    return rows.mapInArrow(run, "path string, media_type string, title string, text string, error string")
