"""Sentence boundaries across languages and scripts (problem 5).

The rules are written once as a step function over small symbolic states and compiled into a table-
driven finite transducer: symbols are character classes and the letters of known abbreviations, and
every character yields one of a few outputs (content, end of a sentence before it, end at the token's
start).  Texts run through the table side by side.  A long text is cut into chunks; each chunk is first
turned into its state-transition function, the functions are composed by a parallel prefix scan, and
then every chunk is run from its now known entry state, so no boundary depends on where the chunks lie.

Rules: end marks of all scripts with closing quotes end a sentence when what follows may start one; a
line break ends a sentence, in Thai also a space; abbreviations, initials, ordinals, decimals, versions
and host names do not; a quoted sentence does not end the larger one around it; citations in square
brackets after the end mark belong to no sentence.

Defined results: null or blank texts have no sentence; positions count code points from 0, the end is
excluded; repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import prepare

# Abbreviations.  A title never ends a sentence; a reference goes on before a number or a
# small letter; an ending abbreviation goes on before a small letter only.
TITLES = "dr prof av mr mrs ms sr sra srta doç yrd uzm ltd cf bkz vgl hr mme mlle डॉ श्री".split()
REFERENCES = "no md art abs sec pág núm fig vol nr bd aprox bzw ca ecl böl çev ст стр п".split()
ENDINGS = "etc vb vs usw inc co corp şti tic san jr u.a".split()
# Months that follow a German ordinal number.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()

OPEN_QUOTES, CLOSE_QUOTES = "“«「『‘", "”»」』’"
LOW_QUOTE, STRAIGHT = "„", '"'
MARKS, WIDE_MARKS = "!?…؟।॥‼⁈⁉", "。！？｡"
CHUNK = 1024

# output bits of a character
CONTENT, END_BEFORE, TOKEN_START, END_AT_TOKEN = 1, 2, 4, 8


@lru_cache(maxsize=1)
def _trie() -> tuple[list[dict[str, int]], dict[int, str]]:
    nodes: list[dict[str, int]] = [{}]
    tags: dict[int, str] = {}
    for tag, words in (("title", TITLES), ("ref", REFERENCES), ("may", ENDINGS), ("month", MONTHS)):
        for word in words:
            at = 0
            for ch in word:
                if ch not in nodes[at]:
                    nodes.append({})
                    nodes[at][ch] = len(nodes) - 1
                at = nodes[at][ch]
            tags[at] = tag
    return nodes, tags


def _alphabet() -> list[str]:
    return sorted({ch for n in _trie()[0] for ch in n if ch != "."})


def _case(ch: str) -> str:
    if ch.isupper() or ch.istitle():
        return "U"
    return "L" if ch.islower() else "K"


@lru_cache(maxsize=1)
def symbols() -> tuple[list[tuple[str, str]], np.ndarray]:
    """All symbols (class, letter) and the symbol of each character of the basic plane; the last symbol is padding."""
    letters = set(_alphabet())
    names: list[tuple[str, str]] = []
    index: dict[tuple[str, str], int] = {}

    def sym(name: tuple[str, str]) -> int:
        if name not in index:
            index[name] = len(names)
            names.append(name)
        return index[name]

    table = np.zeros(0x10000, dtype=np.int16)
    sym(("other", ""))
    for cp in range(0x10000):
        ch = chr(cp)
        low = "i" if ch == "İ" else ch.lower()
        if ch in "\n\r  \x0b\x0c\x85":
            name = ("newline", "")
        elif ch.isspace():
            name = ("space", "")
        elif ch == ".":
            name = ("dot", "")
        elif ch in WIDE_MARKS:
            name = ("wide", "")
        elif ch in MARKS:
            name = ("mark", "")
        elif ch == "[" or ch == "]":
            name = (ch, "")
        elif ch == STRAIGHT:
            name = ("straight", "")
        elif ch in "“":
            name = ("turned", "")
        elif ch == LOW_QUOTE:
            name = ("low", "")
        elif ch in OPEN_QUOTES:
            name = ("open", "")
        elif ch in CLOSE_QUOTES and ch != "’":
            name = ("close", "")
        elif ch in ")）":
            name = ("paren", "")
        elif ch in ",;:،；：，、":
            name = ("comma", "")
        elif ch.isdigit():
            name = ("digit", "")
        elif 0x0E00 <= cp <= 0x0E7F:
            name = ("thai", "")
        elif 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF:
            name = ("han", "")
        elif ch.isalpha() or 0x0900 <= cp <= 0x0DFF or 0x0610 <= cp <= 0x06ED or 0x0300 <= cp <= 0x036F:
            if 0x0300 <= cp <= 0x036F:
                name = ("L", "")
            else:
                name = (_case(ch), low if low in letters else "")
        else:
            name = ("other", "")
        table[cp] = sym(name)
    names.append(("pad", ""))
    return names, table


# A state: (quote, kind, a, b, c)
#   quote: 0 none, 1 “ or « or 「, 2 „, 3 "
#   kind: start | word(node, several letters, caseless) | number | gap | thaigap | other | cite (in sentence) | cited | skip (citation of no sentence)
#         | wait(type, closed, spaced) after an end mark | month(node)
START = (0, "start", 0, 0, 0)


def _step(state: tuple, symbol: tuple[str, str]) -> tuple[tuple, int]:
    quote, kind, a, b, c = state
    cls, letter = symbol
    nodes, tags = _trie()

    def word(node: int, several: int, caseless: int) -> tuple:
        return (quote, "word", node, several, caseless)

    def begin() -> tuple:
        """The state after the first character of a token."""
        if cls in "ULK":
            return word(nodes[0].get(letter, -1) if letter else -1, 0, int(cls == "K"))
        if cls == "digit":
            return (quote, "number", 0, 0, 0)
        if cls == "thai":
            return (quote, "thai", 0, 0, 0)
        return (quote, "other", 0, 0, 0)

    def after_quote_sign() -> tuple | None:
        """The quote state after a quotation mark, with True where it opens; None where the character is none."""
        if cls == "straight":
            return (0, False) if quote == 3 else (3, True) if quote == 0 else (quote, False)
        if cls == "turned":
            return (0, False) if quote == 2 else (1, True)
        if cls == "low":
            return (2, True)
        if cls == "open":
            return (1, True)
        if cls == "close":
            return (0, False)
        return None

    if cls == "pad":
        return state, 0
    if cls == "newline":
        return START, END_BEFORE
    if kind == "skip":
        return ((quote, "start", 0, 0, 0), 0) if cls == "]" else (state, 0)
    if kind == "cite":
        return ((quote, "cited", 0, 0, 0), 0) if cls == "]" else (state, 0)

    if kind == "wait":
        typ, closed, spaced = a, b, c
        if cls == "space":
            return (quote, "wait", typ, closed, 1), 0
        if cls == "[":
            if typ in ("title",):
                return (quote, "cite", 0, 0, 0), 0
            return (0, "skip", 0, 0, 0), END_BEFORE
        if cls in ("dot", "mark", "wide") and not spaced:
            nxt = "wide" if cls == "wide" else "mark" if typ in ("mark", "wide") or cls == "mark" else "dots"
            return (quote, "wait", nxt, closed, 0), CONTENT
        if cls in ("dot", "mark", "wide"):
            return (quote, "wait", "mark", closed, 0), CONTENT
        sign = after_quote_sign()
        if sign is not None and not sign[1] and (quote or not spaced):
            return (sign[0], "wait", typ, 1, 0), CONTENT
        if cls == "paren" and not spaced:
            return (quote, "wait", typ, closed, 0), CONTENT
        if cls == "comma":
            return (quote, "other", 0, 0, 0), CONTENT
        ends = _may_end(typ, closed, spaced, cls, quote)
        if typ == "number" and spaced and not closed and not quote and cls == "U" and letter and letter in nodes[0] and _leads_to_month(nodes[0][letter]):
            return (quote, "month", nodes[0][letter], 0, 0), CONTENT | TOKEN_START
        if ends:
            quote = 0
            if sign is not None:
                return (sign[0] if sign[1] else 0, "other", 0, 0, 0), END_BEFORE | CONTENT
            return begin(), END_BEFORE | CONTENT
        if sign is not None:
            return (sign[0], "other", 0, 0, 0), CONTENT
        return begin(), CONTENT

    if kind == "month":
        if cls in "ULK":
            node = nodes[a].get(letter, -1) if letter else -1
            if node >= 0 and _leads_to_month(node):
                return (quote, "month", node, 1, 0), CONTENT
            return word(node, 1, 0), CONTENT | END_AT_TOKEN
        if tags.get(a) == "month":
            return _step((quote, "word", -1, 1, 0), symbol)
        nxt, out = _step((quote, "word", a, b, 0), symbol)
        return nxt, out | END_AT_TOKEN

    # content or start
    if cls == "space":
        if kind == "start":
            return state, 0
        if kind == "thai":
            return (quote, "thaigap", 0, 0, 0), 0
        if kind in ("cited", "thaigap"):
            return state, 0
        return (quote, "gap", 0, 0, 0), 0
    if cls == "[":
        if kind == "start":
            return (quote, "skip", 0, 0, 0), 0
        if kind == "thaigap":
            return (0, "skip", 0, 0, 0), END_BEFORE
        return (quote, "cite", 0, 0, 0), 0
    end_here = END_BEFORE if kind == "thaigap" and cls != "dot" else 0
    if cls == "dot":
        typ = "plain"
        if kind == "word":
            tag = tags.get(a)
            node = nodes[a].get(".", -1) if a >= 0 else -1
            if tag in ("title", "ref", "may"):
                typ = tag
            elif not b:
                typ = "initial"
            if node >= 0:
                typ = "initial"
        elif kind == "number":
            typ = "number"
        return (quote, "wait", typ, 0, 0), CONTENT
    if cls in ("mark", "wide"):
        return (quote, "wait", cls, 0, 0), CONTENT | end_here
    sign = after_quote_sign()
    if sign is not None:
        return (sign[0], "other", 0, 0, 0), CONTENT | end_here
    if kind == "word" and cls in "ULK":
        node = nodes[a].get(letter, -1) if a >= 0 and letter else -1
        return word(node, 1, c), CONTENT
    if kind == "word" and cls == "digit":
        return (quote, "number", 0, 0, 0), CONTENT
    return begin(), CONTENT | end_here


@lru_cache(maxsize=None)
def _leads_to_month(node: int) -> bool:
    nodes, tags = _trie()
    return tags.get(node) == "month" or any(_leads_to_month(n) for n in nodes[node].values())


def _may_end(typ: str, closed: int, spaced: int, cls: str, quote: int) -> bool:
    """Whether the sentence ends, given what stands at its end mark and the class of the next character."""
    if quote:
        return False  # still inside a quotation
    if cls == "han":
        return not closed and typ in ("wide", "mark")
    if typ == "wide" and not closed:
        return True
    if cls == "L":
        return False
    if closed and (cls == "K" or not spaced) and cls != "U":
        return False
    if not spaced:
        if cls == "U":
            return closed == 1 or typ in ("plain", "mark", "number")
        if cls in ("K", "thai"):
            return typ in ("plain", "mark")
        return cls in ("straight", "turned", "low", "open") and typ in ("mark", "wide")
    if typ in ("title", "initial"):
        return False
    if typ == "ref":
        return cls != "digit" and cls not in ("other", "paren")
    return True


@lru_cache(maxsize=1)
def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """The tables next[state, symbol] and output[state, symbol], by exploring all reachable states; state 0 starts."""
    names, _ = symbols()
    index = {START: 0}
    order = [START]
    nexts: list[list[int]] = []
    outs: list[list[int]] = []
    k = 0
    while k < len(order):
        row, out = [], []
        for symbol in names:
            state, o = _step(order[k], symbol)
            if state not in index:
                index[state] = len(order)
                order.append(state)
            row.append(index[state])
            out.append(o)
        nexts.append(row)
        outs.append(out)
        k += 1
    return np.array(nexts, dtype=np.int16), np.array(outs, dtype=np.int8)


def _encode(text: str, table: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return table[np.where(raw < 0x10000, raw, 0x2022)]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The state-transition function of one chunk followed by another."""
    return np.take_along_axis(then, first.astype(np.int64), axis=-1)


def chunk_functions(chunks: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """For each chunk the state reached from every state; states that have met are carried once."""
    n_states = nexts.shape[0]
    out = np.empty((len(chunks), n_states), dtype=np.int16)
    for i, row in enumerate(chunks):
        inverse = np.arange(n_states)
        live = np.arange(n_states, dtype=np.int64)
        for j, symbol in enumerate(row):
            live = nexts[live, symbol].astype(np.int64)
            if len(live) > 1 and (j & 7) == 7:
                live, back = np.unique(live, return_inverse=True)
                inverse = back[inverse]
        out[i] = live[inverse]
    return out


def entry_states(functions: np.ndarray) -> np.ndarray:
    """Entry state of each chunk of one text, by a parallel prefix scan over the chunks' functions."""
    prefix = functions.copy()
    step = 1
    while step < len(prefix):
        prefix[step:] = compose(prefix[:-step], prefix[step:])
        step *= 2
    return np.concatenate(([0], prefix[:-1, 0]))


def outputs(texts: list[str], nexts: np.ndarray, outs: np.ndarray, table: np.ndarray, chunk: int = CHUNK) -> list[np.ndarray]:
    """Output bits of every character of every text."""
    pad = nexts.shape[1] - 1
    encoded = [_encode(t, table) for t in texts]
    rows: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []
    entries: list[int] = []
    for i, e in enumerate(encoded):
        parts = [e[k : k + chunk] for k in range(0, len(e), chunk)]
        if len(parts) > 1:
            states = entry_states(chunk_functions([*parts[:-1], parts[-1][:0]], nexts))
        else:
            states = [0] * len(parts)
        for k, (p, s) in enumerate(zip(parts, states, strict=True)):
            rows.append(p)
            owner.append((i, k))
            entries.append(int(s))
    result = [np.empty(len(e), dtype=np.int8) for e in encoded]
    order = sorted(range(len(rows)), key=lambda r: len(rows[r]))
    for lo in range(0, len(order), 2048):
        group = order[lo : lo + 2048]
        width = max(len(rows[r]) for r in group)
        block = np.full((width, len(group)), pad, dtype=np.int64)
        for col, r in enumerate(group):
            block[: len(rows[r]), col] = rows[r]
        state = np.array([entries[r] for r in group], dtype=np.int64)
        got = np.empty((width, len(group)), dtype=np.int8)
        for j in range(width):
            symbol = block[j]
            got[j] = outs[state, symbol]
            state = nexts[state, symbol].astype(np.int64)
        for col, r in enumerate(group):
            i, k = owner[r]
            result[i][k * chunk : k * chunk + len(rows[r])] = got[: len(rows[r]), col]
    return result


def spans(bits: np.ndarray) -> list[tuple[int, int]]:
    """Sentence spans from the output bits of one text."""
    late = np.flatnonzero(bits & END_AT_TOKEN)
    if len(late):
        starts = np.flatnonzero(bits & TOKEN_START)
        bits = bits.copy()
        for p in late:
            bits[starts[np.searchsorted(starts, p, side="right") - 1]] |= END_BEFORE
    content = np.flatnonzero(bits & CONTENT)
    if not len(content):
        return []
    number = np.cumsum((bits & END_BEFORE) != 0)[content]
    first = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
    last = np.append(first[1:], len(content)) - 1
    return [(int(content[a]), int(content[b]) + 1) for a, b in zip(first, last, strict=True)]


def split_texts(texts: list[str | None], chunk: int = CHUNK) -> list[list[tuple[int, int]]]:
    """Sentence spans of each text."""
    nexts, outs = compile_transducer()
    _, table = symbols()
    return [spans(b) for b in outputs([t or "" for t in texts], nexts, outs, table, chunk)]


def sentence_units(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: the other columns of ``rows`` with start_pos and end_pos."""
    spark = rows.sparkSession
    prepare(spark)
    kept = [c for c in rows.columns if c not in (text, "start_pos", "end_pos")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    shared = spark.sparkContext.broadcast((*compile_transducer(), symbols()[1]))  # fixed by the rules, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nexts, outs, table = shared.value
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for lo in range(0, batch.num_rows, 2048):
                part = whole.slice(lo, 2048)
                found = [spans(b) for b in outputs([t or "" for t in part.column(text).to_pylist()], nexts, outs, table)]
                index = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(index).combine_chunks() for c in kept),
                        pa.array([s for ss in found for s, _ in ss], pa.int32()),
                        pa.array([e for ss in found for _, e in ss], pa.int32()),
                    ],
                    names=[*kept, "start_pos", "end_pos"],
                )

    return rows.filter(F.col(text).isNotNull()).mapInArrow(run, f"{fields}, start_pos int, end_pos int")
