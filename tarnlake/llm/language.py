"""Language of documents and of each paragraph in mixed-language documents (problem 1).

Multilingual mixture inference.  A text is folded (small letters, no accents) and read as character
four-grams; blocks of consecutive four-grams get a log-likelihood per language.  Expectation-
maximisation over the blocks estimates the share of each language in the text, and languages are
dropped while the penalised likelihood grows; what is left is the text's language set.  Each
paragraph then takes the most probable language of that set.

The n-gram model is trained here, on a bounded, documented sample of labelled rows
(about 1.5 times ``per_label`` rows of each label, at most ``max_labels`` labels), with a second EM that corrects the
sample's false labels; a few function words and the script of each letter serve as its prior.
Classification itself covers every row and whole texts in one Arrow pass without a shuffle.

Defined results: a null, empty or letterless text has the language null and confidence 0 and is no
case.  Repeated rows give equal results.  A text in several languages has one row per paragraph.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.quality import text_profile
from tarnlake.session import prepare

# Languages and the function words that seed them.
SEEDS = {
    "tr": "ve bir ile bu için tarafından içinde olarak hâlinde sonunda edilir yapılır kadar üzerinden gereklidir nasıl kim ne değil",
    "az": "və bir ilə bu üçün tərəfindən ərzində hər yalnız görə bilərlər olmadıqda haqqında necə kim nə edilir məlumat",
    "en": "the of and to in is for by be on with are that this not as at from may must who what when",
    "de": "der die das und in den von zu mit für nicht wer auf werden dem über muss wie wann eine ist sind",
    "fr": "le la les et de des du est que pour dans sur une par qui au aux doit comment quand sont",
    "es": "el la los las y del que en para por un una con se quien cómo cuándo debe sobre está",
    "pt": "o a os as e do da dos das em não quem num à um uma como quando deve sobre é são",
    "it": "il lo la gli le e di che per della dei non chi entro sono con come quando deve una è",
    "nl": "de het een en van voor niet wie moet op te dat worden aan zijn is hoe wanneer met over",
    "ru": "и в на не что для кто о по только когда этого как если это",
    "ar": "في من على إلى أن لا عن التي ما إلا إذا ذلك هل كيف متى",
    "hi": "है के को की में से ने और का नहीं जो पर क्या कैसे कब",
    "zh": "的 不 在 人 有 是 和 应 当 并 可 以 内 一 次 谁 什么",
    "ja": "の に は を が と で も た し て する れ なら ない いつ か",
    "th": "การ ที่ และ ใน ต้อง ให้ ได้ โดย ไม่ ของ มี เป็น",
}
LANGUAGES = tuple(SEEDS)
_INDEX = {lang: i for i, lang in enumerate(LANGUAGES)}

# Three-letter codes and names in use for the same languages.
ALIASES = {
    "tur": "tr", "aze": "az", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt",
    "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru", "ara": "ar", "hin": "hi", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th",
    "turkish": "tr", "english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it",
    "dutch": "nl", "azerbaijani": "az", "russian": "ru", "arabic": "ar", "hindi": "hi", "chinese": "zh", "japanese": "ja", "thai": "th",
}
NO_LANGUAGE = frozenset(("", "und", "unknown", "n/a", "na", "none", "null", "mul", "xx", "zxx", "mis", "?"))

BUCKETS = 1 << 16
BLOCK = 48  # four-grams of a block
TEMPER = 0.5  # four-grams overlap, so their evidence counts half
PENALTY = 12.0  # log-likelihood a further language must bring
PART_PENALTY = 1.5  # the same per logarithm of the number of four-grams
_SCRIPTS = ("latin", "cyrillic", "arabic", "devanagari", "thai", "kana", "han")
_SCRIPT_OF = {"ru": "cyrillic", "ar": "arabic", "hi": "devanagari", "th": "thai"}
_PARAGRAPHS = re.compile(r"\n(?:[^\S\n]*\n)+")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_%.\-]{45,}")
_NOT_TEXT = re.compile(r"<[/!]?[A-Za-z][^<>\n]{0,300}>|https?://\S+|&[a-z]+;|\[[^\[\]\s]{8,}\]|\\[a-z]+\*?|\S+@\S+")


def canonical_label(label: str | None) -> str | None:
    """The two-letter code a label stands for; None where it names no language."""
    if label is None:
        return None
    text = label.strip().lower()
    if text in NO_LANGUAGE:
        return None
    head = re.split(r"[-_\s]", text)[0]
    head = ALIASES.get(head, head)
    return head if re.fullmatch("[a-z]{2}", head) and head not in NO_LANGUAGE else ALIASES.get(text)


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For the basic plane: the folded code point (space for non-letters, 0 for marks to drop) and the script."""
    fold = np.full(0x10000, 32, dtype=np.int32)
    script = np.full(0x10000, -1, dtype=np.int8)
    ranges = (
        (0x0041, 0x024F, 0), (0x1E00, 0x1EFF, 0), (0x0400, 0x052F, 1), (0x0600, 0x06FF, 2), (0x0900, 0x097F, 3), (0x0E00, 0x0E7F, 4),
        (0x3040, 0x30FF, 5), (0x3400, 0x9FFF, 6),
    )
    for lo, hi, s in ranges:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            category = unicodedata.category(ch)
            if category[0] == "M" and s != 0:
                fold[cp], script[cp] = cp, s
            elif category[0] == "L":
                base = unicodedata.normalize("NFKD", ch.lower())[0] if s in (0, 1) and ch not in "йЙ" else ch
                fold[cp], script[cp] = ord("i") if ch in "ıİ" else ord(base) if ord(base) < 0x10000 else cp, s
    fold[0x0300:0x0370] = 0
    fold[0x0D] = fold[0x0A] = 32
    return fold, script


_FOLD, _SCRIPT = _fold_tables()


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(raw < 0x10000, raw, 32).astype(np.int64)


def four_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the four-grams whose middle is letters, their places, and the script of each place (-1: none)."""
    script = _SCRIPT[codes]
    folded = _FOLD[codes]
    if (folded == 0).any():
        keep = folded != 0
        folded, script, places = folded[keep], script[keep], np.flatnonzero(keep)
    else:
        places = None
    n = len(folded)
    if n < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), script
    is_letter = folded != 32
    ok = np.flatnonzero(is_letter[1:-2] & is_letter[2:-1])
    f = folded.astype(np.uint64)
    h = f[:-3][ok] * np.uint64(0x9E3779B97F4A7C15)
    for k, mult in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
        h = (h ^ (h >> np.uint64(29))) + f[k : n - 3 + k][ok] * np.uint64(mult)
    h ^= h >> np.uint64(32)
    at = ok + 1
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), at if places is None else places[at], script


def _script_table() -> np.ndarray:
    """Log-probability of a letter's script in each language."""
    table = np.full((len(_SCRIPTS), len(LANGUAGES)), np.log(1e-3))
    for lang, i in _INDEX.items():
        own = _SCRIPT_OF.get(lang)
        if own:
            table[_SCRIPTS.index(own), i] = np.log(0.97)
            table[0, i] = np.log(0.02)
        elif lang == "zh":
            table[6, i], table[5, i], table[0, i] = np.log(0.97), np.log(1e-4), np.log(0.02)
        elif lang == "ja":
            table[6, i], table[5, i], table[0, i] = np.log(0.5), np.log(0.48), np.log(0.02)
        else:
            table[0, i] = np.log(0.98)
    return table.astype(np.float32)


SCRIPT_LOGP = _script_table()


def train(samples: Iterable[tuple[str, str | None]], rounds: int = 3) -> np.ndarray:
    """Log-probabilities [bucket, language] from a bounded sample of (text, label).

    Labels are a prior that the EM may overrule: a row whose text speaks clearly for another
    language moves there, so false labels in the sample do no harm.
    """
    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    for lang, words in SEEDS.items():
        h, _, _ = four_grams(_codes("  " + words + "  "))
        np.add.at(counts[:, _INDEX[lang]], h, 2.0)
    rows = []
    for text, label in samples:
        codes = _codes(_ENCODED.sub(" ", _NOT_TEXT.sub(" ", text or "")))
        h, _, script = four_grams(codes)
        if len(h) < 8:
            continue
        uniq, c = np.unique(h, return_counts=True)
        by_script = np.bincount(script[script >= 0], minlength=len(_SCRIPTS)).astype(np.float64)
        lang = canonical_label(label)
        rows.append((uniq, c.astype(np.float64), by_script, _INDEX.get(lang, -1) if lang else -1))
    seed_counts = counts.copy()
    for turn in range(rounds):
        logp = _log_probabilities(counts)
        counts = seed_counts.copy()
        for uniq, c, by_script, label in rows:
            # the seeds alone know few four-grams, so the first turn leans on the label within its script
            score = (c @ logp[uniq]) * (0.05 if turn == 0 else TEMPER) + by_script @ SCRIPT_LOGP
            if label >= 0:
                score[label] += 6.0
            score -= score.max()
            p = np.exp(score)
            p /= p.sum()
            best = int(p.argmax())
            if p[best] > 0.9:
                counts[uniq, best] += c
    return _log_probabilities(counts)


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    smooth = 0.05
    total = counts.sum(axis=0) + smooth * 4000
    return np.log((counts + smooth) / total).astype(np.float32)


def _segments(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with markup blanked and the spans of its paragraphs."""
    clean = _NOT_TEXT.sub(lambda m: " " * len(m.group()), text) if any(ch in text for ch in "<&[\\@:") else text
    if _ENCODED.search(clean):
        clean = _ENCODED.sub(lambda m: " " * len(m.group()), clean)
    spans, start = [], 0
    for m in _PARAGRAPHS.finditer(text):
        if text[start : m.start()].strip():
            spans.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    return clean, spans


def _em(block_like: np.ndarray, doc_of: np.ndarray, first: np.ndarray, active: np.ndarray, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Language shares and log-likelihood of each document, over its blocks; only active languages have a share."""
    pi = active / active.sum(axis=1, keepdims=True)
    size = np.diff(np.append(first, len(doc_of)))[:, None]
    for _ in range(turns):
        r = pi[doc_of] * block_like
        mass = r.sum(axis=1, keepdims=True)
        r /= np.maximum(mass, 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / size
    ll = np.add.reduceat(np.log(np.maximum((pi[doc_of] * block_like).sum(axis=1), 1e-300)), first)
    return pi, ll


def infer(texts: list[str | None], logp: np.ndarray, segments: bool = True) -> list[list[tuple[int, str | None, float]]]:
    """For each text its rows (seg_no, language, confidence): seg_no 0, or its paragraphs where it mixes languages.

    Without ``segments`` a text in several languages has the one with the largest share.
    """
    out: list[list[tuple[int, str | None, float]]] = [[(0, None, 0.0)] for _ in texts]
    pieces, block_first, block_key, offset = [], [], [], 0
    scripts, starts = [], []
    spans_of: dict[int, list[tuple[int, int]]] = {}
    total_blocks = 0
    keys: list[tuple[int, int]] = []  # text, paragraph of each block
    for i, text in enumerate(texts):
        if not text:
            continue
        clean, spans = _segments(text)
        codes = _codes(clean)
        h, at, _ = four_grams(codes)
        if len(h) == 0:
            continue
        spans_of[i] = spans
        ends = np.array([e for _, e in spans], dtype=np.int64)
        par = np.searchsorted(ends, at, side="right")
        par = np.minimum(par, len(spans) - 1)
        change = np.flatnonzero(np.diff(par)) + 1
        par_first = np.concatenate(([0], change))
        rank = np.arange(len(h)) - np.repeat(par_first, np.diff(np.append(par_first, len(h))))
        new = (rank % BLOCK) == 0
        sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
        first = np.flatnonzero(new)
        # a short rest joins the block before it in the same paragraph
        merge = (sizes < BLOCK // 2) & (rank[first] > 0)
        first = first[~merge]
        pieces.append(h)
        scripts.append(_SCRIPT[codes[at]])
        block_first.append(first + offset)
        keys.extend((i, int(p)) for p in par[first])
        starts.append(len(first))
        offset += len(h)
        total_blocks += len(first)
    if not pieces:
        return out
    grams = np.concatenate(pieces)
    first = np.concatenate(block_first)
    # sums per block, in slices that stay in cache
    ll = np.empty((total_blocks, len(LANGUAGES)), dtype=np.float64)
    bounds = np.append(first, len(grams))
    lo = 0
    while lo < total_blocks:
        hi = min(total_blocks, lo + 1024)
        part = logp[grams[bounds[lo] : bounds[hi]]]
        ll[lo:hi] = np.add.reduceat(part, first[lo:hi] - bounds[lo], axis=0)
        lo = hi
    script = np.concatenate(scripts).astype(np.int64)
    block_of = np.repeat(np.arange(total_blocks), np.diff(bounds))
    by_script = np.bincount(block_of * len(_SCRIPTS) + np.maximum(script, 0), minlength=total_blocks * len(_SCRIPTS)).reshape(total_blocks, -1)
    ll = TEMPER * ll + by_script @ SCRIPT_LOGP
    n_grams = np.diff(bounds)
    text_ids = sorted(spans_of)
    doc_first = np.concatenate(([0], np.cumsum(starts)[:-1]))
    whole = np.add.reduceat(ll, doc_first, axis=0)
    order = np.argsort(-whole, axis=1)
    top, second = order[:, 0], order[:, 1]
    doc_of = np.repeat(np.arange(len(text_ids)), starts)
    gain = np.add.reduceat(ll.max(axis=1) - ll[np.arange(total_blocks), top[doc_of]], doc_first)
    grams_of = np.add.reduceat(n_grams, doc_first)
    penalty = PENALTY + PART_PENALTY * np.log(grams_of)
    mixed = np.flatnonzero(gain > penalty)  # only here can a second language pay for itself
    share = np.zeros((len(text_ids), len(LANGUAGES)))
    share[np.arange(len(text_ids)), top] = 1.0
    if len(mixed):
        in_mixed = np.isin(doc_of, mixed)
        local = np.searchsorted(mixed, doc_of[in_mixed])
        part = ll[in_mixed]
        like = np.exp(part - part.max(axis=1, keepdims=True))
        m_first = np.searchsorted(local, np.arange(len(mixed)))
        active = np.zeros((len(mixed), len(LANGUAGES)))
        np.maximum.at(active, (local, part.argmax(axis=1)), 1.0)
        active[np.arange(len(mixed)), top[mixed]] = 1.0
        pi, base = _em(like, local, m_first, active)
        live = np.ones(len(mixed), dtype=bool)
        for _ in range(len(LANGUAGES)):
            # loss of likelihood without each language of the set
            loss = np.full((len(mixed), len(LANGUAGES)), np.inf)
            for lang in np.flatnonzero(active.any(axis=0)):
                rest = pi.copy()
                rest[:, lang] = 0
                mass = rest.sum(axis=1, keepdims=True)
                rest = np.where(mass > 0, rest / np.maximum(mass, 1e-300), rest)
                without = np.add.reduceat(np.log(np.maximum((rest[local] * like).sum(axis=1), 1e-300)), m_first)
                here = active[:, lang] > 0
                loss[here, lang] = (base - without)[here]
            loss[active.sum(axis=1) <= 1] = np.inf
            weakest = loss.argmin(axis=1)
            drop = live & (loss[np.arange(len(mixed)), weakest] < penalty[mixed])
            if not drop.any():
                break
            active[drop, weakest[drop]] = 0
            pi, base = _em(like, local, m_first, active)
        share[mixed] = pi * active
    several = (share > 0).sum(axis=1) > 1
    # posterior of the best single language
    best = whole[np.arange(len(text_ids)), top]
    runner = whole[np.arange(len(text_ids)), second]
    single_conf = 1 / (1 + np.exp(-np.clip(best - runner, 0, 50)))
    for d, i in enumerate(text_ids):
        if not several[d] or not segments:
            lang = int(np.argmax(share[d]))
            out[i] = [(0, LANGUAGES[lang], float(single_conf[d] if lang == top[d] and not several[d] else share[d, lang]))]
            continue
        b0 = doc_first[d]
        b1 = b0 + starts[d]
        prior = np.log(np.maximum(share[d], 1e-12)) + np.where(share[d] > 0, 0.0, -1e6)
        totals = np.zeros((len(spans_of[i]), len(LANGUAGES)))
        for b in range(b0, b1):
            totals[keys[b][1]] += ll[b]
        rows = []
        for p in range(len(spans_of[i])):
            score = totals[p] + prior
            score -= score.max()
            prob = np.exp(score)
            prob /= prob.sum()
            k = int(prob.argmax())
            rows.append((p + 1, LANGUAGES[k], float(prob[k])))
        if len({r[1] for r in rows}) == 1:
            out[i] = [(0, rows[0][1], float(share[d].max()))]
        else:
            out[i] = rows
    return out


def fit_model(spark: SparkSession, sources: list[DataFrame], per_label: int = 150, max_labels: int = 120) -> np.ndarray:
    """Train on at most per_label rows of each of the max_labels commonest raw labels of each source.

    ``sources`` have the columns text and lang.  The sample is drawn by a hash of the text, so it is
    the same on every run; at most 2 * len(sources) * per_label * max_labels rows reach the driver.
    """
    samples: list[tuple[str, str | None]] = []
    for source in sources:
        labelled = source.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels).collect()
        wanted = [(r["lang"], min(1.0, 1.5 * per_label / r["count"])) for r in counts if canonical_label(r["lang"]) in _INDEX]
        if not wanted:
            continue
        rates = F.create_map(*[F.lit(x) for pair in wanted for x in pair])
        draw = (F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("draw")
        rate = F.try_element_at(rates, F.col("lang"))
        picked = labelled.select("lang", "text", draw).filter(F.col("draw") < F.coalesce(rate, F.lit(0.0))).select("lang", "text")
        taken: dict[str, int] = {}
        for row in picked.limit(2 * per_label * max_labels).collect():
            if taken.setdefault(row["lang"], 0) < 2 * per_label:
                taken[row["lang"]] += 1
                samples.append((row["text"], row["lang"]))
    samples.sort(key=lambda s: (s[1] or "", s[0]))
    return train(samples)


def detect_languages(rows: DataFrame, model: np.ndarray, judge_prose: bool = False, segments: bool = True) -> DataFrame:
    """Language of every row, or of each of its paragraphs; without ``segments`` the one with the largest share.

    ``rows`` has src, item_id, lang, text and may have more columns, all of which except text are kept.
    Adds seg_no, detected, confidence and kind.  With judge_prose, kind holds what problem 10's rules
    say of the text (prose, list, table, junk) where the label fails or the text mixes languages; it is
    null elsewhere.
    """
    spark = rows.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages x 4 bytes, 4 MB
    kept = [c for c in rows.columns if c not in ("text", "seg_no", "detected", "confidence", "kind")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start in range(0, batch.num_rows, 512):
                part = table.slice(start, 512)
                found = infer(part.column("text").to_pylist(), logp, segments)
                index = pa.array([i for i, rs in enumerate(found) for _ in rs], pa.int64())
                flat = [r for rs in found for r in rs]
                columns = [part.column(c).take(index).combine_chunks() for c in kept]
                columns += [
                    pa.array([r[0] for r in flat], pa.int32()),
                    pa.array([r[1] for r in flat], pa.string()),
                    pa.array([r[2] for r in flat], pa.float64()),
                    pa.array(_kinds(part, found) if judge_prose else [None] * len(flat), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "seg_no", "detected", "confidence", "kind"])

    return rows.mapInArrow(run, f"{fields}, seg_no int, detected string, confidence double, kind string")


def _kinds(part: pa.Table, found: list) -> list[str | None]:
    out: list[str | None] = []
    for text, label, rows in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), found, strict=True):
        case = len(rows) > 1 or (rows[0][1] is not None and canonical_label(label) != rows[0][1])
        out.extend([text_profile(text)[-1] if case else None] * len(rows))
    return out


def language_cases(detected: DataFrame) -> DataFrame:
    """Rows whose label is missing or wrong, and the paragraphs of texts in several languages."""
    named = label_code(F.col("lang"))
    wrong = (F.col("seg_no") > 0) | named.isNull() | (named != F.col("detected"))
    return detected.filter(F.col("detected").isNotNull() & wrong)


def label_code(label):  # noqa: ANN001, ANN201
    """Column form of canonical_label, in the JVM."""
    low = F.lower(F.trim(label))
    head = F.regexp_extract(low, r"^([a-z]+)", 1)
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    code = F.coalesce(F.try_element_at(aliases, head), head)
    none = F.array(*[F.lit(x) for x in sorted(NO_LANGUAGE)])
    named = low.isNotNull() & ~F.array_contains(none, low) & code.rlike("^[a-z]{2}$") & ~F.array_contains(none, code)
    return F.when(named, code)
