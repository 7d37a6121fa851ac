"""English and Turkish stemmers for lexical search, behind an Arrow UDF.

English follows the published Porter algorithm; Turkish strips inflectional suffixes of nouns and verbs
in the order in which the language adds them, keeping at least two syllables' worth of stem.  They serve
ranking only: two forms of one word should meet, and nothing else depends on them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.text import FOLD_FROM, FOLD_TO

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_WORD = re.compile(r"[^\W]+")
_VOWELS_EN = "aeiou"

# Function words left out by the analyzers.
STOP_EN = frozenset("the a an of to in for and or by is are was were be been this that as at it on with from not may must who what when how".split())
STOP_TR = frozenset("ve veya ile bir bu şu o için olarak de da ki mi mı mu mü ne kim nasıl kadar gibi daha en çok".split())

# Turkish suffixes from the word's end inwards (folded letters).
_TR_SUFFIXES = (
    ("dir", "tir", "dur", "tur"),
    ("mektedir", "maktadir", "abilir", "ebilir", "ilir", "inir", "ulur", "unur", "ecek", "acak", "mali", "meli", "mis", "mus", "iyor", "uyor"),
    ("ndan", "nden", "dan", "den", "tan", "ten", "nda", "nde", "da", "de", "ta", "te", "nin", "nun", "in", "un", "yla", "yle", "la", "le", "na", "ne", "ya", "ye", "yi", "yu", "ni", "nu"),
    ("imiz", "iniz", "umuz", "unuz", "lari", "leri", "si", "su", "sin", "sun"),
    ("lar", "ler"),
    ("i", "u", "a", "e"),
)


def _measure(stem: str) -> int:
    kinds = re.sub("c+", "C", re.sub("v+", "V", "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))))
    return kinds.count("VC")


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS_EN or (word[i] == "y" and i > 0 and not _is_vowel(word, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _ends_short(stem: str) -> bool:
    n = len(stem)
    return n >= 3 and not _is_vowel(stem, n - 3) and _is_vowel(stem, n - 2) and not _is_vowel(stem, n - 1) and stem[-1] not in "wxy"


# Derivational endings of the Porter algorithm, by step.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=50_000)
def stem_en(word: str) -> str:
    """Stem of an English word by Porter's five steps."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_short(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        ending = max((e for e in table if word.endswith(e)), key=len, default=None)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + table[ending]
    ending = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if ending:
        rest = word[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=50_000)
def stem_tr(word: str) -> str:
    """Stem of a Turkish word in folded letters."""
    word = word.translate(_FOLD)
    for group in _TR_SUFFIXES:
        for suffix in group:
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and len(rest) >= 4 and re.search("[aeiou]", rest):
                word = rest
                break
    return word


def analyse(text: str | None, config: str | None) -> list[str]:
    """Lexemes of a text under an analyzer, in order, with repetitions."""
    words = _WORD.findall((text or "").replace("İ", "i").lower())
    if config == "english":
        return [stem_en(w.translate(_FOLD)) for w in words if w not in STOP_EN]
    if config == "turkish":
        return [stem_tr(w) for w in words if w not in STOP_TR]
    return words


def analysed(text: Column | str, config: Column | str) -> Column:
    """Lexemes of a text column under an analyzer column, in Arrow batches."""

    def run(texts: pa.Array, configs: pa.Array) -> pa.Array:
        return pa.array([analyse(t, c) for t, c in zip(texts.to_pylist(), configs.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text, config)
