"""Chunks, sentences, claims, windows and planted errors."""

import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import corruption, textops

TEXT = "Birinci madde. Fesih süresi otuz gündür; ayrıca bildirim yapılır.\n\nİkinci paragraf burada başlar. Devam eder! Biter mi?\n\nÜçüncü paragraf tek cümledir.\n\n" + "Uzun cümle " * 60 + "."


def column(spark, expr_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(expr_of(F.col("x")).alias("y")).collect()]


@given(st.text(alphabet="ab .!?\n\"'", max_size=400), st.integers(1, 60), st.integers(0, 30), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_chunk_spans_cover_and_end(text, target, overlap, least):
    overlap = min(overlap, target - 1)
    spans = textops.chunk_spans(text, target, overlap, least)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    for a, b in textops.segments(text):
        assert set(range(a, b)) <= covered
    assert all(b - a <= target for a, b in spans[:-1])


def test_no_character_is_lost_between_chunks(spark):
    assert textops.segments('He said (go.)\n\nNext "one." And') == [(0, 13), (15, 26), (27, 30)]
    texts = ['He said (go.)\n\nNext', "a.) b.] c!\" d", " x \n \n y.  ", "q" * 50, "", None]
    df = spark.createDataFrame([(i, t, 9, 0, 0) for i, t in enumerate(texts)], "id int, text string, t int, o int, m int")
    rows = textops.with_chunks(df, target="t", overlap="o", least="m").select("id", "chunks", textops.chunk_faults(F.col("text"), F.col("chunks"), F.col("t")).alias("f")).collect()
    assert all((r.f.broken, r.f.lost, r.f.too_long) == (0, 0, 0) for r in rows if r.id < 5) and all(r.chunks for r in rows if r.id < 4)
    torn = df.filter("id = 0").select("text", F.expr("array(named_struct('chunk', 'He', 'span_start', 0, 'span_end', 3))").alias("c"))
    f = torn.select(textops.chunk_faults(F.col("text"), F.col("c"), F.lit(2)).alias("f")).first().f
    assert (f.broken, f.too_long, f.lost) == (1, 0, 13)  # the fault is seen: "said(go.)Next" lies in no chunk


def test_chunk_sizes_and_overlap():
    spans = textops.chunk_spans(TEXT, 200, 60, 20)
    assert len(spans) > 3 and all(b - a <= 200 for a, b in spans)
    assert any(spans[i + 1][0] < spans[i][1] for i in range(len(spans) - 1))
    assert textops.chunk_spans("   ") == [] and textops.chunk_spans("") == []


def test_chunked_frame_keeps_columns(spark):
    df = spark.createDataFrame([(1, TEXT, 200, 60, 20, "o"), (2, None, 200, 0, 0, "o"), (3, "", 200, 0, 0, "o")], "id int, text string, t int, o int, m int, source string")
    rows = textops.chunked(df, target="t", overlap="o", least="m").collect()
    assert {r.id for r in rows} == {1} and all(TEXT[r.span_start : r.span_end] == r.chunk for r in rows)
    assert textops.chunked(df.limit(0)).count() == 0


def test_sentences_and_citations(spark):
    got = column(spark, textops.marked_sentences, "Bir. İki! Üç?", "Ücret 2.500 TL olur. Oran 0.05 kalır. [a:v1][b:v2] Son", "See e.g. the annex. 5. maddede yazar.", None, "", "a. drafts etc.")
    assert got[0] == ["Bir.", "İki!", "Üç?"]
    assert got[1] == ["Ücret 2.500 TL olur.", "Oran 0.05 kalır. [a:v1][b:v2]", "Son"]
    assert got[2] == ["See e.g. the annex.", "5. maddede yazar."] and not got[3] and not got[4] and got[5] == ["a.", "drafts etc."]
    assert column(spark, textops.citations_of, "x. [a][b]", "x [a] y.") == [["a", "b"], []]


def test_claims(spark):
    df = spark.createDataFrame([("q", "Fesih ihbar süresi otuz gündür, ve bildirim yazılı olarak yapılmalıdır. [d1] Kısa, ve öz."), ("e", None)], "query_id string, answer string")
    rows = [(r.claim_no, r.claim, r.citations) for r in textops.drafted_claims(df).orderBy("claim_no").collect()]
    assert rows == [(1, "Fesih ihbar süresi otuz gündür.", ["d1"]), (2, "bildirim yazılı olarak yapılmalıdır.", ["d1"]), (3, "Kısa, ve öz.", [])]


def test_windows_and_overlap(spark):
    assert column(spark, textops.premise_windows, "A b. C d. E f.", "tek", "", "x\n\ny") == [["A b. C d.", "C d. E f."], ["tek"], [], ["x y"]]
    df = spark.createDataFrame([("the fee is ten liras", "fee ten"), ("", "fee"), ("fee", "the of"), (None, None)], "p string, h string")
    assert [r.s for r in df.select(T.overlap_score(F.col("p"), F.col("h")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert column(spark, lambda c: textops.on_evidence(c, F.lit("Süre otuz gündür.")), "süre otuz gündür", "başka şey") == [True, False]


def test_scalars(spark):
    assert column(spark, T.slug, "Açık Rıza — Formu!", None) == ["acik-riza-formu", None]
    assert column(spark, T.file_title, "a/b/kvkk_md-07.html") == ["kvkk md 07"]
    assert column(spark, T.markdown_title, "x\n# Başlık \ny", "## no") == ["Başlık", None]
    assert column(spark, lambda c: T.media_type(c, F.lit("a/B.MD")), "text/html; charset=utf-8", None, " ") == ["text/html", "text/markdown", "text/markdown"]
    assert column(spark, T.snippet, "x" * 300, " y ") == ["x" * 240 + "…", "y"]


def test_corruptions():
    assert corruption.turn_negation("The notice shall be sent", "en") == "The notice shall not be sent"
    assert corruption.turn_negation("Kayıt silinir", "tr") == "Kayıt silinmez"
    assert corruption.swap_term("the data controller decides", "en", 0) == "the data processor decides"
    assert {corruption.swap_term("Gün sayısı ay içinde", "tr", p) for p in range(9)} == {"Ay sayısı ay içinde", "Gün sayısı gün içinde", "Gün sayısı yıl içinde"}
    fees = {corruption.change_number("(2) fee is 1,280 liras", p) for p in range(50)}
    assert fees == {f"(2) fee is {d},280 liras" for d in range(2, 10)}
    assert corruption.change_number("no figure", 1) is None and corruption.turn_negation("x", "de") is None
    with pytest.raises(ValueError):
        corruption.corrupt("The fee is 30 liras.", "de", 0)


def test_turkish_negations():
    for claim, turned in {
        "Veri sorumlusu yükümlüdür.": "Veri sorumlusu yükümlü değildir.", "Bu şarttır.": "Bu şart değildir.", "Bu gündür.": "Bu gün değildir.",
        "Rıza gerekmektedir.": "Rıza gerekmemektedir.", "Rıza gerekmemektedir.": "Rıza gerekmektedir.", "Taraflar isteyebilirler.": "Taraflar isteyemezler.",
        "Taraflar yapabilirler.": "Taraflar yapamazlar.", "Veriler aktarılabilir.": "Veriler aktarılamaz.", "Bu mümkün değildir.": "Bu mümkündür.",
        "Vardır bir istisna.": "Yoktur bir istisna.", "Bildirmek zorundadır.": "Bildirmek zorunda değildir.", "Bu zorunda değildir.": "Bu zorundadır.",
        "Veri işleyen sorumludur.": "Veri işleyen sorumlu değildir.", "Verilebilirler.": "Verilemezler.", "Rıza alınır.": "Rıza alınmaz.", "Kayıt silinir.": "Kayıt silinmez.",
    }.items():
        assert corruption.turn_negation(claim, "tr") == turned
    assert corruption.turn_negation("Hükümlerini Başkan yürütür.", "tr") is None and corruption.turn_negation("Bir kişi.", "tr") is None


def test_english_negations():
    assert corruption.turn_negation("It has been erased.", "en") == "It has not been erased."
    assert corruption.turn_negation("They had repealed it.", "en") == "They had not repealed it."
    assert corruption.turn_negation("It opened on May 27, 1937.", "en") is None
    for claim, turned in {
        "It cannot be used.": "It can be used.", "It can be used.": "It cannot be used.", "They were not told.": "They were told.", "It is void.": "It is not void.",
        "It is void, but may not lapse.": "It is void, but may lapse.", "They have rights.": None, "It did not apply.": "It did apply.",
    }.items():
        assert corruption.turn_negation(claim, "en") == turned


def test_numbers_in_words_and_in_dates():
    for pick in range(300):
        assert "otuz gün" not in corruption.change_number("Başvuru otuz gün içinde sonuçlanır.", pick, "tr")
        words, figure = corruption.change_number("Notice of fifty (50) days is required.", pick, "en").split(" of ")[1].split(" days")[0].split(" (")
        assert figure[0] != "5" and words == corruption.spelled(int(figure[:-1]), "en")
        day, year = corruption.change_number("It was signed on June 28, 2018.", pick, "en").split("June ")[1].rstrip(".").split(", ")
        assert 1 <= int(day) <= 28 and 2008 <= int(year) <= 2028
        assert corruption.change_number("(3) (Değişik:2/3/2024-7499/33 md.) Başvuru [sicil-md-07] incelenir.", pick, "tr") is None
    years = {int(corruption.change_number("in 1977 it began", p).split()[1]) for p in range(300)}
    assert years == set(range(1967, 1988)) - {1977}
    assert corruption.change_number("İKİ AY", 0, "tr") == "Üç AY" and corruption.change_number("Dört ay", 0, "tr") == "İki ay"
    assert corruption.change_number("the three-dimensional structure", 0, "en") is None and corruption.change_number("a bir one", 0, "tr") is None


def test_injection_is_stable_and_labelled(spark):
    rng = random.Random(2)
    rows = [(f"q{i}", j, rng.choice(["tr", "en", "de", None]), rng.choice(["The fee is 30 liras.", "Süre 20 gündür.", "x", None])) for i in range(60) for j in (1, 2)]
    df = spark.createDataFrame(rows, "query_id string, claim_no int, lang string, claim string")
    a = sorted(corruption.inject(df.repartition(1), 0.5, 3).collect())
    b = sorted(corruption.inject(df.repartition(7), 0.5, 3).collect())
    original = {(r[0], r[1]): r[3] for r in rows}
    assert a == b and any(r.corrupted for r in a)
    assert all((r.claim != original[r.query_id, r.claim_no]) == r.corrupted for r in a)
