"""Language, statistics, sentences, splitting, markup, leakage, mixing: operators on small cases and edges."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.llm import language, leakage, markup, mixing, quality, sentences, splitting

TR = "Başvurular yazılı olarak yapılır ve ilgili birim tarafından kaydedilir. Denetçiler konum verilerini yerinde görmek isteyebilir."
EN = "Applications are made in writing and recorded by the unit concerned. The auditors may ask to see location data on site."
DE = "Wer die Standortdaten verändert, muss dies innerhalb von acht Wochen melden. Der Ausschuss prüft die Besucherlisten einmal im Jahr."
FR = "Le comité examine les listes de visiteurs et rend compte à la direction une fois par an. Sans accord écrit, il est interdit de transmettre les dossiers."
ES = "El comité revisa las copias de facturas e informa a la dirección una vez al año. Sin permiso escrito está prohibido entregar los datos."
RU = "Комиссия проверяет данные о местоположении и раз в год отчитывается перед руководством."
JA = "管理者は遅くとも二日以内に位置情報を消去しなければならない。"
ZH = "委员会每年审查一次人事档案，并向管理层报告。"
ALL = {"tr": TR, "en": EN, "de": DE, "fr": FR, "es": ES, "ru": RU, "ja": JA, "zh": ZH}


@pytest.fixture(scope="module")
def model():
    rows = [(t, lang) for lang, t in ALL.items() for _ in range(4)]
    rows += [(EN, "tr"), (TR, "en"), (DE, "en"), (None, "tr"), ("", "en"), ("x", "xx")]  # false labels do no harm
    return language.train(rows)


# ---- language


def test_single_and_mixed(model):
    got = language.infer([*ALL.values(), f"{TR}\n\n{EN}\n \n{DE}", None, "", "12 %", "YAZILI OLARAK KAYDEDILIR VE YAPILIR"], model)
    assert [g[0][1] for g in got[: len(ALL)]] == list(ALL)
    assert [(n, lang) for n, lang, _ in got[len(ALL)]] == [(1, "tr"), (2, "en"), (3, "de")]
    assert got[-4] == got[-3] == got[-2] == [(0, None, 0.0)]
    assert got[-1][0][1] == "tr"
    assert all(0 <= c <= 1 for g in got for _, _, c in g)


def test_single_texts_take_the_largest_share(model):
    text = f"{DE}\n\n{TR} {TR}\n\n{TR}"
    assert [r[0] for r in language.infer([text], model)[0]] == [1, 2, 3]
    (row,) = language.infer([text], model, segments=False)[0]
    assert row[:2] == (0, "tr") and 0.5 < row[2] < 1


def test_long_text_and_noise(model):
    noise = "A1b2C3d4" * 60
    got = language.infer([(EN + " ") * 3000 + "\n\n" + noise + "\n\n" + EN], model)[0]
    assert got[0][:2] == (0, "en")


def test_labels(spark):
    raw = ["tr", " TR ", "tr-TR", "tr_TR", "tur", "Turkish", "en_GB", "xx", "und", "", None, "mul", "n/a", "unknown", "zho"]
    want = ["tr", "tr", "tr", "tr", "tr", "tr", "en", None, None, None, None, None, None, None, "zh"]
    assert [language.canonical_label(x) for x in raw] == want
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, lang string")
    assert [r.c for r in rows.select("i", language.label_code(F.col("lang")).alias("c")).orderBy("i").collect()] == want


def test_cases(spark, model):
    rows = [("d", "1", "tr", TR), ("d", "2", "en", TR), ("d", "3", None, EN), ("d", "4", "tr-TR", TR), ("d", "5", "tr", f"{TR}\n\n{EN}"), ("d", "6", "tr", None), ("d", "6", "tr", None)]
    df = spark.createDataFrame(rows, "src string, item_id string, lang string, text string").withColumn("kind0", F.lit("clash"))
    found = language.language_cases(language.detect_languages(df, model, judge_prose=True)).select("item_id", "seg_no", "detected", "kind")
    assert sorted(map(tuple, found.collect())) == [("2", 0, "tr", "prose"), ("3", 0, "en", "prose"), ("5", 1, "tr", "prose"), ("5", 2, "en", "prose")]
    assert language.detect_languages(df.limit(0), model).count() == 0


# ---- statistics


def kind(text):
    return quality.text_profile(text)[-1]


def test_kinds():
    assert kind("\n".join(f"– {x}" for x in ("Archive manager", "Consent form", "Audit board", "Leave request"))) == "list"
    assert kind("\n".join(f"{i}.1 Consent form ........ {i}" for i in range(5))) == "list"
    assert kind("\n".join(f"A{i},name,2024-01-0{i}" for i in range(1, 6))) == "table"
    assert kind("\n".join(f"A{i}   name   2024-01-0{i}" for i in range(1, 6))) == "table"
    assert kind("qwrt sdfg hjkl qwrtş dfghj kşlw rtqs dfgh jklş wrtq sdfg hjkl wrtp") == "junk"
    assert kind("page " * 50) == "boilerplate" and kind("test " * 50) == "junk" and kind("7 42 8812 9 3344 5 66 90812 4 17 88") == "junk"
    assert kind(";:%! §¬ ?+ :;  ¤¤ @/ (%) !! ;; ¬¬ §§ :: %% ?? ++") == "junk"
    for t in (TR, EN, DE, RU, JA, ZH, EN.upper(), "\n".join(EN.split(". ")), f"<h2>T</h2>\n<p>{EN}</p>"):
        assert kind(t) == "prose", t
    wrapped = "The tribunal read the clause\nnarrowly and excluded entries\ncreated before its third sitting. Under\nanother clause, an operator in town\nthat keeps ledgers longer than a\nmonth owes each claimant a fee."
    assert kind(wrapped) == "prose"
    assert kind(f"{EN} {EN}\n\n– one\n– two\n– three\n\n{EN}") == "prose"


def test_profile_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, "a" * 500_000), (6, EN), (6, EN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(0), "kind": F.lit("clash")})
    got = {r.item_id: r for r in quality.text_statistics(df).collect()}
    assert got[1].n_words is None and got[1].kind is None
    assert got[2].n_words == 0 and got[2].kind is None and got[3].kind is None
    assert got[6].n_words == len(EN.split()) and got[6].end_punct_share == 1.0 and got[6].common_word_share > 0.3
    assert quality.text_statistics(df.limit(0)).count() == 0


def test_repetition_figures():
    p = dict(zip(quality._NAMES, quality.text_profile("a b a b a b\na b a b a b\n\nx y"), strict=True))
    assert p["dup_line_share"] == pytest.approx(1 / 3) and p["dup_paragraph_share"] == 0 and p["top_pair_share"] > 0.8


def test_repetition_decides(monkeypatch):
    line = "This page was last changed by the records office of the council on the first day of the month."
    for text in ("\n".join([line] * 40), " ".join([line] * 40), line + "\n\n" + " ".join(["Copy this page to your folder and send it on."] * 30)):
        assert kind(text) == "boilerplate"
    assert kind("\n".join([line, EN, TR])) == "prose" and kind(f"{line} {line}\n\n{EN}") == "prose"
    assert kind("one two\n" * 30) in ("boilerplate", "list")
    assert kind(f"{EN}\n\n{EN}\n\n" + "click " * 5) == "prose"
    monkeypatch.setattr(quality, "boilerplate_chars", lambda lines: 0)
    assert kind("\n".join([line] * 40)) == "prose"  # without the figures the lines alone look like prose


def test_broken_letters_and_noise():
    spaced = " ".join(EN.replace(" ", ""))
    assert kind(spaced) == "junk" and kind(f"{spaced}\n\n{spaced}") == "junk" and kind(f"{EN}\n{EN}\n{EN}\n{spaced}") == "prose"
    assert kind("!% ));?( ??@?¬ @: +¬ ; ¬@; (¬¬@¬%?!!;+% :: ?)+ ¤§¬¬! :  ( ?:/¤¬¬(? :§?:!?¤%;:¤% :)") == "junk"
    assert kind(f"<h2>T</h2><p>{EN}</p>") == "prose" and kind("! Name !! Date\n" + EN) == "prose"


# ---- sentences


def parts(text, **kw):
    return [text[a:b] for a, b in sentences.split_texts([text], **kw)[0]]


CASES = [
    ("Bir. İki! Üç?", ["Bir.", "İki!", "Üç?"]),
    ("Dr. Ak geldi. Bu 7. maddede yazar.", ["Dr. Ak geldi.", "Bu 7. maddede yazar."]),
    ("See e.g. the annex on p. 15. Case No. 9 was closed.", ["See e.g. the annex on p. 15.", "Case No. 9 was closed."]),
    ("Am 2. März beginnt es. Am 5. Kurs.", ["Am 2. März beginnt es.", "Am 5.", "Kurs."]),
    ("Üye yazdı: “Süre doldu.” Kurul sustu. “Tamam.” dedi.", ["Üye yazdı: “Süre doldu.”", "Kurul sustu.", "“Tamam.” dedi."]),
    ("« Le délai est échu. » répondit-elle. Oui.", ["« Le délai est échu. » répondit-elle.", "Oui."]),
    ("Done [a/b]. Next. [c][d] Last [e]\nNew line", ["Done [a/b].", "Next.", "Last", "New line"]),
    ("Notes, etc. [x] Phones, e-mails, etc. are kept. Ends etc. The end.", ["Notes, etc.", "Phones, e-mails, etc. are kept.", "Ends etc.", "The end."]),
    ("他说：“不能延长。”随后离开。版本v4.16停用。", ["他说：“不能延长。”随后离开。", "版本v4.16停用。"]),
    ("قال: «لا تمدد.» ثم خرج. متى؟ الآن", ["قال: «لا تمدد.» ثم خرج.", "متى؟", "الآن"]),
    ("ห้าม ต้อง\xa0ลบ", ["ห้าม", "ต้อง", "ลบ"]),
    ("members.See it. The U.S. office... but v1.28.1 ran.", ["members.", "See it.", "The U.S. office... but v1.28.1 ran."]),
    ("", []),
    ("  \n ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentence_rules(text, want):
    assert parts(text) == want


@given(st.lists(st.sampled_from([c[0] for c in CASES] + ["Ltd. Şti. ", "\n", " [x]", '"', "s. 77. A. B. "]), max_size=12), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_chunks_change_nothing(pieces, chunk):
    text = " ".join(pieces)
    assert sentences.split_texts([text], chunk=chunk) == sentences.split_texts([text])
    spans = sentences.split_texts([text])[0]
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_sentence_frame(spark):
    df = spark.createDataFrame([("q", 0, "Bir. İki."), ("q", 1, None), ("q", 0, "Bir. İki."), ("r", 0, "x " * 40_000)], "query_id string, claim_no int, text string")
    got = sentences.sentence_units(df).distinct().collect()
    assert sorted((r.query_id, r.start_pos, r.end_pos) for r in got) == [("q", 0, 4), ("q", 5, 9), ("r", 0, 79_999)]


# ---- splitting


def test_stretch_behind_a_boundary_cut():
    text = "a b. " * 20 + "\n\n" + "x" * 300 + "\n\n" + "a b. " * 20
    cuts = [p[2] for p in splitting.bisect_text(text, 100, 10)[1:]]
    assert 102 in cuts and splitting.cut_stretch(text, cuts) == 300


@given(st.text(alphabet="abc .!?\n,。", max_size=600), st.integers(2, 60), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_pieces_fit_and_rebuild(text, limit, overlap):
    pieces = splitting.bisect_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _, _ in pieces)
    assert "".join(text[core:b] for _, b, core, _ in pieces) == text
    kept = max(0, min(overlap, (limit - 1) // 2))
    assert all(core - a >= min(kept, core) for a, _, core, _ in pieces)
    # the cuts show every stretch above the limit, as measuring the whole text does
    stretch = max((len(x) for x in re.split(r"[\s.!?…。！？]+", text)), default=0)
    cut = splitting.cut_stretch(text, [p[2] for p in pieces[1:]])
    assert cut <= stretch and (cut > limit) == (stretch > limit)


def test_cuts_at_paragraph_and_hard():
    text = "a" * 40 + "\n\n" + "b" * 40
    assert [p[:3] for p in splitting.bisect_text(text, 50, 0)] == [(0, 42, 0), (42, 82, 42)]
    assert any(p[3] == 0 for p in splitting.bisect_text("x" * 100, 30, 5))
    far = "a" * 8 + "\n\n" + "b" * 90  # the only boundary lies far from the middle and keeps its strength
    assert (10, 5) in [(p[2], p[3]) for p in splitting.bisect_text(far, 95, 0)]
    worded = " ".join(f"word{i:03d}" for i in range(60))
    starts = [a for a, _, _, _ in splitting.bisect_text(worded, 100, 20)]
    assert len(starts) > 4 and all(a == 0 or worded[a - 1] == " " for a in starts)


def test_split_frame(spark):
    rows = [("d", "1", "o", "x" * 50), ("d", "2", "o", "w " * 30), ("d", "3", "o", "short"), ("d", "4", "none", "x" * 99), ("d", "5", "o", None), ("d", "6", None, "x" * 99)]
    df = spark.createDataFrame(rows, "src string, item_id string, owner string, text string").withColumn("target_chars", F.lit("clash"))
    limits = spark.createDataFrame([("o", 20, 5), ("o", 20, 5), ("none", None, None)], "owner string, target_chars int, overlap_chars int")
    got = {r.item_id: r for r in splitting.split_oversized(df.select("src", "item_id", "owner", "text"), limits).collect()}
    assert set(got) == {"1", "2"} and got["1"].longest == 50 and got["2"].longest == 0 and got["2"].hard_cuts == 0


# ---- markup

KIND_CASES = [
    ("plain text, [5] and $100 to $200, x < 5 and y > 2, a_b_c, 2*3*4, (*), #4, C:\\data\\x, R&D, <a@b.example>", []),
    ("<p>Hi</p>", ["html"]), ("a&nbsp;b", ["html"]), ("a &lt;i&gt;b", ["html"]), ("x <!-- n --> y", ["html"]), ("a <br> b", ["html"]),
    ("# Head\ntext", ["markdown"]), ("Head\n=====\n", ["markdown"]), ("a **b** c", ["markdown"]), ("[a](https://x.y)", ["markdown"]), ("x[^1]", ["markdown"]), ("~~x~~", ["markdown"]),
    ("`code <b>`", ["markdown"]), ("```\n<p>'''x'''</p>\n```", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("== H ==\n", ["wiki"]), ("[[a|b]]", ["wiki"]), ("{{t|x}}", ["wiki"]), ("it is ''so'' nice", ["wiki"]), ("{| class=x\n|-\n| a || b\n|}", ["wiki"]), ("[https://x.y label]", ["wiki"]),
    ("\\emph{a}", ["latex"]), ("$x_{1} \\le 2$", ["latex"]), ("$$a^2$$", ["latex"]), ("{\\displaystyle x}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
    ("<b>x</b> and **y**", ["html", "markdown"]), ("<pre><code>'''a''' **b**</code></pre>", ["html"]), ("", []),
]


@pytest.mark.parametrize("text,want", KIND_CASES)
def test_markup_kinds(text, want):
    assert markup.extract(text)[1] == want


def cleaned(text):
    return markup.extract(text)[0]


def test_clean_text():
    assert cleaned("<h2>T</h2><p>One<br>two</p><ul><li>a<li>b</ul>") == "## T\nOne\ntwo\n- a\n- b"
    assert cleaned("== H ==\n{{box|x}}\nsee [[a|b]] and '''c'''\n* [[d]]") == "## H\nsee b and c\n- d"
    assert cleaned("Head\n====\n**b** [l](http://x) ![i](http://y)[^2]") == "# Head\nb l i"
    assert cleaned("\\section{S}\nA \\textbf{b}\\cite{k} is $x_{1}$\n\\begin{itemize}\n\\item c\n\\end{itemize}") == "## S\nA b is $x_{1}$\n- c"
    assert cleaned("```\nx = '''1''' **y**\n```") == "```\nx = '''1''' **y**\n```"
    assert cleaned("a &lt;i&gt;b&lt;/i&gt; c") == "a b c"


def test_host_votes_drop_link_bars(spark):
    page = '<div class="nav1"><a href="x">Home of all pages</a> <a href="y">Next</a></div><div class="c{0}"><p>{1}</p></div>'
    rows = [("d", i, "h", page.replace("{0}", str(i)).replace("{1}", EN)) for i in range(6)] + [("d", 90, "h", None), ("d", 91, None, "<p>x</p>"), ("d", 92, "h", "plain"), ("d", 0, "h", page.replace("{0}", "0").replace("{1}", EN))]
    df = spark.createDataFrame(rows, "src string, item_id long, host string, text string")
    got = {r.item_id: r for r in markup.clean_markup(df).collect()}
    assert got[0].clean == EN and "Home" not in got[3].clean
    assert got[90].clean is None and list(got[90].kinds) == [] and got[91].clean == "x" and got[92].clean == "plain"
    assert markup.clean_markup(df.limit(0)).count() == 0


def test_every_page_has_one_vote(spark):
    """A long page does not outvote the others, menus lose in their host only, and what loses shows no kind of its own."""
    menu = "<ul class=\"menu7\"><li><a href=\"a\">Home '''x''' of pages</a></li><li><a href=\"b\">Next page of these</a></li></ul>"
    page = menu.replace("7", "{0}") + '<div class="c{0}"><p>' + EN + "</p></div>"
    rows = [("d", i, "h", page.replace("{0}", str(i))) for i in range(5)]
    rows += [("d", 10, "h", '<ul class="menu1"><li>' + (EN + " ") * 400 + "</li></ul>")]  # one page that uses the same path for text
    rows += [("d", 20, "g", '<ul class="menu1"><li>' + EN + "</li></ul>"), ("d", 21, None, menu)]
    df = spark.createDataFrame(rows, "src string, item_id long, host string, text string")
    votes = {(r.host, r.path): (r.votes_for, r.votes_against) for r in markup.host_votes(df.repartition(3)).collect()}
    assert votes["h", "ul.menu#>li"] == (1, 5) and votes["g", "ul.menu#>li"] == (1, 0) and votes["h", "div.c#>p"] == (5, 0)
    got = {r.item_id: r for r in markup.clean_markup(df).collect()}
    assert all(got[i].clean == EN and list(got[i].kinds) == ["html"] for i in range(5))
    assert got[10].clean.startswith("- App")  # the vote leaves nothing of this page, so it stays
    assert got[20].clean == f"- {EN}" and "wiki" in got[21].kinds
    votes = markup.host_votes(df)
    plain, salted = (sorted(map(str, markup.with_losing_paths(df, votes, most_paths=n).select("item_id", "losing").collect())) for n in (100, 0))
    assert plain == salted


def test_no_bound_on_length_or_depth():
    assert markup.extract("`" + "x" * 500 + "`")[1] == ["markdown"] and markup.extract("a *" + "x y " * 50 + "z* b")[1] == ["markdown"]
    assert markup.extract("{{a|{{b|{{c|{{d|{{e|f}}}}}}}}}} rest") == ("rest", ["wiki"])
    assert markup.extract("\\a{\\b{\\c{\\d{\\e{deep}}}}}") == ("deep", ["latex"])
    assert markup.extract("a $" + "x" * 300 + "$ b")[1] == ["latex"]


def test_one_kind_makes_no_other():
    text = "<h2>T</h2><ul><li>one</li></ul>\n\\section{S}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n$a_{1}*b*c$"
    clean, kinds = markup.extract(text)
    assert kinds == ["html", "latex"] and clean.startswith("## T\n- one") and "## S\n- x" in clean and "$a_{1}*b*c$" in clean
    assert markup.extract(" x  1")[1] == []


# ---- leakage


def passage(rng, n):
    return " ".join(rng.choice(["alpha", "the", "of", "river", "beta", "stone", "tower"]) + str(rng.randint(0, 400)) for _ in range(n))


def brute(doc, item, share=0.4, per=8):
    """Longest aligned stretch with at most one change in eight words, by trying all."""
    a, b, best = leakage.folded_words(doc or ""), leakage.folded_words(item), 0
    for d in range(-len(b), len(a)):
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = [a[i + d] == b[i] for i in range(lo, hi)]
        for x in range(len(same)):
            wrong = 0
            for y in range(x, len(same)):
                wrong += not same[y]
                if wrong * per <= y - x + 1:
                    best = max(best, y - x + 1)
    return best >= leakage.needed(len(b), share)


def test_split_and_joined_words():
    rng = random.Random(4)
    words = passage(rng, 40).split()
    words[9], words[20] = "koprusu'nun", "gorunur"
    held = words[:20] + ["goru.nur"] + words[21:]
    text = "before it " + " ".join(held).replace("'", " ").replace("goru.nur", "gorunu.r") + " after it"
    item = leakage.word_hashes(" ".join(words))
    assert leakage.best_stretch(leakage.word_hashes(text), item, leakage.np.array([2])) == (41, 1, 2, 0)


def test_guaranteed_run():
    """The run that every sufficient stretch holds, against all ways to spread the changes."""
    for m in range(1, 30):
        worst = m
        for n in range(m, 2 * m + 16):
            c = n // 8
            worst = min(worst, -(-(n - c) // (c + 1)))
        assert leakage.guaranteed_run(m) == worst
    assert [leakage.guaranteed_run(m) for m in (1, 4, 9, 10, 17, 18, 49)] == [1, 4, 4, 5, 5, 6, 7]


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, passage(rng, rng.randint(30, 60))) for i in range(12)]
    docs = []
    for d in range(90):
        i, p = rng.choice(items)
        w = p.split()
        n = int(len(w) * rng.choice([0.2, 0.3, 0.45, 0.6, 1.0]))
        at = rng.randint(0, len(w) - n)
        piece = w[at : at + n]
        for k in range(len(piece)):
            if rng.random() < rng.choice([0.0, 0.05, 0.1]):
                piece[k] = piece[k][::-1]
        piece = [x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "!"]) for x in piece]
        docs.append((d, passage(rng, 20) + " " + rng.choice([" ", "\n"]).join(piece) + ". " + passage(rng, 20)))
    docs += [(200, None), (201, ""), (202, "short"), (203, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    it = spark.createDataFrame([*items, items[0], (99, None), (98, " !? ")], "item_id long, passage string")
    want = {(d, i) for d, t in docs for i, p in items if brute(t, p)}
    for block in (5, 1000):
        got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, block_items=block).collect()}
        assert got == want
    assert leakage.find_leaks(df.limit(0), it).count() == 0 and leakage.find_leaks(df, it.limit(0)).count() == 0


def test_short_items_and_changes_at_every_place(spark):
    """Items of 5 to 60 words, the shortest sufficient stretch, changes spread so that runs are as short as they can be or anywhere."""
    rng = random.Random(5)
    items, docs = [], []
    for i, n in enumerate([5, 6, 8, 10, 12, 14, 17, 20, 22, 23, 25, 26, 30, 38, 40, 45, 52, 60]):
        words = [f"w{i}x{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        m = leakage.needed(n)
        for size in {m - 1, m, min(n, m + 3), min(n, 8), min(n, 16)} - {0}:
            for at in {0, (n - size) // 2, n - size}:
                piece = words[at : at + size]
                c = size // 8
                spread_out = [round((k + 1) * size / (c + 1)) - 1 for k in range(c)]
                for changed in (spread_out, sorted(rng.sample(range(size), c)), sorted(rng.sample(range(size), min(size, c + 1)))):
                    text = [("changed" if k in changed else w) for k, w in enumerate(piece)]
                    docs.append((len(docs), "some text before " + " ".join(text) + " and after"))
    want = {(d, i) for d, t in docs for i, p in items if brute(t, p)}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, telling=0.0).collect()}
    assert want <= got and all(brute(docs[d][1], items[i][1]) for d, i in got)
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, telling=0.0, block_items=3).collect()} == got
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, telling=0.0, block_words=40).collect()} == got


def test_same_subject_is_no_leak_whatever_the_block(spark):
    common = "the council of {} paid {} crowns to the ferry crews of {} who had carried {} commuters each dawn over the old bridge near {}"
    rng = random.Random(3)
    items = [(i, common.format(*(f"name{rng.randint(0, 10**6)}" for _ in range(5)))) for i in range(12)]
    text = common.format(*(f"other{k}" for k in range(5)))
    df, it = spark.createDataFrame([(1, text), (2, items[0][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    for block in (3, 1000):
        assert [(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it, block_items=block).collect()] == [(2, 0)]


# ---- mixing


def test_tokens(spark):
    rows = [(1, "s", EN), (2, "s", None), (3, "s", "")]
    got = {r.doc_id: r.tokens for r in mixing.count_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1] == len(mixing._encoder(mixing.TOKENIZER).encode_ordinary(EN)) and got[2] == got[3] == 0


TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def test_curriculum_and_shares(spark):
    counted = spark.createDataFrame([(i, "big" if i < 90 else "small", 10) for i in range(100)] + [(200, None, 5), (201, "big", 0)], "doc_id long, source string, tokens long")
    rows = [("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("m", "none", 0.0, None), ("m", "big", 0.5, 1), (None, "big", 1.0, 1), ("n", "none", 1.0, 4)]
    totals = mixing.source_totals(counted.filter("source is not null"))
    demand = mixing.mixture_demand(totals, spark.createDataFrame(rows, TARGETS))
    drawn = mixing.curriculum(counted, demand)
    got = {(r.mix_id, r.source): r for r in mixing.shares_reached(demand, drawn).collect()}
    big, small = got["m", "big"], got["m", "small"]
    assert (big.drawn, big.shortfall, big.copies) == (500, 0, 1) and (small.drawn, small.shortfall, small.copies) == (300, 200, 3)
    assert big.actual_share == pytest.approx(500 / 800) and small.ends_at < 0.6 and big.ends_at == pytest.approx(0.98)
    assert got["m", "none"].shortfall == 0 and got["n", "none"].shortfall == 1000 and got["n", "none"].actual_share == 0
    rows = drawn.collect()
    assert len([r for r in rows if r.source == "small"]) == 30 and len([r for r in rows if r.source == "big"]) == 50
    assert all(0 <= r.position <= 1 for r in rows) and len({(r.doc_id, r.copy) for r in rows}) == 80
    again = mixing.curriculum(counted.repartition(7), demand, rows_per_bucket=7).collect()  # order within a source differs by bucket, sums do not
    assert sorted((r.source, r.tokens, round(r.position, 9)) for r in again) == sorted((r.source, r.tokens, round(r.position, 9)) for r in rows)
    slow = [r for r in mixing.curriculum(counted, demand, stretch=True).collect() if r.source == "small"]
    assert len(slow) == 30 and max(r.position for r in slow) > 0.95
    assert mixing.curriculum(counted.limit(0), demand).count() == 0


def test_schedules_are_input(spark):
    """With b asked for only in the second half, its documents stand there, and the shares are the integrals."""
    counted = spark.createDataFrame([(i, "ab"[i % 2], 5) for i in range(400)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.25, 1)], TARGETS)
    knots = [("m", "a", 0.0, 1.0), ("m", "a", 1.0, 0.0), ("m", "b", 0.5, 0.0), ("m", "b", 1.0, 1.0), ("m", "b", 1.5, 9.0), (None, "b", 0.1, 9.0), ("m", "b", 0.2, None), ("m", "a", 0.0, 1.0)]
    schedules = spark.createDataFrame(knots, "mix_id string, source string, time double, weight double")
    demand = mixing.mixture_demand(mixing.source_totals(counted), targets, schedules)
    rows = mixing.curriculum(counted, demand).collect()
    assert {r.source: round(r.demand, 6) for r in demand.collect()} == {"a": 1000.0, "b": 500.0}
    assert min(r.position for r in rows if r.source == "b") >= 0.5
    early = sum(r.tokens for r in rows if r.source == "a" and r.position < 0.5)
    assert early == pytest.approx(750, abs=5)  # three quarters of a falling line lie in its first half


def test_default_schedules_add_up(spark):
    rows = [("m", "a", 0.7, 1), ("m", "b", 0.25, 1), ("m", "c", 0.05, 1), ("o", "a", 1.0, 1)]
    lines = {(r.mix_id, r.source, r.time): r.weight for r in mixing.schedule_of_targets(spark.createDataFrame(rows, TARGETS)).collect()}
    assert all(w >= 0 for w in lines.values()) and len(lines) == 8
    for t in (0.0, 1.0):
        assert sum(w for (m, _, at), w in lines.items() if m == "m" and at == t) == pytest.approx(1.0)
    for m, s, share, _ in rows:
        assert (lines[m, s, 0.0] + lines[m, s, 1.0]) / 2 == pytest.approx(share)
    assert lines["m", "c", 0.0] > lines["m", "c", 1.0] and lines["m", "a", 0.0] < lines["m", "a", 1.0]


def test_times_invert_the_integral(spark):
    knots = [("m", s, t, w) for s, points in (("up", ((0.0, 0.2), (1.0, 0.6))), ("flat", ((0.3, 0.4),)), ("bent", ((0.0, 0.0), (0.5, 1.0), (0.75, 0.0), (1.0, 0.4)))) for t, w in points]
    curves = mixing.demand_curves(spark.createDataFrame(knots, "mix_id string, source string, time double, weight double"))
    asked = curves.crossJoin(spark.range(0, 101).select((F.col("id") / 100.0).alias("f")))
    got = mixing.with_time(asked, F.col("f") * F.col("share"), name="t").collect()

    def weight(points, t):
        return leakage.np.interp(t, [p[0] for p in points], [p[1] for p in points])

    shapes = {s: [(t, w) for _, x, t, w in knots if x == s] for s in ("up", "flat", "bent")}
    fine = leakage.np.linspace(0, 1, 20001)
    for r in got:
        cumulative = leakage.np.concatenate(([0], leakage.np.cumsum((lambda w: (w[1:] + w[:-1]) / 2)(weight(shapes[r.source], fine)) / 20000)))
        assert leakage.np.interp(r.t, fine, cumulative) == pytest.approx(r.f * r.share, abs=1e-6)
    assert len(got) == 3 * 100  # the whole integral is never passed


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([("m", "1", "tr", TR)], "src string, item_id string, lang string, text string")
    noisy = df.withColumns({c: F.lit("x") for c in ("seg_no", "detected", "confidence", "kind", "start_pos", "end_pos", "tokens", "supply")})
    assert language.detect_languages(noisy, model).first().detected == "tr"
    assert sentences.sentence_units(noisy).first().start_pos == 0
    assert mixing.count_tokens(noisy.withColumn("source", F.lit("s"))).first().tokens > 0
    targets = spark.createDataFrame([("m", "s", 1.0, 2)], TARGETS).withColumn("supply", F.lit("x"))
    assert mixing.mixture_demand(spark.createDataFrame([("s", 10, 1)], "source string, supply long, n_docs long"), targets).first().supply == 10
