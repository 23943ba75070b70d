import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import boilerplate, keyword_pages, prose, reading_level

SUBJECTS, VERBS = ["the teacher", "a student", "our class", "the little dog"], ["reads", "finds", "opens", "keeps"]
OBJECTS = ["an old book", "the green door", "a small box", "the long list"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} in the house near the river".capitalize()


def hard(rng):
    return f"the {rng.choice(['asymptotic', 'heterogeneous'])} formalization {rng.choice(['presupposes', 'subsumes'])} an {rng.choice(['ontological', 'epistemological'])} commitment".capitalize()


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [(i, "en", 1 + i % 2, ". ".join((sentence if i % 2 == 0 else hard)(rng) for _ in range(12)) + ".") for i in range(24)]
    rows += [(90, None, 1, "no lang"), (91, "en", None, "no level"), (92, "en", 1, None)]
    return spark.createDataFrame(rows, "sample_id long, lang string, reading_level int, text string")


def pages_and_links(rng):
    rows, links = [], []
    for i in range(60):
        body = "\n".join(["Home | News | Contact | Search", *(". ".join(sentence(rng) for _ in range(4)) + "." for _ in range(2)), f"Related: X{i} notes, Y{i * 7} lab", f"(c) {2000 + i} Acme. All rights reserved."])
        rows.append((i, "https://www.acme.example/p" + str(i), f"X{i} - Topic {i % 3}", body))
    spam = [" ".join(rng.choice(["cheap", "tablet", "offer", "buy"]) + " " + rng.choice(["nowx", "zork"]) for _ in range(40)), "\n".join(f"{k}. Zig{k} Zag{k * 3}" for k in range(40))]
    for k, text in enumerate(spam):
        rows.append((100 + k, f"https://s{k}.example/", "Spam", text))
        rows.append((110 + k, f"https://s{k}.example/b", None, sentence(rng) + ".\n" + text))
    rows += [(200, "https://e.example/", None, None), (201, None, "", ""), (202, "https://f.example", "t", "Not found."), (3, rows[3][1], rows[3][2], rows[3][3]), (203, "https://g.example/", None, "\n".join(sentence(rng) + "." for _ in range(3)))]
    links += [(r[1], "https://t.example/", "cheap tablet", None) for r in rows[:5]] + [(None, None, None, None), (rows[0][1], "x", None, None)]
    return rows, links


def test_keyword_pages(spark, samples):
    rows, links = pages_and_links(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, body string").withColumn("lang", F.lit("clash"))
    l = spark.createDataFrame(links, "source_url string, target_url string, anchor_text string, discovered_at timestamp")
    out = {r.doc_id: r for r in keyword_pages.judged_pages(docs, "doc_id", "url", "body", l, samples).collect()}
    assert len(out) == len({r[0] for r in rows})
    assert {i for i, r in out.items() if r.found} == {100, 101, 110, 111}
    assert out[200].n_words == 0 and out[202].n_real == 0
    assert keyword_pages.judged_pages(docs.limit(0), "doc_id", "url", "body", l, samples).count() == 0
    assert keyword_pages.judged_pages(docs, "doc_id", "url", "body", l.limit(0), samples.limit(0)).where("found").count() == 0


def test_all_samples_count(spark, samples):
    rows, links = pages_and_links(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, body string")
    l = spark.createDataFrame(links, "source_url string, target_url string, anchor_text string, discovered_at timestamp")
    before = spark.range(-20_000, 0).select(F.col("id").alias("sample_id"), F.lit("xx").alias("lang"), F.lit(1).alias("reading_level"), F.lit("Zig zag zug.").alias("text"))
    many = before.unionByName(samples)
    model, known = prose.load(many), prose.train([(r.lang, r.text) for r in many.collect() if r.lang and r.text])
    assert model["langs"] == ["en", "xx"] and set(model["words"]) == set(known["words"]) and "teacher" in model["words"]
    assert all((model[k] == known[k]).all() for k in ("pairs", "triples", "known", "content"))
    out = keyword_pages.judged_pages(docs, "doc_id", "url", "body", l, many)
    assert {r.doc_id for r in out.where("found").collect()} == {100, 101, 110, 111}


def test_quantiles_are_exact(spark):
    shares = [0.25, 0.5, 0.75]
    df = spark.range(300_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), F.rand(5).alias("x"), F.when(F.col("id") % 10 == 0, F.floor(F.rand(6) * 5)).cast("double").alias("y"),
        F.lit(None).cast("double").alias("z"),
    ).unionByName(spark.createDataFrame([("few", 3.0, None, None), ("few", 1.0, None, None), ("few", 2.0, 7.0, None)], "g string, x double, y double, z double")).localCheckpoint()
    found = {r.g: r for r in keyword_pages.quantiles(df, ["g"], ["x", "y", "z"], shares).collect()}
    rows = df.collect()
    for g in (None, "a", "few"):
        assert found[g].n == sum(r.g == g for r in rows) and found[g].q_z is None
        for m in "xy":
            values = sorted(r[m] for r in rows if r.g == g and r[m] is not None)
            assert found[g][f"q_{m}"] == [values[max(1, math.ceil(s * len(values))) - 1] for s in shares]
    assert keyword_pages.quantiles(df.limit(0), ["g"], ["x"], shares).count() == 0


ITALIAN = {
    "s": ["Il corso di reti", "Ogni studente", "La nostra classe", "Il professore", "Un gruppo di amici", "La biblioteca della scuola"],
    "v": ["presenta agli altri", "descrive con cura", "mette a confronto", "cerca da molti anni", "spiega in poche parole", "conserva per tutti"],
    "o": ["le strutture di dati", "gli alberi e i grafi", "una storia lunga", "il valore delle prove", "la forma di un problema", "i libri del nonno"],
    "e": ["senza fare rumore", "nel primo anno", "prima della fine del mese", "con gli esempi di ieri", "e poi ne parla a casa", "come si fa in ogni laboratorio"],
}
RUSSIAN = {
    "s": ["Курс по сетям", "Каждый студент", "Наш класс", "Учитель", "Группа друзей", "Библиотека школы"],
    "v": ["показывает всем", "описывает для нас", "сравнивает в уме", "ищет уже год", "объясняет на пальцах", "хранит для всех"],
    "o": ["структуры данных", "деревья и графы", "длинную историю", "цену и смысл", "вид задачи", "книги деда"],
    "e": ["без шума", "в первый год", "до конца месяца", "на примере из книги", "и потом идёт домой", "как и в лаборатории"],
}


def strange(rng, words):
    return " ".join(rng.choice(words[k]) for k in "svoe") + "."


def site_in(words, rng, n=60):
    rows = []
    for i in range(n):
        text = [" ".join(strange(rng, words) for _ in range(4)) for _ in range(2)]
        rows.append((i, f"https://www.sito.example/p{i}", f"X{i}", "\n".join(["Home | Novità | Contatti | Cerca", *text, f"© {2000 + i} Sito. Tutti i diritti riservati."])))
    return rows


@pytest.mark.parametrize("words", [ITALIAN, RUSSIAN])
def test_languages_without_samples(spark, words):
    """Prose in a language that no sample has is no spam, and its site's lines are found."""
    rows, rng = graded(), random.Random(12)
    samples = spark.createDataFrame([(r["sample_id"], r["lang"], r["text"]) for r in rows], "sample_id long, lang string, text string")
    site = site_in(words, rng)
    known = [(1000 + k, f"https://p{k}.example/", "t", r["text"]) for k, r in enumerate(rows)]
    spam = [(900, "https://s.example/", "s", " ".join(rng.choice(["offerta", "sconto", "prezzo", "vendita"]) + " " + rng.choice(["scarpe", "telefono", "borsa"]) for _ in range(80)))]
    pages = spark.createDataFrame(site + known + spam, "doc_id long, url string, title string, body string")
    links = spark.createDataFrame([], "source_url string, target_url string, anchor_text string")
    found = {r.doc_id for r in keyword_pages.judged_pages(pages, "doc_id", "url", "body", links, samples).where("found").collect()}
    assert found == {900}
    own = pages.where("doc_id < 900").selectExpr("'docs' AS table_name", "doc_id AS row_id", "url", "title", "body AS text")
    got = {(r.row_id, r.line_no) for r in boilerplate.site_lines(own, samples).collect()}
    assert got == {(i, n) for i in range(60) for n in (0, 3)}


def test_slope_of_a_power_law(spark):
    counts = [round(1000 / r) for r in range(1, 30)]
    df = spark.createDataFrame([(1, counts, [1] * len(counts)), (2, [1], [50])], "id long, counts array<int>, types array<int>")
    got = {r.id: r for r in keyword_pages.curves(df).collect()}
    assert abs(got[1].slope + 1) < 0.02 and got[1].spread < 0.02 and got[2].slope is None


def test_site_lines(spark, samples):
    rows, _ = pages_and_links(random.Random(4))
    rows = [r for r in rows if r[0] not in (100, 101, 110, 111)]
    docs = spark.createDataFrame(list(dict.fromkeys(rows)), "row_id long, url string, title string, text string").withColumn("table_name", F.lit("docs")).withColumn("host", F.lit("clash"))
    got = {(r.row_id, r.line_no) for r in boilerplate.site_lines(docs, samples).collect()}
    assert got == {(i, n) for i in range(60) for n in (0, 3, 4)}
    texts = {r.row_id: r.main_text for r in boilerplate.main_text(docs, boilerplate.site_lines(docs, samples)).collect()}
    assert texts[5] == "\n".join(dict((r[0], r[3]) for r in rows)[5].split("\n")[1:3]) and texts[200] is None and texts[202] == "Not found."
    assert boilerplate.site_lines(docs.limit(0), samples).count() == 0


def test_site_lines_by_all_samples(spark, samples):
    before = spark.range(-20_000, 0).select(F.col("id").alias("sample_id"), F.lit("xx").alias("lang"), F.lit(1).alias("reading_level"), F.lit("Zig zag zug.").alias("text"))
    lines = ["home | news | contact | search", "the teacher reads an old book in the house near the river"]
    rows = [(i, f"https://www.acme.example/p{i}", "\n".join(lines)) for i in range(30)]
    docs = spark.createDataFrame(rows, "row_id long, url string, text string").withColumns({"table_name": F.lit("docs"), "title": F.lit(None).cast("string")})
    got = {(r.row_id, r.line_no) for r in boilerplate.site_lines(docs, before.unionByName(samples)).collect()}
    assert got == {(i, 0) for i in range(30)}  # prose stays, though all pages have it


def test_prose_of_words_that_no_sample_has_stays(spark):
    """Its lines begin alike, as furniture does; of the site's own sentences, which have its shape too, none stays."""
    rng, rows = random.Random(6), []
    graded_rows = [(r["sample_id"], r["lang"], r["text"]) for r in graded()]
    new = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    for i in range(60):
        alike = f"If the {new()} of a {new()} is {new()}, the {new()} will {new()} in {new()}."
        own = f"Unlike {new()}, {new()} and {new()} have no {new()} to {new()} with {new()}."
        note = f"This site keeps small files on your device to remember the settings of {rng.choice(['readers', 'guests'])}."
        rows.append((i, f"https://www.acme.example/p{i}", f"X{i}", "\n".join(["Home | News | Contact | Search", alike, own, note, f"Related: {new()} notes, {new()} lab"])))
    docs = spark.createDataFrame(rows, "row_id long, url string, title string, text string").withColumn("table_name", F.lit("docs"))
    samples = spark.createDataFrame(graded_rows, "sample_id long, lang string, text string")
    got = {(r.row_id, r.line_no) for r in boilerplate.site_lines(docs, samples).collect()}
    assert got == {(i, n) for i in range(60) for n in (0, 3, 4)}


def test_elements_of_a_dom(spark, samples):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        prose_text = "".join(f"<p>{sentence(rng)}. {sentence(rng)} {i}.</p>" for _ in range(2))
        teaser = f"<div class='promo'><span>offer {rng.choice('abc')}</span></div>"
        rows.append((i, "https://www.acme.example/p" + str(i), f"<html><head><title>T{i}</title><style>p {{}}</style></head><body><div class='menu'><ul><li>Home</li><li>News &amp; more</li></ul></div><div class='main'><h1>{chr(97 + i % 26) * 3}{chr(98 + i // 26)} chapter</h1>{prose_text}</div>{teaser}<br></body></html>"))
    rows += [(90, "https://www.acme.example/e", None), (91, None, "")]
    pages = boilerplate.html_lines(spark.createDataFrame(rows, "id long, url string, html string"), "id", "url", "html")
    first = pages.where("row_id = 0").first()
    assert first.title == "T0" and first.text.split("\n")[:3] == ["Home", "News & more", "aaab chapter"] and first.paths[0] == "body./div.menu/ul./li." and len(first.paths) == 6
    got = {(r.row_id, r.line_no) for r in boilerplate.site_lines(pages, samples).collect()}
    assert got == {(i, n) for i in range(40) for n in (0, 1, 5)}


def test_importance_is_that_of_entropy(spark):
    import math

    rows = [("h", 1, 4, 4, 0.0), ("h", 2, 4, 8, 5 * math.log(5)), ("h", 3, 1, 1, 0.0)]
    nodes = spark.createDataFrame(rows, "host string, node long, k long, c long, s double")
    got = {r.node: r.share for r in boilerplate.sized(nodes, spark.createDataFrame([("h", 11)], "host string, m long")).collect()}
    entropy = -sum(p * math.log(p) for p in (5 / 8, 1 / 8, 1 / 8, 1 / 8))
    assert abs(got[1] - 0.3) < 1e-12 and abs(got[2] - (math.exp(entropy) - 1) / 10) < 1e-12 and got[3] == 0


def test_plain_repairs_and_signs():
    assert boilerplate.plain("BÃºsqueda") == "búsqueda" and boilerplate.plain("Q &amp; A ") == "q & a"
    assert boilerplate.signs("© 2024-05 Acme | My page", "acme", "my page") == ["#", "@", "titlesign"]


def test_levels(spark, samples):
    rng = random.Random(6)
    texts = {
        1: ". ".join(sentence(rng) for _ in range(9)), 2: ". ".join(hard(rng) for _ in range(9)).upper(), 3: ". ".join([*(sentence(rng) for _ in range(5)), *(hard(rng) for _ in range(2))]),
        4: None, 5: "", 6: "1 2 3 ...", 7: "zzz qqq xxx. yyy zzz", 8: ". ".join(hard(rng) for _ in range(4000)),
    }
    rows = [*texts.items(), (1, texts[1]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("clash"))
    got = {r.doc_id: r for r in reading_level.reading_levels(df, "doc_id", "text", samples).collect()}
    assert len(got) == 9
    assert [got[i].reading_level for i in (1, 2, 3, 4, 5, 6, 8, None)] == [1, 2, 1, None, None, None, 2, 1]
    assert got[7].lang is None and got[7].reading_level in (1, 2) and got[4].n_words == 0
    empty = reading_level.reading_levels(df, "doc_id", "text", samples.limit(0)).collect()
    assert len(empty) == 9 and all(r.reading_level is None for r in empty)
    assert reading_level.reading_levels(df.limit(0), "doc_id", "text", samples).count() == 0


def test_held_out_levels():
    pd = pytest.importorskip("pyarrow.parquet")
    try:
        rows = pd.read_table("/root/testdata/sf0.001/reading_samples.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data")
    right = 0
    for fold in range(4):
        model = reading_level.train([(r["lang"], r["reading_level"], r["text"]) for i, r in enumerate(rows) if i % 4 != fold])
        held = [r for i, r in enumerate(rows) if i % 4 == fold]
        right += sum(j[:2] == (r["lang"], r["reading_level"]) for r, j in zip(held, reading_level.judge([r["text"] for r in held], model)))
    assert right >= 0.95 * len(rows)


def test_prose_model_counts_by_brute_force():
    model = prose.train([("en", "the cat sat on the mat. a dog ran"), ("en", "the cat sat on the mat. a dog ran")])
    s = prose.Sentences(["the cat sat on the mat! xx yy zz", None, "", "a dog | ran"], model)
    assert s.owner.tolist() == [0, 0, 3, 3] and s.size.tolist() == [6, 3, 2, 1]
    assert s.pairs.tolist() == [7, 0, 2, 1] and s.triples.tolist() == [6, 0, 1, 0]
    assert s.real().tolist() == [True, False, False, False]


def graded():
    pq = pytest.importorskip("pyarrow.parquet")
    try:
        return pq.read_table("/root/testdata/sf0.001/reading_samples.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data")


def dressed(rng):
    """German keywords dressed up as sentences, as TESTDATA counts among keywords."""
    goods = ["pliabet studienkredit", "laptop angebot stuvap", "briavur klausur lösungen", "gratis skripte yuzaedrind", "rucksack sale brarip"]
    a, b, c = (rng.choice(goods) for _ in range(3))
    return rng.choice([f"das ist die {a} und der {b} für {a}", f"die {a} und die {b} für die {a}", f"alle {a} in der {b} mit der {c}"])


def test_keywords_strung_on_function_words_are_no_sentences():
    rows, rng = graded(), random.Random(7)
    model = prose.train([(r["lang"], r["text"]) for r in rows])
    strings = ["das ist die pliabet studienkredit und der laptop angebot stuvap für pliabet studienkredit", "le sac soldes heikein et le offre portable gouzoukrirk pour le sac soldes heikein", *(dressed(rng) for _ in range(200))]
    assert not prose.Sentences(strings, model).real().any()
    s = prose.Sentences([r["text"] for r in rows if r["lang"] == "de"], model)
    assert s.real()[s.size >= 6].mean() > 0.95
    s = prose.Sentences(["Unsere Klasse spricht über Zeiglil, danach sendet der Kalender ein Bild."], model)
    assert s.real().tolist() == [True] and s.content[0] >= prose.LEAST_CONTENT


def test_german_pages_of_dressed_keywords_are_found(spark):
    rows, rng = graded(), random.Random(8)
    prose_rows = [(k, f"https://p{k}.example/", r["text"]) for k, r in enumerate(r for r in rows if r["lang"] == "de")]
    first = "Unsere Klasse spricht über Zeiglil, danach sendet der Kalender ein Bild.\n"
    spam = [(900 + k, f"https://s{k}.example/", (first if k % 2 else "") + ". ".join(dressed(rng) for _ in range(25)) + ".") for k in range(6)]
    docs = spark.createDataFrame(prose_rows + spam, "doc_id long, url string, body string")
    samples = spark.createDataFrame([(r["sample_id"], r["lang"], r["text"]) for r in rows], "sample_id long, lang string, text string")
    links = spark.createDataFrame([], "source_url string, target_url string, anchor_text string")
    out = keyword_pages.judged_pages(docs, "doc_id", "url", "body", links, samples)
    assert {r.doc_id for r in out.where("found").collect()} == {r[0] for r in spam}
