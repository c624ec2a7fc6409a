import random

import numpy as np
import pytest

from pressmill.llm.language import LanguageModel, fit_model, identify, label_language
from pressmill.llm.readability import DEFAULT_CUTS, document_grade, fit_cuts, grades, reading_levels, sentences, syllables

TEXT = {
    "en": "the bank said this month that most of the customers in the valley still use a simple loan and the office will open before noon".split(),
    "vi": "ngân hàng cho biết nhiều khách hàng ở vùng hồ vẫn dùng dịch vụ phổ biến và cửa hàng sẽ mở rộng thêm trong tháng này".split(),
    "es": "el banco dijo que los vecinos del barrio todavía esperan una respuesta sobre el préstamo y la oficina abrió ayer con millones".split(),
    "pt": "o banco disse que os moradores do bairro ainda esperam uma resposta sobre o empréstimo e o escritório abriu ontem com milhões".split(),
    "fr": "la banque a dit que les habitants du quartier attendent encore une réponse sur le prêt et le bureau ouvre hier avec des millions".split(),
    "de": "die bank sagte dass die nachbarn noch immer auf eine antwort zum kredit warten und das büro öffnet gestern mit millionen euro".split(),
}
JA = ["顧客の重要な価格は、まだ投資家を待っている。", "銀行は今週、新しい手数料を計画している。", "市場の小さな会社は、まだ契約を待っている。"]


def line(lang, rng, n=14):
    return rng.choice(JA) + rng.choice(JA) if lang == "ja" else " ".join(rng.choice(TEXT[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    langs = [*TEXT, "ja"]
    rows = []
    for i in range(420):
        lang = langs[i % 7]
        rows.append((i, "\n".join(line(lang, rng) for _ in range(5)), lang if i % 10 else "en", lang))
    return rows


@pytest.fixture(scope="module")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, label, "x", 0.5) for i, t, label, _ in corpus], "doc_id long, text string, lang string, line_no string, confidence double")


@pytest.fixture(scope="module")
def model(documents):
    return fit_model(documents)


def test_labels():
    for label, lang in [("en-US", "en"), ("EN GB", "en"), ("vietnamese", "vi"), ("VN", "vi"), ("vi_VN", "vi"), ("deu", "de"), ("jpn", "ja"), ("id", None), ("und", None), ("", None), (None, None), ("  fr ", "fr")]:
        assert label_language(label) == lang


def test_documents_in_spite_of_wrong_labels(documents, model, corpus):
    found = {r.doc_id: r for r in identify(documents, model).where("line_no = -1").collect()}
    assert len(found) == len(corpus)
    right = sum(found[i].lang == lang for i, _, _, lang in corpus)
    assert right == len(corpus)
    assert all(found[i].label_ok == (label == lang) for i, _, label, lang in corpus)
    assert min(r.confidence for r in found.values()) > 0.9


def test_lines_in_another_language(spark, model):
    rng = random.Random(9)
    rows = []
    for i, (main, other) in enumerate([("en", "vi"), ("vi", "en"), ("fr", "de"), ("pt", "es"), ("en", "ja"), ("de", "fr")]):
        lines = [line(main, rng) for _ in range(6)]
        lines[3] = line(other, rng)
        rows.append((i, "\n".join(lines), main, other))
    table = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.line_no, r.lang) for r in identify(table, model).where("line_no >= 0").collect()}
    assert got == {(i, 3, other) for i, _, _, other in rows}


def test_edge_cases(spark, model):
    digest = "d0978736ae4383925b808188923620433d989fcfdb4e7248b26338fa803cb22b " * 20
    rng = random.Random(2)
    rows = [(1, None, "en"), (2, "", None), (3, "12345 !!", "en"), (4, line("vi", rng) + "\n" + digest, "vi"), (5, line("en", rng, 60_000), "en"), (None, line("es", rng), "es"), (5, line("en", rng), "en")]
    found = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    by = {(r.doc_id, r.line_no): r.lang for r in found}
    assert by == {(1, -1): None, (2, -1): None, (3, -1): None, (4, -1): "vi", (5, -1): "en", (None, -1): "es"}
    assert len(found) == 7


def test_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty, fit_model(empty)).count() == 0
    assert identify(spark.createDataFrame([(1, "hello there", "en")], "doc_id long, text string, lang string"), LanguageModel.fit([])).count() == 1


def test_unseen_words_back_off_to_their_letters(model):
    scores, words, known = model.score(["ungesehenes xyz nachbarschaft"])
    assert words[0] == 3 and known[0] == 0 and np.isfinite(scores).all()


def test_syllables():
    for word, n in [("cat", 1), ("table", 2), ("banks", 1), ("opened", 2), ("wanted", 2), ("use", 1), ("regulatory", 5), ("securitisation", 6), ("hm", 1)]:
        assert abs(syllables(word) - n) <= (1 if n > 4 else 0), word


def test_sentences_need_an_end():
    assert sentences("no end here") == []
    assert len(sentences("One is here. Two is there!")) == 3


def test_grades_grow_with_difficulty():
    easy = ["My dog is big. We can see the cat. You can go home now."] * 3
    hard = ["Notwithstanding heterogeneous regulatory considerations, institutional securitisation necessitates epistemological qualification of microeconomic intermediation."] * 3
    assert document_grade(easy, "en") + 8 < document_grade(hard, "en")
    assert document_grade(["no sentence"], "en") is None


def test_cuts_and_their_defaults():
    pairs = [("en", g + 0.01 * k, level) for level, g in ((1, 2), (2, 6), (3, 12), (4, 20)) for k in range(50)]
    cuts = fit_cuts(pairs)
    assert 2.5 < cuts["en"][0] < 6.1 and 6.4 < cuts["en"][1] < 12.1 and 12.4 < cuts["en"][2] < 20.1
    assert cuts["vi"] == DEFAULT_CUTS["vi"] == fit_cuts([])["vi"]


def test_reading_levels(spark, model):
    easy = "The bank said the office will open. Most of the customers use a loan. " * 12
    hard = ("this month most customers of the valley bank office still use a simple loan because notwithstanding heterogeneous regulatory institutional securitisation "
            "the office will open before noon and necessitates considerable epistemological qualification of the microeconomic intermediation. ") * 6  # fmt: skip
    rows = [(i, easy if i % 2 else hard) for i in range(60)] + [(100, None), (101, ""), (102, "Too short."), (103, "\n".join(JA) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as grade")
    labels = spark.createDataFrame([(i, i, 1 if i % 2 else 4) for i in range(60)] + [(90, 0, None), (91, None, 2)], "label_id long, doc_id long, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, labels, model).collect()}
    assert set(got) == set(range(60))
    assert all(got[i] == 1 if i % 2 else got[i] == 4 for i in range(60))
    assert reading_levels(docs, labels.limit(0), model).count() == 60
    assert grades(docs.limit(0), model).count() == 0
