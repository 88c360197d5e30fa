import unicodedata

from corpuslane.llm import lookalike as L

SCHEMA = "doc_id bigint, text string, form string, ch string"
BASE = "Über café: the model saves 72 points"
SAME = [BASE, "Über café: the model saves 72 points", "Über café: the mоdеl saves 72 points", "Über café: the mo​del saves 72 points", "Über café: the ｍｏｄｅｌ saves 72 points"]
OTHER = ["Über café: the Model saves 72 points", "Über café: the model saves 7² points", "Uber café: the model saves 72 points", "Über café: the model saves 72 points."]


def make(spark, texts):
    return spark.createDataFrame([(i, t, "f", "c") for i, t in enumerate(texts)], SCHEMA)


def brute(t, tables):
    t = "".join(tables.decompositions.get(c, c) for c in t)
    return unicodedata.normalize("NFC", "".join(L.LOOKALIKES.get(c, c) for c in t))


def test_pairs(spark):
    texts = SAME + OTHER + [BASE, None, "", "  ", "​  ", "​"]
    got = {(r.doc_a, r.doc_b) for r in L.same_looking_pairs(L.one_form(make(spark, texts + []))).collect()}
    same = list(range(len(SAME))) + [len(SAME) + len(OTHER)]
    assert got == {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]}


def test_forms_equal_normalisation(spark):
    tables = L.Tables()
    texts = SAME + OTHER + ["ạ̇ ạ̇", "ḍ̇", "ʼﬁnal ﬃ", "й ё Й Россия", "́ lone", "q̣̇ẍ́", "ǖ ǖ ṻ", "K Å Ω", "日本語　ﾃｽﾄ", "x" * 9000 + "́" + "о" * 9000, "🙂‍🙂 é"]
    got = {r.doc_id: r.form for r in L.one_form(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, tables), t[:40]


def test_repeats_and_empty(spark):
    df = make(spark, [BASE, None])
    assert L.one_form(df.unionByName(df)).count() == 2
    assert L.one_form(df.where("false")).count() == 0 and L.same_looking_pairs(L.one_form(df.where("false"))).count() == 0


def test_hangul_and_far_mark_classes_equal_nfc(spark):
    texts = ["한국어 문장", "각각", "가", "힣 끝", "ᄀᄀ 홀로", "각ᆨ", "a\u0331\u1dc5\u0323\u20e8 x", "\u05e9\u05c1\u05bc", "\u0915\u093c\u094d"]
    stored = [(i, unicodedata.normalize(how, t)) for i, t in enumerate(texts) for how in ("NFC", "NFD")]
    got = L.one_form(spark.createDataFrame(stored, "doc_id bigint, text string")).collect()
    for r in got:
        assert r.form == unicodedata.normalize("NFC", texts[r.doc_id]), r


def test_members_are_one_row_a_document(spark):
    rows = [(i, "é" if i % 2 else "e\u0301") for i in range(300)] + [(1000, "alone"), (1001, None)]
    forms = L.one_form(spark.createDataFrame(rows, "doc_id bigint, text string"))
    members = L.form_members(forms).collect()
    assert len(members) == 300 and len({m.form_id for m in members}) == 1 and {m.spellings for m in members} == {2}
