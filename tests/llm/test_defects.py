import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpuslane.llm import defects as D

GEN = "generation_id bigint, prompt_id string, task string, error string, text string, kind string, defect string, prompt_text string"
PROMPT = "prompt_id string, task string, style string, lang string, prompt_text string"
ASK = "Summarise the core contribution of the uploaded paper on speech segmentation under label imbalance."
GOOD = [
    "The paper studies speech segmentation and introduces a sparse encoder. It reports consistent gains in recall on two corpora.",
    "**Strengths**\n- The paper is clear about the data that it uses.\n- The evaluation covers several seeds.\n\n**Weaknesses**\n- No discussion of rare entities\n- No discussion of rare entities",
    '{"summary": "The query concerns speech segmentation.", "key_findings": ["The encoder improves recall [S1]."]}',
    ASK + '\n\n{"summary": "The query concerns speech segmentation.", "key_findings": ["The encoder improves recall."], "citations": ["S1"]}',
    "I cannot verify every number without the full tables, but the main points are clear. The encoder improves recall on the test corpus. The authors release their guidelines.",
]
BAD = {
    "empty": [None, " ", "N/A", "```json\n```", '{"summary": "", "key_findings": []}', "# Scope\n\n# Contribution\n\n", "**Strengths**\n-\n\n**Weaknesses**\n-", "<think></think>\n"],
    "truncated": ["The paper studies speech segmentation and introduces a sparse encoder. It reports consistent gains in", '{"summary": "The query concerns speech segm', ASK + '\n\n{"summary": "The query concerns speech segm', "The paper studies speech segmentation. We release annotation…"],
    "refusal": ["I'm sorry, but I cannot help with this request. Thank you for understanding.", "Lo siento, pero no puedo ayudar con esta solicitud.", '{"summary": "Apologies, I am not able to provide that.", "key_findings": []}'],
    "copied_question": [ASK, f"**{ASK.upper()}**", f"Question: {ASK}", ASK.replace("core ", ""), f"{ASK}\n\n{ASK}"],
    "other_language": ["Les résultats suggèrent que la régularisation joue un rôle décisif dans la plupart des cas. Le modèle ne nécessite aucune supervision.", "Die Ergebnisse legen nahe, dass größere Datenmengen nur begrenzt helfen. Das Modell benötigt keine Annotationen und ist nicht auf eine Sprache begrenzt."],
}


BACKGROUND = "/root/testdata/sf0.01"


def found(spark, rows, prompts, background=False):
    """Labels of the rows; no function is trusted by itself, so a corpus to learn from may be put beside them."""
    g, p = spark.createDataFrame(rows, GEN), spark.createDataFrame(prompts, PROMPT)
    if background:
        more = spark.read.parquet(f"{BACKGROUND}/model_generations.parquet").withColumn("generation_id", -F.col("generation_id") - 1)
        g = g.select("generation_id", "prompt_id", "error", "text").unionByName(more.select("generation_id", "prompt_id", "error", "text"))
        p = p.unionByName(spark.read.parquet(f"{BACKGROUND}/prompt_records.parquet").select(p.columns))
    return {r.generation_id: r.defect for r in D.one_defect(D.labels(D.with_votes(D.prepare(g, p)))).where("generation_id >= 0").collect()}


@pytest.mark.skipif(not os.path.isdir(BACKGROUND), reason="no test data")
def test_each_defect(spark):
    prompts = [("X1", "t", "s", "en", ASK), ("X2", "t", "s", "en", "Explain it. Please reply in French."), ("X1", "t", "s", "en", ASK)]
    rows, want, i = [], {}, 0
    # The last sound answer looks much like a refusal; were it a quarter as common as refusals, votes alone would take it for one.
    for k in range(12):
        for t in GOOD if k == 0 else GOOD[:-1]:
            i += 1
            rows.append((i, "X1", None, None, t, "k", "d", "x"))
    for d, texts in BAD.items():
        for t in texts:
            i += 1
            want[i] = d
            rows.append((i, "X1", None, None, t, "k", "d", "x"))
    i += 1
    rows.append((i, "X2", "t", None, BAD["other_language"][0], "k", "d", "x"))  # what was asked for
    i += 1
    rows.append((i, "nobody", None, "content filter", GOOD[0], "k", "d", "x"))
    assert found(spark, rows + rows[:7], prompts, background=True) == want


def test_nothing(spark):
    assert found(spark, [], []) == {} and found(spark, [(1, None, None, None, GOOD[0], None, None, None)], []) == {}
    assert found(spark, [(1, "P", None, None, "word " * 40_000 + "end.", None, None, None)], [("P", "t", "s", "en", ASK)]) == {}


def fitted(patterns, names):
    model = D.LabelModel(names).fit(patterns)
    return dict(zip([v for v, _ in patterns], model.odds([v for v, _ in patterns])))


def test_label_model_separates():
    odds = fitted([("111", 50), ("000", 900), ("100", 20), ("-11", 5)], ["a", "b", "c"])
    assert odds["111"] > 5 and odds["-11"] > 2 and odds["000"] < -5 and odds["100"] < 0


def test_label_model_beats_every_fixed_rule_on_votes():
    """Six noisy functions with known truth: no OR of any subset of them, nor any single one, labels as well as EM."""
    rng = random.Random(7)
    hit, noise, silent = [0.95, 0.8, 0.75, 0.7, 0.85, 0.6], [0.03, 0.06, 0.02, 0.08, 0.05, 0.01], [0.0, 0.2, 0.1, 0.0, 0.4, 0.0]
    rows = []
    for _ in range(20_000):
        truth = rng.random() < 0.05
        rows.append((truth, "".join("-" if rng.random() < s else str(int(rng.random() < (h if truth else n))) for h, n, s in zip(hit, noise, silent))))
    odds = fitted(sorted(Counter(v for _, v in rows).items()), list("abcdef"))
    wrong = lambda rule: sum(rule(v) != truth for truth, v in rows)
    rules = [wrong(lambda v, at=at: any(v[i] == "1" for i in at)) for k in range(1, 7) for at in combinations(range(6), k)]
    assert wrong(lambda v: odds[v] > 0) * 3 < min(rules)
    # One loud function alone is overruled, several weak ones without it carry a label.
    assert odds["100000"] < 0 < odds["011110"]


def test_cutoffs_are_chosen_on_planted_rows(spark):
    """The planted sample gets votes but teaches nothing, and cutoffs and figures come from it."""
    prompts = [("P1", "t", "s", "en", ASK), ("P2", "t", "s", "fr", "Explique la segmentation de la parole et ses limites à un débutant."), (None, None, None, None, None)]
    good = [GOOD[0] + f" It was run {i} times." for i in range(60)]
    rows = [(i, "P1", None, None, t, "k", "d", "x") for i, t in enumerate(good)] + [(100 + i, "P2", None, None, BAD["other_language"][0] + f" Voir {i}.", "k", "d", "x") for i in range(20)]
    g, p = spark.createDataFrame(rows, GEN), spark.createDataFrame(prompts, PROMPT)
    planted = D.plant(g, p, rows=40)
    assert {r.planted for r in planted.select("planted").distinct().collect()} == {"none", "truncated", "copied_question", "empty", "refusal", "other_language"}
    every = g.select("generation_id", "prompt_id", "error", "text", F.lit(None).cast("string").alias("planted")).unionByName(planted)
    votes = D.with_votes(D.prepare(every, p))
    figures = D.validated_cutoffs(D.pattern_odds(votes)[0]).set_index("defect")
    assert all(figures.loc[d, "recall"] >= 0.9 and figures.loc[d, "precision"] >= 0.9 for d in ("empty", "copied_question"))
    assert D.labels(votes).count() == 0  # the real rows are sound


def test_line_ends_are_judged_by_rates(spark):
    """A sound list end that never stood bare, and a cut one whose words once did, get their votes at any size."""
    prose = [f"The system number {w} covers several corpora in the field of speech. It says little on missing metadata. It adds more text about {w} methods." for w in (f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150))]
    kept = "**Strengths**\n- The paper covers several\n- The paper says enough\n- The paper is clear\n- The paper runs well\n\nIt is a fine paper on speech."
    sound, cut = "It is fine.\n- Unclear handling of missing metadata", [f"It is fine.\n- {w} version covers several" for w in ("One", "Another", "This", "That", "Each", "Every", "No", "Any")]
    once = "It is fine.\n- One remark on this.\n- One remark on rarities"
    texts = [*prose, kept, once, sound, *cut]
    for times in (1, 10):
        rows = [(len(texts) * k + i, "nobody", None, None, t, None, None, None) for k in range(times) for i, t in enumerate(texts)]
        votes = D.with_votes(D.prepare(spark.createDataFrame(rows, GEN), spark.createDataFrame([], PROMPT)))
        got = {(texts[r.generation_id % len(texts)], r.truncated__strange_end) for r in votes.where("generation_id % 161 > 150").collect()}
        assert len(texts) == 161 and got == {(once, None), (sound, 0), *((c, 1) for c in cut)}


def test_defects_are_planted_into_all_responses(spark):
    """More than the 1,000 responses that cutoffs were chosen on before; equal planted texts are one row that counts for all."""
    prompts = [("P1", "t", "s", "en", ASK), ("P2", "t", "s", "fr", "Explique la segmentation de la parole et ses limites à un débutant."), ("P3", "t", "s", "en", "Explain it. Please reply in French.")]
    rows = [(i, f"P{i % 3 + 1}", None, None, f"{GOOD[0]} It was run {i} times.", None, None, None) for i in range(1_500)]
    rows += [(2_000, "P1", None, None, "short", None, None, None), (2_001, None, None, None, GOOD[0], None, None, None), (2_002, "nobody", None, None, GOOD[0], None, None, None)]
    g, p = spark.createDataFrame(rows, GEN), spark.createDataFrame(prompts, PROMPT)
    want = {"none": 1_500, "truncated": 1_500, "copied_question": 1_500, "empty": 1_500, "refusal": 1_500, "other_language": 1_000}
    assert {r.planted: r["count"] for r in D.plant(g, p).groupBy("planted").count().collect()} == want
    every = D.with_planted(g, p).cache()
    got = {r.planted: r.n for r in every.where("planted is not null").groupBy("planted").agg(F.sum("copies").alias("n")).collect()}
    assert got | {"none": D.prepare(every, p).where("sound").count()} == want
    assert every.where("planted in ('copied_question', 'empty', 'refusal')").count() < 200
    # Each response is read under a prompt of another language.
    wrong = every.where("planted = 'other_language'")
    assert wrong.select("text").distinct().count() == 1_000 and {r.prompt_id for r in wrong.select("prompt_id").distinct().collect()} == {"P1", "P2"}
