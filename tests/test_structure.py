import pytest
from pyspark.sql import functions as F

from corpuslane.functions import rules as R
from corpuslane.operators import structure as S

PAPER = """A Title
Abstract
We study speech.
It   works. Figure 1 shows it.
1 Introduction
Words come first.
2 Our Approach
ignored heading
2.1 Algorithm 1 steps
inside a caption line
3 Experiments
Scores rise.
4 Future Work
None.
5 Experimental details
More scores."""
NUMBERED = "[1] Doe, J. A paper on speech. Journal, 2020.\n[2] Roe, R. and Poe, E. Another paper on text,\nwrapped here. 2019.\n[2] Roe, R. and Poe, E. Another paper on text,\nwrapped here. 2019."
BY_AUTHOR = "Doe, J. A paper on speech with a long\ntitle. Journal of Speech, 2020.\n17\nRoe, R. and Poe, E. Another paper on text.\nIn Proceedings of Texts, 2019a."


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_sections_and_abstract(spark):
    df = spark.createDataFrame([(1, PAPER, "x"), (2, None, "x"), (3, "", "x"), (4, "no headings", "x")], "id long, text string, section string")
    got = {(r.id, r.section): r.body for r in S.split_sections(df.select("id", "text"), "id").collect()}
    assert got == {(1, "introduction"): "Words come first.", (1, "results"): "Scores rise.\n\nMore scores.", (1, "conclusion"): "None."}
    assert one(spark, S.abstract_of, PAPER) == "We study speech. It works." and one(spark, S.abstract_of, "nothing") == "" and one(spark, S.abstract_of, None) is None
    assert [r.section for r in S.heading_lines(df.where("id = 1").select("id", "text"), "id").where("opens").collect()] == ["introduction", None, "results", "conclusion", "results"]


def test_reference_lists(spark):
    assert one(spark, S.split_references, NUMBERED) == ["Doe, J. A paper on speech. Journal, 2020", "Roe, R. and Poe, E. Another paper on text, wrapped here. 2019"]
    assert one(spark, S.split_references, BY_AUTHOR) == ["Doe, J. A paper on speech with a long title. Journal of Speech, 2020", "Roe, R. and Poe, E. Another paper on text. In Proceedings of Texts, 2019a"]
    assert one(spark, S.split_references, None) == [] and one(spark, S.split_references, "") == []


@pytest.mark.parametrize("entry,score", [("Doe, J. A paper on speech and many other things. 2020", 5.0), ("short 2020", -4.0), ("x" * 800, -6.0), ("", -6.0)])
def test_entry_score(spark, entry, score):
    assert one(spark, S.entry_score, entry) == score


def test_rules(spark):
    ask = {"Could you recommend me some research papers on  graph learning?!": "graph learning", "Which papers should I read about RAG.": "RAG", "What is RAG?": None, None: None, "": None}
    assert {k: one(spark, R.recommendation_topic, k) for k in ask} == ask
    talk = {"Hello!": True, "thanks a lot": True, "Hey, what can you do?": True, "I'm new to this tool. how can you help me?": True, "Hello, find papers": False, "": False}
    assert {k: one(spark, R.is_chit_chat, k) for k in talk} == talk
    calls = {'{"tool": "search_offline", "arguments": {"query": " x ", "top_k": 99}}': ("x", 20), '```json\n{"tool": "search_offline", "arguments": {"query": "y", "top_k": "no"}}\n```': ("y", 5), '{"tool": "search_offline", "arguments": {"query": " "}}': None, '{"tool": "other"}': None, "none": None, None: None}
    assert {k: (lambda r: tuple(r) if r else None)(one(spark, R.tool_call, k)) for k in calls} == calls
    assert one(spark, lambda c: R.aps_authors(F.split(c, ";")), "Doe, Jane Ann;Max Roe") == "J. A. Doe and M. Roe" and one(spark, lambda c: R.aps_authors(F.split(c, ";")), "Ada;B C;D E") == "Ada et al."
    assert one(spark, lambda c: R.aps_authors(F.split(c, ";")), None) == "Unknown author" and one(spark, lambda c: R.aps_author(c), "A Team and Friends") == "A Team and Friends"
    assert one(spark, lambda c: R.capped(c, 4, True), "abcdefgh") == "ab" + R.NOTICE + "gh" and one(spark, lambda c: R.capped(c, 8), "abcdefgh") == "abcdefgh"
    places = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.5, 2), (0.5, 3)], "s double, p int").select(R.relation_by_place(F.col("s"), F.col("p")).alias("r"))
    assert [r.r for r in places.collect()] == ["method_related", "similar", "foundational", "recent"]


def test_messages(spark):
    rows = [(1, [("system", "s"), ("user", "u"), ("assistant", "a")]), (2, [("user", "u"), ("system", "s"), ("assistant", " ")]), (3, [("user", "u")]), (4, []), (5, None)]
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id int, m array<struct<role:string,content:string>>").select("id", R.message_problems(F.col("m")).alias("p")).collect()}
    assert got[1] == [] and got[2] == ["empty assistant", "order of roles"] and "fewer than two messages" in got[3] and "no assistant" in got[3] and "no user" in got[4] and "fewer than two messages" in got[5]
