"""Markdown sections, parsed answers, training rows and section weights on small cases worked out by hand."""

from pyspark.sql import functions as F

from corpuslane.operators import markdown as M
from corpuslane.operators import retrieval as T
from corpuslane.operators import training as N

TEXT = "intro\r\n# Top:\n- one\n## Sub\n* two  words\n-\n**Bold**\n\nplain\n# Next #\n"


def test_sections_run_to_the_next_heading_of_their_level(spark):
    rows = spark.createDataFrame([(1, TEXT, 9), (2, None, 9), (3, "", 9), (4, "no heading", 9)], "k int, text string, _lines int")
    got = {r.line_no: r for r in M.sections(rows, "k").collect()}
    assert [(n, got[n].level, got[n].title, len(got[n].body)) for n in sorted(got)] == [(2, 1, "top", 7), (4, 2, "sub", 2), (7, 2, "bold", 2), (10, 1, "next", 1)]
    shown = {r.line_no: r.x for r in M.sections(rows, "k").select("line_no", M.items(F.col("body"), "All").alias("x")).collect()}
    assert shown == {2: ["one", "two words", "Bold**"], 4: ["two words"], 7: ["All: plain"], 10: []}
    assert M.sections(rows.where("k > 9"), "k").count() == 0


def test_items_are_limited(spark):
    text = "# Findings\n" + "\n".join("- " + "x" * 2000 for _ in range(20))
    found = M.parse_answers(spark.createDataFrame([(1, text, None)], "k int, text string, error string"), "k").first()
    assert found.origin == "markdown" and [len(i) for i in found.key_findings] == [1000] * 8


def test_answers_from_json_markdown_or_neither(spark):
    rows = [
        (1, 'Sure: {"summary": " s ", "key_findings": ["a", "b"], "research_gaps": ["{x"]} end', None),
        (2, "**Strengths**\n- good\n**Weaknesses**\nnone seen", None),
        (3, "just prose", None), (4, " \n", None), (5, None, None), (6, "# Findings\n- a", "timeout"), (7, '{"other": 1}', None), (1, 'Sure: {"summary": " s ", "key_findings": ["a", "b"], "research_gaps": ["{x"]} end', None),
    ]
    got = {r.k: tuple(r)[1:] for r in M.parse_answers(spark.createDataFrame(rows, "k int, text string, error string"), "k").collect()}
    assert got[1] == ("json", "s", ["a", "b"], ["{x"])
    assert got[2] == ("markdown", "good", ["good"], ["Gaps: none seen"])
    assert got[3] == got[4] == got[5] == ("failed", M.FAILED, [], [])
    assert got[6] == ("failed", "Synthesis failed: timeout", [], [])
    assert got[7] == ("json", M.FAILED, [], [])
    assert len(got) == 7


def test_instruction_rows_cite_only_their_pack(spark):
    packs = spark.createDataFrame([(1, "S1", "text"), (2, "S1", "see 1905.12345 there"), (3, "S1", None)], "query_id long, source_id string, snippet string")
    queries = spark.createDataFrame([(1, "q"), (2, "q"), (3, " "), (4, "q")], "query_id long, text string")
    got = {(r.key, r.task) for r in N.instruction_rows(packs, queries).collect()}
    assert got == {("1", t) for t in N.PACK_TASKS} | {("2", t) for t, (_, _, quoted) in N.PACK_TASKS.items() if not quoted}


def test_paper_rows_and_deficits(spark):
    full = {"introduction": "i", "abstract": "a", "method": "m", "results": "r", "conclusion": " "}
    parsed = spark.createDataFrame([(1, full), (2, full), (3, None), (4, {})], "parsed_id long, sections map<string,string>")
    rows = N.paper_rows(parsed, 1)
    assert sorted((r.task, r.key) for r in rows.collect()) == [("paper_findings", "1"), ("paper_summary", "1")]
    wanted = dict.fromkeys(N.PAPER_TASKS, 1)
    assert {r.task: (r.rows, r.deficit) for r in N.deficits(rows, wanted).collect()} == {"paper_findings": (1, 0), "paper_summary": (1, 0), "paper_outlook": (0, 1)}
    assert [r.deficit for r in N.deficits(rows.where("false"), wanted).collect()] == [1, 1, 1]
    assert {r.checksum for r in N.manifest(rows.orderBy("task")).collect()} == {r.checksum for r in N.manifest(rows.orderBy(F.desc("task"))).collect()}


def test_role_weights_equal_the_weighted_sum_of_dots(spark):
    rows = [(1, "whole", [1.0, 2.0]), (1, "method", [3.0, 0.0]), (1, "method", [3.0, 0.0]), (2, "method", [0.0, 4.0]), (3, "other", [9.0, 9.0]), (None, "whole", [1.0, 1.0]), (4, "whole", None)]
    v = spark.createDataFrame(rows, "doc_id long, role string, vec array<float>")
    got = {r.doc_id: [round(x, 6) for x in r.vec] for r in T.role_weighted(v, {"whole": 0.6, "method": 0.4}).collect()}
    assert got == {1: [1.8, 1.2], 2: [0.0, 1.6]}
    q = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, qvec array<float>")
    assert [(r.doc_id, r.score) for r in T.nearest(T.role_weighted(v, {"whole": 0.6, "method": 0.4}), q, 1).collect()] == [(1, 3.0)]
