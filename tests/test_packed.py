import pytest
from pyspark.sql import functions as F

from corpuslane.operators import packed

SCHEMA = "flat_id bigint, authors string, categories string, layout string, pos int"

CASES = {
    "Jane Doe, John Smith, III, Ada Lovelace": ["Jane Doe", "John Smith, III", "Ada Lovelace"],
    "Doe, Jane": ["Doe, Jane"],
    "Doe, J., & Smith, A. B.": ["Doe, J.", "Smith, A. B."],
    "Doe, J. H., Smith, X., Lovelace, A. K.": ["Doe, J. H.", "Smith, X.", "Lovelace, A. K."],
    "Doe, Jane and Smith, John P.": ["Doe, Jane", "Smith, John P."],
    "Jane Doe and John van Smith": ["Jane Doe", "John van Smith"],
    ";Jane Doe;; John Smith; ;": ["Jane Doe", "John Smith"],
    "Jane Doe|  John Smith |Ada Lovelace": ["Jane Doe", "John Smith", "Ada Lovelace"],
    "Jane Doe\r\nJohn Smith": ["Jane Doe", "John Smith"],
    "Jane Doe / John Smith": ["Jane Doe", "John Smith"],
    "['Jane Doe', \"Pat O'Hara\"]": ["Jane Doe", "Pat O'Hara"],
    '["In\\u00e9s Doe", "John Smith"]': ["Inés Doe", "John Smith"],
    '"Doe, Jane","Thomas ""Tom"" Smith"': ["Doe, Jane", 'Thomas "Tom" Smith'],
    'Jane Doe; "Reyl, Doe & Partners Lab"': ["Jane Doe", "Reyl, Doe & Partners Lab"],
}
CODES = {
    "cs.LG cs.CL": ["cs.LG", "cs.CL"], ",cs.LG, stat.ML,": ["cs.LG", "stat.ML"], "cs.LG; q-bio.QM; 68T50": ["cs.LG", "q-bio.QM", "68T50"],
    "Reasoning, Planning (cs.AI); Sound (cs.SD)": ["Reasoning, Planning (cs.AI)", "Sound (cs.SD)"], '"Audio; Voice (eess.AS)"; "Sound (cs.SD)"': ["Audio; Voice (eess.AS)", "Sound (cs.SD)"],
    "cs.LG q-bio.QM|cs.CV|cs.NE": ["cs.LG", "q-bio.QM", "cs.CV", "cs.NE"],
}


def split(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in packed.split_packed(df).collect():
        out.setdefault((r.flat_id, r.field_name), {})[r.pos] = r.item
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}, out


def test_manners(spark):
    rows = [(i, a, None, "x", 7) for i, a in enumerate(CASES)] + [(100 + i, None, c, "x", 7) for i, c in enumerate(CODES)]
    got, places = split(spark, rows + rows)
    for i, (a, want) in enumerate(CASES.items()):
        assert got[(i, "authors")] == want, a
    for i, (c, want) in enumerate(CODES.items()):
        assert got[(100 + i, "categories")] == want, c
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())


@pytest.mark.parametrize("value", [None, "", "  ", "[]", " ; ,; ", "[ ]"])
def test_nothing_inside(spark, value):
    assert split(spark, [(1, value, value, None, None)])[0] == {}


def test_empty_table_null_key_and_long_field(spark):
    assert split(spark, [])[0] == {}
    many = "; ".join(f"Jane Doe{chr(97 + i % 26)}" for i in range(3000))
    got, _ = split(spark, [(1, many, 'a "lone quote', None, None), (None, "Jane Doe; John Smith", None, None, None)])
    assert len(got[(1, "authors")]) == 3000 and got[(None, "authors")] == ["Jane Doe", "John Smith"]
    assert got[(1, "categories")]


def test_steadier_way_wins_between_equally_regular_ones(spark):
    rows = [("authors", "L", w, 10, r, s) for w, r, s in (("strong", 0.9, 0.4), ("comma_pairs", 0.9, 1.0), ("whole", 0.1, 1.0))]
    scores = spark.createDataFrame(rows, "kind string, layout string, way string, rows long, regularity double, steadiness double")
    weighed = scores.withColumn("score", F.col("regularity") * (1 - packed.STEADY_WEIGHT + packed.STEADY_WEIGHT * F.col("steadiness")))
    assert [r.way for r in packed.best_ways(weighed).collect()] == ["comma_pairs"]


def test_steadiness_is_measured_by_layout(spark):
    """Of two ways with like pieces, the one whose piece counts hardly vary scores higher."""
    way = lambda name, n: (name, ["Jane Doe"] * n)
    rows = [("authors", None, "L", [way("even", 2), way("odd", 1 if i % 2 else 9)]) for i in range(20)]
    prepared = spark.createDataFrame(rows, "kind string, items array<string>, layout string, ways array<struct<way:string,pieces:array<string>>>")
    got = {r.way: r for r in packed.layout_scores(prepared).collect()}
    assert got["even"].regularity == got["odd"].regularity == 1.0 and got["even"].steadiness == 1.0 and got["odd"].score < got["even"].score
