import json

from pyspark.sql import functions as F

from corpuslane.operators import documents as D
from corpuslane.operators import sessions as E
from corpuslane.sources import files
from corpuslane.streaming import rollup


def test_jsonl_modes(spark, tmp_path):
    good = [{"id": f"20{i:02d}.0000{i}", "title": " A  b ", "abstract": "x", "authors": "Jane Doe and John Smith", "categories": "cs.LG cs.CL", "update_date": "2020-01-01"} for i in range(4)]
    good[0] |= {"authors_parsed": [["Doe", "Jane", ""], ["Smith", "John", "Jr"]], "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}], "journal-ref": "J. X"}
    p = tmp_path / "raw.jsonl"
    p.write_text("\n".join(map(json.dumps, good[:2])) + "\n\n{broken\n" + "\n".join(map(json.dumps, good[2:])) + "\n")
    marked = files.read_jsonl(spark, str(p), files.RAW_RECORD, "mark").cache()
    assert files.scan_report(marked).first().asDict() == {"scanned": 5, "kept": 4, "invalid": 1}
    assert files.read_jsonl(spark, str(p), files.RAW_RECORD, "skip").where("id is not null").count() == 4
    papers = {r.paper_id: r for r in files.paper_from_raw(marked.where("_corrupt is null")).collect()}
    first, second = papers["2000.00000"], papers["2001.00001"]
    assert first.authors == ["Jane Doe", "John Smith Jr"] and first.published_date == "2007-04-02" and first.venue == "J. X" and first.title == "A b"
    assert second.authors == ["Jane Doe", "John Smith"] and second.published_date == "2020-01-01" and second.venue is None
    arr = tmp_path / "arr.json"
    arr.write_text(json.dumps(good))
    assert files.read_json_any(spark, str(arr), files.RAW_RECORD).count() == 4
    files.write_csv(marked.select(F.coalesce("id", F.lit("-")).alias("id"), "title"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 5
    folder = files.read_folder(spark, str(tmp_path), files.RAW_RECORD)
    assert folder.where("origin = 'raw'").count() >= 4


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a, b = files.fingerprint(df, "id").first(), files.fingerprint(df.repartition(7).select("x", "id"), "id").first()
    assert a == b and files.fingerprint(df.where("id < 99"), "id").first() != a


def events(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0, cast(id % 97 as int), 0)").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 5 == 0, "purchase").otherwise("view").alias("event_type"), (F.col("id") % 10).cast("double").alias("value"), F.lit('{"k": 1}').alias("props"),
    )


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.unionByName(e).repartition(6).write.parquet(str(tmp_path / "in"))
    stream = rollup.windowed(rollup.read_events(spark, str(tmp_path / "in")), "1 hour", "10 days")
    got = {(str(r.start), r.event_type): (r.events, r.total) for r in rollup.run_available(stream, ["start", "event_type"], str(tmp_path)).collect()}
    want = {(str(r.start), r.event_type): (r.events, r.events * r["mean"]) for r in E.windows(e, "1 hour").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def test_manifest_edges(spark):
    e = events(spark, 30)
    m = {r.user_id: r for r in E.manifest(e).collect()}
    assert sum(r.events for r in m.values()) == 30 and m[0].state == "complete"
    assert E.manifest(e.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None), (None, None, 1, "view", 1.0, "{bad")], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    assert E.manifest(E.distinct_events(odd)).count() == 0 and E.props_totals(odd).count() == 0


def test_documents(spark):
    g = spark.createDataFrame([(1, "p", "see [S1, S9] and 2101.00001"), (2, "p", None), (3, "p", "none")], "generation_id bigint, prompt_id string, text string")
    got = {r.generation_id: r for r in D.check_citations(g, ["S1", "2101.00001"]).collect()}
    assert (got[1].used, got[1].unsupported, got[1].passed) == (3, 1, False) and not got[3].passed and 2 not in got
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Alpha beta delta. Zeta eta theta. Alpha beta epsilon."), (2, ""), (3, None), (4, "One.")], "doc_id bigint, text string")
    s = D.extractive_summary(docs, 2).collect()
    assert [r.place for r in s if r.doc_id == 1] == sorted(r.place for r in s if r.doc_id == 1) and "Zeta" not in " ".join(r.sentence for r in s if r.doc_id == 1)
    assert {r.doc_id for r in s} == {1, 4}


def test_summary_reads_all_sections_with_tfidf(spark):
    rows = [(1, {"zz": "Last words of it", "method": "We build a parser. We test a parser.", "abstract": "We show a parser"}), (2, {"method": "A sole sentence."}), (3, None)]
    texts = D.section_texts(spark.createDataFrame(rows, "parsed_id bigint, sections map<string,string>"))
    got = [(r.doc_id, r.place, r.sentence) for r in D.extractive_summary(texts, 5).orderBy("doc_id", "place").collect()]
    assert got == [(1, 0, "We show a parser"), (1, 1, "We build a parser."), (1, 2, "We test a parser."), (1, 3, "Last words of it"), (2, 0, "A sole sentence.")]
    # Common words bind many sentences weakly by TF-IDF; rare ones bind two strongly.
    docs = spark.createDataFrame([(1, "corpus alpha. corpus beta. corpus gamma. corpus delta. rare unit zeta corpus. rare unit eta corpus.".replace(". ", ". C"))], "doc_id bigint, text string")
    assert {r.place for r in D.extractive_summary(docs, 2).collect()} == {4, 5}
