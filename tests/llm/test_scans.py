from corpuslane.llm import scans as S

SCHEMA = "parsed_id bigint, title string, sections map<string,string>, reference_entries array<string>, line string, n int"
CLEAN = "The training objective combines a sparse encoder with a regularisation term. We release annotation guidelines for speech segmentation. The well-tuned parser improves evaluation accuracy over earlier systems. Figure three illustrates the results."
BODY = (
    "The training objec-\ntive combines a spar5e encoder with a\nregularisahon term. We re-\n12\nJ. Doe et al.\nlease annotation guidelines for\nspeech segmentation. The well-\ntuned parser improves\n13\nJ. Doe et al.\nevaluation accuracy.\n14\nJ. Doe et al.\nF igure three illustrates the results."
)


def run(spark, rows):
    return S.Repair(spark.createDataFrame(rows, SCHEMA))


def test_repair(spark):
    clean = [(i, "Other work", {"method": CLEAN}, [CLEAN], "x", 1) for i in range(100, 130)]
    scan = (1, "A title", {"method": BODY, "results": None, "discussion": ""}, None, "x", 1)
    r = run(spark, clean + [scan, scan, (2, None, None, [None, ""], None, None), (None, "t", {"method": BODY}, None, None, None)])
    got = {(x.parsed_id, x.noise, x.item) for x in r.found().collect()}
    assert got == {
        (1, "hyphenation", "objective"), (1, "hyphenation", "release"), (1, "hyphenation", "well-tuned"), (1, "misread", "sparse"), (1, "misread", "regularisation"), (1, "misread", "figure"),
        (1, "page_number", "12"), (1, "page_number", "13"), (1, "page_number", "14"), (1, "running_header", "J. Doe et al."),
    }
    text = {(x.parsed_id, x.part_name): x.text for x in r.text().collect()}[(1, "method")]
    assert text.startswith("The training objective combines a sparse encoder with a regularisation term. We release annotation guidelines") and "Doe" not in text and "well-tuned parser" in text


def test_numbers_of_the_text_stay(spark):
    rows = [(i, "T", {"results": "It rose to\n2024.\nIn all\n17\nwas the count of runs\nand 9120 the sum"}, ["Doe, J. A title of some length.\n2011."], None, None) for i in (1,)]
    got = {(x.noise, x.item) for x in run(spark, rows).found().collect()}
    assert ("page_number", "2024.") not in got and not any(n == "hyphenation" for n, _ in got)


def test_a_header_goes_with_the_page_number_beside_it(spark):
    text = "It joins a sparse enco-\n11 / 20\n12 Proc. of Some Forum, vol. 9\nder with a long term that fills the line.\nThe runs took longer than 12\n12 / 20\nhours in all of the cases.\n13 / 20\n90 updates were made for each of the seeds."
    got = {(x.noise, x.item) for x in run(spark, [(1, "A title", {"method": text}, None, None, None)]).found().collect()}
    assert {x for x in got if x[0] != "misread"} == {("hyphenation", "encoder"), ("page_number", "11 / 20"), ("page_number", "12 / 20"), ("page_number", "13 / 20"), ("running_header", "12 Proc. of Some Forum, vol. 9")}


def test_empty(spark):
    r = run(spark, [])
    assert r.found().count() == 0 and r.text().count() == 0


def test_printed_forms():
    assert "sparse" in S.printed_forms("spar5e") and "citation" in S.printed_forms("citahon")
    assert "domain" in S.printed_forms("dornain") and "under" in S.printed_forms("uncler") and S.printed_forms("f igure") == ["figure"]


def test_headers_repeat_fuzzily_and_at_any_length(spark):
    """Misread copies of one header count together, a header of 200 letters is one, and a line of text that repeats is none."""
    long = "Proceedings of the Annual Meeting on " + "Computational Methods for Scanned Documents and " * 3 + "Related Other Subjects"
    heads = ["Journal of Speech", "Joumal of Speech", "Journal of Specch", "Journal of Speech"]
    body = "the model reads words of many kinds from the page and keeps them all in order for the reader who comes after and wants more of them again and again for every reader who likes to read the lines that are written here for the test of this"
    texts = []
    for i, h in enumerate(heads):
        texts += [body + f" {i}", str(10 + i), h if i % 2 == 0 or i == 1 or i == 3 else h]
    other = []
    for i in range(4):
        other += [body + f" {i}", str(20 + i), long]
    rows = [(1, "A title of something else", {"method": "\n".join(texts)}), (2, "Another title", {"method": "\n".join(other)})]
    papers = spark.createDataFrame([(i, t, s, []) for i, t, s in rows], "parsed_id long, title string, sections map<string,string>, reference_entries array<string>")
    got = {(r.parsed_id, r.line) for r in S.find_edges(S.split_lines(papers)).where("noise = 'running_header'").collect()}
    assert got == {(1, h) for h in heads} | {(2, long)} and len(long) > 200
