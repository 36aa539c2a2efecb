"""The cleaning stage, literal references and checks of candidates on small tables."""

from pyspark.sql import functions as F

from lexiflow.operators import candidates, cleaning, references
from tests.test_reference_operators import rows, texts


def test_stage_drops_repeats_and_cuts_long_paragraphs(spark):
    twice = "A first sentence that is long enough to count here. "
    block = "Same paragraph, which is long enough, twice."
    long = " ".join(f"Sentence number {i} has exactly these eight words." for i in range(60))
    got = rows(cleaning.process(texts(spark, f"{twice}{twice}See https://x.org/a.b, please.\n\n{block}\n\n{block}\n\n- item one\n- item one", long, "", None)))
    assert got[0].text == f"{twice}See https://x.org/a.b, please.\n\n{block}\n\n- item one\n- item one" and got[0].duplicates == 2
    assert [len(p.split()) for p in got[1].text.split("\n\n")] == [168, 168, 144] and got[1].paragraphs_created == 2
    assert got[1].text.replace("\n\n", " ") == long
    assert got[2].text == got[3].text == "" and got[2].issues == got[3].issues == []


def test_stage_goes_back_where_numbers_would_go(spark):
    got = rows(cleaning.process(texts(spark, "Only a sentence of some length here. Only a sentence of some length here.")))
    assert got[0].text == "Only a sentence of some length here." and got[0].issues == []
    issues = spark.createDataFrame([("a 12", "a 13"), ("see http://a.b", "see"), ("x", " ")], "s string, r string").select(cleaning.integrity(F.col("s"), F.col("r")).alias("i")).collect()
    assert [r.i for r in issues] == [["numbers"], ["urls"], ["empty"]]


def test_no_break_spaces_and_error_text(spark):
    t = spark.createDataFrame([("5 км и 7 %, № 5, 3 more",)], "t string")
    assert t.select(cleaning.nonbreaking(F.col("t")).alias("t"), cleaning.nonbreaking_count(F.col("t")).alias("n")).first()[:] == ("5 км и 7 %, № 5, 3 more", 3)
    t = spark.createDataFrame([("at https://u:p@a.b/c?key=1#x token=abc, Bearer zz\n",)], "t string")
    assert t.select(cleaning.redact(F.col("t")).alias("t")).first().t == "at https://a.b/c [hidden], [hidden] "


def test_reference_ranges_merge_and_lists_of_sources(spark):
    text = "See (https://a.b/c(d)). Doi 10.1234/xy, [1, 2] (Ivanov, 1999) and Table 2.1b, not Table two.\nReferences\nOne book\nAppendix A\nfree"
    got = references.reference_ranges(texts(spark, text, "", None)).collect()
    assert all(text[r.start : r.end] == r.value for r in got)
    assert [r.value for r in got] == ["https://a.b/c(d)", "10.1234/xy", "[1, 2]", "(Ivanov, 1999)", "Table 2.1b", "One book", "Appendix A"]
    assert [r.value for r in got if r.bibliography] == ["One book"]
    lines = references.bibliography_blocks(references.paragraph_rows(texts(spark, text))).orderBy("pos").collect()
    assert [r.in_bibliography for r in lines] == [False, True, True, False, False]


def test_references_kept_in_order(spark):
    pairs = spark.createDataFrame([(1, "[1] a [2]", "[1] b [2]"), (2, "[1] a [2]", "[2] a [1]"), (3, "", None)], "doc_id long, source string, candidate string")
    assert {r.doc_id: r.kept for r in references.references_kept(pairs).collect()} == {1: True, 2: False, 3: True}


def test_candidate_checks(spark):
    made = [
        (1, "Anna may see the plan.", "Anna may see that plan.", None),
        (2, "Anna may see the plan.", "She sees the the plan", ["plan"]),
        (3, "The «term» is (not) all.", "The term is all).", ["term"]),
        (4, None, None, None),
    ]
    got = {r.id: r for r in candidates.check(spark.createDataFrame(made, "id long, source string, candidate string, terms array<string>"), terms="terms").collect()}
    assert got[1].ok and got[1].reasons == []
    assert got[2].reasons == ["unfinished", "certainty", "lost_name", "new_name"]
    assert got[3].reasons == ["quotes", "certainty", "brackets"]
    assert got[4].reasons == ["unfinished"]


def test_candidate_profile(spark):
    made = [(1, "The planned market studies showed growth today", "Today growth showed the planned market studies."), (2, "The market grows.", "The market grows."), (3, None, "x")]
    got = {r.id: r for r in candidates.profile(spark.createDataFrame(made, "id long, source string, candidate string")).collect()}
    assert got[1].stable_vocabulary and got[1].length_ratio == 1 and got[1].n_sentences == 1 and got[1].safe == (0.24 <= got[1].novelty <= 0.74)
    assert got[2].novelty == 0 and not got[2].safe and not got[3].safe
    sized = spark.createDataFrame([("a b c d", "a"), ("a b", "a b c"), ("a", "a"), ("", "a")], "s string, c string")
    assert [r.v for r in sized.select(candidates.volume(F.col("s"), F.col("c")).alias("v")).collect()] == ["shrunk", "grown", None, None]


def test_urls_beside_private_use_letters():
    """Letters of the text stay where they are, whatever stands for a URL meanwhile."""
    from lexiflow.operators.cleaning import MARKS, cleaned

    assert cleaned("a \ue000 b http://x.y/z c  d")[0] == "a \ue000 b http://x.y/z c d"
    assert cleaned("\ue000\ue001 http://a.b/1 ,  http://a.b/2 .")[0] == "\ue000\ue001 http://a.b/1, http://a.b/2."
    full = "".join(MARKS) + " http://a.b  x"
    assert cleaned(full)[0] == full
