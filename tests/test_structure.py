"""Numbers, counts and export of blocks on small tables."""

from lexiflow.operators import cleaning, documents, structure


def test_captions_keep_their_numbers(spark):
    rows = [(1, 0, "table", "2"), (1, 1, "table", None), (1, 2, "table", ""), (1, 3, "figure", None), (1, 4, "table", "2.1"), (2, 0, "table", None), (1, 5, "table", None)]
    got = structure.number_captions(spark.createDataFrame(rows, "doc_id long, pos int, kind string, number string"))
    assert {(r.doc_id, r.pos): r.number for r in got.collect()} == {(1, 0): "2", (1, 1): "1", (1, 2): "3", (1, 3): "1", (1, 4): "2.1", (2, 0): "1", (1, 5): "4"}
    plain = documents.numbered_captions([documents.Block("caption", "table", number=n or "") for *_, k, n in rows[:3]])[0]
    assert [b.number for b in plain] == ["2", "1", "3"] and structure.number_captions(got.limit(0)).count() == 0


def test_missing_counts_and_text_files(spark, tmp_path):
    need = spark.createDataFrame([("a",), ("b",)], "part string")
    assert [r.part for r in structure.missing(need, need.where("part = 'a'"), ["part"]).collect()] == ["b"]
    blocks = spark.createDataFrame([(1, "list"), (1, None), (None, "list")], "doc_id long, type string")
    assert {r.doc_id: r.n_list for r in structure.block_counts(blocks, ["list"]).collect()} == {1: 1, None: 1}
    structure.write_text(spark.createDataFrame([("one",), (None,)], "text string").coalesce(1), str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("part-*")
    assert file.read_text(encoding="utf-8") == "\ufeffone\n\ufeff\n"


def test_errors_are_fit_to_show(spark):
    rows = [("at https://u:p@a.b/c?k=1 token=abc\x00", "at https://a.b/c [hidden]"), (None, None), ("x" * 2000, "x" * 1200)]
    frame = spark.createDataFrame(rows, "m string, want string").withColumn("got", cleaning.redact(cleaning.F.col("m")))
    assert all((r.got or "").strip() == (r.want or "") for r in frame.collect())
