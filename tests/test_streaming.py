"""Streams against the same work on whole tables."""

from statistics import median

from lexiflow import streaming
from lexiflow.operators import scores


def drained(frame, name, **options):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").options(**options).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_scores_of_a_stream_are_those_of_a_table(spark, tmp_path):
    rows = [(k, f"Moreover, number {k} grew. It is important to note this. " * (k % 4)) for k in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    assert sorted(drained(streaming.score_stream(stream), "scored")) == sorted(scores.scores(docs).collect())


def test_history_is_bounded_and_carried_between_batches(spark, tmp_path):
    values = {"a": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0], "b": [1.0, 2.0]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("a", 99, None)]
    frame = spark.createDataFrame(rows, "key string, id long, value double")
    for lo, hi in ((0, 4), (4, 8), (8, 100)):
        frame.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = {(r.key, r.id): (r.median, r.share) for r in drained(streaming.against_history(stream, kept=6, least=3), "held")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held["spark.sql.shuffle.partitions"])
    assert len(got) == 12
    for key, vs in values.items():
        for i, v in enumerate(vs):
            seen = vs[: i + 1][-6:]
            want = (None, None) if len(seen) < 3 else (median(seen), (sum(x < v for x in seen) + seen.count(v) / 2) / len(seen))
            assert got[key, i] == want
