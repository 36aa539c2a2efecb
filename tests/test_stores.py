"""Stores and queues kept by streams: replays, late, stale and timed-out items."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexiflow.streaming import queues, stores
from lexiflow.streaming.stores import Store

EVENT = f"key string, seq long, {stores.EVENT}"


def saved(key, seq, text, **more):
    return (key, seq, "save", None, more.get("label"), 3, 1.5, None, text)


def plain_versions(events):
    """The versions of each key by a loop over its events."""
    kept = {}
    for key, seq, op, i, label, words, score, off, text in sorted(events, key=lambda e: (e[0], e[1])):
        own = kept.setdefault(key, [])
        if op == "save" and (text or "").strip():
            cut = text[: stores.LETTERS]
            kept[key] = [(f"rev-{seq}-{len(text)}", cut), *(x for x in own if x[1] != cut)][:20]
        elif op == "remove":
            kept[key] = [x for x in own if x[0] != i]
        elif op == "clear":
            kept[key] = []
    return kept


def contents(spark, store):
    out = {}
    for r in stores.entries(spark, store).orderBy("key", "place").collect():
        out.setdefault(r.key, []).append((r.id, r.text))
    return out


def some_events():
    r, out = random.Random(7), []
    for seq in range(1, 240):
        key = r.choice("aab")
        if r.random() < 0.8:
            out.append(saved(key, seq, r.choice([f"text {r.randrange(40)}", " ", None, "ü" * 9])))
        else:
            i = f"rev-{r.randrange(1, seq + 1)}-{r.choice([6, 7])}"
            out.append((key, seq, "clear" if key == "b" and r.random() < 0.1 else "remove", i, None, None, None, None, None))
    return out


def test_stream_and_replay(spark, tmp_path):
    """A store after a stream is that of a loop; a batch that runs again changes nothing."""
    events = some_events()
    frame = spark.createDataFrame(events, EVENT)
    for k in range(3):
        frame.where(f"seq > {80 * k} and seq <= {80 * k + 80}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(str(tmp_path / "store"), stores.REVISION, stores.revision_step, buckets=3)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stores.keep_stream(stream, store, str(tmp_path / "check"))
    query.awaitTermination(120)
    want = {k: v for k, v in plain_versions(events).items() if v}
    assert contents(spark, store) == want and max(map(len, want.values())) == 20
    stores.merge(store, frame.where("seq > 160"), 2)  # the last batch once more
    assert contents(spark, store) == want
    assert {r.key: len(r.entries) for r in stores.read(spark, store, 1).collect()} == {k: len(v) for k, v in plain_versions([e for e in events if e[1] <= 80]).items()}
    assert contents(spark, stores.compacted(spark, store, str(tmp_path / "small"))) == want


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path):
    store = Store(str(tmp_path / "s"), stores.REVISION, stores.revision_step, buckets=2)
    assert stores.entries(spark, store).count() == 0
    stores.merge(store, spark.createDataFrame([saved("a", 1, "one")], EVENT), 0)
    half = stores.read(spark, store).withColumn("entries", F.slice("entries", 1, 0))
    half.write.partitionBy("bucket").parquet(f"{store.path}/rows/version=1")  # written, but not committed
    assert contents(spark, store) == {"a": [("rev-1-3", "one")]}
    long = "x" * (stores.LETTERS + 5)
    stores.merge(store, spark.createDataFrame([saved("a", 2, long, label="l" * 70), (None, 3, *saved("a", 3, "z")[2:])], EVENT), 1)
    first = stores.entries(spark, store).orderBy("place").first()
    assert (len(first.text), first.truncated, len(first.label), first.id) == (stores.LETTERS, True, 60, f"rev-2-{len(long)}")
    stores.merge(store, spark.createDataFrame([], EVENT), 2)
    assert stores.entries(spark, store).count() == 2


def test_parts_of_a_work(spark, tmp_path):
    store = Store(str(tmp_path / "s"), stores.PART, stores.part_step(("intro", "end")), buckets=2)
    rows = [
        ("w", 1, "add", "p1", "intro", " T ", None, "one\r\n\r\n\r\n\r\ntwo", None), ("w", 2, "add", "p2", "nowhere", None, "f.txt", "x", None), ("w", 3, "add", "p3", "end", None, None, "  ", None),
        ("w", 4, "move", "p2", "end", None, None, None, None), ("w", 5, "move", "p1", "unknown", None, None, None, None), ("w", 6, "add", "p4", "end", None, None, "y", None), ("w", 7, "remove", "p9", None, None, None, None, None),
        ("v", 1, "add", "p1", "intro", None, None, "z", None), ("v", 2, "remove", "p1", None, None, None, None, None),
    ]
    kind = f"key string, seq long, {stores.PART_EVENT}"
    stores.merge(store, spark.createDataFrame(rows, kind), 0)
    parts = lambda: [(r.key, r.place, r.part_id, r.section_id, r.title, r.text) for r in stores.entries(spark, store).orderBy("key", "place").collect()]
    assert parts() == [("w", 1, "p1", "intro", "T", "one\n\ntwo"), ("w", 2, "p2", "end", "", "x"), ("w", 3, "p4", "end", "", "y")]
    stores.merge(store, spark.createDataFrame([("w", 8, "profile", None, None, None, None, None, ["intro"]), ("w", 9, "add", "p2", "intro", "new", None, "xx", None)], kind), 1)
    assert parts() == [("w", 1, "p1", "intro", "T", "one\n\ntwo"), ("w", 2, "p2", "intro", "new", "xx"), ("w", 3, "p4", "unassigned", "", "y")]


@pytest.fixture
def rocks(spark):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_queue(spark, tmp_path, rocks):
    """One item at a time; a newer version replaces, a stale report changes nothing, what takes too long is given up."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [("k", "put", "a", 1, at(0)), ("k", "put", "b", 1, at(1)), ("k", "put", "b", 2, at(2)), ("m", "put", "z", 1, at(2)), (None, "put", "z", 1, at(2))],
        [("k", "done", "a", 0, at(5)), ("k", "done", "a", 1, at(6)), ("k", "put", "c", 1, at(7)), ("k", "put", "b", 1, at(7))],
        [("m", "done", "z", 1, at(8)), ("k", "put", "d", 1, at(9)), ("x", "put", "late", 1, at(9))],
        [("n", "put", "y", 1, at(40))],  # time goes on: b and what comes after it run out
        [("k", "done", "b", 2, at(41)), ("q", "put", "old", 1, at(3)), ("n", "put", "y2", 1, at(42))],
        [("n", "done", "y", 1, at(43))],
    ]
    kind = "key string, op string, item string, version long, at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = queues.serial_queue(stream, "20 seconds").writeStream.format("memory").queryName("queued").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = [(r.key, r.item, r.version, r.event) for r in spark.table("queued").collect()]
    of = lambda key: [x[1:] for x in got if x[0] == key]
    assert of("k")[:5] == [("a", 1, "started"), ("a", 0, "stale"), ("a", 1, "done"), ("b", 2, "started"), ("b", 1, "stale")]
    assert ("b", 2, "given up") in of("k") and ("c", 1, "started") in of("k") and ("b", 2, "stale") in of("k")
    assert of("m") == [("z", 1, "started"), ("z", 1, "done")] and of("q") == []
    assert of("n") == [("y", 1, "started"), ("y", 1, "done"), ("y2", 1, "started")]
