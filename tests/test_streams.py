"""Streams against their batch twins: micro-batches of any cut, documents that stall, tags that are cut."""

import datetime as dt
import json

import pytest

from foliospark.streaming import guard, timed

START = dt.datetime(2024, 1, 1)
SCHEMA = "doc_id long, chunk_no long, ts timestamp, text string, last boolean"


def at(second):
    return START + dt.timedelta(seconds=second)


def streamed(spark, tmp_path, batches, name, build):
    """Rows of build(stream), each list of `batches` being a micro-batch; and the numbers of state rows after each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if json.loads(p.json)["stateOperators"]]
    return spark.table(name).collect(), kept


@pytest.fixture
def few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_guard_with_timers(spark, tmp_path, few_parts):
    batches = [
        [(1, 0, at(0), "begins and stalls ", None), (2, 0, at(0), "ends in time ", None), (3, 0, at(1), "see minvoice.com", None), (5, 0, at(2), "late ", None)],
        [(2, 1, at(20), "here", True), (3, 1, at(21), "again minvoice.com", None), (4, 0, at(30), "begins later ", None), (5, 1, at(31), "chunk ", None)],
        [(4, 1, at(58), "goes on ", None), (5, 2, at(59), "beyond its time", None), (3, 2, at(60), "never shown", None), (2, 2, at(60), "nor this", None)],
        [(6, 0, at(75), "moves time on", True)],
        [(7, 0, at(76), "last", True)],
    ]
    rows, _ = streamed(spark, tmp_path, batches, "guarded_timed", lambda s: timed.guard_stream(s, limit_s=50))
    text, ends = {}, {}
    for r in rows:
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
        ends[r.doc_id] = (ends.get(r.doc_id, (False, False))[0] or r.stopped, ends.get(r.doc_id, (False, False))[1] or r.timed_out)
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = guard.guard_batch(whole, limit_s=50, until=at(76).timestamp()).collect()
    assert text == {r.doc_id: r.text for r in want}
    assert ends == {r.doc_id: (r.stopped, r.timed_out) for r in want}
    assert ends[1] == (False, True) and text[1].count("OCR_TIMEOUT") == 1  # no chunk of it came after the first
    assert ends[2] == ends[4] == (False, False) and ends[3] == (True, False) and ends[5] == (False, True)


def test_state_is_freed(spark, tmp_path, few_parts):
    batches = [[(k, 0, at(k), f"text {k}", k % 2 == 0) for k in range(20)], [(100, 0, at(500), "x", True)], [(101, 0, at(5000), "y", True)], [(102, 0, at(90000), "z", True)]]
    rows, kept = streamed(spark, tmp_path, batches, "guarded_freed", lambda s: timed.guard_stream(s, limit_s=50, keep_s=1000))
    assert max(kept) >= 20 and kept[-1] <= 2  # the documents of the last chunks, whose marks are still kept
    assert sum(r.timed_out for r in rows) == 10


TEXT = "a <b <|ref|>title<|/ref|><|det|>[[1, 2, 3, 4], [5, 6, 7, 8]]<|/det|>\n\n x<|ref|>t<|/ref|><|det|>[9, 9, 9, 9]<|/det|> y <|ref|>open"


@pytest.mark.parametrize("mode", ["markdown", "ocr", None])
def test_tags_cut_across_batches(spark, tmp_path, few_parts, mode):
    size = 17  # tags, names and boxes are cut
    parts = [TEXT[k : k + size] for k in range(0, len(TEXT), size)]
    # Document 1 comes a chunk a micro-batch, 2 in two halves, 3 all at once and without an end.
    batches = [[(1, k, at(k), part, k == len(parts) - 1)] for k, part in enumerate(parts)]
    batches[0] += [(2, k, at(0), part, None) for k, part in enumerate(parts[:3])] + [(3, k, at(0), part, None) for k, part in enumerate(parts)]
    batches[1] += [(2, k, at(1), part, k == len(parts) - 1) for k, part in enumerate(parts) if k >= 3] + [(4, 0, at(1), None, None), (4, 1, at(1), "<|re", None)]
    batches += [[(9, 0, at(1000), "<", True)], [(9, 1, at(1001), "passed over", None)]]
    rows, _ = streamed(spark, tmp_path, batches, f"tagged_{mode}", lambda s: timed.tag_stream(s, mode))
    shown, boxes = {}, {}
    for r in rows:
        shown[r.doc_id] = shown.get(r.doc_id, "") + r.shown
        boxes[r.doc_id] = boxes.get(r.doc_id, 0) + r.boxes
    whole = spark.createDataFrame([r for b in batches for r in b if r[:2] != (9, 1)], SCHEMA)
    want = guard.read_tags(whole, mode).collect()
    assert shown == {r.doc_id: r.shown for r in want} and boxes == {r.doc_id: r.boxes for r in want}
    assert shown[1] == shown[2] == shown[3] and boxes[1] == (3 if mode else 0)
