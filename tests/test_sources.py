"""Files and sinks."""

from pyspark.sql import functions as F

from foliospark.sources import readers

RULE = "=" * 80


def test_samples_are_cut_while_they_are_read(spark, tmp_path):
    text = "what stands above\n" + "".join(f'{RULE}\n=== SAMPLE {k} - case {k}  ===\n{RULE}\n"text {k} é\n=== SAMPLE no banner\n{"=" * 5}",\n' for k in range(5000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text(f"{RULE}\n=== SAMPLE x - broken\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (4096, 4099, 5003, 7919, 16384):  # splits end anywhere in rules and banners
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        assert readers.samples(spark, str(tmp_path)).where("sample_no IS NOT NULL").select("sample_no").distinct().count() == 5000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = readers.samples(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        rows = read.collect()
        tasks = read.where("sample_no IS NOT NULL").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 8
    good = sorted((r.sample_no, r.name, r.text) for r in rows if r.error is None)
    want = readers.split_samples(spark.createDataFrame([(text,)], "value string")).collect()
    assert good == sorted((r.sample_no, r.name, r.text) for r in want) and len(good) == 5000
    assert sorted(r.text for r in rows if r.error) == ["what stands above", "x - broken"] and all(r.sample_no is None for r in rows if r.error)


def test_files_of_other_kinds_are_error_rows(spark, tmp_path):
    for name in ("a.PDF", "b.docx", "c.jpeg", "d.exe", "sub/e.png", "f"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.error, r.length) for r in readers.files(spark, str(tmp_path)).collect()}
    bad = ("unsupported", "Unsupported file format", 2)
    assert got == {"a.PDF": ("pdf", None, 2), "b.docx": ("word", None, 2), "c.jpeg": ("image", None, 2), "d.exe": bad, "e.png": ("image", None, 2), "f": bad}


def test_corpus_without_columns(spark):
    assert readers.drawn(spark.createDataFrame([(1,)], "x int")).count() == 0
    assert readers.drawn(spark.createDataFrame([], "DRAW_PLAIN string")).count() == 0


def test_flat_rows_and_payloads(spark):
    from foliospark.functions import text

    rows = spark.createDataFrame([(1, [("a", 2)])], "id int, items array<struct<n:string,q:int>>")
    assert readers.flat_rows(rows).first()["items"] == '[{"n":"a","q":2}]'
    df = spark.createDataFrame([("data:x;base64,aGk=",), ("aGk=",), (None,)], "t string")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(text.base64_payload(F.col("t"))).collect()] == [b"hi", b"hi", None]
