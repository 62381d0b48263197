"""Functions in SQL, and their twins as column expressions."""

import random

from pyspark.sql import functions as F

from foliospark.functions import numbers, plain, sql, words

SAID = ["one", "two", "thirteen", "forty", "ninety", "hundred", "thousand", "million", "and", "cents", "dollars", "only", "x", "us dollars", "zero"]
VN = ["một", "hai", "năm", "lăm", "mười", "mươi", "trăm", "nghìn", "triệu", "tỷ", "linh", "đồng", "chẵn", "và", "tư"]


def test_words_are_the_same(spark):
    rng = random.Random(4)
    rows = [(None, None, None), ("", "", 0.0), ("USD five", " ** hai.", -1.0), ("twenty-one, and five cents", "Hai mươi lăm", 1e12), ("x", "tỷ", 1e15)]
    rows += [(" ".join(rng.choice(SAID) for _ in range(rng.randint(1, 9))), " ".join(rng.choice(VN) for _ in range(rng.randint(1, 9))), float(rng.choice([rng.randrange(10**k) for k in range(1, 15)])) + rng.choice([0, 0.25, 0.5, 0.01, 0.99])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "en string, vn string, n double")
    got = df.select("*", words.en_words_to_number(F.col("en")).alias("a"), words.vn_words_to_number(F.col("vn")).alias("b"), words.number_to_en_words(F.col("n")).alias("c"), words.number_to_vn_words(F.col("n")).alias("d")).collect()
    for r in got:
        assert r.a == plain.en_words_to_number(r.en), r.en
        assert r.b == plain.vn_words_to_number(r.vn), r.vn
        assert (r.c or "") == plain.number_to_en_words(r.n), r.n
        assert (r.d or "") == plain.number_to_vn_words(r.n), r.n


def test_functions(spark):
    sql.register(spark)
    texts = ["1.234,50", "USD 1,234.5", "", None, "2 x 3", "x", "$1.500", "Ngày 02 tháng 03 năm 2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("said")
    got = spark.sql("SELECT t, parse_number(t) AS n, parse_quantity(t) AS q, parse_price(t) AS p, document_date(t, true) AS d FROM said").collect()
    want = {r.t: (r.n, r.q, r.p) for r in df.select("t", numbers.parse_number(F.col("t")).alias("n"), numbers.parse_quantity(F.col("t")).alias("q"), numbers.parse_price(F.col("t")).alias("p")).collect()}
    assert {r.t: (r.n, r.q, r.p) for r in got} == want and next(r.d for r in got if r.t == texts[-1]) == "02/03/2024"


def test_items_as_a_table(spark):
    sql.register(spark)
    texts = [(1, "| Description | Quantity | Unit Price | Amount |\n| Pen | 1 | 2 | 2 |\n| Ink | 1 | 3 | 3 |"), (2, None), (3, "1 rod 2 3 6"), (4, "<table><tr><td>h<tr><td>1<td>P<td>kg<td>2<td>3<td>6"), (5, "")]
    spark.createDataFrame(texts, "id long, t string").createOrReplaceTempView("docs")
    got = spark.sql("SELECT id, i.place, i.productName, i.quantity, i.amount FROM docs, LATERAL invoice_items(t) i ORDER BY id, place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Pen", 1.0, 2.0), (1, 1, "Ink", 1.0, 3.0), (3, 0, "1 rod", 2.0, 6.0), (4, 0, "P", 2.0, 6.0)]
