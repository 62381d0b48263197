import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import html_table, invoice, items, shipping
from foliospark.sources import readers


def rows(spark, text):
    df = items.with_items(spark.createDataFrame([(text,)], "raw string"), "raw")
    return [(x.productName, x.unit, x.quantity, x.unitPrice, x.amount) for x in df.first()["items"]]


def test_pipe_vietnamese(spark):
    text = "HÓA ĐƠN\n| STT | Tên hàng | ĐVT | SL | Đơn giá | Thành tiền |\n|---|---|---|---|---|---|\n| 1 | Gạch | m2 | 500 | 185.000 | 92.500.000 |\n| | Cộng tiền hàng | | | | 92.500.000 |"
    assert rows(spark, text) == [("Gạch", "m2", 500.0, 185000.0, 92500000.0)]


def test_pipe_second_price_is_amount(spark):
    text = "| Item # | Description | Quantity | Unit Price | Unit | Price |\n|--|--|--|--|--|--|\n| 1 | Red pen | 5 | 1.50 | pcs | 7.50 |\n| 2 | Blue\npen | 2 | 2,00 | pcs | 4,00 |\n| TOTAL | | | | | 11.50 |"
    assert rows(spark, text) == [("Red pen", "pcs", 5.0, 1.5, 7.5), ("Blue pen", "pcs", 2.0, 2.0, 4.0)]


def test_pipe_oddities(spark):
    # Ghost column, units in a row of their own, numbering row, repeated row, lone price.
    text = "| Description | Col2 | Quantity | Price |\n| | KGS | USD |\n| (1) | (2) | (3) |\n| Steel | 10 | 50 |\n| Steel | 10 | 50 |\n| Batch: 7 | 1 | 1 |"
    assert rows(spark, text) == [("Steel", "KGS", 10.0, None, 50.0)]
    # A name below a code.
    text = "| Description | Quantity | Amount |\n| 12345 | 4 | 80.50 |\n| Copper wire | | |\n| Nail | 1 | 2 |"
    assert rows(spark, text) == [("Copper wire", None, 4.0, None, 80.5), ("Nail", None, 1.0, None, 2.0)]
    # No header: by place.
    assert rows(spark, "| 1 | Pen | pcs | 2 | 3 | 6 |") == [("Pen", "pcs", 2.0, 3.0, 6.0)]
    # Fewer cells than the header.
    assert rows(spark, "| Description | Quantity | Tax Rate | Amount |\n| Pen | 2 | 6.00 |") == [("Pen", None, 2.0, None, 6.0)]
    # More cells than the header.
    assert rows(spark, "| Description | Quantity |\n| Pen | 2 | 2.62/KG | 1 297,45 |") == [("Pen", None, 2.0, 2.62, 1297.45)]


def test_html(spark):
    text = "<table><tr><td>STT</td><td>Tên</td><td>ĐVT</td><td>SL</td><td>Giá</td><td>Tiền</td></tr><tr><td>(1)</td><td>(2)</td><td>(3)</td><td>(4)</td><td>(5)</td><td>(6=4x5)</td></tr><tr><td>1</td><td>A &amp; B</td><td>cái</td><td>4 x 5</td><td>1.000</td><td>20.000</td></tr><tr><td>Cộng tiền</td><td></td><td></td><td></td><td></td><td>5</td></tr></table>"
    assert rows(spark, text) == [("A & B", "cái", 20.0, 1000.0, 20000.0)]


def test_plain_lines(spark):
    df = spark.createDataFrame([("1 bolt 5 1.000 5.000\nx 1 2 3\n2 few 3",)], "raw string").select(items.plain_items(F.col("raw")).alias("i"))
    assert [(x.productName, x.quantity, x.unitPrice, x.amount) for x in df.first()["i"]] == [("1 bolt   .000", 5.0, 1000.0, 5000.0)]  # numbers go wherever they stand


def test_nulls_and_filters(spark):
    from pyspark.sql import functions as F

    assert items.with_items(spark.createDataFrame([(None,)], "raw string"), "raw").first()["items"] == []
    text = "| Description | Quantity | Unit Price | Amount |\n| Pen | 1 | 2 | 2 |\n| Ink | 1 | 3 | 3 |\n| Pen. | 1 | 2 | 2 |\n| Ink. | 1 | 3 | 3 |"
    df = items.with_items(spark.createDataFrame([(text,)], "raw string"), "raw")
    got = df.select(items.collapsed_double(F.col("items")).alias("i"), items.amount_sum(F.col("items")).alias("s")).first()
    assert [x.productName for x in got.i] == ["Pen", "Ink"] and got.s == 10.0
    bad = [("USD", 1.0, 1.0, 1.0), ("FOB:", 1.0, 1.0, 1.0), ("ok", None, None, None), ("good", 1.0, None, 2.0), ("12", None, None, 2.0), ("-", 1.0, None, 1.0), ("DHL express", 1.0, 1.0, 1.0), ("x", 1.0, 1.0, 2e12)]
    made = spark.createDataFrame([([(None, n, None, p, q, a, None, None, None) for n, q, p, a in bad],)], f"items {items.ITEMS}")
    assert [x.productName for x in made.select(items.without_garbage(F.col("items")).alias("i")).first().i] == ["good"]


def test_html_rows_to_the_end(spark):
    n = 100_003
    text = "<table><tr><td>No</td></tr>" + "".join(f"<tr><td>{k}</td><td>P{k}</td><td>pcs</td><td>2</td><td>3</td><td>6</td></tr>" for k in range(1, n + 1)) + "</table>"
    docs = spark.createDataFrame([(text,)], "raw string")
    assert items.with_html_items(docs, "raw").select(F.size("items").alias("n")).first().n == n


def test_samples_to_the_end(spark):
    n = 100_003
    rule = "=" * 20
    text = "".join(f"{rule}\n== SAMPLE {k} - s ==\n{rule}\nt{k}\n" for k in range(1, n + 1))
    out = readers.split_samples(spark.createDataFrame([(text,)], "value string"))
    assert out.where("text IS NULL").count() == 0 and out.where(f"sample_no = {n}").first().text == f"t{n}"


def test_lines_to_the_end(spark):
    text = "Shipper:\nNAME\n" + "\n".join(f"x{k}" for k in range(10_005)) + "\nConsignee: Q"
    got = shipping.fields(spark.createDataFrame([(text, 1), (None, 2), ("", 3)], "raw_text string, carrier int")).collect()
    assert got[0].shipperName == "NAME" and got[0].shipperAddress.endswith(", x10004") and got[0].consigneeName == "Q"
    assert all(r[f] is None for r in got[1:] for f in shipping.FIELDS)
    text = "Đơn vị bán hàng: A\nNgười mua hàng: B\n" + "x\n" * 10_005 + "Mã số thuế: 0107500414"
    got = invoice.heads(spark.createDataFrame([(text, 1), (None, 2), (" \n", 3)], "raw_text string, sellerName int")).collect()
    assert (got[0].sellerName, got[0].buyerTaxCode) == ("A", "0107500414")
    assert all(v is None for r in got[1:] for n, v in r.asDict().items() if n != "raw_text")


CELL = "".join(f"<td>{x}</td>" for x in ("1", "rod", "kg", "2", "3", "6"))


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (CELL, ["1", "rod", "kg", "2", "3", "6"]),
        ("<td>1<td>rod<td>kg<td>2<td>3<td>6", ["1", "rod", "kg", "2", "3", "6"]),
        ("<TD class='a>b' title=\"x>\">1</TD ><td>a<br>b <b> c </b></td>", ["1", "abc"]),
        ("<td>1</td><td><table><tr><td>in</td><td>ner</td></tr></table> out</td><td>z</td>", ["1", "innerout", "z"]),
        ("<td>&#80;&#x50;&amp;&lt;&nbsp;&Agrave;&euro;&unknown; a&ampb</td>", ["PP&<\xa0À€&unknown; a&b"]),
        ("<td>a<!-- <td>no</td> --></td><td><script>if (a<b) '</td>'</script>x</td>", ["a", "x"]),
        ("<td colspan=2>a < b</td><th>head</th><td>c", ["a < b", "c"]),
        ("", []),
    ],
)
def test_html_rows(row, want):
    for text in (f"x <table><tr><td>head</td></tr><tr>{row}</tr></table> <table><tr><td>second</td></tr></table>", f"<TABLE><thead><tr><td>head<tbody><tr>{row}"):
        assert html_table.first_table(text) == [["head"], want]


def test_html_tables_that_never_end():
    for text in ("<table>" * 20_000, "<table><tr>" + "<td>" * 50_000, "<a" * 50_000, "<a '" * 50_000 + ">", "<table><tr><td>" + "&" * 100_000, "<!--" * 50_000, '<td "' * 50_001 + ">"):
        began = time.process_time()
        html_table.items_of(text)
        assert time.process_time() - began < 3


def test_plain_lines_of_one_text(spark):
    texts = ["1 rod 2 3.000 6.000\n2 x 1 1 1", "", None, "no\n12 a 1,5 2\n3  b 1 2 3 4", " 1 a 1 2 3", "1\t2 3 4"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", items.plain_items(F.col("t")).alias("i")).collect()
    for r in rows:
        assert [x.asDict() for x in r.i] == items.plain_of(r.t)
