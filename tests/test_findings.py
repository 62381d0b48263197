"""Queries against their SQL on tables that are made for one finding each."""

import os

import duckdb

import __spark_entry__

SF = "/root/testdata/sf0.001"


def tables(folder, **made):
    """The smallest tables with some replaced by what the SQL in `made` says of them."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.split(".")[0]
        con.execute(f"COPY ({made.get(name, 'SELECT * FROM t').replace('FROM t', f"FROM '{SF}/{f}'")}) TO '{folder}/{f}' (FORMAT parquet)")
    return str(folder)


def same(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = __spark_entry__.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    shown = [tuple(r[c] for c in cols) for r in got.collect()]
    assert len(shown) > 0 and sorted(shown, key=key) == sorted(want, key=key)


def test_prices_that_look_like_years(spark, tmp_path):
    same(spark, tables(tmp_path, orders="SELECT * REPLACE (1900.0::DOUBLE + o_orderkey % 201 AS o_totalprice) FROM t"), "small_rules")


def test_totals_that_look_like_years(spark, tmp_path):
    lines = "SELECT * REPLACE (1700.0::DOUBLE + l_orderkey % 401 AS l_extendedprice) FROM t WHERE l_orderkey < 400 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) = 1"
    same(spark, tables(tmp_path, lineitem=lines), "invoice_totals")


def test_years_beside_prices_that_look_like_them(spark, tmp_path):
    """`Total: 2024` is a year though a unit price of the table is 2,024.00."""
    lines = "SELECT * REPLACE (2024.0::DOUBLE * l_quantity AS l_extendedprice) FROM t WHERE l_orderkey < 400"
    same(spark, tables(tmp_path, lineitem=lines), "invoice_totals")


def test_years_are_told_where_they_are_read():
    from foliospark.operators import invoice

    item = "COMMERCIAL INVOICE\n| Description | Quantity | Unit Price | Amount |\n| pen | 2 | 2,024.00 | 4,048.00 |\n| ink | 1 | 30.00 | 30.00 |\n"
    for said, total in (("Total: 2024", None), ("Total: 2,024.00", 2024.0), ("| Total | 2024 |", None), ("| Total | 2,024.00 |", 2024.0), ("Subtotal\nTotal\n2000\n2024", None), ("Subtotal\nTotal\n2,000.00\n2,024.00", 2024.0)):
        f = invoice.parse(item + said)
        assert (f["totalAmount"] if f["totalAmount"] in f["noYears"] else None) == total, said


def test_texts_of_small_files_are_many_tasks(spark):
    """A file of one task: the rows that texts are made of are dealt out, whatever Spark would join again."""
    for name in ("invoice_looks", "invoice_looks_unmarked", "party_layouts", "items_from_loose_text", "bol_second_look", "bol_fields", "invoice_whole_text", "party_fallbacks"):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Exchange")] if "Exchange" in plan else ""
        assert "MapInArrow" in above, name


def test_rows_are_cut_once(monkeypatch):
    """However many layouts and rules ask for cells, a row of an invoice's table is cut into them a bounded number of times."""
    from foliospark.operators import invoice

    rows = [f"| {k} | blue pen P{k} | 2 | 5.00 | 10.00 |" for k in range(200)]
    text = "\n".join(["COMMERCIAL INVOICE", "Invoice No: INV1", "Date: 07/25/1997", "Seller: Folio Ltd", "Buyer: Q", "| Item | Description | Quantity | Price | Amount |", *rows, "Total amount: 2,000.00"])
    cut, cells = [], invoice._cells
    monkeypatch.setattr(invoice, "_cells", lambda line: cut.append(line) or cells(line))
    got = invoice.parse(text)
    assert got["sellerName"] == "Folio Ltd" and got["totalAmount"] == 2000.0
    assert len(cut) <= 2 * len(rows)


def test_labels_of_amounts_as_by_their_pattern():
    from foliospark.operators import invoice

    for line in ("Sub total: 5", "TOTAL AMOUNT DUE 7", "subtotals total", "totals", "x_total total", "Tổng cộng tiền thanh toán: 1", "Invoıce total 3 total", "İ total 5", "ſubtotal 4", "VAT amount (total)", "no label"):
        m = invoice._AMOUNT.search(line)
        assert invoice._amount_label(line) == ((m[0].lower(), m.end()) if m else None)


def test_asked_fields_are_as_if_all_were_read():
    from foliospark.operators import invoice
    from foliospark.plans import queries
    from foliospark.sources import layouts

    texts = [p[0] for p in layouts.PARTIES] + [row[0] for row in queries._WHOLE]
    texts += ["CÔNG TY A\n0106046798\nSố: 12\nKý hiệu: AB1\nNgày 01 tháng 02 năm 2020", "COMMERCIAL INVOICE\nInvoice No: A1\n| Description | Amount |\n| a | 5.00 |\n| 9% | CGST | 1.00 |\nTotal: 2024", "", None]
    for text in texts:
        whole = invoice.parse(text)
        for asked in (["invoiceID"], ["invoiceDate", "invoiceSerial"], ["totalAmount", "noYears"], ["sellerName"], ["buyerTaxCode"], ["taxPercent"], ["largest"], ["rules"], ["currency", "invoiceName", "sellerPhoneNumber"]):
            got = invoice.parse(text, frozenset(asked))
            assert [got.get(n) for n in asked] == [whole.get(n) for n in asked], (text, asked)


def test_what_is_not_asked_for_is_not_read(monkeypatch, spark):
    """Totals are read without the parties, and queries ask for the fields that they show."""
    from foliospark.operators import invoice

    text = "COMMERCIAL INVOICE\nSeller: Folio Ltd\nBuyer: Q\n| Description | Amount |\n| a | 5.00 |\nTotal amount: 5.00"
    for f in ("english_parties", "section_party", "currency_of"):
        monkeypatch.setattr(invoice, f, lambda *_: 1 / 0)
    assert invoice.parse(text, frozenset(["totalAmount", "preTaxPrice"]))["totalAmount"] == 5.0
    for name in ("field_coverage_rollup", "invoice_header_fields", "total_vs_items_flags", "validation_summary", "vn_invoice_fields"):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" in plan and "buyerBankAccountNumber" not in plan and "blockNumbers" not in plan, name


def test_orders_are_dealt_out_before_texts_are_made(spark):
    """Shuffle partitions that Spark would join to few large ones keep their number, so that all cores have invoices to read."""
    from foliospark.sources import render

    plan = render.invoices(spark, SF)._jdf.queryExecution().executedPlan().toString()
    n = 4 * spark.sparkContext.defaultParallelism
    assert [x for x in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in x and f", {n}), REPARTITION_BY_NUM" in x]


def test_texts_go_no_further_than_their_items(spark):
    """In SQL as well: a text is not repeated beside each of its items, nor its day read again for each, and no table in Arrow is made of each text's few items."""
    plan = __spark_entry__.queries()["sql_surface"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("BatchEvalPythonUDTF invoice_items", 1)
    assert "raw_text" not in above and "document_date" not in above and "document_date" in below
