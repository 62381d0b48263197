"""Document texts rendered from the order tables, so that parsing them can be held against the tables.

The parsers see (doc_id, raw_text) only. All expressions are built in; shuffles gather an order's lines, and deal rows of tables out before texts are made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.words import number_to_en_words, number_to_vn_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows over all cores, by a key: a small file is one task's, and the texts that come of its rows would all be one reader's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, items): each order's distinct (name, qty, amount), in order. Orders are dealt out over all cores: of few large shuffle partitions, the last ones would keep a core or two with the texts made of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.bround("l_extendedprice", 2).alias("amount"))
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct(F.concat_ws(" ", "p_name", F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("name"), F.col("l_quantity").cast("long").alias("qty"), "amount")
    return dealt(named, "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, customer, nation, supplier-like seller, day) of each order."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"), "c_name", "c_custkey", "n_name", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "o_orderpriority"
    )


def english(x: Column) -> Column:
    """1234.5 as 1,234.50."""
    return F.format_number(x, 2)


def vietnamese(x: Column, decimals: int = 0) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(x, decimals), ".,", ",.")


def pipe_table(items: Column) -> Column:
    row = lambda x, k: F.concat_ws(" | ", F.concat(F.lit("| "), (k + 1).cast("string")), x["name"], x["qty"].cast("string"), english(x["amount"] / x["qty"]), F.lit("pcs"), F.concat(english(x["amount"]), F.lit(" |")))
    head = F.lit("| Item # | Description | Quantity | Unit Price | Unit | Price |\n| --- | --- | --- | --- | --- | --- |\n")
    return F.concat(head, F.array_join(F.transform(items, row), "\n"))


def html_table(items: Column) -> Column:
    cell = lambda *xs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in xs], F.lit("</tr>"))
    row = lambda x, k: cell((k + 1).cast("string"), x["name"], F.lit("cái"), x["qty"].cast("string"), vietnamese(x["amount"] / x["qty"], 2), vietnamese(x["amount"], 2))
    head = cell(*map(F.lit, ["STT", "Tên hàng", "ĐVT", "SL", "Đơn giá", "Thành tiền"]))
    number = cell(*map(F.lit, ["(1)", "(2)", "(3)", "(4)", "(5)", "(6=4x5)"]))
    return F.concat(F.lit("<table>"), head, number, F.array_join(F.transform(items, row), ""), cell(F.lit("Cộng tiền hàng"), *[F.lit("")] * 5), F.lit("</table>"))


def loosened(text: Column, key: Column) -> Column:
    """A text's HTML table in one of five looser ways, by the key: cells and rows not closed; a table within the unit's cell; letters as numbers;
    tags in capitals with brackets in their attributes; comments, bold and line breaks in cells and rows of a section."""
    body = F.regexp_replace(text, "</t[dr]>", "")
    nested = F.replace(text, F.lit("<td>cái</td>"), F.lit("<td><table><tr><td>cá</td><td>i</td></tr></table></td>"))
    coded = F.replace(F.replace(F.replace(text, F.lit("r"), F.lit("&#114;")), F.lit("<t&#114;>"), F.lit("<tr>")), F.lit("</t&#114;>"), F.lit("</tr>"))
    coded = F.replace(coded, F.lit("cái"), F.lit("c&aacute;&#x69;"))
    shouted = F.replace(F.replace(text, F.lit("<td>"), F.lit("<TD title='a>b' data-x=\"</td>\">")), F.lit("</td>"), F.lit("</TD >"))
    marked = F.replace(F.replace(text, F.lit("<td>cái</td>"), F.lit("<td><!-- <td>x</td> --><b>cái</b><br/></td>")), F.lit("<table>"), F.lit("<table border=1><tbody>"))
    return F.element_at(F.array(body, nested, coded, shouted, marked), (F.abs(key) % 5 + 1).cast("int"))


def plain_lines(items: Column) -> Column:
    """Lines with whole amounts: number, name, quantity, price and amount."""
    row = lambda x, k: F.concat_ws(" ", (k + 1).cast("string"), F.regexp_replace(x["name"], r"\d", "x"), x["qty"].cast("string"), vietnamese(F.floor(x["amount"] / x["qty"])), vietnamese(F.floor(x["amount"])))
    return F.array_join(F.transform(items, row), "\n")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text): an English invoice of each order that has lines."""
    df = orders(spark, sf_dir).join(order_lines(spark, sf_dir), "doc_id")
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["amount"])
    df = df.withColumn("sum", F.bround(total, 2)).withColumn("tax", F.floor(F.col("sum") * 10 + 0.001) / 100)
    text = F.concat_ws(
        "\n", F.lit("# **COMMERCIAL INVOICE**"), F.concat(F.lit("Invoice No: INV"), F.col("doc_id").cast("string")), F.concat(F.lit("Date: "), F.date_format("day", "MM/dd/yyyy")), F.lit("Seller: Folio Trading Co., Ltd"),
        F.lit("Tax code: 0106046798"), F.concat(F.lit("Buyer: "), F.col("c_name")), F.concat(F.lit("Tax code: "), F.lpad(F.col("c_custkey").cast("string"), 10, "7")), F.concat(F.lit("Country: "), F.col("n_name")),
        F.lit("Payment method: T/T"), F.lit(""), pipe_table(F.col("items")), F.lit(""), F.concat(F.lit("Sub total: USD "), english(F.col("sum"))), F.lit("VAT 10%"), F.concat(F.lit("VAT amount: USD "), english(F.col("tax"))),
        F.concat(F.lit("Invoice total: USD "), english(F.col("sum") + F.col("tax"))), F.concat(F.lit("In words: "), number_to_en_words(F.bround(F.col("sum") + F.col("tax"), 2))),
    )
    return df.select("doc_id", text.alias("raw_text"))


def vn_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text): a Vietnamese invoice of each order, an HTML table in it."""
    df = orders(spark, sf_dir).join(order_lines(spark, sf_dir), "doc_id")
    text = F.concat_ws(
        "\n", F.lit("HÓA ĐƠN GIÁ TRỊ GIA TĂNG"), F.concat(F.lit("Ký hiệu: 1C25T"), F.substring(F.col("n_name"), 1, 2)), F.concat(F.lit("Số: "), F.col("doc_id").cast("string")),
        F.concat(F.lit("Ngày "), F.date_format("day", "dd"), F.lit(" tháng "), F.date_format("day", "MM"), F.lit(" năm "), F.date_format("day", "yyyy")), F.lit("Đơn vị bán hàng: CÔNG TY FOLIO"), F.lit("Mã số thuế: 0106046798"),
        F.lit("Điện thoại: 024 3747 6666"), F.concat(F.lit("Tên đơn vị: "), F.col("c_name")), html_table(F.col("items")), F.concat(F.lit("Số tiền viết bằng chữ: "), number_to_vn_words(F.floor("o_totalprice"))),
    )
    return df.select("doc_id", text.alias("raw_text"))


def bills_of_lading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text): a bill of lading of each order, labels of the route above its values."""
    df = dealt(orders(spark, sf_dir), "doc_id")
    digits = F.lpad((F.col("doc_id") % 10_000_000).cast("string"), 7, "0")
    text = F.concat_ws(
        "\n", F.lit("FOLIO OCEAN SHIPPING"), F.lit("BILL OF LADING"), F.concat(F.lit("B/L No. FO"), F.col("doc_id").cast("string")), F.lit("Shipper:"), F.lit("FOLIO TRADING CO"), F.lit("12 HARBOUR STREET"), F.lit("TEL: +84 24 3747"),
        F.lit("Consignee: TO ORDER"), F.col("c_name"), F.lit("TAX ID: 0107500414"), F.lit("Notify party: SAME AS CONSIGNEE"), F.lit("| Ocean Vessel / Voy. No. | Port of Loading | Port of Discharge |"),
        F.concat(F.lit("| FOLIO STAR "), F.lpad((F.col("doc_id") % 900 + 100).cast("string"), 3, "0"), F.lit("E | HAI PHONG | "), F.col("n_name"), F.lit(" |")), F.lit("Container No. / Seal No."), F.concat(F.lit("FOLU"), digits, F.lit(" / 40HQ / A"), digits),
        F.concat(F.lit("Total: "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(" PALLETS")), F.concat(english(F.floor(F.col("o_totalprice") / 10)), F.lit(" KGS")), F.concat(english(F.floor(F.col("o_totalprice") / 1000) + 10), F.lit(" CBM")),
        F.when(F.col("doc_id") % 2 == 0, "FREIGHT PREPAID").otherwise("FREIGHT COLLECT"), F.concat(F.lit("Laden on board "), F.upper(F.date_format("day", "ddMMMyyyy"))), F.lit("Signed by the master"),
    )
    return df.select("doc_id", text.alias("raw_text"))


def identity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, front_text, back_text): a card of each customer."""
    df = dealt(table(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    front = F.concat_ws(
        "\n", F.lit("CĂN CƯỚC CÔNG DÂN"), F.concat(F.lit("Số / No.: "), F.lpad(F.col("c_custkey").cast("string"), 12, "0")), F.lit("Họ và tên / Full name:"), F.upper("c_name"), F.lit("Ngày sinh / Date of birth: 01/02/1990"),
        F.concat(F.lit("Giới tính / Sex: "), F.when(F.col("c_custkey") % 2 == 0, "Nam").otherwise("Nữ"), F.lit(" Quốc tịch / Nationality: "), F.col("n_name")), F.lit("Quê quán / Place of origin: "), F.concat(F.lit("Xã "), F.col("c_mktsegment")),
        F.lit("Nơi thường trú / Place of residence:"), F.lit("Số 1 Phố Mới"), F.col("n_name"), F.lit("Có giá trị đến / Date of expiry: 31/12/2030"),
    )
    back = F.concat_ws("\n", F.lit("Đặc điểm nhân dạng / Personal identification:"), F.lit("Nốt ruồi C:1cm"), F.lit("Ngày, tháng, năm / Date, month, year: 27/06/2021"), F.lit("CỤC TRƯỞNG CỤC CẢNH SÁT"), F.when(F.col("c_custkey") % 3 == 0, "IDVNM123").otherwise("-"))
    return df.select(F.col("c_custkey").alias("doc_id"), front.alias("front_text"), back.alias("back_text"))
