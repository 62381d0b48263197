"""Scalars against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliospark.functions import dates, numbers, plain, text, words


def each(spark, fn, cases, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], f"k int, x {kind}")
    got = {r.k: r.y for r in rows.select("k", fn(F.col("x")).alias("y")).collect()}
    for k, (x, want) in enumerate(cases):
        assert got[k] == (pytest.approx(want) if isinstance(want, float) else want), (x, got[k], want)


def test_numbers(spark):
    each(spark, numbers.parse_number, [
        ("1.234.567,89", 1234567.89), ("1,234,567.89", 1234567.89), ("24.150,000", 24150000.0), ("1,234.567", 1234.567), ("1,50", 1.5), ("1,234", 1234.0),
        ("0,588", 0.588), ("1,234,567", 1234567.0), ("107.800", 107800.0), ("1.5", 1.5), ("1.234.567", 1234567.0), ("109.258.00", 109258.0), ("0.588", 588.0),
        ("-5", 5.0), ("$3,240.00", 3240.0), ("USD 0.25", 0.25), ("VND 8,500,000", 8500000.0), ("37,580 USD", 37580.0), ("1 297,45", 1297.45), ("16,200KG", 16200.0),
        ("5kg", 5.0), ("1.5e3", 1.53), ("12.", 12.0), ("", None), ("abc", None), (".", None), (",", None), (None, None),
    ])
    each(spark, numbers.parse_quantity, [("4 x 5", 20.0), ("1.250", 1250.0), ("6,00", 6.0), ("2 x 1.5", 2.0), ("3×4", 12.0)])
    each(spark, numbers.parse_price, [("2.044", 2.044), ("12.345", 12.345), ("150.000", 150000.0)])
    each(spark, numbers.tax_percent, [(10.0, "10%"), (10.5, "10.5%")], "double")
    each(spark, numbers.local_phone, [("+84 24 3747", "0243747"), ("024 3747", "0243747")])


def test_words_to_numbers(spark):
    each(spark, words.vn_words_to_number, [
        ("Ba trăm bảy mươi triệu bốn trăm bốn mươi nghìn đồng", 370440000.0), ("mười hai", 12.0), ("hai mươi ba", 23.0), ("hai mươi ba nghìn", 23000.0),
        ("một trăm linh năm", 105.0), ("một tỷ hai trăm triệu", 1200000000.0), ("triệu", 1000000.0),
    ])
    each(spark, words.vn_spoken_to_number, [
        ("Ba trăm bảy mươi triệu bốn trăm bốn mươi nghìn đồng", 370440000.0), ("mười hai", 12.0), ("hai mươi ba", 3.0), ("hai mươi ba nghìn", 3000.0),
        ("một trăm linh năm", 105.0), ("một tỷ hai trăm triệu", 1200000000.0), ("triệu", 0.0),
    ])
    each(spark, words.en_words_to_number, [
        ("twenty five thousand six hundred thirty four and cents twenty eight", 25634.28), ("US DOLLARS SIXTY FIVE THOUSAND FOUR HUNDRED EIGHTY THREE AND CENTS TWENTY SIX ONLY", 65483.26),
        ("five euros and twenty cents", 5.20), ("no number words", 0.0), ("one hundred dollars only", 100.0), ("one hundred dollars fifty cents", 100.5), ("ten dollars and five only", 10.05),
        ("one thousand, two hundred and thirty-four and fifty-six cents", 1234.56), ("Fifty cents", 0.5), ("two hundred and ninety nine", 299.0), ("seven million eight", 7000008.0), (None, 0.0), ("", 0.0),
    ])


def test_numbers_to_words(spark):
    each(spark, words.number_to_vn_words, [
        (370440000.0, "Ba trăm bảy mươi triệu bốn trăm bốn mươi nghìn đồng"), (1000005.0, "Một triệu năm đồng"), (21.0, "Hai mươi mốt đồng"), (15.0, "Mười lăm đồng"),
        (24.0, "Hai mươi tư đồng"), (14.0, "Mười bốn đồng"), (105.0, "Một trăm lẻ năm đồng"), (0.0, ""), (-1.0, ""), (1e12, ""),
    ], "double")
    each(spark, words.number_to_en_words, [
        (1234.56, "One thousand, two hundred and thirty-four and fifty-six cents"), (100.0, "One hundred only"), (21.0, "Twenty-one only"), (0.5, "Fifty cents"), (0.0, ""),
    ], "double")


def test_dates(spark):
    day = dt.date
    each(spark, dates.parse_document_date, [
        ("31/12/2024", day(2024, 12, 31)), ("12/31/2024", day(2024, 12, 31)), ("03/04/2025", day(2025, 4, 3)), ("31/02/2024", None),
        ("Ngày 04 tháng 08 năm 2025", day(2025, 8, 4)), ("NGÀY 4 tháng 8 năm 2025", day(2025, 8, 4)), ("2024-05-06", None), ("1.2.2024", day(2024, 2, 1)),
    ])
    each(spark, dates.parse_model_date, [("2024-05-06", day(2024, 5, 6)), ("12/31/2024", day(2024, 12, 31)), ("31-12-2024", day(2024, 12, 31)), ("x", None)])
    each(spark, dates.iso_to_slashes, [("2024-05-06", "06/05/2024"), ("6.5.2024", "6.5.2024")])


def test_text(spark):
    each(spark, text.phone, [("Điện thoại: 024 3747 6666 Fax: 1", "02437476666"), ("Tel: 1234567", None), (None, None)])
    each(spark, lambda x: text.selected_pages(x, F.lit(5)), [
        ("1,3", [0, 2]), ("4-9", [3, 4]), ("3-1", [0, 1, 2, 3, 4]), ("0", [0, 1, 2, 3, 4]), ("x", [0, 1, 2, 3, 4]), ("all", [0, 1, 2, 3, 4]), ("", [0, 1, 2, 3, 4]), ("2,2", [1]), (None, [0, 1, 2, 3, 4]),
    ])
    each(spark, text.pages_of, [("--- PAGE 1 ---\nA\n--- PAGE 2 ---\n \n--- PAGE 3 ---\nC", ["A", "C"])])
    each(spark, text.clean_rawtext, [("<|ref|>a\nb<|/ref|>x\r\n\n\ny<|det|>q<|/det|> ", "x\ny")])
    each(spark, text.invoice_lines, [('## Head\n**bold** <|x|>t\n|---|:-\n|--|--|\n"\n"a\nb"\n"c"', ["Head", "bold t", "|---|:-", "a", "b", '"c"'])])
    each(spark, text.salvaged_json, [('<think>x</think>```json\n{"a":1}\n```', '{"a":1}'), ('so: {"a":2} end', '{"a":2}'), ("no", None), ("{bad", None)])
    each(spark, text.not_placeholder, [("[Invoice.No]", None), ("[a b]", "[a b]"), ("x", "x")])
    each(spark, lambda x: text.not_placeholder(x, False), [("[a b]", None), ("{{x}}", None), ("x", "x")])
    each(spark, text.amount_in_words, [("Một triệu đồng chẵn. |Người mua hàng ký", "Một triệu đồng chẵn"), ("Misa abc", "Misa abc"), ("một trăm nghìn\\nđồng.;", "một trăm nghìn đồng")])
    each(spark, text.email, [("to a.b-c@x.org, ok", "a.b-c@x.org"), ("none", None)])
    each(spark, lambda x: F.to_json(F.array(*text.split_serial(x))), [("1C25THO", '["1","C25THO"]'), ("AA/19P", '["AA/19P",null]'), ("01GTKT0/001", '["01","GTKT0/001"]')])
    each(spark, lambda x: text.char_jaccard(x, F.lit("abcd")), [("ABCE", 0.6), ("", 0.0), ("abcd", 1.0)])
    each(spark, lambda x: text.base64_payload(x).cast("string"), [("data:x;base64,aGk=", "hi"), ("aGk=", "hi"), ("?", None)])
    each(spark, lambda x: text.corrected(x, [("a", "b"), ("bb", "c")]), [("ab", "c")])


def test_single_texts_are_read_as_columns_are(spark):
    """functions.plain against the Column functions, on texts made of what numbers and lines are made of."""
    import random

    rng = random.Random(4)
    made = ["".join(rng.choice(["1", "23", "456", "000", ".", ",", "-", " ", "$", "€", "USD ", "x", "×", "kg", "0"]) for _ in range(rng.randint(0, 7))) for _ in range(600)] + [None]
    lines = ["".join(rng.choice(["a", "**b**", "\n", "\\n", "|", "---", '"', "# ", "<|x|>", " ", "<|ref|>q<|/ref|><|det|>r<|/det|>", "https://", ".", "misa"]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(made)], "k int, x string").select("k", *[f(F.col("x")).alias(f.__name__) for f in (numbers.parse_number, numbers.parse_quantity, numbers.parse_price)])
    for r in rows.collect():
        x = made[r.k]
        assert (r.parse_number, r.parse_quantity, r.parse_price) == (plain.number(x), plain.quantity(x), plain.price(x)), x
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").select("k", text.shipping_lines(F.col("x")).alias("s"), text.invoice_lines(F.col("x")).alias("i"), text.amount_in_words(F.col("x")).alias("w"))
    for r in rows.collect():
        x = lines[r.k]
        assert (r.s or [], r.i or [], r.w or None) == (plain.shipping_lines(x), plain.invoice_lines(x), plain.amount_in_words(x)), x


def test_document_dates():
    cases = [("12/31/2024", False, "31/12/2024"), ("03/04/2024", False, "04/03/2024"), ("03/04/2024", True, "03/04/2024"), ("31/01/2024", False, "31/01/2024"), ("Jan 5, 2024", False, "05/01/2024"), ("5th March 2023", False, "05/03/2023"), ("2024-05-06", False, "06/05/2024"), ("12.01.2024", False, "12/01/2024"), ("Ngày 04 tháng 08 năm 2025", True, "04/08/2025"), ("05-JUN-2022", False, "05/06/2022"), ("99/99/2024", False, None), ("1/1/1800", False, None), (None, True, None), ("May be 12 of 2024", False, None)]
    for x, day_first, want in cases:
        assert plain.document_date(x, day_first) == want, x
