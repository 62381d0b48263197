"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
CHEAP = [
    "items_from_plain_lines", "number_locale_parse", "dates_parsed", "tax_checks", "zoom_merge", "agreement_matrix", "p95_nearest_rank", "page_selection", "identity_cards", "stream_timeout",
    "currency_detect", "provenance_flags", "placeholder_cleanup", "bol_fields", "bol_blocks_ffill", "bol_second_look", "party_layouts", "party_fallbacks", "invoice_looks", "invoice_sections", "items_from_loose_text",
    "row_reasons", "item_garbage", "card_corrections", "tag_stream", "sample_files", "small_rules", "text_parts", "model_refinement", "max_concurrency", "load_throughput", "items_from_html", "items_from_loose_html", "field_comparators", "validity_verdicts", "invoice_whole_text", "sql_surface", "sample_corpus", "json_sink", "corpus_columns", "invoice_looks_unmarked", "item_garbage_rules", "tag_modes", "stalled_streams", "party_tidying"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    shown = [tuple(r[c] for c in cols) for r in got.collect()]
    assert sorted(shown, key=key) == sorted(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM want").fetchall(), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["nation", "n_items", "revenue"]
