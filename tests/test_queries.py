"""A few registered queries against their DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from folioforge.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["clean_text", "classify_pdf", "page_reasons", "ocr_run_budget", "quality_span_kind", "header_row_detect", "paragraph_islands", "round_trip_xlsx", "round_trip_pdf", "rich_docx", "rich_xlsx", "rich_pptx", "rich_pdf", "convert_pdf_ocr", "convert_errors", "ocr_health_documents", "ocr_fusion_documents", "format_summary", "local_run_accounting", "live_plan_first_fit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(key([r[c] for c in names]) for r in df.collect()) == sorted(map(key, got.fetchall()))


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["gfm_slug_unique", "list_markers"])
def test_queries_of_all_lines(spark, duck, name):
    test_query(spark, duck, name)
    lines = duck.execute("SELECT sum(len(string_split(text, chr(10)))) FROM documents").fetchone()[0]
    assert registry.QUERIES[name](spark, SF).count() == lines > duck.execute("SELECT count(*) FROM documents").fetchone()[0]
