"""Every query of the subpackage against its SQL twin, on the small tables."""

import os

import duckdb
import pytest

from wedgeworks.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the document tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    key = lambda rows: sorted(map(repr, plain_rows(rows)))
    assert key(map(tuple, got.select(*columns).collect())) == key(want)


def plain_rows(rows):
    return [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the document tables")
def test_every_query_returns_a_row_per_document_or_page(spark):
    sizes = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op5_pii", "op7_token_counts", "op10_quality_crf"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == sizes["documents"], name
    assert QUERIES["op6_html_extraction"](spark, SF).count() == sizes["pages"]
