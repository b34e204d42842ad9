"""Every registered query of the text operators on the smallest tables: columns, types and rows."""

import pytest

from gneiss.llm import queries as llm

DATA = "/root/testdata/sf0.001"
SHAPES = {
    "p2_found": [("audit_id", "bigint"), ("crawl_id", "bigint")],
    "p3_found": [("crawl_id", "bigint")],
    "p4_found": [("first_id", "bigint"), ("candidate_id", "bigint")],
    "p4_arrivals": [("first_id", "bigint"), ("candidate_id", "bigint")],
    "p5_found": [("crawl_id", "bigint"), ("line_no", "int")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("start_char", "int"), ("end_char", "int")],
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, DATA)
    assert df.dtypes == SHAPES.get(name, df.dtypes)
    rows = df.collect()
    assert rows or name == "p7_variants"  # no case is planted
    if name not in ("p2_quotes", "p6_ids"):
        assert len(rows) == len(set(map(tuple, rows)))


def test_all_documents_are_encoded(spark):
    assert llm.queries()["p6_ids"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_arrivals_are_among_all_duplicates(spark):
    arrived, found = ({tuple(r) for r in llm.queries()[n](spark, DATA).collect()} for n in ("p4_arrivals", "p4_found"))
    assert {i for _, i in arrived} <= {i for _, i in found}
