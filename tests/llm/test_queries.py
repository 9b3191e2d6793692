"""Every training-data query runs over whole small tables; those with SQL are compared with it, and sums with SQL over the rows that are summed."""

import os

import pytest

from corpusmill.llm import queries
from tests.oracle import difference, views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return views(FOLDER)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs(spark, con, name):
    found = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert difference(found, con, queries.ORACLES[name]) == ""
    assert found.count() > 0
    fixed = {"p3_found": ["source_table", "row_id", "defect"], "p4_found": ["source_table", "row_id_a", "row_id_b"], "p6_found": ["doc_id", "item_id"], "p7_found": ["doc_id"]}
    assert found.columns == fixed.get(name, found.columns)


SUMS = {
    "p1_token_budget": (
        "p1_document_tokens",
        """select table_name, slice, lang, domain, count(*) as n_records, count(*) filter (n_tokens > 0) as n_with_text, sum(n_tokens)::bigint as n_tokens from {rows} group by all""",
    ),
    "p2_shares": (
        "p2_selection",
        """select phase, name, sum(n_tokens * uses)::bigint as size_used, count(*) as records_used, sum(uses)::bigint as uses, max(uses) as most_uses,
             sum(n_tokens * uses) / sum(sum(n_tokens * uses)) over (partition by phase) as actual_share from {rows} group by phase, name""",
    ),
    "p7_source_rates": (
        "p7_scores",
        """select source, count(*) as n_documents, count(*) filter (score >= 0.5) as n_flagged, count(*) filter (score >= 0.5) / count(*) as rate,
             count(*) filter (score >= 0.5 and category = 'abusive') as n_abusive from {rows} group by source""",
    ),
}


@pytest.mark.parametrize("name", SUMS)
def test_sums(spark, con, name):
    rows, sql = SUMS[name]
    frame = queries.QUERIES[rows](spark, FOLDER).toPandas()  # noqa: F841
    con.register(f"rows_of_{name}", frame)
    sql = sql.format(rows=f"rows_of_{name}")
    columns = con.sql(sql).columns
    summed = queries.QUERIES[name](spark, FOLDER)
    if name == "p2_shares":
        summed = summed.where("records_used > 0")
    assert difference(summed.select(*columns), con, sql) == ""
