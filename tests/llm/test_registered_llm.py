import pytest

import oracle
from jsonloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    ok, message = oracle.compare(spark, db, SF, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, db, name):
    rows = QUERIES[name](spark, SF)
    key = "conv_id" if name.startswith("op9") else "doc_id"
    table = "conversations" if key == "conv_id" else "documents"
    ids = {r[0] for r in rows.select(key).collect()}
    want = {r[0] for r in db.execute(f"SELECT DISTINCT {key} FROM {table}").fetchall()}
    assert ids == want | ({-7} if key == "conv_id" else set())
