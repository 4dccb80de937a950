import pytest

from relcast.plans import register
from tests import twins


@pytest.fixture(scope="module")
def db(sf_dir):
    return twins.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(register.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf_dir, db, name):
    assert twins.rows_of(register.QUERIES[name](spark, sf_dir)) == twins.twin_rows(db, register.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - set(register.ORACLE_SQL)))
def test_query_without_twin_has_rows(spark, sf_dir, name):
    assert register.QUERIES[name](spark, sf_dir).count() > 0


def test_blake3_ids_are_of_whole_documents(spark, sf_dir):
    from relcast.functions.blake3 import blake3_hex

    got = {r.doc_id: r.stable_id for r in register.QUERIES["stable_id_blake3"](spark, sf_dir).collect()}
    whole = {r.doc_id: r.canonical for r in register.QUERIES["canonical_payload"](spark, sf_dir).collect()}
    assert any(len(c) > 4 * 1024 for c in whole.values())
    assert got == {i: None if c is None else "afid:v1:" + blake3_hex(c.encode()) for i, c in whole.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_plan_reads_few_columns_and_stays_in_the_jvm(spark, sf_dir):
    plan = register.release_diff(spark, sf_dir)._jdf.queryExecution().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1]
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
