"""Every catalogue query against its SQL on whole tables."""

import pytest
from conftest import SF
from oracle import difference, expected

from corpuscope.plans import rules, runs  # noqa: F401
from corpuscope.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, expected(SQL[name], SF)) is None


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blank_abstracts_of_odd_texts(spark, tmp_path):
    import duckdb

    texts = [None, "", "*", "**", "*" * 2000, " ", "\n", "* ", "*\n*", "*\n# Next", "-", "- -", "-*", "```x```", "```*```", "# Abstract", "\nabstract", "*abstract", "　", " *", "\x1c", "\\", "$1", "a", "*a", "***\n" + "word " * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {texts[r.doc_id]: r.is_blank for r in QUERIES["abstract_extract"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {texts[i]: blank for i, blank in db.sql(SQL["abstract_extract"]).fetchall()}
    assert {t for t, blank in got.items() if blank} == {"", "*", "**", "*" * 2000} and got[None] is None
