"""The parts of operators that SQL can tell against their SQL, on the smoke tables and on odd rows."""

import duckdb
import pytest

from ledgerloom.llm import oracles, queries

from ..conftest import SF001

PARTS = ("base_secrets", "base_pii", "url_rules", "source_targets")
ODD = [None, "", "AKIA" + "A" * 12, "x@y.z@a.b", "é api_key='abcdefgh' Token: short", "0" * 40 + "1.2.3.4.5.6.7.8 256.1.1.1", "+1 (555) 010-9999 4111 1111 1111 1111", "f" * 31 + " " + "f" * 32 + "\n" + "a" * 70]


def same(spark, tmp_path, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    queries.queries()[name](spark, str(folder)).write.parquet(str(tmp_path / "out"))
    expected = duck.execute(queries.oracle_sql()[name]).df()
    got = duck.execute(f"select * from '{tmp_path}/out/*.parquet'").df()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", PARTS)
def test_parts_match_sql(spark, tmp_path, name):
    same(spark, tmp_path, SF001, name)


@pytest.mark.parametrize("name", PARTS)
def test_odd_rows_match_sql(spark, tmp_path, name):
    folder = tmp_path / "in"
    folder.mkdir()
    docs = [(i, x, "en", "s" if i % 2 else None, 0) for i, x in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").toPandas().to_parquet(folder / "documents.parquet")
    urls = [None, "", "example.org/es/", "http://Example.ORG/es/a?b#c", "https://a.example.org/en/12", "x://com/fr/", "x://b.com/de/?q", "http://notexample.org/", "http://é.org/#"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").toPandas().to_parquet(folder / "pages.parquet")
    same(spark, tmp_path, folder, name)


def test_sql_of_base_kinds_can_be_read():
    for sql in (oracles.SECRETS_BASE, oracles.PII_BASE, oracles.URL_RULES, oracles.SOURCE_TARGETS):
        assert duckdb.extract_statements(sql)
