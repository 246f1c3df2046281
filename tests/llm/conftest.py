import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and a column with a clashing name."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one two three four five six", "en", "a"), (4, "one two three four five six", "en", "a"), (5, "word " * 20000, "de", "b"), (6, "x" * 50000, None, "b"), (7, "é ü 日本 <|endoftext|> 12's", "fr", "c"), (None, "no number at all", "en", "a")]
    return spark.createDataFrame([(*r, 1, "id") for r in rows], "doc_id long, text string, lang string, source string, n long, id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compares a query with its SQL on the smallest tables."""

    def check(module, name):
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.sql(module.ORACLE_SQL[name]).df()
        got = module.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        plain = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert plain(got) == plain(want)

    return check
