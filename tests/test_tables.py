from __future__ import annotations

import pytest
from fixtures import mixed

from purchase_insights.plans.reports import report
from purchase_insights.sources import tables
from purchase_insights.sources.tables import database_url, jdbc_options


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("postgres://u:p@h/db", "postgresql://u:p@h/db"),
        ("postgresql://u:p@h/db", "postgresql://u:p@h/db"),
        ("postgres://u:p@h/db?x=postgres://y", "postgresql://u:p@h/db?x=postgres://y"),
        ("postgres://h/db?sslmode=require&channel_binding=require", "postgresql://h/db?sslmode=require"),
        ("postgres://h/db?channel_binding=require&sslmode=require", "postgresql://h/db?sslmode=require"),
        ("postgres://h/db?channel_binding=require", "postgresql://h/db"),
        ("postgres://h/db?channel_binding=prefer", "postgresql://h/db?channel_binding=prefer"),
        ("postgres://h/db?a=1&channel_binding=require&b=%20", "postgresql://h/db?a=1&b=%20"),
    ],
)
def test_database_url(given, expected):
    assert database_url({"DATABASE_URL": given}) == expected


@pytest.mark.parametrize("environment", [{}, {"DATABASE_URL": ""}])
def test_database_url_is_required(environment):
    with pytest.raises(EnvironmentError, match="DATABASE_URL"):
        database_url(environment)


def test_database_url_comes_from_the_environment(monkeypatch):
    monkeypatch.setenv("DATABASE_URL", "postgres://h/db")
    assert database_url() == "postgresql://h/db"


def test_jdbc_options():
    url = database_url({"DATABASE_URL": "postgres://ann:p%40ss@host:6543/shop?channel_binding=require&fetchsize=500"})
    assert jdbc_options(url) == {
        "url": "jdbc:postgresql://host:6543/shop",
        "driver": "org.postgresql.Driver",
        "user": "ann",
        "password": "p@ss",
        "sslmode": "require",
        "connectTimeout": "10",
        "fetchsize": "500",
    }
    plain = jdbc_options("postgresql://host/db")
    assert (plain["url"], plain["fetchsize"]) == ("jdbc:postgresql://host/db", "10000")


class RecordingReader:
    """Stands in for ``spark.read``: no database is started for the tests."""

    def __init__(self, loads, settings=None, bounds=(1, 100)):
        self.loads, self.settings, self.bounds = loads, settings or {}, bounds

    def _with(self, **settings):
        return RecordingReader(self.loads, {**self.settings, **settings}, self.bounds)

    def format(self, name):
        return self._with(format=name)

    def option(self, name, value):
        return self._with(**{name: value})

    def options(self, **settings):
        return self._with(**settings)

    def load(self):
        self.loads.append(self.settings)
        return self

    def first(self):
        return self.bounds


class RecordingSession:
    def __init__(self, **reader):
        self.loads = []
        self.read = RecordingReader(self.loads, **reader)


def test_database_table_is_read_in_ranges():
    session = RecordingSession()
    tables.read_database_table(session, {"url": "jdbc:x"}, "customer", partitions=16)
    asked, read = session.loads
    assert asked["query"] == "SELECT MIN(customer_id) AS low, MAX(customer_id) AS high FROM customer"
    assert "dbtable" not in asked
    assert read == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "customer", "partitionColumn": "customer_id",
        "lowerBound": "1", "upperBound": "100", "numPartitions": "16",
    }


def test_given_bounds_are_used_and_an_empty_table_is_read_whole():
    session = RecordingSession()
    tables.read_database_table(session, {}, "customer", bounds=(5, 9))
    assert [(s["lowerBound"], s["upperBound"]) for s in session.loads] == [("5", "9")]
    empty = RecordingSession(bounds=(None, None))
    tables.read_database_table(empty, {}, "customer")
    assert "partitionColumn" not in empty.loads[-1]


def test_database_query_is_pushed_down():
    session = RecordingSession()
    tables.run_database_query(session, {"url": "jdbc:x"}, " SELECT 1;\n")
    assert session.loads == [{"format": "jdbc", "url": "jdbc:x", "query": "SELECT 1"}]


def test_queries_over_the_view(spark):
    df = mixed(spark)
    tables.register_view(df)
    assert tables.read_table(spark).columns == df.columns
    assert tables.read_table(spark).count() == 400
    found = tables.run_query(
        spark,
        """
        SELECT season, COUNT(*) AS transactions, CAST(SUM(purchase_amount) AS DOUBLE) AS total_revenue,
               CAST(SUM(purchase_amount) AS DOUBLE) / COUNT(purchase_amount) AS average_purchase
        FROM purchases GROUP BY season ORDER BY total_revenue DESC NULLS FIRST, season;
        """,
    )
    assert found.collect() == report(df, "season").collect()


def test_catalog_table(spark):
    mixed(spark).write.mode("overwrite").saveAsTable("stored_purchases")
    assert tables.read_table(spark, "stored_purchases").count() == 400
    spark.sql("DROP TABLE stored_purchases")
