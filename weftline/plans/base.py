"""How a query and its SQL are registered."""

from __future__ import annotations

from weftline.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a data folder by name: ``t.documents``."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return read_table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
