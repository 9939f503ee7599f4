"""Named queries and the SQL each is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korridor.roles import SQL as ROLES
from korridor.roles import Roles, with_roles

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Roles; ``sql`` is DuckDB over role views and tables."""

    def put(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Roles(spark, sf_dir))
        if sql:
            ORACLES[name] = with_roles(sql)
        return build

    return put


def portable(name: str, sql: str) -> None:
    """Register SQL that means the same in both engines; role names in it are bound to role frames."""

    names = r"(?<=FROM |JOIN )(" + "|".join([*ROLES, *TABLES]) + r")\b"

    def build(roles: Roles) -> DataFrame:
        frames = {n: getattr(roles, n) if n in ROLES else roles.table(n) for n in re.findall(names, sql)}
        return roles.spark.sql(re.sub(names, r"{\1}", sql), **frames)

    query(name, sql)(build)
