"""Query registry: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; shared table expressions the SQL names are put in front of it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def query_like(name: str, other: str):
    """Register ``fn`` under the SQL of another query, whose rows it gives in another way."""

    def register(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[other]
        return fn

    return register


def with_ctes(sql: str) -> str:
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql.strip()
    heads = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def seq_text(column: str = "seq") -> Column:
    """``day@token|day@token...`` so that a sequence compares as one value."""
    return F.concat_ws(
        "|", F.transform(column, lambda x: F.concat(x["day"].cast("string"), F.lit("@"), x["token"]))
    )


def list_text(column: str | Column, separator: str = ",") -> Column:
    return F.concat_ws(separator, F.transform(column, lambda x: x.cast("string")))


def time_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")
