"""One query for each operator id, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The citation relation derived from the star schema; ``ord`` is the source order, a total one.
CIT = """
cit AS (
  SELECT l_orderkey AS iid, l_linenumber AS seq, n_name AS journal, CAST(year(o_orderdate) AS VARCHAR) AS year, p_brand AS work,
    CAST(100 + (l_partkey % 60) AS INT) AS page, chr(97 + CAST(l_linenumber % 5 AS INT)) AS section, CAST(l_quantity AS INT) AS line,
    p_type AS doctype, round(1 - 6 * l_discount, 3) AS conf, l_returnflag AS flag, l_linestatus AS status,
    ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def query(name: str, sql: str | None = None):
    """Register a query under an operator id. ``sql`` may start from the relation ``cit``."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            head, body = ("RECURSIVE ", sql.strip().replace("WITH RECURSIVE ", "WITH ", 1)) if sql.strip().startswith("WITH RECURSIVE ") else ("", sql.strip())
            ORACLES[name] = f"WITH {head}{CIT}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)
        return f

    return keep
