"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The views of ``quern.sources.views`` in SQL.
VIEWS = {
    "m": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'inbox' WHEN 'F' THEN 'archive' ELSE 'work' END AS folder,
        o_custkey AS thread_key, c_name AS from_name, lower(c_name) || '@example.com' AS from_address, o_orderdate AS date,
        o_orderpriority <> '4-NOT SPECIFIED' AS seen, o_orderpriority = '1-URGENT' AS flagged, o_orderpriority = '5-LOW' AS answered,
        o_totalprice AS amount, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey""",
    "a": """SELECT l_orderkey AS message_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS index,
        'part' || l_partkey || '.' || ['pdf','docx','xlsx','png','zip','txt','jpeg'][l_partkey % 7 + 1] AS filename,
        CAST(l_quantity * 65536 + l_partkey AS BIGINT) AS size, l_returnflag = 'R' AS inline FROM lineitem""",
    "d": """SELECT d.doc_id AS id, source AS folder, split_part(text, chr(10), 1) AS subject, source AS from_name, lower(lang || '@example.com') AS from_address,
        text, coalesce(quality = 1, false) AS seen, coalesce(toxic = 1, false) AS flagged, d.doc_id AS seq FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "c": """SELECT conv_id * 1000 + turn AS stream_id, '⟦' || coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || '⟧' || chr(10) || text AS whole, role
        FROM conversations""",
}


def query(name: str | None = None, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the letters of VIEWS that its SQL uses."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            used = [f"{v} AS ({VIEWS[v]})" for v in views]
            SQL[key] = (f"WITH {', '.join(used)} " if used else "") + sql
        return fn

    return add
