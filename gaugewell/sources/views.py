"""Views over the stored tables for the analyzers: values are made missing by rule, as no table has any NULL.

Each is one SELECT that Spark and other SQL engines read alike; tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gaugewell.sources.tables import table

VIEWS = {
    "m_orders": """SELECT o_orderkey AS rid,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS totalprice,
  CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 11 = 0 THEN NULL ELSE o_orderdate END AS orderdate,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS orderstatus,
  CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_orderpriority END AS orderpriority
FROM {orders}""",
    "m_lineitem": """SELECT
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 7 = 0 OR l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS extendedprice,
  CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN NULL ELSE l_discount END AS discount,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS returnflag,
  l_linestatus AS linestatus,
  CAST(NULL AS DOUBLE) AS always_null
FROM {lineitem}""",
    "m_nan": """SELECT c_custkey AS rid,
  CASE WHEN c_custkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 5 = 1 THEN NULL ELSE c_acctbal END AS acctbal,
  c_mktsegment AS mktsegment
FROM {customer}""",
    "m_documents": """SELECT d.doc_id AS rid, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "dup_lineitem": """SELECT l_quantity, l_discount, l_tax, l_returnflag,
  CASE WHEN l_orderkey % 10 < 8 THEN 'train' ELSE 'test' END AS split, l_linestatus AS label
FROM {lineitem}""",
    "dup_documents": """SELECT doc_id, text, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, source AS label
FROM {documents}""",
    "near_part": """SELECT p_partkey, p_size, p_retailprice, p_brand, p_type,
  CASE WHEN p_partkey % 10 < 8 THEN 'train' ELSE 'test' END AS split
FROM {part}""",
    "near_customer": """SELECT c_custkey, c_acctbal, CAST(c_nationkey AS VARCHAR(9)) AS nation, c_mktsegment FROM {customer}""",
    "near_supplier": """SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS VARCHAR(9)) AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS label FROM {supplier}""",
    "train_customers": "SELECT c_nationkey, c_mktsegment FROM {customer} WHERE c_custkey % 10 < 8",
    "test_customers": "SELECT c_mktsegment, c_nationkey FROM {customer} WHERE c_custkey % 10 >= 8",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in re.findall(r"\{(\w+)\}", sql)})


def view_sql(name: str) -> str:
    """The view over tables of those names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
