"""Domain views over the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KEY = "l_orderkey, l_linenumber, l_partkey, l_shipdate"
_KEY_DESC = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_shipdate DESC"

VIEWS: dict[str, str] = {
    "bars": f"""
SELECT ticker, d, max(CASE WHEN rf = 1 THEN p END) AS open, max(p) AS high, min(p) AS low, max(CASE WHEN rl = 1 THEN p END) AS close, sum(q) AS volume
FROM (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p, l_quantity AS q,
             row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY {_KEY}) AS rf,
             row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY {_KEY_DESC}) AS rl
      FROM lineitem) x
GROUP BY ticker, d""",
    "signals": """
SELECT user_id AS ticker, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'OVERWEIGHT' WHEN 'view' THEN 'HOLD' WHEN 'signup' THEN 'UNDERWEIGHT' WHEN 'error' THEN 'SELL' ELSE 'ERROR' END AS signal,
       CAST(50 + event_id * 37 % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
       CAST(event_id * 7919 % 401 - 200 AS DOUBLE) / CAST(10000 AS DOUBLE) AS actual_return
FROM events""",
    "statements": """
SELECT c_nationkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus AS item,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS value, min(o_orderkey) AS k
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE), o_orderstatus""",
    "insider": """
SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS transaction_date,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate + INTERVAL 5 DAY AS DATE) END AS filing_date, CAST(l_quantity AS BIGINT) AS shares
FROM lineitem""",
    "entities": """
SELECT concat('c', c_custkey) AS id, c_name AS name, 'customer' AS type FROM customer
UNION ALL SELECT concat('o', o_orderkey), concat('order ', o_orderkey), 'order' FROM orders
UNION ALL SELECT concat('n', n_nationkey), n_name, 'nation' FROM nation""",
    "triples": """
SELECT concat('c', o_custkey) AS subject, 'ordered' AS predicate, concat('o', o_orderkey) AS object, CAST(o_orderdate AS DATE) AS valid_from,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate + INTERVAL 90 DAY AS DATE) END AS valid_to FROM orders
UNION ALL SELECT concat('c', c_custkey), 'located_in', concat('n', c_nationkey), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM customer""",
    "posts": """
SELECT d.doc_id AS id, d.text, d.source, CAST(d.n_chars % 97 AS BIGINT) AS score, CAST(doc_id * 13 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf, d.doc_id * 3600 + 1704067200 AS epoch,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "samples": """
SELECT d.doc_id AS sample_id, d.text, d.source AS document_type, d.lang, l.quality - l.toxic AS task_label,
       CAST(DATE '2015-01-01' + CAST(d.doc_id % 3000 AS INT) * INTERVAL 1 DAY AS DATE) AS event_date,
       CAST(DATE '2015-01-01' + CAST(d.doc_id % 3000 + d.doc_id % 5 - 1 AS INT) * INTERVAL 1 DAY AS DATE) AS available_date
FROM documents d JOIN labels l USING (doc_id)""",
}
NEEDS = {"bars": ["lineitem"], "signals": ["events"], "statements": ["orders", "customer"], "insider": ["lineitem"], "entities": ["customer", "orders", "nation"],
         "triples": ["orders", "customer"], "posts": ["documents", "labels"], "samples": ["documents", "labels"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view; its source tables are bound by name, so no global temporary state is left behind."""
    tables = {t: table(spark, sf_dir, t) for t in NEEDS[name]}
    text = VIEWS[name]
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} {t}" if not re.search(rf"\b(?:FROM|JOIN) {t} [a-z]\b", text) else rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def oracle(views: list[str], body: str) -> str:
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"
