"""Names, queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if there is one."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


# SQL fragments shared by the oracles ---------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def decode_sql(expr: str) -> str:
    return f"""replace(replace({expr}, '&quot;', '"'), '&amp;', '&')"""


H1 = decode_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
ARTICLE_HTML = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
ARTICLE = decode_sql(f"regexp_replace({ARTICLE_HTML}, '<[^>]*>', '', 'g')")

# 1..6-gram counts of a CTE t(doc_id, w VARCHAR[])
GRAMS = """
  k AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM t),
  l AS (SELECT doc_id, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4,
          lead(w1, 4) OVER o AS w5, lead(w1, 5) OVER o AS w6 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  g AS (SELECT doc_id, 1 AS n, w1 AS gram FROM l
        UNION ALL SELECT doc_id, 2, w1 || ' ' || w2 FROM l WHERE w2 IS NOT NULL
        UNION ALL SELECT doc_id, 3, w1 || ' ' || w2 || ' ' || w3 FROM l WHERE w3 IS NOT NULL
        UNION ALL SELECT doc_id, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM l WHERE w4 IS NOT NULL
        UNION ALL SELECT doc_id, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM l WHERE w5 IS NOT NULL
        UNION ALL SELECT doc_id, 6, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 || ' ' || w6 FROM l WHERE w6 IS NOT NULL),
  c AS (SELECT doc_id, n, gram, count(*) AS tf FROM g GROUP BY ALL)
"""
