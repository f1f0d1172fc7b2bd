"""Searches and reads written in SQL, by table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as B
from .registry import ORACLES, Tables, query
from .text_queries import passage_index, questions


@query("r03_search_in_sql", ORACLES["r03_search_prose"])
def _(t: Tables) -> DataFrame:
    """As r03_search_prose: all questions' queries are asked at once by a lateral call."""
    B.register_search(t.spark, passage_index(t), ["doc_id", "chunk"], "bm25_passages")
    questions(t).createOrReplaceTempView("bm25_questions")
    return t.spark.sql("""
        WITH hits AS (SELECT q.question_id, h.doc_id, h.chunk, h.score FROM bm25_questions AS q, LATERAL bm25_passages(q.query, 3) AS h),
        best AS (SELECT question_id, doc_id, chunk, max(score) AS score FROM hits GROUP BY question_id, doc_id, chunk),
        ranked AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk) AS rank, doc_id, chunk, score FROM best)
        SELECT * FROM ranked WHERE rank <= 3
    """)


@query("r08_read_in_sql", ORACLES["r08_read"])
def _(t: Tables) -> DataFrame:
    pages = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text")
    B.register_read(t.spark, pages, "read_document")
    t.documents.select("doc_id").createOrReplaceTempView("read_requests")
    return t.spark.sql("""
        SELECT CAST(q.doc_id AS STRING) AS document_id, CAST(r.`from` AS BIGINT) AS `from`, CAST(r.`to` AS BIGINT) AS `to`, r.next_start IS NOT NULL AS has_more, md5(r.text) AS text_md5
        FROM read_requests AS q, LATERAL read_document(CAST(q.doc_id AS STRING), -1, CAST(q.doc_id * 7 AS INT)) AS r
    """)
