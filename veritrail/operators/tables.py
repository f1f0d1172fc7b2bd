"""Search and reading from SQL: table functions over a written index and over pages.

They are SQL functions whose bodies Spark inlines, so they need no Python and are planned with what is around them. A call may be correlated, as in
``SELECT * FROM questions q, LATERAL bm25(q.text, 3)``: Spark then asks all distinct texts at once, by joins and one ranking per text.
A null or empty text finds nothing; a k of null or below 1 gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from .index import Index
from .retrieval import K1, B

NAME = r"[A-Za-z_]\w*"

#: Items of a written index whose scores for all queries of a call a task holds at once.
ITEMS_HELD = 1024


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _define(spark: SparkSession, name: str, arguments: str, returned: list[Ty.StructField], body: str) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returned)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def register_search(spark: SparkSession, ix: Index, keys: list[str], name: str = "bm25") -> None:
    """name(query, k): rank, the item keys and score (five places) of the k best items of an index, as ``retrieval.ranked`` has them.

    Items are dealt to parts, and what is shuffled are their postings, once (of a written index, its blocks by ranges of items). The weights of a call's
    distinct queries are broadcast; a part sums the scores of its items and passes on the k best of each query, so pairs of queries and items are
    never shuffled. The views {name}_blocks, {name}_df and {name}_totals belong to the function.
    """
    if ix.blocks is not None:
        parts = -(-max(ix.totals.first()["n"], 1) // ITEMS_HELD)
        hits = ix.blocks.select(F.pmod(F.xxhash64("segment", "range"), F.lit(parts)).alias("_p"), "term", "hits").repartition(parts, "_p")
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hits = ix.postings.withColumn("_p", F.pmod(F.xxhash64(*keys), F.lit(parts))).repartition(parts, "_p")
    for part, frame in (("blocks", hits), ("df", ix.df), ("totals", ix.totals)):
        frame.createOrReplaceTempView(f"{name}_{part}")
    of = lambda c: f"h.`{c}`" if ix.blocks is not None else f"b.`{c}`"
    opened = " LATERAL VIEW explode(b.hits) AS h" if ix.blocks is not None else ""
    order = ", ".join(f"_k{i}" for i, _ in enumerate(keys))  # under names that clash with no argument
    terms = f"SELECT term, count(*) AS times FROM (SELECT lower(t) AS term FROM explode(regexp_extract_all(coalesce(query, ''), {_literal(T.TOKEN)}, 1)) AS e(t)) GROUP BY term"
    weights = f"SELECT term, times * ln((n - df + 0.5D) / (df + 0.5D) + 1.0D) AS weight, greatest(avgdl, 1.0D) AS avgdl FROM ({terms}) JOIN {name}_df USING (term) CROSS JOIN {name}_totals"
    part = f"w.weight * ({of('tf')} * {K1 + 1}D / ({of('tf')} + {K1}D * ({1 - B}D + {B}D * (greatest({of('dl')}, 1) / w.avgdl))))"
    items = ", ".join(f"{of(k)} AS _k{i}" for i, k in enumerate(keys))
    found = f"SELECT /*+ BROADCAST(w) */ b._p, {items}, {part} AS _part FROM ({weights}) AS w JOIN {name}_blocks AS b ON w.term = b.term{opened}"
    scored = f"SELECT _p, {order}, round(sum(_part), 9) AS score FROM ({found}) GROUP BY _p, {order}"
    some = f"SELECT row_number() OVER (PARTITION BY _p ORDER BY score DESC, {order}) AS _n, {order}, score FROM ({scored}) WHERE score > 0"
    ranked = f"SELECT row_number() OVER (ORDER BY score DESC, {order}) AS rank, {order}, score FROM ({some}) WHERE _n <= k"
    whole = ix.items.schema
    returned = [Ty.StructField("rank", Ty.IntegerType()), *(whole[k] for k in keys), Ty.StructField("score", Ty.DoubleType())]
    _define(spark, name, "query STRING, k INT", returned, f"SELECT rank, {order}, round(score, 5) FROM ({ranked}) WHERE rank <= k")


def register_read(spark: SparkSession, pages: DataFrame, name: str = "read_page") -> None:
    """name(document, number, start_at): from, to, text and next_start (null at the end) of a page, at most 2400 characters; no row for an unknown page.

    A number below 1 is the document's first page. pages: document_id, page, text.
    """
    firsts = pages.groupBy("document_id").agg(F.min("page").alias("page"))
    known = pages.where("text IS NOT NULL").select("document_id", "page", "text")
    # First pages are there once more under the number 0, so a call is one equality of keys.
    asked = known.where("page >= 1").select("*", F.col("page").cast("long").alias("asked"))
    asked.unionByName(known.join(firsts, ["document_id", "page"]).select("document_id", "page", "text", F.lit(0).cast("long").alias("asked"))).createOrReplaceTempView(f"{name}_pages")
    field = Ty.StructField
    kept = pages.schema
    document = kept["document_id"].dataType.simpleString()
    # The arguments become a row of their own, joined by columns: a condition that names them beside the pages would have Spark pair every request with every page.
    call = "SELECT document AS _document, CAST(greatest(number, 0) AS BIGINT) AS _number, greatest(0, coalesce(start_at, 0)) AS _start"
    found = f"SELECT p.page, p.text, least(length(p.text), c._start) AS low FROM ({call}) AS c JOIN {name}_pages AS p ON p.document_id = c._document AND p.asked = c._number"
    high = f"least(length(text), low + {T.READ_LIMIT})"
    returned = [kept["page"], field("from", Ty.IntegerType()), field("to", Ty.IntegerType()), field("text", Ty.StringType()), field("next_start", Ty.IntegerType())]
    body = f"SELECT page, low, {high}, substring(text, low + 1, {T.READ_LIMIT}), CASE WHEN low + {T.READ_LIMIT} < length(text) THEN low + {T.READ_LIMIT} END FROM ({found})"
    _define(spark, name, f"document {document}, number INT, start_at INT", returned, body)
