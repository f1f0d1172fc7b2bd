"""Queries over files that Spark writes from the driver's tables, and over indexes of them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quotes as Q
from ..operators import retrieval as R
from ..operators import trigrams as G
from ..sources import jsonl, verdicts
from ..sources.workspace import shared_dir
from . import text_queries  # noqa: F401  its SQL is used here
from .registry import ORACLES, Tables, query


@query("s06_jsonl_lineage", """
WITH o AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations)
SELECT place, CASE WHEN bad THEN 'invalid_json' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN conv_id END AS conv_id, CASE WHEN NOT bad THEN turn END AS turn, CASE WHEN NOT bad THEN md5(text) END AS text_md5
FROM (SELECT *, (conv_id + turn) % 11 = 3 AS bad FROM o)
""")
def _(t: Tables) -> DataFrame:
    """The conversations as JSON lines in several files, one line in eleven broken, read back: each line's number over all files is its place in the order."""
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 11 == 3, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    path = f"{shared_dir(t.spark)}/jsonl-{uuid.uuid4().hex}"
    t.conversations.orderBy("conv_id", "turn").select(line.alias("value")).write.text(path)
    rows = jsonl.in_sequence(jsonl.jsonl_with_lineage(t.spark, path, "conv_id long, turn long, role string, text string"))
    return rows.select("place", "status", "row.conv_id", "row.turn", F.md5("row.text").alias("text_md5"))


_pages = lambda d: d.select("doc_id", F.lit(1).alias("page"), "text")


@query("r07_grep_indexed", ORACLES["r07_grep"])
def _(t: Tables) -> DataFrame:
    """As r07_grep, over the pages that the three-character index leaves."""
    patterns, keys = ["licen[cs]ed", "token = "], ["doc_id", "page"]
    index = G.written_grams(t.documents, "documents", _pages, keys)
    some = _pages(t.documents).join(G.candidates(index, keys, patterns), keys, "left_semi")
    return R.grep(some, patterns, keys, context=1).select("doc_id", "line", "start", "end", F.md5("text").alias("text_md5"))


@query("j16_quotes_anywhere", """
WITH q AS (SELECT item_id, CAST(i AS INTEGER) AS part, substr(text, CAST(i * 60 + 1 AS BIGINT), 40) AS quote FROM (SELECT item_id, text, unnest(range(0, (length(text) + 59) // 60)) AS i FROM benchmark)),
h AS (SELECT item_id, part, doc_id, length(quote) AS n, string_split(text, quote) AS s FROM q JOIN documents ON contains(text, quote))
SELECT item_id, part, doc_id, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * n AS INTEGER) AS "offset" FROM (SELECT *, unnest(range(1, len(s))) AS i FROM h)
""")
def _(t: Tables) -> DataFrame:
    """Every place in any document where a 40-character quote of a benchmark item stands, one quote for each 60 characters of the item."""
    parts = F.sequence(F.lit(0), F.floor((F.length("text") + 59) / 60).cast("int") - 1)
    quotes = t.benchmark.where(F.length("text") > 0).select("item_id", "text", F.explode(parts).alias("part"))
    quotes = quotes.select("item_id", "part", F.substring(F.col("text"), F.col("part") * 60 + 1, F.lit(40)).alias("quote"))
    return Q.occurrences(quotes, t.documents, ["item_id", "part"], ["doc_id"])


def _judge(text: str, attempt: int) -> str:
    """A client by the first hexadecimal digit of the text's digest: refused, answering at the attempt of that number, always down, or answering at once."""
    digit = int(hashlib.sha256(text.encode()).hexdigest()[0], 16)
    if digit == 0:
        raise verdicts.Refused("no")
    if digit == 4 or (digit < 4 and attempt < digit):
        raise TimeoutError("down")
    return str(len(text))


@query("s15_asked_verdicts", """
WITH c AS (SELECT conv_id, turn, text, role, strpos('0123456789abcdef', substr(sha256(text), 1, 1)) - 1 AS h FROM conversations),
u AS (SELECT DISTINCT text FROM c WHERE role = 'user' AND h NOT IN (0, 4))
SELECT conv_id, turn, CASE WHEN h NOT IN (0, 4) THEN CAST(length(text) AS VARCHAR) END AS verdict, CAST(CASE WHEN u.text IS NOT NULL THEN 0 WHEN h IN (2, 3) THEN h WHEN h = 4 THEN 3 WHEN h IS NOT NULL THEN 1 END AS INTEGER) AS attempts, CASE h WHEN 0 THEN 'Refused: no' WHEN 4 THEN 'TimeoutError: down' END AS error
FROM c LEFT JOIN u USING (text)
""")
def _(t: Tables) -> DataFrame:
    """All turns asked over a store that has the users' turns from a run before."""
    store, turns = f"{shared_dir(t.spark)}/verdicts-{uuid.uuid4().hex}", t.conversations.select("conv_id", "turn", "role", "text")
    verdicts.ask(turns.where("role = 'user'"), "text", _judge, store, "stub", waits=(0, 0))
    return verdicts.ask(turns, "text", _judge, store, "stub", waits=(0, 0)).drop("role", "text")
