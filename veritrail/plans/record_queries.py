"""Joins, scores, traces, curation and reports over events, orders, lineitem, conversations and labels.

Events stand in for recorded traces: user_id is the trace, event_type the tool, event_id the order. Components of scores are derived from ids,
so that both engines have the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import curation as U
from ..operators import evidence as E
from ..operators import groups as G
from ..operators import reporting as P
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import traces as V
from ..streaming import episodes
from .registry import Tables, query

# Tools by event type, for traces made of events.
TOOLS = {"view": "bm25_search", "click": "read", "search": "grep_document", "purchase": "finish", "error": "search_tables", "login": "calculate", "logout": "finish", "signup": "read_table"}
TOOL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOLS.items()) + " ELSE 'read' END"
CALLS_SQL = f"calls AS (SELECT user_id, event_id, {TOOL_SQL} AS name, props FROM events)"


def _tool() -> Column:
    out = F.when(F.lit(False), "")
    for k, v in TOOLS.items():
        out = out.when(F.col("event_type") == k, v)
    return out.otherwise("read")


def calls(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", _tool().alias("name"), "props")


def repeated(t: Tables) -> DataFrame:
    return V.repeated_calls(calls(t), "user_id", ["event_id"], arguments="props")


REPEATED_SQL = f"{CALLS_SQL}, rep AS (SELECT *, row_number() OVER (PARTITION BY user_id, name, props ORDER BY event_id) > 1 AS repeated FROM calls)"

# Evaluation rows: one per event; the run is its type, the question its user.
EVAL_SQL = """
ev AS (SELECT *, CAST(F = 1 AND A = 1 AND NOT unresolved AS INTEGER) AS correct, CAST(F = 1 AND A = 1 AND NOT unresolved AND G = 1 AS INTEGER) AS grounded_success FROM (
  SELECT event_id, event_type AS run_id, user_id AS question_id, CAST(event_id % 7 <> 0 AS INTEGER) AS F, (event_id % 5) / 4.0 AS A, (event_id % 3) / 2.0 AS G, event_id % 11 = 0 AS unresolved,
    CASE WHEN event_id % 7 <> 0 THEN 'accepted_finish' WHEN event_id % 2 = 0 THEN 'turn_limit' ELSE 'infrastructure' END AS stop_reason, CAST(event_id % 100 AS BIGINT) AS output_tokens,
    CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 9 AS BIGINT) END AS tool_calls, value AS latency_s, event_id % 4 AS citation_count, event_id % 2 AS visible_citations, event_id % 8 AS turns FROM events))
"""


def evaluations(t: Tables) -> DataFrame:
    i = F.col("event_id")
    e = t.events.select(
        "event_id", F.col("event_type").alias("run_id"), F.col("user_id").alias("question_id"), (i % 7 != 0).cast("int").alias("F"), (i % 5 / 4).alias("A"), (i % 3 / 2).alias("G"), (i % 11 == 0).alias("unresolved"),
        F.when(i % 7 != 0, "accepted_finish").when(i % 2 == 0, "turn_limit").otherwise("infrastructure").alias("stop_reason"), (i % 100).alias("output_tokens"), F.when((F.col("event_type") == "click") & (i % 13 == 0), None).otherwise(i % 9).alias("tool_calls"),
        F.col("value").alias("latency_s"), F.lit(None).cast("double").alias("cost_usd"), (i % 4).alias("citation_count"), F.least(i % 2, i % 4).alias("visible_citations"), (i % 8).alias("turns"), (i % 6 == 0).alias("gold_page_read"), (i % 3).alias("truncated"),
        F.array(i % 50, i % 70).alias("visible_chars"), F.lit(0).alias("sampling_seed"), F.lit("s").alias("evaluation_signature"),
    )
    right = (F.col("F") == 1) & (F.col("A") == 1) & ~F.col("unresolved")
    return e.withColumn("correct", right.cast("int")).withColumn("grounded_success", (right & (F.col("G") == 1)).cast("int"))


@query("j10_question_target", "SELECT doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS target_missing FROM documents LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return E.with_target(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "target_missing")


@query("j11_paired_conditions", """
SELECT coalesce(a.k, b.k) AS user_id, a.n AS n_a, b.n AS n_b, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS pair_status
FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE value > 15 AND event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE value > 15 AND event_type = 'view' GROUP BY 1) b ON a.k = b.k
""")
def _(t: Tables) -> DataFrame:
    side = lambda kind, n: t.events.where((F.col("value") > 15) & (F.col("event_type") == kind)).groupBy("user_id").agg(F.count("*").alias(n))
    return E.paired(side("click", "n_a"), side("view", "n_b"), ["user_id"])


@query("j12_guarded_review", "SELECT o_orderkey, o_totalprice > 200000 AS high, CASE WHEN l.l_orderkey IS NOT NULL THEN CASE WHEN o_orderstatus = l.s THEN 'same' ELSE 'differs' END ELSE 'alone' END AS guard FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def _(t: Tables) -> DataFrame:
    second = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return E.guarded(t.orders, second, "o_orderkey", "o_orderstatus").select("o_orderkey", (F.col("o_totalprice") > 200000).alias("high"), F.when(F.col("guard_ok"), "same").when(~F.col("guard_ok"), "differs").otherwise("alone").alias("guard"))


@query("j13_call_pairing", """
SELECT coalesce(c.user_id, o.user_id) AS user_id, coalesce(c.k, o.k) AS k, coalesce(c.n, 0) AS calls, coalesce(o.n, 0) AS observations,
  CASE WHEN coalesce(c.n, 0) > 1 OR coalesce(o.n, 0) > 1 THEN 'repeated' WHEN o.n IS NULL THEN 'unanswered' WHEN c.n IS NULL THEN 'orphan' ELSE 'paired' END AS pairing
FROM (SELECT user_id, props AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL) c FULL JOIN (SELECT user_id, props AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) o ON c.user_id = o.user_id AND c.k = o.k
""")
def _(t: Tables) -> DataFrame:
    side = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", F.col("props").alias("k"))
    return E.call_pairs(side("click"), side("view"), ["user_id", "k"])


CITED_SQL = """
rc AS (SELECT user_id AS episode_id, event_id AS k, 'r' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS receipt_id, CAST(event_id % 5 AS VARCHAR) AS document_id, event_id % 3 AS page, CASE WHEN event_id % 4 = 0 THEN 'read' ELSE 'bm25_search' END AS tool,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS text, event_id AS delivered_turn FROM events WHERE event_type = 'click'),
ct AS (SELECT user_id AS episode_id, event_id, 'r' || (event_id % 20 + 1) AS receipt_id, CAST(event_id % 5 AS VARCHAR) AS document_id, event_id % 3 AS page, event_id AS turn FROM events WHERE event_type = 'view'),
cv AS (SELECT ct.episode_id, ct.event_id, coalesce(length(rc.text) > 0, false) AND coalesce(rc.delivered_turn < ct.turn, false) AS valid, rc.tool AS tool FROM ct LEFT JOIN rc USING (episode_id, receipt_id, document_id, page))
"""


def _receipts(t: Tables) -> DataFrame:
    i = F.col("event_id")
    d = t.events.where("event_type = 'click'").select(F.col("user_id").alias("episode_id"), i.alias("delivered_turn"), (i % 5).cast("string").alias("document_id"), (i % 3).alias("page"), F.when(i % 4 == 0, "read").otherwise("bm25_search").alias("tool"), F.when(i % 10 == 0, "").otherwise(F.col("props")).alias("text"))
    return E.receipts(d, "episode_id", ["delivered_turn"])


def _citations(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.where("event_type = 'view'").select(F.col("user_id").alias("episode_id"), "event_id", F.concat(F.lit("r"), (i % 20 + 1).cast("string")).alias("receipt_id"), (i % 5).cast("string").alias("document_id"), (i % 3).alias("page"), i.alias("turn"))


@query("j14_citation_receipts", f"WITH {CITED_SQL} SELECT episode_id, event_id, valid, valid AND coalesce(tool IN ('read', 'read_table', 'grep_document'), false) AS strong FROM cv")
def _(t: Tables) -> DataFrame:
    return E.cited(_citations(t), _receipts(t)).select("episode_id", "event_id", "valid", "strong")


@query("w08_receipt_numbers", f"WITH {CITED_SQL} SELECT episode_id, k AS event_id, receipt_id FROM rc")
def _(t: Tables) -> DataFrame:
    return _receipts(t).select("episode_id", F.col("delivered_turn").alias("event_id"), "receipt_id")


@query("j20_missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("j19_split_membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("j21_gold_page_read", """
SELECT g.user_id, bool_or(r.user_id IS NOT NULL) AS gold_page_read FROM (SELECT DISTINCT user_id, event_id % 40 AS d, event_id % 3 AS p FROM events WHERE event_type = 'purchase') g
LEFT JOIN (SELECT DISTINCT user_id, event_id % 40 AS d, event_id % 3 AS p FROM events WHERE event_type = 'click') r ON g.user_id = r.user_id AND g.d = r.d AND g.p = r.p GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    side = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", (F.col("event_id") % 40).alias("document_id"), (F.col("event_id") % 3).alias("page"))
    return E.page_hits(side("purchase"), side("click"), "user_id")


DIVISION_SQL = """
SELECT c.o AS l_orderkey, count(*) AS claims, count(v.o) AS covered, count(*) = count(v.o) AS all_covered FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS claim FROM lineitem) c
LEFT JOIN (SELECT DISTINCT l_orderkey AS o, l_linenumber AS claim FROM lineitem WHERE l_quantity > 10) v ON c.o = v.o AND c.claim = v.claim GROUP BY 1
"""


@query("j22_all_claims_covered", DIVISION_SQL)
def _(t: Tables) -> DataFrame:
    x = t.lineitem.withColumnRenamed("l_linenumber", "claim")
    return E.all_claims_covered(x, x.where("l_quantity > 10"), "l_orderkey")


@query("j23_claim_sets_equal", """
SELECT coalesce(a.o, b.o) AS l_orderkey, count(CASE WHEN b.o IS NULL THEN 1 END) AS missing, count(CASE WHEN a.o IS NULL THEN 1 END) AS invented, count(CASE WHEN b.o IS NULL OR a.o IS NULL THEN 1 END) = 0 AS equal
FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS c FROM lineitem WHERE l_tax < 0.06) a FULL JOIN (SELECT DISTINCT l_orderkey AS o, l_linenumber AS c FROM lineitem WHERE l_discount < 0.06) b ON a.o = b.o AND a.c = b.c GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    return E.same_sets(t.lineitem.where("l_tax < 0.06"), t.lineitem.where("l_discount < 0.06"), "l_orderkey", "l_linenumber")


@query("j24_subset", "SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda x: x NOT IN ('click', 'view', 'purchase'))) = 0 AS authentic FROM events WHERE value > 25 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = t.events.where("value > 25").groupBy("user_id").agg(F.collect_set("event_type").alias("ids"))
    return x.select("user_id", E.is_subset(F.col("ids"), F.array(*map(F.lit, ["click", "view", "purchase"]))).alias("authentic"))


@query("j26_cached_verdicts", """
SELECT conv_id, turn, coalesce(c.v, -1) AS verdict, c.k IS NOT NULL AS cache_hit FROM conversations LEFT JOIN (SELECT sha256(text) AS k, min(length(text)) AS v FROM conversations WHERE role = 'user' GROUP BY 1) c ON sha256(text) = c.k
""")
def _(t: Tables) -> DataFrame:
    keyed = t.conversations.withColumn("key", F.sha2("text", 256))
    cache = keyed.where("role = 'user'").groupBy("key").agg(F.min(F.length("text")).cast("long").alias("verdict"))
    return E.cached(keyed.select("conv_id", "turn", "key"), cache, "key").select("conv_id", "turn", F.coalesce("verdict", F.lit(-1)).alias("verdict"), "cache_hit")


@query("j27_same_order", "SELECT a.p AS position, a.k AS a_key, b.k AS b_key FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, o_orderstatus AS k FROM orders) a JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, CASE WHEN o_totalprice > 400000 THEN 'O' ELSE o_orderstatus END AS k FROM orders) b ON a.p = b.p WHERE a.k <> b.k")
def _(t: Tables) -> DataFrame:
    # order keys count from 0 without gaps
    a = t.orders.select((F.col("o_orderkey") + 1).alias("position"), F.col("o_orderstatus").alias("k"))
    b = t.orders.select((F.col("o_orderkey") + 1).alias("position"), F.when(F.col("o_totalprice") > 400000, "O").otherwise(F.col("o_orderstatus")).alias("k"))
    return E.same_order(a, b, "k", "position").select("position", "a_key", "b_key")


@query("k02_shortest_quote", "SELECT conv_id, min(struct_pack(n := length(text), q := md5(text)))['n'] AS n FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    found = t.conversations.where("role = 'user' AND text <> ''").select("conv_id", F.col("text").alias("quote"), F.lit(True).alias("found"))
    return E.shortest_quote(found, ["conv_id"]).select("conv_id", F.length("quote").cast("long").alias("n"))


# Scores.

COMPONENT_SQL = """
x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'numeric' ELSE 'semantic' END AS mode, CASE WHEN event_id % 3 <> 2 THEN (event_id % 5) / 4.0 WHEN event_id % 17 = 0 THEN 0.5 END AS N, CASE WHEN event_id % 3 <> 1 THEN (event_id % 3 + event_id % 2) / 4.0 END AS S,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 4) / 3.0 END AS G, CAST(event_id % 7 <> 0 AS INTEGER) AS F FROM events),
y AS (SELECT *, CASE WHEN G IS NULL OR (mode <> 'semantic' AND N IS NULL) OR (mode <> 'numeric' AND S IS NULL) THEN 'invalid_or_missing_component' WHEN (mode = 'semantic' AND N IS NOT NULL) OR (mode = 'numeric' AND S IS NOT NULL) THEN 'nonapplicable_component_must_be_null' END AS reason FROM x),
z AS (SELECT *, CASE WHEN reason IS NULL THEN CASE mode WHEN 'mixed' THEN 0.6 * N + 0.4 * S WHEN 'numeric' THEN N ELSE S END END AS A FROM y)
"""


@query("c02_component_score", f"WITH {COMPONENT_SQL} SELECT event_id, round(A, 6) AS A, round(F * A * (0.5 + 0.5 * G), 6) AS reward, coalesce(CAST(F = 1 AND A = 1 AS INTEGER), 0) AS correct, coalesce(CAST(F = 1 AND A = 1 AND G = 1 AS INTEGER), 0) AS grounded_success, reason IS NOT NULL AS unresolved, reason FROM z")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 3 == 0, "mixed").when(i % 3 == 1, "numeric").otherwise("semantic")
    n = F.when(i % 3 != 2, i % 5 / 4).when(i % 17 == 0, 0.5)
    s = F.when(i % 3 != 1, (i % 3 + i % 2) / 4)
    g = F.when(i % 13 != 0, i % 4 / 3)
    x = t.events.select("event_id", S.component_score(mode, n, s, g, (i % 7 != 0).cast("int")).alias("r"))
    return x.select("event_id", F.round("r.A", 6).alias("A"), F.round("r.reward", 6).alias("reward"), "r.correct", "r.grounded_success", "r.unresolved", "r.reason")


@query("c03_additive_reward", """
WITH x AS (SELECT event_id, (event_id % 3) / 2.0 AS E, (event_id % 4) / 3.0 AS G, (event_id % 5) / 4.0 AS A, CAST(event_id % 10 = 9 OR event_id % 23 = 0 AS INTEGER) AS B, CAST(event_id % 7 <> 0 AS INTEGER) AS F FROM events)
SELECT event_id, CASE WHEN B = 1 AND A <> 1 THEN NULL ELSE round(0.15 * E + F * (0.20 * G + 0.45 * A + 0.15 * B + 0.05), 6) END AS reward FROM x
""")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    reward = S.additive_reward(i % 3 / 2, i % 4 / 3, i % 5 / 4, ((i % 10 == 9) | (i % 23 == 0)).cast("int"), (i % 7 != 0).cast("int"))
    return t.events.select("event_id", F.round(reward, 6).alias("reward"))


@query("c07_grounded_reward", "SELECT event_id, round(least(1.0, greatest(0.0, value / 20 * (0.5 + 0.5 * (event_id % 3) / 2.0))), 6) AS reward FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.grounded_reward(F.col("value") / 20, F.col("event_id") % 3 / 2), 6).alias("reward"))


@query("c09_judge_merge", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN conf >= 0.85 AND v = 'contradicted' THEN 0.0 WHEN conf >= 0.85 AND v = 'entailed' THEN CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE 0.75 END ELSE d END AS quality
FROM (SELECT event_id, (event_id % 5) / 4.0 AS d, (event_id % 20) / 19.0 AS conf, CASE event_id % 3 WHEN 0 THEN 'entailed' WHEN 1 THEN 'contradicted' ELSE 'neutral' END AS v FROM events)
""")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    verdict = F.when(i % 3 == 0, "entailed").when(i % 3 == 1, "contradicted").otherwise("neutral")
    return t.events.select("event_id", S.merged_judgment(i % 5 / 4, verdict, i % 20 / 19, i % 2 == 0, i % 4 == 1, F.lit(0.75), F.when(i % 9 == 0, "numeric")).alias("quality"))


@query("a12_claim_fractions", "SELECT user_id, round(avg(CASE WHEN event_type IN ('click', 'view') THEN CAST(value > 10 AS DOUBLE) END), 6) AS N, round(avg(CASE WHEN event_type NOT IN ('click', 'view') THEN CAST(value > 10 AS DOUBLE) END), 6) AS S FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "numeric").otherwise("semantic")
    x = t.events.select("user_id", kind.alias("kind"), (F.col("value") > 10).alias("correct"))
    return S.claim_fraction(x, "user_id", "kind", "correct").select("user_id", F.round("N", 6).alias("N"), F.round("S", 6).alias("S"))


TYPED_SQL = """
WITH tg AS (SELECT o_orderkey, round(o_totalprice / 1000, 1) AS v FROM orders),
su AS (SELECT o_orderkey, o_totalprice + (o_orderkey % 3) * 200 AS v FROM orders),
sp AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS doc, l_suppkey AS page, 'q' || l_linenumber AS quote FROM lineitem WHERE l_linenumber <= 2),
rc AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS doc, l_suppkey AS page, 'has q' || CASE WHEN l_quantity > 45 THEN 9 ELSE l_linenumber END AS text, CASE WHEN l_tax < 0.07 THEN 'read' ELSE 'bm25_search' END AS tool FROM lineitem),
ci AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.095 THEN l_suppkey + 1 ELSE l_suppkey END AS page, CAST(l_partkey AS VARCHAR) AS doc FROM lineitem WHERE l_linenumber <= 3),
ok AS (SELECT ci.l_orderkey, ci.l_linenumber, rc.tool, rc.text, rc.doc, rc.page, rc.l_orderkey IS NOT NULL AS valid FROM ci LEFT JOIN rc ON ci.l_orderkey = rc.l_orderkey AND ci.l_linenumber = rc.l_linenumber AND ci.page = rc.page AND ci.doc = rc.doc),
fb AS (SELECT l_orderkey, bool_or(NOT valid) AS fab FROM ok GROUP BY 1),
rt AS (SELECT DISTINCT sp.l_orderkey FROM sp JOIN rc ON sp.l_orderkey = rc.l_orderkey AND sp.doc = rc.doc AND sp.page = rc.page AND contains(rc.text, sp.quote)),
cv AS (SELECT sp.l_orderkey, sp.quote, bool_or(ok.l_orderkey IS NOT NULL) AS c FROM sp LEFT JOIN ok ON sp.l_orderkey = ok.l_orderkey AND ok.valid AND ok.tool = 'read' AND sp.doc = ok.doc AND sp.page = ok.page AND contains(ok.text, sp.quote) GROUP BY ALL),
gr AS (SELECT l_orderkey, bool_and(c) AS g FROM cv GROUP BY 1)
SELECT o_orderkey, o_orderkey % 50 = 0 AS target_missing, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(CAST(round(CAST(su.v AS DECIMAL(18,2)) / 1000, 1) AS DECIMAL(18,1)) = CAST(tg.v AS DECIMAL(18,1)) AS DOUBLE) END AS A,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(coalesce(g, false) AND NOT coalesce(fab, false) AS DOUBLE) END AS G, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(rt.l_orderkey IS NOT NULL AS DOUBLE) END AS Ret, coalesce(fab, false) AS fabricated
FROM tg JOIN su USING (o_orderkey) LEFT JOIN fb ON fb.l_orderkey = o_orderkey LEFT JOIN rt ON rt.l_orderkey = o_orderkey LEFT JOIN gr ON gr.l_orderkey = o_orderkey
"""


@query("c01_typed_score", TYPED_SQL)
def _(t: Tables) -> DataFrame:
    key, line = F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber")
    place = [F.col("l_partkey").cast("string").alias("document_id"), F.col("l_suppkey").alias("page")]
    receipt = F.concat_ws("-", line.cast("string"), "l_partkey", "l_suppkey").alias("receipt_id")
    supports = t.lineitem.where(line <= 2).select(key, *place, F.concat(F.lit("q"), line.cast("string")).alias("quote")).withColumn("claim", F.col("quote"))
    targets = supports.groupBy("o_orderkey").agg(F.collect_list(F.struct("document_id", "page", "quote", "claim")).alias("supports"))
    targets = t.orders.where("o_orderkey % 50 <> 0").join(targets, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("question_id"), F.lit("numeric").alias("answer_type"), F.round(F.col("o_totalprice") / 1000, 1).cast("decimal(18,1)").cast("string").alias("value"), F.lit("USD").alias("unit"), F.lit("thousand").alias("scale"),
        F.lit(1).alias("precision"), F.lit(None).cast("string").alias("decision"), F.array().cast("array<string>").alias("aliases"), "supports", F.lit("resolved").alias("adjudication_status"),
    )
    said = (F.col("o_totalprice").cast("decimal(18,2)") + F.col("o_orderkey") % 3 * 200).cast("decimal(18,2)").cast("string")
    submissions = t.orders.select("o_orderkey", F.col("o_orderkey").alias("question_id"), F.lit("numeric").alias("answer_type"), said.alias("value"), F.lit("$").alias("unit"), F.lit("ones").alias("scale"), F.lit(None).cast("string").alias("decision"), F.lit("").alias("answer_text"))
    text = F.concat(F.lit("has q"), F.when(F.col("l_quantity") > 45, 9).otherwise(line).cast("string"))
    receipts = t.lineitem.select(key, receipt, *place, F.when(F.col("l_tax") < 0.07, "read").otherwise("bm25_search").alias("tool"), text.alias("text"), F.lit(0).alias("delivered_turn"))
    citations = t.lineitem.where(line <= 3).select(key, receipt, place[0], F.when(F.col("l_discount") > 0.095, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).alias("page"), F.lit(1).alias("turn"))
    out = S.typed_score(submissions, targets, citations, receipts, episode="o_orderkey", strict=False)  # one order in fifty has no target
    return out.select("o_orderkey", "target_missing", "A", "G", "Ret", "fabricated")


# Traces.


@query("w05_repeated_calls", f"WITH {REPEATED_SQL} SELECT user_id, event_id, repeated FROM rep")
def _(t: Tables) -> DataFrame:
    return repeated(t).select("user_id", "event_id", "repeated")


SEARCHES = "('bm25_search', 'search_tables', 'grep_document')"


@query("w06_guardrails", f"""
WITH {REPEATED_SQL} SELECT user_id, event_id, CASE WHEN repeated THEN 'repeat' WHEN name IN {SEARCHES} AND lag(name, 1) OVER w IN {SEARCHES} AND lag(name, 2) OVER w IN {SEARCHES} THEN 'myopic' END AS guardrail FROM rep WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def _(t: Tables) -> DataFrame:
    return V.guardrails(repeated(t), "user_id", ["event_id"]).select("user_id", "event_id", "guardrail")


@query("a11_tool_metrics", f"WITH {REPEATED_SQL} SELECT user_id, count(*) AS total_calls, sum(CAST(repeated AS BIGINT)) AS repeats, CAST(0 AS BIGINT) AS errors, CAST(sum(length(props)) AS BIGINT) AS chars, count(*) FILTER (name = 'read') AS reads FROM rep GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = V.tool_metrics(repeated(t), t.events.select("user_id", F.col("props").alias("text")), "user_id")
    return m.select("user_id", "total_calls", "repeats", "errors", "chars", F.coalesce(F.col("by_tool")["read"], F.lit(0)).alias("reads"))


PROCESS_SQL = f"""
WITH {REPEATED_SQL}, g AS (SELECT *, CASE WHEN repeated THEN 'repeat' WHEN name IN {SEARCHES} AND lag(name, 1) OVER w IN {SEARCHES} AND lag(name, 2) OVER w IN {SEARCHES} THEN 'myopic' END AS guardrail FROM rep WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT user_id, max(CAST(name IN {SEARCHES} AS DOUBLE)) AS r, max(CAST(name IN ('read', 'read_table', 'grep_document') AS DOUBLE)) AS e, max(CAST(name = 'calculate' AS DOUBLE)) AS c, sum(CAST(repeated AS INTEGER)) AS rp, count(guardrail) AS gc FROM g GROUP BY 1)
SELECT user_id, round(greatest(0.0, least(1.0, 0.35 * r * e + 0.20 * e + 0.15 * CASE WHEN user_id % 2 = 0 THEN c ELSE 1.0 END - 0.30 * least(1.0, rp / 2.0) - 0.15 * least(1.0, gc / 2.0) - 0.20 * CAST(e = 0 AND c = 0 AS DOUBLE))), 6) AS process_quality FROM a
"""


@query("c10_process_quality", PROCESS_SQL)
def _(t: Tables) -> DataFrame:
    guarded = V.guardrails(repeated(t), "user_id", ["event_id"])
    asked = t.events.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "what is the growth?").otherwise("who signed?").alias("question"), F.lit("x").alias("answer"))
    p = V.process_components(guarded, "user_id", asked)
    q = S.process_quality(*[F.col(c) for c in ("pivoted", "evidence_acquired", "arithmetic_compliance", "repeated_calls", "guardrail_count", "premature_answer")])
    return p.select("user_id", F.round(q, 6).alias("process_quality"))


PHASES_SQL = "list_filter([CASE WHEN list_has_any({0}, ['bm25_search', 'search_tables', 'grep_document']) THEN 'r' END, CASE WHEN list_has_any({0}, ['read', 'read_table', 'grep_document']) THEN 'e' END, CASE WHEN list_contains({0}, 'calculate') THEN 'c' END, CASE WHEN list_contains({0}, 'finish') THEN 'f' END], lambda x: x IS NOT NULL)"


@query("c11_phase_agreement", f"""
WITH {CALLS_SQL}, s AS (SELECT user_id, list(name) FILTER (event_id % 2 = 0 AND event_id % 300 < 20) AS a, list(name) FILTER (event_id % 2 = 1 AND event_id % 300 < 40) AS b FROM calls GROUP BY 1),
p AS (SELECT user_id, {PHASES_SQL.format("coalesce(a, [])")} AS a, {PHASES_SQL.format("coalesce(b, [])")} AS b FROM s)
SELECT user_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END, 6) AS agreement FROM p
""")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    x = calls(t).groupBy("user_id").agg(F.collect_list(F.when((i % 2 == 0) & (i % 300 < 20), F.col("name"))).alias("a"), F.collect_list(F.when((i % 2 == 1) & (i % 300 < 40), F.col("name"))).alias("b"))
    return x.select("user_id", F.round(V.phase_agreement(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("w12_last_submission", f"WITH {CALLS_SQL} SELECT user_id, arg_max(props, event_id) AS submission, count(*) AS finishes FROM calls WHERE name = 'finish' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return V.last_submission(calls(t), "user_id", "event_id", arguments="props")


@query("p29_bounded_evidence", """
WITH x AS (SELECT conv_id, turn, left(text, 300) AS p FROM conversations), y AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT conv_id, turn, md5(left(p, CAST(greatest(0, 700 - b) AS BIGINT))) AS evidence_md5 FROM y WHERE length(left(p, CAST(greatest(0, 700 - b) AS BIGINT))) > 0
""")
def _(t: Tables) -> DataFrame:
    return V.running_evidence(t.conversations, "conv_id", ["turn"], 300, 700).select("conv_id", "turn", F.md5("evidence").alias("evidence_md5"))


@query("p28_evidence_texts", """
WITH x AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'read' ELSE 'bm25_search' END AS tool FROM conversations)
SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (tool = 'read'), '')) AS strong_md5, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (tool <> 'read'), '')) AS weak_md5 FROM x GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    x = t.conversations.select("conv_id", "turn", "text", F.when(F.col("role") == "user", "read").otherwise("bm25_search").alias("tool"))
    return V.evidence_texts(x, "conv_id", ["turn"]).select("conv_id", F.md5("strong").alias("strong_md5"), F.md5("weak").alias("weak_md5"))


@query("p31_chat_messages", "SELECT conv_id, count(*) + 1 AS n_messages, md5('system:be brief' || string_agg(chr(10) || role || ':' || text, '' ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = V.chat_messages(t.conversations, "conv_id", "turn", "be brief")
    return m.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "\n")).alias("messages_md5"))


@query("k13_context_window", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS s, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE s <= 500 OR k = 1
""")
def _(t: Tables) -> DataFrame:
    x = t.conversations.withColumn("size", F.length("text"))
    return V.context_window(x, "conv_id", "turn", "size", 500).select("conv_id", "turn")


@query("p12_bounded_observation")
def _(t: Tables) -> DataFrame:
    payload = F.to_json(F.struct("text", F.lit(0).alias("start"), F.length("text").alias("total_chars")))
    x = t.documents.select("doc_id", V.bounded_observation(payload).alias("o"))
    return x.select("doc_id", F.length("o").alias("n_chars"), F.get_json_object("o", "$.observation.truncated").alias("truncated"), F.get_json_object("o", "$.end").cast("long").alias("end"))


# Curation.

W01_SQL = "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1"


@query("w01_keep_first", W01_SQL)
def _(t: Tables) -> DataFrame:
    return U.first_per(t.orders, ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w03_argmax", "SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := l_quantity, b := l_extendedprice, c := -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    best = U.first_per(t.lineitem, ["l_orderkey"], [F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber"])
    return best.select("l_orderkey", "l_linenumber")


@query("w04_duplicates", "SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w ELSE -1 END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)")
def _(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", F.md5("text").alias("identity"))
    return U.with_duplicates(x, "identity", ["doc_id"], F.col("doc_id")).select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query("f04_eligible", f"""
WITH {CALLS_SQL}, f AS (SELECT event_id // 4 AS trace, count(*) FILTER (name = 'finish') AS n_finish, arg_max(name, event_id) AS last_call, count(*) FILTER (name = 'calculate') AS n_calculate FROM calls GROUP BY 1)
SELECT trace, n_finish = 1 AND last_call = 'finish' AND n_calculate = 0 AND trace % 5 <> 0 AS eligible FROM f
""")
def _(t: Tables) -> DataFrame:
    f = U.call_facts(calls(t).withColumn("trace", F.floor(F.col("event_id") / 4)), "trace", "event_id")
    good = (F.col("trace") % 5 != 0).cast("int")
    return f.select("trace", U.eligible(F.lit("finish"), good, F.lit(1), F.lit(1), F.lit(False), F.lit(0)).alias("eligible"))


@query("f06_filter_reason", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 5 = 1 THEN 'unavailable' WHEN o_orderkey % 5 = 2 THEN 'numeric_mismatch' WHEN o_orderkey % 5 = 3 THEN 'numeric_mismatch' END AS filter_reason FROM orders
""")
def _(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    i = F.col("o_orderkey") % 5
    answer = F.when(i == 0, "  ").when(i == 1, "Answer: N/A").when(i == 2, "Answer: none found, 1").when(i == 3, F.concat(F.lit("Answer: -"), price)).otherwise(F.concat(F.lit("so\nAnswer: $"), price))
    x = t.orders.select("o_orderkey", price.alias("gold"), answer.alias("text"))
    kept, dropped = U.filtered(x, "gold", "text")
    return kept.select("o_orderkey", F.lit(None).cast("string").alias("filter_reason")).unionByName(dropped.select("o_orderkey", "filter_reason"))


@query("f07_migration_reasons", """
SELECT o_orderkey, CASE WHEN r = '' THEN 'candidate' ELSE 'quarantined' END AS status, r AS reasons FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'a_expensive' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'b_urgent' END, CASE WHEN o_orderstatus = 'F' THEN 'c_closed' END) AS r FROM orders)
""")
def _(t: Tables) -> DataFrame:
    found = U.reasons(c_closed=F.col("o_orderstatus") == "F", b_urgent=F.col("o_orderpriority") == "1-URGENT", a_expensive=F.col("o_totalprice") > 400000)
    x = t.orders.select("o_orderkey", found.alias("r"))
    return x.select("o_orderkey", U.status(F.col("r")).alias("status"), F.array_join("r", ",").alias("reasons"))


@query("a04_status_counts", "SELECT o_orderstatus AS status, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status"), "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("f09_judged_pass", "SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 5 >= 3 AND event_id % 3 >= 1")
def _(t: Tables) -> DataFrame:
    verdict = F.when(F.col("event_type") == "click", "pass").otherwise("fail")
    return t.events.where(U.judged_pass(verdict, F.col("event_id") % 5, F.col("event_id") % 3)).select("event_id")


@query("f11_length_safe", "SELECT doc_id, n_chars <= 2000 AS kept FROM documents")
def _(t: Tables) -> DataFrame:
    short, long = U.length_safe(t.documents, "n_chars", 2000)
    return short.select("doc_id", F.lit(True).alias("kept")).unionByName(long.select("doc_id", F.lit(False).alias("kept")))


@query("f12_row_violations", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 5000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS violations FROM orders WHERE o_totalprice < 5000 OR o_orderstatus = 'P'")
def _(t: Tables) -> DataFrame:
    v = U.violations(t.orders, ["o_orderkey"], price=F.col("o_totalprice") >= 5000, status=F.col("o_orderstatus") != "P")
    return v.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("f14_evaluation_violations", f"""
WITH {EVAL_SQL}, one AS (SELECT run_id, question_id * 40 + event_id % 40 AS question_id FROM ev), q AS (SELECT DISTINCT question_id * 40 + event_id % 39 AS question_id FROM ev)
SELECT run_id, CAST(question_id AS VARCHAR) AS question_id, violation, count(*) AS n FROM (
  SELECT run_id, question_id, 'repeated' AS violation FROM one GROUP BY 1, 2 HAVING count(*) > 1
  UNION ALL (SELECT run_id, question_id, 'extra' FROM (SELECT DISTINCT run_id, question_id FROM one) WHERE question_id NOT IN (SELECT question_id FROM q))
  UNION ALL SELECT r.run_id, q.question_id, 'missing' FROM (SELECT DISTINCT run_id FROM one) r CROSS JOIN q WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.run_id = r.run_id AND o.question_id = q.question_id)) GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    of = lambda n: (F.col("question_id") * 40 + F.col("event_id") % n).cast("string")
    rows = evaluations(t)
    return U.evaluation_violations(rows.withColumn("question_id", of(40)), rows.select(of(39).alias("question_id")), V.STOP_REASONS).groupBy("run_id", "question_id", "violation").agg(F.count("*").alias("n"))


@query("f16_audit_sample", """
WITH b AS (SELECT event_id, user_id, CASE WHEN event_id IN (5, 17) THEN 0 WHEN value > 60 THEN 1 WHEN event_type = 'error' AND value > 30 THEN 2 WHEN value < 0.05 THEN 3 END AS bucket FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bucket, event_id) AS k FROM b WHERE bucket IS NOT NULL)
SELECT event_id, bucket FROM f WHERE bucket = 0 OR k = 1 ORDER BY bucket, event_id LIMIT 60
""")
def _(t: Tables) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    return U.audit_sample(t.events, "user_id", F.col("event_id").isin(5, 17), [v > 60, (kind == "error") & (v > 30), v < 0.05], ["event_id"], 60).select("event_id", "bucket")


@query("a03_selection_summary", "SELECT sum(n) AS selected_rows, count(*) AS unique_questions, min(n) AS least, max(n) AS most, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS o_rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    s = U.selection_summary(t.orders, "o_custkey", "o_orderstatus")
    return s.select("selected_rows", "unique_questions", "least", "most", F.col("by_model")["O"].alias("o_rows"))


@query("w13_disjoint_split", """
WITH d AS (SELECT o_custkey, count(*) AS n, md5(CAST(o_custkey AS VARCHAR)) AS h FROM orders GROUP BY 1),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT o_custkey, CASE WHEN before < 3000 AND n < (SELECT count(*) FROM orders) - before THEN 'dev' ELSE 'train' END AS split FROM b
""")
def _(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return U.disjoint_split(d, "o_custkey", F.md5(F.col("o_custkey").cast("string")), "n", 3000).select("o_custkey", "split")


# Reports.


@query("a06_main_table", f"""
WITH {EVAL_SQL} SELECT run_id, count(*) AS n_rollouts, count(DISTINCT question_id) AS n_questions, round(100 * avg(F), 6) AS finish_pct, round(100 * avg(correct), 6) AS correct_pct, round(100 * avg(grounded_success), 6) AS grounded_pct, round(avg(A), 6) AS mean_A, round(avg(G), 6) AS mean_G,
  CAST(sum(CAST(unresolved AS INTEGER)) AS BIGINT) AS unresolved, CAST(sum(CAST(stop_reason = 'infrastructure' AS INTEGER)) AS BIGINT) AS infrastructure_failures, round(100 * avg(least(1, correct + CAST(unresolved AND F = 1 AS INTEGER))), 6) AS correct_upper_pct,
  round(100 * avg(least(1, grounded_success + CAST(unresolved AND F = 1 AND G = 1 AS INTEGER))), 6) AS grounded_upper_pct, round(avg(output_tokens), 6) AS output_tokens, round(CASE WHEN count(tool_calls) = count(*) THEN avg(tool_calls) END, 6) AS tool_calls, round(avg(latency_s), 6) AS latency_s FROM ev GROUP BY run_id
""")
def _(t: Tables) -> DataFrame:
    m = P.main_table(evaluations(t)).drop("cost_usd")
    return m.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in m.dtypes])


@query("a07_failure_table", """
WITH e AS (SELECT event_type AS run_id, event_id AS i, CASE WHEN event_id % 7 <> 0 THEN 'accepted_finish' WHEN event_id % 2 = 0 THEN 'turn_limit' ELSE 'infrastructure' END AS s, CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN NULL ELSE event_id % 9 END AS tc FROM events),
c AS (SELECT run_id, unnest([i % 50, i % 70]) AS n FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS m FROM c)
SELECT run_id, count(*) FILTER (s = 'accepted_finish') AS accepted_finish, count(*) FILTER (s = 'turn_limit') AS turn_limit, count(*) FILTER (s = 'infrastructure') AS infrastructure, CAST(0 AS BIGINT) AS other, round(100 * avg(CAST(i % 6 = 0 AS INTEGER)), 6) AS gold_page_read_pct,
  count(*) FILTER (i % 4 = 0) AS zero_citation, round(100 * sum(least(i % 2, i % 4)) / sum(i % 4), 6) AS visible_citation_pct, round(median(i % 8), 6) AS median_turns, round(100 * sum(i % 3) / greatest(1, sum(tc)), 6) AS truncation_pct,
  (SELECT min(n) FROM k WHERE k.run_id = e.run_id AND k = floor((m - 1) * 0.5)) AS median_chars, (SELECT min(n) FROM k WHERE k.run_id = e.run_id AND k = floor((m - 1) * 0.95)) AS p95_chars FROM e GROUP BY run_id
""")
def _(t: Tables) -> DataFrame:
    f = P.failure_table(evaluations(t))
    f = f.select("run_id", "accepted_finish", "turn_limit", "infrastructure", "other", "gold_page_read_pct", "zero_citation", "visible_citation_pct", "median_turns", "truncation_pct", "median_chars", "p95_chars")
    return f.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in f.dtypes])


PAIRS_SQL = """
m AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'x' ELSE 'y' END AS arm, CAST(avg(value) FILTER (event_type = 'click') > 10 AS INTEGER) AS a, CAST(avg(value) FILTER (event_type = 'view') > 10 AS INTEGER) AS b FROM events GROUP BY 1)
"""


def _pairs(t: Tables) -> DataFrame:
    mean = lambda kind: (F.avg(F.when(F.col("event_type") == kind, F.col("value"))) > 10).cast("int")
    x = t.events.groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b"))
    return x.withColumn("arm", F.when(F.col("user_id") % 3 == 0, "x").otherwise("y"))


@query("a08_paired_effect", f"""
WITH {PAIRS_SQL} SELECT arm, count(*) AS n, round(avg(b - a), 6) AS delta, sum(CAST(b > a AS INTEGER))::BIGINT AS wins, sum(CAST(b < a AS INTEGER))::BIGINT AS losses, sum(CAST(a = 1 AND b = 1 AS INTEGER))::BIGINT AS both_correct, sum(CAST(a = 0 AND b = 0 AS INTEGER))::BIGINT AS both_wrong FROM m GROUP BY arm
""")
def _(t: Tables) -> DataFrame:
    return P.paired_effect(_pairs(t), ["arm"], "a", "b").withColumn("delta", F.round("delta", 6))


@query("a09_bootstrap")
def _(t: Tables) -> DataFrame:
    x = _pairs(t).withColumn("delta", (F.col("b") - F.col("a")).cast("double"))
    return P.bootstrap(x, "arm", "user_id", "delta", resamples=2000)


@query("a10_floor_quantile", """
SELECT k.event_type, k.value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) k WHERE i = least(n - 1, floor((n - 1) * 0.95))
""")
def _(t: Tables) -> DataFrame:
    return P.floor_quantile(t.events, ["event_type"], "value", 0.95, "p95")


@query("a13_group_statistics", """
SELECT user_id, count(*) AS n, count(r) AS n_resolved, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(var_pop(r), 6) AS variance, count(*) FILTER (r <> 0) = 0 AS all_zero, min(r) = max(r) AS all_equal, count(*) = count(r) AND NOT coalesce(min(r) = max(r), true) AS retained
FROM (SELECT user_id, CASE WHEN event_id % 501 = 0 THEN NULL ELSE value END AS r FROM events) GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    x = t.events.select("user_id", F.when(F.col("event_id") % 501 != 0, F.col("value")).alias("r"))
    g = G.group_stats(x, "user_id", "r")
    return g.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in g.dtypes])


@query("w09_group_advantages", """
SELECT event_id, round(CASE WHEN n >= 2 AND s > 1e-8 THEN (value - m) / s END, 6) AS advantage FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type))
""")
def _(t: Tables) -> DataFrame:
    x = t.events.withColumn("g", F.concat_ws("/", "user_id", "event_type"))
    return G.advantages(x, "g", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("w10_retained_groups", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, CASE WHEN event_id % 501 = 0 THEN NULL ELSE value END AS r FROM events) GROUP BY 1 HAVING count(*) = count(r) AND min(r) <> max(r))")
def _(t: Tables) -> DataFrame:
    x = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 501 != 0, F.col("value")).alias("r"))
    return G.retained(x, "user_id", "r").select("event_id")


@query("w11_epoch_pages")
def _(t: Tables) -> DataFrame:
    return G.epoch_pages(t.customer.select("c_custkey"), "c_custkey", 1, 64)


@query("a14_confusion", "SELECT lang, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 1000 AND quality = 0) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.confusion(t.documents.join(t.labels, "doc_id"), F.col("n_chars") > 1000, F.col("quality") == 1, ["lang"])


@query("a14_distribution", "SELECT round(l_discount, 3) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.distribution(t.lineitem, "l_discount")


@query("a16_both_means", f"WITH {COMPONENT_SQL} SELECT mode, round(avg(A), 6) AS mean_resolved, round(avg(coalesce(A, 0)), 6) AS mean_unresolved_as_zero, count(A) AS n_resolved FROM z GROUP BY mode")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 3 == 0, "mixed").when(i % 3 == 1, "numeric").otherwise("semantic")
    r = S.component_score(mode, F.when(i % 3 != 2, i % 5 / 4).when(i % 17 == 0, 0.5), F.when(i % 3 != 1, (i % 3 + i % 2) / 4), F.when(i % 13 != 0, i % 4 / 3), (i % 7 != 0).cast("int"))
    out = t.events.select(mode.alias("mode"), r["A"].alias("A")).groupBy("mode").agg(*P.both_means("A"))
    return out.select("mode", F.round("mean_resolved", 6).alias("mean_resolved"), F.round("mean_unresolved_as_zero", 6).alias("mean_unresolved_as_zero"), "n_resolved")


@query("a17_length_summary", "SELECT lang, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.length_summary(t.documents, ["lang"], "n_chars", "source").select("lang", "least", "most", F.round("mean", 6).alias("mean"), F.col("questions").alias("sources"))


@query("a18_corpus_digest")
def _(t: Tables) -> DataFrame:
    return P.corpus_digest(t.documents, ["doc_id"], ["doc_id", "text"])


@query("a19_best_of_n", """
WITH s AS (SELECT user_id, min(event_id) FILTER (value >= 50) AS stop FROM events GROUP BY 1)
SELECT e.user_id, max(value) AS best, count(*) AS tries, max(value) >= 50 AS solved FROM events e JOIN s ON s.user_id = e.user_id WHERE stop IS NULL OR event_id <= stop GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    return P.best_of_n(t.events, "user_id", "value", "event_id", 50.0)


@query("o02_set_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT count(a.k) AS n_a, count(b.k) AS n_b, count(*) FILTER (a.k = b.k) AS common, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k")
def _(t: Tables) -> DataFrame:
    return G.set_compare(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus = 'O'"), "o_custkey")


@query("o04_exact_partition", "SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR n > 1")
def _(t: Tables) -> DataFrame:
    return G.exact_partition(t.orders.where("o_totalprice > 450000"), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("k05_full_roster", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return G.full_roster(t.customer.select("c_custkey"), m, "c_custkey")


EPISODES_SQL = """
WITH e AS (SELECT user_id AS episode_id, event_id AS turn, CASE event_type WHEN 'click' THEN 'deliver' WHEN 'view' THEN 'cite' WHEN 'purchase' THEN 'finish' ELSE 'other' END AS kind, props AS receipt FROM events),
d AS (SELECT episode_id, receipt, min(turn) AS t FROM e WHERE kind = 'deliver' GROUP BY ALL),
b AS (SELECT e.episode_id, count(*) FILTER (NOT coalesce(d.t < e.turn, false)) AS bad FROM e LEFT JOIN d USING (episode_id, receipt) WHERE kind = 'cite' GROUP BY 1)
SELECT episode_id, coalesce((SELECT count(*) FROM d WHERE d.episode_id = e.episode_id), 0) AS receipts, count(*) FILTER (kind = 'finish') AS finishes, coalesce(any_value(bad), 0) AS invalid_citations, max(turn) AS turns,
  count(*) FILTER (kind = 'finish') = 1 AS accepted, count(*) FILTER (kind = 'finish') > 1 AS ambiguous, max(turn) > 9000 AS over_budget FROM e LEFT JOIN b USING (episode_id) GROUP BY episode_id
"""


def episode_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "deliver").when(F.col("event_type") == "view", "cite").when(F.col("event_type") == "purchase", "finish").otherwise("other")
    return t.events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("turn"), kind.alias("kind"), F.col("props").alias("receipt"), F.col("ts").cast("timestamp").alias("at"))


@query("st1_episode_state", EPISODES_SQL)
def _(t: Tables) -> DataFrame:
    return episodes.batch(episode_events(t), 9000)


@query("st1_usable_receipts", """
WITH d AS (SELECT user_id, event_id FROM events WHERE event_type = 'click')
SELECT v.user_id AS episode_id, v.event_id AS turn, count(d.event_id) AS usable FROM (SELECT user_id, event_id FROM events WHERE event_type = 'view') v LEFT JOIN d ON d.user_id = v.user_id AND d.event_id < v.event_id GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    d = t.events.where("event_type = 'click'").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("delivered_turn"))
    v = t.events.where("event_type = 'view'").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("turn"))
    return episodes.usable_receipts(d, v)


@query("m05_five_percent_grade", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.055 THEN 1.0 ELSE 0.0 END AS grade FROM lineitem WHERE abs(l_discount - 0.05) > 0.001 OR l_discount < 0.05")
def _(t: Tables) -> DataFrame:
    money = lambda c: F.format_number(c, 2)
    x = t.lineitem.where("abs(l_discount - 0.05) > 0.001 OR l_discount < 0.05")
    return x.select("l_orderkey", "l_linenumber", A.five_percent_grade(money(F.col("l_extendedprice")), money(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("grade"))


@query("r05_intent_bonus", """
SELECT o_orderkey, CASE WHEN q = 0 AND k = 'operations' THEN 8.0 WHEN q = 0 AND k = 'cashflow' THEN -2.0 WHEN q = 1 AND k = 'cashflow' THEN 8.0 WHEN q = 2 AND k = 'equity' THEN 8.0 ELSE 0.0 END AS bonus FROM (SELECT o_orderkey, o_orderkey % 3 AS q, CASE o_orderstatus WHEN 'O' THEN 'operations' WHEN 'F' THEN 'cashflow' ELSE 'equity' END AS k FROM orders)
""")
def _(t: Tables) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ["The Income Statement", "cash flow of", "who are the Stockholders"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "O", "operations").when(F.col("o_orderstatus") == "F", "cashflow").otherwise("equity")
    return t.orders.select("o_orderkey", R.intent_bonus(asked, kind).alias("bonus"))
