"""Table functions in SQL equal the operators."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions.text import READ_LIMIT
from veritrail.operators import retrieval as R
from veritrail.operators import tables


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 40}"
    return spark.createDataFrame([(i, i % 3, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, 0, None), (501, 0, "")], "id int, part int, text string")


@pytest.mark.parametrize("written", [False, True])
def test_search_equals_ranked(spark, items, written):
    keys = ["id", "part"]
    ix = R.written_index(items, "sql", lambda d: d, keys) if written else R.index(items, keys)
    tables.register_search(spark, ix, keys, "search_it")
    asked = [(1, "w1 W2 w2 w9"), (2, "w3"), (3, "none of it"), (4, ""), (5, None), (6, "w1 W2 w2 w9"), (7, "it's 'w5' \\ w6")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    q.createOrReplaceTempView("asked")
    want = R.ranked(ix, q, keys, 4).select("query_id", "rank", *keys, F.round("score", 5).alias("score"))
    want = sorted(map(tuple, want.collect()))
    got = spark.sql("SELECT query_id, b.* FROM asked, LATERAL search_it(query, 4) AS b")
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {1, 2, 6, 7}
    one = spark.sql("SELECT * FROM search_it('w1 W2 w2 w9', 4)").collect()
    assert sorted(map(tuple, one)) == [r[1:] for r in want if r[0] == 1]
    assert spark.sql("SELECT * FROM search_it('w1', 0)").count() == spark.sql("SELECT * FROM search_it('w1', NULL)").count() == 0


def test_read_equals_read(spark):
    pages = [("a", 2, "x" * 100 + "y" * 5000), ("a", 3, ""), ("b", 1, "é" * READ_LIMIT), ("b", 5, None)]
    p = spark.createDataFrame(pages, "document_id string, page int, text string")
    tables.register_read(spark, p, "read_it")
    asked = [(i, d, n, s) for i, (d, n, s) in enumerate([("a", 2, None), ("a", 2, 90), ("a", 2, 4000), ("a", 2, 9999), ("a", 2, -4), ("a", 3, 0), ("a", 0, 7), ("b", -1, 0), ("b", 1, 1), ("c", 1, 0), ("a", 9, 0)])]
    q = spark.createDataFrame(asked, "i int, document_id string, page int, start int").withColumn("end", F.lit(None).cast("int"))
    q.createOrReplaceTempView("wanted")
    want = R.read(p, q).where("error IS NULL").select("i", "page_read", "from", "to", "text", "next_start")
    got = spark.sql("SELECT w.i, r.* FROM wanted AS w, LATERAL read_it(w.document_id, w.page, w.start) AS r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_requests_meet_pages_by_keys(spark):
    """A read that is asked for by columns pairs no request with all pages."""
    p = spark.createDataFrame([(str(i), 1, "x" * i) for i in range(50)], "document_id string, page int, text string")
    tables.register_read(spark, p, "read_keyed")
    spark.range(50).createOrReplaceTempView("many")
    got = spark.sql("SELECT m.id, r.* FROM many AS m, LATERAL read_keyed(CAST(m.id AS STRING), -1, CAST(m.id * 7 AS INT)) AS r")
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "CartesianProduct" not in plan
    assert got.count() == 50


def test_no_pairs_of_queries_and_items_are_shuffled(spark, items, tmp_path):
    items.repartition(3).write.parquet(str(tmp_path / "d"))
    keys = ["id", "part"]
    tables.register_search(spark, R.written_index(spark.read.parquet(str(tmp_path / "d")), "parts", lambda d: d, keys), keys, "search_parts")
    spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(30)], "query_id int, query string").createOrReplaceTempView("asked_parts")
    got = spark.sql("SELECT query_id, b.* FROM asked_parts, LATERAL search_parts(query, 2) AS b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0" not in plan and "SortMergeJoin [term" not in plan
    # Between the sums and the ranking of a query, only the best of each part go on.
    above = plan[: plan.index("partial_sum")]
    assert above.count("Exchange hashpartitioning(query") == 1 and "Filter (_n#" in above[above.index("Exchange hashpartitioning(query") :]
