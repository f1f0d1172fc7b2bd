"""Queries against their SQL over rows that the small tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.oracle import rows
from veritrail.functions import numbers as N
from veritrail.plans.queries import ORACLES, QUERIES


@pytest.fixture
def compared(spark, tmp_path):
    """Whether a query over the given tables has its SQL's rows, and how many these are."""

    def run(name, **tables):
        db = duckdb.connect()
        for t, columns in tables.items():
            pq.write_table(pa.table(columns), f"{tmp_path}/{t}.parquet")
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
        want = rows(db.execute(ORACLES[name]).df())
        assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == want
        return len(want[1])

    return run


def test_p01_references_cut_within(compared):
    html = ["<title>a&amp;&amp;b and&amp</title>", "x &quot;y&quot &ampquot; &amp;quot; &copy;&copy &middot;", "&nbsp;&lt;b&gt; &#65; &AMP;", None, " a\t\tb\n\n\n\nc "]
    assert compared("p01_clean_text", pages={"page_id": list(range(len(html))), "url": [""] * len(html), "html": html}) == 5


def lines(prices, quantities, numbers=None, keys=None):
    n = len(prices)
    numbers = numbers or [1] * n
    return {"l_orderkey": pa.array(keys or range(1, n + 1), pa.int64()), "l_partkey": pa.array(range(n), pa.int64()), "l_suppkey": pa.array(range(n), pa.int64()),
            "l_linenumber": pa.array(numbers, pa.int32()), "l_quantity": pa.array(quantities, pa.float64()), "l_extendedprice": pa.array(prices, pa.float64())}


def test_m07_ties_of_doubles(compared):
    prices = [65608.23, 67110.23, 17110.53, 33523.45, 16505.19, 68680.01, 66450.79, 66917.51, 10000.01, 900.69]
    assert compared("m07_provenance", lineitem=lines(prices, [32.0] * len(prices))) == len(prices)


def test_m07_amounts_like_other_numbers_of_the_quote(compared):
    """No amount is found in a quote that does not show it, and what is missing or zero gives what the SQL gives."""
    prices, n = [1997.0, 1.0, 1997.01, 997.0, 2.0, -1.0, 0.0, None, 5.0, -5.0, 0.0, 7.0], [32.0, 1.0, 1.0, 3.0, 1.0, 1.0, 7.0, 2.0, 0.0, 0.0, 0.0, None]
    table = lines(prices * 7, n * 7, [k for k in range(1, 8) for _ in prices])
    assert compared("m07_provenance", lineitem=table) == 7 * len(prices)
    half = lines([900.0] * 4, [1.5, 2.5, 3.5, 4.49])
    assert compared("m07_provenance", lineitem=half) == 4


def test_m07_lines_of_one_key(compared):
    """Lines that share order, number, part and supplier are each held against their own receipt, equal ones, too."""
    n = 7 * 4
    table = lines([100.5 + i % 4 // 2 for i in range(n)], [2.0] * n, [1 + i // 4 for i in range(n)], [1] * n)
    zeros = pa.array([0] * n, pa.int64())
    assert compared("m07_provenance", lineitem=table | {"l_partkey": zeros, "l_suppkey": zeros}) == n


def test_rounded_is_that_of_sql(spark):
    values = [2050.2571875, 534.7040625, -534.7040625, 0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, 0.1 + 0.2, 1e300, -1e22, 4503599627.3704955, 0.0, None]
    want = [None if v is None else duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(N.rounded(frame.v, 6)).collect()] == want


def test_m09_prices_that_round_in_two_ways(compared):
    prices = [36580.005, 0.125, 1.005, 2.675, 0.0, -12.5, None, float("nan"), 1e12]
    table = lines(prices * 2, [1.0] * 2 * len(prices), [1] * len(prices) + [3] * len(prices))
    assert compared("m09_quote_has_value", lineitem=table) == 2 * len(prices)
    assert compared("m09_quote_has_value", lineitem=lines([1.0], [1.0]) | {"l_linenumber": pa.array([None], pa.int32())}) == 1


def test_m09_amounts_like_the_year(compared):
    """An amount in parentheses is not the value asked for, whatever other number the quote might be taken to show."""
    prices = [2019.0, 2019.0, 2019.0, 2019.01, 20.0, 9.0, 0.01]
    assert compared("m09_quote_has_value", lineitem=lines(prices, [1.0] * len(prices), [3, 6, 1, 3, 3, 3, 3])) == len(prices)


def test_k03_lines_of_one_number(compared):
    """The order in which lines of the same number come must not matter; nor may odd prices."""
    n = 400
    prices = [round(1000 + (i * 7919 % 9973) / 7, 2) for i in range(n)] + [0.0, None, float("nan"), -3.5]
    quantities = [1.0 + i % 50 for i in range(n)] + [0.0, 2.0, None, 4.0]
    keys = [i % 20 for i in range(n)] + [100, 101, 102, 103]
    assert compared("k03_scored_demonstrations", lineitem=lines(prices, quantities, keys=keys)) == 24


def test_k03_takes_one_line(spark, tmp_path):
    """The plan picks by values alone: no aggregate that depends on the order of rows."""
    pq.write_table(pa.table(lines([1.0, 2.0], [1.0, 2.0], keys=[1, 1])), f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["k03_scored_demonstrations"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "min_by" not in plan and "first(" not in plan


def test_k03_reads_its_lines_once(spark, tmp_path):
    """Pages, traces and targets are made of one written table, not of the lines again."""
    pq.write_table(pa.table(lines([10.0, 2.0], [1.0, 2.0])), f"{tmp_path}/lineitem.parquet")
    assert not [f for f in QUERIES["k03_scored_demonstrations"](spark, str(tmp_path)).inputFiles() if "lineitem" in f]
