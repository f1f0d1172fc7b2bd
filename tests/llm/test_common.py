"""The shared folder and tables written to it."""

from veritrail.llm import _common


def test_shared_dir_is_the_configured_one(spark, tmp_path):
    own = _common.shared_dir(spark)
    assert own and _common.shared_dir(spark) == own

    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert _common.shared_dir(Session()) == str(tmp_path)
    Session.conf = type("None_", (), {"get": lambda self, key, default=None: default})()
    try:
        _common.shared_dir(Session())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a cluster without a shared folder must be refused")


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, [None, "a"], {"k": 1.5}), (None, None, None)], "a int, b array<string>, c map<string,double>")
    out = _common.materialize(df, "test")
    assert out.schema == df.schema and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert _common.materialize(df.limit(0), "test").count() == 0


def test_slices_keep_rows_and_bound_bytes():
    import pyarrow as pa

    batches = [pa.record_batch({"t": ["x" * n for n in sizes]}) for sizes in ([], [5] * 600, [10, 3000, 10, 10, 9000, 2000, 1] * 3)]
    got = list(_common.slices(batches, rows=100, size=4000))
    assert [t for b in got for t in b.column(0).to_pylist()] == [t for b in batches for t in b.column(0).to_pylist()]
    assert all(b.num_rows == 1 or (b.num_rows <= 100 and b.nbytes <= 4000) for b in got)


def test_release_deletes_what_was_written(spark):
    outside = _common.materialize(spark.range(3), "outside")
    with _common.scratch(spark):
        inside = _common.materialize(spark.range(4), "inside")
        assert inside.count() == 4
    assert outside.count() == 3
    try:
        inside.sparkSession.read.parquet(inside.inputFiles()[0])
    except Exception as e:  # noqa: BLE001
        assert "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)
    else:
        raise AssertionError("the table must be gone")


def test_discard_deletes_one_table(spark):
    one, two = (_common.materialize(spark.range(n), "test") for n in (2, 3))
    before = len(_common._written[spark.sparkContext.applicationId])
    _common.discard(one)
    assert len(_common._written[spark.sparkContext.applicationId]) == before - 1 and two.count() == 3
    try:
        one.collect()
    except Exception as e:
        assert "FILE" in str(e).upper()
    else:
        raise AssertionError("the table is still there")
