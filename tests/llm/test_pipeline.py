"""The pipeline's stages in order, each over what its predecessor kept."""

import re

from pyspark.sql import functions as F

from veritrail.llm import near_dedup, quality_rules, secrets, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_dedup", "secret_scans", "best_fit_packing"] and P.ORACLE_SQL is None
    docs = given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, FOLDER)
        if k < len(P.STAGES) - 1:
            assert out.columns == given.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    passed = {r["record"]["doc_id"] for r in quality_rules.ledger(given).where(quality_rules.keeps()).collect()}
    assert ids[0] == passed and ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] == ids[4]
    model = toxicity.fit(kept[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in kept[0].collect() if model.score(r["text"]) < 0.5}
    assert ids[2] == {r["doc_id"] for r in near_dedup.near_duplicates(kept[1]).where("kept").collect()}
    before = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    for r in kept[3].collect():
        assert r["text"] == secrets.masked(before[r["doc_id"]]) and (r["text"] == before[r["doc_id"]] or r["n_chars"] == len(r["text"]))
        assert not re.search(r"token = \"[0-9a-f]{24}", r["text"])
    assert sorted(map(tuple, P.run(spark, FOLDER).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, kept[4].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_odd_documents(spark, tmp_path):
    import corpus_pipeline as P

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, None, None, None, None), (3, "", "en", "s", 0), (None, good + " token=abcdef12", "en", "s", 1), (5, good + " more", None, "t", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).select("doc_id", "piece").collect()
    assert sorted((r["doc_id"] or 0, r["piece"]) for r in got) == [(0, 0), (1, 0)]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0 and F is not None
