"""JSON lines with lineage: the same rows and numbers however the files are split."""

import json
import random

import pytest

from veritrail.sources import jsonl, readers


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for n in range(3):
        lines = []
        for i in range(1, 4000):
            lines.append(rng.choice(["", "  ", "{broken", '{"a": ']) if rng.random() < 0.1 else json.dumps({"a": i, "b": "é" * rng.randrange(60)}, ensure_ascii=False) + rng.choice(["", "\r"]))
        lines[7] = json.dumps({"a": 8, "b": "x" * 200_000})  # longer than a range
        (tmp_path / f"part-{n}.jsonl").write_bytes("\n".join(lines).encode() + b"\n" * (n % 2))
    (tmp_path / "z-empty.jsonl").write_bytes(b"")
    return tmp_path


def expected(folder):
    out = []
    for f in sorted(folder.glob("*.jsonl")):
        for i, line in enumerate(f.read_bytes().decode().split("\n"), 1):
            if line.strip():
                try:
                    out.append((f.name, i, "ok", json.loads(line)["a"]))
                except ValueError:
                    out.append((f.name, i, "invalid_json", None))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r["source"].rpartition("/")[2], r["line"], r["status"], r["row"]["a"] if r["row"] else None) for r in rows.collect()), key=str)


@pytest.mark.parametrize("size", ["16k", "64k", "128m"])
def test_any_split_gives_the_lines_of_the_file(spark, folder, monkeypatch, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = readers.jsonl_with_lineage(spark, str(folder), "a int, b string")
        if size != "128m":
            assert jsonl.numbered_lines(spark, str(folder)).rdd.getNumPartitions() > 20
        want = expected(folder)
        assert got(rows) == want
        counts = {r["source"].rpartition("/")[2]: (r["ok"], r["malformed"], r["first_malformed"]) for r in readers.status_counts(rows).collect()}
        for name in {w[0] for w in want}:
            bad = [w[1] for w in want if w[0] == name and w[2] != "ok"]
            assert counts[name] == (sum(w[0] == name and w[2] == "ok" for w in want), len(bad), min(bad))
        monkeypatch.setattr(jsonl, "BROADCAST_BYTES", 0)
        assert got(readers.jsonl_with_lineage(spark, str(folder), "a int, b string")) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
