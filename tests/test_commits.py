"""Versions of tables: what a killed, a late and a dry run leave."""

import json
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import lookup
from ledgerloom.sources import commits, shared, sinks


def test_tables_change_together(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.version(spark, path) is None and commits.tables(spark, path) == {}
    with pytest.raises(ValueError):
        commits.read(spark, path, "a")
    one = commits.commit(spark, path, {"a": spark.range(1), "b": spark.range(2)}, {"s": spark.range(3)})
    two = commits.commit(spark, path, {"a": spark.range(5)}, {"s": spark.range(4)}, base=one)
    counts = lambda n=None: [commits.read(spark, path, t, n).count() for t in "abs"]
    assert counts() == [5, 2, 7] and counts(one) == [1, 2, 3] and two > one
    assert commits.commit(spark, path, {"a": spark.range(9)}, dry_run=True) is None and counts() == [5, 2, 7]
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"a": spark.range(9)}, base=one)
    assert counts() == [5, 2, 7] and commits.commit(spark, path, {"b": spark.range(0)}) and counts() == [5, 0, 7]


def test_a_killed_run_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.commit(spark, path, {"a": spark.range(1), "b": spark.range(1)})
    files = tmp_path / "t" / "manifests"

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_create", killed)
    with pytest.raises(KeyboardInterrupt):
        commits.commit(spark, path, {"a": spark.range(2), "b": spark.range(2)})
    monkeypatch.undo()
    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        commits.commit(spark, path, {"a": spark.range(2), "b": broken})
    for text in ("", '{"tables": {"a": []', '{"tables": {}}'):
        (files / f"{7:012d}.json").write_text(text)
        (files / f".{7:012d}.json.crc").unlink(missing_ok=True)
        assert commits.version(spark, path) == 1 and commits.read(spark, path, "b").count() == 1
    assert commits.commit(spark, path, {"a": spark.range(4)}) == 8
    assert json.loads((files / f"{8:012d}.json").read_text())["complete"]
    # Folders of the killed runs go, once they are old enough; those of kept versions stay.
    assert commits.vacuum(spark, path, keep=2, older_than=3600) == 0
    assert commits.vacuum(spark, path, keep=1, older_than=-60) >= 3
    assert commits.read(spark, path, "a").count() == 4 and commits.read(spark, path, "b").count() == 1


def test_of_two_runs_one_commits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.commit(spark, path, {"a": spark.range(1)})
    create = commits._create

    def late(own, file, text):
        monkeypatch.undo()
        create(own, file, text)
        create(own, file, text)

    monkeypatch.setattr(commits, "_create", late)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"a": spark.range(2)})
    assert commits.version(spark, path) == 2


def test_snapshots_and_json(spark, tmp_path):
    sinks.write_snapshot(spark.createDataFrame([(1, 5), (3, 4), (2, 4)], "k int, y int"), str(tmp_path / "s"), ["y"], ["k"])
    assert sorted(map(tuple, sinks.read_snapshot(spark, str(tmp_path / "s")).collect())) == [(1, 5), (2, 4), (3, 4)]
    df = spark.createDataFrame([(1, "ñ", [1, None])], "k int, s string, a array<int>")
    assert json.loads(sinks.as_json(df).first().json) == {"k": 1, "s": "ñ", "a": [1, None]}
    batches = spark.createDataFrame([(3,), (1,), (2,)], "b int")
    assert [r.b for r in sinks.dry_run(batches, "b", True).collect()] == [1] and sinks.dry_run(batches, "b", False).count() == 3


class _Session:
    """What the folder depends on."""

    def __init__(self, setting, master, application):
        self.conf = type("C", (), {"get": staticmethod(lambda key, default: setting or default)})
        self.sparkContext = type("S", (), {"master": master, "applicationId": application})


def test_the_shared_folder_without_its_setting():
    first = shared.shared_dir(_Session(None, "local[8]", "one"))
    assert first == shared.shared_dir(_Session(None, "local", "one")) != shared.shared_dir(_Session(None, "local[*]", "two"))
    assert shared.shared_dir(_Session("hdfs://x/y/", "yarn", "three")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(_Session(None, master, "four"))


def test_containment_equals_all_pairs_without_making_them(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])))
    keys = [(k, rng.choice([word(), word() + word(), None])) for k in range(300)]
    for names in ([(word(), rng.randint(0, 9)) for _ in range(60)] + [(None, 0), ("", 4)], [("abc", 1), ("abc", 2), ("ca", 1)], []):
        df, dim = spark.createDataFrame(keys, "k int, t string"), spark.createDataFrame(names, "name string, ord int")
        matched = lookup.containment_match(df, "k", "t", dim, "name", "ord")
        want = {k: min(((t != n, o, n) for n, o in names if t is not None and n is not None and (t in n or n in t)), default=(0, 0, None))[2] for k, t in keys}
        assert {r.k: r.matched for r in matched.collect()} == want
        assert "NestedLoop" not in matched._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in matched._jdf.queryExecution().executedPlan().toString()
