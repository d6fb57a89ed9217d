from __future__ import annotations

from types import SimpleNamespace

import pytest

from purchase_insights.plans.pipeline import load_purchases
from purchase_insights.sources import scratch
from purchase_insights.sources.scratch import materialize, path_exists, remove_scratch, scratch_path


def session(master: str, configured: str | None = None, on_context: str | None = None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: on_context)
    return SimpleNamespace(conf={"spark.checkpoint.dir": configured} if configured else {}, sparkContext=context)


def test_the_configured_folder_is_used():
    path = scratch_path(session("yarn", configured="hdfs://shared/checkpoints/"), "medians")
    assert path.startswith("hdfs://shared/checkpoints/medians-")
    assert scratch_path(session("yarn", on_context="s3a://shared/c"), "medians").startswith("s3a://shared/c/medians-")


def test_paths_are_new_each_time():
    spark = session("yarn", configured="hdfs://shared")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session("spark://host:7077"), "medians")
    assert "purchase-insights-" in scratch_path(session("local[4]"), "medians")


def test_materialized_rows_do_not_depend_on_their_source(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "source"))
    kept = materialize(spark.read.parquet(str(tmp_path / "source")), "kept")
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "source"))
    assert kept.count() == 10
    assert "source" not in kept._jdf.queryExecution().toString()


def test_scratch_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_issued", [])
    paths = [scratch_path(spark, name) for name in "ab"]
    for path in paths:
        spark.range(3).write.parquet(path)
    remove_scratch(spark, paths[0])
    assert [path_exists(spark, path) for path in paths] == [False, True]
    remove_scratch(spark)
    assert not path_exists(spark, paths[1])
    with pytest.raises(ValueError, match="not a scratch path"):
        remove_scratch(spark, str(tmp_path))


def test_loading_leaves_no_copy_of_the_raw_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_issued", [])
    header = "Age,Category,Review Rating,Frequency of Purchases,Promo Code Used"
    (tmp_path / "raw.csv").write_text(f"{header}\n30,a,4.0,Weekly,No\n31,a,NA,Weekly,No\n")
    loaded = load_purchases(spark, str(tmp_path / "raw.csv"), str(tmp_path / "target"))
    assert sorted(r["review_rating"] for r in loaded.collect()) == [4.0, 4.0]
    assert not any("raw-purchases" in path for path in scratch._issued)
    with pytest.raises(Exception, match="already exists"):
        load_purchases(spark, str(tmp_path / "raw.csv"), str(tmp_path / "target"))
    assert load_purchases(spark, str(tmp_path / "raw.csv"), str(tmp_path / "target"), mode="overwrite").count() == 2
