"""Spreading of small tables, and the checkpoint folder."""

from rillframe import session


def test_only_small_tables_are_spread(spark, monkeypatch):
    df = spark.range(100).coalesce(1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL_PIECE", 0)
    assert session.spread(df).rdd.getNumPartitions() == 1


def test_a_folder_is_set_where_all_runs_on_one_machine(spark):
    assert session.ensure_checkpoint_dir(spark)
