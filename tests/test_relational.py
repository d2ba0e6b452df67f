import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import storage
from tideline.operators.aggregates import argmax, first_last, keep_first
from tideline.operators.joins import broadcast_if_small, compare_scalar, hash_join, merge_join, not_exists
from tideline.plans.trace import plan_nodes, to_dot
from tideline.sources.convert import delimited_to_parquet, number_table, split_rows
from tideline.sources.tables import list_files, load, natural_key, read_table, sniff_format, write_delimited, write_epochs
from tideline.streaming.runner import ProgressiveStream, run_progressive


def test_weather_sums(spark):
    df = spark.createDataFrame([("d1", 10, 0.1), ("d1", 20, 0.2), ("d2", 8, 0.31), ("d3", 4, 0.05), ("d3", 5, 0.05)], "date string, temp int, rain double")
    out = {r.date: (r.t, round(r.r, 3)) for r in df.groupBy("date").agg(F.sum("temp").alias("t"), F.sum("rain").alias("r")).collect()}
    assert out == {"d1": (30, 0.3), "d2": (8, 0.31), "d3": (9, 0.1)}


def test_merge_join_with_empty_and_unequal_sides(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 5)], "l string, k int")
    right = spark.createDataFrame([("x", 2), ("y", 3), ("z", 5)], "r string, k int")
    assert sorted((r.l, r.r) for r in merge_join(left, right, ["k"]).collect()) == [("b", "x"), ("c", "x"), ("d", "z")]
    assert merge_join(left.limit(0), right, ["k"]).isEmpty() and merge_join(left, right.limit(0), ["k"]).isEmpty()


def test_swapped_outer_join_keeps_unmatched_rows_once(spark):
    small = spark.createDataFrame([(1,), (2,)], "c int")
    chunk = spark.createDataFrame([(9, 1), (8, 1)], "o int, oc int")
    assert sorted((r.c, r.o) for r in hash_join(chunk, small, ["oc"], ["c"], "left", swap=True).fillna(-1).collect()) == [(1, 8), (1, 9), (2, -1)]


def test_outer_joins_keep_the_keys_of_both_sides(spark):
    left = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "n", 9)], "k int, l string, v int")
    right = spark.createDataFrame([(2, "x", 5), (3, "y", 6), (None, "z", 4)], "j int, r string, v int")
    rows = lambda how: sorted(((r.k, r.l, r.r, r.v, r.v_right) for r in hash_join(left, right, ["k"], ["j"], how).collect()), key=repr)
    inner, only_left, only_right = (2, "b", "x", 8, 5), [(1, "a", None, 7, None), (None, "n", None, 9, None)], [(3, None, "y", None, 6), (None, None, "z", None, 4)]
    assert rows("inner") == [inner]
    assert rows("left") == sorted([inner, *only_left], key=repr)
    assert rows("right") == sorted([inner, *only_right], key=repr)
    assert rows("full") == sorted([inner, *only_left, *only_right], key=repr)


def test_several_rows_are_no_scalar(spark):
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    two = spark.createDataFrame([(1,), (1,)], "b int")
    with pytest.raises(Exception, match="one row expected"):
        compare_scalar(rows, two, F.col("a") > F.col("b")).collect()
    assert compare_scalar(rows, two.limit(0), F.col("a") > F.col("b")).isEmpty()


def test_scalar_pairing(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 10), ("c", 15)], "name string, value int")
    for limit, names in ((7, ["b", "c"]), (12, ["c"])):
        scalar = spark.createDataFrame([(limit,)], "value_limit int")
        assert sorted(r.name for r in compare_scalar(rows, scalar, F.col("value") > F.col("value_limit")).collect()) == names


def test_nulls_never_match(spark):
    left = spark.createDataFrame([(None,), (1,)], "k int")
    assert [r.k for r in not_exists(left, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]).collect()] == [None]


def test_ordered_aggregates(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 3, 30), ("b", 4, 30)], "k string, o int, v int")
    assert sorted(tuple(r) for r in first_last(df, ["k"], "v", ["o"]).collect()) == [("a", 10, 20), ("b", 30, 30)]
    assert sorted((r.k, r.v) for r in keep_first(df, ["k"], ["o"]).collect()) == [("a", 10), ("b", 30)]
    assert argmax(df, "v").count() == 2 and argmax(df, "v", ["k"]).count() == 3


def test_broadcast_is_size_checked(spark):
    big = spark.range(1000)
    assert "broadcast" not in broadcast_if_small(big, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in broadcast_if_small(big, 10_000)._jdf.queryExecution().logical().toString().lower()


def test_scan_is_pruned_and_filtered(spark):
    plan = load(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 5").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,5.0)]" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_files(spark, tmp_path):
    assert sorted(["p-10", "p-9", "p-1"], key=natural_key) == ["p-1", "p-9", "p-10"]
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    for i in (9, 10, 1):
        (tmp_path / f"t.tbl.{i}").write_text(f"{i}|x|\n")
    files = list_files(spark, str(tmp_path), "t")
    assert [f.rsplit(".", 1)[-1] for f in files] == ["1", "9", "10"] and sniff_format(files) == "csv" and sniff_format(["/x/t.parquet"]) == "parquet"
    rows = read_table(spark, str(tmp_path), "t", schema, ["a"]).orderBy("file_order").collect()
    assert [(r.a, r.file_order) for r in rows] == [(1, 0), (9, 1), (10, 2)]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path), "none", schema)
    with pytest.raises(ValueError):
        load(spark, str(tmp_path), "none")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (1, 2)], "epoch int, v int")
    write_epochs(df, str(tmp_path / "o"), "accuracy")
    assert (tmp_path / "o/final.csv").read_text() == (tmp_path / "o/1.csv").read_text() == "v\n2\n" and (tmp_path / "o/0.csv").read_text() == "v\n1\n"
    write_delimited(df, str(tmp_path / "p"), sep="|")
    assert spark.read.csv(str(tmp_path / "p"), header=True, sep="|").count() == 2


def test_command_line_writes_every_estimate_and_its_time(spark, tmp_path, monkeypatch):
    import json
    import sys

    from tideline import cli

    monkeypatch.setattr(cli, "drop_intermediate", lambda spark: None)  # other tests share the session
    monkeypatch.setattr(sys, "argv", ["tideline", "prog_q6", "/root/testdata/sf0.001", str(tmp_path), "accuracy"])
    cli.main()
    meta = json.loads((tmp_path / "meta.json").read_text())
    assert len(meta["time_measures_ns"]) == 10 and meta["time_measures_ns"] == sorted(meta["time_measures_ns"]) and meta["result_dir"] == str(tmp_path)
    assert (tmp_path / "final.csv").read_text() == (tmp_path / "9.csv").read_text() and (tmp_path / "0.csv").read_text().startswith("revenue")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(master))
    assert storage.shared_dir(session("local[2]")) and storage.shared_dir(session("local"))


def test_scratch_deletes_what_is_not_kept(spark):
    with storage.scratch(spark) as keep:
        gone = storage.materialize(spark.range(5), "gone")
        left = keep(storage.materialize(gone.where("id > 1"), "left"))
    assert left.count() == 3 and not storage.exists(spark, gone.stored_at) and storage.exists(spark, left.stored_at)
    made = []
    for _ in range(2):
        path = storage.prepared(spark, "src", "t", lambda p: (made.append(p), spark.range(3).write.parquet(p)))
    assert made == [path]
    storage.drop_path(spark, path)
    assert storage.prepared(spark, "src", "t", lambda p: spark.range(3).write.parquet(p)) != path


def test_stream_gives_the_batch_snapshots(spark, tmp_path):
    lines = load(spark, "/root/testdata/sf0.001", "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"])
    epochs = lines.withColumn("epoch", F.pmod("l_orderkey", F.lit(3)).cast("int"))
    for e in range(3):
        part = tmp_path / f"part{e}"
        epochs.where(F.col("epoch") == e).drop("epoch").coalesce(1).write.parquet(str(part))
        (tmp_path / "chunks").mkdir(exist_ok=True)
        next(part.glob("*.parquet")).rename(tmp_path / "chunks" / f"{e}.parquet")
        import os

        os.utime(tmp_path / "chunks" / f"{e}.parquet", (1_000_000 + e, 1_000_000 + e))
    got = {}
    stream = ProgressiveStream(spark, str(tmp_path / "chunks"), lines.schema, lines.count(), lambda df: df, ["l_returnflag"], ["l_quantity"])
    times = stream.run(lambda epoch, fraction, df: got.update({(epoch, r.l_returnflag): (r.n_final, r.l_quantity_sum) for r in df.collect()}))
    from tideline.operators.epochs import progress

    expected = {(e, r.l_returnflag): (r.n_final, r.l_quantity_sum) for e, _, df in run_progressive(epochs, ["l_returnflag"], ["l_quantity"], progress(epochs, 3), 3) for r in df.collect()}
    assert len(times) == 3 and got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_converters(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("3|x|\n1|y|\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    delimited_to_parquet(spark, str(tmp_path / "a.tbl"), str(tmp_path / "p"), schema, order=["a"])
    assert [r.a for r in spark.read.parquet(str(tmp_path / "p")).orderBy("a").collect()] == [1, 3]
    split_rows(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    one, two = (number_table(spark, 100, partitions=n).groupBy("ci", "x").count() for n in (1, 5))
    assert one.subtract(two).isEmpty() and one.agg(F.max("ci")).first()[0] < 4


def test_trace(spark):
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    nodes = plan_nodes(df)
    assert nodes[0][1] is None and any(name == "Exchange" for *_, name in nodes) and "->" in to_dot(df)
