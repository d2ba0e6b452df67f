"""One query per operator of the library, each with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.distinct import distinct_counts
from tideline.functions.forecast import line_criteria, recursive_forecast, window_forecast
from tideline.functions.growth import fixed_power, growth_fit
from tideline.functions.metrics import accuracy
from tideline.functions.scaling import half_width, ratio_variance, scale
from tideline.operators.aggregates import argmax, first_last, keep_first
from tideline.operators.epochs import PRIME, key_epochs, progress, row_epochs, scattered_sql, shuffled_epochs
from tideline.operators.mapping import apply, apply_at_end, apply_with_fraction
from tideline.operators.joins import compare_scalar, exists, hash_join, merge_join, not_exists
from tideline.operators.progressive import blocked, blocked_rows, pair_snapshots, snapshots
from tideline.plans.progressive import LINES, P, PLANS, oracle, oracle_ctes, run
from tideline.sources.chunks import epoch_rows
from tideline.sources.convert import integer_cents, number_table
from tideline.sources.tables import load, read_delimited, register, write_delimited
from tideline.storage import fresh_path
from tideline.streaming.online import select_online
from tideline.streaming.runner import ProgressiveStream, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


T_SQL = f"t AS (SELECT CAST(range AS INT) AS epoch FROM range({P}))"


# --- sources ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_parquet_projection(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_pipe(spark, sf_dir):
    path = fresh_path(spark, "nation-tbl")
    write_delimited(load(spark, sf_dir, "nation"), path, sep="|", header=False)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return read_delimited(spark, path, schema, sep="|")


@query(f"SELECT CAST(l_orderkey % {P} AS INT) AS epoch, count(*) AS n FROM lineitem GROUP BY 1")
def scan_with_epochs(spark, sf_dir):
    return key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey"]), P, "l_orderkey").groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH scan AS ({LINES}), {T_SQL} SELECT t.epoch, count(*) AS rows, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch")
def progress_fraction(spark, sf_dir):
    return progress(key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey"]), P, "l_orderkey"), P)


_DRAWN = f"SELECT CAST(floor(({scattered_sql('l_orderkey', 7)}) / (CAST({PRIME} AS DOUBLE) / {P})) AS INT) AS epoch FROM lineitem"


@query(f"WITH scan AS ({_DRAWN}), {T_SQL} SELECT t.epoch, count(*) AS rows, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch")
def shuffled_progress(spark, sf_dir):
    return progress(shuffled_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey"]), P, "l_orderkey", 7), P)


@query(f"WITH n AS (SELECT l_quantity, row_number() OVER () - 1 AS place, count(*) OVER () AS total FROM lineitem) SELECT CAST(floor(CAST(place * {P} AS DOUBLE) / total) AS INT) AS epoch, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM n GROUP BY 1")
def scan_row_epochs(spark, sf_dir):
    """Chunks in the order of the file's rows."""
    rows = row_epochs(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "_metadata"), P)
    return rows.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))


@query(f"SELECT CAST(l_orderkey % {P} AS INT) AS epoch, count(*) AS n FROM lineitem GROUP BY 1")
def scan_clustered_files(spark, sf_dir):
    """Rows of every epoch's files of the clustered copy."""
    return spark.createDataFrame(sorted(epoch_rows(spark, sf_dir, "lineitem", P).items()), "epoch int, n long")


# --- rows ------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def map_identity(spark, sf_dir):
    return apply(load(spark, sf_dir, "nation"), lambda df: df)


@query("SELECT * FROM nation WHERE false")
def map_ignore(spark, sf_dir):
    return apply(load(spark, sf_dir, "nation"), lambda df: None)


@query(f"WITH scan AS ({LINES}), {T_SQL} SELECT t.epoch, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction, round(count(*) / (CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan))) AS predicted FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch")
def map_with_fraction(spark, sf_dir):
    lines = key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey"]), P, "l_orderkey")
    snaps = snapshots(lines, [], [], P)
    return apply_with_fraction(snaps, progress(lines, P), lambda df: df.select("epoch", "fraction", F.round(F.col("group_rows") / F.col("fraction")).alias("predicted")))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING count(*) > 100")
def map_at_end(spark, sf_dir):
    return apply_at_end(_line_snaps(spark, sf_dir), lambda df: df.where("group_rows > 100").select("l_returnflag", F.col("group_rows").alias("n")), P)


@query("SELECT l_orderkey, CAST(round(l_discount * 100) AS BIGINT) AS l_discount, CAST(round(l_tax * 100) AS BIGINT) AS l_tax, CAST(round(l_extendedprice) AS BIGINT) AS l_extendedprice FROM lineitem")
def convert_integer_cents(spark, sf_dir):
    return integer_cents(load(spark, sf_dir, "lineitem", ["l_orderkey", "l_discount", "l_tax", "l_extendedprice"]))


def _number(k: int) -> str:
    return f"CAST(CAST(floor({scattered_sql('id + 1', 4512763 + 7919 * k)} / 1000.0) AS BIGINT) % 4 AS INT)"


@query(f"SELECT {', '.join(f'{_number(k)} AS c{"i" * (k + 1)}' for k in range(10))}, {_number(10)} AS x FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS id)")
def convert_number_table(spark, sf_dir):
    """As many rows as there are orders."""
    return number_table(spark, load(spark, sf_dir, "orders", ["o_orderkey"]).count())


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND (l_returnflag = 'R' OR NOT l_linestatus = 'O') AND l_discount BETWEEN 0.02 AND 0.05 AND l_tax <= l_discount AND l_returnflag <> 'N'")
def filter_predicates(spark, sf_dir):
    c = F.col
    kept = (c("l_quantity") >= 10) & (c("l_quantity") < 20) & ((c("l_returnflag") == "R") | ~(c("l_linestatus") == "O")) & c("l_discount").between(0.02, 0.05) & (c("l_tax") <= c("l_discount")) & (c("l_returnflag") != "N")
    return load(spark, sf_dir, "lineitem").where(kept).select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey AS id, n_name AS nation FROM nation")
def project_rename(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"))


@query("SELECT p_partkey, p_size, p_size * 2 + 1 AS twice, -p_size AS negative FROM part")
def with_columns(spark, sf_dir):
    return load(spark, sf_dir, "part", ["p_partkey", "p_size"]).withColumns({"twice": F.col("p_size") * 2 + 1, "negative": -F.col("p_size")})


@query("SELECT p_partkey, substring(p_name, 1, 2) AS two, p_name LIKE 'red%' AS starts, p_name LIKE '%ring' AS ends, p_name LIKE '%o%' AS has, p_name LIKE '%e%i%' AS pattern FROM part")
def scalar_functions_string(spark, sf_dir):
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.substring(name, 1, 2).alias("two"), name.startswith("red").alias("starts"), name.endswith("ring").alias("ends"), name.contains("o").alias("has"), name.like("%e%i%").alias("pattern"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, o_orderdate >= DATE '1998-01-01' AS recent, CAST(floor(o_totalprice / 2) AS BIGINT) AS half, round(o_totalprice) AS whole, CAST(o_orderkey AS DOUBLE) / nullif(o_custkey, 0) AS ratio, round(ln(o_totalprice + 1), 8) AS log, round(sqrt(o_totalprice), 8) AS root FROM orders")
def scalar_functions_date_math(spark, sf_dir):
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_orderdate") >= F.expr("DATE '1998-01-01'")).alias("recent"), F.floor(price / 2).alias("half"), F.round(price).alias("whole"),
        (F.col("o_orderkey").cast("double") / F.nullif("o_custkey", F.lit(0))).alias("ratio"), F.round(F.log(price + 1), 8).alias("log"), F.round(F.sqrt(price), 8).alias("root"),
    )


@query("SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS other FROM orders GROUP BY o_orderstatus")
def case_mask_sum(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("urgent"), F.count_if(~urgent).alias("other"))


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND regexp_matches(p_name, '^(red|blue).*g') AND p_type IS NOT NULL")
def in_like_regex(spark, sf_dir):
    c = F.col
    return load(spark, sf_dir, "part").where(c("p_size").isin(1, 5, 9) & c("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & c("p_name").rlike("^(red|blue).*g") & c("p_type").isNotNull()).select("p_partkey")


# --- joins -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def hash_join_inner(spark, sf_dir):
    big = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return hash_join(load(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]), big, ["c_custkey"], ["o_custkey"])


@query("WITH ps AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l.l_partkey, l.l_suppkey, n, count(*) AS m FROM lineitem l JOIN ps ON l.l_partkey = ps.l_partkey AND l.l_suppkey = ps.l_suppkey GROUP BY 1, 2, 3")
def hash_join_multi_key(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"])
    ps = lines.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return hash_join(lines, ps, ["l_partkey", "l_suppkey"], ["p", "s"]).groupBy("l_partkey", "l_suppkey", "n").agg(F.count(F.lit(1)).alias("m"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def left_join_swapped(spark, sf_dir):
    big = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    joined = hash_join(big, load(spark, sf_dir, "customer", ["c_custkey"]), ["o_custkey"], ["c_custkey"], "left", swap=True)
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def _rich_and_big(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    return rich, load(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")


_SIDES = "(SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000) c {} JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"


@query(f"SELECT o_custkey AS c_custkey, c_nationkey, o_orderkey FROM {_SIDES.format('RIGHT')}")
def right_join(spark, sf_dir):
    return hash_join(*_rich_and_big(spark, sf_dir), ["c_custkey"], ["o_custkey"], "right")


@query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_nationkey, o_orderkey FROM {_SIDES.format('FULL')}")
def full_join(spark, sf_dir):
    return hash_join(*_rich_and_big(spark, sf_dir), ["c_custkey"], ["o_custkey"], "full")


@query("SELECT CAST(l_orderkey % 10 AS INT) AS epoch, o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def merge_join_sorted(spark, sf_dir):
    orders = key_epochs(load(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]).withColumnRenamed("o_orderkey", "k"), P, "k")
    lines = key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "k"), P, "k")
    return merge_join(orders, lines, ["k", "epoch"]).groupBy("epoch", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_join_exists(spark, sf_dir):
    big = load(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return exists(load(spark, sf_dir, "customer", ["c_custkey"]), big, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_join_not_exists(spark, sf_dir):
    big = load(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return not_exists(load(spark, sf_dir, "customer", ["c_custkey"]), big, ["c_custkey"])


@query("WITH n AS (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1) SELECT l_suppkey, c FROM n WHERE c > (SELECT avg(c) FROM n)")
def scalar_subquery_having(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem", ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    return compare_scalar(n, n.agg(F.avg("c").alias("mean")), F.col("c") > F.col("mean"))


@query("SELECT count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")
def correlated_avg_subquery(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"])
    mean = lines.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("limit"))
    return lines.join(mean, "l_partkey").where("l_quantity < limit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220)")
def having_in_subquery(spark, sf_dir):
    large = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 220")
    return exists(load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), large, ["o_orderkey"])


def _line_snaps(spark, sf_dir, keys=("l_returnflag",)):
    rows = key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", *keys]), P, "l_orderkey").withColumn("q", F.col("l_quantity").cast("bigint"))
    return snapshots(rows, list(keys), ["q"], P)


def _flag_totals(spark, sf_dir):
    snaps = _line_snaps(spark, sf_dir)
    each = snaps.select("epoch", "l_returnflag", F.col("q_sum").cast("bigint").alias("q"))
    return each, each.groupBy("epoch").agg(F.sum("q").alias("total"))


SNAP = f"{T_SQL}, s AS (SELECT t.epoch, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS q FROM t JOIN lineitem ON l_orderkey % {P} <= t.epoch GROUP BY t.epoch, l_returnflag), a AS (SELECT epoch, CAST(sum(q) AS BIGINT) AS total FROM s GROUP BY epoch)"


@query(f"WITH {SNAP} SELECT s.epoch, l_returnflag, q, total FROM s JOIN a ON s.epoch = a.epoch")
def merge_mapper_both_online(spark, sf_dir):
    return pair_snapshots(*_flag_totals(spark, sf_dir), "both")


@query(f"WITH {SNAP} SELECT s.epoch, l_returnflag, q, total FROM s, a WHERE a.epoch = 0")
def merge_mapper_left_online(spark, sf_dir):
    return pair_snapshots(*_flag_totals(spark, sf_dir), "left")


@query(f"WITH {SNAP} SELECT s.epoch, l_returnflag, q, total FROM s, a WHERE a.epoch = {P - 1}")
def merge_mapper_right_eof(spark, sf_dir):
    return pair_snapshots(*_flag_totals(spark, sf_dir), "right_end")


# --- aggregates ------------------------------------------------------------------------------


@query("SELECT l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q_sum, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def agg_sum_min_max_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("q_sum"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS q_sum, count(*) AS n FROM lineitem")
def agg_global(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").cast("bigint").alias("q_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS q_sum, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").where("l_quantity < 0").agg(F.sum("l_quantity").cast("bigint").alias("q_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_last FROM orders GROUP BY o_custkey")
def agg_first_last(spark, sf_dir):
    return first_last(load(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*), 8) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_avg_ratio(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1)), 8).alias("mean"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey")
def agg_n_unique(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return keep_first(load(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"]), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def argmax_with_ties(spark, sf_dir):
    return argmax(load(spark, sf_dir, "part", ["p_partkey", "p_size"]), "p_size")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority)")
def argmax_per_group(spark, sf_dir):
    return argmax(load(spark, sf_dir, "orders", ["o_orderpriority", "o_orderkey", "o_totalprice"]), "o_totalprice", ["o_orderpriority"])


@query(f"SELECT CAST(l_orderkey % {P} AS INT) AS epoch, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2")
def snapshot_delta(spark, sf_dir):
    rows = key_epochs(load(spark, sf_dir, "lineitem"), P, "l_orderkey")
    return rows.groupBy("epoch", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))


@query(f"WITH {T_SQL} SELECT t.epoch, p_brand, p_size, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, min(l_quantity) AS low, max(l_quantity) AS high FROM t JOIN lineitem ON l_orderkey % {P} <= t.epoch JOIN part ON l_partkey = p_partkey GROUP BY t.epoch, p_brand, p_size")
def snapshot_cumulative(spark, sf_dir):
    rows = key_epochs(load(spark, sf_dir, "lineitem"), P, "l_orderkey").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    snaps = snapshots(rows, ["p_brand", "p_size"], ["l_quantity"], P, mins=["l_quantity"], maxs=["l_quantity"])
    return snaps.select("epoch", "p_brand", "p_size", F.col("group_rows").alias("n"), F.col("l_quantity_sum").cast("bigint").alias("q"), F.col("l_quantity_min").alias("low"), F.col("l_quantity_max").alias("high"))


@query("SELECT n_name FROM nation WHERE n_regionkey < 3")
def snapshot_blocked_vstack(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    return blocked_rows([nation.where(F.col("n_regionkey") == i).select("n_name") for i in range(3)])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def snapshot_blocked_keep_last(spark, sf_dir):
    return blocked(_line_snaps(spark, sf_dir), P).select("l_returnflag", F.col("group_rows").alias("n"))


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey")
def sort_multi_key(spark, sf_dir):
    return load(spark, sf_dir, "customer", ["c_mktsegment", "c_custkey"]).orderBy(F.desc("c_mktsegment"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_limit(spark, sf_dir):
    return load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


# --- inference -------------------------------------------------------------------------------

Q1 = PLANS["ci_q1"]
Q1_SQL = oracle_ctes(Q1)


def _q1(spark, sf_dir):
    register(spark, sf_dir, ["lineitem"])
    snaps = snapshots(spark.sql(Q1.rows), Q1.keys, Q1.sums, P, variance=True)
    return snaps, progress(spark.sql(Q1.scan), P)


def _q1_scaled(spark, sf_dir):
    snaps, progressed = _q1(spark, sf_dir)
    return scale(snaps, growth_fit(snaps, progressed), Q1.sums, variance=True)


@query(f"{Q1_SQL} SELECT DISTINCT epoch, round(fraction, 10) AS fraction, round(power, 8) AS power FROM fit")
def growth_power(spark, sf_dir):
    return growth_fit(*_q1(spark, sf_dir)).select("epoch", F.round("fraction", 10).alias("fraction"), F.round("power", 8).alias("power"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, n, n_final FROM scaled")
def scale_count(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).select("epoch", *Q1.keys, F.col("group_rows").alias("n"), "n_final")


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(price_sum, 2) AS price FROM scaled")
def scale_sum(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).select("epoch", *Q1.keys, F.round("price_sum", 2).alias("price"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, CAST(n AS DOUBLE) AS n_final, round(qty_raw, 2) AS qty FROM scaled")
def scale_complete(spark, sf_dir):
    snaps, progressed = _q1(spark, sf_dir)
    return scale(snaps, fixed_power(progressed, 0), ["qty"]).select("epoch", *Q1.keys, "n_final", F.round("qty_sum", 2).alias("qty"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(n / pow(fraction, 0.5)) AS n_final FROM scaled")
def scale_converging(spark, sf_dir):
    snaps, progressed = _q1(spark, sf_dir)
    return scale(snaps, fixed_power(progressed, 0.5), []).select("epoch", *Q1.keys, "n_final")


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(n / fraction) AS n_final FROM scaled")
def scale_growing(spark, sf_dir):
    snaps, progressed = _q1(spark, sf_dir)
    return scale(snaps, fixed_power(progressed, 1), []).select("epoch", *Q1.keys, "n_final")


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(qty_var, 6) AS qty_var, round(qty_mean, 8) AS qty_mean FROM scaled")
def variance_pooled(spark, sf_dir):
    return _q1(spark, sf_dir)[0].select("epoch", *Q1.keys, F.round("qty_var", 6).alias("qty_var"), F.round("qty_mean", 8).alias("qty_mean"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(sqrt(qty_sum_var) / qty_sum, 6) AS relative FROM scaled WHERE epoch >= 2")
def variance_sum(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).where("epoch >= 2").select("epoch", *Q1.keys, F.round(F.sqrt("qty_sum_var") / F.col("qty_sum"), 6).alias("relative"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(sqrt(greatest(n_final_var, 0)) / n_final, 6) AS relative FROM scaled WHERE epoch >= 2")
def variance_count(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).where("epoch >= 2").select("epoch", *Q1.keys, F.round(F.sqrt(F.greatest("n_final_var", F.lit(0.0))) / F.col("n_final"), 6).alias("relative"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(qty_price_cov / (qty_sum * price_sum), 8) AS relative FROM scaled WHERE epoch >= 2")
def covariance_sum_sum(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).where("epoch >= 2").select("epoch", *Q1.keys, F.round(F.col("qty_price_cov") / (F.col("qty_sum") * F.col("price_sum")), 8).alias("relative"))


RATIO = "(price_sum/qty_sum)*(price_sum/qty_sum)*(price_sum_var/(price_sum*price_sum) + qty_sum_var/(qty_sum*qty_sum) - 2*qty_price_cov/(price_sum*qty_sum))"


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(sqrt(greatest({RATIO}, 0)), 4) AS sd, round(sqrt(20) * sqrt(greatest({RATIO}, 0)), 3) AS half FROM scaled WHERE epoch >= 2")
def variance_ratio(spark, sf_dir):
    c = F.col
    v = ratio_variance(c("price_sum"), c("qty_sum"), c("price_sum_var"), c("qty_sum_var"), c("qty_price_cov"))
    return _q1_scaled(spark, sf_dir).where("epoch >= 2").select("epoch", *Q1.keys, F.round(F.sqrt(F.greatest(v, F.lit(0.0))), 4).alias("sd"), F.round(half_width(v), 3).alias("half"))


@query(f"{Q1_SQL} SELECT epoch, l_returnflag, l_linestatus, round(qty_sum, 2) AS estimate, round(sqrt(20) * sqrt(qty_sum_var) / qty_sum, 5) AS half FROM scaled WHERE epoch >= 2")
def confidence_interval(spark, sf_dir):
    return _q1_scaled(spark, sf_dir).where("epoch >= 2").select("epoch", *Q1.keys, F.round("qty_sum", 2).alias("estimate"), F.round(half_width(F.col("qty_sum_var")) / F.col("qty_sum"), 5).alias("half"))


def _values(spark, sf_dir, keys):
    """Snapshots per key and supplier, and the growth fit of the keys' totals."""
    lines = key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), P, "l_orderkey")
    rows = lines.join(load(spark, sf_dir, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey"))
    values = snapshots(rows, [*keys, "l_suppkey"], [], P)
    totals = values.groupBy("epoch", *keys).agg(F.sum("group_rows").alias("group_rows"))
    return values, growth_fit(totals, progress(lines, P))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def count_distinct_exact(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"]).join(load(spark, sf_dir, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query()
def count_distinct_moment(spark, sf_dir):
    return distinct_counts(*_values(spark, sf_dir, ["p_brand"]), ["p_brand"], "moment")


_MISSED = "CASE WHEN total - n - q + 1 <= 0 THEN 0 ELSE exp(lgamma(total - q + 1) + lgamma(total - n + 1) - lgamma(total - n - q + 1) - lgamma(total + 1)) END"


@query(f"""WITH {T_SQL}, scan AS ({LINES}), f AS (SELECT t.epoch, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch),
    v AS (SELECT t.epoch, p_brand, l_suppkey, CAST(count(*) AS DOUBLE) AS n_j FROM t JOIN lineitem ON l_orderkey % {P} <= t.epoch JOIN part ON p_partkey = l_partkey GROUP BY t.epoch, p_brand, l_suppkey),
    s AS (SELECT epoch, p_brand, fraction, sum(n_j) OVER (PARTITION BY epoch, p_brand) AS n, sum(n_j) OVER (PARTITION BY epoch, p_brand) / fraction AS total, n_j / fraction AS q FROM v JOIN f USING (epoch))
    SELECT epoch, p_brand, count(*) AS seen, round(sum(CASE WHEN fraction >= 1 OR total < n + q THEN 1 ELSE 1 / greatest(1e-12, 1 - {_MISSED}) END), 4) AS estimate FROM s GROUP BY epoch, p_brand""")
def count_distinct_horvitz(spark, sf_dir):
    return distinct_counts(*_values(spark, sf_dir, ["p_brand"]), ["p_brand"], "horvitz").withColumn("estimate", F.round("estimate", 4))


@query()
def prog_q16(spark, sf_dir):
    """Distinct suppliers per brand, type and size, predicted at every epoch."""
    lines = key_epochs(load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), P, "l_orderkey")
    part = load(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"]).where((F.col("p_brand") != "Brand#12") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    poor = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    keys = ["p_brand", "p_type", "p_size"]
    rows = not_exists(lines.join(part, lines.l_partkey == part.p_partkey), poor, ["l_suppkey"])
    values = snapshots(rows, [*keys, "l_suppkey"], [], P)
    totals = values.groupBy("epoch", *keys).agg(F.sum("group_rows").alias("group_rows"))
    return distinct_counts(values, growth_fit(totals, progress(lines, P)), keys)


# --- forecasts: event value per day and type, as a series -------------------------------------

SERIES = "SELECT event_type, CAST(day(ts) AS DOUBLE) AS t, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS v FROM events GROUP BY event_type, day(ts)"


def _series(spark, sf_dir):
    register(spark, sf_dir, ["events"])
    return spark.sql(SERIES)


def _forecast(method):
    def made(spark, sf_dir):
        return window_forecast(_series(spark, sf_dir), ["event_type"], 31.0, method).select("event_type", "t", F.round("forecast", 8).alias("forecast"))

    return made


PAST = "OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING)"
FORECASTS = {
    "tail": "v",
    "mean": f"avg(v) {PAST}",
    "ols": f"avg(v) {PAST} + (CASE WHEN count(*) {PAST} > 1 THEN regr_slope(v, t) {PAST} ELSE 0 END) * (31.0 - avg(t) {PAST})",
    "trend": f"v + avg(step) {PAST} * (31.0 - t)",
    "trend_last": "v + step * (31.0 - t)",
}
for _name, _made in FORECASTS.items():
    QUERIES[f"forecast_{_name}"] = _forecast(_name)
    ORACLE_SQL[f"forecast_{_name}"] = f"WITH s AS ({SERIES}), d AS (SELECT *, (v - coalesce(lag(v) OVER (PARTITION BY event_type ORDER BY t), 0)) / (t - coalesce(lag(t) OVER (PARTITION BY event_type ORDER BY t), 0)) AS step FROM s) SELECT event_type, t, round({_made}, 8) AS forecast FROM d"


@query(f"""WITH s AS ({SERIES}), o AS (SELECT event_type, min(t) AS t0 FROM s GROUP BY event_type)
    SELECT s.event_type, s.t, s.v, round(sum(pow(0.5, (s.t - p.t) / t0) * p.v) / sum(pow(0.5, (s.t - p.t) / t0)), 6) AS forecast
    FROM s JOIN s p ON s.event_type = p.event_type AND p.t <= s.t JOIN o ON o.event_type = s.event_type GROUP BY s.event_type, s.t, s.v""")
def forecast_ses(spark, sf_dir):
    return recursive_forecast(_series(spark, sf_dir), ["event_type"], 31.0, "ses").withColumn("forecast", F.round("forecast", 6))


_STEPS = f"""s AS ({SERIES}), d AS (SELECT *, (v - coalesce(lag(v) OVER w, 0)) / (t - coalesce(lag(t) OVER w, 0)) AS step, min(t) OVER (PARTITION BY event_type) AS t0, row_number() OVER w AS i
    FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t))"""


def _smoothed(column: str, base: float) -> str:
    """The smoothed mean of a column up to point ``a``, over points ``b``, in SQL."""
    weight = f"pow({base}, (a.t - b.t) / a.t0)"
    return f"sum({weight} * b.{column}) / sum({weight})"


@query(f"""WITH {_STEPS}
    SELECT a.event_type, a.t, a.v, round(a.v + {_smoothed('step', 0.5)} * (31.0 - a.t), 6) AS forecast FROM d a JOIN d b ON a.event_type = b.event_type AND b.t <= a.t GROUP BY a.event_type, a.t, a.v""")
def forecast_trend_ses(spark, sf_dir):
    return recursive_forecast(_series(spark, sf_dir), ["event_type"], 31.0, "trend_ses").withColumn("forecast", F.round("forecast", 6))


@query(f"""WITH {_STEPS}, m AS (
      SELECT a.event_type, a.i, a.t, a.t0, a.v, a.step, avg(b.v) AS mean, avg(b.t) AS mid, CASE WHEN count(*) > 1 THEN regr_slope(b.v, b.t) ELSE 0 END AS slope,
             avg(b.step) AS mean_step, {_smoothed('v', 0.75)} AS smooth_v, {_smoothed('step', 0.5)} AS smooth_step
      FROM d a JOIN d b ON a.event_type = b.event_type AND b.t <= a.t GROUP BY a.event_type, a.i, a.t, a.t0, a.v, a.step),
    k AS (
      SELECT event_type, i, t, t0, unnest(range(7)) AS model, unnest([0, 0, 0, slope, step, mean_step, smooth_step]) AS rise, unnest([v, mean, smooth_v, mean + slope * (t - mid), v, v, v]) AS now FROM m),
    e AS (SELECT k.event_type, k.i + 1 AS i, k.t, k.t0, model, rise, now, pow(n.v - (now + rise * (n.t - k.t)), 2) AS off FROM k JOIN d n ON n.event_type = k.event_type AND n.i = k.i + 1),
    r AS (SELECT a.event_type, a.i, a.t, a.model, a.rise, a.now, {_smoothed('off', 0.75)} AS score FROM e a JOIN e b ON a.event_type = b.event_type AND a.model = b.model AND b.i <= a.i GROUP BY a.event_type, a.i, a.t, a.model, a.rise, a.now),
    z AS (SELECT event_type, i, now + rise * (31.0 - t) AS forecast, row_number() OVER (PARTITION BY event_type, i ORDER BY score, model DESC) AS place FROM r)
    SELECT d.event_type, d.t, d.v, round(CASE WHEN d.i = 1 THEN d.v ELSE z.forecast END, 6) AS forecast FROM d LEFT JOIN z ON z.event_type = d.event_type AND z.i = d.i AND z.place = 1""")
def forecast_selector(spark, sf_dir):
    return recursive_forecast(_series(spark, sf_dir), ["event_type"], 31.0, "selector").withColumn("forecast", F.round("forecast", 6))


@query(f"""WITH s AS ({SERIES}), f AS (SELECT event_type, count(*) AS n, regr_syy(v, t) - pow(regr_sxy(v, t), 2) / nullif(regr_sxx(v, t), 0) AS rss FROM s GROUP BY event_type),
    l AS (SELECT *, CASE WHEN n > 4 AND rss > 0 THEN -n / 2.0 * (ln(2 * pi() * rss / n) + 1) END AS loglik FROM f)
    SELECT event_type, n, round(6 - 2 * loglik, 6) AS aic, round(6 - 2 * loglik + 24.0 / (n - 4), 6) AS aicc, round(3 * ln(n) - 2 * loglik, 6) AS bic FROM l""")
def forecast_criteria(spark, sf_dir):
    return line_criteria(_series(spark, sf_dir), ["event_type"]).select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("aic", "aicc", "bic")))


# --- streams ---------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return windowed_counts(load(spark, sf_dir, "events")).select(F.col("w.start").alias("began"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY l_returnflag")
def stream_last_estimate(spark, sf_dir):
    """The last estimate of a stream of chunk files joined with a table that stands still: the exact answer."""
    lines = load(spark, sf_dir, "lineitem", ["l_partkey", "l_returnflag", "l_quantity"])
    part = load(spark, sf_dir, "part", ["p_partkey", "p_size"]).where("p_size <= 25")
    folder = fresh_path(spark, "stream-chunks")
    lines.repartition(3).write.parquet(folder)
    last = {}
    stream = ProgressiveStream(spark, folder, lines.schema, lines.count(), lambda chunk: chunk.join(part, F.col("l_partkey") == F.col("p_partkey")), ["l_returnflag"], ["l_quantity"], variance=True)
    stream.run(lambda number, fraction, df: last.update(df=df))
    return last["df"].select("l_returnflag", F.col("n_final").alias("n"), F.col("l_quantity_sum").alias("q"))


_ONLINE = "SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'"


@query(oracle(PLANS["prog_q23"]).replace("round(v_sum, 2) AS revenue", "round(v_sum, 2) AS estimate"))
def select_online_reports(spark, sf_dir):
    """All reports of an online statement whose budget is large."""
    reports = select_online(spark, sf_dir, f"SELECT ONLINE {_ONLINE} WITHTIME 3600000 CONFIDENCE 95 REPORTINTERVAL 0;")
    return spark.createDataFrame([(r.epoch, round(r.estimate, 2)) for r in reports], "epoch int, estimate double")


# --- metrics ---------------------------------------------------------------------------------

_R = f"r AS ({oracle(PLANS['prog_q5'])}), z AS (SELECT n_name, revenue AS ref FROM r WHERE epoch = {P - 1})"


@query(f"WITH {_R} SELECT epoch, round(100 * avg(abs(revenue - ref) / abs(ref)), 6) AS mape, round(100 * avg(abs(revenue - ref)), 2) AS mae FROM r JOIN z USING (n_name) GROUP BY epoch")
def metric_mape(spark, sf_dir):
    return accuracy(run(PLANS["prog_q5"])(spark, sf_dir), ["n_name"]).select("epoch", F.round("mape", 6).alias("mape"), F.round("mae", 2).alias("mae"))


_R21 = f"r AS ({oracle(PLANS['prog_q21'])})"


@query(f"WITH {_R21} SELECT epoch, 100.0 * count(*) / (SELECT count(*) FROM r WHERE epoch = {P - 1}) AS recall, 100.0 AS precision FROM r GROUP BY epoch")
def metric_recall_precision(spark, sf_dir):
    return accuracy(run(PLANS["prog_q21"])(spark, sf_dir), ["s_name"]).select("epoch", "recall", "precision")
