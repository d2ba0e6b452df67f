"""Progressive versions of the queries: per epoch, the estimate of the final answer.

A plan names the rows (SQL with a column ``epoch``), the table whose scan counts as progress, the keys
and the summed columns, and the result as SQL expressions over the scaled snapshot. ``run`` evaluates
all epochs in one job over the tables; ``estimates`` gives one estimate after the other and reads
a chunk of files for each; ``oracle`` spells the same meaning as plain SQL that aggregates everything up
to an epoch anew, for every epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.growth import growth_fit
from tideline.functions.scaling import chebyshev, scale
from tideline.operators.epochs import progress
from tideline.operators.progressive import snapshots
from tideline.operators.state import SnapshotState
from tideline.plans.tpch import DEEP_KEYS, PRICE, Q4_WHEN, Q5_WHEN, Q7_WHEN, Q14_WHEN, REVENUE
from tideline.sources.chunks import KEYS, PS, WHOLE, bind, bind_chunk, epoch_rows
from tideline.sources.tables import register
from tideline.storage import materialize, scratch

P = 10
EPOCH = f"CAST(l_orderkey % {P} AS INT) AS epoch"


@dataclass
class Plan:
    rows: str
    keys: list[str]
    sums: list[str]
    result: dict[str, str]
    table: str = "lineitem"
    variance: bool = False
    where: str = ""
    with_: str = ""
    scaled: bool = True
    #: Aggregates per epoch that ``where`` may compare with.
    totals: dict[str, str] = field(default_factory=dict)
    qualify: str = ""

    @property
    def sql(self) -> str:
        return f"WITH {self.with_} {self.rows}" if self.with_ else self.rows

    @property
    def scan(self) -> str:
        return f"SELECT CAST({KEYS[self.table]} % {P} AS INT) AS epoch FROM {self.table}"

    @property
    def cut(self) -> list[str]:
        """The tables of which a chunk holds one epoch: those with the key of the scan."""
        return ["ps"] if self.table == "ps" else ["lineitem", "orders"]

    def finish(self, out: DataFrame) -> DataFrame:
        """The result from scaled snapshots, of one epoch or many."""
        if self.totals:
            each = out.groupBy("epoch").agg(*(F.expr(e).alias(n) for n, e in self.totals.items()))
            out = out.join(F.broadcast(each), "epoch")  # one row an epoch
        out = out.where(self.where) if self.where else out
        out = out.withColumn("__chosen", F.expr(self.qualify)).where("__chosen") if self.qualify else out
        return out.selectExpr("epoch", *self.keys, *(f"{e} AS {n}" for n, e in self.result.items()))


LINES = Plan("", [], [], {}).scan


def fitted(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    """The snapshots of a plan, scaled unless it says otherwise (groups that one chunk completes). What
    is read more than once, by the fit and by the scaling, is stored."""
    bind(spark, sf_dir, plan.sql + plan.scan)
    snaps = snapshots(spark.sql(plan.sql), plan.keys, plan.sums, P, variance=plan.variance)
    if plan.scaled or plan.totals:
        snaps = materialize(snaps, "snapshots")
    return scale(snaps, growth_fit(snaps, progress(spark.sql(plan.scan), P)), plan.sums, variance=plan.variance) if plan.scaled else snaps


def run(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan.finish(fitted(spark, sf_dir, plan))


def estimates(plan: Plan, spark: SparkSession, sf_dir: str, order: Sequence[int] = range(P)) -> Iterator[tuple[int, float, DataFrame]]:
    """(number, fraction, estimate) after each chunk, in the given order of epochs. A chunk reads its own
    files of the tables that are cut, and what chunks before it brought is read from the stored state.
    Closing the generator stops the run."""
    counts = epoch_rows(spark, sf_dir, plan.table, P)
    state = SnapshotState(spark, plan.keys, plan.sums, sum(counts.values()), plan.variance)
    for number, epoch in enumerate(order):
        bind_chunk(spark, sf_dir, plan.sql, P, epoch, plan.cut)
        state.add(number, spark.sql(plan.sql), counts[epoch])
        yield number, state.fraction, plan.finish(state.estimate() if plan.scaled else state.snapshot())


def in_chunks(plan: Plan, order: Sequence[int] = range(P)) -> Callable[[SparkSession, str], DataFrame]:
    """All estimates of a chunked run as one table."""
    return lambda spark, sf_dir: reduce(DataFrame.unionByName, [df for _, _, df in estimates(plan, spark, sf_dir, order)])


def oracle_ctes(plan: Plan) -> str:
    keys = "".join(f", {k}" for k in plan.keys)
    by = "".join(f", base.{k}" for k in plan.keys)
    sums = "".join(f", CAST(sum(base.{c}) AS DOUBLE) AS {c}_raw" for c in plan.sums)
    moments = ""
    join = ""
    if plan.variance:
        parts = "".join(f", avg(CAST({c} AS DOUBLE)) AS {c}_m, coalesce(var_samp(CAST({c} AS DOUBLE)), 0) AS {c}_v" for c in plan.sums)
        pooled = "".join(f", sum(n * {c}_m) / sum(n) AS {c}_mean, greatest(sum(n * ({c}_v + {c}_m * {c}_m)) / sum(n) - (sum(n * {c}_m) / sum(n)) * (sum(n * {c}_m) / sum(n)), 0) AS {c}_var" for c in plan.sums)
        part_by = "".join(f", part.{k}" for k in plan.keys)
        moments = f"part AS (SELECT epoch{keys}, count(*) AS n{parts} FROM base GROUP BY epoch{keys}), pooled AS (SELECT t.epoch{part_by}{pooled} FROM t JOIN part ON part.epoch <= t.epoch GROUP BY t.epoch{part_by}), "
        join = f" JOIN pooled USING (epoch{keys})"
    spread = ", slope_var * n_final * n_final * ln(1 / fraction) AS n_final_var" if plan.variance else ""
    var = "".join(f", {c}_var / n * n_final * n_final + n_final_var * ({c}_raw / n) * ({c}_raw / n) AS {c}_sum_var" for c in plan.sums) if plan.variance else ""
    if plan.variance:
        var += "".join(f", n_final_var * ({a}_raw / n) * ({b}_raw / n) AS {a}_{b}_cov" for i, a in enumerate(plan.sums) for b in plan.sums[i + 1 :])
    final = "".join(f", {c}_raw{' / n * n_final' if plan.scaled else ''} AS {c}_sum" for c in plan.sums)
    with_ = "".join(f"{x}, " for x in (PS if "ps" in f"{plan.with_} {plan.rows} {plan.scan}".replace(",", " ").split() else "", plan.with_) if x)
    return f"""
        WITH {with_}base AS ({plan.rows}), scan AS ({plan.scan}),
        t AS (SELECT CAST(range AS INT) AS epoch FROM range({P})),
        f AS (SELECT t.epoch, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch),
        {moments}
        snap AS (SELECT t.epoch{by}, count(*) AS n{sums} FROM t JOIN base ON base.epoch <= t.epoch GROUP BY t.epoch{by}),
        points AS (SELECT epoch, fraction, ln(fraction) AS x, ln(CAST(sum(n) AS DOUBLE) / count(*)) AS y FROM snap JOIN f USING (epoch) GROUP BY epoch, fraction),
        line AS (SELECT epoch, fraction, CASE WHEN regr_count(y, x) OVER w > 1 THEN regr_slope(y, x) OVER w ELSE 0 END AS power, regr_count(y, x) OVER w AS c, regr_sxx(y, x) OVER w AS sxx,
                 regr_sxy(y, x) OVER w AS sxy, regr_syy(y, x) OVER w AS syy FROM points WINDOW w AS (ORDER BY epoch)),
        fit AS (SELECT epoch, fraction, power, (syy - sxy * sxy / nullif(sxx, 0)) / (c * nullif(sxx, 0)) AS slope_var FROM line),
        counted AS (SELECT *, CASE WHEN power = 0 THEN CAST(n AS DOUBLE) ELSE round(n / pow(fraction, power)) END AS n_final FROM snap JOIN fit USING (epoch){join}),
        spread AS (SELECT *{spread} FROM counted),
        scaled AS (SELECT *{final}{var} FROM spread)"""


def oracle(plan: Plan) -> str:
    keys = "".join(f", {k}" for k in plan.keys)
    source = "scaled"
    if plan.totals:
        source = f"(SELECT *, {', '.join(f'{e} OVER (PARTITION BY epoch) AS {n}' for n, e in plan.totals.items())} FROM scaled)"
    text = f"{oracle_ctes(plan)} SELECT epoch{keys}{''.join(f', {e} AS {n}' for n, e in plan.result.items())} FROM {source} {'WHERE ' + plan.where if plan.where else ''} {'QUALIFY ' + plan.qualify if plan.qualify else ''}"
    return text.replace(WHOLE, "lineitem")


def shuffled_oracle(plan: Plan, order: Sequence[int]) -> str:
    """The same where the chunks come in another order."""
    place = f"CAST(list_position({list(order)}, CAST({KEYS[plan.table]} % {P} AS INT)) - 1 AS INT) AS epoch"
    return oracle(plan).replace(f"CAST({KEYS[plan.table]} % {P} AS INT) AS epoch", place)


def half(variance: str, estimate: str) -> str:
    """Relative half width of the interval, rounded so that both engines agree."""
    return f"round({chebyshev()} * sqrt(greatest({variance}, 0)) / nullif(abs({estimate}), 0), 5)"


def ratio_var(a: str, b: str) -> str:
    x, y = f"{a}_sum", f"{b}_sum"
    return f"({x}/{y})*({x}/{y})*({x}_var/nullif({x}*{x},0) + {y}_var/nullif({y}*{y},0) - 2*{a}_{b}_cov/nullif({x}*{y},0))"


def mean_half(c: str) -> str:
    """Relative half width for an average: the ratio of a scaled sum and the scaled count, whose covariance
    is the mean times the count's variance."""
    x = f"{c}_sum"
    relative = f"({x}_var/nullif({x}*{x},0) + n_final_var/nullif(n_final*n_final,0) - 2*n_final_var*({x}/n_final)/nullif({x}*n_final,0))"
    return f"round({chebyshev()} * sqrt(greatest({relative}, 0)), 5)"


Q1 = f"SELECT {EPOCH}, l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(4,0)) AS qty, {PRICE} AS price, {REVENUE} AS disc, CAST(l_discount AS DECIMAL(4,2)) AS off FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'"
Q5 = f"""SELECT {EPOCH}, n_name, {REVENUE} AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND {Q5_WHEN}"""
Q6 = f"SELECT {EPOCH}, {PRICE} * CAST(l_discount AS DECIMAL(4,2)) AS v FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24"
Q8 = f"""SELECT {EPOCH}, CAST(year(o_orderdate) AS INT) AS o_year, CASE WHEN n2.n_name IN ('NATION_3', 'NATION_8', 'NATION_15') THEN {REVENUE} ELSE 0 END AS own, {REVENUE} AS volume
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
    JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'"""
Q14 = f"SELECT {EPOCH}, CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END AS promo, {REVENUE} AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {Q14_WHEN}"
LATE = "l_shipdate > o_orderdate + INTERVAL '60' DAY"
SUM = {"revenue": "round(v_sum, 2)"}

PLANS: dict[str, Plan] = {
    "prog_q1": Plan(Q1, ["l_returnflag", "l_linestatus"], ["qty", "price", "disc"], {"sum_qty": "round(qty_sum, 2)", "sum_base_price": "round(price_sum, 2)", "sum_disc_price": "round(disc_sum, 2)", "avg_qty": "round(qty_sum / n_final, 6)", "avg_price": "round(price_sum / n_final, 4)", "count_order": "n_final"}),
    "prog_q4": Plan(
        f"SELECT CAST(o_orderkey % {P} AS INT) AS epoch, o_orderpriority FROM orders WHERE {Q4_WHEN} AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {LATE})",
        ["o_orderpriority"], [], {"order_count": "n_final"}, table="orders"),
    "prog_q5": Plan(Q5, ["n_name"], ["v"], SUM),
    "prog_q6": Plan(Q6, [], ["v"], SUM),
    "prog_q7": Plan(
        f"""SELECT {EPOCH}, n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {REVENUE} AS v
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_name IN ('NATION_3', 'NATION_8') AND n2.n_name IN ('NATION_3', 'NATION_8') AND n1.n_name <> n2.n_name AND {Q7_WHEN}""",
        ["supp_nation", "cust_nation", "l_year"], ["v"], SUM),
    "prog_q8": Plan(Q8, ["o_year"], ["own", "volume"], {"mkt_share": "round(own_sum / nullif(volume_sum, 0), 8)"}),
    "prog_q9": Plan(
        f"""SELECT {EPOCH}, n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, {REVENUE} AS v, ps_cost * CAST(l_quantity AS BIGINT) AS cents
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%ring%'""",
        ["nation", "o_year"], ["v", "cents"], {"sum_profit": "round(v_sum - cents_sum / 100, 1)"}),
    "prog_q12": Plan(
        f"""SELECT {EPOCH}, l_linestatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS high, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS low
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_shipdate > o_orderdate""",
        ["l_linestatus"], ["high", "low"], {"high_line_count": "round(high_sum, 3)", "low_line_count": "round(low_sum, 3)"}),
    "prog_q14": Plan(Q14, [], ["promo", "v"], {"promo_revenue": "round(100.0 * promo_sum / nullif(v_sum, 0), 8)"}),
    "prog_q17": Plan(
        f"""SELECT {EPOCH}, {PRICE} AS v FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM {WHOLE} l2 WHERE l2.l_partkey = p_partkey)""",
        [], ["v"], {"avg_yearly": "round(v_sum / 7.0, 2)"}),
    "prog_q19": Plan(
        f"""SELECT {EPOCH}, {REVENUE} AS v FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21) OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30)
           OR (p_brand = 'Brand#3' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 40)""", [], ["v"], SUM),
    "prog_q21": Plan(
        f"""SELECT CAST(l1.l_orderkey % {P} AS INT) AS epoch, s_name FROM supplier JOIN late l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND n_name IN ('NATION_3', 'NATION_8', 'NATION_15', 'NATION_20')
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM late l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey)""",
        ["s_name"], [], {"numwait": "n_final"}, with_=f"late AS (SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {LATE})"),
    "prog_q23": Plan(f"""SELECT {EPOCH}, {REVENUE} AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'""", [], ["v"], SUM),
    "prog_q24": Plan(f"""SELECT {EPOCH}, {REVENUE} AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND l_shipdate >= DATE '1996-10-01' AND l_shipdate < DATE '1997-10-01'""", [], ["v"], SUM),
    "prog_q25": Plan(f"""SELECT {EPOCH}, {REVENUE} AS v FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_8' AND {Q7_WHEN}""", [], ["v"], SUM),
    "prog_q26": Plan(f"""SELECT {EPOCH}, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS p,
        CAST(round(l_extendedprice) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS d FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'""",
        ["l_returnflag", "l_linestatus"], ["q", "p", "d"], {"sum_qty": "round(q_sum, 2)", "sum_base_price": "round(p_sum, 2)", "sum_disc_price": "round(d_sum, 0)", "count_order": "n_final"}),
    "prog_q27": Plan(f"""SELECT {EPOCH}, CAST(round(l_extendedprice) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS v FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND CAST(round(l_discount * 100) AS BIGINT) BETWEEN 5 AND 7 AND l_quantity < 24""", [], ["v"], SUM),
    "prog_q2": Plan(
        f"""SELECT CAST(p_partkey % {P} AS INT) AS epoch, s_acctbal, s_name, n_name, p_partkey, ps_cost FROM offer JOIN best ON p_partkey = k AND ps_cost = low""",
        ["s_acctbal", "s_name", "n_name", "p_partkey", "ps_cost"], [], {}, table="ps", scaled=False,
        with_="""offer AS (SELECT s_acctbal, s_name, n_name, p_partkey, ps_cost FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND p_size <= 25 AND p_type LIKE '%ARD'),
            best AS (SELECT p_partkey AS k, min(ps_cost) AS low FROM offer GROUP BY p_partkey)""",
        qualify="row_number() OVER (PARTITION BY epoch ORDER BY s_acctbal DESC, n_name, s_name, p_partkey) <= 100"),
    "prog_q3": Plan(
        f"""SELECT {EPOCH}, l_orderkey, o_orderdate, {REVENUE} AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15'""",
        ["l_orderkey", "o_orderdate"], ["v"], {"revenue": "v_sum"}, scaled=False, qualify="row_number() OVER (PARTITION BY epoch ORDER BY v_sum DESC, l_orderkey) <= 10"),
    "prog_q10": Plan(
        f"""SELECT {EPOCH}, c_custkey, c_name, c_acctbal, n_name, {REVENUE} AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'""",
        ["c_custkey", "c_name", "c_acctbal", "n_name"], ["v"], {"revenue": "v_sum"}, scaled=False, qualify="row_number() OVER (PARTITION BY epoch ORDER BY v_sum DESC, c_custkey) <= 20"),
    "prog_q11": Plan(
        f"""SELECT CAST(ps_partkey % {P} AS INT) AS epoch, ps_partkey, ps_cost * ps_qty AS cents FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name = 'NATION_8'""", ["ps_partkey"], ["cents"], {"value": "cents_sum / 100"}, table="ps", scaled=False,
        totals={"all_cents": "sum(cents_sum)"}, where="cents_sum > 0.001 * all_cents"),
    "prog_q18": Plan(
        f"""SELECT CAST(o_orderkey % {P} AS INT) AS epoch, c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(l_quantity AS BIGINT) AS q
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)""",
        ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"], ["q"], {"sum_qty": "q_sum"}, scaled=False,
        qualify="row_number() OVER (PARTITION BY epoch ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) <= 100"),
    "ci_q1": Plan(Q1, ["l_returnflag", "l_linestatus"], ["qty", "price", "disc"], {
        "sum_qty": "round(qty_sum, 2)", "qty_half": half("qty_sum_var", "qty_sum"), "price_half": half("price_sum_var", "price_sum"), "disc_half": half("disc_sum_var", "disc_sum"),
        "count_half": half("n_final_var", "n_final"), "avg_qty": "round(qty_sum / n_final, 6)", "avg_price": "round(price_sum / n_final, 4)",
        "avg_qty_half": mean_half("qty"), "avg_price_half": mean_half("price"), "cov_qty_price": "round(qty_price_cov / (qty_sum * price_sum), 8)"}, variance=True, where="epoch >= 2"),
    "ci_q5": Plan(Q5, ["n_name"], ["v"], SUM | {"half": half("v_sum_var", "v_sum")}, variance=True, where="epoch >= 2"),
    "ci_q6": Plan(Q6, [], ["v"], SUM | {"half": half("v_sum_var", "v_sum")}, variance=True, where="epoch >= 2"),
    "ci_q8": Plan(Q8, ["o_year"], ["own", "volume"], {"mkt_share": "round(own_sum / volume_sum, 8)", "half": f"round({chebyshev()} * sqrt(greatest({ratio_var('own', 'volume')}, 0)), 6)"}, variance=True, where="epoch >= 2"),
    "ci_q14": Plan(Q14, [], ["promo", "v"], {"promo_revenue": "round(100.0 * promo_sum / v_sum, 8)", "half": f"round({100 * chebyshev()} * sqrt(greatest({ratio_var('promo', 'v')}, 0)), 5)"}, variance=True, where="epoch >= 2"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(plan) for name, plan in PLANS.items()}
ORACLE_SQL: dict[str, str] = {name: oracle(plan) for name, plan in PLANS.items()}

# Queries whose second step works on every snapshot.
Q13 = Plan(f"SELECT CAST(o_orderkey % {P} AS INT) AS epoch, o_custkey FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%'", ["o_custkey"], [], {}, table="orders")
Q15 = Plan(f"SELECT {EPOCH}, l_suppkey, {REVENUE} AS v FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'", ["l_suppkey"], ["v"], {})


def prog_q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the predicted order counts, the growth fitted on matched orders; customers
    without an order so far count as 0."""
    seen = fitted(spark, sf_dir, Q13).groupBy("epoch", F.col("n_final").alias("c_count")).agg(F.count(F.lit(1)).alias("custdist"))
    register(spark, sf_dir, ["customer"])
    everyone = spark.table("customer").agg(F.count(F.lit(1)).alias("everyone"))
    none = seen.groupBy("epoch").agg(F.sum("custdist").alias("with_orders")).crossJoin(F.broadcast(everyone))
    none = none.select("epoch", F.lit(0.0).alias("c_count"), (F.col("everyone") - F.col("with_orders")).alias("custdist")).where("custdist > 0")
    return seen.unionByName(none)


def prog_q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top supplier of every snapshot, ties kept."""
    scaled = fitted(spark, sf_dir, Q15).select("epoch", "l_suppkey", F.round("v_sum", 2).alias("total_revenue"))
    best = scaled.groupBy("epoch").agg(F.max("total_revenue").alias("best"))
    return scaled.join(F.broadcast(best), "epoch").where("total_revenue = best").drop("best")


Q20 = Plan(
    f"""SELECT {EPOCH}, s_name, ps_partkey, ps_qty, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_name LIKE 'red%' AND n_name IN ('NATION_3', 'NATION_8', 'NATION_15') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01'""",
    ["s_name", "ps_partkey", "ps_qty"], ["q"], {}, where="ps_qty > 0.5 * q_sum", scaled=False)


def prog_q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with more stock of some part than half of what is shipped so far."""
    return run(Q20)(spark, sf_dir).select("epoch", "s_name").distinct()


def prog_q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a recent order among the epochs read: a customer leaves at the epoch of
    its first such order, so the first epoch decides and no snapshot is joined again."""
    register(spark, sf_dir, ["customer", "orders"])
    first = spark.sql(f"SELECT o_custkey, min(CAST(o_orderkey % {P} AS INT)) AS gone FROM orders WHERE o_orderdate >= DATE '2001-01-01' GROUP BY o_custkey")
    chosen = spark.sql("SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer WHERE c_nationkey IN (3, 7, 8, 13, 15, 18, 20)")
    mean = chosen.where("bal > 0").agg((F.sum("bal").cast("double") / F.count(F.lit(1))).alias("mean"))
    rich = chosen.crossJoin(F.broadcast(mean)).where(F.col("bal").cast("double") > F.col("mean")).drop("mean")
    until = F.coalesce("gone", F.lit(P))
    rows = rich.join(first, rich.c_custkey == first.o_custkey, "left").where(until > 0).select("c_nationkey", "bal", F.explode(F.sequence(F.lit(0), until - 1)).alias("epoch"))
    return rows.groupBy("epoch", F.col("c_nationkey").alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), F.sum("bal").cast("double").alias("totacctbal"))


def prog_q30(depth: int) -> Callable[[SparkSession, str], DataFrame]:
    """Nested aggregation at every epoch, sums scaled at every level: the innermost level is a
    snapshot, every further one groups it by ``epoch`` too, and its growth is that of its own groups."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, ["lineitem"])
        own = [f"CAST(({DEEP_KEYS[i]}) % 4 AS INT) AS k{i + 1}" for i in range(depth)]
        keys = [f"k{i}" for i in range(depth, 0, -1)]
        inner = "sum" if depth % 2 == 0 else "max"
        rows = spark.table("lineitem").selectExpr(EPOCH, *own, "CAST(l_quantity AS BIGINT) AS x")
        snap = snapshots(rows, keys, ["x"] if inner == "sum" else [], P, maxs=[] if inner == "sum" else ["x"])
        out = snap.select("epoch", *keys, "group_rows", F.col(f"x_{inner}").cast("double").alias("x_sum"))
        with scratch(spark) as keep:
            done = materialize(progress(spark.sql(LINES), P), "deep-progress")
            for level in range(depth, -1, -1):
                if level < depth:
                    out = out.groupBy("epoch", *keys[depth - level :]).agg(F.count(F.lit(1)).alias("group_rows"), (F.sum if level % 2 == 0 else F.max)("x_sum").alias("x_sum"))
                if level % 2 == 0:
                    out = materialize(out, f"deep-{level}")
                    out = scale(out, growth_fit(out, done), ["x"])
            out = keep(materialize(out.select("epoch", F.round("x_sum", 2).alias("x")), "deep"))
        return out

    return query


def deep_oracle(depth: int) -> str:
    keys = [f"k{i}" for i in range(depth, 0, -1)]
    own = "".join(f", CAST(({DEEP_KEYS[i]}) % 4 AS INT) AS k{i + 1}" for i in range(depth))
    ctes = [
        f"scan AS ({LINES}), t AS (SELECT CAST(range AS INT) AS epoch FROM range({P}))",
        "f AS (SELECT t.epoch, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scan) AS fraction FROM t JOIN scan ON scan.epoch <= t.epoch GROUP BY t.epoch)",
        f"s{depth + 1} AS (SELECT t.epoch{own}, CAST(l_quantity AS DOUBLE) AS x FROM t JOIN lineitem ON l_orderkey % {P} <= t.epoch)",
    ]
    for level in range(depth, -1, -1):
        by = "".join(f", {k}" for k in keys[depth - level :])
        how = "sum" if level % 2 == 0 else "max"
        ctes.append(f"a{level} AS (SELECT epoch{by}, {how}(x) AS x, count(*) AS n FROM s{level + 1} GROUP BY epoch{by})")
        if how == "max":
            ctes.append(f"s{level} AS (SELECT epoch{by}, x FROM a{level})")
            continue
        ctes.append(f"p{level} AS (SELECT epoch, fraction, ln(fraction) AS u, ln(CAST(sum(n) AS DOUBLE) / count(*)) AS v FROM a{level} JOIN f USING (epoch) GROUP BY epoch, fraction)")
        ctes.append(f"g{level} AS (SELECT epoch, fraction, CASE WHEN regr_count(v, u) OVER w > 1 THEN regr_slope(v, u) OVER w ELSE 0 END AS power FROM p{level} WINDOW w AS (ORDER BY epoch))")
        ctes.append(f"s{level} AS (SELECT epoch{by}, x / n * CASE WHEN power = 0 THEN CAST(n AS DOUBLE) ELSE round(n / pow(fraction, power)) END AS x FROM a{level} JOIN g{level} USING (epoch))")
    return f"WITH {', '.join(ctes)} SELECT epoch, round(x, 2) AS x FROM s0"


#: Plans that are also run chunk by chunk, and an order of the chunks drawn beforehand.
CHUNKED = ("prog_q1", "prog_q2", "prog_q4", "prog_q5", "prog_q6", "prog_q8", "prog_q9", "prog_q14", "prog_q17", "prog_q21", "ci_q6")
DRAWN = (7, 2, 9, 0, 5, 3, 8, 1, 6, 4)
DEPTHS = (1, 2, 3, 5, 10)
QUERIES |= {f"chunks_{n.removeprefix('prog_')}": in_chunks(PLANS[n]) for n in CHUNKED} | {"chunks_q6_drawn": in_chunks(PLANS["prog_q6"], DRAWN)}
ORACLE_SQL |= {f"chunks_{n.removeprefix('prog_')}": oracle(PLANS[n]) for n in CHUNKED} | {"chunks_q6_drawn": shuffled_oracle(PLANS["prog_q6"], DRAWN)}
QUERIES |= {"prog_q13": prog_q13, "prog_q20": prog_q20, "prog_q15": prog_q15, "prog_q22": prog_q22} | {f"prog_q30_d{d}": prog_q30(d) for d in DEPTHS}
ORACLE_SQL |= {
    "prog_q13": f"""{oracle_ctes(Q13)}, c AS (SELECT epoch, n_final AS c_count, count(*) AS custdist FROM scaled GROUP BY epoch, n_final)
        SELECT * FROM c UNION ALL SELECT epoch, 0.0 AS c_count, CAST((SELECT count(*) FROM customer) - sum(custdist) AS BIGINT) AS custdist FROM c GROUP BY epoch HAVING (SELECT count(*) FROM customer) > sum(custdist)""",
    "prog_q15": f"{oracle_ctes(Q15)}, r AS (SELECT epoch, l_suppkey, round(v_sum, 2) AS total_revenue FROM scaled) SELECT * FROM r WHERE total_revenue = (SELECT max(total_revenue) FROM r r2 WHERE r2.epoch = r.epoch)",
    "prog_q20": f"SELECT DISTINCT epoch, s_name FROM ({oracle(Q20)})",
    "prog_q22": f"""WITH c AS (SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer WHERE c_nationkey IN (3, 7, 8, 13, 15, 18, 20)),
        t AS (SELECT CAST(range AS INT) AS epoch FROM range({P}))
        SELECT t.epoch, c_nationkey AS cntrycode, count(*) AS numcust, CAST(sum(bal) AS DOUBLE) AS totacctbal FROM c, t
        WHERE CAST(bal AS DOUBLE) > (SELECT CAST(sum(bal) AS DOUBLE) / count(*) FROM c WHERE bal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01' AND o_orderkey % {P} <= t.epoch)
        GROUP BY t.epoch, c_nationkey""",
} | {f"prog_q30_d{d}": deep_oracle(d) for d in DEPTHS}
