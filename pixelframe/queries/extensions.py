"""Relational operations that have no counterpart among the image operators, under names of their own. Not parity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.grids import table


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1, 2")
def ext_group(spark, sf_dir):
    """Grouped aggregation."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey group by n_name")
def ext_join(spark, sf_dir):
    """A join with a small table; the planner picks its form from the sizes."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    """Rollup."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int as place, lag(value) over (partition by user_id order by ts, event_id) as before from events")
def ext_window(spark, sf_dir):
    """Ranking and lag."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).alias("place"), F.lag("value").over(w).alias("before"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def ext_anti_join(spark, sf_dir):
    """Rows without a partner."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select date_trunc('day', ts)::varchar as day, event_type, count(*) as n from events group by 1, 2")
def ext_dates(spark, sf_dir):
    """Counts by day."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("day"), "event_type").agg(F.count("*").alias("n"))
