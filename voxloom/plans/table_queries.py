"""Queries of ordering, selection, set and header operators over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.scalar import saturated
from voxloom.operators import relational
from voxloom.plans.views import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 0.6 + p_retailprice * 0.8, p_partkey) AS INTEGER) AS slice FROM part""")
def slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a stack by their position along the normal."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_size") * 0.6 + F.col("p_retailprice") * 0.8, "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", rank.alias("slice"))


@query("""SELECT p_brand, p_size, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS INTEGER) AS volume FROM part""")
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices at one position belong to different volumes."""
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", rank.alias("volume"))


@query("""SELECT p_brand, CAST(floor(p_retailprice / 100 + 0.5) AS BIGINT) AS cell, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY 1, 2""")
def header_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that agree within a tolerance, by quantised value; the first one names the group."""
    cell = F.floor(F.col("p_retailprice") / 100 + 0.5).alias("cell")
    return table(spark, sf_dir, "part").groupBy("p_brand", cell).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query("""SELECT p_brand, arg_max(p_partkey, (p_size, p_retailprice, p_partkey)) AS best FROM part GROUP BY p_brand""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest, then dearest, then newest of each group."""
    best = F.max_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best.alias("best"))


@query("SELECT o_custkey, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_artefact(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), newest.alias("o_orderkey"))


@query("""SELECT CASE WHEN p_type LIKE '%PROMO%' THEN 'mosaic' WHEN p_type LIKE '%STANDARD%' THEN 'standard' WHEN p_type LIKE '%SMALL%' THEN 'tomographic' WHEN p_type LIKE '%LARGE%' THEN 'spectroscopy' WHEN p_size < 5 THEN 'guff' ELSE 'multiframe' END AS class, count(*) AS n FROM part GROUP BY 1""")
def header_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each header in the first class that it fits."""
    kind = F.when(F.col("p_type").contains("PROMO"), "mosaic").when(F.col("p_type").contains("STANDARD"), "standard").when(F.col("p_type").contains("SMALL"), "tomographic").when(F.col("p_type").contains("LARGE"), "spectroscopy").when(F.col("p_size") < 5, "guff").otherwise("multiframe")
    return table(spark, sf_dir, "part").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT s.s_suppkey, coalesce(n.n_name, 'unknown') AS name FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON n.n_nationkey = s.s_nationkey""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to names, with a default for those that the dictionary lacks."""
    names = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 20).select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf_dir, "supplier").join(names, "s_nationkey", "left")
    return rows.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v > 127 THEN 127 WHEN v < -128 THEN -128 ELSE v END AS TINYINT) AS v FROM (
SELECT l_orderkey, l_linenumber, CAST(sign(q) * floor(abs(q) + 0.5) AS INTEGER) AS v FROM (SELECT *, l_quantity * 6 - 150.5 AS q FROM lineitem))""")
def saturating_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = saturated(F.col("l_quantity") * 6 - 150.5, -128, 127, "tinyint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


@query("""SELECT DISTINCT l_returnflag AS flag, 'union' AS kind FROM lineitem UNION ALL (SELECT o_orderstatus, 'intersect' FROM orders INTERSECT SELECT l_linestatus, 'intersect' FROM lineitem)
UNION ALL (SELECT o_orderstatus, 'except' FROM orders EXCEPT SELECT l_linestatus, 'except' FROM lineitem)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # flags of both tables are counted as one list, as in a join all rows of a flag would meet in one task
    listed = orders.select(F.col("o_orderstatus").alias("flag"), F.lit(True).alias("order")).union(lines.select("l_linestatus", F.lit(False)))
    status = listed.groupBy("flag").agg(F.bool_or("order").alias("order"), F.bool_and("order").alias("only")).filter("order")
    returned = lines.select(F.col("l_returnflag").alias("flag")).distinct().withColumn("kind", F.lit("union"))
    return returned.union(status.select("flag", F.when(F.col("only"), "except").otherwise("intersect").alias("kind")))


@query("""SELECT o_orderkey, round(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10 / 365.25) / 10 AS age FROM orders""")
def anonymised_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates replaced by an age."""
    return table(spark, sf_dir, "orders").select("o_orderkey", relational.age_years(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("age"))


@query("""SELECT o_custkey, round(corr(o_totalprice, o_orderkey), 5) AS r, round(avg(abs(o_totalprice - o_orderkey)), 3) AS mae FROM orders GROUP BY o_custkey HAVING count(*) > 2""")
def column_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and mean absolute difference of two columns."""
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.corr("o_totalprice", "o_orderkey").alias("r"), F.avg(F.abs(F.col("o_totalprice") - F.col("o_orderkey"))).alias("mae"), F.count("*").alias("n"))
    return got.filter(F.col("n") > 2).select("o_custkey", F.round("r", 5).alias("r"), F.round("mae", 3).alias("mae"))


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS position FROM events""")
def cumulative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("position"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def binned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in tumbling windows of one scan."""
    rows = table(spark, sf_dir, "events")
    got = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
