"""Adapter views: the given tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TABLES: dict[tuple[str, str], DataFrame] = {}


_WORTH_SPREADING = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its file listing and schema are read once per session.

    A table of many rows in a few splits only is spread over the cores. A table with
    enough splits is read as it is, without a shuffle.
    """
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        df = spark.read.parquet(key[1])
        cores = spark.sparkContext.defaultParallelism
        if 3 * df.rdd.getNumPartitions() <= cores and df.count() >= _WORTH_SPREADING:
            df = df.repartition(cores)
        _TABLES[key] = df
    return _TABLES[key]


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows and region 5, at every scale
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")
    )


def technicians(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("technician_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("SKILL_"), (k % 8).cast("string")).alias("primary_skill"),
        "city",
        "state",
        (F.lit(40.0) + (k * 7919) % 1000 / F.lit(1000.0)).alias("latitude"),
        (F.lit(-75.0) + (k * 104729) % 1000 / F.lit(1000.0)).alias("longitude"),
        (4 + k % 5).alias("workload_capacity"),
        ((k * 3) % 9).alias("current_assignments"),
    )


def tech_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per technician and day that the line items mention."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("technician_id"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("available"),
        F.max("l_linenumber").alias("max_assignments"),
        (F.min("l_linenumber") + 6).alias("start_hour"),
        (F.min("l_linenumber") + 14).alias("end_hour"),
    )


def dispatches(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    o = orders if orders is not None else table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    place = F.broadcast(_places(spark, sf_dir))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return (
        o.join(c, cust == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("dispatch_id"),
            F.when(F.col("o_orderstatus") == "F", "Order")
            .when(F.col("o_orderstatus") == "O", "Trouble")
            .otherwise("Maintenance")
            .alias("ticket_type"),
            F.when(key % 4 == 0, "install").when(key % 4 == 1, "repair").when(key % 4 == 2, "upgrade")
            .otherwise("maintenance").alias("order_type"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
            .when(F.col("o_orderpriority") == "2-HIGH", "High")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
            .when(F.col("o_orderpriority") == "5-LOW", "Low")
            .otherwise("Normal")
            .alias("priority"),
            F.concat(F.lit("SKILL_"), (cust % 9).cast("string")).alias("required_skill"),
            F.when(F.col("o_orderstatus") == "F", "Closed")
            .when(F.col("o_orderstatus") == "O", "Pending")
            .otherwise("pending")
            .alias("status"),
            "city",
            "state",
            F.when(key % 97 != 0, F.lit(40.0) + (cust * 6151) % 1000 / F.lit(1000.0)).alias("customer_latitude"),
            (F.lit(-75.0) + (cust * 3571) % 1000 / F.lit(1000.0)).alias("customer_longitude"),
            F.expr("o_orderdate + INTERVAL '1' HOUR * CAST(6 + o_orderkey % 16 AS INT)").alias("appointment_start"),
            (30 * (1 + key % 6)).alias("duration_min"),
            F.when(key % 11 == 0, "").when(key % 13 == 0, "0").alias("prior_technician_id"),
        )
    )


def dispatch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag", "l_discount"
    )
    d = dispatches(spark, sf_dir).select(
        F.col("dispatch_id").alias("o_id"), "ticket_type", "order_type", "priority", "city", "state",
        "customer_latitude", "customer_longitude",
    )
    return li.join(d, F.col("l_orderkey") == F.col("o_id")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("dispatch_id"),
        F.col("l_suppkey").alias("assigned_technician_id"),
        "ticket_type",
        "order_type",
        "priority",
        F.concat(F.lit("SKILL_"), (F.col("l_partkey") % 9).cast("string")).alias("required_skill"),
        F.col("city").alias("dispatch_city"),
        F.col("state").alias("dispatch_state"),
        "customer_latitude",
        "customer_longitude",
        F.expr("l_shipdate + INTERVAL '1' HOUR * CAST(6 + l_orderkey % 16 AS INT)").alias("appointment_start"),
        (30 * (1 + F.col("l_linenumber"))).alias("duration_min"),
        F.when(F.col("l_quantity") != 50, F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("productive_dispatch"),
        F.when(F.col("l_discount") < 0.05, 1).otherwise(0).alias("first_time_fix"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dispatch, technician) pairs that the line items propose: one pair per order and supplier."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("dispatch_id"), F.col("l_suppkey").alias("technician_id"))
        .distinct()
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exposures of a long cube (exposure, w, y, x, flux): 64 channels per embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("w", "v"))
    vid = F.col("vec_id")
    return e.select(
        F.when(vid % 2 == 0, "exp1").otherwise("exp2").alias("exposure"),
        "w",
        F.floor(vid / F.lit(40.0)).cast("int").alias("y"),
        F.floor((vid % 40) / F.lit(2.0)).cast("int").alias("x"),
        (F.lit(100.0) * (F.col("v").cast("double") + F.lit(0.2))).alias("flux"),
    )


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("pid"),
        (((k * 7919) % 10007).cast("double") / 10007).alias("px"),
        (((k * 6151 + 17) % 10009).cast("double") / 10009).alias("py"),
        F.when(k % 2 == 0, 0.1).otherwise(-0.1).alias("vx"),
        F.when(k % 3 == 0, 0.1).otherwise(-0.1).alias("vy"),
        (F.lit(1.0) + k % 5).alias("mass"),
    )


def labeled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding")[0].cast("double").alias("x1"),
        F.col("embedding")[1].cast("double").alias("x2"),
        F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"),
    )
