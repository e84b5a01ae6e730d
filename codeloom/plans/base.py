"""Registration of named queries and the graphs that the driver's tables hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n(col=None):
    return F.count(F.lit(1)) if col is None else F.count(col)


def supplies(spark, d) -> DataFrame:
    """Suppliers to parts, one edge per pair."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def geography(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions to nations to customers and suppliers; ids are kind times 10^9 plus key."""
    base = 10**9
    c = lambda name, k: (F.col(name).cast("long") + k * base)
    nation, customer, supplier = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    edges = nation.select(c("n_regionkey", 0).alias("src"), c("n_nationkey", 1).alias("dst"))
    edges = edges.unionByName(customer.select(c("c_nationkey", 1).alias("src"), c("c_custkey", 2).alias("dst")))
    edges = edges.unionByName(supplier.select(c("s_nationkey", 1).alias("src"), c("s_suppkey", 3).alias("dst")))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes, edges


GEO_SQL = """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) + 1000000000 AS dst FROM nation
UNION ALL SELECT CAST(c_nationkey AS BIGINT) + 1000000000, c_custkey + 2000000000 FROM customer
UNION ALL SELECT CAST(s_nationkey AS BIGINT) + 1000000000, s_suppkey + 3000000000 FROM supplier"""


def event_flow(spark, d) -> tuple[DataFrame, DataFrame]:
    """Event types and how often one follows another for a user, as ids in name order and weighted edges."""
    events = table(spark, d, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(before.alias("a"), F.col("event_type").alias("b")).where("a is not null").groupBy("a", "b").agg(n().alias("weight"))
    ids = F.create_map(*[F.lit(x) for i, t in enumerate(EVENT_TYPES) for x in (t, i)])
    edges = pairs.select(F.element_at(ids, F.col("a")).cast("long").alias("src"), F.element_at(ids, F.col("b")).cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return spark.range(len(EVENT_TYPES)).select("id"), edges


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FLOW_SQL = """SELECT list_position(['click','error','purchase','signup','view'], a) - 1 AS src, list_position(['click','error','purchase','signup','view'], b) - 1 AS dst, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) WHERE a IS NOT NULL GROUP BY 1, 2"""


def turns(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversation turns, each followed by the next one."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "conv_id").distinct()
    nxt = F.lead("id").over(Window.partitionBy("conv_id").orderBy("id"))
    return rows.select("id"), rows.select(F.col("id").alias("src"), nxt.alias("dst")).where("dst is not null")


TURNS_SQL = "SELECT id, conv_id, lead(id) OVER (PARTITION BY conv_id ORDER BY id) AS dst FROM (SELECT DISTINCT conv_id * 10000 + turn AS id, conv_id FROM conversations)"


def part_symbols(spark, d) -> DataFrame:
    """Parts as symbols: brand is the file, type the kind, size the complexity."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("kind"), F.col("p_size").alias("complexity"), F.col("p_retailprice").alias("price"))
