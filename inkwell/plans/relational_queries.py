"""Registered queries over the relational core: every kind of statement that the SQL verb reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
#: Suppliers that a task of sql_theta_join holds at once, and into how many parts a nation's customers are dealt.
BLOCK, ACROSS = 4096, 16


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


@query("SELECT c_mktsegment, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
def sql_inner_join(spark, sf_dir):
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def sql_left_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT n_name, s_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def sql_full_join(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier", "nation")
    return s.where("s_acctbal > 5000").join(n.where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("n_name", "s_name")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_name < b.r_name")
def sql_cross_join(spark, sf_dir):
    (r,) = _t(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(r.select(F.col("r_name").alias("b"))).where("a < b")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def sql_semi_join(spark, sf_dir):
    p, li = _t(spark, sf_dir, "part", "lineitem")
    return p.join(li.where("l_quantity >= 49"), p.p_partkey == li.l_partkey, "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)")
def sql_anti_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 250000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON (s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000) OR s_suppkey = c_custkey")
def sql_theta_join(spark, sf_dir):
    """A disjunction as the union of two joins on equality, which shuffle by key; as one condition it would compare all pairs.

    The pairs grow with the square of a nation's rows, so none is kept for DISTINCT: of a key's rows in a nation the
    best balance decides, pairs of equal keys come from the second join, and only keys of several nations on both sides
    can meet twice. A nation's pairs are made in blocks, of which a task holds one block of suppliers.
    """
    s, c = _t(spark, sf_dir, "supplier", "customer")
    several = lambda key: F.count("*").over(Window.partitionBy(key)) > 1
    sn = s.where("s_nationkey is not null").groupBy("s_suppkey", "s_nationkey").agg(F.max("s_acctbal").alias("s_acctbal")).withColumn("s_more", several("s_suppkey"))
    cn = c.where("c_nationkey is not null").groupBy("c_custkey", "c_nationkey").agg((F.min("c_acctbal") + 9000).alias("least")).withColumn("c_more", several("c_custkey"))
    # Only rows that have a partner in their nation; a block of suppliers for each BLOCK of them in the largest nation.
    sn = sn.join(cn.groupBy("c_nationkey").agg(F.min("least").alias("lowest")), F.col("s_nationkey") == F.col("c_nationkey")).where("s_acctbal > lowest").drop("c_nationkey", "lowest")
    cn = cn.join(sn.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top")), F.col("s_nationkey") == F.col("c_nationkey")).where("least < top").drop("s_nationkey", "top")
    rows = sn.groupBy("s_nationkey").count().agg(F.max("count")).first()[0] or 0
    down = -(-rows // BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    sn = sn.withColumn("s_i", part("s_suppkey", down)).withColumn("s_j", every(ACROSS))
    cn = cn.withColumn("c_i", every(down)).withColumn("c_j", part("c_custkey", ACROSS))
    pairs = ["s_suppkey", "c_custkey"]

    def met(cn: DataFrame, sn: DataFrame) -> DataFrame:
        block = (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_i") == F.col("c_i")) & (F.col("s_j") == F.col("c_j"))
        return cn.join(sn.hint("merge"), block & (F.col("s_acctbal") > F.col("least")) & F.coalesce(F.col("s_suppkey") != F.col("c_custkey"), F.lit(True)))

    once = met(cn, sn).where(~(F.col("s_more") & F.col("c_more"))).select(pairs)
    again = met(cn.where("c_more"), sn.where("s_more")).select(pairs).distinct()
    same = s.select("s_suppkey").distinct().join(c.select("c_custkey").distinct(), F.col("s_suppkey") == F.col("c_custkey"))
    return once.unionAll(again).unionAll(same.select(pairs))


@query("SELECT user_id, event_id, value, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS before FROM events")
def sql_window_lag(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "value", F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(-1)).alias("before"))


@query("""SELECT o_orderkey, coalesce((SELECT max_by(event_id, (ts, event_id)) FROM events WHERE user_id = o_custkey % 150 AND ts <= o_orderdate), -1) AS event_id FROM
(SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 8000 DAY - INTERVAL (CAST(o_orderkey % 1000 AS INTEGER)) DAY AS o_orderdate FROM orders)""")
def sql_asof(spark, sf_dir):
    """As-of lookup: both sides in one window by key and time, so no pair of a key's rows is made."""
    o, e = _t(spark, sf_dir, "orders", "events")
    when = F.col("o_orderdate") + F.expr("INTERVAL 8000 DAY") - F.make_interval(days=(F.col("o_orderkey") % 1000).cast("int"))
    asked = o.select((F.col("o_custkey") % 150).alias("user_id"), when.alias("ts"), F.lit(1).alias("side"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    known = e.select("user_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asked.unionByName(known).withColumn("last", F.last("event_id", True).over(w)).where("side = 1").select("o_orderkey", F.coalesce("last", F.lit(-1)).alias("event_id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
def sql_group_having(spark, sf_dir):
    (li,) = _t(spark, sf_dir, "lineitem")
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))
    return out.where("n > 10")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def sql_rollup(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def sql_cube(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS without_status FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def sql_grouping_sets(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    out = o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("without_status"))
    return out


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
def sql_right_join(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.where("o_totalprice > 100000").join(c, o.o_custkey == c.c_custkey, "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE place <= 3")
def sql_window_top3(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    run = F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"), run.alias("running")).where("place <= 3")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def sql_sort_limit_offset(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    return p.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(10)


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def sql_set_operations(spark, sf_dir):
    c, s, n = _t(spark, sf_dir, "customer", "supplier", "nation")
    both = c.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    return both.unionAll(n.select("n_nationkey").subtract(c.where("c_acctbal > 9900").select("c_nationkey")))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def sql_distinct(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    return p.select("p_brand", "p_size").distinct()


@query("WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")
def sql_recursive(spark, sf_dir):
    return spark.sql("WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def sql_subqueries(spark, sf_dir):
    _t(spark, sf_dir, "orders")[0].createOrReplaceTempView("ink_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM ink_orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM ink_orders i WHERE i.o_custkey = o.o_custkey) AND o_totalprice > (SELECT avg(o_totalprice) FROM ink_orders)")


@query("SELECT p_partkey, lower(substr(p_name, 1, 8)) AS head, CAST(length(p_name) AS INTEGER) AS size, upper(p_type) AS kind FROM part WHERE p_name ILIKE '%A%' AND p_type NOT LIKE 'X%' AND regexp_matches(p_brand, '^Brand')")
def sql_strings(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    p = p.where(F.col("p_name").ilike("%A%") & ~F.col("p_type").like("X%") & F.col("p_brand").rlike("^Brand"))
    return p.select("p_partkey", F.lower(F.substring("p_name", 1, 8)).alias("head"), F.length("p_name").alias("size"), F.upper("p_type").alias("kind"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def sql_dates(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    e = e.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, floor(l_quantity / 7) AS weeks, abs(l_discount - 0.05) < 0.005 AS usual FROM lineitem")
def sql_math(spark, sf_dir):
    (li,) = _t(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", F.round(price, 6).alias("charge"), F.floor(F.col("l_quantity") / 7).cast("double").alias("weeks"), (F.abs(F.col("l_discount") - 0.05) < 0.005).alias("usual"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def sql_json(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def sql_parameters(spark, sf_dir):
    _t(spark, sf_dir, "customer")[0].createOrReplaceTempView("ink_customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM ink_customer WHERE c_mktsegment = ? AND c_acctbal > ?", args=["BUILDING", 1000])


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def sql_sessions(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1)
    runs = e.withColumn("g", gap).withColumn("s", F.sum("g").over(w)).groupBy("user_id", "s").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
