"""Queries over the event log and the order tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslane.operators import sessions as E
from corpuslane.runtime import local_folder, table
from corpuslane.sources import files
from corpuslane.streaming import rollup

QUERIES, ORACLE = {}, {}
EV = "e AS (SELECT DISTINCT * FROM events WHERE event_id IS NOT NULL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir):
    return E.distinct_events(table(spark, sf_dir, "events"))


@query(f"""WITH {EV} SELECT user_id, count(*) AS events, count_if(event_type = 'error') AS failures, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, round(sum(value), 4) AS total_value, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_max(event_type, (ts, event_id)) AS last_kind, CASE WHEN bool_or(event_type = 'purchase') THEN 'complete' ELSE 'open' END AS state FROM e GROUP BY user_id""")
def str_manifest(spark, sf_dir):
    return E.manifest(events(spark, sf_dir))


@query(f"WITH {EV} SELECT user_id, event_id, value FROM e WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win_last_click(spark, sf_dir):
    return E.last_matching(events(spark, sf_dir), "click")


@query(f"WITH {EV}, l AS (SELECT user_id, max((ts, event_id)) AS m FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) AS events FROM e JOIN l USING (user_id) WHERE (e.ts, e.event_id) > l.m GROUP BY 1")
def jn_after_last_purchase(spark, sf_dir):
    return E.after_last(events(spark, sf_dir), "purchase")


@query(f"WITH {EV} SELECT event_id, user_id, event_type FROM e WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def str_cursor_page(spark, sf_dir):
    return E.page(events(spark, sf_dir), 500, 100).select("event_id", "user_id", "event_type")


@query(f"WITH {EV} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2")
def str_tumbling(spark, sf_dir):
    return E.windows(events(spark, sf_dir), "6 hours")


@query(f"WITH {EV}, x AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(CAST(d AS INT)) AS start, ts, event_type, value FROM e CROSS JOIN range(0, 2) r(d)) SELECT start, event_type, count(*) AS events, round(avg(value), 6) AS mean FROM x GROUP BY 1, 2")
def str_sliding(spark, sf_dir):
    return E.windows(events(spark, sf_dir), "2 days", "1 day")


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM e WHERE user_id IS NOT NULL), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM i GROUP BY user_id, n""")
def str_sessions(spark, sf_dir):
    return E.sessions(events(spark, sf_dir), 3600)


@query(f"WITH {EV}, k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM e) SELECT event_type, key, count(*) AS n, round(sum(try_cast(json_extract_string(props, key) AS DOUBLE)), 4) AS total FROM k GROUP BY 1, 2")
def scl_json_props(spark, sf_dir):
    return E.props_totals(events(spark, sf_dir))


@query(f"WITH {EV} SELECT event_id, user_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR), 5, '0') AS seq FROM e WHERE user_id IS NOT NULL")
def str_numbered(spark, sf_dir):
    return E.numbered(events(spark, sf_dir)).select("event_id", "seq")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 3) AS total FROM (SELECT DISTINCT * FROM events) GROUP BY 1, 2")
def str_stream_rollup(spark, sf_dir):
    stream = rollup.windowed(rollup.read_events(spark, sf_dir, "events.parquet"), "1 day", "40 days")
    out = rollup.run_available(stream, ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 3).alias("total"))


@query("SELECT count(*) AS scanned, count(*) AS kept, 0 AS invalid, count(DISTINCT doc_id) AS docs, sum(length(text)) AS chars FROM documents")
def src_jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines to the shared folder and read again with bad lines marked."""
    d = table(spark, sf_dir, "documents")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(spark)
    path = f"{base}/documents-{uuid.uuid4().hex}"
    files.write_jsonl(d, path)
    back = files.read_jsonl(spark, path, d.schema, "mark")
    bad = F.col(files.CORRUPT).isNotNull()
    return back.agg(F.count("*").alias("scanned"), F.count_if(~bad).alias("kept"), F.count_if(bad).cast("int").alias("invalid"), F.count_distinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01' GROUP BY 1, 2")
def rel_pricing_summary(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1999-01-01 00:00:00'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("lines"))


@query("""SELECT r_name, n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def rel_revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # Order lines are summed by order before they meet the dimensions.
    per = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = per.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("rev"), 4).alias("revenue"))


@query("SELECT c_mktsegment, o_orderkey, o_totalprice, rn AS rank FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn <= 10")
def rel_top_orders_by_segment(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return j.withColumn("rank", rank).where("rank <= 10").select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand")
def rel_suppliers_by_brand(spark, sf_dir):
    # Partial sums by part and supplier first; brands are few and would be hot keys for the raw lines.
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    per = per.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.sum("q").alias("q"))
    return per.groupBy("p_brand").agg(F.count("*").alias("suppliers"), F.round(F.sum("q"), 2).alias("quantity"))
