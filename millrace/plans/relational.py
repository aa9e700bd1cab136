"""Queries over the star schema and ``events``.

``PLANS`` are DataFrame plans; ``SQL`` holds text that Spark and DuckDB both
take, with ``{name}`` for a table. ``ORACLE`` has the SQL of the DataFrame plans.
Counts are cast to BIGINT and sums of money rounded, on both sides alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import cosine, money, page_text, page_text_sql, revenue
from millrace.functions.custom import digit_sum, spread, words
from millrace.operators.selection import exclude, include
from millrace.operators.skew import salted_distinct_count, top_k_per_group
from millrace.operators.temporal import asof_join, band_join, interval_join, pairs_in_order, session_ids
from millrace.sources.tables import run_sql, table
from millrace.streaming import event_stream, to_files, tumbling


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        money(F.sum("l_extendedprice")).alias("sum_base_price"),
        money(F.sum(revenue())).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("count_order"),
    )


def tumble(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = session_ids(table(spark, d, "events"), "user_id", "ts", "event_id", "30 minutes")
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))


def asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof_join(buys, clicks, ["user_id"], "ts", "click_ts", ["click_ts", "click_id"])


def interval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    spans = e.where("event_type = 'signup'").select(
        F.col("event_id").alias("span_id"), F.col("ts").alias("span_start"), F.expr("ts + interval 10 minutes").alias("span_end")
    )
    hits = interval_join(e.where("event_type = 'error'").select("event_id", "ts"), spans, "ts", "span_start", "span_end", 600)
    return hits.groupBy("span_id").agg(F.count("*").alias("n"))


def salted_cdistinct(spark: SparkSession, d: str) -> DataFrame:
    return salted_distinct_count(table(spark, d, "events"), "event_type", "user_id", "n")


def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).withColumn("rank", F.col("rank").cast("long"))


def include_names(spark: SparkSession, d: str) -> DataFrame:
    return include(table(spark, d, "nation"), "n_name", ["NATION_1", "NATION_7", "NATION_99"]).select("n_nationkey", "n_name")


def exclude_names(spark: SparkSession, d: str) -> DataFrame:
    return exclude(table(spark, d, "nation"), "n_name", ["NATION_1", "NATION_7"]).select("n_nationkey", "n_name")


def pivot(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return g.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("n_f"), F.coalesce("O", F.lit(0)).alias("n_o"))


def unpivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "amount")


def json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the next id, to six places."""
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id"), F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine("a", "b"), 6).alias("cos"))


def turn_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("same", (F.lag("role").over(w) == F.col("role")).cast("int"))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.sum("same"), F.lit(0)).cast("long").alias("repeats"))


def theta(spark: SparkSession, d: str) -> DataFrame:
    return pairs_in_order(table(spark, d, "supplier"), "s_acctbal", 100.0)


def band(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return band_join(c, s, "c_acctbal", "s_acctbal", 5.0, 2.5).groupBy("s_suppkey").agg(F.count("*").alias("n"))


def asof_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``asof``, with each user's events cut by the day."""
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "click_ts", ["click_ts", "click_id"], span_s=86_400)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", page_text("html").alias("text"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"))


def map_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    few = F.map_filter("m", lambda k, v: v >= 10)
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.size(F.map_keys(few)).cast("long").alias("often"),
                    F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, v: s + v).alias("n"))


def own_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", digit_sum()(F.col("p_partkey")).alias("digits"))


def own_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(spread()("p_retailprice"), 4).alias("spread"))


def own_table_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").lateralJoin(words()(F.col("p_name").outer())).groupBy("word").agg(F.count("*").alias("n"), F.max("place").cast("long").alias("last"))


def streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of events by a stream; those whose end the watermark hasn't passed are still open and not there.

    The path is a pattern, as a stream takes a single file only so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/millrace-streams"
    at = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    return to_files(tumbling(event_stream(spark, f"{d}/event[s].parquet"), "1 day", "10 minutes"), f"{at}/out", f"{at}/checkpoint")


PLANS = {
    "theta_join": theta,
    "band_join": band,
    "asof_spans": asof_spans,
    "page_text": pages,
    "json_fields": json_fields,
    "map_counts": map_counts,
    "own_function": own_function,
    "own_aggregate": own_aggregate,
    "own_table_function": own_table_function,
    "streamed_days": streamed_days,
    "agg_q1": pricing_summary,
    "tumble": tumble,
    "sliding": sliding,
    "sessionize": sessions,
    "asof_join": asof,
    "interval_join": interval,
    "salted_distinct": salted_cdistinct,
    "top_per_group": top_per_group,
    "include_names": include_names,
    "exclude_names": exclude_names,
    "pivot": pivot,
    "unpivot": unpivot,
    "json_path": json_path,
    "vector_pairs": vector_pairs,
    "turn_gaps": turn_gaps,
}

ASOF_SQL = """WITH c AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
        SELECT b.event_id, b.user_id, b.ts, c.click_ts, c.click_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.click_ts"""

ORACLE = {
    "theta_join": "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal",
    "band_join": """SELECT s_suppkey, count(*) AS n FROM customer JOIN supplier ON s_acctbal >= c_acctbal - 5.0::DOUBLE AND s_acctbal <= c_acctbal + 2.5::DOUBLE
        GROUP BY s_suppkey""",
    "asof_spans": ASOF_SQL,
    "page_text": f"SELECT page_id, {page_text_sql('html')} AS text FROM pages",
    "json_fields": """SELECT event_type, CAST(sum(k) AS BIGINT) AS k_sum, count(k) AS k_count FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events) GROUP BY event_type""",
    "map_counts": """SELECT user_id, CAST(coalesce(sum(n) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS clicks, count(*) FILTER (WHERE n >= 10) AS often,
        CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
    "own_function": """SELECT p_partkey, CAST(list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda c: CAST(c AS BIGINT))) AS BIGINT) AS digits
        FROM part""",
    "own_aggregate": "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY p_brand",
    "own_table_function": """SELECT word, count(*) AS n, CAST(max(place) AS BIGINT) AS last FROM (SELECT unnest(string_split(p_name, ' ')) AS word,
        unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS place FROM part) GROUP BY word""",
    "streamed_days": """SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, value FROM events) GROUP BY start, event_type
        HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "agg_q1": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "tumble": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding": """SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(o) AS start
        FROM events, (VALUES (0), (1)) v(o)) GROUP BY ALL""",
    "sessionize": """SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY ALL""",
    "asof_join": ASOF_SQL,
    "interval_join": """SELECT s.event_id AS span_id, count(*) AS n FROM events s JOIN events e ON e.ts >= s.ts AND e.ts < s.ts + INTERVAL 10 MINUTE
        WHERE s.event_type = 'signup' AND e.event_type = 'error' GROUP BY ALL""",
    "salted_distinct": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL",
    "top_per_group": """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
    "include_names": "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_99')",
    "exclude_names": "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_7')",
    "pivot": """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o
        FROM lineitem GROUP BY ALL""",
    "unpivot": """SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
    "json_path": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "vector_pairs": """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "turn_gaps": """SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (WHERE p = role) AS BIGINT) AS repeats FROM (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY ALL""",
}

SQL = {
    "inner_join": "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": "SELECT o_orderkey, count(l_orderkey) AS n FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "full_join": "SELECT r_name, n_name FROM {region} FULL JOIN {nation} ON r_regionkey = n_regionkey",
    "semi_join": "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "anti_join": "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS n FROM {events} GROUP BY event_type",
    "filter_agg": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM {events} GROUP BY user_id",
    "row_number": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM {events}",
    "ranking": """SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY c_mktsegment
        ORDER BY c_nationkey, c_custkey) AS BIGINT) AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
        FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)""",
    "lag_lead": """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
        lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM {events}""",
    "first_last": """SELECT event_id, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "frame_rows": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM {events}""",
    "frame_range": """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n
        FROM {orders}""",
    "top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}) u GROUP BY k",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "except": "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey AS k FROM {lineitem}",
    "correlated": "SELECT count(*) AS n FROM {lineitem} a WHERE l_quantity > (SELECT avg(l_quantity) FROM {lineitem} b WHERE b.l_partkey = a.l_partkey)",
    "six_tables": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey
        JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    "strings": "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS a, CAST(length(p_name) AS BIGINT) AS b, replace(p_name, ' ', '_') AS c, trim(lower(p_type)) AS e FROM {part}",
    "dates": """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n, min(o_orderdate) AS first_day
        FROM {orders} GROUP BY 1, 2""",
    "maths": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, p_size % 7 AS m FROM {part}",
    "exact_copies": "SELECT md5(text) AS h, count(*) AS n FROM {documents} GROUP BY 1 HAVING count(*) > 1",
    "label_rates": """SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source""",
    "label_precision": """SELECT source, count(*) AS labelled, round(avg(CAST(quality AS DOUBLE)), 9) AS good_share, round(avg(CAST(toxic AS DOUBLE)), 9) AS toxic_share,
        round(avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END), 9) AS good_of_clean FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source""",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}",
    "strings_more": """SELECT p_partkey, lpad(CAST(p_size AS VARCHAR(9)), 4, '0') AS a, concat_ws('-', p_brand, p_type) AS b, split_part(p_name, ' ', 1) AS c,
        CAST(instr(p_name, 'e') AS BIGINT) AS e, reverse(p_brand) AS f, left(p_name, 2) AS g, right(p_name, 2) AS h, repeat('ab', 2) AS i, translate(p_type, 'AE', 'ae') AS j,
        CAST(ascii(p_name) AS BIGINT) AS k, contains(p_name, 'a') AS l FROM {part}""",
    "dates_more": """SELECT o_orderkey, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(day(o_orderdate) AS BIGINT) AS d, last_day(o_orderdate) AS month_end,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS DATE) AS next_month, CAST(dayofyear(o_orderdate) AS BIGINT) AS y, CAST(hour(o_orderdate) AS BIGINT) AS h,
        CAST(extract(WEEK FROM o_orderdate) AS BIGINT) AS w FROM {orders}""",
    "maths_more": """SELECT p_partkey, round(ln(p_retailprice), 9) AS a, round(exp(p_size / 50.0), 9) AS b, round(power(p_size, 2), 6) AS c, greatest(p_size, 25) AS d,
        least(p_size, 25) AS e, CAST(sign(p_size - 25) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS g, round(sin(p_size), 9) AS h, round(log10(p_retailprice), 9) AS i,
        round(radians(p_size), 9) AS j, CAST(p_size & 7 AS BIGINT) AS k FROM {part}""",
    "page_hosts": "SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') AS host, count(*) AS n FROM {pages} GROUP BY 1",
}


def queries() -> dict:
    return PLANS | {k: (lambda spark, d, sql=sql: run_sql(spark, d, sql)) for k, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {k: sql.replace("{", "").replace("}", "") for k, sql in SQL.items()}
