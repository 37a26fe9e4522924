"""The engine's registered queries: one for each operator, with its SQL for comparison.

Sums of money are taken over decimals and given as doubles, so they do not
depend on the order of addition.
"""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn import surface
from tarn.functions import arithmetic, compat
from tarn.operators import distinct, pagerank, partitioning, regression
from tarn.plans import pruning, query, stats
from tarn.sources import files, sqlite
from tarn.streaming import cumulative

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def _sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, text)
        return spark.sql(text)

    return run


#: Statements that Spark and the oracle read alike.
COMMON = {
    "scan_parquet": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "project_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND 1 = 1",
    "filter_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' OR p_brand ILIKE 'brand#2%'",
    "filter_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band FROM orders",
    "distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "join_inner_broadcast": "SELECT n.n_name, count(1) AS n_customers, CAST(sum(CAST(c.c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_multi": """SELECT r.r_name, n.n_name, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, count(1) AS n_lines
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""",
    "join_shuffle": "SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT o.o_orderkey, c.c_name FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'",
    "join_full": "SELECT s.s_nationkey AS s_nation, c.c_nationkey AS c_nation, s.n_suppliers, c.n_customers FROM (SELECT s_nationkey, count(1) AS n_suppliers FROM supplier GROUP BY s_nationkey) s FULL OUTER JOIN (SELECT c_nationkey, count(1) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c ON s.s_nationkey = c.c_nationkey",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "join_theta": "SELECT b.lo, count(1) AS n_parts FROM part p JOIN (SELECT * FROM (VALUES (1, 10), (11, 25), (26, 50)) AS v(lo, hi)) b ON p.p_size >= b.lo AND p.p_size <= b.hi GROUP BY b.lo",
    "join_using": "SELECT l_orderkey, c_lines, c_big FROM (SELECT l_orderkey, count(1) AS c_lines FROM lineitem GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, count(1) AS c_big FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)",
    "join_natural": "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) b",
    "agg_group_sum_count_min_max": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, count(1) AS cnt, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT count(1) AS cnt, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders",
    "agg_avg": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderpriority",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_orderstatus",
    "agg_having": "SELECT o_custkey, count(1) AS n_orders FROM orders GROUP BY o_custkey HAVING count(1) > 12",
    "agg_filter": "SELECT l_returnflag, count(1) FILTER (WHERE l_discount > 0.05) AS n_discounted, count(1) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(1) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(1) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(1) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_stats": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_returnflag",
    "agg_regr": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem",
    "agg_median": "SELECT l_returnflag, round(median(l_quantity), 6) AS med FROM lineitem GROUP BY l_returnflag",
    "agg_bool_bit": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 300000) AS any_big, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus",
    "agg_first_last": "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_order, max_by(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey",
    "win_row_number": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_ranks": "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "win_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, lag(o_orderkey, 1, -1) OVER w AS before_or FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM orders",
    "win_range_frame": "SELECT p_partkey, count(1) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sort_nulls": "SELECT * FROM (SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000) t ORDER BY o_orderkey DESC NULLS LAST, c_custkey",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT p_size AS k FROM part EXCEPT SELECT l_linenumber FROM lineitem",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, count(1) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n >= 10) SELECT c.c_name, t.n FROM top t JOIN customer c ON c.c_custkey = t.o_custkey",
    "cte_recursive": "WITH RECURSIVE seq(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM seq WHERE n < 20) SELECT n, f FROM seq",
    "values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "sub_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "sub_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, concat(p_brand, '-', p_type) AS c, substr(p_name, 2, 3) AS s, replace(p_type, ' ', '_') AS r, trim(concat('  ', p_name, ' ')) AS t, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '+') AS rp, reverse(p_name) AS rev, repeat('ab', 3) AS rep, split_part(p_brand, '#', 2) AS sp, left(p_name, 2) AS le, right(p_name, 2) AS ri, CAST(ascii(p_name) AS BIGINT) AS asc_, concat_ws('|', p_brand, p_type) AS cw, translate(p_brand, 'Bd', 'bD') AS tr, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS lev FROM part",
    "fn_math": "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_extendedprice), 6) AS sq, round(exp(l_discount), 9) AS e, round(ln(l_extendedprice), 9) AS ln_, round(log10(l_quantity), 9) AS l10, round(log2(l_quantity), 9) AS l2, round(power(l_quantity, 2), 4) AS p, round(sin(l_quantity), 9) AS sn, round(cos(l_quantity), 9) AS cs, round(atan2(l_quantity, l_tax + 1), 9) AS at2, round(degrees(l_tax), 9) AS dg, round(radians(l_quantity), 9) AS rd, CAST(sign(l_quantity - 25) AS DOUBLE) AS sg, round(cbrt(l_quantity), 9) AS cb, l_orderkey % 7 AS m, greatest(l_quantity, l_tax) AS g, least(l_quantity, l_tax) AS le FROM lineitem",
    "fn_conditional": "SELECT c_custkey, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, nullif(c_nationkey, 3) AS nn, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 ELSE 0 END AS auto, ifnull(nullif(c_nationkey, 4), -1) AS nv FROM customer",
    "fn_hash": "SELECT c_custkey, md5(c_name) AS m, md5(concat(c_mktsegment, c_name)) AS m2 FROM customer",
    "map_reduce_single": "SELECT user_id, event_type, count(1) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type",
}

#: Statements that differ in names only: (Spark's, the oracle's).
PAIRS = {
    "join_semi": ("SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", "SELECT c_custkey FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000"),
    "agg_string": ("SELECT r_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey"),
    "agg_percentile": ("SELECT l_returnflag, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "fn_date": (
        "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_trunc('month', o_orderdate) AS t, CAST(date_add(CAST(o_orderdate AS DATE), 10) AS STRING) AS plus10, CAST(datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, date_format(o_orderdate, 'yyyy-MM-dd') AS f, unix_timestamp(o_orderdate) AS u, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, extract(month FROM o_orderdate) AS m, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS t, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS plus10, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS d, strftime(o_orderdate, '%Y-%m-%d') AS f, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS u, extract(dow FROM o_orderdate) AS dow FROM orders",
    ),
    "fn_regex": (
        r"SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_type, '[aeiou]', '') AS cons, p_name RLIKE '^[a-m]' AS early FROM part",
        r"SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_type, '[aeiou]', '', 'g') AS cons, regexp_matches(p_name, '^[a-m]') AS early FROM part",
    ),
    "fn_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(round(element_at(embedding, 1), 5) AS DOUBLE) AS first, CAST(array_contains(array(1, 2, label), 2) AS BOOLEAN) AS has2, array_join(slice(sequence(1, 5), 2, 3), ',') AS part, array_join(array_distinct(array(label, label, 1)), ',') AS dis, array_join(sort_array(array(3, label, 2)), ',') AS srt, array_join(flatten(array(array(1), array(label, 2))), ',') AS flat FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(round(embedding[1], 5) AS DOUBLE) AS first, list_contains([1, 2, label], 2) AS has2, array_to_string([2, 3, 4], ',') AS part, CASE WHEN label = 1 THEN '1' ELSE concat(label, ',1') END AS dis, array_to_string(list_sort([3, label, 2]), ',') AS srt, array_to_string(flatten([[1], [label, 2]]), ',') AS flat FROM embeddings",
    ),
    "fn_unnest": ("SELECT vec_id, pos, CAST(round(x, 5) AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(round(embedding[i], 5) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "fn_json": ("SELECT event_id, CAST(length(props) AS BIGINT) AS n, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, length(props) AS n, json_extract_string(props, '$.k') AS k FROM events"),
    "fn_sha": ("SELECT c_custkey, sha2(c_name, 256) AS s, base64(CAST(c_name AS BINARY)) AS b64, lower(hex(c_custkey)) AS h FROM customer", "SELECT c_custkey, sha256(c_name) AS s, base64(encode(c_name)) AS b64, lower(printf('%x', c_custkey)) AS h FROM customer"),
    "win_groups_frame": (
        "SELECT p_partkey, count(1) OVER (PARTITION BY p_brand ORDER BY dr RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part)",
        "SELECT p_partkey, count(1) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part",
    ),
}

FLAGSHIP = """SELECT n.n_name, c.c_mktsegment, count(1) AS n_orders, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment"""
COMMON["flagship"] = FLAGSHIP


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks reach: below the configured checkpoint folder; only a local session may do without."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tarn-")
    return f"{top.rstrip('/')}/tarn-{name}-{os.getpid()}-{os.urandom(4).hex()}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "nation"), path)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(path)


def parquet_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parquet")
    files.write_parquet(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, ["n_regionkey"])
    return spark.read.parquet(path).where("n_regionkey = 2").select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def sqlite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, of 25 rows, as a SQLite table joined with customer."""
    path = _folder(spark, "nation").removeprefix("file:") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation_db (n_nationkey INTEGER, n_name TEXT)")
        db.executemany("INSERT INTO nation_db VALUES (?, ?)", [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()])
    nation = sqlite.read(spark, path, "nation_db")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers"))


def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.run_map_reduce(
        spark,
        "SELECT user_id, event_type, count(1) AS c, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DECIMAL(28, 6)) AS s FROM input GROUP BY user_id, event_type",
        "SELECT user_id, event_type, sum(c) AS cnt, CAST(sum(s) AS DOUBLE) AS total FROM input GROUP BY user_id, event_type",
        input=table(spark, sf_dir, "events"),
    )


def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.register(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"])
    return spark.sql("SELECT r_name, count(1) AS n FROM input JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def union_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV shards of nation: whole numbers, fractions, and a column without any value, read as one input."""
    rows, top = table(spark, sf_dir, "nation"), _folder(spark, "shards")
    value = [F.col("n_regionkey"), F.col("n_regionkey") + 0.5, F.lit(None).cast("int")]
    for i, v in enumerate(value):
        files.write_csv(rows.where(F.col("n_nationkey") % 3 == i).select("n_nationkey", v.alias("v"), (F.col("n_name") if i == 1 else F.lit(None).cast("string")).alias("note")), f"{top}/shard-{i}.csv")
    return files.register(spark, [f"{top}/shard-{i}.csv" for i in range(3)]).select("n_nationkey", F.col("v").cast("double").alias("v"), "note")


def dpp_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pruning.prune(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "C_MKTSEGMENT", " building ", "c_custkey", "o_custkey")
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))


def analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.analyze(table(spark, sf_dir, "orders"))


def expr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    value = arithmetic.compile_expression("(l_quantity + 1) * l_extendedprice / (l_tax + 1) - 2", df.columns)
    return df.select("l_orderkey", "l_linenumber", F.round(value, 4).alias("result"))


def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key, its rows and the number of partitions that hold them: 1."""
    df = partitioning.hash_partition(table(spark, sf_dir, "orders"), 8, ["o_custkey", "absent"])
    df = df.withColumn("part", F.spark_partition_id())
    return df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("n_partitions"))


def broadcast_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = stats.join_sides(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_suppliers"))


def salted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    return partitioning.salted_sum(df, ["l_returnflag"], "qty").select("l_returnflag", F.col("sum_qty").cast("double").alias("sum_qty"))


def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of ``surface.PAIRS``, its exact distinct count taken apart from the rest."""
    part, quantity, known = F.col("l_partkey"), F.col("l_quantity"), F.col("known")
    found = distinct.counted_apart(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "known", F.approx_count_distinct(part).alias("sketched"),
        F.percentile_approx(quantity, 0.5).alias("a50"), F.median(quantity).alias("e50"), F.percentile_approx(quantity, 0.9).alias("a90"), F.percentile(quantity, 0.9).alias("e90"),
    )
    near = lambda a, e, most: F.abs(F.col(a) - F.col(e)) <= most
    return found.select("l_returnflag", near("sketched", "known", known * 0.1).alias("near"), near("a50", "e50", 1).alias("near_median"), near("a90", "e90", 1).alias("near_p90"))


def ols_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = regression.fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return fitted.select("coefficient_idx", F.round("value", 4).alias("value"))


def pagerank_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    degree = lines.groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("out_degree"))
    rows = lines.join(degree, F.col("l_suppkey") == F.col("k")).select(F.col("l_partkey").alias("target"), F.lit(1.0).alias("rank"), "out_degree")
    return pagerank.step(rows).select("target", F.round("rank", 9).alias("rank"))


def pagerank_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return pagerank.iterate(lines, 3).select("node", F.round("rank", 9).alias("rank"))


def window_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("rolling"))


def fn_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", compat.gcd(c("p_partkey"), c("p_size")).alias("g"), compat.lcm(c("p_partkey"), c("p_size")).alias("l"), compat.trunc_number(c("p_retailprice") - 1000).cast("double").alias("t"),
        compat.strpos(c("p_brand"), "#").cast("long").alias("at"), compat.to_hex(c("p_partkey")).alias("h"), compat.array_has_all(F.array(F.lit(1), c("p_size")), F.array(F.lit(1), F.lit(7))).alias("has"),
        compat.regexp_match(c("p_brand"), "#[1-3]").alias("rm"), compat.iszero(c("p_size") - 7).alias("z"), F.array_join(compat.array_slice(F.sequence(F.lit(1), c("p_size")), 2, 3), ",").alias("sl"),
        F.array_join(compat.array_pop_back(F.array(F.lit(5), c("p_size"))), ",").alias("pb"), F.array_join(compat.array_pop_front(F.array(F.lit(5), c("p_size"))), ",").alias("pf"),
        F.array_join(compat.array_replace(F.array(F.lit(1), c("p_size")), 1, 9), ",").alias("rp"), F.array_join(compat.array_resize(F.array(c("p_size")), 3, 0), ",").alias("rz"),
    )


def date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(compat.date_bin(900, F.col("ts")).cast("timestamp_ntz").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, sf_dir: str, aggregate: Callable[[DataFrame], DataFrame], delay: float | None) -> DataFrame:
    top = _folder(spark, "stream")
    state = cumulative.CumulativeState(spark, f"{top}/state", ["user_id", "category"], ["n", "total"])
    state.where.create_dir(state.at, recursive=True)
    cumulative.start(_stream(spark, sf_dir), state, aggregate, f"{top}/checkpoint", "ts" if delay else None, delay or 0, every=None).awaitTermination()
    return state.current().select("user_id", "category", "n", F.col("total").cast("double").alias("total"))


def _by_user(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))


def stream_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, _by_user, None)


def stream_watermark_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, _by_user, 86400.0)


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation")
    return _drained(spark, sf_dir, lambda b: b.join(names, F.col("user_id") % 25 == F.col("n_nationkey")).groupBy("user_id", F.col("n_name").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")), None)


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows over a stream, as each batch leaves them, written to the shared folder."""
    windows = cumulative.windowed(_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour", "1 day")
    top = _folder(spark, "windows")
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{top}/batch={i}")
    query = windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{top}-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{top}/batch={query.lastProgress.batchId}")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("sum_value", 4).alias("total"))


#: DataFrame queries: (query, oracle or None).
BUILT: dict[str, tuple[Query, str | None]] = {
    "csv_roundtrip": (csv_roundtrip, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "parquet_partitioned": (parquet_partitioned, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "sqlite_join": (sqlite_join, "SELECT n_name, count(1) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "map_reduce": (map_reduce, "SELECT user_id, event_type, count(1) AS cnt, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events GROUP BY user_id, event_type"),
    "union_inputs": (union_inputs, "SELECT r_name, CAST(2 * count(1) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "union_widened": (union_widened, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_regionkey::DOUBLE WHEN 1 THEN n_regionkey + 0.5::DOUBLE END AS v, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS note FROM nation"),
    "dpp_prune": (dpp_prune, "SELECT o_custkey, count(1) AS n_orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building') GROUP BY o_custkey"),
    "analyze_table": (analyze_table, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(1) AS row_count, count(1) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
    "expr_eval": (expr_eval, "SELECT l_orderkey, l_linenumber, round((l_quantity + 1) * l_extendedprice / (l_tax + 1) - 2, 4) AS result FROM lineitem"),
    "hash_partition": (hash_partition, "SELECT o_custkey, count(1) AS n, CAST(1 AS BIGINT) AS n_partitions FROM orders GROUP BY o_custkey"),
    "broadcast_hint": (broadcast_hint, "SELECT n_name, count(1) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "salted_sum": (salted_sum, "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty FROM lineitem GROUP BY l_returnflag"),
    "agg_approx_distinct": (agg_approx_distinct, surface.PAIRS["agg_approx_distinct"][1]),
    "ols_lineitem": (ols_lineitem, """WITH s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS d, sum(l_quantity * l_extendedprice) AS p, sum(l_discount * l_extendedprice) AS q FROM lineitem)
        SELECT CAST(0 AS BIGINT) AS coefficient_idx, round((p * d - b * q) / (a * d - b * b), 4) AS value FROM s UNION ALL SELECT CAST(1 AS BIGINT), round((a * q - b * p) / (a * d - b * b), 4) FROM s"""),
    "pagerank_step": (pagerank_step, "WITH d AS (SELECT l_suppkey AS k, count(1) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_partkey AS target, round(0.15 + 0.85 * sum(1.0::DOUBLE / n), 9) AS rank FROM lineitem JOIN d ON k = l_suppkey GROUP BY l_partkey"),
    "pagerank_iterate": (pagerank_iterate, """WITH e AS (SELECT l_suppkey AS s, l_partkey AS d FROM lineitem), o AS (SELECT s, count(1) AS n FROM e GROUP BY s),
        w AS (SELECT s, d, count(1)::DOUBLE / any_value(n) AS w FROM e JOIN o USING (s) GROUP BY s, d), v AS (SELECT s AS k FROM e UNION SELECT d FROM e),
        r1 AS (SELECT k, 0.15 + 0.85 * coalesce(sum(w), 0) AS r FROM v LEFT JOIN w ON d = k GROUP BY k),
        r2 AS (SELECT v.k, 0.15 + 0.85 * coalesce(sum(w * r), 0) AS r FROM v LEFT JOIN w ON d = v.k LEFT JOIN r1 ON r1.k = s GROUP BY v.k),
        r3 AS (SELECT v.k, 0.15 + 0.85 * coalesce(sum(w * r), 0) AS r FROM v LEFT JOIN w ON d = v.k LEFT JOIN r2 ON r2.k = s GROUP BY v.k)
        SELECT k AS node, round(r, 9) AS rank FROM r3"""),
    "window_rolling": (window_rolling, "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events"),
    "fn_compat": (fn_compat, "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, trunc(p_retailprice - 1000) AS t, strpos(p_brand, '#') AS at, lower(printf('%x', p_partkey)) AS h, p_size = 7 AS has, CASE WHEN regexp_matches(p_brand, '#[1-3]') THEN regexp_extract(p_brand, '#[1-3]') END AS rm, p_size = 7 AS z, array_to_string(range(1, p_size + 1)[2:3], ',') AS sl, '5' AS pb, CAST(p_size AS VARCHAR) AS pf, concat('9,', CASE WHEN p_size = 1 THEN 9 ELSE p_size END) AS rp, concat(p_size, ',0,0') AS rz FROM part"),
    "date_bin": (date_bin, "SELECT time_bucket(INTERVAL '15 minutes', ts) AS bin, count(1) AS n FROM events GROUP BY bin"),
    "stream_cumulative": (stream_cumulative, "SELECT user_id, event_type AS category, count(1) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events GROUP BY user_id, event_type"),
    "stream_watermark_filter": (stream_watermark_filter, "SELECT user_id, event_type AS category, count(1) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) - 86400 FROM events) GROUP BY user_id, event_type"),
    "stream_static_join": (stream_static_join, "SELECT user_id, n_name AS category, count(1) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY user_id, n_name"),
    "stream_window": (stream_window, "SELECT date_trunc('hour', ts) AS start, event_type, count(1) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}


COMMON |= surface.COMMON
PAIRS |= surface.PAIRS


def queries() -> dict[str, Query]:
    return {**{k: _sql(v) for k, v in COMMON.items()}, **{k: _sql(v[0]) for k, v in PAIRS.items()}, **{k: v[0] for k, v in BUILT.items()}}


def oracle_sql() -> dict[str, str]:
    return {**COMMON, **{k: v[1] for k, v in PAIRS.items()}, **{k: v[1] for k, v in BUILT.items() if v[1] is not None}}
