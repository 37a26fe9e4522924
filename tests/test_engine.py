import json
import math
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import __main__ as cli
from tarn import jobs
from tarn.functions import arithmetic, compat
from tarn.operators import pagerank, partitioning, regression
from tarn.plans import pruning, query, stats
from tarn.session import EngineConfig
from tarn.sources import files, sqlite
from tarn.streaming import cumulative


def write(path, text):
    path.write_text(text)
    return str(path)


def ratings(path, part):
    rows = "".join(f"user_{i % 5 + 1},{i % 5 + part},2026-06-04T12:57:{i:02d}Z,{['action', 'comedy', 'drama'][i % 3]}\n" for i in range(60))
    return write(path / f"part-{part}.csv", "user_id,rating,timestamp,category\n" + rows)


@pytest.fixture
def dpp(tmp_path):
    rows = "".join(f"user_{i % 3 + 1},{i % 5 + 1},{1780598000 + i},{['action', 'comedy', 'drama', 'sci-fi'][i % 4]}\n" for i in range(2500))
    fact = write(tmp_path / "ratings_dpp.csv", "user_id,rating,timestamp,category\n" + rows)
    dim = write(tmp_path / "dim_user.csv", "user_id,active,region\nuser_1,true,US\nuser_2,false,EU\nuser_3,true,US\n")
    return fact, dim


def test_input_is_the_union_of_all_main_files(spark, tmp_path):
    paths = [ratings(tmp_path, p) for p in range(3)]
    lookup = write(tmp_path / "category_lookup.csv", "category,category_name\naction,Action Movies\ncomedy,Comedy Shows\ndrama,Drama Series\n")
    files.register(spark, [*paths, lookup])
    out = query.run_map_reduce(
        spark,
        "SELECT user_id, category_name, COUNT(1) AS n, SUM(rating) AS s FROM input r JOIN category_lookup c ON r.category = c.category GROUP BY user_id, category_name",
        "SELECT user_id, category_name, SUM(n) AS n, SUM(s) AS s FROM input GROUP BY user_id, category_name",
    ).collect()
    assert sum(r["n"] for r in out) == 180
    assert sum(r["s"] for r in out) == sum(i % 5 + p for i in range(60) for p in range(3))
    assert spark.table("part_1" if "part_1" in [t.name for t in spark.catalog.listTables()] else "`part-1`").count() == 60


def test_unknown_suffix_is_an_error(spark):
    with pytest.raises(ValueError, match="unsupported"):
        files.read(spark, "/tmp/x.xyz")


def test_sqlite_join(spark, tmp_path, dpp):
    path = str(tmp_path / "user_metadata.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE user_status (user_id TEXT, age INTEGER, membership TEXT)")
        db.executemany("INSERT INTO user_status VALUES (?, ?, ?)", [("user_1", 25, "Premium"), ("user_2", 30, "Free"), ("user_3", 35, "Premium"), ("user_4", None, "Free"), ("user_5", 45, None)])
    files.register(spark, [dpp[0], path])
    assert [f.dataType.simpleString() for f in sqlite.schema(path, "user_status")] == ["string", "bigint", "string"]
    got = spark.sql("SELECT r.user_id, membership, count(1) AS n, sum(rating) AS s FROM input r JOIN user_status u ON r.user_id = u.user_id GROUP BY 1, 2 ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("user_1", "Premium", 834, 2502), ("user_2", "Free", 833, 2500), ("user_3", "Premium", 833, 2498)]
    assert spark.table("user_status").where("age IS NULL").count() == 1


def test_pruning(spark, dpp):
    fact, dim = (files.read(spark, p) for p in dpp)
    got = pruning.prune(fact, dim, "ACTIVE", " True ", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s")).orderBy("user_id").collect()
    assert [tuple(r) for r in got] == [("user_1", 834, 2502), ("user_3", 833, 2498)]
    assert pruning.prune(fact, dim, "region", "nowhere", "user_id").count() == 0


def test_analyze(spark, dpp):
    rows = {r["column_name"]: r for r in stats.analyze(files.read(spark, dpp[0])).collect()}
    assert {k: (r["row_count"], r["null_count"], r["distinct_count"]) for k, r in rows.items()} == {"user_id": (2500, 0, 3), "rating": (2500, 0, 5), "timestamp": (2500, 0, 2500), "category": (2500, 0, 4)}
    assert (rows["rating"]["min"], rows["rating"]["max"]) == ("1", "5")
    df = spark.createDataFrame([(9, None), (10, None)], "a int, b string")
    rows = {r["column_name"]: r for r in stats.analyze(df).collect()}
    assert (rows["a"]["min"], rows["a"]["max"]) == ("9", "10")
    assert (rows["b"]["null_count"], rows["b"]["distinct_count"], rows["b"]["min"]) == (2, 0, None)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0, 8.0), (2.0, 1.0, 7.0), (3.0, 3.0, 15.0), (4.0, 5.0, 23.0), (None, 1.0, 9.0)], "x1 double, x2 double, y double")
    got = [r["value"] for r in regression.fit(df, iterations=2).orderBy("coefficient_idx").collect()]
    assert np.allclose(got, [2.0, 3.0], atol=1e-9)
    with pytest.raises(regression.SingularError):
        regression.fit(df.select("x1", (F.col("x1") * 2).alias("x2"), "y"))
    with pytest.raises(ValueError):
        regression.fit(df.limit(0))


def test_pagerank(spark):
    df = spark.createDataFrame([("node_A", 1.0, 2.0), ("node_B", 1.0, 2.0), ("node_C", 1.0, 1.0)], "target string, rank double, out_degree double")
    assert {r["target"]: round(r["rank"], 9) for r in pagerank.step(df).collect()} == {"node_A": 0.575, "node_B": 0.575, "node_C": 1.0}
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")], "src string, dst string")
    rank = {n: 1.0 for n in "abcd"}
    for _ in range(6):
        rank = {n: 0.15 + 0.85 * sum(rank[s] / sum(x[0] == s for x in [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]) for s, d in [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")] if d == n) for n in "abcd"}
    got = {r["node"]: r["rank"] for r in pagerank.iterate(edges, 6).collect()}
    assert all(math.isclose(got[n], rank[n], rel_tol=1e-9) for n in "abcd")


@pytest.mark.parametrize("text, want", [("x + 1", 4.0), ("(x + 1) * y", 20.0), ("x - 1 - 1", 1.0), ("2 * x / y", 1.2), ("x / 0", math.inf), ("1.5e1 + .5", 15.5)])
def test_expressions(spark, text, want):
    assert arithmetic.evaluate(spark.createDataFrame([(3, 5.0)], "x int, y double"), text).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("text", ["SELECT x", "x +", "(x", "X + 1", "x % 2", "-x", "x > 1", "x x", ""])
def test_bad_expressions(text):
    with pytest.raises(arithmetic.ExpressionError):
        arithmetic.compile_expression(text, ["x"])


def test_expression_nulls(spark):
    assert arithmetic.evaluate(spark.createDataFrame([(None, 0.0)], "x int, y double"), "x / y").first()[0] is None
    assert math.isnan(arithmetic.evaluate(spark.createDataFrame([(0, 0.0)], "x int, y double"), "x / y").first()[0])


def test_keys_and_partitions(spark):
    assert partitioning.resolve_keys(["a", "key"], ["zz"]) == ["key"]
    assert partitioning.resolve_keys(["a", "b"], None) == ["a"]
    assert partitioning.resolve_keys(["a", "b"], ["b", "a"]) == ["b", "a"]
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    parts = partitioning.hash_partition(df, 4, ["k"]).withColumn("p", F.spark_partition_id())
    assert parts.count() == 30
    assert parts.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0


def test_split(spark):
    spark.createDataFrame([(1, 2.0)], "k int, v double").createOrReplaceTempView("split_input")
    s = query.explain_split(spark, "SELECT k, SUM(v), COUNT(1), MIN(v), MAX(v) FROM split_input GROUP BY k")
    assert s.splittable and s.keys == ("k",) and len(s.final) == 4
    assert not query.explain_split(spark, "SELECT k, AVG(v) FROM split_input GROUP BY k").splittable
    assert not query.explain_split(spark, "SELECT k, COUNT(DISTINCT v) FROM split_input GROUP BY k").splittable


def test_stream_is_cumulative_and_drops_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "user_id,rating,timestamp,category\n"
    write(source / "batch1.csv", head + "user_1,5,1780598000,action\nuser_2,4,1780598002,comedy\n")
    names = spark.createDataFrame([("action", "Action Movies"), ("comedy", "Comedy Shows")], "category string, category_name string")
    path = f"file://{tmp_path}/state"
    (tmp_path / "state").mkdir()
    state = cumulative.CumulativeState(spark, path, ["user_id", "category_name"], ["total_ratings", "total_rating_sum"])

    def total(batch):
        return batch.join(names, "category").groupBy("user_id", "category_name").agg(F.count(F.lit(1)).alias("total_ratings"), F.sum("rating").cast("double").alias("total_rating_sum"))

    def drain():
        stream = cumulative.csv_source(spark, str(source), "user_id string, rating int, timestamp long, category string")
        cumulative.start(stream, state, total, f"{tmp_path}/checkpoint", "timestamp", 5, every=None).awaitTermination()

    drain()
    write(source / "batch2.csv", head + "user_1,4,1780598010,action\nuser_2,4,1780598012,comedy\nuser_3,5,1780597000,action\n")
    drain()
    want = [("user_1", "Action Movies", 2, 9.0), ("user_2", "Comedy Shows", 2, 8.0)]
    assert [tuple(r) for r in state.current().orderBy("user_id").collect()] == want
    # a replayed batch counts once
    batch = spark.createDataFrame([("user_9", "x", 1, 1.0)], "user_id string, category_name string, total_ratings long, total_rating_sum double")
    state.merge(7, batch)
    state.merge(7, batch)
    assert state.current().where("user_id = 'user_9'").first()["total_ratings"] == 1
    assert state.batch() == 7
    (tmp_path / "state" / "manifest-000000008-000000009.json").write_text('{"batch": 8, "buc')  # a writer was lost
    assert state.batch() == 7 and state.current().count() == 3
    assert state.merge(8, batch).where("user_id = 'user_9'").first()["total_ratings"] == 2
    assert len(list((tmp_path / "state").glob("batch-*"))) <= 4


def test_jobs(spark, tmp_path, dpp):
    engine = jobs.Engine(spark)
    out = str(tmp_path / "out")
    job = engine.submit("SELECT user_id, count(1) AS n FROM input GROUP BY user_id", input_files=[dpp[0]], output_dir=out, num_partitions=2, prune={"file": dpp[1], "filter_column": "active", "value": "true", "key": "user_id"})
    assert engine.wait(job, 120).state == jobs.COMPLETED
    assert sorted((r["user_id"], int(r["n"])) for r in spark.read.option("header", True).csv(out).collect()) == [("user_1", 834), ("user_3", 833)]
    bad = engine.submit("SELECT nothing FROM input", input_files=[dpp[0]], output_dir=out)
    assert engine.wait(bad, 120).state == jobs.FAILED and engine.status(bad).error
    table = engine.submit("ANALYZE TABLE ratings", input_files=[dpp[0]], output_dir=str(tmp_path / "stats"))
    assert engine.wait(table, 120).state == jobs.COMPLETED
    assert engine.catalog.get("ratings").row_count == 2500
    with pytest.raises(ValueError):
        engine.submit(input_files=[dpp[0]], output_dir=out)
    assert engine.metrics()["jobs_completed"] == 2 and "tarn_jobs_failed 1" in engine.prometheus()
    assert engine.cancel(job).state == jobs.COMPLETED


def test_spec(tmp_path):
    path = write(tmp_path / "job.yaml", "mapSql: SELECT 1\nnumPartitions: 4\ninputFiles:\n  - a.csv\n  - b.csv\n")
    assert jobs.load_spec(path) == {"mapSql": "SELECT 1", "numPartitions": 4, "inputFiles": ["a.csv", "b.csv"]}


def test_compat(spark):
    row = spark.createDataFrame([(12, 18, -2.7, [1, 2, 3])], "a long, b long, x double, l array<int>").select(
        compat.gcd(F.col("a"), F.col("b")), compat.lcm(F.col("a"), F.col("b")), compat.trunc_number(F.col("x")), compat.array_slice(F.col("l"), 2, 3),
        compat.array_pop_back(F.col("l")), compat.array_pop_front(F.col("l")), compat.array_replace(F.col("l"), 2, 9), compat.array_resize(F.col("l"), 5, 0),
    ).first()
    assert list(row) == [6, 36, -2.0, [2, 3], [1, 2], [2, 3], [1, 9, 3], [1, 2, 3, 0, 0]]


def test_config():
    confs = EngineConfig(broadcast_bytes=50_000).confs()
    assert confs["spark.sql.autoBroadcastJoinThreshold"] == "50000" and confs["spark.sql.adaptive.skewJoin.skewedPartitionFactor"] == "3.0"


def test_times_in_milliseconds_and_without_a_time(spark):
    rows = [(1780598000000, "a"), (1780598004999, "b"), (1780598005000, "c"), (1780598010000, "d"), (None, "e")]
    ms = spark.createDataFrame(rows, "t long, k string")
    assert {r["k"] for r in cumulative.late_filter(ms, "t", 5).collect()} == {"c", "d"}
    seconds = ms.withColumn("t", (F.col("t") / 1000).cast("long"))
    assert {r["k"] for r in cumulative.late_filter(seconds, "t", 5).collect()} == {"c", "d"}
    at = ms.withColumn("t", F.timestamp_millis("t"))
    assert {r["k"] for r in cumulative.late_filter(at, "t", 5).collect()} == {"c", "d"}
    assert cumulative.late_filter(ms.where("t IS NULL"), "t", 5).count() == 0


def test_shards_of_other_types_keep_their_rows(spark, tmp_path):
    a = write(tmp_path / "s-0.csv", "k,v,note\nx,1,\n")
    b = write(tmp_path / "s-1.csv", "k,v,note\ny,2.5,hello\n")
    c = write(tmp_path / "s-2.csv", "v,k,note\n30000000000,z,\n")
    d = write(tmp_path / "s-3.csv", "k,v,note\nw,,\n")
    got = files.register(spark, [a, b, c, d])
    assert sorted((r["k"], r["v"], r["note"]) for r in got.collect()) == [("w", None, None), ("x", 1.0, None), ("y", 2.5, "hello"), ("z", 3e10, None)]
    got = files.register(spark, [a, b], schema="k string, v double, note string")
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "double", "string"] and got.count() == 2
    words = write(tmp_path / "s-4.csv", "k,v,note\nq,many,\n")
    assert sorted(r["v"] for r in files.register(spark, [a, words]).collect()) == ["1", "many"]
    short = write(tmp_path / "s-5.csv", "k,v\nx,1\n")
    with pytest.raises(files.SchemaError):
        files.register(spark, [a, short])
    lookup = write(tmp_path / "names.csv", "k,name\nx,Ex\n")
    assert files.register(spark, [a, lookup]).count() == 1 and spark.table("names").count() == 1


def test_broadcast_files_of_a_job(spark, tmp_path, dpp):
    names = write(tmp_path / "lookup.csv", "category,category_name\naction,Action Movies\ndrama,Drama Series\n")
    engine, out = jobs.Engine(spark), str(tmp_path / "out")
    job = engine.submit(
        map_sql="SELECT category_name, count(1) AS n FROM input JOIN kinds USING (category) GROUP BY category_name", reduce_sql="SELECT category_name, sum(n) AS n FROM merged_shuffle GROUP BY category_name",
        input_files=[dpp[0]], output_dir=out, broadcasts={"kinds": names}, num_partitions=3,
    )
    assert engine.wait(job, 120).state == jobs.COMPLETED, engine.status(job).error
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(out).collect()) == [("Action Movies", "625"), ("Drama Series", "625")]
    assert engine.tasks(job) and all(t["failed"] == 0 for t in engine.tasks(job))
    assert engine.health() == {"status": "ok"} and engine.workers()[0]["running_tasks"] >= 0


def test_a_running_job_is_cancelled(spark, tmp_path, dpp):
    engine = jobs.Engine(spark)
    job = engine.submit("SELECT count(1) AS n FROM input a CROSS JOIN input b CROSS JOIN input c WHERE a.rating + b.rating * c.rating = -1", input_files=[dpp[0]], output_dir=str(tmp_path / "out"))
    until = time.time() + 60
    while not any(t["active"] for t in engine.tasks(job)) and time.time() < until:
        time.sleep(0.1)
    assert engine.status(job).state == jobs.RUNNING
    began = time.time()
    assert engine.cancel(job).state == jobs.CANCELLED
    engine.wait(job, 60)
    assert engine.status(job).state == jobs.CANCELLED and time.time() - began < 30 and engine.metrics()["jobs_cancelled"] == 1


def test_regression_and_rank_jobs(spark, tmp_path):
    engine = jobs.Engine(spark)
    lr = write(tmp_path / "lr.csv", "x1,x2,y\n1.0,2.0,8.0\n2.0,1.0,7.0\n3.0,3.0,15.0\n4.0,5.0,23.0\n")
    pr = write(tmp_path / "pr.csv", "target,rank,out_degree\na,1.0,2.0\nb,1.0,2.0\na,0.5,1.0\n")
    one, two = engine.submit_lr(lr, str(tmp_path / "lr")), engine.submit_pagerank(pr, str(tmp_path / "pr"))
    assert engine.wait(one, 120).state == engine.wait(two, 120).state == jobs.COMPLETED
    read = lambda p: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / p))
    assert np.allclose([r["value"] for r in read("lr").orderBy("coefficient_idx").collect()], [2.0, 3.0])
    assert {r["target"]: round(r["rank"], 9) for r in read("pr").collect()} == {"a": 1.0, "b": 0.575}


STREAM = {
    "map_sql": "SELECT user_id, category_name, count(1) AS total_ratings, sum(rating) AS total_rating_sum FROM input r JOIN category_lookup c ON r.category = c.category GROUP BY user_id, category_name",
    "reduce_sql": "SELECT user_id, category_name, sum(total_ratings) AS total_ratings, CAST(sum(total_rating_sum) AS DOUBLE) AS total_rating_sum FROM input GROUP BY user_id, category_name",
}


@pytest.fixture
def batches(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "user_id,rating,timestamp,category\n"
    write(source / "batch1.csv", head + "user_1,5,1780598000,action\nuser_2,4,1780598002,comedy\n")
    lookup = write(tmp_path / "category_lookup.csv", "category,category_name\naction,Action Movies\ncomedy,Comedy Shows\n")
    return source, lookup, lambda: write(source / "batch2.csv", head + "user_1,4,1780598010,action\nuser_2,4,1780598012,comedy\nuser_3,5,1780597000,action\n")


def test_a_streaming_job_runs_until_it_is_stopped(spark, tmp_path, batches):
    source, lookup, more = batches
    engine, out = jobs.Engine(spark), str(tmp_path / "out")
    job = engine.submit_streaming(str(source), str(tmp_path / "checkpoint"), output_dir=out, broadcasts={"category_lookup": lookup}, every="1 second", num_partitions=1, **STREAM)
    read = lambda: sorted(tuple(r) for r in spark.read.option("header", True).csv(out).collect())

    def until(want):
        end = time.time() + 90
        while time.time() < end and engine.status(job).state in (jobs.PENDING, jobs.RUNNING):
            try:
                if read() == want:
                    return
            except Exception:  # the folder is being replaced
                pass
            time.sleep(0.5)
        assert read() == want, engine.status(job).error

    until([("user_1", "Action Movies", "1", "5.0"), ("user_2", "Comedy Shows", "1", "4.0")])
    more()
    until([("user_1", "Action Movies", "2", "9.0"), ("user_2", "Comedy Shows", "2", "8.0")])
    assert engine.status(job).state == jobs.RUNNING and engine.tasks(job)
    assert engine.stop(job).state == jobs.COMPLETED
    other = engine.submit_streaming(str(source), str(tmp_path / "other"), output_dir=out, broadcasts={"category_lookup": lookup}, **STREAM)
    engine.cancel(other)
    assert engine.wait(other, 60).state == jobs.CANCELLED
    with pytest.raises(ValueError):
        engine.submit_streaming(str(source), "", output_dir=out, **STREAM)


def test_command_line(spark, tmp_path, dpp, batches, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["submit", "--sql", "SELECT user_id, count(1) AS n FROM input GROUP BY user_id", "--input", dpp[0], "--output", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["state"] == jobs.COMPLETED
    assert spark.read.option("header", True).csv(out).count() == 3
    assert cli.main(["submit", "--sql", "SELECT nothing FROM input", "--input", dpp[0], "--output", out]) == 1
    source, lookup, _ = batches
    args = ["stream", "--input", str(source), "--checkpoint", str(tmp_path / "cp"), "--map-sql", STREAM["map_sql"], "--reduce-sql", STREAM["reduce_sql"], "--output", out, "--broadcast", f"category_lookup={lookup}"]
    assert cli.main(args) == 0 and spark.read.option("header", True).csv(out).count() == 2
    lr = write(tmp_path / "lr.csv", "x1,y\n1.0,2.0\n2.0,4.0\n")
    assert cli.main(["lr", "--input", lr, "--output", out]) == 0


def test_signs_of_infinities(spark):
    df = spark.createDataFrame([(1.0, -0.0), (1.0, 0.0), (-1.0, -0.0), (-1.0, 0.0)], "a double, b double")
    assert [r["result"] for r in arithmetic.evaluate(df, "a / b").collect()] == [-math.inf, math.inf, math.inf, -math.inf]


def test_an_empty_match_is_a_match(spark):
    df = spark.createDataFrame([("aab",), ("b",), ("c",), (None,)], "t string")
    assert [r[0] for r in df.select(compat.regexp_match(F.col("t"), "a*")).collect()] == ["aa", "", "", None]
    assert [r[0] for r in df.select(compat.regexp_match(F.col("t"), "b")).collect()] == ["b", "b", None, None]


def test_approximate_statistics(spark, dpp):
    df = files.read(spark, dpp[0])
    exact, near = ({r["column_name"]: r for r in stats.analyze(df, approximate=a).collect()} for a in (None, 0.02))
    assert exact.keys() == near.keys()
    for c in exact:
        assert all(exact[c][k] == near[c][k] for k in ("row_count", "null_count", "min", "max"))
        assert abs(exact[c]["distinct_count"] - near[c]["distinct_count"]) <= 0.1 * exact[c]["distinct_count"]
