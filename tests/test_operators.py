import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.functions import page_text
from millrace.functions.custom import digit_sum, running_totals
from millrace.operators import selection
from millrace.operators.selection import exclude, include, inventory
from millrace.operators.temporal import asof_join, band_join, interval_join, pairs_in_order
from millrace.sources import files
from millrace.sources.manifest import import_projects, read_manifests, write_inventory

SF = "/root/testdata/sf0.001"


def test_lists_and_nulls(spark):
    rows = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", None), ("p", "a")], "org string, repo string")
    names = lambda df: sorted((r.repo for r in df.collect()), key=str)
    assert names(include(rows, "repo", ["a"])) == ["a", "a"]
    assert names(exclude(rows, "repo", ["a"])) == [None, "b"]
    assert names(inventory(rows, "repo", "org", "o", only=["a", "b"], ignore=["b"])) == ["a"]
    assert names(inventory(rows, "repo", "org", "o")) == [None, "a", "b"]


def test_manifest_and_inventory(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "x/y", "mode": "m", "dependencies": {}, "agents": ["a", "b"]}, indent=2))
    rows = read_manifests(spark, str(tmp_path / "m.json"))
    assert [r.asDict() for r in rows.collect()] == [{"name": "x/y", "mode": "m", "dependencies": {}, "agents": ["a", "b"]}]
    write_inventory(rows.select("name"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0]["name"] == "x/y"


def test_asof_ties_and_interval_bounds(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 2, "c")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["u", "v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
    at = lambda s: f"timestamp_ntz '2024-01-01 00:{s}'"
    points = spark.sql(f"SELECT * FROM VALUES (1, {at('10:00')}), (2, {at('20:00')}), (3, {at('19:59')}) AS p(id, ts)")
    spans = spark.sql(f"SELECT {at('10:00')} AS a, {at('20:00')} AS b")
    assert sorted(r.id for r in interval_join(points, spans, "ts", "a", "b", 300).collect()) == [1, 3]


def test_long_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(selection, "INLINE", 1)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "repo string")
    assert [r.repo for r in include(rows, "repo", ["a", "c"]).collect()] == ["a"]
    assert sorted((r.repo for r in exclude(rows, "repo", ["a", "c", None]).collect()), key=str) == [None, "b"]
    monkeypatch.setattr(selection, "INLINE", 1000)
    plan = exclude(rows, "repo", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_asof_of_null_keys_and_spans(spark):
    rng = random.Random(2)
    kind = "k string, t timestamp_ntz"
    times = [f"2024-03-{d:02d} {h:02d}:00:00" for d in range(28, 32) for h in range(24)]
    rows = lambda n: [(rng.choice(["a", "b", None]), rng.choice(times)) for _ in range(n)]
    left = spark.createDataFrame(rows(60), "k string, t string").selectExpr("k", "cast(t AS timestamp_ntz) AS t")
    right = spark.createDataFrame([(*r, i) for i, r in enumerate(rows(25))], "k string, t string, v int").selectExpr("k", "cast(t AS timestamp_ntz) AS u", "v")
    got = [sorted(map(tuple, asof_join(left, right, ["k"], "t", "u", ["u", "v"], span_s=s).collect()), key=str) for s in (None, 3600, 100_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60
    assert all(r[2] is None for r in got[0] if r[0] is None) and any(r[2] for r in got[0])
    r = right.collect()
    for k, t, _, v in got[0]:
        due = max(((x.u, x.v) for x in r if k is not None and x.k == k and x.u <= t), default=(None, None))
        assert v == due[1]


def test_intervals_over_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        points = spark.sql("SELECT timestamp_ntz '2024-03-31 02:30:00' AS ts")
        spans = spark.sql("SELECT timestamp_ntz '2024-03-31 02:10:00' AS a, timestamp_ntz '2024-03-31 02:40:00' AS b")
        assert interval_join(points, spans, "ts", "a", "b", 600).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bands_and_pairs(spark):
    rng = random.Random(4)
    a, b = [rng.uniform(-50, 50) for _ in range(80)], [rng.choice([rng.uniform(-50, 50), 7.0]) for _ in range(70)]
    left, right = spark.createDataFrame([(x,) for x in [*a, None]], "a double"), spark.createDataFrame([(x,) for x in [*b, None]], "b double")
    assert band_join(left, right, "a", "b", 2, 3).count() == sum(x - 2 <= y <= x + 3 for x in a for y in b)
    assert pairs_in_order(right, "b", 10.0).first()[0] == sum(x < y for x in b for y in b)
    assert pairs_in_order(right.limit(0), "b", 10.0).first()[0] == 0


def test_import_flow(spark, tmp_path):
    for org, repo in (("o", "a"), ("o", "b c"), ("p", "a")):
        (tmp_path / "in" / org / repo).mkdir(parents=True)
        (tmp_path / "in" / org / repo / "m.json").write_text(json.dumps({"name": f"{org}/{repo}", "mode": "m", "dependencies": {"x": "1"}, "agents": []}))
    out = import_projects(spark, str(tmp_path / "in"), "o", workspace="w", dry_run=str(tmp_path / "out"))
    assert sorted((r.org, r.repo, r.workspace, r.name) for r in out.collect()) == [("o", "a", "w", "o/a"), ("o", "b c", "w", "o/b c")]
    assert sorted(r.repo for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b c"]
    assert [r.repo for r in import_projects(spark, str(tmp_path / "in"), "o", only=["a", "b c"], ignore=["a"]).collect()] == ["b c"]
    assert not (tmp_path / "in" / "o" / "out").exists()


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_formats(spark, tmp_path, kind):
    schema = "i long, s string, x double, t timestamp_ntz, g string"
    rows = spark.createDataFrame([(1, 'a "quoted", \n line', 0.1, None, "u"), (2, "", -1.5, None, "v"), (None, None, None, None, "v")], schema)
    rows = rows.withColumn("t", F.when(F.col("i") == 1, F.lit("2024-02-29 12:34:56.123456").cast("timestamp_ntz")))
    files.write(rows, str(tmp_path / kind), kind, ["g"])
    back = files.read(spark, str(tmp_path / kind), kind, schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert sorted(p for p in os.listdir(tmp_path / kind) if "=" in p) == ["g=u", "g=v"]


def test_own_functions(spark):
    rows = spark.createDataFrame([(1, 10), (1, 305), (2, None)], "k int, v int")
    assert [r[0] for r in rows.orderBy("k", "v").select(digit_sum()("v")).collect()] == [1, 8, None]
    assert sorted((r.k, r.total) for r in running_totals(rows.where("v IS NOT NULL"), "k", "v").collect()) == [(1, 10.0), (1, 315.0)]


def test_page_text(spark):
    html = "<html><head><title>T</title></head><body><nav>menu</nav><!-- no --><script>if (a < b) x('</p>')</script><H1>One &amp;lt; two</H1><p>a <b>bold</b>  word<br>next</p><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(html,), (None,), ("plain",)], "html string")
    assert [r[0] for r in rows.select(page_text("html")).collect()] == ["One &lt; two\na bold word\nnext", None, "plain"]


def drain(stream, name, checkpoint, mode="append"):
    """All that a stream gives, in the driver's memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def made_stream(spark, tmp_path, batches):
    """A stream that reads a file of (id, minute, user, value) a batch, in order."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(e, m, u, "x", v) for e, m, u, v in rows], "event_id long, m int, user_id long, event_type string, value double")
        made = made.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts", "user_id", "event_type", "value").coalesce(1)
        made.write.mode("append").parquet(str(tmp_path / "s"))
        for name in os.listdir(tmp_path / "s"):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(tmp_path / "s" / name, tmp_path / "s" / f"b{i}.parquet")
                os.utime(tmp_path / "s" / f"b{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


BATCHES = [[(1, 1, 7, 1.0), (2, 12, 7, 2.0)], [(3, 9, 7, 4.0), (4, 40, 8, 8.0)], [(6, 41, 8, 32.0), (4, 40, 8, 8.0)], [(5, 3, 7, 16.0), (7, 90, 9, 64.0)]]


def minutes(rows):
    return sorted((r.start.hour * 60 + r.start.minute, r.n, r.total) for r in rows.collect())


def test_late_rows(spark, tmp_path):
    """Row 3 is late by less than the watermark and counts; row 5 comes after its window was closed and doesn't."""
    got = drain(streaming.tumbling(made_stream(spark, tmp_path, BATCHES), "10 minutes", "15 minutes"), "late", str(tmp_path / "c"))
    assert minutes(got) == [(0, 2, 5.0), (10, 1, 2.0), (40, 3, 48.0)]


def test_sliding_and_sessions(spark, tmp_path):
    stream = made_stream(spark, tmp_path, BATCHES)
    got = drain(streaming.sliding(stream, "20 minutes", "10 minutes", "15 minutes"), "slid2", str(tmp_path / "c1"))
    assert minutes(got)[:-1] == [(0, 3, 7.0), (10, 1, 2.0), (30, 3, 48.0), (40, 3, 48.0)]
    got = drain(streaming.sessions(stream, "10 minutes", "30 minutes"), "sess2", str(tmp_path / "c2"))
    assert sorted((r.user_id, r.n, r.total) for r in got.collect())[-1] == (8, 3, 48.0)


def test_state_between_batches(spark, tmp_path):
    got = drain(streaming.totals_by_user(made_stream(spark, tmp_path, BATCHES)), "totals", str(tmp_path / "c"), "update")
    best = {}
    for r in got.collect():
        best[r.user_id] = max(best.get(r.user_id, (0, 0.0)), (r.n, r.total))
    assert best == {7: (4, 23.0), 8: (3, 48.0), 9: (1, 64.0)}


def test_stream_files_are_read_once(spark, tmp_path):
    stream = made_stream(spark, tmp_path, BATCHES)
    paths = str(tmp_path / "out"), str(tmp_path / "c")
    first = streaming.to_files(streaming.first_seen(stream, "15 minutes"), *paths).count()
    assert first == streaming.to_files(streaming.first_seen(stream, "15 minutes"), *paths).count() == 6  # row 5 is late


def closed(spark, df):
    return {tuple(r) for r in df.collect()}


def test_streams_agree_with_batch(spark, tmp_path):
    path = f"{SF}/events.parquet"
    events = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "x"))
    source = str(tmp_path / "in" / "x")
    out = closed(spark, drain(streaming.tumbling(streaming.event_stream(spark, source), "1 day", "10 minutes"), "tumbled", str(tmp_path / "c1")))
    batch = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()
    want = {(r.start, r.event_type, r.n) for r in batch}
    got = {(r[0], r[2], r[3]) for r in out}
    last = max(r.start for r in batch)
    assert got <= want and {w for w in want if w[0] < last} <= got  # the last window is still open
    assert drain(streaming.sliding(streaming.event_stream(spark, source), "2 days", "1 day", "10 minutes"), "slid", str(tmp_path / "c2")).count() > 0
    sessions = drain(streaming.sessions(streaming.event_stream(spark, source), "30 minutes", "10 minutes"), "sessioned", str(tmp_path / "c3"))
    assert 0 < sessions.agg(F.sum("n")).first()[0] <= events.count()
    once = drain(streaming.first_seen(streaming.event_stream(spark, source), "10 minutes"), "once", str(tmp_path / "c4"))
    assert once.count() == events.select("event_id").distinct().count()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
