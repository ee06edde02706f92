from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terravela.operators import catalogue as c
from terravela.streaming import limits

T0 = datetime(2024, 1, 1)
EVENTS = [("a", 0), ("a", 10), ("a", 20), ("a", 901), ("a", 1000), ("b", 5), ("b", 905), ("b", 906), ("b", 5000), ("b", 5000)]


def expected(most, seconds):
    out, state = [], {}
    for i, (key, t) in sorted(enumerate(EVENTS), key=lambda e: (e[1][1], e[0])):
        opened, n = state.get(key, (None, 0))
        if opened is None or t - opened > seconds:
            opened, n = t, 0
        state[key] = opened, n + 1
        out.append((key, i, n + 1, n + 1 > most))
    return sorted(out)


@pytest.fixture()
def events(spark):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=t), i) for i, (k, t) in enumerate(EVENTS)], "key string, at timestamp, order long")


def test_windows_open_at_a_first_event(events):
    got = limits.fold_hits(events, "key", "at", "order", 2, 900).select("key", "order", "n", "limited").collect()
    assert sorted(map(tuple, got)) == expected(2, 900)
    assert (("a", 3, 1, False) in expected(2, 900)) and (("b", 6, 2, False) in expected(2, 900))


def test_the_stream_counts_as_the_fold(spark, events, tmp_path):
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")
    query = limits.stream_hits(source, 2, 900).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("hits").collect())) == expected(2, 900)


def test_the_log_takes_each_event_once(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        limits.access_log(source, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == len(EVENTS)


def test_failures_are_cleared(spark):
    rows = [("k", T0 + timedelta(seconds=t), i, kind) for i, (t, kind) in enumerate([(0, "failure"), (1, "failure"), (2, "other"), (3, "clear"), (4, "failure"), (2000, "other"), (2001, "failure")])]
    df = spark.createDataFrame(rows, "key string, at timestamp, order long, kind string")
    got = limits.fold_failures(df, "key", "at", "order", F.col("kind"), 2, 900).orderBy("order").collect()
    assert [(r["n"], r["limited"]) for r in got] == [(1, False), (2, True), (2, True), (0, False), (1, False), (0, False), (1, False)]


def test_streams_of_several_batches_count_as_the_folds(spark, tmp_path):
    kinds = ["failure", "failure", "other", "failure", "clear", "failure", None]
    rows = [(f"k{i % 3}", T0 + timedelta(seconds=130 * i + i * i % 7), i, kinds[(i * i + i // 5) % 7]) for i in range(90)]
    for k in range(5):  # a file is a batch; the last holds the latest events
        spark.createDataFrame(rows[18 * k : 18 * (k + 1)], "key string, at timestamp, order long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(rows, "key string, at timestamp, order long, kind string")

    def streamed(run, name):
        source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "10 minutes")
        query = run(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 5
        return sorted(map(tuple, spark.table(name).select("key", "order", "n", "limited").collect()))

    failures = limits.fold_failures(whole, "key", "at", "order", F.col("kind"), 2, 900).select("key", "order", "n", "limited").collect()
    assert streamed(lambda e: limits.stream_failures(e, 2, 900), "failures") == sorted(map(tuple, failures)) and any(r["limited"] for r in failures)
    hits = limits.fold_hits(whole, "key", "at", "order", 2, 900).select("key", "order", "n", "limited").collect()
    assert streamed(lambda e: limits.stream_hits(e.drop("kind"), 2, 900), "several_hits") == sorted(map(tuple, hits))


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "sites": make([(1, 1, "quarry", "Quarry", True), (2, 1, "ridge", "Ridge", True), (3, 1, "staging", "Staging", False), (4, 2, "yard", "Yard", True)], "id long, client_id long, slug string, name string, is_published boolean"),
        "grants": make([(12, 1), (12, 4)], "user_id long, site_id long"),
        "users": make([(10, "o@x", "owner", None, True), (11, "a@x", "client", 1, True), (12, "n@x", "client", 1, True), (13, "b@x", "client", 2, True), (14, "off@x", "client", 1, False)], "id long, email string, role string, client_id long, is_active boolean"),
        "assets": make([(1, 1, "report", True), (2, 1, "photo", False), (3, 4, "report", True)], "id long, site_id long, category string, is_published boolean"),
    }


def test_tenants_see_their_own(tables):
    def seen(v):
        return {r["slug"] for r in c.visible_sites(tables["sites"], tables["grants"], v).collect()}

    assert seen(c.Viewer(11, "client", 1)) == {"quarry", "ridge"} and seen(c.Viewer(12, "client", 1)) == {"quarry"}
    assert seen(c.Viewer(13, "client", 2)) == {"yard"} and len(seen(c.Viewer(10, "owner"))) == 4 and seen(c.Viewer(15, "client", None)) == set()
    by_user = c.visible_by_user(tables["sites"], tables["grants"], tables["users"]).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in by_user} == {10: 4, 11: 2, 12: 1, 13: 1}
    assert c.visible_assets(tables["assets"], tables["sites"], tables["grants"], c.Viewer(11, "client", 1)).count() == 1
    assert c.visible_site(tables["sites"], tables["grants"], c.Viewer(11, "client", 1), "yard").count() == 0


def test_upsert_is_idempotent_and_keeps_ids(spark):
    old = spark.createDataFrame([(1, "k1", "a"), (2, "k2", "b")], "id long, slug string, title string")
    new = spark.createDataFrame([(8, "k2", "B"), (9, "k3", "c"), (7, "k3", "c")], "id long, slug string, title string")
    once = c.upsert(old, new, ["slug"])
    assert sorted(map(tuple, once.collect())) == [(1, "k1", "a"), (2, "k2", "B"), (9, "k3", "c")]
    assert sorted(map(tuple, c.upsert(once, new, ["slug"]).collect())) == sorted(map(tuple, once.collect()))


def test_keys_stay_within_their_site(spark):
    keys = ["sites/1/a.pdf", "sites/1/../2/a", "/sites/1/a", "sites/1/%2E%2e/x", "sites/1/a\\b", "sites/12/a", "sites/1/a b"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(c.key_within(F.col("k"), F.lit("sites/1/")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True] + [False] * 6
