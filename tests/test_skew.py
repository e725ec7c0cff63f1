"""Ordered primitives: many tiny slices must give what one plain window gives."""

import datetime as dt
import random
from unittest import mock

import pytest
from pyspark.sql import Window, functions as F

from needmatch.operators import access as ac, subscribe as sub, webhooks as wh
from needmatch.plans import skew as sk
from needmatch.plans.blocked import cosine_topk
from needmatch.session import materialize


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    seqs = rng.sample(range(3000), 400)
    data = [("hot" if i % 3 else f"k{i % 7}", s, rng.choice("abc")) for i, s in enumerate(seqs)]
    return spark.createDataFrame(data, "k string, seq bigint, v string").cache()


def test_row_number_and_start(spark, log):
    start = spark.createDataFrame([("hot", 1000)], "k string, _start bigint")
    got = sk.sliced_row_number(log, ["k"], sk.id_slice("seq", 50), ["seq"], "rn", start=start)
    w = Window.partitionBy("k").orderBy("seq")
    want = log.withColumn("rn", (F.row_number().over(w) + F.when(F.col("k") == "hot", 1000).otherwise(0)).cast("bigint"))
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_running_sum(log):
    got = sk.sliced_running_sum(log, ["k"], sk.id_slice("seq", 70), ["seq"], F.col("seq"), "s")
    want = log.withColumn("s", F.sum("seq").over(Window.partitionBy("k").orderBy("seq")))
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_lag(log):
    got = sk.sliced_lag(log, ["k"], sk.id_slice("seq", 30), ["seq"], F.col("v"), "p")
    want = log.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    assert rows_of(got.select(want.columns)) == rows_of(want)


@pytest.mark.parametrize("n", [1, 17, 100, 1000])
def test_newest(log, n):
    got = sk.sliced_newest(log, ["k"], sk.id_slice("seq", 40), "seq", n)
    w = Window.partitionBy("k").orderBy(F.col("seq").desc())
    want = log.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_as_of(spark, log):
    targets = spark.createDataFrame([(k, t, t * 13 % 3100) for k in ("hot", "k1", "none") for t in range(60)],
                                    "k string, t bigint, at bigint")
    got = sk.as_of(targets, log, ["k"], "at", "seq", ["v", "seq"], lambda c: sk.id_slice(c, 25))
    best = (targets.join(log, "k").filter("seq <= at").groupBy("k", "t", "at")
            .agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq")))
    want = targets.join(best, ["k", "t", "at"], "left")
    assert rows_of(got.select(want.columns)) == rows_of(want)


@pytest.mark.parametrize("rows_per_slice", [5, 60, 10**6])
def test_percentiles_with_ties(spark, rows_per_slice):
    rng = random.Random(1)
    data = [("a" if i % 3 else "b", float(rng.choice([1, 2, 2, 2, rng.random() * 100]))) for i in range(500)]
    df = spark.createDataFrame(data, "k string, x double")
    got = sk.exact_percentiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95}, rows_per_slice)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile("x", 0.5).alias("p50"), F.percentile("x", 0.95).alias("p95"))
    for g, w in zip(rows_of(got.select("k", "n", "p50", "p95"), "k"), rows_of(want, "k")):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


@pytest.mark.parametrize("gap_us", [300_000, 4_000_000])
def test_rate_limit_in_chunks_equals_sequential(spark, gap_us):
    rng = random.Random(3)
    at, data = 0, []
    for i in range(360):
        at += rng.randrange(1, gap_us)
        data.append(("hot" if i % 3 else f"k{i % 5}", i, at))
    df = (spark.createDataFrame(data, "k string, i bigint, us bigint")
          .withColumn("ts", F.timestamp_micros("us")).drop("us"))
    whole = ac.rate_limit(df, "k", "i", "ts", 7, 30)
    chunked = ac.rate_limit(df, "k", "i", "ts", 7, 30, max_rows=40)
    assert rows_of(chunked, "request_id") == rows_of(whole, "request_id")
    assert whole.filter("not allowed").count() > 0


def test_breakers_in_chunks_equal_sequential(spark):
    rng = random.Random(9)
    at, data = 0, []
    for i in range(600):
        at += rng.randrange(1, 60_000_000)
        data.append(("hot" if i % 3 else "cold", i, at, rng.random() < 0.45))
    df = (spark.createDataFrame(data, "n string, i bigint, us bigint, ok boolean")
          .withColumn("ts", F.timestamp_micros("us")).drop("us"))
    run = lambda m: wh.breaker_states(df, "n", "i", "ts", F.col("ok"), 3, 2, 120, m)
    assert rows_of(run(80), "attempt_id") == rows_of(run(10**6), "attempt_id")


def test_no_window_admits_more_than_the_limit(spark):
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 3_600_000_000) for _ in range(800))
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "k string, i bigint, us bigint").withColumn(
        "ts", F.timestamp_micros("us"))
    ok = {r["request_id"] for r in ac.rate_limit(df, "k", "i", "ts", 5, 60, max_rows=160).filter("allowed").collect()}
    kept = [t for i, t in enumerate(times) if i in ok]
    assert all(sum(1 for u in kept if t - 60_000_000 <= u <= t) <= 5 for t in kept)


def test_rate_pressure_across_slices(spark):
    rng = random.Random(6)
    data = [("hot" if i % 3 else "b", i, rng.randrange(0, 7200) * 1_000_000) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r["request_id"]: r["in_window"] for r in ac.rate_pressure(df, "k", "i", "ts", 600).collect()}
    for k, i, us in data:
        assert got[i] == sum(1 for k2, _, u in data if k2 == k and us - 600_000_000 <= u <= us)


def test_cosine_blocks_equal_one_block(spark):
    rng = random.Random(8)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    nodes = spark.createDataFrame([("p" if i % 3 else "q", i, vec()) for i in range(200)], "g string, n bigint, v array<float>")
    qs = spark.createDataFrame([("p", 1000 + i, vec(), i % 6) for i in range(40)] + [("none", 5, vec(), 3)],
                               "g string, q bigint, v array<float>, k int")
    run = lambda b: cosine_topk(qs, nodes, ["g"], "q", "n", "v", "v", block_rows=b)
    assert rows_of(run(7), "q", "rank") == rows_of(run(4096), "q", "rank")
    assert run(7).count() == sum(i % 6 for i in range(40))


def test_ranged_row_number_spreads_one_key_and_hour(spark):
    """All rows in one key and one hour, with ties of the time: no partition holds much more than its share."""
    begin = dt.datetime(2024, 1, 1)
    rows = [("hot", begin + dt.timedelta(milliseconds=(i * 7919) % 5000 // 3), (i * 7919) % 5000) for i in range(5000)]
    rows += [("b", begin, 1), ("b", begin, 0), ("c", begin + dt.timedelta(days=3), 7)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id long").repartition(5)
    start = spark.createDataFrame([("b", 10)], "k string, _start long")
    written = []
    with mock.patch.object(sk, "materialize", side_effect=lambda d, name: written.append(materialize(d, name)) or written[-1]):
        got = sk.ranged_row_number(df, ["k"], ["at", "id"], start=start, rows_per_slice=250).collect()
    want = {}
    for k, at, i in sorted(rows):
        want[k, i] = want.get((k, "n"), 10 if k == "b" else 0) + 1
        want[k, "n"] = want[k, i]
    assert {(r.k, r.id): r.rn for r in got} == {x: n for x, n in want.items() if x[1] != "n"}
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1000


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_brackets_are_narrowed_to_exact_ranks(spark, kind):
    """Many more values than a slice holds; one value stands for a third of the rows; keys of one and of few values."""
    rng = random.Random(8)
    data = [("hot", rng.gauss(0, 1000) if kind == "double" else rng.randrange(10 ** 6)) for _ in range(30000)]
    data += [("hot", 7)] * 15000 + [("one", 3)] * 400 + [("few", i % 9) for i in range(500)] + [("none", None)] * 3
    cast = float if kind == "double" else int
    data = [(k, None if v is None else cast(v)) for k, v in data]
    df = spark.createDataFrame(data, f"k string, x {kind}")
    rank = {"first": F.lit(1), "low": F.floor(F.col("n") / 100), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 3, "over": F.col("n") + 1}
    got = {r.k: r for r in sk.order_statistics(df, ["k"], "x", rank, rows_per_slice=300).collect()}
    assert set(got) == {"hot", "one", "few"}
    for k, r in got.items():
        own = sorted(v for key, v in data if key == k)
        n = len(own)
        assert (r.n, r["first"], r.low, r.mid, r.high, r.over) == (n, own[0], own[n // 100 - 1], own[n // 2 - 1], own[n - 4], None)
    wide = [r.k for r in sk.order_statistics(df, ["k"], "x", {"mid": F.floor(F.col("n") / 2)}, 1).collect()]
    assert sorted(wide) == ["few", "hot", "one"]


def test_rate_pressure_counts_by_growing_frames(spark):
    """A sliding frame is summed again for each row; growing frames are not."""
    df = spark.sql("SELECT 'u' AS k, id AS i, timestamp_micros(id * 7000 % 90000000) AS ts FROM range(3000)")
    pressure = ac.rate_pressure(df, "k", "i", "ts", 60)
    assert "RangeFrame, -" not in pressure._jdf.queryExecution().executedPlan().toString()
    at = {i: i * 7000 % 90000000 for i in range(3000)}
    got = {r["request_id"]: r["in_window"] for r in pressure.collect()}
    assert all(got[i] == sum(t - 60_000_000 <= x <= t for x in at.values()) for i, t in at.items() if i % 50 == 0) and len(got) == 3000


def dealt(df):
    """Pairs that each task makes."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("_task")).count().collect()]


@pytest.mark.parametrize("pairs", [1 << 17, 500])
def test_meet(spark, pairs):
    rng = random.Random(3)
    keys = [("hot", None)] * 60 + [(rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for _ in range(60)]
    left = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "k string, m int, l int")
    right = spark.createDataFrame([(*k, i) for i, k in enumerate(keys[20:])], "k string, m int, r int")
    with mock.patch.object(sk, "TASK_PAIRS", pairs):
        got = sk.meet(left, right, ["k", "m"], ["l"], ["r"])
        assert got.columns == ["k", "m", "l", "r"]
        found = sorted((r["l"], r["r"]) for r in got.collect())
    assert found == sorted((i, j) for i, a in enumerate(keys) for j, b in enumerate(keys[20:]) if a == b)


def test_meet_of_nothing(spark):
    left, right = spark.createDataFrame([("a", 1)], "k string, l int"), spark.createDataFrame([("b", 2)], "k string, r int")
    assert sk.meet(left, right, ["k"], ["l"], ["r"]).collect() == []


def test_pairs_of_a_hot_key_come_from_several_tasks(spark):
    """Small tables whose pairs are many: no task makes them all, whichever side would fit a broadcast."""
    n = 400
    changes = spark.range(n).select(F.col("id").alias("sequence"), F.lit("p").alias("project_id"), F.lit("k").alias("data_key"))
    agents = spark.range(n).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("agent_id"), F.lit("p").alias("project_id"), F.lit("k").alias("data_key"))
    events = changes.select(F.col("sequence").alias("event_id"), F.lit("t").alias("tenant_id"), F.lit("e").alias("event_type"), F.lit("c").alias("category"), "project_id")
    points = agents.select(F.col("agent_id").alias("endpoint_id"), F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("tenant_id"),
                           *[F.array().cast("array<string>").alias(c) for c in ("events", "categories", "project_ids")])
    with mock.patch.object(sk, "TASK_PAIRS", 1000, create=True):
        for made in (sub.affected_agents(changes, agents), wh.route(events, points)):
            sizes = dealt(made)
            assert sum(sizes) == n * n and max(sizes) < 0.9 * n * n
