"""State, windows, days, proposals and feeds of streams: bounded, exact across switches, and repeatable batch by batch."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import ledger, state

AGG = ledger.IncrementalAgg("sums", lambda t: t.select("key", "block", "amount"), ["key"], ["amount"])
ROWS = "key long, block long, amount long"


def batches(seed, count, deepest):
    """Micro-batches of a chain that now and then switches, and the canonical rows after each."""
    rng, chain, out = random.Random(seed), [], []
    for number in range(count):
        tip = max((b for _, b, _ in chain), default=-1)
        fork = rng.randint(max(-1, tip - deepest), tip) if number and rng.random() < 0.2 else tip
        new = [(rng.randint(0, 20), b, rng.randint(-9, 9)) for b in range(fork + 1, max(fork, tip) + rng.randint(1, 3)) for _ in range(rng.randint(1, 3))]
        chain = [r for r in chain if r[1] <= fork] + new
        out.append((new, list(chain)))
    return out


def sums(rows):
    found = Counter()
    for key, _, amount in rows:
        found[key] += amount
    return dict(found)


def kept(spark, path):
    return {r["key"]: r["amount"] for r in AGG.current(state.kept_state(spark, path, AGG)).collect()}


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def stored(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_state_of_two_hundred_batches_stays_bounded(spark, tmp_path):
    path, read, files = str(tmp_path / "state"), [], []
    for number, (new, chain) in enumerate(batches(1, 200, 5)):
        state.update_state(spark.createDataFrame(new, ROWS).coalesce(1), number, AGG, path, every=8)
        if number % 20 == 19:
            assert kept(spark, path) == sums(chain)
            read.append(state.kept_state(spark, path, AGG).count())
            files.append(stored(path))
    blocks = ledger.DEEPEST + 8 * 3
    assert max(read) <= 21 + 21 * blocks and max(read[5:]) <= 1.3 * max(read[1:5]) and max(files[5:]) <= max(files[:5]) + 12


@pytest.mark.parametrize("every", [1, 3])
def test_a_switch_is_exact_and_a_repeated_batch_changes_nothing(spark, tmp_path, every):
    path = str(tmp_path / "state")
    for number, (new, chain) in enumerate(batches(every, 25, 30)):
        df = spark.createDataFrame(new, ROWS).coalesce(1)
        state.update_state(df, number, AGG, path, every=every)
        state.update_state(df, number, AGG, path, every=every)
        if number % 4 == 0 or number == 24:
            assert kept(spark, path) == sums(chain)


def test_a_batch_that_fails_before_its_head_is_taken_again(spark, tmp_path, monkeypatch):
    path, done = str(tmp_path / "state"), batches(5, 6, 3)
    for number, (new, chain) in enumerate(done):
        df = spark.createDataFrame(new, ROWS).coalesce(1)
        with monkeypatch.context() as m:
            m.setattr(state, "_write_head", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                state.update_state(df, number, AGG, path, every=2)
        state.update_state(df, number, AGG, path, every=2)
        assert kept(spark, path) == sums(chain)


def test_a_switch_below_the_highest_block_less_the_deepest_stops(spark, tmp_path):
    path = str(tmp_path / "state")
    for number, blocks in enumerate([range(100), range(70, 72)]):
        state.update_state(spark.createDataFrame([(1, b, 1) for b in blocks], ROWS), number, AGG, path)
    with pytest.raises(ValueError, match="deeper"):  # within 36 of the tip, 71, but not of 99
        state.update_state(spark.createDataFrame([(1, 60, 1)], ROWS), 2, AGG, path)


def test_a_rolling_window_keeps_no_more_hours_than_it_needs(spark, tmp_path):
    path, agg, hour = str(tmp_path / "window"), state.window_agg("ts_ms", "party"), 3_600_000
    rng, rows = random.Random(4), []
    for number in range(24):
        new = [(rng.randint(0, 9), b, (b * hour) // 4 + rng.randint(0, 99)) for b in range(number * 12, number * 12 + 12) for _ in range(2)]
        if number % 5 == 4:  # a branch of the last blocks
            fork = number * 12 - 7
            new = [(p, b, t) for p, b, t in rows if b > fork] + new
            rows = [r for r in rows if r[1] <= fork]
        rows += new
        state.update_state(spark.createDataFrame(new, "party long, block long, ts_ms long").coalesce(1), number, agg, path, every=2, evict=state.evict_hours(24))
        if number % 6 == 5 or number == 23:
            start = max(t for *_, t in rows) - 24 * hour
            inside = [p for p, _, t in rows if t > start]
            assert tuple(state.rolling_now(spark, path).first()) == (len(inside), len(set(inside)))
    held = state.kept_state(spark, path, agg).where("block IS NULL").agg(F.min("hour"), F.max("hour")).first()
    assert held[1] - held[0] <= 24 and held[0] > 20


def test_days_are_written_again_only_where_touched(spark, tmp_path):
    daily = lambda rows: rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    schema = "block long, day long, amount long"
    first = [(b, b // 10, 1) for b in range(60)]
    second = [(b, b // 10, 2) for b in range(55, 60)] + [(60, 8, 2)]  # day 5 is made again, day 8 comes
    third = [(59, 7, 5), (60, 7, 5)]  # day 8 is left without rows
    files, out = [], None
    for rows in (first, second, third):
        out = ledger.feed([spark.createDataFrame(rows, schema).coalesce(1)], str(tmp_path), lambda source, to, checkpoint: ledger.stream_days(source, daily, to, checkpoint, "block", "day"))
        files.append({d: sorted(n for n in os.listdir(f"{out}/daily/{d}") if n.endswith(".parquet")) for d in os.listdir(f"{out}/daily") if d.startswith("day=")})
    want = Counter(), Counter()
    for block, day, amount in [r for r in first if r[0] < 55] + [r for r in second if r[0] < 59] + third:
        want[0][day] += 1
        want[1][day] += amount
    assert {r["day"]: (r["n"], r["amount"]) for r in ledger.read_days(spark, out).collect()} == {d: (want[0][d], want[1][d]) for d in want[0]}
    for before, after, touched in ((files[0], files[1], {5, 8}), (files[1], files[2], {5, 7, 8})):
        assert {d for d in after if before.get(d) != after[d]} == {f"day={d}" for d in touched}


@pytest.mark.parametrize("cuts", [(40,), (7, 9, 21, 22, 33)])
def test_fates_of_proposals(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    rows = [(rng.randint(0, 7), b, rng.random() < 0.4) for b in range(41) for _ in range(2)] + [(99, 0, False), (98, 5, False), (None, 3, False)]
    edges = [-1, *cuts, 40]
    parts = [spark.createDataFrame([r for r in rows if a < r[1] <= b], "key long, block long, done boolean") for a, b in zip(edges, edges[1:]) if any(a < r[1] <= b for r in rows)]

    def start(source, out, checkpoint):
        return ledger.proposal_fates(source, "key", "block", "done", 2, 6).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")

    out = ledger.feed(parts, str(tmp_path), start)
    got = sorted(((r["key"] is not None, r["key"], r["proposed"], r["fate"], r["block"]) for r in spark.read.parquet(out).collect()), key=str)
    want = []
    for key, p in {(k, b) for k, b, done in rows if not done}:
        commits = [b for k, b, done in rows if done and k == key and p + 2 <= b <= p + 6]
        want.append((key is not None, key, p, "proposed", p))
        if commits:
            want.append((key is not None, key, p, "committed", min(commits)))
        elif p + 6 + 1 < 40:
            want.append((key is not None, key, p, "expired", p + 6))
    assert got == sorted(want, key=str)


def test_a_switch_is_pushed_before_the_blocks_that_replace_others(spark, tmp_path):
    def derive(df, switch):
        blocks = df.groupBy("block").agg(F.sum("amount").alias("amount")).select("block", F.col("block").alias("number"), "amount")
        status = df.agg(F.max("block").alias("tip")).select(F.col("tip").alias("block"), "tip")
        return {"feed": ledger.ordered_feed({"status": status, "block": blocks, "switch": switch.select("fork", "tip", F.col("fork").alias("block"))})}

    parts = [spark.createDataFrame([(1, b, 1) for b in blocks], ROWS) for blocks in ((0, 1, 2), (2, 3))]
    out = ledger.run_parts(parts, derive, str(tmp_path), "block", tell_switch=True)
    rows = [(r["topic"], r["value"]) for r in spark.read.parquet(f"{out}/feed/batch=1").collect()]
    assert rows == [("switch", '{"fork":1,"tip":3}'), ("block", '{"number":2,"amount":1}'), ("block", '{"number":3,"amount":1}'), ("status", '{"tip":3}')]


def test_places_in_a_feed_come_from_its_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") * 7 % 1000)
    for number in (0, 1):
        rows.repartitionByRange(5, "k").sortWithinPartitions("k").write.option("maxRecordsPerFile", 60).parquet(f"{tmp_path}/feed/batch={number}")
    found = ledger.read_places(spark, f"{tmp_path}/feed")
    assert sorted((r["batch"], r["place"], r["k"]) for r in found.collect()) == [(b, k + 1, k) for b in (0, 1) for k in range(1000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()  # the one window is over the counts of files
    assert plan.count("Window [") == 1 and plan.index("Window [") < plan.rindex("Aggregate [batch")


def test_state_and_calls_of_proposals_do_not_grow_with_their_keys(spark, tmp_path):
    rows = [(2**62 + k, k % 5, False) for k in range(200)] + [(2**62 + k, k % 5 + 3, True) for k in range(0, 200, 2)] + [(None, 1, False), (None, 40, True)]
    spark.createDataFrame(rows, "key long, block long, done boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key long, block long, done boolean").parquet(f"{tmp_path}/in")
    fates = ledger.proposal_fates(source, "key", "block", "done", 2, 6, buckets=4)
    stream = fates.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) <= 4
    got = sorted((str(r["key"]), r["proposed"], r["fate"], r["block"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [(str(2**62 + k), k % 5, *end) for k in range(200) for end in (("proposed", k % 5), ("committed", k % 5 + 3) if k % 2 == 0 else ("expired", k % 5 + 6))]
    assert got == sorted([*want, ("None", 1, "proposed", 1), ("None", 1, "expired", 7)])
