"""Ledger operators on literal cases, and the protocol, source and stream functions that have no query."""

import datetime as dt
import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins, ledger, protocol, quality, ranking, series, sets
from ledgerloom.sources import io
from ledgerloom.streaming import ledger as streams


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_interval_shares(spark):
    df = spark.createDataFrame([(1000,), (2000,)], "ms long")
    got = {r.bucket: r.share for r in ledger.interval_histogram(df, "ms", 100, 50_000).collect()}
    assert len(got) == 501 and got[10] == got[20] == "50.000" and got[0] == "0.000"
    got = {r.bucket: r.share for r in ledger.interval_histogram(spark.createDataFrame([(1000,), (1000,), (2000,)], "ms long"), "ms", 100, 50_000).collect()}
    assert (got[10], got[20]) == ("66.666", "33.333")


def test_age_bands(spark):
    today = dt.date(2024, 6, 1)
    ages = [0, 3, 14, 60, 120, 200, 400, 1200]
    cells = spark.createDataFrame([(today - dt.timedelta(days=a), None, 10 * (k + 1)) for k, a in enumerate(ages)], "start date, end date, capacity long")
    bands = [("a", 0, 1), ("b", 1, 7), ("c", 7, 30), ("d", 30, 90), ("e", 90, 180), ("f", 180, 365), ("g", 365, 1095), ("h", 1095, None)]
    last = {}
    for r in series.age_bands(cells, "start", "end", "capacity", bands).where(F.col("day") <= F.lit(today)).orderBy("day").collect():
        last[r.band] = r.measure
    assert last == {b: 10 * (k + 1) for k, (b, *_) in enumerate(bands)}


@pytest.fixture
def small_ranges(spark):
    """Ranges that Spark would put together, being small, stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.usefixtures("small_ranges")
@pytest.mark.parametrize("large", [1_000_000, 3, 0])
def test_match_transfers_equals_greedy(spark, tmp_path, large):
    import random

    rng = random.Random(2)
    legs = [(tx, 1, party, rng.randint(-9, 9)) for tx in range(60) for party in rng.sample(range(9), rng.randint(1, 7))]
    got = {}
    for r in joins.match_transfers(spark.createDataFrame(legs, "tx long, token long, party long, delta long"), "tx", "token", "party", "delta", str(tmp_path), large).collect():
        got.setdefault(r.tx, set()).add((r.sender, r.receiver, r.amount))
    want = {}
    for tx in range(60):
        out = [[p, -d] for t, _, p, d in sorted(legs, key=lambda x: x[2]) if t == tx and d < 0]
        into = [[p, d] for t, _, p, d in sorted(legs, key=lambda x: x[2]) if t == tx and d > 0]
        pairs = set()
        while out and into:
            n = min(out[0][1], into[0][1])
            pairs.add((out[0][0], into[0][0], n))
            out[0][1] -= n
            into[0][1] -= n
            out, into = [x for x in out if x[1]], [x for x in into if x[1]]
        pairs |= {(p, None, n) for p, n in out} | {(None, p, n) for p, n in into}
        if pairs:
            want[tx] = pairs
    assert got == want


def test_as_of(spark):
    left = spark.createDataFrame([(5,), (10,), (11,), (250,), (1,)], "t long")
    right = spark.createDataFrame([(5, "a"), (10, "b"), (120, "c")], "at long, v string")
    assert rows(joins.as_of(left, right, "t", "at", "v", bucket_ms=50), "t") == [(1, None), (5, "a"), (10, "b"), (11, "b"), (250, "c")]


def test_top_n_with_rest_and_pages(spark):
    daily = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (2, "a", 7), (2, "b", 1), (2, "c", 3)], "day int, label string, used long")
    assert rows(ranking.top_n_with_rest(daily, "day", "label", "used", 1), "day", "label") == [(1, "a", 5), (1, "rest", 9), (2, "a", 7), (2, "rest", 4)]
    scores = spark.createDataFrame([("a", 3), ("b", 5), ("c", 3), ("d", 1)], "k string, m long")
    assert rows(ranking.ranked_page(scores, "m", "k", 2, (3, "a")), "position") == [("c", 3, 3), ("d", 1, 4)]
    assert ranking.seeded_sample(scores, "k", 2, 1).collect() == ranking.seeded_sample(scores.repartition(3), "k", 2, 1).collect()


def test_pools_names_scopes(spark):
    blocks = spark.createDataFrame([(1, "l1", "x"), (2, "l9", "/pool2/abc"), (3, "l9", "?")], "number long, lock string, message string")
    locks, messages = spark.createDataFrame([("l1", "One")], "lock string, pool string"), spark.createDataFrame([("/pool2", "Two")], "prefix string, pool string")
    assert [(r.number, r.pool) for r in ledger.pool_of(blocks, locks, messages, "lock", "message").orderBy("number").collect()] == [(1, "One"), (2, "Two"), (3, None)]
    clash = spark.createDataFrame([(1, "l1", "/pool2")], "number long, lock string, message string")
    with pytest.raises(Exception, match="two pools"):
        ledger.pool_of(clash, locks, messages, "lock", "message").collect()
    assert ledger.parse_scope("TX: 0xab") == ("tx", "0xab") and ledger.parse_scope("foo:bar") == (None, "foo:bar") and ledger.parse_scope("x") == (None, "x")
    elf = spark.createDataFrame([(b"\x7fELF12",), (b"no",), (None,)], "data binary")
    assert [r.x for r in elf.select(ledger.is_code_cell("data").alias("x")).collect()] == [True, False, False]


def test_detectors(spark):
    legs = spark.createDataFrame([(1, "input"), (2, "output"), (2, "input")], "tx long, side string")
    protocol.register_detector("seen", lambda d: d.select("tx", F.lit("seen").alias("action")).distinct())
    protocol.register_detector("spent", lambda d: d.where("side = 'input'").select("tx", F.lit("spent").alias("action")))
    assert sorted((r.protocol, r.tx) for r in protocol.detect(legs, "seen", "spent").collect()) == [("seen", 1), ("seen", 2), ("spent", 1), ("spent", 2)]


def test_checks(spark):
    blocks = spark.createDataFrame([(1, "a", "z"), (2, "b", "a"), (3, "c", "x"), (5, "e", "d")], "number long, hash string, parent string")
    assert sorted((r.check, r.key) for r in quality.contiguous(blocks, "number", "hash", "parent").collect()) == [("contiguous", "5"), ("parent_hash", "3")]
    ring = spark.createDataFrame([(1, 4), (4, 9), (9, 1)], "id long, next long")
    assert quality.linked_ring(ring, "id", "next").count() == 0
    assert quality.linked_ring(spark.createDataFrame([(1, 9), (4, 9), (9, 1)], "id long, next long"), "id", "next").count() == 2
    found = quality.run_checks([quality.Check("gaps", lambda t: quality.contiguous(t["blocks"], "number")), quality.Check("broken", lambda t: t["none"]), quality.Check("fine", lambda t: t["blocks"].limit(0))], {"blocks": blocks})
    assert {r.check: r.status for r in found.collect()} == {"gaps": "fail", "broken": "error: KeyError", "fine": "pass"}
    peaks = spark.createDataFrame([("s", 1, 5), ("s", 2, 4)], "k string, day int, v long")
    assert quality.decreasing(peaks, ["k"], "day", "v").count() == 1


def test_presence_and_flow(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(sets.presence(wanted, "k", {"chain": spark.createDataFrame([("a",)], "k string"), "pool": spark.createDataFrame([("a",), ("b",)], "k string")}), "k") == [("a", "chain"), ("b", "pool"), ("c", "none")]


def test_normalize_blocks(spark):
    lock = {"code_hash": "0x1", "hash_type": "type", "args": "0x"}
    out = {"capacity": "0x64", "lock": lock, "type": None}
    txs = [{"hash": "0xa", "inputs": [{"since": "0x0", "previous_output": {"tx_hash": "0x0", "index": "0xffffffff"}}], "outputs": [out], "outputs_data": ["0x"]}, {"hash": "0xb", "inputs": [{"since": "0x0", "previous_output": {"tx_hash": "0xa", "index": "0x0"}}], "outputs": [out, out], "outputs_data": ["0x", "0x01"]}]
    block = {"header": {"number": "0x10", "hash": "0xh", "parent_hash": "0xg", "timestamp": "0x3e8", "epoch": "0x7080001000005"}, "transactions": txs}
    t = io.normalize_blocks(spark.createDataFrame([(json.dumps(block),)], "json string"))
    assert rows(t["blocks"]) == [(16, "0xh", "0xg", 1000, 5, 2)]
    assert rows(t["txs"], "tx_index") == [(16, 0, "0xa", True, 1, 1), (16, 1, "0xb", False, 1, 2)]
    assert [(r.previous_tx_hash, r.previous_index) for r in t["inputs"].collect()] == [("0xa", 0)]
    assert sorted((r.tx_hash, r["index"], r.capacity, r.data) for r in t["outputs"].collect()) == [("0xa", 0, 100, "0x"), ("0xb", 0, 100, "0x"), ("0xb", 1, 100, "0x01")]


def test_sinks(spark, tmp_path):
    df = spark.range(0, 300_000, 50_000).withColumnRenamed("id", "number")
    io.write_events(df, f"{tmp_path}/events")
    read = io.read_ledger(spark, f"{tmp_path}/events", 100_000, 199_999)
    assert sorted(r.number for r in read.collect()) == [100_000, 150_000] and "PartitionFilters: [isnotnull(block_range" in read._jdf.queryExecution().toString()
    days = spark.createDataFrame([("2024-01-01", 10, 1), ("2024-01-02", 20, 2), ("2024-01-03", 30, 3)], "day string, bucket_end long, n long")
    io.write_sealed(days, f"{tmp_path}/days", "day", "bucket_end", 20)
    io.write_sealed(days.withColumn("n", F.col("n") + 10).where("n > 11"), f"{tmp_path}/days", "day", "bucket_end", 30)
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [("2024-01-01", 1), ("2024-01-02", 12), ("2024-01-03", 13)]
    io.write_snapshot(df, f"{tmp_path}/snapshot")
    io.export_entity_history(df.limit(1), "number", {"all": df}, f"{tmp_path}/export", "json")
    assert spark.read.json(f"{tmp_path}/export/all").count() == 1
    (tmp_path / "labels.csv").write_text("code,name\n1,one\n")
    assert rows(io.read_labels(spark, f"{tmp_path}/labels.csv", "code long, name string")) == [(1, "one")]


def test_rollback_equals_direct(spark):
    agg = streams.IncrementalAgg("sums", lambda t: t.select("k", "block", "v"), ["k"], ["v"])
    old = spark.createDataFrame([(k % 3, b, b * k) for b in range(60) for k in range(4)], "k long, block long, v long")
    new = spark.createDataFrame([(k % 3, b, 7) for b in range(50, 70) for k in range(4)], "k long, block long, v long")
    state = agg.apply(agg.rebuild(old.where("block < 45")), old.where("block >= 45"))
    state = agg.apply(agg.roll_back(state, 49), new)
    direct = old.where("block <= 49").union(new)
    assert rows(agg.current(state), "k") == rows(agg.current(agg.rebuild(direct)), "k") and agg.verify(state, direct).count() == 0


def test_canonical_and_switches(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "a", "-"), (2, "b", "a"), (2, "x", "a"), (3, "c", "b"), (4, "d", "c"), (3, "y", "x")], "number long, hash string, parent_hash string")
    got = streams.canonical(blocks, str(tmp_path / "a"), depth=4)
    assert {r.hash for r in got.where("canonical").collect()} == {"a", "b", "c", "d"}
    heavy = blocks.withColumn("work", F.when(F.col("hash").isin("x", "y"), 10).otherwise(1))
    assert {r.hash for r in streams.canonical(heavy, str(tmp_path / "b"), weight="work").where("canonical").collect()} == {"a", "x", "y"}
    long = spark.createDataFrame([(n, f"h{n}", f"h{n - 1}") for n in range(90)] + [(n, f"x{n}", f"x{n - 1}" if n > 60 else "h59") for n in range(60, 95)], blocks.schema)
    found = {r.hash: r.canonical for r in streams.canonical(long, str(tmp_path / "c")).collect()}
    assert all(found[f"h{n}"] == (n < 60) for n in range(90)) and all(found[f"x{n}"] for n in range(60, 95))
    assert streams.canonical(blocks.limit(0), str(tmp_path / "d")).count() == 0
    forked = long.union(spark.createDataFrame([(5, "old", "h4")], blocks.schema))
    with pytest.raises(ValueError, match="settled"):
        streams.canonical(forked, str(tmp_path / "e"))
    told = forked.withColumn("flag", F.col("hash") != "old")
    assert not {r.hash: r.canonical for r in streams.canonical(told, str(tmp_path / "f"), settled="flag").collect()}["old"]
    events = spark.createDataFrame([(1, "p", "q"), (2, "q", "p"), (3, "r", "s")], "key long, old_tip string, new_tip string")
    assert {r.key: r.reversed_by for r in streams.switch_events(events, "old_tip", "new_tip", "key").collect()} == {1: 2, 2: None, 3: None}


def test_switches_deeper_than_36_blocks_stop(spark, tmp_path):
    agg = streams.IncrementalAgg("sums", lambda t: t.select("k", "block", "v"), ["k"], ["v"])
    old = spark.createDataFrame([(1, b, 1) for b in range(100)], "k long, block long, v long")
    state = agg.apply(agg.rebuild(old.where("block < 50")), old.where("block >= 50"))
    assert rows(agg.current(agg.roll_back(state, 63))) == [(1, 64)]
    with pytest.raises(Exception, match="deeper than 36"):
        agg.roll_back(state, 20).collect()
    with pytest.raises(ValueError, match="deeper than 36"):
        streams.rollback({"x": old}, 20, "block", 99)
    chain = spark.createDataFrame([(b, f"h{b}") for b in range(100)], "number long, hash string")
    other = chain.withColumn("hash", F.when(F.col("number") > 50, "x").otherwise(F.col("hash")))
    with pytest.raises(Exception, match="deeper than 36"):
        streams.detect_switch(other, chain).collect()
    assert rows(streams.detect_switch(chain.withColumn("hash", F.when(F.col("number") > 90, "x").otherwise(F.col("hash"))), chain)) == [(90, 91)]


def test_a_stream_takes_back_a_switch_and_stops_at_a_deep_one(spark, tmp_path):
    rows_of = lambda blocks, v: spark.createDataFrame([(b, b % 3, v) for b in blocks], "block long, party long, v long")
    derive = lambda df: {"sums": df.groupBy("party", "block").agg(F.sum("v").alias("v"))}
    parts = [rows_of(range(50), 1), rows_of(range(50, 60), 1), rows_of(range(55, 62), 10), rows_of(range(58, 64), 100)]
    folder = streams.run_parts(parts, derive, str(tmp_path / "s"), "block")
    kept = {r.block: r.v for r in streams.read_committed(spark, folder, "sums", "block").collect()}
    assert kept == {b: 1 if b < 55 else 10 if b < 58 else 100 for b in range(64)}
    assert rows(streams.switches(spark, folder).select("fork", "tip"), "tip") == [(54, 61), (57, 63)]
    with pytest.raises(Exception, match="deeper than 36"):
        streams.run_parts([rows_of(range(5, 70), 5)], derive, str(tmp_path / "s"), "block")
    assert {r.block: r.v for r in streams.read_committed(spark, folder, "sums", "block").collect()} == kept


def test_prefix_parties(spark):
    short = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "p string")
    full = spark.createDataFrame([("aa1",), ("bb1",), ("bb2",)], "o string")
    assert rows(joins.merge_prefix_parties(short, full, "p", "o", 2, strict=False), "p") == [("aa", 1, "aa1", "merged"), ("bb", 2, None, "ambiguous"), ("cc", 0, None, "alone")]
    with pytest.raises(Exception, match="fits several"):
        joins.merge_prefix_parties(short, full, "p", "o", 2).collect()


def test_places_over_ranges(spark, tmp_path):
    import random

    rng = random.Random(1)
    data = [(k, rng.choice([1, 5, 5, 5, 9])) for k in range(200)]
    got = rows(series.all_positions(spark.createDataFrame(data, "k long, m long"), "m", "k", str(tmp_path / "p")).select("position", "k"), "position")
    assert got == [(n + 1, k) for n, (_, k) in enumerate(sorted((-m, k) for k, m in data))]


def stream_of(spark, tmp_path, parts, schema):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_stream_equals_batch(spark, tmp_path):
    parts = [[(b, b % 3, 10 * b) for b in range(k * 10, k * 10 + 10)] for k in range(3)]
    source = stream_of(spark, tmp_path, parts, "block long, party long, v long")
    derive = lambda df: {"sums": df.groupBy("party").agg(F.sum("v").alias("v"))}
    streams.stream_ledger(source, derive, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = streams.read_committed(spark, f"{tmp_path}/out", "sums").groupBy("party").agg(F.sum("v").alias("v"))
    whole = spark.createDataFrame([r for p in parts for r in p], "block long, party long, v long")
    assert rows(got, "party") == rows(derive(whole)["sums"], "party")


def test_stream_buckets_emit_sealed_days_once(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    source = stream_of(spark, tmp_path, [[(hour(1), 1)], [(hour(15), 1), (hour(17), 2)], [(hour(50), 5)]], "ts timestamp, n long")
    out = streams.stream_buckets(source, "ts", "1 day", "16 hours", n=F.sum("n"))
    q = out.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.end, r.n) for r in spark.table("buckets").orderBy("start").collect()] == [(hour(16), 2), (hour(40), 2)]


def test_stream_distinct(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    source = stream_of(spark, tmp_path, [[(at(1), "a"), (at(2), "a")], [(at(3), "b"), (at(5), "a")], [(at(70), "a")]], "ts timestamp, who string")
    q = streams.stream_distinct(source, "ts", "who", "1 hour").writeStream.format("memory").queryName("parties").option("checkpointLocation", f"{tmp_path}/cp3").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("parties").groupBy("bucket").agg(F.count("*").alias("n")).collect()) == [1, 2]


def test_small_stream_helpers(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, at long, v string")
    assert rows(streams.latest_per_key(df, ["k"], "at"), "k") == [(1, 2, "b"), (2, 1, "c")]
    assert {r.topic for r in streams.push_feed({"block": df, "tx": df.limit(1)}).collect()} == {"block", "tx"}
    assert streams.rollback({"x": df}, 1, "at")["x"].count() == 2
    with pytest.raises(ValueError):
        joins.neighbourhood(df, df.select("k"), "k", "at", 6)


@pytest.mark.usefixtures("small_ranges")
def test_a_crowded_transaction_is_matched_in_several_tasks(spark, tmp_path):
    """An airdrop of 40,000 receivers and a swap of many parties: no task holds a transaction."""
    drop = spark.range(40_000).select(F.lit(1).alias("tx"), F.lit(1).alias("token"), F.col("id").alias("party"), (F.col("id") % 7 + 1).alias("delta"))
    sender = spark.createDataFrame([(1, 1, 50_000, -150_000), (2, 1, 3, -5), (2, 1, 4, 5)], "tx int, token int, party long, delta long")
    found = joins.match_transfers(drop.union(sender), "tx", "token", "party", "delta", str(tmp_path), 1000)
    rows = found.where("tx = 1")
    total = rows.agg(F.sum("amount"), F.count_if(F.col("sender").isNull()), F.count(F.lit(1)), F.count_if(F.col("receiver").isNull())).first()
    given = sum(k % 7 + 1 for k in range(40_000))
    assert total[0] == given and total[3] == 0 and total[1] > 0 and total[2] in (40_000, 40_001)
    assert rows.where("sender IS NOT NULL").agg(F.sum("amount")).first()[0] == 150_000
    assert [tuple(r) for r in found.where("tx = 2").collect()] == [(2, 1, 3, 4, 5)]
    parts = spark.read.parquet(f"{tmp_path}/parties").where("tx = 1").groupBy("_range").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 40_000


@pytest.mark.usefixtures("small_ranges")
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles(spark, tmp_path, seed):
    import random

    import numpy as np

    rng = random.Random(seed)
    groups = {"hot": [rng.choice([1, 2, 5, rng.randint(0, 10**6)]) for _ in range(3000)], "one": [7], "two": [1, 4], "same": [3] * 50, "null": [None, None]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in series.exact_quantiles(spark.createDataFrame(rows, "g string, x long").repartition(7), "g", "x", wanted, str(tmp_path / "ranges")).collect()}
    assert set(got) == set(groups) - {"null"}
    for g in got:
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(float(np.quantile(groups[g], q)))
    assert spark.read.parquet(str(tmp_path / "ranges")).where("g = 'hot'").select("_range").distinct().count() > 1


def test_fee_stats_leave_out_the_cellbase(spark):
    rows = [(1, 0, 1, True), (1, 30, 7, False), (1, 31, 7, False), (1, 10, 3, False), (2, 5, 2, True)]
    got = {r["b"]: r for r in ledger.block_fee_stats(spark.createDataFrame(rows, "b long, fee long, size long, base boolean"), "b", "fee", "size", "base").collect()}
    assert (got[1]["txs"], got[1]["size"], tuple(got[1]["least"]), tuple(got[1]["most"]), got[1]["mean"]) == (4, 18, (10, 3), (31, 7), (30 * 3 + 31 * 3 + 10 * 7) * 1000 // 63)
    assert (got[2]["txs"], got[2]["least"], got[2]["mean"]) == (1, None, None)


def test_block_fee_stats_call_nothing_for_each_block(spark):
    txs = spark.createDataFrame([(b, t, b * 13 % 7 + t, t % 5 + 1, t == 0) for b in range(50) for t in range(6)], "block long, tx long, fee long, size long, cellbase boolean")
    found = ledger.block_fee_stats(txs, "block", "fee", "size", "cellbase")
    assert "InPandas" not in found._jdf.queryExecution().toString()
    got = {r["block"]: (r["txs"], r["size"], r["mean"]) for r in found.collect()}
    rates = {b: [Fraction((b * 13 % 7 + t) * 1000, t % 5 + 1) for t in range(1, 6)] for b in range(50)}
    assert got == {b: (6, 16, (sum(x) / 5).__floor__()) for b, x in rates.items()}


def test_tasks_that_match_transfers_grow_in_number_with_the_legs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "TASK_LEGS", 500)
    legs = spark.range(4000).select(F.floor(F.col("id") / 2).alias("tx"), (F.floor(F.col("id") / 2) % 3).alias("token"), (F.col("id") % 2).alias("party"), (F.col("id") % 2 * 2 - 1).alias("delta"))
    found = joins.match_transfers(legs, "tx", "token", "party", "delta", str(tmp_path))
    tasks = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 4 and max(tasks) < 500 and sum(tasks) == 2000
    assert found.where("sender = 0 AND receiver = 1 AND amount = 1").count() == 2000


def test_a_known_tip_and_a_check_sum_each_table_once(spark):
    agg = streams.IncrementalAgg("sums", lambda t: t.select("k", "block", "v"), ["k"], ["v"])
    old, new = (spark.createDataFrame([(k % 3, b, b * k) for b in blocks for k in range(4)], "k long, block long, v long") for blocks in (range(60), range(60, 70)))
    state = agg.apply(agg.rebuild(old), new, 69)
    assert rows(state) == rows(agg.apply(agg.rebuild(old), new))
    sums = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert sums(state) == 2  # the rebuild, and the fold of both
    checked = agg.verify(spark.createDataFrame(state.collect(), state.schema), old.union(new))
    assert sums(checked) == 2 and checked.count() == 0  # sums by key of rows and state, none by block
