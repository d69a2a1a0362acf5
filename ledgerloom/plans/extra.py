"""Queries of sources, sinks, streams, detectors and the remaining functions."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from ..functions.calendar import day_end_ms, day_key
from ..functions.udf import blake2b
from ..operators import joins, ledger, protocol, quality, sets
from ..sources import io
from ..streaming import ledger as streams
from ..streaming import state
from . import cells as c
from . import views as v
from .views import query


@query("SELECT block AS number, tx_index, 'tx' || tx AS tx_hash, tx_index = 0 AS is_cellbase FROM txs", "txs")
def S02_normalize_blocks(spark, d):
    """Blocks as node JSON, then flattened again."""
    t = v.txs(spark, d)
    hexed = lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x)))
    listed = t.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tx_index", F.concat(F.lit("tx"), "tx").alias("hash")))).alias("l"))  # ten a block
    header = F.struct(hexed("block").alias("number"), F.lit("h").alias("hash"), F.lit("p").alias("parent_hash"), F.lit("0x0").alias("timestamp"), F.lit("0x0").alias("epoch"))
    body = F.transform("l", lambda x: F.struct(x.hash.alias("hash")))
    return io.normalize_blocks(listed.select(F.to_json(F.struct(header.alias("header"), body.alias("transactions"))).alias("json")))["txs"].select("number", "tx_index", "tx_hash", "is_cellbase")


def turned(column):
    """Little-endian bytes of an integer column."""
    digits = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8)))))


@query("SELECT outpoint, CAST(capacity AS VARCHAR) AS c, CAST(party AS VARCHAR) AS ar, CAST(outpoint AS VARCHAR) AS s, '7' AS u FROM outputs", "outputs")
def S03_decode_dao_field(spark, d):
    field = F.concat(turned("capacity"), turned("party"), turned("outpoint"), turned(F.lit(7).cast("bigint")))
    x = v.outputs(spark, d).withColumn("f", exact.decode_dao_field(field))
    return x.select("outpoint", *(F.col(f"f.{n}").cast("string").alias(n) for n in ("c", "ar", "s", "u")))


@query("SELECT outpoint, CAST(capacity AS VARCHAR) AS low, CAST(party AS VARCHAR) AS high FROM outputs", "outputs")
def S04_decode_amount(spark, d):
    x = v.outputs(spark, d).withColumn("f", exact.decode_le_u128(F.concat(turned("capacity"), turned("party"))))
    return x.select("outpoint", F.col("f.low").cast("string").alias("low"), F.col("f.high").cast("string").alias("high"))


@query("SELECT p_partkey, p_name FROM part")
def S05_read_labels(spark, d):
    return io.read_labels(spark, f"{d}/part.parquet", "p_partkey long, p_name string", "parquet")


@query("SELECT number, tx_count FROM blocks", "blocks")
def S06_write_events(spark, d):
    folder = io.work_folder(spark)
    b = v.blocks(spark, d).select("number", "tx_count")
    io.write_events(b, folder)
    return spark.read.schema(io.event_schema(b)).parquet(folder).select("number", "tx_count")


@query("SELECT party, CAST(sum(capacity) AS BIGINT) AS capacity FROM outputs GROUP BY party", "outputs")
def S07_write_snapshot(spark, d):
    folder = io.work_folder(spark)
    io.write_snapshot(c.balances(spark, d), folder)
    return spark.read.parquet(folder)


@query("SELECT day, CAST(sum(tx_count) AS BIGINT) AS txs FROM timed WHERE (date_diff('day', DATE '1970-01-01', day) + 1) * 86400000 - 28800000 <= (SELECT max(chain_ms) FROM timed) GROUP BY day", "timed")
def S08_write_sealed(spark, d):
    folder, t = io.work_folder(spark), v.timed(spark, d)
    daily = t.groupBy("day").agg(F.sum("tx_count").alias("txs")).withColumn("bucket_end", day_end_ms("day"))
    io.write_sealed(daily, folder, "day", "bucket_end", t.agg(F.max("chain_ms")).first()[0] or 0)
    return spark.read.schema(daily.schema).parquet(folder).select("day", "txs")


@query("""WITH a AS (SELECT max(created_day) AS day FROM outputs), e AS (SELECT party, created_day AS day, capacity AS c FROM cells UNION ALL SELECT party, consumed_day, -capacity FROM cells WHERE consumed_day IS NOT NULL),
s AS (SELECT party, e.day, CAST(sum(c) AS BIGINT) AS delta FROM e, a WHERE e.day <= a.day AND party IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') GROUP BY 1, 2)
SELECT party, s.day, delta, CAST(sum(delta) OVER w - delta AS BIGINT) AS before, CAST(sum(delta) OVER w AS BIGINT) AS after, CAST(sum(delta) OVER (PARTITION BY party) AS BIGINT) AS current, s.day < a.day AS complete FROM s, a WINDOW w AS (PARTITION BY party ORDER BY s.day ROWS UNBOUNDED PRECEDING)""", "cells")
def S09_export_history(spark, d):
    """Daily rows, state before and after, state now and whether the day is over, of chosen parties, all at one anchor day."""
    folder, cells_ = io.work_folder(spark), v.cells(spark, d)
    ids = v.read(spark, d, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("party"))
    events = cells_.select("party", F.col("created_day").alias("day"), "capacity").union(cells_.where("consumed_day IS NOT NULL").select("party", "consumed_day", -F.col("capacity")))
    series_ = io.entity_series(joins.lookup(events, ids, ["party"]), "party", "day", "capacity", v.outputs(spark, d).agg(F.max("created_day")))
    io.export_entity_history(ids, "party", {"daily": series_}, folder)
    return spark.read.parquet(f"{folder}/daily")


@query("SELECT item, CAST((8 + 33 + strlen(name) + CASE WHEN item % 3 = 0 THEN 0 ELSE 33 + strlen(collection) END + strlen(kind)) * 100000000 AS BIGINT) AS occupied FROM items", "items")
def P04_occupied_capacity(spark, d):
    b = lambda x: F.col(x).cast("binary")
    return v.items(spark, d).select("item", exact.occupied_capacity(b("name"), F.when(F.col("item") % 3 != 0, b("collection")), b("kind")).alias("occupied"))


@query("SELECT outpoint, capacity - capacity % 1000 AS free FROM outputs", "outputs")
def P05_free_part(spark, d):
    return v.outputs(spark, d).select("outpoint", exact.free_part("capacity", F.col("capacity") % 1000).alias("free"))


@query(f"WITH s AS (SELECT tx, CAST(sum(CASE WHEN side = 'input' THEN amount ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN side = 'output' THEN amount ELSE 0 END) AS BIGINT) AS o FROM legs GROUP BY tx) SELECT tx, greatest(i - o, 0) AS fee FROM s", "legs")
def P06_tx_fee(spark, d):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0))
    s = v.legs(spark, d).groupBy("tx").agg(side("input").alias("i"), side("output").alias("o"))
    return s.select("tx", exact.tx_fee("i", "o", F.col("o") > F.col("i")).alias("fee"))


@query("SELECT item, item % 5 = 0 AS code FROM items", "items")
def P09_code_cells(spark, d):
    data = F.when(F.col("item") % 5 == 0, F.concat(F.lit(b"\x7fELF"), F.col("name").cast("binary"))).otherwise(F.col("name").cast("binary"))
    return v.items(spark, d).select("item", ledger.is_code_cell(data).alias("code"))


@query("SELECT tx, line, amount FROM legs WHERE token = 7", "legs")
def P19_scoped_search(spark, d):
    scope, text = ledger.parse_scope("token: 7")
    return v.legs(spark, d).where(F.col({"token": "token", "tx": "tx", "addr": "party"}[scope]) == int(text)).select("tx", "line", "amount")


@query("""WITH x AS (SELECT number, CASE WHEN miner = 1 THEN 'One' WHEN miner = 2 THEN 'Two' END AS a, CASE WHEN CAST(difficulty AS VARCHAR) LIKE '7%' THEN 'Seven' END AS b FROM blocks) SELECT number, CASE WHEN a <> b THEN NULL ELSE coalesce(a, b) END AS pool, a IS NOT NULL AND b IS NOT NULL AS conflict FROM x""", "blocks")
def P22_pool_of(spark, d):
    b = v.blocks(spark, d).select("number", F.col("miner").cast("string").alias("lock"), F.col("difficulty").cast("string").alias("message"))
    locks = spark.createDataFrame([("1", "One"), ("2", "Two")], "lock string, pool string")
    return ledger.pool_of(b, locks, spark.createDataFrame([("7", "Seven")], "prefix string, pool string"), "lock", "message", strict=False).select("number", "pool", "conflict")


PROPOSED = """own AS (SELECT DISTINCT block, party FROM txs WHERE kind = 'signup'), uncle AS (SELECT DISTINCT block, party FROM txs WHERE kind = 'view' AND tx_index > 7),
zone AS (SELECT block, party, min(s) AS source FROM (SELECT *, 0 AS s FROM own UNION ALL SELECT *, 1 FROM uncle) GROUP BY block, party), done AS (SELECT DISTINCT party, block AS committed, moved FROM txs WHERE kind = 'purchase'),
first AS (SELECT z.block, z.party, z.source, min(committed) AS committed FROM zone z LEFT JOIN done t ON z.party = t.party AND committed BETWEEN z.block + 2 AND z.block + 10 GROUP BY 1, 2, 3)"""


def proposal_zone(spark, d):
    t = v.txs(spark, d)
    own = t.where("kind = 'signup'").select("block", "party").distinct()
    uncle = t.where("kind = 'view' AND tx_index > 7").select("block", "party").distinct()
    return sets.first_wins([own, uncle], ["block", "party"], ["block"])


@query(f"WITH {PROPOSED} SELECT * FROM first", "txs")
def J23_proposal_graph(spark, d):
    zone, done = proposal_zone(spark, d), v.txs(spark, d).where("kind = 'purchase'").select("party", F.col("block").alias("committed")).distinct()
    hits = joins.commitments(zone.select("party", "block"), done, "party", "block", "committed", 2, 10)
    return zone.join(hits, ["party", "block"], "left").select("block", "party", "source", "committed")


@query(f"WITH {PROPOSED}, fee AS (SELECT party, block AS committed, CAST(sum(moved) AS BIGINT) AS moved FROM txs WHERE kind = 'purchase' GROUP BY 1, 2) SELECT f.block, count(*) AS proposals, CAST(coalesce(sum(moved), 0) AS BIGINT) AS fees FROM first f LEFT JOIN fee USING (party, committed) GROUP BY f.block", "txs")
def A38_proposal_fees(spark, d):
    fee = v.txs(spark, d).where("kind = 'purchase'").groupBy("party", F.col("block").alias("committed")).agg(F.sum("moved").alias("moved"))
    return J23_proposal_graph(spark, d).join(fee, ["party", "committed"], "left").groupBy("block").agg(F.count(F.lit(1)).alias("proposals"), F.coalesce(F.sum("moved"), F.lit(0)).alias("fees"))


@query(f"WITH {c.RATED} SELECT outpoint, CAST(capacity * CAST(b.ar AS HUGEINT) // a.ar - capacity AS BIGINT) AS gain FROM outputs o JOIN rated a ON o.created_day = a.day JOIN rated b ON b.day = o.created_day + 100", "outputs", "rates", "deposits")
def F11_calculator(spark, d):
    wanted = v.outputs(spark, d).select("outpoint", "capacity", F.col("created_day").alias("from_day"), F.date_add("created_day", 100).alias("to_day"))
    r = joins.attach_rates(wanted, c.rated(spark, d), "day", "ar", a="from_day", b="to_day").where("b IS NOT NULL")
    return r.select("outpoint", exact.compensation("capacity", F.lit(0), "a", "b").alias("gain"))


@query("SELECT number, CAST(281474976710656 // (number % 5000 + 1000) AS VARCHAR) AS difficulty FROM blocks", "blocks")
def F12_compact_difficulty(spark, d):
    compact = F.lit(0x1D << 24).cast("bigint") + F.col("number") % 5000 + 1000
    return v.blocks(spark, d).select("number", exact.compact_difficulty(compact).cast("string").alias("difficulty"))


@query("SELECT DISTINCT created_day AS day, CAST((date_diff('day', DATE '1970-01-01', created_day) + 1) * 86400000 - 28800000 AS BIGINT) AS end_ms, CAST(strftime(created_day, '%Y%m%d') AS INTEGER) AS key FROM outputs", "outputs")
def F13_date_helpers(spark, d):
    return v.outputs(spark, d).select(F.col("created_day").alias("day")).distinct().select("day", day_end_ms("day").alias("end_ms"), day_key("day").alias("key"))


@query("""SELECT item, array_to_string(list_sort(list_distinct([size, item % 50, size])), ',') AS sizes, CAST(len(list_filter([size, item % 50, size], lambda x: x > 40)) AS INTEGER) AS large, list_contains([size, item % 50, size], 7) AS has_7 FROM items""", "items")
def F18_array_helpers(spark, d):
    listed = v.items(spark, d).select("item", F.array("size", F.col("item") % 50, "size").alias("s"))
    return listed.select(
        "item", F.array_join(F.array_sort(F.array_distinct("s")).cast("array<string>"), ",").alias("sizes"), F.size(F.filter("s", lambda x: x > 40)).alias("large"), F.exists("s", lambda x: x == 7).alias("has_7")
    )


@query("SELECT o_custkey AS party, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS capacity, count(*) AS n FROM orders GROUP BY 1")
def T01_stream_ledger(spark, d):
    folder = io.work_folder(spark)
    source = io.stream_table(spark, d, "orders", v.read(spark, d, "orders").schema)
    derive = lambda df: {"sums": df.groupBy(F.col("o_custkey").alias("party")).agg(F.sum(v.cents("o_totalprice")).alias("capacity"), F.count(F.lit(1)).alias("n"))}
    streams.stream_ledger(source, derive, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streams.read_committed(spark, f"{folder}/out", "sums").groupBy("party").agg(F.sum("capacity").alias("capacity"), F.sum("n").alias("n"))


def stream_events(spark, d):
    return io.stream_table(spark, d, "events", v.read(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT CAST(floor((epoch(ts) + 28800) / 86400) AS BIGINT) AS k, value FROM events) SELECT k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS moved FROM e WHERE (k + 1) * 86400 - 28800 <= (SELECT max(epoch(ts)) FROM events) GROUP BY k""")
def T02_stream_buckets(spark, d):
    folder = io.work_folder(spark)
    out = streams.stream_buckets(stream_events(spark, d), "ts", "1 day", "16 hours", n=F.count(F.lit(1)), moved=F.sum(v.cents("value")))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return done.select(F.floor((F.unix_timestamp("start") + 28_800) / 86_400).alias("k"), "n", "moved")


@query("SELECT party, CAST(sum(capacity + CASE WHEN outpoint > tip - 8 THEN 1 ELSE 0 END) AS BIGINT) AS capacity, count(*) AS n FROM outputs, (SELECT max(outpoint) AS tip FROM outputs) GROUP BY party", "outputs")
def T04_running_state(spark, d):
    """Balances kept by a stream and folded after each batch: two batches, and a third that is another branch of the last eight blocks."""
    agg = streams.IncrementalAgg("balances", lambda t: t.select("party", "block", "capacity", F.lit(1).cast("bigint").alias("n")), ["party"], ["capacity", "n"])
    o = v.outputs(spark, d).select("party", F.col("outpoint").alias("block"), "capacity")
    tip, at = o.agg(F.max("block")).first()[0] or 0, F.col("block")
    parts = [o.where(at <= tip // 2), o.where(at > tip // 2), o.where(at > tip - 8).withColumn("capacity", F.col("capacity") + 1)]
    folder = streams.feed(parts, io.work_folder(spark), lambda source, out, checkpoint: state.stream_state(source, agg, out, checkpoint, every=1))
    return agg.current(state.kept_state(spark, folder, agg))


@query("WITH tip AS (SELECT max(ts_ms) AS tip FROM txs) SELECT count(*) AS rows, count(DISTINCT party) AS parties FROM txs, tip WHERE ts_ms > tip - 24 * 3600000", "txs")
def T05_stream_rolling(spark, d):
    """The last 24 hours kept by a stream that evicts older hours: two batches, and a third that is the last eight blocks once more."""
    t = v.txs(spark, d).select("block", "party", "ts_ms")
    tip, at = t.agg(F.max("block")).first()[0] or 0, F.col("block")
    parts = [t.where(at <= tip // 2), t.where((at > tip // 2) & (at <= tip - 20)), t.where(at > tip - 20), t.where(at > tip - 8)]
    folder = streams.feed(parts, io.work_folder(spark), lambda source, out, checkpoint: state.stream_rolling(source, "ts_ms", "party", out, checkpoint, every=1))
    return state.rolling_now(spark, folder)


@query("SELECT epoch_us(ts) // 3600000000 AS hour, count(DISTINCT user_id) AS parties FROM events GROUP BY 1")
def T06_stream_distinct(spark, d):
    folder = io.work_folder(spark)
    out = streams.stream_distinct(stream_events(spark, d), "ts", "user_id", "1 hour", "1 day").select(F.unix_timestamp("bucket.start").alias("at"), "user_id")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").groupBy(exact.int_div("at", 3600).alias("hour")).agg(F.count(F.lit(1)).alias("parties"))


@query("""WITH t AS (SELECT max(number) AS tip FROM blocks) SELECT number, 'h' || number AS hash, number <= tip - 7 AS canonical FROM blocks, t UNION ALL SELECT number, 'x' || number, true FROM blocks, t WHERE number BETWEEN tip - 6 AND tip - 2""", "blocks")
def T09_canonical(spark, d):
    """A side branch that is shorter, but heavier, than the chain it leaves."""
    b = v.blocks(spark, d).select("number", F.concat(F.lit("h"), "number").alias("hash"), F.concat(F.lit("h"), F.col("number") - 1).alias("parent_hash"), F.lit(2).alias("work"))
    tip = b.agg(F.max("number").alias("_tip"))
    near = b.join(F.broadcast(tip)).where(F.col("number").between(F.col("_tip") - 6, F.col("_tip") - 2))
    side = near.select("number", F.concat(F.lit("x"), "number").alias("hash"), F.when(F.col("number") == F.col("_tip") - 6, F.col("parent_hash")).otherwise(F.concat(F.lit("x"), F.col("number") - 1)).alias("parent_hash"), F.lit(5).alias("work"))
    return streams.canonical(b.union(side), io.work_folder(spark), weight="work").select("number", "hash", "canonical")


@query('SELECT number * 2 AS "key", number AS old_tip, number + 100000 AS new_tip, CASE WHEN number % 3 = 0 THEN number * 2 + 1 END AS reversed_by FROM blocks UNION ALL SELECT number * 2 + 1, number + 100000, number, NULL FROM blocks WHERE number % 3 = 0', "blocks")
def T10_switch_events(spark, d):
    n = F.col("number")
    b = v.blocks(spark, d)
    events = b.select((n * 2).alias("key"), n.alias("old_tip"), (n + 100_000).alias("new_tip")).union(b.where("number % 3 = 0").select(n * 2 + 1, n + 100_000, n))
    return streams.switch_events(events, "old_tip", "new_tip", "key")


@query(f"WITH {c.ACTED} SELECT 'savings' AS instance, CAST(party AS VARCHAR) AS entity, count(*) AS n FROM deposits WHERE request_day IS NULL GROUP BY party UNION ALL SELECT 'activity', token || '/' || action, count(*) FROM acted GROUP BY token, action UNION ALL SELECT 'items', party || '/' || item, count(*) FROM legs GROUP BY party, item", "legs", "deposits")
def T12_incremental_instances(spark, d):
    """Each instance is rebuilt up to a block, taken on to the tip, taken back eight blocks and on again; verify() finds nothing.

    Every state is written once, since the next one, its tip and the check all read it; so are the deposits and actions, which are joined and grouped.
    """
    one = F.lit(1).cast("bigint").alias("n")
    make = lambda name, entity, block: streams.IncrementalAgg(name, lambda t: t.select(entity.alias("entity"), block.cast("bigint").alias("block"), one), ["entity"], ["n"])
    parts = [
        (make("savings", F.col("party").cast("string"), F.col("outpoint")), io.written(v.deposits(spark, d).where("request_day IS NULL").select("party", "outpoint")), "outpoint"),
        (make("activity", F.concat_ws("/", "token", "action"), F.col("tx")), io.written(c.acted(spark, d).select("token", "action", "tx")), "tx"),
        (make("items", F.concat_ws("/", "party", "item"), F.col("tx")), v.legs(spark, d), "tx"),
    ]
    tip = v.outputs(spark, d).agg(F.max("outpoint")).first()[0] or 0
    done = []
    for agg, rows, block in parts:
        at, last = F.col(block), rows.agg(F.max(block)).first()[0]
        state = io.written(agg.apply(agg.rebuild(rows.where(at <= tip - 20)), rows.where(at > tip - 20), last))
        fork = min(tip - 8, state.agg(F.max("block")).first()[0] or 0)
        state = io.written(agg.apply(agg.roll_back(state, fork), rows.where(at > fork), last))
        wrong = agg.verify(state, rows).select(F.lit(agg.name).alias("instance"), F.concat(F.lit("wrong: "), "key").alias("entity"), F.lit(-1).cast("bigint").alias("n"))
        done.append(agg.current(state).select(F.lit(agg.name).alias("instance"), "entity", "n").union(wrong))
    return done[0].union(done[1]).union(done[2])


FEED = """WITH t AS (SELECT max(block) AS tip FROM txs), b AS (SELECT block, count(*) AS n FROM txs GROUP BY block), p AS (SELECT 0 AS k UNION ALL SELECT 1),
feed AS (SELECT CASE WHEN k = 1 THEN 2 WHEN block > tip - 20 THEN 1 ELSE 0 END AS batch, block, 1 AS step, 'block' AS topic, '{"number":' || block || ',"tx_count":' || n || '}' AS value FROM b, t, p WHERE k = 0 OR block > tip - 3
UNION ALL SELECT CASE WHEN k = 1 THEN 2 WHEN block > tip - 20 THEN 1 ELSE 0 END, block, 2, 'tx', '{"tx":' || tx || ',"kind":"' || kind || '"}' FROM txs, t, p WHERE k = 0 OR block > tip - 3
UNION ALL SELECT CASE WHEN k = 1 THEN 2 WHEN block > tip - 20 THEN 1 ELSE 0 END, block, 3, 'activity', '{"party":' || party || ',"kind":"' || kind || '","moved":' || CAST(sum(moved) AS BIGINT) || '}' FROM txs, t, p WHERE k = 0 OR block > tip - 3 GROUP BY k, tip, block, party, kind
UNION ALL SELECT 0, tip - 20, 4, 'status', '{"tip":' || (tip - 20) || '}' FROM t UNION ALL SELECT k + 1, tip, 4, 'status', '{"tip":' || tip || '}' FROM t, p UNION ALL SELECT 2, tip - 3, 0, 'switch', '{"fork":' || (tip - 3) || ',"tip":' || tip || '}' FROM t)"""


def pushed(spark, d):
    """The folder of what a stream pushes over three batches, the last a switch."""
    t = v.txs(spark, d).select("tx", "block", "kind", "party", "moved")
    tip, at = t.agg(F.max("block")).first()[0] or 0, F.col("block")

    def feed(df, switch):
        return {
            "feed": streams.ordered_feed({
                "switch": switch.select("fork", "tip", F.col("fork").alias("block")),
                "block": df.groupBy("block").agg(F.count(F.lit(1)).alias("tx_count")).select("block", F.col("block").alias("number"), "tx_count"),
                "tx": df.select("block", "tx", "kind"),
                "activity": df.groupBy("block", "party", "kind").agg(F.sum("moved").alias("moved")),
                "status": df.agg(F.max("block").alias("tip")).select(F.col("tip").alias("block"), "tip"),
            })
        }

    return streams.run_parts([t.where(at <= tip - 20), t.where(at > tip - 20), t.where(at > tip - 3)], feed, io.work_folder(spark), "block", tell_switch=True)


@query(FEED + " SELECT topic, value FROM feed WHERE topic <> 'activity'", "txs")
def T14_push_feed(spark, d):
    """What a stream pushes over three batches, the last a switch: blocks, transactions, sync status, and the switch."""
    return streams.read_committed(spark, pushed(spark, d), "feed").where("topic <> 'activity'").select("topic", "value")


@query(FEED + " SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY block, step, value) AS place, topic, value FROM feed", "txs")
def T14_ordered_feed(spark, d):
    """All five topics in the order in which each batch pushes them: a switch comes before the blocks that replace others."""
    return streams.read_places(spark, f"{pushed(spark, d)}/feed").select(F.col("batch").cast("int").alias("batch"), "place", "topic", "value")


@query("SELECT DISTINCT tx, 'small' AS action, 'tokens' AS protocol FROM legs WHERE token < 10 UNION ALL SELECT tx, 'many', 'lines' FROM legs GROUP BY tx HAVING count(*) > 5", "legs")
def X01_detectors(spark, d):
    protocol.register_detector("tokens", lambda x: x.where("token < 10").select("tx", F.lit("small").alias("action")).distinct())
    protocol.register_detector("lines", lambda x: x.groupBy("tx").agg(F.count(F.lit(1)).alias("n")).where("n > 5").select("tx", F.lit("many").alias("action")))
    return protocol.detect(v.legs(spark, d), "tokens", "lines")


@query("""SELECT 'tokens' AS "check", '7' AS key, '{"amount":' || s || '}' AS expected, '{"amount":' || (s + 1) || '}' AS actual FROM (SELECT CAST(sum(amount) AS BIGINT) AS s FROM legs WHERE token = 7)""", "legs")
def X02_pluggable_aggregate(spark, d):
    """A state kept by deltas in two steps, with one delta too many, against a rebuild from the rows: verify() names the key."""
    agg = streams.IncrementalAgg("tokens", lambda t: t.select("token", F.col("tx").alias("block"), "amount"), ["token"], ["amount"])
    rows = v.legs(spark, d)
    middle = rows.agg(F.floor(F.max("tx") / 2)).first()[0] or 0
    state = agg.apply(agg.rebuild(rows.where(F.col("tx") <= middle)), rows.where(F.col("tx") > middle))
    return agg.verify(state.unionByName(spark.createDataFrame([(7, None, 1)], "token long, block long, amount long")), rows)


@query("""SELECT 'gaps' AS "check", 'fast' AS tier, 'pass' AS status, CAST(0 AS BIGINT) AS findings UNION ALL SELECT 'inputs', 'fast', 'fail', count(*) FROM inputs WHERE outpoint % 100 = 7""", "inputs")
def X03_run_checks(spark, d):
    tables = {"blocks": v.blocks(spark, d), "inputs": v.inputs(spark, d), "outputs": v.outputs(spark, d)}
    checks = [quality.Check("gaps", lambda t: quality.contiguous(t["blocks"], "number")), quality.Check("inputs", lambda t: quality.unresolved_inputs(t["inputs"], t["outputs"].where("outpoint % 100 <> 7"), "outpoint"))]
    return quality.run_checks(checks, tables)


@query()
def X04_blake2b(spark, d):
    return v.items(spark, d).select("item", F.lower(F.hex(blake2b(F.col("name").cast("binary"), b"ledgerloom"))).alias("digest"))


@query()
def L12_seeded_sample(spark, d):
    from ..operators import ranking

    return ranking.seeded_sample(v.outputs(spark, d).select("outpoint", "capacity"), "outpoint", 100, 7)
