"""Queries over blocks and transactions."""

from pyspark.sql import functions as F

from ..functions import exact
from ..functions.calendar import complete_only, day_end_ms, day_key, local_hour
from ..operators import joins, ledger, protocol, quality, ranking, series, sets
from ..sources import io
from ..streaming import ledger as streams
from . import views as v
from .views import query

def cut_text(part, whole, places=3):
    """SQL text of part / whole in percent, cut."""
    n = f"CAST({part} * 100 * {10**places} // {whole} AS BIGINT)"
    return f"CAST({n} // {10**places} AS VARCHAR) || '.' || lpad(CAST({n} % {10**places} AS VARCHAR), {places}, '0')"


EMPTY = 'SELECT CAST(NULL AS VARCHAR) AS "check", CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM {0} WHERE 1 = 0'
KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT number, ts_ms, tx_count, miner FROM blocks, (SELECT max(number) AS tip FROM blocks) WHERE number BETWEEN tip // 10 AND tip // 2", "blocks")
def S01_read_ledger(spark, d):
    """A range of blocks from a table that is stored by block range."""
    folder, b = io.work_folder(spark), v.blocks(spark, d).select("number", "ts_ms", "tx_count", "miner")
    io.write_events(b, folder)
    tip = b.agg(F.max("number")).first()[0] or 0
    return io.read_ledger(spark, folder, tip // 10, tip // 2, io.event_schema(b)).select(*b.columns)


@query("SELECT kind AS endpoint, count(*) AS n, count(*) FILTER (WHERE moved < 1000) / count(*) AS error_rate, quantile_cont(CAST(moved AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(moved AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(moved AS DOUBLE), 0.99) AS p99, count(*) * 1000 / nullif(max(ts_ms) - min(ts_ms), 0) AS throughput FROM txs GROUP BY kind", "txs")
def S10_latency_summary(spark, d):
    from ..sources.io import latency_summary

    t = v.txs(spark, d).withColumn("failed", F.col("moved") < 1000).withColumnRenamed("kind", "endpoint")
    return latency_summary(t, "endpoint", "moved", "failed", "ts_ms")


@query("""WITH a AS (SELECT kind, quantile_cont(CAST(moved AS DOUBLE), 0.95) AS p95 FROM txs WHERE block % 2 = 0 GROUP BY kind), b AS (SELECT kind, quantile_cont(CAST(moved AS DOUBLE), 0.95) AS p95 FROM txs WHERE block % 2 = 1 GROUP BY kind)
SELECT kind AS endpoint, a.p95 AS base_p95, b.p95 AS p95, CASE WHEN a.p95 IS NULL THEN 'new' WHEN b.p95 IS NULL THEN 'gone' WHEN b.p95 / a.p95 - 1 > 0.2 THEN 'regression' WHEN b.p95 / a.p95 - 1 < -0.1 THEN 'improvement' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (kind)""", "txs")
def S11_compare_summaries(spark, d):
    from ..sources.io import compare_summaries, latency_summary

    t = v.txs(spark, d).withColumn("failed", F.lit(False)).withColumnRenamed("kind", "endpoint")
    return compare_summaries(latency_summary(t.where("block % 2 = 0"), "endpoint", "moved", "failed"), latency_summary(t.where("block % 2 = 1"), "endpoint", "moved", "failed"), "endpoint")


@query("SELECT number, ts_ms, chain_ms FROM timed", "timed")
def P01_chain_time(spark, d):
    return v.timed(spark, d).select("number", "ts_ms", "chain_ms")


@query("SELECT number, day, hour, CAST((chain_ms + 28800000) // 3600000 % 24 AS INTEGER) AS local_hour, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS day_key FROM timed", "timed")
def P02_calendar(spark, d):
    return v.timed(spark, d).select("number", "day", "hour", local_hour("chain_ms").alias("local_hour"), day_key("day").alias("day_key"))


DAILY = "SELECT day, count(*) AS blocks, CAST(sum(tx_count) AS BIGINT) AS txs, CAST(sum(interval_ms) AS BIGINT) AS interval_sum, count(interval_ms) AS interval_count FROM timed GROUP BY day"
COMPLETE = "(date_diff('day', DATE '1970-01-01', day) + 1) * 86400000 - 28800000 <= (SELECT max(chain_ms) FROM timed)"


@query(f"SELECT day, count(*) AS blocks, CAST(sum(interval_ms) // count(interval_ms) AS BIGINT) AS avg_interval_ms FROM timed WHERE {COMPLETE} GROUP BY day", "timed")
def P03_complete_days(spark, d):
    t = v.timed(spark, d)
    done = complete_only(t, day_end_ms("day"), t.agg(F.max("chain_ms")))
    return done.groupBy("day").agg(F.count(F.lit(1)).alias("blocks"), exact.int_div(F.sum("interval_ms"), F.count("interval_ms")).alias("avg_interval_ms"))


@query("""WITH x AS (SELECT day, 1 AS b, tx_count AS t, interval_ms AS i, CASE WHEN interval_ms IS NULL THEN 0 ELSE 1 END AS c, 0 AS m, 0 AS n, 0 AS u, 0 AS o, 0 AS p FROM timed UNION ALL SELECT day, 0, 0, 0, 0, moved, 0, 0, 0, 0 FROM txs
UNION ALL SELECT created_day, 0, 0, 0, 0, 0, 1, 0, occupied, 0 FROM cells UNION ALL SELECT consumed_day, 0, 0, 0, 0, 0, 0, 1, 0, occupied FROM cells WHERE consumed_day IS NOT NULL)
SELECT day, CAST(sum(b) AS BIGINT) AS blocks, CAST(sum(t) AS BIGINT) AS txs, CAST(coalesce(sum(i), 0) AS BIGINT) AS interval_sum, CAST(sum(c) AS BIGINT) AS interval_count, CAST(sum(m) AS BIGINT) AS moved, CAST(sum(n) AS BIGINT) AS cells_created, CAST(sum(u) AS BIGINT) AS cells_consumed, CAST(sum(o) AS BIGINT) AS occupied_created, CAST(sum(p) AS BIGINT) AS occupied_consumed FROM x GROUP BY day""", "timed", "txs", "cells")
def A01_daily_chain_stats(spark, d):
    """Daily facts of blocks, transactions and cells, joined by day."""
    o, one = v.outputs(spark, d), F.count(F.lit(1))
    spent = joins.resolve_inputs(v.inputs(spark, d), o, ["outpoint"])
    facts = [
        ledger.totals(v.timed(spark, d), ["day"], blocks=one, txs=F.sum("tx_count"), interval_sum=F.sum("interval_ms"), interval_count=F.count("interval_ms")),
        ledger.totals(v.txs(spark, d), ["day"], moved=F.sum("moved")),
        ledger.totals(o.withColumnRenamed("created_day", "day"), ["day"], cells_created=one, occupied_created=F.sum("occupied")),
        ledger.totals(spent.withColumnRenamed("consumed_day", "day"), ["day"], cells_consumed=one, occupied_consumed=F.sum("occupied")),
    ]
    return ledger.sum_facts(facts, ["day"])


@query("SELECT hour, count(*) AS blocks, CAST(sum(tx_count) AS BIGINT) AS txs FROM timed GROUP BY hour", "timed")
def A02_hourly_chain_stats(spark, d):
    return ledger.totals(v.timed(spark, d), ["hour"], blocks=F.count(F.lit(1)), txs=F.sum("tx_count"))


@query("SELECT epoch, min(number) AS first_block, max(number) AS last_block, count(*) AS length, max(chain_ms) - min(chain_ms) AS duration_ms, CAST(sum(tx_count) AS BIGINT) AS txs FROM timed GROUP BY epoch", "timed")
def A03_epoch_stats(spark, d):
    return ledger.totals(v.timed(spark, d), ["epoch"], first_block=F.min("number"), last_block=F.max("number"), length=F.count(F.lit(1)), duration_ms=F.max("chain_ms") - F.min("chain_ms"), txs=F.sum("tx_count"))


@query(f"""WITH r AS (SELECT day, miner, count(*) AS blocks, CAST(sum(difficulty // 36 + CASE WHEN number % 36 < difficulty % 36 THEN 1 ELSE 0 END) AS BIGINT) AS reward FROM timed GROUP BY day, miner), p AS (SELECT miner, CAST(sum(blocks) AS BIGINT) AS week_blocks FROM r WHERE day < (SELECT max(day) FROM r) AND day >= (SELECT max(day) FROM r) - 7 GROUP BY miner), w AS (SELECT sum(week_blocks) AS w FROM p)
SELECT day, miner, blocks, reward, week_blocks, CASE WHEN week_blocks IS NOT NULL THEN {cut_text('week_blocks', 'w')} END AS share FROM r LEFT JOIN p USING (miner), w""", "timed")
def A04_miner_share(spark, d):
    b = v.timed(spark, d).withColumn("reward", exact.block_issuance(F.col("number") % 36, F.lit(36).cast("bigint"), "difficulty"))
    return ledger.miner_share(b, "day", "miner", "reward")


@query("SELECT day, CAST(sum(tx_count) AS BIGINT) AS txs FROM timed GROUP BY day", "timed")
def A05_tx_count(spark, d):
    return ledger.totals(v.timed(spark, d), ["day"], txs=F.sum("tx_count"))


@query("SELECT day, CAST(sum(interval_ms) // count(interval_ms) AS BIGINT) AS avg_interval_ms FROM timed WHERE interval_ms IS NOT NULL GROUP BY day", "timed")
def A06_avg_interval(spark, d):
    t = v.timed(spark, d).where("interval_ms IS NOT NULL")
    return t.groupBy("day").agg(exact.int_div(F.sum("interval_ms"), F.count("interval_ms")).alias("avg_interval_ms"))


@query("SELECT day, CAST((2 * sum(difficulty) * 1000 + sum(interval_ms)) // (2 * sum(interval_ms)) AS BIGINT) AS hash_rate FROM timed WHERE interval_ms IS NOT NULL GROUP BY day HAVING sum(interval_ms) > 0", "timed")
def A07_hash_rate(spark, d):
    s = v.timed(spark, d).where("interval_ms IS NOT NULL").groupBy("day").agg((F.sum("difficulty") * 1000).alias("w"), F.sum("interval_ms").alias("t")).where("t > 0")
    return s.select("day", exact.half_up("w", "t").alias("hash_rate"))


@query("SELECT day, CAST(sum(difficulty) // count(*) AS BIGINT) AS mean_difficulty FROM timed GROUP BY day", "timed")
def A08_mean_difficulty(spark, d):
    return v.timed(spark, d).groupBy("day").agg(exact.int_div(F.sum("difficulty"), F.count(F.lit(1))).alias("mean_difficulty"))


@query(f"WITH s AS (SELECT day, sum(uncles) AS u, sum(tx_count) AS t FROM timed GROUP BY day) SELECT day, CAST(u AS BIGINT) AS uncles, {cut_text('u', 't')} AS uncle_rate FROM s", "timed")
def A09_uncle_rate(spark, d):
    s = v.timed(spark, d).groupBy("day").agg(F.sum("uncles").alias("uncles"), F.sum("tx_count").alias("t"))
    return s.select("day", "uncles", exact.ratio_cut("uncles", "t").alias("uncle_rate"))


@query(f"""WITH t AS (SELECT * FROM timed, (SELECT max(epoch) AS last FROM timed) WHERE interval_ms IS NOT NULL AND epoch < last AND epoch >= last - 42), x AS (SELECT least(interval_ms // 600000, 100) AS bucket, count(*) AS n FROM t GROUP BY 1), w AS (SELECT sum(n) AS whole FROM x)
SELECT CAST(r.range AS BIGINT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n, {cut_text('coalesce(n, 0)', 'whole')} AS share FROM range(0, 101) r LEFT JOIN x ON r.range = x.bucket, w""", "timed")
def A10_interval_histogram(spark, d):
    """Intervals of the last 42 complete epochs; the last bucket counts all longer ones."""
    recent = ledger.last_groups(v.timed(spark, d), "epoch", 42)
    return ledger.interval_histogram(recent.where("interval_ms IS NOT NULL"), "interval_ms", 600_000, 60_000_000)


@query("SELECT CAST(least(interval_ms // 60000, 30) AS BIGINT) AS band, count(*) AS n FROM timed WHERE interval_ms IS NOT NULL GROUP BY 1", "timed")
def A11_interval_bands(spark, d):
    t = v.timed(spark, d).where("interval_ms IS NOT NULL")
    return t.groupBy(exact.interval_band(exact.int_div("interval_ms", 60_000)).cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT epoch, max(chain_ms) - min(chain_ms) AS ms FROM timed GROUP BY epoch) SELECT CAST((2 * ms + 60000) // 120000 AS BIGINT) AS minutes, count(*) AS epochs FROM e GROUP BY 1", "timed")
def A12_epoch_histogram(spark, d):
    e = A03_epoch_stats(spark, d)
    return e.groupBy(exact.half_up("duration_ms", F.lit(60_000)).alias("minutes")).agg(F.count(F.lit(1)).alias("epochs"))


@query("SELECT t.tx, max(b.number) AS as_of FROM txs t LEFT JOIN (SELECT min(number) AS number, day FROM timed GROUP BY day) b ON b.day <= t.day GROUP BY t.tx", "txs", "timed")
def J07_as_of(spark, d):
    firsts = v.timed(spark, d).groupBy("day").agg(F.min("number").alias("number")).select(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("at"), "number")
    t = v.txs(spark, d).select("tx", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("at"))
    return joins.as_of(t, firsts, "at", "at", "number", bucket_ms=30).select("tx", "as_of")


@query("SELECT day, min(number) AS first_block, max(number) AS last_block, count(*) AS blocks FROM timed GROUP BY day", "timed")
def J08_blocks_by_day(spark, d):
    return joins.blocks_by_day(v.timed(spark, d), "day", "number")


@query("SELECT number, ts_ms, lag(ts_ms) OVER (ORDER BY number) AS parent_ts_ms FROM blocks", "blocks")
def J09_with_parent(spark, d):
    return joins.with_parent(v.blocks(spark, d).select("number", "ts_ms"), "number", "ts_ms")


@query("""WITH p AS (SELECT party AS id, min(block) AS proposed FROM txs WHERE kind = 'signup' GROUP BY party), c AS (SELECT party AS id, block AS committed FROM txs WHERE kind = 'purchase')
SELECT p.id, proposed, min(committed) AS committed FROM p JOIN c USING (id) WHERE committed BETWEEN proposed + 2 AND proposed + 200 GROUP BY p.id, proposed""", "txs")
def J12_commitments(spark, d):
    t = v.txs(spark, d)
    p = t.where("kind = 'signup'").groupBy(F.col("party").alias("id")).agg(F.min("block").alias("proposed"))
    return joins.commitments(p, t.where("kind = 'purchase'").select(F.col("party").alias("id"), F.col("block").alias("committed")), "id", "proposed", "committed", 2, 200)


@query("""WITH p AS (SELECT DISTINCT party AS id, block AS proposed FROM txs WHERE kind = 'signup'), c AS (SELECT DISTINCT party AS id, block AS committed FROM txs WHERE kind = 'purchase')
SELECT id, committed, min(proposed) AS proposed FROM p JOIN c USING (id) WHERE committed BETWEEN proposed + 2 AND proposed + 10 GROUP BY id, committed""", "txs")
def J13_earliest_proposal(spark, d):
    t = v.txs(spark, d)
    p = t.where("kind = 'signup'").select(F.col("party").alias("id"), F.col("block").alias("proposed")).distinct()
    c = t.where("kind = 'purchase'").select(F.col("party").alias("id"), F.col("block").alias("committed")).distinct()
    return joins.earliest_proposal(p, c, "id", "proposed", "committed", 2, 10)


@query("""WITH tip AS (SELECT max(block) AS tip FROM txs), p AS (SELECT party AS id, block AS proposed FROM txs WHERE kind = 'signup' AND block + 10 > (SELECT tip FROM tip)),
b AS (SELECT id, max(proposed) FILTER (WHERE proposed + 2 <= tip + 1) AS r, max(proposed) FILTER (WHERE proposed + 2 > tip + 1) AS g FROM p, tip GROUP BY id)
SELECT c_custkey AS id, CASE WHEN r IS NOT NULL THEN 'proposed' WHEN g IS NOT NULL THEN 'gap' ELSE 'pending' END AS stage, coalesce(r, g) AS proposed FROM customer LEFT JOIN b ON c_custkey = id""", "txs")
def J14_pool_stage(spark, d):
    t = v.txs(spark, d)
    tip = t.agg(F.max("block")).first()[0] or 0
    p = t.where("kind = 'signup'").select(F.col("party").alias("id"), F.col("block").alias("proposed"))
    return joins.pool_stage(v.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), p, tip, "id", "proposed", 2, 10)


RULES = [("first", 0), ("second", 7), ("third", 20), ("never", 10**9)]


@query("""WITH r(rule, at_epoch) AS (VALUES ('first', 0), ('second', 7), ('third', 20), ('never', 1000000000)) SELECT rule, CAST(at_epoch AS BIGINT) AS at_epoch, (SELECT min(number) FROM blocks WHERE epoch >= at_epoch) AS activation_block FROM r""", "blocks")
def J26_activation_blocks(spark, d):
    rules = spark.createDataFrame(RULES, "rule string, at_epoch long")
    epochs = v.blocks(spark, d).groupBy("epoch").agg(F.min("number").alias("first"))
    return joins.activation_blocks(rules, epochs, "rule", "at_epoch", "epoch", "first")


@query("""WITH n AS (SELECT number FROM blocks WHERE number = 50), b AS (SELECT block, tx FROM txs) SELECT CAST(tx AS BIGINT) AS node, 1 AS distance FROM b WHERE block = 50
UNION ALL SELECT -50, 0""", "blocks", "txs")
def J22_tx_graph(spark, d):
    edges = v.txs(spark, d).select((-F.col("block")).alias("block"), "tx")
    seeds = v.blocks(spark, d).where("number = 50").select((-F.col("number")).alias("node"))
    return joins.neighbourhood(edges, seeds, "block", "tx", 2).where("distance < 2")


@query("SELECT block, CAST(sum(CASE WHEN kind = 'error' THEN 0 ELSE moved END) AS BIGINT) AS moved FROM txs GROUP BY block", "txs")
def A19_value_moved(spark, d):
    deltas = v.txs(spark, d).withColumn("delta", F.when(F.col("kind") == "error", -F.col("moved")).otherwise(F.col("moved")))
    return ledger.value_moved(deltas, "block", "delta")


@query("WITH x AS (SELECT 'day' AS grain, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS bucket, * FROM txs UNION ALL SELECT 'hour', hour, * FROM txs) SELECT grain, bucket, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS \"{k}\"" for k in KINDS)
+ ", count(*) FILTER (WHERE tx_index = 0) AS cellbase, CAST(sum(moved) AS BIGINT) AS moved, count(DISTINCT json_extract_string(props, '$.k')) AS scripts, count(DISTINCT (block, party, kind)) AS actions FROM x GROUP BY grain, bucket", "txs")
def A20_activity_stats(spark, d):
    """Kinds, cellbases, value, scripts and distinct actions per day and per hour: what is distinct by hour comes first, days are made of that."""
    t = v.txs(spark, d).select("day", "hour", "kind", "tx_index", "moved", "block", "party", F.get_json_object("props", "$.k").alias("script"))
    kinds = {k: F.count_if(F.col("kind") == k) for k in KINDS}
    sums = ledger.totals(t, ["day", "hour"], **kinds, cellbase=F.count_if(F.col("tx_index") == 0), moved=F.sum("moved"))
    facts = []
    for grain, at in (("hour", F.col("hour")), ("day", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint"))):
        place = [F.lit(grain).alias("grain"), at.alias("bucket")]
        facts.append(sums.select(*place, *KINDS, "cellbase", "moved"))
        for name, columns in (("scripts", ["script"]), ("actions", ["block", "party", "kind"])):
            by_hour = t.where(F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0).select("day", "hour", *columns).distinct()
            facts.append(by_hour.select(*place, *columns).distinct().groupBy("grain", "bucket").agg(F.count(F.lit(1)).alias(name)))
    return ledger.sum_facts(facts, ["grain", "bucket"])


@query("SELECT day, count(DISTINCT party) AS parties FROM txs GROUP BY day", "txs")
def A21_active_addresses(spark, d):
    return ledger.active_parties(v.txs(spark, d), "day", "party")


@query("SELECT tx, CASE WHEN kind = 'error' THEN 'failed' WHEN moved >= 10000 AND kind = 'purchase' THEN 'large' WHEN kind IN ('click', 'view') THEN 'visit' ELSE 'other' END AS bucket FROM txs", "txs")
def P13_classify_bucket(spark, d):
    k, m = F.col("kind"), F.col("moved")
    return v.txs(spark, d).select("tx", ledger.first_kind(("failed", k == "error"), ("large", (m >= 10000) & (k == "purchase")), ("visit", k.isin("click", "view"))).alias("bucket"))


TAGGED = "SELECT block, party, CAST(bit_or((CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) | (CASE WHEN kind = 'signup' THEN 4 ELSE 0 END) | (CASE WHEN tx_index = 0 THEN 32 ELSE 0 END)) AS INTEGER) AS tags FROM txs GROUP BY block, party"


def tagged(spark, d):
    mask = ledger.party_tags(token=F.col("kind") == "purchase", identity=F.col("kind") == "signup", cellbase=F.col("tx_index") == 0)
    return v.txs(spark, d).groupBy("block", "party").agg(F.bit_or(mask).alias("tags"))


@query(TAGGED, "txs")
def P12_party_tags(spark, d):
    return tagged(spark, d)


@query(f"SELECT * FROM ({TAGGED}) WHERE tags & 4 <> 0", "txs")
def P14_match_activity(spark, d):
    return ledger.match_activity(tagged(spark, d), "tags", "", "identity")


@query("SELECT tx, CASE WHEN moved IS NOT NULL AND kind = 'purchase' THEN 'committed' WHEN block + 2 > 990 THEN 'early' WHEN block + 10 >= 990 THEN 'waiting' ELSE 'expired' END AS state FROM txs", "txs")
def P23_proposal_state(spark, d):
    return v.txs(spark, d).select("tx", ledger.proposal_state("block", F.when(F.col("kind") == "purchase", F.col("block")), 990, 2, 10).alias("state"))


@query("""WITH f AS (SELECT number, tx_count * 100 + uncles AS fee, number % 3 + 1 AS size FROM blocks) SELECT number, CAST(fee * 1000 // size AS BIGINT) AS rate FROM f""", "blocks")
def F06_fee_rate(spark, d):
    b = v.blocks(spark, d).select("number", (F.col("tx_count") * 100 + F.col("uncles")).alias("fee"), (F.col("number") % 3 + 1).alias("size"))
    return b.select("number", exact.fee_rate("fee", "size").alias("rate"))


FEES = "SELECT tx, block, moved + 1 AS fee, tx % 5 + 1 AS size, tx % 1000 + 500 AS cycles, ts_ms FROM txs"


def fees(spark, d):
    return v.txs(spark, d).select("tx", "block", (F.col("moved") + 1).alias("fee"), (F.col("tx") % 5 + 1).alias("size"), (F.col("tx") % 1000 + 500).alias("cycles"), "ts_ms")


@query(f"WITH f AS ({FEES}) SELECT block, count(*) AS txs, CAST(sum(size) AS BIGINT) AS size, arg_min(fee * 1000 // size, fee / size) FILTER (WHERE tx % 10 <> 0) AS least_rate, arg_max(fee * 1000 // size, fee / size) FILTER (WHERE tx % 10 <> 0) AS most_rate, CAST(sum(fee * 60 // size * 1000) FILTER (WHERE tx % 10 <> 0) // 60 // count(*) FILTER (WHERE tx % 10 <> 0) AS BIGINT) AS mean FROM f GROUP BY block", "txs")
def A37_block_fee_stats(spark, d):
    """Fee rates of a block's transactions but the cellbase, which has the first place."""
    s = ledger.block_fee_stats(fees(spark, d).withColumn("cellbase", F.col("tx") % 10 == 0), "block", "fee", "size", "cellbase")
    return s.select("block", "txs", "size", exact.fee_rate("least.fee", "least.size").alias("least_rate"), exact.fee_rate("most.fee", "most.size").alias("most_rate"), "mean")


@query(f"WITH f AS ({FEES}) SELECT block, CAST(sum(fee * 60 // size * 1000) // 60 // count(*) AS BIGINT) AS mean FROM f GROUP BY block", "txs")
def X05_rational_mean(spark, d):
    from ..functions.udf import rational_mean

    return rational_mean(fees(spark, d), "block", "fee", "size")


@query(f"WITH f AS ({FEES}) SELECT count(*) AS txs, CAST(sum(size) AS BIGINT) AS size, CAST(sum(cycles) AS BIGINT) AS cycles, min(fee * 1000 // size) AS least_rate, max(fee * 1000 // size) AS most_rate, min(ts_ms) AS oldest FROM f", "txs")
def A65_pool_summary(spark, d):
    return ledger.pool_summary(fees(spark, d), "size", "fee", "ts_ms", "cycles")


@query(f"WITH f AS ({FEES}) SELECT tx, fee, size FROM f", "txs")
def L09_pool_order(spark, d):
    return ranking.pool_order(fees(spark, d), "fee", "size", "ts_ms", "tx").select("tx", "fee", "size")


@query("SELECT tx, block, tx_index FROM txs WHERE (block, tx_index) < (800, 5) ORDER BY block DESC, tx_index DESC LIMIT 50", "txs")
def L01_keyset_page(spark, d):
    return ranking.page(v.txs(spark, d).select("tx", "block", "tx_index"), ["block", "tx_index"], 50, (800, 5))


@query("SELECT number, tx_count FROM blocks ORDER BY number DESC LIMIT 20", "blocks")
def L07_latest(spark, d):
    return ranking.page(v.blocks(spark, d).select("number", "tx_count"), ["number"], 20)


@query("SELECT number, ts_ms FROM blocks WHERE number % 25 = 0", "blocks")
def L12_stride_sample(spark, d):
    return ranking.stride_sample(v.blocks(spark, d).select("number", "ts_ms"), "number", 25)


@query("""WITH k AS (SELECT day, kind, count(*) AS n FROM txs GROUP BY day, kind), p AS (SELECT kind, max(n) AS peak FROM k GROUP BY kind) SELECT p.kind, peak, min(day) AS peak_day FROM p JOIN k ON p.kind = k.kind AND n = peak GROUP BY p.kind, peak""", "txs")
def L11_series_peak(spark, d):
    k = v.txs(spark, d).groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))
    return ranking.series_peak(k, "kind", "day", "n")


@query("SELECT number, list_sort(list(ts_ms) OVER (ORDER BY number ROWS BETWEEN 36 PRECEDING AND CURRENT ROW))[CAST(least(number, 36) + 1 AS BIGINT) // 2 + 1] AS median_ms FROM blocks", "blocks")
def W10_median_time(spark, d):
    return series.median_time(v.blocks(spark, d).select("number", "ts_ms"), "number", "ts_ms", 37).select("number", "median_ms")


@query("WITH s AS (SELECT day, count(*) AS n FROM txs GROUP BY day) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change_n FROM s", "txs")
def W02_daily_change(spark, d):
    return series.daily_change(v.txs(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")), [], "day", "n")


@query("""WITH tip AS (SELECT max(ts_ms) AS tip FROM txs) SELECT count(*) AS rows, count(DISTINCT party) AS parties FROM txs, tip WHERE ts_ms > tip - 24 * 3600000""", "txs")
def W08_rolling_window(spark, d):
    t = v.txs(spark, d)
    return streams.rolling_window(t, "ts_ms", t.agg(F.max("ts_ms")).first()[0] or 0, 24, "party")


@query("""WITH s AS (SELECT day, CAST(sum(uncles) AS BIGINT) AS u, CAST(sum(tx_count) AS BIGINT) AS t FROM timed GROUP BY day)
SELECT day, CAST(sum(u) OVER w AS BIGINT) AS uncles_7, CAST(sum(t) OVER w AS BIGINT) AS txs_7 FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "timed")
def W09_trailing_ratio(spark, d):
    s = v.timed(spark, d).groupBy("day").agg(F.sum("uncles").alias("u"), F.sum("tx_count").alias("t"))
    return series.zero_fill(s, [], "day", "u", "t").select("day", series.trailing_sum(s, [], "day", "u", 7).alias("uncles_7"), series.trailing_sum(s, [], "day", "t", 7).alias("txs_7"))


@query("""SELECT day, max(hour) AS hour, arg_max(n, hour) AS n FROM (SELECT day, hour, count(*) AS n FROM txs GROUP BY day, hour) GROUP BY day""", "txs")
def W16_peer_history(spark, d):
    return series.latest_of_day(v.txs(spark, d).groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n")), [], "day", "hour")


@query("SELECT 'tx' AS kind, tx AS id, ts_ms FROM txs WHERE kind = 'purchase' UNION ALL SELECT 'block', number, ts_ms FROM blocks", "txs", "blocks")
def U01_union_feed(spark, d):
    return sets.union_feed({"tx": v.txs(spark, d).where("kind = 'purchase'").select(F.col("tx").alias("id"), "ts_ms"), "block": v.blocks(spark, d).select(F.col("number").alias("id"), "ts_ms")})


@query("""WITH u AS (SELECT party, block, 0 AS source FROM txs WHERE kind = 'signup' UNION ALL SELECT party, block, 1 FROM txs WHERE kind = 'view') SELECT party, block, source FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY source, block) AS n FROM u) WHERE n = 1""", "txs")
def U02_proposal_zone(spark, d):
    t = v.txs(spark, d)
    return sets.first_wins([t.where("kind = 'signup'").select("party", "block"), t.where("kind = 'view'").select("party", "block")], ["party"], ["block"])


@query("SELECT DISTINCT c_custkey AS party, CASE WHEN c_custkey IN (SELECT party FROM txs WHERE kind = 'purchase') THEN 'on_chain' WHEN c_custkey IN (SELECT party FROM txs) THEN 'pool' ELSE 'none' END AS presence FROM customer", "txs")
def U04_presence(spark, d):
    t = v.txs(spark, d)
    wanted = v.read(spark, d, "customer").select(F.col("c_custkey").alias("party"))
    return sets.presence(wanted, "party", {"on_chain": t.where("kind = 'purchase'").select("party"), "pool": t.select("party")})


@query("""WITH a AS (SELECT DISTINCT block, party FROM txs WHERE kind = 'view'), b AS (SELECT DISTINCT block, party FROM txs WHERE kind = 'click')
SELECT block, party, CASE WHEN a.block IS NOT NULL AND b.block IS NOT NULL THEN 'kept' WHEN a.block IS NOT NULL THEN 'out' ELSE 'in' END AS flow FROM (SELECT *, 1 AS x FROM a) a FULL JOIN b USING (block, party)""".replace("a.block IS NOT NULL AND b.block IS NOT NULL", "(block, party) IN (SELECT block, party FROM a) AND (block, party) IN (SELECT block, party FROM b)").replace("WHEN a.block IS NOT NULL THEN 'out'", "WHEN (block, party) IN (SELECT block, party FROM a) THEN 'out'"), "txs")
def U06_item_flow(spark, d):
    t = v.txs(spark, d)
    return sets.item_flow(t.where("kind = 'view'"), t.where("kind = 'click'"), ["block", "party"])


@query("SELECT tx, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM txs", "txs")
def F16_json_field(spark, d):
    return v.txs(spark, d).select("tx", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT tx, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT tx, moved * 7 AS s FROM txs)", "txs")
def F14_format_duration(spark, d):
    return v.txs(spark, d).select("tx", exact.format_duration(F.col("moved") * 7).alias("text"))


@query("SELECT tx, CAST(moved * 1000 // 300 // 1000 AS BIGINT) AS whole, CAST(moved AS BIGINT) AS moved, CAST((2 * moved + 7) // 14 AS BIGINT) AS rounded FROM txs", "txs")
def F05_ratios(spark, d):
    return v.txs(spark, d).select("tx", exact.int_div("moved", 300).alias("whole"), "moved", exact.half_up("moved", F.lit(7)).alias("rounded"))


@query("SELECT number, CAST(difficulty // 36 + CASE WHEN number % 36 < difficulty % 36 THEN 1 ELSE 0 END AS BIGINT) AS reward FROM blocks", "blocks")
def F08_block_issuance(spark, d):
    return v.blocks(spark, d).select("number", exact.block_issuance(F.col("number") % 36, F.lit(36).cast("bigint"), "difficulty").alias("reward"))


@query("""WITH e AS (SELECT number, epoch, number % 36 AS i FROM blocks) SELECT number, CAST(epoch + ((greatest(20000 - epoch - CASE WHEN 18 >= i THEN 0 ELSE 1 END, 0)) // 180 + 1) * 180 AS BIGINT) AS boundary FROM e""", "blocks")
def F09_next_boundary(spark, d):
    b = v.blocks(spark, d)
    start = (F.col("epoch"), F.col("number") % 36, F.lit(36))
    return b.select("number", exact.next_boundary(start, (F.lit(20_000).cast("bigint"), F.lit(18), F.lit(36))).cast("bigint").alias("boundary"))


@query("""WITH f AS (SELECT block, party, bool_or(kind = 'view') AS iv, bool_or(kind = 'click') AS oc, bool_or(kind = 'signup') AS os, bool_or(kind = 'purchase') AS ip FROM txs GROUP BY block, party)
SELECT block, party, CASE WHEN iv AND os THEN 'force_close' WHEN iv THEN 'close' WHEN oc THEN 'open' WHEN ip AND os THEN 'revoke' WHEN ip THEN 'settle' END AS action FROM f WHERE iv OR oc OR ip""", "txs")
def F20_classify_channel(spark, d):
    k = F.col("kind")
    t = v.txs(spark, d).withColumns({"id": F.concat_ws("/", "block", "party"), "side": F.when(k.isin("view", "purchase"), "input").otherwise("output")})
    found = protocol.classify_channel(t, "id", "side", k.isin("view", "click"), k.isin("signup", "purchase"))
    parts = F.split("id", "/")
    return found.select(parts[0].cast("bigint").alias("block"), parts[1].cast("bigint").alias("party"), "action")


@query("SELECT block, party, kind FROM txs WHERE kind = 'error' UNION ALL SELECT DISTINCT block, party, kind FROM txs WHERE kind <> 'error'", "txs")
def F26_dedup_actions(spark, d):
    return protocol.dedup_actions(v.txs(spark, d).select("block", "party", "kind"), ["block", "party", "kind"], F.col("kind") == "error")


@query("""SELECT 'contiguous' AS "check", CAST(number AS VARCHAR) AS key, CAST(number - 1 AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM blocks b WHERE number % 10 <> 3 AND number > 0 AND (number - 1) % 10 = 3""", "blocks")
def Q02_contiguous(spark, d):
    return quality.contiguous(v.blocks(spark, d).where("number % 10 <> 3"), "number")


@query(EMPTY.format("events"))
def Q04_kinds_make_days(spark, d):
    kinds = A20_activity_stats(spark, d).where("grain = 'day'").select("bucket", sum((F.col(k) for k in KINDS), F.lit(0)).alias("n"))
    days = v.txs(spark, d).groupBy(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return quality.equal_by_key("kinds", kinds, days, ["bucket"], ["n"])


@query("""WITH b AS (SELECT tx, CASE WHEN kind = 'error' THEN 'failed' WHEN moved >= 10000 AND kind = 'purchase' THEN 'large' WHEN kind IN ('click', 'view') THEN 'visit' ELSE 'other' END AS bucket FROM txs) SELECT 'bucket' AS "check", CAST(tx AS VARCHAR) AS key, '{"bucket":"' || bucket || '"}' AS expected, '{"bucket":"failed"}' AS actual FROM b WHERE tx % 500 = 3 AND bucket <> 'failed'""", "txs")
def Q05_bucket_index(spark, d):
    """An index by bucket, filled by one filter a bucket and with some rows filed wrongly, against the activity's own classification."""
    t = v.txs(spark, d)
    astray = F.col("tx") % 500 == 3
    rules = {"failed": "kind = 'error'", "large": "kind = 'purchase' AND moved >= 10000", "visit": "kind IN ('click', 'view')", "other": "kind = 'signup' OR (kind = 'purchase' AND moved < 10000)"}
    index = sets.union_feed({b: t.where(rule).select("tx") for b, rule in rules.items()}).select("tx", F.when(astray, "failed").otherwise(F.col("kind")).alias("bucket"))
    return quality.equal_by_key("bucket", P13_classify_bucket(spark, d), index, ["tx"], ["bucket"])


@query("""WITH days AS (SELECT DISTINCT day FROM timed) SELECT 'missing_days' AS "check", CAST(day AS VARCHAR) AS key, 'a row' AS expected, CAST(NULL AS VARCHAR) AS actual FROM days WHERE day(day) % 5 = 0""", "timed")
def Q08_missing_days(spark, d):
    t = v.timed(spark, d)
    return quality.missing_days(t.where(F.dayofmonth("day") % 5 != 0).select("day").distinct(), t, "day")


@query("""WITH f AS (SELECT number, 'h' || number AS hash FROM blocks), tip AS (SELECT max(number) AS tip FROM blocks), x AS (SELECT number, CASE WHEN number > tip - 5 THEN 'x' || number ELSE 'h' || number END AS hash FROM blocks, tip WHERE number > tip - 36)
SELECT max(f.number) FILTER (WHERE f.hash = x.hash) AS fork, min(f.number) FILTER (WHERE f.hash <> x.hash) AS first_orphan FROM f JOIN x USING (number)""", "blocks")
def T07_detect_switch(spark, d):
    b = v.blocks(spark, d)
    tip = b.agg(F.max("number")).first()[0] or 0
    stored = b.select("number", F.concat(F.lit("h"), "number").alias("hash"))
    new = b.select("number", F.concat(F.when(F.col("number") > tip - 5, "x").otherwise("h"), "number").alias("hash"))
    return streams.detect_switch(new, stored)


DELTAS = streams.IncrementalAgg("party_totals", lambda t: t.select("party", "block", F.col("moved").alias("moved"), F.lit(1).cast("bigint").alias("n")), ["party"], ["moved", "n"])


@query("SELECT party, CAST(sum(moved) AS BIGINT) AS moved, count(*) AS n FROM txs GROUP BY party", "txs")
def T11_incremental(spark, d):
    """Rebuilt in two parts, the second taken back to a fork and applied again."""
    t = v.txs(spark, d)
    tip = t.agg(F.max("block")).first()[0] or 0
    state = DELTAS.apply(DELTAS.rebuild(t.where(F.col("block") <= tip - 20)), t.where(F.col("block") > tip - 20))
    state = DELTAS.apply(DELTAS.roll_back(state, tip - 8), t.where(F.col("block") > tip - 8))
    return DELTAS.current(state)


@query("SELECT tx, block, party, CAST(moved + CASE WHEN block > tip - 8 THEN 1 ELSE 0 END AS BIGINT) AS moved FROM txs, (SELECT max(block) AS tip FROM txs)", "txs")
def T08_rollback(spark, d):
    """A stream that has derived rows up to the tip takes back its last eight blocks and applies another branch of them."""
    t = v.txs(spark, d).select("tx", "block", "party", "moved")
    tip = t.agg(F.max("block")).first()[0] or 0
    branch = t.where(F.col("block") > tip - 8).withColumn("moved", F.col("moved") + 1)
    folder = streams.run_parts([t.where(F.col("block") <= tip - 20), t.where(F.col("block") > tip - 20), branch], lambda df: {"rows": df}, io.work_folder(spark), "block")
    return streams.read_committed(spark, folder, "rows", "block")


@query("""WITH p AS (SELECT DISTINCT party, block FROM txs WHERE kind = 'signup'), tip AS (SELECT max(block) AS tip FROM txs) SELECT party, block FROM p, tip WHERE block + 100 >= tip AND party NOT IN (SELECT party FROM txs WHERE kind = 'purchase' AND block > (SELECT tip FROM tip) - 3)""", "txs")
def T13_pending_proposals(spark, d):
    """Proposals and commitments kept by a stream in two batches; what is neither committed nor out of its window at the tip."""
    t = v.txs(spark, d).select("block", "party", "kind")
    tip = t.agg(F.max("block")).first()[0] or 0
    derive = lambda df: {"proposals": df.where("kind = 'signup'").select("party", "block").distinct(), "commitments": df.where("kind = 'purchase'").select("party", "block").distinct()}
    folder = streams.run_parts([t.where(F.col("block") <= tip // 2), t.where(F.col("block") > tip // 2)], derive, io.work_folder(spark), "block")
    kept = lambda name: streams.read_committed(spark, folder, name, "block")
    return streams.pending_proposals(kept("proposals"), kept("commitments").where(F.col("block") > tip - 3).select("party").distinct(), tip, "party", "block", 100)


@query("""WITH tip AS (SELECT max(block) AS tip FROM txs), p AS (SELECT DISTINCT party, block FROM txs WHERE kind = 'signup'), c AS (SELECT DISTINCT party, block AS done FROM txs WHERE kind = 'purchase'),
f AS (SELECT p.party, p.block, min(done) AS done FROM p LEFT JOIN c ON p.party = c.party AND done BETWEEN p.block + 2 AND p.block + 10 GROUP BY 1, 2)
SELECT party, block AS proposed, 'proposed' AS fate, block FROM p UNION ALL SELECT party, block, 'committed', done FROM f WHERE done IS NOT NULL UNION ALL SELECT party, block, 'expired', block + 10 FROM f, tip WHERE done IS NULL AND block + 11 < tip""", "txs")
def T13_proposal_fates(spark, d):
    """Every proposal with its commitment or expiry, told by a stream in three batches whose timers close the windows."""
    t = v.txs(spark, d).where("kind IN ('signup', 'purchase')").select("party", "block", (F.col("kind") == "purchase").alias("done"))
    # the last block of all, of no party, lets the watermark reach the tip whatever happened in it
    last = v.txs(spark, d).agg(F.max("block").alias("block")).where("block IS NOT NULL").select(F.lit(None).cast("bigint").alias("party"), "block", F.lit(True).alias("done"))
    rows, at = t.union(last), F.col("block")
    tip = last.first()[1] if not last.isEmpty() else 0
    folder, schema = io.work_folder(spark), "party long, proposed long, fate string, block long"

    def start(source, out, checkpoint):
        fates = streams.proposal_fates(source, "party", "block", "done", 2, 10)
        return fates.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")

    streams.feed([rows.where(at <= tip // 3), rows.where((at > tip // 3) & (at <= tip // 2)), rows.where(at > tip // 2)], folder, start)
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("""WITH tip AS (SELECT max(block) AS tip FROM txs), b AS (SELECT block, party, moved + CASE WHEN block > tip - 8 THEN 1 ELSE 0 END AS moved, CASE WHEN block > tip - 8 THEN day + 1 ELSE day END AS day FROM txs, tip)
SELECT day, count(*) AS n, count(DISTINCT party) AS parties, CAST(sum(moved) AS BIGINT) AS moved FROM b GROUP BY day""", "txs")
def T08_rolled_back_days(spark, d):
    """Daily figures kept by a stream that takes back its last eight blocks for a branch whose blocks are a day later: only the days touched are written again."""
    t = v.txs(spark, d).select("tx", "block", "party", "moved", "day")
    tip, at = t.agg(F.max("block")).first()[0] or 0, F.col("block")
    branch = t.where(at > tip - 8).withColumns({"moved": F.col("moved") + 1, "day": F.date_add("day", 1)})
    daily = lambda rows: rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("party").alias("parties"), F.sum("moved").alias("moved"))
    folder = streams.feed([t.where(at <= tip // 2), t.where(at > tip // 2), branch], io.work_folder(spark), lambda source, out, checkpoint: streams.stream_days(source, daily, out, checkpoint, "block", "day"))
    return streams.read_days(spark, folder, "day date, n long, parties long, moved long")


@query("""WITH m AS (SELECT max(block) AS tip FROM txs), a AS (SELECT DISTINCT party FROM txs, m WHERE block < tip * 3 // 10), b AS (SELECT DISTINCT party FROM txs, m WHERE block >= tip * 6 // 10 AND kind = 'view'), c AS (SELECT DISTINCT party FROM txs, m WHERE kind = 'purchase' AND block >= tip * 9 // 10)
SELECT party, CASE WHEN party NOT IN (SELECT party FROM a) THEN 'arrived' WHEN party IN (SELECT party FROM b) THEN 'stayed' WHEN party IN (SELECT party FROM c) THEN 'committed' ELSE 'rejected' END AS change FROM (SELECT party FROM a UNION SELECT party FROM b)""", "txs")
def T15_pool_diff(spark, d):
    t = v.txs(spark, d)
    tip = t.agg(F.max("block")).first()[0] or 0
    return streams.pool_diff(t.where(F.col("block") < tip * 3 // 10), t.where((F.col("block") >= tip * 6 // 10) & (F.col("kind") == "view")), t.where((F.col("kind") == "purchase") & (F.col("block") >= tip * 9 // 10)), "party")


@query("SELECT tx, hour FROM txs WHERE (hour + 1) * 3600000 <= (SELECT max(ts_ms) FROM txs) - 86400000", "txs")
def T03_late_rows(spark, d):
    t = v.txs(spark, d)
    tip = t.agg(F.max("ts_ms").alias("tip"))
    return streams.late_rows(t.join(F.broadcast(tip)), (F.col("hour") + 1) * 3_600_000, F.col("tip") - 86_400_000).select("tx", "hour")


@query("""WITH x AS (SELECT 'day' AS grain, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS bucket, (date_diff('day', DATE '1970-01-01', day) + 1) * 86400000 - 28800000 AS bucket_end, number, tx_count FROM timed UNION ALL SELECT 'hour', hour, (hour + 1) * 3600000, number, tx_count FROM timed)
SELECT grain, bucket, max(number) AS tip, CAST(sum(tx_count) AS BIGINT) AS txs, max(bucket_end) <= (SELECT max(chain_ms) FROM timed) AS complete FROM x GROUP BY grain, bucket""", "timed")
def A71_network_headline(spark, d):
    """Transactions and highest block per day and per hour, and whether the bucket is over."""
    t = v.timed(spark, d)
    now = t.agg(F.max("chain_ms").alias("_now"))
    one = lambda grain, bucket, end: F.struct(F.lit(grain).alias("grain"), bucket.cast("bigint").alias("bucket"), end.cast("bigint").alias("bucket_end"))
    grains = F.array(one("day", F.datediff("day", F.lit("1970-01-01").cast("date")), day_end_ms("day")), one("hour", F.col("hour"), (F.col("hour") + 1) * 3_600_000))
    x = ledger.totals(t.select(F.inline(grains), "number", "tx_count"), ["grain", "bucket", "bucket_end"], tip=F.max("number"), txs=F.sum("tx_count"))
    return x.join(F.broadcast(now)).select("grain", "bucket", "tip", "txs", (F.col("bucket_end") <= F.col("_now")).alias("complete"))


@query("SELECT day, CAST(sum(uncles) AS BIGINT) AS uncles, count(*) AS blocks, count(*) FILTER (WHERE ts_ms < chain_ms) AS switches FROM timed WHERE day > (SELECT max(day) FROM timed) - 15 GROUP BY day", "timed")
def A58_fork_days(spark, d):
    t = v.timed(spark, d)
    last = t.agg(F.max("day").alias("_last"))
    return t.join(F.broadcast(last)).where(F.col("day") > F.date_sub("_last", 15)).groupBy("day").agg(F.sum("uncles").alias("uncles"), F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("ts_ms") < F.col("chain_ms")).alias("switches"))


@query("SELECT miner, min(number) AS first, max(number) AS latest, count(*) AS n FROM blocks GROUP BY miner", "blocks")
def A63_advertisement_facts(spark, d):
    return ledger.facts(v.blocks(spark, d), ["miner"], "number")


@query("SELECT kind, party % 10 AS action, count(*) AS n FROM txs GROUP BY kind, party % 10", "txs")
def A66_action_counts(spark, d):
    return v.txs(spark, d).groupBy("kind", (F.col("party") % 10).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT party, min(block) AS first_seen, max(block) AS last_seen, arg_max(kind, tx) AS state, count(*) AS events FROM txs GROUP BY party", "txs")
def J20_channel_lifecycle(spark, d):
    c = joins.channel_lifecycle(v.txs(spark, d), "party", ["block", "tx"], "kind")
    return c.select("party", F.col("opened.block").alias("first_seen"), F.col("last.block").alias("last_seen"), "state", "events")

