"""Queries over cells, tokens, savings, scripts, names and peers."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact
from ..operators import joins, ledger, protocol, quality, ranking, series, sets
from ..sources import io
from . import views as v
from .chain import cut_text
from .views import query


@query("SELECT outpoint, party, capacity, consumed_day, consumed_day IS NULL AS live FROM cells", "cells")
def J01_cell_state(spark, d):
    return joins.cell_state(v.outputs(spark, d), v.inputs(spark, d), ["outpoint"], "consumed_day").select("outpoint", "party", "capacity", "consumed_day", "live")


@query("SELECT * FROM outputs WHERE outpoint NOT IN (SELECT outpoint FROM inputs)", "outputs", "inputs")
def J02_live_set(spark, d):
    return joins.live_set(v.outputs(spark, d), v.inputs(spark, d), ["outpoint"])


@query("SELECT outpoint, consumed_day, party, capacity FROM inputs JOIN outputs USING (outpoint)", "outputs", "inputs")
def J03_resolve_inputs(spark, d):
    return joins.resolve_inputs(v.inputs(spark, d), v.outputs(spark, d), ["outpoint"]).select("outpoint", "consumed_day", "party", "capacity")


@query("SELECT outpoint, capacity, consumed_day, c_name AS owner FROM outputs JOIN inputs USING (outpoint) JOIN customer ON party = c_custkey", "outputs", "inputs")
def J04_consumed_cells(spark, d):
    owners = v.read(spark, d, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("owner"))
    return joins.consumed_cells(v.outputs(spark, d), v.inputs(spark, d), owners, ["outpoint"], "party").select("outpoint", "capacity", "consumed_day", "owner")


@query("SELECT tx, line, amount, o_orderstatus AS status FROM legs LEFT JOIN orders ON tx = o_orderkey", "legs")
def J05_attach_tx(spark, d):
    orders = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_orderstatus").alias("status"))
    return joins.attach(v.legs(spark, d).select("tx", "line", "amount"), orders, ["tx"])


@query("SELECT * FROM outputs WHERE party IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", "outputs")
def J06_lookup(spark, d):
    wanted = v.read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("party"))
    return joins.lookup(v.outputs(spark, d), wanted, ["party"])


@query("SELECT outpoint, capacity, type FROM cells WHERE type = '1-URGENT' AND party % 7 = 3", "cells")
def P07_by_script(spark, d):
    c = v.cells(spark, d).withColumns({"lock_code_hash": F.col("type"), "lock_hash_type": F.col("party") % 7})
    return ledger.by_script(c, "1-URGENT", 3).select("outpoint", "capacity", "type")


@query("SELECT outpoint, party, capacity FROM cells WHERE consumed_day IS NULL AND type = '5-LOW'", "cells")
def P08_live_cells(spark, d):
    return ledger.live_cells(v.cells(spark, d), "consumed_day", type="5-LOW").select("outpoint", "party", "capacity")


def state_steps(df, start, end):
    """+1 for the party on the day a row starts, -1 on the day it ends."""
    step = lambda day, n: F.struct(F.col(day).alias("day"), F.lit(n).cast("bigint").alias("n"))
    return df.select("party", F.inline(F.array(step(start, 1), step(end, -1)))).where(F.col("day").isNotNull())


def cell_steps(spark, d):
    return state_steps(v.cells(spark, d), "created_day", "consumed_day")


#: What may happen to an item.
ITEM_ACTIONS = ("mint", "transfer", "burn", "renew", "update", "recycle")
CLASS = "CASE WHEN type = '1-URGENT' THEN 'savings' WHEN type <> '4-NOT SPECIFIED' THEN 'typed' ELSE 'plain' END"


def classed(spark, d):
    type_ = F.when(F.col("type") != "4-NOT SPECIFIED", F.col("type"))
    return v.cells(spark, d).withColumn("class", ledger.cell_class(F.col("type") == "1-URGENT", type_))


@query(f"SELECT outpoint, {CLASS} AS class FROM cells", "cells")
def P10_cell_class(spark, d):
    return classed(spark, d).select("outpoint", "class")


@query("""WITH r(type, kind) AS (VALUES ('1-URGENT', 'token'), ('2-HIGH', 'object'), ('3-MEDIUM', 'identity')) SELECT outpoint, coalesce(kind, 'other') AS holding FROM cells LEFT JOIN r USING (type)""", "cells")
def P11_holding_class(spark, d):
    registry = spark.createDataFrame([("1-URGENT", "token"), ("2-HIGH", "object"), ("3-MEDIUM", "identity")], "type string, kind string")
    return ledger.holding_class(v.cells(spark, d), registry, "type").select("outpoint", "holding")


@query("SELECT tx, count(DISTINCT token) AS types, min(token) AS first FROM legs WHERE token < 30 GROUP BY tx", "legs")
def P15_recognized_types(spark, d):
    known = v.legs(spark, d).select("token").distinct().where("token < 30")
    return ledger.recognized_types(v.legs(spark, d), known, "tx", "token").select("tx", F.size("types").cast("bigint").alias("types"), F.col("types")[0].alias("first"))


@query("SELECT DISTINCT tx, token FROM legs WHERE token >= 30", "legs")
def P16_script_calls(spark, d):
    known = v.legs(spark, d).select("token").distinct().where("token < 30")
    return ledger.script_calls(v.legs(spark, d), known, "tx", "token")


@query("""WITH c AS (SELECT collection, count(*) FILTER (WHERE kind = 'ECONOMY') AS a, count(*) FILTER (WHERE kind = 'SMALL') AS b, count(*) FILTER (WHERE size > 45) AS c FROM items GROUP BY collection) SELECT collection, CASE WHEN c > 0 THEN 'server' WHEN b > 0 THEN 'permanent' WHEN a > 0 THEN 'chain' ELSE 'empty' END AS tier FROM c""", "items")
def P17_composition_tier(spark, d):
    c = v.items(spark, d).groupBy("collection").agg(F.count_if(F.col("kind") == "ECONOMY").alias("a"), F.count_if(F.col("kind") == "SMALL").alias("b"), F.count_if(F.col("size") > 45).alias("c"))
    return c.select("collection", ledger.composition_tier({"chain": "a", "permanent": "b", "server": "c"}).alias("tier"))


@query("SELECT outpoint, CASE WHEN consumed_day IS NOT NULL THEN 'recycled' WHEN capacity > 20000000 THEN 'active' WHEN capacity + 5000000 > 20000000 THEN 'grace' ELSE 'free' END AS state FROM cells", "cells")
def P18_expiry_state(spark, d):
    return v.cells(spark, d).select("outpoint", ledger.expiry_state(F.col("consumed_day").isNull(), "capacity", 5_000_000, 20_000_000).alias("state"))


@query("SELECT item, name FROM items WHERE lower(name) LIKE '%ring%' OR lower(collection) LIKE '%ring%'", "items")
def P20_name_match(spark, d):
    return ledger.name_match(v.items(spark, d), "RING", "name", "collection").select("item", "name")


TRAITS = "SELECT item, 'kind' AS name, kind AS value FROM items UNION ALL SELECT item, 'size', CAST(size AS VARCHAR) FROM items"


def traits(spark, d):
    pairs = F.array(F.struct(F.lit("kind").alias("name"), F.col("kind").alias("value")), F.struct(F.lit("size").alias("name"), F.col("size").cast("string").alias("value")))
    return v.items(spark, d).select("item", F.inline(pairs))


@query("SELECT item FROM items WHERE kind = 'ECONOMY' AND size = 11", "items")
def P21_has_traits(spark, d):
    return ledger.has_traits(traits(spark, d), "item", {"kind": "ECONOMY", "size": "11"})


@query("""SELECT 'item' AS kind, outpoint AS id FROM (SELECT outpoint FROM outputs WHERE party = 77 ORDER BY outpoint DESC LIMIT 10) UNION ALL SELECT 'child', item FROM items WHERE collection = 'Brand#13' UNION ALL SELECT 'channel', tx FROM legs GROUP BY tx HAVING bool_or(party = 7)""", "outputs", "items", "legs")
def P24_items_of(spark, d):
    """The newest items of an owner, the children of a parent name, and the channels that a party is in."""
    page = ranking.page(ledger.items_of(v.outputs(spark, d), "party", 77).select("outpoint"), ["outpoint"], 10)
    parts = {"item": page.select(F.col("outpoint").alias("id")), "child": ledger.items_of(v.items(spark, d), "collection", "Brand#13").select(F.col("item").alias("id")), "channel": ledger.groups_of(v.legs(spark, d), "tx", "party", 7).select(F.col("tx").alias("id"))}
    return sets.union_feed(parts)


@query("SELECT node, country, CASE WHEN 100 - node % 100 > 60 THEN 'stale' WHEN reachable THEN 'online' ELSE 'unreachable' END AS state FROM peers WHERE version = 'MACHINERY'", "peers")
def P25_peer_filter(spark, d):
    return v.peers(spark, d).where("version = 'MACHINERY'").select("node", "country", ledger.peer_state(F.col("reachable"), F.col("node") % 100, F.lit(100), 60).alias("state"))


@query("WITH n AS (SELECT party, count(*) AS txs FROM txs GROUP BY party) SELECT party, CAST(sum(capacity) FILTER (WHERE consumed_day IS NULL) AS BIGINT) AS balance, CAST(sum(occupied) FILTER (WHERE consumed_day IS NULL) AS BIGINT) AS occupied, count(*) FILTER (WHERE consumed_day IS NULL) AS live_cells, count(*) AS total_cells, CAST(coalesce(max(txs), 0) AS BIGINT) AS txs, min(created_day) AS first_seen FROM cells LEFT JOIN n USING (party) GROUP BY party", "cells", "txs")
def A13_address_balance(spark, d):
    live = F.col("consumed_day").isNull()
    alive = lambda c: F.sum(F.when(live, F.col(c)))
    held = ledger.totals(v.cells(spark, d), ["party"], balance=alive("capacity"), occupied=alive("occupied"), live_cells=F.count_if(live), total_cells=F.count(F.lit(1)), first_seen=F.min("created_day"))
    return joins.attach(held, ledger.totals(v.txs(spark, d), ["party"], txs=F.count(F.lit(1))), ["party"]).withColumn("txs", F.coalesce("txs", F.lit(0)))


@query("""WITH e AS (SELECT party, created_day AS day, 1 AS n FROM cells UNION ALL SELECT party, consumed_day, -1 FROM cells WHERE consumed_day IS NOT NULL), s AS (SELECT party, day, sum(n) AS n FROM e GROUP BY party, day), r AS (SELECT party, day, n, sum(n) OVER (PARTITION BY party ORDER BY day) AS now FROM s) SELECT day AS created_day, count(*) AS "new" FROM r WHERE now > 0 AND now - n <= 0 GROUP BY day""", "cells")
def A14_new_addresses(spark, d):
    return series.become_positive(cell_steps(spark, d), "party", "day", "n").withColumnRenamed("day", "created_day")


@query(f"SELECT {CLASS} AS class, count(*) AS cells, CAST(sum(capacity) AS BIGINT) AS capacity, count(*) FILTER (WHERE data_size > 0) AS with_data FROM cells WHERE consumed_day IS NULL GROUP BY 1", "cells")
def A15_live_cell_summary(spark, d):
    return ledger.totals(classed(spark, d).where("consumed_day IS NULL"), ["class"], cells=F.count(F.lit(1)), capacity=F.sum("capacity"), with_data=F.count_if(F.col("data_size") > 0))


@query(f"""WITH t AS (SELECT party, {CLASS} AS class, type, count(*) AS n FROM cells WHERE consumed_day IS NULL GROUP BY 1, 2, 3), l AS (SELECT party, class, string_agg(type || '=' || n, ',' ORDER BY type) AS collections FROM t GROUP BY party, class)
SELECT party, class, count(*) AS cells, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(occupied) AS BIGINT) AS occupied, count(DISTINCT type) AS types, count(DISTINCT data_size) AS items, max(collections) AS collections FROM (SELECT *, {CLASS} AS class FROM cells WHERE consumed_day IS NULL) JOIN l USING (party, class) GROUP BY party, class""", "cells")
def A16_holdings(spark, d):
    live = classed(spark, d).where("consumed_day IS NULL")
    each = live.groupBy("party", "class", "type").agg(F.count(F.lit(1)).alias("n"))
    listed = each.groupBy("party", "class").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("l"))  # one entry a collection
    listed = listed.select("party", "class", F.array_join(F.transform("l", lambda x: F.concat(x.type, F.lit("="), x.n)), ",").alias("collections"))
    sums = ledger.totals(live, ["party", "class"], cells=F.count(F.lit(1)), capacity=F.sum("capacity"), occupied=F.sum("occupied"), types=F.count_distinct("type"), items=F.count_distinct("data_size"))
    return sums.join(listed, ["party", "class"])


SIGNED = "CAST(sum(CASE WHEN side = 'input' THEN -amount ELSE amount END) AS BIGINT)"


@query(f"SELECT tx, party, {SIGNED} AS delta, {SIGNED.replace('amount', 'occupied')} AS occupied_delta FROM legs GROUP BY tx, party", "legs")
def A17_party_deltas(spark, d):
    return ledger.signed_deltas(v.legs(spark, d), ["tx", "party"], "side", "amount", occupied_delta="occupied")


@query(f"SELECT tx, party, token, {SIGNED} AS delta FROM legs GROUP BY tx, party, token HAVING {SIGNED} <> 0", "legs")
def A18_item_deltas(spark, d):
    return ledger.signed_deltas(v.legs(spark, d), ["tx", "party", "token"], "side", "amount").where("delta <> 0")


@query(f"WITH h AS (SELECT token, party, {SIGNED} AS held, count(*) AS cells FROM legs GROUP BY token, party) SELECT token, CAST(sum(held) AS BIGINT) AS supply, count(*) FILTER (WHERE held > 0) AS holders, CAST(sum(cells) AS BIGINT) AS cells FROM h GROUP BY token", "legs")
def A22_token_summary(spark, d):
    signed = v.legs(spark, d).withColumn("signed", F.when(F.col("side") == "input", -F.col("amount")).otherwise(F.col("amount")))
    return ledger.token_summary(signed, "token", "party", "signed")


@query(f"SELECT token, day, CAST(sum(amount) FILTER (WHERE side = 'output') AS BIGINT) AS minted, CAST(sum(amount) FILTER (WHERE side = 'input') AS BIGINT) AS burnt, count(*) FILTER (WHERE side = 'output') AS mints, count(*) FILTER (WHERE side = 'input') AS burns, count(DISTINCT tx) AS txs, {SIGNED.replace('amount', 'capacity')} AS owned_capacity, {SIGNED.replace('amount', 'occupied')} AS owned_occupied FROM legs GROUP BY token, day", "legs")
def A23_token_daily(spark, d):
    out = F.col("side") == "output"
    net = lambda c: F.sum(F.when(out, F.col(c)).otherwise(-F.col(c)))
    return ledger.totals(
        v.legs(spark, d), ["token", "day"], minted=F.sum(F.when(out, F.col("amount"))), burnt=F.sum(F.when(~out, F.col("amount"))), mints=F.count_if(out), burns=F.count_if(~out), txs=F.count_distinct("tx"),
        owned_capacity=net("capacity"), owned_occupied=net("occupied"),
    )


@query("""WITH h AS (SELECT party % 50 AS token, hour, count(*) AS n, count(*) FILTER (WHERE ts_ms > (SELECT max(ts_ms) FROM txs) - 86400000) AS r FROM txs GROUP BY 1, 2) SELECT token, hour, n, CAST(sum(n) OVER (PARTITION BY token) AS BIGINT) AS total, CAST(sum(r) OVER (PARTITION BY token) AS BIGINT) AS recent FROM h""", "txs")
def A24_token_transfers(spark, d):
    """Transfers per token and hour, with the token's total and those of the last 24 hours."""
    t = v.txs(spark, d).withColumn("token", F.col("party") % 50)
    last = t.agg(F.max("ts_ms").alias("_last"))
    hourly = ledger.totals(t.join(F.broadcast(last)), ["token", "hour"], n=F.count(F.lit(1)), r=F.count_if(F.col("ts_ms") > F.col("_last") - 86_400_000))
    own = Window.partitionBy("token")
    return hourly.select("token", "hour", "n", F.sum("n").over(own).alias("total"), F.sum("r").over(own).alias("recent"))


@query("SELECT p_brand AS collection, count(*) AS total, count(*) FILTER (WHERE day > (SELECT max(day) - 30 FROM legs)) AS recent FROM legs JOIN part ON item = p_partkey GROUP BY p_brand", "legs")
def A25_collection_transfers(spark, d):
    t = v.legs(spark, d)
    last = t.agg(F.max("day").alias("_last"))
    named = t.join(v.items(spark, d).select("item", "collection"), "item").join(F.broadcast(last))
    return ledger.totals(named, ["collection"], total=F.count(F.lit(1)), recent=F.count_if(F.col("day") > F.date_sub("_last", 30)))


@query("""WITH w AS (SELECT token, CAST(date_trunc('week', day) AS DATE) AS week, count(DISTINCT tx) AS txs FROM legs GROUP BY 1, 2), l AS (SELECT max(day) AS last FROM legs), s AS (SELECT token, min(week) AS a, max(week) AS b FROM w GROUP BY token), g AS (SELECT token, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM s)
SELECT g.token, g.week, CAST(coalesce(txs, 0) AS BIGINT) AS txs FROM g LEFT JOIN w ON g.token = w.token AND g.week = w.week, l WHERE g.week + 7 <= last""", "legs")
def A26_weekly_tx(spark, d):
    t = v.legs(spark, d)
    w = t.groupBy("token", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.count_distinct("tx").alias("txs"))
    span = w.groupBy("token").agg(F.min("week").alias("a"), F.max("week").alias("b")).select("token", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    last = t.agg(F.max("day").alias("_last"))
    return span.join(w, ["token", "week"], "left").join(F.broadcast(last)).where(F.date_add("week", 7) <= F.col("_last")).select("token", "week", F.coalesce("txs", F.lit(0)).alias("txs"))


@query(f"""WITH h AS (SELECT token, party, {SIGNED} AS held FROM legs GROUP BY token, party), p AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY held DESC, party) AS n FROM h WHERE held > 0)
SELECT token, CAST(least(length(CAST(held AS VARCHAR)) - 1, 6) AS VARCHAR) AS part, count(*) AS holders, CAST(sum(held) AS BIGINT) AS amount FROM p GROUP BY 1, 2
UNION ALL SELECT token, CASE WHEN n = 1 THEN 'top_1' WHEN n <= 10 THEN 'next_9' ELSE 'rest' END, NULL, CAST(sum(held) AS BIGINT) FROM p GROUP BY 1, 2""", "legs")
def A27_holder_distribution(spark, d):
    """Holders and amount by power of ten, and the amount of the first, the next nine and the rest."""
    held = ledger.signed_deltas(v.legs(spark, d), ["token", "party"], "side", "amount")
    bands = ledger.holder_distribution(held, "token", "delta").select("token", F.col("band").cast("string").alias("part"), "holders", "amount")
    top = ledger.top_holders(held, "token", "party", "delta").unpivot("token", ["top_1", "next_9", "rest"], "part", "amount").where("amount > 0")
    return bands.union(top.select("token", "part", F.lit(None).cast("bigint").alias("holders"), "amount"))


@query("WITH h AS (SELECT token, party, count(*) AS held FROM legs GROUP BY token, party) SELECT token, held, count(*) AS owners FROM h GROUP BY token, held", "legs")
def A28_collection_holders(spark, d):
    return ledger.count_of_counts(v.legs(spark, d), "token", "party")


@query(f"WITH w AS (SELECT collection FROM items GROUP BY collection HAVING bool_and(item % 97 <> 3)) SELECT collection, name, value, count(DISTINCT item) AS items FROM ({TRAITS}) JOIN items USING (item) WHERE collection IN (SELECT collection FROM w) GROUP BY collection, t_name, value".replace("name, value, count", "t_name AS name, value, count").replace(TRAITS, TRAITS.replace("AS name", "AS t_name")), "items")
def A29_trait_distribution(spark, d):
    known = v.items(spark, d).withColumn("decoded", F.col("item") % 97 != 3)
    return ledger.decoded_trait_distribution(known, traits(spark, d), "collection", "item", "decoded", "name", "value")


ACTED = """a AS (SELECT token, tx, item, bool_or(side = 'output') AS created, bool_or(side = 'input') AS consumed, min(day) AS day FROM legs GROUP BY token, tx, item),
acted AS (SELECT *, CASE WHEN created AND consumed THEN 'transfer' WHEN created THEN 'mint' ELSE 'burn' END AS action FROM a)"""


def acted(spark, d):
    a = v.legs(spark, d).groupBy("token", "tx", "item").agg(F.bool_or(F.col("side") == "output").alias("created"), F.bool_or(F.col("side") == "input").alias("consumed"), F.min("day").alias("day"))
    return a.withColumn("action", ledger.actions_of("created", "consumed"))


@query("""WITH g AS (SELECT token, tx, min(day) AS day, min(party) FILTER (WHERE side = 'input') AS bp, min(party) FILTER (WHERE side = 'output') AS ap, sum(amount) FILTER (WHERE side = 'input') AS bt, sum(amount) FILTER (WHERE side = 'output') AS t, max(line) AS l FROM legs GROUP BY token, tx),
k AS (SELECT *, CASE WHEN bp IS NULL THEN 'mint' WHEN ap IS NULL AND l > 2 THEN 'recycle' WHEN ap IS NULL THEN 'burn' WHEN bp <> ap THEN 'transfer' WHEN t > bt THEN 'renew' ELSE 'update' END AS action FROM g)
SELECT token, day, """ + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS \"{a}\"" for a in ("mint", "transfer", "burn", "renew", "update", "recycle")) + " FROM k GROUP BY token, day", "legs")
def A30_collection_activity_daily(spark, d):
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    g = v.legs(spark, d).groupBy("token", "tx").agg(
        F.min("day").alias("day"), F.min(side("input", "party")).alias("before"), F.min(side("output", "party")).alias("after"), F.sum(side("input", "amount")).alias("was"), F.sum(side("output", "amount")).alias("now"), F.max("line").alias("line")
    )
    action = ledger.item_action("before", "after", "was", "now", F.col("line") > 2)
    return ledger.totals(g.withColumn("action", action), ["token", "day"], **{a: F.count_if(F.col("action") == a) for a in ITEM_ACTIONS})


@query(f"WITH {ACTED} SELECT DISTINCT token, tx, action FROM acted", "legs")
def A31_collection_actions(spark, d):
    return acted(spark, d).select("token", "tx", "action").distinct()


@query(f"""WITH h AS (SELECT item, party FROM legs GROUP BY item, party HAVING {SIGNED} > 0), j AS (SELECT collection, count(DISTINCT item) AS live, count(DISTINCT party) AS owners FROM items JOIN h USING (item) GROUP BY collection),
t AS (SELECT collection, count(*) AS total, count(*) FILTER (WHERE kind = 'ECONOMY') AS chain, count(*) FILTER (WHERE kind = 'SMALL') AS permanent, count(*) FILTER (WHERE size > 45) AS server FROM items GROUP BY collection)
SELECT collection, total, coalesce(live, 0) AS live, coalesce(owners, 0) AS owners, chain, permanent, server FROM t LEFT JOIN j USING (collection)""", "items", "legs")
def A32_collection_summary(spark, d):
    held = ledger.signed_deltas(v.legs(spark, d), ["item", "party"], "side", "amount").where("delta > 0")
    tiers = {"chain": F.col("kind") == "ECONOMY", "permanent": F.col("kind") == "SMALL", "server": F.col("size") > 45}
    return ledger.collection_summary(v.items(spark, d), held, "collection", "item", "party", tiers)


@query("SELECT 'token' AS asset, count(DISTINCT token) AS n, count(*) AS rows FROM legs UNION ALL SELECT 'collection', count(DISTINCT collection), count(*) FROM items UNION ALL SELECT 'identity', count(DISTINCT node), count(*) FROM peers", "legs", "items", "peers")
def A33_asset_summary(spark, d):
    one = lambda name, df, c: df.agg(F.count_distinct(c).alias("n"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("asset"), "n", "rows")
    return one("token", v.legs(spark, d), "token").union(one("collection", v.items(spark, d), "collection")).union(one("identity", v.peers(spark, d), "node"))


USAGE = """u AS (SELECT 'lock' AS role, CAST(party AS VARCHAR) AS script, capacity, occupied, consumed_day FROM cells UNION ALL SELECT 'type', type, capacity, occupied, consumed_day FROM cells),
usage AS (SELECT role, script, count(*) AS cells, count(*) FILTER (WHERE consumed_day IS NULL) AS live_cells, CAST(sum(CASE WHEN consumed_day IS NULL THEN capacity ELSE 0 END) AS BIGINT) AS live_capacity, CAST(sum(CASE WHEN consumed_day IS NULL THEN occupied ELSE 0 END) AS BIGINT) AS live_occupied FROM u WHERE script IS NOT NULL GROUP BY role, script)"""


def usage(spark, d):
    c = v.cells(spark, d).withColumn("live", F.col("consumed_day").isNull())
    return ledger.script_usage(c, {"lock": "party", "type": "type"}, "live", "capacity", "occupied")


@query(f"WITH {USAGE} SELECT * FROM usage", "cells")
def A34_script_usage(spark, d):
    return usage(spark, d)


@query(f"WITH {USAGE} SELECT n_name AS family, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(live_capacity) AS BIGINT) AS live_capacity FROM usage JOIN customer ON script = CAST(c_custkey AS VARCHAR) JOIN nation ON c_nationkey = n_nationkey WHERE role = 'lock' GROUP BY n_name", "cells")
def A35_family_usage(spark, d):
    families = v.peers(spark, d).select(F.col("node").cast("string").alias("script"), F.col("country").alias("family"))
    return ledger.totals(usage(spark, d).where("role = 'lock'").join(families, "script"), ["family"], cells=F.sum("cells"), live_capacity=F.sum("live_capacity"))


EVENTS = "e AS (SELECT type, created_day AS day, capacity, occupied FROM cells UNION ALL SELECT type, consumed_day, -capacity, -occupied FROM cells WHERE consumed_day IS NOT NULL)"


@query(f"WITH {EVENTS} SELECT type, day, CAST(sum(capacity) AS BIGINT) AS delta, CAST(sum(occupied) AS BIGINT) AS occupied_delta FROM e GROUP BY type, day", "cells")
def A36_script_daily(spark, d):
    step = lambda day, sign: F.struct(F.col(day).alias("day"), (sign * F.col("capacity")).alias("capacity"), (sign * F.col("occupied")).alias("occupied"))
    e = v.cells(spark, d).select("type", F.inline(F.array(step("created_day", 1), step("consumed_day", -1)))).where(F.col("day").isNotNull())
    return ledger.totals(e, ["type", "day"], delta=F.sum("capacity"), occupied_delta=F.sum("occupied"))


@query("SELECT outpoint, party, deposit_day, request_day, complete_day FROM deposits", "deposits")
def J10_deposit_lifecycle(spark, d):
    o, i = v.outputs(spark, d), v.inputs(spark, d)
    done = i.where("complete_day > consumed_day").select("outpoint", "complete_day")
    life = joins.deposit_lifecycle(o.withColumnRenamed("created_day", "deposit_day"), i.select("outpoint", F.col("consumed_day").alias("request_day")), done, "outpoint")
    return life.select("outpoint", "party", "deposit_day", "request_day", "complete_day")


RATED = """r0 AS (SELECT min(day) AS a, greatest(max(day), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) AS b FROM rates), rd AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r0),
rated AS (SELECT rd.day, last_value(ar IGNORE NULLS) OVER (ORDER BY rd.day ROWS UNBOUNDED PRECEDING) AS ar FROM rd LEFT JOIN rates USING (day))"""


def rated(spark, d):
    shipped = v.read(spark, d, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("x"))  # no later than this is anything requested
    last = shipped.union(v.outputs(spark, d).agg(F.max("created_day"))).agg(F.max("x"))
    return series.carry_fill(v.rates(spark, d), [], "day", "ar", last=last)


@query(f"WITH {RATED} SELECT day, ar FROM rated", "rates", "deposits")
def A69_rate_by_day(spark, d):
    return rated(spark, d)


@query(f"WITH {RATED} SELECT outpoint, a.ar AS ar_deposit, b.ar AS ar_request FROM deposits d LEFT JOIN rated a ON d.deposit_day = a.day LEFT JOIN rated b ON d.request_day = b.day", "rates", "deposits")
def J11_attach_rates(spark, d):
    return joins.attach_rates(v.deposits(spark, d), rated(spark, d), "day", "ar", ar_deposit="deposit_day", ar_request="request_day").select("outpoint", "ar_deposit", "ar_request")


GAIN = "CAST((capacity - capacity % 1000) * CAST(b.ar AS HUGEINT) // a.ar - (capacity - capacity % 1000) AS BIGINT)"


def gains(spark, d):
    r = joins.attach_rates(v.deposits(spark, d), rated(spark, d), "day", "ar", ar_deposit="deposit_day", ar_request="request_day")
    return r.withColumn("gain", exact.compensation("capacity", F.col("capacity") % 1000, "ar_deposit", "ar_request"))


@query(f"WITH {RATED} SELECT outpoint, {GAIN} AS gain FROM deposits d LEFT JOIN rated a ON d.deposit_day = a.day LEFT JOIN rated b ON d.request_day = b.day", "rates", "deposits")
def F07_compensation(spark, d):
    return gains(spark, d).select("outpoint", "gain")


AGED = f"""{RATED}, tips AS (SELECT k, (SELECT max(deposit_day) FROM deposits) - k AS tip FROM (VALUES (0), (1)) t(k)),
aged AS (SELECT k, tip, outpoint, party, capacity, deposit_day, CASE WHEN request_day <= tip THEN request_day END AS request_day, CASE WHEN complete_day <= tip THEN complete_day END AS complete_day, date_diff('day', deposit_day, tip) AS age FROM deposits, tips WHERE deposit_day <= tip),
gained AS (SELECT g.*, {GAIN} AS gain FROM aged g JOIN rated a ON a.day = g.deposit_day JOIN rated b ON b.day = coalesce(g.request_day, g.tip))"""


def aged(spark, d, back=0):
    """Deposits as they were so many days before the last one, with their age and what they had gained."""
    x = v.deposits(spark, d)
    tip = x.agg(F.date_sub(F.max("deposit_day"), back).alias("_at"))
    then = lambda c: F.when(F.col(c) <= F.col("_at"), F.col(c)).alias(c)
    x = x.join(F.broadcast(tip)).where("deposit_day <= _at").select("outpoint", "party", "capacity", "deposit_day", then("request_day"), then("complete_day"), F.datediff("_at", "deposit_day").alias("age"), "_at")
    r = joins.attach_rates(x.withColumn("end_day", F.coalesce("request_day", "_at")), rated(spark, d), "day", "ar", a="deposit_day", b="end_day")
    return r.withColumn("gain", exact.compensation("capacity", F.col("capacity") % 1000, "a", "b")).drop("_at", "end_day", "a", "b")


@query(f"""WITH {AGED} SELECT CAST(coalesce(sum(gain) FILTER (WHERE request_day IS NULL AND complete_day IS NULL), 0) AS BIGINT) AS active, CAST(coalesce(sum(gain) FILTER (WHERE request_day IS NOT NULL AND complete_day IS NULL), 0) AS BIGINT) AS frozen,
CAST(coalesce(sum(gain) FILTER (WHERE complete_day IS NOT NULL), 0) AS BIGINT) AS claimed, CAST(coalesce(sum(gain) FILTER (WHERE complete_day IS NULL), 0) AS BIGINT) AS unclaimed FROM gained WHERE k = 0""", "rates", "deposits")
def A40_compensation_split(spark, d):
    return ledger.compensation_split(aged(spark, d), "request_day", "complete_day", "gain")


@query(f"""WITH {AGED} SELECT CAST(coalesce(sum(capacity) FILTER (WHERE request_day IS NULL AND complete_day IS NULL), 0) AS BIGINT) AS deposited, CAST(coalesce(sum(capacity) FILTER (WHERE request_day IS NOT NULL AND complete_day IS NULL), 0) AS BIGINT) AS waiting, count(*) FILTER (WHERE request_day IS NULL AND complete_day IS NULL) AS active_deposits, count(DISTINCT CASE WHEN request_day IS NULL AND complete_day IS NULL THEN party END) AS depositors,
CAST(sum(age) FILTER (WHERE request_day IS NULL AND complete_day IS NULL) // count(*) FILTER (WHERE request_day IS NULL AND complete_day IS NULL) AS BIGINT) AS average_age, CAST(coalesce(sum(gain) FILTER (WHERE request_day IS NULL AND complete_day IS NULL), 0) AS BIGINT) AS compensation FROM gained WHERE k = 0""", "rates", "deposits")
def A39_savings_stats(spark, d):
    return ledger.savings_stats(aged(spark, d), "capacity", "party", "request_day", "complete_day", "age", "gain")


@query(f"""WITH {AGED}, s AS (SELECT k, sum(capacity) FILTER (WHERE request_day IS NULL) AS c, count(DISTINCT party) FILTER (WHERE request_day IS NULL) AS p, sum(gain) FILTER (WHERE request_day IS NULL) AS g, count(*) AS n, count(request_day) AS r FROM gained GROUP BY k)
SELECT CAST(a.c - b.c AS BIGINT) AS change_deposited, CAST(a.p - b.p AS BIGINT) AS change_depositors, CAST(a.g - b.g AS BIGINT) AS change_compensation, CAST(a.n - b.n AS BIGINT) AS deposits, CAST(a.r - b.r AS BIGINT) AS requests FROM s a, s b WHERE a.k = 0 AND b.k = 1""", "rates", "deposits")
def A41_savings_change(spark, d):
    """Differences between two days: the state of savings at each, and the deposits and requests between them."""
    at = lambda k: aged(spark, d, k)
    stats = [ledger.savings_stats(at(k), "capacity", "party", "request_day", "complete_day", "age", "gain").select(F.col("deposited").alias(f"c{k}"), F.col("depositors").alias(f"p{k}"), F.col("compensation").alias(f"g{k}")) for k in (0, 1)]
    between = v.deposits(spark, d).join(F.broadcast(v.deposits(spark, d).agg(F.max("deposit_day").alias("_tip")))).agg(F.count_if(F.col("deposit_day") == F.col("_tip")).alias("deposits"), F.count_if(F.col("request_day") == F.col("_tip")).alias("requests"))
    both = stats[0].join(F.broadcast(stats[1])).join(F.broadcast(between))
    return both.select(*((F.col(f"{c}0") - F.col(f"{c}1")).alias(f"change_{n}") for c, n in (("c", "deposited"), ("p", "depositors"), ("g", "compensation"))), "deposits", "requests")


@query(f"WITH {AGED} SELECT party, count(*) AS deposits, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(gain) AS BIGINT) AS compensation FROM gained WHERE k = 0 AND request_day IS NULL GROUP BY party", "rates", "deposits")
def A42_address_savings(spark, d):
    return ledger.totals(aged(spark, d).where("request_day IS NULL"), ["party"], deposits=F.count(F.lit(1)), capacity=F.sum("capacity"), compensation=F.sum("gain"))


SNAPSHOT = """hs AS (SELECT party, day, sum(n) AS n FROM (SELECT party, deposit_day AS day, 1 AS n FROM deposits UNION ALL SELECT party, request_day, -1 FROM deposits WHERE request_day IS NOT NULL) GROUP BY party, day), hr AS (SELECT day, n, sum(n) OVER (PARTITION BY party ORDER BY day) AS now FROM hs),
x AS (SELECT deposit_day AS day, capacity AS c, 1 AS n, capacity AS g, 1 AS a, 0 AS w, 0 AS f, 0 AS p, 0 AS h FROM deposits UNION ALL SELECT request_day, -capacity, -1, 0, 0, 0, 0, 0, 0 FROM deposits WHERE request_day IS NOT NULL UNION ALL SELECT complete_day, 0, 0, 0, 0, 1, 0, 0, 0 FROM deposits WHERE complete_day IS NOT NULL
UNION ALL SELECT min(deposit_day), 0, 0, 0, 0, 0, 1, 0, 0 FROM deposits GROUP BY party UNION ALL SELECT deposit_day, 0, 0, 0, 0, 0, 0, count(DISTINCT party), 0 FROM deposits GROUP BY deposit_day
UNION ALL SELECT day, 0, 0, 0, 0, 0, 0, 0, CASE WHEN now > 0 AND now - n <= 0 THEN 1 WHEN now <= 0 AND now - n > 0 THEN -1 ELSE 0 END FROM hr),
y AS (SELECT day, sum(c) AS c, sum(n) AS n, sum(g) AS g, sum(a) AS a, sum(w) AS w, sum(f) AS f, sum(p) AS p, sum(h) AS h FROM x GROUP BY day),
snapshot AS (SELECT y.day, CAST(sum(c) OVER o AS BIGINT) AS deposited, CAST(sum(n) OVER o AS BIGINT) AS deposits, CAST(sum(g) OVER o AS BIGINT) AS gross, CAST(a AS BIGINT) AS new_deposits, CAST(g AS BIGINT) AS new_capacity, CAST(w AS BIGINT) AS withdrawals, CAST(sum(h) OVER o AS BIGINT) AS depositors, CAST(sum(f) OVER o AS BIGINT) AS ever_depositors, CAST(p AS BIGINT) AS depositing, last_value(ar IGNORE NULLS) OVER o AS ar FROM y LEFT JOIN rates ON y.day = rates.day WINDOW o AS (ORDER BY y.day ROWS UNBOUNDED PRECEDING))"""


FIELDS = SNAPSHOT + """, pr AS (SELECT day, sum(q) AS q FROM (SELECT deposit_day AS day, capacity AS q FROM deposits UNION ALL SELECT complete_day, -capacity FROM deposits WHERE complete_day IS NOT NULL) GROUP BY day),
bl AS (SELECT created_day AS day, max(outpoint) AS last_block, sum(capacity) AS cap, sum(occupied) AS occ, sum(data_size) AS ds FROM outputs GROUP BY 1),
fl AS (SELECT day, last_block, CAST(2 * sum(cap) OVER o AS BIGINT) AS c, CAST(sum(ds) OVER o AS BIGINT) AS s, CAST(sum(occ) OVER o AS BIGINT) AS u FROM bl WINDOW o AS (ORDER BY day ROWS UNBOUNDED PRECEDING)),
full_days AS (SELECT a.*, CAST(sum(coalesce(q, 0)) OVER o AS BIGINT) AS protocol, last_value(last_block IGNORE NULLS) OVER o AS last_block, last_value(c IGNORE NULLS) OVER o AS c, last_value(fl.s IGNORE NULLS) OVER o AS s, last_value(u IGNORE NULLS) OVER o AS u
FROM snapshot a LEFT JOIN pr ON a.day = pr.day LEFT JOIN fl ON a.day = fl.day WINDOW o AS (ORDER BY a.day ROWS UNBOUNDED PRECEDING))"""


def header_fields(spark, d):
    """Day, last block and its fields: C (issued), S (not yet claimed) and U (occupied), as running sums of the days' blocks."""
    days = v.outputs(spark, d).groupBy(F.col("created_day").alias("day")).agg(F.max("outpoint").alias("last_block"), *(F.sum(c).alias(c) for c in ("capacity", "occupied", "data_size")))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return days.select("day", "last_block", (F.sum("capacity").over(w) * 2).alias("c"), F.sum("data_size").over(w).alias("s"), F.sum("occupied").over(w).alias("u"))


@query(f"WITH {FIELDS} SELECT * FROM full_days", "deposits", "rates")
def A43_savings_daily(spark, d):
    """Daily state of savings: facts of each day are summed, and only the days are ordered.

    deposited is what is active, protocol what is locked until its withdrawal is complete; C, S, U and the rate are those of the last block.
    """
    x, one = v.deposits(spark, d), F.count(F.lit(1))
    day = lambda c: F.col(c).alias("day")
    facts = [
        x.groupBy(day("deposit_day")).agg(F.sum("capacity").alias("c"), one.alias("n"), F.sum("capacity").alias("new_capacity"), one.alias("new_deposits"), F.sum("capacity").alias("q")),
        x.where("request_day IS NOT NULL").groupBy(day("request_day")).agg((-F.sum("capacity")).alias("c"), (-one).alias("n")),
        x.where("complete_day IS NOT NULL").groupBy(day("complete_day")).agg(one.alias("withdrawals"), (-F.sum("capacity")).alias("q")),
        x.groupBy("party").agg(F.min("deposit_day").alias("day")).groupBy("day").agg(one.alias("first")),
        x.select("party", day("deposit_day")).distinct().groupBy("day").agg(one.alias("depositing")),
        series.holder_steps(state_steps(x, "deposit_day", "request_day"), "party", "day", "n"),
    ]
    daily = ledger.sum_facts(facts, ["day"]).withColumnRenamed("c", "active").join(v.rates(spark, d), "day", "left").join(header_fields(spark, d), "day", "left")
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c, name: F.sum(c).over(w).alias(name)
    return daily.select(
        "day", run("active", "deposited"), run("n", "deposits"), run("new_capacity", "gross"), "new_deposits", "new_capacity", "withdrawals", run("step", "depositors"), run("first", "ever_depositors"), "depositing",
        run("q", "protocol"), *(F.last(c, True).over(w).alias(c) for c in ("ar", "last_block", "c", "s", "u")),
    )


@query(f"WITH {FIELDS} SELECT day, deposited, CAST(deposited - lag(deposited) OVER (ORDER BY day) AS BIGINT) AS change_deposited, depositors, new_deposits, new_capacity, depositing, ever_depositors, {cut_text('deposited', '(c - s)', 4)} AS ratio FROM full_days", "deposits", "rates")
def A44_savings_charts(spark, d):
    """Series of savings; the ratio is that of active deposits to the circulating supply, what is issued and claimed."""
    s = series.daily_change(A43_savings_daily(spark, d), [], "day", "deposited")
    return s.select("day", "deposited", "change_deposited", "depositors", "new_deposits", "new_capacity", "depositing", "ever_depositors", exact.ratio_cut("deposited", F.col("c") - F.col("s"), 4).alias("ratio"))


@query("""WITH t AS (SELECT max(deposit_day) AS tip FROM deposits), b AS (SELECT 30 - (date_diff('day', deposit_day, tip)) % 30 AS bucket, count(*) AS n FROM deposits, t WHERE request_day IS NULL GROUP BY 1),
r AS (SELECT deposit_day + CAST((date_diff('day', deposit_day, request_day) + 29) // 30 * 30 AS INTEGER) <= tip AS ready FROM deposits, t WHERE request_day IS NOT NULL AND complete_day IS NULL)
SELECT 'live' AS part, CAST(r.range AS BIGINT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(1, 31) r LEFT JOIN b ON r.range = bucket UNION ALL SELECT 'ready', NULL, count(*) FILTER (WHERE ready) FROM r UNION ALL SELECT 'waiting', NULL, count(*) FILTER (WHERE NOT ready) FROM r""", "deposits")
def A45_unlock_windows(spark, d):
    """Live deposits by days to their next cycle end, and requests whose cycle is over (ready) or not (waiting)."""
    x = v.deposits(spark, d)
    x = x.join(F.broadcast(x.agg(F.max("deposit_day").alias("_tip"))))
    b = x.where("request_day IS NULL").groupBy((30 - F.datediff("_tip", "deposit_day") % 30).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    live = spark.range(1, 31).withColumnRenamed("id", "bucket").join(b, "bucket", "left").select(F.lit("live").alias("part"), "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    unlock = F.date_add("deposit_day", F.ceil(F.datediff("request_day", "deposit_day") / 30).cast("int") * 30)
    split = x.where("request_day IS NOT NULL AND complete_day IS NULL").agg(F.count_if(unlock <= F.col("_tip")).alias("ready"), F.count_if(unlock > F.col("_tip")).alias("waiting"))
    return live.union(split.select(F.lit(None).cast("bigint").alias("bucket"), "ready", "waiting").unpivot("bucket", ["ready", "waiting"], "part", "n").select("part", "bucket", "n"))


RANKED = "r AS (SELECT party, CAST(sum(capacity) AS BIGINT) AS capacity FROM outputs GROUP BY party), ranked AS (SELECT *, row_number() OVER (ORDER BY capacity DESC, party) AS position FROM r)"


def balances(spark, d):
    return v.outputs(spark, d).groupBy("party").agg(F.sum("capacity").alias("capacity"))


@query(f"WITH {RANKED}, s AS (SELECT sum(capacity) AS whole, sum(capacity) FILTER (WHERE position <= 1) AS a, sum(capacity) FILTER (WHERE position <= 10) AS b, sum(capacity) FILTER (WHERE position <= 100) AS c FROM ranked) SELECT CAST(whole AS BIGINT) AS whole, {cut_text('a', 'whole')} AS top_1, {cut_text('b', 'whole')} AS top_10, {cut_text('c', 'whole')} AS top_100 FROM s", "outputs")
def A46_concentration(spark, d):
    return ledger.concentration(balances(spark, d), "capacity", "party")


@query(f"WITH {RANKED} SELECT party, capacity, position FROM ranked", "outputs")
def W07_rank(spark, d):
    return series.all_positions(balances(spark, d), "capacity", "party", io.work_folder(spark))


@query(f"WITH {RANKED}, c AS (SELECT capacity AS m, party AS k FROM ranked WHERE position = 40) SELECT party, capacity, CAST(position AS INTEGER) AS position FROM ranked WHERE position BETWEEN 41 AND 60", "outputs")
def L02_ranked_page(spark, d):
    b = balances(spark, d)
    last = ranking.top(b, "capacity", "party", 40).orderBy("capacity", F.desc("party")).first()
    return ranking.ranked_page(b, "capacity", "party", 20, (last["capacity"], last["party"]) if last else None)


@query("SELECT party, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(date_diff('day', deposit_day, DATE '2002-01-01')) // count(*) AS BIGINT) AS days FROM deposits WHERE request_day IS NULL GROUP BY party ORDER BY capacity DESC, party LIMIT 25", "deposits")
def L03_top_depositors(spark, d):
    x = v.deposits(spark, d).where("request_day IS NULL").groupBy("party").agg(F.sum("capacity").alias("capacity"), exact.int_div(F.sum(F.datediff(F.lit("2002-01-01").cast("date"), "deposit_day")), F.count(F.lit(1))).alias("days"))
    return ranking.top(x, "capacity", "party", 25)


@query(f"WITH {RANKED} SELECT party, capacity FROM ranked WHERE position <= 50", "outputs")
def L04_top_addresses(spark, d):
    return ranking.top(balances(spark, d), "capacity", "party", 50)


@query(f"""WITH s AS (SELECT day, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(occupied) AS BIGINT) AS occupied, CAST(token AS VARCHAR) AS token FROM legs GROUP BY day, token), l AS (SELECT * FROM s WHERE day = (SELECT max(day) FROM s)),
u AS (SELECT 'amount' AS measure, day, token, amount AS value FROM s UNION ALL SELECT 'occupied', day, token, occupied FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, token) AS n FROM u WHERE day = (SELECT max(day) FROM u))
SELECT measure, 'top' AS part, day, token, CAST(n AS INTEGER) AS rank, value FROM k WHERE n <= 20
UNION ALL SELECT measure, 'drawn', day, CASE WHEN (measure, token) IN (SELECT measure, token FROM k WHERE n <= 5) THEN token ELSE 'rest' END AS token, NULL, CAST(sum(value) AS BIGINT) FROM u GROUP BY measure, day, 4""", "legs")
def L05_most_utilised_scripts(spark, d):
    s = v.legs(spark, d).groupBy("day", F.col("token").cast("string").alias("token")).agg(F.sum("amount").alias("amount"), F.sum("occupied").alias("occupied"))
    return ranking.most_utilised(s, "day", "token", ["amount", "occupied"])


@query("WITH s AS (SELECT day, p_brand AS collection, count(*) AS n FROM legs JOIN part ON item = p_partkey GROUP BY 1, 2), top AS (SELECT collection FROM s WHERE day = (SELECT max(day) FROM s) ORDER BY n DESC, collection LIMIT 5) SELECT day, CASE WHEN collection IN (SELECT collection FROM top) THEN collection ELSE 'rest' END AS collection, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2", "legs")
def L06_most_utilised_assets(spark, d):
    s = v.legs(spark, d).join(v.items(spark, d).select("item", "collection"), "item").groupBy("day", "collection").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_n_with_rest(s, "day", "collection", "n", 5)


@query("""WITH p AS (SELECT outpoint, party, deposit_day, CASE WHEN complete_day IS NOT NULL THEN 'complete' WHEN request_day IS NOT NULL THEN 'requested' ELSE 'active' END AS status FROM deposits), a AS (SELECT * FROM p WHERE (deposit_day, outpoint) < (DATE '2000-01-01', 5000))
SELECT * FROM (SELECT 'active' AS list, outpoint, deposit_day FROM a WHERE status = 'active' ORDER BY deposit_day DESC, outpoint DESC LIMIT 30) UNION ALL SELECT * FROM (SELECT 'requested', outpoint, deposit_day FROM a WHERE status = 'requested' ORDER BY deposit_day DESC, outpoint DESC LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'complete', outpoint, deposit_day FROM a WHERE status = 'complete' ORDER BY deposit_day DESC, outpoint DESC LIMIT 30) UNION ALL SELECT * FROM (SELECT 'party 77', outpoint, deposit_day FROM a WHERE party = 77 ORDER BY deposit_day DESC, outpoint DESC LIMIT 30) UNION ALL SELECT * FROM (SELECT 'all', outpoint, deposit_day FROM a ORDER BY deposit_day DESC, outpoint DESC LIMIT 30)""", "deposits")
def L08_list_deposits(spark, d):
    """The newest deposits after a cursor: of each status, of one party, and of all."""
    done, asked = F.col("complete_day").isNotNull(), F.col("request_day").isNotNull()
    x = v.deposits(spark, d).withColumn("status", F.when(done, "complete").when(asked, "requested").otherwise("active"))
    lists = {s: x.where(F.col("status") == s) for s in ("active", "requested", "complete")} | {"party 77": x.where("party = 77"), "all": x}
    cursor = (F.lit("2000-01-01").cast("date"), 5000)
    return sets.union_feed({n: ranking.page(p.select("outpoint", "deposit_day"), ["deposit_day", "outpoint"], 30, cursor) for n, p in lists.items()}).withColumnRenamed("kind", "list")


@query("SELECT collection, count(*) AS n FROM items GROUP BY collection ORDER BY n, collection", "items")
def L10_list_assets(spark, d):
    return ranking.sorted_list(v.items(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n")), "n", "collection", False)


RATE0 = "WITH y AS (SELECT date_part('year', day) AS year, min(ar) AS a, max(ar) AS b, CAST(max(day) - min(day) AS BIGINT) AS days FROM rates GROUP BY 1)"


@query(f"{RATE0} SELECT CAST(year AS INTEGER) AS year, CAST(CAST((b - a) * 365 * 10000 // (CAST(a AS HUGEINT) * days) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST((b - a) * 365 * 10000 // (CAST(a AS HUGEINT) * days) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS yearly FROM y WHERE days > 0", "rates")
def F10_realized_return(spark, d):
    y = v.rates(spark, d).groupBy(F.year("day").alias("year")).agg(F.min("ar").alias("a"), F.max("ar").alias("b"), F.datediff(F.max("day"), F.min("day")).alias("days")).where("days > 0")
    return y.select("year", exact.realized_return("a", "b", "days").alias("yearly"))


@query("WITH p AS (SELECT day, ar, lag(ar) OVER (ORDER BY day) AS before FROM rates) SELECT date_part('year', day) AS year, CAST(sum((ar - before) * 1000003 // before) AS BIGINT) AS secondary FROM p WHERE before IS NOT NULL GROUP BY 1", "rates")
def A47_miner_secondary(spark, d):
    r = v.rates(spark, d)
    w = Window.orderBy("day")
    p = r.withColumn("before", F.lag("ar").over(w)).where("before IS NOT NULL")
    return p.groupBy(F.year("day").cast("bigint").alias("year")).agg(F.sum(exact.int_div((F.col("ar") - F.col("before")) * 1_000_003, "before")).alias("secondary"))


LAYERS = f"l AS (SELECT type, created_day AS day, CAST(sum(capacity) AS BIGINT) AS c FROM outputs GROUP BY 1, 2), p AS (SELECT day, {', '.join(f'''CAST(coalesce(sum(c) FILTER (WHERE type LIKE '{k}%'), 0) AS BIGINT) AS l{k}''' for k in range(1, 6))} FROM l GROUP BY day)"


def layers(spark, d):
    o = v.outputs(spark, d)
    return o.groupBy(F.col("created_day").alias("day")).agg(*(F.sum(F.when(F.startswith("type", F.lit(str(k))), F.col("capacity")).otherwise(0)).alias(f"l{k}") for k in range(1, 6)))


@query(f"WITH {LAYERS} SELECT day, " + ", ".join(f"CAST(sum(l{k}) OVER w AS BIGINT) AS total_l{k}" for k in range(1, 6)) + " FROM p WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)", "outputs")
def A48_cumulative_split(spark, d):
    return series.running_total(layers(spark, d), [], "day", *(f"l{k}" for k in range(1, 6))).select("day", *(f"total_l{k}" for k in range(1, 6)))


@query(f"WITH {LAYERS} SELECT *, l1 + l2 + l3 + l4 + l5 AS whole FROM p", "outputs")
def A49_supply_layers(spark, d):
    x = layers(spark, d)
    return x.withColumn("whole", sum((F.col(f"l{k}") for k in range(1, 6)), F.lit(0)).cast("bigint"))


@query("""WITH s AS (SELECT day, ar, c FROM rates JOIN (SELECT day, CAST(sum(c) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS c FROM (SELECT created_day AS day, sum(capacity) AS c FROM outputs GROUP BY created_day)) USING (day)),
i AS (SELECT a.day, a.ar - b.ar AS gained, CAST((a.c - b.c) * 10000 // b.c AS BIGINT) AS nominal, CAST((a.ar - b.ar) * 10000 // b.ar AS BIGINT) AS earned FROM s a JOIN s b ON b.day = a.day - 365) SELECT day, gained, nominal AS nominal_bp, nominal - earned AS real_bp FROM i""", "rates", "outputs")
def A50_inflation(spark, d):
    """Growth over 365 days in hundredths of a percent: of the supply (nominal), and of it less what savings earned (real)."""
    supply = series.running_total(v.outputs(spark, d).groupBy(F.col("created_day").alias("day")).agg(F.sum("capacity").alias("c")), [], "day", "c")
    r = v.rates(spark, d).join(supply.select("day", "total_c"), "day")
    x = r.join(r.select(F.date_add("day", 365).alias("day"), F.col("ar").alias("ar0"), F.col("total_c").alias("c0")), "day")
    grown = lambda a, b: exact.int_div((F.col(a) - F.col(b)).cast("decimal(28,0)") * 10_000, F.col(b))
    return x.select("day", (F.col("ar") - F.col("ar0")).alias("gained"), grown("total_c", "c0").alias("nominal_bp"), (grown("total_c", "c0") - grown("ar", "ar0")).alias("real_bp"))


OVER_TIME = f"{EVENTS}, s AS (SELECT type, day, sum(capacity) AS c FROM e GROUP BY type, day)"


@query(f"WITH {EVENTS}, t AS (SELECT day, sum(occupied) AS o, sum(capacity) AS c FROM e GROUP BY day), s AS (SELECT day, CAST(sum(o) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS size, CAST(sum(c) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS whole, CAST(o AS BIGINT) AS net FROM t) SELECT day, size, net, CASE WHEN whole <> 0 THEN {cut_text('size', 'whole')} END AS share FROM s", "cells")
def A51_knowledge_size(spark, d):
    s = series.state_over_time(v.cells(spark, d), "created_day", "consumed_day", [], size="occupied", whole="capacity")
    return series.daily_change(s, [], "day", "size").select("day", "size", F.coalesce("change_size", "size").alias("net"), exact.ratio_cut("size", "whole").alias("share"))


@query(f"WITH {OVER_TIME} SELECT type, day, CAST(sum(c) OVER (PARTITION BY type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS capacity FROM s", "cells")
def A52_composition_daily(spark, d):
    return series.state_over_time(v.cells(spark, d), "created_day", "consumed_day", ["type"], capacity="capacity")


@query(f"WITH {OVER_TIME} SELECT type, day, CAST(sum(c) OVER (PARTITION BY type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s", "cells")
def W05_state(spark, d):
    return series.state_over_time(v.cells(spark, d), "created_day", "consumed_day", ["type"], total="capacity")


@query(f"""WITH {EVENTS}, t AS (SELECT day, sum(occupied) AS o, coalesce(sum(-occupied) FILTER (WHERE occupied < 0), 0) AS u FROM e GROUP BY day), r AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t),
f AS (SELECT r.day, coalesce(u, 0) AS u, sum(coalesce(o, 0)) OVER (ORDER BY r.day ROWS UNBOUNDED PRECEDING) AS o, sum(coalesce(u, 0)) OVER (ORDER BY r.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS w FROM r LEFT JOIN t USING (day))
SELECT day, CAST(u AS BIGINT) AS consumed, CAST(w AS BIGINT) AS consumed_7, CASE WHEN o <> 0 THEN {cut_text('u', 'o')} END AS day_ratio, CASE WHEN o <> 0 THEN {cut_text('w', 'o')} END AS week_ratio FROM f""", "cells")
def A53_turnover(spark, d):
    """Consumed of occupied, per day and over seven days."""
    c = v.cells(spark, d)
    used = c.where("consumed_day IS NOT NULL").groupBy(F.col("consumed_day").alias("day")).agg(F.sum("occupied").alias("consumed"))
    size = series.carry_fill(series.state_over_time(c, "created_day", "consumed_day", [], size="occupied"), [], "day", "size")
    f = size.join(used, "day", "left").withColumn("consumed", F.coalesce("consumed", F.lit(0)))
    f = f.withColumn("consumed_7", series.trailing_sum(f, [], "day", "consumed", 7))
    return f.select("day", "consumed", "consumed_7", exact.ratio_cut("consumed", "size").alias("day_ratio"), exact.ratio_cut("consumed_7", "size").alias("week_ratio"))


@query("SELECT CAST(CASE WHEN capacity < 5000000 THEN 0 WHEN capacity < 10000000 THEN 1 WHEN capacity < 20000000 THEN 2 WHEN capacity < 30000000 THEN 3 WHEN capacity < 40000000 THEN 4 ELSE 5 END AS INTEGER) AS band, count(*) AS cells, CAST(sum(capacity) AS BIGINT) AS capacity FROM cells WHERE consumed_day IS NULL GROUP BY 1", "cells")
def A54_size_distribution(spark, d):
    band = ledger.size_bands("capacity", [5_000_000, 10_000_000, 20_000_000, 30_000_000, 40_000_000])
    return ledger.totals(v.cells(spark, d).where("consumed_day IS NULL").withColumn("band", band), ["band"], cells=F.count(F.lit(1)), capacity=F.sum("capacity"))


@query("WITH a AS (SELECT party, strftime(min(created_day), '%Y-%m') AS month, sum(capacity) AS ever, coalesce(sum(capacity) FILTER (WHERE consumed_day IS NULL), 0) AS now FROM cells GROUP BY party) SELECT month, count(*) AS parties, CAST(sum(ever) AS BIGINT) AS ever, CAST(sum(now) AS BIGINT) AS now FROM a GROUP BY month", "cells")
def A55_cohort_retention(spark, d):
    a = v.cells(spark, d).groupBy("party").agg(F.date_format(F.min("created_day"), "yyyy-MM").alias("month"), F.sum("capacity").alias("ever"), F.sum(F.when(F.col("consumed_day").isNull(), F.col("capacity")).otherwise(0)).alias("now"))
    return ledger.totals(a, ["month"], parties=F.count(F.lit(1)), ever=F.sum("ever"), now=F.sum("now"))


@query("""WITH c AS (SELECT CASE WHEN consumed_day IS NULL THEN 'open' ELSE 'closed' END AS state, type, capacity, date_diff('day', created_day, consumed_day) AS life FROM cells)
SELECT state, NULL AS type, count(*) AS channels, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(quantile_disc(life, 0.5) AS INTEGER) AS median_life, count(*) FILTER (WHERE life <= 1) AS short_lives FROM c GROUP BY state
UNION ALL SELECT state, type, count(*), CAST(sum(capacity) AS BIGINT), CAST(quantile_disc(life, 0.5) AS INTEGER), count(*) FILTER (WHERE life <= 1) FROM c GROUP BY state, type""", "cells")
def A56_channel_stats(spark, d):
    c = v.cells(spark, d).withColumns({"state": F.when(F.col("consumed_day").isNull(), "open").otherwise("closed"), "life": F.datediff("consumed_day", "created_day")})
    return ledger.channel_stats(c, "state", "type", "capacity", "life", 1)


@query("""SELECT 'pair' AS kind, least(party, token) AS one, greatest(party, token) AS two, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, min(day) AS first, max(day) AS last FROM legs GROUP BY 2, 3
UNION ALL SELECT 'party', p, NULL, count(*), CAST(sum(amount) AS BIGINT), min(day), max(day) FROM (SELECT party AS p, amount, day FROM legs UNION ALL SELECT token, amount, day FROM legs WHERE token <> party) GROUP BY p""", "legs")
def A57_channel_network(spark, d):
    x = v.legs(spark, d)
    parties = ledger.party_counts(x, "party", "token", "amount", "day").withColumnRenamed("party", "one")
    return sets.union_feed({"pair": ledger.pair_counts(x, "party", "token", "amount", "day"), "party": parties})


@query("SELECT country, count(*) AS n, count(*) FILTER (WHERE reachable) AS flagged FROM peers GROUP BY country", "peers")
def A59_peer_distributions(spark, d):
    return ledger.distribution(v.peers(spark, d), "country", "reachable")


@query("SELECT version, country, count(*) AS n FROM peers GROUP BY version, country UNION ALL SELECT version, NULL, count(*) FROM peers GROUP BY version", "peers")
def A60_release_counts(spark, d):
    return ledger.two_levels(v.peers(spark, d), "version", "country")


@query("WITH s AS (SELECT country, count(*) AS t FROM peers GROUP BY country), top AS (SELECT country FROM s ORDER BY t DESC, country LIMIT 5) SELECT CASE WHEN country IN (SELECT country FROM top) THEN country ELSE 'rest' END AS country, CAST(sum(t) AS BIGINT) AS total FROM s GROUP BY 1", "peers")
def A61_hosting_split(spark, d):
    return ledger.top_and_rest(v.peers(spark, d).withColumn("one", F.lit(1).cast("bigint")), "country", "one", 5)


@query("SELECT country, count(*) FILTER (WHERE reachable AND node % 3 = 0) AS direct, count(*) FILTER (WHERE reachable AND node % 3 <> 0) AS relayed, count(*) FILTER (WHERE NOT reachable) AS exhausted FROM peers GROUP BY country", "peers")
def A62_probe_outcomes(spark, d):
    kind = ledger.first_kind(("direct", F.col("reachable") & (F.col("node") % 3 == 0)), ("relayed", F.col("reachable")), other="exhausted")
    return ledger.kind_counts(v.peers(spark, d).withColumn("outcome", kind), "country", "outcome", ["direct", "relayed", "exhausted"])


@query("SELECT token, party, min(day) AS first, max(day) AS latest, count(*) AS n FROM legs GROUP BY token, party", "legs")
def A64_session_facts(spark, d):
    return ledger.facts(v.legs(spark, d), ["token", "party"], "day")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def A67_group_by_host(spark, d):
    return ledger.group_by_host(v.read(spark, d, "pages"), "url")


@query("SELECT node, country, CAST(coalesce(n, 0) AS BIGINT) AS sessions FROM peers LEFT JOIN (SELECT party, count(*) AS n FROM outputs GROUP BY party) ON node = party", "peers", "outputs")
def A68_peer_map(spark, d):
    sessions = v.outputs(spark, d).groupBy(F.col("party").alias("node")).agg(F.count(F.lit(1)).alias("sessions"))
    return v.peers(spark, d).select("node", "country").join(sessions, "node", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


@query("SELECT tx, side, token, array_to_string(list_sort(list(line)), ',') AS positions FROM legs GROUP BY tx, side, token", "legs")
def A70_script_groups(spark, d):
    return ledger.script_groups(v.legs(spark, d), "tx", "side", "token", "line").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("SELECT count(*) AS cells, CAST(sum(capacity) AS BIGINT) AS issued, CAST(coalesce(sum(capacity) FILTER (WHERE type = '5-LOW'), 0) AS BIGINT) AS burnt FROM outputs WHERE created_day = (SELECT min(created_day) FROM outputs)", "outputs")
def A72_genesis_baseline(spark, d):
    o = v.outputs(spark, d)
    first = o.agg(F.min("created_day").alias("created_day"))
    return o.join(F.broadcast(first), "created_day").agg(F.count(F.lit(1)).alias("cells"), F.sum("capacity").alias("issued"), F.sum(F.when(F.col("type") == "5-LOW", F.col("capacity")).otherwise(0)).alias("burnt"))


@query(f"WITH s AS (SELECT token, day, {SIGNED} AS delta FROM legs GROUP BY token, day) SELECT token, day, delta, CAST(sum(delta) OVER (PARTITION BY token ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_delta FROM s", "legs")
def W01_running_total(spark, d):
    return series.running_total(ledger.signed_deltas(v.legs(spark, d), ["token", "day"], "side", "amount"), ["token"], "day", "delta")


FILL = "WITH o AS (SELECT type, party % 25 AS zone, created_day AS day, count(*) AS n FROM outputs GROUP BY 1, 2, 3), x AS (SELECT type, zone, min(day) AS a, (SELECT max(day) FROM o) AS b FROM o GROUP BY type, zone), r AS (SELECT type, zone, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM x)"


def sparse(spark, d):
    """All outputs by type, zone and day: each zone has days without an output."""
    return v.outputs(spark, d).groupBy("type", (F.col("party") % 25).alias("zone"), F.col("created_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{FILL} SELECT r.type, r.zone, r.day, last_value(n IGNORE NULLS) OVER (PARTITION BY r.type, r.zone ORDER BY r.day ROWS UNBOUNDED PRECEDING) AS n FROM r LEFT JOIN o ON r.type = o.type AND r.zone = o.zone AND r.day = o.day", "outputs")
def W03_carry_fill(spark, d):
    return series.carry_fill(sparse(spark, d), ["type", "zone"], "day", "n")


@query(f"{FILL} SELECT r.type, r.zone, r.day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM r LEFT JOIN o ON r.type = o.type AND r.zone = o.zone AND r.day = o.day", "outputs")
def W04_zero_fill(spark, d):
    return series.zero_fill(sparse(spark, d), ["type", "zone"], "day", "n")


BANDS = [("under 1", 0, 1), ("1-7", 1, 7), ("7-30", 7, 30), ("30-90", 30, 90), ("90-180", 90, 180), ("180-365", 180, 365), ("365-1095", 365, 1095), ("1095+", 1095, None)]


@query("""WITH b(band, a, z) AS (VALUES """ + ", ".join(f"('{n}', {a}, {'NULL' if z is None else z})" for n, a, z in BANDS) + """), x AS (SELECT band, created_day + CAST(a AS INTEGER) AS enter, least(created_day + CAST(z AS INTEGER), consumed_day) AS leave, capacity FROM cells, b),
h AS (SELECT * FROM x WHERE leave IS NULL OR enter < leave), e AS (SELECT band, enter AS day, capacity FROM h UNION ALL SELECT band, leave, -capacity FROM h WHERE leave IS NOT NULL), s AS (SELECT band, day, sum(capacity) AS c FROM e GROUP BY band, day)
SELECT band, CAST(day AS DATE) AS day, CAST(sum(c) OVER (PARTITION BY band ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS measure FROM s""", "cells")
def W06_age_bands(spark, d):
    return series.age_bands(v.cells(spark, d), "created_day", "consumed_day", "capacity", BANDS)


@query(f"WITH s AS (SELECT token, tx, day, {SIGNED} AS delta FROM legs GROUP BY token, tx, day) SELECT token, tx, day, CAST(sum(delta) OVER (PARTITION BY token ORDER BY day, tx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS supply FROM s WHERE delta <> 0", "legs")
def W11_supply_events(spark, d):
    s = ledger.signed_deltas(v.legs(spark, d), ["token", "tx", "day"], "side", "amount").where("delta <> 0")
    w = Window.partitionBy("token").orderBy("day", "tx").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("token", "tx", "day", F.sum("delta").over(w).alias("supply"))


@query(f"WITH {OVER_TIME}, t AS (SELECT type, day, sum(c) OVER (PARTITION BY type ORDER BY day ROWS UNBOUNDED PRECEDING) AS c FROM s), x AS (SELECT type, min(day) AS a, (SELECT max(day) FROM t) AS b FROM t GROUP BY type), r AS (SELECT type, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM x) SELECT r.type, r.day, CAST(last_value(c IGNORE NULLS) OVER (PARTITION BY r.type ORDER BY r.day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS capacity FROM r LEFT JOIN t ON r.type = t.type AND r.day = t.day", "cells")
def W12_capacity_history(spark, d):
    return series.carry_fill(A52_composition_daily(spark, d), ["type"], "day", "capacity")


@query(f"WITH c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 365 DAY)) AS DATE) AS day FROM rates UNION SELECT max(day) FROM rates), m AS (SELECT c.day, max(ar) AS ar FROM c JOIN rates r ON r.day <= c.day GROUP BY c.day), p AS (SELECT day, ar, lag(ar) OVER (ORDER BY day) AS b FROM m) SELECT day, ar, {cut_text('(ar - b)', 'b')} AS growth FROM p", "rates")
def W13_rate_milestones(spark, d):
    """The rate every 365 days and at the tip, with its growth since the milestone before."""
    r = v.rates(spark, d)
    span = r.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    marks = span.select(F.explode(F.array_union(F.sequence("a", "b", F.expr("interval 365 days")), F.array("b"))).alias("day"))
    m = series.daily_change(marks.join(series.carry_fill(r, [], "day", "ar"), "day"), [], "day", "ar")  # a row a year
    return m.select("day", "ar", exact.ratio_cut("change_ar", F.col("ar") - F.col("change_ar")).alias("growth"))


@query("WITH e AS (SELECT party, created_day AS day, 1 AS n FROM cells UNION ALL SELECT party, consumed_day, -1 FROM cells WHERE consumed_day IS NOT NULL), s AS (SELECT party, day, sum(n) AS n FROM e GROUP BY party, day), r AS (SELECT party, day, n, sum(n) OVER (PARTITION BY party ORDER BY day) AS now FROM s), c AS (SELECT day, sum(CASE WHEN now > 0 AND now - n <= 0 THEN 1 WHEN now <= 0 AND now - n > 0 THEN -1 ELSE 0 END) AS step FROM r GROUP BY day) SELECT day, CAST(sum(step) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS holders FROM c", "cells")
def W14_holders_over_time(spark, d):
    return series.holders_over_time(cell_steps(spark, d), "party", "day", "n")


@query("WITH m AS (SELECT item, tx * 10 + line AS place, min(party) AS party FROM legs GROUP BY item, tx * 10 + line), n AS (SELECT *, lag(party) OVER (PARTITION BY item ORDER BY place) AS before FROM m), s AS (SELECT * FROM n WHERE before IS DISTINCT FROM party) SELECT item, min(place) AS first_seen, max(place) AS held_since, arg_max(party, place) AS party FROM s GROUP BY item", "legs")
def W15_held_since(spark, d):
    m = v.legs(spark, d).groupBy("item", (F.col("tx") * 10 + F.col("line")).alias("at")).agg(F.min("party").alias("party"))
    return series.held_since(m, "item", "at", "party")


@query("SELECT item, place, CAST(row_number() OVER (PARTITION BY item ORDER BY place) AS INTEGER) AS version FROM (SELECT DISTINCT item, tx * 10 + line AS place FROM legs)", "legs")
def J19_item_versions(spark, d):
    return joins.item_versions(v.legs(spark, d).select("item", (F.col("tx") * 10 + F.col("line")).alias("place")).distinct(), "item", ["place"])


MATCH = f"""n AS (SELECT tx, token, party, {SIGNED} AS net FROM legs GROUP BY tx, token, party HAVING {SIGNED} <> 0),
p AS (SELECT *, sum(abs(net)) OVER (PARTITION BY tx, token, net > 0 ORDER BY party ROWS UNBOUNDED PRECEDING) AS hi FROM n), t AS (SELECT tx, token, coalesce(sum(-net) FILTER (WHERE net < 0), 0) AS sent, coalesce(sum(net) FILTER (WHERE net > 0), 0) AS got FROM n GROUP BY tx, token),
o AS (SELECT tx, token, party AS sender, hi + net AS a, hi AS b FROM p WHERE net < 0), i AS (SELECT tx, token, party AS receiver, hi - net AS c, hi AS d FROM p WHERE net > 0)"""


@query(f"""WITH {MATCH} SELECT o.tx, o.token, sender, receiver, CAST(least(b, d) - greatest(a, c) AS BIGINT) AS amount FROM o JOIN i ON o.tx = i.tx AND o.token = i.token WHERE a < d AND c < b
UNION ALL SELECT i.tx, i.token, NULL, receiver, CAST(d - greatest(c, sent) AS BIGINT) FROM i JOIN t ON i.tx = t.tx AND i.token = t.token WHERE d > sent
UNION ALL SELECT o.tx, o.token, sender, NULL, CAST(b - greatest(a, got) AS BIGINT) FROM o JOIN t ON o.tx = t.tx AND o.token = t.token WHERE b > got""", "legs")
def J15_match_transfers(spark, d):
    signed = v.legs(spark, d).withColumn("delta", F.when(F.col("side") == "input", -F.col("amount")).otherwise(F.col("amount")))
    return joins.match_transfers(signed, "tx", "token", "party", "delta", io.work_folder(spark))


@query("SELECT tx, line, coalesce(s_name, 'unknown') AS name FROM legs LEFT JOIN supplier ON party = s_suppkey AND s_acctbal > 0", "legs")
def J16_attach_names(spark, d):
    labels = v.read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("party"), F.col("s_name").alias("name"))
    return joins.attach_names(v.legs(spark, d).select("tx", "line", "party"), labels, ["party"], "name").select("tx", "line", "name")


@query("""SELECT r.item, c.outpoint FROM items r JOIN outputs c ON r.item = c.outpoint WHERE r.kind <> 'SMALL' UNION ALL SELECT r.item, c.outpoint FROM items r JOIN outputs c ON r.item = c.party WHERE r.kind = 'SMALL'""", "items", "outputs")
def J17_resolve_code(spark, d):
    refs = v.items(spark, d).select("item", F.when(F.col("kind") == "SMALL", "type").otherwise("data").alias("how"))
    c = v.outputs(spark, d).select("outpoint", F.col("outpoint").alias("data_hash"), F.col("party").alias("type_hash"))
    return joins.resolve_code(refs, c, "item", "how", "data_hash", "type_hash").select("item", "outpoint")


@query("""WITH s AS (SELECT DISTINCT substr(c_name, 1, 17) AS prefix FROM customer), f AS (SELECT substr(c_name, 1, 17) AS prefix, count(DISTINCT c_name) AS matches, min(c_name) AS owner FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT prefix, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CASE WHEN matches = 1 THEN owner END AS owner, CASE WHEN matches IS NULL THEN 'alone' WHEN matches = 1 THEN 'merged' ELSE 'ambiguous' END AS status FROM s LEFT JOIN f USING (prefix)""")
def J18_merge_prefix_parties(spark, d):
    c = v.read(spark, d, "customer")
    short = c.select(F.substring("c_name", 1, 17).alias("prefix")).distinct()
    return joins.merge_prefix_parties(short, c.where("c_acctbal > 9000").select(F.col("c_name").alias("owner")), "prefix", "owner", 17, strict=False)


@query("""WITH e AS (SELECT DISTINCT tx, party FROM legs), s AS (SELECT 1 AS tx), a AS (SELECT DISTINCT party FROM e WHERE tx = 1), b AS (SELECT DISTINCT tx FROM e WHERE party IN (SELECT party FROM a) AND tx <> 1)
SELECT 'tx1' AS node, 0 AS distance UNION ALL SELECT 'p' || party, 1 FROM a UNION ALL SELECT 'tx' || tx, 2 FROM b""", "legs")
def J21_cell_graph(spark, d):
    edges = v.legs(spark, d).select(F.concat(F.lit("tx"), "tx").alias("a"), F.concat(F.lit("p"), "party").alias("b")).distinct()
    seeds = edges.where("a = 'tx1'").select("a").distinct()
    return joins.neighbourhood(edges, seeds, "a", "b", 2)


@query("""SELECT o_orderkey AS height, o_orderstatus AS old_hash, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS new_hash, o_orderkey % 3 = 0 AS differs FROM orders""")
def J24_branch_compare(spark, d):
    o = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_orderstatus").alias("hash"))
    new = o.withColumn("hash", F.when(F.col("height") % 3 == 0, "x").otherwise(F.col("hash")))
    return joins.branch_compare(o, new, "height", "hash")


@query("SELECT outpoint, CASE WHEN outpoint IN (SELECT outpoint FROM inputs) THEN 'committed' WHEN party % 2 = 0 THEN 'pending' ELSE 'dropped' END AS fate FROM outputs", "outputs", "inputs")
def J25_branch_fate(spark, d):
    o = v.outputs(spark, d)
    return joins.branch_fate(o.select("outpoint"), v.inputs(spark, d).select("outpoint"), o.where("party % 2 = 0").select("outpoint"), "outpoint")


@query("SELECT token, arg_min(party, tx * 10 + line) AS party, count(DISTINCT party) > 1 AS conflict FROM (SELECT token, tx, line, min(party) AS party FROM legs GROUP BY token, tx, line) GROUP BY token", "legs")
def J27_bind_token_info(spark, d):
    info = v.legs(spark, d).groupBy("token", (F.col("tx") * 10 + F.col("line")).alias("at")).agg(F.min("party").alias("party"))
    at_tie = info.withColumn("at", F.struct("at", "party"))
    return joins.bind_info(v.legs(spark, d).select("token").distinct(), at_tie, ["token"], "at", "party")


@query("""WITH u AS (SELECT DISTINCT tx, token FROM legs) SELECT g.tx, g.item, p_name AS name, u.token AS supplies FROM (SELECT DISTINCT tx, item FROM legs) g LEFT JOIN part ON item = p_partkey LEFT JOIN u ON u.tx = g.tx AND u.token = p_size % 50""", "legs")
def J28_expand_deps(spark, d):
    cells = v.items(spark, d).select("item", "name", (F.col("size") % 50).alias("token"))
    return joins.expand_deps(v.legs(spark, d), cells, "item", v.legs(spark, d).select("tx", "token"), "tx", "token").select("tx", "item", "name", "supplies")


@query("SELECT outpoint, CAST(capacity // 100 AS VARCHAR) || CASE WHEN capacity % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(capacity % 100 AS VARCHAR), 2, '0'), '0') END AS text FROM outputs", "outputs")
def F04_scale_amount(spark, d):
    return v.outputs(spark, d).select("outpoint", exact.scale_amount("capacity", F.lit(2)).alias("text"))


@query("SELECT outpoint, CAST(capacity // 100000000 AS VARCHAR) || CASE WHEN capacity % 100000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(capacity % 100000000 AS VARCHAR), 8, '0'), '0') END AS coins FROM outputs", "outputs")
def F03_to_coins(spark, d):
    return v.outputs(spark, d).select("outpoint", exact.to_coins("capacity").alias("coins"))


@query("SELECT item, '0x' || lower(to_hex(encode(name))) AS hex, name AS back FROM items", "items")
def F01_hex(spark, d):
    x = v.items(spark, d).withColumn("hex", exact.bytes_to_hex(F.col("name").cast("binary")))
    return x.select("item", "hex", exact.hex_to_bytes("hex").cast("string").alias("back"))


@query("SELECT item, '0x' || sha256(name) AS hash, CAST(size AS INTEGER) AS \"index\" FROM items", "items")
def F02_outpoints(spark, d):
    text = F.concat(F.upper(F.sha2(F.col("name").cast("binary"), 256)), F.lit("#"), F.col("size"))
    x = v.items(spark, d).withColumn("o", exact.parse_outpoint(text))
    return x.select("item", exact.normalize_hash("o.tx_hash").alias("hash"), F.col("o.index").alias("index"))


@query("SELECT page_id, CASE WHEN html LIKE '%http://%' OR html LIKE '%https://%' THEN 'server' ELSE 'none' END AS tier FROM pages")
def F15_media_tier(spark, d):
    return v.read(spark, d, "pages").select("page_id", exact.media_tier("html").alias("tier"))


@query("SELECT collection, max(name) AS name, CAST(max(size) AS BIGINT) AS size, min(kind) AS kind FROM items GROUP BY collection", "items")
def F17_merge_traits(spark, d):
    x = v.items(spark, d).groupBy("collection").agg(F.max("name").alias("n"), F.max("size").alias("s"), F.min("kind").alias("k"))
    one = F.create_map(F.lit("name"), F.lit("?"), F.lit("kind"), F.col("k"))
    two = F.create_map(F.lit("name"), F.col("n"), F.lit("size"), F.col("s").cast("string"))
    m = exact.merge_traits(one, two)
    return x.select("collection", m["name"].alias("name"), m["size"].cast("bigint").alias("size"), m["kind"].alias("kind"))


@query("""WITH t AS (SELECT tx, bool_or(side = 'input' AND token < 10) AS ib, bool_or(side = 'output' AND token < 10) AS ob, bool_or(side = 'input' AND token >= 10 AND token < 20) AS il, bool_or(side = 'output' AND token >= 10 AND token < 20) AS ol, bool_or(side = 'input' AND token >= 20) AS ip, bool_or(side = 'output' AND token >= 20) AS op FROM legs WHERE token < 30 GROUP BY tx)
SELECT tx, action FROM (SELECT tx, CASE WHEN ol THEN 'time_locked' WHEN ib AND ob THEN 'transfer' WHEN ib AND op THEN 'leap_out' WHEN ip AND ob THEN 'leap_in' WHEN il AND op THEN 'receive' WHEN ob THEN 'leap_in' END AS action FROM t) WHERE action IS NOT NULL""", "legs")
def F19_classify_bridge(spark, d):
    t = F.col("token")
    return protocol.classify_bridge(v.legs(spark, d), "tx", "side", t < 10, (t >= 10) & (t < 20), t < 30)


@query("""WITH t AS (SELECT tx, count(*) FILTER (WHERE token < 10 AND side = 'input') AS i, count(*) FILTER (WHERE token < 10 AND side = 'output') AS o, sum(CASE WHEN token < 10 THEN 0 WHEN side = 'output' THEN amount ELSE -amount END) AS x FROM legs GROUP BY tx)
SELECT tx, action FROM (SELECT tx, CASE WHEN i = 0 AND o > 0 THEN 'open' WHEN i > 0 AND o = 0 THEN 'close' WHEN i > 1 AND x < 0 THEN 'redemption' WHEN i > 0 AND x > 0 THEN 'borrow' WHEN i > 0 AND x < 0 THEN 'repay' WHEN i > 0 THEN 'adjust' END AS action FROM t) WHERE action IS NOT NULL""", "legs")
def F21_classify_vault(spark, d):
    return protocol.classify_vault(v.legs(spark, d), "tx", "side", F.col("token") < 10, "amount")


@query("SELECT tx, substr(CAST(party + 1000 AS VARCHAR), 1, 3) AS owner, CASE WHEN bool_or(side = 'input') THEN 'settled' ELSE 'submitted' END AS action FROM legs WHERE token < 5 GROUP BY 1, 2", "legs")
def F22_classify_intent(spark, d):
    return protocol.classify_intent(v.legs(spark, d).withColumn("o", (F.col("party") + 1000).cast("string")), "tx", "side", F.col("token") < 5, "o", 3)


@query("""WITH b AS (SELECT c_custkey AS id, c_nationkey AS owner, CAST(c_acctbal AS BIGINT) AS expiry, CASE WHEN c_custkey % 4 = 0 THEN 'listed' ELSE 'normal' END AS status FROM customer WHERE c_custkey % 10 <> 1),
a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_nationkey END AS owner, CAST(c_acctbal AS BIGINT) + c_custkey % 2 AS expiry, CASE WHEN c_custkey % 5 = 0 THEN 'listed' ELSE 'normal' END AS status FROM customer WHERE c_custkey % 10 <> 7)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'register' WHEN a.id IS NULL THEN 'recycle' WHEN b.status = 'normal' AND a.status = 'listed' THEN 'list' WHEN b.status = 'listed' AND a.status = 'normal' AND a.owner = b.owner THEN 'cancel' WHEN b.status = 'listed' AND a.owner <> b.owner THEN 'buy' WHEN a.expiry > b.expiry THEN 'renew' WHEN a.owner <> b.owner THEN 'transfer' ELSE 'edit' END AS action FROM b FULL JOIN a ON a.id = b.id""")
def F23_classify_name(spark, d):
    c = v.read(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    base = c.select("id", F.col("c_nationkey").alias("owner"), F.round("c_acctbal").cast("bigint").alias("expiry"))
    before = base.where("id % 10 <> 1").withColumn("status", F.when(F.col("id") % 4 == 0, "listed").otherwise("normal"))
    after = base.where("id % 10 <> 7").select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("owner")).alias("owner"), (F.col("expiry") + F.col("id") % 2).alias("expiry"), F.when(F.col("id") % 5 == 0, "listed").otherwise("normal").alias("status"))
    return protocol.classify_name(before, after, ["id"], "owner", "expiry", "status")


FLOW = "f AS (SELECT tx, item, bool_or(side = 'input') AS i, bool_or(side = 'output') AS o FROM legs GROUP BY tx, item), g AS (SELECT tx, item, CASE WHEN i AND o THEN 'kept' WHEN i THEN 'out' ELSE 'in' END AS flow FROM f)"


@query(f"WITH {FLOW} SELECT tx, item, flow FROM g WHERE flow <> 'kept' OR tx NOT IN (SELECT tx FROM g WHERE flow <> 'kept')", "legs")
def F24_name_subjects(spark, d):
    x = v.legs(spark, d)
    return protocol.name_subjects(sets.item_flow(x.where("side = 'input'"), x.where("side = 'output'"), ["tx", "item"]), "tx", "flow")


@query("SELECT outpoint, CASE WHEN request_day IS NULL THEN 'deposit' WHEN complete_day IS NULL THEN 'withdraw_request' ELSE 'complete' END AS action FROM deposits", "deposits")
def F25_savings_actions(spark, d):
    r, c = F.col("request_day").isNotNull(), F.col("complete_day").isNotNull()
    return v.deposits(spark, d).select("outpoint", protocol.savings_action(~c, r, c).alias("action"))


@query("""SELECT coalesce(c.k, l.k) AS "key", coalesce(l.name, c.name) AS name, coalesce(l.size, c.size) AS size, CASE WHEN c.size <> l.size THEN 'size' ELSE '' END AS conflicts FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0) c FULL JOIN (SELECT p_partkey AS k, p_name AS name, p_size + p_partkey % 2 AS size FROM part WHERE p_partkey % 5 <> 0) l ON c.k = l.k""".replace("p_size + p_partkey % 2", "CAST(p_size + p_partkey % 2 AS INTEGER)"))
def F27_merge_metadata(spark, d):
    p = v.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    labels = p.where("key % 5 <> 0").withColumn("size", (F.col("size") + F.col("key") % 2).cast("int"))
    return protocol.merge_metadata(p.where("key % 3 <> 0"), labels, "key", ["name", "size"]).withColumn("conflicts", F.array_join("conflicts", ","))


@query("""SELECT 'part' AS kind, CAST(item AS VARCHAR) AS id, name, lower(name) = 'small ring' AS exact, (SELECT count(*) FROM items WHERE lower(name) = 'small ring') > 1 AS ambiguous FROM items WHERE lower(name) LIKE '%small ring%'""", "items")
def U03_search(spark, d):
    s = v.read(spark, d, "supplier")
    return sets.search("small ring", {"part": (v.items(spark, d), "item", "name"), "supplier": (s, "s_suppkey", "s_name")})


@query("SELECT outpoint, party, 'expected' AS side FROM outputs WHERE outpoint % 50 = 0 UNION ALL SELECT outpoint, party + 1, 'actual' FROM outputs WHERE outpoint % 50 = 0", "outputs")
def U05_diff(spark, d):
    o = v.outputs(spark, d).select("outpoint", "party")
    return sets.diff(o, o.withColumn("party", F.when(F.col("outpoint") % 50 == 0, F.col("party") + 1).otherwise(F.col("party"))))


NONE = 'SELECT CAST(NULL AS VARCHAR) AS "check", CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM orders WHERE 1 = 0'


@query("""SELECT 'unresolved_inputs' AS "check", CAST(outpoint AS VARCHAR) AS key, 'known output' AS expected, CAST(NULL AS VARCHAR) AS actual FROM inputs WHERE outpoint % 100 = 7""", "inputs")
def Q01_unresolved_inputs(spark, d):
    return quality.unresolved_inputs(v.inputs(spark, d), v.outputs(spark, d).where("outpoint % 100 <> 7"), "outpoint")


def live_totals(spark, d):
    return v.outputs(spark, d).join(v.inputs(spark, d), "outpoint", "left_anti").groupBy("party").agg(F.sum("capacity").alias("balance"), F.count(F.lit(1)).alias("live_cells"))


@query(NONE)
def Q03_balances(spark, d):
    stored = A13_address_balance(spark, d).where("live_cells > 0")
    return quality.equal_by_key("balances", stored, live_totals(spark, d), ["party"], ["balance", "live_cells"])


@query(NONE)
def Q06_parts_make_whole(spark, d):
    return quality.parts_make_whole("layers", A49_supply_layers(spark, d), "day", [f"l{k}" for k in range(1, 6)], "whole")


@query(f"""WITH s AS (SELECT token, day, {SIGNED} AS delta FROM legs GROUP BY token, day), t AS (SELECT token, day, CAST(sum(delta) OVER (PARTITION BY token ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s) SELECT 'negative_total_delta' AS "check", CAST(token AS VARCHAR) AS key, '>= 0' AS expected, CAST(total AS VARCHAR) AS actual FROM t WHERE total < 0""", "legs")
def Q07_negative_state(spark, d):
    return quality.negative_state(W01_running_total(spark, d), "token", ["total_delta"])


@query("""WITH e AS (SELECT type, created_day AS day, CAST(sum(capacity) AS BIGINT) AS c FROM outputs GROUP BY 1, 2), f AS (SELECT min(day) AS day FROM (SELECT created_day AS day FROM cells WHERE type = '5-LOW')), n AS (SELECT CAST(sum(capacity) FILTER (WHERE created_day <= (SELECT day FROM f) AND (consumed_day IS NULL OR consumed_day > (SELECT day FROM f))) AS BIGINT) AS c FROM cells WHERE type = '5-LOW')
SELECT 'entity_daily' AS "check", '5-LOW/' || day AS key, '{"capacity":' || n.c || '}' AS expected, '{"capacity":' || (n.c + 1) || '}' AS actual FROM f, n""", "cells", "outputs")
def Q09_entity_history(spark, d):
    """The stored history (signed events, one running sum) against what was created less what was consumed, summed apart: daily, at a
    day in the middle, and now. The stored row of the first day of one type is off by one."""
    c = v.cells(spark, d)
    stored = A52_composition_daily(spark, d)
    first = stored.where("type = '5-LOW'").agg(F.min("day").alias("_first"))
    off = (F.col("type") == "5-LOW") & (F.col("day") == F.col("_first"))
    stored = stored.join(F.broadcast(first)).select("type", "day", (F.col("capacity") + F.when(off, 1).otherwise(0)).alias("capacity"))
    sums = ledger.sum_facts([c.groupBy("type", F.col("created_day").alias("day")).agg(F.sum("capacity").alias("made")), c.where("consumed_day IS NOT NULL").groupBy("type", F.col("consumed_day").alias("day")).agg(F.sum("capacity").alias("used"))], ["type", "day"])
    again = series.running_total(sums, ["type"], "day", "made", "used").select("type", "day", (F.col("total_made") - F.col("total_used")).alias("capacity"))
    daily = quality.equal_by_key("entity_daily", again, stored, ["type", "day"], ["capacity"])
    middle = c.agg(F.date_add(F.min("created_day"), (F.datediff(F.max("created_day"), F.min("created_day")) / 2).cast("int")).alias("_day"))
    alive = (F.col("created_day") <= F.col("_day")) & (F.col("consumed_day").isNull() | (F.col("consumed_day") > F.col("_day")))
    then = c.join(F.broadcast(middle)).groupBy("type").agg(F.sum(F.when(alive, F.col("capacity")).otherwise(0)).alias("capacity"))
    held = stored.join(F.broadcast(middle)).where(F.col("day") <= F.col("_day")).groupBy("type").agg(F.max_by("capacity", "day").alias("capacity"))
    now = c.groupBy("type").agg(F.sum(F.when(F.col("consumed_day").isNull(), F.col("capacity")).otherwise(0)).alias("capacity"))
    last = stored.groupBy("type").agg(F.max_by("capacity", "day").alias("capacity"))
    return daily.union(quality.equal_by_key("entity_prefix", then, held, ["type"], ["capacity"])).union(quality.equal_by_key("entity_current", now, last, ["type"], ["capacity"]))


@query(NONE)
def Q10_lifecycle_cells(spark, d):
    a = v.deposits(spark, d).where("request_day IS NULL").select("outpoint", "capacity")
    return quality.equal_by_key("lifecycle", a, J02_live_set(spark, d).select("outpoint", "capacity"), ["outpoint"], ["capacity"])


@query(f"""WITH {RANKED}, s AS (SELECT count(*) AS n, max(position) AS hi, CAST(sum(capacity) AS BIGINT) AS c FROM ranked WHERE position <> 10), w AS (SELECT CAST(sum(capacity) AS BIGINT) AS c FROM outputs)
SELECT 'ranks_complete' AS "check", 'ranking' AS key, '1..' || n AS expected, '1..' || hi AS actual FROM s WHERE n <> hi UNION ALL SELECT 'ranking_sum', 'ranking', CAST(w.c AS VARCHAR), CAST(s.c AS VARCHAR) FROM s, w WHERE w.c <> s.c""", "outputs")
def Q11_ranking(spark, d):
    """A ranking that lacks its tenth row: places aren't 1..n, and it doesn't sum to the whole."""
    return quality.ranks_complete(W07_rank(spark, d).where("position <> 10"), "position", "capacity", v.outputs(spark, d).agg(F.sum("capacity")))


@query(NONE)
def Q12_collection_activity(spark, d):
    """Each (token, transaction) is one action of one day."""
    daily = A30_collection_activity_daily(spark, d).groupBy("token").agg(F.sum(sum((F.col(a) for a in ITEM_ACTIONS), F.lit(0))).alias("n"))
    pairs = v.legs(spark, d).select("token", "tx").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return quality.equal_by_key("collection_activity", pairs, daily, ["token"], ["n"])


@query("""SELECT 'token_counts' AS "check", '9' AS key, '{"cells":' || n || '}' AS expected, '{"cells":' || (n + 2) || '}' AS actual FROM (SELECT count(*) AS n FROM legs WHERE token = 9) WHERE n > 0""", "legs")
def Q13_token_counts(spark, d):
    """Stored counts of tokens, one of them too high, against the rows themselves."""
    a = A22_token_summary(spark, d).select("token", (F.col("cells") + F.when(F.col("token") == 9, 2).otherwise(0)).alias("cells"))
    return quality.equal_by_key("token_counts", v.legs(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("cells")), a, ["token"], ["cells"])


@query("""SELECT DISTINCT 'senders' AS "check", tx || '/' || party AS key, '{"n":1}' AS expected, CAST(NULL AS VARCHAR) AS actual FROM legs WHERE side = 'input' AND tx % 70 = 5""", "legs")
def Q14_senders(spark, d):
    """Sender tags of the parties, which some transactions lack, against the inputs they spend."""
    flags = v.legs(spark, d).groupBy("tx", "party").agg(F.max(ledger.party_tags(sender=(F.col("side") == "input") & (F.col("tx") % 70 != 5))).alias("tags"))
    a = flags.where(ledger.has_tag("tags", "sender")).select("tx", "party", F.lit(1).alias("n"))
    return quality.equal_by_key("senders", v.legs(spark, d).where("side = 'input'").select("tx", "party", F.lit(1).alias("n")).distinct(), a, ["tx", "party"], ["n"])


@query(NONE)
def Q15_recognized(spark, d):
    a = v.legs(spark, d).where("token < 30").groupBy("tx").agg(F.count_distinct("token").alias("types"))
    return quality.equal_by_key("recognized", a, P15_recognized_types(spark, d).select("tx", "types"), ["tx"], ["types"])


@query("""SELECT 'linked_ring' AS "check", CAST(c_custkey AS VARCHAR) AS key, '1' AS expected, '0' AS actual FROM customer WHERE c_custkey = 11 UNION ALL SELECT 'linked_ring', '12', '1', '2'""")
def Q16_linked_ring(spark, d):
    ids = v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    ring = ids.join(ids.select((F.col("id") - 1).alias("id"), F.col("id").alias("next")), "id", "left")
    first = ids.agg(F.min("id").alias("_first"))
    ring = ring.join(F.broadcast(first)).select("id", F.when(F.col("id") == 10, 12).otherwise(F.coalesce("next", "_first")).alias("next"))
    return quality.linked_ring(ring, "id", "next")


@query("""SELECT 'hash_matches' AS "check", sha256(CASE WHEN item % 100 = 5 THEN name || 'x' ELSE name END) AS key, sha256(name) AS expected, sha256(name || 'x') AS actual FROM items WHERE item % 100 = 5""", "items")
def Q17_hash_matches(spark, d):
    """Stored ids, of which some were made from another label, against the hash of the label."""
    stored = v.items(spark, d).select("item", F.sha2(F.concat("name", F.when(F.col("item") % 100 == 5, "x").otherwise("")).cast("binary"), 256).alias("id"))
    both = stored.join(v.items(spark, d).select("item", F.sha2(F.col("name").cast("binary"), 256).alias("hashed")), "item")
    return quality.hash_matches(both, "id", "hashed")


@query(f"""WITH h AS (SELECT token, party, {SIGNED} AS held FROM legs GROUP BY token, party), n AS (SELECT token, count(*) FILTER (WHERE held > 0) AS n FROM h GROUP BY token)
SELECT 'holder_rows' AS "check", '3' AS key, '{{"holders":' || n || '}}' AS expected, '{{"holders":' || (n + 1) || '}}' AS actual FROM n WHERE token = 3""", "legs")
def Q18_owner_counts(spark, d):
    """Live cells by owner along two paths, and rows of holders against their stored count, which is off by one for one token."""
    a = v.cells(spark, d).where("consumed_day IS NULL").groupBy("party").agg(F.count(F.lit(1)).alias("live_cells"))
    owners = quality.equal_by_key("owner_counts", a, live_totals(spark, d).select("party", "live_cells"), ["party"], ["live_cells"])
    rows = ledger.signed_deltas(v.legs(spark, d), ["token", "party"], "side", "amount").groupBy("token").agg(F.count_if(F.col("delta") > 0).alias("holders"))
    stored = A22_token_summary(spark, d).select("token", (F.col("holders") + F.when(F.col("token") == 3, 1).otherwise(0)).alias("holders"))
    return owners.union(quality.equal_by_key("holder_rows", rows, stored, ["token"], ["holders"]))


@query(NONE)
def Q19_two_way_index(spark, d):
    x = v.legs(spark, d)
    by_item = series.held_since(x.select("item", F.struct("tx", "line", "party").alias("at"), "party"), "item", "at", "party").select("party", "item", F.lit(1).alias("n"))
    by_party = x.groupBy("item").agg(F.max_by("party", F.struct("tx", "line", "party")).alias("party")).select("party", "item", F.lit(1).alias("n"))
    return quality.equal_by_key("two_way_index", by_party, by_item, ["party", "item"], ["n"])


@query("""WITH c AS (SELECT miner, count(*) AS n, count(*) FILTER (WHERE number % 50 <> 7) AS m FROM blocks GROUP BY miner) SELECT 'miner_rows' AS "check", CAST(miner AS VARCHAR) AS key, '{"n":' || n || '}' AS expected, CASE WHEN m > 0 THEN '{"n":' || m || '}' END AS actual FROM c WHERE n <> m""", "blocks")
def Q20_miner_rows(spark, d):
    """Blocks of each miner against the cellbase transactions of its blocks; some blocks have lost theirs."""
    b = v.blocks(spark, d)
    cellbase = v.txs(spark, d).where("tx_index = 0 AND block % 50 <> 7").select(F.col("block").alias("number"))
    found = cellbase.join(b.select("number", "miner"), "number").groupBy("miner").agg(F.count(F.lit(1)).alias("n"))
    return quality.equal_by_key("miner_rows", b.groupBy("miner").agg(F.count(F.lit(1)).alias("n")), found, ["miner"], ["n"])


@query("""WITH s AS (SELECT created_day AS day, CAST(count(*) AS DOUBLE) AS n FROM outputs GROUP BY created_day), l AS (SELECT max(day) AS last FROM s) SELECT 'within_tolerance' AS "check", CAST(day AS VARCHAR) AS key FROM s, l WHERE date_diff('day', day, last) < 30 AND date_part('day', day) % 9 = 0""", "outputs")
def Q21_external_series(spark, d):
    theirs = v.outputs(spark, d).groupBy(F.col("created_day").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ours = theirs.withColumn("n", F.when(F.dayofmonth("day") % 9 == 0, F.col("n") * 1.5).otherwise(F.col("n")))
    return quality.within_tolerance(ours, theirs, "day", "n", 0.01).select("check", "key")


@query("""SELECT 'explorer' AS "check", CAST(outpoint AS VARCHAR) AS key, 'capacity' AS field, 'critical' AS severity, CAST(capacity AS VARCHAR) AS ours, CAST(capacity + 1 AS VARCHAR) AS theirs FROM outputs WHERE outpoint % 200 = 1""", "outputs")
def Q22_explorer_rows(spark, d):
    o = v.outputs(spark, d).select("outpoint", "capacity", "party")
    theirs = o.withColumn("capacity", F.when(F.col("outpoint") % 200 == 1, F.col("capacity") + 1).otherwise(F.col("capacity")))
    return quality.compare_rows("explorer", o, theirs, "outpoint", {"capacity": "critical", "party": "major"})


@query("""SELECT 'script_figures' AS "check", '5-LOW' AS key, '{"cells":' || n || ',"live_cells":' || l || '}' AS expected, '{"cells":' || n || ',"live_cells":' || (l - 1) || '}' AS actual FROM (SELECT count(*) AS n, count(*) FILTER (WHERE consumed_day IS NULL) AS l FROM cells WHERE type = '5-LOW') WHERE n > 0""", "cells")
def Q23_script_figures(spark, d):
    """Stored figures of type scripts, one of them too low, against outputs and the live set, counted apart."""
    off = F.when(F.col("script") == "5-LOW", 1).otherwise(0)
    a = usage(spark, d).where("role = 'type'").select("script", "cells", (F.col("live_cells") - off).alias("live_cells"))
    every = v.outputs(spark, d).groupBy(F.col("type").alias("script")).agg(F.count(F.lit(1)).alias("cells"))
    live = J02_live_set(spark, d).groupBy(F.col("type").alias("script")).agg(F.count(F.lit(1)).alias("live_cells"))
    again = every.join(live, "script", "left").withColumn("live_cells", F.coalesce("live_cells", F.lit(0)))
    return quality.equal_by_key("script_figures", again, a, ["script"], ["cells", "live_cells"])


@query("""SELECT 'only_code' AS "check", CAST(item AS VARCHAR) AS key, '7F454C46' AS expected, upper(to_hex(encode(substr(name, 1, 4)))) AS actual FROM items""", "items")
def Q24_only_code(spark, d):
    return quality.only_code(v.items(spark, d).withColumn("data", F.col("name").cast("binary")), "item", "data")


@query("""SELECT 'code_cells' AS "check", type || '/' || outpoint AS key, '{"found":true}' AS expected, CAST(NULL AS VARCHAR) AS actual FROM cells WHERE consumed_day IS NULL AND outpoint % 5 = 0 AND outpoint % 20 = 10""", "cells")
def Q25_code_cells(spark, d):
    """An index of live code cells by type, which lacks some, against a scan of the live set for cells whose data is code."""
    index = v.cells(spark, d).where("consumed_day IS NULL AND outpoint % 5 = 0 AND outpoint % 20 <> 10").select("type", "outpoint", F.lit(True).alias("found"))
    data = F.when(F.col("outpoint") % 5 == 0, F.concat(F.lit(b"\x7fELF"), F.col("type").cast("binary"))).otherwise(F.col("type").cast("binary"))
    scan = J02_live_set(spark, d).where(ledger.is_code_cell(data)).select("type", "outpoint", F.lit(True).alias("found"))
    return quality.equal_by_key("code_cells", scan, index, ["type", "outpoint"], ["found"])
