"""Predicates and aggregates of a ledger (P07-P25, A01-A72) as functions of a DataFrame and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Predicates.


def by_script(cells: DataFrame, code_hash: str, hash_type: str, role: str = "lock") -> DataFrame:
    """Cells whose lock or type is the script (code hash, hash type)."""
    return cells.where((F.col(f"{role}_code_hash") == code_hash) & (F.col(f"{role}_hash_type") == hash_type))


def live_cells(cells: DataFrame, consumed: str, **equals) -> DataFrame:
    """Live cells with the given column values (P08); cells is the result of joins.cell_state()."""
    out = cells.where(F.col(consumed).isNull())
    for column, value in equals.items():
        out = out.where(F.col(column) == value)
    return out


def is_code_cell(data: str | Column) -> Column:
    """Data that starts with the ELF magic number."""
    return F.coalesce(F.hex(F.substring(_c(data), 1, 4)) == "7F454C46", F.lit(False))


def cell_class(savings: Column, type_: Column) -> Column:
    """savings, typed or plain (P10)."""
    return F.when(savings, "savings").when(type_.isNotNull(), "typed").otherwise("plain")


def holding_class(cells: DataFrame, registry: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Each cell's class for its owner from a registry (key, kind) of types; plain without a type, other if unknown."""
    found = cells.join(registry.select(key, kind), key, "left")
    return found.withColumn("holding", F.when(F.col(key).isNull(), "plain").otherwise(F.coalesce(kind, F.lit("other"))))


#: Bits of a party's tags.
TAGS = {"token": 1, "object": 2, "identity": 4, "savings": 8, "protocol": 16, "cellbase": 32, "type_call": 64, "lock_call": 128, "sender": 256}


def party_tags(**flags: str | Column) -> Column:
    """Bitmask of the named flags."""
    out = F.lit(0)
    for name, flag in flags.items():
        out = out.bitwiseOR(F.when(_c(flag), TAGS[name]).otherwise(0))
    return out


def has_tag(mask: str | Column, name: str) -> Column:
    return _c(mask).bitwiseAND(F.lit(TAGS[name])) != 0


def first_kind(*rules: tuple[str, Column], other: str = "other") -> Column:
    """The first rule that holds names the kind: each row is in one kind, by precedence."""
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise(other)


def match_activity(df: DataFrame, mask: str, actions: str, wanted: str) -> DataFrame:
    """Activities of a party by a tag, or by "protocol:name" among an array of actions."""
    kind, _, name = wanted.partition(":")
    return df.where(F.exists(actions, lambda a: a == name)) if kind == "protocol" and name else df.where(has_tag(mask, kind))


def recognized_types(cells: DataFrame, registry: DataFrame, tx: str, key: str) -> DataFrame:
    """Known types of each transaction, sorted."""
    return cells.join(registry.select(key).distinct(), key, "left_semi").groupBy(tx).agg(F.array_sort(F.collect_set(key)).alias("types"))


def script_calls(cells: DataFrame, registry: DataFrame, tx: str, key: str) -> DataFrame:
    """Distinct unknown scripts of each transaction."""
    return cells.where(F.col(key).isNotNull()).join(registry.select(key), key, "left_anti").select(tx, key).distinct()


def composition_tier(counts: dict[str, str]) -> Column:
    """The weakest tier that a collection has items of; counts name columns from strongest to weakest."""
    out = F.lit("empty")
    for tier, column in counts.items():
        out = F.when(F.col(column) > 0, tier).otherwise(out)
    return out


def expiry_state(live: str | Column, expiry: str | Column, grace: int, now: int) -> Column:
    """recycled, active, grace or free."""
    return F.when(~_c(live), "recycled").when(_c(expiry) > now, "active").when(_c(expiry) + grace > now, "grace").otherwise("free")


def parse_scope(query: str) -> tuple[str | None, str]:
    """("scope", rest) of a search text such as "tx:0xab"; the scope is None if there's none of the known."""
    head, colon, rest = query.strip().partition(":")
    known = {"block", "tx", "addr", "cell", "script", "token", "asset"}
    return (head.lower(), rest.strip()) if colon and head.lower() in known else (None, query.strip())


def items_of(df: DataFrame, owner: str, who) -> DataFrame:
    """The rows of an owner, or the children of a parent name."""
    return df.where(F.col(owner) == who)


def groups_of(membership: DataFrame, group: str, member: str, who) -> DataFrame:
    """What a party takes part in, each once, looked up in a table of (member, group) rows (P24): only the party's own rows are read on."""
    return items_of(membership, member, who).select(group).distinct()


def name_match(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in one of the columns, case ignored (P20)."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return df.where(hit)


def has_traits(traits: DataFrame, item: str, wanted: dict[str, str], name: str = "name", value: str = "value") -> DataFrame:
    """Items with every wanted name and value (P21); traits has one row each."""
    hit = F.lit(False)
    for n, v in wanted.items():
        hit = hit | ((F.col(name) == n) & (F.col(value) == v))
    return traits.where(hit).groupBy(item).agg(F.count_distinct(name).alias("_n")).where(F.col("_n") == len(wanted)).select(item)


def pool_of(blocks: DataFrame, by_lock: DataFrame, by_message: DataFrame, lock: str, message: str, strict: bool = True) -> DataFrame:
    """Name of each block's pool by exact lock, else by message prefix (P22). Names of both that differ are an error, or,
    if not strict, a row without pool whose conflict is true.

    Prefixes are joined by their length and text, so that the join has a key.
    """
    named = blocks.join(by_lock.select(lock, F.col("pool").alias("_a")), lock, "left")
    lengths = sorted(r[0] for r in by_message.select(F.length("prefix")).distinct().collect())  # of label prefixes
    heads = F.array(*(F.substring(F.col(message), 1, n) for n in lengths)) if lengths else F.array().cast("array<string>")
    key = blocks.columns
    hits = blocks.select(*key, F.explode(F.array_distinct(heads)).alias("prefix")).join(by_message.select("prefix", F.col("pool").alias("_b")), "prefix")
    hits = hits.groupBy(message).agg(F.max_by("_b", F.length("prefix")).alias("_b"))  # the longest prefix
    named = named.join(hits, message, "left")
    clash = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))
    wrong = F.raise_error(F.lit("two pools for one block")).cast("string") if strict else F.lit(None).cast("string")
    out = named.withColumn("pool", F.when(clash, wrong).otherwise(F.coalesce("_a", "_b")))
    return (out if strict else out.withColumn("conflict", clash)).select(*key, "pool", *(() if strict else ("conflict",)))


def proposal_state(proposed: str | Column, committed: str | Column, tip: int, closest: int, farthest: int) -> Column:
    """committed, early, waiting or expired."""
    p = _c(proposed)
    return F.when(_c(committed).isNotNull(), "committed").when(p + closest > tip, "early").when(p + farthest >= tip, "waiting").otherwise("expired")


def peer_state(reachable: Column, last_seen: Column, now: Column, stale: int) -> Column:
    """online, unreachable or stale (P25)."""
    return F.when(now - last_seen > stale, "stale").when(reachable, "online").otherwise("unreachable")


# Aggregates.


def totals(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """One row per key with named aggregates; the shape of A01-A03, A13, A16, A22, A30, A32, A36 and others."""
    return df.groupBy(*keys).agg(*(m.alias(n) for n, m in measures.items()))


def share(df: DataFrame, keys: list[str], group: list[str], measure: str, places: int = 3) -> DataFrame:
    """Sum per key and its share in the group as percent text, cut."""
    part = df.groupBy(*group, *keys).agg(F.sum(measure).alias("part"))
    whole = F.sum("part").over(Window.partitionBy(*group)) if group else None
    if whole is None:
        return part.join(F.broadcast(part.agg(F.sum("part").alias("whole")))).withColumn("share", exact.ratio_cut("part", "whole", places))
    return part.withColumn("whole", whole).withColumn("share", exact.ratio_cut("part", "whole", places))


def last_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The rows of the last n complete groups of a rising number, such as epochs: all but the newest are complete (A10)."""
    tip = df.agg(F.max(group).alias("_tip"))
    return df.join(F.broadcast(tip)).where((F.col(group) < F.col("_tip")) & (F.col(group) >= F.col("_tip") - n)).drop("_tip")


def miner_share(blocks: DataFrame, day: str, miner: str, reward: str, days: int = 7) -> DataFrame:
    """Blocks and reward of each miner per day, and its share of the blocks of the last complete days, cut."""
    daily = blocks.groupBy(day, miner).agg(F.count(F.lit(1)).alias("blocks"), F.sum(reward).alias("reward"))
    tip = daily.agg(F.max(day).alias("_tip"))
    recent = daily.join(F.broadcast(tip)).where((F.col(day) < F.col("_tip")) & (F.col(day) >= F.date_sub("_tip", days)))
    part = recent.groupBy(miner).agg(F.sum("blocks").alias("week_blocks"))
    whole = part.agg(F.sum("week_blocks").alias("_whole"))
    return daily.join(part, miner, "left").join(F.broadcast(whole)).select(day, miner, "blocks", "reward", "week_blocks", exact.ratio_cut("week_blocks", "_whole").alias("share"))


def sum_facts(facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Daily facts of several tables as one row per key (A01): measures are summed, 0 where a table has no row."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return both.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns if c not in keys))


def interval_histogram(df: DataFrame, value: str, width: int, most: int, places: int = 3) -> DataFrame:
    """Counts of value div width for 0..most div width (all longer ones in the last), zero-filled, with shares cut."""
    last = most // width
    counted = df.groupBy(F.least(F.floor(F.col(value) / width), F.lit(last)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    every = df.sparkSession.range(0, last + 1).withColumnRenamed("id", "bucket")
    return every.join(counted, "bucket", "left").join(F.broadcast(whole)).select("bucket", F.coalesce("n", F.lit(0)).alias("n"), exact.ratio_cut(F.coalesce("n", F.lit(0)), "whole", places).alias("share"))


def new_by_day(df: DataFrame, entity: str, day: str) -> DataFrame:
    """How many entities are first seen on each day."""
    return df.groupBy(entity).agg(F.min(day).alias(day)).groupBy(day).agg(F.count(F.lit(1)).alias("new"))


def signed_deltas(legs: DataFrame, keys: list[str], side: str, amount: str, source: str = "input", **more: str) -> DataFrame:
    """Net amount per key, and of more columns under their names: outputs less inputs (A17, A18); zero is kept, filter it for item deltas."""
    net = lambda c: F.sum(F.when(F.col(side) == source, -F.col(c)).otherwise(F.col(c)))
    return legs.groupBy(*keys).agg(*(net(c).alias(n) for n, c in {"delta": amount, **more}.items()))


def value_moved(deltas: DataFrame, tx: str, delta: str) -> DataFrame:
    """Sum of the positive deltas of each transaction."""
    return deltas.groupBy(tx).agg(F.sum(F.greatest(F.col(delta), F.lit(0))).alias("moved"))


def kind_counts(df: DataFrame, bucket: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows of each kind per bucket, one column a kind."""
    return df.groupBy(bucket).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def active_parties(df: DataFrame, bucket: str, party: str) -> DataFrame:
    """Exact number of distinct parties per bucket (A21): two aggregates, so no bucket gathers its parties in one task."""
    return df.select(bucket, party).where(F.col(party).isNotNull()).distinct().groupBy(bucket).agg(F.count(F.lit(1)).alias("parties"))


def token_summary(balances: DataFrame, token: str, party: str, amount: str) -> DataFrame:
    """Live supply and holders per token (A22), from sums per (token, party)."""
    held = balances.groupBy(token, party).agg(F.sum(amount).alias("_held"), F.count(F.lit(1)).alias("_cells"))
    return held.groupBy(token).agg(F.sum("_held").alias("supply"), F.count_if(F.col("_held") > 0).alias("holders"), F.sum("_cells").alias("cells"))


def holder_distribution(held: DataFrame, key: str, amount: str, bands: int = 7) -> DataFrame:
    """Holders and amount per band of powers of ten (A27): band k holds 10^k <= amount < 10^(k+1), the last all above."""
    digits = F.length(F.col(amount).cast("decimal(38,0)").cast("string")) - 1
    return held.where(F.col(amount) > 0).groupBy(key, F.least(digits, F.lit(bands - 1)).alias("band")).agg(F.count(F.lit(1)).alias("holders"), F.sum(amount).alias("amount"))


def top_holders(held: DataFrame, key: str, owner: str, amount: str) -> DataFrame:
    """Amount of the first holder, the next nine and the rest per key (A27): only ten rows of a key are ever ranked in one place."""
    some = held.where(F.col(amount) > 0)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(amount), owner))
    best = some.withColumn("_n", place).where(F.col("_n") <= 10).groupBy(key).agg(
        F.sum(F.when(F.col("_n") == 1, F.col(amount)).otherwise(0)).alias("top_1"), F.sum(F.when(F.col("_n") > 1, F.col(amount)).otherwise(0)).alias("next_9")
    )
    return some.groupBy(key).agg(F.sum(amount).alias("_all")).join(best, key).select(key, "top_1", "next_9", (F.col("_all") - F.col("top_1") - F.col("next_9")).alias("rest"))


def count_of_counts(df: DataFrame, group: str, owner: str) -> DataFrame:
    """How many owners of a group hold n rows of it."""
    return df.groupBy(group, owner).agg(F.count(F.lit(1)).alias("held")).groupBy(group, "held").agg(F.count(F.lit(1)).alias("owners"))


def trait_distribution(traits: DataFrame, item: str, name: str, value: str) -> DataFrame:
    """Items per trait value, each item once."""
    return traits.select(item, name, value).distinct().groupBy(name, value).agg(F.count(F.lit(1)).alias("items"))


def decoded_trait_distribution(items: DataFrame, traits: DataFrame, group: str, item: str, decoded: str, name: str, value: str) -> DataFrame:
    """Items per trait value of each group, only for groups whose items are all decoded."""
    whole = items.groupBy(group).agg(F.min(decoded).alias("_all")).where("_all").select(group)
    known = items.select(group, item).join(whole, group)
    return traits.select(item, name, value).distinct().join(known, item).groupBy(group, name, value).agg(F.count(F.lit(1)).alias("items"))


def item_action(before_owner: str | Column, after_owner: str | Column, before_term: str | Column, after_term: str | Column, expired: Column) -> Column:
    """mint, transfer, renew, update, recycle or burn of an item from its owner and term before and after, null where it doesn't exist."""
    old, new = _c(before_owner), _c(after_owner)
    return (
        F.when(old.isNull(), "mint").when(new.isNull() & expired, "recycle").when(new.isNull(), "burn").when(old != new, "transfer").when(_c(after_term) > _c(before_term), "renew").otherwise("update")
    )


def collection_summary(items: DataFrame, holdings: DataFrame, collection: str, item: str, owner: str, tiers: dict[str, Column]) -> DataFrame:
    """Items, live items (those that someone holds), owners and items of each tier per collection (A32); holdings has rows (item, owner)."""
    counts = items.groupBy(collection).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(rule).alias(name) for name, rule in tiers.items()))
    held = items.select(collection, item).join(holdings.select(item, owner), item)
    live = held.select(collection, item).distinct().groupBy(collection).agg(F.count(F.lit(1)).alias("live"))
    owners = held.select(collection, owner).distinct().groupBy(collection).agg(F.count(F.lit(1)).alias("owners"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(live, collection, "left").join(owners, collection, "left").select(collection, "total", zero("live"), zero("owners"), *tiers)


def actions_of(created: str | Column, consumed: str | Column) -> Column:
    """transfer, mint or burn from what a transaction creates and consumes."""
    return F.when(_c(created) & _c(consumed), "transfer").when(_c(created), "mint").when(_c(consumed), "burn")


def script_usage(cells: DataFrame, roles: dict[str, str], live: str, capacity: str, occupied: str) -> DataFrame:
    """Cells, live cells, and live capacity and occupied part per script and role (A34); each cell counts once for its lock and once for its type."""
    pairs = F.array(*(F.struct(F.lit(role).alias("role"), F.col(column).cast("string").alias("script")) for role, column in roles.items()))
    used = cells.select(F.inline(pairs), live, capacity, occupied).where(F.col("script").isNotNull())
    alive = lambda c: F.sum(F.when(F.col(live), F.col(c)).otherwise(0))
    return used.groupBy("role", "script").agg(F.count(F.lit(1)).alias("cells"), F.count_if(live).alias("live_cells"), alive(capacity).alias("live_capacity"), alive(occupied).alias("live_occupied"))


def block_fee_stats(txs: DataFrame, block: str, fee: str, size: str, cellbase: str) -> DataFrame:
    """Count and size per block, and the least, greatest and mean fee rate of its transactions but the cellbase.

    least and greatest are (fee, size) of the transaction: a decimal quotient with more digits than two sizes can differ by
    orders the rates. The mean is that of the rates, not weighted, and exact before it is cut. Without other transactions all three are null.
    """
    from ..functions.udf import rational_mean

    rate = (F.col(fee).cast("decimal(18,0)") * F.lit(1_000_000_000_000).cast("decimal(13,0)")).cast("decimal(38,0)") / F.col(size).cast("decimal(10,0)")
    paid = F.when(~F.col(cellbase), rate)
    stats = txs.groupBy(block).agg(F.count(F.lit(1)).alias("txs"), F.sum(size).alias("size"), F.min_by(F.struct(fee, size), paid).alias("least"), F.max_by(F.struct(fee, size), paid).alias("most"))
    return stats.join(rational_mean(txs.where(~F.col(cellbase)), block, fee, size), block, "left")


def concentration(df: DataFrame, measure: str, key: str, tops: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Shares of the n greatest in the whole, cut (A46); only the greatest of all tops are ranked."""
    best = df.orderBy(F.desc(measure), key).limit(max(tops)).withColumn("_n", F.row_number().over(Window.orderBy(F.desc(measure), key)))
    sums = best.agg(*(F.sum(F.when(F.col("_n") <= n, F.col(measure)).otherwise(0)).alias(f"sum_{n}") for n in tops)).join(df.agg(F.sum(measure).alias("whole")))
    return sums.select("whole", *(exact.ratio_cut(f"sum_{n}", "whole").alias(f"top_{n}") for n in tops))


def savings_stats(deposits: DataFrame, capacity: str, owner: str, requested: str, completed: str, age: str, gain: str) -> DataFrame:
    """Deposited, waiting for withdrawal, counts, depositors, and average age and compensation of the active deposits.

    age and gain are columns of each deposit at the time asked for; the average is cut.
    """
    active, waiting = F.col(requested).isNull() & F.col(completed).isNull(), F.col(requested).isNotNull() & F.col(completed).isNull()
    return deposits.agg(
        F.sum(F.when(active, F.col(capacity)).otherwise(0)).alias("deposited"),
        F.sum(F.when(waiting, F.col(capacity)).otherwise(0)).alias("waiting"),
        F.count_if(active).alias("active_deposits"),
        F.count_distinct(F.when(active, F.col(owner))).alias("depositors"),
        exact.int_div(F.sum(F.when(active, F.col(age))), F.nullif(F.count_if(active), F.lit(0))).alias("average_age"),
        F.coalesce(F.sum(F.when(active, F.col(gain))), F.lit(0)).alias("compensation"),
    )


def compensation_split(deposits: DataFrame, requested: str, completed: str, gain: str) -> DataFrame:
    """Compensation that runs on (active), is fixed by a request (frozen), was paid out (claimed), and was not yet (unclaimed)."""
    active, done = F.col(requested).isNull() & F.col(completed).isNull(), F.col(completed).isNotNull()
    part = lambda rule: F.coalesce(F.sum(F.when(rule, F.col(gain))), F.lit(0))
    return deposits.agg(part(active).alias("active"), part(~active & ~done).alias("frozen"), part(done).alias("claimed"), part(~done).alias("unclaimed"))


def size_bands(value: str | Column, bounds: list[int]) -> Column:
    """Index of the band that a value falls in; bounds are the lower ends of the bands after the first."""
    return sum((F.when(_c(value) >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def channel_stats(channels: DataFrame, state: str, token: str, capacity: str, life: str, short: int) -> DataFrame:
    """Counts, capacity, lower median life (exact) and lives of at most `short`, by state and by (state, token).

    Rows of a whole state have a null token. A channel that is still open has a null life.
    """
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{life}`)").cast(channels.schema[life].dataType)
    grouped = channels.rollup(state, token).agg(
        F.count(F.lit(1)).alias("channels"), F.sum(capacity).alias("capacity"), median.alias("median_life"), F.count_if(F.col(life) <= short).alias("short_lives"), F.grouping_id().alias("_level")
    )
    return grouped.where("_level < 3").drop("_level")


def pair_counts(df: DataFrame, a: str, b: str, measure: str, first: str) -> DataFrame:
    """Counts, sum, first and last time per unordered pair."""
    return df.groupBy(F.least(a, b).alias("one"), F.greatest(a, b).alias("two")).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"), F.min(first).alias("first"), F.max(first).alias("last"))


def party_counts(df: DataFrame, a: str, b: str, measure: str, time: str) -> DataFrame:
    """Counts, sum, first and last time per party, on either end."""
    ends = df.select(F.explode(F.array_distinct(F.array(a, b))).alias("party"), measure, time)
    return ends.groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"), F.min(time).alias("first"), F.max(time).alias("last"))


def distribution(df: DataFrame, label: str, flag: str) -> DataFrame:
    """Rows per label and how many have the flag."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))


def two_levels(df: DataFrame, upper: str, lower: str) -> DataFrame:
    """Counts of both levels; lower is null in the rows of the upper level."""
    return df.rollup(upper, lower).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level")).where("_level < 3").drop("_level")


def top_and_rest(df: DataFrame, label: str, measure: str, n: int, rest: str = "rest") -> DataFrame:
    """The n labels of greatest sum and all others as one."""
    sums = df.groupBy(label).agg(F.sum(measure).alias("total"))
    best = sums.orderBy(F.desc("total"), label).limit(n).select(label, F.lit(True).alias("_top"))
    return sums.join(F.broadcast(best), label, "left").groupBy(F.when(F.col("_top"), F.col(label)).otherwise(rest).alias(label)).agg(F.sum("total").alias("total"))


def facts(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """First and latest time and count per key."""
    return df.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("latest"), F.count(F.lit(1)).alias("n"))


def pool_summary(pool: DataFrame, size: str, fee: str, arrived: str, cycles: str) -> DataFrame:
    """Totals, fee-rate range and oldest arrival of all rows."""
    rate = exact.fee_rate(fee, size)
    return pool.agg(F.count(F.lit(1)).alias("txs"), F.sum(size).alias("size"), F.sum(cycles).alias("cycles"), F.min(rate).alias("least_rate"), F.max(rate).alias("most_rate"), F.min(arrived).alias("oldest"))


def group_by_host(df: DataFrame, url: str) -> DataFrame:
    """Rows per host of a URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    return df.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def script_groups(legs: DataFrame, tx: str, role: str, script: str, index: str) -> DataFrame:
    """Positions per script of each transaction (A70); as many as the transaction has legs."""
    return legs.groupBy(tx, role, script).agg(F.sort_array(F.collect_list(index)).alias("positions"))
