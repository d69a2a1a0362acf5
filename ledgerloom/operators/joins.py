"""Joins over a ledger (J01-J28). Every one is an equi-join that Spark may shuffle, broadcast or split; nothing is hinted without a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import carried, in_ranges


def cell_state(outputs: DataFrame, inputs: DataFrame, keys: list[str], spent: str) -> DataFrame:
    """Outputs with their consumer's columns; live where `spent` (a column of inputs) is null."""
    return outputs.join(inputs, keys, "left").withColumn("live", F.col(spent).isNull())


def live_set(outputs: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs without a consumer."""
    return outputs.join(inputs.select(*keys), keys, "left_anti")


def resolve_inputs(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each input with the output it spends; check the rest with quality.unresolved_inputs()."""
    return inputs.join(outputs, keys)


def consumed_cells(outputs: DataFrame, inputs: DataFrame, txs: DataFrame, keys: list[str], consumer: str) -> DataFrame:
    """Spent outputs with the attributes of the consuming transaction."""
    return outputs.join(inputs, keys).join(txs, consumer)


def attach(df: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Pointer rows with the attributes they point at (J05); a pointer without target keeps nulls."""
    return df.join(attributes, keys, "left")


def lookup(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose key is wanted."""
    return df.join(wanted.select(*keys), keys, "left_semi")


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, by: list[str] | None = None, name: str = "as_of", bucket_ms: int = 86_400_000) -> DataFrame:
    """Each left row with the last right value at or before its time, or null.

    Both sides go into one row order per time bucket; what a bucket inherits is the last value of any earlier
    bucket, taken over the few buckets. No time range is joined.
    """
    by = by or []
    tagged = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    marks = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = tagged.unionByName(marks, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_t") / bucket_ms))
    ends = marks.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms)).groupBy(*by, "_bucket").agg(F.max_by("_v", "_t").alias("_last"))
    buckets = both.select(*by, "_bucket").distinct().join(ends, [*by, "_bucket"], "left")
    inherited = buckets.select(*by, "_bucket", F.last("_last", True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(name, F.last("_v", True).over(inside)).join(inherited, [*by, "_bucket"], "left")
    return found.where(F.col("_side") == 1).withColumn(name, F.coalesce(name, "_from")).select(*left.columns, name)


def blocks_by_day(blocks: DataFrame, day: str, number: str) -> DataFrame:
    """First and last block and count of each day."""
    return blocks.groupBy(day).agg(F.min(number).alias("first_block"), F.max(number).alias("last_block"), F.count(F.lit(1)).alias("blocks"))


def with_parent(blocks: DataFrame, number: str, *columns: str) -> DataFrame:
    """Each block with its parent's columns as parent_*; the first has nulls."""
    parents = blocks.select((F.col(number) + 1).alias(number), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return blocks.join(parents, number, "left")


def deposit_lifecycle(deposits: DataFrame, requests: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """Deposits with their request and completion, paired by position key and never by amount or owner."""
    return deposits.join(requests, key, "left").join(completions, key, "left")


def attach_rates(deposits: DataFrame, rates: DataFrame, position: str, rate: str, **points: str) -> DataFrame:
    """The accumulated rate at each named point: attach_rates(d, r, "day", "ar", ar_deposit="deposit_day")."""
    out = deposits
    for name, at in points.items():
        out = out.join(rates.select(F.col(position).alias(at), F.col(rate).alias(name)), at, "left")
    return out


def _windowed(proposals: DataFrame, txs: DataFrame, key: str, proposed: str, committed: str, closest: int, farthest: int) -> DataFrame:
    """Proposals with the commitments inside their windows. Heights are cut into stretches as long as a window, and a window
    meets the two stretches it can reach, so a party with many of both is joined stretch by stretch."""
    width = farthest - closest + 1
    first = F.floor((F.col(proposed) + closest) / width)
    reach = proposals.withColumn("_stretch", F.explode(F.array(first, first + 1)))
    hits = reach.join(txs.withColumn("_stretch", F.floor(F.col(committed) / width)), [key, "_stretch"])
    return hits.where(F.col(committed).between(F.col(proposed) + closest, F.col(proposed) + farthest))


def commitments(proposals: DataFrame, txs: DataFrame, key: str, proposed: str, committed: str, closest: int, farthest: int) -> DataFrame:
    """The earliest commitment of each proposal inside its window [proposed + closest, proposed + farthest]."""
    hits = _windowed(proposals, txs, key, proposed, committed, closest, farthest)
    return hits.groupBy(key, proposed).agg(F.min(committed).alias(committed))


def earliest_proposal(proposals: DataFrame, txs: DataFrame, key: str, proposed: str, committed: str, closest: int, farthest: int) -> DataFrame:
    """The earliest proposal in whose window each commitment falls."""
    hits = _windowed(proposals, txs, key, proposed, committed, closest, farthest)
    return hits.groupBy(key, committed).agg(F.min(proposed).alias(proposed))


def pool_stage(pool: DataFrame, proposals: DataFrame, tip: int, key: str, proposed: str, closest: int, farthest: int) -> DataFrame:
    """Each pool transaction with its stage at the tip: proposed (committable), gap, or pending; the latest such proposal."""
    open_ = proposals.where(F.col(proposed) + farthest > tip)
    ready = F.col(proposed) + closest <= tip + 1
    best = open_.groupBy(key).agg(F.max(F.when(ready, F.col(proposed))).alias("_ready"), F.max(F.when(~ready, F.col(proposed))).alias("_gap"))
    stage = F.when(F.col("_ready").isNotNull(), "proposed").when(F.col("_gap").isNotNull(), "gap").otherwise("pending")
    return pool.join(best, key, "left").select(*pool.columns, stage.alias("stage"), F.coalesce("_ready", "_gap").alias(proposed))


#: Legs of one (tx, token) from which on its parties are matched range by range.
LARGE = 1_000_000
#: Legs that a task matches on average: its sorts and aggregates hold some 550 bytes a leg at once, so tasks grow in number.
TASK_LEGS = 100_000


def match_transfers(legs: DataFrame, tx: str, token: str, party: str, delta: str, path: str, large: int = LARGE) -> DataFrame:
    """Net senders paired with net receivers per (tx, token) in party order; the rest is mint or burn.

    The greedy pairing equals the overlap of both sides' cumulative intervals. The starts of all intervals, put in one
    order, cut the line into stretches that have one sender and one receiver each, carried forward from the last start
    of their side; so the work is linear in the parties of a (tx, token). Rows: tx, token, sender, receiver, amount;
    sender null is a mint, receiver null a burn. Legs are dealt by (tx, token) once, for all steps, to tasks of about TASK_LEGS legs; a (tx, token) of more than
    `large` legs, such as an airdrop, lies in ranges of parties and then of places instead, written below path, and
    sums and last starts are carried from range to range.
    """
    keys = [tx, token]
    few = legs.select(*keys, party, delta)
    tasks = few.count() // TASK_LEGS + 1
    crowded = few.repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_legs")).where(F.col("_legs") > large).select(*keys)
    if crowded.isEmpty():
        return _matched(few.repartition(tasks, *keys), keys, party, delta)
    wide = _wide_points(few.join(crowded, keys, "left_semi"), keys, party, delta, path)
    return _matched(few.join(crowded, keys, "left_anti").repartition(tasks, *keys), keys, party, delta).unionByName(_cut_ranges(wide, keys, f"{path}/points"))


def _net(legs: DataFrame, keys: list[str], party: str, delta: str) -> DataFrame:
    return legs.groupBy(*keys, party).agg(F.sum(delta).alias("_net")).where(F.col("_net") != 0)


def _points(placed: DataFrame, keys: list[str], party: str) -> DataFrame:
    """(_at, _s, _r) of each group: where an interval of a sender or receiver starts, and where the last of a side (_end) ends."""
    nobody = F.lit(None).cast(placed.schema[party].dataType)
    side = lambda rule, p: F.when(rule, F.struct(p.alias("p")))
    sends, gets = F.col("_net") < 0, F.col("_net") > 0
    point = lambda at, who: F.struct(F.col(at).alias("_at"), side(sends, who).alias("_s"), side(gets, who).alias("_r"))
    points = placed.select(*keys, F.inline(F.array_compact(F.array(point("_lo", F.col(party)), F.when(F.col("_end"), point("_hi", nobody))))))
    return points.groupBy(*keys, "_at").agg(F.max("_s").alias("_s"), F.max("_r").alias("_r"))


def _matched(legs: DataFrame, keys: list[str], party: str, delta: str) -> DataFrame:
    order = Window.partitionBy(*keys, F.col("_net") > 0).orderBy(party)
    hi = F.sum(F.abs("_net")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = _net(legs, keys, party, delta).withColumns({"_hi": hi, "_end": F.lead(party).over(order).isNull()}).withColumn("_lo", F.col("_hi") - F.abs("_net"))
    along = Window.partitionBy(*keys).orderBy("_at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = _points(placed, keys, party).select(*keys, F.last("_s", True).over(so_far)["p"].alias("sender"), F.last("_r", True).over(so_far)["p"].alias("receiver"), (F.lead("_at").over(along) - F.col("_at")).alias("amount"))
    return cut.where(F.col("amount").isNotNull())


def _wide_points(legs: DataFrame, keys: list[str], party: str, delta: str, path: str) -> DataFrame:
    """The points of groups whose parties lie in several ranges: sums of the ranges before are added to those inside."""
    side = [*keys, "_gets"]
    ranged = in_ranges(_net(legs, keys, party, delta).withColumn("_gets", F.col("_net") > 0), side, [party], f"{path}/parties")
    along = Window.partitionBy(*side).orderBy("_range")  # a row for each range of a group
    sums = carried(ranged, side, _sum=F.sum(F.abs("_net"))).select(*side, "_range", F.coalesce(F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_range").over(along).isNull().alias("_last"))
    inside = Window.partitionBy(*side, "_range").orderBy(party)
    hi = F.sum(F.abs("_net")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = ranged.join(sums, [*side, "_range"]).withColumns({"_hi": hi, "_end": F.lead(party).over(inside).isNull() & F.col("_last")}).withColumn("_lo", F.col("_hi") - F.abs("_net"))
    return _points(placed, keys, party)


def _cut_ranges(points: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The stretches between points that lie in several ranges: the last starts before a range and the first point after it are carried."""
    ranged = in_ranges(points, keys, ["_at"], path)
    along = Window.partitionBy(*keys).orderBy("_range")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = carried(ranged, keys, _ls=F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_at"))), _lr=F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))), _first=F.min("_at"))
    ends = ends.select(*keys, "_range", F.last("_ls", True).over(before).alias("_ls"), F.last("_lr", True).over(before).alias("_lr"), F.lead("_first").over(along).alias("_next"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    who = lambda own, last, name: F.coalesce(F.last(own, True).over(so_far), F.col(last))["p"].alias(name)
    cut = ranged.join(ends, [*keys, "_range"]).select(*keys, who("_s", "_ls", "sender"), who("_r", "_lr", "receiver"), (F.coalesce(F.lead("_at").over(inside), "_next") - F.col("_at")).alias("amount"))
    return cut.where(F.col("amount").isNotNull())


def attach_names(df: DataFrame, labels: DataFrame, keys: list[str], name: str, fallback: str | Column = "unknown") -> DataFrame:
    """Rows with the name of what they refer to."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return df.join(labels.select(*keys, name), keys, "left").withColumn(name, F.coalesce(F.col(name), other))


def resolve_code(refs: DataFrame, cells: DataFrame, code: str, kind: str, data_hash: str, type_hash: str) -> DataFrame:
    """References with the live cells that carry their code: by data hash, or by type hash where kind is "type" (J17)."""
    by_data = refs.where(F.col(kind) != "type").join(cells, F.col(code) == F.col(data_hash))
    by_type = refs.where(F.col(kind) == "type").join(cells, F.col(code) == F.col(type_hash))
    return by_data.unionByName(by_type)


def merge_prefix_parties(short: DataFrame, full: DataFrame, prefix: str, owner: str, n: int, strict: bool = True) -> DataFrame:
    """Parties known by a prefix: merged with the one owner it fits, alone if it fits none.

    A prefix that fits several owners is an error; if not strict, its status says so.
    """
    hits = full.select(F.substring(owner, 1, n).alias(prefix), owner).distinct().groupBy(prefix).agg(F.count(F.lit(1)).alias("matches"), F.min(owner).alias(owner))
    wrong = F.raise_error(F.lit("a prefix fits several parties")).cast("string") if strict else F.lit("ambiguous")
    matches = F.coalesce("matches", F.lit(0))
    status = F.when(matches == 0, "alone").when(matches == 1, "merged").otherwise(wrong)
    return short.join(hits, prefix, "left").select(*short.columns, matches.alias("matches"), F.when(matches == 1, F.col(owner)).alias(owner), status.alias("status"))


def item_versions(events: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Every event of an item's cell numbered in chain order."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(item).orderBy(*order)))


def channel_lifecycle(events: DataFrame, channel: str, order: list[str], kind: str) -> DataFrame:
    """Last state of each channel with the places of its first and last event."""
    at = F.struct(*order)
    return events.groupBy(channel).agg(F.max_by(kind, at).alias("state"), F.min(at).alias("opened"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """Nodes within depth steps (1..5) of the seeds along undirected edges, with their least distance."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    both = edges.select(F.col(source).alias("_a"), F.col(target).alias("_b")).union(edges.select(target, source)).distinct()
    reached = seeds.toDF("node").withColumn("distance", F.lit(0))
    frontier = reached
    for step in range(1, depth + 1):
        found = frontier.join(both, frontier["node"] == both["_a"]).select(F.col("_b").alias("node")).distinct()
        frontier = found.join(reached.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        reached = reached.union(frontier)
    return reached


def branch_compare(old: DataFrame, new: DataFrame, height: str, hash_: str) -> DataFrame:
    """Two branches aligned by height: both, only old or only new, and whether they differ."""
    a, b = old.select(height, F.col(hash_).alias("old_hash")), new.select(height, F.col(hash_).alias("new_hash"))
    return a.join(b, height, "full_outer").withColumn("differs", ~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def branch_fate(orphans: DataFrame, committed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Whether each orphaned transaction was committed again, is pending, or dropped."""
    c, p = committed.select(key, F.lit(True).alias("_c")).distinct(), pending.select(key, F.lit(True).alias("_p")).distinct()
    return orphans.join(c, key, "left").join(p, key, "left").select(*orphans.columns, F.when(F.col("_c"), "committed").when(F.col("_p"), "pending").otherwise("dropped").alias("fate"))


def activation_blocks(rules: DataFrame, epochs: DataFrame, rule: str, at_epoch: str, epoch: str, first: str) -> DataFrame:
    """First block of the first epoch at or after each rule's (J26): rules and epochs in one order, the next epoch looked up."""
    marks = epochs.select(F.col(epoch).alias("_at"), F.lit(None).cast("string").alias("_rule"), F.col(first).alias("_first"))
    asked = rules.select(F.col(at_epoch).alias("_at"), F.col(rule).cast("string").alias("_rule"), F.lit(None).cast("bigint").alias("_first"))
    after = Window.orderBy("_at").rangeBetween(0, Window.unboundedFollowing)  # one row an epoch, and the rules
    found = marks.union(asked).withColumn("activation_block", F.min("_first").over(after)).where(F.col("_rule").isNotNull())
    return found.select(F.col("_rule").alias(rule), F.col("_at").alias(at_epoch), "activation_block")


def bind_info(tokens: DataFrame, info: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The first observed value of each token, and whether a later one conflicts."""
    first = info.groupBy(*keys).agg(F.min_by(value, order).alias(value), (F.count_distinct(value) > 1).alias("conflict"))
    return tokens.join(first, keys, "left")


def expand_deps(members: DataFrame, cells: DataFrame, key: str, used: DataFrame, tx: str, code: str) -> DataFrame:
    """Transactions with the cells their dependency groups list, and which script of the transaction each supplies, if any.

    members lists the cells of each transaction, a row for each (tx, cell), as a table of membership does; a cell that is
    listed twice counts once. used has the scripts that each transaction runs (tx, code); a cell supplies its own code.
    """
    listed = members.select(tx, key).distinct().join(cells, key, "left")
    return listed.join(used.select(tx, code, F.col(code).alias("supplies")).distinct(), [tx, code], "left")
