"""Protocol actions of a transaction from the kinds of cells it consumes and creates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Detector = Callable[[DataFrame], DataFrame]
_detectors: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """A detector maps transaction legs to rows (tx, action)."""
    _detectors[name] = detector


def detect(legs: DataFrame, *protocols: str) -> DataFrame:
    """Union of the detectors' actions with the protocol's name: of the named protocols, or of all."""
    return reduce(lambda a, b: a.unionByName(b), (_detectors[n](legs).withColumn("protocol", F.lit(n)) for n in sorted(protocols or _detectors)))


def flow_flags(legs: DataFrame, tx: str, side: str, **kinds: Column) -> DataFrame:
    """For each kind whether a transaction consumes (in_) and creates (out_) it; the base of F19-F22."""
    flags = []
    for name, rule in kinds.items():
        flags += [F.bool_or(rule & (F.col(side) == "input")).alias(f"in_{name}"), F.bool_or(rule & (F.col(side) == "output")).alias(f"out_{name}")]
    return legs.groupBy(tx).agg(*flags)


def _pick(flags: DataFrame, tx: str, *rules: tuple[str, Column]) -> DataFrame:
    action = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        action = action.when(rule, name)
    return flags.select(tx, action.alias("action")).where(F.col("action").isNotNull())


def classify_bridge(legs: DataFrame, tx: str, side: str, bound: Column, time_locked: Column, asset: Column) -> DataFrame:
    """Bridged assets: transfer, leap_out, leap_in, time_locked or receive."""
    f = flow_flags(legs.where(asset), tx, side, bound=bound, locked=time_locked, plain=~bound & ~time_locked)
    c = F.col
    return _pick(
        f, tx, ("time_locked", c("out_locked")), ("transfer", c("in_bound") & c("out_bound")), ("leap_out", c("in_bound") & c("out_plain")),
        ("leap_in", c("in_plain") & c("out_bound")), ("receive", c("in_locked") & c("out_plain")), ("leap_in", c("out_bound")),
    )


def classify_channel(legs: DataFrame, tx: str, side: str, funding: Column, commitment: Column) -> DataFrame:
    """Payment channels: open, force_close, revoke, settle or close."""
    f, c = flow_flags(legs, tx, side, funding=funding, commitment=commitment), F.col
    return _pick(
        f, tx, ("force_close", c("in_funding") & c("out_commitment")), ("close", c("in_funding")), ("open", c("out_funding")),
        ("revoke", c("in_commitment") & c("out_commitment")), ("settle", c("in_commitment")),
    )


def classify_vault(legs: DataFrame, tx: str, side: str, vault: Column, supply: str) -> DataFrame:
    """Debt vaults by counts of vaults and the direction of the supply: open, close, borrow, repay, redemption, adjust."""
    sides = lambda s: F.count_if(vault & (F.col(side) == s))
    delta = F.sum(F.when(~vault, F.when(F.col(side) == "output", F.col(supply)).otherwise(-F.col(supply))).otherwise(0))
    f, c = legs.groupBy(tx).agg(sides("input").alias("n_in"), sides("output").alias("n_out"), delta.alias("delta")), F.col
    return _pick(
        f, tx, ("open", (c("n_in") == 0) & (c("n_out") > 0)), ("close", (c("n_in") > 0) & (c("n_out") == 0)), ("redemption", (c("n_in") > 1) & (c("delta") < 0)),
        ("borrow", (c("n_in") > 0) & (c("delta") > 0)), ("repay", (c("n_in") > 0) & (c("delta") < 0)), ("adjust", c("n_in") > 0),
    )


def classify_intent(legs: DataFrame, tx: str, side: str, intent: Column, owner: str, prefix: int = 20) -> DataFrame:
    """Swap intents: submitted when created, settled when consumed, with the owner's prefix."""
    rows = legs.where(intent).groupBy(tx, F.substring(owner, 1, prefix).alias("owner")).agg(F.bool_or(F.col(side) == "input").alias("i"), F.bool_or(F.col(side) == "output").alias("o"))
    return rows.select(tx, "owner", F.when(F.col("i"), "settled").otherwise("submitted").alias("action"))


def classify_name(before: DataFrame, after: DataFrame, keys: list[str], owner: str, expiry: str, status: str) -> DataFrame:
    """Names by the difference of consumed and created state: register, recycle, list, cancel, buy, renew, transfer, edit."""
    b = before.select(*keys, F.struct(owner, expiry, status).alias("b"))
    a = after.select(*keys, F.struct(owner, expiry, status).alias("a"))
    was, now = lambda x: F.col(f"b.{x}"), lambda x: F.col(f"a.{x}")
    action = (
        F.when(F.col("b").isNull(), "register")
        .when(F.col("a").isNull(), "recycle")
        .when((was(status) == "normal") & (now(status) == "listed"), "list")
        .when((was(status) == "listed") & (now(status) == "normal") & (was(owner) == now(owner)), "cancel")
        .when((was(status) == "listed") & (was(owner) != now(owner)), "buy")
        .when(now(expiry) > was(expiry), "renew")
        .when(was(owner) != now(owner), "transfer")
        .otherwise("edit")
    )
    return b.join(a, keys, "full_outer").select(*keys, action.alias("action"))


def name_subjects(flow: DataFrame, tx: str, flow_column: str) -> DataFrame:
    """The accounts an action is about: those only created or only consumed, or all if there are none."""
    changed = flow.groupBy(tx).agg(F.bool_or(F.col(flow_column) != "kept").alias("_any"))
    return flow.join(changed, tx).where(~F.col("_any") | (F.col(flow_column) != "kept")).drop("_any")


def savings_action(created: Column, requested: Column, consumed: Column) -> Column:
    """deposit, withdraw_request or complete, one for each cell."""
    return F.when(created & ~requested, "deposit").when(created & requested, "withdraw_request").when(consumed, "complete")


def dedup_actions(actions: DataFrame, keys: list[str], per_cell: Column) -> DataFrame:
    """Actions once each, but those that count per cell as often as they come."""
    return actions.where(~per_cell).dropDuplicates(keys).unionByName(actions.where(per_cell))


def merge_metadata(chain: DataFrame, labels: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Label values over chain values, with the fields in which they conflict."""
    both = chain.alias("c").join(labels.alias("l"), key, "full_outer")
    clash = [F.when(F.col(f"c.{f}") != F.col(f"l.{f}"), F.lit(f)) for f in fields]
    return both.select(key, *(F.coalesce(F.col(f"l.{f}"), F.col(f"c.{f}")).alias(f) for f in fields), F.array_compact(F.array(*clash)).alias("conflicts"))
