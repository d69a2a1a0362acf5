"""Exact numbers as column expressions: integers and decimals only, cut or rounded by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base units of a coin; bytes of a cell besides its scripts and data.
COIN, CAPACITY_BYTES, SCRIPT_BYTES = 100_000_000, 8, 33


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a: str | Column, b: str | Column | int) -> Column:
    """Quotient of non-negative integers or decimals, cut; exact, and an error beyond 64 bits."""
    b = F.lit(b) if isinstance(b, int) else _c(b)
    return _div(_c(a), b)


def _div(a: Column, b: Column) -> Column:
    wide = "decimal(38,0)"
    a, b = a.cast(wide), b.cast(wide)
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def hex_to_bytes(x: str | Column, width: int | None = None) -> Column:
    """Bytes of hex text with or without 0x; null if it is no hex or has another width."""
    bare = F.regexp_replace(F.lower(_c(x)), "^0x", "")
    ok = bare.rlike("^([0-9a-f]{2})*$") & (F.lit(True) if width is None else F.length(bare) == 2 * width)
    return F.when(ok, F.unhex(bare))


def bytes_to_hex(x: str | Column) -> Column:
    """Lower-case hex with 0x."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(x))))


def normalize_hash(x: str | Column) -> Column:
    """A 32-byte hash as 0x and 64 lower-case digits, or null."""
    bare = F.regexp_replace(F.lower(F.trim(_c(x))), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("0x"), bare))


def parse_outpoint(x: str | Column) -> Column:
    """Struct (tx_hash, index) of hash-index, hash:index or hash#index, or null."""
    pattern = r"^\s*(?:0x)?([0-9a-fA-F]{64})[-:#]([0-9]{1,9})\s*$"
    found = F.regexp_extract(_c(x), pattern, 1)
    return F.when(found != "", F.struct(F.concat(F.lit("0x"), F.lower(found)).alias("tx_hash"), F.regexp_extract(_c(x), pattern, 2).cast("int").alias("index")))


def to_coins(x: str | Column) -> Column:
    """Base units as coin text: no trailing zeros, sign kept."""
    return scale_amount(x, F.lit(8))


def scale_amount(raw: str | Column, decimals: str | Column) -> Column:
    """An integer amount as decimal text shifted by its decimals, no trailing zeros."""
    raw, decimals = _c(raw), _c(decimals).cast("int")
    digits = F.regexp_replace(raw.cast("decimal(38,0)").cast("string"), "^-", "")
    padded = F.lpad(digits, 40, "0")
    whole = F.regexp_replace(F.substring(padded, F.lit(1), F.lit(40) - decimals), "^0+(?=.)", "")
    part = F.regexp_replace(F.substring(padded, F.lit(41) - decimals, decimals), "0+$", "")
    sign = F.when(raw < 0, "-").otherwise("")
    return F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def ratio_cut(part: str | Column, whole: str | Column, places: int = 3, percent: bool = True) -> Column:
    """part / whole (as percent) as text with so many places, cut and never rounded; null if whole is 0."""
    scale = 10**places * (100 if percent else 1)
    return F.when(_c(whole) != 0, _placed(_div(_c(part).cast("decimal(38,0)") * F.lit(scale).cast("decimal(18,0)"), _c(whole)), places))


def ratio_half_up(part: str | Column, whole: str | Column, places: int = 3, percent: bool = True) -> Column:
    """As ratio_cut(), but rounded half up."""
    scale = 10**places * (100 if percent else 1)
    twice = _c(part).cast("decimal(38,0)") * F.lit(2 * scale).cast("decimal(18,0)")
    return F.when(_c(whole) != 0, _placed(_div(twice.cast("decimal(38,0)") + _c(whole), F.lit(2) * _c(whole)), places))


def _placed(n: Column, places: int) -> Column:
    if places == 0:
        return n.cast("string")
    text = F.lpad(n.cast("string"), 30, "0")
    return F.concat(F.regexp_replace(F.substring(text, 1, 30 - places), "^0+(?=.)", ""), F.lit("."), F.substring(text, 31 - places, places))


def half_up(a: str | Column, b: str | Column) -> Column:
    """a / b of non-negative integers, rounded half up."""
    return _div(F.lit(2) * _c(a) + _c(b), F.lit(2) * _c(b))


def fee_rate(fee: str | Column, size: str | Column) -> Column:
    """Fee per thousand bytes, cut; order rates by fee_before() instead."""
    return _div(_c(fee) * 1000, _c(size))


def fee_before(fee_a: Column, size_a: Column, fee_b: Column, size_b: Column) -> Column:
    """Whether rate a is higher than rate b, by cross product: exact where quotients would tie."""
    wide = "decimal(19,0)"
    return fee_a.cast(wide) * size_b.cast(wide) > fee_b.cast(wide) * size_a.cast(wide)


def compensation(capacity: str | Column, occupied: str | Column, rate_then: str | Column, rate_now: str | Column) -> Column:
    """What the free part has gained between two accumulated rates, cut."""
    free = _c(capacity) - _c(occupied)
    return _div(free.cast("decimal(19,0)") * _c(rate_now).cast("decimal(19,0)"), _c(rate_then)) - free


def block_issuance(index: str | Column, length: str | Column, reward: str | Column) -> Column:
    """A block's share of an epoch's reward; the remainder goes to the first blocks."""
    share, left = _div(_c(reward), _c(length)), F.pmod(_c(reward), _c(length))
    return share + F.when(_c(index) < left, 1).otherwise(0)


def next_boundary(start: tuple[Column, Column, Column], tip: tuple[Column, Column, Column], cycle: int = 180) -> Column:
    """Epoch number of the next cycle end after the tip for a deposit at start; both are (number, index, length).

    At an exact boundary a new cycle starts. Fractions are compared by cross product.
    """
    (n0, i0, l0), (n1, i1, l1) = start, tip
    whole = (n1 - n0).cast("bigint")
    past = i1.cast("bigint") * l0.cast("bigint") >= i0.cast("bigint") * l1.cast("bigint")
    elapsed = F.when(past, whole).otherwise(whole - 1)  # whole epochs since the start
    return n0 + (_div(F.greatest(elapsed, F.lit(0)), F.lit(cycle)) + 1) * cycle


def day_bucket(epochs_left: str | Column, epochs_per_day: int = 6) -> Column:
    """Nominal days until a boundary, rounded down."""
    return _div(_c(epochs_left), F.lit(epochs_per_day))


def realized_return(rate_then: str | Column, rate_now: str | Column, days: str | Column) -> Column:
    """Simple yearly return in percent between two accumulated rates, cut to 2 places."""
    gained = (_c(rate_now) - _c(rate_then)).cast("decimal(20,0)") * F.lit(365)
    return _placed(_div(gained * F.lit(10000), _c(rate_then).cast("decimal(20,0)") * _c(days)), 2)


def nominal_return(year: str | Column, base: float = 2.47, halving: int = 4) -> Column:
    """Nominal yearly return in percent on a timeline that halves the base issuance every few years."""
    return F.lit(base) / F.pow(F.lit(2.0), F.floor(_c(year) / halving))


def compact_difficulty(compact: str | Column) -> Column:
    """Difficulty floor(2^256 / target) of a compact target, as decimal(38,0); needs exponent 18..32."""
    exponent, mantissa = F.shiftrightunsigned(_c(compact).cast("bigint"), 24), _c(compact).cast("bigint").bitwiseAND(F.lit(0xFFFFFF))
    shift = (F.lit(256) - 8 * (exponent - 3)).cast("int")  # difficulty = 2^shift / mantissa, and shift <= 136
    low = F.least(shift, F.lit(100))
    power = F.pow(F.lit(2.0), low.cast("double")).cast("decimal(38,0)")
    return F.floor(power / mantissa.cast("decimal(8,0)")).cast("decimal(38,0)")


def format_duration(seconds: str | Column) -> Column:
    """Text such as 1d 2h 3m 4s; leading zero units are left out."""
    s = _c(seconds)
    d, h, m = _div(s, F.lit(86400)), _div(F.pmod(s, F.lit(86400)), F.lit(3600)), _div(F.pmod(s, F.lit(3600)), F.lit(60))
    r = F.pmod(s, F.lit(60))
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, r))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def occupied_capacity(lock_args: Column, type_args: Column, data: Column) -> Column:
    """Base units that a cell's bytes take up; type_args null means no type script."""
    size = CAPACITY_BYTES + SCRIPT_BYTES + F.length(lock_args) + F.when(type_args.isNotNull(), SCRIPT_BYTES + F.length(type_args)).otherwise(0) + F.coalesce(F.length(data), F.lit(0))
    return size.cast("bigint") * COIN


def free_part(capacity: str | Column, occupied: str | Column) -> Column:
    """capacity - occupied; an occupied part below 0 or over the whole is an error."""
    cap, occ = _c(capacity), _c(occupied)
    return F.when((occ >= 0) & (occ <= cap), cap - occ).otherwise(F.raise_error(F.lit("occupied part outside the whole")).cast("bigint"))


def tx_fee(inputs: str | Column, outputs: str | Column, withdrawal: str | Column) -> Column:
    """inputs - outputs; 0 where a savings withdrawal makes outputs larger, otherwise an error."""
    i, o = _c(inputs), _c(outputs)
    return F.when(i >= o, i - o).when(_c(withdrawal), F.lit(0).cast("bigint")).otherwise(F.raise_error(F.lit("outputs exceed inputs")).cast("bigint"))


def little_endian(x: str | Column, at: int, n: int = 8) -> Column:
    """An unsigned little-endian integer of n <= 8 bytes at an offset, as decimal(20,0)."""
    digits = F.hex(_c(x))
    turned = F.concat(*(F.substring(digits, 2 * (at + k) + 1, 2) for k in reversed(range(n))))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def decode_dao_field(x: str | Column) -> Column:
    """The four integers C, AR, S, U of a 32-byte header field."""
    return F.struct(*(little_endian(x, 8 * k).alias(name) for k, name in enumerate(("c", "ar", "s", "u"))))


def decode_le_u128(x: str | Column) -> Column:
    """Low and high 64 bits of an amount in the first 16 bytes."""
    return F.when(F.length(_c(x)) >= 16, F.struct(little_endian(x, 0).alias("low"), little_endian(x, 8).alias("high")))


def limb_sum_text(low_sum: str | Column, high_sum: str | Column) -> Column:
    """Decimal text of high * 2^64 + low for sums of limbs, exact while high stays below 10^18 (7.4)."""
    carry = _div(_c(low_sum), F.lit("18446744073709551616").cast("decimal(38,0)"))
    low = _c(low_sum).cast("decimal(38,0)") - carry.cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)")
    high = _c(high_sum).cast("decimal(38,0)") + carry
    return (high.cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + low).cast("decimal(38,0)").cast("string")


def media_sources(text: str | Column) -> Column:
    """The media URIs in a content text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(r"((?:https?|ipfs|ar|btcfs|data)://?[^\s\"'<>]+)"), F.lit(1))


def media_tier(text: str | Column) -> Column:
    """Where the media of a content depend on: none, chain, permanent store or server."""
    uris = media_sources(text)
    return (
        F.when(F.exists(uris, lambda u: u.startswith("http")), "server")
        .when(F.exists(uris, lambda u: u.startswith("ipfs") | u.startswith("ar")), "permanent")
        .when(F.size(uris) > 0, "chain")
        .otherwise("none")
    )


def item_id_dna(content: str | Column) -> Column:
    """Declared id and DNA of an item's JSON content (F16)."""
    return F.struct(F.get_json_object(_c(content), "$.id").alias("id"), F.get_json_object(_c(content), "$.dna").alias("dna"))


def merge_traits(*steps: Column) -> Column:
    """Maps of traits merged; a later step overrides."""
    merged = steps[0]
    for step in steps[1:]:
        merged = F.map_concat(F.map_filter(merged, lambda k, _: ~F.array_contains(F.map_keys(step), k)), step)
    return merged


def interval_band(seconds: str | Column, most: int = 30) -> Column:
    """Whole seconds 0..most-1, and most for all longer ones."""
    return F.least(_c(seconds), F.lit(most))
