"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions.calendar import chain_time, day_end_ms, day_key, day_of, days_between, hour_index
from ledgerloom.functions.udf import blake2b, rational_mean


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def lit(x, kind="bigint"):
    return F.lit(x).cast(kind)


def test_rounding(spark):
    cases = [(5, 2, 3), (4, 2, 2), (7, 4, 2), (6, 4, 2)]
    assert [one(spark, x=exact.half_up(lit(a), lit(b))).x for a, b, _ in cases] == [w for *_, w in cases]


def test_ratios_are_cut(spark):
    r = one(spark, a=exact.ratio_cut(lit(2), lit(3)), b=exact.ratio_cut(lit(1), lit(3)), c=exact.ratio_half_up(lit(2), lit(3)), d=exact.ratio_cut(lit(1), lit(2)), e=exact.ratio_cut(lit(1), lit(0)), f=exact.ratio_cut(lit(2), lit(3), 2))
    assert tuple(r) == ("66.666", "33.333", "66.667", "50.000", None, "66.66")


def test_free_part_and_fee(spark):
    assert one(spark, x=exact.free_part(lit(1000), lit(600))).x == 400
    with pytest.raises(Exception, match="occupied part"):
        one(spark, x=exact.free_part(lit(100), lit(150)))
    assert one(spark, x=exact.tx_fee(lit(10), lit(7), F.lit(False)), y=exact.tx_fee(lit(7), lit(10), F.lit(True))) == (3, 0)
    with pytest.raises(Exception, match="outputs exceed"):
        one(spark, x=exact.tx_fee(lit(7), lit(10), F.lit(False)))


def test_amounts(spark):
    r = one(spark, a=exact.to_coins(lit(123_450_000_000)), b=exact.to_coins(lit(-5)), c=exact.to_coins(lit(0)), d=exact.scale_amount(lit(1234), F.lit(0)), e=exact.scale_amount(lit(1234), F.lit(6)))
    assert tuple(r) == ("1234.5", "-0.00000005", "0", "1234", "0.001234")


def test_little_endian(spark):
    data = (7).to_bytes(8, "little") + (2**64 - 1).to_bytes(8, "little") + (3).to_bytes(8, "little") + (2**40).to_bytes(8, "little")
    r = one(spark, x=exact.decode_dao_field(F.lit(data)), y=exact.decode_le_u128(F.lit(data)), z=exact.decode_le_u128(F.lit(b"short")))
    assert tuple(map(int, r.x)) == (7, 2**64 - 1, 3, 2**40) and tuple(map(int, r.y)) == (7, 2**64 - 1) and r.z is None
    assert one(spark, x=exact.limb_sum_text(F.lit(str(2**65 + 5)).cast("decimal(38,0)"), F.lit("10").cast("decimal(38,0)"))).x == str(12 * 2**64 + 5)


def test_hashes(spark):
    h = "AB" * 32
    r = one(spark, a=exact.normalize_hash(F.lit(" " + h)), b=exact.normalize_hash(F.lit("0x12")), c=exact.parse_outpoint(F.lit(f"0x{h}#7")), d=exact.parse_outpoint(F.lit("x:1")), e=exact.hex_to_bytes(F.lit("0x0aff"), 2), f=exact.hex_to_bytes(F.lit("0x0aff"), 3))
    assert r.a == "0x" + h.lower() and r.b is None and tuple(r.c) == ("0x" + h.lower(), 7) and r.d is None and bytes(r.e) == b"\x0a\xff" and r.f is None


def test_savings_functions(spark):
    assert one(spark, x=exact.compensation(lit(1000), lit(400), lit(10), lit(15))).x == 300
    assert [one(spark, x=exact.block_issuance(F.lit(i), lit(4), lit(10))).x for i in range(4)] == [3, 3, 2, 2]
    at = lambda n, i, length: (lit(n), F.lit(i), F.lit(length))
    assert one(spark, x=exact.next_boundary(at(5, 1, 2), at(185, 1, 2))).x == 365  # exactly a cycle later a new one starts
    assert one(spark, x=exact.next_boundary(at(5, 1, 2), at(185, 1, 3))).x == 185
    assert one(spark, x=exact.realized_return(lit(3), lit(5), lit(365))).x == "66.66"
    assert one(spark, x=exact.nominal_return(F.lit(5.0), 2.0)).x == 1.0
    assert int(one(spark, x=exact.compact_difficulty(lit(0x20010000))).x) == 256


def test_occupied_capacity(spark):
    r = one(spark, a=exact.occupied_capacity(F.lit(b"\0" * 20), F.lit(None).cast("binary"), F.lit(b"")), b=exact.occupied_capacity(F.lit(b"\0" * 20), F.lit(b"\0" * 32), F.lit(b"12345678")))
    assert tuple(r) == (61 * 10**8, (61 + 33 + 32 + 8) * 10**8)


def test_calendar(spark):
    day = 20_000 * 86_400_000
    df = spark.createDataFrame([(0, day + 1), (1, day + 16 * 3_600_000 - 1), (2, day + 16 * 3_600_000), (3, day + 5)], "number long, ms long")
    got = chain_time(df, "number", "ms", "t").orderBy("number").select("t", day_of("ms").alias("d"), hour_index("ms").alias("h"), day_key(day_of("ms")).alias("k"), day_end_ms(day_of("ms")).alias("e")).collect()
    assert [r.t - day for r in got] == [1, 16 * 3_600_000 - 1, 16 * 3_600_000, 16 * 3_600_000]
    assert [(r.d - got[0].d).days for r in got] == [0, 0, 1, 0] and got[0].e == day + 16 * 3_600_000
    assert got[0].h == 480_000 and got[0].k == int(got[0].d.strftime("%Y%m%d"))
    assert days_between(spark.sql("SELECT DATE '2024-02-27' AS a, DATE '2024-03-01' AS b"), "a", "b").count() == 4


def test_chain_time_over_ranges(spark):
    from ledgerloom.functions.calendar import prefix

    df = spark.range(1000).selectExpr("id AS number", "CASE WHEN id % 7 = 0 THEN id - 50 ELSE id END AS ms")
    got = prefix(df, "number", "ms", "m", "max", width=37).join(prefix(df, "number", "ms", "s", "sum", width=37), ["number", "ms"]).orderBy("number").collect()
    top, total = -(10**9), 0
    for r in got:
        top, total = max(top, r.ms), total + r.ms
        assert (r.m, r.s) == (top, total)


def test_text_functions(spark):
    r = one(spark, a=exact.media_tier(F.lit("see ipfs://abc")), b=exact.media_tier(F.lit("x https://a/b ipfs://c")), c=exact.media_tier(F.lit("btcfs://q")), d=exact.media_tier(F.lit("none")), e=exact.item_id_dna(F.lit('{"id": 5, "dna": "ab"}')), f=exact.format_duration(lit(90_061)))
    assert (r.a, r.b, r.c, r.d, tuple(r.e), r.f) == ("permanent", "server", "chain", "none", ("5", "ab"), "1d 1h 1m 1s")
    merged = one(spark, m=exact.merge_traits(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).m
    assert merged == {"a": "1", "b": "3"}


def test_udfs(spark):
    import hashlib

    assert bytes(one(spark, x=blake2b(F.lit(b"abc"), b"p")).x) == hashlib.blake2b(b"abc", digest_size=32, person=b"p").digest()
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, 3), ("a", 1, 6), ("b", 5, 1)], "k string, fee long, size long")
    assert {r.k: r["mean"] for r in rational_mean(df, "k", "fee", "size").collect()} == {"a": 277, "b": 5000}


def test_rational_means_of_many_groups_are_added_up_in_one_pass(spark):
    from fractions import Fraction

    rows = [(None if g == 70 else g, g * 7919 % 211 + k, (g + k) % 9 + 1) for g in range(300) for k in range(6)] + [(5, -40, 7)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups lie across batches
    try:
        found = rational_mean(spark.createDataFrame(rows, "k long, fee long, size int"), "k", "fee", "size")
        got = {r["k"]: r["mean"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    shares = {}
    for k, fee, n in rows:
        shares.setdefault(k, []).append(Fraction(fee, n) * 1000)
    assert got == {k: (sum(x) / len(x)).__floor__() for k, x in shares.items()}
    assert "InPandas" not in found._jdf.queryExecution().toString()  # no call for each group
