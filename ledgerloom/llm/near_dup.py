"""MinHash near-dedup with odd sketches.

Each text is the set of its word shingles. MinHash samples of the set serve twice: in bands, whose equal
keys bring candidates together, and folded into an odd sketch, a parity bitmap in which the XOR of two
texts counts the samples they don't share. The sketch estimates high similarities closely, so only
candidates near or above the threshold have their full sets compared.

Texts with the same set are one class from the start. In a band's bucket every class is first compared with
the smallest class only, which links most of a group at the cost of one pair a member. Classes that their
sketches tie together, directly or over others, are a family; in a family that is not one component yet,
blocks of members meet block by block inside tasks, and only confirmed links come out. Pairs that share a
bucket but no family are joined on the bucket with the sketch as the join condition. So each pair that
shares a bucket and passes its sketches is in one component already or decided on its full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chain, mix, signed, slices
from .components import components, merged
from .id_filter import rows_with_ids
from .shared import cut, texts

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
_LONGS = SKETCH_BITS // 64
#: Members of a family in one block, about.
BLOCK = 1024
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SAMPLE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def shingle_sets(column: pa.Array, n: int = 2) -> list[np.ndarray]:
    """The distinct n-word shingles of each row as sorted hashes; with fewer words, all of them as one."""
    words = Words(column)
    grams = chain(words.hash, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(chain(words.hash[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(low, ((short[at : at + 2048, None] ^ _XOR) * _TIMES).min(0), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Every sample flips one bit; bits of shared samples cancel in the XOR of two sketches."""
    bit = (mix(samples.astype(np.uint64) | _SAMPLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float, spread: float = 6.0) -> int:
    """The most differing bits that a pair at the similarity shows, but for so many standard deviations."""
    apart = SAMPLES * (1 - similarity)
    apart += spread * math.sqrt(SAMPLES * similarity * (1 - similarity))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * apart))
    return int(expected + 2 * math.sqrt(expected)) + 1


def _signatures(batches, n: int):
    for part in slices(batches):
        sets = shingle_sets(part.column("text"), n)
        samples = [minhash(s) for s in sets]
        filled = [mix(s) for s in sets]
        prints = np.array([(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) if len(s) else 0)) for s in filled], np.uint64).reshape(-1, 2)
        sketches = np.stack([odd_sketch(s) for s in samples])
        keys = np.concatenate([signed(band_keys(s)) for s in samples])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(signed(np.ascontiguousarray(prints[:, 0]))),
                pa.array(signed(np.ascontiguousarray(prints[:, 1]))),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys)),
                *(pa.array(np.ascontiguousarray(sketches[:, k])) for k in range(_LONGS)),
            ],
            ["doc_id", "n_shingles", "print_a", "print_b", "bands", *_sketch_columns()],
        )


def _sketch_columns(prefix: str = "s") -> list[str]:
    return [f"{prefix}{k}" for k in range(_LONGS)]


def _differing(left: str, right: str):
    """Bits that differ between two sketches whose columns start with these prefixes."""
    return sum((F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(_LONGS)), F.lit(0))


def _compare(batches, n: int, percent: int):
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rights = shingle_sets(part.column("text_b"), n)
            for k, right in enumerate(rights):
                if last[0] != a[at + k]:
                    last = a[at + k], shingle_sets(part.column("text_a").slice(k, 1), n)[0]
                left = last[1]
                same = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * same >= percent * (len(left) + len(right) - same) and same > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def confirmed(pairs: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    needed = rows_with_ids(texts(documents, "doc_id"), ids)
    both = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _compare(batches, n, percent), f"a {kind}, b {kind}"))


def _sets(batches, n: int):
    for part in slices(batches):
        sets = shingle_sets(part.column("text"), n)
        keep = [part.column(k) for k in range(part.num_columns) if part.schema.names[k] != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([s.tobytes() for s in sets], pa.binary())], [*(k for k in part.schema.names if k != "text"), "shingles"])


def _block_links(batches, limit: int, percent: int):
    """Rows sorted by family and pair of blocks, each pair of blocks whole in a partition: its confirmed links between components."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        start, edges = 0, _edges(held)
        for stop in edges[:-1]:
            yield from _links_of(held.slice(start, stop - start), limit, percent)
            start = stop
        held = held.slice(start)
    if held is not None:
        yield from _links_of(held, limit, percent)


def _edges(rows: pa.Table) -> list[int]:
    keys = np.stack([rows.column(k).to_numpy() for k in ("family", "one", "two")])
    return [*(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), rows.num_rows]


def _links_of(rows: pa.Table, limit: int, percent: int):
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    docs, parts = rows.column("doc_id").to_pylist(), rows.column("component").to_pylist()
    place = np.stack([rows.column(c).to_numpy() for c in _sketch_columns()], 1).view(np.uint64)  # bitwise_count() takes absolute values
    block = rows.column("block").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    left, right = (np.flatnonzero(block == one), np.flatnonzero(block == two)) if one != two else (np.arange(len(docs)),) * 2
    component = np.array(parts)
    out: list[tuple[int, int]] = []
    for i in left.tolist():
        others = right[right > i] if one == two else right
        others = others[component[others] != component[i]]
        others = others[np.bitwise_count(place[others] ^ place[i]).sum(1) <= limit]
        for j in others.tolist():
            a, b = find(parts[i]), find(parts[j])
            small, large = sorted((len(sets[i]), len(sets[j])))
            if a == b or 100 * small < percent * large:
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if same and 100 * same >= percent * (small + large - same):
                root[max(a, b)] = min(a, b)
                out.append((docs[i], docs[j]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], rows.schema.field("doc_id").type), pa.array([y for _, y in out], rows.schema.field("doc_id").type)], ["a", "b"])


def family_links(families: DataFrame, sketch: DataFrame, documents: DataFrame, n: int, percent: int, limit: int) -> DataFrame:
    """The confirmed links between components inside each family (rows: family, doc_id, component)."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = families.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).where(F.col("main.n") < F.col("n"))
    # members of the largest component meet only blocks of the others
    few, many = F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int"), F.ceil(F.col("main.n") / BLOCK).cast("int")
    members = families.join(sizes.select("family", F.col("main.component").alias("main"), few.alias("few"), many.alias("many")), "family")
    spot, main = F.xxhash64("doc_id"), F.col("component") == F.col("main")
    block = F.when(main, F.col("few") + F.pmod(spot, F.col("many"))).otherwise(F.pmod(spot, F.col("few"))).cast("int")
    members = cut(members.select("family", "doc_id", "component", block.alias("block"), F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")).alias("blocks")))
    texts_of = rows_with_ids(texts(documents, "doc_id"), members).join(members.join(sketch, "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    schema = f"doc_id {kind}, family {kind}, component {kind}, blocks int, block int, " + ", ".join(f"{c} long" for c in _sketch_columns()) + ", shingles binary"
    ready = texts_of.select("doc_id", "family", "component", "blocks", "block", *_sketch_columns(), "text").mapInArrow(lambda b: _sets(b, n), schema)
    meeting = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other", "blocks")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = meeting.repartition(spread, "family", "one", "two").sortWithinPartitions("family", "one", "two", "doc_id")
    return cut(ordered.mapInArrow(lambda b: _block_links(b, limit, percent), f"a {kind}, b {kind}"))


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id).

    Two texts are linked if 100 * |A and B| >= percent * |A or B| over their sets of n-word shingles (A-Z
    folded). Null texts and texts without words are linked with nothing. Rows that share a doc_id are one
    node. A row without doc_id is linked with nothing; its component_id is null and it is kept. Other
    columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, print_a long, print_b long, bands array<long>, " + ", ".join(f"{c} long" for c in _sketch_columns())
    rows = cut(texts(documents, "doc_id").mapInArrow(lambda batches: _signatures(batches, n), schema))
    real = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    prints = ["print_a", "print_b", "n_shingles"]
    classes = cut(real.groupBy(*prints).agg(F.min("doc_id").alias("doc_id")))
    first = real.join(classes, [*prints, "doc_id"], "left_semi")

    bands = first.select("doc_id", F.explode("bands").alias("key")).distinct()
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where(F.col("center") < F.col("last"))
    crowded = cut(bands.join(shared.select("key", "center"), "key"))
    sketch = cut(first.join(crowded.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *_sketch_columns()).dropDuplicates(["doc_id"]))
    left = sketch.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(_sketch_columns())))
    right = sketch.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"q{k}") for k, c in enumerate(_sketch_columns())))
    limit = sketch_limit(percent / 100)

    stars = crowded.where(F.col("doc_id") != F.col("center")).select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = cut(stars.join(right, "b").join(left, "a").select("a", "b", _differing("p", "q").alias("apart")).where(F.col("apart") <= limit))
    tried = cut(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    links = confirmed(tried, documents, n, percent)
    found = components(links)

    # Families that are not one component yet: their blocks of members meet inside tasks.
    family = cut(components(near.select("a", "b")).select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("component")))
    more = family_links(family, sketch, documents, n, percent, limit)
    if not more.isEmpty():
        found = merged(found, more)

    # What shares a bucket, but neither family nor component.
    placed = crowded.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(family.select("doc_id", "family"), "doc_id", "left")
    placed = placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("family", "doc_id").alias("family"))
    mixed = placed.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high")).where(F.col("low") < F.col("high")).select("key")
    open_rows = cut(placed.join(mixed, "key").join(sketch, "doc_id"))
    one = open_rows.select("key", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("family").alias("fa"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(_sketch_columns())))
    two = open_rows.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("family").alias("fb"), *(F.col(c).alias(f"q{k}") for k, c in enumerate(_sketch_columns())))
    apart = (F.col("ca") != F.col("cb")) & (F.col("fa") != F.col("fb")) & (_differing("p", "q") <= limit)
    rest = cut(one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & apart).select("a", "b").distinct())
    if not rest.isEmpty():
        found = merged(found, confirmed(rest, documents, n, percent))

    placed_classes = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*prints, F.coalesce("component", "doc_id").alias("class_component"))
    by_id = rows.select("doc_id", *prints).join(placed_classes, prints, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_component", "doc_id"))
    return by_id.select("doc_id", "n_shingles", component.cast(kind).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
