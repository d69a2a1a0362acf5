"""The pipeline, stage by stage, against plain Python on a small folder of tables."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

from ledgerloom.llm.queries import toxicity_machine

from .test_operators import folded, linked

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki".split() for b in "lon mar nes pit rov sul tan vex".split()]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(20)) for k in range(5)] + [(7, None), (8, "")]
    rows = []
    for i in range(900):
        body = text(rng.randint(20, 40))
        rows.append((i, body + " you vile insult" if i % 3 == 0 else body))
    rows += [(1200 + k, rows[3 * k + 1][1]) for k in range(6)]  # copies, exact and near
    rows += [(1220 + k, rows[3 * k + 2][1] + " more") for k in range(6)]
    rows += [(1240 + k, text(10) + " " + items[k][1]) for k in range(5)]
    rows += [(1250, "mail " + text(8) + " password = Hunter2Hunter2 and AKIA" + "Z9" * 8 + " then " + "0123456789abcdef" * 2)]
    rows += [(1260, None), (1261, ""), (1262, "   "), (1263, "the " * 9000 + text(5)), (1264, "x" * 30000), (1265, "ü☃ naïve ▁ text\n\tof blanks")]
    out = tmp_path_factory.mktemp("tables")
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": None, "n_chars": len(t or "")} for i, t in rows], pa.schema(kinds)), out / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": i, "text": t} for i, t in items], pa.schema([("item_id", pa.int64()), ("text", pa.string())])), out / "benchmark.parquet")
    labels = [{"doc_id": i, "quality": 1, "toxic": int("insult" in (t or ""))} for i, t in rows if i < 900]
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), out / "labels.parquet")
    return str(out)


def contaminated(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, hit = find(folded(text)), set()
    for item in items:
        own = find(folded(item))
        for k in range(max(1, len(own) - 12) if own else 0):
            window = own[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def masked(text):
    text = text or ""
    text = re.sub(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}""", "[secret]", text)
    return re.sub(r"[0-9a-f]{32,}", "[secret]", text)


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, [tuple(r) for r in docs.collect()]
    machine, items = toxicity_machine(spark, folder), [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def expected(name, rows):
        if name == "toxicity":
            return [r for r in rows if machine.scores(pa.array([r[1] or ""]))[0] < 0.7]
        if name == "near_duplicates":
            first = linked([r[:2] for r in rows], 5, 80)
            return [r for r in rows if first[r[0]][1] == r[0]]
        if name == "decontamination":
            return [r for r in rows if not contaminated(r[1], items)]
        return [(r[0], masked(r[1]), r[2], r[3], len(masked(r[1]))) for r in rows]

    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        want, before = expected(name, now), now
        now = [tuple(r) for r in docs.select(columns).collect()]
        assert docs.columns == columns and Counter(now) == Counter(want), name
        assert name == "secrets" or len(now) < len(before)
    assert sum("insult" in (r[1] or "") for r in now) <= 15  # of 300
    assert {1260, 1261, 1262, 1263, 1264, 1265} <= {r[0] for r in now}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in now) and all(r.round_trip for r in last)
    assert sorted(corpus_pipeline.run(spark, folder).collect(), key=str) == sorted(last, key=str)


def test_stages_take_repeated_rows_null_ids_more_columns_and_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id > 1100")
    extra = docs.union(docs.where("doc_id < 1205")).selectExpr("if(doc_id = 1201, null, doc_id) as doc_id", "text", "lang", "source", "n_chars", "lang as items", "n_chars as start", "source as `a.b`", "1 as component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, folder)
        assert got.columns == extra.columns and got.where("doc_id is null").count() == 2
        assert stage(spark, extra.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, folder).count() == extra.count()
