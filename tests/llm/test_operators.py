"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, html_text, licenses, near_dup, piece_nbest, queries, repeats, secrets, token_files, top_inner, toxicity
from ledgerloom.llm.components import components

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, n_words long, start long, key string, component string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "k", "c") for i, t in rows], DOCS)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta eps Zeta eta théta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(v)))
    shared = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(4):
        rows.append((len(rows), rng.choice(words) + shared + rng.choice(words)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one"), (len(rows) + 3, "one"), (len(rows) + 4, "ab " * 3000), (None, base[0])]
    return rows


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rows = corpus()
    got = near_dup.near_duplicates(docs_of(spark, rows), n, 80).collect()
    want = linked(rows, n, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_duplicates_small_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    rows = [r for r in corpus(seed=5) if r[0] is not None]
    got = near_dup.near_duplicates(docs_of(spark, rows + rows[:3]), 2, 80).collect()
    want = linked(rows, 2, 80)
    assert len(got) == len(rows) + 3
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 9), (4, 4), (10, 11), (12, 11), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10, 12: 10}


@pytest.mark.parametrize("large", [1_000_000, 0])
def test_components_of_random_links(spark, monkeypatch, large):
    from ledgerloom.llm import components as module

    monkeypatch.setattr(module, "LARGE", large)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(500, 501 + k) for k in range(80)]
    more = [(rng.randrange(300), rng.randrange(300)) for _ in range(40)] + [(900, 901), (3, 900), (505, 700), (1000, 1000)]

    def brute(pairs):
        low = {x: x for p in pairs for x in p}
        for _ in pairs:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    first = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in first.collect()} == {k: v for k, v in brute(links).items() if k in {x for a, b in links if a != b for x in (a, b)}}
    both = {r.node: r.component for r in module.merged(first, spark.createDataFrame(more, "a long, b long")).collect()}
    want = brute(links + more)
    assert all(want[k] == v for k, v in both.items()) and {k for k, v in want.items() if k != v} <= set(both)


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9, 0.97):
        union = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        cut_at = int(1000 * (1 - share) / 2)
        a, b = near_dup.odd_sketch(near_dup.minhash(union[cut_at:])), near_dup.odd_sketch(near_dup.minhash(union[: 1000 - cut_at]))
        assert np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum() <= near_dup.sketch_limit(share)


PAGE = """<html><head><title>Site</title><script>var a="</p><article>";</script></head><body><nav><ul><li><a href=x>Home</a><li>More</ul></nav><div class="ad">Buy</div>
<article><h1>A  title</h1><p>First &amp; second<br>line.<div class="comments"><p>nice post, thanks</p></div><p>Last \n one &eacute;.</article><footer>&copy; me</footer>"""


def test_html(spark):
    plain = "<body><div id='menu'><a>Home</a> <a>News</a></div><div><p>Long text of a page without an article, with many words.</p><p>And more of it.</p></div><footer>Imprint</footer>"
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, "v", None, 0), (3, None, "", 0), (4, "w", plain, 0), (4, "w", plain, 0)], "page_id long, url string, html string, text int")
    got = html_text.extract_text(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5
    assert by[1].text == "A title\nFirst & second line.\nLast one é." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == ""
    assert by[4].text == "Long text of a page without an article, with many words.\nAnd more of it."
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "inside, want",
    [(f"<{n}-x name=x></{n}-x>", "A\nB rest") for n in ("svg", "video", "template", "style", "script", "math", "object")]
    + [(f"<{n} class=i/>", "A\nB rest") for n in ("svg", "math")]
    + [(f"<{n} class=i>gone</{n}>", "A\nB rest") for n in ("svg", "video", "template", "noscript", "object", "canvas", "audio", "style", "script", "textarea", "iframe")]
    + [(f"<div><{n}>gone</div>", "A\nB rest") for n in ("video", "template", "noscript", "object", "canvas", "audio", "svg")]
    + [(f"<{n} class=i>lost", "A") for n in ("script", "style", "textarea", "iframe")]
    + [
        ("<svg class='i' />mid<svg></svg>", "A\nmid\nB rest"),
        ("<svg><style/><title>t</title><path d='x'/>", "A\nB rest"),
        ("<svg><style>p>q {}</style><foreignObject><p>gone</p></foreignObject></svg>", "A\nB rest"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>", "A\nif x=2 then\nB rest"),
        ("<script>'</p>' <b></script x>", "A\nB rest"),
    ],
)
def test_html_elements_that_are_passed_over(inside, want):
    assert html_text.extract(f"<article><p>A</p>{inside}<p>B rest</p></article>", {}) == want


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in corpus(seed=2) if r[0] is not None] + [(900, "don't <|endoftext|> Ünï x\ty")]
    random.Random(0).shuffle(rows)
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs_of(spark, rows), path, WORDS)
    got = {r.doc_id: r for r in token_files.token_positions(spark, path).collect()}
    encode, start = Tokenizer.from_file(WORDS), 0
    for i, t in sorted(rows):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_files.read_tokens(spark, path).where("doc_id = 900").select("tokens").first()
    assert one.tokens[-1] == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_token_starts_with_shared_ids(spark, tmp_path, parts):
    rows = [(3, "a b c d"), (3, "one"), (3, "a b c d"), (3, "two words"), (3, None), (None, "none"), (None, "also none"), (1, "first"), (9, "last one")]
    path, partitions = f"file://{tmp_path}/tokens", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        token_files.write_tokens(docs_of(spark, rows), path, WORDS)
        got = token_files.token_positions(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    stored = token_files.read_tokens(spark, path).orderBy("file_part", "position").collect()
    whole = [i for r in stored for i in r.tokens]
    assert [r.doc_id for r in stored] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == len(whole) and len({r.start for r in got}) == len(rows)
    for r in got:  # the tokens of each row stand where it says
        assert zlib.crc32(np.array(whole[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_top_inner_products(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [1.0, float("inf")]), (404, []), (405, [2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    real = {i: np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64), (0, 6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_inner.top_inner_products(df).collect())
    want = []
    for q in sorted(real):
        if q % 50 == 0:
            best = sorted((-int(real[q] @ x), i) for i, x in real.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert top_inner.top_inner_products(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [(2048, 4096, 512), (8, 4, 2)])
def test_top_inner_products_of_shared_ids_and_uneven_lengths(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK", "QUERY_BLOCK", "AT_ONCE"), blocks, strict=True):
        monkeypatch.setattr(top_inner, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 9 else 50, [float(x) for x in rng.normal(size=20) * rng.choice([0.01, 1, 1, 40])]) for i in range(300)]
    rows += [(50, rows[0][1]), (100, [0.0] * 20), (150, [9e6] * 20)]
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    want = Counter()
    for i, (query, _) in enumerate(rows):
        if query % 50 == 0:
            best = sorted((-int(x[i] @ x[j]), vec) for j, (vec, _) in enumerate(rows) if j != i)[:5]
            want.update((query, k + 1, vec, -score) for k, (score, vec) in enumerate(best))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in top_inner.top_inner_products(df).collect()) == want


def test_toxicity_learns_pairs_and_keeps_held_out_rows_out(spark):
    rng = random.Random(0)
    common = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(common) for _ in range(30)]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words += ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b), 0))
    rows += [(5000, None), (5001, "")]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (6000, None, 0)], "doc_id long, toxic int, text int")
    machine = toxicity.fit(docs, known.where(~toxicity.held_out()))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, machine).collect()}
    unseen = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s > 0.5) == y for s, y in unseen]) > 0.97
    assert 0 <= got[5000] == got[5001] <= 1
    assert toxicity.drop_toxic(docs, machine).count() == sum(s < 0.7 for s in got.values())
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), known.limit(0))).count() == 0


def test_toxicity_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(20)] + ["insult"] * (i % 8 == 0))) for i in range(400)]
    known = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # each file is read by a task of its own
    try:
        docs = spark.createDataFrame(spark.sparkContext.parallelize(docs_of(spark, rows).collect(), 50), DOCS)  # eight rows a task, one of them toxic
        one, many = (toxicity.fit(d, known) for d in (docs.coalesce(1), docs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    _, bucket = toxicity._terms(pa.array(["insult"]))
    assert (many.slot[bucket] >= 0).all()
    assert (one.slot == many.slot).all() and one.bias == many.bias
    assert (one.weight == many.weight).all() and (one.factor == many.factor).all()


def test_licenses(spark):
    text = "Ä first line.\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT licence. Released under the mit License! All rights reserved."
    got = licenses.find_licenses(docs_of(spark, [(1, text), (2, None), (3, ""), (1, text), (4, "Released by the MIT")])).collect()
    found = Counter((r.doc_id, r.license, text[r.start : r.end], r.n_matched) for r in got)
    assert found == {
        (1, "gpl-3-notice", "This work is licensed under the GNU General Public License, version 3", 12): 2,
        (1, "mit-notice", "Released under the MIT", 4): 2,
        (1, "mit-notice", "Released under the mit License", 5): 2,
        (1, "all-rights-reserved", "All rights reserved", 3): 2,
    }


def test_alignment_is_the_best_in_the_band():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        start = rng.randint(-2, 4)
        score = {}
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and abs(j - start - i) <= licenses.BAND:
                    score[i, j] = 2 + max([0, *(s - (i - x - 1) - (j - y - 1) for (x, y), s in score.items() if x < i and y < j)])
        matched, first, last = licenses.align(np.array(a, np.uint64), np.array(b, np.uint64), start)
        assert bool(matched) == bool(score)
        if matched:
            assert 0 <= first <= last < len(b) and 2 * matched >= max(score.values())


@pytest.mark.parametrize("name", ["mit", "bsd-3-clause", "zlib", "isc", "unlicense-whole"])
def test_whole_license_texts_with_changes(spark, name):
    rng = random.Random(name)
    words = re.findall(r"[A-Za-z0-9]+", licenses.TEMPLATES[name])
    before, after = [f"p{rng.randrange(99)}" for _ in range(300)], [f"q{rng.randrange(99)}" for _ in range(300)]
    own = list(words)
    for k in sorted(rng.sample(range(5, len(own) - 5), 5), reverse=True):  # some words changed, one lost, one more
        own[k] = "zzz"
    del own[20]
    own.insert(60, "extra")
    text = " ".join(before) + " " + " ".join(own) + "! " + " ".join(after)
    rows = spark.createDataFrame([(1, text), (2, " ".join(before + words[: len(words) // 2] + after))], "doc_id long, text string")
    got = [r for r in licenses.find_licenses(rows).collect() if r.license == name]
    assert len(got) == 1 and got[0].doc_id == 1
    assert text[got[0].start : got[0].end] == " ".join(own)
    left = Counter(own)
    assert len(words) - 6 <= got[0].n_matched <= sum(min(n, left[w]) for w, n in Counter(words).items()) and got[0].coverage == got[0].n_matched / len(words)


def test_every_place_of_a_template_is_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    table = {f"t{k}": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for k in range(12)}
    rows, want = [], Counter()
    for i in range(60):
        words, spans = [f"x{rng.randrange(500)}" for _ in range(rng.randint(0, 40))], []
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(sorted(table))
            spans.append((name, len(words), len(words) + len(table[name].split())))
            words += table[name].split() + [f"y{k}" for k in range(30)]
        rows.append((i, " ".join(words)))
        at = np.cumsum([0, *(len(w) + 1 for w in words)])
        want.update((i, name, int(at[a]), int(at[b]) - 1) for name, a, b in spans)
    templates = spark.createDataFrame([*table.items(), (None, "x"), ("none", None)], "license string, text string")
    found = licenses.find_licenses(docs_of(spark, rows), templates, coverage=1.0).collect()
    assert not want - Counter((r.doc_id, r.license, r.start, r.end) for r in found)
    for r in found:  # what else is found holds all words in their order
        rest = iter(rows[r.doc_id][1][r.start : r.end].split())
        assert r.n_matched == len(table[r.license].split()) and all(w in rest for w in table[r.license].split())


def test_secrets_against_plain_searches(spark):
    rng = random.Random(12)
    bits = ["password", "Secret", "token", "api_key", "=", ": ", '"', " ", "\n", "AKIA", "Z9Z9Z9Z9Z9Z9", "0123abcd" * 4, "hunter2hunter2", "é", "user=bob", "https://a.example/path", "qZ7xK2mN9pR4sT6vW8yB", "x " * 130]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs = docs_of(spark, rows).withColumn("spans", F.lit("s")).withColumn("n_hex", F.lit(1)).withColumn("base_sha256", F.lit(2))
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for i, text in rows:
        base = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        order = {"assign": 0, "access": 1, "hex": 2}
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base, key=lambda s: (s[0], order[s[2]])))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for *_, k in base) for kind in order)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s)]
        assert [s for s in spans if s[0] in order] == [(k, a, b) for a, b, k in sorted(base, key=lambda s: (s[0], order[s[2]]))]
        kinds = secrets.weak_candidates(text, secrets.base_spans(text))
        near = lambda p, q: p[0] <= q[1] + secrets.REACH and q[0] <= p[1] + secrets.REACH
        parts = [(a, b, secrets.ORDER[k]) for a, b, k in kinds] + base
        for a, b, k in kinds:  # every pair of parts, one by one
            other = ("access", "id", "endpoint") if secrets.ORDER[k] == "weak" else ("assign", "hex", "weak")
            assert ((secrets.ORDER[k], a, b) in spans) == any(near((a, b), p) for p in parts if p[2] in other)
    same = secrets.mask_secrets(docs)
    assert same.columns == docs.columns and same.where("spans <> 's' OR n_hex <> 1").count() == 0


def test_secrets(spark):
    key = "AKIA" + "A1" * 8
    text = f'é password = "hunter2hunter2" token:abc {key} {"0f" * 16} user=alice\nqZ7xK2mN9pR4sT6vW8yB https://db.example/x'
    far = "user=alice " + "x " * 400 + "qZ7xK2mN9pR4sT6vW8yB"
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, [(1, text), (2, None), (3, ""), (4, far), (5, "qZ7xK2mN9pR4sT6vW8yB")])).collect()}
    r = got[1]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert {(k, text[int(a) : int(b)]) for k, a, b in spans} == {
        ("assign", 'password = "hunter2hunter2'), ("access", key), ("hex", "0f" * 16), ("id", "user=alice"), ("weak", "qZ7xK2mN9pR4sT6vW8yB"), ("endpoint", "https://db.example/x"),
    }
    base = ",".join(":".join(s) for s in spans if s[0] in ("assign", "access", "hex"))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[4].spans == got[5].spans == ""
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs_of(spark, [(1, text), (2, None)])).collect()}
    assert masked[2] == "" and "hunter2" not in masked[1] and key not in masked[1] and "user=alice" in masked[1]


@pytest.mark.parametrize("block", [400_000, 20])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(8)
    words = ["a", "bb", "ccc", "Dé", "7"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 13, 30]))) for k in range(9)] + [(20, None), (21, ""), (22, "...")]
    rows = [(k, text(rng.randint(0, 60)) + (items[rng.randrange(9)][1] or "")) for k in range(40)] + [(90, None), (91, ""), (1, "dup row a")]
    got = decontaminate.digest(decontaminate.find_contamination(docs_of(spark, rows), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_hit int"))).collect()
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in items:
        w = find(folded(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = Counter()
    for i, t in rows:
        w, hit, who = find(folded(t)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    who |= windows[tuple(w[k : k + m])]
        want[i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter(tuple(r) for r in got) == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(docs_of(spark, rows), empty).collect())
    kept = decontaminate.drop_contaminated(docs_of(spark, rows[:40]), spark.createDataFrame(items, "item_id long, text string")).count()
    assert kept == sum(1 for r in got if not r.contaminated and r.doc_id < 40) - (1 if not [r for r in got if r.doc_id == 1 and r.n_words == 3][0].contaminated else 0)


@pytest.mark.parametrize("block", [400_000, 20])
def test_contaminated_rows_are_dropped_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(12)]
    clean = "nothing of the benchmark"
    rows = [(1, clean), (1, items[3][1]), (None, items[4][1]), (None, clean), (2, None), (3, clean), (3, clean), (4, items[11][1] + " and more")]
    docs = docs_of(spark, rows).withColumn("a.b", F.struct("lang", "key")).withColumn("items", F.lit("x"))
    got = decontaminate.drop_contaminated(docs, spark.createDataFrame(items * 3, "item_id long, text string"))
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = [r for r in docs.collect() if r.text in (None, clean)]
    assert Counter(got.collect()) == Counter(want) and len(want) == 5


def test_a_repeated_item_counts_once_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    items = spark.createDataFrame([(1, "one item of six words only")] * 40, "item_id long, text string")
    blocks = list(decontaminate._blocks(items, 13))
    assert len(blocks) == 1 and list(blocks[0][0].owners.values()) == [{"1"}]


def every_segmentation(model, text):
    """Scores of all segmentations of a text, best first."""

    def walk(unit, at, score):
        if at == len(unit):
            yield score
        else:
            for end, _, gain in model.edges(unit, at):
                yield from walk(unit, end, score + gain)

    found = [0]
    for unit in re.findall(r" *[^ ]+| +", " " + text):
        own = sorted(walk(unit, 0, 0), reverse=True)[:40]
        found = sorted((a + b for a in found for b in own), reverse=True)[:40]
    return found


@pytest.mark.parametrize("text", ["the", "a b", "the cat sat", "on and on", "héy you", "x☃▁y z", "  q r  s ", "aaaa aaa", "ab ab ab ab ab"])
@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_the_best_segmentations_of_several_units(text, n):
    model, want = piece_nbest.pieces(PIECES), every_segmentation(piece_nbest.pieces(PIECES), text)
    for ids, score, others in (model.encode(text, n), model.encode_all(pa.array([text]), n)[0]):
        assert score == want[0] and model.decode(ids) == text
        if n > 1:
            assert [s for s, _ in others] == want[: min(n, len(want))]
        units = re.findall(r" *[^ ]+| +", " " + text)
        for total, changes in others:  # each alternative is a segmentation of the same text, and they differ
            parts = [list(model.encode(u[1:], 1)[0]) if u[:1] == " " and len(u) > 1 else None for u in units]
            for unit, ids_of in changes:
                assert "".join(model.plain[list(ids_of)]) == units[unit] or model.is_byte[list(ids_of)].any()
                parts[unit] = list(ids_of)
        assert len({str(c) for _, c in others}) == len(others)


@pytest.mark.parametrize("text, ways", [("a" * 20_000, 4), ("ab" * 10_000, 4), ("é" * 20_000, 2), ("☃" * 5_000, 1), ("x y " + "z" * 20_000, 4)])
def test_a_long_unit_with_many_ties(text, ways):
    model = piece_nbest.pieces(PIECES)
    ids, score, others = model.encode_all(pa.array([text]), 4)[0]
    assert model.decode(ids) == text and len(others) == ways and others[0][0] == score and len({str(c) for _, c in others}) == ways


def test_pieces(spark):
    rows = [(1, "Hello  wörld \n\t tab▁ ☃ 'x'"), (2, None), (3, ""), (4, " "), (5, "ab " * 4000), (1, "Hello")]
    encoded = piece_nbest.encode_pieces(docs_of(spark, rows), PIECES, n=3)
    back = Counter((r.doc_id, r.text) for r in piece_nbest.decode_pieces(encoded, PIECES).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    checked = {(r.doc_id, r.n_pieces): r for r in piece_nbest.encode_and_decode(docs_of(spark, rows), PIECES, 3).collect()}
    assert all(r.round_trip for r in checked.values())
    for r in encoded.collect():
        other = checked[r.doc_id, len(r.pieces)]
        assert (other.pieces, other.score, other.n_best) == (r.pieces, r.score, r.n_best)
        assert other.best_scores == ",".join(str(x.score) for x in r.n_best)
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, pieces array<int>")
    assert {r.text for r in piece_nbest.decode_pieces(nothing, PIECES).collect()} == {""}


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [1, 3, 8, 10, 24, 30, 71, 100])
def test_suffix_order_is_that_of_the_bytes(length):
    rng = np.random.default_rng(length)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[100:250] = data[:150]
    begin = rng.permutation(len(data) - length + 1)
    ranks = repeats._suffix_order(data, begin, length)
    strings = [data[b : b + length].tobytes() for b in begin]
    place = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert ranks.tolist() == [place[x] for x in strings]


@pytest.mark.parametrize("group", [1000, 1])
def test_repeated_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [r for r in corpus(seed=3) if r[0] is not None] + [(800, "x" * 5000), (801, "ab" * 200 + "c" + "ab" * 120)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == removed(rows, 100)


def test_repeated_bytes_with_shared_and_missing_ids(spark):
    text = "some words of a text " * 3 + "that is longer than a hundred bytes, to be sure of it, by far."
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(docs_of(spark, [(1, text), (1, text), (None, text), (2, None)])).collect())
    n = len(text)
    assert got == [(False, 1, n), (False, 1, n), (False, 2, 0), (True, 0, 0)]
    assert repeats.remove_repeats(docs_of(spark, [(1, text)]).limit(0)).count() == 0


@pytest.mark.parametrize("group", [1000, 1])
def test_rows_of_one_id_take_nothing_from_one_another(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    base = corpus(seed=5)
    rows = [(i if i is None else i % 7, t) for i, t in base] + [(3, t) for _, t in base[:20]] + [(None, t[30:] + t) for _, t in base[:8]] + [(k % 2, "y" * 300) for k in range(4)]
    length, before = 100, lambda i: -1 if i is None else i  # rows without id come first
    least, want = {}, Counter()
    strings = [[data[p : p + length] for p in range(len(data) - length + 1)] for data in ((t or "").encode() for _, t in rows)]
    for (i, _), listed in zip(rows, strings, strict=True):
        for x in listed:
            least[x] = min(before(i), least.get(x, before(i)))
    for (i, t), listed in zip(rows, strings, strict=True):
        data, seen = (t or "").encode(), set()
        gone = bytearray(len(data))
        for p, x in enumerate(listed):
            if x in seen or least[x] < before(i):
                gone[p : p + length] = b"\1" * length
            seen.add(x)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        want[i, len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs_of(spark, rows)).collect()) == want


@pytest.mark.parametrize("operator", ["near", "tokens", "licenses", "secrets", "contamination", "pieces"])
def test_empty_tables(spark, operator, tmp_path):
    empty = docs_of(spark, [(1, "x")]).limit(0)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    if operator == "tokens":
        token_files.write_tokens(empty, f"file://{tmp_path}/t", WORDS)
        assert token_files.token_positions(spark, f"file://{tmp_path}/t").count() == 0
        return
    found = {
        "near": lambda: near_dup.near_duplicates(empty),
        "licenses": lambda: licenses.find_licenses(empty),
        "secrets": lambda: secrets.find_secrets(empty),
        "contamination": lambda: decontaminate.find_contamination(empty, items),
        "pieces": lambda: piece_nbest.encode_pieces(empty, PIECES),
    }[operator]()
    assert found.count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert F is not None
