"""Fill-in-middle, SimHash links and hard negatives against plain versions, on small fixtures and awkward rows."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from payproof.llm import middle, negatives, simhash
from payproof.llm import words as W
from payproof.llm.queries import queries

rng = random.Random(11)
WORDS = [f"Wort{i}ä" for i in range(500)]
BASE = rng.choices(WORDS, k=400)


def changed(n):
    out = list(BASE)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(WORDS)
    return " ".join(out)


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\ntwo\nthree", "one\ntwo\nthree\n", "a\r\nb\x0bc d\ne", "holds <M> itself\nsecond\n",
    "<\nP>\n<S\n>", "<", "é\U0001f600\n" * 40, "\n".join(rng.choices(WORDS, k=30)), " \t\r\n ", "A b C", "a B c", "x" * 70_000,
    ("y" * 9_000 + "\n") * 30, " ".join(BASE), " ".join(BASE), " ".join(BASE).upper(), *(changed(n) for n in (1, 1, 2, 2, 3, 5, 9)),
]
DOCS = "doc_id long, text string, n string, print string, draws string, cut int, u int, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", "c", 1, 2, "d") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "a", "b", "c", 1, 2, "d"), (5, "another text of the same id", *"abc", 1, 2, "d")]
    rows += [(None, "no id\nat all", *"abc", 1, 2, "d"), (None, " ".join(BASE), *"abc", 1, 2, "d"), (None, None, *"abc", 1, 2, "d")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# Fill-in-middle


def plainly_cut(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 80, "seed": 3}])
def test_middle_equals_a_plain_version(docs, options):
    named = {"spm": "spm_rate"}
    got = middle.transformed(docs, **{named.get(k, k): v for k, v in options.items()}).collect()
    assert got[0].asDict().keys() == {
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256",
    }
    rows = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
    given = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, rows)) == sorted(str(plainly_cut(*g, **options)) for g in given)
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in given)
    assert sorted(r.restored_sha256 for r in got) == texts
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)


def test_middle_of_nothing(no_docs):
    assert middle.transformed(no_docs).count() == 0


def test_rank_index_is_exact_within_its_error():
    r = np.random.default_rng(3)
    for steps in (r.integers(0, 90, 5000), r.integers(0, 20_000, 300), np.ones(4000, int), np.zeros(9, int), np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        index = middle.RankIndex.fit(offsets, 64)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert abs(index.remainder).max() <= 65
    assert len(middle.RankIndex.fit(np.arange(100_000) * 17, 64).first) == 1


def test_boundaries_of_a_chunk():
    texts = ["", "a\nb", "", "\n\n", "c"]
    (chunk,) = W.chunks(pa.array(texts))
    offsets, lines = middle.boundaries(chunk)
    assert offsets.tolist() == [0, 0, 2, 3, 3, 3, 4, 5, 5, 6] and lines.tolist() == [0, 2, 0, 2, 1]


# SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """Rows (id, value) to the least id that links of at most so many differing bits lead to."""
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if None not in (rows[i][0], rows[j][0]) and (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    return [
        None if key is None else min(k for (k, _), g in zip(rows, group, strict=True) if g == own and k is not None)
        for (key, _), own in zip(rows, group, strict=True)
    ]


def test_fingerprints_and_components_equal_a_plain_version(docs):
    given = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    expected = [(k, f"{p:016x}", c) for (k, p), c in zip(given, plain_components(given), strict=True)]
    got = simhash.linked(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert len({c for _, _, c in expected}) < len({p for _, p in given})


def test_query_equals_brute_force(spark, sf):
    """The registered query over its whole table against all pairs."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    given = [(r.doc_id, plain_print(r.text)) for r in rows]
    values = np.array([p for _, p in given], np.uint64)
    ids = np.array([k for k, _ in given])
    least = ids.copy()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    while True:
        after = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (after == least).all():
            break
        least = after
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries()["op12_simhash_near_dedup"](spark, sf).collect()}
    assert got == set(zip(ids.tolist(), values.tolist(), least.tolist(), strict=True))


def test_no_documents_have_no_links(no_docs):
    assert simhash.linked(no_docs).count() == 0


def close_values(n, seed=2):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    while len(out) < n:
        out.add(r.choice(centres) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))))
    return sorted(out)


def test_tree_search_finds_all_within_the_radius():
    values = np.array(close_values(700), np.uint64)
    tree = np.arange(700) % 3
    forest = simhash.Forest(values, tree)
    for radius in (0, 3, 4):
        q, n = forest.search(values, tree, radius)
        near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius) & (tree[:, None] == tree[None, :])
        assert set(zip(q.tolist(), n.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert simhash.Forest(values[:0], tree[:0]).edge.size == 0


@pytest.mark.parametrize("tree_rows", [5, 40, 4096])
def test_shards_of_any_size_lose_no_link(spark, tree_rows, monkeypatch):
    """Small trees: shards are dealt to several of them, and runs to several batches."""
    monkeypatch.setattr(simhash, "BATCH_ROWS", 64)
    values = [*close_values(300), 0, 1, 2**64 - 1]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "print bigint")
    edges = simhash.near(nodes, tree_rows=tree_rows).distinct().collect()
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for e in edges:
        a, b = root(e.u), root(e.v)
        parent[max(a, b)] = min(a, b)
    where = {v: i for i, v in enumerate(signed)}
    got = [where[root(v)] for v in signed]
    names = {}
    got = [names.setdefault(g, i) for i, g in enumerate(got)]
    expected = plain_components(list(enumerate(values)))
    names = {}
    assert got == [names.setdefault(g, i) for i, g in enumerate(expected)]


# Hard negatives


def plainly_mined(rows, step, scale=256, k=5, m=3, low=50, high=95):
    """Rows (vec_id, vector, label); anchors are those whose id step divides."""
    kept = [
        (i, [int(np.floor(scale * float(x))) for x in v], lab)
        for i, v, lab in rows
        if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, (a, va, la) in enumerate(kept):
        if a % step:
            continue
        scored = [
            (-sum(x * y for x, y in zip(va, v, strict=True)), i, lab)
            for j, (i, v, lab) in enumerate(kept)
            if j != n and len(v) == len(va)
        ]
        for p, pid, _ in sorted(s for s in scored if s[2] == la)[:k]:
            window = sorted((s, i) for s, i, lab in scored if lab != la and low * -p <= 100 * -s <= high * -p)
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(window[:m], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row string, v int, anchor string, score int"


def vectors(n, dim, seed=4):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=dim) * 0.1 + 0.3 * (i % 4 == 0)).tolist(), int(r.integers(0, 3))) for i in range(n)]
    same = rows[20][1]
    rows += [(n + i, same, i % 3) for i in range(30)]  # a very common vector: ties
    rows += [(20, same, rows[20][2]), (20, rows[21][1], 1), (None, same, 1), (5, None, 1), (10, same, None)]
    rows += [(10, [None, *same[1:]], 1), (10, [float("nan"), *same[1:]], 1), (10, [float("inf"), *same[1:]], 1), (15, [0.5], 1), (25, [], 1)]
    return rows


@pytest.fixture(scope="module")
def given():
    return vectors(180, 7)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], VECTORS).repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 16, "stream": 10}])
def test_hard_negatives_equal_a_plain_version(spark, given, sizes):
    expected = plainly_mined(given, 5)
    assert expected and mined(spark, given, **sizes) == expected


def test_hard_negatives_with_other_parameters(spark, given):
    expected = plainly_mined(given, 5, scale=1000, k=2, m=6, low=-20, high=120)
    assert mined(spark, given, scale=1000, positives=2, negatives=6, low=-20, high=120) == expected


def test_no_vectors_have_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.25], 1)]) == []  # no anchor


def test_strassen_is_exact():
    r = np.random.default_rng(8)
    for m, k, n in ((1, 1, 1), (33, 47, 65), (64, 64, 64), (70, 130, 37), (0, 5, 9), (40, 17, 200)):
        a, b = r.integers(-(2**20), 2**20, (m, k)), r.integers(-(2**20), 2**20, (k, n))
        assert (negatives.strassen(a, b, 4) == a @ b).all()
    big = np.array([[2**62 // 64] * 64] * 40)
    assert (negatives.strassen(big, np.ones((64, 40), int), 4) == 2**62).all()
    with pytest.raises(OverflowError):
        negatives.products(big, big)


def test_best_takes_ties_in_order_of_columns():
    scores = np.array([[5, 7, 7, 7, 1], [2, 2, 2, 2, 2]])
    taken = np.array([[True, True, False, True, True], [False, False, True, False, False]])
    row, column = negatives.best(scores, taken, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 2)]
