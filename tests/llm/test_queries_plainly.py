"""Registered queries without SQL, and the pipeline, against plain Python over whole small tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from payproof.llm import neardup, packing, quality
from payproof.llm.queries import queries


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def rows_of(spark, sf, name):
    return queries()[name](spark, sf).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def base_counts(text):
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    times = Counter(windows)
    inside = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(found) < 20 or 100 * len(inside) > 30 * len(found)
    return len(found), sum(map(len, found)), symbols, repeated, len(inside), failed


def test_quality_rules(spark, sf, documents):
    got = rows_of(spark, sf, "op1_quality_rules")
    assert len(got) == len(documents)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == base_counts(documents[r.doc_id]) and not (r.kept and r.base_failed)
    assert sum(r.kept for r in got) > len(got) / 2


def check_pieces(got, texts, tokenizer, window=2048):
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for pieces, size in [(sorted(p), len(ids[k])) for k, p in by_doc.items()] + [(sorted(p), None) for p in by_sequence.values()]:
        end = 0
        for start, length in pieces:
            assert start == end
            end += length
        assert end == size if size else end <= window
    return sum(map(len, ids.values())) / (window * len(by_sequence))


def test_packing(spark, sf, documents, tokenizer):
    assert check_pieces(rows_of(spark, sf, "op2_packing"), documents, tokenizer) > 0.97


def test_license_phrases(spark, sf, documents):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in rows_of(spark, sf, "op4_license_scan"):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), documents[r.doc_id])
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, lab) for p, lab in phrases.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base) == (len(found), len(at))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in at}))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    def ok(kind, t):
        digits = re.sub("[^0-9]", "", t)
        return {
            "email": True,
            "ip": kind != "ip" or all(int(p) <= 255 for p in t.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if ok(k, m[0])]


def test_personal_data_base(spark, sf, documents):
    for r in rows_of(spark, sf, "op6_personal_data"):
        spans = base_spans(documents[r.doc_id])
        counts = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert not listed or r.spans.startswith(listed)


def near_classes(texts):
    """The least id that links lead to, of all pairs: weighted Jaccard similarity over runs of five words of 0.8 or more."""
    counts = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        counts[k] = Counter(runs)
    df = Counter(s for c in counts.values() for s in c)
    n = sum(bool(c) for c in counts.values())
    weight = {k: {s: m * (1 + math.log((1 + n) / (1 + df[s])) / math.log(2 + n)) for s, m in c.items()} for k, c in counts.items()}
    total = {k: sum(w.values()) for k, w in weight.items()}
    holders = {}
    for k, w in weight.items():
        for s in w:
            holders.setdefault(s, []).append(k)
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = []
    for k, w in weight.items():
        common = Counter()
        for s, x in w.items():
            for other in holders[s]:
                if other > k:
                    common[other] += min(x, weight[other][s])
        for other, c in common.items():
            similarity = c / (total[k] + total[other] - c)
            if similarity >= 0.8:
                links.append((similarity, k, other))
                a, b = sorted((find(k), find(other)))
                root[b] = a
    return {k: find(k) for k in texts}, links


def test_near_duplicates_find_all_pairs(spark, sf, documents):
    expected, links = near_classes(documents)
    got = {r.doc_id: r.class_id for r in rows_of(spark, sf, "op5_minhash_near_dedup")}
    assert got.keys() == expected.keys() and len(links) >= 5
    missed = [x for x in links if got[x[1]] != got[x[2]]]
    assert len(missed) <= 0.002 * len(links), missed
    # Nothing is tied that no chain of links ties.
    assert all(expected[k] == expected[c] for k, c in got.items())


# The pipeline

rng = random.Random(23)
VOCABULARY = [f"word{i}" for i in range(4000)]
PASSAGE = rng.choices(VOCABULARY, k=70)


def prose(n):
    return rng.choices(VOCABULARY, k=n)


def corpus():
    base = prose(300)
    near = [*base[:100], "changed", *base[101:]]
    texts = [" ".join(prose(120)) for _ in range(12)]
    texts += [" ".join(base), " ".join(base), " ".join(near), " ".join(near).upper()]
    texts += [" ".join([*prose(60), *PASSAGE, *prose(60)]) for _ in range(3)]
    texts += ["too short", None, "", "same eight words again and again they repeat " * 20]
    texts += [" ".join([*prose(40), "mail a.b@c.example.org or +1 (743) 555-3824 from 10.1.2.3", *prose(40)])]
    texts += [" ".join([*prose(30), "4111 1111 1111 1111 and 4111 1111 1111 1112", *prose(30)]), " ".join(prose(3000))]
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    texts = corpus()
    rows = [(k, t, "en", "hot", len(t or ""), "clash") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts_of(df):
    assert tuple(df.columns) == corpus_pipeline.COLUMNS
    return {r.doc_id: r.text for r in df.collect()}


def plain_quality(texts):
    return {k: t for k, t in texts.items() if not base_counts(t or "")[5]}


def plain_near(texts):
    classes, _ = near_classes({k: t or "" for k, t in texts.items()})
    return {k: t for k, t in texts.items() if classes[k] == k}


def plain_cut(texts):
    first = {}
    found = {k: words(t) for k, t in sorted(texts.items())}
    for k, w in found.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    out = {}
    for k, w in found.items():
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        out[k] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[k]
    return out


def plain_redacted(texts):
    out = {}
    for k, t in texts.items():
        at, parts = 0, []
        for s, e, kind in sorted((s, e, kind) for kind, s, e in base_spans(t)):
            if s >= at:
                parts += [t[at:s], f"[{kind.upper()}]"]
                at = e
            else:
                at = max(at, e)
        out[k] = "".join([*parts, t[at:]])
    return out


PLAIN = {"quality_rules": plain_quality, "near_dedup": plain_near, "substring_dedup": plain_cut, "personal_data": plain_redacted}


def test_stages_and_run_equal_plain_versions(spark, small, tokenizer):
    folder, texts = small
    assert [name for name, _ in corpus_pipeline.STAGES] == [*PLAIN, "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    assert quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).rules == ()
    schema = docs.schema
    for name, plain in PLAIN.items():
        expected = plain(texts)
        got = stage(name)(spark, docs, folder)
        assert texts_of(got) == expected, name
        assert [r.n_chars == len(r.text) for r in got.where("text is not null").collect()].count(False) == 0
        assert expected != texts, name  # every stage has something to do
        texts = expected
        docs = spark.createDataFrame([(k, t, "en", "hot", len(t)) for k, t in texts.items()], schema)
    fill = check_pieces(corpus_pipeline.run(spark, folder).collect(), texts, tokenizer)
    assert 0 < fill <= 1
    assert packing.WINDOW == 2048 and neardup.SIMILARITY == 0.8


def test_a_pipeline_of_nothing(spark, small, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small[0]}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
