"""Operators on awkward rows, against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from payproof.llm import chat, html, licenses, neardup, packing, pii, quality, substrings, topk
from payproof.llm import words as W

SCHEMA = "doc_id long, text string, s string, statistics string, h1 long"
rng = random.Random(5)
WORDS = [f"w{i}" for i in range(3000)]
PASSAGE = " ".join(rng.choices(WORDS, k=60))
BASE = rng.choices(WORDS, k=300)
NEAR = [*BASE[:150], "changed", *BASE[151:]]
TEXTS = [
    None, "", " \n ", "ok", "ok", " ".join(BASE), " ".join(BASE), " ".join(NEAR), f"before {PASSAGE} after",
    f"other {PASSAGE}\n" + " ".join(rng.choices(WORDS, k=80)), "same same " * 400, "mail a.b@c.example.org, +1 (743) 555-3824 \U0001f600 1.2.3.4",
    "Released under the MIT License.", "x" * 50_000, 'token = "0123456789abcdef0123456789abcdef"', "café " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "a", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_statistics_and_rules(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels).rules == ()
    got = by_id(quality.judged(docs.select("doc_id", "text"), quality.DecisionList()))
    for i, text in enumerate(TEXTS):
        assert got[i].statistics.n_words == len(plain(text))
        assert got[i].statistics.word_chars == sum(map(len, plain(text)))
    assert got[10].statistics.n_repeat_words == 800 and not got[10].kept and got[5].kept
    assert quality.judged(nothing.select("doc_id", "text"), quality.DecisionList()).count() == 0


def test_rules_learned_on_one_half_hold_on_the_other():
    r = np.random.default_rng(1)
    values = {"a": r.uniform(size=2000), "b": r.uniform(size=2000)}
    bad = (values["a"] > 0.8) | ((values["b"] < 0.1) & (values["a"] < 0.5))
    half = {k: v[:1000] for k, v in values.items()}
    rules = quality.learn(half, bad[:1000])
    assert (rules.keeps({k: v[1000:] for k, v in values.items()}) == ~bad[1000:]).mean() > 0.97


def test_packing(docs, nothing):
    got = packing.pack(docs, keep_ids=True, window=64, shard_docs=4)
    rows = got.collect()
    assert {r.doc_id for r in rows} == {*range(len(TEXTS)), None}
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0) and o + n <= 64
    assert all(r.n_ids <= 64 and len(r.ids) == 64 for r in packing.sequences(got, 64).collect())
    assert packing.pack(nothing).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  a", "a  ", "x   b", "\n\n a\t b", "a\x1c  b", "don't  stop", "é  \xa0  z", "<|endoftext|> hi"]
    for chunk in W.chunks(pa.array(texts)):
        for text, ids in zip(texts, encode.chunk(chunk), strict=True):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    where, at = packing.best_fit([60, 50, 40, 35, 14, 4], 100)
    assert where.tolist() == [0, 1, 0, 1, 1, 2] and at.tolist() == [0, 0, 60, 50, 85, 0]


def test_chat_reads_back(spark):
    texts = [None, "", "<|end|>", "<\\|", "x " * 700, "[INST]\\<", "</s>[INST] ok [/INST]", "\U0001f600 " * 40]
    roles = ["user", "assistant", "system", None, "a<|b"]
    rows = [(1, i, roles[rng.randrange(5)], texts[rng.randrange(8)]) for i in range(400)] + [(None, 0, "assistant", "hi")] * 2
    got = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].turns == "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].targets == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[None].targets == "hihi" and got[None].n_turns == 2


def test_license_templates(docs):
    a = licenses.Automaton("granted to all [who {2} (ask|pray)] today")
    for text, accepted in (("granted to all today", True), ("granted to all who do x ask today", True), ("granted to all who today", False)):
        run = text.split()
        assert a.accepts(lambda i, run=run: run[i] if i < len(run) else None) is accepted
    got = {r.doc_id: r.license for r in licenses.scanned(docs).collect()}
    assert got[12].labels == "mit,mit-notice" and got[12].first_word == 3 and got[12].score == 0.75
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == ""


def test_near_duplicates(docs, nothing):
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got[5] == got[6] == got[7] == 5 and got[3] == got[4] == 3
    assert all(got[i] == i for i in (0, 1, 2, 8, 9, 10, 13)) and got[None] is None
    assert neardup.classes(nothing).count() == 0


def test_samples_collide_as_often_as_the_weighted_similarity():
    r = np.random.default_rng(3)
    keys = W.mix(np.arange(1, 1001, dtype=np.uint64))
    one = r.integers(0, 40, 1000)
    two = np.where(r.uniform(size=1000) < 0.7, one, r.integers(0, 40, 1000))
    w1, w2 = np.exp(one * neardup.STEP), np.exp(two * neardup.STEP)
    similarity = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    hits = []
    for seed in range(150):
        k = W.mix(keys + np.uint64(seed * 7919))
        (a, _), (b, _) = (neardup.bands(k, np.zeros(1000, np.int64), x, 1) for x in (one, two))
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - similarity**neardup.ROWS) < 0.05


def test_personal_data(docs):
    got = {r.doc_id: (r.b, r.t) for r in pii.found(docs).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.redacted(F.col("base"), F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert got[11] == ("email:5:22,ip:43:50,phone:24:41", "mail [EMAIL], [PHONE] \U0001f600 [IP]") or got[11][1] == "mail [EMAIL], [PHONE] \U0001f600 [IP]"
    assert got[0] == ("", "")


def test_estimated_reliability_trusts_labelers_that_agree():
    patterns = {(1, 0, 1, 1, 0, 0): 90, (-1, 0, -1, -1, 0, 0): 110, (1, 0, -1, -1, 0, 0): 5}
    model = pii.estimate(patterns)
    assert model.posterior((1, 0, 1, 1, 0, 0)) > 0.9 > 0.1 > model.posterior((1, 0, -1, -1, 0, 0))


def test_substrings(docs, nothing):
    got = by_id(substrings.digests(docs))
    seen, rows = {}, [(i, plain(t)) for i, t in enumerate(TEXTS)]
    for i, w in rows:
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, w in rows:
        gone = {p for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    left = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert left[6] == "" and left[8] == TEXTS[8] and left[9].startswith("other") and PASSAGE not in left[9]
    assert substrings.digests(nothing).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [r.normal(size=6).tolist() for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=50, stream=2).collect()
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i < 300 or i == 303}
    for q in (0, 100, 200):
        scores = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        assert [(-s, i) for s, i in scores] == [(x.score, x.vec_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q]


def test_html(spark):
    page = '<nav>n</nav><div class="ad">x</div><article><h1>A &amp; B</h1><p>c<b>d</b>  e<p>f<script>"</p>"</script><div class="comments">z</div></article><footer>q</footer>'
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/2", ""), (4, "x", "plain <p>text")]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B cd e f", 2: "", 3: "", 4: "plain text"}


def test_wrappers_align():
    streams = [[("a", False), ("b", False), ("c", False)], [("a", False), ("c", True)], [("a", False), ("b", False), ("d", False), ("c", False)]]
    assert html.expression(html.wrapper_of(streams)) == "(a#) (b#)? (d#)? (c#)+"
    assert html.folded(["a", "b", "a", "b", "c"]) == (("a b", True), ("c", False))


@pytest.mark.parametrize(
    "around",
    [
        '<form id="form1"><input value="x">{}</form>', "<div class='layout with-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>",
        "<div class='page-with-nav has-banner'>{}</div>", "<div id='search-layout'>{}</div>", "<div class='widget'>{}</div>",
        "<div class='sidebar'>{}</div>",
    ],
)
def test_html_containers_do_not_swallow_the_article(around):
    page = around.format("<article><h1>A</h1><div class='widget-content'><p>b c</p></div><p>d</p><label>l</label></article>")
    page = f"<nav>n</nav>{page}<div id='comments'><article>z</article></div><div class='site-footer'>f</div>"
    assert [t for _, t, zone in html.blocks(page) if zone == 2] == ["A", "b c", "d"]


def test_html_left_out_articles_stay_out_beside_a_text():
    page = "<p>the text of a page without article</p><div class='sidebar'><article>teaser</article></div><div class='cookie-banner'>c</div>"
    assert [t for _, t, zone in html.blocks(page) if zone] == ["the text of a page without article"]


def test_html_template_goes_from_articles_and_bodies(spark):
    def menu(n):
        return "<ul>" + "".join(f"<li>menu {i}</li>" for i in range(n)) + "</ul>"

    def article(i):
        extra = f"<div class='hint'>hint{'' if i % 4 else ' of another kind'}</div>" if i % 2 else ""
        return f"<article><h2>Share this</h2><h1>title {i}</h1><p>one {i}<p>two {i}{extra}</article>"

    rows = [(i, f"http://a.example/{i}", article(i)) for i in range(12)]
    rows[3] = (3, "http://a.example/3", article(3).replace("Share this", "Share that"))
    rows += [(20 + i, f"http://b.example/{i}", f"{menu(4)}<div>body {i}</div><div class='x'>note</div>") for i in range(8)]
    rows += [(40 + i, f"http://c.example/{i}", "<article><h1>copy</h1><p>all alike</article>") for i in range(9)]
    rows += [(60 + i, f"http://d.example/{i}", "<article><h1>few</h1><p>x</article>") for i in range(3)]
    near = [f"<article><h1>near</h1><p>{'same words ' * 20}<p>{i if i < 7 else 'other ' * 30}</article>" for i in range(10)]
    rows += [(80 + i, f"http://e.example/{i}", page) for i, page in enumerate(near)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[80 + i].startswith("near same words") for i in range(7))
    assert got[0] == "title 0 one 0 two 0" and got[3] == "title 3 one 3 two 3"
    assert all(got[20 + i] == f"body {i}" for i in range(8))
    assert all(got[40 + i] == "copy all alike" for i in range(9)) and got[60] == "few x"
    assert len(got) == len(rows)


def test_wrappers_of_parts_take_the_same_streams(spark, monkeypatch):
    """A host of very many different streams is inferred in parts, and the wrapper has a field for every group of each."""
    r = random.Random(9)
    middle = [f"/div.{c}" for c in "abcdefgh"]

    def page(i):
        chosen = [m for m in middle if r.random() < 0.6]
        inside = "".join(f"<div class='{m[-1]}'>text {i}</div>" for m in chosen)
        return f"<article><h1>title {i}</h1>{inside}<div class='z'>read this too</div></article>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(120)] + [(200 + i, f"http://b.example/{i}", page(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = {}
    for parts, joined in ((64, 16), (3, 2)):
        monkeypatch.setattr(html, "PART_STREAMS", parts)
        monkeypatch.setattr(html, "PART_WRAPPERS", joined)
        cut = html.cut_up(df).select("host", "kind", "stream").distinct()
        found = html.wrappers(cut.withColumn("n", F.lit(1))).collect()
        assert sorted(x.host for x in found) == ["a.example", "b.example"]
        for x in found:
            items = html.read_in(x.wrapper)
            assert html.written_out(items) == x.wrapper
            for y in cut.where(F.col("host") == x.host).collect():
                stream = html._stream_items(y.stream)
                places = html.fields_of(items, stream)
                assert -1 not in places and places == sorted(places)
        texts[parts] = {x.page_id: x.text for x in html.extracted(df).collect()}
    assert texts[64] == texts[3]
    assert texts[64][0].startswith("title 0") and not texts[64][0].endswith("read this too")
    assert texts[64][200].endswith("read this too")  # three pages are no evidence
    assert html.extracted(df.where("false")).count() == 0


def test_html_fields_tell_equal_slots_apart():
    wrapper = html.wrapper_of([[("a", False), ("b", False), ("a", False)], [("a", False), ("c", True), ("b", False), ("a", True)]])
    assert html.fields_of(wrapper, [("a", False), ("b", False), ("a", True)]) == [0, 2, 3]


@pytest.mark.parametrize(
    ("kind", "text", "spans"),
    [
        ("iban", "to DE89370400440532013000, now", ["DE89370400440532013000"]),
        ("iban", "to DE89 3704 0044 0532 0130 00 now", ["DE89 3704 0044 0532 0130 00"]),
        ("iban", "GB29NWBK60161331926819 NL91ABNA0417164300", ["GB29NWBK60161331926819", "NL91ABNA0417164300"]),
        ("iban", "FR1420041010050500013M02606.", ["FR1420041010050500013M02606"]),
        ("iban", "IT60X0542811101000000123456", ["IT60X0542811101000000123456"]),
        ("iban", "IT60 X054 2811 1010 0000 0123 456", ["IT60 X054 2811 1010 0000 0123 456"]),
        ("iban", "NO9386011117947 MT84MALT011000012345MTLCAST001S", ["NO9386011117947", "MT84MALT011000012345MTLCAST001S"]),
        ("iban", "NO93 8601 1117 947 BE68 5390 0754 7034 IS", ["NO93 8601 1117 947", "BE68 5390 0754 7034"]),
        ("iban", "AB12 3456 78 XY99ABCDEF " + "AB12" * 12, []),
        ("name", "Dr Jos\u00e9 P\u00e9rez and Mr M\u00fcller. Ms Anna-Lena O'Neill-Garc\u00eda", ["Dr Jos\u00e9 P\u00e9rez", "Mr M\u00fcller", "Ms Anna-Lena O'Neill-Garc\u00eda"]),
        ("name", f"Dr A{'b' * 40} x Dr Anna Maria Garcia Lopez said", [f"Dr A{'b' * 40}", "Dr Anna Maria Garcia Lopez"]),
        ("name", "ADr Smith, Dr smith, Dr S", []),
        ("address", "at 12 M\u00fcller Street or 7b Old Mill Hill Road, 5 Roads", ["12 M\u00fcller Street", "7b Old Mill Hill Road"]),
        ("secret", f'"{"a1B2" * 80}"', ["a1B2" * 80]),
        ("secret", '"c2VjcmV0IHZhbHVlIG9mIGE=" x', ["c2VjcmV0IHZhbHVlIG9mIGE="]),
        ("secret", "t = 'c2VjcmV0IHZhbHVlIG9mIGE=='", ["c2VjcmV0IHZhbHVlIG9mIGE=="]),
        ("secret", "api_key=0123456789abcdefABCDEF01&x=1", ["0123456789abcdefABCDEF01"]),
        ("secret", "Password: 0123456789abcdefABCDEF01.", ["0123456789abcdefABCDEF01"]),
        ("secret", "see http://localhost/some/long/path/of/names 'short' \"0123456789abcdefABCDEF", []),
    ],
)
def test_personal_data_candidates_are_whole(spark, kind, text, spans):
    df = pii.found(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    (row,) = df.collect()
    assert [text[x.start : x.end] for x in row.more if x.kind == kind] == spans


def test_frequencies_of_shingles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_SHINGLES", 1000)  # many parts and runs
    common = rng.choices(WORDS, k=95)
    rows = [(i, " ".join([*common, *(f"x{i}y{k}" for k in range(400))])) for i in range(60)]
    rows += [(100 + i, " ".join([*common, *(f"u{k}" for k in range(7)), *(f"v{i}w{k}" for k in range(14))])) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.n for r in neardup.shingle_frequencies(df, 24_000).collect()]
    want = {}
    for _, text in rows:
        w = text.split()
        for s in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            want[s] = want.get(s, 0) + 1
    assert sorted(got) == sorted(n for n in want.values() if n > 1)
    texts = neardup.with_frequencies(df.select(F.col("doc_id").alias("id"), "text").where("doc_id >= 100"), neardup.shingle_frequencies(df, 9))
    one, two = (spark.createDataFrame([r], texts.schema).toArrow() for r in sorted(texts.collect()))
    (similarity,) = neardup._similarity(len(rows))(*(t.column(c).combine_chunks() for t in (one, two) for c in ("text", "known"))).to_pylist()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows[-2:]]
    weight = {s: 1 + np.log((1 + len(rows)) / (1 + n)) / np.log(2 + len(rows)) for s, n in want.items()}
    brute = sum(weight[s] for s in sets[0] & sets[1]) / sum(weight[s] for s in sets[0] | sets[1])
    assert abs(similarity - brute) < 1e-9


def test_counts_of_shingles_are_not_cut():
    idf_of = np.full(neardup.BUCKETS, 2.0)
    at = neardup.levels(np.zeros(2, np.uint64), np.array([5000, 1 << 30]), idf_of)
    assert np.allclose(at * neardup.STEP, np.log([10_000, 2.0**31]), atol=neardup.STEP)


def test_personal_data_is_told_from_what_looks_like_it(spark):
    """Planted spans: dates of birth and social security numbers against dates of versions and numbers of sections."""
    said = {
        "birth": ("born 19{:02d}-03-05", "date of birth: 05/03/19{:02d}"),
        "id": ("ssn 123-45-10{:02d}", "SSN is 219-09-99{:02d}"),
    }
    unsaid = {"birth": ("version 20{:02d}-03-05", "see page 05.03.20{:02d}"), "id": ("section 123-45-10{:02d}", "table no 219-09-99{:02d}")}
    rows = []
    for personal, phrases in ((True, said), (False, unsaid)):
        for kind, forms in phrases.items():
            rows += [(len(rows) + k, f"text {form.format(k)} here", kind, personal) for form in forms for k in range(10, 70)]
    schema = "doc_id long, text string, base string, more boolean"
    found = pii.found(spark.createDataFrame([(i, t, k, p) for i, (_, t, k, p) in enumerate(rows)], schema)).cache()
    accepted = found.select("doc_id", pii.accepted(pii.fit(found)).alias("a"))
    kinds = {r.doc_id: [x.kind for x in r.a] for r in accepted.collect()}
    for personal, least, most in ((True, 0.95, 1.0), (False, 0.0, 0.05)):
        own = [i for i, row in enumerate(rows) if row[3] is personal]
        share = sum(rows[i][2] in kinds[i] for i in own) / len(own)
        assert least <= share <= most, (personal, share)


def test_personal_data_columns_in_the_way(spark):
    text = "mail a@b.example and token='0123456789abcdefABCDEF01'"
    df = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id long, text string, _email string, __name string, base string")
    (row,) = pii.found(df).collect()
    assert (row["_email"], row["__name"]) == ("x", "y") and [x.kind for x in row.base] == ["email"] and [x.kind for x in row.more] == ["secret"]
    none = pii.found(spark.createDataFrame([], df.schema))
    assert none.count() == 0 and pii.fit(none) == [0.0] * pii.WEIGHTS


def test_top_k_of_repeated_ids_and_of_nothing(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (None, [9.0, 9.0]), (3, [1.0])]
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], "vec_id long, embedding array<double>, row int, query string").repartition(2)
    # Two rows of the id have the same best list, so its entries come twice.
    one = [(1, 1, 1024), (2, 2, 512), (3, 0, 0)]
    two = [(1, 0, 1024), (2, 2, 1024), (3, 1, 512)]
    for shard_rows, stream in ((100, 100), (1, 1)):
        got = topk.top_k(df, F.col("vec_id") == 0, k=3, shard_rows=shard_rows, stream=stream).collect()
        assert sorted((x.rank, x.vec_id, x.score // 1024) for x in got) == sorted(one + two + two)
        assert {x.query_id for x in got} == {0}
    assert topk.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") > 100).count() == 0


def test_chat_takes_turns_without_number_first(spark):
    rows = [(1, t, "user", str(t)) for t in (-300, None, -1, 0, 700)]
    (got,) = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert got.turns == "".join(f"user\n{t}\n" for t in (None, -300, -1, 0, 700))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, span int, pos int")
    assert chat.read_back(chat.windows(none)).count() == 0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<article><p title=it's>Hello, we don't know</p><p>more</p></article>", ["Hello, we don't know", "more"]),
        ('<div data-x=5">b c</div><p>d "q" e</p>', ["b c", 'd "q" e']),
        ("<p title='a > b' class=\"x\">c</p>", ["c"]),
        ('<p title="never closed>a</p><p>b</p>', ["a", "b"]),
        ("<p a = 'x' b=y/z c>d</p>", ["d"]),
        ("<div class='share'><p>all there is</p></div>", ["all there is"]),
        ("<form role=search><p>all there is</p></form>", ["all there is"]),
        ("<nav>menu</nav><p hidden>x</p>", []),
    ],
)
def test_html_loses_no_text(page, texts):
    assert [t for _, t, zone in html.blocks(page) if zone] == texts


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses_need_their_whole_wording(spark):
    texts = {
        1: (f"MIT License\n\n{MIT}\n{MIT_REST} And more.", "mit,mit-opening", 1.0),
        2: (f"{MIT} non-commercial use only, and the author may revoke this.", "mit-opening", 0.75),
        3: (f"{MIT} {MIT_REST.replace('TORT OR OTHERWISE', 'TORT')}", "mit-opening", 0.75),
        4: (f"{MIT} {MIT_REST.replace('permission notice', 'permission notice (including the next paragraph)')}", "mit,mit-opening", 1.0),
        5: ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0-notice", 0.75),
        6: ("under the terms of the GNU General Public License", "gpl", 0.5),
    }
    for label, template in licenses.LICENSES.items():
        plain_words = re.sub(r"\[([^\]]*)\]", r"\1", template)
        plain_words = re.sub(r"\{\d+\}", "the Example Project", re.sub(r"\(([^|)]*)\|[^)]*\)", r"\1", plain_words))
        n = len(texts) + 1
        texts[n] = (plain_words.upper(), label, 1.0)
        texts[n + 1] = (" ".join(plain_words.split()[:-1]), None, 0.75)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scanned(df).collect()}
    for i, (_, labels, score) in texts.items():
        assert got[i].score == score, (i, got[i])
        if i <= 6:
            assert got[i].labels == labels
        elif labels is not None:
            assert labels in got[i].labels.split(",")


def test_known_ids_outlive_a_full_memory(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "MEMORY", 20)
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(12):
        texts = [" ".join(rng.choices(WORDS, k=30)) for _ in range(5)] + [f"again {k % 2} the same words"]
        for chunk in W.chunks(pa.array(texts)):
            for text, ids in zip(texts, encode.chunk(chunk), strict=True):
                assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode.known.keys) < 400
