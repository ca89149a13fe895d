import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from payproof.llm.pieces import MARK, Pieces, encoded, pieces


def test_round_trip_and_best_score():
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " ", "hello world", "  two  spaces ", "a▁b", "é\U0001f600 \n\tx", "zq" * 300]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert model.decode(ids) == text
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    by_text = {model.letters[i].decode(): s for i, s in score.items()}
    for word in ("hello", "thereupon", "unbelievable"):
        unit = " " + word
        best = [0.0] + [-np.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            best[j] = max([best[i] + by_text[unit[i:j]] for i in range(j) if unit[i:j] in by_text] + [best[j - 1] + model.unknown])
        (ids,) = model.encode([word])
        assert abs(sum(score[i] for i in ids.tolist()) - best[-1]) < 1e-6
    assert MARK == ord("▁")


def test_units_of_every_length_take_the_best_path():
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(4)
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    by_text = {model.letters[i].decode(): s for i, s in score.items()}
    longest = max(map(len, by_text))
    words = ["".join(r.choice(list("eatinsr漢é"), n)) for n in [*range(1, 60), 200, 230, 231]]
    for word, ids in zip(words, model.encode(words), strict=True):
        unit, best = " " + word, [0.0]
        for j in range(1, len(unit) + 1):
            pieces = [best[i] + by_text[unit[i:j]] for i in range(max(0, j - longest), j) if unit[i:j] in by_text]
            best.append(max([*pieces, best[j - 1] + model.unknown]))
        unknown = sum(c not in by_text for c in unit)
        known = sum(score[i] for i in ids.tolist() if i in score)
        assert abs(known + unknown * model.unknown - best[-1]) < 1e-3 and model.decode(ids) == word
    assert [x.tolist() for x in model.encode(words[::-1])][::-1] == [x.tolist() for x in model.encode(words)]


def test_awkward_rows(spark):
    texts = [None, "", " ", "ok", "ok", "▁ ▁", "x" * 40_000, "漢字 " * 500, "a\x00b"]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, encoded2 string")
    got = {r.doc_id: r.encoded for r in encoded(docs).collect()}
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in enumerate(texts):
        assert got[i].round_trip and got[i].n_ids == len(got[i].ids) and model.decode(np.array(got[i].ids, np.int32)) == (text or "")
        assert got[i].ids_crc32 == zlib.crc32(np.array(got[i].ids, "<u4").tobytes())
    assert got[0].n_ids == 0 and got[3] == got[4]
    assert encoded(docs.limit(0), keep_ids=False).select("encoded.*").collect() == []


def test_ids_are_those_of_the_model(sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces(path)
    r = np.random.default_rng(6)
    texts = ["", " ", "  two  spaces ", "\n\tx é\U0001f600", " " * 300, "x" * 5000, "漢字 " * 50, "unbelievable thereupon"]
    texts += ["".join(r.choice(list("  eatinsr漢é.,"), n)) for n in (*range(1, 80), 255, 256, 257, 258, 3000)]
    texts += ["".join(r.choice(list("eatinsr漢é"), n)) for n in (*range(1, 80), 200, 255, 256, 257, 3000)]
    texts += [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if t and chr(MARK) not in t]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == own.encode(text) and model.decode(ids) == text
