import random

import pyarrow as pa
import pytest

from quern.llm.tokens import cut_points, encode_corpus, encoder, split_oversized, tokenizer_dir

HARD = ["'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "a", "b", "é", "е", "中", "\xa0", "\u3000", "1", "23", ".", "!", "'", "’", "#", "\u200b", "😀", "\r\n", "Ω", "<|endoftext|>", "\x85", " ", "\x1c"]


def test_encoding_equals_the_library(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, offsets = encoder().encode(pa.array(texts))
    bpe = encoder().bpe
    assert all(bpe.encode_ordinary(t) == ids[offsets[i] : offsets[i + 1]].tolist() for i, t in enumerate(texts))


def test_encoding_equals_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello  world's\n\n<|endoftext|> x", "naïve ΩΩ 中文字 12:30", ""]
    ids, offsets = encoder().encode(pa.array(texts))
    assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(3)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_row_has_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (None, "c", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or -1, r.ids) for r in encode_corpus(df).collect()), key=str)
    assert len(got) == 5 and [x[1] for x in got if x[0] in (2, 3)] == [[], []]
    assert encode_corpus(df.limit(0)).count() == 0


def test_pieces(spark):
    enc = encoder()
    prose = " ".join(f"Sentence number {i} is here, and it ends." + ("\n\n" if i % 9 == 0 else "") for i in range(600))
    hard = "中" * 3000
    df = spark.createDataFrame([(1, prose, 0), (2, hard, 0), (3, "short", 0), (4, None, 0), (5, "", 0)], "doc_id long, text string, piece int")
    rows = sorted(split_oversized(df).collect(), key=lambda r: (r.doc_id, r.piece))
    assert {r.doc_id for r in rows} == {1, 2}
    for doc, text in ((1, prose), (2, hard)):
        ids, _ = enc.encode(pa.array([text]))
        own = [r for r in rows if r.doc_id == doc]
        assert own[0].first_token == 0 and own[-1].end_token == len(ids)
        assert all(b.first_token == a.end_token - 64 for a, b in zip(own, own[1:])) and all(0 < r.n_tokens <= 768 for r in own)
        joined = own[0].piece_text
        for a, b in zip(own, own[1:]):
            again = enc.bpe.decode(ids[b.first_token : a.end_token].tolist())
            assert b.piece_text.startswith(again)
            joined += b.piece_text[len(again) :]
        assert joined == text
        assert all(len(enc.encode(pa.array([r.piece_text]))[0]) <= 768 for r in own)
    inner = [r.piece_text for r in rows if r.doc_id == 1][:-1]
    assert all(t.rstrip().endswith(".") for t in inner)


def test_cut_points_without_boundaries():
    import numpy as np

    assert cut_points(b"a" * 10, np.ones(10, np.int64), 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert cut_points(b"ab", np.ones(2, np.int64), 4, 1) == [(0, 2)]


def test_a_run_that_fits_a_piece_is_not_torn():
    import numpy as np

    raw = b"ab cd ef. " + b"x" * 14 + b" end of it all"
    pieces = cut_points(raw, np.ones(len(raw), np.int64), 20, 2)
    assert pieces[0] == (0, 9)
    assert any(a <= 10 and 24 <= b for a, b in pieces)


def test_overlap_must_leave_room(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "doc_id long, text string"), limit=10, overlap=5)
