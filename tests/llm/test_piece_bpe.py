import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lectern.llm.piece_bpe import PieceBpe, piece_decode, piece_encode
from lectern.llm.queries import op12_piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def bpe():
    return PieceBpe(PATH)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_equal_the_library(bpe, library):
    rng = random.Random(3)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    pieces = [*"ab \t\n,.é你😀\x00\x85\xa0 12", "▁", "  ", "   ", "　", "<0x41>", "<s>", "</s>", "<unk>", "\U0010ffff"]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.5 else rng.choice(names) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(rng.randint(1, 900))) for _ in range(100)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids_of(ids) == library.encode(text)
        assert bpe.decode(ids) == library.decode(ids_of(ids))


def test_long_runs_equal_the_library(bpe, library):
    """Runs of blanks tie in rank at every length, and some pieces come to be after larger ones they are part of."""
    texts = ["x" * 5000, " " * 3000, "hyper" * 800, "\n" * 500, "ab" * 700, " " * 40 + "a" + " " * 40, "apple" * 300 + " " * 17, "你" * 999, "▁" * 50]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids_of(ids) == library.encode(text)
    rng = random.Random(5)
    unsafe = [library.id_to_piece(int(i)) for i in np.flatnonzero(~bpe.safe[: bpe.size])]
    texts = ["".join(rng.choice(unsafe[:400]) for _ in range(rng.randint(1, 40))).replace("▁", " ") for _ in range(500)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids_of(ids) == library.encode(text)


def test_any_ids_are_decoded_as_the_library_does(bpe, library):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 8))]
        assert bpe.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_odd_rows_round_trip(odd, odd_rows, nothing, library):
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in piece_encode(odd, with_decoded=True).collect())
    want = [(i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd_rows]
    assert got == sorted(want)
    back = {(r.doc_id, r.text) for r in piece_decode(piece_encode(odd)).collect()}
    assert back == {(i, library.decode(library.encode(t or ""))) for i, t in odd_rows}
    assert piece_encode(nothing).count() == 0


def test_null_ids_and_a_very_long_text(spark, library):
    assert [tuple(r) for r in piece_decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == [(1, None), (2, "")]
    text = " ".join(f"wörd{i} é" for i in range(300_000)) + " " * 20_000 + "z" * 20_000
    (row,) = piece_encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_decoded=True).collect()
    assert row.ids == library.encode(text)
    assert row.decoded == text


def test_query_on_a_table(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_piece_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *sha)
