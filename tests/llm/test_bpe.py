import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from lectern.llm.bpe import ByteBpe, bpe_decode, bpe_encode, pre_tokens
from lectern.llm.queries import op2_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ByteBpe(PATH).ranks, special_tokens={})


def test_cuts_equal_the_pattern():
    rng, pattern = random.Random(4), regex.compile(public_tokenizers.PATTERN)
    pieces = [*"ab's'tre l  \n\t12²!?é’你'll\xa0\x85", "'re", " 'd", "\x1c", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pre_tokens(text) == pattern.findall(text)


def test_matrix_and_long_merges_equal_the_library():
    bpe, library, rng = ByteBpe(PATH), reference(), random.Random(5)
    words = ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 400))) for _ in range(500)] + ["a" * 3000, "ab" * 700]
    for word, ids in zip(words, bpe.encode_words([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word)


def test_odd_rows_round_trip(odd, odd_rows, nothing):
    library = reference()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_encode(odd).collect())
    want = []
    for i, text in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {(r.doc_id, bytes(r.bytes)) for r in bpe_decode(bpe_encode(odd, with_ids=True)).collect()}
    assert back == {(i, (t or "").encode()) for i, t in odd_rows}
    assert bpe_encode(nothing).count() == 0


def test_query_on_a_table(spark):
    folder, library = "/root/testdata/sf0.001", reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2_byte_bpe(spark, folder).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
