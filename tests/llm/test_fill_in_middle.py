import hashlib
import random
import re

import pytest

from lectern.llm.fill_in_middle import fill_in_middle, restore
from lectern.llm.queries import op11_fill_in_middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm_share=80):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text, text
    if h[3] % 100 < spm_share:
        return doc_id, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def key(row):
    return tuple((x is None, x) for x in row)


def test_odd_rows(odd, odd_rows, nothing):
    got = restore(fill_in_middle(odd, rate=100)).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(i, t, 100) for i, t in odd_rows), key=key)
    assert restore(fill_in_middle(nothing)).count() == 0


@pytest.mark.parametrize(("rate", "spm_share"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_random_texts(spark, rate, spm_share):
    rng = random.Random(rate + spm_share)
    pieces = [*"ab<>PSM \t\n\x0b\x1c\x85\xa0é你", "<P>", "<S", "<M>", "  ", "😀", "word"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.choice((0, 1, 2, 5, 30))))) for i in range(1500)] + [(2000, None), (None, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = restore(fill_in_middle(frame, rate=rate, spm_share=spm_share)).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(i, t, rate, spm_share) for i, t in rows), key=key)


def test_restore_of_what_was_not_made_here(spark):
    rows = [("psm", "<P>a<S>c"), ("psm", "x<P>a<S>c<M>b"), ("spm", "<P>a<S>c<M>b"), ("psm", "<P>a<S>c<M>b<M>"), ("other", "a"), (None, "a"), ("plain", None), ("spm", "<S>c<P>a<M>b"), ("psm", "<P><S><M>"), ("plain", "<P>")]
    got = [r.restored for r in restore(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, form string, output string")).orderBy("i").collect()]
    assert got == [None] * 7 + ["abc", "", "<P>"]


def test_a_very_long_text(spark):
    text = " ".join(f"wörd{i}" for i in range(900_000))
    frame = spark.createDataFrame([(i, text if i == 3 else "x y z") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in restore(fill_in_middle(frame, rate=100)).collect()}
    assert got == {i: brute(i, text if i == 3 else "x y z", 100) for i in range(6)}


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_fill_in_middle(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        _, n, form, a, b, output, text = brute(r.doc_id, texts[r.doc_id])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text)]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, *sha)
