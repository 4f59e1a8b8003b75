import random
import re
import zlib

import numpy as np

import pytest

from lectern.llm import language_id
from lectern.llm.language_id import Parser, SuffixAutomaton, identify_language, keep_identified
from lectern.llm.queries import op1_language_id


def text_of(lang, seed, n=40):
    rng = random.Random(seed)
    parts = ("ka", "lo", "mi") if lang == "aa" else ("str", "eng", "ulf")
    return " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))


@pytest.mark.parametrize("dense", [True, False])
def test_automaton_accepts_exactly_the_substrings(dense):
    rng = random.Random(1)
    word = [rng.randrange(3) for _ in range(60)]
    automaton = SuffixAutomaton(word, 4, dense)
    parts = {tuple(word[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for _ in range(3000):
        probe, state = [rng.randrange(4) for _ in range(rng.randint(1, 6))], 0
        for c in probe:
            state = int(automaton.follow(np.array([state]), np.array([c]))[0]) if state >= 0 else -1
        assert (state >= 0) == (tuple(probe) in parts)


def squeezed(text):
    """Letters lower-cased, every run of anything else one blank."""
    return re.sub(r"[\W\d_]+", " ", text.lower())


def naive_phrases(text, model):
    """Longest matches by substring search, restarted at every stretch."""
    count = 0
    for at in range(0, len(text), language_id.STRETCH):
        rest = text[at : at + language_id.STRETCH]
        while rest:
            n = 1
            while n < len(rest) and rest[: n + 1] in model:
                n += 1
            count, rest = count + 1, rest[n:]
    return count


@pytest.mark.parametrize("cells", [language_id.DENSE_CELLS, 0])
def test_entropies_equal_a_naive_parse(monkeypatch, cells):
    """Also of texts of many stretches, with letters that no language or only another one has."""
    monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
    rng = random.Random(8)
    model = [(name, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(120))) for name, letters in (("aa", "abcde"), ("bb", "cdefgh"), ("cc", "абвгд"))]
    parser = Parser(tuple(model))
    texts = ["".join(rng.choice("abcdefghабвгдzя  1.") for _ in range(n)) for n in (1, 2, 5, 30, 255, 256, 257, 700, 3000)] + [model[0][1], "zzz", "12", ""]
    got = parser.entropies(texts)
    for text, line in zip(texts, got, strict=True):
        own = squeezed(text)
        for (_, known), bits in zip(model, line, strict=True):
            if not own.strip():
                assert np.isinf(bits)
                continue
            assert abs(bits - naive_phrases(own, squeezed(known)) * np.log2(len(squeezed(known))) / len(own)) < 1e-9


def test_many_scripts_and_languages(spark):
    """Seventy languages, some of letters of their own, one only of long texts: all are learned."""
    rng, rows = random.Random(5), []
    alphabets = [[chr(base + k) for k in range(20)] for base in (0x61, 0x430, 0x3B1, 0x5D0, 0x905, 0x3041, 0xAC00)]
    for n in range(70):
        letters = alphabets[n % 7]
        syllables = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)]
        for k in range(6):
            size = 9_000 if n == 69 else 40
            rows.append((10 * n + k, " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(size // 7)), f"l{n:02d}"))
    got = {r.doc_id: r.lang_pred for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == lang for i, lang in held]) > 0.98 and all(got[i] == lang for i, lang in held if lang == "l69")


def test_kept_rows_carry_the_language(spark, odd, odd_rows, nothing):
    rows = [(i, text_of("aa" if i % 2 else "bb", i), "aa" if i % 2 else "bb") for i in range(60)] + [(None, text_of("aa", 99), None), (61, text_of("bb", 98), "aa"), (62, "12", "aa"), (63, None, "bb"), (1, text_of("aa", 1), "aa")]
    got = keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 63 and all(r.lang == ("bb" if "str" in r.text or "eng" in r.text or "ulf" in r.text else "aa") for r in got)
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in odd_rows if t and any(c.isalpha() for c in t))
    with pytest.warns(UserWarning):
        assert keep_identified(nothing).count() == 0
    with pytest.warns(UserWarning):
        assert keep_identified(spark.createDataFrame([(1, "text", None), (2, "12", None)], "doc_id long, text string, lang string")).count() == 1


def test_predictions_and_odd_rows(spark, odd, odd_rows, nothing):
    rows = [(i, text_of("aa" if i % 2 else "bb", i), "aa" if i % 2 else "bb") for i in range(60)] + [(100, None, "aa"), (101, "12 34", "bb"), (102, "", None)]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(60))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify_language(odd).count() == len(odd_rows) and identify_language(nothing).count() == 0


def test_nothing_labelled_is_undetermined(spark):
    frame = spark.createDataFrame([(i, "some text", None) for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify_language(frame).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op1_language_id(spark, folder).collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.97
