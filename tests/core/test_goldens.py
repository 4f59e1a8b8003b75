"""Known facts about the operators, on small frames."""

import datetime
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import programmes as P
from lectern.functions import structures as S
from lectern.functions import text as X
from lectern.operators.board import board_search, chunk_search, embedding_action
from lectern.operators.chunks import MOST, OVERLAP, chunk_documents, chunk_problems, split_text
from lectern.operators.curriculum import merge_items, parse_sections, repair_encoding
from lectern.operators.grouping import group_entities
from lectern.operators.layout import boxes_to_lines
from lectern.operators.merge import diff, merge_columns, soft_delete, upsert
from lectern.operators.ranking import bm25, hybrid_search, policy_rank, retrieval_metrics
from lectern.operators.sequences import diverse_sample, lanes
from lectern.plans import scalars
from lectern.registry import QUERIES
from lectern.sources.files import json_lines, json_records, latest_file, optional_parquet
from lectern.sources.html import table_cells
from lectern.sources.providers import embed, extract_pages, paged
from lectern.streaming.incremental import drained, leases, micro_batches, windowed_counts
from lectern.streaming.keyed_table import KeyedTable

CAND = "program_id string, chunk_id string, chunk_type string, similarity double"


def ranked(spark, rows, policy, **more):
    return policy_rank(spark.createDataFrame(rows, CAND), policy, **more).orderBy("rank").collect()


def test_policies(spark):
    one = ranked(spark, [("a", "1", "CORE", 0.7), ("a", "2", "ATTACHMENT", 0.8)], "baseline")
    assert (one[0].chunk_id, one[0].score) == ("2", 0.8)
    assert ranked(spark, [("a", "2", "ATTACHMENT", 0.8)], "weighted")[0].score == pytest.approx(0.76)
    three = [("a", str(i), "CORE", s) for i, s in enumerate((0.8, 0.7, 0.6))]
    assert ranked(spark, three, "aggregate")[0].score == pytest.approx(0.87)
    for rows in ([("a", "1", "CORE", 0.5), ("b", "2", "CORE", 0.5)], [("b", "2", "CORE", 0.5), ("a", "1", "CORE", 0.5)]):
        assert [r.program_id for r in ranked(spark, rows, "baseline", limit=1)] == ["a"]


def test_label_bonuses_and_hard_filter(spark):
    rows = [("match", "1", "CORE", 0.5, ["SENIOR"], ["DIGITAL"]), ("wrong", "2", "CORE", 0.9, ["CHILD"], ["ART"]), ("unknown", "3", "CORE", 0.4, ["UNKNOWN"], ["UNKNOWN"])]
    frame = spark.createDataFrame(rows, CAND + ", ages array<string>, categories array<string>")
    asked = {"ages": ["SENIOR"], "categories": ["DIGITAL"]}
    soft = {r.program_id: r.score for r in policy_rank(frame, "metadata", asked).collect()}
    assert soft["match"] == pytest.approx(0.58) and "wrong" in soft
    assert {r.program_id for r in policy_rank(frame, "combined", asked).collect()} == {"match", "unknown"}


def test_terms_and_bm25(spark):
    one = spark.createDataFrame([("  초등학생, AI-교실!  ",)], "t string").select(X.terms(F.col("t")).alias("w")).first()
    assert one.w == ["초등학생", "ai", "교실"]
    docs = spark.createDataFrame([("a", "환경 체험 환경"), ("b", "독서 토론")], "k string, t string")
    assert [r.k for r in bm25(docs, "k", "t", ["환경"]).collect()] == ["a"]
    assert bm25(docs, "k", "t", []).count() == 0


def test_metrics(spark):
    rows = [("q", i + 1, r, f"d{i}") for i, r in enumerate((3, 2, 1, 0, 0))] + [("open", 1, None, "x")]
    got = retrieval_metrics(spark.createDataFrame(rows, "q string, rank int, rel int, k string"), "q", "rank", "rel", "k").collect()
    assert len(got) == 1
    assert (got[0].precision_at_5, got[0].ndcg_at_5, got[0].reciprocal_rank, got[0].success_at_3) == (0.4, 1.0, 1.0, 1)


def plain_split(text, header):
    """The chunk rule character by character: every boundary that may count is listed and the first kind that has one wins."""
    total = 1
    for _ in range(4):
        parts, at, tail = [], 0, ""
        while at < len(text):
            room = 2000 - len(header(len(parts), total)) - 2
            free = room - len(tail)
            wish = max(1, min(1500 - (2000 - room) - len(tail), free))
            rest = text[at:]
            size = len(rest)
            if size > free:
                ends = range(1, min(wish, free) + 1)
                blank = [e for e in ends if rest[: e][-2:] == "\n\n" and e - 2 >= int(0.6 * wish)]
                line = [e for e in ends if rest[e - 1] == "\n" and e - 1 >= int(0.6 * wish)]
                sentence = [e for e in ends if rest[e - 1] in ".!?。！？" and e - 1 >= int(0.6 * wish)]
                size = next((x[-1] for x in (blank, line, sentence) if x), free)
            new = rest[:size]
            parts.append((new if new.startswith(tail) else tail + new, at, at + size))
            at += size
            last = new[-150:]
            tail = last.split("\n\n")[-1]
            tail = tail if tail.strip() else ""
        if len(parts) == total:
            break
        total = len(parts)
    return [(f"{header(k, len(parts))}\n\n{x}", a, b) for k, (x, a, b) in enumerate(parts)]


def test_chunks(spark):
    rng = random.Random(4)
    header = lambda k, n: f"a title\npart {k + 1}/{n}"
    texts = ["".join(rng.choice(("word ", "longer words ", ". ", "! ", "。", "\n", "\n\n", "x" * 90, "  ")) for _ in range(n)) for n in (1, 5, 80, 300, 900, 2000) for _ in range(4)] + ["y" * 7000, "z" * 1990]
    for text in texts:
        got = split_text(text, header)
        assert [x[:3] for x in got] == plain_split(text, header)
        assert all(len(x[0]) <= MOST and x[3] <= OVERLAP for x in got)
        assert "".join(text[a:b] for _, a, b, _ in got) == text
    body = "Paragraph one. " * 300
    rows = [(1, "t", "all", "core", "sessions", "f", body), (2, "t", None, None, "", None, None), (3, None, None, "c" * 4001, None, None, "참가 신청서\n" + body), (4, "t", None, "mail a.b@example.com", "x\n강사: 홍길동", None, "  ")]
    frame = chunk_documents(spark.createDataFrame(rows, "k long, n string, a string, c string, s string, f string, b string"), "k", "n", "a", "c", "s", "f", "b")
    got = {}
    for r in frame.orderBy("k", "part").collect():
        got.setdefault(r.k, []).append(r)
    n = len(got[1]) - 2
    assert [r.chunk_key for r in got[1]] == ["core", "sessions", *(f"attachment:1:part:{i}" for i in range(n))] and n > 2 and [r.part for r in got[1]] == list(range(n + 2))
    assert 2 not in got and [(r.chunk_key, r.long) for r in got[3]] == [("core", True)] and not any(r.long for r in got[1])
    assert [r.content.split("\n\n")[-1] for r in got[4]] == ["mail", "x"]
    assert "".join(body.strip()[r.source_start : r.source_end] for r in got[1][2:]) == body.strip()
    assert chunk_problems(frame, "k").count() == 0
    assert chunk_problems(frame.unionByName(frame), "k").first().problems == ["DUPLICATE_CHUNK_KEY", "GAP"]


ANY_BLANK = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def sanitised_by_hand(text, attached):
    """The rule line by line; blanks are those of any script."""
    phone, mail = re.compile(X.PERSONAL_PHONE), re.compile(X.PERSONAL_EMAIL)
    ends = lambda x: re.sub(rf"^{ANY_BLANK}+|{ANY_BLANK}+$", "", x)
    source = ends(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"\r\n?", "\n", text or "")))
    if attached and re.search(X.HIGH_RISK, source):
        return "", ["HIGH_RISK_DOCUMENT"]
    kept, found, hit = [], set(), False
    for line in source.split("\n"):
        has = {n for n, p in (("PHONE", phone), ("EMAIL", mail)) if p.search(line)}
        whole = next((n for n, p in X.PERSONAL_LINES if re.search(p, line)), None)
        hit = hit or bool(has) or whole is not None
        if whole:
            found.add(whole)
        elif has and re.search(X.PERSONAL_ROW, line):
            found |= has | {"PERSONAL_CONTACT_ROW"}
        else:
            found |= has
            line = ends(re.sub(rf"{ANY_BLANK}*[:：]{ANY_BLANK}*$", "", re.sub(rf"{ANY_BLANK}{{2,}}", " ", mail.sub("", phone.sub("", line)))))
            kept += [line] if line else []
    return (ends("\n".join(kept)), sorted(found)) if hit else (source, [])


def test_sanitised_texts(spark):
    rng = random.Random(7)
    parts = ("강사: 홍길동", "문의 02-123-4567", "a.b@example.com", "신청자 이름 홍 010-1234-5678", "생년월일 2000-01-01", "주소 : 서울", "예금주 홍", "just  two   blanks", "", " ", "참가 신청서", "신청서", "전화:010 1234 5678 :", "\x07bell", "1010-1234-5678")
    blanks = [" ", "\u00a0", "\u3000", "\u2003", "\ufeff", "\u2028"]
    texts = ["\n".join(rng.choice(parts[:10] if k % 3 else parts) for _ in range(rng.randint(0, 6))) for k in range(300)] + [None, "", "title\n\n\nbody\r\nend ", "출석부"]
    texts += ["".join(rng.choice(blanks) if c == " " else c for c in t or "") for t in texts] + ["\u00a0a\u3000", "참가\u00a0신청서", "신청자\u3000이름\u3000: 홍길동", "전화 ０１０-1234-5678"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.sanitised(F.col("t"), True).alias("a"), X.sanitised(F.col("t"), False).alias("b"))
    for r in frame.collect():
        text = texts[r.k]
        assert (r.a.text, r.a.categories) == sanitised_by_hand(text, True) == X.sanitise(text, True), repr(text)
        assert (r.b.text, r.b.categories) == sanitised_by_hand(text, False) == X.sanitise(text, False), repr(text)
    again = frame.select(X.sanitised(F.col("a.text"), True).alias("x"), "a.text")
    assert again.filter("x.text <> text").count() == 0
    assert X.sanitise("\u00a0a\u3000", True) == ("a", []) and X.sanitise("참가\u00a0신청서", True) == ("", ["HIGH_RISK_DOCUMENT"]) and X.sanitise("신청자\u3000이름\u3000: 홍길동", False) == ("", ["PERSON_NAME"])


def test_sanitised_documents(spark):
    """The redaction query on all documents, by the rule in plain Python."""
    folder = "/root/testdata/sf0.001"
    line = lambda i: scalars._PERSONAL[i % len(scalars._PERSONAL)]
    texts = {r.doc_id: "\n".join(x for x in (r.text, line(r.doc_id)) if x is not None) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["o_x7_redact_lines"](spark, folder).collect()
    assert {r.doc_id: (r.text, r.categories) for r in got} == {i: sanitised_by_hand(t, True) for i, t in texts.items()}


def test_sanitised_texts_by_guarded_searches(spark):
    """Texts of the signs that the searches are guarded by, and blanks before a line separator at the end."""
    rng = random.Random(11)
    parts = ["0", "02", "010", "1", "-", ")", " ", "  ", "123", "4567", "a", "Z", "@", "a.kr", ".com", ":", "：", "\n", "신청자", "이름", "신청서", "출석부", "주소", "계좌", "가", "강사", "\u3000", "\u00a0", "\x07", "\x7f", "\t", "é"]
    texts = ["a \x85", "a :\x85", "강사\n:", "x02-123-4567", "(02)123-4567 x"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.sanitised(F.col("t"), True).alias("a"), X.sanitised(F.col("t"), False).alias("b"))
    wrong = [texts[r.k] for r in frame.collect() if (r.a.text, r.a.categories) != X.sanitise(texts[r.k], True) or (r.b.text, r.b.categories) != X.sanitise(texts[r.k], False)]
    assert wrong == []


def test_columns_and_plain_functions_agree_on_any_blanks_and_digits(spark):
    rng = random.Random(9)
    pieces = ["초등", "저학년", "고학년", "1~3학년", "４~６학년", "6~7세", " ", "\u00a0", "\u3000", "\x85", "전 연령", "전\u00a0연령", "성인", "어린이", "독서", "２기", "3차", "(가)", "２０２６년"]
    texts = ["초등\u00a0저학년", "독서 ２기"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in frame.select("k", P.query_audience(F.col("t")).alias("a"), P.series_key(F.col("t"), F.array().cast("array<string>")).alias("s")).collect():
        name = re.sub(r"\d{4}년|상반기|하반기", "", re.sub(r"\d+\s*(?:기|차|회|타임|반)", "", re.sub(r"\(.*?\)|\[.*?\]", "", texts[r.k])))
        assert r.a == P.query_audience_of(texts[r.k]) and r.s == re.sub(r"[^\w]", "", name) + "|-", repr(texts[r.k])
    assert P.query_audience_of("초등\u00a0저학년") == "elementary_lower"


def test_search_rules(spark):
    """Concepts and audiences of known queries and texts, and the series of known titles."""
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    asked = P.concepts_of("환경과 만들기")
    assert asked == {"topics": ["environment"], "activities": ["craft"]}
    found = lambda s: {g: P.concepts(F.lit(s), g) for g in P.CONCEPTS}
    assert one(P.concept_adjustment(asked, found("기후 이야기와 종이접기"))).coverage == 1.0
    english = one(P.concept_adjustment(asked, found("English quiz")))
    assert english.coverage == 0.0 and abs(english.adjustment + 0.2) < 1e-9 and english.missing == ["craft", "environment"]
    three = P.concepts_of("그림책 독서 인형극")
    assert abs(one(P.concept_adjustment(three, found("동화구연"))).coverage - 1 / 4) < 1e-9  # 그림책 also names art
    fit = lambda asked, target: one(P.audience_adjustment(asked, P.document_audiences(F.lit(target).cast("string")))).adjustment
    assert [fit("adult", t) for t in ("성인", "지역주민", "유아", None)] == [0.10, 0.08, -0.25, -0.02]
    assert [fit("elementary_lower", t) for t in ("초등 1~3학년", "초등학생", "4~6학년", "누구나")] == [0.14, 0.10, -0.25, 0.06]
    assert [fit(None, "성인"), fit("general", "성인"), fit("general", "누구나")] == [0.0, -0.04, 0.08]
    assert [P.query_audience_of(q) for q in ("초등 저학년 과학", "초등 4~6학년", "아이와 함께", "직장인", "그냥")] == ["elementary_lower", "elementary_upper", "child", "adult", None]
    keys = [one(P.series_key(F.lit(t), P.document_audiences(F.lit("성인")))) for t in ("[특강] 동화나라 3기 (10/15)", "동화나라 2024년 상반기", "동화나라!")]
    assert keys == ["동화나라|adult"] * 3
    items = spark.createDataFrame([(1, "과학 실험", "초등 1~3학년", "s", [1.0, 0.0]), (2, "과학 실험 2기", "초등 1~3학년", "s", [0.9, 0.1]), (3, "과학 실험", "성인", "s", [1.0, 0.0]), (4, "과학관 실험실", None, "s", [0.4, 0.0]), (5, "그림", "초등학생", "s", [1.0, 0.0])], "source_id int, title string, target string, summary string, embedding array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    got = [(r.rank, r.source_id, r.series_count) for r in board_search(items, q, "초등 저학년 과학 실험").collect()]
    assert got == [(1, 1, 2)]  # an adult one, one far from the best and one of other concepts are left out
    assert board_search(items, q.limit(0), "과학").count() == 0


def test_planned_and_guarded_embeddings(spark):
    guard = {"provider": "p", "model": "m", "revision": "r", "version": "v", "dimension": 2}
    base = dict(chunk_id=0, program_id=0, chunk_type="CORE", target="초등", embedding=[1.0, 0.0], status="COMPLETED", embedded_hash="h", content_hash="h", content="x", exists=True, attempted_at=None, **guard)
    changes = [{}, {"status": "FAILED"}, {"model": "n"}, {"revision": None}, {"dimension": 3}, {"embedded_hash": "g"}, {"version": "w"}, {"provider": "q"}]
    rows = [{**base, "chunk_id": i, "program_id": i // 2, **c} for i, c in enumerate([*changes, {"embedding": [0.0, 1.0]}])]
    schema = "chunk_id int, program_id int, chunk_type string, target string, embedding array<double>, status string, embedded_hash string, content_hash string, content string, exists boolean, attempted_at timestamp, provider string, model string, revision string, version string, dimension int"
    frame = spark.createDataFrame([{**r} for r in rows], schema)
    q = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    assert [(r.rank, r.chunk_id, r.candidates) for r in chunk_search(frame, q, guard).collect()] == [(1, 0, 2), (2, 8, 2)]
    assert [r.chunk_id for r in chunk_search(frame, q, guard, threshold=0.5, kind="CORE", target="초등").collect()] == [0] and chunk_search(frame, q, guard, kind="SESSIONS").count() == 0
    now = datetime.datetime(2024, 1, 1, 12)
    plans = [({}, "unchanged"), ({"model": "n"}, "would_update"), ({"exists": None, "status": None}, "would_create"), ({"content": " \n "}, "skipped_empty"), ({"content": None}, "skipped_empty")]
    plans += [({"status": "PROCESSING", "attempted_at": now - datetime.timedelta(minutes=m)}, a) for m, a in ((30, "skipped_recent_processing"), (31, "would_update"))]
    frame = spark.createDataFrame([{**base, "chunk_id": i, **c} for i, (c, _) in enumerate(plans)], schema)
    got = frame.select("chunk_id", embedding_action(guard, F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("a")).collect()
    assert {r.chunk_id: r.a for r in got} == {i: a for i, (_, a) in enumerate(plans)}


def test_hybrid_methods(spark):
    lex = spark.createDataFrame([(1, 1, 9.0), (2, 2, 8.0)], "k int, rank int, score double")
    near = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.8)], "k int, rank int, similarity double")
    records = spark.createDataFrame([(1, "b", ["A"], 1, 2), (2, "a", None, None, None), (3, "c", ["A"], 5, 6)], "k int, group_id string, ages array<string>, grade_min int, grade_max int")
    run = lambda *a, **k: [(r.rank, r.k, r.boosts) for r in hybrid_search(lex, near, records, "k", *a, **k).collect()]
    assert run("BM25", 5) == [(1, 1, []), (2, 2, [])] and run("DENSE", 5) == [(1, 2, []), (2, 3, [])]
    assert run("HYBRID", 5) == [(1, 2, []), (2, 1, []), (3, 3, [])] and run("HYBRID", 1) == [(1, 2, [])]
    assert run("HYBRID_TARGETED", 5, age="A", grade=2) == [(1, 2, []), (2, 1, ["TARGET_AGE_GROUP:+0.002"])]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "d")], "k int, v string")
    assert {r.k: r.status for r in diff(old, new, ["k"], ["v"]).collect()} == {1: "deleted", 2: "unchanged", 3: "updated", 4: "created"}
    assert {(r.k, r.v) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, None), (3, "x"), (4, "d")}
    assert {r.k: r.is_active for r in soft_delete(old, new, ["k"]).collect()} == {1: False, 2: True, 3: True}
    assert {r.k: r.v for r in merge_columns(old, new, ["k"], ["v"]).collect()} == {1: "a", 2: None, 3: "x", 4: "d"}


def test_grouping(spark):
    rows = spark.createDataFrame([(1, "b", "x", 1), (2, "b", "x", 5), (3, "b", "x", 2), (4, "b", "y", 1), (5, "", "x", 1)], "k long, b string, t string, s int")
    blocked = spark.createDataFrame([(1, 3)], "a long, b long")
    got = {r.k: r for r in group_entities(rows, "k", "b", "t", blocked, "s").collect()}
    assert got[1].group_id == got[2].group_id != got[3].group_id
    assert got[1].representative == 2 and got[1].confidence == "HIGH"
    assert got[4].members == got[5].members == 1


def test_text_machines(spark):
    body = "hello\nage: 7\nand up\n[ Notes ]\n- fee : free\nplain"
    got = [(r.section, r.label, r.value) for r in parse_sections(spark.createDataFrame([(1, body), (2, None)], "k long, t string"), "k", "t").orderBy("position").collect()]
    assert got == [("intro", None, "hello"), ("intro", "age", "7 and up"), ("Notes", "fee", "free plain")]
    boxes = [(1, 50.0, 100.0, 60.0, 112.0, "b"), (1, 10.0, 104.0, 20.0, 116.0, "a"), (1, 10.0, 140.0, 20.0, 152.0, "c")]
    frame = spark.createDataFrame(boxes, "k long, left double, top double, right double, bottom double, text string")
    assert [r.text for r in boxes_to_lines(frame, "k").orderBy("line").collect()] == ["a b", "c"]
    broken = "한글".encode("cp949").decode("latin-1")
    assert [r.x for r in spark.createDataFrame([(broken,), ("plain",), (None,)], "t string").select(repair_encoding(F.col("t")).alias("x")).collect()] == ["한글", "plain", None]
    a = spark.createDataFrame([(1, "x", "ab"), (1, "y", "q")], "k int, label string, value string")
    b = spark.createDataFrame([(1, "x", "ABC"), (1, "z", "n")], "k int, label string, value string")
    assert {(r.label, r.value, r.outcome) for r in merge_items(a, b, "k").collect()} == {("x", "ABC", "extended"), ("y", "q", "kept"), ("z", "n", "added")}


def test_redaction_and_dates(spark):
    t = "title\npassword: hunter2\ncall (555) 123-4567 now\nx a.b@example.com"
    rules = (("SECRET", r"(?i)password\s*:"),)
    f = lambda s: spark.createDataFrame([(s,)], "t string").select(X.redact_lines(F.col("t"), rules).alias("r")).first().r
    once = f(t)
    assert f("title\n\nbody").text == "title\n\nbody" and f("password: a.b@example.com\nx").categories == ["SECRET"]
    assert once.text == "title\ncall now\nx" and once.categories == ["EMAIL", "PHONE", "SECRET"]
    assert f(once.text).text == once.text
    days = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-2-9",), (None,)], "d string").select(S.is_calendar_date(F.col("d")).alias("x"))
    assert [r.x for r in days.collect()] == [True, False, False, False]


def test_sequences(spark):
    days = [(1, 0, 5, k) for k in range(7)] + [(1, 6, 7, 99)]
    got = {r.k: r.lane for r in lanes(spark.createDataFrame(days, "g int, a int, b int, k int"), ["g"], "a", "b", "k").collect()}
    assert sorted(v for v in got.values() if v is not None) == [0, 0, 1, 2, 3, 4] and sum(v is None for v in got.values()) == 2
    rng = random.Random(2)
    for n in (1, 7, 40):
        rows = [(k, sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))})) for k in range(n)]
        often, covered, left, want = Counter(x for _, x in rows for x in x), Counter(), list(rows), []
        while left and len(want) < 6:
            best = max(left, key=lambda r: (100 * sum(1 / often[x] for x in r[1] if not covered[x]) + sum(1 / (1 + covered[x]) for x in r[1]), r[0]))
            left.remove(best)
            want.append(best[0])
            covered.update(best[1])
        assert diverse_sample(spark.createDataFrame(rows, "k int, l array<string>"), "l", "k", 6) == want
    assert diverse_sample(spark.createDataFrame([], "k int, l array<string>"), "l", "k", 6) == []


def test_sources(spark, tmp_path):
    (tmp_path / "a-1.json").write_text('{"records": [{"x": 1}, {"x": 2}], "other": 0}')
    (tmp_path / "a-2.json").write_text('{"records": [{"x": 3}]}')
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r.x for r in json_records(spark, str(tmp_path / "a-1.json"), "x: int").collect()) == [1, 2]
    assert sorted(r.x for r in json_lines(spark, str(tmp_path / "l.jsonl"), "x int").collect()) == [1, 2]
    assert latest_file(spark, str(tmp_path), "a-*.json").endswith("a-2.json")
    assert optional_parquet(spark, str(tmp_path / "none"), "x int").count() == 0
    page = "<table><tr><th colspan=2>a&amp;b</th></tr><tr><td>1</td><td>x<br>y</td></tr></table>"
    got = table_cells(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("row_no", "cell_no").collect()
    assert [(r.row_no, r.cell_no, r.header, r.colspan, r.text) for r in got] == [(0, 0, True, 2, "a&b"), (1, 0, False, 1, "1"), (1, 1, False, 1, "xy")]


def test_every_order_becomes_a_table_and_lines(spark):
    folder, orders = "/root/testdata/sf0.001", defaultdict(list)
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").collect():
        orders[r.l_orderkey].append((r.l_linenumber, float(r.l_quantity), r.l_returnflag))
    cells = [(k, i, c, t) for k, rows in orders.items() for i, row in enumerate(sorted((str(n), f) for n, _, f in rows)) for c, t in enumerate(row)]
    assert sorted((r.l_orderkey, r.row_no, r.cell_no, r.text) for r in QUERIES["o_s10_html_tables"](spark, folder).collect()) == sorted(cells)
    lines = []
    for k, rows in orders.items():
        tops = sorted({n for n, _, _ in rows})
        lines += [(k, i, " ".join(f for n, _, f in sorted(rows) if n == top)) for i, top in enumerate(tops)]
    assert sorted((r.l_orderkey, r.line, r.text) for r in QUERIES["o_r9_layout_lines"](spark, folder).collect()) == sorted(lines)


def test_providers(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, " "), (4, "x" * 9000)]
    model = lambda: lambda texts: np.ones((len(texts), 4))
    got = {r.k: r for r in embed(spark.createDataFrame(rows, "k long, t string"), "k", "t", model, 4).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["COMPLETED", "SKIPPED", "SKIPPED", "SKIPPED"] and list(got[1].embedding) == [0.5] * 4
    (tmp_path / "a.bin").write_bytes(b"one\ftwo")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    pages = extract_pages(files, lambda c: c.decode().split("\f")).orderBy("path", "page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, "two"), (0, None)] and "UnicodeDecodeError" in pages[2].failure
    assert paged(spark.createDataFrame([(1,), (2,)], "n int"), "n", lambda n: [{"x": n}] * n, "x long").count() == 3


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "id long, event string, at long"
    spark.createDataFrame([(1, "claim", 1000), (2, "claim", 1000)], kind).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(1, "complete", 1060), (3, "none", 9999)], kind).coalesce(1).write.mode("append").parquet(source)
    table = KeyedTable(spark, target, kind, ["id"], "at", buckets=4)
    q = micro_batches(spark, source, kind).writeStream.foreachBatch(table.sink("in")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.event) for r in table.snapshot().collect()} == {(1, "complete"), (2, "claim"), (3, "none")}
    got = drained(leases(micro_batches(spark, source, kind)), str(tmp_path / "leases"), "update", ["id"]).collect()
    # The second lease has no event of its own after 30 minutes, but time goes on.
    assert {r.id: (r.status, r.since) for r in got} == {1: ("COMPLETED", 1060), 2: ("PENDING", 2800), 3: ("PENDING", 0)}
    spark.createDataFrame([(3, "claim", 100), (4, "claim", 2000), (4, "fail", 2100), (5, "claim", 9000), (6, "none", 10_000)], kind).coalesce(1).write.parquet(str(tmp_path / "more"))
    got = drained(leases(micro_batches(spark, str(tmp_path / "more"), kind)), str(tmp_path / "leases2"), "update", ["id"]).collect()
    assert {r.id: r.status for r in got} == {3: "PENDING", 4: "FAILED", 5: "PROCESSING", 6: "PENDING"}
    stream = micro_batches(spark, source, kind).withColumn("t", F.timestamp_seconds("at"))
    assert sum(r.n for r in drained(windowed_counts(stream, "t", "event"), str(tmp_path / "windows"), "complete", []).collect()) == 4
