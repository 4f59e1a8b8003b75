"""The corpus: search texts, title signals, the safety ladder, records and their lineage; counters gathered while tables are written."""

from pyspark.sql import functions as F

from lectern.operators import corpus as C
from lectern.operators.reports import validity_row, verification_report, write_counted


def column(spark, values, f):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_search_texts(spark):
    texts = ["강사: 홍길동\n책", "a 010-1234-5678 b", "x　 y  z", "see https://a.b/c?d now", "m@n.org [링크 http://q] e", "02)123-4567", None, ""]
    assert column(spark, texts, C.search_text) == ["책", "a b", "x y z", "see now", "[링크 e", "", "", ""]


def test_titles(spark):
    titles = ["[우지] 빛 만들기 2차(11:00~12:00)", "독서회 2026. 4/11(토)", "[a]", "오전 9:30 ~ 10:00 (10분) 체험 3타임", "ＡＢ　Ｃ", ""]
    got = column(spark, titles, C.title_signals)
    assert [(x.base_title, x.comparable) for x in got] == [("빛 만들기", "빛만들기"), ("독서회", "독서회"), ("[a]", "a"), ("체험", "체험"), ("ＡＢ Ｃ", "abc"), ("", "")]
    assert [(x.occurrence_date, x.time, x.round, x.institution) for x in got] == [(None, "11:00~12:00", 2, "우지"), ("2026. 4/11(토)", None, None, None), (None, None, None, "a"), (None, "오전9:30~10:00", 3, None), (None,) * 4, (None,) * 4]


CANDIDATES = "section_id string, source string, program_id int, match string, conflicts array<string>, titled boolean"


def inputs(spark):
    rows = [
        ("s1", "x", 1, "CANDIDATE", None, True), ("s2", "x", 1, "AMBIGUOUS", ["c"], True), ("s3", "x", None, "CANDIDATE", [], True), ("s4", "x", 1, "NO_RELIABLE_MATCH", [], True), ("s9", "x", 2, "CANDIDATE", [], True),
        ("s5", "bad", 2, "CANDIDATE", ["c"], True), ("s6", "bad", 2, "CANDIDATE", [], True), ("s7", "x", 2, "CANDIDATE", [], None), ("s8", "mild", 3, "CANDIDATE", [], True),
    ]
    sections = spark.createDataFrame([(f"s{i}", [f"u{i}b", f"u{i}a", "gone"]) for i in range(1, 9)], "section_id string, unit_refs array<string>")
    exceptions = spark.createDataFrame([("bad", "UNDER_SEGMENTATION_RISK"), ("bad", "READING_ORDER_UNRESOLVED"), ("bad", "READING_ORDER_UNRESOLVED"), ("mild", "SMALL"), ("bad", "SMALL")], "source string, code string")
    units = spark.createDataFrame([(f"u{i}{c}", f"{c}{i} 문의: 1") for i in range(1, 9) for c in "ab"] + [("u8a", None)], "unit_id string, text string")
    return spark.createDataFrame(rows, CANDIDATES), sections, exceptions, units


def test_safety_ladder(spark):
    got = {r.section_id: (r.status, r.reasons) for r in C.section_safety(*inputs(spark)[:3]).collect()}
    safe = ("SAFE_FOR_CORPUS", ["CANDIDATE_WITH_TITLE_EVIDENCE", "NO_FATAL_REPRESENTATION_EXCEPTION"])
    assert got == {
        "s1": safe, "s8": safe, "s2": ("MANUAL_REVIEW", ["AMBIGUOUS_CANDIDATE"]), "s3": ("CORE_ONLY", ["NO_RELIABLE_PROGRAM_CASE_MATCH"]), "s4": ("CORE_ONLY", ["NO_RELIABLE_PROGRAM_CASE_MATCH"]), "s5": ("MANUAL_REVIEW", ["EVIDENCE_CONFLICT"]),
        "s6": ("MANUAL_REVIEW", ["READING_ORDER_UNRESOLVED", "UNDER_SEGMENTATION_RISK"]), "s7": ("CORE_ONLY", ["TITLE_EVIDENCE_INSUFFICIENT"]), "s9": ("CORE_ONLY", ["SECTION_NOT_FOUND"]),
    }


PROGRAMMES = "program_id int, title string, audience string, location string, notices string, starts string, ends string"


def test_records_and_lineage(spark):
    candidates, sections, exceptions, units = inputs(spark)
    programmes = spark.createDataFrame([(1, "[관] 책 4/1", "성인", "강당", "오세요", "2026-01-01", "2026-01-02"), (2, "책 4/8", None, None, None, None, None), (3, "그림 " + "가" * 7000, "", None, "", "2026-01-01", "2026-01-01")], PROGRAMMES)
    members = spark.createDataFrame([("g1", 1, True), ("g1", 2, False), ("g2", 3, True)], "group_id string, program_id int, representative boolean")
    safety = C.section_safety(candidates, sections, exceptions)
    texts = C.safe_texts(safety, units)
    assert {(r.program_id, r.section_id, r.text) for r in texts.collect()} == {(1, "s1", "b1\na1"), (3, "s8", "b8\na8")}
    safe = {r.group_id: r for r in C.corpus_records(programmes, members, texts).collect()}
    assert safe["g1"].lexical_text == "프로그램명: 책\n원본 제목: [관] 책 4/1 / 책 4/8\n대상: 성인\n기관: 관\n장소: 강당\n핵심 내용: 오세요\n활동: b1\na1\n운영 정보: 2026-01-01 ~ 2026-01-02"
    assert safe["g1"].dense_text == "성인을 대상으로 하는 책 프로그램이다. 강당에서 운영된다. 오세요 주요 활동은 b1 a1"
    assert (safe["g1"].members, safe["g1"].representative, safe["g1"].truncated) == (2, 1, False)
    assert safe["g2"].truncated and len(safe["g2"].lexical_text) == 6000 and len(safe["g2"].dense_text) == 4000
    core = C.corpus_records(programmes, members)
    assert "활동" not in {r.group_id: r for r in core.collect()}["g1"].lexical_text
    one, other = (C.corpus_hash(C.corpus_records(p, members, texts)).first().hash for p in (programmes, programmes.repartition(5)))
    assert one == other != C.corpus_hash(core).first().hash
    refs = C.lineage(members, safety)
    assert refs.count() == 3 + 2 + 6
    known = units.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("ref")).union(sections.select(F.lit("section"), "section_id")).union(programmes.select(F.lit("program"), F.col("program_id").cast("string")))
    assert [tuple(r) for r in C.dangling(refs, known).collect()] == [("unit", "gone", 2)]


def test_lineage_takes_one_join_and_only_named_units_are_read(spark, capsys):
    candidates, sections, exceptions, units = inputs(spark)
    safety = C.section_safety(candidates, sections, exceptions).localCheckpoint()
    C.lineage(spark.createDataFrame([("g1", 1, True)], "group_id string, program_id int, representative boolean"), safety).explain("simple")
    assert capsys.readouterr().out.count("Join") == 1
    C.safe_texts(safety, units.localCheckpoint()).explain("simple")
    assert "LeftSemi" in capsys.readouterr().out


def test_texts_without_a_contact_sign_hold_no_contact(spark):
    texts = ["[HTTPS a]", "[a httpx] 책", "0 2-123-4567", "01 0-1234-5678", "0212345678", "ftp://x", "a@b", "강 사: x", "\u3000[x]  y\u00a0"]
    assert column(spark, texts, C.search_text) == ["", "책", "0 2-123-4567", "01 0-1234-5678", "", "ftp://x", "a@b", "강 사: x", "[x] y"]


def test_memberships(spark):
    programmes = spark.createDataFrame([(1,), (2,), (3,)], "program_id int")
    members = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("b", 2, True), ("c", 2, False)], "group_id string, program_id int, representative boolean")
    assert sorted(((r.program_id or 0, r.problem) for r in C.membership_problems(members, programmes).collect())) == [(0, "NOT_ONE_REPRESENTATIVE"), (0, "NOT_ONE_REPRESENTATIVE"), (1, "SEVERAL_GROUPS"), (2, "SEVERAL_GROUPS"), (3, "NO_GROUP")]
    fine = C.representatives(spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "group_id string, program_id int, size int"), [F.desc("size")])
    assert C.membership_problems(fine, programmes).count() == 0


def test_counters_come_with_the_write(spark, tmp_path):
    path = str(tmp_path / "t")
    counts = write_counted(spark.range(10), path, {"n": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)})
    assert counts == {"n": 10, "even": 5} and spark.read.parquet(path).count() == 10
    row = validity_row(spark, counts, {"whole": True, "odd": False}).first()
    assert (row.n, row.even, row.whole, row.odd, row.valid) == (10, 5, True, False, False)
    assert write_counted(spark.range(0), str(tmp_path / "u"), {"n": F.count("*")}) == {"n": 0}


FILES = "id int, program_id int, url string, active boolean, known_program boolean, status string, raw string, cleaned string, extractor string, version string, failure string, attempts int, attempted_at int, extracted_at int, checksum string"


def test_verification(spark):
    rows = [(1, 1, "u", True, True, "COMPLETED", "x" * 60, " ", "e", "1", None, 1, 5, 4, "c"), (2, 2, "u", False, True, "FAILED", None, None, None, None, None, 2, 1, None, "c "), (3, 2, "v", True, False, "FAILED", None, None, None, None, " ", -1, 1, None, None), (4, 2, "v", True, True, "PENDING", None, None, None, None, None, None, None, 3, "d")]
    got = {(r.section, r.metric): r.n for r in verification_report(spark.createDataFrame(rows, FILES)).collect()}
    some = {
        ("totals", "files"): 4, ("totals", "active"): 3, ("totals", "orphans"): 1, ("integrity", "cleaned_blank"): 1, ("integrity", "raw_under_50"): 0, ("integrity", "raw_under_100"): 1, ("times", "extracted_before_last_attempt"): 1, ("times", "pending_but_extracted"): 1,
        ("times", "failed_without_reason"): 1, ("attempts", "suspicious"): 2, ("missing", "checksum"): 1, ("duplicates", "url_groups"): 2, ("duplicates", "program_url_groups"): 1, ("duplicates", "checksum_groups"): 1, ("duplicates", "cross_program_checksums"): 1, ("duplicates", "active_and_inactive_url"): 1,
    }
    assert {k: got[k] for k in some} == some
    assert all(r.n == 0 for r in verification_report(spark.createDataFrame([], FILES)).collect())


def test_a_cut_keeps_the_line_break_it_falls_behind(spark):
    texts = ["abc\nde", "ab  cde", "abcd", "abc　de", None]
    assert column(spark, texts, lambda t: C._cut(t, 4)) == ["abc\n", "ab", "abcd", "abc　", None]
