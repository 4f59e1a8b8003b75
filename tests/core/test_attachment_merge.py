"""What becomes of an attachment's items: known, contradicting, supplementing, placed, displaced or noise."""

from lectern.operators.attachment_merge import merge_attachments

PROGRAMME = "key int, title string, target string, capacity string, instructor string, schedule string, location string, fee string, score double"
BOARD = "key int, n int, section string, label string, value string"


def merged(spark, items, board=(), programme=("책 읽기", "초등학생 1~3학년", "15", "홍길동", "2026-01-01 10:00", "우지 도서관", "재료비 5,000원", 0.9)):
    frames = spark.createDataFrame([(1, *programme)], PROGRAMME), spark.createDataFrame([(1, i, *x) for i, x in enumerate(items)], "key int, n int, label string, value string").repartition(3), spark.createDataFrame([(1, i, *x) for i, x in enumerate(board)], BOARD)
    row = merge_attachments(*frames).first()
    return {c: [tuple(x) for x in row[c]] if isinstance(row[c], list) else row[c] for c in row.asDict()}


def test_audit(spark):
    items = [
        ("프로그램명", "책 읽기!"), ("강좌명", "전혀 다른 이름"), ("대상", "초등 1~3학년 20명"), ("수강 인원", "20"), ("강사명", "홍길동"), ("교육장소", "본관 3층"), ("장소", "본관"), ("교육시간", "10:00"), ("재료비", "5,000 원"), ("교재비", "-"), ("교재비", "무료"),
        ("준비물", "가위"), ("준비물", "가위와 풀, 색종이"), ("준비물", "풀"), ("준비물", "및 재료비"), ("교육내용", "세부 교육내용"), ("프로그램 소개", "함께 읽는다"), ("온라인 가능 여부", "☑ 가능 □ 불가능"), ("온라인가능여부", "모름"), ("모르는 것", "x"), ("목표", "  "), ("학습자 준비물", "연필"),
    ]
    got = merged(spark, items, [("operation", "준비물", "가위 하나")])
    assert got["skipped"] == [("프로그램명", "책 읽기!"), ("대상", "초등 1~3학년 20명"), ("강사명", "홍길동"), ("교육시간", "10:00"), ("재료비", "5,000 원")]
    assert got["warnings"] == [("ATTACHMENT_CAPACITY_CONFLICT", "수강 인원", "15", "20"), ("ATTACHMENT_ONLINE_STATUS_AMBIGUOUS", "온라인가능여부", None, "모름")]
    assert got["supplement"] == [("교육장소", "본관 3층"), ("교재비", "없음"), ("온라인 진행 가능", "가능")]
    assert got["discarded"] == [("준비물", "가위 하나", "DISPLACED_BY_FULLER_VALUE"), ("준비물", "및 재료비", "TABLE_NOISE"), ("교육내용", "세부 교육내용", "TABLE_NOISE")]
    assert got["items"] == [("operation", "준비물", "가위와 풀, 색종이"), ("content", "첨부 표기명", "전혀 다른 이름"), ("content", "프로그램 소개", "함께 읽는다"), ("operation", "학습자 준비물", "연필")]
    assert [a[1] for a in got["added"]] == ["첨부 표기명", "교육장소", "교재비", "준비물", "프로그램 소개", "온라인 진행 가능", "학습자 준비물"]
    assert got["review"] == "MANUAL_REVIEW_REQUIRED"


def test_sparse_programmes(spark):
    got = merged(spark, [("프로그램명", "x y"), ("재료비", "3,000원"), ("장소", "강당"), ("목표", "짧다"), ("목표", "더 긴 목표")], programme=(None,) * 7 + (0.1,))
    assert got["warnings"] == [("ATTACHMENT_TITLE_CONFLICT", "프로그램명", None, "x y")]
    assert got["items"] == [("operation", "재료비", "3,000원"), ("content", "목표", "더 긴 목표")]
    assert got["discarded"] == [("목표", "짧다", "DISPLACED_BY_FULLER_VALUE")]
    got = merged(spark, [("대상", "성인"), ("재료비", "1,000원")], programme=("t", "성인 누구나", None, None, None, None, "2,000원", None))
    assert got["skipped"] == [("대상", "성인")] and [w[0] for w in got["warnings"]] == ["ATTACHMENT_FEE_CONFLICT"]
    empty = merge_attachments(spark.createDataFrame([], PROGRAMME), spark.createDataFrame([], "key int, n int, label string, value string"), spark.createDataFrame([], BOARD))
    assert empty.count() == 0
