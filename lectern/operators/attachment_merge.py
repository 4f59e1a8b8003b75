"""Labelled items of an attachment merged into a programme's board, with an audit of what became of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, nfkc

# What kind of thing an attachment's label names.
LABEL_KINDS = {
    "title": ("프로그램명", "강좌명"),
    "target": ("교육대상", "대상", "모집대상", "신청대상"),
    "instructor": ("강사명", "강사성명", "담당강사"),
    "schedule": ("교육기간", "운영기간", "교육일시", "교육시간", "운영횟수", "기간", "시간", "운영시간"),
    "location": ("교육장소", "장소", "운영장소"),
    "fee": ("재료비", "교재비"),
    "capacity": ("수강인원", "참여인원", "모집인원"),
    "materials": ("교재", "준비물", "학습자준비물", "강의실준비"),
    "content": ("프로그램소개", "교육내용", "강의목표", "목표", "참고자료", "강의개요", "강의운영방법", "프로그램개요", "활동계획", "운영내용", "프로그램내용"),
    "online": ("온라인가능여부",),
}
# Cells that are no values, ways to say that a fee is none, and marks of a ticked box.
NOISE_VALUE, NOISE_MATERIALS = "^(?:비고|교수방법|세부 교육내용)$", rf"^(?:/|및){BLANKS}*재{BLANKS}*료{BLANKS}*비|^[0-9]+{BLANKS}|차시{BLANKS}*세부|강의실{BLANKS}*준비"
NO_FEE_SIGN, NO_FEE_WORD, TICK = "^[-ㅡ—–/／]+$", "(?i)^(?:없음|0원|무료)$", rf"[☑✓✔⍔]{BLANKS}*"
SHOWN_TITLE, ONLINE, MATCHED = "첨부 표기명", "온라인 진행 가능", 0.55


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def _alike(a: Column, b: Column) -> Column:
    """Whether one of two comparable texts contains the other (empty ones are like nothing)."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([0-9,]+){BLANKS}*원"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))


def _schools(text: Column) -> Column:
    for long, short in (("초등학생", "초등"), ("중학생", "중등"), ("고등학생", "고등")):
        text = F.replace(text, F.lit(long), F.lit(short))
    return text


def _judged(items: DataFrame, programmes: DataFrame) -> DataFrame:
    """items with the rule that each falls under, before the order of the items counts: act, section, shown label and value, note, basic value."""
    kinds = F.create_map(*[F.lit(x) for kind, labels in LABEL_KINDS.items() for label in labels for x in (label, kind)])
    trimmed = F.regexp_replace(F.col("value"), rf"^{BLANKS}+|{BLANKS}+$", "")
    rows = items.withColumn("kind", F.try_element_at(kinds, F.regexp_replace("label", f"{BLANKS}+", ""))).withColumn("said", trimmed).filter("kind IS NOT NULL AND said <> ''").join(programmes, "key")
    kind, value = F.col("kind"), F.col("value")
    basic = F.when(kind == "fee", F.col("fee"))
    for name in ("title", "target", "capacity", "instructor", "schedule", "location"):
        basic = F.when(kind == name, F.col(name)).otherwise(basic)
    asked = F.when(kind == "target", F.regexp_replace(F.regexp_replace(value, rf"(?s){BLANKS}*[0-9]+{BLANKS}*명.*$", ""), rf"(?s){BLANKS}*온라인{BLANKS}*가능{BLANKS}*여부.*$", "")).otherwise(value)
    side = lambda c: F.when(kind == "target", _schools(F.coalesce(c, F.lit("")))).otherwise(F.coalesce(c, F.lit("")))
    rows = rows.withColumn("basic", basic).withColumn("bare", _bare(value)).withColumn("_known", _bare(side(F.col("basic")))).withColumn("_asked", _bare(side(asked)))
    same, bare = _alike(F.col("_known"), F.col("_asked")), F.col("bare")
    act = lambda name, section=None, label=None, shown=None, note=None: F.struct(F.lit(name).alias("act"), F.lit(section).cast("string").alias("section"), (F.col("label") if label is None else F.lit(label)).alias("shown"), (value if shown is None else shown).alias("put"), (F.lit(note).cast("string") if not isinstance(note, Column) else note).alias("note"))
    noise = ((kind == "materials") & value.rlike(NOISE_MATERIALS)) | F.col("said").rlike(NOISE_VALUE)
    ticked = F.when(value.rlike(TICK + "가능"), "가능").when(value.rlike(TICK + "불가능"), "불가능").when(bare.isin("가능", "불가능"), bare)
    free = F.col("said").rlike(NO_FEE_SIGN) | bare.rlike(NO_FEE_WORD)
    mine, theirs = _amounts(F.col("basic")), _amounts(value)
    known = (F.size(theirs) > 0) & (F.size(F.array_except(theirs, mine)) == 0)
    content = F.when(kind == "content", "content").otherwise("operation")
    placed = F.struct(F.lit("place").alias("act"), content.alias("section"), F.col("label").alias("shown"), value.alias("put"), F.lit(None).cast("string").alias("note"))
    rule = (
        F.when(noise, act("discard", note="TABLE_NOISE"))
        .when(kind == "title", F.when(same, act("skip")).when(F.coalesce("score", F.lit(0.0)) >= MATCHED, act("add", "content", SHOWN_TITLE)).otherwise(act("warn", note="ATTACHMENT_TITLE_CONFLICT")))
        .when(kind == "online", F.when(ticked.isNotNull(), act("supplement", "basicInfo", ONLINE, ticked)).otherwise(act("warn", note="ATTACHMENT_ONLINE_STATUS_AMBIGUOUS")))
        .when((kind == "fee") & free, act("supplement label", "basicInfo", shown=F.when(F.contains(value, F.lit("무료")), "무료").otherwise("없음")))
        .when(kind == "fee", F.when(known, act("skip")).when((F.size(mine) == 0) | (F.size(theirs) == 0), act("place", "operation")).otherwise(act("warn", note="ATTACHMENT_FEE_CONFLICT")))
        .when(kind.isin("target", "capacity", "instructor"), F.when(same, act("skip")).otherwise(act("warn", note=F.concat(F.lit("ATTACHMENT_"), F.upper("kind"), F.lit("_CONFLICT")))))
        .when(kind.isin("schedule", "location"), F.when(same, act("skip")).otherwise(act("supplement value", "basicInfo")))
        .otherwise(placed)
    )
    return rows.withColumn("x", rule).select("key", "n", "label", "value", "basic", "bare", "x.*")


def merge_attachments(programmes: DataFrame, items: DataFrame, board: DataFrame) -> DataFrame:
    """key, added, skipped, discarded, warnings, supplement, items, review of each programme that an attachment has items for.

    programmes: key, title, target, capacity, instructor, schedule, location, fee
    (all as text), score (how well the attachment's section matched).  items: key, n,
    label, value, in the order n.  board: key, n, section, label, value that stand there already.

    By the kind of its label an item repeats what is known (skipped), contradicts it
    (a warning with a code), supplements the basic information or goes into a
    section.  A section takes no value that is like one it has; of two values under
    one label the longer stays and the other is discarded.  Supplements take a
    schedule or place once, a fee that is none once a label.  Unknown labels and
    blank values are passed over.  A programme's items are a few dozen, folded in order inside one expression.
    """
    item = "struct<section:string,label:string,value:string,bare:string>"
    audit = "struct<list:string,section:string,label:string,value:string,note:string,basic:string>"
    state = lambda held: F.struct(F.array().cast(f"array<{item}>").alias("supplement"), held.alias("items"), F.array().cast(f"array<{audit}>").alias("audit"))
    entry = lambda x, value=None: F.struct(x["section"].alias("section"), x["shown"].alias("label"), (x["put"] if value is None else value).alias("value"), x["bare"].alias("bare"))

    def noted(x: Column, name: str, value: Column | None = None, note: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("list"), x["section"].alias("section"), x["shown"].alias("label"), (x["put"] if value is None else value).alias("value"), (x["note"] if note is None else note).alias("note"), x["basic"].alias("basic")).cast(audit)

    def step(s: Column, x: Column) -> Column:
        put = lambda supplement=None, items=None, *notes: F.struct((supplement if supplement is not None else s["supplement"]).alias("supplement"), (items if items is not None else s["items"]).alias("items"), (F.concat(s["audit"], F.array(*notes)) if notes else s["audit"]).alias("audit"))
        with_it = F.concat(s["supplement"], F.array(entry(x).cast(item)))
        fresh_label = ~F.exists(s["supplement"], lambda i: i["label"] == x["shown"])
        fresh_value = ~F.exists(s["supplement"], lambda i: _alike(i["bare"], x["bare"]))
        supplemented = (x["act"] == "supplement") | ((x["act"] == "supplement label") & fresh_label) | ((x["act"] == "supplement value") & fresh_value)
        place = x["act"].isin("place", "add")
        here = lambda i: i["section"] == x["section"]
        like = F.exists(s["items"], lambda i: here(i) & _alike(i["bare"], x["bare"]))
        old = F.try_element_at(F.filter(s["items"], lambda i: here(i) & (i["label"] == x["shown"])), F.lit(1))
        swapped = F.transform(s["items"], lambda i: F.when(here(i) & (i["label"] == x["shown"]), entry(x).cast(item)).otherwise(i))
        longer, displaced = F.length(x["put"]) > F.length(old["value"]), F.lit("DISPLACED_BY_FULLER_VALUE")
        always = x["act"] == "add"  # an attachment's own title is reported whether or not it lands
        return (
            F.when(x["act"].isin("skip", "warn", "discard"), put(None, None, F.struct(*[noted(x, "skipped")[c].alias(c) if c != "list" else x["act"].alias("list") for c in ("list", "section", "label", "value", "note", "basic")]).cast(audit)))
            .when(supplemented, put(with_it, None, noted(x, "added"))).when(~place, put())
            .when(like, F.when(always, put(None, None, noted(x, "added"))).otherwise(put()))
            .when(old.isNull(), put(None, F.concat(s["items"], F.array(entry(x).cast(item))), noted(x, "added")))
            .when(longer, put(None, swapped, noted(x, "added"), noted(x, "discard", old["value"], displaced)))
            .otherwise(F.when(always, put(None, None, noted(x, "added"))).otherwise(put(None, None, noted(x, "discard", None, displaced))))
        )

    judged = _judged(items, programmes)
    ordered = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "act", "section", "shown", "put", "note", "basic", "bare"))).alias("todo"))
    standing = board.withColumn("bare", _bare(F.col("value"))).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "section", "label", "value", "bare"))), lambda i: F.struct(i["section"].alias("section"), i["label"].alias("label"), i["value"].alias("value"), i["bare"].alias("bare"))).alias("held"))
    rows = ordered.join(standing, "key", "left").withColumn("held", F.coalesce("held", F.array()).cast(f"array<{item}>"))
    merged = rows.withColumn("end", F.aggregate("todo", state(F.col("held")), step))
    of = lambda name: F.filter("end.audit", lambda a: a["list"] == name)
    pair = lambda a: F.struct(a["label"].alias("label"), a["value"].alias("value"))
    return merged.select(
        "key", F.transform(of("added"), lambda a: F.struct(a["section"].alias("section"), a["label"].alias("label"), a["value"].alias("value"))).alias("added"), F.transform(of("skip"), pair).alias("skipped"),
        F.transform(of("discard"), lambda a: F.struct(a["label"].alias("label"), a["value"].alias("value"), a["note"].alias("reason"))).alias("discarded"),
        F.transform(of("warn"), lambda a: F.struct(a["note"].alias("code"), a["label"].alias("label"), a["basic"].alias("basic"), a["value"].alias("value"))).alias("warnings"),
        F.transform("end.supplement", pair).alias("supplement"), F.transform("end.items", lambda i: F.struct(i["section"].alias("section"), i["label"].alias("label"), i["value"].alias("value"))).alias("items"),
        F.when(F.size(of("warn")) > 0, "MANUAL_REVIEW_REQUIRED").otherwise("AUTO_REVIEW_CANDIDATE").alias("review"),
    )
