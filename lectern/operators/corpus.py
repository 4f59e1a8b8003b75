"""The search corpus: a safety ladder over attachment sections, records that name all their inputs, and what of the lineage dangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, nfkc

# Contacts that leave a search text, in order; lengths of its parts; exceptions that keep a section out.
CONTACTS = tuple(p.replace(r"\s", BLANKS).replace(r"\d", "[0-9]") for p in (
    r"(?i)(?:전화|문의|연락처|담당자|강사)\s*[:：]?\s*[^\n]{0,60}", r"0\d{1,2}(?:[-.)]|\s)?\d{3,4}(?:[-.]|\s)?\d{4}", r"01[016789](?:[-.)]|\s)?\d{3,4}(?:[-.]|\s)?\d{4}",
    r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", "https?://[^" + BLANKS[1:-1] + "]+",
))
# Something that each contact, and a link in brackets, holds: a text without it has none.
CONTACT_SIGN = "(?i)전화|문의|연락처|담당자|강사|0[0-9]|@|http"
MOST_LEXICAL, MOST_DENSE, MOST_ATTACHMENT = 6000, 4000, 3000
FATAL = ("READING_ORDER_UNRESOLVED", "UNDER_SEGMENTATION_RISK", "POSSIBLE_FALSE_ATTACHMENT_LINK")
_DATE = r"(?:\d{4}[.-]\s*)?\d{1,2}[./-]\s*\d{1,2}(?:\s*\([^)]*\))?"
_TIME = r"(?:오전|오후)?\s*\d{1,2}\s*:\s*\d{2}\s*(?:~|〜|-)\s*(?:오전|오후)?\s*\d{1,2}\s*:\s*\d{2}"
_ROUND = r"(?:^|\s|\()(\d{1,2})\s*(?:차|회차|타임)(?=\s|\(|\)|$)"


def _any(pattern: str) -> str:
    return pattern.replace(r"\s", BLANKS).replace(r"\d", "[0-9]")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", "")


def _flat(text: Column) -> Column:
    return _trim(F.regexp_replace(text, f"{BLANKS}+", " "))


def search_text(text: Column) -> Column:
    """A text without contacts and links, blanks collapsed; empty for null."""
    text = F.coalesce(text, F.lit(""))
    out = text
    for pattern in (*CONTACTS, r"(?i)\[[^\]]*https?[^\]]*\]"):
        out = F.regexp_replace(out, pattern, " ")
    return _flat(F.when(text.rlike(CONTACT_SIGN), out).otherwise(text))


def title_signals(title: Column) -> Column:
    """struct(base_title, comparable, occurrence_date, time, round, institution) of a title: what names the programme and what tells one holding of it from another."""
    title = F.coalesce(title, F.lit(""))
    found = lambda pattern, group=0: F.when(title.rlike(pattern), _trim(F.regexp_extract(title, pattern, group)))
    base = F.regexp_replace(title, _any(r"^\s*\[[^\]]+\]\s*"), "")
    for pattern in (_DATE, _TIME + r"(?:\s*\([^)]*\))?", _ROUND, r"[\[\](){}]"):
        base = F.regexp_replace(base, _any(pattern), " ")
    base = F.coalesce(F.nullif(_flat(base), F.lit("")), _trim(title))
    return F.struct(
        base.alias("base_title"), F.regexp_replace(F.lower(nfkc(base)), "[^0-9a-z가-힣]+", "").alias("comparable"), found(_any(_DATE)).alias("occurrence_date"), F.regexp_replace(found(_any(_TIME)), f"{BLANKS}+", "").alias("time"),
        found(_any(_ROUND), 1).try_cast("int").alias("round"), found(_any(r"^\s*\[([^\]]+)\]"), 1).alias("institution"),
    )


def section_safety(candidates: DataFrame, sections: DataFrame, exceptions: DataFrame, fatal: Sequence[str] = FATAL) -> DataFrame:
    """section_id, program_id, source, status, reasons, unit_refs of every candidate link of a section with a programme.

    candidates: section_id, source, program_id, match, conflicts (array), titled.
    sections: section_id, unit_refs.  exceptions: source, code.  The first rule that holds:

    1. an AMBIGUOUS match is for MANUAL_REVIEW,
    2. NO_RELIABLE_MATCH or no programme, 3. an unknown section: CORE_ONLY,
    4. conflicting evidence, 5. fatal exceptions of the source (each a reason): MANUAL_REVIEW,
    6. no title evidence: CORE_ONLY; else SAFE_FOR_CORPUS.
    """
    codes = exceptions.filter(F.col("code").isin(*fatal)).groupBy("source").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # a few codes
    known = sections.select("section_id", "unit_refs", F.lit(True).alias("found"))
    rows = candidates.join(known, "section_id", "left").join(codes, "source", "left")
    one = lambda status, *reasons: F.struct(F.lit(status).alias("status"), F.array(*map(F.lit, sorted(reasons))).alias("reasons"))
    ladder = (
        F.when(F.col("match") == "AMBIGUOUS", one("MANUAL_REVIEW", "AMBIGUOUS_CANDIDATE"))
        .when((F.col("match") == "NO_RELIABLE_MATCH") | F.col("program_id").isNull(), one("CORE_ONLY", "NO_RELIABLE_PROGRAM_CASE_MATCH"))
        .when(F.col("found").isNull(), one("CORE_ONLY", "SECTION_NOT_FOUND"))
        .when(F.coalesce(F.size("conflicts"), F.lit(0)) > 0, one("MANUAL_REVIEW", "EVIDENCE_CONFLICT"))
        .when(F.col("codes").isNotNull(), F.struct(F.lit("MANUAL_REVIEW").alias("status"), F.col("codes").alias("reasons")))
        .when(~F.coalesce("titled", F.lit(False)), one("CORE_ONLY", "TITLE_EVIDENCE_INSUFFICIENT"))
        .otherwise(one("SAFE_FOR_CORPUS", "CANDIDATE_WITH_TITLE_EVIDENCE", "NO_FATAL_REPRESENTATION_EXCEPTION"))
    )
    return rows.withColumn("x", ladder).select("section_id", "program_id", "source", "x.status", "x.reasons", "unit_refs")


def safe_texts(safety: DataFrame, units: DataFrame) -> DataFrame:
    """program_id, section_id, text of the safe sections: their units' search texts in order, at most MOST_ATTACHMENT characters.

    units: unit_id, text.  Sections without any text are left out.
    """
    refs = safety.filter("status = 'SAFE_FOR_CORPUS'").select("program_id", "section_id", F.posexplode("unit_refs").alias("n", "unit_id"))
    # Only what a safe section names is read for contacts; the join leaves it in the order that the grouping and the next join need.
    named = units.join(refs.select("unit_id"), "unit_id", "left_semi")
    said = named.groupBy("unit_id").agg(F.min(F.get(F.filter(F.array(search_text(F.col("text"))), lambda x: x != ""), F.lit(0))).alias("text")).filter("text IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    whole = refs.join(said, "unit_id").groupBy("program_id", "section_id").agg(F.array_join(parts, "\n").alias("text"))
    return whole.withColumn("text", _cut(F.col("text"), MOST_ATTACHMENT))


def _cut(text: Column, most: int) -> Column:
    """A text of at most so many characters; spaces at the cut go, a line break there stays."""
    return F.when(F.length(text) > most, F.rtrim(F.left(text, F.lit(most)))).otherwise(text)


def _record_id(mode: str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", "group_id", F.lit(mode)), 256), F.lit(32))


def corpus_records(programmes: DataFrame, members: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One record a group: corpus_id, group_id, representative, members, title, lexical_text, dense_text, truncated, content_hash.

    programmes: program_id, title, audience, location, notices, starts, ends.
    members: group_id, program_id, representative.  sections: safe_texts, whose text
    goes in by programme and section; without it the core alone makes the record.
    Texts over their length are cut and flagged.
    """
    mode = "core" if sections is None else "safe"
    signals = title_signals(F.col("title"))
    said = members.join(programmes, "program_id").withColumn("signals", F.struct(signals["base_title"].alias("base_title"), signals["institution"].alias("institution")))
    core = said.filter("representative").groupBy("group_id").agg(F.min_by(F.struct("program_id", "signals", "audience", "location", "notices", "starts", "ends"), "program_id").alias("r"))
    titles = said.groupBy("group_id").agg(F.array_sort(F.collect_set(F.nullif("title", F.lit("")))).alias("titles"), F.count("*").alias("members"))
    rows = core.join(titles, "group_id")
    if sections is not None:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("program_id", "section_id", "text"))), lambda x: x["text"])
        rows = rows.join(members.join(sections, "program_id").groupBy("group_id").agg(F.array_join(parts, "\n").alias("attached")), "group_id", "left")
    clean = lambda c: search_text(F.col(f"r.{c}")).alias(c)
    attached = F.coalesce("attached", F.lit("")) if sections is not None else F.lit("")
    rows = rows.select("group_id", F.col("r.program_id").alias("representative"), "members", "titles", "r.signals", F.col("r.signals.base_title").alias("title"), clean("audience"), clean("location"), clean("notices"), "r.starts", "r.ends", attached.alias("attached"))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    period = F.concat("starts", F.when((F.coalesce("ends", F.lit("")) != "") & (F.col("ends") != F.col("starts")), F.concat(F.lit(" ~ "), "ends")).otherwise(""))
    lexical = F.concat_ws(
        "\n", F.concat(F.lit("프로그램명: "), "title"), F.when(F.size("titles") > 1, F.concat(F.lit("원본 제목: "), F.array_join("titles", " / "))), line("대상: ", F.col("audience")), line("기관: ", F.col("signals.institution")),
        line("장소: ", F.col("location")), line("핵심 내용: ", F.col("notices")), line("활동: ", F.col("attached")), line("운영 정보: ", F.when(F.coalesce("starts", F.lit("")) != "", period)),
    )
    has = lambda c, *parts: F.when(F.col(c) != "", F.concat(*parts)).otherwise("")
    dense = F.concat(has("audience", F.col("audience"), F.lit("을 대상으로 하는 ")), F.col("title"), F.lit(" 프로그램이다."), has("location", F.lit(" "), F.col("location"), F.lit("에서 운영된다.")), has("notices", F.lit(" "), F.col("notices")), has("attached", F.lit(" 주요 활동은 "), F.col("attached")))
    made = rows.withColumn("lexical", lexical).withColumn("dense", _flat(dense))
    texts = made.select(_record_id(mode).alias("corpus_id"), "group_id", "representative", "members", "title", _cut(F.col("lexical"), MOST_LEXICAL).alias("lexical_text"), _cut(F.col("dense"), MOST_DENSE).alias("dense_text"), ((F.length("lexical") > MOST_LEXICAL) | (F.length("dense") > MOST_DENSE)).alias("truncated"))
    return texts.withColumn("content_hash", F.sha2(F.to_json(F.struct(*texts.columns)), 256))


def lineage(members: DataFrame, safety: DataFrame) -> DataFrame:
    """corpus_id, kind, ref of everything that a safe record is made of: its programmes, their safe sections and those sections' units."""
    base = members.select(_record_id("safe").alias("corpus_id"), "program_id")
    safe = base.join(safety.filter("status = 'SAFE_FOR_CORPUS'"), "program_id")
    ref = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("ref"))
    named = F.concat(F.array(ref("section", F.col("section_id"))), F.transform(F.coalesce("unit_refs", F.array()), lambda u: ref("unit", u)))
    return base.select("corpus_id", F.inline(F.array(ref("program", F.col("program_id"))))).union(safe.select("corpus_id", F.inline(named))).distinct()


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The references (kind, ref) that no known input (kind, ref) stands behind, with how many records name each."""
    return refs.join(known.select("kind", "ref"), ["kind", "ref"], "left_anti").groupBy("kind", "ref").agg(F.count_distinct("corpus_id").alias("records"))


def corpus_hash(records: DataFrame, key: str = "corpus_id", digest: str = "content_hash") -> DataFrame:
    """One row ``hash``: of all records' digests in the order of their keys, by a tree over the keys' first letters, so no task sees all of them."""
    level = records.select(F.col(key).alias("k"), F.col(digest).alias("h"))
    for size in (4, 2, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n")
        level = level.groupBy(F.left("k", F.lit(size)).alias("up")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("up", "k")
    return level.select(F.col("h").alias("hash"))


def membership_problems(members: DataFrame, programmes: DataFrame) -> DataFrame:
    """program_id, problem of each programme that is in no group or several, and of each group without exactly one representative (program_id null)."""
    each = programmes.select("program_id").distinct().join(members, "program_id", "left")
    groups = F.count_distinct("group_id")
    wrong = each.groupBy("program_id").agg(groups.alias("n")).filter("n <> 1").select("program_id", F.when(F.col("n") == 0, "NO_GROUP").otherwise("SEVERAL_GROUPS").alias("problem"))
    heads = members.groupBy("group_id").agg(F.count_if("representative").alias("n")).filter("n <> 1")
    return wrong.unionByName(heads.select(F.lit(None).cast(wrong.schema["program_id"].dataType).alias("program_id"), F.lit("NOT_ONE_REPRESENTATIVE").alias("problem")))


def representatives(groups: DataFrame, order: Sequence[Column]) -> DataFrame:
    """groups (group_id, program_id, ...) as members: the first of each group by ``order`` is its representative."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*order))
    return groups.select("group_id", "program_id", (place == 1).alias("representative"))
