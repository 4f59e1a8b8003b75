"""Typed programme records from crawled posts: dictionary look-ups, labelled body lines, fees, capacity, series and warnings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups of participants, posts that are no programmes, how fees, capacities and repeats are written.
TARGET_GROUPS = ("어린이", "초등학생", "중학생", "일반인", "어르신")
TEST_TITLE = r"(?i)^(?:테스트|test)\s*[0-9]*$"
LABEL_LINE = r"(?U)^([가-힣A-Za-z][가-힣A-Za-z\s]{0,12}?)\s*[:：]\s*(.*)$"
SENTENCE_END = r"(?:습니다|합니다|됩니다|바랍니다|주세요|드립니다|입니다)[.!]?$|다[.!]$"
CONTINUED = r"^[（(\-–—→]"
FEE_LINE = r"(?U)수\s*강\s*료|재\s*료\s*비|교\s*재\s*비|참\s*가\s*비|교육비"
FREE_FEE, PAID_FEE = r"(?:수강료|참가비|교육비)[^.!?。]*무료", r"(?:수강료|참가비|교육비)[^.!?。]*[0-9][0-9,]*원"
MATERIAL_FEE = r"재료비[^.!?。0-9]{0,20}([0-9,]+)원"
DETAIL_CAPACITY = r"(?U)(?:(?:해당\s*강좌는\s*)?([0-9]+)명(?:이|을)?\s*(?:수업\s*가능|추첨)|정원\s*([0-9]+)명)"
OCCURRENCE = "(?U)" + "|".join((
    r"[0-9]{1,2}\s*[/.]\s*[0-9]{1,2}\s*\.?\s*(?:\([월화수목금토일]\))?", r"[0-9]{1,2}\s*월\s*[0-9]{0,2}\s*일?", r"[0-9]{1,2}\s*:\s*[0-9]{2}\s*(?:~\s*[0-9]{1,2}\s*:\s*[0-9]{2})?",
    r"\(?\s*[0-9]{1,2}\s*차\s*\)?", r"\(\s*[0-9]+\s*분\s*\)", r"\([월화수목금토일]요일[^)]*\)",
))
DATE_RANGE = r"(?U)^([0-9]{4}-[0-9]{2}-[0-9]{2})\s*~\s*([0-9]{4}-[0-9]{2}-[0-9]{2})$"
UNNAMED = "미상"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def _or_null(text: Column) -> Column:
    return F.nullif(_trim(text), F.lit(""))


def tag_text(text: Column) -> Column:
    """A tag without brackets, ways of holding and kinds of founder, blanks and case."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?U)비대면\s*-\s*", "")
    out = F.regexp_replace(out, r"(?U)(?:^|[/\s])(?:사립|공립)(?=[/\s]|$)", " ")
    return F.lower(_compact(out))


def _pieces(text: str, lengths: Sequence[int]) -> Column:
    """The distinct pieces of a text that have one of the lengths."""
    none = F.array().cast("array<string>")
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substr(text, at, F.lit(n)))).otherwise(none)
    return F.array_distinct(F.concat(none, *[cut(n) for n in lengths]))


def dictionary_lookup(texts: DataFrame, text: str, entries: DataFrame, negatives: Sequence[str] = ()) -> DataFrame:
    """texts (distinct values of a column) with canonical and known_negative.

    entries: ord, canonical, contains array<string>, equals array<string>.  The
    entry of the smallest ord counts of which an alias in ``contains`` stands
    anywhere in the text, or one in ``equals`` is a whole segment between slashes;
    all compared as tag_text.  A text without an entry that is one of the negatives is known to name none.

    Every piece of a text that is as long as some alias meets the aliases by an
    equality join, so the work does not grow with the dictionary; only the lengths
    of its aliases come to the driver.
    """
    inside = entries.select("ord", "canonical", F.explode("contains").alias("alias")).select("ord", "canonical", tag_text(F.col("alias")).alias("alias"), F.lit(False).alias("whole"))
    whole = entries.select("ord", "canonical", F.explode("equals").alias("alias")).select("ord", "canonical", tag_text(F.col("alias")).alias("alias"), F.lit(True).alias("whole"))
    aliases = inside.unionByName(whole).filter("alias <> ''").groupBy("alias", "whole").agg(F.min(F.struct("ord", "canonical")).alias("entry"))
    lengths = sorted(r.n for r in inside.filter("alias <> ''").select(F.length("alias").alias("n")).distinct().collect())
    distinct = texts.select(text).distinct().withColumn("_tag", tag_text(F.col(text)))
    within = _pieces("_tag", lengths)
    candidates = F.concat(F.transform(within, lambda x: F.struct(x.alias("alias"), F.lit(False).alias("whole"))), F.transform(F.array_distinct(F.split("_tag", "/")), lambda x: F.struct(x.alias("alias"), F.lit(True).alias("whole"))))
    met = distinct.select("_tag", F.inline(candidates)).distinct().join(aliases, ["alias", "whole"]).groupBy("_tag").agg(F.min("entry").alias("entry"))
    known = F.col("_tag").isin([]) if not negatives else F.col("_tag").isin(*[t for t in negatives])
    return distinct.join(met, "_tag", "left").select(text, F.col("entry.canonical").alias("canonical"), (F.col("entry").isNull() & known & (F.col("_tag") != "")).alias("known_negative"))


def containments(names: DataFrame, name: str) -> DataFrame:
    """whole, part: every pair of different names of which one contains the other, whatever their case.

    Pieces of a name that are as long as some name meet the names by an equality
    join, so no pair is looked at that does not hold.  Null and empty names take no part.
    """
    one = names.select(F.col(name).alias("name")).filter("name <> ''").distinct().withColumn("low", F.lower("name"))
    lengths = sorted(r.n for r in one.select(F.length("low").alias("n")).distinct().collect())  # at most as many as the longest name has letters
    cut = one.select(F.col("name").alias("whole"), F.explode(_pieces("low", lengths)).alias("low"))
    return cut.join(one.withColumnRenamed("name", "part"), "low").filter("whole <> part").select("whole", "part")


def label_line(line: Column) -> Column:
    """struct(label, raw_label, value) of a ``label : value`` line, ornaments before its first letter left out; null for any other."""
    bare = F.regexp_replace(_trim(line), r"^[^\p{L}]+", "")
    raw = _trim(F.regexp_extract(bare, LABEL_LINE, 1))
    return F.when(bare.rlike(LABEL_LINE), F.struct(_compact(raw).alias("label"), raw.alias("raw_label"), _trim(F.regexp_extract(bare, LABEL_LINE, 2)).alias("value")))


def _bare_ends(text: Column) -> Column:
    return _compact(F.regexp_replace(F.regexp_replace(text, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))


def structure_bodies(posts: DataFrame, key: str, labels: DataFrame, topics: Sequence[tuple[str, Sequence[str]]], duplicates: Sequence[str] = (), fallback: str = "etc") -> DataFrame:
    """key, kind, section, position, label, value: where each line of a post's body and notices belongs.

    posts: key, body, notices, basics (array of values that stand beside the body),
    table_text (text of its tables).  labels: label, field, section (null field:
    known and ignored; null section: mapped, but shown nowhere).  topics: (id, keywords), in order.

    - A labelled line of a section is an item there under its own wording; lines
      that begin with a bracket or dash right behind it go on from it, notices apart.
    - Labels whose field is one of ``duplicates`` are left out, as are lines that
      repeat a basic value or a table's text; unknown labels are also listed (kind unmapped).
    - An unlabelled whole sentence with a topic's keyword is a notice of the first
      such topic; every line of ``notices`` is one (of ``fallback`` without a topic),
      a repeated line once.  All other lines are the intro.

    position orders the rows of one kind in a post.  Null texts have no lines.
    """
    on = Window.partitionBy(key).orderBy("src", "n")
    table = F.coalesce(F.col("table_text"), F.lit(""))
    basics = F.transform(F.coalesce("basics", F.array().cast("array<string>")), lambda b: _bare_ends(F.coalesce(b, F.lit(""))))
    at = lambda c, src: posts.select(key, F.lit(src).alias("src"), _compact(table).alias("table_text"), basics.alias("basics"), F.posexplode(_lines(F.col(c))).alias("n", "line"))
    lines = at("body", 0).unionByName(at("notices", 1)).withColumn("line", _trim(F.col("line"))).withColumn("flat", _compact(F.col("line")))
    lines = lines.filter("line <> ''").filter((F.col("src") == 1) | ~((F.length("flat") >= 2) & F.contains("table_text", "flat")))
    topic = F.lit(None).cast("string")
    for name, words in reversed(topics):
        topic = F.when(F.col("flat").rlike("|".join(re.escape(re.sub(r"\s+", "", w)) for w in words)), F.lit(name)).otherwise(topic)
    read = lines.withColumn("read", F.when(F.col("src") == 0, label_line(F.col("line")))).withColumn("topic", topic)
    known = labels.groupBy("label").agg(F.first(F.struct("field", "section")).alias("known"))
    read = read.withColumn("label", F.col("read.label")).join(known, "label", "left")
    routable = F.col("read").isNull() & F.col("line").rlike(SENTENCE_END) & F.col("topic").isNotNull()
    duplicate = F.coalesce(F.col("known.field").isin(*duplicates), F.lit(False)) if duplicates else F.lit(False)
    first = F.when(F.col("src") == 1, "notice").when(duplicate, "left out").when(F.col("known.section").isNotNull(), "item").when(F.col("line").rlike(CONTINUED) & ~routable, "more").otherwise("other")
    read = read.withColumn("first", first).withColumn("routable", routable)
    before = F.last(F.when(F.col("first") != "more", F.col("first")), ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, -1))
    read = read.withColumn("more", (F.col("first") == "more") & F.coalesce(before == "item", F.lit(False)))
    read = read.withColumn("item", F.sum((F.col("first") == "item").cast("int")).over(on))
    repeated = F.array_contains("basics", _bare_ends(F.col("line")))
    kind = F.when(F.col("first").isin("item", "notice", "left out"), F.col("first")).when(F.col("more"), "item").when(repeated, "left out").when(F.col("routable"), "notice").otherwise("intro")
    placed = read.withColumn("kind", kind).withColumn("value", F.when(F.col("first") == "item", F.col("read.value")).otherwise(F.col("line")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("src", "n", "value"))), lambda x: x["value"])
    items = placed.filter("kind = 'item'").groupBy(key, "item").agg(F.min("src").alias("src"), F.min("n").alias("n"), F.min_by("known.section", "n").alias("section"), F.min_by("read.raw_label", "n").alias("label"), _trim(F.array_join(texts, " ")).alias("value"))
    items = items.select(key, F.lit("item").alias("kind"), "section", "src", "n", "label", "value")
    none = F.lit(None).cast("string")
    intro = placed.filter("kind = 'intro'").select(key, F.lit("intro").alias("kind"), none.alias("section"), "src", "n", none.alias("label"), "value")
    notices = placed.filter("kind = 'notice'").withColumn("section", F.coalesce("topic", F.lit(fallback)))
    notices = notices.groupBy(key, "section", "flat").agg(F.min(F.struct("src", "n", "value")).alias("x")).select(key, F.lit("notice").alias("kind"), "section", "x.src", "x.n", none.alias("label"), "x.value")
    unmapped = read.filter("src = 0 AND read IS NOT NULL AND known IS NULL").select(key, F.lit("unmapped").alias("kind"), none.alias("section"), "src", "n", "label", none.alias("value"))
    every = items.unionByName(intro).unionByName(notices).unionByName(unmapped)
    order = Window.partitionBy(key, "kind").orderBy("src", "n")
    return every.withColumn("position", F.row_number().over(order) - 1).select(key, "kind", "section", "position", "label", "value")


def fees(detail: Column) -> Column:
    """struct(is_free, fee_text, material_fee, ambiguous) by the lines that name a fee; several material amounts are ambiguous."""
    found = F.filter(F.transform(_lines(detail), _trim), lambda x: x.rlike(FEE_LINE))
    flat = _compact(F.array_join(found, " "))
    free = F.when(flat.rlike(FREE_FEE), F.lit(True)).when(flat.rlike(PAID_FEE), F.lit(False))
    amounts = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(flat, F.lit(MATERIAL_FEE), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))))
    return F.struct(free.alias("is_free"), F.when(F.size(found) > 0, F.array_join(found, "\n")).alias("fee_text"), F.when(F.size(amounts) == 1, amounts[0]).alias("material_fee"), (F.size(amounts) > 1).alias("ambiguous"))


def series_of(title: Column, library: Column) -> Column:
    """struct(series_key, occurrence): what a programme's repeats have in common, and what tells this one apart in its title (null if nothing)."""
    bare = _trim(F.regexp_replace(title, r"(?U)^\s*(?:\[[^\]]*\]\s*)+", ""))
    every = F.regexp_extract_all(bare, F.lit(OCCURRENCE), 0)
    base = _compact(F.regexp_replace(F.regexp_replace(bare, OCCURRENCE, " "), r"[\[\]()（）<>「」]", " "))
    key = F.concat(F.coalesce(library, F.lit(UNNAMED)), F.lit("::"), F.coalesce(F.nullif(base, F.lit("")), _compact(bare)))
    return F.struct(key.alias("series_key"), F.when(F.size(every) > 0, _trim(F.regexp_replace(F.array_join(every, " "), r"(?U)\s+", " "))).alias("occurrence"))


def normalise_programmes(posts: DataFrame, entries: DataFrame, labels: DataFrame, negatives: Sequence[str] = (), location: str = "location") -> DataFrame:
    """One typed row for each post, with its warnings and status.

    posts: source_id, source_url, title, basics (map of label to value), body,
    detail, notices, online_status, n_tables, n_images, n_attachments, unmapped
    (whether structure_bodies found an unknown label).  entries and negatives as in
    dictionary_lookup; labels as in structure_bodies.

    The library is looked up by the title's leading tags, else by the first line of
    the body whose label is a location and whose value the dictionary knows.  A
    capacity that the detail text gives otherwise overrides the one given, unless it
    gives several.  Nothing is guessed: what cannot be read is null and warned of.
    """
    base = posts.withColumn("_head", _trim(F.coalesce("title", F.lit(""))))
    tagged = r"(?U)^((?:\[[^\]]+\]\s*)+)"
    base = base.withColumn("title_tags", F.transform(F.regexp_extract_all(F.regexp_extract("_head", tagged, 1), F.lit(r"\[([^\]]+)\]"), 1), _trim))
    base = base.withColumn("_bare", F.coalesce(F.nullif(F.regexp_replace("_head", tagged, ""), F.lit("")), F.col("_head"))).withColumn("_tags", F.array_join("title_tags", "/"))
    by_tag = dictionary_lookup(base, "_tags", entries, negatives)
    base = base.join(by_tag.withColumnRenamed("canonical", "_by_tag"), "_tags")
    # Only posts without a known tag are looked up by their bodies.
    told = base.filter("_by_tag IS NULL").select("source_id", F.posexplode(_lines(F.coalesce("body", "detail"))).alias("n", "line")).withColumn("read", label_line(F.col("line"))).filter("read IS NOT NULL")
    places = labels.filter(F.col("field") == location).select("label").distinct()
    told = told.select("source_id", "n", F.col("read.label").alias("label"), F.col("read.value").alias("place")).join(places, "label", "left_semi")
    found = told.join(dictionary_lookup(told, "place", entries), "place").filter("canonical IS NOT NULL").groupBy("source_id").agg(F.min(F.struct("n", "canonical", "place")).alias("_body"))
    base = base.join(found, "source_id", "left")
    library = F.coalesce("_by_tag", "_body.canonical")
    info = lambda name: F.coalesce(F.try_element_at("basics", F.lit(name)), F.lit(""))
    target = F.split(_trim(info("대상")), r"(?U)\s+")
    given = F.when(_trim(info("모집인원")).rlike("^[0-9]+$"), _trim(info("모집인원")).try_cast("long"))
    detail = F.coalesce("detail", F.lit(""))
    seen = F.transform(F.regexp_extract_all(detail, F.lit(DETAIL_CAPACITY), 0), lambda m: F.coalesce(F.regexp_extract(m, DETAIL_CAPACITY, 1).try_cast("long"), F.regexp_extract(m, DETAIL_CAPACITY, 2).try_cast("long")))
    period, apply, schedule = _trim(info("교육기간")), _trim(info("신청기간")), _trim(info("교육시간"))
    day = lambda text, k: F.nullif(F.regexp_extract(text, DATE_RANGE, k), F.lit(""))
    out = base.select(
        "source_id", "source_url", F.col("_bare").alias("title"), "title_tags", library.alias("library_name"), F.when(F.col("_by_tag").isNotNull(), "title_tag").when(F.col("_body").isNotNull(), "body_location").alias("library_source"),
        F.col("known_negative").alias("known_non_library"), F.when(target[0].isin(*TARGET_GROUPS), target[0]).alias("target_group"), F.nullif(F.array_join(F.slice(target, 2, 1_000), " "), F.lit("")).alias("target_detail"),
        _or_null(info("강사")).alias("instructor"), given.alias("given"), F.array_distinct(F.array_compact(seen)).alias("capacity_candidates"), day(period, 1).alias("program_start"), day(period, 2).alias("program_end"),
        day(apply, 1).alias("apply_start"), day(apply, 2).alias("apply_end"), F.when(schedule.rlike("[0-9]"), schedule).alias("schedule_text"), _or_null(detail).alias("description"), "online_status",
        F.when(F.col("n_tables") > 0, "table").when(_or_null(F.coalesce("body", "detail")).isNotNull(), "text").when(F.col("n_images") > 0, "image").when(F.col("n_attachments") > 0, "attachment_only").otherwise("empty").alias("content_kind"),
        _or_null(F.col("notices")).alias("notice_text"), fees(detail).alias("fee"), series_of(F.coalesce("title", F.lit("")), library).alias("series"), F.col("_head").rlike(TEST_TITLE).alias("is_test"), "unmapped",
    )
    seen = F.col("capacity_candidates")
    ambiguous = F.size(seen) > 1
    conflict = F.col("given").isNotNull() & F.exists(seen, lambda x: x != F.col("given"))
    out = out.withColumn("capacity", F.when(conflict & ~ambiguous, F.element_at(seen, 1)).otherwise(F.col("given")))
    reason = F.when(F.col("is_test"), "TEST_TITLE").when(F.col("schedule_text").isNull(), "SCHEDULE_WITHOUT_ANY_DIGIT")
    core = F.col("target_group").isNull() | F.col("target_detail").isNull() | F.col("capacity").isNull() | F.col("program_start").isNull() | F.col("apply_start").isNull() | F.col("schedule_text").isNull()
    rules = (
        ("LIBRARY_NAME_UNRESOLVED", F.col("library_name").isNull() & ~F.col("known_non_library")), ("INVALID_CORE_FIELD", core), ("CAPACITY_OVERRIDDEN_BY_DETAIL", conflict & ~ambiguous), ("CAPACITY_DETAIL_AMBIGUOUS", ambiguous),
        ("DESCRIPTION_MISSING", F.col("description").isNull()), ("MATERIAL_FEE_AMBIGUOUS", F.col("fee.ambiguous")), ("TUITION_STATUS_UNKNOWN", F.col("fee.fee_text").isNotNull() & F.col("fee.is_free").isNull()), ("UNMAPPED_LABEL_IN_BODY", F.coalesce("unmapped", F.lit(False))),
    )
    out = out.withColumn("exclusion_reason", reason).withColumn("warnings", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])))
    review = F.arrays_overlap("warnings", F.array(F.lit("INVALID_CORE_FIELD"), F.lit("CAPACITY_DETAIL_AMBIGUOUS")))
    status = F.when(F.col("exclusion_reason").isNotNull(), "excluded").when(review, "needs_review").when(F.size("warnings") > 0, "partial").otherwise("normalized")
    out = out.withColumn("is_excluded", F.col("exclusion_reason").isNotNull()).withColumn("status", status)
    return out.select("*", "fee.is_free", "fee.fee_text", "fee.material_fee", "series.series_key", "series.occurrence").drop("fee", "series", "given", "is_test", "unmapped")
