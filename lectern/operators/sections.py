"""Which pages of a document belong to a titled programme: title scores a page, a start among the near-best, an end at the next boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, edit_similarity, nfkc
from .layout import upper_median

# Headings of programme plans and of what is appended to them, run labels that tell no programme apart.
PLAN_HEADING = r"(?U)^(.{0,60}?(?:독서지도|그림책\s*지도)\s*계획안)"
NAMED_HEADING = r"(?U)(?:프로그램\s*명|강\s*좌\s*명|강\s*의\s*명)\s+(.+?)(?=프로그램\s*소개|개\s*요|목\s*표|대\s*상|교육|강사|교재|수\s*강|요일|일\s*자|장\s*소|$)"
SECTION_HEADING = r"(?U)(?:프로그램\s*명|강\s*좌\s*명|강\s*의\s*명|독서지도\s*계획안|그림책\s*지도\s*계획안)"
APPENDIX_HEADING = r"(?U)^[\[［(]\s*(?:붙임|별첨|부록)\s*\d*\s*[\]］)]"
METADATA_LINE = r"(?U)(?:\d{1,2}[./월-]\d{1,2}|\d{1,2}:\d{2}|대상|일시|장소|기간|강사|신청|모집)"
PERIPHERAL_LINE = r"(?U)(?:문의|연락처|담당자|홈페이지|전화|기관|교육과|도서관\s*귀하)"
RUN_LABEL = "^(?:[0-9]{4}년?|[0-9]+기)$"
PLACE_WORD = "^(?:동|작은도서관)$"
TAGS = r"(?U)^(?:\s*\[[^\]]+\])+\s*"
LEAST, NEAR_BEST, MOST, TAG_BONUS = 0.55, 0.1, 0.95, 0.25
HEAD_CHARS, HEADING_CHARS, LINE_CHARS = 600, 700, 100


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _untagged(text: Column) -> Column:
    return F.regexp_replace(text, TAGS, "")


def comparable(text: Column) -> Column:
    """A title without its leading tags, compatibility-normalised, lower case, letters and digits alone."""
    return _letters(nfkc(_untagged(text)))


def _title_parts(titles: DataFrame) -> DataFrame:
    """titles (with title) and what a page is held to: target, tokens, tags."""
    bare = nfkc(F.regexp_replace("title", TAGS, ""))
    words = F.transform(F.split(F.lower(bare), r"[^\p{L}\p{N}]+"), _letters)
    every = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(PLACE_WORD))
    telling = F.filter(every, lambda w: ~w.rlike(RUN_LABEL))
    tags = F.filter(F.transform(F.regexp_extract_all(nfkc(F.col("title")), F.lit(r"\[([^\]]+)\]"), 1), _letters), lambda t: F.length(t) >= 2)
    return titles.withColumn("target", _letters(bare)).withColumn("tokens", F.when(F.size(telling) >= 2, telling).otherwise(every)).withColumn("tags", tags)


def _page_parts(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) and their comparable whole and head, headings' comparable texts, and whether they open a section or an appendix."""
    text = F.col("text")
    known = pages.select("doc", "page", F.coalesce(text, F.lit("")).alias("text")).withColumn("_hangul", text.rlike("[가-힣]"))  # every heading's pattern has such a letter
    head = F.substring(text, 1, HEAD_CHARS)
    known = known.withColumn("_flat", F.when(F.col("_hangul"), F.substring(collapse(head), 1, HEADING_CHARS))).withColumn("_opening", F.when(F.col("_hangul"), F.substring(collapse(text), 1, 260)))
    known = known.withColumn("_first", F.trim(F.get(F.split(head, "\r?\n", 2), F.lit(0))))
    flat, opening, line = F.col("_flat"), F.col("_opening"), F.col("_first")
    found = lambda pattern: F.when(flat.rlike(pattern), F.regexp_extract(flat, pattern, 1))
    boundary = opening.rlike(SECTION_HEADING) | F.substring(opening, 1, 60).rlike(APPENDIX_HEADING)
    told = {"whole": text, "_head": F.when(F.length(text) > HEAD_CHARS, head), "_line": F.when((line != "") & (F.length(line) <= LINE_CHARS), line), "_plan": found(PLAN_HEADING), "_named": found(NAMED_HEADING)}
    out = known.select("doc", "page", "text", F.coalesce(boundary, F.lit(False)).alias("boundary"), *(_untagged(c).alias(name) for name, c in told.items()))
    out = out.withColumns({name: nfkc(F.col(name)) for name in told}).withColumns({name: _letters(F.col(name)) for name in told})
    return out.withColumn("compact", F.coalesce("_head", "whole")).withColumn("headings", F.array_compact(F.array("_line", "_plan", "_named"))).drop("_head", "_line", "_plan", "_named")


def title_score() -> Column:
    """How well a page (headings, compact) fits a title (target, tokens, tags), 0 to 0.95.

    The best of: a heading that contains the title or is contained in it (1) or the
    edit similarity of the two, with 0.25 more if the page has one of the title's
    tags; 0.9 if it has all of two or more telling words, 0.72 for three quarters.
    """
    target, compact = F.col("target"), F.col("compact")
    one = lambda h: F.when(F.contains(h, target) | F.contains(target, h), F.lit(1.0)).when((h == "") | (target == ""), F.lit(0.0)).otherwise(edit_similarity(target, h))
    heading = F.coalesce(F.array_max(F.transform("headings", one)), F.lit(0.0))
    bonus = F.when(F.exists("tags", lambda t: F.contains(compact, t)), TAG_BONUS).otherwise(0.0)
    n = F.size("tokens")
    covered = F.when(n > 0, F.size(F.filter("tokens", lambda t: F.contains(compact, t))) / n).otherwise(0.0)
    words = F.when((n >= 2) & (covered == 1), 0.9).when(covered >= 0.75, 0.72).otherwise(0.0)
    return F.least(F.lit(MOST), F.greatest(heading + bonus, words))


def match_sections(pages: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """doc, title, status, score, pages, text: the pages of each document that belong to each title asked of it.

    pages: doc, page (an order), text.  targets: doc, title, single (whether the
    document holds one programme alone).  known: doc, title of the programmes that
    a document may hold.  A page counts from a score of 0.55; status is

    - NOT_FOUND if none does (score 0, no pages),
    - WHOLE_DOCUMENT if the document is single (score 1), or if several pages are
      best alike and no other known title stands in it,
    - AMBIGUOUS if several are best alike and another does (score 0.4, those pages),
    - SECTION_MATCHED else: from the first page within 0.1 of the best up to the
      page before the next one that opens a section, an appendix or another known title.

    A title stands on a page if its comparable form (4 characters or more) does.
    Pages meet titles of their own document alone.  Null texts are empty; rows with
    a null doc, page or title take no part; repeated titles count once.
    """
    held = _page_parts(pages.filter("doc IS NOT NULL AND page IS NOT NULL"))
    asked = _title_parts(targets.filter("doc IS NOT NULL AND title IS NOT NULL").groupBy("doc", "title").agg(F.bool_or(F.coalesce("single", F.lit(False))).alias("single")))
    others = known.filter("doc IS NOT NULL AND title IS NOT NULL").select("doc", comparable(F.col("title")).alias("other")).filter(F.length("other") >= 4).groupBy("doc").agg(F.collect_set("other").alias("others"))
    pairs = held.join(asked.join(others, "doc", "left"), "doc").withColumn("score", title_score())
    foreign = F.coalesce(F.exists("others", lambda o: (o != F.col("target")) & F.contains("whole", o)), F.lit(False))
    pairs = pairs.select("doc", "title", "single", "page", "text", "score", "boundary", foreign.alias("foreign"))
    group, order = Window.partitionBy("doc", "title"), Window.partitionBy("doc", "title").orderBy("page")
    fit = pairs.withColumn("best", F.max("score").over(group)).withColumn("hit", (F.col("score") == F.col("best")) & (F.col("score") >= LEAST))
    near = (F.col("score") >= LEAST) & (F.col("score") >= F.col("best") - NEAR_BEST)
    fit = fit.withColumn("hits", F.sum(F.col("hit").cast("int")).over(group)).withColumn("start", F.min(F.when(near, F.col("page"))).over(group)).withColumn("any_foreign", F.bool_or("foreign").over(group))
    ends = F.min(F.when((F.col("page") > F.col("start")) & (F.col("boundary") | F.col("foreign")), F.col("page"))).over(group)
    single = F.col("single") & (F.col("hits") > 0)
    status = F.when(F.col("hits") == 0, "NOT_FOUND").when(single | ((F.col("hits") > 1) & ~F.col("any_foreign")), "WHOLE_DOCUMENT").when(F.col("hits") > 1, "AMBIGUOUS").otherwise("SECTION_MATCHED")
    fit = fit.withColumn("end", ends).withColumn("status", status)
    inside = (F.col("page") >= F.col("start")) & (F.col("end").isNull() | (F.col("page") < F.col("end")))
    chosen = F.when(F.col("status") == "WHOLE_DOCUMENT", F.lit(True)).when(F.col("status") == "AMBIGUOUS", F.col("hit")).when(F.col("status") == "SECTION_MATCHED", inside).otherwise(F.lit(False))
    score = F.when(F.col("status") == "NOT_FOUND", 0.0).when(F.col("status") == "AMBIGUOUS", 0.4).when(single, 1.0).otherwise(F.col("best"))
    part = F.when(chosen, F.struct("page", F.when(F.col("status") != "AMBIGUOUS", F.col("text")).alias("text")))
    found = fit.withColumn("part", part).withColumn("_score", score).groupBy("doc", "title").agg(F.first("status").alias("status"), F.first("_score").alias("score"), F.array_sort(F.collect_list("part")).alias("parts"))
    texts = F.transform("parts", lambda p: p["text"])
    return found.select("doc", "title", "status", "score", F.transform("parts", lambda p: p["page"]).alias("pages"), F.array_join(F.filter(texts, lambda x: x.isNotNull()), "\n\n").alias("text"))


def title_segments(lines: DataFrame, key: str, look_ahead: int = 5) -> DataFrame:
    """key, line, segment, kind: the stretch of an image's lines that each line belongs to.

    lines: key, line (an order), text, height, linked (how many programmes the
    image is linked with).  A title's anchor is a line of 2 to 50 characters, at
    least 1.1 of the image's upper median height, that is neither metadata nor
    contact, with metadata in one of the next ``look_ahead`` lines.  From the
    first anchor on each one begins a PROGRAM_REGION that ends before the next, for
    as many as are linked and one more (two at least); lines above the first are in
    none.  An image of one programme, or with fewer than two anchors, is one
    WHOLE_DOCUMENT.  Windows alone: no image is held whole.
    """
    page, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("line")
    tall = F.coalesce(F.col("height"), F.lit(0)).cast("double")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    meta = F.coalesce("text", F.lit("")).rlike(METADATA_LINE)
    fit = F.length(text).between(2, 50) & ~text.rlike(PERIPHERAL_LINE) & ~text.rlike(METADATA_LINE)
    # What a text says is told before the sort, which so moves no texts; one sort serves every window.
    told = lines.select(key, "line", "linked", tall.alias("_tall"), meta.alias("_meta"), fit.alias("_fit")).repartition(key).sortWithinPartitions(key, "line")
    said = told.withColumn("_middle", upper_median("_tall", [key])).withColumn("_median", F.when(F.col("_middle") == 0, 1.0).otherwise(F.col("_middle")))
    near = F.coalesce(F.max(F.col("_meta").cast("int")).over(order.rowsBetween(1, look_ahead)), F.lit(0)) == 1
    anchor = F.col("_fit") & (F.col("_tall") >= F.col("_median") * 1.1) & near
    found = said.withColumn("_anchor", anchor.cast("int")).withColumn("_all", F.sum("_anchor").over(page)).withColumn("_at", F.sum("_anchor").over(order))
    whole = (F.coalesce("linked", F.lit(0)) == 1) | (F.col("_all") < 2)
    last = F.greatest(F.lit(2), F.coalesce("linked", F.lit(0)) + 1)
    segment = F.when(whole, F.lit(0)).when(F.col("_at") > 0, F.least("_at", last) - 1)
    return found.select(key, "line", segment.cast("int").alias("segment"), F.when(whole, "WHOLE_DOCUMENT").otherwise("PROGRAM_REGION").alias("kind")).filter("segment IS NOT NULL")
