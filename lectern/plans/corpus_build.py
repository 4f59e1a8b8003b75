"""The search corpus and its reports, over the tables: safety ladder, records with lineage, reconciliation, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.reports import validity_row, verification_report, write_counted
from ..registry import query
from ..storage import stored, work_folder
from .documents import _ITEMS, _items

# Each item a section linked with its part: the flags make the match, the numbers the evidence; sources are suppliers, exceptions stand on some of them.
_CANDIDATES = f"""items AS ({_ITEMS.replace("l_shipdate,", "l_shipdate, l_quantity, l_discount, l_tax, l_suppkey,")}), links AS (
  SELECT concat(l_orderkey, ':', r) AS section_id, CAST(l_suppkey AS VARCHAR) AS source, CASE WHEN l_linestatus = 'O' AND l_quantity < 5 THEN NULL ELSE l_partkey END AS program_id,
    CASE l_returnflag WHEN 'A' THEN 'AMBIGUOUS' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'NO_RELIABLE_MATCH' ELSE 'CANDIDATE' END ELSE 'CANDIDATE' END AS match, l_tax > 0.06 AS conflict, l_discount > 0.02 AS titled, l_quantity > 3 AS found, s_nationkey AS k, l_quantity AS q, r
  FROM items JOIN supplier ON s_suppkey = l_suppkey
), safety AS (
  SELECT *, CASE WHEN match = 'AMBIGUOUS' THEN 'MANUAL_REVIEW' WHEN match = 'NO_RELIABLE_MATCH' OR program_id IS NULL OR NOT found THEN 'CORE_ONLY' WHEN conflict OR k IN (3, 4, 5) THEN 'MANUAL_REVIEW' WHEN NOT titled THEN 'CORE_ONLY' ELSE 'SAFE_FOR_CORPUS' END AS status,
    CASE WHEN match = 'AMBIGUOUS' THEN ['AMBIGUOUS_CANDIDATE'] WHEN match = 'NO_RELIABLE_MATCH' OR program_id IS NULL THEN ['NO_RELIABLE_PROGRAM_CASE_MATCH'] WHEN NOT found THEN ['SECTION_NOT_FOUND'] WHEN conflict THEN ['EVIDENCE_CONFLICT']
      WHEN k = 3 THEN ['READING_ORDER_UNRESOLVED'] WHEN k = 4 THEN ['POSSIBLE_FALSE_ATTACHMENT_LINK', 'READING_ORDER_UNRESOLVED'] WHEN k = 5 THEN ['UNDER_SEGMENTATION_RISK'] WHEN NOT titled THEN ['TITLE_EVIDENCE_INSUFFICIENT']
      ELSE ['CANDIDATE_WITH_TITLE_EVIDENCE', 'NO_FATAL_REPRESENTATION_EXCEPTION'] END AS reasons
  FROM links
)"""


def _sections(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, sections, exceptions, units) of the items."""
    more = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    kept = stored(_items(t, more).drop("l_linenumber", "l_extendedprice", "l_shipdate", "n"), "items")  # numbered once, for candidates, sections and units
    rows = kept.withColumn("section_id", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("r").cast("string"))).withColumn("source", F.col("l_suppkey").cast("string"))
    match = F.when(F.col("l_returnflag") == "A", "AMBIGUOUS").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "NO_RELIABLE_MATCH").otherwise("CANDIDATE")
    program = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 5)), F.col("l_partkey"))
    candidates = rows.select("section_id", "source", program.alias("program_id"), match.alias("match"), F.when(F.col("l_tax") > 0.06, F.array(F.lit("DATE"))).alias("conflicts"), (F.col("l_discount") > 0.02).alias("titled"))
    refs = F.array(F.concat("section_id", F.lit("/b")), F.concat("section_id", F.lit("/a")))
    sections = rows.filter("l_quantity > 3").select("section_id", refs.alias("unit_refs"))
    k = F.col("s_nationkey")
    codes = F.when(k == 3, F.array(F.lit("READING_ORDER_UNRESOLVED"))).when(k == 4, F.array(F.lit("READING_ORDER_UNRESOLVED"), F.lit("POSSIBLE_FALSE_ATTACHMENT_LINK"), F.lit("READING_ORDER_UNRESOLVED"))).when(k == 5, F.array(F.lit("UNDER_SEGMENTATION_RISK"), F.lit("SMALL_IMAGE"))).when(k < 12, F.array(F.lit("SMALL_IMAGE")))
    exceptions = t.supplier.select(F.col("s_suppkey").cast("string").alias("source"), F.explode(codes).alias("code"))
    unit = lambda place, text: F.struct(F.concat("section_id", F.lit(place)).alias("unit_id"), text.alias("text"))
    said = F.array(unit("/a", F.concat(F.lit("활동 "), F.col("r").cast("string"), F.lit(" a@b.co"))), unit("/b", F.when(F.col("l_quantity") < 40, F.concat(F.lit("첫째 "), F.col("l_quantity").cast("int").cast("string")))))
    return candidates, sections, exceptions, rows.select(F.inline(said))


@query("o_k3_safety_gate", f"WITH {_CANDIDATES} SELECT section_id, program_id, status, reasons FROM safety")
def safety_gate(t):
    return C.section_safety(*_sections(t)[:3]).select("section_id", "program_id", "status", "reasons")


# Parts are programmes: those of one name and brand are one group, the largest of which (then the first) stands for it.
_CORPUS = f"""{_CANDIDATES}, sections AS (SELECT program_id, section_id, concat(CASE WHEN q < 40 THEN concat('첫째 ', CAST(q AS INTEGER), chr(10)) ELSE '' END, '활동 ', r) AS text FROM safety WHERE status = 'SAFE_FOR_CORPUS'),
named AS (SELECT *, concat('[', p_type, '] ', p_name, ' ', replace(p_brand, '#', ''), ' 4/', 1 + p_size % 28, CASE WHEN p_size > 25 THEN ' (2차)' ELSE '' END) AS title, concat(p_name, ' ', replace(p_brand, '#', '')) AS base FROM part),
grouped AS (SELECT *, md5(base) AS group_id, row_number() OVER (PARTITION BY base ORDER BY p_size DESC, p_partkey) AS place FROM named),
attached AS (SELECT group_id, string_agg(text, chr(10) ORDER BY program_id, section_id) AS attached FROM grouped JOIN sections ON program_id = p_partkey GROUP BY 1),
titles AS (SELECT group_id, count(*) AS members, count(DISTINCT title) AS n, string_agg(DISTINCT title, ' / ' ORDER BY title) AS titles FROM grouped GROUP BY 1),
full_texts AS (
  SELECT group_id, p_partkey AS representative, members, base AS title, concat('프로그램명: ', base, CASE WHEN n > 1 THEN concat(chr(10), '원본 제목: ', titles) ELSE '' END, chr(10), '대상: ', lower(p_brand), chr(10), '기관: ', p_type,
    chr(10), '핵심 내용: 오세요', coalesce(concat(chr(10), '활동: ', attached), ''), chr(10), '운영 정보: 2026-01-01', CASE WHEN p_size > 10 THEN ' ~ 2026-02-01' ELSE '' END) AS lexical,
    concat(lower(p_brand), '을 대상으로 하는 ', base, ' 프로그램이다. 오세요', coalesce(concat(' 주요 활동은 ', replace(attached, chr(10), ' ')), '')) AS dense
  FROM grouped JOIN titles USING (group_id) LEFT JOIN attached USING (group_id) WHERE place = 1
)"""


def _programmes(t) -> tuple[DataFrame, DataFrame]:
    s = F.col("p_size")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    title = F.concat(F.lit("["), "p_type", F.lit("] "), "p_name", F.lit(" "), brand, F.lit(" 4/"), (1 + s % 28).cast("string"), F.when(s > 25, " (2차)").otherwise(""))
    rows = t.part.repartition("p_partkey").select(F.col("p_partkey").alias("program_id"), title.alias("title"), F.lower("p_brand").alias("audience"), F.lit(None).cast("string").alias("location"), F.lit("오세요　https://x.y/z 010-1234-5678").alias("notices"), F.lit("2026-01-01").alias("starts"), F.when(s > 10, "2026-02-01").otherwise("2026-01-01").alias("ends"), "p_size")
    base = C.title_signals(F.col("title"))["base_title"]
    members = C.representatives(rows.select(F.md5(base).alias("group_id"), "program_id", "p_size"), [F.desc("p_size"), F.asc("program_id")])
    return rows.drop("p_size"), members


@query("o_k5_corpora", f"WITH {_CORPUS} SELECT group_id, representative, members, title, rtrim(left(lexical, 6000)) AS lexical_text, rtrim(left(dense, 4000)) AS dense_text, length(lexical) > 6000 OR length(dense) > 4000 AS truncated FROM full_texts")
def corpora(t):
    candidates, sections, exceptions, units = _sections(t)
    programmes, members = _programmes(t)
    texts = C.safe_texts(C.section_safety(candidates, sections, exceptions), units)
    return C.corpus_records(programmes, members, texts).drop("corpus_id", "content_hash")


# The records are built twice, from the rows as they are and dealt anew; every part is in one group, and of what the records name a few units are taken away.
@query("o_k5_lineage", f"""WITH {_CORPUS}, refs AS (
  SELECT group_id, 'program' AS kind, CAST(p_partkey AS VARCHAR) AS ref FROM grouped UNION SELECT group_id, 'section', section_id FROM grouped JOIN sections ON program_id = p_partkey
  UNION SELECT group_id, 'unit', concat(section_id, u) FROM grouped JOIN sections ON program_id = p_partkey, (VALUES ('/a'), ('/b')) v(u)
) SELECT kind, count(*) AS refs, count_if(kind = 'unit' AND ref LIKE '1%/b') AS dangling, 0::BIGINT AS membership_problems, TRUE AS same_hash FROM refs GROUP BY kind""")
def corpus_lineage(t):
    candidates, sections, exceptions, units = _sections(t)
    programmes, members = (stored(x, "programmes") for x in _programmes(t))
    safety = stored(C.section_safety(candidates, sections, exceptions).drop("reasons").filter("status = 'SAFE_FOR_CORPUS'"), "safety")  # what records and lineage read
    anew = lambda frame, *by: frame.repartition(F.xxhash64(F.lit("anew"), *by))  # as many parts as rows need
    hashes = [C.corpus_hash(C.corpus_records(p, m, C.safe_texts(s, u))).first().hash for p, m, s, u in ((programmes, members, safety, units), (anew(programmes, "title"), anew(members, "program_id"), anew(safety, "section_id"), anew(units, "unit_id")))]
    refs = stored(C.lineage(members, safety), "refs")
    left = units.filter("NOT unit_id LIKE '1%/b'")
    known = programmes.select(F.lit("program").alias("kind"), F.col("program_id").cast("string").alias("ref")).union(sections.select(F.lit("section"), "section_id")).union(left.select(F.lit("unit"), "unit_id"))
    lost = C.dangling(refs, known).groupBy("kind").agg(F.count("*").alias("dangling"))
    problems = C.membership_problems(members, programmes).count()
    counted = refs.groupBy("kind").agg(F.count("*").alias("refs")).join(lost, "kind", "left")
    return counted.select("kind", "refs", F.coalesce("dangling", F.lit(0)).alias("dangling"), F.lit(problems).cast("long").alias("membership_problems"), F.lit(hashes[0] == hashes[1]).alias("same_hash"))


@query("o_x13_title_signals", """SELECT p_partkey, concat(p_name, ' class') AS base_title, concat(replace(p_name, ' ', ''), 'class') AS comparable, concat('2026. 4/', 1 + p_size % 28, '(토)') AS occurrence_date,
  CASE WHEN p_size > 25 THEN concat('오전', 1 + p_size % 9, ':00~', 2 + p_size % 9, ':30') END AS time, CASE WHEN p_size <= 25 THEN p_size % 9 + 1 END AS round, p_type AS institution FROM part""")
def title_parts(t):
    s, n = F.col("p_size"), lambda c: c.cast("string")
    time = F.concat(F.lit(" 오전 "), n(1 + s % 9), F.lit(":00 ~ "), n(2 + s % 9), F.lit(":30(매주)"))
    title = F.concat(F.lit(" [ "), "p_type", F.lit("] "), "p_name", F.lit("　(Class) 2026. 4/"), n(1 + s % 28), F.lit("(토)"), F.when(s > 25, time).otherwise(F.concat(F.lit(" ("), n(s % 9 + 1), F.lit("차)"))))
    x = C.title_signals(title)
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", F.lower("x.base_title").alias("base_title"), "x.comparable", "x.occurrence_date", "x.time", "x.round", "x.institution")


# Customers, orders and items are written once, and counted on the way; what crosses tables is one join of what was written.
_RECONCILED = """SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT c_custkey) FROM customer) AS customer_ids, (SELECT count_if(c_acctbal < 0) FROM customer) AS in_debt, (SELECT count_if(c_name IS NULL OR c_name = '') FROM customer) AS unnamed,
  (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments, count(*) AS orders, count(DISTINCT o_orderkey) AS order_ids, count(DISTINCT o_custkey) AS ordering, count_if(o_orderstatus = 'F') AS finished, count_if(o_orderstatus = 'O') AS open,
  count_if(o_orderstatus = 'P') AS partial, count_if(o_totalprice <= 0) AS worthless, count_if(o_orderdate IS NULL) AS undated, (SELECT count(*) FROM lineitem) AS items, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS ordered, (SELECT count_if(l_returnflag = 'R') FROM lineitem) AS returned,
  (SELECT count_if(l_quantity <= 0) FROM lineitem) AS empty_items, (SELECT count_if(l_discount < 0 OR l_discount > 1) FROM lineitem) AS odd_discounts, (SELECT count_if(l_tax > 0.05) FROM lineitem) AS high_taxes, (SELECT count_if(l_shipdate IS NULL) FROM lineitem) AS unshipped,
  (SELECT count(DISTINCT l_partkey) FROM lineitem) AS parts, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS suppliers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_items FROM orders"""


@query("o_a30_reconciliation", f"SELECT *, customers = customer_ids AS ids_are_unique, orphan_orders = 0 AND orphan_items = 0 AS nothing_dangles, worthless + undated + empty_items + odd_discounts + unshipped + unnamed = 0 AS values_hold, customers = customer_ids AND orders = order_ids AND orphan_orders = 0 AND orphan_items = 0 AND worthless + undated + empty_items + odd_discounts + unshipped + unnamed = 0 AS valid FROM ({_RECONCILED})")
def reconciliation(t):
    folder = work_folder(t.spark, "reconciled")
    n, of = F.count(F.lit(1)), lambda rule: F.count_if(F.coalesce(rule, F.lit(False)))
    ids = lambda c: F.size(F.collect_set(c))  # of nations and segments, a few each
    c = write_counted(t.customer, f"{folder}/customer", {"customers": n, "in_debt": of(F.col("c_acctbal") < 0), "unnamed": of(F.coalesce("c_name", F.lit("")) == ""), "nations": ids("c_nationkey"), "segments": ids("c_mktsegment")})
    o = write_counted(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), f"{folder}/orders",
        {"orders": n, **{name: of(F.col("o_orderstatus") == s) for name, s in (("finished", "F"), ("open", "O"), ("partial", "P"))}, "worthless": of(F.col("o_totalprice") <= 0), "undated": of(F.col("o_orderdate").isNull())},
    )
    i = write_counted(
        t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"), f"{folder}/lineitem",
        {"items": n, "returned": of(F.col("l_returnflag") == "R"), "empty_items": of(F.col("l_quantity") <= 0), "odd_discounts": of((F.col("l_discount") < 0) | (F.col("l_discount") > 1)), "high_taxes": of(F.col("l_tax") > 0.05), "unshipped": of(F.col("l_shipdate").isNull())},
    )
    held = lambda name: t.spark.read.parquet(f"{folder}/{name}")
    # Keys by table, one row each side: the distinct keys and what has no other side, from the key columns alone.
    by = lambda name, key: held(name).groupBy(F.col(key).alias("k")).agg(F.count("*").alias(name))
    people = by("customer", "c_custkey").join(by("orders", "o_custkey"), "k", "full_outer").agg(F.count("customer").alias("customer_ids"), F.count("orders").alias("ordering"), F.coalesce(F.sum(F.when(F.col("customer").isNull(), F.col("orders"))), F.lit(0)).alias("orphan_orders")).first()
    goods = by("orders", "o_orderkey").join(by("lineitem", "l_orderkey"), "k", "full_outer").agg(F.count("orders").alias("order_ids"), F.count("lineitem").alias("ordered"), F.coalesce(F.sum(F.when(F.col("orders").isNull(), F.col("lineitem"))), F.lit(0)).alias("orphan_items")).first()
    wide = held("lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")).first()
    x = {**c, **o, **i, **people.asDict(), **goods.asDict(), **wide.asDict()}
    unique, whole = x["customers"] == x["customer_ids"], x["orphan_orders"] == 0 and x["orphan_items"] == 0
    values = sum(x[k] for k in ("worthless", "undated", "empty_items", "odd_discounts", "unshipped", "unnamed")) == 0
    row = validity_row(t.spark, x, {"ids_are_unique": unique, "nothing_dangles": whole, "values_hold": values, "orders_are_unique": x["orders"] == x["order_ids"]})
    return row.drop("orders_are_unique")


# Documents are the files of their sources; their numbers make what has happened to each.
_FILES = """files AS (SELECT doc_id AS id, source AS program_id, md5(left(text, 40)) AS url, n_chars % 7 <> 0 AS active, source <> 'src1' AS known, ['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'][1 + n_chars % 4] AS status, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 13 = 0 THEN '  ' ELSE left(text, 80) END AS raw,
  left(text, CAST(n_chars % 120 AS BIGINT)) AS cleaned, CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE 'x' END AS extractor, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE '1' END AS version, CASE WHEN n_chars % 6 = 1 THEN 'TIMEOUT' END AS failure, n_chars % 4 - 1 AS attempts,
  n_chars % 50 AS attempted_at, CASE WHEN n_chars % 9 > 1 THEN n_chars % 60 END AS extracted_at, CASE WHEN n_chars % 17 = 0 THEN '' ELSE md5(text) END AS checksum FROM documents), done AS (SELECT * FROM files WHERE active AND status = 'COMPLETED')"""
_SIZE = "length(trim(coalesce({}, '')))"
_METRICS = (
    ("totals", "files", "files", "TRUE"), ("totals", "active", "files", "active"), ("totals", "inactive", "files", "NOT active"), ("totals", "orphans", "files", "NOT known"), *(("status", s, "files", f"active AND status = '{s}'") for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")),
    ("integrity", "raw_null", "done", "raw IS NULL"), ("integrity", "raw_blank", "done", "trim(raw) = ''"), ("integrity", "cleaned_null", "done", "cleaned IS NULL"), ("integrity", "cleaned_blank", "done", "trim(cleaned) = ''"), *(("integrity", f"{c}_under_{n}", "done", f"{_SIZE.format(c)} < {n}") for c in ("raw", "cleaned") for n in (50, 100)),
    ("integrity", "no_extractor", "done", "trim(extractor) = ''"), ("integrity", "no_version", "done", "version IS NULL"), ("integrity", "no_extraction_time", "done", "extracted_at IS NULL"), ("integrity", "no_attempt_time", "done", "attempted_at IS NULL"), ("integrity", "no_attempt", "done", "attempts < 1"),
    ("integrity", "failure_named", "done", "failure IS NOT NULL"), ("attempts", "two_or_more", "files", "active AND attempts >= 2"), ("attempts", "suspicious", "files", "active AND attempts < 0"), ("times", "extracted_before_last_attempt", "done", "extracted_at < attempted_at"),
    ("times", "pending_but_extracted", "files", "active AND status = 'PENDING' AND extracted_at IS NOT NULL"), ("times", "failed_without_reason", "files", "active AND status = 'FAILED' AND failure IS NULL"), ("missing", "checksum", "files", "active AND checksum = ''"),
)
_DOUBLES = (
    ("program_url_groups", "count(*)", "SELECT 1 FROM files GROUP BY program_id, url HAVING count(*) > 1"), ("url_groups", "count(*)", "SELECT 1 FROM files GROUP BY url HAVING count(*) > 1"), ("checksum_groups", "count(*)", "SELECT 1 FROM files WHERE checksum <> '' GROUP BY checksum HAVING count(*) > 1"),
    ("rows_in_checksum_groups", "coalesce(sum(n), 0)", "SELECT count(*) AS n FROM files WHERE checksum <> '' GROUP BY checksum HAVING count(*) > 1"), ("same_program_checksums", "count(*)", "SELECT 1 FROM files WHERE checksum <> '' GROUP BY checksum HAVING count(*) > 1 AND count(DISTINCT program_id) < count(*)"),
    ("cross_program_checksums", "count(*)", "SELECT 1 FROM files WHERE checksum <> '' GROUP BY checksum HAVING count(DISTINCT program_id) > 1"), ("active_and_inactive_url", "count(*)", "SELECT 1 FROM files GROUP BY url HAVING bool_or(active) AND bool_or(NOT active)"),
)
_REPORT = " UNION ALL ".join([f"SELECT '{a}' AS section, '{b}' AS metric, count(*) AS n FROM {source} WHERE {rule}" for a, b, source, rule in _METRICS] + [f"SELECT 'duplicates', '{name}', CAST({n} AS BIGINT) FROM ({of})" for name, n, of in _DOUBLES])


@query("o_k18_verification", f"WITH {_FILES} {_REPORT}")
def verification(t):
    n = F.col("n_chars")
    status = F.get(F.array(*map(F.lit, ("PENDING", "PROCESSING", "COMPLETED", "FAILED"))), (n % 4).cast("int"))
    files = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("program_id"), F.md5(F.left("text", F.lit(40))).alias("url"), (n % 7 != 0).alias("active"), (F.col("source") != "src1").alias("known_program"), status.alias("status"), F.when(n % 11 == 0, None).when(n % 13 == 0, "  ").otherwise(F.left("text", F.lit(80))).alias("raw"),
        F.left("text", (n % 120).cast("int")).alias("cleaned"), F.when(n % 3 == 0, " ").otherwise("x").alias("extractor"), F.when(n % 5 != 0, "1").alias("version"), F.when(n % 6 == 1, "TIMEOUT").alias("failure"), (n % 4 - 1).alias("attempts"), (n % 50).alias("attempted_at"), F.when(n % 9 > 1, n % 60).alias("extracted_at"),
        F.when(n % 17 == 0, "").otherwise(F.md5("text")).alias("checksum"),
    )
    return verification_report(files)
