"""Text, date, vector, array, map and JSON functions over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import structures as S
from ..functions import text as X
from ..functions import vectors as V
from ..registry import query

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("o_x1_nfkc_tokens", r"SELECT vec_id AS id, list_filter(string_split(trim(regexp_replace(lower(concat('AB-', vec_id, ' x1')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS terms FROM embeddings")
def nfkc_tokens(t):
    wide = F.concat(F.lit("ＡＢ－"), F.col("vec_id").cast("string"), F.lit("　ｘ１"))  # full-width forms
    return t.embeddings.select(F.col("vec_id").alias("id"), X.terms(X.nfkc(wide)).alias("terms"))


@query("o_x3_clean_lines", r"SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS clean FROM documents")
def clean_lines(t):
    return t.documents.select("doc_id", X.clean_lines(F.col("text")).alias("clean"))


@query("o_x4_strip_markup", r"""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</t[dh]>\s*<t[dh][^>]*>', ' | ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|ul|ol|section|article)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS plain FROM pages""")
def strip_markup(t):
    return t.pages.select("page_id", X.strip_markup(F.col("html")).alias("plain"))


@query("o_x4_numeric_entities", "SELECT page_id, list_reduce(list_prepend(html, list_distinct(regexp_extract_all(html, '&#([0-9]{1,6});', 1))), lambda a, x: replace(a, '&#' || x || ';', chr(CAST(x AS INTEGER)))) AS plain FROM (SELECT page_id, html || ' &#8212; &#44032;&#65; &#8212;' AS html FROM pages)")
def numeric_entities(t):
    return t.pages.select("page_id", X.decode_entities(F.concat("html", F.lit(" &#8212; &#44032;&#65; &#8212;"))).alias("plain"))


@query("o_x5_first_sentence", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '^([^.!?\n]+[.!?])', 1), ''), text) AS excerpt FROM documents")
def first_sentence(t):
    return t.documents.select("doc_id", X.first_sentence(F.col("text")).alias("excerpt"))


@query("o_x6_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 96 THEN concat(rtrim(substr(text, 1, 96)), '...') ELSE text END AS preview FROM conversations")
def preview(t):
    return t.conversations.select("conv_id", "turn", X.preview(F.col("text")).alias("preview"))


_PERSONAL = ("강사: 홍길동", "문의 02-123-4567 또는 a.b@example.com", "신청자 이름 홍길동 010-1234-5678", "생년월일 2000-01-01\n연락처 : 010 1234 5678", "참가 신청서", "주소: 서울", "신청자\u3000이름\u3000: 홍길동", "참가\u00a0신청서", "말\u00a0\u00a0전화 02-123-4567\u3000:\u00a0", None)


@query("o_x7_redact_lines")
def redact_lines(t):
    line = F.element_at(F.array(*[F.lit(v).cast("string") for v in _PERSONAL]), (F.col("doc_id") % len(_PERSONAL) + 1).cast("int"))
    r = X.sanitised(F.concat_ws("\n", "text", line), True)
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.text", "r.categories")


@query("o_x8_forbidden", rf"SELECT doc_id, regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, 'token = ') AS forbidden FROM documents")
def forbidden(t):
    return t.documents.select("doc_id", (F.col("text").rlike(_EMAIL) | F.col("text").rlike("token = ")).alias("forbidden"))


@query("o_x9_remove_known", "SELECT doc_id, replace(text, source, '') AS text FROM documents")
def remove_known(t):
    return t.documents.select("doc_id", F.when(F.col("source") != "", F.replace("text", "source", F.lit(""))).otherwise(F.col("text")).alias("text"))


# What is scrubbed from search texts: addresses, phone numbers, links, account-like numbers, address lines.
_SCRUBBED = (_EMAIL, r"\+?[0-9]{0,3} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", r"https?://[^ \n]+", r"[0-9]{2,6}-[0-9]{2,6}-[0-9]{4,8}", r"(?i)(address|phone|e-?mail) ?: ?[^\n]*")
_SCRUB = "text"
for _pattern in _SCRUBBED:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_pattern}', '', 'g')"


@query("o_x10_scrub", f"SELECT doc_id, trim(regexp_replace({_SCRUB}, ' {{2,}}', ' ', 'g')) AS text FROM documents")
def scrub(t):
    x = F.col("text")
    for pattern in _SCRUBBED:
        x = F.regexp_replace(x, pattern, "")
    return t.documents.select("doc_id", F.trim(F.regexp_replace(x, " {2,}", " ")).alias("text"))


@query("o_x11_failure_message", r"SELECT page_id, left(regexp_replace(concat('failed: ', url, ' ', html), 'https?://[^\s]+', '[URL]', 'g'), 500) AS message FROM pages")
def failure_message(t):
    return t.pages.select("page_id", F.left(F.regexp_replace(F.concat(F.lit("failed: "), "url", F.lit(" "), "html"), r"https?://[^\s]+", "[URL]"), F.lit(500)).alias("message"))


@query("o_x12_mask_url", r"SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/...') AS masked FROM pages WHERE url LIKE 'http%'")
def mask_url(t):
    u = F.col("url")
    return t.pages.filter(u.startswith("http")).select("page_id", F.concat(F.regexp_extract(u, "^(https?://[^/]+)", 1), F.lit("/...")).alias("masked"))


@query("o_x13_comparison_key", r"SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^((?:\[[^\]]+\]\s*)+)', ''), '\([^)]*[0-9]{1,2}:[0-9]{2}[^)]*\)', '', 'g'), '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}', '', 'g'), '(?i)\b(round|part|no\.?)\s*[0-9]+|#[0-9]+', '', 'g')), '[^\p{L}\p{N}]+', '', 'g') AS key FROM (SELECT page_id, concat('[notice] ', url, ' 2024-05-01 (11:00~12:00) Part ', page_id) AS t FROM pages)")
def comparison_key(t):
    title = F.concat(F.lit("[notice] "), "url", F.lit(" 2024-05-01 (11:00~12:00) Part "), F.col("page_id").cast("string"))
    return t.pages.select("page_id", X.comparison_key(title).alias("key"))


@query("o_x16_group_key", "SELECT o_orderkey, concat_ws('|', o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m')) AS key FROM orders")
def group_key(t):
    return t.orders.select("o_orderkey", F.concat_ws("|", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM")).alias("key"))


@query("o_x17_leading_tags", r"SELECT p_partkey, regexp_extract_all(regexp_extract(concat('[', p_brand, '] [', p_type, ']  ', p_name), '^((?:\[[^\]]+\]\s*)+)', 1), '\[([^\]]+)\]', 1) AS tags FROM part")
def leading_tags(t):
    return t.part.select("p_partkey", X.leading_tags(F.concat(F.lit("["), "p_brand", F.lit("] ["), "p_type", F.lit("]  "), "p_name")).alias("tags"))


@query("o_x18_label_value", r"SELECT event_id, trim(regexp_extract(line, '^[-*\s]*([^:]+?)\s*:', 1)) AS label, trim(regexp_extract(line, ':\s*(.*)$', 1)) AS value FROM (SELECT event_id, concat('- ', event_type, ' : ', value) AS line FROM (SELECT event_id, event_type, user_id AS value FROM events))")
def label_value(t):
    line = F.concat(F.lit("- "), "event_type", F.lit(" : "), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.trim(F.regexp_extract(line, r"^[-*\s]*([^:]+?)\s*:", 1)).alias("label"), F.trim(F.regexp_extract(line, r":\s*(.*)$", 1)).alias("value"))


@query("o_x20_label_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' WHEN 'error' THEN 'ignored' ELSE 'unknown' END AS field FROM events")
def label_lookup(t):
    known = F.create_map(*[F.lit(x) for x in ("view", "seen", "click", "seen", "error", "ignored")])
    return t.events.select("event_id", F.coalesce(F.try_element_at(known, F.col("event_type")), F.lit("unknown")).alias("field"))


@query("o_x21_topics", "SELECT doc_id, CASE WHEN contains(text, 'License') AND right(trim(text), 1) = '.' THEN 'license' WHEN contains(text, '@') THEN 'contact' ELSE 'none' END AS topic FROM documents")
def topics(t):
    has = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda k: F.contains("text", k))
    return t.documents.select("doc_id", F.when(has("License") & (F.right(F.trim("text"), F.lit(1)) == "."), "license").when(has("@"), "contact").otherwise("none").alias("topic"))


@query("o_x23_group_detail", "SELECT p_partkey, list_filter(string_split(p_type, ' ')[2:3], lambda w: w IN ('BRUSHED', 'ANODIZED', 'STEEL', 'BRASS')) AS details FROM part")
def group_detail(t):
    return t.part.select("p_partkey", F.filter(F.slice(F.split("p_type", " "), 2, 2), lambda w: w.isin("BRUSHED", "ANODIZED", "STEEL", "BRASS")).alias("details"))


@query("o_x24_capacity", r"SELECT p_partkey, CASE WHEN len(n) = 1 THEN TRY_CAST(n[1] AS INTEGER) END AS capacity, len(n) > 1 AS ambiguous FROM (SELECT p_partkey, list_distinct(regexp_extract_all(concat(p_brand, ' ', p_name), '[0-9]+')) AS n FROM part)")
def capacity(t):
    n = F.array_distinct(F.regexp_extract_all(F.concat("p_brand", F.lit(" "), "p_name"), F.lit("([0-9]+)"), 1))
    p = t.part.select("p_partkey", n.alias("n"))
    return p.select("p_partkey", F.when(F.size("n") == 1, F.col("n")[0].try_cast("int")).alias("capacity"), (F.size("n") > 1).alias("ambiguous"))


@query("o_x26_warnings", "SELECT doc_id, list_filter([CASE WHEN n_chars < 100 THEN 'SHORT' END, CASE WHEN contains(text, '@') THEN 'CONTACT' END], lambda x: x IS NOT NULL) AS warnings, CASE WHEN n_chars < 100 THEN 'REVIEW' WHEN contains(text, '@') THEN 'WARN' ELSE 'OK' END AS status FROM documents")
def warnings(t):
    short, contact = F.col("n_chars") < 100, F.contains("text", F.lit("@"))
    return t.documents.select("doc_id", F.array_compact(F.array(F.when(short, "SHORT"), F.when(contact, "CONTACT"))).alias("warnings"), F.when(short, "REVIEW").when(contact, "WARN").otherwise("OK").alias("status"))


_RULES = (("LICENSE", "License"), ("CONTACT", "@"), ("TABLE", r"\|"))
_FOUND = r"list_filter([CASE WHEN regexp_matches(text, 'License') THEN 'LICENSE' END, CASE WHEN regexp_matches(text, '@') THEN 'CONTACT' END, CASE WHEN regexp_matches(text, '\|') THEN 'TABLE' END], lambda x: x IS NOT NULL)"


@query("o_x27_multi_label", f"SELECT doc_id, CASE WHEN len({_FOUND}) > 0 THEN {_FOUND} ELSE ['UNKNOWN'] END AS labels FROM documents")
def multi_label(t):
    return t.documents.select("doc_id", X.labels_of(F.col("text"), _RULES).alias("labels"))


@query("o_x28_capped_taxonomy", f"SELECT doc_id, CASE WHEN len({_FOUND}) > 0 THEN ({_FOUND})[1:2] ELSE ['UNKNOWN'] END AS labels FROM documents")
def capped_taxonomy(t):
    return t.documents.select("doc_id", X.labels_of(F.col("text"), _RULES, cap=2).alias("labels"))


@query("o_x31_fallback", f"SELECT doc_id, CASE WHEN len({_FOUND}) > 0 THEN {_FOUND} ELSE [upper(lang)] END AS labels, CASE WHEN len({_FOUND}) > 0 THEN 'text' ELSE 'lang' END AS origin FROM documents")
def fallback(t):
    found = X.labels_of(F.col("text"), _RULES)
    unknown = F.array_contains(found, "UNKNOWN")
    return t.documents.select("doc_id", F.when(unknown, F.array(F.upper("lang"))).otherwise(found).alias("labels"), F.when(unknown, "lang").otherwise("text").alias("origin"))


@query("o_x32_keywords", r"SELECT item_id, (list_sort(list_filter(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'of'))))[1:20] AS words FROM benchmark")
def keywords(t):
    return t.benchmark.select("item_id", X.keywords(F.col("text"), ("the", "and", "of")).alias("words"))


@query("o_x33_expansion", "SELECT event_id, concat_ws(' ', event_type, CASE event_type WHEN 'view' THEN 'look see' WHEN 'purchase' THEN 'buy' END) AS expanded FROM events")
def expansion(t):
    more = F.try_element_at(F.create_map(F.lit("view"), F.lit("look see"), F.lit("purchase"), F.lit("buy")), F.col("event_type"))
    return t.events.select("event_id", F.concat_ws(" ", "event_type", more).alias("expanded"))


@query("o_x34_template", "SELECT p_partkey, concat_ws(chr(10), concat('name: ', p_name), CASE WHEN p_size > 10 THEN concat('size: ', p_size) END, concat('type: ', p_type)) AS body FROM part")
def template(t):
    size = F.when(F.col("p_size") > 10, F.concat(F.lit("size: "), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.concat_ws("\n", F.concat(F.lit("name: "), "p_name"), size, F.concat(F.lit("type: "), "p_type")).alias("body"))


@query("o_x35_ordered_children", "SELECT l_orderkey, string_agg(concat(l_linenumber, '. ', l_returnflag), chr(10) ORDER BY l_linenumber, l_returnflag) AS body FROM lineitem GROUP BY 1")
def ordered_children(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit(". "), r["l_returnflag"])), "\n").alias("body"))


@query("o_x36_drop_title", "SELECT doc_id, trim(array_to_string(list_filter(l, lambda x, i: i = 1 OR (trim(x) <> trim(l[1]) AND NOT contains(lower(x), 'licensed under') AND NOT contains(lower(x), 'all rights reserved'))), chr(10))) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def drop_title(t):
    """The body without later repetitions of its title (the first line) and without notices."""
    notice = lambda x: F.contains(F.lower(x), F.lit("licensed under")) | F.contains(F.lower(x), F.lit("all rights reserved"))
    d = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", F.trim(F.array_join(F.filter("l", lambda x, i: (i == 0) | ((F.trim(x) != F.trim(F.col("l")[0])) & ~notice(x))), "\n")).alias("body"))


@query("o_x37_search_text", "SELECT doc_id, left(concat_ws(' ', lang, source, text), 1000) AS dense, length(concat_ws(' ', lang, source, text)) > 1000 AS truncated FROM documents")
def search_text(t):
    x = F.concat_ws(" ", "lang", "source", "text")
    return t.documents.select("doc_id", F.left(x, F.lit(1000)).alias("dense"), (F.length(x) > 1000).alias("truncated"))


@query("o_x38_profile_variants", "SELECT p_partkey, v AS variant, concat_ws(' ', p_name, CASE WHEN v >= 1 THEN p_brand END, CASE WHEN v >= 2 THEN p_type END) AS profile FROM part, (VALUES (0), (1), (2)) x(v)")
def profile_variants(t):
    p = t.part.withColumn("variant", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return p.select("p_partkey", "variant", F.concat_ws(" ", "p_name", F.when(F.col("variant") >= 1, F.col("p_brand")), F.when(F.col("variant") >= 2, F.col("p_type"))).alias("profile"))


@query("o_x39_detail_level", r"SELECT doc_id, CASE WHEN n > 10 THEN 'detailed' WHEN n > 0 THEN 'basic' ELSE 'none' END AS level FROM (SELECT doc_id, len(regexp_extract_all(text, '\n')) AS n FROM documents)")
def detail_level(t):
    n = F.regexp_count("text", F.lit("\n"))
    return t.documents.select("doc_id", F.when(n > 10, "detailed").when(n > 0, "basic").otherwise("none").alias("level"))


@query("o_x40_comparable", r"SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = lower(n_name) AS same, contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name)) AS within FROM nation JOIN region ON r_regionkey = n_regionkey")
def comparable(t):
    j = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    a, b = F.lower("n_name"), F.lower("r_name")
    return j.select("n_nationkey", (F.regexp_replace(a, "[^a-z0-9]", "") == a).alias("same"), (F.contains(a, b) | F.contains(b, a)).alias("within"))


@query("o_x42_edit_similarity", "SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / CAST(greatest(length(a.n_name), length(b.n_name)) AS DOUBLE), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_similarity(t):
    a = t.nation.select("n_regionkey", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"))
    b = t.nation.select("n_regionkey", F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b", F.round(X.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("o_x43_match_score", "SELECT p_partkey, least(0.95, round(CASE WHEN share >= 0.8 THEN 0.9 WHEN share >= 0.4 THEN 0.6 ELSE 0.2 END + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END, 4)) AS score FROM (SELECT p_partkey, p_size, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) / CAST(len(list_distinct(string_split(lower(p_name), ' '))) AS DOUBLE) AS share FROM part)")
def match_score(t):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))
    step = F.when(share >= 0.8, 0.9).when(share >= 0.4, 0.6).otherwise(0.2)
    return t.part.select("p_partkey", F.least(F.lit(0.95), F.round(step + F.when(F.col("p_size") > 25, 0.1).otherwise(0.0), 4)).alias("score"))


@query("o_x44_class_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS latin, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits, len(regexp_extract_all(text, '[^\x00-\x7F]'))::BIGINT AS wide FROM documents")
def class_counts(t):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n("[A-Za-z]").alias("latin"), n("[0-9]").alias("digits"), n(r"[^\x00-\x7F]").alias("wide"))


@query("o_x45_control_share", r"SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x1F]')) > greatest(3, 0.01 * length(text)) AS excessive FROM documents")
def control_share(t):
    return t.documents.select("doc_id", (F.regexp_count("text", F.lit(r"[\x00-\x1F]")) > F.greatest(F.lit(3.0), 0.01 * F.length("text"))).alias("excessive"))


@query("o_x46_schedule", "SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' WHEN day(o_orderdate) <= 7 THEN 'first week' ELSE 'weekday' END AS pattern FROM orders")
def schedule(t):
    return t.orders.select("o_orderkey", F.when(F.dayofweek("o_orderdate").isin(1, 7), "weekend").when(F.dayofmonth("o_orderdate") <= 7, "first week").otherwise("weekday").alias("pattern"))


@query("o_x47_signals", r"SELECT doc_id, regexp_matches(text, '[0-9]{16}') AS card, regexp_extract_all(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS phones FROM documents")
def signals(t):
    return t.documents.select("doc_id", F.col("text").rlike("[0-9]{16}").alias("card"), F.regexp_extract_all("text", F.lit(r"(\([0-9]{3}\) [0-9]{3}-[0-9]{4})"), 1).alias("phones"))


@query("o_x48_relationship", "SELECT conv_id, CASE WHEN bool_and(role <> 'system') THEN 'plain' WHEN bool_or(role = 'system') AND count(*) > 3 THEN 'guided' ELSE 'short' END AS kind FROM conversations GROUP BY 1")
def relationship(t):
    g = t.conversations.groupBy("conv_id").agg(F.bool_and(F.col("role") != "system").alias("plain"), F.count("*").alias("n"))
    return g.select("conv_id", F.when(F.col("plain"), "plain").when(F.col("n") > 3, "guided").otherwise("short").alias("kind"))


@query("o_x49_exceptions", "SELECT n_nationkey, list_filter([CASE WHEN n_nationkey NOT IN (SELECT s_nationkey FROM supplier) THEN 'NO_SUPPLIER' END, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) THEN 'DEBT' END], lambda x: x IS NOT NULL) AS codes FROM nation")
def exceptions(t):
    s = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("s", F.lit(True))
    d = t.customer.filter("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("d", F.lit(True))
    j = t.nation.join(s, "n_nationkey", "left").join(d, "n_nationkey", "left")
    return j.select("n_nationkey", F.array_compact(F.array(F.when(F.col("s").isNull(), "NO_SUPPLIER"), F.when(F.col("d"), "DEBT"))).alias("codes"))


@query("o_x50_first_label_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_label_wins(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))


@query("o_x51_notice_split", "SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: length(x) >= 8))) AS notices FROM documents")
def notice_split(t):
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: F.length(x) >= 8))).alias("notices"))


@query("o_x52_session_number", "SELECT event_id, CASE WHEN TRY_CAST(replace(replace(s, 'l', '1'), 'O', '0') AS INTEGER) BETWEEN 1 AND 60 THEN TRY_CAST(replace(replace(s, 'l', '1'), 'O', '0') AS INTEGER) END AS session FROM (SELECT event_id, replace(replace(CAST(user_id AS VARCHAR), '1', 'l'), '0', 'O') AS s FROM events)")
def session_number(t):
    s = F.translate(F.translate(F.col("user_id").cast("string"), "10", "lO"), "lO", "10").try_cast("int")
    return t.events.select("event_id", F.when(s.between(1, 60), s).alias("session"))


@query("o_x53_category", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'numbers' WHEN regexp_matches(text, '\|') THEN 'table' ELSE 'text' END AS category FROM conversations")
def category(t):
    return t.conversations.select("conv_id", "turn", X.first_label(F.col("text"), (("numbers", "[0-9]"), ("table", r"\|")), "text").alias("category"))


_MESSAGES = ("connect ETIMEDOUT 10.0.0.1", "HTTP 503 from server", "HTTP 404", "read ECONNRESET", "JSON parse error at 3", "HTTP 429 too many", "", "disk full")
_FAILURES = (("TIMEOUT", "(?i)timed? ?out|etimedout", True), ("RATE_LIMIT", "429|(?i)too many", True), ("SERVER", "HTTP 5[0-9]{2}", True), ("NETWORK", "(?i)econn|network", True), ("CLIENT", "HTTP 4[0-9]{2}", False), ("PARSE", "(?i)parse|syntax", False))
_MESSAGE = f"([{', '.join(repr(m) for m in _MESSAGES)}])[CAST(event_id % {len(_MESSAGES)} AS INTEGER) + 1]"


@query("o_x54_failures", f"SELECT category, category IN ({', '.join(repr(n) for n, _, again in _FAILURES if again)}) AS retryable, count(*) AS n FROM (SELECT CASE {' '.join(f'WHEN regexp_matches(m, {p!r}) THEN {n!r}' for n, p, _ in _FAILURES)} ELSE 'UNKNOWN' END AS category FROM (SELECT {_MESSAGE} AS m FROM events)) GROUP BY 1, 2")
def failures(t):
    """The first category whose pattern a message has, and whether it is worth another attempt."""
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    category = X.first_label(message, tuple((n, p) for n, p, _ in _FAILURES), "UNKNOWN")
    again = F.col("category").isin(*[n for n, _, again in _FAILURES if again])
    return t.events.select(category.alias("category")).groupBy("category", again.alias("retryable")).agg(F.count("*").alias("n"))


@query("o_x55_lanes", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returns' WHEN count(*) = 1 THEN 'single' ELSE 'normal' END AS lane FROM lineitem GROUP BY 1")
def lane_routing(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))
    return g.select("l_orderkey", F.when(F.col("returned"), "returns").when(F.col("n") == 1, "single").otherwise("normal").alias("lane"))


@query("o_x56_between", "SELECT page_id, CASE WHEN position('<h1>' IN html) > 0 THEN trim(substr(r, 1, least(CASE WHEN position('</h1>' IN r) > 0 THEN position('</h1>' IN r) ELSE length(r) + 1 END - 1, 200))) END AS title FROM (SELECT page_id, html, substr(html, position('<h1>' IN html) + 4) AS r FROM pages)")
def between(t):
    return t.pages.select("page_id", X.between_markers(F.col("html"), "<h1>", ("</h1>",), 200).alias("title"))


@query("o_x58_data_url", "SELECT n_nationkey, sha256(from_base64(to_base64(encode(n_name)))) AS key FROM nation")
def data_url(t):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("n_name", "utf-8")))
    return t.nation.select("n_nationkey", F.sha2(F.unbase64(F.regexp_extract(url, "^data:[^;]*;base64,(.*)$", 1)), 256).alias("key"))


@query("o_x59_display", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'free' WHEN p_retailprice > 1500 THEN concat(CAST(floor(p_retailprice) AS BIGINT), ' up') ELSE 'normal' END AS fee, replace('2024-05-01', '-', '.') AS day FROM part")
def display(t):
    fee = F.when(F.col("p_size") < 5, "free").when(F.col("p_retailprice") > 1500, F.concat(F.floor("p_retailprice").cast("string"), F.lit(" up"))).otherwise("normal")
    return t.part.select("p_partkey", fee.alias("fee"), F.replace(F.lit("2024-05-01"), F.lit("-"), F.lit(".")).alias("day"))


# ---- dates

_DAY = "(CASE WHEN o_orderkey % 3 = 0 THEN '2024-02-30' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'x' END)"


@query("o_d1_calendar_date", f"SELECT o_orderkey, coalesce(strftime(TRY_CAST({_DAY} AS DATE), '%Y-%m-%d') = {_DAY}, false) AS valid FROM orders")
def calendar_date(t):
    k = F.col("o_orderkey") % 3
    return t.orders.select("o_orderkey", S.is_calendar_date(F.when(k == 0, "2024-02-30").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("x")).alias("valid"))


@query("o_d2_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS \"start\", '2024-12-31' AS \"end\" FROM orders")
def date_range(t):
    x = S.date_range(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ~ 2024-12-31")))
    return t.orders.select("o_orderkey", x.alias("r")).select("o_orderkey", "r.start", "r.end")


@query("o_d3_weekly", "SELECT o_orderkey, len(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(7 * (o_orderkey % 4) + 2 AS INTEGER), INTERVAL 7 DAY)) = 1 + o_orderkey % 4 AS fits FROM orders")
def weekly(t):
    a = F.to_date("o_orderdate")
    days = S.weekly_dates(a, F.expr("date_add(to_date(o_orderdate), CAST(7 * (o_orderkey % 4) + 2 AS INT))"), (1 + F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", days.isNotNull().alias("fits"))


@query("o_d4_grid", "SELECT DISTINCT d - CAST(dayofweek(d) AS INTEGER) AS week, (d + INTERVAL 1 MONTH)::DATE AS next_month FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)")
def grid(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(S.week_start(d).alias("week"), F.add_months(d, 1).alias("next_month")).distinct()


@query("o_d5_reversed", "SELECT count_if(a > b) AS reversed, count_if(apply_end > a) AS late_applications, count(*) AS n FROM (SELECT o_orderdate AS a, TIMESTAMP '1995-01-01' + to_days(CAST(o_orderkey % 1000 AS INTEGER)) AS b, o_orderdate + to_days(CAST(o_orderkey % 9 - 6 AS INTEGER)) AS apply_end FROM orders)")
def reversed_ranges(t):
    a = F.col("o_orderdate").cast("timestamp")
    b = F.expr("date_add(DATE '1995-01-01', CAST(o_orderkey % 1000 AS INT))").cast("timestamp")
    apply_end = F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(CAST(o_orderkey % 9 - 6 AS INT))")
    return t.orders.select(a.alias("a"), b.alias("b"), apply_end.alias("apply_end")).agg(F.count_if(F.col("a") > F.col("b")).alias("reversed"), F.count_if(F.col("apply_end") > F.col("a")).alias("late_applications"), F.count("*").alias("n"))


@query("o_d6_age", "SELECT event_id, round((epoch_us(m.now) - epoch_us(ts)) / 3600000000.0, 3) AS hours, (epoch_us(m.now) - epoch_us(ts)) / 3600000000.0 >= 1 AS stale FROM events, (SELECT max(ts) AS now FROM events) m")
def age(t):
    now = t.events.agg(F.max("ts").alias("now"))
    e = t.events.join(F.broadcast(now), how="cross")
    hours = S.age_hours(F.col("now").cast("timestamp"), F.col("ts").cast("timestamp"))
    return e.select("event_id", F.round(hours, 3).alias("hours"), (hours >= 1).alias("stale"))


# ---- vectors, arrays, JSON


@query("o_v1_dot", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(len(embedding)), lambda i: CAST(i AS DOUBLE))), 6) AS dot FROM embeddings")
def dot(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.dot(e, F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: i.cast("double"))), 6).alias("dot"))


@query("o_v2_cosine_distance", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings e")
def cosine_distance(t):
    q = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q), how="cross").select("vec_id", F.round(1 - V.cosine(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("o_v3_validation", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def validation(t):
    return t.embeddings.select("vec_id", V.is_finite(F.col("embedding"), 64).alias("valid"))


@query("o_v4_synthetic", "SELECT vec_id, list_transform(raw, lambda x: round(x / sqrt(list_sum(list_transform(raw, lambda y: y * y))), 9)) AS v FROM (SELECT vec_id, list_transform(range(16), lambda i: CAST((vec_id + 17 * i) % 101 - 50 AS DOUBLE)) AS raw FROM embeddings)")
def synthetic(t):
    return t.embeddings.select("vec_id", F.transform(V.synthetic(F.col("vec_id"), 16), lambda x: F.round(x, 9)).alias("v"))


@query("o_r1_clean_list", "SELECT p_partkey, list_filter(list_transform([p_brand, concat(' ', p_brand), '', p_type], lambda x: trim(x)), lambda x: x <> '')[1:1] || [trim(p_type)] AS items FROM part")
def clean_list(t):
    return t.part.select("p_partkey", S.clean_list(F.array("p_brand", F.concat(F.lit(" "), "p_brand"), F.lit(""), "p_type")).alias("items"))


@query("o_r2_flatten", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def flatten(t):
    g = t.conversations.groupBy("conv_id", "role").agg(F.collect_list("turn").alias("x")).groupBy("conv_id").agg(F.collect_list("x").alias("xs"))
    return g.select("conv_id", F.size(F.flatten("xs")).cast("long").alias("n"))


@query("o_r5_merge_text", "SELECT user_id, event_type, array_to_string(list_sort(list_filter(l, lambda x: len(list_filter(l, lambda y: y <> x AND contains(y, x))) = 0)), ' ') AS body FROM (SELECT user_id, event_type, list(DISTINCT CAST(event_id % 97 AS VARCHAR)) AS l FROM events GROUP BY 1, 2)")
def merge_text(t):
    """Distinct pieces joined, those that another piece contains left out."""
    pieces = t.events.groupBy("user_id", "event_type").agg(F.collect_set((F.col("event_id") % 97).cast("string")).alias("l"))
    whole = F.filter("l", lambda x: ~F.exists("l", lambda y: (y != x) & F.contains(y, x)))
    return pieces.select("user_id", "event_type", F.array_join(F.array_sort(whole), " ").alias("body"))


@query("o_r6_markup_units", r"SELECT page_id, pos, item FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS item, generate_subscripts(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1), 1) - 1 AS pos FROM pages)")
def markup_units(t):
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">'), 1)).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


@query("o_r7_page_merge", "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.turn IS NULL THEN 'only user' WHEN b.turn IS NULL THEN 'only long' ELSE 'both' END AS state FROM (SELECT conv_id, turn FROM conversations WHERE length(text) > 300) a FULL JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user') b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def page_merge(t):
    a = t.conversations.filter("length(text) > 300").select("conv_id", "turn", F.lit(1).alias("a"))
    b = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lit(1).alias("b"))
    return a.join(b, ["conv_id", "turn"], "full_outer").select("conv_id", "turn", F.when(F.col("a").isNull(), "only user").when(F.col("b").isNull(), "only long").otherwise("both").alias("state"))


@query("o_r8_reading_order", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS reading, bool_and(length(text) > 10) AS complete, round(avg(length(text)), 4) AS mean FROM conversations GROUP BY 1")
def reading_order(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.bool_and(F.length("text") > 10).alias("complete"), F.round(F.avg(F.length("text")), 4).alias("mean"))
    return g.select("conv_id", F.array_join("x.role", ">").alias("reading"), "complete", "mean")


@query("o_r10_section_ranges", "SELECT conv_id, turn AS a, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS b FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE role = 'user'")
def section_ranges(t):
    c = t.conversations.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).filter("role = 'user'")
    return c.select("conv_id", F.col("turn").alias("a"), F.coalesce(F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - 1, "last").alias("b"))


@query("o_r12_longest_wins", "SELECT source, lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def longest_wins(t):
    return t.documents.groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("o_r13_overrides", "SELECT coalesce(a.n_nationkey, b.k) AS k, coalesce(b.v, a.n_name) AS v FROM nation a FULL JOIN (VALUES (1, 'NEW'), (2, ''), (99, 'ADDED')) b(k, v) ON a.n_nationkey = b.k WHERE coalesce(b.v, a.n_name) <> ''")
def overrides(t):
    b = t.spark.createDataFrame([(1, "NEW"), (2, ""), (99, "ADDED")], "k int, new string")
    j = t.nation.select(F.col("n_nationkey").alias("k"), "n_name").join(b, "k", "full_outer")
    return j.select("k", F.coalesce("new", "n_name").alias("v")).filter("v <> ''")


@query("o_p1_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def payload(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("o_p2_row_json", "SELECT n_nationkey, concat('{\"n_nationkey\":', n_nationkey, ',\"n_name\":\"', n_name, '\"}') AS line FROM nation")
def row_json(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))


@query("o_p3_content_hash", "SELECT n_nationkey, sha256(concat('{\"n_name\":\"', n_name, '\",\"n_nationkey\":', n_nationkey, '}')) AS h FROM nation")
def content_hash(t):
    return t.nation.select("n_nationkey", S.content_hash(["n_nationkey", "n_name"]).alias("h"))


@query("o_p4_entry", "SELECT o_custkey, min(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def entry_value(t):
    g = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_totalprice").alias("value")).groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("label"), "value")).alias("x"))
    return g.select("o_custkey", S.entry_value(F.col("x"), "1-URGENT").alias("urgent"))


@query("o_p5_survey_defaults", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def survey_defaults(t):
    p = F.from_json("props", "k string, missing string")
    return t.events.select("event_id", p.alias("p")).select("event_id", F.coalesce(F.col("p.k").try_cast("int"), F.lit(0)).alias("k"), F.coalesce("p.missing", F.lit("none")).alias("missing"))


# ---- scores


_SET = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query("o_m6_evidence", f"SELECT a.item_id, b.item_id AS other, CASE WHEN contains(lower(a.text), lower(b.text)) THEN 1.0 ELSE round(len(list_intersect({_SET.format('a.text')}, {_SET.format('b.text')})) / CAST(len({_SET.format('b.text')}) AS DOUBLE), 6) END AS score FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def evidence(t):
    a = t.benchmark.select("item_id", "text")
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("text_b"))
    x, y = F.array_distinct(X.terms(F.col("text"))), F.array_distinct(X.terms(F.col("text_b")))
    share = F.round(F.size(F.array_intersect(x, y)) / F.size(y), 6)
    return a.join(b, "item_id").select("item_id", "other", F.when(F.contains(F.lower("text"), F.lower("text_b")), 1.0).otherwise(share).alias("score"))


@query("o_m7_block_roles", "SELECT doc_id, CASE WHEN n_chars < 60 THEN 'heading' WHEN contains(text, '|') THEN 'table' ELSE 'body' END AS role, CASE WHEN n_chars < 60 THEN 0.9 WHEN contains(text, '|') THEN 0.8 ELSE 0.5 END AS confidence FROM documents")
def block_roles(t):
    pair = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).cast("decimal(2,1)").alias("confidence"))
    x = F.when(F.col("n_chars") < 60, pair("heading", 0.9)).when(F.contains("text", F.lit("|")), pair("table", 0.8)).otherwise(pair("body", 0.5))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", "x.role", "x.confidence")


@query("o_m8_mean_class", "SELECT user_id, CASE WHEN avg(value) >= 60 THEN 'HIGH' WHEN avg(value) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM events GROUP BY 1")
def mean_class(t):
    m = F.avg("value")
    return t.events.groupBy("user_id").agg(F.when(m >= 60, "HIGH").when(m >= 40, "MEDIUM").otherwise("LOW").alias("class"))
