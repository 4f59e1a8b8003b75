"""Projections, filters and joins over the star schema, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.normalise import containments
from ..operators.ranking import global_rank
from ..registry import query


@query("o_f1_pruned_list", "SELECT c_custkey, c_name, struct_pack(segment := c_mktsegment).segment AS segment FROM customer")
def pruned_list(t):
    return t.customer.select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment")).alias("evidence")).select("c_custkey", "c_name", "evidence.segment")


@query("o_f2_optional_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (NULL IS NULL OR o_orderstatus = NULL) AND ('1-URGENT' IS NULL OR o_orderpriority = '1-URGENT')")
def optional_filter(t, status=None, priority="1-URGENT"):
    out = t.orders
    for column, value in (("o_orderstatus", status), ("o_orderpriority", priority)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out.select("o_orderkey", "o_orderstatus")


@query("o_f3_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('An'))")
def substring(t):
    return t.part.filter(F.contains(F.lower("p_name"), F.lower(F.lit("An")))).select("p_partkey", "p_name")


@query("o_f4_or_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'heed') OR contains(lower(source), 'src7') OR list_contains(string_split(lang, '-'), 'de')")
def or_search(t):
    return t.documents.filter(F.contains(F.lower("text"), F.lit("heed")) | F.contains(F.lower("source"), F.lit("src7")) | F.array_contains(F.split("lang", "-"), "de")).select("doc_id")


@query("o_f5_blank_insensitive", r"SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(concat(source, text)), '[\s\x0B]+', '', 'g'), 'andthe')")
def blank_insensitive(t):
    joined = F.regexp_replace(F.lower(F.concat("source", "text")), r"\s+", "")
    return t.documents.filter(F.contains(joined, F.lit("andthe"))).select("doc_id")


@query("o_f6_facets", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_custkey % 3 = 0")
def facets(t):
    return t.orders.filter("o_orderstatus = 'F'").filter("o_orderpriority = '2-HIGH'").filter("o_custkey % 3 = 0").select("o_orderkey")


@query("o_f9_recent_lease", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTES")
def recent_lease(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now), how="cross").filter("event_type = 'error' AND ts >= now - INTERVAL 30 MINUTES").select("event_id")


@query("o_f10_owner_scope", "SELECT event_id FROM events WHERE user_id = 7 OR (user_id IS NULL OR user_id % 50 = 0)")
def owner_scope(t):
    return t.events.filter((F.col("user_id") == 7) | F.col("user_id").isNull() | (F.col("user_id") % 50 == 0)).select("event_id")


@query("o_f11_first_reason", "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'SHORT' WHEN regexp_matches(text, 'License') THEN 'LICENSE' WHEN lang <> 'en' THEN 'LANGUAGE' END AS reason FROM documents")
def first_reason(t):
    reason = F.when(F.length("text") < 200, "SHORT").when(F.col("text").rlike("License"), "LICENSE").when(F.col("lang") != "en", "LANGUAGE")
    return t.documents.select("doc_id", reason.alias("reason"))


@query("o_f12_content_profile", r"SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 20 THEN 'detailed' WHEN contains(text, chr(10)) THEN 'lines' ELSE 'plain' END AS profile FROM documents")
def content_profile(t):
    lines = F.size(F.split("text", "\n"))
    return t.documents.select("doc_id", F.when(lines > 20, "detailed").when(lines > 1, "lines").otherwise("plain").alias("profile"))


@query("o_f13_recruit_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN d > '1997-01-01' THEN 'upcoming' WHEN d >= '1995-01-01' THEN 'open' ELSE 'closed' END AS status FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)")
def recruit_status(t):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "P", "unknown").when(d > "1997-01-01", "upcoming").when(d >= "1995-01-01", "open").otherwise("closed")
    return t.orders.select("o_orderkey", status.alias("status"))


@query("o_f14_presence_flags", "SELECT l.doc_id IS NOT NULL AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def presence_flags(t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("x")), "doc_id", "left")
    return d.groupBy(F.col("x").isNotNull().alias("labelled")).agg(F.count("*").alias("n"))


@query("o_f15_dynamic_where", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand LIKE 'Brand#1%' ORDER BY p_partkey LIMIT 50")
def dynamic_where(t):
    out = t.part
    for predicate in (F.col("p_size").between(5, 20), F.col("p_brand").startswith("Brand#1")):
        out = out.filter(predicate)
    return out.orderBy("p_partkey").limit(50).select("p_partkey")


@query("o_f16_upper_in", "SELECT c_custkey FROM customer WHERE upper(coalesce(c_mktsegment, '')) IN ('BUILDING', 'MACHINERY')")
def upper_in(t):
    return t.customer.filter(F.upper(F.coalesce("c_mktsegment", F.lit(""))).isin("BUILDING", "MACHINERY")).select("c_custkey")


_AUD = "list_filter([CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_size BETWEEN 5 AND 30 THEN 'medium' END, CASE WHEN p_size > 40 THEN 'general' END], lambda x: x IS NOT NULL)"


@query("o_f17_universal_member", f"SELECT p_partkey FROM part WHERE list_has_any({_AUD}, ['medium', 'general'])")
def universal_member(t):
    s = F.col("p_size")
    aud = F.array_compact(F.array(F.when(s < 10, "small"), F.when(s.between(5, 30), "medium"), F.when(s > 40, "general")))
    return t.part.filter(F.arrays_overlap(aud, F.array(F.lit("medium"), F.lit("general")))).select("p_partkey")


@query("o_f18_eligibility", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.045 AND l_tax > 0.02 AND l_quantity / 50 >= 0.66")
def eligibility(t):
    return t.lineitem.filter("l_discount >= 0.045 AND l_tax > 0.02 AND l_quantity / 50 >= 0.66").select("l_orderkey", "l_linenumber")


@query("o_f19_tri_state_filter", f"SELECT p_partkey FROM (SELECT p_partkey, {_AUD} AS aud FROM part) WHERE len(aud) = 0 OR list_has_any(aud, ['small'])")
def tri_state(t):
    s = F.col("p_size")
    aud = F.array_compact(F.array(F.when(s < 10, "small"), F.when(s.between(5, 30), "medium"), F.when(s > 40, "general")))
    same = F.when(F.size(aud) > 0, F.size(F.array_intersect(aud, F.array(F.lit("small")))) > 0)
    return t.part.filter(F.coalesce(same, F.lit(True))).select("p_partkey")


@query("o_f20_range_or_null", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size - 5 END AS lo, p_size + 5 AS hi FROM part) WHERE lo IS NULL OR 30 BETWEEN lo AND hi")
def range_or_null(t):
    p = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size") - 5).alias("lo"), (F.col("p_size") + 5).alias("hi"))
    return p.filter("lo IS NULL OR 30 BETWEEN lo AND hi").select("p_partkey")


@query("o_f21_inspector", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, count(*) AS n FROM orders GROUP BY o_custkey HAVING list_contains(list(DISTINCT o_orderpriority), '1-URGENT') ORDER BY o_custkey LIMIT 500")
def inspector(t):
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("n"))
    return g.filter(F.array_contains("priorities", "1-URGENT")).orderBy("o_custkey").limit(500)


@query("o_f22_regex_audit", r"SELECT count_if(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, count_if(regexp_matches(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS phones, count_if(regexp_matches(text, '(?i)licen[cs]e')) AS licenses FROM documents")
def regex_audit(t):
    x = F.col("text")
    n = lambda p: F.count_if(x.rlike(p))
    return t.documents.agg(n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), n(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}").alias("phones"), n("(?i)licen[cs]e").alias("licenses"))


@query("o_f23_validation_issues", "SELECT p_partkey, list_filter([CASE WHEN p_size > 45 THEN 'part.size' END, CASE WHEN p_retailprice < 950 THEN 'part.retailprice' END, CASE WHEN length(p_name) > 20 THEN 'part.name' END], lambda x: x IS NOT NULL) AS issues FROM part WHERE p_size > 45 OR p_retailprice < 950 OR length(p_name) > 20")
def validation_issues(t):
    rules = (("part.size", F.col("p_size") > 45), ("part.retailprice", F.col("p_retailprice") < 950), ("part.name", F.length("p_name") > 20))
    issues = F.array_compact(F.array(*[F.when(bad, F.lit(path)) for path, bad in rules]))
    return t.part.select("p_partkey", issues.alias("issues")).filter(F.size("issues") > 0)


@query("o_f24_role_flags", "SELECT conv_id, turn, role = 'user' AS is_owner, role IN ('system', 'assistant') AS is_staff FROM conversations")
def role_flags(t):
    return t.conversations.select("conv_id", "turn", (F.col("role") == "user").alias("is_owner"), F.col("role").isin("system", "assistant").alias("is_staff"))


@query("o_f25_taken_probe", "SELECT c_custkey, c_custkey = 17 AS key_taken, c_name = (SELECT c_name FROM customer WHERE c_custkey = 5) AS name_taken FROM customer WHERE c_custkey = 17 OR c_name = (SELECT c_name FROM customer WHERE c_custkey = 5)")
def taken_probe(t):
    name = t.customer.filter("c_custkey = 5").agg(F.max("c_name").alias("wanted"))
    c = t.customer.join(F.broadcast(name), how="cross")
    return c.filter("c_custkey = 17 OR c_name = wanted").select("c_custkey", (F.col("c_custkey") == 17).alias("key_taken"), (F.col("c_name") == F.col("wanted")).alias("name_taken"))


@query("o_f26_topic_board", "SELECT conv_id, turn, row_number() OVER (ORDER BY length(text) + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END DESC, conv_id, turn) AS place FROM conversations WHERE role = 'user' AND contains(lower(text), 'th')")
def topic_board(t):
    c = t.conversations.filter((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("th")))
    votes = F.length("text") + (F.col("conv_id") % 7 == 0).cast("int")
    return global_rank(c, -votes, [F.asc("conv_id"), F.asc("turn")], "place").select("conv_id", "turn", "place")


# ---- joins


@query("o_j1_four_way", "SELECT n_name, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def four_way(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("o_j2_one_row_cross", "SELECT p_partkey, round(p_retailprice / q.top, 6) AS share FROM part CROSS JOIN (SELECT max(p_retailprice) AS top FROM part) q")
def one_row_cross(t):
    q = t.part.agg(F.max("p_retailprice").alias("top"))
    return t.part.join(F.broadcast(q), how="cross").select("p_partkey", F.round(F.col("p_retailprice") / F.col("top"), 6).alias("share"))


@query("o_j3_left_keep_all", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_keep_all(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("o_j4_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("o_j5_fan_out", "SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def fan_out(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    return t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)


@query("o_j6_orphans", "SELECT count(*) AS orphans FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def orphans(t):
    return t.labels.join(t.documents.filter("lang = 'en'"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("o_j7_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2")
def lookup(t):
    n = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("o_j8_required_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def required_lookup(t):
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.withColumn("e", F.assert_true(F.col("n_name").isNotNull(), F.lit("a supplier's nation is missing"))).filter("e IS NULL").select("s_suppkey", "n_name")


@query("o_j9_composite_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS returned FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_returnflag = 'R'")
def composite_key(t):
    b = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("returned"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(b, ["l_orderkey", "l_linenumber"])


@query("o_j10_semi", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS valid FROM nation")
def semi(t):
    known = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    yes = t.nation.join(known, "n_nationkey", "left_semi").select("n_nationkey", F.lit(True).alias("valid"))
    return yes.unionByName(t.nation.join(known, "n_nationkey", "left_anti").select("n_nationkey", F.lit(False).alias("valid")))


@query("o_j11_containment", "WITH s AS (SELECT DISTINCT source FROM documents) SELECT a, b, place FROM (SELECT a.source AS a, b.source AS b, row_number() OVER (PARTITION BY a.source ORDER BY length(b.source) DESC, b.source) AS place FROM s a JOIN s b ON a.source <> b.source AND (contains(lower(b.source), lower(a.source)) OR contains(lower(a.source), lower(b.source)))) WHERE place <= 3")
def containment(t):
    pairs = containments(t.documents, "source")
    both = pairs.select(F.col("whole").alias("a"), F.col("part").alias("b")).unionByName(pairs.select(F.col("part").alias("a"), F.col("whole").alias("b"))).distinct()
    w = Window.partitionBy("a").orderBy(F.desc(F.length("b")), "b")
    return both.select("a", "b", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


@query("o_j12_overlap", "SELECT day, count(*) AS open FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER), INTERVAL 1 DAY))::DATE AS day FROM orders) GROUP BY day")
def overlap(t):
    o = t.orders.select(F.to_date("o_orderdate").alias("a"), F.expr("date_add(to_date(o_orderdate), CAST(o_orderkey % 9 AS INT))").alias("b"))
    return o.select(F.explode(F.sequence("a", "b")).alias("day")).groupBy("day").agg(F.count("*").alias("open"))


@query("o_j13_membership", "WITH g AS (SELECT o_custkey, list(o_orderkey) AS members FROM orders GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, g.o_custkey FROM (SELECT o_custkey, unnest(members) AS k FROM g) g JOIN lineitem l ON l.l_orderkey = g.k")
def membership(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("members")).select("o_custkey", F.explode("members").alias("l_orderkey"))
    return g.join(t.lineitem, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("o_j14_ordered_refs", "SELECT conv_id, string_agg(concat(role, ':', length(text)), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def ordered_refs(t):
    refs = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("refs")).select("conv_id", F.posexplode("refs").alias("pos", "turn"))
    j = refs.join(t.conversations, ["conv_id", "turn"]).select("conv_id", "pos", F.concat("role", F.lit(":"), F.length("text")).alias("line"))
    return j.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x")).select("conv_id", F.array_join("x.line", "\n").alias("body"))


@query("o_j15_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS returned, coalesce(b.n, 0) AS accepted FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k")
def full_outer(t):
    f = lambda flag, name: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias(name))
    return f("R", "returned").join(f("A", "accepted"), "k", "full_outer").fillna(0)


@query("o_j16_self_parent", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def self_parent(t):
    p = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return t.conversations.select("conv_id", "turn").join(p, ["conv_id", "turn"], "left")


@query("o_j17_pairs_in_group", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pairs_in_group(t):
    a = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("a"))
    return a.join(t.supplier.select("s_nationkey", F.col("s_suppkey").alias("b")), "s_nationkey").filter("a < b").select("a", "b")


@query("o_j18_alternates", "SELECT a.p_partkey, count(*) AS others FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey")
def alternates(t):
    w = Window.partitionBy(F.lower("p_name"))
    return t.part.select("p_partkey", (F.count("*").over(w) - 1).alias("others")).filter("others > 0")


@query("o_j19_donor", "SELECT a.doc_id, d.donor, d.conflict FROM documents a LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS donor, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1) d ON d.h = md5(a.text) AND d.donor <> a.doc_id")
def donor(t):
    d = t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("donor"), (F.countDistinct("lang") > 1).alias("conflict"))
    a = t.documents.select("doc_id", F.md5("text").alias("h")).join(d, "h")
    other = F.col("donor") != F.col("doc_id")
    return a.select("doc_id", F.when(other, F.col("donor")).alias("donor"), F.when(other, F.col("conflict")).alias("conflict"))


@query("o_j20_dangling", "SELECT conv_id, ref FROM (SELECT conv_id, unnest([turn - 1, turn + 1]) AS ref FROM conversations) r WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = r.conv_id AND c.turn = r.ref)")
def dangling(t):
    refs = t.conversations.select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("ref"))
    return refs.join(t.conversations.select("conv_id", F.col("turn").alias("ref")), ["conv_id", "ref"], "left_anti")


@query("o_j21_null_safe_mismatch", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.quality = 1 THEN d.n_chars END IS DISTINCT FROM d.n_chars")
def null_safe(t):
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.filter(~F.when(F.col("quality") == 1, F.col("n_chars")).eqNullSafe(F.col("n_chars"))).select("doc_id")


@query("o_j22_contains_residual", "SELECT a.conv_id, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND position(split_part(a.text, ' ', 1) IN b.text) > 0 GROUP BY a.conv_id")
def contains_residual(t):
    a = t.conversations.select("conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("x"))
    b = t.conversations.select("conv_id", F.col("turn").alias("turn_b"), F.col("text").alias("text_b"))
    return a.join(b, "conv_id").filter((F.col("turn") != F.col("turn_b")) & F.contains("text_b", "x")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("o_j23_bridge", "SELECT o_custkey, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY o_custkey")
def bridge(t):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("o_j24_favourites", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type = 'purchase'")
def favourites(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return t.events.filter("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("o_j25_candidates", "SELECT o_orderkey, count(*) AS near FROM (SELECT o_orderkey, unnest([o_custkey - 1, o_custkey, o_custkey + 1]) AS c FROM orders) JOIN customer ON c_custkey = c GROUP BY o_orderkey")
def candidates(t):
    k = t.orders.select("o_orderkey", F.explode(F.array(*[F.col("o_custkey") + i for i in (-1, 0, 1)])).alias("c_custkey"))
    return k.join(t.customer, "c_custkey").groupBy("o_orderkey").agg(F.count("*").alias("near"))


@query("o_j26_nested", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS lines FROM customer")
def nested(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = t.orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    j = t.customer.select("c_custkey").join(orders, "c_custkey", "left")
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    total = F.aggregate(F.coalesce("orders", F.array()), F.lit(0), lambda s, o: s + F.greatest(F.lit(0), F.coalesce(F.size(o["lines"]), F.lit(0))))
    return j.select("c_custkey", F.greatest(F.lit(0), size("orders")).cast("long").alias("orders"), total.cast("long").alias("lines"))


@query("o_j27_array_semi", "SELECT o_custkey FROM (SELECT o_custkey, list(o_orderkey % 100) AS ids FROM orders GROUP BY 1) WHERE list_has_any(ids, [3, 14, 15])")
def array_semi(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 100).alias("ids"))
    return g.filter(F.arrays_overlap("ids", F.array(*[F.lit(x).cast("long") for x in (3, 14, 15)]))).select("o_custkey")


@query("o_j28_series", "SELECT a.o_orderkey, count(b.o_orderkey) AS others, min(b.o_orderdate) AS first_other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY a.o_orderkey")
def series(t):
    """Counted over the customer's orders: the first other one is the first, or for the first itself the second."""
    per = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    every = per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = t.orders.select("o_orderkey", (F.count("*").over(every) - 1).alias("others"), F.when(F.row_number().over(per) == 1, F.nth_value("o_orderdate", 2).over(every)).otherwise(F.first("o_orderdate").over(every)).alias("first_other"))
    return o.filter("others > 0")


@query("o_j29_reverse_lookup", "SELECT p_brand, string_agg(DISTINCT s_name, ';' ORDER BY s_name) AS suppliers FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 7 GROUP BY p_brand")
def reverse_lookup(t):
    j = t.part.filter("p_size = 7").join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ";").alias("suppliers"))


@query("o_x2_collapse", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS line FROM documents")
def collapse_text(t):
    return t.documents.select("doc_id", collapse(F.col("text")).alias("line"))
