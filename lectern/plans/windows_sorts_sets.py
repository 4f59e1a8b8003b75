"""Windows, orders, top-k, set operations and merge plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.structures import week_start
from ..operators.merge import diff, increment, keep_first, merge_columns, replace_children, soft_delete, upsert
from ..operators import ranking
from ..operators.ranking import best_of_group, floor_of_best, nearest, type_priority
from ..operators.sequences import diverse_sample, forward_fill, islands, lanes, ordered_digest, segments, tree_paths
from ..registry import query


@query("o_n1_round_robin", "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS place FROM documents) ORDER BY place, doc_id LIMIT 40")
def round_robin(t):
    w = Window.partitionBy("lang").orderBy(F.length("text"), "doc_id")
    return t.documents.select("doc_id", "lang", F.row_number().over(w).cast("long").alias("place")).orderBy("place", "doc_id").limit(40)


@query("o_n2_group_count", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def window_count(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))


@query("o_n3_strata_representative", "SELECT kind, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'LARGE' THEN -p_size ELSE p_size END, p_partkey) AS r FROM (SELECT p_partkey, p_size, CASE WHEN p_size > 40 THEN 'LARGE' WHEN p_size > 20 THEN 'MIDDLE' ELSE 'SMALL' END AS kind FROM part)) WHERE r = 1")
def strata(t):
    p = t.part.select("p_partkey", "p_size", F.when(F.col("p_size") > 40, "LARGE").when(F.col("p_size") > 20, "MIDDLE").otherwise("SMALL").alias("kind"))
    return keep_first(p, ["kind"], [F.when(F.col("kind") == "LARGE", -F.col("p_size")).otherwise(F.col("p_size")), F.col("p_partkey")]).select("kind", "p_partkey")


@query("o_n4_top1", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def top1(t):
    return keep_first(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderpriority"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("o_n5_top2_sum", "SELECT o_custkey, round(sum(CASE r WHEN 1 THEN o_totalprice WHEN 2 THEN 0.1 * o_totalprice END), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2 GROUP BY 1")
def top2_sum(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = t.orders.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return x.groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("r") == 1, F.col("o_totalprice")).otherwise(0.1 * F.col("o_totalprice"))), 4).alias("score"))


@query("o_n6_global_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def global_rank(t):
    return ranking.global_rank(t.customer, -F.col("c_acctbal"), [F.asc("c_custkey")], "place").select("c_custkey", "place")


@query("o_n7_floor", "SELECT o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS top FROM orders) WHERE o_totalprice >= 0.85 * top")
def floor(t):
    return floor_of_best(t.orders, ["o_orderpriority"], "o_totalprice", 0.85).select("o_orderkey")


@query("o_n8_collapse", "SELECT p_brand, p_partkey, n AS group_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r = 1")
def collapse(t):
    return best_of_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "group_size")


@query("o_n9_series_size", "SELECT doc_id, count(*) OVER (PARTITION BY source, lang) AS n FROM documents")
def series_size(t):
    return t.documents.select("doc_id", F.count("*").over(Window.partitionBy("source", "lang")).alias("n"))


@query("o_n10_completeness", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN contains(text, '@') THEN 1 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 2 ELSE 0 END DESC, doc_id) AS r FROM documents) WHERE r = 1")
def completeness(t):
    score = F.contains("text", F.lit("@")).cast("int") + 2 * (F.col("n_chars") > 1000).cast("int")
    return keep_first(t.documents, ["source"], [F.desc(score), F.asc("doc_id")]).select("source", "doc_id")


@query("o_n11_variants", "SELECT conv_id, max(CASE WHEN r = 1 THEN turn END) AS first, list(turn ORDER BY r) FILTER (WHERE r > 1) AS variants FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) GROUP BY conv_id HAVING count(*) > 1")
def variants(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    x = t.conversations.withColumn("r", F.row_number().over(w)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "turn"))).alias("x")).filter(F.size("x") > 1)
    return x.select("conv_id", F.col("x")[0]["turn"].alias("first"), F.slice("x.turn", F.lit(2), F.size("x") - 1).alias("variants"))


@query("o_n12_near_ties", "SELECT s_nationkey, CASE WHEN count_if(abs(s_acctbal - top) < 500) > 1 THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS status FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM supplier) GROUP BY 1")
def near_ties(t):
    x = t.supplier.withColumn("top", F.max("s_acctbal").over(Window.partitionBy("s_nationkey")))
    return x.groupBy("s_nationkey").agg(F.when(F.count_if(F.abs(F.col("s_acctbal") - F.col("top")) < 500) > 1, "AMBIGUOUS").otherwise("CLEAR").alias("status"))


@query("o_n13_gaps", "SELECT event_id, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS gap FROM events)")
def gaps(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = F.when(micros(F.col("ts")) - micros(F.lag("ts").over(w)) <= 2 * 86_400_000_000, 0).otherwise(1)
    return t.events.withColumn("gap", gap).select("event_id", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("block"))


@query("o_n14_break_segments", "SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, coalesce(lag(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS b FROM conversations)")
def break_segments(t):
    return segments(t.conversations, ["conv_id"], [F.col("turn")], F.col("role") == "assistant").select("conv_id", "turn", "segment")


@query("o_n15_forward_fill", "SELECT conv_id, turn, last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM (SELECT *, CASE WHEN role = 'user' THEN text END AS v FROM conversations)")
def filled(t):
    c = t.conversations.withColumn("asked", F.when(F.col("role") == "user", F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.last("asked", ignorenulls=True).over(w).alias("asked"))


@query("o_n15_fill_blanks", "SELECT event_id, coalesce(last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '-') AS v FROM (SELECT *, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS v FROM events)")
def fill_blanks(t):
    e = t.events.withColumn("v", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return forward_fill(e, ["user_id"], [F.col("ts"), F.col("event_id")], "v").select("event_id", F.coalesce("v", F.lit("-")).alias("v"))


_SPANS = "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(60 + o_orderkey % 90 AS INTEGER) AS b FROM orders"


@query("o_n16_reach", f"WITH s AS ({_SPANS}) SELECT o_orderkey, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)")
def reach(t):
    s = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"), F.expr("date_add(to_date(o_orderdate), CAST(60 + o_orderkey % 90 AS INT))").alias("b"))
    return islands(s, ["o_custkey"], "a", "b", [F.col("a"), F.col("o_orderkey")]).select("o_orderkey", "island")


@query("o_n17_moves", "SELECT user_id, count_if(value > p) AS up, count_if(value < p) AS down FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def moves(t):
    e = t.events.withColumn("p", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("value") > F.col("p")).alias("up"), F.count_if(F.col("value") < F.col("p")).alias("down"))


@query("o_n18_margin", "SELECT l_orderkey, round(max(CASE WHEN r = 1 THEN l_extendedprice END) - max(CASE WHEN r = 2 THEN l_extendedprice END), 4) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) GROUP BY 1")
def margin(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    x = t.lineitem.select("l_orderkey", F.row_number().over(w).alias("r"), "l_extendedprice", F.lead("l_extendedprice").over(w).alias("second"))
    return x.filter("r = 1").select("l_orderkey", F.round(F.col("l_extendedprice") - F.col("second"), 4).alias("margin"))


@query("o_n19_next_start", "SELECT conv_id, turn, lead(turn, 1, 1000) OVER (PARTITION BY conv_id ORDER BY turn) AS next_start FROM conversations WHERE role = 'user'")
def next_start(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lead("turn", 1, 1000).over(w).alias("next_start"))


# ---- orders and top-k

_SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _first_vector(t):
    """The query's vector as a frame of one row, or of none where the table lacks it."""
    return t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("vector")).limit(1)


@query("o_o1_exact_top_k", f"SELECT vec_id, round({_SIM}, 6) AS similarity FROM embeddings e ORDER BY {_SIM} DESC, vec_id LIMIT 20")
def exact_top_k(t):
    return nearest(t.embeddings, "embedding", _first_vector(t), "vec_id", 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


_FETCH = f"SELECT vec_id, label, {_SIM} AS s FROM embeddings e WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 25"


@query("o_o2_over_fetch", f"SELECT label, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM ({_FETCH})) WHERE r = 1 ORDER BY s DESC, vec_id LIMIT 5")
def over_fetch(t, k: int = 5):
    near = nearest(t.embeddings.filter("vec_id <> 0"), "embedding", _first_vector(t), "vec_id", max(5 * k, 20))
    best = keep_first(near, ["label"], [F.desc("similarity"), F.asc("vec_id")])
    return best.orderBy(F.desc("similarity"), "vec_id").limit(k).select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("o_o3_type_priority", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 9 END, event_id) AS place FROM events")
def priority_order(t):
    kind = F.when(F.col("event_type") == "purchase", "CORE").when(F.col("event_type") == "signup", "SESSIONS").when(F.col("event_type") == "click", "ATTACHMENT").otherwise("-")
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(type_priority(kind), "event_id")).cast("long").alias("place"))


@query("o_o4_pinned_first", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 100")
def pinned_first(t):
    x = t.orders.orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)
    w = Window.orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_orderdate"), F.desc("o_orderkey"))
    return x.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("o_o5_open_first", "SELECT p_partkey FROM part ORDER BY p_size < 10 DESC, CASE WHEN p_size > 3 THEN p_retailprice END DESC NULLS LAST, p_partkey DESC LIMIT 60")
def open_first(t):
    price = F.when(F.col("p_size") > 3, F.col("p_retailprice"))
    return t.part.orderBy(F.desc(F.col("p_size") < 10), price.desc_nulls_last(), F.desc("p_partkey")).limit(60).select("p_partkey")


@query("o_o6_page", "SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page(t, number: int = 3, size: int = 20):
    return t.customer.orderBy("c_name", "c_custkey").offset((number - 1) * size).limit(size).select("c_custkey")


@query("o_o6_page_clamp", "WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM customer) SELECT c_custkey, pages AS page, list_filter([pages - 2, pages - 1, pages], lambda p: p >= 1) AS shown FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS r FROM customer), n WHERE r > (pages - 1) * 20 AND r <= pages * 20")
def page_clamp(t, number: int = 10**6, size: int = 20):
    """A page past the end is the last one; beside it the numbers of the pages around it."""
    pages = max(1, -(-t.customer.count() // size))
    page = min(max(number, 1), pages)
    shown = [p for p in range(page - 2, page + 3) if 1 <= p <= pages]
    rows = t.customer.orderBy("c_name", "c_custkey").offset((page - 1) * size).limit(size)
    return rows.select("c_custkey", F.lit(page).cast("long").alias("page"), F.array(*map(F.lit, shown)).cast("array<bigint>").alias("shown"))


@query("o_o7_popularity", "SELECT user_id, count_if(event_type = 'click') + count_if(event_type = 'purchase') AS score FROM events GROUP BY 1 ORDER BY user_id % 40 = 0 DESC, score DESC, user_id LIMIT 30")
def popularity(t):
    n = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") + F.count_if(F.col("event_type") == "purchase")).alias("score"))
    return n.orderBy(F.desc(F.col("user_id") % 40 == 0), F.desc("score"), "user_id").limit(30)


@query("o_o8_vote_orders", "SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS popular, row_number() OVER (ORDER BY latest DESC, user_id) AS latest FROM (SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1)")
def vote_orders(t):
    x = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    popular = ranking.global_rank(x, -F.col("n"), [F.asc("user_id")], "popular")
    latest = ranking.global_rank(popular, -F.unix_micros(F.col("t").cast("timestamp")), [F.asc("user_id")], "latest")
    return latest.select("user_id", "popular", "latest")


@query("o_o9_top_values", "SELECT p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_type LIMIT 12")
def top_values(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(12)


@query("o_o10_diverse_sample")
def diverse(t, size: int = 6):
    tag = F.explode(F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("hour:"), F.hour("ts").cast("string")), F.when(F.col("value") > 90, F.lit("value:HIGH")).otherwise(F.lit("value:LOW"))))
    kinds = t.events.select("user_id", tag.alias("tag")).groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("labels"))  # a few dozen kinds of tag
    chosen = diverse_sample(kinds, "labels", "user_id", size)
    return t.spark.createDataFrame([(i + 1, int(k)) for i, k in enumerate(chosen)], "place int, user_id long")


@query("o_o11_stratified_fill", "WITH s AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2) SELECT doc_id FROM (SELECT doc_id, 0 AS k FROM (SELECT min(doc_id) AS doc_id FROM s GROUP BY lang) UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM s GROUP BY lang)) ORDER BY k, doc_id LIMIT 25")
def stratified_fill(t, size: int = 25):
    first = t.documents.groupBy("lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rest = t.documents.select("doc_id").join(first, "doc_id", "left_anti")
    return first.withColumn("k", F.lit(0)).unionByName(rest.withColumn("k", F.lit(1))).orderBy("k", "doc_id").limit(size).select("doc_id")


@query("o_o12_tree_order", "SELECT conv_id, turn, string_agg(lpad(CAST(p AS VARCHAR), 4, '0'), '/' ORDER BY p) AS path FROM (SELECT c.conv_id, c.turn, p.turn AS p FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn <= c.turn) GROUP BY 1, 2")
def tree_order(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(F.collect_list("turn").over(w), lambda p: F.lpad(p.cast("string"), 4, "0")), "/").alias("path"))


@query("o_o12_comment_tree", "WITH RECURSIVE t AS (SELECT event_id, 0 AS depth, lpad(CAST(event_id AS VARCHAR), 9, '0') AS path FROM events WHERE event_id % 7 = 0 UNION ALL SELECT e.event_id, depth + 1, path || '/' || lpad(CAST(e.event_id AS VARCHAR), 9, '0') FROM events e JOIN t ON e.event_id // 4 = t.event_id WHERE e.event_id % 7 <> 0) SELECT event_id, depth, path FROM t")
def comment_tree(t):
    answers = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 4)).alias("parent"))
    return tree_paths(answers, "event_id", "parent")


@query("o_o13_calendar_lanes")
def calendar_lanes(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"), F.expr("date_add(to_date(o_orderdate), CAST(o_orderkey % 5 AS INT))").alias("b"))
    return lanes(o.withColumn("week", week_start(F.col("a"))), ["o_custkey", "week"], "a", "b", "o_orderkey")  # a customer's calendar


@query("o_o14_criteria_samples", "SELECT p_partkey FROM (SELECT p_partkey, min(k) AS k FROM (SELECT 1 AS k, arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey FROM part UNION ALL SELECT 2, arg_max(p_partkey, (p_retailprice, -p_partkey)) FROM part WHERE p_size < 20 UNION ALL SELECT 3, arg_min(p_partkey, (p_size, p_partkey)) FROM part UNION ALL SELECT 4, arg_min(p_partkey, (p_retailprice, p_partkey)) FROM part) GROUP BY p_partkey) ORDER BY k LIMIT 5")
def criteria_samples(t):
    key = F.col("p_partkey")
    most = lambda c, k: F.max_by(key, F.struct(F.col(c), -key)).alias(f"k{k}")
    least = lambda c, k: F.min_by(key, F.struct(F.col(c), key)).alias(f"k{k}")
    small = F.struct(F.when(F.col("p_size") < 20, F.col("p_retailprice")), -key)
    one = t.part.agg(most("p_size", 1), F.max_by(key, F.when(F.col("p_size") < 20, small)).alias("k2"), least("p_size", 3), least("p_retailprice", 4))
    x = one.select(F.posexplode(F.array("k1", "k2", "k3", "k4")).alias("k", "p_partkey")).groupBy("p_partkey").agg(F.min("k").alias("k"))
    return x.orderBy("k").limit(5).select("p_partkey")


# ---- sets: two overlapping slices of orders stand for two snapshots

_OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0"


def _old(t):
    return t.orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _new(t):
    return t.orders.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")


_DIFF = f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN 'unchanged' ELSE 'updated' END AS status FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey"


@query("o_u1_snapshot_diff", _DIFF)
def snapshot_diff(t):
    return diff(_old(t), _new(t), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("o_u2_blank_insensitive_change", r"SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE regexp_replace(d.text, '[\s\x0B]+', '', 'g') <> regexp_replace(CASE WHEN l.toxic = 1 THEN upper(d.text) ELSE replace(d.text, ' ', '  ') END, '[\s\x0B]+', '', 'g')")
def blank_insensitive_change(t):
    j = t.documents.join(t.labels, "doc_id")
    after = F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return j.filter(bare(F.col("text")) != bare(after)).select("doc_id")


@query("o_u3_union_distinct", f"SELECT o_orderkey FROM ({_OLD}) UNION SELECT o_orderkey FROM ({_NEW})")
def union_distinct(t):
    return _old(t).select("o_orderkey").union(_new(t).select("o_orderkey")).distinct()


@query("o_u4_pool", "SELECT q, k, list_sort(list(method)) AS methods, min(place) AS best FROM (SELECT 'short' AS method, source AS q, lang AS k, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS place FROM documents UNION ALL SELECT 'long', source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) FROM documents) WHERE place <= 3 GROUP BY q, k")
def pool(t):
    def method(name, order):
        w = Window.partitionBy("source", "lang").orderBy(order, "doc_id")
        return t.documents.select(F.lit(name).alias("method"), F.col("source").alias("q"), F.col("lang").alias("k"), F.row_number().over(w).alias("place"))

    both = method("short", F.asc("n_chars")).unionByName(method("long", F.desc("n_chars"))).filter("place <= 3")
    return both.groupBy("q", "k").agg(F.array_sort(F.collect_list("method")).alias("methods"), F.min("place").cast("long").alias("best"))


@query("o_u5_both_differences", f"SELECT 'removed' AS side, o_orderkey FROM (SELECT o_orderkey FROM ({_OLD}) EXCEPT SELECT o_orderkey FROM ({_NEW})) UNION ALL SELECT 'added', o_orderkey FROM (SELECT o_orderkey FROM ({_NEW}) EXCEPT SELECT o_orderkey FROM ({_OLD}))")
def both_differences(t):
    a, b = _old(t).select("o_orderkey"), _new(t).select("o_orderkey")
    return a.exceptAll(b).distinct().select(F.lit("removed").alias("side"), "o_orderkey").unionByName(b.exceptAll(a).distinct().select(F.lit("added").alias("side"), "o_orderkey"))


@query("o_u6_keep_first_last", "SELECT md5(text) AS h, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def keep_first_last(t):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    first = keep_first(d, ["h"], [F.asc("doc_id")]).withColumnRenamed("doc_id", "first")
    return first.join(keep_first(d, ["h"], [F.desc("doc_id")]).withColumnRenamed("doc_id", "last"), "h").select("h", "first", "last")


@query("o_u7_uniqueness", "SELECT count(*) = count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT md5(text)) AS texts FROM documents")
def uniqueness(t):
    return t.documents.agg((F.count("*") == F.countDistinct("doc_id")).alias("ids"), (F.count("*") == F.countDistinct(F.md5("text"))).alias("texts"))


@query("o_u8_missing", "SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
def missing(t):
    seen = t.nation.join(t.supplier.filter("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return t.nation.select("n_name").subtract(seen)


@query("o_u9_array_sets", "SELECT o_custkey, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_intersect(a, b)) AS both FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS a, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def array_sets(t):
    f = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    x = t.orders.groupBy("o_custkey").agg(f("F").alias("a"), f("O").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return x.select("o_custkey", F.array_sort(F.array_union("a", "b")).alias("either"), F.array_sort(F.array_intersect("a", "b")).alias("both"))


# ---- merge plans


@query("o_w1_upsert", f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}))")
def upserted(t):
    return upsert(_old(t), _new(t), ["o_orderkey"])


@query("o_w2_replace_children", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber = 1")
def replaced(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    new = l.filter("l_orderkey % 6 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return replace_children(l, new, "l_orderkey")


@query("o_w3_soft_delete", f"SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM ({_NEW})) AS is_active FROM ({_OLD})")
def soft_deleted(t):
    return soft_delete(_old(t), _new(t), ["o_orderkey"]).select("o_orderkey", "is_active")


@query("o_w4_merge_columns", f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, a.o_totalprice FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey")
def merged(t):
    return merge_columns(_old(t), _new(t), ["o_orderkey"], ["o_orderstatus"])


@query("o_w5_publish_counts", f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def publish_counts(t):
    return diff(_old(t), _new(t), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).groupBy("status").agg(F.count("*").alias("n"))


@query("o_w5_publish_plan", f"SELECT o_orderkey, CASE WHEN status = 'deleted' THEN 'delete' ELSE 'upsert' END AS action FROM ({_DIFF})")
def publish_plan(t):
    """A full refresh: every incoming row is written, every held one that did not come goes."""
    new = _new(t).select("o_orderkey", F.lit("upsert").alias("action"))
    gone = _old(t).select("o_orderkey").join(new, "o_orderkey", "left_anti")
    return new.unionByName(gone.withColumn("action", F.lit("delete")))


@query("o_w6_diff_sync", _DIFF.replace("status FROM", "status FROM").replace("AS status", "AS action"))
def diff_sync(t):
    return diff(_old(t), _new(t), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).withColumnRenamed("status", "action")


@query("o_w7_hash_gate", f"SELECT b.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'CREATED' WHEN md5(a.o_orderstatus) = md5(b.o_orderstatus) THEN 'UNCHANGED' ELSE 'UPDATED' END AS action FROM ({_NEW}) b LEFT JOIN ({_OLD}) a ON a.o_orderkey = b.o_orderkey")
def hash_gate(t):
    a = _old(t).select("o_orderkey", F.md5("o_orderstatus").alias("h"))
    j = _new(t).join(a, "o_orderkey", "left")
    return j.select("o_orderkey", F.when(F.col("h").isNull(), "CREATED").when(F.col("h") == F.md5("o_orderstatus"), "UNCHANGED").otherwise("UPDATED").alias("action"))


@query("o_w8_toggle", "SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle(t):
    return t.events.groupBy("user_id", "event_type").count().filter("count % 2 = 1").select("user_id", "event_type")


@query("o_w8_toggle_state", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 1) SELECT user_id, event_type, CASE WHEN s.user_id IS NULL THEN 'insert' WHEN c.user_id IS NULL THEN 'keep' ELSE 'delete' END AS action FROM s FULL JOIN c USING (user_id, event_type)")
def toggle_state(t):
    """Toggles against what is held: an absent pair is inserted, a present one deleted, others stay."""
    held = t.events.filter("event_id % 3 = 0").select("user_id", "event_type").distinct().withColumn("held", F.lit(True))
    asked = t.events.filter("event_id % 3 = 1").select("user_id", "event_type").distinct().withColumn("asked", F.lit(True))
    action = F.when(F.col("held").isNull(), "insert").when(F.col("asked").isNull(), "keep").otherwise("delete")
    return held.join(asked, ["user_id", "event_type"], "full_outer").select("user_id", "event_type", action.alias("action"))


@query("o_w9_gated_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE r = 1")
def gated_upsert(t):
    open_ = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return keep_first(t.events.join(open_, "user_id", "left_semi"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("o_w10_increment", "SELECT coalesce(s.user_id, e.user_id) AS user_id, coalesce(s.attempts, 0) + coalesce(e.n, 0) AS attempts FROM (SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'view' GROUP BY 1) s FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e ON s.user_id = e.user_id")
def incremented(t):
    state = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return increment(state, t.events.filter("event_type = 'error'"), "user_id", "attempts")


@query("o_w11_claim", "SELECT event_id, o_orderkey, r = 1 AND o_orderstatus IN ('O', 'P') AS won, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'PROCESSING' ELSE o_orderstatus END AS status FROM (SELECT event_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts, event_id) AS r FROM events JOIN orders ON o_orderkey = user_id)")
def claim(t):
    """Claims of rows by compare-and-set: of an allowed status, the first claim of a row wins and no other does."""
    c = t.events.select("event_id", "ts", F.col("user_id").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    first = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("ts", "event_id")) == 1
    ok = F.col("o_orderstatus").isin("O", "P")
    return c.select("event_id", "o_orderkey", (first & ok).alias("won"), F.when(ok, "PROCESSING").otherwise(F.col("o_orderstatus")).alias("status"))


@query("o_w12_stale_recovery", "SELECT event_id, CASE WHEN event_type = 'error' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 30 DAY THEN 'PENDING' ELSE event_type END AS status FROM events")
def stale_recovery(t):
    now = t.events.agg(F.max("ts").alias("now"))
    e = t.events.join(F.broadcast(now), how="cross")
    stale = (F.col("event_type") == "error") & (F.col("ts") <= F.col("now") - F.expr("INTERVAL 30 DAYS"))
    return e.select("event_id", F.when(stale, "PENDING").otherwise(F.col("event_type")).alias("status"))


@query("o_w14_partial_update", "SELECT c.c_custkey, coalesce(p.c_name, c.c_name) AS c_name, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0) p USING (c_custkey)")
def partial_update(t):
    k = F.col("c_custkey")
    patch = t.customer.filter(k % 5 == 0).select(k, F.when(k % 2 == 0, F.upper("c_name")).alias("c_name"), F.when(k % 3 == 0, "NEW").alias("c_mktsegment"))
    return merge_columns(t.customer.select("c_custkey", "c_name", "c_mktsegment"), patch, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("o_w15_latest_label", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_label(t):
    return keep_first(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("o_w16_report", "SELECT string_agg(concat('- ', lang, ': ', n), chr(10) ORDER BY lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def report(t):
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return n.agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "lang", F.lit(": "), "n"))).alias("x")).select(F.array_join("x", "\n").alias("report"))


@query("o_w17_fingerprint", """WITH a AS (SELECT o_orderkey // 1024 AS g, sha256(string_agg(concat_ws('|', o_orderkey, o_custkey, o_orderstatus), chr(10) ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1),
b AS (SELECT g // 1024 AS h, sha256(string_agg(d, chr(10) ORDER BY g)) AS d FROM a GROUP BY 1), c AS (SELECT h // 1024 AS i, sha256(string_agg(d, chr(10) ORDER BY h)) AS d FROM b GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY i)) AS fingerprint FROM c""")
def fingerprint(t):
    return ordered_digest(t.orders, "o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"))
