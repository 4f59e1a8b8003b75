"""Aggregations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.structures import half_up
from ..functions.text import terms
from ..functions.vectors import is_finite, norm
from ..operators.ranking import global_rank, lexical_statistics, retrieval_metrics
from ..operators.sequences import ordered_digest
from ..registry import query


@query("o_a1_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_count(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("o_a2_votes", "SELECT c_custkey, count(e.event_id) AS votes, coalesce(bool_or(e.event_type = 'purchase'), false) AS bought, max(e.value) FILTER (WHERE e.event_type = 'click') AS top_click FROM customer LEFT JOIN events e ON e.user_id = c_custkey GROUP BY c_custkey")
def votes(t):
    j = t.customer.join(t.events, F.col("user_id") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("event_id").alias("votes"), F.coalesce(F.bool_or(F.col("event_type") == "purchase"), F.lit(False)).alias("bought"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("top_click"))


@query("o_a3_distinct_arrays", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F')), []) AS done FROM orders GROUP BY 1")
def distinct_arrays(t):
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))).alias("done"))


@query("o_a4_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_quantity > 25) AS big, count(DISTINCT l_suppkey) AS suppliers, (SELECT count(*) FROM supplier) AS known FROM lineitem")
def conditional_counts(t):
    one = t.lineitem.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.countDistinct("l_suppkey").alias("suppliers"))
    return one.join(t.supplier.agg(F.count("*").alias("known")), how="cross")


@query("o_a5_audit_row", "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS stray_labels, (SELECT count(*) FROM documents WHERE trim(text) = '') AS empty_texts, (SELECT count(*) FROM pages WHERE NOT contains(html, '<h1>')) AS untitled_pages, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_lines")
def audit_row(t):
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    d, n, o = t.documents, t.labels, t.orders
    parts = (
        count(d, "docs"), count(n, "labels"), count(t.pages, "pages"), count(d.join(n, "doc_id", "left_anti"), "unlabelled"), count(n.join(d, "doc_id", "left_anti"), "stray_labels"),
        count(d.filter(F.trim("text") == ""), "empty_texts"), count(t.pages.filter(~F.contains("html", F.lit("<h1>"))), "untitled_pages"),
        count(o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orphan_orders"), count(t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "orphan_lines"),
    )
    out = parts[0]
    for one in parts[1:]:  # one row each
        out = out.join(F.broadcast(one), how="cross")
    return out


@query("o_a6_duplicates", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(t):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1")


@query("o_a7_duplicate_keys", "SELECT 'name' AS key, count(*) AS groups FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'brand_size', count(*) FROM (SELECT p_brand, p_size FROM part GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'type', count(*) FROM (SELECT p_type FROM part GROUP BY 1 HAVING count(*) > 1)")
def duplicate_keys(t):
    out = None
    for name, keys in (("name", ["p_name"]), ("brand_size", ["p_brand", "p_size"]), ("type", ["p_type"])):
        one = t.part.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("groups")).select(F.lit(name).alias("key"), "groups")
        out = one if out is None else out.unionByName(one)
    return out


@query("o_a8_child_counts", "SELECT o_orderkey, coalesce(l.n, 0) AS lines, coalesce(l.r, 0) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def child_counts(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return t.orders.select("o_orderkey").join(c, "o_orderkey", "left").fillna(0)


@query("o_a9_metric_bundle", "SELECT event_type AS metric, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'high', count_if(value > 90) FROM events UNION ALL SELECT 'low', count_if(value < 10) FROM events UNION ALL SELECT 'days', count(DISTINCT CAST(ts AS DATE)) FROM events UNION ALL SELECT 'valued', count(value) FROM events UNION ALL SELECT 'all', count(*) FROM events")
def metric_bundle(t):
    v = F.col("value")
    whole = t.events.agg(F.countDistinct("user_id").alias("users"), F.count_if(v > 90).alias("high"), F.count_if(v < 10).alias("low"), F.countDistinct(F.to_date("ts")).alias("days"), F.count("value").alias("valued"), F.count("*").alias("all"))
    return t.events.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n")).unionByName(whole.unpivot([], whole.columns, "metric", "n"))


@query("o_a10_crosstab", "SELECT lang, count_if(lower(source) = 'src0') AS src0, count_if(lower(source) = 'src1') AS src1, count_if(lower(source) = 'src2') AS src2 FROM documents GROUP BY lang")
def crosstab(t):
    return t.documents.groupBy("lang").pivot("source", ["src0", "src1", "src2"]).agg(F.count(F.lit(1))).fillna(0)


@query("o_a11_length_stats", "SELECT lang, min(length(text)) AS least, round(avg(length(text)), 2) AS mean, median(length(text)) AS middle, max(length(text)) AS most FROM documents GROUP BY lang")
def length_stats(t):
    n = F.length("text")
    return t.documents.groupBy("lang").agg(F.min(n).cast("long").alias("least"), F.round(F.avg(n), 2).alias("mean"), F.median(n).alias("middle"), F.max(n).cast("long").alias("most"))


@query("o_a12_lower_percentiles", "SELECT o_orderstatus, list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM orders GROUP BY 1")
def lower_percentiles(t):
    # Ranks instead of a sorted list, so that a huge group needs no one row.
    w = Window.partitionBy("o_orderstatus")
    x = t.orders.select("o_orderstatus", "o_totalprice", F.row_number().over(w.orderBy("o_totalprice")).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * p) + 1, F.col("o_totalprice")))
    return x.groupBy("o_orderstatus").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("o_a13_upper_median", "SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS middle FROM orders GROUP BY 1")
def upper_median(t):
    w = Window.partitionBy("o_orderpriority")
    x = t.orders.select("o_orderpriority", "o_totalprice", F.row_number().over(w.orderBy("o_totalprice")).alias("r"), F.count("*").over(w).alias("n"))
    return x.groupBy("o_orderpriority").agg(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("o_totalprice"))).alias("middle"))


@query("o_a14_rounded_median", "SELECT l_returnflag, CAST(floor(median(l_quantity) + 0.5) AS BIGINT) AS middle FROM lineitem GROUP BY 1")
def rounded_median(t):
    return t.lineitem.groupBy("l_returnflag").agg(half_up(F.median("l_quantity")).alias("middle"))


@query("o_a15_coverage", "SELECT lang, count_if(contains(text, '@')) AS n, count(*) AS total, round(100.0 * count_if(contains(text, '@')) / count(*), 1) AS percent FROM documents GROUP BY 1")
def coverage(t):
    hit = F.count_if(F.contains("text", F.lit("@")))
    return t.documents.groupBy("lang").agg(hit.alias("n"), F.count("*").alias("total"), F.round(100.0 * hit / F.count("*"), 1).alias("percent"))


_LABELS = "list_filter([CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, 'License') THEN 'license' END], lambda x: x IS NOT NULL)"


@query("o_a16_multi_label", f"SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM (SELECT unnest({_LABELS}) AS label FROM documents) GROUP BY label")
def multi_label(t):
    labels = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(name)) for x, name in (("@", "contact"), ("|", "table"), ("License", "license"))]))
    total = t.documents.agg(F.count("*").alias("total"))
    n = t.documents.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), how="cross").select("label", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


@query("o_a17_histogram", "SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def histogram(t):
    n = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return global_rank(n, -F.col("n"), [F.asc("p_brand")], "place").withColumn("place", F.col("place").cast("long"))


@query("o_a18_fill_rate", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS total, count_if({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') AS filled, round(100.0 * count_if({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') / count(*), 1) AS percent FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def fill_rate(t):
    filled = t.documents.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in t.documents.columns])
    rows = filled.unpivot(["total"], t.documents.columns, "name", "filled")
    return rows.select("name", "total", "filled", F.round(100.0 * F.col("filled") / F.col("total"), 1).alias("percent"))


@query("o_a19_series_stats", "WITH g AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest, (SELECT list(p_type ORDER BY n DESC, p_type) FROM (SELECT * FROM g ORDER BY n DESC, p_type LIMIT 5)) AS top FROM g")
def series_stats(t):
    g = t.part.groupBy("p_type").agg(F.count("*").alias("n")).filter("n > 1")
    top = g.orderBy(F.desc("n"), "p_type").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "p_type"))).alias("x"))
    stats = g.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.max("n").alias("largest"))
    return stats.join(F.broadcast(top), how="cross").select("groups", "members", "largest", F.col("x.p_type").alias("top"))


@query("o_a20_dictionary_coverage", "SELECT coalesce(d.kind, 'unknown') AS kind, count(*) AS n FROM events e LEFT JOIN (VALUES ('view', 'mapped'), ('click', 'mapped'), ('signup', 'ignored')) d(event_type, kind) USING (event_type) GROUP BY 1")
def dictionary_coverage(t):
    d = t.spark.createDataFrame([("view", "mapped"), ("click", "mapped"), ("signup", "ignored")], "event_type string, kind string")
    return t.events.join(F.broadcast(d), "event_type", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


@query("o_a20_unresolved", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events WHERE event_type NOT IN ('view', 'click', 'signup') GROUP BY 1")
def unresolved(t):
    """Values that the dictionary lacks, the most frequent first."""
    d = t.spark.createDataFrame([("view",), ("click",), ("signup",)], "event_type string")
    n = t.events.join(F.broadcast(d), "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))
    return global_rank(n, -F.col("n"), [F.asc("event_type")], "place").withColumn("place", F.col("place").cast("long"))


@query("o_a21_sizes_of_sizes", "SELECT n AS size, count(*) AS groups FROM (SELECT md5(text), count(*) AS n FROM documents GROUP BY 1) GROUP BY n")
def sizes_of_sizes(t):
    return t.documents.groupBy(F.md5("text")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query("o_a22_savings", "SELECT count(*) AS files, count(DISTINCT md5(text)) AS contents, round(100.0 * (count(*) - count(DISTINCT md5(text))) / count(*), 2) AS saved FROM documents")
def savings(t):
    h = F.countDistinct(F.md5("text"))
    return t.documents.agg(F.count("*").alias("files"), h.alias("contents"), F.round(100.0 * (F.count("*") - h) / F.count("*"), 2).alias("saved"))


@query("o_a23_fixed_domain", "SELECT v.label, coalesce(n, 0) AS n, CAST(floor(100.0 * coalesce(n, 0) / (SELECT count(*) FROM events) + 0.5) AS BIGINT) AS percent FROM (VALUES ('view'), ('click'), ('refund')) v(label) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON e.event_type = v.label")
def fixed_domain(t):
    domain = t.spark.createDataFrame([("view",), ("click",), ("refund",)], "label string")
    n = t.events.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    total = t.events.agg(F.count("*").alias("total"))
    j = domain.join(n, "label", "left").fillna(0).join(F.broadcast(total), how="cross")
    return j.select("label", "n", half_up(100.0 * F.col("n") / F.col("total")).alias("percent"))


@query("o_a24_fan_in", "SELECT l_suppkey, len(list(DISTINCT l_partkey)) AS parts, list_sort(list(DISTINCT l_partkey))[1:5] AS first_parts FROM lineitem GROUP BY 1")
def fan_in(t):
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))
    first = pairs.withColumn("place", place).filter("place <= 5").groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("first_parts"))  # five at most
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("parts")).join(first, "l_suppkey").select("l_suppkey", "parts", "first_parts")


@query("o_a25_batch_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2")
def batch_summary(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("numbers"), F.countDistinct("l_orderkey").alias("orders"))


@query("o_a26_bucket_counts", "SELECT count(*) AS all_rows, count_if(value < 20) AS low, count_if(value >= 20 AND value < 80) AS middle, count_if(value >= 80) AS high FROM events")
def bucket_counts(t):
    v = F.col("value")
    return t.events.agg(F.count("*").alias("all_rows"), F.count_if(v < 20).alias("low"), F.count_if((v >= 20) & (v < 80)).alias("middle"), F.count_if(v >= 80).alias("high"))


@query("o_a27_options", "SELECT DISTINCT c_mktsegment AS option FROM customer")
def options(t):
    return t.customer.select(F.col("c_mktsegment").alias("option")).distinct().orderBy("option")


@query("o_a28_shared_members", "SELECT s_suppkey, members FROM supplier JOIN (SELECT s_nationkey, list_sort(list(DISTINCT s_suppkey)) AS members FROM supplier GROUP BY 1) USING (s_nationkey)")
def shared_members(t):
    m = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_set("s_suppkey")).alias("members"))
    return t.supplier.join(m, "s_nationkey").select("s_suppkey", "members")


@query("o_a29_nested_reasons", "SELECT role, count(*) AS n FROM conversations WHERE turn > 1 GROUP BY role")
def nested_reasons(t):
    nest = t.conversations.groupBy("conv_id", (F.col("turn") > 1).alias("late")).agg(F.collect_list("role").alias("roles")).groupBy("conv_id").agg(F.collect_list(F.struct("late", "roles")).alias("parts"))
    flat = F.flatten(F.transform(F.filter("parts", lambda p: p["late"]), lambda p: p["roles"]))
    return nest.select(F.explode(flat).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("o_a31_lexical_stats", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def lexical_stats(t):
    return lexical_statistics(t.documents, "doc_id", "text")[1]


@query("o_a32_ir_metrics", """WITH pool AS (SELECT d.source AS q, d.doc_id, l.quality * 2 + l.toxic AS rel, row_number() OVER (PARTITION BY d.source ORDER BY length(d.text), d.doc_id) AS rank FROM documents d JOIN labels l USING (doc_id)),
ideal AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, doc_id) AS best FROM pool)
SELECT q, sum(CASE WHEN rank <= 5 AND rel >= 2 THEN 1 ELSE 0 END) / 5.0 AS precision_at_5, round(CASE WHEN sum(CASE WHEN best <= 5 THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 5 THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) ELSE 0 END, 6) AS ndcg_at_5,
round(coalesce(1.0 / min(CASE WHEN rank <= 5 AND rel >= 2 THEN rank END), 0), 6) AS reciprocal_rank, max(CASE WHEN rank <= 3 AND rel >= 2 THEN 1 ELSE 0 END) AS success_at_3, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5.0 AS mean_relevance FROM ideal GROUP BY q""")
def ir_metrics(t):
    p = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("q"), "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("rel"), F.length("text").alias("n"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("n", "doc_id")))
    return retrieval_metrics(p, "q", "rank", "rel", "doc_id")


@query("o_a33_filter_precision", "SELECT d.lang, round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS plain, round(avg(CASE WHEN l.toxic = 0 THEN CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END END), 4) AS filtered, count_if(l.quality = 0) AS misses FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def filter_precision(t):
    good = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    j = t.documents.join(t.labels, "doc_id")
    return j.groupBy("lang").agg(F.round(F.avg(good), 4).alias("plain"), F.round(F.avg(F.when(F.col("toxic") == 0, good)), 4).alias("filtered"), F.count_if(F.col("quality") == 0).alias("misses"))


@query("o_a34_label_audit", f"SELECT count_if(n = 0) AS unknown, count_if(n > 1) AS several, count_if(n = 1) AS matched FROM (SELECT len({_LABELS}) AS n FROM documents)")
def label_audit(t):
    n = F.size(F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(x)) for x in ("@", "|", "License")])))
    return t.documents.select(n.alias("n")).agg(F.count_if(F.col("n") == 0).alias("unknown"), F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("n") == 1).alias("matched"))


@query("o_a35_policy_totals", "SELECT o_orderpriority AS policy, count(*) AS returned, count_if(o_orderstatus = 'F') AS done, count(*) - count(DISTINCT o_custkey) AS repeats FROM orders GROUP BY 1")
def policy_totals(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("policy")).agg(F.count("*").alias("returned"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), (F.count("*") - F.countDistinct("o_custkey")).alias("repeats"))


@query("o_a36_embedding_qa", "SELECT count(*) AS n, list_sort(list(DISTINCT len(embedding))) AS sizes, count_if(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS broken, count(*) - count(DISTINCT vec_id) AS repeated, count_if(abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 1e-5) AS not_unit FROM embeddings")
def embedding_qa(t):
    e = F.col("embedding")
    return t.embeddings.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.size(e).cast("long"))).alias("sizes"), F.count_if(~is_finite(e)).alias("broken"), (F.count("*") - F.countDistinct("vec_id")).alias("repeated"), F.count_if(F.abs(norm(e) - 1) > 1e-5).alias("not_unit"))


@query("o_a37_corpus_summary", r"SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count_if(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS private, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', doc_id, text)), 1, 8)) AS BIGINT)) AS BIGINT) AS fingerprint FROM documents GROUP BY 1")
def corpus_summary(t):
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")), 1, 8), 16, 10).cast("long")  # summed, so in any order
    private = F.count_if(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), private.alias("private"), F.sum(mark).alias("fingerprint"))


@query("o_a38_extensions", r"SELECT lower(regexp_extract(url, '\.([A-Za-z0-9]{1,5})$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def extensions(t):
    return t.pages.groupBy(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]{1,5})$", 1)).alias("ext")).agg(F.count("*").alias("n"))


@query("o_a39_inventory", f"SELECT route, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, unnest({_LABELS}) AS route FROM documents) GROUP BY route")
def inventory(t):
    labels = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(name)) for x, name in (("@", "contact"), ("|", "table"), ("License", "license"))]))
    return t.documents.select(F.length("text").alias("c"), F.explode(labels).alias("route")).groupBy("route").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("o_a40_fingerprints", "SELECT 'nation' AS name, TRUE AS same UNION ALL SELECT 'supplier', count_if(s_suppkey % 50 = 7) = 0 FROM supplier UNION ALL SELECT 'customer', (SELECT string_agg(c_name, '|' ORDER BY c_custkey) FROM customer) = (SELECT string_agg(CASE WHEN c_acctbal < -1e9 THEN 'x' ELSE c_name END, '|' ORDER BY c_custkey) FROM customer)")
def fingerprints(t):
    """Tables whose rows, in order, are those of an earlier state (here: some suppliers had another name)."""
    pairs = (
        ("nation", t.nation, t.nation, "n_nationkey", F.col("n_name")),
        ("supplier", t.supplier, t.supplier.withColumn("s_name", F.when(F.col("s_suppkey") % 50 == 7, "x").otherwise(F.col("s_name"))), "s_suppkey", F.col("s_name")),
        ("customer", t.customer, t.customer.withColumn("c_name", F.when(F.col("c_acctbal") < -1e9, "x").otherwise(F.col("c_name"))), "c_custkey", F.col("c_name")),
    )
    out = None
    for name, now, before, key, line in pairs:
        both = ordered_digest(now, key, line).join(F.broadcast(ordered_digest(before, key, line).withColumnRenamed("fingerprint", "before")), how="cross")  # one row each
        one = both.select(F.lit(name).alias("name"), (F.col("fingerprint") == F.col("before")).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query("o_a41_ranges", "SELECT event_type, min(ts) AS first, max(ts) AS last, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def ranges(t):
    return t.events.groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.avg("value"), 6).alias("mean"))


@query("o_a42_totals", "SELECT count(*) AS n FROM lineitem")
def totals(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("o_a43_distribution_line", "SELECT string_agg(concat(label, ':', n), ', ' ORDER BY label) AS line FROM (SELECT coalesce(CASE WHEN lang <> 'de' THEN lang END, 'UNKNOWN') AS label, count(*) AS n FROM documents GROUP BY 1)")
def distribution_line(t):
    n = t.documents.groupBy(F.coalesce(F.when(F.col("lang") != "de", F.col("lang")), F.lit("UNKNOWN")).alias("label")).agg(F.count("*").alias("n"))
    return n.agg(F.array_sort(F.collect_list(F.concat("label", F.lit(":"), "n"))).alias("x")).select(F.array_join("x", ", ").alias("line"))


@query("o_a44_median_by_group", "SELECT event_type, median(value) AS middle FROM events GROUP BY 1")
def median_by_group(t):
    return t.events.groupBy("event_type").agg(F.median("value").alias("middle"))


@query("o_a45_repeat_count", "SELECT user_id, count(*) - count(DISTINCT event_type) AS repeats FROM events GROUP BY 1")
def repeat_count(t):
    return t.events.groupBy("user_id").agg((F.count("*") - F.countDistinct("event_type")).alias("repeats"))


@query("o_a46_dashboard", "SELECT count(*) AS n, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS open, CAST(sum(lines) AS BIGINT) AS lines FROM (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def dashboard(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    j = t.orders.join(lines, "o_orderkey", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


@query("o_a47_breakdowns", "SELECT 'type' AS by, event_type AS label, count(*) AS n FROM events WHERE value > 50 GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id % 10 AS VARCHAR), count(*) FROM events WHERE value > 50 GROUP BY 2")
def breakdowns(t):
    e = t.events.filter("value > 50").select(F.explode(F.map_from_arrays(F.array(F.lit("type"), F.lit("user")), F.array("event_type", (F.col("user_id") % 10).cast("string")))).alias("by", "label"))
    return e.groupBy("by", "label").agg(F.count("*").alias("n"))


@query("o_x1_tokens", f"SELECT doc_id, {_TOKENS} AS terms FROM documents")
def tokens(t):
    return t.documents.select("doc_id", terms(F.col("text")).alias("terms"))
