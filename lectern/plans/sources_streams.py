"""Sources, sinks, order-dependent text machines and streams over the tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators.curriculum import merge_items, repair_encoding
from ..registry import query
from ..sources.files import file_kind, latest_file, optional_parquet, split_known, union_files, write_json_lines
from ..sources.html import page_links, table_cells
from ..sources.providers import embed, extract_pages, paged
from ..storage import work_folder
from ..streaming.incremental import changed_only, drained, leases, windowed_counts
from ..streaming.keyed_table import KeyedTable


@query("o_s1_table_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 100")
def table_scan(t):
    return t.customer.filter("c_acctbal > 9000").select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query("o_s2_bound_sql", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")
def bound_sql(t):
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice >= :least AND o_orderstatus = :status", args={"least": 100000, "status": "F"}, orders=t.orders)


# A reader takes the first version; a writer then commits another one, with customers in debt moved; the reader still reads what it took.
@query("o_s3_snapshot", "SELECT c_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, count_if(c_acctbal < 0) AS later FROM customer GROUP BY 1")
def snapshot(t):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", F.lit(1).alias("at"))
    table = KeyedTable(t.spark, work_folder(t.spark, "snapshot"), rows.schema, ["c_custkey"], "at", buckets=8)
    table.upsert(rows)
    pinned = table.snapshot()
    table.upsert(rows.filter("c_acctbal < 0").select("c_custkey", F.lit(-1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit(2).alias("at")))
    moved = table.snapshot().filter("c_nationkey = -1").select("c_custkey", F.lit(1).alias("moved"))
    both = pinned.join(moved, "c_custkey", "left")
    return both.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("moved").alias("later"))


@query("o_s4_unwrap_records", "SELECT conv_id, role, length(text)::BIGINT AS n FROM conversations")
def unwrap_records(t):
    docs = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("role", "text")).alias("records"))).alias("body"))
    record = F.from_json("body", "records array<struct<role: string, text: string>>")
    return docs.select("conv_id", F.inline(record["records"])).select("conv_id", "role", F.length("text").cast("long").alias("n"))


@query("o_s5_json_lines", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_lines(t):
    return t.events.filter(F.trim("props") != "").select(F.from_json("props", "k bigint").alias("r")).groupBy("r.k").agg(F.count("*").alias("n"))


@query("o_s6_union_files", "SELECT r_regionkey AS k, r_name AS name, NULL AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_of_files(t):
    return union_files([t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))])


@query("o_s7_latest_file", "SELECT 'supplier.parquet' AS name")
def latest(t):
    path = latest_file(t.spark, t.folder, "*.parquet")
    return t.spark.createDataFrame([(path.rsplit("/", 1)[-1],)], "name string")


def _listing(page: int) -> list[dict]:
    return [{"page": page, "item": 10 * page + i} for i in range(10)]


@query("o_s9_paged_source", "SELECT n_nationkey AS page, 10 * n_nationkey + i AS item FROM nation, range(10) r(i)")
def paged_source(t):
    return paged(t.nation.repartition(4), "n_nationkey", _listing, "page long, item long")


@query("o_s13_extracted_pages", "SELECT n_nationkey, n_name AS text FROM nation")
def extracted_pages(t):
    files = t.nation.select(F.col("n_nationkey").cast("string").alias("path"), F.encode("n_name", "utf-8").alias("content"))
    pages = extract_pages(files, lambda content: [content.decode()])
    return pages.filter("failure IS NULL").select(F.col("path").cast("int").alias("n_nationkey"), "text")


def _hashing_model():
    """A stand-in for a model: counts of hashed characters."""
    return lambda texts: np.array([np.bincount(np.frombuffer(x.encode(), np.uint8) % 16, minlength=16) for x in texts])


@query("o_s17_embedding_provider", "SELECT doc_id, 16 AS size, true AS unit FROM documents WHERE trim(text) <> '' AND length(text) <= 8000")
def embedding_provider(t):
    e = embed(t.documents, "doc_id", "text", _hashing_model, 16)
    return e.filter("status = 'COMPLETED'").select("doc_id", F.size("embedding").alias("size"), (F.abs(norm(F.col("embedding")) - 1) < 1e-5).alias("unit"))


@query("o_s8_optional", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS note FROM nation")
def optional_source(t):
    notes = optional_parquet(t.spark, f"{t.folder}/no_such_table_{uuid.uuid4().hex}.parquet", "n_nationkey int, note string")
    return t.nation.select("n_nationkey").join(notes, "n_nationkey", "left")


@query("o_s10_html_rows", r"SELECT page_id, pos, target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target, CAST(generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS INTEGER) AS pos FROM pages)")
def html_rows(t):
    return page_links(t.pages).filter("tag = 'a'").select("page_id", F.col("position").alias("pos"), "target")


@query("o_s10_html_tables", "WITH r AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS f, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber AS VARCHAR), l_returnflag) - 1 AS INTEGER) AS row_no FROM lineitem) SELECT l_orderkey, 0 AS table_no, row_no, c AS cell_no, FALSE AS header, 1 AS colspan, 1 + c AS rowspan, CASE c WHEN 0 THEN CAST(n AS VARCHAR) ELSE f END AS text FROM r, (VALUES (0), (1)) v(c)")
def html_tables(t):
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td rowspan=2>"), "l_returnflag", F.lit("</td></tr>"))
    pages = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return table_cells(pages, "l_orderkey").select("l_orderkey", "table_no", "row_no", "cell_no", "header", "colspan", "rowspan", "text")


@query("o_s11_content_key", "SELECT page_id, sha256(html) AS checksum, octet_length(encode(html)) AS size, NOT regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.)') AND starts_with(url, 'http') AS allowed FROM pages".replace("\\\\", "\\"))
def content_key(t):
    safe = ~F.col("url").rlike(r"^https?://(localhost|127\.|10\.|192\.168\.)") & F.col("url").startswith("http")
    return t.pages.select("page_id", F.sha2("html", 256).alias("checksum"), F.octet_length("html").cast("long").alias("size"), safe.alias("allowed"))


@query("o_s12_file_kind", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'pdf' WHEN n_nationkey % 3 = 1 THEN 'png' ELSE 'unknown' END AS kind FROM nation")
def kinds(t):
    k = F.col("n_nationkey") % 3
    content = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.encode("n_name", "utf-8"))
    return t.nation.select("n_nationkey", file_kind(content).alias("kind"))


@query("o_s16_reuse", "SELECT 'reuse' AS state, count(*) AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'pending', count(*) FROM documents WHERE doc_id % 3 <> 0")
def reuse(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("h"))
    known, todo = split_known(rows, rows.filter("doc_id % 3 = 0"), ["doc_id", "h"])
    return known.agg(F.count("*").alias("n")).select(F.lit("reuse").alias("state"), "n").unionByName(todo.agg(F.count("*").alias("n")).select(F.lit("pending").alias("state"), "n"))


@query("o_s18_seed", "SELECT * FROM (VALUES ('HQ', 1), ('EAST', 2)) v(name, floor_no)")
def seed(t):
    return t.spark.createDataFrame([("HQ", 1), ("EAST", 2)], "name string, floor_no int")


@query("o_s19_point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id = 42")
def point_lookup(t):
    return t.documents.filter("doc_id = 42").select("doc_id", "lang").limit(1)


@query("o_f7_threshold", "SELECT vec_id FROM embeddings e WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) >= 0.4")
def threshold(t):
    asked = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("vector")).limit(1)
    return t.embeddings.join(F.broadcast(asked), how="cross").filter(cosine(F.col("embedding"), F.col("vector")) >= 0.4).select("vec_id")


@query("o_w13_json_lines_out", "SELECT o_orderkey, concat('{\"id\":', o_orderkey, ',\"status\":\"', o_orderstatus, '\",\"note\":null}') AS value FROM orders")
def json_lines_out(t):
    path = f"{work_folder(t.spark, 'lines')}/orders"
    write_json_lines(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note")), path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("o_orderkey"), "value")


@query("o_x57_encoding", "SELECT n_nationkey, n_name AS name FROM nation")
def encoding(t):
    return t.nation.select("n_nationkey", repair_encoding(F.col("n_name")).alias("name"))


@query("o_r11_merge_audit", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.label, b.label) AS label, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NOT NULL AND contains(lower(b.v), lower(a.v)) AND NOT contains(lower(a.v), lower(b.v)) THEN b.v ELSE a.v END AS value, CASE WHEN b.v IS NULL THEN 'kept' WHEN a.v IS NULL THEN 'added' WHEN contains(lower(a.v), lower(b.v)) THEN 'skipped' WHEN contains(lower(b.v), lower(a.v)) THEN 'extended' ELSE 'conflict' END AS outcome FROM (SELECT p_partkey AS k, 'brand' AS label, p_brand AS v FROM part) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'size' ELSE 'brand' END AS label, CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR) WHEN p_size > 30 THEN p_brand || 'x' WHEN p_size > 20 THEN 'other' ELSE lower(p_brand) END AS v FROM part WHERE p_size > 10) b ON a.k = b.k AND a.label = b.label")
def merge_audit(t):
    s = F.col("p_size")
    a = t.part.select(F.col("p_partkey").alias("k"), F.lit("brand").alias("label"), F.col("p_brand").alias("value"))
    value = F.when(s > 40, s.cast("string")).when(s > 30, F.concat("p_brand", F.lit("x"))).when(s > 20, "other").otherwise(F.lower("p_brand"))
    b = t.part.filter(s > 10).select(F.col("p_partkey").alias("k"), F.when(s > 40, "size").otherwise("brand").alias("label"), value.alias("value"))
    return merge_items(a, b, "k")


@query("o_t1_incremental", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def incremental(t):
    now = t.documents.select("doc_id", F.md5("text").alias("h"))
    known = t.documents.filter("doc_id % 10 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return changed_only(now, known, "doc_id", "h").select("doc_id")


def _event_stream(t):
    return t.spark.readStream.schema(t.events.schema).parquet(t.folder, pathGlobFilter="events.parquet")


# The table holds the views when the stream begins; its batch is run twice, and an older one follows: the latest event of each user stays.
@query("o_t1_streamed_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def streamed_upsert(t):
    columns = ["user_id", "event_id", "event_type", "value"]
    events = t.events.select(*columns)
    folder = work_folder(t.spark, "upserts")
    table = KeyedTable(t.spark, f"{folder}/table", events.schema, ["user_id"], "event_id", buckets=16)
    table.upsert(events.filter("event_type = 'view'"))
    stream = _event_stream(t).select(*columns)
    stream.writeStream.foreachBatch(table.sink("events")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    before = table.manifest()
    table.sink("events")(events.withColumn("value", F.lit(-1.0)), max(before["streams"].values()))
    table.upsert(events.filter("event_type = 'click'"))
    return table.snapshot()


@query("o_t2_leases")
def lease_states(t):
    event = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("none")
    e = _event_stream(t).select(F.col("user_id").alias("id"), event.alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return drained(leases(e), work_folder(t.spark, "leases"), "update", ["id"])


@query("o_t3_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(t):
    e = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))
    return drained(windowed_counts(e, "at", "event_type"), work_folder(t.spark, "windows"), "complete", [])
