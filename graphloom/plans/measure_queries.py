"""Queries that count, measure and compare: roll-ups, percentiles, evaluation metrics, snapshots, ranges, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import module_stem
from graphloom.operators import changes
from graphloom.operators.search import containing
from graphloom.plans.graph_queries import CALLS, CUSTOMERS, REFERENCES
from graphloom.plans.registry import query
from graphloom.sources.graph_views import Tables, edges, nodes

BOTH = f"{CALLS}, {REFERENCES}, e AS (SELECT 'CALLS' AS kind, confidence, 'resolver' AS origin FROM calls UNION ALL SELECT 'REFERENCES', confidence, 'resolver' FROM refs UNION ALL SELECT 'DEFINES', NULL, 'syntax' FROM orders)"


@query(f"""WITH {BOTH} SELECT coalesce(kind, '') AS kind, coalesce(origin, '') AS origin, coalesce(confidence, '') AS confidence, count(*) AS n
FROM (SELECT kind, origin, coalesce(confidence, 'unknown') AS confidence FROM e) GROUP BY GROUPING SETS ((kind), (origin), (confidence), ())""")
def fanout_grouping_sets(t: Tables) -> DataFrame:
    rows = edges(t, "CALLS", "REFERENCES", "DEFINES").select("kind", "origin", F.coalesce("confidence", F.lit("unknown")).alias("confidence"))
    sets = rows.groupingSets([["kind"], ["origin"], ["confidence"], []], "kind", "origin", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "origin", "confidence")], "n")


@query(f"WITH {BOTH} SELECT kind, count(*) AS n, count(*) FILTER (confidence = 'high') AS n_high FROM e GROUP BY kind")
def fanout_by_kind(t: Tables) -> DataFrame:
    return edges(t, "CALLS", "REFERENCES", "DEFINES").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("n_high"))


@query(f"""WITH {CUSTOMERS}, {CALLS}, n AS (SELECT file, count(*) AS n_nodes FROM cust JOIN orders ON o_custkey = c_custkey GROUP BY file), k AS (SELECT file, count(*) AS n_edges FROM calls JOIN cust ON owner = c_custkey GROUP BY file)
SELECT coalesce(n.file, k.file) AS file, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges FROM n FULL JOIN k ON n.file = k.file""")
def graph_counts_by_file(t: Tables) -> DataFrame:
    n = nodes(t, "Function").groupBy("file").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges(t, "CALLS").groupBy(F.col("owner_file").alias("file")).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "file", "full_outer").select("file", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, max(n_chars) AS longest, round(avg(n_chars), 4) AS mean, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90,
quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, count(*) FILTER (n_chars > 4096) AS oversized FROM documents GROUP BY lang""")
def token_percentiles(t: Tables) -> DataFrame:
    """Nearest-rank percentiles of chunk sizes by language."""
    rank = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars) AS BIGINT)")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 4).alias("mean"), *[rank(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.count_if(F.col("n_chars") > 4096).alias("oversized"))


@query("""WITH b AS (SELECT doc_id // 16 AS batch, max(n_chars) AS longest, sum(n_chars)::BIGINT AS total, count(*) AS n FROM documents GROUP BY doc_id // 16)
SELECT batch, longest, total, longest * n AS padded, longest * n - total AS waste, round((longest * n - total) / (longest * n), 6) AS ratio FROM b""")
def embedding_batch_telemetry(t: Tables) -> DataFrame:
    b = t.documents.groupBy(F.expr("doc_id div 16").alias("batch")).agg(F.max("n_chars").alias("longest"), F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))
    padded = F.col("longest") * F.col("n")
    return b.select("batch", "longest", "total", padded.alias("padded"), (padded - F.col("total")).alias("waste"), F.round((padded - F.col("total")) / padded, 6).alias("ratio"))


@query(f"""WITH {CUSTOMERS} SELECT coalesce('r' || n_regionkey, '') AS repo, coalesce(n_name, '') AS package, count(*) AS n, count(*) FILTER (file_kind = 'test') AS n_test FROM cust GROUP BY ROLLUP (n_regionkey, n_name)""")
def discovery_rollup(t: Tables) -> DataFrame:
    rows = nodes(t, "File").rollup("repo", "package_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("file_kind") == "test").alias("n_test"))
    return rows.select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("package_name", F.lit("")).alias("package"), "n", "n_test")


@query("""SELECT lang AS reason, source AS folder, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents WHERE n_chars < 400 GROUP BY lang, source ORDER BY n DESC, bytes DESC, reason, folder LIMIT 10""")
def top_contributors(t: Tables) -> DataFrame:
    rows = t.documents.filter("n_chars < 400").groupBy(F.col("lang").alias("reason"), F.col("source").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))
    return rows.orderBy(F.col("n").desc(), F.col("bytes").desc(), "reason", "folder").limit(10)


@query(f"""WITH {CUSTOMERS} SELECT n_name AS package, count(*) AS discovered, count(o) AS parsed, count(*) FILTER (o IS NULL) AS skipped, count(*) FILTER (o > 12) AS rich
FROM cust LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY n_name""")
def lifecycle_counts(t: Tables) -> DataFrame:
    """How far each package's files came: discovered, parsed, skipped, rich in symbols."""
    per_file = nodes(t, "Function").groupBy("file").agg(F.count(F.lit(1)).alias("o"))
    rows = nodes(t, "File").join(per_file, "file", "left")
    return rows.groupBy(F.col("package_name").alias("package")).agg(F.count(F.lit(1)).alias("discovered"), F.count("o").alias("parsed"), F.count_if(F.col("o").isNull()).alias("skipped"), F.count_if(F.col("o") > 12).alias("rich"))


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value, event_id) AS n FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE n = 1""")
def failure_history_latest(t: Tables) -> DataFrame:
    rows = changes.latest(t.events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("value"), F.col("event_id")])
    return rows.select("user_id", "event_type", "event_id", "value")


@query("""WITH p AS (SELECT p_brand, min(p_type || '/' || p_name) AS lo, max(p_type || '/' || p_name) AS hi FROM part GROUP BY p_brand)
SELECT p_brand, coalesce(max(substr(lo, 1, k)) FILTER (substr(lo, 1, k) = substr(hi, 1, k)), '') AS prefix FROM p, range(1, 60) t(k) WHERE k <= length(lo) GROUP BY p_brand""")
def common_prefix(t: Tables) -> DataFrame:
    """The longest common prefix of each group: that of its least and greatest member."""
    p = t.part.select("p_brand", F.concat_ws("/", "p_type", "p_name").alias("s")).groupBy("p_brand").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    k = F.aggregate(F.sequence(F.lit(1), F.length("lo")), F.lit(0), lambda a, i: F.when(F.expr("lo").substr(F.lit(1), i) == F.expr("hi").substr(F.lit(1), i), i).otherwise(a))
    return p.select("p_brand", F.col("lo").substr(F.lit(1), k).alias("prefix"))


RANKED = "WITH q AS (SELECT source, d.doc_id, quality = 1 AS wanted, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(RANKED + """, m AS (SELECT source, min(rank) FILTER (wanted AND rank <= 10) AS first, count(*) FILTER (wanted AND rank <= 10) AS hits, count(*) FILTER (wanted) AS total, count(*) FILTER (NOT wanted AND rank <= 10) AS wrong,
  coalesce(sum(1 / log2(rank + 1)) FILTER (wanted AND rank <= 10), 0) AS dcg FROM q GROUP BY source)
SELECT source, round(coalesce(1.0 / first, 0), 6) AS mrr, round(hits / greatest(total, 1), 6) AS recall, round(CASE WHEN total = 0 THEN 1 ELSE dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg, wrong FROM m""")
def eval_metrics_mrr_recall_ndcg(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    q = t.documents.join(t.labels, "doc_id").select("source", "doc_id", (F.col("quality") == 1).alias("wanted"), F.row_number().over(w).alias("rank"))
    top = F.col("wanted") & (F.col("rank") <= 10)
    m = q.groupBy("source").agg(F.min(F.when(top, F.col("rank"))).alias("first"), F.count_if(top).alias("hits"), F.count_if("wanted").alias("total"), F.count_if(~F.col("wanted") & (F.col("rank") <= 10)).alias("wrong"), F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return m.select("source", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / F.greatest("total", F.lit(1)), 6).alias("recall"), F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"), "wrong")


@query("""SELECT coalesce(lang, '') AS capability, coalesce(gate, '') AS gate, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0 AND gate = 'required') AS blocking
FROM (SELECT lang, quality, CASE WHEN toxic = 1 THEN 'target' ELSE 'required' END AS gate FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((lang), (gate), ())""")
def eval_gate_rollup(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").select(F.col("lang").alias("capability"), "quality", F.when(F.col("toxic") == 1, "target").otherwise("required").alias("gate"), F.when(F.col("toxic") == 1, "target").otherwise("required").alias("g"))
    out = rows.groupingSets([["capability"], ["gate"], []], "capability", "gate").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if((F.col("quality") == 0) & (F.col("g") == "required")).alias("blocking"))
    return out.select(F.coalesce("capability", F.lit("")).alias("capability"), F.coalesce("gate", F.lit("")).alias("gate"), "total", "passed", "blocking")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT c_nationkey, c_mktsegment, c_custkey FROM r WHERE n = 1""")
def first_per_key(t: Tables) -> DataFrame:
    return changes.latest(t.customer, ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey")


CAP = """WITH r AS (SELECT doc_id, source, n_chars, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS cap, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY source, cap = 2 AND n > 1 ORDER BY n) AS m FROM r)
SELECT doc_id, source, n_chars FROM s WHERE n = 1 OR (cap = 2 AND m = 1) ORDER BY n_chars DESC, doc_id LIMIT 25"""


@query(CAP)
def topk_per_file_cap(t: Tables) -> DataFrame:
    """A greedy cap per file of 1, or 2 for some rows, in closed form: the first, and the first further row of cap 2."""
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    rows = t.documents.select("doc_id", "source", "n_chars", F.when(F.col("lang") == "en", 2).otherwise(1).alias("cap")).withColumn("n", F.row_number().over(w))
    second = Window.partitionBy("source", (F.col("cap") == 2) & (F.col("n") > 1)).orderBy("n")
    rows = rows.withColumn("m", F.row_number().over(second)).filter("n = 1 OR (cap = 2 AND m = 1)")
    return rows.orderBy(F.col("n_chars").desc(), "doc_id").limit(25).select("doc_id", "source", "n_chars")


@query("""SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'call-syntax' WHEN 'N' THEN 'compiler' ELSE 'module-resolution' END)), ',') AS evidence FROM lineitem GROUP BY l_orderkey""")
def evidence_union(t: Tables) -> DataFrame:
    e = edges(t, "CALLS").groupBy("from_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), ",").alias("evidence"))
    return e.select(F.substring_index("from_id", ":", -1).cast("long").alias("l_orderkey"), "evidence")


DIFF = """WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""


@query(DIFF)
def snapshot_diff(t: Tables) -> DataFrame:
    before = t.documents.filter("doc_id % 7 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    after = t.documents.filter("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("h"))
    return changes.snapshot_diff(before, after, "doc_id", "h")


@query("""WITH w AS (SELECT DISTINCT md5(text) AS h FROM documents) SELECT h, h IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AS reused FROM w""")
def cache_reuse(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return changes.reuse(hashed, hashed.filter("doc_id % 3 = 0"), "h")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM r WHERE n = 1""")
def merge_first_wins(t: Tables) -> DataFrame:
    return changes.latest(t.documents, ["text"], [F.col("doc_id")]).select("doc_id", "source")


@query("""WITH u AS (SELECT c_custkey, c_name, 1 AS seq FROM customer UNION ALL SELECT c_custkey, c_name || ' (moved)', 2 FROM customer WHERE c_custkey % 4 = 0)
SELECT c_custkey, arg_max(c_name, seq) AS c_name FROM u GROUP BY c_custkey""")
def node_upsert(t: Tables) -> DataFrame:
    moved = t.customer.filter("c_custkey % 4 = 0").select("c_custkey", F.concat("c_name", F.lit(" (moved)")).alias("c_name"), F.lit(2).alias("seq"))
    rows = t.customer.select("c_custkey", "c_name", F.lit(1).alias("seq")).unionByName(moved)
    return changes.latest(rows, ["c_custkey"], [F.col("seq").desc()]).select("c_custkey", "c_name")


@query("""WITH d AS (SELECT *, md5(text) AS h FROM documents) SELECT h, min(doc_id) AS doc_id, count(*) - 1 AS duplicates, max(n_chars) AS size FROM d GROUP BY h""")
def embed_dedupe_inputs(t: Tables) -> DataFrame:
    """Each distinct input once, with how many would have been embedded again."""
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("duplicates"), F.max("n_chars").alias("size"))


SPANS = "WITH s AS (SELECT l_orderkey AS f, l_linenumber AS id, l_linenumber AS a, l_linenumber + (l_partkey % 5)::INT AS b FROM lineitem)"


@query(SPANS + """, r AS (SELECT p.f, p.id AS point, s.id AS span, row_number() OVER (PARTITION BY p.f, p.id ORDER BY s.b - s.a, s.id, s.a, s.b) AS n FROM s p JOIN s ON p.f = s.f AND s.a < p.a AND s.b >= p.b)
SELECT f, point, span FROM r WHERE n = 1""")
def range_containment_smallest(t: Tables) -> DataFrame:
    """For each span the smallest other one of its file that contains it."""
    s = t.lineitem.select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + (F.col("l_partkey") % 5)).cast("int").alias("b"))
    p = s.select("f", F.col("id").alias("point"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    return p.join(s, "f").filter("a < pa AND b >= pb").groupBy("f", "point").agg(F.min(F.struct(F.col("b") - F.col("a"), "id")).alias("m")).select("f", "point", F.col("m.id").alias("span"))


@query(SPANS + " SELECT x.f, x.id AS one, y.id AS two FROM s x JOIN s y ON x.f = y.f AND x.id < y.id AND x.a <= y.b AND y.a <= x.b GROUP BY x.f, x.id, y.id")
def range_overlap(t: Tables) -> DataFrame:
    """Overlapping spans of every file."""
    s = t.lineitem.select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + (F.col("l_partkey") % 5)).cast("int").alias("b"))
    x, y = (s.select("f", *[F.col(c).alias(f"{k}{c}") for c in ("id", "a", "b")]) for k in "xy")
    return x.join(y, "f").filter("xid < yid AND xa <= yb AND ya <= xb").select("f", F.col("xid").alias("one"), F.col("yid").alias("two")).distinct()


@query(f"""WITH {CUSTOMERS}, f AS (SELECT file, file_kind FROM cust UNION ALL SELECT replace(file, '.ts', '.test.ts'), 'test' FROM cust WHERE c_custkey % 3 = 0)
SELECT t.file AS test_file, s.file AS source_file FROM f t JOIN f s ON replace(t.file, '.test.ts', '.ts') = s.file AND t.file <> s.file""")
def suffix_pairing(t: Tables) -> DataFrame:
    """Tests with the source file their own name points to."""
    files = nodes(t, "File").select("file")
    tests = files.filter(F.regexp_extract("file", "/c([0-9]+)", 1).cast("long") % 3 == 0).select(F.concat(module_stem(F.col("file")), F.lit(".test.ts")).alias("test_file"))
    return tests.join(files, F.regexp_replace("test_file", r"\.test\.ts$", ".ts") == F.col("file")).select("test_file", F.col("file").alias("source_file"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '/') AS s FROM pages)
SELECT page_id, s[2] AS lang FROM p WHERE len(s) = 3 AND s[2] IN ('en', 'fr') AND s[3] <> ''""")
def route_pattern_join(t: Tables) -> DataFrame:
    """Requests with the route patterns they fit: as many segments, each equal or a parameter."""
    routes = t.spark.createDataFrame([(["en", ":id"], "en"), (["fr", ":id"], "fr")], "route array<string>, lang string").withColumn("n", F.size("route"))
    pages = t.pages.select("page_id", F.split(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/").alias("seg")).withColumn("m", F.size("seg"))
    same = F.forall(F.zip_with("route", "seg", lambda r, s: (r == s) | (r.startswith(":") & (s != ""))), lambda x: x)
    return pages.join(F.broadcast(routes), (F.col("n") == F.col("m")) & same).select("page_id", "lang")


@query("""SELECT d.doc_id, i.item_id FROM documents d JOIN benchmark i ON contains(d.text, i.text)""")
def substring_theta_join(t: Tables) -> DataFrame:
    """Documents that contain a benchmark text as a whole."""
    return containing(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def event_log_tail(t: Tables) -> DataFrame:
    last = t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20)
    return last.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, max(ts) AS beat, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN epoch_ms(now) - epoch_ms(beat) > 300000 THEN 'stale' ELSE 'running' END AS status FROM u, m""")
def heartbeat_stale(t: Tables) -> DataFrame:
    """Runs whose last sign of life is over five minutes old."""
    now = t.events.agg(F.max("ts").alias("now"))
    u = t.events.groupBy("user_id").agg(F.max("ts").alias("beat"), F.count(F.lit(1)).alias("n"))
    old = F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("beat").cast("timestamp")) > 300_000
    return u.join(F.broadcast(now)).select("user_id", "n", F.when(old, "stale").otherwise("running").alias("status"))


@query("""SELECT doc_id, source, 1 + ceil(n_chars / 1024)::BIGINT + 2 * (n_chars % 7) + CASE WHEN lang = 'de' THEN 30 ELSE 0 END AS cost FROM documents""")
def file_cost_model(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", _cost().alias("cost"))


def _cost():
    return 1 + F.ceil(F.col("n_chars") / 1024) + 2 * (F.col("n_chars") % 7) + F.when(F.col("lang") == "de", 30).otherwise(0)


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, 1 + ceil(n_chars / 1024)::BIGINT + 2 * (n_chars % 7) + CASE WHEN lang = 'de' THEN 30 ELSE 0 END AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, cost, i, 0::BIGINT AS bin, cost AS total, 1 AS n FROM c WHERE i = 1 UNION ALL
  SELECT c.source, c.doc_id, c.cost, c.i, r.bin + CASE WHEN r.total + c.cost > 120 OR r.n >= 8 THEN 1 ELSE 0 END, CASE WHEN r.total + c.cost > 120 OR r.n >= 8 THEN c.cost ELSE r.total + c.cost END, CASE WHEN r.total + c.cost > 120 OR r.n >= 8 THEN 1 ELSE r.n + 1 END
  FROM r JOIN c ON c.source = r.source AND c.i = r.i + 1)
SELECT source, doc_id, cost, bin FROM r""")
def shard_bins_greedy(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", _cost().cast("long").alias("cost"))
    return changes.greedy_bins(rows, "source", "doc_id", "cost", 120, 8)


@query()
def length_aware_batches(t: Tables) -> DataFrame:
    return changes.padded_batches(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 16, 40_000, 60_000)
