"""Queries on text and paths: tokenizing, ids, truncation, globs, exact search, module resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.search import search_lines
from graphloom.plans.graph_queries import CUSTOMERS
from graphloom.plans.ranking_queries import TOKENS
from graphloom.plans.registry import query
from graphloom.sources.graph_views import Tables, nodes


@query(f"SELECT p_partkey, array_to_string({TOKENS.format(t="replace(p_name, ' ', '') || p_brand || 'camelCase' || p_type")}, ' ') AS tokens FROM part")
def tokenize_camel(t: Tables) -> DataFrame:
    text = F.concat(F.regexp_replace("p_name", " ", ""), "p_brand", F.lit("camelCase"), "p_type")
    return t.part.select("p_partkey", F.array_join(T.tokens(text), " ").alias("tokens"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name || ' a1 $x ' || p_brand), '[a-z_$][a-z0-9_$]*'), lambda x: length(x) > 2), ' ') AS words FROM part")
def query_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(T.query_words(F.concat("p_name", F.lit(" a1 $x "), "p_brand")), " ").alias("words"))


@query("SELECT DISTINCT p_name, array_to_string(list_distinct_ordered, ' ') AS needles FROM (SELECT p_name, list_filter(regexp_split_to_array(lower(p_name || '.$Get-' || p_name), '[^a-z0-9_$]+'), lambda x, i: x <> '' AND list_position(regexp_split_to_array(lower(p_name || '.$Get-' || p_name), '[^a-z0-9_$]+'), x) = i) AS list_distinct_ordered FROM part)")
def symbol_needles(t: Tables) -> DataFrame:
    return t.part.select("p_name", F.array_join(T.needles(F.concat("p_name", F.lit(".$Get-"), "p_name")), " ").alias("needles")).distinct()


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || upper(w[i + 1][1]) || substr(w[i + 1], 2)), ' ') AS grams FROM w""")
def camel_bigrams(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w"))
    return words.select("p_partkey", F.array_join(T.camel_grams(F.col("w"), 2), " ").alias("grams"))


@query(f"""WITH {CUSTOMERS} SELECT c_custkey, 'file:ws:r' || n_regionkey || '@c0ffee:' || file || '#' || c_name AS id, 'edge:CONTAINS:package:' || c_nationkey || '->file:' || c_custkey AS edge, substr(sha256(file), 1, 8) AS digest FROM cust""")
def stable_ids(t: Tables) -> DataFrame:
    files = nodes(t, "File").select("id", "repo", F.concat(F.lit(".\\"), F.regexp_replace("file", "/", "\\\\")).alias("raw"), "file", "name")
    packages = t.customer.select("c_custkey", F.concat(F.lit("package:"), F.col("c_nationkey").cast("string")).alias("p"), F.concat(F.lit("file:"), F.col("c_custkey").cast("string")).alias("fid"))
    made = T.stable_id(F.lit("file"), F.lit("ws"), F.col("repo"), F.lit("c0ffee"), T.normal_path(F.col("raw")), F.col("name"))
    return files.join(packages, F.col("id") == F.col("fid")).select("c_custkey", made.alias("id"), T.edge_id(F.lit("CONTAINS"), F.col("p"), F.col("fid")).alias("edge"), F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 8).alias("digest"))


@query("""WITH c AS (SELECT doc_id, text, strlen(text) AS bytes FROM documents), k AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, unnest(range(0, 101)) AS n, text FROM c WHERE bytes > 100) WHERE n <= length(text) AND strlen(left(text, n)) <= 88 GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN bytes <= 100 THEN text ELSE left(text, n) || chr(10) || '[truncated]' END AS excerpt FROM c LEFT JOIN k ON c.doc_id = k.doc_id""")
def utf8_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate_utf8(F.col("text"), 100).alias("excerpt"))


def _roles_sql() -> str:
    names = ", ".join(f"CASE WHEN (m & {b}) > 0 THEN '{n}' END" for b, n in T.ROLES.items())
    return f"WITH m AS (SELECT DISTINCT (l_partkey % 128)::INT AS m FROM lineitem), r AS (SELECT m, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS r FROM m) SELECT m AS mask, CASE WHEN r = '' THEN 'ReadAccess' ELSE r END AS roles FROM r"


@query(_roles_sql())
def role_bitmask(t: Tables) -> DataFrame:
    masks = t.lineitem.select((F.col("l_partkey") % 128).cast("int").alias("mask")).distinct()
    return masks.select("mask", F.array_join(T.role_names(F.col("mask")), ",").alias("roles"))


@query(f"WITH {CUSTOMERS} SELECT file, regexp_matches(file, '^n1[^/]*/.*\\.ts$') AS included, regexp_matches(file, '^n2/.*$') AS folder, regexp_matches(file, '^(?:.*/)?c[^/]5\\.ts$') AS deep FROM cust")
def glob_filter(t: Tables) -> DataFrame:
    fits = lambda p: F.col("file").rlike(T.glob_regex(p))
    return nodes(t, "File").select("file", fits("n1*/**.ts").alias("included"), fits("n2").alias("folder"), fits("**/c?5.ts").alias("deep"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (json_extract(props, '$.missing') IS NULL) AS lacking FROM events GROUP BY event_type")
def json_metadata_extract(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("lacking"))


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT source, doc_id, line_no, substr(line, 1, 80) AS excerpt FROM l WHERE contains(line, '%%% ') ORDER BY source, doc_id, line_no LIMIT 100""")
def exact_line_search(t: Tables) -> DataFrame:
    hits = search_lines(t.documents, "%%% ", ["source", "doc_id"], "text", 100)
    return hits.select("source", "doc_id", "line_no", F.substring("line", 1, 80).alias("excerpt"))


LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS spec FROM pages)"


@query(f"""WITH {LINKS}, n AS (SELECT DISTINCT lower(substr(p_name, 1, strpos(p_name || ' ', ' ') - 1)) AS pkg FROM part)
SELECT spec, count(*) AS n, CASE WHEN starts_with(spec, '.') THEN 'relative' WHEN starts_with(spec, '/') AND lower(substr(spec, 2)) IN (SELECT pkg FROM n) THEN 'workspace' WHEN starts_with(spec, '/') THEN 'unresolved' ELSE 'external' END AS status FROM links GROUP BY spec""")
def module_resolution_priority(t: Tables) -> DataFrame:
    """Specifiers with the first way of resolving them that applies."""
    links = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("spec")).groupBy("spec").agg(F.count(F.lit(1)).alias("n"))
    packages = t.part.select(F.lower(F.substring_index("p_name", " ", 1)).alias("pkg")).distinct()
    found = links.join(packages, F.lower(F.expr("substr(spec, 2)")) == F.col("pkg"), "left")
    status = F.when(F.col("spec").startswith("."), "relative").when(F.col("spec").startswith("/") & F.col("pkg").isNotNull(), "workspace").when(F.col("spec").startswith("/"), "unresolved").otherwise("external")
    return found.select("spec", "n", status.alias("status"))


@query(f"""WITH {CUSTOMERS}, f AS (SELECT replace(file, '.ts', CASE c_custkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END) AS file FROM cust),
a AS (SELECT DISTINCT 'n' || c_nationkey || '/c' || (c_custkey + 1) AS stem FROM customer), e AS (SELECT unnest(['.ts', '.tsx', '.js', '/index.ts', '/index.js']) AS ext, generate_subscripts(['.ts', '.tsx', '.js', '/index.ts', '/index.js'], 1) AS p)
SELECT stem, min(p) AS place, arg_min(f.file, p) AS file FROM a, e JOIN f ON f.file = stem || ext GROUP BY stem""")
def extension_probe(t: Tables) -> DataFrame:
    """For each import stem the first file that exists among its extensions and index files."""
    k = F.regexp_extract("file", "/c([0-9]+)", 1).cast("long")
    files = nodes(t, "File").select(F.concat(T.module_stem(F.col("file")), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.js")).alias("file"))
    asked = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), (F.col("c_custkey") + 1).cast("string")).alias("stem")).distinct()
    # a file answers for the stems it has before one of the extensions, so each file is asked about and no stem is multiplied
    ends = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(x).alias("ext")) for i, x in enumerate((".ts", ".tsx", ".js", "/index.ts", "/index.js"))])
    fits = F.filter(ends, lambda e: F.col("file").endswith(e["ext"]))
    stems = files.select("file", F.explode(fits).alias("e")).select("file", "e.p", F.expr("substr(file, 1, length(file) - length(e.ext))").alias("stem"))
    hits = asked.join(stems, "stem")
    return hits.groupBy("stem").agg((F.min("p") + 1).cast("long").alias("place"), F.min_by("file", "p").alias("file"))


@query("""SELECT page_id, '/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') AS path FROM pages""")
def http_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.http_path(F.col("url")).alias("path"))


#: Paths with the routes and packages they stand for.
PATHS = ["app/(shop)/cart/[id]", "app/[...slug]", "/a//b/", "", "@scope/pkg/deep", "lodash/fp", "./local", "/abs", "react"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', {p})" for i, (r, p) in enumerate([("/app/cart/:id", "'app'"), ("/app/:slug", "'app'"), ("/a/b", "NULL"), ("/", "''"), ("/@scope/pkg/deep", "'@scope/pkg'"), ("/lodash/fp", "'lodash'"), ("/./local", "NULL"), ("/abs", "NULL"), ("/react", "'react'")])) + ") v(i, route, package)")
def route_and_package_names(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(list(enumerate(PATHS)), "i int, p string")
    return rows.select("i", T.route_path(F.col("p")).alias("route"), T.package_of(F.col("p")).alias("package"))
