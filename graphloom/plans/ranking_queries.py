"""Queries on vectors and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a, query_words, tokens
from graphloom.functions.vectors import hash_embedding, nearest
from graphloom.operators import retrieval
from graphloom.plans.graph_queries import CALLS, CLASSES, CUSTOMERS, FUNCTIONS, SYMBOLS
from graphloom.plans.registry import query
from graphloom.sources.durable import cut
from graphloom.sources.graph_views import Tables, edges, nodes

FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(w) + 1), lambda i: ascii(w[i])::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT"
TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({t}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT DISTINCT unnest({TOKENS.format(t='p_name')}) AS w FROM part) SELECT w AS token, {FNV} AS h FROM w")
def hash_tokens_fnv1a(t: Tables) -> DataFrame:
    return t.part.select(F.explode(tokens(F.col("p_name"))).alias("token")).distinct().select("token", fnv1a(F.col("token")).alias("h"))


@query(f"""WITH w AS (SELECT p_partkey, unnest({TOKENS.format(t="p_name || ' ' || p_brand || ' ' || p_type")}) AS w FROM part), b AS (SELECT p_partkey, ({FNV}) % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2),
l AS (SELECT p_partkey, sqrt(sum(n * n)) AS len FROM b GROUP BY 1) SELECT p_partkey, bucket, round(n / len, 6) AS value FROM b JOIN l USING (p_partkey)""")
def hash_embedding_values(t: Tables) -> DataFrame:
    """Hashed embeddings, as their values other than 0."""
    e = hash_embedding(t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), "p_partkey", "text")
    return e.select("p_partkey", F.posexplode("embedding").alias("bucket", "value")).filter("value <> 0").select("p_partkey", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


def _query_vector(t: Tables):
    first = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in first[0]])


NEAREST = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q)
SELECT vec_id, round(s, 6) AS similarity FROM s {where} ORDER BY round(s, 9) DESC, vec_id LIMIT 10"""


@query(NEAREST.format(where=""))
def cosine_topk(t: Tables) -> DataFrame:
    return nearest(t.embeddings, _query_vector(t), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(NEAREST.format(where="WHERE label % 3 = 1"))
def cosine_topk_filtered(t: Tables) -> DataFrame:
    return nearest(t.embeddings, _query_vector(t), 10, F.col("label") % 3 == 1).select("vec_id", F.round("similarity", 6).alias("similarity"))


#: A question of each intent that the ranking queries ask.
QUESTIONS = {"caller": "where is handle12 called for the red widget orders", "implementation": "implementation source of handle12", "test": "tests for handle12", "imports": "imported handle12 types"}
MODELS = {k: retrieval.query_model(q) for k, q in QUESTIONS.items()}
MODEL = MODELS["caller"]

PACKAGES = "pk AS (SELECT 'function:' || o_orderkey AS id, n_name FROM orders JOIN cust ON o_custkey = c_custkey UNION ALL SELECT 'class:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
KIND_ORDER = "CASE kind WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 5 END"


def _lexical_sql(model: retrieval.QueryModel) -> str:
    """Words are worth 0.04 (three letters) or 0.08, code tokens 0.42 as the name and 0.14 anywhere."""
    terms = [f"CASE WHEN contains(hay, '{w}') THEN {0.04 if len(w) <= 3 else 0.08} ELSE 0 END" for w in model.words]
    terms += [f"CASE WHEN lower(name) = '{c.lower()}' THEN 0.42 WHEN contains(hay, '{c.lower()}') THEN 0.14 ELSE 0 END" for c in model.code_tokens]
    return f"""{SYMBOLS}, {PACKAGES}, hays AS (SELECT s.*, lower(concat_ws(' ', file, name, kind, n_name, kind, qualified_name)) AS hay FROM symbols s LEFT JOIN pk ON pk.id = s.id),
lexical AS (SELECT *, round(({" + ".join(terms)})::DOUBLE, 6) AS lexical FROM hays), lex AS (SELECT *, row_number() OVER (ORDER BY lexical DESC, {KIND_ORDER}, coalesce(file, ''), id) AS place FROM lexical WHERE lexical > 0)"""


def _nodes(t: Tables) -> DataFrame:
    return nodes(t, "Function", "Class", "TypeAlias")


@query(f"WITH {_lexical_sql(MODEL)} SELECT id, lexical AS score FROM lex WHERE place <= 120")
def lexical_score_top(t: Tables) -> DataFrame:
    return retrieval.best_lexical(retrieval.lexical(_nodes(t), MODEL)).select("id", F.col("lexical").alias("score"))


def _sources_sql(model: retrieval.QueryModel) -> str:
    """Candidates: the best by words, the first functions of the name, and what those call; for tests the best tests too."""
    tests = " UNION ALL SELECT id, 'test', row_number() OVER (ORDER BY place) FROM (SELECT * FROM lex WHERE file_kind = 'test' ORDER BY place LIMIT 50)" if model.intent == "test" else ""
    return f"""{_lexical_sql(model)}, {CALLS}, named AS (SELECT id FROM symbols WHERE lower(name) = 'handle12' ORDER BY id LIMIT 8),
called AS (SELECT to_id AS id, bool_or(by_compiler) AS by_compiler, bool_or(by_module) AS by_module FROM calls WHERE from_id IN (SELECT id FROM named) GROUP BY to_id ORDER BY to_id LIMIT 60),
c AS (SELECT id, 'lexical' AS source, place AS rank FROM lex WHERE place <= 120 UNION ALL SELECT id, 'symbol', row_number() OVER (ORDER BY id) FROM named UNION ALL SELECT id, 'graph', row_number() OVER (ORDER BY id) FROM called{tests}),
f AS (SELECT id, 18 * sum(CASE source WHEN 'lexical' THEN 1.5::DOUBLE WHEN 'symbol' THEN 2::DOUBLE WHEN 'test' THEN 1.4::DOUBLE ELSE 1.5::DOUBLE END / (60 + rank)) AS fusion, string_agg(source || '=' || rank, ',' ORDER BY source || '=' || rank) AS sources FROM c GROUP BY id)"""


def _candidates(t: Tables, model: retrieval.QueryModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, relations, the best lexical rows)."""
    n = _nodes(t)
    lex = retrieval.lexical(n, model)
    best = retrieval.best_lexical(lex)
    named = cut(retrieval.top(n.filter("lower(name) = 'handle12'"), [], 8, "symbol"))
    calls = cut(edges(t, "CALLS", of=named.select(F.col("id").alias("from_id"))))
    called = retrieval.top(calls.select(F.col("to_id").alias("id")).distinct(), [], 60, "graph")
    met = calls.select(F.col("to_id").alias("id"), F.col("kind").alias("edge_kind"), "evidence", F.lit(True).alias("direct")).join(called.select("id"), "id", "left_semi")
    out = retrieval.top_lexical(best).unionByName(named).unionByName(called)
    if model.intent == "test":
        for part in retrieval.test_candidates(lex, n):
            out = out.unionByName(part)
    return out, met, best


@query(f"WITH {_sources_sql(MODEL)} SELECT id, round(fusion, 6) AS fusion, sources FROM f")
def rrf_fusion(t: Tables) -> DataFrame:
    return retrieval.fused(_candidates(t, MODEL)[0]).select("id", F.round("fusion", 6).alias("fusion"), "sources")


def _scored_sql(model: retrieval.QueryModel) -> str:
    """Boosts and demotions of the rules that these questions can meet over these nodes, intent by intent."""
    exact = f"lower(name) IN ({', '.join(repr(x.lower()) for x in model.symbol_tokens)})"
    test, source, calls = "coalesce(file_kind = 'test', FALSE)", "coalesce(file_kind = 'source', FALSE)", "g.id IS NOT NULL"
    boosts = [(exact, 1.1), (f"{calls} AND g.by_compiler", 0.25), (f"{calls} AND g.by_module", 0.22), (calls, 0.22)]
    demotions = [("regexp_matches(lower(name), '(schema|params|input)$')", 0.18)]
    if model.intent == "implementation":
        boosts += [(source, 0.7), ("kind IN ('Function', 'Class')", 0.28)]
        demotions += [(test, 0.72), (test, 0.62)]
    if model.intent == "caller":
        boosts += [(calls, 0.55), (f"{calls} AND kind = 'Function'", 0.55), (f"{calls} AND kind = 'Class'", 0.3)]
        demotions += [(test, 0.62), (test, 0.28), (exact, 2.2)]
    if model.intent == "imports":
        demotions += [(test, 0.62), (exact, 1.1)]
    if model.intent == "test":
        boosts += [(test, 0.68)]
        demotions += [(source, 0.22)]
    add = lambda rules: " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in rules)
    words = [w for w in model.words if len(w) >= 4 and w not in ("then", "from", "with", "into", "this", "that")]
    hits = " + ".join(f"CASE WHEN contains(lower(coalesce(file, '')), '{w}') OR contains(lower(name), '{w}') THEN 1 ELSE 0 END" for w in words)
    cover = "CASE WHEN n_words >= 2 THEN least(n_words * 0.14::DOUBLE, 0.84) ELSE 0 END + CASE WHEN n_words >= 3 AND kind IN ('Function', 'Class') THEN 0.28::DOUBLE ELSE 0 END" if len(words) >= 2 else "0"
    return f"""{_sources_sql(model)}, j AS (SELECT f.id, fusion, sources, s.kind, s.file, s.name, coalesce(l.lexical, 0) AS by_words, {exact} OR {calls} AS allows, {add(boosts)} AS boosts, {add(demotions)} AS demotion, {hits or '0'} AS n_words
  FROM f JOIN symbols s ON f.id = s.id LEFT JOIN called g ON g.id = f.id LEFT JOIN (SELECT id, lexical FROM lex WHERE place <= 120) l ON l.id = f.id),
s AS (SELECT *, round(boosts + {cover} + least(by_words, 0.6), 6) AS boost FROM j), r AS (SELECT *, round(fusion + boost - round(demotion, 6), 6) AS score FROM s)"""


def _ranked_sql(model: retrieval.QueryModel, limit: int = 20) -> str:
    order = f"score DESC, {KIND_ORDER}, coalesce(file, ''), coalesce(name, ''), id"
    if model.intent in ("caller", "imports"):
        kept = "SELECT * FROM n WHERE n <= 4"
    else:
        kept = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, n > 1 AND allows ORDER BY n) AS m FROM n) WHERE n = 1 OR (n > 1 AND allows AND m = 1)"
    return f"WITH {_scored_sql(model)}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {order}) AS n FROM r), k AS ({kept}) SELECT id, score, greatest(0, least(0.99, round(score / 4, 6))) AS normal, sources FROM k ORDER BY {order} LIMIT {limit}"


def _ranked(t: Tables, intent: str, limit: int = 20) -> DataFrame:
    model = MODELS[intent]
    candidates, met, lex = _candidates(t, model)
    rows = retrieval.hybrid(_nodes(t), candidates, model, limit, met, lex)
    return rows.select("id", "score", retrieval.normalized(F.col("score")).alias("normal"), "sources")


@query(f"WITH {_scored_sql(MODELS['imports'])} SELECT id, boost, round(demotion, 6) AS demotion, score FROM r")
def boost_demote_score(t: Tables) -> DataFrame:
    model = MODELS["imports"]
    candidates, met, lex = _candidates(t, model)
    return retrieval.scored(_nodes(t), candidates, model, met, lex).select("id", "boost", "demotion", "score")


@query(_ranked_sql(MODELS["caller"]))
def hybrid_topk(t: Tables) -> DataFrame:
    return _ranked(t, "caller")


@query(_ranked_sql(MODELS["implementation"]))
def hybrid_implementation(t: Tables) -> DataFrame:
    return _ranked(t, "implementation")


@query(_ranked_sql(MODELS["test"]))
def hybrid_tests(t: Tables) -> DataFrame:
    return _ranked(t, "test")


@query(_ranked_sql(MODELS["imports"]))
def hybrid_imports(t: Tables) -> DataFrame:
    return _ranked(t, "imports")


#: Questions with an intent each.
ASKED = ["where is foo called", "route handler wired api", "test suite for cart", "implementation not test source", "imports of the module", "callee list", "callers", "source of truth", "blue green", "auth middleware flow", ""]


def _intent_sql() -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
    cases = " ".join("WHEN " + " AND ".join(f"list_has_any(w, {list(g)!r})" for g in groups) + f" THEN '{name}'" for name, groups in retrieval.INTENTS)
    return f"""WITH q(i, q) AS (VALUES {rows}), w AS (SELECT i, list_filter(regexp_extract_all(lower(q), '[a-z_$][a-z0-9_$]*'), lambda x: length(x) > 2) AS w FROM q)
SELECT i, CASE {cases} ELSE 'broad' END AS intent FROM w"""


@query(_intent_sql())
def intent_detect(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame(list(enumerate(ASKED)), "i int, q string")
    return asked.select("i", retrieval.intent_column(query_words(F.col("q"))).alias("intent"))


@query(f"WITH {CUSTOMERS}, {FUNCTIONS}, {CLASSES} SELECT file, count(*) AS n FROM (SELECT file FROM functions WHERE file_kind = 'test' UNION ALL SELECT file FROM classes WHERE contains(lower(name), '7')) GROUP BY file ORDER BY n DESC, file LIMIT 50")
def test_intent_files(t: Tables) -> DataFrame:
    """Candidates of a test-minded query: files by how many of their symbols are tests or match."""
    n = nodes(t, "Function").filter("file_kind = 'test'").unionByName(nodes(t, "Class").filter("contains(lower(name), '7')"))
    return n.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file").limit(50)
