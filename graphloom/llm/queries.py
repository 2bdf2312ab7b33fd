"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import best_fit_packing, chat_format, jaccard_join, media_columns, mixing, quality_rules, substring_dedup, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_digests(media_columns.text_media(table(spark, sf_dir, "documents")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), num=90, den=100, width=3)


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=35)


def quality_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.training_rows(documents, labels))
    scored = toxicity.score_documents(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The rules of the URL query.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


#: What is blocked where no rule says otherwise. Hosts have a dot in front, so ``*.x`` fits a label's start.
URL_GLOBS = [
    *(url_filter.Glob(f"*.{name}*") for name in ("spam-", "cheap-", "casino", "adserv", "doubleclick", "torrent", "warez", "phish", "malware", "porn", "viagra", "payday")),
    *(url_filter.Glob("*", path) for path in ("*/ads/*", "*/banner*", "*/popup*", "*/login*", "*/cart/*", "*/wp-admin/*", "*/cgi-bin/*", "*/session?/*", "*.exe", "*.zip", "*.apk", "*/feed/*.xml")),
    url_filter.Glob("*.xn--*.top"),
    url_filter.Glob("*.m.*", "*/print/*"),
]


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS, default="allow")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.conversation_digests(chat_format.format_conversations(rows))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": text_images,
        "op2_mixing": mixing_targets,
        "op3_token_counts": piece_counts,
        "op4_jaccard_join": linked_documents,
        "op5_substring_dedup": repeated_passages,
        "op6_quality_rules": quality_lists,
        "op7_toxicity": toxicity_scores,
        "op8_url_filter": url_verdicts,
        "op9_chat_format": chat_turns,
        "op10_best_fit_packing": packed_sequences,
    }


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_sql() -> str:
    ranked = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ranked)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)
    like = lambda glob: glob.replace("_", "\\_").replace("*", "%").replace("?", "_")
    bad = " OR ".join(f"'.' || host LIKE '{like(g.host)}' ESCAPE '\\' AND path LIKE '{like(g.path)}' ESCAPE '\\'" for g in URL_GLOBS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM p"""


_CHAT_SQL = """
WITH c AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '(\\\\|<\\|im_start\\|>|<\\|im_end\\|>|</?s>|\\[/?INST\\])', '.\\1', 'g') AS longer FROM c),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(longer) + length(regexp_replace(role, '(\\\\|<\\|im_start\\|>|<\\|im_end\\|>|</?s>|\\[/?INST\\]|\\n)', '.\\1', 'g')) + 24)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""


_LINKED_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM w),
r(v, c) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.v = w.doc_id GROUP BY w.doc_id, n.n"""


_REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS run FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": _LINKED_SQL, "op5_substring_dedup": _REPEATS_SQL, "op8_url_filter": _url_sql(), "op9_chat_format": _CHAT_SQL}
