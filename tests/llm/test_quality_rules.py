import re
from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import queries
from graphloom.llm.quality_rules import BASE, first_rule, judge_quality, learn_rules, text_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, tricky):
    got = sorted(tuple(r[c] for c in BASE) for r in text_statistics(tricky).collect())
    assert got == sorted(brute(r["text"]) for r in tricky.collect())


def test_on_the_documents(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, d, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, d, "labels").collect()}
    rows = queries.quality_lists(spark, d).collect()
    right = bad = 0
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            bad += 1
            right += r["kept"] == bool(labels[r["doc_id"]])
    assert len(rows) == 1000 and right / bad > 0.95


def test_without_labels(spark, tricky):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = judge_quality(tricky, labels).collect()
    assert len(rows) == tricky.count() and all(r["kept"] != r["base_failed"] for r in rows)
    assert judge_quality(tricky.limit(0), labels).count() == 0


def test_learns_a_planted_rule(spark):
    rows = spark.range(900).select(
        "id",
        F.lit(100).cast("long").alias("n_words"),
        F.lit(500).cast("long").alias("word_chars"),
        (F.col("id") % 30).alias("n_symbols"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_dup_lines", "n_repeat_words", "n_marks")],
        F.lit(9).cast("long").alias("n_lines"),
        F.lit(80).cast("long").alias("n_distinct"),
        (F.col("id") % 7).alias("n_capitals"),
        (F.col("id") % 30 >= 24).cast("int").alias("bad"),
    )
    rules = learn_rules(rows)
    assert len(rules) == 1 and rules[0][0].statistic == "symbols_per_word" and rules[0][0].above
    got = rows.withColumn("r", first_rule(rules)).filter("(r is not null) != (bad = 1)").count()
    assert got == 0
