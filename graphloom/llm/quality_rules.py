"""Quality rules: decision lists learned by sequential covering, as ordered Spark conditional expressions.

Statistics of each text, the learning and the verdict are DataFrame operations only. A rule is a conjunction of
thresholds on statistics. Growing adds the threshold with the best information gain on two thirds of the labelled rows,
pruning drops thresholds from the end while that helps on the last third; rows a rule covers leave, and the next rule
is learned on the rest, until no rule is precise enough. One aggregate counts all thresholds of a growing step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import WORD, discard, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the rules may use, all of them shares or means but the first.
STATISTICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word": lambda: F.col("word_chars") / F.col("n_words"),
    "symbols_per_word": lambda: F.col("n_symbols") / F.col("n_words"),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.col("n_lines"),
    "repeat_share": lambda: F.col("n_repeat_words") / F.col("n_words"),
    "distinct_share": lambda: F.col("n_distinct") / F.col("n_words"),
    "capital_share": lambda: F.col("n_capitals") / F.col("word_chars"),
    "marks_per_word": lambda: F.col("n_marks") / F.col("n_words"),
}


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the five base counts, and n_lines, n_distinct, n_capitals and n_marks for the rules.

    A null text counts as empty: all 0. Whole texts are read, however long. Repeated rows stay, other columns are not
    read, an empty table gives an empty one.
    """
    text = F.col("_t")
    t = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("_t"))
    t = t.select("id", "_t", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - 7), lambda i: F.xxhash64(F.slice("_w", i, F.lit(8))))
    t = t.select(
        "id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(text, "[^!?|]+", "")).cast("long").alias("n_marks"),
        F.when(F.size("_w") >= 8, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))))
    t = t.select("id", *BASE[:4], "n_lines", "n_distinct", "n_capitals", "n_marks", ordered.alias("_o"))

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("_o", k - 1)["h"], F.get("_o", k + 1)["h"]
        return F.when(F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False)), x["i"])

    starts = F.sort_array(F.filter(F.transform("_o", twice), lambda x: x.isNotNull()))
    t = t.withColumn("_p", starts).drop("_o")
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).cast("long").alias("last"))
    covered = F.aggregate("_p", nothing, lambda a, p: F.struct((a["n"] + F.least(F.lit(8).cast("long"), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select(F.col("id").alias(id_col), *BASE, "n_lines", "n_distinct", "n_capitals", "n_marks")


@dataclass(frozen=True)
class Threshold:
    """``statistic >= value`` (above) or ``statistic < value``."""

    statistic: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.value:.6g}"

    def column(self) -> Column:
        x = F.coalesce(STATISTICS[self.statistic](), F.lit(0.0))
        return x >= self.value if self.above else x < self.value


Rule = tuple[Threshold, ...]


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (t.column() for t in rule))


def first_rule(rules: list[Rule]) -> Column:
    """The ordered conditional: number of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(rule_column(rule), F.lit(i)).otherwise(out)
    return out


def learn_rules(labelled: DataFrame, label: str = "bad", max_rules: int = 8, max_terms: int = 3, bins: int = 24, precision: float = 0.9, least_share: float = 0.003) -> list[Rule]:
    """An ordered list of rules for rows whose 0/1 ``label`` is 1; empty if there are none of either kind.

    Counts in the base columns and n_lines, n_distinct, n_capitals and n_marks must be there. Null labels are left out.
    What comes to the driver is a table of (statistic, bin) counts at each step, whatever the number of rows.
    """
    names = list(STATISTICS)
    values = {n: F.coalesce(STATISTICS[n](), F.lit(0.0)) for n in names}
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), (F.pmod(F.xxhash64(labelled.columns[0], F.lit(3)), F.lit(3)) == 0).alias("prune"), *[values[n].alias(n) for n in names])
    marks = [i / bins for i in range(1, bins)] + [0.005, 0.995]
    seen = rows.agg(F.count("y").alias("n"), F.sum("y").alias("pos"), *[F.percentile_approx(n, marks, 10_000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("y") == 1, F.col(n)), marks, 10_000).alias(f"{n}_1") for n in names]).first()
    if not seen["n"] or not seen["pos"] or seen["pos"] == seen["n"]:
        return []
    cuts = {n: sorted(set(seen[n] or []) | set(seen[f"{n}_1"] or [])) for n in names}
    number = lambda n: reduce(lambda a, b: a + b, [(F.col(n) >= c).cast("int") for c in cuts[n]])
    table = written(rows.select("y", "prune", F.array(*[number(n) for n in names]).alias("bin")), "quality-train")
    try:
        return _cover(table, names, cuts, max_rules, max_terms, precision, max(5, least_share * seen["n"]))
    finally:
        discard(table)


def _holds(term: tuple[int, bool, int]) -> Column:
    statistic, above, cut = term
    at = F.get("bin", F.lit(statistic))
    return at > cut if above else at <= cut  # bin k: k cuts are at or below the value


def _all(terms) -> Column:
    return reduce(lambda a, b: a & b, map(_holds, terms), F.lit(True))


def _cover(table: DataFrame, names: list[str], cuts: dict, max_rules: int, max_terms: int, precision: float, least: float) -> list[Rule]:
    found: list[list[tuple[int, bool, int]]] = []
    while len(found) < max_rules:
        rest = table.filter(~reduce(lambda a, b: a | b, map(_all, found), F.lit(False)))
        grown: list[tuple[int, bool, int]] = []
        while len(grown) < max_terms:
            term = _best(rest.filter(~F.col("prune") & _all(grown)), names, cuts, least)
            if term is None:
                break
            grown.append(term)
        if not grown:
            break
        sums = []
        for k in range(1, len(grown) + 1):
            sums += [F.sum(F.when(_all(grown[:k]), F.col("y"))).alias(f"p{k}"), F.sum(F.when(_all(grown[:k]), 1 - F.col("y"))).alias(f"n{k}")]
        got = rest.filter("prune").agg(*sums).first()
        worth = [((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"n{k}"] or 0)) for k in range(1, len(grown) + 1)]
        best = max(range(len(worth)), key=lambda k: (worth[k], -k))
        p, n = got[f"p{best + 1}"] or 0, got[f"n{best + 1}"] or 0
        if p < 2 or p < precision * (p + n):
            break
        found.append(grown[: best + 1])
    return [tuple(Threshold(names[s], above, cuts[names[s]][c]) for s, above, c in terms) for terms in found]


def _best(rows: DataFrame, names: list[str], cuts: dict, least: float) -> tuple[int, bool, int] | None:
    """The threshold with the highest information gain on rows; none if the rows are all of one kind or nothing gains."""
    counts = rows.select("y", F.posexplode("bin").alias("s", "b")).groupBy("s", "b").agg(F.sum("y").alias("p"), F.count("y").alias("t")).collect()
    p: dict[int, list[int]] = {s: [0] * (len(cuts[n]) + 1) for s, n in enumerate(names)}
    t = {s: list(x) for s, x in p.items()}
    for r in counts:
        p[r["s"]][r["b"]], t[r["s"]][r["b"]] = r["p"], r["t"]
    pos, all_ = sum(p[0]), sum(t[0])
    if not pos or pos == all_:
        return None
    base, best = math.log2(pos / all_), (1e-9, None)
    for s, name in enumerate(names):
        below_p = below_t = 0
        for cut in range(len(cuts[name])):
            below_p, below_t = below_p + p[s][cut], below_t + t[s][cut]
            for above, a, b in ((False, below_p, below_t), (True, pos - below_p, all_ - below_t)):
                if a >= least / 3 and b < all_:
                    gain = a * (math.log2(a / b) - base)
                    if gain > best[0]:
                        best = (gain, (s, above, cut))
    return best[1]


def judge_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 200_000, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Per row: doc_id, the five base counts, base_failed, rule (number of the learned rule that rejects it) and kept.

    The list is learned from labelled rows that pass the base rules, at most about ``max_rows`` of them by hash of id;
    an id with several labels counts by the lowest. Without usable labels no rule rejects. Documents with a null id have
    no label and are judged like the others.
    """
    stats = written(text_statistics(documents), "quality-stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((1 - F.least(F.min("quality"), F.lit(1))).alias("bad"))
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rules = learn_rules(stats.filter(~failed).join(known, "doc_id"))
    judged = stats.withColumn("base_failed", failed)
    judged = judged.withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    out = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *BASE, "base_failed", "kept", "rule")
    out._graphloom_rules = [" and ".join(map(str, r)) for r in rules]
    return out
