"""Bounded traversal by frontier joins, closures and searches over the induced neighbourhood."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.symbols import flag
from graphloom.sources.durable import cut


def expand(edges: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = True) -> DataFrame:
    """(id, depth): everything within ``depth`` hops of the seeds, each at its least depth.

    Each hop's frontier is checkpointed: later hops read it, and what was seen, instead of doing all earlier joins again.
    """
    steps = edges.select("from_id", "to_id")
    if both_ways:
        steps = steps.unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(steps, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def two_hop_calls(calls: DataFrame, cap: int | None = None) -> DataFrame:
    """Transitive calls (from_id, via_id, to_id, confidence): both hops exist, the ends differ, direct pairs once.

    For each (from, to) the first middle by id stands; confidence is high if both hops are. ``cap`` keeps the first rows.
    """
    once = calls.groupBy("from_id", "to_id").agg(F.max(F.col("confidence") == "high").alias("high"))
    a = once.select("from_id", F.col("to_id").alias("via_id"), F.col("high").alias("h1"))
    b = once.select(F.col("from_id").alias("via_id"), "to_id", F.col("high").alias("h2"))
    pairs = a.join(b, "via_id").filter("from_id <> to_id").join(once.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    out = pairs.groupBy("from_id", "to_id").agg(F.min(F.struct("via_id", (F.col("h1") & F.col("h2")).alias("high"))).alias("m"))
    out = out.select("from_id", "m.via_id", "to_id", F.when(F.col("m.high"), "high").otherwise("medium").alias("confidence"))
    return out if cap is None else out.orderBy("from_id", "to_id").limit(cap)


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Simple paths of 1 to ``depth`` edges from the starts: (start, id, hops, path, score). Edges have ``weight``."""
    now = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"), F.lit(0).cast("long").alias("score"))
    out = None
    for hop in range(1, depth + 1):
        step = edges.select(F.col("from_id"), F.col("to_id"), F.col("weight"))
        now = now.join(step, F.col("id") == F.col("from_id")).filter(~F.array_contains("path", F.col("to_id")))
        now = now.select("start", F.col("to_id").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("to_id")).alias("path"), (F.col("score") + F.col("weight") - hop).alias("score"))
        out = now if out is None else out.unionByName(now)
    return out


def best_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """For each (start, goal) the best simple path within ``depth``: score, then fewer hops, then ids."""
    found = paths(edges, pairs.select(F.col("start").alias("id")).distinct(), depth)
    hits = found.join(pairs, (found["start"] == pairs["start"]) & (found["id"] == pairs["goal"])).select(found["start"], "goal", "hops", "score", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
    w = Window.partitionBy("start", "goal").orderBy(F.col("score").desc(), "hops", "path")
    return hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


#: What the kind of an edge, its evidence and its confidence are worth on a path.
KIND_SCORE = {"CALLS": 40, "TESTS": 40, "IMPORTS": 30, "EXPORTS": 30, "REFERENCES": 30, "DEFINES": 10, "HAS_CHUNK": 10, "MENTIONS": 1}
OTHER_KIND = 5


def evidence_of() -> Column:
    """Evidence and origin of an edge, sorted."""
    none = F.array().cast("array<string>")
    origin = F.when(F.coalesce("origin", F.lit("")) != "", F.array("origin")).otherwise(none)
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("evidence", none), origin), lambda e: e != "")))


def evidence_fits(require: bool | dict[str, list[str]] | None) -> Column:
    """Whether an edge has the evidence asked for: any at all (True), one of ``any_of``, each of ``all_of``."""
    if not require:
        return F.lit(True)
    have = evidence_of()
    if require is True:
        return F.size(have) > 0
    if "any_of" in require:
        return F.arrays_overlap(have, F.array(*[F.lit(e) for e in require["any_of"]])) if require["any_of"] else F.lit(False)
    return F.size(F.array_except(F.array(*[F.lit(e) for e in require["all_of"]]).cast("array<string>"), have)) == 0


def edge_score(incoming: bool = False) -> Column:
    have = evidence_of()
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_SCORE.items() for x in pair])[F.col("kind")], F.lit(OTHER_KIND))
    told = flag(F.array_contains(have, "compiler"), 40) + flag(F.array_contains(have, "module-resolution"), 25) + flag(F.exists(have, lambda e: e.endswith("syntax")), 10)
    sure = F.when(F.col("confidence") == "high", 20).when(F.col("confidence") == "medium", 10).when(F.col("confidence") == "fallback", 2).otherwise(0)
    return (kind + told + sure - (5 if incoming else 0)).cast("long")


def steps_of(edges: DataFrame, direction: str = "outgoing", kinds: list[str] | None = None, require: bool | dict[str, list[str]] | None = None) -> DataFrame:
    """Edges to walk (from_id, to_id, weight) in a direction: outgoing, incoming or either; of some kinds and evidence."""
    rows = edges.filter(evidence_fits(require)) if kinds is None else edges.filter(F.col("kind").isin(*kinds)).filter(evidence_fits(require))
    parts = []
    if direction in ("outgoing", "either"):
        parts.append(rows.select("from_id", "to_id", edge_score().alias("weight")))
    if direction in ("incoming", "either"):
        parts.append(rows.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), edge_score(True).alias("weight")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _search(start, goals: set, forbidden: set, out: dict, depth: int, most_steps: int) -> tuple | None:
    """The best path as (negative score, hops, nodes): by score, then fewer hops, then ids. A node is entered again only
    nearer to the start; goals are noted and not expanded; paths at full depth don't count as steps."""
    queue, entered, best, steps = [(0, 0, (start,))], dict.fromkeys(forbidden, 0) | {start: 0}, None, 0
    while queue and steps < most_steps:
        score, hops, path = heapq.heappop(queue)
        if hops >= depth:
            continue
        steps += 1
        for b, w in out.get(path[-1], ()):
            if entered.get(b, depth + 1) <= hops + 1:
                continue
            new = (score - w + hops + 1, hops + 1, (*path, b))
            if b in goals:
                best = new if best is None or new < best else best
                continue
            entered[b] = hops + 1
            heapq.heappush(queue, new)
    return best


def _search_each(start, goals: list, out: dict, depth: int, most_steps: int) -> list[tuple]:
    """(goal, best path) as ``_search`` finds for each goal alone, mostly from one search.

    A search for a goal differs from one without only in that no path goes on from the goal. Where all ways to each node
    lead through a goal, or none, leaving those through it out changes nothing for the others. Goals for which this
    doesn't hold, and all goals where the steps run out, get a search of their own.
    """
    ways, apart = {}, set(goals)
    if len(goals) > 2:
        queue, entered, steps = [(0, 0, (start,))], {start: 0}, 0
        while queue and steps < most_steps:
            score, hops, path = heapq.heappop(queue)
            if hops >= depth:
                continue
            steps += 1
            for b, w in out.get(path[-1], ()):
                if b in path:
                    continue
                new = (score - w + hops + 1, hops + 1, (*path, b))
                ways.setdefault(b, []).append(new)
                if entered.get(b, depth + 1) > hops + 1:
                    entered[b] = hops + 1
                    heapq.heappush(queue, new)
        if not queue:
            through = [[set(new[2][1:-1]) for new in found] for found in ways.values() if len(found) > 1]
            apart &= set().union(*(set.union(*t) - set.intersection(*t) for t in through))
    rows = []
    for goal in goals:
        best = _search(start, {goal}, set(), out, depth, most_steps) if goal in apart else min(ways.get(goal, ()), default=None)
        if best and goal != start:
            rows.append((goal, best))
    return rows


def _reach(edges: DataFrame, starts: DataFrame, depth: int, closed: DataFrame | None) -> DataFrame:
    """(start, from_id, to_id, weight): the edges each start can walk within ``depth``, not on from closed nodes.

    Of edges between the same nodes the weightiest stands, so what a front meets needs no grouping.
    """
    once = edges.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"))
    reach = None
    front = starts.select("start", F.col("start").alias("at")).distinct()
    seen = front
    for hop in range(1, depth + 1):
        step = front.join(once, F.col("at") == F.col("from_id")).select("start", "from_id", "to_id", "weight")
        reach = step if reach is None else reach.unionByName(step)
        if hop == depth:
            break
        found = step.select("start", F.col("to_id").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        if closed is not None:
            found = found.join(closed.select(F.col("id").alias("at")), "at", "left_anti").select("start", "at")
        front = cut(found)
        seen = seen.unionByName(front)
    return reach


def _out(near: Iterable[tuple]) -> dict:
    out: dict = {}
    for a, b, w in sorted(near, key=lambda e: (-e[2], e[1])):
        out.setdefault(a, []).append((b, w))
    return out


def best_first(edges: DataFrame, pairs: DataFrame, depth: int, most_steps: int = 5000, closed: DataFrame | None = None) -> DataFrame:
    """Best-first search for each (start, goal) over edges (from_id, to_id, weight), up to ``most_steps`` expansions.

    Without a column ``goal``, each node a start can reach within ``depth`` is its goal. The frontier loop collects, for
    each start, only edges it can reach within ``depth``; their rows come sorted by start and the ordered search runs on
    one start's neighbourhood at a time, for all of its goals. Closed nodes (id) can be a start or goal only.
    """
    kind, every = dict(pairs.dtypes)["start"], "goal" not in pairs.columns
    rows = _reach(edges, pairs, depth, closed).withColumn("weight", F.col("weight").cast("long"))
    if not every:
        rows = rows.unionByName(pairs.select("start", F.lit(None).cast(kind).alias("from_id"), F.col("goal").alias("to_id"), F.lit(None).cast("long").alias("weight")))
    names = ("start", "goal", "hops", "score", "path")

    def answers(start, near: list, goals: dict) -> list[tuple]:
        asked = dict.fromkeys(b for _, b, _ in near) if every else goals
        return [(start, goal, best[1], -best[0], ">".join(map(str, best[2]))) for goal, best in _search_each(start, list(asked), _out(near), depth, most_steps)]

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, goals, schema = None, [], {}, None
        table = lambda found: pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((schema.field("start").type, schema.field("to_id").type, pa.int64(), pa.int64(), pa.string()))], names)
        for batch in batches:
            schema, found = batch.schema, []
            for start, a, b, w in zip(*(batch.column(c).to_pylist() for c in ("start", "from_id", "to_id", "weight"))):
                if start != at:
                    found += answers(at, near, goals)
                    at, near, goals = start, [], {}
                if a is None:
                    goals[b] = None
                else:
                    near.append((a, b, w))
            yield table(found)
        if schema is not None:
            yield table(answers(at, near, goals))

    return rows.repartition("start").sortWithinPartitions("start").mapInArrow(search_all, f"start {kind}, goal {kind}, hops long, score long, path string")


def ordered_paths(edges: DataFrame, sequences: DataFrame, depth: int, most_steps: int = 5000, closed: DataFrame | None = None) -> DataFrame:
    """For each sequence of groups of nodes (seq, place from 0, id) the first way through them in order: (seq, hops,
    score, path array of strings).

    From each node of the first group, in the order of ids, the best path to any node of the next group, from there to
    the one after, each of up to ``depth`` edges and without the nodes already passed. The first start that gets
    through stands. Groups are asked for by name, so a sequence has few of them.
    """
    text = sequences.select("seq", "place", F.col("id").cast("string").alias("id"))
    steps = edges.select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "weight")
    last = text.groupBy("seq").agg(F.max("place").alias("last"))
    groups = last.agg(F.max("last")).first()[0]
    state = text.filter("place = 0").select("seq", F.col("id").alias("first"), F.array("id").alias("path"), F.lit(0).cast("long").alias("score"))
    done = None

    def search_all(asks: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out, found = _out(zip(near["from_id"], near["to_id"], near["weight"])), []
        for seq, first, path, score, goals in zip(*(asks[c] for c in ("seq", "first", "path", "score", "goals"))):
            best = _search(path[-1], set(goals), set(path[:-1]), out, depth, most_steps)
            if best is not None:
                found.append((seq, first, [*path, *best[2][1:]], score - best[0]))
        return pd.DataFrame({c: pd.Series([r[i] for r in found], dtype=object) for i, c in enumerate(("seq", "first", "path", "score"))})

    kind = dict(text.dtypes)["seq"]
    for place in range(groups + 1):
        through = state.join(last.filter(F.col("last") == place), "seq").drop("last")
        done = through if done is None else done.unionByName(through)
        if place == groups:
            break
        goals = text.filter(F.col("place") == place + 1).groupBy("seq").agg(F.collect_list("id").alias("goals"))
        asks = state.join(goals, "seq").withColumn("at", F.element_at("path", -1))
        reach = _reach(steps, asks.select(F.col("at").alias("start")).distinct(), depth, closed)
        state = cut(asks.groupBy("at").cogroup(reach.groupBy("start")).applyInPandas(search_all, f"seq {kind}, first string, path array<string>, score long"))
    best = done.groupBy("seq").agg(F.min(F.struct("first", "path", "score")).alias("b"))
    return best.select("seq", (F.size("b.path") - 1).cast("long").alias("hops"), "b.score", "b.path")


def indirect_coverage(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, id, hops): what tests reach within ``hops`` over any edge, on a way with at least one call."""
    now = starts.select(F.col("id").alias("start"), "id", F.lit(False).alias("called"))
    out = None
    for hop in range(1, hops + 1):
        now = now.join(edges, F.col("id") == F.col("from_id")).select("start", F.col("to_id").alias("id"), (F.col("called") | (F.col("kind") == "CALLS")).alias("called")).filter("start <> id").groupBy("start", "id").agg(F.max("called").alias("called"))
        hit = now.filter("called").select("start", "id", F.lit(hop).alias("hops"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("start", "id").agg(F.min("hops").alias("hops"))


def chains(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """(origin, last, depth): where the star exports (f, target) of each module (f) lead and how many modules are seen.

    A module has one target at most. A chain ends at a module without one or before a module already seen; ``last`` is
    null in the second case. Pointers are doubled, only those of chains still under way, until a round ends no chain or
    changes nothing more, so no length is a bound and rounds grow with the logarithm of the longest chain or circle.
    """
    every = modules.select("f").unionByName(exports.select(F.col("target").alias("f"))).distinct()
    first = cut(every.join(exports.select("f", "target"), "f", "left").select("f", F.col("target").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("f").alias("least")))

    def doubled(now: DataFrame, table: DataFrame) -> DataFrame:
        """Pointers that go on by those of the table; ``moved`` tells where a lower module was met."""
        b = table.select(F.col("f").alias("to"), F.col("to").alias("b_to"), F.col("steps").alias("b_steps"), F.col("least").alias("b_least"))
        return cut(now.join(b, "to").select("f", F.col("b_to").alias("to"), (F.col("steps") + F.col("b_steps")).alias("steps"), F.least("least", "b_least").alias("least"), (F.col("b_least") < F.col("least")).alias("moved")))

    def ended(now: DataFrame, done: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        """(done, still under way, how many): ``done`` (f, last, steps) grows by the pointers that lead to a row of it.

        The chains under way have ends at consecutive distances: a round that ends none leaves those that never end.
        """
        left = -1
        while n and n != left:
            end = done.select(F.col("f").alias("to"), F.col("last"), F.col("steps").alias("more"))
            met = cut(now.join(end, "to", "left").select("f", "to", "steps", "least", "last", "more"))
            over = met.filter("more IS NOT NULL").select("f", "last", (F.col("steps") + F.col("more")).alias("steps"))
            done, left = done.unionByName(over), n
            now = met.filter("more IS NULL").select("f", "to", "steps", "least")
            n = now.count()
            if n and n != left:
                now = doubled(now, met)  # its targets may have ended in this round
        return done, now, n

    ends = first.filter("to IS NULL").select("f", F.col("f").alias("last"), F.lit(0).cast("long").alias("steps"))
    going = first.filter("to IS NOT NULL")
    done, turning, n = ended(going, ends, going.count())
    found = done.select(F.col("f").alias("origin"), "last", (F.col("steps") + 1).alias("depth"))
    if n:
        # what never ends: where two rounds lead to equally many modules, those are the modules of all circles
        turning = whole = cut(going.join(turning.select("f"), "f", "left_semi"))
        images = n
        while (now := whole.select("to").distinct().count()) != images:
            images, whole = now, doubled(whole, whole)
        on = cut(whole.select(F.col("to").alias("f")).distinct())
        # windows of a circle of which none meets a lower module when doubled hold the least of the circle
        circle = turning.join(on, "f", "left_semi")
        while (further := doubled(circle, circle)).filter("moved").count():
            circle = further
        size = circle.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
        size = cut(circle.select("f", "least").join(size, "least").select("f", "size"))
        tails = turning.join(on, "f", "left_anti")
        tails, _, _ = ended(tails, on.select("f", F.col("f").alias("last"), F.lit(0).cast("long").alias("steps")), tails.count())
        circles = tails.join(size.withColumnRenamed("f", "last"), "last").select(F.col("f").alias("origin"), F.lit(None).cast(dict(first.dtypes)["f"]).alias("last"), (F.col("steps") + F.col("size")).alias("depth"))
        found = found.unionByName(circles)
    return found.join(modules.select(F.col("f").alias("origin")), "origin", "left_semi")
