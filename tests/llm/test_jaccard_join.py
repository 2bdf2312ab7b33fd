import random
import re

import numpy as np
import pytest

from graphloom.llm import jaccard_join, queries
from graphloom.llm.components import connected
from graphloom.llm.jaccard_join import Likeness, Region, jaccard_groups


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, num, den, width):
    sets = [shingles(r["text"], width) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        others = {j for g in s for j in index[g] if j > i}
        for j in others:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            k = root(i)
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_on_the_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    want = brute(queries.table(spark, d, "documents").collect(), 90, 100, 3)
    assert got(queries.linked_documents(spark, d)) == want
    assert any(c != i for i, _, c in want)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("pqrstuv") + str(rng.randrange(9))
    return " ".join(words)


@pytest.mark.parametrize("num,width,most", [(80, 5, 8192), (90, 3, 12), (60, 1, 30), (100, 2, 8192)])
def test_clusters_around_the_threshold(spark, num, width, most, monkeypatch):
    rng = random.Random(num)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 40)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 90))] for _ in range(6)]
    texts = [edited(rng, rng.choice(bases), rng.randrange(5)) for _ in range(260)]
    shared = " ".join(f"common{i}" for i in range(40))
    texts += [shared + " " + edited(rng, [f"x{rng.randrange(500)}" for _ in range(12)], 1) for _ in range(160)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(jaccard_groups(df, num, 100, width, most_members=most)) == brute(df.collect(), num, 100, width)


def test_tricky_rows(spark, tricky):
    for width in (3, 5):
        assert got(jaccard_groups(tricky, 80, 100, width)) == brute(tricky.collect(), 80, 100, width)
    assert jaccard_groups(tricky.limit(0)).count() == 0


def test_region_matches_all_pairs():
    rng = np.random.default_rng(4)
    for num in (60, 80, 90):
        like = Likeness(num, 100, 1)
        base = [rng.choice(2000, 60, replace=False) for _ in range(4)]
        arrays = []
        for _ in range(300):
            s = set(base[rng.integers(4)].tolist())
            for _ in range(rng.integers(0, 14)):
                s.discard(int(rng.choice(list(s))))
                s.add(int(rng.integers(2000)))
            arrays.append(np.array(sorted(s), np.uint64))
        region = Region(arrays, np.array([len(a) for a in arrays]), like, True)
        roots = region.roots()
        up = list(range(300))
        find = lambda x: x if up[x] == x else find(up[x])
        for i in range(300):
            for j in range(i):
                both = len(np.intersect1d(arrays[i], arrays[j]))
                if 100 * both >= num * (len(arrays[i]) + len(arrays[j]) - both):
                    up[find(i)] = find(j)
        want = [find(i) for i in range(300)]
        assert len(set(zip(roots.tolist(), want))) == len(set(roots.tolist())) == len(set(want))


@pytest.mark.parametrize("num", [60, 80, 90])
def test_cells_and_windows_do_the_join(num):
    """Clusters, a chain from one to another, and unrelated sets: the cells are taken, and the answer is that of all pairs."""
    rng = np.random.default_rng(num)
    like = Likeness(num, 100, 1)
    arrays = []
    for k in range(14):
        base = rng.choice(5000, 80, replace=False) + 10_000 * k
        for _ in range(30):
            s = set(base.tolist()) - set(rng.choice(base, rng.integers(0, 12), replace=False).tolist())
            arrays.append(np.array(sorted(s | set(rng.integers(300_000, 400_000, rng.integers(0, 8)).tolist())), np.uint64))
    step = np.arange(900_000, 900_200)
    arrays += [step[i : i + 100].astype(np.uint64) for i in range(0, 100, 2)]
    arrays += [np.unique(rng.integers(0, 1 << 40, 60)).astype(np.uint64) for _ in range(200)]
    arrays = [arrays[i] for i in rng.permutation(len(arrays))]
    region = Region(arrays, np.array([len(a) for a in arrays]), like, True)
    roots = region.roots()
    assert num == 60 or region.cells > 10 and region.far > 0
    index, up = {}, list(range(len(arrays)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(arrays):
        shared = {}
        for x in a.tolist():
            for j in index.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            index[x].append(i)
        for j, both in shared.items():
            if 100 * both >= num * (len(a) + len(arrays[j]) - both):
                up[find(i)] = find(j)
    want = [find(i) for i in range(len(arrays))]
    assert len(set(zip(roots.tolist(), want))) == len(set(roots.tolist())) == len(set(want))


def test_regions_larger_than_a_task_should_hold(spark, monkeypatch):
    """A group of near copies, its fringe and unrelated texts with the same opening, parted over tasks."""
    rng = random.Random(9)
    taken = []
    parted = jaccard_join._parted
    monkeypatch.setattr(jaccard_join, "_parted", lambda todo, *rest: taken.append(todo.count()) or parted(todo, *rest))
    monkeypatch.setattr(jaccard_join, "SAMPLE", 30)
    base = [f"b{i}" for i in range(60)]
    texts = [edited(rng, base, rng.randrange(4)) for _ in range(150)]
    texts += [edited(rng, base, rng.randrange(4, 14)) for _ in range(60)]
    texts += [" ".join([f"{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for num, width in ((80, 1), (90, 2)):
        assert got(jaccard_groups(df, num, 100, width, most_members=40)) == brute(df.collect(), num, 100, width)
    assert taken and all(n > 40 for n in taken)


def test_profiles_part_long_unrelated_texts(spark):
    """Of a region of long texts only those go on to sketches that are near another, whatever classes their profiles have."""
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long, edge = some(9000), some(3300)
    texts = [some(9000 + i) for i in range(24)] + [some(3200 + 10 * i) for i in range(12)]
    texts += [long, long[:8700] + some(150), edge, edge[:3200]]
    rows = jaccard_join._read(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), like := Likeness(90, 100, 3))
    sets = rows.select(rows["doc_id"].alias("tid"), "n", "profile")
    kept = jaccard_join._thinned(sets.selectExpr("7L as region", "tid"), sets, like, 1024).collect()
    assert sorted(r["tid"] for r in kept) == [36, 37, 38, 39]
    assert len({len(r["profile"]) for r in sets.filter("tid > 37").collect()}) == 2  # compared across class counts


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7), (None, 3), (300, 301), (301, 300)]
    out = {r["v"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[200] == out[150] == out[100] == 100 and out[301] == 300 and len(out) == 66
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
