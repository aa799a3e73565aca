import random

import numpy as np
import pytest

from codeloom.operators import graphalg, reach
from codeloom.plans.queries import QUERIES
from tests.test_graphalg import bfs, brute_betweenness, graph, random_graph


def sums_of_all(pairs, n, sources):
    """(reached by, sum of distances, through) by one search per entity."""
    met, far, owed = np.zeros(n), np.zeros(n), np.zeros(n)
    from_ = {s: bfs(pairs, s) for s in range(n)}
    for s in sources:
        d, c = from_[s]
        for t in set(d) - {s}:
            met[t] += 1
            far[t] += d[t]
            for v in set(d) - {s, t}:
                dv, cv = from_[v]
                if t in dv and d[v] + dv[t] == d[t]:
                    owed[v] += c[v] * cv[t] / c[t]
    return met, far, owed


@pytest.mark.parametrize("tasks", [1, 3])
@pytest.mark.parametrize("cells", [1, 90, 1 << 20])
def test_sums_of_paths(monkeypatch, cells, tasks):
    """Sparse graphs, where much is taken out, and denser ones; all sources and some; batches of any width."""
    monkeypatch.setattr(reach, "CELLS", cells)
    for seed in range(40):
        rng = random.Random(seed)
        n = rng.choice([2, 5, 9, 14, 25])
        pairs = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([1, n // 2 + 1, n, 2 * n]))) if a != b})
        if not pairs:
            continue
        a, b = map(np.array, zip(*pairs))
        sources = np.arange(n) if seed % 2 else np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        got = [sum(x) for x in zip(*(reach.sums(n, a, b, sources, t, tasks) for t in range(tasks)))]
        near = [sum(x) for x in zip(*(reach.sums(n, a, b, sources, t, tasks, through=False) for t in range(tasks)))]
        for g, w in zip([*got, *near[:2]], [*(want := sums_of_all(pairs, n, sources)), *want[:2]]):
            assert np.allclose(g, w), seed


def test_sources_cost_no_job_per_level(spark):
    """A chain of 60 links took a join and a write for each of its levels, forth and back."""
    ids = [f"n{i:02d}" for i in range(61)]
    pairs = list(zip(ids, ids[1:]))
    links, nodes = graph(spark, pairs, ids)
    tracker, group = spark.sparkContext.statusTracker(), "one-chain"
    spark.sparkContext.setJobGroup(group, "")
    got = {r.uuid: r.betweenness for r in graphalg.betweenness(links, nodes, sources=61).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(abs(got[v] - w) < 1e-12 for v, w in brute_betweenness(pairs, ids).items())
    assert jobs < 50


@pytest.mark.parametrize("sources", [None, 6])
def test_graphs_too_large_for_a_worker(spark, monkeypatch, sources):
    pairs, ids = random_graph(3)
    links, nodes = graph(spark, pairs, ids)

    def all_measures():
        near = {r.uuid: r.closeness for r in graphalg.closeness(links, nodes, sources=sources).collect()}
        return near, {r.uuid: (r.score, r.betweenness, r.connections) for r in graphalg.hotspots(links, nodes, None, sources).collect()}

    small = all_measures()
    monkeypatch.setattr(reach, "MOST", 5)
    large = all_measures()
    assert all(small[0][v] == pytest.approx(large[0][v]) and small[1][v] == pytest.approx(large[1][v]) for v in ids)


def test_hotspots_cost_no_job_per_round(spark):
    """PageRank wrote its state each round; loops, an unknown end and an entity without links are in the graph."""
    pairs, ids = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("d", "d"), ("d", "b")], ["a", "b", "c", "d", "e"]
    links, nodes = graph(spark, pairs, ids)
    spark.sparkContext.setJobGroup("spots", "")
    got = {r.uuid: r for r in graphalg.hotspots(links, nodes, None, sources=3).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("spots"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rank = dict.fromkeys(ids, 0.2)
    for _ in range(100):
        out = {v: [b for a, b in pairs if a == v and b in ids] for v in ids}
        lost = sum(rank[v] for v in ids if not out[v])
        new = {v: 0.15 / 5 + 0.85 * (sum(rank[a] / len(out[a]) for a in ids if v in out[a]) + lost / 5) for v in ids}
        rank, moved = new, sum(abs(new[v] - rank[v]) for v in ids)
        if moved < 5e-6:
            break
    assert all(abs(got[v]["rank"] - rank[v]) < 1e-12 for v in ids)
    assert {v: got[v].connections for v in ids} == {"a": 2, "b": 3, "c": 3, "d": 3, "e": 0}
    assert jobs < 60


def test_paths_are_not_kept(spark, tmp_path):
    """The rows of (source, reached) were written and joined level by level."""
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = [*zip(ids, ids[1:]), ("n03", "n03"), ("n00", "n02"), ("n01", "n03"), ("n39", "n20")]
    spark.createDataFrame([(u,) for u in [*ids, "alone"]], "uuid string").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(f"l{i}", *p, "calls", None, None) for i, p in enumerate(pairs)], "uuid string, from_uuid string, to_uuid string, type string, created_at timestamp, properties string").write.parquet(f"{tmp_path}/edges.parquet")
    spark.sparkContext.setJobGroup("paths", "")
    got = {(r.source, r.uuid): (r.depth, r.paths) for r in QUERIES["shortest_paths"](spark, str(tmp_path)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {s: bfs(pairs, s) for s in ids}
    assert got == {(s, t): (d, want[s][1][t]) for s in ids for t, d in want[s][0].items() if t != s}
    assert jobs < 50


@pytest.mark.parametrize("measure", ["closeness", "betweenness"])
def test_exact_measures_cost_no_job_per_level(spark, measure):
    ids = [f"n{i:02d}" for i in range(41)]
    links, nodes = graph(spark, list(zip(ids, ids[1:])), ids)
    spark.sparkContext.setJobGroup(measure, "")
    got = {r.uuid: r[measure] for r in getattr(graphalg, measure)(links, nodes).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(measure))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {"closeness": lambda i: i / sum(range(i + 1)) * i / 40 if i else 0.0, "betweenness": lambda i: i * (40 - i) / (40 * 39)}[measure]
    assert all(abs(got[v] - want(i)) < 1e-12 for i, v in enumerate(ids))
    assert jobs < 50
