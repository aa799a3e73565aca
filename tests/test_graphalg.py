import random
from collections import deque
from itertools import permutations

import pytest

from codeloom.operators import graphalg
from codeloom.plans.queries import QUERIES


def graph(spark, pairs, ids):
    return spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(i,) for i in ids], "uuid string")


def random_graph(seed, n=14, m=26):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    return sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(m)}), ids


def bfs(pairs, source):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    dist, count, order = {source: 0}, {source: 1}, deque([source])
    while order:
        v = order.popleft()
        for w in out.get(v, []):
            if w not in dist:
                dist[w], count[w] = dist[v] + 1, 0
                order.append(w)
            if dist[w] == dist[v] + 1:
                count[w] += count[v]
    return dist, count


def brute_betweenness(pairs, ids):
    from_ = {s: bfs(pairs, s) for s in ids}
    total = dict.fromkeys(ids, 0.0)
    for s, t in permutations(ids, 2):
        d, c = from_[s]
        if t not in d:
            continue
        for v in ids:
            if v in (s, t) or v not in d:
                continue
            dv, cv = from_[v]
            if t in dv and d[v] + dv[t] == d[t]:
                total[v] += c[v] * cv[t] / c[t]
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_path_measures(spark, seed):
    pairs, ids = random_graph(seed)
    links, nodes = graph(spark, pairs, ids)
    paths = graphalg.shortest_paths(links, nodes)
    got = {r.uuid: r.betweenness for r in graphalg.betweenness(links, nodes, paths).collect()}
    want = brute_betweenness(pairs, ids)
    assert all(abs(got[v] - want[v]) < 1e-9 for v in ids)
    close = {r.uuid: r.closeness for r in graphalg.closeness(links, nodes, paths).collect()}
    back = [(b, a) for a, b in pairs]
    for v in ids:
        d = [x for u, x in bfs(back, v)[0].items() if u != v]
        assert abs(close[v] - (len(d) / sum(d) * len(d) / (len(ids) - 1) if d else 0.0)) < 1e-9


def test_paths_longer_than_thirty_links(spark):
    ids = [f"n{i:02d}" for i in range(36)]
    pairs = list(zip(ids, ids[1:]))
    links, nodes = graph(spark, pairs, ids)
    paths = graphalg.shortest_paths(links, nodes.where("uuid < 'n02'"))
    assert {(r.source, r.uuid): r.depth for r in paths.collect()} == {(a, b): j - i for i, a in enumerate(ids[:2]) for j, b in enumerate(ids) if i <= j}


def test_path_queries_cover_the_whole_graph(spark, tmp_path):
    """All types of links, an isolated entity and an unknown end."""
    pairs = [("a", "b", "calls"), ("b", "c", "inherits"), ("a", "d", "imports"), ("d", "c", "uses"), ("c", "x", "calls")]
    ids = ["a", "b", "c", "d", "e"]
    spark.createDataFrame([(u, "r", "f.py", "function", u, 1, 2, None, None, None, None, None, False) for u in ids], "uuid string, repo_id string, file_path string, type string, name string, start_line int, end_line int, docstring string, tags array<string>, metadata string, created_by string, created_at timestamp, manual boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(f"l{i}", *p, None, None) for i, p in enumerate(pairs)], "uuid string, from_uuid string, to_uuid string, type string, created_at timestamp, properties string").write.parquet(f"{tmp_path}/edges.parquet")
    got = {r.uuid: r.betweenness_millionths / 1e6 for r in QUERIES["betweenness"](spark, str(tmp_path)).collect()}
    want = brute_betweenness([p[:2] for p in pairs], [*ids, "x"])
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-8 for v in want)
    reach = {v: bfs([p[:2] for p in pairs], v)[0] for v in want}
    assert {(r.source, r.uuid): r.depth for r in QUERIES["shortest_paths"](spark, str(tmp_path)).collect()} == {(s, t): d for s in reach for t, d in reach[s].items() if d}
    assert {r.uuid for r in QUERIES["closeness"](spark, str(tmp_path)).collect()} == set(want)
    assert {r.uuid for r in QUERIES["hotspots"](spark, str(tmp_path)).collect()} == set(want)


def test_pagerank_sums_to_one_and_matches(spark):
    pairs, ids = random_graph(4)
    links, nodes = graph(spark, pairs, ids)
    got = {r.uuid: r["rank"] for r in graphalg.pagerank(links, nodes, rounds=30, tolerance=0.0).collect()}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(30):
        lost = sum(r for v, r in rank.items() if v not in out)
        rank = {v: 0.15 / len(ids) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == v) + lost / len(ids)) for v in ids}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[v] - rank[v]) < 1e-9 for v in ids)


@pytest.mark.parametrize("seed", [1, 7])
def test_strong_components(spark, seed):
    pairs, ids = random_graph(seed, 12, 20)
    links, nodes = graph(spark, pairs, ids)
    got = {r.uuid: r.component for r in graphalg.strong_components(links, nodes).collect()}
    reach = {v: set(bfs(pairs, v)[0]) for v in ids}
    assert set(got) == set(ids)
    for a in ids:
        for b in ids:
            assert (got[a] == got[b]) == (b in reach[a] and a in reach[b])


def test_cycles(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "d"), ("c", "e"), ("e", "f"), ("f", "b")]
    links, _ = graph(spark, pairs, [])
    got = {(tuple(r.path), r.length, r.severity) for r in graphalg.cycles(links, 4).collect()}
    assert got == {(("d",), 1, "high"), (("a", "b"), 2, "high"), (("a", "b", "c"), 3, "high"), (("b", "c", "e", "f"), 4, "medium")}


def test_cycles_of_any_length(spark):
    ring = [f"n{i}" for i in range(6)]
    pairs = [*zip(ring, [*ring[1:], ring[0]]), ("n2", "n0"), ("n5", "z"), ("z", "z")]
    links, _ = graph(spark, pairs, [])
    got = {(tuple(r.path), r.length) for r in graphalg.cycles(links, None).collect()}
    assert got == {(tuple(ring), 6), (("n0", "n1", "n2"), 3), (("z",), 1)}


def test_component_query_covers_the_whole_graph(spark, tmp_path):
    """A component over several types of links, an isolated entity, an unknown end."""
    ids = ["a", "b", "c", "d", "e"]
    spark.createDataFrame([(u, "r", "f.py", "function", u, 1, 2, None, None, None, None, None, False) for u in ids], "uuid string, repo_id string, file_path string, type string, name string, start_line int, end_line int, docstring string, tags array<string>, metadata string, created_by string, created_at timestamp, manual boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    pairs = [("a", "b", "calls"), ("b", "c", "inherits"), ("c", "a", "imports"), ("c", "d", "uses"), ("d", "x", "imports")]
    spark.createDataFrame([(f"l{i}", *p, None, None) for i, p in enumerate(pairs)], "uuid string, from_uuid string, to_uuid string, type string, created_at timestamp, properties string").write.parquet(f"{tmp_path}/edges.parquet")
    assert {(r["size"], r.components) for r in QUERIES["strong_components"](spark, str(tmp_path)).collect()} == {(3, 1), (1, 3)}


def test_empty_graph(spark):
    links, nodes = graph(spark, [], [])
    assert graphalg.pagerank(links, nodes).count() == 0
    assert graphalg.strong_components(links, nodes).count() == 0
    assert graphalg.cycles(links).count() == 0
    assert graphalg.betweenness(links, nodes).count() == 0


def test_pagerank_stops_at_its_tolerance(spark):
    """A chain of states joined with themselves: planning must not grow with the rounds."""
    import time

    pairs, ids = random_graph(9, 40, 90)
    links, nodes = graph(spark, pairs, ids)
    began = time.time()
    far = {r.uuid: r["rank"] for r in graphalg.pagerank(links, nodes, tolerance=0.0, rounds=40).collect()}
    assert time.time() - began < 60
    near = {r.uuid: r["rank"] for r in graphalg.pagerank(links, nodes, tolerance=1e-7).collect()}
    assert all(abs(near[v] - far[v]) < 1e-4 for v in ids)


def test_estimates_and_their_error(spark):
    pairs, ids = random_graph(5, 60, 150)
    links, nodes = graph(spark, pairs, ids)
    exact = brute_betweenness(pairs, ids)
    whole = {r.uuid: r.betweenness for r in graphalg.betweenness(links, nodes, sources=60).collect()}
    assert all(abs(whole[v] - exact[v]) < 1e-9 for v in ids)
    part = {r.uuid: r.betweenness for r in graphalg.betweenness(links, nodes, sources=30).collect()}
    assert sum(abs(part[v] - exact[v]) for v in ids) / sum(exact.values()) < 0.5
    top = sorted(ids, key=exact.get)[-5:]
    assert len(set(top) & set(sorted(ids, key=part.get)[-10:])) >= 4
    spots = graphalg.hotspots(links, nodes, limit=None).collect()
    assert len(spots) == 60 and abs(spots[0].average - sum(r.score for r in spots) / 60) < 1e-12
    assert {r.uuid: r.connections for r in spots} == {v: sum((a == v) + (b == v) for a, b in pairs) for v in ids}


def test_a_bound_on_paths_is_an_error(spark):
    pairs, ids = random_graph(1)
    links, nodes = graph(spark, pairs, ids)
    with pytest.raises(graphalg.TooManyPaths):
        graphalg.shortest_paths(links, nodes, most_rows=20)
    assert graphalg.shortest_paths(links, nodes, most_rows=14 * 14).count() > 20
