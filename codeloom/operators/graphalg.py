"""Iterative graph algorithms as joins and aggregations; state is cut into the shared folder between rounds.

Links are (src, dst), repeated ones count once. Nothing is broadcast and no list of ids, labels or components comes to
the driver, only counts. Empty graphs give empty results.

Path measures go from each source in a worker that has all links (`operators/reach`), up to `reach.MOST` entities and links;
larger graphs go level by level, which holds sources x reachable rows, bounded by `most_rows` where given. `betweenness` and
`closeness` from a sample of pivots estimate the same figures from as many sources as asked for, whatever the size of the
graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import reach
from codeloom.session import cut


def pagerank(links: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(uuid, rank) over nodes (uuid): dangling mass is spread evenly; ends when the ranks move less than tolerance per node
    in all, or at `rounds`. Links to unknown entities are left out.

    A round is one join, one aggregation and one write; the dangling mass and the movement come from what was written.
    """
    ids = cut(nodes.select("uuid").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    pairs = links.select("src", "dst").distinct()
    pairs = pairs.join(ids.withColumnRenamed("uuid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uuid", "dst"), "dst", "left_semi")
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    pairs = cut(pairs.join(out, "src"))
    ranks = cut(ids.join(pairs.select(F.col("src").alias("uuid"), "n_out").distinct(), "uuid", "left").withColumn("rank", F.lit(1.0 / n)))
    linked = ranks.drop("rank")
    lost = ranks.where("n_out is null").count() / n
    for _ in range(rounds):
        given = pairs.join(ranks.select(F.col("uuid").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("uuid")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        old = ranks.select("uuid", F.col("rank").alias("old"))
        new = linked.join(given, "uuid", "left").join(old, "uuid")
        new = cut(new.select("uuid", "n_out", "old", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) / n)).alias("rank")))
        row = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"), F.sum(F.when(F.col("n_out").isNull(), F.col("rank"))).alias("lost")).first()
        ranks, lost = new.drop("old"), row.lost or 0.0
        if row.moved < tolerance * n:
            break
    return ranks.select("uuid", "rank")


class TooManyPaths(RuntimeError):
    """More (source, reached) rows than allowed."""


def shortest_paths(links: DataFrame, sources: DataFrame, most: int | None = None, every: int = 8, most_rows: int | None = None) -> DataFrame:
    """(source, uuid, depth, paths): distance and number of shortest paths from each source (uuid), level by level until
    no level has a new entity, or to depth `most`. Levels are written once and merged with what is seen every few.

    most_rows: raise TooManyPaths when more rows than that are reached, rather than filling the cluster.
    """
    pairs = cut(links.select("src", "dst").distinct())
    seen = cut(sources.select(F.col("uuid").alias("source"), "uuid", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct())
    frontier, d = seen, 0
    reached = seen.count() if most_rows is not None else 0
    while most is None or d < most:
        d += 1
        step = frontier.join(pairs, F.col("uuid") == F.col("src")).groupBy("source", F.col("dst").alias("uuid")).agg(F.sum("paths").alias("paths"))
        frontier = cut(step.join(seen, ["source", "uuid"], "left_anti").select("source", "uuid", F.lit(d).alias("depth"), "paths"))
        if most_rows is not None:
            reached += frontier.count()
            if reached > most_rows:
                raise TooManyPaths(f"more than {most_rows} rows at depth {d}; estimate from pivots instead")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % every == 0:
            seen = cut(seen)
    return seen


def pivots(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(uuid) of n of the nodes, those with the smallest hash: a sample without regard to order, the same every time."""
    return nodes.select("uuid").distinct().orderBy(F.xxhash64(F.lit(seed), F.col("uuid")), "uuid").limit(n)


def path_sums(links: DataFrame, nodes: DataFrame, sources: int | None = None, through: bool = True) -> DataFrame | None:
    """reach.measures from all nodes or as many pivots; None if the graph is too large for a worker."""
    ids = nodes.select("uuid").distinct()
    if not reach.fits(links, ids):
        return None
    return reach.measures(links, ids if sources is None else pivots(nodes, sources), through)


def closeness(links: DataFrame, nodes: DataFrame, paths: DataFrame | None = None, sources: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """(uuid, closeness): incoming distances, scaled by the share of entities that reach it; 0 if none does.

    sources: paths (or their path_sums) are those from as many pivots; what reaches an entity is counted among them and
    scaled up.
    """
    ids = nodes.select("uuid").distinct()
    n = ids.count()
    if paths is None and sums is None:
        sums = path_sums(links, nodes, sources, through=False)
    if sums is None:
        if paths is None:
            paths = shortest_paths(links, ids if sources is None else pivots(nodes, sources))
        sums = paths.where("depth > 0").groupBy("uuid").agg(F.count(F.lit(1)).alias("r"), F.sum("depth").alias("far"))
    scale = n / sources if sources is not None and sources < n else 1.0
    near = sums.where("r > 0").select("uuid", (F.col("r") * scale).alias("r"), (F.col("far") * scale).alias("far"))
    score = (F.col("r") / F.col("far")) * (F.col("r") / F.lit(max(n - 1, 1)))
    return ids.join(near, "uuid", "left").select("uuid", F.coalesce(score, F.lit(0.0)).alias("closeness"))


def betweenness(links: DataFrame, nodes: DataFrame, paths: DataFrame | None = None, sources: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """(uuid, betweenness): share of shortest paths through each entity, directed, normalised, ends excluded.

    The dependencies of paths are accumulated from the farthest level back, one join and aggregation per level. sources:
    paths (or their path_sums) are those from as many pivots, and the sums are scaled up.
    """
    base = nodes.select("uuid").distinct()
    n = base.count()
    if paths is None and sums is None:
        sums = path_sums(links, nodes, sources)
    acc = _dependencies(links, base, nodes, paths, sources) if sums is None else sums.select("uuid", "owed")
    if acc is None:
        return base.withColumn("betweenness", F.lit(0.0))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if sources is not None and sources < n:
        scale *= n / sources
    summed = acc.groupBy("uuid").agg((F.sum("owed") * scale).alias("betweenness"))
    return base.join(summed, "uuid", "left").select("uuid", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _dependencies(links: DataFrame, base: DataFrame, nodes: DataFrame, paths: DataFrame | None, sources: int | None) -> DataFrame | None:
    """(uuid, owed), to be summed up, from paths level by level; None if no path has a link."""
    if paths is None:
        paths = cut(shortest_paths(links, base if sources is None else pivots(nodes, sources)))
    pairs = cut(links.select("src", "dst").distinct())
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    acc = None
    last = paths.where(F.col("depth") == deepest).withColumn("owed", F.lit(0.0))
    for d in range(deepest, 0, -1):
        above = paths.where(F.col("depth") == d - 1).select("source", F.col("uuid").alias("src"), F.col("paths").alias("above"))
        share = last.withColumnRenamed("uuid", "dst").join(pairs, "dst").join(above, ["source", "src"])
        owed = share.groupBy("source", F.col("src").alias("uuid")).agg(F.sum(F.col("above") / F.col("paths") * (1 + F.col("owed"))).alias("owed"))
        level = cut(paths.where(F.col("depth") == d - 1).join(owed, ["source", "uuid"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0))))
        inner = level.where("source <> uuid").groupBy("uuid").agg(F.sum("owed").alias("owed"))
        acc = inner if acc is None else acc.unionByName(inner)
        last = level
    return acc


def hotspots(links: DataFrame, nodes: DataFrame, limit: int | None = 10, sources: int | None = None) -> DataFrame:
    """(uuid, score, betweenness, closeness, rank, connections, average): the entities of the largest combined score, how
    many link ends each has, and the average score of all. sources: estimate the path measures from as many pivots."""
    ids = nodes.select("uuid").distinct()
    if reach.fits(links, ids):
        ids = cut(ids)
        sums = reach.figures(links, ids if sources is None else pivots(ids, sources), ids)
        n = ids.count()
        share = n / sources if sources is not None and sources < n else 1.0
        through = F.col("owed") * (share / ((n - 1) * (n - 2)) if n > 2 else share)
        near = F.when(F.col("r") > 0, (F.col("r") / F.col("far")) * (F.col("r") * share / F.lit(max(n - 1, 1)))).otherwise(0.0)
        rows = sums.select("uuid", through.alias("betweenness"), near.alias("closeness"), "rank", "connections")
    else:
        paths = cut(shortest_paths(links, ids if sources is None else pivots(nodes, sources)))
        ends = links.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("uuid")).groupBy("uuid").agg(F.count(F.lit(1)).alias("connections"))
        rows = betweenness(links, ids, paths, sources).join(closeness(links, ids, paths, sources), "uuid").join(pagerank(links, ids), "uuid")
        rows = rows.join(ends, "uuid", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))
    scored = cut(rows.withColumn("score", 0.4 * F.col("betweenness") + 0.3 * F.col("closeness") + 0.3 * F.col("rank")))
    average = scored.agg(F.avg("score").alias("average"))
    top = scored if limit is None else scored.orderBy(F.desc("score"), "uuid").limit(limit)
    return top.join(F.broadcast(average))


def _spread_min(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (uuid, label) lowered along pairs (src, dst) until none changes."""
    while True:
        offered = pairs.join(labels.select(F.col("uuid").alias("src"), F.col("label").alias("offer")), "src").groupBy(F.col("dst").alias("uuid")).agg(F.min("offer").alias("offer"))
        new = cut(labels.join(offered, "uuid", "left").select("uuid", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        labels = new.select("uuid", "label")
        if new.where("moved").isEmpty():
            return labels


def strong_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uuid, component): trim what has no way in or out, colour the rest forward, and walk back within the colours."""
    ids = cut(nodes.select("uuid").distinct())
    pairs = links.where("src <> dst").select("src", "dst").distinct()
    pairs = cut(pairs.join(ids.withColumnRenamed("uuid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uuid", "dst"), "dst", "left_semi"))
    left, done = ids, None

    def settle(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    n = pairs.count()
    while True:
        # Trimming: what has no way in or no way out is a component of its own. Only the links that are left are written.
        while True:
            live = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            pairs = cut(live.select("src", "dst"))
            before, n = n, pairs.count()
            if n == before:
                break
        linked = cut(left.join(pairs.select(F.col("src").alias("uuid")).distinct(), "uuid", "left_semi"))
        settle(cut(left.join(linked, "uuid", "left_anti").select("uuid", F.col("uuid").alias("component"))))
        left = linked
        if not n:
            break
        colours = _spread_min(pairs, left.select("uuid", F.col("uuid").alias("label")))
        # Back from each root along links within its colour.
        same = pairs.join(colours.select(F.col("uuid").alias("src"), F.col("label").alias("ls")), "src").join(colours.select(F.col("uuid").alias("dst"), F.col("label").alias("ld")), "dst")
        back = cut(same.where("ls = ld").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = cut(colours.where("uuid = label"))
        frontier = found
        while True:
            step = back.join(frontier.select(F.col("uuid").alias("src"), "label"), "src").select(F.col("dst").alias("uuid"), "label").distinct()
            frontier = cut(step.join(found, "uuid", "left_anti"))
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier.select("uuid", "label")))
        settle(found.select("uuid", F.col("label").alias("component")))
        left = cut(left.join(found, "uuid", "left_anti"))
        gone = found.select("uuid")
        pairs = cut(pairs.join(gone.withColumnRenamed("uuid", "src"), "src", "left_anti").join(gone.withColumnRenamed("uuid", "dst"), "dst", "left_anti"))
        n = pairs.count()
    return done


def cycles(links: DataFrame, most: int | None = 4) -> DataFrame:
    """(path, length): elementary circuits of at most `most` links (None: of any length), each once, from its smallest
    entity on. There can be exponentially many; a circuit lies within a strong component."""
    pairs = links.select("src", "dst").distinct()
    loops = pairs.where("src = dst").select(F.array("src").alias("path"), F.lit(1).alias("length"))
    steps = pairs.where("src <> dst")
    # Only links between entities with a way in and a way out can be on a circuit.
    live = steps.select(F.col("src").alias("uuid")).distinct().join(steps.select(F.col("dst").alias("uuid")).distinct(), "uuid", "left_semi")
    steps = cut(steps.join(live.withColumnRenamed("uuid", "src"), "src", "left_semi").join(live.withColumnRenamed("uuid", "dst"), "dst", "left_semi"))
    if most is None:
        inside = cut(strong_components(steps, live))
        steps = steps.join(inside.select(F.col("uuid").alias("src"), "component"), "src").join(inside.select(F.col("uuid").alias("dst"), "component"), ["dst", "component"])
        steps = cut(steps.select("src", "dst"))
    level = steps.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    found, length = loops, 2
    while True:
        closing = level.join(steps, F.col("end") == F.col("src")).where(F.col("dst") == F.element_at("path", 1)).select("path", F.lit(length).alias("length"))
        found = found.unionByName(closing)
        if length == most:
            break
        on = level.join(steps, F.col("end") == F.col("src")).where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        level = on.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"))
        if most is None:
            level = cut(level)
            if level.isEmpty():
                break
        length += 1
    return found.withColumn("severity", F.when(F.col("length") <= 3, "high").otherwise("medium"))
