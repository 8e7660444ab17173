"""Graph analytics on edge relations (src, dst): every round is a join, lineage is cut by tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import components, materialise, written
from . import reach as R

DAMPING, ROUNDS = 0.85, 20


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over distinct neighbours."""
    return fans(edges.select("src", "dst").distinct())


def fans(pairs: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of pairs (src, dst) that are distinct already."""
    ends = pairs.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """The distinct edges between known ends, as a table."""
    return materialise(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "pairs")


#: Links of one source in a bucket of their own.
HUB_LINKS = 1 << 20


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(id, centrality): ranks after a fixed number of rounds, divided by the largest; dangling mass is dropped.

    The links lie dealt by their source while rounds run, so a round is one join in place and one shuffle of sums. The
    links of a hub are dealt into several buckets, and what it is given goes to each of them.
    """
    pairs = distinct_pairs(edges)
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    buckets = F.coalesce((F.col("out") / HUB_LINKS).cast("int"), F.lit(0))
    all_nodes = materialise(nodes(pairs).join(out, "id", "left").select("id", buckets.alias("last"), "out"), "nodes")
    n = max(1, all_nodes.count())
    places = all_nodes.select("id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bucket"))
    source = all_nodes.filter("out is not null").select(F.col("id").alias("src"), "last", (1.0 / F.col("out")).alias("share"))
    bucket = F.pmod(F.xxhash64("dst"), F.col("last") + 1).cast("int")
    links = pairs.join(source, "src").select("src", bucket.alias("bucket"), F.col("dst").alias("id"), "share").join(places.withColumnRenamed("bucket", "to"), "id")
    links = materialise(links, "links").repartition("src", "bucket").persist()
    zero = places.select("id", "bucket", F.lit(0.0).alias("given"))
    ranks = places.select("id", "bucket", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        met = links.join(ranks.withColumnRenamed("id", "src"), ["src", "bucket"]).select("id", F.col("to").alias("bucket"), (F.col("rank") * F.col("share")).alias("given"))
        ranks = met.unionByName(zero).groupBy("id", "bucket").agg((F.lit((1 - damping) / n) + damping * F.sum("given")).alias("rank"))
        if i % 10 == 9 or i == rounds - 1:
            ranks = materialise(ranks, "ranks")
    links.unpersist()
    ranks = ranks.filter("bucket = 0")
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("centrality"))  # one row


def dependency_metrics(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, instability, spof_score, centrality), rounded to four places."""
    d = degrees(edges).withColumn("instability", S.instability(F.col("fan_in"), F.col("fan_out")))
    d = d.withColumn("spof_score", S.spof(F.col("fan_in"), F.col("instability"))).join(pagerank(edges), "id")
    return d.select("id", "fan_in", "fan_out", *(F.round(c, 4).alias(c) for c in ("instability", "spof_score", "centrality")))


def bfs(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, level): the least level at which each node is reached from each root of ``start`` (id)."""
    pairs = distinct_pairs(edges)
    frontier, (n, _), _ = written(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("level")).distinct(), "level")
    seen, depth = frontier, 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.join(pairs, frontier.id == pairs.src).select("root", F.col("dst").alias("id")).distinct()
        frontier, (n, _), _ = written(step.join(seen, ["root", "id"], "left_anti").withColumn("level", F.lit(depth)), "level")
        seen = seen.unionByName(frontier) if n else seen  # a table of each level, none is written twice
    return seen


#: Neighbours in one list, and pairs that a task counts once, about.
LIST, TASK_PAIRS = 1024, 1 << 21


def within(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``bfs`` to a depth of one or more whose last step, which makes most rows, travels as lists of neighbours.

    A node's neighbours go to a root as lists of at most ``LIST``, dealt by root once; each is counted where it arrives, so
    no pair of root and node is shuffled.
    """
    pairs = materialise(distinct_pairs(edges), "pairs")
    inner = bfs(pairs, start, depth - 1)
    place = F.floor((F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1) / LIST).alias("place")
    lists = materialise(pairs.select("src", "dst", place).groupBy("src", "place").agg(F.collect_list("dst").alias("ids")).select("src", "ids"), "lists")
    last = inner.filter(F.col("level") == depth - 1)
    total = last.groupBy("id").agg(F.count("*").alias("n")).join(pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id").agg(F.sum(F.col("n") * F.col("d"))).first()[0]
    tasks = max(start.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TASK_PAIRS))
    far = last.join(lists, last.id == lists.src).select("root", F.lit(depth).alias("level"), "ids")
    held = far.unionByName(inner.select("root", "level", F.array("id").alias("ids"))).repartition(tasks, "root")
    return held.select("root", F.explode("ids").alias("id"), "level").groupBy("root", "id").agg(F.min("level").alias("level"))


def neighbourhood(edges: DataFrame, start: DataFrame, max_depth: int = 2, max_nodes: int = 50) -> DataFrame:
    """(root, id, level): nodes within ``max_depth``; of more than ``max_nodes`` the nearest, then smallest ids."""
    found = bfs(edges, start, max_depth)
    order = F.row_number().over(W.partitionBy("root").orderBy("level", "id"))
    return found.withColumn("n", order).filter(F.col("n") <= max_nodes).drop("n")


def closure_sizes(edges: DataFrame) -> DataFrame:
    """(root, reached): how many nodes each node with an edge reaches in one step or more; itself counts on a cycle.

    By condensation (``reach``): no pair of nodes is built.
    """
    pairs = distinct_pairs(edges)
    on_cycle = pairs.filter("src = dst").select("src").distinct()
    found = R.reached(pairs, strong_components(pairs))
    # A node of a component of two or more reaches itself; a single one does by an edge to itself.
    own = F.col("component_size") > 1
    rows = found.join(on_cycle.select(F.col("src").alias("root"), F.lit(1).alias("loop")), "root", "left")
    total = F.col("others") + F.when(own | F.col("loop").isNotNull(), 1).otherwise(0)
    return rows.select("root", total.alias("reached")).filter("reached > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance, path) of each pair, edges taken both ways; the lexicographically least of shortest paths.

    Searches from both ends, each time from the side with the smaller front, until the two meet or one ends. Levels are
    (pair, node) rows without paths; one path a pair is then walked through the levels, at each step to the least node
    that lies on a shortest path.
    """
    both = distinct_pairs(edges.unionByName(reverse(edges)))
    asked = materialise(pairs.select("a", "b").distinct(), "asked")
    sides = {s: [materialise(asked.select("a", "b", F.col(s).alias("id")), "front")] for s in ("a", "b")}
    size = {"a": asked.count(), "b": asked.count()}
    met, key = None, ["a", "b"]
    while True:
        # Pairs that have met are settled at the least depth, as both searches go level by level.
        now = sides["a"][-1].join(sides["b"][-1], [*key, "id"], "left_semi").select(*key).distinct()
        now = materialise(now.withColumns({"p": F.lit(len(sides["a"]) - 1), "q": F.lit(len(sides["b"]) - 1)}), "met")
        met = now if met is None else met.unionByName(now)
        if not min(size.values()):
            break
        grow = min(size, key=lambda s: (size[s], s))
        open_pairs = sides[grow][-1].join(met.select(*key), key, "left_anti")
        step = open_pairs.join(both, open_pairs.id == both.src).select(*key, F.col("dst").alias("id")).distinct()
        for old in sides[grow]:
            step = step.join(old, [*key, "id"], "left_anti")
        front, (size[grow], _), _ = written(step, "front")
        sides[grow].append(front)
    met = materialise(met, "met")
    # Nodes of the first half that lie on a shortest path, from the meeting level back to the start.
    deepest = len(sides["a"]) - 1
    on_path: dict[int, DataFrame] = {}
    above = None
    for level in range(deepest, -1, -1):
        here = sides["a"][level]
        meets = here.join(met.filter(F.col("p") == level).select(*key, "q"), key)
        ends = None
        for q, front in enumerate(sides["b"]):
            one = meets.filter(F.col("q") == q).join(front, [*key, "id"], "left_semi").select(*key, "id")
            ends = one if ends is None else ends.unionByName(one)
        if above is not None:
            before = above.join(both, above.id == both.src).select(*key, F.col("dst").alias("id"))
            ends = ends.unionByName(here.join(before.distinct(), [*key, "id"], "left_semi"))
        above = on_path[level] = materialise(ends.distinct(), "on_path")
    # One step of all walks at a time: first along the levels of a, then down those of b.
    walk = materialise(met.withColumns({"at": F.col("a"), "path": F.array("a")}), "walk")
    done = None
    for step in range(len(sides["a"]) + len(sides["b"])):
        over = walk.filter(F.col("p") + F.col("q") == step)
        done = over if done is None else done.unionByName(over)
        walk = walk.filter(F.col("p") + F.col("q") > step)
        to = [on_path[step + 1].withColumns({"q": F.lit(None).cast("int")})] if step + 1 in on_path else []
        to += [front.withColumn("q", F.lit(q)) for q, front in enumerate(sides["b"])]
        known = to[0]
        for more in to[1:]:
            known = known.unionByName(more)
        known = known.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("id").alias("next"), F.col("q").alias("kq"))
        near = walk.join(both, walk["at"] == both.src).select(*walk.columns, F.col("dst").alias("next"))
        left = near.p + near.q - step - 1  # levels of b that remain behind the next node
        fits = F.when(near.p > step, known.kq.isNull()).otherwise(known.kq == left)
        best = near.join(known, (near.a == known.ka) & (near.b == known.kb) & (near.next == known.next) & fits).groupBy(*key, "p", "q", "path").agg(F.min(near.next).alias("at"))
        walk, (n, _), _ = written(best.select(*key, "p", "q", "at", F.array_append("path", F.col("at")).alias("path")), "walk")
        if not n:
            break
    return pairs.join(done.select(*key, "path"), key, "left").select("a", "b", (F.size("path") - 1).alias("distance"), "path")


def weak_components(edges: DataFrame, min_size: int = 1) -> DataFrame:
    """(id, component, size): weakly connected components of at least ``min_size`` nodes."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("v").alias("id"), F.col("root").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    return found.join(sizes, "component").select("id", "component", "size")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of strongly connected components of two nodes or more, by forward colouring.

    Nodes that no edge enters or leaves are in no component and go first. Then each round spreads the largest id along
    the edges as a colour; the nodes of a colour from which its own node can be reached backwards within the colour are
    a component. They leave, and the rest goes on. Edges whose ends differ in colour can lie in no component and leave too.
    """
    found, left = None, edges.filter("src <> dst and src is not null and dst is not null").select("src", "dst").distinct()
    while True:
        for _ in range(2):
            left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        left, (n, _), _ = written(left, "scc")
        if not n:
            break
        colour, state, _ = written(nodes(left).withColumn("colour", F.col("id")), "colour")
        while True:
            spread = left.join(colour, left.src == colour.id).select(F.col("dst").alias("id"), "colour").unionByName(colour)
            before = state
            colour, state, _ = written(spread.groupBy("id").agg(F.max("colour").alias("colour")), "colour")
            if state == before:
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2"))
        inside = materialise(left.join(a, "src").join(b, "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("colour")), "inside")
        back = inside.select(F.col("dst").alias("id"), "colour", "src")
        frontier, (n, _), _ = written(inside.select(F.col("colour").alias("id"), "colour").distinct(), "reached")
        reached = frontier
        while n:
            step = frontier.join(back, ["id", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            frontier, (n, _), _ = written(step.join(reached, ["id", "colour"], "left_anti"), "reached")
            reached = reached.unionByName(frontier) if n else reached
        found = reached if found is None else found.unionByName(reached)
        ids = reached.select("id")
        left = inside.join(ids, inside.src == ids.id, "left_anti").join(ids, inside.dst == ids.id, "left_anti").select("src", "dst")
    if found is None:
        return nodes(edges).limit(0).withColumn("component", F.col("id"))
    named = found.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return found.join(named, "colour").select("id", "component")


def two_cycles(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst").distinct()
    back = reverse(pairs)
    return pairs.join(back, ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def impact(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(root, direct, transitive, fan_out, risk): dependents of each root (of every node) along reversed edges.

    Of every node, dependents are counted by condensation; of given roots, by a search.
    """
    pairs = distinct_pairs(edges)
    if start is None:
        start = nodes(pairs)
        direct = pairs.filter("src <> dst").groupBy(F.col("dst").alias("root")).agg(F.count("*").alias("direct"))
        counts = R.reached(reverse(pairs), strong_components(pairs)).join(direct, "root", "left")
        counts = counts.select("root", F.coalesce("direct", F.lit(0)).alias("direct"), (F.col("others") - F.coalesce("direct", F.lit(0))).alias("transitive"))
    else:
        levels = bfs(reverse(pairs), start)
        counts = levels.groupBy("root").agg(F.count_if(F.col("level") == 1).alias("direct"), F.count_if(F.col("level") > 1).alias("transitive"))
    out = pairs.join(start, pairs.src == start.id).groupBy(F.col("src").alias("root")).agg(F.count("*").alias("fan_out"))
    return counts.join(out, "root", "left").select("root", "direct", "transitive", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), S.risk_class(F.col("direct")).alias("risk"))


def reached_by(axes: dict[str, tuple[DataFrame, float]], start: DataFrame, max_depth: int) -> DataFrame:
    """(root, id, axis, confidence): what depends on the roots along each kind of edges."""
    parts = None
    for name, (edges, confidence) in sorted(axes.items()):
        one = bfs(reverse(edges), start, max_depth).filter("level > 0").select("root", "id", F.lit(name).alias("axis"), F.lit(confidence).alias("confidence"))
        parts = one if parts is None else parts.unionByName(one)
    return materialise(parts, "axes")


def blast_radius(axes: dict[str, tuple[DataFrame, float]], start: DataFrame, max_depth: int = 5) -> DataFrame:
    """(root, affected, confidence, risk, reasons): what depends on the roots along several kinds of edges.

    ``axes``: name -> (edges, confidence). The highest risk counts; two low ones make a medium.
    """
    parts = reached_by(axes, start, max_depth)
    per_axis = parts.groupBy("root", "axis", "confidence").agg(F.count_distinct("id").alias("affected"))
    risks = {"none": 0, "low": 1, "medium": 2, "high": 3}
    risk = S.risk_class(F.col("affected"))
    order = F.create_map(*(F.lit(x) for p in risks.items() for x in p))[risk]
    # Axes that reach nothing still count with weight one.
    every = start.select(F.col("id").alias("root")).join(parts.sparkSession.createDataFrame([(n, c) for n, (_, c) in sorted(axes.items())], "axis string, confidence double").hint("broadcast"))
    full = every.join(per_axis.drop("confidence"), ["root", "axis"], "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    summary = full.groupBy("root").agg(
        F.round(F.sum((F.col("affected") + 1) * F.col("confidence")) / F.sum(F.col("affected") + 1), 2).alias("confidence"), F.max(order).alias("r"), F.count_if(risk == "low").alias("lows")
    )
    # The axes that reach something are the reasons; there are no more of them than axes.
    union = parts.groupBy("root").agg(F.count_distinct("id").alias("affected"), F.array_sort(F.collect_set("axis")).alias("reasons"))
    names = F.array(*(F.lit(n) for n in risks))
    level = F.when((F.col("r") == 1) & (F.col("lows") >= 2), 2).otherwise(F.col("r"))
    return summary.join(union, "root", "left").select("root", F.coalesce("affected", F.lit(0)).alias("affected"), "confidence", F.element_at(names, level.cast("int") + 1).alias("risk"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, length, severity, cycle): of each strongly connected component the shortest cycle through its smallest
    node, the lexicographically least of these, from that node on.

    Distances back to the smallest node are found for all components at once; one walk a component then goes along them.
    """
    strong = materialise(strong_components(edges), "strong")
    a, b = strong.select(F.col("id").alias("src"), "component"), strong.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    inside = edges.filter("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").filter(F.col("component") == F.col("c2")).select("component", "src", "dst")
    inside = materialise(inside, "inside")
    far = materialise(bfs(reverse(inside), strong.select(F.col("component").alias("id")).distinct()).select(F.col("root").alias("component"), F.col("id").alias("dst"), "level"), "far")
    steps = materialise(inside.join(far, ["component", "dst"]), "steps")
    first = steps.filter(F.col("src") == F.col("component")).groupBy("component").agg(F.min(F.struct("level", "dst")).alias("x"))
    walk, (n, _), _ = written(first.select("component", F.array("component", "x.dst").alias("cycle"), F.col("x.dst").alias("place"), F.col("x.level").alias("left")), "walk")
    done = walk.filter("left = 1")
    while n:
        open_walks = walk.filter("left > 1")
        near = open_walks.join(steps.select("component", F.col("src").alias("place"), F.col("dst").alias("next"), "level"), ["component", "place"]).filter(F.col("level") == F.col("left") - 1)
        moved = near.groupBy("component", "cycle", "left").agg(F.min("next").alias("place"))
        walk, (n, _), _ = written(moved.select("component", F.array_append("cycle", F.col("place")).alias("cycle"), "place", (F.col("left") - 1).alias("left")), "walk")
        done = done.unionByName(walk.filter("left = 1")) if n else done
    length = F.size("cycle")
    return done.select("component", length.alias("length"), S.cycle_severity(length).alias("severity"), "cycle")
