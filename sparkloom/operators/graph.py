"""The concept graph: building, traversal, paths, ordering, importance, communities.

Nodes are (name, ...), edges (src, rel, dst). Iterations run over DataFrames: each
round is one join with the edges and an anti-join with what has been seen, written
to the checkpoint folder so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..columns import counted, first_rows
from ..columns import numbered as placed
from ..session import Scratch, cut_lineage
from . import packed


def build(nodes: DataFrame, edges: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per node name, distinct edges between known nodes, count of skipped edges).

    Of several rows with one name the last by ``order`` counts, as an upsert has it; without
    an order the first by all columns.
    """
    n = upserted(nodes, order) if order else first_rows(nodes, ["name"])
    distinct = edges.select("src", "rel", "dst").distinct()
    kept = distinct.join(n.select(F.col("name").alias("src")), "src", "left_semi").join(n.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")
    skipped = distinct.agg(F.count(F.lit(1)).alias("total")).join(kept.agg(F.count(F.lit(1)).alias("kept"))).select((F.col("total") - F.col("kept")).alias("skipped"))
    return n, kept, skipped


def upserted(nodes: DataFrame, order: str) -> DataFrame:
    """One row per name: the last by ``order``; its attributes replace all earlier ones."""
    from ..sources.sinks import upsert

    return upsert(nodes.limit(0), nodes, ["name"], order)


def merged(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a merge: new attributes win by name, an edge stands once per (src, rel, dst)."""
    from ..sources.sinks import upsert

    return upsert(nodes, new_nodes, ["name"]), edges.select("src", "rel", "dst").unionByName(new_edges.select("src", "rel", "dst")).distinct()


def stubs(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for the triples' endpoints that aren't known yet (names taken as they are spelled)."""
    ends = triples.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti")


def extracted(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(src, rel, dst) from model replies that hold {"triples": [...]}; unknown types are dropped."""
    from ..functions.text import json_object

    t = replies.select(F.inline(json_object(F.col(column), "triples array<struct<source:string,relation:string,target:string>>")["triples"]))
    known = t.where(F.col("relation").isin(schemas.RELATIONSHIP_TYPES) & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    return known.select(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst"))


def canonical(nodes: DataFrame, name: str) -> DataFrame:
    """The node whose name equals ``name`` in any case; of several the first by name."""
    return nodes.where(F.lower("name") == name.lower()).orderBy("name").limit(1)


def _typed(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("rel").isin(types)) if types else edges


def _ways(edges: DataFrame) -> DataFrame:
    """Each edge as a step (a, b) in both directions, repeats included."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def _frontier(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return cut_lineage(found.join(seen.select(*keys), keys, "left_anti"))


def depths(edges: DataFrame, start: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """(name, depth) of all nodes within ``hops`` undirected steps of ``start`` (name).

    The edges are written once; a frontier is counted and, while small, broadcast, so the
    edges of a hop needn't be dealt.
    """
    steps = _ways(cut_lineage(_typed(edges, types).select("src", "dst")) if hops > 1 else _typed(edges, types))
    seen = start.select("name", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        found = steps.join(counted(frontier.select(F.col("name").alias("a"))), "a").select(F.col("b").alias("name")).distinct()
        frontier = _frontier(found.withColumn("depth", F.lit(depth)), seen, ["name"])
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 2, types: list[str] | None = None, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(up to ``most`` nodes by depth and name, all edges that touch a node expanded on the way)."""
    reach = depths(edges, start, hops, types)
    expanded = reach.where(F.col("depth") < hops).select("name")
    own = _typed(edges, types)
    ends = counted(expanded)
    touching = own.join(ends.select(F.col("name").alias("src")), "src", "left_semi").select("src", "rel", "dst").unionByName(own.join(ends.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")).distinct()
    return reach.orderBy("depth", "name").limit(most), touching


def retrieve(edges: DataFrame, start: DataFrame, mode: str = "standard", hops: int = 2) -> tuple[DataFrame, DataFrame]:
    from ..functions.scoring import MODE_TYPES

    return neighbours(edges, start, 4 if mode == "prerequisite" else hops, MODE_TYPES.get(mode))


def similar(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours by one step of a similarity type."""
    return neighbours(edges, start, 1, schemas.SIMILARITY_TYPES)


def use_cases(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours by up to two steps of a usage type."""
    return neighbours(edges, start, 2, schemas.USAGE_TYPES)


def direct(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours by one step of any type."""
    return neighbours(edges, start, 1)


def subgraphs(edges: DataFrame, starts: DataFrame, hops: int = 2, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """The neighbourhoods of many starts at once: (key, name, depth) of up to ``most`` nodes each, (key, src, rel, dst).

    ``starts`` has (key, name, types); a null ``types`` allows every type. All walk in the
    same rounds, so their number costs rows, not jobs.
    """
    own = cut_lineage(edges.select("src", "rel", "dst"))
    allowed = F.col("types").isNull() | F.array_contains("types", F.col("rel"))
    seen = starts.select("key", "name", F.lit(0).alias("depth"))
    frontier, reached = starts.select("key", "name", "types"), []
    for depth in range(1, hops + 1):
        ends = counted(frontier)
        out = own.join(ends, F.col("src") == F.col("name")).where(allowed).select("key", "types", "src", "rel", "dst", F.col("dst").alias("found"))
        back = own.join(ends, F.col("dst") == F.col("name")).where(allowed).select("key", "types", "src", "rel", "dst", F.col("src").alias("found"))
        step = cut_lineage(out.unionByName(back))
        reached.append(step.select("key", "src", "rel", "dst"))
        new = step.select("key", F.col("found").alias("name"), "types").dropDuplicates(["key", "name"])
        frontier = _frontier(new, seen, ["key", "name"])
        seen = seen.unionByName(frontier.select("key", "name", F.lit(depth).alias("depth")))
    touching = reached[0]
    for step in reached[1:]:
        touching = touching.unionByName(step)
    first = Window.partitionBy("key").orderBy("depth", "name")
    return seen.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most).drop("rn"), touching.distinct()


def compare(edges: DataFrame, a: DataFrame, b: DataFrame, hops: int = 2, types: tuple[str, ...] = ("REQUIRES", "IS_A")) -> DataFrame:
    """(side, name): neighbours that two nodes share or that only one has."""
    own = cut_lineage(_typed(edges, list(types)))
    one, two = (depths(own, s, hops).where("depth > 0").select("name") for s in (a, b))
    marked = one.withColumn("in_a", F.lit(1)).join(two.withColumn("in_b", F.lit(1)), "name", "full")
    return marked.select(F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("shared").alias("side"), "name")


def shown(compared: DataFrame, most: int = 8) -> DataFrame:
    """(side, names): the first names of each side of a comparison, as a list to show."""
    first = compared.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy("name"))).where(F.col("rn") <= most)
    return first.groupBy("side").agg(F.array_sort(F.collect_list("name")).alias("names"))


def closure(edges: DataFrame, start: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Everything reachable along outgoing edges, the start not included unless a cycle returns to it."""
    steps = cut_lineage(_typed(edges, types if types is not None else schemas.PREREQUISITE_TYPES).select("src", "dst"))
    seen = None
    frontier = start.select("name")
    while True:
        found = steps.join(counted(frontier.select(F.col("name").alias("src"))), "src").select(F.col("dst").alias("name")).distinct()
        frontier = cut_lineage(found if seen is None else found.join(seen, "name", "left_anti"))
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
    return seen if seen is not None else start.select("name").limit(0)


def paths(edges: DataFrame, source: str, target: str, types: list[str] | None = None) -> DataFrame:
    """(place, name) from source to target over undirected edges, each node reached from its first parent by
    name; over all types where the prerequisite types don't connect them; else just the two names.

    A frontier row carries the way it came; nodes seen before carry their names only.
    """
    spark = edges.sparkSession
    every = cut_lineage(edges.select("src", "rel", "dst"))
    way = None
    for chosen in (types if types is not None else schemas.PREREQUISITE_TYPES, None):
        steps = _ways(_typed(every, chosen))
        frontier = spark.createDataFrame([(source, [source])], "name string, way array<string>")
        seen = frontier.select("name")
        while True:
            found = steps.join(counted(frontier.withColumnRenamed("name", "a")), "a").groupBy(F.col("b").alias("name")).agg(F.min_by("way", "a").alias("way"))
            frontier = _frontier(found.select("name", F.concat("way", F.array("name")).alias("way")), seen, ["name"])
            there = frontier.where(F.col("name") == target)
            if not there.isEmpty():
                way = there.select("way")
                break
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.select("name"))
        if way is not None:
            break
    if way is None:
        way = spark.createDataFrame([([source, target],)], "way array<string>")
    return way.select(F.posexplode("way").alias("place", "name"))


def shortest_path(edges: DataFrame, source: str, target: str, types: list[str] | None = None) -> list[str]:
    """The names of ``paths`` in order."""
    return [r["name"] for r in paths(edges, source, target, types).orderBy("place").collect()]  # one row per step


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(name, part): for each node on a cycle the least name of its strongly connected part; other nodes have no row.

    Nodes that nothing leads to, or that lead nowhere, are trimmed. Of the rest each takes the
    least name that reaches it, until nothing changes; a node that kept its own is a root, and
    what leads to it inside its colour is its part. Parts found are taken out and the rest goes
    round again. Each loop ends when it changes nothing.
    """
    with Scratch(edges.sparkSession) as scratch:
        keep = scratch.kept
        left = keep(edges.select("src", "dst").where("src <> dst").distinct())
        found = keep(left.select(F.col("src").alias("name"), F.col("src").alias("part")).limit(0))
        while True:
            left, size = _trimmed(left, keep)
            if not size:
                break
            colour = keep(left.select(F.col("src").alias("name")).distinct().select("name", F.col("name").alias("part")))
            while True:
                sent = left.join(colour.select(F.col("name").alias("src"), "part"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("part").alias("came"))
                grown = keep(colour.join(sent, "name", "left").select("name", F.least("part", "came").alias("part"), (F.col("came") < F.col("part")).alias("new")))
                colour = grown.select("name", "part")
                if grown.where("new").isEmpty():
                    break
            inside = keep(left.join(colour.select(F.col("name").alias("src"), "part"), "src").join(colour.select(F.col("name").alias("dst"), F.col("part").alias("other")), "dst").where("part = other").select("src", "dst", "part"))
            own = front = keep(colour.where("name = part"))
            while not front.isEmpty():
                back = inside.join(front.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name"), "part").distinct()
                front = keep(back.join(own, "name", "left_anti"))
                own = own.unionByName(front)
            own = keep(own)
            found = found.unionByName(own)
            left = keep(left.join(own.select(F.col("name").alias("src")), "src", "left_anti").join(own.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst"))
        # Roots that only trimming would have taken (alone in their part) lie on no cycle.
        alone = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        return cut_lineage(found.join(alone, "part", "left_anti").select("name", "part"))


def _trimmed(left: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Edges without those at nodes that nothing leads to or that lead nowhere, and their number."""
    size = left.count()
    while size:
        left = keep(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == size:
            break
        size = now
    return left, size


def curriculum(edges: DataFrame, target: DataFrame, known: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(level, name): prerequisites first, each behind all that it needs; known ones left out, the target last.

    Rounds peel off what needs nothing more, until nothing is left. Nodes that need each other (a
    cycle) stand together: where peeling stops at cycles, each strongly connected part counts as
    one node from there on.
    """
    chosen = types if types is not None else schemas.PREREQUISITE_TYPES
    inside = cut_lineage(closure(edges, target, chosen).unionByName(target.select("name")).distinct())
    ends = inside.select(F.col("name").alias("dst"))
    needs = cut_lineage(_typed(edges, chosen).select("src", "dst").distinct().where("src <> dst").join(inside.select(F.col("name").alias("src")), "src", "left_semi").join(ends, "dst", "left_semi"))
    with Scratch(edges.sparkSession) as scratch:
        keep = scratch.kept
        # ``node`` is a name, or the part that stands for it once cycles are joined.
        member = keep(inside.select("name", F.col("name").alias("node")))
        left, needs, out, level = keep(member.select("node")), keep(needs), None, 0
        while True:
            ready = keep(left.join(needs.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
            if ready.isEmpty():
                if left.isEmpty():
                    break
                # Every node left needs something: cycles, and what stands behind them.
                parts = strongly_connected(needs)
                to = lambda df, c: df.join(parts.select(F.col("name").alias(c), "part"), c, "left").withColumn(c, F.coalesce("part", c)).drop("part")  # noqa: B023, E731
                member, left = keep(to(member, "node")), keep(to(left, "node").distinct())
                needs = keep(to(to(needs, "src"), "dst").where("src <> dst").distinct().select("src", "dst"))
                continue
            out = ready if out is None else out.unionByName(ready)
            left = keep(left.join(ready, "node", "left_anti").select("node"))
            needs = keep(needs.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
            level += 1
        levels = cut_lineage(member.join(out, "node").select("name", "level")) if out is not None else inside.select("name", F.lit(0).alias("level")).limit(0)
    last = levels.agg((F.max("level") + 1).alias("last"))
    goal = target.select("name").withColumn("is_target", F.lit(True))
    placed = levels.join(goal, "name", "left").join(F.broadcast(last))
    drop = [k.lower() for k in known or []]
    shown = placed.where(F.col("is_target").isNotNull() | ~F.lower("name").isin(drop)) if drop else placed
    return shown.select(F.when(F.col("is_target"), F.col("last")).otherwise(F.col("level")).alias("level"), "name")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """(name, score), the highest score 1. Parallel edges add weight; nodes without a way out share theirs evenly.

    What such nodes share raises all scores by one factor, as the even start does, and the
    scaling to the highest takes it out again. So the scores are the sum of what an even start
    sends on in each round, damped: x = 1 + d P'1 + (d P')^2 1 + ... A round joins what was
    sent last with the links, which are dealt by source once; it ends when a round sends less
    than ``tolerance`` per node in the mean, after ``rounds`` rounds at most.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = nodes.select("name").distinct()
    share = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).repartition(parts, "src").select("src", "dst", share.alias("part"))
    links = cut_lineage(weighted.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").repartition(parts, "src"))
    sent = cut_lineage(names.withColumn("r", F.lit(1.0)))
    n, held = sent.count(), [sent]
    for _ in range(rounds):
        sent = cut_lineage(sent.join(links, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg((damping * F.sum(F.col("r") * F.col("part"))).alias("r")))
        held.append(sent)
        if (sent.agg(F.sum("r")).first()[0] or 0) <= tolerance * n:
            break
        if len(held) > 16:
            held = [cut_lineage(_summed(held))]
    rank = _summed(held)
    top = rank.agg(F.max("r").alias("top"))
    return rank.join(F.broadcast(top)).select("name", (F.col("r") / F.col("top")).alias("score"))  # top is one row


def _summed(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("name").agg(F.sum("r").alias("r"))


def heatmap(nodes: DataFrame, edges: DataFrame, top_types: int = 4) -> DataFrame:
    """Edge counts for every pair of categories (0 where there are none) and their commonest types."""
    kind = nodes.select("name", "category")
    pairs = edges.join(kind.withColumnsRenamed({"name": "src", "category": "from_cat"}), "src").join(kind.withColumnsRenamed({"name": "dst", "category": "to_cat"}), "dst")
    counts = pairs.groupBy("from_cat", "to_cat", "rel").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("from_cat", "to_cat").orderBy(F.desc("n"), "rel")))
    cells = ranked.groupBy("from_cat", "to_cat").agg(F.sum("n").alias("cnt"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= top_types, F.struct("rn", "rel")))), lambda x: x["rel"]), ",").alias("top_types"))
    present = kind.select("category").distinct()
    grid = present.select(F.col("category").alias("from_cat")).join(counted(present.select(F.col("category").alias("to_cat"))))
    return grid.join(cells, ["from_cat", "to_cat"], "left").select("from_cat", "to_cat", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), F.coalesce("top_types", F.lit("")).alias("top_types"))


def category_rollup(nodes: DataFrame, scores: DataFrame, missing: float = 0.01) -> DataFrame:
    """Counts and score sums by node, category and in all (the levels of a sunburst)."""
    both = nodes.join(scores, "name", "left").select("category", "name", F.coalesce("score", F.lit(missing)).alias("score"))
    return both.rollup("category", "name").agg(F.grouping_id().alias("lvl"), F.count(F.lit(1)).alias("cnt"), F.round(F.sum("score"), 6).alias("total"))


def incident(edges: DataFrame, name: str) -> DataFrame:
    """A node's edges by type and direction, the other ends listed."""
    own = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return own.groupBy("rel", F.when(F.col("src") == name, "out").otherwise("in").alias("direction")).agg(F.array_sort(F.collect_list(F.when(F.col("src") == name, F.col("dst")).otherwise(F.col("src")))).alias("others"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


#: Links (both ways) of a graph that one task takes over.
FINISH_LINKS = 50_000
#: Parallel rounds before communities are contracted to nodes.
LEVEL_ROUNDS = 2


def communities(edges: DataFrame, least: int = 3, resolution: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    """(community_id, size, name): greedy modularity, level by level, ids by size.

    While the graph has more than ``FINISH_LINKS`` links, a level moves nodes in parallel for a few
    rounds (``_moved``) and contracts each community to one node of the next level's graph. A
    graph of that size or less is left to one task, which moves its nodes in turn, level by level,
    until nothing moves (``in_turn``). Then the communities are refined: the
    nodes of the whole graph may change over again, one by one, in parallel rounds until a round
    gains less than ``tolerance`` of what these have gained. Every step raises modularity, so the
    labelling at hand is always the best one so far.
    """
    with Scratch(edges.sparkSession) as scratch:
        keep = scratch.kept
        names, whole = _hashed(edges, keep)
        alone = lambda of: of.select(F.col("a").alias("name"), F.col("a").alias("c"))
        first = level = packed.pack(whole, whole.count(), keep)
        total, count = first.size()
        links, degrees = None, keep(first.degrees())
        own, label, moves = degrees, alone(degrees), 1 if total else 0
        while moves:
            if count <= FINISH_LINKS:
                links = packed.lifted(level, label) if links is None else links
                up, moves = _finished(links, total, resolution).toDF("name", "c"), 0
            else:
                if level is None:
                    level = packed.pack(links, count, keep)
                    degrees = keep(level.degrees())
                up, moves = _moved_numbers(degrees, level, total, alone(degrees), resolution, tolerance, keep, LEVEL_ROUNDS)
                links, level = keep(packed.lifted(level, up)), None
                count = links.count()
            label = keep(label.join(up.select(F.col("name").alias("c"), F.col("c").alias("to")), "c").select("name", F.col("to").alias("c")))
        found = _moved_numbers(own, first, total, label, resolution, tolerance, keep)[0] if total else label
        found = cut_lineage(_by_name(found, names))
    return numbered(found.withColumnRenamed("c", "community"), least)


def _hashed(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((name, id), (a, b, w)): each edge as links both ways between numbers that are hashes of the names; nothing is joined.

    Should two names have one hash, nodes are numbered by name instead.
    """
    own = keep(edges.where("src <> dst").select("src", "dst"))
    ends = own.select(F.col("src").alias("name")).unionByName(own.select(F.col("dst").alias("name"))).distinct()
    names = keep(ends.select("name", _hash("name").alias("id")))
    if names.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        links = own.select(_hash("src").alias("a"), _hash("dst").alias("b"))
    else:
        names, links = _by_number(own.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("w")), keep)
        links = keep(links.select("a", "b"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return names, links.select(F.inline(both), F.lit(1.0).alias("w"))


def _hash(name: str) -> Column:
    return F.xxhash64(name)


def _by_number(links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((name, id), (a, b, w)): nodes numbered by name, links between numbers."""
    ends = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    names = keep(placed(ends, ["name"], "id"))
    own = links.join(names.select(F.col("name").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("name").alias("b"), F.col("id").alias("y")), "b")
    return names, own.select(F.col("x").alias("a"), F.col("y").alias("b"), "w")


def _by_name(label: DataFrame, names: DataFrame) -> DataFrame:
    own = label.toDF("id", "to").join(names, "id").select("name", F.col("to").alias("id"))
    return own.join(names.withColumnRenamed("name", "c"), "id").select("name", "c")


def _finished(links: DataFrame, total: float, resolution: float) -> DataFrame:
    """(c, to): the communities that the nodes of a contracted graph of bounded size end in, by one task."""

    def run(rows):  # type: ignore[no-untyped-def]
        import pandas as pd

        found = in_turn(zip(rows["a"], rows["b"], rows["w"].tolist(), strict=True), float(total), resolution)
        return pd.DataFrame({"c": list(found), "to": list(found.values())})

    return links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "c long, to long")


def in_turn(links, total: float, resolution: float = 1.0) -> dict:  # type: ignore[no-untyped-def]
    """Community of each node after greedy moves of one node after another, then of whole communities, until nothing moves."""
    beside: dict[str, dict[str, float]] = {}
    for a, b, w in links:
        beside.setdefault(a, {})[b] = w
    group = {a: a for a in beside}  # a node of the input -> its node at this level
    label = dict(group)
    while True:
        degree = {a: sum(ws.values()) for a, ws in beside.items()}
        mass: dict[str, float] = {}
        for a, c in label.items():
            mass[c] = mass.get(c, 0.0) + degree[a]
        any_moved, moved = False, True
        while moved:
            moved = False
            for a in sorted(beside):
                kin: dict[str, float] = {}
                for b, w in beside[a].items():
                    if b != a:
                        kin[label[b]] = kin.get(label[b], 0.0) + w
                own = label[a]
                mass[own] -= degree[a]
                best, most = own, kin.get(own, 0.0) - resolution * degree[a] * mass[own] / total
                for c in sorted(kin):
                    worth = kin[c] - resolution * degree[a] * mass[c] / total
                    if worth > most + 1e-9:
                        best, most = c, worth
                mass[best] += degree[a]
                if best != own:
                    label[a], moved, any_moved = best, True, True
        group = {a: label[g] for a, g in group.items()}
        if not any_moved:
            return group
        lifted: dict[str, dict[str, float]] = {}
        for a, ws in beside.items():
            row = lifted.setdefault(label[a], {})
            for b, w in ws.items():
                row[label[b]] = row.get(label[b], 0.0) + w
        beside = lifted
        label = {c: c for c in beside}


def _weighted(edges: DataFrame) -> DataFrame:
    """(a, b, w) both ways; self-loops don't count."""
    return _ways(edges.where("src <> dst")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def _degrees(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("a").alias("name")).agg(F.sum("w").alias("k"))


def _lifted(links: DataFrame, label: DataFrame) -> DataFrame:
    """The links between communities; those within one become its self-loop."""
    far = label.select(F.col("name").alias("b"), F.col("c").alias("to"))
    return links.join(label.select(F.col("name").alias("a"), "c"), "a").join(far, "b").groupBy(F.col("c").alias("a"), F.col("to").alias("b")).agg(F.sum("w").alias("w"))


def modularity_of(links: DataFrame, label: DataFrame | None, total: float, resolution: float = 1.0) -> float:
    """Modularity of a labelling of ``links`` (a, b, w) both ways; without labels each node is its own community."""
    if not total:
        return 0.0
    own = links if label is None else _lifted(links, label)
    sizes = own.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside"))
    return sizes.agg(F.sum(F.col("inside") / total - resolution * (F.col("k") / total) ** 2)).first()[0] or 0.0


#: Levels of a node's turn; a node is on level l or above with probability 2^-l.
_TURNS = 40


def _moved(links: DataFrame, total: float, label: DataFrame, resolution: float, tolerance: float, keep: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> tuple[DataFrame, int]:
    """((name, c), moves made) after one level of moves; every round raises modularity.

    A round lets nodes out of half the communities, drawn anew each round, into the other half.
    So no two moves cost each other a link: a neighbour that leaves with a node, or enters beside
    it, only adds to its gain. What they do cost each other is room: a node counts the weight of
    all that enter its target or leave its community in turn before it or with it, and goes only
    if its gain outweighs that. Turns are drawn too, on levels that get twice as rare each, so
    those that come first are few, and the sums are over some forty numbers per community,
    however large it is. The gains of all that go add up to at most what modularity grows by.

    It ends after ``rounds`` rounds, or two in a row that gain less than ``tolerance`` of what all
    have gained. ``keep`` writes a table.
    """
    names, own = _by_number(links, keep)
    own = keep(own.withColumn("w", F.col("w").cast("double")))
    ids = names.select(F.col("name").alias("c"), F.col("id").alias("to"))
    start = keep(label.join(names, "name").join(ids, "c").select(F.col("id").alias("name"), F.col("to").alias("c")))
    found, moves = _moved_numbers(own, packed.pack(own, own.count(), keep), total, start, resolution, tolerance, keep, rounds)
    return _by_name(found, names), moves


def _moved_numbers(links: DataFrame, level: packed.Packed, total: float, label: DataFrame, resolution: float, tolerance: float, keep: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> tuple[DataFrame, int]:
    """``_moved`` for numbered nodes and their packed links; of ``links`` only the sums by node count (a, w)."""
    label = keep(label.join(_degrees(links), "name").select("name", "c", "k", F.lit(0.0).alias("gain")))
    idle, step, moves, reached = 0, 0, 0, 0.0
    while idle < 2 and step != rounds:
        size = label.groupBy("c").agg(F.sum("k").alias("tot"))
        state = label.select("name", "c").join(size, "c")
        left = packed.wishes(level, state, float(total), resolution, step)
        draw = F.pmod(F.xxhash64("a", F.lit(step)), F.lit(1 << _TURNS)) + 1
        turn = F.floor(F.lit(float(_TURNS)) - F.log2(draw.cast("double"))).cast("int")
        wants = keep(left.withColumn("turn", turn))
        sums = wants.select(F.explode(F.array("to", "own")).alias("c"), "turn", "k").groupBy("c", "turn").agg(F.sum("k").alias("k"))
        so_far = sums.select("c", "turn", F.sum("k").over(Window.partitionBy("c").orderBy(F.desc("turn"))).alias("mass"))
        entered = so_far.select(F.col("c").alias("to"), "turn", F.col("mass").alias("entered"))
        gone = so_far.select(F.col("c").alias("own"), "turn", F.col("mass").alias("gone"))
        sure = wants.join(entered, ["to", "turn"]).join(gone, ["own", "turn"])
        go = sure.withColumn("gain", F.col("gain") - resolution * F.col("k") * (F.col("entered") + F.col("gone") - 2 * F.col("k")) / total).where("gain > 1e-9").select(F.col("a").alias("name"), "to", F.col("gain").alias("won"))
        label = keep(label.join(go, "name", "left").select("name", F.coalesce("to", "c").alias("c"), "k", F.coalesce("won", F.lit(0.0)).alias("gain")))
        made, gained = label.agg(F.count_if(F.col("gain") > 0), F.coalesce(F.sum("gain"), F.lit(0.0))).first()  # type: ignore[misc]
        moves, reached, step = moves + made, reached + gained, step + 1
        idle = idle + 1 if gained <= tolerance * reached else 0
    return label.select("name", "c"), moves


def numbered(labels: DataFrame, least: int = 3) -> DataFrame:
    """Communities of ``least`` members or more, numbered by size (ties: first member)."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first")).where(F.col("size") >= least)
    ids = placed(sizes, [F.desc("size"), F.col("first")], "community_id").select("community", "size", F.col("community_id").cast("int").alias("community_id"))
    return labels.join(ids, "community").select("community_id", "size", "name")


def top_members(members: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """Each community's ``n`` members with the highest score (ties: by name), with their place."""
    ranked = members.join(scores.select("name", "score"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("score"), "name"))).where(F.col("rn") <= n).select("community_id", "name", "score", "rn")


def summary_prompts(members: DataFrame, scores: DataFrame, concepts: DataFrame, n: int = 10) -> DataFrame:
    """(community_id, node_names, details): all members by name, and the best-ranked ones with their definitions."""
    line = F.concat(F.lit("- "), "name", F.coalesce(F.concat(F.lit(": "), "definition"), F.lit("")))
    told = top_members(members, scores, n).join(concepts.select("name", "definition"), "name", "left").groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("ls"))
    names = members.groupBy("community_id").agg(F.array_sort(F.collect_list("name")).alias("node_names"))
    return names.join(told, "community_id").select("community_id", "node_names", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("details"))


def summaries(members: DataFrame) -> DataFrame:
    """The fallback summary of each community: its size and first five members."""
    grouped = members.groupBy("community_id").agg(F.array_sort(F.collect_list("name")).alias("node_names"))
    return grouped.withColumn("summary", _fallback())


def _fallback() -> Column:
    return F.concat(F.lit("Community of "), F.size("node_names").cast("string"), F.lit(" AI concepts: "), F.array_join(F.slice("node_names", 1, 5), ", "), F.lit("."))


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (name), each once."""
    ends = nodes.select("name").distinct()
    own = edges.join(ends.select(F.col("name").alias("src")), "src", "left_semi").join(ends.select(F.col("name").alias("dst")), "dst", "left_semi")
    return own.select("src", "rel", "dst").distinct()


def listed(concepts: DataFrame, scores: DataFrame, categories: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    """Concepts that meet the filters given, with their score (0 where there is none), best first."""
    own = concepts
    if categories:
        own = own.where(F.col("category").isin(categories))
    if difficulties:
        own = own.where(F.col("difficulty").isin(difficulties))
    return own.join(scores.select("name", "score"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "name")


def enriched(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """The concepts of a path, subgraph or ordering, its own columns kept."""
    return names.join(concepts, "name")


def at_hop(reach: DataFrame, hop: int) -> DataFrame:
    return reach.where(F.col("depth") == hop)


def drawn(nodes: DataFrame, edges: DataFrame, scores: DataFrame, highlight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a network drawing needs: nodes with size and highlight, edges with both ends present."""
    from ..functions.text import node_size

    own = first_rows(nodes, ["name"]).join(scores.select("name", "score"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    top = own.agg(F.greatest(F.max("score"), F.lit(1e-12)).alias("top"))
    sized = own.join(F.broadcast(top)).withColumn("size", node_size(F.col("score"), F.col("top"))).drop("top")
    return sized.withColumn("highlighted", F.col("name") == F.lit(highlight or "")), edges_within(edges, own)


def ingest(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all nodes, all edges, counts) after triples come in: unknown ends become stub nodes first.

    Counts have the triples, the new nodes and the relationships written, repeats included.
    """
    new = stubs(triples, nodes)
    grown = nodes.select("name").unionByName(new)
    written = triples.agg(F.count(F.lit(1)).alias("triples"), F.count(F.lit(1)).alias("new_relationships"))
    return grown, edges.unionByName(triples).distinct(), written.join(new.agg(F.count(F.lit(1)).alias("new_concepts")))


def chunk_counts(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """How many chunks a resumed run takes and how many it skips."""
    marked = chunks.select("chunk_id").join(done.select("chunk_id").distinct().withColumn("done", F.lit(1)), "chunk_id", "left")
    return marked.agg(F.count_if(F.col("done").isNull()).alias("chunks_processed"), F.count("done").alias("chunks_skipped"))


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose id isn't among those done: where a resumed run goes on."""
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def with_summaries(communities: DataFrame, cached: DataFrame) -> DataFrame:
    """Communities (community_id, node_names) with a cached summary of the same members, else the fallback.

    Keyed by a digest of the members: ids are dealt anew at each detection, members aren't.
    """
    key = F.sha2(F.array_join(F.array_sort("node_names"), "\u0001"), 256)
    known = cached.select(key.alias("key"), F.col("summary").alias("cached"))
    return communities.select("community_id", "node_names", key.alias("key")).join(known, "key", "left").select("community_id", "node_names", F.coalesce("cached", _fallback()).alias("summary"))


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:  # type: ignore[no-untyped-def]
    """Nodes and edges as written by ``sinks.write_graph``."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
