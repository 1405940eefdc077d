"""Parent-child links to full hierarchies: weighted disjoint-set forests, merged by rounds of doubling.

A worker puts the links it holds into a forest that keeps, for every node, the top it is known to hang from and the offset
(steps) up to it. Forests of different workers are merged by looking up each top in the other forests and adding the
offsets; every round doubles the reach, so a tree of depth d takes about log2(d) rounds. A round in which no node
reaches a true root shows that only circles, and what hangs below them, are left. Paths are then laid out by the same
lookups, with lists of nodes in place of offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import Shelf, lookup_join, materialise, ship_package


#: Links that a worker holds at once; so many or fewer make one forest, which needs no merging.
LOCAL_LINKS = 500_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(child, parent) links -> (node, top, steps): climbs as far as the partition's own links lead.

    A node on a circle of local links, or below one, has top NULL.
    """
    parent, top = _forest(batches)
    nodes = list(top)
    for at in range(0, len(nodes), 65_536):
        part = nodes[at : at + 65_536]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([top[x][0] for x in part], pa.int64()), pa.array([top[x][1] for x in part], pa.int64())], ["node", "top", "steps"]
        )


def _forest(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, int], dict[int, tuple[int | None, int]]]:
    """parent and (top, steps) of every node."""
    parent: dict[int, int] = {}
    for batch in batches:
        parent.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    top: dict[int, tuple[int | None, int]] = {}
    for start in parent:
        trail, node, seen = [], start, set()
        while node in parent and node not in top and node not in seen:
            seen.add(node)
            trail.append(node)
            node = parent[node]
        root, steps = top.get(node, (None if node in seen else node, 0))
        for x in reversed(trail):
            steps += 1
            top[x] = (root, steps if root is not None else 0)
    return parent, top


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (child, parent) links -> (node, root, depth, path) of the children, by climbing through the index of parents."""
    parent, top = _forest(batches)
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["node", "root", "depth", "path"])

    for node, (root, steps) in top.items():
        path = None if root is None else [node] * (steps + 1)
        up = node
        for i in range(steps - 1, -1, -1):
            up = path[i] = parent[up]
        rows.append((node, -1 if root is None else root, -1 if root is None else steps, path))
        held += steps + 1
        if held >= 65_536:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


def _links(links: DataFrame, child: str, parent: str) -> DataFrame:
    return (
        links.select(F.col(child).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent")).dropna()
        .groupBy("node").agg(F.min("parent").alias("parent"))
    )


def unfollowed(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, parent) of the links that hierarchy() doesn't follow, as a node has more than one parent: all but the smallest."""
    every = links.select(F.col(child).cast("bigint").alias("child"), F.col(parent).cast("bigint").alias("parent")).dropna().distinct()
    kept = every.groupBy("child").agg(F.min("parent").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return every.join(kept, "child").where("parent <> _kept").select("child", "parent")


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root, depth) of every node that has a parent; -1 and -1 for a node on a circle or below one.

    root is the topmost ancestor, depth the steps up to it. Repeated links count once; links with a NULL end are ignored;
    of several parents of a node the smallest is taken (unfollowed() has the links to the others); a node that is its own
    parent is a circle. An empty table gives an empty result. Further columns are ignored. Nodes without a parent aren't
    listed: they are roots at depth 0.
    """
    ship_package(links.sparkSession)
    edges = materialise(_links(links, child, parent), "edges")
    parts_of = edges.count() // local_links + 1
    none = F.lit(-1).cast("bigint")
    if parts_of == 1:  # one forest has it all
        forest = edges.coalesce(1).mapInArrow(_local_forest, "node bigint, top bigint, steps bigint")
        return forest.select("node", F.coalesce("top", none).alias("root"), F.when(F.col("top").isNull(), none).otherwise(F.col("steps")).alias("depth"))
    # neighbours in id tend to be neighbours in the tree: ranges of ids make the local forests deep
    forest = edges.repartitionByRange(parts_of, "node").mapInArrow(_local_forest, "node bigint, top bigint, steps bigint")
    shelf = Shelf("forest")
    latest, left = shelf.add(_mark_roots(materialise(forest, "local_forest"), edges)), -1
    while (now := (open_ := latest.where(_OPEN)).count()) not in (0, left):
        left = now
        known = shelf.read().where(f"not ({_OPEN})").unionByName(open_)
        # the tops of open nodes hang from other nodes: their own tops and steps, each once
        ups = materialise(
            known.join(open_.select(F.col("top").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("rooted").alias("_rooted")), "ups"
        )
        climbed = lookup_join(open_.select("node", "top", "steps"), ups, "top", "inner", open_.select("top"))
        latest = shelf.add(climbed.select("node", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_rooted").alias("rooted")))
    ended = shelf.read().where(f"not ({_OPEN})").unionByName(open_)
    return ended.select("node", F.when(F.col("rooted"), F.col("top")).otherwise(none).alias("root"), F.when(F.col("rooted"), F.col("steps")).otherwise(none).alias("depth"))


#: A node that is neither known to hang from a root nor from a circle.
_OPEN = "not rooted and top is not null"


def _mark_roots(forest: DataFrame, edges: DataFrame) -> DataFrame:
    """forest with rooted: whether the top hangs from no node."""
    tops = forest.select(F.col("top").alias("node")).dropna().distinct()
    hanging = materialise(tops.join(edges.select("node"), "node", "left_semi").select(F.col("node").alias("top"), F.lit(True).alias("hangs")), "hanging")
    return lookup_join(forest, hanging, "top", "left").select("node", "top", "steps", (F.col("top").isNotNull() & F.col("hangs").isNull()).alias("rooted"))


def paths(links: DataFrame, child: str = "child", parent: str = "parent", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root, depth, path) of every node of a link; path runs from the root to the node, as ARRAY<BIGINT>.

    Roots have depth 0 and themselves as path; nodes on a circle or below one have -1, -1 and a NULL path. NULLs, repeats
    and empty tables as in hierarchy(). The parents of a node are looked up through the (node, parent) index: by one worker
    if the links fit into one, else by joins, 1, 2, 4, ... steps at a time.
    """
    ship_package(links.sparkSession)
    edges = materialise(_links(links, child, parent), "edges")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.array("node").alias("path"))
    if edges.count() <= local_links:
        return edges.coalesce(1).mapInArrow(_local_paths, "node bigint, root bigint, depth bigint, path array<bigint>").unionByName(roots)
    known = materialise(hierarchy(edges, "node", "parent", local_links), "hierarchy")
    # (node, up, trail): trail runs from below `up` to node
    shelf = Shelf("trails")
    started = edges.join(known.where("depth > 0").select("node", "root", "depth"), "node")
    latest = shelf.add(started.select("node", "root", "depth", F.col("parent").alias("up"), F.array("node").alias("trail")))
    while not (open_ := latest.where("up <> root")).isEmpty():
        trails = shelf.read().where("up = root").unionByName(open_)
        ups = materialise(
            trails.join(open_.select(F.col("up").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("trail").alias("_trail")), "ups"
        )
        latest = shelf.add(lookup_join(open_, ups, "up", "inner", open_.select("up")).select("node", "root", "depth", F.col("_up").alias("up"), F.concat("_trail", "trail").alias("trail")))
    below = shelf.read().where("up = root").select("node", "root", "depth", F.concat(F.array("root"), "trail").alias("path"))
    circles = known.where("depth < 0").select("node", "root", "depth", F.lit(None).cast("array<bigint>").alias("path"))
    return below.unionByName(circles).unionByName(roots)


def descendants(paths_: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps): every node below every node, from paths()' result; one row each, so no list grows without bound."""
    return (
        paths_.where("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
        .where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("steps"))
    )


def circle_descendants(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(ancestor, descendant, steps) of the nodes on circles and below them, which have no path and so aren't in descendants().

    steps is the fewest from descendant up to ancestor. On a circle every node is an ancestor of every node; its own, as
    many steps up as the circle is long. NULLs, repeats, several parents and empty tables as in hierarchy(). Circles are
    found by jumps of 1, 2, 4, ... steps and cut at their smallest node, which is then a root like any other.
    """
    edges = materialise(_links(links, child, parent), "edges")
    left = materialise(edges.join(hierarchy(edges, "node", "parent").where("depth < 0").select("node"), "node"), "left")
    # the nodes that jumps end on become fewer until only those on circles are left
    jumps, reached = left.select("node", F.col("parent").alias("to")), left.count()
    while (now := (on := materialise(jumps.select(F.col("to").alias("node")).distinct(), "on")).count()) != reached:
        reached = now
        jumps = materialise(lookup_join(jumps, jumps.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to", "inner", jumps).select("node", F.col("_to").alias("to")), "jumps")
    circle = materialise(left.join(on, "node"), "circle")
    # the smallest node seen on the way; once a longer way finds no smaller one, it is the circle's
    seen, changed = circle.select("node", F.col("parent").alias("to"), F.col("node").alias("least")), True
    while changed:
        further = lookup_join(seen, seen.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least")), "to", "inner", seen)
        further = materialise(further.select("node", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("fell")), "least")
        changed, seen = not further.where("fell").isEmpty(), further.select("node", "to", "least")
    cut = hierarchy(circle.join(seen.where("node <> least").select("node"), "node"), "node", "parent")
    places = seen.where("node = least").select("node", F.col("node").alias("circle"), F.lit(0).cast("bigint").alias("at")).unionByName(cut.select("node", F.col("root").alias("circle"), F.col("depth").alias("at")))
    places = materialise(places, "places")
    lengths = places.groupBy("circle").agg(F.count(F.lit(1)).alias("length"))
    below = materialise(paths(left.join(on, "node", "left_anti"), "node", "parent").where("depth > 0"), "below")
    # every node with the node of the circle that it comes to, and the steps up to that
    come = places.select(F.col("node").alias("descendant"), F.col("node").alias("entry"), F.lit(0).cast("bigint").alias("up")).unionByName(
        below.select(F.col("node").alias("descendant"), F.col("root").alias("entry"), F.col("depth").alias("up"))
    )
    come = lookup_join(come, places.select(F.col("node").alias("entry"), "circle", F.col("at").alias("_at")), "entry")
    round_ = F.pmod(F.col("_at") - F.col("at"), F.col("length"))
    steps = F.when(F.col("ancestor") == F.col("descendant"), F.col("length")).otherwise(F.col("up") + round_)
    around = come.join(lookup_join(places, lengths, "circle").select(F.col("node").alias("ancestor"), "circle", "at", "length"), "circle").select("ancestor", "descendant", steps.alias("steps"))
    return around.unionByName(descendants(below).join(places.select(F.col("node").alias("ancestor")), "ancestor", "left_anti"))
