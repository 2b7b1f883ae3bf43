"""Parent-child links turned into full hierarchies: ancestors with steps, paths, depths, roots, cycles.

Most nodes have one parent, so the links are almost a forest.  Nodes with several parents, and one node of every cycle
of single-parent nodes, are cut from their parents and become tree roots; what is left is a forest.

* Cycles are exposed by peeling leaves, 2^k layers in round k: round k squares the parent function and keeps the nodes
  that still have something below them.  What never peels off lies on a cycle.
* The forest becomes one Euler tour; parallel list ranking gives every node its entry, exit and depth, and a node's
  ancestors are the nodes whose interval holds its entry, found by an equi-join on blocks of the tour.
* The cut links form a small graph between trees.  Its fewest-steps closure takes log rounds of min-plus squaring, and
  joining it with the intervals gives the ancestors beyond a tree's root, those over several parents and round cycles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.plans.list_ranking import ONE_TASK, next_in_order, suffix_sums
from quillon.plans.skew import join_unique
from quillon.runtime import drop, materialise

#: Tour positions per block of the interval join.
BLOCK = 128
#: Nodes below one cut root that one task joins with the root's own ancestors.
BELOW = 100_000


@dataclass
class Forest:
    """``nodes`` (n, id), ``edges`` (child, parent), ``tour`` (n, entry, exit, depth), ``up`` (n, above, steps, depth: the
    node itself and its ancestors in its tree, the tree's root where steps equal depth), ``cut`` (root, entry: links cut from roots with parents), ``pairs`` (n,
    ancestor, steps)."""

    nodes: DataFrame
    edges: DataFrame
    tour: DataFrame
    up: DataFrame
    cut: DataFrame
    pairs: DataFrame


def latest(df: DataFrame, node: str, parents: str, version: list[str]) -> DataFrame:
    """(id, parents): each id as its row of greatest ``version`` columns, nulls least."""
    rows = df.select(clean_id(node).alias("id"), F.col(parents).alias("parents"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(version))).where("id is not null")
    newest = Window.partitionBy("id").orderBy(*(F.col(f"v{i}").desc_nulls_last() for i in range(len(version))))
    return rows.withColumn("newest", F.row_number().over(newest)).where("newest = 1").select("id", "parents")


def _links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with numbers, and their distinct links by number to parents that are nodes."""
    found, _ = materialise(found.withColumn("n", F.monotonically_increasing_id()), "nodes")
    nodes = found.select("n", "id")
    named = found.select(F.col("n").alias("child"), F.explode("parents").alias("p")).select("child", clean_id("p").alias("id")).where("id is not null")
    links = named.agg(F.count("*")).first()[0]
    edges, _ = materialise(join_unique(named.distinct(), nodes, "id", links).select("child", F.col("n").alias("parent")), "edges")
    return nodes, edges


def _cycle_cuts(single: DataFrame, nodes: DataFrame) -> DataFrame:
    """One node, that of the least id, of every cycle of (child, parent) with one parent each."""
    spark = single.sparkSession
    # v, the node 2^k links above it, and the least node on the way there
    jump, path = materialise(single.select(F.col("child").alias("v"), F.col("parent").alias("to"), F.least("child", "parent").alias("least")), "peel")
    size, moved, peeled = jump.count(), 1, 1
    while size and (moved or peeled):
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        # keep what has something 2^k below it, then square the function; once nothing goes, all lie on cycles
        kept = jump.join(jump.select(F.col("to").alias("v")).distinct(), "v", "left_semi") if peeled else jump
        step = join_unique(kept, ahead, "to", size).select("v", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved"))
        step, newer = materialise(step, "peel")
        before = size
        size, moved = step.agg(F.count("*"), F.count_if("moved")).first()
        peeled = before - size
        drop(spark, path)
        jump, path = step.drop("moved"), newer
    named = jump.select(F.col("v").alias("n"), "least").join(nodes, "n")
    return named.groupBy("least").agg(F.min_by("n", "id").alias("child")).select("child")


def _tour(nodes: DataFrame, tree: DataFrame, one_task: int) -> DataFrame:
    """Entry, exit and depth of every node of the forest ``tree`` (child, parent), as one tour below a virtual root."""
    under = nodes.select(F.col("n").alias("child")).join(tree, "child", "left").select(F.coalesce("parent", F.lit(-1).cast("bigint")).alias("parent"), "child")
    ordered, path = materialise(next_in_order(under, ["parent", "child"]), "siblings")
    first = under.groupBy("parent").agg(F.min("child").alias("first"))
    down = under.join(first.select(F.col("parent").alias("child"), "first"), "child", "left").select((F.col("child") * 2).alias("element"), F.coalesce(F.col("first") * 2, F.col("child") * 2 + 1).alias("after"), F.lit(1).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("delta"))
    up = ordered.select((F.col("child") * 2 + 1).alias("element"), F.when(F.col("next_parent") == F.col("parent"), F.col("next_child") * 2).when(F.col("parent") < 0, F.lit(-1).cast("bigint")).otherwise(F.col("parent") * 2 + 1).alias("after"), F.lit(1).cast("bigint").alias("length"), F.lit(-1).cast("bigint").alias("delta"))
    sums = suffix_sums(down.unionByName(up), one_task)
    n = F.floor(F.col("element") / 2).cast("bigint").alias("n")
    side = F.col("element") % 2
    total = nodes.count() * 2
    # everything after an element sums to minus what came before it, since a tour ends at the depth at which it began
    tour = sums.groupBy(n).agg(
        F.max(F.when(side == 0, F.lit(total) - F.col("length"))).alias("entry"),
        F.max(F.when(side == 1, F.lit(total) - F.col("length"))).alias("exit"),
        F.max(F.when(side == 0, -F.col("delta"))).cast("int").alias("depth"),
    )
    tour, _ = materialise(tour, "tour")
    drop(nodes.sparkSession, path)
    return tour


def _within_tree(tour: DataFrame) -> DataFrame:
    """(n, above, steps, depth): each node with itself and its ancestors in its tree, by interval containment."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    below = tour.select("n", "entry", "depth", block("entry").alias("block"))
    inner = tour.where("exit > entry + 1").select(F.col("n").alias("above"), F.col("entry").alias("from"), F.col("exit").alias("until"), F.col("depth").alias("top"), F.explode(F.sequence(block("entry"), block("exit"))).alias("block"))
    held = below.join(inner, "block").where("entry > from and entry < until").select("n", "above", (F.col("depth") - F.col("top")).alias("steps"), "depth")
    return tour.select("n", F.col("n").alias("above"), F.lit(0).alias("steps"), "depth").unionByName(held)


def _between_trees(cut: DataFrame, up: DataFrame) -> DataFrame:
    """(root, entry, steps): the fewest steps from each cut root to every node at which a path enters another tree."""
    spark = cut.sparkSession
    tops = up.where("steps = depth").select(F.col("n").alias("entry"), F.col("above").alias("next"), "steps")
    cut_roots = cut.select(F.col("root").alias("next")).distinct()
    links = cut.count()
    hop = join_unique(join_unique(cut, tops, "entry", links), cut_roots, "next", links).groupBy("root", "next").agg(F.min(F.col("steps") + 1).alias("cost"))
    far, path = materialise(hop, "between")
    state = far.agg(F.count("*"), F.sum("cost")).first()
    while state[0]:
        ahead = far.select(F.col("root").alias("next"), F.col("next").alias("next2"), F.col("cost").alias("cost2"))
        twice = far.join(ahead, "next").select("root", F.col("next2").alias("next"), (F.col("cost") + F.col("cost2")).alias("cost"))
        wider, newer = materialise(far.unionByName(twice).groupBy("root", "next").agg(F.min("cost").alias("cost")), "between")
        drop(spark, path)
        far, path = wider, newer
        before, state = state, far.agg(F.count("*"), F.sum("cost")).first()
        if tuple(before) == tuple(state):
            break
    here = cut.select("root", F.col("root").alias("next"), F.lit(0).alias("cost")).distinct()
    doors = cut.select(F.col("root").alias("next"), "entry")
    return here.unionByName(far).join(doors, "next").groupBy("root", "entry").agg(F.min(F.col("cost") + 1).alias("steps"))


def build_forest(found: DataFrame, one_task: int = ONE_TASK) -> Forest:
    """The hierarchy of (id, parents), ids distinct; see ``ancestors``."""
    nodes, edges = _links(found)
    counted = edges.withColumn("of", F.count("*").over(Window.partitionBy("child")))
    single = counted.where("of = 1").select("child", "parent")
    cuts, _ = materialise(counted.where("of > 1").select("child").distinct().unionByName(_cycle_cuts(single, nodes)), "cuts")
    cut, _ = materialise(edges.join(cuts, "child", "left_semi").select(F.col("child").alias("root"), F.col("parent").alias("entry")), "cut")
    tour = _tour(nodes, edges.join(cuts, "child", "left_anti"), one_task)
    up, _ = materialise(_within_tree(tour), "up")

    doors = _between_trees(cut, up)
    beyond = doors.join(up.select(F.col("n").alias("entry"), "above", F.col("steps").alias("more")), "entry").groupBy("root", "above").agg(F.min(F.col("steps") + F.col("more")).alias("more"))
    beyond, _ = materialise(beyond, "beyond")
    # a large tree is split among tasks, each with a copy of what lies beyond its root; there are few large ones
    size = tour.where("depth = 0").select(F.col("n").alias("root"), F.ceil((F.col("exit") - F.col("entry") + 1) / (2 * BELOW)).cast("int").alias("parts"))
    large = F.broadcast(size.where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    with_parts = beyond.join(large, "root", "left").select("root", "above", "more", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    below = up.where("steps = depth").select("n", F.col("above").alias("root"), "steps").join(large, "root", "left").withColumn("part", F.pmod(F.xxhash64("n"), parts).cast("int"))
    over = below.join(with_parts, ["root", "part"]).select("n", "above", (F.col("steps") + F.col("more")).alias("steps"))
    pairs = up.where("steps > 0").drop("depth").unionByName(over).groupBy("n", F.col("above").alias("ancestor")).agg(F.min("steps").alias("steps"))
    return Forest(nodes, edges, tour, up, cut, pairs)


def ancestors(df: DataFrame, node: str, parents: str, version: list[str], one_task: int = ONE_TASK) -> DataFrame:
    """(id, ancestor_id, steps): one row for each node and each node reached from it over ``parents``, with the fewest
    steps; a node that reaches itself is its own ancestor.

    ``parents`` is an array of ids; a node counts as its row of greatest ``version`` columns.  Ids are compared in lower
    case without surrounding blanks; rows without an id are no nodes.  Null, blank, repeated and unknown parents are
    passed over; null and empty arrays mean no parents.  An empty table gives no rows.  Other columns are never read.
    """
    f = build_forest(latest(df, node, parents, version), one_task)
    own, other = f.nodes.select("n", "id"), f.nodes.select(F.col("n").alias("ancestor"), F.col("id").alias("ancestor_id"))
    return f.pairs.join(own, "n").join(other, "ancestor").select("id", "ancestor_id", "steps")


def _rootless(f: Forest) -> DataFrame:
    """The nodes without parents."""
    return f.nodes.join(f.edges.select(F.col("child").alias("n")), "n", "left_anti").select("n")


def _to_roots(f: Forest, pairs: DataFrame) -> DataFrame:
    """(n, root, steps): each node with each node without parents that it reaches, itself if it is one."""
    rootless = _rootless(f)
    above = pairs.join(rootless.select(F.col("n").alias("ancestor")), "ancestor").select("n", F.col("ancestor").alias("root"), "steps")
    return above.unionByName(rootless.select("n", F.col("n").alias("root"), F.lit(0).alias("steps")))


def _tree_paths(f: Forest) -> DataFrame:
    """(n, root, tree_path): each node with its tree's root and the ids from that root down to it."""
    named = f.up.join(f.nodes.select(F.col("n").alias("above"), "id"), "above")
    path = F.transform(F.sort_array(F.collect_list(F.struct("steps", "id")), asc=False), lambda x: x["id"]).alias("tree_path")
    return named.groupBy("n").agg(F.max(F.when(F.col("steps") == F.col("depth"), F.col("above"))).alias("root"), path)


def _leads(f: Forest, paths: DataFrame, depths: DataFrame) -> DataFrame:
    """(root, lead): for each tree's root that reaches a node without parents, the ids above it on a path of fewest
    steps, that node first; of equally short paths the one over the parent of least id.

    Inside a tree a path has no choice, so only cut roots choose a parent; the segments that they choose are then
    joined up by pointer doubling.
    """
    spark = f.nodes.sparkSession
    links = f.cut.count()
    ahead = depths.join(f.nodes, "n").select(F.col("n").alias("entry"), F.struct("depth", "id").alias("rank"))
    best = join_unique(f.cut, ahead, "entry", links).groupBy("root").agg(F.min_by(F.struct("entry", "rank"), "rank").alias("best"))
    best = best.select("root", F.col("best.entry").alias("entry"), F.col("best.rank.depth").alias("ahead"))
    segments = paths.select(F.col("n").alias("entry"), F.col("root").alias("next"), F.col("tree_path").alias("lead"))
    chosen = join_unique(best, segments, "entry", links)
    # a segment as long as its depth begins at a node without parents
    chosen = chosen.select("root", F.when(F.size("lead") <= F.col("ahead"), F.col("next")).alias("next"), "lead")
    far, path = materialise(chosen, "leads")
    going = far.where("next is not null").count()
    while going:
        beyond = far.select(F.col("root").alias("next"), F.col("next").alias("next2"), F.col("lead").alias("lead2"))
        on = join_unique(far.where("next is not null"), beyond, "next", going).select("root", F.col("next2").alias("next"), F.concat("lead2", "lead").alias("lead"))
        further, newer = materialise(far.where("next is null").unionByName(on), "leads")
        drop(spark, path)
        far, path = further, newer
        going = far.where("next is not null").count()
    return far.select("root", "lead").unionByName(_rootless(f).select(F.col("n").alias("root"), F.array().cast("array<string>").alias("lead")))


def summary(df: DataFrame, node: str, parents: str, version: list[str], one_task: int = ONE_TASK) -> DataFrame:
    """One row per node: ``path`` (ids from a node without parents down to it, a path of fewest steps; of equally short
    ones that over the parents of least ids; null if it reaches no such node), ``tree_path`` (ids from the root of its
    tree down to it), ``depth`` (fewest steps to a node without parents, null if none is reached), ``n_roots`` (such
    nodes reached, itself if it is one; ``roots`` names them), ``n_ancestors``, ``n_descendants``, ``n_parents``,
    ``in_cycle``.

    A tree's root has no parent, or several, or is the node at which a cycle was cut; paths beyond it go on at each of
    its parents, which ``segments`` gives, so the tree paths together spell every path once instead of multiplying them
    out.
    """
    f = build_forest(latest(df, node, parents, version), one_task)
    pairs, _ = materialise(f.pairs, "pairs")
    tops, _ = materialise(_to_roots(f, pairs).groupBy("n").agg(F.min("steps").alias("depth"), F.count("*").alias("n_roots")), "tops")
    above = pairs.groupBy("n").agg(F.count("*").alias("n_ancestors"), F.max(F.col("n") == F.col("ancestor")).alias("in_cycle"))
    below = pairs.groupBy(F.col("ancestor").alias("n")).agg(F.count("*").alias("n_descendants"))
    paths, _ = materialise(_tree_paths(f), "paths")
    whole = join_unique(paths, _leads(f, paths, tops.select("n", "depth")), "root", f.nodes.count()).select("n", F.concat("lead", "tree_path").alias("path"))
    out = f.nodes.join(paths, "n").join(whole, "n", "left").join(f.edges.groupBy(F.col("child").alias("n")).agg(F.count("*").alias("n_parents")), "n", "left")
    out = out.join(tops, "n", "left").join(above, "n", "left").join(below, "n", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "path", "tree_path", "depth", zero("n_roots"), zero("n_ancestors"), zero("n_descendants"), zero("n_parents"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def roots(df: DataFrame, node: str, parents: str, version: list[str], one_task: int = ONE_TASK) -> DataFrame:
    """(id, root_id, steps): each node with each node without parents that it reaches, and the fewest steps; a node
    without parents is its own root at 0 steps."""
    f = build_forest(latest(df, node, parents, version), one_task)
    own, other = f.nodes.select("n", "id"), f.nodes.select(F.col("n").alias("root"), F.col("id").alias("root_id"))
    return _to_roots(f, f.pairs).join(own, "n").join(other, "root").select("id", "root_id", "steps")


def segments(df: DataFrame, node: str, parents: str, version: list[str], one_task: int = ONE_TASK) -> DataFrame:
    """(id, parent_id, parent_path): the links cut from the roots of trees, each with its parent's ``tree_path``.

    A node's paths are its ``tree_path``, put below each ``parent_path`` of that path's first id, and so on until a
    first id has no row here.
    """
    f = build_forest(latest(df, node, parents, version), one_task)
    above = _tree_paths(f).join(f.nodes, "n").select(F.col("n").alias("entry"), F.col("id").alias("parent_id"), F.col("tree_path").alias("parent_path"))
    own = f.nodes.select(F.col("n").alias("root"), "id")
    return join_unique(f.cut, above, "entry", f.cut.count()).join(own, "root").select("id", "parent_id", "parent_path")
