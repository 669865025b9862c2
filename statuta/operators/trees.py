"""Trees of act elements: keyword propagation, roots, subtrees in pre-order, structural checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.ids import range_ends, roman_first_bracket, root_id
from statuta.operators.hierarchy import all_descendants, hierarchy
from statuta.session import cut


def edges(nodes: DataFrame) -> DataFrame:
    """``nro, node_id, pos, ord, child, child_pos``: links to existing children, in order; a repeated child counts once."""
    listed = nodes.select("nro", "node_id", "pos", F.posexplode("children").alias("ord", "child")).groupBy("nro", "node_id", "child").agg(
        F.min("ord").alias("ord"), F.min("pos").alias("pos")
    )
    keys = nodes.select("nro", F.col("node_id").alias("child"), F.col("pos").alias("child_pos"))
    return listed.join(keys, ["nro", "child"])


def reachable(starts: DataFrame, links: DataFrame, group: list[str]) -> DataFrame:
    """``group, nro, node_id``: the starts and everything below them by ``links``, the columns of :func:`edges`.

    What lies below a node is found once for the graph, by the paths of its hierarchy, and starts are joined to
    it. Only below a loop, where no node has a path, links are followed round by round, over new nodes only.
    """
    keys = [*group, "nro", "node_id"]
    step = cut(links.select("nro", "node_id", "pos", "child", "child_pos"))
    elements = cut(
        step.select("nro", "node_id", "pos", F.lit(None).cast("string").alias("parent"))
        .unionByName(step.select("nro", F.col("child").alias("node_id"), F.col("child_pos").alias("pos"), F.col("node_id").alias("parent")))
    )
    found = cut(hierarchy(elements, children=None))
    first = cut(starts.select(*keys).distinct())
    pairs = all_descendants(elements, found, children=None)
    below = first.join(pairs.withColumnRenamed("ancestor", "node_id"), ["nro", "node_id"]).select(*group, "nro", F.col("descendant").alias("node_id"))
    seen = first.unionByName(below).distinct()
    # Everything below a broken node is broken as well.
    broken = found.where("broken").select("nro", "node_id")
    looped = cut(first.join(broken, ["nro", "node_id"], "left_semi"))
    if not looped.isEmpty():
        step = cut(step.select("nro", "node_id", "child").join(broken, ["nro", "node_id"], "left_semi"))
        new = circle = looped
        while not new.isEmpty():
            more = new.join(step, ["nro", "node_id"]).select(*group, "nro", F.col("child").alias("node_id")).distinct()
            new = cut(more.join(circle, keys, "left_anti"))
            circle = cut(circle.unionByName(new))
        seen = seen.unionByName(circle).distinct()
    return seen


def cited_nodes(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, node_id``: elements that relations name themselves.

    Null units name every element. A single id names its element. A range names the elements from
    its left end to its right in document order; none if the left is missing, to the end of the act if
    the right is missing or equal; none if the right stands before the left.
    """
    keys = ["conceptId", "instanceOfType", "nro"]
    whole = relations.where("units IS NULL").select(*keys).join(nodes.select("nro", "node_id"), "nro")
    units = relations.select(*keys, F.explode("units").alias("id")).distinct()
    single = units.where(~F.contains("id", F.lit("-"))).withColumnRenamed("id", "node_id").join(
        nodes.select("nro", "node_id"), ["nro", "node_id"], "left_semi"
    )
    ends = units.where(F.contains("id", F.lit("-"))).select(
        *keys, range_ends(F.col("id"))[0].alias("l"), range_ends(F.col("id"))[1].alias("r")
    )
    at = nodes.select("nro", "node_id", "pos")
    left = at.select("nro", F.col("node_id").alias("l"), F.col("pos").alias("from"))
    right = at.select("nro", F.col("node_id").alias("r"), F.col("pos").alias("to"))
    spans = ends.join(left, ["nro", "l"]).join(right, ["nro", "r"], "left").where("`to` IS NULL OR `to` >= `from`")
    # Positions in cells: a range meets only the nodes of the cells it touches.
    cell = 256
    last = nodes.groupBy("nro").agg(F.max("pos").alias("last"))
    bounded = spans.join(last, "nro").select(*keys, "from", F.coalesce("to", "last").alias("to"))
    touched = bounded.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor(F.col("to") / cell))))
    inside = touched.join(at.withColumn("cell", F.floor(F.col("pos") / cell)), ["nro", "cell"]).where("pos BETWEEN `from` AND `to`")
    out = [part.select(*keys, "node_id") for part in (whole, single, inside)]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def propagate_keywords(acts: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, node_id``: elements that receive a keyword of their act.

    Only keywords that the act itself lists are passed on, to the elements their relation names and to
    all below them; loops end at elements already reached.
    """
    keys = ["conceptId", "instanceOfType", "nro"]
    own = acts.select("nro", F.explode("keywords").alias("k")).select("k.conceptId", "k.instanceOfType", "nro").distinct()
    named = cited_nodes(relations.join(own, keys, "left_semi"), nodes)
    return reachable(named, edges(nodes), ["conceptId", "instanceOfType"])


def leaf_roots(nodes: DataFrame) -> DataFrame:
    """``nro, root, pos``: roots of leaves, in the order of their first leaf.

    A root that is no element is looked for with its first digit as a Roman numeral; if that is none
    either it is left out.
    """
    leaves = nodes.where(F.coalesce(F.size("children"), F.lit(0)) <= 0)
    roots = leaves.select("nro", root_id(F.col("node_id")).alias("root"), "pos").groupBy("nro", "root").agg(F.min("pos").alias("pos"))
    keys = nodes.select("nro", F.col("node_id").alias("root"))
    known = roots.join(keys, ["nro", "root"], "left_semi")
    lost = roots.join(keys, ["nro", "root"], "left_anti").withColumn("root", roman_first_bracket(F.col("root")))
    both = known.unionByName(lost.join(keys, ["nro", "root"], "left_semi"))
    return both.groupBy("nro", "root").agg(F.min("pos").alias("pos"))


def preorder(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nro, root, node_id, depth, branch, path, seq``: the nodes below each root in pre-order.

    ``branch`` is the child of the root that the node lies under (null for the root). Children come in
    their order; a node met again on its own path (a loop) is not entered again. The levels are
    built one join at a time over the nodes of the last one.
    """
    # Read at every level, so written once.
    links = cut(edges(nodes).withColumnRenamed("node_id", "up"))
    level = roots.select(
        "nro", "root", F.col("root").alias("node_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("branch"),
        F.array("root").alias("path"), F.array().cast("array<int>").alias("ords"),
    )
    level = cut(level)
    out = level
    while not level.isEmpty():
        below = level.withColumnRenamed("node_id", "up").join(links, ["nro", "up"]).where(~F.array_contains("path", F.col("child")))
        level = cut(below.select(
            "nro", "root", F.col("child").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.coalesce("branch", "child").alias("branch"),
            F.array_append("path", F.col("child")).alias("path"), F.array_append("ords", F.col("ord")).alias("ords"),
        ))
        out = out.unionByName(level)
    order = Window.partitionBy("nro", "root").orderBy("ords")
    return out.withColumn("seq", F.row_number().over(order) - 1)


def backward_references(nodes: DataFrame) -> DataFrame:
    """``nro, node_id, kind``: elements whose child is above them: 'self' or a loop of 'three'."""
    e = edges(nodes).select("nro", F.col("node_id").alias("a"), F.col("child").alias("b"))
    own = e.where("a = b").select("nro", F.col("a").alias("node_id"), F.lit("self").alias("kind"))
    two = e.join(e.select("nro", F.col("a").alias("b"), F.col("b").alias("c")), ["nro", "b"]).where("a != b AND b != c")
    three = two.join(e.select("nro", F.col("a").alias("c"), F.col("b").alias("a")), ["nro", "c", "a"], "left_semi")
    return own.unionByName(three.select("nro", F.col("a").alias("node_id"), F.lit("three").alias("kind"))).distinct()
