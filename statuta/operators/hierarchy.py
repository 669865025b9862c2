"""Parent-child rows to full hierarchies, on forests and on graphs with loops.

Rows name their parent and their children. The operator gives every node its path, depth, root
and number of descendants, and finds the nodes that lie on a loop or below one.

Method. Nodes are laid out in fragments of consecutive positions. Inside a fragment every chain
of single parents is contracted by pointer jumping to its terminal: a root, a node with several
parents, the exit (the parent in another fragment), or a loop. Exits and nodes with several
parents form the quotient, which is solved by the same routine: fragments of a quotient are a node and
some of the nodes right below it, chosen by hashes, so that a quotient shrinks by a quarter at least
wherever its nodes lie, and by all nodes below which nothing is left. When a tree's quotient fits one
fragment it is solved there; solutions are joined back and local path pieces appended, level by level. A
loop inside a fragment shows as a chain without terminal, at whatever level it has become so short.
No task ever holds more of a tree than a fragment, which is bounded at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.session import cut, hot_join, is_small, ship, small

ROOT, EXIT, SEVERAL, LOOP = 0, 1, 2, 3
#: Positions of a fragment.
WIDTH = 512
#: Nodes of a tree's quotient that are solved in one place.
FIT = 32_768
#: Nodes of a fragment of a quotient, about, beside its upper node.
STAR = 512
_CHUNK_ROWS = 200_000
_LABEL = "tree string, pos long, kind int, term long, len long, seg array<string>"
_SOLVED = "tree string, pos long, broken boolean, root long, depth long, path array<string>"


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no (tree, frag) is split; every row is copied twice at most."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if batch.empty:
            continue
        last = (batch["tree"] == batch["tree"].iloc[-1]) & (batch["frag"] == batch["frag"].iloc[-1])
        if rows + len(batch) < _CHUNK_ROWS or last.all() and (not held or _same_end(held[-1], batch)):
            # Nothing can be given away yet, or need not: the batch waits without a copy.
            held.append(batch)
            rows += len(batch)
            continue
        cut_at = int(np.argmax(last.to_numpy()))
        yield pd.concat([*held, batch.iloc[:cut_at]], ignore_index=True)
        held, rows = [batch.iloc[cut_at:]], len(batch) - cut_at
    if held:
        yield pd.concat(held, ignore_index=True)


def _same_end(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return a["tree"].iloc[-1] == b["tree"].iloc[-1] and a["frag"].iloc[-1] == b["frag"].iloc[-1]


class _Local:
    """The graph of some whole fragments, with dense local numbers."""

    def __init__(self, rows: pd.DataFrame):
        group = rows.groupby(["tree", "frag"], sort=False).ngroup().to_numpy()
        is_node = rows["kind"].isna().to_numpy()
        nodes = rows[is_node].assign(g=group[is_node]).drop_duplicates(["g", "pos"])
        self.pos, self.group, self.tree = nodes["pos"].to_numpy(np.int64), nodes["g"].to_numpy(), nodes["tree"].to_numpy()
        self.name = nodes["node"].to_numpy()
        self.size = len(nodes)
        index = pd.Series(np.arange(self.size), index=pd.MultiIndex.from_arrays([self.group, self.pos]))
        e = rows[~is_node]
        of = group[~is_node]
        self.kind = e["kind"].to_numpy().astype(np.int64)
        self.parent_pos = e["parent"].fillna(-1).to_numpy(np.int64)
        self.child = index.reindex(pd.MultiIndex.from_arrays([of, e["pos"]])).to_numpy().astype(np.int64)
        local = index.reindex(pd.MultiIndex.from_arrays([of, self.parent_pos])).to_numpy()
        self.parent = np.where(np.isnan(local) | (self.kind != EXIT), -1, local).astype(np.int64)
        self.len, self.seg = e["len"].to_numpy(np.int64), e["seg"].to_numpy()
        self.rank = e["rank"].to_numpy(np.int64)
        self.indegree = np.bincount(self.child, minlength=self.size)


def _tail(seg, name) -> list[str]:
    return ([] if seg is None else list(seg)) + [name]


def _contract(names: bool):
    """Label every node of whole fragments with the terminal of its chain, its distance and the piece from there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            g = _Local(rows)
            kind, term, base = np.full(g.size, ROOT), g.pos.copy(), np.zeros(g.size, np.int64)
            one = g.indegree[g.child] == 1
            kind[g.indegree > 1] = SEVERAL
            edge_of = np.full(g.size, -1)
            edge_of[g.child[one]] = np.nonzero(one)[0]
            top = one & (g.kind == ROOT)
            term[g.child[top]], base[g.child[top]] = g.parent_pos[top], g.len[top]
            out = one & (g.kind == EXIT) & (g.parent < 0)
            kind[g.child[out]], term[g.child[out]], base[g.child[out]] = EXIT, g.parent_pos[out], g.len[out] + 1
            inner = one & (g.parent >= 0)
            own = inner & (g.parent == g.child)
            kind[g.child[own | one & (g.kind == LOOP)]] = LOOP
            up, step = np.arange(g.size), np.zeros(g.size, np.int64)
            up[g.child[inner & ~own]] = g.parent[inner & ~own]
            step[g.child[inner & ~own]] = g.len[inner & ~own] + 1
            stop, jump = up == np.arange(g.size), up
            for _ in range(max(1, int(g.size).bit_length() + 1)):
                step = step + step[jump]
                jump = jump[jump]
            kind_at = np.where(stop[jump], kind[jump], LOOP)
            looped = kind_at == LOOP
            pieces: list = [None] * g.size
            for i in np.argsort(np.where(looped, 0, step), kind="stable") if names else ():
                if looped[i]:
                    continue
                e = edge_of[i]
                if not stop[i]:
                    pieces[i] = pieces[up[i]] + _tail(g.seg[e], g.name[i])
                else:
                    pieces[i] = [] if kind[i] == SEVERAL else _tail(g.seg[e] if e >= 0 else None, g.name[i])
            yield pd.DataFrame({
                "tree": g.tree, "pos": g.pos, "kind": kind_at.astype(np.int32), "term": np.where(looped, -1, term[jump]),
                "len": np.where(looped, 0, step + base[jump]), "seg": pieces,
            })

    return run


def _solve_whole(names: bool):
    """Solve trees that lie in one fragment: peel nodes all of whose parents are peeled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            g = _Local(rows)
            open_parents = g.indegree.copy()
            top = g.kind == ROOT
            sound = top | (g.parent >= 0)
            np.subtract.at(open_parents, g.child[top], 1)
            order = np.argsort(g.parent, kind="stable")
            begin = np.searchsorted(g.parent[order], np.arange(g.size + 1))
            best = np.full(g.size, -1)
            ranked = np.lexsort((g.parent_pos, g.rank))[::-1]
            ranked = ranked[sound[ranked]]
            best[g.child[ranked]] = ranked
            path: list = [None] * g.size
            depth, root, done = np.zeros(g.size, np.int64), g.pos.copy(), np.zeros(g.size, bool)
            ready = np.nonzero(open_parents == 0)[0].tolist()
            while ready:
                i = ready.pop()
                e, done[i] = best[i], True
                if e >= 0:
                    p = g.parent[e]
                    root[i], depth[i] = (g.parent_pos[e], g.len[e]) if top[e] else (root[p], depth[p] + g.len[e] + 1)
                if names:
                    above = [] if e < 0 or top[e] else path[g.parent[e]]
                    path[i] = above + (_tail(g.seg[e], g.name[i]) if e >= 0 else [g.name[i]])
                for c in g.child[order[begin[i] : begin[i + 1]]]:
                    open_parents[c] -= 1
                    if open_parents[c] == 0:
                        ready.append(c)
            yield pd.DataFrame({"tree": g.tree, "pos": g.pos, "broken": ~done, "root": root, "depth": depth, "path": path})

    return run


def _in_fragments(rows: DataFrame) -> DataFrame:
    """Bring each fragment together; a large tree is spread over as many tasks as it has fragments."""
    return (
        rows.repartition("tree", "frag").sortWithinPartitions("tree", "frag")
        .select("tree", "frag", "pos", "node", "parent", "kind", "len", "seg", "rank")
    )


def _stars(rows: DataFrame, level: int) -> DataFrame:
    """Fragments of a quotient: a node whose hash says so takes in those right below it whose hash says not.

    A node above many takes in about STAR of them only; the others are taken in from below, and vanish
    from the next quotient when nothing hangs on them any more.
    """
    takes = lambda c: F.pmod(F.xxhash64("tree", c, F.lit(level)), F.lit(2)) == 1
    below = rows.where("kind IS NULL AND up IS NOT NULL").groupBy("tree", "up").agg(F.count(F.lit(1)).alias("n"))
    # A row for every STAR nodes at most.
    wide = small(cut(below.where(F.col("n") > STAR).withColumn("parts", F.ceil(F.col("n") / STAR)).drop("n")))
    joined = rows.join(wide, ["tree", "up"], "left")
    here = F.pmod(F.xxhash64("tree", "pos", F.lit(-level)), F.coalesce("parts", F.lit(1))) == 0
    return joined.withColumn("frag", F.when(F.col("up").isNotNull() & takes("up") & ~takes("pos") & here, F.col("up")).otherwise(F.col("pos")))


def _peel(rows: DataFrame) -> DataFrame:
    """Solve by rounds over the nodes all of whose parents are solved: for nodes with several parents in great number.

    Such nodes cannot be contracted, and no task could hold them. There are as many rounds as they follow each other.
    """
    keys = ["tree", "pos"]
    nodes, edges = cut(rows.where("kind IS NULL").select(*keys, "node").distinct()), cut(rows.where("kind IS NOT NULL"))
    wanted = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    piece = F.coalesce("seg", F.array().cast("array<string>"))
    first = nodes.join(wanted, keys, "left_anti").select(*keys, F.col("pos").alias("root"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path"))
    tops = edges.where(F.col("kind") == ROOT).select(*keys, "rank", "parent", F.col("parent").alias("root"), F.col("len").alias("depth"), piece.alias("path"))
    known = cut(first)
    while True:
        above = known.select("tree", F.col("pos").alias("parent"), "root", F.col("depth").alias("d"), F.col("path").alias("p"))
        met = edges.where(F.col("kind") == EXIT).join(above, ["tree", "parent"]).select(
            *keys, "rank", "parent", "root", (F.col("d") + F.col("len") + 1).alias("depth"), F.concat("p", piece).alias("path")
        )
        of = tops.unionByName(met).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rank", "parent", "root", "depth", "path")).alias("b"))
        new = of.join(wanted.withColumnRenamed("n", "m"), [*keys, "m"]).join(known.select(*keys), keys, "left_anti").join(nodes, keys)
        new = cut(new.select(*keys, "b.root", "b.depth", F.array_append("b.path", F.col("node")).alias("path")))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    return nodes.select(*keys).join(known.withColumn("broken", F.lit(False)), keys, "left").select(
        *keys, F.coalesce("broken", F.lit(True)).alias("broken"), "root", "depth", "path"
    )


def _solve(rows: DataFrame, names: bool, width: int, level: int = 0, before: int | None = None) -> DataFrame:
    """rows: one per node (kind null) and one per edge; result: whether broken, root, depth and path per node."""
    if level == 0:
        top = rows.agg(F.max("pos")).first()[0]
        fits = top is None or top < width
        framed = rows.withColumn("frag", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    else:
        per = rows.where("kind IS NULL").groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        fits = (per["most"] or 0) <= FIT
        if not fits and before is not None and per["all"] > 0.95 * before:
            return _peel(rows)
        before = per["all"]
        framed = rows.withColumn("frag", F.lit(0).cast("long")) if fits else _stars(rows, level)
    if fits:
        return _in_fragments(framed).mapInPandas(_solve_whole(names), _SOLVED)
    label = cut(_in_fragments(framed).mapInPandas(_contract(names), _LABEL))
    own_names = rows.where("kind IS NULL").select("tree", "pos", "node")
    several = label.where(F.col("kind") == SEVERAL).where(F.col("pos") == F.col("term")).select("tree", "pos")
    portals = label.where(F.col("kind") == EXIT).select("tree", F.col("term").alias("pos")).distinct()
    inner = portals.join(several, ["tree", "pos"], "left_anti")
    on_chain = F.col("kind").isin(EXIT, SEVERAL)
    as_edge = lambda k: F.when(k == SEVERAL, F.lit(EXIT)).otherwise(k).alias("kind")
    # A portal hangs on the terminal of its own chain; its name closes the piece. A node at the top of its own
    # chain needs no edge.
    hanging = inner.join(label, ["tree", "pos"])
    from_portal = hanging.where(on_chain | (F.col("kind") == LOOP) | (F.col("len") > 0)).select(
        "tree", "pos", F.col("term").alias("parent"), as_edge(F.col("kind")), F.when(on_chain, F.col("len") - 1).otherwise(F.col("len")).alias("len"),
        F.expr("IF(size(seg) > 0, slice(seg, 1, size(seg) - 1), seg)").alias("seg"), F.lit(0).cast("long").alias("rank"),
        F.when(on_chain, F.col("term")).alias("up"),
    )
    many = cut(rows.where("kind IS NOT NULL").join(several, ["tree", "pos"]).drop("up"))
    above = label.select("tree", F.col("pos").alias("parent"), F.col("kind").alias("k"), "term", F.col("len").alias("l"), F.col("seg").alias("piece"))
    none = F.array().cast("array<string>")
    # Nodes with several parents are mostly few, and go to the labels; else the labels go to them.
    upward = many.where(F.col("kind") == EXIT)
    met = above.join(F.broadcast(upward), ["tree", "parent"]) if is_small(upward) else hot_join(upward, above, ["tree", "parent"], ["pos"], "inner")
    from_several = met.select(
        "tree", "pos", F.col("term").alias("parent"), as_edge(F.col("k")),
        # Below a root the piece begins with the root itself, so that there is one name more than steps.
        (F.col("l") + F.col("len") + F.when(F.col("k") == ROOT, 1).otherwise(0)).alias("len"),
        F.concat(F.coalesce("piece", none), F.coalesce("seg", none)).alias("seg"), "rank", F.lit(None).cast("long").alias("up"),
    ).unionByName(
        many.where(F.col("kind") != EXIT).select("tree", "pos", "parent", "kind", "len", "seg", "rank", F.lit(None).cast("long").alias("up"))
    )
    up = hanging.where(on_chain).select("tree", "pos", F.col("term").alias("up"))
    nodes = inner.unionByName(several).join(own_names, ["tree", "pos"]).join(up, ["tree", "pos"], "left").select(
        "tree", "pos", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("kind"), F.lit(0).cast("long").alias("len"),
        F.lit(None).cast("array<string>").alias("seg"), F.lit(0).cast("long").alias("rank"), "up",
    )
    edges = from_portal.unionByName(from_several).withColumn("node", F.lit(None).cast("string"))
    solved = _solve(cut(nodes.unionByName(edges.select(nodes.columns))), names, width, level + 1, before)
    ends = cut(solved.select("tree", F.col("pos").alias("term"), "broken", F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path").alias("above")))
    none_of = lambda t: F.lit(None).cast(t)
    alone = label.where(~on_chain).select(
        "tree", "pos", (F.col("kind") == LOOP).alias("broken"), F.col("term").alias("root"), F.col("len").alias("depth"),
        F.when(F.col("kind") == ROOT, F.col("seg")).alias("path") if names else none_of("array<string>").alias("path"),
    )
    hung = hot_join(label.where(on_chain), ends, ["tree", "term"], ["pos"]).select(
        "tree", "pos", F.coalesce("broken", F.lit(True)).alias("broken"), F.col("r").alias("root"), (F.col("d") + F.col("len")).alias("depth"),
        F.when(~F.col("broken"), F.concat("above", "seg")).alias("path") if names else none_of("array<string>").alias("path"),
    )
    return alone.unionByName(hung)


def _links(src: DataFrame) -> DataFrame:
    """``tree, p, c, rank``: who is named above whom, by the node itself (rank 0) or by the parent only (1)."""
    return (
        src.where("up IS NOT NULL").select("tree", F.col("up").alias("p"), F.col("node").alias("c"), F.lit(0).alias("rank"))
        .unionByName(src.select("tree", F.col("node").alias("p"), F.explode("down").alias("c"), F.lit(1).alias("rank")))
        .groupBy("tree", "p", "c").agg(F.min("rank").alias("rank"))
    )


def _laid_out(elements: DataFrame, tree: str, node: str, pos: str, parent: str | None, children: str | None) -> DataFrame:
    """Nodes and edges of all trees as the rows that :func:`_solve` takes."""
    ship(elements.sparkSession)
    src = elements.select(
        F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{node}`").alias("node"),
        F.col(f"`{pos}`").cast("long").alias("pos"),
        (F.col(f"`{parent}`") if parent else F.lit(None).cast("string")).alias("up"),
        (F.col(f"`{children}`") if children else F.lit(None).cast("array<string>")).alias("down"),
    ).where("tree IS NOT NULL AND node IS NOT NULL AND pos IS NOT NULL")
    nodes = cut(src.groupBy("tree", "node").agg(F.min("pos").alias("pos")))
    p = nodes.select("tree", F.col("node").alias("p"), F.col("pos").alias("parent"))
    c = nodes.select("tree", F.col("node").alias("c"), F.col("pos"))
    none: Column = F.lit(None).cast("array<string>")
    # One parent may stand above a large part of all nodes.
    edges = hot_join(_links(src), p, ["tree", "p"], ["c"], "inner").join(c, ["tree", "c"]).select(
        "tree", "pos", F.lit(None).cast("string").alias("node"), "parent", F.lit(EXIT).alias("kind"), F.lit(0).cast("long").alias("len"), none.alias("seg"),
        # Of several parents the one the node names itself comes first, then the earliest.
        (F.col("rank") * (1 << 41) + F.col("parent")).alias("rank"), F.lit(None).cast("long").alias("up"),
    )
    rows = nodes.select(
        "tree", "pos", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("kind"), F.lit(0).cast("long").alias("len"),
        none.alias("seg"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("up"),
    ).unionByName(edges)
    return cut(rows)


def hierarchy(
    elements: DataFrame,
    tree: str = "nro",
    node: str = "node_id",
    pos: str = "pos",
    parent: str | None = "parent",
    children: str | None = "children",
    width: int = WIDTH,
    paths: bool = True,
) -> DataFrame:
    """Path, depth and root of every node, and whether a loop makes them impossible.

    P is above C if C names P as parent or P lists C as child, both being nodes of the same tree.
    Links to absent nodes are ignored; a node above itself is a loop. A node with several parents
    has its path through the one it names itself, else through the first that lists it.

    Result: ``tree, node, broken, root, depth, path``; for broken nodes the last three are null.
    Without ``paths`` there is no column ``path``, and no names are carried along: in deep trees paths take as
    much room as the square of the depth. Rows with a null tree or node are left out, repeated rows count
    once, an empty table gives an empty result; further columns of the input are ignored.
    """
    rows = _laid_out(elements, tree, node, pos, parent, children)
    names = rows.where("kind IS NULL").select("tree", "pos", "node")
    original = elements.schema[tree].dataType
    solved = _solve(rows, paths, width).join(names, ["tree", "pos"])
    sound = lambda c: F.when(~F.col("broken"), c)
    if paths:
        root = sound(F.element_at("path", 1))
    else:
        tops = names.select("tree", F.col("pos").alias("root"), F.col("node").alias("top"))
        solved = hot_join(solved, tops, ["tree", "root"], ["pos"])
        root = sound(F.col("top"))
    return solved.select(
        F.col("tree").cast(original).alias(tree), F.col("node").alias(node), "broken", root.alias("root"), sound(F.col("depth")).alias("depth"),
        *([sound(F.col("path")).alias("path")] if paths else []),
    )


def broken_nodes(
    elements: DataFrame, tree: str = "nro", node: str = "node_id", pos: str = "pos", parent: str | None = "parent", children: str | None = "children",
    width: int = WIDTH,
) -> DataFrame:
    """``tree, node``: the nodes that lie on a loop or below one; edge cases as in :func:`hierarchy`."""
    rows = _laid_out(elements, tree, node, pos, parent, children)
    found = _solve(rows, False, width).where("broken").select("tree", "pos")
    named = rows.where("kind IS NULL").select("tree", "pos", "node").join(found, ["tree", "pos"], "left_semi")
    return named.select(F.col("tree").cast(elements.schema[tree].dataType).alias(tree), F.col("node").alias(node))


def descendants(found: DataFrame, tree: str = "nro", node: str = "node_id") -> DataFrame:
    """The (ancestor, descendant) pairs along the paths of :func:`hierarchy`, with their distance.

    A pair is a row, so that no node's descendants are gathered in one place. Pairs through further
    parents and pairs with broken nodes are not on these paths: see :func:`all_descendants`.
    """
    return (
        found.where(~F.col("broken"))
        .select(tree, F.col(node).alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
        .where(F.col("level") < F.col("depth"))
        .select(tree, "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
    )


def all_descendants(
    elements: DataFrame,
    found: DataFrame,
    tree: str = "nro",
    node: str = "node_id",
    parent: str = "parent",
    children: str | None = "children",
) -> DataFrame:
    """All (ancestor, descendant) pairs by any chain of links, of every sound ancestor: ``tree, ancestor, descendant``.

    ``found`` is :func:`hierarchy` of ``elements``. Descendants are sound or broken; broken nodes have
    none of their own, since a loop makes that impossible.

    Links beside the paths (further parents, and all links to broken nodes) lead from a sound node to
    where they land. Landings that reach another such link are followed round by round until nothing
    new is reached; the paths above the first link and below the landing then give the pairs. Rounds are
    as many as such links follow each other, so a deep tree takes none, and a deep broken part as many as it is deep.
    """
    known = cut(found.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"), "broken", "path"))
    src = elements.select(
        F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"),
        (F.col(f"`{parent}`") if parent else F.lit(None).cast("string")).alias("up"),
        (F.col(f"`{children}`") if children else F.lit(None).cast("array<string>")).alias("down"),
    ).where("tree IS NOT NULL AND node IS NOT NULL")
    above = known.select("tree", F.col("node").alias("p"), F.col("broken").alias("p_broken"), F.col("path").alias("p_path"))
    below = known.select("tree", F.col("node").alias("c"), F.col("broken").alias("c_broken"), F.try_element_at("path", F.lit(-2)).alias("first"))
    beside = cut(
        _links(src).join(above, ["tree", "p"]).join(below, ["tree", "c"])
        .where(F.col("c_broken") | ~F.col("first").eqNullSafe(F.col("p")))
        .select("tree", "p", "c", "p_broken", "c_broken", "p_path")
    )
    landings = beside.where("NOT c_broken").select("tree", F.col("c").alias("x")).distinct()
    # From a landing to the next: on the path to the next link's upper end, or a broken upper end itself.
    hops = cut(
        beside.where("NOT p_broken").select("tree", F.explode("p_path").alias("x"), F.col("c").alias("next"))
        .join(landings, ["tree", "x"], "left_semi")
        .unionByName(beside.where("p_broken").select("tree", F.col("p").alias("x"), F.col("c").alias("next"))).distinct()
    )
    new = cut(beside.where("NOT p_broken").select("tree", F.col("p").alias("s"), F.col("c").alias("x")).distinct())
    reached, rounds = new, 0
    while not new.isEmpty():
        new = cut(
            new.join(hops, ["tree", "x"]).select("tree", "s", F.col("next").alias("x")).distinct()
            .join(reached, ["tree", "s", "x"], "left_anti")
        )
        reached, rounds = reached.unionByName(new), rounds + 1
        if rounds % 16 == 0:
            reached = cut(reached)
    sound = known.where("NOT broken")
    under = (
        sound.select("tree", F.col("node").alias("descendant"), F.explode("path").alias("x"))
        .join(landings, ["tree", "x"], "left_semi")
        .unionByName(known.where("broken").select("tree", F.col("node").alias("descendant"), F.col("node").alias("x")))
    )
    over = sound.select("tree", F.col("node").alias("s"), F.explode("path").alias("ancestor"))
    # Sources below the same ancestor often share a landing: ancestors are merged before the landings unfold.
    tops = reached.join(over, ["tree", "s"]).select("tree", "ancestor", "x").distinct()
    further = tops.join(under, ["tree", "x"]).select("tree", "ancestor", "descendant")
    along = sound.select("tree", F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("ancestor"), F.col("node").alias("descendant"))
    pairs = along.unionByName(further).distinct()
    return pairs.select(F.col("tree").alias(tree), "ancestor", "descendant")


def with_descendant_counts(found: DataFrame, tree: str = "nro", node: str = "node_id", pairs: DataFrame | None = None) -> DataFrame:
    """:func:`hierarchy` with ``n_descendants``; the counts are combined before the shuffle.

    Counted are ``pairs``, which :func:`all_descendants` gives, else those along the paths only.
    """
    pairs = descendants(found, tree, node) if pairs is None else pairs
    counts = pairs.groupBy(tree, F.col("ancestor").alias(node)).agg(
        F.count(F.lit(1)).alias("n_descendants")
    )
    return found.join(counts, [tree, node], "left").withColumn(
        "n_descendants", F.when(~F.col("broken"), F.coalesce("n_descendants", F.lit(0)))
    )
