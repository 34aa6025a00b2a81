"""Parent-child links to hierarchies: loops set apart, then heavy-path labels.

Pointers are doubled, so a chain of n names takes log2(n) rounds of joins; each round is
cut by a checkpoint. Names with children ("inner" names) are few against leaves, so the
rounds work on them only; leaves are attached by one last join on their parent.

Loops: names with one parent climb to a top or to a name with several parents ("joint").
Joints and the climbs between them form a small graph; walks over it are doubled until
none is left, or until the names that end one stay the same: those lie on or below loops.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import Kept, Rounds, join_dealt, join_hot

#: Walks and reach between joints are doubled while they have at most this many pairs for
#: each link (and a few more); beyond it single rounds go on with the pairs at hand. The
#: result is the same.
PAIRS_PER_LINK, PAIRS_MORE = 16, 10_000
#: Children of one parent are numbered in hash ranges of about this many names.
SIBLINGS = 100_000


def links(rows: DataFrame, parent: str, children: str) -> DataFrame:
    """Distinct (parent, child) links; null names and null lists hold none."""
    return (
        rows.select(F.col(parent).alias("parent"), F.explode(F.col(children)).alias("child"))
        .where(F.col("parent").isNotNull() & F.col("child").isNotNull())
        .distinct()
    )


def climb(r: Rounds, up: DataFrame, sums: bool = False, kept: tuple[str, ...] = ()) -> tuple[Kept, list[Kept]]:
    """Pointer doubling over (x, up): null ``up`` is a top; each x occurs once. Columns ``kept`` stay with x.

    Returns the last round (x, at, far: the ancestor ``far`` links above, stopping at
    the top; ``open`` where no top was reached; with ``sums`` also ``size``, the sum of
    ``size`` over the names at or below x) and all rounds, the k-th with ancestors 2**k
    links above. Rounds end when no name reaches its top any more: depths have no gaps,
    so names still open lie on or below a loop of ``up``, and once their ``at`` stay the
    same those are loop names only.
    """
    weight = [*(["size"] if sums else []), *kept]
    keep = lambda df: r.cut(df, hot="CASE WHEN open THEN at END", n_open=F.count_if("open"))
    state = keep(up.select("x", F.coalesce("up", "x").alias("at"), F.col("up").isNotNull().cast("long").alias("far"), F.col("up").isNotNull().alias("open"), *weight))
    rounds, n, images, k = [], -1, -1, 0
    while True:
        rounds.append(state)
        before, n = n, state.facts["n_open"]
        if n == 0:
            return state, rounds
        if n == before:
            was, images = images, state.df.where("open").select("at").distinct().count()
            if was == images:
                return state, rounds
        at = state.df
        above = at.select(F.col("x").alias("at"), F.col("at").alias("_at"), F.col("far").alias("_far"), F.col("open").alias("_open"))
        after = join_hot(at.where("open"), above, "at", state.hot).select(
            "x", F.col("_at").alias("at"), (F.col("far") + F.col("_far")).alias("far"), F.col("_open").alias("open"), *weight
        ).unionByName(at.where("NOT open").select("x", "at", "far", "open", *weight))
        if sums:
            # names exactly 2**k below x add what they have gathered; counted map-side
            exact = at.where(F.col("far") == 2**k).groupBy(F.col("at").alias("x")).agg(F.sum("size").alias("_more"))
            after = after.join(exact, "x", "left").select("x", "at", "far", "open", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"), *kept)
        state, k = keep(after.coalesce(r.tasks)), k + 1


def _joined_pairs(pairs: DataFrame) -> int:
    """Rows of the join of (src, dst) with itself, from counts alone."""
    ends = pairs.groupBy(F.col("dst").alias("x")).agg(F.count(F.lit(1)).alias("a")).join(pairs.groupBy(F.col("src").alias("x")).agg(F.count(F.lit(1)).alias("b")), "x")
    return int(ends.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)


def _joined(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", F.col("dst").alias("_m")).join(pairs.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()


def endless(r: Rounds, graph: Kept) -> DataFrame:
    """(x): names of a graph (src, dst) at which walks of any length end, i.e. on or below its loops.

    The pairs of walks of 2**k hops are joined with themselves. No pairs left: no loops.
    If walks of 2**k and of 2**(k+1) hops end at the same names, so do longer ones. Where
    the pairs would grow too many, names that no walk reaches are peeled off instead,
    2**k hops a round.
    """
    room, hop, ends = PAIRS_PER_LINK * graph.n + PAIRS_MORE, graph, -1
    while hop.n:
        was, ends = ends, hop.df.select("dst").distinct().count()
        if was == ends:
            break
        if _joined_pairs(hop.df) <= room:
            hop = r.cut(_joined(hop.df))
        else:
            hop = r.cut(hop.df.join(hop.df.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    return hop.df.select(F.col("dst").alias("x")).distinct()


def _shortcuts(r: Rounds, graph: Kept) -> tuple[Kept, bool]:
    """(src, dst) joined by 1 to 2**k hops, and whether that is all reach there is."""
    room, pairs, before = PAIRS_PER_LINK * graph.n + PAIRS_MORE, graph, -1
    while pairs.n > before:
        if _joined_pairs(pairs.df) > room:
            return pairs, False
        before, pairs = pairs.n, r.cut(pairs.df.unionByName(_joined(pairs.df)).distinct())
    return pairs, True


def components(r: Rounds, graph: Kept) -> Kept:
    """(x, component) of all names on loops of a graph (src, dst); one component's names reach each other."""
    pairs, whole = _shortcuts(r, graph)
    if whole:
        back = pairs.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return r.cut(pairs.df.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("x")).agg(F.max("dst").alias("component")))
    return _coloured(r, pairs)


def _coloured(r: Rounds, edges: Kept) -> Kept:
    """components by colouring, for graphs with too many pairs.

    The greatest name that reaches x is its colour; the names of a colour that reach
    that greatest name are one component; it is set apart and the rest is done again.
    """
    found = r.cut(edges.df.select(F.col("src").alias("x"), F.col("dst").alias("component")).where("false"))
    while edges.n:
        links = edges.df
        colour = r.cut(links.select(F.col("src").alias("x")).union(links.select("dst")).distinct().withColumn("colour", F.col("x")))
        while True:
            reached = links.join(colour.df.withColumnRenamed("x", "src"), "src").groupBy(F.col("dst").alias("x")).agg(F.max("colour").alias("_c"))
            after = colour.df.join(reached, "x", "left").select("x", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") > F.col("colour")).alias("_new"))
            colour = r.cut(after, n_new=F.count_if("_new"))
            if not colour.facts["n_new"]:
                break
        end = lambda side, name: colour.df.select(F.col("x").alias(side), F.col("colour").alias(name))  # noqa: B023,E731
        inside = r.cut(links.join(end("src", "c1"), "src").join(end("dst", "c2"), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))).df
        part = frontier = r.cut(colour.df.select("x", "colour").where("x = colour"))
        while frontier.n:
            back = inside.join(frontier.df.select(F.col("x").alias("dst"), "colour"), ["dst", "colour"], "left_semi").select(F.col("src").alias("x"), "colour").distinct()
            frontier = r.cut(back.join(part.df, "x", "left_anti"))
            part = r.cut(part.df.unionByName(frontier.df))
        # a component of one name loops only if it holds a link to itself
        many = part.df.groupBy("colour").count()
        looping = part.df.join(many, "colour").join(inside.where("src = dst").select(F.col("src").alias("x"), F.lit(True).alias("_self")), "x", "left")
        found = r.cut(found.df.unionByName(looping.where("count > 1 OR _self").select("x", F.col("colour").alias("component"))))
        gone = part.df.select("x")
        rest = links.join(gone.withColumnRenamed("x", "src"), "src", "left_anti").join(gone.withColumnRenamed("x", "dst"), "dst", "left_anti")
        edges = r.cut(rest.select("src", "dst"))
    return found


def _up_from(r: Rounds, marked: DataFrame, rounds: list[Kept]) -> DataFrame:
    """All ancestors of ``marked`` (x), themselves included, along the doubled pointers."""
    for k, state in enumerate(rounds):
        step = state.df.where("far > 0").select("x", "at")
        marked = marked.union(marked.join(step, "x").select(F.col("at").alias("x"))).distinct()
        if k % 3 == 2:
            marked = r.cut(marked).df
    return marked


def loop_status(r: Rounds, edges: Kept, parents: Kept, inner: Kept) -> Kept:
    """(x, status) of every name on or below a loop: ``cycle`` or ``below_cycle``.

    ``parents``: x, up (the smallest parent), n (number of parents); ``inner``: x.
    """
    one_up = inner.df.join(parents.df, "x", "left").select("x", F.when(F.col("n") == 1, F.col("up")).alias("up"))
    top, rounds = climb(r, one_up)
    cycle = top.df.where("open").select(F.col("at").alias("x")).distinct()
    # links into names with several parents, each from the top of the parent's climb
    several = parents.df.where("n > 1").join(inner.df, "x", "left_semi").select(F.col("x").alias("child"))
    into = join_hot(edges.df, several, "child", edges.hot, "left_semi")
    joints = r.cut(join_hot(into, top.df.select(F.col("x").alias("parent"), "at", "open"), "parent", edges.hot_too).select("parent", "child", F.col("at").alias("src"), F.col("child").alias("dst"), "open"), n_open=F.count_if("open"))
    # what hangs below a loop met on a climb is marked by a loop of its own
    graph = r.cut(joints.df.select(F.when(F.col("open"), F.col("dst")).otherwise(F.col("src")).alias("src"), "dst").distinct())
    bad = tainted = r.cut(endless(r, graph)) if graph.n else None
    if tainted and tainted.n:
        real = joints.df.where("NOT open").select("src", "dst").distinct().join(tainted.df.withColumnRenamed("x", "src"), "src", "left_semi")
        turned = r.cut(real.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        above = endless(r, turned)
        core = turned.df.join(above.withColumnRenamed("x", "src"), "src", "left_semi").join(above.withColumnRenamed("x", "dst"), "dst", "left_semi")
        parts = components(r, r.cut(core.select("src", "dst")))
        end = lambda side, name: parts.df.select(F.col("x").alias(side), F.col("component").alias(name))
        closing = joints.df.where("NOT open").join(end("src", "c1"), "src").join(end("dst", "c2"), "dst").where("c1 = c2")
        closing = r.cut(closing.select(F.col("parent").alias("x")).distinct())
        # the names between two loop names are the climb from the closing link's parent
        cycle = cycle.union(_up_from(r, closing.df, rounds)) if closing.n else cycle
    cycle = cycle.distinct()
    bad_top = (bad.df if bad else cycle.where("false")).select(F.col("x").alias("at"), F.lit(True).alias("_bad"))
    bad_inner = r.cut(top.df.join(bad_top, "at", "left").where("open OR _bad").select("x"))
    below = join_hot(edges.df, bad_inner.df.withColumnRenamed("x", "parent"), "parent", edges.hot_too, "left_semi").select(F.col("child").alias("x"))
    return r.cut(
        below.union(bad_inner.df).distinct().join(cycle.select("x", F.lit("cycle").alias("status")), "x", "left")
        .select("x", F.coalesce("status", F.lit("below_cycle")).alias("status"))
    )


class Hierarchy:
    """Loops, heavy-path labels, paths and intervals of the graph in ``rows`` (parent, array of children).

    Names on or below loops have a status and no place. Every other name hangs below its
    smallest parent; the links left out by that are in ``edges`` and count in ``pairs``.
    Repeated links count once, null names and lists hold none, a key without children
    is a tree of one name, an empty table gives empty results; other columns are ignored.
    """

    def __init__(self, rows: DataFrame, parent: str, children: str) -> None:
        self.outer = rows.sparkSession
        self.r = r = Rounds(self.outer, 1)
        self.kept_edges = edges = r.enter(links(rows, parent, children), hot="child", hot_too="parent")
        keys = rows.where(F.col(parent).isNotNull()).select(F.col(parent).alias("x")).distinct()
        parents = r.cut(edges.df.groupBy(F.col("child").alias("x")).agg(F.min("parent").alias("up"), F.count(F.lit(1)).alias("n")))
        inner = r.cut(edges.df.select(F.col("parent").alias("x")).distinct())
        self.kept_status = loop_status(r, edges, parents, inner)
        known = parents.df.select("x", "up").join(inner.df.select("x", F.lit(True).alias("is_inner")), "x", "full").join(keys, "x", "full")
        self.clear = r.cut(known.join(self.kept_status.df, "x", "left_anti").select("x", "up", F.coalesce("is_inner", F.lit(False)).alias("is_inner")), hot="CASE WHEN NOT is_inner THEN up END")

    @property
    def edges(self) -> DataFrame:
        return self.r.leave(self.kept_edges)

    @property
    def status(self) -> DataFrame:
        return self.r.leave(self.kept_status)

    @cached_property
    def placed(self) -> Kept:
        """Inner names: x, up, size, chain (its top name) and chain_pos.

        Sizes are gathered by doubling; of the inner children of a name the one with the
        largest subtree (ties: the greatest name) continues its chain.
        """
        r, clear = self.r, self.clear.df
        # a leaf counts for its parent; counted where the rows lie
        leaves = clear.where("NOT is_inner AND up IS NOT NULL").groupBy(F.col("up").alias("x")).agg(F.count(F.lit(1)).alias("_leaves"))
        inner = clear.where("is_inner").join(leaves, "x", "left").select("x", "up", F.col("up").alias("parent"), (1 + F.coalesce("_leaves", F.lit(0))).alias("size"))
        sized = climb(r, inner, sums=True, kept=("parent",))[0].df
        heavy = sized.where("parent IS NOT NULL").groupBy("parent").agg(F.max(F.struct("size", "x")).alias("_h")).select(F.col("_h.x").alias("x"), F.col("parent").alias("_on"))
        top = climb(r, sized.join(heavy, "x", "left").select("x", F.col("_on").alias("up"), "size", "parent"), kept=("size", "parent"))[0].df
        return r.cut(top.select("x", F.col("parent").alias("up"), "size", F.col("at").alias("chain"), F.col("far").alias("chain_pos")), hot="chain", hot_too="CASE WHEN x = chain THEN up END")

    @cached_property
    def chains(self) -> Kept:
        """chain, at (the chain its top hangs on, null for a root), pos (where), up."""
        placed = self.placed.df
        above = placed.select(F.col("x").alias("up"), F.col("chain").alias("at"), F.col("chain_pos").alias("pos"))
        return self.r.cut(join_hot(placed.where("x = chain").select("chain", "up"), above, "up", self.placed.hot_too, "left"), hot="at", n_open=F.count("at"))

    def _along(self, state: DataFrame) -> DataFrame:
        """Chain segments joined by doubling: chain, at, root, and sums or concatenations of the other columns.

        A tree has at most log2(names) chains on a path, so this takes few rounds.
        """
        hot, n_open, df = self.chains.hot, self.chains.facts["n_open"], state
        while n_open:
            own = [c for c in df.columns if c not in ("chain", "at", "root")]
            upper = df.select(F.col("chain").alias("at"), F.col("at").alias("_at"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in own])
            add = [(F.concat(f"_{c}", c) if t.startswith("array") else F.col(f"_{c}") + F.col(c)).alias(c) for c, t in df.dtypes if c in own]
            joined = join_hot(df.where("at IS NOT NULL"), upper, "at", hot).select("chain", F.col("_at").alias("at"), F.coalesce("_root", "root").alias("root"), *add)
            state = self.r.cut(joined.unionByName(df.where("at IS NULL")).coalesce(self.r.tasks), hot="at", n_open=F.count("at"))
            hot, n_open, df = state.hot, state.facts["n_open"], state.df
        return df

    @cached_property
    def labels(self) -> DataFrame:
        """Inner names with root_id and depth, read from the chains' labels."""
        state = self.chains.df.select("chain", "at", F.when(F.col("at").isNull(), F.col("chain")).alias("root"), F.coalesce(F.col("pos") + 1, F.lit(0)).alias("depth"))
        top = self._along(state).select("chain", F.col("root").alias("root_id"), F.col("depth").alias("_depth"))
        return join_hot(self.placed.df, top, "chain", self.placed.hot).select("x", "up", "size", "chain", "chain_pos", "root_id", (F.col("_depth") + F.col("chain_pos")).cast("int").alias("depth"))

    def _with_leaves(self, inner: DataFrame, of_leaf: dict, of_lone: dict) -> DataFrame:
        """Rows of ``inner`` and of the leaves, whose columns come from their parent's row (``_`` before its names)."""
        columns = [c for c in inner.columns if c != "x"]
        above = inner.select(F.col("x").alias("up"), *[F.col(c).alias(f"_{c}") for c in columns])
        rest = self.clear.df.where("NOT is_inner")
        leaves = join_hot(rest.where("up IS NOT NULL").select("x", "up"), above, "up", self.clear.hot)
        made = lambda df, of: df.select("x", *[of[c].cast(dict(inner.dtypes)[c]).alias(c) for c in columns])
        return inner.unionByName(made(leaves, of_leaf)).unionByName(made(rest.where("up IS NULL"), of_lone))

    def depths(self) -> DataFrame:
        """(x, root_id, depth) of every name clear of loops."""
        inner = self.labels.select("x", "root_id", "depth")
        out = self._with_leaves(inner, {"root_id": F.col("_root_id"), "depth": F.col("_depth") + 1}, {"root_id": F.col("x"), "depth": F.lit(0)})
        return self.r.leave(self.r.cut(out))

    def paths(self) -> DataFrame:
        """(x, root_id, depth, size, path): the path is the chain's prefix and its segment; size counts the subtree."""
        r, placed = self.r, self.placed
        segments = placed.df.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain_pos", "x"))), lambda s: s["x"]).alias("members"))
        segments = r.cut(segments)
        hung = join_hot(self.chains.df, segments.df.select(F.col("chain").alias("at"), F.col("members").alias("_above")), "at", self.chains.hot, "left")
        none = F.array().cast("array<string>")
        prefix = F.when(F.col("at").isNotNull(), F.slice("_above", F.lit(1), (F.col("pos") + 1).cast("int"))).otherwise(none)
        state = hung.select("chain", "at", F.when(F.col("at").isNull(), F.col("chain")).alias("root"), prefix.alias("prefix"))
        whole = r.cut(self._along(state).select("chain", "prefix").join(segments.df, "chain"))
        inner = join_hot(self.labels, whole.df, "chain", placed.hot).select(
            "x", "root_id", "depth", "size", F.concat("prefix", F.slice("members", F.lit(1), (F.col("chain_pos") + 1).cast("int"))).alias("path")
        )
        of_leaf = {"root_id": F.col("_root_id"), "depth": F.col("_depth") + 1, "size": F.lit(1), "path": F.concat("_path", F.array("x"))}
        out = self._with_leaves(r.cut(inner).df, of_leaf, {"root_id": F.col("x"), "depth": F.lit(0), "size": F.lit(1), "path": F.array("x")})
        return r.leave(r.cut(out))

    def intervals(self) -> DataFrame:
        """(x, root_id, first, last): numbers of a preorder that walks the chain first.

        The names below x are those of its root with ``first`` in (first, last].
        """
        r, placed = self.r, self.placed.df
        heavy = placed.where("chain_pos > 0").select(F.col("up").alias("_on"), F.col("size").alias("_heavy"))
        light = placed.where("chain_pos = 0 AND up IS NOT NULL").select("x", "up", "size").unionByName(self.clear.df.where("NOT is_inner AND up IS NOT NULL").select("x", "up", F.lit(1).cast("long").alias("size")))
        # light siblings in order: sums per hash range first, so a hot parent is never one task
        ranges = max(64, -(-self.clear.n // SIBLINGS))
        light = light.withColumn("_range", F.pmod(F.xxhash64("x"), F.lit(ranges)))
        sums = light.groupBy("up", "_range").agg(F.sum("size").alias("_n"))
        before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("up").orderBy("_range")) - F.col("_n")).drop("_n")
        # parents' heavy sizes are few rows beside those of (parent, range), where they are added
        before = before.join(heavy, F.col("up") == F.col("_on"), "left").select("up", "_range", (1 + F.coalesce("_heavy", F.lit(0)) + F.col("_before")).alias("_before"))
        inside = light.withColumn("_in", F.sum("size").over(Window.partitionBy("up", "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        offset = r.cut(inside.join(before, ["up", "_range"]).select("x", (F.col("_before") + F.col("_in")).alias("offset"))).df
        state = self.chains.df.join(offset.withColumnRenamed("x", "chain"), "chain", "left").select(
            "chain", "at", F.when(F.col("at").isNull(), F.col("chain")).alias("root"), (F.coalesce("pos", F.lit(0)) + F.coalesce("offset", F.lit(0))).alias("first"))
        top = self._along(state).select("chain", F.col("first").alias("_top"))
        inner = join_hot(self.labels, top, "chain", self.placed.hot).select("x", "root_id", (F.col("_top") + F.col("chain_pos")).alias("first"), (F.col("_top") + F.col("chain_pos") + F.col("size") - 1).alias("last"))
        out = self._with_leaves(r.cut(inner).df, {"root_id": F.col("_root_id"), "first": F.col("_first"), "last": F.lit(0)}, {"root_id": F.col("x"), "first": F.lit(0), "last": F.lit(0)})
        leaf = self.clear.df.where("NOT is_inner AND up IS NOT NULL").select("x").join(offset, "x").select("x", F.col("offset").alias("_offset"))
        own = F.col("first") + F.coalesce("_offset", F.lit(0))
        done = out.join(leaf, "x", "left").select("x", "root_id", own.alias("first"), F.when(F.col("_offset").isNotNull(), own).otherwise(F.col("last")).alias("last"))
        return r.leave(r.cut(done))

    def pairs(self, tree: DataFrame) -> DataFrame:
        """(x, descendant) of the graph that ``tree`` (such pairs, each name itself included) lacks.

        The links left out of the tree are those of second parents and those to names on or
        below loops. Only they are walked: a hop leads from any name at or above such a link
        to the link's child, and what the tree has below the children met is added. A name
        on a loop is below itself.
        """
        r = self.r
        tree = r.cut(tree)
        r.sized(tree.n)
        beside = self.kept_edges.df.join(self.clear.df.where("up IS NOT NULL").select(F.col("up").alias("parent"), F.col("x").alias("child")), ["parent", "child"], "left_anti")
        # names on or below loops are in no tree, so they stand for themselves
        above = tree.df.select("x", F.col("descendant").alias("parent"))
        hops = join_dealt(beside, above, "parent", self.kept_edges.hot_too, "child", "left").select(F.coalesce("x", "parent").alias("src"), F.col("child").alias("dst"))
        pairs, before = r.cut(hops.distinct()), 0
        while pairs.n > before:
            before, pairs = pairs.n, r.cut(pairs.df.unionByName(_joined(pairs.df)).distinct())
        below = pairs.df.join(tree.df.select(F.col("x").alias("dst"), "descendant"), "dst", "left").select(F.col("src").alias("x"), F.coalesce("descendant", "dst").alias("descendant"))
        return r.leave(r.cut(below.distinct().join(tree.df, ["x", "descendant"], "left_anti")))


def tree_pairs(paths: DataFrame) -> DataFrame:
    """(x, descendant) along the tree, each name itself included: the chain segments of each path."""
    return paths.select(F.explode("path").alias("x"), F.col("x").alias("descendant"))
