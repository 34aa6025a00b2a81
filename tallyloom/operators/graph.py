"""Directed graphs as edge tables (src, dst): neighbours, reach, trees, naming of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import Kept, Rounds, cut

#: Hops of a breadth-first round.
HOPS = 4


def edge_table(rows: DataFrame, key: str, neighbours: str, forward: bool = True) -> DataFrame:
    """(src, dst, pos) from adjacency lists; null lists and entries give no edge."""
    pairs = rows.select(F.col(key).alias("a"), F.posexplode(neighbours).alias("pos", "b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select(*([F.col("a").alias("src"), F.col("b").alias("dst")] if forward else [F.col("b").alias("src"), F.col("a").alias("dst")]), "pos")


def simple_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (declared or at an edge's end) and edges without parallels; of parallel edges the first by ``pos`` stays."""
    kept = edges.groupBy("src", "dst").agg(F.min_by("transform", "pos").alias("transform"))
    ends = kept.select(F.col("src").alias("id")).union(kept.select(F.col("dst").alias("id")))
    return nodes.select("id").union(ends).distinct(), kept


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def direct(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): one hop from each start (column ``start``)."""
    return edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct().join(starts.select("start").distinct(), "start", "left_semi")


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, level): everything reachable from each start, with the least number of hops.

    Breadth first for all starts at once, HOPS hops a round; every round joins only the
    pairs that are new. The start itself is reported only if it lies on a loop. Unknown
    starts give no rows, null names are no names.
    """
    r = Rounds(edges.sparkSession, 1)
    hop = r.enter(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("node"), "dst").distinct()).df
    first = starts.select("start").distinct().join(hop.withColumnRenamed("node", "start"), "start").select("start", F.col("dst").alias("node"), F.lit(1).alias("level"))
    new = r.cut(first)
    out, level = new, 1
    while new.n:
        r.sized(max(new.n * HOPS, 1))
        step, steps = new.df.select("start", "node"), None
        for i in range(1, HOPS + 1):
            step = step.join(hop, "node").select("start", F.col("dst").alias("node")).distinct()
            at = step.withColumn("level", F.lit(level + i))
            steps = at if steps is None else steps.unionByName(at)
        steps = steps.groupBy("start", "node").agg(F.min("level").alias("level")).join(out.df, ["start", "node"], "left_anti")
        level += HOPS
        # names met on the way were expanded in the same round, so only the last ones go on
        fresh = r.cut(steps, n_last=F.count_if(F.col("level") == level))
        r.sized(max(out.n + fresh.n, 1))
        out = r.cut(out.df.unionByName(fresh.df).coalesce(r.tasks))
        new = Kept(fresh.df.where(F.col("level") == level), fresh.facts["n_last"])
    return r.leave(out)


def lineage_query(nodes: DataFrame, edges: DataFrame, ids: DataFrame, downstream: bool) -> DataFrame:
    """(start, node, is_direct, model, data_type): direct and transitive lineage of known columns."""
    edges = edges if downstream else reverse(edges)
    known = ids.join(nodes.select(F.col("id").alias("start")), "start", "left_semi")
    return reach(edges, known).join(nodes.select(F.col("id").alias("node"), "model", "data_type"), "node", "left").select("start", "node", (F.col("level") == 1).alias("is_direct"), "model", "data_type")


def split_column_id(c: str) -> tuple:
    """(model, column) of ``model.column``: split at the last dot."""
    return F.regexp_replace(F.col(c), r"\.[^.]*$", ""), F.substring_index(F.col(c), ".", -1)


def relation_edges(edges: DataFrame, known: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, src, dst): edges below each start that a relation tree lists.

    Tests are neither listed nor crossed, names that are no known node are dropped; each
    name is expanded once per start, so every edge out of a reached name occurs once.
    """
    listed = edges.select("src", "dst").distinct().where(~F.col("dst").startswith("test.")).join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    reached = reach(listed, starts).select("start", F.col("node").alias("src"))
    sources = reached.union(starts.select("start", F.col("start").alias("src"))).distinct()
    return sources.join(cut(listed), "src").select("start", "src", "dst")


def describe(nodes: DataFrame) -> DataFrame:
    """(node, path, table_name, type): file without ``models/``, ``schema.table`` and resource type of nodes."""
    name = F.coalesce(F.nullif("alias", F.lit("")), F.col("name"), F.lit(""))
    return nodes.select(
        "node", F.regexp_replace(F.coalesce("original_file_path", F.lit("")), "^models/", "").alias("path"),
        F.concat_ws(".", F.nullif("schema", F.lit("")), name).alias("table_name"), F.coalesce("resource_type", F.lit("")).alias("type"),
    )


def neighbours(edges: DataFrame, described: DataFrame, compact_above: int = 20) -> DataFrame:
    """(start, node, path, table_name, type, level): neighbours that are known and no tests; level 0 in lists of more than ``compact_above``."""
    rows = edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct().join(described.where("type <> 'test'"), "node")
    many = rows.groupBy("start").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(many, "start").select("start", "node", "path", "table_name", "type", F.when(F.col("_n") > compact_above, F.lit(0)).alias("level"))


def relation_tree(edges: DataFrame, described: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, row_no, node, level, path, table_name, type): trees of relations in pre-order.

    ``edges`` (src, dst, pos). A name is listed under each expanded name that has it, and
    expanded where it comes first; tests and unknown names are neither listed nor crossed.
    Pre-order is sequential, so one tree is made by one task from its own links, as numbers.
    """
    listed = cut(edges.join(described.where("type <> 'test'").select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "pos"))
    pairs = reach(listed, starts).select("start", F.col("node").alias("src"))
    pairs = pairs.union(starts.select("start", F.col("start").alias("src"))).distinct()
    rows = pairs.join(listed, "src").select("start", "src", "dst", "pos")

    def walk(links):  # noqa: ANN001, ANN202 - a pandas frame in and out
        import pandas as pd

        start = links["start"].iloc[0]
        below: dict[str, list[str]] = {}
        for src, dst in links.sort_values(["pos", "dst"])[["src", "dst"]].itertuples(index=False):
            below.setdefault(src, []).append(dst)
        out, expanded, todo = [], {start}, [iter([(0, x) for x in below.get(start, [])])]
        while todo:
            level, x = next(todo[-1], (None, None))
            if x is None:
                todo.pop()
                continue
            out.append((start, len(out), x, level))
            if x not in expanded:
                expanded.add(x)
                todo.append(iter([(level + 1, y) for y in below.get(x, [])]))
        return pd.DataFrame(out, columns=["start", "row_no", "node", "level"])

    tree = rows.groupBy("start").applyInPandas(walk, "start string, row_no int, node string, level int")
    return tree.join(described, "node").select("start", "row_no", "node", "level", "path", "table_name", "type")


def downstream_models(edges: DataFrame, starts: DataFrame, models: DataFrame) -> DataFrame:
    """(start, model, level): models below each start; tests and sources are crossed, not reported."""
    below = reach(edges, starts).where(F.col("node").startswith("model."))
    return below.join(models.select(F.col("id").alias("node")), "node", "left_semi").select("start", F.col("node").alias("model"), "level")


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, n_parts, node): names by which queries may call a node's table, lower-case.

    Full names belong to the last node that has them, two-part names to the first, and
    bare names only to a node that is alone with it. ``nodes``: id, database, schema,
    alias, name, pos.
    """
    names = nodes.select("id", "pos", "database", "schema", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("alias"), F.lower("name"))))).alias("t"))
    low = lambda *cs: F.lower(F.concat_ws(".", *cs))
    full = names.where("database IS NOT NULL AND schema IS NOT NULL").groupBy(low("database", "schema", "t").alias("key")).agg(F.max_by("id", F.struct("pos", "id")).alias("node"))
    two = names.where("schema IS NOT NULL").groupBy(low("schema", "t").alias("key")).agg(F.min_by("id", F.struct("pos", "id")).alias("node"))
    one = names.groupBy(F.col("t").alias("key")).agg(F.min("id").alias("node"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    parts = [(full, 3), (two, 2), (one, 1)]
    out = None
    for df, n in parts:
        df = df.select("key", F.lit(n).alias("n_parts"), "node")
        out = df if out is None else out.unionByName(df)
    return out


def resolve_tables(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``node`` to rows with ``table_name``: the most qualified of its keys that is known."""
    name = F.lower("table_name")
    wanted = tables.select("table_name").distinct().select("table_name", F.explode(F.array_distinct(F.array(
        F.struct(F.substring_index(name, ".", -3).alias("key"), F.lit(3).alias("n_parts")), F.struct(F.substring_index(name, ".", -2).alias("key"), F.lit(2).alias("n_parts")),
        F.struct(F.substring_index(name, ".", -1).alias("key"), F.lit(1).alias("n_parts")),
    ))).alias("k")).select("table_name", "k.*")
    met = wanted.join(keys, ["key", "n_parts"]).groupBy("table_name").agg(F.max_by("node", "n_parts").alias("node"))
    return tables.join(met, "table_name", "left")


def column_lineage(symbolic: DataFrame, nodes: DataFrame, columns: DataFrame, outside: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lineage nodes, lineage edges) of all models from their symbolic lineage.

    ``symbolic``: see plans.usage.extract_lineage; ``nodes``: see table_keys, plus
    short_name; ``columns`` (id, column, data_type) from the catalog, used to expand
    stars. Tables that resolve to no node and columns a star leaves out give no edge; with
    ``outside`` such a table goes by its own name (its bare stars can't be expanded).
    """
    named = resolve_tables(symbolic.where("table_name IS NOT NULL"), table_keys(nodes)).join(nodes.select(F.col("id").alias("node"), "short_name"), "node", "left")
    rows = named.withColumn("up", F.coalesce("short_name", "table_name")) if outside else named.where("node IS NOT NULL").withColumnRenamed("short_name", "up")
    down = nodes.select(F.col("id").alias("model"), F.col("short_name").alias("down"))
    plain = rows.where("output <> '*'").select("model", "up", "column", "output", "transform")
    left_out = rows.where("transform = 'except'").select("model", "node", "column").distinct()
    star = rows.where("output = '*' AND column = '*'").select("model", "node", "up").distinct()
    wide = star.join(columns.select(F.col("id").alias("node"), F.lower("column").alias("column")), "node").join(left_out, ["model", "node", "column"], "left_anti")
    both = plain.unionByName(wide.select("model", "up", "column", F.col("column").alias("output"), F.lit("passthrough").alias("transform")))
    edges = both.join(down, "model").select(F.concat_ws(".", "up", F.lower("column")).alias("src"), F.concat_ws(".", "down", F.lower("output")).alias("dst"), "transform")
    edges = edges.groupBy("src", "dst").agg(F.min("transform").alias("transform"))
    declared = columns.join(nodes.select("id", "short_name"), "id").select(F.concat_ws(".", "short_name", F.lower("column")).alias("id"), F.upper(F.coalesce("data_type", F.lit("STRING"))).alias("data_type"))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(declared.select("id")).distinct()
    out = ids.join(declared.groupBy("id").agg(F.max("data_type").alias("data_type")), "id", "left")
    model, column = split_column_id("id")
    return out.select("id", model.alias("model"), column.alias("column"), "data_type"), edges


def query_closure(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """(dataset, query, table_name): tables a query reads itself or through the queries it names.

    ``refs`` (dataset, query, other), ``tables`` (dataset, query, table_name); references
    stay inside a dataset, loops and dangling references are harmless.
    """
    node = lambda q: F.struct("dataset", F.col(q).alias("query"))
    edges = refs.select(node("query").alias("src"), node("other").alias("dst"))
    starts = tables.select(node("query").alias("start")).union(refs.select(node("query").alias("start"))).distinct()
    pairs = reach(edges, starts).select("start", "node").union(starts.select("start", F.col("start").alias("node"))).distinct()
    return pairs.join(tables.select(node("query").alias("node"), "table_name"), "node").select("start.dataset", "start.query", "table_name").distinct()


def top_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
