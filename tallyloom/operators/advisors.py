"""Advice from usage events: clustering, partitioning, refresh plans, table and branch reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.graph import HOPS
from tallyloom.operators.hierarchy import endless
from tallyloom.session import Kept, Rounds

# fixed values: types that cannot be clustered or can be partitioned on
NOT_CLUSTERABLE = ("STRUCT", "ARRAY", "GEOGRAPHY", "JSON")
TIME_TYPES = ("TIMESTAMP", "DATE", "DATETIME")
INTEGER_TYPES = ("INT64", "INTEGER", "INT", "BIGINT")
# fixed values: functions around a time column that still let partitions be skipped
PRUNING_WRAPS = ("date", "timestamp", "datetime", "timestamptrunc", "datetimetrunc", "datetrunc", "timetrunc")
# fixed values: materializations that are built incrementally
INCREMENTAL = ("incremental", "materialized_view")


def base_type(c: Column) -> Column:
    """Type name without parameters: upper case, up to the first bracket."""
    return F.upper(F.trim(F.split(F.split(F.coalesce(c, F.lit("")), r"\(")[0], "<")[0]))


def _scaled(points: Column, models: Column) -> Column:
    return points * F.greatest(F.log2(models + 1), F.lit(1.0))


def cluster_scores(events: DataFrame) -> DataFrame:
    """(target, column, score, counters): how well each column would serve as a cluster key.

    Equality 3, IN 2.5, ranges 2, any of them under a function 0.5; joins 2; grouping 1;
    times log2(models + 1), at least 1. Other clauses and operators count nothing.
    Points are summed in tenths, so the order of rows never shows.
    """
    where, wrapped = F.col("clause") == "where", F.col("wrapping_fn") != ""
    ranges = F.col("operator").isin("between", "gt", "ge", "lt", "le")
    known = F.col("operator").isin("eq", "in") | ranges
    tenths = (
        F.when(where & known & wrapped, 5).when(where & (F.col("operator") == "eq"), 30).when(where & (F.col("operator") == "in"), 25)
        .when(where & ranges, 20).when(F.col("clause") == "join", 20).when(F.col("clause") == "group_by", 10).otherwise(0)
    )
    kind = {
        "n_eq": where & ~wrapped & (F.col("operator") == "eq"), "n_in": where & ~wrapped & (F.col("operator") == "in"), "n_range": where & ~wrapped & ranges,
        "n_wrapped": where & known & wrapped, "n_join": F.col("clause") == "join", "n_group": F.col("clause") == "group_by",
    }
    per_model = events.withColumn("_p", tenths).where("_p > 0").groupBy("target", "column", "downstream_model").agg(
        F.sum("_p").alias("_p"), *[F.count_if(c).alias(k) for k, c in kind.items()]
    )
    sums = per_model.groupBy("target", "column").agg(F.sum("_p").alias("_p"), F.count("downstream_model").alias("n_models"), *[F.sum(k).alias(k) for k in kind])
    return sums.withColumn("score", F.round(_scaled(F.col("_p") / 10, F.col("n_models")), 2)).drop("_p")


def cluster_advice(scores: DataFrame, columns: DataFrame, most: int = 4) -> DataFrame:
    """Ranked cluster keys per target, and the columns left out with the reason.

    ``columns``: (target, column, data_type, is_partition). Columns the catalog does not
    know stay in, with an empty type. ``most`` is kept within 1 to 4.
    """
    joined = scores.where("score > 0").join(columns, ["target", "column"], "left")
    kind = base_type(F.col("data_type"))
    reason = F.when(F.coalesce("is_partition", F.lit(False)), "partition column").when(kind.isin(*NOT_CLUSTERABLE), F.concat(F.lit("type "), kind))
    rated = joined.withColumn("excluded", F.coalesce(reason, F.lit(""))).withColumn("data_type", F.coalesce("data_type", F.lit("")))
    order = Window.partitionBy("target").orderBy((F.col("excluded") != "").cast("int"), F.desc("score"), "column")
    ranked = rated.withColumn("rank_no", F.when(F.col("excluded") == "", F.row_number().over(order)))
    return ranked.where((F.col("excluded") != "") | (F.col("rank_no") <= max(1, min(most, 4))))


def counted(n: str, one: str, many: str) -> Column:
    return F.when(F.col(n) == 1, F.lit(f"1 {one}")).when(F.col(n) > 1, F.concat(F.col(n).cast("string"), F.lit(f" {many}")))


def cluster_reasons() -> Column:
    """One phrase for each counter above 0, in fixed order."""
    return F.array_join(F.array_compact(F.array(
        counted("n_eq", "equality filter", "equality filters"), counted("n_in", "IN filter", "IN filters"), counted("n_range", "range filter", "range filters"),
        counted("n_wrapped", "filter under a function", "filters under functions"), counted("n_join", "join", "joins"), counted("n_group", "grouping", "groupings"),
    )), "; ")


def matches_current(recommended: DataFrame, current: DataFrame) -> DataFrame:
    """(target, recommended, current, matches): whether a target already has exactly the recommended columns.

    ``recommended`` (target, column) and ``current`` (target, columns); order and case don't
    count, and two empty lists don't match.
    """
    low = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)))
    wanted = recommended.groupBy("target").agg(F.collect_set("column").alias("_w"))
    rows = wanted.join(current.select("target", "columns"), "target", "left").select("target", low(F.col("_w")).alias("recommended"), low(F.col("columns")).alias("current"))
    return rows.withColumn("matches", (F.size("current") > 0) & (F.col("recommended") == F.col("current")))


#: Counters of filters that let partitions be skipped, and their operators.
_PARTITION_KINDS = {"n_between": ("between",), "n_range": ("gt", "ge", "lt", "le"), "n_eq": ("eq",), "n_in": ("in",)}


def partition_reasons() -> Column:
    """One phrase for each counter above 0, in fixed order."""
    return F.array_join(F.array_compact(F.array(
        counted("n_between", "BETWEEN filter", "BETWEEN filters"), counted("n_range", "range filter", "range filters"), counted("n_eq", "equality filter", "equality filters"),
        counted("n_in", "IN filter", "IN filters"), counted("n_wrapped", "filter whose function defeats pruning", "filters whose functions defeat pruning"),
    )), "; ")


def partition_scores(events: DataFrame, columns: DataFrame) -> DataFrame:
    """(target, column, data_type, score, granularity, ...) for time and integer columns in WHERE.

    BETWEEN 3, other ranges 2.5, equality 2, IN 1.5; a function that defeats pruning
    scores 0 and its model does not count; times the type's bonus and log2(models + 1).
    """
    typed = events.where(F.col("clause") == "where").join(columns, ["target", "column"]).withColumn("base", base_type(F.col("data_type")))
    typed = typed.where(F.col("base").isin(*TIME_TYPES, *INTEGER_TYPES))
    op = F.col("operator")
    defeated = (op == "fn") | ((F.col("wrapping_fn") != "") & ~F.col("wrapping_fn").isin(*PRUNING_WRAPS))
    tenths = F.when(defeated, 0).when(op == "between", 30).when(op.isin("gt", "ge", "lt", "le"), 25).when(op == "eq", 20).when(op == "in", 15)
    per_model = typed.withColumn("_p", tenths).where("_p IS NOT NULL").withColumn("_fn", defeated).groupBy("target", "column", "base", "downstream_model").agg(
        F.sum("_p").alias("_p"), F.count_if(~F.col("_fn")).alias("_good"), F.count_if("_fn").alias("n_wrapped"),
        *[F.count_if(~F.col("_fn") & op.isin(*ops)).alias(n) for n, ops in _PARTITION_KINDS.items()],
    )
    sums = per_model.groupBy("target", "column", "base").agg(
        F.sum("_p").alias("_p"), F.count_if(F.col("_good") > 0).alias("n_models"), F.sum("n_wrapped").alias("n_wrapped"), *[F.sum(n).alias(n) for n in _PARTITION_KINDS]
    )
    bonus = F.when(F.col("base").isin("TIMESTAMP", "DATE"), 1.5).when(F.col("base") == "DATETIME", 1.3).otherwise(1.0)
    return sums.select(
        "target", "column", F.col("base").alias("data_type"), F.round(_scaled(F.col("_p") / 10 * bonus, F.col("n_models")), 2).alias("score"), "n_models", "n_wrapped", *_PARTITION_KINDS,
        F.when(F.col("base").isin(*TIME_TYPES), "DAY").otherwise("RANGE_BUCKET").alias("granularity"),
    )


def partition_advice(scores: DataFrame, alternatives: int = 4) -> DataFrame:
    """The best column of each target (rank 1) and up to four others; scores of 0 are dropped."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "column")
    return scores.where("score > 0").withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= 1 + alternatives)


def pruning_split(children: DataFrame, pruning: DataFrame, materialized: DataFrame) -> DataFrame:
    """Per target: children that prune by its best column, those that don't, and how they are built.

    ``children`` (target, model), ``pruning`` (target, model), ``materialized`` (model, materialized).
    """
    good = pruning.select("target", "model", F.lit(True).alias("_good")).distinct()
    rows = children.distinct().join(good, ["target", "model"], "left").join(materialized, "model", "left")
    prunes, inc = F.coalesce("_good", F.lit(False)), F.coalesce("materialized", F.lit("")).isin(*INCREMENTAL)
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(inc).alias("n_incremental"), F.count_if(prunes & inc).alias("pruning_incremental"), F.count_if(~prunes & inc).alias("scanning_incremental"),
        F.count_if(prunes & ~inc).alias("pruning_tables"), F.count_if(~prunes & ~inc).alias("scanning_tables"),
        F.round(100.0 * F.count_if(prunes) / F.count(F.lit(1)), 1).alias("impact_pct"),
    )


# -- refresh ------------------------------------------------------------------

def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, level): longest way from a name without parents; names on or below loops come last, one level after all others.

    ``edges`` (src, dst) are restricted to ``nodes`` (x). Loops are set apart first; then
    the names whose level grew pass it on, HOPS links a round.
    """
    r = Rounds(edges.sparkSession, 1)
    inside = edges.join(nodes.select(F.col("x").alias("src")), "src", "left_semi").join(nodes.select(F.col("x").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    graph = r.enter(inside)
    bad = r.cut(endless(r, graph)).df
    hop = r.cut(graph.df.join(bad.withColumnRenamed("x", "dst"), "dst", "left_anti").select("src", "dst")).df
    names = r.cut(nodes.where("x IS NOT NULL").select("x").distinct().join(bad, "x", "left_anti"))
    state = r.cut(names.df.select("x", F.lit(0).alias("level")), top=F.max("level"))
    new = r.cut(names.df.join(hop.select(F.col("dst").alias("x")).distinct(), "x", "left_anti").select("x", F.lit(0).alias("level")))
    while new.n:
        step, steps = new.df, None
        for _ in range(HOPS):
            step = step.withColumnRenamed("x", "src").join(hop, "src").groupBy(F.col("dst").alias("x")).agg((F.max("level") + 1).alias("level"))
            steps = step if steps is None else steps.unionByName(step)
        best = steps.groupBy("x").agg(F.max("level").alias("_l"))
        after = state.df.join(best, "x", "left").select("x", F.greatest("level", F.coalesce("_l", "level")).alias("level"), (F.col("_l") > F.col("level")).alias("_new"))
        state = r.cut(after, n_new=F.count_if("_new"), top=F.max("level"))
        new = Kept(state.df.where("_new").select("x", "level"), state.facts["n_new"])
    last = bad.join(nodes.select("x").distinct(), "x", "left_semi").select("x", F.lit(state.facts["top"] + 1).alias("level"))
    return r.leave(r.cut(state.df.select("x", "level").unionByName(last)))


def propagate_changes(changed: DataFrame, edges: DataFrame, events: DataFrame, stars: DataFrame, no_sql: DataFrame) -> DataFrame:
    """(model, column): what of each model is affected by the changes; column ``*`` is all of it.

    ``changed`` (model, column), ``edges`` (parent, model), ``events`` (parent, model,
    column) for every use of a parent's column, ``stars`` (parent, model, bare_star) for
    every query that names the parent, ``no_sql`` (model). A change passes on if the
    model has no text, takes a bare star of the parent, or uses a changed column; if all
    of the parent changed, any use or reference passes everything on. The rounds add pairs
    until none is new, so loops in the graph end them too.
    """
    r = Rounds(changed.sparkSession, 1)
    uses = r.enter(events.select("parent", "model", "column").distinct())
    stars, edges = r.cut(stars.select("parent", "model", "bare_star").distinct()), r.cut(edges.select("parent", "model").distinct())
    blind = edges.df.join(no_sql.select("model").distinct(), "model", "left_semi").select("parent", "model")
    everything = r.cut(blind.union(stars.df.where("bare_star").select("parent", "model")).distinct()).df
    touching = r.cut(uses.df.select("parent", "model").union(stars.df.select("parent", "model")).distinct()).df
    known = frontier = r.cut(changed.select("model", "column").distinct())
    while frontier.n:
        parents = frontier.df.withColumnRenamed("model", "parent")
        star = F.lit("*").alias("column")
        step = (
            parents.join(everything, "parent").select("model", star)
            .union(parents.where("column = '*'").join(touching, "parent").select("model", star))
            .union(parents.where("column <> '*'").join(uses.df, ["parent", "column"]).select("model", "column"))
        ).distinct()
        frontier = r.cut(step.join(known.df, ["model", "column"], "left_anti"))
        known = r.cut(known.df.unionByName(frontier.df).coalesce(r.tasks))
    return r.leave(known)


def refresh_plan(downstream: DataFrame, affected: DataFrame, changed: DataFrame, models: DataFrame) -> DataFrame:
    """(model, bucket, reason) of every model below a change, and of the changed models.

    ``models`` (model, materialized, unique_keys, partition_cols, has_sql). Full: changed,
    no text, all affected, not incremental, or a unique key or partition column affected;
    otherwise incremental; models that nothing reaches are skipped. A changed model that is
    also downstream of another counts once, as changed.
    """
    cols = affected.groupBy("model").agg(F.collect_set("column").alias("cols"))
    rows = downstream.select("model").union(changed.select("model")).distinct().join(models, "model", "left").join(cols, "model", "left").join(changed.select("model", F.lit(True).alias("_self")).distinct(), "model", "left")
    none = F.array().cast("array<string>")
    hit = lambda c: F.arrays_overlap(F.coalesce(c, none), F.coalesce("cols", none))
    reason = (
        F.when(F.col("_self"), "changed model itself").when(F.col("cols").isNull(), "not affected").when(~F.coalesce("has_sql", F.lit(False)), "no SQL")
        .when(F.array_contains("cols", "*"), "whole row affected").when(~F.coalesce("materialized", F.lit("")).isin(*INCREMENTAL), "not incremental")
        .when(hit("unique_keys"), "unique key affected").when(hit("partition_cols"), "partition column affected").otherwise("safe")
    )
    bucket = F.when(F.col("reason") == "not affected", "skip").when(F.col("reason") == "safe", "incremental").otherwise("full")
    return rows.withColumn("reason", reason).select("model", bucket.alias("bucket"), "reason")


# -- reviews ------------------------------------------------------------------

def analyze_rules(tables: DataFrame) -> DataFrame:
    """(model, priority, rule) for each rule that applies to a table.

    Columns: model, materialized, total_gb, n_queries, partition_col, cluster_cols, filters
    (arrays), expiration_days, partition_count, potential_savings, live_partition_col.
    """
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    none = F.array().cast("array<string>")
    clusters, filters = F.coalesce("cluster_cols", none), F.coalesce("filters", none)
    parted = F.col("partition_col").isNotNull()
    uncovered = F.array_except(filters, clusters)
    rule = lambda when, priority, name: F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("rule")))
    rules = F.array_compact(F.array(
        rule(~parted & (v("total_gb") > 10), "HIGH", "add_partition"),
        rule((F.size(clusters) == 0) & (v("total_gb") > 5) & (v("n_queries") > 100), "MEDIUM", "add_clustering"),
        rule(parted & F.col("expiration_days").isNull() & (v("partition_count") > 365), "MEDIUM", "partition_expiration"),
        rule(parted & F.col("live_partition_col").isNotNull() & (F.lower("partition_col") != F.lower("live_partition_col")), "LOW", "config_mismatch"),
        rule((F.size(clusters) > 0) & (F.size(uncovered) > 0), "LOW", "clustering_optimization"),
        rule(v("potential_savings") > 1, "LOW", "billing_model"),
    ))
    return tables.where(F.coalesce("materialized", F.lit("view")) != "view").select("model", F.explode(rules).alias("r")).select("model", "r.priority", "r.rule")


def downstream_alignment(children: DataFrame) -> DataFrame:
    """(root, model, alignment): whether the first five filters of a child meet the root's layout.

    Columns: root, model, filters (array), root_partition, root_clusters (array). A filter
    that hits neither makes the child SUBOPTIMAL, or POOR if the root has no layout at all.
    """
    none = F.array().cast("array<string>")
    layout = F.transform(F.array_compact(F.concat(F.array("root_partition"), F.coalesce("root_clusters", none))), F.lower)
    missed = F.filter(F.slice(F.coalesce("filters", none), 1, 5), lambda c: ~F.array_contains(layout, F.lower(c)))
    return children.select("root", "model", F.when(F.size(missed) == 0, "GOOD").when(F.size(layout) == 0, "POOR").otherwise("SUBOPTIMAL").alias("alignment"), missed.alias("missed"))


def upstream_alignment(parents: DataFrame) -> DataFrame:
    """(root, model, alignment): whether a parent is laid out for what the root filters on.

    Columns: root, model, materialized, has_partition, layout (array), root_has_partition, root_filters (array).
    """
    first = F.slice(F.coalesce("root_filters", F.array().cast("array<string>")), 1, 3)
    layout = F.transform(F.coalesce("layout", F.array().cast("array<string>")), F.lower)
    short = F.exists(first, lambda c: ~F.array_contains(layout, F.lower(c)))
    return parents.select("root", "model", F.when(F.coalesce("materialized", F.lit("view")) == "view", "N/A").when(F.col("root_has_partition") & ~F.coalesce("has_partition", F.lit(False)), "HIGH").when(short, "MEDIUM").otherwise("ALIGNED").alias("alignment"))


def common_filters(children: DataFrame, most: int, least: int) -> DataFrame:
    """(root, column, n_models): columns that at least ``least`` children filter on, the ``most`` commonest; ties by name."""
    counts = children.select("root", "model", F.explode("filters").alias("column")).distinct().groupBy("root", "column").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= least)
    return counts.withColumn("rank_no", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n_models"), "column"))).where(F.col("rank_no") <= most)


def branch_recommendations(upstream: DataFrame, downstream: DataFrame, layout: DataFrame, most: int = 2, least: int = 2) -> DataFrame:
    """(root, kind, subject, n_models, priority): what to change around a model.

    ``upstream`` (root, model, alignment), ``downstream`` (root, model, alignment, filters),
    ``layout`` (root, root_partition, root_clusters). Parents of HIGH alignment get a
    partition; the ``most`` commonest columns that at least ``least`` poorly aligned children
    filter on, beyond the root's layout, become cluster keys; the commonest filter of all
    children partitions a root without partition. Ties go by name.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), F.lower)
    own = layout.select("root", F.lower("root_partition").alias("_p"), low(F.col("root_clusters")).alias("_c"))
    parents = upstream.where("alignment = 'HIGH'").select("root", F.lit("upstream_partition").alias("kind"), F.col("model").alias("subject"), F.lit(None).cast("long").alias("n_models"), F.lit("HIGH").alias("priority")).distinct()
    used = downstream.select("root", "model", "alignment", F.explode(F.slice(F.coalesce("filters", none), 1, 5)).alias("subject")).distinct().join(own, "root")
    counts = lambda rows: rows.groupBy("root", "subject").agg(F.count_distinct("model").alias("n_models")).where(F.col("n_models") >= least)
    first = lambda rows, n: rows.withColumn("_i", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n_models"), "subject"))).where(F.col("_i") <= n)
    name = F.lower("subject")
    missing = used.where("alignment IN ('POOR', 'SUBOPTIMAL')").where(~F.coalesce(name == F.col("_p"), F.lit(False)) & ~F.array_contains("_c", name))
    clusters = first(counts(missing), most).select("root", F.lit("add_clustering").alias("kind"), "subject", "n_models", F.lit("MEDIUM").alias("priority"))
    parts = first(counts(used.where("_p IS NULL")), 1).select("root", F.lit("add_partition").alias("kind"), "subject", "n_models", F.lit("HIGH").alias("priority"))
    return parents.unionByName(clusters).unionByName(parts)


def refresh_summary(plan: DataFrame) -> DataFrame:
    """(bucket, n_models, models): models of each bucket, sorted and joined by spaces."""
    return plan.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_models"), F.array_join(F.array_sort(F.collect_list("model")), " ").alias("models"))


def refresh_commands(plan: DataFrame, program: str = "dbt") -> DataFrame:
    """(bucket, command): one command for each bucket that is to be built."""
    flag = F.when(F.col("bucket") == "full", " --full-refresh").otherwise("")
    return refresh_summary(plan).where("bucket <> 'skip'").select("bucket", F.concat(F.lit(f"{program} run"), flag, F.lit(" --select "), "models").alias("command"))


def parse_columns(specs: list[str]) -> dict[str, set[str]]:
    """Columns by model of ``MODEL:c1,c2`` texts, lower-case; repeated models are united, an empty list stays empty."""
    out: dict[str, set[str]] = {}
    for spec in specs:
        model, colon, names = spec.partition(":")
        if not colon or not model.strip():
            raise ValueError(f"{spec!r} is not MODEL:column,column")
        out.setdefault(model.strip(), set()).update(n.strip().lower() for n in names.split(",") if n.strip())
    return out


def narrowed(changed: DataFrame, specs: dict[str, set[str]]) -> DataFrame:
    """``changed`` (model, column) with whole-model changes of the named models replaced by their columns."""
    rows = [(m, c) for m, cs in specs.items() for c in sorted(cs)]
    named = changed.sparkSession.createDataFrame(rows, "model string, column string")
    return changed.where(~F.col("model").isin(list(specs))).select("model", "column").unionByName(named).distinct()


def missing_models(requested: DataFrame, known: DataFrame) -> DataFrame:
    """(name): requested names that no model has."""
    return requested.select("name").distinct().join(known.select("name"), "name", "left_anti")
