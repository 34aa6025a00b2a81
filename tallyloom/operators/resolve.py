"""Where a model is to be found, what state it is in, and what is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitize_identifier(c: str) -> Column:
    """At most 1,024 characters, others than letters, digits, _ and - as _, and a leading _ where needed."""
    body = F.regexp_replace(F.substring(F.col(c), 1, 1024), r"[^A-Za-z0-9_-]", "_")
    return F.when(body.rlike(r"^[A-Za-z_]"), body).otherwise(F.concat(F.lit("_"), body))


def table_parts(c: str, at_first: bool = False) -> tuple[Column, Column]:
    """(dataset, table) of ``dataset__table``; the table is what follows the last (or first) ``__``."""
    if at_first:
        return F.regexp_extract(F.col(c), r"^(.*?)__(.*)$", 1), F.regexp_extract(F.col(c), r"^(.*?)__(.*)$", 2)
    return F.regexp_extract(F.col(c), r"^(.*)__(.*?)$", 1), F.regexp_extract(F.col(c), r"^(.*)__(.*?)$", 2)


def format_bytes(n: Column) -> Column:
    """MB below 1,000 MB, else GB, with one decimal; null counts as 0."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    mb = n / 1024**2
    return F.when(mb < 1000, F.concat(F.format_string("%.1f", mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))


def fallback(requested: DataFrame, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, level, unique_id, searched): each requested name at the first level that has it.

    Each level is a name and (name, unique_id), several ids of a name by the smallest.
    ``searched`` lists the levels up to the hit, all of them if there is none.
    """
    out = requested.select("name").distinct()
    for i, (_, known) in enumerate(levels):
        out = out.join(known.groupBy("name").agg(F.min("unique_id").alias(f"_u{i}")), "name", "left")
    hit = [F.when(F.col(f"_u{i}").isNotNull(), F.lit(label)) for i, (label, _) in enumerate(levels)]
    number = F.coalesce(*[F.when(F.col(f"_u{i}").isNotNull(), i + 1) for i in range(len(levels))], F.lit(len(levels)))
    return out.select(
        "name", F.coalesce(*hit).alias("level"), F.coalesce(*[F.col(f"_u{i}") for i in range(len(levels))]).alias("unique_id"),
        F.array_join(F.slice(F.array(*[F.lit(label) for label, _ in levels]), F.lit(1), number), ",").alias("searched"),
    )


def readable_bytes(n: Column) -> Column:
    """B, KB, MB, GB or TB by 1,024, with two decimals (none for bytes); null stays null."""
    n = n.cast("double")
    out = F.concat(F.format_string("%.2f", n / 1024**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B"))).otherwise(out))


def fallback_warnings(resolved: DataFrame) -> DataFrame:
    """(name, type, severity): warnings for names not found in the first level, and errors for those found in none.

    Only names with ``__`` can be asked for in the warehouse, so another name's ``live`` hit
    does not count. ``resolved``: see fallback.
    """
    unasked = (F.col("level") == "live") & ~F.col("name").contains("__")
    lost = F.col("level").isNull() | unasked
    kind = F.when(lost, "model_not_found").when(F.col("level") == "dev", "using_dev_manifest").when(F.col("level") == "live", "using_live_table")
    return resolved.select("name", kind.alias("type"), F.when(lost, "error").otherwise("warning").alias("severity")).where("type IS NOT NULL")


def git_manifest_warnings() -> Column:
    """Array of (type, severity) where the state of a model's file and the manifests disagree.

    Columns: use_dev, modified, committed, in_prod, in_dev, has_dev_manifest. Asked for the
    development version of a model that is not in its manifest, or for a changed model that
    is in neither, nothing else is said.
    """
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    dev, changed, committed = f("use_dev"), f("modified"), f("committed")
    say = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))
    new = say(~dev & ~f("in_prod") & f("in_dev") & changed, "new_model_candidate", "warning")
    absent = dev & ~f("in_dev")
    stop = F.when(absent, F.array(F.coalesce(say(changed | committed, "modified_not_compiled", "warning"), say(F.lit(True), "dev_without_changes", "warning")))).when(
        changed & ~f("in_prod") & ~f("in_dev"), F.array(say(F.lit(True), "file_not_compiled", "error")))
    rest = F.array(
        new, say(dev & ~changed & ~committed, "dev_without_changes", "warning"), say(dev & ~changed & committed, "dev_committed_not_merged", "info"),
        say(~dev & changed, "git_mismatch", "warning"), say(~dev & ~changed & committed, "git_committed", "info"), say(dev & ~f("has_dev_manifest"), "dev_manifest_missing", "error"),
    )
    return F.coalesce(stop, F.array_compact(rest))


def lifecycle_state() -> Column:
    """State of a model from its flags.

    Columns: enabled, file_path, is_renamed, renamed_from, renamed_to, exists, is_deleted,
    in_prod, in_dev, is_new, is_modified, is_committed. Null flags count as false, a null
    ``enabled`` or ``exists`` as true.
    """
    f = lambda c, missing=False: F.coalesce(F.col(c), F.lit(missing))
    path = F.coalesce(F.regexp_replace("file_path", r"\\", "/"), F.lit(""))
    renamed = f("is_renamed") & F.col("renamed_from").isNotNull() & F.col("renamed_to").isNotNull()
    gone = f("is_deleted") | ~f("exists", True)
    new = F.when(f("is_new") | ~f("is_committed"), "new_uncommitted").when(f("in_dev"), "new_in_dev_manifest").otherwise("new_committed")
    kept = F.when(~f("is_modified"), "prod_stable").when(f("in_dev"), "modified_in_dev_manifest").otherwise("modified_uncommitted")
    return (
        F.when(~f("enabled", True), "deprecated_disabled").when(F.concat(F.lit("/"), path).contains("/deprecated/"), "deprecated_folder")
        .when(renamed, F.when(path.contains(F.col("renamed_from")), "renamed_old").otherwise("renamed_new"))
        .when(gone, F.when(f("in_prod"), "deleted_locally").otherwise("not_found")).when(~f("in_prod"), new).otherwise(kept)
    )


def git_flags(code: str, path: str) -> dict[str, Column]:
    """Flags of one line of ``git status --porcelain``: its two-letter code and its path part."""
    c = F.coalesce(F.col(code), F.lit(""))
    renamed = c.startswith("R")
    return {
        "is_new": c.isin("??", "A "), "is_tracked": c != "??", "is_modified": c.contains("M") | (c == "A "), "is_deleted": c.contains("D"), "is_renamed": renamed,
        "renamed_from": F.when(renamed, F.split(F.col(path), " -> ")[0]), "renamed_to": F.when(renamed, F.try_element_at(F.split(F.col(path), " -> "), F.lit(2))),
    }


def state_warnings() -> Column:
    """Array of warnings where a model's files and manifests disagree; a deleted file ends the list."""
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))
    rest = F.array_compact(F.array(
        w(f("is_new") & ~f("in_dev"), "file_not_compiled", "error"), w(f("is_modified") & ~f("in_dev"), "modified_not_in_dev", "warning"),
        w(f("is_modified") & f("in_prod"), "prod_is_older", "warning"), w(~f("is_tracked"), "untracked_file", "info"),
        w(f("is_renamed"), "renamed_file", "info"), w(f("in_dev") & ~f("in_prod"), "only_in_dev", "info"),
    ))
    return F.when(f("is_deleted"), F.array(F.struct(F.lit("file_deleted").alias("type"), F.lit("error").alias("severity")))).otherwise(rest)


#: States whose columns the production catalog can't know.
FRESH_STATES = ("modified_uncommitted", "modified_committed", "modified_in_dev_manifest", "new_uncommitted", "new_committed", "new_in_dev_manifest")


def column_source(state: Column, has_catalog: Column, catalog_age_hours: Column, most_hours: float = 24) -> Column:
    """``catalog`` if the model's state allows it and the catalog is there and fresh, else ``live``."""
    return F.when(~state.isin(*FRESH_STATES) & F.coalesce(has_catalog, F.lit(False)) & (catalog_age_hours <= most_hours), "catalog").otherwise("live")


def context_bundle(requested: DataFrame, bundles: DataFrame) -> DataFrame:
    """One row per requested name; names that are not known keep nulls."""
    return requested.select("name").distinct().join(bundles, "name", "left")


def compiled_sql(models: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(unique_id, sql, error): the manifest's text if not blank, else the file's; exactly one of both is set."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    sql = F.coalesce(F.when(filled(F.col("compiled_code")).isNotNull(), F.col("compiled_code")), F.when(filled(F.col("disk_sql")).isNotNull(), F.col("disk_sql")))
    return models.join(on_disk.select("original_file_path", "disk_sql"), "original_file_path", "left").select("unique_id", sql.alias("sql"), F.when(sql.isNull(), "no compiled SQL").alias("error"))


def sql_coverage(models: DataFrame) -> DataFrame:
    """(n_models, with_sql, enough, diagnosis): whether at least half of the models have SQL."""
    out = models.agg(F.count(F.lit(1)).alias("n_models"), F.count_if(F.trim(F.coalesce("compiled_code", F.lit(""))) != "").alias("with_sql"))
    twice = 2 * F.col("with_sql")
    return out.select("n_models", "with_sql", (twice >= F.col("n_models")).alias("enough"), F.when(F.col("with_sql") == 0, "none compiled").when(twice < F.col("n_models"), "mostly uncompiled").otherwise("ok").alias("diagnosis"))


def safe_path(path: str) -> str:
    """``path`` itself, unless it climbs, leaves the home folders or could be read by a shell as more than a path."""
    import re

    if ".." in path.split("/") or re.search(r"[;&|`$<>\n\r*?(){}\[\]!\\\"']", path) or path.startswith("/") and not path.startswith(("/home/", "/Users/", "/tmp/")):
        raise ValueError(f"not a safe path: {path!r}")
    return path


def validate_query(spark, text: str) -> tuple[bool, str, int]:
    """(valid, error, bytes): whether Spark can analyse a query, and the size it estimates for its result."""
    try:
        plan = spark.sql(text)._jdf.queryExecution()
        return True, "", int(str(plan.optimizedPlan().stats().sizeInBytes()))
    except Exception as e:  # noqa: BLE001 - any refusal is the answer
        return False, str(e).split("\n")[0][:200], 0
