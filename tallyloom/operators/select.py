"""Selection, search and projection of models.

``models``: unique_id, short_name, name, alias, schema, database, package_name, tags,
config (JSON text), original_file_path, description, compiled_code, raw_code, pos.
Null fields never match a selector; projections give the stated default for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strict_variant


def short_name(c: str = "unique_id") -> Column:
    return F.substring_index(F.col(c), ".", -1)


def config_value(path: str, config: str = "config") -> Column:
    """Text of a dotted config entry, booleans as ``True`` and ``False``; null where missing."""
    steps = "".join(f"[\"{p}\"]" for p in path.split("."))
    v = F.try_variant_get(strict_variant(config), f"${steps}", "string")
    return F.when(v.isin("true", "false"), F.initcap(v)).otherwise(v)


def config_list(key: str, field: str | None = None, config: str = "config") -> Column:
    """Entries of a polymorphic config value (text, list, or object with ``field``) as an array; empty where missing."""
    v = f"try_variant_get({_strict(config)}, '$[\"{key}\"]', 'variant')"
    kind = f"schema_of_variant({v})"
    none = "cast(array() AS array<string>)"
    named = f"coalesce(try_variant_get({v}, '$.field', 'string'), try_variant_get({v}, '$.column', 'string'))" if field else "NULL"
    return F.expr(
        f"CASE WHEN {kind} = 'STRING' THEN array(try_variant_get({v}, '$', 'string')) WHEN {kind} LIKE 'ARRAY%' THEN coalesce(try_variant_get({v}, '$', 'array<string>'), {none}) "
        f"WHEN {kind} LIKE 'OBJECT%' AND {named} IS NOT NULL THEN array({named}) ELSE {none} END"
    )


def _strict(config: str) -> str:
    return f"try_parse_json({config})"


def selector(text: str) -> Column | None:
    """Condition of one selector; None for one without a known method, which keeps everything."""
    if text.startswith("config.") and ":" in text:
        path, _, value = text[len("config."):].rpartition(":")
        return F.coalesce(config_value(path) == value, F.lit(False))
    method, colon, value = text.partition(":")
    if not colon:
        return None
    known = {"tag": F.array_contains("tags", value), "path": F.col("original_file_path").startswith(value), "package": F.col("package_name") == value}
    return F.coalesce(known[method], F.lit(False)) if method in known else None


def select_models(models: DataFrame, selectors: list[str], all_tags: bool = False) -> DataFrame:
    """Models that meet the selectors: any of the tags (all with ``all_tags``) and every other one."""
    tags = [selector(s) for s in selectors if s.startswith("tag:")]
    others = [c for s in selectors if not s.startswith("tag:") and (c := selector(s)) is not None]
    conditions = others + ([reduce((lambda a, b: a & b) if all_tags else (lambda a, b: a | b), tags)] if tags else [])
    return models.where(reduce(lambda a, b: a & b, conditions)) if conditions else models


def get_model(models: DataFrame, name: str) -> DataFrame:
    """The first model in manifest order whose last name part is ``name``."""
    return all_models(models).where(short_name() == name).orderBy("pos").limit(1)


def first_models(models: DataFrame) -> DataFrame:
    """(model, unique_id): get_model for every short name at once."""
    return all_models(models).groupBy(short_name().alias("model")).agg(F.min_by("unique_id", F.struct("pos", "unique_id")).alias("unique_id"))


def all_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("unique_id").startswith("model."))


def search(models: DataFrame, pattern: str) -> DataFrame:
    """Name and description of models whose whole id contains the pattern, in any case."""
    return all_models(models).where(F.lower("unique_id").contains(pattern.lower())).select("unique_id", F.coalesce("description", F.lit("")).alias("description"))


def name_pattern(models: DataFrame, pattern: str) -> DataFrame:
    return all_models(models).where(F.lower(short_name()).contains(pattern.lower())).select(short_name().alias("model")).distinct()


def modified(models: DataFrame, changes: DataFrame) -> DataFrame:
    """(unique_id, origin): models whose file is among the changed ones.

    A changed path matches if it ends with the model's path; so both are cut to their
    last two parts for an equi-join, and the rest is compared after it. Untracked wins
    over uncommitted, that over committed. Models without a path match nothing.
    """
    key = lambda c: F.substring_index(F.col(c), "/", -1)
    rank = F.when(F.col("origin") == "untracked", 3).when(F.col("origin") == "uncommitted", 2).otherwise(1)
    files = changes.where("path IS NOT NULL").select("path", "origin", key("path").alias("_k"), rank.alias("_rank"))
    rows = models.where("original_file_path <> ''").select("unique_id", "original_file_path", key("original_file_path").alias("_k"))
    return rows.join(files, "_k").where("endswith(path, original_file_path)").groupBy("unique_id").agg(F.max_by("origin", "_rank").alias("origin"))


def compact_list(models: DataFrame) -> DataFrame:
    """One row (models, tables): sorted names, joined by spaces; the text form is the first of them alone."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), " ")
    return list_projection(models).agg(joined("model").alias("models"), joined("table_name").alias("tables"))


def file_matches(names: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, path): changed SQL files named like a model, or like its table part (what follows the last ``__``)."""
    wanted = names.select("name").distinct().withColumn("_file", F.explode(F.array_distinct(F.array(F.col("name"), F.substring_index("name", "__", -1)))))
    files = changes.where(F.col("path").endswith(".sql")).select("path", F.regexp_extract("path", r"([^/]*)\.sql$", 1).alias("_file")).distinct()
    return wanted.join(files, "_file").select("name", "path").distinct()


def united_changes(changes: DataFrame) -> DataFrame:
    """(path, origin): every changed file once; untracked wins over uncommitted, that over committed."""
    rank = F.when(F.col("origin") == "untracked", 3).when(F.col("origin") == "uncommitted", 2).otherwise(1)
    return changes.where("path IS NOT NULL").groupBy("path").agg(F.max_by("origin", rank).alias("origin"))


def list_with_status(models: DataFrame, changes: DataFrame) -> DataFrame:
    """list_projection with the config's ``meta`` as JSON text and the origin of a change of the model's file."""
    meta = F.to_json(F.try_variant_get(strict_variant("config"), "$.meta", "variant"))
    return models.join(modified(models, changes), "unique_id", "left").select(
        short_name().alias("model"), F.col("original_file_path").alias("path"), F.when(meta != "null", meta).alias("meta"), F.col("origin").alias("git_status")
    )


def live_config(facts: DataFrame) -> DataFrame:
    """(name, config): the part of a config that the warehouse knows, as JSON text; all other settings have their defaults.

    ``facts`` (name, table_type, partition_field, cluster_fields).
    """
    kind = F.when(F.coalesce("table_type", F.lit("TABLE")) == "TABLE", "table").otherwise("view").alias("materialized")
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    nulls = lambda *names: [text.alias(n) for n in names]
    whole = F.struct(
        kind, F.col("partition_field").alias("partition_by"), F.col("cluster_fields").alias("cluster_by"), *nulls("unique_key", "incremental_strategy", "on_schema_change"), empty.alias("grants"), none.alias("tags"), empty.alias("meta"),
        F.lit(True).alias("enabled"), *nulls("alias", "schema", "database"), none.alias("pre_hook"), none.alias("post_hook"), empty.alias("quoting"), empty.alias("column_types"), empty.alias("persist_docs"), *nulls("full_refresh"),
    )
    return facts.select("name", F.to_json(whole, {"ignoreNullFields": "false"}).alias("config"))


def list_projection(models: DataFrame) -> DataFrame:
    return models.select(
        short_name().alias("model"), F.concat_ws(".", "schema", F.coalesce(F.nullif("alias", F.lit("")), "name")).alias("table_name"),
        F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"), F.coalesce(config_value("materialized"), F.lit("view")).alias("materialized"), F.col("original_file_path").alias("path"),
    )


def tag_groups(models: DataFrame, wanted: list[str]) -> DataFrame:
    """(tag_group, model): each model once, under its wanted tags in sorted order."""
    hit = F.array_sort(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in wanted])))
    return models.withColumn("_hit", hit).where(F.size("_hit") > 0).select(F.array_join("_hit", "+").alias("tag_group"), short_name().alias("model"))


def schema_projection(models: DataFrame, source: str = "config_or_model", strategy: str = "alias_or_name") -> DataFrame:
    """Database, schema and table of models in production.

    ``source``: model, config, or config_or_model; ``strategy``: name (then alias) or alias_or_name.
    """
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    pick = lambda c: {"model": [F.col(c)], "config": [config_value(c)], "config_or_model": [config_value(c), F.col(c)]}[source]
    table = [F.col("name"), F.col("alias")] if strategy == "name" else [config_value("alias"), F.col("name")]
    return models.select(short_name().alias("model"), filled(*pick("database")).alias("database"), filled(*pick("schema")).alias("schema"), filled(*table).alias("table_name"))


def find_path(models: DataFrame, name: str) -> DataFrame:
    """File of a model by its name, or of the first one stored as ``schema.table``."""
    by_name = all_models(models).where(short_name() == name).select("original_file_path", "pos", F.lit(0).alias("_rank"))
    if "." in name:
        schema, table = name.rsplit(".", 1)
        stored = all_models(models).where((F.col("schema") == schema) & ((F.col("alias") == table) | (F.col("name") == table))).select("original_file_path", "pos", F.lit(1).alias("_rank"))
        by_name = by_name.unionByName(stored)
    return by_name.orderBy("_rank", "pos").limit(1).select("original_file_path")


def find_paths(models: DataFrame) -> DataFrame:
    """(name, original_file_path): find_path for every model name and every ``schema.table`` at once."""
    rows = all_models(models)
    stored = F.explode(F.transform(F.array_distinct(F.array_compact(F.array("alias", "name"))), lambda t: F.concat_ws(".", "schema", t)))
    asked = rows.select(short_name().alias("name"), F.lit(0).alias("_rank"), "pos", "original_file_path", "unique_id").unionByName(
        rows.where("schema IS NOT NULL").select(stored.alias("name"), F.lit(1).alias("_rank"), "pos", "original_file_path", "unique_id")
    )
    # nulls of pos come first, as in find_path
    first = F.struct("_rank", "pos", "unique_id")
    return asked.where("name IS NOT NULL").groupBy("name").agg(F.min_by("original_file_path", first).alias("original_file_path"))


def sql_projection(models: DataFrame, raw: bool = False) -> DataFrame:
    return models.select("unique_id", F.coalesce(F.col("raw_code" if raw else "compiled_code"), F.lit("")).alias("sql"))


def documented_columns(models: DataFrame) -> DataFrame:
    """(unique_id, column, data_type, description) as declared, with defaults."""
    return models.select("unique_id", F.explode("columns").alias("column", "c")).select("unique_id", "column", F.coalesce("c.data_type", F.lit("unknown")).alias("data_type"), F.coalesce("c.description", F.lit("")).alias("description"))


# fixed values: display names of warehouse types
TYPE_NAMES = {
    "INT64": "integer", "INTEGER": "integer", "FLOAT64": "float", "FLOAT": "float", "NUMERIC": "numeric", "BIGNUMERIC": "bignumeric", "BOOL": "boolean", "BOOLEAN": "boolean",
    "STRING": "string", "BYTES": "bytes", "DATE": "date", "DATETIME": "datetime", "TIME": "time", "TIMESTAMP": "timestamp", "STRUCT": "struct", "ARRAY": "array", "GEOGRAPHY": "geography", "JSON": "json",
}


def display_type(c: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.upper(F.col(c))), F.lower(F.nullif(c, F.lit(""))), F.lit("unknown"))


def catalog_columns(columns: DataFrame) -> DataFrame:
    """Columns of each table by index (999 if missing), then as listed, with display types."""
    return columns.select("unique_id", "column", display_type("type").alias("type"), F.coalesce("index", F.lit(999)).alias("index"), "pos").orderBy("unique_id", "index", "pos")


def columns_with_docs(spine: DataFrame, docs: DataFrame) -> DataFrame:
    """Real columns with their documentation, if any; documented columns that are not there are dropped."""
    return spine.join(docs.select("unique_id", "column", "description"), ["unique_id", "column"], "left").withColumn("description", F.coalesce("description", F.lit("")))


def is_stale(generated_at: Column, now: Column, hours: float) -> Column:
    """Whether a time is missing, unreadable, or more than ``hours`` before ``now``."""
    at = F.try_to_timestamp(generated_at)
    return at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600)


def column_reference(text: str) -> tuple[str, str]:
    """(model, column) of ``model.column`` or ``model:column``."""
    for sep in (":", "."):
        model, found, column = text.rpartition(sep)
        if found and model and column:
            return model, column
    raise ValueError(f"{text!r} names no column; write model.column")
