"""Readers and writers of project artifacts: manifests, catalogs, scans, indexes, lineage, compiled SQL.

JSON documents are read as variants, so that missing and polymorphic parts don't matter.
A missing file or one that is not JSON raises ``ArtifactError``.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import keep_last_duplicate_keys, strict_variant
from tallyloom.operators.bi import scrub_people


class ArtifactError(ValueError):
    """An artifact is missing, unreadable, or of another version."""

    def __init__(self, message: str, suggestion: str = "") -> None:
        super().__init__(message)
        self.suggestion = suggestion


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row, column ``v``: the JSON document in a file."""
    keep_last_duplicate_keys(spark)
    try:
        text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "t")
        out = text.select(strict_variant("t").alias("v"))
        if out.where("v IS NULL").limit(1).count():
            raise ArtifactError(f"{path} is not JSON", "write the artifact again")
    except ArtifactError:
        raise
    except Exception as e:
        raise ArtifactError(f"{path} can't be read", "check the path") from e
    return out


def _entries(doc: DataFrame, key: str) -> DataFrame:
    """(pos, key, value) of the object at ``key``."""
    part = doc.select(F.expr(f"try_variant_get(v, '$[\"{key}\"]', 'variant')").alias("_p"))
    return part.alias("d").lateralJoin(part.sparkSession.tvf.variant_explode(F.col("d._p").outer()).alias("e")).select("e.pos", "e.key", "e.value")


def _text(name: str) -> str:
    return f"try_variant_get(value, '$.{name}', 'string')"


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """models, sources, edges (child_map, parent_map), in manifest order where order counts."""
    doc = read_document(spark, path)
    fields = "name alias schema database package_name resource_type compiled_code raw_code description original_file_path".split()
    models = _entries(doc, "nodes").select(
        F.col("key").alias("unique_id"), "pos", *[F.expr(_text(f)).alias(f) for f in fields], F.expr("try_variant_get(value, '$.tags', 'array<string>')").alias("tags"),
        F.expr("try_variant_get(value, '$.depends_on.nodes', 'array<string>')").alias("depends_on"), F.expr("to_json(try_variant_get(value, '$.config', 'variant'))").alias("config"),
        F.expr("try_variant_get(value, '$.columns', 'map<string,struct<data_type:string,description:string>>')").alias("columns"),
    )
    sources = _entries(doc, "sources").select(F.col("key").alias("unique_id"), *[F.expr(_text(f)).alias(f) for f in ("schema", "identifier", "name", "database", "resource_type")])
    edges = None
    for kind in ("child_map", "parent_map"):
        lists = _entries(doc, kind).select("key", F.expr("try_variant_get(value, '$', 'array<string>')").alias("names"))
        part = lists.select(F.col("key").alias("src"), F.posexplode("names").alias("pos", "dst"), F.lit(kind).alias("kind"))
        edges = part if edges is None else edges.unionByName(part)
    return {"models": models, "sources": sources, "edges": edges}


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """columns, stats and generated_at of a catalog."""
    doc = read_document(spark, path)
    nodes = _entries(doc, "nodes").unionByName(_entries(doc, "sources"))
    listed = nodes.select(F.col("key").alias("unique_id"), F.expr("try_variant_get(value, '$.columns', 'variant')").alias("_c"))
    cols = listed.alias("n").lateralJoin(spark.tvf.variant_explode(F.col("n._c").outer()).alias("e")).select(
        "n.unique_id", F.col("e.key").alias("column"), "e.pos", F.expr("try_variant_get(e.value, '$.type', 'string')").alias("type"), F.expr("try_variant_get(e.value, '$.index', 'int')").alias("index")
    )
    stats = nodes.select(F.col("key").alias("unique_id"), F.expr("try_variant_get(value, '$.stats.num_rows.value', 'bigint')").alias("row_count"), F.expr("try_variant_get(value, '$.stats.num_bytes.value', 'bigint')").alias("bytes"))
    return {"columns": cols, "stats": stats, "generated_at": doc.select(F.expr("try_variant_get(v, '$.metadata.generated_at', 'string')").alias("generated_at"))}


def read_table(spark: SparkSession, path: str, kind: str = "parquet", max_rows: int | None = None) -> DataFrame:
    """A monitoring table from files (parquet, json, csv with a header); ``max_rows`` only where a caller asks for it."""
    rows = spark.read.option("header", "true").format(kind).load(path)
    return rows if max_rows is None else rows.limit(max_rows)


SCAN_SCHEMA = """workspaces array<struct<id string, name string,
  datasets array<struct<id string, name string, tables array<struct<name string, source array<struct<expression string>>,
    measures array<struct<name string, expression string, isHidden boolean>>>>>>,
  reports array<struct<id string, name string, datasetId string, modifiedDateTime string, users array<struct<displayName string, reportUserAccessRight string>>>>>>"""


def read_scan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """reports, tables and measures of a workspace scan; what identifies people is not in the schema."""
    rows = spark.read.schema(SCAN_SCHEMA).json(path, multiLine=True).select(F.explode("workspaces").alias("w"))
    reports = rows.select(F.col("w.id").alias("workspace_id"), F.col("w.name").alias("workspace"), F.posexplode("w.reports").alias("pos", "r")).select(
        "workspace_id", "workspace", "pos", F.col("r.id").alias("report_id"), F.col("r.name").alias("report_name"), F.col("r.datasetId").alias("dataset_id"), F.col("r.users").alias("users")
    )
    tables = rows.select(F.col("w.id").alias("workspace_id"), F.explode("w.datasets").alias("d")).select("workspace_id", F.col("d.id").alias("dataset_id"), F.explode("d.tables").alias("t"))
    return {
        "reports": reports,
        "tables": tables.select("workspace_id", "dataset_id", F.col("t.name").alias("query"), F.col("t.source").alias("source")),
        "measures": tables.select("workspace_id", "dataset_id", F.col("t.name").alias("query"), F.explode("t.measures").alias("m")).select("workspace_id", "dataset_id", "query", F.col("m.name").alias("metric"), F.col("m.expression").alias("expression")),
    }


def scrubbed(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the JSON in ``text`` freed of what identifies people; texts that are not JSON become null."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for t in b[text]:
                try:
                    out.append(json.dumps(scrub_people(json.loads(t))) if isinstance(t, str) else None)
                except (ValueError, RecursionError):
                    out.append(None)
            yield b.assign(**{text: out})

    return rows.mapInPandas(run, rows.schema)


def fetch_rows(keys: DataFrame, fetch: Callable[[dict], list[dict]], schema: str, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows that ``fetch`` returns for each row of ``keys``, with a last column ``error``.

    For remote calls (live columns, table facts, layouts). A call that raises is made again,
    ``attempts`` times in all, after ``wait`` seconds, then twice as many; ArtifactError is
    final. A key whose calls all fail has one row with the key's columns of the schema, nulls
    and the error's text, so no key is lost silently.
    """

    def run(batches: Iterator) -> Iterator:
        import time

        import pandas as pd

        names = [part.split()[0] for part in schema.split(",")]
        for b in batches:
            rows: list[dict] = []
            for key in b.to_dict("records"):
                for attempt in range(1, attempts + 1):
                    try:
                        rows += [{**r, "error": None} for r in fetch(key)]
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a call is data
                        if attempt == attempts or isinstance(e, ArtifactError):
                            rows.append({**{k: v for k, v in key.items() if k in names}, "error": f"{type(e).__name__}: {e}"[:200]})
                            break
                        time.sleep(wait * 2 ** (attempt - 1))
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return keys.mapInPandas(run, f"{schema}, error string")


def polled(start: Callable[[], str], status: Callable[[str], str], result: Callable[[str], object], polls: int = 120, wait: float = 2.0) -> object:
    """Result of a remote job: started, asked for until it has succeeded. A failed or endless job raises ArtifactError."""
    import time

    job = start()
    for _ in range(polls):
        state = status(job)
        if state == "Succeeded":
            return scrub_people(result(job))
        if state == "Failed":
            break
        time.sleep(wait)
    raise ArtifactError(f"job {job} did not succeed", "try again later")


def decoded_layouts(definitions: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds ``layout``: the JSON text in the base64 payload of the first part whose path ends in report.json; null if there is none.

    ``parts`` is an array of (path, payload).
    """
    part = F.try_element_at(F.filter(F.col(parts), lambda p: F.coalesce(p["path"], F.lit("")).endswith("report.json")), F.lit(1))
    read = definitions.withColumn("_payload", part["payload"]).withColumn("_text", F.try_validate_utf8(F.expr("CAST(try_to_binary(_payload, 'base64') AS STRING)")))
    return read.withColumn("layout", F.when(strict_variant("_text").isNotNull(), F.col("_text"))).drop("_payload", "_text")


def write_scan(scan: dict, path: str) -> dict[str, int | str]:
    """Writes a scan result without what identifies people; returns the numbers of workspaces, datasets, reports and tables."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(scrub_people(scan), f, indent=2, ensure_ascii=False)
    spaces = scan.get("workspaces") or []
    datasets = [d for w in spaces for d in w.get("datasets") or []]
    return {
        "workspaces": len(spaces), "datasets": len(datasets), "reports": sum(len(w.get("reports") or []) for w in spaces),
        "tables": sum(len(d.get("tables") or []) for d in datasets), "output": path,
    }


WARNING_SCHEMA = "type string, severity string, message string, detail string, suggestion string"


def warnings_frame(spark: SparkSession, warnings: list[dict]) -> DataFrame:
    """Warnings as rows; what a warning does not say is null."""
    names = [part.split()[0] for part in WARNING_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(w.get(n) for n in names) for w in warnings], WARNING_SCHEMA)


def read_compiled_sql(spark: SparkSession, root: str) -> DataFrame:
    """(original_file_path, disk_sql) of the files below ``root``; blank files have null text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return files.select(F.regexp_extract("p", r"/(models/.*)$", 1).alias("original_file_path"), F.when(F.trim("value") != "", F.col("value")).alias("disk_sql"))


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path, origin) of files changed against the first of origin/main, origin/master, main, master, or not committed."""
    def git(*args: str) -> list[str]:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False).stdout.splitlines()

    base = next((b for b in ("origin/main", "origin/master", "main", "master") if git("rev-parse", "--verify", "-q", b)), None)
    rows = [(p, "committed") for p in (git("diff", "--name-only", f"{base}...HEAD") if base else [])]
    rows += [(p, "uncommitted") for p in git("diff", "--name-only") + git("diff", "--name-only", "--cached")]
    rows += [(p, "untracked") for p in git("ls-files", "--others", "--exclude-standard")]
    return spark.createDataFrame(rows, "path string, origin string")


LINEAGE_VERSION = "1.0"


def write_lineage(nodes: DataFrame, edges: DataFrame, path: str, generated_at: str, digest: str | None = None) -> None:
    """Nodes, edges and one row about them, as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    spark.createDataFrame([(LINEAGE_VERSION, generated_at, digest)], "schema_version string, generated_at string, manifest_digest string").write.mode("overwrite").json(f"{path}/meta")


def read_lineage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, facts); another version is refused."""
    meta = spark.read.schema("schema_version string, generated_at string, manifest_digest string").json(f"{path}/meta").first()
    if meta is None or meta.schema_version != LINEAGE_VERSION:
        raise ArtifactError(f"lineage of version {meta and meta.schema_version}; {LINEAGE_VERSION} is read", "build it again")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta.asDict()


def write_index(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines; empty arrays and nulls are left out."""
    arrays = [f.name for f in reports.schema if f.dataType.typeName() == "array"]
    sparse = reports.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in arrays}) if arrays else reports
    sparse.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Reports as written; what was left out is an empty array or null again."""
    rows = spark.read.schema(like.schema).json(path)
    arrays = [f for f in like.schema if f.dataType.typeName() == "array"]
    return rows.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in arrays}) if arrays else rows
