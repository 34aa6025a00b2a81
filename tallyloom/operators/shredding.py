"""Nested records to related flat tables by shared inlining.

The schema graph has element types as nodes and containment as edges. An element
gets its own table if it is a root, repeated (array or map), shared (reached from
several parents) or recursive; every other element is inlined into the table of the
element that holds it. Rows keep an id, their parent's id and type, and the keys
(positions, map keys) of all table elements above them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import keep_last_duplicate_keys, strict_variant
from tallyloom.session import counted_cut, cut


@dataclass(frozen=True)
class Edge:
    """``parent`` holds ``child`` at ``step``; kinds: one, array, map.

    ``json``: the step holds JSON as text, which is parsed (an invalid text holds nothing).
    """

    parent: str
    child: str
    step: str
    kind: str = "one"
    json: bool = False


@dataclass
class SchemaGraph:
    """Element types, edges between them, and the scalar attributes of each."""

    root: str
    edges: list[Edge]
    attributes: dict[str, dict[str, str]] = field(default_factory=dict)

    def reachable(self, start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for e in self.edges:
                if e.parent == (at := todo[-1]) and e.child not in seen:
                    seen.add(e.child)
                    todo.append(e.child)
                    break
            else:
                todo.remove(at)
        return seen

    def placement(self) -> dict[str, str]:
        """Why an element has its own table (root, repeated, shared, recursive), or ``inlined``."""
        why = {self.root: "root"}
        for e in self.edges:
            into = [x for x in self.edges if x.child == e.child]
            if e.child in self.reachable(e.child):
                why[e.child] = "recursive"
            elif len({x.parent for x in into}) > 1 or len(into) > 1:
                why.setdefault(e.child, "shared")
            elif e.kind != "one":
                why.setdefault(e.child, "repeated")
            else:
                why.setdefault(e.child, "inlined")
        return why

    def ring(self, element: str) -> list[str]:
        """Table elements that ``element`` holds and is held by, itself included; empty if it is not recursive."""
        why = self.placement()
        below = self.reachable(element)
        return sorted(x for x in below if element in self.reachable(x) and why[x] != "inlined") if element in below else []

    def routes(self, table: str) -> list[tuple[str, list[Edge]]]:
        """Edge chains into ``table`` from the tables that hold it, through inlined elements."""
        why, found = self.placement(), []

        def up(element: str, chain: list[Edge]) -> None:
            for e in self.edges:
                if e.child == element:
                    if why[e.parent] == "inlined":
                        up(e.parent, [e, *chain])
                    else:
                        found.append((e.parent, [e, *chain]))

        up(table, [])
        return found

    def columns(self, table: str) -> dict[str, tuple[list[Edge], str]]:
        """Columns of a table: its own attributes and those of elements inlined into it."""
        why, out = self.placement(), {}

        def down(element: str, chain: list[Edge]) -> None:
            for name, step in self.attributes.get(element, {}).items():
                out[name] = (chain, step)
            for e in self.edges:
                if e.parent == element and why[e.child] == "inlined":
                    down(e.child, [*chain, e])

        down(table, [])
        return out


def _get(value: str, step: str) -> str:
    """A member of a variant; a ``step`` that starts with ``$`` is a whole path."""
    path = step if step.startswith("$") else f'$["{step}"]'
    return f"try_variant_get({value}, '{path}', 'variant')"


def _follow(df: DataFrame, chain: list[Edge], out: str) -> DataFrame:
    """Adds ``out``: the value at the end of ``chain``, all of whose edges but the last are single."""
    df = df.withColumn(out, F.col("_v"))
    for e in chain:
        if e.step:
            df = df.withColumn(out, F.expr(_get(out, e.step)))
        if e.json:
            df = df.withColumn(out, text_of(out)).withColumn(out, strict_variant(out))
    return df


def text_of(value: str) -> Column:
    """The string held by a variant; null for any other kind."""
    return F.expr(f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({value}, '$', 'string') END")


def _spread(df: DataFrame, kind: str, key: str) -> DataFrame:
    """One row per array element (position from 0) or map entry of ``_w``; other kinds hold none."""
    tvf = df.sparkSession.tvf
    kept = [c for c in df.columns if c not in ("_v", "_w")]
    rows = df.alias("p").lateralJoin(tvf.variant_explode(F.col("p._w").outer()).alias("e"))
    of_kind = F.col("e.key").isNull() if kind == "array" else F.col("e.key").isNotNull()
    at = F.col("e.pos") if kind == "array" else F.col("e.key")
    return rows.where(of_kind).select(*[F.col(f"p.`{c}`") for c in kept], at.alias(key), F.col("e.value").alias("_v"))


class Shredder:
    """Tables of ``graph`` over root records.

    ``roots`` has the root's key column and ``_v``, a variant with the record's fields
    (JSON parts still as text). Null records, null elements and values of another kind
    than the graph says hold nothing; array positions count every element.
    """

    def __init__(self, graph: SchemaGraph, roots: DataFrame, key: str) -> None:
        keep_last_duplicate_keys(roots.sparkSession)
        self.graph, self.key = graph, key
        self._rows = {graph.root: roots.select(F.col(key), F.col(key).cast("string").alias("_id"), F.lit(None).cast("string").alias("_parent_id"), F.lit(None).cast("string").alias("_parent"), "_v")}

    def _key_name(self, e: Edge) -> str:
        return f"{e.child}_key" if e.kind == "map" else f"{e.child}_no"

    def _step(self, rows: DataFrame, parent: str, chain: list[Edge]) -> DataFrame:
        last = chain[-1]
        rows = _follow(rows, chain, "_w")
        if last.kind == "one":
            rows = rows.where(F.col("_w").isNotNull()).drop("_v").withColumnRenamed("_w", "_v").withColumn("_at", F.lit(last.step))
            name = None
        else:
            name = self._key_name(last)
            rows = _spread(rows.drop(name), last.kind, name)
            rows = rows.withColumn("_at", F.concat(F.lit(last.step + ":"), F.col(name).cast("string")))
        return (
            rows.withColumn("_parent_id", F.col("_id")).withColumn("_parent", F.lit(parent))
            .withColumn("_id", F.concat_ws("/", "_parent_id", "_at")).drop("_at")
        )

    def rows(self, table: str) -> DataFrame:
        """Rows of an element's table with their variant ``_v``; recursive elements level by level.

        Elements that hold each other are made together: a level's rows of one are the next
        level's parents of the others.
        """
        if table in self._rows:
            return self._rows[table]
        ring = self.graph.ring(table)
        if not ring:
            self._rows[table] = self._union([self._step(self.rows(p), p, c) for p, c in self.graph.routes(table)])
            return self._rows[table]
        routes = {t: self.graph.routes(t) for t in ring}
        level: dict[str, DataFrame] = {}
        for t in ring:
            outer = [self._step(self.rows(p), p, c) for p, c in routes[t] if p not in ring]
            if outer:
                level[t] = cut(self._union(outer).withColumn("_level", F.lit(0)))
        out, n = {t: [df] for t, df in level.items()}, 0
        while level:
            n += 1
            after: dict[str, DataFrame] = {}
            for t in ring:
                steps = [self._step(level[p], p, c) for p, c in routes[t] if p in level]
                if steps:
                    made, count = counted_cut(self._union(steps).withColumn("_level", F.lit(n)))
                    if count:
                        after[t] = made
                        out.setdefault(t, []).append(made)
            level = after
        for t in ring:
            if t not in out:
                raise ValueError(f"no way leads from {self.graph.root} to {t}")
            self._rows[t] = self._union(out[t])
        return self._rows[table]

    def shape(self, element: str) -> list[tuple[str, str]]:
        """(path, kind) of all parts of an element's values, inlined or not; see observed_shape."""
        if self.graph.placement()[element] != "inlined":
            return observed_shape(self.rows(element), "_v")
        found = None
        for holder, chain in self.graph.routes(element):
            part = _follow(self.rows(holder), chain, "_w").select("_w")
            found = part if found is None else found.unionByName(part)
        return observed_shape(found.where("_w IS NOT NULL"), "_w")

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def table(self, table: str) -> DataFrame:
        """Flat table: keys, id, parent's id and type, and every attribute as text.

        An attribute named like a key gets the element's name before its own.
        """
        rows = self.rows(table)
        keys = [c for c in rows.columns if c != "_v"]
        columns = self.graph.columns(table)
        chains: dict[tuple, str] = {}
        for i, (chain, _) in enumerate(columns.values()):
            if tuple(chain) not in chains:
                chains[tuple(chain)] = f"_c{i}"
                rows = _follow(rows, chain, f"_c{i}")
        values = []
        for name, (chain, step) in columns.items():
            name = f"{table}_{name}" if name in keys else name
            value = _get(chains[tuple(chain)], step) if step else chains[tuple(chain)]
            values.append(F.expr(f"CASE WHEN schema_of_variant({value}) <> 'VOID' THEN try_variant_get({value}, '$', 'string') END").alias(name))
            values.append(F.expr(f"regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0)").alias(f"{name}_kind"))
        return rows.select(*keys, *values)


def latest_rows(rows: DataFrame, key: str, version: str, content: list[str]) -> DataFrame:
    """Rows of the latest version of each key, without shuffling their content.

    Only (key, version, content hash) is reduced; the rows are then filtered by a join
    on those. Of different rows with one version the greatest hash counts; exact copies
    of a row all stay, for the caller to make distinct once they are narrow.
    """
    hashed = rows.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(*content))
    best = hashed.groupBy(key).agg(F.max(F.struct(F.coalesce(F.col(version), F.timestamp_micros(F.lit(-(2**62)))).alias("v"), F.col("_h").alias("h"))).alias("_b"))
    best = best.select(F.col(key).alias("_k"), F.col("_b.v").alias("_bv"), F.col("_b.h").alias("_bh"))
    return hashed.join(best, (F.col(key) == F.col("_k")) & (F.coalesce(F.col(version), F.timestamp_micros(F.lit(-(2**62)))) == F.col("_bv")) & (F.col("_h") == F.col("_bh")), "left_semi").drop("_h")


# -- the schema graph of given records -------------------------------------------

def shape_paths(ddl: str) -> list[tuple[str, str]]:
    """(path, kind) of every part of a variant type as text; array elements are ``[]``, kinds are upper case."""
    out: list[tuple[str, str]] = []
    at = 0

    def name() -> str:
        nonlocal at
        if ddl[at] == "`":
            end = at + 1
            while ddl[end] != "`" or ddl[end : end + 2] == "``":
                end += 2 if ddl[end : end + 2] == "``" else 1
            got, at = ddl[at + 1 : end].replace("``", "`"), end + 1
            return got
        end = ddl.index(":", at)
        got, at = ddl[at:end], end
        return got

    todo: list[tuple[str, str]] = [("$", "type")]
    while todo:
        path, state = todo.pop()
        if state == "close":
            at += 1
        elif state == "member":
            if ddl[at] == ">":
                at += 1
                continue
            at += 2 if ddl.startswith(", ", at) else 0
            step = name()
            at += 2  # the colon and a space
            todo += [(path, "member"), (f"{path}.{step}", "type")]
        elif ddl.startswith(("OBJECT<", "ARRAY<"), at):
            kind = ddl[at : ddl.index("<", at)]
            at += len(kind) + 1
            out.append((path, kind))
            todo += [(path, "member")] if kind == "OBJECT" else [(path, "close"), (f"{path}[]", "type")]
        else:
            end = at
            while end < len(ddl) and ddl[end] not in ",>":
                end = ddl.index(")", end) if ddl[end] == "(" else end + 1
            out.append((path, ddl[at:end].strip()))
            at = end
    return out


def observed_shape(rows: DataFrame, value: str) -> list[tuple[str, str]]:
    """(path, kind) of all parts of the variants in a column; parts of several kinds are VARIANT. One aggregate over all rows."""
    ddl = rows.agg(F.expr(f"schema_of_variant_agg({value})").alias("s")).first()[0]
    return shape_paths(ddl) if ddl else []


def undeclared(graph: SchemaGraph, observed: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str, bool]]:
    """(element, path, kind, declared) of what ``observed`` found below each element.

    ``observed`` maps an element to the shape of its values. A part is declared if an
    attribute or edge leads to it, or lies above or below it.
    """
    out = []
    for element, parts in observed.items():
        steps = [s[2:] if s.startswith("$") else s for s in graph.attributes.get(element, {}).values()]
        steps = [s.replace("[0]", "[]") for s in steps] + [e.step for e in graph.edges if e.parent == element and e.step]
        for path, kind in parts:
            inner = path[2:]
            if inner:
                near = any(inner == s or inner.startswith((s + ".", s + "[")) or s.startswith((inner + ".", inner + "[")) for s in steps)
                out.append((element, path, kind, near))
    return out
