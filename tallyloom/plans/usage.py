"""How queries use columns of other tables, and where their output columns come from.

Everything here works on one text at a time and runs inside tasks; the DataFrame
functions at the end apply it to a column of texts, all models in one pass.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.sqltext import Node, SqlError, parse, tokens

RANGES = ("between", "gt", "ge", "lt", "le")
#: Clauses of a SELECT that events are taken from, by the parser's name for them.
_CLAUSES = {"where": "where", "group_by": "group_by", "order_by": "order_by", "qualify": "qualify"}


def tables_of(n: Node) -> Iterator[Node]:
    """FROM items of a select, joined groups opened."""
    for t in n.extra["from"]:
        if t.kind == "joined":
            yield from (k for k in t.walk() if k.kind in ("table", "derived", "unnest", "function_table") and k.extra.get("role"))
        elif t.kind not in ("on", "using"):
            yield t


def names_of(table: Node) -> list[str]:
    """A table's name with one, two and three parts, lower-case, shortest first."""
    parts = [p.lower() for p in table.parts[-3:]]
    return [".".join(parts[-i:]) for i in range(1, len(parts) + 1)]


def cte_names(query: Node) -> set[str]:
    return {n.name.lower() for n in query.walk() if n.kind == "cte"}


def selects(query: Node) -> Iterator[Node]:
    return (n for n in query.walk() if n.kind == "select")


def _is_physical(t: Node, ctes: set[str]) -> bool:
    return t.kind == "table" and not (len(t.parts) == 1 and t.parts[0].lower() in ctes)


def _enclosing_select(n: Node) -> Node | None:
    while n.parent is not None:
        n = n.parent
        if n.kind == "select":
            return n
    return None


def _columns(expr: Node, scope: Node, aliases: set[str], alone: bool, in_window: bool = False) -> Iterator[Node]:
    """Columns under ``expr`` that belong to ``aliases``; windows are left to their own clauses.

    A qualified name counts wherever it stands, also in nested queries that reuse the
    alias; a bare name counts in its own select only, if the target is its one source.
    """
    todo = [expr]
    while todo:
        n = todo.pop(0)
        if n.kind == "column":
            if len(n.parts) > 1 and n.parts[0].lower() in aliases:
                yield n
            elif len(n.parts) > 1 and len(n.parts) > 2 and n.parts[-2].lower() in aliases:
                yield n
            elif len(n.parts) == 1 and alone and _enclosing_select(n) is scope:
                yield n
        todo = [k for k in n.kids if in_window or k.kind != "window"] + todo


def _column_name(n: Node, aliases: set[str]) -> str:
    """The column itself: fields of structs after it are not part of it."""
    if len(n.parts) == 1:
        return n.parts[0]
    return n.parts[1] if n.parts[0].lower() in aliases else n.parts[-1]


def classify(column: Node, top: Node) -> tuple[str, str, str]:
    """(operator, selectivity, wrapping function) of a column reference below ``top``."""
    wrap, at, below = "", column, column
    while at is not top and at.parent is not None:
        below, at = at, at.parent
        if at.kind == "compare":
            others = [k for k in at.kids if k is not below]
            kinds = {k.kind for k in others}
            selectivity = (
                "subquery" if "subquery" in kinds else "range" if at.name in RANGES
                else "literal" if others and all(_is_literal(k) for k in others) else "none"
            )
            return at.name, selectivity, wrap
        if at.kind == "function" and not wrap:
            wrap = at.name
        if at.kind in ("select", "query"):
            break
    return ("fn" if wrap else "none"), "none", wrap


def _is_literal(n: Node) -> bool:
    return n.kind == "literal" or n.kind in ("arithmetic", "tuple", "function") and n.kids != [] and all(_is_literal(k) for k in n.kids) or n.kind == "function" and not n.kids


def usage_events(text: str | None, targets: set[str] | None) -> list[tuple[str, str, str, str, str, str]]:
    """(target, column, clause, operator, selectivity, wrapping_fn) for each use of a target's column.

    ``targets`` are lower-case names with one to three parts; None stands for all tables
    that are no CTE, named as written, lower-case. WHERE, GROUP BY, ORDER BY,
    QUALIFY, JOIN ... ON, windows and the select list count; HAVING, LIMIT and USING don't.
    Null, blank and unreadable texts, and an empty target set, give no events.
    """
    if not text or not text.strip() or targets is not None and not targets:
        return []
    try:
        query = parse(text)
    except SqlError:
        return []
    return _events(query, targets)


def _events(query: Node, targets: set[str] | None) -> list[tuple[str, str, str, str, str, str]]:
    ctes, out = cte_names(query), []
    for s in selects(query):
        sources = list(tables_of(s))
        by_target: dict[str, set[str]] = {}
        for t in sources:
            if not _is_physical(t, ctes):
                continue
            if hit := {".".join(p.lower() for p in t.parts)} if targets is None else targets.intersection(names_of(t)):
                by_target.setdefault(max(hit, key=len), set()).update({(t.alias or t.name).lower(), t.name.lower()})
        for target, aliases in by_target.items():
            alone = len(sources) == 1

            def add(top: Node, clause: str, in_window: bool = False) -> None:
                for c in _columns(top, s, aliases, alone, in_window):  # noqa: B023
                    out.append((target, _column_name(c, aliases).lower(), clause, *classify(c, top)))  # noqa: B023

            for part, clause in _CLAUSES.items():
                for top in s.extra[part]:
                    add(top, clause)
            for f in s.extra["from"]:
                for on in (k for k in f.walk() if k.kind == "on"):
                    add(on, "join")
            if (q := s.parent) is not None and q.kind == "query" and q.extra["body"] is s:
                for top in q.extra["order"]:
                    add(top, "order_by")
            for w in s.walk():
                if w.kind == "window" and _enclosing_select(w) is s:
                    for k in w.extra.get("partition", []):
                        add(k, "partition_by", True)
                    for k in w.extra.get("order", []):
                        add(k, "order_by", True)
            for item in s.extra["items"]:
                add(item, "select")
    return out


def table_references(text: str | None) -> list[tuple[str, bool, bool]]:
    """(name as written, lower-case; in FROM of a select with a bare star; stands in FROM) of all tables.

    An unreadable text gives the dotted names a pattern finds in it.
    """
    if not text or not text.strip():
        return []
    try:
        query = parse(text)
    except SqlError:
        return [(n, "*" in text, True) for n in dotted_names(text)]
    ctes, out = cte_names(query), {}
    for s in selects(query):
        bare = any(i.kind == "star" and not i.name for i in s.extra["items"])
        for t in tables_of(s):
            if _is_physical(t, ctes):
                first = t.extra.get("role") == "from"
                name = ".".join(p.lower() for p in t.parts)
                was = out.get(name, (False, False))
                out[name] = (was[0] or bare and first, was[1] or first)
    return [(k, *v) for k, v in out.items()]


#: Names that are no column where a comparison follows them.
_NO_COLUMN = frozenset("and or not where in is null like between on case when then else".split())


def filter_columns(text: str | None) -> list[str]:
    """Columns compared in the first WHERE of a text, by its tokens alone: distinct, in order, as written.

    A column is a name right before ``= < > != <>``, IN (, LIKE, BETWEEN or IS [NOT] NULL;
    GROUP BY, ORDER BY, LIMIT and HAVING end the clause. Comments and quoted texts hold
    none; null texts and texts that are no SQL tokens give none.
    """
    try:
        toks = tokens(text or "")
    except SqlError:
        return []
    words = [v.lower() if k in ("name", "op") else f"<{k}>" for k, v in toks] + ["", "", "", ""]
    at = next((i for i, w in enumerate(words) if w == "where"), None)
    out: dict[str, None] = {}
    while at is not None and (at := at + 1) < len(toks):
        w, then = words[at], words[at + 1]
        if w in ("limit", "having") or w in ("group", "order") and then == "by":
            break
        if toks[at][0] != "name" or w in _NO_COLUMN:
            continue
        tested = then in ("=", "<", ">", "!=", "<>", "<=", ">=", "like", "between") or then == "in" and words[at + 2] == "("
        if tested or then == "is" and "null" in words[at + 2 : at + 4]:
            out[toks[at][1]] = None
    return list(out)


_DOTTED = re.compile(r"`([\w-]+(?:\.[\w-]+){1,2})`|\b([\w-]+\.\w+\.\w+)\b")


def dotted_names(text: str) -> list[str]:
    return list(dict.fromkeys((a or b).lower() for a, b in _DOTTED.findall(text)))


def analyze_query(text: str | None) -> dict[str, object]:
    """Tables with a dot in their name, and the columns of all WHERE, JOIN ON and GROUP BY clauses.

    Bare names, distinct, in order. An unreadable text gives the tables a pattern finds
    and status ``partial``.
    """
    out: dict[str, object] = {"tables": [], "where_columns": [], "join_columns": [], "group_columns": [], "status": "ok"}
    try:
        query = parse(text or "")
    except SqlError:
        return out | {"tables": dotted_names(text or ""), "status": "partial"}
    ctes = cte_names(query)
    found: dict[str, dict[str, None]] = {k: {} for k in ("tables", "where_columns", "join_columns", "group_columns")}
    for s in selects(query):
        for t in tables_of(s):
            if _is_physical(t, ctes) and len(t.parts) > 1:
                found["tables"][".".join(t.parts)] = None
        ons = [k for f in s.extra["from"] for k in f.walk() if k.kind == "on"]
        for key, tops in (("where_columns", s.extra["where"]), ("join_columns", ons), ("group_columns", s.extra["group_by"])):
            for top in tops:
                for c in top.walk():
                    if c.kind == "column":
                        found[key][c.parts[-1]] = None
    return out | {k: list(v) for k, v in found.items()}


# -- column lineage -----------------------------------------------------------

Sources = dict[tuple[str, str], None]


class _Scope:
    """What a FROM item offers: named columns, or any column of one physical table."""

    def __init__(self, alias: str, columns: dict[str, Sources] | None = None, table: str = "", more: list[str] | None = None) -> None:
        self.alias, self.columns, self.table, self.more = alias.lower(), columns, table, more or []

    def get(self, name: str) -> Sources | None:
        if self.columns is not None:
            hit = self.columns.get(name.lower())
            if hit is None and len(self.more) == 1:
                return {(self.more[0], name.lower()): None}
            return hit
        return {(self.table, name.lower()): None} if self.table else None


class OverBudget(Exception):
    """A text took longer than its budget."""


class Lineage:
    """Output columns of a query with the physical columns they are made of.

    Columns of ``SELECT *`` over a physical table are the pair (``*``, table): the caller
    expands them with the catalog. A ``budget`` in seconds ends texts that take longer.
    """

    def __init__(self, query: Node, budget: float = 0.0) -> None:
        self._until = time.monotonic() + budget if budget > 0 else None
        self.outputs = self._query(query, {})

    def _query(self, q: Node, env: dict[str, tuple]) -> list[tuple[str, Sources, str]]:
        env = dict(env)
        for c in q.extra["ctes"]:
            env[c.name.lower()] = self._renamed(self._query(c.kids[0], env), c.parts)
        return self._body(q.extra["body"], env)

    def _body(self, b: Node, env: dict) -> list[tuple[str, Sources, str]]:
        if b.kind == "query":
            return self._query(b, env)
        if b.kind == "set":
            left, right = (self._body(k, env) for k in b.kids)
            return [
                (n, s | right[i][1], t if i < len(right) and right[i][2] == t else "derived") if i < len(right) and b.name != "except" else (n, s, t)
                for i, (n, s, t) in enumerate(left)
            ]
        return self._select(b, env)

    @staticmethod
    def _renamed(columns: list, names: list[str]) -> list:
        return [(names[i] if i < len(names) else n, s, t) for i, (n, s, t) in enumerate(columns)]

    def _scope(self, t: Node, env: dict, before: list[_Scope]) -> _Scope:
        alias = t.alias or t.name
        if t.kind == "table":
            if len(t.parts) == 1 and t.parts[0].lower() in env:
                return self._offer(alias, env[t.parts[0].lower()])
            return _Scope(alias, None, ".".join(p.lower() for p in t.parts))
        if t.kind == "derived":
            return self._offer(alias, self._renamed(self._query(t.kids[0], env), t.parts))
        made: Sources = {}
        for k in t.kids:
            made |= self._sources(k, before, env)
        names = [n for n in (t.alias, str(t.extra.get("offset", ""))) if n]
        scope = _Scope(alias, {n.lower(): made if n == t.alias else {} for n in names})
        return scope

    @staticmethod
    def _offer(alias: str, columns: list) -> _Scope:
        stars = [next(iter(s))[0] for n, s, _ in columns if n == "*"]
        return _Scope(alias, {n.lower(): s for n, s, _ in columns if n != "*"}, "", stars)

    def _resolve(self, parts: list[str], scopes: list[_Scope]) -> Sources:
        if len(parts) > 1:
            for s in scopes:
                if parts[0].lower() == s.alias:
                    return s.get(parts[1]) or {}
                if len(parts) > 2 and s.table.endswith(".".join(p.lower() for p in parts[:-1])) and s.table:
                    return s.get(parts[-1]) or {}
        known = [s for s in scopes if s.columns is not None and parts[0].lower() in s.columns]
        if known:
            return known[0].get(parts[0]) or {}
        # a column that no derived table offers is one of the physical table's, if there is one
        open_ended = [s for s in scopes if s.columns is None or s.more]
        return (open_ended[0].get(parts[0]) or {}) if len(open_ended) == 1 else {}

    def _sources(self, e: Node, scopes: list[_Scope], env: dict) -> Sources:
        out: Sources = {}
        todo = [e]
        while todo:
            n = todo.pop(0)
            if n.kind == "column":
                out |= self._resolve(n.parts, scopes) or self._resolve(n.parts, getattr(self, "_outer", []))
            elif n.kind == "subquery":
                for _, s, _ in self._query_in(n.kids[0], scopes, env):
                    out |= s
            elif n.kind != "exists":
                todo = n.kids + todo
        return out

    def _query_in(self, q: Node, outer: list[_Scope], env: dict) -> list[tuple[str, Sources, str]]:
        """A nested query, which may also name columns of the queries around it."""
        keep, self._outer = getattr(self, "_outer", []), outer
        try:
            return self._query(q, env)
        finally:
            self._outer = keep

    def _select(self, s: Node, env: dict) -> list[tuple[str, Sources, str]]:
        if self._until is not None and time.monotonic() > self._until:
            raise OverBudget
        scopes: list[_Scope] = []
        for t in tables_of(s):
            scopes.append(self._scope(t, env, scopes))
        out: list[tuple[str, Sources, str]] = []
        for i, item in enumerate(s.extra["items"]):
            if item.kind == "star":
                replaced = {k.name.lower(): k for k in item.kids}
                dropped = {p.lower() for p in item.parts}
                for scope in scopes:
                    if item.name and item.name.lower() != scope.alias:
                        continue
                    if scope.columns is None:
                        out.append(("*", {(scope.table, c): None for c in ["*", *sorted(dropped | replaced.keys())]}, "passthrough"))
                    else:
                        out += [("*", {(t, "*"): None}, "passthrough") for t in scope.more]
                        out += [(n, src, "passthrough") for n, src in scope.columns.items() if n not in dropped and n not in replaced]
                out += [(k.name, self._sources(k.kids[0], scopes, env), "derived") for k in item.kids]
                continue
            e = item.kids[0]
            inner = e
            while inner.kind == "field":
                inner = inner.kids[0]
            sources = self._sources(e, scopes, env)
            name = item.name or (e.parts[-1] if e.kind == "column" else e.name if e.kind == "field" else f"f{i}_")
            tag = "passthrough" if inner.kind == "column" and sources else "derived" if sources else "unknown"
            out.append((name, sources, tag))
        return out


def lineage_rows(text: str | None, budget: float = 0.0) -> tuple[list[tuple[str, str, str, str]], str]:
    """((output, table, column, transform) rows, status) of one text.

    A star row has output ``*``; its further rows with transform ``except`` name columns
    the star leaves out. Status: ok, no_sql (null or blank), unreadable, timeout (over ``budget`` seconds, 0 for none).
    """
    if not text or not text.strip():
        return [], "no_sql"
    try:
        outputs = Lineage(parse(text), budget).outputs
    except OverBudget:
        return [], "timeout"
    except (SqlError, RecursionError):
        return [], "unreadable"
    rows = []
    for name, sources, tag in outputs:
        for table, column in sources:
            rows.append((name, table, column, "except" if name == "*" and column != "*" else tag))
    return list(dict.fromkeys(rows)), "ok"


# -- over DataFrames ----------------------------------------------------------

EVENT_FIELDS = "target string, column string, clause string, operator string, selectivity string, wrapping_fn string, event_no int"


def extract_usage(models: DataFrame, model: str, sql: str, targets: str) -> DataFrame:
    """Usage events of every row: (model, target, column, ...); ``targets`` is an array of names per row."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for m, text, names in zip(b["m"], b["s"], b["t"]):
                wanted = {str(n).lower() for n in names} if names is not None else set()
                rows += [(m, *e, i) for i, e in enumerate(usage_events(text, wanted))]
            yield pd.DataFrame(rows, columns=["model", "target", "column", "clause", "operator", "selectivity", "wrapping_fn", "event_no"])

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s"), F.col(targets).alias("t")).mapInPandas(run, f"model string, {EVENT_FIELDS}")


def extract_all_usage(models: DataFrame, model: str, sql: str) -> DataFrame:
    """Usage events of every row on all tables it names: (model, target, column, ..., status).

    A text that can't be read has one row with status ``unreadable`` and nulls.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for m, text in zip(b["m"], b["s"]):
                if not text or not text.strip():
                    continue
                try:
                    rows += [(m, *e, i, "ok") for i, e in enumerate(_events(parse(text), None))]
                except SqlError:
                    rows.append((m, *[None] * 7, "unreadable"))
            yield pd.DataFrame(rows, columns=["model", "target", "column", "clause", "operator", "selectivity", "wrapping_fn", "event_no", "status"])

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s")).mapInPandas(run, f"model string, {EVENT_FIELDS}, status string")


def extract_filters(models: DataFrame, model: str, sql: str) -> DataFrame:
    """(model, columns): see filter_columns; one row per row."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"model": b["m"], "columns": [filter_columns(t) for t in b["s"]]})

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s")).mapInPandas(run, "model string, columns array<string>")


def extract_references(models: DataFrame, model: str, sql: str) -> DataFrame:
    """(model, table_name, bare_star, in_from) for each table each text names."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = [(m, *r) for m, text in zip(b["m"], b["s"]) for r in table_references(text)]
            yield pd.DataFrame(rows, columns=["model", "table_name", "bare_star", "in_from"])

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s")).mapInPandas(run, "model string, table_name string, bare_star boolean, in_from boolean")


def time_lineage(models: DataFrame, model: str, sql: str, budget: float = 30.0) -> DataFrame:
    """(model, seconds, status): what extract_lineage takes for every text; order by seconds for the slowest."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for m, text in zip(b["m"], b["s"]):
                start = time.monotonic()
                status = lineage_rows(text, budget)[1]
                rows.append((m, time.monotonic() - start, status))
            yield pd.DataFrame(rows, columns=["model", "seconds", "status"])

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s")).mapInPandas(run, "model string, seconds double, status string")


def slowest(timings: DataFrame, most: int = 5, least: float = 0.0) -> DataFrame:
    """The ``most`` models that took longest, of those that took ``least`` seconds; ties by name."""
    return timings.where(F.col("seconds") >= least).orderBy(F.desc("seconds"), "model").limit(most)


def extract_lineage(models: DataFrame, model: str, sql: str, budget: float = 30.0) -> DataFrame:
    """(model, output, table_name, column, transform, status): symbolic lineage of every text."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for m, text in zip(b["m"], b["s"]):
                found, status = lineage_rows(text, budget)
                rows += [(m, *r, status) for r in found] or [(m, None, None, None, None, status)]
            yield pd.DataFrame(rows, columns=["model", "output", "table_name", "column", "transform", "status"])

    return models.select(F.col(model).alias("m"), F.col(sql).alias("s")).mapInPandas(run, "model string, output string, table_name string, column string, transform string, status string")


def extract_analysis(rows: DataFrame, key: str, sql: str) -> DataFrame:
    """(key, tables, where_columns, join_columns, group_columns, status) of every text."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([{"key": k, **analyze_query(t)} for k, t in zip(b["k"], b["s"])], columns=["key", "tables", "where_columns", "join_columns", "group_columns", "status"])

    return rows.select(F.col(key).cast("string").alias("k"), F.col(sql).alias("s")).mapInPandas(run, "key string, tables array<string>, where_columns array<string>, join_columns array<string>, group_columns array<string>, status string")
