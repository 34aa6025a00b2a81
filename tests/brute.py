"""Plain Python versions of the general queries, over tables read with pyarrow."""

import collections
import datetime as dt
import json
import re
from decimal import Decimal

import pyarrow.parquet as pq


def rows(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def strip_sql(text):
    """Walks the text character by character: quotes are kept, comments and space dropped."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" and c != "`" else 1
            out.append(text[i:j + 1])
            i = j + 1
        elif text.startswith("--", i):
            while i < len(text) and text[i] not in "\r\n":
                i += 1
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = len(text) if j < 0 else j + 2
        elif c in " \t\n\r\f\v":
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def no_constant(name):
    raise ValueError(name)


def latest(items, key, version="loaded_at"):
    best = {}
    for r in items:
        k = key(r)
        if k is not None and (k not in best or r[version] > best[k][version]):
            best[k] = r
    return best


def p1(sf_dir):
    best = latest(rows(sf_dir, "manifest_nodes"), lambda r: (r["snapshot_date"], r["unique_id"]))
    by = collections.defaultdict(dict)
    for (d, u), r in best.items():
        config = r["config"]
        by[d][u] = (r["compiled_code"] and strip_sql(r["compiled_code"]), config if config is None else json.dumps(json.loads(config), sort_keys=True))
    out, dates = set(), sorted(by)
    for a, b in zip(dates, dates[1:]):
        for u in by[a].keys() | by[b].keys():
            old, new = by[a].get(u), by[b].get(u)
            if old != new:
                out.add((str(b), u, "added" if old is None else "removed" if new is None else "changed"))
    return out


def p2(sf_dir):
    parents, names = collections.defaultdict(set), set()
    children = collections.defaultdict(set)
    for r in rows(sf_dir, "child_map"):
        names.add(r["unique_id"])
        for c in r["children"] or []:
            names.add(c)
            parents[c].add(r["unique_id"])
            children[r["unique_id"]].add(c)

    def ancestors(x):
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(parents[y])
        return seen

    up = {x: ancestors(x) for x in names}
    loop = {x for x in names if x in up[x]}
    out = set()
    for x in names:
        if not x.startswith("model."):
            continue
        if x in loop:
            out.add((x, "cycle", -1))
        elif up[x] & loop:
            out.add((x, "below_cycle", -1))
        else:
            top, depth = x, 0
            while parents[top]:
                top, depth = min(parents[top]), depth + 1
            out.add((x, top, depth))
    return out


def p3(sf_dir):
    out, best = collections.defaultdict(lambda: [0, 0]), latest(rows(sf_dir, "table_reference_incremental"), lambda r: r["ref_id"])
    for r in best.values():
        if r["table_id"] is not None:
            t = out["table_reference_incremental", f"{r['dataset_id']}.{r['table_id']}"]
            t[0] += 1
            t[1] += int((r["reference_count"] or "").strip() or 0)
    entries = collections.defaultdict(list)
    for r in rows(sf_dir, "child_map"):
        entries[r["unique_id"]].extend(r["children"] or [])
    return {(*k, *v) for k, v in out.items()} | {("child_map", k, len(v), len(set(v))) for k, v in entries.items()}


def p4(sf_dir):
    data = rows(sf_dir, "models_costs_incremental")
    last = max(r["hour"] for r in data).date()
    named = [r for r in data if r["dbt_model_name"] is not None]
    best = latest(named, lambda r: (r["dbt_model_name"].removeprefix("lumen_dwh."), r["hour"]))
    days = collections.defaultdict(lambda: collections.defaultdict(Decimal))
    for (m, h), r in best.items():
        days[m][h.date()] += Decimal((r["total_query_cost"] or "").strip() or 0)
    out = set()
    for m, by in days.items():
        d = min(by)
        while d <= last:
            span = lambda n: int(sum((by.get(d - dt.timedelta(i), Decimal(0)) for i in range(n)), Decimal(0)) * 1_000_000)  # noqa: B023,E731
            out.add((m, str(d), span(7), span(30)))
            d += dt.timedelta(1)
    return out


def p5(sf_dir):
    out = set()
    for rid, r in latest(rows(sf_dir, "bi_reports"), lambda r: r["report_id"], "scanned_at").items():
        for p, section in enumerate(r["sections"] or []):
            for v, visual in enumerate((section or {}).get("visualContainers") or []):
                try:
                    at = json.loads((visual or {}).get("config"), parse_constant=no_constant)
                    roles = at["singleVisual"]["projections"].items()
                except (ValueError, TypeError, KeyError, AttributeError):
                    continue
                for role, items in roles:
                    for i, item in enumerate(items if isinstance(items, list) else []):
                        ref = item.get("queryRef") if isinstance(item, dict) else None
                        if isinstance(ref, str) and re.search(r"\S", ref):
                            out.add((rid, p, v, role, i, ref.strip()))
    return out
