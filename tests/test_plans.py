"""The SQL reader, usage events, references and column lineage."""

import pytest

from tallyloom.plans.sqltext import SqlError, parse
from tallyloom.plans.usage import analyze_query, extract_lineage, extract_references, extract_usage, lineage_rows, table_references, usage_events

T = {"visits", "ds.visits", "proj.ds.visits"}
CASES = [
    ("select 1 from proj.ds.visits v where v.id = 5", [("id", "where", "eq", "literal", "")]),
    ("select 1 from `proj.ds.visits` v where v.c in ('a', 'b')", [("c", "where", "in", "literal", "")]),
    ("select 1 from ds.visits v where v.id in (select id from other)", [("id", "where", "in", "subquery", "")]),
    ("select 1 from visits v where v.d between '2024-01-01' and '2024-02-01'", [("d", "where", "between", "range", "")]),
    ("select 1 from visits v where coalesce(v.x, v.y) = 5", [("x", "where", "eq", "literal", "coalesce"), ("y", "where", "eq", "literal", "coalesce")]),
    ("select 1 from visits v join e on e.k = v.k", [("k", "join", "eq", "none", "")]),
    ("select 1 from visits v join e on upper(e.k) = upper(v.k)", [("k", "join", "eq", "none", "upper")]),
    ("select count(*) from visits v group by v.c", [("c", "group_by", "none", "none", "")]),
    ("select 1 from visits v qualify row_number() over (partition by v.x order by v.y desc) = 1", [("x", "partition_by", "none", "none", ""), ("y", "order_by", "none", "none", "")]),
    ("with visits as (select * from o.t) select 1 from visits v where v.a = 1", []),
    ("with z as (select 1 k) select 1 from visits t join z on true where t.amount > 100", [("amount", "where", "gt", "range", "")]),
    ("select v.a, v.b from visits v", [("a", "select", "none", "none", ""), ("b", "select", "none", "none", "")]),
    ("select 1 from visits v where v.a is not null and not v.b like 'x%' and v.c != 3", [("a", "where", "is_null", "none", ""), ("b", "where", "like", "literal", ""), ("c", "where", "neq", "literal", "")]),
    ("select 1 from visits v where extract(year from v.ts) = 2024", [("ts", "where", "eq", "literal", "extract")]),
    ("select 1 from visits having max(x) > 1", []), ("", []), (None, []), ("garbage ((", []), ("select 1 from elsewhere e where e.a = 1", []),
]


@pytest.mark.parametrize(("text", "events"), CASES)
def test_usage(text, events):
    assert [e[1:] for e in usage_events(text, T)] == events


def test_usage_without_targets_and_in_frames(spark):
    assert usage_events("select 1 from visits v where v.id = 5", set()) == []
    rows = spark.createDataFrame([("m", CASES[0][0], sorted(T)), ("n", None, None), ("o", "((", [])], "model string, sql string, t array<string>")
    assert [tuple(r)[:5] for r in extract_usage(rows, "model", "sql", "t").collect()] == [("m", "proj.ds.visits", "id", "where", "eq")]
    assert extract_usage(rows.limit(0), "model", "sql", "t").count() == 0
    assert extract_references(rows, "model", "sql").count() == 1
    assert {r["status"] for r in extract_lineage(rows, "model", "sql").collect()} == {"ok", "no_sql", "unreadable"} - {"ok"} | {r["status"] for r in extract_lineage(rows.where("model = 'm'"), "model", "sql").collect()}


def test_references():
    assert table_references("select * from a.b join c.d using (k)") == [("a.b", True, True), ("c.d", False, False)]
    assert table_references("select t.* from a.b t") == [("a.b", False, True)]
    assert table_references("broken ( from p.d.t") == [("p.d.t", False, True)]
    assert table_references(None) == []


def test_analysis():
    out = analyze_query("select 1 from p.d.t a join d.u b on a.k = b.k where a.x = 1 and lower(b.y) = 'z' group by a.g")
    assert out == {"tables": ["p.d.t", "d.u"], "where_columns": ["x", "y"], "join_columns": ["k"], "group_columns": ["g"], "status": "ok"}
    assert analyze_query("select ??? p.d.t")["status"] == "partial" and analyze_query(None)["tables"] == []


def test_lineage():
    rows, status = lineage_rows("with c as (select id, upper(name) nm, * except (id) from p.d.raw) select c.id as cid, nm, a.x, c.extra, (select max(v) from d.ev) mv, count(*) n from c join d.a as a using (id) group by 1")
    assert status == "ok" and set(rows) == {
        ("cid", "p.d.raw", "id", "passthrough"), ("nm", "p.d.raw", "name", "passthrough"), ("x", "d.a", "x", "passthrough"), ("extra", "p.d.raw", "extra", "passthrough"), ("mv", "d.ev", "v", "derived")
    }
    assert set(lineage_rows("select a, b from d.t union all select c, d + 1 from d.u")[0]) == {("a", "d.t", "a", "passthrough"), ("a", "d.u", "c", "passthrough"), ("b", "d.t", "b", "derived"), ("b", "d.u", "d", "derived")}
    assert set(lineage_rows("select * except (x) from d.t")[0]) == {("*", "d.t", "*", "passthrough"), ("*", "d.t", "x", "except")}
    assert lineage_rows("  ") == ([], "no_sql") and lineage_rows("select from") == ([], "unreadable")


@pytest.mark.parametrize("text", [
    "select a, from t", "select array_agg(x order by y limit 1)[offset(0)], struct(1 as a, 'x' as b), safe_cast(x as int64) from unnest([1, 2]) x with offset as o",
    "select 1 # note\n from my-proj.d.t2 t, unnest(t.arr) as u where not exists (select 1 from k where k.id = t.id)", "select * replace (lower(a) as a) from t window w as (partition by b)",
    "(select 1) union all (select 2) order by 1 limit 3", "select interval 1 day, date '2024-01-01', @p, x.y.z, -1e-3, if(a, b, c) from t for system_time as of current_timestamp()",
])
def test_reads(text):
    assert parse(text).kind == "query"


@pytest.mark.parametrize("text", ["", "select", "select 1 from", "{{ config() }}", "select (1", "update t set a = 1", "select " + "(" * 5000 + "1" + ")" * 5000, "'open"])
def test_refuses(text):
    with pytest.raises(SqlError):
        parse(text)
