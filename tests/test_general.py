"""The general operators against plain Python versions on whole tables, and on awkward rows."""

import datetime as dt

import brute
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import json_core, sql_core, strict_variant
from tallyloom.operators import hierarchy as h
from tallyloom.operators.hierarchy import Hierarchy
from tallyloom.operators.hotkeys import key_totals, latest_versions, list_totals
from tallyloom.operators.rolling import trailing_totals
from tallyloom.operators.shredding import Edge, SchemaGraph, Shredder, latest_rows
from tallyloom.operators.snapshots import leaf_bits_for, snapshot_changes
from tallyloom.queries import general
from tallyloom.session import Rounds, join_dealt, join_hot


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_found_equals_brute_force(spark, small, n):
    rows = got(general.QUERIES[f"p{n}_found"](spark, small))
    assert len(rows) == len(set(rows))
    assert set(rows) == getattr(brute, f"p{n}")(small)


def test_sql_core(spark):
    texts = ["select 'a -- b'  , x -- c\n from t /* y\n z */ where \"q  r\" = `b  c`", "select 'it''s  ok', 'a\\' -- b'", "a/* open", "'open  ", "", None, "x" * 300_000 + " '" + "\\a" * 60_000 + "'"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(sql_core("t")).collect()
    assert [r[0] for r in rows] == [t if t is None else brute.strip_sql(t) for t in texts]


def test_json_core(spark):
    same = [('{"a": 1, "b": [1, 2]}', '{"b":[1,2.0],"\\u0061":1e0}'), ("null", " null "), ('"x\\/y"', '"x/y"')]
    other = [('{"a":[1,2]}', '{"a":[2,1]}'), ("null", None), ("{", "{ "), ('{"a":"1"}', '{"a":1}'), ("true", "1"), ('{"a":".0"}', '{"a":""}')]
    rows = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, same boolean")
    assert all(r[0] == r[1] for r in rows.select(json_core("a").eqNullSafe(json_core("b")), "same").collect())


def test_strict_variant(spark):
    texts = {'{"a":1}': True, '{"a":1} x': False, "1], [2": False, '1,"b":2': False, "": False, "[1,]": False, "{'a':1}": False, '{"a":1,"a":2}': True}
    general.keep_last_duplicate_keys(spark)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strict_variant("t").isNotNull()).collect()
    assert dict(map(tuple, rows)) == texts


def snap(spark, rows):
    return spark.createDataFrame([(dt.date(2025, 1, d), k, dt.datetime(2025, 1, 1, v), c, "clash") for d, k, v, c in rows], "s date, k string, v timestamp, c string, _row string")


def changes(df, **kw):
    return sorted(tuple(map(str, r[:3])) for r in snapshot_changes(df, "s", "k", "v", {"c": F.col("c")}, **kw).collect())


def test_snapshot_changes(spark):
    rows = [(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 2, "y"), (1, "b", 1, None), (1, "d", 1, ""), (3, "a", 1, "y"), (3, "b", 1, ""), (3, "c", 1, "z"), (9, "a", 1, "y"), (9, "b", 1, ""), (9, "c", 1, "z"), (3, None, 1, "z")]
    want = [("2025-01-03", "b", "changed"), ("2025-01-03", "c", "added"), ("2025-01-03", "d", "removed")]
    assert changes(snap(spark, rows)) == want
    assert changes(snap(spark, rows), leaf_bits=12) == want
    assert changes(snap(spark, rows[:5])) == []
    assert changes(snap(spark, rows[:0])) == []
    # a tie in version does not depend on order
    tie = [(1, "a", 1, "x"), (1, "a", 1, "y"), (2, "a", 1, "x"), (2, "a", 1, "y")]
    assert changes(snap(spark, tie)) == changes(snap(spark, tie[::-1])) == []
    assert leaf_bits_for(10) == 4 and leaf_bits_for(1e12) == 32


def tree(spark, rows):
    return spark.createDataFrame(rows, "p string, c array<string>, x string")


def test_hierarchy_shapes(spark):
    rows = [
        ("r", ["a", "b", "a", None], ""), ("a", ["c"], ""), ("c", ["d", "e"], ""), ("d", ["f"], ""), ("lone", None, ""), (None, ["zz"], ""), ("r", [], ""),
        ("l1", ["l2"], ""), ("l2", ["l3", "below"], ""), ("l3", ["l1"], ""), ("r", ["l1"], ""), ("self", ["self", "under"], ""), ("under", ["deep"], ""),
        ("x1", ["x2"], ""), ("x2", ["x1", "y1"], ""), ("y1", ["y2"], ""), ("y2", ["y1"], ""),
    ]
    made = Hierarchy(tree(spark, rows), "p", "c")
    status = dict(got(made.status))
    assert status == {k: "cycle" for k in ("l1", "l2", "l3", "self", "x1", "x2", "y1", "y2")} | {k: "below_cycle" for k in ("below", "under", "deep")}
    out = {r["x"]: r for r in made.paths().collect()}
    assert out["f"]["path"] == ["r", "a", "c", "d", "f"] and out["f"]["depth"] == 4 and out["f"]["root_id"] == "r"
    assert out["lone"]["path"] == ["lone"] and out["lone"]["size"] == 1
    assert out["r"]["size"] == 7
    assert {x: (r["root_id"], r["depth"]) for x, r in out.items()} == {r[0]: (r[1], r[2]) for r in got(made.depths())}
    numbered = {r["x"]: r for r in made.intervals().collect()}
    for x, r in numbered.items():
        below = {y for y, s in out.items() if x in s["path"][:-1]}
        assert {y for y, s in numbered.items() if s["root_id"] == r["root_id"] and r["first"] < s["first"] <= r["last"]} == below
    empty = Hierarchy(tree(spark, []), "p", "c")
    assert got(empty.status) == [] and got(empty.paths()) == [] and got(empty.depths()) == [] and got(empty.intervals()) == []


def test_deep_chain_and_wide_parent(spark):
    rows = [(f"n{i:03}", [f"n{i + 1:03}"], "") for i in range(130)] + [("n000", [f"w{i}" for i in range(300)], "")]
    made = Hierarchy(tree(spark, rows), "p", "c")
    out = {r["x"]: r for r in made.paths().collect()}
    assert out["n130"]["depth"] == 130 and out["n130"]["path"] == [f"n{i:03}" for i in range(131)]
    assert out["n000"]["size"] == 431 and len({r["first"] for r in made.intervals().collect()}) == 431


def test_hubs(spark):
    """A parent and a child that hold most links, second parents and a loop beside them."""
    rows = [("hub", [f"x{i}" for i in range(600)], ""), *[(f"x{i}", ["sink"], "") for i in range(300)], ("top", ["hub"], ""), ("other", [f"x{i}" for i in range(300)], ""), ("sink", ["end"], ""), ("x7", ["ring"], ""), ("ring", ["ring", *[f"y{i}" for i in range(300)]], "")]
    made = Hierarchy(tree(spark, rows), "p", "c")
    assert "hub" in made.kept_edges.hot_too and "sink" in made.kept_edges.hot
    status = dict(got(made.status))
    assert status["ring"] == "cycle" and len(status) == 301
    depths = {r[0]: (r[1], r[2]) for r in got(made.depths())}
    assert depths["x5"] == ("top", 2) and depths["end"] == ("top", 4) and depths["other"] == ("other", 0)
    links = h.tree_pairs(made.paths())
    below = {}
    for x, y in set(got(links.where("x <> descendant"))) | set(got(made.pairs(links))):
        below.setdefault(x, set()).add(y)
    assert len(below["hub"]) == 600 + 2 + 301 and len(below["other"]) == 300 + 2 + 301 and len(below["x7"]) == 2 + 301 and len(below["x9"]) == 2


def ladder(levels):
    """Two names a level, each with both names of the next level as children."""
    return [(f"n{i:02}{s}", [f"n{i + 1:02}a", f"n{i + 1:02}b"], "") for i in range(levels - 1) for s in "ab"]


@pytest.mark.parametrize("room", [16, 0])
def test_ladders(spark, monkeypatch, room):
    """Names with several parents only: every link counts, and rounds grow with the logarithm of the depth."""
    cuts = []
    plain = Rounds.cut
    monkeypatch.setattr(Rounds, "cut", lambda self, *a, **k: cuts.append(1) or plain(self, *a, **k))
    monkeypatch.setattr(h, "PAIRS_PER_LINK", room)
    monkeypatch.setattr(h, "PAIRS_MORE", 10_000 if room else 0)
    used = {}
    for n in (6, 24) if room else (6,):
        cuts.clear()
        made = Hierarchy(tree(spark, ladder(n)), "p", "c")
        assert got(made.status) == [] and {r["depth"] for r in made.depths().collect()} == set(range(n))
        used[n] = len(cuts)
    if room:
        assert used[24] <= used[6] + 12
        return
    below = made.paths()
    tree_links = h.tree_pairs(below)
    pairs = set(got(tree_links.where("x <> descendant"))) | set(got(made.pairs(tree_links)))
    assert sum(x == "n00b" for x, _ in pairs) == 10
    looped = Hierarchy(tree(spark, [*ladder(4), ("n03b", ["n01a", "z"], ""), ("z", ["z1"], "")]), "p", "c")
    assert dict(got(looped.status)) == {f"n0{i}{s}": "cycle" for i in (1, 2, 3) for s in "ab" if (i, s) not in ((1, "b"), (3, "a"))} | {"n03a": "below_cycle", "z": "below_cycle", "z1": "below_cycle"}


def test_descendants_beside_the_tree(spark, tmp_path):
    below = {
        "r": ["a", "b"], "a": ["c"], "b": ["c", "d"], "c": ["e"], "d": ["e", "l1"], "e": ["t"], "l1": ["l2"], "l2": ["l1", "u"], "u": ["v"], "v": None, "s": ["s"], "z": [], "q": ["v", "e"],
    }
    m = lambda x: f"model.{x}"
    rows = [(m(k), v if v is None else [m(x) for x in v]) for k, v in below.items()]
    spark.createDataFrame(rows, "unique_id string, children array<string>").write.parquet(f"{tmp_path}/child_map.parquet")

    def all_below(x):
        seen, todo = set(), list(below.get(x) or [])
        while todo:
            if (y := todo.pop()) not in seen:
                seen.add(y)
                todo += below.get(y) or []
        return seen

    names = {*below, *(y for v in below.values() for y in v or [])}
    pairs = got(general.QUERIES["p2_descendants"](spark, str(tmp_path)))
    assert sorted(pairs) == sorted((m(x), m(y)) for x in names for y in all_below(x))
    out = {r["unique_id"]: r for r in general.QUERIES["p2_paths"](spark, str(tmp_path)).collect()}
    assert {x: r["n_descendants"] for x, r in out.items()} == {m(x): len(all_below(x)) for x in names}
    assert (out[m("l1")]["root_id"], out[m("v")]["root_id"], out[m("v")]["depth"], out[m("v")]["path"]) == ("cycle", "below_cycle", -1, None)


def test_join_hot(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.range(30_000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    kept = Rounds(spark, 20_000).cut(left, hot="k")
    assert kept.hot == ["7"] and kept.n == 20_000
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum("v")).first()
    twice = right.union(right)
    assert sums(join_dealt(left, twice, "k", ["7", "9"], "id")) == sums(left.join(twice, "k"))
    assert sums(join_dealt(left, twice.where("k <> '9'"), "k", ["7", "9"], "id", "left")) == sums(left.join(twice.where("k <> '9'"), "k", "left"))
    assert sums(join_hot(kept.df, right, "k", kept.hot)) == sums(join_hot(left, right, "k", [])) == sums(left.join(right, "k"))


def test_totals(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 7), (1, 2, "a", 7), (2, 1, None, 9), (3, None, "b", None), (None, 5, "a", 100)], "id long, v long, k string, n long")
    last = latest_versions(rows, "id", "v", ["k", "n"])
    assert sorted(got(last)) == [(1, "a", 7), (2, None, 9), (3, "b", None)]
    assert sorted(got(key_totals(last, "k", "n"))) == [("a", 1, 7), ("b", 1, 0)]
    assert got(key_totals(last.limit(0), "k", "n")) == []
    lists = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["x"]), ("b", None), ("b", []), ("c", [None, "x"]), (None, ["q"])], "k string, e array<string>")
    assert sorted(got(list_totals(lists, "k", "e"))) == [("a", 4, 2), ("b", 0, 0), ("c", 2, 1)]


def test_trailing_totals(spark):
    d = lambda i: dt.date(2025, 1, 1) + dt.timedelta(i)
    rows = spark.createDataFrame([("a", d(0), 1), ("a", d(0), 2), ("a", d(40), 5), ("b", d(39), None), (None, d(1), 9), ("c", None, 9)], "e string, d date, n long")
    out = {(r[0], r[1]): r[2:] for r in trailing_totals(rows, "e", "d", F.col("n"), [1, 7, 30, 13]).collect()}
    assert len(out) == 41 + 2
    for i in range(41):
        total = lambda n: (3 if i < n else 0) + (5 if i == 40 else 0)  # noqa: B023,E731
        assert out["a", d(i)] == (total(1), total(7), total(30), total(13))
    assert out["b", d(40)] == (0, 0, 0, 0)
    assert got(trailing_totals(rows.limit(0), "e", "d", F.col("n"), [7])) == []


def test_shared_inlining(spark):
    g = SchemaGraph("r", [Edge("r", "a", "xs", "array"), Edge("a", "one", "one"), Edge("one", "t", "tag"), Edge("r", "t", "tag"), Edge("one", "m", "map", "map"), Edge("r", "n", "tree", "array"), Edge("n", "n", "kids", "array")],
                    {"a": {"name": "name"}, "one": {"v": "v"}, "t": {"label": "l"}, "n": {"id": "i"}})
    assert g.placement() == {"r": "root", "a": "repeated", "one": "inlined", "t": "shared", "m": "repeated", "n": "recursive"}
    doc = '{"xs":[{"name":"p","one":{"v":1,"tag":{"l":"q"},"map":{"k":[],"z":2}}},null,5,{"name":null,"one":[]}],"tag":{"l":"top"},"tree":[{"i":1,"kids":[{"i":2,"kids":[{"i":3}]},null]}]}'
    roots = spark.createDataFrame([("d1", doc), ("d2", None), ("d3", "[]")], "id string, j string").select("id", F.expr("try_parse_json(j)").alias("_v"))
    s = Shredder(g, roots, "id")
    assert sorted(got(s.table("a").select("a_no", "name", "v"))) == [(0, "p", "1"), (1, None, None), (2, None, None), (3, None, None)]
    assert sorted(got(s.table("t").select("_parent", "label"))) == [("a", "q"), ("r", "top")]
    assert sorted(got(s.table("m").select("m_key", "a_no"))) == [("k", 0), ("z", 0)]
    nodes = s.table("n")
    assert sorted(got(nodes.where("n_id IS NOT NULL").select("_level", "n_id"))) == [(0, "1"), (1, "2"), (2, "3")]
    links = {r["_id"]: r["_parent_id"] for r in nodes.collect()}
    assert sum(p in links for p in links.values()) == 3


def test_latest_rows(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = spark.createDataFrame([("a", t(1), "x"), ("a", t(2), "y"), ("a", t(2), "y"), ("b", None, "z"), (None, t(1), "q")], "k string, v timestamp, c string")
    assert sorted(got(latest_rows(rows, "k", "v", ["c"]).select("k", "c"))) == [("a", "y"), ("a", "y"), ("b", "z")]
