"""Leaked passages against brute force over all documents and items."""

import random

from pyspark.sql import functions as F

from tallyloom.llm import queries
from tallyloom.llm import leakage
from tallyloom.llm.leakage import RUN, best_passage, leaked_items, leaked_passages, positional_index
from tallyloom.llm.words import words


def holds_passage(text, item):
    return best_passage(text, item) is not None


def test_words():
    assert words(f"a <img src='{'x' * 4000}'> b [quote={'y' * 4000}]c") == ["a", "b", "c"]
    assert words("if a <b " + "and so on " * 40 + "> c")[:4] == ["if", "a", "b", "and"]
    assert words("Fеnjоr &amp; <b>Bi</b>g  [quote=x]H​ouse—Ｆｕｌｌ ﬁne café") == ["fenjor", "big", "house", "full", "fine", "cafe"]
    assert words("> tru-\n> sted half-done") == ["trusted", "half", "done"]
    assert words("a <!-- <!-- ad --> ad --> b") == ["a", "b"]
    assert words(None) == words("") == words("... !!") == []


def edited(rng, passage, edits):
    out = list(passage)
    for at in sorted(rng.sample(range(1, len(out) - 1), edits), reverse=True):
        kind = rng.choice("sdi")
        out[at : at + (kind != "i")] = [] if kind == "d" else ["zz"]
    return out


def test_every_allowed_edit_is_found():
    rng = random.Random(4)
    item = [f"w{i}" for i in range(70)]
    for _ in range(400):
        n = rng.randint(15, 60)
        at = rng.randint(0, 70 - n)
        text = ["x", "y"] * rng.randint(0, 5) + edited(rng, item[at : at + n], rng.randint(0, n // 10)) + ["q"] * 3
        assert holds_passage(text, item)


def test_too_little_is_not_found():
    item = [f"w{i}" for i in range(70)]
    assert not holds_passage(item[10:23] + ["q"] * 20, item)
    assert not holds_passage(item[10:20] + ["q", "q"] + item[21:26], item)
    shuffled = item[:]
    random.Random(2).shuffle(shuffled)
    assert not holds_passage(shuffled, item) and not holds_passage([], item) and not holds_passage(item, item[:14])


def test_index_and_awkward_rows(spark):
    item = " ".join(f"term{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, f"start {item} end", "x"), (2, None, "x"), (3, "", "x"), (4, item.upper().replace(" ", ",\n> "), "x"), (4, item.upper().replace(" ", ",\n> "), "x"), (None, item, "x"), (5, " ".join(item.split()[:12]), "x"), (6, "term0 " * 5000, "x")],
        "doc long, text string, item_id string",
    )
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1), (10, "other words " + item, 1), (None, item, 1)], "item long, text string, doc int")
    assert sorted(map(tuple, leaked_items(docs, "doc", "text", items, "item", "text").collect())) == [(1, 7), (1, 10), (4, 7), (4, 10)]
    assert leaked_items(docs.limit(0), "doc", "text", items, "item", "text").count() == 0
    assert leaked_items(docs, "doc", "text", items.limit(0), "item", "text").count() == 0
    out = {(r["doc"], r["item"]): r for r in leaked_passages(docs, "doc", "text", items, "item", "text").collect()}
    assert {k: (r["kind"], r["n_edits"], r["item_from"], r["item_to"], r["doc_from"], r["doc_to"]) for k, r in out.items()} == {
        (1, 7): ("exact", 0, 0, 30, 1, 31), (4, 7): ("exact", 0, 0, 30, 0, 30), (1, 10): ("exact", 0, 2, 32, 1, 31), (4, 10): ("exact", 0, 2, 32, 0, 30)
    }
    index = positional_index(docs.where("doc = 1"), "doc", "text")
    assert index.where("term = 'term3'").first()["places"] == [4] and RUN == 6


def test_best_passage():
    item = [f"w{i}" for i in range(40)]
    assert best_passage(["x", *item[5:15], "zz", *item[16:36], "y"], item) == (1, 5, 36, 1, 32)
    assert best_passage([*item[:15], "q", "q", "q", *item[:22]], item) == (0, 0, 22, 18, 40)


def test_large_test_sets_take_the_same_rows(spark, monkeypatch):
    """Shuffled joins with hot terms dealt, and a filter whose slots are all taken."""
    rng = random.Random(8)
    pool = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(pool, k=30))) for i in range(12)]
    docs = [(i, "hot " * 9 + " ".join(rng.choices(pool, k=8)) + " " + " ".join(items[i % 12][1].split()[i % 5 : 12 + i % 9]) + " hot") for i in range(80)]
    docs, items = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    run = lambda: sorted(map(tuple, leaked_passages(docs, "doc", "text", items, "item", "text").collect()))
    first = run()
    assert first
    monkeypatch.setattr(leakage, "FEW", 0)
    monkeypatch.setattr(leakage, "SLOT_BITS", 2)
    assert run() == first


def test_query_equals_brute_force(spark, small):
    rows = {tuple(r) for r in queries.QUERIES["p7_found"](spark, small).collect()}
    read = lambda name, key: [(r[0], words(r[1])) for r in spark.read.parquet(f"{small}/{name}.parquet").select(key, "text").where(F.col("text").isNotNull()).collect()]
    items = read("eval_items", "item_id")
    assert rows == {(d, i) for d, text in read("documents", "doc_id") for i, item in items if holds_passage(text, item)}
