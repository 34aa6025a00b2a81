"""Packing: every text once, no container too full, little space unused."""

import numpy as np
import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import packing
from tallyloom.llm.packing import BestFit, fill_report, pack, pack_shard, pieces_of, token_counter
from tallyloom.llm import queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("ab"), st.integers(0, 6)), max_size=120))
def test_shard_holds(items):
    rows = pd.DataFrame(items, columns=["size", "source", "cluster"])
    rows = rows.astype({"size": int, "cluster": int})
    rows["container"] = pack_shard(rows, 50)
    assert (rows.groupby("container")["size"].sum() <= 50).all()
    assert len(rows["container"]) == len(items)


def test_copies_are_kept_apart_while_there_is_room():
    rows = pd.DataFrame({"size": [10] * 40 + [90] * 40, "source": "s", "cluster": [1] * 8 + list(range(100, 172))})
    rows["container"] = pack_shard(rows, 100)
    assert rows[rows["cluster"] == 1].groupby("container").size().max() == 1
    assert rows["container"].nunique() == 40


def test_hot_cluster_costs_no_space():
    rng = np.random.default_rng(1)
    size = rng.integers(20, 300, 3000)
    size[:1000] = 40
    rows = pd.DataFrame({"size": size, "source": "s", "cluster": [1] * 1000 + list(range(10, 2010))})
    rows["container"] = pack_shard(rows, 1024)
    assert rows["container"].nunique() <= -(-size.sum() // 1024) + 2


def test_sources_apart():
    rows = pd.DataFrame({"size": [10] * 10, "source": ["a"] * 5 + ["b"] * 5, "cluster": range(10)})
    rows["container"] = pack_shard(rows, 1000, {"a": {"b"}, "b": {"a"}})
    assert rows.groupby("container")["source"].nunique().max() == 1 and rows["container"].nunique() == 2


def test_tightest_container_first():
    bins = BestFit(10)
    assert [bins.add_run(n, 1, 0, 1)[0] for n in (6, 7, 3, 4)] == [0, 1, 1, 0]


def test_pack_awkward_rows(spark):
    long = "word " * 700
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "", "s", "x"), (3, None, "s", "x"), (4, long, "s", "x"), (None, "lost", "s", "x"), (5, "a", "s", "x"), (5, "a", "s", "x")], "doc long, text string, source string, size string")
    out = pack(rows, "doc", "text", "source", *VOCABULARY, capacity=128).collect()
    assert {r["doc"] for r in out} == {1, 2, 4, 5} and sum(r["doc"] == 5 for r in out) == 2
    pieces = sorted((r["first_token"], r["n_tokens"]) for r in out if r["doc"] == 4)
    total = token_counter(*VOCABULARY)(long)
    assert sum(n for _, n in pieces) == total and all(n == 128 for _, n in pieces[:-1]) and [f for f, _ in pieces] == list(range(0, total, 128))
    used = pd.DataFrame([r.asDict() for r in out]).groupby("container_id")["n_tokens"].sum()
    assert used.max() <= 128
    empty = pack(rows.limit(0), "doc", "text", "source", *VOCABULARY)
    assert empty.count() == 0 and fill_report(empty).first()["n_containers"] == 0


def test_pieces(spark):
    rows = spark.createDataFrame([(1, 0), (2, 10), (3, 11), (4, 30)], "item int, size long")
    assert sorted((r["item"], r["piece"], r["first_token"], r["size"]) for r in pieces_of(rows, 10).collect()) == [(1, 0, 0, 0), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 1), (4, 0, 0, 10), (4, 1, 10, 10), (4, 2, 20, 10)]


def test_long_texts_are_counted_whole():
    count = token_counter(*VOCABULARY)
    text = "line of words\n" * 40_000
    whole = packing._pieces
    try:
        packing._pieces = lambda t: [t]
        want = [token_counter(*VOCABULARY)(t) for t in (text, "naïve café, don't! " * 12_000, "x" * 300_000)]
    finally:
        packing._pieces = whole
    assert [count(t) for t in (text, "naïve café, don't! " * 12_000, "x" * 300_000)] == want
    assert len(list(packing._pieces(text))) > 3 and "".join(packing._pieces(text)) == text


def test_strict_keeps_any_number_of_copies_apart():
    rows = pd.DataFrame({"size": [40] * 300 + [900] * 30, "source": "s", "cluster": [1] * 300 + list(range(10, 40))})
    rows["container"] = pack_shard(rows, 1024, strict=True)
    assert rows[rows["cluster"] == 1].groupby("container").size().max() == 1 and rows["container"].nunique() == 300
    assert rows.groupby("container")["size"].sum().max() <= 1024


def test_query(spark, small):
    out = queries.QUERIES["p6_containers"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL")
    rows = out.toPandas()
    assert set(rows["doc_id"]) == {r[0] for r in docs.select("doc_id").collect()}
    assert not rows.duplicated(["doc_id", "piece_no"]).any() and rows.groupby("container_id")["n_tokens"].sum().max() <= 2048
    assert fill_report(out).first()["share_unused"] < 0.1
