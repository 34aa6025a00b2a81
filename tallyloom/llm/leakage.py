"""Test passages in training text, by a positional inverted index.

The index holds, for each term and document, the positions of the term. A passage that
leaked leaves at least one exact run of RUN words, so each run of a test item is looked
up by its two rarest terms: their position lists are intersected at the offset the item
gives. Documents that pass are compared with the item around the hit, position by
position, with altered, missing and added words counted: a passage without any is an
exact match, others are proximity matches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyloom.llm.words import words
from tallyloom.session import HOT_SHARE, Kept, cut, ensure_checkpoint_dir, observed

#: Words of the item a passage must have, and words per tolerated edit.
LEAST_WORDS, WORDS_PER_EDIT = 15, 10
#: Words an edit must add to a passage to be worth it.
EDIT_COST = 3
#: L words with L // 10 edits have an exact run of at least (L - e) / (e + 1) words; the
#: least of these over L >= 15 is 6 (20 words, 2 edits).
RUN = 6
#: Slots of the filter of test terms: the index is made of words whose slot a test term
#: has. It takes 2**SLOT_BITS / 8 bytes in every task, however large the test set is.
SLOT_BITS = 22
#: Rows of test data that may be broadcast; beyond it joins are shuffled, hot terms dealt
#: over SALTS copies of their rows.
FEW, SALTS = 200_000, 32


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, at, term): the words of every test item with their positions."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, w) for k, t in zip(b["item"], b["text"]) for i, w in enumerate(words(t))]
            yield pd.DataFrame(rows, columns=["item", "at", "term"])

    kind = dict(items.dtypes)[key]
    return items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text")).mapInPandas(split, f"item {kind}, at int, term string")


def term_slots(terms: DataFrame) -> np.ndarray:
    """Which slots some term has; 2**SLOT_BITS booleans."""
    slots = terms.select(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(1 << SLOT_BITS)).cast("int").alias("slot")).distinct().toPandas()
    out = np.zeros(1 << SLOT_BITS, dtype=bool)
    out[slots["slot"].to_numpy(dtype=np.int64)] = True
    return out


def positional_index(docs: DataFrame, key: str, text: str, slots: np.ndarray | None = None) -> DataFrame:
    """(doc, version, term, places): the index of a corpus; with ``slots``, of the terms in these slots only.

    ``version`` is a hash of the text, which keeps apart texts that share a key.
    """
    known = docs.sparkSession.sparkContext.broadcast(slots)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, seen = known.value, {}
        for b in batches:
            rows = []
            if len(seen) > 500_000:
                seen.clear()
            for k, v, t in zip(b["doc"], b["version"], b["text"]):
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words(t)):
                    hit = seen.get(w)
                    if hit is None:
                        hit = seen[w] = wanted is None or bool(wanted[zlib.crc32(w.encode()) & (len(wanted) - 1)])
                    if hit:
                        places.setdefault(w, []).append(i)
                rows += [(k, v, w, p) for w, p in places.items()]
            yield pd.DataFrame(rows, columns=["doc", "version", "term", "places"])

    kind = dict(docs.dtypes)[key]
    chosen = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return chosen.mapInPandas(post, f"doc {kind}, version long, term string, places array<int>")


def _kept(df: DataFrame, hot: str | None = None) -> Kept:
    """Cut of ``df`` with its number of rows and the hot values of a column, counted on the way."""
    seen = Observation()
    ensure_checkpoint_dir(df.sparkSession)
    asked = [F.count(F.lit(1)).alias("n"), *([F.expr(f"approx_top_k({hot}, {HOT_SHARE}, {20 * HOT_SHARE})").alias("hot")] if hot else [])]
    out = df.observe(seen, *asked).checkpoint(eager=True)
    got = observed(seen, out, asked)
    return Kept(out, int(got["n"]), {}, [r[0] for r in got.get("hot") or [] if r[0] is not None and r[1] * HOT_SHARE > got["n"]])


def rare_pairs(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(item, term, other, ahead): the two rarest terms of each run of RUN words of an item.

    Rarity is the number of documents with the term. A run with a term that no document
    has cannot occur and gives no pair; ties go to the earlier word.
    """
    counts = index.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    w = Window.partitionBy("item").orderBy("at").rowsBetween(0, RUN - 1)
    runs = terms.join(counts, "term", "left").withColumn("run", F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "term")).over(w))
    best = runs.where(F.size("run") == RUN).withColumn("run", F.array_sort("run")).where(F.col("run")[0]["df"] > 0)
    return best.select(
        "item", F.col("run")[0]["term"].alias("term"), F.col("run")[1]["term"].alias("other"), (F.col("run")[1]["at"] - F.col("run")[0]["at"]).alias("ahead")
    ).distinct()


def met_terms(index: Kept, right: Kept, on: str, how: str = "inner") -> DataFrame:
    """Index rows joined to rows of test data on a term, which few terms may hold most of.

    A small right side is broadcast. Beyond that hot terms are dealt: their index rows over
    SALTS parts by document, their right rows copied to every part.
    """
    if right.n <= FEW:
        return index.df.join(F.broadcast(right.df), on, how)
    is_hot = F.coalesce(F.col(on).isin(index.hot), F.lit(False)) if index.hot else F.lit(False)
    left = index.df.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int"))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.df.withColumn("_part", F.explode(parts)), [on, "_part"], how).drop("_part")


def candidates(index: Kept, pairs: Kept) -> DataFrame:
    """(doc, version, item): documents in which some run's two rarest terms stand at the right distance."""
    seeds = met_terms(index, pairs, "term")
    wanted = _kept(pairs.df.select(F.col("other").alias("term")).distinct())
    others = met_terms(index, wanted, "term", "left_semi").select("doc", "version", F.col("term").alias("other"), F.col("places").alias("other_places"))
    met = seeds.join(others, ["doc", "version", "other"])
    return met.where("arrays_overlap(transform(places, p -> p + ahead), other_places)").select("doc", "version", "item").distinct()


def _reach(a: list[str], b: list[str], edits: int) -> list[tuple[int, int]]:
    """Most words of ``a`` passed from its start with 0, 1, ... edits against ``b``'s start, and the words of ``b`` passed with them.

    The work is at most the square of the edits, which are a tenth of the item's words.
    """

    def slide(i: int, shift: int) -> int:
        while i < len(a) and i + shift < len(b) and a[i] == b[i + shift]:
            i += 1
        return i

    front = {0: slide(0, 0)}
    most = [(front[0], front[0])]
    for _ in range(edits):
        after: dict[int, int] = {}
        for shift, i in front.items():
            for s, j in ((shift, i + 1), (shift - 1, i + 1), (shift + 1, i)):
                if j <= len(a) and 0 <= j + s <= len(b):
                    after[s] = max(after.get(s, 0), slide(j, s))
        if not after:
            break
        front = after
        # of ways that pass as many words of a the one with the fewest words of b counts
        i, last = max((i, -(i + s)) for s, i in front.items())
        most.append(max((i, -last), most[-1], key=lambda x: (x[0], -x[1])))
    return most


def best_passage(text: list[str], item: list[str]) -> tuple[int, int, int, int, int] | None:
    """(edits, item from, item to, text from, text to) of the best passage, if there is one.

    A passage has LEAST_WORDS successive words of ``item`` with few enough edits. The best
    has most words, each edit counting as EDIT_COST words less; then the fewest edits, then
    the first place in the text. Ends are exclusive.
    """
    starts: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(item) - RUN + 1):
        starts.setdefault(tuple(item[i : i + RUN]), []).append(i)
    edits = len(item) // WORDS_PER_EDIT
    span = len(item) + edits + 1
    best: tuple | None = None
    for j in range(len(text) - RUN + 1):
        for i in starts.get(tuple(text[j : j + RUN]), ()):
            if i and j and item[i - 1] == text[j - 1]:
                continue  # inside a run that was tried from its start
            right = _reach(item[i:], text[j : j + span], edits)
            left = _reach(item[:i][::-1], text[max(j - span, 0) : j][::-1], edits)
            for x, (behind, text_behind) in enumerate(left):
                for y, (ahead, text_ahead) in enumerate(right):
                    if behind + ahead >= max(LEAST_WORDS, WORDS_PER_EDIT * (x + y)):
                        found = (behind + ahead - EDIT_COST * (x + y), -(x + y), -j, x + y, i - behind, i + ahead, j - text_behind, j + text_ahead)
                        best = found if best is None or found[:3] > best[:3] else best
    return best[3:] if best else None


def leaked_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, kind, n_edits, item_from, item_to, doc_from, doc_to): the best passage of each item in each document.

    Positions count words from 0, ends are exclusive; ``kind`` is exact or proximity. Rows
    with a null key or text, and texts without words, hold nothing; an item of fewer than
    LEAST_WORDS words can't leak; repeated rows count once. All items count in a document,
    so a shared passage is reported for each of them. Other columns are ignored.
    """
    terms = _kept(item_terms(items, item_key, item_text))
    index = _kept(positional_index(docs, doc_key, doc_text, term_slots(terms.df)), hot="term")
    pairs = _kept(rare_pairs(terms.df, index.df))
    met = cut(candidates(index, pairs))
    # the documents' words are read back from the index; words of no item stay unknown
    text_key = ["doc", "version"]
    places = index.df.join(met.select(*text_key).distinct(), text_key, "left_semi").dropDuplicates([*text_key, "term"])
    lists = places.groupBy(*text_key).agg(F.collect_list(F.struct("term", "places")).alias("terms"))
    texts = _kept(terms.df.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda s: s["term"]).alias("item_words")))
    # an item in very many documents is met by all of them: few items are broadcast
    texts = F.broadcast(texts.df) if terms.n <= 10 * FEW else texts.df
    compared = met.join(texts, "item").groupBy(*text_key).agg(F.collect_list(F.struct("item", "item_words")).alias("items")).join(lists, text_key)
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, posted, tried in zip(b["doc"], b["terms"], b["items"]):
                text = [""] * (1 + max(int(max(t["places"])) for t in posted))
                for t in posted:
                    for p in t["places"]:
                        text[p] = t["term"]
                for x in tried:
                    found = best_passage(text, list(x["item_words"]))
                    if found:
                        rows.append((doc, x["item"], "proximity" if found[0] else "exact", *found))
            yield pd.DataFrame(rows, columns=["doc", "item", "kind", "n_edits", "item_from", "item_to", "doc_from", "doc_to"])

    found = compared.select("doc", "terms", "items").mapInPandas(compare, f"doc {kinds[0]}, item {kinds[1]}, kind string, n_edits int, item_from int, item_to int, doc_from int, doc_to int")
    return found.withColumnRenamed("doc", doc_key).withColumnRenamed("item", item_key)


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key): documents with a passage of an item; distinct. See leaked_passages."""
    return leaked_passages(docs, doc_key, doc_text, items, item_key, item_text).select(doc_key, item_key).distinct()
