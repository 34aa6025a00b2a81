"""Texts into containers of fixed capacity by conflict-constrained best fit.

Sizes are tokens of a public tokenizer. Items are dealt into shards by hash, each large
enough that its last containers weigh little; within a shard the largest item goes first
into the tightest container that can take it. Containers are kept in order of their
residual space and carry bitmaps of the sources and duplicate clusters they hold; the
search moves on to the next larger residual until a container fits without conflict.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

CAPACITY = 2048
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Items of a shard; a shard is packed by one task and needs about 300 bytes an item.
SHARD_ITEMS = 20_000


def token_counter(vocabulary: str, pattern: str):
    """Function from texts to token counts, for a byte-level vocabulary in rank format."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: sum(len(encoding.encode_ordinary(part)) for part in _pieces(text))


def _pieces(text: str, least: int = 100_000) -> Iterator[str]:
    """Parts of a text that can be counted one by one.

    A seam lies between a letter and a single space before a letter: split patterns of
    byte-level vocabularies end a token there in any case, so counts add up exactly. A
    text without seams stays whole.
    """
    at = 0
    for m in _SEAM.finditer(text):
        if m.start() - at >= least:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


def token_sizes(docs: DataFrame, key: str, text: str, source: str, vocabulary: str, pattern: str, cluster: str | None = None) -> DataFrame:
    """(item, source, cluster, size): tokens of every text that is not null.

    ``cluster`` is a hash of the column of that name, such as the class of a near-duplicate
    search; without one, of the text's letters and digits in lower case, so copies that
    differ in case, spacing or punctuation share one.
    """
    kind = dict(docs.dtypes)[key]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary, pattern)
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "source": b["source"], "cluster": b["cluster"], "size": [count(t) for t in b["text"]]})

    plain = F.lower(F.regexp_replace(F.col(text), r"[^\p{L}\p{N}]+", " "))
    chosen = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("item"), F.col(source).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(cluster).cast("string"), plain) if cluster else plain).alias("cluster"), F.col(text).alias("text"),
    )
    return chosen.mapInPandas(measure, f"item {kind}, source string, cluster long, size long")


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, first_token, size, ...): a text above the capacity in full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    return (
        sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("first_token", F.col("piece") * F.lit(capacity).cast("long"))
        .withColumn("size", F.least(F.col("size") - F.col("first_token"), F.lit(capacity)))
    )


class BestFit:
    """Containers of one shard, in order of residual space.

    ``apart`` gives, for a source's bit, the bits of sources it must not share a
    container with; items of one cluster bit never share one.
    """

    def __init__(self, capacity: int, apart: dict[int, int] | None = None) -> None:
        self.capacity, self.apart = capacity, apart or {}
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r is set while some container has residual r
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _place(self, bin_no: int, size: int, source: int, cluster: int) -> int:
        left = self.residual[bin_no] - size
        self.residual[bin_no] = left
        self.sources[bin_no] |= source
        self.clusters[bin_no] |= cluster
        self.levels[left].append(bin_no)
        self.filled |= 1 << left
        return bin_no

    def _fits(self, bin_no: int, source: int, cluster: int) -> bool:
        return not self.clusters[bin_no] & cluster and not self.sources[bin_no] & self.apart.get(source, 0)

    def add_run(self, size: int, source: int, cluster: int, count: int) -> list[int]:
        """Places ``count`` items alike in everything; returns their containers.

        One pass over the residuals serves the whole run: a container passed over holds
        the cluster or a conflicting source and keeps doing so.
        """
        placed: list[int] = []
        open_levels = self.filled >> size
        r = size
        while open_levels and len(placed) < count:
            skip = (open_levels & -open_levels).bit_length() - 1
            r, open_levels = r + skip, open_levels >> skip
            level = self.levels[r]
            kept, taken = [], []
            while level and len(placed) + len(taken) < count:
                b = level.pop()
                (taken if self._fits(b, source, cluster) else kept).append(b)
            level.extend(reversed(kept))
            if not level:
                self.filled &= ~(1 << r)
            placed += [self._place(b, size, source, cluster) for b in taken]
            if not cluster and len(placed) < count and taken:
                # alike items without a cluster may share a container
                open_levels, r = self.filled >> size, size
                continue
            r, open_levels = r + 1, open_levels >> 1
        while len(placed) < count:
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            placed.append(self._place(len(self.residual) - 1, size, source, cluster))
        return placed


def pack_shard(items: pd.DataFrame, capacity: int, apart: dict[str, set[str]] | None = None, strict: bool = False) -> list[int]:
    """Container number of each row of ``items`` (size, source, cluster), by best fit.

    Texts with copies go first, while there is room to keep them apart, then the others;
    both largest first. With ``strict`` no container holds two copies of a text, whatever
    their number, and a cluster with more copies than the other texts need containers opens
    containers of its own. Without it such a cluster is dealt into groups that can be kept
    apart, so that it costs no space: a container then holds at most one copy of each group.
    Texts of 0 tokens conflict with none.
    """
    room = len(items) + 1 if strict else max(1, int(0.9 * items["size"].sum() / capacity))
    copies = items["cluster"].value_counts()
    bits: dict[tuple[int, int], int] = {}
    for c, n in copies[copies > 1].items():
        for group in range(-(-n // room)):
            bits[c, group] = 1 << len(bits)
    names = sorted({s if isinstance(s, str) else "" for s in items["source"]})
    source_bit = {s: 1 << i for i, s in enumerate(names)}
    apart_bits = {source_bit[s]: sum(source_bit[o] for o in others if o in source_bit) for s, others in (apart or {}).items() if s in source_bit}
    bins = BestFit(capacity, apart_bits)
    out = [0] * len(items)
    seen: dict[int, int] = {}
    rows = []
    for i, (n, s, c) in enumerate(zip(items["size"], items["source"], items["cluster"])):
        seen[c] = seen.get(c, -1) + 1
        bit = bits[c, seen[c] // room] if copies[c] > 1 and n else 0
        rows.append((not bit, -int(n), bit, source_bit[s if isinstance(s, str) else ""], i))
    rows.sort()
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][:4] == rows[at][:4]:
            end += 1
        size, cluster, source = -rows[at][1], rows[at][2], rows[at][3]
        chunk = rows[at:end]
        if cluster:
            placed = bins.add_run(size, source, cluster, len(chunk))
        else:
            placed = [bins.add_run(size, source, 0, 1)[0] for _ in chunk]
        for (*_, i), b in zip(chunk, placed):
            out[i] = b
        at = end
    return out


def pack(
    docs: DataFrame, key: str, text: str, source: str, vocabulary: str, pattern: str,
    capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, apart: dict[str, set[str]] | None = None, strict: bool = False, cluster: str | None = None,
) -> DataFrame:
    """(container_id, key, piece_no, first_token, n_tokens): every text placed exactly once.

    Texts above the capacity are split at token ``capacity``, 2 ``capacity``, ...; no
    other text is split. Null keys and texts are no items and left out, empty texts take
    0 tokens; a repeated row is placed again, in another container. ``apart`` names sources
    that must not share a container; ``strict``, ``cluster``: see pack_shard, token_sizes. Shards follow a hash of row and piece, so the copies
    of a hot text or key are spread evenly and each shard's bitmaps stay small.
    """
    kind = dict(docs.dtypes)[key]
    sizes = cut(token_sizes(docs, key, text, source, vocabulary, pattern, cluster))
    # row numbers of written files stay the same when a task runs again
    items = pieces_of(sizes.withColumn("row", F.monotonically_increasing_id()), capacity)
    shards = max(1, -(-items.count() // shard_items))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
        made = pack_shard(group, capacity, apart, strict)
        shard = group["shard"].iloc[0]
        return pd.DataFrame({
            "container_id": [f"{shard}-{b}" for b in made], "item": group["item"], "piece_no": group["piece"],
            "first_token": group["first_token"], "n_tokens": group["size"],
        })

    packed = dealt.groupBy("shard").applyInPandas(fill, f"container_id string, item {kind}, piece_no int, first_token long, n_tokens long")
    return packed.withColumnRenamed("item", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_items, n_tokens, share_unused) of a packing."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
    ).withColumn("share_unused", F.round(1 - F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), 6))
