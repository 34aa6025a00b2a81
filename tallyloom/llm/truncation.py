"""Texts cut by a length limit or a broken transfer, found by a hashed logistic regression.

Every text is read once, into the features of its closing and its lengths. Lengths at
which a source's texts pile up are found in counts over all rows. Training needs no
labels: texts of a bounded sample are cut artificially (anywhere, or at a length taken
for a limit) and become positives; the same texts as stored, and beginnings of them that
end where a sentence ends, are negatives. Every record is then scored from its features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

#: Texts the classifier is fitted on: those with the least hash. A bound on the training
#: rows only; limits, word counts and scores cover all rows.
SAMPLE_TEXTS = 8_000
FEATURE_BITS = 18
MASK = (1 << FEATURE_BITS) - 1
#: Words are counted in this many hash slots over all texts.
WORD_SLOTS = 1 << 19
#: Words a task counts by name before it adds them to the slots.
HELD_WORDS = 200_000
#: Share of texts in a pile of lengths that may close with a sentence end.
MOST_ENDED = 0.4
#: Greatest logit kept; scores are counted in eighths of a logit.
MOST = 15.0
#: A group's share of cut texts leans toward that of all sources like this many texts.
LEAN = 300.0
#: Least probability of a reported text. The shares err on the low side (most texts above it are plainly cut), hence below 0.5.
DECIDE = 0.15
#: Characters before the end that the closing features look at; open markup and lengths
#: are taken from the whole text.
TAIL = 240
#: Rows of a right side that may be broadcast; more are met by salted joins.
FEW = 10_000

# fixed values: marks that shortened texts are closed with
MARKS = ("...", "…", "[...]", "[…]", "&hellip;", "&#8230;")
_MARK = re.compile(r"\s*(?:" + "|".join(re.escape(m) for m in MARKS) + r")$")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_+")
_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = frozenset(".!?…:;)]}>\"'»”`*~=_|-")
_ENDED = re.compile(r"[.!?]['\")\]]*\s*$")
_SENTENCE_END = re.compile(r"[^\W\d_]{2,}(?P<stop>[.!?]+)(?=\s|$)")
_BREAK = re.compile(r"[.!?]\s|\n")
_PARTIAL = re.compile(r"(<[^<>]{0,80}|\[/?[a-z]*(=[^\]]{0,80})?|&[a-z#0-9]{0,7}|https?:/{0,2})$")
_WORDLY = re.compile(r"[^\W_]|[<\[&]")
_AGAIN = re.compile(r"(.)\1+")
# fixed values: elements of forum markup that come in pairs
_PAIRS = frozenset(("quote", "code", "b", "i", "u", "size", "img", "blockquote", "small", "pre", "p", "div", "span", "em", "strong", "a", "url"))
_TAG = re.compile(r"[<\[](/?)([a-z]+)\b[^<>\[\]]*[>\]]", re.I)
_DIGITS = str.maketrans("123456789", "000000000")
#: Shapes of characters: A for upper case, a for other letters, 0 for digits.
_SHAPES = {ord(c): "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in map(chr, range(0x250))}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().translate(_DIGITS))


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_SLOTS


def _bucket(n: float) -> int:
    return 0 if n <= 0 else int(n).bit_length()


def _open_markup(text: str) -> str:
    """The innermost element or block that the text leaves open."""
    stack: list[str] = []
    if "<" in text or "[" in text:
        for close, name in _TAG.findall(text):
            name = name.lower()
            if name in _PAIRS:
                if not close:
                    stack.append(name)
                elif name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name):]
    if "```" in text and text.count("```") % 2:
        stack.append("```")
    return stack[-1] if stack else ""


class Ending:
    """The closing of a text: hashed features, and what limits and word counts are asked for.

    ``chars`` and ``bytes`` are lengths without a closing mark, ``word`` is the slot of the
    last word (-1 where the text ends in something else), ``close`` how it ends.
    """

    __slots__ = ("bytes", "chars", "close", "ended", "features", "mark", "size", "word")

    def __init__(self, text: str) -> None:
        last_part = text[-60:]
        found = _MARK.search(last_part)
        bare = text[: len(text) - len(last_part) + found.start()] if found else text
        mark = found[0].strip() if found else ""
        self.chars, self.mark = len(bare), bool(mark)
        self.bytes = len(bare) if bare.isascii() else len(bare.encode("utf-8", "replace"))
        tail = bare[-TAIL:]
        body = tail.rstrip()
        self.ended = bool(_ENDED.search(tail[-40:]))
        words = words_of(body)
        last = words[-1] if words else ""
        is_word = last[:1].isalnum()
        self.word, self.size = _slot(last) if is_word else -1, min(len(last), 8)
        line = body.rsplit("\n", 1)[-1]
        run = _BREAK.split(body)[-1]
        n_run = len(_WORD.findall(run))
        # a closing line without letters or digits lies in no word, sentence or piece of markup
        signs = not mark and line.strip() != "" and not _WORDLY.search(line)
        stopped = self.close = "signs" if signs else "stop" if body[-1:] in _STOP and body else "word" if is_word else "other"
        inside = _open_markup(text)
        first = (words_of(line[:80]) + ["", ""])[:2]
        start = run[:1]
        entering = "" if not start else "upper" if start.isupper() else "lower" if start.isalpha() else "0"
        token = body.rsplit(None, 1)[-1] if body else ""
        look = "url" if token[:4].lower() in ("http", "www.") else _AGAIN.sub(r"\1", token[-40:].translate(_SHAPES))[:12]
        above = body[: -len(line)].rstrip("\n").rsplit("\n", 1)[-1].strip()[:4] if line else ""
        w2, w3, w4 = " ".join(words[-2:]), " ".join(words[-3:]), " ".join(words[-4:])
        named = (
            "1", f"mark={mark}", f"markclose={mark}|{stopped}", f"shape={body[-4:].translate(_SHAPES).lower()}", f"char={body[-1:]}", f"two={body[-2:]}", f"three={body[-3:]}",
            f"w1={last}", f"w2={w2}", f"w3={w3}", f"w4={w4}", f"prev={words[-2] if len(words) > 1 else ''}|{stopped}",
            f"open={inside}", f"openclose={inside}|{stopped}", f"partial={bool(_PARTIAL.search(body))}", f"paren={body.count('(') > body.count(')')}|{stopped}",
            f"run={_bucket(n_run)}|{stopped}", f"runraw={min(n_run, 14)}|{entering}|{stopped}", f"line={first[0]} {first[1]}", f"linelen={_bucket(len(line))}|{stopped}",
            f"look={look}", f"above={above}|{first[1]}", f"whole={' '.join(words) if len(text) < 60 else ''}",
            f"line1={first[0]}|{stopped}", f"length={_bucket(len(text)) // 2}|{stopped}", f"space={len(tail) > len(body)}|{stopped}",
            *[f"bag={w}" for w in (words[-8:] + [""] * 8)[:8]],
        )
        self.features = [zlib.crc32(f.encode("utf-8", "replace")) & MASK for f in named]


def gap_of(chars: int, n_bytes: int, limits: list[tuple[str, int]]) -> str:
    """How far a text is below the nearest limit of its source above it, in steps."""
    if not limits:
        return "none"
    left = [g for unit, cap in limits if (g := cap - (chars if unit == "chars" else n_bytes)) > -4]
    if not left:
        return "over"
    g = min(left)
    return "at" if g <= 0 else "near" if g <= 3 else "word" if g <= 12 else "below"


_CACHE: dict[str, int] = {}


def _id(name: str) -> int:
    got = _CACHE.get(name)
    if got is None:
        got = _CACHE[name] = zlib.crc32(name.encode()) & MASK
    return got


def asked_features(gap: str, mark: bool, close: str, word: int, size: int, counts: np.ndarray) -> list[int]:
    """Features that depend on limits and word counts."""
    known = _bucket(float(counts[word])) if word >= 0 else -1
    return [
        _id(f"gap={gap}"), _id(f"gapmark={gap}|{mark}"), _id(f"gapclose={gap}|{close}|{mark}"),
        _id(f"known={known}"), _id(f"knownlen={known}|{size}"), _id(f"closeknown={close}|{min(known, 5)}"),
    ]


ENDING_FIELDS = "h long, chars int, bytes int, ended int, mark boolean, close string, word int, size int, x array<int>, slots array<int>, slot_n array<int>"


def endings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (key, source, text): see Ending; null ``x`` for null and blank texts.

    Further rows without ``h`` hold, for a task, the number of texts with a word by slot.
    """
    kind = dict(docs.dtypes)["key"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "source", *[f.split()[0] for f in ENDING_FIELDS.split(", ")]]
        total, held = np.zeros(WORD_SLOTS, dtype=np.int64), Counter()

        def settle() -> None:
            for w, n in held.items():
                total[_slot(w)] += n
            held.clear()

        for b in batches:
            rows = []
            for k, source, h, t in zip(b["key"], b["source"], b["h"], b["text"]):
                if not isinstance(t, str) or not t.strip():
                    rows.append((k, source, h, 0, 0, 0, False, "blank", -1, 0, None, None, None))
                    continue
                e = Ending(t)
                # the last word may be cut, so it is no evidence for itself
                held.update(set(_LETTERS.findall(t.lower())[:-1]))
                rows.append((k, source, h, e.chars, e.bytes, int(e.ended), e.mark, e.close, e.word, e.size, e.features, None, None))
            if len(held) > HELD_WORDS:
                settle()
            yield pd.DataFrame(rows, columns=columns)
        settle()
        used = np.flatnonzero(total)
        yield pd.DataFrame([(None, None, None, 0, 0, 0, False, "counts", -1, 0, None, used, total[used])], columns=columns)

    return docs.select("key", "source", F.xxhash64("text").alias("h"), "text").mapInPandas(read, f"key {kind}, source string, {ENDING_FIELDS}")


def word_counts(read: DataFrame) -> np.ndarray:
    """Number of texts with a word, by hash slot, over all texts; WORD_SLOTS numbers."""
    pairs = read.where("close = 'counts'").select(F.explode(F.arrays_zip("slots", "slot_n")).alias("s"))
    counted = pairs.groupBy("s.slots").agg(F.sum("s.slot_n").alias("n")).toPandas()
    out = np.zeros(WORD_SLOTS, dtype=np.float32)
    out[counted["slots"].to_numpy()] = counted["n"].to_numpy()
    return out


def length_limits(read: DataFrame, least: int = 5, times: float = 6.0, sigmas: float = 8.0, span: int = 60) -> DataFrame:
    """(source, unit, cap): all lengths at which distinct texts of a source pile up.

    ``cap`` counts chars or UTF-8 bytes of the text without a closing mark. A pile has at
    least ``least`` distinct texts, ``times`` the mean of the ``span`` lengths on each
    side and ``sigmas`` deviations more than it, and few of its texts (MOST_ENDED) close
    with a sentence end. Counting is by (source, unit, length), combined map-side. Of
    piles next to each other (a text cut at bytes piles up at several chars) the largest
    counts, and of two units with the same texts the one with the larger pile.
    """
    lengths = read.where("x IS NOT NULL").select("source", "h", F.col("ended").alias("e"), F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")),
    )).alias("l")).select("source", "l.unit", "l.n", "h", "e")
    counts = lengths.distinct().groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("e").alias("e"))
    w = Window.partitionBy("source", "unit").orderBy("n")
    near = [F.coalesce(F.sum("c").over(x), F.lit(0)) for x in (w.rangeBetween(-span, -1), w.rangeBetween(1, span))]
    around = (near[0] + near[1]) / (span + F.least(F.lit(span), F.greatest(F.col("n") - 1, F.lit(1))))
    piles = counts.withColumn("around", F.greatest(around, F.lit(0.5)))
    piles = piles.where((F.col("e") <= MOST_ENDED * F.col("c")) & (F.col("c") >= least) & (F.col("c") >= times * F.col("around")) & (F.col("c") - F.col("around") >= sigmas * F.sqrt("around")))
    # bytes and chars of one limit are near each other; only the largest pile of a neighbourhood stays
    best = F.max(F.struct("c", "n", "unit")).over(Window.partitionBy("source").orderBy("n").rangeBetween(-span, span))
    return piles.withColumn("b", best).where("b.unit = unit AND b.n = n").select("source", "unit", F.col("n").alias("cap"))


def _clip(text: str, unit: str, n: int) -> str:
    return text[:n] if unit == "chars" else text.encode("utf-8", "replace")[:n].decode("utf-8", "ignore")


def examples(text: str, limits: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[int, str, list[tuple[str, int]]]]:
    """(label, text, limits) made of one stored text."""
    e = Ending(text)
    if gap_of(e.chars, e.bytes, limits) in ("at", "near", "word"):
        return []  # it may be cut itself
    out: list[tuple[int, str, list[tuple[str, int]]]] = [(0, text, limits)]
    if rng.random() < 0.06:
        out.append((0, text, [("chars", e.chars)]))  # a whole text may end at a limit
    ends = list(_SENTENCE_END.finditer(text))
    inner = [m for m in ends if m.end() < len(text)]
    if inner:
        m = inner[int(rng.integers(len(inner)))]
        out.append((0, text[: m.start("stop")] if rng.random() < 0.7 else text[: m.end()], limits))
    ended = {e.start("stop") for e in ends} | {e.end() for e in ends}
    for _ in range(3 if len(text) > 12 else 0):
        n = int(rng.integers(8, len(text)))
        made = text[:n]
        if n in ended or not made.strip() or re.search(r"[.!?]\s*$", made[-20:]) or text[n : n + 20].strip() in ("", ".", "!", "?"):
            continue
        if rng.random() < 0.35 and n >= 60:
            limit = ("chars", n) if rng.random() < 0.6 else ("bytes", len(made.encode("utf-8", "replace")))
            if rng.random() < 0.3:
                made = made.rsplit(" ", 1)[0]
            made += str(rng.choice(["", "", "...", "…", " [...]", "&hellip;"]))
            out.append((1, made, [limit]))
        else:
            out.append((1, made, limits))
    return out


def fit(x: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression over hashed features, by AdaGrad in small batches."""
    w, g2 = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-8)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for at in np.array_split(order.permutation(len(x)), max(len(x) // 256, 1)):
            if not len(at):
                continue
            p = 1 / (1 + np.exp(-w[x[at]].sum(axis=1)))
            touched, where = np.unique(x[at].ravel(), return_inverse=True)
            grad = np.bincount(where, weights=np.repeat((p - labels[at]) / len(at), x.shape[1])) + decay * w[touched]
            g2[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(g2[touched])
    return w.astype(np.float32)


def meet(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join on ``keys`` (nulls equal), of which few values may hold most of ``left``.

    A right side of up to FEW rows is broadcast; a larger one is copied ``salts`` times
    and each hot key's rows are dealt over the copies.
    """
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    if right.limit(FEW + 1).count() <= FEW:
        return left.join(F.broadcast(right), on, "left").drop(*[f"_{k}" for k in keys])
    right = right.withColumn("_dealt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    left = left.withColumn("_salt", F.pmod("h", F.lit(salts)).cast("int"))
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return left.join(right, [*on, left["_salt"] == right["_dealt"]], "left").drop("_salt", "_dealt", *[f"_{k}" for k in keys])


def _limit_list(limits: object) -> list[tuple[str, int]]:
    return [(x["unit"], int(x["cap"])) for x in limits] if limits is not None else []


def score_truncation(docs: DataFrame, key: str, text: str, source: str, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """(key, source, score): the probability that a text is only the beginning of what was written.

    Null, empty and blank texts get score 0, and so do texts that close with a line of
    signs alone, which is inside no word, sentence or markup; repeated rows are scored alike; other columns
    are ignored. Limits and word counts come from all rows; the model is fitted on the
    artificial cuts of at most ``sample`` texts.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    read = cut(endings(docs))
    limits = cut(length_limits(read).groupBy("source").agg(F.collect_list(F.struct("unit", "cap")).alias("limits")))
    context = docs.sparkSession.sparkContext
    counts = context.broadcast(word_counts(read))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made: list[tuple[int, int, list[int]]] = []
            for t, h, found in zip(b["text"], b["h"], b["limits"]):
                for y, s, caps in examples(t, _limit_list(found), np.random.default_rng(abs(int(h)))):
                    e = Ending(s)
                    made.append((int(h) & 1, y, e.features + asked_features(gap_of(e.chars, e.bytes, caps), e.mark, e.close, e.word, e.size, counts.value)))
            yield pd.DataFrame(made, columns=["fold", "label", "x"])

    # hashes are picked first, so that only the sample's texts move
    kept = read.where("x IS NOT NULL").select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = docs.withColumn("h", F.xxhash64("text")).where(F.trim("text") != "").where(F.col("h") <= (kept if kept is not None else -(2**63)))
    chosen = meet(chosen.dropDuplicates(["h"]), limits, ["source"]).select("text", "h", "limits")
    lessons = chosen.mapInPandas(make, "fold long, label long, x array<int>").toPandas()
    # two folds by text: no text is scored by a model that saw it as an uncut example
    models = []
    for fold in (0, 1):
        part = lessons[lessons["fold"] != fold]
        x = np.stack([np.asarray(v) for v in part["x"]]) if len(part) else np.zeros((0, 1), dtype=np.int64)
        models.append(fit(x, part["label"].to_numpy(float)))
    weights = context.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, zones = np.full(len(b), -np.inf), ["blank"] * len(b)
            rows = zip(b["x"], b["h"], b["chars"], b["bytes"], b["mark"], b["close"], b["word"], b["size"], b["limits"])
            for i, (x, h, chars, n_bytes, mark, close, word, size, found) in enumerate(rows):
                if x is None:
                    continue
                gap = gap_of(chars, n_bytes, _limit_list(found))
                w = weights.value[int(h) & 1]
                z[i] = min(max(float(w[x].sum() + w[asked_features(gap, mark, close, word, size, counts.value)].sum()), -MOST), MOST)
                zones[i] = "signs" if close == "signs" else "limit" if gap in ("at", "near", "word") else "far"
            yield pd.DataFrame({"key": b["key"], "source": b["source"], "h": b["h"], "zone": zones, "z": z})

    kind = dict(docs.dtypes)["key"]
    scored = cut(meet(read.where("close <> 'counts'").drop("slots", "slot_n"), limits, ["source"]).mapInPandas(score, f"key {kind}, source string, h long, zone string, z double"))
    made = float(lessons["label"].mean()) if len(lessons) else 0.5
    adjusted = meet(scored, prior_offsets(scored, made), ["source", "zone"])
    return adjusted.select("key", "source", F.when(F.col("zone").isin("blank", "signs"), 0.0).otherwise(1 / (1 + F.exp(-(F.col("z") + F.coalesce("shift", F.lit(0.0)))))).alias("score"))


def _share(z: np.ndarray, n: np.ndarray, made: float, strength: float, toward: float) -> float:
    """Share of positives by expectation-maximisation over counts ``n`` of logits ``z``."""
    z = z - np.log(made / (1 - made))
    share = 0.5
    for _ in range(300):
        p = 1 / (1 + np.exp(-(z + np.log(share / (1 - share)))))
        share = float(np.clip(((p * n).sum() + strength * toward) / (n.sum() + strength), 1e-5, 1 - 1e-5))
    return share


def prior_offsets(scored: DataFrame, made: float) -> DataFrame:
    """(source, zone, shift): logit shift from the training share to each group's own share.

    Groups are a source's texts at one of its limits, or far from them. Shares are
    estimated from counts of scores in bins of an eighth, so a group is never more than a
    few hundred rows; small groups lean toward the share of all sources.
    """
    made = min(max(made, 1e-5), 1 - 1e-5)
    bins = scored.where("zone NOT IN ('blank', 'signs')").groupBy("source", "zone", F.round(F.col("z") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = cut(bins)
    overall = {
        zone: _share(part["bin"].to_numpy() / 8, part["n"].to_numpy(), made, 1.0, 0.5)
        for zone, part in bins.groupBy("zone", "bin").agg(F.sum("n").alias("n")).toPandas().groupby("zone")
    }

    def shift(group: pd.DataFrame) -> pd.DataFrame:
        zone = group["zone"].iloc[0]
        share = _share(group["bin"].to_numpy() / 8, group["n"].to_numpy(), made, LEAN, overall[zone])
        return pd.DataFrame({"source": [group["source"].iloc[0]], "zone": [zone], "shift": [np.log(share / (1 - share)) - np.log(made / (1 - made))]})

    return bins.groupBy("source", "zone").applyInPandas(shift, "source string, zone string, shift double")


def cut_texts(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source) of the texts that are only a beginning; see score_truncation."""
    scores = score_truncation(docs, key, text, source)
    return scores.where(F.col("score") >= DECIDE).select(F.col("key").alias(key), F.col("source").alias(source))


def truncation_shares(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, n_posts, n_cut, share) over the texts that are not null; null sources are one group."""
    scores = score_truncation(docs.where(F.col(text).isNotNull()), key, text, source)
    return (
        scores.groupBy(F.col("source").alias(source))
        .agg(F.count(F.lit(1)).alias("n_posts"), F.count_if(F.col("score") >= DECIDE).alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n_posts"), 6))
    )
