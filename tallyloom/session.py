"""Session helpers: a local session for tests and benches, cutting of lineage, and rounds of joins."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot; fewer than HOT_SHARE keys can be.
HOT_SHARE = 200
#: Rows a task of a round has at least, while there are fewer tasks than the session's
#: usual number, and at most.
LEAST_ROWS, MOST_ROWS = 50_000, 2_000_000


def local_session(cores: int = 8, app: str = "tallyloom", memory: str = "12g") -> SparkSession:
    """Session for one machine. On a cluster the driver program brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master may fall back.

    A machine-local folder would lose data with its executor, so on any other
    master a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(seen: Observation, written: DataFrame, asked: list[Column]) -> dict:
    """What was counted while ``written`` was written; counted again if the report of it got lost on the way."""
    for _ in range(100):
        if seen._jo.getRowOrEmpty().isDefined():  # waits a tenth of a second
            return seen.get
    return written.agg(*asked).first().asDict()


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, which is counted while they are written."""
    seen, n = Observation(), F.count(F.lit(1)).alias("n")
    out = cut(df.observe(seen, n))
    return out, int(observed(seen, out, [n])["n"])


@dataclass
class Kept:
    """A frame of a round that was cut: ``n`` rows, ``facts`` counted on the way, ``hot`` keys."""

    df: DataFrame
    n: int
    facts: dict[str, int] = field(default_factory=dict)
    hot: list[str] = field(default_factory=list)
    hot_too: list[str] = field(default_factory=list)


class Rounds:
    """A session of its own for rounds of joins over frames that are cut each round.

    The number of tasks follows the rows of the frames, so plans are made once and not
    again at every shuffle; the caller's session keeps its settings. Rows, facts and hot
    keys are counted while a frame is written, at no further job.
    """

    def __init__(self, spark: SparkSession, rows: int) -> None:
        ensure_checkpoint_dir(spark)
        self.outer = spark
        self.usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.sized(rows)

    def sized(self, rows: int) -> None:
        """Tasks for frames of this many rows from now on."""
        self.tasks = max(1, min(self.usual, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.tasks))

    def _bound(self, df: DataFrame, spark: SparkSession) -> DataFrame:
        # a frame over the written rows, without the size estimates of the plan that made it:
        # those are multiplied at joins and have thousands of digits after some rounds
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)

    def cut(self, df: DataFrame, hot: str | None = None, hot_too: str | None = None, **facts: Column) -> Kept:
        """Writes ``df``; ``facts`` are aggregates over it, ``hot`` (``hot_too``) is SQL for a key whose hot values are wanted."""
        seen = Observation()
        asked = {"_n": F.count(F.lit(1)), **facts}
        for name, key in (("_hot", hot), ("_hot_too", hot_too)):
            if key:
                asked[name] = F.expr(f"approx_top_k({key}, {HOT_SHARE}, {20 * HOT_SHARE})")
        counted = [a.alias(k) for k, a in asked.items()]
        out = df.observe(seen, *counted).checkpoint(eager=True)
        got = observed(seen, out, counted)
        n = int(got["_n"])
        keys = [[r[0] for r in got.get(k) or [] if r[0] is not None and r[1] * HOT_SHARE > n] for k in ("_hot", "_hot_too")]
        return Kept(self._bound(out, self.spark), n, {k: int(got[k] or 0) for k in facts}, *keys)

    def enter(self, df: DataFrame, hot: str | None = None, hot_too: str | None = None, **facts: Column) -> Kept:
        """Cut of a frame of the caller's session, planned there."""
        kept = self.cut(df, hot, hot_too, **facts)
        self.sized(max(kept.n, 1))
        return kept

    def leave(self, kept: Kept) -> DataFrame:
        """The frame for the caller's session."""
        return self._bound(kept.df, self.outer)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (unique in ``key``), of whose keys those in ``hot`` hold much of ``left``.

    Their rows meet a broadcast of as many rows of ``right`` as there are hot keys (fewer
    than HOT_SHARE) and are not shuffled; all other rows are joined as usual.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return spread.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def join_dealt(left: DataFrame, right: DataFrame, key: str, hot: list[str], by: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """``left`` joined to ``right`` (any number of rows a key), of whose keys those in ``hot`` hold much of ``left``.

    Their rows are dealt over ``salts`` parts by a hash of ``by``, and each part has its own
    copy of the right rows.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int"))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_part", F.explode(parts)), [key, "_part"], how).drop("_part")
