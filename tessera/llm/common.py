"""What several operators of this subpackage need: tables, shards, lineage cuts, byte hashing and components of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession) -> int:
    """How many parts the data is dealt into: the session's shuffle partitions, which a cluster sets in proportion to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Without it, and without a checkpoint folder of
    the session, a temporary folder stands in on a local master (tests); a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that a lost executor costs no recomputation before
    this point. The table goes with drop_cut(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*cuts: DataFrame) -> None:
    """Removes tables written by cut() once nothing lazy reads them any more."""
    for df in cuts:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(taken: list[str], name: str, prefix: str) -> str:
    """name, or with as many prefixes as it takes not to clash with a column in taken (upper and lower case are one)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"{prefix}_{name}"
    return name


#: A key is heavy if it holds more than one in HEAVY of all rows, and more than LIGHT rows; at most HEAVY keys can be.
HEAVY, LIGHT = 1024, 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined by key with keyed, which has one row a key and in times how many of rows, total in all, hold it.

    Heavy keys (at most HEAVY rows of keyed, so a broadcast of bounded size) never gather in one task: their rows stay
    where they are. All others are joined as the optimizer likes; no key there has more than one in HEAVY of all rows."""
    keyed = cut(keyed)
    heavy = (F.col("times") * HEAVY > total) & (F.col("times") > LIGHT)
    hot, rest = keyed.where(heavy).drop("times"), keyed.where(~heavy).drop("times")
    if hot.isEmpty():
        return rows.join(rest, key)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(usual.join(rest, key))


#: Bits of a filter of ids: a fixed size, whatever their number. The fuller it is the more it lets pass.
FILTER_BITS = 23


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """A test for long ids, true for all that ids (a column of longs) holds and false for most others: what fails it needs
    no join with ids, and so need not be shuffled."""
    at = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(1 << FILTER_BITS))
    rows = ids.select(at.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit")
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    sent = ids.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda id_: held(F.pmod(F.xxhash64(id_), F.lit(1 << FILTER_BITS)))


# --- hashing of bytes in numpy -------------------------------------------------------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd multiplier and of its inverse; kept per worker and grown by doubling."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all 64 output bits (one-to-one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums P with P[e] - P[s] standing for data[s:e] times multiplier**s, and the inverse powers that take s out again."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal spans have equal hashes wherever they stand."""
    sums, down = prefix_hashes(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


# --- connected components of links ---------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id that links reach.

    Every round joins each id's neighbours to their smallest neighbour (large star, then small star), which at least
    halves the depth of the trees that it builds, until a round changes nothing; ids and links stay distributed, the
    centre of a large component is a heavy key of join_keyed(), and a round's table cuts the lineage.
    """
    edge = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    edge, before = cut(edge), None
    n = edge.count()
    while n:
        both = edge.union(edge.select("hi", "lo")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("times"))
        large = cut(join_keyed(both, low, "u", 2 * n).where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi"))
        small_low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("times"))
        joined = join_keyed(large, small_low, "hi", n)
        small = joined.select(F.col("m").alias("lo"), "hi").union(joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo < hi").distinct()
        new = cut(small)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        drop_cut(edge, large)
        edge, n = new, state[0]
        if state == before:
            break
        before = state
    lows = edge.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return edge.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(lows)
