"""What several operators of this subpackage use: checkpoint folder, 64-bit word hashing in numpy."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: White space of the word contracts: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of this machine; a cluster raises."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-"))
    return jsc.getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them from there: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the rows that ``saved`` wrote for this very DataFrame, once nothing reads them any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (public-domain splitmix finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


#: Spans of more bytes are hashed by BLAKE2b, one by one.
LONG_SPAN = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every data[start:end] (uint8); other seeds give unrelated hashes.

    Eight bytes a round, each round scrambled before the next: spans of equal length up to eight bytes never collide, and no
    pattern of letters cancels itself out, as it would in a polynomial modulo 2**64.
    """
    length = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    h = mix64(length.astype(U) + U((seed * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    long = length > LONG_SPAN
    live, at, left = None, start, np.where(long, 0, length) if long.any() else length
    while True:
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix64(h ^ part)
            live = np.flatnonzero(left > 8)
            at, left = at[live], left[live]
        else:
            h[live] = mix64(h[live] ^ part)
            more = left > 8
            live, at, left = live[more], at[more], left[more]
        at, left = at + 8, left - 8
        if not len(live):
            break
    for i in np.flatnonzero(long).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: the bytes, starts and ends of all words, and each text's number of words."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    text_end = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, text_end)
    return data, start, end, np.diff(np.concatenate(([0], upto)))


def rolling(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes, a sum with independent odd factors; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(seed & 0xFFFFFFFFFFFFFFFF))
    factor = (seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF
    for j in range(k):
        factor = (factor * 0x5851F42D4C957F2D + 0x14057B7EF767814E) & 0xFFFFFFFFFFFFFFFF
        total += words[j : j + n] * U(factor | 1)
    return mix64(total)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b).

    Labels are lowered to the least of the neighbours' and then to the label's own label, which halves
    long paths; each round is written to the checkpoint folder. Only the count of changed labels
    reaches the driver.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = saved(lower.join(target, "low").select("node", F.least("low", "far").alias("component"), "was"))
        forget(labels)
        labels = new
        if labels.where("component <> was").isEmpty():
            forget(edges)
            return labels.select("node", "component")
