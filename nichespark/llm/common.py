"""Shared pieces: durable tables, Arrow helpers, word hashing and connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

# --- session ---------------------------------------------------------------------------------


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when neither PYTHONPATH nor the working folder holds it."""
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in known or os.getcwd() == ROOT or getattr(spark.sparkContext, "_nichespark_shipped", False):
        return
    if os.path.isdir(f"{os.getcwd()}/nichespark"):
        return
    out = os.path.join(tempfile.mkdtemp(), "nichespark_py.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in Path(ROOT, "nichespark").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(out)
    spark.sparkContext._nichespark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_nichespark_dir", None)
    if own is None:
        own = spark.sparkContext._nichespark_dir = tempfile.mkdtemp(prefix="nichespark-")
    return own


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nichespark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a durable table that nothing reads any more."""
    path = getattr(df, "_nichespark_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Keys joined by broadcast in `lookup`: so many at most, of more than so many rows each.
HOT_KEYS, HOT_ROWS = 1000, 20_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has at most one row for a key; left is read twice and should be a stored table.

    The rows of the HOT_KEYS most frequent keys of left stay where they are and get right's rows for
    these keys (at most HOT_KEYS) by broadcast. The others are shuffled: no key is left that holds more
    than a HOT_KEYS-th of all rows, unless it has no more than `least`.
    """
    top = left.groupBy(*keys).count().where(F.col("count") > least).orderBy(F.desc("count")).limit(HOT_KEYS).drop("count").collect()
    if not top:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in top], left.select(*keys).schema).withColumn("__hot", F.lit(True)))
    marked = left.join(hot, keys, "left")
    some = F.broadcast(right.join(hot.drop("__hot"), keys, "left_semi"))
    return marked.where("__hot").drop("__hot").join(some, keys, how).unionByName(marked.where("__hot is null").drop("__hot").join(right, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator is about to write (names compare without case)."""
    drop = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in drop]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of text in all rows (one narrow pass)."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def scaled(total: int, least: int, power: float, unit: int = 1 << 30) -> int:
    """A block size that is `least` up to `unit` bytes of input and then grows with the given power of it."""
    return int(least * max(1.0, total / unit) ** power)


# --- Arrow -----------------------------------------------------------------------------------


def text_array(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A contiguous binary array (int64 offsets) without nulls; null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    return col.fill_null("").cast(pa.large_binary())


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array; offsets start at 0."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 20):
    """Ranges of rows that hold about `limit` bytes each; a longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _differs(a: np.ndarray) -> bool:
    return a.dtype.kind in "iu" and a.dtype != np.uint32 and len(a) > 0


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; whole numbers, uint32 apart, are stored as differences."""
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = np.diff(a, prepend=a.dtype.type(0)) if _differs(a) else a
        planes = raw.view(np.uint8).reshape(len(a), a.itemsize).T  # equal bytes of the numbers side by side
        body.append(a.dtype.str.encode().ljust(8) + zstandard.compress(planes.tobytes(), 1))
    return np.array([len(arrays), *map(len, body)], np.int64).tobytes() + b"".join(body)


def thaw(value: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(value[:8], np.int64)[0])
    size, at, out = np.frombuffer(value[8 : 8 + 8 * n], np.int64), 8 + 8 * n, []
    for s in size:
        part = value[at : at + int(s)]
        at += int(s)
        dtype = np.dtype(part[:8].decode().strip())
        planes = np.frombuffer(zstandard.decompress(part[8:]), np.uint8)
        a = np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)
        out.append(np.cumsum(a, dtype=dtype) if _differs(a) else a)
    return out


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on after a task and are used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """A function on batches that tidies up when its task ends."""

    def and_then(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return and_then


def _and_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


# --- words and rolling hashes ----------------------------------------------------------------

#: Space and \x09-\x0D end a word; every other byte belongs to one.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) * 8 + 5 for x in _rng.integers(2**40, 2**60, 4))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _BASES[which] % 2**64
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > 1 << 23:  # a very long text: don't keep its tables
            _powers.pop(which)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, by prefix sums."""
    up, down = powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of each row; off are the rows' offsets into data."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


#: From the first to the last letter or digit, in time linear in the text (an anchored class at its end takes the square).
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


def bare(token: str) -> str:
    """The token in lower case without what isn't a letter or digit at its ends."""
    core = _CORE.search(token.lower())
    return core.group(0) if core else ""


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(_BYTE[data], starts, ends, 0)


def gram_hashes(h: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hashes of h[i:i+n] for i in 0..len(h)-n."""
    i = np.arange(max(0, len(h) - n + 1))
    return spans_hash(h, i, i + n, which)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """h, as a fraction of 2**64, in n equal ranges (sorted h gives sorted buckets)."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def in_sorted(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


# --- connected components --------------------------------------------------------------------


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node reachable by the given links (in memory; for one bucket)."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component): for every linked node the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) over a link table that stays
    distributed; each round's table is written to the shared folder and the one before deleted. The
    links of nodes with many of them are joined where they lie (`lookup`). Nodes without links are absent.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = durable(e, "links")

    def stamp(t: DataFrame):
        """(links, a hash of all, links of the node with the most)"""
        ends = t.select(F.explode(F.array("u", "v")).alias("x"), F.when(F.col("x") == F.col("u"), F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.count("h").alias("own")).agg(F.sum("own"), F.sum("h"), F.max("n")).first()

    def joined(left: DataFrame, low: DataFrame, most: int) -> DataFrame:
        return lookup(left, low, ["u"], least=hot_rows) if most > hot_rows else left.join(low, "u")

    seen = stamp(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, low, seen[2]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = joined(large, low, seen[2])
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        old, e = e, durable(small, "links")
        discard(old)
        now = stamp(e)
        if tuple(now)[:2] == tuple(seen)[:2]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def keep_one(docs: DataFrame, near: DataFrame, id_col: str) -> DataFrame:
    """docs without those whose id isn't its component in near (id_col, component; a row for each of docs).

    Of rows that repeat an id which stays, the first by their columns as JSON text is kept; rows with a null id all stay.
    """
    ids = F.col(f"`{id_col}`")
    near = near.where(ids.isNotNull()).groupBy(ids).agg(F.max(ids != F.col("component")).alias("__gone"), F.count("*").alias("__rows"))
    fate = durable(near.where("__gone or __rows > 1").select(ids, "__gone"), "fate")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    alone = docs.join(fate, id_col, "left_anti").select(*cols)
    row = F.struct(*cols)
    again = docs.join(fate.where("not __gone"), id_col, "left_semi").groupBy(ids.alias("__id")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return alone.unionByName(again.select("__row.*"))
