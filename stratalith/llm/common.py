"""What the training-data operators share: tables, lineage cuts, line keys and row keys."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint(df: DataFrame) -> str | None:
    """The folder of a table that cut() made."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    found = plan.rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if (path := _checkpoint(out)) and (scopes := _scopes.get()):
        scopes[-1].append(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that cut() made. What was computed from them must have been written or cut itself."""
    for t in tables:
        if path := _checkpoint(t):
            remove(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() makes inside are removed at the end; results must have been written by then."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            remove(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_parts(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Shuffle partitions: the session's, or more if df's size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    set_to = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(set_to, min(100_000, size // bytes_each)) if size < 1 << 55 else set_to


def ids_unique(df: DataFrame, name: str) -> bool:
    """Whether no value of the column stands in two rows; reads that column only."""
    return df.groupBy(name).count().filter("count > 1").isEmpty()


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers live on between tasks, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps the memory for the next task


#: Caches of a worker that outlive a task, by operator: how to empty each.
_caches: dict[str, Callable[[], None]] = {}


def outlives(name: str, clear: Callable[[], None]) -> None:
    _caches[name] = clear


def tidy(each: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back when it ends, and before it begins empties the caches that other operators left in its worker."""

    @functools.wraps(each)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in _caches if k != name]:
            _caches.pop(other)()
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed(text: Column) -> list[Column]:
    """96 bits: enough that 10^12 keys meet by chance with a probability under 10^-4."""
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def with_lines(docs: DataFrame, least: int, *more: str) -> DataFrame:
    """The columns named in more, th (the text's hash) and, line by line, h1, h2 (hashes of the keys) and n (their lengths; -1 below least)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    keys = F.transform(lines, lambda k: F.struct(*hashed(k), F.when(F.length(k) >= least, F.length(k)).otherwise(-1).alias("n")))
    each = docs.select(*more, F.xxhash64("text").alias("th"), keys.alias("k"))
    return each.select(*more, "th", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), F.col("k.n").alias("n"))


def hashed_lines(docs: DataFrame, least: int, *more: str) -> DataFrame:
    """with_lines() as a table, of 16 bytes a line: what counts keys and what looks for them read it instead of the texts."""
    return cut(with_lines(docs, least, *more))


def keys_once(lines: DataFrame, *more: str) -> DataFrame:
    """h1, h2 of each row's distinct keys, for hashed_lines."""
    zipped = F.filter(F.arrays_zip("h1", "h2", "n"), lambda k: k["n"] >= 0)
    return lines.select(*more, F.inline(F.array_distinct(F.transform(zipped, lambda k: F.struct(k["h1"], k["h2"])))))


def keys_placed(lines: DataFrame, *more: str) -> DataFrame:
    """pos, h1, h2, n for each line that has a key, for hashed_lines."""
    placed = lines.select(*more, F.posexplode(F.arrays_zip("h1", "h2", "n")).alias("pos", "k")).filter("k.n >= 0")
    return placed.select(*more, "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), F.col("k.n").cast("long").alias("n"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until none of the taken ones is equal to it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns; nulls equal each other."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out
