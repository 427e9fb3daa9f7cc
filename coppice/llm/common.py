"""Helpers that the operators share: shared scratch tables, bounded batches of
text, hashes that Spark and DuckDB compute alike."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: White space as the contracts fix it: the ASCII space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"

#: Above this many ids a semi-join is left to the planner instead of a broadcast
#: (8 bytes an id: at most some tens of MB in every executor).
BROADCAST_IDS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when Python ends.

    Only where that setting is absent and all of Spark is on this machine (tests) is
    a local temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone before Python ends
        pass


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and
    a lost executor costs no recomputation of what came before."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Semi-join on ``ids`` (distinct, one column ``on``): broadcast if counted to
    be small, a shuffled join otherwise."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``m``; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % m


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ':'; null reads as
    the empty string. 52 bits, so the double is exact in any engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType())}


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(name, _KINDS[kind]) for name, kind in kinds.items()]])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text
    (a longer text stands alone) and hand out the texts as Python strings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = room = 0
        for i, n in enumerate(sizes):
            if i > start and room + n > limit:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, room = i, 0
            room += n
        part = batch.slice(start)
        yield part, part.column(column).to_pylist()


#: Rows and bytes that Arrow moves at once between the JVM and Python, which both hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, if they aren't already: texts are long,
    and buffers of the size of a batch stay allocated on both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = spark.conf.get(key)
        except Exception:  # this Spark has no such bound
            continue
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return what this worker has freed to the system; it idles with it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def mapped(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, list], list[pa.Array]], keep_text: bool = True, **kinds: str) -> DataFrame:
    """``df`` with the columns ``kinds`` that ``work`` gives for runs of rows, from
    their ``text`` as Python strings. Columns of ``df`` with these names are
    replaced; others may have any names, dots and repeated ones included."""
    own = df.drop(*kinds)
    names = own.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())
    plain = own.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    keep = [i for i in range(len(names)) if keep_text or i != at]
    schema = extended(plain.select(*[f"c{i}" for i in keep]), **{f"r{i}": k for i, k in enumerate(kinds.values())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, f"c{at}"):
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *work(part, texts)], names=schema.names)
        give_back()

    small_batches(df.sparkSession)
    return plain.mapInArrow(run, schema).toDF(*[names[i] for i in keep], *kinds)


_held: list = [None, None]


def held(key, make: Callable[[], object]):
    """The one thing that this Python worker keeps between tasks. When another key
    asks, the former is let go first: stages that follow each other in a reused
    worker don't add up."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


class Words:
    """Values by word, bounded in bytes: of two generations the older is dropped when
    the younger is full. What a run of texts asks for stays at hand until the next."""

    def __init__(self, room: int = 24 << 20, value_bytes: int = 32):
        self.room, self.value_bytes = room // 2, value_bytes + 140
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def missing(self, words: set[str]) -> list[str]:
        """The words to be put; all others are in ``young`` from here on."""
        if self.size > self.room:
            self.old, self.young, self.size = self.young, {}, 0
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                    self.size += len(w) + self.value_bytes
                else:
                    new.append(w)
        return new

    def put(self, words: list[str], values: list) -> None:
        self.young.update(zip(words, values))
        self.size += sum(map(len, words)) + self.value_bytes * len(words)
