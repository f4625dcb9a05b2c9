"""Helpers shared by the corpus operators: table access, shared storage and text normalisation."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Executors need not have this package installed: what they run is sent to them whole.
cloudpickle.register_pickle_by_value(sys.modules["trailmark"])

#: Where each stored frame that is still held has its table.
_STORED: dict[int, tuple[weakref.ref, str]] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other code point as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session, which is one process, may go without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it isn't set")
    return f"file://{tempfile.gettempdir()}/trailmark-shared"


def stored(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing twice.

    The table outlives the call, because the returned frame reads it lazily; it is deleted when the application
    ends.  ``instead_of`` is a stored frame that nothing reads any more once the new one is written; its table is
    deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    # Shuffle files go once the driver's collector finds that no plan refers to them: have it look now.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop(id(instead_of))[1])
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    made = spark.read.schema(df.schema).parquet(path)
    _STORED[id(made)] = (weakref.ref(made, lambda _, key=id(made): _STORED.pop(key, None)), path)
    return made


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose task gives the memory it freed back to the system at its end.

    A worker lives on after its task, and what its allocators keep for later counts against the executor meanwhile.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def id_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the row-wise operators read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Stands for a null id where ids are compared; it sorts below every other.
NO_ID = -(2**63)


def smallest_of_group(rows: DataFrame, keys: list[str], id_col: str, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a salt, and one row per group with its smallest id and its salts as bits.

    The map side leaves one row of a group in each task, so a hot group's winners meet without its rows; ``with_salts``
    turns the second frame into rows that join the first on salt and keys, none of which carries more than one salt's
    share of a group.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(salts)).cast("int"))
    winners = salted.groupBy(*keys).agg(F.min(id_col).alias("smallest"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    return salted, winners


def with_salts(winners: DataFrame, salts: int = 64) -> DataFrame:
    return winners.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> getbit(salts, s) = 1)"))).drop("salts")


def likely_among(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", others: bool = False, bits: int = 2**23) -> DataFrame:
    """``rows`` without most of those whose id is not among ``ids``; every row whose id is there stays.

    A filter before a join on the id: a bitmap of hashed ids, whose size is ``bits`` at most whatever is marked, is
    broadcast.  The more ids there are, the more other rows pass; which rows the join finds doesn't change.
    With ``others`` the rows that don't pass are given instead.
    """
    at, word, held = unused(rows, "__place", "__word", "__bits")
    place = F.pmod(F.xxhash64(F.lit(53), F.col(id_col).cast("long")), F.lit(bits))
    bit = F.col(at).bitwiseAND(63).cast("int")
    marked = ids.select(place.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(held))
    tried = rows.withColumn(at, place).withColumn(word, F.shiftright(at, 6))
    found = tried.join(F.broadcast(marked), word, "left") if others else tried.join(F.broadcast(marked), word)
    passed = F.coalesce(F.getbit(held, bit), F.lit(0)) == (0 if others else 1)
    return found.filter(passed | F.col(id_col).isNull() if others else passed).select(*rows.columns)
