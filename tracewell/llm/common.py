"""What the training-data operators share: scratch tables, words, table readers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves every other byte (so UTF-8 stays valid).
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8. bytes.split() splits at exactly the six ASCII blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named _c0, _c1, ... by place, and the new name of each old one: nothing an operator adds clashes."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, only a local session gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder with the driver")
        where = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scratch: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; deleted when the driver's Python ends, or with the ``scratch_scope`` it was made in."""
    path = f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_delete, None)
    _scratch[path] = spark
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


def _delete(paths: list[str] | None) -> None:
    for path in list(_scratch) if paths is None else paths:
        if (spark := _scratch.pop(path, None)) is None:
            continue
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Scratch tables made inside are deleted at its end; what is to stay is made with ``materialize(..., stays=True)``."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(made)


#: Tables whose rows are megabytes: a writer looks at its size after each row, and a reader, which takes up to 4096 rows or a
#: row group at once, holds this much.
WIDE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, name: str, stays: bool = False, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, a lost executor costs nothing written.

    ``wide``: rows are large, see ``WIDE``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if stays and (made := _scope.get()) is not None:
        made.remove(path)
    schema = df.schema
    df.write.options(**WIDE if wide else {}).option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    _delete([_paths[df]])
