"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretrace.session import checkpoint_dir

#: What separates words everywhere in this subpackage: ASCII white space, as bytes.split() has it.
SPACE_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: what follows starts from files
    that every executor sees, and values made up while writing (row ids) stay as they are."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns cannot clash with those of an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker, over all tasks it runs.

    Functions of this package are pickled by value, so their own module globals begin anew
    in each task.
    """
    home = sys.modules.setdefault("_wiretrace_worker", types.ModuleType("_wiretrace_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def large_object(name: str, make: Callable[[], object]) -> object:
    """As ``worker_cache``, for objects of many megabytes, of which a worker keeps one at a time.

    Workers go from one operator's tasks to the next one's, and an executor's memory holds all of
    them beside its heap.
    """
    kept = worker_cache("large", dict)
    if name not in kept:
        let_go()
        kept[name] = make()
    return kept[name]


def let_go() -> None:
    """Drop the large object that tasks of another operator have left in this worker, if any."""
    kept = worker_cache("large", dict)
    if kept:
        kept.clear()
        gc.collect()
        release()


def release() -> None:
    """Give freed memory back to the system at the end of a task. A Python worker lives on, and
    what its allocators hold would add to the memory of all that runs on the executor later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


class TwoGenerations:
    """A bounded cache: when the young part is full it becomes the old one, which is let go.

    Entries in use move to the young part again, so frequent ones stay.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` not kept; the others are in ``young`` afterwards."""
        out = []
        young, old = self.young, self.old
        if len(young) > self.most:
            self.old = old = young
            self.young = young = {}
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    young[k] = v
        return out
