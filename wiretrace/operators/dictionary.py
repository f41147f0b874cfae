"""Names of numbers, looked up in one dictionary per distinct set of constants.

Captures of one browser build have the same constants. Joining rows with the names of each
capture, by capture and number, would shuffle all rows on very uneven keys and repeat the names
for every capture. Here each distinct set of names is one row that holds a map; rows take it
along from a table of a few builds and look their numbers up in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

NAMES = "__names"
_ID = "__dictionary"


def owners(enums: DataFrame) -> DataFrame:
    """capture_id and the id of its set of names.

    The id is made of the number of entries and two sums of hashes, which merge in fixed width
    before the shuffle. Captures with the same names have the same id; that others share it
    takes a collision of both hash sums.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "enum", "name", "id").cast("decimal(20,0)"))
    return enums.groupBy("capture_id").agg(F.concat_ws(":", F.count(F.lit(1)), mark(1), mark(2)).alias(_ID))


def dictionaries(enums: DataFrame, owned: DataFrame) -> DataFrame:
    """One row per set of names: a map from enum to its names by number (sorted, as several may
    share one) and its flags in name order. Only one capture of each set is read further; its few
    thousand entries stay in one place for all three steps."""
    one = owned.groupBy(_ID).agg(F.min("capture_id").alias("capture_id"))
    by_id = enums.join(one, "capture_id").repartition(_ID).groupBy(_ID, "enum", "id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    by_enum = by_id.groupBy(_ID, "enum").agg(F.map_from_entries(F.collect_list(F.struct("id", "names"))).alias("ids"))
    flags = F.flatten(
        F.transform(F.map_entries("ids"), lambda e: F.transform(e["value"], lambda n: F.struct(n.alias("name"), e["key"].alias("id"))))
    )
    known = F.struct("ids", F.sort_array(flags).alias("flags"))
    return by_enum.groupBy(_ID).agg(F.map_from_entries(F.collect_list(F.struct("enum", known))).alias(NAMES))


def with_names(rows: DataFrame, enums: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Add the map of the ``wanted`` enums to ``rows`` for ``first_name``, ``last_name`` and
    ``flags``; drop it with ``drop(NAMES)``. A capture without names has NULL there.

    Both small tables are stored first, so that Spark knows their bytes and sends them to all
    tasks only below its own threshold. Entries without a name or number are left out.
    """
    entries = enums.where(F.col("enum").isin(*wanted)).select("capture_id", "enum", "name", F.col("id").cast("bigint").alias("id"))
    entries = entries.dropna()
    owned = stored(owners(entries), "owners")
    names = stored(dictionaries(entries, owned), "dictionaries")
    return rows.join(owned, "capture_id", "left").join(names, _ID, "left").drop(_ID)


def _names(enum: Column, code: Column) -> Column:
    return F.col(NAMES)[enum]["ids"][code.cast("bigint")]


def first_name(enum: Column, code: Column) -> Column:
    """The first name of a number in sorted order; NULL when there is none."""
    return F.element_at(_names(enum, code), 1)


def last_name(enum: Column, code: Column) -> Column:
    """The last name of a number in sorted order; NULL when there is none."""
    return F.element_at(_names(enum, code), -1)


def flags(enum: Column) -> Column:
    """All names of an enum with their numbers, in name order."""
    return F.col(NAMES)[enum]["flags"]
