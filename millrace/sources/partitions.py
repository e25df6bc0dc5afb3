"""Partitions of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables up to this size are dealt anew if they leave cores idle; larger ones have splits enough.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of files as it is, or, if it is small and has fewer files than there are cores, dealt to all of them.

    For rows that are dear to work on, as texts are; the shuffle is bounded by SMALL_BYTES.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES and len(df.inputFiles()) < cores else df


#: Bytes of a large table's files that one part has, where rows are dealt by a key.
PART_BYTES = 4 << 20


def parts_of(table: DataFrame) -> int:
    """Parts that a large table of files asks for by its size; 0 for a small one.

    They are no fewer than those of other shuffles, so that a join deals the other side alike and not this one again.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size <= PART_BYTES * 4 else max(least, -(-size // PART_BYTES))


def dealt(df: DataFrame, key: str, of: DataFrame | None = None) -> DataFrame:
    """Rows of a large table of files dealt by a key to as many parts as its size asks for; a small one's as they are.

    ``of`` is the table whose size counts, for rows that were made of it.

    What a task of the joins and aggregates by that key holds is then bounded however many rows there are: adaptive plans put
    shuffled parts together up to a size of compressed bytes, which sequential keys and equal values undercut by far.
    """
    n = parts_of(df if of is None else of)
    return df.repartition(n, key) if n else df
