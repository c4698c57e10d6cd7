"""Groups of any size as bounded pairs of blocks.

A group (an inverted list, a trie node) may hold a third of all rows, so it never reaches a task whole: its members are dealt
into blocks, and a task sees two blocks at a time. Members of n blocks take part in n pairs of blocks each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def block_pairs(member: Column, blocks: Column) -> Column:
    """Array of ``struct(i, j, side)`` to explode: the pairs of blocks i <= j that a member (hashed to a block) takes part in."""
    own = F.pmod(F.xxhash64(member, F.lit(17)), blocks.cast("long")).cast("int")
    return F.transform(
        F.sequence(F.lit(0), (blocks - 1).cast("int")),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own <= other, 0).otherwise(1).alias("side")),
    )


def sided_pairs(member: Column, home: Column, others: Column, homes: Column) -> Column:
    """As block_pairs, for a group of which the members at home need no comparison with each other.

    The others are dealt into blocks 0 to others - 1, those at home into the homes blocks after them; pairs have at least one block
    of others. Without others there is none.
    """
    spread = F.xxhash64(member, F.lit(17))
    own = F.when(home, others + F.pmod(spread, F.greatest(homes, F.lit(1)).cast("long"))).otherwise(F.pmod(spread, F.greatest(others, F.lit(1)).cast("long"))).cast("int")
    last = F.when(home, others - 1).otherwise(others + homes - 1).cast("int")
    partners = F.when(others > 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(partners, lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own <= other, 0).otherwise(1).alias("side")))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], list]) -> Iterator:
    """Apply work to each run of rows with equal keys of a partition sorted by them; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held:
                yield from work(pa.Table.from_batches(held))
            held, begin = [], int(cut)
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield from work(pa.Table.from_batches(held))


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]
