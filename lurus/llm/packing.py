"""Problem 8: containers of fixed capacity, filled by bounded-space online packing.

Each task keeps at most OPEN containers open. An item goes to the open one where it leaves least room; where none fits, a new one is opened, and if OPEN
are open already the fullest is closed first. What is still open when a task ends is merged: those containers are items of the next round, which has a
sixteenth of the tasks, until one task merges the last OPEN * 16. An item beyond the capacity is cut into full containers, its rest is an ordinary item.

Defined results: items of size zero or null need no container (bin is null); the containers depend on the partitioning, their contents never exceed
the capacity and no item at or below it is cut; empty tables give no containers; repeated ids are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.operators.resources import small
from lurus.plans.session import checkpointed, importable

CAPACITY, OPEN, FAN_IN = 2048, 64, 16


class Packer:
    """Open containers, ordered by the room they have left."""

    def __init__(self, capacity: int, open_: int, first: int) -> None:
        self.capacity, self.open, self.next, self.rooms = capacity, open_, first, []

    def place(self, size: int) -> int:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, bin_ = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.open:
                self.rooms.pop(0)
            room, bin_ = self.capacity, self.next
            self.next += 1
        if room > size:
            insort(self.rooms, (room - size, bin_))
        return bin_


def _pack(capacity: int, open_: int, level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, open_, (level << 56) | (TaskContext.get().partitionId() << 32))
        for batch in batches:
            items, piece, sizes, bins = [], [], [], []
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                while size is not None and size > capacity:
                    items.append(item), piece.append(n), sizes.append(capacity), bins.append(packer.next)
                    packer.next += 1
                    size, n = size - capacity, n + 1
                items.append(item), piece.append(n), sizes.append(size or 0), bins.append(packer.place(size) if size else None)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(piece, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.int64()), pa.nulls(len(items), pa.int64())], names=["item", "piece", "size", "bin", "fill"])
        rest = packer.rooms
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64())] * 3 + [pa.array([b for _, b in rest], pa.int64()), pa.array([capacity - r for r, _ in rest], pa.int64())], names=["item", "piece", "size", "bin", "fill"])

    return pack


PACKED = "item long, piece long, size long, bin long, fill long"


def pack_items(items: DataFrame, capacity: int = CAPACITY, open_: int = OPEN) -> DataFrame:
    """(item, piece, size, bin) of (item, size)."""
    importable(items.sparkSession)
    packed = checkpointed(items.select(F.col("item").cast("long"), F.col("size").cast("long")).mapInArrow(_pack(capacity, open_, 0), PACKED))
    parts = packed.rdd.getNumPartitions()
    left = packed.where("fill is not null").select("bin", "fill")
    moves = []
    level = 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = checkpointed(left.select(F.col("bin").alias("item"), F.col("fill").alias("size")).repartition(parts).mapInArrow(_pack(capacity, open_, level), PACKED))
        moves.append(merged.where("fill is null").select(F.col("item").alias("from"), F.col("bin").alias("to")))
        left = merged.where("fill is not null").select("bin", "fill")
        level += 1
    out = packed.where("fill is null").select("item", "piece", "size", "bin")
    if not moves:
        return out
    # a container may be merged again and again: the chain of its moves is closed first, among the few containers that were left open
    chain = moves[0]
    for move in moves[1:]:
        chain = chain.join(move.toDF("to", "next"), "to", "left").select("from", F.coalesce("next", "to").alias("to"))
    chain = small(checkpointed(chain))
    return out.join(chain, out["bin"] == chain["from"], "left").select("item", "piece", "size", F.coalesce("to", "bin").alias("bin"))
