"""Extension: the log's head kept up to date over a stream of records.

The state is the log's frontier: the roots of the complete subtrees that its entries make up, one for each binary digit
of its size. A batch brings its own; merging both costs a number of hashes that follows the number of levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merkle
from ..operators.components import settled

Peak = tuple[int, int, bytes]  # level, idx, hash


def _joined(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def complete_subtrees(leaves: DataFrame, first: int, size: int) -> list[Peak]:
    """Roots of the largest complete subtrees of entries first to first + size - 1; at most two for each level."""
    nodes, peaks, low, high = leaves.select("idx", "hash"), [], first, first + size
    level = 0
    while low < high:
        single = [i for i in ([low] if low % 2 else []) + ([high - 1] if high % 2 and high - 1 >= low else [])]
        if single:
            peaks += [(level, r["idx"], bytes(r["hash"])) for r in nodes.where(F.col("idx").isin(single)).collect()]
        low, high = -(-low // 2), high // 2
        pair = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        nodes = nodes.groupBy(F.shiftright("idx", 1).alias("idx")).agg(pair.alias("p")).where(F.size("p") == 2)
        nodes = settled(nodes.select("idx", merkle.node(F.col("p")[0]["hash"], F.col("p")[1]["hash"]).alias("hash")))
        level += 1
    return sorted(set(peaks), key=lambda p: p[1] << p[0])


class Frontier:
    def __init__(self, peaks: list[Peak] | None = None) -> None:
        self.peaks = peaks or []

    @property
    def size(self) -> int:
        return sum(1 << level for level, _, _ in self.peaks)

    def extend(self, peaks: list[Peak]) -> None:
        for peak in peaks:
            self.peaks.append(peak)
            while len(self.peaks) > 1 and self.peaks[-2][0] == self.peaks[-1][0] and self.peaks[-2][1] % 2 == 0:
                (level, idx, left), (_, _, right) = self.peaks[-2:]
                self.peaks[-2:] = [(level + 1, idx // 2, _joined(left, right))]

    def root(self) -> str:
        if not self.peaks:
            return merkle.EMPTY_ROOT
        out = self.peaks[-1][2]
        for _, _, left in reversed(self.peaks[:-1]):
            out = _joined(left, out)
        return out.hex()


def appender(path: str, frontier: Frontier, told: Callable[[int, int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: log a batch's records (id, digest, unix_time) under path, each batch's lines in a folder of its
    own, so that a repeated batch replaces itself. One writer."""

    def append(batch: DataFrame, number: int) -> None:
        first = frontier.size
        lines = settled(merkle.log_of(batch).withColumn("idx", F.col("idx") + first))
        n = lines.count()
        if n:
            lines.write.mode("overwrite").parquet(f"{path}/batch={number}")
            frontier.extend(complete_subtrees(merkle.leaves(lines), first, n))
        if told:
            told(number, frontier.size, frontier.root())

    return append
