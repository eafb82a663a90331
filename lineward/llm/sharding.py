"""Shards of nearly equal size that keep equal texts together.

The groups of equal texts stand in the order of their fingerprint, which spreads sizes evenly. The
smallest capacity with which the ordered groups fit into the shards one after another is found by
binary search; each capacity is checked greedily. The groups themselves never reach the driver. It
sees the sizes of at most a few ten thousand runs of groups (all fingerprints with a common beginning)
and asks for a finer division only of the runs in which a cut can fall, until these are single groups.

Null and empty texts are equal. An empty table gives an empty result; fewer groups than shards leave
shards empty. A group larger than an even share fills a shard alone and sets the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineward.llm.common import written

# A row of any text costs this many bytes beside its text.
ROW_BYTES = 8
# Hexadecimal digits of the fingerprint: of the first runs, and added by each finer division.
FIRST_DIGITS = 4
MORE_DIGITS = 2
# Rows of a shard are numbered in cells: fingerprints with these digits in common, times the salts
# that split one large group of equal texts.
CELL_DIGITS = 3
CELL_SALTS = 16


def sized(docs: DataFrame) -> DataFrame:
    """Per document its id, size, checksum and the fingerprint of its text; the text stays behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"),
    )


class Runs:
    """Ordered runs of groups on the driver: where each begins, ends, and whether it is one group."""

    def __init__(self, rows: list[tuple[str, int, bool]]):
        rows = sorted(rows)
        self.rows = rows
        self.starts = [0, *accumulate(r[1] for r in rows)]
        self.total = self.starts[-1]

    def landing(self, position: int) -> int:
        """The run that ``position`` falls into, or -1 at a bound of runs."""
        i = bisect_right(self.starts, position) - 1
        return -1 if self.starts[i] == position or i >= len(self.rows) else i

    def reach(self, start: int, capacity: int, whole_runs: bool) -> int:
        """How far one shard gets from ``start``; within a run of several groups only if not ``whole_runs``."""
        aim = min(start + capacity, self.total)
        run = self.landing(aim)
        if run < 0 or not (whole_runs or self.rows[run][2]):
            return aim
        return max(self.starts[run], start)

    def cuts(self, capacity: int, shards: int, whole_runs: bool) -> list[int]:
        """Greedy filling: the end of each shard."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, whole_runs)
            ends.append(at)
        return ends

    def least(self, shards: int, whole_runs: bool) -> int:
        """The smallest capacity with which ``shards`` shards take everything."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, whole_runs)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even_cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Cuts within ``capacity``, each as near to an even share of the rest as that allows, and the runs
        that a finer division would have to split to place them exactly."""
        split: set[int] = set()

        def near(position: int) -> None:
            run = self.landing(position)
            if run >= 0 and not self.rows[run][2]:
                split.add(run)

        latest = [self.total]
        for _ in range(shards - 1):  # from the end: where the remaining shards have to begin at least
            aim = max(latest[-1] - capacity, 0)
            near(aim)
            latest.append(self.starts[bisect_left(self.starts, aim)])
        least = latest[::-1]
        ends, at = [], 0
        for left in range(shards, 0, -1):
            low, high = least[shards - left], min(at + capacity, self.total)
            near(high)
            aim = min(max(at + round((self.total - at) / left), low), high)
            near(aim)
            i = bisect_right(self.starts, aim) - 1
            below = self.starts[i]
            above = self.starts[min(i + 1, len(self.rows))]
            best = above if above <= high and above - aim < aim - below or below < max(low, at) else below
            ends.append(best)
            at = best
        return ends, split


def _runs_of(rows: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    run = F.substring("text_key", 1, digits)
    found = rows.groupBy(run.alias("run")).agg(
        F.sum("size").alias("size"), (F.min("text_key") == F.max("text_key")).alias("single")
    )
    return [(r["run"], r["size"], r["single"]) for r in found.collect()]


def bounds(rows: DataFrame, shards: int) -> list[str]:
    """Where every shard but the first begins: a beginning of a fingerprint, or '~' after the last."""
    runs = Runs(_runs_of(rows, FIRST_DIGITS))
    if not runs.rows:
        return ["~"] * (shards - 1)
    while True:
        low, high = runs.least(shards, False), runs.least(shards, True)
        nearest, farthest = runs.cuts(low, shards, True), runs.cuts(high, shards, False)
        split = set()
        if low < high:
            for a, b in zip(nearest, farthest):
                first = max(bisect_right(runs.starts, a) - 1, 0)
                last = min(bisect_left(runs.starts, b), len(runs.rows))
                split |= {i for i in range(first, last) if not runs.rows[i][2]}
        else:
            ends, split = runs.even_cuts(low, shards)
        if not split:
            break
        finer = [
            row
            for digits in sorted({len(runs.rows[i][0]) for i in split})
            for row in _runs_of(
                rows.where(
                    F.substring("text_key", 1, digits).isin(
                        [runs.rows[i][0] for i in split if len(runs.rows[i][0]) == digits]
                    )
                ),
                digits + MORE_DIGITS,
            )
        ]
        runs = Runs([r for i, r in enumerate(runs.rows) if i not in split] + finer)
    begin = {start: row[0] for start, row in zip(runs.starts, runs.rows)}
    return [begin.get(end, "~") for end in ends[:-1]]


def _shard(begins: list[str]) -> Column:
    shard = F.lit(0)
    for begin in begins:
        shard = shard + (F.col("text_key") >= begin).cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document with its size, checksum, shard and slot; equal texts share a shard.

    Slots count the rows of a shard from 0 without a gap: cells of a shard are counted first, and a row
    is numbered within its cell, so that no task holds a shard or a large group.
    """
    rows = written(sized(docs), "sized")
    rows = rows.withColumns(
        {
            "shard": _shard(bounds(rows, shards)),
            "cell": F.substring("text_key", 1, CELL_DIGITS),
            "salt": F.pmod(F.xxhash64("doc_id"), F.lit(CELL_SALTS)),
        }
    )
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("shard", "cell", "salt")
        .count()
        .select(
            F.col("shard").alias("c_shard"),
            F.col("cell").alias("c_cell"),
            F.col("salt").alias("c_salt"),
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"),
        )
    )
    within = Window.partitionBy("shard", "cell", "salt").orderBy("text_key", "doc_id")
    numbered = rows.withColumn("place", F.row_number().over(within))
    # At most 16^CELL_DIGITS * CELL_SALTS + shards * CELL_SALTS cells, whatever the number of rows.
    placed = numbered.join(
        F.broadcast(cells),
        (F.col("shard") == F.col("c_shard"))
        & (F.col("cell") == F.col("c_cell"))
        & (F.col("salt") == F.col("c_salt")),
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
