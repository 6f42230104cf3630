"""Filling containers of fixed capacity, by pattern packing with non-negative least squares.

Sizes are summed up in a histogram, which has at most ``capacity`` bars whatever the number of items.
On the driver, few-item patterns of binned sizes that fill a container are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is
packed best-fit decreasing into the gaps, again bar by bar.  The result is a plan: ranges of ranks
within a size go to ranges of containers.  Items get their rank within their size by distributed
running counts and look their container up in the plan, whose length is bounded by the number of bars
and patterns, not by the number of items.

Defined results: items of size 0 (null and empty texts) go to no container; an item above the capacity
is cut into parts of the capacity and a rest; equal sizes are ranked by hash and key; copies of an item
with the same key count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.llm.ranks import parts_for, running
from loomsheet.session import checkpoint

CAPACITY = 2_048
#: bins of sizes for the patterns, and items in a pattern
BINS, MOST = 64, 4


def patterns(bins: int = BINS, most: int = MOST) -> np.ndarray:
    """All multisets of at most ``most`` bins that fill a container to the last bin, as counts by bin (rows)."""
    rows = []
    for n in range(1, most + 1):
        for head in combinations_with_replacement(range(1, bins + 1), n - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                row = np.zeros(bins, np.int16)
                for b in (*head, last):
                    row[b - 1] += 1
                rows.append(row)
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method: columns of ``a`` enter by gradient, leave at zero."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            columns = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[columns] = z
                break
            old = x[columns]
            low = z <= 1e-12
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[columns] = old + step * (z - old)
            drop = columns[x[columns] <= 1e-12]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


class Plan:
    """Ranges of ranks by size and the containers they go to."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.containers = 0
        self.moves: list[tuple[int, int, int, int]] = []  # size, first rank, items, first container
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of containers (first, number)

    def _free(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            self.gaps.setdefault(gap, []).append((first, number))


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, most: int = MOST) -> Plan:
    """A plan for ``histogram`` (size -> items, sizes from 1 to ``capacity``)."""
    plan = Plan(capacity)
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    width = -(-capacity // bins)
    sizes_in: list[list[int]] = [[] for _ in range(bins + 1)]
    for size in sorted(left, reverse=True):
        sizes_in[-(-size // width)].append(size)

    def take(bin_: int, number: int) -> Iterator[tuple[int, int, int]]:
        """Up to ``number`` items of a bin, largest first: (size, first rank, items)."""
        own = sizes_in[bin_]
        while number and own:
            size = own[0]
            n = min(number, left[size])
            rank = used[size]
            used[size] += n
            left[size] -= n
            number -= n
            if not left[size]:
                own.pop(0)
            yield size, rank, n

    table = patterns(bins, most)
    bars = np.array([sum(left[s] for s in sizes_in[b]) for b in range(1, bins + 1)], float)
    fill = nnls(table.T.astype(float), bars)
    for j in np.argsort(-fill):
        number = int(fill[j])
        for b in np.flatnonzero(table[j]):
            number = min(number, sum(left[s] for s in sizes_in[b + 1]) // int(table[j][b]))
        if number < 1:
            continue
        first = plan.containers
        plan.containers += number
        room = [(first, number, capacity)]  # ranges of the pattern's containers that have the same gap
        for b in np.flatnonzero(table[j]):
            for _ in range(int(table[j][b])):
                after = []
                supply = take(int(b) + 1, number)
                size = rank = n = 0
                for start, many, gap in room:
                    while many:
                        if not n:
                            size, rank, n = next(supply)
                        k = min(n, many)
                        plan.moves.append((size, rank, k, start))
                        after.append((start, k, gap - size))
                        start, many, rank, n = start + k, many - k, rank + k, n - k
                room = after
        for start, many, gap in room:
            plan._free(gap, start, many)
    for size in sorted(left, reverse=True):  # best fit, decreasing
        rank, number = used[size], left[size]
        for gap in sorted(g for g in plan.gaps if g >= size):
            while number and plan.gaps.get(gap):
                first, many = plan.gaps[gap].pop()
                k = min(many, number)
                plan.moves.append((size, rank, k, first))
                plan._free(gap, first + k, many - k)
                plan._free(gap - size, first, k)
                rank, number = rank + k, number - k
            if not number:
                break
            # what the size left of its own gaps may take it again
            again = gap - size
            while number and again >= size and plan.gaps.get(again):
                first, many = plan.gaps[again].pop()
                k = min(many, number)
                plan.moves.append((size, rank, k, first))
                plan._free(again, first + k, many - k)
                plan._free(again - size, first, k)
                rank, number = rank + k, number - k
        per = capacity // size
        while number:
            many = max(1, number // per)
            first = plan.containers
            plan.containers += many
            layers = min(per, number) if many == 1 else per
            for _ in range(layers):
                plan.moves.append((size, rank, many, first))
                rank, number = rank + many, number - many
            plan._free(capacity - layers * size, first, many)
    return plan


def parts(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, tokens): items of more than ``capacity`` tokens cut into full parts and a rest."""
    pieces = F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))
    cut = items.filter("tokens > 0").select("doc_id", "tokens", F.explode(pieces).alias("part_no"))
    return cut.select("doc_id", "part_no", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part_no") * capacity).alias("tokens"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, tokens, container) for items (doc_id, tokens)."""
    rows = checkpoint(parts(items.groupBy("doc_id").agg(F.max("tokens").alias("tokens")), capacity))
    bars = {r["tokens"]: r["n"] for r in rows.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(bars, capacity)
    moves = sorted(plan.moves)
    keys = np.array([size << 40 | rank for size, rank, _, _ in moves], np.int64)
    firsts = np.array([first - rank for _, rank, _, first in moves], np.int64)
    shared = items.sparkSession.sparkContext.broadcast((keys, firsts))
    order = F.xxhash64("doc_id", "part_no")
    ranked = running(
        rows.withColumn("_order", order), ["tokens"], ["_order", "doc_id", "part_no"], F.pmod(order, F.lit(parts_for(sum(bars.values())))), F.lit(1).cast("long"), "rank"
    )

    @F.pandas_udf(T.LongType())
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        keys, firsts = shared.value
        where = np.searchsorted(keys, (size.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(firsts[where] + rank.to_numpy(np.int64))

    return ranked.select("doc_id", "part_no", "tokens", container("tokens", "rank").alias("container"))
