"""Filling containers of fixed capacity with items (problem 7): a configuration LP.

Only the histogram of item sizes reaches the driver: at most ``capacity``
numbers, whatever the corpus. There a plan is made in four steps, each bounded by
the capacity too:

1. Sizes are grouped into classes of ``grain`` units, rounded up.
2. The configuration LP over the classes (how often to use which filling, so that
   every class is covered, with as few containers as possible) is solved by
   multiplicative weights: a class counts the less, the more it is covered; the
   filling that is worth most under these weights is found by a knapsack dynamic
   program and used a little more.
3. The solution is rounded down to whole containers, which get real sizes from
   the classes, largest first. Equal containers are kept as one row with a count.
4. What is left, and the space that rounding up wasted, are matched by best fit
   decreasing, on counts of equal items and of equal containers.

The plan says which ranks among the items of one size go to which containers.
Items get their rank in their size by salted counting, so one size may hold any
share of all items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphloom.session import materialise

#: Units of a size class; items of one size that a task ranks.
GRAIN, ROWS_A_TASK = 8, 1_000_000
#: Share of all units, in the smallest items, that the linear program leaves for filling gaps.
HELD_BACK = 0.03
#: Multiplicative weights: rounds at most, how sharply cover lowers a weight, and the share of a class one use may cover.
ROUNDS, ETA, STEP = 2500, 12.0, 0.1

Group = tuple[int, dict[int, int]]  # so many containers, each with so many items of a size


def best_filling(worth: np.ndarray, room: int) -> dict[int, int]:
    """The filling of ``room`` units worth most; worth[u - 1] is the worth of an item of u units (unbounded knapsack)."""
    best, pick = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        value = worth[:c] + best[c - 1 :: -1][:c]
        u = int(np.argmax(value))
        if value[u] > best[c - 1]:
            best[c], pick[c] = value[u], u + 1
        else:
            best[c] = best[c - 1]
    filling: dict[int, int] = defaultdict(int)
    while room > 0:
        if pick[room]:
            filling[int(pick[room])] += 1
            room -= int(pick[room])
        else:
            room -= 1
    return dict(filling)


def solve_lp(demand: np.ndarray, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Fractional use of fillings that covers ``demand`` (items by units, from 1), by multiplicative weights."""
    room = len(demand)
    present = demand > 0
    cover = np.zeros(room)
    use: dict[tuple, float] = defaultdict(float)
    if not present.any():
        return use
    for _ in range(rounds):
        least = cover[present].min()
        if least >= 1:
            break
        weight = np.where(present & (cover < 1), np.exp(-ETA * (cover - least)) / np.maximum(demand, 1), -1.0)
        filling = best_filling(weight, room)
        units = np.fromiter(filling, int)
        times = np.fromiter(filling.values(), int)
        amount = max(STEP * float((demand[units - 1] / times).min()), min(1.0, float((demand[units - 1] / times).min())))
        use[tuple(sorted(filling.items(), reverse=True))] += amount
        cover[units - 1] += times * amount / demand[units - 1]
    return use


def realise(use: dict[tuple, float], left: dict[int, int], grain: int) -> list[Group]:
    """Whole containers for the fractional ``use``: sizes are taken from ``left``, largest of each class first."""
    shelf: dict[int, list[list[int]]] = defaultdict(list)
    for size in sorted(left):
        shelf[-(-size // grain)].append([size, left[size]])
    stock = {u: sum(n for _, n in rows) for u, rows in shelf.items()}
    groups: list[Group] = []
    for filling, amount in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        todo = min([int(amount + 1e-9), *(stock.get(u, 0) // k for u, k in filling)])
        while todo > 0:
            # so many containers that each gets the same sizes
            run, content = todo, defaultdict(int)
            for u, k in filling:
                size, n = shelf[u][-1]
                run = min(run, n // k) if n >= k else 0
            if run:
                for u, k in filling:
                    row = shelf[u][-1]
                    content[row[0]] += k
                    row[1] -= k * run
            else:
                run = 1
                for u, k in filling:
                    need = k
                    while need:
                        row = shelf[u][-1]
                        got = min(need, row[1])
                        content[row[0]] += got
                        row[1] -= got
                        need -= got
                        if not row[1]:
                            shelf[u].pop()
            for u, k in filling:
                stock[u] -= k * run
                while shelf[u] and not shelf[u][-1][1]:
                    shelf[u].pop()
            groups.append((run, dict(content)))
            todo -= run
    left.clear()
    left.update({size: n for rows in shelf.values() for size, n in rows if n})
    return groups


def best_fit(groups: list[Group], left: dict[int, int], capacity: int) -> list[Group]:
    """The groups after all items of ``left`` found room, by best fit decreasing; new containers are opened at need."""
    room: dict[int, list[Group]] = defaultdict(list)
    for count, content in groups:
        room[capacity - sum(s * k for s, k in content.items())].append((count, content))
    rooms = sorted(room)

    def put(free: int, group: Group) -> None:
        if not room[free]:
            at = bisect_left(rooms, free)
            if at == len(rooms) or rooms[at] != free:
                insort(rooms, free)
        room[free].append(group)

    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                k = min(capacity // size, n)
                put(capacity - k * size, (n // k, {size: k}))
                n -= n // k * k
                continue
            free = rooms[at]
            count, content = room[free].pop()
            if not room[free]:
                rooms.pop(at)
            k = min(free // size, n)
            took = min(count, n // k)
            put(free - k * size, (took, content | {size: content.get(size, 0) + k}))
            if took < count:
                put(free, (count - took, content))
            n -= k * took
    return [g for free in sorted(room) for g in room[free]]


def plan(histogram: dict[int, int], capacity: int, grain: int = GRAIN, rounds: int = ROUNDS) -> list[Group]:
    """Groups of equal containers that hold all items of the histogram (sizes from 1 to ``capacity``)."""
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    small, held, total = {}, 0, sum(s * n for s, n in left.items())
    for size in sorted(left):
        if held + size * left[size] > HELD_BACK * total:
            break
        held += size * left[size]
        small[size] = left.pop(size)
    demand = np.zeros(capacity // grain)
    for size, n in left.items():
        if -(-size // grain) <= len(demand):
            demand[-(-size // grain) - 1] += n
    groups = realise(solve_lp(demand, rounds), left, grain)
    return best_fit(groups, left | small, capacity)


def intervals(groups: list[Group]) -> tuple[np.ndarray, ...]:
    """The plan by size: (size, first rank, first container, items of the size in one container), ascending."""
    rows, taken, base = [], defaultdict(int), 0
    for count, content in groups:
        for size, k in content.items():
            rows.append((size, taken[size], base, k))
            taken[size] += k * count
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(sized: DataFrame, key: str, size: str, capacity: int, grain: int = GRAIN) -> DataFrame:
    """(key, piece, tokens, container): every item, or piece of an item above ``capacity``, with its container.

    Items above the capacity are cut into full pieces and a rest, numbered from
    1; no other is. Items of size 0 or null take no room: piece 1, container
    null. Containers are numbered from 0. The input is read three times, so it is
    written to the shared folder first.
    """
    whole = materialise(sized.select(key, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("__size")), "sizes")
    parts = F.greatest(F.ceil(F.col("__size") / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = whole.select(key, "__size", F.explode(F.sequence(F.lit(1), parts)).alias("piece"))
    tokens = F.least(F.lit(capacity).cast("bigint"), F.col("__size") - (F.col("piece") - 1) * F.lit(capacity))
    pieces = pieces.select(key, "piece", tokens.alias("tokens"))

    histogram = {r[0]: r[1] for r in pieces.filter("tokens > 0").groupBy("tokens").count().collect()}  # at most capacity rows
    # a size of very many items is ranked in as many parts as its items need: capacity + items / ROWS_A_TASK parts in all
    cut = {s: -(-n // ROWS_A_TASK) for s, n in histogram.items() if n > ROWS_A_TASK}
    parts_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("tokens")), F.lit(1)) if cut else F.lit(1)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), parts_of).cast("int"))
    counts = pieces.filter("tokens > 0").groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes, first, container, each = intervals(plan(histogram, capacity, grain))
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    order = Window.partitionBy("tokens", "salt").orderBy(key, "piece")
    ranked = pieces.filter("tokens > 0").withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    ranked = ranked.join(F.broadcast(offsets), ["tokens", "salt"]).select(key, "piece", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    span = np.int64(1) << 40
    starts = sizes * span + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = np.searchsorted(starts, size * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container[at] + (rank - first[at]) // each[at], pa.int64())], names=[*batch.schema.names[:3], "container"])

    kind = pieces.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"`{key}` {kind}, piece int, tokens bigint, container bigint")
    empty = pieces.filter("tokens = 0").select(key, "piece", "tokens", F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(empty)
