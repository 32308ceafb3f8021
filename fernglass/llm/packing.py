"""Filling of containers of fixed capacity with items, by patterns fitted to the histogram of sizes.

What is planned on the driver is the histogram of sizes: at most ``capacity`` numbers, however many items there are. The plan says
for each size which ranks go to which containers; the items take their ranks in parallel."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
#: Length classes, and the most documents of a pattern.
CLASSES, DEPTH = 48, 6
#: Entries of a plan up to which every task gets it whole.
PLANNED = 200_000


def patterns(classes: int, depth: int) -> np.ndarray:
    """Every way to fill ``classes`` units with up to ``depth`` items of whole units, each a non-increasing row padded with 0."""
    found: list[list[int]] = []

    def extend(row: list[int], left: int) -> None:
        if left == 0:
            found.append(row + [0] * (depth - len(row)))
        elif len(row) < depth:
            most = min(left, row[-1] if row else left)
            for unit in range(most, -(-left // (depth - len(row))) - 1, -1):
                extend([*row, unit], left - unit)

    extend([], classes)
    return np.array(found, np.int32).reshape(-1, depth)


def fit(shapes: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that least-squares fit ``target`` (items by class), by the active-set method, until no pattern would better the fit."""
    rows = np.zeros(len(shapes))
    active: list[int] = []
    values = np.zeros(0)
    column = lambda j: np.bincount(shapes[j], minlength=len(target))[: len(target)] * (np.arange(len(target)) > 0)
    matrix = np.zeros((len(target), 0))
    weight = np.arange(len(target)) > 0
    last = np.inf
    while True:
        miss = (target - (matrix @ values if active else 0)) * weight
        gain = miss[shapes].sum(1) - (shapes == 0).sum(1) * miss[0]
        gain[active] = -np.inf
        j = int(np.argmax(gain)) if len(gain) else -1
        error = float(miss @ miss)
        if j < 0 or gain[j] <= 1e-6 * max(1.0, float(target.max())) or len(active) >= weight.sum() or error >= last * (1 - 1e-12):
            break
        last = error if active else np.inf
        active.append(j)
        values = np.append(values, 0.0)
        matrix = np.column_stack([matrix, column(j)])
        while True:
            best = np.linalg.lstsq(matrix, target * weight, rcond=None)[0]
            if (best > 1e-9).all():
                values = best
                break
            low = best <= 1e-9
            step = np.min(np.where(low, values / np.maximum(values - best, 1e-12), np.inf))
            values = values + step * (best - values)
            keep = values > 1e-9
            if keep.all():
                keep[np.argmin(values)] = False
            active, values, matrix = [a for a, k in zip(active, keep) if k], values[keep], matrix[:, keep]
            if not active:
                break
    rows[active] = values
    return rows


class _Plan:
    """Items by size that are still to be placed, and where those placed went."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.containers = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in histogram.items():
            if size > 0:
                self.left[size] = n
        self.taken = np.zeros(capacity + 1, np.int64)
        self.out: list[tuple[int, int, int]] = []

    def place(self, size: int, count: int, first: int) -> None:
        self.out.append((size, int(self.taken[size]), first))
        self.taken[size] += count
        self.left[size] -= count

    def fill(self, bounds: list[tuple[int, int]], repeat: int) -> int:
        """Fill up to ``repeat`` containers to the last token with a size from each of the ranges ``bounds``, as many at once as the sizes allow; how many were filled.

        The first sizes are the most plentiful of their ranges; the last two are the pair that fills what is left and of which there are most,
        the very last one of any range if its own has none."""
        done = 0
        while done < repeat:
            need: dict[int, int] = {}
            space = self.capacity
            for low, high in bounds[:-2]:
                free = self.left[low:high] // np.array([need.get(s, 0) + 1 for s in range(low, high)])
                size = low + int(np.argmax(free))
                if not free.max() or size > space:
                    return done
                need[size] = need.get(size, 0) + 1
                space -= size
            spare = self.left.copy()
            for size, n in need.items():
                spare[size] -= n
            pair = None
            for (low, high), (least, most) in ((bounds[-2:] if len(bounds) > 1 else [bounds[0], (0, 1)]), (bounds[-2] if len(bounds) > 1 else bounds[0], (0, self.capacity + 1))):
                a = np.arange(low, min(high, space + 1))
                b = space - a
                ready = np.where(a == b, spare[a] // 2, np.minimum(spare[a], np.where(b > 0, spare[b], spare[a]))) * ((b >= least) & (b < most))
                if len(a) and ready.max() > 0:
                    pair = int(a[np.argmax(ready)])
                    break
            if pair is None:
                return done
            for size in (pair, space - pair):
                if size:
                    need[size] = need.get(size, 0) + 1
            n = min([repeat - done, *(int(self.left[s]) // k for s, k in need.items())])
            if n <= 0:
                return done
            for size, k in need.items():
                for _ in range(k):
                    self.place(size, n, self.containers)
            self.containers += n
            done += n
        return done

    def best_fit(self) -> None:
        """What is left, the largest size first, each into the least space that holds it; containers that are alike are one group."""
        free: dict[int, list[list[int]]] = {}
        for size in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[size]:
                space = min((f for f in free if f >= size and free[f]), default=None)
                if space is None:  # a new container for as many of this size as one can hold
                    n = int(self.left[size])
                    hold = min(self.capacity // size, n)
                    rows = n // hold
                    for _ in range(hold):
                        self.place(size, rows, self.containers)
                    free.setdefault(self.capacity - hold * size, []).append([self.containers, rows])
                    self.containers += rows
                else:
                    first, count = free[space].pop()
                    n = min(count, int(self.left[size]))
                    self.place(size, n, first)
                    if count > n:
                        free[space].append([first + n, count - n])
                    if space > size:
                        free.setdefault(space - size, []).append([first, n])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> tuple[list[tuple[int, int, int]], int, int]:
    """``([(size, first rank, first container)], containers, items placed by patterns)``: the item of a size with rank r, of the last entry whose first rank
    is r or less, goes to container ``first container + r - first rank``; a first container of -1 means the zeroth container for all.

    Sizes are rounded to the nearest class. Patterns of up to ``depth`` classes that fill a container are fitted by non-negative least squares to the histogram of
    classes; counts are rounded down, and each pattern is made of sizes of its classes that fill the container to the last token. That is
    done anew with what is left while it places items. The rest is packed by best fit."""
    p = _Plan(histogram, capacity)
    unit = capacity / classes
    edge = [min(capacity + 1, max(1, math.ceil((c - 0.5) * unit))) for c in range(classes + 2)]
    class_of = np.zeros(capacity + 1, np.int64)
    for c in range(1, classes + 1):
        class_of[edge[c] : edge[c + 1] if c < classes else capacity + 1] = c
    bounds = [(edge[c], edge[c + 1] if c < classes else capacity + 1) for c in range(classes + 1)]
    shapes = patterns(classes, depth)
    total = int(p.left.sum())
    while p.left.any():
        target = np.bincount(class_of, p.left, classes + 1)
        present = target > 0
        present[0] = True
        able = shapes[present[shapes].all(1)]
        counts = np.floor(fit(able, np.where(np.arange(classes + 1) > 0, target, 0)) + 1e-6).astype(np.int64) if len(able) else np.zeros(0, np.int64)
        made = 0
        # patterns of few, large classes first: small sizes are what can make up for them
        for j in sorted(np.flatnonzero(counts).tolist(), key=lambda j: int((able[j] > 0).sum())):
            made += p.fill([bounds[c] for c in able[j].tolist() if c], int(counts[j]))
        if not made:
            break
    by_patterns = total - int(p.left.sum())
    p.best_fit()
    if histogram.get(0):
        p.out.append((0, 0, -1))
        p.containers = max(p.containers, 1)
    return p.out, p.containers, by_patterns


def pack(items: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container`` of items ``doc_id, n_tokens``.

    An item over the capacity is split into full containers and a rest; no other is. Items of size 0 and null
    sizes (taken as 0) share container 0 at no cost. Repeated rows are items of their own. Containers are numbered
    from 0 without gaps; ties go by id, so the result is the same on every run for distinct ids."""
    spark = items.sparkSession
    # sizes are read three times and may be dear to compute
    items = cut(items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("_size")))
    full = F.floor(F.col("_size") / capacity).cast("int")
    rest = F.col("_size") % capacity
    last = F.when((rest > 0) | (full == 0), F.array(F.struct(full.cast("int").alias("piece"), rest.alias("n_tokens")))).otherwise(F.array().cast("array<struct<piece:int,n_tokens:bigint>>"))
    pieces = F.concat(F.when(full > 0, F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda p: F.struct(p.cast("int").alias("piece"), F.lit(capacity).cast("long").alias("n_tokens")))).otherwise(F.array().cast("array<struct<piece:int,n_tokens:bigint>>")), last)
    rows = items.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.piece", "p.n_tokens")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("n_tokens", "_bucket").agg(F.count("*").alias("_n"))
    # ranks within a size: the bucket's start among the size's buckets, then the row's place in its bucket
    before = Window.partitionBy("n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n_tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("n_tokens").agg(F.sum("_n")).collect()}  # at most capacity + 1 rows
    entries, _, _ = plan(histogram, capacity, classes, depth)
    table = spark.createDataFrame(entries or [(-1, 0, 0)], "n_tokens long, first long, container long")
    table = table.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("first", "container"))).alias("_plan"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("n_tokens", "_bucket").orderBy("doc_id", "piece")) - 1)
    # the start table has a row per size and bucket: bounded by (capacity + 1) x buckets; the plan's size is known here
    ranked = ranked.join(starts, ["n_tokens", "_bucket"]).join(F.broadcast(table) if len(entries) <= PLANNED else table, "n_tokens").withColumn("_rank", F.col("_start") + F.col("_in"))
    entry = F.element_at(F.filter("_plan", lambda e: e["first"] <= F.col("_rank")), -1)
    container = F.when(entry["container"] < 0, F.lit(0)).otherwise(entry["container"] + F.col("_rank") - entry["first"])
    return ranked.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("first_token"), "n_tokens", container.alias("container"))
