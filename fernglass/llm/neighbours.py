"""The most similar vectors of every vector: floors by cross-polytope hashing with multiprobe tables, all pairs against them, and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION, K = 64, 10
#: Hash tables, and vectors in a shard, which a task holds whole: the fewer shards a domain has, the less is sent. More than one table costs more than its floors save.
TABLES, SHARD = 1, 131_072
#: Domains up to which their numbers of shards are sent to every task.
DOMAINS = 100_000
#: Signed axes probed in each table, at any number of rows. Tables and probes only save time; what is found does not depend on them.
PROBES = 7
#: Rows of a matrix product's sides, and pairs of a block's queries that wait at most for their cosines in double precision.
BLOCK, CROWD = 1024, 1_000_000

_OUT = "domain string, chunk_id string, near array<struct<d:double,neighbour:string>>"


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    """Whether a vector has ``dimension`` finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations(dimension: int, tables: int, seed: int = 7) -> list[list[np.ndarray]]:
    """Three vectors of random signs for each table; with a Hadamard transform after each they act as a random rotation."""
    rng = np.random.default_rng(seed)
    return [[rng.choice(np.float32([-1, 1]), dimension) for _ in range(3)] for _ in range(tables)]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, width, h = len(rows), rows.shape[1], 1
    while h < width:
        pairs = rows.reshape(n, -1, 2, h)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return rows / np.float32(np.sqrt(width))


def turned(unit: np.ndarray, signs: list[np.ndarray]) -> np.ndarray:
    """Rows after a pseudo-rotation. The transforms of the axes make its matrix, one product with which turns all rows at once where there are more rows than axes."""
    if len(unit) > unit.shape[1]:
        return unit @ turned(np.eye(unit.shape[1], dtype=np.float32), signs)
    for flip in signs:
        unit = hadamard(unit * flip)
    return unit


def nearest_axes(rows: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each rotated unit vector, nearest first; axis j is 2j, its opposite 2j + 1."""
    size = np.abs(rows)
    top = np.argpartition(-size, min(probes, size.shape[1] - 1), axis=1)[:, :probes]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1), 1)
    return top * 2 + (np.take_along_axis(rows, top, 1) < 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in single precision."""
    rows = rows.astype(np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def cosines(queries: np.ndarray, base: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair in double precision, its sums taken from the first number to the last, so that it has the bits of SQL's."""
    found = [np.zeros(0)]
    for at in range(0, len(q), 50_000):
        x, y = queries[q[at : at + 50_000]].astype(np.float64), base[b[at : at + 50_000]].astype(np.float64)
        dot, left, right = (np.add.accumulate(product, axis=1, out=product)[:, -1] for product in (x * y, x * x, y * y))
        found.append(np.clip(dot / np.sqrt(left * right), -1, 1))
    return np.concatenate(found)


def first_of_equals(rows: np.ndarray, most: int) -> np.ndarray:
    """The rows without those that ``most`` rows before them equal."""
    seen: dict[bytes, int] = {}
    kept = []
    for number, row in enumerate(map(bytes, rows)):
        seen[row] = times = seen.get(row, 0) + 1
        if times <= most:
            kept.append(number)
    return np.array(kept, np.int64)


def _best(queries: np.ndarray, base: np.ndarray, q: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs the k best of each query by the cosine in double precision, the earlier base row first where it is equal; ``s`` goes along."""
    order = np.lexsort((b, -cosines(queries, base, q, b), q))
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
    return q[order], b[order], s[order]


def search(queries: np.ndarray, base: np.ndarray, own: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """``(query rows, base rows)`` of the k best base rows of each query, best first; ``own`` is the query's own base row or -1.

    In each table a base row lies in the cell of its nearest signed axis and a query looks into the cells of its ``probes``
    nearest ones; the k-th best there is its floor. Then all pairs are scored in matrix products, and those not under the floor, less what
    single precision may be wrong by, are judged in double. So the rows found are the k best whatever the tables, the probes and
    the number of rows are, and equal ones are taken in the order of the base."""
    kept = first_of_equals(base, k + 1)
    place = np.full(len(base) + 1, -1)
    place[kept] = np.arange(len(kept))
    base, own = base[kept], place[own]
    ask, look = unit(queries), unit(base)
    slack = np.float32(2 * (ask.shape[1] + 4) * np.finfo(np.float32).eps)
    floor = np.full(len(ask), -2, np.float32)
    for signs in rotations(ask.shape[1], tables):
        looked, cell = nearest_axes(turned(ask, signs), probes), nearest_axes(turned(look, signs), 1)[:, 0]
        for c in range(2 * ask.shape[1]):
            rows, asking = np.flatnonzero(cell == c), np.flatnonzero((looked == c).any(axis=1))
            for at in range(0, len(asking) if len(rows) > k else 0, BLOCK):
                part = asking[at : at + BLOCK]
                floor[part] = np.maximum(floor[part], _reached(ask[part] @ look[rows].T, k) - slack)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(ask), BLOCK):
        part, low, mine = ask[start : start + BLOCK], floor[start : start + BLOCK], own[start : start + BLOCK]
        q, b, s, new, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), [], 0
        for at in range(0, len(look), BLOCK):
            score = part @ look[at : at + BLOCK].T
            bare = np.flatnonzero(low < -1)
            if len(bare) and score.shape[1] > k:
                low[bare] = _reached(score[bare], k) - slack
            over = np.flatnonzero(score >= low[:, None])
            over_q, over_b = np.divmod(over, score.shape[1])
            other = mine[over_q] != over_b + at
            new.append((over_q[other], over_b[other] + at, score.ravel()[over[other]]))
            waiting += len(over)
            if waiting > 16 * len(part) or at + BLOCK >= len(look):
                q, b, s = (np.concatenate([old, *more]) for old, more in zip((q, b, s), zip(*new)))
                order = np.lexsort((-s, q))
                q, b, s = q[order], b[order], s[order]
                last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
                low[q[last]] = np.maximum(low[q[last]], s[last] - slack)
                keep = s >= low[q]
                q, b, s, new, waiting = q[keep], b[keep], s[keep], [], 0
                if len(q) > CROWD:
                    q, b, s = _best(queries[start : start + BLOCK], base, q, b, s, k)
        q, b, _ = _best(queries[start : start + BLOCK], base, q, b, s, k)
        found.append((q + start, kept[b]))
    q, b = (np.concatenate(rows) for rows in zip(*found))
    return q, b


def _reached(score: np.ndarray, k: int) -> np.ndarray:
    """What k rows other than the query's own reach at least, of more than k."""
    return np.partition(score, -k - 1, axis=1)[:, -k - 1]


def _tile(k: int, tables: int, probes: int):
    """The neighbours within a shard, or of the rows of each of two shards in the other."""

    def run(table: pa.Table) -> pa.Table:
        # one row per id; a fixed order makes ties the same on every run
        places = {i: r for r, i in enumerate(table.column("chunk_id").to_pylist())}
        names = sorted(places)
        order = [places[i] for i in names]
        lists = table.column("vector").combine_chunks()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)[order]
        shard = table.column("_own").to_numpy()[order]
        sides = [np.flatnonzero(shard == s) for s in np.unique(shard)]
        found = []
        if table.column("_a")[0].as_py() == table.column("_b")[0].as_py():
            q, b = search(vectors, vectors, np.arange(len(vectors)), k, tables, probes)
            found.append((q, b))
        elif len(sides) == 2:
            for query, base in (sides, sides[::-1]):
                q, b = search(vectors[query], vectors[base], np.full(len(query), -1), k, tables, probes)
                found.append((query[q], base[b]))
        q, b = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
        cosine = cosines(vectors, vectors, q, b)
        # the neighbours of a row lie together; a list of them is one row
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        every = pa.array(names, pa.string())
        near = pa.StructArray.from_arrays([pa.array(-cosine), every.take(pa.array(b))], ["d", "neighbour"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)].astype(np.int32)), near)
        return pa.table({"domain": pa.array([table.column("domain")[0].as_py()] * len(first), pa.string()), "chunk_id": every.take(pa.array(q[first])), "near": lists})

    return run


def most_similar(chunks: DataFrame, k: int = K, *, dimension: int = DIMENSION, tables: int = TABLES, probes: int = PROBES, shard: int = SHARD) -> DataFrame:
    """``domain, chunk_id, neighbour, rank, cosine``: the k most similar chunks of the same domain for every usable vector.

    Domains compare trimmed and in lower case; a null domain, a null id and a vector that is not ``dimension`` finite numbers or
    all zero are left out. Repeated and late rows of an id are one. Equal similarities rank by id. A domain alone or smaller
    than k + 1 gives what there is. The rows of a domain are cut into S shards of about ``shard``, and each shard and each pair of
    shards is one bounded group, searched both ways, so a domain with most rows is many tasks of one size; a vector is sent S times."""
    rows = chunks.select(F.lower(F.trim("domain")).alias("domain"), "chunk_id", "vector").filter(F.col("domain").isNotNull() & F.col("chunk_id").isNotNull())
    shards = rows.groupBy("domain").agg(F.ceil(F.count("*") / shard).cast("int").alias("_shards"))
    groups, domains = shards.agg(F.coalesce(F.sum(F.expr("_shards * (_shards + 1) / 2")), F.lit(1)), F.count("*")).first()
    # groups are few and take long, so they are spread over more partitions than there are of them, which are not put together again
    parts = int(min(20_000, max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * groups)))
    rows = rows.filter(usable(F.col("vector"), dimension)).join(F.broadcast(shards) if domains <= DOMAINS else shards, "domain").withColumn("_own", F.pmod(F.xxhash64("chunk_id"), F.col("_shards")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("_shards") - 1), lambda s: F.struct(F.least("_own", s).alias("_a"), F.greatest("_own", s).alias("_b")))
    rows = rows.withColumn("_tile", F.explode(tiles)).select("domain", "chunk_id", "vector", "_own", "_tile.*").repartition(parts, "domain", "_a", "_b")
    found = rows.groupBy("domain", "_a", "_b").applyInArrow(_tile(k, tables, probes), _OUT)
    lists = found.groupBy("domain", "chunk_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("l"))
    return lists.select("domain", "chunk_id", F.posexplode("l").alias("rank", "n")).select("domain", "chunk_id", F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("n.d")).alias("cosine"))


def similar_pairs(neighbours: DataFrame, least: float = 0.90) -> DataFrame:
    """``chunk_id_a, chunk_id_b``: pairs, the smaller id first, where one is among the other's neighbours with ``least`` cosine or more."""
    close = neighbours.filter(F.col("cosine") >= least)
    return close.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()
