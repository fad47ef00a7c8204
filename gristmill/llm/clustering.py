r"""Lloyd's rounds over whole-number vectors, pruned by the triangle inequality: Yinyang grouping for centroids, Elkan bounds for vector codes.

Vectors are packed into blocks where they lie and never move again. A round is one pass over the blocks: each block is assigned, its bounds are
renewed, and every task adds up the sums of what it has seen. Blocks and sums go to one table in the shared folder, which the next round reads, so that
lost executors cost a reread. Sums meet by key: a task gets one row a task of the pass and key, however many vectors a cluster has. What the driver gets
are the centroids, bounded by their number and width.

Components become whole numbers, floor(factor * x). As long as squares stay within what a double holds exactly, they are computed as doubles; blocks
with larger ones are computed on Python's whole numbers, entry by entry without bounds. So every assignment, tie and mean is exact. Bounds are doubles
that are rounded outwards and only leave out an entry if they say strictly that it is farther; equal distances are looked at as whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import by_size, forget, written
from gristmill.llm.vectors import LARGEST, exact, scaled

#: Rows of a block at most.
ROWS = 4096
#: Pairs of a vector and an entry that are computed at once.
PAIRS = 1 << 18
#: Part by which bounds are moved outwards for what rounding may have taken.
SLACK = 1e-6
BLOCK = "ids array<long>, labels array<string>, matrix binary, width int, state binary, key int, n long, sums string"
#: Copies of a label's sum, over which its rows are dealt where labels are too many to be sent everywhere.
SALTS = 16


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, label as text) of vectors that aren't null and hold no null or non-finite component."""
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", odd))


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors; shorter ones are followed by zeros. No state yet."""
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("matrix", pa.binary()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("embedding")
                offsets, flat = lists.offsets.to_numpy(), np.asarray(lists.values, np.float64)
                size = np.diff(offsets)
                m = np.zeros((part.num_rows, width))
                place = np.arange(width)[None, :] < size[:, None]
                m[place] = flat[offsets[0] : offsets[-1]]
                with np.errstate(over="ignore"):
                    small = m.astype(np.float32)
                same = bool((small == m).all())
                row = [[part.column("vec_id").to_pylist()], [part.column("label").to_pylist()], [(small if same else m).tobytes()], [width if same else -width]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, kind, strict=True)], schema=kind)

    return vectors.mapInArrow(run, "ids array<long>, labels array<string>, matrix binary, width int")


def unpacked(matrix: bytes, width: int) -> np.ndarray:
    return np.frombuffer(matrix, np.float32 if width > 0 else np.float64).reshape(-1, abs(width)).astype(np.float64)


def numbers(m: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * m), as doubles where they are exact and as Python's whole numbers elsewhere."""
    out = scaled(m, factor)
    if fits(out):
        return out
    return np.array([[exact(x, factor) for x in row] for row in m.tolist()], object).reshape(m.shape)


def fits(*of: np.ndarray) -> bool:
    """Whether squared distances between rows of these stay exact as doubles."""
    most = max((float(abs(x).max()) if x.dtype != object else math.inf for x in of if x.size), default=0.0)
    return most < 2**26 and 4 * most * most * max(x.shape[-1] for x in of) < 2**52


def entries_of(rows: list[list[int]]) -> np.ndarray:
    """Rows of whole numbers as a matrix: of doubles, if all are small."""
    small = all(abs(x) < 2**26 for r in rows for x in r)
    return np.array(rows, np.float64 if small else object)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of c, exact."""
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in c.tolist()] for r in x.tolist()], object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def pair_squares(x: np.ndarray, rows: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of single pairs."""
    out = np.empty(len(rows))
    for k in range(0, len(rows), PAIRS):
        d = x[rows[k : k + PAIRS]] - c[at[k : k + PAIRS]]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x) * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x) * (1 - SLACK)


def least(d: np.ndarray) -> np.ndarray:
    """The place of each row's least number, the first of equal ones."""
    return np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64) if d.dtype == object else d.argmin(1)


def added(x: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the rows of each entry."""
    n = np.bincount(mine, minlength=k)
    if x.dtype == object:
        sums = np.zeros((k, x.shape[1]), object)
        for row, e in zip(x, mine.tolist(), strict=True):
            sums[e] += row
        return n, sums
    one = np.zeros((len(x), k))
    one[np.arange(len(x)), mine] = 1
    return n, (one.T @ x).astype(np.int64)


def drifts(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    """How far each entry has moved, rounded up."""
    def far(a: list[int], b: list[int]) -> float:
        square = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return math.sqrt(square) * (1 + SLACK) if square < 2**1000 else math.inf

    return np.array([far(a, b) for a, b in zip(old, new, strict=True)])


class Yinyang:
    """Centroids in groups. A vector has an upper bound of the distance to its own and a lower bound a group of that to the group's others."""

    parts = 1

    def __init__(self, books: list[list[list[int]]], moved: list[np.ndarray] | None, groups: np.ndarray, factor: int) -> None:
        self.c, self.factor, self.groups = entries_of(books[0]), factor, groups
        self.t = int(groups.max()) + 1
        self.moved = None if moved is None else moved[0]
        self.far = None if moved is None else np.array([self.moved[groups == g].max(initial=0) for g in range(self.t)])

    def block(self, m: np.ndarray, state: bytes | None) -> tuple[np.ndarray, list[np.ndarray], bytes]:
        x = numbers(m, self.factor)
        n = len(x)
        if not (x.dtype == self.c.dtype == np.float64 and fits(x, self.c)):
            mine = least(squares(x.astype(object), self._whole()))
            return x, [mine], self._state(mine, np.full(n, np.inf), np.zeros((n, self.t)))
        if state is None:
            d = squares(x, self.c)
            mine = d.argmin(1)
            upper = up(d[np.arange(n), mine])
            d[np.arange(n), mine] = np.inf
            return x, [mine], self._state(mine, upper, np.stack([down(d[:, self.groups == g].min(1)) for g in range(self.t)], 1))
        size = n * 4
        mine, upper = np.frombuffer(state, np.int32, n).astype(np.int64), np.frombuffer(state, np.float32, n, size).astype(np.float64)
        lower = np.frombuffer(state, np.float32, n * self.t, 2 * size).reshape(n, self.t).astype(np.float64)
        upper = (upper + self.moved[mine]) * (1 + SLACK)
        lower = lower - self.far[None, :]
        lower -= SLACK * abs(lower)  # below 0 it says nothing, but a centroid's own move counts from there
        # globally: all groups are farther than the own centroid; then again with the distance itself
        rest = np.flatnonzero(lower.min(1) <= upper)
        own = pair_squares(x, rest, self.c, mine[rest])
        upper[rest] = up(own)
        near = lower[rest].min(1) <= upper[rest]
        rest, own = rest[near], own[near]
        best, was = own.copy(), mine[rest]
        now, start, before = was.copy(), upper[rest], lower[rest]
        every = np.arange(len(rest))
        after = np.where(before <= start[:, None], np.inf, before)
        for g in range(self.t):
            members = np.flatnonzero(self.groups == g)
            # by group, then by centroid: the group's bound before its farthest move, less the centroid's own move
            alone = before[:, g, None] + self.far[g] - self.moved[members][None, :]
            scanned, own_one = (before[:, g] <= start)[:, None], members[None, :] == was[:, None]
            alone -= SLACK * abs(alone)
            able = scanned & ~(alone > start[:, None]) & ~own_one
            r, e = np.nonzero(able)
            d = np.full(able.shape, np.inf)
            d[r, e] = pair_squares(x, rest[r], self.c, members[e])
            # the group's best one is held against the best so far by whole number, then by place
            place = d.argmin(1)
            low, name = d[every, place], members[place]
            take = (low < best) | ((low == best) & (name < now))
            loser, lost = np.where(take, now, name), np.where(take, best, low)
            # what wasn't looked at, the others, and whoever lost bound their groups
            d[every, place] = np.inf
            left = np.where(able | own_one | ~scanned, np.inf, alone)
            after[:, g] = np.minimum(after[:, g], np.minimum(down(d.min(1)), left.min(1)))
            np.minimum.at(after, (every, self.groups[loser]), down(lost))
            now, best = np.where(take, name, now), np.where(take, low, best)
        mine[rest], upper[rest] = now, up(best)
        lower[rest] = after
        return x, [mine], self._state(mine, upper, lower)

    def _whole(self) -> np.ndarray:
        return np.array([[int(v) for v in r] for r in self.c.tolist()], object)

    def _state(self, mine: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
        with np.errstate(over="ignore"):
            return mine.astype(np.int32).tobytes() + np.nextafter(upper.astype(np.float32), np.float32(np.inf)).tobytes() + np.nextafter(lower.astype(np.float32), np.float32(-np.inf)).tobytes()

    def cut(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(x, self.c)]


class Elkan:
    """Vectors in parts, each with its codebook. A part has an upper bound of the distance to its entry and a lower bound an entry.

    Lower bounds are levels of a byte, rounded down: the largest first distance of a part is 255 levels.
    """

    def __init__(self, books: list[list[list[int]]], moved: list[np.ndarray] | None, factor: int) -> None:
        self.books, self.moved, self.factor, self.parts = [entries_of(b) for b in books], moved, factor, len(books)
        self.k = len(books[0])
        self.between: list[np.ndarray | None] = []
        for c in self.books:
            half = down(np.maximum(squares(c, c), 0)) / 2 if fits(c) else None
            if half is not None:
                np.fill_diagonal(half, np.inf)
            self.between.append(half)

    def cut(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        w = x.shape[1] // self.parts
        return [(x[:, p * w : (p + 1) * w], c) for p, c in enumerate(self.books)]

    def block(self, m: np.ndarray, state: bytes | None) -> tuple[np.ndarray, list[np.ndarray], bytes]:
        x = numbers(m, self.factor)
        n, size = len(x), len(x) * (2 + 4 + 4 + self.k)
        found, states = [], []
        for p, (y, c) in enumerate(self.cut(x)):
            mine, upper, scale, level = self._part(p, y, c, None if state is None else state[p * size : (p + 1) * size])
            found.append(mine)
            states.append(mine.astype(np.int16).tobytes() + np.nextafter(upper.astype(np.float32), np.float32(np.inf)).tobytes() + scale.astype(np.float32).tobytes() + level.tobytes())
        return x, found, b"".join(states)

    def _part(self, p: int, y: np.ndarray, c: np.ndarray, state: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(y), self.k
        every = np.arange(n)
        if not (y.dtype == c.dtype == np.float64 and fits(y, c)):
            whole = lambda a: np.array([[int(v) for v in r] for r in a.tolist()], object).reshape(a.shape)
            return least(squares(whole(y), whole(c))), np.full(n, np.inf), np.ones(n), np.zeros((n, k), np.uint8)
        if state is None:
            d = squares(y, c)
            mine = d.argmin(1)
            root = np.sqrt(d)
            scale = np.maximum(root.max(1), 1).astype(np.float32).astype(np.float64) * ((1 + SLACK) / 255)
            return mine, up(d[every, mine]), scale, self._levels(root, scale[:, None])
        mine = np.frombuffer(state, np.int16, n).astype(np.int64)
        upper, scale = (np.frombuffer(state, np.float32, n, at).astype(np.float64) for at in (2 * n, 6 * n))
        level = np.frombuffer(state, np.uint8, n * k, 10 * n).reshape(n, k)
        moved = self.moved[p]
        upper = (upper + moved[mine]) * (1 + SLACK)
        if moved.any():
            fall = np.minimum(np.ceil(moved[None, :] * (1 + SLACK) / scale[:, None]), 255).astype(np.uint8)
            level = np.where(level > fall, level - fall, 0).astype(np.uint8)
        else:
            level = level.copy()
        half = self.between[p]
        # nothing is nearer than the own entry if half the way to its nearest neighbour is more
        rest = np.flatnonzero(half.min(1)[mine] <= upper)
        own = pair_squares(y, rest, c, mine[rest])
        upper[rest] = up(own)
        level[rest, mine[rest]] = self._levels(np.sqrt(own), scale[rest])
        able = (level[rest] * (scale[rest] * (1 - SLACK))[:, None] <= upper[rest][:, None]) & (half[mine[rest]] <= upper[rest][:, None])
        able[np.arange(len(rest)), mine[rest]] = False
        r, e = np.nonzero(able)
        if len(r):
            d = pair_squares(y, rest[r], c, e)
            level[rest[r], e] = self._levels(np.sqrt(d), scale[rest[r]])
            # distance and place in one whole number: of equal distances the lower place
            keys = d.astype(np.int64) * k + e
            first = np.flatnonzero(np.diff(r, prepend=-1))
            rows, best = r[first], np.minimum.reduceat(keys, first)
            better = best < own[rows].astype(np.int64) * k + mine[rest[rows]]
            won = rest[rows[better]]
            mine[won], upper[won] = best[better] % k, up((best[better] // k).astype(np.float64))
        return mine, upper, scale, level

    @staticmethod
    def _levels(root: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(root * (1 - SLACK) / scale), 255).astype(np.uint8)


def round_of(blocks: DataFrame, step: Callable[[], Yinyang | Elkan], k: int) -> DataFrame:
    """Blocks with their new state, and each task's sums: key is part * k + entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = step()
        counts, sums = [0] * how.parts, [0] * how.parts
        names = ["ids", "labels", "matrix", "width", "state", "key", "n", "sums"]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.string()]
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                width = one.column("width")[0].as_py()
                x, found, state = how.block(unpacked(one.column("matrix")[0].as_buffer(), width), one.column("state")[0].as_py() if "state" in one.schema.names else None)
                for p, (y, _) in enumerate(how.cut(x)):
                    n, s = added(y, found[p], k)
                    counts[p], sums[p] = counts[p] + n, sums[p] + s
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names[:4]), pa.array([state], pa.binary()), *(pa.nulls(1, t) for t in kinds[5:])], names)
        rows = [(p * k + int(e), int(counts[p][e]), ",".join(map(str, sums[p][e].tolist()))) for p in range(how.parts) if not isinstance(counts[p], int) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in kinds[:5]), *(pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds[5:]))], names)

    return blocks.mapInArrow(run, BLOCK)


def means(table: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The entries after a round: floor(sum / count), and the old ones where nothing was."""
    k = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = None, 0, []

        def out() -> pa.RecordBatch:
            some = [] if key is None else [(key, ",".join(str(v // n) for v in total))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.string())], ["key", "mean"])

        for batch in batches:
            for name, count, text in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sums")), strict=True):
                values = [*map(int, text.split(","))]
                if name != key:
                    yield out()
                    key, n, total = name, count, values
                else:
                    n, total = n + count, [a + b for a, b in zip(total, values, strict=True)]
        yield out()

    parts = table.filter(F.col("key").isNotNull()).select("key", "n", "sums").repartition("key").sortWithinPartitions("key")
    new = [[*b] for b in books]
    for row in parts.mapInArrow(run, "key int, mean string").collect():  # as many as there are entries
        new[row.key // k][row.key % k] = [*map(int, row.mean.split(","))]
    return new


def lloyd(vectors: DataFrame, books: list[list[list[int]]], width: int, rounds: int, step: Callable[..., Yinyang | Elkan]) -> tuple[DataFrame, list[list[list[int]]], list[np.ndarray] | None]:
    """(blocks with the last round's state, final entries, their last moves) after `rounds` assignments and updates."""
    k, moved = len(books[0]), None
    blocks = written(packed(vectors, width), "blocks")
    for _ in range(rounds):
        table = written(round_of(blocks, _bound(step, books, moved), k), "round")
        new = means(table, books)
        forget(blocks)
        moved, books, blocks = [drifts(a, b) for a, b in zip(books, new, strict=True)], new, _blocks_of(table)
    return blocks, books, moved


def _blocks_of(table: DataFrame) -> DataFrame:
    blocks = table.filter(F.col("key").isNull()).select("ids", "labels", "matrix", "width", "state")
    blocks.written_to = table.written_to
    return blocks


def _bound(step: Callable[..., Yinyang | Elkan], books: list, moved: list | None) -> Callable[[], Yinyang | Elkan]:
    return lambda: step(books, moved)


def assigned(blocks: DataFrame, step: Callable[[], Yinyang | Elkan]) -> DataFrame:
    """(vec_id, label, codes, error): the last assignment, with squared distances summed over parts and held to the range of a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = step()
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                x, found, _ = how.block(unpacked(one.column("matrix")[0].as_buffer(), one.column("width")[0].as_py()), one.column("state")[0].as_py() if "state" in one.schema.names else None)
                total = 0
                for (y, c), mine in zip(how.cut(x), found, strict=True):
                    if y.dtype == c.dtype == np.float64 and fits(y, c):
                        total = total + pair_squares(y, np.arange(len(y)), c, mine).astype(np.int64)
                    else:
                        whole = lambda a: [[int(v) for v in row] for row in a.tolist()]
                        total = total + np.array([sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for row, e in zip(whole(y), whole(c[mine]), strict=True)], object)
                codes = np.stack(found, 1).astype(np.int32)
                error = [min(LARGEST, int(v)) for v in total.tolist()]
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, how.parts, dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), lists, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return blocks.mapInArrow(run, "vec_id long, label string, codes array<int>, error long")


def summed(c: str) -> Column:
    """A sum that is held to the range of a long."""
    return F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def in_groups(centers: list[list[int]], t: int) -> np.ndarray:
    """The group of each centroid: a few rounds over the centroids alone. Any grouping gives the same result."""
    c = np.array([[float(max(-(2**500), min(2**500, v))) for v in row] for row in centers])
    middle = c[np.linspace(0, len(c) - 1, t).astype(int)]
    for _ in range(5):
        near = ((c[:, None, :] - middle[None, :, :]) ** 2).sum(2).argmin(1)
        middle = np.stack([c[near == g].mean(0) if (near == g).any() else middle[g] for g in range(t)])
    return np.unique(near, return_inverse=True)[1]


def digest(books: list[list[list[int]]]) -> str:
    """Lower-case hex SHA-256 of all entries' components, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, factor: int = 256, width: int = 64, group: int = 10) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `width` components, none of them null or non-finite.

    Centroids start as the k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; of equal ids the lesser vector comes first, vectors without
    an id come last. Fewer vectors than k make fewer centroids. Equal distances go to the smaller number; means are exact and rounded down; a centroid without
    vectors stays. Rows that repeat an id are vectors of their own and each has its row. Sums and distances beyond a long are held to its range. Extra
    columns are left out. No vectors, no rows.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors).filter(F.size("embedding") == width)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "vec_id", "embedding").orderBy(F.col("key").asc_nulls_last(), "vec_id", "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    books = [[[exact(x, factor) for x in r.embedding] for r in first]]
    groups = in_groups(books[0], max(1, len(first) // group))
    step = lambda b, moved: Yinyang(b, moved, groups, factor)
    blocks, books, moved = lloyd(kept, books, width, rounds, step)
    last = written(assigned(blocks, _bound(step, books, moved)).select("vec_id", F.col("codes")[0].alias("cluster"), F.col("error").alias("distance")), "assigned")
    forget(blocks)
    sums = {r.cluster: r.n for r in last.groupBy("cluster").agg(summed("distance").alias("n")).collect()}  # one a centroid
    total = min(LARGEST, sum(sums.values()))
    rows = [(c, n, total, digest([[books[0][c]]])) for c, n in sums.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that isn't null and holds no null or non-finite component.

    Codebooks start as the parts of the `entries` vectors with the smallest ids; of equal ids the lesser vector comes first, those without an id come last. Vectors that
    are shorter than the longest, or than a multiple of `parts`, count as if zeros followed. Equal distances go to the lower index; means are exact and
    rounded down; an entry that isn't used stays. Rows that repeat an id each have their row; null labels are one label. Sums beyond a long are held to its
    range. Extra columns are left out. No vectors, no rows.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors)
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first().n
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    w = max(1, -(-longest // parts))
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    rows = [[exact(x, factor) for x in r.embedding] + [0] * (parts * w - len(r.embedding)) for r in first]
    books = [[r[p * w : (p + 1) * w] for r in rows] for p in range(parts)]
    step = lambda b, moved: Elkan(b, moved, factor)
    blocks, books, moved = lloyd(kept, books, parts * w, rounds, step)
    last = written(assigned(blocks, _bound(step, books, moved)), "assigned")
    forget(blocks)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return with_label_error(last).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def with_label_error(rows: DataFrame) -> DataFrame:
    """All columns with the sum of `error` over the rows of the same label. Few labels are sent everywhere; of many each has SALTS rows, over which its own are dealt."""
    sums = written(rows.groupBy("label").agg(summed("error").alias("label_error")), "labels")
    few = by_size(sums)
    if few is not sums:
        return rows.join(few, rows["label"].eqNullSafe(few["label"])).drop(few["label"])
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "_label")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["label"].eqNullSafe(salted["_label"]) & (dealt["_salt"] == salted["_salt"])).drop("_label", "_salt")
