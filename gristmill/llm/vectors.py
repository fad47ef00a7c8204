r"""Searches of a stated set of query vectors against all vectors.

Both sides are packed into blocks where their rows lie. Queries form groups and candidates form slices, each of a bounded number of bytes;
a task holds one group, the blocks of one slice stream by it, and each query keeps its best rows in a heap, whose worst row is a bar for what follows. The
slices are searched in two rounds, the second with the bars of the first, so that it emits little more than what counts. Heaps
merge what the tasks emit. No side is collected, and no task holds more than a group and a slice.

`Nearest`: in a block, both sides are rounded to int8 with a scale a row. Their product, exact in whole numbers, is off from the
true one by at most |eq| |c| + |q - eq| |ec|, where eq and ec are what rounding took from a row. A pair whose upper bound is below the
bar, or below the k-th lower bound of the block, can't be among the k nearest; the pairs that survive are computed in double precision and go to the heaps.

`TopScores`: whole-number scores by aggregation of sorted lists without random access. A block's candidates lie in one sorted list a
component. Lists are read in steps from the end that the query's sign prefers. What has been read of a candidate bounds its score from below
and above: an unread component lies between the list's other end and where it stands, and all unread ones together
have what is left of the candidate's norm. A query stops reading as soon as at most OPEN x k candidates reach the k-th lower bound or the bar; their final
scores are then resolved. At the lists' ends the bounds are the scores, so there is no other way beside this one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import written

#: Rows of a block at most, and bytes of a group of queries and of a slice of candidates, about.
ROWS, GROUP_BYTES, SLICE_BYTES = 4096, 32 << 20, 64 << 20
#: Parts of the lists after which bounds are looked at, and candidates that may then be open, as a multiple of k.
STEPS, OPEN = 8, 8
#: Queries looked at together.
STRIP = 64
LARGEST = 2**63 - 1


def whole(batch: pa.RecordBatch, zero: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) by vector length: rows that have an id and no null or non-finite component; zero vectors only if wanted."""
    lists = batch.column("embedding")
    has = np.logical_not(lists.is_null().to_numpy(zero_copy_only=False)) & np.logical_not(batch.column("vec_id").is_null().to_numpy(zero_copy_only=False))
    offsets = lists.offsets.to_numpy()
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
    lengths = np.diff(offsets)
    for n in np.unique(lengths[has]).tolist():
        rows = np.flatnonzero(has & (lengths == n))
        m = flat[offsets[rows][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(rows), 1))
        fine = np.isfinite(m).all(1) & (zero | m.any(1))
        yield rows[fine], m[fine]


def packed(vectors: DataFrame, zero: bool) -> DataFrame:
    """(ids, bars, matrix, width, place) of vectors (vec_id, embedding; bar): blocks of rows of one length, packed where they lie.

    width is negative if the matrix is of doubles. A row without bar has the lowest one.
    """
    barred = "bar" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            for parts in held.values():
                ids, bars, m = (np.concatenate(x) for x in zip(*parts, strict=True))
                for k in range(0, len(ids), ROWS):
                    yield _block(ids[k : k + ROWS], bars[k : k + ROWS], m[k : k + ROWS])
            held.clear()

        for batch in batches:
            names = batch.column("vec_id").to_numpy(zero_copy_only=False)
            bars = np.asarray(batch.column("bar").to_numpy(zero_copy_only=False), np.float64) if barred else np.full(len(names), np.nan)
            for at, m in whole(batch, zero):
                if len(at):
                    held.setdefault(m.shape[1], []).append((names[at].astype(np.int64), bars[at], m))
                    rows += len(at)
            if rows >= 4 * ROWS:
                yield from out()
                rows = 0
        yield from out()

    columns = ["vec_id", "embedding", *["bar"] * barred]
    blocks = vectors.select(*columns).mapInArrow(run, "ids binary, bars binary, matrix binary, width int")
    return blocks.withColumn("place", F.monotonically_increasing_id())


def _block(ids: np.ndarray, bars: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        small = m.astype(np.float32)
    exact = bool((small == m).all())
    bars = np.where(np.isnan(bars), -np.inf, bars) if not np.isnan(bars).all() else bars[:0]
    body = (small if exact else m).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([bars.tobytes()], pa.binary()), pa.array([body], pa.binary()), pa.array([m.shape[1] if exact else -m.shape[1]], pa.int32())], ["ids", "bars", "matrix", "width"])


def _unpacked(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = batch.column("width")[r].as_py()
    ids, bars = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", np.int64), ("bars", np.float64)))
    m = np.frombuffer(batch.column("matrix")[r].as_buffer(), np.float32 if width > 0 else np.float64).reshape(-1, abs(width)).astype(np.float64)
    return ids, bars if len(bars) else np.full(len(ids), -np.inf), m


def wide(m: np.ndarray, width: int) -> np.ndarray:
    """Shorter vectors count as if zeros followed."""
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Search:
    """A group of queries and what each has found so far. `look` is a block's work."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, ids: np.ndarray, bars: np.ndarray, m: np.ndarray) -> None:
        self.parts.append((ids, bars, m))

    def start(self) -> None:
        width = max((m.shape[1] for _, _, m in self.parts), default=1)
        self.ids = np.concatenate([x for x, _, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.bar = np.concatenate([x for _, x, _ in self.parts]) if self.parts else np.zeros(0)
        self.m = np.concatenate([wide(m, width) for _, _, m in self.parts]) if self.parts else np.zeros((0, 1))
        self.parts.clear()
        self.heaps: list[list[tuple]] = [[] for _ in self.ids]
        self.ready = True

    def candidates(self, ids: np.ndarray, m: np.ndarray) -> None:
        if not self.ready:
            self.start()
        if len(self.ids) and len(ids):
            width = max(self.m.shape[1], m.shape[1])
            self.m = wide(self.m, width)
            self.look(ids, wide(m, width))

    def look(self, ids: np.ndarray, m: np.ndarray) -> None:
        raise NotImplementedError

    def keep(self, r: int, found: Iterator[tuple]) -> None:
        """Merges (key, -vec_id, score) into the heap of query r and raises its bar."""
        best = self.heaps[r] = heapq.nlargest(self.k, [*self.heaps[r], *found])
        if len(best) == self.k:
            self.bar[r] = max(self.bar[r], self.bar_of(best[-1]))

    def bar_of(self, worst: tuple) -> float:
        raise NotImplementedError

    def rows(self) -> Iterator[tuple[int, int, object]]:
        if not self.ready:
            self.start()
        for q, heap in zip(self.ids.tolist(), self.heaps, strict=True):
            for _, minus, score in heap:
                yield q, -minus, score


def order_of(score: float) -> tuple[bool, float]:
    """Sums that overflow both ways are nan, which stands above all others, as in SQL."""
    return (True, 0.0) if score != score else (False, score)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(c))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(c.shape[1]):
            total += q[:, k] * c[:, k]
    return total


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a largest component below 1, and the powers of two that were taken out of them."""
    e = np.frexp(np.abs(x).max(1, initial=0))[1]
    return np.ldexp(x, -e[:, None]), e


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what rounding took away, and the norms of what is left of the rows."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    small = np.rint(x / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int8 product tile, exact: floats hold its whole numbers as long as they stay below their precision."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


class Nearest(Search):
    """Largest inner products in double precision, by int8 tiles."""

    def look(self, ids: np.ndarray, m: np.ndarray) -> None:
        c, ce = unit(m)
        top = int(ce.max())
        c8, cs, cerr, _ = quantised(c)
        norm = np.linalg.norm(c, axis=1)
        share = np.ldexp(1.0, np.maximum(ce - top, -1060))  # of the block's largest power of two
        slack = 8 * (m.shape[1] + 8) * 2.0**-52  # rounding of sums, here and in the exact products, as a part of the norms' product
        for at in range(0, len(self.ids), STRIP):
            s = slice(at, at + STRIP)
            q, qe = unit(self.m[s])
            q8, qs, qerr, left = quantised(q)
            qnorm = np.linalg.norm(q, axis=1)
            about = products(q8, c8) * qs[:, None] * (cs * share)[None, :]
            off = ((qerr[:, None] * norm[None, :] + left[:, None] * cerr[None, :]) * (1 + 1e-9) + slack * qnorm[:, None] * norm[None, :]) * share[None, :] + 1e-300
            low, high = about - off, about + off
            power = qe[:, None] + ce[None, :]
            over = (power + math.ceil(math.log2(m.shape[1] + 1)) >= 1020) | (power <= -900)  # what may leave the range of doubles has no bounds
            if over.any():
                low[over], high[over] = -np.inf, np.inf
            own = self.ids[s, None] == ids[None, :]
            low[own] = high[own] = -np.inf
            with np.errstate(over="ignore"):
                bar = np.ldexp(self.bar[s], -(qe + top))
            if len(ids) > self.k:
                bar = np.maximum(bar, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            rows, places = np.nonzero((high >= bar[:, None]) & ~own)
            scores = np.empty(len(rows))
            for k in range(0, len(rows), 65_536):
                part = slice(k, k + 65_536)
                scores[part] = inner(self.m[at + rows[part]], m[places[part]])
            ends = np.searchsorted(rows, np.arange(len(low) + 1))
            for r in np.flatnonzero(np.diff(ends)).tolist():
                part = slice(ends[r], ends[r + 1])
                self.keep(at + r, ((order_of(x), minus, x) for x, minus in zip(scores[part].tolist(), (-ids[places[part]]).tolist(), strict=True)))

    def bar_of(self, worst: tuple) -> float:
        nan, score = worst[0]
        return math.inf if nan else score


class Lists:
    """A block's candidates in one sorted list a component."""

    def __init__(self, c: np.ndarray) -> None:
        self.c, self.n = c, len(c)
        order = np.argsort(c, axis=0, kind="stable")
        self.sorted = np.take_along_axis(c, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], 0)
        self.square = c * c
        self.norm = self.square.sum(1)

    def read(self, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For lists read from the top and from the bottom: what was read (1 or 0), where lists stand, their other ends."""
        s, kind = self.sorted, self.c.dtype
        return [((self.place >= self.n - depth).astype(kind), s[self.n - depth], s[0]), ((self.place < depth).astype(kind), s[depth - 1], s[-1])]


def bounds(q: np.ndarray, lists: Lists, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores (queries x candidates) from what lies before `depth` in the lists.

    What was read of a candidate counts. Each component not yet read lies between the list's other end and where it stands; all of them
    together can't give more than the product of their norms.
    """
    known = worst = best = unread = 0
    rest = lists.norm[None, :]
    for part, (got, stand, end) in zip((np.maximum(q, 0), np.minimum(q, 0)), lists.read(depth), strict=True):
        known = known + part @ (lists.c * got).T
        at, far = part * stand, part * end
        best = best + at.sum(1, keepdims=True) - at @ got.T
        worst = worst + far.sum(1, keepdims=True) - far @ got.T
        unread = unread + (part * part) @ (1 - got).T
        rest = rest - (part != 0).astype(got.dtype) @ (lists.square * got).T
    if depth < lists.n:
        # what rounding may have taken from the norms is given back: it grows with the number of components
        slack = max(1e-5, 4 * (lists.c.shape[1] + 8) * float(np.finfo(lists.c.dtype).eps))
        norms = np.sqrt(np.maximum(unread + slack * (q * q).sum(1, keepdims=True), 0) * (np.maximum(rest, 0) + slack * lists.norm[None, :])) * (1 + slack) + slack * np.abs(known)
        norms += 1 if lists.norm.max(initial=0) > 1 else 0
        best, worst = np.minimum(best, norms), np.maximum(worst, -norms)
    return known + worst, known + best


def scaled(m: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * m); where that leaves the range of doubles it is infinite, and `resolve` works on whole numbers."""
    with np.errstate(over="ignore"):
        return np.floor(factor * m)


def exact(x: float, factor: int) -> int:
    return math.floor(factor * x) if abs(x) < 2.0**900 else factor * int(x)


class TopScores(Search):
    """Highest whole-number inner products of floor(factor * x), by sorted lists. `read` of `held` list entries were looked at."""

    def __init__(self, k: int, factor: int = 256) -> None:
        super().__init__(k)
        self.factor = factor
        self.read = self.held = 0

    def look(self, ids: np.ndarray, m: np.ndarray) -> None:
        qm = self.m
        most = max(float(np.abs(qm).max()), 1 / self.factor) * max(float(np.abs(m).max()), 1 / self.factor)
        sums = most * (self.factor + 1) ** 2 * m.shape[1] if most < 1e200 else math.inf
        fits = sums < 2**50
        if fits:
            kind = np.float32 if sums < 2**22 else np.float64  # whole numbers that the kind holds exactly
            q, c, power = scaled(qm, self.factor).astype(kind), scaled(m, self.factor).astype(kind), 0
        else:  # below 1, with bounds a little wider; `resolve` has the whole numbers
            (q, qe), (c, ce) = ((np.ldexp(x, -e), e) for x, e in ((x, int(np.frexp(np.abs(x).max())[1])) for x in (qm, m)))
            power = qe + ce
        lists = Lists(c)
        unit_ = self.factor**2 if not fits else 1
        for at in range(0, len(self.ids), STRIP):
            rows = np.arange(at, min(at + STRIP, len(self.ids)))
            for step in range(1, STEPS + 1):
                depth = -(-step * len(ids) // STEPS)
                low, high = bounds(q[rows], lists, depth)
                if not fits:
                    # floor takes less than 1 from each side's components
                    wide_ = 1e-9 * (np.abs(q[rows]).sum(1, keepdims=True) * np.abs(c).max() + 1) + math.ldexp(1.0, -min(qe, 900)) + math.ldexp(1.0, -min(ce, 900))
                    edge = math.ldexp(1.0, max(-1000, 63 - power)) / unit_
                    low, high = (np.clip(x, -edge, edge) for x in (low - wide_ * m.shape[1], high + wide_ * m.shape[1]))
                own = self.ids[rows, None] == ids[None, :]
                low[own] = high[own] = -np.inf
                bar = np.ldexp(self.bar[rows], -power) / unit_
                if len(ids) > self.k:
                    bar = np.maximum(bar, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
                able = (high >= bar[:, None]) & ~own
                done = (able.sum(1) <= OPEN * self.k) | (step == STEPS)
                self.held += len(rows) * lists.c.size if step == 1 else 0
                self.read += int(done.sum()) * depth * c.shape[1]
                for r, places in ((int(rows[x]), np.flatnonzero(able[x])) for x in np.flatnonzero(done)):
                    if len(places):
                        self.keep(r, zip(scores := self.resolve(qm[r], m[places], fits), (-ids[places]).tolist(), scores, strict=True))
                rows = rows[~done]
                if not len(rows):
                    break

    def resolve(self, q: np.ndarray, c: np.ndarray, fits: bool) -> list[int]:
        """Final scores, held to the range of a long."""
        if fits:
            return (scaled(c, self.factor) @ scaled(q, self.factor)).astype(np.int64).tolist()
        ours = [exact(x, self.factor) for x in q.tolist()]
        return [max(-LARGEST - 1, min(LARGEST, sum(a * exact(b, self.factor) for a, b in zip(ours, row, strict=True)))) for row in c.tolist()]

    def bar_of(self, worst: tuple) -> float:
        return math.nextafter(float(worst[0]), -math.inf) if abs(worst[0]) >= 2**53 else float(worst[0])


def rounds(asked: DataFrame, blocks: DataFrame, groups: int, slices: int, taken: tuple[int, int], search: Callable[[], Search], kind: str, zero: bool) -> DataFrame:
    """(query_id, vec_id, score): what each task of the slices from taken[0] to below taken[1] finds."""
    number = pa.float64() if kind == "double" else pa.int64()
    first, last = taken
    # blocks are numbered by partition and by place in it: both count, so that they are dealt evenly
    spread = lambda c, n: F.pmod(F.shiftright(c, 33) + F.col(c).bitwiseAND(2**33 - 1), F.lit(n)).cast("int")
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    columns = ["task", "side", "ids", "bars", "matrix", "width"]
    left = packed(asked, zero).withColumn("slice", every(first, last)).withColumn("task", spread("place", groups) * (last - first) + F.col("slice") - first).withColumn("side", F.lit(0)).select(*columns)
    mine = blocks.withColumn("slice", spread("place", slices)).filter(F.col("slice").between(first, last - 1))
    right = mine.withColumn("group", every(0, groups)).withColumn("task", F.col("group") * (last - first) + F.col("slice") - first).withColumn("side", F.lit(1)).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, None

        def done() -> pa.RecordBatch:
            out = [*now.rows()] if now else []
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in enumerate((pa.int64(), pa.int64(), number))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                if (name := batch.column("task")[r].as_py()) != task:
                    yield done()
                    now, task = search(), name
                ids, bars, m = _unpacked(batch, r)
                if batch.column("side")[r].as_py():
                    now.candidates(ids, m)
                else:
                    now.add(ids, bars, m)
        yield done()

    both = left.unionByName(right).repartitionById(groups * (last - first), F.col("task")).sortWithinPartitions("task", "side")
    return both.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def merged(found: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query's rows, by a heap a query as its rows stream by."""
    number = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        query, heap = None, []

        def close() -> None:
            out.extend((query, n, -minus, score) for n, (_, minus, score) in enumerate(sorted(heap, reverse=True), 1))
            heap.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.int64(), number))], ["query_id", "rank", "vec_id", "score"])
            out.clear()
            return made

        for batch in batches:
            for q, v, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    close()
                    query = q
                push = heapq.heappush if len(heap) < k else heapq.heappushpop
                push(heap, (order_of(score), -v, score))
            if len(out) > 50_000:
                yield batch_of()
        close()
        yield batch_of()

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, f"query_id long, rank int, vec_id long, score {kind}")


def takes_part(zero: bool) -> Column:
    """Whether a row's vector is whole: not null, with no null or non-finite component; with zero=False also not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    whole_ = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd)
    return whole_ if zero else whole_ & F.exists("embedding", lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int, by: Callable[[], Search], kind: str, zero: bool, group_bytes: int = GROUP_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; `by` makes a task's Search."""
    asked = written(queries.filter(takes_part(zero)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = written(packed(vectors, zero), "candidates")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("embedding") + 8), F.lit(0)).alias("bytes")).first().bytes
    n, held = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("matrix")), F.lit(0))).first()
    groups = max(1, math.ceil(size / group_bytes))
    # small tables are dealt to all cores
    slices = max(1, math.ceil(held / slice_bytes), min(n, math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / groups)))
    first = math.isqrt(slices - 1) + 1 if slices > 1 else 1
    found = rounds(asked, blocks, groups, slices, (0, first), by, kind, zero)
    if first < slices:
        found = written(merged(found, k, kind), "found")
        bars = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
        more = rounds(asked.join(bars, "vec_id", "left"), blocks, groups, slices, (first, slices), by, kind, zero)
        found = found.select("query_id", "vec_id", "score").unionByName(more)
    return merged(found, k, kind)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, **how: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product with each query's, its own id left out.

    Exact: bounds only leave out what can't qualify. Ties go to the smaller vec_id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without vec_id; shorter vectors count as if zeros followed. Rows that
    repeat a vec_id are candidates of their own, as a query an id is asked once, with its least vector that takes part. Sums that leave the range of doubles are infinite, or nan, which
    stands above all. Extra columns are left out; empty tables give empty results.
    """
    return search(vectors.select("vec_id", "embedding"), queries, k, lambda: Nearest(k), "double", zero=False, **how)


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: int = 256, **how: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest whole-number inner products of floor(factor * x), exact.

    Ties go to the smaller vec_id; a query's own id is left out. Vectors that are null or hold null or non-finite components
    take no part, nor do rows without vec_id; zero vectors do, with score 0. Scores beyond a long are held to its range. Repeats, lengths,
    extra columns and empty tables as in `nearest`.
    """
    return search(vectors.select("vec_id", "embedding"), queries, k, lambda: TopScores(k, factor), "long", zero=True, **how)
