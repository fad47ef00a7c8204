r"""Near-duplicate documents by MinHash with tensored banding, links confirmed on whole shingle sets.

1. One pass over the texts gives each document the size of its set of word shingles, a digest of the set and 2 x M sub-keys:
   two collections of M, each sub-key from ROWS minhashes.
2. Documents with equal sets are one class; only its first document goes on.
3. Tensoring: a table key is a pair of sub-keys, one of each collection, so that 2 x M x ROWS minhashes serve M x RING tables of 2 x ROWS rows: each
   sub-key of the first collection is paired with RING neighbours of the second.
   A table key can only be shared by documents that share both of its sub-keys, so sub-keys that stand alone are dropped before pairs
   are formed: nothing is lost, and unlike documents never expand.
4. Candidates: each document with the first document of its buckets that it meets most often. Confirmed links are joined to
   components, and again with the firsts of other components. What a component holds needs no further check. Buckets that then still hold
   several components are looked at pair by pair, each set of documents once, in tiles of bounded size, without emitting a pair: each document has a
   bitmap in which every shingle flips one bit, and two bitmaps never differ in more bits than the sets differ in shingles. Only pairs
   that this bound and their sizes allow are emitted. No cap: a pair is left out only when it can't be a link or can't change a component.
5. A link is confirmed on the full sets: 100 * intersection >= 85 * union.

A pair is missed if no two paired tables agree in both sub-keys; `miss` bounds how likely that is. At the threshold itself (s = 0.85, 3 rows, M = 18,
RING = 8) it is below 3.1e-7; the pipeline, which links from 0.80 on, takes M = 36 and RING = 6: below 4.9e-7. Two documents of similarity 0.3, as common
boilerplate makes them, share a table with a probability of 0.10, those of 0.1 with 0.00014.
With exact=True nothing is missed: keys are then the least hashes of a set, so many that two linked sets must share one of them.

Documents that are alike in large numbers meet at hubs: the first of a bucket, the least id of a component, the digest of a text. Rows of a hub are
salted: spread over several tasks, with the one row of a set or label that they are joined with repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import by_size, forget, written

WORDS = 5
PERCENT = 85
ROWS, M, RING = 3, 18, 8
SEED = 20_240_229
#: Documents of a bucket that a task looks at together, twice, and bytes of their bitmaps, about.
TILE, TILE_BYTES = 2048, 16 << 20
#: So many of the most frequent keys with so many rows are hubs.
HUBS, MANY = 1000, 10_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made



def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS, known: _Words | None = None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles. bytes.lower and bytes.split know ASCII alone, as is asked for."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map((_Words() if known is None else known).__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * _MIX + hashes[k : len(found) - size + 1 + k])
    return np.unique(total)


def _coefficients(rows: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, 2 * m * rows, np.uint64)
    return draw() | np.uint64(1), draw()


def sub_keys(shingles: np.ndarray, rows: int = ROWS, m: int = M) -> np.ndarray:
    """2 x m sub-keys: the first m are one collection's, the others the second's."""
    a, b = _coefficients(rows, m)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[None, at : at + 2048] * a[:, None]
        values += b[:, None]
        values ^= values >> np.uint64(32)
        np.minimum(least, values.min(1), out=least)
    key = np.arange(2 * m, dtype=np.uint64)
    for column in least.reshape(2 * m, rows).T:
        key = mixed(key * _MIX + column)
    return key.view(np.int64)


def miss(similarity: float, rows: int = ROWS, m: int = M, ring: int = RING) -> float:
    """A bound of the probability that a pair of this similarity shares no table: a sub-keys of the first collection have a + ring - 1 different partners at least."""
    p = similarity**rows
    q = 1 - p
    return q**m + sum(math.comb(m, a) * p**a * q ** (m - a) * q ** min(m, a + ring - 1) for a in range(1, m + 1))


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(few) < percent * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def least_hashes(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """So many of a set's least hashes that two sets which share none of theirs can't be linked: what a linked set may lack, and one."""
    return shingles[: len(shingles) - -(-percent * len(shingles) // 100) + 1].view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, keys_of: Callable[[np.ndarray], np.ndarray] = sub_keys) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, known)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(keys_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bitmap of 4 to 8 bits a shingle, 256 at least: bit k says whether an odd number of shingles has k as its low bits."""
    width = max(256, 1 << (4 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles, bits) of the documents that `wanted` (node) names, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([bitmap(x) for x in sets], pa.binary())], ["node", "shingles", "bits"])

    few = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(by_size(wanted), "node", "left_semi")
    return few.mapInArrow(run, "node long, shingles binary, bits binary")


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def possible(nodes: np.ndarray, n: np.ndarray, part: np.ndarray, chunk: np.ndarray, bits: list[bytes], across: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that bitmaps and sizes allow to be links, of different components; with `across`, of different chunks."""
    width = np.array([len(b) // 8 for b in bits])
    off = 100 - percent
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        wide = np.flatnonzero(width == 2 * w)
        mine = np.frombuffer(b"".join([bits[k] for k in own]), np.uint64).reshape(len(own), w)
        theirs = np.concatenate([mine, folded(np.frombuffer(b"".join([bits[k] for k in wide]), np.uint64).reshape(len(wide), 2 * w))])
        at = np.concatenate([own, wide])
        for k, x in enumerate(own.tolist()):
            rest = at[k + 1 :]
            able = (part[rest] != part[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
            if across:
                able &= chunk[rest] != chunk[x]
            if able.any():
                to = np.flatnonzero(able)
                differ = np.bitwise_count(theirs[k + 1 + to] ^ mine[k]).sum(1, dtype=np.int64)
                for y in rest[to[(100 + percent) * differ <= off * (n[x] + n[rest[to]])]].tolist():
                    yield (int(nodes[x]), int(nodes[y])) if nodes[x] < nodes[y] else (int(nodes[y]), int(nodes[x]))


def open_pairs(inside: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of `inside` (key, node, n, part, bits, tiles): pairs that share a bucket and may link two components."""
    chunk = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    dealt = inside.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "n", "part", "chunk", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: set[tuple[int, int]] = set()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        def look() -> None:
            if len(held) > 1:
                nodes, n, part, chunk = (np.array([r[k] for r in held]) for k in (3, 4, 5, 6))
                out.update(possible(nodes, n, part, chunk, [r[7] for r in held], held[0][1] != held[0][2], percent))

        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    look()
                    held.clear()
                held.append(row)
            if len(out) > 20_000:
                yield batch()
                out.clear()
        look()
        yield batch()

    keys = ["key", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, repeats: bool = False) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are linked; with `repeats` a b may stand in many pairs, as an a may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    pairs = pairs.select("a", "b")
    return salted(salted(pairs, one, "a", hubs(pairs, "a")), two, "b", hubs(pairs, "b") if repeats else None).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def hubs(rows: DataFrame, key: str) -> DataFrame | None:
    """(key, salts): the HUBS most frequent values that have MANY rows or more; whatever has a thousandth of all rows is among them."""
    often = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= MANY)
    top = often.orderBy(F.col("n").desc(), key).limit(HUBS).collect()  # a thousand rows at most
    kind = dict(rows.dtypes)[key]
    return rows.sparkSession.createDataFrame([(r[key], min(HUBS, -(-r.n // MANY))) for r in top], f"{key} {kind}, salts int") if top else None


def salted(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """`rows` joined with `table` (one row a key) by `key`; with `hot`, rows of a hub are spread, and the table's row of it repeated."""
    if hot is None:
        return rows.join(table, key, how)
    salts = F.coalesce("salts", F.lit(1))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("salts")
    again = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return spread.join(again, [key, "_salt"], how).drop("_salt")


def handed(table: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a written table that can be forgotten like the table."""
    view.written_to = table.written_to
    return view


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): the least node that each can reach.

    Rounds of: take the least label around, then the label of that label. Each round is written to the shared folder.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "both")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    hot = hubs(both, "v")
    while True:
        around = salted(both, labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v", hot).groupBy("u").agg(F.min("l").alias("l"))
        lower = written(labels.join(around, "u").select("u", F.least("label", "l").alias("next"), "label"), "lower")
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("after"))
        moved = written(salted(lower, jump, "next", hubs(lower, "next")).select("u", F.least("next", "after").alias("new"), "label"), "labels")
        forget(lower, labels)
        labels = handed(moved, moved.select("u", F.col("new").alias("label")))
        still = moved.filter(F.col("new") != F.col("label")).isEmpty()
        if still:
            forget(both)
            return handed(moved, labels.select(F.col("u").alias("node"), F.col("label").alias("component")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, m: int = M, ring: int = RING, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links lead to, kept says that it is the row's own. Null, empty and blank texts
    have no shingles, are linked with nothing and kept. Rows that repeat a doc_id are seen as one document: their links
    unite. Rows with a null doc_id take no part: component_id is null and they are kept, unless their set is another row's. Texts are read whole, however long.
    With exact=True keys come from the sets themselves instead of minhashes, more of them the longer a text is. Extra
    columns are left out; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, words, (lambda s: least_hashes(s, percent)) if exact else (lambda s: sub_keys(s, rows, m))), "signatures")
    classes = written(signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"), F.any_value("n_shingles").alias("n")), "classes")
    nodes = classes.filter(F.col("node").isNotNull())

    single = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    if exact:
        keyed_nodes = single.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("tables"))
    else:
        of = lambda low: F.collect_list(F.when((F.col("place") < m) == low, F.struct((F.col("place") % m).alias("place"), "key")))
        places = single.join(shared, "key").groupBy("node").agg(of(True).alias("ones"), of(False).alias("twos"))
        near = lambda x: F.filter("twos", lambda y: F.pmod(y["place"] - x["place"], F.lit(m)) < ring)
        pairs = F.flatten(F.transform("ones", lambda x: F.transform(near(x), lambda y: F.xxhash64(x["key"], y["key"]))))
        keyed_nodes = places.select("node", pairs.alias("tables")).filter(F.size("tables") > 0)
    active = written(keyed_nodes.join(nodes.select("node", "n"), "node"), "active")
    keyed = active.select("node", "n", F.explode("tables").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
    firsts = keyed.join(buckets, "key").filter("node <> first").groupBy("node", "first").agg(F.count("*").alias("met"))
    size = active.select("node", "n")
    met = written(sized(firsts.select(F.col("first").alias("a"), F.col("node").alias("b"), "met"), size, percent), "met")
    named = written(active.select("node"), "nodes")
    sets = written(shingle_sets(docs, named, words), "sets")
    forget(named)

    def links(pairs: DataFrame, **how: bool) -> DataFrame:
        held = written(pairs, "pairs")
        found = written(confirmed(held, sets, percent, **how), "edges")
        forget(held)
        return found

    edges = links(most_met(met))
    label = components(edges)
    more = links(most_met(apart(met, label)))
    if not more.isEmpty():
        forget(label)
        label = components(edges.unionByName(more))

    part = keyed.join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))
    several = part.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("members"), F.sum(F.greatest("n", F.lit(32))).alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("h"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("g"))
    tiles = F.ceil(F.greatest(F.col("members") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
    unlike = several.filter("x < y").groupBy("members", "h", "g").agg(F.min("key").alias("key"), F.min(tiles).alias("tiles")).select("key", "tiles")  # buckets of the same documents are one
    inside = part.join(unlike, "key").join(sets.select("node", "bits"), "node")
    last = links(open_pairs(inside, percent), repeats=True)
    if not last.isEmpty():
        forget(label)
        label = components(edges.unionByName(more).unionByName(last))

    of = written(classes.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "found")
    forget(classes, active, met, sets, edges, more, last, label)
    rows_ = signed.select("doc_id", "n_shingles", "digest")
    out = salted(rows_, of, "digest", hubs(rows_, "digest"), "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of `docs`, all columns, without those whose group keeps another; of rows that repeat a doc_id one stays."""
    gone = written(near_duplicates(docs, **how).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    kept = docs.join(by_size(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    rest, again = kept.join(by_size(twice), "doc_id", "left_anti"), kept.join(by_size(twice), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return rest.unionByName(again.withColumn("_place", first).filter("_place = 1").drop("_place")).select(*docs.columns)


def one_of_each_text(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of `docs`, all columns, without those whose set of shingles is equal to or linked with that of a row that stays.

    Of linked rows the one with the least doc_id stays; rows without id come last. Only rows of equal or linked sets go: ids
    may repeat or be null. Of rows without shingles that repeat an id one stays.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if counts.isEmpty():
        return one_of_each(docs, **how)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col("_row"), "doc_id", F.xxhash64("text").alias("_text"))
    found = written(near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "found")
    placed = found.join(ids, "_row")
    # rows without shingles are alike if they repeat an id
    group = F.struct(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("d"), F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNull(), F.col("_row")).alias("r"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row")
    stay = placed.groupBy(group.alias("g")).agg(F.min_by("_row", order).alias("_row")).select("_row")
    gone = written(found.select("_row").join(stay, "_row", "left_anti"), "gone")
    return rows.join(by_size(gone), "_row", "left_anti").select(*docs.columns)


def fits(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def sized(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b, met) whose sizes allow a link."""
    x, y = size.select(F.col("node").alias("a"), F.col("n").alias("na")), size.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    return pairs.join(x, "a").join(y, "b").filter(fits(F.col("na"), F.col("nb"), percent)).select("a", "b", "met")


def most_met(met: DataFrame) -> DataFrame:
    """For each b of `met` (a, b, met) the a that it meets most often, the least of equal ones."""
    return met.groupBy("b").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("a")).select("a", "b")


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b, met) that lie in different components."""
    x, y = label.select(F.col("node").alias("a"), F.col("component").alias("pa")), label.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b", "met")
