r"""Token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens that haven't been met yet are held as one ragged array of symbols. In each step every sequence's lowest-ranked pair is found and
all its occurrences are merged at once, in all sequences; sequences with no pair left are put aside, and what is left of each is counted. Merging all
occurrences at once is right because a merge makes a token that only later merges take: the file is checked for that. Sequences of more than
LONG symbols keep their pairs in places by rank, so that a step touches only what it merges, and time grows with the length and not with length times steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.bpe import LATER, byte_alphabet, public_path

#: Characters of a text that are cut into pre-tokens at once, about, and pre-tokens that are looked at together.
PIECE, WORDS = 1 << 20, 1 << 19
#: Symbols from which on a sequence keeps its pairs by rank.
LONG = 512
#: Pre-tokens whose counts a worker keeps, and how long they may be.
STORE, STORED = 400_000, 48
#: How the file's kind of pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
_SHIFT = 20


class Merges:
    """A merge list over numbers. Symbols 0 to 255 are the bytes, 256 + r is what merge r makes."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        number = {c: b for b, c in enumerate(byte_alphabet())}
        pairs = []
        for rank, (a, b) in enumerate(merges):
            if a not in number or b not in number or a + b in number:
                raise ValueError(f"merge {rank} doesn't make a new token from older ones")
            pairs.append(number[a] << _SHIFT | number[b])
            number[a + b] = 256 + rank
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = np.array(pairs, np.int64)[order], order.astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they aren't merged."""
        key = a.astype(np.int64) << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The symbols left of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = size.copy()
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.long_count(np.frombuffer(words[k], np.uint8).astype(np.int32))
        few = np.flatnonzero((size > 1) & (size <= LONG))
        if len(few):
            out[few] = self.ragged_counts(b"".join([words[k] for k in few.tolist()]), size[few])
        return out

    def ragged_counts(self, flat: bytes, size: np.ndarray) -> np.ndarray:
        """The symbols left of sequences that lie one behind the other."""
        sym = np.frombuffer(flat, np.uint8).astype(np.int32)
        out = size.copy()
        name, size = np.arange(len(size)), size.copy()  # of the sequences that are still merging
        last = np.cumsum(size) - 1
        rank = np.append(self.rank(sym[:-1], sym[1:]), NONE)
        rank[last] = NONE
        while True:
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            going = low != NONE
            if not going.all():
                out[name[~going]] = size[~going]
                kept = np.repeat(going, size)
                sym, rank, name, size, low = sym[kept], rank[kept], name[going], size[going], low[going]
            if not len(name):
                return out
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[alternate(hit, hit[1:] == hit[:-1] + 1)]
            owner = np.searchsorted(np.cumsum(size), hit, side="right")
            sym[hit] = 256 + rank[hit]
            kept = np.ones(len(sym), bool)
            kept[hit + 1] = False
            closed = np.zeros(len(sym), bool)  # the last symbol of a sequence
            closed[np.cumsum(size) - 1] = True
            closed[hit] |= closed[hit + 1]
            sym, rank, closed = sym[kept], rank[kept], closed[kept]
            size = size - np.bincount(owner, minlength=len(size))
            at = hit - np.arange(len(hit))
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[~closed[near]]
            rank[at[closed[at]]] = NONE
            rank[near] = self.rank(sym[near], sym[near + 1])

    def long_count(self, sym: np.ndarray) -> int:
        """The symbols left of a single long sequence."""
        n = len(sym)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.rank(sym[at], sym[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for some in np.split(np.arange(len(at)), cuts) if len(at) else []:
                r = int(rank[some[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[some])

        put(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.rank(sym[at], sym[after[at]]) == r]
            at = at[alternate(at, at[1:] == after[at[:-1]])]
            if not len(at):
                continue
            gone = after[at]
            sym[at], alive[gone] = 256 + r, False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            put(np.unique(np.concatenate([at, left[left >= 0]])))
        return int(alive.sum())


def alternate(at: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which of the places are merged: in a run of joined ones every other, from the left."""
    if not len(at):
        return np.zeros(0, bool)
    start = np.concatenate([[True], ~joined])
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(start, number, 0))) % 2 == 0


def plain(text: str) -> bool:
    """Whether all characters are of Latin-1, whose classes all versions of Unicode share."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counter:
    """A tokenizer file: special tokens, pre-tokens, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer") or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no byte-level BPE without prefix space and normaliser")
        self.merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        marks = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.marks, self.mark = marks, regex.compile("|".join(map(regex.escape, marks)))
        later = "".join(regex.sub("([0-9a-f]+)", lambda m: chr(int(m[1], 16)), LATER).split())
        self.later = regex.compile(f"[{later}]")
        self.word = regex.compile(PATTERN, regex.V0)
        pattern = PATTERN
        for plain, kept in ((r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])+"), (r" ?\p{L}+", rf" ?(?:(?![{later}])\p{{L}})+"), (r" ?\p{N}+", rf" ?(?:(?![{later}])\p{{N}})+")):
            pattern = pattern.replace(plain, kept)
        self.word_of_later = regex.compile(pattern, regex.V0)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.store: dict[str, int] = {}
        self.passing: list[str] = []

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces, cut before single spaces, where no pre-token goes on."""
        at = 0
        while len(text) - at > PIECE and (m := self.cut.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def words(self, piece: str) -> tuple[int, list[str]]:
        """(special tokens, pre-tokens) of a piece."""
        found = self.word if plain(piece) or not self.later.search(piece) else self.word_of_later
        if not any(m in piece for m in self.marks):
            return 0, found.findall(piece)
        parts = self.mark.split(piece)
        return len(parts) - 1, [w for part in parts for w in found.findall(part)]

    def known(self, words: set[str]) -> dict[str, int]:
        """Counts of these pre-tokens and of others; those not met before are merged together. Long ones are given up with the next call."""
        for w in self.passing:
            self.store.pop(w, None)
        new = [*words.difference(self.store)]
        if len(self.store) + len(new) > STORE:
            self.store = {w: self.store[w] for w in words.intersection(self.store)}
        self.store.update(zip(new, self.merges.counts([w.encode("utf-8") for w in new]).tolist(), strict=True))
        self.passing = [w for w in new if len(w) > STORED]
        return self.store

    def counts(self, texts: Iterator[str | None]) -> Iterator[int]:
        """Of each text in turn; as many texts as come to WORDS pre-tokens are looked at together."""
        held: list[tuple[int, list[str]]] = []  # place of the text, its pre-tokens
        total: list[int] = []
        size = 0

        def settle() -> None:
            known = self.known(set().union(*(w for _, w in held)))
            for k, words in held:
                total[k] += sum(map(known.__getitem__, words))
            held.clear()

        for text in texts:
            total.append(0)
            for piece in self.pieces(text or ""):
                special, words = self.words(piece)
                total[-1] += special
                held.append((len(total) - 1, words))
                size += len(words)
                if size >= WORDS:
                    settle()
                    size = 0
        settle()
        return iter(total)


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """All columns (but older ones of these names) with n_bytes, n_tokens and over_limit, of every whole text; a null text is empty.

    `path` is the tokenizer file, which every machine must have. Special tokens' strings count as one token each, as the library has it. Rows are independent: ties, repeated rows,
    nulls in other columns and empty tables need nothing special. A worker holds the texts of an Arrow batch, WORDS pre-tokens, and of the longest pre-token some 30 bytes a byte.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = counter(path or public_path("byte_bpe_50k.json"))
        for batch in batches:
            n = pa.array([*how.counts(x.as_py() for x in batch.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n_tokens"])

    counted = docs.mapInArrow(run, f"{fields}, n_tokens long")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})
