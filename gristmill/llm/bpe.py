r"""BPE encoding and decoding as a streaming transducer.

The merge list has a sufficient lookahead: whether a merge (u, v) takes place is open only as long as an earlier merge can
take v, or a part at v's right end, away to the right, which in turn an earlier merge can prevent, and so on. Ranks
fall along such a chain, so the longest one of each token is found in a single pass over the merges. A token that ends that many symbols
before the end of what has been read is final, as is every token once its word has ended. The transducer reads symbols little by little, emits what is final and keeps
the rest: its memory is bounded by the lookahead, not the word. Words of all lengths take this way.

Texts are cut at white space, which no token crosses, and the transducer's answers are kept by word in a bounded store.
Decoding is a state machine over the tokens' bytes that emits text as bytes complete characters.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of a word that are read at once, at least.
READ = 16
#: Words whose answers a worker keeps, twice, and how long they may be.
STORE, STORED = 150_000, 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


BYTE_OF = {c: b for b, c in enumerate(byte_alphabet())}


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> dict[str, int]:
    """For each token, the symbols beyond its end that decide whether it stays as it is: while none of them can take it or a part at its right end."""
    parts: dict[str, str] = {}
    reach: dict[str, int] = {}

    def open_to(token: str | None) -> int:
        most = 0
        while token is not None:  # the token itself, its right part, that one's right part ...
            most = max(most, reach.get(token, 0))
            token = parts.get(token)
        return most

    for left, right in merges:
        most = open_to(right)
        parts.setdefault(left + right, right)
        reach[left] = max(reach.get(left, 0), length[right] + most)
    return {t: open_to(t) for t in length}


class Transducer:
    """Symbols in, token ids out as soon as they are final."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        bare = lambda t: t.removesuffix(end) if end and t != end else t
        needs = sufficient_lookahead(merges, {t: len(bare(t)) for t in vocab})
        self.lookahead = max(needs.values(), default=0)
        self.need = {i: needs[t] for t, i in vocab.items()}
        self.length = {i: len(bare(t)) for t, i in vocab.items()}
        self.bits = max(vocab.values(), default=0).bit_length()
        self.made = [vocab[a + b] for a, b in merges]
        self.rank = {vocab[a] << self.bits | vocab[b]: k for k, (a, b) in reversed([*enumerate(merges)])}
        self.closed = {i: vocab[t + end] for t, i in vocab.items() if t + end in vocab}

    def tokens(self, ids: list[int]) -> list[int]:
        """The merges in the order of their ranks, of equal ones the leftmost first."""
        if len(ids) > 200:
            return self.long_tokens(ids)
        get, bits, made, none = self.rank.get, self.bits, self.made, 1 << 40
        ranks = [get(a << bits | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            k = ranks.index(best)
            new = made[best]
            ids[k] = new
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << bits | ids[k + 1], none)
            if k:
                ranks[k - 1] = get(ids[k - 1] << bits | new, none)
        return ids

    def long_tokens(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n in the number of symbols."""
        get, bits = self.rank.get, self.bits
        sym: list[int] = [*ids]
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        heap = [(r, k) for k, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (r := get(a << bits | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            n = after[k]
            if sym[k] < 0 or n < 0 or get(sym[k] << bits | sym[n]) != r:
                continue
            sym[k], sym[n] = self.made[r], -1
            after[k] = m = after[n]
            if m >= 0:
                before[m] = k
                if (q := get(sym[k] << bits | sym[m])) is not None:
                    heapq.heappush(heap, (q, k))
            if (p := before[k]) >= 0 and (q := get(sym[p] << bits | sym[k])) is not None:
                heapq.heappush(heap, (q, p))
        return [x for x in sym if x >= 0]

    def encode(self, word: Iterable[int]) -> Iterator[int]:
        """Ids of one word's symbols, each as soon as it is final.

        Reads as much again as is kept, so that no symbol is looked at often and never much more than the lookahead is held.
        The last symbol read counts as unknown: if the word ends with it, it is another one.
        """
        kept: list[int] = []
        source = iter(word)
        while True:
            wanted = max(READ, len(kept))
            some = [*itertools.islice(source, wanted)]
            kept += some
            if len(some) < wanted:  # the word has ended
                if kept:
                    kept[-1] = self.closed.get(kept[-1], kept[-1])
                yield from self.tokens(kept)
                return
            left, done = len(kept) - 1, 0
            for t in self.tokens(kept[:-1]):
                left -= self.length[t]
                if left < self.need[t]:
                    break
                done += self.length[t]
                yield t
            kept = kept[done:]


class Decoder:
    """Ids in, text out: each id's bytes go through a UTF-8 state machine, which emits a character with its last byte.

    `pieces` has the bytes of each id; other ids have none. With `between`, so many characters are left out at the text's start.
    """

    def __init__(self, pieces: dict[int, bytes], between: int = 0) -> None:
        self.pieces, self.skip = pieces, between
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed_all(self, ids: Iterable[int]) -> str:
        out = self.machine.decode(b"".join([p for p in map(self.pieces.get, ids) if p]))
        if self.skip and out:
            out, self.skip = out[self.skip :], 0
        return out

    def feed(self, token: int) -> str:
        return self.feed_all((token,))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


#: Code points (hexadecimal) that are letters or numbers only in later versions of Unicode than the tokenizer has.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
#: Capitals of later versions than Python has, and their small letters.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

#: White space as the tokenizer's patterns mean it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Tokenizer:
    """A word-end BPE tokenizer file: normalisation, pieces, special tokens, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.transducer = Transducer(model["vocab"], merges, self.end)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.shown = {i: b" " + t.encode() for i, t in self.tokens.items()}
        spelt = lambda t: bytes(BYTE_OF[c] for c in t.removesuffix(self.end)) + b" " if self.end and t.endswith(self.end) else bytes(BYTE_OF[c] for c in t)
        self.spelt = {i: t.encode() if t in self.special else spelt(t) for i, t in self.tokens.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern, later = split["pattern"]["Regex"], "".join(regex.sub("([0-9a-f]+)", lambda m: chr(int(m[1], 16)), LATER).split())
        self.piece, self.later = regex.compile(pattern, regex.V0), regex.compile(f"[{later}]")
        for plain, kept in ((r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])+"), (r"[\p{L}]+", rf"(?:(?![{later}])\p{{L}})+"), (r"[\p{N}]", rf"(?![{later}])\p{{N}}")):
            pattern = pattern.replace(plain, kept)
        self.piece_of_later = regex.compile(pattern, regex.V0)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = tuple(self.special)
        self.spaces, self.odd = regex.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")
        self.symbol = [model["vocab"][c] for c in byte_alphabet()]
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> Iterable[str]:
        """Runs without white space. str.split also cuts at four control characters that are no white space here."""
        return text.split() if not self.odd.search(text) else (w for w in self.spaces.split(text) if w)

    def pieces(self, word: str) -> list[tuple[bool, str]]:
        """(special, piece) of a word: special tokens, and pieces of what is between them, normalised."""
        out = []
        for k, part in enumerate(self.cut.split(word) if "<" in word and any(m in word for m in self.marks) else (word,)):
            if k % 2:
                out.append((True, part))
            elif part:
                piece = self.piece
                if part.isascii():
                    part = part.lower()
                else:
                    part = "".join(map(str.lower, unicodedata.normalize("NFC", part))).translate(LOWER)
                    piece = self.piece_of_later if self.later.search(part) else piece
                out += [(False, p) for p in piece.findall(part)]
        return out

    def piece_answer(self, piece: str) -> bytes:
        """Of a normalised piece, which its own kind of word may have made known already."""
        if (made := self.known(piece)) is None:
            raw = piece.encode("utf-8", "surrogatepass")
            made = array("I", self.transducer.encode(map(self.symbol.__getitem__, raw))).tobytes()
            self.keep(piece, made)
        return made

    def known(self, word: str) -> bytes | None:
        made = self.store.get(word)
        return self.older.get(word) if made is None else made

    def keep(self, word: str, made: bytes) -> None:
        if len(word) <= STORED:
            if len(self.store) >= STORE:  # words not met since the last time go
                self.older, self.store = self.store, {}
            self.store[word] = made

    def decoder(self, text: bool = False) -> Decoder:
        """With `text`, words with a space behind each; without, what the library gives for a file that names no decoder: the tokens, a space between."""
        return Decoder(self.spelt) if text else Decoder(self.shown, between=1)

    def answer(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        if (made := self.known(word)) is None:
            # words differ in case and in what surrounds them; their pieces are often known
            made = b"".join([array("I", [self.special[p]]).tobytes() if special else self.piece_answer(p) for special, p in self.pieces(word)])
        self.keep(word, made)
        return made

    def forget(self) -> None:
        """Gives up the words known; workers outlive their tasks, and others need the memory."""
        self.store, self.older = {}, {}

    def blocks(self, text: str, words: int = 8192) -> Iterator[bytes]:
        """The text's ids, some thousand words at a time."""
        source = iter(self.words(text))
        while some := [*itertools.islice(source, words)]:
            got = [*map(self.store.get, some)]
            if None in got:
                got = [self.answer(w) if x is None else x for x, w in zip(got, some, strict=True)]
            yield b"".join(got)

    def encode(self, text: str) -> Iterator[int]:
        for block in self.blocks(text):
            yield from np.frombuffer(block, "<u4").tolist()


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; a null text is empty.

    `path` is the tokenizer file, which every machine must have; by default the public one. Rows are independent, so ties, repeated rows and empty tables need
    nothing special; words of any length pass through the transducer in blocks. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path or public_path())
        for rows in batches:
            n, a, b = [], [], []
            for text in rows.column(1):
                ids, decoded, total, decoder = hashlib.sha256(), hashlib.sha256(), 0, tok.decoder()
                for block in tok.blocks(text.as_py() or ""):
                    ids.update(block)
                    total += len(block) // 4
                    decoded.update(decoder.feed_all(array("I", block)).encode())
                decoded.update(decoder.finish().encode())
                n.append(total)
                a.append(ids.hexdigest())
                b.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tok.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of `docs` (but an older `out`) with `out`: the ids of `text`; a null text gives no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path or public_path())
        for rows in batches:
            ids = [[*tok.encode(x.as_py() or "")] for x in rows.column(text)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], [*rows.schema.names, out])
        tok.forget()

    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out}` array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded", text: bool = True) -> DataFrame:
    """All columns with `out`, the text of `ids`: by default words with a space after each, with text=False the library's form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path or public_path())
        for rows in batches:
            said = []
            for x in rows.column(ids):
                d = tok.decoder(text)
                said.append("".join(map(d.feed, x.as_py() or ())) + d.finish())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string())], [*rows.schema.names, out])

    encoded = encoded.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out}` string")
