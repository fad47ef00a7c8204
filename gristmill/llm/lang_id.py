r"""Language ID with a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the running text's bytes forwards and backwards, spaces and all, and gives every position a distribution over languages. Long texts are read in stretches that
overlap by CONTEXT bytes at both ends, so that every position that counts has been led up to. A document's
language is the one that its letters' positions, pooled, find most likely; its score is the mean probability that they give it. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import by_size, written

#: Labelled documents a language and stretches a document that the network learns from, and bytes a stretch: the bounds of the training sample.
DOCUMENTS, STRETCHES, LEARNT = 150, 40, 48
HIDDEN = 8
STEPS, BATCH, RATE, SEED = 260, 256, 0.02, 11
#: Bytes of a stretch that count, bytes on either side that lead up to them, stretches read at once, bytes of texts taken together.
CORE, CONTEXT, ROWS, TOGETHER = 256, 16, 512, 1 << 18
#: Rows whose texts are taken out of Arrow at once.
SLICE = 256
UNKNOWN = "und"
#: What stands behind a text's end.
END = 256

_LETTER = regex.compile(r"\p{L}")
#: Capitals of ASCII become small; other bytes stay.
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that are letters or parts of them, mostly.
_LETTERS = np.array([97 <= c <= 122 or 128 <= c < 256 for c in range(257)])


class Direction:
    """A gated recurrent layer over byte codes. Gates: update, reset, candidate, in this order. Arrays are time x rows."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.p = {"w": rng.normal(0, 0.3, (3, 257, hidden)).astype(np.float32), "u": rng.normal(0, hidden**-0.5, (3, hidden, hidden)).astype(np.float32)}
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """x, mask: time x rows -> time x rows x hidden; beyond a text's end the state stays. Without mask there is no such place."""
        (wz, wr, wc), (uz, ur, uc) = self.p["w"], self.p["u"]
        rows = x.shape[1]
        h = np.zeros((rows, self.hidden), wc.dtype)
        out, gates = np.empty((*x.shape, self.hidden), wc.dtype), np.empty((2 * rows, self.hidden), wc.dtype)
        for t, code in enumerate(x):
            gates = gates if keep is None else np.empty_like(gates)
            z, r = gates[:rows], gates[rows:]
            np.add(wz.take(code, 0), h @ uz, out=z)
            np.add(wr.take(code, 0), h @ ur, out=r)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)  # too large numbers end as 0
            gates += 1
            np.reciprocal(gates, out=gates)
            c = wc.take(code, 0)
            c += (r * h) @ uc
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if mask is not None:
                m = mask[t, :, None]
                new = np.where(m, new, h)
                if keep is not None:
                    keep.append((h, z, r, c, m))
            out[t] = h = new
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        uz, ur, uc = self.p["u"]
        gu, into = np.zeros_like(self.p["u"]), np.empty((3, *d_out.shape), uc.dtype)
        dh = np.zeros_like(d_out[0])
        for t in reversed(range(len(x))):
            h, z, r, c, m = kept[t]
            dh = dh + d_out[t]
            d = m * dh
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            gu += np.stack([h.T @ dz, h.T @ dr, (r * h).T @ dc])
            into[:, t] = dz, dr, dc
            dh = (1 - m) * dh + d * z + drh * r + dz @ uz.T + dr @ ur.T
        codes, flat = x.ravel(), into.reshape(3, -1, self.hidden)
        gw = np.stack([np.stack([np.bincount(codes, gate[:, k], 257) for k in range(self.hidden)], 1) for gate in flat])
        return {"w": gw.astype(uc.dtype), "u": gu}


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.v = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def positions(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Log-probabilities of the languages at every position: languages x time x rows. Backwards, what lies behind the end comes first and leaves no trace."""
        one, two = ([], []) if keep is not None else (None, None)
        with np.errstate(over="ignore"):
            a = self.ahead.forward(x, mask, one)
            b = self.back.forward(x[::-1], None if mask is None else mask[::-1], two)[::-1]
        h = self.ahead.hidden
        logp = np.ascontiguousarray((a @ self.v[:h] + b @ self.v[h:] + self.c).transpose(2, 0, 1))
        logp -= logp.max(0)
        logp -= np.log(np.exp(logp).sum(0))
        if keep is not None:
            keep |= {"one": one, "two": two, "a": a, "b": b}
        return logp

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of rows x (rows x time) with the labels y."""
        x = np.ascontiguousarray(x.T)
        mask = x != END
        keep: dict = {}
        logp = self.positions(x, mask, keep)
        n, rows = mask.sum(), np.arange(x.shape[1])
        d = np.exp(logp)
        d[y, :, rows] -= 1
        d = (d * (mask / n)).astype(logp.dtype).transpose(1, 2, 0)
        loss = -float((logp[y, :, rows] * mask.T).sum() / n)
        h, flat = self.ahead.hidden, d.reshape(-1, d.shape[2])
        ds = d @ self.v.T
        g1 = self.ahead.backward(x, keep["one"], ds[:, :, :h])
        g2 = self.back.backward(x[::-1], keep["two"], ds[::-1, :, h:])
        gv = np.concatenate([keep["a"].reshape(-1, h).T @ flat, keep["b"].reshape(-1, h).T @ flat])
        return loss, {"aw": g1["w"], "au": g1["u"], "bw": g2["w"], "bu": g2["u"], "v": gv, "c": d.sum((0, 1))}

    def parameters(self) -> dict[str, np.ndarray]:
        return {"aw": self.ahead.p["w"], "au": self.ahead.p["u"], "bw": self.back.p["w"], "bu": self.back.p["u"], "v": self.v, "c": self.c}

    def fit(self, x: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> "Network":
        """x: stretches x bytes, END behind short ones. Languages are drawn alike."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        places = [np.flatnonzero(labels == k) for k in np.unique(labels)]
        for step in range(1, steps + 1):
            take = np.array([p[rng.integers(len(p))] for p in (places[k] for k in rng.integers(0, len(places), batch))])
            _, grads = self.gradients(x[take], labels[take])
            now = rate * (1 - 0.9 * step / steps)
            for k, p in self.parameters().items():
                g = np.clip(grads[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text, over its letters' positions: summed log-probabilities, summed probabilities, their number, summed entropies."""
        out = np.zeros((len(texts), 2 * len(self.languages) + 2))
        of, begin, end, low, high = stretches([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        order = np.argsort(end - begin, kind="stable")
        for at in range(0, len(order), ROWS):
            take = order[at : at + ROWS]
            place = begin[take] + np.arange((end - begin)[take].max())[:, None]  # time x rows
            inside = place < end[take]
            x = np.where(inside, data[np.minimum(place, len(data) - 1)], END)
            logp = self.positions(x, None if inside.all() else inside)
            m = (_LETTERS[x] & (place >= low[take]) & (place < high[take])).astype(np.float32)
            p = np.exp(logp)
            p *= m
            np.add.at(out, of[take], np.concatenate([(logp * m).sum(1), p.sum(1), m.sum(0)[None], -(p * logp).sum((0, 1))[None]]).T)
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        """Language, score and doubt: the mean entropy of the positions as a share of the largest possible."""
        n = len(self.languages)
        held: list[bytes | None] = []
        size = 0
        for k, t in enumerate(texts):
            held.append(t.encode("utf-8", "surrogatepass").translate(_SMALL) if t and n and _LETTER.search(t) else None)
            size += len(held[-1] or b"")
            if size >= TOGETHER or k == len(texts) - 1:
                rows = self.pooled([t or b"" for t in held])
                for t, row in zip(held, rows, strict=True):
                    if t is None:
                        yield UNKNOWN, 0.0, 1.0
                    else:  # every letter has a byte from a to z or from 128 on
                        best = int(np.argmax(row[:n]))
                        yield self.languages[best], min(1.0, float(row[n + best] / row[2 * n])), float(row[2 * n + 1] / row[2 * n] / np.log(n)) if n > 1 else 0.0
                held, size = [], 0


def stretches(lengths: list[int]) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other: each stretch's text, begin and end, and begin and end of the part that counts."""
    parts = [-(-n // CORE) for n in lengths]
    of = np.repeat(np.arange(len(lengths)), parts)
    size = np.array(lengths, np.int64)
    first = np.cumsum(size) - size
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = first[of] + k * CORE
    stop = first[of] + size[of]
    high = np.minimum(low + CORE, stop)
    return of, np.maximum(low - CONTEXT, first[of]), np.minimum(high + CONTEXT, stop), low, high


def padded(texts: list[bytes], width: int) -> np.ndarray:
    x = np.full((len(texts), width), END)
    for k, t in enumerate(texts):
        x[k, : len(t)] = np.frombuffer(t[:width], np.uint8)
    return x


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_sample(docs: DataFrame, per_language: int = DOCUMENTS) -> DataFrame:
    """(text, lang) of at most `per_language` rows of each language, chosen by hash, none of them held out.

    Ids are ranked without texts; only the chosen ids' texts are read, and their rows are cut again, as an id may have any number of them.
    """
    usable = docs.filter((remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    by = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = written(usable.select("doc_id", "lang").withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= per_language).select("doc_id", "lang").distinct(), "chosen")
    named = usable.select("doc_id", "lang", "text").join(by_size(chosen), ["doc_id", "lang"], "left_semi")
    again = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text"), "text")
    return named.withColumn("_r", F.row_number().over(again)).filter(F.col("_r") <= per_language).select("text", "lang")


def sample_stretches(sample: DataFrame, per_document: int = STRETCHES, width: int = LEARNT) -> DataFrame:
    """(lang, stretch): at most `per_document` stretches of `width` bytes of each text, spread evenly over it. Cut where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, cut = [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass").translate(_SMALL)
                n = min(per_document, -(-len(data) // width))
                for at in np.linspace(0, max(0, len(data) - width), n).astype(int).tolist():
                    langs.append(lang)
                    cut.append(data[at : at + width])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], ["lang", "stretch"])

    return sample.select("text", "lang").mapInArrow(run, "lang string, stretch binary")


def train(docs: DataFrame, per_language: int = DOCUMENTS, per_document: int = STRETCHES) -> Network:
    """A network of the languages of a bounded sample; only short stretches of it reach the driver."""
    sample = sorted((r.lang, bytes(r.stretch)) for r in sample_stretches(training_sample(docs, per_language), per_document).collect())
    languages = sorted({lang for lang, _ in sample})
    network = Network(languages)
    if len(languages) < 2:
        return network
    return network.fit(padded([t for _, t in sample], LEARNT), np.array([languages.index(lang) for lang, _ in sample]))


RESULT = "held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, network: Network, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; with keep=True all columns of `docs`, these and doubt.

    doubt is near 1 where no position tells one language from others, whatever languages the text mixes.

    A text that is null or has no letters is `und` with score 0, as is every text if nothing was learned. Predictions take the
    text alone. Rows are independent: ties, repeated rows and empty tables need nothing special, and long texts are read whole. Older columns named like results are replaced.
    """
    result = RESULT + ", doubt double" * keep
    names = [x.split()[0] for x in result.split(", ")]
    docs = docs.drop(*names) if keep else docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = docs_columns.index("text"), docs_columns.index("doc_id")
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = [*network.predict(batch.column(at).to_pylist())]
            held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0 for d in batch.column(ids).to_pylist()]
            kept = batch.columns if keep else [batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(held, pa.bool_()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *[pa.array([x[2] for x in found], pa.float64())] * keep], [*(docs_columns if keep else ["doc_id"]), *names])

    docs_columns = docs.columns
    kept = [f for f in docs.schema if keep or f.name == "doc_id"]
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {result}")
