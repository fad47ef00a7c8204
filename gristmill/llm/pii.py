r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds: e-mail address, IP address, card number (Luhn), phone number. Added kinds: IBAN (mod 97), and numbers of
the form 123-45-6789 where a word about them stands near. A span of an added kind is kept if it touches no base span and its score reaches the threshold.
All patterns read a text once: runs of digits are taken whole, and e-mail addresses are grown from their @.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national")
#: Score of a confirmed span without context, what a context word near it adds, what is kept.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "national": 0.4}
CONTEXT_ADDS, CONTEXT_CHARS, LEAST = 0.3, 48, 0.6
#: Fixed values.
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "national": ("ssn", "social security", "national id", "identity number"),
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN, NATIONAL = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_IBAN, _NATIONAL = re.compile(IBAN, re.A), re.compile(NATIONAL, re.A)
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            s = at
            while s > free and text[s - 1] in _LOCALS:
                s -= 1
            if s < at:
                yield s, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; a match that fails its test is dropped with the text that it took."""
    if "@" in text:
        yield from ((s, 0, e) for s, e in emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield m.start(), 1, m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            yield m.start(), 2, m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                yield m.start(), 3, m.end()


def score(text: str, s: int, kind: int, e: int) -> float:
    near = text[max(0, s - CONTEXT_CHARS) : s].lower() + " " + text[e : e + CONTEXT_CHARS].lower()
    return min(1.0, SCORE[KINDS[kind]] + CONTEXT_ADDS * any(re.search(rf"\b{w}", near, re.A) for w in CONTEXT[KINDS[kind]]))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    found = [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if 15 <= len(c := m.group().replace(" ", "")) <= 34 and mod97(c)]
    found += [(m.start(), 5, m.end()) for m in _NATIONAL.finditer(text)]
    starts = [b for b, _, _ in base]
    furthest = [*itertools.accumulate((e for _, _, e in base), max, initial=-1)]
    for s, k, e in found:
        if score(text, s, k, e) >= LEAST and furthest[bisect.bisect_left(starts, e)] <= s:  # no base span that starts before its end reaches it
            yield s, k, e


def find_personal(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, (start, kind, end) by start and kind; code points, end exclusive."""
    if not _WORTH.search(text):
        return [], []
    base = sorted(base_spans(text))
    return base, sorted([*base, *added_spans(text, base)])


_WORTH = re.compile("[0-9@]")


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every whole text.

    A null text is empty and has no spans; then spans is "" and base_sha256 that of "". scores has one number from 0 to 1 for
    each of spans. Rows are independent, so ties, repeated rows and empty tables need nothing special; extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list] = [[] for _ in range(7)]
            for x in rows.column(1):
                t = x.as_py() or ""
                base, spans = find_personal(t)
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, (*(kinds.count(k) for k in range(4)), hashlib.sha256(named(base).encode()).hexdigest(), named(spans), [score(t, *x) for x in spans]), strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, out, types)], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {RESULT}")


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` with every span in `text` replaced by [EMAIL], [IP], ...; overlapping spans get the first one's mark."""

    def clean(t: str | None) -> str | None:
        if not t or not (spans := find_personal(t)[1]):
            return t
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [t[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            k = rows.schema.get_field_index(text)
            yield rows.set_column(k, text, pa.array([clean(x.as_py()) for x in rows.column(k)], pa.string()))

    return docs.mapInArrow(run, docs.schema)
