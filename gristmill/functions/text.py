"""Text functions, Column -> Column. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import let

_LINE_END = r"(?=[\n\r\x{2028}\x{2029}]|\z)"


BRACKET = r"\["


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at both ends, in ECMAScript's meaning of it."""
    return F.btrim(c, F.lit(P.BLANKS))


def is_blank(c: Column) -> Column:
    return ~text_or_empty(c).rlike(f"[^{P.WS}]")


def normalize_text(c: Column) -> Column:
    """Line ends, runs of empty lines, blanks at line ends, filler lines, ends."""
    c = F.regexp_replace(text_or_empty(c), r"\r\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, rf"(?<![ \t])[ \t]+{_LINE_END}", "")
    # the first sign is looked for before what stands in front of it, which would else be looked at everywhere
    c = F.regexp_replace(c, rf"[=\-_*#](?<![^\n\r\x{{2028}}\x{{2029}}][=\-_*#])[=\-_*#]{{4,}}{_LINE_END}", "")
    return trimmed(c)


def _by_blanks(c: Column, use: Callable[[Column, str], Column]) -> Column:
    """use(c, blanks): texts without any character that might be a blank beyond ASCII are searched with ASCII's alone, as a set of few characters is much faster to look up."""
    return let(c, lambda t: F.when(t.rlike(P.WIDE), use(t, P.WS)).otherwise(use(t, P.WS_ASCII)))


def _glued(t: Column, blanks: str) -> Column:
    """Begins at the blanks, not at the name before them: it only has to end there, behind what the last match took."""
    out = F.regexp_replace(t, rf"(?=[@{blanks}])(?<=[a-zA-Z0-9._%+-])(?!\G)[{blanks}]*+@[{blanks}]*([a-zA-Z0-9.-]+)", "@$1")
    return F.regexp_replace(out, rf"@([a-zA-Z0-9.-]+)[{blanks}]*\.[{blanks}]*([a-zA-Z]{{2,}})", "@$1.$2")


def repair_minimal(c: Column) -> Column:
    """Glues e-mail addresses that white space around @ and dots has broken. Texts without an @ are left alone."""
    return let(text_or_empty(c), lambda t: F.when(F.contains(t, F.lit("@")), _by_blanks(t, _glued)).otherwise(t))


def _lone_at(blanks: str) -> str:
    """A sign for @ or a lone "at" between `blanks` or brackets. What follows a blank is looked at first: most blanks end there."""
    open_ = rf"[{blanks}(\[]"
    return rf"(?i){open_}(?=[{blanks}(\[@©®a])(?:(?<=\G{open_})|(?<!{open_}{open_})){open_}*(?:@|©|®|at|\(a\))[{blanks})\]]+"


def repair_full(c: Column) -> Column:
    """What recognised text needs besides: other signs for @, dots before domains, runs of blanks. It also turns a lone "at" into @."""
    c = F.regexp_replace(text_or_empty(c), r"\r\n", "\n")
    c = _by_blanks(c, lambda t, blanks: F.regexp_replace(t, _lone_at(blanks), "@"))
    c = repair_minimal(c)
    c = F.regexp_replace(c, P.java(r"\.[{S}]*(com|edu|org|gov|net|io|ai|in|ac|uk|de|ca){B}", True), ".$1")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def repaired(c: Column, repair: str = "full") -> Column:
    """repair: full, minimal or none."""
    return {"full": repair_full, "minimal": repair_minimal, "none": text_or_empty}[repair](c)


def shannon_entropy(c: Column) -> Column:
    """Bits a character; 0 for empty texts.

    Characters are sorted and put together again, so that each is one run; what is gone through one by one is the alphabet, not the text. Time grows with the length and not with
    length times alphabet.
    """
    text = text_or_empty(c)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    total = F.aggregate(runs, F.lit(0.0), lambda acc, x: acc + weight(F.length(x)))
    size = F.length(text)
    return F.when(size > 0, F.log2(size.cast("double")) - total / size).otherwise(F.lit(0.0))


def has_keywords(c: Column) -> Column:
    return text_or_empty(c).rlike(P.java(P.KEYWORDS, True))


def noisy_tokens(c: Column, least: int = 16, bits: float = 4.2) -> Column:
    """Tokens of `least` characters or more that have an entropy of `bits` or more. A token needs 2 ** bits different characters for that."""
    longest = F.filter(F.split(text_or_empty(c), P.java(P.TOKEN_CUT)), lambda t: F.length(t) >= max(least, int(2**bits)))
    return F.filter(longest, lambda t: shannon_entropy(t) >= bits)


def has_noisy_tokens(c: Column, least: int = 16, bits: float = 4.2) -> Column:
    longest = F.filter(F.split(text_or_empty(c), P.java(P.TOKEN_CUT)), lambda t: F.length(t) >= max(least, int(2**bits)))
    return F.exists(longest, lambda t: shannon_entropy(t) >= bits)


def is_triaged(c: Column) -> Column:
    """Whether a passage is worth a classifier's time."""
    return ~is_blank(c) & (has_keywords(c) | has_noisy_tokens(c))


def suspicion(c: Column) -> Column:
    """5 for keywords, 3 for noise: noisy tokens, or a noisy text as a whole."""
    noisy = has_noisy_tokens(c) | (shannon_entropy(c) > 4.2)
    return F.when(has_keywords(c), 5).otherwise(0) + F.when(noisy, 3).otherwise(0)


def sha256_or_null(c: Column) -> Column:
    """Of the untrimmed text; null for blank ones."""
    return F.when(~is_blank(c), F.sha2(c, 256))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; without a dot the whole name."""
    return F.lower(F.element_at(F.split(text_or_empty(name), r"\."), -1))


def snippet(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def label_list(c: Column) -> Column:
    return F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(c, ", ")).otherwise(F.lit("None"))
