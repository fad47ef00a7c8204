"""SQL (DuckDB) that says what the library's queries say, put together from the same fixed values."""

from __future__ import annotations

from gristmill.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str, fold: bool = False) -> str:
    return lit(P.re2(p, fold))


def replaced(x: str, p: str, by: str, fold: bool = False) -> str:
    return f"regexp_replace({x}, {pattern(p, fold)}, {lit(by)}, 'g')"


def trimmed(x: str) -> str:
    return replaced(x, r"^[{S}]+|[{S}]+$", "")


def repair_minimal(x: str) -> str:
    x = replaced(x, r"([a-zA-Z0-9._%+-]+)[{S}]*@[{S}]*([a-zA-Z0-9.-]+)", r"\1@\2")
    return replaced(x, r"@([a-zA-Z0-9.-]+)[{S}]*\.[{S}]*([a-zA-Z]{2,})", r"@\1.\2")


def repair_full(x: str) -> str:
    x = replaced(x, r"\r\n", "\n")
    x = replaced(x, r"[{S}(\[]+(?:@|©|®|at|\(a\))[{S})\]]+", "@", True)
    x = repair_minimal(x)
    x = replaced(x, r"\.[{S}]*(com|edu|org|gov|net|io|ai|in|ac|uk|de|ca){B}", r".\1", True)
    return replaced(x, r"[ \t]{2,}", " ")


def normalized(x: str) -> str:
    x = replaced(x, r"\r\n", "\n")
    x = replaced(x, r"\n{3,}", "\n\n")
    x = replaced(x, r"(?m)[ \t]+$", "")
    x = replaced(x, r"(?m)^[=\-_*#]{5,}$", "")
    return trimmed(x)


def printable(x: str) -> str:
    """One line without control characters; empty if less than 70 % of it is ASCII."""
    control = lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]")
    line = f"trim({replaced(f'regexp_replace({x}, {control}, {lit(" ")}, {lit("g")})', '[{S}]+', ' ')}, ' ')"
    return f"list_transform([{line}], lambda y: CASE WHEN length({replaced('y', r'[^ -~{S}]', '')}) >= 0.7 * length(y) THEN y ELSE '' END)[1]"


def nodes(text: str) -> str:
    """The lines of a text as XML nodes hold them: trimmed, without empty ones, entities inside texts decoded once too often."""
    fixed = f"replace(replace(x, '&quot;', '\"'), '&apos;', {lit(chr(39))})"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {trimmed(fixed)}), lambda x: x <> '')"


def words(ws) -> str:
    return "(" + ", ".join(map(lit, ws)) + ")"


def _luhn(m: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    at = f"CAST({d}[length({d}) - i] AS INTEGER)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {at} ELSE (2 * {at}) % 10 + {at} // 5 END)) % 10 = 0)"


def _iban(m: str) -> str:
    c = f"upper({replaced(m, '[{S}-]', '')})"
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    rest = f"list_reduce(list_transform(string_split({turned}, ''), lambda x: CASE WHEN x ~ '[A-Z]' THEN ascii(x) - 55 + 100 ELSE ascii(x) - 48 END), lambda a, x: CASE WHEN x >= 100 THEN (a * 100 + x - 100) % 97 ELSE (a * 10 + x) % 97 END, 0)"
    return f"(length({c}) BETWEEN 15 AND 34 AND regexp_full_match({c}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND {rest} = 1)"


def _bare(x: str) -> str:
    return f"lower(regexp_replace({trimmed(x)}, '^[''\"]|[''\"]$', '', 'g'))"


def _api_key(m: str) -> str:
    parts = f"string_split_regex({m}, {pattern('[:=]|{B}is{B}', True)})"
    return f"NOT (len({parts}) > 1 AND {_bare(parts + '[-1]')} IN {words(P.COMMON_WORDS)})"


def _credential(m: str) -> str:
    parts = f"list_filter(string_split_regex({m}, {pattern('[:=is{S}]+', True)}), lambda p: p <> '')"
    last = _bare(f"{parts}[-1]")
    return f"(len({parts}) > 0 AND {last} NOT IN {words(P.COMMON_WORDS)} AND NOT regexp_full_match({last}, '[0-9]{{1,4}}'))"


CHECKS = {"credit_card": _luhn, "pan": lambda m: f"(length({m}) = 10 AND substr({m}, 4, 1) IN {words(P.PAN_TYPES)})", "iban": _iban, "api_key": _api_key, "potential_credential": _credential}


def found(text: str, p: str, fold: bool = False) -> str:
    """list of {match, index}."""
    hits, gaps = f"regexp_extract_all({text}, {pattern(p, fold)})", f"string_split_regex({text}, {pattern(p, fold)})"
    at = f"CAST(list_sum(list_transform({gaps}[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform({hits}[1:k - 1], lambda h: length(h))), 0) AS INTEGER)"
    return f"list_transform(range(1, len({hits}) + 1), lambda k: {{'match': {hits}[k], 'index': {at}}})"


def rule(text: str, r: P.Rule) -> str:
    hits = found(text, r.pattern, r.fold)
    if check := CHECKS.get(r.category):
        hits = f"list_filter({hits}, lambda m: {check('m.match')})"
    row = f"{{'category': {lit(r.category)}, 'label': {lit(r.label)}, 'match': m.match, 'index': m.index, 'severity': {lit(r.severity)}}}"
    return f"list_transform({hits}, lambda m: {row})"


def scanned(repair: str = "minimal", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE scan: key, text, repaired, matches."""
    made = {"minimal": repair_minimal, "full": repair_full}[repair](f"coalesce({text}, '')")
    all_rules = " || ".join(rule("repaired", r) for r in P.RULES)
    return f"fixed AS (SELECT *, {made} AS repaired FROM {table}), scan AS (SELECT * EXCLUDE (matches_) , matches_ AS matches FROM (SELECT *, {all_rules} AS matches_ FROM fixed))"


def case(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


ROLE_OF = "['engineering', 'product', 'hr', 'finance', 'executive', 'contractor', 'default'][doc_id % 7 + 1]"
DOMAIN_OF = "['chatgpt.com', 'chat.openai.com', 'gemini.google.com', 'claude.ai', 'unknown', 'evil.example'][doc_id % 6 + 1]"


def risked(role: str = ROLE_OF, domain: str = DOMAIN_OF) -> str:
    """CTE risked: scan with regex_score, role_weight, destination_weight, critical, score."""
    worst = f"coalesce(list_max(list_transform(matches, lambda m: CAST({case('m.category', P.BASE, '50')} AS DOUBLE))), 0.0)"
    emails = "len(list_filter(matches, lambda m: m.category = 'email'))"
    where = "CASE " + " ".join(f"WHEN contains({domain}, {lit(k)}) THEN {w}::DOUBLE" for k, w in P.DESTINATIONS) + " ELSE 1.25::DOUBLE END"
    score = "CAST(floor(regex_score * role_weight * destination_weight + 0.5) AS BIGINT)"
    return (
        f"weighed AS (SELECT *, CASE WHEN {emails} >= 2 THEN greatest({worst}, 70.0) ELSE {worst} END AS regex_score, CAST({case(role, P.ROLES, '1.0')} AS DOUBLE) AS role_weight, {where} AS destination_weight, "
        f"len(list_filter(matches, lambda m: m.category IN {words(P.SCORE_FLOOR)})) > 0 AS critical FROM scan), "
        f"risked AS (SELECT *, least(100, greatest(0, CASE WHEN critical THEN greatest({score}, 95) ELSE {score} END)) AS score FROM weighed)"
    )


def judged(block: int | str = 75, redact: int | str = 45) -> str:
    """CTE judged (thresholds are numbers or columns): risked with floor (list), action, risk_score, reasons (list of descriptions)."""
    hits = ", ".join(f"CASE WHEN len(list_filter(matches, lambda m: m.category = {lit(c)})) > 0 THEN {lit(text)} END" for c, text in P.FLOOR)
    critical = f"CASE WHEN score >= 90 THEN [{filled(P.CRITICAL_REASON, 'score')}] ELSE CAST([] AS VARCHAR[]) END"
    b, r = f"least(89, {block})", f"least({block}, {redact})"
    return (
        f"floored AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS named FROM risked), "
        f"firm AS (SELECT *, CASE WHEN len(named) > 0 THEN named ELSE {critical} END AS floor FROM floored), "
        f"judged AS (SELECT *, CASE WHEN len(floor) > 0 OR score >= {b} THEN 'block' WHEN score >= {r} OR len(list_filter(matches, lambda m: m.severity <> 'low')) > 0 THEN 'redact' ELSE 'allow' END AS action, "
        "CASE WHEN len(floor) > 0 THEN greatest(score, 95) ELSE score END AS risk_score, "
        "CASE WHEN len(floor) > 0 THEN floor ELSE list_transform(matches, lambda m: " + filled(P.PATTERN_REASON, "m.label") + ") END AS reasons FROM firm)"
    )


def redacted(text: str = "coalesce(text, '')") -> str:
    """Folds the matches into the text."""
    return f"list_reduce(matches, lambda a, m: {{'category': '', 'label': '', 'match': replace(a.match, m.match, '[REDACTED_' || upper(m.category) || ']'), 'index': 0, 'severity': ''}}, {{'category': '', 'label': '', 'match': {text}, 'index': 0, 'severity': ''}}).match"


def unlike(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def filled(template: str, *values: str) -> str:
    parts = template.split("{}")
    return " || ".join(x for k, part in enumerate(parts) for x in ([lit(part)] if part else []) + ([f"({values[k]})"] if k < len(values) else []))


def explained() -> str:
    """For messages, not files."""
    u = unlike("reasons")
    others = filled(P.SAID_OTHERS, "reasons[1]", "len(reasons) - 1", "CASE WHEN len(reasons) > 2 THEN 's' ELSE '' END")
    why = f"CASE WHEN len({u}) = 1 THEN reasons[1] WHEN len({u}) > 1 THEN {others} ELSE {filled(P.SAID_LIMIT, 'risk_score')} END"
    tests = [(f"action = '{a}'" + ("" if f is None else f" AND len(floor) {'>' if f else '='} 0"), t) for (a, f, file), t in P.STEPS.items() if file is not True]
    step = "CASE " + " ".join(f"WHEN {test} THEN {lit(text)}" for test, text in tests) + " END"
    said = filled(P.SAID, lit(P.SAID_MESSAGE), "upper(action)", "risk_score", why, step)
    return f"CASE WHEN action = 'allow' AND len(reasons) = 0 THEN {filled(P.SAID_FINE, lit(P.SAID_MESSAGE), 'risk_score')} ELSE {said} END"


def entropy(x: str) -> str:
    """Bits a character."""
    chars = f"string_split({x}, '')"
    n = f"length({x})"
    return f"CASE WHEN {n} > 0 THEN log2({n}) - list_sum(list_transform(map_values(list_histogram({chars})), lambda c: CASE WHEN c > 1 THEN c * log2(c) ELSE 0.0 END)) / {n} ELSE 0.0 END"


def noisy(x: str) -> str:
    tokens = f"string_split_regex({x}, {pattern(P.TOKEN_CUT)})"
    return f"len(list_filter({tokens}, lambda t: CASE WHEN length(t) >= 18 THEN {entropy('t')} >= 4.2 ELSE false END)) > 0"


def keywords(x: str) -> str:
    return f"regexp_matches({x}, {pattern(P.KEYWORDS, True)})"


def blank(x: str) -> str:
    return f"({trimmed(x)} = '')"


def suspicion(x: str) -> str:
    return f"(CASE WHEN {keywords(x)} THEN 5 ELSE 0 END + CASE WHEN {noisy(x)} OR {entropy(x)} > 4.2 THEN 3 ELSE 0 END)"


def windowed(source: str = "documents") -> str:
    """CTE windowed: doc_id, chunk_index, text, window_type, start_char, end_char."""
    anchor = f"list_filter({found('clean', P.ANCHORS, True)}, lambda m: m.index > 1500)[1]"
    return (
        f"cleaned AS (SELECT doc_id, {trimmed("coalesce(text, '')")} AS clean FROM {source}), anchored AS (SELECT doc_id, clean, length(clean) AS n, {anchor} AS hit FROM cleaned WHERE clean <> ''), "
        "centred AS (SELECT *, hit.index + length(hit.match) // 2 AS center FROM anchored), "
        "windowed AS (SELECT doc_id, 0 AS chunk_index, CASE WHEN n <= 2500 THEN clean ELSE substr(clean, 1, 1500) END AS text, CASE WHEN n <= 2500 THEN 'FULL' ELSE 'HEAD' END AS window_type, 0 AS start_char, CASE WHEN n <= 2500 THEN n ELSE 1500 END AS end_char FROM centred "
        "UNION ALL SELECT doc_id, 1, substr(clean, greatest(0, center - 400) + 1, least(n, center + 400) - greatest(0, center - 400)), 'ANCHOR_LOCUS', greatest(0, center - 400), least(n, center + 400) FROM centred WHERE n > 2500 AND hit IS NOT NULL)"
    )


def chunked(most: int, overlap: int, least: int = 1000) -> str:
    """CTE chunk: doc_id, s, e (start and end of each chunk), one after the other; sized: doc_id, t, n."""
    lines = f"length(regexp_extract(substr(t, s + {least + 2}, s + {most} - s - {least}), '(?s)^.*\n'))"
    dots = f"length(regexp_extract(substr(t, s + {least + 2}, s + {most} - s - {least} + 1), '(?s)^.*\\. '))"
    behind = f"greatest(CASE WHEN {lines} > 0 THEN s + {least} + 1 + {lines} ELSE 0 END, CASE WHEN {dots} > 0 THEN s + {least} + {dots} ELSE 0 END)"
    end = f"CASE WHEN s + {most} >= n THEN n WHEN {behind} > 0 THEN {behind} ELSE s + {most} END"
    return (
        "sized AS (SELECT doc_id, text AS t, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text <> ''), "
        f"chunk AS (SELECT doc_id, s, {end} AS e FROM (SELECT *, CAST(0 AS BIGINT) AS s FROM sized) UNION ALL SELECT doc_id, s, {end} FROM (SELECT z.*, c.e - {overlap} AS s FROM chunk c JOIN sized z USING (doc_id) WHERE c.e < z.n))"
    )
