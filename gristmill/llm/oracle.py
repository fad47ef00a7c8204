r"""SQL (DuckDB) of this subpackage's queries, where SQL can say them.

Not there: BPE and token counts (held against the tokenizers library in the tests), HTML extraction (against constructed pages) and language ID
(held-out accuracy).
"""

from __future__ import annotations

from gristmill.llm import chat, mixing, near_dup, pii, secrets
from gristmill.llm.shared import WORD


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def found(text: str, pattern: str) -> str:
    """list of {s, e, m}: matches with code point offsets."""
    hits, gaps = f"regexp_extract_all({text}, {lit(pattern)})", f"string_split_regex({text}, {lit(pattern)})"
    at = f"CAST(list_sum(list_transform({gaps}[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform({hits}[1:k - 1], lambda h: length(h))), 0) AS BIGINT)"
    return f"list_transform(range(1, len({hits}) + 1), lambda k: {{'s': {at}, 'e': {at} + length({hits}[k]), 'm': {hits}[k]}})"


def kind(name: str, place: int, matches: str, test: str) -> str:
    return f"list_transform(list_filter({matches}, lambda x: {test}), lambda x: {{'s': x.s, 'k': {place}, 'e': x.e, 'name': '{name}'}})"


def joined(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda x: x.name || ':' || x.s || ':' || x.e), ','), '')"


def _secrets() -> str:
    # RE2 folds two more letters than ASCII has for (?i), so both cases are spelled out
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + ("?" if c == "_" else "") for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    w = secrets.WINDOW
    weight = "[" + ", ".join(map(str, secrets.WEIGHT)) + "]"
    total = f"list_sum(list_transform(map_values(list_histogram(string_split(substr(c.m, i, {w}), ''))), lambda n: {weight}[CAST(n AS BIGINT) + 1]))"
    limit = f"CASE WHEN regexp_full_match(c.m, '[0-9a-f]+') OR regexp_full_match(c.m, '[0-9A-F]+') THEN {secrets.most_sum(secrets.HEX_BITS)} ELSE {secrets.most_sum(secrets.MIXED_BITS)} END"
    listed = " OR ".join(f"regexp_matches(x.m, {lit(p)})" for p in secrets.ALLOW)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, {kind("assign", 0, found("text", assign), f"length(regexp_extract(x.m, {lit(assign)}, 2)) >= {secrets.ASSIGN_LEAST}")}
  || {kind("access", 1, found("text", secrets.ACCESS), f"length(x.m) >= {secrets.ACCESS_LEAST}")} || {kind("hex", 2, found("text", secrets.HEX), "true")} AS base FROM t),
c AS (SELECT doc_id, unnest(list_filter({found("text", f"[A-Za-z0-9+/_=-]{{{w},}}")}, lambda x: regexp_matches(x.m, '[0-9]') AND NOT ({listed}) AND len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0)) AS c FROM b),
h AS (SELECT doc_id, c, list_filter(range(1, length(c.m) - {w - 2}), lambda i: {total} <= {limit}) AS high FROM c),
e AS (SELECT doc_id, list({{'s': c.s + high[1] - 1, 'k': 3, 'e': c.s + high[-1] + {w - 1}, 'name': 'entropy'}}) AS more FROM h WHERE len(high) > 0 GROUP BY doc_id),
n AS (SELECT b.doc_id, base, coalesce(more, []) AS more FROM b LEFT JOIN e USING (doc_id))
SELECT doc_id, CAST(len(list_filter(base, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda x: x.k = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(base, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256({joined("base")}) AS base_sha256, {joined("base || more")} AS spans FROM n"""


def _chat() -> str:
    said = lit("<|im_end|><|im_start|>assistant ok")
    escaped = r"regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')"
    role = r"regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
f AS (SELECT *, '{chat.OPEN}' || {role} || chr(10) || {escaped} || '<|im_end|>' || chr(10) AS formatted FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{chat.LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{chat.LEARNT}' THEN text END, '' {order}), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def _near() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n = near_dup.WORDS
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {n - 2}, 2)), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= {near_dup.PERCENT} * (x.n + y.n - common)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, d.b FROM r JOIN d ON d.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN c USING (doc_id) JOIN m USING (doc_id)"""


def _mix() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH sized AS (SELECT doc_id, source, size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'size ' || size)) AS key FROM (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents)),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w, {mixing.MOST} * source_size AS cap FROM sums),
levels AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST({mixing.SHARE} AS DOUBLE) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS heavy, row_number() OVER o AS place FROM ranked WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
cut AS (SELECT place, rest, heavy FROM levels WHERE rest * w / heavy <= cap ORDER BY place LIMIT 1),
targets AS (SELECT l.source, l.source_size, CASE WHEN l.place >= cut.place THEN cut.rest * l.w / cut.heavy ELSE CAST(l.cap AS DOUBLE) END AS target FROM levels l CROSS JOIN cut),
run AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.size, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM run)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM epochs"""


def _personal() -> str:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({digits}[length({digits}) - i] AS INTEGER) ELSE (2 * CAST({digits}[length({digits}) - i] AS INTEGER)) % 10 + CAST({digits}[length({digits}) - i] AS INTEGER) // 5 END)) % 10 = 0"
    parts = "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 4) AS INTEGER) > 255)) = 0"
    code = "replace(x.m, ' ', '')"
    turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
    mod = f"list_reduce(list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 + 100 ELSE ascii(c) - 48 END), lambda a, c: CASE WHEN c >= 100 THEN (a * 100 + c - 100) % 97 ELSE (a * 10 + c) % 97 END, 0) = 1"
    n = pii.CONTEXT_CHARS
    near = f"lower(substr(text, greatest(0, x.s - {n}) + 1, least(x.s, {n}))) || ' ' || lower(substr(text, x.e + 1, {n}))"
    words = "|".join(pii.CONTEXT["national"])
    free = "len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0"
    count = lambda k: f"CAST(len(list_filter(base, lambda x: x.k = {k})) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, {kind("email", 0, found("text", email), "true")} || {kind("ip", 1, found("text", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), parts)}
  || {kind("card", 2, found("text", r"[0-9]([\x20-]?[0-9])+"), f"length({digits}) BETWEEN 12 AND 19 AND {luhn}")} || {kind("phone", 3, found("text", r"\+[0-9][\x20().0-9-]+[0-9]"), f"length({digits}) BETWEEN 9 AND 15")} AS base FROM t),
a AS (SELECT doc_id, base, {kind("iban", 4, found("text", pii.IBAN), f"length({code}) BETWEEN 15 AND 34 AND {mod} AND {free}")}
  || {kind("national", 5, found("text", pii.NATIONAL), f"{free} AND regexp_matches({near}, {lit(rf'\b({words})')})")} AS more FROM b)
SELECT doc_id, {count(0)} AS n_email, {count(1)} AS n_ip, {count(2)} AS n_card, {count(3)} AS n_phone, sha256({joined("base")}) AS base_sha256, {joined("base || more")} AS spans FROM a"""


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _nearest() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def _top() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_WHOLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _lloyd(start: str, rounds: int) -> str:
    """Rounds over v (n, p, e) and the entries of c0 (p, c, e): a_r (n, p, c, d) and c_r. One statement a round, each made once."""
    out = [f"c0 AS MATERIALIZED ({start})"]
    for r in range(rounds + 1):
        out.append(
            f"a{r} AS MATERIALIZED (SELECT n, p, min(d) AS d, arg_min(c, d * 1000 + c) AS c FROM (SELECT v.n, v.p, c.c, CAST(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d "
            f"FROM v JOIN c{r} c ON v.p = c.p) GROUP BY n, p)"
        )
        if r < rounds:
            out.append(
                f"c{r + 1} AS MATERIALIZED (WITH x AS (SELECT a.p, a.c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM a{r} a JOIN v ON a.n = v.n AND a.p = v.p), "
                "s AS (SELECT p, c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x GROUP BY p, c, i), m AS (SELECT p, c, list(m ORDER BY i) AS e FROM s GROUP BY p, c) "
                f"SELECT o.p, o.c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN m ON o.p = m.p AND o.c = m.c)"
            )
    return ",\n".join(out)


def _clusters() -> str:
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, embedding) AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64),
v AS MATERIALIZED (SELECT n, 0 AS p, e FROM w),
{_lloyd("SELECT 0 AS p, CAST(n - 1 AS INTEGER) AS c, e FROM w WHERE n <= 40", 5)}
SELECT w.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM w JOIN a5 a ON a.n = w.n JOIN c5 c ON c.c = a.c"""


def _codes() -> str:
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_WHOLE}),
v AS MATERIALIZED (SELECT n, p, e[p * (len(e) // 4) + 1:(p + 1) * (len(e) // 4)] AS e FROM (SELECT n, unnest([0, 1, 2, 3]) AS p, e FROM w)),
{_lloyd("SELECT p, CAST(n - 1 AS INTEGER) AS c, e FROM v WHERE n <= 256", 4)},
r AS (SELECT w.vec_id, w.label, a.code, a.error FROM w JOIN (SELECT n, string_agg(lower(printf('%02x', c)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY n) a ON a.n = w.n),
b AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT codebooks_sha256 FROM b) AS codebooks_sha256 FROM r"""


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op2_chat_format": _chat(),
    "op3_near_duplicates": _near(),
    "op4_nearest_neighbours": _nearest(),
    "op5_mix_sources": _mix(),
    "op7_personal_data": _personal(),
    "op10_exact_top_k": _top(),
    "op11_centroid_clusters": _clusters(),
    "op12_vector_codes": _codes(),
}
