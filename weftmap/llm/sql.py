"""SQL (DuckDB) with the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import quality
from .chat import LOSS_ROLE

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1() -> str:
    rules = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "bangs_per_word": "n_bangs / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    }
    cells = " UNION ALL ".join(f"SELECT '{r}' AS rule, {i} AS i, {c}::DOUBLE AS cutoff" for r in quality.RULES for i, c in enumerate(quality.GRID))
    ratios = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in rules.items())
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules) + " END"
    share, n_rules = f"{0.02 / len(rules)!r}", len(rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, w[i:i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY r),
b AS (SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs,
 len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM b),
k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
l AS (SELECT f.*, quality FROM f JOIN k USING (doc_id) WHERE NOT base_failed),
s AS (SELECT lang, count(*) FILTER (quality = 1) AS n FROM l GROUP BY lang),
c AS (SELECT l.lang, rule, i, cutoff, count(*) FILTER (quality = 1 AND {value} > cutoff) AS rejected, count(*) FILTER (quality = 0 AND {value} > cutoff) AS caught FROM l, ({cells}) GROUP BY ALL),
p AS (SELECT c.*, s.n, CASE WHEN rejected <= floor(n * {share}) THEN list_sum(list_transform(range(0, rejected + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) ELSE 1 END AS p FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang),
h AS (SELECT *, min((p <= 0.05 / ((SELECT count(*) FROM s) * {n_rules}))::INT) OVER (PARTITION BY lang, rule ORDER BY i) AS holds FROM p),
best AS (SELECT lang, rule, cutoff FROM h WHERE holds = 1 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - 10 * rejected DESC, i) = 1 AND caught > 0),
bad AS (SELECT DISTINCT r FROM f JOIN best ON f.lang IS NOT DISTINCT FROM best.lang WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f"""


def op4() -> str:
    esc = "replace(replace(replace({}, '\\', '\\e'), '<', '\\l'), '[', '\\b')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, length({esc.format('text')}) + CASE WHEN role IS NOT DISTINCT FROM before THEN 6 ELSE 4 + length(replace({esc.format('role')}, chr(10), '\\n')) END + CASE WHEN role IS NOT DISTINCT FROM after THEN 0 ELSE 4 END AS chars FROM o),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS told, coalesce(string_agg(text, '' ORDER BY n) FILTER (role = '{LOSS_ROLE}'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


def op5(window: int = 35) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, i, list_aggregate(w[i:i + {window - 1}], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
again AS (SELECT r, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
edge AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM again),
gone AS (SELECT r, list(unnested) AS gone FROM (SELECT r, unnest(range(CASE WHEN before + {window} > i THEN before + {window} ELSE i END, i + {window})) AS unnested FROM edge) GROUP BY r),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE r IN (SELECT r FROM gone)),
left_over AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.i) AS kept FROM words ANTI JOIN (SELECT r, unnest(gone) AS i FROM gone) q ON q.r = words.r AND q.i = words.i GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(CASE WHEN gone IS NULL THEN coalesce(list_aggregate(w, 'string_agg', ' '), '') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN left_over USING (r)"""


def op6(n: int = 5) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT min(r) AS c, w, count(*) AS copies, min(doc_id) AS least FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT c, list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ') AS g FROM (SELECT c, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM c)),
size AS (SELECT c, count(*) AS n FROM s GROUP BY c),
pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c),
links AS (SELECT a, b FROM pairs JOIN size x ON x.c = a JOIN size y ON y.c = b WHERE 5 * pairs.n >= 4 * (x.n + y.n - pairs.n)),
reach AS (SELECT c, c AS to_c FROM c UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.to_c),
root AS (SELECT reach.c, min(least) AS class_id FROM reach JOIN c ON c.c = reach.to_c GROUP BY reach.c),
other AS (SELECT a, sum(copies) AS n FROM links JOIN c ON c.c = links.b GROUP BY a)
SELECT d.doc_id, CASE WHEN c.c IS NULL THEN d.doc_id ELSE class_id END AS class_id, coalesce(other.n + copies - 1, copies - 1, 0)::BIGINT AS n_links, CASE WHEN len(d.w) = 0 THEN 0 ELSE greatest(len(d.w) - {n - 1}, 1) END::BIGINT AS n_shingles
FROM d LEFT JOIN c ON c.w = d.w LEFT JOIN root ON root.c = c.c LEFT JOIN other ON other.a = c.c"""


def op11() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
o AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS FIRST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM o"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit; each byte is followed by seven zeros, so that a step is the same for every bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"


def op12(n: int = 10, grace: int = 12, keep: int = 48) -> str:
    hour, day = 3_600_000_000, 86_400_000_000
    down = lambda x, by: f"(({x}) - ((({x}) % {by}) + {by}) % {by}) // {by}"
    per_batch = f"(SELECT unnest(range(0, {n})) AS b)"
    return f"""
WITH a AS (SELECT click_id, epoch_us(ts) AS t, coalesce({down("epoch_us(arrived_at)", day)}, 0) AS d, coalesce(kind, 'none') AS kind, coalesce(CASE WHEN isfinite(value) THEN floor(value * 100 + 0.5)::BIGINT END, 0) AS cents, coalesce({_crc32("click_id::VARCHAR")}, 0) AS crc FROM clicks WHERE ts IS NOT NULL),
q AS (SELECT *, ((d % {n}) + {n}) % {n} AS q FROM a),
m AS (SELECT click_id, min({{'b': least({n - 1}, q + greatest(0, crc % 30 - 23)), 't': t - (d - q) * {day}, 'k': kind, 'c': cents}}) AS r FROM q GROUP BY click_id),
e AS (SELECT click_id, r.b AS b, r.t AS t, r.k AS kind, r.c AS cents, {down("r.t", hour)} AS hour FROM m),
w AS (SELECT g.b, max(top) AS w FROM {per_batch} g LEFT JOIN (SELECT b, max(t) AS top FROM e GROUP BY b) x ON x.b < g.b GROUP BY g.b),
s AS (SELECT e.*, coalesce((hour + 1) * {hour} + {keep * hour} <= w, false) AS late FROM e JOIN w USING (b)),
p AS (SELECT kind, hour, b, count(*) AS n, sum(cents)::BIGINT AS c FROM s WHERE NOT late GROUP BY kind, hour, b),
first AS (SELECT kind, hour, min(b) AS first FROM p GROUP BY kind, hour),
given AS (SELECT kind, hour, min(w.b) AS given FROM first JOIN w ON w.b >= first AND (hour + 1) * {hour} + {grace * hour} <= w GROUP BY kind, hour),
every AS (SELECT f.kind, f.hour, g.b, coalesce(p.n, 0) AS new, sum(coalesce(p.n, 0)) OVER o AS n, sum(coalesce(p.c, 0)) OVER o AS c, given FROM first f CROSS JOIN {per_batch} g LEFT JOIN p ON p.kind = f.kind AND p.hour = f.hour AND p.b = g.b LEFT JOIN given x ON x.kind = f.kind AND x.hour = f.hour WINDOW o AS (PARTITION BY f.kind, f.hour ORDER BY g.b)),
told AS (SELECT *, lag(n) OVER o AS n0, lag(c) OVER o AS c0 FROM every WINDOW o AS (PARTITION BY kind, hour ORDER BY b)),
out AS (SELECT b, hour, -1 AS click_id, n, c, 'emit' AS record, kind FROM told WHERE b = given
 UNION ALL SELECT b, hour, -1, n0, c0, 'retract', kind FROM told WHERE b > given AND new > 0
 UNION ALL SELECT b, hour, -1, n, c, 'replace', kind FROM told WHERE b > given AND new > 0
 UNION ALL SELECT b, hour, -1, n, c, 'final', kind FROM told WHERE given IS NULL AND b = {n - 1}
 UNION ALL SELECT b, hour, click_id, 1, cents, 'late', kind FROM s WHERE late)
SELECT b::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n::BIGINT AS n_rows, c::BIGINT AS cents, record, kind FROM out"""


def op13(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    near = lambda c: f"(SELECT r, vec_id, v, c, d FROM (SELECT v.r, v.vec_id, v.v, {c}.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[i] - {c}.v[i]) * (v.v[i] - {c}.v[i])))::BIGINT AS d FROM v, {c}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED {near(f'c{i}')}")
        steps.append(f"m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
a AS MATERIALIZED {near(f"c{rounds}")},
t AS (SELECT c, sum(d)::BIGINT AS d FROM a GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, t.d AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a JOIN t USING (c) JOIN c{rounds} USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op4_chat_format": op4(), "op5_substring_dedup": op5(), "op6_ngram_join": op6(), "op11_exact_dedup": op11(), "op12_pane_revisions": op12(), "op13_centroids": op13()}
