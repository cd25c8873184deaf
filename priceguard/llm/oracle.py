"""DuckDB SQL for the corpus queries that SQL can express."""

from . import licenses, mixing, quality

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _states(line: str) -> str:
    """Whether a line is a copyright statement (no engine-side look-ahead is needed)."""
    begins = lambda p: f"regexp_matches({line}, {_quoted(r'^[^\S\n]*(?:' + p + ')')})"
    return " OR ".join(f"({begins(yes)}" + (f" AND NOT {begins(no)})" if no else ")") for yes, no in licenses.STATED)


def _normalised(text: str) -> str:
    t = f"array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda line: CASE WHEN {_states('line')} THEN ' ' ELSE line END), chr(10))"
    for old, new in licenses.SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'), ' ')"


_KNOWN = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.LICENSES + licenses.WHOLE)
OP1 = f"""WITH known AS (SELECT sha256({_normalised("t")}) AS digest, min(n) AS license FROM (VALUES {_KNOWN}) k(n, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t, sha256({_normalised("coalesce(text, '')")}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(k.license))), ',') AS notices
  FROM (SELECT doc_id, sha256({_normalised("line")}) AS digest FROM l) x JOIN known k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(m.notices, '') AS notices FROM d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN m ON m.doc_id = d.doc_id"""

_R = quality.LineRules()
_BOILER = quality.BOILERPLATE.removeprefix("(?i)")
_LINE = f"""(len(l) = 0 OR (regexp_matches(l, '[.!?…,;:。！？，、；：।॥؟،؛։።၊။៕]') AND NOT (l = upper(l) AND l <> lower(l)) AND len(l) - len(regexp_replace(l, '[#*$%&|<>]', '', 'g')) <= len(l) * {_R.symbol_share}
  AND NOT (len(l) - len(regexp_replace(l, '[|>»•]', '', 'g')) >= {_R.min_separators} AND (len(l) - len(regexp_replace(l, '[|>»•]', '', 'g'))) * 40 >= len(l))
  AND NOT (len(l) <= {_R.boilerplate_chars} AND regexp_matches(l, '(?i){_BOILER}'))))"""
OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
li AS (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x),
ls AS (SELECT doc_id, count_if(l <> '') - count(DISTINCT CASE WHEN l <> '' THEN line END) AS n_dup_lines, sum(CASE WHEN {_LINE} THEN len(line) ELSE 0 END) + greatest(count_if({_LINE}) - 1, 0) AS kept_chars FROM li GROUP BY doc_id),
wi AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) x),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wi) x WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM tw) x GROUP BY doc_id),
j AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, kept_chars / greatest(len(t), 1) AS share FROM d JOIN ls USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND share >= {_R.min_kept_share} AS kept FROM j"""

OP4 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM q"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4) x
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

_W = "CASE (place - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)) + " END"
OP7 = f"""WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * size)::DOUBLE AS squares FROM z GROUP BY 1),
k AS (SELECT *, {_W} AS weight, 3 * source_size AS cap FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM b) x),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS height FROM k),
g AS (SELECT source, source_size, squares, least(coalesce(weight * (SELECT max(height) FROM v WHERE height <= cap / weight), cap::DOUBLE), cap::DOUBLE) AS target FROM v),
h AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS copies, greatest(round(target)::BIGINT - floor(target / greatest(source_size, 1))::BIGINT * source_size, 0) AS rest FROM g),
o AS (SELECT z.*, source_size, target, copies, rest, CASE WHEN size > 0 AND rest > 0 THEN least(rest::DOUBLE * size::DOUBLE / squares, 0.999999) END AS p FROM z JOIN h ON z.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, CASE WHEN p IS NULL THEN 1.0 ELSE ((u / (1 - u)) * ((1 - p) / p)) / (1 + (u / (1 - u)) * ((1 - p) / p)) END AS key FROM o),
e AS (SELECT *, coalesce(sum(CASE WHEN key < 1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size + CASE WHEN key < 1 THEN greatest(least(size, rest - before), 0) ELSE 0 END)::BIGINT AS taken FROM e"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
_CRC32 = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295), 4294967295)"
_TREE = lambda name, leaves, by: f"""{name} AS ({leaves} UNION ALL
  SELECT {by}, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), max(n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {by}, level, place // 2)"""  # noqa: E731
_SIDES = lambda tree: f"""(SELECT a.g, a.level, a.place, coalesce(CASE WHEN a.place % 2 = 1 THEN b.h END, '') AS l, coalesce(CASE WHEN a.place % 2 = 0 THEN b.h END, '') AS r
  FROM {tree} a LEFT JOIN {tree} b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND b.place = xor(a.place, 1) WHERE a.n > 1)"""  # noqa: E731
OP12 = f"""WITH RECURSIVE d AS (SELECT doc_id, lang AS g, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF("(n_chars + 1)")} ELSE {_LEAF("n_chars")} END AS used FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d),
{_TREE("t", "SELECT g, 0::BIGINT AS level, place, leaf AS h, n FROM p", "g")},
s AS (SELECT g AS name, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
{_TREE("u", "SELECT 0 AS g, 0::BIGINT AS level, place, h, n FROM s", "g")},
e AS (SELECT g, level, place, l, r FROM {_SIDES("t")} x), f AS (SELECT level, place, l, r FROM {_SIDES("u")} x),
lower AS (SELECT p.g, p.place, list(struct_pack(l := l, r := r) ORDER BY level) AS path FROM p JOIN e ON p.g IS NOT DISTINCT FROM e.g AND e.place = p.place >> e.level::INTEGER GROUP BY ALL),
upper AS (SELECT s.name, list(struct_pack(l := l, r := r) ORDER BY level) AS path FROM s JOIN f ON f.place = s.place >> f.level::INTEGER GROUP BY ALL),
j AS (SELECT p.*, s.h AS subroot, list_concat(coalesce(lower.path, []), coalesce(upper.path, [])) AS path FROM p JOIN s ON p.g IS NOT DISTINCT FROM s.name
  LEFT JOIN lower ON p.g IS NOT DISTINCT FROM lower.g AND p.place = lower.place LEFT JOIN upper ON p.g IS NOT DISTINCT FROM upper.name),
k AS (SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(l := used, r := ''), path), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l AS folded_root FROM j)
SELECT *, folded_root = root AS verified FROM k"""
OP13 = f"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {_CRC32} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
d AS (SELECT row_number() OVER () AS row, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM a),
x AS (SELECT row, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS s FROM (SELECT row, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12) y),
m AS (SELECT l.row, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.row = r.row AND l.s = r.s AND l.i < r.i),
o AS (SELECT row, q, min(i) AS start, max(i) + 6 + q AS stop FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM m) z GROUP BY row, q, island),
r AS (SELECT row, start, stop - start AS length, min(q) AS period FROM o WHERE stop - start >= greatest(12, 2 * q) GROUP BY row, start, stop),
b AS (SELECT row, count(*) AS n_runs, list(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period)[1] AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, list(struct_pack(a := start + period, b := start + length)) AS gone FROM r GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: len(list_filter(gone, lambda y: y.a < i AND i <= y.b)) = 0) END, ' ')) AS collapsed_sha256 FROM d LEFT JOIN b ON b.row = d.row"""

ORACLE_SQL = {
    "op1_license_scan": OP1,
    "op3_line_quality": OP3,
    "op4_warc_dictionary": OP4,
    "op6_count_rtree_join": OP6,
    "op7_pareto_mix": OP7,
    "op12_merkle_versions": OP12,
    "op13_lyndon_runs": OP13,
}
