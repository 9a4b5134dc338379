"""DuckDB SQL for the queries that SQL can express; each is written from the query's definition."""

from __future__ import annotations

from .license_texts import KNOWN
from .licenses import SPELLINGS
from .secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH RECURSIVE s AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, text, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM s),
e AS (SELECT *, doc_id::HUGEINT * 2147483648 + line_no AS pos FROM l WHERE length(line) >= 10),
d AS (SELECT line, min(pos) AS pos, count(*) AS n FROM e GROUP BY line),
m AS (SELECT * FROM d WHERE length(line) >= 40),
p AS (SELECT x.line AS a, y.line AS b FROM m x JOIN m y ON left(x.line, 20) = left(y.line, 20) AND x.line < y.line
  UNION SELECT x.line, y.line FROM m x JOIN m y ON right(x.line, 20) = right(y.line, 20) AND x.line < y.line),
k AS (SELECT a, b FROM p WHERE abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) <= 1),
both_ways AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
firsts AS (SELECT r.a AS line, min(least(x.pos, y.pos)) AS first FROM reach r JOIN m x ON x.line = r.a JOIN m y ON y.line = r.b GROUP BY r.a),
degree AS (SELECT a AS line, count(*) AS n_links FROM both_ways GROUP BY a),
known AS (SELECT d.line, coalesce(f.first, d.pos) AS first, coalesce(g.n_links, 0) AS n_links FROM d
  LEFT JOIN firsts f ON f.line = d.line LEFT JOIN degree g ON g.line = d.line WHERE d.n > 1 OR f.first IS NOT NULL),
marked AS (SELECT l.doc_id, l.line_no, l.line, k.first, k.n_links, coalesce(l.doc_id::HUGEINT * 2147483648 + l.line_no > k.first, false) AS gone
  FROM l LEFT JOIN known k ON k.line = l.line),
per AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(sum(n_links), 0)::BIGINT AS n_links, min(first) AS first,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, n_dropped, n_links, (first // 2147483648)::BIGINT AS class_doc_id, (first % 2147483648)::BIGINT AS class_line,
  length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM per
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)))) & 31)::INT, 1)
  FOR i IN range(32)], 'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS top FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical(t: str, whole: bool) -> str:
    t = f"lower({t})"
    if whole:
        t = f"regexp_replace({t}, '(?:^|\\n)[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|\\(c\\)|©)[^\\n]*', '', 'g')"
    t = f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        t = f"replace({t}, {_quote(a)}, {_quote(b)})"
    return t


def _op4() -> str:
    known = ", ".join(f"({_quote(i)}, {_quote(t)}, {str(w).lower()})" for i, t, w in KNOWN)
    return f"""
WITH known(license_id, text, entire) AS (VALUES {known}),
whole AS (SELECT sha256({_canonical("text", True)}) AS digest, min(license_id) AS license_id FROM known WHERE entire GROUP BY 1),
notice AS (SELECT sha256({_canonical("text", False)}) AS digest, min(license_id) AS license_id FROM known WHERE NOT entire GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
hit AS (SELECT l.doc_id, count(*) AS n_notices, string_agg(DISTINCT n.license_id, ',' ORDER BY n.license_id) AS notices
  FROM l JOIN notice n ON n.digest = sha256({_canonical("l.line", False)}) GROUP BY l.doc_id),
c AS (SELECT doc_id, sha256({_canonical("text", True)}) AS digest FROM d)
SELECT c.doc_id, c.digest, w.license_id, coalesce(h.n_notices, 0) AS n_notices, coalesce(h.notices, '') AS notices
FROM c LEFT JOIN whole w ON w.digest = c.digest LEFT JOIN hit h ON h.doc_id = c.doc_id
"""


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT a.doc_id, a.i, a.n, x.item FROM spot a JOIN win x ON x.n = a.n AND x.words = a.words),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id),
place AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
numbered AS (SELECT row_number() OVER () AS win, item, n, string_split(words, ' ') AS w FROM win),
part AS (SELECT win, item, n, unnest(w) AS term, unnest(range(0, n)) AS j FROM numbered),
freq AS (SELECT term, count(*) AS n FROM place GROUP BY term),
anchor AS (SELECT p.win, arg_min(p.term, coalesce(f.n, 0) * 1000 + p.j) AS term, arg_min(p.j, coalesce(f.n, 0) * 1000 + p.j) AS j FROM part p LEFT JOIN freq f ON f.term = p.term GROUP BY p.win),
start AS (SELECT DISTINCT a.win, t.doc_id, t.p - a.j + o.off AS s FROM anchor a JOIN place t ON t.term = a.term, (SELECT unnest(range(-2, 3)) AS off) o),
close AS (SELECT s.win, s.doc_id, s.s FROM start s JOIN part q ON q.win = s.win
  JOIN place t ON t.doc_id = s.doc_id AND t.term = q.term AND t.p BETWEEN s.s + q.j - 2 AND s.s + q.j + 2
  GROUP BY s.win, s.doc_id, s.s, q.n HAVING count(DISTINCT q.j) = q.n),
near AS (SELECT c.doc_id, count(DISTINCT x.item) AS n_near_items FROM close c JOIN numbered x ON x.win = c.win GROUP BY c.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(x.n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN near x ON x.doc_id = d.doc_id
"""


def _op8() -> str:
    either = "".join
    ci = lambda w: either(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(ci(w) for w in ("password", "passwd", "secret", "token")) + "|" + ci("api") + "_?" + ci("key")
    kinds = (
        ("assign", 0, f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
        ("hex", 2, "[0-9a-f]+", 0, 16),
        ("vendor", 3, "(?:gh[pousr]_|xox[abprs]-|sk_live_|eyJ)[A-Za-z0-9_.-]+", 0, 20),
    )
    parts = []
    for name, rank, pattern, group, least in kinds:
        parts.append(f"""
SELECT rid, doc_id, source, {rank} AS rank, '{name}' AS kind, spot AS start, spot + length(m[i]) AS stop, v[i] AS value FROM (
  SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS spot FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
        string_split_regex(text, '{pattern}') AS g FROM d))) WHERE length(v[i]) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners,
  count(DISTINCT coalesce('=' || source, '') || chr(10) || coalesce('=' || doc_id, '')) AS repositories FROM s GROUP BY value),
x AS (SELECT s.*, f.owners, f.repositories, f.owners < {EXAMPLE_OWNERS} AND f.repositories < {EXAMPLE_REPOSITORIES} AS live FROM s JOIN f ON f.value = s.value),
per AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3 OR live) AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example, max(owners) AS n_owners, max(repositories) AS n_repositories FROM x GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repositories, 0) AS n_repositories FROM d LEFT JOIN per ON per.rid = d.rid
"""


OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM c),
r AS (SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') THEN escaped ELSE text END AS body FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

ORACLES = {"op1_line_dedup": OP1, "op3_warc": OP3, "op4_licenses": _op4(), "op6_decontaminate": OP6, "op8_secrets": _op8(), "op9_chat": OP9}
