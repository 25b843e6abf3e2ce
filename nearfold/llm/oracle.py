r"""DuckDB SQL for the operators that SQL can express.

Not expressible: byte-level BPE ids (op1, op10), keyed surrogates (op4),
minimum cuts of pages (op5) and the hash order of the mix (op8); those are
tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from nearfold.llm import quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
tri AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g
  FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS n_distinct
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
wrd AS (
  SELECT doc_id, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (upper(word) = word AND lower(word) <> word) AS up
  FROM u GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(wrd.n, 0)::BIGINT AS n_words, coalesce(wrd.chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_lines,
    coalesce(line.n - line.n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(wrd.up, 0)::BIGINT AS n_upper_words
  FROM d LEFT JOIN wrd USING (doc_id) LEFT JOIN line USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper_words > 50 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

_CELLS = ", ".join(f"('{p}', '{r}', {quality_rules.mask(p)}, {quality_rules.bit(r)})" for p, rules in quality_rules.POLICIES.items() for r in rules)
ABLATIONS = f"""
SELECT policy, rule, count_if(failed_bits & bit <> 0) AS n_failed, count_if(failed_bits & mask = bit) AS n_only_this,
  count_if(failed_bits & mask & ~bit = 0) AS n_kept_without, count_if(failed_bits & mask = 0) AS n_kept, bit_or(failed_bits) AS all_bits
FROM ({QUALITY}) led, (VALUES {_CELLS}) c(policy, rule, mask, bit)
GROUP BY policy, rule
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS whole FROM s GROUP BY doc_id),
l AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q USING (sh) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8),
reach AS (SELECT doc_id AS doc, doc_id AS other FROM d UNION SELECT r.doc, l.b FROM reach r JOIN l ON r.other = l.a)
SELECT d.doc_id, (SELECT min(other) FROM reach WHERE doc = d.doc_id) AS class_id,
  (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links,
  coalesce((SELECT count(*) FROM n y WHERE y.whole = n.whole AND y.n = n.n), 0) + CASE WHEN n.n IS NULL THEN 1 ELSE 0 END AS copies,
  coalesce(n.n, 0) AS n_shingles
FROM d LEFT JOIN n USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
o AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, 'start') AS before,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS escaped
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT *, (before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'),
    ('tool', 'assistant'), ('assistant', 'user'), ('assistant', 'tool')) AS fine FROM o),
r AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(url_encode(role)) + 1 + escaped + 10 + 1) AS formatted_chars,
    min(pos) FILTER (NOT fine) AS bad_turn, arg_max(role, pos) AS last
  FROM g GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, bad_turn IS NULL AND last = 'assistant' AS valid, bad_turn::INTEGER AS bad_turn
FROM r
"""

EXACT = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) AS text_sha256 FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def sql() -> dict[str, str]:
    return {
        "op2_quality_rules": QUALITY,
        "quality_ablations": ABLATIONS,
        "op3_ngram_join": NEAR,
        "op6_warc": WARC,
        "op7_chat_formatting": CHAT,
        "op9_exact_dedup": EXACT,
    }
