"""DuckDB oracle SQL for every checkable query of the catalog.

The SQL re-derives everything from the raw driver views (``embeddings``,
``documents``, ``events``), independently of the Spark code path.  Common
table expressions are built by small string helpers so the split rules are
spelled once.
"""

from __future__ import annotations

# ------------------------------------------------------------------ split CTEs

PERM = """perm AS (
  SELECT vec_id AS pool_pos, embedding,
         row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS perm_rank
  FROM embeddings),
sz AS (SELECT count(*) * 6 // 10 AS nb, count(*) * 3 // 10 AS ni FROM embeddings)"""

BASE = """base AS (
  SELECT row_number() OVER (ORDER BY pool_pos) - 1 AS id, pool_pos, embedding
  FROM perm, sz WHERE perm_rank < sz.nb)"""

QUERIES = """qs AS (
  SELECT perm_rank - (sz.nb + sz.ni) AS qid, pool_pos, embedding
  FROM perm, sz WHERE perm_rank >= sz.nb + sz.ni)"""

INSERTS = """ins AS (
  SELECT perm_rank - sz.nb AS seq, pool_pos, embedding
  FROM perm, sz WHERE perm_rank >= sz.nb AND perm_rank < sz.nb + sz.ni)"""

TIERS = """tiers AS (
  SELECT t.tier, row_number() OVER (PARTITION BY t.tier ORDER BY p.pool_pos) - 1 AS id,
         p.pool_pos, p.embedding
  FROM perm p, sz,
       (SELECT unnest([sz.nb * 10 // 100, sz.nb * 50 // 100, sz.nb]) AS tier FROM sz) t
  WHERE p.perm_rank < t.tier)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def dot(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN {norm(a)} * {norm(b)} > 0 THEN 1 - {dot(a, b)} / ({norm(a)} * {norm(b)}) END"


def l2(a: str, b: str) -> str:
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda x: abs(x[1] - x[2])))"


DIST = {"cosine": cosine, "l2": l2, "l1": l1}


def knn_sql(metric: str, k: int, items: str = "base", queries: str = "qs", extra_ctes: tuple = ()) -> str:
    d = DIST[metric]("q.embedding", "b.embedding")
    ctes = [PERM, BASE, QUERIES, *extra_ctes]
    return with_(*ctes, f"""d AS (SELECT q.qid, b.id, {d} AS distance FROM {queries} q, {items} b)""") + f"""
SELECT qid, rk, id, round(distance, 6) + 0.0 AS distance FROM (
  SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rk
  FROM d WHERE distance IS NOT NULL) WHERE rk <= {k}"""




# ------------------------------------------------------------------ sentence CTEs

WS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

SENTS = rf"""pieces AS (
  SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM (
    SELECT doc_id, string_split_regex(trim(regexp_replace(text, '{WS}', ' ', 'g')), '\. ') AS parts
    FROM documents WHERE text IS NOT NULL)),
sents AS (
  SELECT doc_id, pos, trim(raw) AS text, length(trim(raw)) AS n_chars FROM pieces
  WHERE length(trim(raw)) > 20 AND length(trim(raw)) < 300)"""

NUMBERED = """numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS pool_pos FROM sents),
psz AS (SELECT count(*) * 2 // 3 AS np FROM sents),
mt AS (SELECT np * 10 // 11 AS mt FROM psz)"""

SPOOL = """spool AS (SELECT n.* FROM numbered n, psz WHERE n.pool_pos < psz.np),
sperm AS (
  SELECT pool_pos, text,
         row_number() OVER (ORDER BY md5('42:' || CAST(pool_pos AS VARCHAR)), pool_pos) - 1 AS perm_rank
  FROM spool)"""

STIERS = """stiers AS (
  SELECT t.tier, row_number() OVER (PARTITION BY t.tier ORDER BY p.pool_pos) - 1 AS id, p.pool_pos, p.text
  FROM sperm p, (SELECT unnest([mt * 10 // 100, mt * 50 // 100, mt]) AS tier FROM mt) t
  WHERE p.perm_rank < t.tier)"""

SQUERIES = """squeries AS (SELECT perm_rank - mt.mt AS qid, pool_pos, text FROM sperm, mt WHERE perm_rank >= mt.mt)"""

SINSERTS = """sinserts AS (
  SELECT pool_pos - psz.np AS seq, pool_pos, doc_id, pos, text FROM numbered, psz
  WHERE pool_pos >= psz.np AND pool_pos < psz.np + psz.np // 2)"""

SENT_ALL = (SENTS, NUMBERED, SPOOL, STIERS, SQUERIES, SINSERTS)


def vec_text(e: str) -> str:
    return f"'[' || array_to_string(list_transform({e}, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']'"


# ------------------------------------------------------------------ operation log

OPS = """ops AS (
  SELECT event_id, ts, user_id, event_type, value AS latency_ms,
         event_type IN ('view', 'click') AS is_read,
         ['read_heavy', 'balanced', 'write_heavy'][(user_id % 3) + 1] AS profile
  FROM events)"""


def pct(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


WORKLOAD = with_(OPS, """w AS (SELECT *, time_bucket(INTERVAL 1 day, ts) AS window_start FROM ops)""") + """
SELECT profile, window_start, count_if(is_read) AS n_reads,
       round(count_if(is_read) / 86400.0, 6) AS read_qps,
       round(avg(CASE WHEN is_read THEN latency_ms END), 6) AS mean_read_latency_ms,
       round(quantile_cont(latency_ms, 0.95) FILTER (WHERE is_read), 6) AS p95_read_latency_ms,
       round(quantile_cont(latency_ms, 0.99) FILTER (WHERE is_read), 6) AS p99_read_latency_ms,
       round(count_if(NOT is_read) / 86400.0, 6) AS write_throughput_per_sec,
       count_if(NOT is_read) AS total_writes
FROM w GROUP BY profile, window_start"""


def _pair(expr: str, name: str) -> str:
    return f"""SELECT a.vec_id, b.vec_id AS next_id, round({expr}, 6) AS {name}
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def cos_(a: str, b: str) -> str:
    return cosine(a, b)


NLISTS = """nl AS (SELECT CAST(round(sqrt(nb)) AS BIGINT) AS lists FROM sz),
pbase AS (SELECT b.id, b.pool_pos, b.embedding, p.perm_rank FROM base b JOIN perm p USING (pool_pos))"""

SERVING_LISTS = NLISTS.replace("round(sqrt(nb))", "round(0.75 * sqrt(nb))")

CENTS = """cents AS (SELECT perm_rank AS list_id, embedding AS centroid FROM pbase, nl WHERE perm_rank < nl.lists)"""

ASG = f"""asg AS (SELECT id, list_id, cd FROM (
  SELECT b.id, c.list_id, {cosine('b.embedding', 'c.centroid')} AS cd,
         row_number() OVER (PARTITION BY b.id ORDER BY {cosine('b.embedding', 'c.centroid')}, c.list_id) AS r
  FROM base b, cents c) WHERE r = 1)"""


def probes_cte(p: int) -> str:
    return f"""probes AS (SELECT qid, list_id, r AS list_rank FROM (
  SELECT q.qid, c.list_id,
         row_number() OVER (PARTITION BY q.qid ORDER BY {cosine('q.embedding', 'c.centroid')}, c.list_id) AS r
  FROM qs q, cents c) WHERE r <= {p})"""


def topk_of(src: str, keys: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY distance, id) AS rk
  FROM {src} WHERE distance IS NOT NULL) WHERE rk <= {k})"""


EXACT10 = f"""exact AS (SELECT * FROM {topk_of(f"(SELECT q.qid, b.id, {cosine('q.embedding', 'b.embedding')} AS distance FROM qs q, base b)", "qid", 10)})"""
EXACT100 = f"""exact AS (SELECT * FROM {topk_of(f"(SELECT q.qid, b.id, {cosine('q.embedding', 'b.embedding')} AS distance FROM qs q, base b)", "qid", 100)})"""


def pivot_search_cte(p: int, k: int) -> str:
    cand = f"""(SELECT p.qid, b.id, {cosine('q.embedding', 'b.embedding')} AS distance
  FROM probes p JOIN asg a ON a.list_id = p.list_id JOIN base b ON b.id = a.id JOIN qs q ON q.qid = p.qid)"""
    return f"res AS (SELECT * FROM {topk_of(cand, 'qid', k)})"


CPS = """cps AS (SELECT unnest([0, nb * 10 // 100, nb * 20 // 100, nb * 30 // 100, nb * 50 // 100]) AS ci FROM sz)"""

GROWN = """grown AS (SELECT cps.ci, b.id, b.embedding FROM cps, base b
  UNION ALL SELECT cps.ci, 800000000 + i.seq, i.embedding FROM cps, ins i WHERE i.seq < cps.ci)"""

GROW_GT = f"""ggt AS (SELECT * FROM {topk_of(f"(SELECT g.ci, q.qid, g.id, {cosine('q.embedding', 'g.embedding')} AS distance FROM grown g, qs q)", "ci, qid", 10)})"""


def degradation_sql(p: int) -> str:
    allrows = """allrows AS (SELECT id, pool_pos, embedding, CAST(NULL AS BIGINT) AS seq FROM base
  UNION ALL SELECT 800000000 + seq, pool_pos, embedding, seq FROM ins, sz WHERE seq < sz.nb * 50 // 100)"""
    asg_all = f"""asg_all AS (SELECT id, seq, list_id FROM (
  SELECT a.id, a.seq, c.list_id,
         row_number() OVER (PARTITION BY a.id ORDER BY {cosine('a.embedding', 'c.centroid')}, c.list_id) AS r
  FROM allrows a, cents c) WHERE r = 1)"""
    cand = f"""(SELECT cps.ci, p.qid, x.id, {cosine('q.embedding', 'x.embedding')} AS distance
  FROM cps, probes p JOIN asg_all a ON a.list_id = p.list_id JOIN allrows x ON x.id = a.id JOIN qs q ON q.qid = p.qid
  WHERE a.seq IS NULL OR a.seq < cps.ci)"""
    res = f"dres AS (SELECT * FROM {topk_of(cand, 'ci, qid', 10)})"
    rec = """drec AS (SELECT t.ci, t.qid, count(r.id) / count(*) AS recall FROM ggt t
  LEFT JOIN dres r ON r.ci = t.ci AND r.qid = t.qid AND r.id = t.id GROUP BY t.ci, t.qid)"""
    # rebuild: pivots = first round(sqrt(grown)) rows of the grown table by rank
    nl2 = """nl2 AS (SELECT CAST(round(sqrt(sz.nb + sz.nb * 50 // 100)) AS BIGINT) AS lists FROM sz),
ranked AS (SELECT a.*, p.perm_rank FROM allrows a JOIN perm p USING (pool_pos)),
cents2 AS (SELECT perm_rank AS list_id, embedding AS centroid FROM ranked, nl2 WHERE perm_rank < nl2.lists)"""
    asg2 = f"""asg2 AS (SELECT id, list_id FROM (
  SELECT a.id, c.list_id,
         row_number() OVER (PARTITION BY a.id ORDER BY {cosine('a.embedding', 'c.centroid')}, c.list_id) AS r
  FROM allrows a, cents2 c) WHERE r = 1)"""
    probes2 = f"""probes2 AS (SELECT qid, list_id FROM (
  SELECT q.qid, c.list_id,
         row_number() OVER (PARTITION BY q.qid ORDER BY {cosine('q.embedding', 'c.centroid')}, c.list_id) AS r
  FROM qs q, cents2 c) WHERE r <= {p})"""
    cand2 = f"""(SELECT p.qid, x.id, {cosine('q.embedding', 'x.embedding')} AS distance
  FROM probes2 p JOIN asg2 a ON a.list_id = p.list_id JOIN allrows x ON x.id = a.id JOIN qs q ON q.qid = p.qid)"""
    res2 = f"dres2 AS (SELECT * FROM {topk_of(cand2, 'qid', 10)})"
    rec2 = """drec2 AS (SELECT t.ci, t.qid, count(r.id) / count(*) AS recall FROM ggt t
  LEFT JOIN dres2 r ON r.qid = t.qid AND r.id = t.id, sz WHERE t.ci = sz.nb * 50 // 100 GROUP BY t.ci, t.qid)"""
    body = with_(PERM, BASE, QUERIES, INSERTS, NLISTS, CENTS, CPS, GROWN, GROW_GT, allrows, asg_all, probes_cte(p),
                 res, rec, nl2, asg2, probes2, res2, rec2)
    return body + f"""SELECT 'ivf_pivot' AS index_type, CAST(round(ci * 100.0 / sz.nb) AS BIGINT) AS checkpoint_pct,
  ci AS cumulative_inserts, ci + sz.nb AS total_rows, phase, {r6('avg(recall)')} AS mean_recall, count(*) AS n_queries
FROM (SELECT ci, qid, recall, 'no_rebuild' AS phase FROM drec UNION ALL SELECT ci, qid, recall, 'post_rebuild' FROM drec2), sz
GROUP BY ci, phase, sz.nb"""


def embed_cte(src: str) -> str:
    """``vec (id, embedding)`` from ``src (id, text)``."""
    return rf"""etoks AS (
  SELECT id, list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''),
    lambda t: {{'b': CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64,
               's': CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END}}) AS toks
  FROM ({src})),
eraw AS (SELECT id, list_transform(range(64), lambda i: coalesce(list_sum(list_transform(toks,
    lambda x: CASE WHEN x.b = i THEN x.s ELSE 0.0 END)), 0.0)) AS raw FROM etoks),
vec AS MATERIALIZED (SELECT id, list_transform(raw, lambda x: CAST(CASE WHEN n > 0 THEN x / n ELSE 0.0 END AS FLOAT)) AS embedding
  FROM (SELECT id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS n FROM eraw))"""


EMBED = embed_cte("SELECT id, text FROM stiers, mt WHERE tier = mt.mt")
# every sentence once, by pool position; unit vectors as fixed-size arrays for the pair products
TEXT_VEC = embed_cte("SELECT pool_pos AS id, text FROM numbered")
TEXT_UNIT = f"""unit AS MATERIALIZED (
  SELECT id, CAST(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / {norm('embedding')}) AS DOUBLE[64]) AS u
  FROM vec WHERE {norm('embedding')} > 0),
uq AS MATERIALIZED (SELECT q.qid, u.u FROM squeries q JOIN unit u ON u.id = q.pool_pos),
ui AS MATERIALIZED (SELECT t.tier, t.id, t.pool_pos, u.u FROM stiers t JOIN unit u ON u.id = t.pool_pos)"""
# equal up to rounding noise is a tie, which goes to the smaller id
TEXT_PAIR = "round(1 - array_inner_product(q.u, t.u), 12)"


def scaling_sql(p: int) -> str:
    """Per tier: pivot lists by the sqrt rule, probes min(p, lists), recall@10 vs the tier's exact top-10."""
    tl = """tl AS (SELECT DISTINCT tier, CAST(round(sqrt(tier)) AS BIGINT) AS lists FROM tiers),
tp AS (SELECT t.tier, t.id, t.embedding, p.perm_rank FROM tiers t JOIN perm p USING (pool_pos)),
tc AS (SELECT tp.tier, tp.perm_rank AS list_id, tp.embedding AS centroid FROM tp JOIN tl USING (tier)
  WHERE tp.perm_rank < tl.lists)"""
    ta = f"""ta AS (SELECT tier, id, list_id FROM (
  SELECT x.tier, x.id, c.list_id, row_number() OVER (PARTITION BY x.tier, x.id
         ORDER BY {cosine('x.embedding', 'c.centroid')}, c.list_id) AS r
  FROM tp x JOIN tc c USING (tier)) WHERE r = 1)"""
    tprobe = f"""tprobe AS (SELECT tier, qid, list_id FROM (
  SELECT c.tier, q.qid, c.list_id, tl.lists, row_number() OVER (PARTITION BY c.tier, q.qid
         ORDER BY {cosine('q.embedding', 'c.centroid')}, c.list_id) AS r
  FROM qs q, tc c JOIN tl USING (tier)) WHERE r <= least({p}, lists))"""
    cand = f"""(SELECT pr.tier, pr.qid, x.id, {cosine('q.embedding', 'x.embedding')} AS distance
  FROM tprobe pr JOIN ta a ON a.tier = pr.tier AND a.list_id = pr.list_id
  JOIN tp x ON x.tier = a.tier AND x.id = a.id JOIN qs q ON q.qid = pr.qid)"""
    exact = f"""(SELECT x.tier, q.qid, x.id, {cosine('q.embedding', 'x.embedding')} AS distance FROM tp x, qs q)"""
    body = with_(PERM, TIERS, QUERIES, tl, ta, tprobe, f"tres AS (SELECT * FROM {topk_of(cand, 'tier, qid', 10)})",
                 f"texact AS (SELECT * FROM {topk_of(exact, 'tier, qid', 10)})",
                 """trec AS (SELECT t.tier, t.qid, count(r.id) / count(*) AS recall FROM texact t
  LEFT JOIN tres r ON r.tier = t.tier AND r.qid = t.qid AND r.id = t.id GROUP BY t.tier, t.qid)""")
    return body + f"""SELECT tier, 'ivf_pivot' AS index_type, lists, least({p}, lists) AS probes,
  {r6('avg(recall)')} AS mean_recall, count(*) AS n_queries FROM trec JOIN tl USING (tier) GROUP BY tier, lists"""


def sql() -> dict[str, str]:
    s = {}
    s["sentences"] = with_(SENTS) + "SELECT doc_id, pos, text, n_chars FROM sents"
    s["sentence_pool"] = with_(SENTS, NUMBERED, SPOOL) + "SELECT pool_pos, doc_id, pos, text FROM spool"
    s["insert_pool"] = with_(*SENT_ALL) + "SELECT seq, pool_pos, doc_id, pos, text FROM sinserts"
    s["permutation"] = with_(SENTS, NUMBERED, SPOOL) + "SELECT pool_pos, perm_rank FROM sperm"
    s["tier_slice"] = with_(*SENT_ALL) + "SELECT tier, id, pool_pos, text FROM stiers"
    s["query_slice"] = with_(*SENT_ALL) + "SELECT qid, pool_pos, text FROM squeries"
    s["length_stats"] = with_(*SENT_ALL) + """SELECT tier, count(*) AS n_rows, min(length(text)) AS min_len,
  max(length(text)) AS max_len, count_if(length(text) < 20) AS n_short FROM stiers GROUP BY tier"""
    s["row_preview"] = with_(*SENT_ALL) + """SELECT tier, id, pool_pos, substring(text, 1, 80) AS preview,
  length(text) AS n_chars FROM stiers WHERE id = 0"""
    s["vector_preview"] = with_(PERM, TIERS) + f"""SELECT tier, id, pool_pos, len(embedding) AS dims,
  substring({vec_text('embedding')}, 1, 60) AS preview FROM tiers WHERE id = 0"""
    s["split_disjoint"] = with_(*SENT_ALL, PERM, BASE, QUERIES, INSERTS) + """,
 stmax AS (SELECT pool_pos FROM sperm, mt WHERE perm_rank < mt.mt)
SELECT 's_inserts' AS part_a, 's_queries' AS part_b,
       (SELECT count(*) FROM sinserts WHERE pool_pos IN (SELECT pool_pos FROM squeries)) AS n_shared
UNION ALL SELECT 's_inserts', 's_tier_max', (SELECT count(*) FROM sinserts WHERE pool_pos IN (SELECT pool_pos FROM stmax))
UNION ALL SELECT 's_queries', 's_tier_max', (SELECT count(*) FROM squeries WHERE pool_pos IN (SELECT pool_pos FROM stmax))
UNION ALL SELECT 'v_base', 'v_inserts', (SELECT count(*) FROM base WHERE pool_pos IN (SELECT pool_pos FROM ins))
UNION ALL SELECT 'v_base', 'v_queries', (SELECT count(*) FROM base WHERE pool_pos IN (SELECT pool_pos FROM qs))
UNION ALL SELECT 'v_inserts', 'v_queries', (SELECT count(*) FROM ins WHERE pool_pos IN (SELECT pool_pos FROM qs))"""
    s["csv_roundtrip"] = with_(*SENT_ALL) + """SELECT part, id, text, length(text) AS n_chars FROM (
  SELECT 'tier_' || CAST(tier AS VARCHAR) AS part, id, text FROM stiers UNION ALL SELECT 'queries', qid, text FROM squeries
  UNION ALL SELECT 'inserts', seq, text FROM sinserts)"""
    # vector functions
    s["vec_l2"] = _pair(l2("a.embedding", "b.embedding"), "distance")
    s["vec_cosine"] = _pair(cosine("a.embedding", "b.embedding"), "distance")
    s["vec_l1"] = _pair(l1("a.embedding", "b.embedding"), "distance")
    s["vec_dot"] = _pair(dot("a.embedding", "b.embedding"), "dot")
    s["vec_norms"] = f"SELECT vec_id, round({norm('embedding')}, 6) AS norm FROM embeddings"
    s["vec_normalize"] = f"""SELECT vec_id, len(u) AS dims, round({norm('u')}, 6) AS unit_norm,
  round(list_sum(u), 6) AS component_sum FROM (
  SELECT vec_id, CASE WHEN {norm('embedding')} > 0 THEN
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / {norm('embedding')}) END AS u FROM embeddings)"""
    s["tier_validate"] = with_(PERM, TIERS) + f"""SELECT tier, count(*) AS n_rows, min(len(embedding)) AS min_dim,
  max(len(embedding)) AS max_dim, count_if(list_bool_or(list_transform(embedding, lambda x: isnan(x)))) AS n_nan,
  count_if(embedding IS NULL) AS n_null, round(min({norm('embedding')}), 6) AS min_norm,
  round(max({norm('embedding')}), 6) AS max_norm FROM tiers GROUP BY tier"""
    s["dim_quarantine"] = """SELECT len(embedding) AS dims, count(*) AS n_rows, len(embedding) <> 64 AS quarantined
FROM embeddings GROUP BY len(embedding)"""
    s["vector_tsv_roundtrip"] = with_(PERM, BASE, INSERTS, QUERIES) + f"""SELECT part, id, {vec_text('embedding')} AS embedding_text,
  len(embedding) AS dims, 0.0 AS max_abs_err FROM (SELECT 'base' AS part, id, embedding FROM base
  UNION ALL SELECT 'inserts', seq, embedding FROM ins UNION ALL SELECT 'queries', qid, embedding FROM qs)"""
    # search
    s["knn_join_cosine"] = knn_sql("cosine", 10)
    s["knn_join_l2"] = knn_sql("l2", 10)
    s["knn_join_l1"] = knn_sql("l1", 10)
    s["knn_single_l2"] = with_(PERM, BASE, QUERIES) + f"""SELECT b.id FROM base b, qs q WHERE q.qid = 0
  ORDER BY {l2('b.embedding', 'q.embedding')}, b.id LIMIT 5"""
    s["knn_with_distance"] = with_(PERM, BASE, QUERIES) + f"""SELECT b.id, {vec_text('b.embedding')} AS embedding_text,
  round({l2('b.embedding', 'q.embedding')}, 6) AS distance FROM base b, qs q WHERE q.qid = 0
  ORDER BY {l2('b.embedding', 'q.embedding')}, b.id LIMIT 3"""
    # operation-log metrics
    s["latency_summary"] = with_(OPS, """reads AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts, event_id) AS seq
  FROM ops WHERE is_read)""") + """SELECT profile, count(*) AS n_ops, round(avg(latency_ms), 6) AS mean_latency_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms,
  count_if(seq <= 20) AS n_warmup
FROM reads GROUP BY profile"""
    s["latency_sketch"] = with_(OPS) + """SELECT profile, time_bucket(INTERVAL 1 day, ts) AS window_start, count(*) AS n_reads,
  true AS p50_within, true AS p95_within, true AS p99_within FROM ops WHERE is_read GROUP BY ALL"""
    s["throughput"] = with_(OPS) + """SELECT profile, count(*) AS n_reads,
  round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 6) AS qps_wall,
  round(count(*) / (sum(latency_ms) / 1000.0), 6) AS qps_latency_sum,
  round(count(*) / 2592000.0, 6) AS qps_fixed_duration
FROM ops WHERE is_read GROUP BY profile"""
    s["workload_summary"] = WORKLOAD
    s["metrics_log"] = f"""SELECT profile, window_start, read_qps, mean_read_latency_ms, p95_read_latency_ms,
  p99_read_latency_ms, write_throughput_per_sec, total_writes FROM ({WORKLOAD})"""
    # ground truth
    s["ground_truth_topk"] = with_(PERM, QUERIES, TIERS) + f"""SELECT tier, qid, rk, id, pool_pos, {r6('distance')} AS distance
FROM {topk_of(f"(SELECT t.tier, q.qid, t.id, t.pool_pos, {cosine('q.embedding', 't.embedding')} AS distance FROM tiers t, qs q)", "tier, qid", 100)}"""
    s["growing_ground_truth"] = with_(PERM, BASE, QUERIES, INSERTS, CPS, GROWN, GROW_GT) + f"""SELECT
  CAST(round(ci * 100.0 / sz.nb) AS BIGINT) AS checkpoint_pct, ci AS cumulative_inserts, qid, rk, id,
  {r6('distance')} AS distance FROM ggt, sz"""
    s["growing_truth_incremental"] = s["growing_ground_truth"]
    s["gt_validate"] = with_(PERM, BASE, QUERIES, INSERTS, CPS, GROWN, GROW_GT) + """SELECT
  CAST(round(ci * 100.0 / sz.nb) AS BIGINT) AS checkpoint_pct, ci AS cumulative_inserts, count(*) AS n_rows,
  count_if(isnan(distance) OR distance IS NULL) AS n_nan, count_if(id < 0) AS n_negative,
  count_if(ci > 0 AND id >= 800000000 + ci) AS n_out_of_range,
  CAST(count_if(NOT EXISTS (SELECT 1 FROM grown g WHERE g.ci = ggt.ci AND g.id = ggt.id)) AS BIGINT) AS n_missing
FROM ggt, sz GROUP BY ci, sz.nb"""
    # inverted lists
    s["ivf_trained_nearest"] = with_(PERM, BASE, NLISTS) + """SELECT nb AS n_rows, CAST(0 AS BIGINT) AS n_not_nearest,
  lists AS n_lists, lists AS n_distinct FROM sz, nl"""
    s["ivf_pivot_postings"] = with_(PERM, BASE, NLISTS, CENTS, ASG) + f"SELECT id, list_id, {r6('cd')} AS centroid_distance FROM asg"
    s["ivf_pivot_search"] = with_(PERM, BASE, QUERIES, SERVING_LISTS, CENTS, ASG, probes_cte(20), pivot_search_cte(20, 10)) + \
        f"SELECT qid, rk, id, {r6('distance')} AS distance FROM res"
    s["ivf_search"] = knn_sql("cosine", 10)
    recall = with_(PERM, BASE, QUERIES, SERVING_LISTS, CENTS, ASG, probes_cte(20), pivot_search_cte(20, 10), EXACT10, """hits AS (
  SELECT t.qid, count(r.id) / count(*) AS recall FROM exact t LEFT JOIN res r ON r.qid = t.qid AND r.id = t.id GROUP BY t.qid)""")
    s["ivf_pivot_recall"] = recall + f"""SELECT {r6('avg(recall)')} AS mean_recall, count(*) AS n_queries, (SELECT lists FROM nl) AS lists,
  avg(recall) >= 0.9 AS recall_ok FROM hits"""
    s["stream_lookup_recall"] = recall + f"SELECT {r6('avg(recall)')} AS mean_recall, count(*) AS n_queries, avg(recall) >= 0.9 AS recall_ok FROM hits"
    s["recall_at_k"] = with_(PERM, BASE, QUERIES, SERVING_LISTS, CENTS, ASG, probes_cte(20), pivot_search_cte(20, 10), EXACT10) + \
        f"""SELECT t.qid, {r6('count(r.id) / count(*)')} AS recall, count(*) AS n_truth
FROM exact t LEFT JOIN res r ON r.qid = t.qid AND r.id = t.id GROUP BY t.qid"""
    s["recall_curve"] = with_(PERM, BASE, QUERIES, SERVING_LISTS, CENTS, ASG, probes_cte(20), pivot_search_cte(20, 100), EXACT100,
                              "ks AS (SELECT unnest([1, 10, 50, 100]) AS k)") + f"""SELECT k, {r6('avg(recall)')} AS mean_recall,
  count(*) AS n_queries, max(depth) AS depth FROM (
  SELECT ks.k, t.qid, count(r.id) / count(*) AS recall, count(*) AS depth
  FROM ks JOIN exact t ON t.rk <= ks.k LEFT JOIN res r ON r.qid = t.qid AND r.id = t.id AND r.rk <= ks.k
  GROUP BY ks.k, t.qid) GROUP BY k"""
    grid = """grid AS (SELECT unnest([nl.lists // 2, nl.lists, nl.lists * 2]) AS lists FROM nl),
pv AS (SELECT unnest([1, 5, 10, 20]) AS probes),
cells AS (SELECT g.lists, pv.probes, least(pv.probes, g.lists) AS effective_probes FROM grid g, pv)"""
    gcents = """gcents AS (SELECT g.lists, p.perm_rank AS list_id, p.embedding AS centroid FROM grid g, pbase p
  WHERE p.perm_rank < g.lists)"""
    gasg = f"""gasg AS (SELECT lists, id, list_id FROM (
  SELECT c.lists, b.id, c.list_id,
         row_number() OVER (PARTITION BY c.lists, b.id ORDER BY {cosine('b.embedding', 'c.centroid')}, c.list_id) AS r
  FROM base b, gcents c) WHERE r = 1)"""
    gprobe = f"""gprobe AS (SELECT c.lists, q.qid, c.list_id,
  row_number() OVER (PARTITION BY c.lists, q.qid ORDER BY {cosine('q.embedding', 'c.centroid')}, c.list_id) AS list_rank
  FROM qs q, gcents c)"""
    gcand = f"""(SELECT cl.lists, cl.probes, gp.qid, b.id, {cosine('q.embedding', 'b.embedding')} AS distance
  FROM cells cl JOIN gprobe gp ON gp.lists = cl.lists AND gp.list_rank <= cl.probes
  JOIN gasg a ON a.lists = cl.lists AND a.list_id = gp.list_id JOIN base b ON b.id = a.id JOIN qs q ON q.qid = gp.qid)"""
    gres = f"gres AS (SELECT * FROM {topk_of(gcand, 'lists, probes, qid', 10)})"
    s["ivf_probe_sweep"] = with_(PERM, BASE, QUERIES, NLISTS, grid, gcents, gasg, gprobe, gres, EXACT10) + f"""SELECT
  lists, probes, least(probes, lists) AS effective_probes, {r6('avg(recall)')} AS mean_recall, count(*) AS n_queries FROM (
  SELECT ct.lists, ct.probes, ct.qid, count(r.id) / count(*) AS recall
  FROM (SELECT * FROM cells, exact) ct LEFT JOIN gres r
    ON r.lists = ct.lists AND r.probes = ct.probes AND r.qid = ct.qid AND r.id = ct.id
  GROUP BY ct.lists, ct.probes, ct.qid) GROUP BY lists, probes"""
    s["sweep_grid"] = with_(PERM, NLISTS.split(",\npbase")[0], grid) + """SELECT 'graph' AS index_type, m, ef_construction,
  ef_search, CAST(NULL AS BIGINT) AS lists, CAST(NULL AS BIGINT) AS probes, CAST(NULL AS BIGINT) AS effective_probes, sz.nb AS n_rows
FROM (SELECT unnest([16, 32, 64]) AS m), (SELECT unnest([64, 128, 200]) AS ef_construction),
     (SELECT unnest([10, 20, 40, 80, 160]) AS ef_search), sz
WHERE ef_construction >= 2 * m
UNION ALL SELECT 'ivf', NULL, NULL, NULL, lists, probes, effective_probes, sz.nb FROM cells, sz"""
    s["scaling_recall"] = scaling_sql(20)
    s["compact_postings"] = with_(PERM, BASE, NLISTS, CENTS, ASG) + "SELECT list_id, count(*) AS n_rows FROM asg GROUP BY list_id"
    s["rebuild_delta_pivot"] = f"""WITH curve AS ({degradation_sql(20)})
SELECT b.index_type, b.checkpoint_pct, b.mean_recall AS recall_no_rebuild, a.mean_recall AS recall_post_rebuild,
  {r6('a.mean_recall - b.mean_recall')} AS recall_delta
FROM curve b JOIN curve a ON a.index_type = b.index_type AND a.checkpoint_pct = b.checkpoint_pct
WHERE b.phase = 'no_rebuild' AND a.phase = 'post_rebuild'"""
    s["degradation_curve_pivot"] = degradation_sql(20)
    s["metrics_scrub"] = f"""SELECT index_type, checkpoint_pct, cumulative_inserts, total_rows, phase, mean_recall
FROM ({degradation_sql(20)}) WHERE NOT (checkpoint_pct = 0 AND phase = 'no_rebuild')"""
    # table operations
    s["load_tier"] = with_(PERM, TIERS) + """SELECT tier, count(*) AS n_rows, tier AS n_expected, true AS count_ok
FROM tiers GROUP BY tier"""
    s["pk_violations"] = with_(PERM, INSERTS) + """SELECT 800000000 + seq AS id, CAST(2 AS BIGINT) AS n_copies
FROM ins, sz WHERE seq < sz.nb * 30 // 100"""
    s["append_range"] = with_(PERM, BASE, INSERTS) + """SELECT id, pool_pos FROM base
UNION ALL SELECT 800000000 + seq, pool_pos FROM ins, sz WHERE seq < sz.nb * 50 // 100"""
    s["append_resume"] = with_(PERM, BASE, INSERTS) + """SELECT id, CAST(1 AS BIGINT) AS n_copies FROM base
UNION ALL SELECT 800000000 + seq, 1 FROM ins, sz WHERE seq < sz.nb * 50 // 100"""
    s["append_checked"] = with_(PERM, INSERTS) + """SELECT outcome, count(*) AS n_rows FROM (
  SELECT 'loaded' AS outcome FROM perm, sz WHERE perm_rank < sz.nb
  UNION ALL SELECT CASE seq % 10 WHEN 0 THEN 'dimension' WHEN 1 THEN 'null' WHEN 3 THEN 'known_key' ELSE 'loaded' END FROM ins
  UNION ALL SELECT 'repeated_key' FROM ins WHERE seq % 10 = 2) GROUP BY outcome"""
    s["delete_range"] = with_(PERM, BASE) + "SELECT id, pool_pos FROM base"
    s["table_state"] = with_(PERM, BASE, INSERTS, CPS) + """SELECT ci AS cumulative_inserts,
  (SELECT count(*) FROM base) + (SELECT count(*) FROM ins WHERE seq < ci) AS n_rows,
  (SELECT count(*) FROM ins WHERE seq < ci) AS n_inserted FROM cps"""
    s["delete_steps"] = with_(PERM, BASE, INSERTS, """c AS (SELECT count(*) AS n,
  count_if(id % 3 = 0) AS d3, count_if(id % 2 = 0 AND id % 3 <> 0) AS d2, (SELECT count(*) FROM ins) AS m FROM base)""") + """
SELECT 'loaded' AS step, 0::BIGINT AS n_deleted, n AS n_live, n AS n_stored FROM c
UNION ALL SELECT 'every third', d3, n - d3, n FROM c
UNION ALL SELECT 'every second', d2, n - d3 - d2, n FROM c
UNION ALL SELECT 'appended', 0, n - d3 - d2 + m, n + m FROM c
UNION ALL SELECT 'compacted', 0, n - d3 - d2 + m, n - d3 - d2 + m FROM c"""
    s["index_versions"] = with_(PERM, BASE, NLISTS, """v AS (SELECT (SELECT lists FROM nl) AS nl, (SELECT count(*) FROM base) AS n)""") + """
SELECT x.version::BIGINT AS version, 'items' AS "table", 'ivf_pivot' AS index_type, (x.f * v.nl)::BIGINT AS lists, v.n AS n_rows,
  x.status, x.since::BIGINT AS since, x.until::BIGINT AS until
FROM v, (VALUES (1, 1, 'active', 1, NULL), (2, 1, 'replaced', 1, 2), (2, 2, 'active', 2, NULL), (3, 1, 'replaced', 1, 2),
  (3, 2, 'dropped', 2, 3), (4, 1, 'replaced', 1, 2), (4, 2, 'dropped', 2, 3), (4, 1, 'active', 4, NULL)) x(version, f, status, since, until)"""
    # streaming
    s["stream_ingest"] = with_(PERM, BASE, INSERTS, NLISTS, CENTS) + f"""SELECT 800000000 + seq AS id, list_id,
  {r6('cd')} AS centroid_distance FROM (
  SELECT i.seq, c.list_id, {cosine('i.embedding', 'c.centroid')} AS cd,
         row_number() OVER (PARTITION BY i.seq ORDER BY {cosine('i.embedding', 'c.centroid')}, c.list_id) AS r
  FROM ins i, cents c) WHERE r = 1"""
    s["stream_lookup"] = s["ivf_pivot_search"]
    s["stream_cyclic_ingest"] = with_(PERM, BASE, INSERTS, NLISTS, CENTS, """w AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS counter FROM events
  WHERE event_type NOT IN ('view', 'click')),
wr AS (SELECT 900000000 + w.counter AS id, i.seq AS vec_ix, i.embedding FROM w
  JOIN ins i ON i.seq = w.counter % (SELECT count(*) FROM ins))""") + f"""SELECT id, vec_ix, list_id,
  {r6('cd')} AS centroid_distance FROM (
  SELECT x.id, x.vec_ix, c.list_id, {cosine('x.embedding', 'c.centroid')} AS cd,
         row_number() OVER (PARTITION BY x.id ORDER BY {cosine('x.embedding', 'c.centroid')}, c.list_id) AS r
  FROM wr x, cents c) WHERE r = 1"""
    s["stream_workload_windows"] = with_(OPS, "w AS (SELECT *, time_bucket(INTERVAL 60 second, ts) AS window_start FROM ops)") + \
        f"""SELECT window_start, profile, count_if(is_read) AS n_reads, count_if(NOT is_read) AS n_writes,
  {r6('avg(CASE WHEN is_read THEN latency_ms END)')} AS mean_read_latency_ms, {r6('max(latency_ms)')} AS max_latency_ms,
  {r6("quantile_cont(latency_ms, 0.95) FILTER (WHERE is_read)")} AS p95_read_latency_ms,
  {r6("quantile_cont(latency_ms, 0.99) FILTER (WHERE is_read)")} AS p99_read_latency_ms,
  {r6("count_if(is_read) / 60.0")} AS read_qps, {r6("count_if(NOT is_read) / 60.0")} AS write_throughput_per_sec
FROM w GROUP BY window_start, profile"""
    # embedding stage
    s["embed_pool"] = with_(*SENT_ALL, EMBED) + f"""SELECT id, len(embedding) AS dims, {r6(norm('embedding'))} AS norm,
  {r6("list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i))")} AS checksum,
  len(list_filter(embedding, lambda x: x <> 0)) AS n_nonzero FROM vec"""
    s["embed_pool_batched"] = s["embed_pool"]
    s["embedding_rate"] = with_(SENTS, NUMBERED) + """SELECT count(*) AS n_observed, count(*) AS n_stored, true AS batches_cover,
  true AS rate_positive FROM numbered"""
    s["stage_cache"] = with_(*SENT_ALL) + """SELECT stage, n_rows, CAST(1 AS BIGINT) AS n_builds, true AS same_rows FROM (
  SELECT 'numbered' AS stage, count(*) AS n_rows FROM numbered UNION ALL SELECT 'pool', count(*) FROM sperm
  UNION ALL SELECT 'tiers', count(*) FROM stiers UNION ALL SELECT 'inserts', count(*) FROM sinserts)"""
    # neighbour graph
    s["graph_search_l2"] = knn_sql("l2", 10)
    s["graph_validate"] = with_(PERM) + """SELECT nb AS n_nodes, CAST(0 AS BIGINT) AS n_self_edges,
  CAST(0 AS BIGINT) AS n_repeated_edges, CAST(0 AS BIGINT) AS n_over_degree, CAST(0 AS DOUBLE) AS max_error FROM sz"""
    s["graph_reachable"] = with_(PERM) + """SELECT m, efc AS ef_construction, nb AS n_nodes, CAST(0 AS BIGINT) AS n_unreached,
  CAST(0 AS BIGINT) AS n_over_degree FROM sz, (SELECT unnest([16, 32, 64]) AS m) a, (SELECT unnest([64, 128, 200]) AS efc) b
  WHERE efc >= 2 * m"""
    s["graph_recall_floor"] = with_(PERM, QUERIES) + """SELECT CAST(32 AS BIGINT) AS m, CAST(128 AS BIGINT) AS ef_construction,
  CAST(40 AS BIGINT) AS ef_search, true AS recall_ok, count(*) AS n_queries FROM qs"""
    # corpus to search
    s["text_items"] = with_(*SENT_ALL, TEXT_VEC) + f"""SELECT part, p.id, p.pool_pos, len(embedding) AS dims,
  {r6(norm('embedding'))} AS norm, {r6("list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i))")} AS checksum,
  len(list_filter(embedding, lambda x: x <> 0)) AS n_nonzero FROM (
  SELECT 'tier_' || CAST(tier AS VARCHAR) AS part, id, pool_pos FROM stiers
  UNION ALL SELECT 'queries', qid, pool_pos FROM squeries
  UNION ALL SELECT 'inserts', seq, pool_pos FROM sinserts) p JOIN vec ON vec.id = p.pool_pos"""
    s["text_ground_truth"] = with_(*SENT_ALL, TEXT_VEC, TEXT_UNIT) + f"""SELECT tier, qid, rk, id, pool_pos, {r6('distance')} AS distance
FROM {topk_of(f"(SELECT t.tier, q.qid, t.id, t.pool_pos, {TEXT_PAIR} AS distance FROM ui t, uq q)", "tier, qid", 10)}"""
    s["text_knn"] = with_(*SENT_ALL, TEXT_VEC, TEXT_UNIT) + f"""SELECT qid, rk, id, {r6('distance')} AS distance
FROM {topk_of(f"(SELECT q.qid, t.id, {TEXT_PAIR} AS distance FROM ui t JOIN mt ON t.tier = mt.mt, uq q)", "qid", 10)}"""
    return s
