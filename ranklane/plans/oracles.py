"""DuckDB SQL that the registered queries are checked against.

Written over the raw tables, apart from the engine: BASE has the collection, the run and the judgments.
"""

from __future__ import annotations

BASE = r"""
WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS docid, coalesce(source, '') AS title, coalesce(text, '') AS text FROM documents),
tok AS (SELECT docid, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS tokens FROM docs),
topics AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'dev' ELSE 'train' END AS split, CAST(item_id AS VARCHAR) AS query_id, text AS query_text FROM benchmark),
terms AS (SELECT DISTINCT split, query_id, term FROM (SELECT split, query_id, unnest(list_filter(regexp_split_to_array(lower(query_text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM topics)),
nterms AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
stat AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
tf AS (SELECT docid, dl, term, count(*) AS tf FROM (SELECT docid, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT t.split, t.query_id, tf.docid,
    CAST(sum(CAST(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + CAST(0.9 AS DOUBLE) * (CAST(1 - CAST(0.4 AS DOUBLE) AS DOUBLE) + CAST(0.4 AS DOUBLE) * dl / avgdl)) AS DECIMAL(18,9))) AS DOUBLE) AS bm25_score,
    CAST(sum(CAST(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)) AS DECIMAL(18,9))) AS DOUBLE) AS score_c,
    count(*) AS matched
  FROM terms t JOIN df USING (term) JOIN tf USING (term) CROSS JOIN stat GROUP BY 1, 2, 3),
hits AS (SELECT * FROM (SELECT s.*, n_terms, row_number() OVER (PARTITION BY split, s.query_id ORDER BY bm25_score DESC, docid) AS bm25_rank FROM scored s JOIN nterms USING (query_id)) WHERE bm25_rank <= 100),
qrels AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS docid, CAST(CASE WHEN quality = 1 AND (doc_id * 7 + item_id) % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS relevance_grade FROM benchmark, labels WHERE (doc_id + item_id) % 3 = 0),
run AS (SELECT split, query_id, docid, bm25_rank, bm25_score FROM hits),
cand AS (SELECT r.*, relevance_grade, CASE WHEN relevance_grade IS NULL THEN 'unjudged' WHEN relevance_grade > 0 THEN 'relevant' ELSE 'judged_non_relevant' END AS judgment,
    CASE WHEN relevance_grade IS NOT NULL THEN CAST(relevance_grade > 0 AS BIGINT) END AS relevance, relevance_grade IS NOT NULL AS is_judged
  FROM run r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.docid = r.docid),
lex AS (SELECT split, query_id, docid, bm25_rank, CAST(CAST(matched AS DOUBLE) / n_terms AS FLOAT) AS score FROM hits),
rank_bm25 AS (SELECT split, query_id, docid, bm25_rank AS rank FROM hits),
rank_lexical AS (SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY score DESC, docid) AS rank FROM lex),
rank_c AS (SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY score_c DESC, docid) AS rank FROM hits),
rank_oracle AS (SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY (judgment = 'relevant') DESC, bm25_rank, docid) AS rank FROM cand),
ideal AS (SELECT query_id, sum(CASE WHEN pos <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(pos + 1) ELSE 0.0 END) AS idcg, count(*) FILTER (WHERE relevance_grade > 0) AS positives
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_grade DESC, docid) AS pos FROM qrels) GROUP BY 1),
{metrics}
hasrel AS (SELECT t.split, t.query_id, coalesce(max(CAST(judgment = 'relevant' AS INT)), 0) > 0 AS has_relevant FROM topics t LEFT JOIN cand c ON c.query_id = t.query_id GROUP BY 1, 2),
strata AS (SELECT a.split, a.query_id, a.ndcg_at_10 AS baseline, o.ndcg_at_10 AS oracle,
    CASE WHEN NOT has_relevant THEN 'no_relevant_in_candidates' WHEN abs(a.ndcg_at_10 - o.ndcg_at_10) <= greatest(1e-9 * greatest(abs(a.ndcg_at_10), abs(o.ndcg_at_10)), 1e-12) THEN 'already_at_oracle' ELSE 'improvable' END AS stratum
  FROM m_bm25 a JOIN m_oracle o ON o.query_id = a.query_id JOIN hasrel h ON h.query_id = a.query_id),
qstrata AS (SELECT *, relevant_bucket || '|' || CASE WHEN has_judged_negative THEN 'T' ELSE 'F' END AS stratum FROM
  (SELECT *, CASE WHEN n_relevant >= 3 THEN '3+' ELSE CAST(n_relevant AS VARCHAR) END AS relevant_bucket, n_judged_negatives > 0 AS has_judged_negative FROM
    (SELECT split, query_id, CAST(count(*) FILTER (WHERE judgment = 'relevant') AS INT) AS n_relevant, CAST(count(*) FILTER (WHERE judgment = 'judged_non_relevant') AS INT) AS n_judged_negatives FROM cand GROUP BY 1, 2))),
weakb AS (SELECT *, row_number() OVER (PARTITION BY split, query_id, bucket ORDER BY CAST('0x' || substr(md5('20260803|' || query_id || '|' || bucket || '|' || docid), 1, 8) AS BIGINT), docid) AS place FROM
  (SELECT split, query_id, docid, bm25_rank, CASE WHEN bm25_rank <= 50 THEN 0 WHEN bm25_rank <= 75 THEN 1 ELSE 2 END AS bucket FROM cand WHERE judgment = 'unjudged' AND bm25_rank BETWEEN 26 AND 100)),
weak AS (SELECT split, query_id, docid, bm25_rank, choice FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY greatest(place - CASE WHEN bucket = 2 THEN 2 ELSE 3 END, 0), bucket, place) AS choice FROM weakb) WHERE choice <= 8),
enc AS (SELECT c.split, c.query_id, c.docid, t.query_text, title || chr(10) || d.text AS document, d.title, d.text FROM cand c JOIN topics t ON t.query_id = c.query_id JOIN docs d ON d.docid = c.docid),
encoded AS (SELECT split, query_id, docid, length(query_text) + length(document) + 4 AS tokens_before, length(query_text) + least(length(document), greatest(320 - length(query_text) - 4, 0)) + 4 AS tokens_after FROM enc),
pos AS (SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY docid) - 1 AS p FROM cand WHERE judgment = 'relevant'),
neg AS (SELECT split, query_id, docid, bm25_rank, row_number() OVER (PARTITION BY split, query_id ORDER BY bm25_rank, docid) - 1 AS k, 'judged' AS source FROM cand WHERE judgment = 'judged_non_relevant'),
negw AS (SELECT * FROM neg UNION ALL SELECT split, query_id, docid, bm25_rank, row_number() OVER (PARTITION BY split, query_id ORDER BY bm25_rank, docid) - 1, 'weak' FROM weak),
{pairs}
done AS (SELECT 1)
"""

_METRICS = """
j_{0} AS (SELECT r.split, r.query_id, r.docid, r.rank, c.relevance_grade, c.is_judged FROM rank_{0} r JOIN cand c ON c.query_id = r.query_id AND c.docid = r.docid),
s_{0} AS (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY rank, docid) AS pos, row_number() OVER (PARTITION BY split, query_id, is_judged ORDER BY rank, docid) AS kpos FROM j_{0}),
q_{0} AS (SELECT split, query_id,
    sum(CASE WHEN pos <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(pos + 1) ELSE 0.0 END) AS dcg,
    sum(CASE WHEN is_judged AND kpos <= 10 AND relevance_grade > 0 THEN (pow(2.0, relevance_grade) - 1) / log2(kpos + 1) ELSE 0.0 END) AS cdcg,
    count(*) FILTER (WHERE relevance_grade > 0 AND pos <= 100) AS found, count(*) FILTER (WHERE is_judged AND pos <= 10) AS judged,
    min(CASE WHEN relevance_grade > 0 AND rank <= 10 THEN rank END) AS first_rank, count(*) AS retrieved FROM s_{0} GROUP BY 1, 2),
m_{0} AS (SELECT t.split, t.query_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END AS ndcg_at_10, CASE WHEN idcg > 0 THEN coalesce(cdcg, 0) / idcg ELSE 0.0 END AS condensed_ndcg_at_10,
    CASE WHEN positives > 0 THEN CAST(coalesce(found, 0) AS DOUBLE) / positives ELSE 0.0 END AS recall_at_100, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_100,
    CAST(coalesce(judged, 0) AS DOUBLE) / 10 AS judged_at_10, coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE) AS rr_at_10, coalesce(retrieved, 0) AS retrieved, coalesce(positives, 0) AS relevant_total
  FROM topics t LEFT JOIN q_{0} q ON q.query_id = t.query_id LEFT JOIN ideal i ON i.query_id = t.query_id),
"""

_PAIRS = """
sz_{0} AS (SELECT p.split, p.query_id, p.n AS np, p.n * coalesce(nj, 0) AS ja, p.n * coalesce(nw, 0) AS wa FROM (SELECT split, query_id, count(*) AS n FROM pos GROUP BY 1, 2) p
    JOIN (SELECT query_id, count(*) FILTER (WHERE source = 'judged') AS nj, count(*) FILTER (WHERE source = 'weak') AS nw FROM {1} GROUP BY 1) n ON n.query_id = p.query_id),
cap_{0} AS (SELECT *, least(wa, 8) + greatest(least(wa - least(wa, 8), 16 - jt - least(wa, 8)), 0) AS wt FROM (SELECT *, least(ja, 8) + greatest(least(ja - least(ja, 8), 16 - least(ja, 8) - least(wa, 8)), 0) AS jt FROM sz_{0})),
turn_{0} AS (SELECT *, (t - 1) % np AS p, CASE WHEN t <= jt THEN 'judged' ELSE 'weak' END AS source, CASE WHEN t <= jt THEN (t - 1) // np ELSE (t - 1 - jt) // np END AS k FROM (SELECT *, unnest(range(1, jt + wt + 1)) AS t FROM cap_{0})),
pairs_{0} AS (SELECT t.split, t.query_id, pos.docid AS positive_docid, n.docid AS negative_docid, t.source AS negative_source, n.bm25_rank AS negative_bm25_rank, CAST(CASE WHEN t.source = 'judged' THEN 1.0 ELSE 0.5 END AS FLOAT) AS pair_weight
  FROM turn_{0} t JOIN pos ON pos.query_id = t.query_id AND pos.p = t.p JOIN {1} n ON n.query_id = t.query_id AND n.source = t.source AND n.k = t.k),
"""

PREFIX = BASE.replace("{metrics}", "".join(_METRICS.format(x) for x in ("bm25", "lexical", "c", "oracle"))).replace("{pairs}", _PAIRS.format("judged", "neg") + _PAIRS.format("weak", "negw"))


def over_base(sql: str) -> str:
    return PREFIX + sql


#: Metric columns rounded for comparison across engines.
ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in ("ndcg_at_10", "condensed_ndcg_at_10", "recall_at_100", "hit_at_100", "judged_at_10", "rr_at_10"))
MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("ndcg_at_10", "condensed_ndcg_at_10", "recall_at_100", "hit_at_100", "judged_at_10", "rr_at_10"))


def summary_of(system: str) -> str:
    """Paired summary of ``system`` against the BM25 order."""
    return f"""SELECT count(*) AS queries, count(*) FILTER (WHERE d >= 1e-12) AS improved, count(*) FILTER (WHERE d <= -1e-12) AS degraded, count(*) FILTER (WHERE abs(d) < 1e-12) AS ties,
      round(avg(d), 9) AS mean_delta, round(quantile_cont(d, 0.5), 9) AS median_delta, round(min(d), 9) AS min_delta, round(max(d), 9) AS max_delta
      FROM (SELECT s.ndcg_at_10 - b.ndcg_at_10 AS d FROM m_{system} s JOIN m_bm25 b ON b.query_id = s.query_id)"""


def at_depth(k: int) -> str:
    return f"""SELECT split, query_id, docid, row_number() OVER (PARTITION BY split, query_id ORDER BY CASE WHEN bm25_rank <= {k} THEN 0 ELSE 1 END, CASE WHEN bm25_rank <= {k} THEN score END DESC NULLS LAST,
      CASE WHEN bm25_rank > {k} THEN bm25_rank END, docid) AS rank FROM lex"""
