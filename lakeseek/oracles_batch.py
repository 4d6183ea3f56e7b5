"""DuckDB SQL for queries_batch: every query against every chunk."""

from __future__ import annotations

from lakeseek.functions.text import GENERIC_TERMS
from lakeseek.oracles import _BID, _WIDE
from lakeseek.oracles_more import _CHUNKS, _CONF, _NORM
from lakeseek.oracles_more import ORACLES as _SINGLE

_GENERIC = ", ".join(f"'{t}'" for t in sorted(GENERIC_TERMS))
#: Benchmark items have no word with a dot or hyphen inside, so each phrase is one token.
_MANY = f"""{_CHUNKS},
qp AS (SELECT item_id AS query_id, regexp_extract(strip_accents(lower(w)), '[\\p{{L}}\\p{{N}}]+') AS t
       FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_.\\-]+')) AS w FROM benchmark) WHERE length(w) > 1),
qt AS (SELECT query_id, t, count(*) AS times FROM qp WHERE t <> '' GROUP BY ALL),
tf AS (SELECT chunk_id, t, sum(f) AS f FROM (SELECT chunk_id, unnest(a) AS t, 3.0::DOUBLE AS f FROM tk UNION ALL SELECT chunk_id, unnest(b), 1.0::DOUBLE FROM tk) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
dn AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
im AS (SELECT chunk_id, t, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END
              * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(a) + len(b))::DOUBLE / avgdl)) AS i FROM tf JOIN dn USING (t) JOIN tk USING (chunk_id), st),
bm AS (SELECT query_id, chunk_id, round(-sum(i * times), 9) AS score FROM im JOIN qt USING (t) GROUP BY ALL)"""


def _best(k: int, source: str = "bm") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= {k}"


#: Of the hits lx(query_id, chunk_id, score).
_QUALITY = f"""
tr AS (SELECT item_id AS query_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'),
         lambda w: lower(w) NOT IN ({_GENERIC}) AND (length(w) >= 3 OR (upper(w) = w AND regexp_matches(w, '[A-Z]')))), lambda w: lower(w)) AS ws FROM benchmark),
te AS (SELECT query_id, t, min(pos) AS pos FROM (SELECT query_id, unnest(ws) AS t, unnest(range(len(ws))) AS pos FROM tr) GROUP BY ALL),
td AS (SELECT t, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(list_concat(a, b)) AS t FROM tk) WHERE t IN (SELECT t FROM te) GROUP BY t),
tw AS (SELECT query_id, t, pos, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM te LEFT JOIN td USING (t), st),
tp AS (SELECT query_id, sum(w) AS total, first(t ORDER BY w DESC, pos) AS top FROM tw GROUP BY query_id),
nm AS (SELECT chunk_id, {_NORM.format("title")} AS ti, {_NORM.format("text")} AS x FROM ch WHERE chunk_id IN (SELECT chunk_id FROM lx)),
sp AS (SELECT *, string_split(ti, ' ') AS tl, string_split(x, ' ') AS xl FROM nm),
cv AS (SELECT query_id, chunk_id, sum(CASE WHEN list_contains(tl, t) THEN w ELSE 0 END) AS tiw, sum(CASE WHEN list_contains(xl, t) THEN w ELSE 0 END) AS xw
       FROM lx JOIN sp USING (chunk_id) JOIN tw USING (query_id) GROUP BY ALL),
ql AS (SELECT lx.query_id, lx.chunk_id, lx.score, CASE WHEN total IS NULL THEN 0.0 WHEN contains(x, {_NORM.format("q.text")}) THEN 1.0
         WHEN len(ws) >= 3 AND xw < 0.5 * total AND tiw = 0 THEN 0.0 WHEN tiw / total >= 0.5 AND list_contains(tl, top) THEN greatest(0.85, tiw / total)
         WHEN tiw / total >= 0.5 THEN tiw / total ELSE greatest(tiw / total, 0.7 * xw / total) END AS quality
       FROM lx JOIN sp USING (chunk_id) JOIN benchmark q ON q.item_id = query_id JOIN tr USING (query_id) LEFT JOIN tp USING (query_id) LEFT JOIN cv USING (query_id, chunk_id))"""


def _hybrid(limit: int, condition: str, real: str) -> str:
    return f"""WITH {_MANY}, be AS ({_best(1000)}),
lx AS (SELECT query_id, chunk_id, score FROM ({_best(40, f"(SELECT be.* FROM be JOIN ch USING (chunk_id) WHERE {condition})")}) JOIN ch USING (chunk_id) WHERE {real}), {_QUALITY},
al AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_sum([(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2 FOR i IN range(1, 65)]) AS distance
       FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id IN (SELECT chunk_id FROM ch WHERE {condition})),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS dense_rank FROM al QUALIFY dense_rank <= 40),
dc AS (SELECT query_id, chunk_id, dense_rank, {_CONF} AS conf FROM nn JOIN ch USING (chunk_id) WHERE {real}),
sx AS (SELECT query_id, chunk_id, quality, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS lexical_rank FROM ql WHERE quality >= 0.2),
ok AS (SELECT query_id FROM dc WHERE conf >= 0.55 UNION SELECT query_id FROM sx),
fu AS (SELECT query_id, chunk_id, coalesce(conf / (60 + dense_rank), 0) + coalesce((0.5 + 3.5 * quality) / (60 + lexical_rank), 0) AS score, dense_rank, lexical_rank
       FROM (SELECT * FROM dc WHERE conf > 0) FULL OUTER JOIN sx USING (query_id, chunk_id) WHERE query_id IN (SELECT query_id FROM ok)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id) AS rank FROM fu)
SELECT query_id, rank, chunk_id, round(score, 9) AS score, dense_rank, lexical_rank FROM rk WHERE rank <= {limit}"""


ORACLES: dict[str, str] = {
    "legacy_array": """SELECT o_orderkey AS bid_id, '{"[' || chr(92) || o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "arrivals_by_window": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "file_changes": """SELECT 'pages/' || page_id || '.pdf' AS path, CASE page_id % 10 WHEN 1 THEN 'changed' WHEN 3 THEN 'changed' WHEN 2 THEN 'new' WHEN 4 THEN 'removed' ELSE 'unchanged' END AS change FROM pages""",
    "last_document_of_a_bid": f"""WITH {_WIDE}
SELECT {_BID} || '::atc_clause::1' AS chunk_id, 'Generic: ' || CASE WHEN k % 3 = 0 THEN 'Other' ELSE 'First' END || ' term of order ' || k || chr(10) || o_orderstatus AS text, k % 3 = 0 AS second FROM wide
UNION ALL SELECT {_BID} || '::atc_clause::2', 'Delivery / Training: Deliver to ' || c_name, k % 3 = 0 FROM wide""",
    "knn_indexed": _SINGLE["knn_topk"],
    "knn_indexed_filtered": _SINGLE["knn_filtered"],
    "knn_indexed_many": _SINGLE["knn_batch"],
    "bm25_blocks": _SINGLE["bm25_weighted_title_text"],
    "lexical_search_many": f"WITH {_MANY}, be AS ({_best(250)}) {_best(10, 'be')}",
    "match_quality_many": f"WITH {_MANY}, lx AS ({_best(40)}), {_QUALITY} SELECT query_id, chunk_id, round(quality, 9) AS quality FROM ql",
    "hybrid_search_many": _hybrid(10, "TRUE", "coalesce(NOT is_boilerplate, TRUE)"),
    "hybrid_search_many_filtered": _hybrid(5, "lang IN ('en', 'de') AND n_chars >= 500", "TRUE"),
}
