"""DuckDB SQL for the queries of queries_search and queries_tables."""

from __future__ import annotations

_TOK = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_NORM = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), ' ')"
_CHUNKS = f"""
ch AS (SELECT d.doc_id AS chunk_id, split_part(text, chr(10), 1) AS title, text, lang, source, n_chars, q.quality = 0 AS is_boilerplate
       FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id),
tk AS (SELECT chunk_id, {_TOK.format("title")} AS a, {_TOK.format("text")} AS b FROM ch),
st AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS avgdl FROM tk)"""


def _bm25(phrases: list[list[str]], title: float = 3.0, name: str = "bm") -> str:
    """CTEs up to (chunk_id, score)."""

    def count(column: str, p: list[str]) -> str:
        test = " AND ".join(f"{column}[i + {d}] = '{t}'" for d, t in enumerate(p))
        return f"len([i FOR i IN range(1, len({column}) + 1) IF {test}])"

    kinds = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    counts = ", ".join(f"{title} * {count('a', p)} + {count('b', p)} AS f{i}" for i, p in enumerate(kinds))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(kinds)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    parts = []
    for p in phrases:
        i = kinds.index(p)
        parts.append(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / avgdl))")
    hit = " OR ".join(f"f{i} > 0" for i in range(len(kinds)))
    return f"""{_CHUNKS}, ct AS (SELECT chunk_id, CAST(len(a) + len(b) AS DOUBLE) AS length, {counts} FROM tk), dn AS (SELECT {dfs} FROM ct),
{name} AS (SELECT chunk_id, -({" + ".join(parts)}) AS score FROM ct, dn, st WHERE {hit})"""


_Q = [["thatin"], ["thing"], ["orantion"]]
#: Every vector beside the query's.
_EMB = "(SELECT e.vec_id, e.label, e.embedding, q.embedding AS qe FROM embeddings e, embeddings q WHERE q.vec_id = 0)"
_L2 = "list_sum([(CAST(embedding[i] AS DOUBLE) - CAST(qe[i] AS DOUBLE)) ** 2 FOR i IN range(1, 65)])"
_DOT = "list_sum([CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE) FOR i IN range(1, 65)])"
_CONF = "CASE WHEN distance <= 1.45 THEN 1.0 WHEN distance <= 1.55 THEN 0.85 WHEN distance <= 1.65 THEN 0.55 WHEN distance <= 1.75 THEN 0.2 ELSE 0.0 END::DOUBLE"
_TERMS = ("thatin", "thing", "orantion")
_QUALITY = f"""
df AS (SELECT {", ".join(f"count(*) FILTER (list_contains(a, '{t}') OR list_contains(b, '{t}')) AS d{i}" for i, t in enumerate(_TERMS))} FROM tk),
wt AS (SELECT {", ".join(f"ln((n + 1) / (d{i} + 1)) + 1 AS w{i}" for i in range(3))} FROM df, st),
nm AS (SELECT chunk_id, {_NORM.format("title")} AS t, {_NORM.format("text")} AS x FROM ch),
cv AS (SELECT chunk_id, x, w0 + w1 + w2 AS total,
  {" + ".join(f"CASE WHEN list_contains(string_split(t, ' '), '{t}') THEN w{i} ELSE 0 END" for i, t in enumerate(_TERMS))} AS tw,
  {" + ".join(f"CASE WHEN list_contains(string_split(x, ' '), '{t}') THEN w{i} ELSE 0 END" for i, t in enumerate(_TERMS))} AS xw,
  list_contains(string_split(t, ' '), CASE WHEN w0 >= w1 AND w0 >= w2 THEN 'thatin' WHEN w1 >= w2 THEN 'thing' ELSE 'orantion' END) AS top FROM nm, wt),
ql AS (SELECT chunk_id, CASE WHEN contains(x, 'thatin thing orantion') THEN 1.0 WHEN xw < 0.5 * total AND tw = 0 THEN 0.0
  WHEN tw / total >= 0.5 AND top THEN greatest(0.85, tw / total) WHEN tw / total >= 0.5 THEN tw / total ELSE greatest(tw / total, 0.7 * xw / total) END AS quality FROM cv)"""


def _lists(condition: str = "TRUE", real: str = "TRUE") -> str:
    return f"""{_bm25(_Q)}, {_QUALITY},
best AS (SELECT * FROM bm ORDER BY score, chunk_id LIMIT 1000),
lx AS (SELECT * FROM (SELECT best.* FROM best JOIN ch USING (chunk_id) WHERE {condition} ORDER BY score, chunk_id LIMIT 40) JOIN ch USING (chunk_id) WHERE {real}),
nn AS (SELECT v.*, row_number() OVER (ORDER BY distance, chunk_id) AS dense_rank FROM (
  SELECT vec_id AS chunk_id, {_L2} AS distance FROM {_EMB} WHERE vec_id IN (SELECT chunk_id FROM ch WHERE {condition}) ORDER BY distance, chunk_id LIMIT 40) v),
dd AS (SELECT nn.chunk_id, distance, dense_rank FROM nn JOIN ch USING (chunk_id) WHERE {real})"""


_NEAR = f"SELECT vec_id AS chunk_id, {_L2} AS distance FROM {_EMB} ORDER BY distance, chunk_id LIMIT 40"
_FREE = f"""{_bm25(_Q)}, {_QUALITY}, lx AS (SELECT * FROM bm ORDER BY score, chunk_id LIMIT 40),
dd AS (SELECT v.*, row_number() OVER (ORDER BY distance, chunk_id) AS dense_rank FROM ({_NEAR}) v)"""
_FUSED = f"""
sx AS (SELECT chunk_id, quality, row_number() OVER (ORDER BY score, chunk_id) AS lexical_rank FROM lx JOIN ql USING (chunk_id) WHERE quality >= 0.2),
dc AS (SELECT chunk_id, dense_rank, {_CONF} AS conf FROM dd),
fu AS (SELECT chunk_id, coalesce(conf / (60 + dense_rank), 0) + coalesce((0.5 + 3.5 * quality) / (60 + lexical_rank), 0) AS score, dense_rank, lexical_rank
  FROM (SELECT * FROM dc WHERE conf > 0) FULL OUTER JOIN sx USING (chunk_id)
  WHERE (SELECT count(*) FROM dc WHERE conf >= 0.55) + (SELECT count(*) FROM sx) > 0)"""
_TEN = "SELECT chunk_id, round(score, 9) AS score, dense_rank, lexical_rank FROM fu ORDER BY fu.score DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id LIMIT 10"
_SOME = "lang IN ('en', 'de') AND n_chars >= 500"
_FORTY = "SELECT chunk_id, round(score, 9) AS score FROM bm ORDER BY round(score, 9), chunk_id LIMIT 40"

_OLD = """old AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 1 THEN text || ' old' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 2
  UNION ALL SELECT -doc_id - 1, md5(text) FROM documents WHERE doc_id % 10 = 4)"""
_CHANGES = f"""WITH {_OLD}, c AS (
SELECT coalesce(o.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'removed' WHEN d.doc_id % 10 = 3 THEN 'failed' WHEN o.doc_id IS NULL THEN 'new'
  WHEN o.hash = md5(d.text) THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL OUTER JOIN documents d ON o.doc_id = d.doc_id)"""
_LIST = """li AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS nth FROM orders),
ca AS (SELECT CAST(floor(nth / 20) AS BIGINT) AS page, nth AS position, CASE WHEN nth % 7 = 6 THEN o_orderkey + 1 ELSE o_orderkey END AS bid_id,
  'GEM/' || year(o_orderdate) || '/B/' || CASE WHEN nth % 7 = 6 THEN o_orderkey + 1 ELSE o_orderkey END AS bid_number FROM li WHERE nth % 21 <> 20)"""
_EXPIRY = """WITH x AS (SELECT o_orderkey, o_orderstatus <> 'O' AS expired, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS chunks FROM orders)"""
_FIRST = """r AS (SELECT CASE WHEN o_orderkey % 17 <> 0 THEN 'GEM/B/' || o_orderkey ELSE 'N/A' END AS bid_id, o.*, c_name, n_name, l_linenumber,
  (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem z WHERE z.l_orderkey = o_orderkey) AS qty
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY l_linenumber, o_orderkey) AS rn FROM r) WHERE rn = 1)"""
_LIVE = """WITH s AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS TIMESTAMP) + INTERVAL 21 HOUR AS e FROM orders),
v AS (SELECT k, CASE WHEN k % 4 <> 1 THEN e END AS stored, k % 5 <> 4 AS found, k % 11 = 0 AS bad,
  CASE WHEN k % 5 <> 4 AND k % 11 <> 0 THEN CASE k % 5 WHEN 0 THEN e + INTERVAL 7 DAY WHEN 1 THEN e - INTERVAL 1 DAY WHEN 2 THEN e + INTERVAL 30 SECOND ELSE e END END AS live FROM s),
x AS (SELECT CAST(k AS VARCHAR) AS bid_number, strftime(live, '%d-%m-%Y %H:%M:%S') AS live_end_date, date_trunc('minute', live) <> date_trunc('minute', stored) AS extended,
  CASE WHEN NOT found THEN 'not_found' WHEN bad THEN 'error: unreadable end date' ELSE 'ok' END AS status, CASE WHEN found AND NOT bad THEN CAST(k % 2 AS INTEGER) END AS b_is_inactive,
  CAST((epoch(date_trunc('minute', live)) - epoch(date_trunc('minute', stored))) / 60 AS BIGINT) AS moved_minutes FROM v)"""
_EAV = """e AS (SELECT o_orderkey AS id, 'GEM/B/' || o_orderkey AS bid_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer,
  CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, (o_orderkey % 8) || '.5' AS half FROM orders)"""

ORACLES: dict[str, str] = {
    "hybrid_search": f"WITH {_lists(real='coalesce(NOT is_boilerplate, TRUE)')}, {_FUSED} {_TEN}",
    "hybrid_search_filtered": f"WITH {_lists(_SOME)}, {_FUSED} {_TEN}",
    "bm25_topk": f"WITH {_bm25(_Q, 1.0)} {_FORTY}",
    "bm25_weighted_title_text": f"WITH {_bm25(_Q)} {_FORTY}",
    "bm25_repeated_term": f"WITH {_bm25([['thing'], ['thing'], ['thatin']])} {_FORTY}",
    "bm25_phrase": f"WITH {_bm25([['of', 'the'], ['thing']])} {_FORTY}",
    "lexical_search": f"WITH {_bm25(_Q)}, b AS (SELECT * FROM bm ORDER BY score, chunk_id LIMIT 500) SELECT chunk_id, round(score, 9) AS score FROM b JOIN ch USING (chunk_id) WHERE lang = 'en' ORDER BY b.score, chunk_id LIMIT 20",
    "overfetch_post_filter": f"WITH {_bm25(_Q)}, b AS (SELECT * FROM bm ORDER BY score, chunk_id LIMIT 250) SELECT chunk_id FROM b JOIN ch USING (chunk_id) WHERE source = 'src3' ORDER BY score, chunk_id LIMIT 10",
    "overfetch_prefilter": f"WITH {_bm25(_Q)} SELECT chunk_id FROM bm JOIN ch USING (chunk_id) WHERE source = 'src3' ORDER BY score, chunk_id LIMIT 10",
    "term_document_frequency": f"WITH {_CHUNKS} SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(list_concat(a, b)) AS term FROM tk) GROUP BY term",
    "term_idf": f"WITH {_CHUNKS}, d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(list_concat(a, b)) AS term FROM tk) GROUP BY term) SELECT term, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM d, st",
    "corpus_stats": f"WITH {_CHUNKS} SELECT n, round(avgdl, 9) AS avgdl FROM st",
    "lexical_match_quality": f"WITH {_CHUNKS}, {_QUALITY} SELECT chunk_id, round(quality, 9) AS quality FROM ql",
    "knn_topk": f"SELECT chunk_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY v.distance, chunk_id) AS dense_rank FROM ({_NEAR}) v",
    "knn_filtered": f"""WITH v AS (SELECT vec_id AS chunk_id, 1 - {_DOT.format("embedding", "qe")} / sqrt({_DOT.format("embedding", "embedding")} * {_DOT.format("qe", "qe")}) AS distance
  FROM {_EMB} WHERE label IN (1, 2) ORDER BY distance, chunk_id LIMIT 20) SELECT chunk_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY v.distance, chunk_id) AS dense_rank FROM v""",
    "knn_batch": """SELECT query_id, chunk_id, round(distance, 6) AS distance, dense_rank FROM (
  SELECT query_id, chunk_id, p.distance, row_number() OVER (PARTITION BY query_id ORDER BY p.distance, chunk_id) AS dense_rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_sum([(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2 FOR i IN range(1, 65)]) AS distance
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) p) WHERE dense_rank <= 5""",
    "dense_confidence_bands": f"SELECT {_CONF} AS confidence, count(*) AS n FROM (SELECT {_L2} AS distance FROM {_EMB}) GROUP BY 1",
    "rrf_fusion": f"""WITH {_FREE}, lr AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS lexical_rank FROM lx)
SELECT chunk_id, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score, dense_rank, lexical_rank
FROM (SELECT chunk_id, dense_rank FROM dd) FULL OUTER JOIN lr USING (chunk_id)""",
    "confidence_fusion": f"WITH {_FREE}, {_FUSED} SELECT chunk_id, round(score, 9) AS score, dense_rank, lexical_rank FROM fu",
    "answerability_gate": "SELECT 0::BIGINT AS answers",
    "match_badge": f"""WITH {_FREE}, {_FUSED} SELECT chunk_id, CASE WHEN dense_rank <= 3 THEN 'High Match (Semantic)' WHEN lexical_rank <= 3 THEN 'High Match (Lexical)' ELSE 'Medium Match' END AS badge FROM fu""",
    "where_and_or": "SELECT doc_id AS chunk_id FROM documents WHERE (lang = 'de' OR source = 'src1') AND n_chars < 3000",
    "where_comparisons": "SELECT doc_id AS chunk_id FROM documents WHERE n_chars >= 700 AND n_chars < 2500 AND coalesce(lang, '') <> 'fr' AND coalesce(source, '') <> 'src2'",
    "where_nulls": f"""WITH {_CHUNKS} SELECT chunk_id, coalesce(NOT is_boilerplate, TRUE) AS ne, coalesce(NOT is_boilerplate, TRUE) AS nin, coalesce(NOT is_boilerplate, FALSE) AS nin_null,
  is_boilerplate IS NOT NULL AS gt, is_boilerplate IS NULL AS eq_null FROM ch""",
    "boilerplate_exclusion": f"WITH {_CHUNKS} SELECT chunk_id FROM ch WHERE coalesce(NOT is_boilerplate, TRUE)",
    "cdc_classify": f"{_CHANGES} SELECT doc_id, change FROM c",
    "cdc_sync_delta": f"{_CHANGES} SELECT doc_id, CASE WHEN change = 'removed' THEN 'delete' ELSE 'upsert' END AS op FROM c WHERE change IN ('removed', 'new', 'changed')",
    "snapshot_merge": f"{_CHANGES} SELECT c.doc_id, coalesce(CASE WHEN change IN ('new', 'changed') THEN md5(d.text) END, o.hash) AS hash FROM c LEFT JOIN old o USING (doc_id) LEFT JOIN documents d USING (doc_id) WHERE change <> 'removed' AND NOT (change = 'failed' AND o.doc_id IS NULL)",
    "removed_bids": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "stale_chunks": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 5 AND l_orderkey % 3 = 0",
    "new_candidates": f"WITH {_LIST} SELECT DISTINCT bid_id FROM ca WHERE bid_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)",
    "expiry_split": f"{_EXPIRY} SELECT o_orderkey, expired FROM x",
    "expiry_report": f"{_EXPIRY} SELECT count(*) FILTER (NOT expired) AS active_bid_count, count(*) FILTER (expired) AS expired_bid_count, CAST(sum(chunks) FILTER (expired) AS BIGINT) AS expired_chunk_count FROM x",
    "export_dedupe": f"WITH {_FIRST} SELECT bid_id, CAST(l_linenumber AS BIGINT) AS line FROM f",
    "export_rows": f"""WITH {_FIRST} SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'GeM' AS portal, bid_id, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE n_name END AS client,
  o_orderpriority AS title, CAST(qty AS VARCHAR) AS quantity, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start,
  strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') AS end_date, 'p/' || o_orderkey || '.pdf' AS link FROM f""",
    "date_range_filter": "SELECT o_orderkey FROM orders WHERE (o_orderkey % 19 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1995-03-01') AND (o_orderkey % 23 = 0 OR CAST(o_orderdate AS DATE) <= DATE '1997-06-30')",
    "newness_flag": "SELECT o_orderkey, o_orderkey % 29 <> 0 AND date_trunc('second', o_orderdate) <= TIMESTAMP '1997-01-08 00:00:00' AND date_trunc('second', o_orderdate) > TIMESTAMP '1997-01-01 00:00:00' AS is_new FROM orders",
    "extension_check": f"{_LIVE} SELECT * FROM x",
    "extension_labels": f"{_LIVE} SELECT bid_number, CASE WHEN extended THEN 'YES' WHEN status = 'not_found' THEN 'Closed (not extended)' WHEN NOT extended THEN 'No' ELSE 'Unknown (could not parse dates)' END AS label FROM x",
    "extension_counts": f"{_LIVE} SELECT count(*) FILTER (extended) AS extended_count, count(*) FILTER (status = 'not_found') AS not_found_count FROM x",
    "eav_pivot": f"WITH {_EAV} SELECT *, NULL::VARCHAR AS nothing FROM e",
    "eav_typed_value": f"""WITH {_EAV} SELECT id, 'bid_id' AS key, bid_id AS value FROM e UNION ALL SELECT id, 'status', status FROM e UNION ALL SELECT id, 'customer', customer FROM e
  UNION ALL SELECT id, 'even', even FROM e UNION ALL SELECT id, 'half', half FROM e""",
    "exact_id_lookup": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7",
    "ra_parent_mapping": f"WITH {_LIST} SELECT page, position, bid_id, bid_number FROM ca",
    "early_stop_pages": f"""WITH {_LIST}, k AS (SELECT DISTINCT bid_id FROM ca WHERE page BETWEEN 20 AND 22 OR page = 5),
p AS (SELECT page, bool_and(bid_id IN (SELECT bid_id FROM k)) AS a FROM ca GROUP BY page),
s AS (SELECT min(page) AS stop FROM (SELECT page, count(*) FILTER (a) OVER (ORDER BY page ROWS 2 PRECEDING) AS run FROM p) WHERE run = 3)
SELECT page, count(*) AS n FROM ca, s WHERE stop IS NULL OR page <= stop GROUP BY page""",
    "manifest_explode": "SELECT o_orderkey AS bid_id, o_orderpriority AS bid_number, strftime(o_orderdate, '%Y-%m-%d') AS download_date FROM orders",
    "metadata_null_drop": f"WITH {_CHUNKS} SELECT chunk_id, CAST((lang IS NOT NULL) AS BIGINT) + CAST((source IS NOT NULL) AS BIGINT) + CAST((n_chars IS NOT NULL) AS BIGINT) + CAST((is_boilerplate IS NOT NULL) AS BIGINT) AS entries FROM ch",
    "chunk_validity": "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 7 <> 0",
    "last_wins": "SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey",
    "download_names": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'bid ' || page_id || '.pdf' WHEN 1 THEN 'a_b' || page_id || '.pdf'
  ELSE 'document' || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.bin' END END AS name FROM pages""",
}

from lakeseek import oracles_records  # noqa: E402  it uses the parts above

ORACLES |= oracles_records.ORACLES
