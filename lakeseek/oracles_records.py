"""DuckDB SQL for the queries of queries_records."""

from __future__ import annotations

from lakeseek.oracles import _BID, _CATEGORY, _DAY, _ELIGIBILITY, _EMD, _END_DAY, _FILE, _ORG, _OVERVIEW, _POLICY, _WIDE
from lakeseek.oracles_more import _CHANGES, _EXPIRY, _FIRST, _FUSED, _LIST, _LIVE, _Q, _bm25, _lists

_NO_BID = "o_orderkey % 7 <> 0"
_REAL = "coalesce(NOT is_boilerplate, TRUE)"
#: Fused with candidates for a limit of 40 instead of 10.
_WIDER = _lists(real=_REAL).replace("LIMIT 1000)", "LIMIT 4000)").replace("LIMIT 40)", "LIMIT 160)")
_ORDER = "fu.score DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id"
_ROWS = """o AS (SELECT o_orderkey AS id, 'e' || o_orderkey AS embedding_id, o.* FROM orders o JOIN nation ON n_nationkey = o_orderkey % 25
  JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 <> 3 AND r_name = '{}')"""

ORACLES: dict[str, str] = {
    "bid_records": f"""WITH {_WIDE}
SELECT {_BID} AS bid_id, 'GeM' AS portal, '2024-01-01T00:00:00Z' AS date, '2024-01-01T00:00:00Z' AS added_at, {_ORG} AS client_organization,
  r_name AS ministry, CASE WHEN k % 4 <> 3 THEN c_name END AS organisation, {_CATEGORY} AS bid_title, qty AS quantity, {_EMD} AS emd_amount, NULL::VARCHAR AS delivery_period,
  {_DAY} || ' 09:00:00' AS start_date_to_submit_bid, {_END_DAY} || ' 21:00:00' AS end_date_to_submit_bid,
  CASE WHEN k % 3 = 0 THEN 'https://portal.example/showbidDocument/' || k ELSE {_FILE} END AS pdf_link,
  strftime(o_orderdate, '%Y-%m-%d') AS published_date, TRUE AS document_hash, 'bids/2024-01-01/' || {_FILE} AS pdf_path FROM wide""",
    "chunk_texts": f"""WITH {_WIDE}, c AS (
  SELECT {_BID} || '::overview' AS chunk_id, {_OVERVIEW} AS text FROM wide
  UNION ALL SELECT {_BID} || '::eligibility_financial', {_ELIGIBILITY} FROM wide
  UNION ALL SELECT {_BID} || '::scope_of_work', {_CATEGORY} FROM wide
  UNION ALL SELECT {_BID} || '::preference_policy', {_POLICY} FROM wide
  UNION ALL SELECT {_BID} || '::atc_clause::1', 'Generic: First term of order ' || k || chr(10) || o_orderstatus FROM wide
  UNION ALL SELECT {_BID} || '::atc_clause::2', 'Delivery / Training: Deliver to ' || c_name FROM wide) SELECT * FROM c WHERE text <> ''""",
    "parent_metadata": """SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, CASE WHEN l_orderkey % 3 <> 0 THEN o_orderpriority END) AS metadata
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "file_ids": f"SELECT o_orderkey AS bid_id FROM orders WHERE {_NO_BID} AND o_orderkey % 5 <> 0 AND o_orderkey <> 0",
    "relative_paths": f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN {_NO_BID} THEN '/bid_' || o_orderkey || '_doc.pdf' ELSE '/other-' || o_orderkey || '.pdf' END AS relative FROM orders",
    "known_bid_ids": f"SELECT o_orderkey AS bid_id FROM orders WHERE o_orderkey % 3 = 0 OR ({_NO_BID} AND o_orderkey % 5 <> 0)",
    "manifest_join": f"""SELECT o_orderkey, CASE WHEN {_NO_BID} THEN o_orderkey END AS internal_id, CASE WHEN {_NO_BID} AND o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS download_date,
  CASE WHEN {_NO_BID} AND o_orderkey % 3 = 0 THEN o_orderpriority END AS downloaded_at FROM orders""",
    "manifest_round_trip": "SELECT o_orderkey AS bid_id, strftime(o_orderdate, '%Y-%m-%d') AS download_date, o_orderpriority AS downloaded_at FROM orders",
    "sorted_ids": f"{_CHANGES} SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM c JOIN documents USING (doc_id) WHERE change IN ('new', 'changed') GROUP BY source",
    "download_cap": f"""WITH {_LIST}, f AS (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY page, position) AS rn FROM ca)
SELECT bid_id, bid_number FROM f WHERE rn = 1 AND bid_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) ORDER BY page, position LIMIT 25""",
    "download_counters": """SELECT count(*) AS attempted, count(*) FILTER (o_orderkey % 6 <> 0) AS downloaded, count(*) FILTER (o_orderkey % 6 = 0) AS failed,
  CAST(sum(o_orderkey % 100) FILTER (o_orderkey % 6 <> 0) AS BIGINT) AS n_bytes FROM orders""",
    "delta_counters": f"{_CHANGES} SELECT change, count(*) AS n FROM c GROUP BY change",
    "expired_ids": f"{_EXPIRY} SELECT o_orderkey, nullif(chunks, 0) AS chunks FROM x WHERE expired",
    "result_fields": f"""WITH {_lists(real=_REAL)}, {_FUSED}, t AS (SELECT * FROM fu ORDER BY {_ORDER} LIMIT 10)
SELECT chunk_id, NULL::VARCHAR AS bid_id, NULL::VARCHAR AS chunk_type, title AS bid_title, round(score, 6) AS score, dense_rank, lexical_rank, text FROM t JOIN ch USING (chunk_id)""",
    "status_augmented_export": f"""{_LIVE}, {_FIRST}
SELECT bid_id, coalesce(live_end_date, '') AS live_end, CASE WHEN extended THEN 'YES' WHEN status = 'not_found' THEN 'Closed (not extended)' WHEN NOT extended THEN 'No' ELSE 'Unknown (could not parse dates)' END AS extended,
  coalesce(status, 'unknown') AS status FROM f LEFT JOIN x ON 'GEM/B/' || bid_number = bid_id""",
    "display_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN 'start' ELSE 'N/A' END AS start_label,
  CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'N/A' END AS end_label FROM orders""",
    "bid_files": """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'named/' || o_orderkey || '.pdf' WHEN o_orderkey % 3 = 0 THEN 'x/bid_' || (o_orderkey + 100000) || '_doc.PDF' END AS path FROM orders""",
    "collection_scan": f"WITH {_ROWS.format('ASIA')} SELECT embedding_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer, 5::BIGINT AS entries FROM o",
    "collection_members": f"WITH {_ROWS.format('EUROPE')} SELECT id, embedding_id FROM o",
    "collection_search": f"""WITH {_bm25(_Q, 1.0)}, b AS (SELECT chunk_id, score FROM bm JOIN nation ON n_nationkey = chunk_id % 25 JOIN region ON r_regionkey = n_regionkey
  WHERE n_nationkey % 4 <> 3 AND r_name = 'AMERICA' ORDER BY score, chunk_id LIMIT 375)
SELECT 'e' || chunk_id AS embedding_id, round(score, 9) AS score FROM b JOIN ch USING (chunk_id) WHERE lang = 'en' ORDER BY b.score, chunk_id LIMIT 15""",
    "collection_search_by_id": "SELECT 'e27' AS embedding_id, -1e12::DOUBLE AS score, 'GEM/2024/B/27' AS bid_id",
    "metadata_json": "SELECT o_orderkey AS id, o_orderstatus AS status, (o_orderkey % 8) || '.5' AS half FROM orders",
    "vector_metadata_entries": """SELECT doc_id AS chunk_id, 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL""",
    "run_dates": """SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS at_midnight,
  strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOUR + INTERVAL 330 MINUTE, '%Y-%m-%d') AS at_eight FROM orders""",
    "exact_id_first": "SELECT doc_id AS chunk_id, 'GEM/2024/B/7' AS bid_id FROM documents WHERE doc_id % 100 = 7",
    "index_after_update": """WITH ch AS (SELECT doc_id AS chunk_id, split_part(text, chr(10), 1) AS title, text FROM documents WHERE doc_id % 4 <> 0),
t AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}\\p{Co}]+')) AS term FROM ch) SELECT term, count(*) AS df FROM t GROUP BY term""",
    "search_between_dates": f"""WITH {_WIDER}, {_FUSED}, t AS (SELECT * FROM fu ORDER BY {_ORDER} LIMIT 40)
SELECT chunk_id, round(score, 9) AS score FROM t WHERE chunk_id % 60 >= 14 ORDER BY t.score DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id LIMIT 10""",
}
