"""DuckDB SQL for each query, on the base columns rather than on the synthetic texts."""

from __future__ import annotations

_WIDE = """
wide AS (
  SELECT o.*, c.c_name, c.c_mktsegment, n.n_name, r.r_name, q.qty, o.o_orderkey AS k
  FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey) q ON q.l_orderkey = o.o_orderkey)"""
_DAY = "strftime(o_orderdate, '%d-%m-%Y')"
_END_DAY = "strftime(CAST(o_orderdate AS DATE) + CAST(k % 30 AS INTEGER), '%d-%m-%Y')"
_BID = "'GEM/' || year(o_orderdate) || '/B/' || k"
_ORG = "CASE WHEN k % 4 <> 3 THEN c_name ELSE n_name END"
_FILE = "'bid_' || k || '_doc.pdf'"
_EMD = "CASE WHEN k % 4 IN (0, 2) THEN CAST(k * 10 AS DOUBLE) END"
_CATEGORY = "o_orderpriority || ' , ' || c_mktsegment"
_OVERVIEW = f"""concat_ws(' ', 'Procurement of ' || {_CATEGORY} || '.', 'Required by ' || {_ORG} || ' (' || r_name || ').',
  CASE WHEN qty <> 0 THEN 'Quantity: ' || qty || '.' END, CASE WHEN k % 4 IN (0, 2) AND k <> 0 THEN 'EMD Amount: ' || (k * 10) || '.0.' END,
  'Bid closes: ' || {_END_DAY} || ' 21:00:00.')"""
_OEM = "CASE WHEN k % 3 = 1 THEN CAST(k % 7000 AS DOUBLE) END"
_ELIGIBILITY = """concat_ws(' ',
  CASE WHEN k % 3 = 0 AND k % 50 <> 0 THEN 'Minimum average annual turnover required: ' || (k % 50) || '.0 Lakh.' END,
  CASE WHEN k % 3 = 1 AND k % 7000 <> 0 THEN 'OEM average turnover required: ' || (k % 7000) || '.0 crore.' END,
  CASE WHEN k % 5 <> 0 THEN 'Past experience required: ' || (k % 5) || ' years.' END,
  CASE WHEN k % 2 = 0 THEN 'Past performance requirement: ' || (k % 100) || '%.' END,
  CASE WHEN k % 4 IN (0, 2) AND k <> 0 THEN 'EMD amount: ' || (k * 10) || '.0, advisory bank State Bank of India.' END,
  CASE WHEN k % 6 IN (0, 1, 3) THEN 'ePBG required: ' || (k % 10) || '.5% for ' || (k % 36) || ' months.' END)"""
_POLICY = """concat_ws(' ',
  CASE WHEN k % 13 = 0 AND (k % 60 <> 0 OR k % 30 <> 0) THEN 'Local content requirement: minimum ' || (k % 60) || '% (Class I) / ' || (k % 30) || '% (Class II).' END,
  CASE WHEN k % 14 = 0 AND k % 20 <> 0 THEN 'MII purchase preference applies up to L1+' || (k % 20) || '%' || CASE WHEN k % 50 <> 0 THEN ', max ' || (k % 50) || '% of quantity.' ELSE '.' END END,
  CASE WHEN k % 11 = 0 AND k % 15 <> 0 THEN 'MSE purchase preference applies up to L1+' || (k % 15) || '%' || CASE WHEN k % 25 <> 0 THEN ', max ' || (k % 25) || '% of quantity.' ELSE '.' END END)"""

ORACLES: dict[str, str] = {
    "extract_bid_fields": f"""WITH {_WIDE}
SELECT {_BID} AS bid_id, 'GeM' AS portal, '2024-01-01T00:00:00Z' AS date, '2024-01-01T00:00:00Z' AS added_at, {_ORG} AS client_organization,
  r_name AS ministry, CASE WHEN k % 4 <> 3 THEN c_name END AS organisation, {_CATEGORY} AS bid_title, qty AS quantity, '-' AS delivery_period,
  {_DAY} || ' 09:00:00' AS start_date_to_submit_bid, {_END_DAY} || ' 21:00:00' AS end_date_to_submit_bid,
  CASE WHEN k % 3 = 0 THEN 'https://portal.example/showbidDocument/' || k ELSE {_FILE} END AS pdf_link,
  strftime(o_orderdate, '%Y-%m-%d') AS published_date, 'bids/2024-01-01/' || {_FILE} AS pdf_path FROM wide""",
    "extract_quantity": f"WITH {_WIDE} SELECT k AS o_orderkey, qty AS quantity FROM wide",
    "extract_datetime": f"WITH {_WIDE} SELECT k AS o_orderkey, {_DAY} || ' 09:00:00' AS bid_start, {_END_DAY} || ' 21:00:00' AS bid_end FROM wide",
    "extract_turnover": f"""WITH {_WIDE} SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN CAST(k % 50 AS DOUBLE) END AS turnover, 'Lakh' AS unit,
  {_OEM} AS oem_turnover, CASE WHEN k % 3 = 1 THEN 'crore' ELSE 'Lakh' END AS oem_unit FROM wide""",
    "extract_experience": f"WITH {_WIDE} SELECT k AS o_orderkey, CASE WHEN k % 5 <> 0 THEN k % 5 END AS years, CASE WHEN k % 2 = 0 THEN k % 100 END AS past_performance FROM wide",
    "extract_emd": f"WITH {_WIDE} SELECT k AS o_orderkey, {_EMD} AS emd_amount, CASE WHEN k % 4 IN (0, 2) THEN 'State Bank of India' END AS bank FROM wide",
    "extract_epbg": f"""WITH {_WIDE} SELECT k AS o_orderkey, k % 6 <> 2 AS required, CASE WHEN k % 6 IN (0, 1, 3) THEN (k % 10) + 0.5::DOUBLE END AS percent,
  CASE WHEN k % 6 IN (0, 1, 3) THEN k % 36 END AS months, CASE WHEN k % 6 IN (0, 1, 3) THEN 'Union Bank' END AS bank FROM wide""",
    "extract_preference": f"""WITH {_WIDE} SELECT k AS o_orderkey, k % 14 = 0 AS mii, CASE WHEN k % 7 = 0 THEN k % 20 END AS mii_band, CASE WHEN k % 7 = 0 THEN k % 50 END AS mii_share,
  k % 11 = 0 AS mse, CASE WHEN k % 11 = 0 THEN k % 15 END AS mse_band, CASE WHEN k % 11 = 0 THEN k % 25 END AS mse_share FROM wide""",
    "extract_local_content": f"WITH {_WIDE} SELECT k AS o_orderkey, CASE WHEN k % 13 = 0 THEN k % 60 END AS class1, CASE WHEN k % 13 = 0 THEN k % 30 END AS class2 FROM wide",
    "extract_bid_id": f"""WITH {_WIDE} SELECT k AS o_orderkey,
  CASE WHEN k % 9 = 0 THEN 'GEM/UNKNOWN/B/0000000' WHEN k % 3 = 0 THEN 'GEM/UNKNOWN/B/' || k ELSE {_BID} END AS bid_id,
  CASE WHEN k % 3 = 0 THEN 'https://portal.example/showbidDocument/' || k ELSE {_FILE} END AS pdf_link FROM wide""",
    "item_category_takewhile": f"WITH {_WIDE} SELECT k AS o_orderkey, {_CATEGORY} AS category FROM wide",
    "parse_date": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS long_year, strftime(o_orderdate, '%Y-%m-%d') AS short_year,
  strftime(o_orderdate, '%Y/%m/%d') AS other FROM orders""",
    "atc_clauses": f"""WITH {_WIDE}
SELECT k AS o_orderkey, 1::BIGINT AS clause_no, 'Generic' AS heading, 'First term of order ' || k || chr(10) || o_orderstatus AS body FROM wide
UNION ALL SELECT k, 2, 'Delivery / Training', 'Deliver to ' || c_name FROM wide""",
    "overview_chunk": f"WITH {_WIDE} SELECT {_BID} AS bid_id, {_OVERVIEW} AS overview FROM wide",
    "eligibility_chunk": f"WITH {_WIDE} SELECT k AS o_orderkey, {_ELIGIBILITY} AS eligibility FROM wide",
    "preference_chunk": f"WITH {_WIDE} SELECT k AS o_orderkey, {_POLICY} AS policy FROM wide",
    "all_chunks": f"""WITH {_WIDE}, c AS (
  SELECT {_BID} AS bid_id, 'overview' AS chunk_type, NULL::BIGINT AS clause_no, {_OVERVIEW} AS t FROM wide
  UNION ALL SELECT {_BID}, 'eligibility_financial', NULL, {_ELIGIBILITY} FROM wide
  UNION ALL SELECT {_BID}, 'scope_of_work', NULL, {_CATEGORY} FROM wide
  UNION ALL SELECT {_BID}, 'preference_policy', NULL, {_POLICY} FROM wide
  UNION ALL SELECT {_BID}, 'atc_clause', unnest([1, 2]), 'x' FROM wide)
SELECT bid_id || '::' || chunk_type || CASE WHEN clause_no IS NULL THEN '' ELSE '::' || clause_no END AS chunk_id, bid_id, chunk_type, clause_no FROM c WHERE t <> ''""",
    "query_terms": """SELECT item_id, array_to_string([lower(w) FOR w IN regexp_extract_all(text, '[A-Za-z0-9]+')
  IF (length(w) >= 3 OR (upper(w) = w AND regexp_matches(w, '[A-Z]'))) AND lower(w) NOT IN
  ('a','an','and','as','at','by','category','clearly','details','for','from','generic','goods','in','item','items','not','of','on','or','per','product','products',
   'required','requirement','service','services','specified','the','to','use','with')], ' ') AS terms FROM benchmark""",
    "index_tokens": r"""SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+'), ' ') AS tokens FROM documents""",
    "normalise_text": "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm FROM documents",
    "content_hash": "SELECT doc_id, md5(text) AS hash FROM documents",
}
