"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: chr(11) and chr(12) are the two white-space characters without an escape in SQL.
_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _shingle_sets(source: str, key: str) -> str:
    words = _WORDS.format(_LOWER.format("text"))
    return f"""
    SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM (SELECT {key}, {words} AS w FROM {source}) WHERE len(w) > 0)"""


ORACLES: dict[str, str] = {
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, {_LOWER.format(f"trim(lines[i], {_SPACES})")} AS k, len(lines) AS n
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, max(n) AS n_lines, count(*) FILTER (k IN (SELECT k FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM l GROUP BY doc_id""",
    "op8_decontaminate": f"""
WITH d AS ({_shingle_sets("documents", "doc_id")}), b AS ({_shingle_sets("benchmark", "item_id")}),
q AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM d JOIN b USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING 100 * count(*) >= 80 * n_item_shingles""",
}

#: What escaping adds: a character for each backslash and each control string's first character.
_ESCAPED = r"""length({0}) + length({0}) - length(replace({0}, '\', ''))
  + len(regexp_extract_all({0}, '<\||</?s>|\[/?INST\]')) + 2 * len(regexp_extract_all({0}, '<</?SYS>>'))"""
ORACLES["op5_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_ESCAPED.format("r")} + {_ESCAPED.format("x")} + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


#: Whole groups times whole vocabulary, where the operator joins postings.
ORACLES["op11_source_divergence"] = f"""
    WITH d AS (SELECT coalesce(doc_id, -1 - row_number() OVER ()) AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
    groups AS (SELECT DISTINCT lang, source FROM d),
    counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    every AS (SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS ln FROM groups JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
    shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
                      1 + (1000000000 * (ln + 2)) // (sum(ln) OVER g + 2 * count(*) OVER g) AS q
               FROM every WINDOW g AS (PARTITION BY lang, source)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
              UNION ALL
              SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    WHERE part = 'pair' OR rank <= 10"""


def _clustering(clusters: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid in each round."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) - 1 AS k, x AS c FROM v
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) <= {clusters})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT row, vec_id, x, k, d FROM (
                    SELECT row, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i})
                QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
                        SELECT k, list(({floor})::BIGINT ORDER BY dim) AS c FROM (
                            SELECT k, dim, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS dim FROM a{i}) GROUP BY k, dim)
                        GROUP BY k) m USING (k))"""
            )
    return f"""
    WITH {", ".join(steps)}
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLES["op12_centroids"] = _clustering()

#: For pages laid out as those of the test tables: one article element, of headings and paragraphs.
ORACLES["op13_html_text"] = r"""
    WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(h, '<br>', ' '), '</?(h1|p)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
    c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
            '&quot;?', '"', 'g'), '&#(x27|39);?', chr(39), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM b),
    d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""
