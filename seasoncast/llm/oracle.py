"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_TWO = "('ac.uk','co.in','co.jp','co.kr','co.nz','co.uk','co.za','com.au','com.br','com.cn','com.mx','com.tr','gov.uk','net.au','org.au','org.uk')"
_K = "1.0 / least(greatest(coalesce(sum(power(y - n*mu, 2) - n*mu*(1-mu)) / nullif(sum(n*mu*(1-mu)*(n-1)), 0), 1e-4), 1e-4), 0.5) - 1.0"

ORACLE["op1_url_reputation"] = rf"""
WITH page AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
named AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM page),
parts AS (SELECT *, regexp_extract(name, '([^.]+\.[^.]+)$', 1) AS two, regexp_extract(name, '([^.]+\.[^.]+\.[^.]+)$', 1) AS three,
                 regexp_matches(name, '^[0-9.]+$') AS address FROM named),
placed AS (
  SELECT page_id, host, path,
         CASE WHEN address THEN name WHEN two IN {_TWO} AND three <> '' THEN three
              WHEN two <> '' AND two NOT IN {_TWO} THEN two ELSE name END AS domain,
         CASE WHEN address THEN '' WHEN two IN {_TWO} THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix
  FROM parts),
outcome AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
counts AS (
  SELECT host, domain, suffix, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS y
  FROM placed LEFT JOIN outcome USING (page_id) GROUP BY ALL),
s0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, (SELECT (sum(y) + 1.0) / (sum(n) + 2.0) FROM counts) AS mu FROM counts GROUP BY 1),
s1 AS (SELECT suffix, (k*mu + y) / (k + n) AS mu FROM s0, (SELECT {_K} AS k FROM s0 WHERE n > 0)),
d0 AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, any_value(mu) AS mu FROM counts JOIN s1 USING (suffix) GROUP BY 1, 2),
d1 AS (SELECT domain, suffix, (k*mu + y) / (k + n) AS mu FROM d0, (SELECT {_K} AS k FROM d0 WHERE n > 0)),
h0 AS (SELECT host, n, y, mu FROM counts JOIN d1 USING (domain, suffix)),
h1 AS (SELECT host, n, y, (k*mu + y) / (k + n) AS rate, k*mu + y AS a, k*(1-mu) + n - y AS b
       FROM h0, (SELECT {_K} AS k FROM h0 WHERE n > 0)),
h2 AS (SELECT host, n, rate, rate - 1.645 * sqrt(a*b / ((a+b)*(a+b)*(a+b+1))) AS bound FROM h1),
ruled AS (
  SELECT page_id, host, path, n, rate, bound,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM placed JOIN h2 USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
       n AS host_labelled, round(rate, 6) AS host_rate, round(bound, 6) AS host_bound
FROM ruled
"""

ORACLE["op9_chat_snapshots"] = """
WITH placed AS (
  SELECT conv_id, row_number() OVER w - 1 AS pos, coalesce(role, '0') || chr(1) || (role IS NULL) || chr(1) || coalesce(text, '') || chr(1) || (text IS NULL) AS said,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS piece
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
prefixes AS (
  SELECT conv_id, pos, list(said) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM prefixes WHERE pos = n - 1 GROUP BY prefix),
proper AS (SELECT DISTINCT prefix FROM prefixes WHERE pos < n - 1),
kept AS (SELECT conv_id, n_copies, n_turns FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper))
SELECT conv_id, pos // 256 AS part, n_turns, n_copies, string_agg(piece, '' ORDER BY pos) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, pos // 256, n_turns, n_copies
"""

_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in (
    "lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "work is licensed under", "sign in to", "subscribe to our"))
_COUNT = "(length(line) - length(regexp_replace(line, '{0}', '', 'g')))"

ORACLE["op6_line_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM d),
said AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT r, i, word || chr(1) || lead(word) OVER t || chr(1) || lead(word, 2) OVER t AS gram FROM said WINDOW t AS (PARTITION BY r ORDER BY i)),
hits AS (SELECT r, i FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM hits, range(3) o(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT r, line, strlen(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS ink, len(regexp_extract_all(line, '{_WORD}')) AS n,
         regexp_extract(line, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
         {_COUNT.format('!')} AS shouts, {_COUNT.format('[|>]')} AS bars, {_COUNT.format('[#*$%&|<>]')} AS symbols, ({_PHRASES}) AS phrase
  FROM lines WHERE regexp_matches(line, '{_WORD}')),
failed AS (
  SELECT r, line, ink, (NOT (last IN ('.', '!', '?', ':', ';', '"', '''', ')', ']', '}}') OR unicode(last) >= 128) AND n < 8)
         OR shouts > 0.3 * n OR (bars >= 2 AND bars > 0.2 * n) OR symbols > 0.1 * ink OR phrase AS fails FROM judged),
by_doc AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count_if(fails) AS removed,
                  sum(CASE WHEN fails THEN ink ELSE 0 END)::DOUBLE / sum(ink)::DOUBLE AS lost FROM failed GROUP BY r),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0.0) AS lost
  FROM d JOIN words USING (r) LEFT JOIN by_doc USING (r) LEFT JOIN covered USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4 AS kept
FROM figures
"""

ORACLE["op2_lsh_forest_join"] = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
sets AS MATERIALIZED (SELECT r, doc_id, len(g) AS n, md5(array_to_string(g, chr(10))) AS id FROM s),
texts AS MATERIALIZED (SELECT id, min(doc_id) AS least, min(r) AS one, any_value(n) AS n, count(*) AS copies FROM sets WHERE n > 0 GROUP BY id),
e AS MATERIALIZED (SELECT id, unnest(g) AS gram FROM texts JOIN s ON s.r = texts.one),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT x, y FROM common JOIN texts a ON a.id = x JOIN texts b ON b.id = y WHERE 9 * c >= 4 * (a.n + b.n)),
links AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(id, other) AS (SELECT id, id FROM texts UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.other),
classes AS (SELECT reach.id, min(least) AS class_id FROM reach JOIN texts ON texts.id = reach.other GROUP BY 1),
counted AS (SELECT x AS id, sum(copies) AS links, count(*) AS n_texts FROM links JOIN texts ON texts.id = y GROUP BY 1)
SELECT doc_id, CASE WHEN sets.n > 0 THEN class_id ELSE doc_id END AS class_id,
       CASE WHEN sets.n > 0 THEN coalesce(links, 0) + copies - 1 ELSE 0 END::BIGINT AS n_links,
       coalesce(n_texts, 0)::BIGINT AS n_text_links, coalesce(copies, 1)::BIGINT AS n_copies
FROM sets LEFT JOIN texts USING (id) LEFT JOIN classes USING (id) LEFT JOIN counted USING (id)
"""

ORACLE["op5_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS MATERIALIZED (
  SELECT r, p, md5_number(substr(x, 2 * p::BIGINT + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, strlen(x) // 2 - 199)) AS p FROM d)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
marked AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM windows SEMI JOIN again USING (k)),
runs AS (SELECT r, p, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
spans AS MATERIALIZED (SELECT r, run, min(p) AS lo, max(p) + 200 AS hi FROM runs GROUP BY r, run),
cuts AS (SELECT r, lo AS stop, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS start FROM spans
         UNION ALL SELECT d.r, strlen(x) // 2, coalesce(max(hi), 0) FROM d LEFT JOIN spans USING (r) GROUP BY d.r, x),
kept AS (SELECT r, string_agg(substr(x, 2 * start::BIGINT + 1, 2 * (stop - start)::BIGINT), '' ORDER BY start) AS rest FROM cuts JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(hi - lo) AS n, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE["op12_lexical_scan"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN wanted USING (term) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, size GROUP BY term, n_docs),
gain AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms))) AS gain
  FROM tf JOIN weight USING (term) JOIN d USING (r), size),
scored AS (SELECT item_id, r, sum(gain)::BIGINT AS score FROM wanted JOIN gain USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored JOIN d USING (r) WHERE score > 0
QUALIFY rank <= 50
"""

ORACLE["op11_source_schedule"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][sid % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining,
             (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, sid)),
f AS (SELECT *, cap::DOUBLE * weights::DOUBLE >= weight::DOUBLE * remaining::DOUBLE AS below FROM l),
lv AS (SELECT max(remaining) FILTER (below) AS remaining_, max(weights) FILTER (below) AS weights_ FROM f),
t AS (SELECT source, source_size, CASE WHEN below THEN (weight * remaining_)::DOUBLE / weights_::DOUBLE ELSE cap::DOUBLE END AS target FROM f, lv),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS take FROM t),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d)
SELECT doc_id, placed.source, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (take // source_size) * size + least(greatest(take % source_size - first, 0), size) END::BIGINT AS taken
FROM placed JOIN p ON placed.source IS NOT DISTINCT FROM p.source
"""
