"""SQL that says the same as each query, for another engine to run on the same tables."""

from __future__ import annotations

from quillmatch.plans.config import ADMIN_WORDS, STOP_WORDS
from quillmatch.plans.queries import ALLOW, BLOCK, VOCAB


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


GRANTS = """g AS (SELECT doc_id, 'doc-' || doc_id AS id, source, source AS agency, substr(text, 1, 80) AS title,
  CASE WHEN doc_id % 10 = 0 THEN '93.' || doc_id ELSE 'N-' || doc_id END AS number, substr(text, 1, 2000) AS synopsis, lower(text) AS searchable_text,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + (doc_id % 150)::INT, '%Y-%m-%d') END AS close_date,
  CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE '$' || (doc_id * 7919 % 9000) * 1000 END AS award_ceiling, 'https://grants.example.org/' || doc_id AS link,
  strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') || 'T10:00:00' AS timestamp FROM documents)"""
PROFILES = """kw0 AS (SELECT conv_id, turn, string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +') AS w FROM conversations WHERE role = 'user'),
kw1 AS (SELECT conv_id, turn, unnest(w) AS kw, unnest(range(len(w))) AS i FROM kw0),
fk AS (SELECT conv_id, 'fac-' || conv_id AS name, kw, min((turn, i)) AS seen FROM kw1 WHERE length(kw) >= 4 GROUP BY ALL),
fw AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'),
f AS (SELECT fw.conv_id, 'fac-' || fw.conv_id AS name, 'dept-' || fw.conv_id % 7 AS department, CASE WHEN fw.conv_id % 4 = 0 THEN '' ELSE 'fac' || fw.conv_id || '@example.org' END AS email,
  k.keywords, coalesce(k.n, 0) AS n_kw, e.embedding, fw.conv_id % 3 AS src, CASE WHEN fw.conv_id % 5 = 0 THEN 4 ELSE 5 END AS version
  FROM fw LEFT JOIN (SELECT conv_id, list(kw ORDER BY seen) AS keywords, count(*) AS n FROM fk GROUP BY 1) k USING (conv_id) LEFT JOIN embeddings e ON e.vec_id = fw.conv_id)"""
IDF = """nf AS (SELECT count(*) AS n FROM f),
idf AS (SELECT kw, count(DISTINCT conv_id) AS df, ln(any_value(n) / count(DISTINCT conv_id)) AS idf FROM fk, nf GROUP BY kw),
dyn AS (SELECT kw FROM idf WHERE idf <= ln(1.0 / 0.08))"""
ELIGIBLE = f"""good AS (SELECT kw, idf FROM idf WHERE kw NOT IN (SELECT kw FROM dyn) AND kw NOT IN ({_list(STOP_WORDS)}) AND kw NOT IN ({_list(ADMIN_WORDS)}))"""
JOIN = """gn AS (SELECT doc_id, id, regexp_replace(searchable_text, '[^a-z0-9 ]', ' ', 'g') AS text, regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g') AS title FROM g),
gt AS (SELECT DISTINCT doc_id, id, unnest(string_split_regex(text, ' +')) AS kw, title, length(text) AS len FROM gn),
gk AS (SELECT gt.doc_id, id, kw, idf, len, contains(' ' || title || ' ', ' ' || kw || ' ')::INT AS in_title FROM gt JOIN good USING (kw))"""
PAIRS = """pr AS (SELECT gk.doc_id, gk.id, fk.name, list(kw ORDER BY kw) AS keywords, count(*) AS n_matched, sum(in_title)::BIGINT AS title_hits, sum(least(idf, 5.0)) AS idf_sum, sum(length(kw)) AS raw_len, any_value(len) AS len
  FROM gk JOIN fk USING (kw) GROUP BY ALL),
ps AS (SELECT *, n_matched + title_hits AS score, least(least(idf_sum / 20, 1.0) + least(0.05 * title_hits, 0.15) + least(5.0 * raw_len / greatest(len, 1), 0.10), 1.0) AS kwc FROM pr),
kwm AS (SELECT *, least(round_even(kwc * 100, 0), 99)::BIGINT AS conf FROM ps)"""
SEMANTIC = """nc AS (SELECT count(DISTINCT conv_id) AS c FROM conversations), ne AS (SELECT count(*) AS c FROM embeddings),
gv AS (SELECT g.doc_id, g.id, e.embedding FROM g, nc, ne, embeddings e WHERE e.vec_id = nc.c + g.doc_id % (ne.c - nc.c)),
sims AS (SELECT gv.doc_id, gv.id, f.name, list_dot_product(gv.embedding::DOUBLE[], f.embedding::DOUBLE[]) AS sim FROM gv, f WHERE f.embedding IS NOT NULL),
sem AS (SELECT * FROM sims WHERE sim >= 0.25)"""
MATCHES = """al AS (SELECT doc_id, id, name, 'keyword' AS match_type, keywords, score, 0.0::DOUBLE AS sim, conf FROM kwm
  UNION ALL SELECT doc_id, id, name, 'semantic', [], 0, sim, least(round_even(sim * 0.85 * 100, 0), 99)::BIGINT FROM sem ANTI JOIN kwm USING (id, name)),
st AS (SELECT * FROM al WHERE conf >= 15 AND (match_type <> 'keyword' OR len(keywords) >= 2 OR conf >= 50)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, match_type, sim DESC, name) AS rank FROM st),
m AS (SELECT (DATE '2100-01-01' - substr(g.timestamp, 1, 10)::DATE)::BIGINT * 10000000000000 + rk.doc_id * 1000 + rank AS pos, g.timestamp, rk.id AS grant_id, g.title AS grant_title, g.agency AS grant_agency,
  g.close_date, g.award_ceiling, g.link, rk.name AS faculty_name, f.department AS faculty_department, rk.keywords, score AS match_score, match_type, sim, conf FROM rk JOIN g USING (id) JOIN f ON f.name = rk.name WHERE rank <= 50)"""

P = f"WITH {PROFILES}\n"
PG = f"WITH {GRANTS},\n{PROFILES}\n"
PI = f"WITH {PROFILES},\n{IDF}\n"
PK = f"WITH {GRANTS},\n{PROFILES},\n{IDF},\n{ELIGIBLE},\n{JOIN}\n"
PP = f"{PK.rstrip()},\n{PAIRS}\n"
PS = f"WITH {GRANTS},\n{PROFILES},\n{SEMANTIC}\n"
PA = f"{PP.rstrip()},\n{SEMANTIC}\n"
PM = f"{PA.rstrip()},\n{MATCHES}\n"

LOGS = """WITH l AS (SELECT event_id AS line_no, event_type, user_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'mod' || user_id % 4 AS module, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events)
"""


def _spine(labels, counts: str) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"SELECT slot::BIGINT AS slot, label, coalesce(n, 0)::BIGINT AS n FROM (VALUES {values}) AS s(slot, label) LEFT JOIN ({counts}) USING (label)"


AWARD = ["<100K", "100K-500K", "500K-1M", "1M-5M", ">5M"]
AWARD_CASE = "CASE WHEN c < 100000 THEN '<100K' WHEN c < 500000 THEN '100K-500K' WHEN c < 1000000 THEN '500K-1M' WHEN c < 5000000 THEN '1M-5M' ELSE '>5M' END"
SIMS = ["<0.60", "0.60-0.65", "0.65-0.70", "0.70-0.75", "0.75-0.80", "0.80+"]
STOPS = "(SELECT list(w) FROM (SELECT unnest(string_split('with that this from have been they their which will also more than when some into other were after about these both such very through between during multiple several currently previously including focused focuses working worked studies studying trained training received completed joined using university maryland school medicine department division section faculty professor assistant associate adjunct fellow instructor member staff board certified interested interests interest area areas field fields include includes included focus research laboratory lab group team project projects program programs study approach approaches', ' ')) AS w))"
LONE = "(SELECT list(w) FROM (SELECT unnest(string_split('also thus role such lead leads novel known using used well with both than when where which have been they their from that this', ' ')) AS w))"
_GOOD = "NOT list_contains(b.stops, {0}) AND length({0}) >= 4"
_MAIL = "CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'closed' WHEN d = 0 THEN 'today' WHEN d <= 7 THEN 'week' WHEN d <= 30 THEN 'month' ELSE 'later' END"
_TRIM = "regexp_replace({0}, '^[ ]+|[ ]+$', '', 'g')"

ORACLE_SQL = {
    "match_keyword": PP + """, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, name) AS r FROM kwm WHERE conf >= 15 AND (len(keywords) >= 2 OR conf >= 50))
SELECT id AS grant_id, name AS faculty_name, len(keywords)::BIGINT AS n_keywords, conf AS confidence FROM k WHERE r <= 50""",
    "normalize": "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')) AS normalized FROM documents",
    "text_functions": f"""WITH b AS (SELECT conv_id, turn, role, text, {STOPS} AS stops FROM conversations)
SELECT conv_id, turn, role, md5(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')) AS normalized, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed,
  (SELECT coalesce(string_agg(w, '|' ORDER BY p), '') FROM (SELECT w, min(i) AS p FROM (SELECT unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT regexp_extract_all(lower(b.text), '[a-z]{{4,}}') AS x)) WHERE NOT list_contains(b.stops, w) GROUP BY w)) AS mined,
  'my-source-' || substr(md5('My Source|' || substr(text, 1, 20) || '|u'), 1, 12) AS key,
  (SELECT coalesce(string_agg(substr(w, 1, 1), '' ORDER BY i), '') FROM (SELECT w, row_number() OVER (ORDER BY i) AS n, i FROM (SELECT unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT string_split_regex(b.text, '[ ,]') AS x)) WHERE w <> '') WHERE n <= 2) AS initials FROM b""",
    "profile_phrases": f"""WITH b AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z0-9\\- ]', ' ', 'g')), ' +'), lambda t: length(t) >= 3) AS w, {STOPS} AS stops, {LONE} AS lone FROM conversations WHERE role = 'user'),
x AS (SELECT conv_id, turn, 1 AS k, i, w[i] AS p FROM b, unnest(range(1, len(w) + 1)) AS u(i) WHERE length(w[i]) >= 5 AND NOT list_contains(stops, w[i]) AND NOT list_contains(lone, w[i])
 UNION ALL SELECT conv_id, turn, 2, i, w[i] || ' ' || w[i + 1] FROM b, unnest(range(1, len(w))) AS u(i) WHERE {_GOOD.format('w[i]')} AND {_GOOD.format('w[i + 1]')}
 UNION ALL SELECT conv_id, turn, 3, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM b, unnest(range(1, len(w) - 1)) AS u(i) WHERE ({_GOOD.format('w[i]')})::INT + ({_GOOD.format('w[i + 1]')})::INT + ({_GOOD.format('w[i + 2]')})::INT >= 2),
d AS (SELECT conv_id, turn, p, min((k, i)) AS o FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS n FROM d)
SELECT b.conv_id, b.turn, coalesce(string_agg(p, '|' ORDER BY o), '') AS phrases FROM b LEFT JOIN (SELECT * FROM r WHERE n <= 40) r USING (conv_id, turn) GROUP BY ALL""",
    "profile_sentence": P + """, s AS (SELECT name, department, keywords[1:40] AS k FROM f)
SELECT name, md5(name || ' is a researcher in ' || department || '.' || CASE coalesce(len(k), 0) WHEN 0 THEN '' WHEN 1 THEN ' Their research focuses on ' || k[1] || '.' WHEN 2 THEN ' Their research interests include ' || k[1] || ' and ' || k[2] || '.'
  ELSE ' Their research interests include ' || array_to_string(k[1:len(k) - 1], ', ') || ', and ' || k[len(k)] || '.' END) AS profile FROM s""",
    "grant_sentence": f"WITH {GRANTS} SELECT id, md5(array_to_string(list_filter([{_TRIM.format('title')}, {_TRIM.format('agency')}, {_TRIM.format('substr(synopsis, 1, 400)')}], lambda p: p <> ''), '. ')) AS text FROM g",
    "grant_fields": f"""WITH {GRANTS}, x AS (SELECT *, datediff('day', DATE '2024-01-30', try_cast(substr(close_date, 1, 10) AS DATE))::BIGINT AS d, {_TRIM.format('lower(title)')} AS t FROM g)
SELECT id, try_cast(replace(replace(award_ceiling, '$', ''), ',', '') AS BIGINT) AS award, d AS days, CASE WHEN d IS NULL THEN 'none' WHEN d < 0 THEN 'closed' WHEN d <= 7 THEN 'critical' WHEN d <= 21 THEN 'warning' ELSE 'ok' END AS urgency, {_MAIL} AS mail,
  starts_with(t, 'the ') OR starts_with(t, 'de ') OR (title = upper(title) AND title <> lower(title) AND len(string_split_regex({_TRIM.format('title')}, '\\s+')) <= 4) AS junk, starts_with(t, 'the and') OR starts_with(t, 'en la') AS notice FROM x""",
    "idf": PI + "SELECT kw, df, floor(idf * 1e6)::BIGINT AS idf_e6 FROM idf",
    "dynamic_stops": PI + "SELECT kw FROM dyn",
    "eligible_keywords": PI.rstrip() + f",\n{ELIGIBLE} SELECT kw FROM good",
    "keyword_join": PK + "SELECT id, count(*) AS n_keywords, sum(in_title)::BIGINT AS n_title, min(kw) AS first_kw FROM gk GROUP BY id",
    "pair_scores": PP + "SELECT id, name, array_to_string(keywords, '|') AS keywords, n_matched, title_hits, score AS match_score, conf AS confidence_score FROM kwm",
    "cosine_join": PS + "SELECT id, name, floor(sim * 10000)::BIGINT AS sim_e4 FROM sem",
    "semantic_distribution": PS + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name DESC) AS n FROM sims)
SELECT id, floor(max(sim) * 10000)::BIGINT AS max_sim, floor(quantile_cont(sim, 0.95) * 10000)::BIGINT AS p95, floor(quantile_cont(sim, 0.9) * 10000)::BIGINT AS p90, floor(quantile_cont(sim, 0.5) * 10000)::BIGINT AS median, count(*) FILTER (sim >= 0.25) AS n_threshold,
 count(*) FILTER (sim >= 0.5) AS n_50, count(*) FILTER (sim >= 0.55) AS n_55, count(*) FILTER (sim >= 0.6) AS n_60, count(*) FILTER (sim >= 0.65) AS n_65, string_agg(name, '|' ORDER BY n) FILTER (n <= 5) AS top FROM r GROUP BY id""",
    "merge_full_outer": PA + """, j AS (SELECT coalesce(kwm.id, sem.id) AS id, CASE WHEN kwm.id IS NOT NULL AND sem.id IS NOT NULL THEN 'both' WHEN kwm.id IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS match_type, kwc, sim, score FROM kwm FULL JOIN sem ON kwm.id = sem.id AND kwm.name = sem.name)
SELECT match_type, count(*) AS n, sum(least(round_even(CASE match_type WHEN 'both' THEN greatest(kwc, sim) * 1.15 WHEN 'keyword' THEN kwc ELSE sim * 0.85 END * 100, 0), 99))::BIGINT AS conf, sum(coalesce(score, 0))::BIGINT AS score FROM j GROUP BY 1""",
    "match_table": PM + "SELECT pos, grant_id, faculty_name, faculty_department, match_type, match_score::BIGINT AS match_score, conf AS confidence_score, array_to_string(keywords, '|') AS keywords, floor(sim * 10000)::BIGINT AS sim_e4 FROM m",
    "top_k_per_grant": PM + "SELECT grant_id, count(*) AS n, min(conf) AS min_conf, max(conf) AS max_conf FROM m GROUP BY 1",
    "relevance": f"""WITH {GRANTS}, x AS (SELECT id, number, lower(agency) AS a, lower(title) AS t, len(regexp_extract_all(lower(title) || ' ' || searchable_text, '\\b({VOCAB})\\b')) AS hits FROM g),
y AS (SELECT *, list_filter([{_list(BLOCK)}], lambda z: contains(a, z) OR contains(t, z))[1] AS b, list_filter([{_list(ALLOW)}], lambda z: contains(a, z))[1] AS w FROM x)
SELECT id, b IS NULL AND (w IS NOT NULL OR starts_with(number, '93.') OR hits >= 3) AS is_relevant,
 CASE WHEN b IS NOT NULL THEN 'blocked: ' || b WHEN w IS NOT NULL THEN 'allowed: ' || w WHEN starts_with(number, '93.') THEN 'number: ' || number WHEN hits >= 3 THEN 'vocabulary: ' || hits ELSE 'nothing relevant' END AS reason FROM y""",
    "purge_recount": PM + "SELECT count(*) AS total, count(DISTINCT grant_id) AS grants, count(DISTINCT faculty_name) AS faculty, count(*) FILTER (match_type = 'keyword') AS keyword, count(*) FILTER (match_type = 'semantic') AS semantic FROM m WHERE link NOT LIKE '%7'",
    "unseen_items": "SELECT source, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1",
    "unique_profiles": """WITH p AS (SELECT DISTINCT conv_id AS pos, 'n-' || conv_id % 40 AS name, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'm' || conv_id % 25 || '@x.org' END AS email FROM conversations WHERE role = 'user'),
e AS (SELECT * FROM p WHERE email <> '' QUALIFY row_number() OVER (PARTITION BY email ORDER BY pos) = 1), n AS (SELECT * FROM p WHERE email = '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos) = 1)
SELECT * FROM e UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = n.name AND e.pos < n.pos)""",
    "inactive_profiles": """WITH p AS (SELECT DISTINCT conv_id AS pos, 'fac-' || conv_id AS name, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'fac' || conv_id || '@example.org' END AS email FROM conversations WHERE role = 'user'),
b AS (SELECT * FROM p WHERE pos % 5 <> 0), c AS (SELECT pos, CASE WHEN pos % 4 = 1 THEN name || '-new' ELSE name END AS name, email FROM p WHERE pos % 3 <> 0)
SELECT *, false AS inactive, NULL::VARCHAR AS inactive_since FROM c UNION ALL SELECT *, true, '2024-01-30' FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.name = b.name OR (c.email <> '' AND c.email = b.email))""",
    "source_health": """WITH r AS (SELECT (user_id % 50)::VARCHAR AS source, ts::DATE::VARCHAR AS run, CASE WHEN count(*) FILTER (event_type = 'error') > 3 THEN -1 ELSE count(*) FILTER (event_type = 'purchase') END AS found FROM events GROUP BY 1, 2),
h AS (SELECT source, max(run) FILTER (found > 0) AS last_success, sum(found)::BIGINT AS total_found FROM r WHERE found >= 0 GROUP BY 1)
SELECT h.source, count(r.run)::BIGINT AS consecutive_zeros, last_success, total_found, count(r.run) >= 3 AS alert FROM h LEFT JOIN (SELECT * FROM r WHERE found >= 0) r ON r.source = h.source AND (last_success IS NULL OR run > last_success) GROUP BY h.source, last_success, total_found""",
    "coverage": P + "SELECT count(*) AS total, count(*) FILTER (n_kw > 0) AS with_keywords, count(*) FILTER (embedding IS NOT NULL) AS with_embeddings, round(count(*) FILTER (n_kw > 0) / count(*) * 100, 1) AS keyword_pct, round(count(*) FILTER (embedding IS NOT NULL) / count(*) * 100, 1) AS embedding_pct FROM f",
    "type_breakdown": PM + "SELECT count(*) FILTER (match_type = 'keyword') AS keyword_matches, count(*) FILTER (match_type = 'semantic') AS semantic_matches, 0::BIGINT AS both_matches FROM m",
    "type_share": PM + "SELECT count(*) FILTER (match_type = 'keyword') AS keyword, count(*) FILTER (match_type = 'semantic') AS semantic, 0::BIGINT AS both FROM m",
    "daily_trend": PM + "SELECT d.day, count(*) FILTER (match_type = 'keyword') AS keyword, count(*) FILTER (match_type = 'semantic') AS semantic, 0::BIGINT AS both FROM (SELECT strftime(DATE '2024-01-17' + i::INT, '%Y-%m-%d') AS day FROM range(14) AS t(i)) d LEFT JOIN m ON substr(timestamp, 1, 10) = d.day GROUP BY 1",
    "event_trend": "SELECT d.day, count(*) FILTER (event_type = 'click') AS keyword, count(*) FILTER (event_type = 'view') AS semantic, count(*) FILTER (event_type = 'purchase') AS both FROM (SELECT DATE '2024-01-17' + i::INT AS dd, strftime(DATE '2024-01-17' + i::INT, '%Y-%m-%d') AS day FROM range(14) AS t(i)) d LEFT JOIN events ON ts::DATE = dd GROUP BY 1",
    "top_agencies": PM + "SELECT agency, n FROM (SELECT grant_agency AS agency, count(*) AS n, min(pos) AS p FROM m GROUP BY 1 ORDER BY n DESC, p LIMIT 8)",
    "department_coverage": P + "SELECT department AS dept, count(*) AS total, count(*) FILTER (n_kw > 0) AS with_kw, round_even(count(*) FILTER (n_kw > 0) / count(*) * 100, 0)::BIGINT AS pct FROM f GROUP BY 1 ORDER BY total DESC, dept LIMIT 15",
    "award_buckets": PM + _spine(AWARD, f"SELECT {AWARD_CASE} AS label, count(*) AS n FROM (SELECT try_cast(replace(replace(award_ceiling, '$', ''), ',', '') AS BIGINT) AS c FROM m) WHERE c > 0 GROUP BY 1"),
    "order_award_buckets": _spine(AWARD, f"SELECT {AWARD_CASE} AS label, count(*) AS n FROM (SELECT floor(o_totalprice)::BIGINT AS c FROM orders) WHERE c > 0 GROUP BY 1"),
    "top_faculty": PM + "SELECT name, n FROM (SELECT faculty_name AS name, count(*) AS n, min(pos) AS p FROM m GROUP BY 1 ORDER BY n DESC, p LIMIT 15)",
    "top_departments": PM + "SELECT dept, n FROM (SELECT faculty_department AS dept, count(*) AS n, min(pos) AS p FROM m GROUP BY 1 ORDER BY n DESC, p LIMIT 10)",
    "top_keywords": PM + "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM m) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20",
    "source_breakdown": P + "SELECT source, count(*) AS n FROM (SELECT unnest(CASE src WHEN 0 THEN ['Profile page', 'PubMed'] WHEN 1 THEN ['PubMed'] ELSE [] END) AS source FROM f) GROUP BY 1",
    "department_keywords": P + "SELECT department AS dept, round(sum(n_kw) / count(*), 1) AS avg_keywords, count(*) AS faculty_count FROM f GROUP BY 1 ORDER BY avg_keywords DESC, dept LIMIT 12",
    "confidence_deciles": PM + _spine([f"{i}-{i + 9}" for i in range(0, 100, 10)], "SELECT b || '-' || b + 9 AS label, count(*) AS n FROM (SELECT least(conf, 99) // 10 * 10 AS b FROM m) GROUP BY 1"),
    "similarity_buckets": PM + _spine(SIMS, "SELECT CASE WHEN sim < 0.6 THEN '<0.60' WHEN sim < 0.65 THEN '0.60-0.65' WHEN sim < 0.7 THEN '0.65-0.70' WHEN sim < 0.75 THEN '0.70-0.75' WHEN sim < 0.8 THEN '0.75-0.80' ELSE '0.80+' END AS label, count(*) AS n FROM m WHERE match_type = 'semantic' GROUP BY 1"),
    "upcoming_deadlines": PM + """, u AS (SELECT grant_id, substr(any_value(grant_title), 1, 60) AS title, any_value(grant_agency) AS agency, any_value(close_date) AS close_date, datediff('day', DATE '2024-01-30', try_cast(any_value(close_date) AS DATE))::BIGINT AS days_left, count(*) AS faculty_count FROM m GROUP BY 1)
SELECT * FROM u WHERE days_left BETWEEN -7 AND 90 ORDER BY days_left, grant_id LIMIT 10""",
    "grant_rollup": PM + """SELECT grant_id, any_value(grant_agency) AS grant_agency, any_value(timestamp) AS first_seen, array_to_string(list_sort(list(DISTINCT match_type)), '|') AS types, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), '|') AS keywords, max(match_score)::BIGINT AS max_score,
 count(*) AS faculty_count, datediff('day', DATE '2024-01-30', try_cast(any_value(close_date) AS DATE))::BIGINT AS days_until_close, coalesce(try_cast(replace(any_value(award_ceiling), '$', '') AS BIGINT), 0) AS award_int, max(conf) AS confidence, arg_min(faculty_name, pos) AS first_faculty FROM m GROUP BY grant_id""",
    "grants_page": PM + """, r AS (SELECT grant_id, max(conf) AS confidence, count(*) AS faculty_count, bool_or(contains(lower(grant_title), 'the') OR contains(lower(grant_agency), 'the') OR contains(faculty_name, 'the') OR contains('|' || array_to_string(keywords, '|'), 'the')) AS hit, any_value(grant_agency) AS a FROM m GROUP BY 1)
SELECT grant_id, confidence, faculty_count FROM r WHERE hit AND contains(a, 'src1') ORDER BY confidence DESC, grant_id LIMIT 5 OFFSET 5""",
    "faculty_page": PM + "SELECT f.name, count(m.pos) AS match_count FROM f LEFT JOIN m ON m.faculty_name = f.name GROUP BY 1 ORDER BY match_count DESC, name LIMIT 10",
    "faculty_detail": PM + "SELECT pos, grant_id FROM m WHERE faculty_name = 'fac-3' ORDER BY pos LIMIT 20",
    "filter_matches": PM + "SELECT pos, grant_id, faculty_name FROM m WHERE match_type = 'keyword' AND contains(grant_agency, 'src1') AND (contains(lower(grant_title), 'the') OR contains(faculty_name, 'the') OR contains('|' || array_to_string(keywords, '|'), 'the'))",
    "keyword_detail": PM + """, k AS (SELECT unnest(keywords) AS keyword, grant_id, faculty_name, faculty_department AS dept, pos FROM m), w AS (SELECT keyword, count(DISTINCT grant_id) AS grant_count, count(DISTINCT faculty_name) AS faculty_count FROM k GROUP BY 1),
o AS (SELECT keyword, dept, count(*) AS n, min(pos) AS p FROM k GROUP BY 1, 2), t AS (SELECT keyword, arg_min(dept, (-n, p)) AS top_dept FROM o GROUP BY 1) SELECT * FROM w JOIN t USING (keyword) ORDER BY grant_count DESC, keyword LIMIT 30""",
    "keyword_count_histogram": P + _spine(["0", "1-10", "11-25", "26-50", "51-100", "100+"], "SELECT CASE WHEN n_kw < 1 THEN '0' WHEN n_kw <= 10 THEN '1-10' WHEN n_kw <= 25 THEN '11-25' WHEN n_kw <= 50 THEN '26-50' WHEN n_kw <= 100 THEN '51-100' ELSE '100+' END AS label, count(*) AS n FROM f GROUP BY 1"),
    "department_leaderboard": PM + "SELECT faculty_department AS dept, count(*) AS total_matches, count(DISTINCT grant_id) AS unique_grants, count(DISTINCT faculty_name) AS unique_faculty, round(sum(match_score) / count(*), 1) AS avg_score, count(*) FILTER (match_type = 'semantic') AS sem_matches, round_even(count(*) FILTER (match_type = 'semantic') / count(*) * 100, 0)::BIGINT AS sem_pct FROM m GROUP BY 1 ORDER BY total_matches DESC, dept LIMIT 20",
    "confidence_quintiles": PM + _spine(["0-20", "20-40", "40-60", "60-80", "80-100"], "SELECT CASE WHEN c < 20 THEN '0-20' WHEN c < 40 THEN '20-40' WHEN c < 60 THEN '40-60' WHEN c < 80 THEN '60-80' ELSE '80-100' END AS label, count(*) AS n FROM (SELECT round_even(CASE match_type WHEN 'semantic' THEN sim * 100 ELSE conf END, 0) AS c FROM m) GROUP BY 1"),
    "digest": PM + "SELECT grant_id, max(conf) AS best, count(*) AS n, any_value(grant_agency) AS agency, CASE WHEN max(conf) >= 60 THEN 'high' WHEN max(conf) >= 35 THEN 'medium' ELSE 'low' END AS band FROM m GROUP BY 1",
    "digest_agencies": PM + "SELECT grant_agency, count(DISTINCT grant_id) AS n FROM m GROUP BY 1 ORDER BY n DESC, grant_agency LIMIT 4",
    "export_matches": PM + "SELECT m.timestamp, grant_id, grant_title, grant_agency, g.number AS grant_number, m.link AS grant_link, m.close_date AS grant_close_date, m.award_ceiling AS grant_award_ceiling, faculty_name, faculty_department, f.email AS faculty_email, array_to_string(m.keywords, '; ') AS matched_keywords, match_type, match_score::BIGINT AS match_score, conf AS confidence_score FROM m JOIN g ON g.id = m.grant_id JOIN f ON f.name = faculty_name WHERE contains(lower(grant_title), 'fac-1') OR contains(faculty_name, 'fac-1')",
    "export_faculty": PM + ", c AS (SELECT faculty_name AS name, count(*) AS n FROM m GROUP BY 1) SELECT f.name, f.department, f.email, 'https://people.example.org/' || f.conv_id AS url, n_kw::BIGINT AS keyword_count, CASE src WHEN 0 THEN 'Profile page; PubMed' WHEN 1 THEN 'PubMed' ELSE '' END AS sources, coalesce(c.n, 0) AS match_count, coalesce(array_to_string(keywords[1:20], '; '), '') AS keywords FROM f LEFT JOIN c USING (name)",
    "customer_page": "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40",
    "confidence_histogram": PM + "SELECT match_type, " + ", ".join(f"count(*) FILTER (conf >= {x}) AS ge_{x}" for x in (20, 25, 30, 35, 40, 45, 50, 60, 70, 80)) + ", round(avg(conf), 1) AS mean FROM m GROUP BY 1",
    "position_stats": PM + ", s AS (SELECT match_type, list(conf ORDER BY conf) AS v, count(*) AS n FROM m GROUP BY 1) SELECT match_type, n AS count, v[1] AS min, v[n] AS max, list_sum(v) / n AS mean, v[n // 4 + 1] AS p25, v[n // 2 + 1] AS p50, v[3 * n // 4 + 1] AS p75 FROM s",
    "matches_per_faculty": PM + "SELECT c // 5 * 5 || '-' || c // 5 * 5 + 4 AS bucket, count(*) AS n FROM (SELECT faculty_name, count(*) AS c FROM m GROUP BY 1) GROUP BY 1",
    "keyword_frequency": PM + "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM m) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 30",
    "violations": PM + "SELECT count(*) FILTER (sim < 0.72) AS below_semantic, count(*) FILTER (conf < 0.65) AS below_confidence FROM m",
    "diagnostics_overview": PM + "SELECT count(*) AS total_matches, count(DISTINCT faculty_name) AS unique_faculty, count(DISTINCT grant_id) AS unique_grants, count(*) FILTER (regexp_matches(grant_title, '(?i)\\b(home|menu|navigation|search results|page \\d|login|sign in|about us|contact)\\b')) AS suspicious FROM m",
    "breakdown_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "stale_embeddings": P + "SELECT count(*) FILTER (embedding IS NULL OR version <> 5) AS stale, count(*) AS total FROM f",
    "log_parsed": LOGS + "SELECT level, module, count(*) AS n FROM l GROUP BY 1, 2",
    "log_metrics": LOGS + "SELECT 'total_faculty_processed' AS metric, arg_max(user_id, line_no) AS value FROM l WHERE event_type = 'signup' UNION ALL SELECT 'total_matches_raw', arg_max(user_id, line_no) FROM l WHERE event_type NOT IN ('signup', 'error')",
    "drop_reasons": LOGS + "SELECT 'reason ' || user_id % 7 AS reason, count(*) AS n FROM l WHERE event_type = 'error' GROUP BY 1",
    "filter_logs": LOGS + "SELECT line_no, stamp || ' [ERROR] ' || module || ': dropped: reason ' || user_id % 7 AS value FROM l WHERE level = 'ERROR' AND module = 'mod1' ORDER BY line_no DESC LIMIT 200",
    "pass_status": LOGS + "SELECT i AS pass, coalesce(max('complete') FILTER (event_type = 'signup'), 'unknown') AS status FROM range(1, 8) AS t(i) LEFT JOIN l ON event_type = 'signup' AND line_no % 9 = i GROUP BY 1",
}
_SCREEN = ORACLE_SQL["relevance"].replace("SELECT id, b IS NULL", ", z AS (SELECT id, t, b IS NULL") + ")"
ORACLE_SQL["screening_counts"] = _SCREEN + " SELECT count(*) AS n_grants, count(*) FILTER (NOT is_relevant) AS skipped_irrelevant, 0::BIGINT AS skipped_admin FROM z"
