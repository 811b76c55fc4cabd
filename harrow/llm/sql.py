"""SQL counterparts of the queries, for the tables as they are."""

_REVIEWS = """rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC) AS nth FROM reviews) WHERE nth = 1),
tk AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)) AS terms FROM rv WHERE text IS NOT NULL),
ex AS (SELECT doc_id, unnest(terms) AS term FROM tk),
po AS (SELECT doc_id, term, count(*) AS tf FROM ex GROUP BY ALL),
di AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY term),
nn AS (SELECT count(*) AS n FROM tk)"""
_MARK = "CASE WHEN df < 3 THEN 'rare' WHEN df > 0.2 * n THEN 'common' END AS mark"

P1_TERMS = f"WITH {_REVIEWS} SELECT term, df, cf, {_MARK} FROM di, nn"
P1_FOUND = f"SELECT term, mark FROM (WITH {_REVIEWS} SELECT term, {_MARK} FROM di, nn) WHERE mark IS NOT NULL"
P1_NGRAMS = f"""WITH {_REVIEWS},
g AS (SELECT doc_id, unnest(list_transform(range(1, len(terms) - w + 2), lambda i: array_to_string(terms[i:i + w - 1], ' '))) AS ngram, w AS num_terms FROM tk, (VALUES (1), (2), (3)) v(w) WHERE len(terms) >= w),
c AS (SELECT ngram, num_terms::INTEGER AS num_terms, count(DISTINCT doc_id) AS df, count(*) AS cf FROM g GROUP BY ngram, num_terms)
SELECT ngram, num_terms, df, cf, {_MARK} FROM c, nn"""
P2_FOUND = f"""WITH {_REVIEWS}, w AS (SELECT doc_id, term, round((1 + log10(tf)) * log10(n::DOUBLE / df), 12) AS weight FROM po JOIN di USING (term), nn WHERE df >= 2)
SELECT doc_id, term FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) = 1"""
P2_WEIGHTS = f"""WITH {_REVIEWS}, l AS (SELECT doc_id, sum(tf) AS len FROM po GROUP BY doc_id), t AS (SELECT sum(cf)::DOUBLE AS total FROM di),
s AS (SELECT doc_id, term, tf, df, cf, (tf + 100.0::DOUBLE * cf / total) / (len + 100.0::DOUBLE) AS p, cf / total AS b, (1 + log10(tf)) * log10(n::DOUBLE / df) AS weight FROM po JOIN di USING (term) JOIN l USING (doc_id), t, nn WHERE df >= 2)
SELECT doc_id, term, tf, df, cf, round(p * log2(p / b), 6) AS kl, round(weight, 6) AS weight FROM s"""
P2_DISTINCTIVE = P2_WEIGHTS.rsplit("SELECT", 1)[0] + "SELECT doc_id, term, round(p * log2(p / b), 6) AS kl FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p * log2(p / b), 12) DESC, term) = 1"
_FUSED = """c AS (SELECT DISTINCT query_id, doc_id, vsm_score, lm_score FROM candidates),
rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC) AS nth FROM reviews) WHERE nth = 1),
m AS (SELECT query_id, doc_id, vsm_score, lm_score, score::DOUBLE AS score, helpfulness_num::DOUBLE AS votes,
      CASE WHEN coalesce(helpfulness_den, 0) = 0 THEN 0.5 ELSE helpfulness_num::DOUBLE / helpfulness_den END::DOUBLE AS ratio FROM c LEFT JOIN rv USING (doc_id)),
l AS (SELECT query_id, doc_id, unnest(['vsm', 'lm', 'score', 'votes', 'ratio']) AS metric, unnest([vsm_score, lm_score, score, votes, ratio]) AS v FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, metric ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, metric, v) - 1) / 2 AS place FROM l),
f AS (SELECT query_id, doc_id, round(sum(1 / (60 + place)), 12) AS fused FROM r GROUP BY ALL)"""
P3_FOUND = f"WITH {_FUSED} SELECT query_id, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) = 1"
P3_FUSED = f"WITH {_FUSED} SELECT query_id, doc_id, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM f"
P9_FOUND = """WITH d AS (SELECT lower(trim(source, ' ')) AS source, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 ]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source)
SELECT lower(trim(t.source, ' ')) AS source FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source, ' '))
WHERE coalesce(s.size, 0) * max_repeats < target_share * (SELECT sum(size) FROM d)"""
