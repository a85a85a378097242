"""Building blocks of the comparison SQL (DuckDB)."""

PATTERN = r"(?:[\p{L}\p{M}\p{Nd}]*[\p{L}\p{M}]['’](?:(?:[\p{L}\p{M}][\p{L}\p{M}\p{Nd}]*)?[\p{L}\p{M}]['’])*[\p{L}\p{M}][\p{L}\p{M}\p{Nd}]*)|[\p{L}\p{M}\p{Nd}]+".replace("'", "''")
#: tok(doc_id, lang, t)
TOK = rf"""tok AS (SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '{PATTERN}'), lambda x: replace(x, '’', '''')),
    lambda x: length(regexp_replace(x, '[^\p{{L}}\p{{M}}]', '', 'g')) >= 2) AS t FROM documents)"""
#: occ(doc_id, lang, token), freq(lang, token, df)
FREQ = f"""{TOK}, occ AS (SELECT doc_id, lang, unnest(list_distinct(t)) AS token FROM tok), freq AS (SELECT lang, token, count(*) AS df FROM occ GROUP BY ALL)"""


def keywords(k: int) -> str:
    """... kw(lang, rank, token, df), inc(lang, doc_id, rank)"""
    return f"""{FREQ}, kw AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) - 1 AS rank, token, df FROM freq QUALIFY rank < {k}),
    inc AS (SELECT occ.lang, doc_id, rank FROM occ JOIN kw USING (lang, token))"""


def cooc(k: int) -> str:
    """... cooc(lang, i, j, n)"""
    return f"""{keywords(k)}, cooc AS (SELECT a.lang, a.rank AS i, b.rank AS j, count(*) AS n FROM inc a JOIN inc b ON a.doc_id = b.doc_id AND a.lang = b.lang AND a.rank < b.rank GROUP BY ALL)"""


def grid(k: int) -> str:
    """... jac(lang, i, j, jaccard)"""
    return f"""{cooc(k)}, jac AS (SELECT a.lang, a.rank AS i, b.rank AS j, CASE WHEN a.df + b.df - coalesce(n, 0) <> 0 THEN coalesce(n, 0) / (a.df + b.df - coalesce(n, 0)) ELSE 0.0 END AS jaccard
    FROM kw a JOIN kw b ON a.lang = b.lang AND a.rank < b.rank LEFT JOIN cooc c ON c.lang = a.lang AND c.i = a.rank AND c.j = b.rank)"""


def features(k: int) -> str:
    """... feat(lang, selected_count, incidence_count, the features) of occ(doc_id, lang, token) and docs(doc_id, lang), which come before."""
    return f"""freq AS (SELECT lang, token, count(*) AS df FROM occ GROUP BY ALL), kw AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) - 1 AS rank, token, df FROM freq QUALIFY rank < {k}),
    inc AS (SELECT occ.lang, doc_id, rank FROM occ JOIN kw USING (lang, token)), cooc AS (SELECT a.lang, a.rank AS i, b.rank AS j, count(*) AS n FROM inc a JOIN inc b ON a.doc_id = b.doc_id AND a.lang = b.lang AND a.rank < b.rank GROUP BY ALL),
    jac AS (SELECT a.lang, a.rank AS i, b.rank AS j, CASE WHEN a.df + b.df - coalesce(n, 0) <> 0 THEN coalesce(n, 0) / (a.df + b.df - coalesce(n, 0)) ELSE 0.0 END AS jaccard FROM kw a JOIN kw b ON a.lang = b.lang AND a.rank < b.rank LEFT JOIN cooc c ON c.lang = a.lang AND c.i = a.rank AND c.j = b.rank),
    near AS (SELECT lang, quantile_cont(m, 0.5) AS median_nearest_jaccard FROM (SELECT lang, i, max(jaccard) AS m FROM (SELECT lang, i, jaccard FROM jac UNION ALL SELECT lang, j, jaccard FROM jac) GROUP BY ALL) GROUP BY lang), share AS (SELECT lang, avg(CAST(jaccard >= 0.5 AS DOUBLE)) AS similar_pair_share FROM jac GROUP BY lang),
    f2 AS (SELECT lang, i, j, n FROM cooc UNION ALL SELECT lang, j, i, n FROM cooc), nm AS (SELECT lang, i, sqrt(sum(n * n)) AS norm FROM f2 GROUP BY ALL), dt AS (SELECT a.lang, a.i, b.i AS j, sum(a.n * b.n) AS dot FROM f2 a JOIN f2 b ON a.lang = b.lang AND a.j = b.j AND a.i < b.i GROUP BY ALL),
    cs AS (SELECT x.lang, quantile_cont(coalesce(dot / (mx.norm * my.norm), 0.0), 0.5) AS median_cosine FROM kw x JOIN kw y ON x.lang = y.lang AND x.rank < y.rank LEFT JOIN dt d ON d.lang = x.lang AND d.i = x.rank AND d.j = y.rank LEFT JOIN nm mx ON mx.lang = x.lang AND mx.i = x.rank LEFT JOIN nm my ON my.lang = x.lang AND my.i = y.rank GROUP BY x.lang),
    al AS (SELECT a.lang, avg(CAST(EXISTS (SELECT 1 FROM kw b WHERE b.lang = a.lang AND b.rank <> a.rank AND b.df = a.df) AS DOUBLE)) AS exact_alternative_share, avg(CAST(EXISTS (SELECT 1 FROM kw b WHERE b.lang = a.lang AND b.rank <> a.rank AND abs(b.df - a.df) <= 5) AS DOUBLE)) AS five_alternative_share, count(*) AS selected_count, stddev_pop(df) / avg(df) AS frequency_cv FROM kw a GROUP BY a.lang),
    sz AS (SELECT lang, count(*) AS docs FROM docs GROUP BY lang), ic AS (SELECT lang, count(*) AS incidence_count FROM inc GROUP BY lang),
    feat AS (SELECT lang, selected_count, incidence_count, incidence_count / (docs * selected_count) AS matrix_density, incidence_count / docs AS mean_document_length, frequency_cv, exact_alternative_share, five_alternative_share, median_nearest_jaccard, similar_pair_share, median_cosine
        FROM sz JOIN al USING (lang) JOIN ic USING (lang) JOIN near USING (lang) JOIN share USING (lang) JOIN cs USING (lang))"""
