"""DuckDB SQL for the queries that SQL can express."""

from . import quality


def _quality(documents="documents", columns="doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept", risk=quality.RISK, delta=quality.DELTA):
    """op2 as SQL; the rules' scores and grids are those of quality.py."""
    alpha = risk / len(quality.RULES)
    scores = ",\n".join(f"CAST({score.replace(' / ', ' * 1.0 / ')} AS DOUBLE) AS s_{r}" for r, (score, _) in quality.RULES.items())
    grid = ",\n".join(f"('{r}', CAST({c!r} AS DOUBLE))" for r, (_, g) in quality.RULES.items() for c in g)
    marks = " UNION ALL ".join(f"SELECT lang AS stratum, quality = 1 AS good, '{r}' AS rule, s_{r} AS score FROM lab" for r in quality.RULES)
    fails = " OR ".join(f"coalesce((SELECT s_{r} > cutoff FROM cut WHERE cut.stratum = b.lang AND rule = '{r}'), false)" for r in quality.RULES)
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM {documents}),
        grams AS (
            SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c >= 2),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
        lines AS (
            SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
        stats AS (
            SELECT d.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS BIGINT) AS n_marks,
                   CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
                   CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
            FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN lines ON lines.r = d.r),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {scores} FROM stats),
        lab AS (SELECT b.*, l.quality FROM b JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND lang IS NOT NULL),
        grid(rule, cutoff) AS (VALUES {grid}),
        marks AS ({marks}),
        tests AS (
            SELECT stratum, rule, cutoff, CAST(count(*) FILTER (good) AS DOUBLE) AS n, count(*) FILTER (good AND score > cutoff) AS k,
                   count(*) FILTER (NOT good AND score > cutoff) AS bad
            FROM marks JOIN grid USING (rule) GROUP BY ALL),
        tails AS (
            SELECT *, count(*) OVER () AS m,
                   CASE WHEN k > n * {alpha!r} THEN 1.0 ELSE (
                       SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r})))
                       FROM unnest(range(0, k + 1)) AS u(j)) END AS p
            FROM tests),
        cut AS (
            SELECT stratum, rule, arg_max(cutoff, bad * 1000.0 + cutoff) AS cutoff
            FROM tails WHERE p <= {delta!r} / m AND bad > 0 GROUP BY ALL),
        verdict AS (SELECT *, NOT base_failed AND NOT ({fails}) AS kept FROM b)
        SELECT {columns} FROM verdict"""


#: op2's operator with limits that tables of some hundred labels can meet, so that cutoffs are admitted and reject documents
FEW_LABELS = {"risk": 0.9, "delta": 0.9}

ORACLES = {
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
            FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) ON v = d.doc_id""",
    "op10_benchmark_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents),
        b AS (
            SELECT item_id,
                   coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM benchmark),
        bw AS (
            SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
            FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
        dw AS (
            SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
        m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op2_quality_rules": _quality(),
    "quality_rules_of_few_labels": _quality(risk=FEW_LABELS["risk"], delta=FEW_LABELS["delta"]),
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] AS chunk FROM l, unnest(range(1, len(l))) AS u(i)),
        k AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY chunk) AS keeper FROM w WHERE regexp_matches(chunk, '[^\x20\x09-\x0D]')),
        r AS (SELECT doc_id, i FROM k WHERE keeper <> (doc_id, i) AND NOT (keeper[1] = doc_id AND i < keeper[2] + 2)),
        runs AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) WHERE before IS NULL OR i > before + 2 GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM r),
        n AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(array_to_string([l.l[j] FOR j IN range(1, len(l.l) + 1) IF NOT list_contains(n.gone, j)], chr(10)), '') END AS text,
               CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(runs.n, 0) AS BIGINT) AS n_removed_chunks
        FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op5_warc": r"""
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS last FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN CAST(last AS BIGINT) END AS refers_to FROM r""",
}
