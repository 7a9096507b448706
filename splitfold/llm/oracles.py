"""DuckDB SQL for the results of the operators' queries, where SQL can say them."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text, A-Z in lower case.
LOWER_WORDS = f"regexp_extract_all(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def similar_sets(sets: str, key: str) -> str:
    """CTEs that end in pairs(a, b, na, nb, both): sets (key, n, elements) of Jaccard similarity 0.8 or more, by rare first elements."""
    return f"""
    elements AS (SELECT {key} AS k, n, unnest(elements) AS e FROM {sets}),
    counted AS (SELECT e, count(*) AS df FROM elements GROUP BY e),
    placed AS (SELECT k, n, e, row_number() OVER (PARTITION BY k ORDER BY df, e) AS pos FROM elements JOIN counted USING (e)),
    prefix AS (SELECT * FROM placed WHERE pos <= n - (80 * n + 99) // 100 + 1),
    met AS (SELECT DISTINCT x.k AS a, y.k AS b FROM prefix x JOIN prefix y ON x.e = y.e AND x.k < y.k AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
    sized AS (SELECT a, b, len(list_intersect(x.elements, y.elements)) AS both_n, x.n + y.n AS n FROM met JOIN {sets} x ON x.{key} = a JOIN {sets} y ON y.{key} = b),
    pairs AS (SELECT a, b FROM sized WHERE 100 * both_n >= 80 * (n - both_n))"""


#: The smallest k reachable from each k of nodes(k) over pairs(a, b).
COMPONENTS = """
    links AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
    reached(k, r) AS (SELECT k, k FROM nodes UNION SELECT links.y, reached.r FROM reached JOIN links ON links.x = reached.k WHERE reached.r < links.y),
    component AS (SELECT k, min(r) AS c FROM reached GROUP BY k)"""

OP2 = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
    lines AS (SELECT doc_id, line, list_sort(list_distinct({LOWER_WORDS.format('l')})) AS elements FROM raw),
    worded AS (SELECT * FROM lines WHERE len(elements) > 0),
    first AS (SELECT elements, min((doc_id, line)) AS place FROM worded GROUP BY elements),
    classes AS (SELECT elements, place, len(elements) AS n, row_number() OVER (ORDER BY place) AS k FROM first),
    {similar_sets('classes', 'k')},
    gone AS (SELECT DISTINCT b AS k FROM pairs),
    state AS (SELECT classes.elements, place, gone.k IS NOT NULL AS gone FROM classes LEFT JOIN gone USING (k)),
    marked AS (SELECT doc_id, gone OR (doc_id, line) > place AS r FROM worded JOIN state USING (elements)),
    counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r) AS n_removed FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN counts USING (doc_id)"""

OP1 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {LOWER_WORDS.format('text')} AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS elements FROM words),
    docs AS (SELECT doc_id, elements, len(elements) AS n FROM sets),
    {similar_sets('docs', 'doc_id')},
    nodes AS (SELECT doc_id AS k FROM documents),
    {COMPONENTS}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM docs JOIN component ON k = doc_id"""

OP3 = f"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) > 8),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 7]) AS n FROM places),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(8) AS r(k) WHERE n > 1 GROUP BY doc_id),
    raw AS (SELECT doc_id, source, unnest(ls) AS l FROM split),
    lines AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(l), '\\p{{N}}', '0', 'g'), '[^\\p{{L}}0]+', ' ', 'g')) AS line, sum(len(regexp_extract_all(l, '{WORD}'))) AS n FROM raw GROUP BY ALL),
    held AS (SELECT doc_id, source, line, sum(n) AS n FROM lines GROUP BY ALL),
    frequent AS (SELECT doc_id, n, count(*) OVER (PARTITION BY source, line) > 100 AS over FROM held),
    removed AS (SELECT doc_id, sum(n) AS line_words, coalesce(sum(n) FILTER (over), 0) AS n_removed_words FROM frequent GROUP BY doc_id),
    base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(line_words, 0) AS line_words, coalesce(n_removed_words, 0) AS n_removed_words
        FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 2 * n_removed_words <= line_words AS kept, CAST(n_removed_words AS BIGINT) AS n_removed_words
FROM judged"""

OP5 = f"""
WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    sized AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM usable),
    vectors AS (SELECT * FROM sized WHERE size > 0 AND isfinite(size)),
    pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
        WHERE list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.98),
    nodes AS (SELECT vec_id AS k FROM embeddings),
    {COMPONENTS},
    counts AS (SELECT x AS k, count(*) AS n_links FROM links GROUP BY x)
SELECT k AS vec_id, coalesce(n_links, 0) AS n_links, c AS component_id, k = c AS kept FROM component LEFT JOIN counts USING (k)"""


def spans_of(kind: str, rank: int, pattern: str, fits: str) -> str:
    """CTE of a kind's spans: the matches (m) that fit, with their places, which follow from the lengths of gaps and matches."""
    return f"""
    {kind}_parts AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g[1:len(m)]) AS g FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts)),
    {kind}_places AS (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {kind}_parts),
    {kind}_spans AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {kind}_places WHERE {fits})"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST({DIGITS}[i] AS INT)
        ELSE CAST({DIGITS}[i] AS INT) * 2 - CASE WHEN CAST({DIGITS}[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
OP6_BASE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    {spans_of('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')},
    {spans_of('ip', 1, r'[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])'))) = 0")},
    {spans_of('card', 2, r'[0-9](?:[\x20-]?[0-9])+', LUHN)},
    {spans_of('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', f'length({DIGITS}) BETWEEN 9 AND 15')},
    spans AS (SELECT * FROM email_spans UNION ALL SELECT * FROM ip_spans UNION ALL SELECT * FROM card_spans UNION ALL SELECT * FROM phone_spans),
    joined AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM documents LEFT JOIN joined USING (doc_id)"""

OP7_TARGETS = f"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes GROUP BY source),
    capped AS (SELECT *, source_size / weight AS r FROM sources),
    levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS level
        FROM capped WINDOW before AS (ORDER BY r, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    free AS (SELECT min((r, coalesce('=' || source, ''), level)) FILTER (level * weight <= 3 * source_size) AS f FROM levels)
SELECT doc_id, size, source_size, CAST(coalesce(CASE WHEN level * weight <= 3 * source_size THEN f[3] * weight ELSE 3 * source_size END, 0) AS DOUBLE) AS target
FROM sizes JOIN levels ON sizes.source IS NOT DISTINCT FROM levels.source, free"""

SQL = {"op1_minhash_dedup": OP1, "op2_line_dedup": OP2, "op3_quality_rules": OP3, "op5_embedding_dedup": OP5, "op6_base_spans": OP6_BASE, "op7_targets": OP7_TARGETS}
