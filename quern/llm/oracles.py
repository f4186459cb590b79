"""DuckDB SQL for the queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op2_quality_rules"] = rf"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM twice, range(0, 3) r(o)) GROUP BY doc_id
), m AS (
    SELECT b.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
           (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::BIGINT AS n_upper
    FROM base b LEFT JOIN covered c USING (doc_id)
), l AS (
    SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 4 * n_words)::INT
        + 8 * (100 * n_upper > 60 * word_chars)::INT + 16 * (100 * n_dup_lines > 50 * n_lines)::INT + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS fail_bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits FROM l
"""


_BARE = r"""list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '')"""

#: For items of five words or more, as all of the table's are.
ORACLES["op9_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_BARE} AS w FROM documents), b AS (SELECT item_id, {_BARE} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
grams AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM items GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(DISTINCT g) AS shared_shingles FROM grams JOIN items USING (g) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles::DOUBLE / item_shingles AS containment FROM hit JOIN n USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles - 1e-9
"""

ORACLES["op10_substring_dedup"] = rf"""
WITH base AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM base WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(0, 20) r(o)),
word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM base)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM base LEFT JOIN kept USING (doc_id)
"""
