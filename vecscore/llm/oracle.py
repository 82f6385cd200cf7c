"""The operators' results as plain SQL over the test tables (for DuckDB), where SQL can say them."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
PLAIN = r"'[^\x20\x09-\x0D]+'"


def split(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {pattern})"


OP1 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {split(LOW.format("text"), ALNUM)} AS w FROM documents),
i AS (SELECT item_id, {split(LOW.format("text"), ALNUM)} AS w FROM benchmark),
iw AS (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda p: w[p:p + 9])) AS win FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, p, w[p:p + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT DISTINCT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP2 = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substring(t, 2 * p - 1, 400)) AS h FROM (SELECT doc_id, t, unnest(range(1, n - 198)) AS p FROM d WHERE n >= 200)),
r AS MATERIALIZED (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
f AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM f),
i AS MATERIALIZED (SELECT doc_id, min(p) AS s, max(p) + 199 AS e FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s + 1) AS BIGINT) AS n_removed, max(e) AS last FROM i GROUP BY doc_id),
b AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a FROM i),
k AS (SELECT doc_id, string_agg(substring(t, 2 * a + 1, 2 * (s - a - 1)), '' ORDER BY s) AS kept FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(t, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP5 = f"""WITH d AS MATERIALIZED (SELECT doc_id, l, list_transform(l, lambda x: len({split(LOW.format("x"), ALNUM)})) AS c FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents)),
w AS MATERIALIZED (SELECT doc_id, p, 3 AS n, l[p:p + 2] AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3) WHERE l[p] <> '' OR l[p + 1] <> '' OR l[p + 2] <> ''
 UNION ALL SELECT doc_id, p, 2, l[p:p + 1] FROM (SELECT doc_id, l, c, unnest(range(1, len(l))) AS p FROM d WHERE len(l) >= 2) WHERE c[p] > 0 AND c[p + 1] > 0 AND c[p] + c[p + 1] >= 40
 UNION ALL SELECT doc_id, p, 1, l[p:p] FROM (SELECT doc_id, l, c, unnest(range(1, len(l) + 1)) AS p FROM d) WHERE c[p] >= 40),
x AS (SELECT doc_id, p, n FROM w QUALIFY row_number() OVER (PARTITION BY n, win ORDER BY doc_id, p) > 1),
g AS MATERIALIZED (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM x) GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
 sha256(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda q: NOT coalesce(list_contains(gone, q), false)), lambda q: l[q]), chr(10))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

OP8 = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {split("text", PLAIN)} AS w FROM documents),
v AS (SELECT doc_id, p, w[p:p + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, p FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY doc_id),
b AS (SELECT d.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
e AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND word_chars <= 25 * greatest(n_words, 1) AND 10 * n_symbols <= 3 * n_words AND 10 * n_dup_lines <= 3 * len(string_split(t, chr(10))) AND regexp_matches(t, '\\p{{L}}') AS kept FROM e"""

OP9 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {split(LOW.format("text"), PLAIN)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_repeats": OP2, "op5_lines": OP5, "op8_quality": OP8, "op9_near_duplicates": OP9}
