"""SQL of the filter interaction audit."""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (
    SELECT doc_id, part, len(words) < 200 AS "A", 100 * len(list_distinct(words)) < 50 * len(words) AS "B",
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS "C", regexp_matches(text, '[#$%&*|]') AS "D",
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS "E"
    FROM w
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
    SELECT f.part, coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad, "A"::INTEGER + 2 * "B"::INTEGER + 4 * "C"::INTEGER + 8 * "D"::INTEGER + 16 * "E"::INTEGER AS mask
    FROM f LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
    SELECT a.z || b.z || c.z || d.z || e.z AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5
), s AS (SELECT *, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
g AS (
    SELECT part, filter_order, step, n, n_good, n_bad, mask & bits[step] > 0 AS own, bit_count(mask) AS failed, mask & coalesce(list_sum(bits[:step - 1]), 0)::INTEGER > 0 AS gone
    FROM c, s
), r AS (
    SELECT part, filter_order, step, filter_order[step] AS letter,
        sum(n) FILTER (NOT gone AND NOT own) AS kept, sum(n) FILTER (NOT gone AND own) AS removed, sum(n) FILTER (gone AND own) AS redundant,
        sum(n) FILTER (own AND failed = 1) AS unique_fails, sum(n_good) FILTER (NOT gone AND own) AS good_lost, sum(n_bad) FILTER (NOT gone AND own) AS toxic_lost
    FROM g GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM r
"""
