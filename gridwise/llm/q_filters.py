"""Query op12: all orders of five filters, by source."""

from gridwise.llm import filteraudit
from gridwise.llm._common import table


def op12_filter_audit(spark, sf_dir):
    cells = filteraudit.mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filteraudit.audit(cells)


#: Every order is applied to every document, filter after filter.
SQL = r"""WITH w AS (SELECT *, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, coalesce(source, '') AS part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS fails FROM w LEFT JOIN said USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
    WHERE length(regexp_replace(a.f || b.f || c.f || d.f || e.f, 'A', '')) = 4 AND (a.f || b.f || c.f || d.f || e.f) LIKE '%B%' AND (a.f || b.f || c.f || d.f || e.f) LIKE '%C%'
    AND (a.f || b.f || c.f || d.f || e.f) LIKE '%D%' AND (a.f || b.f || c.f || d.f || e.f) LIKE '%E%'),
s AS (SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, f, good, toxic, fails[f] AS fails, len(list_filter(string_split(earlier, ''), lambda e: fails[e])) > 0 AS gone,
    len(list_filter(map_values(fails), lambda v: v)) AS n_fails FROM d, s),
g AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed,
    count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
    count(*) FILTER (NOT gone AND fails AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic = 1) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


def queries():
    return {"op12_filter_audit": op12_filter_audit}


def oracle_sql():
    return {"op12_filter_audit": SQL}
