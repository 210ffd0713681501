"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

_WORDS8 = "string_split(trim(regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"



def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT r, {rank} AS rank, '{kind}' AS kind,
           list_sum(list_transform(between[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0) AS s,
           length(found[k]) AS n
    FROM (SELECT r, string_split_regex(t, '{p}') AS between, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {group}) AS val FROM d),
         LATERAL (SELECT unnest(generate_series(1, len(found))) AS k) WHERE length(val[k]) >= {least}"""


def _secrets_sql() -> str:
    from .secretscan import ADDED, BASE

    rules = BASE + ADDED
    spans = " UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(rules))
    base = len(BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s0 AS ({spans}),
s AS (SELECT r, rank, s, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)) AS span FROM s0),
g AS (SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
             string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {base}) AS base, string_agg(span, ',' ORDER BY s, rank) AS every,
             count(*) FILTER (rank >= {base}) AS added FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(every, '') AS spans, coalesce(added, 0) AS n_added
FROM d LEFT JOIN g USING (r)
"""


ORACLE["op1_secrets"] = _secrets_sql()

ORACLE["op8_decontamination"] = f"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT r, doc_id, list_filter({_WORDS8.format(t='t')}, lambda x: x <> '') AS w FROM d0),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_WORDS8.format(t="coalesce(text, '')")}, lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, k, least(k + 9, len(w))), ' ') AS p, least(10, len(w)) AS n
        FROM i, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT d.r, s.n, k, array_to_string(list_slice(w, k, k + s.n - 1), ' ') AS p
        FROM d, sizes s, LATERAL (SELECT unnest(generate_series(1, len(d.w) - s.n + 1)) AS k) WHERE len(d.w) >= s.n),
hit AS (SELECT pos.r, pos.k, pos.n, win.item FROM pos JOIN win ON pos.p = win.p AND pos.n = win.n),
word AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(word.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""
