"""DuckDB SQL for the queries that SQL can express."""

from rolelens.llm.url_filter import CATEGORIES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

_OP2 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS body,
             replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_BLANK_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP4 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.low FROM r JOIN e ON r.id = e.x WHERE r.low < e.y),
m AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n USING (doc_id)
"""


def _shrink(name: str, child: str, parent: str, key: str, columns: str) -> str:
    """One level of the beta-binomial shrinkage: CTE ``name`` with a posterior a, b per row of ``child``."""
    return f"""
{name}_j AS (SELECT c.*, p.a / (p.a + p.b) AS m FROM {child} c JOIN {parent} p USING ({key})),
{name}_s AS (SELECT 1 / least(greatest(coalesce(
       sum(CASE WHEN m * (1 - m) > 0 THEN (good - n * m) ** 2 / (n * m * (1 - m)) - 1 END)
       / nullif(sum(n - 1), 0), 0.001), 0.001), 0.5) - 1 AS s FROM {name}_j),
{name} AS (SELECT {columns}, m * s + good AS a, (1 - m) * s + n - good AS b FROM {name}_j, {name}_s)"""


def _labels(host: str, n: int) -> str:
    """The last ``n`` labels of a host: 1 its suffix, 2 its domain; one more below a country's categories."""
    bare = rf"regexp_replace({host}, '\.?(:[0-9]*)?\z', '')"
    category = rf"regexp_matches({bare}, '(^|\.)({'|'.join(CATEGORIES)})\.[a-z][a-z]\z')"
    return (
        rf"CASE WHEN regexp_matches({bare}, '^[0-9]+(\.[0-9]+){{3}}\z') OR starts_with({bare}, '[') THEN {bare}"
        f" ELSE array_to_string(string_split({bare}, '.')[CASE WHEN {category} THEN -{n + 1} ELSE -{n} END:], '.') END"
    )


_OP7 = rf"""
WITH u AS (SELECT page_id,
       translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT host, count(*) AS n, CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS good
      FROM u JOIN labels ON labels.doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
h AS (SELECT host, {_labels("host", 2)} AS domain, {_labels("host", 1)} AS suffix, n, good FROM o),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
x AS (SELECT suffix, '' AS root, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
al AS (SELECT '' AS root, coalesce(sum(good), 0) + 1.0 AS a, coalesce(sum(n) - sum(good), 0) + 1.0 AS b FROM h),
{_shrink("ps", "x", "al", "root", "suffix")},
{_shrink("pd", "d", "ps", "suffix", "domain")},
{_shrink("ph", "(SELECT host, domain, n, good FROM h)", "pd", "domain", "host")},
n AS (SELECT 'host' AS level, host AS name, a, b FROM ph UNION ALL SELECT 'domain', domain, a, b FROM pd
      UNION ALL SELECT 'suffix', suffix, a, b FROM ps UNION ALL SELECT 'all', root, a, b FROM al),
v AS (SELECT level, name, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) < 0.5 AS blocked FROM n),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'),
                         ('org/fr/', 'allow')),
r AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT DISTINCT host, path FROM u) JOIN rules
        ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
       AND starts_with(path, substr(rule, strpos(rule, '/'))) JOIN u USING (host, path) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, CASE WHEN coalesce(vh.blocked, vd.blocked, vs.blocked, va.blocked)
       THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN (SELECT DISTINCT host, path, rule, verdict FROM r) r USING (host, path)
LEFT JOIN v vh ON vh.level = 'host' AND vh.name = u.host
LEFT JOIN v vd ON vd.level = 'domain' AND vd.name = {_labels("u.host", 2)}
LEFT JOIN v vs ON vs.level = 'suffix' AND vs.name = {_labels("u.host", 1)}
LEFT JOIN v va ON va.level = 'all'
"""

_OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
z AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS weight
       FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), z),
m AS (SELECT rid, doc_id, 75 + (25 * len(w) * big_n) // big_l AS m FROM d, z WHERE len(w) > 0),
s AS (SELECT item_id, rid, CAST(sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM tf JOIN q USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


ORACLE: dict[str, str] = {
    "op2_chat_format": _OP2,
    "op4_minhash": _OP4,
    "op7_url_filter": _OP7,
    "op9_decontaminate": _OP9,
    "op11_ranked_search": _OP11,
}
