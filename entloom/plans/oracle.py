"""DuckDB SQL for the queries, written on its own: other joins and other forms than the Spark plans."""

from __future__ import annotations

from ..operators.extract import RULES
from .queries import BORDERLINE, MERGE, SCHEMA, SWEEP_BORDERLINE, SWEEP_MERGE, TIEBREAK

_W = r"\p{L}\p{N}_"
_SPACE = r"\s\x{1c}-\x{1f}"
_TOKEN = rf"[{_W}](?:[{_W}''\-’]*[{_W}])?|[^{_SPACE}]"

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents)"
_HIT = """SELECT doc_id, '{label}' AS type, CAST({score} AS DOUBLE) AS score, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM docs WHERE regexp_matches(text, '{p}')"""
RAW = (
    DOCS
    + ",\nhits AS ("
    + " UNION ALL ".join(_HIT.format(label=r.label, score=r.score, p=r.pattern) for r in RULES)
    + """),
places AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits),
starts AS (SELECT doc_id, type, score, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM places),
raw AS (SELECT doc_id, start, CAST(start + length(text) AS INTEGER) AS "end", text, type, score, 'm_' || substr(sha1(doc_id || ':' || start || ':' || (start + length(text)) || ':regex'), 1, 10) AS id FROM starts)"""
)
MENTIONS = (
    RAW
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY score DESC, start, "end" DESC, id, text) AS rk FROM raw),
chosen(doc_id, type, rk, ok, kept) AS (
    SELECT doc_id, type, rk, true, [{'s': start, 'e': "end"}] FROM ranked WHERE rk = 1
    UNION ALL
    SELECT r.doc_id, r.type, r.rk, len(list_filter(c.kept, lambda x: x.s < r."end" AND r.start < x.e)) = 0,
        CASE WHEN len(list_filter(c.kept, lambda x: x.s < r."end" AND r.start < x.e)) = 0 THEN list_append(c.kept, {'s': r.start, 'e': r."end"}) ELSE c.kept END
    FROM chosen c JOIN ranked r ON r.doc_id = c.doc_id AND r.type = c.type AND r.rk = c.rk + 1),
mentions AS (SELECT r.* FROM ranked r JOIN chosen c USING (doc_id, type, rk) WHERE c.ok)"""
)
ENTITIES = (
    MENTIONS
    + """,
single AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY type DESC) = 1),
grouped AS (SELECT doc_id, type, lower(text) AS k, arg_min(text, start) AS canonical, count(*) AS n_mentions, min(start) AS first_start, min(score) AS least, avg(score) AS mean, list(id ORDER BY id) AS ids,
    list({'s': start, 'e': "end"} ORDER BY start) AS spans FROM single GROUP BY 1, 2, 3),
entities AS (SELECT *, 'e_' || substr(sha1(doc_id || '|' || array_to_string(ids, '|')), 1, 10) AS entity_id, 0.5 * mean + 0.5 * 0.9 AS confidence FROM grouped),
routed AS (SELECT *, CASE WHEN confidence < 0.8 THEN 'low_cluster_conf' WHEN least < 0.5 THEN 'low_span_conf' END AS reason FROM entities),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_start, entity_id) + 1 AS line, substr(entity_id, 3, 1) AS digit FROM routed)"""
)
TILES = rf"""tiles AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}|[{_SPACE}]+')) AS token, generate_subscripts(regexp_extract_all(text, '{_TOKEN}|[{_SPACE}]+'), 1) AS k FROM docs),
ends AS (SELECT doc_id, token, k, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS "end" FROM tiles),
tokens AS (SELECT doc_id, CAST("end" - length(token) AS INTEGER) AS start, "end", token FROM ends WHERE NOT regexp_matches(token, '^[{_SPACE}]'))"""


def _context(half: int, start: str = "m.start", end: str = 'm."end"', body: str = "d.text") -> str:
    lo = f"greatest({start} - {half}, 0)"
    return f"trim(replace(substring({body}, {lo} + 1, least({end} + {half}, length({body})) - {lo}), chr(10), ' '), ' ' || chr(9) || chr(13))"


def _vectors(pairs_at: float = MERGE) -> str:
    return f"""v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS doc_id, 'v' || vec_id AS entity_id, CAST(embedding AS DOUBLE[]) AS e, label, 0.8 + 0.01 * (vec_id % 10) AS confidence FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {pairs_at}),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(n, r) AS (SELECT a, a FROM edges UNION SELECT e.b, x.r FROM reach x JOIN edges e ON e.a = x.n),
roots AS (SELECT n AS vec_id, min(r) AS root FROM reach GROUP BY n)"""


RESOLVED = (
    _vectors()
    + f""",
member AS (SELECT v.*, root FROM v JOIN roots USING (vec_id)),
named AS (SELECT root, arg_max(entity_id, 1000000000 * length(entity_id) - vec_id) AS canonical, 'c_' || substr(sha1('Vector|' || arg_max(entity_id, 1000000000 * length(entity_id) - vec_id) || '|' || string_agg(doc_id, '|' ORDER BY doc_id)), 1, 10) AS cluster_id, count(*) AS n FROM member GROUP BY root),
dims AS (SELECT root, i, sum(e[i]) AS t FROM member, (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) + 1)) AS i) GROUP BY root, i),
totals AS (SELECT root, list(t ORDER BY i) AS total, greatest(sqrt(sum(t * t)), 1e-9) AS size FROM dims GROUP BY root),
clusters AS (SELECT n.*, total, list_transform(total, lambda x: x / size) AS centroid FROM named n JOIN totals USING (root)),
placed AS (SELECT v.*, root FROM v LEFT JOIN roots USING (vec_id)),
sims AS (SELECT p.vec_id, c.root AS target, c.cluster_id AS target_id, list_dot_product(p.e, c.centroid) AS s FROM placed p JOIN clusters c ON p.root IS DISTINCT FROM c.root),
near AS (SELECT vec_id, max(s) AS s1, max(s, 2)[2] AS s2, arg_max(target_id, s) AS nearest_cluster_id FROM sims GROUP BY vec_id),
inside AS (SELECT p.doc_id, p.entity_id, c.cluster_id, list_dot_product(p.e, list_transform(list_zip(c.total, p.e), lambda x: x[1] - x[2])) / greatest(sqrt(list_sum(list_transform(list_zip(c.total, p.e), lambda x: (x[1] - x[2]) ** 2))), 1e-9) AS top_similarity,
    greatest(0, coalesce(near.s1, 0)) AS second_similarity FROM placed p JOIN clusters c USING (root) LEFT JOIN near USING (vec_id)),
outside AS (SELECT p.doc_id, p.entity_id, s1, s2, nearest_cluster_id, 'c_' || substr(sha1('Vector|' || p.entity_id || '|' || p.doc_id), 1, 10) AS own_id, coalesce(s1 >= {BORDERLINE}, false) AS border, coalesce(s1 >= {TIEBREAK}, false) AS moved FROM placed p LEFT JOIN near USING (vec_id) WHERE p.root IS NULL),
plain AS (SELECT doc_id, entity_id, cluster_id FROM inside UNION ALL SELECT doc_id, entity_id, own_id FROM outside),
tagged AS (SELECT v.*, cluster_id FROM v JOIN plain USING (doc_id, entity_id))"""
)
PRF = """both_ AS (SELECT cluster_id AS s, 'g' || label AS g, vec_id FROM tagged),
pr AS (SELECT a.s = b.s AS same_s, a.g = b.g AS same_g FROM both_ a JOIN both_ b ON a.vec_id < b.vec_id),
pairwise AS (SELECT coalesce(count(*) FILTER (same_s AND same_g) / nullif(count(*) FILTER (same_s), 0), 1.0) AS p, coalesce(count(*) FILTER (same_s AND same_g) / nullif(count(*) FILTER (same_g), 0), 1.0) AS r FROM pr),
each_ AS (SELECT a.vec_id, count(*) FILTER (a.s = b.s AND a.g = b.g) AS o, count(*) FILTER (a.s = b.s) AS ns, count(*) FILTER (a.g = b.g) AS ng FROM both_ a CROSS JOIN both_ b GROUP BY 1),
bcubed AS (SELECT avg(o / ns) AS p, avg(o / ng) AS r FROM each_)"""
_F1 = "CASE WHEN {0}.p + {0}.r > 0 THEN 2 * {0}.p * {0}.r / ({0}.p + {0}.r) ELSE 0 END"


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _cent(source: str, key: str) -> str:
    return f"""SELECT cluster_id, i, avg(e[i]) AS t, count(*) AS n FROM {source}, (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) + 1)) AS i) GROUP BY {key}, i"""


_NAMES = ", ".join(f"'{t}'" for t in SCHEMA.type_names[1:])
_EDIT = "CASE WHEN digit < '4' THEN 'reject' WHEN digit < '8' THEN 'edit' WHEN digit < 'c' THEN 'keep' END"
_GRID = ", ".join(f"({m}, {b})" for m in SWEEP_MERGE for b in SWEEP_BORDERLINE if b <= m)
_MERGES = ", ".join(f"({m})" for m in SWEEP_MERGE)

SQL: dict[str, str] = {
    "extract_to_route": _with(ENTITIES, "SELECT doc_id, entity_id, type, canonical, CAST(n_mentions AS INTEGER) AS n_mentions, round(confidence, 6) AS confidence, reason FROM routed"),
    "doc_scan_sha": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(sha256(text), 1, 16) AS text_sha, CAST(length(text) AS INTEGER) AS n FROM documents",
    "safe_filename": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}\-_.]', '_', 'g') AS name FROM pages",
    "token_counts": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(regexp_extract_all(text, '{_TOKEN}')) AS INTEGER) AS n_tokens FROM documents",
    "token_offsets": _with(DOCS + ", " + TILES, "SELECT * FROM tokens"),
    "mentions_regex": _with(RAW, 'SELECT doc_id, start, "end", text, type, score FROM raw'),
    "unknown_labels": _with(RAW, "SELECT type AS label, count(*) AS n FROM raw WHERE type NOT IN ('Email', 'IPv4') GROUP BY 1"),
    "mention_ids": _with(RAW, """SELECT doc_id, start, "end", type, id, 'human_' || substr(sha1(doc_id || ':' || start || ':' || "end"), 1, 10) AS human_id FROM raw"""),
    "snap_mentions": _with(
        RAW + ", " + TILES,
        """, cut AS (SELECT doc_id, start + 1 AS s, "end" - 1 AS e, type, score FROM raw WHERE "end" - start > 3),
snapped AS (SELECT c.doc_id, c.type, c.score, c.s, c.e, coalesce(max(l.start), c.s) AS lo, coalesce(max(r."end"), c.e) AS hi, row_number() OVER () AS k FROM (SELECT *, row_number() OVER () AS rn FROM cut) c
    LEFT JOIN tokens l ON l.doc_id = c.doc_id AND l.start < c.s AND c.s < l."end" LEFT JOIN tokens r ON r.doc_id = c.doc_id AND r.start < c.e AND c.e < r."end" GROUP BY c.rn, c.doc_id, c.type, c.score, c.s, c.e)
SELECT s.doc_id, CAST(lo + length(p) - length(ltrim(p)) AS INTEGER) AS start, CAST(lo + length(p) - length(ltrim(p)) + length(trim(p)) AS INTEGER) AS "end", trim(p) AS text, type, score
FROM (SELECT s.*, substring(d.text, lo + 1, hi - lo) AS p FROM snapped s JOIN docs d USING (doc_id)) s""",
    ),
    "nms_mentions": _with(MENTIONS, 'SELECT doc_id, id, start, "end", type, score FROM mentions'),
    "multilabel_overlaps": _with(MENTIONS, """SELECT a.doc_id, a.start AS start_a, a."end" AS end_a, a.type AS type_a, b.start AS start_b, b."end" AS end_b, b.type AS type_b
FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.type < b.type AND a.start < b."end" AND b.start < a."end" """),
    "span_invariant_violations": _with(MENTIONS, 'SELECT m.doc_id, id, start, "end" FROM mentions m JOIN docs d USING (doc_id) WHERE substring(d.text, start + 1, "end" - start) <> m.text'),
    "span_invariant_violations_seeded": _with(MENTIONS, """, moved AS (SELECT doc_id, id, CAST(start + (start % 2 = 0)::INT AS INTEGER) AS start, CAST("end" + (start % 2 = 0)::INT AS INTEGER) AS "end", text AS t FROM mentions)
SELECT m.doc_id, id, start, "end" FROM moved m JOIN docs d USING (doc_id) WHERE "end" > length(d.text) OR substring(d.text, start + 1, "end" - start) <> t"""),
    "gazetteer_mentions": _with(MENTIONS + ", " + TILES, rf""", names AS (SELECT DISTINCT type AS label, text AS name, regexp_extract(text, '^(?:{_TOKEN})') AS token FROM mentions WHERE type = 'ProperName'),
spots AS (SELECT t.doc_id, t.start, CAST(t.start + length(n.name) AS INTEGER) AS "end", n.name, n.label FROM tokens t JOIN names n ON t.token = n.token)
SELECT p.doc_id, p.start, p."end", p.name AS text, p.label FROM spots p JOIN docs d USING (doc_id) SEMI JOIN tokens t ON t.doc_id = p.doc_id AND t."end" = p."end" WHERE substring(d.text, p.start + 1, length(p.name)) = p.name"""),
    "coref_entities": _with(ENTITIES, "SELECT doc_id, entity_id, type, canonical, CAST(n_mentions AS INTEGER) AS n_mentions, first_start FROM entities"),
    "coref_client": _with(ENTITIES, """SELECT doc_id, type, arg_max(text, 1000000000 * length(text) - start) AS canonical, 0.9::DOUBLE AS confidence, CAST(count(*) AS INTEGER) AS n_mentions
FROM single GROUP BY doc_id, type, lower(regexp_extract(text, '\\S+'))"""),
    "surface_canonical": _with(ENTITIES, "SELECT doc_id, entity_id, canonical AS surface_canonical FROM entities"),
    "within_doc_conf": _with(ENTITIES, "SELECT doc_id, entity_id, round(confidence, 6) AS confidence FROM entities"),
    "partition_violations": _with(ENTITIES, f""", part AS (SELECT * FROM entities WHERE type <> 'License')
SELECT DISTINCT doc_id, ids[1] AS id, 'missing' AS problem FROM part WHERE n_mentions > 1
UNION SELECT doc_id, ids[2], 'repeated' FROM part WHERE n_mentions > 1
UNION SELECT doc_id, id, 'missing' FROM single WHERE type = 'License'
UNION SELECT doc_id, type, 'type' FROM part WHERE type NOT IN ({_NAMES})"""),
    "entity_repr": _with(ENTITIES, f""", firsts AS (SELECT doc_id, entity_id, canonical, unnest(spans[1:2]) AS m, generate_subscripts(spans[1:2], 1) AS i FROM entities),
ctx AS (SELECT f.doc_id, entity_id, canonical, i, {_context(80, 'f.m.s', 'f.m.e')} AS c FROM firsts f JOIN docs d USING (doc_id))
SELECT doc_id, entity_id, canonical || coalesce(string_agg(' | ' || c, '' ORDER BY i) FILTER (c <> ''), '') AS repr FROM ctx GROUP BY doc_id, entity_id, canonical"""),
    "embedded_entities": _with(ENTITIES, f""", firsts AS (SELECT doc_id, entity_id, canonical, unnest(spans[1:2]) AS m, generate_subscripts(spans[1:2], 1) AS i FROM entities),
ctx AS (SELECT f.doc_id, entity_id, canonical, i, {_context(80, 'f.m.s', 'f.m.e')} AS c FROM firsts f JOIN docs d USING (doc_id)),
said AS (SELECT doc_id, entity_id, ' ' || lower(canonical || coalesce(string_agg(' | ' || c, '' ORDER BY i) FILTER (c <> ''), '')) || ' ' AS t FROM ctx GROUP BY doc_id, entity_id, canonical),
grams AS (SELECT doc_id, entity_id, md5(substr(t, CAST(unnest(range(1, greatest(2, length(t) - 1))) AS INTEGER), 3)) AS h FROM said),
slots AS (SELECT doc_id, entity_id, ('0x' || substr(h, 15, 2))::INTEGER % 64 AS slot, sum(CASE WHEN substr(h, 1, 1) >= '8' THEN 1 ELSE -1 END) AS x FROM grams GROUP BY 1, 2, 3)
SELECT doc_id, entity_id, 64 AS dim, CASE WHEN sum(x * x) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm2 FROM slots GROUP BY doc_id, entity_id"""),
    "context_windows": _with(MENTIONS, f'SELECT m.doc_id, m.start, m."end", m.type, {_context(60)} AS context FROM mentions m JOIN docs d USING (doc_id)'),
    "sim_pairs": _with(_vectors(), "SELECT a, b, round(s, 6) AS similarity FROM pairs"),
    "sim_pairs_blocked": _with(_vectors(0.3), "SELECT CAST(x.label AS VARCHAR) AS type, a, b, round(s, 6) AS similarity FROM pairs JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b WHERE x.label = y.label"),
    "component_roots": _with(_vectors(), "SELECT vec_id AS node, root FROM roots"),
    "cluster_ids": _with(RESOLVED, "SELECT cluster_id, canonical, n FROM clusters"),
    "singletons": _with(RESOLVED, "SELECT doc_id, entity_id, own_id AS cluster_id FROM outside"),
    "loo_margin": _with(RESOLVED, "SELECT doc_id, entity_id, cluster_id, round(top_similarity, 6) AS top_similarity, round(second_similarity, 6) AS second_similarity FROM inside"),
    "nearest_cluster": _with(RESOLVED, "SELECT doc_id, entity_id, nearest_cluster_id, round(s1, 6) AS nearest_similarity FROM outside WHERE border"),
    "tiebreak_applied": _with(RESOLVED, "SELECT doc_id, entity_id, nearest_cluster_id AS cluster_id, round(s1, 6) AS top_similarity, round(coalesce(s2, 0), 6) AS second_similarity FROM outside WHERE moved"),
    "crossdoc_conf": _with(RESOLVED, """, a AS (SELECT doc_id, entity_id, cluster_id, 1.0 AS d, top_similarity AS t, second_similarity AS s FROM inside
    UNION ALL SELECT doc_id, entity_id, CASE WHEN moved THEN nearest_cluster_id ELSE own_id END, CASE WHEN moved THEN 0.9 ELSE 1.0 END, CASE WHEN moved THEN s1 ELSE 1.0 END, CASE WHEN moved THEN coalesce(s2, 0) ELSE 0.0 END FROM outside)
SELECT doc_id, entity_id, cluster_id, round(least(1, greatest(0, 0.4 * CAST(confidence AS DOUBLE) + 0.4 * CAST(d AS DOUBLE) + 0.2 * least(1, greatest(0, t - s)))), 6) AS confidence FROM a JOIN v USING (doc_id, entity_id)"""),
    "registry": _with(RESOLVED, """SELECT cluster_id, arg_max(entity_id, 1000000000 * length(entity_id) - vec_id) AS canonical, 'Vector' AS type, string_agg(doc_id || '/' || entity_id, ',' ORDER BY vec_id) AS members FROM tagged GROUP BY cluster_id"""),
    "centroids": _with(RESOLVED, f""", c AS ({_cent('tagged', 'cluster_id')})
SELECT cluster_id, CAST(n AS INTEGER) AS size, CAST(i - 1 AS INTEGER) AS dim, round(t / greatest(sqrt(sum(t * t) OVER (PARTITION BY cluster_id)), 1e-9), 6) AS x FROM c"""),
    "centroids_updated": _with(_vectors(), f""", even AS (SELECT *, 'l' || label AS cluster_id FROM v WHERE vec_id % 2 = 0), odd AS (SELECT *, 'l' || label AS cluster_id FROM v WHERE vec_id % 2 = 1 AND label % 2 = 0),
fresh AS (SELECT *, 'new_l' || label AS cluster_id FROM v WHERE vec_id % 2 = 1 AND label % 2 = 1),
a AS ({_cent('even', 'cluster_id')}), b AS ({_cent('odd', 'cluster_id')}), f AS ({_cent('fresh', 'cluster_id')}),
a1 AS (SELECT cluster_id, i, n, t / greatest(sqrt(sum(t * t) OVER (PARTITION BY cluster_id)), 1e-9) AS t FROM a),
m AS (SELECT a1.cluster_id, a1.i, a1.n + coalesce(b.n, 0) AS n, CASE WHEN b.n IS NULL THEN a1.t ELSE (a1.t * a1.n + b.t * b.n) / (a1.n + b.n) END AS t FROM a1 LEFT JOIN b ON a1.cluster_id = b.cluster_id AND a1.i = b.i UNION ALL SELECT cluster_id, i, n, t FROM f)
SELECT cluster_id, CAST(n AS INTEGER) AS size, CAST(i - 1 AS INTEGER) AS dim, round(t / greatest(sqrt(sum(t * t) OVER (PARTITION BY cluster_id)), 1e-9), 6) AS x FROM m"""),
    "incremental_assign": _with(
        f"""v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS doc_id, 'v' || vec_id AS entity_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
even AS (SELECT * FROM v WHERE vec_id % 2 = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM even a JOIN even b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {MERGE}),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(n, r) AS (SELECT a, a FROM edges UNION SELECT d.b, x.r FROM reach x JOIN edges d ON d.a = x.n),
roots AS (SELECT n AS vec_id, min(r) AS root FROM reach GROUP BY n),
placed AS (SELECT even.*, coalesce(root, even.vec_id) AS root FROM even LEFT JOIN roots USING (vec_id)),
named AS (SELECT root, 'c_' || substr(sha1('Vector|' || arg_max(entity_id, 1000000000 * length(entity_id) - vec_id) || '|' || string_agg(doc_id, '|' ORDER BY doc_id)), 1, 10) AS cluster_id FROM placed GROUP BY root),
dims AS (SELECT root, i, avg(e[i]) AS t FROM placed, (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) + 1)) AS i) GROUP BY root, i),
olds AS (SELECT cluster_id, list(t / size ORDER BY i) AS c FROM (SELECT *, greatest(sqrt(sum(t * t) OVER (PARTITION BY root)), 1e-9) AS size FROM dims) JOIN named USING (root) GROUP BY cluster_id),
near AS (SELECT v.vec_id, max(list_dot_product(v.e, o.c)) AS s, arg_max(o.cluster_id, list_dot_product(v.e, o.c)) AS target FROM v CROSS JOIN olds o WHERE v.vec_id % 2 = 1 GROUP BY v.vec_id),
turn AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, v.*, s, target, 'c_' || substr(sha1('Vector|' || entity_id || '|' || doc_id), 1, 10) AS own FROM v JOIN near USING (vec_id)),
fold(k, pos, best, made) AS (
    SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS DOUBLE), [{{'id': 'none', 'c': [0.0::DOUBLE], 'n': 0::BIGINT}}][1:0]
    UNION ALL
    SELECT k, CASE WHEN s >= {MERGE} AND s >= best THEN -1 WHEN best >= {MERGE} THEN pos ELSE 0 END, best,
        CASE WHEN s >= {MERGE} AND s >= best THEN made WHEN best >= {MERGE} THEN
            list_transform(made, lambda x, i: CASE WHEN i = pos THEN {{'id': x.id, 'c': list_transform(x.c, lambda y, j: (y * x.n + e[j]) / (x.n + 1) / greatest(sqrt(list_sum(list_transform(x.c, lambda z, l: ((z * x.n + e[l]) / (x.n + 1)) ** 2))), 1e-9)), 'n': x.n + 1}} ELSE x END)
        ELSE list_append(made, {{'id': own, 'c': e, 'n': 1::BIGINT}}) END
    FROM (SELECT t.k, t.s, t.own, t.e, made, coalesce(list_max(list_transform(made, lambda x: list_dot_product(x.c, t.e))), -1) AS best,
        coalesce(list_position(list_transform(made, lambda x: list_dot_product(x.c, t.e)), list_max(list_transform(made, lambda x: list_dot_product(x.c, t.e)))), 0) AS pos FROM fold f JOIN turn t ON t.k = f.k + 1))""",
        f"""SELECT doc_id, entity_id, CASE WHEN pos = -1 OR (pos = 0 AND s >= {TIEBREAK}) THEN target WHEN pos > 0 THEN (SELECT made FROM fold ORDER BY k DESC LIMIT 1)[pos].id ELSE own END AS cluster_id,
    round(CASE WHEN pos = -1 THEN s WHEN pos > 0 THEN best WHEN s >= {BORDERLINE} THEN s ELSE 1.0 END, 6) AS top_similarity,
    CASE WHEN pos <> 0 THEN 'threshold' WHEN s >= {TIEBREAK} THEN 'llm_tiebreak' ELSE 'singleton' END AS source, NOT (pos = -1 OR (pos = 0 AND s >= {TIEBREAK})) AS is_new
FROM fold JOIN turn USING (k)""",
    ),
    "review_route": _with(ENTITIES, "SELECT doc_id, entity_id, reason FROM routed WHERE reason IS NOT NULL"),
    "review_lines": _with(ENTITIES, "SELECT doc_id, CAST(line AS INTEGER) AS line, 'keep' AS op, entity_id AS id, type, canonical, round(confidence, 6) AS confidence, CAST(n_mentions AS INTEGER) AS n_mentions, reason FROM lines"),
    "review_lines_flagged": _with(ENTITIES, "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_start, entity_id) + 1 AS INTEGER) AS line, entity_id AS id, reason FROM routed WHERE reason IS NOT NULL"),
    "review_apply": _with(ENTITIES, f""", ops AS (SELECT *, {_EDIT} AS op FROM lines)
SELECT doc_id, entity_id, type, canonical || CASE WHEN op = 'edit' THEN ' (edited)' ELSE '' END AS canonical, round(confidence, 6) AS confidence, CAST(n_mentions AS INTEGER) AS n_mentions FROM ops WHERE op IS DISTINCT FROM 'reject'
UNION ALL SELECT doc_id, 'human_' || entity_id, type, canonical || CASE WHEN op = 'edit' THEN ' (edited)' ELSE '' END, 1.0, CAST(n_mentions AS INTEGER) FROM ops WHERE line = 2 AND op IS NOT NULL"""),
    "review_lint": _with(ENTITIES, """, spans AS (SELECT doc_id, line, digit, unnest(spans) AS m FROM lines)
SELECT DISTINCT doc_id, CAST(line AS INTEGER) AS line, message FROM (
    SELECT doc_id, line + unnest([0, 1000]) AS line, 'id repeats: ' || entity_id AS message FROM lines WHERE digit = '0'
    UNION ALL SELECT doc_id, line, 'unknown type: Nope' FROM lines WHERE digit = '1'
    UNION ALL SELECT doc_id, line, 'text differs at ' || m.s || '-' || m.e FROM spans WHERE digit = '2'
    UNION ALL SELECT doc_id, line, 'span out of bounds: ' || m.s || '-' || (m.e + 10000000) FROM spans WHERE digit = '3'
    UNION ALL SELECT doc_id, line, 'mentions overlap' FROM lines WHERE digit = '3' AND n_mentions > 1
    UNION ALL SELECT doc_id, line, 'unknown id: ' || entity_id || 'x' FROM lines WHERE digit = '4'
    UNION ALL SELECT doc_id, line, 'an added id must begin with human_: ' || entity_id FROM lines WHERE digit = '5')"""),
    "review_lint_headers": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1 AS line, unnest(['the document''s text has changed', 'schema version is 0']) AS message FROM documents WHERE substr(sha256(text), 1, 1) < '8'""",
    "pairwise_prf": _with(RESOLVED + ", " + PRF, f"SELECT round(p, 9) AS precision, round(r, 9) AS recall, round({_F1.format('pairwise')}, 9) AS f1 FROM pairwise"),
    "bcubed_prf": _with(RESOLVED + ", " + PRF, f"SELECT round(p, 9) AS precision, round(r, 9) AS recall, round({_F1.format('bcubed')}, 9) AS f1 FROM bcubed"),
    "eval_report": _with(RESOLVED + ", " + PRF, f"""SELECT (SELECT count(*) FROM both_) AS n_entities, (SELECT count(DISTINCT s) FROM both_) AS n_system_clusters, (SELECT count(DISTINCT g) FROM both_) AS n_gold_clusters,
    round(pairwise.p, 9) AS pairwise_precision, round(pairwise.r, 9) AS pairwise_recall, round({_F1.format('pairwise')}, 9) AS pairwise_f1, round(bcubed.p, 9) AS bcubed_precision, round(bcubed.r, 9) AS bcubed_recall, round({_F1.format('bcubed')}, 9) AS bcubed_f1 FROM pairwise, bcubed"""),
    "threshold_sweep": _with(
        f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), merges(t) AS (VALUES {_MERGES}), grid(t, b) AS (VALUES {_GRID}),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {min(SWEEP_MERGE)}),
edges AS (SELECT t, a, b FROM pairs, merges WHERE s >= t UNION SELECT t, b, a FROM pairs, merges WHERE s >= t),
reach(t, n, r) AS (SELECT t, a, a FROM edges UNION SELECT e.t, e.b, x.r FROM reach x JOIN edges e ON e.a = x.n AND e.t = x.t),
both_ AS (SELECT m.t, v.vec_id, label AS g, coalesce(min(r), v.vec_id) AS s FROM v CROSS JOIN merges m LEFT JOIN reach x ON x.t = m.t AND x.n = v.vec_id GROUP BY m.t, v.vec_id, label),
pr AS (SELECT a.t, a.s = b.s AS same_s, a.g = b.g AS same_g FROM both_ a JOIN both_ b ON a.t = b.t AND a.vec_id < b.vec_id),
pairwise AS (SELECT t, coalesce(count(*) FILTER (same_s AND same_g) / nullif(count(*) FILTER (same_s), 0), 1.0) AS p, coalesce(count(*) FILTER (same_s AND same_g) / nullif(count(*) FILTER (same_g), 0), 1.0) AS r FROM pr GROUP BY t),
each_ AS (SELECT a.t, a.vec_id, count(*) FILTER (a.s = b.s AND a.g = b.g) AS o, count(*) FILTER (a.s = b.s) AS ns, count(*) FILTER (a.g = b.g) AS ng FROM both_ a JOIN both_ b ON a.t = b.t GROUP BY 1, 2),
bcubed AS (SELECT t, avg(o / ns) AS p, avg(o / ng) AS r FROM each_ GROUP BY t)""",
        f"""SELECT CAST(grid.t AS DOUBLE) AS merge_threshold, CAST(grid.b AS DOUBLE) AS borderline_threshold, (SELECT count(DISTINCT s) FROM both_ WHERE both_.t = grid.t) AS n_system_clusters, round({_F1.format('pairwise')}, 9) AS pairwise_f1, round({_F1.format('bcubed')}, 9) AS bcubed_f1
FROM grid JOIN pairwise USING (t) JOIN bcubed USING (t)""",
    ),
    "gold_duplicates": "SELECT CAST(vec_id AS VARCHAR) AS doc_id, 'v' || vec_id AS entity_id, CAST(2 AS BIGINT) AS n FROM embeddings WHERE vec_id % 2 = 0",
    "inspect_topk": _with(ENTITIES, "SELECT doc_id, entity_id, CAST(n_mentions AS INTEGER) AS n_mentions, round(confidence, 6) AS confidence FROM entities ORDER BY n_mentions DESC, entities.confidence DESC, doc_id, entity_id LIMIT 20"),
    "manifest_counts": _with(ENTITIES, "SELECT (SELECT count(*) FROM docs) AS n_documents, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM routed WHERE reason IS NOT NULL) AS n_flagged"),
    "confidence_formulas": """SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, 0.5 * (l_discount * 10) + 0.5 * least(1, greatest(0, l_tax * 20)))), 6) AS within,
    round(least(1, greatest(0, 0.4 * (l_discount * 10) + 0.4 * 1.0::DOUBLE + 0.2 * least(1, greatest(0, greatest(0, l_tax * 20 - l_discount))))), 6) AS cross FROM lineitem""",
}
# the bodies that begin with a comma go on with the list of common tables
SQL = {k: v.replace("\n, ", ",\n", 1) if "\n, " in v else v for k, v in SQL.items()}
