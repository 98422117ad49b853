"""The registered queries of this subpackage and their SQL.

SQL can state what op4, op5, op6 and op11 to op13 return; tests hold the others to brute force,
an exact round trip, recall or held-out accuracy.
"""

from __future__ import annotations

import importlib

from loomspan.llm import redirects as D

#: Query name -> module that defines a function of that name.
MODULES = {
    "op1_quality_qda": "quality",
    "op2_template_removal": "page_text",
    "op3_order_minhash": "order_minhash",
    "op4_nn_descent": "nn_descent",
    "op5_suffix_repeats": "repeated_spans",
    "op6_arc_to_warc": "archives",
    "op7_vector_packing": "packing",
    "op8_multi_index": "multi_index",
    "op9_token_frames": "token_files",
    "op10_gumbel_pieces": "sampled_pieces",
    "op11_grid_cells": "grid_codes",
    "op12_checkpointed_repair": "repair",
    "op13_redirect_classes": "redirects",
}


#: Links of all pairs of a label, and the smallest id that a walk over links reaches.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT r.a AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a"""

#: Windows of 100 bytes, cut from stretches of 1,000; all but the first of equal ones are removed.
REPEATS_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
stretches AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2198) AS part, least(1000, n_bytes - 99 - base) AS n FROM (SELECT *, unnest(range(0, greatest(n_bytes - 99, 0), 1000)) AS base FROM t)),
windows AS (SELECT doc_id, base + i AS s, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(range(0, n)) AS i FROM stretches)),
again AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
starts AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM starts) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n_bytes, n_bytes + 1 FROM t)),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY y) AS h FROM cuts c JOIN t USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT t.doc_id, CAST(t.n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

#: Base32 of a SHA-1: every five hexadecimal digits make four of its letters.
ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST(concat('0x', substr(sha1(x), 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM l"""


def _codes_sql() -> str:
    """Rounds of exact assignment; sums of integers below 2^53 are exact as doubles."""
    near = "SELECT id, p, x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y), 'e': e}}) AS m FROM parts JOIN c{0} USING (p) GROUP BY 1, 2, 3"
    rounds = ""
    for i in range(4):
        rounds += f"""
a{i} AS MATERIALIZED ({near.format(i)}),
s{i} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS y FROM (SELECT p, m.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, 17) t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.y, c.y) AS y FROM c{i} c LEFT JOIN s{i} s USING (p, e)),"""
    return f"""
WITH v AS (SELECT vec_id AS id, label, [floor(1024 * x) FOR x IN embedding::DOUBLE[]] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT id, p, q[16 * p + 1 : 16 * p + 16] AS x FROM v, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, e, x AS y FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e FROM parts) WHERE e < 256),{rounds}
a4 AS MATERIALIZED ({near.format(4)}),
codes AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY 1),
book AS (SELECT sha256(string_agg(CAST(CAST(y[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM c4, range(1, 17) t(j))
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM codes JOIN v USING (id), book"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rest_sql(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _address_sql(url: str) -> str:
    return f"nullif(concat(translate(regexp_extract({_rest_sql(url)}, '^[^/?#]*'), '{D.UPPER}', '{D.LOWER}'), regexp_extract({_rest_sql(url)}, '^[^/?#]*([^#]*)', 1)), '')"


def _redirects_sql() -> str:
    """Links by the same patterns; reachable addresses by a walk over them."""
    value = lambda name: "concat(" + ", ".join(f"regexp_extract(t, {_quoted(D.VALUE.format(name))}, {g})" for g in (1, 2, 3)) + ")"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in D.RULES)
    return f"""
WITH RECURSIVE u AS (SELECT page_id, url, coalesce(translate(regexp_extract({_rest_sql('url')}, '^[^/?#]*'), '{D.UPPER}', '{D.LOWER}'), '') AS host, coalesce(regexp_extract({_rest_sql('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path, {_address_sql('url')} AS own, regexp_replace(coalesce(html, ''), {_quoted(D.UNSEEN)}, ' ', 'g') AS h FROM pages),
tags AS (SELECT page_id, host, path, own, unnest([regexp_replace(t, '\\s+', ' ', 'g') FOR t IN regexp_extract_all(h, {_quoted(D.TAGS)})]) AS t FROM u),
named AS (SELECT page_id, host, path, own, trim(replace(CASE WHEN regexp_matches(t, {_quoted(D.CANONICAL)}) THEN {value('href')} WHEN regexp_matches(t, {_quoted(D.REFRESH)}) THEN regexp_extract({value('content')}, {_quoted(D.REFRESH_URL)}, 1) ELSE '' END, '&amp;', '&')) AS l FROM tags),
full_urls AS (SELECT page_id, own, CASE WHEN regexp_matches(l, '{D.SCHEME}//') THEN l WHEN regexp_matches(l, '{D.SCHEME}') THEN NULL WHEN starts_with(l, '//') THEN concat('x:', l) WHEN host = '' THEN NULL WHEN starts_with(l, '/') THEN concat('x://', host, l) WHEN regexp_matches(l, '^[?#]') THEN concat('x://', host, path, l) ELSE concat('x://', host, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END, l) END AS x FROM named WHERE l <> ''),
targets AS (SELECT page_id, own, {_address_sql('x')} AS b FROM full_urls),
least_named AS (SELECT page_id, min(b) AS b FROM targets GROUP BY 1),
seen AS (SELECT u.page_id, host, path, own, coalesce(own, n.b) AS address FROM u LEFT JOIN least_named n USING (page_id)),
links AS (SELECT DISTINCT s.address AS a, t.b FROM targets t JOIN seen s USING (page_id) WHERE t.b IS NOT NULL),
every AS (SELECT address FROM seen WHERE address IS NOT NULL UNION SELECT a FROM links UNION SELECT b FROM links),
rules AS (SELECT * FROM (VALUES {rules}) r(host, start, verdict)),
fits AS (SELECT address, concat(host, start) AS rule, verdict FROM every JOIN rules ON (regexp_extract(address, '^[^/?]*') = host OR ends_with(regexp_extract(address, '^[^/?]*'), concat('.', host))) AND starts_with(regexp_extract(address, '^[^/?]*([^?]*)', 1), start)),
best AS (SELECT address, first(rule ORDER BY length(rule) DESC, verdict, rule DESC) AS rule, first(verdict ORDER BY length(rule) DESC, verdict, rule DESC) AS verdict FROM fits GROUP BY 1),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
alias AS (SELECT r.a AS address, min(r.b) AS component, bool_or(coalesce(x.verdict = 'block', false)) AS blocked FROM reach r LEFT JOIN best x ON x.address = r.b GROUP BY 1),
j AS (SELECT s.*, CASE WHEN own IS NOT NULL THEN b.rule END AS rule, b.verdict AS v, coalesce(a.blocked, false) OR coalesce(b.verdict = 'block', false) AS blocked, coalesce(a.component, s.address) AS component FROM seen s LEFT JOIN best b USING (address) LEFT JOIN alias a USING (address))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'none' END AS via, component FROM j"""


def _repair_sql() -> str:
    """Costs by a walk back over each conversation's turns, edits by a walk forward."""
    words, never = "[^\\x20\\x09-\\x0D]", 1_000_000
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = lambda s, v: f"CASE WHEN gone THEN {never} " + "".join(f"WHEN initial = '{r}' THEN cut + {v(t)} " for r, own in (("s", {0: 1}), ("u", {0: 2, 1: 2, 3: 2}), ("a", {2: 3})) for at, t in own.items() if at == s) + f"ELSE {never} END"
    rerole = lambda s, v: f"CASE WHEN gone THEN {never} ELSE 2 + cut + {v(to[s])} END"
    base = ", ".join(f"least(3 + v{s}, {keep(s, lambda t: f'v{t}')}, {rerole(s, lambda t: f'v{t}')}) AS b{s}" for s in range(4))
    # costs behind a turn (list w) and before it (list v); lists count from 1
    pick = "CASE " + " ".join(
        f"WHEN state = {s} THEN CASE WHEN i <= n AND 3 + w[{s + 1}] = v[{s + 1}] THEN 'D' WHEN 2 + v[{to[s] + 1}] = v[{s + 1}] THEN 'I' WHEN {keep(s, lambda t: f'w[{t + 1}]')} = v[{s + 1}] THEN 'K' ELSE 'R' END" for s in range(4)
    ) + " END"
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
dmg AS (SELECT *, xor(list_reduce(list_concat([4294967295], [CAST(ord(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS what FROM src, tab),
kept AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM dmg WHERE what <> 0),
num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM kept),
flt AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{words}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM num),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, coalesce(concat(lag(initial) OVER (PARTITION BY conv_id ORDER BY i), initial) NOT IN ('su', 'ua', 'au'), false) AND i > 1 AS illegal FROM flt),
back AS (SELECT conv_id, n + 1 AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM r WHERE i = 1 UNION ALL
  SELECT conv_id, i, least(b0, 2 + u) AS v0, least(b1, 2 + u) AS v1, u AS v2, least(b3, 2 + b2) AS v3 FROM (SELECT *, least(b2, 2 + b3) AS u FROM (SELECT r.conv_id, r.i, {base} FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1))),
st AS (SELECT b.conv_id, b.i, r.n, r.role, r.text, r.initial, coalesce(r.gone, false) AS gone, coalesce(r.cut, 0) AS cut, [b.v0, b.v1, b.v2, b.v3] AS v, [l.v0, l.v1, l.v2, l.v3] AS w FROM back b LEFT JOIN back l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
fwd AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS done FROM r WHERE i = 1 UNION ALL
  SELECT conv_id, CASE WHEN e IN ('', 'I') THEN i ELSE i + 1 END,
    CASE WHEN e IN ('', 'D') THEN state WHEN e = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    concat(audit, e), CASE e WHEN 'K' THEN list_append(lines, concat(role, ':', text)) WHEN 'R' THEN list_append(lines, concat(fit, text)) WHEN 'I' THEN list_append(lines, fit) ELSE lines END, e = ''
  FROM (SELECT *, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END AS fit, CASE WHEN w[1] IS NULL AND v[state + 1] = 0 THEN '' WHEN w[1] IS NULL THEN 'I' ELSE {pick} END AS e
    FROM (SELECT f.*, st.* EXCLUDE (conv_id, i) FROM fwd f JOIN st ON st.conv_id IS NOT DISTINCT FROM f.conv_id AND st.i = f.i WHERE NOT f.done))),
ends AS (SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS h FROM fwd WHERE done),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY 1)
SELECT c.conv_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(coalesce(b.v0, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, coalesce(e.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN agg a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1"""


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"loomspan.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_nn_descent": VECTORS_SQL, "op5_suffix_repeats": REPEATS_SQL, "op6_arc_to_warc": ARCHIVES_SQL, "op11_grid_cells": _codes_sql(), "op12_checkpointed_repair": _repair_sql(), "op13_redirect_classes": _redirects_sql()}
