"""SQL of the operators that SQL can express beside their own modules' constants: plain definitions, for small tables."""

OP2_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
bytes AS (SELECT doc_id, unnest(generate_series(1, n)) AS i, unnest(regexp_extract_all(x, '..')) AS c FROM d WHERE n > 0),
mark AS (SELECT doc_id, i, c, coalesce(max(dup.i) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.i), -100) > i - 100 AS gone FROM bytes LEFT JOIN dup USING (doc_id, i)),
span AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM mark),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, n - 34)) AS i FROM n WHERE n >= 35)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
words AS (SELECT doc_id, unnest(generate_series(1, n)) AS i, unnest(w) AS word FROM n WHERE n > 0),
mark AS (SELECT doc_id, i, word, coalesce(max(dup.i) OVER (PARTITION BY words.doc_id ORDER BY words.i), -35) > i - 35 AS gone FROM words LEFT JOIN dup USING (doc_id, i)),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM mark GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM n LEFT JOIN cut USING (doc_id)
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
places AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
found AS (SELECT doc_id, i, m, item FROM places JOIN win USING (m, k)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM found)),
hit AS (SELECT doc_id, count(*) FILTER (reach > i) AS n_hit FROM (
  SELECT words.doc_id, words.i, max(f.reach) OVER (PARTITION BY words.doc_id ORDER BY words.i) AS reach FROM words LEFT JOIN (SELECT doc_id, i, max(i + m) AS reach FROM found GROUP BY ALL) f USING (doc_id, i)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN hit USING (doc_id)
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
part AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN part ON part.a = d.doc_id
"""


def _op13_sql() -> str:
    """Rounds of assignment and means, one after the other; dot products of integers are exact in doubles."""
    steps = []
    for k in range(5):
        steps.append(f"""near{k} AS (SELECT v.n, v.p, arg_min(b.k, (list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.c) + list_dot_product(b.c, b.c), b.k)) AS k,
  min(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.c) + list_dot_product(b.c, b.c)) AS d FROM parts v JOIN book{k} b USING (p) GROUP BY ALL)""")
        if k < 4:
            steps.append(f"""mean{k} AS (SELECT p, k, list(c ORDER BY i) AS c FROM (SELECT p, k, i, floor(sum(y) / count(*)) AS c FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} JOIN parts USING (n, p)) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.k = b.k)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n FROM v),
parts AS (SELECT n, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM kept, generate_series(0, 3) g(p)),
book0 AS (SELECT p, n - 1 AS k, x AS c FROM parts WHERE n <= 256),
{', '.join(steps)},
codes AS (SELECT n, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY n),
sha AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM book4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (n), sha
"""


OP13_SQL = _op13_sql()


def _op11_sql() -> str:
    """Row by row the least (cost, audit) that reaches each state of the grammar, with the lines written so far."""
    step = lambda s, cost, mark, line=None: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{mark}', 'lines': {s}.lines" + (f" || [{line}]" if line else "") + "} END"
    delete = lambda s: step(s, 3, "D")
    keep = lambda s, first: f"CASE WHEN NOT gone AND first = '{first}' THEN {step(s, 'cut', 'K', 'line')} END"
    rerole = lambda s, role: f"CASE WHEN NOT gone THEN {step(s, '2 + cut', 'R', f"'{role}:' || body")} END"
    insert = lambda s, role: step(s, 2, "I", f"'{role}:'")
    least = lambda *x: f"list_min([{', '.join(x)}])"
    # crc32, bit by bit: digits, signs and a colon are bytes of their own.
    bits = "list_reduce(generate_series(1, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b))"
    crc = f"xor(list_reduce(list_transform(string_split(id, ''), lambda ch: ord(ch)::BIGINT), lambda crc, b: {bits}, 4294967295::BIGINT), 4294967295)"
    two = [f(s) for s in ("s0", "s1", "s3") for f in (lambda s: keep(s, "u"), lambda s: rerole(s, "user"))]
    return rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations)),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS body, unnest(generate_series(1, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE kind <> 0),
seq AS (SELECT *, coalesce(conv_id::VARCHAR, 'null') AS c, left(role, 1) AS first, role || ':' || body AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy) AS j,
  regexp_extract(body, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, regexp_matches(body, '[^\x20\x09-\x0D]') AS filled FROM hurt),
told AS (SELECT *, row_number() OVER (PARTITION BY c, role, body ORDER BY j) > 1 AS again, lag(first) OVER (PARTITION BY c ORDER BY j) AS before FROM seq),
fault AS (SELECT *, CASE WHEN NOT filled THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
rows_of AS (SELECT c, j, first, line, body, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM fault),
start AS (SELECT {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS s0, {{'cost': 2::BIGINT, 'audit': 'I', 'lines': ['user:']}} AS s2, {{'cost': 4::BIGINT, 'audit': 'II', 'lines': ['user:', 'assistant:']}} AS s3),
fold AS (SELECT c, 0::BIGINT AS j, s0, CASE WHEN false THEN s0 END AS s1, s2, s3 FROM (SELECT DISTINCT c FROM rows_of), start
  UNION ALL SELECT c, j, n0, n1, m2, {least('n3', insert('m2', 'assistant'))} FROM (SELECT c, j, n0, n1, n3, {least('n2', insert('n0', 'user'), insert('n1', 'user'), insert('n3', 'user'))} AS m2 FROM (
    SELECT c, r.j, {delete('s0')} AS n0, {least(delete('s1'), keep('s0', 's'))} AS n1, {least(delete('s2'), *two)} AS n2, {least(delete('s3'), keep('s2', 'a'), rerole('s2', 'assistant'))} AS n3
    FROM fold f JOIN rows_of r USING (c) WHERE r.j = f.j + 1))),
ends AS (SELECT c, {least('s0', 's3')} AS best FROM fold SEMI JOIN (SELECT c, max(j) AS j FROM rows_of GROUP BY c) USING (c, j)),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY c)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS c FROM conversations) i LEFT JOIN counts USING (c) LEFT JOIN ends USING (c)
"""


OP11_SQL = _op11_sql()
