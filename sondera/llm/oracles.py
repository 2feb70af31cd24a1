"""SQL for DuckDB that gives the rows of the registered queries, where SQL can say them."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: All pairs of texts by their weighted five-word shingles, then reachability of documents; a document may have several texts.
OP1 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id, w) AS k, doc_id, w FROM (SELECT DISTINCT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents WHERE doc_id IS NOT NULL)),
g AS (SELECT k, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS g FROM w),
c AS (SELECT k, s, count(*) AS n FROM (SELECT k, unnest(g) AS s FROM g) GROUP BY k, s),
t AS (SELECT k, w.doc_id, sum(n) AS t FROM c JOIN w USING (k) GROUP BY k, w.doc_id),
i AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM i JOIN t x ON i.a = x.k JOIN t y ON i.b = y.k WHERE i.m >= 0.8 * (x.t + y.t - i.m) - 1e-9),
d AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b),
r AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM t UNION SELECT d.b, r.root FROM r JOIN d ON r.node = d.a)
SELECT node AS doc_id, min(root) AS component_id, node = min(root) AS kept FROM r GROUP BY node
"""

#: Cosine of all pairs, then reachability.
OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT r.node AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.root) AS component_id, r.node = min(r.root) AS kept FROM r LEFT JOIN n ON n.a = r.node GROUP BY r.node
"""

#: The exponent that repeats the smallest source twice, in closed form; places from one window for each source and epoch.
OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len({_WORDS.format("coalesce(text, '')")}) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
x AS (SELECT max(tokens) * 1.0 / min(tokens) AS ratio, max(tokens) AS top FROM s WHERE tokens > 0),
a AS (SELECT top, CASE WHEN ratio <= 2 THEN 0.0 ELSE round(1 - ln(2.0) / ln(ratio), 9) END AS exponent FROM x),
b AS (SELECT source, tokens, CAST(CASE WHEN tokens = 0 THEN 0 ELSE round(tokens * round(least(2.0, pow(top * 1.0 / tokens, 1 - exponent)), 6)) END AS BIGINT) AS budget, greatest(64, CAST(ceil(tokens / 4000000.0) AS BIGINT)) AS blocks FROM s, a),
e AS (SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM b),
p AS (SELECT d.*, e.tokens, e.budget, e.epochs, e.rest, CAST('0x' || substr(md5('1:block:' || mark), 1, 8) AS BIGINT) % e.blocks AS block, unnest(range(0, CAST(e.epochs + CASE WHEN e.rest > 0 THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM d JOIN e ON d.source = e.source),
k AS (SELECT *, md5('1:' || epoch || ':' || source || ':' || block) AS block_key, md5('1:' || epoch || ':' || mark) AS doc_key FROM p),
q AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_key, doc_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k)
SELECT doc_id, source, n_tokens, epoch, block, CAST(epoch * tokens + ahead AS BIGINT) AS place, CASE WHEN budget > 0 THEN round((epoch * tokens + ahead) * 1.0 / budget, 9) ELSE 0.0 END AS mix_at FROM q WHERE epoch < epochs OR ahead < rest
"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP6 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(24 + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS chars, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS codes FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(codes, 's?u(au)*a?') AS valid_order FROM g
"""

#: CRC-32 as a fold over bytes with a table of its remainders; near words meet by what is left of them without one letter.
OP13 = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM d),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda a, c: xor(a >> 8, t[xor(a & 255, c) + 1]))) AS h FROM b, t),
k AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM e a JOIN e b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT e.word, e.n, v.word, v.n FROM e JOIN v ON e.k = v.word UNION SELECT v.word, v.n, e.word, e.n FROM e JOIN v ON e.k = v.word),
f AS (SELECT v.word, v.n, count(p.near) AS n_near, min({'m': -p.m, 'w': p.near}) AS best FROM v LEFT JOIN p ON v.word = p.word GROUP BY v.word, v.n),
g AS (SELECT word, n, n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM f),
c AS (SELECT word, word AS at, 0 AS step FROM g UNION ALL SELECT c.word, g.form, step + 1 FROM c JOIN g ON c.at = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, arg_max(c.at, c.step) AS root, g.n, g.n_near, g.form_n FROM g JOIN c ON g.word = c.word GROUP BY g.word, g.form, g.n, g.n_near, g.form_n
"""

ORACLE = {"op1_near_dedup": OP1, "op3_embedding_dedup": OP3, "op4_mixing": OP4, "op6_chat": OP6, "op13_spelling_variants": OP13}
