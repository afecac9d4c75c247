"""DuckDB SQL that states a registered query's result independently of the operator's method."""

ORACLE: dict[str, str] = {}

ORACLE["op1_decontamination"] = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, abc),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, abc WHERE text IS NOT NULL),
bw AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g, p, list_count(w) AS n FROM bw),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m),
hits AS (SELECT dw.doc_id, win.item_id, dw.p, dw.m, win.p AS q
         FROM (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM dw) dw JOIN win USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM (SELECT DISTINCT doc_id, p, m FROM hits)) GROUP BY 1),
diag AS (SELECT DISTINCT doc_id, item_id, m, q, p - q AS shift FROM hits),
runs AS (SELECT doc_id, item_id, m, shift, q - row_number() OVER (PARTITION BY doc_id, item_id, m, shift ORDER BY q) AS island FROM diag),
longest AS (SELECT doc_id, max(n) AS longest_match
            FROM (SELECT doc_id, m + count(*) - 1 AS n FROM runs GROUP BY doc_id, item_id, m, shift, island) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
u AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT b, max(page_id) AS top, count(*) AS n FROM p GROUP BY b)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p JOIN g USING (b)
"""


def _merkle(levels: int = 6, crown: int = 4) -> str:
    """Levels are written out one by one: 16 ** ``levels`` leaves a source, 16 ** ``crown`` sources."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"

    def tree(start, name, n):
        out = []
        for k in range(n):
            nodes = start if k == 0 else f"{name}n{k}"
            out.append(f"""{name}l{k} AS (SELECT s, p, h, count(*) OVER (PARTITION BY s) AS c,
  coalesce(string_agg(h, '') OVER (PARTITION BY s, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY s, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes}),
{name}n{k + 1} AS (SELECT s, p // 16 AS p, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h
  FROM {name}l{k} GROUP BY s, p // 16)""")
        return ",\n".join(out)

    def climb(frm, name, n, s, p):
        out = []
        for k in range(n):
            out.append(f"""{name}f{k} AS (SELECT f.* EXCLUDE (g, proof), proof || l || r AS proof,
  CASE WHEN c > 1 THEN sha256(l || g || r) ELSE g END AS g FROM {frm if k == 0 else f'{name}f{k - 1}'} f
  JOIN {name}l{k} t ON t.s = f.{s} AND t.p = f.{p} // {16 ** k})""")
        return ",\n".join(out)

    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
    body = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS src, sha256({body} || {field('text')}) AS h,
    CASE WHEN {crc} % 5 = 0 THEN sha256({body} || {field(lower)}) END AS tampered FROM documents),
leaf AS (SELECT *, src AS s, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
{tree("leaf", "a", levels)},
subs AS (SELECT s AS src, h AS subroot, h, 0 AS s, row_number() OVER (ORDER BY s) - 1 AS p FROM an{levels}),
{tree("subs", "b", crown)},
f AS (SELECT doc_id, leaf.h AS leaf, leaf.src, leaf.p, subroot, subs.s AS one, subs.p AS q, coalesce(tampered, leaf.h) AS g, '' AS proof
      FROM leaf JOIN subs ON subs.src = leaf.src),
{climb("f", "a", levels, "src", "p")},
{climb(f"af{levels - 1}", "b", crown, "one", "q")}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, g AS folded_root, g = root.h AS verified
FROM bf{crown - 1}, (SELECT h FROM bn{crown}) root
"""


ORACLE["op11_merkle_manifest"] = _merkle()

ORACLE["op13_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.*, fl.f AS l, fr.f AS r, CAST(1000000::HUGEINT * a * a // (fl.f::HUGEINT * fr.f) AS BIGINT) AS score
      FROM c JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(c.w[1:k], ' ')
             JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS f
           FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE m = 3 AND k = 1) GROUP BY 1, 2),
left_over AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE b.m = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN n USING (lang) QUALIFY rank <= 2000
"""
