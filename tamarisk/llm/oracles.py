"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sizes z JOIN reach r ON r.a = z.doc_id GROUP BY 1, 2
"""

#: Ranges of scripts that are written without spaces, as in ``substring_dedup``.
_UNSPACED = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"

_OP1 = (
    r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x09-\x0D\x20]*(?:[UNSPACED]|[^\x09-\x0D\x20UNSPACED]+)') AS t FROM documents
), words AS (
  SELECT doc_id, k, t, ltrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w,
    sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS stop
  FROM (SELECT doc_id, unnest(t) AS t, unnest(range(len(t))) AS k FROM split)
), lists AS (SELECT doc_id, list(lower(w) ORDER BY k) AS w FROM words GROUP BY doc_id
), runs AS (
  SELECT doc_id, k, md5(array_to_string(w[k + 1:k + 50], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS k FROM lists)
), firsts AS (SELECT run, min({'d': doc_id, 'k': k}) AS f, count(*) AS n FROM runs GROUP BY run HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r.doc_id, unnest(range(r.k, r.k + 50)) AS k
  FROM runs r JOIN firsts USING (run) WHERE r.doc_id != f.d OR r.k >= f.k + 50
), marked AS (
  SELECT w.*, g.k IS NOT NULL AS gone, length(t) - length(w) AS lead, contains(left(t, length(t) - length(w)), chr(10)) AS breaks
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k
), spans AS (
  SELECT doc_id, min(k) AS a, string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',') AS span FROM (
    SELECT doc_id, min(k) AS k, min(stop - length(w)) AS b, max(stop) AS e
    FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM marked WHERE gone) GROUP BY doc_id, island
  ) GROUP BY doc_id, k
), broken AS (
  SELECT *, sum(CAST(breaks AND gone AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS nl FROM marked
), kept AS (
  SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before, nl - coalesce(lag(nl) OVER (PARTITION BY doc_id ORDER BY k), 0) > 0 AS crossed
  FROM broken WHERE NOT gone
), texts AS (
  SELECT doc_id, string_agg(CASE WHEN before IS NULL AND k > 0 THEN right(t, length(t) - lead) WHEN before < k - 1 AND crossed AND NOT breaks THEN chr(10) || right(t, length(t) - lead) ELSE t END, '' ORDER BY k) AS text
  FROM kept GROUP BY doc_id
), ends AS (SELECT doc_id, max(stop) AS stop, count(*) AS n_units, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id)
SELECT s.doc_id, coalesce(x.text, '') || right(s.text, length(s.text) - CAST(coalesce(e.stop, 0) AS BIGINT)) AS text,
  coalesce(e.n_units, 0) AS n_units, coalesce(e.n_removed, 0) AS n_removed,
  coalesce((SELECT string_agg(span, ',' ORDER BY a) FROM spans p WHERE p.doc_id = s.doc_id), '') AS removed_spans
FROM split s LEFT JOIN texts x USING (doc_id) LEFT JOIN ends e USING (doc_id)
"""
).replace("UNSPACED", _UNSPACED)

_OP9 = r"""
WITH rows AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
spoken AS (SELECT pair_id, max(turn) AS last FROM rows WHERE role = 'assistant' GROUP BY 1),
reply AS (
  SELECT xor(r.pair_id, 1) AS pair_id, min(r.text) AS reply
  FROM rows r JOIN spoken s ON s.pair_id = r.pair_id AND r.turn = s.last WHERE r.role = 'assistant' GROUP BY 1
), sides AS (
  SELECT *, 'chosen' AS side FROM rows
  UNION ALL
  SELECT r.pair_id, r.turn, r.role, CASE WHEN r.role = 'assistant' AND r.turn = s.last THEN coalesce(p.reply, '') ELSE r.text END, 'rejected'
  FROM rows r LEFT JOIN spoken s ON s.pair_id = r.pair_id LEFT JOIN reply p ON p.pair_id = r.pair_id
), turns AS (
  SELECT pair_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r
  FROM sides GROUP BY 1, 2, 3, 4
), firsts AS (SELECT pair_id, min(turn) AS first FROM turns WHERE c != r GROUP BY 1),
parts AS (
  SELECT t.*, f.first, t.turn < f.first OR f.first IS NULL AS common FROM turns t LEFT JOIN firsts f ON f.pair_id IS NOT DISTINCT FROM t.pair_id
), labelled AS (
  SELECT pair_id, turn, role, text, 'prompt' AS part FROM parts WHERE common
  UNION ALL SELECT pair_id, turn, role, text, 'chosen' FROM parts WHERE NOT common AND c
  UNION ALL SELECT pair_id, turn, role, text, 'rejected' FROM parts WHERE NOT common AND r
), pieces AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece, part != 'prompt' AND role = 'assistant' AS trained FROM labelled
), places AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces
), cut AS (SELECT *, CAST(start AS BIGINT) // 1000000 AS segment FROM places
), rel AS (SELECT *, CAST(start - min(start) OVER (PARTITION BY pair_id, part, segment) AS BIGINT) AS s FROM cut)
SELECT pair_id, segment,
  coalesce(string_agg(piece, '' ORDER BY s) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY s) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(CAST(s AS VARCHAR) || '-' || CAST(s + length(piece) AS VARCHAR), ',' ORDER BY s) FILTER (part = 'chosen' AND trained), '') AS chosen_mask,
  coalesce(string_agg(piece, '' ORDER BY s) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(s AS VARCHAR) || '-' || CAST(s + length(piece) AS VARCHAR), ',' ORDER BY s) FILTER (part = 'rejected' AND trained), '') AS rejected_mask
FROM rel GROUP BY ALL
"""

def _digested(*fields: str) -> str:
    """The leaf of a row's fields."""
    parts = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


#: crc32 of a number's digits, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda v, j: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

_OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_digested("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN c % 7 = 0 THEN {_digested("doc_id", "source", "lang", "n_chars + 1", "text")} END AS tampered
  FROM (SELECT *, {_CRC} AS c FROM documents)
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
inner_nodes AS (
  SELECT 0 AS level, lang, i, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER (PARTITION BY lang) AS top FROM inner_nodes) WHERE top > 0 GROUP BY level, lang, i // 2
), subroots AS (
  SELECT lang, h AS subroot, depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i
  FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS depth FROM inner_nodes) WHERE level = depth
), outer_nodes AS (
  SELECT 0 AS level, i, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER () AS top FROM outer_nodes) WHERE top > 0 GROUP BY level, i // 2
), top AS (SELECT h AS root, level AS height FROM outer_nodes ORDER BY level DESC LIMIT 1),
rows AS (SELECT p.*, s.subroot, s.depth, s.i AS g, t.root, t.height FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, top t),
steps AS (
  SELECT r.doc_id, r.i, r.lang, k, (r.i >> k) % 2 AS pos, coalesce(n.h, '') AS h
  FROM (SELECT *, unnest(range(depth)) AS k FROM rows) r LEFT JOIN inner_nodes n ON n.level = r.k AND n.lang IS NOT DISTINCT FROM r.lang AND n.i = xor(r.i >> k, 1)
  UNION ALL
  SELECT r.doc_id, r.i, r.lang, depth + k, (r.g >> k) % 2, coalesce(n.h, '')
  FROM (SELECT *, unnest(range(height)) AS k FROM rows) r LEFT JOIN outer_nodes n ON n.level = r.k AND n.i = xor(r.g >> k, 1)
), paths AS (SELECT lang, i, list(h ORDER BY k) AS h, list(pos ORDER BY k) AS pos FROM steps GROUP BY lang, i),
folds AS (
  SELECT r.lang, r.i, 0 AS k, coalesce(tampered, leaf) AS acc, coalesce(p.h, []) AS h, coalesce(p.pos, []) AS pos FROM rows r LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM r.lang AND p.i = r.i
  UNION ALL
  SELECT lang, i, k + 1, CASE WHEN pos[k + 1] = 0 THEN sha256(acc || h[k + 1]) ELSE sha256(h[k + 1] || acc) END, h, pos FROM folds WHERE k < len(h)
)
SELECT r.doc_id, r.leaf, r.subroot, r.root, sha256(array_to_string(f.h, '')) AS proof_sha256, f.acc AS folded_root, f.acc = r.root AS verified
FROM rows r JOIN folds f ON f.lang IS NOT DISTINCT FROM r.lang AND f.i = r.i AND f.k = len(f.h)
"""

_OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), chance AS (
  SELECT doc_id, text, t, len(t) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(s, k, 8) AS BIGINT)) AS h FROM cut
), placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM chance
), parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_ngram_jaccard_join": _OP2, "op9_preference_chat": _OP9, "op12_merkle_manifest": _OP12, "op13_fill_middle": _OP13}
