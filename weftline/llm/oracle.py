r"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '|#$%&*!', '')))
        / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
stats AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS capped_before, coalesce(sum(w) OVER b, 0)::BIGINT AS w_before,
    sum(w) OVER ()::BIGINT AS w_all
  FROM stats
  WINDOW b AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
caps AS (
  SELECT *, cap <= (total::DOUBLE - capped_before) / (w_all - w_before) * w AS capped FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE
      ELSE (total::DOUBLE - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT)
        / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT * w END AS target
  FROM caps),
drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN target - epochs * source_size - before > 0
    AND (target - epochs * source_size - before) * 2 >= size THEN 1 ELSE 0 END) AS taken
FROM drawn
"""

_DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER k AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size
  FROM d WINDOW k AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = d.doc_id
"""

_SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i : i + 12], ' ')) AS h, hash(array_to_string(w[i : i + 12], '|')) AS g
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, g) AS f FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late WHERE f < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

_INFILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents),
h AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || s[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1 : least(a, b)], ''), '') AS p,
    coalesce(array_to_string(u[least(a, b) + 1 : greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1 :], ''), '') AS x
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_LATTICE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id))::BIGINT AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN lowest l ON l.a = vec_id
"""


def _tree(name: str, levels: int) -> str:
    """Levels name_1 .. of nodes name_0 (k, idx, n, h), and the runs name_r0 .. of each; a finished group passes through."""
    out = ""
    for j in range(levels):
        out += f"""
{name}_r{j} AS (SELECT k, idx // 16 AS p, any_value(n) AS n, list(h ORDER BY idx) AS run FROM {name}_{j} GROUP BY ALL),
{name}_{j + 1} AS (SELECT k, p AS idx, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}_r{j}),"""
    return out


def _climb(name: str, levels: int, at: str) -> str:
    """From rows at_0 (id, k, idx, node, proof) up all levels: the folded digest and the siblings on the way."""
    out = ""
    for j in range(levels):
        left, right = "array_to_string(run[1 : idx % 16], '')", "array_to_string(run[idx % 16 + 2 :], '')"
        out += f"""
{at}_{j + 1} AS (
  SELECT id, k, idx // 16 AS idx, CASE WHEN n > 1 THEN sha256(coalesce({left}, '') || node || coalesce({right}, '')) ELSE node END AS node,
    proof || CASE WHEN n > 1 THEN coalesce({left}, '') || coalesce({right}, '') ELSE '' END AS proof
  FROM {at}_{j} JOIN {name}_r{j} USING (k) WHERE p = idx // 16),"""
    return out


def _merkle(levels: int, upper: int) -> str:
    """Levels one by one: enough for 16^levels rows of a source and 16^upper sources."""
    said = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(said(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: {step}), 4294967295)"
    small = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(small)} END AS tampered FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n_sources FROM (SELECT DISTINCT source FROM documents)),
l AS (
  SELECT d.*, s.k, row_number() OVER (PARTITION BY s.k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY s.k) AS n
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
a_0 AS (SELECT k, idx, n, leaf AS h FROM l),{_tree("a", levels)}
b_0 AS (SELECT 0 AS k, s.k AS idx, n_sources AS n, h FROM s JOIN a_{levels} t ON t.k = s.k),{_tree("b", upper)}
c_0 AS (SELECT id, k, idx, coalesce(tampered, leaf) AS node, '' AS proof FROM l),{_climb("a", levels, "c")}
e_0 AS (SELECT id, 0 AS k, k AS idx, node, proof FROM c_{levels}),{_climb("b", upper, "e")}
root AS (SELECT h AS root FROM b_{upper})
SELECT doc_id, leaf, a_{levels}.h AS subroot, root, sha256(e_{upper}.proof) AS proof_sha256, e_{upper}.node AS folded_root, e_{upper}.node = root AS verified
FROM l JOIN e_{upper} USING (id) JOIN a_{levels} ON a_{levels}.k = l.k, root
"""


ORACLE = {
    "op2_near_dedup": _NEAR,
    "op1_mixing": _MIX,
    "op3_decontamination": _DECONTAMINATE,
    "op4_exact_dedup": _EXACT,
    "op9_substring_dedup": _SUBSTRING,
    "op11_fill_in_middle": _INFILL,
    "op12_lattice_dedup": _LATTICE,
    "op13_merkle": _merkle(4, 2),
}
