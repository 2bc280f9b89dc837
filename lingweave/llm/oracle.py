"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Words of lower-cased ASCII digits and letters and of all other characters.
_ALNUM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_ALNUM}, []) AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM pos, sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT occ.r, occ.i, occ.n, win.item_id FROM occ JOIN win USING (n, k)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


def _field(column: str) -> str:
    """A value of a leaf: bytes, colon, text; null is a hyphen."""
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 bit by bit; 3988292384 is its reflected polynomial.
_BITS = "list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))"
_BYTES = "list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: ascii(c)::BIGINT)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda s, c: {_BITS}), 4294967295::BIGINT)"


def _levels(name: str, leaves: str) -> str:
    """Nodes of every level, pairs of which become one, until a part has a single node."""
    return f"""
{name} AS (
  SELECT 0 AS lvl, part, i, d FROM {leaves}
  UNION ALL
  SELECT lvl + 1, part, i // 2, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name}) WHERE n > 1 GROUP BY lvl, part, i // 2)"""


ORACLE["op11_manifest"] = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce('1' || lang, '0') AS part, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered
  FROM documents),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves),
low AS (SELECT part, r AS i, leaf AS d FROM ranked),
{_levels('nodes', 'low')},
heights AS (SELECT part, max(lvl) AS h FROM nodes GROUP BY part),
roots AS MATERIALIZED (SELECT n.part, h, d AS subroot, row_number() OVER (ORDER BY n.part) - 1 AS place FROM nodes n JOIN heights USING (part) WHERE lvl = h),
high AS (SELECT '' AS part, place AS i, subroot AS d FROM roots),
{_levels('tops', 'high')},
top AS (SELECT lvl AS height, d AS root FROM tops ORDER BY lvl DESC LIMIT 1),
steps AS MATERIALIZED (
  SELECT row, s.lvl, bit, d FROM (
    SELECT row, part, unnest(range(0, h)) AS lvl, r FROM ranked JOIN roots USING (part)) s
  CROSS JOIN LATERAL (SELECT (r >> lvl) & 1 AS bit, xor(r >> lvl, 1) AS other) x
  LEFT JOIN nodes n ON n.part = s.part AND n.lvl = s.lvl AND n.i = x.other
  UNION ALL
  SELECT row, h + up, (place >> up) & 1, d FROM (
    SELECT row, h, place, unnest(range(0, height)) AS up FROM ranked JOIN roots USING (part), top) s
  LEFT JOIN tops n ON n.lvl = s.up AND n.i = xor(place >> up, 1)),
proofs AS (SELECT row, sha256(coalesce(string_agg(d, '' ORDER BY lvl), '')) AS proof_sha256, count(*) AS n FROM steps GROUP BY row),
fold AS (
  SELECT row, 0 AS lvl, coalesce(tampered, leaf) AS d FROM ranked
  UNION ALL
  SELECT f.row, f.lvl + 1, sha256(CASE WHEN bit = 1 THEN s.d ELSE '' END || f.d || CASE WHEN bit = 0 THEN coalesce(s.d, '') ELSE '' END)
  FROM fold f JOIN steps s ON s.row = f.row AND s.lvl = f.lvl)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM ranked JOIN roots USING (part) CROSS JOIN top LEFT JOIN proofs p USING (row)
JOIN fold f ON f.row = ranked.row AND f.lvl = coalesce(p.n, 0)"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op12_line_dedup"] = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS MATERIALIZED (
  SELECT row, doc_id, i, line, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs)),
repeated AS (SELECT key, max(doc_id) AS last FROM placed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
judged AS (
  SELECT p.*, r.key IS NOT NULL AND p.doc_id IS DISTINCT FROM r.last AS gone FROM placed p LEFT JOIN repeated r ON r.key = p.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id"""
