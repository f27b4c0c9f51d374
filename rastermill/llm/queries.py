"""Queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from .bpe import op6_byte_bpe
from .chat import op2_chat_format
from .edit_counts import op4_edit_counts
from .html_text import op10_html_text
from .merkle import op11_merkle_manifest
from .mixing import op8_mixing
from .near_dedup import op1_near_dedup
from .neighbours import op9_neighbours
from .personal_data import op5_personal_data
from .quality import op7_quality_rules
from .resample import op12_resample
from .secrets import op3_secret_scan
from .toxicity import op13_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_chat_format, op3_secret_scan, op4_edit_counts, op5_personal_data, op6_byte_bpe, op7_quality_rules, op8_mixing, op9_neighbours, op10_html_text, op11_merkle_manifest, op12_resample, op13_toxicity)} | {"pipeline": pipeline.run}


_ESCAPED = r"length(regexp_replace({0}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))"
CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 23) AS BIGINT) AS formatted_chars, false AS rewrites
FROM rows GROUP BY conv_id
"""

_PASS = """
u{k} AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, rest FROM ({rows})),
f{k} AS (SELECT source, min(h) FILTER (upto > rest) AS t, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS l FROM u{k} GROUP BY source),
g{k} AS (SELECT f.source, coalesce(f.t, 9223372036854775807) AS t, f.l, coalesce(sum(u.size), 0) AS i FROM f{k} f LEFT JOIN u{k} u ON u.source IS NOT DISTINCT FROM f.source AND u.h = f.t GROUP BY ALL),
p{k} AS (SELECT p.* EXCLUDE (rest), coalesce(g.t, 9223372036854775807) AS t{k}, coalesce(g.l, p.rest) AS l{k}, coalesce(g.i, 0) AS i{k}, coalesce(g.l, p.rest) AS rest FROM {before} p LEFT JOIN g{k} g ON g.source IS NOT DISTINCT FROM p.source)"""
MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS lim, CAST(source_size AS DOUBLE) * 3 / weight AS fill FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM c WINDOW before AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT source, source_size, least(lim, coalesce((SELECT level FROM v WHERE level <= fill ORDER BY fill, level LIMIT 1) * weight, lim)) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest FROM a),
{_PASS.format(k=0, before="p", rows="SELECT d.*, rest FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source")},
{_PASS.format(k=1, before="p0", rows="SELECT d.*, rest FROM d JOIN p0 p ON d.source IS NOT DISTINCT FROM p.source WHERE h >= t0 AND size <= l0")},
{_PASS.format(k=2, before="p1", rows="SELECT d.*, rest FROM d JOIN p1 p ON d.source IS NOT DISTINCT FROM p.source WHERE h >= t0 AND size <= l0 AND h >= t1 AND size <= l1")},
q AS (SELECT *, i2 > 0 AND l2 * 2 >= i2 AS nearer FROM p2),
x AS (SELECT *, i0 > 0 AND i0 - l0 < CASE WHEN nearer THEN i2 - l2 ELSE l2 END AS over_first FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN over_first THEN h <= t0 ELSE h < t0 OR (size <= l0 AND (h < t1 OR (size <= l1 AND (h < t2 OR (h = t2 AND nearer))))) END::INT) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

#: All pairs that share a window, and all that links reach.
CLASSES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) ELSE [hash(array_to_string(w, ' '))] END) AS s FROM w),
c AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t ta ON ta.doc_id = x JOIN t tb ON tb.doc_id = y WHERE CAST(common AS DOUBLE) / (ta.total + tb.total - common) >= 0.8),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM documents JOIN m USING (doc_id)
"""


#: CRC-32 of a decimal number: the table of a byte's eight steps, then the digits.
_CRC = """crc AS (SELECT list(list_reduce(list_concat([b::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"""
_CRC_OF = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda x: ord(x)::UBIGINT)), lambda c, x: xor(c >> 8, crc.t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
#: Levels of eight that the text spells out: enough for two million documents a language, and for 4,096 languages.
_LEVELS, _TOPS = 7, 4


def _merkle_levels(name: str, nodes: str, levels: int) -> str:
    """Level k of `name`: a node's index, its tree's size there, its preimage (null where a tree has ended), digest."""
    parts, before = [], nodes
    for k in range(1, levels + 1):
        parts.append(f"{name}{k} AS (SELECT tree, idx // 8 AS idx, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN string_agg(digest, '' ORDER BY idx) END AS pre, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest FROM {before} GROUP BY tree, idx // 8, n)")
        before = f"{name}{k}"
    return ", ".join(parts)


def _merkle_walk(name: str, start: str, levels: int) -> str:
    """Siblings and folded digest (p, f) of `start`'s rows (tree, idx, p, f), level by level."""
    parts, before = [], start
    for k in range(1, levels + 1):
        slot = "64 * CAST(w.idx % 8 AS BIGINT)"
        head, rest = f"left(l.pre, {slot})", f"substr(l.pre, {slot} + 65)"
        parts.append(f"{name}{k} AS (SELECT w.* REPLACE (w.idx // 8 AS idx, CASE WHEN l.pre IS NULL THEN p ELSE p || {head} || {rest} END AS p, CASE WHEN l.pre IS NULL THEN f ELSE sha256({head} || f || {rest}) END AS f) FROM {before} w JOIN {'up' if name == 'w' else 'top'}{k} l ON l.tree = w.tree AND l.idx = w.idx // 8)")
        before = f"{name}{k}"
    return ", ".join(parts)


_RECORD = " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE = f"""
WITH {_CRC},
d AS (SELECT doc_id, lang, sha256({_RECORD} || {_FIELD("text")}) AS digest, sha256({_RECORD} || {_FIELD("CASE WHEN " + _CRC_OF.format("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS f FROM documents, crc),
leaves AS (SELECT doc_id, digest, digest AS leaf, f, '' AS p, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_merkle_levels("up", "leaves", _LEVELS)},
roots AS (SELECT tree, digest AS subroot FROM up{_LEVELS}),
nodes AS (SELECT 0 AS tree, tree AS idx, subroot AS digest, count(*) OVER () AS n FROM roots),
{_merkle_levels("top", "nodes", _TOPS)},
{_merkle_walk("w", "leaves", _LEVELS)},
whole AS (SELECT w.doc_id, w.leaf, r.subroot, w.p, w.f, 0 AS tree, w.tree AS idx FROM w{_LEVELS} w JOIN roots r ON r.tree = w.tree),
{_merkle_walk("v", "whole", _TOPS)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM top{_TOPS}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT digest FROM top{_TOPS}) AS verified FROM v{_TOPS}
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS UBIGINT))"
_CRC_BYTES = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {_BYTES}), lambda c, x: xor(c >> 8, crc.t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"
RESAMPLE = f"""
WITH {_CRC},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT r, unnest({_RUNS}) AS f FROM d),
g AS MATERIALIZED (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
b AS MATERIALIZED (SELECT f, CAST({_CRC_BYTES.format("f")} % 10000 AS INTEGER) AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM g)), crc),
n AS MATERIALIZED (SELECT r, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
s AS (SELECT b, CAST(sum(n) AS DOUBLE) AS s FROM n GROUP BY b),
t AS (SELECT b, CAST(count(*) AS DOUBLE) AS t FROM g JOIN b USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
v AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN gain USING (b) GROUP BY r),
x AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, 5 * count(*) OVER (PARTITION BY able) // 100 AS take FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= take THEN place END AS rank FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": CLASSES, "op2_chat_format": CHAT, "op8_mixing": MIX, "op11_merkle_manifest": MERKLE, "op12_resample": RESAMPLE}
