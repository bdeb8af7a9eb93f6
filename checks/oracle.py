"""SQL counterparts of the registered queries.

Written from the rules, not from the package: type trees of the derived catalogue and of the searched
texts are spelt out as VALUES, and alignment, pointer peeling, bindings, alias readings and scores are
worked out by joins and windows over them.
"""

from __future__ import annotations

RET = 1_000_000

# Numbers of each part.
FNS = """
f AS (
  SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS item_id, replace(lower(p_brand), '#', '_') AS crate,
         replace(p_name, ' ', '_') AS name, p_partkey % 5 = 0 AS is_method, CAST(p_size % 4 AS INT) AS n_args,
         CAST((p_partkey * 7 + p_size) % 20 AS INT) AS arg0,
         CASE WHEN p_type <> 'PROMO' THEN CAST((p_partkey * 3 + p_size) % 20 AS INT) END AS ret,
         CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS docs, p_partkey // 50 AS block
  FROM part),
fns AS (
  SELECT *, CASE WHEN is_method THEN 'impl:' || block ELSE '' END AS impl_id
  FROM f WHERE CASE WHEN is_method THEN block % 10 <> 9 ELSE p_partkey % 97 <> 0 END)"""

# Type trees by number: reading ('-', W as written, A expanded), position, pointers, core.
TYPES = """
base(tid, reading, seq, path, spine, refs, kind, name, n) AS (VALUES
  (0, '-', 0, '', '', [], 'prim', 'i32', NULL),
  (1, '-', 0, '', '', ['&'], 'prim', 'str', NULL),
  (2, '-', 0, '', '', [], 'prim', 'bool', NULL),
  (3, '-', 0, '', '', [], 'path', 'String', NULL),
  (4, '-', 0, '', '', [], 'path', 'Vec', 1), (4, '-', 1, '0', 'path', [], 'generic', 'T', NULL),
  (5, '-', 0, '', '', [], 'path', 'Option', 1), (5, '-', 1, '0', 'path', [], 'generic', 'T', NULL),
  (6, '-', 0, '', '', [], 'path', 'Option', 1), (6, '-', 1, '0', 'path', [], 'prim', 'i32', NULL),
  (7, '-', 0, '', '', [], 'path', 'Result', 2), (7, '-', 1, '0', 'path', [], 'generic', 'T', NULL),
  (7, '-', 2, '1', 'path', [], 'generic', 'E', NULL),
  (8, '-', 0, '', '', [], 'path', 'Option', 1), (8, '-', 1, '0', 'path', [], 'path', 'Result', 2),
  (8, '-', 2, '0.0', 'path.path', [], 'generic', 'T', NULL), (8, '-', 3, '0.1', 'path.path', [], 'generic', 'E', NULL),
  (9, '-', 0, '', '', [], 'path', 'Result', 2), (9, '-', 1, '0', 'path', [], 'path', 'Option', 1),
  (9, '-', 2, '0.0', 'path.path', [], 'generic', 'T', NULL), (9, '-', 3, '1', 'path', [], 'generic', 'E', NULL),
  (10, '-', 0, '', '', ['&m'], 'path', 'Vec', 1), (10, '-', 1, '0', 'path', [], 'prim', 'u8', NULL),
  (11, '-', 0, '', '', ['&'], 'slice', NULL, 1), (11, '-', 1, '0', 'slice', [], 'prim', 'u8', NULL),
  (12, '-', 0, '', '', [], 'tuple', NULL, 2), (12, '-', 1, '0', 'tuple', [], 'prim', 'i32', NULL),
  (12, '-', 2, '1', 'tuple', [], 'prim', 'bool', NULL),
  (13, '-', 0, '', '', [], 'generic', 'T', NULL),
  (14, '-', 0, '', '', [], 'path', 'HashMap', 2), (14, '-', 1, '0', 'path', [], 'generic', 'K', NULL),
  (14, '-', 2, '1', 'path', [], 'generic', 'V', NULL),
  (15, '-', 0, '', '', ['*c'], 'prim', 'u8', NULL),
  (16, 'W', 0, '', '', [], 'path', 'Result', 1), (16, 'W', 1, '0', 'path', [], 'generic', 'T', NULL),
  (16, 'A', 2, '', '', [], 'path', 'Result', 2), (16, 'A', 3, '0', 'path', [], 'generic', 'T', NULL),
  (16, 'A', 4, '1', 'path', [], 'path', 'Error', NULL),
  (17, 'W', 0, '', '', ['&'], 'path', 'Result', 1), (17, 'W', 1, '0', 'path', [], 'generic', 'T', NULL),
  (17, 'A', 2, '', '', ['&'], 'path', 'Result', 2), (17, 'A', 3, '0', 'path', [], 'generic', 'T', NULL),
  (17, 'A', 4, '1', 'path', [], 'path', 'Error', NULL),
  (18, '-', 0, '', '', [], 'other', NULL, NULL),
  (19, '-', 0, '', '', [], 'path', 'Cow', 2), (19, '-', 1, '0', 'path', [], 'nontype', NULL, NULL),
  (19, '-', 2, '1', 'path', [], 'prim', 'str', NULL),
  (20, '-', 0, '', '', [], 'path', 'Widget', NULL),
  (21, '-', 0, '', '', [], 'path', 'Shape', 1), (21, '-', 1, '0', 'path', [], 'generic', 'T', NULL),
  (22, '-', 0, '', '', [], 'path', 'Bits', NULL),
  (23, '-', 0, '', '', [], 'prim', 'i32', NULL),
  (24, '-', 0, '', '', [], 'tuple', NULL, 2), (24, '-', 1, '0', 'tuple', [], 'prim', 'i32', NULL),
  (24, '-', 2, '1', 'tuple', [], 'prim', 'bool', NULL),
  (25, '-', 0, '', '', [], 'slice', NULL, 1), (25, '-', 1, '0', 'slice', [], 'prim', 'u8', NULL),
  (26, '-', 0, '', '', [], 'other', NULL, NULL),
  (27, '-', 0, '', '', ['*c'], 'prim', 'u8', NULL),
  (28, '-', 0, '', '', ['&'], 'prim', 'str', NULL)),
ty AS (
  SELECT tid, reading, seq, path, spine, CAST(refs AS VARCHAR[]) AS refs, kind, name, n FROM base
  UNION ALL
  SELECT tid + 10, reading, seq, path, spine,
         CASE WHEN path = '' THEN list_prepend('&', CAST(refs AS VARCHAR[])) ELSE CAST(refs AS VARCHAR[]) END,
         kind, name, n
  FROM base WHERE tid BETWEEN 20 AND 28)"""

# Types per slot; 20 and up are receivers (30 and up behind a reference) in the place of Self.
SLOTS = f"""
slots AS (
  SELECT item_id, CAST(k AS INT) AS slot,
         CASE WHEN k = 0 AND is_method THEN 20 + 10 * CAST(p_partkey // 5 % 2 AS INT) + CAST(block % 10 AS INT)
              ELSE CAST((arg0 + 5 * k) % 20 AS INT) END AS tid
  FROM fns, (VALUES (0), (1), (2)) ks(k) WHERE k < n_args
  UNION ALL SELECT item_id, {RET}, ret FROM fns WHERE ret IS NOT NULL),
inodes AS (
  SELECT item_id, slot, tid, reading, seq, path, spine, refs, kind, name, n FROM slots JOIN ty USING (tid)
  UNION ALL SELECT item_id, -1, NULL, '-', 0, '', '', CAST([] AS VARCHAR[]), 'arity', NULL, n_args FROM fns
  UNION ALL SELECT item_id, {RET}, NULL, '-', 0, '', '', CAST([] AS VARCHAR[]), 'unit', NULL, NULL FROM fns WHERE ret IS NULL)"""

TEXTS = f"""
texts(qid, text, q_name) AS (VALUES
  (0, '(i32) -> bool', NULL), (1, '(&str) -> String', NULL), (2, '(T) -> Option<T>', NULL),
  (3, '(Option<Result<T, E>>) -> Result<Option<T>, E>', NULL), (4, '(Vec<T>, _) -> T', NULL),
  (5, '(&mut Vec<u8>) -> ()', NULL), (6, '(..) -> bool', NULL), (7, '()', NULL),
  (8, '((i32, bool)) -> i32', NULL), (9, '([u8])', NULL), (10, 'fn blue_bolt', 'blue_bolt'),
  (11, 'fn red_ring(i32) -> i32', 'red_ring'), (12, 'fn (a0: i32, b: _) -> Option<i32>', NULL),
  (13, '(&Result<i32, E>, &mut [u8])', NULL), (14, 'fn new_rod(x0: &str) -> String', 'new_rod')),
argnames(qid, slot, arg) AS (VALUES (12, 0, 'a0'), (12, 1, 'b'), (14, 0, 'x0')),
qraw(qid, slot, path, spine, refs, kind, name, n, canon) AS (VALUES
  (0, -1, '', '', [], 'arity', NULL, 1, ''), (0, 0, '', '', [], 'prim', 'i32', NULL, 'i32'),
  (0, {RET}, '', '', [], 'prim', 'bool', NULL, 'bool'),
  (1, -1, '', '', [], 'arity', NULL, 1, ''), (1, 0, '', '', ['&'], 'prim', 'str', NULL, 'str'),
  (1, {RET}, '', '', [], 'path', 'String', NULL, 'String'),
  (2, -1, '', '', [], 'arity', NULL, 1, ''), (2, 0, '', '', [], 'generic', 'T', NULL, 'T'),
  (2, {RET}, '', '', [], 'path', 'Option', 1, 'Option<T>'), (2, {RET}, '0', 'path', [], 'generic', 'T', NULL, 'T'),
  (3, -1, '', '', [], 'arity', NULL, 1, ''), (3, 0, '', '', [], 'path', 'Option', 1, 'Option<Result<T,E>>'),
  (3, 0, '0', 'path', [], 'path', 'Result', 2, 'Result<T,E>'), (3, 0, '0.0', 'path.path', [], 'generic', 'T', NULL, 'T'),
  (3, 0, '0.1', 'path.path', [], 'generic', 'E', NULL, 'E'),
  (3, {RET}, '', '', [], 'path', 'Result', 2, 'Result<Option<T>,E>'),
  (3, {RET}, '0', 'path', [], 'path', 'Option', 1, 'Option<T>'), (3, {RET}, '0.0', 'path.path', [], 'generic', 'T', NULL, 'T'),
  (3, {RET}, '1', 'path', [], 'generic', 'E', NULL, 'E'),
  (4, -1, '', '', [], 'arity', NULL, 2, ''), (4, 0, '', '', [], 'path', 'Vec', 1, 'Vec<T>'),
  (4, 0, '0', 'path', [], 'generic', 'T', NULL, 'T'), (4, {RET}, '', '', [], 'generic', 'T', NULL, 'T'),
  (5, -1, '', '', [], 'arity', NULL, 1, ''), (5, 0, '', '', ['&m'], 'path', 'Vec', 1, 'Vec<u8>'),
  (5, 0, '0', 'path', [], 'prim', 'u8', NULL, 'u8'), (5, {RET}, '', '', [], 'unit', NULL, NULL, ''),
  (6, {RET}, '', '', [], 'prim', 'bool', NULL, 'bool'),
  (7, -1, '', '', [], 'arity', NULL, 0, ''), (7, {RET}, '', '', [], 'unit', NULL, NULL, ''),
  (8, -1, '', '', [], 'arity', NULL, 1, ''), (8, 0, '', '', [], 'tuple', NULL, 2, '(i32,bool)'),
  (8, 0, '0', 'tuple', [], 'prim', 'i32', NULL, 'i32'), (8, 0, '1', 'tuple', [], 'prim', 'bool', NULL, 'bool'),
  (8, {RET}, '', '', [], 'prim', 'i32', NULL, 'i32'),
  (9, -1, '', '', [], 'arity', NULL, 1, ''), (9, 0, '', '', [], 'slice', NULL, 1, '[u8]'),
  (9, 0, '0', 'slice', [], 'prim', 'u8', NULL, 'u8'), (9, {RET}, '', '', [], 'unit', NULL, NULL, ''),
  (11, -1, '', '', [], 'arity', NULL, 1, ''), (11, 0, '', '', [], 'prim', 'i32', NULL, 'i32'),
  (11, {RET}, '', '', [], 'prim', 'i32', NULL, 'i32'),
  (12, -1, '', '', [], 'arity', NULL, 2, ''), (12, 0, '', '', [], 'prim', 'i32', NULL, 'i32'),
  (12, {RET}, '', '', [], 'path', 'Option', 1, 'Option<i32>'), (12, {RET}, '0', 'path', [], 'prim', 'i32', NULL, 'i32'),
  (13, -1, '', '', [], 'arity', NULL, 2, ''), (13, 0, '', '', ['&'], 'path', 'Result', 2, 'Result<i32,E>'),
  (13, 0, '0', 'path', [], 'prim', 'i32', NULL, 'i32'), (13, 0, '1', 'path', [], 'generic', 'E', NULL, 'E'),
  (13, 1, '', '', ['&m'], 'slice', NULL, 1, '[u8]'), (13, 1, '0', 'slice', [], 'prim', 'u8', NULL, 'u8'),
  (13, {RET}, '', '', [], 'unit', NULL, NULL, ''),
  (14, -1, '', '', [], 'arity', NULL, 1, ''), (14, 0, '', '', ['&'], 'prim', 'str', NULL, 'str'),
  (14, {RET}, '', '', [], 'path', 'String', NULL, 'String')),
qnodes AS (SELECT qid, slot, path, spine, CAST(refs AS VARCHAR[]) AS refs, kind, name, n, canon FROM qraw)"""

# Pointer chains: every pair that occurs, taken apart from the outside.
PEEL = """
peel(q0, i0, q, i, k) AS (
  SELECT q.refs, i.refs, q.refs, i.refs, 0
  FROM (SELECT DISTINCT refs FROM qnodes) q, (SELECT DISTINCT refs FROM ty) i
  UNION ALL
  SELECT q0, i0, CASE WHEN len(q) > 0 AND q[1][1] = i[1][1] THEN q[2:] ELSE q END, i[2:],
         k + CASE WHEN len(q) > 0 AND q[1] = i[1] THEN 0 ELSE 1 END
  FROM peel WHERE len(i) > 0),
peeled AS (SELECT q0, i0, q AS rest, k FROM peel WHERE len(i) = 0)"""

# Aligned nodes; an alias reached with n pointers left has readings 0 and 1 .. n + 1.
ALIGNED = """
met AS (
  SELECT q.qid, i.item_id, i.slot, i.tid, i.reading, i.seq, i.path, q.refs AS q_refs, i.refs AS i_refs,
         q.kind AS qk, i.kind AS ik, q.name AS qn, i.name AS inn, q.n AS q_n, i.n AS i_n, q.canon, p.rest, p.k
  FROM qnodes q JOIN inodes i ON q.slot = i.slot AND q.path = i.path AND q.spine = i.spine
  JOIN peeled p ON p.q0 = q.refs AND p.i0 = i.refs),
roots AS (SELECT qid, item_id, slot, max(len(rest)) AS left_over FROM met WHERE path = '' AND reading <> '-' GROUP BY ALL),
read AS (
  SELECT m.*, CAST(0 AS BIGINT) AS b, rest AS rest2, k AS k2 FROM met m WHERE reading = '-'
  UNION ALL
  SELECT m.*, 0, CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE rest END,
         CASE WHEN path = '' THEN k + len(rest) ELSE k END
  FROM met m WHERE reading = 'W'
  UNION ALL
  SELECT m.*, g.j + 1, CASE WHEN path = '' THEN rest[len(rest) - g.j + 1:] ELSE rest END,
         CASE WHEN path = '' THEN k + len(rest) - g.j ELSE k END
  FROM met m JOIN roots r USING (qid, item_id, slot), LATERAL (SELECT unnest(generate_series(0, r.left_over)) AS j) g
  WHERE reading = 'A'),
raw AS (
  SELECT qid, item_id, slot, tid, reading, b, seq, path, q_refs, i_refs, rest2 AS rest, k2 AS k,
    ik IN ('arity', 'unit', 'nontype') OR qk = 'unit' AS plain,
    CASE WHEN ik = 'generic' AND qk <> 'unit' THEN inn END AS generic,
    CASE WHEN ik = 'generic' AND qk <> 'unit' THEN CASE WHEN len(rest2) > 0 THEN array_to_string(rest2, ' ') || ' ' ELSE '' END || canon END AS canon,
    CASE WHEN ik = 'arity' THEN CAST(abs(q_n - i_n) AS DOUBLE)
         WHEN ik = 'unit' AND qk = 'unit' THEN 0.0
         WHEN ik IN ('unit', 'nontype') OR qk = 'unit' THEN 1.0
         WHEN ik = 'generic' THEN 0.0
         WHEN ik <> qk THEN 1.0
         WHEN ik = 'prim' THEN CASE WHEN qn = inn THEN 0.0 ELSE 1.0 END
         WHEN ik = 'tuple' THEN CAST(abs(q_n - i_n) AS DOUBLE)
         WHEN ik = 'slice' THEN 0.0
         WHEN ik = 'path' THEN levenshtein(qn, inn) / CAST(greatest(strlen(qn), strlen(inn)) AS DOUBLE)
              + CASE WHEN i_n IS NULL THEN coalesce(q_n, 0) ELSE 0 END
         ELSE 1.0 END AS s0,
    CASE WHEN ik = 'arity' THEN CASE WHEN q_n = 0 AND i_n = 0 THEN 1 ELSE abs(q_n - i_n) END
         WHEN ik IN ('unit', 'nontype') OR qk = 'unit' THEN 1
         WHEN ik = 'generic' THEN 0
         WHEN ik = 'tuple' AND qk = 'tuple' THEN 1 + abs(q_n - i_n)
         WHEN ik = 'path' AND qk = 'path' THEN 1 + CASE WHEN i_n IS NULL THEN coalesce(q_n, 0) ELSE 0 END
         ELSE 1 END AS c0,
    CASE WHEN ik IN ('arity', 'unit', 'nontype') OR qk = 'unit' THEN 0
         WHEN ik = 'generic' THEN k2 ELSE k2 + len(rest2) END AS steps
  FROM read),
aligned AS (SELECT *, s0 + 0.25 * steps AS s, CAST(c0 + steps AS BIGINT) AS c FROM raw),
bound AS (
  SELECT * REPLACE (
      CASE WHEN generic IS NULL THEN s
           WHEN row_number() OVER w = 1 THEN s + 0.25
           WHEN first_value(canon) OVER w = canon THEN s ELSE s + 1 END AS s,
      CASE WHEN generic IS NULL THEN c ELSE c + 1 END AS c)
  FROM aligned
  WINDOW w AS (PARTITION BY qid, item_id, generic ORDER BY slot, b, seq)),
per_reading AS (SELECT qid, item_id, slot, b, sum(s) AS s FROM bound WHERE reading <> '-' GROUP BY ALL),
choice AS (
  SELECT qid, item_id, slot, b FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, item_id, slot ORDER BY round(s, 9), b) AS r FROM per_reading)
  WHERE r = 1),
chosen AS (
  SELECT x.* FROM bound x LEFT JOIN choice y ON x.qid = y.qid AND x.item_id = y.item_id AND x.slot = y.slot
  WHERE x.reading = '-' OR x.b = y.b),
sums AS (SELECT qid, item_id, sum(s) AS s, CAST(sum(c) AS BIGINT) AS c FROM chosen GROUP BY ALL)"""

# Names on top of the signature, then the threshold.
HITS = """
dist AS (
  SELECT t.qid, f.item_id, levenshtein(t.q_name, f.name) / CAST(greatest(strlen(t.q_name), strlen(f.name)) AS DOUBLE) AS d
  FROM texts t, fns f WHERE t.q_name IS NOT NULL),
argdist AS (
  SELECT a.qid, f.item_id,
         sum(levenshtein(a.arg, 'a' || a.slot) / CAST(greatest(strlen(a.arg), 2) AS DOUBLE)) AS d, count(*) AS n
  FROM argnames a JOIN fns f ON a.slot < f.n_args GROUP BY ALL),
scored AS (
  SELECT t.qid, t.text, f.crate, f.item_id, f.impl_id, f.name, f.docs, f.is_method, f.block,
         coalesce(s.s, 0) + coalesce(d.d, 0) + coalesce(a.d, 0) AS s,
         coalesce(s.c, 0) + CASE WHEN d.d IS NULL THEN 0 ELSE 1 END + coalesce(a.n, 0) AS c
  FROM texts t CROSS JOIN fns f
  LEFT JOIN sums s ON s.qid = t.qid AND s.item_id = f.item_id
  LEFT JOIN dist d ON d.qid = t.qid AND d.item_id = f.item_id
  LEFT JOIN argdist a ON a.qid = t.qid AND a.item_id = f.item_id),
withscore AS (SELECT *, CAST(s / c AS FLOAT) AS score FROM scored WHERE c > 0),
hits AS (SELECT * FROM withscore WHERE score < CAST(0.4 AS FLOAT))"""

_RECEIVER_PATH = """CASE CAST(block % 10 AS INT) WHEN 0 THEN crate || '/types/Widget' WHEN 1 THEN crate || '/types/Shape'
    WHEN 2 THEN crate || '/types/Bits' WHEN 3 THEN 'i32' WHEN 4 THEN 'tuple' WHEN 5 THEN 'slice' WHEN 6 THEN 'array'
    WHEN 7 THEN 'pointer' ELSE 'reference' END"""
_RECEIVER_PAGE = """CASE CAST(block % 10 AS INT) WHEN 0 THEN crate || '/types/struct.Widget.html'
    WHEN 1 THEN crate || '/types/enum.Shape.html' WHEN 2 THEN crate || '/types/union.Bits.html'
    WHEN 3 THEN 'primitive.i32.html' WHEN 4 THEN 'primitive.tuple.html' WHEN 5 THEN 'primitive.slice.html'
    WHEN 6 THEN 'primitive.array.html' WHEN 7 THEN 'primitive.pointer.html' ELSE 'primitive.reference.html' END"""
PATH = f"CASE WHEN is_method THEN {_RECEIVER_PATH} || '/' || name ELSE crate || '/' || name END"
LINK = f"CASE WHEN is_method THEN {_RECEIVER_PAGE} || '#method.' || name ELSE crate || '/fn.' || name || '.html' END"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


ROWS = (FNS, TYPES, SLOTS, TEXTS, PEEL, ALIGNED)
SEARCH = (*ROWS, HITS)

SCOPES = """
odd AS (SELECT DISTINCT crate FROM f WHERE CAST(split_part(crate, '_', 2) AS INT) % 2 = 1),
scopes AS (
  SELECT DISTINCT 'set:all' AS scope, crate FROM f UNION ALL SELECT 'set:odd', crate FROM odd
  UNION ALL SELECT 'set:odd', 'brand_' || (count(DISTINCT crate) + 75) FROM f
  UNION ALL SELECT DISTINCT 'crate:' || crate, crate FROM f)"""

# Package files: cut off at the end, without paths, skipped by their names, with a member of no kind.
FILES = """
packages AS (
  SELECT DISTINCT crate, CASE WHEN num IN (14, 34) THEN '_' || crate ELSE crate END AS file,
         CASE WHEN num % 10 = 5 AND num % 20 < 10 THEN 'no JSON' WHEN num % 10 = 5 THEN 'no index or paths'
              WHEN num IN (14, 34) THEN 'skipped by its name' WHEN num IN (24, 44) THEN 'unknown layout' END AS fault
  FROM (SELECT *, CAST(split_part(crate, '_', 2) AS INT) AS num FROM f)),
good AS (SELECT crate FROM packages WHERE fault IS NULL)"""

SHOWN = f"""text, scope, rank, round(CAST(score AS DOUBLE), 6) AS score, name, {PATH} AS path, {LINK} AS link, docs,
  crate, item_id"""


def _ranked(source: str, group: str, k: int | None) -> str:
    limit = f"WHERE rank <= {k}" if k else ""
    return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (
        PARTITION BY {group} ORDER BY score, crate, item_id, impl_id) AS INT) AS rank FROM {source}) {limit})"""


# Parser view of the written types; as arguments the last four do not parse.
WRITTEN = f"""
wr(tid, path, spine, refs, kind, name, n, canon) AS (VALUES
  (0, '', '', '', 'prim', 'i32', NULL, 'i32'), (1, '', '', '&', 'prim', 'str', NULL, 'str'),
  (2, '', '', '', 'prim', 'bool', NULL, 'bool'), (3, '', '', '', 'path', 'String', NULL, 'String'),
  (4, '', '', '', 'path', 'Vec', 1, 'Vec<T>'), (4, '0', 'path', '', 'generic', 'T', NULL, 'T'),
  (5, '', '', '', 'path', 'Option', 1, 'Option<T>'), (5, '0', 'path', '', 'generic', 'T', NULL, 'T'),
  (6, '', '', '', 'path', 'Option', 1, 'Option<i32>'), (6, '0', 'path', '', 'prim', 'i32', NULL, 'i32'),
  (7, '', '', '', 'path', 'Result', 2, 'Result<T,E>'), (7, '0', 'path', '', 'generic', 'T', NULL, 'T'),
  (7, '1', 'path', '', 'generic', 'E', NULL, 'E'),
  (8, '', '', '', 'path', 'Option', 1, 'Option<Result<T,E>>'), (8, '0', 'path', '', 'path', 'Result', 2, 'Result<T,E>'),
  (8, '0.0', 'path.path', '', 'generic', 'T', NULL, 'T'), (8, '0.1', 'path.path', '', 'generic', 'E', NULL, 'E'),
  (9, '', '', '', 'path', 'Result', 2, 'Result<Option<T>,E>'), (9, '0', 'path', '', 'path', 'Option', 1, 'Option<T>'),
  (9, '0.0', 'path.path', '', 'generic', 'T', NULL, 'T'), (9, '1', 'path', '', 'generic', 'E', NULL, 'E'),
  (10, '', '', '&m', 'path', 'Vec', 1, 'Vec<u8>'), (10, '0', 'path', '', 'prim', 'u8', NULL, 'u8'),
  (11, '', '', '&', 'slice', NULL, 1, '[u8]'), (11, '0', 'slice', '', 'prim', 'u8', NULL, 'u8'),
  (12, '', '', '', 'tuple', NULL, 2, '(i32,bool)'), (12, '0', 'tuple', '', 'prim', 'i32', NULL, 'i32'),
  (12, '1', 'tuple', '', 'prim', 'bool', NULL, 'bool'),
  (13, '', '', '', 'generic', 'T', NULL, 'T'),
  (14, '', '', '', 'path', 'HashMap', 2, 'HashMap<K,V>'), (14, '0', 'path', '', 'generic', 'K', NULL, 'K'),
  (14, '1', 'path', '', 'generic', 'V', NULL, 'V'),
  (15, '', '', '*c', 'prim', 'u8', NULL, 'u8'),
  (16, '', '', '', 'path', 'io', NULL, 'io'), (17, '', '', '&', 'path', 'io', NULL, 'io'),
  (19, '', '', '', 'path', 'Cow', NULL, 'Cow')),
spelt(tid, t) AS (VALUES (0, 'i32'), (1, '&str'), (2, 'bool'), (3, 'String'), (4, 'Vec<T>'), (5, 'Option<T>'),
  (6, 'Option<i32>'), (7, 'Result<T, E>'), (8, 'Option<Result<T, E>>'), (9, 'Result<Option<T>, E>'),
  (10, '&mut Vec<u8>'), (11, '&[u8]'), (12, '(i32, bool)'), (13, 'T'), (14, 'HashMap<K, V>'), (15, '*const u8'),
  (16, 'io::Result<T>'), (17, '&io::Result<T>'), (18, '[u8; 4]'), (19, 'Cow<''a, str>')),
args AS (
  SELECT f.*, CAST(k AS INT) AS k, CAST((arg0 + 5 * k) % 20 AS INT) AS tid
  FROM f, (VALUES (0), (1), (2)) ks(k) WHERE k < n_args),
argtext AS (
  SELECT item_id, string_agg(CASE WHEN is_method THEN 'a' || k || ': ' ELSE '' END || t, ', ' ORDER BY k) AS list,
         string_agg(CASE WHEN is_method THEN 'a' || k ELSE '-' END, ',' ORDER BY k) AS names, max(tid) > 15 AS broken
  FROM args JOIN spelt USING (tid) GROUP BY item_id),
written AS (
  SELECT f.*, '(' || coalesce(a.list, '') || ')' || coalesce(' -> ' || t, '') AS decl, coalesce(a.names, '') AS arg_names,
         NOT coalesce(a.broken, false) AS ok
  FROM f LEFT JOIN argtext a USING (item_id) LEFT JOIN spelt ON spelt.tid = f.ret)"""

ORACLE: dict[str, str] = {
    "search_topk": f"""{_with(*SEARCH)}, hs AS (SELECT *, 'set:all' AS scope FROM hits)
        SELECT {SHOWN} FROM {_ranked('hs', 'text', 30)}""",
    "scoped_search_topk": f"""{_with(*SEARCH, SCOPES)}, hs AS (
          SELECT h.*, s.scope FROM hits h JOIN scopes s ON s.crate = h.crate
           AND s.scope = CASE h.qid % 3 WHEN 0 THEN 'set:all' WHEN 1 THEN 'set:odd' ELSE 'crate:brand_12' END)
        SELECT {SHOWN} FROM {_ranked('hs', 'text, scope', 30)}""",
    "search_all_hits": f"""{_with(*SEARCH)} SELECT text, crate, item_id, round(CAST(score AS DOUBLE), 6) AS score FROM hits""",
    "search_wide_threshold": f"""{_with(*SEARCH)}, hs AS (SELECT *, 'set:all' AS scope FROM withscore WHERE score < CAST(0.6 AS FLOAT))
        SELECT {SHOWN} FROM {_ranked('hs', 'text', 5)}""",
    "hits_json": f"""{_with(*SEARCH)}
        SELECT text, 'set:all' AS scope, rank, '{{"name":"' || name || '","path":["' || replace({PATH}, '/', '","')
          || '"],"link":["' || replace({LINK}, '/', '","') || '"],"docs":' || coalesce('"' || docs || '"', 'null') || '}}' AS hit
        FROM {_ranked('hits', 'text', 30)}""",
    "query_log_answers": f"""{_with(*SEARCH, SCOPES)}, hs AS (
          SELECT h.*, s.scope FROM hits h JOIN scopes s ON s.crate = h.crate WHERE s.scope IN ('set:all', 'set:odd')),
        best AS (SELECT * FROM {_ranked('hs', 'qid, scope', 30)})
        SELECT e.event_id AS query_id, b.text, b.scope, b.rank, b.name, b.crate, b.item_id, round(CAST(b.score AS DOUBLE), 6) AS score
        FROM events e JOIN best b ON b.qid = e.event_id % 15
         AND b.scope = CASE WHEN e.event_type = 'error' THEN 'set:odd' ELSE 'set:all' END""",
    "name_search_topk": f"""{_with(FNS)}, asked AS (SELECT DISTINCT 'fn ' || substr(name, 2) AS text, substr(name, 2) AS q FROM f),
        hs AS (SELECT a.text, 'set:all' AS scope, fns.*,
                 CAST(levenshtein(a.q, name) / CAST(greatest(strlen(a.q), strlen(name)) AS DOUBLE) AS FLOAT) AS score
               FROM asked a, fns),
        near AS (SELECT * FROM hs WHERE score < CAST(0.4 AS FLOAT))
        SELECT {SHOWN} FROM {_ranked('near', 'text', 30)}""",
    "name_search_urls": """WITH n AS (
          SELECT DISTINCT regexp_extract(regexp_extract(url, '//(.*)\\.example\\.', 1), '[^.]*$') AS name FROM pages)
        SELECT a.name AS query, b.name, round(levenshtein(a.name, b.name) / CAST(greatest(strlen(a.name), strlen(b.name)) AS DOUBLE), 6) AS distance
        FROM n a, n b WHERE CAST(levenshtein(a.name, b.name) / CAST(greatest(strlen(a.name), strlen(b.name)) AS DOUBLE) AS FLOAT) < CAST(0.4 AS FLOAT)""",
    "scope_listing": f"{_with(FNS, SCOPES)} SELECT DISTINCT scope FROM scopes",
    "scope_check": f"""WITH {FNS}, {SCOPES}, asked AS (
          SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 'set:odd' WHEN 1 THEN 'crate:brand_' || (s_nationkey + 5)
             WHEN 2 THEN 'brand_' || s_nationkey ELSE 'crate:brand_1:x' END AS scope FROM supplier),
        known AS (SELECT DISTINCT scope FROM scopes)
        SELECT query_id, scope, CAST(NULL AS VARCHAR) AS crate, 'misspelt' AS problem FROM asked WHERE query_id % 4 IN (2, 3)
        UNION ALL SELECT query_id, scope, NULL, 'unknown scope' FROM asked ANTI JOIN known USING (scope) WHERE query_id % 4 IN (0, 1)
        UNION ALL SELECT query_id, scope, crate, 'unknown crate' FROM asked
          JOIN (SELECT scope, crate FROM scopes ANTI JOIN f USING (crate)) lacking USING (scope)""",
    "file_items": f"""{_with(FNS, FILES)}, g AS (SELECT f.* FROM f SEMI JOIN good USING (crate))
        SELECT crate, CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, count(*) AS n, 'item' AS source FROM g GROUP BY ALL
        UNION ALL SELECT crate, 'impl', count(DISTINCT block), 'item' FROM g WHERE is_method GROUP BY ALL
        UNION ALL SELECT DISTINCT crate, 'typedef', 1, 'item' FROM g
        UNION ALL SELECT crate, 'function', count(*), 'path' FROM g WHERE NOT is_method AND p_partkey % 97 <> 0 GROUP BY ALL
        UNION ALL SELECT DISTINCT g.crate, k.kind, 1, 'path' FROM g, (VALUES ('struct'), ('enum'), ('union')) k(kind)""",
    "file_problems": f"""{_with(FNS, FILES)}
        SELECT file, fault AS reason FROM packages WHERE fault IS NOT NULL
        UNION ALL VALUES ('words', 'no list of names'), ('holes', 'a name is null')""",
    "file_scopes": f"""{_with(FNS, FILES, SCOPES)}
        SELECT 'set:all' AS scope, crate FROM packages
        UNION ALL SELECT scope, crate FROM scopes WHERE scope = 'set:odd'
        UNION ALL SELECT 'set:holes', 'brand_12'
        UNION ALL SELECT 'crate:' || file, file FROM packages""",
    "file_search": f"""{_with(*SEARCH, FILES)}, hs AS (SELECT h.*, 'set:all' AS scope FROM hits h SEMI JOIN good USING (crate))
        SELECT {SHOWN} FROM {_ranked('hs', 'text', 30)}""",
    "kept_items": f"""{_with(FNS)}
        SELECT crate, CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, count(*) AS n, 'item' AS source FROM f GROUP BY ALL
        UNION ALL SELECT crate, 'impl', count(DISTINCT block), 'item' FROM f WHERE is_method GROUP BY ALL
        UNION ALL SELECT DISTINCT crate, 'typedef', 1, 'item' FROM f
        UNION ALL SELECT crate, 'function', count(*), 'path' FROM f WHERE NOT is_method AND p_partkey % 97 <> 0 GROUP BY ALL
        UNION ALL SELECT DISTINCT f.crate, k.kind, 1, 'path' FROM f, (VALUES ('struct'), ('enum'), ('union')) k(kind)""",
    "catalog_by_kind": f"""{_with(FNS, TYPES, SLOTS)},
        trees AS (SELECT item_id, string_agg(concat_ws(':', slot, reading, seq, path, spine, array_to_string(refs, ' '), kind,
                    coalesce(name, '?'), coalesce(n, -1)), ';' ORDER BY slot, seq) AS tree FROM inodes GROUP BY item_id)
        SELECT crate, CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, count(*) AS n, count(docs) AS n_docs,
               count(DISTINCT tree) AS n_signatures
        FROM fns JOIN trees USING (item_id) GROUP BY ALL""",
    "flattened_nodes": f"""{_with(FNS, TYPES, SLOTS)}
        SELECT item_id, slot, path, spine, array_to_string(refs, ' ') AS refs, kind, name, n AS n_children, reading FROM inodes""",
    "hit_links": f"{_with(FNS)} SELECT crate, item_id, {PATH} AS path, {LINK} AS link FROM fns",
    "dangling_refs": f"""{_with(FNS)}
        SELECT crate, item_id, '' AS impl_id, 'no path' AS reason, item_id AS missing_id FROM f WHERE NOT is_method AND p_partkey % 97 = 0
        UNION ALL SELECT DISTINCT crate, CAST(NULL AS VARCHAR), 'impl:' || block, 'no member', 'gone:' || block
        FROM f WHERE is_method AND block % 10 <> 9 AND block % 11 = 0""",
    "signature_nodes": f"""{_with(FNS, WRITTEN)}
        SELECT item_id, -1 AS slot, '' AS path, '' AS spine, '' AS refs, 'arity' AS kind, CAST(NULL AS VARCHAR) AS name,
               n_args AS n_children, '' AS canon FROM written WHERE ok
        UNION ALL SELECT item_id, k, path, spine, refs, kind, wr.name, n, canon
          FROM args JOIN wr USING (tid) JOIN (SELECT item_id FROM written WHERE ok) USING (item_id)
        UNION ALL SELECT item_id, {RET}, path, spine, refs, kind, wr.name, n, canon FROM written JOIN wr ON wr.tid = ret WHERE ok
        UNION ALL SELECT item_id, {RET}, '', '', '', 'unit', NULL, NULL, '' FROM written WHERE ok AND ret IS NULL""",
    "signature_slots": f"""{_with(FNS, WRITTEN)}
        SELECT item_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fn ' ELSE 'fn ' || name END || decl AS text,
               CASE WHEN p_partkey % 3 = 2 THEN name END AS name, ok AS has_sig, CASE WHEN ok THEN n_args END AS n_args,
               CASE WHEN NOT ok THEN NULL WHEN ret IS NULL THEN 'unit' WHEN ret <> 18 THEN 'type' END AS ret,
               CASE WHEN NOT ok THEN decl WHEN ret IN (16, 17) THEN '::Result<T>' WHEN ret = 18 THEN ' -> [u8; 4]'
                    WHEN ret = 19 THEN '<''a, str>' ELSE '' END AS unparsed,
               NOT ok AND p_partkey % 3 <> 2 AS rejected, CASE WHEN ok THEN arg_names ELSE '' END AS arg_names
        FROM written""",
    "arity_components": f"""{_with(*ROWS)}
        SELECT text, item_id, s, c FROM aligned JOIN texts USING (qid) WHERE slot = -1""",
    "node_components": f"""{_with(*ROWS)}
        SELECT text, slot, path, CAST(b AS INT) AS reading, round(s, 6) AS s, c, count(*) AS n FROM aligned JOIN texts USING (qid) GROUP BY ALL""",
    "generic_binding": f"""{_with(*ROWS)}
        SELECT text, x.item_id, x.slot, x.path, CAST(x.b AS INT) AS reading, x.generic, x.canon, x.s - a.s AS s
        FROM bound x JOIN aligned a ON a.qid = x.qid AND a.item_id = x.item_id AND a.slot = x.slot AND a.path = x.path
         AND a.b = x.b AND a.reading = x.reading
        JOIN texts ON texts.qid = x.qid WHERE x.generic IS NOT NULL""",
    "ref_peel_cost": f"""{_with(*ROWS)}
        SELECT array_to_string(q_refs, ' ') AS q_refs, array_to_string(i_refs, ' ') AS i_refs,
               array_to_string(rest, ' ') AS rest, k, count(*) AS n
        FROM aligned GROUP BY ALL""",
    "pair_scores": f"""{_with(*ROWS)}
        SELECT text, item_id, round(CAST(CAST(s / c AS FLOAT) AS DOUBLE), 6) AS score, c FROM sums JOIN texts USING (qid)""",
    "alias_choice": f"""{_with(*ROWS)}
        SELECT text, item_id, slot, CAST(max(b) AS INT) AS reading, round(sum(s), 6) AS s, CAST(sum(c) AS BIGINT) AS c
        FROM chosen JOIN texts USING (qid) WHERE reading <> '-' GROUP BY text, item_id, slot""",
    "component_list": f"""{_with(*SEARCH)}, lists AS (
          SELECT qid, item_id, string_agg(concat_ws(':', slot, path, CAST(round(s * 1000000) AS BIGINT), c), ' '
                 ORDER BY slot, b, seq) AS parts
          FROM chosen GROUP BY ALL),
        owns AS (SELECT qid, item_id, 'name::' || CAST(round(d * 1000000) AS BIGINT) || ':1' AS own FROM dist),
        args AS (SELECT a.qid, f.item_id, string_agg('arg' || a.slot || '::' || CAST(round(
                   levenshtein(a.arg, 'a' || a.slot) / CAST(greatest(strlen(a.arg), 2) AS DOUBLE) * 1000000) AS BIGINT) || ':1', ' ' ORDER BY a.slot) AS arg
                 FROM argnames a JOIN fns f ON a.slot < f.n_args GROUP BY ALL)
        SELECT text, crate, item_id, round(CAST(score AS DOUBLE), 6) AS score, concat_ws(' ', own, arg, parts) AS parts
        FROM {_ranked('hits', 'text', 30)} LEFT JOIN lists USING (qid, item_id) LEFT JOIN owns USING (qid, item_id) LEFT JOIN args USING (qid, item_id)""",
}
ORACLE["name_search_pieces"] = ORACLE["name_search_urls"]
