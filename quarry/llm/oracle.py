"""DuckDB SQL twins of the numbered operators that SQL can express."""

#: CRC-32 of column ``s`` (ASCII), by the table of the reflected polynomial.
_CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(s: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)")


PERIODIC_RUNS = rf"""
WITH {_CRC},
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, {_crc('CAST(doc_id AS VARCHAR)')} AS h,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w
  FROM documents, crc_table),
places AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM texts),
worded AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 <> 0 OR n = 0 THEN w ELSE list_transform(range(n),
         lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) END AS w FROM places),
word AS (SELECT rid, n, i, w[i + 1] AS x FROM (SELECT rid, n, w, unnest(range(n)) AS i FROM worded)),
equal AS (
  SELECT l.rid, r.i - l.i AS q, l.i FROM word l JOIN word r ON l.rid = r.rid AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
island AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM equal) GROUP BY rid, q, g),
run AS (
  SELECT rid, start, length, min(q) AS period FROM island WHERE length >= greatest(24, 3 * q) GROUP BY rid, start, length),
best AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(s := start, l := length, p := period) ORDER BY length / period DESC, start, period) AS b
  FROM run GROUP BY rid),
kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.rid = word.rid AND i >= start + period AND i < start + length) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period,
       (1000 * b.l // b.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM worded LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

_TERMS = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

LEXICAL_SEARCH = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS.format('text')}, []) AS w FROM documents),
item AS (SELECT row_number() OVER () AS iid, item_id, coalesce({_TERMS.format('text')}, []) AS w FROM benchmark),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM doc),
tf AS (SELECT rid, x, count(*) AS tf FROM (SELECT rid, unnest(w) AS x FROM doc) GROUP BY rid, x),
df AS (SELECT x, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
       FROM tf, stats GROUP BY x, n_docs),
term AS (SELECT iid, x, count(*) AS times FROM (SELECT iid, unnest(w) AS x FROM item) GROUP BY iid, x),
norm AS (SELECT rid, doc_id, 25 + (75 * len(w) * n_docs) // total AS m FROM doc, stats),
scored AS (
  SELECT iid, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM term JOIN df USING (x) JOIN tf USING (x) JOIN norm USING (rid) GROUP BY iid, rid)
SELECT item_id, rank, doc_id, score FROM (
  SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored JOIN norm USING (rid) WHERE score > 0) JOIN item USING (iid) WHERE rank <= 10
"""
