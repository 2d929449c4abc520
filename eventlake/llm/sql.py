"""DuckDB SQL for the operators' queries that SQL can express, over the whole tables."""

from ..plans.catalog import CRC_TABLE, crc32_sql

_LE32 = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"

OP1 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), padded AS (
  SELECT doc_id, strlen(t)::BIGINT AS n_bytes, t || repeat(' ', (CASE WHEN strlen(t) = 0 THEN 192 ELSE (192 - strlen(t) % 192) % 192 END)::BIGINT) AS payload FROM texts
), stored AS (
  SELECT *, strlen(payload)::BIGINT AS size, hex(encode(payload)) AS digits FROM padded
), files AS (
  SELECT *, from_hex('52494646' || {_LE32.format("(size + 36)")} || '57415645666D7420' || '10000000' || '0100' || '0100' || '401F0000' || '401F0000' || '0100' || '0800' || '64617461' || {_LE32.format("size")} || digits) AS media,
         list_transform(range(size), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT) AS b
  FROM stored
)
SELECT doc_id, n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, {crc32_sql("b[-16:]")} AS tail_crc32, (size + 44)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
       printf('rms=%.4f;mean=%.4f;crossings=%d;peak=%d', sqrt(list_avg(list_transform(b, lambda x: (x - 128) * (x - 128)))), list_avg(list_transform(b, lambda x: x - 128)),
              list_sum(list_transform(list_zip(b[:-2], b[2:]), lambda x: CASE WHEN (x[1] < 128) <> (x[2] < 128) THEN 1 ELSE 0 END))::BIGINT, list_max(list_transform(b, lambda x: abs(x - 128)))) AS feature,
       1 AS position, 'document ' || doc_id AS caption
FROM files, {CRC_TABLE}
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM by_source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT level AS free_level FROM levels WHERE ratio >= level ORDER BY ratio, source NULLS FIRST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN ratio >= free_level THEN w * free_level ELSE cap END AS target
  FROM levels LEFT JOIN free ON TRUE
), due AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS due
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), split AS (
  SELECT *, floor(due + 1e-9) AS certain, greatest(due - floor(due + 1e-9), 0) AS pi FROM due
), ranked AS (
  SELECT *, CASE WHEN pi > 1e-9 AND size > 0 THEN ln(u / (1 - u)) - ln(pi / (1 - pi)) END AS rank,
         target - sum(size * certain) OVER (PARTITION BY source) AS lack
  FROM split
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (certain + CASE WHEN rank IS NOT NULL AND before + size / 2 <= lack THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6 = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS block
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM listed WHERE len(words) >= 50)
), first_seen AS (
  SELECT block, min(doc_id) AS ref FROM windows GROUP BY block
), spans AS (
  SELECT w.doc_id, w.pos FROM windows w JOIN first_seen f ON w.block = f.block WHERE f.ref < w.doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM spans
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM listed
), kept AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.pos) AS body
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT l.doc_id, len(l.words)::BIGINT AS n_words, (len(l.words) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
            + length('<|im_start|><|im_sep|><|im_end|>') + 1 AS chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP10 = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(list_zip(words[:-2], words[2:]), lambda w: w[1] || ' ' || w[2]) END) AS shingle FROM listed
), sized AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), tokens AS (
  SELECT doc_id, n, md5_number(shingle) AS shingle FROM sets JOIN sized USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS root FROM edges UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.doc_id WHERE r.root < e.b
), least AS (
  SELECT doc_id, min(root) AS component FROM reached GROUP BY doc_id
)
SELECT l.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, l.doc_id) AS component_id, coalesce(component, l.doc_id) = l.doc_id AS kept
FROM listed l LEFT JOIN sized USING (doc_id) LEFT JOIN least c ON c.doc_id = l.doc_id
"""

OP12 = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, i // width AS part, i % width AS pos, v[i + 1] AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM kept)
), book0 AS (
  SELECT part, entry, pos, x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), near0 AS (
  SELECT vec_id, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (
    SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS away FROM cells v JOIN book0 b ON v.part = b.part AND v.pos = b.pos GROUP BY 1, 2, 3) GROUP BY 1, 2
), sums0 AS (
  SELECT v.part, n.entry, v.pos, sum(v.x)::BIGINT AS s, count(*) AS c FROM cells v JOIN near0 n ON v.vec_id = n.vec_id AND v.part = n.part GROUP BY 1, 2, 3
), book1 AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN c IS NULL THEN b.x ELSE (s - ((s % c) + c) % c) // c END AS x FROM book0 b LEFT JOIN sums0 t ON b.part = t.part AND b.entry = t.entry AND b.pos = t.pos
), near1 AS (
  SELECT vec_id, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (
    SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS away FROM cells v JOIN book1 b ON v.part = b.part AND v.pos = b.pos GROUP BY 1, 2, 3) GROUP BY 1, 2
), sums1 AS (
  SELECT v.part, n.entry, v.pos, sum(v.x)::BIGINT AS s, count(*) AS c FROM cells v JOIN near1 n ON v.vec_id = n.vec_id AND v.part = n.part GROUP BY 1, 2, 3
), book2 AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN c IS NULL THEN b.x ELSE (s - ((s % c) + c) % c) // c END AS x FROM book1 b LEFT JOIN sums1 t ON b.part = t.part AND b.entry = t.entry AND b.pos = t.pos
), near2 AS (
  SELECT vec_id, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (
    SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS away FROM cells v JOIN book2 b ON v.part = b.part AND v.pos = b.pos GROUP BY 1, 2, 3) GROUP BY 1, 2
), coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, sum(n.away)::BIGINT AS error
  FROM kept k JOIN near2 n ON k.vec_id = n.vec_id GROUP BY 1, 2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded
"""

OP13 = rf"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} AS h
  FROM documents, {CRC_TABLE}
), placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM hashed
), listed AS (
  SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) AS words FROM placed
), windows AS (
  SELECT doc_id, n, pos, md5_number(array_to_string(words[pos + 1:pos + 16], ' ')) AS block
  FROM (SELECT *, unnest(range(n - 15)) AS pos FROM listed WHERE n >= 24)
), repeated AS (
  SELECT doc_id, block FROM windows GROUP BY 1, 2 HAVING count(*) > 1
), twice AS (
  SELECT w.* FROM windows w JOIN repeated USING (doc_id, block)
), pairs AS (
  SELECT x.doc_id, x.pos, y.pos - x.pos AS q FROM twice x JOIN twice y ON x.doc_id = y.doc_id AND x.block = y.block AND y.pos > x.pos AND 3 * (y.pos - x.pos) <= x.n
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, q ORDER BY pos) AS island FROM pairs
), stretches AS (
  SELECT doc_id, min(pos) AS start, max(pos) + 16 - min(pos) + q AS length, q FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY 1, 2, 3
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said,
         first({{'start': start, 'length': length, 'period': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS best
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM runs
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS pos FROM listed
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS body FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos WHERE g.pos IS NULL GROUP BY w.doc_id
)
SELECT l.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM listed l LEFT JOIN told USING (doc_id) LEFT JOIN kept k ON k.doc_id = l.doc_id
"""
