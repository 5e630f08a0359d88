"""DuckDB statements for the registered queries."""

from __future__ import annotations


def _words_in_windows(name: str, k: int) -> str:
    """Words per text inside windows of ``k`` words that the text holds twice or more."""
    return f"""
    {name}_at AS (
      SELECT doc_id, unnest(range(1, len(words) - {k} + 2)) AS i, words FROM w WHERE len(words) >= {k}
    ), {name}_win AS (
      SELECT doc_id, i, array_to_string(words[i:i + {k - 1}], ' ') AS win FROM {name}_at
    ), {name}_hit AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM {name}_win
    ), {name} AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {k})) AS p FROM {name}_hit WHERE n > 1
      ) GROUP BY doc_id
    )"""


OP1 = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), {_words_in_windows("r3", 3)}, {_words_in_windows("r10", 10)}, {_words_in_windows("r201", 201)},
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r3.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(r10.n, 0) AS BIGINT) AS n_covered_words,
    r201.n IS NOT NULL AS has_long_repeat
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN r3 USING (doc_id)
    LEFT JOIN r10 USING (doc_id) LEFT JOIN r201 USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT has_long_repeat AND 100 * n_covered_words <= 40 * n_words AS kept
FROM base
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), items AS (
  SELECT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS win FROM (
    SELECT item_id, words, least(len(words), 13) AS k,
      unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i
    FROM b WHERE len(words) > 0)
), wins AS (
  SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS win FROM (
    SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
    FROM d, (SELECT DISTINCT k FROM items) WHERE len(words) >= k)
), hits AS (
  SELECT DISTINCT doc_id, wins.k, i, item_id FROM wins JOIN items USING (k, win)
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits)
  GROUP BY doc_id
), met AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
), terms AS (
  SELECT win, unnest(list_distinct(string_split(win, ' '))) AS word, len(list_distinct(string_split(win, ' '))) AS n
  FROM (SELECT DISTINCT win FROM items)
), places AS (
  SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)
), holding AS (
  SELECT doc_id, win FROM (SELECT DISTINCT doc_id, word FROM places) JOIN terms USING (word)
  GROUP BY doc_id, win, n HAVING count(*) = n
), close AS (
  SELECT doc_id, win, n, count(DISTINCT word)
    OVER (PARTITION BY doc_id, win ORDER BY p RANGE BETWEEN CURRENT ROW AND 25 FOLLOWING) AS together
  FROM holding JOIN terms USING (win) JOIN places USING (doc_id, word)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, win FROM close WHERE together = n) JOIN items USING (win) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(met.n, 0) AS BIGINT) AS n_items, sha256(coalesce(met.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(words) AS contaminated,
  CAST(coalesce(near.n, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near.ids, '')) AS near_items_sha256
FROM d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN met USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), lasts AS (
  SELECT conv_id, max(i) AS l FROM t WHERE role = 'assistant' GROUP BY conv_id
), replies AS (
  SELECT conv_id, l, max(i) AS p FROM t JOIN lasts USING (conv_id)
  WHERE role = 'assistant' AND i < l GROUP BY conv_id, l
), other AS (
  SELECT lasts.conv_id, lasts.l, coalesce(t.text, '') AS instead
  FROM lasts LEFT JOIN replies USING (conv_id)
    LEFT JOIN t ON t.conv_id = lasts.conv_id AND t.i = coalesce(p, lasts.l - 1)
), pairs AS (
  SELECT o.conv_id, l, t.text AS reply, instead, CASE WHEN t.text = instead THEN l ELSE l - 1 END AS n_common
  FROM other o JOIN t ON t.conv_id = o.conv_id AND t.i = l
), prompts AS (
  SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
  FROM pairs JOIN t USING (conv_id) WHERE i <= n_common GROUP BY conv_id
)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt,
  CASE WHEN n_common = l THEN '' ELSE '<|assistant|>' || chr(10) || reply || '<|end|>' || chr(10) END AS chosen,
  CASE WHEN n_common = l THEN '' ELSE '14-' || (22 + length(reply)) END AS chosen_mask,
  CASE WHEN n_common = l THEN '' ELSE '<|assistant|>' || chr(10) || instead || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN n_common = l THEN '' ELSE '14-' || (22 + length(instead)) END AS rejected_mask
FROM pairs LEFT JOIN prompts USING (conv_id)
"""

OP8 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), src AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY source),
tot AS (SELECT sum(tokens) AS total, count(*) AS n FROM src WHERE tokens > 0),
shares AS (SELECT list(CAST(tokens AS DOUBLE) / total) AS ps, any_value(n) AS n FROM src, tot WHERE tokens > 0),
bis(lo, hi) AS (
  SELECT 0, 1000001
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid,
      ln(list_sum(list_transform(ps, lambda x: pow(x, mid / 1e6))))
        - list_sum(list_transform(ps, lambda x: pow(x, mid / 1e6) * (mid / 1e6) * ln(x)))
          / list_sum(list_transform(ps, lambda x: pow(x, mid / 1e6))) >= 0.99 * ln(n) - 1e-12 AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM bis WHERE hi - lo > 1), shares)
), a AS (SELECT max(lo) AS step FROM bis),
w AS (
  SELECT source, tokens, step,
    CASE WHEN tokens = 0 THEN 0 ELSE CAST(round(1e9 * pow(CAST(tokens AS DOUBLE), step / 1e6)
      / (SELECT sum(pow(CAST(tokens AS DOUBLE), step / 1e6)) FROM src, a WHERE tokens > 0)) AS BIGINT) END AS ppb
  FROM src, a
), g AS (
  SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE goal // tokens END AS passes,
    CASE WHEN tokens = 0 THEN 0 ELSE goal % tokens END AS rest,
    least(greatest(CAST(ceil(tokens / 262144.0) AS BIGINT), 1), 1048576) AS n_blocks
  FROM (SELECT w.*, CAST((CAST(ppb AS HUGEINT) * CAST(floor(total * 1.25) AS BIGINT)) // 1000000000 AS BIGINT) AS goal
    FROM w, tot)
), rows_ AS (
  SELECT t.*, passes, rest, step, ppb,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % n_blocks AS block
  FROM t JOIN g USING (source)
), blocks AS (
  SELECT source, block, passes, rest, sum(tokens) AS n, unnest(range(0, passes + 1)) AS epoch
  FROM rows_ GROUP BY source, block, passes, rest
), placed AS (
  SELECT *, row_number() OVER o - 1 AS block_position, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM blocks WINDOW o AS (PARTITION BY source, epoch
    ORDER BY md5(source || ':' || block || ':' || epoch || ':7'), block)
), each AS (
  SELECT r.doc_id, r.source, r.tokens, r.step, r.ppb, p.epoch, p.block, p.block_position,
    p.epoch < p.passes OR p.upto <= p.rest AS whole, p.rest - p.upto + p.n AS room,
    md5(r.doc_id || ':' || p.epoch || ':7:row') AS k
  FROM rows_ r JOIN placed p USING (source, block)
  WHERE p.epoch < p.passes OR p.rest > 0
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY k) AS upto FROM each
)
SELECT doc_id, source, tokens AS n_tokens, epoch, block, block_position,
  CAST(step AS BIGINT) AS exponent_ppm, ppb AS weight_ppb
FROM summed WHERE whole OR room > 0 AND upto <= room
"""

OP12 = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx FROM leaves
), trees AS (
  SELECT source, 0 AS k, list(leaf ORDER BY idx) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, k + 1, list_transform(range(0, (len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS k, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM crown WHERE len(nodes) > 1
), climb AS (
  SELECT doc_id, source, leaf, idx AS pos, 0 AS k, '' AS proof,
    CASE WHEN crc32_of % 2 = 0 THEN changed ELSE leaf END AS folded
  FROM (SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc32_of
    FROM placed)
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, pos // 3, c.k + 1,
    proof || array_to_string(nodes[pos - pos % 3 + 1:pos], '') || array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''),
    sha256(array_to_string(nodes[pos - pos % 3 + 1:pos], '') || folded || array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''))
  FROM climb c JOIN trees t ON c.source IS NOT DISTINCT FROM t.source AND c.k = t.k AND len(nodes) > 1
), arrived AS (
  SELECT doc_id, c.source, leaf, subroot, place AS pos, 0 AS k, proof, folded
  FROM climb c JOIN trees t ON c.source IS NOT DISTINCT FROM t.source AND c.k = t.k AND len(nodes) = 1
    JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, source, leaf, subroot, pos // 3, c.k + 1,
    proof || array_to_string(nodes[pos - pos % 3 + 1:pos], '') || array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''),
    sha256(array_to_string(nodes[pos - pos % 3 + 1:pos], '') || folded || array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''))
  FROM arrived c JOIN crown t ON c.k = t.k AND len(nodes) > 1
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = nodes[1] AS verified
FROM arrived c JOIN crown t ON c.k = t.k AND len(nodes) = 1
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d
), counts AS (
  SELECT part, failed, count(*) AS n, count(good.doc_id) AS good, count(bad.doc_id) AS toxic
  FROM f LEFT JOIN good USING (doc_id) LEFT JOIN bad USING (doc_id) GROUP BY part, failed
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own,
    '[' || substr(filter_order, 1, step - 1) || '-]' AS earlier,
    '[' || substr(filter_order, 1, step) || ']' AS upto
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), each AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT regexp_matches(failed, upto) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, own) AND NOT regexp_matches(failed, earlier) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, own) AND regexp_matches(failed, earlier) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, own) AND NOT regexp_matches(failed, earlier) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, own) AND NOT regexp_matches(failed, earlier) THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM each
"""

SQL = {
    "op1_quality_rules": OP1,
    "op2_decontamination": OP2,
    "op5_preference_format": OP5,
    "op8_mixing": OP8,
    "op12_merkle_manifest": OP12,
    "op13_filter_audit": OP13,
}
