"""DuckDB SQL for the training-data queries that SQL can express.

Written from the contracts, not from the operators: conversations are compared
by their joined turns instead of hashes, repeated words and benchmark phrases
by the words themselves.
"""

from __future__ import annotations

from .quality import FINE, MEASURES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
prefixes AS (
  SELECT *, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         max(pos) OVER (PARTITION BY conv_id) AS n_turns
  FROM placed),
whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, prefix FROM prefixes WHERE pos = n_turns GROUP BY n_turns, prefix),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.prefix = w.prefix)),
content AS (
  SELECT conv_id, pos, role,
         replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS body
  FROM placed)
SELECT k.conv_id, k.n_turns::INTEGER AS n_turns, k.n_equal,
       sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END)::BIGINT AS n_trained,
       string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept k JOIN content c ON c.conv_id = k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_equal
"""


def _measures() -> str:
    exact = " UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS measure, CASE WHEN {bottom} > 0 THEN {cells} * {top} // {bottom} ELSE 0 END::BIGINT AS c "
        "FROM counts WHERE n_words > 0" for name, (top, bottom, cells, *_) in MEASURES.items())
    doublings = f"(length(bin(c)) - {FINE.bit_length()})::INTEGER"
    return (f"SELECT lang, source, measure, CASE WHEN c < {FINE} THEN c ELSE {FINE} + 64 * {doublings} + "
            f"((c >> greatest({doublings}, 0)) - {FINE}) // 64 END AS cell FROM ({exact})")


def _edge(cell: str) -> str:
    return (f"CASE WHEN {cell} < {FINE} THEN {cell}::BIGINT ELSE ({FINE} + 64 * (({cell} - {FINE}) % 64))::BIGINT "
            f"<< greatest(({cell} - {FINE}) // 64, 0)::INTEGER END")


def _quartiles(keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""SELECT {by}, max(total) AS total, min(cell) FILTER (upto * 4 >= total) AS lo, min(cell) FILTER (upto * 4 >= total * 3) AS hi
      FROM (SELECT {by}, cell, sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
            FROM (SELECT {by}, cell, count(*) AS n FROM cells GROUP BY {by}, cell)) GROUP BY {by}"""


def _limits() -> str:
    out = []
    for name, (_, _, cells, margin, _, low) in MEASURES.items():
        here = f"FILTER (measure = '{name}')"
        hi, lo = f"({_edge('hi')})", f"({_edge('lo')})"
        out.append(f"max(({hi} + 4e0 * ({hi} - {lo})) / {cells} + {margin}::DOUBLE) {here} AS {name}_hi")
        if low:
            out.append(f"max(({lo} - 4e0 * ({hi} - {lo})) / {cells} - {margin}::DOUBLE) {here} AS {name}_lo")
    return ", ".join(out)


def _failed() -> str:
    out = []
    for name, (top, bottom, _, _, noise, low) in MEASURES.items():
        slack = f"{noise}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)"
        out.append(f"coalesce({top} / nullif({bottom}, 0) > {name}_hi + {slack}, FALSE)")
        if low:
            out.append(f"coalesce({top} / nullif({bottom}, 0) < {name}_lo - {slack}, FALSE)")
    return " OR ".join(out)


QUALITY = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM texts WHERE len(w) >= 5)),
twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS k FROM grams) WHERE k > 1),
covered AS (
  SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS spot FROM twice) GROUP BY rid),
lined AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(lines) AS n_lines
  FROM lined LEFT JOIN covered c USING (rid)),
cells AS ({_measures()}),
own AS ({_quartiles('lang, source')}),
per_lang AS ({_quartiles('lang')}),
everything AS ({_quartiles('')}),
chosen AS (
  SELECT o.lang, o.source, o.measure,
         CASE WHEN o.total >= 200 THEN o.lo WHEN l.total >= 200 THEN l.lo ELSE e.lo END AS lo,
         CASE WHEN o.total >= 200 THEN o.hi WHEN l.total >= 200 THEN l.hi ELSE e.hi END AS hi
  FROM own o JOIN per_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN everything e ON o.measure = e.measure),
limits AS (SELECT lang, source, {_limits()} FROM chosen GROUP BY lang, source),
judged AS (
  SELECT c.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_failed()} AS out_of_range
  FROM counts c LEFT JOIN limits m ON c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT out_of_range AS kept
FROM judged
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id, w, len(w) AS n, least(len(w), 10) AS span
  FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_grams AS (
  SELECT DISTINCT item_id, span, array_to_string(w[p:p + span - 1], ' ') AS gram
  FROM (SELECT item_id, span, w, unnest(range(1, n - span + 2)) AS p FROM items)),
text_grams AS (
  SELECT rid, span, p, array_to_string(w[p:p + span - 1], ' ') AS gram
  FROM (SELECT rid, span, w, unnest(range(1, len(w) - span + 2)) AS p
        FROM texts, (SELECT DISTINCT span FROM items) WHERE len(w) >= span)),
found AS (SELECT DISTINCT rid, p, span, item_id FROM text_grams JOIN item_grams USING (span, gram)),
hit AS (
  SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(p, p + span)) AS spot FROM found) GROUP BY rid),
names AS (SELECT rid, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM found GROUP BY rid),
text_words AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM texts),
item_words AS (SELECT item, n, span, unnest(w) AS word, unnest(range(n)) AS off FROM items),
df AS (SELECT word, count(*) AS df FROM text_words GROUP BY word),
ranked AS (
  SELECT item, spot, word, off, df, row_number() OVER (PARTITION BY item, spot ORDER BY df, off) AS r
  FROM (SELECT item, word, off, coalesce(df, 0) AS df,
               unnest(range(greatest(0, off - span + 1), least(off, n - span) + 1)) AS spot
        FROM item_words LEFT JOIN df USING (word))),
anchors AS (
  SELECT DISTINCT a.item, a.word AS wa, a.off AS oa, coalesce(b.word, a.word) AS wb, coalesce(b.off, a.off) AS ob
  FROM (SELECT * FROM ranked WHERE r = 1 AND df > 0) a
  LEFT JOIN (SELECT * FROM ranked WHERE r = 2) b ON a.item = b.item AND a.spot = b.spot),
places AS (
  SELECT DISTINCT x.rid, item, x.pos - oa AS shift
  FROM anchors JOIN text_words x ON x.word = wa
  JOIN text_words y ON y.rid = x.rid AND y.pos = x.pos - oa + ob AND y.word = wb),
kinds AS (SELECT item, n, word, count(*) OVER (PARTITION BY item) AS k FROM (SELECT DISTINCT item, n, word FROM item_words)),
near AS (
  SELECT rid, count(DISTINCT item_id) AS n
  FROM (SELECT p.rid, p.item, p.shift FROM places p JOIN kinds USING (item)
        JOIN text_words t ON t.rid = p.rid AND t.word = kinds.word AND t.pos >= p.shift - 5 AND t.pos < p.shift + kinds.n + 5
        GROUP BY p.rid, p.item, p.shift HAVING count(DISTINCT t.word) >= 0.8 * max(k)) JOIN items USING (item) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
       coalesce(near.n, 0) AS n_near_items
FROM texts LEFT JOIN hit USING (rid) LEFT JOIN names USING (rid) LEFT JOIN near USING (rid)
"""
