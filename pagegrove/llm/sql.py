r"""DuckDB statements for the queries that SQL can express.

op1, op5 (trained models), op6 (a tokenizer), op7 (an HTML scan) and op9
(sequential packing) have none; op4 and op10 are too slow in SQL on whole
tables.  Those are tested against brute force on small fixtures.
"""

from __future__ import annotations

from pagegrove.llm.divergence_rules import CLASSES, COMMON, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, N_CLASSES, SLOTS

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _distance(p: str, q: str) -> str:
    total = lambda h: f"list_sum({h})::DOUBLE"
    x, y = f"({p}[i] / {total(p)})", f"({q}[i] / {total(q)})"
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({x} + {y}) / 2)) / 2 ELSE 0.0 END"
    return f"CASE WHEN {total(p)} > 0 AND {total(q)} > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x)} + {term(y)})), 0.0)) END"


def rules_sql() -> str:
    steps, rest = [], "t"
    for k, (_n, pattern) in enumerate(CLASSES):
        steps.append(f"s{k} AS (SELECT *, regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{k} FROM {f's{k - 1}' if k else 'base'})")
        rest = f"r{k}"
    last = f"s{len(CLASSES) - 1}"
    sizes = ["length(t)", *[f"length(r{k})" for k in range(len(CLASSES))]]
    classes = ", ".join([f"{a} - {b}" for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]])
    common = " ".join(f"WHEN '{code}' THEN {_quoted(words)}" for code, words in COMMON.items())
    sums = lambda col, n: "[" + ", ".join(f"coalesce(sum({col}[{k}]) FILTER (WHERE NOT base_failed), 0)" for k in range(1, n + 1)) + "]"
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         CASE lang {common} END AS common
  FROM documents),
{', '.join(steps)},
win AS (
  SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
reps AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
feat AS (
  SELECT {last}.rid, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(reps.n, 0)::BIGINT AS n_repeat_words, length(t) AS chars, [{classes}] AS c,
         CASE WHEN common IS NULL THEN list_transform(range(0, {SLOTS + 1}), lambda k: 0::BIGINT)
              ELSE list_append(list_transform(common, lambda x: len(list_filter(words, lambda w: lower(w) = x))::BIGINT),
                               len(list_filter(words, lambda w: NOT list_contains(common, lower(w))))::BIGINT) END AS w
  FROM {last} LEFT JOIN reps ON reps.rid = {last}.rid),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM feat),
refs AS (SELECT lang AS ref_lang, {sums('c', N_CLASSES)} AS cr, {sums('w', SLOTS + 1)} AS wr FROM judged GROUP BY lang),
dist AS (
  SELECT judged.*, CASE WHEN chars >= {MIN_CHARS} AND list_sum(cr) >= {MIN_CHARS} THEN {_distance('c', 'cr')} END AS cd,
         CASE WHEN n_words >= {MIN_WORDS} AND list_sum(wr) >= {MIN_WORDS} THEN {_distance('w', 'wr')} END AS wd
  FROM judged JOIN refs ON lang IS NOT DISTINCT FROM ref_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {MAX_CLASS_DISTANCE}, false)
       AND NOT coalesce(wd * wd - {SLOTS} / (8 * ln(2.0)) / n_words > {MAX_WORD_DISTANCE} * {MAX_WORD_DISTANCE}, false) AS kept
FROM dist"""


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g') AS er,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g') AS et FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

#: crc32 of an ASCII text: its bytes in turn, each followed by eight shifts (-1).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({x}) + 1), lambda i: [ascii({x}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

TRIE_SQL = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT own.*, base.t AS b, {_CRC.format(x='(own.conv_id::VARCHAR)')} % 4 AS h FROM own LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 20),
built AS (SELECT conv_id, list_concat(coalesce(b[1:h], []), t[h + 1:]) AS t FROM heads),
prefix AS (SELECT conv_id, t[1:d] AS k, d, len(t) AS n FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)),
node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends,
         CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].text, '{WORD}')) ELSE 0 END AS words
  FROM prefix GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k, d)),
below AS (SELECT k[1:j] AS k, j AS d, sum((n_children = 0)::INT) AS leaves, sum((n_convs - 1) * words) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM full_node) GROUP BY ALL)
SELECT x.conv_id::BIGINT AS conv_id, x.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_node AS x JOIN below USING (k, d) LEFT JOIN node AS up ON up.k = x.k[1:x.d - 1] AND up.d = x.d - 1"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
corpus AS (SELECT (count(*) FILTER (WHERE len(ws) > 0))::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS t FROM d) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t, n_docs),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scored AS (
  SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws)::BIGINT * n_docs) // n_terms))))::BIGINT AS score
  FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN d USING (rid), corpus GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""

ORACLES = {"op12_pair_maxscore": SEARCH_SQL, "op11_conversation_trie": TRIE_SQL, "op2_divergence_rules": rules_sql(), "op3_warc": WARC_SQL, "op8_chat_events": CHAT_SQL}
