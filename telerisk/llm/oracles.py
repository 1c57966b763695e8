"""DuckDB SQL of the operators that SQL can express, written over the whole tables."""

from __future__ import annotations

from telerisk.llm import credentials as C
from telerisk.llm import ledger as L

_bits = {name: 1 << k for k, name in enumerate(L.RULES)}
_failed = {
    "few_words": "n_words < 10", "repeated_words": "100 * n_repeat_words > 20 * n_words", "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines", "word_length": "word_chars NOT BETWEEN 2 * n_words AND 20 * n_words",
    "shouting": "n_letters >= 40 AND 100 * n_upper > 50 * n_letters"}
_only = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"

OP6 = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + {L.WINDOW - 1}] AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - {L.WINDOW - 2})) AS i FROM d) x),
again AS (SELECT doc_id, COUNT(DISTINCT i + k.k) AS n FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) x,
  (SELECT UNNEST(range({L.WINDOW})) AS k) k WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_only('#*$%&|<>')} AS n_symbols,
  COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words, COALESCE(n_lines, 0) AS n_lines, {_only('A-Z')} AS n_upper, {_only('A-Za-z')} AS n_letters
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, {' + '.join(f'CASE WHEN {rule} THEN {_bits[name]} ELSE 0 END' for name, rule in _failed.items())} AS mask FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, mask & {L.mask(L.BASE_RULES)} <> 0 AS base_failed,
  mask & {L.mask(L.POLICIES[L.CURRENT])} = 0 AS kept, CAST(mask AS BIGINT) AS failed FROM f"""


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, least: str = "") -> str:
    """Pieces of the text that start with a match, their places from running lengths."""
    marked = f"string_split(regexp_replace(t, {_text(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"""SELECT doc_id, {kind} AS kind, s AS start, s + length(hit) AS finish FROM (
  SELECT doc_id, n, string_split(piece, chr(2))[1] AS hit,
         COALESCE(SUM(length(piece) - CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, UNNEST(p) AS piece, UNNEST(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, {marked} AS p FROM d) x) y) z
  WHERE n > 1 {least}"""


_kinds = {k: C.KINDS.index(k) for k in C.KINDS}
_in = lambda names: "kind IN (" + ", ".join(str(_kinds[n]) for n in names) + ")"
_near = lambda names: (f"(COALESCE(start - MAX(CASE WHEN {_in(names)} THEN finish END) OVER before <= {C.REACH}, FALSE) "  # noqa: E731
                       f"OR COALESCE(MIN(CASE WHEN {_in(names)} THEN start END) OVER after - finish <= {C.REACH}, FALSE))")
_frames = """WINDOW before AS (PARTITION BY doc_id, block ORDER BY start, kind, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (PARTITION BY doc_id, block ORDER BY start, kind, finish ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
_list = ("STRING_AGG(['" + "', '".join(C.KINDS) + "'][kind + 1] || ':' || CAST(start AS VARCHAR) || ':' || CAST(finish AS VARCHAR), ',' ORDER BY start, kind)")

OP10 = f"""WITH d AS (SELECT doc_id, translate(COALESCE(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
base AS ({_spans(0, C.ASSIGN, f"AND length(regexp_extract(hit, {_text(C.ASSIGN)}, 1)) >= 8")} UNION ALL {_spans(1, C.ACCESS)} UNION ALL {_spans(2, C.HEX)}),
weak AS ({_spans(3, C.ACCOUNT)} UNION ALL {_spans(4, C.ENDPOINT)} UNION ALL {_spans(5, C.OPAQUE, ' '.join(f'AND regexp_matches(hit, {_text(x)})' for x in C.MIXED))}),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak UNION ALL SELECT * FROM ({_spans(-1, C.BLANK)}) l WHERE doc_id IN (SELECT doc_id FROM weak)),
placed AS (SELECT * FROM (SELECT *, SUM(CASE WHEN kind < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, kind, finish) AS block FROM parts) p WHERE kind >= 0),
free AS (SELECT * FROM (SELECT *, COALESCE(MAX(CASE WHEN kind <> 5 THEN finish END) OVER before > start, FALSE)
  OR COALESCE(MIN(CASE WHEN kind <> 5 THEN start END) OVER after < finish, FALSE) AS met FROM placed {_frames}) f WHERE kind <> 5 OR NOT met),
judged AS (SELECT *, {_near(C.IDENTIFIERS)} AS i, {_near(C.SECRETS)} AS s, {_near(C.ENDPOINTS)} AS e FROM free {_frames}),
every AS (SELECT doc_id, kind, start, finish FROM base UNION ALL
  SELECT doc_id, kind, start, finish FROM judged WHERE (kind = 3 AND s) OR (kind = 5 AND (i OR e)) OR (kind = 4 AND i AND s)),
told AS (SELECT doc_id, {_list} AS spans FROM every GROUP BY doc_id),
counted AS (SELECT doc_id, COUNT(*) FILTER (WHERE kind = 0) AS n_assign, COUNT(*) FILTER (WHERE kind = 1) AS n_access, COUNT(*) FILTER (WHERE kind = 2) AS n_hex,
  {_list} AS listed FROM base GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
  sha256(COALESCE(listed, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN told USING (doc_id)"""

OP11 = """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) FOR i IN range(1, len(q.e) + 1)])) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) r WHERE rank <= 10"""

_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12 = f"""WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang,
  UNNEST(regexp_split_to_array(translate(COALESCE(text, ''), '{_upper}', '{_upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, UNNEST(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, COUNT(*) AS a FROM places, (SELECT UNNEST([1, 2, 3]) AS size) s
  WHERE i + size - 1 <= len(w) GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, UNNEST(range(1, size)) AS k FROM c) x),
told AS (SELECT t.*, h.a AS l, r.a AS r, CAST(1000000::HUGEINT * t.a * t.a // (h.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts t JOIN f h ON h.lang = t.lang AND h.phrase = t.head AND h.size = t.k JOIN f r ON r.lang = t.lang AND r.phrase = t.tail AND r.size = t.size - t.k),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM told) x WHERE j = 1),
inside AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3
  UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) x GROUP BY ALL),
total AS (SELECT lang, SUM(a) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT lang, phrase, a, l, r, n, score, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best JOIN total USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a) x WHERE rank <= 2000"""
