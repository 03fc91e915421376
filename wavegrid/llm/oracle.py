"""DuckDB SQL for corpus queries that SQL can express."""

from __future__ import annotations

from wavegrid.llm.licenses import PHRASES, TEMPLATES, run_length
from wavegrid.llm.mixing import op4_sql
from wavegrid.llm.quality_rules import LIMITS
from wavegrid.llm.sketch_dedup import OP11_SQL
from wavegrid.llm.token_rollup import OP2_SQL
from wavegrid.llm.turn_trie import OP13_SQL
from wavegrid.llm.vector_codes import OP12_SQL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id),
o AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM o JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(least(n.doc_id, (SELECT min(j) FROM r WHERE r.i = n.doc_id)), n.doc_id) AS component_id,
       CAST((SELECT count(*) FROM e WHERE e.i = n.doc_id) AS BIGINT) AS n_links
FROM n
"""


def divergence(p: str, q: str) -> str:
    """The sum's term of the Jensen-Shannon divergence, of shares p and q."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"({part(p)} + {part(q)}) / 2"


#: Character classes but white space, in the order of quality_rules.BYTE_CLASS.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[^a-zA-Z0-9#*$%&|<>\x09-\x0D\x20\x{80}-\x{10FFFF}]", r"[^\x00-\x7F]")
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
wd AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
tri AS (SELECT doc_id, i, word, lead(word, 1) OVER v AS w2, lead(word, 2) OVER v AS w3 FROM wd WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n > 1),
nrep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) AS q(k) GROUP BY doc_id),
ln AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
ndup AS (SELECT doc_id, sum(n - 1) AS n FROM ln GROUP BY doc_id),
base AS (
  SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(ndup.n, 0) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN ndup USING (doc_id) LEFT JOIN nrep USING (doc_id)),
cls AS (SELECT doc_id, lang, k, n FROM (SELECT doc_id, lang, unnest(range(6)) AS k, unnest([{", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in CLASSES)}]) AS n FROM d)),
rcl AS (SELECT lang, k, CAST(sum(n) AS DOUBLE) AS n FROM cls GROUP BY ALL),
cd AS (
  SELECT doc_id, sqrt(greatest(0, sum({divergence("p", "q")}))) AS dist, max(total) AS total FROM (
    SELECT c.doc_id, c.n / sum(c.n) OVER v AS p, r.n / sum(r.n) OVER v AS q, sum(c.n) OVER v AS total
    FROM cls c JOIN rcl r ON c.lang = r.lang AND c.k = r.k WINDOW v AS (PARTITION BY c.doc_id)) GROUP BY doc_id),
rchars AS (SELECT lang, sum(length(text)) AS n FROM d GROUP BY lang),
sw AS (SELECT lang, word, count(*) AS n FROM wd WHERE length(word) <= 4 GROUP BY ALL),
top AS (SELECT lang, word, CAST(n AS DOUBLE) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS p FROM sw) WHERE p <= 40),
share AS (SELECT top.lang, sum(top.n) / greatest(1, (SELECT sum(n) FROM sw WHERE sw.lang = top.lang)) AS s FROM top GROUP BY top.lang),
mine AS (
  SELECT d.doc_id, top.word, top.n AS r, coalesce(c.n, 0) AS m FROM d JOIN top ON top.lang = d.lang
  LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM wd GROUP BY ALL) c ON c.doc_id = d.doc_id AND c.word = top.word),
wdist AS (
  SELECT doc_id, max(total) AS total, sqrt(greatest(0, sum(CASE WHEN total > 0 THEN {divergence("p", "q")} END))) AS dist FROM (
    SELECT doc_id, sum(m) OVER v AS total, m / greatest(1, sum(m) OVER v) AS p, r / sum(r) OVER v AS q FROM mine WINDOW v AS (PARTITION BY doc_id)) GROUP BY doc_id),
j AS (
  SELECT base.*, n_words < {LIMITS["min_words"]} OR 100 * n_repeat_words > {LIMITS["max_repeat_percent"]} * n_words AS base_failed,
         CASE WHEN rchars.n >= {LIMITS["min_reference_chars"]} AND cd.total >= {LIMITS["min_chars"]} THEN cd.dist END AS class_distance,
         CASE WHEN rchars.n >= {LIMITS["min_reference_chars"]} AND n_words >= {LIMITS["min_words_common"]} THEN
           CASE WHEN wdist.total >= {LIMITS["min_common"]} THEN wdist.dist WHEN {LIMITS["expect_common"]} * n_words * share.s >= {LIMITS["min_common"]} THEN 1.0 END END AS word_distance
  FROM base LEFT JOIN cd USING (doc_id) LEFT JOIN wdist USING (doc_id) LEFT JOIN share ON share.lang = base.lang LEFT JOIN rchars ON rchars.lang = base.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {LIMITS["max_class_distance"]} AND coalesce(word_distance, 0) <= {LIMITS["max_word_distance"]} AS kept
FROM j
"""

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SETS = [(label, sorted(set(t.split())), run_length(t)) for label, t in TEMPLATES]
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{LICENSE_WORD}') AS w FROM d),
ph(label, p) AS (VALUES {", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())}),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, greatest(0, len(w) - len(p) + 1)), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM w, ph),
base AS (
  SELECT w.doc_id, t, len(w) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) FILTER (WHERE i IS NOT NULL) AS labels
  FROM w LEFT JOIN places ON places.doc_id = w.doc_id GROUP BY w.doc_id, t, len(w)),
tp(k, label, s, n) AS (VALUES {", ".join(f"({k}, '{label}', {s}, {n})" for k, (label, s, n) in enumerate(SETS))}),
able AS (SELECT doc_id, k, label, w, s, n FROM w, tp WHERE len(list_intersect(s, w)) >= (0.85 - 1e-12) * len(s)),
run AS (SELECT doc_id, k, label, s, i, w[i:i + n - 1] AS w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM able) WHERE list_contains(s, w[i])),
fit AS (SELECT *, i - 1 + list_max(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN list_contains(s, w[j]) THEN j END)) AS last
  FROM (SELECT *, len(list_intersect(s, w)) / CAST(len(s) AS DOUBLE) AS share FROM run) WHERE share >= 0.85 - 1e-12),
blk AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(last) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM fit) WHERE before IS NULL OR i > before GROUP BY doc_id),
hit AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM fit GROUP BY doc_id)
SELECT base.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hit.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, CAST(coalesce(blk.n, 0) AS BIGINT) AS n_blocks
FROM base LEFT JOIN hit ON hit.doc_id = base.doc_id LEFT JOIN blk ON blk.doc_id = base.doc_id
"""

ORACLE_SQL = {
    "op1_ngram_join": OP1_SQL, "op2_token_rollup": OP2_SQL, "op4_source_mixing": op4_sql(), "op6_quality_rules": OP6_SQL, "op7_license_scan": OP7_SQL,
    "op11_sketch_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_turn_trie": OP13_SQL,
}
