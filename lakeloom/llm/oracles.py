"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lakeloom.llm.quality import DELTA, LEAST_WORDS, MOST_REPEATED, RISK, RULES, STRATA, WINDOW

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def jaccard(width: int, percent: int) -> str:
    """Components of documents whose shingle sets are similar enough: all pairs that share a shingle, then closure."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT doc_id, doc_id FROM documents),
r(doc_id, reached) AS (SELECT a, b FROM g UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.reached = g.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""


def quality() -> str:
    """Counts, measures, certified cutoffs and verdict of each document."""
    measures = {
        "symbol_rate": "n_symbols / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
        "mark_rate": "n_marks / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "same_word_share": "1 - n_distinct / greatest(n_words, 1)::DOUBLE",
    }
    p, level = RISK / len(RULES), DELTA / (len(RULES) * (len(STRATA) + 1))
    cells = " UNION ALL ".join(f"SELECT '{r}' AS rule, {c}::DOUBLE AS cutoff, stratum, count(*) AS n, count_if({r} >= {c})::BIGINT AS k FROM held GROUP BY stratum" for r, grid in RULES.items() for c in grid)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
    rejected = " OR ".join(f"({r} >= (SELECT cutoff FROM cut WHERE cut.stratum = m.stratum AND rule = '{r}'))" for r in RULES)
    strata = ", ".join(f"'{s}'" for s in STRATA)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, {WORDS.format('text')} AS w, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS k FROM w WHERE len(w) >= {WINDOW}),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
steps AS (SELECT doc_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW})) AS step FROM again),
repeats AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY 1),
counts AS (SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(list_distinct(w)) AS n_distinct, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[!?]')) AS n_marks, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeats ON repeats.doc_id = w.doc_id),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {', '.join(f'{x} AS {r}' for r, x in measures.items())} FROM counts),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
cells AS ({cells}),
tests AS (SELECT *, max(CASE WHEN k >= n * {p} THEN 1 ELSE {tail} END) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS worst FROM cells),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tests WHERE worst <= {level} GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({rejected}, false) AS kept, stratum, {', '.join(RULES)} FROM m"""


ORACLES = {"op8_quality_rules": quality(), "op9_jaccard_join": jaccard(3, 90)}
