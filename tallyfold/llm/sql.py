"""SQL twins, written for DuckDB from the contracts and not from the Spark plans."""

from __future__ import annotations

from tallyfold.llm.quality import (
    CHAR_SHARES,
    MAX_CHAR_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_CHARS_FOR_DIVERGENCE,
    MIN_WORDS_FOR_DIVERGENCE,
    WORD_SHARES,
)

URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT p.page_id, p.host, p.path,
  (SELECT rule_host || rule_path FROM rules
   WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
   ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules
   WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
   ORDER BY length(rule_host || rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM parts p
"""


def _distance(shares: list[str], reference: list[float]) -> str:
    terms = [
        f"(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q!r}::DOUBLE)) ELSE 0 END"
        f" + {q!r}::DOUBLE * ln(2 * {q!r}::DOUBLE / ({p} + {q!r}::DOUBLE)))"
        for p, q in zip(shares, reference, strict=True)
    ]
    return f"sqrt(greatest(({' + '.join(terms)}) / 2 / ln(2), 0))"


def _quality_sql() -> str:
    by_chars = [_distance([f"c{i}" for i in range(6)], list(q)) for q in CHAR_SHARES.values()]
    counts, by_words = [], []
    for lang, shares in WORD_SHARES.items():
        for i, word in enumerate(shares):
            counts.append(
                f"len(list_filter(words, lambda x: x = '{word}' OR x = '{word.capitalize()}'))::DOUBLE / n_words AS {lang}{i}"
            )
        own = [f"{lang}{i}" for i in range(len(shares))]
        rest = f"greatest(1 - ({' + '.join(own)}), 0)"
        by_words.append(_distance([*own, rest], [*shares.values(), 1.0 - sum(shares.values())]))
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
counted AS (
  SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(text) AS n
  FROM cut),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM counted)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS r(k) GROUP BY doc_id),
shares AS (
  SELECT *, length(regexp_replace(text, '[^a-z]', '', 'g'))::DOUBLE / n AS c0,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / n AS c1,
    length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / n AS c2,
    (n - word_chars)::DOUBLE / n AS c3,
    length(regexp_replace(text, '[\x20\x09-\x0DA-Za-z0-9]|[^\x00-\x7f]', '', 'g'))::DOUBLE / n AS c4,
    length(regexp_replace(text, '[\x00-\x7f]', '', 'g'))::DOUBLE / n AS c5,
    {", ".join(counts)}
  FROM counted WHERE n >= {MIN_CHARS_FOR_DIVERGENCE} AND n_words >= {MIN_WORDS_FOR_DIVERGENCE}),
distances AS (
  SELECT doc_id, least({", ".join(by_chars)}) AS by_chars, least({", ".join(by_words)}) AS by_words FROM shares),
judged AS (
  SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    c.n_words < 10 OR 100 * coalesce(r.n_repeat_words, 0) > 20 * c.n_words AS base_failed,
    coalesce(by_chars > {MAX_CHAR_DISTANCE} OR by_words > {MAX_WORD_DISTANCE}, false) AS far
  FROM counted c LEFT JOIN repeated r USING (doc_id) LEFT JOIN distances d USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT far AS kept
FROM judged
"""


QUALITY_SQL = _quality_sql()
