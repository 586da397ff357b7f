"""DuckDB SQL for the corpus queries that SQL can express."""

import re

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host
  FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
stats AS (
  SELECT rid, doc_id, host, text, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
  LEFT JOIN rep USING (rid)),
texts AS (SELECT host, text, min(doc_id) AS id FROM d GROUP BY host, text),
lines AS (
  SELECT host, text, id, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT host, text, id, unnest(string_split(text, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
own AS (SELECT host, line, text, any_value(id) AS id, sum(len(string_split(line, ' '))) AS w FROM lines GROUP BY host, line, text),
cnt AS (SELECT host, line, count(*) AS n FROM own GROUP BY host, line HAVING count(*) >= 10),
frequent AS (
  SELECT host, line FROM cnt JOIN (SELECT host, count(*) AS total FROM texts GROUP BY host) USING (host)
  WHERE n * 100 > total * 10 OR n > 100),
removed AS (
  SELECT host, text, sum(w) AS gone FROM own JOIN frequent USING (host, line) GROUP BY host, text),
judged AS (
  SELECT stats.*, coalesce(gone, 0) AS gone, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM stats LEFT JOIN removed USING (host, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words - gone) * 100 < n_words * 30 AS kept
FROM judged
"""


def secrets(rules) -> str:
    """The spans of each rule from its matches and the pieces between them.  Letters are spelt out in either case."""

    def re2(rule) -> str:
        pattern = rule.pattern
        if rule.ignore_case:
            pattern = "".join(
                x if x.startswith(("[", "\\")) else re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", x)
                for x in re.findall(r"\[[^\]]*\]|\\x[0-9a-f]{2}|\\.|.", pattern)
            )
        return pattern.replace("'", "''")

    parts = []
    for k, rule in enumerate(rules):
        parts.append(f"""
  SELECT rid, kind, rank, start, start + length(m) AS stop FROM (
    SELECT rid, '{rule.kind}' AS kind, {k} AS rank, ms[i] AS m, gs[i] AS g,
      list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{re2(rule)}', 0) AS ms, regexp_extract_all(text, '{re2(rule)}', {rule.group}) AS gs,
        regexp_split_to_array(text, '{re2(rule)}') AS ps
      FROM d WHERE regexp_matches(text, '{re2(rule)}')))) WHERE length(g) >= {rule.min_length}""")
    base = [r.kind for r in rules if r.base]
    names = ", ".join(f"'{k}'" for k in base)
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, kind, rank, start::BIGINT AS start, stop::BIGINT AS stop FROM ({" UNION ALL ".join(parts)})),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)},
  {line} FILTER (kind IN ({names})) AS base, {line} AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
