"""DuckDB SQL of those text queries that SQL can express."""

from __future__ import annotations

import re

from tripweave.llm import robust_rules as rules

# Lower-case A-Z only, as the contracts ask.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0
), windows AS (
  SELECT item_id, size, array_to_string(w[pos : pos + size - 1], ' ') AS words
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM sized)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), places AS (
  SELECT r, pos, s.size, array_to_string(w[pos : pos + s.size - 1], ' ') AS words
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM docs), (SELECT DISTINCT size FROM windows) s
  WHERE pos + s.size - 1 <= len(w)
), hits AS (
  SELECT DISTINCT r, pos, p.size, item_id FROM places p JOIN windows v ON p.words = v.words AND p.size = v.size
), covered AS (
  SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY r
), found AS (
  SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

OP11 = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, * FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k) WHERE len(w) >= k
), phrases AS MATERIALIZED (
  SELECT lang, w[i : i + k - 1] AS words, any_value(k) AS k, count(*) AS a FROM places GROUP BY lang, words HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.words, c.a, j, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM phrases WHERE k > 1) c
  JOIN phrases l ON l.lang = c.lang AND l.words = c.words[1 : j] JOIN phrases r ON r.lang = c.lang AND r.words = c.words[j + 1 :]
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, words[i : i + s - 1] AS words, max(a) AS longer
  FROM (SELECT lang, words, a, k, s, unnest(range(1, k - s + 2)) AS i FROM phrases, range(2, 5) t(s) WHERE s < k) GROUP BY ALL
), kept AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best LEFT JOIN inner_parts USING (lang, words) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), sizes AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), terms AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM counts, whole GROUP BY term, big_n
), items AS (
  SELECT row_number() OVER () AS i, item_id, unnest({_WORDS.format("text")}) AS term FROM benchmark
), wanted AS (
  SELECT i, item_id, term, count(*) AS times FROM items GROUP BY ALL
), scores AS (
  SELECT i, item_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM wanted JOIN terms USING (term) JOIN counts USING (term) JOIN sizes USING (r), whole GROUP BY i, item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN sizes USING (r) WHERE score > 0 QUALIFY rank <= 20
"""


def _op12() -> str:
    """Base counts by unnesting, then the same estimates step by step, each a table of its own."""
    j = range(rules.SIZE)
    pairs = [(a, b) for a in j for b in range(a + 1)]
    plain = lambda sql: re.sub(r"(?<=[0-9])D\b", "", sql)
    listed = lambda parts: plain(", ".join(parts))
    a = ", ".join(f"a{x}" for x in j)
    sums = ", ".join(["count(*) AS n"] + [f"sum(a{x}) AS s{x}" for x in j] + [f"sum(a{x} * a{y}) AS p{x}{y}" for x, y in pairs])
    estimate = ", ".join([f"m{x}" for x in j] + [f"l{x}{y}" for x, y in pairs])
    ranked = plain(rules.RANKED)

    def estimated(rows: str, keys: str) -> str:
        return f"SELECT *, {listed(rules.estimate_sql())} FROM (SELECT {keys}, {sums} FROM {rows} GROUP BY ALL)"

    def measured(estimates: str, keys: str) -> str:
        return f"SELECT {keys}, {a}, {plain(rules.distance_sql())} AS d FROM (SELECT *, {listed(rules.solved_sql())} FROM grouped_rows JOIN {estimates} USING (lg, sg))"

    values = ", ".join(f"CASE WHEN NOT base_failed THEN CAST(floor(1000.0 * {plain(s)}) AS BIGINT) END AS a{x}" for x, s in enumerate(rules.STATISTICS))
    spread = ", ".join(
        f"(hi{x} - lo{x}) * (hi{x} - lo{x}) / 1.8196 + {float(rules.FLOORS[x] ** 2)} AS c{x}{y}" if x == y else f"0.0 AS c{x}{y}" for x, y in pairs
    )
    quartiles = ", ".join(f"quantile_disc(a{x}, {p}) AS {n}{x}" for x in j for n, p in (("lo", 0.25), ("m", 0.5), ("hi", 0.75)))
    ctes = [f"""
docs AS (SELECT row_number() OVER () AS r, * FROM documents),
words AS (SELECT r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
found AS (SELECT r, i FROM windows JOIN (SELECT r, x FROM windows GROUP BY r, x HAVING count(*) > 1) USING (r, x)),
repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM found) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (SELECT r, doc_id, coalesce('l' || lang, 'n') AS lg, coalesce('s' || source, 'n') AS og, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.again, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM docs JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
based AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM counts),
stats AS MATERIALIZED (SELECT *, {values} FROM based),
of_source AS (SELECT lg, og, count(*) AS n FROM stats WHERE NOT base_failed GROUP BY ALL),
of_lang AS (SELECT lg, sum(n) AS n_lang, min(n) < {rules.LEAST_ROWS} AS mixed FROM of_source GROUP BY lg),
named AS (SELECT lg, og, mixed, CASE WHEN n >= {rules.LEAST_ROWS} THEN og ELSE 'all' END AS sg FROM of_source JOIN of_lang USING (lg) WHERE n_lang >= {rules.LEAST_ROWS}),
placed AS MATERIALIZED (SELECT * FROM stats LEFT JOIN named USING (lg, og)),
grouped_rows AS MATERIALIZED (SELECT lg, sg, {a} FROM placed WHERE NOT base_failed AND sg IS NOT NULL
  UNION ALL SELECT lg, 'all', {a} FROM placed WHERE NOT base_failed AND mixed AND sg <> 'all'),
e0 AS MATERIALIZED (
  SELECT lg, sg, 'q' AS start, {estimate} FROM (SELECT *, {listed(rules.root_sql())} FROM (SELECT lg, sg, {", ".join(f"m{x}" for x in j)}, {spread} FROM (SELECT lg, sg, {quartiles} FROM grouped_rows GROUP BY ALL)))
  UNION ALL SELECT lg, sg, 's', {estimate} FROM ({estimated("grouped_rows", "lg, sg")}))"""]
    for i in range(rules.STEPS):
        ctes.append(f"""
d{i} AS MATERIALIZED ({measured(f"e{i}", "lg, sg, start")}),
h{i} AS (SELECT lg, sg, start, quantile_disc({ranked}, 0.5) AS half FROM d{i} GROUP BY ALL),
e{i + 1} AS MATERIALIZED ({estimated(f"(SELECT d{i}.* FROM d{i} JOIN h{i} USING (lg, sg, start) WHERE {ranked} <= half)", "lg, sg, start")})""")
    root = " * ".join(f"l{x}{x}" for x in j)
    ctes.append(f"""
chosen AS MATERIALIZED (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY lg, sg ORDER BY {root}, start) AS place FROM e{rules.STEPS}) WHERE place = 1),
dc AS MATERIALIZED ({measured("chosen", "lg, sg")}),
scales AS (SELECT lg, sg, exp(quantile_disc({ranked}, 0.5) / 1000.0) / {rules.CHI_HALF} AS scale FROM dc GROUP BY ALL),
final AS MATERIALIZED ({estimated(f"(SELECT dc.* FROM dc JOIN scales USING (lg, sg) WHERE d <= {rules.CHI_WEIGHT} * greatest(scale, 1.0))", "lg, sg")}),
judged AS (SELECT *, {plain(rules.distance_sql())} AS d FROM (SELECT *, {listed(rules.solved_sql())} FROM placed LEFT JOIN (SELECT lg, sg, {estimate} FROM final) USING (lg, sg)))""")
    shown = ", ".join(rules.COUNTS)
    return f"WITH {','.join(ctes)}\nSELECT doc_id, {shown}, base_failed, NOT base_failed AND coalesce(d <= {rules.CHI_REJECT}, true) AS kept FROM judged"


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op11_collocations": OP11, "op12_robust_rules": _op12(), "op13_ranked_search": OP13}
