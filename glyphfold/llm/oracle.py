"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

OP3 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.doc_id, pos, line, (last IS NOT NULL AND keyed.doc_id <> last) AS dropped
  FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_PLAIN = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH item_words AS (
  SELECT item_id, {_PLAIN} AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT item_id, w, least(5, len(w)) AS width, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, {_PLAIN} AS w FROM documents WHERE doc_id IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM doc_words, (SELECT DISTINCT width FROM item_shingles) WHERE len(w) >= width)
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item_shingles,
  count(*)::DOUBLE / any_value(n) AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*)::DOUBLE / any_value(n) >= 0.8
"""

OP8 = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
    coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * word_chars < 30 * n_words OR 10 * word_chars > 120 * n_words OR 10 * n_symbols > n_words
      OR 10 * n_dup_lines > n_words OR 10 * n_stutter > n_words AS narrow,
    10 * word_chars < 20 * n_words OR 10 * word_chars > 200 * n_words OR 10 * n_symbols > 3 * n_words
      OR 10 * n_dup_lines > 3 * n_words OR 10 * n_stutter > 3 * n_words AS wide
  FROM measured
), hosts AS (
  SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR narrow) AS failures FROM judged GROUP BY source
), moments AS (
  SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM moments
), verdicts AS (
  SELECT source, (failures + m * strength) / (docs + strength) > 0.3 AS distrusted FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter, base_failed,
  NOT base_failed AND NOT wide AND NOT (distrusted AND (base_failed OR narrow)) AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

OP11 = r"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM doc_terms
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc_terms)
  GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM held, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms JOIN held USING (term) JOIN weights USING (term), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def lloyd_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Rounds of assignment and update, one pair of table expressions each; an entry is a list of whole numbers."""
    steps = [
        f"""WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), cut AS (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
  FROM vectors, (SELECT unnest(range({parts})) AS p)
), book0 AS (
  SELECT p, e, x AS c FROM (
    SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut
  ) WHERE e < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
  SELECT vec_id, label, p, x, e, d FROM (
    SELECT vec_id, label, cut.p, x, e,
      list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut JOIN book{k} ON cut.p = book{k}.p
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
)""")
        if k < rounds:
            steps.append(f"""means{k} AS (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, e, j, floor(sum(x[j + 1])::HUGEINT / count(*))::BIGINT AS m
    FROM near{k}, (SELECT unnest(range((SELECT max(len(x)) FROM cut))) AS j) GROUP BY p, e, j
  ) GROUP BY p, e
), book{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e
)""")
    return ",\n".join(steps) + f""",
coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded, digest"""


OP12 = lloyd_sql()

OP13 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS low FROM windows GROUP BY s
), removed AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM windows JOIN firsts USING (s), (SELECT unnest(range(13)) AS k) WHERE doc_id > low
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) ANTI JOIN removed USING (doc_id, i)
  GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id LEFT JOIN gone ON words.doc_id = gone.doc_id
"""

ORACLE: dict[str, str] = {
    "op3_line_dedup": OP3,
    "op4_decontamination": OP4,
    "op8_host_quality": OP8,
    "op11_ball_tree_search": OP11,
    "op12_vector_codes": OP12,
    "op13_substring_dedup": OP13,
}
