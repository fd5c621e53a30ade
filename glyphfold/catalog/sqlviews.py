"""The derived views of :mod:`glyphfold.plans.views` as common table expressions."""

LINES = """v_lines AS (
  SELECT doc_id, CAST((n - 1) // 50 AS INTEGER) AS page, CAST(n AS INTEGER) AS line_no, text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"""

ATOMS = LINES + """, v_tok AS (
  SELECT doc_id, page, line_no, unnest(string_split(text, ' ')) AS text,
         CAST(generate_subscripts(string_split(text, ' '), 1) AS INTEGER) AS tok_no FROM v_lines),
v_atoms AS (
  SELECT doc_id, page, line_no, tok_no, text, CAST(coalesce(x, 0) AS DOUBLE) AS x,
         CAST(-((line_no - 1) % 50) AS DOUBLE) AS y, CAST(length(text) AS DOUBLE) AS w, 1.0::DOUBLE AS h,
         CASE WHEN regexp_matches(text, '^\\p{Lu}') THEN 'upper' WHEN regexp_matches(text, '^[0-9]+$') THEN 'digit'
              WHEN contains(text, '@') THEN 'at' ELSE 'other' END AS style_key,
         CAST((doc_id + tok_no) % 8 AS INTEGER) AS mode
  FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM v_tok)
  WHERE text <> '')"""

PAGES = """v_page_space AS (
  SELECT DISTINCT doc_id, page, 0.0::DOUBLE AS x0, -50.0::DOUBLE AS y0, 200.0::DOUBLE AS x1, 1.0::DOUBLE AS y1,
    CASE WHEN doc_id % 5 = 0 THEN 5.0::DOUBLE END AS cx0, CASE WHEN doc_id % 5 = 0 THEN -60.0::DOUBLE END AS cy0,
    CASE WHEN doc_id % 5 = 0 THEN 150.0::DOUBLE END AS cx1, CASE WHEN doc_id % 5 = 0 THEN 0.0::DOUBLE END AS cy1,
    CAST(90 * (doc_id % 4) AS INTEGER) AS rotate,
    CASE WHEN doc_id % 11 = 3 THEN 0.0::DOUBLE ELSE 1.0 + doc_id % 2 END AS user_unit
  FROM v_lines)"""

CATALOGUE = """v_catalogue AS (
  SELECT p_partkey AS font_id, lower(replace(p_name, ' ', '')) AS name_key,
    string_split(p_name, ' ')[-1] AS family_key,
    CASE p_type WHEN 'ECONOMY' THEN 300 WHEN 'PROMO' THEN 700 ELSE 400 END AS weight,
    p_size % 2 = 1 AS italic,
    CASE p_partkey % 3 WHEN 0 THEN range(97, 123) WHEN 1 THEN list_concat([32], range(97, 123))
         ELSE range(97, 117) END AS code_points,
    ['embedded', 'local', 'upload', 'bundled'][p_partkey % 4 + 1] AS source,
    p_partkey % 4 AS source_rank,
    sha256(p_name || '|' || p_brand) AS hash
  FROM part)"""

COMMANDS = """v_commands AS (
  SELECT user_id AS doc_id, event_id AS seq, ts,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'open' ELSE 'apply' END
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'preview' ELSE 'export' END
      WHEN 'click' THEN 'apply' WHEN 'purchase' THEN 'validate'
      ELSE CASE WHEN k % 7 = 0 THEN 'close' ELSE 'validate' END END AS op,
    CAST(k % 3 AS BIGINT) AS expected_revision, k % 5 <> 4 AS valid
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

EDITS = """v_edits AS (
  SELECT doc_id, page, line_no, text AS source_text,
    CASE WHEN doc_id % 2 = 0 THEN rpad('[REDACTED]', 14, '.') ELSE '[REDACTED]' END AS replacement,
    doc_id % 3 <> 0 AS accept_substitution
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(text, '@') THEN 0 ELSE 1 END,
          CASE WHEN contains(text, '@') THEN line_no ELSE -length(text) END, line_no) AS rn FROM v_lines)
  WHERE rn = 1)"""

# Lines with their place in the document text.
SPANS = LINES + """, v_spans AS (
  SELECT *, CAST(e - length(text) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (
    SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM v_lines))"""
