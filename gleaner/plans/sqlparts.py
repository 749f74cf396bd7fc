"""The staging views of `stage.py` spelled in SQL, for the oracle side."""

FIRST_LINE = r"^[^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*"
WS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_CHARS = " || ".join(f"chr({c})" for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


REC = f"""rec AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'https://example.org/d/' || doc_id AS url, source AS author,
         text AS caption, n_chars, n_chars AS likes, n_chars / 8.0 AS duration, lang AS genre, source,
         CASE WHEN text <> '' THEN substring(regexp_extract(text, '{FIRST_LINE}'), 1, 120)
              ELSE CAST(doc_id AS VARCHAR) END AS title0,
         {LINES} AS lines
  FROM documents),
records AS (
  SELECT *, CASE WHEN title0 <> '' THEN title0 ELSE id END AS title,
         CASE WHEN n_chars >= 300 THEN lines[1] ELSE '' END AS summary,
         CASE WHEN n_chars >= 1000 THEN id || '.mp4' END AS video_path,
         CASE WHEN n_chars >= 500 THEN id || '.jpg' END AS thumbnail_path,
         CASE WHEN n_chars >= 2000 THEN id || '.pdf' END AS pdf_path,
         CASE WHEN genre = 'en' THEN 'claude-cli' ELSE 'local' END AS backend,
         CASE WHEN n_chars >= 1000 THEN 'sonnet' ELSE '' END AS model,
         list_filter(lines, lambda x, i: i % 2 = 1) AS odd_lines
  FROM rec)"""

SLUG = "trim(regexp_replace(regexp_replace(lower({x}), '[ \\t\\r\\n]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-')"

TAGS = f"""tag_words AS (
  SELECT id, tag, min(pos) AS pos FROM (
    SELECT id, {SLUG.format(x='w')} AS tag, pos FROM (
      SELECT CAST(doc_id AS VARCHAR) AS id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w,
             generate_subscripts(string_split_regex(text, '[ \\t\\r\\n]+'), 1) AS pos
      FROM documents))
  WHERE tag <> '' GROUP BY id, tag),
tags AS (
  SELECT id, tag, nth FROM (
    SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM tag_words) WHERE nth <= 8)"""

ANNOTATIONS = """annotations AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, quality = 1 AS starred, quality = 0 AND toxic = 0 AS read,
         toxic = 1 AS archived, 'q' || quality AS note FROM labels)"""

LISTING = f"""{REC}, {ANNOTATIONS},
listing AS (
  SELECT r.*, coalesce(a.starred, false) AS starred, coalesce(a.read, false) AS read,
         coalesce(a.archived, false) AS archived
  FROM records r LEFT JOIN annotations a ON a.id = r.id)"""

MEMBERSHIP = """membership AS (
  SELECT unnest([lower(n_name), lower(c_mktsegment)]) AS slug, c_custkey AS pos,
         CAST(c_custkey AS VARCHAR) AS record_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

FACTS = "facts AS (SELECT conv_id AS record_id, role AS arm, turn AS pos, text FROM conversations)"

ORDER_TAGS = """order_tags AS (
  SELECT DISTINCT l_orderkey AS id, lower(p_type) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORDER_MEMBERS = "order_members AS (SELECT lower(o_orderpriority) AS slug, o_orderkey AS record_id FROM orders)"
