"""The catalog's queries in plain SQL over the driver's tables, written from the rules, not from the operators."""

from __future__ import annotations

from ..config import CLASSIFIER_SYNONYMS, EXTRACTOR_SYNONYMS, ClassifierConfig, Title
from . import adapters as A
from .catalog import HEADER_WORDS, QUANTITIES, TITLES, WITHOUT_PAGES


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def synonyms(name: str, words: dict[str, list[str]]) -> str:
    """name(ord, category, word, norm): no listed word but 'sr. no' has a full stop, and it keeps it, as none ends in one."""
    flat = [(c, w) for c, ws in words.items() for w in ws]
    return f"{name}(ord, category, word) AS (VALUES {values([(i, c, w) for i, (c, w) in enumerate(flat)])})"


LINES = """lines AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn, l_partkey,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '-K' || l_linenumber END AS tag,
    CASE WHEN l_partkey % 7 = 0 THEN '1,5' WHEN l_partkey % 11 = 0 THEN '3m' WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
    p_name || CASE WHEN l_partkey % 17 = 0 THEN ' see /12.3' ELSE '' END || CASE WHEN l_partkey % 19 = 0 THEN '�' ELSE '' END AS descr,
    p_type AS model, s_name AS maker, CASE WHEN l_suppkey % 3 = 0 THEN 'x' || l_suppkey ELSE '' END AS note
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

#: The main table's rows of each order and parser, before the header row that stands among them where o % 4 = 3.
BODY = LINES + """,
body0 AS (
  SELECT DISTINCT o, 0 AS pos, '+S' || (o % 10) AS c0, '' AS c1, '' AS c2, '' AS c3, '' AS c4, '' AS c5, NULL AS k FROM lines WHERE o % 3 = 0
  UNION ALL SELECT o, rn, tag, qty, descr, model, maker, note, l_partkey FROM lines
  UNION ALL SELECT DISTINCT o, 1000, '', '', '', '', '', '', NULL FROM lines WHERE o % 4 = 1),
body AS (
  SELECT 'pymupdf' AS parser, * FROM body0 WHERE o % 9 <> 4
  UNION ALL SELECT 'pdfplumber', * FROM body0 WHERE k IS NULL OR k % 4 <> 0),
orders_ AS (SELECT DISTINCT o, CAST(o // 8 AS VARCHAR) AS doc, CAST(o % 8 + 1 AS INTEGER) AS page FROM lines),
heads(kind, h0, h1, h2, h3, h4, h5) AS (VALUES
  (0, 'Item', 'Qty', 'Description', 'Type', 'Supplier', 'Foo'), (1, 'Pos.', 'Quantty', 'Omschrijvng', 'Model No', 'Fabrikant', 'Foo'),
  (2, '', 'Amount', 'Function text', 'Type number', 'Make', 'Designation'), (3, 'Tag', 'Pcs', 'Descr', 'Model', 'Brand', 'Foo')),
tabs AS (
  SELECT o, parser, 0 AS table_index, o % 4 = 3 AS promoted, count(*) AS n_rows, 6 AS n_cols FROM body GROUP BY o, parser
  UNION ALL SELECT o, 'pymupdf', 1, false, 1, 3 FROM orders_ WHERE o % 5 = 0 AND o % 9 <> 4
  UNION ALL SELECT o, 'pymupdf', 2, false, 1, 6 FROM orders_ WHERE o % 7 = 0 AND o % 9 <> 4),
sel AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o, parser ORDER BY n_rows, n_cols, table_index) AS r FROM tabs WHERE n_cols BETWEEN 4 AND 11 AND n_rows >= 1) WHERE r = 1),
pref AS (
  SELECT * EXCLUDE q FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY parser DESC) AS q FROM sel) WHERE q = 1)"""

#: Rows of the chosen tables without blank ones; row_pos counts the blank ones too.
ROWS = BODY + """,
mine AS (
  SELECT p.o, p.table_index, b.pos, b.c0, b.c1, b.c2, b.c3, b.c4, b.c5, b.k,
    CAST(row_number() OVER (PARTITION BY p.o ORDER BY b.pos) - 1 AS INTEGER) AS row_pos
  FROM pref p JOIN body b ON b.o = p.o AND b.parser = p.parser WHERE p.table_index = 0
  UNION ALL SELECT o, 2, 1, '-X1', '1', 'Decoy', 'T', 'M', '', NULL, 0 FROM pref WHERE table_index = 2),
kept AS (SELECT *, pos = 0 AS is_section_header, CASE WHEN table_index = 0 AND o % 3 = 0 THEN '+S' || (o % 10) END AS label FROM mine WHERE pos <> 1000),
data AS (
  SELECT *, CASE WHEN c0 = '' AND label IS NOT NULL THEN label END AS inherited,
    CASE WHEN table_index = 0 AND o % 4 = 2 THEN CASE WHEN c5 <> '' AND c5 <> c2 THEN c2 || chr(10) || c5 ELSE c2 END ELSE c2 END AS descr,
    CASE WHEN table_index = 0 AND o % 4 = 2 THEN '{}' ELSE '{"foo":"' || c5 || '"}' END AS extra
  FROM kept WHERE NOT is_section_header),
canon AS (
  SELECT CAST(o // 8 AS VARCHAR) AS source_pdf, CAST(o % 8 + 1 AS INTEGER) AS source_page, CAST(NULL AS VARCHAR) AS source_section,
    CAST(row_number() OVER (PARTITION BY o // 8 ORDER BY o % 8, row_pos) - 1 AS INTEGER) AS row_index,
    nullif(coalesce(inherited, c0), '') AS device_tag, CASE WHEN c1 = '1,5' THEN '1.5' ELSE nullif(c1, '') END AS quantity,
    CASE WHEN c1 = '' THEN NULL WHEN c1 = '1,5' THEN 'float' WHEN c1 = '3m' THEN 'text' ELSE 'int' END AS quantity_kind,
    descr AS description, c4 AS manufacturer, c3 AS model_number, CAST(NULL AS VARCHAR) AS order_number,
    CASE WHEN descr LIKE '%/12.3%' THEN '/12.3' END AS schematic_position, extra AS extra_fields,
    c0 || '|' || c1 || '|' || c2 || '|' || c3 || '|' || c4 || '|' || c5 AS raw, '["' || concat_ws('","', c0, c1, c2, c3, c4, c5) || '"]' AS raw_json,
    concat_ws('|', CASE WHEN contains(descr, '�') THEN 'encoding_replacement_char_found:description' END, CASE WHEN c1 = '3m' THEN 'quantity_unparseable:''3m''' END) AS warnings
  FROM data)"""

AGREE = BODY + """,
sides AS (
  SELECT x.doc, x.page, coalesce(a.n_rows, 0) AS p, coalesce(b.n_rows, 0) AS s
  FROM orders_ x LEFT JOIN sel a ON a.o = x.o AND a.parser = 'pymupdf' LEFT JOIN sel b ON b.o = x.o AND b.parser = 'pdfplumber'),
agree AS (
  SELECT doc, page, CAST(p AS INTEGER) AS primary_rows, CAST(s AS INTEGER) AS secondary_rows,
    CASE WHEN abs(p - s) > 1 THEN 'page ' || page || ': pymupdf=' || p || ' pdfplumber=' || s || ' diff=' || abs(p - s) || ' tolerance=1' END AS warning FROM sides)"""

#: Every header row there is, cell by cell; 0 to 3 by an order's number, 7 and 9 of the two small tables, matched against
#: the settings' words by the rules of the page signals (hc) and of the column mapping (m).
_HEADS = {**dict(enumerate(A.HEADERS)), 7: A.DECOYS[1][0], 9: A.DECOYS[2][0]}
HEAD_CELLS = f"""{synonyms('cs', CLASSIFIER_SYNONYMS)}, {synonyms('es', EXTRACTOR_SYNONYMS)},
hd(kind, i, raw) AS (VALUES {values([(k, i, h) for k, hs in _HEADS.items() for i, h in enumerate(hs)])}),
hs AS (SELECT *, trim(regexp_replace(lower(replace(raw, '�', '.')), '\\s+', ' ', 'g')) AS s FROM hd),
hn AS (SELECT kind, i, raw, nullif(regexp_replace(s, '[:.\\s]+$', ''), '') AS a, trim(regexp_replace(s, '[:.]+$', '')) AS norm FROM hs)"""
CATEGORIES = f"""{HEAD_CELLS},
hc AS (
  SELECT * FROM (SELECT n.kind, n.i, n.raw, y.category, row_number() OVER (PARTITION BY n.kind, n.i ORDER BY n.a <> y.word, levenshtein(n.a, y.word), y.ord) AS r
    FROM hn n JOIN cs y ON n.a = y.word OR length(n.a) >= 4 AND length(y.word) >= 4 AND levenshtein(n.a, y.word) <= 2) WHERE r = 1),
hcat AS (SELECT kind, CAST(count(DISTINCT category) AS INTEGER) AS cats, array_to_string(list_sort(list_distinct(list(category))), '|') AS categories, string_agg(raw, '|' ORDER BY i) AS headers FROM hc GROUP BY kind)"""
MAPPED = f"""{HEAD_CELLS},
hit AS (
  SELECT * FROM (SELECT n.kind, n.i, y.category AS field, CASE WHEN n.norm = y.word THEN 'exact' ELSE 'fuzzy' END AS method, levenshtein(n.norm, y.word) AS distance, y.word AS synonym,
      row_number() OVER (PARTITION BY n.kind, n.i ORDER BY levenshtein(n.norm, y.word), y.ord) AS r
    FROM hn n JOIN es y ON n.norm <> '' AND (n.norm = y.word OR length(n.norm) >= 4 AND levenshtein(n.norm, y.word) <= 2)) WHERE r = 1),
place AS (SELECT n.*, h.field, h.method, h.distance, h.synonym, n.i = 0 AND h.field IS NULL AND n.kind NOT IN (SELECT kind FROM hit WHERE field = 'device_tag') AS first
  FROM hn n LEFT JOIN hit h ON h.kind = n.kind AND h.i = n.i),
m AS (SELECT kind, i, raw, norm, CASE WHEN first THEN 'device_tag' ELSE field END AS field, CASE WHEN first THEN 'positional' ELSE coalesce(method, 'none') END AS method, CAST(coalesce(distance, 0) AS INTEGER) AS distance, synonym FROM place)"""

#: What the page signals see: the primary parser's tables as grids, the header row first. Of an order whose number leaves 3,
#: the first row is a title and the header the second.
GRIDS = BODY + """,
seen AS (
  SELECT o, 0 AS table_index, o % 4 AS kind, count(*) + CASE WHEN o % 4 = 3 THEN 2 ELSE 1 END AS size, 6 AS width,
    CAST(count(*) FILTER (WHERE pos NOT IN (0, 1000)) + CASE WHEN o % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS n FROM body WHERE parser = 'pymupdf' GROUP BY o
  UNION ALL SELECT o, 1, 7, 2, 3, 1 FROM orders_ WHERE o % 5 = 0 AND o % 9 <> 4
  UNION ALL SELECT o, 2, 9, 2, 6, 1 FROM orders_ WHERE o % 7 = 0 AND o % 9 <> 4)"""

_H = ClassifierConfig().signals.column_header
HEADER = f"""{GRIDS}, {CATEGORIES},
head2 AS (
  SELECT o, doc, page, CASE WHEN cats >= {_H.strong_threshold} THEN {float(_H.strong_weight)} WHEN cats >= {_H.weak_threshold} THEN {float(_H.weak_weight)} ELSE 0.0 END AS score, cats AS categories_found,
    CASE WHEN cats >= {_H.strong_threshold} THEN 'strong' WHEN cats >= {_H.weak_threshold} THEN 'weak' ELSE 'none' END AS qualification, categories, headers, table_index, header_row, tables_scanned
  FROM (SELECT x.*, c.cats, c.categories, c.headers, s.table_index, CASE WHEN s.kind = 3 THEN 1 ELSE 0 END AS header_row, count(*) OVER (PARTITION BY s.o) AS tables_scanned,
      row_number() OVER (PARTITION BY s.o ORDER BY c.cats DESC, s.table_index) AS r FROM seen s JOIN hcat c ON c.kind = s.kind JOIN orders_ x ON x.o = s.o) WHERE r = 1)"""

COUNT = HEADER + """,
cand AS (SELECT *, width >= 3 AND n >= 2 AS ok FROM seen),
best AS (
  SELECT o, max(n) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok) AS candidates, string_agg(n, '|' ORDER BY table_index) AS per_table FROM cand GROUP BY o),
rowsig AS (
  SELECT x.o, x.doc, x.page, CASE WHEN b.n >= 10 THEN 3.0 WHEN b.n >= 5 THEN 1.0 WHEN b.n >= 1 THEN -2.0 ELSE 0.0 END AS score, coalesce(b.n, 0) AS rows,
    CASE WHEN b.n >= 10 THEN 'strong' WHEN b.n >= 5 THEN 'weak' WHEN b.n >= 1 THEN 'negative' ELSE 'none' END AS qualification,
    (SELECT min(table_index) FROM cand c WHERE c.o = b.o AND c.ok AND c.n = b.n) AS table_index, b.candidates, b.per_table
  FROM best b JOIN orders_ x ON x.o = b.o)"""

SCORES = COUNT + """,
scored0 AS (
  SELECT x.o, x.doc, x.page, CASE WHEN x.o % 6 = 0 OR x.o % 10 = 0 THEN 3.0 ELSE 0.0 END AS title, h.score AS header, r.score AS row_score,
    CASE WHEN x.o * 37 % 2000 + x.o % 5 <= 500 THEN 2.0 WHEN x.o * 37 % 2000 + x.o % 5 >= 1500 THEN -1.0 ELSE 0.0 END AS density,
    h.table_index AS best_table_index, coalesce(h.headers, '') AS headers, coalesce(r.rows, 0) AS rows
  FROM orders_ x LEFT JOIN head2 h ON h.o = x.o LEFT JOIN rowsig r ON r.o = x.o),
scored AS (SELECT *, title + coalesce(header, 0) + coalesce(row_score, 0) + density AS total0 FROM scored0),
cont AS (
  SELECT s.*, CASE WHEN a.total0 >= 7 OR b.total0 >= 7 THEN 2.0 ELSE 0.0 END AS bonus
  FROM scored s LEFT JOIN scored a ON a.doc = s.doc AND a.page = s.page - 1 LEFT JOIN scored b ON b.doc = s.doc AND b.page = s.page + 1),
final AS (SELECT *, total0 + bonus AS total_score FROM cont)"""

ISLANDS = SCORES + """,
isl AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY doc ORDER BY page) = 1 THEN 0 ELSE 1 END AS brk FROM final WHERE total_score >= 7)),
fp AS (
  SELECT *, list_filter(string_split(lower(headers), '|'), lambda x: x <> '') AS prints, row_number() OVER (PARTITION BY doc, island ORDER BY page) AS i FROM isl)"""

FOLD = "WITH RECURSIVE " + ISLANDS + """,
fold(doc, island, i, page, part, known) AS (
  SELECT doc, island, i, page, 0, prints FROM fp WHERE i = 1
  UNION ALL
  SELECT n.doc, n.island, n.i, n.page, f.part + CASE WHEN u.apart THEN 1 ELSE 0 END, CASE WHEN u.apart THEN n.prints ELSE list_distinct(list_concat(f.known, n.prints)) END
  FROM fold f JOIN fp n ON n.doc = f.doc AND n.island = f.island AND n.i = f.i + 1,
  LATERAL (SELECT len(f.known) > 0 AND len(n.prints) > 0 AND len(list_intersect(f.known, n.prints)) / len(list_distinct(list_concat(f.known, n.prints))) < 0.6 AS apart) u),
part AS (SELECT p.*, f.part FROM fp p JOIN fold f ON f.doc = p.doc AND f.island = p.island AND f.i = p.i)"""

_SUMMARY = """,
run0 AS (
  SELECT doc, island, part, min(page) AS start_page, max(page) AS end_page, string_agg(page, '|' ORDER BY page) AS pages, avg(total_score) AS mean_score,
    array_to_string(list_sort(list_distinct(flatten(list(prints)))), '|') AS fingerprint, sum(rows) AS total_rows,
    count(*) FILTER (WHERE total_score >= 12) AS strong_pages, count(*) FILTER (WHERE total_score < 12) AS weak_pages
  FROM part GROUP BY doc, island, part)"""

_MATCH = f"""{synonyms('cs', CLASSIFIER_SYNONYMS)}, {synonyms('es', EXTRACTOR_SYNONYMS)},
words AS (SELECT DISTINCT h FROM (SELECT unnest([p_name, p_type, p_brand]) AS h FROM part UNION ALL SELECT * FROM (VALUES {values([(w,) for w in HEADER_WORDS])}) v(h))),
plain AS (SELECT h, trim(regexp_replace(lower(replace(h, '�', '.')), '\\s+', ' ', 'g')) AS s, trim(regexp_replace(lower(h), '\\s+', ' ', 'g')) AS c FROM words),
norm AS (SELECT h, nullif(regexp_replace(s, '[:.\\s]+$', ''), '') AS a, trim(regexp_replace(s, '[:.]+$', '')) AS b, c FROM plain),
ca AS (
  SELECT h, category FROM (SELECT n.h, y.category, row_number() OVER (PARTITION BY n.h ORDER BY n.a <> y.word, levenshtein(n.a, y.word), y.ord) AS r
    FROM norm n JOIN cs y ON n.a = y.word OR length(n.a) >= 4 AND length(y.word) >= 4 AND levenshtein(n.a, y.word) <= 2) WHERE r = 1),
eb AS (
  SELECT * FROM (SELECT n.h, y.category AS field, CASE WHEN n.b = y.word THEN 'exact' ELSE 'fuzzy' END AS method, levenshtein(n.b, y.word) AS distance, y.word AS synonym,
      row_number() OVER (PARTITION BY n.h ORDER BY levenshtein(n.b, y.word), y.ord) AS r
    FROM norm n JOIN es y ON n.b <> '' AND (n.b = y.word OR length(n.b) >= 4 AND levenshtein(n.b, y.word) <= 2)) WHERE r = 1),
qc AS (SELECT DISTINCT n.h FROM norm n JOIN es y ON y.category = 'quantity' AND (n.c = y.word OR length(n.c) >= 4 AND length(y.word) >= 4 AND levenshtein(n.c, y.word) <= 2))"""

_ENDS = """o AS (SELECT CAST(o_orderkey // 6 AS VARCHAR) AS doc, o_orderkey % 6 AS i, o_custkey % 7 AS w FROM orders),
e AS (SELECT doc, CAST(i * 5 + 1 AS INTEGER) AS exp_start, CAST(i * 5 + 1 + w AS INTEGER) AS exp_end FROM o WHERE i % 2 = 0),
g AS (SELECT doc, CAST(i * 5 - 3 AS INTEGER) AS got_start, CAST(i * 5 - 3 + w AS INTEGER) AS got_end FROM o WHERE i % 2 = 1),
pairs AS (SELECT e.doc, exp_start, exp_end, got_start, got_end, least(exp_end, got_end) - greatest(exp_start, got_start) + 1 AS shared FROM e JOIN g ON e.doc = g.doc AND exp_start <= got_end AND got_start <= exp_end)"""

_WORDS = """t AS (SELECT CAST(conv_id // 4 AS VARCHAR) AS doc, CAST(conv_id % 4 * 100 + turn + 1 AS INTEGER) AS page, CAST(conv_id % 4 AS INTEGER) AS run_idx, string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS w FROM conversations),
w AS (SELECT doc, page, run_idx, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM t)"""

_LABELS = """,
size_ AS (SELECT doc, run_idx, count(DISTINCT page) AS pages FROM t GROUP BY doc, run_idx),
many AS (SELECT doc FROM size_ GROUP BY doc HAVING count(*) > 1),
here AS (SELECT k.doc, run_idx, token, count(DISTINCT page) AS n FROM k JOIN many USING (doc) GROUP BY k.doc, run_idx, token),
own AS (
  SELECT h.doc, h.run_idx, h.token FROM here h JOIN size_ s ON s.doc = h.doc AND s.run_idx = h.run_idx AND s.pages = h.n
  WHERE NOT EXISTS (SELECT 1 FROM here x WHERE x.doc = h.doc AND x.token = h.token AND x.run_idx <> h.run_idx)),
labels_ AS (SELECT doc, run_idx, token FROM (SELECT *, row_number() OVER (PARTITION BY doc, run_idx ORDER BY length(token) DESC, token) AS r FROM own) WHERE r = 1)"""

_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"

_SHEET = ROWS + """,
sheet AS (
  SELECT source_pdf, row_index, quantity AS aantal, 'Stuks' AS eenheid, device_tag AS klantartikel, description AS omschrijving, manufacturer AS fabrikant, model_number AS type_bestelnummer,
    CAST(NULL AS VARCHAR) AS toegeleverd, CAST(NULL AS VARCHAR) AS odc_code, nullif(replace(warnings, '|', '; '), '') AS opmerking, CAST(NULL AS VARCHAR) AS ean_code FROM canon)"""

_PAGES = "pg AS (SELECT DISTINCT CAST(l_orderkey // 8 AS VARCHAR) AS doc, CAST(l_orderkey % 8 // 4 AS INTEGER) AS run_idx, CAST(l_orderkey % 8 + 1 AS INTEGER) AS page FROM lineitem)"

SQL: dict[str, str] = {
    "title_signal": "WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn + 1 AS INTEGER) AS page, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, {quote(p)}, 'i') THEN {quote(p)} END" for p in TITLES) + ") AS patterns, " + " + ".join(f"CAST(coalesce(regexp_matches(text, {quote(p)}, 'i'), false) AS INTEGER)" for p in TITLES) + " AS n_patterns FROM conversations) SELECT doc, page, CASE WHEN n_patterns > 0 THEN 3.0 ELSE 0.0 END AS score, n_patterns, patterns FROM h",
    "title_snippet": rf"SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn + 1 AS INTEGER) AS page, trim(regexp_replace(regexp_extract(text, '(?is).{{0,30}}?(?:{TITLES[0]}).{{0,30}}'), '\s+', ' ', 'g')) AS snippet FROM conversations WHERE regexp_matches(text, {quote(TITLES[0])}, 'i')",
    "title_snippets": "SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn + 1 AS INTEGER) AS page, trim(regexp_replace(CASE " + " ".join(rf"WHEN regexp_matches(text, {quote(p)}, 'i') THEN regexp_extract(text, {quote(f'(?is).{{0,30}}?(?:{p}).{{0,30}}')})" for p in TITLES) + r" END, '\s+', ' ', 'g')) AS snippet FROM conversations WHERE " + " OR ".join(f"regexp_matches(text, {quote(p)}, 'i')" for p in TITLES),
    "title_unicode": f"""WITH t AS (SELECT p_partkey, 'Sheet ' || p_partkey || ': PARTS' || [' ', chr(160), chr(8195) || ' ', chr(10), '', '-'][p_partkey % 6 + 1] || 'List, ' || p_name AS page FROM part),
h AS (SELECT p_partkey, {" + ".join(f"CAST(regexp_matches(replace(replace(page, chr(160), ' '), chr(8195), ' '), {quote(p)}, 'i') AS INTEGER)" for p in Title().patterns)} AS n_patterns FROM t)
SELECT p_partkey, CASE WHEN n_patterns > 0 THEN 3.0 ELSE 0.0 END AS score, n_patterns FROM h""",
    "required_fields": """WITH r AS (SELECT p_partkey AS row_index, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(160) || ' ' WHEN 2 THEN NULL ELSE p_name END AS said FROM part)
SELECT row_index, CASE WHEN said = '' THEN NULL ELSE trim(replace(said, chr(160), ' ')) END AS description, CASE WHEN coalesce(trim(replace(said, chr(160), ' ')), '') = '' THEN 'required_field_missing:description' ELSE '' END AS warnings FROM r""",
    "header_normalize": r"""WITH s AS (
  SELECT p_partkey, '  ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE p_partkey % 3 WHEN 0 THEN chr(10) || chr(9) || 'No. :' WHEN 1 THEN ' :. ' ELSE '.:' END || CASE WHEN p_partkey % 5 = 0 THEN '�' ELSE '' END AS h FROM part),
 n AS (SELECT p_partkey, lower(trim(regexp_replace(replace(h, '�', '.'), '\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS c FROM s)
SELECT p_partkey, nullif(regexp_replace(x, '[:.\s]+$', ''), '') AS a, trim(regexp_replace(x, '[:.]+$', '')) AS b, c FROM n""",
    "header_match": f"WITH {_MATCH} SELECT n.h, ca.category, eb.field, coalesce(eb.method, 'none') AS method, coalesce(eb.distance, 0) AS distance, eb.synonym, qc.h IS NOT NULL AS is_quantity FROM norm n LEFT JOIN ca USING (h) LEFT JOIN eb USING (h) LEFT JOIN qc USING (h)",
    "column_header_signal": f"WITH {HEADER} SELECT * EXCLUDE o FROM head2",
    "row_count_signal": f"WITH {COUNT} SELECT doc, page, score, rows, qualification, table_index, candidates, per_table FROM rowsig",
    "vector_density": "WITH c AS (SELECT CAST(page_id AS VARCHAR) AS doc, CAST((length(html) - length(replace(html, '<li', ''))) // 3 + (length(html) - length(replace(html, '<a', ''))) // 2 + (length(html) - length(replace(html, '<p', ''))) // 2 AS BIGINT) AS primitives FROM pages) SELECT doc, CASE WHEN primitives <= 8 THEN 2.0 WHEN primitives >= 14 THEN -1.0 ELSE 0.0 END AS score, primitives FROM c",
    "page_score": f"WITH {SCORES} SELECT doc, page, title, header, row_score, density, total0 AS total_score, best_table_index, headers, rows FROM scored",
    "continuity": f"WITH {SCORES} SELECT doc, page, bonus, total_score FROM final",
    "runs_islands": f"WITH {ISLANDS} SELECT doc, page, island FROM isl",
    "runs_fold": f"{FOLD} SELECT doc, island, part, page, array_to_string(prints, '|') AS prints FROM part",
    "run_summary": f"{FOLD}{_SUMMARY} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY start_page) - 1 AS INTEGER) AS run_idx, start_page, end_page, pages, round(mean_score, 6) AS mean_score, fingerprint, CAST(total_rows AS BIGINT) AS total_rows, round(greatest(0.0, least(1.0, mean_score / 20)), 6) AS confidence, strong_pages, weak_pages FROM run0 WHERE strong_pages > 0 AND total_rows >= 3",
    "top10_pages": f"WITH {SCORES}, bound AS (SELECT CAST(CAST(doc AS BIGINT) // 5 AS VARCHAR) AS doc, CAST(CAST(doc AS BIGINT) % 5 * 8 + page AS INTEGER) AS page, total_score FROM final) SELECT * FROM (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc ORDER BY total_score DESC, page) AS INTEGER) AS rank, total_score FROM bound) WHERE rank <= 10",
    "page_report": f"WITH {SCORES} SELECT doc, page AS page_number, total_score, rows AS row_count, title, header AS column_header, row_score, density AS vector_density, bonus AS continuity FROM final",
    "promote_header": f"WITH {BODY} SELECT x.doc, x.page, t.parser, t.table_index, t.promoted, CASE t.table_index WHEN 1 THEN 'A|Qty|B' WHEN 2 THEN 'Item|Qty|Description|Type|Make|Foo' ELSE concat_ws('|', h0, h1, h2, h3, h4, h5) END AS headers, CAST(t.n_rows AS INTEGER) AS n_rows, t.n_cols FROM tabs t JOIN orders_ x ON x.o = t.o JOIN heads ON kind = t.o % 4",
    "select_table": f"WITH {BODY} SELECT x.doc, x.page, s.parser, s.table_index, CAST(s.n_rows AS INTEGER) AS n_rows, s.n_cols FROM sel s JOIN orders_ x ON x.o = s.o",
    "parser_preference": f"WITH {BODY} SELECT x.doc, x.page, s.parser, s.table_index, CAST(s.n_rows AS INTEGER) AS n_rows FROM pref s JOIN orders_ x ON x.o = s.o",
    "consensus": f"WITH {AGREE} SELECT * FROM agree",
    "pages_without_table": f"WITH {BODY} SELECT doc, page FROM orders_ WHERE o NOT IN (SELECT o FROM sel)",
    "map_columns": f"""WITH {BODY}, {MAPPED} SELECT x.doc, x.page, p.parser, p.table_index, m.i AS column_index, m.raw AS raw_header, m.norm AS normalized_header, m.field AS canonical_field, m.method AS match_method, m.distance AS match_distance, m.synonym AS matched_synonym
FROM pref p JOIN orders_ x ON x.o = p.o JOIN m ON m.kind = CASE WHEN p.table_index = 2 THEN 9 ELSE p.o % 4 END""",
    "merged_columns": f"WITH {BODY}, {MAPPED} SELECT x.doc, x.page, m.field AS canonical_field, count(*) AS columns FROM pref p JOIN orders_ x ON x.o = p.o JOIN m ON m.kind = CASE WHEN p.table_index = 2 THEN 9 ELSE p.o % 4 END WHERE m.field IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "section_rows": f"WITH {ROWS} SELECT x.doc, x.page, k.row_pos, k.is_section_header, k.c0 AS first_cell FROM kept k JOIN orders_ x ON x.o = k.o",
    "inherit_tag": f"WITH {ROWS} SELECT x.doc, x.page, k.row_pos, coalesce(k.inherited, k.c0) AS device_tag, k.inherited AS inherited_device_tag FROM data k JOIN orders_ x ON x.o = k.o",
    "extra_fields": f"WITH {ROWS} SELECT x.doc, x.page, k.row_pos, k.descr AS description, k.extra FROM data k JOIN orders_ x ON x.o = k.o",
    "parse_quantity": f"""WITH {LINES}, s AS (SELECT qty AS raw FROM lines UNION ALL SELECT * FROM (VALUES {values([(q,) for q in QUANTITIES])}) v(raw)),
g AS (SELECT raw, count(*) AS n, trim(raw) AS t FROM s GROUP BY raw),
p AS (SELECT *, CASE WHEN length(t) - length(replace(t, ',', '')) = 1 AND NOT contains(t, '.') THEN replace(t, ',', '.') ELSE t END AS c FROM g),
k AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '{_INT}') THEN 'int' WHEN regexp_matches(c, '{_FLOAT}') THEN 'float' ELSE 'text' END AS kind FROM p)
SELECT raw, n, kind, CASE WHEN kind = 'int' THEN CAST(CAST(replace(t, '_', '') AS HUGEINT) AS VARCHAR) END AS i, CASE WHEN kind = 'float' THEN CAST(replace(c, '_', '') AS DOUBLE) END AS d, CASE WHEN kind = 'text' THEN raw END AS s,
  CASE WHEN kind = 'text' THEN 'quantity_unparseable:' || CASE WHEN contains(raw, '''') AND NOT contains(raw, '"') THEN '"' || raw || '"' ELSE '''' || replace(raw, '''', '\\''') || '''' END END AS warning FROM k""",
    "canonical_rows": f"WITH {ROWS} SELECT * EXCLUDE raw_json FROM canon",
    "validation_audit": f"""WITH {AGREE}, {ROWS.removeprefix(BODY + ",")},
r AS (SELECT source_pdf, count(*) AS n, count(*) FILTER (WHERE warnings <> '') AS w, count(*) FILTER (WHERE contains(warnings, 'encoding')) AS e,
   max(device_tag IS NOT NULL) AS a, max(quantity IS NOT NULL) AS b, max(schematic_position IS NOT NULL) AS c FROM canon GROUP BY source_pdf),
i AS (SELECT doc, string_agg(warning, '|' ORDER BY page) AS consensus, string_agg(page, '|' ORDER BY page) AS issue_pages FROM agree WHERE warning IS NOT NULL GROUP BY doc),
l AS (SELECT doc, string_agg(page, '|' ORDER BY page) AS tableless FROM orders_ WHERE o NOT IN (SELECT o FROM sel) GROUP BY doc)
SELECT d.doc AS source_pdf, CAST(coalesce(r.n, 0) AS INTEGER) AS total_rows, CASE WHEN d.doc NOT IN (SELECT doc FROM orders_) THEN 'no_page_runs_provided' END AS note, CAST(coalesce(r.w, 0) AS INTEGER) AS rows_with_warnings, CAST(coalesce(r.e, 0) AS INTEGER) AS encoding_warnings_total,
  coalesce(i.consensus, '') AS consensus, coalesce(i.issue_pages, '') AS issue_pages, coalesce(l.tableless, '') AS tableless,
  concat_ws('|', CASE WHEN NOT coalesce(r.a, false) THEN 'device_tag' END, CASE WHEN NOT coalesce(r.b, false) THEN 'quantity' END, CASE WHEN r.n IS NULL THEN 'description|manufacturer|model_number' END, 'order_number', CASE WHEN NOT coalesce(r.c, false) THEN 'schematic_position' END) AS never
FROM (SELECT DISTINCT doc FROM orders_ UNION ALL SELECT * FROM (VALUES {values([(x,) for x in WITHOUT_PAGES])}) v(doc)) d LEFT JOIN r ON r.source_pdf = d.doc LEFT JOIN i ON i.doc = d.doc LEFT JOIN l ON l.doc = d.doc""",
    "metrics": f"WITH {ROWS} SELECT count(*) AS total_rows, count(DISTINCT (source_pdf, source_page)) AS pages, count(DISTINCT CASE WHEN source_page % 3 = 0 THEN 'S' || source_page END) AS n_sections, count(*) FILTER (WHERE warnings <> '') AS rows_with_warnings FROM canon",
    "fill_rates": f"WITH {ROWS}, u AS (SELECT source_pdf, unnest(['device_tag', 'quantity', 'description', 'manufacturer', 'model_number', 'order_number', 'schematic_position']) AS field, unnest([device_tag, quantity, description, manufacturer, model_number, order_number, schematic_position]) AS v FROM canon) SELECT source_pdf, field, round(avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END), 6) AS filled FROM u GROUP BY source_pdf, field",
    "search_filter": f"WITH {ROWS} SELECT source_pdf, row_index, description FROM canon WHERE regexp_matches(description, 'see /1[0-9]|green', 'i')",
    "search_literal": f"WITH {ROWS} SELECT source_pdf, row_index, description FROM canon WHERE source_pdf = '3' AND contains(description, '/12.3')",
    "union_docs": f"WITH {ROWS} SELECT CASE WHEN CAST(source_pdf AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS pdf, source_pdf, row_index, device_tag FROM canon",
    "import_sheet": f"WITH {_SHEET} SELECT * FROM sheet",
    "order_sheet": f"""WITH {_SHEET} SELECT source_pdf, row_index + 1 AS pos, aantal AS menge, eenheid AS me, left(omschrijving, 120) AS kunden_bezeichnung, coalesce(klantartikel, fabrikant || type_bestelnummer) AS kunden_artikel, type_bestelnummer AS bstnr,
  fabrikant AS lieferant, 'zie bstnr' AS typ, fabrikant AS hersteller, odc_code AS bmk, opmerking AS bemerkung, 'not used' AS seite_pfad, 0 AS beistellung, 'not used' AS einbau_ort, ean_code AS eannr, CAST(length(type_bestelnummer) AS INTEGER) AS lengte FROM sheet""",
    "csv_rows": f"WITH {ROWS} SELECT source_pdf, CAST(source_page AS VARCHAR) AS source_page, '' AS source_section, CAST(row_index AS VARCHAR) AS row_index, coalesce(device_tag, '') AS device_tag, coalesce(quantity, '') AS quantity, description, manufacturer, model_number, '' AS order_number, coalesce(schematic_position, '') AS schematic_position, extra_fields, raw_json AS raw, replace(warnings, '|', '; ') AS warnings FROM canon",
    "section_names": f"WITH {ROWS} SELECT DISTINCT 'S' || source_page AS source_section FROM canon WHERE source_page % 3 = 0",
    "run_lists": f"""WITH {_PAGES}, s AS (SELECT doc, run_idx, CASE WHEN min(page) = max(page) THEN CAST(min(page) AS VARCHAR) ELSE min(page) || '-' || max(page) END AS span FROM pg GROUP BY doc, run_idx)
SELECT doc, CASE WHEN CAST(doc AS BIGINT) % 5 = 0 THEN '—' ELSE string_agg(span, ', ' ORDER BY run_idx) END AS said FROM s GROUP BY doc""",
    "acceptance": f"""WITH {_ENDS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, exp_start, exp_end ORDER BY shared DESC, got_start, got_end) AS r FROM pairs) WHERE r = 1),
x AS (SELECT d.doc, b.doc IS NOT NULL AS found, abs(d.exp_start - b.got_start) <= 1 AND abs(d.exp_end - b.got_end) <= 1 AS near FROM (SELECT DISTINCT * FROM e) d LEFT JOIN b ON b.doc = d.doc AND b.exp_start = d.exp_start AND b.exp_end = d.exp_end),
m AS (SELECT doc, count(*) AS ranges, count(*) FILTER (WHERE NOT found) AS missed, count(*) FILTER (WHERE found AND NOT near) AS wrong_ends FROM x GROUP BY doc),
gp AS (SELECT DISTINCT doc, unnest(generate_series(got_start, got_end)) AS page FROM g), ep AS (SELECT DISTINCT doc, unnest(generate_series(exp_start, exp_end)) AS page FROM e),
ex AS (SELECT doc, count(*) AS extra FROM (SELECT * FROM gp EXCEPT SELECT * FROM ep) GROUP BY doc),
w AS (SELECT doc, CAST(sum(exp_end - exp_start) AS BIGINT) AS expected_rows FROM e GROUP BY doc),
rw AS (SELECT CAST(o_orderkey // 6 AS VARCHAR) AS doc, CASE WHEN o_custkey % 4 = 0 THEN '   ' WHEN o_custkey % 50 = 1 THEN 'a�' ELSE o_orderpriority END AS s FROM orders),
r AS (SELECT doc, count(*) AS rows, avg(CASE WHEN trim(s) = '' THEN 0.0 ELSE 1.0 END) AS described, count(*) FILTER (WHERE contains(s, '�')) AS lost FROM rw GROUP BY doc),
a AS (SELECT m.*, coalesce(ex.extra, 0) AS extra, w.expected_rows, coalesce(r.rows, 0) AS rows, r.described, coalesce(r.lost, 0) AS lost FROM m JOIN w USING (doc) LEFT JOIN ex USING (doc) LEFT JOIN r USING (doc))
SELECT doc, ranges, missed, wrong_ends, extra, expected_rows, rows, rows >= floor(expected_rows * 0.6) AS enough_rows, round(described, 6) AS described, lost,
  missed = 0 AND wrong_ends = 0 AND extra <= 2 AND rows >= floor(expected_rows * 0.6) AND rows > 0 AND described >= 0.7 AND lost = 0 AS accepted FROM a""",
    "zone_tokens": f"WITH {_WORDS} SELECT DISTINCT doc, page, token FROM w WHERE length(token) BETWEEN 2 AND 15 AND (i * 13 % 100 + 4 > 70 OR (i * 7 % 100 + 5 > 50 AND i * 13 % 100 < 15))",
    "section_labels": f"WITH {_WORDS}, k AS (SELECT DISTINCT doc, page, run_idx, token FROM w WHERE length(token) BETWEEN 2 AND 15){_LABELS} SELECT s.doc, s.run_idx, l.token AS label FROM size_ s LEFT JOIN labels_ l ON l.doc = s.doc AND l.run_idx = s.run_idx",
    "page_sections": f"WITH {_WORDS}, k AS (SELECT DISTINCT doc, page, run_idx, token FROM w WHERE length(token) BETWEEN 2 AND 15 AND (i * 13 % 100 + 4 > 70 OR (i * 7 % 100 + 5 > 50 AND i * 13 % 100 < 15))){_LABELS} SELECT t.doc, t.page, l.token AS source_section FROM t LEFT JOIN labels_ l ON l.doc = t.doc AND l.run_idx = t.run_idx",
    "overlap_join": f"WITH {_ENDS} SELECT * FROM pairs",
    "best_overlap": f"""WITH {_ENDS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, exp_start, exp_end ORDER BY shared DESC, got_start, got_end) AS r FROM pairs) WHERE r = 1)
SELECT d.doc, d.exp_start, d.exp_end, b.got_start, b.got_end, b.shared, b.doc IS NOT NULL AS found, coalesce(abs(d.exp_start - b.got_start) <= 1 AND abs(d.exp_end - b.got_end) <= 1, false) AS ends_right
FROM (SELECT DISTINCT * FROM e) d LEFT JOIN b ON b.doc = d.doc AND b.exp_start = d.exp_start AND b.exp_end = d.exp_end""",
    "extra_pages": f"WITH {_ENDS}, p AS (SELECT DISTINCT doc, unnest(generate_series(got_start, got_end)) AS page FROM g), x AS (SELECT DISTINCT doc, unnest(generate_series(exp_start, exp_end)) AS page FROM e) SELECT doc, count(*) AS extra FROM (SELECT * FROM p EXCEPT SELECT * FROM x) GROUP BY doc",
    "page_ranges": "SELECT * FROM (VALUES " + values([("33-35,47-51", 0, i, 33 + i) for i in range(3)] + [("33-35,47-51", 1, i, 47 + i) for i in range(5)] + [("33-35, 47", 0, i, 33 + i) for i in range(3)] + [("33-35, 47", 1, 0, 47), (" 7 , 9 - 11 ", 0, 0, 7)] + [(" 7 , 9 - 11 ", 1, i, 9 + i) for i in range(3)] + [("5", 0, 0, 5), ("2-2,2", 0, 0, 2), ("2-2,2", 1, 0, 2)]) + ") v(doc, run_idx, pos, page)",
    "page_spans": f"WITH {_PAGES} SELECT doc, run_idx, CASE WHEN min(page) = max(page) THEN CAST(min(page) AS VARCHAR) ELSE min(page) || '-' || max(page) END AS span FROM pg GROUP BY doc, run_idx",
}
