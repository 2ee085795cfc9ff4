"""The same queries as plain SQL over the given tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- shared parts ----------------------------------------------------------------------------

RAW = """raw AS (
  SELECT vec_id, q::INTEGER AS query_idx,
    'out/Doc, ' || (vec_id // 10) || '_page_' || (vec_id % 10 + 1) || '.png' AS file_path,
    'Doc, ' || (vec_id // 10) AS doc, (vec_id % 10 + 1)::INTEGER AS page_num,
    embedding[7*q+1]::DOUBLE * 10 AS l0, embedding[7*q+2]::DOUBLE * 10 AS l1,
    embedding[7*q+3]::DOUBLE * 10 + CASE WHEN vec_id % 7 = 3 THEN 100.0 ELSE 0.0 END::DOUBLE AS l2,
    embedding[7*q+4]::DOUBLE + 0.5 AS cx, embedding[7*q+5]::DOUBLE + 0.5 AS cy,
    abs(embedding[7*q+6]::DOUBLE) AS w, abs(embedding[7*q+7]::DOUBLE) + CASE WHEN q = 8 THEN abs(embedding[64]::DOUBLE) ELSE 0.0::DOUBLE END AS h
  FROM embeddings CROSS JOIN (SELECT unnest(range(0, 9)) AS q))"""
CLASSED = """topped AS (SELECT *, greatest(l0, l1, l2) AS m FROM raw),
classed AS (
  SELECT *, (CASE WHEN l0 = m THEN 0 WHEN l1 = m THEN 1 ELSE 2 END)::INTEGER AS class_id,
    1.0::DOUBLE / (exp(l0 - m) + exp(l1 - m) + exp(l2 - m)) AS score,
    cx - w * 0.5::DOUBLE AS rx0, cy - h * 0.5::DOUBLE AS ry0, cx + w * 0.5::DOUBLE AS rx1, cy + h * 0.5::DOUBLE AS ry1
  FROM topped),
named AS (
  SELECT *, CASE class_id WHEN 0 THEN 'table' WHEN 1 THEN 'table rotated' ELSE 'no object' END AS label,
    rx0 * 1700 AS x0, ry0 * 2600 AS y0, rx1 * 1700 AS x1, ry1 * 2600 AS y1
  FROM classed)"""
KEPT = """kept AS (
  SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY query_idx) - 1)::INTEGER AS table_idx
  FROM named WHERE label <> 'no object')"""
IMAGES = "images AS (SELECT DISTINCT vec_id, file_path, doc, page_num FROM raw)"
BOX4 = "round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1"

DOCPAGES = """docpages AS (
  SELECT doc_id, 'Doc, ' || doc_id AS doc, greatest(1, ceil(n_chars / 2000.0))::INTEGER AS n_pages,
    (600 + doc_id % 2000)::INTEGER AS width, (800 + doc_id % 1700)::INTEGER AS height
  FROM documents)"""
PAGEROWS = """pagerows AS (
  SELECT *, 'out/' || doc || '_page_' || page_num || '.png' AS image_path
  FROM (SELECT *, unnest(range(1, n_pages + 1))::INTEGER AS page_num FROM docpages))"""

CAT = "cat AS (SELECT doc_id AS publication_id, 'https://pubs.example.org/publication/' || doc_id AS url FROM documents)"
OBT = "obt AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE '' END || doc_id || '.pdf' AS file_name FROM labels)"
OBTIDS = "obtids AS (SELECT file_name, substr(file_name, 1, length(file_name) - 4)::BIGINT AS publication_id FROM obt WHERE file_name NOT LIKE 'x%')"
FILES = """files AS (
  SELECT CASE doc_id % 4 WHEN 0 THEN 'sample_' WHEN 1 THEN 'Sample ' ELSE '' END || doc_id
      || CASE WHEN doc_id % 4 = 3 THEN '.png' ELSE '.pdf' END AS file_name,
    'in/' || lang AS folder, CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM documents)"""

HREFS = """lists AS (SELECT page_id, url, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
links AS (
  SELECT page_id, url, unnest(hrefs) AS href, (generate_subscripts(hrefs, 1) - 1)::INTEGER AS link_pos,
    regexp_extract(url, '^[a-z]+://[^/?#]*') AS root
  FROM lists),
resolved AS (SELECT page_id AS publication_id, link_pos, root || href AS link_url, substr(href, 2) AS path FROM links)"""

PX = """px AS (
  SELECT vec_id, (k - 1)::INTEGER AS i, least(greatest(floor((embedding[k]::DOUBLE + 0.5) * 255), 0), 255)::INTEGER AS g
  FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS k))"""
# Three channels of an 8 x 8 image, in stored order: the 64 values three times over.
RGB = """rgb AS (
  SELECT o.vec_id, o.i, a.g AS c0, b.g AS c1, c.g AS c2
  FROM px o JOIN px a ON o.vec_id = a.vec_id AND a.i = 3 * o.i % 64 JOIN px b ON o.vec_id = b.vec_id AND b.i = (3 * o.i + 1) % 64
    JOIN px c ON o.vec_id = c.vec_id AND c.i = (3 * o.i + 2) % 64)"""


def _hex(source: str, height: int, width: int, channels: int, value: str = "g", order: str = "i") -> str:
    return f"""SELECT vec_id, {height}::INTEGER AS height, {width}::INTEGER AS width, {channels}::INTEGER AS "nChannels",
  string_agg(printf('%02X', {value}::INTEGER), '' ORDER BY {order}) AS pixels
FROM {source} GROUP BY vec_id"""


def _otsu(source: str, n: int) -> str:
    """Best level per image of ``source(vec_id, i, g)`` with n pixels."""
    return f"""sums AS (
  SELECT vec_id, t, count(*) FILTER (g <= t) AS n0, coalesce(sum(g) FILTER (g <= t), 0) AS s0, sum(g) AS s
  FROM {source} CROSS JOIN (SELECT unnest(range(0, 256)) AS t) GROUP BY vec_id, t),
best AS (
  SELECT vec_id, t, row_number() OVER (
    PARTITION BY vec_id ORDER BY power((s * n0 - s0 * {n})::DOUBLE, 2) / (n0 * ({n} - n0)) DESC, t) AS r
  FROM sums WHERE n0 BETWEEN 1 AND {n - 1}),
levels AS (
  SELECT i.vec_id, coalesce(b.t, 0)::INTEGER AS level
  FROM (SELECT DISTINCT vec_id FROM {source}) i LEFT JOIN best b ON b.vec_id = i.vec_id AND b.r = 1)"""


def _weights(name: str, n_in: int, n_out: int) -> str:
    """Cubic resampling weights (o, p, k) in 1/4194304 units."""
    ratio = f"({float(n_in)}::DOUBLE / {float(n_out)}::DOUBLE)"
    return f"""{name}_c AS (
  SELECT o, p, (o + 0.5::DOUBLE) * {ratio} AS center, greatest({ratio}, 1.0::DOUBLE) AS spread
  FROM (SELECT unnest(range(0, {n_out})) AS o) CROSS JOIN (SELECT unnest(range(0, {n_in})) AS p)),
{name}_x AS (
  SELECT o, p, abs((p - center + 0.5::DOUBLE) / spread) AS x FROM {name}_c
  WHERE p >= greatest(trunc(center - 2 * spread + 0.5::DOUBLE), 0) AND p < least(trunc(center + 2 * spread + 0.5::DOUBLE), {n_in})),
{name}_k AS (
  SELECT o, p, CASE WHEN x < 1 THEN (1.5::DOUBLE * x - 2.5::DOUBLE) * x * x + 1
    WHEN x < 2 THEN (((x - 5) * x + 8) * x - 4) * (-0.5::DOUBLE) ELSE 0 END AS k FROM {name}_x),
{name}_s AS (SELECT o, p, k / sum(k) OVER (PARTITION BY o) * 4194304 AS k FROM {name}_k),
{name} AS (SELECT o, p, trunc(k + CASE WHEN k < 0 THEN -0.5 ELSE 0.5 END) AS k FROM {name}_s)"""


def _resize(source: str, w: int, h: int, new_w: int, new_h: int) -> str:
    """``resized(vec_id, ch, x, y, g)`` from ``source(vec_id, ch, x, y, g)``."""
    clip = "least(greatest(floor((sum(g * k) + 2097152) / 4194304.0::DOUBLE), 0), 255)"
    return f"""{_weights("wx", w, new_w)},
{_weights("wy", h, new_h)},
across AS (SELECT vec_id, ch, y, wx.o AS x, {clip} AS g FROM {source} JOIN wx ON wx.p = {source}.x GROUP BY vec_id, ch, y, wx.o),
resized AS (SELECT vec_id, ch, x, wy.o AS y, {clip} AS g FROM across JOIN wy ON wy.p = across.y GROUP BY vec_id, ch, x, wy.o)"""


def _normal(value: str, mean: str, std: str) -> str:
    return f"round((({value}::FLOAT / 255::FLOAT - {mean}::FLOAT) / {std}::FLOAT)::DOUBLE, 4)"


# ---- sources ---------------------------------------------------------------------------------

ORACLE["catalog_scan"] = _with(CAT) + "SELECT publication_id, url FROM cat WHERE publication_id % 97 <> 0"
ORACLE["catalog_rejects"] = _with(CAT) + "SELECT 'n/a ' || publication_id AS id_text, url FROM cat WHERE publication_id % 97 = 0"
ORACLE["suffix_filter"] = _with(FILES) + "SELECT file_name FROM files WHERE file_name LIKE '%.pdf'"
ORACLE["name_exclude"] = _with(FILES) + "SELECT file_name FROM files WHERE file_name LIKE '%.pdf' AND file_name NOT ILIKE '%sample%'"
ORACLE["page_scan"] = "SELECT url, html FROM pages WHERE html IS NOT NULL"
ORACLE["missing_ids_scan"] = "SELECT unnest([doc_id, doc_id + 1, doc_id + 2]) AS publication_id FROM labels"

# ---- links and downloads ---------------------------------------------------------------------

ORACLE["extract_links"] = _with(HREFS) + "SELECT page_id, link_pos, href FROM links"
ORACLE["extract_links_by_class"] = _with(HREFS) + """SELECT page_id,
  (row_number() OVER (PARTITION BY page_id ORDER BY link_pos) - 1)::INTEGER AS link_pos, href
FROM links WHERE regexp_matches(href, '^/[A-Z]')"""
ORACLE["resolve_links"] = _with(HREFS) + """SELECT page_id, link_pos,
  CASE link_pos % 7 WHEN 0 THEN href WHEN 1 THEN substr(href, 2) WHEN 2 THEN '//cdn.example.org/' || substr(href, 2)
    WHEN 3 THEN '#' || substr(href, 2) WHEN 4 THEN '?q=' || substr(href, 2) WHEN 5 THEN 'a/../b/./' || substr(href, 2)
    ELSE 'mailto:' || substr(href, 2) END AS href,
  CASE link_pos % 7 WHEN 0 THEN root || href WHEN 1 THEN root || href
    WHEN 2 THEN split_part(url, ':', 1) || '://cdn.example.org' || href
    WHEN 3 THEN root || '/#' || substr(href, 2) WHEN 4 THEN root || '/?q=' || substr(href, 2)
    WHEN 5 THEN root || '/b' || href ELSE 'mailto:' || substr(href, 2) END AS link_url
FROM links"""
ORACLE["catalog_links"] = _with(HREFS) + "SELECT publication_id, link_pos, link_url FROM resolved"
ORACLE["catalog_links_copies"] = ORACLE["catalog_links"]
ORACLE["catalog_links_some"] = _with(HREFS) + """SELECT publication_id, link_pos, link_url FROM resolved WHERE publication_id % 10 = 3
UNION ALL SELECT -publication_id, link_pos, link_url FROM resolved WHERE publication_id % 20 = 3"""
REPEATED = """repeated AS (
  SELECT publication_id, publication_id * 4 AS catalog_pos, link_pos, link_url FROM resolved
  UNION ALL SELECT publication_id, publication_id * 4 + 1, link_pos, link_url FROM resolved WHERE publication_id % 5 = 0
  UNION ALL SELECT publication_id + 1, publication_id * 4 + 2, link_pos, link_url FROM resolved WHERE publication_id % 3 = 0)"""
ORACLE["download_plan_by_id"] = _with(HREFS, REPEATED) + """SELECT publication_id, arg_max(link_pos, catalog_pos * 100000 + link_pos) AS link_pos,
  arg_max(link_url, catalog_pos * 100000 + link_pos) AS link_url, publication_id || '.pdf' AS file_path, count(*) AS n_links
FROM repeated GROUP BY publication_id"""
ORACLE["overwritten_links"] = _with(HREFS, REPEATED) + """SELECT publication_id, catalog_pos, link_pos, link_url
FROM (SELECT *, catalog_pos * 100000 + link_pos AS place, max(catalog_pos * 100000 + link_pos) OVER (PARTITION BY publication_id) AS last FROM repeated)
WHERE place < last"""
ORACLE["seed_plan_by_path"] = _with(HREFS) + """SELECT path AS file_path,
  arg_max(link_url, link_pos - publication_id * 100000) AS link_url, count(*) AS n_links
FROM resolved GROUP BY path"""
ORACLE["fetch_fallback"] = _with(HREFS).rstrip() + """, marked AS (
  SELECT publication_id, link_pos, link_pos >= count(*) OVER (PARTITION BY publication_id) - publication_id % 7 AS dead,
    row_number() OVER (PARTITION BY publication_id ORDER BY link_pos DESC)::INTEGER AS attempt, link_url FROM resolved),
tried AS (SELECT *, min(attempt) FILTER (NOT dead) OVER (PARTITION BY publication_id) AS got FROM marked)
SELECT publication_id, attempt, link_pos, link_url || CASE WHEN dead THEN '?dead' ELSE '' END AS link_url,
  publication_id || '.pdf' AS file_path, CASE WHEN NOT dead THEN strlen(link_url) END AS n_bytes,
  CASE WHEN dead THEN 'error' ELSE 'ok' END AS status, CASE WHEN dead THEN 'OSError: 404' END AS reason
FROM tried WHERE attempt <= coalesce(got, attempt)"""
ORACLE["download_plan_by_path"] = _with(HREFS) + """SELECT path AS file_path,
  arg_max(link_url, publication_id * 100000 + link_pos) AS link_url, count(*) AS n_links
FROM resolved GROUP BY path"""
ORACLE["fetch_documents"] = _with(HREFS) + """SELECT publication_id AS page_id, link_pos, link_url,
  CASE WHEN link_url LIKE '%e' THEN NULL ELSE strlen(link_url) END AS n_bytes,
  CASE WHEN link_url LIKE '%e' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN link_url LIKE '%e' THEN 'OSError: 404' END AS reason
FROM resolved"""
ORACLE["expected_files"] = _with(CAT, OBT) + """SELECT publication_id, 'raw_pdf/' || publication_id || '.pdf' AS pdf_path,
  publication_id || '.pdf' IN (SELECT file_name FROM obt) AS present
FROM cat"""

# ---- reconciliation --------------------------------------------------------------------------

ORACLE["obtained_ids"] = _with(OBT, OBTIDS) + "SELECT file_name, publication_id FROM obtids"
ORACLE["obtained_rejects"] = _with(OBT) + "SELECT file_name FROM obt WHERE file_name LIKE 'x%'"
ORACLE["reconcile_found"] = _with(CAT, OBT, OBTIDS) + "SELECT * FROM cat WHERE publication_id IN (SELECT publication_id FROM obtids)"
ORACLE["reconcile_missing"] = _with(CAT, OBT, OBTIDS) + "SELECT * FROM cat WHERE publication_id NOT IN (SELECT publication_id FROM obtids)"
ORACLE["reconcile_ratio"] = _with(CAT, OBT, OBTIDS) + """SELECT n_catalog, n_found, n_files,
  round(n_files / n_catalog::DOUBLE, 6) AS file_ratio, round(n_found / n_catalog::DOUBLE, 6) AS coverage
FROM (SELECT count(*) AS n_catalog, count(*) FILTER (publication_id IN (SELECT publication_id FROM obtids)) AS n_found,
  (SELECT count(*) FROM obtids) AS n_files FROM cat)"""
ORACLE["file_count"] = _with(FILES) + "SELECT folder, count(*) AS n_files FROM files GROUP BY folder"
ORACLE["missing_json"] = _with(CAT, OBT, OBTIDS) + """SELECT '{"publication_id":' || publication_id || '}' AS value
FROM cat WHERE publication_id NOT IN (SELECT publication_id FROM obtids)"""

# ---- pages -----------------------------------------------------------------------------------

ORACLE["page_counts"] = _with(DOCPAGES) + "SELECT doc, n_pages::BIGINT AS n_pages FROM docpages"
ORACLE["document_page_counts"] = """SELECT doc_id,
  CASE WHEN text LIKE 'A%' THEN NULL ELSE greatest(1, ceil(length(text) / 2000.0))::INTEGER END AS n_pages,
  CASE WHEN text LIKE 'A%' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN text LIKE 'A%' THEN 'ValueError: no page tree' END AS reason
FROM documents"""
ORACLE["page_range"] = _with(DOCPAGES) + """SELECT mode, doc_id, unnest(range(lo, least(hi, n_pages) + 1))::INTEGER AS page_num
FROM docpages CROSS JOIN (VALUES ('both', 2, 4), ('start', 3, 1000000), ('end', 1, 2), ('all', 1, 1000000)) AS m(mode, lo, hi)"""
ORACLE["page_batches"] = _with(DOCPAGES) + """SELECT doc_id, first_page, least(first_page + 9, n_pages)::INTEGER AS last_page
FROM (SELECT doc_id, n_pages, unnest(range(1, n_pages + 1, 10))::INTEGER AS first_page FROM docpages)"""
ORACLE["batch_flatten"] = _with(DOCPAGES, PAGEROWS) + "SELECT doc_id, doc || '_page_' || page_num || '.png' AS image_path FROM pagerows"
ORACLE["page_path_build"] = _with(DOCPAGES, PAGEROWS) + "SELECT doc_id, page_num, 'out/' || doc || '.x_page_' || page_num || '.png' AS image_path FROM pagerows"
ORACLE["page_path_parse"] = _with(DOCPAGES, PAGEROWS) + "SELECT image_path, substr(image_path, 5) AS file_name, doc, page_num FROM pagerows"
ORACLE["drop_empty_pages"] = _with(DOCPAGES, PAGEROWS) + "SELECT doc_id, page_num, image_path FROM pagerows WHERE (doc_id + page_num) % 7 <> 0"
ORACLE["pending_pages"] = _with(DOCPAGES, PAGEROWS) + "SELECT doc_id, page_num, '/' || image_path AS image_path FROM pagerows WHERE (doc_id + page_num) % 3 <> 0"
ORACLE["page_preview"] = _with(DOCPAGES, PAGEROWS) + """SELECT doc_id, page_num, trunc(width * 0.25)::INTEGER AS preview_w, trunc(height * 0.25)::INTEGER AS preview_h
FROM pagerows WHERE page_num = 2"""
ORACLE["quarantine"] = _with(FILES) + "SELECT file_name, status FROM files WHERE status = 'error'"
ORACLE["render_pages"] = """SELECT 'out/' || doc_id || '_page_' || page_num || '.png' AS image_path, page_num,
  strlen(page)::INTEGER AS n_bytes, md5(page) AS image_md5, 'ok' AS status
FROM (
  SELECT doc_id, page_num, substr(text, 2000 * (page_num - 1) + 1, 2000) AS page
  FROM (SELECT doc_id, text, unnest(range(1, greatest(1, ceil(n_chars / 2000.0))::BIGINT + 1))::INTEGER AS page_num FROM documents))
WHERE page <> ''"""

ORACLE["render_batches"] = _with(DOCPAGES, PAGEROWS) + """SELECT doc AS doc_path, page_num,
  CASE WHEN page_num % 7 <> 0 THEN md5(doc || ':' || page_num) END AS image_md5,
  CASE WHEN page_num % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN page_num % 7 = 0 THEN 'ValueError: broken page' END AS reason
FROM pagerows"""

# ---- images ----------------------------------------------------------------------------------

ORACLE["img_gray"] = _with(PX, RGB) + _hex("rgb", 8, 8, 1, "((c0 * 19595 + c1 * 38470 + c2 * 7471 + 32768) // 65536)")
ORACLE["img_bgr_to_rgb"] = _with(PX, RGB) + _hex("rgb", 8, 8, 3).replace("printf('%02X', g::INTEGER)", "printf('%02X%02X%02X', c2, c1, c0)")
ORACLE["img_otsu_level"] = _with(PX, _otsu("px", 64)) + "SELECT vec_id, level FROM levels"
ORACLE["img_binarize"] = _with(
    PX, _otsu("px", 64), "bin AS (SELECT vec_id, i, CASE WHEN g > level THEN 255 ELSE 0 END AS g FROM px JOIN levels USING (vec_id))"
) + _hex("bin", 8, 8, 1)
ORACLE["img_three_channel"] = _with(PX) + _hex("px", 8, 8, 3).replace("printf('%02X', g::INTEGER)", "repeat(printf('%02X', g), 3)")
ORACLE["img_dilate"] = _with(
    PX,
    """wide AS (
  SELECT a.vec_id, a.i, max(b.g) AS g FROM px a JOIN px b
    ON a.vec_id = b.vec_id AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1
  GROUP BY a.vec_id, a.i)""",
) + _hex("wide", 8, 8, 1)
ORACLE["img_resize_dims"] = _with(DOCPAGES) + """SELECT doc_id,
  round_even(800.0::DOUBLE / greatest(width, height) * width, 0)::INTEGER AS new_w,
  round_even(800.0::DOUBLE / greatest(width, height) * height, 0)::INTEGER AS new_h
FROM docpages"""
ORACLE["img_resize_pixels"] = _with(
    PX, "src AS (SELECT vec_id, 0 AS ch, i % 8 AS x, i // 8 AS y, g FROM px)", _resize("src", 8, 8, 12, 12)
) + _hex("resized", 12, 12, 1, "g", "y, x")
_COLOR = """src AS (
  SELECT vec_id, ch, i % 8 AS x, i // 8 AS y, CASE ch WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS g
  FROM rgb CROSS JOIN (SELECT unnest(range(0, 3)) AS ch))"""
ORACLE["img_resize_down"] = _with(PX, RGB, _COLOR, _resize("src", 8, 8, 5, 5)) + _hex("resized", 5, 5, 3, "g", "y, x, ch")
ORACLE["img_normalize"] = _with(PX) + f"""SELECT vec_id, (c * 64 + i)::INTEGER AS i, {_normal("g", "0.485", "0.229")} AS v
FROM px CROSS JOIN (SELECT unnest(range(0, 3)) AS c)"""
ORACLE["img_profile_binarized"] = _with(
    PX,
    RGB,
    # Stored order is BGR here.
    "gray AS (SELECT vec_id, i, (c2 * 19595 + c1 * 38470 + c0 * 7471 + 32768) // 65536 AS g FROM rgb)",
    _otsu("gray", 64),
    "src AS (SELECT vec_id, 0 AS ch, i % 8 AS x, i // 8 AS y, CASE WHEN g > level THEN 255 ELSE 0 END AS g FROM gray JOIN levels USING (vec_id))",
    _resize("src", 8, 8, 14, 14),
) + f"""SELECT vec_id, (c * 196 + y * 14 + x)::INTEGER AS i, {_normal("g", "0.485", "0.229")} AS v
FROM resized CROSS JOIN (SELECT unnest(range(0, 3)) AS c)"""
ORACLE["img_profile_plain"] = _with(
    PX, RGB, _COLOR, _resize("src", 8, 8, 14, 14), "stats(ch, mean, std) AS (VALUES (2, 0.485, 0.229), (1, 0.456, 0.224), (0, 0.406, 0.225))"
) + f"""SELECT vec_id, ((2 - ch) * 196 + y * 14 + x)::INTEGER AS i, {_normal("g", "mean", "std")} AS v
FROM resized JOIN stats USING (ch)"""

ORACLE["img_chain"] = _with(
    PX,
    RGB,
    "gray AS (SELECT vec_id, i, (c2 * 19595 + c1 * 38470 + c0 * 7471 + 32768) // 65536 AS g FROM rgb)",
    _otsu("gray", 64),
    "bin AS (SELECT vec_id, i, CASE WHEN g > level THEN 'FFFFFF' ELSE '000000' END AS g FROM gray JOIN levels USING (vec_id))",
) + _hex("bin", 8, 8, 3).replace("printf('%02X', g::INTEGER)", "g")

# ---- detection -------------------------------------------------------------------------------

ORACLE["run_model"] = _with(
    PX,
    _otsu("px", 64),
    """means AS (
  SELECT vec_id, avg(((CASE WHEN g > level THEN 255 ELSE 0 END)::FLOAT / 255::FLOAT - 0.485::FLOAT)::FLOAT / 0.229::FLOAT) AS v
  FROM px JOIN levels USING (vec_id) GROUP BY vec_id)""",
    """raw AS (
  SELECT vec_id, 0 AS query_idx, v AS l0, 1 - v AS l1, v * 0.5 AS l2, 3.2 AS x0, 2.4 AS y0, 4.8 AS x1, 5.6 AS y1 FROM means
  UNION ALL SELECT vec_id, 1, -v, v, 0, 0.0, 0.0, 4.0, 8.0 FROM means)""",
    "topped AS (SELECT *, greatest(l0, l1, l2) AS m FROM raw)",
) + """SELECT vec_id, query_idx, CASE WHEN l0 = m THEN 'table' ELSE 'table rotated' END AS label,
  round(1.0 / (exp(l0 - m) + exp(l1 - m) + exp(l2 - m)), 6) AS score,
  x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1
FROM topped WHERE l0 = m OR l1 = m"""
ORACLE["run_model_faults"] = _with(
    PX,
    _otsu("px", 64),
    """means AS (
  SELECT vec_id, avg(((CASE WHEN g > level THEN 255 ELSE 0 END)::FLOAT / 255::FLOAT - 0.485::FLOAT)::FLOAT / 0.229::FLOAT) AS v
  FROM px JOIN levels USING (vec_id) GROUP BY vec_id)""",
    """counts AS (
  SELECT vec_id, ((v >= v * 0.5 OR 1 - v >= v * 0.5)::INTEGER + (-v >= 0 OR v >= 0)::INTEGER)::INTEGER AS n FROM means)""",
) + """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE 8 END::INTEGER AS img_w,
  CASE WHEN vec_id % 11 = 0 THEN -1 WHEN vec_id % 7 = 0 THEN 7 ELSE 8 END::INTEGER AS img_h,
  CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN vec_id % 11 = 0 THEN 'ValueError: no image' WHEN vec_id % 7 = 0 THEN 'ValueError: cut page' END AS reason,
  CASE WHEN vec_id % 11 <> 0 AND vec_id % 7 <> 0 THEN n END AS n_detections
FROM counts"""
ORACLE["zip_outputs"] = _with(RAW) + """SELECT vec_id, query_idx, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2,
  round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM raw"""
ORACLE["softmax"] = _with(RAW, CLASSED) + """SELECT vec_id, query_idx, round(exp(l0 - m) * score, 6) AS p0,
  round(exp(l1 - m) * score, 6) AS p1, round(exp(l2 - m) * score, 6) AS p2 FROM named"""
ORACLE["best_class"] = _with(RAW, CLASSED) + "SELECT vec_id, query_idx, class_id, round(score, 6) AS score FROM named"
ORACLE["label_lookup"] = _with(RAW, CLASSED) + "SELECT vec_id, query_idx, class_id, label FROM named"
ORACLE["box_to_corners"] = _with(RAW, CLASSED) + """SELECT vec_id, query_idx, round(rx0, 6) AS x0, round(ry0, 6) AS y0,
  round(rx1, 6) AS x1, round(ry1, 6) AS y1 FROM named"""
ORACLE["box_rescale"] = _with(RAW, CLASSED) + f"SELECT vec_id, query_idx, {BOX4} FROM named"
ORACLE["drop_no_object"] = _with(RAW, CLASSED, KEPT) + "SELECT vec_id, query_idx, label FROM kept"
ORACLE["detect_objects"] = _with(RAW, CLASSED, KEPT) + f"SELECT file_path, query_idx, label, round(score, 6) AS score, {BOX4} FROM kept"
ORACLE["score_threshold"] = _with(RAW, CLASSED, KEPT) + "SELECT vec_id, query_idx, label, round(score, 6) AS score FROM kept WHERE score > 0.8"
ORACLE["page_results"] = _with(RAW, CLASSED, KEPT, IMAGES) + """SELECT i.file_path, count(h.vec_id)::INTEGER AS n_detections,
  coalesce(string_agg(label || ':' || floor(score * 1000)::BIGINT || ':' || floor(x0)::BIGINT || ':' || floor(y0)::BIGINT, ';'
    ORDER BY query_idx) FILTER (h.vec_id IS NOT NULL), '') AS detections
FROM images i LEFT JOIN kept h ON h.vec_id = i.vec_id GROUP BY i.file_path"""
ORACLE["flatten_detections"] = _with(RAW, CLASSED, KEPT) + f"SELECT file_path, table_idx, label, round(score, 6) AS score, {BOX4} FROM kept"
ORACLE["doc_table_counts"] = _with(RAW, CLASSED, KEPT, IMAGES) + """SELECT i.doc, count(DISTINCT i.vec_id) AS n_pages, count(h.vec_id) AS table_count
FROM images i LEFT JOIN kept h ON h.vec_id = i.vec_id GROUP BY i.doc"""

# ---- results ---------------------------------------------------------------------------------

ORACLE["parse_detections"] = _with(RAW, CLASSED, KEPT) + """SELECT file_path, table_idx, label,
  round(floor(score * 1000) / 1000, 6) AS score, floor(x0) AS x0, floor(y0) AS y0, floor(x1) AS x1, floor(y1) AS y1
FROM kept"""
ORACLE["results_export"] = _with(RAW, CLASSED, KEPT, IMAGES) + """SELECT i.file_path,
  '[' || coalesce(string_agg('{"label":"' || label || '","score":' || floor(score * 1000) / 1000 || ',"bbox":['
    || floor(x0) || ',' || floor(y0) || ',' || floor(x1) || ',' || floor(y1) || ']}', ',' ORDER BY query_idx)
    FILTER (h.vec_id IS NOT NULL), '') || ']' AS score
FROM images i LEFT JOIN kept h ON h.vec_id = i.vec_id GROUP BY i.file_path"""
_COUNTED = """counted AS (
  SELECT i.vec_id AS row_idx, i.file_path, count(h.vec_id)::INTEGER AS n_detections
  FROM images i LEFT JOIN kept h ON h.vec_id = i.vec_id GROUP BY i.vec_id, i.file_path)"""
ORACLE["lookup_by_path"] = _with(RAW, CLASSED, KEPT, IMAGES, _COUNTED) + "SELECT * FROM counted WHERE file_path = 'out/Doc, 3_page_5.png'"
ORACLE["lookup_by_index"] = _with(RAW, CLASSED, KEPT, IMAGES, _COUNTED) + "SELECT * FROM counted WHERE row_idx = 85"
ORACLE["results_join_pages"] = _with(RAW, CLASSED, KEPT, IMAGES, _COUNTED, DOCPAGES, PAGEROWS) + """SELECT file_path, row_idx, n_detections, width, height
FROM counted LEFT JOIN pagerows ON file_path = image_path"""
ORACLE["overlay_rects"] = _with(
    RAW,
    CLASSED,
    KEPT,
    """styles(label, layer, layer_no, color, line_width, hatch, alpha) AS (VALUES
  ('table', 'fill', 1, '1,0,0.45', 2, NULL, 0.1), ('table', 'edge', 2, '1,0,0.45', 2, NULL, 0.3),
  ('table', 'hatch', 3, '1,0,0.45', 0, '//////', 0.2), ('table rotated', 'fill', 1, '0.95,0.6,0.1', 2, NULL, 0.1),
  ('table rotated', 'edge', 2, '0.95,0.6,0.1', 2, NULL, 0.3), ('table rotated', 'hatch', 3, '0.95,0.6,0.1', 0, '//////', 0.2))""",
) + """SELECT file_path, table_idx, label, layer, layer_no, color, line_width, hatch, alpha::DOUBLE AS alpha,
  round(x0, 4) AS x, round(y0, 4) AS y, round(x1 - x0, 4) AS w, round(y1 - y0, 4) AS h
FROM kept JOIN styles USING (label)"""
ORACLE["annotated_pages"] = _with(RAW, CLASSED, KEPT) + "SELECT DISTINCT file_path FROM kept"
ORACLE["annotated_paths"] = _with(DOCPAGES, PAGEROWS) + "SELECT image_path AS file_path, 'tables/' || substr(image_path, 5) AS out_path FROM pagerows"
_CROP_PATH = "'crops/' || doc || '.pdf_page_' || page_num || '_table_' || table_idx || '.png' AS image_path"
ORACLE["crop_spec"] = _with(RAW, CLASSED, KEPT) + f"""SELECT page_num, table_idx, label,
  least(greatest(floor(x0), 0), 1700)::INTEGER AS left, least(greatest(floor(y0), 0), 2600)::INTEGER AS top,
  least(greatest(ceil(x1), 0), 1700)::INTEGER AS right, least(greatest(ceil(y1), 0), 2600)::INTEGER AS bottom, {_CROP_PATH}
FROM kept""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')
ORACLE["crop_spec_nearest"] = _with(RAW, CLASSED, KEPT) + f"""SELECT page_num, table_idx, label,
  round_even(x0, 0)::INTEGER AS "left", round_even(y0, 0)::INTEGER AS top,
  round_even(x1, 0)::INTEGER AS "right", round_even(y1, 0)::INTEGER AS bottom, {_CROP_PATH}
FROM kept"""
ORACLE["page_crops"] = _with(
    RAW,
    CLASSED,
    KEPT,
    PX,
    """rects AS (
  SELECT vec_id, table_idx, label, least(greatest(floor(rx0 * 8), 0), 8)::INTEGER AS l, least(greatest(floor(ry0 * 8), 0), 8)::INTEGER AS t,
    least(greatest(ceil(rx1 * 8), 0), 8)::INTEGER AS r, least(greatest(ceil(ry1 * 8), 0), 8)::INTEGER AS b FROM kept)""",
    """cut AS (
  SELECT c.vec_id, c.table_idx, string_agg(printf('%02X', p.g), '' ORDER BY p.i) AS pixels
  FROM rects c JOIN px p ON p.vec_id = c.vec_id AND p.i % 8 >= l AND p.i % 8 < r AND p.i // 8 >= t AND p.i // 8 < b
  GROUP BY c.vec_id, c.table_idx)""",
) + """SELECT vec_id, table_idx, label, l AS "left", t AS top, r AS "right", b AS bottom, greatest(b - t, 0)::INTEGER AS height,
  greatest(r - l, 0)::INTEGER AS width, coalesce(pixels, '') AS pixels, 'crops/' || vec_id || '.pdf_page_1_table_' || table_idx || '.png' AS image_path
FROM rects LEFT JOIN cut USING (vec_id, table_idx)"""
ORACLE["lateral_crops"] = ORACLE["page_crops"]
ORACLE["crop_pixels"] = _with(
    PX,
    """cells AS (
  SELECT e.vec_id, o AS i, e.vec_id % 11 - 2 + o % 4 AS x, e.vec_id % 7 - 1 + o // 4 AS y
  FROM embeddings e CROSS JOIN (SELECT unnest(range(0, 20)) AS o))""",
    """cut AS (
  SELECT c.vec_id, c.i, coalesce(p.g, 0) AS g FROM cells c LEFT JOIN px p
    ON p.vec_id = c.vec_id AND c.x BETWEEN 0 AND 7 AND c.y BETWEEN 0 AND 7 AND p.i = c.y * 8 + c.x)""",
) + _hex("cut", 5, 4, 1)

# ---- tables ----------------------------------------------------------------------------------

ORACLE["documents_table"] = _with(RAW, CLASSED, KEPT, IMAGES) + """SELECT i.doc || '.pdf' AS filename, count(DISTINCT i.vec_id) AS n_pages, count(h.vec_id) AS table_count
FROM images i LEFT JOIN kept h ON h.vec_id = i.vec_id GROUP BY i.doc"""
ORACLE["tables_table"] = _with(RAW, CLASSED, KEPT) + f"SELECT doc || '.pdf' AS filename, page_num, table_idx, {BOX4}, {_CROP_PATH} FROM kept"

# ---- written and read back -------------------------------------------------------------------

GROUPS = """counted AS (SELECT vec_id // 50 AS g, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1),
groups AS (
  SELECT 'n' || g % 25 || '/' || g % 10 || '/Group, ' || g || CASE WHEN g % 3 = 0 THEN '.txt' ELSE '.pdf' END AS name,
    CASE WHEN g % 4 <> 0 THEN ids ELSE '' END AS content FROM counted)"""
ORACLE["catalog_file"] = ORACLE["catalog_scan"]
ORACLE["stored_files"] = _with(GROUPS) + """SELECT name, strlen(content) AS n_bytes, 'written' AS status,
  CASE WHEN content <> '' THEN md5(content) END AS content_md5 FROM groups"""
ORACLE["tree_listing"] = _with(GROUPS) + """SELECT name, split_part(name, '/', 3) AS file_name, strlen(content) AS n_bytes
FROM groups WHERE name LIKE '%.pdf'"""
# The file has the lower row first.
ORACLE["image_scan"] = _with(GROUPS) + """SELECT 'Doc, ' || g // 10 || '_page_' || (g % 10 + 1) || '.bmp' AS name,
  CASE WHEN g % 9 = 0 THEN -1 ELSE 2 END::INTEGER AS height, CASE WHEN g % 9 = 0 THEN -1 ELSE 4 END::INTEGER AS width,
  CASE WHEN g % 9 = 0 THEN -1 ELSE 3 END::INTEGER AS "nChannels",
  CASE WHEN g % 9 = 0 THEN '' ELSE string_agg(printf('%02X', ((g + n + (i + 12) % 24) % 256)::INTEGER), '' ORDER BY i) END AS pixels
FROM counted CROSS JOIN (SELECT unnest(range(0, 24)) AS i) GROUP BY g, n"""
ORACLE["results_file"] = ORACLE["parse_detections"]
ORACLE["lookup_stored"] = ORACLE["lookup_by_path"]
ORACLE["pending_manifest"] = ORACLE["pending_pages"]
ORACLE["recorded_documents"] = ORACLE["documents_table"]
ORACLE["recorded_tables"] = ORACLE["tables_table"]
ORACLE["missing_array"] = _with(CAT, OBT, OBTIDS) + "SELECT publication_id FROM cat WHERE publication_id NOT IN (SELECT publication_id FROM obtids)"
ORACLE["kept_pages"] = ORACLE["render_batches"]
