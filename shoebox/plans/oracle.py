"""The queries again as SQL for DuckDB, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from shoebox.sources import fixtures

FILES = f"files AS ({fixtures.FILE_INDEX.format(octets='strlen', hash='sha256(text)')})"
PHOTOS = "scoped AS (SELECT * FROM files WHERE file_path IN ('Photos','photos') OR file_path LIKE 'Photos/%' OR file_path LIKE 'photos/%')"
LOCATIONS = f"locations AS ({fixtures.LOCATIONS})"
EVENTS = f"log AS ({fixtures.FILE_EVENTS.format(k=chr(39).join(['json_extract_string(props, ', '$.k', ')']))})"
GROUPS = "SELECT user_id, content_hash, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS total_size FROM {} GROUP BY ALL HAVING count(*) > 1"
PAGE = f"page AS ({GROUPS.format('files')} ORDER BY total_size DESC, count DESC, content_hash, user_id LIMIT {{}} OFFSET {{}})"

STATS = """, sized AS (SELECT user_id, content_hash, file_size, count(*) AS n FROM {0} GROUP BY ALL),
hashed AS (SELECT user_id, content_hash, sum(n) AS n, sum((n - 1) * file_size) AS w FROM sized GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS indexed_files, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicate_groups,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_files, CAST(sum(w) AS BIGINT) AS wasted_bytes FROM hashed GROUP BY user_id"""

LISTING = """listing AS (SELECT * REPLACE (file_mtime + CASE WHEN file_id % 7 = 1 THEN 5 ELSE 0 END AS file_mtime,
  CASE WHEN file_id % 17 = 3 THEN 0 WHEN file_id % 11 = 2 THEN file_size + 1 ELSE file_size END AS file_size) FROM files WHERE file_id % 9 <> 4),
indexed AS (SELECT * FROM files WHERE file_id % 5 <> 2)"""
DIFF = f"""WITH {FILES}, {LISTING} SELECT l.user_id, l.file_id, i.file_id IS NOT NULL AS was_indexed,
  i.file_id IS NULL OR NOT ({{}}) AS needs_work FROM listing l LEFT JOIN indexed i USING (user_id, file_id) WHERE l.file_size <> 0"""
WORK = "work AS (SELECT l.* FROM listing l LEFT JOIN indexed i USING (user_id, file_id) WHERE l.file_size <> 0 AND (i.file_id IS NULL OR i.file_mtime <> l.file_mtime OR i.file_size <> l.file_size))"

REQUESTS = """asked AS (SELECT user_id, file_id, -file_id AS pos FROM files WHERE file_id % 3 <> 0 UNION ALL SELECT user_id, file_id, 1 FROM files WHERE file_id % 30 = 1
  UNION ALL SELECT user_id, -7, 2 FROM files WHERE file_id = 0),
turns AS (SELECT a.*, f.content_hash AS h, row_number() OVER (PARTITION BY a.user_id, a.file_id ORDER BY pos) AS turn FROM asked a LEFT JOIN files f USING (user_id, file_id)),
copies AS (SELECT user_id, content_hash AS h, count(*) AS copies FROM files GROUP BY ALL),
nths AS (SELECT t.*, c.copies, CASE WHEN turn = 1 THEN row_number() OVER (PARTITION BY t.user_id, t.h, turn = 1 ORDER BY pos) END AS nth FROM turns t LEFT JOIN copies c USING (user_id, h)),
plan AS (SELECT user_id, pos, file_id, CASE WHEN h IS NULL THEN 'not_indexed' WHEN turn > 1 THEN 'repeated' WHEN nth < copies THEN 'deleted' ELSE 'last_copy' END AS outcome FROM nths)"""

# Weights are doubles, added in the order of the rules.
SCORES = f"""p AS ({fixtures.PHOTO_ATTRS}),
f AS (SELECT *, coalesce(make, '') <> '' AS cam, coalesce(flash, 0) & 1 = 1 AS fl, date_original IS NOT NULL AS dated,
  CASE WHEN height > 0 THEN width::DOUBLE / height ELSE 1.0::DOUBLE END AS ar, width::DOUBLE * height / 1000000 AS mp,
  CASE WHEN width > 0 AND height > 0 THEN file_size::DOUBLE / (width * height) ELSE 0::DOUBLE END AS bpp,
  CASE WHEN focal_length LIKE '%/%' THEN CASE WHEN split_part(focal_length, '/', 2)::DOUBLE > 0 THEN split_part(focal_length, '/', 1)::DOUBLE / split_part(focal_length, '/', 2)::DOUBLE END ELSE focal_length::DOUBLE END AS mm,
  regexp_matches(file_name, 'screenshot|bildschirmfoto|screen[\\s_-]?shot|scan[\\s_-]?\\d|document|receipt|invoice|page[\\s_-]?\\d|pdf|print|statement', 'i') AS docfn,
  regexp_matches(file_name, '^[a-f0-9]{{8,}}\\.(jpg|jpeg|png|webp)$|meme|funny|lol|FB_IMG|instagram|reddit|twitter|received_\\d+|signal-\\d+|whatsapp|^IMG-\\d{{8}}-WA\\d+|download|saved', 'i') AS memefn,
  regexp_matches(file_name, '^IMG_\\d{{4,}}|^PXL_\\d{{4,}}|^DSC_\\d{{3,}}|selfie|portrait|family|kids?|child|vacation|holiday', 'i') AS famfn,
  mime_type = 'image/png' AS png, mime_type = 'image/jpeg' AS jpeg,
  EXISTS (SELECT 1 FROM (VALUES (1920,1080),(1080,1920),(2560,1440),(1440,2560),(3840,2160),(2160,3840),(1366,768),(768,1366),(1280,720),(720,1280),(2048,1536),(1536,2048),(2732,2048),(2048,2732),
    (1125,2436),(2436,1125),(1170,2532),(2532,1170),(1284,2778),(2778,1284),(1290,2796),(2796,1290)) s(w, h) WHERE width <> 0 AND height <> 0 AND abs(width - w) < w * 0.05::DOUBLE AND abs(height - h) < h * 0.05::DOUBLE) AS screen
  FROM p),
a AS (SELECT *,
  0::DOUBLE + if(png AND NOT cam, 0.18::DOUBLE, 0) + if(screen AND NOT cam, 0.15::DOUBLE, 0) + if(docfn, 0.45::DOUBLE, 0) + if(NOT has_gps AND NOT cam, 0.10::DOUBLE, 0)
    + if(png AND bpp > 0 AND bpp < 1.5, 0.08::DOUBLE, 0) + if(cam AND NOT docfn, -0.25::DOUBLE, 0) + if(has_gps, -0.10::DOUBLE, 0) + if(jpeg AND NOT docfn, -0.08::DOUBLE, 0) AS d1,
  0::DOUBLE + if(NOT cam AND NOT has_gps, 0.15::DOUBLE, 0) + if(file_size > 0 AND file_size < 500000, 0.15::DOUBLE, 0) + if(mp > 0 AND mp < 2, 0.10::DOUBLE, 0)
    + if(jpeg AND bpp > 0 AND bpp < 0.5, 0.15::DOUBLE, 0) + if(memefn, 0.30::DOUBLE, 0) + if(ar > 0.8::DOUBLE AND ar < 1.25::DOUBLE AND mp < 3, 0.10::DOUBLE, 0) AS m1,
  0::DOUBLE + if(has_gps, 0.12::DOUBLE, 0) + if(cam, 0.06::DOUBLE, 0) + if(cam AND NOT fl, 0.08::DOUBLE, 0) + if(ar > 1.3::DOUBLE, 0.15::DOUBLE, 0) + if(mp >= 8, 0.08::DOUBLE, 0)
    + if(coalesce(mm <= 35, false), 0.14::DOUBLE, 0) + if(file_size > 3000000, 0.05::DOUBLE, 0) + if(fl, -0.18::DOUBLE, 0) + if(ar < 1, -0.12::DOUBLE, 0) + if(coalesce(mm >= 60, false), -0.08::DOUBLE, 0) AS n1,
  0::DOUBLE + if(cam, 0.10::DOUBLE, 0) + if(ar < 0.85::DOUBLE, 0.15::DOUBLE, 0) + if(ar >= 0.85::DOUBLE AND ar <= 1.45::DOUBLE, 0.08::DOUBLE, 0) + if(fl, 0.18::DOUBLE, 0)
    + if(coalesce(least(abs(mm - 35), abs(mm - 50), abs(mm - 56), abs(mm - 85), abs(mm - 105), abs(mm - 135)) < 5, false), 0.18::DOUBLE, 0) + if(dated, 0.10::DOUBLE, 0) + if(famfn, 0.20::DOUBLE, 0)
    + if(mp >= 5 AND file_size > 1000000, 0.10::DOUBLE, 0) + if(has_gps AND cam, 0.05::DOUBLE, 0) + if(NOT cam AND mp >= 2 AND ar >= 0.75::DOUBLE AND ar <= 1.5::DOUBLE, 0.08::DOUBLE, 0) AS f1,
  0::DOUBLE + 0.05::DOUBLE + if(ar > 0.9::DOUBLE AND ar < 1.1::DOUBLE AND cam, 0.15::DOUBLE, 0) + if(mp >= 2 AND mp < 8, 0.05::DOUBLE, 0) AS o1 FROM f),
b AS (SELECT *, d1 + if(NOT docfn AND d1 > 0.45::DOUBLE, -0.18::DOUBLE, 0) + if(jpeg AND NOT docfn AND mp >= 1.5::DOUBLE, -0.10::DOUBLE, 0) AS d2,
  n1 + if(fl OR coalesce(mm >= 50, false) OR ar < 1.15::DOUBLE, -0.12::DOUBLE, 0) AS n2, f1 + if(cam AND NOT has_gps AND ar <= 1.45::DOUBLE, 0.07::DOUBLE, 0) AS f2 FROM a),
scores AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, d2)) AS document, greatest(0::DOUBLE, least(1::DOUBLE, m1)) AS meme, greatest(0::DOUBLE, least(1::DOUBLE, n2)) AS nature,
  greatest(0::DOUBLE, least(1::DOUBLE, f2 + if(cam AND has_gps AND n2 > 0.35::DOUBLE AND f2 > 0.30::DOUBLE, 0.05::DOUBLE, 0))) AS family, greatest(0::DOUBLE, least(1::DOUBLE, o1)) AS object FROM b),
best AS (SELECT *, greatest(document, meme, nature, family, object) AS top, CASE WHEN greatest(document, meme, nature, family, object) = 0 THEN 'object' WHEN document = top THEN 'document' WHEN meme = top THEN 'meme'
  WHEN nature = top THEN 'nature' WHEN family = top THEN 'family' ELSE 'object' END AS category FROM scores)"""

#: Per category, the conditions again, to count indicators.
INDICATORS = {
    "document": {
        "png_no_camera": "png AND NOT cam", "screen_resolution": "screen AND NOT cam", "document_filename": "docfn", "no_metadata": "NOT has_gps AND NOT cam", "low_compression_ratio": "png AND bpp > 0 AND bpp < 1.5",
        "camera_penalty": "cam AND NOT docfn", "gps_penalty": "has_gps", "jpeg_photo_bias_penalty": "jpeg AND NOT docfn", "doc_without_filename_penalty": "NOT docfn AND d1 > 0.45::DOUBLE",
        "jpeg_document_penalty": "jpeg AND NOT docfn AND mp >= 1.5",
    },
    "meme": {
        "no_camera_metadata": "NOT cam AND NOT has_gps", "small_file_size": "file_size > 0 AND file_size < 500000", "low_resolution": "mp > 0 AND mp < 2", "high_jpeg_compression": "jpeg AND bpp > 0 AND bpp < 0.5",
        "meme_filename": "memefn", "square_aspect": "ar > 0.8::DOUBLE AND ar < 1.25 AND mp < 3",
    },
    "nature": {
        "has_gps": "has_gps", "has_camera": "cam", "no_flash": "cam AND NOT fl", "landscape_orientation": "ar > 1.3::DOUBLE", "high_resolution": "mp >= 8", "wide_angle": "mm <= 35", "large_file": "file_size > 3000000",
        "flash_penalty": "fl", "portrait_penalty": "ar < 1", "telephoto_penalty": "mm >= 60", "nature_context_penalty": "fl OR coalesce(mm >= 50, false) OR ar < 1.15::DOUBLE",
    },
    "family": {
        "has_camera": "cam", "portrait_orientation": "ar < 0.85::DOUBLE", "human_photo_aspect": "ar >= 0.85::DOUBLE AND ar <= 1.45::DOUBLE", "flash_used": "fl",
        "portrait_focal_length": "least(abs(mm - 35), abs(mm - 50), abs(mm - 56), abs(mm - 85), abs(mm - 105), abs(mm - 135)) < 5", "has_date": "dated", "family_filename": "famfn",
        "high_quality": "mp >= 5 AND file_size > 1000000", "gps_with_camera": "has_gps AND cam", "phone_export_people_bias": "NOT cam AND mp >= 2 AND ar >= 0.75 AND ar <= 1.5",
        "family_indoor_camera_bias": "cam AND NOT has_gps AND ar <= 1.45::DOUBLE", "family_close_competitor_boost": "cam AND has_gps AND n2 > 0.35::DOUBLE AND f2 > 0.30::DOUBLE",
    },
    "object": {"default_category": "true", "square_with_camera": "ar > 0.9::DOUBLE AND ar < 1.1::DOUBLE AND cam", "medium_resolution": "mp >= 2 AND mp < 8"},
}
COUNT_INDICATORS = " UNION ALL ".join(f"SELECT '{c}/{n}' AS indicator, count(*) AS files FROM b WHERE {w}" for c, rules in INDICATORS.items() for n, w in rules.items())
#: How many rules of the winning category held, and the fallback.
HELD = "CASE category " + " ".join(f"WHEN '{c}' THEN " + " + ".join(f"coalesce(({w})::INT, 0)" for w in rules.values()) for c, rules in INDICATORS.items()) + " END + 1"

CELL = "CAST(floor({0} * 10000 + 0.5::DOUBLE) AS BIGINT)"


def shown(x: str) -> str:
    n = CELL.format(x)
    return f"(CASE WHEN {n} < 0 OR ({n} = 0 AND {x} < 0) THEN '-' ELSE '' END || CAST(abs({n}) // 10000 AS VARCHAR) || '.' || lpad(CAST(abs({n}) % 10000 AS VARCHAR), 4, '0'))"


MARKED = f"""{LOCATIONS}, marked AS (SELECT *, {shown('lat')} || ',' || {shown('lng')} AS marker FROM locations WHERE has_location AND lat IS NOT NULL AND lng IS NOT NULL)"""

FACES = f"""faces0 AS ({fixtures.FACES.format(vector=fixtures.DUCK_VECTOR)}),
faces AS (SELECT * EXCLUDE (raw), list_transform(raw, lambda x: CAST(round_even(x / sqrt(list_sum(list_transform(raw, lambda y: y * y))) * 127, 0) AS BIGINT)) AS sig FROM faces0),
vecs AS (SELECT *, list_transform(sig, lambda x: x / 127.0::DOUBLE / sqrt(list_sum(list_transform(sig, lambda y: (y / 127.0::DOUBLE) * (y / 127.0::DOUBLE))))) AS vec, count(*) OVER (PARTITION BY user_id, file_id) AS n_faces FROM faces)"""
LABELS = """labels0 AS (SELECT vec_id AS label_id, user_id, sig, 'P' || label AS person FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY vec_id) AS n FROM faces WHERE vec_id % 4 < 2) WHERE n <= 3
  UNION ALL SELECT -1, user_id, sig, 'Nobody' FROM faces WHERE vec_id = 2 UNION ALL SELECT -2, user_id, sig, '' FROM faces WHERE vec_id = 9),
refs AS (SELECT * FROM labels0 l WHERE person <> '' AND EXISTS (SELECT 1 FROM vecs v WHERE v.user_id = l.user_id AND v.sig = l.sig AND v.n_faces = 1))"""
CENTRES = """parts AS (SELECT r.user_id, person, unnest(range(64)) AS pos, unnest(vec) AS x, label_id FROM refs r JOIN (SELECT DISTINCT user_id, sig, vec FROM vecs) v ON r.user_id = v.user_id AND r.sig = v.sig),
sums AS (SELECT user_id, person, pos, sum(x) AS x, min(label_id) AS ord FROM parts GROUP BY user_id, person, pos),
centres AS (SELECT user_id, person, min(ord) AS ord, list(x / n ORDER BY pos) AS vec FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id, person)) AS n FROM sums) GROUP BY user_id, person)"""
ASSIGN = """pairs AS (SELECT v.vec_id, c.person, list_sum(list_transform(range(1, 65), lambda i: v.vec[i] * c.vec[i])) AS score, c.ord FROM vecs v JOIN centres c USING (user_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS nth, coalesce(lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, ord), -1) AS second FROM pairs),
found AS (SELECT v.*, coalesce(r.person, k.person) AS person, CASE WHEN r.person IS NOT NULL THEN 1.0::DOUBLE ELSE k.score END AS match_score FROM vecs v LEFT JOIN refs r ON r.user_id = v.user_id AND r.sig = v.sig
  LEFT JOIN ranked k ON k.vec_id = v.vec_id AND nth = 1 AND score >= 0.74::DOUBLE AND score - second >= 0.01::DOUBLE WHERE coalesce(r.person, k.person) IS NOT NULL),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person, file_id ORDER BY match_score DESC, face_index) AS n FROM found) WHERE n = 1),
files AS (SELECT *, row_number() OVER (PARTITION BY user_id, person ORDER BY match_score DESC, face_confidence DESC, file_size DESC, file_id) AS pos, count(*) OVER (PARTITION BY user_id, person) AS cnt FROM once)"""
PEOPLE = f"WITH {FACES}, {LABELS}, {CENTRES}, {ASSIGN}"

LAST = f"{EVENTS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_id ORDER BY ts DESC, event_id DESC) AS n FROM log) WHERE n = 1)"
THROTTLE = f"""WITH RECURSIVE {EVENTS}, idle AS (SELECT DISTINCT user_id, ts FROM log WHERE op <> 'created'), due AS (SELECT user_id, min(ts) AS ts FROM idle GROUP BY user_id
      UNION ALL SELECT d.user_id, (SELECT min(i.ts) FROM idle i WHERE i.user_id = d.user_id AND i.ts >= d.ts + INTERVAL 300 SECOND) AS ts FROM due d WHERE d.ts IS NOT NULL) SELECT user_id, count(*) AS cleanups FROM due WHERE ts IS NOT NULL GROUP BY user_id"""

# Listeners see images alone.
GONE = """gone_last AS (SELECT user_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_id ORDER BY ts DESC, event_id DESC) AS m FROM log WHERE mime_type = 'image/jpeg') WHERE m = 1 AND op = 'deleted'),
gone_ever AS (SELECT DISTINCT user_id, file_id FROM log WHERE mime_type = 'image/jpeg' AND op = 'deleted')"""
BASE = "base AS (SELECT user_id, file_id, 'Photos/old.jpg' AS file_path, 1::BIGINT AS file_size, 'image/jpeg' AS mime_type, 'old' AS content_hash, max(event_id) AS file_mtime FROM log WHERE event_id % 3 = 0 GROUP BY user_id, file_id)"


def replayed(seen: str) -> str:
    """Rows after the log: one event after another, a created one counts unless the content before it has its time and size, a rename unless a content that counts comes later."""
    content = "file_path, file_size, mime_type, content_hash, file_mtime"
    return f"""{BASE}, seen AS (SELECT * FROM log WHERE {seen} AND NOT (op IN ('created', 'written') AND file_size = 0)),
contents AS (SELECT *, lag(op) OVER w AS op0, lag(file_mtime) OVER w AS m0, lag(file_size) OVER w AS s0 FROM seen WHERE op <> 'renamed' WINDOW w AS (PARTITION BY user_id, file_id ORDER BY ts, event_id)),
known AS (SELECT c.*, CASE WHEN op0 IS NULL THEN b.file_mtime WHEN op0 <> 'deleted' THEN m0 END AS m1, CASE WHEN op0 IS NULL THEN b.file_size WHEN op0 <> 'deleted' THEN s0 END AS s1 FROM contents c LEFT JOIN base b USING (user_id, file_id)),
counted AS (SELECT * FROM known WHERE op <> 'created' OR m1 IS NULL OR m1 <> file_mtime OR s1 <> file_size QUALIFY row_number() OVER (PARTITION BY user_id, file_id ORDER BY ts DESC, event_id DESC) = 1),
named AS (SELECT user_id, file_id, ts, event_id, file_path FROM seen WHERE op = 'renamed' QUALIFY row_number() OVER (PARTITION BY user_id, file_id ORDER BY ts DESC, event_id DESC) = 1),
there AS (SELECT user_id, file_id, {content}, ts, event_id FROM counted WHERE op <> 'deleted' UNION ALL SELECT user_id, file_id, {content}, NULL, NULL FROM base b WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.user_id = b.user_id AND c.file_id = b.file_id)),
rows_after AS (SELECT t.* REPLACE (CASE WHEN n.file_path IS NOT NULL AND (t.ts IS NULL OR n.ts > t.ts OR n.ts = t.ts AND n.event_id > t.event_id) THEN n.file_path ELSE t.file_path END AS file_path) FROM there t LEFT JOIN named n USING (user_id, file_id))"""


SUPPORTED = "('image/jpeg','image/png','image/gif','image/webp','image/heic','image/heif','image/tiff','image/bmp','image/svg+xml','image/x-dcraw')"


def trimmed_target() -> str:
    t = "CASE WHEN file_id % 4 = 0 THEN '../' || file_path WHEN file_id % 4 = 1 THEN '/' || file_path ELSE file_path || '/' END"
    return f"CASE WHEN contains({t}, '..') OR starts_with({t}, '/') THEN NULL ELSE trim({t}, '/') END"


# The worker's prompts as label names, in order.
PROMPT_NAMES = (
    "'a_document_scan_with_text','a_screenshot_of_an_app_or_website','an_invoice_or_receipt','printed_page_with_mostly_text','an_internet_meme','a_social_media_post_image','a_funny_image_with_caption_text',"
    "'chat_app_forwarded_image','a_nature_landscape','mountains,_forest,_sea,_or_outdoor_scenery_with_no_close_people','a_travel_landscape_photo','outdoor_scenic_view','a_family_photo_with_people','people_portrait',"
    "'group_of_people_indoors_or_outdoors','a_child_or_kids_in_a_photo','a_person_taking_a_selfie','a_photo_of_an_object','product_shot','close-up_of_an_item','indoor_clutter_or_household_items','car_interior_or_dashboard'"
)


ORACLE: dict[str, str] = {
    "dup_groups_all": f"WITH {FILES} {GROUPS.format('files')}",
    "dup_groups_photos": f"WITH {FILES}, {PHOTOS} {GROUPS.format('scoped')}",
    "dup_groups_page2": f"WITH {FILES}, {PAGE.format(20, 20)} SELECT * FROM page",
    "dup_group_count": f"WITH {FILES}, g AS ({GROUPS.format('files')}) SELECT user_id, count(*) AS groups FROM g GROUP BY user_id",
    "dup_page_files": f"WITH {FILES}, {PAGE.format(20, 0)} SELECT p.*, f.file_id, f.file_path, f.file_size, f.mime_type, f.file_mtime FROM page p JOIN files f USING (user_id, content_hash)",
    "dup_group_detail": f"WITH {FILES}, {PAGE.format(1, 0)}, g AS ({GROUPS.format('files')}) SELECT f.user_id, f.content_hash, f.file_id, f.file_path, f.file_size, f.file_mtime, g.count, g.total_size FROM files f JOIN g USING (user_id, content_hash) WHERE content_hash = (SELECT content_hash FROM page)",
    "dup_stats_all": f"WITH {FILES}{STATS.format('files')}",
    "dup_stats_photos": f"WITH {FILES}, {PHOTOS}{STATS.format('scoped')}",
    "dup_wasted_bytes": f"WITH {FILES}, s AS (SELECT user_id, content_hash, file_size, count(*) AS n FROM files GROUP BY ALL HAVING count(*) > 1) SELECT user_id, CAST(sum((n - 1) * file_size) AS BIGINT) AS wasted_bytes FROM s GROUP BY user_id",
    "dup_files_semi": f"WITH {FILES} SELECT user_id, file_id, content_hash FROM files WHERE (user_id, content_hash) IN (SELECT (user_id, content_hash) FROM files GROUP BY user_id, content_hash HAVING count(*) > 1)",
    "dup_keep_one": f"WITH {FILES}, k AS (SELECT user_id, content_hash, min(file_id) AS kept FROM files GROUP BY ALL) SELECT user_id, content_hash, file_id, file_path, file_size FROM files JOIN k USING (user_id, content_hash) WHERE file_id <> kept",
    "bulk_delete_plan": f"WITH {FILES}, {REQUESTS} SELECT * FROM plan",
    "bulk_delete_summary": f"WITH {FILES}, {REQUESTS} SELECT user_id, count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome <> 'deleted') AS failed FROM plan GROUP BY user_id",
    "index_keyset_page": f"WITH {FILES} SELECT user_id, file_id, file_path FROM files WHERE file_id > 100 ORDER BY file_id LIMIT 500",
    "index_diff": DIFF.format("i.file_mtime = l.file_mtime AND i.file_size = l.file_size"),
    "index_diff_mtime": DIFF.format("i.file_mtime = l.file_mtime"),
    "index_diff_row": DIFF.format("true"),
    "index_merge": f"WITH {FILES}, {LISTING}, {WORK} SELECT user_id, file_id, file_size, file_mtime FROM work UNION ALL SELECT user_id, file_id, file_size, file_mtime FROM indexed WHERE (user_id, file_id) NOT IN (SELECT (user_id, file_id) FROM work)",
    "index_stale_anti": f"WITH {FILES}, {LISTING} SELECT user_id, file_id, file_path FROM files ANTI JOIN listing USING (user_id, file_id)",
    "index_stale_kept": f"WITH {FILES}, {LISTING} SELECT user_id, count(*) AS files FROM files SEMI JOIN listing USING (user_id, file_id) GROUP BY user_id",
    "scan_counters": f"""WITH {FILES}, {LISTING}, d AS (SELECT l.user_id, l.file_id, i.file_id IS NULL OR i.file_mtime <> l.file_mtime OR i.file_size <> l.file_size AS w FROM listing l LEFT JOIN indexed i USING (user_id, file_id) WHERE l.file_size <> 0),
      o AS (SELECT *, CASE WHEN w AND file_id % 40 = 0 THEN 'error' WHEN w THEN 'done' ELSE 'skipped' END AS outcome FROM d)
      SELECT user_id, count(*) AS total, count(*) FILTER (outcome = 'done') AS hashed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors,
        count(*) FILTER (outcome <> 'error' AND file_id % 2 = 0) AS with_positive FROM o GROUP BY user_id""",
    "index_counts": f"WITH {FILES}, {PHOTOS} SELECT user_id, count(*) AS files, count(*) FILTER (mime_type IN {SUPPORTED}) AS images FROM scoped GROUP BY user_id",
    "index_json": f"WITH {LOCATIONS} SELECT file_id, CAST(has_location AS VARCHAR) AS has_location, round(lat, 6) AS lat, '2023-11-14T22:13:20+00:00' AS scanned_at FROM locations",
    "class_scores": f"WITH {SCORES} SELECT file_id, round(document, 9) AS document, round(meme, 9) AS meme, round(nature, 9) AS nature, round(family, 9) AS family, round(object, 9) AS object FROM scores",
    "class_indicators": f"WITH {SCORES} SELECT * FROM ({COUNT_INDICATORS}) WHERE files > 0",
    "class_best": f"WITH {SCORES} SELECT file_id, category, round(top, 9) AS confidence, CAST({HELD} AS BIGINT) AS n_indicators FROM best",
    "class_counts": f"WITH {SCORES} SELECT category, count(*) AS count FROM best GROUP BY category",
    "class_counts_zero_filled": f"WITH {SCORES}, r AS (SELECT * FROM best) SELECT c.category, count(r.file_id) AS count, (SELECT count(*) FROM r) AS total FROM (VALUES ('document'), ('meme'), ('nature'), ('family'), ('object')) c(category) LEFT JOIN r USING (category) GROUP BY c.category",
    "class_page": f"WITH {SCORES} SELECT file_id, round(top, 9) AS confidence FROM best WHERE category = 'family' ORDER BY top DESC, file_id LIMIT 30 OFFSET 10",
    "ml_merge": f"""WITH {SCORES}, m AS (SELECT *, file_id % 2 = 0 AND file_id % 10 <> 0 AND (file_id % 100) / 80.0::DOUBLE BETWEEN 0.45::DOUBLE AND 1 AS ok FROM best)
      SELECT file_id, CASE WHEN ok THEN 'meme' ELSE category END AS category, round(CASE WHEN ok THEN (file_id % 100) / 80.0::DOUBLE ELSE top END, 9) AS confidence,
        CASE WHEN ok THEN 'ml_inference,ml_model:m,ml_label:a:0.250' ELSE '' END AS indicators FROM m""",
    "place_markers": f"WITH {MARKED} SELECT user_id, marker, round(arg_min(lat, file_id), 6) AS lat, round(arg_min(lng, file_id), 6) AS lng, count(*) AS count FROM marked GROUP BY user_id, marker",
    "place_totals": f"WITH {MARKED} SELECT user_id, (SELECT count(DISTINCT marker) FROM marked m WHERE m.user_id = l.user_id) AS total_markers, count(*) AS total_photos_with_location FROM locations l WHERE has_location GROUP BY user_id",
    "place_marker_files": f"WITH {MARKED} SELECT * FROM (SELECT user_id, marker, CAST(row_number() OVER (PARTITION BY user_id, marker ORDER BY file_id) AS INT) AS pos, file_id FROM marked) WHERE pos <= 200",
    "gps_decimal": """SELECT event_id, CASE WHEN event_id % 7 IN (2, 3, 5) THEN NULL ELSE round(((event_id % 90)::DOUBLE + (event_id % 60)::DOUBLE / 2 / 60 + (event_id % 3600)::DOUBLE / 100 / 3600) * CASE WHEN event_id % 4 < 2 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END, 6) + 0.0::DOUBLE END AS decimal FROM events""",
    "face_counts": f"WITH {FACES} SELECT user_id, file_id, count(*) AS faces FROM faces GROUP BY ALL",
    "face_images": f"WITH {FACES} SELECT user_id, count(DISTINCT file_id) AS total_face_images FROM faces GROUP BY ALL",
    "face_decode": f"WITH {FACES} SELECT vec_id, CAST(list_sum(sig) AS BIGINT) AS total, list_min(sig) AS least, list_max(sig) AS most FROM faces",
    "ref_candidates": f"""WITH {FACES}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, sig ORDER BY face_confidence DESC, file_id, face_index) AS n FROM vecs WHERE n_faces = 1)
      SELECT * FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY face_confidence DESC, file_size DESC, file_id) AS INT) AS pos, file_id, face_confidence AS confidence FROM b WHERE n = 1) WHERE pos <= 120""",
    "ref_eligible_labels": f"WITH {FACES}, {LABELS} SELECT user_id, label_id, person FROM refs",
    "person_centroids": f"WITH {FACES}, {LABELS}, {CENTRES} SELECT user_id, person, pos, round(x / n, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id, person)) AS n FROM sums)",
    "person_assign": f"{PEOPLE} SELECT vec_id, user_id, person, round(match_score, 6) AS match_score FROM found",
    "person_clusters": f"""{PEOPLE}, h AS (SELECT f.user_id, person, cnt, face_confidence AS conf, c.ord FROM files f JOIN centres c USING (user_id, person) WHERE pos = 1)
      SELECT user_id, cluster_id, person, count, top_confidence, total_clusters FROM (SELECT user_id, 'person-' || substr(sha1(person), 1, 12) AS cluster_id, person, cnt AS count, conf AS top_confidence, count(*) OVER (PARTITION BY user_id) AS total_clusters,
        row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, cnt DESC, ord) AS rank FROM h) WHERE rank <= 10""",
    "person_page": f"{PEOPLE} SELECT user_id, person, CAST(pos AS INT) AS pos, file_id, cnt AS count, least(cnt, 15) < cnt AS has_more, least(cnt, 15) AS next_offset FROM files WHERE pos > 5 AND pos <= 15",
    "person_files_only_one_profile": f"""WITH {FACES}, {LABELS}, {CENTRES}, s AS (SELECT v.*, CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.user_id = v.user_id AND r.sig = v.sig AND r.person = 'P1') THEN 1.0::DOUBLE
        ELSE list_sum(list_transform(range(1, 65), lambda i: v.vec[i] * c.vec[i])) END AS score FROM vecs v JOIN centres c ON c.user_id = v.user_id AND c.person = 'P1'),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_id ORDER BY score DESC, face_index) AS n FROM s WHERE score >= 0.74::DOUBLE) WHERE n = 1)
      SELECT user_id, file_id, round(score, 6) AS match_score, count(*) OVER (PARTITION BY user_id) AS count FROM o""",
    "signature_files": f"""WITH {FACES}, w AS (SELECT * FROM faces f WHERE EXISTS (SELECT 1 FROM faces g WHERE g.user_id = f.user_id AND g.sig = f.sig AND g.vec_id % 10 < 4)),
      c AS (SELECT *, count(*) OVER (PARTITION BY user_id, file_id) AS k, row_number() OVER (PARTITION BY user_id, file_id ORDER BY face_confidence DESC, face_index) AS n FROM w)
      SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY face_confidence DESC, file_size DESC, file_id) AS INT) AS pos, file_id, k AS faces, count(*) OVER (PARTITION BY user_id) AS count FROM c WHERE n = 1""",
    "event_apply_last": f"WITH {LAST} SELECT user_id, file_id, event_id, op, file_size FROM last",
    "event_apply_index": f"""WITH {EVENTS}, {replayed("mime_type = 'image/jpeg'")} SELECT user_id, file_id, file_path, content_hash, file_size FROM rows_after""",
    "event_apply_stream": f"""WITH {EVENTS}, {replayed("mime_type = 'image/jpeg'")} SELECT user_id, file_id, file_path, content_hash, file_size FROM rows_after""",
    "event_delete_cascade": f"""WITH {LAST}, {GONE} SELECT t.table_name, CASE t.table_name WHEN 'file_hashes' THEN (SELECT count(*) FROM last ANTI JOIN gone_last USING (user_id, file_id))
      WHEN 'classifications' THEN (SELECT count(*) FROM last ANTI JOIN gone_ever USING (user_id, file_id)) ELSE (SELECT count(*) FROM last) END AS rows FROM (VALUES ('file_hashes'), ('classifications'), ('file_faces'), ('file_locations')) t(table_name)""",
    "event_rates": f"WITH {EVENTS} SELECT date_trunc('day', ts) AS start, op, count(*) AS n FROM log GROUP BY ALL",
    "path_functions": f"WITH {FILES} SELECT file_id, regexp_extract(file_path, '[^/]*$') AS base, regexp_replace(file_path, '/?[^/]*$', '') AS folder, file_path AS relative, {trimmed_target()} AS target FROM files",
    "ml_label_argmax": f"""WITH {FILES}, prompts AS (SELECT unnest(range(22)) AS rank), s AS (SELECT file_id, rank, ((file_id * 31 + rank * 17) % 101) / 128.0::DOUBLE AS score,
        CASE WHEN rank < 4 THEN 'document' WHEN rank < 8 THEN 'meme' WHEN rank < 12 THEN 'nature' WHEN rank < 17 THEN 'family' ELSE 'object' END AS category FROM files, prompts),
      t AS (SELECT file_id, category, max(score) AS top, min(rank) AS ord FROM s GROUP BY ALL), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY top DESC, ord) AS n FROM t) WHERE n = 1),
      names AS (SELECT unnest(range(22)) AS rank, unnest([{PROMPT_NAMES}]) AS name),
      r AS (SELECT file_id, rank, row_number() OVER (PARTITION BY file_id ORDER BY round_even(score, 4) DESC, rank) AS n FROM s)
      SELECT w.file_id, w.category, round_even(w.top, 4) AS confidence, a.name AS first, b.name AS fifth FROM w JOIN r r1 ON r1.file_id = w.file_id AND r1.n = 1 JOIN names a ON a.rank = r1.rank
        JOIN r r5 ON r5.file_id = w.file_id AND r5.n = 5 JOIN names b ON b.rank = r5.rank""",
    "display_forms": f"""WITH {FILES}, n AS (SELECT *, (file_size * file_size)::DOUBLE AS n FROM files), u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS k FROM n)
      SELECT file_id, CASE WHEN n = 0 THEN '0 B' WHEN k = 0 THEN CAST(n::BIGINT AS VARCHAR) || ' B' ELSE CAST(CAST(floor(n * 10 / pow(1024, k) + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(n * 10 / pow(1024, k) + 0.5) AS BIGINT) % 10 AS VARCHAR)
        || CASE k WHEN 1 THEN ' KB' WHEN 2 THEN ' MB' ELSE ' GB' END END AS size, CAST(least(100, floor(file_id * 100.0 / 700 + 0.5)) AS INT) AS progress, substr(content_hash, 1, 12) AS preview FROM u""",
    "ml_breaker": f"""WITH RECURSIVE {EVENTS}, calls AS (SELECT event_id % 16 AS run_id, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 16 = 3 THEN 503 ELSE 200 END WHEN event_id % 5 = 0 THEN 422 ELSE 503 END AS status FROM log),
      e AS (SELECT *, sum((status = 200)::INT) OVER (PARTITION BY run_id ORDER BY seq) AS epoch FROM calls), s AS (SELECT *, sum((status = 503)::INT) OVER (PARTITION BY run_id, epoch ORDER BY seq) AS streak FROM e),
      t AS (SELECT run_id, min(seq) AS stop FROM s WHERE status = 503 AND streak >= 5 GROUP BY run_id) SELECT c.run_id, count(*) AS calls, count(*) FILTER (t.stop IS NULL OR c.seq <= t.stop) AS asked FROM calls c LEFT JOIN t USING (run_id) GROUP BY c.run_id""",
    "cleanup_throttle": THROTTLE,
    "signature_hashes": f"""WITH {FILES}, s AS (SELECT file_id, user_id, content_hash, repeat(content_hash, CAST(file_id % 4 + 1 AS INT)) AS t FROM files)
      SELECT file_id, CASE WHEN length(t) <= 191 THEN t ELSE 'sig:v1:' || sha256(t) END AS signature, 'person-' || substr(sha1(user_id), 1, 12) AS cluster,
        CAST(list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(('0x' || content_hash[i])::INT, ('0x' || content_hash[65 - i])::INT)))) AS BIGINT) AS distance FROM s""",
}
