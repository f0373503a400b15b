"""SQL of the queries of ``details``, written from their definitions."""

from __future__ import annotations

from .oracle import EVENTS, FACES, FILES, GONE, LAST, LISTING, LOCATIONS, REQUESTS, SCORES, SUPPORTED, THROTTLE, replayed

AT = "strftime(make_timestamp((1700000000 + {}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"
IMAGES = f"mime_type IN {SUPPORTED}"


def json(names: dict[str, str]) -> str:
    """Each row of ``r`` as a JSON text, keys in order."""
    return "SELECT CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in names.items()) + ") AS VARCHAR) AS json FROM r"


FILE = {"id": "file_id * 10 + 1", "userId": "user_id", "fileId": "file_id", "filePath": "file_path", "fileSize": "file_size"}

STORED = f"""stored AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{bad' WHEN 3 THEN '{{"status":"completed","total":-4,"processed":2}}'
  ELSE '{{"status":"scanning"}}' END AS raw, event_id AS total, event_id - event_id % 3 AS processed, event_id % 400 AS age FROM events),
parsed AS (SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 'completed' WHEN event_id % 6 > 3 THEN 'scanning' ELSE 'idle' END AS status, CASE WHEN event_id % 6 = 3 THEN -4 WHEN event_id % 6 > 3 THEN total ELSE 0 END AS raw_total,
  CASE WHEN event_id % 6 = 3 THEN 2 WHEN event_id % 6 > 3 THEN processed ELSE 0 END AS processed, CASE WHEN event_id % 6 > 3 THEN age END AS age FROM stored)"""

VERSIONS = "(VALUES (1), (2)) v(version)"


def upserts(table: str, values: str, shown: str) -> str:
    """The second version of every third file and of new ones, over the others."""
    return f"""changed AS (SELECT * FROM {table} WHERE file_id % 3 = 0 UNION ALL SELECT * REPLACE (-file_id - 1 AS file_id) FROM {table} WHERE file_id % 7 = 0),
after AS (SELECT * REPLACE ({values}) FROM changed UNION ALL SELECT * FROM {table} WHERE file_id % 3 <> 0) {shown}"""


PHOTOS = "(file_path IN ('Photos','photos') OR file_path LIKE 'Photos/%' OR file_path LIKE 'photos/%')"
FACE_FILES = "faces_of AS (SELECT user_id, file_id, file_path, file_id % 4 <> 1 AS has_face, CASE WHEN file_id % 4 <> 1 THEN 's' || vec_id END AS face_signature FROM faces WHERE face_index = 1)"

MOVES = """files0 AS (SELECT user_id, file_id, CASE WHEN file_id % 2 = 0 THEN 'Old/' ELSE 'New/' END AS folder, 'n' || (file_id % 10) AS stem, CASE WHEN file_id % 4 = 1 THEN '_1' ELSE '' END AS suffix FROM files),
asked AS (SELECT *, row_number() OVER (PARTITION BY user_id, stem, suffix ORDER BY file_id) AS turn, count(*) OVER (PARTITION BY user_id, stem, suffix) AS wanted FROM files0 WHERE file_id % 6 = 2),
held AS (SELECT DISTINCT user_id, stem || suffix AS name FROM files0 WHERE folder = 'New/'),
numbers AS (SELECT a.user_id, a.stem, a.suffix, k, row_number() OVER (PARTITION BY a.user_id, a.stem, a.suffix ORDER BY k) AS turn
  FROM (SELECT DISTINCT user_id, stem, suffix, wanted FROM asked) a, LATERAL (SELECT unnest(range(0, wanted + 3)) AS k)
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = a.user_id AND h.name = a.stem || a.suffix || CASE WHEN k = 0 THEN '' ELSE '_' || k END)),
moved AS (SELECT a.user_id, a.file_id AS pos, a.file_id, 'moved' AS outcome, 'New/' || a.stem || a.suffix || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.jpg' AS new_path FROM asked a JOIN numbers USING (user_id, stem, suffix, turn))"""

IOU = """(CASE WHEN least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)
  THEN (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) ELSE 0 END)"""

# Progress ends as it says; while scanning, if nothing comes for more than 180 seconds.
SETTLED = """WITH s AS (SELECT CAST(event_id % 23 AS VARCHAR) AS user_id, CASE WHEN event_id % 11 = 0 THEN 'completed' WHEN event_id % 37 = 0 THEN 'error' ELSE 'scanning' END AS status, event_id % 5 * 10 AS total, event_id % 7 * 10 AS processed,
  make_timestamp((1700000000 + event_id * 10) * 1000000) AS updated_at FROM events), n AS (SELECT *, lead(updated_at) OVER (PARTITION BY user_id ORDER BY updated_at) AS next FROM s)
SELECT user_id, CASE WHEN status <> 'scanning' THEN status WHEN total > 0 AND processed >= total THEN 'completed' ELSE 'interrupted' END AS status, total, processed, updated_at FROM n
WHERE status <> 'scanning' OR next IS NULL OR next > updated_at + INTERVAL 180 SECOND"""

SQL = {
    "listing_visible": f"""WITH {FILES} SELECT user_id, count(*) AS files, count(*) FILTER ({IMAGES}) AS images FROM files WHERE file_id % 6 NOT IN (0, 1, 3) GROUP BY user_id""",
    "listing_types": """SELECT doc_id AS file_id, CASE doc_id % 9 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 4 THEN 'image/heic' WHEN 6 THEN 'image/x-dcraw' WHEN 7 THEN 'image/svg+xml' WHEN 8 THEN 'image/webp'
      ELSE 'application/octet-stream' END AS mime_type FROM documents""",
    "capped_hashes": """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN sha256(coalesce(text, '')) END AS content_hash, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN 'done' ELSE 'error' END AS outcome FROM documents""",
    "tag_locations": """WITH t AS (SELECT event_id AS file_id, event_id AS k, NOT (k % 5 <> 0 AND (k % 7 = 0 OR k % 11 = 0) OR k % 17 = 0 OR k % 13 = 0) AS there FROM events)
      SELECT file_id, there AS has_location, CASE WHEN there THEN round(((k % 90)::DOUBLE + (k % 60)::DOUBLE / 60.0::DOUBLE + ((k % 600)::DOUBLE / 10) / 3600.0::DOUBLE) * CASE WHEN k % 5 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END, 9) END AS lat,
      CASE WHEN there THEN round(((k % 180)::DOUBLE + (k % 60)::DOUBLE / 60.0::DOUBLE + (k % 60)::DOUBLE / 3600.0::DOUBLE) * CASE WHEN k % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END, 9) END AS lng FROM t""",
    "tag_numbers": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id / 4.0::DOUBLE WHEN 2 THEN event_id + 0.5::DOUBLE WHEN 5 THEN -event_id::DOUBLE WHEN 7 THEN event_id * 10.0::DOUBLE END AS number FROM events",
    "tags_flattened": """SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'last' ELSE CAST(doc_id AS VARCHAR) END AS make, CASE WHEN doc_id % 3 <> 0 THEN '1' ELSE '0' END AS flash,
      CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS VARCHAR) END AS iso, CASE WHEN doc_id % 3 <> 0 THEN 3 ELSE 2 END AS tags FROM documents""",
    "page_settings": """WITH a AS (SELECT event_id, event_id * 7 % 500 - 100 AS l, event_id % 50 - 10 AS o FROM events)
      SELECT event_id, greatest(1, least(200, l)) AS page_limit, greatest(0, o) AS page_offset, greatest(1, least(50, l)) AS clusters, greatest(1, least(300, l)) AS candidates, CASE WHEN event_id % 4 = 0 THEN 'photos' ELSE 'all' END AS scope FROM a""",
    "ranged_hashes": """SELECT doc_id AS file_id, strlen(coalesce(text, '')) AS length, CASE WHEN strlen(coalesce(text, '')) <= 20000 THEN sha256(coalesce(text, '')) END AS content_hash,
      CASE WHEN strlen(coalesce(text, '')) <= 20000 THEN 'done' ELSE 'error' END AS outcome FROM documents""",
    "eligible_files": f"""WITH {FILES}, r AS (SELECT file_id, CASE WHEN file_id % 19 = 0 THEN 0 ELSE file_size * 4096 END AS size, CASE file_id % 8 WHEN 0 THEN 'image/tiff' WHEN 1 THEN 'image/heic' ELSE mime_type END AS mime FROM files)
      SELECT file_id, 'categories' AS worker FROM r WHERE size > 0 AND size <= 12582912 AND mime IN ('image/jpeg','image/png','image/webp','image/gif')
      UNION ALL SELECT file_id, 'faces' FROM r WHERE size > 0 AND size <= 52428800 AND mime IN ('image/jpeg','image/png','image/webp','image/gif','image/bmp','image/tiff')""",
    "progress_read": f"WITH {STORED} SELECT event_id, status, greatest(0, raw_total) AS total, processed, raw_total FROM parsed",
    "progress_settled": f"""WITH {STORED}, s AS (SELECT *, coalesce(400 - age > 180, true) AS stale, greatest(0, raw_total) AS total FROM parsed),
      t AS (SELECT event_id, stale, status AS was, CASE WHEN status = 'scanning' AND stale THEN CASE WHEN total > 0 AND processed >= total THEN 'completed' ELSE 'interrupted' END ELSE status END AS status FROM s)
      SELECT event_id, stale, status, was <> 'scanning' AS may_start, status <> 'scanning' AS may_restart FROM t""",
    "progress_written": f"""WITH {FILES}, n AS (SELECT user_id, count(*) AS total FROM files GROUP BY user_id),
      p AS (SELECT user_id, total, unnest(range(50, total, 50)) AS processed, 'scanning' AS status FROM n UNION ALL SELECT user_id, total, total, 'completed' FROM n)
      SELECT user_id, processed, '{{"status":"' || status || '","total":' || total || ',"processed":' || processed || ',"updated_at":"2023-11-14T22:13:20+00:00"}}' AS text FROM p""",
    "upsert_categories": f"""WITH {SCORES}, base AS (SELECT user_id, file_id, category, top AS confidence FROM best),
      {upserts('base', "'meme' AS category, 0.5::DOUBLE AS confidence", "SELECT user_id, category, count(*) AS files, count(*) FILTER (confidence = 0.5) AS half FROM after GROUP BY ALL")}""",
    "upsert_locations": f"""WITH {LOCATIONS}, base AS (SELECT user_id, file_id, has_location, 0 AS file_mtime FROM locations), {upserts('base', 'false AS has_location, 2 AS file_mtime', 'SELECT user_id, file_id, has_location, file_mtime FROM after')}""",
    "upsert_faces": f"""WITH {FACES}, {FACE_FILES}, {upserts('faces_of', "true AS has_face, 'v2' AS face_signature", 'SELECT user_id, file_id, has_face, face_signature FROM after')}""",
    "faces_present": f"WITH {FACES}, {FACE_FILES} SELECT user_id, file_id, face_signature FROM faces_of WHERE has_face",
    "face_file_counts": f"WITH {FACES}, {FACE_FILES} SELECT user_id, count(*) FILTER (has_face) AS files FROM faces_of WHERE {PHOTOS} GROUP BY user_id",
    "location_file_counts": f"WITH {LOCATIONS} SELECT user_id, count(*) FILTER (has_location) AS files FROM locations GROUP BY user_id",
    "class_count_one": f"WITH {SCORES} SELECT user_id, count(*) AS count FROM best WHERE category = 'family' GROUP BY user_id",
    "faces_replaced": f"""WITH {FACES}, gone AS (SELECT DISTINCT user_id, file_id FROM faces WHERE file_id % 3 = 0)
      SELECT user_id, file_id, face_index, 's' || vec_id AS face_signature, face_confidence FROM faces WHERE file_id % 3 <> 0
      UNION ALL SELECT user_id, file_id, 1, 'n' || file_id, 0.5 FROM gone WHERE file_id % 2 = 0 UNION ALL SELECT user_id, file_id, 2, 'm' || file_id, 0.6 FROM gone WHERE file_id % 2 = 0""",
    "labels_set": f"""WITH {FACES}, c AS (SELECT user_id, 's' || vec_id AS sig, CASE WHEN vec_id % 8 = 0 THEN 'Later' WHEN vec_id % 6 IN (0, 1) THEN '' ELSE 'New ' || (vec_id % 6) END AS name FROM faces WHERE vec_id % 2 = 0 AND (vec_id % 22 <> 0 OR vec_id % 8 = 0))
      SELECT user_id, sig AS face_signature, name AS label_name FROM c WHERE name <> '' UNION ALL
      SELECT user_id, 's' || vec_id, 'Old' FROM faces WHERE vec_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = faces.user_id AND c.sig = 's' || vec_id)""",
    "users_dropped": f"WITH {FILES} SELECT user_id, count(*) AS files FROM files WHERE user_id <> 'en' GROUP BY user_id",
    "point_lookup": f"WITH {FILES} SELECT user_id, file_id, content_hash FROM files WHERE user_id IN ('en', 'de') AND file_id IN (7, 8, -1)",
    "json_file_hashes": f"WITH {FILES}, r AS (SELECT * FROM files) " + json(FILE | {"contentHash": "content_hash", "mimeType": "mime_type", "fileMtime": "file_mtime", "scannedAt": AT.format("file_id")}),
    "json_classifications": f"WITH {FILES}, r AS (SELECT * FROM files) "
    + json(FILE | {"mimeType": "mime_type", "category": "'meme'", "confidence": "round((file_id % 8) / 16.0::DOUBLE, 3)", "indicators": "CASE WHEN file_id % 2 = 0 THEN ['a', 'b'] ELSE [] END", "classifiedAt": AT.format("file_id")}),
    "json_file_locations": f"WITH {FILES}, r AS (SELECT *, file_id % 2 = 0 AS t FROM files) "
    + json(FILE | {"mimeType": "mime_type", "hasLocation": "t", "lat": "CASE WHEN t THEN file_id % 90 + 0.25::DOUBLE END", "lng": "CASE WHEN t THEN -(file_id % 90) - 0.5::DOUBLE END", "fileMtime": "file_mtime", "scannedAt": AT.format("file_id")}),
    "json_file_faces": f"WITH {FILES}, r AS (SELECT *, file_id % 2 = 0 AS t FROM files) "
    + json(FILE | {"mimeType": "mime_type", "hasFace": "t", "faceSignature": "CASE WHEN t THEN 's' END", "faceConfidence": "CASE WHEN t THEN (file_id % 8) / 8.0::DOUBLE + 0.25::DOUBLE END", "fileMtime": "file_mtime", "scannedAt": AT.format("file_id")}),
    "json_face_instances": f"WITH {FILES}, r AS (SELECT * FROM files) "
    + json(FILE | {"mimeType": "mime_type", "faceIndex": "1", "faceSignature": "'s' || file_id", "faceConfidence": "(file_id % 8) / 8.0::DOUBLE + 0.25::DOUBLE", "fileMtime": "file_mtime", "scannedAt": AT.format("file_id")}),
    "json_face_labels": f"WITH {FILES}, r AS (SELECT * FROM files) " + json({"id": "file_id * 10 + 1", "userId": "user_id", "faceSignature": "'s' || file_id", "labelName": "'A \"B\"'", "updatedAt": AT.format("file_id")}),
    "free_names": f"""WITH {FILES} SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'a_3.jpg' WHEN 1 THEN 'b_1' WHEN 2 THEN 'c.tar_2.gz' WHEN 3 THEN '_2.x' ELSE 'free.png' END AS name FROM files""",
    "confidence_forms": f"WITH {FILES} SELECT file_id, CAST(floor((file_id % 201) / 200.0::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) AS percent, 'a b ' || replace(user_id, '_', ' ') || ' ' AS spaced FROM files",
    "face_confidences": """WITH b AS (SELECT vec_id, 0.5::DOUBLE + ((vec_id % 30 + 1) * (vec_id % 41 + 1))::DOUBLE / 4096 * 2.0::DOUBLE + (vec_id % 5 + 1) * 0.05::DOUBLE AS base FROM embeddings)
      SELECT vec_id, round_even(least(1.0::DOUBLE, greatest(0.3::DOUBLE, CASE WHEN vec_id % 3 <> 0 THEN base * 0.6::DOUBLE + (vec_id % 64) / 64.0::DOUBLE * 0.4::DOUBLE ELSE base END)), 4) AS confidence FROM b""",
    "prompt_expansion": """WITH d AS (SELECT DISTINCT doc_id AS k FROM documents), known AS (SELECT 'c' || (k % 4) AS category, 'p' || (k // 8) AS prompt, min(k) AS pos FROM d GROUP BY ALL),
      wanted AS (SELECT 'c' || (k % 6) AS label, min(k) AS ord FROM d GROUP BY ALL)
      SELECT label AS category, coalesce(prompt, label) AS prompt, ord, coalesce(pos, 0) AS pos FROM wanted LEFT JOIN known ON category = label""",
    "ml_retry": f"""WITH {FILES} SELECT user_id, file_id, ['document','meme','nature','family','object'][file_size % 5 + 1] AS category, round((file_size % 100) / 100.0::DOUBLE, 6) AS confidence FROM files
      WHERE mime_type IN ('image/jpeg','image/png','image/webp','image/gif') AND file_size > 0 AND file_id % 7 <> 0""",
    "face_worker": f"""WITH {FILES}, r AS (SELECT * FROM files WHERE mime_type IN ('image/jpeg','image/png','image/webp','image/gif','image/bmp','image/tiff') AND file_size > 0)
      SELECT user_id, file_id, 0 AS pos, 'a' || file_size AS signature, 0.9::DOUBLE AS confidence FROM r UNION ALL SELECT user_id, file_id, 1, 'b' || file_size, 0.8::DOUBLE FROM r WHERE file_size % 2 = 0""",
    "move_files": f"""WITH {FILES}, {MOVES} SELECT * FROM moved UNION ALL SELECT user_id, file_id, file_id, 'invalid_target', NULL FROM files WHERE file_id % 6 = 3
      UNION ALL SELECT user_id, file_id, -file_id, 'not_found', NULL FROM files WHERE file_id % 6 = 4""",
    "classified_delete": f"""WITH {FILES}, {LISTING}, {REQUESTS} SELECT a.user_id, a.pos, a.file_id, CASE WHEN l.file_id IS NULL THEN 'already_removed' ELSE 'deleted' END AS outcome FROM asked a LEFT JOIN listing l USING (user_id, file_id) WHERE a.pos < 0""",
    "duplicate_delete": f"""WITH {FILES}, nodes AS (SELECT user_id, file_id, n, file_path || '#' || n AS path, file_id % 8 > 2 OR n = 2 AS deletable FROM files, (VALUES (1), (2)) v(n) WHERE file_id % 8 <> 0 AND (n = 1 OR file_id % 8 = 2)),
      asked AS (SELECT user_id, file_id, content_hash, file_id * 7919 % 10007 AS pos FROM files WHERE file_id % 3 <> 1),
      s AS (SELECT a.*, (SELECT count(*) FROM nodes n WHERE n.user_id = a.user_id AND n.file_id = a.file_id) = 0 AS gone, (SELECT arg_min(path, n.n) FROM nodes n WHERE n.user_id = a.user_id AND n.file_id = a.file_id AND deletable) AS path,
        (SELECT count(*) FROM files f WHERE f.user_id = a.user_id AND f.content_hash = a.content_hash) AS copies FROM asked a),
      t AS (SELECT *, copies - least(copies - 1, coalesce(sum((gone OR path IS NOT NULL)::INT) OVER (PARTITION BY user_id, content_hash ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS alive FROM s),
      o AS (SELECT user_id, file_id, CASE WHEN alive <= 1 THEN 'last_copy' WHEN gone THEN 'already_removed' WHEN path IS NULL THEN 'not_deletable' ELSE 'deleted' END AS outcome, path FROM t)
      SELECT user_id, file_id, outcome, CASE WHEN outcome = 'deleted' THEN path END AS path FROM o UNION ALL SELECT user_id, -file_id, 'not_indexed', NULL FROM files WHERE file_id % 100 = 5""",
    "header_sizes": "SELECT doc_id AS file_id, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE doc_id % 5000 END::INT AS width, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE doc_id * 31 % 7001 END::INT AS height FROM documents",
    "group_after_delete": f"""WITH {FILES}, {REQUESTS}, gone AS (SELECT user_id, file_id FROM plan WHERE outcome = 'deleted')
      SELECT user_id, content_hash, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS total_size FROM files f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = f.user_id AND g.file_id = f.file_id) GROUP BY ALL HAVING count(*) > 1""",
    "reference_faces": f"WITH {FACES} SELECT user_id, file_id FROM faces GROUP BY ALL HAVING count(*) = 1",
    "pages_appended": "SELECT lang AS user_id, doc_id AS file_id, doc_id // 20 AS page, doc_id % 20 AS pos FROM documents",
    "event_apply_all_types": f"""WITH {EVENTS}, {replayed('true')} SELECT user_id, file_id, file_path, mime_type FROM rows_after""",
    "event_delete_both": f"""WITH {LAST}, {GONE} SELECT user_id, file_id, 'file_hashes' AS table_name FROM last ANTI JOIN gone_last USING (user_id, file_id)
      UNION ALL SELECT user_id, file_id, 'classifications' FROM last ANTI JOIN gone_ever USING (user_id, file_id)""",
    "scans_settled": SETTLED,
    "scans_settled_stream": SETTLED,
    "cleanup_throttle_stream": THROTTLE,
    "job_scan": f"""WITH {FILES}, {LISTING}, work AS (SELECT l.* FROM listing l LEFT JOIN indexed i USING (user_id, file_id) WHERE l.file_size <> 0 AND l.file_id % 40 <> 0 AND (i.file_id IS NULL OR i.file_mtime <> l.file_mtime OR i.file_size <> l.file_size))
      SELECT user_id, file_id, file_size, file_mtime FROM work UNION ALL SELECT i.user_id, i.file_id, i.file_size, i.file_mtime FROM indexed i JOIN listing USING (user_id, file_id) WHERE NOT EXISTS (SELECT 1 FROM work w WHERE w.user_id = i.user_id AND w.file_id = i.file_id)""",
    "job_scan_forced": f"""WITH {FILES}, {LISTING} SELECT user_id, count(*) AS total, count(*) FILTER (file_id % 40 <> 0) AS hashed, 0 AS skipped, count(*) FILTER (file_id % 40 = 0) AS errors FROM listing WHERE file_size <> 0 GROUP BY user_id""",
    "job_cleanup": f"""WITH {FILES}, {LISTING}, g AS (SELECT user_id, content_hash, row_number() OVER (PARTITION BY user_id ORDER BY sum(file_size) DESC, count(*) DESC, content_hash) AS n FROM files GROUP BY user_id, content_hash HAVING count(*) > 1)
      SELECT user_id, count(*) AS files, CAST(sum(file_id) AS BIGINT) AS ids FROM files f WHERE NOT (EXISTS (SELECT 1 FROM g WHERE g.user_id = f.user_id AND g.content_hash = f.content_hash AND n <= 20)
        AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.user_id = f.user_id AND l.file_id = f.file_id)) GROUP BY user_id""",
    "face_nms": f"""WITH RECURSIVE boxes AS (SELECT vec_id % 40 AS file_id, vec_id * 37 % 200 AS x, vec_id * 53 % 150 AS y, vec_id * 7 % 60 + 40 AS w, vec_id * 11 % 60 + 40 AS h FROM embeddings),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w * h DESC, x, y, w, h) AS rn FROM boxes),
      clash AS (SELECT b.file_id, b.rn, list(a.rn) AS with_ FROM ranked a JOIN ranked b ON a.file_id = b.file_id AND a.rn < b.rn AND {IOU}::DOUBLE / (a.w * a.h + b.w * b.h - {IOU}) >= 0.35::DOUBLE GROUP BY ALL),
      walk(file_id, rn, kept) AS (SELECT file_id, 0::BIGINT, []::BIGINT[] FROM ranked GROUP BY file_id UNION ALL
        SELECT w.file_id, r.rn, CASE WHEN c.with_ IS NOT NULL AND list_has_any(w.kept, c.with_) THEN w.kept ELSE list_append(w.kept, r.rn) END
        FROM walk w JOIN ranked r ON r.file_id = w.file_id AND r.rn = w.rn + 1 LEFT JOIN clash c ON c.file_id = r.file_id AND c.rn = r.rn),
      ends AS (SELECT file_id, kept FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rn DESC) AS z FROM walk) WHERE z = 1),
      out AS (SELECT file_id, unnest(kept) AS rn, generate_subscripts(kept, 1) AS face_index FROM ends)
      SELECT o.file_id, face_index, x, y, w, h, 0.9::DOUBLE AS score FROM out o JOIN ranked r ON r.file_id = o.file_id AND r.rn = o.rn""",
}
