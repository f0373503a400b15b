"""Schemas of the index tables.  All are keyed by user; the logical key is user and file."""

from __future__ import annotations

FILE = "user_id string, file_id long, file_path string, file_size long, mime_type string"

FILE_HASHES = f"{FILE}, content_hash string, file_mtime long, scanned_at timestamp"
CLASSIFICATIONS = f"{FILE}, category string, confidence double, indicators array<string>, classified_at timestamp"
FILE_LOCATIONS = f"{FILE}, has_location boolean, lat double, lng double, file_mtime long, scanned_at timestamp"
FILE_FACES = f"{FILE}, has_face boolean, face_signature string, face_confidence double, file_mtime long, scanned_at timestamp"
FACE_INSTANCES = f"{FILE}, face_index int, face_signature string, face_confidence double, file_mtime long, scanned_at timestamp"
FACE_LABELS = "label_id long, user_id string, face_signature string, label_name string, updated_at timestamp"
LISTING = f"{FILE}, file_mtime long"
EVENTS = "user_id string, file_id long, event_id long, ts timestamp, op string, file_path string, file_size long, mime_type string, content_hash string, file_mtime long"

#: Key columns by table.
KEYS = {
    "file_hashes": ["user_id", "file_id"],
    "classifications": ["user_id", "file_id"],
    "file_locations": ["user_id", "file_id"],
    "file_faces": ["user_id", "file_id"],
    "face_instances": ["user_id", "file_id", "face_index"],
    "face_labels": ["user_id", "face_signature"],
}
