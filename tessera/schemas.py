"""Explicit schemas of the graph's node and edge tables. Each is partitioned by project on disk."""

from __future__ import annotations

FOLDER = "project string, path string, name string"
FILE = "project string, path string, name string, url string, content string"
CODE_ENTITY = (
    "project string, file string, name string, type string, labels array<string>, content string, start_line int, end_line int, embedding array<float>, "
    "decorators array<string>, base_classes array<string>, import_type string, calls array<string>, ord long"
)
DOCUMENT = "project string, path string, name string, type string"
DOC_CHUNK = "project string, path string, index int, content string, embedding array<float>"
COMMIT = "project string, hash string, author string, email string, date_raw string, date_ts timestamp, message string, files_changed array<string>, embedding array<float>"
LIBRARY = "project string, name string"
PROJECT_META = "project string, last_commit string"
EDGE = "project string, edge string, src string, dst string"

NODES = {"folder": FOLDER, "file": FILE, "code_entity": CODE_ENTITY, "document": DOCUMENT, "doc_chunk": DOC_CHUNK, "commit": COMMIT, "library": LIBRARY, "project_meta": PROJECT_META}
#: Merge keys of the upserts.
KEYS = {
    "folder": ["project", "path"], "file": ["project", "path"], "code_entity": ["project", "file", "name"], "document": ["project", "path"], "doc_chunk": ["project", "path", "index"],
    "commit": ["project", "hash"], "library": ["project", "name"], "project_meta": ["project"], "edge": ["project", "edge", "src", "dst"],
}
