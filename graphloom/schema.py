"""Schemas of the property graph and of what surrounds it; schemas are declared, never inferred."""

NODES = (
    "seq bigint, id string, type string, name string, file string, start_line int, end_line int, language string, visibility string, is_async boolean, "
    "complexity_score int, parameters array<string>, return_type string, parent_symbol string, summary string"
)
EDGES = "edge_id bigint, source string, target string, relation string, is_bridge boolean, confidence double, context string, file string"
COMMITS = "revision string, author string, date timestamp, message string, files_changed array<string>"
BLAME = "file string, line_number int, revision string, author string, content string"
MEMORY = "key string, content string, tags array<string>, source_files array<string>, created_at timestamp, updated_at timestamp, expires_at timestamp"
FILE_CHANGES = "path string, change string, ts timestamp"
