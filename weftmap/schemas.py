"""Schemas of the index's tables."""

NODES = "id string, name string, kind string, file_path string, start_line int, end_line int, references array<string>, seq int"
SOURCES = "file_path string, source string"
FILES = "file_path string, parse_time_ms double"
EDGES = "src string, dst string"
SCORES = "file_path string, score double"

KINDS = ("function", "method", "class", "interface", "type", "enum", "module", "constant", "import", "export", "decorator", "variable")
#: Kinds that stand for links between files, left out of maps and counts of definitions.
LINK_KINDS = ("import", "export")
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python"}
