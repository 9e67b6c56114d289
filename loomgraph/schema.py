"""Tables of the engine, and the values of their enumerated columns."""

from __future__ import annotations

FILES = "relative string, extension string, size bigint, content string, ord bigint"
ROUTES = "method string, path string, file string, framework string, tags array<string>, confidence string, ord bigint"
FIELD = "struct<name:string,field_type:string,flags:array<string>>"
SCHEMAS = f"name string, table_name string, fields array<{FIELD}>, relations array<string>, orm string, confidence string, file string, ord bigint"
IMPORT_EDGES = "from_file string, to_file string"
ENV_VARS = "name string, file string, pattern string"
MIDDLEWARE = "name string, file string, framework string"
NODES = "id string, label string, node_type string, file string, line int, community bigint, ord bigint"
EDGES = "from_id string, to_id string, kind string, conf_class string, conf_score float, ord bigint"

# Fixed values.
FRAMEWORKS = (
    "Axum", "Actix", "NextJs", "Express", "Hono", "Fastify", "NestJs", "SvelteKit",
    "Remix", "FastApi", "Flask", "Django", "Gin", "Fiber", "Echo", "Unknown",
)
ORMS = ("Diesel", "SeaOrm", "Sqlx", "Prisma", "Drizzle", "TypeOrm", "SqlAlchemy", "Gorm", "Unknown")
LANGUAGES = ("Rust", "TypeScript", "JavaScript", "Python", "Go", "Swift", "Mixed", "Unknown")
NODE_TAGS = {
    "Function": "fn", "Method": "method", "Struct": "struct", "Class": "class", "Module": "mod",
    "Route": "route", "Schema": "schema", "Document": "doc", "Concept": "concept", "Variable": "var",
}
EDGE_KINDS = ("Calls", "Imports", "Implements", "Contains", "InheritsFrom", "SemanticallySimilarTo")
EDGE_CONFIDENCES = ("Extracted", "Inferred", "Ambiguous")
