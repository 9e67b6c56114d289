"""Settings of a project's scan."""

from __future__ import annotations

from dataclasses import dataclass, field

# What a scan skips and reads unless told otherwise.
EXCLUDED = (
    "target", "node_modules", ".git", "dist", ".next", "__pycache__", ".mypy_cache",
    "vendor", ".build", "DerivedData", "*.xcodeproj", "*.xcworkspace",
)
EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py", "go", "swift")
DOC_EXTENSIONS = ("md", "txt", "rst")


@dataclass
class ProjectConfig:
    """root: a folder that Spark reads. rescan_seconds 0: only on force_scan()."""

    root: str
    exclude_dirs: tuple[str, ...] = EXCLUDED
    extensions: tuple[str, ...] = EXTENSIONS
    max_file_size: int = 500_000
    rescan_seconds: int = 300
    context_token_budget: int = 4_000
    ast_extraction: bool = True
    semantic_extraction: bool = False
    link_imports: bool = True
    store: str | None = None
    options: dict = field(default_factory=dict)
