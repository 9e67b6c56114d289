"""Projects: a scan's tables, kept and asked."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProjectConfig
from ..operators import analytics, assemble, traverse
from ..operators.communities import assign_communities
from ..operators.env import detect_env_vars, detect_middleware
from ..operators.frameworks import detect_frameworks, detect_orms
from ..operators.imports import hot_files, import_edges
from ..operators.models import detect_models, filter_models
from ..operators.routes import detect_routes, filter_routes
from ..operators.symbols.extract import cached_scan, scan_files, semantic_rows, tables
from ..sources import store
from ..sources.files import collect_files, language, project_name
from ..sources.scratch import save
from . import present

GRAPH = ["nodes", "edges"]
FLAT = ["files", "routes", "models", "imports", "hot", "env_vars", "middleware", "stats", "about"]


@dataclass
class Scan:
    """Tables of one scan; nodes and edges are missing after a start from a store without a graph."""

    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def has_graph(self) -> bool:
        return all(name in self.tables for name in GRAPH)


def scan_tables(spark: SparkSession, config: ProjectConfig, files: DataFrame, name: str, extractor: Callable | None = None) -> dict[str, DataFrame]:
    """All tables of a project's files: what the detectors find, and the graph that it makes.

    The files are written once and read by every detector; the only barrier is the
    set of frameworks and mappers, which gates the detectors.
    """
    files = save(files, "files")
    frameworks, orms = save(detect_frameworks(files), "frameworks"), save(detect_orms(files), "orms")
    routes = save(detect_routes(files, frameworks), "routes")
    models = save(detect_models(files, orms), "models")
    imports = save(import_edges(files), "imports")
    hot = save(hot_files(imports), "hot")
    rows = None
    if config.ast_extraction:
        cache = store.ExtractionCache(spark, f"{config.store}/symbols") if config.store else None
        rows = cached_scan(files, cache) if cache else save(scan_files(files), "symbols")
    nothing = scan_files(files.limit(0))
    symbols = tables(rows if rows is not None else nothing, files)
    semantic = tables(save(semantic_rows(files, extractor), "semantic"), files) if config.semantic_extraction and extractor else None
    modules = (assemble.module_nodes(files), assemble.module_edges(imports)) if config.link_imports and config.ast_extraction else None
    nodes, edges = assemble.build_graph(symbols, routes, models, semantic, modules)
    edges = save(edges, "edges")
    nodes = save(assign_communities(save(nodes, "nodes"), edges), "nodes")
    now = datetime.now(UTC).replace(tzinfo=None)
    about = language(files).select(
        F.lit(name).alias("name"), F.lit(config.root).alias("root"), "language",
        F.array(*(F.lit(r[0]) for r in frameworks.orderBy("framework").collect())).alias("frameworks"),
        F.array(*(F.lit(r[0]) for r in orms.orderBy("orm").collect())).alias("orms"), F.lit(now).alias("scanned_at"),
    )
    return {
        "files": files.drop("content"), "routes": routes, "models": models, "imports": imports, "hot": hot, "env_vars": save(detect_env_vars(files), "env"),
        "middleware": detect_middleware(files), "stats": analytics.token_stats(routes, models, files, hot), "about": about, "nodes": nodes, "edges": edges,
    }


class Project:
    """A project's latest scan. Asking scans first if there is none, or the last is older than the configured age."""

    def __init__(self, spark: SparkSession, config: ProjectConfig, extractor: Callable | None = None, cached: Scan | None = None) -> None:
        self.spark, self.config, self.extractor, self.cached = spark, config, extractor, cached
        self.at = time.monotonic() if cached else None

    def force_scan(self) -> Scan:
        files = collect_files(self.spark, self.config)
        found = scan_tables(self.spark, self.config, files, project_name(self.spark, self.config.root), self.extractor)
        self.cached, self.at = Scan(found), time.monotonic()
        return self.cached

    def scan(self) -> Scan:
        """The cached scan while it is young enough; with rescan_seconds 0 until force_scan()."""
        limit = self.config.rescan_seconds
        if self.cached is None or limit and time.monotonic() - self.at > limit:
            return self.force_scan()
        return self.cached

    def graph(self) -> tuple[DataFrame, DataFrame] | None:
        s = self.scan()
        return (s.nodes, s.edges) if s.has_graph else None

    def context_block(self) -> str:
        """The scan's block and, below an empty line, the graph's."""
        s, budget = self.scan(), self.config.context_token_budget
        about, stats = s.about.first(), s.stats.first().asDict()
        flat = present.context_block(about.name, about.language, about.frameworks[0], s.routes, s.models, s.hot, s.env_vars, stats, about.scanned_at, budget)
        graph = present.graph_section(s.nodes, s.edges, budget) if s.has_graph else ""
        return f"{flat}\n\n{graph}" if graph else flat

    def graph_query(self, query: str, max_tokens: int, direction: str = "both") -> str:
        found = self.graph()
        return present.walk_text(query, "BFS", traverse.bfs_context(*found, query, max_tokens, direction)) if found else ""

    def graph_query_dfs(self, query: str, max_tokens: int) -> str:
        found = self.graph()
        return present.walk_text(query, "DFS", traverse.dfs_context(*found, query, max_tokens)) if found else ""

    def blast_radius(self, files: list[str], depth: int) -> dict[str, DataFrame]:
        s = self.scan()
        touched = save(traverse.blast_files(s.imports, files, depth), "touched")
        return {"files": touched.orderBy("file"), "routes": traverse.blast_routes(s.routes, touched), "models": traverse.blast_models(s.models, touched)}

    def symbol_callers(self, symbol: str, depth: int) -> tuple[DataFrame, DataFrame] | None:
        """(the symbol's row, its callers), or none if no label holds the symbol."""
        found = self.graph()
        if not found:
            return None
        target = traverse.best_symbol(*found, symbol)
        return None if target.isEmpty() else (target, traverse.symbol_callers(*found, symbol, depth))

    def communities(self) -> tuple[DataFrame, DataFrame] | None:
        found = self.graph()
        return (analytics.community_summary(found[0]), analytics.cross_community_edges(*found)) if found else None

    def routes(self, method: str | None = None, path_prefix: str | None = None) -> DataFrame:
        return filter_routes(self.scan().routes, method, path_prefix)

    def schemas(self, model_name: str | None = None) -> DataFrame:
        return filter_models(self.scan().models, model_name)


class Registry:
    """Projects by id, with their scans kept in a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.projects = spark, folder.rstrip("/"), {}

    def get(self, project_id: str) -> Project | None:
        return self.projects.get(project_id)

    def get_or_init(self, project_id: str, config: ProjectConfig) -> Project:
        """The project at hand, or one that starts from its kept scan, if there is a whole one."""
        if project_id not in self.projects:
            self.projects[project_id] = Project(self.spark, config, cached=self.load(project_id))
        return self.projects[project_id]

    def force_reindex(self, project_id: str, config: ProjectConfig, extractor: Callable | None = None) -> Project:
        project = Project(self.spark, config, extractor)
        self.persist(project_id, project.force_scan())
        self.projects[project_id] = project
        return project

    def project_ids(self) -> list[str]:
        return sorted(self.projects)

    def invalidate(self, project_id: str) -> None:
        self.projects.pop(project_id, None)
        store.remove(self.spark, f"{self.folder}/{project_id}")

    def persist(self, project_id: str, scan: Scan) -> None:
        store.save_tables({k: scan.tables[k] for k in FLAT}, f"{self.folder}/{project_id}/scan")
        if scan.has_graph:
            store.save_tables({k: scan.tables[k] for k in GRAPH}, f"{self.folder}/{project_id}/graph")

    def load(self, project_id: str) -> Scan | None:
        """A kept scan; without its graph if only that is missing or broken."""
        flat = store.load_tables(self.spark, f"{self.folder}/{project_id}/scan", FLAT)
        if flat is None:
            return None
        graph = store.load_tables(self.spark, f"{self.folder}/{project_id}/graph", GRAPH)
        return Scan(flat | (graph or {}))
