"""Text blocks of scans and graphs, from top-k rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import community_summary, god_nodes, graph_stats

ROUTES, MODELS, FIELDS, HOT, GODS, COMMUNITIES = 15, 10, 5, 5, 8, 5
CUT = "\n... (truncated to token budget)"


def cut_bytes(text: str, most: int) -> str:
    """The longest start of text of so many bytes that ends with a whole character."""
    return text.encode()[:most].decode("utf-8", "ignore")


def context_block(name: str, language: str, framework: str, routes: DataFrame, models: DataFrame, hot: DataFrame, env_vars: DataFrame, stats: dict, scanned_at: datetime, budget: int) -> str:
    """What a scan found, in at most four bytes a token and a note where it was cut."""
    out = [f"== Codebase: {name} ({language} / {framework}) ==", f"Routes ({stats['route_count']}):"]
    out += [f"  {r.method} {r.path} [{r.file}]" for r in routes.orderBy("ord").limit(ROUTES).collect()]
    if stats["route_count"] > ROUTES:
        out.append(f"  ... and {stats['route_count'] - ROUTES} more")
    out.append(f"Schemas ({stats['schema_count']}):")
    for m in models.orderBy("ord").limit(MODELS).collect():
        fields = ", ".join(f.name for f in m.fields[:FIELDS])
        out.append(f"  {m.name} {{ {fields} }}" if fields else f"  {m.name}")
    if stats["schema_count"] > MODELS:
        out.append(f"  ... and {stats['schema_count'] - MODELS} more")
    files = hot.orderBy(F.desc("imported_by"), "file").limit(HOT).collect()
    if files:
        out += ["Hot files (most imported):", *(f"  {f.file} (imported by {f.imported_by} files)" for f in files)]
    # the block is cut at four bytes a token, so more names than that holds are never shown
    names = [r.name for r in env_vars.orderBy("name").limit(4 * budget // 3 + 1).collect()]
    if names:
        out.append(f"Env vars: {', '.join(names)}")
    out.append(f"Scanned: {scanned_at:%H:%M UTC} | {stats['file_count']} files | ~{stats['estimated_context_tokens']} tokens")
    out.append("== End codebase context ==")
    text = "\n".join(out)
    return text if len(text.encode()) <= 4 * budget else cut_bytes(text, 4 * budget) + CUT


def graph_section(nodes: DataFrame, edges: DataFrame, budget: int) -> str:
    """Counts, the most connected nodes and the largest communities; empty for a graph without nodes."""
    s = graph_stats(nodes, edges).first()
    if not s.node_count:
        return ""
    out = [f"== Knowledge Graph: {s.node_count} nodes, {s.edge_count} edges ({s.function_count} fns, {s.route_count} routes, {s.schema_count} schemas) =="]
    out.append("Key abstractions (by connections):")
    for g in god_nodes(nodes, edges, GODS).collect():
        out.append(f"  {g.label} [{f'{g.file}:{g.line}' if g.line > 0 else g.file}] — {g.degree} connections")
    if found := community_summary(nodes).limit(COMMUNITIES).collect():
        out += ["Communities:", *(f"  {c.label} ({c.size} nodes)" for c in found)]
    out += ['Use handle.graph_query("<topic>", tokens) for targeted subgraph context.', "== End graph context =="]
    return cut_bytes("\n".join(out), budget // 2 * 4)


def walk_text(query: str, kind: str, rows: DataFrame) -> str:
    """A walk's lines under a header that counts them."""
    lines = [r.line for r in rows.orderBy("nth").collect()]
    return "\n".join([f'=== Graph context for "{query}" ({len(lines)} nodes, {kind}) ===', *lines])
