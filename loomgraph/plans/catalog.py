"""Queries that show every operator on the star schema tables, each with SQL that a second engine can run.

The SQL is written from the tables where it can be, rather than from the texts that
are derived from them, so that it doesn't repeat what it is to confirm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_path, pascal_case
from ..operators import analytics, assemble, traverse
from ..operators.communities import assign_communities
from ..operators.env import detect_env_vars, detect_middleware
from ..operators.frameworks import detect_frameworks, detect_orms
from ..operators.imports import extract_imports, hot_files, import_edges
from ..operators.models import detect_models, filter_models
from ..operators.routes import detect_routes, filter_routes
from ..operators.symbols.extract import cached_scan, confidence_of, scan_files, semantic_rows, tables
from ..operators.symbols.result import Found
from ..sources import corpus
from ..sources.files import language
from ..sources.scratch import save, shared_dir
from ..sources.store import ExtractionCache, content_hash, load_tables, save_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ALL_NODES = f"nodes as ({corpus.NODES_SQL})"
ALL_EDGES = f"raw as ({corpus.EDGES_SQL}), edges as (select * from raw where from_id in (select id from nodes) and to_id in (select id from nodes))"
GRAPH_SQL = f"with recursive {ALL_NODES}, {ALL_EDGES}"
PART_FILE = "concat('src/m', cast({k} % 7 as varchar), '/p', cast({k} as varchar), '.ts')"
#: The import tree: part k imports part k / 2.
IMPORTS_SQL = f"""imports as (select {PART_FILE.format(k='a.p_partkey')} from_file, {PART_FILE.format(k='b.p_partkey')} to_file
 from part a join part b on b.p_partkey = a.p_partkey // 2 where a.p_partkey <> b.p_partkey)"""
ROUTES_SQL = f"""routes as (
 select distinct 'GET' as method, concat('/api/', cast(p_size as varchar), '/:id') as path, {PART_FILE.format(k='p_partkey')} as file, 'Express' framework from part
 union all select unnest(['GET', 'POST']), concat('/s/', cast(s_nationkey as varchar)), concat('svc/s', cast(s_suppkey as varchar), '.py'), 'Flask' from supplier
 union all select 'GET', concat('/plain/', cast(s_suppkey as varchar)), concat('svc/s', cast(s_suppkey as varchar), '.py'), 'Flask' from supplier
 union all select 'GET', concat('/c/', cast(c_nationkey as varchar)), concat('cmd/c', cast(c_custkey as varchar), '.go'), 'Gin' from customer
 union all select 'GET', concat('/n/', cast(n_nationkey as varchar)), concat('core/n', cast(n_nationkey as varchar), '.rs'), 'Axum' from nation)"""
MODELS_SQL = """models as (
 select concat('A', cast(n_nationkey as varchar)) as name, concat('n', cast(n_nationkey as varchar)) table_name, 'SeaOrm' orm, concat('core/n', cast(n_nationkey as varchar), '.rs') as file from nation
 union all select 'B', null, 'SeaOrm', concat('core/n', cast(n_nationkey as varchar), '.rs') from nation
 union all select concat('Supp', cast(s_suppkey as varchar)), concat('supp_', cast(s_suppkey % 5 as varchar)), 'SqlAlchemy', concat('svc/s', cast(s_suppkey as varchar), '.py') from supplier)"""
SOURCE, DEPTH = "src/m1/p1.ts", 3
BLAST_SQL = f"""walk as (select '{SOURCE}' as file, 0 as depth union select i.from_file, w.depth + 1 from walk w join imports i on i.to_file = w.file where w.depth + 1 < {DEPTH}),
 touched as (select file, min(depth) as depth from walk group by file)"""
CALLEE = "supplier#000000005"
BUDGET, TOPIC = 400, "region::1"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = corpus.nodes(spark, sf_dir)
    return nodes, assemble.valid_edges(corpus.edges(spark, sf_dir), nodes)


# Sources, imports


@query("language", """select case when ts * 3 >= n * 2 then 'TypeScript' when go * 3 >= n * 2 then 'Go' when py * 3 >= n * 2 then 'Python' when rs * 3 >= n * 2 then 'Rust' else 'Mixed' end as language
 from (select *, ts + py + go + rs as n from (select (select count(*) from part) ts, (select count(*) from supplier) py, (select count(*) from customer) go, (select count(*) from nation) rs))""")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(corpus.files(spark, sf_dir))


@query("raw_imports", f"""select {PART_FILE.format(k='p_partkey')} as from_file, unnest(['express', concat('../m', cast((p_partkey // 2) % 7 as varchar), '/p', cast(p_partkey // 2 as varchar))]) as "import" from part
 union all select concat('svc/s', cast(s_suppkey as varchar), '.py'), unnest(['flask', 'sqlalchemy']) from supplier
 union all select concat('cmd/c', cast(c_custkey as varchar), '.go'), 'github.com/gin-gonic/gin' from customer
 union all select concat('core/n', cast(n_nationkey as varchar), '.rs'), unnest(['axum::Router', 'sea_orm::entity::prelude::*']) from nation""")
def _raw_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_imports(corpus.files(spark, sf_dir))


@query("import_edges", f"with {IMPORTS_SQL} select * from imports")
def _import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(corpus.files(spark, sf_dir))


@query("hot_files", f"with {IMPORTS_SQL} select to_file as file, count(*) as imported_by from imports group by to_file order by imported_by desc, file limit 20")
def _hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_files(import_edges(corpus.files(spark, sf_dir)))


@query("normalize_path", "select p_partkey, concat('x/m', cast(p_partkey % 7 as varchar), '/p', cast(p_partkey as varchar)) as path from part")
def _normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir)
    parts = spark.table("part").select("p_partkey", F.concat(F.lit("../x/./y//z/../../m"), F.col("p_partkey") % 7, F.lit("/q/../p"), "p_partkey").alias("p"))
    return parts.select("p_partkey", normalize_path(F.col("p")).alias("path"))


@query("content_hash_dups", "select sha256(text) as hash, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def _content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir)
    return spark.table("documents").where("text is not null").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


# Detectors


@query("frameworks", "select unnest(['Axum', 'Express', 'Flask', 'Gin']) as framework")
def _frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_frameworks(corpus.files(spark, sf_dir))


@query("orms", "select unnest(['SeaOrm', 'SqlAlchemy']) as orm")
def _orms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_orms(corpus.files(spark, sf_dir))


@query("routes", f"with {ROUTES_SQL} select * from routes")
def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_routes(corpus.files(spark, sf_dir)).select("method", "path", "file", "framework")


@query("routes_filtered", f"with {ROUTES_SQL} select method, path, file from routes where method = 'POST' and starts_with(path, '/s/1')")
def _routes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_routes(detect_routes(corpus.files(spark, sf_dir)), "post", "/s/1").select("method", "path", "file")


@query("route_tags", f"with {ROUTES_SQL}, tags as (select unnest(string_split(path, '/')) as tag from routes) select tag, count(*) as n from tags where tag <> '' and not starts_with(tag, ':') and not starts_with(tag, '{{') group by tag")
def _route_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_routes(corpus.files(spark, sf_dir)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("schemas", f"with {MODELS_SQL} select * from models")
def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_models(corpus.files(spark, sf_dir)).select("name", "table_name", "orm", "file")


@query("schemas_filtered", f"with {MODELS_SQL} select name, table_name, file from models where lower(name) = 'supp7'")
def _schemas_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_models(detect_models(corpus.files(spark, sf_dir)), "SUPP7").select("name", "table_name", "file")


@query("pascal_case", "select p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type), ' ', '_'), '_'), lambda x: upper(x[1]) || x[2:]), '') as name from part")
def _pascal_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir)
    return spark.table("part").select("p_partkey", pascal_case(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("name"))


@query("env_vars", f"""with found as (
 select upper(replace(p_brand, '#', '_')) as name, {PART_FILE.format(k='p_partkey')} as file, 'process.env' as pattern from part
 union all select concat('SUPP_', cast(s_suppkey % 10 as varchar)), concat('svc/s', cast(s_suppkey as varchar), '.py'), 'os.getenv' from supplier
 union all select concat('CUST_', upper(c_mktsegment)), concat('cmd/c', cast(c_custkey as varchar), '.go'), 'os.Getenv' from customer)
 select name, min(file) as file, min(pattern) as pattern from found group by name""")
def _env_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_env_vars(corpus.files(spark, sf_dir))


@query("middleware", """select 'gin.Logger' as name, concat('cmd/c', cast(c_custkey as varchar), '.go') as file, 'gin/fiber/echo' as framework from customer
 union all select 'CorsLayer', concat('core/n', cast(n_nationkey as varchar), '.rs'), 'axum' from nation""")
def _middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_middleware(corpus.files(spark, sf_dir))


@query("token_stats", f"""with {ROUTES_SQL}, {MODELS_SQL}, {IMPORTS_SQL}, n as (select (select count(*) from routes) route_count, (select count(*) from models) schema_count,
 (select count(*) from part) + (select count(*) from supplier) + (select count(*) from customer) + (select count(*) from nation) file_count, least(20, (select count(distinct to_file) from imports)) hot_file_count)
 select 40 + 15 * least(route_count, 15) + 20 * least(schema_count, 10) + 10 * least(hot_file_count, 5) as estimated_context_tokens, * from n""")
def _token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    return analytics.token_stats(detect_routes(files), detect_models(files), files, hot_files(import_edges(files)))


SYMBOLS_SQL = """select concat('core/n', cast(n_nationkey as varchar), '.rs::', s.name, case when s.name = 'A' then cast(n_nationkey as varchar) else '' end) as id,
 concat(s.name, case when s.name = 'A' then cast(n_nationkey as varchar) else '' end) as label, 'Struct' as node_type, concat('core/n', cast(n_nationkey as varchar), '.rs') as file, s.line
 from nation, (select 'A' as name, 5 as line union all select 'B', 7) s
 union all """ + corpus.each_supplier([("svc/s@K@.py::list_s", "list_s", "Function", "svc/s@K@.py", 4), ("svc/s@K@.py::Supp@K@", "Supp@K@", "Class", "svc/s@K@.py", 7)], "id label node_type file line")


@query("symbols", SYMBOLS_SQL)
def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    return tables(scan_files(files), files)[0].select("id", "label", "node_type", "file", "line")


# Graph assembly


@query("graph_nodes", f"""with {ROUTES_SQL}, {MODELS_SQL} select distinct concat(file, '::route::', method, '::', path) as id, concat(method, ' ', path) as label, 'Route' as node_type from routes
 union all select concat('schema::', lower(coalesce(table_name, name))), max(struct_pack(file := file, name := name)).name, 'Schema' from models group by 1
 union all select concat('core/n', cast(n_nationkey as varchar), '.rs::A', cast(n_nationkey as varchar)), concat('A', cast(n_nationkey as varchar)), 'Struct' from nation
 union all select concat('core/n', cast(n_nationkey as varchar), '.rs::B'), 'B', 'Struct' from nation
 union all select concat('svc/s', cast(s_suppkey as varchar), '.py::list_s'), 'list_s', 'Function' from supplier
 union all select concat('svc/s', cast(s_suppkey as varchar), '.py::Supp', cast(s_suppkey as varchar)), concat('Supp', cast(s_suppkey as varchar)), 'Class' from supplier""")
def _graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ord must grow with the path here, for which is the last of a table's models
    files = corpus.files(spark, sf_dir).withColumn("ord", F.lit(0).cast("bigint"))
    routes, models = detect_routes(files), detect_models(files)
    last = models.withColumn("ord", F.row_number().over(_by_file("table_name")).cast("bigint"))
    nodes, _ = assemble.build_graph(tables(scan_files(files), files), routes, last)
    return nodes.select("id", "label", "node_type")


def _by_file(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("file", "name")


@query("dedup_last_wins", "select cast(user_id as varchar) as id, max_by(event_type, event_id) as label, max(event_id) as ord from events group by user_id")
def _dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir)
    return assemble.dedup_nodes(spark.table("events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("label"), F.col("event_id").alias("ord")))


@query("upsert_nodes", f"with {ALL_NODES} select id, case when num % 2 = 0 then upper(label) else label end as label, level * 1000000000000 + num as ord from nodes")
def _upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = corpus.nodes(spark, sf_dir)
    new = nodes.where(F.col("ord") % 2 == 0).withColumns({"label": F.upper("label"), "ord": F.col("ord") + 5})
    return assemble.upsert_nodes(nodes, new).select("id", "label", "ord")


@query("edges_valid", f"{GRAPH_SQL} select * from edges")
def _edges_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1].select("from_id", "to_id", "kind")


@query("nodes_of_type", f"with {ALL_NODES} select id, label from nodes where node_type = 'Function'")
def _nodes_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.nodes_of_type(corpus.nodes(spark, sf_dir), "Function").select("id", "label")


@query("neighbours", f"""{GRAPH_SQL} select n.id, n.label, e.kind, 'out' as direction from edges e join nodes n on n.id = e.to_id where e.from_id = 'nation::3'
 union all select n.id, n.label, e.kind, 'in' from edges e join nodes n on n.id = e.from_id where e.to_id = 'nation::3'""")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.neighbours(*graph(spark, sf_dir), "nation::3", "both").select("id", "label", "kind", "direction")


# Walks


@query("blast_radius_files", f"with recursive {IMPORTS_SQL}, {BLAST_SQL} select * from touched")
def _blast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.blast_files(import_edges(corpus.files(spark, sf_dir)), [SOURCE], DEPTH)


@query("blast_radius_routes", f"with recursive {IMPORTS_SQL}, {BLAST_SQL}, {ROUTES_SQL} select method, path, file from routes where file in (select file from touched)")
def _blast_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    return traverse.blast_routes(detect_routes(files), _blast_files(spark, sf_dir)).select("method", "path", "file")


@query("blast_radius_models", f"with recursive {IMPORTS_SQL}, {BLAST_SQL}, m as (select concat('P', cast(p_partkey as varchar)) as name from part) select name from m where exists (select 1 from touched where contains(lower(file), lower(name)))")
def _blast_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir)
    models = spark.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    return traverse.blast_models(models, _blast_files(spark, sf_dir))


@query("seed_nodes", f"with {ALL_NODES} select id, label from nodes where contains(lower(label), 'part#') or contains(lower(concat(split_part(id, '::', 1), '/', id)), 'supplier') or contains(lower(label), '00007') or contains(lower(concat(split_part(id, '::', 1), '/', id)), '00007') or contains(lower(concat(split_part(id, '::', 1), '/', id)), 'part#')")
def _seed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.seed_nodes(corpus.nodes(spark, sf_dir), "Part# SUPPLIER 00007").select("id", "label")


CONTAINS_SQL = f"{GRAPH_SQL}, links as (select * from edges where kind = 'Contains')"


@query("bfs_context", f"""{CONTAINS_SQL}, seeds as (select id from nodes where contains(lower(label), '{TOPIC}') or contains(lower(concat(split_part(id, '::', 1), '/', id)), '{TOPIC}')),
 walk as (select id, 0 as depth from seeds union select l.to_id, w.depth + 1 from walk w join links l on l.from_id = w.id where w.depth < 2),
 near as (select id, min(depth) as depth from walk group by id),
 shown as (select from_id, string_agg(label, ', ' order by to_id) as labels from (select l.from_id, l.to_id, n.label, row_number() over (partition by l.from_id order by l.to_id) as nth from links l join nodes n on n.id = l.to_id) where nth <= 4 group by from_id),
 lines as (select near.id, near.depth, n.level, n.num, concat('  [', case n.node_type when 'Module' then 'mod' when 'Struct' then 'struct' when 'Class' then 'class' when 'Function' then 'fn' else 'method' end, '] ', n.label, ' [', split_part(n.id, '::', 1), '/', n.id,
  case when n.num % 100 > 0 then concat(':', cast(n.num % 100 as varchar)) else '' end, ']', case when s.labels is null then '' else concat(' → ', s.labels) end) as line from near join nodes n on n.id = near.id left join shown s on s.from_id = near.id),
 run as (select *, row_number() over o as nth, sum(strlen(line) + 1) over (o rows unbounded preceding) as used from lines window o as (order by depth, level, num, id))
 select cast(nth as integer) as nth, id, depth, line from run where used <= {3 * BUDGET} or nth = 1""")
def _bfs_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = traverse.bfs_context(nodes, edges, TOPIC, BUDGET, "out", 2)
    return found.select("nth", "id", "depth", "line")


@query("dfs_context")
def _dfs_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return traverse.dfs_context(nodes, edges, TOPIC, BUDGET, 2).select("nth", "id", "line")


@query("dfs_tree", f"""{GRAPH_SQL}, links as (select *, row_number() over (partition by from_id order by to_id desc) as turn from edges where kind = 'Contains'),
 walk as (select id, [0::bigint] as path from nodes where id = '{TOPIC}' union all select l.to_id, list_append(w.path, l.turn) from walk w join links l on l.from_id = w.id where len(w.path) <= 2),
 shown as (select from_id, string_agg(label, ', ' order by to_id) as labels from (select l.from_id, l.to_id, n.label, row_number() over (partition by l.from_id order by l.to_id) as nth from links l join nodes n on n.id = l.to_id) where nth <= 4 group by from_id),
 lines as (select w.id, w.path, concat('  [', case n.node_type when 'Module' then 'mod' when 'Struct' then 'struct' when 'Class' then 'class' when 'Function' then 'fn' else 'method' end, '] ', n.label, ' [', split_part(n.id, '::', 1), '/', n.id,
  case when n.num % 100 > 0 then concat(':', cast(n.num % 100 as varchar)) else '' end, ']', case when s.labels is null then '' else concat(' → ', s.labels) end) as line from walk w join nodes n on n.id = w.id left join shown s on s.from_id = w.id),
 run as (select *, row_number() over o as nth, sum(strlen(line) + 1) over (o rows unbounded preceding) as used from lines window o as (order by path))
 select cast(nth as integer) as nth, id, line from run where used <= {3 * BUDGET} or nth = 1""")
def _dfs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth-first walk of the part of the graph that is a tree, where SQL can tell its order."""
    nodes, edges = graph(spark, sf_dir)
    return traverse.dfs_context(nodes, edges.where("kind = 'Contains'"), TOPIC, BUDGET, 2).select("nth", "id", "line")


@query("fallback_seeds", f"""{GRAPH_SQL}, ends as (select from_id as id from edges union all select to_id from edges)
 select n.id, n.label from nodes n left join ends using (id) group by n.id, n.label, n.level, n.num order by count(ends.id) desc, n.level, n.num limit 5""")
def _fallback_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.resolve_seeds(*graph(spark, sf_dir), "no-such-word").select("id", "label")


@query("callers", f"""{GRAPH_SQL}, walk as (select 'supplier::1' as id, 0 as depth union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id and e.kind = 'Calls' where w.depth < 2)
 select id, min(depth) as depth from walk group by id having min(depth) > 0""")
def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return traverse.callers(edges, assemble.get_node(nodes, "supplier::1"), 2)


@query("symbol_callers", f"""{GRAPH_SQL}, ends as (select from_id as id from edges union all select to_id from edges), degree as (select id, count(*) as d from ends group by id),
 best as (select n.id from nodes n left join degree using (id) where contains(lower(n.label), 'supplier') order by coalesce(d, 0) desc, level, num limit 1)
 select distinct n.id, n.label, concat(split_part(n.id, '::', 1), '/', n.id) as file, cast(n.num % 100 as integer) as line, 1 as depth from edges e join nodes n on n.id = e.from_id where e.kind = 'Calls' and e.to_id = (select id from best)""")
def _symbol_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.symbol_callers(*graph(spark, sf_dir), "Supplier", 1)


# Measures


@query("god_nodes", f"""{GRAPH_SQL}, ends as (select from_id as id from edges union all select to_id from edges)
 select n.id, n.label, count(ends.id) as degree from nodes n left join ends using (id) group by n.id, n.label, n.level, n.num order by degree desc, n.level, n.num limit 10""")
def _god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.god_nodes(*graph(spark, sf_dir), 10).select("id", "label", "degree")


@query("orphan_nodes", f"{GRAPH_SQL} select id, label from nodes where id not in (select from_id from edges) and id not in (select to_id from edges)")
def _orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.orphan_nodes(*graph(spark, sf_dir)).select("id", "label")


@query("ambiguous_nodes", f"{GRAPH_SQL} select id, label from nodes where id in (select to_id from edges where kind = 'Calls')")
def _ambiguous_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    doubt = F.when(F.col("kind") == "Calls", "Ambiguous").otherwise("Extracted")
    return analytics.ambiguous_nodes(nodes, edges.withColumn("conf_class", doubt)).select("id", "label")


@query("cross_community", f"{GRAPH_SQL} select e.from_id, e.to_id, e.kind, a.community as from_community, b.community as to_community from edges e join nodes a on a.id = e.from_id join nodes b on b.id = e.to_id where a.community <> b.community and a.community <> 0")
def _cross_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cross_community_edges(*graph(spark, sf_dir)).select("from_id", "to_id", "kind", "from_community", "to_community")


@query("graph_stats", f"""{GRAPH_SQL} select (select count(*) from nodes) as node_count, (select count(*) from edges) as edge_count, (select count(*) from nodes where node_type in ('Function', 'Method')) as function_count,
 0::bigint as route_count, 0::bigint as schema_count, (select count(distinct community) from nodes) as community_count""")
def _graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.graph_stats(*graph(spark, sf_dir))


@query("community_summary", f"""with {ALL_NODES}, tops as (select community, split_part(id, '::', 1) as folder, count(*) as n from nodes group by all),
 ranked as (select *, row_number() over (partition by community order by n desc, folder) as nth, sum(n) over (partition by community) as total from tops)
 select community as id, cast(total as bigint) as size, concat(folder, ' (', cast(cast(total as bigint) as varchar), ')') as label from ranked where nth = 1""")
def _community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.community_summary(corpus.nodes(spark, sf_dir))


@query("modularity", f"""{GRAPH_SQL}, m as (select count(*) as m, count(*) filter (a.community = b.community) as inside from edges e join nodes a on a.id = e.from_id join nodes b on b.id = e.to_id),
 ends as (select from_id as id from edges union all select to_id from edges), d as (select community, count(*) as d from ends join nodes using (id) group by community)
 select round(inside / m - (select sum(d::double * d) from d) / (4.0::double * m * m), 6) as q from m""")
def _modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.modularity(*graph(spark, sf_dir)).select(F.round("q", 6).alias("q"))


@query("louvain")
def _louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return assign_communities(nodes, edges).select("id", "community")


@query("louvain_quality", "select true as at_least_regions")
def _louvain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the communities found have a modularity no less than that of the regions that nodes belong to."""
    nodes, edges = graph(spark, sf_dir)
    found = analytics.modularity(assign_communities(nodes, edges), edges).select(F.col("q").alias("found"))
    return found.join(F.broadcast(analytics.modularity(nodes, edges))).select((F.col("found") >= F.col("q")).alias("at_least_regions"))


# The kit: further frameworks, mappers and languages. What is to be found is stated from the files' texts.

KIT_ROUTES = [
    ("GET", "/e/@K@", "web/e@K@.js", "Express"), ("POST", "/h/@K@", "web/h@K@.ts", "Hono"), ("GET", "/list", "nest/n@K@.ts", "NestJs"), ("POST", "/made@K@", "nest/n@K@.ts", "NestJs"),
    ("GET", "/api/r@K@", "src/app/api/r@K@/route.ts", "NextJs"), ("POST", "/api/r@K@", "src/app/api/r@K@/route.ts", "NextJs"), ("GET", "/f/@K@", "fast/f@K@.py", "FastApi"),
    ("GET", "/a/@K@", "act/a@K@.rs", "Actix"), ("GET", "/g/@K@", "fib/g@K@.go", "Fiber"),
]
KIT_MODELS = [("RowSets@K@", "row_sets@K@", "Diesel", "act/a@K@.rs"), ("User@K@", None, "Prisma", "schema/m@K@.prisma"), ("OrderItems", "items_@K@", "Drizzle", "db/d@K@.ts"), ("User@K@", None, "Gorm", "fib/g@K@.go")]
KIT_FIELDS = [("act/a@K@.rs", "name", "Text", ""), ("schema/m@K@.prisma", "id", "Int", "Pk"), ("schema/m@K@.prisma", "email", "String", "Unique,Nullable")]
KIT_IMPORTS = [
    ("web/e@K@.js", "express"), ("web/h@K@.ts", "hono"), ("web/h@K@.ts", "./e@K@"), ("nest/n@K@.ts", "@nestjs/common"), ("fast/f@K@.py", "fastapi"), ("fast/f@K@.py", "os"),
    ("old/o@K@.py", "os.path as p"), ("act/a@K@.rs", "actix_web::get"), ("act/a@K@.rs", "actix_web::App"), ("act/a@K@.rs", "crate::store::db"), ("act/a@K@.rs", "diesel::prelude::*"),
    ("db/d@K@.ts", "drizzle-orm/pg-core"), ("fib/g@K@.go", "github.com/gofiber/fiber/v2"), ("fib/g@K@.go", "gorm.io/gorm"),
]
#: File, name in ids, label, kind, line.
KIT_SYMBOLS = [
    ("web/e@K@.js", "start", "start", "Function", 4), ("web/e@K@.js", "stop", "stop", "Function", 5), ("web/h@K@.ts", "Card", "Card", "Function", 4),
    ("nest/n@K@.ts", "C@K@Controller", "C@K@Controller", "Class", 2), ("nest/n@K@.ts", "list", "list", "Method", 4), ("nest/n@K@.ts", "make", "make", "Method", 6),
    ("src/app/api/r@K@/route.ts", "GET", "GET", "Function", 1), ("src/app/api/r@K@/route.ts", "POST", "POST", "Function", 2),
    ("fast/f@K@.py", "read", "read", "Function", 5), ("fast/f@K@.py", "Item@K@", "Item@K@", "Class", 8), ("fast/f@K@.py", "__init__", "__init__", "Method", 9), ("fast/f@K@.py", "total", "total", "Method", 13),
    ("old/o@K@.py", "Old@K@", "Old@K@", "Class", 2), ("old/o@K@.py", "show", "show", "Method", 3), ("old/o@K@.py", "inner", "inner", "Function", 5), ("old/o@K@.py", "after", "after", "Function", 7),
    ("act/a@K@.rs", "index", "index", "Function", 5), ("act/a@K@.rs", "helper", "helper", "Function", 6), ("act/a@K@.rs", "inner", "inner", "Module", 7), ("act/a@K@.rs", "deep", "deep", "Function", 7),
    ("act/a@K@.rs", "Row@K@", "Row@K@", "Struct", 8), ("act/a@K@.rs", "show", "show", "Method", 9),
    ("fib/g@K@.go", "User@K@", "User@K@", "Struct", 4), ("fib/g@K@.go", "Doer", "Doer", "Class", 7), ("fib/g@K@.go", "Save", "Save", "Method", 8), ("fib/g@K@.go", "main", "main", "Function", 9),
    ("ios/v@K@.swift", "View@K@", "View@K@", "Struct", 2), ("ios/v@K@.swift", "View@K@.body", "body", "Method", 3), ("ios/v@K@.swift", "Box@K@", "Box@K@", "Class", 5),
    ("ios/v@K@.swift", "Box@K@.init", "init", "Method", 6), ("ios/v@K@.swift", "Id@K@", "Id@K@", "Variable", 8),
]
KIT_NODES = [(f"{file}::{name}", label, kind, file, line) for file, name, label, kind, line in KIT_SYMBOLS]
KIT_DB = "select 'lib/store/db.rs::Db' as id, 'Db' as label, 'Struct' as node_type, 'lib/store/db.rs' as file, 1 as line"
#: Edges within the graph, then those that lead out of it. Scores in hundredths.
KIT_INNER = [
    ("nest/n@K@.ts::C@K@Controller", "nest/n@K@.ts::list", "Contains", "Extracted", 100), ("nest/n@K@.ts::C@K@Controller", "nest/n@K@.ts::make", "Contains", "Extracted", 100),
    ("fast/f@K@.py::Item@K@", "fast/f@K@.py::__init__", "Contains", "Extracted", 100), ("fast/f@K@.py::Item@K@", "fast/f@K@.py::total", "Contains", "Extracted", 100),
    ("old/o@K@.py::Old@K@", "old/o@K@.py::show", "Contains", "Extracted", 100),
    ("act/a@K@.rs::index", "act/a@K@.rs::helper", "Calls", "Inferred", 70), ("act/a@K@.rs::deep", "act/a@K@.rs::helper", "Calls", "Inferred", 70), ("act/a@K@.rs::show", "act/a@K@.rs::helper", "Calls", "Inferred", 70),
    ("act/a@K@.rs::Row@K@", "act/a@K@.rs::show", "Contains", "Extracted", 100), ("fib/g@K@.go::User@K@", "fib/g@K@.go::Save", "Contains", "Extracted", 100),
    ("ios/v@K@.swift::View@K@", "ios/v@K@.swift::View@K@.body", "Contains", "Extracted", 100), ("ios/v@K@.swift::Box@K@", "ios/v@K@.swift::Box@K@.init", "Contains", "Extracted", 100),
]
KIT_OUTER = [
    ("web/h@K@.ts::__module__", "hono::__module__", "Imports", "Extracted", 100), ("web/h@K@.ts::__module__", "./e@K@::__module__", "Imports", "Extracted", 100),
    ("nest/n@K@.ts::__module__", "@nestjs/common::__module__", "Imports", "Extracted", 100), ("fast/f@K@.py::__module__", "fastapi::__module__", "Imports", "Extracted", 100),
    ("fast/f@K@.py::__module__", "os::__module__", "Imports", "Extracted", 100), ("fast/f@K@.py::__module__", "sys::__module__", "Imports", "Extracted", 100),
    ("fast/f@K@.py::Item@K@", "fast/f@K@.py::Base", "InheritsFrom", "Extracted", 100), ("old/o@K@.py::__module__", "os.path::__module__", "Imports", "Extracted", 100),
    ("old/o@K@.py::Old@K@", "old/o@K@.py::Left", "InheritsFrom", "Extracted", 100), ("old/o@K@.py::Old@K@", "old/o@K@.py::Right", "InheritsFrom", "Extracted", 100),
    ("act/a@K@.rs::__module__", "act/a@K@.rs::crate::store::db", "Imports", "Extracted", 100), ("act/a@K@.rs::Row@K@", "act/a@K@.rs::Show", "Implements", "Inferred", 80),
    ("db/d@K@.ts::__module__", "drizzle-orm/pg-core::__module__", "Imports", "Extracted", 100), ("fib/g@K@.go::__module__", "github.com/gofiber/fiber/v2::__module__", "Imports", "Extracted", 100),
    ("fib/g@K@.go::__module__", "gorm.io/gorm::__module__", "Imports", "Extracted", 100), ("ios/v@K@.swift::__module__", "SwiftUI::__module__", "Imports", "Extracted", 100),
    ("ios/v@K@.swift::View@K@", "ios/v@K@.swift::View", "Implements", "Inferred", 90),
]
EDGE_COLUMNS = "from_id to_id kind conf_class score"
_edges = lambda edges: edges.select("from_id", "to_id", "kind", "conf_class", F.round(F.col("conf_score") * 100).cast("int").alias("score"))


@query("kit_frameworks", "select unnest(['Actix', 'Express', 'FastApi', 'Fiber', 'Hono', 'NestJs', 'NextJs']) as framework")
def _kit_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_frameworks(corpus.kit(spark, sf_dir))


@query("kit_orms", "select unnest(['Diesel', 'Drizzle', 'Gorm', 'Prisma']) as orm")
def _kit_orms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_orms(corpus.kit(spark, sf_dir))


@query("kit_routes", corpus.each_supplier(KIT_ROUTES, "method path file framework"))
def _kit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_routes(corpus.kit(spark, sf_dir)).select("method", "path", "file", "framework")


@query("kit_schemas", corpus.each_supplier(KIT_MODELS, "name table_name orm file"))
def _kit_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_models(corpus.kit(spark, sf_dir)).select("name", "table_name", "orm", "file")


@query("kit_fields", corpus.each_supplier(KIT_FIELDS, "file name field_type flags"))
def _kit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = detect_models(corpus.kit(spark, sf_dir)).select("file", F.explode("fields").alias("f"))
    return fields.select("file", "f.name", "f.field_type", F.array_join("f.flags", ",").alias("flags"))


@query("kit_env_vars", f"select name, min(file) as file, min(pattern) as pattern from ({corpus.each_supplier([('ACT_@K@', 'act/a@K@.rs', 'std::env::var'), ('KEY_@K@', 'conf/.env.s@K@', 'dotenv'), ('OTHER', 'conf/.env.s@K@', 'dotenv')], 'name file pattern')}) group by name")
def _kit_env_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_env_vars(corpus.kit(spark, sf_dir))


@query("kit_middleware", corpus.each_supplier([("cors", "web/e@K@.js", "express/hono"), ("CORS", "fast/f@K@.py", "fastapi/flask"), ("Logger", "act/a@K@.rs", "actix")], "name file framework"))
def _kit_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_middleware(corpus.kit(spark, sf_dir))


@query("kit_imports", corpus.each_supplier(KIT_IMPORTS, 'from_file "import"'))
def _kit_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_imports(corpus.kit(spark, sf_dir))


@query("kit_import_edges", corpus.each_supplier([("web/h@K@.ts", "web/e@K@.js"), ("act/a@K@.rs", "lib/store/db.rs")], "from_file to_file"))
def _kit_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(corpus.kit(spark, sf_dir))


@query("kit_symbols", f"{corpus.each_supplier(KIT_NODES, 'id label node_type file line')} union all {KIT_DB}")
def _kit_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.kit(spark, sf_dir)
    return tables(scan_files(files), files)[0].select("id", "label", "node_type", "file", "line")


@query("kit_symbol_edges", corpus.each_supplier(KIT_INNER + KIT_OUTER, EDGE_COLUMNS))
def _kit_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.kit(spark, sf_dir)
    return _edges(tables(scan_files(files), files)[1])


def _kit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = save(corpus.kit(spark, sf_dir), "kit")
    modules = assemble.module_nodes(files), assemble.module_edges(import_edges(files))
    return assemble.build_graph(tables(scan_files(files), files), detect_routes(files), detect_models(files), tables(semantic_rows(files, topics), files), modules)


KIT_LINKS = [
    ("nest/n@K@.ts::route::GET::/list", "nest/n@K@.ts::list", "Contains", "Inferred", 60), ("web/h@K@.ts::__module__", "web/e@K@.js::__module__", "Imports", "Extracted", 100),
    ("act/a@K@.rs::__module__", "lib/store/db.rs::__module__", "Imports", "Extracted", 100), ("docs/t@K@.md::Topic @K@", "fast/f@K@.py::read", "Calls", "Ambiguous", 30),
]


def topics(docs: list[tuple[str, str]]) -> list[Found]:
    """A stand-in for a semantic extractor: a document's heading, and a doubtful link to the file of its number."""
    found = []
    for file, text in docs:
        one, name = Found(file), text.splitlines()[0].removeprefix("# ")
        made = one.node(name, "Module", 1)
        number = name.rpartition(" ")[2]
        one.edge(made, f"fast/f{number}.py::read", "Calls", confidence_of(0.3))
        found.append(one)
    return found


@query("kit_graph_edges", corpus.each_supplier(KIT_INNER + KIT_LINKS, EDGE_COLUMNS))
def _kit_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole graph: symbols, imports between files, documents, and routes with the symbols that their paths name."""
    return _edges(_kit_graph(spark, sf_dir)[1])


@query("kit_store_round_trip", corpus.each_supplier(KIT_INNER + KIT_LINKS, EDGE_COLUMNS))
def _kit_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges, from tables that were kept and loaded again."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}/store"
    nodes, edges = _kit_graph(spark, sf_dir)
    save_tables({"nodes": nodes, "edges": edges}, folder)
    return _edges(load_tables(spark, folder, ["nodes", "edges"])["edges"])


@query("extraction_cache", f"select file, count(*) as n from ({corpus.each_supplier(KIT_NODES, 'id label node_type file line')} union all {KIT_DB}) group by file")
def _extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each file from a cache that a scan before has filled, so that no file with symbols is scanned again."""
    files = corpus.kit(spark, sf_dir)
    cache = ExtractionCache(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}/cache")
    cached_scan(files, cache)
    known, _ = cache.partition(files)
    return known.where("is_node").groupBy(F.col("relative").alias("file")).agg(F.count("*").alias("n"))


@query("kit_language", "select 'Mixed' as language")
def _kit_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(corpus.kit(spark, sf_dir))
