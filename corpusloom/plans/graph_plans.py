"""Queries over graphs, architecture and impact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import architecture as A
from corpusloom.operators import graph as G
from corpusloom.operators import impact as I
from corpusloom.plans.bind import EDGES_SQL, TRADE_SQL, nation_edges, part_edges, table

#: The stated starts: ids divisible by 20.
_SEEDS = "node % 20 = 0"
SEEDS_SQL = "seeds AS (SELECT DISTINCT src AS query_id, src AS node FROM edges WHERE src % 20 = 0)"


def _seeds(edges):
    return edges.select(F.col("src").alias("query_id"), F.col("src").alias("node")).where(_SEEDS).distinct()


def edge_build(spark, d):
    return part_edges(spark, d)


def degree_in_out(spark, d):
    return G.degrees(part_edges(spark, d)).select("node", "out_degree", "in_degree")


def neighbours_of_node(spark, d):
    """One hop from the smallest source, both ways."""
    e = part_edges(spark, d)
    first = e.agg(F.min("src")).first()[0]
    both = G.neighbours(e, first).withColumn("way", F.lit("out")).unionByName(G.neighbours(e, e.agg(F.min("dst")).first()[0], False).withColumn("way", F.lit("in")))
    return both


def _reach(name, edges_of, depth):
    def run(spark, d):
        e = edges_of(part_edges(spark, d))
        return G.reach(e, _seeds(part_edges(spark, d)), depth).select("query_id", "node", F.col("depth").cast("bigint").alias("depth"))

    run.__name__ = name
    run.__doc__ = f"Nodes within {depth} steps of the seeds, with their distance."
    return run


bfs_depth2 = _reach("bfs_depth2", lambda e: e, 2)
reverse_reach4 = _reach("reverse_reach4", G.reverse, 4)


def reach_both_ways(spark, d):
    """Either direction within two steps."""
    e = part_edges(spark, d)
    return G.reach(e.union(G.reverse(e)).distinct(), _seeds(e), 2).select("query_id", "node", F.col("depth").cast("bigint").alias("depth"))


def reach_cycles(spark, d):
    """Nodes within three steps of the seeds; a seed on a cycle reaches itself."""
    e = part_edges(spark, d)
    return G.reach(e, _seeds(e), 3, cycles=True).select("query_id", "node", F.col("depth").cast("bigint").alias("depth"))


CYCLES_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {SEEDS_SQL}, walk AS (SELECT DISTINCT query_id, dst AS node, 1 AS depth FROM seeds JOIN edges ON src = node UNION
  SELECT w.query_id, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT query_id, node, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL"""


def _reach_sql(join: str, depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, {SEEDS_SQL}, walk AS (SELECT query_id, node, 0 AS depth FROM seeds UNION
  SELECT w.query_id, e.b, w.depth + 1 FROM walk w JOIN ({join}) e ON e.a = w.node WHERE w.depth < {depth})
SELECT query_id, node, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0"""


_FWD, _REV = "SELECT src AS a, dst AS b FROM edges", "SELECT dst AS a, src AS b FROM edges"


def bfs_multi_seed_roles(spark, d):
    """Up to twelve neighbours of each seed with the role of their first reach."""
    e = part_edges(spark, d)
    return G.expand(e, _seeds(e)).select("query_id", "node", F.col("distance").cast("bigint").alias("distance"), "role")


ROLES_SQL = f"""WITH {EDGES_SQL}, {SEEDS_SQL}, r AS (SELECT query_id, dst AS node, 0 AS way FROM seeds JOIN edges ON src = node UNION ALL SELECT query_id, src, 1 FROM seeds JOIN edges ON dst = node),
f AS (SELECT query_id, node, min(way) AS way FROM r WHERE query_id <> node GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way, node) AS k FROM f)
SELECT query_id, node, 1::BIGINT AS distance, CASE way WHEN 0 THEN 'dependency' ELSE 'dependent' END AS role FROM n WHERE k <= 12"""


def shortest_chains(spark, d):
    e = part_edges(spark, d)
    c = G.shortest_chain(e, _seeds(e), 2)
    return c.select("query_id", "node", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


CHAINS_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {SEEDS_SQL}, walk AS (SELECT query_id, node, [node] AS chain FROM seeds UNION ALL
  SELECT w.query_id, e.dst, list_append(w.chain, e.dst) FROM walk w JOIN edges e ON e.src = w.node WHERE len(w.chain) < 3),
best AS (SELECT query_id, node, chain, row_number() OVER (PARTITION BY query_id, node ORDER BY len(chain), chain) AS k FROM walk)
SELECT query_id, node, array_to_string(chain, '>') AS chain FROM best WHERE k = 1"""


def direct_dependents_semi(spark, d):
    """Customers' nations that buy a part's brand and also its supplier's nation: edges on both tables."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    bought = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("l_suppkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("src"), F.col("s_suppkey").alias("dst"))
    return G.direct_dependents(bought, s)


def longest_prefix_join(spark, d):
    """Names of parts as dotted modules, resolved to the deepest known prefix."""
    dotted = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    names = table(spark, d, "part").select(F.concat(dotted, F.lit(".v"), F.col("p_size").cast("string")).alias("name"))
    known = table(spark, d, "part").select(F.explode(F.array(F.substring_index(dotted, ".", 2), F.substring_index(dotted, ".", 1))).alias("key")).distinct().withColumn("value", F.concat(F.replace("key", F.lit("."), F.lit("/")), F.lit(".py")))
    return G.longest_prefix(names, known)


PREFIX_SQL = """WITH n AS (SELECT DISTINCT replace(p_name, ' ', '.') || '.v' || p_size::VARCHAR AS name FROM part),
k AS (SELECT DISTINCT unnest([array_to_string(string_split(p_name, ' ')[:2], '.'), string_split(p_name, ' ')[1]]) AS key FROM part)
SELECT name, arg_max(key, length(key)) AS target, replace(arg_max(key, length(key)), '.', '/') || '.py' AS value FROM n JOIN k ON name = key OR starts_with(name, key || '.') GROUP BY name"""


def arch_nodes(spark, d):
    return A.nodes(_tree(spark, d))


def _tree(spark, d):
    """Region, nation and segment folders with a customer file each."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.concat_ws("/", "r_name", "n_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py"))).alias("path"), "c_custkey")


TREE_SQL = """tree AS (SELECT concat_ws('/', r_name, n_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'c' || c_custkey::VARCHAR || '.py') AS path, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pk AS (SELECT path, array_to_string(string_split(path, '/')[:-2], '/') AS package, replace(left(path, length(path) - 3), '/', '.') AS module FROM tree)"""


def containment_tree(spark, d):
    return A.containment(_tree(spark, d))


CONTAIN_SQL = f"""WITH {TREE_SQL}, ps AS (SELECT DISTINCT package FROM pk),
near AS (SELECT c.package AS id, coalesce(arg_max(p.package, length(p.package)), '.') AS parent FROM ps c LEFT JOIN ps p ON starts_with(c.package, p.package || '/') GROUP BY c.package)
SELECT 'package' AS parent_kind, package AS parent, 'file' AS kind, path AS id FROM pk UNION ALL SELECT 'file', path, 'module', module FROM pk UNION ALL SELECT 'package', parent, 'package', id FROM near"""


def arch_statistics(spark, d):
    return A.statistics(A.containment(_tree(spark, d)))


def package_edges(spark, d):
    """Trade between nations, lifted to regions."""
    owner = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return A.lifted_edges(nation_edges(spark, d), owner)


def _file_edges(spark, d):
    """Customers whose orders follow each other by key: edges between files."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    f = _tree(spark, d)
    a = f.select(F.col("c_custkey").alias("o_custkey"), F.col("path").alias("src"))
    b = f.select(F.col("c_custkey").alias("k2"), F.col("path").alias("dst"))
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("k2"))
    return G.edge_table(o.join(nxt, "o_orderkey").join(a, "o_custkey").join(b, "k2"))


FILE_EDGES_SQL = """fe AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 1 JOIN tree a ON a.c_custkey = o.o_custkey JOIN tree b ON b.c_custkey = p.o_custkey WHERE a.path <> b.path)"""


def subsystem_projection(spark, d):
    s = A.subsystems(_tree(spark, d), _file_edges(spark, d))
    return s.select("subsystem", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("packages", "files", "modules", "entry_files")], F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


SUBSYSTEM_SQL = f"""WITH {TREE_SQL}, {FILE_EDGES_SQL}, x AS (SELECT string_split(src, '/')[1] AS a, string_split(dst, '/')[1] AS b, dst FROM fe),
base AS (SELECT string_split(path, '/')[1] AS subsystem, count(DISTINCT package) AS n_packages, count(DISTINCT path) AS n_files, count(DISTINCT module) AS n_modules FROM pk GROUP BY ALL),
o AS (SELECT a AS subsystem, string_agg(DISTINCT b, ',' ORDER BY b) AS dependencies FROM x WHERE a <> b GROUP BY ALL), i AS (SELECT b AS subsystem, string_agg(DISTINCT a, ',' ORDER BY a) AS dependents, count(DISTINCT dst) AS n_entry_files FROM x WHERE a <> b GROUP BY ALL)
SELECT subsystem, n_packages, n_files, n_modules, coalesce(n_entry_files, 0) AS n_entry_files, coalesce(dependencies, '') AS dependencies, coalesce(dependents, '') AS dependents FROM base LEFT JOIN o USING (subsystem) LEFT JOIN i USING (subsystem)"""


def package_layers(spark, d):
    """Layers of an acyclic graph: packages depend on those of smaller names only."""
    e = _file_edges(spark, d).where(A.package_of(F.col("src")) > A.package_of(F.col("dst")))
    return A.package_layers(_tree(spark, d), e).select(F.col("group").alias("subsystem"), F.col("node").alias("package"), F.col("layer").cast("bigint").alias("layer"))


LAYERS_SQL = f"""WITH RECURSIVE {TREE_SQL}, {FILE_EDGES_SQL}, pe AS (SELECT DISTINCT a.package AS src, b.package AS dst FROM fe JOIN pk a ON a.path = fe.src JOIN pk b ON b.path = fe.dst WHERE a.package > b.package AND string_split(fe.src, '/')[1] = string_split(fe.dst, '/')[1]),
up AS (SELECT DISTINCT package AS node, 0 AS layer FROM pk UNION SELECT pe.src, up.layer + 1 FROM up JOIN pe ON pe.dst = up.node)
SELECT string_split(node, '/')[1] AS subsystem, node AS package, max(layer)::BIGINT AS layer FROM up GROUP BY ALL"""


#: An order of lines that tells rows apart which share order, line number and part.
_SEQ = "CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS DECIMAL(20, 0)) * 10000000000 + l_suppkey * 10 + (ascii(l_returnflag) % 5) * 2 + ascii(l_linestatus) % 2"


def _relations(spark, d):
    """Relations between orders' customers and parts, several per pair."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    kinds = F.array(*[F.lit(k) for k in I.PRIORITY])
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("target"), F.expr(_SEQ).cast("decimal(38,0)").alias("seq"), (F.col("l_partkey") % 40).cast("string").alias("path"),
        F.element_at(kinds, (F.col("l_suppkey") % 10 + 1).cast("int")).alias("relationship"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason"),
        F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("evidence"), (F.col("l_linenumber") % 4).cast("int").alias("depth"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string"))).alias("symbol"),
    )


_KINDS = ", ".join(f"'{k}'" for k in I.PRIORITY)
_PRIO = "CASE relationship " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.PRIORITY.items()) + " END"
_BUCK = "CASE relationship " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.BUCKET.items()) + " END"
RELATIONS_SQL = f"""rel AS (SELECT o_custkey AS target, ({_SEQ})::HUGEINT AS seq, (l_partkey % 40)::VARCHAR AS path, [{_KINDS}][(l_suppkey % 10 + 1)] AS relationship, 'line ' || l_linenumber::VARCHAR AS reason,
  l_returnflag AS e1, l_linestatus AS e2, l_linenumber % 4 AS depth, CASE WHEN l_linenumber > 2 THEN 's' || (l_partkey % 3)::VARCHAR END AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ev AS (SELECT target, path, string_agg(e, ' ' ORDER BY s) AS evidence FROM (SELECT target, path, e, min(s) AS s FROM (SELECT target, path, e1 AS e, seq * 2 AS s FROM rel UNION ALL SELECT target, path, e2, seq * 2 + 1 FROM rel) GROUP BY ALL) GROUP BY ALL),
pick AS (SELECT *, row_number() OVER (PARTITION BY target, path ORDER BY {_PRIO} DESC, seq) AS k FROM rel),
firsts AS (SELECT target, path, arg_min(symbol, seq) FILTER (symbol IS NOT NULL) AS symbol, coalesce(arg_min(depth, seq) FILTER (depth <> 0), 0) AS depth FROM rel GROUP BY ALL),
items AS (SELECT p.target, p.path, p.relationship, p.reason, ev.evidence, f.symbol, f.depth FROM pick p JOIN ev USING (target, path) JOIN firsts f USING (target, path) WHERE k = 1)"""


def merge_priority(spark, d):
    m = I.ordered_items(I.merge_items(_relations(spark, d)))
    return m.select("target", "path", "relationship", "reason", F.array_join("evidence", " ").alias("evidence"), "symbol", F.col("depth").cast("bigint").alias("depth"), I.item_risk(F.col("relationship"), F.col("symbol").isNotNull()).alias("risk"), F.col("position").cast("bigint").alias("position"))


_RISK = "CASE WHEN relationship = 'api_consumer' AND symbol IS NOT NULL THEN 'high' ELSE CASE relationship " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.ITEM_RISK.items()) + " END END"
MERGE_SQL = f"WITH {RELATIONS_SQL} SELECT target, path, relationship, reason, evidence, symbol, depth::BIGINT AS depth, {_RISK} AS risk, row_number() OVER (PARTITION BY target ORDER BY {_BUCK}, depth, path) AS position FROM items"


def impact_summary_pivot(spark, d):
    return I.impact_summary(I.merge_items(_relations(spark, d)))


_COUNTS = ", ".join(f"count(*) FILTER (relationship = '{r}') AS {n}" for r, n in I.COUNTED.items())


def impact_risk(spark, d):
    items = I.merge_items(_relations(spark, d))
    summary = I.impact_summary(items)
    extra = items.groupBy("target").agg(F.max("depth").alias("max_depth_reached"), F.max(F.col("symbol").isNotNull()).alias("exported"))
    return I.overall_risk(summary.join(extra, "target")).select("target", "points", "risk")


RISK_SQL = f"""WITH {RELATIONS_SQL}, s AS (SELECT target, {_COUNTS}, max(depth) AS md, bool_or(symbol IS NOT NULL) AS ex FROM items GROUP BY target),
p AS (SELECT target, least(direct_dependents, 5) * 2 + least(indirect_dependents, 3) + least(tests, 2) + CASE WHEN api_consumers > 0 THEN 2 ELSE 0 END + CASE WHEN ex THEN 1 ELSE 0 END + CASE WHEN md >= 3 THEN 1 ELSE 0 END AS points FROM s)
SELECT target, points::BIGINT AS points, CASE WHEN points >= 8 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS risk FROM p"""


def surface_merge(spark, d):
    """Items of one (path, direction, relationship) merged: the nearest gives the reason."""
    r = _relations(spark, d).withColumn("direction", F.when(F.col("seq") % 2 == 0, "incoming").otherwise("outgoing")).withColumn("source", F.col("target").cast("string"))
    m = I.merge_surface(r)
    return m.select("path", "direction", "relationship", F.col("depth").cast("bigint").alias("depth"), "reason", "source", F.array_join("evidence", " ").alias("evidence"))


SURFACE_SQL = f"""WITH {RELATIONS_SQL}, s AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction FROM rel),
e AS (SELECT path, direction, relationship, string_agg(DISTINCT e, ' ' ORDER BY e) AS evidence FROM (SELECT path, direction, relationship, unnest([e1, e2]) AS e FROM s) GROUP BY ALL),
m AS (SELECT path, direction, relationship, depth, reason, target::VARCHAR AS source, row_number() OVER (PARTITION BY path, direction, relationship ORDER BY depth, seq) AS k FROM s)
SELECT path, direction, relationship, depth::BIGINT AS depth, reason, source, evidence FROM m JOIN e USING (path, direction, relationship) WHERE k = 1"""


def surface_summary(spark, d):
    r = _relations(spark, d).withColumn("direction", F.when(F.col("seq") % 2 == 0, "incoming").otherwise("outgoing"))
    return I.surface_summary(r)


SUMMARY_SQL = f"WITH {RELATIONS_SQL}, s AS (SELECT relationship, CASE WHEN seq % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction, CASE WHEN depth <= 1 THEN 'direct' ELSE 'transitive' END AS depth_class FROM rel) SELECT relationship, direction, depth_class, count(*) AS items FROM s GROUP BY GROUPING SETS ((relationship), (direction), (depth_class))"


def top_dependents(spark, d):
    """The three most used sources of each part: a capped window."""
    e = part_edges(spark, d)
    w = Window.partitionBy("dst").orderBy("src")
    return e.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3")


QUERIES = {f.__name__: f for f in (
    edge_build, degree_in_out, neighbours_of_node, bfs_depth2, reverse_reach4, reach_both_ways, reach_cycles, bfs_multi_seed_roles, shortest_chains, direct_dependents_semi, longest_prefix_join,
    arch_nodes, containment_tree, arch_statistics, package_edges, subsystem_projection, package_layers, merge_priority, impact_summary_pivot, impact_risk, surface_merge, surface_summary, top_dependents)}
ORACLE_SQL = {
    "edge_build": f"WITH {EDGES_SQL} SELECT src, dst FROM edges",
    "degree_in_out": f"WITH {EDGES_SQL} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node",
    "neighbours_of_node": f"WITH {EDGES_SQL} SELECT DISTINCT dst AS node, 'out' AS way FROM edges WHERE src = (SELECT min(src) FROM edges) UNION ALL SELECT DISTINCT src, 'in' FROM edges WHERE dst = (SELECT min(dst) FROM edges)",
    "bfs_depth2": _reach_sql(_FWD, 2),
    "reverse_reach4": _reach_sql(_REV, 4),
    "reach_both_ways": _reach_sql(f"{_FWD} UNION {_REV}", 2),
    "reach_cycles": CYCLES_SQL,
    "bfs_multi_seed_roles": ROLES_SQL,
    "shortest_chains": CHAINS_SQL,
    "direct_dependents_semi": "SELECT DISTINCT c_nationkey::BIGINT AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey = c_nationkey)",
    "longest_prefix_join": PREFIX_SQL,
    "arch_nodes": f"WITH {TREE_SQL} SELECT DISTINCT 'file' AS kind, path AS id FROM pk UNION SELECT 'module', module FROM pk UNION SELECT 'package', package FROM pk UNION SELECT 'package', '.'",
    "containment_tree": CONTAIN_SQL,
    "arch_statistics": f"SELECT parent_kind, kind, count(*) AS edges, count(DISTINCT parent) AS parents, count(DISTINCT id) AS children FROM ({CONTAIN_SQL}) GROUP BY ALL",
    "package_edges": f"WITH {TRADE_SQL} SELECT a.n_regionkey AS src, b.n_regionkey AS dst, count(*) AS weight FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL",
    "subsystem_projection": SUBSYSTEM_SQL,
    "package_layers": LAYERS_SQL,
    "merge_priority": MERGE_SQL,
    "impact_summary_pivot": f"WITH {RELATIONS_SQL} SELECT target, {_COUNTS} FROM items GROUP BY target",
    "impact_risk": RISK_SQL,
    "surface_merge": SURFACE_SQL,
    "surface_summary": SUMMARY_SQL,
    "top_dependents": f"WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM edges) SELECT src, dst, rank FROM r WHERE rank <= 3",
}
