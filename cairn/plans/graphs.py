"""Queries on graphs: components, taint, reach, paths, cycles and distance; and the cross product of dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import joins as J
from cairn.operators import windows as W
from cairn.plans.base import table
from cairn.plans.joins import _RUNS


def _docs(s, d):
    return table(s, d, "documents")


def _copies(s, d):
    """Edges from each record to the first one with the same text."""
    coded = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha"))
    first = coded.groupBy("sha").agg(F.min("doc_id").alias("src"))
    return coded.join(first, "sha").where("src <> doc_id").select("src", F.col("doc_id").alias("dst"))


def exact_dup_families(s, d):
    """Families of records with the same text: a star needs no search, one aggregate by digest answers it."""
    return _docs(s, d).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("component"), F.count("*").alias("members")).where("members > 1").select("component", "members")


def g_components_blob(s, d):
    """Families of records with the same text, with a representative in hash order and the strata that they cross."""
    each = _docs(s, d).select(F.sha2("text", 256).alias("sha"), "doc_id", "lang", "source", W.hash_rank("blob", "doc_id").alias("rank"))
    fam = each.groupBy("sha").agg(F.min("doc_id").alias("component"), F.min(F.struct("rank", "doc_id"))["doc_id"].alias("representative"), F.count("*").alias("members"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))
    return fam.where("members > 1").drop("sha")


def g_components_mixed(s, d):
    """Families joined by equal texts or by a shared first line of 20 characters or more."""
    line = _docs(s, d).select("doc_id", F.substring_index("text", "\n", 1).alias("line")).where("length(line) >= 20")
    first = line.groupBy("line").agg(F.min("doc_id").alias("src"))
    by_line = line.join(first, "line").where("src <> doc_id").select("src", F.col("doc_id").alias("dst"))
    return G.connected_components(_copies(s, d).unionByName(by_line)).select("node", "component")


def near_copy_components(s, d):
    from cairn.plans.joins import near_copies

    pairs, members = near_copies(s, d)
    links = pairs.select("a", "b").unionByName(members.select("a", F.col("id").alias("b")))
    comps = G.connected_components(links, "a", "b")
    nodes = _docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("exposed"))
    return G.tainted(nodes, comps, "doc_id", "exposed").groupBy("status").agg(F.count("*").alias("n"))


def _words(text):
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


# Bytes of short items that contained() compares with every document.
SHORT = 1 << 20


def contained(docs, benchmark):
    """(doc_id, item_id) of the documents that hold an item's whole text.

    Looked up are the words 2 to 7 of an item, its last word left out: whatever stands around the item,
    these are words of the document too, by their 64-bit codes. An item of under three words has none: all such items,
    SHORT bytes at most or ValueError, are sought in every document.
    """
    items = benchmark.where("text is not null").select("item_id", F.col("text").alias("item"), _words("text").alias("v"))
    inner = F.slice("v", 2, F.least(F.lit(6), F.size("v") - 2))
    long = items.where("size(v) >= 3").select("item_id", "item", F.xxhash64(inner).alias("head"), F.size(inner).alias("n"))
    sizes = sorted(r["n"] for r in long.select("n").distinct().collect())  # six at most
    every = docs.where("text is not null").select("doc_id", "text")
    few = items.where("size(v) < 3").select("item_id", "item")
    if (few.agg(F.sum(F.octet_length("item") + 32)).first()[0] or 0) > SHORT:
        raise ValueError(f"items of under three words have more than {SHORT} bytes")
    short = every.join(F.broadcast(few), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    if not sizes:
        return short.distinct()
    heads = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(k))))
    none = F.expr("cast(array() as array<bigint>)")
    pieces = every.select("doc_id", _words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*[F.when(F.size("w") >= k, heads(k)).otherwise(none) for k in sizes]))).alias("head"))
    pairs = pieces.join(long, "head").select(F.col("doc_id").alias("of"), "item_id", "item").distinct()
    found = every.join(pairs, F.col("doc_id").eqNullSafe(F.col("of"))).where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    return found.unionByName(short).distinct()


def contamination(s, d):
    """Records that hold the whole text of a benchmark item."""
    return contained(_docs(s, d), table(s, d, "benchmark"))


def _edges(s, d):
    """A graph of parts: each leads to two parts with larger keys."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("src"))
    n = table(s, d, "part").count()
    step = p.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 3 + 1)).alias("dst"))
    return step.where(F.col("dst") <= n)


def reach(s, d):
    return G.distances(_edges(s, d), s.range(1, 2)).select("node")


def g_distance(s, d):
    return G.distances(_edges(s, d), s.range(1, 3))


def deep_edges(s, d):
    """The edges above and a chain through the first parts, so that the longest path has more than 12 edges."""
    p = table(s, d, "part").where("p_partkey < 10").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return _edges(s, d).where("src > 0").unionByName(p.where("src > 0")).distinct()


def targets(s, *nodes):
    return s.createDataFrame([(n,) for n in nodes], "t long")


def multiples(s, d, of):
    return table(s, d, "part").where(F.col("p_partkey") % of == 0).select("p_partkey")


def shown(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def paths(s, d):
    found = G.simple_paths(deep_edges(s, d), s.range(1, 2), targets(s, 40, 60, 94))
    return found.select(shown("path").alias("path"), "length")


def g_first_paths(s, d):
    """The three shortest paths to each target."""
    found = G.first_paths(deep_edges(s, d), s.range(1, 2), targets(s, 40, 60, 94, 148), 3)
    return found.select(F.col("node").alias("target"), "rank", shown("path").alias("path"))


def g_audit(s, d):
    """How many paths lead to each target, and how many of them hold no multiple of 7."""
    found = G.path_counts(deep_edges(s, d), s.range(1, 2), targets(s, 40, 60, 94, 148), multiples(s, d, 7))
    return found.select(F.col("node").alias("target"), F.col("paths").cast("long").alias("paths"), (F.col("paths") - F.col("mediated")).cast("long").alias("unmediated"))


def cycle(s, d):
    """Nations that lie on a cycle or between cycles, where each leads to the nation numbered by three times its key and one."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    return G.on_cycles(n.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst")).unionByName(n.where("src % 4 = 0").select("src", (F.col("src") * 2).alias("dst"))))


def g_validate(s, d):
    """Lines as edges from order to part: orders and parts that are not there, loops and repeated edges."""
    nodes = table(s, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("node"))
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_linenumber") == 7, F.col("l_orderkey")).otherwise(F.col("l_partkey") % 500).alias("dst"))
    return G.invalid_edges(nodes, edges).groupBy("reason").agg(F.count("*").alias("n"))


def g_reach_required(s, d):
    near = G.distances(_edges(s, d), s.range(1, 2)).select("node")
    return table(s, d, "part").select(F.col("p_partkey").alias("node")).join(near, "node", "left_anti")


def matrix_cross(s, d):
    """Regions x order priorities x flags with the reason for which a combination is left out."""
    r = table(s, d, "region").select("r_name")
    p = table(s, d, "orders").select("o_orderpriority").distinct()
    f = table(s, d, "lineitem").select("l_returnflag").distinct()
    reason = J.first_reason([((F.col("r_name") == "ASIA") & (F.col("l_returnflag") == "A"), "unsupported"), (F.col("o_orderpriority").startswith("5") & (F.col("l_returnflag") != "N"), "low")])
    return r.crossJoin(p).crossJoin(f).withColumn("reason", reason)


QUERIES = {f.__name__: f for f in (exact_dup_families, g_components_blob, g_components_mixed, near_copy_components, contamination, reach, g_distance, paths, g_first_paths, g_audit, cycle, g_validate, g_reach_required, matrix_cross)}

_EDGES = "edges AS (SELECT p_partkey AS src, p_partkey*2 AS dst FROM part WHERE p_partkey*2<=(SELECT count(*) FROM part) UNION ALL SELECT p_partkey, p_partkey*3+1 FROM part WHERE p_partkey*3+1<=(SELECT count(*) FROM part))"
_DEEP = _EDGES.replace("edges AS", "edges0 AS", 1) + ", edges AS (SELECT src, dst FROM edges0 UNION SELECT p_partkey, p_partkey+1 FROM part WHERE p_partkey<10)"
_PATHS = _DEEP + ", p AS (SELECT [1::BIGINT] AS path UNION ALL SELECT list_append(path, dst) FROM p JOIN edges ON path[-1]=src AND NOT list_contains(path,dst))"
_STARS = """t AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS line FROM documents),
e0 AS (SELECT DISTINCT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM t UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY line) FROM t WHERE length(line)>=20), e AS (SELECT a, b FROM e0 WHERE a<>b UNION SELECT b, a FROM e0 WHERE a<>b),
r AS (SELECT DISTINCT a AS node, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a=r.node)"""
_REACH = "SELECT node, min(low) AS component FROM r GROUP BY 1"
_NEAR = _RUNS.replace("WITH w", "WITH RECURSIVE w", 1) + """, g AS (SELECT a AS doc_id, n, unnest(t) AS run FROM u), p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n)+any_value(y.n) AS n, count(*) AS common FROM g x JOIN g y ON x.run=y.run AND x.doc_id<y.doc_id GROUP BY x.doc_id, y.doc_id),
pairs AS (SELECT a, b FROM p WHERE common*100>=90*(n-common) UNION ALL SELECT a, doc_id FROM k WHERE doc_id<>a)"""
SQL = {
    "exact_dup_families": "SELECT min(doc_id) AS component, count(*) AS members FROM documents GROUP BY text HAVING count(*)>1",
    "contamination": "SELECT d.doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "reach": f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN edges ON src=node) SELECT node FROM r",
    "g_distance": f"WITH RECURSIVE {_EDGES}, r AS (SELECT unnest([1::BIGINT,2]) AS node, 0 AS depth UNION SELECT dst, depth+1 FROM r JOIN edges ON src=node WHERE depth<20) SELECT node, min(depth) AS depth FROM r GROUP BY 1",
    "paths": f"WITH RECURSIVE {_PATHS} SELECT array_to_string(path,'>') AS path, len(path)-1 AS length FROM p WHERE path[-1] IN (40,60,94)",
    "g_first_paths": f"WITH RECURSIVE {_PATHS} SELECT target, rank, array_to_string(path,'>') AS path FROM (SELECT path[-1] AS target, path, row_number() OVER (PARTITION BY path[-1] ORDER BY len(path), path)::INTEGER AS rank FROM p WHERE path[-1] IN (40,60,94,148)) WHERE rank<=3",
    "g_audit": f"WITH RECURSIVE {_PATHS} SELECT path[-1] AS target, count(*) AS paths, count(*) FILTER (len(list_filter(path, lambda x: x%7=0))=0) AS unmediated FROM p WHERE path[-1] IN (40,60,94,148) GROUP BY 1",
    "g_components_blob": "SELECT min(doc_id) AS component, arg_min(doc_id, sha256('blob'||chr(0)||doc_id::VARCHAR)) AS representative, count(*) AS members, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(*)>1",
    # on a cycle or between two: what a node of a cycle reaches and what reaches one
    "cycle": "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey*3+1)%25 AS dst FROM nation UNION SELECT n_nationkey, n_nationkey*2 FROM nation WHERE n_nationkey%4=0), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst=e.src), c AS (SELECT src AS node FROM r WHERE src=dst) SELECT node FROM (SELECT DISTINCT src AS node FROM r WHERE dst IN (SELECT node FROM c)) WHERE node IN (SELECT dst FROM r WHERE src IN (SELECT node FROM c))",
    "g_validate": "WITH n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey%10<>3), e AS (SELECT src, dst, count(*) AS k FROM (SELECT l_orderkey AS src, CASE WHEN l_linenumber=7 THEN l_orderkey ELSE l_partkey%500 END AS dst FROM lineitem) GROUP BY 1,2), j AS (SELECT CASE WHEN src NOT IN (SELECT id FROM n) THEN 'dangling_source' WHEN dst NOT IN (SELECT id FROM n) THEN 'dangling_target' WHEN src=dst THEN 'loop' WHEN k>1 THEN 'repeated' END AS reason FROM e) SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1",
    "g_components_mixed": f"WITH RECURSIVE {_STARS}, c AS ({_REACH}) SELECT node, component FROM c",
    "near_copy_components": f"""{_NEAR}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT DISTINCT a AS node, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a=r.node), c AS (SELECT node, min(low) AS component FROM r GROUP BY 1),
m AS (SELECT d.doc_id, coalesce(component, d.doc_id) AS component, coalesce(toxic=1, false) AS exposed FROM documents d LEFT JOIN c ON node=d.doc_id LEFT JOIN labels l ON l.doc_id=d.doc_id), y AS (SELECT *, bool_or(exposed) OVER (PARTITION BY component) AS any_exposed FROM m)
SELECT CASE WHEN exposed THEN 'exposed' WHEN any_exposed THEN 'related' ELSE 'clean' END AS status, count(*) AS n FROM y GROUP BY 1""",
    "g_reach_required": f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN edges ON src=node) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)",
    "matrix_cross": "SELECT r_name, o_orderpriority, l_returnflag, CASE WHEN r_name='ASIA' AND l_returnflag='A' THEN 'unsupported' WHEN starts_with(o_orderpriority,'5') AND l_returnflag<>'N' THEN 'low' END AS reason FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem)",
}
