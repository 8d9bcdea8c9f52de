"""Queries over Python sources written from the parts table, one module per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import calls as K
from corpusloom.operators import code as C
from corpusloom.operators import imports as M
from corpusloom.operators import semantic
from corpusloom.plans.bind import table

TEMPLATE = (
    "import os\nimport pkg{b}.mod{k2}\nfrom pkg{a}.mod{k1} import func{k1} as nxt\n\n"
    "class Cls{k}:\n    def run(self, x: int):\n        return nxt(x)\n\n"
    "def func{k}(a):\n    c = Cls{k}()\n    c.run(a)\n    return nxt(a) + os.path.getsize(a)\n"
)


def _files(spark, d):
    k = F.col("p_partkey")
    values = {"a": (k + 1) % 10, "b": (k + 2) % 10, "k1": k + 1, "k2": k + 2, "k": k}
    source = F.lit(TEMPLATE)
    for name, v in values.items():
        source = F.replace(source, F.lit("{" + name + "}"), v.cast("string"))
    path = F.concat(F.lit("pkg"), (k % 10).cast("string"), F.lit("/mod"), k.cast("string"), F.lit(".py"))
    return table(spark, d, "part").select(path.alias("path"), source.alias("source"))


_P = "p AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 10)::VARCHAR || '/mod' || p_partkey::VARCHAR || '.py' AS path FROM part)"
_NEXT = "nx AS (SELECT p.k, p.path, a.path AS p1, b.path AS p2 FROM p LEFT JOIN p a ON a.k = p.k + 1 LEFT JOIN p b ON b.k = p.k + 2)"


def code_symbols(spark, d):
    s = C.rows_of(C.analyse(_files(spark, d)), "symbols")
    return s.select("path", "name", "kind", F.col("line").cast("bigint").alias("line"), F.coalesce("parent_class", F.lit("")).alias("parent_class"), F.array_join(F.transform("args", lambda a: a["name"]), ",").alias("args"))


def code_spans(spark, d):
    f = _files(spark, d)
    s = C.span_text(f, C.rows_of(C.analyse(f), "spans"))
    return s.select("path", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens")


def code_import_edges(spark, d):
    return M.import_edges(C.analyse(_files(spark, d)))


def code_call_edges(spark, d):
    e, _ = K.build(C.analyse(_files(spark, d)))
    n = lambda c: F.coalesce(c, F.lit(""))
    return e.select("kind", F.col("src.path").alias("src_path"), n(F.col("src.name")).alias("src_name"), F.col("dst.path").alias("dst_path"), n(F.col("dst.name")).alias("dst_name"), F.col("line").cast("bigint").alias("line"))


def code_unresolved(spark, d):
    _, u = K.build(C.analyse(_files(spark, d)))
    return u.select("path", F.coalesce("source_symbol", F.lit("")).alias("source_symbol"), "name", "reason", F.col("line").cast("bigint").alias("line"))


def code_references(spark, d):
    r = C.rows_of(C.analyse(_files(spark, d)), "refs")
    return r.groupBy("kind").agg(F.count("*").alias("refs"), F.count_distinct("path").alias("files"))


def document_composition(spark, d):
    """Digest of what is embedded of each module."""
    f = _files(spark, d)
    doc = semantic.document_text(C.document_parts(C.analyse(f), f))
    return doc.select("path", F.sha2("document", 256).alias("document_hash"))


def hashed_embeddings(spark, d):
    """Norm and filled places of each document's hashed bag of words."""
    docs = table(spark, d, "documents").select("doc_id", V.hashed_embedding(256)("text").alias("v"))
    return docs.select("doc_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).cast("bigint").alias("places"))


QUERIES = {f.__name__: f for f in (code_symbols, code_spans, code_import_edges, code_call_edges, code_unresolved, code_references, document_composition, hashed_embeddings)}
ORACLE_SQL = {
    "code_symbols": f"""WITH {_P} SELECT path, 'Cls' || k AS name, 'class' AS kind, 5::BIGINT AS line, '' AS parent_class, '' AS args FROM p UNION ALL
SELECT path, 'run', 'method', 6, 'Cls' || k, 'self,x' FROM p UNION ALL SELECT path, 'func' || k, 'function', 9, '', 'a' FROM p""",
    "code_spans": f"""WITH {_P}, c AS (SELECT path, k, length('class Cls' || k || ':') + 1 AS l1, length('    def run(self, x: int):') + 1 + length('        return nxt(x)') + 1 AS l2, length('def func' || k || '(a):') + 1 + length('    c = Cls' || k || '()') + 1 + length('    c.run(a)') + 1 + length('    return nxt(a) + os.path.getsize(a)') + 1 AS l3 FROM p)
SELECT path, 'Cls' || k AS name, 5::BIGINT AS start_line, 7::BIGINT AS end_line, ceil((l1 + l2) / 4.0)::BIGINT AS tokens FROM c UNION ALL SELECT path, 'run', 6, 7, ceil(l2 / 4.0)::BIGINT FROM c UNION ALL SELECT path, 'func' || k, 9, 12, ceil(l3 / 4.0)::BIGINT FROM c""",
    "code_import_edges": f"WITH {_P}, {_NEXT} SELECT path AS src, p1 AS dst FROM nx WHERE p1 IS NOT NULL UNION SELECT path, p2 FROM nx WHERE p2 IS NOT NULL",
    "code_call_edges": f"""WITH {_P}, {_NEXT} SELECT 'import' AS kind, path AS src_path, '' AS src_name, p2 AS dst_path, '' AS dst_name, 2::BIGINT AS line FROM nx WHERE p2 IS NOT NULL
UNION ALL SELECT 'import', path, '', p1, '', 3 FROM nx WHERE p1 IS NOT NULL UNION ALL SELECT 'reference', path, '', p1, 'func' || (k + 1), 3 FROM nx WHERE p1 IS NOT NULL
UNION ALL SELECT 'call', path, 'run', p1, 'func' || (k + 1), 7 FROM nx WHERE p1 IS NOT NULL UNION ALL SELECT 'instantiation', path, 'func' || k, path, 'Cls' || k, 10 FROM nx
UNION ALL SELECT 'method_call', path, 'func' || k, path, 'run', 11 FROM nx UNION ALL SELECT 'call', path, 'func' || k, p1, 'func' || (k + 1), 12 FROM nx WHERE p1 IS NOT NULL""",
    "code_unresolved": f"""WITH {_P}, {_NEXT} SELECT path, 'func' || k AS source_symbol, 'os.path.getsize' AS name, 'unresolved_module' AS reason, 12::BIGINT AS line FROM nx
UNION ALL SELECT path, 'func' || k, 'nxt', 'unresolved_name', 12 FROM nx WHERE p1 IS NULL UNION ALL SELECT path, 'Cls' || k || '.run', 'nxt', 'unresolved_name', 7 FROM nx WHERE p1 IS NULL""",
    "code_references": f"WITH {_P} SELECT 'call' AS kind, count(*) * 5 AS refs, count(*) AS files FROM p UNION ALL SELECT 'name', count(*) * 3, count(*) FROM p",
    "document_composition": f"""WITH {_P} SELECT path, sha256('path: ' || path || chr(10) || 'imports: os pkg' || (k + 2) % 10 || '.mod' || (k + 2) || ' pkg' || (k + 1) % 10 || '.mod' || (k + 1) || chr(10) || 'functions: func' || k || chr(10) || 'classes: Cls' || k || chr(10) || 'methods: run' || chr(10) || 'source: ' ||
  'import os' || chr(10) || 'import pkg' || (k + 2) % 10 || '.mod' || (k + 2) || chr(10) || 'from pkg' || (k + 1) % 10 || '.mod' || (k + 1) || ' import func' || (k + 1) || ' as nxt' || chr(10) || chr(10) || 'class Cls' || k || ':' || chr(10) || '    def run(self, x: int):' || chr(10) || '        return nxt(x)' || chr(10) || chr(10) ||
  'def func' || k || '(a):' || chr(10) || '    c = Cls' || k || '()' || chr(10) || '    c.run(a)' || chr(10) || '    return nxt(a) + os.path.getsize(a)' || chr(10)) AS document_hash FROM p""",
}
