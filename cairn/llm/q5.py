"""op5_jaccard: groups of documents linked by three-word shingles at a Jaccard similarity of 0.9 or more."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.jaccard_rtree import classes


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=3, percent=90)


ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x<>'') AS t FROM documents),
q AS (SELECT doc_id, CASE WHEN len(t)>=3 THEN list_distinct(list_transform(range(1, len(t)-1), lambda i: t[i]||' '||t[i+1]||' '||t[i+2])) WHEN len(t)>0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM w),
r AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM q), p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n)+any_value(y.n) AS n, count(*) AS c FROM r x JOIN r y ON x.g=y.g AND x.doc_id<y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p WHERE 100*c>=90*(n-c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS node, a AS low FROM e UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a=reach.node), k AS (SELECT node, min(low) AS low FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, coalesce(low, doc_id) AS component_id FROM q LEFT JOIN k ON node=doc_id"""
