"""op2_lattice: near-duplicate vectors of the whole embeddings table."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.lattice_e8 import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


# All pairs: what an exact search would find. Vectors that hold nulls or non-finite components, or only zeros, are left out.
ORACLE_SQL = """WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(embedding, lambda x: x<>0))>0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id<>y.vec_id AND len(x.v)=len(y.v) WHERE list_cosine_similarity(x.v, y.v)>=0.9),
r AS (SELECT DISTINCT a AS node, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a=r.node), k AS (SELECT node, min(low) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id)=vec_id AS kept FROM embeddings LEFT JOIN k ON node=vec_id LEFT JOIN n ON a=vec_id"""
