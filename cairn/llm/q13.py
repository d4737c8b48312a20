"""op13_resampling: every document's score towards the benchmark's texts, and the ranks of the quarter that is drawn."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.position_ngrams import resample


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents").select("doc_id", "text"), read("benchmark").select("text"))


# crc32 by its definition, a table of the 256 bytes' remainders and one step a byte, over the different n-grams.
ORACLE_SQL = r"""WITH poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c%2=1 THEN xor(c>>1, 3988292384) ELSE c>>1 END)) AS tab),
w AS (SELECT 'd' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') AS t FROM documents
 UNION ALL SELECT 't', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') FROM benchmark),
g AS (SELECT side, doc_id, unnest(t) AS gram FROM w UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i]||' '||t[i+1])) FROM w WHERE len(t)>1),
x AS (SELECT gram, hex(encode(gram)) AS h FROM g GROUP BY 1),
b AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h)//2), lambda i: ('0x'||h[2*i+1:2*i+2])::BIGINT)), lambda c, v: xor(c>>8, tab[xor(c, v)%256+1])), 4294967295)%10000 AS bucket FROM x, poly),
f AS (SELECT side, doc_id, bucket FROM g JOIN b USING (gram)), n AS (SELECT bucket, count(*) FILTER (side='d') AS s, count(*) FILTER (side='t') AS t FROM f GROUP BY 1), z AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
k AS (SELECT bucket, floor(1000*ln((n.t+1)::DOUBLE*(z.s+10000)::DOUBLE/((n.s+1)::DOUBLE*(z.t+10000)::DOUBLE)))::BIGINT AS gain FROM n, z WHERE n.s>0),
m AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gain FROM f JOIN k USING (bucket) WHERE side='d' GROUP BY 1),
c AS (SELECT doc_id, len(t) AS words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features>0 THEN (gain-((gain%n_features)+n_features)%n_features)//n_features ELSE 0 END AS weight FROM w LEFT JOIN m USING (doc_id) WHERE side='d'),
y AS (SELECT *, weight+floor(-1000*ln(-ln((('0x'||sha256('7:'||doc_id)[1:8])::BIGINT+0.5::DOUBLE)/4294967296)))::BIGINT AS score FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE words>=20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place<=25*n//100 THEN place END AS rank FROM y LEFT JOIN r USING (doc_id)"""
