"""The registered corpus queries: production parameters over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import shared_dir
from .decontamination import find_contamination
from .importance import resample
from .language_id import identify, train
from .language_model import score_documents
from .minhash import near_duplicates
from .mixture import mix
from .periodic_runs import digest, periodic_runs, plant
from .quality import classify
from .secrets import report, scan, train_models
from .suffix_dedup import remove_repeats
from .token_output import read_tokens, write_tokens
from .vector_dedup import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return report(scan(documents, train_models(documents)))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(plant(table(spark, sf_dir, "documents"))))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_minhash, op3_bpe, op4_language_id, op5_decontamination, op6_quality, op7_secrets, op8_language_model, op9_token_output, op10_vector_dedup, op11_periodic_runs, op12_mixture, op13_importance)}

_REACH = """reach AS (SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)"""

#: CRC-32 in SQL, four bits at a time; the table is the sixteen remainders of the polynomial.
_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_i] = _c
_DIGITS = "list_transform(range(0, 2 * strlen(f)), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(f), CAST(xor(i, 1) + 1 AS INT), 1)) - 1 AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_DIGITS}), lambda c, b: xor(c >> 4, {_NIBBLES}[(xor(c, b) & 15) + 1])), 4294967295)"

ORACLE_SQL = {
    "op2_minhash": rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.x = d.doc_id""",
    "op10_vector_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN degree d ON d.a = vec_id LEFT JOIN component c ON c.x = vec_id""",
    "op12_mixture": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
  -ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(t)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656)
  / greatest(0.1::DOUBLE, coalesce(length(regexp_replace(t, '\P{L}+', '', 'g')) / nullif(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0), 0)) AS key FROM d),
s AS (SELECT source, sum(size) AS total, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source),
o AS (SELECT *, (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(2 * total) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2 * total / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, total, least(CAST(2 * total AS DOUBLE), max(level) OVER () * w) AS target FROM o),
x AS (SELECT source, total, target, floor(target + 0.5) AS wanted, CASE WHEN total > 0 THEN floor(floor(target + 0.5) / total) ELSE 0 END AS whole FROM t),
g AS (SELECT k.doc_id, k.size, x.*, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS gone
  FROM k JOIN x ON k.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST(whole * size + least(greatest(wanted - whole * total - gone, 0), size) AS BIGINT) AS taken FROM g""",
    "op13_importance": rf"""WITH texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, doc_id, r, len(w) AS n, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
  || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
own AS (SELECT side, r, f, count(*) AS c FROM features GROUP BY ALL),
hashed AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM own)),
tally AS (SELECT bucket, sum(c) FILTER (side = 0) AS s, sum(c) FILTER (side = 1) AS t FROM own JOIN hashed USING (f) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS gain FROM tally),
weights AS (SELECT r, CAST(sum(c * gain) AS BIGINT) AS weight, CAST(sum(c) AS BIGINT) AS n_features FROM own JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id, weight) AS place, count(*) FILTER (may) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * eligible // 100 THEN place END AS rank FROM placed""",
}
