"""Queries over the driver's tables, one for each operator: whole tables, whole texts, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, byte_bpe, exact_dedup, filter_audit, language_id, line_dedup, mixing, phrases, sharding, simhash_dedup, substring_dedup, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_classes(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(_table(spark, sf_dir, "documents")).drop("raw_hash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe_encode(_table(spark, sf_dir, "documents"), ranks_path(), with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_simhash_dedup, op3_exact_dedup, op4_sharding, op5_bpe, op6_language_id, op7_ann, op8_mixing, op9_line_dedup, op10_toxicity, op11_filter_audit, op12_phrases, op13_byte_bpe, pipeline)
}

#: Lower-casing of A-Z only, as SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM docs, range(1, len(w) - 33) AS r(p) WHERE len(w) >= 35),
rep AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM rep, range(0, 35) AS r(i)),
kept AS (SELECT d.doc_id, x.p, d.w[x.p] AS word FROM docs d, range(1, len(d.w) + 1) AS x(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.p = x.p)),
txt AS (SELECT doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(t.k, 0))::BIGINT AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
FROM docs d LEFT JOIN txt t USING (doc_id)""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op11_filter_audit": r"""
WITH raw AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS lowest FROM raw),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > lowest)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, (SELECT b FROM f WHERE f.f = filter_order[step]) AS b,
  (SELECT coalesce(sum(b), 0)::INT FROM f WHERE contains(filter_order[1 : step - 1], f.f)) AS earlier FROM o, range(1, 6) AS r(step)),
z AS (SELECT part, filter_order, step, s.b, sum(CASE WHEN mask & (s.b | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & s.b <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & s.b <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = s.b THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & s.b <> 0 AND mask & earlier = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & s.b <> 0 AND mask & earlier = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley FROM z""",
    "op12_phrases": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten([list_transform(range(1, len(w) - s + 2), lambda i: w[i : i + s - 1]) for s in [1, 2, 3]])) AS g FROM w WHERE len(w) > 0),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
long AS (SELECT lang, a, unnest([g[1 : 2], g[2 : 3]]) AS g FROM f WHERE len(g) = 3),
most AS (SELECT lang, g, max(a) AS most FROM long GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.g = b.g WHERE most IS NULL OR 100 * most < 50 * b.a),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
