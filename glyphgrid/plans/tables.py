"""Queries of the text, answer, ranking, log and sampling families over the plain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation, metrics, sampling, selector
from .views import table

QUERIES, ORACLE = {}, {}

#: Words of a document's start without letters beyond ASCII, as a short text to work on (a feature of the test data, not a limit of the operators).
_PHRASES = "ph AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _phrases(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'sample') AS stem FROM pages")
def p1_safe_stem(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query(f"WITH {_PHRASES} SELECT a.item_id, b.item_id AS other, levenshtein(a.t, b.t)::BIGINT AS dist, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t), 1) AS ned, greatest(1 - levenshtein(a.t, b.t) / greatest(length(a.t), 1), 0.0) AS reward FROM ph a JOIN ph b ON b.item_id = a.item_id + 1")
def t2_edit_distances(spark, d):
    a = _phrases(spark, d)
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("t").alias("u"))
    return a.join(b, "item_id").select("item_id", "other", F.levenshtein("t", "u").cast("long").alias("dist"), T.ned(F.col("t"), F.col("u")).alias("ned"), T.pair_reward(F.col("t"), F.col("u")).alias("reward"))


@query("SELECT doc_id, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS plain FROM documents")
def t8_letters_and_digits(spark, d):
    return table(spark, d, "documents").select("doc_id", T.letters_and_digits(F.col("text")).alias("plain"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS plain, regexp_full_match(text, '[\\x20-\\x7E]{0,25}') AS short FROM documents")
def t14_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ascii_only(F.col("text")).alias("plain"), T.printable_and_short(F.col("text")).alias("short"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 13 THEN substr(p_name, 1, 11) || '..' ELSE p_name END AS short, CASE WHEN lower(substr(p_type, 1, 1)) IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || p_type AS article, lower(replace(replace(p_type, '_', ' '), '/', ' or ')) AS clean FROM part")
def t23_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.short_name(F.col("p_name")).alias("short"), T.with_article(F.col("p_type")).alias("article"), T.clean_name(F.col("p_type")).alias("clean"))


@query("SELECT conv_id, turn, CASE WHEN list_has_any(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END AS answer, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth FROM conversations")
def t17_yes_or_no(spark, d):
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.yes_or_no(F.col("text")).alias("answer"), F.row_number().over(w).cast("long").alias("nth"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN chr((65 + event_id % 5)::INT) WHEN 1 THEN chr((65 + event_id % 5)::INT) WHEN 2 THEN chr((65 + event_id % 5)::INT) ELSE 'FAILED' END AS letter FROM events")
def t18_choice_letter(spark, d):
    c = F.char(65 + F.col("event_id") % 5)
    k = F.col("event_id") % 4
    said = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(". because"))).when(k == 2, F.concat(F.lit("So. The answer is "), c, F.lit("."))).otherwise(F.concat(F.lit("The answer is A. The answer is "), c, F.lit(".")))
    return table(spark, d, "events").select("event_id", T.choice_letter(said).alias("letter"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 10)::DOUBLE ELSE -1.0 END AS first, CASE WHEN event_id % 3 = 0 THEN (event_id % 7)::DOUBLE ELSE -1.0 END AS second FROM events")
def t20_score_pair(spark, d):
    a, b = F.col("event_id") % 10, F.col("event_id") % 7
    said = F.when(F.col("event_id") % 3 == 0, F.concat(a.cast("string"), F.lit(","), b.cast("string"), F.lit("\nwell"))).when(F.col("event_id") % 3 == 1, F.lit("none given")).otherwise(F.concat(a.cast("string"), F.lit("\n1 2")))
    s = T.score_pair(said)
    return table(spark, d, "events").select("event_id", s[0].alias("first"), s[1].alias("second"))


@query("SELECT p_partkey, regexp_replace(substr(regexp_replace(p_name, '[^ -~]', '', 'g'), 1, 25), '', '') AS text FROM part")
def t6_codes_round_trip(spark, d):
    return table(spark, d, "part").select("p_partkey", T.decode_codes(T.encode_codes(F.col("p_name"), 26)).alias("text"))


@query("SELECT event_type, iteration, round(quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY iteration RANGE BETWEEN 19 PRECEDING AND CURRENT ROW), 8) AS median FROM (SELECT event_type, event_id AS iteration, value FROM events)")
def w10_rolling_median(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("event_id").alias("iteration"), "value")
    return curation.rolling_median(e, "event_type", "iteration", "value", 20).select("event_type", "iteration", F.round("median", 8).alias("median"))


@query("SELECT event_type, max_by(value, event_id) AS value FROM events GROUP BY 1")
def x1_latest_scalars(spark, d):
    return curation.latest(table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a31_confusion(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH m AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT DISTINCT quality AS cls FROM m UNION SELECT DISTINCT toxic FROM m),
s AS (SELECT cls, coalesce((SELECT sum(n) FROM m WHERE quality = cls AND toxic = cls), 0)::BIGINT AS tp, coalesce((SELECT sum(n) FROM m WHERE toxic = cls), 0)::BIGINT AS pos_gt, coalesce((SELECT sum(n) FROM m WHERE quality = cls), 0)::BIGINT AS pos_pred FROM c)
SELECT *, coalesce(tp::DOUBLE / nullif(pos_gt + pos_pred - tp, 0), 0.0) AS iou, coalesce(tp::DOUBLE / nullif(pos_gt, 0), 0.0) AS acc FROM s""")
def a32_class_iou(spark, d):
    return metrics.class_scores(metrics.confusion(table(spark, d, "labels"), "quality", "toxic"), "quality", "toxic")


@query("""SELECT source, tp, fp, tn, fn, coalesce(p, 0.0) AS precision, coalesce(r, 0.0) AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, (tp + fp)::DOUBLE / (tp + fp + tn + fn) AS yes_ratio FROM
(SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS r FROM (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1))""")
def a34_polarity(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.polarity(df, F.col("quality") == 1, F.col("toxic") == 1, "source")


@query("SELECT source, round(sum(CASE WHEN quality = 1 THEN cum / rank ELSE 0 END) / sum(quality), 9) AS ap FROM (SELECT source, quality, sum(quality) OVER w AS cum, row_number() OVER w AS rank FROM labels JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1 HAVING sum(quality) > 0")
def a41_tag_ap(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    df = sampling.running(df, ["source"], ["n_chars", "doc_id"], "quality", falling=True)
    ap = F.sum(F.when(F.col("quality") == 1, F.col("cum") / F.col("rank")).otherwise(0.0)) / F.sum("quality")
    return df.groupBy("source").agg(F.round(F.when(F.sum("quality") > 0, ap), 9).alias("ap")).where("ap is not null")


@query("""WITH r AS (SELECT source, quality AS tp, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, sum(quality) OVER (PARTITION BY source) AS pos FROM labels JOIN documents USING (doc_id)),
c AS (SELECT *, sum(tp) OVER (PARTITION BY source ORDER BY rank) AS cum FROM r), e AS (SELECT *, max(cum / rank) OVER (PARTITION BY source ORDER BY rank DESC) AS env FROM c)
SELECT source, round(sum(tp * env / pos), 8) AS ap FROM e WHERE pos > 0 GROUP BY 1""")
def a24_voc_ap(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    df = sampling.running(df, ["source"], ["n_chars", "doc_id"], "quality", falling=True)
    # The largest precision from a hit on: by number of hits, so from as few rows as a source has positives.
    cuts = df.where("cum > 0").groupBy("source", "cum").agg(F.max(F.col("cum") / F.col("rank")).alias("p"))
    best = cuts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("cum")).alias("neg"), "p"))).alias("c"), F.max("cum").alias("pos"))
    total = F.aggregate("c", F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("top")), lambda s, x: F.struct((s["sum"] + F.greatest(s["top"], x["p"])).alias("sum"), F.greatest(s["top"], x["p"]).alias("top")), lambda s: s["sum"])
    return best.select("source", F.round(total / F.col("pos"), 8).alias("ap"))


@query("SELECT coalesce(event_type, 'all') AS category, count(*) AS n, round(avg(value), 7) AS mean FROM events GROUP BY ROLLUP (event_type)")
def a40_category_means(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 7).alias("mean")).select(F.coalesce("event_type", F.lit("all")).alias("category"), "n", "mean")


@query("SELECT user_id, round((c * least(1.0::DOUBLE, (c - 1) / 3) + (n - c) * least(1.0::DOUBLE, c / 3)) / n, 9) AS score FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) AS n FROM events GROUP BY 1)")
def a35_consensus(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("answers"))
    return e.select("user_id", F.round(T.consensus_score(F.col("answers"), F.lit("click")), 9).alias("score"))


@query("SELECT source, avg((lang = 'en')::INT) AS accuracy, count(*) AS n, count(DISTINCT lang) AS languages FROM documents GROUP BY 1")
def a38_accuracy(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("int")).alias("accuracy"), F.count("*").alias("n"), F.countDistinct("lang").alias("languages"))


@query("SELECT DISTINCT lang AS word FROM documents UNION SELECT source FROM documents")
def a52_vocabulary(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("lang").alias("word")).unionByName(t.select(F.col("source").alias("word"))).distinct()


@query("SELECT l.doc_id, l.quality, coalesce(d.source, 'FAILED') AS source FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d USING (doc_id)")
def j17_failure_default(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", "source")
    return table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", "quality", F.coalesce("source", F.lit("FAILED")).alias("source"))


@query("SELECT l.doc_id, d.lang, b.item_id FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.doc_id")
def j18_three_way(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").join(b, "doc_id")


@query("SELECT a.rn AS line, a.item_id, b.page_id FROM (SELECT row_number() OVER (ORDER BY item_id) AS rn, item_id FROM benchmark) a JOIN (SELECT row_number() OVER (ORDER BY page_id) AS rn, page_id FROM pages) b USING (rn)")
def j19_positional(spark, d):
    number = lambda t, k: sampling.place_in_order(table(spark, d, t).select(k), [k]).select(k, (F.col("place") + 1).cast("long").alias("line"))
    return number("benchmark", "item_id").join(number("pages", "page_id"), "line")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j28_category_chain(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    places = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "r_name")


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS shard FROM orders")
def b4_contiguous_shards(spark, d):
    return sampling.contiguous_shards(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, source, doc_id FROM documents")
def b7_round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"]).select("turn", "source", "doc_id")


@query("SELECT conv_id, sum(length(regexp_replace(trim(text), '\\s+', ' ', 'g')) - length(replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ', '')) + 1)::BIGINT AS words FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def b11_words_per_conversation(spark, d):
    return table(spark, d, "conversations").where(F.trim("text") != "").groupBy("conv_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def a49_shard_usage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 100 AND 299")
def w13_chunk(spark, d):
    return sampling.rows_between(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100, 200)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1 - 137) % count(*) OVER () + count(*) OVER ()) % count(*) OVER () AS place FROM orders")
def w15_rotation(spark, d):
    o = sampling.place_in_order(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return o.select("o_orderkey", sampling.rotated(F.col("place"), F.col("total"), 137).cast("long").alias("place"))


@query("SELECT o_orderkey, s FROM orders, range(0, 2000, 60) t(s) WHERE s <= greatest(100 + o_orderkey % 500 - 128, 0) UNION SELECT o_orderkey, greatest(100 + o_orderkey % 500 - 128, 0) FROM orders")
def w9_patch_grid(spark, d):
    size = 100 + F.col("o_orderkey") % 500
    return table(spark, d, "orders").select("o_orderkey", F.explode(curation.patch_starts(size, 128, 60)).alias("s"))


@query("SELECT source, list_aggregate(list_sort(list(lang || ':' || doc_id)), 'string_agg', ',') AS entries FROM (SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2) GROUP BY 1")
def p7_nested(spark, d):
    n = curation.nested(table(spark, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id", "doc_id")
    return n.select("source", F.array_join(F.array_sort(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("entries"))


@query("SELECT doc_id FROM documents WHERE trim(text) = '' OR trim(text) IN ('N/A', 'unknown') OR contains(lower(text), 'licensed under') OR regexp_matches(text, '^[\"'']\\s*[\"'']$')")
def f1_invalid_text(spark, d):
    t = table(spark, d, "documents")
    return t.where(curation.invalid_text(F.col("text"), ("N/A", "unknown"), ("Licensed under",))).select("doc_id")


@query("SELECT r_regionkey AS cat, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a20_category_histogram(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("cat")).agg(F.count("*").alias("n"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("cat")).join(n, "cat", "left").na.fill(0, ["n"])


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus = 'F'")
def q5_scan_limit(spark, d):
    return selector.select(table(spark, d, "orders"), "o_orderstatus=F", ["o_orderkey"], 500).select("o_orderkey")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x_hourly_events(spark, d):
    """Extension: the batch form of the streaming window."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "total")
