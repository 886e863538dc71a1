"""Queries of text spotting over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, spotting
from .detection import _W, _iou
from .ranking import _COVER
from .registered import registrar
from .views import guesses, table, truth

QUERIES, ORACLE, query = registrar()

#: A lexicon of all parts, without a key: words of every length, most of them an edit or more from the recognised ones.
_LEXICON = "lex AS (SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'W' || (p_partkey * 37 % 1000) WHEN 1 THEN 'x' || (p_partkey * 11 % 700) || '-' ELSE p_name END AS word FROM part), low AS (SELECT upper(word) AS u, min(ord) AS ord, arg_min(word, ord) AS word FROM lex GROUP BY 1)"
_SEEN = "CASE WHEN gi % 5 = 0 THEN text || 'qq' || gi WHEN gi % 5 = 1 THEN 'v' || text ELSE text END"
_NEAREST = f"{_LEXICON}, seen AS (SELECT image_id, gi, text, {_SEEN} AS word FROM gt), d AS (SELECT DISTINCT upper(word) AS w FROM seen), one AS (SELECT w, arg_min(low.word, (levenshtein(u, w), ord)) AS match, min(levenshtein(u, w)) AS distance FROM d, low GROUP BY 1), near AS (SELECT image_id, gi, text, seen.word, match, distance FROM seen JOIN one ON w = upper(word))"


def _lexicon(spark, d):
    k = F.col("p_partkey")
    word = F.when(k % 3 == 0, F.concat(F.lit("W"), k * 37 % 1000)).when(k % 3 == 1, F.concat(F.lit("x"), k * 11 % 700, F.lit("-"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(k.alias("ord"), word.alias("word"))


def _nearest(spark, d, **options):
    g = F.col("gi") % 5
    seen = F.when(g == 0, F.concat("text", F.lit("qq"), "gi")).when(g == 1, F.concat(F.lit("v"), "text")).otherwise(F.col("text"))
    return spotting.nearest_word(truth(spark, d).select("image_id", "gi", "text", seen.alias("word")), _lexicon(spark, d), None, "word", **options)


@query(f"{_W}, {_NEAREST} SELECT image_id, gi, CASE WHEN distance < 2.5 THEN match END AS match, distance::INT AS distance FROM near")
def t10_nearest_word(spark, d):
    return _nearest(spark, d, keep_far=False).select("image_id", "gi", "match", "distance")


@query(f"{_W}, {_NEAREST}, j AS (SELECT near.text, p.text AS guess, match FROM near JOIN pred p ON p.image_id = near.image_id AND p.pi = near.gi), r AS (SELECT 'none' AS lexicon, text, guess AS refined FROM j UNION ALL SELECT 'full', text, lower(match) FROM j) SELECT lexicon, avg((text = refined)::INT) AS accuracy, sum(levenshtein(refined, text))::BIGINT AS edits FROM r GROUP BY 1")
def a44_by_lexicon(spark, d):
    side = guesses(spark, d).select("image_id", F.col("pi").alias("gi"), F.col("text").alias("guess"))
    return spotting.recognition_by_lexicon(_nearest(spark, d).join(side, ["image_id", "gi"]), "text", "guess", {"full": "match"})


_SPECIAL = spotting.SPECIAL_CHARACTERS.replace("'", "''")


@query(f"SELECT doc_id, k, w, regexp_replace(translate(regexp_replace(regexp_replace(w, '''[sS]$', ''), '^-+|-+$', '', 'g'), '{_SPECIAL}', '{' ' * len(spotting.SPECIAL_CHARACTERS)}'), '^\\s+|\\s+$', '', 'g') AS word FROM (SELECT doc_id, k, CASE k % 3 WHEN 0 THEN v || '''s' WHEN 1 THEN '--' || v || '-' ELSE '(' || v || ')!' END AS w FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^ -~]', '', 'g'), ' ')[:9]) AS v, generate_subscripts(string_split(text, ' ')[:9], 1) AS k FROM documents WHERE text IS NOT NULL))")
def t13_spotting_word(spark, d):
    words = F.slice(F.split(F.regexp_replace("text", "[^ -~]", ""), " "), 1, 9)
    own = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(words).alias("k", "v")).withColumn("k", (F.col("k") + 1).cast("long"))
    w = F.when(F.col("k") % 3 == 0, F.concat("v", F.lit("'s"))).when(F.col("k") % 3 == 1, F.concat(F.lit("--"), "v", F.lit("-"))).otherwise(F.concat(F.lit("("), "v", F.lit(")!")))
    return own.withColumn("w", w).select("doc_id", "k", "w", spotting.spotting_word(F.col("w")).alias("word"))


_OFF = "off AS (SELECT DISTINCT p.image_id, p.pi FROM pred p JOIN gt g USING (image_id) WHERE g.score < 0.03 AND greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) / ((p.x2 - p.x1) * (p.y2 - p.y1)) > 0.5)"
_CARED = f"""{_OFF}, tr AS (SELECT * FROM gt WHERE score >= 0.03), de AS (SELECT * FROM pred WHERE (image_id, pi) NOT IN (SELECT image_id, pi FROM off)),
cand AS (SELECT g.image_id, g.gi, p.pi, {_iou('g', 'p')} AS iou, g.text AS a, p.text AS b FROM tr g JOIN de p USING (image_id) WHERE {_iou('g', 'p')} > 0.5){_COVER.format(k='', j='').replace('ORDER BY iou DESC, gi, pi', 'ORDER BY gi, pi')},
cn AS (SELECT image_id, coalesce(gt_care, 0) AS gt_care, coalesce(det_care, 0) AS det_care, coalesce(matched, 0) AS matched, coalesce(correct, 0) AS correct FROM (SELECT image_id FROM gt UNION SELECT image_id FROM pred)
 LEFT JOIN (SELECT image_id, count(*) AS gt_care FROM tr GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS det_care FROM de GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS matched, count(*) FILTER (upper(a) = upper(b)) AS correct FROM cov GROUP BY 1) USING (image_id))"""
_HMEAN = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS hmean"


def _counts(spark, d):
    return spotting.spotting_counts(truth(spark, d).withColumn("care", F.col("score") >= 0.03), guesses(spark, d))


@query(f"{_W}, {_CARED}, s AS (SELECT *, CASE WHEN gt_care = 0 THEN CASE WHEN det_care > 0 THEN 0.0 ELSE 1.0 END WHEN det_care > 0 THEN correct::DOUBLE / det_care ELSE 0.0 END AS precision, CASE WHEN gt_care = 0 THEN 1.0 ELSE correct::DOUBLE / gt_care END AS recall FROM cn) SELECT *, {_HMEAN} FROM s")
def a47_spotting_scores(spark, d):
    return spotting.spotting_scores(_counts(spark, d), "correct")


@query(f"{_W}, {_CARED}, s AS (SELECT 'end_to_end' AS kind, sum(correct)::DOUBLE / sum(det_care)::DOUBLE AS precision, sum(correct)::DOUBLE / sum(gt_care)::DOUBLE AS recall FROM cn UNION ALL SELECT 'detection', sum(matched)::DOUBLE / sum(det_care)::DOUBLE, sum(matched)::DOUBLE / sum(gt_care)::DOUBLE FROM cn) SELECT *, {_HMEAN} FROM s")
def a47_spotting_summary(spark, d):
    return spotting.spotting_summary(_counts(spark, d))


@query(f"""{_W}, v AS (SELECT p.image_id, p.pi, p.score, coalesce(v.tp, 0) AS tp FROM pred p LEFT JOIN (SELECT image_id, pi, (row_number() OVER (PARTITION BY image_id, gi ORDER BY score DESC, pi) = 1)::INT AS tp FROM (SELECT p.image_id, p.pi, p.score, g.gi, {_iou('g', 'p')} AS iou, row_number() OVER (PARTITION BY p.image_id, p.pi ORDER BY {_iou('g', 'p')} DESC, g.gi) AS r FROM pred p JOIN gt g USING (image_id)) WHERE r = 1 AND iou > 0.5) v USING (image_id, pi)),
r AS (SELECT image_id, tp, sum(tp) OVER w / row_number() OVER w AS p FROM v WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, pi))
SELECT image_id, round(sum(CASE WHEN tp = 1 THEN p ELSE 0 END) / any_value(n), 8) AS ap FROM r JOIN (SELECT image_id, count(*) AS n FROM gt GROUP BY 1) USING (image_id) GROUP BY 1""")
def a48_confidence_ap(spark, d):
    gt, pred = truth(spark, d), guesses(spark, d)
    hits = matching.voc_hits(pred, matching.best_truth(matching.iou_pairs(gt, pred, 0.0)), 0.5)
    hits = hits.join(gt.groupBy("image_id").agg(F.count("*").alias("n")), "image_id")
    return spotting.confidence_ap(hits, "image_id", "score", "pi", "n").select("image_id", F.round("ap", 8).alias("ap"))


@query(f"{_W} SELECT image_id, string_agg(x1::INT || ',' || y1::INT || ',' || x2::INT || ',' || y1::INT || ',' || x2::INT || ',' || y2::INT || ',' || x1::INT || ',' || y2::INT || ',####' || text, chr(10) ORDER BY pi) AS content FROM (SELECT * FROM pred WHERE score >= 0.04 AND pi % 2 = 1) GROUP BY 1")
def k10_submission(spark, d):
    b = F.col("box")
    points = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    pred = guesses(spark, d).where("pi % 2 = 1").withColumn("points", points).withColumn("text", F.concat("text", F.lit("é")))
    return spotting.submission(pred, "points", "text", "score", 0.04)


@query(f"{_W} SELECT image_id, x1, y1, x2, y2, string_agg(text, ' | ' ORDER BY pi) AS texts, count(*) AS n FROM (SELECT image_id, pi, text, min(x1) OVER w AS x1, min(y1) OVER w AS y1, max(x2) OVER w AS x2, max(y2) OVER w AS y2 FROM pred WINDOW w AS (PARTITION BY image_id)) GROUP BY ALL")
def k4_recognised_texts(spark, d):
    """Recognised texts of each image in one line, with the box around all of them."""
    b = F.col("box")
    own = guesses(spark, d).where("text <> ''").groupBy("image_id").agg(F.min(b["x1"]).alias("x1"), F.min(b["y1"]).alias("y1"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2"), F.sort_array(F.collect_list(F.struct("pi", "text"))).alias("t"))
    return own.select("image_id", "x1", "y1", "x2", "y2", F.array_join(F.transform("t", lambda x: x["text"]), " | ").alias("texts"), F.size("t").cast("long").alias("n"))
