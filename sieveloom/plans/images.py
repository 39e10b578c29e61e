"""Queries: clauses, masks, gates, listings, model adapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tags as t
from ..operators import clauses as cl
from ..operators import geometry, masks
from . import domain as d
from .registry import QUERIES, query

CROPS = "crops AS (SELECT image, CAST(box AS INTEGER) AS crop, 't' || CAST(CAST(y0 AS INTEGER) % 5 AS VARCHAR) AS tag, score FROM boxes)"


def _crops(spark, sf_dir):
    return d.boxes(spark, sf_dir).select("image", F.col("box").alias("crop"), F.concat(F.lit("t"), (F.col("y0").cast("int") % 5).cast("string")).alias("tag"), "score")


@query("p15_count_gate", "WITH " + d.BOXES + """
, n AS (SELECT image, count(*) AS n FROM boxes GROUP BY image)
SELECT image, CASE WHEN n < 2 THEN 'skip:too-few-instances' WHEN n > 8 THEN 'skip:too-many-instances'
  WHEN image % 4 > 0 AND (n < image % 4 OR (image % 3 <> 2 AND n > image % 4 + image % 3)) THEN 'skip:count-mismatch'
  WHEN image % 4 = 0 AND image % 5 > 0 AND n > image % 5 THEN 'skip:count-mismatch' END AS skip FROM n""")
def count_gate(spark, sf_dir):
    n = d.boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    expected = F.when(F.col("image") % 4 > 0, F.col("image") % 4)
    boys = F.when(F.col("image") % 3 != 2, F.col("image") % 3)
    panels = F.when(F.col("image") % 5 > 0, F.col("image") % 5)
    return n.select("image", cl.count_gate(F.col("n"), expected, boys, panels).alias("skip"))


def _policy():
    return cl.Policy(max_tags=3, group_of={f"t{i}": "hair_color" if i < 2 else "pose" for i in range(5)}, priority=("hair_color",), exclusive=frozenset({"hair_color"}), subject=frozenset({"hair_color", "pose"}))


@query("r08_r10_clause_tags")
def clause_tags(spark, sf_dir):
    bags = d.fronts(spark, sf_dir).select(F.col("key").alias("image"), F.array(F.lit("t1"), F.lit("t3")).alias("bag"), (F.col("key") % 9 == 0).alias("repeated"))
    best = _crops(spark, sf_dir).groupBy("image", "crop", "tag").agg(F.max("score").alias("score"))
    return cl.clause_tags(best, bags, _policy())


@query("r09_bag_removals_all", "WITH " + d.BOXES + ",\n" + CROPS + """,
s AS (SELECT image, crop, tag, max(score) AS score FROM crops GROUP BY ALL),
c AS (SELECT image, tag, crop, score, count(*) OVER (PARTITION BY image, tag) AS n FROM s WHERE tag IN ('t1', 't2', 't3'))
SELECT image, tag, crop, CASE WHEN n > 1 THEN 'multi-clause' WHEN tag = 't3' THEN 'character-name' WHEN tag = 't1' AND image % 2 = 0 THEN 'two-tone-marker' ELSE 'moved' END AS verdict FROM c""")
def bag_removals_all(spark, sf_dir):
    """Removals judged by every crop of an image."""
    scores = _crops(spark, sf_dir).groupBy("image", "crop", "tag").agg(F.max("score").alias("score"))
    held = scores.where("tag in ('t1', 't2', 't3')").select("image", "crop", "tag")
    images = scores.select("image").distinct()
    bag = images.withColumn("tag", F.explode(F.array(*map(F.lit, ("t1", "t2", "t3"))))).select("image", "tag", F.when(F.col("tag") != "t3", "g").alias("grp"), (F.col("tag") == "t3").alias("is_name"), (F.col("image") % 2 == 0).alias("pinned"))
    return cl.bag_removals(held, scores, bag, 0.25, F.col("tag") == "t1")


@query("t09_clause_drift", "WITH " + d.BAGS + """
SELECT key, len(list_filter(tags[2:5], lambda x: NOT list_contains(tags[1:4], x))) AS novel, len(list_filter(tags[2:5], lambda x: list_contains(tags[1:3], x))) AS doubled FROM bags""")
def clause_drift(spark, sf_dir):
    from ..operators.joins import clause_drift as drift

    _, novel, doubled = drift(F.slice("tags", 1, 4), F.slice("tags", 2, 4), F.slice("tags", 1, 3))
    return d.bags(spark, sf_dir).select("key", F.size(novel).cast("long").alias("novel"), F.size(doubled).cast("long").alias("doubled"))


@query("k27_compare_runs", "WITH " + d.OCCURRENCES + """
, a AS (SELECT key, list_distinct(list(tag)) AS x FROM occurrences GROUP BY key), b AS (SELECT key, list_distinct(list(tag) FILTER (WHERE n <= 3)) AS y FROM occurrences GROUP BY key)
SELECT key AS image, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS same, 0 AS gained, CAST(len(list_filter(x, lambda v: NOT list_contains(y, v))) AS INTEGER) AS lost FROM a JOIN b USING (key)""")
def compare_runs(spark, sf_dir):
    o = d.occurrences(spark, sf_dir)
    one = o.groupBy(F.col("key").alias("image")).agg(F.collect_set("tag").alias("tags"))
    two = o.where("n <= 3").groupBy(F.col("key").alias("image")).agg(F.collect_set("tag").alias("tags"))
    return cl.compare_runs(one, two)


@query("k18_run_summary", "WITH " + d.BOXES + """
SELECT count(DISTINCT image) AS images, count(*) AS clauses, CAST(max(box) AS INTEGER) AS most, round(1 - count(*) FILTER (WHERE score < 0.93) / count(*), 3) AS reuse_ratio FROM boxes""")
def run_summary(spark, sf_dir):
    b = d.boxes(spark, sf_dir)
    return b.agg(F.count_distinct("image").alias("images"), F.count(F.lit(1)).alias("clauses"), F.max("box").alias("most"), F.round(1 - F.count_if(F.col("score") < 0.93) / F.count(F.lit(1)), 3).alias("reuse_ratio"))


@query("p17_verdict_gate", "WITH " + d.FRONTS + " SELECT key FROM fronts WHERE people IN ('1girl', 'solo') AND rating <> 'explicit'")
def verdict_gate(spark, sf_dir):
    return d.fronts(spark, sf_dir).where(F.col("people").isin("1girl", "solo") & (F.col("rating") != "explicit")).select("key")


@query("p18_w14_listing", """
SELECT page_id, lower(url) AS name FROM pages WHERE contains(lower(url), 'example.com') ORDER BY regexp_replace(lower(url), '/[^/]*$', ''), lower(url), page_id LIMIT 200""")
def listing(spark, sf_dir):
    name = F.lower("url")
    rows = d.table(spark, sf_dir, "pages").where(name.contains("example.com"))
    return rows.orderBy(F.regexp_replace(name, "/[^/]*$", ""), name, "page_id").limit(200).select("page_id", name.alias("name"))


@query("w04_best_count", "WITH " + d.SCORES + """
SELECT sample, family, tag, score FROM (SELECT sample, CASE WHEN tag % 2 = 0 THEN 'girl' ELSE 'boy' END AS family, tag, score, row_number() OVER (PARTITION BY sample, tag % 2 ORDER BY score DESC, tag) AS r FROM scores) WHERE r = 1""")
def best_count(spark, sf_dir):
    s = d.scores(spark, sf_dir).withColumn("family", F.when(F.col("tag") % 2 == 0, "girl").otherwise("boy"))
    order = Window.partitionBy("sample", "family").orderBy(F.desc("score"), "tag")
    return s.withColumn("r", F.row_number().over(order)).where("r = 1").select("sample", "family", "tag", "score")


@query("f13_solo_indices", "WITH " + d.EMITTED + """
, v AS (SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS index FROM (SELECT DISTINCT tag FROM emitted))
SELECT tag, index, tag IN ('1girl', '1boy', 'solo') AS single FROM v WHERE tag IN ('1girl', '1boy', 'solo', '2girls', '6+girls', 'multiple_girls', '3others')""")
def solo_indices(spark, sf_dir):
    names = d.emitted(spark, sf_dir).select("tag").distinct().withColumn("index", F.row_number().over(Window.orderBy("tag")) - 1)
    single = F.col("tag").isin(*t.SINGLE_COUNTS)
    return names.where(single | t.is_count_tag(F.col("tag"))).select("tag", "index", single.alias("single"))


MASKS = """m AS (SELECT image, box, greatest(0, least(16, CAST(floor(x0 / 40) AS INTEGER))) AS a, greatest(0, least(16, CAST(floor(x1 / 40) AS INTEGER))) AS b FROM boxes)"""


def _masks(spark, sf_dir):
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(16), F.floor(F.col(c) / 40).cast("int")))
    rows = d.boxes(spark, sf_dir).select("image", "box", cell("x0").alias("a"), cell("x1").alias("b"))
    return rows.select(F.col("image").cast("string").alias("name"), F.col("box").alias("place"), F.lit(1).alias("height"), F.lit(16).alias("width"), masks.ignore_mask(masks.mask_bits(F.col("a"), F.col("b"), 16)).alias("alpha"))


@query("t08_j16_b12_merge_masks_all", "WITH " + d.BOXES + ",\n" + MASKS + """
SELECT CAST(image AS VARCHAR) AS name, count(*) FILTER (WHERE NOT hit) AS kept FROM (SELECT image, p, bool_or(p >= a AND p < b) AS hit FROM m, unnest(range(16)) AS u(p) GROUP BY image, p) GROUP BY image""")
def merge_masks_all(spark, sf_dir):
    """Masks of every box of an image merged."""
    merged = masks.merge_masks(_masks(spark, sf_dir))
    return merged.select("name", F.regexp_count(F.hex("alpha"), F.lit("FF")).cast("long").alias("kept"))


@query("k24_mask_coverage_all", "WITH " + d.BOXES + ",\n" + MASKS + " SELECT CAST(image AS VARCHAR) AS name, CAST(box AS INTEGER) AS place, round(100.0 * (16 - greatest(0, b - a)) / 16, 6) AS percent FROM m")
def mask_coverage_all(spark, sf_dir):
    return _masks(spark, sf_dir).select("name", "place", F.round(masks.coverage_percent("alpha"), 6).alias("percent"))


@query("b13_label_maps")
def label_maps(spark, sf_dir):
    b = d.boxes(spark, sf_dir).select("image", "box", *[(F.col(c) / 40).alias(c) for c in ("x0", "y0", "x1", "y1")])
    maps = masks.label_maps(b, 16, 24)
    return maps.select("image", F.md5("labels").alias("labels_md5"))


@query("l11_k26_box_recall", "WITH " + d.BOXES + """
, t AS (SELECT * FROM boxes WHERE box % 2 = 1), p AS (SELECT * FROM boxes WHERE box % 2 = 0),
h AS (SELECT DISTINCT t.image, t.box FROM t JOIN p ON t.image = p.image WHERE greatest(least(t.x1, p.x1) - greatest(t.x0, p.x0), 0) * greatest(least(t.y1, p.y1) - greatest(t.y0, p.y0), 0)
      / ((t.x1 - t.x0) * (t.y1 - t.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) - greatest(least(t.x1, p.x1) - greatest(t.x0, p.x0), 0) * greatest(least(t.y1, p.y1) - greatest(t.y0, p.y0), 0)) >= 0.3)
SELECT (SELECT count(*) FROM t) AS targets, (SELECT count(*) FROM h) AS found, round((SELECT count(*) FROM h) / (SELECT count(*) FROM t), 6) AS recall""")
def box_recall(spark, sf_dir):
    from ..operators import geometry as geo

    b = d.boxes(spark, sf_dir)
    targets = b.where("box % 2 = 1")
    missed = geo.uncovered(targets, b.where("box % 2 = 0"), 0.3, 2.0).select("image", "box", F.lit(1).alias("m"))
    all_rows = targets.join(missed, ["image", "box"], "left")
    return all_rows.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("m").isNull()).alias("found"), F.round(F.count_if(F.col("m").isNull()) / F.count(F.lit(1)), 6).alias("recall"))


@query("v02_v04_dense_matches")
def dense_matches(spark, sf_dir):
    """Vectors read as 4 x 4 grids of four values, matched for near pairs."""
    from ..operators import vectors

    e = d.table(spark, sf_dir, "embeddings")
    features = e.select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"), F.lit(4).alias("side"), F.col("embedding").alias("grid"))
    return vectors.near_dense_matches(features, 0.25, 4, 0.5, 0.99)


@query("k25_suppression_counts", "SELECT count(*) AS n FROM lineitem")
def suppression_counts(spark, sf_dir):
    """Kept and suppressed boxes add up to all boxes."""
    from ..operators import geometry as geo

    b = d.boxes(spark, sf_dir)
    kept = geo.suppress(b)
    gone = b.join(kept.select("image", "box"), ["image", "box"], "left_anti")
    return kept.select("image").unionByName(gone.select("image")).agg(F.count(F.lit(1)).alias("n"))


FLOORS = (0.9, 0.93, 0.96, 0.99)


def _pairs_by_floor(spark, sf_dir):
    # By score, a box below a floor never decides on one above it: one replay holds for all floors.
    floors = F.explode(F.filter(F.array(*map(F.lit, FLOORS)), lambda f: F.col("dropped_score") >= f))
    return geometry.suppression_pairs(d.boxes(spark, sf_dir)).withColumn("floor", floors)


@query("k25_suppression_pairs")
def suppression_pairs(spark, sf_dir):
    """(kept, dropped) pairs of the boxes above each score floor."""
    return _pairs_by_floor(spark, sf_dir).select("floor", "image", "kept", "dropped", "kept_score", "dropped_score")


@query("k25_suppression_audit")
def suppression_audit(spark, sf_dir):
    """Kept and suppressed boxes above each score floor."""
    above = F.explode(F.filter(F.array(*map(F.lit, FLOORS)), lambda f: F.col("score") >= f))
    total = d.boxes(spark, sf_dir).select(above.alias("floor")).groupBy("floor").agg(F.count(F.lit(1)).alias("n"))
    gone = _pairs_by_floor(spark, sf_dir).groupBy("floor").agg(F.count(F.lit(1)).alias("g"))
    lost = F.coalesce("g", F.lit(0))
    return total.join(gone, "floor", "left").select("floor", (F.col("n") - lost).alias("kept"), lost.alias("suppressed"))


def stages():
    """Names and runners of all registered queries: the stage registry."""
    return dict(QUERIES)


@query("y03_map_threshold", "WITH " + d.SCORES + """
SELECT sample, string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) AS kept FROM scores WHERE score >= CASE WHEN tag < 5 THEN 0.55 ELSE 0.5 END GROUP BY sample""")
def map_threshold(spark, sf_dir):
    per = d.scores(spark, sf_dir).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("m"))
    limits = F.create_map(*[x for i in range(5) for x in (F.lit(i), F.lit(0.55))])
    kept = per.select("sample", F.array_sort(F.map_keys(t.above(F.col("m"), limits))).alias("k")).where(F.size("k") > 0)
    return kept.select("sample", F.array_join("k", ",").alias("kept"))


@query("y06_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def iso_times(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    return e.select("event_id", t.iso_utc(F.col("ts")).alias("iso"), t.minute(F.col("ts")).alias("minute"))


@query("f44_f45_keys_and_selectors", "SELECT * FROM (VALUES ('a/b', true), ('/a', false), ('a/../b', false), ('c:x', false), ('a\\b', false), ('..', false), ('a..b', true), ('', false)) AS v(path, good)")
def keys_and_selectors(spark, sf_dir):
    if t.parse_selectors("Hair, hair,x > Y,, face", ("hair", "face")) != ("hair", "x > Y", "face"):
        raise ValueError("selectors")
    rows = spark.createDataFrame([(p,) for p in ("a/b", "/a", "a/../b", "c:x", "a\\b", "..", "a..b", "")], "path string")
    return rows.select("path", t.is_rel_key(F.col("path")).alias("good"))


@query("r11_suggested_count", "WITH " + d.BOXES + """
, n AS (SELECT image, count(*) AS n FROM boxes GROUP BY image)
SELECT image, CASE WHEN n > image % 3 THEN CASE WHEN n >= 6 THEN '6+girls' WHEN n = 1 THEN '1girl' ELSE CAST(n AS VARCHAR) || 'girls' END END AS suggested FROM n""")
def suggested_count(spark, sf_dir):
    n = d.boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return n.select("image", t.suggest_count(F.col("n"), F.col("image") % 3).alias("suggested"))


@query("j18_vocab_membership", "WITH " + d.OCCURRENCES + ",\n" + d.KNOWLEDGE + " SELECT DISTINCT key FROM occurrences WHERE tag IN (SELECT tag FROM knowledge WHERE kind = 'character')")
def vocab_membership(spark, sf_dir):
    names = d.knowledge(spark, sf_dir).where("kind = 'character'").select("tag")
    return d.occurrences(spark, sf_dir).join(names, "tag", "left_semi").select("key").distinct()


@query("k22_group_totals", "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS grouped, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT label, vec_id % 40 AS b, count(*) AS n FROM embeddings GROUP BY ALL)")
def group_totals(spark, sf_dir):
    per = d.table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 40).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("grouped"), F.count_if(F.col("n") == 1).alias("singletons"))


@query("w17_score_swings", "WITH " + d.SCORES + """
, a AS (SELECT tag, avg(score) FILTER (WHERE sample % 2 = 0) AS x, avg(score) FILTER (WHERE sample % 2 = 1) AS y, sum(truth) AS support FROM scores GROUP BY tag)
SELECT tag, round(y - x, 6) AS swing FROM a WHERE support >= 5 ORDER BY abs(round(y - x, 6)) DESC, tag LIMIT 5""")
def score_swings(spark, sf_dir):
    even = F.col("sample") % 2 == 0
    per = d.scores(spark, sf_dir).groupBy("tag").agg(F.avg(F.when(even, F.col("score"))).alias("x"), F.avg(F.when(~even, F.col("score"))).alias("y"), F.sum("truth").alias("support"))
    swing = F.round(F.col("y") - F.col("x"), 6)
    return per.where("support >= 5").select("tag", swing.alias("swing")).orderBy(F.desc(F.abs(F.col("swing"))), "tag").limit(5)


@query("g06_quoted_spans", "WITH " + d.CAPTIONS_SQL + """
SELECT id, array_to_string(regexp_extract_all(text, '「[^「」]*」|『[^『』]*』|"[^"]*"'), '|') AS spans FROM captions""")
def quoted_spans(spark, sf_dir):
    from ..functions.grammar import quoted_spans as spans

    return d.captions(spark).select("id", F.array_join(spans(F.col("text")), "|").alias("spans"))


@query("g06_document_quoted_spans", """
SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '「[^「」]*」|『[^『』]*』|"[^"]*"'), '|') AS spans FROM documents""")
def document_quoted_spans(spark, sf_dir):
    """Quoted spans of every document."""
    from ..functions.grammar import quoted_spans as spans

    return d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(spans(F.col("text")), "|").alias("spans"))


@query("z01_m01_scored_batches", "SELECT doc_id, length(text) AS score FROM documents")
def scored_batches(spark, sf_dir):
    """A stub model over document batches."""
    from .models import scored

    rows = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(rows, lambda: lambda pdf: pdf.assign(score=pdf["text"].str.len())[["doc_id", "score"]], "doc_id long, score long")
