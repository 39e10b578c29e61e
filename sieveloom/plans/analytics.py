"""Queries: vocabulary statistics, joins, lines, geometry, metrics, vectors, state, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import tags as t
from ..operators import geometry as geo
from ..operators import joins, metrics, state, vectors, vocab
from . import domain as d
from .registry import check_grid, query

MIN_FREQ = 20


# Vocabulary ------------------------------------------------------------------
@query("k01_vocabulary", "WITH " + d.EMITTED + f"""
SELECT tag AS name, count(*) AS freq, round(avg(pos), 2) AS median_pos, CAST(row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS INTEGER) AS index
FROM emitted WHERE tag NOT IN ('safe', 'sensitive', 'nsfw', 'explicit', 'general', 'questionable') GROUP BY tag HAVING count(*) >= {MIN_FREQ}""")
def vocabulary(spark, sf_dir):
    return vocab.tag_statistics(d.emitted(spark, sf_dir), MIN_FREQ)


@query("k02_rating_distribution", "WITH " + d.FRONTS + " SELECT CASE rating WHEN 'general' THEN 'safe' ELSE rating END AS rating, count(*) AS n FROM fronts GROUP BY 1")
def rating_distribution(spark, sf_dir):
    return vocab.rating_distribution(d.bags(spark, sf_dir))


@query("k03_people_distribution", "WITH " + d.FRONTS + """
SELECT CASE people WHEN '1girl' THEN '1girl' WHEN '2girls' THEN '2girls' WHEN 'multiple_girls' THEN '2girls' WHEN '1boy' THEN '1boy' WHEN 'solo' THEN 'no_people' ELSE 'multi' END AS people, count(*) AS n FROM fronts GROUP BY 1""")
def people_distribution(spark, sf_dir):
    return vocab.people_distribution(d.bags(spark, sf_dir))


@query("p06_k04_categories", "WITH " + d.EMITTED + ",\n" + d.KNOWLEDGE + """
SELECT category, count(*) AS n, count(*) FILTER (WHERE cached) AS cached FROM (
  SELECT e.tag, k.kind IS NOT NULL AS cached, CASE WHEN e.tag IN ('safe', 'general', 'explicit') THEN 'rating' WHEN e.tag LIKE '@%' THEN 'artist'
    WHEN e.tag IN ('1girl', '2girls', 'multiple_girls', '1boy', '6+girls', '3others') THEN 'count' WHEN e.tag = 'red widget' THEN 'copyright' ELSE coalesce(k.kind, 'general') END AS category
  FROM (SELECT DISTINCT tag FROM emitted) e LEFT JOIN knowledge k USING (tag)) GROUP BY category""")
def categories(spark, sf_dir):
    cache = d.knowledge(spark, sf_dir).select("tag", F.col("kind").alias("category"))
    over = spark.createDataFrame([("red widget", "copyright")], "tag string, category string")
    out = vocab.categorize(d.emitted(spark, sf_dir).select("tag").distinct(), cache, over)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("cached").alias("cached"))


HALF = "half AS (SELECT tag FROM knowledge WHERE posts >= 45)"


@query("k05_coverage", "WITH " + d.EMITTED + ",\n" + d.KNOWLEDGE + ",\n" + HALF + """
SELECT count(*) AS unique_tags, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (WHERE h.tag IS NULL) AS unique_missing, CAST(sum(n) FILTER (WHERE h.tag IS NULL) AS BIGINT) AS occurrences_missing
FROM (SELECT tag, count(*) AS n FROM emitted GROUP BY tag) e LEFT JOIN half h USING (tag)""")
def coverage(spark, sf_dir):
    return vocab.coverage(d.emitted(spark, sf_dir), d.knowledge(spark, sf_dir).where("posts >= 45"))


@query("k05_most_missing", "WITH " + d.EMITTED + ",\n" + d.KNOWLEDGE + ",\n" + HALF + " SELECT tag, count(*) AS n FROM emitted WHERE tag NOT IN (SELECT tag FROM half) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def most_missing(spark, sf_dir):
    return vocab.most_missing(d.emitted(spark, sf_dir), d.knowledge(spark, sf_dir).where("posts >= 45"))


AXES = "axes AS (SELECT tag, kind AS axis FROM knowledge WHERE kind IN ('character', 'copyright'))"


@query("k06_b06_inverted_index", "WITH " + d.OCCURRENCES + ",\n" + d.KNOWLEDGE + ",\n" + AXES + """
SELECT axis, tag, key // 4096 AS part, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS keys, count(*) AS n FROM (SELECT DISTINCT axis, o.tag, key FROM occurrences o JOIN axes USING (tag)) GROUP BY axis, tag, part""")
def inverted_index(spark, sf_dir):
    axes = d.knowledge(spark, sf_dir).where("kind in ('character', 'copyright')").select("tag", F.col("kind").alias("axis"))
    return vocab.inverted_index(d.occurrences(spark, sf_dir), axes).select("axis", "tag", "part", F.array_join("keys", ",").alias("keys"), "n")


@query("k07_axis_coverage", "WITH " + d.OCCURRENCES + ",\n" + d.KNOWLEDGE + ",\n" + AXES + """
SELECT axis, count(DISTINCT key) AS images, round(100.0 * count(DISTINCT key) / (SELECT count(*) FROM orders), 4) AS percent FROM occurrences JOIN axes USING (tag) GROUP BY axis""")
def axis_coverage(spark, sf_dir):
    axes = d.knowledge(spark, sf_dir).where("kind in ('character', 'copyright')").select("tag", F.col("kind").alias("axis"))
    return vocab.axis_coverage(d.occurrences(spark, sf_dir), axes, d.table(spark, sf_dir, "orders").count())


def _solo(spark, sf_dir):
    return d.occurrences(spark, sf_dir).join(d.fronts(spark, sf_dir).where("solo").select("key"), "key", "left_semi").select("key", "tag")


def _adjectives(spark, sf_dir):
    return d.knowledge(spark, sf_dir).select(F.element_at(F.split("tag", " "), 1).alias("path"), F.col("tag").alias("name"))


@query("k08_k09_k11_group_modes", "WITH " + d.OCCURRENCES + ",\n" + d.FRONTS + ",\n" + d.KNOWLEDGE + """,
g AS (SELECT string_split(tag, ' ')[1] AS path, tag FROM knowledge),
p AS (SELECT path, o.key, count(DISTINCT o.tag) AS k FROM occurrences o JOIN fronts f ON f.key = o.key AND f.solo JOIN g USING (tag) GROUP BY path, o.key),
s AS (SELECT path, count(*) AS n_any, count(*) FILTER (WHERE k >= 2) AS n_multi, round(count(*) FILTER (WHERE k >= 2) / count(*), 6) AS multi_rate FROM p GROUP BY path)
SELECT *, CASE WHEN n_any < 30 THEN 'low_support' WHEN multi_rate <= 0.05 THEN 'confident' WHEN multi_rate <= 0.2 THEN 'borderline' ELSE 'multilabel' END AS tier,
  CASE WHEN n_any >= 30 AND multi_rate <= 0.05 THEN 'softmax_when_solo' ELSE 'multilabel' END AS mode FROM s""")
def group_modes(spark, sf_dir):
    return vocab.decide_mode(vocab.group_cooccurrence(_solo(spark, sf_dir), _adjectives(spark, sf_dir)), 30, 0.05, 0.2)


@query("k10_j08_taxonomy_groups", "WITH " + d.OCCURRENCES + ",\n" + d.KNOWLEDGE + """,
v AS (SELECT tag AS name, count(*) AS freq FROM occurrences GROUP BY tag HAVING count(*) >= 50),
r AS (SELECT split_part(path, ' > ', 2) AS path, name, freq FROM v JOIN knowledge k ON k.tag = v.name WHERE kind = 'general'),
s AS (SELECT *, count(*) OVER (PARTITION BY path) AS c FROM r)
SELECT path, name, freq, CAST(row_number() OVER (PARTITION BY path ORDER BY freq DESC, name) AS INTEGER) AS place FROM s WHERE c >= 3""")
def taxonomy_groups(spark, sf_dir):
    counts = d.occurrences(spark, sf_dir).groupBy(F.col("tag").alias("name")).agg(F.count(F.lit(1)).alias("freq"))
    kb = d.knowledge(spark, sf_dir).withColumn("path", F.split("path", " > ")[1])
    return vocab.taxonomy_groups(counts, kb, 50, 3)


@query("k12_conditional", "WITH " + d.OCCURRENCES + ",\n" + d.FRONTS + """,
r AS (SELECT DISTINCT o.key, tag FROM occurrences o JOIN fronts f ON f.key = o.key AND f.solo),
s AS (SELECT key, count(*) AS k FROM r GROUP BY key)
SELECT tag AS name, count(*) AS n_solo, count(*) FILTER (WHERE k > 1) AS n_co, round(count(*) FILTER (WHERE k > 1) / count(*), 6) AS ratio
FROM r JOIN s USING (key) GROUP BY tag HAVING count(*) >= 5 AND round(count(*) FILTER (WHERE k > 1) / count(*), 6) >= 0.5""")
def conditional(spark, sf_dir):
    return vocab.conditional_cooccurrence(_solo(spark, sf_dir), 5, 0.5)


@query("k12_partners", "WITH " + d.OCCURRENCES + ",\n" + d.FRONTS + """,
r AS (SELECT DISTINCT o.key, tag FROM occurrences o JOIN fronts f ON f.key = o.key AND f.solo)
SELECT a.tag AS name, b.tag AS partner, count(*) AS n FROM r a JOIN r b ON a.key = b.key AND a.tag <> b.tag GROUP BY 1, 2""")
def partner_counts(spark, sf_dir):
    return vocab.partners(_solo(spark, sf_dir))


@query("k13_partner_buckets")
def partner_buckets(spark, sf_dir):
    solo = _solo(spark, sf_dir)
    return vocab.classify_partners(vocab.conditional_cooccurrence(solo, 5, 0.5), vocab.partners(solo), 5, 0.6)


@query("k14_attribution", "WITH " + d.BOXES + """,
n AS (SELECT image, count(*) AS crops FROM boxes GROUP BY image),
c AS (SELECT image, CAST(y0 % 7 AS INTEGER) AS tag, count(*) AS k FROM boxes GROUP BY 1, 2)
SELECT image, count(*) FILTER (WHERE k = 1) AS attributable, count(*) FILTER (WHERE k = crops AND crops > 1) AS shared FROM c JOIN n USING (image) GROUP BY image""")
def attribution(spark, sf_dir):
    """Tags that one crop has, and tags that all crops share."""
    rows = d.boxes(spark, sf_dir).select("image", (F.col("y0") % 7).cast("int").alias("tag"))
    crops = rows.groupBy("image").agg(F.count(F.lit(1)).alias("crops"))
    per = rows.groupBy("image", "tag").agg(F.count(F.lit(1)).alias("k")).join(crops, "image")
    return per.groupBy("image").agg(F.count_if(F.expr("k = 1")).alias("attributable"), F.count_if(F.expr("k = crops and crops > 1")).alias("shared"))


@query("k15_k16_identity_verdict", "WITH " + d.BOXES + """,
g AS (SELECT image, u.grp, CASE u.grp WHEN 0 THEN CAST(x0 % 3 AS INTEGER) WHEN 1 THEN CAST(y0 % 2 AS INTEGER) ELSE CAST(x1 % 2 AS INTEGER) END AS v FROM boxes, unnest([0, 1, 2]) AS u(grp) WHERE score >= 0.9),
n AS (SELECT image, count(*) AS crops FROM boxes WHERE score >= 0.9 GROUP BY image),
a AS (SELECT image, grp, count(DISTINCT v) = 1 AS same FROM g GROUP BY image, grp),
r AS (SELECT image, round(avg(CAST(same AS INTEGER)), 6) AS agreement FROM a JOIN n USING (image) WHERE crops >= 2 GROUP BY image)
SELECT image, agreement, CASE WHEN agreement >= 0.66 THEN 'same' WHEN agreement <= 0.34 THEN 'different' ELSE 'unsure' END AS verdict FROM r""")
def identity_verdict(spark, sf_dir):
    """Share of the groups on which all reliable crops agree, and the verdict's band."""
    rows = d.boxes(spark, sf_dir).where("score >= 0.9")
    crops = rows.groupBy("image").agg(F.count(F.lit(1)).alias("crops")).where("crops >= 2")
    values = F.array((F.col("x0") % 3).cast("int"), (F.col("y0") % 2).cast("int"), (F.col("x1") % 2).cast("int"))
    per = rows.select("image", F.posexplode(values).alias("grp", "v")).groupBy("image", "grp").agg((F.min("v") == F.max("v")).cast("int").alias("same"))
    out = per.join(crops, "image").groupBy("image").agg(F.round(F.avg("same"), 6).alias("agreement"))
    return out.withColumn("verdict", F.when(F.col("agreement") >= 0.66, "same").when(F.col("agreement") <= 0.34, "different").otherwise("unsure"))


@query("k23_folder_rollup", """
WITH p AS (SELECT string_split(regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '#.*$', ''), '/') AS p FROM pages)
SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS n FROM p, unnest(range(1, len(p))) AS u(i) GROUP BY 1""")
def folder_rollup(spark, sf_dir):
    path = F.regexp_replace(F.substring_index(F.regexp_replace("url", "^[^:]*://", ""), "?", 1), "#.*$", "")
    return vocab.folder_rollup(d.table(spark, sf_dir, "pages").select(path.alias("path")))


@query("w16_split_sizes", "SELECT 'val' AS split, CAST(round_even(count(*) * 0.05, 0) AS BIGINT) AS n FROM orders UNION ALL SELECT 'train', count(*) - CAST(round_even(count(*) * 0.05, 0) AS BIGINT) FROM orders")
def split_sizes(spark, sf_dir):
    return split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("w16_split")
def split(spark, sf_dir):
    """Train and validation keys by hash; the sizes are fixed, the members are ours."""
    return vocab.split_train(d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), 0.05, 42)


# Joins and sets --------------------------------------------------------------
LADDER = """revised AS (SELECT c_custkey AS key, 'r' || c_name AS text FROM customer WHERE c_custkey % 3 = 0),
master AS (SELECT c_custkey AS key, 'm' || c_name AS text FROM customer WHERE c_custkey % 2 = 0), source AS (SELECT c_custkey AS key, c_name AS text FROM customer WHERE c_custkey % 5 <> 1)"""


def _ladder(spark, sf_dir):
    c = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    return c, [("revised", c.where("key % 3 = 0").select("key", F.concat(F.lit("r"), "text").alias("text"))), ("master", c.where("key % 2 = 0").select("key", F.concat(F.lit("m"), "text").alias("text"))), ("source", c.where("key % 5 <> 1"))]


@query("j01_a10_caption_ladder", "WITH " + LADDER + """
SELECT c.c_custkey AS key, CASE WHEN r.text IS NOT NULL THEN 'revised' WHEN m.text IS NOT NULL THEN 'master' WHEN s.text IS NOT NULL THEN 'source' END AS rung, coalesce(r.text, m.text, s.text) AS text
FROM customer c LEFT JOIN revised r ON r.key = c.c_custkey LEFT JOIN master m ON m.key = c.c_custkey LEFT JOIN source s ON s.key = c.c_custkey""")
def caption_ladder(spark, sf_dir):
    images, rungs = _ladder(spark, sf_dir)
    return joins.caption_ladder(images.select("key"), rungs)


@query("j02_z07_describe", "WITH " + d.EMITTED + ",\n" + d.KNOWLEDGE + " SELECT e.tag, kind, path, posts FROM (SELECT DISTINCT tag FROM emitted) e LEFT JOIN knowledge USING (tag)")
def describe(spark, sf_dir):
    return joins.describe(d.emitted(spark, sf_dir).select("tag").distinct(), d.knowledge(spark, sf_dir))


@query("j03_b10_two_key_join", """
WITH w AS (SELECT s_suppkey AS id, s_name AS tag, 'NATION_' || CAST(s_nationkey AS VARCHAR) AS title, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'body ' || s_name END AS body FROM supplier),
k AS (SELECT tag AS k, 0 AS o, body, id FROM w UNION ALL SELECT title, 1, body, id FROM w),
b AS (SELECT k, body, row_number() OVER (PARTITION BY k ORDER BY o, id) AS r FROM k WHERE body <> '')
SELECT n.n_name AS tag, b.body FROM nation n LEFT JOIN b ON b.k = n.n_name AND r = 1""")
def two_key_join(spark, sf_dir):
    s = d.table(spark, sf_dir, "supplier")
    wiki = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("tag"), F.concat(F.lit("NATION_"), "s_nationkey").alias("title"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("body "), "s_name")).alias("body"))
    return joins.two_key_join(d.table(spark, sf_dir, "nation").select(F.col("n_name").alias("tag")), wiki)


@query("j04_overlay", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'new ' || c_name ELSE c_name END AS text FROM customer")
def overlay(spark, sf_dir):
    c = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    update = c.where("key % 2 = 0").select("key", F.when(F.col("key") % 3 == 0, "  ").otherwise(F.concat(F.lit("new "), "text")).alias("text"))
    return joins.overlay(c, update, "key", "text")


@query("j05_y07_rename_fallback", """
WITH v AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, length(name) AS col FROM v WHERE name NOT LIKE 'red %' AND name NOT LIKE 'old %'),
r AS (SELECT replace(name, 'red ', 'blue ') AS old, name AS new FROM v WHERE name LIKE 'red %')
SELECT v.name, coalesce(c.col, o.col) AS col FROM v LEFT JOIN c USING (name) LEFT JOIN (SELECT r.new AS name, c.col FROM r JOIN c ON c.name = r.old) o USING (name)""")
def rename_fallback(spark, sf_dir):
    v = d.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    columns = v.where("name not like 'red %' and name not like 'old %'").select("name", F.char_length("name").cast("long").alias("col"))
    renames = v.where("name like 'red %'").select(F.replace("name", F.lit("red "), F.lit("blue ")).alias("old"), F.col("name").alias("new"))
    return joins.with_fallback(v, columns, renames)


@query("j06_j07_resolve_groups", "WITH " + d.KNOWLEDGE + """,
v AS (SELECT tag, row_number() OVER (ORDER BY tag) AS i FROM knowledge WHERE posts >= 40)
SELECT kind AS grp, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS indices FROM knowledge k JOIN v USING (tag) GROUP BY kind""")
def resolve_groups(spark, sf_dir):
    kb = d.knowledge(spark, sf_dir)
    names = kb.where("posts >= 40").select(F.col("tag").alias("name")).withColumn("index", F.row_number().over(Window.orderBy("name")))
    groups, _ = joins.resolve_groups(kb.select(F.col("kind").alias("grp"), F.lit(0).alias("place"), "tag"), names)
    return groups.select("grp", F.array_join("indices", ",").alias("indices"))


@query("j10_manifest", "WITH " + d.BAGS + """
SELECT f.key, CASE WHEN f.key % 11 = 0 THEN 'no-image' WHEN f.rating = 'explicit' THEN 'no-rating' WHEN NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.key = f.key AND o.tag LIKE 'small %') THEN 'no-tag' END AS reason FROM fronts f""")
def manifest(spark, sf_dir):
    rows = d.bags(spark, sf_dir).join(d.fronts(spark, sf_dir).select("key", F.when(F.col("rating") != "explicit", F.col("rating")).alias("rating")), "key")
    names = d.table(spark, sf_dir, "part").where("p_name like 'small %'").select(F.col("p_name").alias("name")).distinct()
    return joins.manifest(rows, d.fronts(spark, sf_dir).where("key % 11 <> 0").select("key"), names)


@query("j11_visible_groups", """
WITH s AS (SELECT vec_id AS key, label AS grp FROM embeddings WHERE vec_id % 3 = 0), k AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM s)
SELECT grp, key FROM k WHERE n >= 2""")
def visible_groups(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("key"))
    return joins.visible_groups(e, e.where("key % 3 = 0").select("key"))[0]


@query("j17_h08_exclusions", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0")
def exclusions(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return joins.not_excluded(o, o.where("key % 4 = 0"), o.where("key % 7 = 0"), "key")


@query("a09_t05_first_source", """
WITH u AS (SELECT s_nationkey AS k, 0 AS d, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, 1, c_name FROM customer)
SELECT k, arg_min(name, d * 1000000000 + rank) AS name FROM (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY name) AS rank FROM u) GROUP BY k""")
def first_source(spark, sf_dir):
    s = d.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("d"), F.col("s_name").alias("name"))
    c = d.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("d"), F.col("c_name").alias("name"))
    return joins.first_by(s.unionByName(c), ["k"], [F.col("d"), F.col("name")]).select("k", "name")


@query("a03_unique_keys", "SELECT o_orderkey AS key, count(*) AS n FROM orders GROUP BY 1")
def unique_keys(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    check_grid(o, ["key"])
    return o.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("a29_expand_runs", """
SELECT n_nationkey AS place, n_name AS tag, CASE WHEN n_nationkey < 5 THEN 'general' WHEN n_nationkey < 9 THEN 'character' ELSE 'artist' END AS category FROM nation WHERE n_nationkey < 20""")
def expand_runs(spark, sf_dir):
    from ..sources.files import expand_runs as expand

    runs = spark.createDataFrame([(0, "general", 5), (1, "character", 4), (2, "artist", 11)], "i int, category string, length int")
    return expand(d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("tag")), runs)


# Lines -----------------------------------------------------------------------
def _lines(spark, sf_dir):
    return d.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.col("role").alias("kind"), "text")


@query("f29_f30_f33_line_text", r"""
SELECT conv_id AS page, turn AS seq, replace(replace(text, '\', '\\'), chr(10), '\n') AS escaped, replace(replace(replace(text, '"', '”'), chr(13) || chr(10), chr(10)), chr(10), '\n') AS quoted,
       length(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS chars, regexp_matches(text, '^[\x00-\x7F]*$') AS latin_only, regexp_matches(text, '^[^\x00-\x7F]*$') AS no_ascii FROM conversations""")
def line_text(spark, sf_dir):
    c = F.col("text")
    return _lines(spark, sf_dir).select("page", "seq", ln.escape_text(c).alias("escaped"), ln.quote_text(c).alias("quoted"), ln.char_count(c).cast("long").alias("chars"), ln.is_latin_only(c).alias("latin_only"), c.rlike(r"^[^\x00-\x7F]*$").alias("no_ascii"))


@query("f29_escape_round_trip", "SELECT count(*) AS n, count(*) AS same FROM conversations")
def escape_round_trip(spark, sf_dir):
    c = F.col("text")
    return _lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(ln.unescape_text(ln.escape_text(c)) == c).alias("same"))


SOUNDS = ("ぱん♡ぱん♡", "びくッ", "ドキドキ", "あはは", "チラッ", "漢字テスト", "ふわふわふわ", "ザー", "キュン", "おはようございます", "正T正正", "abc", "♡★", "ッッ", "ころころ")
EXPECT = (("ぱん", "sfx"), ("びく", "sfx"), ("ドキ", "sfx"), ("あは", "speech"), ("チラ", "sfx"), ("テスト", "speech"), ("ふわ", "speech"), ("ザ", "sfx"), ("キュン", "sfx"), ("おはようございます", "speech"), ("", "speech"), ("", "speech"), ("", "speech"), ("", "sfx"), ("ころ", "sfx"))


@query("f31_f32_sound_words", "SELECT * FROM (VALUES " + ", ".join(f"({d.quoted(s)}, {d.quoted('あはは' if s == 'あはは' else k)}, {d.quoted(v)})" for s, (k, v) in zip(SOUNDS, EXPECT, strict=True)) + ") AS t(text, sound, kind)")
def sound_words(spark, sf_dir):
    c = F.col("text")
    rows = spark.createDataFrame([(s,) for s in SOUNDS], "text string")
    return rows.select("text", ln.sound_key(c).alias("sound"), ln.line_kind(c).alias("kind"))


@query("f31_f32_line_sounds")
def line_sounds(spark, sf_dir):
    """Sound key and kind of every line."""
    c = F.col("text")
    return _lines(spark, sf_dir).select("page", "seq", ln.sound_key(c).alias("sound"), ln.line_kind(c).alias("kind"))


@query("f34_f39_read_guard")
def read_guard(spark, sf_dir):
    """Normalized reads that neither run away nor overflow their box."""
    c = F.col("text")
    rows = _lines(spark, sf_dir).select("page", "seq", c, (F.lit(200) + F.col("seq") * 10).alias("w"), F.lit(300).alias("h"))
    return rows.select("page", "seq", F.md5(F.coalesce(ln.guard(c, F.col("w"), F.col("h")), F.lit("-"))).alias("guarded"), ln.is_runaway(c).alias("runaway"), ln.has_script(c).alias("script"), F.md5(ln.drop_symbols(c)).alias("bare"))


@query("f37_f41_p13_floors", "WITH " + d.BOXES + """
SELECT image, box, greatest(12, CAST(round_even((x1 - x0) * (y1 - y0) / 196, 0) AS INTEGER)) AS cap, round(sqrt((x1 - x0) * (y1 - y0) / 6), 6) AS glyph FROM boxes WHERE score >= 0.95 AND sqrt((x1 - x0) * (y1 - y0) / 6) >= 80""")
def floors(spark, sf_dir):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = d.boxes(spark, sf_dir).select("image", "box", "score", ln.length_cap(w, h).alias("cap"), ln.glyph_px(w, h, F.lit("glyphs")).alias("g"))
    return rows.where("score >= 0.95 and g >= 80").select("image", "box", "cap", F.round("g", 6).alias("glyph"))


@query("f40_keep_boxes", "WITH " + d.BOXES + """
SELECT image, box FROM boxes WHERE score >= 0.97""")
def keep_boxes(spark, sf_dir):
    """Latin lines with a low detection score live by their read."""
    rows = d.boxes(spark, sf_dir).select("image", "box", ln.keep_box(F.lit("hello"), F.lit(0.3), F.when(F.col("score") >= 0.97, 0.85).otherwise(0.5), F.lit(13.0)).alias("k"))
    return rows.where("k").select("image", "box")


@query("f42_token_confidence", "SELECT vec_id, round(list_avg(p[1:n]), 6) AS confidence FROM (SELECT vec_id, least((66 - vec_id % 64) % 64, (67 - vec_id % 64) % 64) AS n, list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS p FROM embeddings)")
def token_confidence(spark, sf_dir):
    """Token ids count up from vec_id modulo 64, so the stops stand anywhere in a vector."""
    e = d.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("p"))
    return e.select("vec_id", F.round(ln.token_confidence(F.col("p"), F.transform("p", lambda x, i: ((F.col("vec_id") + i) % 64).cast("int")), (2, 3)), 6).alias("confidence"))


#: What Python's strip() takes off.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def whole_line_key():
    return F.concat_ws("|", "kind", F.btrim("text", F.lit(SPACES)))


@query("t01_t03_whole_line_dedupe", f"""
SELECT page, seq, kind FROM (SELECT conv_id AS page, turn AS seq, role AS kind, row_number() OVER (PARTITION BY conv_id, role, trim(text, {d.quoted(SPACES)}) ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def whole_line_dedupe(spark, sf_dir):
    """Lines without later repeats of their whole trimmed text."""
    return joins.deduped_lines(_lines(spark, sf_dir), whole_line_key()).select("page", "seq", "kind")


@query("w10_renumber", "SELECT conv_id AS page, turn AS seq, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM conversations WHERE role <> 'system'")
def renumber(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("kind <> 'system'")
    return rows.select("page", "seq", F.row_number().over(Window.partitionBy("page").orderBy("seq")).alias("place"))


# Geometry --------------------------------------------------------------------
IOU = """greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"""
AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


@query("e01_j15_overlaps", "WITH " + d.BOXES + f""",
p AS (SELECT a.image, a.box AS a, b.box AS b, {IOU} AS i, {AREA.format("a")} + {AREA.format("b")} AS s FROM boxes a JOIN boxes b ON a.image = b.image AND a.box < b.box)
SELECT image, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.3""")
def overlaps(spark, sf_dir):
    return geo.overlapping(d.boxes(spark, sf_dir), 0.3)


@query("e02_suppress")
def suppress(spark, sf_dir):
    return geo.suppress(d.boxes(spark, sf_dir))


@query("e03_t07_merge_parts")
def merge_parts(spark, sf_dir):
    b = d.boxes(spark, sf_dir)
    return geo.merge_parts(b.where("score >= 0.95"), b.where("score < 0.95 and score >= 0.5"))


@query("e05_denest_inner", "WITH " + d.BOXES + f""",
h AS (SELECT a.image, a.box, count(*) AS n, sum({AREA.format("b")} * b.score) AS w, max({AREA.format("a")} * a.score) AS own
      FROM boxes a JOIN boxes b ON a.image = b.image AND a.box <> b.box WHERE {AREA.format("b")} < {AREA.format("a")} AND {IOU} / ({AREA.format("b")}) >= 0.85 GROUP BY a.image, a.box)
SELECT image, box FROM boxes WHERE (image, box) NOT IN (SELECT (image, box) FROM h WHERE n >= 2 AND w / greatest(own, 1e-9) >= 0.2)""")
def denest_inner(spark, sf_dir):
    return geo.denest(d.boxes(spark, sf_dir)).select("image", "box")


@query("e05_denest_outer", "WITH " + d.BOXES + f"""
SELECT image, box FROM boxes WHERE (image, box) NOT IN (
  SELECT (a.image, a.box) FROM boxes a JOIN boxes b ON a.image = b.image AND a.box <> b.box WHERE {AREA.format("b")} > {AREA.format("a")} AND {IOU} / ({AREA.format("a")}) >= 0.85)""")
def denest_outer(spark, sf_dir):
    return geo.denest(d.boxes(spark, sf_dir), "outer").select("image", "box")


@query("e06_drop_nested", "WITH " + d.BOXES + f""",
k AS (SELECT *, box % 2 AS kind FROM boxes)
SELECT image, box FROM k WHERE (image, box) NOT IN (
  SELECT (a.image, a.box) FROM k a JOIN k b ON a.image = b.image AND a.kind = b.kind WHERE {AREA.format("b")} > {AREA.format("a")} AND {IOU} / ({AREA.format("a")}) >= 0.85)""")
def drop_nested(spark, sf_dir):
    return geo.drop_nested(d.boxes(spark, sf_dir).withColumn("kind", F.col("box") % 2)).select("image", "box")


@query("e07_uncovered", "WITH " + d.BOXES + f""",
c AS (SELECT * FROM boxes WHERE box % 2 = 0), l AS (SELECT * FROM boxes WHERE box % 2 = 1)
SELECT image, box FROM c WHERE (image, box) NOT IN (
  SELECT (a.image, a.box) FROM c a JOIN l b ON a.image = b.image
  WHERE {IOU} / ({AREA.format("a")} + {AREA.format("b")} - {IOU}) >= 0.3 OR {IOU} / least({AREA.format("a")}, {AREA.format("b")}) >= 0.5)""")
def uncovered(spark, sf_dir):
    b = d.boxes(spark, sf_dir)
    return geo.uncovered(b.where("box % 2 = 0"), b.where("box % 2 = 1")).select("image", "box")


@query("e08_decode_head", """
SELECT l_orderkey AS image, least(greatest(l_quantity * 10 - 40, 0), 640.0) AS x0, least(greatest(l_quantity * 10 + 40, 0), 640.0) AS x1, round(1 - l_discount, 2) AS score FROM lineitem WHERE round(1 - l_discount, 2) >= 0.95""")
def decode_head(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("image"), F.lit(0).alias("box"), (F.col("l_quantity") * 10).alias("cx"), F.lit(10.0).alias("cy"), F.lit(80.0).alias("w"), F.lit(8.0).alias("h"), F.round(1 - F.col("l_discount"), 2).alias("score"))
    return geo.decode_head(rows, 0.95, 640).select("image", "x0", "x1", "score")


@query("p14_largest", "WITH " + d.BOXES + f"""
SELECT image, box FROM (SELECT a.*, row_number() OVER (PARTITION BY image ORDER BY {AREA.format("a")} DESC, box) AS r FROM boxes a WHERE least(x1 - x0, y1 - y0) >= 130 AND score >= 0.93) WHERE r <= 2""")
def largest(spark, sf_dir):
    return geo.largest(d.boxes(spark, sf_dir), 130, 0.93, 2).select("image", "box")


@query("w06_reading_order", "WITH " + d.BOXES + """,
p AS (SELECT image, sum(CASE WHEN CAST(y1 - y0 AS INTEGER) >= 1.5 * CAST(x1 - x0 AS INTEGER) THEN 1 ELSE 0 END) * 2 >= count(*) AS columns,
      list_sort(list(CAST(x1 - x0 AS INTEGER))) AS w, list_sort(list(CAST(y1 - y0 AS INTEGER))) AS h FROM boxes GROUP BY image),
b AS (SELECT image, columns, greatest(1, floor((CASE WHEN columns THEN w[len(w) // 2 + 1] ELSE h[len(h) // 2 + 1] END) / 2)) AS band FROM p)
SELECT image, box, CAST(row_number() OVER (PARTITION BY image ORDER BY CASE WHEN columns THEN -floor(x1 / band) ELSE floor(y0 / band) END, CASE WHEN columns THEN y0 ELSE x0 END, box) AS INTEGER) AS place
FROM boxes JOIN b USING (image)""")
def reading_order(spark, sf_dir):
    return geo.reading_order(d.boxes(spark, sf_dir)).select("image", "box", "place")


@query("w08_lanes", "WITH " + d.BOXES + """,
g AS (SELECT *, (x0 + x1) / 2 AS c, lag((x0 + x1) / 2) OVER w AS pc, lag(x1 - x0) OVER w AS pw FROM boxes WINDOW w AS (PARTITION BY image ORDER BY (x0 + x1) / 2, box))
SELECT image, box, CAST(sum(CASE WHEN c - pc > 0.5 * least(x1 - x0, pw) THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY c, box) AS INTEGER) AS lane FROM g""")
def lanes(spark, sf_dir):
    return geo.lanes(d.boxes(spark, sf_dir)).select("image", "box", "lane")


@query("w07_rows", "WITH RECURSIVE " + d.BOXES + """,
s AS (SELECT image, box, y0, y1, row_number() OVER (PARTITION BY image ORDER BY y0, y1, box) AS r FROM boxes),
f AS (SELECT image, box, r, y0 AS low, y1 AS high, 0 AS row FROM s WHERE r = 1
  UNION ALL SELECT s.image, s.box, s.r,
    CASE WHEN least(f.high - f.low, s.y1 - s.y0) <= 0 OR least(f.high, s.y1) - greatest(f.low, s.y0) < 0.25 * least(f.high - f.low, s.y1 - s.y0) THEN s.y0 ELSE least(f.low, s.y0) END,
    CASE WHEN least(f.high - f.low, s.y1 - s.y0) <= 0 OR least(f.high, s.y1) - greatest(f.low, s.y0) < 0.25 * least(f.high - f.low, s.y1 - s.y0) THEN s.y1 ELSE greatest(f.high, s.y1) END,
    f.row + CASE WHEN least(f.high - f.low, s.y1 - s.y0) <= 0 OR least(f.high, s.y1) - greatest(f.low, s.y0) < 0.25 * least(f.high - f.low, s.y1 - s.y0) THEN 1 ELSE 0 END
  FROM f JOIN s ON s.image = f.image AND s.r = f.r + 1)
SELECT image, box, row FROM f""")
def box_rows(spark, sf_dir):
    return geo.rows_of(d.boxes(spark, sf_dir)).select("image", "box", "row")


@query("w09_positions")
def positions(spark, sf_dir):
    return geo.assign_positions(d.boxes(spark, sf_dir))


@query("e09_e10_padding", "WITH " + d.BOXES + """,
g AS (SELECT *, round_even(0.12 * greatest(x1 - x0, y1 - y0), 0) AS g, least(0.12 * greatest(x1 - x0, y1 - y0), 0.3 * least(x1 - x0, y1 - y0), 4) AS p FROM boxes)
SELECT image, box, greatest(0.0, x0 - g) AS px0, least(1000.0, x1 + g) AS px1, round_even(greatest(0.0, x0 - p), 0) AS tx0, round_even(least(1000.0, y1 + p), 0) AS ty1,
       CAST(round_even(least(greatest(y0, 0), 1000) - 500, 0) AS INTEGER) AS cy0 FROM g""")
def padding(spark, sf_dir):
    b, side = geo.box(), F.lit(1000.0)
    p, q, c = geo.pad_box(b, side, side), geo.tight_pad_box(b, side, side), geo.centred_box(b, side, side)
    return d.boxes(spark, sf_dir).select("image", "box", p[0].alias("px0"), p[2].alias("px1"), q[0].alias("tx0"), q[3].alias("ty1"), c[0].alias("cy0"))


def _sizes(spark, sf_dir):
    return d.boxes(spark, sf_dir).select("image", (F.col("x1") * 4).cast("int").alias("width"), (F.col("y1") * 4).cast("int").alias("height")).distinct()


@query("e11_e12_k20_buckets", "WITH " + d.BOXES + """,
i AS (SELECT DISTINCT image, CAST(x1 * 4 AS INTEGER) AS width, CAST(y1 * 4 AS INTEGER) AS height FROM boxes),
t(i, edge, low, high) AS (VALUES (0, 512, 1008, 1024), (1, 768, 2160, 2160), (2, 896, 3000, 3024), (3, 1024, 4032, 4200), (4, 1280, 6300, 6300), (5, 1536, 8640, 8640)),
z AS (SELECT DISTINCT width, height FROM i),
e AS (SELECT width, height, arg_min(edge, i) AS edge FROM (SELECT z.*, t.*, abs(ln(((low + high) / 2) / ((width / 16.0) * (height / 16.0)))) AS c, min(abs(ln(((low + high) / 2) / ((width / 16.0) * (height / 16.0))))) OVER (PARTITION BY width, height) AS m FROM z, t) WHERE c = m GROUP BY width, height),
b AS (SELECT edge, CASE WHEN edge = 1024 THEN low ELSE round_even(low * 0.975, 0) END AS low, CASE WHEN edge = 1024 THEN high ELSE round_even(high * 1.025, 0) END AS high FROM t),
g AS (SELECT edge, hp, wp FROM b, unnest(range(1, 257)) AS u(hp), unnest(range(1, 257)) AS v(wp) WHERE hp * wp BETWEEN low AND high),
r AS (SELECT e.width, e.height, e.edge, hp, wp, row_number() OVER (PARTITION BY e.width, e.height ORDER BY
        round(abs(wp / hp - least(greatest(e.width / e.height, 0.25), 4.0)), 12), round(abs(ln(greatest(wp * 16 / e.width, hp * 16 / e.height))), 12), hp, wp) AS k FROM e JOIN g USING (edge))
SELECT edge, CAST(wp * 16 AS INTEGER) AS bucket_width, CAST(hp * 16 AS INTEGER) AS bucket_height, count(*) AS n FROM i JOIN r ON r.width = i.width AND r.height = i.height AND k = 1 GROUP BY ALL""")
def buckets(spark, sf_dir):
    return geo.fit_buckets(spark, _sizes(spark, sf_dir)).groupBy("edge", "bucket_width", "bucket_height").agg(F.count(F.lit(1)).alias("n"))


@query("e12_e13_margins", "WITH " + d.BOXES + """,
i AS (SELECT DISTINCT image, CAST(x1 * 4 AS INTEGER) AS width, CAST(y1 * 4 AS INTEGER) AS height FROM boxes)
SELECT image, width, height, round_even(width * 10 / 100, 0) AS mx0, greatest(round_even(height * 5 / 100, 0) + 1, round_even(height - height * 20 / 100, 0)) AS my1,
  CASE WHEN width * height > 4096 * 256 THEN CAST(greatest(1, floor(width * sqrt(4096 * 256.0 / (width * height)))) AS INTEGER) END AS capped FROM i""")
def margins(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    m = geo.margin_box(w, h, 5, 0, 20, 10)
    return _sizes(spark, sf_dir).select("image", "width", "height", m[0].cast("double").alias("mx0"), m[3].cast("double").alias("my1"), geo.capped_size(w, h, 4096)[0].alias("capped"))


# Ranking and metrics ---------------------------------------------------------
@query("l01_precision_recall", "WITH " + d.SCORES + """
, p AS (SELECT tag, sum(CASE WHEN score >= 0.6 THEN truth ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS p, sum(truth) AS s FROM scores GROUP BY tag),
r AS (SELECT tag, tp / greatest(p, 1) AS precision, tp / greatest(s, 1) AS recall, s FROM p)
SELECT tag, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, CAST(s AS BIGINT) AS support FROM r""")
def precision_recall(spark, sf_dir):
    return metrics.precision_recall(d.scores(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.6).cast("int")))


@query("l02_average_precision", "WITH " + d.SCORES + """
SELECT tag, round(avg(CASE WHEN truth = 1 THEN p END), 9) AS ap FROM (SELECT tag, truth, sum(truth) OVER w / row_number() OVER w AS p FROM scores WINDOW w AS (PARTITION BY tag ORDER BY score DESC, sample)) GROUP BY tag""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(d.scores(spark, sf_dir))


@query("l03_micro_f1", "WITH " + d.SCORES + " SELECT round(2 * sum(CASE WHEN score >= 0.6 THEN truth ELSE 0 END) / greatest(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) + sum(truth), 1), 9) AS micro_f1 FROM scores")
def micro_f1(spark, sf_dir):
    return metrics.micro_f1(d.scores(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.6).cast("int")))


@query("l04_thresholds", "WITH " + d.SCORES + """,
s AS (SELECT tag, k, round(2 * sum(CASE WHEN score > round(k * 0.05, 2) THEN truth ELSE 0 END) / greatest(sum(CASE WHEN score > round(k * 0.05, 2) THEN 1 ELSE 0 END) + sum(truth), 1), 9) AS f1 FROM scores, unnest(range(1, 20)) AS u(k) GROUP BY tag, k),
r AS (SELECT tag, k, f1, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, k) AS r FROM s)
SELECT tag, CASE WHEN f1 <= 0 THEN 0.5 ELSE round(k * 0.05, 2) END AS threshold, f1 FROM r WHERE r = 1""")
def thresholds(spark, sf_dir):
    return metrics.best_thresholds(d.scores(spark, sf_dir))


@query("l05_reliability", "WITH " + d.SCORES + " SELECT CAST(least(floor(score * 15), 14) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS confidence, round(avg(truth), 9) AS accuracy FROM scores GROUP BY 1")
def reliability(spark, sf_dir):
    return metrics.reliability(d.scores(spark, sf_dir))


@query("l05_l06_expected_error", "WITH " + d.SCORES + ", b AS (SELECT count(*) AS n, round(avg(score), 9) AS c, round(avg(truth), 9) AS a FROM scores GROUP BY least(floor(score * 15), 14)) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def expected_error(spark, sf_dir):
    return metrics.expected_error(d.scores(spark, sf_dir))


@query("l07_slices", "WITH " + d.SCORES + """
, t AS (SELECT tag % 3 AS slice, tag, sum(CASE WHEN score >= 0.6 THEN truth ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS p, sum(truth) AS s FROM scores GROUP BY tag)
SELECT slice, round(2 * sum(tp) / greatest(sum(p) + sum(s), 1), 9) AS micro, round(avg(2 * tp / greatest(p + s, 1)), 9) AS macro FROM t GROUP BY slice""")
def slices(spark, sf_dir):
    fired = (F.col("score") >= 0.6).cast("int")
    per = d.scores(spark, sf_dir).groupBy("tag").agg(F.sum(fired * F.col("truth")).alias("tp"), F.sum(fired).alias("p"), F.sum("truth").alias("s"))
    one = F.greatest(F.col("p") + F.col("s"), F.lit(1))
    return per.groupBy((F.col("tag") % 3).alias("slice")).agg(F.round(2 * F.sum("tp") / F.greatest(F.sum("p") + F.sum("s"), F.lit(1)), 9).alias("micro"), F.round(F.avg(2 * F.col("tp") / one), 9).alias("macro"))


@query("l08_y04_read_back", "WITH " + d.SCORES + """
, c AS (SELECT label AS caption, (label + k) % 10 AS tag FROM (SELECT DISTINCT label FROM embeddings), unnest(range(3)) AS u(k))
SELECT caption, sample AS image, round(avg(-ln(1 + exp(-(ln(least(greatest(score, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(score, 1e-6), 1 - 1e-6)))))), 9) AS value FROM c JOIN scores USING (tag) GROUP BY ALL""")
def read_back(spark, sf_dir):
    captions = d.table(spark, sf_dir, "embeddings").select(F.col("label").alias("caption")).distinct()
    captions = captions.withColumn("tag", F.explode(F.array(*[(F.col("caption") + k) % 10 for k in range(3)])))
    logits = d.scores(spark, sf_dir).select(F.col("sample").alias("image"), "tag", metrics.to_logit(F.col("score")).alias("logit"))
    return metrics.read_back(captions, logits)


@query("w02_group_winner", "WITH " + d.SCORES + """
SELECT sample AS image, grp, tag, score FROM (SELECT sample, tag % 3 AS grp, tag, score, row_number() OVER (PARTITION BY sample, tag % 3 ORDER BY score DESC, tag) AS r FROM scores) WHERE r = 1 AND score >= 0.5 + 0.01 * tag""")
def group_winner(spark, sf_dir):
    s = d.scores(spark, sf_dir).select(F.col("sample").alias("image"), "tag", "score", (F.col("tag") % 3).alias("grp"))
    return metrics.group_winner(s, s.select("tag").distinct().withColumn("threshold", 0.5 + 0.01 * F.col("tag")))


@query("w03_top_capped", "WITH " + d.SCORES + """
SELECT sample, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, tag DESC) AS r FROM scores WHERE score >= 0.5) WHERE r <= 1 + sample % 3""")
def top_capped(spark, sf_dir):
    return metrics.top_capped(d.scores(spark, sf_dir).where("score >= 0.5"), 1 + F.col("sample") % 3, ["sample"]).select("sample", "tag", "score")


@query("w12_j14_best_margin", "WITH " + d.SCORES + """, r AS (SELECT sample, tag, score, row_number() OVER (PARTITION BY sample ORDER BY score DESC, tag) AS r FROM scores)
SELECT sample, max(CASE WHEN r = 1 THEN tag END) AS best, max(CASE WHEN r = 1 THEN score END) AS best_score, round(max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END), 9) AS margin FROM r WHERE r <= 2 GROUP BY sample""")
def best_margin(spark, sf_dir):
    return metrics.best_margin(d.scores(spark, sf_dir), "sample", "score", "tag")


@query("w01_y05_argmax", """
WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS p FROM embeddings)
SELECT vec_id, list_position(p, list_max(p)) - 1 AS rating, round(list_max(p) / list_sum(p), 9) AS share FROM p""")
def argmax(spark, sf_dir):
    p = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x: 1 / (1 + F.exp(-x)))
    e = d.table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return e.select("vec_id", metrics.argmax_first(F.col("p")).cast("long").alias("rating"), F.round(F.array_max(metrics.ratings_normalized(F.col("p"))), 9).alias("share"))


@query("w05_popularity", "WITH " + d.KNOWLEDGE + " SELECT tag, CAST(row_number() OVER (ORDER BY posts DESC, tag) AS INTEGER) AS place FROM knowledge")
def popularity(spark, sf_dir):
    return d.knowledge(spark, sf_dir).select("tag", F.row_number().over(Window.orderBy(F.desc("posts"), "tag")).alias("place"))


@query("p16_bag_relaxation", "WITH " + d.SCORES + " SELECT sample, tag, score FROM scores WHERE score < 0.6 AND score >= greatest(0.6 * 0.35 * power(0.85, tag % 3), 0.3) AND tag % 2 = 0")
def bag_relaxation(spark, sf_dir):
    s = d.scores(spark, sf_dir).where("tag % 2 = 0")
    floor = F.greatest(0.6 * 0.35 * F.pow(F.lit(0.85), F.col("tag") % 3), F.lit(0.3))
    return s.where((F.col("score") < 0.6) & (F.col("score") >= floor)).select("sample", "tag", "score")


# Vectors ---------------------------------------------------------------------
PAIRS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.label AS bucket, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-8) * (sqrt(list_dot_product(b.v, b.v)) + 1e-8)), 6) AS cosine
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)"""


def _pairs(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))
    # the limit is on the rounded cosine, as in the SQL
    return vectors.near_pairs(e, 0.3 - 5e-7).where("cosine >= 0.3")


@query("j13_v01_v05_near_pairs", "WITH " + PAIRS + " SELECT * FROM pairs WHERE cosine >= 0.3")
def near_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


COMPONENTS = "WITH RECURSIVE " + PAIRS + """,
g AS (SELECT a, b FROM pairs WHERE cosine >= 0.3), h AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
r AS (SELECT vec_id AS id, vec_id AS seen FROM e UNION SELECT r.id, h.b FROM r JOIN h ON h.a = r.seen),
c AS (SELECT id, min(seen) AS component FROM r GROUP BY id)"""


def _components(spark, sf_dir):
    nodes = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return vectors.components(spark, nodes, _pairs(spark, sf_dir).select("a", "b"))


@query("v06_components", COMPONENTS + " SELECT id, component FROM c")
def components(spark, sf_dir):
    return _components(spark, sf_dir)


@query("v07_v08_w13_groups", COMPONENTS + " SELECT component, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS INTEGER) AS group FROM c GROUP BY component HAVING count(*) >= 2".replace("AS group", 'AS "group"'))
def groups(spark, sf_dir):
    return vectors.groups(_components(spark, sf_dir))


@query("k21_mean_cosine", COMPONENTS + """, m AS (SELECT component, v, sqrt(list_dot_product(v, v)) + 1e-8 AS n FROM c JOIN e ON e.vec_id = c.id),
s AS (SELECT component, d, sum(v[d] / n) AS s, count(*) AS k FROM m, unnest(range(1, 65)) AS u(d) GROUP BY component, d)
SELECT component, max(k) AS size, round(CASE WHEN max(k) > 1 THEN (sum(s * s) - max(k)) / (max(k) * (max(k) - 1)) ELSE 1 END, 4) AS mean_cosine FROM s GROUP BY component""")
def mean_cosine(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.mean_pairwise_cosine(_components(spark, sf_dir).join(v, "id").select("component", "vector"))


@query("v09_v10_pair_tiers", "WITH " + PAIRS + """, t AS (SELECT a, b, cosine, bit_count(xor(a * 2654435761, b * 2654435761)) AS ham, abs((a % 7) / 10.0 - (b % 7) / 10.0) > 0.06 AS skew FROM pairs WHERE cosine >= 0.2),
s AS (SELECT *, CASE WHEN skew THEN -1 ELSE 0.5 * (1 - ham / 64) + 0.25 * (cosine + 1) END AS score FROM t)
SELECT a, b, CAST(ham AS INTEGER) AS ham, round(score, 6) AS score, CASE WHEN score < 0 THEN 'skip' WHEN ham <= 6 AND cosine >= 0.95 THEN 'auto' WHEN ham <= 12 THEN 'review' ELSE 'skip' END AS tier FROM s""")
def pair_tiers(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))
    p = vectors.near_pairs(e, 0.2 - 5e-7).where("cosine >= 0.2")
    ham = vectors.hamming(F.col("a") * 2654435761, F.col("b") * 2654435761)
    score = vectors.pair_score(ham, F.col("cosine"), (F.col("a") % 7) / 10, (F.col("b") % 7) / 10)
    return p.select("a", "b", ham.alias("ham"), F.round(score, 6).alias("score"), vectors.pair_tier(ham, F.col("cosine"), score).alias("tier"))


@query("p19_cohabiting", "SELECT vec_id FROM (SELECT vec_id, count(*) OVER (PARTITION BY label, vec_id % 50) AS n FROM embeddings) WHERE n >= 2")
def cohabiting(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings")
    return e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label", F.col("vec_id") % 50))).where("n >= 2").select("vec_id")


@query("v13_a21_h16_work_list", "SELECT vec_id AS path, vec_id % 97 AS size, label AS mtime FROM embeddings WHERE NOT (vec_id % 2 = 0 AND vec_id % 6 <> 0)")
def work_list(spark, sf_dir):
    from ..sources.files import feature_work

    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), (F.col("vec_id") % 97).alias("size"), F.col("label").alias("mtime"))
    cache = e.where("path % 2 = 0").select("path", F.when(F.col("path") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", F.lit(1).alias("version"))
    return feature_work(e, cache, 1)


# State -----------------------------------------------------------------------
def _proposals(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority")
    targets = o.where("key % 5 <> 4").select("key", F.concat("o_orderpriority", F.lit(" ")).alias("text"))
    before = F.when(F.col("key") % 3 == 0, F.lit("other")).when(F.col("key") % 10 == 9, F.lit("")).otherwise(F.col("o_orderpriority"))
    after = F.when(F.col("key") % 7 == 0, before).when(F.col("key") % 11 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("new "), "o_orderpriority"))
    return targets, o.select("key", before.alias("before"), after.alias("after"))


PROPOSALS = """targets AS (SELECT o_orderkey AS key, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 <> 4),
b AS (SELECT o_orderkey AS key, o_orderpriority AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'other' WHEN o_orderkey % 10 = 9 THEN '' ELSE o_orderpriority END AS before FROM orders),
proposals AS (SELECT key, before, CASE WHEN key % 7 = 0 THEN before WHEN key % 11 = 0 THEN p ELSE 'new ' || p END AS after FROM b),
plan AS (SELECT p.key, p.before, p.after, CASE WHEN after = '' OR after = before THEN 'no-proposal' WHEN t.key IS NULL AND before <> '' THEN 'missing-caption'
  WHEN coalesce(t.text, '') = after THEN 'already-applied' WHEN coalesce(t.text, '') <> before THEN 'drifted' ELSE 'would-write' END AS status FROM proposals p LEFT JOIN targets t USING (key))"""


@query("h01_drift_plan", "WITH " + PROPOSALS + " SELECT key, status FROM plan")
def drift_plan(spark, sf_dir):
    return state.drift_plan(*_proposals(spark, sf_dir)).select("key", "status")


@query("h01_h03_h07_apply", "WITH " + PROPOSALS + " SELECT key, after AS text FROM plan WHERE status = 'would-write' UNION ALL SELECT t.key, trim(t.text) FROM targets t WHERE key NOT IN (SELECT key FROM plan WHERE status = 'would-write')")
def apply(spark, sf_dir):
    targets, proposals = _proposals(spark, sf_dir)
    plan = state.replay(state.drift_plan(targets, proposals), targets)
    return state.applied(targets, plan).select("key", F.btrim("text").alias("text"))


@query("h02_h11_undo", "WITH " + PROPOSALS + " SELECT key, text FROM targets")
def undo(spark, sf_dir):
    """Apply, then undo what was written: the targets are what they were."""
    targets, proposals = _proposals(spark, sf_dir)
    plan = state.drift_plan(targets, proposals)
    after = state.applied(targets, plan)
    return state.undone(after, state.undo_plan(after, plan.where("status = 'would-write'"))).select("key", F.btrim("text").alias("text"))


@query("k17_k19_stage_counts", "WITH " + PROPOSALS + " SELECT status, count(*) AS n FROM plan GROUP BY status")
def stage_counts(spark, sf_dir):
    return state.drift_plan(*_proposals(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


HISTORY = """e AS (SELECT user_id AS key, event_type AS text, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS seq FROM e WHERE p IS DISTINCT FROM text)"""


@query("h12_w11_q06_history", "WITH " + HISTORY + " SELECT key, CAST(seq AS INTEGER) AS seq, text FROM (SELECT *, max(seq) OVER (PARTITION BY key) AS m FROM s) WHERE seq > m - 10")
def history(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("order"), F.col("event_type").alias("text"))
    return state.push_history(e).select("key", "seq", "text")


@query("h08_exclude_ledger", """
SELECT user_id AS rel, min(ts) AS at, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS moved FROM events GROUP BY user_id""")
def exclude_ledger(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("rel"), F.col("ts").alias("at"), F.array("event_type").alias("moved"), "event_id")
    out = state.exclude(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))
    return out.select("rel", "at", F.array_join("moved", ",").alias("moved"))


PUBLISH = """s AS (SELECT c_custkey AS rel, c_name AS c FROM customer WHERE c_custkey % 4 <> 0), t AS (SELECT c_custkey AS rel, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_name END AS c FROM customer WHERE c_custkey % 5 <> 0),
plan AS (SELECT coalesce(s.rel, t.rel) AS rel, CASE WHEN s.rel IS NULL THEN 'would-remove' WHEN t.rel IS NULL THEN 'would-create' WHEN s.c = t.c THEN 'identical' ELSE 'would-overwrite' END AS status FROM s FULL JOIN t USING (rel))"""


def _publish(spark, sf_dir):
    c = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rel"), F.col("c_name").alias("content"))
    return state.publish_plan(c.where("rel % 4 <> 0"), c.where("rel % 5 <> 0").withColumn("content", F.when(F.col("rel") % 3 == 0, "old").otherwise(F.col("content"))))


@query("h09_h10_publish_plan", "WITH " + PUBLISH + " SELECT rel, status FROM plan")
def publish_plan(spark, sf_dir):
    return _publish(spark, sf_dir)


@query("h11_publish_revert", "WITH " + PUBLISH + " SELECT rel, CASE status WHEN 'would-create' THEN 'remove' WHEN 'would-overwrite' THEN 'restore' ELSE 'recreate' END AS action FROM plan WHERE status <> 'identical'")
def publish_revert(spark, sf_dir):
    return state.publish_revert(_publish(spark, sf_dir))


@query("h15_b03_overwrite_whole_text", "SELECT DISTINCT conv_id AS page, turn AS seq, CASE WHEN conv_id % 2 = 0 THEN text || '|' || role ELSE text END AS text FROM conversations WHERE NOT (conv_id % 2 = 0 AND role = 'system')")
def overwrite_whole_text(spark, sf_dir):
    """Whole lines; the new text of a line ends in its role."""
    old = _lines(spark, sf_dir).select("page", "seq", "text", "kind")
    new = old.where("page % 2 = 0").select("page", "seq", F.when(F.col("kind") == "system", "").otherwise(F.concat_ws("|", "text", "kind")).alias("text"))
    return state.overwrite_by_key(old.drop("kind"), new, ["page"], F.col("text") == "").distinct()


# Streams ---------------------------------------------------------------------
@query("q01_q05_progress_stream", "SELECT event_type AS step, count(*) AS n, CAST(max(event_id) AS BIGINT) AS done FROM events GROUP BY 1")
def progress_stream(spark, sf_dir):
    """The event log as a stream of files, read through once and merged by step."""
    from ..streaming.events import upsert

    source = spark.readStream.schema(d.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = f"{named.rstrip('/')}/stream" if named else tempfile.mkdtemp(prefix="stream-")

    def merge(batch, number):
        batch.groupBy(F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("done")).write.mode("append").parquet(out)

    out = f"{place}/{uuid.uuid4().hex}/out"
    run = upsert(source, merge, f"{place}/{uuid.uuid4().hex}/log")
    run.awaitTermination()
    return spark.read.parquet(out).groupBy("step").agg(F.sum("n").alias("n"), F.max("done").alias("done"))
