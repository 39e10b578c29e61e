"""Queries: proposals, reports, publishing, groups, overrides, hashes, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tags as t
from ..operators import curation as c
from ..operators import joins, metrics, rules, stages, state
from ..sources import files
from . import captions as caps
from . import domain as d
from .registry import query

GROUPS = [("first_brands", ["Brand#1"]), ("second_brands", ["Brand#2"])]
SELECTORS = ["character", "first_brands", "Brand#21", "copyright"]
#: the first selector of a tag, in SQL
SELECTOR = """CASE WHEN kind = 'character' THEN 'character' WHEN kind = 'copyright' THEN 'copyright' WHEN kind = 'meta' THEN NULL
  WHEN starts_with(path, 'Brand#1') THEN 'first_brands' WHEN starts_with(path, 'Brand#21') THEN 'Brand#21' END"""


def _autotag(mode):
    def run(spark, sf_dir):
        bags = d.bags(spark, sf_dir)
        new = F.when(F.col("key") % 3 == 0, F.slice("tags", 1, 1)).otherwise(F.array(F.concat(F.lit("smile "), F.col("key") % 5), F.col("tags")[0]))
        predictions = bags.where("key % 11 <> 0").select("key", new.alias("tags"))
        return stages.autotag_proposals(bags.select("key"), bags.where("key % 4 <> 0"), predictions, mode)

    return run


def _autotag_sql(kept, there):
    return "WITH " + d.BAGS + f"""
, r AS (SELECT key, CASE WHEN key % 4 <> 0 THEN tags END AS old,
  CASE WHEN key % 11 <> 0 THEN CASE WHEN key % 3 = 0 THEN [tags[1]] ELSE ['smile ' || (key % 5), tags[1]] END END AS new FROM bags)
, p AS (SELECT key, old, new, CASE WHEN old IS NULL THEN new ELSE {kept} END AS after FROM r)
, q AS (SELECT key, coalesce(array_to_string(old, ', '), '') AS before, coalesce(array_to_string(after, ', '), '') AS after, old, new FROM p)
, z AS (SELECT key, before, after, CASE {there} WHEN new IS NULL THEN 'no-prediction' WHEN before = after THEN 'unchanged' ELSE 'ok' END AS status FROM q)
SELECT key, before, CASE WHEN status = 'ok' THEN after ELSE before END AS proposed, status FROM z"""


query("h06_autotag_missing", _autotag_sql("old", "WHEN old IS NOT NULL THEN 'has-caption'"))(_autotag("missing"))
query("h06_p10_autotag_merge", _autotag_sql("old || list_filter(coalesce(new, []), lambda x: NOT list_contains(old, x))", ""))(_autotag("merge"))
query("h06_autotag_overwrite", _autotag_sql("new", ""))(_autotag("overwrite"))


@query("h06_drop_proposals", "WITH " + d.EMITTED + ", " + d.KNOWLEDGE + f"""
, m AS (SELECT key, pos, e.tag, {SELECTOR} AS selector FROM emitted e LEFT JOIN knowledge k ON e.tag = k.tag)
, g AS (SELECT key, string_agg(tag, ', ' ORDER BY pos) AS before, coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (WHERE selector IS NULL), '') AS proposed,
  coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (WHERE selector IS NOT NULL), '') AS dropped FROM m GROUP BY key)
SELECT *, CASE WHEN dropped = '' THEN 'unchanged' ELSE 'ok' END AS status FROM g""")
def drop_proposals(spark, sf_dir):
    return stages.drop_proposals(d.emitted(spark, sf_dir), d.knowledge(spark, sf_dir), GROUPS, SELECTORS)


@query("k19_first_selectors", "WITH " + d.EMITTED + ", " + d.KNOWLEDGE + f"""
SELECT {SELECTOR} AS selector, count(*) AS n FROM emitted e JOIN knowledge k ON e.tag = k.tag GROUP BY 1 HAVING selector IS NOT NULL""")
def first_selectors(spark, sf_dir):
    return stages.selector_counts(d.emitted(spark, sf_dir), d.knowledge(spark, sf_dir), GROUPS, SELECTORS)


REPORTS = """reports AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'autotag' WHEN 1 THEN 'position' WHEN 2 THEN 'correct' ELSE 'drop_groups' END AS stage,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'tree' || (o_custkey % 3) END AS src, CASE WHEN o_orderkey % 17 <> 0 THEN 'out' || (o_custkey % 2) END AS dst, o_orderstatus = 'F' AS applied,
  CASE o_orderkey % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status FROM orders)"""


def _reports(spark, sf_dir):
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 0, "autotag").when(k % 4 == 1, "position").when(k % 4 == 2, "correct").otherwise("drop_groups")
    status = F.when(k % 5 == 0, "proposed").when(k % 5 == 1, "skipped").otherwise("ok")
    return d.table(spark, sf_dir, "orders").select(
        k.alias("id"), stage.alias("stage"), F.when(k % 13 != 0, F.concat(F.lit("tree"), F.col("o_custkey") % 3)).alias("src"), F.when(k % 17 != 0, F.concat(F.lit("out"), F.col("o_custkey") % 2)).alias("dst"),
        (F.col("o_orderstatus") == "F").alias("applied"), status.alias("status"),
    )


@query("h04_report_admission", "WITH " + REPORTS + """
SELECT id, CASE WHEN applied THEN 'already-applied' WHEN src IS NULL OR dst IS NULL THEN 'no-roots' WHEN src <> 'tree1' OR dst <> 'out0' THEN 'other-roots' ELSE 'admitted' END AS verdict FROM reports""")
def report_admission(spark, sf_dir):
    return stages.admission(_reports(spark, sf_dir), F.lit("tree1"), F.lit("out0")).select("id", "verdict")


@query("h05_writable_rows", "WITH " + REPORTS + """
SELECT id, stage, CASE stage WHEN 'position' THEN 'images' ELSE 'rows' END AS rows_key FROM reports WHERE status = CASE stage WHEN 'position' THEN 'proposed' ELSE 'ok' END""")
def writable_rows(spark, sf_dir):
    return stages.writable(_reports(spark, sf_dir), stages.replay_specs(spark)).select("id", "stage", "rows_key")


WRITES = """captions AS (SELECT l_orderkey AS key, 'text ' || max(l_partkey) AS text FROM lineitem GROUP BY 1),
history AS (SELECT l_orderkey AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INTEGER) AS seq, 'old' AS "by", 'text ' || l_partkey AS text FROM lineitem),
writes AS (SELECT o_orderkey AS key, 'new ' || o_custkey AS text FROM orders WHERE o_orderkey % 3 = 0)"""


def _write(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem")
    captions = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.concat(F.lit("text "), F.max("l_partkey")).alias("text"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    history = line.select(F.col("l_orderkey").alias("key"), F.row_number().over(order).alias("seq"), F.lit("old").alias("by"), F.concat(F.lit("text "), "l_partkey").alias("text"))
    writes = d.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("new "), "o_custkey").alias("text"))
    variants = captions.select("key", F.lit("v1").alias("label"), "text")
    return stages.caption_write(captions, history, variants, writes, "autotag", limit=3)


@query("b04_caption_write", "WITH " + WRITES + """
SELECT key, text FROM captions WHERE key NOT IN (SELECT key FROM writes) UNION ALL SELECT key, text FROM writes""")
def caption_write(spark, sf_dir):
    return _write(spark, sf_dir)[0]


@query("b04_caption_history", "WITH " + WRITES + """
, last AS (SELECT key, max(seq) AS top, arg_max(text, seq) AS said FROM history GROUP BY key)
, every AS (SELECT key, seq, "by", text FROM history UNION ALL
  SELECT c.key, CAST(top + 1 AS INTEGER), 'autotag', c.text FROM captions c JOIN writes USING (key) JOIN last USING (key) WHERE said <> c.text)
SELECT key, seq, "by", text FROM every e WHERE seq > (SELECT max(seq) FROM every x WHERE x.key = e.key) - 3""")
def caption_history(spark, sf_dir):
    return _write(spark, sf_dir)[1]


@query("b04_caption_variants", "WITH " + WRITES + " SELECT key, 'v1' AS label, text FROM captions WHERE key NOT IN (SELECT key FROM writes)")
def caption_variants(spark, sf_dir):
    return _write(spark, sf_dir)[2]


LISTINGS = """every AS (SELECT o_orderkey AS k, 'p' || o_orderkey || '.png' AS rel,
  CASE o_orderkey % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'caption' WHEN 2 THEN 'layout' WHEN 3 THEN 'variants' WHEN 4 THEN 'mask' WHEN 5 THEN 'master' ELSE 'index' END AS kind, CAST(o_custkey % 5 AS VARCHAR) AS stamp FROM orders),
source AS (SELECT rel, kind, stamp FROM every WHERE k % 5 <> 0),
destination AS (SELECT rel, kind, CASE WHEN k % 2 = 0 THEN stamp ELSE 'x' END AS stamp FROM every WHERE k % 3 <> 0),
pub AS (SELECT rel, kind, CASE WHEN s.stamp IS NULL THEN CASE WHEN kind = 'layout' THEN 'would-remove' END WHEN t.stamp IS NULL THEN 'would-create' WHEN s.stamp = t.stamp THEN 'identical' ELSE 'would-overwrite' END AS status
  FROM source s FULL JOIN destination t USING (rel, kind))"""


def _listings(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, stages.PUBLISHED)), (k % 7 + 1).cast("int"))
    every = d.table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("p"), k, F.lit(".png")).alias("rel"), kind.alias("kind"), (F.col("o_custkey") % 5).cast("string").alias("stamp"))
    destination = every.where("k % 3 <> 0").select("k", "rel", "kind", F.when(F.col("k") % 2 == 0, F.col("stamp")).otherwise("x").alias("stamp"))
    return every, every.where("k % 5 <> 0").drop("k"), destination.drop("k")


LISTINGS = LISTINGS.replace("WHEN 1 THEN 'caption' WHEN 2 THEN 'layout' WHEN 3 THEN 'variants' WHEN 4 THEN 'mask' WHEN 5 THEN 'master' ELSE 'index'", " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(stages.PUBLISHED) if i))


@query("h09_publish_rows", "WITH " + LISTINGS + """
SELECT rel, kind, status FROM pub WHERE status IS NOT NULL UNION ALL
SELECT rel, kind, 'missing-source' FROM every e WHERE k % 5 = 0 AND k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM pub p WHERE p.rel = e.rel AND p.kind = e.kind AND status IS NOT NULL)""")
def publish_rows(spark, sf_dir):
    every, source, destination = _listings(spark, sf_dir)
    return stages.publish_rows(source, destination, every.where("k % 2 = 0").select("rel", "kind"))


@query("h10_excluded_rows", "WITH " + LISTINGS + """
SELECT '_excluded/' || s.rel AS rel, s.kind, CASE WHEN t.rel IS NULL THEN 'would-create' WHEN s.stamp = t.stamp THEN 'identical' ELSE 'would-overwrite' END AS status
FROM source s LEFT JOIN destination t ON s.rel = t.rel AND s.kind = t.kind WHERE s.kind IN ('image', 'caption', 'variants', 'mask')""")
def excluded_rows(spark, sf_dir):
    _, source, destination = _listings(spark, sf_dir)
    return stages.excluded_rows(source, destination.withColumn("rel", F.concat(F.lit("_excluded/"), "rel")))


@query("h10_stale_siblings", "WITH " + LISTINGS + """
SELECT rel, replace(rel, '.png', '.jpg') AS other FROM every WHERE kind = 'image' AND k % 5 <> 0""")
def stale_siblings(spark, sf_dir):
    _, source, _ = _listings(spark, sf_dir)
    both = source.unionByName(source.withColumn("rel", F.replace("rel", F.lit(".png"), F.lit(".jpg"))))
    return stages.stale_siblings(source, both)


@query("j20_promoted", "WITH " + d.FRONTS + " SELECT key, CASE WHEN key % 3 = 0 THEN 'audited ' || key ELSE people END AS caption FROM fronts")
def promoted(spark, sf_dir):
    rows = d.fronts(spark, sf_dir).select("key", F.col("people").alias("caption"))
    return stages.promoted(rows, rows.where("key % 3 = 0").select("key", F.concat(F.lit("audited "), "key").alias("caption")))


@query("j19_artifacts", """
WITH f AS (SELECT 'f' || (event_id % 40) AS rel, user_id % 9 AS inode, event_id % 3 AS place FROM events)
SELECT rel, inode, CASE min(place) WHEN 0 THEN 'resized' WHEN 1 THEN 'masks' ELSE 'ocr' END AS tree FROM f GROUP BY rel, inode""")
def artifacts(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id") % 40).alias("rel"), (F.col("user_id") % 9).alias("inode"), (F.col("event_id") % 3).alias("place"))
    return stages.artifacts([(name, rows.where(F.col("place") == i)) for i, name in enumerate(("resized", "masks", "ocr"))])


MEMBERS = """members(grp, place, tag) AS (VALUES ('wild', 0, '$category:character'), ('wild', 1, 'cold widget'), ('series', 0, '$category:copyright'), ('series', 1, 'own tag'), ('plain', 0, 'red bolt')),
expanded AS (SELECT grp, place, k.tag FROM members m JOIN knowledge k ON m.tag = '$category:' || k.kind UNION ALL SELECT grp, place, tag FROM members WHERE NOT starts_with(tag, '$category:'))"""


def _members(spark, sf_dir):
    members = spark.createDataFrame([("wild", 0, "$category:character"), ("wild", 1, "cold widget"), ("series", 0, "$category:copyright"), ("series", 1, "own tag"), ("plain", 0, "red bolt")], "grp string, place int, tag string")
    return c.expand_members(members, d.knowledge(spark, sf_dir).select(F.col("tag").alias("name"), F.col("kind").alias("category")))


@query("j07_category_members", "WITH " + d.KNOWLEDGE + ", " + MEMBERS + """
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY place, tag) AS INTEGER) AS place, tag FROM expanded""")
def category_members(spark, sf_dir):
    return _members(spark, sf_dir)[0]


@query("j07_member_clashes", "WITH " + d.KNOWLEDGE + ", " + MEMBERS + """
SELECT tag, array_to_string(list_sort(list(DISTINCT grp)), ', ') AS groups FROM (SELECT * FROM expanded UNION ALL SELECT 'again', 0, tag FROM knowledge WHERE kind = 'character') GROUP BY tag HAVING count(DISTINCT grp) > 1""")
def member_clashes(spark, sf_dir):
    members = spark.createDataFrame([("wild", 0, "$category:character"), ("wild", 1, "cold widget"), ("series", 0, "$category:copyright"), ("series", 1, "own tag"), ("plain", 0, "red bolt"), ("again", 0, "$category:character")], "grp string, place int, tag string")
    return c.expand_members(members, d.knowledge(spark, sf_dir).select(F.col("tag").alias("name"), F.col("kind").alias("category")))[1].select("tag", F.array_join("groups", ", ").alias("groups"))


@query("j09_merge_derived", "WITH " + d.KNOWLEDGE + """
, curated AS (SELECT 'brand_11_economy' AS grp, tag FROM knowledge WHERE posts % 7 = 0)
, fresh AS (SELECT path, trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_') AS grp, tag FROM knowledge)
, left_over AS (SELECT * FROM fresh WHERE grp NOT IN (SELECT grp FROM curated) AND tag NOT IN (SELECT tag FROM curated))
SELECT grp, tag, 'curated' AS origin FROM curated UNION ALL SELECT grp, tag, 'derived' FROM left_over WHERE path IN (SELECT path FROM left_over GROUP BY path HAVING count(*) >= 2)""")
def merge_derived(spark, sf_dir):
    k = d.knowledge(spark, sf_dir)
    return c.merge_derived(k.where("posts % 7 = 0").select(F.lit("brand_11_economy").alias("grp"), "tag"), k.select("path", "tag"), 2)


@query("j08_recovered_paths", "WITH " + d.KNOWLEDGE + """
SELECT CASE WHEN posts % 3 = 0 THEN 'new ' || tag ELSE tag END AS name, path FROM knowledge UNION ALL SELECT 'no such tag', NULL""")
def recovered_paths(spark, sf_dir):
    k = d.knowledge(spark, sf_dir)
    name = F.when(F.col("posts") % 3 == 0, F.concat(F.lit("new "), "tag")).otherwise(F.col("tag"))
    names = k.select(name.alias("name")).unionByName(spark.createDataFrame([("no such tag",)], "name string"))
    return c.recovered_paths(names, k, k.where("posts % 3 = 0").select(name.alias("name"), F.col("tag").alias("old")))


@query("g15_t02_attached_lines", """
WITH l AS (SELECT conv_id AS page, turn AS seq, text, CASE role WHEN 'assistant' THEN 'sfx' ELSE 'speech' END AS kind FROM conversations UNION ALL
  SELECT conv_id, turn + 1000, '  ' || text, CASE role WHEN 'assistant' THEN 'sfx' ELSE 'speech' END FROM conversations UNION ALL
  SELECT DISTINCT conv_id, 5000 + n, s, 'sfx' FROM conversations, (VALUES (0, 'ぱん'), (1, 'ぱんぱん'), (2, 'ぱんっ'), (3, 'どん')) v(n, s))
, k AS (SELECT page, kind, seq, text, CASE WHEN kind = 'speech' THEN trim(text, E' \\t\\n\\r') WHEN text LIKE 'ぱん%' THEN 'ぱん' WHEN text = 'どん' THEN 'どん' ELSE chr(0) || text END AS key FROM l)
, f AS (SELECT page, kind, key, min(seq) AS seq, arg_min(text, seq) AS text FROM k GROUP BY ALL)
, s AS (SELECT page, kind, string_agg('"' || replace(replace(text, '"', '”'), E'\\n', '\\n') || '"', ', ' ORDER BY seq) AS said FROM f GROUP BY ALL)
, p AS (SELECT DISTINCT conv_id AS page FROM conversations)
SELECT page, 'bag' || coalesce('. Japanese text reads as ' || (SELECT said FROM s WHERE s.page = p.page AND kind = 'speech'), '') || coalesce('. Japanese SFX reads as ' || (SELECT said FROM s WHERE s.page = p.page AND kind = 'sfx'), '') AS text FROM p""")
def attached_lines(spark, sf_dir):
    talk = d.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("seq"), "text", F.when(F.col("role") == "assistant", "sfx").otherwise("speech").alias("kind"))
    sounds = spark.createDataFrame([(5000, "ぱん"), (5001, "ぱんぱん"), (5002, "ぱんっ"), (5003, "どん")], "seq long, text string")
    pages = talk.select("page").distinct()
    said = pages.join(F.broadcast(sounds)).select("page", "seq", "text", F.lit("sfx").alias("kind"))  # four rows
    rows = talk.unionByName(talk.withColumn("seq", F.col("seq") + 1000).withColumn("text", F.concat(F.lit("  "), "text"))).unionByName(said)
    return c.attach_lines(pages.withColumn("text", F.lit("bag")), rows)


@query("g12_audit_population", "WITH " + d.FRONTS + " SELECT key FROM fronts WHERE people NOT IN ('2girls', 'multiple_girls', '6+girls')")
def audit_population(spark, sf_dir):
    """Captions that detection passes by because they have a single subject."""
    return caps.candidates(spark, sf_dir).where("reason = 'single-subject'").select("key")


@query("g17_plain_backgrounds", "WITH " + d.BAGS + """
SELECT key, array_to_string(list_filter(tags || ['white background', 'simple background', 'Grey Background'], lambda x: NOT ends_with(lower(x), 'background') OR (key % 3 = 0 AND x = 'white background')), ', ') AS tags FROM bags""")
def plain_backgrounds(spark, sf_dir):
    bags = d.bags(spark, sf_dir).withColumn("tags", F.concat("tags", F.array(*map(F.lit, ("white background", "simple background", "Grey Background")))))
    plain = F.when(F.col("key") % 3 == 0, F.array(F.lit("White Background"), F.lit("smile"))).otherwise(F.array(F.lit("smile")))
    return bags.select("key", F.array_join(rules.blank_backgrounds(F.col("tags"), plain), ", ").alias("tags"))


@query("p01_replaced_texts", "SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THE ', '') AS text FROM documents")
def replaced_texts(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", rules.apply_replacements(F.col("text"), [("the", "THE"), ("THE ", "")]).alias("text"))


#: tags of an order's number, and which of them say less than another
IMPLYING = (("long hair", "hair", "smile"), ("very long hair", "long hair", "hat"), ("red dress", "dress", "blue dress"), ("smile", "hat", "bow"))


@query("p12_implied_tags", """
SELECT o_orderkey AS key, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['hair'] WHEN 1 THEN ['long hair'] WHEN 2 THEN ['dress'] ELSE [] END) AS tag FROM orders""")
def implied_tags(spark, sf_dir):
    choice = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in IMPLYING]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return rules.implied(d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.explode(choice).alias("tag")))


@query("f20_censor_marks", """
WITH x AS (SELECT o_orderkey AS key, CASE o_orderkey % 6 WHEN 0 THEN 'mosaic censoring' WHEN 1 THEN 'bar_censor' WHEN 2 THEN 'Censored' WHEN 3 THEN 'uncensored' WHEN 4 THEN 'decensored' ELSE 'smile' END AS tag FROM orders)
SELECT key, tag FROM x WHERE tag IN ('mosaic censoring', 'bar_censor', 'Censored')""")
def censor_marks(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, ("mosaic censoring", "bar_censor", "Censored", "uncensored", "decensored", "smile"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), tag.alias("tag")).where(t.is_censor_tag(F.col("tag")))


@query("f10_p20_owned_characters", """
WITH x AS (SELECT o_orderkey AS key, 'shiro (' || CASE o_orderkey % 3 WHEN 0 THEN 'mignon' WHEN 1 THEN 'some series' ELSE 'kat (bu-kunn)' END || ')' AS name, o_orderkey % 4 AS c FROM orders)
SELECT key, name FROM x WHERE c < 2 AND name <> 'shiro (mignon)' AND name <> 'shiro (kat (bu-kunn))'""")
def owned_characters(spark, sf_dir):
    k = F.col("o_orderkey")
    who = F.element_at(F.array(*map(F.lit, ("mignon", "some series", "kat (bu-kunn)"))), (k % 3 + 1).cast("int"))
    rows = d.table(spark, sf_dir, "orders").select(k.alias("key"), F.concat(F.lit("shiro ("), who, F.lit(")")).alias("name"), F.element_at(F.array(*map(F.lit, ("character", "copyright", "general", "meta"))), (k % 4 + 1).cast("int")).alias("category"))
    handles = t.artist_handles(F.array(F.lit("@mignon"), F.lit("@kat (bu-kunn)"), F.lit("@_@ "), F.lit("smile")))
    return c.trainable_rows(rows.withColumn("handle", t.artist_oc_handle(F.col("name"), handles)), ["character", "copyright"]).select("key", "name")


@query("f21_artist_category", """
WITH x AS (SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN '@sincos' WHEN 1 THEN '@ @' WHEN 2 THEN 'smile' ELSE '@' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'meta' ELSE 'artist' END AS category FROM orders)
SELECT key, CASE WHEN category = 'artist' AND name <> '@sincos' THEN 'general' ELSE category END AS category FROM x""")
def artist_category(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("@sincos", "@ @", "smile", "@"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), c.fix_artist_category(F.when(F.col("o_orderkey") % 5 == 0, "meta").otherwise("artist"), name).alias("category"))


@query("f26_escape_hints", "WITH " + d.KNOWLEDGE + """
SELECT path AS grp, x.w || ' ' || tag AS tag FROM knowledge, (VALUES ('two-tone'), ('multicolored')) x(w)""")
def escape_hints(spark, sf_dir):
    k = d.knowledge(spark, sf_dir).select(F.col("path").alias("grp"), "tag")
    words = F.explode(F.array(*map(F.lit, ("two-tone", "multicolored", "plain", "remixed"))))
    return c.escape_hints(k.withColumn("w", words).select("grp", F.concat_ws(" ", "w", "tag").alias("tag")))


@query("p07_bad_overrides", "WITH " + d.KNOWLEDGE + " SELECT tag, CASE WHEN posts % 4 = 0 THEN 'charcter' END AS category FROM knowledge WHERE posts % 4 = 0 OR posts % 5 = 0")
def bad_overrides(spark, sf_dir):
    k = d.knowledge(spark, sf_dir)
    return c.bad_overrides(k.select("tag", F.when(F.col("posts") % 4 == 0, "charcter").when(F.col("posts") % 5 != 0, F.col("kind")).alias("category")))


@query("v11_applied_matches", """
SELECT vec_id AS source, CASE vec_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'likely' ELSE 'weak' END AS tier FROM embeddings WHERE vec_id % 3 < 2 AND vec_id NOT IN (3, 4, 6)""")
def applied_matches(spark, sf_dir):
    tier = F.element_at(F.array(*map(F.lit, ("strong", "likely", "weak"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return c.matched_apply(d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), tier.alias("tier")), ["strong", "likely"], skip=("3", "4", "6"))


@query("v12_caption_tag_sets", "WITH " + d.BAGS + """
SELECT b.key, (SELECT string_agg(DISTINCT replace(tag, '_', ' '), '|' ORDER BY replace(tag, '_', ' ')) FROM emitted e WHERE e.key = b.key AND pos >= 2) AS tags FROM bags b JOIN fronts f USING (key) WHERE people <> 'solo'""")
def caption_tag_sets(spark, sf_dir):
    bags = d.bags(spark, sf_dir).join(d.fronts(spark, sf_dir).where("people <> 'solo'").select("key"), "key", "left_semi")
    return bags.select("key", F.array_join(c.caption_tag_set(F.array_join("tags", ", ")), "|").alias("tags"))


@query("t04_line_boxes", """
WITH l AS (SELECT conv_id AS page, turn AS seq, role AS text, turn * 10 + conv_id AS box FROM conversations)
SELECT page, text, min(box) AS box FROM l GROUP BY page, text""")
def line_boxes(spark, sf_dir):
    rows = d.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.concat(F.lit(" "), "role").alias("text"), (F.col("turn") * 10 + F.col("conv_id")).alias("box"))
    return c.line_boxes(rows)


@query("t06_united_lists", "WITH " + d.EMITTED + """
, u AS (SELECT key, tag, min(pos) AS pos FROM emitted GROUP BY key, tag) SELECT key, string_agg(tag, ', ' ORDER BY pos) AS names FROM u GROUP BY key""")
def united_lists(spark, sf_dir):
    bags = d.bags(spark, sf_dir)
    return bags.select("key", F.array_join(c.united_lists([F.col("tags"), F.slice("tags", 2, 100_000), F.reverse("tags")]), ", ").alias("names"))


@query("k28_listing_summary", "SELECT 'f' || (l_suppkey % 7) AS folder, count(*) AS files, sum(l_partkey) AS bytes FROM lineitem GROUP BY 1")
def listing_summary(spark, sf_dir):
    return c.listing_summary(d.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey") % 7).alias("folder"), F.col("l_partkey").alias("bytes")))


@query("w15_draw_order", r"""
WITH p AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS path FROM part)
SELECT path, 2 AS depth, array_to_string(list_transform(string_split(lower(path), '/'), lambda x: x || chr(1)), '/') AS place FROM p""")
def draw_order(spark, sf_dir):
    return c.draw_order(d.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path")).distinct()).withColumn("depth", F.col("depth").cast("int"))


@query("q02_log_window", """
WITH n AS (SELECT user_id AS job, ts, event_type || '#' || event_id AS line FROM events)
, o AS (SELECT job, line, row_number() OVER (PARTITION BY job ORDER BY ts, line) - 1 AS pos, count(*) OVER (PARTITION BY job) AS n FROM n)
SELECT job, line, pos FROM o WHERE pos >= n - 4""")
def log_window(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.concat_ws("#", "event_type", "event_id").alias("line"))
    return c.log_window(rows, 4).select("job", "line", F.col("offset").alias("pos"))


@query("l06_tier_agreement", "WITH " + d.KNOWLEDGE + """
, s AS (SELECT tag, (30 + posts) / 100.0::DOUBLE AS threshold, 0.5::DOUBLE AS best, CASE WHEN posts >= 50 THEN 'head' WHEN posts >= 49 THEN 'mid' ELSE 'tail' END AS tier FROM knowledge)
SELECT tier, count(*) AS n, count(*) FILTER (WHERE abs(threshold - best) <= 0.05::DOUBLE) AS agree FROM s GROUP BY tier""")
def tier_agreement(spark, sf_dir):
    k = d.knowledge(spark, sf_dir)
    scores = k.select("tag", (F.lit(30) + F.col("posts")).alias("threshold"), F.lit(50).alias("best")).select("tag", (F.col("threshold") / 100).alias("threshold"), (F.col("best") / 100).alias("best"))
    return c.frequency_agreement(scores, k.select("tag", metrics.frequency_tier(F.col("posts"), 50, 49).alias("tier")))


@query("j21_accepted_rows", """
SELECT o_orderkey AS key, o_orderkey % 3 = 0 AS accepted FROM orders WHERE o_custkey % 10 = 3""")
def accepted_rows(spark, sf_dir):
    """Rows of a report that a curator's list names, and names that no row has."""
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c"))
    yes, lost = joins.accept(orders.where("key % 3 = 0"), orders.where("c % 10 = 3").select("key"), "key")
    return yes.select("key", F.lit(True).alias("accepted")).unionByName(lost.select("key", F.lit(False).alias("accepted")))


@query("h16_work_left", """
SELECT o_orderkey AS key, o_custkey % 4 AS sig FROM orders WHERE NOT (o_orderkey % 3 = 0) AND NOT (o_orderkey % 3 = 1 AND o_custkey % 4 = 0)""")
def work_left(spark, sf_dir):
    stamps = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 4).alias("sig"))
    derived = stamps.where("key % 3 = 0").unionByName(stamps.where("key % 3 = 1").select("key", F.lit(0).cast("long").alias("sig")))
    return state.up_to_date(derived, stamps, ["key"], ["sig"])


@query("a25_feature_work", """
SELECT o_orderkey AS path, o_custkey AS size, 7 AS mtime FROM orders WHERE NOT (o_orderkey % 3 = 0)""")
def feature_work(spark, sf_dir):
    sources = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.lit(7).alias("mtime"))
    stale = sources.where("path % 3 = 1").withColumn("size", F.col("size") + 1).withColumn("version", F.lit(2)).unionByName(sources.where("path % 3 = 2").withColumn("version", F.lit(1)))
    return files.feature_work(sources, sources.where("path % 3 = 0").withColumn("version", F.lit(2)).unionByName(stale), 2)


@query("v09_perceptual_hashes")
def perceptual_hashes(spark, sf_dir):
    """Hashes of vectors drawn as images: 8 x 8 cells of 4 x 4 points."""
    rows = d.table(spark, sf_dir, "embeddings")
    cells = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("embedding", (F.floor(F.floor(i / 32) / 4) * 8 + F.floor((i % 32) / 4) + 1).cast("int")))
    return c.perceptual_hashes(rows.select(F.col("vec_id").alias("key"), cells.alias("grey")))


