"""Queries on captions: tag shapes, grammar, rules, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar as g
from ..functions import tags as t
from ..operators import rules
from . import domain as d
from .registry import query

LIST = lambda xs: "(" + ", ".join(d.quoted(x) for x in xs) + ")"
ARRAY = lambda xs: "[" + ", ".join(d.quoted(x) for x in xs) + "]"
NORM = r"regexp_replace(lower(replace(trim({0}, ' ' || chr(9) || chr(10)), '_', ' ')), '\s+', ' ', 'g')"
#: the distinct tags of all orders, and of the literal captions split plainly
ALL_TAGS = (
    d.EMITTED
    + ",\n"
    + d.CAPTIONS_SQL
    + r""",
all_tags AS (
  SELECT DISTINCT tag FROM emitted
  UNION SELECT trim(x, ' ' || chr(9) || chr(10)) AS tag FROM (SELECT unnest(string_split(text, ',')) AS x FROM captions)
  WHERE trim(x, ' ' || chr(9) || chr(10)) <> '')"""
)


def all_tags(spark, sf_dir):
    literal = d.captions(spark).select(F.explode(rules.split_rules(F.col("text"))).alias("tag"))
    return d.emitted(spark, sf_dir).select("tag").unionByName(literal).distinct()


COUNT = t.COUNT_PATTERN


@query(
    "f01_f07_f14_tag_shape",
    "WITH "
    + ALL_TAGS
    + f"""
SELECT tag, {NORM.format("tag")} AS normalized,
       replace(regexp_replace({NORM.format("tag")}, '^@', ''), ' ', '_') AS kb_key,
       regexp_matches(tag, '{COUNT}') AS is_count,
       TRY_CAST(nullif(regexp_extract({NORM.format("tag")}, '^([0-9]+)girls?$', 1), '') AS INTEGER) AS girls,
       TRY_CAST(nullif(regexp_extract({NORM.format("tag")}, '^([0-9]+)boys?$', 1), '') AS INTEGER) AS boys,
       regexp_matches(tag, '^@[^ \\t\\n]') AS is_artist,
       tag IN {LIST([*t.RATINGS, *t.LEGACY_RATINGS])} AS is_rating,
       CASE WHEN tag IN {LIST(t.RATINGS)} THEN tag WHEN tag = 'general' THEN 'safe' WHEN tag = 'questionable' THEN 'nsfw' END AS rating,
       regexp_matches(tag, '^[0-9]{{4}}$') AND coalesce(TRY_CAST(tag AS INTEGER) BETWEEN 1900 AND 2100, false) AS is_year,
       contains(tag, 'commentary') AS is_commentary,
       {NORM.format("tag")} IN {LIST(t.COMIC_TAGS)} AS is_comic
FROM all_tags""",
)
def tag_shape(spark, sf_dir):
    c = F.col("tag")
    return all_tags(spark, sf_dir).select(
        "tag", t.normalize_tag(c).alias("normalized"), t.tag_key(c).alias("kb_key"), t.is_count_tag(c).alias("is_count"), t.exact_count(c, "girl").alias("girls"), t.exact_count(c, "boy").alias("boys"),
        t.is_artist_tag(c).alias("is_artist"), t.is_rating_tag(c).alias("is_rating"), t.canonical_rating(c).alias("rating"), t.is_year_tag(c).alias("is_year"), t.is_commentary_tag(c).alias("is_commentary"), t.is_comic_tag(c).alias("is_comic"),
    )


W = f"string_split({NORM.format('tag')}, ' ')"


@query(
    "f16_f17_colour_tags",
    "WITH "
    + ALL_TAGS
    + f""",
w AS (SELECT tag, {NORM.format("tag")} AS k, {W} AS w FROM all_tags),
c AS (SELECT tag, k, w, k <> '' AND (k IN {LIST(t.COLOR_PHRASES)}
        OR (w[-1] IN {LIST(t.COLORED_PARTS)} AND list_has_any(w, {ARRAY(t.COLOR_WORDS)}))
        OR w[1] IN {LIST(t.COLOR_WORDS)}
        OR (w[1] IN {LIST(t.COLOR_MODIFIERS)} AND coalesce(w[2] IN {LIST(t.COLOR_WORDS)}, false))) AS is_color FROM w)
SELECT tag, is_color,
       is_color AND w[-1] NOT IN {LIST(t.NOT_CHARACTER_COLOURS)} AND len(list_filter(w, lambda x: ends_with(x, 'skinned'))) = 0 AS is_character_colour
FROM c""",
)
def colour_tags(spark, sf_dir):
    c = F.col("tag")
    return all_tags(spark, sf_dir).select("tag", t.is_color_tag(c).alias("is_color"), t.is_character_colour(c).alias("is_character_colour"))


@query(
    "f05_f06_f12_people",
    "WITH "
    + d.BAGS
    + """,
x AS (SELECT key, rating, people FROM fronts)
SELECT b.key,
  CASE people WHEN '1girl' THEN 1 WHEN '2girls' THEN 2 WHEN 'multiple_girls' THEN NULL WHEN '6+girls' THEN NULL ELSE 0 END AS girls,
  CASE people WHEN '1boy' THEN 1 ELSE 0 END AS boys,
  CASE people WHEN '1girl' THEN 1 WHEN '2girls' THEN 3 WHEN 'multiple_girls' THEN 3 WHEN '6+girls' THEN 7 WHEN '1boy' THEN 6 WHEN 'solo' THEN 0 ELSE 7 END AS people,
  people IN ('1girl', '1boy', 'solo') AS solo
FROM bags b JOIN x USING (key)""",
)
def people(spark, sf_dir):
    c = F.col("tags")
    return d.bags(spark, sf_dir).select("key", t.count_of(c, "girl").alias("girls"), t.count_of(c, "boy").alias("boys"), t.classify_people(c).alias("people"), t.is_solo(c).alias("solo"))


@query(
    "f09_f10_f23_f27_name_parts",
    "WITH "
    + ALL_TAGS
    + r"""
SELECT tag, nullif(regexp_extract(tag, '^(.+?) \((.+)\)$', 1), '') AS name, nullif(regexp_extract(tag, '^(.+?) \((.+)\)$', 2), '') AS series,
       CASE WHEN tag LIKE '%)' THEN CASE WHEN tag LIKE '%(kat (bu-kunn))' THEN 'kat (bu-kunn)' ELSE nullif(trim(regexp_extract(tag, '\(([^()]*)\)$', 1)), '') END END AS qualifier,
       trim(string_split(tag, '(')[1]) AS prefix, length(tag) - length(replace(tag, '(', '')) AS parens
FROM all_tags""",
)
def name_parts(spark, sf_dir):
    c = F.col("tag")
    return all_tags(spark, sf_dir).select("tag", t.name_part(c).alias("name"), t.series_part(c).alias("series"), t.trailing_qualifier(c).alias("qualifier"), t.name_prefix(c).alias("prefix"), F.regexp_count(c, F.lit(r"\(")).cast("long").alias("parens"))


@query(
    "f19_implied_pairs",
    "WITH "
    + ALL_TAGS
    + f""",
k AS (SELECT DISTINCT {NORM.format("tag")} AS k FROM all_tags),
target(general, target) AS (SELECT k, k FROM k UNION ALL VALUES ('bow', 'bowtie'), ('very long hair', 'absurdly long hair'))
SELECT DISTINCT s.k AS specific, g.k AS general FROM k s JOIN k g ON s.k <> g.k
WHERE EXISTS (SELECT 1 FROM target x WHERE x.general = g.k AND (s.k = x.target OR (ends_with(s.k, ' ' || x.target) AND string_split(s.k, ' ')[1] NOT IN {LIST(t.NON_IMPLYING)})))
   OR ((g.k = 'bow' OR ends_with(g.k, ' bow')) AND s.k = left(g.k, length(g.k) - 3) || 'bowtie')
   OR ((g.k = 'neckerchief' OR ends_with(g.k, ' neckerchief')) AND s.k = left(g.k, length(g.k) - 11) || 'bowtie')""",
)
def implied_pairs(spark, sf_dir):
    """Pairs of the vocabulary's tags; candidates meet on their last word, or on
    the few words that the extra tables name, not in a product of all tags."""
    k = all_tags(spark, sf_dir).select(t.normalize_tag(F.col("tag")).alias("k")).distinct()
    last = F.element_at(F.split("k", " "), -1)
    words = F.when(last == "bowtie", F.array(last, F.lit("bow"), F.lit("neckerchief"))).otherwise(F.array(last))
    s = k.select(F.col("k").alias("specific"), F.explode(words).alias("w"))
    return s.join(k.select(F.col("k").alias("general"), last.alias("w")), "w").where(t.implies(F.col("specific"), F.col("general"))).select("specific", "general").distinct()


@query("f28_wildcard_exclude", "WITH " + ALL_TAGS + f"""
SELECT tag FROM all_tags WHERE NOT regexp_matches({NORM.format("tag")}, '^red .*$') AND NOT regexp_matches({NORM.format("tag")}, '^.* hair$')""")
def wildcard_exclude(spark, sf_dir):
    return all_tags(spark, sf_dir).where(~t.matches_any(F.col("tag"), ["red *", "*_hair"]))


@query("f15_f22_f25_f43_emit_forms", "WITH " + ALL_TAGS + r"""
SELECT tag, replace(tag, '_', ' ') AS spaced, trim(regexp_replace(lower(tag), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
       array_to_string(list_filter(regexp_split_to_array(lower(tag), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ('the', 'and', 'with', 'series')), ' ') AS title_words
FROM all_tags""")
def emit_forms(spark, sf_dir):
    c = F.col("tag")
    return all_tags(spark, sf_dir).select("tag", t.underscore_to_space(c).alias("spaced"), t.slug(c).alias("slug"), F.array_join(t.title_words(c), " ").alias("title_words"))


@query("f20_censor_tags", "WITH " + ALL_TAGS + f"""
SELECT tag FROM all_tags WHERE contains({NORM.format("tag")}, 'censor') AND NOT contains({NORM.format("tag")}, 'uncensor') AND NOT contains({NORM.format("tag")}, 'decensor')""")
def censor_tags(spark, sf_dir):
    return all_tags(spark, sf_dir).where(t.is_censor_tag(F.col("tag")))


@query("f24_page_text", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), 'a^', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS text
FROM pages""")
def page_text(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", t.strip_html(F.col("html")).alias("text"))


@query("g01_z05_caption_spans")
def caption_spans(spark, sf_dir):
    """Spans of every document as a caption; the grammar is beyond SQL, and tests hold it."""
    rows = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(g.caption_spans("text")).alias("s"))
    return rows.select("id", "s.start", "s.end", "s.text", "s.kind", "s.clause")


@query("g02_g03_g04_parse_documents")
def parse_documents(spark, sf_dir):
    """Every document parsed as a caption: sizes, the flattened form's hash."""
    p = d.table(spark, sf_dir, "documents").select("doc_id", g.parse_caption("text").alias("p"))
    return p.select("doc_id", F.size("p.flat_tags").alias("tags"), F.size("p.clauses").alias("clauses"), g.has_text_clauses(F.col("p")).alias("has_text"), F.md5(g.flatten_caption(F.col("p"))).alias("flat_md5"))


@query("g02_g03_g09_plain_round_trip", "WITH " + d.BAGS + """
SELECT key, array_to_string(tags, ', ') AS caption, len(tags) AS n FROM bags""")
def plain_round_trip(spark, sf_dir):
    """Bags rendered, parsed by the grammar and rendered again."""
    rendered = d.bags(spark, sf_dir).select("key", g.compose(F.col("tags"), F.array().cast(f"array<{g.CLAUSE}>")).alias("caption"))
    parsed = rendered.select("key", g.parse_caption("caption").alias("p"))
    return parsed.select("key", g.compose(F.col("p.flat_tags"), F.col("p.clauses")).alias("caption"), F.size("p.flat_tags").cast("long").alias("n"))


LAYOUT = ("multiple views", "comic", "silent comic", "sequential", "2koma", "3koma", "4koma", "multiple 4koma")


@query("g10_g12_candidates", "WITH " + d.BAGS + """
SELECT key, CASE people WHEN '2girls' THEN 'multi-girl' WHEN 'multiple_girls' THEN 'multi-girl' WHEN '6+girls' THEN 'multi-girl' ELSE 'single-subject' END AS reason
FROM fronts""")
def candidates(spark, sf_dir):
    """Whether a caption goes through detection, and the first reason that holds."""
    parsed = d.bags(spark, sf_dir).select("key", F.struct(F.col("tags").alias("flat_tags"), F.array().cast(f"array<{g.CLAUSE}>").alias("clauses")).alias("p"))
    keys = g.tag_keys(F.col("p"))
    girls = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, LAYOUT))), F.lit(None)).otherwise(t.count_of(keys, "girl"))
    reason = (
        F.when(g.has_clauses(F.col("p")), "already-has-clauses").when(F.array_contains(keys, "multiple views"), "multiple-views")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, LAYOUT[1:]))), "panel-layout").when(girls.isNull() | (girls > 1), "multi-girl").otherwise("single-subject")
    )
    return parsed.select("key", reason.alias("reason"))


@query("g13_colour_bags", "WITH " + d.BAGS + """
, t AS (SELECT key, pos, tag, row_number() OVER (PARTITION BY key, tag ORDER BY pos) AS r FROM emitted)
SELECT b.key, coalesce(string_agg(t.tag, ', ' ORDER BY t.pos) FILTER (WHERE r = 1 AND string_split(t.tag, ' ')[1] IN """ + LIST(t.COLOR_WORDS) + """), '') AS colours
FROM bags b JOIN t USING (key) GROUP BY b.key""")
def colour_bags(spark, sf_dir):
    return d.bags(spark, sf_dir).select("key", F.array_join(t.distinct_by_key(F.filter("tags", t.is_color_tag)), ", ").alias("colours"))


@query("g14_layout_json", "WITH " + d.BAGS + """
SELECT key, CASE rating WHEN 'safe' THEN 'sfw' WHEN 'general' THEN 'sfw' ELSE 'nsfw' END AS safety, artist, people,
       (SELECT string_agg(tag, ', ' ORDER BY n) FROM occurrences o WHERE o.key = f.key) AS caption
FROM fronts f""")
def layout_json(spark, sf_dir):
    """The nested layout of a caption, read back from its JSON."""
    rating = F.filter(F.transform("tags", t.canonical_rating), lambda r: r.isNotNull())[0]
    artist = F.filter("tags", t.is_artist_tag)[0]
    rest = F.nullif(F.array_join(F.filter("tags", lambda x: ~t.is_artist_tag(x) & ~t.is_rating_tag(x) & ~t.is_count_tag(x) & (x != "solo")), ", "), F.lit(""))
    layout = F.struct(F.struct(F.when(rating.isin("safe", "sensitive"), "sfw").otherwise("nsfw").alias("safety"), artist.alias("artist")).alias("meta"), F.filter("tags", lambda x: t.is_count_tag(x) | (x == "solo"))[0].alias("people"), rest.alias("caption"))
    made = d.bags(spark, sf_dir).select("key", F.to_json(layout).alias("j"))
    read = F.from_json("j", "meta struct<safety:string,artist:string>, people string, caption string")
    return made.select("key", read.alias("r")).select("key", "r.meta.safety", "r.meta.artist", "r.people", "r.caption")


@query("g16_merge_tags", "WITH " + d.BAGS + """
SELECT key, array_to_string(tags || list_filter(['new tag', 'red widget'], lambda x: NOT list_contains(tags, x)), ', ') AS merged FROM bags""")
def merge_tags(spark, sf_dir):
    new = F.array(F.lit("safe"), F.lit("new_tag"), F.lit("new tag"), F.lit("red widget"))
    merged = rules.merge_tags(F.col("tags"), new)
    return d.bags(spark, sf_dir).select("key", F.array_join(F.transform(merged, lambda x: F.when(x == "new_tag", "new tag").otherwise(x)), ", ").alias("merged"))


@query("g17_g18_propose", "WITH " + d.BAGS + """
SELECT key, array_to_string(CASE WHEN people = '3girls' THEN tags WHEN people IN ('1girl', '2girls') THEN list_transform(tags, lambda x, i: CASE WHEN i = 2 THEN '3girls' ELSE x END) ELSE tags || ['3girls'] END, ', ') AS proposed
FROM bags JOIN fronts USING (key)""")
def propose(spark, sf_dir):
    return d.bags(spark, sf_dir).select("key", F.array_join(rules.propose_count(F.col("tags"), "3girls"), ", ").alias("proposed"))


ALIASES = {"small ring": "tiny ring", "red widget": "scarlet widget"}


@query("p01_p04_rules", "WITH " + d.BAGS + """
, a AS (SELECT key, pos, CASE tag WHEN 'small ring' THEN 'tiny ring' WHEN 'red widget' THEN 'scarlet widget' ELSE tag END AS tag FROM emitted),
f AS (SELECT key, tag, min(pos) AS pos FROM a GROUP BY key, tag),
v AS (SELECT DISTINCT key FROM f WHERE tag IN ('green bolt', 'tiny ring'))
SELECT key, string_agg(tag, ', ' ORDER BY pos) AS caption FROM f
WHERE tag <> 'old gear' AND NOT (tag = 'blue bolt' AND key IN (SELECT key FROM v)) GROUP BY key""")
def apply_rules(spark, sf_dir):
    rendered = d.bags(spark, sf_dir).select("key", F.array_join("tags", ", ").alias("c"))
    tags = rules.split_rules(rules.apply_replacements(F.col("c"), []))
    return rendered.select("key", F.array_join(rules.apply_rules(tags, ALIASES, ["old gear"], {"blue bolt": ["green bolt", "tiny ring"]}), ", ").alias("caption"))


@query("p05_p08_tag_kind", "WITH " + ALL_TAGS + ",\n" + d.KNOWLEDGE + f"""
SELECT t.tag, coalesce(CASE WHEN regexp_matches(t.tag, '^@[^ \\t\\n]') THEN 'artist' WHEN t.tag IN {LIST(rules.QUALITY_TAGS)} THEN 'quality'
  WHEN t.tag IN {LIST([*t.RATINGS, *t.LEGACY_RATINGS])} THEN 'safety' WHEN regexp_matches(t.tag, '^(19[0-9][0-9]|20[0-9][0-9]|2100)$') THEN 'year'
  WHEN regexp_matches(t.tag, '{COUNT}') THEN 'count' WHEN contains(t.tag, 'commentary') THEN 'general' ELSE k.kind END, 'unknown') AS kind
FROM all_tags t LEFT JOIN knowledge k USING (tag)""")
def tag_kind(spark, sf_dir):
    known = d.knowledge(spark, sf_dir).select("tag", "kind")
    return all_tags(spark, sf_dir).join(known, "tag", "left").select("tag", F.coalesce(rules.classify(F.col("tag"), F.col("kind")), F.lit("unknown")).alias("kind"))


GROUPS = [("first", ["Brand#1 >", "Brand#2 >"]), ("teens", ["Brand#1"]), ("rest", ["Brand#"])]


@query("p09_p11_drop_groups", "WITH " + d.BAGS + ",\n" + d.KNOWLEDGE + """,
g AS (SELECT e.key, e.pos, e.tag, CASE WHEN e.tag LIKE '@%' THEN 'artist' WHEN e.pos = 1 AND e.tag <> 'solo' THEN 'count' WHEN e.pos = 0 THEN NULL
        WHEN k.kind IN ('character', 'copyright', 'meta') THEN k.kind WHEN k.path LIKE 'Brand#1 >%' OR k.path LIKE 'Brand#2 >%' THEN 'first'
        WHEN k.path LIKE 'Brand#1%' THEN 'teens' WHEN k.path LIKE 'Brand#%' THEN 'rest' END AS grp
      FROM emitted e LEFT JOIN knowledge k USING (tag))
SELECT key, string_agg(tag, ', ' ORDER BY pos) AS kept, count(*) AS n FROM g WHERE coalesce(grp, '') NOT IN ('teens', 'meta', 'artist') GROUP BY key""")
def drop_groups(spark, sf_dir):
    rows = d.emitted(spark, sf_dir).join(d.knowledge(spark, sf_dir), "tag", "left")
    gone = F.coalesce(rules.drop_group(F.col("tag"), F.col("kind"), F.col("path"), GROUPS).isin("teens", "meta", "artist"), F.lit(False))
    kept = rows.where(~gone).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("x"))
    return kept.select("key", F.array_join(F.transform("x", lambda p: p["tag"]), ", ").alias("kept"), F.size("x").cast("long").alias("n"))


@query("p12_implied_drop", "WITH " + d.EMITTED + """
SELECT DISTINCT g.key, g.tag FROM emitted g JOIN emitted s ON s.key = g.key AND s.tag <> g.tag AND ends_with(s.tag, ' ' || g.tag)""")
def implied_drop(spark, sf_dir):
    return rules.implied(d.emitted(spark, sf_dir))


@query("r01_r02_correct_bags", "WITH " + d.BAGS + ",\n" + d.KNOWLEDGE + """,
f AS (SELECT key, tag, min(pos) AS pos FROM emitted GROUP BY key, tag),
b AS (SELECT f.key, f.pos, CASE f.tag WHEN 'general' THEN 'safe' ELSE replace(f.tag, '_', ' ') END AS tag,
        CASE WHEN f.pos = 0 THEN 5 WHEN f.tag LIKE '@%' THEN 9 WHEN f.pos = 1 AND f.tag <> 'solo' THEN 6
             ELSE CASE k.kind WHEN 'meta' THEN 3 WHEN 'character' THEN 7 WHEN 'copyright' THEN 8 ELSE 10 END END AS place,
        f.pos = 1 AND f.tag = 'solo' AS unknown
      FROM f LEFT JOIN knowledge k ON k.tag = f.tag)
SELECT key, string_agg(tag, ', ' ORDER BY place, pos) AS caption, coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (WHERE unknown), '') AS unknown FROM b GROUP BY key""")
def correct_bags(spark, sf_dir):
    out = rules.correct_bags(d.emitted(spark, sf_dir), d.knowledge(spark, sf_dir))
    return out.select("key", F.array_join("tags", ", ").alias("caption"), F.array_join("unknown", ", ").alias("unknown"))


@query("r03_caption_of_scores", "WITH " + d.SCORES + """
SELECT sample, string_agg('tag ' || tag, ', ' ORDER BY tag) AS caption FROM scores WHERE score >= 0.55 GROUP BY sample""")
def caption_of_scores(spark, sf_dir):
    """Kept tags as a caption, in slot order."""
    kept = d.scores(spark, sf_dir).where("score >= 0.55").groupBy("sample").agg(F.array_sort(F.collect_list("tag")).alias("x"))
    return kept.select("sample", F.array_join(F.transform("x", lambda v: F.concat(F.lit("tag "), v)), ", ").alias("caption"))


@query("r04_r05_r07_variants", "WITH " + d.BAGS + """
SELECT key, 'v' || CAST(v AS VARCHAR) AS label, len(tags) AS n, array_to_string(tags[1:3], ', ') AS front,
       array_to_string(list_sort(tags[4:]), ', ') AS bag FROM bags, unnest(range(3)) AS u(v)""")
def variants(spark, sf_dir):
    """Three variants a caption: the front stays, the rest goes by a hash of key,
    variant and place; v0 is as it was. Shuffles agree in every run."""
    rows = d.bags(spark, sf_dir).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rest = F.slice("tags", 4, F.greatest(F.size("tags") - 3, F.lit(0)))
    keyed = F.array_sort(F.transform(rest, lambda x, i: F.struct(F.when(F.col("v") == 0, i.cast("long")).otherwise(F.xxhash64("key", "v", i)).alias("h"), x.alias("x"))))
    mixed = F.concat(F.slice("tags", 1, 3), F.transform(keyed, lambda e: e["x"]))
    made = rows.select("key", "v", mixed.alias("m"))
    return made.select("key", F.concat(F.lit("v"), "v").alias("label"), F.size("m").cast("long").alias("n"), F.array_join(F.slice("m", 1, 3), ", ").alias("front"), F.array_join(F.array_sort(F.slice("m", 4, F.greatest(F.size("m") - 3, F.lit(0)))), ", ").alias("bag"))


@query("y01_y02_multi_hot", "WITH " + d.BAGS + """,
v AS (SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT tag FROM occurrences) )
SELECT o.key, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS hot FROM (SELECT DISTINCT key, tag FROM occurrences) o JOIN fronts f ON f.key = o.key AND f.solo JOIN v USING (tag) GROUP BY o.key""")
def multi_hot(spark, sf_dir):
    """Indices of the distinct tags of solo images."""
    from pyspark.sql import Window

    rows = d.occurrences(spark, sf_dir).select("key", "tag").distinct()
    vocab = rows.select("tag").distinct().withColumn("i", F.row_number().over(Window.orderBy("tag")) - 1)
    solo = d.bags(spark, sf_dir).where(t.is_solo(F.col("tags"))).select("key")
    hot = rows.join(solo, "key", "left_semi").join(vocab, "tag").groupBy("key").agg(F.array_sort(F.collect_list("i")).alias("x"))
    return hot.select("key", F.array_join("x", ",").alias("hot"))
