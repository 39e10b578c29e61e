"""Rules over bags: replacements, aliases, removals, typing, ordering, drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as t

#: The order in which a corrected bag emits its kinds.
BUCKETS = ("front", "quality", "meta", "year", "safety", "count", "character", "copyright", "artist", "general")
#: Tags of the quality slot; ``score N`` regains its underscore.
QUALITY_TAGS = ("masterpiece", "best quality", "good quality", "normal quality", "low quality", "worst quality", *(f"score {n}" for n in range(1, 10)))


def apply_replacements(text: Column, replacements: list[tuple[str, str]]) -> Column:
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def apply_aliases(tags: Column, aliases: dict[str, str]) -> Column:
    """Renamed in place and each tag once; without aliases repeats stay."""
    if not aliases:
        return tags
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.array_distinct(F.transform(tags, lambda x: F.coalesce(F.try_element_at(table, x), x)))


def apply_rules(tags: Column, aliases: dict[str, str], remove: list[str], dedup: dict[str, list[str]]) -> Column:
    """Aliases; then the removed tags and every base whose variant is there go."""
    tags = apply_aliases(tags, aliases)
    gone = F.array(*map(F.lit, remove)) if remove else F.array().cast("array<string>")
    for base, variants in dedup.items():
        gone = F.concat(gone, F.when(F.arrays_overlap(tags, F.array(*map(F.lit, variants))), F.array(F.lit(base))).otherwise(F.array().cast("array<string>")))
    return F.filter(tags, lambda x: ~F.array_contains(gone, x))


def split_rules(text: Column) -> Column:
    """Plain commas, no quotes."""
    return F.filter(F.transform(F.split(text, ","), t.trim), lambda x: x != "")


def classify(tag: Column, kind: Column, known_artist: Column | None = None) -> Column:
    """The bucket of a normalized tag, given its kind in the knowledge base (null: unknown)."""
    artist = F.lit("artist") if known_artist is None else F.when(known_artist, "artist").otherwise("general")
    return (
        F.when(tag == t.NO_ARTIST, "artist").when(t.is_artist_tag(tag), artist).when(tag.isin(*QUALITY_TAGS), "quality").when(t.is_rating_tag(tag), "safety")
        .when(t.is_year_tag(tag), "year").when(t.is_count_tag(tag), "count").when(t.is_commentary_tag(tag), "general").otherwise(kind)
    )


def correct_bags(rows: DataFrame, knowledge: DataFrame, *, insert_no_artist: bool = False, trigger: str = "", trigger_front: bool = True) -> DataFrame:
    """(key, tags, unknown): each bag in bucket order.

    rows: (key, pos, tag). The first occurrence of a key stands; ratings go to
    the canonical band, once each; unknown tags are general and reported. A bag
    is one caption's, so collecting it is bounded by the caption.
    """
    rows = rows.withColumn("tag", t.normalize_tag(F.col("tag"))).withColumn("k", t.tag_key(F.col("tag"))).where("tag <> ''")
    if trigger:
        rows = rows.where(F.col("k") != t.tag_key(F.lit(trigger)))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "k").orderBy("pos"))).where("r = 1")
    typed = first.join(knowledge.select(F.col("tag").alias("_t"), "kind"), F.col("tag") == F.col("_t"), "left").withColumn("bucket", classify(F.col("tag"), F.col("kind")))
    unknown = F.col("bucket").isNull()
    typed = typed.withColumn("unknown", unknown).withColumn("bucket", F.coalesce("bucket", F.lit("general")))
    emit = F.when(F.col("bucket") == "safety", F.coalesce(t.canonical_rating(F.col("tag")), F.col("tag"))).otherwise(t.quality_emit_form(F.col("tag")))
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    per = typed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "pos", emit.alias("emit"), "unknown"))).alias("x"))
    part = lambda low, high: F.transform(F.filter("x", lambda e: (e["place"] >= low) & (e["place"] <= high)), lambda e: e["emit"])
    at = {b: i + 1 for i, b in enumerate(BUCKETS)}
    artists = part(at["artist"], at["artist"])
    if trigger and not trigger_front:
        artists = F.concat(F.array(F.lit(trigger)), artists)
    if insert_no_artist:
        artists = F.when(F.size(artists) == 0, F.array(F.lit(t.NO_ARTIST))).otherwise(artists)
    front = F.array(F.lit(trigger)) if trigger and trigger_front else F.array().cast("array<string>")
    safety = F.array_distinct(part(at["safety"], at["safety"]))
    tags = F.concat(front, part(at["quality"], at["year"]), safety, part(at["count"], at["copyright"]), artists, part(at["general"], at["general"]))
    return per.select("key", tags.alias("tags"), F.transform(F.filter("x", lambda e: e["unknown"]), lambda e: e["emit"]).alias("unknown"))


def drop_group(tag: Column, kind: Column, path: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """The coarse group of a tag: its shape, its kind, else the first group with a prefix of its path."""
    out = F.when(tag == t.NO_ARTIST, F.lit(None)).when(t.is_artist_tag(tag), "artist").when(t.is_count_tag(tag), "count").when(t.is_rating_tag(tag), F.lit(None)).when(kind.isin("artist", "character", "copyright", "meta"), kind)
    for slug, prefixes in groups:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | path.startswith(p)
        out = out.when(hit, slug)
    return out


def should_drop(tag: Column, kind: Column, path: Column, groups: list[tuple[str, list[str]]], selectors: list[str]) -> Column:
    """Under any selector: a structural tag by its own group only, others by path too."""
    structural = ("artist", "character", "copyright", "meta", "count")
    coarse = drop_group(tag, kind, path, groups)
    by_path = F.lit(False)
    known = dict(groups)
    for s in selectors:
        if s not in structural:
            for p in known.get(s, [s]):
                by_path = by_path | path.startswith(p)
    hit = F.coalesce(coarse.isin(*selectors), F.lit(False)) | (~F.coalesce(coarse.isin(*structural), F.lit(False)) & F.coalesce(by_path, F.lit(False)))
    return ~(tag == t.NO_ARTIST) & ~t.is_rating_tag(tag) & hit


def implied(rows: DataFrame) -> DataFrame:
    """(key, tag) of bag tags that another tag of the bag implies. rows: (key, tag)."""
    own = rows.select("key", "tag", t.normalize_tag(F.col("tag")).alias("k")).distinct()
    pairs = own.alias("g").join(own.alias("s"), F.col("g.key") == F.col("s.key")).where(t.implies(F.col("s.k"), F.col("g.k")))
    return pairs.select(F.col("g.key").alias("key"), F.col("g.tag").alias("tag")).distinct()


def merge_tags(existing: Column, new: Column) -> Column:
    """Novel keys appended; a leading rating of the new tags falls if there is one already."""
    keys = F.transform(existing, t.normalize_tag)
    rated = F.exists(existing, t.is_rating_tag)
    fresh = F.filter(new, lambda x, i: ~F.array_contains(keys, t.normalize_tag(x)) & ~((i == 0) & rated & t.is_rating_tag(x)))
    return F.concat(existing, t.distinct_by_key(fresh))


def blank_backgrounds(tags: Column, plain: Column) -> Column:
    """``* background`` tags that the plain result has not go."""
    keys = F.transform(plain, t.normalize_tag)
    return F.filter(tags, lambda x: ~t.normalize_tag(x).endswith("background") | F.array_contains(keys, t.normalize_tag(x)))


def propose_count(tags: Column, tag: str) -> Column:
    """A girl count takes the place of the first exact one; any other tag goes to the end, unless it is there."""
    exact = F.filter(F.transform(tags, lambda x, i: F.when(t.exact_count(x, "girl").isNotNull(), i)), lambda i: i.isNotNull())
    at = F.try_element_at(exact, F.lit(1))
    put = F.transform(tags, lambda x, i: F.when(i == at, F.lit(tag)).otherwise(x))
    girls = t.exact_count(F.lit(tag), "girl").isNotNull()
    has = F.exists(tags, lambda x: t.normalize_tag(x) == t.normalize_tag(F.lit(tag)))
    return F.when(has, tags).when(girls & at.isNotNull(), put).otherwise(F.concat(tags, F.array(F.lit(tag))))
