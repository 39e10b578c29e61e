"""Tag functions: the shape of a tag, counts of a bag, colours, implication.

All are expressions over columns, so they stay in generated code; bags are
arrays of strings whose order means something and which may hold repeats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ----------------------------------------------------------------
COUNT_PATTERN = r"^(?:[0-9]+\+?(?:girl|boy|other)s?|multiple[_ ](?:girls|boys|others))$"
SINGLE_COUNTS = ("solo", "1girl", "1boy", "1other")
RATINGS = ("safe", "sensitive", "nsfw", "explicit")
LEGACY_RATINGS = {"general": "safe", "questionable": "nsfw"}
PEOPLE_LABELS = ("no_people", "1girl", "1girl_1boy", "2girls", "2girls_1boy", "2boys_1girl", "1boy", "multi")
COLOR_WORDS = (
    "aqua", "black", "blonde", "blue", "brown", "green", "grey", "gray", "orange", "pink", "purple", "red", "silver", "white", "yellow", "tan", "teal", "cyan",
    "magenta", "maroon", "navy", "olive", "violet", "beige", "gold", "golden", "cream", "crimson", "scarlet", "turquoise", "lavender", "peach", "azure", "ivory", "bronze",
)
COLOR_MODIFIERS = ("light", "dark", "pale", "deep", "bright", "pastel")
COLOR_PHRASES = (
    "monochrome", "greyscale", "grayscale", "colorful", "muted color", "pastel colors", "limited palette", "spot color", "rainbow order", "two-tone hair",
    "multicolored hair", "gradient hair", "streaked hair", "split-color hair", "rainbow hair", "colored inner hair", "multicolored eyes", "heterochromia",
    "two-tone eyes", "dark skin", "pale skin", "tan", "sun tan", "tanlines", "tan lines", "dark-skinned female", "dark-skinned male",
)
COLORED_PARTS = ("hair", "eyes", "skin")
NOT_CHARACTER_COLOURS = ("skin", "background", "sky", "border", "theme")
COMIC_TAGS = ("comic", "manga", "doujinshi", "2koma", "3koma", "4koma", "5koma", "multiple 4koma")
NON_IMPLYING = ("no", "spoken", "looking", "covered")
EXTRA_IMPLIES = {"bow": ("bowtie",), "very long hair": ("absurdly long hair",)}
SUPERSEDED_BY = {"bow": "bowtie", "neckerchief": "bowtie"}
NO_ARTIST = "@no-artist"


def trim(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_tag(c: Column) -> Column:
    """The key of a tag: trimmed, underscores as spaces, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.replace(trim(c), F.lit("_"), F.lit(" "))), r"(?U)\s+", " ")


def tag_key(c: Column) -> Column:
    """The knowledge-base key: normalized, without one leading @, spaces as underscores."""
    return F.replace(F.regexp_replace(normalize_tag(c), "^@", ""), F.lit(" "), F.lit("_"))


def is_count_tag(c: Column) -> Column:
    return c.rlike(COUNT_PATTERN)


def exact_count(c: Column, noun: str) -> Column:
    """N of an exact ``N<noun>s``; null otherwise, open counts included."""
    return F.nullif(F.regexp_extract(normalize_tag(c), rf"^([0-9]+){noun}s?$", 1), F.lit("")).cast("int")


def count_of(tags: Column, noun: str) -> Column:
    """The largest exact count; else null where a count is open; else 0."""
    best = F.array_max(F.transform(tags, lambda t: exact_count(t, noun)))
    unknown = F.exists(tags, lambda t: (normalize_tag(t) == f"multiple {noun}s") | normalize_tag(t).rlike(rf"^[0-9]+\+{noun}s?$"))
    return F.when(best.isNotNull(), best).when(unknown, F.lit(None)).otherwise(F.lit(0)).cast("int")


def classify_people(tags: Column) -> Column:
    """Index into PEOPLE_LABELS. Numbers win; ``multiple_x`` counts as two where no
    number for x stands; anything with others, three of a kind or two of each is 7."""
    counts = F.filter(tags, is_count_tag)
    number = lambda noun: F.coalesce(F.array_max(F.transform(F.filter(counts, lambda t: ~t.startswith("multiple") & t.contains(noun)), lambda t: F.regexp_extract(t, "^([0-9]+)", 1).cast("int"))), F.lit(0))
    several = lambda noun: F.exists(counts, lambda t: t.startswith("multiple") & t.contains(noun))
    girls = F.when((number("girl") == 0) & several("girl"), 2).otherwise(number("girl"))
    boys = F.when((number("boy") == 0) & several("boy"), 2).otherwise(number("boy"))
    other = F.exists(counts, lambda t: t.contains("other"))
    table = F.create_map(*[x for g, b, k in ((0, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (1, 2, 5), (0, 1, 6)) for x in (F.lit(g * 10 + b), F.lit(k))])
    return F.when(other | (girls >= 3) | (boys >= 3), 7).otherwise(F.coalesce(F.try_element_at(table, (girls * 10 + boys).cast("int")), F.lit(7))).cast("int")


def is_artist_tag(c: Column) -> Column:
    return c.rlike(r"(?U)^@\S")


def strip_artist_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^@", "")


def artist_handles(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tags, is_artist_tag), strip_artist_prefix))


def trailing_qualifier(c: Column) -> Column:
    """The balanced parenthetical at the end, nested ones whole; null without one."""
    t = F.regexp_replace(c, r"(?U)\s+$", "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("open"))

    def step(a, ch):
        depth = a["depth"] + F.when(ch == ")", 1).when(ch == "(", -1).otherwise(0)
        closed = (ch == "(") & (depth == 0) & (a["open"] == 0)
        return F.struct(depth.cast("int").alias("depth"), (a["at"] + 1).alias("at"), F.when(closed, a["at"] + 1).otherwise(a["open"]).alias("open"))

    found = F.aggregate(F.split(F.reverse(t), ""), state, step)["open"]
    inner = trim(F.substr(t, F.char_length(t) - found + 2, found - 2))
    return F.when(t.endswith(")") & (found > 0), F.nullif(inner, F.lit("")))


def artist_oc_handle(c: Column, handles: Column) -> Column:
    """The artist that an original character is qualified by, else null."""
    q = trailing_qualifier(c)
    return F.when(F.array_contains(handles, q), q)


def is_rating_tag(c: Column) -> Column:
    return c.isin(*RATINGS, *LEGACY_RATINGS)


def canonical_rating(c: Column) -> Column:
    out = F.when(c.isin(*RATINGS), c)
    for old, new in LEGACY_RATINGS.items():
        out = out.when(c == old, F.lit(new))
    return out


def is_solo(names: Column) -> Column:
    """One single-count name and no other count tag."""
    return F.arrays_overlap(names, F.array(*map(F.lit, SINGLE_COUNTS))) & ~F.exists(names, lambda n: is_count_tag(n) & ~n.isin(*SINGLE_COUNTS))


def is_year_tag(c: Column) -> Column:
    return c.rlike("^[0-9]{4}$") & F.coalesce(c.try_cast("int").between(1900, 2100), F.lit(False))


def quality_emit_form(c: Column) -> Column:
    return F.when(c.rlike("^score [0-9]+$"), F.replace(c, F.lit(" "), F.lit("_"))).otherwise(c)


def is_commentary_tag(c: Column) -> Column:
    return c.contains("commentary")


def is_comic_tag(c: Column) -> Column:
    return normalize_tag(c).isin(*COMIC_TAGS)


def _colored(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, COLOR_WORDS)))


def is_color_tag(c: Column) -> Column:
    """A phrase of the list; a coloured hair, eyes or skin; a colour first; or a modifier and a colour."""
    t = normalize_tag(c)
    words = F.split(t, " ")
    body = F.element_at(words, -1).isin(*COLORED_PARTS) & _colored(words)
    lead = F.element_at(words, 1).isin(*COLOR_WORDS)
    second = F.coalesce(F.try_element_at(words, F.lit(2)).isin(*COLOR_WORDS), F.lit(False))
    return (t != "") & (t.isin(*COLOR_PHRASES) | body | lead | (F.element_at(words, 1).isin(*COLOR_MODIFIERS) & second))


def is_character_colour(c: Column) -> Column:
    words = F.split(normalize_tag(c), " ")
    return is_color_tag(c) & ~F.element_at(words, -1).isin(*NOT_CHARACTER_COLOURS) & ~F.exists(words, lambda w: w.endswith("skinned"))


def implies(specific: Column, generic: Column) -> Column:
    """Does one normalized tag say all that another does?"""
    reach = lambda target: (specific == target) | (
        specific.endswith(F.concat(F.lit(" "), target)) & ~F.split(specific, " ")[0].isin(*NON_IMPLYING)
    )
    out = reach(generic)
    for general, targets in EXTRA_IMPLIES.items():
        for target in targets:
            out = out | ((generic == general) & reach(F.lit(target)))
    for head, better in SUPERSEDED_BY.items():
        stem = F.substr(generic, F.lit(1), F.char_length(generic) - len(head))
        out = out | (((generic == head) | generic.endswith(" " + head)) & (specific == F.concat(stem, F.lit(better))))
    return (specific != generic) & out


def is_censor_tag(c: Column) -> Column:
    t = normalize_tag(c)
    return (t.contains("censor") & ~t.contains("uncensor") & ~t.contains("decensor")) | (t == "mosaic censoring")


def title_words(c: Column, stopwords: tuple[str, ...] = ("the", "and", "with", "series")) -> Column:
    """Words of four characters and more, stop words aside."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.char_length(w) >= 4) & ~w.isin(*stopwords))


def name_part(c: Column) -> Column:
    """name of ``name (series)``; null without the form."""
    return F.nullif(F.regexp_extract(c, r"^(.+?) \((.+)\)$", 1), F.lit(""))


def series_part(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(.+?) \((.+)\)$", 2), F.lit(""))


def name_prefix(c: Column) -> Column:
    """What stands before the first parenthesis."""
    return trim(F.substring_index(c, "(", 1))


def specificity(c: Column) -> Column:
    """Parentheses, then length: what sorts later is more specific."""
    return F.struct(F.regexp_count(c, F.lit(r"\(")).alias("parens"), F.char_length(c).alias("length"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def wildcard(pattern: str) -> str:
    """The regular expression of a pattern in which only * is special."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.lower().replace("_", " ").split("*")) + "$"


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | normalize_tag(c).rlike(wildcard(p))
    return out


def underscore_to_space(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def distinct_by_key(tags: Column) -> Column:
    """The first tag of each key, spelled as it stands; empty keys go. Sorted by key and
    place, a tag is first where its key differs from the one before."""
    keyed = F.array_sort(F.transform(tags, lambda t, i: F.struct(normalize_tag(t).alias("k"), i.alias("i"), t.alias("t"))))
    before = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int,t:string>")), F.slice(keyed, 1, F.greatest(F.size(tags) - 1, F.lit(0))))
    marked = F.zip_with(keyed, before, lambda x, p: F.struct(x["i"].alias("i"), x["t"].alias("t"), ((x["k"] != "") & (p["k"].isNull() | (p["k"] != x["k"]))).alias("first")))
    first = F.when(F.size(tags) == 0, F.array().cast("array<struct<i:int,t:string,first:boolean>>")).otherwise(F.filter(marked, lambda x: x["first"]))
    return F.transform(F.array_sort(first), lambda x: x["t"])


def clean_markup(body: Column, longest: int = 600) -> Column:
    """Wiki text as plain text: the first paragraph, links as their label, tags,
    headings and bullets gone, white space collapsed, cut at a word with an ellipsis."""
    t = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2")
    t = F.regexp_replace(t, r'"([^"\n]+)":(?:\[[^\]]*\]|\S+)', "$1")
    t = F.regexp_replace(t, r"\[/?[a-zA-Z][^\]\n]*\]", "")
    t = F.regexp_replace(t, r"(?m)^h[1-6]\.\s*.*$", "")
    t = F.regexp_replace(t, r"(?m)^\s*\*+\s*", "")
    t = F.element_at(F.split(F.regexp_replace(t, r"^\s+", ""), r"\n\s*\n"), 1)
    t = trim(F.regexp_replace(t, r"(?U)\s+", " "))
    cut = F.regexp_replace(F.substr(t, F.lit(1), F.lit(longest)), r"\s+\S*$", "")
    return F.when(F.char_length(t) <= longest, t).otherwise(F.concat(cut, F.lit("…")))


def strip_html(html: Column) -> Column:
    """Page text: scripts, styles, comments and tags gone, common entities read."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.btrim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def above(scores: Column, thresholds: Column, default: float = 0.5) -> Column:
    """Entries of a score map at or above their threshold."""
    return F.map_filter(scores, lambda k, v: v >= F.coalesce(F.try_element_at(thresholds, k), F.lit(default)))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def is_rel_key(path: Column) -> Column:
    """Forward slashes only, below the root: no drive, no leading slash, no .. part."""
    return (path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)")


def parse_selectors(spec: str | None, known: tuple[str, ...]) -> tuple[str, ...]:
    """A comma list of selectors: known names lower-cased, others as they are, each once."""
    parts = [p.strip() for p in (spec or "").split(",")]
    return tuple(dict.fromkeys(p.lower() if p.lower() in known else p for p in parts if p))


def suggest_count(instances: Column, girls: Column) -> Column:
    """The girl count that detections suggest where the caption says fewer."""
    return F.when(instances > F.coalesce(girls, F.lit(0)), F.when(instances >= 6, "6+girls").when(instances == 1, "1girl").otherwise(F.concat(instances.cast("string"), F.lit("girls"))))
