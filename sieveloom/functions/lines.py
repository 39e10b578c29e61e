"""Functions on read text lines: escaping, sound words, floors, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ----------------------------------------------------------------
MAX_SOUND_KANA = 6
VOCAL_INITIAL = "あいうえおんはひふへほぁぃぅぇぉアイウエオンハヒフヘホァィゥェォ"
VOICED_INITIAL = "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴ"
SOKUON = "っッ"
SOUND_STARTS = (
    "ちら", "ちゅ", "ちゃぷ", "きゅ", "くちゅ", "くい", "くる", "こし", "ころ", "とく", "とろ", "たゆ", "ぷる", "ぴく", "ぴちゃ", "ぺろ", "ぺた", "ぱく",
    "ふに", "ふる", "ふわ", "むぎゅ", "むに", "もみ", "すり", "ずり", "しこ", "つん", "つぷ", "かり", "こく", "きらきら", "はむ", "れろ", "にゅ",
    "チラ", "チュ", "キュ", "クチュ", "トク", "プル", "ピク", "ペロ", "フワ", "スリ", "ツン", "カリ", "コク", "ハム", "レロ", "ニュ", "ムニ", "モミ",
)
TALLY = "正一丁下卜TF "
MIN_DET, LOW_DET_SCORE, MIN_GLYPH, LATIN_GLYPH, LATIN_SCORE = 0.6, 0.9, 16.0, 12.0, 0.8
MIN_CAP, CAP_GLYPH = 12, 14


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_text(c: Column) -> Column:
    """Backslash pairs are set aside first, so ``\\\\n`` is a backslash and an n."""
    return F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def quote_text(c: Column) -> Column:
    """What may stand between quotes: quotes curled, line breaks as backslash and n."""
    return F.regexp_replace(F.replace(c, F.lit('"'), F.lit("”")), "\r\n|\n", r"\\n")


def unquote_text(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"""^["「『]|["」』]$""", ""), F.lit("\\n"), F.lit("\n"))


def kana_core(c: Column) -> Column:
    return F.regexp_replace(c, "[^ぁ-んァ-ヶー]", "")


def sound_key(c: Column) -> Column:
    """The kana without sokuon and long marks, folded to its smallest repeating unit."""
    return F.regexp_replace(F.regexp_replace(kana_core(c), "[っッー]", ""), r"^(.+?)\1+$", "$1")


def line_kind(c: Column, in_bubble: Column | None = None) -> Column:
    """sfx or speech: a cascade over the kana of the line."""
    core = kana_core(c)
    first = F.substr(core, F.lit(1), F.lit(1))
    starts = F.lit(False)
    for s in SOUND_STARTS:
        starts = starts | core.startswith(s)
    repeated = core.rlike(r"^(.{1,3})\1")
    sound = repeated | starts | F.lit(VOICED_INITIAL + SOKUON).contains(first)
    short = (F.char_length(core) <= 4) & (core.rlike("^[ァ-ヶー]+$") | core.rlike(f"[{SOKUON}]$"))
    speech = (core == "") | c.rlike("[一-鿿]") | (F.char_length(core) > MAX_SOUND_KANA) | F.lit(VOCAL_INITIAL).contains(first)
    out = F.when(in_bubble, "speech").when(speech, "speech") if in_bubble is not None else F.when(speech, "speech")
    return out.when(sound | short, "sfx").otherwise("speech")


def char_count(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"(?U)\s", ""))


def is_latin_only(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def is_tally(c: Column) -> Column:
    return c.contains("正") & F.btrim(c).rlike(f"^[{TALLY}]+$")


def keep_text(c: Column, min_chars: int = 0, skip_latin: bool = False) -> Column:
    kept = ~is_tally(c) & (char_count(c) >= min_chars)
    return kept & ~is_latin_only(c) if skip_latin else kept


def drop_symbols(c: Column) -> Column:
    """Without pictographs; white space collapsed in each line, empty lines gone."""
    lines = F.split(F.regexp_replace(c, r"\p{So}", ""), "\n")
    lines = F.transform(lines, lambda s: F.btrim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def has_script(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^ーっッゝゞヽヾ]]")


def is_runaway(c: Column) -> Column:
    """A run of 16 of a kind, a unit of 2 to 8 eight times, or one of 9 to 40 three times; ellipses do not count."""
    t = F.regexp_replace(c, "[….・]", "")
    return t.rlike(r"(?s)(.)\1{15}") | t.rlike(r"(?s)(.{2,8}?)\1{7}") | t.rlike(r"(?s)(.{9,40}?)\1{2}")


def is_latin(c: Column) -> Column:
    """Has a letter, and no letter outside ASCII."""
    return c.rlike("[A-Za-z]") & ~c.rlike(r"[\p{L}&&[^A-Za-z]]")


def length_cap(width: Column, height: Column) -> Column:
    """max(12, area / glyph area), rounded half to even."""
    return F.greatest(F.lit(MIN_CAP), F.bround(width * height / F.lit(CAP_GLYPH * CAP_GLYPH), 0).cast("int"))


def glyph_px(width: Column, height: Column, text: Column) -> Column:
    n = F.char_length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(n > 0, F.sqrt(width * height / n)).otherwise(F.lit(0.0))


def readable(text: Column, det: Column, score: Column, glyph: Column) -> Column:
    floor = F.when(text.rlike(r"[\p{L}&&[^\p{ASCII}]]"), MIN_GLYPH).otherwise(LATIN_GLYPH)
    return (text != "") & ((det >= MIN_DET) | (score >= LOW_DET_SCORE)) & (glyph >= floor)


def keep_box(text: Column, det: Column, score: Column, glyph: Column) -> Column:
    """readable, or a Latin line read well, or a Hangul line lost to its glyph alone."""
    hangul = text.rlike(r"[가-힣]") & ~text.rlike(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾟ]")
    rescue = F.when(is_latin(text), score >= LATIN_SCORE).otherwise(hangul & ((det >= MIN_DET) | (score >= LOW_DET_SCORE)))
    return readable(text, det, score, glyph) | ((glyph >= LATIN_GLYPH) & rescue)


def token_confidence(probs: Column, ids: Column, stops: tuple[int, ...]) -> Column:
    """Mean probability up to the first stop id; null without a token before it."""
    stop = F.array_min(F.array(*[F.nullif(F.array_position(ids, s).cast("int"), F.lit(0)) for s in stops]))
    used = F.slice(probs, 1, F.coalesce(stop - 1, F.size(probs)))
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used))


@F.pandas_udf(T.StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, which has no built-in function."""
    import unicodedata

    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_read(c: Column) -> Column:
    """Hearts and shapes folded, dot runs as an ellipsis, composed, lines collapsed."""
    t = F.translate(c, "❤♥❣", "♡♡♡")
    t = F.regexp_replace(t, r"\$([^$\n]*)\$", "$1")
    t = F.regexp_replace(nfc(t), r"\.{2,}|・{2,}|…+", "…")
    lines = F.transform(F.split(t, "\n"), lambda s: F.btrim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def guard(c: Column, width: Column, height: Column) -> Column:
    """The normalized read, or null where it runs away or is too long for its box."""
    t = normalize_read(c)
    return F.when((t != "") & ~is_runaway(t) & (F.char_length(t) <= length_cap(width, height)), t)
