"""The caption grammar: a flat bag of tags, then clauses.

``bag. On the left, a, b. On the right, c. Japanese text reads as "x", "y".``

A tokenizer walks a caption once and yields spans with their offsets; the parse
is a fold of the spans, so the two cannot disagree. Both reach Spark as Arrow
UDFs. Composing, flattening and cutting work on the parsed struct in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tags import distinct_by_key, normalize_tag

# Fixed values ----------------------------------------------------------------
POSITION_HEADERS = ("On the ", "In the ")
TEXT_HEADERS = ("Japanese text reads as ", "Japanese SFX reads as ")
QUOTES = (("「", "」"), ("『", "』"), ('"', '"'))

_TAGS = T.ArrayType(T.StringType())
_CLAUSE = T.StructType().add("position", T.StringType()).add("tags", _TAGS).add("prefix", T.StringType())
CLAUSE = _CLAUSE.simpleString()
PARSED = T.StructType().add("flat_tags", _TAGS).add("clauses", T.ArrayType(_CLAUSE))
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType()).add("kind", T.StringType()).add("clause", T.IntegerType()))

_QUOTED = re.compile("|".join(f"{o}[^{o}{c}]*{c}" for o, c in QUOTES))
_BORDER = re.compile(r"\.\s*(?=(?i:(?:on|in)\s+the\s)|" + "|".join(TEXT_HEADERS) + ")")
_HEADER = re.compile(r"(on|in)\s+the\s+(.+)", re.IGNORECASE | re.DOTALL)


def _pieces(caption: str, low: int, high: int, masked: str) -> Iterator[tuple[int, int]]:
    """Trimmed non-empty pieces between separators; ``masked`` hides quoted ones."""
    at = low
    for m in [*re.finditer(r"[,\n]", masked[low:high]), None]:
        end = high if m is None else low + m.start()
        text = caption[at:end]
        inner = text.strip()
        if inner:
            first = at + len(text) - len(text.lstrip())
            yield first, first + len(inner)
        at = end + 1


def _shorn(tag: str) -> str:
    """Without a closing period, if letters, digits or a closing quote remain."""
    rest = tag[:-1]
    if tag.endswith(".") and (any(ch.isalnum() for ch in rest) or rest.endswith(tuple(c for _, c in QUOTES))):
        return rest.rstrip()
    return tag


def _text_header(tag: str) -> str | None:
    return next((h for h in TEXT_HEADERS if tag.startswith(h) or tag == h.rstrip()), None)


def tag_spans(caption: str) -> list[dict]:
    """start, end, text, kind (header, artist, tag) and clause (-1: the bag)."""
    masked = _QUOTED.sub(lambda m: "\0" * len(m[0]), caption)
    segments, at = [], 0
    for m in _BORDER.finditer(caption):
        if masked[m.start()] != "\0":
            segments.append((at, m.start()))
            at = m.end()
    segments.append((at, len(caption)))
    out: list[dict] = []
    clause = -1

    def add(start: int, text: str, kind: str) -> None:
        out.append({"start": start, "end": start + len(text), "text": text, "kind": kind, "clause": clause})

    for number, (low, high) in enumerate(segments):
        for j, (first, last) in enumerate(_pieces(caption, low, high, masked)):
            text = _shorn(caption[first:last])
            looks = text.startswith(POSITION_HEADERS) or _text_header(text) is not None
            # Later segments open with a header by their place; in the first, any tag may be one.
            if (number > 0 and j == 0) or (looks and (j == 0 or number == 0)):
                clause += 1
                header = _text_header(text)
                add(first, header.rstrip() if header else text, "header")
                if header and (rest := text[len(header) :].strip()):
                    add(caption.index(rest, first + len(header)), rest, "tag")
            else:
                add(first, text, "artist" if len(text) > 1 and text[0] == "@" and not text[1].isspace() else "tag")
    return out


def parse(caption: str) -> dict:
    """flat_tags and clauses (position, tags, prefix)."""
    flat: list[str] = []
    clauses: list[dict] = []
    for span in tag_spans(caption):
        if span["kind"] != "header":
            (clauses[-1]["tags"] if clauses else flat).append(span["text"])
        elif header := _text_header(span["text"]):
            clauses.append({"position": "", "tags": [], "prefix": header})
        else:
            m = _HEADER.fullmatch(span["text"])
            clauses.append({"position": m[2].strip() if m else span["text"], "tags": [], "prefix": f"{m[1].capitalize()} the " if m else "On the "})
    return {"flat_tags": flat, "clauses": clauses}


@F.pandas_udf(PARSED)
def parse_caption(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        yield pd.DataFrame([parse(x or "") for x in s], columns=["flat_tags", "clauses"])


@F.pandas_udf(SPANS)
def caption_spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: tag_spans(x or ""))


def parse_plain(c: Column) -> Column:
    """The bag of a caption without clauses, quotes or line breaks, in the JVM."""
    tags = F.transform(F.split(c, r"[,\n]"), lambda x: F.btrim(x))
    tags = F.filter(tags, lambda t: t != "")
    return F.transform(tags, lambda t: F.when(t.rlike(r"[\p{L}\p{N}].*\.$"), F.regexp_replace(t, r"\s*\.$", "")).otherwise(t))


def is_text_clause(clause: Column) -> Column:
    return clause["prefix"].isin(*TEXT_HEADERS)


def position_clauses(parsed: Column) -> Column:
    return F.filter(parsed["clauses"], lambda c: ~is_text_clause(c))


def text_clauses(parsed: Column) -> Column:
    return F.filter(parsed["clauses"], is_text_clause)


def has_clauses(parsed: Column) -> Column:
    return F.size(position_clauses(parsed)) > 0


def has_text_clauses(parsed: Column) -> Column:
    return F.size(text_clauses(parsed)) > 0


def tag_keys(parsed: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parsed["flat_tags"], normalize_tag), lambda k: k != ""))


def _render(clause: Column) -> Column:
    text = F.rtrim(F.concat(clause["prefix"], F.array_join(clause["tags"], ", ")))
    head = F.concat(clause["prefix"], clause["position"])
    return F.when(is_text_clause(clause), text).otherwise(F.array_join(F.concat(F.array(head), clause["tags"]), ", "))


def compose(flat: Column, clauses: Column) -> Column:
    """Bag, then position clauses, then text clauses, ended by a period; a bare
    join where there are no clauses."""
    bag = F.array_join(F.filter(flat, lambda t: t != ""), ", ")
    shown = F.filter(clauses, lambda c: (F.size(c["tags"]) > 0) | (c["position"] != ""))
    ordered = F.concat(F.filter(shown, lambda c: ~is_text_clause(c)), F.filter(shown, is_text_clause))
    body = F.concat(F.array_join(F.transform(ordered, _render), ". "), F.lit("."))
    return F.when(F.size(ordered) == 0, bag).when(bag == "", body).otherwise(F.concat(bag, F.lit(". "), body))


def all_tags(parsed: Column) -> Column:
    """The bag's tags, then each position clause's."""
    return F.concat(parsed["flat_tags"], F.flatten(F.transform(position_clauses(parsed), lambda c: c["tags"])))


def flatten_caption(parsed: Column) -> Column:
    """Clauses merged back into the bag, each key once; text clauses stay."""
    return compose(distinct_by_key(all_tags(parsed)), text_clauses(parsed))


def partition_tags(parsed: Column, drops) -> tuple[Column, Column]:
    """(kept parse, dropped tags) by ``drops(tag, clause or None)``. Text clauses are
    out of reach; a position clause that loses all its tags goes."""
    flat = F.filter(parsed["flat_tags"], lambda t: ~drops(t, None))
    cut = F.transform(parsed["clauses"], lambda c: F.struct(c["position"].alias("position"), F.when(is_text_clause(c), c["tags"]).otherwise(F.filter(c["tags"], lambda t: ~drops(t, c))).alias("tags"), c["prefix"].alias("prefix"), (F.size(c["tags"]) == 0).alias("bare")))
    kept = F.filter(cut, lambda c: (F.size(c["tags"]) > 0) | c["bare"] | is_text_clause(c))
    kept = F.transform(kept, lambda c: F.struct(c["position"].alias("position"), c["tags"].alias("tags"), c["prefix"].alias("prefix")))
    gone = F.concat(F.filter(parsed["flat_tags"], lambda t: drops(t, None)), F.flatten(F.transform(position_clauses(parsed), lambda c: F.filter(c["tags"], lambda t: drops(t, c)))))
    return F.struct(flat.alias("flat_tags"), kept.alias("clauses")), gone


def quoted_spans(c: Column) -> Column:
    """Every closed quotation, marks included."""
    return F.regexp_extract_all(c, F.lit('「[^「」]*」|『[^『』]*』|"[^"]*"'), F.lit(0))


def text_clause(lines: Column, sound: bool) -> Column:
    from .lines import quote_text

    return F.struct(F.lit("").alias("position"), F.transform(F.filter(lines, lambda t: t != ""), lambda t: F.concat(F.lit('"'), quote_text(t), F.lit('"'))).alias("tags"), F.lit(TEXT_HEADERS[int(sound)]).alias("prefix"))
