"""Boxes: measures, joins by overlap, nesting, padding, resize targets.

A box is columns x0, y0, x1, y1; joins are equi-joins on the image with the
geometric test on top. Order-bound suppression streams over rows sorted by image
and holds one image's boxes at a time.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Token bands of the resize tiers.
EDGE_BANDS = {512: (1008, 1024), 768: (2160, 2160), 896: (3000, 3024), 1024: (4032, 4200), 1280: (6300, 6300), 1536: (8640, 8640)}
FROZEN_EDGES = (1024,)
BAND_TOLERANCE = 0.025
MAX_RATIO = 4.0
PATCH, AXIS_CAP = 16, 256


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a, b) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    i = intersection(a, b)
    return _ratio(i, area(a) + area(b) - i)


def containment(a, b) -> Column:
    """Of the smaller."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def inside(inner, outer) -> Column:
    return _ratio(intersection(inner, outer), area(inner))


def overlapping(boxes: DataFrame, least_iou: float) -> DataFrame:
    """(image, a, b, iou) for pairs a < b of one image."""
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.box") < F.col("b.box")))
    value = iou(box("a."), box("b."))
    return pairs.where(value >= least_iou).select(F.col("a.image").alias("image"), F.col("a.box").alias("a"), F.col("b.box").alias("b"), F.round(value, 6).alias("iou"))


def denest(boxes: DataFrame, policy: str = "inner", least: float = 0.85, explained: float = 0.2) -> DataFrame:
    """Boxes that stay: ``inner`` drops one that holds two smaller ones, unless these
    explain too little of it by area and score; ``outer`` drops one inside a larger."""
    if policy == "raw":
        return boxes
    a, b = boxes.alias("a"), boxes.alias("b")
    other = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.box") != F.col("b.box")))
    mine, theirs = box("a."), box("b.")
    if policy == "outer":
        gone = other.where((area(theirs) > area(mine)) & (inside(mine, theirs) >= least))
        return boxes.join(gone.select(F.col("a.image").alias("image"), F.col("a.box").alias("box")).distinct(), ["image", "box"], "left_anti")
    if policy != "inner":
        raise ValueError("policy must be inner, outer or raw")
    held = other.where((area(theirs) < area(mine)) & (inside(theirs, mine) >= least))
    per = held.groupBy(F.col("a.image").alias("image"), F.col("a.box").alias("box")).agg(F.count(F.lit(1)).alias("n"), F.sum(area(theirs) * F.col("b.score")).alias("w"), F.max(area(mine) * F.col("a.score")).alias("own"))
    gone = per.where((F.col("n") >= 2) & (F.col("w") / F.greatest(F.col("own"), F.lit(1e-9)) >= explained))
    return boxes.join(gone, ["image", "box"], "left_anti")


def drop_nested(lines: DataFrame, least: float = 0.85) -> DataFrame:
    """Lines that sit in no larger line of their kind."""
    a, b = lines.alias("a"), lines.alias("b")
    inner, outer = box("a."), box("b.")
    gone = a.join(b, (F.col("a.image") == F.col("b.image")) & F.col("a.kind").eqNullSafe(F.col("b.kind"))).where((area(outer) > area(inner)) & (inside(inner, outer) >= least))
    return lines.join(gone.select(F.col("a.image").alias("image"), F.col("a.box").alias("box")).distinct(), ["image", "box"], "left_anti")


def uncovered(components: DataFrame, lines: DataFrame, least_iou: float = 0.3, least_containment: float = 0.5) -> DataFrame:
    """Components that no line covers."""
    a, b = components.alias("a"), lines.alias("b")
    hit = a.join(b, F.col("a.image") == F.col("b.image")).where((iou(box("a."), box("b.")) >= least_iou) | (containment(box("a."), box("b.")) >= least_containment))
    return components.join(hit.select(F.col("a.image").alias("image"), F.col("a.box").alias("box")).distinct(), ["image", "box"], "left_anti")


def _np_iou(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(IoU, containment) of a box against boxes."""
    size = lambda b: np.maximum(b[..., 2] - b[..., 0], 0) * np.maximum(b[..., 3] - b[..., 1], 0)
    shared = np.maximum(np.minimum(one[2], many[:, 2]) - np.maximum(one[0], many[:, 0]), 0) * np.maximum(np.minimum(one[3], many[:, 3]) - np.maximum(one[1], many[:, 1]), 0)
    both, least = size(one) + size(many) - shared, np.minimum(size(one), size(many))
    return np.divide(shared, both, out=np.zeros_like(shared), where=both > 0), np.divide(shared, least, out=np.zeros_like(shared), where=least > 0)


def _per_image(rows: DataFrame, pick, schema) -> DataFrame:
    """Frames made of whole images: ``pick(frame, cuts)`` gets rows sorted by image and
    where each image ends. Small groups share a batch, so they cost no more than
    large ones; a batch's last image waits for its other rows."""

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            images = pdf["image"].to_numpy()
            cuts = np.flatnonzero(images[1:] != images[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield pick(pdf.iloc[:last], cuts.tolist())
            rest = pdf.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pick(rest, [len(rest)])

    return rows.repartition("image").sortWithinPartitions("image").mapInPandas(stream, schema)


def _greedy(xy: np.ndarray, order: np.ndarray, always: np.ndarray, iou_limit: float, containment_limit: float) -> list[int]:
    """Rows of one image that stay, tried in ``order``; ``always`` ones do not ask."""
    kept: list[int] = []
    for i in order.tolist():
        if kept and not always[i]:
            overlap, held = _np_iou(xy[i], xy[kept])
            if ((overlap >= iou_limit) | (held >= containment_limit)).any():
                continue
        kept.append(i)
    return kept


def _kept(pdf: pd.DataFrame, cuts: list[int], always: np.ndarray, iou_limit: float, containment_limit: float) -> pd.DataFrame:
    xy, score, box = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["score"].to_numpy(), pdf["box"].to_numpy()
    rows: list[int] = []
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        order = np.lexsort((box[a:b], -score[a:b], ~always[a:b]))
        rows += [a + i for i in _greedy(xy[a:b], order, always[a:b], iou_limit, containment_limit)]
    return pdf.iloc[rows]


def suppress(boxes: DataFrame, iou_limit: float = 0.65, containment_limit: float = 1.01) -> DataFrame:
    """Greedy suppression: by score, ties by box; a box that meets a kept one goes."""
    pick = lambda pdf, cuts: _kept(pdf, cuts, np.zeros(len(pdf), bool), iou_limit, containment_limit)
    return _per_image(boxes, pick, boxes.schema)


def suppression_pairs(boxes: DataFrame, iou_limit: float = 0.65) -> DataFrame:
    """Each box that greedy suppression by IoU drops, with the first kept box that it
    meets: image, kept, dropped, kept_score, dropped_score."""

    def pick(pdf: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        xy, score, box = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["score"].to_numpy(), pdf["box"].to_numpy()
        kept, gone = [], []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            stay: list[int] = []
            for i in (a + np.lexsort((box[a:b], -score[a:b]))).tolist():
                hits = np.flatnonzero(_np_iou(xy[i], xy[stay])[0] >= iou_limit) if stay else ()
                if len(hits):
                    kept.append(stay[hits[0]])
                    gone.append(i)
                else:
                    stay.append(i)
        return pd.DataFrame({"image": pdf["image"].to_numpy()[gone], "kept": box[kept], "dropped": box[gone], "kept_score": score[kept], "dropped_score": score[gone]})

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    return _per_image(boxes, pick, f"image {kinds['image']}, kept {kinds['box']}, dropped {kinds['box']}, kept_score {kinds['score']}, dropped_score {kinds['score']}")


def merge_parts(subjects: DataFrame, parts: DataFrame, iou_limit: float = 0.65, containment_limit: float = 0.7) -> DataFrame:
    """All subjects, and parts by score that meet nothing kept so far."""
    rows = subjects.withColumn("_part", F.lit(0)).unionByName(parts.withColumn("_part", F.lit(1)))
    pick = lambda pdf, cuts: _kept(pdf, cuts, pdf["_part"].to_numpy() == 0, iou_limit, containment_limit).drop(columns="_part")
    return _per_image(rows, pick, subjects.schema)


def small_boxes(boxes: DataFrame, width: float, height: float, least_fraction: float) -> DataFrame:
    return boxes.where(area(box()) >= least_fraction * width * height)


def largest(boxes: DataFrame, least_side: float, least_score: float, n: int) -> DataFrame:
    """The ``n`` largest boxes of each image above the floors."""
    kept = boxes.where((F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= least_side) & (F.col("score") >= least_score))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("image").orderBy(F.desc(area(box())), "box"))).where(F.col("_r") <= n).drop("_r")


def reading_order(lines: DataFrame, vertical_ratio: float = 1.5) -> DataFrame:
    """lines with ``place`` from 1: columns right to left on a page set in columns,
    else rows top to bottom; the band is half the upper median thickness."""
    w = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")).cast("int"))
    h = F.greatest(F.lit(1), (F.col("y1") - F.col("y0")).cast("int"))
    per = lines.groupBy("image").agg(
        F.sum((h >= vertical_ratio * w).cast("int")).alias("_tall"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(w)).alias("_w"), F.sort_array(F.collect_list(h)).alias("_h")
    )  # one page's lines
    middle = F.floor(F.size("_w") / 2).cast("int") + 1
    columns = F.col("_tall") * 2 >= F.col("_n")
    band = F.greatest(F.lit(1), F.floor(F.when(columns, F.element_at("_w", middle)).otherwise(F.element_at("_h", middle)) / 2))
    rows = lines.join(per.select("image", columns.alias("_columns"), band.alias("_band")), "image")
    first = F.when(F.col("_columns"), -F.floor(F.col("x1") / F.col("_band"))).otherwise(F.floor(F.col("y0") / F.col("_band")))
    second = F.when(F.col("_columns"), F.col("y0")).otherwise(F.col("x0"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(first, second, "box"))).drop("_columns", "_band")


def lanes(boxes: DataFrame, gap: float = 0.5) -> DataFrame:
    """boxes with ``lane`` from 0: a new one where the distance to the centre before
    exceeds ``gap`` of the narrower box."""
    centre = (F.col("x0") + F.col("x1")) / 2
    order = Window.partitionBy("image").orderBy(centre, "box")
    wide = F.col("x1") - F.col("x0")
    new = (centre - F.lag(centre).over(order) > gap * F.least(wide, F.lag(wide).over(order))).cast("int")
    return boxes.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("lane", F.sum("_new").over(order).cast("int")).drop("_new")


def rows_of(boxes: DataFrame, overlap: float = 0.25) -> DataFrame:
    """boxes with ``row`` from 0: intervals that overlap the running span by at least
    ``overlap`` of the narrower chain; a fold over one image's boxes in the JVM."""
    per = boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "box"))).alias("b"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.array().cast("array<struct<box:int,row:int>>").alias("out"))

    def step(s, x):
        shared = F.least(s["high"], x["y1"]) - F.greatest(s["low"], x["y0"])
        narrow = F.least(s["high"] - s["low"], x["y1"] - x["y0"])
        new = (s["row"] < 0) | (narrow <= 0) | (shared < overlap * narrow)
        row = s["row"] + F.when(new, 1).otherwise(0)
        return F.struct(
            row.alias("row"), F.when(new, x["y0"]).otherwise(F.least(s["low"], x["y0"])).alias("low"), F.when(new, x["y1"]).otherwise(F.greatest(s["high"], x["y1"])).alias("high"),
            F.concat(s["out"], F.array(F.struct(x["box"].cast("int").alias("box"), row.cast("int").alias("row")))).alias("out"),
        )

    found = per.select("image", F.explode(F.aggregate("b", start, step)["out"]).alias("o")).select("image", F.col("o.box").alias("box"), F.col("o.row").alias("row"))
    return boxes.join(found, ["image", "box"])


ORDINALS = ("second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
ROW_WORDS = {1: ("",), 2: ("top", "bottom"), 3: ("top", "middle", "bottom")}
EDGE_HUG, EDGE_CLEAR, LANE_GAP = 0.15, 0.47, 0.5


def horizontal_names(n: int) -> list[str]:
    if n < 4:
        return [[], ["center"], ["left", "right"], ["left", "middle", "right"]][n]
    inner = [f"{ORDINALS[i] if i < len(ORDINALS) else f'{i + 2}th'} from left" for i in range(n - 2)]
    return ["leftmost", *inner, "rightmost"]


def _chains(spans: np.ndarray, overlap: float) -> np.ndarray:
    """Group of each interval: sorted, joined while the running span overlaps enough."""
    order = np.lexsort((spans[:, 1], spans[:, 0]))
    out, group, span = np.zeros(len(spans), int), -1, (0.0, 0.0)
    for i in order:
        a, b = spans[i]
        narrow = min(span[1] - span[0], b - a)
        if group < 0 or narrow <= 0 or min(span[1], b) - max(span[0], a) < overlap * narrow:
            group, span = group + 1, (a, b)
        else:
            span = (min(span[0], a), max(span[1], b))
        out[i] = group
    return out


def _lane_groups(spans: np.ndarray) -> np.ndarray:
    centre, wide = spans.mean(1), spans[:, 1] - spans[:, 0]
    order = np.argsort(centre, kind="stable")
    jump = np.diff(centre[order]) > LANE_GAP * np.minimum(wide[order][1:], wide[order][:-1])
    out = np.zeros(len(spans), int)
    out[order] = np.concatenate([[0], np.cumsum(jump)])
    return out


def position_names(xy: np.ndarray, overlap: float = 0.25) -> tuple[list[str], list[int]]:
    """(name of each box, reading order). Rows first; where all boxes share a row,
    columns; where nothing separates, or a group outgrows the words, left to right."""
    n = len(xy)
    if not n:
        return [], []
    mid = {0: (xy[:, 0] + xy[:, 2]) / 2, 1: (xy[:, 1] + xy[:, 3]) / 2}
    groups = _chains(xy[:, [1, 3]], overlap)
    by_row = groups.max() > 0
    if not by_row:
        groups = _lane_groups(xy[:, [0, 2]])
    count = int(groups.max()) + 1
    minor = mid[0] if by_row or count == 1 else mid[1]
    reading = sorted(range(n), key=lambda i: (groups[i], minor[i]))
    plain = [""] * n
    for name, i in zip(horizontal_names(n), sorted(range(n), key=lambda i: mid[0][i]), strict=True):
        plain[i] = name
    members = [[i for i in reading if groups[i] == g] for g in range(count)]
    if count == 1 or (count if by_row else max(map(len, members))) > max(ROW_WORDS):
        return plain, reading

    def edge(i: int, axis: int, words: tuple[str, str]) -> str:
        low, high = xy[:, axis].min(), xy[:, axis + 2].max()
        if high <= low:
            return ""
        near, far = (xy[i, axis] - low) / (high - low), (high - xy[i, axis + 2]) / (high - low)
        if near <= EDGE_HUG and far >= EDGE_CLEAR:
            return words[0]
        return words[1] if far <= EDGE_HUG and near >= EDGE_CLEAR else ""

    out = [""] * n
    across = ROW_WORDS[count] if by_row else horizontal_names(count)
    for g, inner in enumerate(members):
        if len(inner) == 1:
            side = edge(inner[0], 0 if by_row else 1, ("left", "right") if by_row else ("top", "bottom"))
            words = [(across[g], side) if by_row else (side, across[g])]
        elif by_row:
            words = [(across[g], w) for w in horizontal_names(len(inner))]
        else:
            words = [(w, across[g]) for w in ROW_WORDS[len(inner)]]
        for i, pair in zip(inner, words, strict=True):
            out[i] = " ".join(pair).strip()
    return out, reading


def assign_positions(boxes: DataFrame, overlap: float = 0.25) -> DataFrame:
    """(image, box, position, place): names and reading order, per image."""

    def pick(pdf: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        xy, box = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["box"].to_numpy()
        names, places, rows = [], [], []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            order = np.argsort(box[a:b], kind="stable")
            named, reading = position_names(xy[a:b][order], overlap)
            place = np.empty(b - a, int)
            place[reading] = np.arange(1, b - a + 1)
            names += named
            places.append(place)
            rows.append(a + order)
        rows = np.concatenate(rows)
        return pd.DataFrame({"image": pdf["image"].to_numpy()[rows], "box": box[rows], "position": names, "place": np.concatenate(places)})

    return _per_image(boxes, pick, "image long, box int, position string, place int")


def pad_box(b, width: Column, height: Column, pad: float = 0.12) -> tuple[Column, ...]:
    grow = F.bround(pad * F.greatest(b[2] - b[0], b[3] - b[1]), 0)
    return F.greatest(F.lit(0.0), b[0] - grow), F.greatest(F.lit(0.0), b[1] - grow), F.least(width, b[2] + grow), F.least(height, b[3] + grow)


def tight_pad_box(b, width: Column, height: Column, fraction: float = 0.12, short_fraction: float = 0.3, most: float = 4) -> tuple[Column, ...]:
    w, h = b[2] - b[0], b[3] - b[1]
    p = F.least(fraction * F.greatest(w, h), short_fraction * F.least(w, h), F.lit(most))
    return tuple(F.bround(x, 0) for x in (F.greatest(F.lit(0.0), b[0] - p), F.greatest(F.lit(0.0), b[1] - p), F.least(width, b[2] + p), F.least(height, b[3] + p)))


def centred_box(b, width: Column, height: Column) -> Column:
    """[y0, x0, y1, x1] from the middle of the canvas, clamped to it."""
    at = lambda v, side: F.bround(F.least(F.greatest(v, F.lit(0.0)), side) - side / 2, 0).cast("int")
    return F.array(at(b[1], height), at(b[0], width), at(b[3], height), at(b[2], width))


def margin_box(width: Column, height: Column, top: float, right: float, bottom: float, left: float) -> tuple[Column, ...]:
    """Pixels left after percent margins; opposite ones are scaled to 95 together."""
    scale = lambda a, b: (a * 95 / (a + b), b * 95 / (a + b)) if a + b >= 95 else (a, b)
    (left, right), (top, bottom) = scale(max(left, 0.0), max(right, 0.0)), scale(max(top, 0.0), max(bottom, 0.0))
    x0, y0 = F.bround(width * left / 100, 0), F.bround(height * top / 100, 0)
    return x0, y0, F.greatest(x0 + 1, F.bround(width - width * right / 100, 0)), F.greatest(y0 + 1, F.bround(height - height * bottom / 100, 0))


def choose_edge(width: Column, height: Column, tiers: tuple[int, ...] = tuple(EDGE_BANDS)) -> Column:
    """The tier whose middle is nearest to the native tokens by ratio; the first of equals."""
    native = (width / 16.0) * (height / 16.0)
    costs = F.array(*[F.struct(F.abs(F.ln(F.lit(sum(EDGE_BANDS[e]) / 2) / native)).alias("cost"), F.lit(i).alias("i"), F.lit(e).alias("edge")) for i, e in enumerate(tiers)])
    return F.array_min(costs)["edge"]


def grids(spark: SparkSession, edges: tuple[int, ...] = tuple(EDGE_BANDS), cap: int = AXIS_CAP) -> DataFrame:
    """(edge, bands): for each grid height hp of a tier the widths low to high in its
    band; a table of fixed size."""
    rows = []
    for edge in edges:
        low, high = EDGE_BANDS[edge]
        if edge not in FROZEN_EDGES:
            low, high = round(low * (1 - BAND_TOLERANCE)), round(high * (1 + BAND_TOLERANCE))
        spans = ((edge, hp, max(1, -(-low // hp)), min(cap, high // hp)) for hp in range(1, min(cap, high) + 1))
        rows.append((edge, [r[1:] for r in spans if r[2] <= r[3]]))
    return spark.createDataFrame(rows, "edge int, bands array<struct<hp:int,low:int,high:int>>")


def fit_buckets(spark: SparkSession, images: DataFrame, tiers: tuple[int, ...] = tuple(EDGE_BANDS), max_ratio: float = MAX_RATIO) -> DataFrame:
    """images (image, width, height) with edge, bucket_width, bucket_height: the grid of
    the tier with the nearest aspect, then the least rescaling, then the smallest shape.
    Sizes repeat, so each distinct size is solved once; of the widths of a height
    only the two around the aspect can be nearest."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    sizes = images.select("width", "height").distinct().withColumn("edge", choose_edge(w, h, tiers))
    near = F.least(F.greatest(w / h, F.lit(1 / max_ratio)), F.lit(float(max_ratio)))
    sizes = sizes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "width", "height")  # few bytes, much work
    rows = sizes.withColumn("near", near).join(F.broadcast(grids(spark, tiers)), "edge")  # a fixed table

    def key(band: Column, wp: Column) -> Column:
        wp = F.least(F.greatest(wp.cast("int"), band["low"]), band["high"])
        cover = F.greatest(wp * PATCH / w, band["hp"] * PATCH / h)
        whole = lambda x: F.floor(x * 1e12 + 0.5)  # noqa: E731  (twelve places, without decimals)
        return F.struct(whole(F.abs(wp / band["hp"] - F.col("near"))).alias("a"), whole(F.abs(F.ln(cover))).alias("c"), band["hp"].alias("hp"), wp.alias("wp"))

    around = lambda f: F.transform("bands", lambda band: key(band, f(F.col("near") * band["hp"])))
    nearest = F.array_min(F.concat(around(F.floor), around(F.ceil)))
    best = rows.select("width", "height", "edge", F.explode(F.array(nearest)).alias("best"))  # a generator, so it is worked out once
    best = best.select("width", "height", "edge", (F.col("best.wp") * PATCH).alias("bucket_width"), (F.col("best.hp") * PATCH).alias("bucket_height"))
    return images.join(best, ["width", "height"])


def capped_size(width: Column, height: Column, cap: int) -> Column:
    """[w, h] scaled to at most ``cap`` tokens, floored; null where it already fits."""
    scale = F.sqrt(F.lit(cap * 256.0) / (width * height))
    return F.when((F.lit(cap) > 0) & (width * height > cap * 256), F.array(F.greatest(F.lit(1), F.floor(width * scale)).cast("int"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int")))


def decode_head(rows: DataFrame, least_score: float, side: float) -> DataFrame:
    """cx, cy, w, h, score -> clipped corners of rows above the floor."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(side)))
    kept = rows.where(F.col("score") >= least_score)
    return kept.select("image", "box", clip(F.col("cx") - F.col("w") / 2).alias("x0"), clip(F.col("cy") - F.col("h") / 2).alias("y0"), clip(F.col("cx") + F.col("w") / 2).alias("x1"), clip(F.col("cy") + F.col("h") / 2).alias("y1"), "score")


