"""Masks as rows: packed alpha bytes with their size, merged, measured, painted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Alpha of a detection's bytes: what it leaves.
LEFT = bytes([255, *[0] * 255])


def merge_masks(masks: DataFrame) -> DataFrame:
    """masks (name, place, height, width, alpha binary) -> one per name, the least alpha of
    all; a mask of another size is resampled to that of the first place, nearest pixel."""
    rows = masks.select("name", "place", "height", "width", "alpha").repartition("name").sortWithinPartitions("name", "place")
    return rows.mapInPandas(merged, "name string, height int, width int, alpha binary")


def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by name and place, merged a batch at a time; a batch's last name waits
    for its other rows as a mask of its own."""
    rest = None
    for pdf in parts:
        if pdf.empty:
            continue
        done = _least(pdf if rest is None else pd.concat([rest, pdf], ignore_index=True))
        yield done.iloc[:-1]
        rest = done.iloc[-1:]
    if rest is not None:
        yield rest


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    name, height, width = pdf["name"].to_numpy(object), pdf["height"].to_numpy(), pdf["width"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    if (height == height[0]).all() and (width == width[0]).all():
        stack = np.frombuffer(b"".join(pdf["alpha"]), np.uint8).reshape(len(pdf), height[0] * width[0])
        alpha = [a.tobytes() for a in np.minimum.reduceat(stack, first, axis=0)]
    else:
        alpha = []
        for i, j in zip(first, [*first[1:], len(pdf)], strict=True):
            each = [np.frombuffer(b, np.uint8).reshape(h, w) for b, h, w in zip(pdf["alpha"].iloc[i:j], height[i:j], width[i:j], strict=True)]
            now, (h, w) = each[0].copy(), each[0].shape
            for a in each[1:]:
                np.minimum(now, a if a.shape == now.shape else a[np.arange(h) * a.shape[0] // h][:, np.arange(w) * a.shape[1] // w], out=now)
            alpha.append(now.tobytes())
    return pd.DataFrame({"name": name[first], "height": height[first], "width": width[first], "alpha": alpha})


@F.pandas_udf(T.DoubleType())
def coverage_percent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Share of the bytes that are not zero, in percent."""
    for s in parts:
        yield s.map(lambda b: None if b is None else 100.0 * np.count_nonzero(np.frombuffer(b, np.uint8)) / max(len(b), 1))


@F.pandas_udf(T.BinaryType())
def ignore_mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Alpha of what a detection leaves: 0 where it detects, 255 elsewhere."""
    for s in parts:
        yield s.map(lambda b: None if b is None else b.translate(LEFT))


def label_maps(instances: DataFrame, height: int, width: int) -> DataFrame:
    """instances (image, box, x0..y1) -> image, labels (binary): i + 1 for the i-th box,
    later boxes over earlier ones, 255 at most."""
    rows = instances.repartition("image").sortWithinPartitions("image", "box")

    def paint(pdf: pd.DataFrame) -> bytes:
        out = np.zeros((height, width), np.uint8)
        for i, r in enumerate(pdf.itertuples(index=False)):
            if i < 255:
                out[max(0, int(r.y0)) : max(0, int(r.y1)), max(0, int(r.x0)) : max(0, int(r.x1))] = i + 1
        return out.tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["image"].iloc[-1] if len(pdf) else None
            done, rest = pdf[pdf["image"] != last], pdf[pdf["image"] == last]
            yield pd.DataFrame([(k, paint(p)) for k, p in done.groupby("image", sort=False)], columns=["image", "labels"])
        if rest is not None and len(rest):
            yield pd.DataFrame([(rest["image"].iloc[0], paint(rest))], columns=["image", "labels"])

    return rows.mapInPandas(run, "image long, labels binary")


def mask_overlap(a: np.ndarray, b: np.ndarray) -> float | None:
    """Shared pixels over those of the smaller mask; null if either is empty."""
    least = min(int(a.sum()), int(b.sum()))
    return float((a & b).sum()) / least if least else None


def box_fill(mask: np.ndarray, box: tuple[int, int, int, int]) -> float:
    x0, y0, x1, y1 = box
    window = mask[y0:y1, x0:x1]
    return float(window.mean()) if window.size else 0.0


def component_boxes(mask: np.ndarray, least_side: int, most_share: float = 0.4) -> list[tuple[int, int, int, int]]:
    """Boxes of the connected pixels of a boolean mask (eight neighbours), largest first;
    thin ones and ones that fill the page go. Labels spread along rows and columns."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        grown = label
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                shifted = np.zeros_like(label)
                shifted[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = label[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
                grown = np.maximum(grown, shifted)
        grown = np.where(mask, grown, 0)
        flat = np.concatenate([[0], grown.reshape(-1)])
        grown = np.where(mask, flat[grown], 0)  # a label stands for its own cell's label
        if (grown == label).all():
            break
        label = grown
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
        side, size = min(box[2] - box[0], box[3] - box[1]), (box[2] - box[0]) * (box[3] - box[1])
        if side >= least_side and size < most_share * h * w:
            out.append((size, box))
    return [b for _, b in sorted(out, key=lambda x: -x[0])]


def mask_bits(x0: Column, x1: Column, side: int) -> Column:
    """A row mask of ``side`` pixels, set from x0 to x1, as bytes; for tests and demos."""
    start = F.ceil(F.greatest(F.lit(0), F.least(x0, F.lit(side)))).cast("int")
    end = F.greatest(start, F.ceil(F.least(x1, F.lit(side))).cast("int"))
    bits = F.concat(F.repeat(F.lit("00"), start), F.repeat(F.lit("ff"), end - start), F.repeat(F.lit("00"), side - end))
    return F.to_binary(F.when(x0.isNull() | x1.isNull(), F.lit("00" * side)).otherwise(bits), F.lit("hex"))
