"""Clauses of an image's crops: which tags each gets, and which leave the bag.

Choosing is sequential inside an image (what one candidate takes, the next may
not), so it runs in Arrow batches over rows sorted by image. What can be a join
or a window is one: gates, relaxation and the plan of removals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE_PER_SUBJECT = ("hair_color", "eye_color")


@dataclass(frozen=True)
class Policy:
    """Knobs and tables of the choice; tables name groups or tags."""

    max_tags: int = 8
    max_novel: int = 1
    name_confidence: float = 0.5
    discriminative_only: bool = True
    bag_gated: bool = True
    bind_framing: bool = True
    free_groups: bool = False
    unlisted_names: bool = False
    priority: tuple[str, ...] = ()
    exclusive: frozenset[str] = frozenset()
    identity: frozenset[str] = frozenset()
    gated: frozenset[str] = frozenset()
    invariant: frozenset[str] = frozenset()
    subject: frozenset[str] = frozenset()
    scene: frozenset[str] = frozenset()
    excluded: frozenset[str] = frozenset()
    page_level: frozenset[str] = frozenset()
    characters: frozenset[str] = frozenset()
    structural: frozenset[str] = frozenset()
    group_of: dict[str, str] = field(default_factory=dict)


def choose(kept: dict[str, float], winners: dict[str, str], bag: frozenset[str], own: frozenset[str], shared: frozenset[str], policy: Policy, *, has_head: bool = True, repeated: bool = False) -> list[str]:
    """Tags of one crop's clause, most telling first.

    Ranked: one character name, the winner of each priority group (one the bag
    names before the model's), then the rest, bag tags first and by score. All
    bag tags are tried before any novel one; each passes every veto.
    """
    group = policy.group_of.get
    by_score = sorted(kept, key=lambda x: -kept[x])
    ranked: list[str] = []
    if not repeated:
        names = [x for x in by_score if x in policy.characters and kept[x] >= policy.name_confidence and (policy.unlisted_names or x in bag)]
        ranked += names[:1]
    for g in policy.priority:
        members = [x for x in by_score if group(x) == g]
        pick = next((x for x in members if x in bag), None) or winners.get(g) or next(iter(members), None)
        if pick and pick not in ranked:
            ranked.append(pick)
    closed = policy.characters | policy.excluded | policy.scene | policy.structural
    rest = [x for x in by_score if x not in ranked and x not in closed and (group(x) in policy.subject or (x in bag and (x in own or (policy.free_groups and group(x) is None))))]
    ranked += [x for x in rest if x in bag] + [x for x in rest if x not in bag]

    spoken = {g for g in policy.gated if policy.bag_gated and any(group(x) == g for x in bag)}
    single = frozenset(ONE_PER_SUBJECT) if policy.free_groups else policy.exclusive
    taken: dict[str, str | None] = {}

    def vetoed(x: str) -> bool:
        g = group(x)
        return (
            (policy.discriminative_only and x in shared) or x in policy.excluded or x in policy.page_level or (g in single and g in taken.values())
            or (not has_head and g in policy.identity) or (repeated and g in policy.invariant) or (not policy.bind_framing and g == "framing") or (g in spoken and x not in bag)
        )

    novel = policy.max_novel
    for want_bag in (True, False):
        for x in ranked:
            if len(taken) >= policy.max_tags or (not want_bag and novel <= 0):
                break
            if (x in bag) == want_bag and x not in taken and not vetoed(x):
                taken[x] = group(x)
                novel -= not want_bag
    return [x for x in ranked if x in taken]


def clause_tags(scores: DataFrame, bags: DataFrame, policy: Policy) -> DataFrame:
    """(image, crop, place, tag). scores (image, crop, tag, score): what each crop kept;
    bags (image, bag array, repeated boolean)."""
    # bags are as many as the images, so never a broadcast, however small their file
    rows = scores.join(bags.hint("merge"), "image").select(F.col("image").cast("long"), F.col("crop").cast("int"), "tag", F.col("score").cast("double"), F.col("bag").cast("array<string>"), "repeated")
    rows = rows.repartition("image").sortWithinPartitions("image", "crop", F.desc("score"), "tag")
    return rows.mapInArrow(partial(clause_rows, policy=policy), "image long, crop int, place int, tag string")


def clause_rows(parts: Iterator[pa.RecordBatch], policy: Policy) -> Iterator[pa.RecordBatch]:
    """Clauses of rows (image, crop, tag, score, bag, repeated) sorted by image, crop,
    falling score and tag. A batch's last image waits for its other rows."""
    chooser, rest, last = _Chooser(policy), [], None
    for part in parts:
        if not len(part):
            continue
        image = part["image"].to_numpy()
        cut = int(np.searchsorted(image, image[-1]))
        if cut or image[0] != last:
            done = pa.Table.from_batches([*rest, part.slice(0, cut)])
            if len(done):
                yield chooser.clauses(done)
            rest, last = [], image[-1]
        rest.append(part.slice(cut))
    if rest:
        yield chooser.clauses(pa.Table.from_batches(rest))


class _Chooser:
    """Clauses of whole images. Crops that kept like tags in like order, under like
    bags, have like clauses; ``choose`` is asked once for them, and up to ``MOST``
    answers are remembered."""

    MOST = 1 << 16

    def __init__(self, policy: Policy):
        self.policy = policy
        self.forget()

    def forget(self) -> None:
        self.tags: dict[str, int] = {}
        self.bags: dict[tuple, int] = {}
        self.answers: dict[tuple[int, bytes], int] = {}
        self.chosen: list[list[str]] = []

    def clauses(self, rows: pa.Table) -> pa.RecordBatch:
        if max(len(self.tags), len(self.bags), len(self.answers)) > self.MOST:
            self.forget()
        rows = rows.combine_chunks()
        image, crop = rows["image"].to_numpy(), rows["crop"].fill_null(-1).to_numpy()
        # null tags say nothing, but their crop counts
        coded = rows["tag"].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        tag = np.array([*(self.tags.setdefault(x, len(self.tags)) for x in names), -1], np.int64)[coded.indices.fill_null(len(names)).to_numpy()]
        score = rows["score"].to_numpy().astype(float)
        new_image = np.concatenate([[True], image[1:] != image[:-1]])
        new_crop = new_image | np.concatenate([[True], crop[1:] != crop[:-1]])
        of_image, of_crop = np.cumsum(new_image) - 1, np.cumsum(new_crop) - 1
        # a tag that stands twice in a crop counts by its first, its best score
        _, once = np.unique(of_crop * (len(self.tags) + 1) + tag + 1, return_index=True)
        once = np.sort(once[tag[once] >= 0])
        at, kept, place_of = of_image[once], tag[once], of_crop[once]
        _, where, n = np.unique(at * len(self.tags) + kept, return_inverse=True, return_counts=True)
        held, crops = n[where], np.bincount(of_image[new_crop])[at]
        own, shared, sure = held == 1, (held == crops) & (crops > 1), score[once] >= self.policy.name_confidence
        mark = (((kept * 2 + own) * 2 + shared) * 2 + sure).tobytes()

        first = np.flatnonzero(new_image)
        bag = rows["bag"].combine_chunks().take(pa.array(first)).to_pylist()
        again = rows["repeated"].combine_chunks().take(pa.array(first)).to_pylist()
        bag_id = [self.bags.setdefault((bool(r), *(b or ())), len(self.bags)) for b, r in zip(bag, again, strict=True)]
        starts = np.flatnonzero(new_crop)
        ends = np.searchsorted(place_of, np.arange(len(starts)), side="right").tolist()
        answer, a = np.empty(len(starts), np.int64), 0
        for i, (k, b) in enumerate(zip(of_image[starts].tolist(), ends, strict=True)):
            key = bag_id[k], mark[8 * a : 8 * b]
            known = self.answers.get(key)
            if known is None:
                known = self.answers[key] = len(self.chosen)
                row = [(names[coded.indices[j].as_py()], score[j]) for j in once[a:b].tolist()]
                mine = [frozenset(x for (x, _), y in zip(row, ys[a:b], strict=True) if y) for ys in (own, shared)]
                self.chosen.append(choose(dict(row), {}, frozenset(bag[k] or ()), *mine, self.policy, repeated=bool(again[k])))
            answer[i], a = known, b

        used, answer = np.unique(answer, return_inverse=True)
        chosen = [self.chosen[k] for k in used.tolist()]
        length = np.array([len(x) for x in chosen], np.int64)
        begin, n = np.cumsum(length) - length, length[answer]
        of = np.repeat(np.arange(len(starts)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        words = pa.array([x for each in chosen for x in each], pa.string())
        at_crop = pa.array(starts[of])
        columns = [rows["image"].combine_chunks().take(at_crop), rows["crop"].combine_chunks().take(at_crop), pa.array(place, pa.int32()), words.take(pa.array(begin[answer][of] + place))]
        return pa.RecordBatch.from_arrays(columns, ["image", "crop", "place", "tag"])


def bag_removals(clauses: DataFrame, scores: DataFrame, bag: DataFrame, margin: float, invariant: Column | None = None, thin: bool = False) -> DataFrame:
    """(image, tag, crop, verdict) of bag tags that clauses carry: moved, or why not.

    clauses (image, crop, tag), scores (image, crop, tag, score), bag (image, tag,
    grp, is_name, pinned). A name stays; so does a tag of several clauses, one whose
    group is the character's own unless the bag has two values of it and no marker
    explains them, one that another crop kept too, and one whose runner-up is near.
    """
    held = clauses.join(bag, ["image", "tag"])
    count = held.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image", "tag")))
    own = scores.select("image", "tag", F.col("crop").alias("c"), "score")
    rivals = count.join(own, ["image", "tag"], "left").groupBy("image", "tag", "crop", "n", "grp", "is_name", "pinned").agg(
        F.max(F.when(F.col("c") == F.col("crop"), F.col("score"))).alias("mine"), F.max(F.when(F.col("c") != F.col("crop"), F.col("score"))).alias("rival")
    )
    values = bag.where("grp is not null").groupBy("image", "grp").agg(F.count_distinct("tag").alias("values"))
    rows = rivals.join(values, ["image", "grp"], "left")
    slack = F.when(F.col("mine") > 0, 1 - F.coalesce("rival", F.lit(0.0)) / F.col("mine")).otherwise(F.lit(0.0))
    of_character = F.lit(False) if invariant is None else invariant
    if thin:
        return rows.select("image", "tag", "crop", F.when(F.col("is_name"), "character-name").otherwise("moved").alias("verdict"))
    verdict = (
        F.when(F.col("n") > 1, "multi-clause").when(F.col("is_name"), "character-name").when(of_character & F.col("pinned"), "two-tone-marker").when(of_character & (F.coalesce("values", F.lit(0)) < 2), "sole-value")
        .when(F.col("rival").isNotNull() & (F.col("rival") >= 0.5), "multi-kept").when(slack < margin, "margin").otherwise("moved")
    )
    return rows.select("image", "tag", "crop", verdict.alias("verdict"))


def count_gate(detected: Column, expected: Column, boys: Column, panels: Column, least: int = 2, most: int = 8) -> Column:
    """Why detections cannot be bound to a caption's counts, else null. Null expected or
    boys: the caption does not say; panels: the most subjects a page can hold."""
    upper = F.when(boys.isNull(), F.lit(None)).otherwise(expected + boys)
    known = F.coalesce(expected, F.lit(0)) > 0
    return (
        F.when(detected < least, "skip:too-few-instances").when(detected > most, "skip:too-many-instances")
        .when(known & ((detected < expected) | F.coalesce(detected > upper, F.lit(False))), "skip:count-mismatch")
        .when(~known & F.coalesce(detected > panels, F.lit(False)), "skip:count-mismatch")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (image, tags array) -> image, same, gained, lost; most changed first by size."""
    both = a.select("image", F.col("tags").alias("x")).join(b.select("image", F.col("tags").alias("y")), "image", "full")
    none = F.array().cast("array<string>")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    gained, lost = F.size(F.array_except(y, x)), F.size(F.array_except(x, y))
    return both.select("image", ((gained == 0) & (lost == 0)).alias("same"), gained.alias("gained"), lost.alias("lost"))
