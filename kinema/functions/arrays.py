"""Column expressions over landmark arrays, boxes and probability lists; all are Spark SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once for all its uses in f: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pose_reorder(pose: Column, order: Column, keep: Column) -> Column:
    """AR3: the joints of `keep` in that order; a joint that `order` lacks is null."""
    return F.transform(keep, lambda k: F.when(F.array_position(order, k) > 0, F.get(pose, (F.array_position(order, k) - 1).cast("int"))))


def combine_hands(left: Column, right: Column, n: int = 21) -> tuple[Column, Column]:
    """AR4: 2n coordinates, NaN and null reading 0, and a mask of the finite ones; a null hand is n missing joints."""
    side = lambda h: F.coalesce(h, F.array_repeat(F.lit(None).cast("double"), n))
    both = F.concat(side(left), side(right))
    good = lambda v: v.isNotNull() & ~F.isnan(v)
    return F.transform(both, lambda v: F.when(good(v), v).otherwise(0.0)), F.transform(both, good)


def mask_by_score(present: Column, score: Column, threshold: float, n: int = 21) -> Column:
    """AR6: all joints of a hand that is there with a score (null being 0) of at least the threshold."""
    return F.array_repeat(present & (F.coalesce(score, F.lit(0.0)) >= threshold), n)


def wrist_fallback(wrist: Column, pose_wrist: Column, visible: Column, world: bool) -> Column:
    """AR7: a missing wrist is the visible pose wrist, but for world coordinates."""
    return wrist if world else F.coalesce(wrist, F.when(visible, pose_wrist))


def hand_scale(xs: Column, ys: Column, least: int = 2) -> Column:
    """AR8: upper median distance of joints from the first, 0 if there are fewer than `least`."""
    first = F.struct(F.get(xs, F.lit(0)).alias("x"), F.get(ys, F.lit(0)).alias("y"))
    return _once(first, lambda p: _scale(F.zip_with(xs, ys, lambda x, y: F.hypot(x - p["x"], y - p["y"])), least))


def _scale(distances: Column, least: int) -> Column:
    """Upper median of the distances without the smallest, the first joint's own, 0 if there are fewer than `least`."""
    rest = _once(F.array_sort(distances), lambda d: F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))))
    return _once(rest, lambda d: F.when(F.size(d) < least, 0.0).otherwise(F.get(d, F.floor(F.size(d) / 2).cast("int"))))


def mean_l2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """AR9: mean distance of paired points."""
    d = F.zip_with(F.arrays_zip(ax.alias("x"), ay.alias("y")), F.arrays_zip(bx.alias("x"), by.alias("y")), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return _sum(d) / F.size(d)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """AR9: intersection over union of boxes (x0, y0, x1, y1), 0 if the union is at most 1e-9."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union <= 1e-9, 0.0).otherwise(w * h / union)


def pose_quality(distance: Column, scale: Column, visibility: Column, inside: Column) -> Column:
    """AR10: 1 / (1 + distance / scale), null out of the picture or under a visibility of 0.25."""
    return F.when(inside & (visibility >= 0.25), 1 / (1 + distance / F.nullif(scale, F.lit(0.0))))


def wrists_close(gap: Column, scale: Column) -> Column:
    """AR11: sides are ambiguous when the pose wrists are nearer than 1.1 x the scale."""
    return gap < 1.1 * scale


def assign_sides(ll: Column, lr: Column, rl: Column, rr: Column) -> Column:
    """AR12: swap two hands if the summed distances to the other sides' pose wrists are smaller; a single hand moves if its other
    side is under 0.8 x as far. Arguments: distance of left hand to left and right wrist, of right hand to left and right."""
    both = ll.isNotNull() & rr.isNotNull()
    return F.when(both, F.when(lr + rl < ll + rr, "swap").otherwise("keep")).when(ll.isNotNull(), F.when(lr < 0.8 * ll, "move").otherwise("keep")).when(rr.isNotNull(), F.when(rl < 0.8 * rr, "move").otherwise("keep"))


def far_from_pose(distance: Column, scale: Column, least_scale: float, inside: Column | None = None, factor: float = 1.5) -> Column:
    """AR12: whether a hand is rejected: its wrist is over `factor` x its scale (least_scale at least) from the pose wrist, or that is out of the picture."""
    far = F.coalesce(distance > factor * F.greatest(scale, F.lit(least_scale)), F.lit(False))
    return far if inside is None else far | ~F.coalesce(inside, F.lit(True))


def like_last_good(to_own: Column, to_other: Column, ratio: float) -> Column:
    """AR12: whether a hand is near enough to its own side's last good wrist, at most `ratio` x as far as the other side's; true where one is unknown."""
    return F.coalesce(to_own <= to_other * ratio, F.lit(True))


def wrist_depth(hand: Column, pose_world: Column, pose_image: Column, world: bool) -> Column:
    """AR14: the depth to go by: in world coordinates the hand's, then the world pose's; else the world pose's, the image pose's, the hand's."""
    return F.coalesce(hand, pose_world) if world else F.coalesce(pose_world, pose_image, hand)


def bone_error(points: Column, anchor: Column, links: Sequence[tuple[int, int]], scale: Column, anchor_scale: Column) -> Column:
    """AR15: the largest relative error of a bone's length over the hand's scale against the anchor's, of points with x and y; null without scales."""
    lengths = lambda p, m: [F.hypot(F.get(p, F.lit(i))["x"] - F.get(p, F.lit(j))["x"], F.get(p, F.lit(i))["y"] - F.get(p, F.lit(j))["y"]) / m for i, j in links]
    errors = [F.abs(a - b) / F.greatest(b, F.lit(1e-6)) for a, b in zip(lengths(points, scale), lengths(anchor, anchor_scale), strict=True)]
    return F.when((scale > 0) & (anchor_scale > 0), F.coalesce(F.array_max(F.array(*errors)), F.lit(0.0)))


def points_scale(points: Column, least: int = 2) -> Column:
    """AR8 of points with x and y."""
    return _once(F.get(points, F.lit(0)), lambda p: _scale(F.transform(points, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])), least))


def sanity_check(points: Column, anchor: Column, before: Column, links: Sequence[tuple[int, int]], k: float = 2.0, least: int = 2) -> Column:
    """AR15: (reasons, scale_ratio, wrist_jump, bone_error) of a hand's points against its anchor and its points before.

    The wrist's jump is held against k x the anchor's scale, or the hand's own without an anchor.
    """
    first = lambda p, c: F.get(p, F.lit(0))[c]
    jump = F.hypot(first(points, "x") - first(before, "x"), first(points, "y") - first(before, "y"))

    def measured(own: Column, of_anchor: Column) -> Column:
        scale = F.when(of_anchor != 0, of_anchor)
        return F.struct((own / scale).alias("ratio"), jump.alias("jump"), bone_error(points, anchor, links, own, scale).alias("bone"), F.coalesce(scale, own).alias("base"))

    def judged(m: Column) -> Column:
        found = F.array(F.when((m["ratio"] < 0.70) | (m["ratio"] > 1.35), "scale"), F.when((m["base"] > 0) & (m["jump"] > k * m["base"]), "jump"), F.when(m["bone"] > 0.30, "bone"))
        return F.struct(F.filter(found, lambda x: x.isNotNull()).alias("reasons"), m["ratio"].alias("scale_ratio"), m["jump"].alias("wrist_jump"), m["bone"].alias("bone_error"))

    scales = F.struct(points_scale(points, least).alias("own"), points_scale(anchor, least).alias("anchor"))
    return _once(_once(scales, lambda s: measured(s["own"], s["anchor"])), judged)


def dedup_hands(distance: Column, wrist: Column, overlap: Column, scale: Column, left_score: Column, right_score: Column) -> Column:
    """AR13: of two hands that are the same the one to drop: that of the lower score, the right one of equal scores."""
    same = (distance < 0.25 * scale) | (wrist < 0.35 * scale) | (overlap > 0.8)
    return F.when(same, F.when(left_score < right_score, "left").otherwise("right"))


def occlusion(overlap: Column, depth: Column, other: Column, least_overlap: float, least_gap: float) -> Column:
    """AR14: boxes overlap and the own wrist lies behind the other."""
    return (overlap >= least_overlap) & (depth > other + least_gap)


def sanity_reasons(scale: Column, anchor_scale: Column, jump: Column, bone_error: Column, k: float = 2.5) -> Column:
    """AR15: reasons to reject: scale ratio outside 0.70 to 1.35, a wrist jump over k x scale, a bone-length error over 0.30."""
    ratio = scale / F.nullif(anchor_scale, F.lit(0.0))
    found = F.array(F.when((ratio < 0.70) | (ratio > 1.35), "scale"), F.when(jump > k * anchor_scale, "jump"), F.when(bone_error > 0.30, "bone"))
    return F.filter(found, lambda x: x.isNotNull())


def shift_to_reference(xs: Column, dx: Column, most: Column) -> Column:
    """AR16: coordinates moved by dx, at most `most`, and clamped to [0, 1]."""
    step = F.greatest(F.least(dx, most), -most)
    return F.transform(xs, lambda x: F.greatest(F.least(x + step, F.lit(1.0)), F.lit(0.0)))


def bones(joints: Column, parents: Column) -> Column:
    """AR19: each joint minus its parent, the root (parent -1) 0."""
    return F.transform(joints, lambda v, i: F.when(F.get(parents, i) >= 0, v - F.get(joints, F.get(parents, i))).otherwise(0.0))


def resample_index(length: Column, n: int) -> Column:
    """AR20: n indices evenly over [0, length - 1], halves to even, both ends pinned."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (length - 1) / max(1, n - 1)).cast("int"))


def slice_with_pad(values: Column, start: Column, n: int) -> Column:
    """AR21: n values from start, the last one repeated beyond the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.least(start + i, F.size(values) - 1)))


def entropy(probs: Column) -> Column:
    """AR22: -sum p ln p, p at least 1e-9."""
    return _sum(F.transform(probs, lambda p: -p * F.ln(F.greatest(p, F.lit(1e-9)))))


def top_k(probs: Column, k: int) -> Column:
    """AR22: the k largest probabilities as (p, id), ties to the smaller id."""
    pairs = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("n"), i.alias("id"))))
    return F.transform(F.slice(pairs, 1, k), lambda x: F.struct((-x["n"]).alias("p"), x["id"].alias("id")))


def margin(probs: Column) -> Column:
    """AR22: the largest probability less the second."""
    p = F.sort_array(probs, asc=False)
    return F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))


def true_probability(probs: Column, label: Column) -> Column:
    """AR22: the probability of the true class, null if there is no such class."""
    return F.get(probs, label.cast("int"))


def sum_of_squares(probs: Column) -> Column:
    """AR22: sum p^2."""
    return _sum(F.transform(probs, lambda p: p * p))


def l2_normalize(v: Column) -> Column:
    """AR23: the unit vector, a zero vector staying zero; a null coordinate stays null, and doesn't count."""
    n = F.sqrt(_sum(F.transform(v, lambda x: F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0)))))
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: F.when(m > 0, x.cast("double") / m).otherwise(x.cast("double") * 0))), F.lit(0))


def cosine01(a: Column, b: Column) -> Column:
    """AR23: cosine of unit vectors, clipped to [-1, 1], mapped to [0, 1]."""
    return (F.greatest(F.least(_sum(F.zip_with(a, b, lambda x, y: x * y)), F.lit(1.0)), F.lit(-1.0)) + 1) / 2


def bio_string(tags: Column, most: int = 200) -> Column:
    """AR24: tags as text of O, B and I, cut with the length after it."""
    text = F.array_join(F.transform(tags, lambda t: F.substring(F.lit("OBI"), t + 1, F.lit(1))), "")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...("), F.length(text), F.lit(")"))).otherwise(text)
