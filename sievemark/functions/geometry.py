"""Boxes and ratios as column expressions. Boxes are four columns; xywh begins top left, xyxy has two corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
#: Areas below these are small and medium.
SMALL_AREA, MEDIUM_AREA = 32.0**2, 96.0**2


def box(*columns: Column | str) -> Box:
    return tuple(F.col(c) if isinstance(c, str) else c for c in columns)  # type: ignore[return-value]


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson_lower(successes: Column, total: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson interval of successes / total; 0 without a trial."""
    n, p = total.cast("double"), successes.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)


def _overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))


def iou_xywh(a: Box, b: Box) -> Column:
    """Intersection over union; sizes are taken as they are, so a negative one counts as negative."""
    common = _overlap(a[0], a[0] + a[2], b[0], b[0] + b[2]) * _overlap(a[1], a[1] + a[3], b[1], b[1] + b[3])
    union = a[2] * a[3] + b[2] * b[3] - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(0.0)


def iou_xyxy(a: Box, b: Box) -> Column:
    """Intersection over union; a box whose corners are swapped has no area."""
    area = lambda q: F.greatest(q[2] - q[0], F.lit(0)) * F.greatest(q[3] - q[1], F.lit(0))
    common = _overlap(a[0], a[2], b[0], b[2]) * _overlap(a[1], a[3], b[1], b[3])
    union = area(a) + area(b) - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(0.0)


def xywh_to_xyxy(q: Box) -> Box:
    return q[0], q[1], q[0] + q[2], q[1] + q[3]


def xyxy_to_xywh(q: Box) -> Box:
    return q[0], q[1], q[2] - q[0], q[3] - q[1]


def centre_to_xyxy(q: Box) -> Box:
    """From centre and size."""
    return q[0] - q[2] / 2, q[1] - q[3] / 2, q[0] + q[2] / 2, q[1] + q[3] / 2


def to_unit_centre(q: Box, width: Column, height: Column) -> Box:
    """From xywh in pixels to centre and size as shares of the image."""
    return (q[0] + q[2] / 2) / width, (q[1] + q[3] / 2) / height, q[2] / width, q[3] / height


def yolo_line(class_id: Column, q: Box, width: Column, height: Column) -> Column:
    """`class cx cy w h` with eight decimals; null where a size isn't positive or a share is outside 0 to 1."""
    ok = (width > 0) & (height > 0) & (q[2] > 0) & (q[3] > 0)
    shares = to_unit_centre(q, F.when(ok, width), F.when(ok, height))
    for share in shares:
        ok = ok & share.between(0, 1)
    return F.when(ok, F.concat_ws(" ", class_id.cast("string"), *[F.format_string("%.8f", x.cast("double")) for x in shares]))


def valid_xywh(q: Box, width: Column, height: Column, slack: float = 1e-6) -> Column:
    """Whether a box is finite, has a size and lies in its image, up to the slack."""
    finite = F.lit(True)
    for x in q:
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite & (q[2] > 0) & (q[3] > 0) & (q[0] >= -slack) & (q[1] >= -slack) & (q[0] + q[2] <= width + slack) & (q[1] + q[3] <= height + slack), F.lit(False))


def clamped_xywh(q: Box) -> Box:
    """Slightly negative corners moved to the image's edge."""
    return F.greatest(F.lit(0.0), q[0]), F.greatest(F.lit(0.0), q[1]), q[2], q[3]


def quantized(x: Column, decimals: int = 3) -> Column:
    """A decimal rounded half to even, as text; there is no negative zero."""
    return F.bround(x.cast("decimal(28,12)"), decimals).cast(f"decimal(20,{decimals})").cast("string")


def canonical_from_yolo(q: Box, width: Column, height: Column, decimals: int = 3) -> Column:
    """Array of x, y, w, h in pixels as text, from centre and size as shares."""
    d = lambda c: c.cast("decimal(14,10)")
    cx, cy, w, h = (d(c) for c in q)
    pixels_w, pixels_h = width.cast("decimal(8,0)"), height.cast("decimal(8,0)")
    half = F.lit("0.5").cast("decimal(2,1)")
    return F.array(*[quantized(x, decimals) for x in ((cx - w * half) * pixels_w, (cy - h * half) * pixels_h, w * pixels_w, h * pixels_h)])


def canonical_from_coco(q: Box, decimals: int = 3) -> Column:
    return F.array(*[quantized(x, decimals) for x in q])


def size_class(area: Column) -> Column:
    return F.when(area < SMALL_AREA, "small").when(area < MEDIUM_AREA, "medium").otherwise("large")


def restored_xyxy(q: Box, scale: Column, left: Column, top: Column, width: Column, height: Column) -> Box:
    """Undo a letterbox: shift, scale, and clip to the image."""
    into = lambda x, pad, most: F.least(F.greatest((x - pad) / scale, F.lit(0.0)), most.cast("double"))
    return into(q[0], left, width), into(q[1], top, height), into(q[2], left, width), into(q[3], top, height)


def letterbox(width: Column, height: Column, size: int, centred: bool) -> dict[str, Column]:
    """scale, resized_width, resized_height, pad_left, pad_top of an image fitted into a square. Centred ones round the
    size half to even and put the padding's half before, others cut the size and pad after."""
    scale = F.least(size / height.cast("double"), size / width.cast("double"))
    fit = F.rint if centred else F.floor
    shape = [F.greatest(F.lit(1), F.least(F.lit(size), fit(x * scale).cast("int"))) for x in (width, height)]
    pad = [F.rint((size - x) / 2 - 0.1) if centred else F.lit(0.0) for x in shape]
    return dict(zip(("scale", "resized_width", "resized_height", "pad_left", "pad_top"), (scale, *shape, *pad), strict=True))


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Where tiles of a side begin: every stride, and one flush with the end."""
    stride = max(1, round(tile * (1 - overlap)))
    last = length - tile
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def tile_grid(width: Column, height: Column, tile: int, overlap: float) -> Column:
    """Array of left, top, right, bottom of an image's tiles, row by row."""
    xs, ys = tile_starts(width, tile, overlap), tile_starts(height, tile, overlap)
    cell = lambda x, y: F.struct(x.alias("left"), y.alias("top"), F.least(x + tile, width).alias("right"), F.least(y + tile, height).alias("bottom"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: cell(x, y))))
