"""Column expressions for points, boxes and grid cells. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackframe.schemas import FRAME_HEIGHT, FRAME_WIDTH


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def midpoint(a, b) -> Column:
    return (_c(a) + _c(b)) / F.lit(2.0)


def truncated(x) -> Column:
    """Drop the fraction, toward zero."""
    return _c(x).cast("int")


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def point_box(x, y, size: int = 20, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> Column:
    """Square box around a point, cut off at the frame border."""
    half = int(size / 2)
    px, py = truncated(x), truncated(y)
    return F.struct(
        F.greatest(F.lit(0), px - half).alias("x1"),
        F.greatest(F.lit(0), py - half).alias("y1"),
        F.least(F.lit(width), px + half).alias("x2"),
        F.least(F.lit(height), py + half).alias("y2"),
    )


def recentred_box(x1, y1, x2, y2, size: int = 20,
                  width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> Column:
    """Box of fixed size around the half-even rounded centre of another box."""
    cx = F.bround(midpoint(x1, x2)).cast("int")
    cy = F.bround(midpoint(y1, y2)).cast("int")
    half = size // 2
    return F.struct(
        clamp(cx - half, 0, width - 1).alias("x1"),
        clamp(cy - half, 0, height - 1).alias("y1"),
        clamp(cx + half, 0, width - 1).alias("x2"),
        clamp(cy + half, 0, height - 1).alias("y2"),
    )


def corner_size(x1, y1, x2, y2) -> Column:
    """Top-left corner with width and height."""
    return F.struct(
        _c(x1).alias("x"), _c(y1).alias("y"),
        (_c(x2) - _c(x1)).alias("w"), (_c(y2) - _c(y1)).alias("h"),
    )


def unit_centre_box(x1, y1, x2, y2, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> Column:
    """Centre, width and height as fractions of the frame."""
    return F.struct(
        (midpoint(x1, x2) / width).alias("xc"), (midpoint(y1, y2) / height).alias("yc"),
        ((_c(x2) - _c(x1)) / width).alias("w"), ((_c(y2) - _c(y1)) / height).alias("h"),
    )


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def heading_degrees(dx, dy) -> Column:
    return F.degrees(F.atan2(_c(dy), _c(dx)))


def angle_between(ux, uy, vx, vy) -> Column:
    """Degrees between two vectors, -1 when one of them has no length."""
    ux, uy, vx, vy = map(_c, (ux, uy, vx, vy))
    length = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = clamp((ux * vx + uy * vy) / F.when(length == 0, None).otherwise(length), -1.0, 1.0)
    return F.when(length == 0, F.lit(-1.0)).otherwise(F.degrees(F.acos(cosine)))


def wrapped_turn(turn) -> Column:
    """Absolute difference of two headings in degrees, folded into 0..180."""
    turn = F.abs(_c(turn)) % 360
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def cell_right_closed(x, size: float, limit: float) -> Column:
    """Index of the (low, high] cell holding x; null outside (0, limit]."""
    n = int(limit // size)
    index = (F.ceil(_c(x) / F.lit(float(size))) - 1).cast("int")
    return F.when((index >= 0) & (index < n), index)


def cell_left_closed(x, size: float, low: float, n_cells: int) -> Column:
    """Index of the [low, high) cell holding x, last cell closed; null outside."""
    high = low + size * n_cells
    index = F.floor((_c(x) - F.lit(float(low))) / F.lit(float(size))).cast("int")
    return (F.when(_c(x) == F.lit(float(high)), F.lit(n_cells - 1))
            .when((index >= 0) & (index < n_cells), index))


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over union of the boxes in struct columns a and b."""
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    shared = w * h

    def area(s):
        return (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))

    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(
        shared.cast("double") / (area(a) + area(b) - shared))


def patch_address(x, y, patch_width: int, patch_height: int, patches_across: int) -> Column:
    """Patch number in row order and the position inside that patch."""
    gx, gy = F.floor(_c(x) / patch_width), F.floor(_c(y) / patch_height)
    return F.struct(
        (gx + gy * patches_across).cast("int").alias("patch"),
        (_c(x) % patch_width).alias("local_x"), (_c(y) % patch_height).alias("local_y"),
    )
