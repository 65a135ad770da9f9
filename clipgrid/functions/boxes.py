"""Box arithmetic on ``struct<xmin,ymin,xmax,ymax>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def _int(value: Column) -> Column:
    """Truncate towards zero; text that is no number becomes null."""
    return value.try_cast("double").try_cast("int")


def box_of(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box from four coordinates, truncated to int; null as a whole if any coordinate is missing."""
    parts = [_int(c) for c in (xmin, ymin, xmax, ymax)]
    present = parts[0].isNotNull()
    for part in parts[1:]:
        present = present & part.isNotNull()
    return F.when(present, F.struct(*[p.alias(n) for p, n in zip(parts, SIDES)]))


def box_of_array(coords: Column) -> Column:
    """A box from an ``(x1, y1, x2, y2)`` array; a wrong length is an error, a null array a null box."""
    checked = F.when(
        coords.isNotNull() & (F.size(coords) != 4), F.raise_error(F.lit("expected four box coordinates"))
    ).otherwise(coords)
    return box_of(*[F.try_element_at(checked, F.lit(i)) for i in range(1, 5)])


def missing_sides(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Names of the coordinates that are absent, comma separated; empty text when complete."""
    return F.concat_ws(
        ", ", *[F.when(c.isNull(), F.lit(n)) for c, n in zip((xmin, ymin, xmax, ymax), SIDES)]
    )


def box_error(box: Column) -> Column:
    """Null for a null or valid box, else the reason it is invalid."""
    inverted = (box["xmax"] < box["xmin"]) | (box["ymax"] < box["ymin"])
    return F.when(box.isNotNull() & inverted, F.lit("inverted box"))


def checked_box(box: Column) -> Column:
    """The box itself; an inverted one fails the job."""
    return F.when(box_error(box).isNotNull(), F.raise_error(box_error(box))).otherwise(box)


def box_width(box: Column) -> Column:
    return box["xmax"] - box["xmin"]


def box_height(box: Column) -> Column:
    return box["ymax"] - box["ymin"]


def box_area(box: Column) -> Column:
    return box_width(box).cast("long") * box_height(box)


def box_normalised(box: Column, width: Column, height: Column) -> Column:
    """Centre and size as fractions of the image."""
    return F.struct(
        ((box["xmin"] + box["xmax"]) / 2.0 / width).alias("cx"),
        ((box["ymin"] + box["ymax"]) / 2.0 / height).alias("cy"),
        (box_width(box) / width).alias("w"),
        (box_height(box) / height).alias("h"),
    )


def _struct_int(*values: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, SIDES)])


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """Cut the box to the image. A box fully outside becomes degenerate or inverted and covers no pixel."""
    zero = F.lit(0)
    return F.when(
        box.isNotNull(),
        _struct_int(
            F.greatest(zero, box["xmin"]),
            F.greatest(zero, box["ymin"]),
            F.least(width, box["xmax"]),
            F.least(height, box["ymax"]),
        ),
    )


def clamp_box_to_pixel(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> Column:
    """Round half to even, cut to the image and keep at least one pixel in each direction."""
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    x0 = F.greatest(F.lit(0), F.least(w - 1, F.rint(xmin)))
    y0 = F.greatest(F.lit(0), F.least(h - 1, F.rint(ymin)))
    x1 = F.greatest(x0 + 1, F.least(w, F.rint(xmax)))
    y1 = F.greatest(y0 + 1, F.least(h, F.rint(ymax)))
    return _struct_int(x0, y0, x1, y1)


def clamp_box_for_iou(box: Column, width: Column, height: Column) -> Column:
    """The clamp used for overlap: the near corner stays inside the image, the far one may touch its edge."""
    zero = F.lit(0)
    return _struct_int(
        F.greatest(zero, F.least(box["xmin"], width - 1)),
        F.greatest(zero, F.least(box["ymin"], height - 1)),
        F.greatest(zero, F.least(box["xmax"], width)),
        F.greatest(zero, F.least(box["ymax"], height)),
    )


def decode_coordinates(box: Column, width: Column, height: Column, mode: str | Column = "auto") -> Column:
    """Coordinates as a reply states them, in pixels.

    ``pixel`` keeps them, ``normalized`` reads them on a 0-1000 scale, ``auto`` takes the scale when no
    coordinate exceeds 1000.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    largest = F.greatest(*[box[n] for n in SIDES])

    def scaled(value: Column, extent: Column) -> Column:
        return (value / F.lit(1000.0) * extent).cast("int")

    scaled_box = _struct_int(
        scaled(box["xmin"], width),
        scaled(box["ymin"], height),
        scaled(box["xmax"], width),
        scaled(box["ymax"], height),
    )
    by_scale = (mode == "normalized") | ((mode == "auto") & (largest <= 1000))
    known = mode.isin("pixel", "normalized", "auto")
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown coordinate mode "), mode))).when(
        box.isNotNull(), F.when(by_scale, scaled_box).otherwise(box)
    )
