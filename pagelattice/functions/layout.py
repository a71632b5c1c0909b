"""Column expressions on rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Sides rounded to even; the area is the rounded product of the raw sides."""
    return F.struct(*[F.bround(v).cast("int").alias(n) for n, v in (("x", x), ("y", y), ("width", width), ("height", height), ("area", width * height))])


def spatial_visibility(x: Column, y: Column, width: Column, height: Column) -> Column:
    part = lambda at, size: F.when(at + size > 2, "OUTSIDE_PAGE_PARTIALLY").otherwise("OUTSIDE_PAGE")
    where = (
        F.when((x >= 0) & (y >= 0), "IN_PAGE").when((x < 0) & (x + width <= 0), "OUTSIDE_PAGE").when((y < 0) & (y + height <= 0), "OUTSIDE_PAGE")
        .when(x < 0, part(x, width)).otherwise(part(y, height))
    )
    return F.concat(where, F.when((width == 0) | (height == 0), "__ZERO_AREA").otherwise(""))


def search_bounds(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    return {"x1": F.greatest(F.lit(0), x - 30), "y1": F.greatest(F.lit(0), y - 160), "x2": x + width + 50, "y2": y + height + 160}


def pair_bounds(a: str, b: str) -> dict[str, Column]:
    """The box around two boxes whose columns have the prefixes a and b."""
    return {k: (F.least if k.endswith("1") else F.greatest)(F.col(f"{a}{k}"), F.col(f"{b}{k}")) for k in ("x1", "y1", "x2", "y2")}


def scaled(value: Column, scale: float) -> Column:
    return F.bround(value * F.lit(float(scale))).cast("int")


def all_visible(row: str = "") -> Column:
    c = lambda n: F.col(f"{row}{n}")
    return (c("css_display") != "none") & (c("css_visibility") == "visible") & ~c("jquery_is_hidden") & c("driver_is_displayed") & (c("spatial_visibility") == "IN_PAGE")
