"""Similarity of cropped screenshots: colour votes as expressions, pixel work in vectorised functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as kind_of
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from pagelattice.session import small_batches, spread

# The divisor of bin differences here, and the thresholds in the functions below.
PIXELS = 5000


def hist_difference(a: Column, b: Column) -> Column:
    """Summed bin differences by PIXELS, with a penalty for colours only one side has; at most 1."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda t, v: t + v) / PIXELS

    def lone(x: Column, y: Column) -> Column:
        return F.when((x > 100) & (y < 4), F.when(x > 300, 0.15).otherwise(0.08))

    extra = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(lone(x, y), lone(y, x), F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
    return F.least(F.lit(1.0), gap + extra)


def dimensions_factor(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    near = (F.abs(h1 - h2) < 3) & (F.abs(w1 - w2) < 3)
    return F.when(near & (h1 == h2) & (w1 == w2), 0.9).when(near & (h1 == h2), 0.93).when(near, 0.97)


def compare_summaries(a: Column, b: Column, row: int = 50) -> Column:
    """Share of unequal palette indices: half as they lie, a quarter for a shift of one row either way."""

    def unequal(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        return F.size(F.filter(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p != q), lambda v: v)) / n.cast("double")

    def cut(x: Column) -> Column:
        return F.slice(x, F.lit(row + 1), F.size(x) - row)

    return F.lit(0.5) * unequal(a, b) + F.lit(0.25) * unequal(cut(a), b) + F.lit(0.25) * unequal(a, cut(b))


def summaries(a: pd.Series, b: pd.Series) -> pd.Series:
    """compare_summaries of images of 50 pixels a row for whole batches; images of one size are stacked."""
    out = np.full(len(a), np.nan)
    sizes: dict[int, list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None and len(x) == len(y) > 50:
            sizes.setdefault(len(x), []).append(k)
    for n, rows in sizes.items():
        step = max(1, 2_000_000 // n)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            x, y = np.stack(a.iloc[some].to_list()), np.stack(b.iloc[some].to_list())
            out[some] = 0.5 * (x != y).mean(1) + 0.25 * (x[:, 50:] != y[:, :-50]).mean(1) + 0.25 * (x[:, :-50] != y[:, 50:]).mean(1)
    return pd.Series(out).where(~np.isnan(out), None)


summary_difference = F.pandas_udf(summaries, DoubleType())


def visual_vote(summary: Column, histogram: Column, structure: Column, dummy: Column, photo: Column, dw: Column, dh: Column) -> Column:
    """0 same, 1 different, 0.5 unsure, by votes of the three measures."""
    votes = (
        F.when(summary < 0.42, 1.0).otherwise(0.0) + F.coalesce(F.when(histogram < 0.17, 1.0).when(histogram > 0.9, -0.5), F.lit(0.0))
        + F.coalesce(F.when(structure < 0.6, 1.0).when(structure > 0.85, -1.0).when(structure > 0.75, -0.6), F.lit(0.0))
    )
    answer = (F.lit(3.0) - votes) / 4.5
    return F.when(dummy, 0.5).when(photo & (dw < 5) & (dh < 3), 0.0).when(answer < 0.24, 0.0).when(answer > 0.76, 1.0).otherwise(0.5)


def cosine_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


@F.pandas_udf(StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """Hex of the low 8 x 8 frequencies of a 32 x 32 grey image against their median without the first."""
    basis = cosine_matrix(32)[:8]
    out = np.full(len(pixels), None, object)
    at = np.flatnonzero([values is not None and len(values) == 1024 for values in pixels])
    if len(at):
        images = np.stack(pixels.iloc[at].to_list()).astype(float).reshape(-1, 32, 32)
        low = (basis @ images @ basis.T).reshape(len(at), 64)
        bits = low >= np.median(low[:, 1:], axis=1)[:, None]
        out[at] = [f"{int.from_bytes(row.tobytes()):016x}" for row in np.packbits(bits, axis=1)]
    return pd.Series(out)


def ssim(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean SSIM with a uniform 7 x 7 window of each pair of stacked grey images."""

    def box(v: np.ndarray) -> np.ndarray:
        total = np.pad(v, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
        return (total[:, 7:, 7:] - total[:, :-7, 7:] - total[:, 7:, :-7] + total[:, :-7, :-7]) / 49

    mx, my = box(x), box(y)
    k = 49 / 48
    vx, vy, cov = k * (box(x * x) - mx * mx), k * (box(y * y) - my * my), k * (box(x * y) - mx * my)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean((1, 2))


def structures(a: pd.Series, wide1: pd.Series, b: pd.Series, wide2: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """SSIM of the top left width x height pixels of two flat grey images of given widths; null where there's none.

    Pairs of one size are stacked, so that a batch takes a few array operations.
    """
    out = np.full(len(a), np.nan)
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y, w, h) in enumerate(zip(a, b, width, height)):
        if x is not None and y is not None and w >= 7 and h >= 7:
            sizes.setdefault((int(w), int(h)), []).append(k)
    for (w, h), rows in sizes.items():
        step = max(1, 500_000 // (w * h))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            x, y = (np.stack([np.asarray(g[k], float).reshape(-1, int(wide[k]))[:h, :w] for k in some]) for g, wide in ((a, wide1), (b, wide2)))
            out[some] = ssim(x, y)
    return pd.Series(out).where(~np.isnan(out), None)


structural_similarity = F.pandas_udf(structures, DoubleType())


def compare_colours(histogram: Column, summary: Column, factor: Column, area1: Column, area2: Column) -> Column:
    """Mean of both colour measures, drawn in for equal dimensions and pushed out for unequal areas; at most 1."""
    small, large = F.least(area1, area2), F.greatest(area1, area2)
    uneven = F.when((small > 0) & (large > small * 2.4), 1.15).otherwise(1.0)
    return F.least(F.lit(1.0), (histogram + summary) / 2 * F.coalesce(factor, F.lit(1.0)) * uneven)


def sizes_comparable(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Whether two crops are near enough in size for SSIM, whose window needs 7 pixels a side."""
    dw, dh = F.abs(w1 - w2), F.abs(h1 - h2)
    near = ((dw < 5) & (dh < 11)) | ((dh < 5) & (dw < 11)) | ((dw == 0) & (dh < 17)) | ((dh == 0) & (dw < 17))
    return near & (F.least(w1, h1, w2, h2) >= 7)


def compare_structure(a: str, b: str) -> Column:
    """1 - SSIM of the part both grey crops have; null where the sizes differ too much."""
    (w1, h1, g1), (w2, h2, g2) = ([F.col(f"{side}{n}") for n in ("width", "height", "grey")] for side in (a, b))
    ok = sizes_comparable(w1, h1, w2, h2)
    return F.lit(1.0) - structural_similarity(F.when(ok, g1), w1, F.when(ok, g2), w2, F.least(w1, w2), F.least(h1, h2))


def visual_cascade(colours: Column, structure: Column) -> Column:
    """The older verdict of both measures: 0, 0.25, 0.5 or 1."""
    agreed = (F.abs(structure - colours) < 0.12) & ((structure + colours) / 2 < 0.5)
    by_structure = (
        F.when((structure < 0.27) | agreed, 0.0).when((structure < 0.35) & (colours > 0.5), 0.5)
        .when((structure < 0.3) & (colours < 0.5), 0.0).when(structure > 0.7, 1.0).otherwise(0.5)
    )
    by_colour = F.when(colours < 0.4, 0.25).when(colours < 0.6, 0.5).otherwise(1.0)
    return F.when(colours < 0.25, 0.0).when(structure.isNotNull(), by_structure).otherwise(by_colour)


def mean_squared_error(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))
    return F.aggregate(squares, F.lit(0.0), lambda t, v: t + v) / F.size(a)


CROP = "dummy boolean, is_photo boolean, pixels array<int>, histogram array<int>, grey array<int>"


def crop_elements(elements: DataFrame, screens: DataFrame, side: int = 50, colours: int = 16) -> DataFrame:
    """Elements with their crop of the page's screenshot.

    `screens` holds page_id, width, image (RGB bytes), palette (RGB bytes of the
    colours) and indices (one byte a pixel).  Added: dummy (outside or without
    area), is_photo (large, names an image, and quantising changed most pixels),
    pixels (side x side palette indices, nearest), histogram of those, and grey.
    A page's screenshot comes before its elements in one task and is held until
    the next page's, so it is neither broadcast nor repeated for each element.
    """
    small_batches(elements.sparkSession)
    names = elements.columns
    told = ("x", "y", "width", "height", "outer_html")
    none = lambda df, own: [F.lit(None).cast(df.schema[c].dataType).alias(own[c]) for c in own]
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    shots = screens.select(F.col("page_id").alias("page"), F.lit(False).alias("is_element"), F.lit(None).cast(elements.select(whole).schema[0].dataType).alias("element"), *[F.col(c) for c in SHOT])
    owned = elements.select(F.col("page_id").alias("page"), F.lit(True).alias("is_element"), whole.alias("element"), *none(screens, dict(zip(SHOT, SHOT))))
    met = spread(shots.union(owned).filter("page is not null"), "page").sortWithinPartitions("page", "is_element")

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []
        for batch in batches:
            pages, kinds, element = batch.column("page").to_pylist(), batch.column("is_element").to_pylist(), batch.column("element")
            fields = dict(zip(names, element.flatten()))
            boxes = list(zip(*[fields[c].to_pylist() for c in told])) if len(element) else []
            taken, out = [], []
            for k, own in enumerate(pages):
                if own != page:
                    page, held = own, []
                if not kinds[k]:
                    held.append(tuple(batch.column(c)[k].as_py() for c in SHOT))
                    continue
                for shot in held:
                    taken.append(k)
                    out.append(_crop(*boxes[k], *shot, side, colours))
            if taken:
                made = [pa.array([c[n] for c in out], pa.bool_()) for n in (0, 1)] + [_lists([c[n] for c in out]) for n in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([fields[c].take(pa.array(taken)) for c in names] + made, names=[*names, "dummy", "is_photo", "pixels", "histogram", "grey"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema)
    return met.mapInArrow(crop, f"{kinds}, {CROP}")


#: The columns of a screenshot.
SHOT = ("width", "image", "palette", "indices")


def _crop(x: int, y: int, w: int, h: int, html: str | None, wide: int, image: bytes, palette: bytes, indices: bytes, side: int, colours: int) -> tuple:
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        return True, None, None, None, None
    index = np.frombuffer(indices, np.uint8).reshape(-1, wide)[y : y + h, x : x + w]
    full = np.frombuffer(image, np.uint8).reshape(-1, wide, 3)[y : y + h, x : x + w].astype(int)
    if not index.size:
        return True, None, None, None, None
    drawn = np.frombuffer(palette, np.uint8).reshape(-1, 3).astype(int)[index]
    kept = float((np.abs(full - drawn).mean(2) < 7).mean())
    lower = (html or "").lower()
    photo = w * h > 5000 and any(s in lower for s in ("<img", ".jpg", ".png")) and 0.05 < kept < 0.31
    at = lambda n: ((np.arange(side) + 0.5) * n / side).astype(int)
    small = index[at(index.shape[0])][:, at(index.shape[1])].ravel()
    grey = np.rint(full @ np.array([0.299, 0.587, 0.114])).astype(int)
    return False, photo, small, np.bincount(small, minlength=colours)[:colours], grey.ravel()


def _lists(values: list[np.ndarray | None]) -> pa.ListArray:
    """Arrays as lists of 32-bit integers; None is null."""
    ends = np.cumsum([0, *[0 if v is None else len(v) for v in values]])
    gone = np.array([v is None for v in values] + [False])
    some = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=gone), pa.array(np.concatenate(some).astype(np.int32) if some else [], pa.int32()))


PAIR = "dummy boolean, photo boolean, summary double, histogram double, structure double, dw double, dh double"
#: Crops of a page that one task holds; of larger pages, every block of that size meets every other.
BLOCK = 200


def visual_pairs(crops: DataFrame, key: str = "page_id", order: str = "idx") -> DataFrame:
    """Every pair of a page's crops: summary, histogram and structure, and visually_similar by their votes.

    The crops of a page meet in one task, which makes the pairs, so that the
    pixels of a crop travel once and not once a pair; a page of more than BLOCK
    goes in pairs of blocks.
    """
    small_batches(crops.sparkSession)
    kinds = {n: crops.schema[n].dataType.simpleString() for n in (key, order)}
    rows = crops.select(F.col(key).alias("page"), F.col(order).alias("place"), *[F.col(n) for n in ("width", "height", "dummy", "is_photo", "pixels", "histogram", "grey")]).filter("page is not null and place is not null")
    own = Window.partitionBy("page")
    blocks = F.ceil(F.count("*").over(own) / BLOCK).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread(placed.drop("blocks").withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other"), "page", "p", "q").sortWithinPartitions("page", "p", "q", "place")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            at = list(zip(*[batch.column(n).to_pylist() for n in ("page", "p", "q")]))
            for k, own in enumerate(at):
                if own != group:
                    yield from _measured(group, held, types)
                    group, held = own, []
                held.append({n: batch.column(n)[k].as_py() for n in ("own", "place", "width", "height", "dummy", "is_photo")} | {n: _numbers(batch.column(n), k) for n in ("pixels", "histogram", "grey")})
        yield from _measured(group, held, types)

    types = [kind_of(crops.schema[n].dataType) for n in (key, order)]
    found = met.mapInArrow(pair, f"page {kinds[key]}, i {kinds[order]}, j {kinds[order]}, {PAIR}")
    vote = visual_vote(*[F.col(n) for n in ("summary", "histogram", "structure", "dummy", "photo", "dw", "dh")])
    return found.select(F.col("page").alias(key), "i", "j", "summary", "histogram", "structure", vote.alias("visually_similar"))


def _numbers(column: pa.ListArray, k: int) -> np.ndarray | None:
    value = column[k]
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else None


def _measured(group: tuple | None, rows: list[dict], types: list[pa.DataType], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The pairs of one page's block, or of two of its blocks, in parts."""
    if group is None:
        return
    page, p, q = group
    pairs = [(a, b) for a, one in enumerate(rows) for b, other in enumerate(rows[a + 1 :], a + 1) if one["place"] < other["place"] and (p == q or one["own"] != other["own"])]
    for at in range(0, len(pairs), most):
        some = pairs[at : at + most]
        one, other = ([rows[e[side]] for e in some] for side in (0, 1))
        column = lambda n: (pd.Series([r[n] for r in one]), pd.Series([r[n] for r in other]))
        (w1, w2), (h1, h2), (d1, d2), (p1, p2) = map(column, ("width", "height", "dummy", "is_photo"))
        dw, dh = (w1 - w2).abs(), (h1 - h2).abs()
        near = ((dw < 5) & (dh < 11)) | ((dh < 5) & (dw < 11)) | ((dw == 0) & (dh < 17)) | ((dh == 0) & (dw < 17))
        near &= np.minimum(np.minimum(w1, h1), np.minimum(w2, h2)) >= 7
        grey = [s.where(near, None) for s in column("grey")]
        structure = 1 - structures(grey[0], w1, grey[1], w2, np.minimum(w1, w2), np.minimum(h1, h2))
        numbers = lambda v: pa.array(np.asarray(v, float), pa.float64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([
            pa.array([page] * len(some), types[0]), pa.array([r["place"] for r in one], types[1]), pa.array([r["place"] for r in other], types[1]), pa.array(d1 | d2, pa.bool_()), pa.array(p1.eq(True) & p2.eq(True), pa.bool_()),
            numbers(summaries(*column("pixels"))), numbers(_hist_differences(*column("histogram"))), numbers(structure), numbers(dw), numbers(dh),
        ], names=["page", "i", "j", "dummy", "photo", "summary", "histogram", "structure", "dw", "dh"])


def _hist_differences(a: pd.Series, b: pd.Series) -> np.ndarray:
    """hist_difference of whole batches, its sums in the same order; 1 where a histogram is missing, as there."""
    out = np.ones(len(a))
    some = np.flatnonzero([x is not None and y is not None for x, y in zip(a, b)])
    if len(some):
        x, y = np.stack(a.iloc[some].to_list()), np.stack(b.iloc[some].to_list())
        lone = lambda u, v: np.where((u > 100) & (v < 4), np.where(u > 300, 0.15, 0.08), 0.0)
        parts = np.where((x > 100) & (y < 4), lone(x, y), lone(y, x))
        extra = np.zeros(len(some))
        for k in range(parts.shape[1]):
            extra = extra + parts[:, k]
        out[some] = np.minimum(1.0, np.abs(x - y).sum(1) / PIXELS + extra)
    return out


def misses_factor(a: Column, b: Column, bins: int = 10) -> Column:
    """The older factor of two histograms by how many of their first bins disagree; null in between."""

    def miss(x: Column, y: Column) -> Column:
        low, high = F.least(x, y).cast("double"), F.greatest(x, y).cast("double")
        return F.when(high / F.when(low == 0, 0.1).otherwise(low) > 3.6, 0.6).when(high - low > 850, 1.0).when((high > 180) & (low < 22), 1.0).otherwise(0.0)

    n = F.round(F.aggregate(F.zip_with(F.slice(a, 1, bins), F.slice(b, 1, bins), miss), F.lit(0.0), lambda t, v: t + v), 6)
    return F.when(n > 3.85, 1.5).when(n > 2.2, 1.25).when(n < 0.6, 0.48).when(n < 1.3, 0.6)


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def pixel_index(indices: Column, width: Column, x: Column, y: Column) -> Column:
    """The palette index of a pixel of a screenshot with one byte a pixel."""
    return _byte(indices, y * width + x)


def palette_colour(palette: Column, index: Column) -> Column:
    """Red, green and blue of a palette's colour."""
    return F.array(*[_byte(palette, index * 3 + k) for k in range(3)])


def same_images(images: DataFrame, key: str = "phash") -> DataFrame:
    """Groups of more than one image with the same hash, and their origins."""
    return images.groupBy(key).agg(F.array_sort(F.collect_list("origin")).alias("origins")).filter(F.size("origins") > 1)
