"""Distances of two elements as Column expressions: 0 same, 1 different, 0.5 unsure.

Each function takes the prefixes of both sides' columns.  All stay on the JVM,
and a select of several reads the pairs once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.text import blended_distance, gestalt_percent, quick_distance, simple_distance

# Number of style keys, half-width of the neutral band, longest distance of two corners.
CSS_KEYS = 134
NEUTRAL = 0.04
MAX_SPREAD = 2817.8


def with_ids(elements: DataFrame, missing: bool = False) -> DataFrame:
    """Style arrays and feature sets as numbers, made once an element, so that pairs compare numbers and not strings.

    css_ids: a 64-bit hash of position and value of each style that isn't blank;
    css_blank: a bit for each position that is; css_missing, if asked for: a bit
    for each that is null; feature_ids: a hash of each distinct feature.
    """
    if "css_array" in elements.columns:
        styles = F.col("css_array")
        ids = F.filter(F.transform(styles, lambda v, k: F.when(v != "", F.xxhash64(k, v))), lambda v: v.isNotNull())
        bits = lambda at, told: F.aggregate(
            F.transform(F.slice(styles, at + 1, F.lit(64)), lambda v, k: F.when(told(v), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"), lambda t, v: t.bitwiseOR(v),
        )
        every = lambda told: F.array(*[bits(F.lit(at), told) for at in range(0, CSS_KEYS, 64)])
        elements = elements.withColumns({"css_ids": ids, "css_blank": every(lambda v: v == ""), **({"css_missing": every(lambda v: v.isNull())} if missing else {})})
    if "feature_set" in elements.columns:
        elements = elements.withColumn("feature_ids", F.array_distinct(F.transform("feature_set", lambda v: F.xxhash64(v))))
    return elements


def _both(a: str, b: str, *names: str) -> list[Column]:
    return [F.col(f"{side}{n}").cast("double") for n in names for side in (a, b)]


def areas_similar(a: str, b: str) -> Column:
    w1, w2, h1, h2, a1, a2 = _both(a, b, "width", "height", "area")
    dw, dh = F.abs(w1 - w2), F.abs(h1 - h2)
    near = (dw < 4) | (dh < 4)
    ratio = F.greatest(a1, a2) / F.when(F.least(a1, a2) == 0, None).otherwise(F.least(a1, a2))
    d = lambda v: F.lit(float(v))
    return (
        F.when((w1 == w2) & (h1 == h2), d(0)).when((h1 == h2) & (dw <= 6), d(0))
        .when((w1 == 0) | (w2 == 0), F.when(w1 == w2, d(0)).otherwise(d(1))).when((h1 == 0) | (h2 == 0), F.when(h1 == h2, d(0)).otherwise(d(1)))
        .when((a1 <= 1) & (a2 <= 1), d(0.22)).when(((a1 <= 1) & (a2 > 1)) | ((a2 < 1) & (a1 > 1)), d(1)).when((a1 < 50) & (a2 < 50), d(0.5))
        .when(ratio > 3, d(1)).when(near & (ratio < 1.5), d(0)).when(near & (ratio < 2), d(0.28)).when(ratio < 1.25, d(0.5)).otherwise(d(1))
    )


def area_alignment_simple(a: str, b: str) -> Column:
    x1, x2, y1, y2, w1, w2, h1, h2, a1, a2 = _both(a, b, "x", "y", "width", "height", "area")
    same = (F.abs(w1 - w2) <= 2.1) | (F.abs(h1 - h2) <= 2.1)
    aligned = (F.abs(y1 - y2) <= 2.1) | (F.abs(x1 - x2) <= 2.1)
    base = F.when(same & aligned, 0.0).when(same | aligned, 0.25).otherwise(0.75)
    high, low = F.greatest(a1, a2), F.least(a1, a2)
    uneven = ((high > 0.1) & (low / F.when(high == 0, None).otherwise(high) < 0.6)) | (F.abs(a1 - a2) > 1300)
    return F.least(F.lit(1.0), base * F.when(uneven, 1.3).otherwise(1.0))


def adjusted_euclidean_distance(a: str, b: str, page_height: float | Column = 2400) -> Column:
    x1, x2, y1, y2 = _both(a, b, "x", "y")
    height = page_height if isinstance(page_height, Column) else F.lit(float(page_height))
    dx, dy = F.abs(x1 - x2), F.abs(y1 - y2)
    sy = F.when(dy > 800, F.least(F.lit(2500.0), F.lit(800.0) + (dy - 800) / 2)).otherwise(dy)
    sx = F.least(F.lit(1300.0), dx)
    d = F.sqrt(sx * sx + sy * sy)
    share = F.least(F.lit(MAX_SPREAD), d) / MAX_SPREAD
    ends = ((y1 < 450) & (height - y2 < 450)) | ((y2 < 450) & (height - y1 < 450))
    return F.when(d < 170, 0.5).when((height > 1400) & ends, F.least(F.lit(1.0), share * 1.2)).when((dy < 1400) & ((dx < 5) | (dy < 5)), share * 0.7).otherwise(share)


def standard_euclidean_distance(a: str, b: str) -> Column:
    """Distance of both corners by the largest one; corrected, since it can't be 0 for all pairs."""
    x1, x2, y1, y2 = _both(a, b, "x", "y")
    return F.least(F.lit(1.0), F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / MAX_SPREAD)


def spatially_aligned(a: str, b: str) -> Column:
    x1, x2, y1, y2 = _both(a, b, "x", "y")
    dx, dy = F.abs(x1 - x2), F.abs(y1 - y2)
    zero = lambda x, y: (x < 0.01) & (y < 0.01)
    off = lambda x, y: (x > 0.1) | (y > 0.1)
    return (
        F.when((zero(x1, y1) & off(x2, y2)) | (zero(x2, y2) & off(x1, y1)), 0.5).when((dx < 8) & (dy < 8), 0.5)
        .when(dx < 4, F.when(dy < 800, 0.0).otherwise(0.5)).when(dy < 4, F.when(dx < 900, 0.0).otherwise(0.5)).otherwise(1.0)
    )


def compare_computed_styles(a: str, b: str) -> Column:
    """By equal positions of two style arrays, from `with_ids`; equal blanks count less."""
    return _by_equals(a, b, _shared_bits(a, b, "css_blank"))


def _shared_bits(a: str, b: str, name: str) -> Column:
    both = lambda k: F.bit_count(F.get(f"{a}{name}", F.lit(k)).bitwiseAND(F.get(f"{b}{name}", F.lit(k))))
    shared = both(0)
    for k in range(1, -(-CSS_KEYS // 64)):
        shared = shared + both(k)
    return shared


def _by_equals(a: str, b: str, blanks: Column) -> Column:
    equal = F.size(F.array_intersect(f"{a}css_ids", f"{b}css_ids"))
    v = F.greatest(F.lit(-16.0), F.least(F.lit(13.0), F.lit(1.5) * equal + blanks - CSS_KEYS))
    return F.lit(1.0) - (v + 16) / 29.0


def compare_style_maps(a: str, b: str) -> Column:
    """The same score over arrays with null for a key that an element lacks: what both lack says nothing."""
    weights = F.zip_with(F.col(f"{a}styles"), F.col(f"{b}styles"), lambda p, q: F.when(~p.eqNullSafe(q), -1.0).when(F.coalesce(p, F.lit("")) == "", 0.0).otherwise(0.5))
    v = F.greatest(F.lit(-16.0), F.least(F.lit(13.0), F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)))
    return F.lit(1.0) - (v + 16) / 29.0


def compare_style_map_ids(a: str, b: str) -> Column:
    """compare_style_maps of CSS_KEYS keys, from `with_ids` with what's missing."""
    return _by_equals(a, b, _shared_bits(a, b, "css_blank") + _shared_bits(a, b, "css_missing"))


def compare_weighted_styles(a: str, b: str) -> Column:
    """Mean over the keys that either has; rare values count for more.

    `styles` holds structs (v, w) in the order of the keys: a value and its
    weight, v null where it's missing.
    """

    def point(p: Column, q: Column) -> Column:
        one = F.coalesce(F.when(p["v"].isNotNull(), p["w"]), q["w"])
        alone = F.when(one < 0.1, 0.6).when(one < 0.3, 0.7).otherwise(0.8)
        both = F.when((p["w"] < 0.12) & (q["w"] < 0.12), 0.75).when((p["w"] < 0.12) & (q["w"] > 0.75), 1.0).otherwise(0.6)
        unequal = F.when(p["v"].isNotNull() & q["v"].isNotNull(), both).otherwise(alone)
        return F.when(p["v"].isNull() & q["v"].isNull(), None).when(p["v"].eqNullSafe(q["v"]), F.least(F.lit(0.44), p["w"] / 2)).otherwise(unequal)

    points = F.filter(F.zip_with(F.col(f"{a}styles"), F.col(f"{b}styles"), point), lambda v: v.isNotNull())
    # bound to a variable, as the expression would be evaluated for the sum and for the number
    mean = lambda p: F.try_divide(F.aggregate(p, F.lit(0.0), lambda t, v: t + v), F.size(p).cast("double"))
    return F.get(F.transform(F.array(points), mean), F.lit(0))


def compare_computed_styles_jaccard(a: str, b: str) -> Column:
    """Jaccard distance of the styles that aren't blank, from `with_ids`."""
    return _overlap(F.col(f"{a}css_ids"), F.col(f"{b}css_ids"))


def jaccard_distance(x: Column, y: Column) -> Column:
    shared = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))
    return F.coalesce(F.lit(1.0) - shared, F.lit(0.0))


def featureset_overlap(a: str, b: str) -> Column:
    """Jaccard distance of two sets of distinct features, from `with_ids`."""
    return _overlap(F.col(f"{a}feature_ids"), F.col(f"{b}feature_ids"))


def _overlap(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - shared
    return F.when(every > 0, F.lit(1.0) - shared / every.cast("double")).otherwise(F.lit(0.0))


def _mean(signals: Sequence[Column], told: Callable[[Column], Column]) -> Column:
    """Mean of the signals that tell something, 0.5 without any; plain sums, so that code is generated for them."""
    total, n = F.lit(0.0), F.lit(0)
    for v in signals:
        total = total + F.when(told(v), v).otherwise(F.lit(0.0))
        n = n + F.when(told(v), 1).otherwise(0)
    return F.when(n > 0, total / n).otherwise(F.lit(0.5))


def mean_of(*signals: Column) -> Column:
    """Mean of the signals that aren't null, 0.5 without any."""
    return _mean(signals, lambda v: v.isNotNull())


def compare_visibility(a: str, b: str) -> Column:
    c = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    (v1, v2), (h1, h2), (s1, s2), (d1, d2), (p1, p2), (o1, o2) = map(c, ("css_visibility", "jquery_is_hidden", "css_display", "driver_is_displayed", "spatial_visibility", "all_visible"))
    css = F.when(v1 != v2, 1.0).when(v1 != "visible", 0.0)
    hidden = F.when(h1 != h2, 1.0).when(h1, 0.0)
    display = F.when(s1 == s2, 0.0).otherwise(1.0)
    shown = F.when(d1 != d2, 1.0).when(~d1, 0.0)
    spatial = F.when(p1 == p2, F.when(p1 != "IN_PAGE", 0.0)).when((p1 == "IN_PAGE") | (p2 == "IN_PAGE"), 1.0)
    return F.when(o1 & o2, 0.5).otherwise(mean_of(css, hidden, display, shown, spatial))


def url_similarity(a: str, b: str, page_host: Column) -> Column:
    c = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    (u1, u2), (t1, t2), (h1, h2) = map(c, ("url", "url_type", "url_host"))
    kind = F.when(t1 == t2, F.when(t1 != "WEBPAGE", 0.0)).when((t1 == "WEBPAGE") | (t2 == "WEBPAGE"), 1.0)
    special = F.lit(None).cast("double")
    for flag in ("contains_event", "is_social", "is_gcal", "is_eventbrite", "is_google_map"):
        f1, f2 = c(flag)
        special = F.when(f1 & f2, 0.0).when(f1 | f2, 1.0).otherwise(special)
    host = F.when(h1 == h2, F.when(h1 == page_host, 0.3).otherwise(0.0)).when((h1 == page_host) | (h2 == page_host), 1.0).otherwise(0.5)
    empty = (u1 == "") | (u2 == "")
    return F.when(empty, F.when(u1 == u2, 0.0).otherwise(1.0)).when(u1 == u2, 0.0).when(kind == 1, 1.0).otherwise(mean_of(kind, special, host))


def compare_text(a: str, b: str) -> Column:
    c = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    (t1, t2), (m1, m2), (g1, g2), (d1, d2) = map(c, ("text", "text_is_more_link", "text_is_digit", "text_has_date"))
    return (
        F.when((t1 == "") & (t2 == ""), None).when(t1 == t2, 0.0).when((t1 == "") | (t2 == ""), 1.0)
        .when(m1 & m2, 0.0).when(m1 | m2, 1.0).when(g1 & g2, F.when(F.length(t1) == F.length(t2), 0.0).otherwise(0.15))
        .when((d1 != "") & (d2 != ""), F.when(d1 == d2, 0.0).otherwise(0.35)).when((d1 != "") | (d2 != ""), 1.0)
    )


def compare_start_tag(a: str, b: str) -> Column:
    s1, s2, p1, p2 = (F.col(x) for x in (f"{a}start_tag", f"{b}start_tag", f"{a}parent_start_tag", f"{b}parent_start_tag"))
    return F.when((s1 == s2) & (F.length(s1) > 24), 0.0).when(p1 == p2, F.when(s1 == s2, 0.0).otherwise(0.25))


def compare_img(a: str, b: str) -> Column:
    i1, i2, p1, p2 = (F.col(x) for x in (f"{a}img_type", f"{b}img_type", f"{a}parent_img_type", f"{b}parent_img_type"))
    differ = lambda x, y: F.when(x == y, 0.0).otherwise(1.0)
    return F.when((i1 != "") | (i2 != ""), differ(i1, i2)).when((p1 != "") | (p2 != ""), differ(p1, p2))


def compare_navigation(a: str, b: str) -> Column:
    n1, n2 = F.col(f"{a}in_nav"), F.col(f"{b}in_nav")
    return F.when(n1 & n2, 0.0).when(n1 | n2, 1.0).otherwise(0.5)


def with_letters(elements: DataFrame) -> DataFrame:
    """letters: a number for each character of the HTML without content and its how-manieth occurrence; n_letters: its length."""
    lower = F.lower("outer_html_no_content")
    times = lambda c: F.length(lower) - F.length(F.replace(lower, c, F.lit("")))
    kinds = F.filter(F.transform(F.filter(F.array_distinct(F.split(lower, "")), lambda c: c != ""), lambda c: F.struct(c.alias("c"), times(c).alias("n"))), lambda e: e["n"] > 0)
    return elements.withColumns({"letters": F.flatten(F.transform(kinds, lambda e: F.transform(F.sequence(F.lit(1), e["n"]), lambda k: F.xxhash64(e["c"], k)))), "n_letters": F.length(lower)})


def quick_by_letters(a: str, b: str) -> Column:
    """quick_distance of the HTML without content, from `with_letters`."""
    size = F.col(f"{a}n_letters") + F.col(f"{b}n_letters")
    return F.when(size == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.lit(2.0) * F.size(F.array_intersect(f"{a}letters", f"{b}letters")) / size)


def compare_outer(a: str, b: str, quick: bool = True, cheap: Column | None = None) -> Column:
    """By HTML alone: unlike tags, the cheap bound, the parents' gestalt, then the elements' own; null if none decides.

    The cheap bound is read at many places: give a column of the pairs that holds it, from `quick_by_letters`.
    """
    c = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    (t1, t2), (pt1, pt2), (h1, h2), (p1, p2), (n1, n2) = map(c, ("tag_name", "parent_tag_name", "outer_html_no_content", "parent_outer_html_no_content", "num_tags"))
    long, short = F.greatest(F.length(p1), F.length(p2)), F.least(F.length(p1), F.length(p2))
    parents = short > 1
    unlike = parents & (long > 450) & (long > 3 * short)
    cheap = quick_distance(F.lower(h1), F.lower(h2)) if cheap is None else cheap
    open_ = ~((t1 != t2) & (pt1 != pt2)) & ((cheap <= 0.57) | F.lit(not quick))
    near = lambda x: F.substring(F.lower(x), 1, 300 if quick else 430)
    parent = F.lit(1.0) - gestalt_percent(F.when(open_ & parents & ~unlike, near(p1)), F.when(open_ & parents & ~unlike, near(p2))) / 100
    large = ((n1 > 2) & (n2 > 2)) | ((F.length(h1) > 160) & (F.length(h2) > 160))
    chosen = lambda x: F.when(open_ & large, F.lower(x))
    gestalt = lambda x, y: F.lit(1.0) - gestalt_percent(x, y) / 100
    own = blended_distance(gestalt(chosen(h1), chosen(h2)), F.lit(0.0) if quick else gestalt(F.reverse(chosen(h1)), F.reverse(chosen(h2))), simple_distance(h1, h2), quick)
    return (
        F.when((t1 != t2) & (pt1 != pt2), 1.0).when((cheap > 0.57) & F.lit(quick), cheap).when(unlike, 1.0)
        .when(parents & (parent < 0.11), 0.0).when(large & (own < 0.1), 0.0).when(large & (own > 0.85), 1.0)
    )


def compare_content(a: str, b: str, quick: bool = True, cheap: Column | None = None) -> Column:
    """Mean of what text, start tags, images and HTML say; 0.5 if they say nothing."""
    return mean_of(compare_text(a, b), compare_start_tag(a, b), compare_img(a, b), compare_outer(a, b, quick, cheap))


def where_displayed(a: str, b: str, distance: Column) -> Column:
    """0.5 as soon as either element isn't displayed."""
    return F.when(~F.col(f"{a}driver_is_displayed") | ~F.col(f"{b}driver_is_displayed"), 0.5).otherwise(distance)


def detail_similarity(a: str, b: str) -> Column:
    """Distance of two text elements of sibling pages; it may exceed 1."""
    c = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    (t1, t2), (n1, n2), (p1, p2), (x1, x2), (y1, y2), (h1, h2), (s1, s2) = map(c, ("tag", "outer_no_content", "parent_no_content", "x", "y", "height", "start_tag"))
    s = simple_distance(n1, n2)
    s = F.when(p1.isNotNull() & p2.isNotNull(), s * 0.65 + simple_distance(p1, p2) * 0.35).otherwise(s)
    s = s * F.when(F.abs(x1 - x2) < 10, F.when(F.abs(y1 - y2) < 40, 0.85).otherwise(0.95)).otherwise(1.0)
    s = s * F.when(F.abs(h1 - h2) < 3, 0.9).otherwise(1.0) * F.when(s1 == s2, 0.9).otherwise(1.1)
    return F.when(t1 != t2, 1.0).otherwise(s)


def combined(*distances: Column) -> Column:
    """Mean of the distances that aren't neutral; 0.5 without any.  Give columns, not expressions: each is read several times."""
    return _mean(distances, lambda v: F.coalesce(F.abs(v - 0.5) > NEUTRAL, F.lit(False)))


#: Users may add functions of the same form: (prefix a, prefix b) -> Column.
REGISTRY: dict[str, Callable[[str, str], Column]] = {
    "areas_similar": areas_similar,
    "area_alignment_simple": area_alignment_simple,
    "adjusted_euclidean_distance": adjusted_euclidean_distance,
    "spatially_aligned": spatially_aligned,
    "compare_computed_styles": compare_computed_styles,
    "compare_visibility": compare_visibility,
    "featureset_overlap": featureset_overlap,
}


def all_functions(visually_similar: Callable[[str, str], Column], cheap: Column | None = None) -> dict[str, Callable[[str, str], Column]]:
    """The ten functions; how crops compare is given, as screenshots are inputs.  page_host: the page's own host; cheap: as in `compare_outer`."""
    return {
        **REGISTRY,
        "url_similarity": lambda a, b: url_similarity(a, b, F.col(f"{a}page_host")),
        "compare_content": lambda a, b: compare_content(a, b, cheap=cheap),
        "visually_similar": visually_similar,
    }
