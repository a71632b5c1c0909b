"""Truth tables at the borders of the distances."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import distances as D
from pagelattice.functions import html, layout, text, urls
from pagelattice.operators import pairs


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def rects(spark, a, b):
    names = ("x", "y", "width", "height", "area")
    return one(spark, **{f"a_{n}": v for n, v in zip(names, a)}, **{f"b_{n}": v for n, v in zip(names, b)})


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ((0, 0, 10, 5, 50), (9, 9, 10, 5, 50), 0.0), ((0, 0, 10, 5, 50), (0, 0, 16, 5, 80), 0.0), ((0, 0, 0, 5, 0), (0, 0, 9, 6, 54), 1.0), ((0, 0, 0, 5, 0), (0, 0, 0, 6, 0), 0.0),
        ((0, 0, 1, 1, 1), (0, 0, 2, 1.5, 2), 1.0), ((0, 0, 2, 1.5, 2), (0, 0, 1, 1, 1), 0.5), ((0, 0, 100, 10, 1000), (0, 0, 100, 40, 4000), 1.0), ((0, 0, 100, 10, 1000), (0, 0, 102, 17, 1734), 0.28),
    ],
)
def test_areas(spark, a, b, expected):
    assert rects(spark, a, b).select(D.areas_similar("a_", "b_")).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(("dx", "dy", "expected"), [(7, 7, 0.5), (3, 100, 0.0), (3, 799, 0.0), (3, 800, 0.5), (100, 3, 0.0), (900, 3, 0.5), (8, 8, 1.0)])
def test_spatially_aligned(spark, dx, dy, expected):
    assert rects(spark, (50, 50, 1, 1, 1), (50 + dx, 50 + dy, 1, 1, 1)).select(D.spatially_aligned("a_", "b_")).first()[0] == expected


@pytest.mark.parametrize(("dy", "height", "expected"), [(169, 2400, 0.5), (1300, 1401, min(1, 1.2 * 1050 / 2817.8)), (1300, 1400, 0.7 * 1050 / 2817.8)])
def test_euclidean(spark, dy, height, expected):
    assert rects(spark, (50, 50, 1, 1, 1), (50, 50 + dy, 1, 1, 1)).select(D.adjusted_euclidean_distance("a_", "b_", height)).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        (["v"] * 134, ["v"] * 134, 0.0), (["v"] * 134, ["w"] * 134, 1.0), ([""] * 134, [""] * 134, 1 - 16 / 29), (["v"] * 130 + [""] * 4, ["v"] * 100 + ["w"] * 30 + [""] * 4, 1 - (13 + 16) / 29),
        (["v"] * 80 + [""] * 54, ["v"] * 80 + ["x"] * 54, 1 - (-14 + 16) / 29), (["v", "w"] + [""] * 132, ["w", "v"] + [""] * 132, 1 - (-2 + 16) / 29),
    ],
)
def test_styles(spark, a, b, expected):
    rows = D.with_ids(spark.createDataFrame([(1, a), (2, b)], "idx int, css_array array<string>"))
    pair = rows.filter("idx = 1").select(F.col("css_ids").alias("a_css_ids"), F.col("css_blank").alias("a_css_blank")).crossJoin(rows.filter("idx = 2").select(F.col("css_ids").alias("b_css_ids"), F.col("css_blank").alias("b_css_blank")))
    assert pair.select(D.compare_computed_styles("a_", "b_")).first()[0] == pytest.approx(expected)


def test_feature_overlap(spark):
    for a, b, expected in (([], [], 0.0), (["x"], [], 1.0), (["x", "y"], ["y", "z"], 1 - 1 / 3), (["x", "x"], ["x"], 0.0)):
        rows = D.with_ids(spark.createDataFrame([(a,)], "feature_set array<string>")).select(F.col("feature_ids").alias("a_feature_ids"))
        other = D.with_ids(spark.createDataFrame([(b,)], "feature_set array<string>")).select(F.col("feature_ids").alias("b_feature_ids"))
        assert rows.crossJoin(other).select(D.featureset_overlap("a_", "b_")).first()[0] == pytest.approx(expected)


def test_pair_expressions_stay_in_generated_code(spark):
    names = list(D.REGISTRY)
    row = "page_id long, idx int, x int, y int, width int, height int, area int, css_visibility string, css_display string, jquery_is_hidden boolean, driver_is_displayed boolean, spatial_visibility string, all_visible boolean, css_array array<string>, feature_set array<string>"
    rows = D.with_ids(spark.createDataFrame([], row)).drop("css_array", "feature_set")
    found = pairs.measured(pairs.pairs_within(rows)).select("page_id", D.combined(*[F.col(n) for n in names]).alias("d"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.split("Join")[0]


def blend(a, b, quick):
    """The blend of both gestalt distances and the edit distance, written out."""

    def gestalt(x, y):
        return 1 - int(100 * SequenceMatcher(None, x, y, autojunk=False).ratio()) / 100

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = next_row(row, i, c, y)
        return row[-1] / max(len(x), len(y), 1)

    def next_row(row, i, c, y):
        out = [i]
        for j, d in enumerate(y, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    one = gestalt(a, b)
    if quick or one < 0.3:
        return one
    two = gestalt(a[::-1], b[::-1])
    if abs(one - two) <= 0.19:
        return (one + two) / 2
    e = edits(a, b)
    v = 0.34 * e + 0.33 * one + 0.33 * two
    return 0.6 * v + 0.4 * min(one, two, e) if v < 0.15 else 0.6 * v + 0.4 * max(one, two, e) if v > 0.85 else v


@pytest.mark.parametrize("quick", [True, False])
def test_blended_distance_of_random_strings(spark, quick):
    rng = random.Random(4)
    rows = [tuple("".join(rng.choice("ab<>/") for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(400)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    forward, backward = 1 - text.gestalt_percent("a", "b") / 100, 1 - text.gestalt_percent(F.reverse("a"), F.reverse("b")) / 100
    told = frame.select("k", "a", "b", forward.alias("f"), backward.alias("r")).select("k", text.blended_distance(F.col("f"), F.col("r"), text.simple_distance(F.col("a"), F.col("b")), quick).alias("d"))
    found = {r["k"]: r["d"] for r in told.collect()}
    assert all(found[k] == pytest.approx(blend(a, b, quick)) for k, (a, b) in enumerate(rows))


def test_content_is_the_mean_of_its_signals(spark):
    base = {
        "tag_name": "a", "parent_tag_name": "li", "outer_html_no_content": "<a></a>", "parent_outer_html_no_content": "<li><a></a></li>", "num_tags": 1, "text": "x", "text_is_more_link": False, "text_is_digit": False, "text_has_date": "",
        "start_tag": "<a>", "parent_start_tag": "<li>", "img_type": "", "parent_img_type": "",
    }
    dated = {**base, "text": "may 1st", "text_has_date": "MONTH_DAY_NUM_WORD"}
    image = {**base, "img_type": "IMG", "start_tag": "<a b>"}
    cases = [(base, base, 0.0), (base, dated, (1 + 0 + 0) / 3), (base, image, (0 + 0.25 + 1 + 0) / 4), (dated, {**dated, "text": "june 2nd"}, (0 + 0 + 0) / 3), (dated, {**dated, "text": "x", "text_has_date": "TIME"}, 0.35 / 3)]
    names = [side + n for side in ("a_", "b_") for n in base]
    rows = [tuple(a.values()) + tuple(b.values()) for a, b, _ in cases]
    found = [r[0] for r in spark.createDataFrame(rows, names).select(D.compare_content("a_", "b_")).collect()]
    assert found == pytest.approx([c[2] for c in cases])


def test_means(spark):
    null = F.lit(None).cast("double")
    assert one(spark).select(D.mean_of(null, F.lit(1.0), F.lit(0.0)), D.mean_of(null), D.combined(F.lit(0.5), F.lit(0.53), F.lit(0.0)), D.combined(F.lit(0.5))).first()[:] == (0.5, 0.5, 0.0, 0.5)


def test_text_and_html(spark):
    row = one(spark, h='<a class="Active b12 a" href="/x"><img src="p.png"> Read <b>more</b> </a>').select(
        html.tag_name(F.col("h")), html.class_attr_str(F.col("h")), html.visible_text(F.col("h")), html.num_tags(F.col("h")), html.img_type(F.lower("h")), html.start_tag(F.col("h")), html.tags_key(F.col("h"))
    ).first()
    assert row[:] == ("a", "['a', 'b__N__']", "Read more", 2, "IMG", '<a class="active b12 a" href="">', "a__img__b")
    words = ["3rd of March", "march 3rd", "Dec 2019", "10:30 am", "Sunday", "sunken", "none", ""]
    labels = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(text.text_has_date(F.col("w"))).collect()]
    assert labels == ["DAY_NUM_OPTWORD_MONTH", "MONTH_DAY_NUM_WORD", "MONTH_YEAR", "TIME", "DAY_NAME", "DAY_NAME", "", ""]


def test_gestalt(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string").select(text.gestalt_percent("a", "b")).collect()
    assert [r[0] for r in rows] == [75.0, 100.0, None]


def test_urls_and_layout(spark):
    base = F.lit("https://www.a.com/d/p.html?q=1")
    found = one(spark).select(*[urls.absolute_url(F.lit(h), base) for h in ("/x", "x", "//b.com/x", "#top", "mailto:a@b.c", "http://c.d")]).first()
    assert found[:] == ("https://www.a.com/x", "https://www.a.com/d/x", "https://b.com/x", "", "mailto:a@b.c", "http://c.d")
    seen = one(spark).select(*[layout.spatial_visibility(*map(F.lit, r)) for r in ((0, 0, 1, 1), (-5, 0, 5, 1), (-5, 0, 8, 1), (-5, 0, 7, 1), (0, -9, 3, 0))]).first()
    assert seen[:] == ("IN_PAGE", "OUTSIDE_PAGE", "OUTSIDE_PAGE_PARTIALLY", "OUTSIDE_PAGE", "OUTSIDE_PAGE__ZERO_AREA")


def test_quick_distance_by_letters(spark):
    texts = ["", "<a></a>", "<A href='x'></A>", "<a class='aab'>", "ééa", "<li><li>", None]
    rows = D.with_letters(spark.createDataFrame(list(enumerate(texts)), "idx int, outer_html_no_content string"))
    found = pairs.prefixed(rows, "a_").crossJoin(pairs.prefixed(rows, "b_")).select(D.quick_by_letters("a_", "b_").alias("x"), text.quick_distance(F.lower("a_outer_html_no_content"), F.lower("b_outer_html_no_content")).alias("y")).collect()
    assert len(found) == 49 and [r["x"] for r in found] == [r["y"] for r in found]
