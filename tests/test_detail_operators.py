import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.functions import distances as D
from pagelattice.functions import html, urls
from pagelattice.functions import text as text_functions
from pagelattice.functions.styles import STYLE_KEYS
from pagelattice.operators import affinity, columns, describe, evaluate, pairs, visual
from pagelattice.plans import queries
from pagelattice.sources import fixtures

KEYS = ["g"]
SCHEMA = "g string, page_idx int, gap string, y_low int, y_high int"


def gap_rows(spark, *gaps, g="a"):
    return [(g, k, gap, 10, 20) for k, gap in enumerate(gaps)]


def test_regular_gaps_give_columns_and_blank_ones_go(spark):
    rows = gap_rows(spark, "<b>x</b> one<br><i>k</i>", "<b>x</b> two<br/><i>l</i>", "<b>x</b> six<i>m</i>")
    parts = columns.split_gaps(spark.createDataFrame(rows, SCHEMA), KEYS)
    assert {r["part"] for r in parts.collect()} == set()  # two kinds of tag sequences, and no long common run
    even = spark.createDataFrame(gap_rows(spark, "<b>x</b> one<i></i>", "<b>x</b> two<i></i>", g="b"), SCHEMA)
    found = columns.text_columns(columns.split_gaps(even, KEYS), KEYS).collect()
    assert sorted((r["col_index"], r["page_idx"], r["text"]) for r in found) == [(0, 0, "x"), (0, 1, "x"), (1, 0, "one"), (1, 1, "two")]


def test_line_breaks_and_unequal_arity(spark):
    rows = [*gap_rows(spark, "<b>a<br>c</b>", "<b>d</b>"), *gap_rows(spark, "<b>a<i>c</b>", "<b>d</b>", g="b"), ("c", 0, "no tag", 0, 0)]
    parts = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("whole"))
    found = columns.text_columns(parts, KEYS).collect()
    assert sorted((r["g"], r["page_idx"], r["text"]) for r in found) == [("a", 0, "ac"), ("a", 1, "d")]


def test_inconsistent_gaps_are_cut_at_common_tags(spark):
    same = "<a>1<b>2<c>3<d>4<e>5<f>6"
    rows = gap_rows(spark, same + "<g>7<h>8", same + "<i>7<j>8")
    parts = {(r["part"], r["page_idx"]): r["gap"] for r in columns.split_gaps(spark.createDataFrame(rows, SCHEMA), KEYS).collect()}
    assert parts == {("head", 0): "<a>1<b>2<c>3<d>4<e>5", ("head", 1): "<a>1<b>2<c>3<d>4<e>5"}
    rows = gap_rows(spark, "<x>0" + same, "<y>0<z>0" + same)
    parts = {(r["part"], r["page_idx"]): r["gap"] for r in columns.split_gaps(spark.createDataFrame(rows, SCHEMA), KEYS).collect()}
    assert parts == {("tail", 0): same, ("tail", 1): same}


def test_locations_by_line_by_word_and_none(spark):
    texts = spark.createDataFrame([(1, 1, "Big sale", 100, 100), (2, 1, "two words", 100, 100), (3, 2, "x", 0, 0)], "row_id long, page_id long, text string, y_low int, y_high int")
    box = "page_id long, text string, x int, y int, x2 int, y2 int"
    lines = spark.createDataFrame([(1, "BIG SALE today", 5, 100, 95, 120), (1, "Big sale", 5, 900, 95, 920)], box)
    words = spark.createDataFrame([(1, "Two", 10, 101, 30, 111), (1, "words", 40, 101, 70, 112), (1, "words", 40, 600, 70, 612)], box)
    found = {r["row_id"]: tuple(r)[1:] for r in columns.locate_texts(texts, lines, words).collect()}
    assert found == {1: (5, 100, 90, 20), 2: (10, 101, 60, 11), 3: (None,) * 4}


def test_crops(spark):
    rng = np.random.default_rng(1)
    index = rng.integers(0, 4, (90, 120)).astype(np.uint8)
    palette = np.array([[0, 0, 0], [90, 90, 90], [180, 180, 180], [255, 255, 255]], np.uint8)
    image = palette[index]
    screens = spark.createDataFrame([(1, 120, bytearray(image.tobytes()), bytearray(palette.tobytes()), bytearray(index.tobytes()))], "page_id long, width int, image binary, palette binary, indices binary")
    elements = spark.createDataFrame([(1, 0, 10, 5, 100, 80, "<img>"), (1, 1, -1, 0, 5, 5, ""), (1, 2, 0, 0, 0, 5, None), (1, 3, 500, 500, 5, 5, "")], "page_id long, idx int, x int, y int, width int, height int, outer_html string")
    found = {r["idx"]: r for r in visual.crop_elements(elements, screens).collect()}
    assert [found[k]["dummy"] for k in range(4)] == [False, True, True, True]
    at_y, at_x = ((np.arange(50) + 0.5) * 80 / 50).astype(int), ((np.arange(50) + 0.5) * 2).astype(int)
    small = index[5:85, 10:110][at_y][:, at_x]
    assert found[0]["pixels"] == small.ravel().tolist() and sum(found[0]["histogram"]) == 2500
    assert found[0]["grey"] == image[5:85, 10:110, 0].astype(int).ravel().tolist()
    assert found[0]["is_photo"] is False  # quantising changed nothing


def test_structure_of_equal_and_unlike_crops(spark):
    grey = np.random.default_rng(2).integers(0, 255, (20, 20))
    wide = np.pad(grey, ((0, 0), (0, 3)))
    rows = [(20, 20, grey.ravel().tolist(), 23, 20, wide.ravel().tolist()), (20, 20, grey.ravel().tolist(), 60, 60, [0] * 3600), (20, 6, [0] * 120, 20, 6, [0] * 120)]
    pairs = spark.createDataFrame(rows, "a_width int, a_height int, a_grey array<int>, b_width int, b_height int, b_grey array<int>")
    found = [r[0] for r in pairs.select(visual.compare_structure("a_", "b_")).collect()]
    assert found[0] == pytest.approx(0, abs=1e-9) and found[1:] == [None, None]


def test_content_decisions(spark):
    base = {"tag_name": "a", "parent_tag_name": "li", "outer_html_no_content": "<a></a>", "parent_outer_html_no_content": "<li><a></a></li>", "num_tags": 1}
    other = {**base, "tag_name": "b", "parent_tag_name": "p"}
    unlike = {**base, "outer_html_no_content": "zzzzzzzzzz"}
    far = {**base, "parent_outer_html_no_content": "<p>" * 200}
    cases = [(base, base, 0.0), (base, other, 1.0), (base, unlike, 1.0), (base, far, 1.0), ({**base, "parent_outer_html_no_content": ""}, base, None)]
    rows = [tuple(a.values()) + tuple(b.values()) for a, b, _ in cases]
    names = [side + n for side in ("a_", "b_") for n in base]
    found = [r[0] for r in spark.createDataFrame(rows, names).select(D.compare_outer("a_", "b_")).collect()]
    assert found == [c[2] for c in cases]


DETAIL = "g string, page_idx int, page_id long, pos int, tag string, outer_html string, outer_no_content string, parent_no_content string, start_tag string, num_tags int, x int, y int, width int, height int"


def detail(page_idx, pos, text, y, tag="p", num_tags=1, x=40, attrs="", parent=None):
    html = f"<{tag}{attrs}>{text}</{tag}>"
    return ("a", page_idx, page_idx + 10, pos, tag, html, f"<{tag}{attrs}></{tag}>", parent, f"<{tag}{attrs}>", num_tags, x, y, 100, 20)


def test_matches_and_the_box_around_both(spark):
    rows = [detail(0, 0, "one", 100), detail(1, 0, "two", 240), detail(2, 0, "three", 400), detail(2, 1, "far", 900), detail(3, 4, "four", 410, num_tags=9), detail(3, 5, "five", 180)]
    frame = spark.createDataFrame(rows, DETAIL)
    first, second, later = (frame.filter(c) for c in ("page_idx = 0", "page_idx = 1", "page_idx >= 2"))
    best = columns.best_matches(columns.match(first, second), second)
    assert [tuple(r)[:3] for r in best.collect()] == [("a", 0, 0)]
    # the third page's element lies outside the first one's own box, but inside the box around both
    found = sorted((r["page_idx"], r["pos"]) for r in columns.extend(best, first, second, later).collect())
    assert found == [(2, 0), (3, 5)]


def test_elements_of_many_tags_choose_none(spark):
    rows = [detail(0, 0, "one", 100, num_tags=9), detail(1, 0, "two", 100), detail(0, 1, "x", 600), detail(1, 1, "y", 600, num_tags=9), detail(0, 2, "z", 1200, "li"), detail(1, 2, "z", 1200, "li"), detail(1, 3, "z", 1230, "li", num_tags=9), detail(1, 4, "z", 1290, "li")]
    frame = spark.createDataFrame(rows, DETAIL)
    second = frame.filter("page_idx = 1")
    best = columns.best_matches(columns.match(frame.filter("page_idx = 0"), second), second)
    # page 2's element of many tags is a partner, but doesn't look for one itself
    assert sorted((r["pos1"], r["pos2"]) for r in best.collect()) == [(1, 1), (2, 2), (2, 4)]


def brute_matches(rows, distance):
    """The matches of the first two pages and their elements on later pages, one element after another."""
    meets = lambda box, e: e["x"] <= box[2] and e["x"] + 15 >= box[0] and e["y"] <= box[3] and e["y"] + 15 >= box[1]
    bounds = lambda e: (max(0, e["x"] - 30), max(0, e["y"] - 160), e["x"] + e["width"] + 50, e["y"] + e["height"] + 160)
    pages = {}
    for r in rows:
        pages.setdefault(r["page_idx"], []).append(r)
    near = [(distance(a, b), a, b) for a in pages[0] if a["num_tags"] <= 8 for b in pages[1] if a["tag"] == b["tag"] and meets(bounds(a), b)]
    near = [n for n in near if n[0] < 0.24]
    best = {}
    for d, a, b in sorted(near, key=lambda n: (n[0], n[2]["pos"])):
        best.setdefault(a["pos"], (a, b))
    pairs, used = list(best.values()), {b["pos"] for _, b in best.values()}
    rest = {}
    for d, a, b in sorted(near, key=lambda n: (n[0], n[1]["pos"])):
        if b["pos"] not in used and b["num_tags"] <= 8:
            rest.setdefault(b["pos"], (a, b))
    out = {}
    for a, b in pairs + list(rest.values()):
        one, two = bounds(a), bounds(b)
        box = (min(one[0], two[0]), min(one[1], two[1]), max(one[2], two[2]), max(one[3], two[3]))
        cells = {0: a["pos"], 1: b["pos"]}
        for n in (n for n in pages if n > 1):
            scored = [((distance(a, c) + distance(b, c)) / 2, c["pos"]) for c in pages[n] if c["num_tags"] <= 8 and c["tag"] == a["tag"] and meets(box, c)]
            scored = [x for x in sorted(scored) if x[0] < 0.25]
            if scored:
                cells[n] = scored[0][1]
        out[a["pos"], b["pos"]] = cells
    return out


def test_columns_of_four_pages_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for page in range(4):
        for pos in range(12):
            attrs = "" if pos % 3 else f' class="{"k" * (1 + pos)}"'
            rows.append(detail(page, pos, f"field {pos} of {page * 7 + pos}", 90 + 60 * pos + rng.randrange(-25, 25), rng.choice(["p", "p", "li"]), rng.choice([1, 2, 9]), 40 + rng.randrange(8), attrs))
    frame = spark.createDataFrame(rows, DETAIL)
    names = frame.columns
    told = [dict(zip(names, r)) for r in rows]

    def distance(a, b):
        if a["tag"] != b["tag"]:
            return 1.0
        x, y = a["outer_no_content"], b["outer_no_content"]
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, before = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        s = row[-1] / max(len(x), len(y))
        s *= (0.85 if abs(a["y"] - b["y"]) < 40 else 0.95) if abs(a["x"] - b["x"]) < 10 else 1
        return s * (0.9 if abs(a["height"] - b["height"]) < 3 else 1) * (0.9 if a["start_tag"] == b["start_tag"] else 1.1)

    sources = spark.createDataFrame([("a", n, "<div>" + "<b>label</b>".join(r["outer_html"] for r in told if r["page_idx"] == n) + "</div>") for n in range(4)], "g string, page_idx int, html string")
    found = columns.find_columns(frame, sources)
    expected = brute_matches(told, distance)
    got = {}
    for r in found.filter("kind = 'element'").collect():
        got.setdefault(r["col_id"], {})[r["page_idx"]] = r["text"]
    texts = {(r["page_idx"], r["pos"]): f"field {r['pos']} of {r['page_idx'] * 7 + r['pos']}" for r in told}
    assert got == {f"{a}-{b}": {n: texts[n, p] for n, p in cells.items()} for (a, b), cells in expected.items()} and len(got) > 5


def test_recognised_lines_fix_widths_and_place_texts(spark):
    rows = [detail(p, pos, f"{name} {p}", y) for p in range(3) for pos, (name, y) in enumerate((("title", 100), ("price", 300)))]
    frame = spark.createDataFrame(rows, DETAIL)
    pages = [f"<i>x</i><p>title {p}</p><b>made in {p}</b><u></u><p>price {p}</p>" for p in range(3)]
    sources = spark.createDataFrame([("a", p, h) for p, h in enumerate(pages)], "g string, page_idx int, html string")
    box = "page_id long, text string, x int, y int, x2 int, y2 int"
    lines = spark.createDataFrame([(p + 10, f"title {p} !", 40, 101, 340, 120) for p in range(3)] + [(p + 10, f"made in {p}", 50, 200, 120, 215) for p in range(3)], box)
    words = spark.createDataFrame([], box)
    found = columns.find_columns(frame, sources, lines, words).collect()
    assert {(r["text"], r["width"]) for r in found if r["kind"] == "element"} == {(f"title {p}", 300) for p in range(3)} | {(f"price {p}", 100) for p in range(3)}
    placed = {r["text"]: (r["x"], r["y"], r["width"], r["height"]) for r in found if r["kind"] == "text" and "made" in r["text"]}
    assert placed == {f"made in {p}": (50, 200, 70, 15) for p in range(3)}


def test_features_of_an_element(spark):
    row = spark.createDataFrame(
        [(20, "12px", "red", "400", "a/b/c/d", False, "block", '<A class=" Active nav12  x " href="/u" hrefLang="en" data-k="v">t</A>', "a__['nav__N__', 'x']", 2, "http://facebook.com/p", "SOCIAL_URL_HOST", "WEBPAGE")],
        "height int, font_size string, font_colour string, font_weight string, xpath_suffix string, driver_is_displayed boolean, css_display string, outer_html string, tag_class_str string, n_ancestors int, url string, url_host string, url_type string",
    )
    own = ["attrs___class__ Active nav12  x ", "attrs___data-k__v", "attrs___hreflang__en", "classes___nav__N__", "classes___x"]
    expected = ["height___20", "font-size___12px", "font-colour___red", "font-weight___400", "xpath_suffix___a/b/c/d", "driver__is_displayed___False", "cssComputed__display___block", "url_host___SOCIAL_HOST", "url_type___WEBPAGE", "ancestor1__tag_class___a__['nav__N__', 'x']"]
    expected += [f"ancestor{n}__{x}" for n in range(2) for x in own]
    assert row.select(describe.feature_set()).first()[0] == sorted(expected)
    bare = row.withColumns({"driver_is_displayed": F.lit(True), "n_ancestors": F.lit(0), "url": F.lit(""), "url_type": F.lit("")})
    assert bare.select(describe.feature_set()).first()[0] == sorted([*expected[:5], "cssComputed__display___block", "url_type___"])


@pytest.mark.parametrize(("path", "suffix"), [("/html/body[1]/a[12]", "/html/body/a"), ("/a/b/c/d", "/a/b/c/d"), ("/a/b/c/d[3]/e", "b/c/d/e"), ("/a/b/c/d/e[123]", "b/c/d/e[123]"), ("", "")])
def test_path_suffix(spark, path, suffix):
    assert spark.range(1).select(html.xpath_suffix(F.lit(path))).first()[0] == suffix


@pytest.mark.parametrize(
    ("url", "host", "expected"),
    [("http://a.b/?x=1&y", "a.b", [("x", "1"), ("y", "NO_EQUALS")]), ("http://a.b/?x=1&x=2&&", "a.b", [("x", "2")]), ("http://a.b/?whole", "a.b", [("whole", "")]), ("http://a.b/?x=1", "c.d", []), ("http://a.b/", "a.b", []), ("http://a.b/?&", "a.b", [])],
)
def test_url_parameters(spark, url, host, expected):
    row = spark.range(1).select(urls.url_params(F.lit(url), F.lit("a.b"), F.lit(host)), urls.url_param_names(F.lit(url), F.lit("a.b"), F.lit(host))).first()
    assert [tuple(p) for p in row[0]] == expected and row[1] == ",".join(n for n, _ in expected)


def test_styles_of_a_map(spark):
    styles = spark.createDataFrame([({"z-index": "3", "color": "c" * 120, "none": "x"},)], "styles map<string,string>").select(describe.style_array(F.col("styles"))).first()[0]
    assert len(styles) == 134 and styles[STYLE_KEYS.index("z-index")] == "3" and styles[STYLE_KEYS.index("color")] == "c" * 100 and sum(map(bool, styles)) == 2
    rows = spark.createDataFrame([(1, 0, ["a", "", "b"]), (1, 1, ["a", "x", "c"]), (2, 0, ["c", "", ""])], "page_id int, idx int, css_array array<string>")
    found = {(r["page_id"], r["idx"], r["k"]): r["n"] for r in describe.interned_styles(rows).collect()}
    assert found == {(1, 0, 0): 0, (1, 0, 1): -1, (1, 0, 2): 2, (1, 1, 0): 0, (1, 1, 1): 1, (1, 1, 2): 3, (2, 0, 0): 0, (2, 0, 1): -1, (2, 0, 2): -1}


def scalar_ssim(x, y):
    total = []
    for r in range(x.shape[0] - 6):
        for c in range(x.shape[1] - 6):
            a, b = x[r : r + 7, c : c + 7].ravel(), y[r : r + 7, c : c + 7].ravel()
            cov = ((a - a.mean()) * (b - b.mean())).sum() / 48
            total.append((2 * a.mean() * b.mean() + 6.5025) * (2 * cov + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (a.var(ddof=1) + b.var(ddof=1) + 58.5225)))
    return float(np.mean(total))


def test_structure_against_a_scalar_version(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], []
    for w1, h1, w2, h2 in ((12, 9, 12, 9), (12, 9, 14, 17), (20, 8, 20, 8), (9, 30, 10, 30)):
        x, y = rng.integers(0, 255, (h1, w1)).astype(float), rng.integers(0, 255, (h2, w2)).astype(float)
        h, w = min(h1, h2), min(w1, w2)
        y[:h, :w] = (x[:h, :w] + y[:h, :w]) / 2
        rows.append((w1, h1, x.astype(int).ravel().tolist(), w2, h2, y.astype(int).ravel().tolist()))
        expected.append(1 - scalar_ssim(x[:h, :w], np.floor(y[:h, :w])))
    pairs = spark.createDataFrame(rows, "a_width int, a_height int, a_grey array<int>, b_width int, b_height int, b_grey array<int>")
    assert [r[0] for r in pairs.select(visual.compare_structure("a_", "b_")).collect()] == pytest.approx(expected)


def test_perceptual_hash_against_a_scalar_version(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 255, 1024).tolist() for _ in range(4)]

    def scalar(v):
        x = np.array(v, float).reshape(32, 32)
        low = np.array([[sum(x[r, c] * np.cos(np.pi * (2 * r + 1) * i / 64) * np.cos(np.pi * (2 * c + 1) * j / 64) for r in range(32) for c in range(32)) for j in range(8)] for i in range(8)]).ravel()
        return f"{int(''.join('1' if v >= np.median(low[1:]) else '0' for v in low), 2):016x}"

    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*images, None, [1, 2]])], "k int, pixels array<int>")
    found = {r[0]: r[1] for r in rows.select("k", visual.perceptual_hash("pixels")).collect()}
    assert found == {**{k: scalar(v) for k, v in enumerate(images)}, 4: None, 5: None}


def test_photos_and_pairs_of_crops(spark):
    rng = np.random.default_rng(1)
    index = rng.integers(0, 4, (90, 120)).astype(np.uint8)
    palette = np.array([[0, 0, 0], [90, 90, 90], [180, 180, 180], [240, 240, 240]], np.uint8)
    image = palette[index].astype(int)
    image[np.arange(90) % 5 != 0] += 12  # quantising keeps a fifth of the rows
    screens = spark.createDataFrame([(1, 120, bytearray(image.astype(np.uint8).tobytes()), bytearray(palette.tobytes()), bytearray(index.tobytes()))], "page_id long, width int, image binary, palette binary, indices binary")
    boxes = [(0, 0, 100, 80, "<img>"), (1, 0, 100, 80, "x"), (2, 0, 99, 80, "a.JPG"), (0, 0, 50, 80, "<img>"), (-1, 0, 9, 9, "")]
    elements = spark.createDataFrame([(1, k, *b) for k, b in enumerate(boxes)], "page_id long, idx int, x int, y int, width int, height int, outer_html string")
    crops = visual.crop_elements(elements, screens)
    assert {r["idx"]: r["is_photo"] for r in crops.collect()} == {0: True, 1: False, 2: True, 3: False, 4: None}
    found = {(r["i"], r["j"]): r for r in visual.visual_pairs(crops).collect()}
    assert len(found) == 10 and found[0, 2]["visually_similar"] == 0.0 and all(found[k, 4]["visually_similar"] == 0.5 for k in range(4))
    one = {r["idx"]: r for r in crops.collect()}
    a, b = np.array(one[0]["pixels"]), np.array(one[1]["pixels"])
    assert found[0, 1]["summary"] == pytest.approx(0.5 * (a != b).mean() + 0.25 * (a[50:] != b[:-50]).mean() + 0.25 * (a[:-50] != b[50:]).mean())
    assert found[0, 3]["structure"] is None


def test_colours_of_unequal_areas(spark):
    cases = [(0.4, 0.2, 0.9, 100, 100, 0.27), (0.4, 0.2, None, 100, 241, 0.345), (0.4, 0.2, None, 240, 100, 0.3), (1.0, 1.0, None, 1, 9, 1.0), (0.4, 0.2, None, 0, 9, 0.3)]
    rows = spark.createDataFrame([c[:5] for c in cases], "h double, s double, f double, a int, b int")
    found = [r[0] for r in rows.select(visual.compare_colours(*[F.col(n) for n in "hsfab"])).collect()]
    assert found == pytest.approx([c[5] for c in cases])


def scalar_messages(s, rounds=200, damping=0.5):
    """Affinity propagation element by element, without stopping early."""
    n = len(s)
    r, a = [[0.0] * n for _ in range(n)], [[0.0] * n for _ in range(n)]
    for _ in range(rounds):
        new = [[s[i][k] - max(a[i][m] + s[i][m] for m in range(n) if m != k) for k in range(n)] for i in range(n)]
        r = [[damping * r[i][k] + (1 - damping) * new[i][k] for k in range(n)] for i in range(n)]
        new = [[sum(max(0, r[m][k]) for m in range(n) if m != k) if i == k else min(0, r[k][k] + sum(max(0, r[m][k]) for m in range(n) if m not in (i, k))) for k in range(n)] for i in range(n)]
        a = [[damping * a[i][k] + (1 - damping) * new[i][k] for k in range(n)] for i in range(n)]
    chosen = [k for k in range(n) if r[k][k] + a[k][k] > 0]
    return [i if i in chosen else max(chosen, key=lambda k: s[i][k]) for i in range(n)]


def test_affinity_propagation_against_scalar_messages(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.3, (5, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    s = -distance
    np.fill_diagonal(s, np.median(s[~np.eye(15, dtype=bool)]))
    expected = scalar_messages(s.tolist())
    assert affinity.exemplars(-distance).tolist() == expected and len(set(expected)) == 3
    rows = [(p, i, j, float(distance[i, j])) for p in ("x", "y") for i in range(15) for j in range(i + 1, 15)]
    found = {(r["page_id"], r["idx"]): r["exemplar"] for r in affinity.propagated(spark.createDataFrame(rows, "page_id string, i int, j int, dist double")).collect()}
    assert found == {(p, i): expected[i] for p in ("x", "y") for i in range(15)}
    alike = spark.createDataFrame([(1, 0, 1, 0.0)], "page_id long, i int, j int, dist double")
    assert affinity.propagated(alike).count() == 2


def test_detail_scan_and_parents(spark):
    page = "<ul><li>a</li><li><b>c</b></li></ul><p>" + "<i>x</i>" * 6 + "</p><h1>t</h1>"
    rows = fixtures.scan_details(spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["pos"], r["tag"], r["outer_html"]) for r in rows] == [(0, "h1", "<h1>t</h1>"), (1, "li", "<li>a</li>"), (2, "li", "<li><b>c</b></li>"), *[(3 + k, "i", "<i>x</i>") for k in range(6)], (9, "b", "<b>c</b>")]
    assert [r["parent_outer_html"] is not None for r in rows] == [False, True, False, *[False] * 6, True]


def test_parents_count_in_the_distance_of_details(spark):
    a, b = detail(0, 0, "one", 100, parent="<ul></ul>"), detail(1, 0, "two", 100, parent="<ol></ol>")
    far, none = detail(1, 0, "two", 190, tag="p", x=80, attrs=" k", parent="<ul></ul>"), detail(1, 0, "two", 100)
    rows = spark.createDataFrame([(k, *x, *y) for k, (x, y) in enumerate(((a, b), (a, far), (a, none), (a, detail(1, 0, "two", 100, "li"))))], ["k", *["a_" + n for n in detail_names()], *["b_" + n for n in detail_names()]])
    found = [r[0] for r in rows.orderBy("k").select(D.detail_similarity("a_", "b_")).collect()]
    assert found == pytest.approx([0.35 * 2 / 9 * 0.85 * 0.9 * 0.9, 0.65 * 2 / 9 * 0.9 * 1.1, 0.0, 1.0])


def detail_names():
    return [part.split()[0] for part in DETAIL.split(", ")]


def png(width, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for value in row for v in (value, value, value)) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_equal_images_of_a_folder(spark, tmp_path):
    rng = random.Random(3)
    one, two = ([[rng.randrange(256) for _ in range(32)] for _ in range(32)] for _ in range(2))
    for name, rows in (("a", one), ("b", two), ("c", one)):
        (tmp_path / f"{name}.png").write_bytes(png(32, rows))
    images = fixtures.read_images(spark, str(tmp_path))
    grey = F.expr("transform(sequence(0, 1023), k -> cast(conv(hex(substring(data, 3 * k + 1, 1)), 16, 10) as int))")
    found = visual.same_images(images.select("origin", visual.perceptual_hash(grey).alias("phash"))).collect()
    assert [[o.rsplit("/", 1)[1] for o in r["origins"]] for r in found] == [["a.png", "c.png"]]


def test_scan_with_equality_and_limit(spark):
    rows = spark.createDataFrame([(k, "sd"[k % 2]) for k in range(20)], "k int, ans string")
    assert {r["ans"] for r in fixtures.scan_where(rows, 5, ans="s").collect()} == {"s"} and fixtures.scan_where(rows, 5, ans="s").count() == 5 and fixtures.scan_where(rows, 99, ans="d", k=3).count() == 1


def test_numbers_of_styles_need_no_join(spark):
    rows = spark.createDataFrame([(1, 0, ["a", None, "b"]), (1, 1, ["", "x", "b"])], "page_id int, idx int, css_array array<string>")
    told = describe.interned_styles(rows)
    assert "Join" not in told._jdf.queryExecution().executedPlan().toString()
    assert {(r["idx"], r["k"]): r["n"] for r in told.collect()} == {(0, 0): 0, (0, 1): -1, (0, 2): 2, (1, 0): -1, (1, 1): 1, (1, 2): 2}


def test_keys_of_a_map_are_looked_up_in_one_expression(spark):
    plan = spark.createDataFrame([({"color": "x"},)], "styles map<string,string>").select(describe.style_array(F.col("styles")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at") <= 2


def test_weights_travel_as_one_row(spark):
    rng = np.random.default_rng(5)
    arrays = [[str(rng.choice(["", "u", "v", f"rare{k}"], p=[0.1, 0.5, 0.3, 0.1])) for _ in STYLE_KEYS] for k in range(12)]
    rows = spark.createDataFrame([(1, k, a) for k, a in enumerate(arrays)], "page_id int, idx int, css_array array<string>")
    weights = describe.style_weight(rows.select(F.posexplode("css_array").alias("k", "v")), rows)
    exact = {(r["k"], r["v"]): r["weight"] for r in weights.collect()}
    whole = spark.createDataFrame([(1, k, [(v or None, exact[at, v]) for at, v in enumerate(a)]) for k, a in enumerate(arrays)], "page_id int, idx int, styles array<struct<v string, w double>>")
    got, expected = ({(r["i"], r["j"]): r["d"] for r in pairs.measured(pairs.pairs_within(e), {"d": D.compare_weighted_styles}).collect()} for e in (describe.weighed_styles(rows, weights), whole))
    assert len(got) == 66 and got == expected


def test_style_maps_by_ids(spark):
    rng = np.random.default_rng(6)
    arrays = [[[None, "", "u", "v"][c] for c in rng.integers(0, 4 if k % 2 else 2, len(STYLE_KEYS))] for k in range(8)]
    rows = spark.createDataFrame([(1, k, a, a) for k, a in enumerate(arrays)], "page_id int, idx int, css_array array<string>, styles array<string>")
    found = pairs.measured(pairs.pairs_within(D.with_ids(rows, missing=True)), {"ids": D.compare_style_map_ids, "maps": D.compare_style_maps}).collect()
    assert len(found) == 28 and all(r["ids"] == pytest.approx(r["maps"]) for r in found)


def test_short_date_patterns_find_what_the_long_ones_find():
    rng = random.Random(7)
    parts = "0 1 2 3 4 5 7 9 00 10 20 30 31 32 12 24 st nd rd th of jan january june july sept september may march Mar DEC 2010 2019 2020 2024 2025 2009 : . am pm a.m. p.m. a.m PM mon monday thurs Sun x".split() + [" ", " ", "  "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 6))) for _ in range(60_000)]
    for (name, long), (same, short) in zip(text_functions.DATE_PATTERNS, text_functions.DATE_FOUND, strict=True):
        long, short = re.compile(f"(?i){long}"), re.compile(f"(?i){short}")
        assert name == same and not [t for t in texts if bool(long.search(t)) != bool(short.search(t))][:3]


def test_pairs_of_crops_in_blocks_and_without_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shots = []
    for page in (1, 2):
        index = rng.integers(0, 4, (40, 60)).astype(np.uint8)
        palette = np.array([[0, 0, 0], [90, 90, 90], [180, 180, 180], [240, 240, 240]], np.uint8)
        shots.append((page, 60, bytearray(palette[index].tobytes()), bytearray(palette.tobytes()), bytearray(index.tobytes())))
    screens = spark.createDataFrame(shots, "page_id long, width int, image binary, palette binary, indices binary")
    boxes = [(page, k, k % 3 * 9 - (k == 4), 2, 10 + k % 2 * 8, 12, "x") for page, n in ((1, 14), (2, 3), (7, 2)) for k in range(n)]
    elements = spark.createDataFrame(boxes, "page_id long, idx int, x int, y int, width int, height int, outer_html string")
    crops = visual.crop_elements(elements, screens)
    assert "Broadcast" not in crops._jdf.queryExecution().executedPlan().toString()
    rows = {(r["page_id"], r["idx"]): r for r in crops.collect()}
    assert sorted(rows) == [(p, k) for p, n in ((1, 14), (2, 3)) for k in range(n)]
    whole = sorted(visual.visual_pairs(crops).collect())
    monkeypatch.setattr(visual, "BLOCK", 4)
    assert sorted(visual.visual_pairs(crops).collect()) == whole and len(whole) == 14 * 13 // 2 + 3
    both = crops.select(*[F.col(c).alias(f"a_{c}") for c in crops.columns]).join(crops.select(*[F.col(c).alias(f"b_{c}") for c in crops.columns]), F.expr("a_page_id = b_page_id and a_idx < b_idx"))
    columns_ = both.select("a_page_id", "a_idx", "b_idx", visual.summary_difference("a_pixels", "b_pixels"), visual.hist_difference(F.col("a_histogram"), F.col("b_histogram")), visual.compare_structure("a_", "b_"))
    assert sorted(tuple(r) for r in columns_.collect()) == [tuple(r)[:6] for r in whole]


def test_places_over_ranges(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0.0, 0.1, 0.3, 0.3, 0.9, None]), rng.choice([None, 0.0, 0.1, 0.31, 0.8])) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, colour double, structure double")
    report = evaluate.pair_report(table, ["id"])
    assert report.columns == ["id", "colour", "structure", "triage", "place"]
    assert "rownumber" not in report._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    places = {}
    for r in sorted(report.collect(), key=lambda r: (r["triage"], r["colour"] is not None, r["colour"] or 0.0, r["structure"] is not None, r["id"])):
        places[r["triage"]] = places.get(r["triage"], 0) + 1
        assert r["place"] == places[r["triage"]]
    assert sum(places.values()) == 400 and len(places) == 3


def test_gaps_of_sources_in_their_own_table(spark):
    pages = spark.createDataFrame([(k, "".join(f"<p>{k}{i}</p>  <b>" for i in range(k + 1))) for k in range(4)] + [(9, "x")], "page_id int, html string")
    parts = spark.createDataFrame([(k, i, f"<p>{k}{i}</p>") for k in range(4) for i in range(k + 1)] + [(2, 7, "absent"), (5, 0, "x")], "page_id int, pos int, outer_html string")
    told = columns.page_gaps(parts, pages)
    assert sorted(told.collect()) == sorted(columns.gaps(parts.join(pages, "page_id")).collect()) and told.count() == 6
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "html" not in window


@pytest.mark.parametrize(("most", "rows"), [(1, 1000), (3, 1000), (1, 37)])
def test_edges_of_vectors_in_blocks(spark, tmp_path, monkeypatch, most, rows):
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(230, 5))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, [0.0] * 5), (901, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(queries, "MOST_BLOCKS", most)
    monkeypatch.setattr(queries, "BLOCK_ROWS", rows)
    found = queries._vector_edges(spark, str(tmp_path))
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(1 - x @ x.T <= queries.VECTOR_EPS)) if i < j}
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected)
