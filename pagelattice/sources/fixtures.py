"""Element tables derived from the driver's tables, and readers of case files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import html, layout, text, urls
from pagelattice.functions.styles import STYLE_KEYS
from pagelattice.session import read_table, spread

PAGE_HEIGHT = 2400
DETAIL = r"(?is)<h1\b[^>]*>.*?</h1>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>|<footer\b[^>]*>.*?</footer>"


KEYS = ("page_id", "cast(p_partkey%40 as int) idx")
RECT = (
    "cast((p_partkey%6)*210 as int) x",
    "cast((p_partkey%40)*60 + case when p_partkey%7=0 then 3 else 0 end as int) y",
    "cast(case when p_partkey%17=0 then 0 else 60+((p_partkey*7)%4)*3 + case when p_partkey%5=0 then 80 else 0 end end as int) width",
    "cast(12+(p_partkey%3)*(p_partkey%4) as int) height",
)
VISIBILITY = (
    "case p_partkey%5 when 0 then 'none' when 1 then 'inline' else 'block' end css_display",
    "case when p_partkey%9=0 then 'hidden' else 'visible' end css_visibility",
    "p_partkey%5=0 jquery_is_hidden",
    "p_partkey%10<>0 driver_is_displayed",
    "case p_partkey%8 when 0 then 'OUTSIDE_PAGE' when 1 then 'IN_PAGE__ZERO_AREA' else 'IN_PAGE' end spatial_visibility",
)
STYLES = ("transform(sequence(0,133), k -> case when (k*7+p_partkey)%11=0 then '' else concat('v', cast(p_partkey%(k%3+1) as string)) end) css_array",)
FEATURES = ("array_sort(array_distinct(concat(split(p_name,' '), array('brand___'||p_brand, 'type___'||p_type, 'size___'||cast(p_size%5 as string))))) feature_set",)

_TAG = "case when p_partkey%5=0 then 'div' else 'a' end"
_URL = "case when p_partkey%5=0 then '' else case p_partkey%4 when 0 then 'https://www.example.com/p/' || cast(p_partkey%50 as string) when 1 then 'https://facebook.com/x' when 2 then 'mailto:a@b.c' else 'https://shop.example.net/i.png' end end"
_CLASSES = "case p_partkey%7 when 0 then '' when 1 then 'Active' else 'Active ' || split_part(p_name, ' ', 1) || cast(p_size as string) || ' btn' || cast(p_partkey%3 as string) end"
#: What a browser would hand over of an element: HTML, path, number of ancestors (itself included), fonts and URL.
RAW = (
    f"""'<' || {_TAG} || ' class="' || {_CLASSES} || '"' || case when p_partkey%5=0 then '' else ' href="' || {_URL} || '" hreflang="en"' end || ' data-size="' || cast(p_size as string) || '">' || p_name || '</' || {_TAG} || '>' outer_html""",
    f"'/html/body[1]/div[' || cast(p_partkey%120 as string) || ']' || case when p_partkey%3=0 then '' else '/ul/li[3]' end || '/' || {_TAG} xpath",
    "cast(p_partkey%4 as int) n_ancestors", f"{_URL} url", "cast(10+p_size%4 as string) || 'px' font_size", "case when p_partkey%3=0 then 'bold' else '400' end font_weight", "lower(p_brand) font_colour",
)


def raw_elements(spark: SparkSession, sf_dir: str, *more: tuple[str, ...]) -> DataFrame:
    """Elements as a browser hands them over, with what features, URLs and contents are told by, and the columns of further groups."""
    rows = elements(spark, sf_dir, RECT, VISIBILITY, RAW, *more)
    h, u = F.col("outer_html"), F.col("url")
    rows = rows.withColumns({"xpath_suffix": html.xpath_suffix(F.col("xpath")), "tag_class_str": html.tag_class(h), **urls.described(u)})
    return rows.withColumns({
        "text": html.visible_text(h), "start_tag": html.start_tag(h), "tag_name": html.tag_name(h), "img_type": html.img_type(F.lower(h)), "outer_html_no_content": html.no_content(h), "num_tags": html.num_tags(h),
        **{n: F.lit("") for n in ("parent_start_tag", "parent_img_type", "parent_tag_name", "parent_outer_html_no_content")},
    }).withColumns({"text_is_digit": text.text_is_digit(F.col("text")), "text_has_date": text.text_has_date(F.col("text")), "text_is_more_link": text.text_is_more_link(F.col("text"))})


def style_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with their styles as a map, blank ones missing, some values long."""
    values = F.transform("css_array", lambda v, k: F.when((k % 13 == 5) & (v != ""), F.rpad(v, 120, "x")).otherwise(v))
    styles = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in STYLE_KEYS]), values), lambda _, v: v != "")
    return elements(spark, sf_dir, STYLES).select("page_id", "idx", styles.alias("styles"))


SCREEN = "page_id long, width int, image binary, palette binary, indices binary"


def screens(spark: SparkSession, sf_dir: str, width: int = 160, height: int = 120) -> DataFrame:
    """A screenshot of each page: the index of a pixel's colour is (7 x + 3 y + page) % 16; every fifth row differs from its colour by 9."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        palette = (np.arange(48) * 5 % 240).astype(np.uint8).reshape(16, 3)
        y, x = np.mgrid[0:height, 0:width]
        for batch in batches:
            rows = []
            for page in batch["page_id"]:
                index = ((7 * x + 3 * y + page) % 16).astype(np.uint8)
                image = palette[index] + np.where(y % 5 == 0, 0, 9).astype(np.uint8)[:, :, None]
                rows.append((page, width, image.tobytes(), palette.tobytes(), index.tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "width", "image", "palette", "indices"])

    return elements(spark, sf_dir, RECT).select("page_id").distinct().mapInPandas(draw, SCREEN)


def shown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements small enough for those screenshots; a few lie outside or are empty."""
    keys = "cast((p_partkey*7)%80 - 3 as int) x", "cast((p_partkey*11)%50 as int) y", "cast(case when p_partkey%19=0 then 0 else 7+(p_partkey%3)*36 end as int) width", "cast(8+(p_partkey%2)*56 as int) height"
    image = """case when p_partkey%2=0 then '<a><img src="a.jpg"></a>' else '<a>x</a>' end outer_html"""
    return elements(spark, sf_dir, keys, (image,)).withColumn("area", F.col("width") * F.col("height"))


def elements(spark: SparkSession, sf_dir: str, *groups: tuple[str, ...]) -> DataFrame:
    """Elements made of the rows of part, with the columns of the groups (all without any), in one scan.

    A small file is few tasks, and its rows become far longer here, so they are
    spread by their page while they are short.
    """
    chosen = groups or (RECT, VISIBILITY, STYLES, FEATURES)
    part = spread(read_table(spark, sf_dir, "part").withColumn("page_id", F.expr("cast(floor(p_partkey/40) as bigint)")), "page_id")
    rows = part.selectExpr(*KEYS, *[c for g in chosen for c in g])
    if RECT in chosen:
        rows = rows.withColumn("area", F.col("width") * F.col("height"))
    return rows.withColumn("all_visible", layout.all_visible()) if VISIBILITY in chosen else rows


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a link: page_id, idx, outer_html, page_url."""
    return scan_links(read_table(spark, sf_dir, "pages"))


def scan_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(html.LINK), F.lit(0))).alias("idx", "outer_html"))


def described_links(found: DataFrame) -> DataFrame:
    """Links with the columns that URL and content comparison need; the parent is a list item."""
    h = F.col("outer_html")
    parent = F.concat(F.lit("<li>"), h, F.lit("</li>"))
    rows = found.withColumn("url", urls.absolute_url(html.href(h), F.col("page_url")))
    return rows.select(
        "page_id", "idx", "outer_html", "url", urls.url_host(F.col("page_url")).alias("page_host"), *[c.alias(n) for n, c in urls.described(F.col("url")).items()],
        html.visible_text(h).alias("text"), html.start_tag(h).alias("start_tag"), html.tag_name(h).alias("tag_name"), html.img_type(F.lower(h)).alias("img_type"),
        html.start_tag(parent).alias("parent_start_tag"), html.img_type(F.lower(parent)).alias("parent_img_type"), html.no_content(h).alias("outer_html_no_content"),
        html.tag_name(parent).alias("parent_tag_name"), html.no_content(parent).alias("parent_outer_html_no_content"), html.num_tags(h).alias("num_tags"),
    ).withColumns({"text_is_digit": text.text_is_digit(F.col("text")), "text_has_date": text.text_has_date(F.col("text")), "text_is_more_link": text.text_is_more_link(F.col("text"))})


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text elements of pages with a pseudo layout, inside the band 70 < y < 1700."""
    found = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(DETAIL), F.lit(0))).alias("pos", "outer_html"))
    h = F.col("outer_html")
    rows = found.select(
        "page_id", "pos", html.tag_name(h).alias("tag"), "outer_html", html.no_content(h).alias("outer_no_content"), F.lit(None).cast("string").alias("parent_no_content"), html.start_tag(h).alias("start_tag"),
        F.lit(40).alias("x"), (F.col("pos") * 60 + 71).alias("y"), F.least(F.lit(1200), F.length(html.visible_text(h)) * 8).alias("width"), F.lit(20).alias("height"), html.num_tags(h).alias("num_tags"),
    )
    return rows.filter("y > 70 and y < 1700")


ENCLOSING = r"(?is)<ul\b[^>]*>.*?</ul>|<nav\b[^>]*>.*?</nav>|<section\b[^>]*>.*?</section>"


def scan_details(pages: DataFrame, most: int = 12, few: int = 3) -> DataFrame:
    """page_id, pos, tag, outer_html, parent_outer_html: elements of the detail tags, tag by tag, without those of over `most` opening brackets.

    An element of fewer than `few` comes with the first enclosing list,
    navigation or section that holds it, if there's one.
    """
    found = None
    for place, tag in enumerate(html.DETAIL_TAGS):
        own = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))
        part = _placed(own, place, tag)
        found = part if found is None else F.concat(found, part)
    brackets = lambda h: F.length(h) - F.length(F.replace(h, F.lit("<"), F.lit("")))
    kept = F.filter(found, lambda e: brackets(e["outer_html"]) <= most)
    rows = pages.select("page_id", F.regexp_extract_all("html", F.lit(ENCLOSING), F.lit(0)).alias("around"), F.posexplode(kept).alias("pos", "e")).select("page_id", "pos", "around", "e.*")
    parent = F.get(F.filter("around", lambda v: F.contains(v, F.col("outer_html")) & (v != F.col("outer_html"))), F.lit(0))
    return rows.select("page_id", "pos", "tag", "outer_html", F.when(brackets(F.col("outer_html")) < few, parent).alias("parent_outer_html"))


def _placed(found: Column, place: int, tag: str) -> Column:
    return F.transform(found, lambda h: F.struct(F.lit(place).alias("place"), F.lit(tag).alias("tag"), h.alias("outer_html")))


def contexts(pages: DataFrame, quick: bool = True) -> DataFrame:
    """What is told of a page beside its elements."""
    return pages.select("page_id", urls.url_host(F.col("url")).alias("page_url_host"), urls.url_base(F.col("url")).alias("page_host_base"), F.lit(PAGE_HEIGHT).alias("page_height"), F.lit(quick).alias("quick"))


def siblings(spark: SparkSession, sf_dir: str, most: int = 3, least: int = 3) -> DataFrame:
    """g, page_idx, page_id: the first pages of hosts that have at least `least`."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rows = read_table(spark, sf_dir, "pages").select("page_id", host.alias("g"))
    counts = rows.groupBy("g").count().filter(F.col("count") >= least).select("g")
    placed = rows.join(counts, "g", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("page_id"))).filter(F.col("r") <= most)
    return placed.select("g", "page_id", (F.col("r") - 1).alias("page_idx"))


def scan_where(rows: DataFrame, most: int, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values, `most` at most."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.limit(most)


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Case files {context, elem_descriptions: [...]}, one row an element with its index."""
    cases = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return cases.select("context", F.posexplode("elem_descriptions").alias("idx", "desc")).select("context.*", "idx", "desc.*")


TRUTH = "cluster_ids array<array<string>>, results_old struct<matrix_results:map<string,map<string,double>>>, results_new struct<matrix_results:map<string,map<string,double>>>"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth files as rows: case, function, pair, old and new distance, and whether the pair is one cluster's."""
    files = spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("case", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    old = files.select("case", "cluster_ids", F.explode("results_old.matrix_results").alias("name", "pairs"), F.col("results_new.matrix_results").alias("later"))
    rows = old.select("case", "cluster_ids", "name", F.try_element_at("later", "name").alias("later"), F.explode("pairs").alias("pair", "old"))
    ends = F.split("pair", "__")
    same = F.exists("cluster_ids", lambda c: F.array_contains(c, ends[0]) & F.array_contains(c, ends[1]))
    return rows.select("case", "name", "pair", "old", F.try_element_at("later", "pair").alias("new"), same.alias("same_cluster"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
