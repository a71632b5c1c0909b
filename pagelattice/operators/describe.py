"""From partial feeds to one description of each element."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions.html import attributes, class_features
from pagelattice.functions.styles import STYLE_KEYS
from pagelattice.functions.urls import is_social

# Fixed value: the weight of a style from which on `compare_weighted_styles` tells none from another.
COMMON = 0.88


def consolidate(feeds: Sequence[DataFrame], keys: Sequence[str] = ("page_id", "node_id")) -> DataFrame:
    """One row a node: of each column the greatest value, so blanks and nulls lose.

    The result doesn't depend on the order of the feeds, and late feeds may be
    added later.  Maps have no order: the first that isn't null stays.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    maps = {f.name for f in rows.schema if f.dataType.typeName() == "map"}
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[(F.first(c, True) if c in maps else F.max(c)).alias(c) for c in rest])


def new_elements(found: DataFrame, known: DataFrame, key: str = "node_id") -> DataFrame:
    """Elements that a rescan found and that aren't known."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def with_navigation(elements: DataFrame, nav: DataFrame, keys: Sequence[str] = ("page_id", "idx")) -> DataFrame:
    """in_nav: whether the table of navigation ids holds the element."""
    known = nav.select(*keys).distinct().withColumn("in_nav", F.lit(True))
    return elements.join(known, list(keys), "left").withColumn("in_nav", F.coalesce("in_nav", F.lit(False)))


def filter_invisible(elements: DataFrame) -> DataFrame:
    """Drops elements outside the page, without area or hidden; numbers the others anew."""
    gone = (F.col("spatial_visibility") == "OUTSIDE_PAGE") | F.endswith("spatial_visibility", F.lit("__ZERO_AREA")) | F.col("jquery_is_hidden")
    kept = elements.filter(~gone).withColumnRenamed("idx", "index_original")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("index_original")) - 1)


def style_frequency(styles: DataFrame, elements: DataFrame) -> DataFrame:
    """k, v, frequency: share of the elements that have value v for key k.  The number of elements is a scalar of the same plan."""
    n = elements.agg(F.count("*").cast("double")).scalar()
    return styles.groupBy("k", "v").agg(F.count("*").alias("n")).select("k", "v", (F.col("n") / n).alias("frequency"))


def style_weight(styles: DataFrame, elements: DataFrame) -> DataFrame:
    """k, v, weight: rare values weigh more, none less than 0.12."""
    return style_frequency(styles, elements).select("k", "v", F.greatest(F.lit(1.0) - F.col("frequency"), F.lit(0.12)).alias("weight"))


def weighed_styles(elements: DataFrame, weights: DataFrame) -> DataFrame:
    """page_id, idx, styles: structs (v, w) in the order of the keys, v null where it's blank, as `compare_weighted_styles` reads them.

    Weights from COMMON on act alike there, and only a value that more than
    1 - COMMON of the elements have weighs less, of which a key has a few at
    most.  So those alone travel to the elements, as one short row.
    """
    few = weights.filter(F.col("weight") < COMMON).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("v", "weight"))).alias("m"))
    row = few.agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("few")).select(F.transform(F.sequence(F.lit(0), F.lit(len(STYLE_KEYS) - 1)), lambda k: F.try_element_at("few", k)).alias("few"))
    weight = lambda v, k: F.coalesce(F.try_element_at(F.get("few", k), v), F.lit(1.0))
    styles = F.transform("css_array", lambda v, k: F.struct(F.when(v != "", v).alias("v"), weight(v, k).alias("w")))
    return elements.crossJoin(F.broadcast(row)).select("page_id", "idx", styles.alias("styles"))


def number_repeats(rows: DataFrame, value: str, order: str, within: str = "page_id", out: str = "name") -> DataFrame:
    """The k-th occurrence of a value in a page's list is named value__k; the first has no suffix."""
    n = F.row_number().over(Window.partitionBy(within, value).orderBy(order))
    return rows.withColumn(out, F.when(n == 1, F.col(value)).otherwise(F.concat(F.col(value), F.lit("__"), n.cast("string"))))


#: The fields whose features are `field___value`, in this order, with the columns that hold them.
FEATURE_FIELDS = {"height": "height", "font-size": "font_size", "font-colour": "font_colour", "font-weight": "font_weight", "xpath_suffix": "xpath_suffix"}


def feature_set() -> Column:
    """The features of an element, strings `key___value`, each once.

    Features of ancestors 0 to 2 hold the element's own classes, attributes and
    tag with classes, and say of the ancestor only that it exists.  `displayed`
    is named unless true; the host only where there's a URL.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    none = F.array().cast("array<string>")
    parts = [F.array(*[text(f"{k}___", F.col(c).cast("string")) for k, c in FEATURE_FIELDS.items()])]
    shown = F.col("driver_is_displayed")
    parts.append(F.when(shown, none).otherwise(F.array(text("driver__is_displayed___", F.when(shown.isNull(), "None").otherwise("False")))))
    parts.append(F.array(text("cssComputed__display___", F.col("css_display"))))
    classes, attrs = class_features(F.col("outer_html")), F.filter(attributes(F.col("outer_html")), lambda x: x["key"] != "href")
    named = lambda values, key, told: F.transform(values, lambda x: text(key, told(x)))
    for n in range(3):
        own = [F.array(text(f"ancestor{n}__tag_class___", F.col("tag_class_str")))] if n else []
        own.append(named(classes, f"ancestor{n}__classes___", lambda c: c))
        own.append(named(attrs, f"ancestor{n}__attrs___", lambda x: F.concat(x["key"], F.lit("__"), x["value"])))
        parts.append(F.when(F.col("n_ancestors") > n, F.concat(*own)).otherwise(none))
    host = F.when(is_social(F.col("url")), "SOCIAL_HOST").otherwise(F.col("url_host"))
    parts.append(F.when((F.col("url") != "") & host.isNotNull(), F.array(text("url_host___", host))).otherwise(none))
    parts.append(F.array(text("url_type___", F.col("url_type"))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull())))


def style_array(styles: Column) -> Column:
    """A map of styles as an array in the order of the keys: '' where a key is missing, values cut at 100 characters.

    The map is bound to a variable, as an expression for it would be evaluated for each key.
    """
    told = lambda m: F.transform(F.array(*[F.lit(k) for k in STYLE_KEYS]), lambda k: F.substring(F.coalesce(F.try_element_at(m, k), F.lit("")), 1, 100))
    return F.get(F.transform(F.array(styles), told), F.lit(0))


def interned_styles(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """page, idx, k, n: each style that isn't blank as a number that its page gives to position and value; blank is -1.

    Blank styles come last in the order of the numbers, so that one sort of a page's styles does.
    """
    styles = elements.select(page, "idx", F.posexplode("css_array").alias("k", "v"))
    blank = ~F.coalesce(F.col("v") != "", F.lit(False))
    number = F.dense_rank().over(Window.partitionBy(page).orderBy(blank, "k", "v")) - 1
    return styles.select(page, "idx", "k", F.when(blank, -1).otherwise(number).alias("n"))
