"""Column expressions that read HTML text; all of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that detail pages are scanned for, in this order.
DETAIL_TAGS = ("h1", "h2", "h3", "h4", "h5", "div", "span", "p", "abbr", "article", "li", "strong", "section", "header", "summary", "time", "footer", "i", "b", "em", "td")
LINK = r"(?is)<a\b[^>]*>.*?</a>"


def tag_name(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"^\s*<([a-zA-Z0-9]+)", 1))


def start_tag(html: Column) -> Column:
    """The first tag in lower case; the targets of links and images are blanked."""
    return F.lower(F.regexp_replace(F.regexp_extract(html, r"^\s*(<[^>]*>)", 1), r'(href|src)="[^"]*"', '$1=""'))


def no_content(html: Column) -> Column:
    """The tags alone."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"<[^>]*>"), F.lit(0)), "")


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def inner_html(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"^\s*<[^>]*>", ""), r"</[^>]*>\s*$", "")


def href(html: Column) -> Column:
    return F.regexp_extract(html, r'href="([^"]*)"', 1)


def num_tags(html: Column) -> Column:
    """Half of the opening brackets, rounded to even."""
    return F.bround((F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))) / F.lit(2.0)).cast("int")


def img_type(lower_html: Column) -> Column:
    return F.when(F.contains(lower_html, F.lit("<img")), "IMG").when(F.contains(lower_html, F.lit("background-image: url(")), "BACKGROUND_IMG").otherwise("")


def class_attr_str(html: Column) -> Column:
    """Sorted classes as a list literal; digits become __N__ and `active` is left out."""
    raw = F.regexp_extract(F.regexp_extract(html, r"^\s*(<[^>]*>)", 1), r'class="([^"]*)"', 1)
    parts = F.transform(F.split(raw, " "), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\d+", "__N__"))
    kept = F.array_sort(F.filter(parts, lambda x: x != "active"))
    return F.when(raw == "", "").when(F.size(kept) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(kept, "', '"), F.lit("']")))


def attributes(html: Column) -> Column:
    """Attributes of the first tag as structs (key, value): keys in lower case, of equal keys the first."""
    tag = F.regexp_extract(html, r"^\s*(<[^>]*>)", 1)
    found = F.transform(
        F.regexp_extract_all(tag, F.lit(r'([a-zA-Z_:][-a-zA-Z0-9_:.]*="[^"]*")'), F.lit(1)),
        lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^=]*)=", 1)).alias("key"), F.regexp_extract(x, '(?s)^[^=]*="(.*)"$', 1).alias("value")),
    )
    names = F.transform(found, lambda x: x["key"])
    return F.filter(found, lambda x, k: F.array_position(names, x["key"]) == k + 1)


def attribute(html: Column, name: str) -> Column:
    """An attribute's value, '' without it."""
    return F.coalesce(F.get(F.filter(attributes(html), lambda x: x["key"] == name), F.lit(0))["value"], F.lit(""))


def class_features(html: Column) -> Column:
    """Classes in their order, in lower case with digits as __N__; `active` and blanks are left out."""
    parts = F.transform(F.split(F.trim(attribute(html, "class")), " "), lambda x: F.lower(F.trim(x)))
    return F.transform(F.filter(parts, lambda x: (x != "active") & (x != "")), lambda x: F.regexp_replace(x, r"\d+", "__N__"))


def tag_class(html: Column) -> Column:
    return F.concat(tag_name(html), F.lit("__"), class_attr_str(html))


def xpath_suffix(xpath: Column) -> Column:
    """The last four steps without numbers; a path of fewer than five slashes as a whole."""
    bare = F.regexp_replace(xpath, r"\[\d{1,2}\]", "")
    steps = F.split(bare, "/")
    return F.when(F.size(steps) < 6, bare).otherwise(F.array_join(F.slice(steps, -4, 4), "/"))


def xpath_with_attributes(xpath: Column, html: Column) -> Column:
    """The path with a condition of all attributes but href, in their order; without any as it is."""
    named = F.transform(F.filter(attributes(html), lambda x: x["key"] != "href"), lambda x: F.concat(F.lit("@"), x["key"], F.lit('="'), x["value"], F.lit('"')))
    condition = F.when(F.size(named) > 0, F.concat(F.lit("["), F.array_join(named, " and "), F.lit("]"))).otherwise(F.lit(""))
    return F.when(F.size(attributes(html)) > 0, F.concat(F.regexp_replace(xpath, "/+$", ""), condition)).otherwise(xpath)


def parent_fields(ancestors: Column) -> dict[str, Column]:
    """The columns of the first ancestor but the element itself; '' where there's none."""
    outer = F.coalesce(F.get(ancestors, F.lit(1))["outer_html"], F.lit(""))
    told = lambda v: F.when(outer != "", v).otherwise(F.lit(""))
    return {
        "parent_tag_name": F.coalesce(F.get(ancestors, F.lit(1))["tag_name"], F.lit("")), "parent_outer_html": outer, "parent_outer_html_l": F.lower(outer),
        "parent_outer_html_no_content": told(no_content(F.lower(outer))), "parent_start_tag": told(start_tag(outer)), "parent_img_type": told(img_type(F.lower(outer))),
    }


def tags_key(html: Column) -> Column:
    """Opening tags in order, br left out."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z0-9]+)"), F.lit(1)), F.lower)
    return F.array_join(F.filter(tags, lambda t: t != "br"), "__")


def outer_key(html: Column) -> Column:
    return F.array_join(F.regexp_extract_all(html, F.lit(r"</?[a-zA-Z0-9]+"), F.lit(0)), "__")


def text_fragments(html: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(html, F.lit(r">([^<>]+?)<"), F.lit(1)), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.filter(parts, lambda x: x != "")


def fragment_text(html: Column) -> Column:
    """Fragments by line, with `&gt;` and `&lt;` as characters; null if there are none."""
    parts = text_fragments(html)
    return F.when(F.size(parts) > 0, F.replace(F.replace(F.array_join(parts, "\n"), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")))


def is_offline(html: Column, status: Column | None = None) -> Column:
    bad = html.isNull() | F.contains(html, F.lit("502 Bad Gateway")) | F.contains(html, F.lit("503 Service Unavailable"))
    return F.coalesce(bad | status.isin(500, 501, 502, 503) if status is not None else bad, F.lit(False))
