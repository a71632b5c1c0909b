"""Column expressions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What URLs are told apart by, here and in the patterns below.
SOCIAL = r"(^|\.)(facebook|twitter|x|instagram|linkedin|youtube|pinterest|tiktok)\.[a-z.]+$"


def url_host(url: Column) -> Column:
    """Authority in lower case, without a leading `www.`."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), r"^www\.", "")


def url_base(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def absolute_url(href: Column, page_url: Column) -> Column:
    """Absolute targets stay; `//x` and `/x` get the page's scheme or base; others its folder."""
    h = F.trim(href)
    base = url_base(page_url)
    folder = F.regexp_extract(page_url, r"^(https?://[^/?#]+(/[^?#]*/)?)", 1)
    return (
        F.when((h == "") | F.startswith(h, F.lit("#")) | F.startswith(F.lower(h), F.lit("javascript:")), "")
        .when(F.rlike(h, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(page_url, r"^(https?:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(base, h))
        .otherwise(F.concat(F.regexp_replace(folder, r"/$", ""), F.lit("/"), h))
    )


def url_type(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(url == "", "").when(F.startswith(u, F.lit("mailto:")), "EMAIL").when(F.startswith(u, F.lit("tel:")), "PHONE")
        .when(F.rlike(u, F.lit(r"\.(png|jpe?g|gif|svg|webp)([?#].*)?$")), "IMAGE").when(F.rlike(u, F.lit(r"\.(pdf|docx?|xlsx?|pptx?)([?#].*)?$")), "DOCUMENT")
        .otherwise("WEBPAGE")
    )


def is_social(url: Column) -> Column:
    return F.rlike(url_host(url), F.lit(SOCIAL))


def is_google_map(url: Column) -> Column:
    return F.contains(url, F.lit("maps.google")) | F.rlike(url, F.lit(r"google\.[a-z\.]{2,6}/maps/"))


def is_eventbrite(url: Column) -> Column:
    return F.rlike(url, F.lit(r"eventbrite\.[a-z\.]{2,6}/e/"))


def is_google_calendar(url: Column) -> Column:
    return F.contains(url, F.lit("google.com/calendar")) | F.contains(url, F.lit("calendar.google.com"))


def contains_event(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(url, r"^([^?]*)", 1), r"/+$", "")
    return F.contains(url, F.lit("event")) & ~F.endswith(bare, F.lit("events"))


def described(url: Column) -> dict[str, Column]:
    """The URL columns of a description."""
    kind = url_type(url)
    return {
        "url_type": kind,
        "url_host": F.when(kind != "WEBPAGE", "").when(is_social(url), "SOCIAL_URL_HOST").otherwise(url_host(url)),
        "url_lower": F.lower(url),
        "is_google_map": is_google_map(url),
        "is_eventbrite": is_eventbrite(url),
        "is_gcal": is_google_calendar(url),
        "is_social": is_social(url),
        "contains_event": contains_event(url),
    }


def url_params(url: Column, host: Column, page_host: Column) -> Column:
    """Parameters of a URL on the page's own host as structs (name, value), by name; of equal names the last.

    A query without `=` is a parameter of its own with a blank value, and a
    parameter without one among others has the value NO_EQUALS.
    """
    query = F.regexp_replace(F.trim(F.regexp_extract(url, r"\?([^#]*)", 1)), "&+$", "")
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    one = lambda p: F.struct(F.regexp_extract(p, r"(?s)^([^=]*)", 1).alias("name"), F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise("NO_EQUALS").alias("value"))
    names = F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1))
    last = F.filter(parts, lambda p, k: ~F.array_contains(F.slice(names, k + 2, F.size(names)), F.regexp_extract(p, r"(?s)^([^=]*)", 1)))
    none = F.array().cast("array<struct<name:string,value:string>>")
    lone = F.array(F.struct(query.alias("name"), F.lit("").alias("value")))
    told = F.coalesce((host == page_host) & F.contains(url, F.lit("?")) & (query != ""), F.lit(False))
    return F.when(~told, none).when(~F.contains(query, F.lit("=")), lone).otherwise(F.array_sort(F.transform(last, one)))


def url_param_names(url: Column, host: Column, page_host: Column) -> Column:
    """Names of the parameters, sorted, by comma."""
    return F.array_join(F.transform(url_params(url, host, page_host), lambda p: p["name"]), ",")
