"""Queries of what elements are described by, of clusters and their updates, and of screenshots, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import distances as D
from pagelattice.functions import html, urls
from pagelattice.operators import describe, updates, visual
from pagelattice.operators import pairs as P
from pagelattice.plans import detail_queries as T
from pagelattice.plans import oracle as O
from pagelattice.plans import queries as Q
from pagelattice.session import read_table
from pagelattice.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
H = F.col


def query(sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_RAW = r"""raw as (select *, case when t = 'div' then '' else case k % 4 when 0 then 'https://www.example.com/p/' || cast(k % 50 as varchar) when 1 then 'https://facebook.com/x' when 2 then 'mailto:a@b.c' else 'https://shop.example.net/i.png' end end as url,
        case k % 4 when 0 then 'WEBPAGE' when 1 then 'WEBPAGE' when 2 then 'EMAIL' else 'IMAGE' end as kind, case k % 4 when 0 then 'example.com' when 1 then 'SOCIAL_HOST' else '' end as host,
        '/html/body[1]/div[' || cast(k % 120 as varchar) || ']' || case when k % 3 = 0 then '' else '/ul/li[3]' end || '/' || t as xpath from (
        select p_partkey as k, cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx, p_name, p_size, p_brand, case when p_partkey % 5 = 0 then 'div' else 'a' end as t,
            case p_partkey % 7 when 0 then '' when 1 then 'Active' else 'Active ' || split_part(p_name, ' ', 1) || cast(p_size as varchar) || ' btn' || cast(p_partkey % 3 as varchar) end as cls from part)),
    told as (select *, case when length(regexp_replace(xpath, '\[\d{1,2}\]', '', 'g')) - length(replace(regexp_replace(xpath, '\[\d{1,2}\]', '', 'g'), '/', '')) < 5 then regexp_replace(xpath, '\[\d{1,2}\]', '', 'g')
            else array_to_string(string_split(regexp_replace(xpath, '\[\d{1,2}\]', '', 'g'), '/')[-4:], '/') end as suffix,
        [regexp_replace(lower(c), '\d+', '__N__', 'g') for c in string_split(cls, ' ') if lower(c) <> 'active' and c <> ''] as classes from raw),
    named as (select *, t || '__' || case when cls = '' then '' when len(classes) = 0 then '[]' else '[''' || array_to_string(list_sort(classes), ''', ''') || ''']' end as tag_class from told)"""
_FEATURES = f"""{O._RECT}, {O._VIS}, {_RAW},
    attrs as (select *, list_concat(['class__' || cls], list_concat(case when t = 'a' then ['hreflang__en'] else [] end, ['data-size__' || cast(p_size as varchar)])) as attr from named),
    features as (select page_id, idx, list_sort(list_distinct(list_concat(
        ['height___' || cast(height as varchar), 'font-size___' || cast(10 + p_size % 4 as varchar) || 'px', 'font-colour___' || lower(p_brand), 'font-weight___' || case when k % 3 = 0 then 'bold' else '400' end, 'xpath_suffix___' || suffix,
         'cssComputed__display___' || css_display, 'url_type___' || case when t = 'div' then '' else kind end],
        case when driver_is_displayed then [] else ['driver__is_displayed___False'] end, case when url <> '' then ['url_host___' || host] else [] end,
        case when k % 4 > 0 then list_concat(['ancestor0__classes___' || c for c in classes], ['ancestor0__attrs___' || c for c in attr]) else [] end,
        case when k % 4 > 1 then list_concat(['ancestor1__tag_class___' || tag_class], ['ancestor1__classes___' || c for c in classes], ['ancestor1__attrs___' || c for c in attr]) else [] end,
        case when k % 4 > 2 then list_concat(['ancestor2__tag_class___' || tag_class], ['ancestor2__classes___' || c for c in classes], ['ancestor2__attrs___' || c for c in attr]) else [] end))) as f
        from attrs join rect using (page_id, idx) join vis using (page_id, idx))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.raw_elements(spark, sf_dir).select("page_id", "idx", describe.feature_set().alias("feature_set"))


@query(f"with {_RAW} select page_id, idx, tag_class from named")
def p7_tag_class(spark, sf_dir):
    return X.raw_elements(spark, sf_dir).select("page_id", "idx", H("tag_class_str").alias("tag_class"))


_OUTER = """'<li class="Nav 1"><img src="' || cast(idx as varchar) || '.png">' || h || '</li>'"""


@query(f"""with {O._LINKS}, parents as (select page_id, idx, case when idx % 4 = 0 then '' else {_OUTER} end as p from links)
    select page_id, idx, case when p = '' then '' else 'li' end as parent_tag_name, p as parent_outer_html, lower(p) as parent_outer_html_l, {O._NO_CONTENT.format('lower(p)')} as parent_outer_html_no_content,
        case when p = '' then '' else '<li class="nav 1">' end as parent_start_tag, case when p = '' then '' else 'IMG' end as parent_img_type from parents""")
def p9_parent(spark, sf_dir):
    """Every fourth link has no ancestor but itself."""
    own = F.struct(html.tag_name(H("outer_html")).alias("tag_name"), H("outer_html"))
    outer = F.concat(F.lit('<li class="Nav 1"><img src="'), H("idx").cast("string"), F.lit('.png">'), H("outer_html"), F.lit("</li>"))
    parent = F.struct(F.lit("li").alias("tag_name"), outer.alias("outer_html"))
    rows = X.links(spark, sf_dir).withColumn("ancestors", F.when(H("idx") % 4 == 0, F.array(own)).otherwise(F.array(own, parent)))
    return rows.select("page_id", "idx", *[c.alias(n) for n, c in html.parent_fields(H("ancestors")).items()])


@query(f"with {_RAW} select page_id, idx, suffix as xpath_suffix from told")
def p10_xpath_suffix(spark, sf_dir):
    return X.raw_elements(spark, sf_dir).select("page_id", "idx", "xpath_suffix")


@query(f"""with {_RAW} select page_id, idx, xpath || '[@class="' || cls || '"' || case when t = 'a' then ' and @hreflang="en"' else '' end || ' and @data-size="' || cast(p_size as varchar) || '"]' as xpath_w_attrs from raw""")
def p11_xpath_with_attributes(spark, sf_dir):
    return X.raw_elements(spark, sf_dir).select("page_id", "idx", html.xpath_with_attributes(H("xpath"), H("outer_html")).alias("xpath_w_attrs"))


@query(f"with {O._CSS} select page_id, idx, array_to_string([case when c[k] <> '' and (k - 1) % 13 = 5 then rpad(c[k], 100, 'x') else c[k] end for k in range(1, 135)], '|') as css from css")
def p15_css_array(spark, sf_dir):
    return X.style_maps(spark, sf_dir).select("page_id", "idx", F.array_join(describe.style_array(H("styles")), "|").alias("css"))


@query(f"""with {O._CSS}, kv as (select page_id, idx, cast(k - 1 as int) as k, c[k] as v from css, unnest(range(1, 135)) as t(k)),
    numbers as (select page_id, k, v, row_number() over (partition by page_id order by k, v) - 1 as n from (select distinct page_id, k, v from kv where v <> ''))
    select page_id, idx, k, cast(coalesce(n, -1) as int) as n from kv left join numbers using (page_id, k, v)""")
def p16_css_interning(spark, sf_dir):
    return describe.interned_styles(X.elements(spark, sf_dir, X.STYLES))


_PARAMS = "case page_id % 6 when 0 then '' when 1 then '?a=1&b=2&a=3' when 2 then '?x' when 3 then '?q=1&flag&' when 4 then '?&' else '?z=v=w&k=' end"


@query("""select page_id, case when page_id % 5 = 4 or url = '' then '' else case page_id % 6 when 1 then 'a,b' when 2 then 'x' when 3 then 'flag,q' when 5 then 'k,z' else '' end end as names,
    case when page_id % 5 = 4 or url = '' then '' else case page_id % 6 when 1 then '3,2' when 2 then '' when 3 then 'NO_EQUALS,1' when 5 then ',v=w' else '' end end as vals from pages""")
def p23_url_params(spark, sf_dir):
    """Pages' URLs with a query; every fifth is on another host than its page."""
    rows = read_table(spark, sf_dir, "pages").withColumn("u", F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.expr(_PARAMS))).withColumn("host", urls.url_host(H("u")))
    page_host = F.when(H("page_id") % 5 == 4, "other.org").when(H("url") == "", "none").otherwise(H("host"))
    found = rows.select("page_id", urls.url_params(H("u"), H("host"), page_host).alias("p"), urls.url_param_names(H("u"), H("host"), page_host).alias("names"))
    return found.select("page_id", "names", F.array_join(F.transform("p", lambda p: p["value"]), ",").alias("vals"))


@query(f"with {_FEATURES} select page_id, idx, array_to_string(f, '|') as features from features")
def p24_feature_set(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "idx", F.array_join("feature_set", "|").alias("features"))


@query(O._pairs(_FEATURES, "features", O._JACCARD.format("a.f", "b.f")))
def c9_element_features(spark, sf_dir):
    """The overlap of the features that elements really get."""
    return P.measured(P.pairs_within(D.with_ids(_features(spark, sf_dir)).drop("feature_set")), {"distance": D.featureset_overlap}).withColumn("distance", F.round("distance", 6))


_C10 = """case when a.url = '' or b.url = '' then case when a.url = b.url then 0.0 else 1.0 end when a.url = b.url then 0.0 when a.kind <> b.kind and (a.kind = 'WEBPAGE' or b.kind = 'WEBPAGE') then 1.0
    else list_avg([case when a.kind = b.kind and a.kind <> 'WEBPAGE' then 0.0 end, case when a.social and b.social then 0.0 when a.social or b.social then 1.0 end,
        case when a.h = b.h then case when a.h = 'example.com' then 0.3 else 0.0 end when a.h = 'example.com' or b.h = 'example.com' then 1.0 else 0.5 end]) end"""
_C5A = "case when a.p_name = b.p_name then 0.0 end"
_START_TAG = """('<' || t || ' class="' || lower(cls) || '"' || case when t = 'a' then ' href="" hreflang="en"' else '' end || ' data-size="' || cast(p_size as varchar) || '">')"""
_TAGS_ONLY = """('<' || t || ' class="' || cls || '"' || case when t = 'a' then ' href="' || url || '" hreflang="en"' else '' end || ' data-size="' || cast(p_size as varchar) || '"></' || t || '>')"""
_C5B = "case when a.st = b.st and length(a.st) > 24 then 0.0 when a.st = b.st then 0.0 else 0.25 end"
_QUICK = "(1.0 - 2.0 * list_sum([least(length(a.nc) - length(replace(a.nc, c, '')), length(b.nc) - length(replace(b.nc, c, ''))) for c in list_distinct(string_split(a.nc, ''))]) / (length(a.nc) + length(b.nc)))"
_TEN = f"""{O._RECT}, {O._VIS}, {O._CSS}, {_FEATURES.removeprefix(f"{O._RECT}, {O._VIS}, ")},
    elem as (select *, case when t = 'div' then '' else kind end as kind2, {_START_TAG} as st, lower({_TAGS_ONLY}) as nc, t = 'a' and k % 4 = 1 as social,
            case when t = 'div' then '' when k % 4 = 1 then 'SOCIAL_URL_HOST' else host end as h from box join vis using (page_id, idx) join css using (page_id, idx) join features using (page_id, idx) join named using (page_id, idx)),
    named2 as (select * exclude (kind, kind2), kind2 as kind from elem),
    measured as (select a.page_id, a.idx as i, b.idx as j, [cast(v as double) for v in [{O._C1}, {O._C2}, {O._C3A}, {O._C3C}, {O._c4('a.c', 'b.c')}, {O._C8}, {O._JACCARD.format('a.f', 'b.f')}, {_C10},
        coalesce(list_avg([cast(x as double) for x in [{_C5A}, {_C5B}, case when {_QUICK} > 0.57 then {_QUICK} end]]), 0.5), case when not a.driver_is_displayed or not b.driver_is_displayed then 0.5 else {O._C1} end]] as d from named2 a join named2 b on {O._SAME_PAGE})"""


@query(f"with {_TEN} select page_id, i, j, round(coalesce(list_avg([v for v in d if abs(0.5 - v) > 0.04]), 0.5), 6) as dist from measured")
def a5_combine_all(spark, sf_dir):
    """All ten functions; the crops' verdict is stood in for by their areas."""
    rows = X.raw_elements(spark, sf_dir, X.STYLES).withColumn("feature_set", describe.feature_set())
    pairs = P.pairs_within(D.with_letters(D.with_ids(rows)).drop("css_array", "feature_set").withColumn("page_host", F.lit("example.com")))
    pairs = pairs.withColumn("cheap", D.quick_by_letters("a_", "b_"))
    ten = D.all_functions(lambda a, b: D.where_displayed(a, b, D.areas_similar(a, b)), H("cheap"))
    measured = P.measured(pairs, ten)
    return measured.select("page_id", "i", "j", F.round(D.combined(*[H(n) for n in ten]), 6).alias("dist"))


@query(f"""with recursive {O._ALL}, {O._REACH}, {_RAW}, rows as (select page_id, cluster_key, idx, area, driver_is_displayed, all_visible, url, p_name from keyed join box using (page_id, idx) join vis using (page_id, idx) join raw using (page_id, idx))
    select page_id, cluster_key, count(*) as length, round(avg(cast(area as double)), 6) as avg_area, bool_or(driver_is_displayed) as any_displayed, bool_and(driver_is_displayed) as visible, bool_and(all_visible) as all_visible,
        string_agg(cast(idx as varchar), ',' order by idx) as node_ids, coalesce(string_agg(url, ' ' order by idx) filter (where url <> ''), '') as urls,
        array_to_string(list_sort(list_distinct(coalesce(list(url) filter (where url <> ''), []))), ' ') as urls_key, array_to_string(list_sort(list_distinct(list(p_name))), '|') as text_key from rows group by page_id, cluster_key""")
def a6_cluster_stats(spark, sf_dir):
    rows = Q._clusters(spark, sf_dir).filter("cluster_key is not null").join(X.raw_elements(spark, sf_dir).hint("merge"), ["page_id", "idx"])
    found = updates.cluster_fields(rows)
    return found.select(
        "page_id", "cluster_key", "length", F.round("avg_area", 6).alias("avg_area"), "any_displayed", "visible", "all_visible", F.array_join(F.transform("node_ids", lambda v: v.cast("string")), ",").alias("node_ids"),
        F.array_join("urls", " ").alias("urls"), F.array_join("urls_key", " ").alias("urls_key"), F.array_join("text_key", "|").alias("text_key"),
    )


_SETS = f"""{O._ALL}, {O._REACH}, {_RAW}, sets as (select page_id, cluster_key, list_sort(list_distinct(coalesce(list(url) filter (where url <> ''), []))) as u from keyed join raw using (page_id, idx) group by page_id, cluster_key)"""


@query(f"with recursive {_SETS} select a.page_id, a.cluster_key as one, b.cluster_key as other from sets a join sets b on a.page_id = b.page_id and a.cluster_key < b.cluster_key and a.u = b.u")
def a8_equivalent_clusters(spark, sf_dir):
    rows = Q._clusters(spark, sf_dir).filter("cluster_key is not null").join(X.raw_elements(spark, sf_dir).hint("merge"), ["page_id", "idx"])
    return updates.equivalent_clusters(updates.cluster_fields(rows))


@query(f"with recursive {O._ALL}, {O._REACH}, {_RAW} select page_id, cluster_key, idx, url from keyed join raw using (page_id, idx) where url <> '' and contains(url, 'example.com')")
def f9_urls_of_host(spark, sf_dir):
    rows = Q._clusters(spark, sf_dir).filter("cluster_key is not null").join(X.raw_elements(spark, sf_dir).hint("merge"), ["page_id", "idx"])
    return updates.urls_of_host(rows, F.lit("https://www.example.com/list")).select("page_id", "cluster_key", "idx", "url")


@query(f"""with recursive {O._ALL}, {O._REACH}, {_RAW}, e as (select page_id, '{{' || string_agg('"' || cast(idx as varchar) || '":{{"text":"' || p_name || '","node_id":"' || cast(idx as varchar) || '","rect":{{"x":' || x || ',"y":' || y || ',"width":' || width || ',"height":' || height || ',"area":' || area || '}},"tag_name":"' || t || '"}}', ',' order by cast(idx as varchar)) || '}}' as elements from box join raw using (page_id, idx) group by page_id),
    c as (select page_id, '{{' || string_agg('"' || cast(cluster_key as varchar) || '":[' || ids || ']', ',' order by cast(cluster_key as varchar)) || '}}' as clusters from (select page_id, cluster_key, string_agg('"' || cast(idx as varchar) || '"', ',' order by idx) as ids from keyed group by 1, 2) group by page_id)
    select page_id, elements, coalesce(clusters, '{{}}') as clusters from e left join c using (page_id)""")
def k3_element_update(spark, sf_dir):
    """One message a page: its elements by id, and its clusters."""
    rows = X.raw_elements(spark, sf_dir).join(Q._clusters(spark, sf_dir).hint("merge"), ["page_id", "idx"])
    found = updates.element_updates(rows)
    return found.select("page_id", F.to_json("elements_by_id").alias("elements"), F.to_json("clusters").alias("clusters"))


@query(f"""with {O._BEST}, cells as (select g, pos1, pos2, 0 as page_idx, case when pos1 % 3 = 2 then null else pos1 end as pos from best union all select g, pos1, pos2, 1, pos2 from best),
    named as (select *, cast(pos1 as varchar) || '-' || cast(pos2 as varchar) as col_id from cells),
    c as (select g, '{{' || string_agg('"' || col_id || '":[' || ids || ']', ',' order by col_id) || '}}' as column_clusters from (select g, col_id, string_agg(case when pos is null then 'null' else '"' || col_id || '@' || cast(page_idx as varchar) || '"' end, ',' order by page_idx) as ids from named group by 1, 2) group by g),
    d as (select n.g, string_agg(col_id || '@' || cast(n.page_idx as varchar) || ':' || cast(x + 1300 * n.page_idx as varchar) || ':' || cast(y as varchar), '|' order by col_id || '@' || cast(n.page_idx as varchar)) as descs from named n join sib s on s.g = n.g and s.page_idx = n.page_idx and s.pos = n.pos group by n.g)
    select c.g, column_clusters, descs from c join d using (g)""")
def k4_column_update(spark, sf_dir):
    """One message a selection: columns with an id or null for each page, and the elements by id, placed on the canvas."""
    best = Q._best(spark, sf_dir).select("g", F.concat_ws("-", "pos1", "pos2").alias("col_id"), "pos1", F.posexplode(F.array("pos1", "pos2")).alias("page_idx", "pos"))
    cells = best.withColumn("pos", F.when((H("page_idx") == 0) & (H("pos1") % 3 == 2), None).otherwise(H("pos"))).drop("pos1")
    details = X.details(spark, sf_dir).join(X.siblings(spark, sf_dir), "page_id").withColumn("text", html.fragment_text(H("outer_html")))
    found = updates.column_updates(cells.join(details.select("g", "page_idx", "pos", "text", "x", "y", "width", "height"), ["g", "page_idx", "pos"], "left"))
    told = F.transform(F.array_sort(F.map_entries("descs_by_id")), lambda e: F.concat_ws(":", e["key"], e["value"]["rect"]["x"].cast("string"), e["value"]["rect"]["y"].cast("string")))
    return found.select("g", F.to_json("column_clusters").alias("column_clusters"), F.array_join(told, "|").alias("descs"))


@query(f"with {O._ANSWERS} select count(*) as n, count(distinct ans) as kinds from (select * from answers where ans = 's' limit 1000)")
def s12_scan_where(spark, sf_dir):
    """The feature is a scan with equality and a limit; its rows are free, their number isn't."""
    return X.scan_where(Q._answers(spark, sf_dir), 1000, ans="s").agg(F.count("*").alias("n"), F.countDistinct("ans").alias("kinds"))


_SHOWN = """shown as (select cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx, cast((p_partkey*7)%80 - 3 as int) as x, cast((p_partkey*11)%50 as int) as y,
        cast(case when p_partkey%19=0 then 0 else 7+(p_partkey%3)*36 end as int) as w, cast(8+(p_partkey%2)*56 as int) as h, p_partkey % 2 = 0 as img from part),
    crops as (select *, x < 0 or w = 0 as dummy, case when x >= 0 and w > 0 then
        [(7 * (x + cast(floor((q % 50 + 0.5) * w / 50) as int)) + 3 * (y + cast(floor((q // 50 + 0.5) * h / 50) as int)) + page_id) % 16 for q in range(2500)] end as px from shown)"""


@query(f"""with {_SHOWN}, kept as (select *, len([1 for q in range(y, y + h) if q % 5 = 0]) / cast(h as double) as equal_rows from crops)
    select page_id, idx, dummy, case when not dummy then img and w * h > 5000 and equal_rows > 0.05 and equal_rows < 0.31 end as is_photo, md5(array_to_string(px, ',')) as pixels_md5,
        case when not dummy then array_to_string([len(list_filter(px, lambda v: v = b)) for b in range(16)], ',') end as histogram from kept""")
def v1_crops(spark, sf_dir):
    found = visual.crop_elements(X.shown_elements(spark, sf_dir), X.screens(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return found.select("page_id", "idx", "dummy", "is_photo", F.md5(joined("pixels")).alias("pixels_md5"), joined("histogram").alias("histogram"))


@query(None)
def v10_visual_pairs(spark, sf_dir):
    """Every pair of a page's crops: measures of colour and structure, and the verdict of both."""
    crops = visual.crop_elements(X.shown_elements(spark, sf_dir), X.screens(spark, sf_dir))
    return visual.visual_pairs(crops).select("page_id", "i", "j", F.round("summary", 6).alias("summary"), F.round("histogram", 6).alias("histogram"), F.round("structure", 6).alias("structure"), "visually_similar")


_SUM = "list_sum([cast({0} as double) for k in range(1, 65) if (k - 1) // 8 between r and r + 6 and (k - 1) % 8 between c and c + 6])"
_SSIM = f"""windows as (select a_vec_id, b_vec_id, {_SUM.format('p[k]')} / 49 as mx, {_SUM.format('q[k]')} / 49 as my, {_SUM.format('p[k] * p[k]')} / 49 as xx, {_SUM.format('q[k] * q[k]')} / 49 as yy, {_SUM.format('p[k] * q[k]')} / 49 as xy
        from (select a.vec_id as a_vec_id, b.vec_id as b_vec_id, a.p as p, b.p as q from hist a join hist b on a.page_id = b.page_id and a.vec_id < b.vec_id), (values (0, 0), (0, 1), (1, 0), (1, 1)) as t(r, c)),
    structures as (select a_vec_id, b_vec_id, 1 - avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) * 49 / 48 + 58.5225) / ((mx * mx + my * my + 6.5025) * ((xx - mx * mx + yy - my * my) * cast(49 as double) / 48 + 58.5225))) as structure from windows group by 1, 2)"""


def _measured_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = F.lit(8)
    grey = visual.structural_similarity(H("a_pixels"), eight, H("b_pixels"), eight, eight, eight)
    return T._crops(spark, sf_dir).select("a_vec_id", "b_vec_id", visual.compare_summaries(H("a_pixels"), H("b_pixels"), 8).alias("s"), visual.hist_difference(H("a_hist"), H("b_hist")).alias("h"), (1 - grey).alias("structure"), F.abs(H("a_width") - H("b_width")).alias("dw"), F.abs(H("a_height") - H("b_height")).alias("dh"))


@query(f"with {T._CROPS}, {_SSIM} select a_vec_id, b_vec_id, round(structure + 1e-9, 5) as structure from structures")
def v7_structure(spark, sf_dir):
    return _measured_crops(spark, sf_dir).select("a_vec_id", "b_vec_id", F.round(H("structure") + 1e-9, 5).alias("structure"))


@query(f"""with {T._CROPS}, {_SSIM}, m as (select a.a_vec_id, a.b_vec_id, summary as s, histogram as h, structure as t, abs((a.a_vec_id % 7) - (a.b_vec_id % 7)) as dw, abs((a.a_vec_id % 5) - (a.b_vec_id % 5)) as dh from both_crops a join structures using (a_vec_id, b_vec_id)),
    votes as (select *, (3 - (case when s < 0.42 then 1.0 else 0.0 end + case when h < 0.17 then 1.0 when h > 0.9 then -0.5 else 0.0 end + case when t < 0.6 then 1.0 when t > 0.85 then -1.0 when t > 0.75 then -0.6 else 0.0 end)) / 4.5 as answer from m)
    select a_vec_id, b_vec_id, cast(case when a_vec_id % 11 = 0 then 0.5 when a_vec_id % 5 = 0 and b_vec_id % 5 = 0 and dw < 5 and dh < 3 then 0.0 when answer < 0.24 then 0.0 when answer > 0.76 then 1.0 else 0.5 end as double) as vote from votes""")
def v9_visual_vote(spark, sf_dir):
    vote = visual.visual_vote(H("s"), H("h"), H("structure"), H("a_vec_id") % 11 == 0, (H("a_vec_id") % 5 == 0) & (H("b_vec_id") % 5 == 0), H("dw"), H("dh"))
    return _measured_crops(spark, sf_dir).select("a_vec_id", "b_vec_id", vote.alias("vote"))
