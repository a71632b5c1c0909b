"""Queries of sources, reports, canvas, orders and the older measures, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import distances as D
from pagelattice.functions.html import DETAIL_TAGS
from pagelattice.operators import affinity, describe, evaluate, updates, visual
from pagelattice.operators import pairs as P
from pagelattice.plans import element_queries as E
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


@query(f"select page_id, {O._HOST.format('url')} as page_url_host, regexp_extract(url, '^(https?://[^/?#]+)', 1) as page_host_base, 2400 as page_height, true as quick from pages")
def s2_context(spark, sf_dir):
    return X.contexts(read_table(spark, sf_dir, "pages"))


@query(f"with {O._RECT}, {O._VIS}, {E._RAW} select page_id, idx, xpath, case when idx % 3 = 0 then null else x end as x, css_display, driver_is_displayed, t as tag_name from raw join rect using (page_id, idx) join vis using (page_id, idx)")
def s5_four_feeds(spark, sf_dir):
    """HTML, paths, rectangles (of some, some twice) and styles by element, in any order."""
    rows = X.raw_elements(spark, sf_dir)
    keys = ["page_id", "idx"]
    some = rows.filter("idx % 3 <> 0").select(*keys, "x")
    feeds = [rows.select(*keys, "tag_name", F.lit("").alias("css_display")), rows.select(*keys, "xpath"), some, some.filter("idx % 2 = 0"), rows.select(*keys, "css_display", "driver_is_displayed")]
    return describe.consolidate(feeds, keys)


_SCANNED = " union all ".join(rf"select page_id, {k} as place, x[i] as h, i, html, '{t}' as tag from (select page_id, html, regexp_extract_all(html, '(?is)<{t}\b[^>]*>.*?</{t}>') as x from pages), unnest(range(1, len(x) + 1)) as u(i)" for k, t in enumerate(DETAIL_TAGS))


@query(rf"""with scanned as ({_SCANNED}), told as (select *, length(h) - length(replace(h, '<', '')) as n from scanned),
    kept as (select *, row_number() over (partition by page_id order by place, i) - 1 as pos from told where n <= 12)
    select page_id, cast(pos as int) as pos, tag, md5(h) as outer_md5, case when n < 3 then md5([v for v in regexp_extract_all(html, '(?is)<ul\b[^>]*>.*?</ul>|<nav\b[^>]*>.*?</nav>|<section\b[^>]*>.*?</section>') if contains(v, h) and v <> h][1]) end as parent_md5 from kept""")
def s6_detail_scan(spark, sf_dir):
    found = X.scan_details(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "pos", "tag", F.md5("outer_html").alias("outer_md5"), F.md5("parent_outer_html").alias("parent_md5"))


@query(f"with {O._SIB} select page_id, pos, cast(round_even((x + 1300 * page_idx) * 0.5, 0) as int) as x, cast(round_even(y * 0.5, 0) as int) as y, cast(round_even(width * 0.5, 0) as int) as width, cast(round_even(least(height, 1400 - y) * 0.5, 0) as int) as height from sib where y < 1400")
def k7_canvas(spark, sf_dir):
    """Elements on the canvas of their siblings, at half its size; what lies below its crop goes."""
    rows = X.details(spark, sf_dir).join(X.siblings(spark, sf_dir), "page_id")
    return updates.on_canvas(rows, 0.5).select("page_id", "pos", "x", "y", "width", "height")


@query("""with v as (select l_orderkey, l_linenumber, cast(l_discount * 5 as double) as c, case when l_linenumber % 3 > 0 then cast(l_tax * 6 as double) end as s from lineitem),
    t as (select *, case when c < 0.25 or (s <> 0 and s < 0.3) then 'similar' when c > 0.33 or (s <> 0 and s > 0.33) then 'different' else 'ambiguous' end as triage from v)
    select l_orderkey, l_linenumber, triage, cast(row_number() over (partition by triage order by c, s is not null, l_orderkey, l_linenumber) as int) as place from t""")
def k9_pair_report(spark, sf_dir):
    """Pairs by their triage, in the order of their colours, those without a structure first."""
    structure = F.when(H("l_linenumber") % 3 > 0, (H("l_tax") * 6).cast("double"))
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (H("l_discount") * 5).cast("double").alias("colour"), structure.alias("structure"))
    return evaluate.pair_report(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "triage", H("place").cast("int").alias("place"))


@query(f"with recursive {O._ALL}, {O._REACH} select page_id, cluster_key, idx, cast(row_number() over (partition by page_id, cluster_key order by area desc, idx) as int) as place from keyed join box using (page_id, idx)")
def a6_sorted_members(spark, sf_dir):
    rows = Q._clusters(spark, sf_dir).filter("cluster_key is not null").join(X.elements(spark, sf_dir, X.RECT).hint("merge"), ["page_id", "idx"])
    return updates.sorted_members(rows, F.desc("area"), H("idx")).select("page_id", "cluster_key", "idx", "place")


@query("select case l_returnflag when 'A' then 'areas_similar' when 'N' then 'spatially_aligned' else l_returnflag end as name, count(*) as n from lineitem group by 1")
def a14_renamed(spark, sf_dir):
    """Old function names looked up by their new ones; a name that isn't there stays."""
    rows = read_table(spark, sf_dir, "lineitem").select(H("l_returnflag").alias("name"))
    return evaluate.renamed(rows, {"A": "areas_similar", "N": "spatially_aligned"}).groupBy("name").agg(F.count("*").alias("n"))


@query(O._pairs(O._LINKS, "links", "case when a.idx % 3 = 0 and b.idx % 3 = 0 then 0.0 when a.idx % 3 = 0 or b.idx % 3 = 0 then 1.0 else 0.5 end"))
def c11_navigation(spark, sf_dir):
    """Navigation links come as a table of ids."""
    found = X.links(spark, sf_dir)
    nav = found.filter("idx % 3 = 0").select("page_id", "idx")
    rows = describe.with_navigation(found.select("page_id", "idx"), nav.union(nav))
    return P.measured(P.pairs_within(rows), {"distance": D.compare_navigation}).withColumn("distance", F.round("distance", 6))


_MISS = "case when greatest(a.h[k], b.h[k]) / cast(case when least(a.h[k], b.h[k]) = 0 then 0.1 else least(a.h[k], b.h[k]) end as double) > 3.6 then 0.6 when abs(a.h[k] - b.h[k]) > 850 then 1.0 when greatest(a.h[k], b.h[k]) > 180 and least(a.h[k], b.h[k]) < 22 then 1.0 else 0.0 end"


@query(f"""with {O._HIST}, m as (select a.vec_id as a_vec_id, b.vec_id as b_vec_id, round(list_sum([cast({_MISS} as double) for k in range(1, 11)]), 6) as n from hist a join hist b on a.page_id = b.page_id and a.vec_id < b.vec_id)
    select a_vec_id, b_vec_id, cast(case when n > 3.85 then 1.5 when n > 2.2 then 1.25 when n < 0.6 then 0.48 when n < 1.3 then 0.6 end as double) as factor from m""")
def v13_misses_factor(spark, sf_dir):
    return Q._hist_pairs(spark, sf_dir).select("a_vec_id", "b_vec_id", visual.misses_factor(H("a_hist"), H("b_hist")).alias("factor"))


@query(f"""with {E._SHOWN}, c as (select page_id, idx, (7 * (x + w // 2) + 3 * (y + h // 2) + page_id) % 16 as i from shown where x >= 0 and w > 0)
    select page_id, idx, cast(i as int) as colour, concat_ws(',', (i * 15) % 240, (i * 15 + 5) % 240, (i * 15 + 10) % 240) as rgb from c""")
def v14_pixels(spark, sf_dir):
    """The colour of each element's middle: its index, and what the palette holds there."""
    rows = X.shown_elements(spark, sf_dir).filter("x >= 0 and width > 0").join(X.screens(spark, sf_dir).withColumnRenamed("width", "wide").hint("merge"), "page_id")
    middle = [(H(a) + F.floor(H(b) / 2)).cast("int") for a, b in (("x", "width"), ("y", "height"))]
    colour = visual.pixel_index(H("indices"), H("wide"), *middle)
    return rows.select("page_id", "idx", colour.alias("colour"), F.array_join(F.transform(visual.palette_colour(H("palette"), colour), lambda v: v.cast("string")), ",").alias("rgb"))


@query(None)
def g3_affinity_propagation(spark, sf_dir):
    """Exemplars of each page's elements by message passing over the negative distances."""
    return affinity.propagated(Q._distances(spark, sf_dir).select("page_id", "i", "j", D.combined(*[H(n) for n in Q.NAMES]).alias("dist")))


@query(f"""with {O._RECT}, {O._VIS}, {E._RAW}, told2 as (select n.*, {E._START_TAG} as st from named n)
    select page_id, idx, t as tag_name, p_name as text, st as start_tag, tag_class as tag_class_str, suffix as xpath_suffix, 1 as num_tags, case when t = 'div' then '' else kind end as url_type, width * height as area, all_visible, '' as img_type
    from told2 join rect using (page_id, idx) join vis using (page_id, idx)""")
def p34_element_assembly(spark, sf_dir):
    """One description an element out of all its derived parts."""
    return X.raw_elements(spark, sf_dir).select("page_id", "idx", "tag_name", "text", "start_tag", "tag_class_str", "xpath_suffix", "num_tags", "url_type", "area", "all_visible", "img_type")
