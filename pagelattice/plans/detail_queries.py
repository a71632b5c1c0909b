"""Queries of the operators for text columns, crops, style maps and small table steps, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import distances as D
from pagelattice.functions import html
from pagelattice.operators import columns as W
from pagelattice.operators import describe, visual
from pagelattice.operators import pairs as P
from pagelattice.plans import oracle as O
from pagelattice.session import read_table, spread
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


def _siblings_details(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    return X.details(spark, sf_dir).join(X.siblings(spark, sf_dir, most), "page_id")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "html")


def _sibling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between a field and the next one, on each sibling page."""
    rows = _siblings_details(spark, sf_dir).join(_sources(spark, sf_dir), "page_id").withColumn("at", F.instr(H("html"), H("outer_html"))).filter("at > 0")
    own = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumns({"to": F.lead("at").over(own), "next": F.lead("pos").over(own), "next_y": F.lead("y").over(own)}).filter("next = pos + 1")
    gap = F.trim(F.substr(H("html"), H("at"), F.greatest(F.lit(0), H("to") - H("at"))))
    return rows.select("g", "pos", "page_idx", gap.alias("gap"), F.least("y", "next_y").alias("y_low"), F.greatest("y", "next_y").alias("y_high"))


_GAP_ROWS = f"""{O._SIB}, placed_at as (select s.*, instr(p.html, s.h) as here, p.html from sib s join pages p using (page_id)),
    stepped as (select *, lead(here) over w as there, lead(pos) over w as next_pos, lead(y) over w as next_y from placed_at where here > 0 window w as (partition by page_id order by pos)),
    gap_rows as (select g, pos, page_idx, trim(substr(html, here, greatest(0, there - here)), ' ') as gap, least(y, next_y) as y_low, greatest(y, next_y) as y_high from stepped where next_pos = pos + 1),
    tagged as (select *, regexp_extract_all(gap, '</?[a-zA-Z0-9]+') as tags from gap_rows)"""
_WHOLE = f"""{_GAP_ROWS}, by_key as (select g, pos, tags, count(*) as n, min(page_idx) as first_idx from tagged group by g, pos, tags),
    ranked as (select *, count(*) over (partition by g, pos) as kinds, row_number() over (partition by g, pos order by n desc, first_idx) as r from by_key),
    regular as (select g, pos, tags from ranked where r = 1 and ((kinds = 1 and n > 1) or n > 2)),
    whole as (select t.g, t.pos, page_idx, gap, 'whole' as part from tagged t join regular r on r.g = t.g and r.pos = t.pos and r.tags = t.tags)"""


@query(f"with {_WHOLE} select g, pos, page_idx, part, md5(gap) as gap_md5 from whole")
def w8_split_gaps(spark, sf_dir):
    parts = W.split_gaps(_sibling_gaps(spark, sf_dir), ["g", "pos"])
    return parts.filter("part = 'whole'").select("g", "pos", "page_idx", "part", F.md5("gap").alias("gap_md5"))


@query(None)
def w8_inconsistent_parts(spark, sf_dir):
    return W.split_gaps(_sibling_gaps(spark, sf_dir), ["g", "pos"]).filter("part <> 'whole'").select("g", "pos", "page_idx", "part", F.md5("gap").alias("gap_md5"))


@query(rf"""with {_WHOLE}, bare as (select *, string_split(regexp_replace(regexp_replace(gap, '(?i)</?br/?>', '', 'g'), '(</?[a-zA-Z0-9]+)', chr(1) || '\1', 'g'), chr(1)) as m from whole),
    sized as (select *, len(m) - 1 as n_tags from bare where len(m) > 1),
    even as (select g, pos from sized group by g, pos having count(distinct n_tags) = 1 and max(n_tags) > 1),
    cells as (select g, pos, page_idx, cast(i - 2 as int) as col_index, trim(regexp_extract(m[i], '([^>]*)$', 1), ' ') as text from sized join even using (g, pos), unnest(range(2, len(m))) as t(i))
    select g, pos, col_index, page_idx, text from cells where (g, pos, col_index) in (select (g, pos, col_index) from cells where text <> '')""")
def w7_text_columns(spark, sf_dir):
    parts = W.split_gaps(_sibling_gaps(spark, sf_dir), ["g", "pos"]).filter("part = 'whole'")
    return W.text_columns(parts, ["g", "pos"]).select("g", "pos", "col_index", "page_idx", "text")


@query(None)
def w10_find_columns(spark, sf_dir):
    """All fields of the first five sibling pages of each host."""
    sources = X.siblings(spark, sf_dir, 5).join(_sources(spark, sf_dir), "page_id").select("g", "page_idx", "html")
    texts, lines, words = _spoken(spark, sf_dir)
    return W.find_columns(_siblings_details(spark, sf_dir, 5), sources, lines, words)


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, and lines and words as a recogniser would give them: every second element as a line, all words in a row."""
    rows = X.details(spark, sf_dir).withColumn("text", html.visible_text(H("outer_html")))
    texts = rows.select((H("page_id") * 100_000 + H("pos")).alias("row_id"), "page_id", "text", H("y").alias("y_low"), H("y").alias("y_high"))
    lines = rows.filter("pos % 2 = 0").select("page_id", F.concat("text", F.lit(" x")).alias("text"), "x", "y", (H("x") + H("width")).alias("x2"), (H("y") + 20).alias("y2"))
    words = rows.select("page_id", "y", F.posexplode(F.split("text", " ")).alias("k", "text"))
    return texts, lines, words.select("page_id", "text", (H("k") * 9).alias("x"), "y", (H("k") * 9 + 8).alias("x2"), (H("y") + 20).alias("y2"))


@query(f"""with {O._DETAIL}, told as (select *, page_id * 100000 + pos as row_id, {O._TEXT.format('h')} as txt from detail),
    lines as (select page_id, lower(txt || ' x') as txt, x, y, x + width as x2, y + 20 as y2 from told where pos % 2 = 0),
    words as (select page_id, lower(w[k]) as txt, (k - 1) * 9 as x, y, (k - 1) * 9 + 8 as x2, y + 20 as y2 from (select page_id, y, string_split(txt, ' ') as w from told), unnest(range(1, len(w) + 1)) as t(k)),
    by_line as (select row_id, min(l.x) as x, min(l.y) as y, min(l.x2) as x2, min(l.y2) as y2 from told t join lines l on l.page_id = t.page_id and l.x <= 1300 and l.x2 >= 0 and l.y <= t.y + 30 and l.y2 >= t.y - 30
        and starts_with(l.txt, lower(t.txt)) group by row_id having count(*) = 1),
    by_word as (select row_id, min({{'x': w.x, 'y': w.y}}) as a, max({{'x': w.x2, 'y': w.y2}}) as b from told t join words w on w.page_id = t.page_id and w.x <= 1300 and w.x2 >= 0 and w.y <= t.y + 30 and w.y2 >= t.y - 30
        and list_contains(string_split(lower(t.txt), ' '), w.txt) where row_id not in (select row_id from by_line) group by row_id),
    spoken as (select row_id, x, y, x2, y2 from by_line union all select row_id, a.x, a.y, b.x, b.y from by_word)
    select t.row_id, cast(f.x as bigint) as x, cast(f.y as bigint) as y, cast(f.x2 - f.x as bigint) as width, cast(f.y2 - f.y as bigint) as height from told t left join spoken f using (row_id)""")
def w9_locate_texts(spark, sf_dir):
    found = W.locate_texts(*_spoken(spark, sf_dir))
    return found.select("row_id", *[H(n).cast("long").alias(n) for n in ("x", "y", "width", "height")])


@query(f"with {O._DETAIL} select page_id, pos, cast(case when pos % 3 = 0 then 100 + pos else width end as int) as width from detail")
def w4_fix_widths(spark, sf_dir):
    rows = X.details(spark, sf_dir).select("page_id", "pos", "width")
    twice = rows.filter("pos % 3 = 1").select("page_id", "pos", F.lit(7).alias("width"))
    found = rows.filter("pos % 3 = 0").select("page_id", "pos", (H("pos") + 100).alias("width")).unionByName(twice).unionByName(twice)
    return W.fix_widths(rows, found, ["page_id", "pos"]).select("page_id", "pos", "width")


@query(f"""with {O._SIB} select g || '#' || cast(pos as varchar) as col_id, round(avg(case when instr(p.html, h) > 0 then cast(instr(p.html, h) - 1 as double) end) + 1e-9, 4) as avg_pos,
    round(avg(cast(x as double)), 4) as avg_x, round(avg(cast(y as double)), 4) as avg_y, min(x) as min_x, max(x + width) as max_x from sib join pages p using (page_id) group by 1""")
def a9_column_positions(spark, sf_dir):
    rows = _siblings_details(spark, sf_dir).join(_sources(spark, sf_dir), "page_id").withColumn("col_id", F.concat_ws("#", "g", "pos"))
    return W.positions(rows).withColumns({"avg_pos": F.round(H("avg_pos") + 1e-9, 4), "avg_x": F.round("avg_x", 4), "avg_y": F.round("avg_y", 4)})


@query(O._pairs(O._CSS, "css", O._c4("a.c", "b.c")))
def c4c_style_maps(spark, sf_dir):
    rows = X.elements(spark, sf_dir, X.STYLES).select("page_id", "idx", F.transform("css_array", lambda v: F.when(v != "", v)).alias("css_array"))
    return P.measured(P.pairs_within(D.with_ids(rows, missing=True).drop("css_array")), {"distance": D.compare_style_map_ids}).withColumn("distance", F.round("distance", 6))


_POINT = """case when p.v = '' and q.v = '' then null when p.v = q.v then least(0.44, p.w / 2) when p.v <> '' and q.v <> '' then case when p.w < 0.12 and q.w < 0.12 then 0.75 when p.w < 0.12 and q.w > 0.75 then 1.0 else 0.6 end
    else case when (case when p.v <> '' then p.w else q.w end) < 0.1 then 0.6 when (case when p.v <> '' then p.w else q.w end) < 0.3 then 0.7 else 0.8 end end"""


@query(f"""with {O._FREQ}, weighed as (select kv.page_id, kv.idx, kv.k, kv.v, greatest(1 - f, 0.12) as w from kv join freq using (k, v))
    select p.page_id, p.idx as i, q.idx as j, round(avg(cast({_POINT} as double)), 6) as distance from weighed p join weighed q on p.page_id = q.page_id and p.idx < q.idx and p.k = q.k group by 1, 2, 3""")
def c4d_weighted_styles(spark, sf_dir):
    """Weights come to the elements before pairs are made."""
    rows = X.elements(spark, sf_dir, X.STYLES)
    weights = describe.style_weight(rows.select("page_id", "idx", F.posexplode("css_array").alias("k", "v")), X.elements(spark, sf_dir, X.RECT))
    return P.measured(P.pairs_within(describe.weighed_styles(rows, weights)), {"distance": D.compare_weighted_styles}).withColumn("distance", F.round("distance", 6))


@query(None)
def c5_compare_content(spark, sf_dir):
    return P.measured(P.pairs_within(X.described_links(X.links(spark, sf_dir))), {"distance": D.compare_content}).withColumn("distance", F.round("distance", 6))


@query(O._pairs(f"{O._RECT}, {O._VIS}, shown as (select * from box join vis using (page_id, idx))", "shown", f"case when not a.driver_is_displayed or not b.driver_is_displayed then 0.5 else {O._C1} end"))
def c12_where_displayed(spark, sf_dir):
    rows = X.elements(spark, sf_dir, X.RECT, X.VISIBILITY)
    return P.measured(P.pairs_within(rows), {"distance": lambda a, b: D.where_displayed(a, b, D.areas_similar(a, b))}).withColumn("distance", F.round("distance", 6))


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors as if they were crops of 8 x 8 palette indices."""
    rows = spread(read_table(spark, sf_dir, "embeddings").withColumn("page_id", (H("vec_id") / 50).cast("long")), "page_id").select(
        "vec_id", "page_id", F.expr("transform(embedding, e -> cast(floor(abs(cast(e as double)) * 20D) as int))").alias("pixels"),
        F.expr("transform(slice(embedding,1,16), e -> cast(floor(abs(cast(e as double))*1500D) as int))").alias("hist"), (H("vec_id") % 7 + 20).alias("width"), (H("vec_id") % 5 + 20).alias("height"),
    )
    return P.pairs_within(rows.withColumn("area", H("width") * H("height")), order="vec_id")


_UNEQUAL = "len([1 for k in range(1, {2} + 1) if {0} <> {1}]) / cast({2} as double)"
_SUMMARY = f"0.5 * {_UNEQUAL.format('a.p[k]', 'b.p[k]', 64)} + 0.25 * {_UNEQUAL.format('a.p[k + 8]', 'b.p[k]', 56)} + 0.25 * {_UNEQUAL.format('a.p[k]', 'b.p[k + 8]', 56)}"
_FACTOR = "case when abs(a.height-b.height) < 3 and abs(a.width-b.width) < 3 then case when a.height = b.height then case when a.width = b.width then 0.9 else 0.93 end else 0.97 end else 1.0 end"
_CROPS = f"""hist as (select vec_id, cast(floor(vec_id / 50) as bigint) as page_id, [cast(floor(abs(cast(e as double)) * 20) as int) for e in embedding] as p, [cast(floor(abs(cast(e as double)) * 1500) as int) for e in embedding[1:16]] as h,
        vec_id % 7 + 20 as width, vec_id % 5 + 20 as height, (vec_id % 7 + 20) * (vec_id % 5 + 20) as area from embeddings),
    both_crops as (select a.vec_id as a_vec_id, b.vec_id as b_vec_id, cast({_SUMMARY} as double) as summary, cast({O._HIST_DIFF} as double) as histogram, cast({_FACTOR} as double) as factor,
        list_sum([(cast(a.p[k] as double) - b.p[k]) * (a.p[k] - b.p[k]) for k in range(1, 65)]) / 64 as mse,
        ((abs(a.width-b.width) < 5 and abs(a.height-b.height) < 11) or (abs(a.height-b.height) < 5 and abs(a.width-b.width) < 11) or (a.width = b.width and abs(a.height-b.height) < 17) or (a.height = b.height and abs(a.width-b.width) < 17)) as comparable
        from hist a join hist b on a.page_id = b.page_id and a.vec_id < b.vec_id),
    coloured as (select *, least(1.0, (histogram + summary) / 2 * factor) as colours from both_crops)"""


def _colours() -> Column:
    factor = visual.dimensions_factor(H("a_width"), H("a_height"), H("b_width"), H("b_height"))
    return visual.compare_colours(visual.hist_difference(H("a_hist"), H("b_hist")), visual.compare_summaries(H("a_pixels"), H("b_pixels"), 8), factor, H("a_area"), H("b_area"))


@query(f"with {_CROPS} select a_vec_id, b_vec_id, round(summary, 6) as summary from coloured")
def v3_compare_summaries(spark, sf_dir):
    return _crops(spark, sf_dir).select("a_vec_id", "b_vec_id", F.round(visual.compare_summaries(H("a_pixels"), H("b_pixels"), 8), 6).alias("summary"))


@query(f"with {_CROPS} select a_vec_id, b_vec_id, round(colours + 1e-9, 6) as colours from coloured")
def v6_compare_colours(spark, sf_dir):
    return _crops(spark, sf_dir).select("a_vec_id", "b_vec_id", F.round(_colours() + 1e-9, 6).alias("colours"))


@query(f"with {_CROPS} select a_vec_id, b_vec_id, comparable from coloured")
def v7_sizes_comparable(spark, sf_dir):
    return _crops(spark, sf_dir).select("a_vec_id", "b_vec_id", visual.sizes_comparable(H("a_width"), H("a_height"), H("b_width"), H("b_height")).alias("comparable"))


@query(f"""with {_CROPS}, t as (select *, case when a_vec_id % 2 = 0 then cast((a_vec_id + b_vec_id) % 11 as double) / 10 end as s, round(colours + 1e-9, 6) as c from coloured)
    select a_vec_id, b_vec_id, cast(case when c < 0.25 then 0 when s is not null then case when s < 0.27 or (abs(s - c) < 0.12 and (s + c) / 2 < 0.5) then 0 when s < 0.35 and c > 0.5 then 0.5 when s < 0.3 and c < 0.5 then 0 when s > 0.7 then 1 else 0.5 end
        when c < 0.4 then 0.25 when c < 0.6 then 0.5 else 1 end as double) as verdict from t""")
def v8_visual_cascade(spark, sf_dir):
    structure = F.when(H("a_vec_id") % 2 == 0, ((H("a_vec_id") + H("b_vec_id")) % 11).cast("double") / 10)
    return _crops(spark, sf_dir).select("a_vec_id", "b_vec_id", visual.visual_cascade(F.round(_colours() + 1e-9, 6), structure).alias("verdict"))


@query(f"with {_CROPS} select a_vec_id, b_vec_id, round(mse, 6) as mse from coloured")
def v12_mean_squared_error(spark, sf_dir):
    return _crops(spark, sf_dir).select("a_vec_id", "b_vec_id", F.round(visual.mean_squared_error(H("a_pixels"), H("b_pixels")), 6).alias("mse"))


@query(f"with {O._LINKS} select page_id, idx from links where idx % 3 <> 0")
def s3_new_elements(spark, sf_dir):
    found = X.links(spark, sf_dir).withColumn("node_id", F.concat_ws("-", "page_id", "idx"))
    return describe.new_elements(found, found.filter("idx % 3 = 0")).select("page_id", "idx")


@query(f"with {O._VIS} select page_id, idx, lower(css_visibility) as css_visibility, lower(css_display) as css_display, jquery_is_hidden, jquery_is_hidden is false or driver_is_displayed as driver_is_displayed from vis")
def p14_css_projection(spark, sf_dir):
    """Whether the browser shows an element matters only where it is hidden."""
    return X.elements(spark, sf_dir, X.VISIBILITY).select("page_id", "idx", F.lower("css_visibility").alias("css_visibility"), F.lower("css_display").alias("css_display"), "jquery_is_hidden", F.when(H("jquery_is_hidden"), H("driver_is_displayed")).otherwise(True).alias("driver_is_displayed"))


@query(f"with {O._SIB}, urls as (select g, url, row_number() over (partition by g order by pages.page_id) as r from placed join pages using (page_id) where url <> '') select g, count(*) as n, count(*) < 2 as failed from urls where r <= 3 group by g")
def k6_too_few_urls(spark, sf_dir):
    """The first three URLs of a selection; fewer than two are an error."""
    rows = read_table(spark, sf_dir, "pages").filter("url <> ''").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("g"), "page_id")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("page_id"))).filter("r <= 3")
    return first.groupBy("g").agg(F.count("*").alias("n"), (F.count("*") < 2).alias("failed"))
