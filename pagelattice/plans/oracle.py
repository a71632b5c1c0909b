"""The same queries as SQL for DuckDB, written from the definitions and not from the plans."""

from __future__ import annotations

from pagelattice.functions.text import DATE_PATTERNS

_LINKS = r"""links as (select page_id, url as page_url, cast(i - 1 as int) as idx, x[i] as h from (select page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') as x from pages), unnest(range(1, len(x) + 1)) as t(i))"""
_RECT = """rect as (select cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx, cast((p_partkey%6)*210 as int) as x,
    cast((p_partkey%40)*60 + case when p_partkey%7=0 then 3 else 0 end as int) as y,
    cast(case when p_partkey%17=0 then 0 else 60+((p_partkey*7)%4)*3 + case when p_partkey%5=0 then 80 else 0 end end as int) as width,
    cast(12+(p_partkey%3)*(p_partkey%4) as int) as height from part),
    box as (select *, width*height as area from rect)"""
_VIS = """vis as (select *, css_display <> 'none' and css_visibility = 'visible' and not jquery_is_hidden and driver_is_displayed and spatial_visibility = 'IN_PAGE' as all_visible from (
    select cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx, case p_partkey%5 when 0 then 'none' when 1 then 'inline' else 'block' end as css_display,
    case when p_partkey%9=0 then 'hidden' else 'visible' end as css_visibility, p_partkey%5=0 as jquery_is_hidden, p_partkey%10<>0 as driver_is_displayed,
    case p_partkey%8 when 0 then 'OUTSIDE_PAGE' when 1 then 'IN_PAGE__ZERO_AREA' else 'IN_PAGE' end as spatial_visibility from part))"""
_CSS = """css as (select cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx,
    [case when (k*7+p_partkey)%11=0 then '' else 'v' || cast(p_partkey%(k%3+1) as varchar) end for k in range(134)] as c from part)"""
_FEAT = """feat as (select cast(floor(p_partkey/40) as bigint) as page_id, cast(p_partkey%40 as int) as idx,
    list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['brand___'||p_brand, 'type___'||p_type, 'size___'||cast(p_size%5 as varchar)]))) as f from part)"""
_SAME_PAGE = "a.page_id = b.page_id and a.idx < b.idx"
_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
_TAG = r"lower(regexp_extract({0}, '^\s*<([a-zA-Z0-9]+)', 1))"
_START = r"""lower(regexp_replace(regexp_extract({0}, '^\s*(<[^>]*>)', 1), '(href|src)="[^"]*"', '\1=""', 'g'))"""
_NO_CONTENT = "array_to_string(regexp_extract_all({0}, '<[^>]*>'), '')"
_BARE = "regexp_replace(v, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_FRAGMENTS = f"[{_BARE} for v in regexp_extract_all({{0}}, '>([^<>]+?)<', 1) if {_BARE} <> '']"
_FRAGMENT_TEXT = f"case when len({_FRAGMENTS}) > 0 then replace(replace(array_to_string({_FRAGMENTS}, chr(10)), '&gt;', '>'), '&lt;', '<') end"
_HOST = r"regexp_replace(lower(regexp_extract({0}, '^https?://([^/?#]+)', 1)), '^www\.', '')"
_DATE = "case " + " ".join(f"when regexp_matches({{0}}, '(?i){p}') then '{n}'" for n, p in DATE_PATTERNS) + " else '' end"
_MORE = r"regexp_replace(lower(trim({0})), '\s*(…|»|\.\.\.)$', '') in ('more','read more','learn more','see more','view more','find out more','more info','details','continue reading')"

_C1 = """case when a.width=b.width and a.height=b.height then 0.0 when a.height=b.height and abs(a.width-b.width)<=6 then 0.0
    when a.width=0 or b.width=0 then case when a.width=b.width then 0.0 else 1.0 end when a.height=0 or b.height=0 then case when a.height=b.height then 0.0 else 1.0 end
    when a.area<=1 and b.area<=1 then 0.22 when (a.area<=1 and b.area>1) or (b.area<1 and a.area>1) then 1.0 when a.area<50 and b.area<50 then 0.5
    when greatest(a.area,b.area) > 3*least(a.area,b.area) then 1.0
    when (abs(a.width-b.width)<4 or abs(a.height-b.height)<4) and greatest(a.area,b.area) < 1.5*least(a.area,b.area) then 0.0
    when (abs(a.width-b.width)<4 or abs(a.height-b.height)<4) and greatest(a.area,b.area) < 2*least(a.area,b.area) then 0.28
    when greatest(a.area,b.area) < 1.25*least(a.area,b.area) then 0.5 else 1.0 end"""
_C2 = """least(1.0, (case when (abs(a.width-b.width)<=2.1 or abs(a.height-b.height)<=2.1) and (abs(a.y-b.y)<=2.1 or abs(a.x-b.x)<=2.1) then 0.0
    when (abs(a.width-b.width)<=2.1 or abs(a.height-b.height)<=2.1) or (abs(a.y-b.y)<=2.1 or abs(a.x-b.x)<=2.1) then 0.25 else 0.75 end)
    * (case when (greatest(a.area,b.area)>0.1 and least(a.area,b.area) < 0.6*greatest(a.area,b.area)) or abs(a.area-b.area)>1300 then 1.3 else 1.0 end))"""
_SPREAD = "sqrt(power(least(1300.0, abs(a.x-b.x)), 2) + power(case when abs(a.y-b.y)>800 then least(2500.0, 800.0+(abs(a.y-b.y)-800)/2.0) else abs(a.y-b.y) end, 2))"
_C3A = f"""case when {_SPREAD} < 170 then 0.5 when (a.y<450 and 2400-b.y<450) or (b.y<450 and 2400-a.y<450) then least(1.0, 1.2*least(2817.8, {_SPREAD})/2817.8)
    when abs(a.y-b.y)<1400 and (abs(a.x-b.x)<5 or abs(a.y-b.y)<5) then 0.7*least(2817.8, {_SPREAD})/2817.8 else least(2817.8, {_SPREAD})/2817.8 end"""
_C3C = """case when (a.x<0.01 and a.y<0.01 and (b.x>0.1 or b.y>0.1)) or (b.x<0.01 and b.y<0.01 and (a.x>0.1 or a.y>0.1)) then 0.5 when abs(a.x-b.x)<8 and abs(a.y-b.y)<8 then 0.5
    when abs(a.x-b.x)<4 then case when abs(a.y-b.y)<800 then 0.0 else 0.5 end when abs(a.y-b.y)<4 then case when abs(a.x-b.x)<900 then 0.0 else 0.5 end else 1.0 end"""
_EQ = "len([1 for k in range(1, 135) if {0}[k] = {1}[k]])"
_BLANK = "len([1 for k in range(1, 135) if {0}[k] = '' and {1}[k] = ''])"


def _c4(a: str, b: str) -> str:
    eq, blank = _EQ.format(a, b), _BLANK.format(a, b)
    return f"1.0 - (greatest(-16.0, least(13.0, cast(-(134 - {eq}) + 0.5 * ({eq} - {blank}) as double))) + 16) / 29.0"


_SIGNALS = """[case when a.css_visibility <> b.css_visibility then 1.0 when a.css_visibility <> 'visible' then 0.0 end, case when a.jquery_is_hidden <> b.jquery_is_hidden then 1.0 when a.jquery_is_hidden then 0.0 end,
    case when a.css_display = b.css_display then 0.0 else 1.0 end, case when a.driver_is_displayed <> b.driver_is_displayed then 1.0 when not a.driver_is_displayed then 0.0 end,
    case when a.spatial_visibility = b.spatial_visibility then case when a.spatial_visibility <> 'IN_PAGE' then 0.0 end when a.spatial_visibility = 'IN_PAGE' or b.spatial_visibility = 'IN_PAGE' then 1.0 end]"""
_C8 = f"case when a.all_visible and b.all_visible then 0.5 else coalesce(cast(list_avg({_SIGNALS}) as double), 0.5) end"
_JACCARD = "case when len({0}) + len({1}) = 0 then 0.0 else 1.0 - cast(len(list_intersect({0}, {1})) as double) / len(list_distinct(list_concat({0}, {1}))) end"


def _pairs(views: str, table: str, distance: str) -> str:
    return f"with {views} select a.page_id, a.idx as i, b.idx as j, round(cast({distance} as double), 6) as distance from {table} a join {table} b on {_SAME_PAGE}"


_LINK_DESC = f"""{_LINKS}, parts as (select *, regexp_extract(h, 'href="([^"]*)"', 1) as href from links),
    d as (select page_id, idx, h, page_url, {_TEXT.format("h")} as txt, {_START.format("h")} as st, case when contains(lower(h), '<img') then 'IMG' when contains(lower(h), 'background-image: url(') then 'BACKGROUND_IMG' else '' end as img,
        {_START.format("('<li>' || h || '</li>')")} as pst, case when href = '' or starts_with(href, '#') then '' when starts_with(href, '/') then regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href else href end as url,
        {_HOST.format("page_url")} as page_host from parts)"""

# everything that the flagship's plan measures, and its clusters
_ALL = f"""{_RECT}, {_VIS}, {_CSS}, {_FEAT},
    elem as (select * from box join vis using (page_id, idx) join css using (page_id, idx) join feat using (page_id, idx)),
    measured as (select a.page_id, a.idx as i, b.idx as j, [cast(v as double) for v in [{_C1}, {_C2}, {_C3A}, {_C3C}, {_c4("a.c", "b.c")}, {_C8}, {_JACCARD.format("a.f", "b.f")}]] as d from elem a join elem b on {_SAME_PAGE}),
    dists as (select page_id, i, j, coalesce(list_avg([v for v in d if abs(0.5 - v) > 0.04]), 0.5) as dist from measured)"""
_REACH = """near as (select page_id, i as a, j as b from dists where dist <= 0.407 union all select page_id, j, i from dists where dist <= 0.407),
    reach as (select distinct page_id, a, a as b from near union select r.page_id, r.a, n.b from reach r join near n on n.page_id = r.page_id and n.a = r.b),
    keyed as (select page_id, a as idx, min(b) as cluster_key from reach group by page_id, a)"""

_DETAIL = rf"""found as (select page_id, i - 1 as pos, x[i] as h from (select page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>|<footer\b[^>]*>.*?</footer>') as x from pages), unnest(range(1, len(x) + 1)) as t(i)),
    detail as (select page_id, cast(pos as int) as pos, {_TAG.format("h")} as tag, h, {_NO_CONTENT.format("h")} as nc, {_START.format("h")} as st, cast(round_even((length(h) - length(replace(h, '<', ''))) / 2.0, 0) as int) as num_tags, 40 as x, cast(71 + 60 * pos as int) as y, cast(least(1200, 8 * length({_TEXT.format("h")})) as int) as width, 20 as height
        from found where 71 + 60 * pos > 70 and 71 + 60 * pos < 1700)"""
_SIBLINGS = """placed as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as g from pages),
    five as (select g, page_id, cast(row_number() over (partition by g order by page_id) - 1 as int) as page_idx from placed where g in (select g from placed group by g having count(*) >= 3) qualify page_idx < 5),
    siblings as (select * from five where page_idx < 3)"""


# levenshtein counts bytes there: letters beyond ASCII get one byte each
_WIDE = "éèêëàâáçíîïóôúùûñüöäßÉÈÊËÀÂÁÇÍÎÏÓÔÚÙÛÑÜÖÄ"
_BYTES = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32), *range(35, 38), *range(40, 60)][: len(_WIDE)])


def _edits(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_WIDE}', {_BYTES}), translate({b}, '{_WIDE}', {_BYTES}))"


def _detail_distance(a: str, b: str) -> str:
    return f"""(case when greatest(length({a}.nc), length({b}.nc)) = 0 then 0.0 else {_edits(f'{a}.nc', f'{b}.nc')} / cast(greatest(length({a}.nc), length({b}.nc)) as double) end
        * (case when abs({a}.x-{b}.x) < 10 then case when abs({a}.y-{b}.y) < 40 then 0.85 else 0.95 end else 1.0 end) * (case when abs({a}.height-{b}.height) < 3 then 0.9 else 1.0 end) * (case when {a}.st = {b}.st then 0.9 else 1.1 end))"""


def _detail_pairs(name: str) -> str:
    return f"""{name} as (select a.g, a.pos as pos1, b.pos as pos2, round({_detail_distance('a', 'b')}, 6) as sim
        from sib a join sib b on a.g = b.g and a.tag = b.tag and a.page_idx = 0 and b.page_idx = 1 and a.num_tags <= 8
        and b.x <= a.x + a.width + 50 and b.x + 15 >= greatest(0, a.x - 30) and b.y <= a.y + a.height + 160 and b.y + 15 >= greatest(0, a.y - 160))"""


_SIB = f"{_DETAIL}, {_SIBLINGS}, sib as (select g, page_idx, detail.* from detail join siblings using (page_id))"
_MATCH = f"""{_SIB}, {_detail_pairs("scored")}, matches as (select * from scored where sim < 0.24)"""
_BEST = f"""{_MATCH}, one as (select * from matches qualify row_number() over (partition by g, pos1 order by sim, pos2) = 1),
    two as (select * from matches m where not exists (select 1 from one o where o.g = m.g and o.pos2 = m.pos2) and (g, pos2) in (select (g, pos) from sib where page_idx = 1 and num_tags <= 8) qualify row_number() over (partition by g, pos2 order by sim, pos1) = 1),
    best as (select * from one union all select * from two)"""
_GAPS = f"""{_DETAIL}, at_pos as (select d.page_id, d.pos, instr(p.html, d.h) as p, p.html from detail d join pages p using (page_id)),
    lagged as (select *, lag(p) over (partition by page_id order by pos) as before from at_pos where p > 0),
    gaps as (select page_id, pos, substr(html, before, greatest(0, p - before)) as gap from lagged where before is not null)"""
_EDGES = """u as (select vec_id, [cast(x as double) for x in embedding] as v from embeddings),
    edges as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id < b.vec_id and 1 - list_cosine_similarity(a.v, b.v) <= 0.6),
    both_ways as (select a, b from edges union all select b, a from edges)"""
_HIST = "hist as (select vec_id, cast(floor(vec_id / 50) as bigint) as page_id, [cast(floor(abs(cast(e as double)) * 1500) as int) for e in embedding[1:16]] as h from embeddings)"
_HIST_DIFF = """least(1.0, list_sum([abs(a.h[k] - b.h[k]) for k in range(1, 17)]) / 5000.0 + list_sum([case when a.h[k] > 100 and b.h[k] < 4 then case when a.h[k] > 300 then 0.15 else 0.08 end
    when b.h[k] > 100 and a.h[k] < 4 then case when b.h[k] > 300 then 0.15 else 0.08 end else 0.0 end for k in range(1, 17)]))"""
_EVAL = "ev as (select l_returnflag as name, cast(l_discount as double) * 10 as old, cast(l_tax as double) * 10 as new, l_linenumber from lineitem)"
_ANSWERS = "answers as (select l.doc_id, case when quality = 1 then 's' else 'd' end as ans, cast(n_chars % 100 as double) / cast(100 as double) as sim from labels l join documents d using (doc_id))"
_VERDICT = "case when (ans = 's' and sim < 0.33) or (ans = 'd' and sim > 0.66) then 'correct' when (ans = 's' and sim > 0.66) or (ans = 'd' and sim < 0.33) then 'incorrect' else 'unsure' end"
_SHIFT = "shifted as (select page_id, idx, x - 300 as x, y - 200 as y, width, height from rect)"
_PART = "case when {0} + {1} > 2 then 'OUTSIDE_PAGE_PARTIALLY' else 'OUTSIDE_PAGE' end"
_FREQ = f"{_CSS}, kv as (select page_id, idx, cast(k - 1 as int) as k, c[k] as v from css, unnest(range(1, 135)) as t(k)), freq as (select k, v, count(*) / cast((select count(*) from part) as double) as f from kv group by k, v)"
_CLASS = """[regexp_replace(lower(trim(v)), '\\d+', '__N__', 'g') for v in string_split('Active b2 ' || lang || ' ' || source, ' ') if lower(trim(v)) <> 'active']"""

ORACLE_SQL: dict[str, str] = {
    "s1_links": f"with {_LINKS} select page_id, idx, h as outer_html from links",
    "s7_offline": "select page_id, html is null or contains(html, '502 Bad Gateway') or contains(html, '503 Service Unavailable') or page_id % 50 = 0 as offline from pages",
    "p1_html_derive": rf"with {_LINKS} select page_id, idx, lower(h) as outer_html_l, regexp_replace(regexp_replace(h, '^\s*<[^>]*>', ''), '</[^>]*>\s*$', '') as inner_html, {_TEXT.format('h')} as text, {_NO_CONTENT.format('h')} as no_content, reverse({_NO_CONTENT.format('h')}) as no_content_rev from links",
    "p2_text_is_digit": r"select doc_id, regexp_matches(coalesce(regexp_extract(text, '([^ ]+)$', 1), ''), '^\p{Nd}+$') as is_digit from documents",
    "p3_num_tags": "select page_id, cast(round_even((length(html) - length(replace(html, '<', ''))) / 2.0, 0) as int) as num_tags from pages",
    "p4_text_has_date": f"select doc_id, {_DATE.format('coalesce(text, chr(0))')} as label from documents",
    "p5_img_type": "select page_id, case when contains(lower(html), '<img') then 'IMG' when contains(lower(html), 'background-image: url(') then 'BACKGROUND_IMG' else '' end as img_type from pages",
    "p6_class_attr_str": f"select doc_id, '[''' || array_to_string(list_sort({_CLASS}), ''', ''') || ''']' as class_str from documents",
    "p8_tags_key": "select page_id, array_to_string([lower(v) for v in regexp_extract_all(html, '<([a-zA-Z0-9]+)', 1) if lower(v) <> 'br'], '__') as tags_key from pages",
    "p12_rect_round": f"with {_RECT} select page_id, idx, cast(round_even(x/2.0, 0) as int) as x, cast(round_even(y/2.0, 0) as int) as y, cast(round_even(width/2.0, 0) as int) as width, cast(round_even(height/2.0, 0) as int) as height, cast(round_even(width*height/4.0, 0) as int) as area from rect",
    "p13_spatial_visibility": f"""with {_RECT}, {_SHIFT} select page_id, idx, (case when x >= 0 and y >= 0 then 'IN_PAGE' when x < 0 and x + width <= 0 then 'OUTSIDE_PAGE' when y < 0 and y + height <= 0 then 'OUTSIDE_PAGE'
        when x < 0 then {_PART.format('x', 'width')} else {_PART.format('y', 'height')} end) || case when width = 0 or height = 0 then '__ZERO_AREA' else '' end as spatial_visibility from shifted""",
    "p18_all_visible": f"with {_VIS} select page_id, idx, all_visible from vis",
    "p19_url_derive": rf"select page_id, case when regexp_matches(lower(url), '\.(png|jpe?g|gif|svg|webp)([?#].*)?$') then 'IMAGE' when url = '' then '' else 'WEBPAGE' end as url_type, case when url = '' then '' else {_HOST.format('url')} end as url_host, lower(url) as url_lower from pages",
    "p20_url_flags": r"select page_id, contains(url, 'maps.google') or regexp_matches(url, 'google\.[a-z\.]{2,6}/maps/') as is_google_map, regexp_matches(url, 'eventbrite\.[a-z\.]{2,6}/e/') as is_eventbrite, contains(url, 'event') and not ends_with(rtrim(split_part(url, '?', 1), '/'), 'events') as contains_event from pages",
    "p28_search_bounds": f"with {_RECT}, {_SHIFT} select page_id, idx, greatest(0, x-30) as x1, greatest(0, y-160) as y1, x+width+50 as x2, y+height+160 as y2 from shifted",
    "p29_pair_bounds": f"with {_RECT} select a.page_id, a.idx as i, b.idx as j, greatest(0, least(a.x, b.x)-30) as x1, greatest(0, least(a.y, b.y)-160) as y1, greatest(a.x+a.width, b.x+b.width)+50 as x2, greatest(a.y+a.height, b.y+b.height)+160 as y2 from rect a join rect b on {_SAME_PAGE}",
    "p30_text_fragments": f"with {_LINKS} select page_id, idx, {_FRAGMENT_TEXT.format('h')} as text from links",
    "p31_scale": f"with {_RECT} select page_id, idx, cast(round_even(x*0.25, 0) as int) as x, cast(round_even(y*0.25, 0) as int) as y from rect",
    "p32_outer_key": "select page_id, array_to_string(regexp_extract_all(html, '</?[a-zA-Z0-9]+'), '__') as outer_key from pages",
    "f1_filter_invisible": f"with {_VIS} select page_id, cast(row_number() over (partition by page_id order by idx) - 1 as int) as index, idx as index_original from vis where spatial_visibility = 'IN_PAGE' and not jquery_is_hidden",
    "f2_viewport": f"with {_DETAIL} select page_id, pos, tag, y, width from detail",
    "f5_redundant": rf"""with {_SIB}, texts as (select g || '#' || cast(pos as varchar) as col_id, page_idx, {_FRAGMENT_TEXT.format('h')} as text from sib)
        select * from texts where col_id in (select col_id from texts group by col_id having count(distinct text) > 1 or (count(distinct text) = 1 and bool_or(regexp_matches(text, '\d'))))""",
    "f7_relevant_pairs": f"with {_RECT} select a.page_id, a.idx as i, b.idx as j, cast({_C1} as double) as areas_similar from box a join box b on {_SAME_PAGE} where b.idx = a.idx + 1",
    "f10_triage": "with v as (select l_orderkey, l_linenumber, cast(l_discount * 5 as double) as c, cast(l_tax * 6 as double) as s from lineitem) select l_orderkey, l_linenumber, case when c < 0.25 or (s <> 0 and s < 0.3) then 'similar' when c > 0.33 or (s <> 0 and s > 0.33) then 'different' else 'ambiguous' end as triage from v",
    "c1_areas_similar": _pairs(_RECT, "box", _C1),
    "c2_area_alignment": _pairs(_RECT, "box", _C2),
    "c3a_adjusted_euclidean": _pairs(_RECT, "box", _C3A),
    "c3b_standard_euclidean": _pairs(_RECT, "box", "least(1.0, sqrt(power(a.x-b.x, 2) + power(a.y-b.y, 2)) / 2817.8)"),
    "c3c_spatially_aligned": _pairs(_RECT, "box", _C3C),
    "c4_computed_styles": _pairs(_CSS, "css", _c4("a.c", "b.c")),
    "c4b_styles_jaccard": _pairs(f"{_CSS}, tagged as (select page_id, idx, [cast(k - 1 as varchar) || '=' || c[k] for k in range(1, 135) if c[k] <> ''] as f from css)", "tagged", _JACCARD.format("a.f", "b.f")),
    "c8_visibility": _pairs(_VIS, "vis", _C8),
    "c9_featureset_overlap": _pairs(_FEAT, "feat", _JACCARD.format("a.f", "b.f")),
    "c5a_text": _pairs(_LINK_DESC, "d", rf"""case when a.txt = '' and b.txt = '' then null when a.txt = b.txt then 0.0 when a.txt = '' or b.txt = '' then 1.0 when {_MORE.format('a.txt')} and {_MORE.format('b.txt')} then 0.0 when {_MORE.format('a.txt')} or {_MORE.format('b.txt')} then 1.0
        when regexp_matches(a.txt, '^\p{{Nd}}+$') and regexp_matches(b.txt, '^\p{{Nd}}+$') then case when length(a.txt) = length(b.txt) then 0.0 else 0.15 end
        when {_DATE.format('a.txt')} <> '' and {_DATE.format('b.txt')} <> '' then case when {_DATE.format('a.txt')} = {_DATE.format('b.txt')} then 0.0 else 0.35 end when {_DATE.format('a.txt')} <> '' or {_DATE.format('b.txt')} <> '' then 1.0 end"""),
    "c5b_start_tag": _pairs(_LINK_DESC, "d", "case when a.st = b.st and length(a.st) > 24 then 0.0 when a.pst = b.pst then case when a.st = b.st then 0.0 else 0.25 end end"),
    "c5c_img": _pairs(_LINK_DESC, "d", "case when a.img <> '' or b.img <> '' then case when a.img = b.img then 0.0 else 1.0 end end"),
    "c6_quick_overlap": _pairs(_LINKS, "links", "case when length(a.h) + length(b.h) = 0 then 0.0 else 1.0 - 2.0 * list_sum([least(length(a.h) - length(replace(a.h, c, '')), length(b.h) - length(replace(b.h, c, ''))) for c in list_distinct(string_split(a.h, ''))]) / (length(a.h) + length(b.h)) end"),
    "c10_url_similarity": _pairs(_LINK_DESC, "d", "case when a.url = '' or b.url = '' then case when a.url = b.url then 0.0 else 1.0 end when a.url = b.url then 0.0 else 0.3 end"),
    "c14_detail_similarity": f"with {_SIB}, {_detail_pairs('scored')} select * from scored",
    "w1_match": f"with {_MATCH} select * from matches",
    "w2_top1": f"with {_BEST} select * from best",
    "w3_extend": f"""with {_BEST}, all_pages as (select g, page_idx, detail.* from detail join five using (page_id)),
        boxed as (select *, greatest(0, x - 30) as x1, greatest(0, y - 160) as y1, x + width + 50 as x2, y + height + 160 as y2 from all_pages),
        met as (select p.g, p.pos1, p.pos2, c.page_idx, c.pos, ({_detail_distance('a', 'c')} + {_detail_distance('b', 'c')}) / 2 as v
            from best p join boxed a on a.g = p.g and a.pos = p.pos1 and a.page_idx = 0 join boxed b on b.g = p.g and b.pos = p.pos2 and b.page_idx = 1
            join boxed c on c.g = p.g and c.tag = a.tag and c.page_idx >= 2 and c.num_tags <= 8
                and c.x <= greatest(a.x2, b.x2) and c.x + 15 >= least(a.x1, b.x1) and c.y <= greatest(a.y2, b.y2) and c.y + 15 >= least(a.y1, b.y1))
        select g, pos1, pos2, page_idx, pos, round(v + 1e-9, 4) as avg_sim from met where v < 0.25 qualify row_number() over (partition by g, pos1, pos2, page_idx order by v, pos) = 1""",
    "w5_order": f"""with {_BEST}, cells as (select g, pos1, pos2, 0 as page_idx, pos1 as pos from best union all select g, pos1, pos2, 1, pos2 from best),
        spots as (select c.g, pos1, pos2, avg(case when instr(p.html, h) > 0 then cast(instr(p.html, h) - 1 as double) end) as avg_pos, avg(cast(y as double)) as avg_y, avg(cast(x as double)) as avg_x
            from cells c join sib s on s.g = c.g and s.page_idx = c.page_idx and s.pos = c.pos join pages p using (page_id) group by 1, 2, 3)
        select g, pos1, pos2, cast(row_number() over (partition by g order by avg_pos nulls first, pos1, pos2) as int) as by_pos, cast(row_number() over (partition by g order by avg_y, avg_x, pos1, pos2) as int) as by_corner from spots""",
    "w6_gap_mining": f"with {_GAPS} select page_id, pos, cast(length(gap) as int) as gap_chars, md5(gap) as gap_md5 from gaps",
    "w6_gap_groups": f"with {_GAPS} select array_to_string(regexp_extract_all(gap, '</?[a-zA-Z0-9]+'), '__') as key, count(*) as n, count(distinct page_id) as pages from gaps group by 1",
    "w12_dedup": f"with {_DETAIL}, t as (select {_FRAGMENT_TEXT.format('h')} as text, x, page_id * 100000 + pos as place from detail) select text, x, min(place) as place from t group by text, x",
    "a1_consolidate": "select o_custkey as node_id, max(o_orderstatus) as status, max(case when o_orderkey % 3 = 0 then '' else o_orderpriority end) as priority from orders group by o_custkey",
    "a2_style_frequency": f"with {_FREQ} select k, v, round(f, 6) as frequency from freq",
    "a3_style_weight": f"with {_FREQ} select k, v, round(greatest(1 - f, 0.12), 6) as weight from freq",
    "a5_combine": f"with {_ALL} select page_id, i, j, round(dist, 6) as dist from dists",
    "flagship_clusters": f"with recursive {_ALL}, {_REACH}, sizes as (select page_id, cluster_key, count(*) as size from keyed group by page_id, cluster_key) select *, cast(row_number() over (partition by page_id order by size desc, cluster_key) as int) as cluster_rank from sizes",
    "g4_leftovers": f"with recursive {_ALL}, {_REACH} select page_id, idx from rect where not exists (select 1 from keyed k where k.page_id = rect.page_id and k.idx = rect.idx)",
    "a7_avg_similarity": f"""with recursive {_ALL}, {_REACH}, mirrored as (select page_id, i as idx, j as other, round(dist, 6) as dist from dists union all select page_id, j, i, round(dist, 6) from dists)
        select m.page_id, m.idx, round(avg(dist) + 1e-8, 4) as avg_dist from mirrored m join keyed p on p.page_id = m.page_id and p.idx = m.idx join keyed q on q.page_id = m.page_id and q.idx = m.other where p.cluster_key = q.cluster_key group by m.page_id, m.idx""",
    "g1_url_clusters": f"with {_LINKS}, n as (select page_id, count(*) as n from links group by page_id) select page_id, idx, cast(case when n > 1 then 0 end as int) as cluster_key from links join n using (page_id)",
    "g1_dbscan": f"with recursive {_EDGES}, reach as (select distinct a, a as b from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b) select a as vec_id, min(b) as cluster from reach group by a",
    "g2_dbscan_core": f"""with recursive {_EDGES}, core as (select a as node from both_ways group by a having count(*) + 1 >= 3), inner_edges as (select a, b from both_ways where a in (from core) and b in (from core)),
        reach as (select node as a, node as b from core union select r.a, w.b from reach r join inner_edges w on w.a = r.b), own as (select a as node, min(b) as component from reach group by a),
        border as (select w.a as node, min(o.component) as touch from both_ways w join own o on o.node = w.b group by w.a)
        select vec_id, coalesce(component, touch) as cluster from embeddings left join own on own.node = vec_id left join border on border.node = vec_id""",
    "a13_hash_suffix": f"with {_LINKS}, r as (select page_id, idx, md5(h) as hash, row_number() over (partition by page_id, md5(h) order by idx) as n from links) select page_id, idx, case when n = 1 then hash else hash || '__' || cast(n as varchar) end as name from r",
    "a14_eval_stats": f"with {_EVAL} select name, round(corr(old, new), 6) as corr, round((var_samp(old) + var_samp(new) + 2.0 * covar_samp(old, new)) / 4, 6) as cov, round(1 - avg(case when abs(old - new) > 0.25 then cast(1 as double) else cast(0 as double) end), 6) as score from ev group by name",
    "a15_adjusted_agreement": f"with {_EVAL}, t as (select name, old, least(1.0, new * case when l_linenumber % 2 = 0 then cast(0.85 as double) else cast(1.08 as double) end) as new from ev) select name, round(corr(old, new), 6) as corr, round(avg(abs(old - new)), 6) as mean_error from t group by name",
    "a17_discrepancy": f"with {_EVAL} select name, count(*) as n, count(*) filter (where abs(old - new) > 0.035) as n_discrepant from ev group by name",
    "a16_confusion": f"with {_ANSWERS} select ans, {_VERDICT} as verdict, count(*) as n from answers group by 1, 2",
    "a16b_confident": f"with {_ANSWERS} select doc_id, ans, sim from answers where {_VERDICT} = 'correct'",
    "k10_histogram": f"with {_ALL} select cast(least(29, floor(round(dist, 6) * 30)) as int) as bin, count(*) as n from dists group by 1",
    "k3_element_update": f"with {_LINKS} select page_id, string_agg(cast(idx as varchar) || ':' || {_TAG.format('h')} || ':' || {_TEXT.format('h')}, '|' order by idx) as elements from links group by page_id",
    "v4_hist_difference": f"with {_HIST} select a.vec_id as a_vec_id, b.vec_id as b_vec_id, round(cast({_HIST_DIFF} as double), 6) as difference from hist a join hist b on a.page_id = b.page_id and a.vec_id < b.vec_id",
    "v5_dimensions_factor": f"with {_RECT} select a.page_id, a.idx as i, b.idx as j, cast(case when abs(a.height-b.height) < 3 and abs(a.width-b.width) < 3 then case when a.height = b.height then case when a.width = b.width then 0.9 else 0.93 end else 0.97 end end as double) as factor from box a join box b on {_SAME_PAGE}",
}
