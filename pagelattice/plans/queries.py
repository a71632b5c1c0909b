"""One query for each operator over tables of the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import distances as D
from pagelattice.functions import html, layout, text, urls
from pagelattice.operators import columns as W
from pagelattice.operators import describe, evaluate, visual
from pagelattice.operators import pairs as P
from pagelattice.operators.components import connected_components
from pagelattice.session import cut, read_table, spread
from pagelattice.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NAMES = list(D.REGISTRY)
VECTOR_EPS = 0.6
#: Blocks of vectors that meet each other for the sake of many tasks, and the vectors of a block once there are more.
MOST_BLOCKS, BLOCK_ROWS = 20, 16_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _links(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return X.links(spark, sf_dir).select("page_id", "idx", *[c.alias(n) for n, c in columns.items()])


H = F.col


def _scalar(name: str, source: Callable[[SparkSession, str], DataFrame], keys: list[str], make: Callable[[], dict[str, Column]]) -> None:
    """Registers a query that derives columns row by row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select(*keys, *[c.alias(n) for n, c in make().items()])

    run.__name__ = name
    QUERIES[name] = run


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.elements(spark, sf_dir, X.RECT)


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rects(spark, sf_dir).withColumns({"x": H("x") - 300, "y": H("y") - 200})


_LINK = ["page_id", "idx"]
_scalar("s1_links", X.links, _LINK, lambda: {"outer_html": H("outer_html")})
_scalar("s7_offline", _pages, ["page_id"], lambda: {"offline": html.is_offline(H("html"), F.when(H("page_id") % 50 == 0, 503).otherwise(200))})
_scalar("p1_html_derive", X.links, _LINK, lambda: {"outer_html_l": F.lower("outer_html"), "inner_html": html.inner_html(H("outer_html")), "text": html.visible_text(H("outer_html")), "no_content": html.no_content(H("outer_html")), "no_content_rev": F.reverse(html.no_content(H("outer_html")))})
_scalar("p2_text_is_digit", _docs, ["doc_id"], lambda: {"is_digit": text.text_is_digit(F.coalesce(F.regexp_extract("text", r"([^ ]+)$", 1), F.lit("")))})
_scalar("p3_num_tags", _pages, ["page_id"], lambda: {"num_tags": html.num_tags(H("html"))})
_scalar("p4_text_has_date", _docs, ["doc_id"], lambda: {"label": text.text_has_date(F.coalesce("text", F.lit("")))})
_scalar("p5_img_type", _pages, ["page_id"], lambda: {"img_type": html.img_type(F.lower("html"))})
_scalar("p6_class_attr_str", _docs, ["doc_id"], lambda: {"class_str": html.class_attr_str(F.concat(F.lit('<a class="Active b2 '), H("lang"), F.lit(" "), H("source"), F.lit('">')))})
_scalar("p8_tags_key", _pages, ["page_id"], lambda: {"tags_key": html.tags_key(H("html"))})
_scalar("p12_rect_round", _rects, _LINK, lambda: {n: layout.rounded_rect(H("x") / 2, H("y") / 2, H("width") / 2, H("height") / 2)[n] for n in ("x", "y", "width", "height", "area")})
_scalar("p13_spatial_visibility", _shifted, _LINK, lambda: {"spatial_visibility": layout.spatial_visibility(H("x"), H("y"), H("width"), H("height"))})
_scalar("p18_all_visible", lambda s, d: X.elements(s, d, X.VISIBILITY), _LINK, lambda: {"all_visible": layout.all_visible()})
_scalar("p19_url_derive", _pages, ["page_id"], lambda: {n: urls.described(H("url"))[n] for n in ("url_type", "url_host", "url_lower")})
_scalar("p20_url_flags", _pages, ["page_id"], lambda: {"is_google_map": urls.is_google_map(H("url")), "is_eventbrite": urls.is_eventbrite(H("url")), "contains_event": urls.contains_event(H("url"))})
_scalar("p28_search_bounds", _shifted, _LINK, lambda: layout.search_bounds(H("x"), H("y"), H("width"), H("height")))
_scalar("p30_text_fragments", X.links, _LINK, lambda: {"text": html.fragment_text(H("outer_html"))})
_scalar("p31_scale", _rects, _LINK, lambda: {"x": layout.scaled(H("x"), 0.25), "y": layout.scaled(H("y"), 0.25)})
_scalar("p32_outer_key", _pages, ["page_id"], lambda: {"outer_key": html.outer_key(H("html"))})


@query
def p29_pair_bounds(spark, sf_dir):
    boxes = _rects(spark, sf_dir).select("page_id", "idx", *[c.alias(n) for n, c in layout.search_bounds(H("x"), H("y"), H("width"), H("height")).items()])
    return P.pairs_within(boxes).select(H("a_page_id").alias("page_id"), H("a_idx").alias("i"), H("b_idx").alias("j"), *[c.alias(n) for n, c in layout.pair_bounds("a_", "b_").items()])


@query
def f1_filter_invisible(spark, sf_dir):
    return describe.filter_invisible(X.elements(spark, sf_dir, X.VISIBILITY)).select("page_id", "index", "index_original")


@query
def f2_viewport(spark, sf_dir):
    return X.details(spark, sf_dir).select("page_id", "pos", "tag", "y", "width")


@query
def f5_redundant(spark, sf_dir):
    rows = X.details(spark, sf_dir).join(X.siblings(spark, sf_dir), "page_id").select("page_idx", F.concat_ws("#", "g", "pos").alias("col_id"), html.fragment_text(H("outer_html")).alias("text"))
    return W.drop_redundant(rows)


@query
def f7_relevant_pairs(spark, sf_dir):
    pairs = P.measured(P.pairs_within(_rects(spark, sf_dir)), {"areas_similar": D.areas_similar})
    rows = _rects(spark, sf_dir)
    chosen = rows.select("page_id", (H("idx") + 1).alias("i"), H("idx").alias("j"))
    return P.relevant(pairs, chosen)


@query
def f10_triage(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluate.triage((H("l_discount") * 5).cast("double"), (H("l_tax") * 6).cast("double")).alias("triage"))


def _distance(name: str, groups: tuple, f: Callable[[str, str], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.measured(P.pairs_within(D.with_ids(X.elements(spark, sf_dir, *groups))), {"distance": f}).withColumn("distance", F.round("distance", 6))

    run.__name__ = name
    QUERIES[name] = run


_distance("c1_areas_similar", (X.RECT,), D.areas_similar)
_distance("c2_area_alignment", (X.RECT,), D.area_alignment_simple)
_distance("c3a_adjusted_euclidean", (X.RECT,), D.adjusted_euclidean_distance)
_distance("c3b_standard_euclidean", (X.RECT,), D.standard_euclidean_distance)
_distance("c3c_spatially_aligned", (X.RECT,), D.spatially_aligned)
_distance("c4_computed_styles", (X.STYLES,), D.compare_computed_styles)
_distance("c8_visibility", (X.VISIBILITY,), D.compare_visibility)
_distance("c9_featureset_overlap", (X.FEATURES,), D.featureset_overlap)


@query
def c4b_styles_jaccard(spark, sf_dir):
    rows = D.with_ids(X.elements(spark, sf_dir, X.STYLES)).select("page_id", "idx", "css_ids")
    return P.measured(P.pairs_within(rows), {"distance": D.compare_computed_styles_jaccard}).withColumn("distance", F.round("distance", 6))


def _link_distance(name: str, f: Callable[[str, str], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = X.described_links(X.links(spark, sf_dir))
        return P.measured(P.pairs_within(found), {"distance": f}).withColumn("distance", F.round("distance", 6))

    run.__name__ = name
    QUERIES[name] = run


_link_distance("c5a_text", D.compare_text)
_link_distance("c5b_start_tag", D.compare_start_tag)
_link_distance("c5c_img", D.compare_img)
_link_distance("c6_quick_overlap", lambda a, b: text.quick_distance(H(f"{a}outer_html"), H(f"{b}outer_html")))
_link_distance("c10_url_similarity", lambda a, b: D.url_similarity(a, b, H(f"{a}page_host")))


@query
def c7_string_distance(spark, sf_dir):
    """Gestalt distance of links' HTML; distinct strings alone reach Python."""
    pairs = P.pairs_within(X.links(spark, sf_dir)).select(H("a_outer_html").alias("a"), H("b_outer_html").alias("b")).distinct()
    forward = pairs.select("a", "b", (1 - text.gestalt_percent("a", "b") / 100).alias("forward"), (1 - text.gestalt_percent(F.reverse("a"), F.reverse("b")) / 100).alias("backward"))
    return forward.select("a", "b", F.round(text.blended_distance(H("forward"), H("backward"), text.simple_distance(H("a"), H("b")), False), 6).alias("distance"))


def _sibling(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return X.details(spark, sf_dir).join(X.siblings(spark, sf_dir).filter(H("page_idx") == n).select("page_id", "g"), "page_id").drop("page_id")


@query
def c14_detail_similarity(spark, sf_dir):
    return W.match(_sibling(spark, sf_dir, 0), _sibling(spark, sf_dir, 1), 100.0).withColumn("sim", F.round("sim", 6))


@query
def w1_match(spark, sf_dir):
    return W.match(_sibling(spark, sf_dir, 0), _sibling(spark, sf_dir, 1)).withColumn("sim", F.round("sim", 6))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_matches(w1_match(spark, sf_dir), _sibling(spark, sf_dir, 1))


@query
def w2_top1(spark, sf_dir):
    return _best(spark, sf_dir)


@query
def w3_extend(spark, sf_dir):
    """Each match's best element of the third to fifth page."""
    pages = X.details(spark, sf_dir).join(X.siblings(spark, sf_dir, 5), "page_id").drop("page_id")
    found = W.extend(_best(spark, sf_dir), _sibling(spark, sf_dir, 0), _sibling(spark, sf_dir, 1), pages.filter("page_idx >= 2"))
    return found.withColumn("avg_sim", F.round(F.col("avg_sim") + F.lit(1e-9), 4))


@query
def w5_order(spark, sf_dir):
    """Matches by their mean place in the sources, and by their mean corner."""
    best = _best(spark, sf_dir).select("g", "pos1", "pos2", F.posexplode(F.array("pos1", "pos2")).alias("page_idx", "pos"))
    cells = best.join(X.details(spark, sf_dir).join(X.siblings(spark, sf_dir), "page_id"), ["g", "page_idx", "pos"]).join(read_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    placed = W.positions(cells.withColumn("col_id", F.concat_ws("-", "g", "pos1", "pos2"))).join(best.select("g", "pos1", "pos2").distinct().withColumn("col_id", F.concat_ws("-", "g", "pos1", "pos2")), "col_id")
    rank = lambda *by: F.row_number().over(Window.partitionBy("g").orderBy(*by, "pos1", "pos2"))
    return placed.select("g", "pos1", "pos2", rank("avg_pos").alias("by_pos"), rank("avg_y", "avg_x").alias("by_corner"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_gaps(X.details(spark, sf_dir).select("page_id", "pos", "outer_html"), read_table(spark, sf_dir, "pages").select("page_id", "html"))


@query
def w6_gap_mining(spark, sf_dir):
    return _gaps(spark, sf_dir).select("page_id", "pos", F.length("gap").alias("gap_chars"), F.md5("gap").alias("gap_md5"))


@query
def w6_gap_groups(spark, sf_dir):
    return W.gap_groups(_gaps(spark, sf_dir))


@query
def w12_dedup(spark, sf_dir):
    rows = X.details(spark, sf_dir).withColumn("text", html.fragment_text(H("outer_html")))
    ordered = rows.select("text", "x", (H("page_id") * 100_000 + H("pos")).alias("place"))
    return W.first_of_equals(ordered, ["text", "x"], "place")


@query
def a1_consolidate(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    first = orders.select(H("o_custkey").alias("node_id"), H("o_orderstatus").alias("status"))
    second = orders.select(H("o_custkey").alias("node_id"), F.when(H("o_orderkey") % 3 == 0, "").otherwise(H("o_orderpriority")).alias("priority"))
    return describe.consolidate([first, second], ["node_id"])


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.elements(spark, sf_dir, X.STYLES).select("page_id", "idx", F.posexplode("css_array").alias("k", "v"))


@query
def a2_style_frequency(spark, sf_dir):
    return describe.style_frequency(_styles(spark, sf_dir), _rects(spark, sf_dir)).withColumn("frequency", F.round("frequency", 6))


@query
def a3_style_weight(spark, sf_dir):
    return describe.style_weight(_styles(spark, sf_dir), _rects(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All native distances of the part-derived elements, in one pass over the pairs."""
    return P.measured(P.pairs_within(D.with_ids(X.elements(spark, sf_dir)).drop("css_array", "feature_set")))


@query
def a5_combine(spark, sf_dir):
    return _distances(spark, sf_dir).select("page_id", "i", "j", F.round(D.combined(*map(H, NAMES)), 6).alias("dist"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clustered(_distances(spark, sf_dir), X.elements(spark, sf_dir, X.RECT), NAMES)


@query
def flagship_clusters(spark, sf_dir):
    return P.ranked(_clusters(spark, sf_dir))


@query
def g4_leftovers(spark, sf_dir):
    return _clusters(spark, sf_dir).filter("cluster_key is null").select("page_id", "idx")


@query
def a7_avg_similarity(spark, sf_dir):
    measured = cut(_distances(spark, sf_dir))
    keys = cut(P.clustered(measured, X.elements(spark, sf_dir, X.RECT), NAMES).filter("cluster_key is not null"))
    pairs = measured.select("page_id", "i", "j", F.round(D.combined(*map(H, NAMES)), 6).alias("dist"))
    both = pairs.select("page_id", H("i").alias("idx"), H("j").alias("other"), "dist").union(pairs.select("page_id", H("j").alias("idx"), H("i").alias("other"), "dist"))
    inner = both.join(keys, ["page_id", "idx"]).join(keys.select("page_id", H("idx").alias("other"), H("cluster_key").alias("other_key")), ["page_id", "other"]).filter("cluster_key = other_key")
    return inner.groupBy("page_id", "idx").agg(F.round(F.avg("dist") + F.lit(1e-8), 4).alias("avg_dist"))


@query
def g1_url_clusters(spark, sf_dir):
    from pagelattice.streaming.ingest import link_clusters

    return link_clusters(read_table(spark, sf_dir, "pages"))


def _vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors within eps, block by block: every block of rows meets every other once.

    All pairs are what density clustering over a metric without an index asks
    for; blocks keep a task's rows bounded, and only edges leave it.  A vector
    goes to every block, so there are few of them: enough for all tasks, then
    one for each BLOCK_ROWS vectors, which are multiplied a part at a time.
    """
    import numpy as np
    import pandas as pd

    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", H("embedding").alias("v"))
    rows = rows.filter(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    n = rows.count()
    blocks = max(4, min(MOST_BLOCKS, -(-n // 2000)), -(-n // BLOCK_ROWS))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "vec_id", "v")

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
        first, second = (rows[rows["own"] == k].sort_values("vec_id") for k in (p, q))
        if first.empty or second.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = (np.stack(m["v"].to_list()).astype(float) for m in (first, second))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        step = max(1, 4_000_000 // len(y))
        near = [np.nonzero(1 - x[at : at + step] @ y.T <= VECTOR_EPS) for at in range(0, len(x), step)]
        i, j = np.concatenate([r + k * step for k, (r, _) in enumerate(near)]), np.concatenate([c for _, c in near])
        a, b = first["vec_id"].to_numpy()[i], second["vec_id"].to_numpy()[j]
        keep = (a < b) if p == q else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return met.groupBy("p", "q").applyInPandas(edges, "a long, b long")


@query
def g1_dbscan(spark, sf_dir):
    return connected_components(_vector_edges(spark, sf_dir)).select(H("node").alias("vec_id"), H("component").alias("cluster"))


@query
def g2_dbscan_core(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "embeddings").select(H("vec_id").alias("node"))
    return P.dbscan(cut(_vector_edges(spark, sf_dir)), nodes, 3).select(H("node").alias("vec_id"), "cluster")


@query
def a13_hash_suffix(spark, sf_dir):
    return describe.number_repeats(_links(spark, sf_dir, hash=F.md5("outer_html")), "hash", "idx").select("page_id", "idx", "name")


def _pairs_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(H("l_returnflag").alias("name"), (H("l_discount").cast("double") * 10).alias("old"), (H("l_tax").cast("double") * 10).alias("new"))


@query
def a14_eval_stats(spark, sf_dir):
    return evaluate.agreement(_pairs_of_functions(spark, sf_dir), "name", "old", "new")


@query
def a15_adjusted_agreement(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(H("l_returnflag").alias("name"), (H("l_discount").cast("double") * 10).alias("old"), evaluate.adjusted((H("l_tax").cast("double") * 10), H("l_linenumber") % 2 == 0).alias("new"))
    return rows.groupBy("name").agg(F.round(F.corr("old", "new"), 6).alias("corr"), F.round(F.avg(F.abs(H("old") - H("new"))), 6).alias("mean_error"))


@query
def a17_discrepancy(spark, sf_dir):
    return evaluate.discrepancies(_pairs_of_functions(spark, sf_dir), "name", "old", "new")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.when(H("quality") == 1, "s").otherwise("d").alias("ans"), ((H("n_chars") % 100).cast("double") / 100).alias("sim"))


@query
def a16_confusion(spark, sf_dir):
    return evaluate.confusion(_answers(spark, sf_dir))


@query
def a16b_confident(spark, sf_dir):
    return _answers(spark, sf_dir).filter(evaluate.verdict(H("ans"), H("sim")) == "correct")


@query
def k10_histogram(spark, sf_dir):
    return evaluate.histogram(a5_combine(spark, sf_dir), "dist")


@query
def k3_element_update(spark, sf_dir):
    rows = X.described_links(X.links(spark, sf_dir)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "tag_name"))).alias("e"))
    return rows.select("page_id", F.array_join(F.transform("e", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["tag_name"], e["text"])), "|").alias("elements"))


def _hist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read_table(spark, sf_dir, "embeddings").withColumn("page_id", (H("vec_id") / 50).cast("long")), "page_id").select("vec_id", "page_id", F.expr("transform(slice(embedding,1,16), e -> cast(floor(abs(cast(e as double))*1500D) as int))").alias("hist"))
    return P.pairs_within(rows, order="vec_id")


@query
def v4_hist_difference(spark, sf_dir):
    return _hist_pairs(spark, sf_dir).select("a_vec_id", "b_vec_id", F.round(visual.hist_difference(H("a_hist"), H("b_hist")), 6).alias("difference"))


@query
def v5_dimensions_factor(spark, sf_dir):
    return P.measured(P.pairs_within(_rects(spark, sf_dir)), {"factor": lambda a, b: visual.dimensions_factor(H(f"{a}width"), H(f"{a}height"), H(f"{b}width"), H(f"{b}height"))})


@query
def v11_phash(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.expr("flatten(array_repeat(transform(embedding, e -> cast(floor(abs(cast(e as double))*255) as int)), 16))").alias("pixels"))
    return rows.select("vec_id", visual.perceptual_hash("pixels").alias("phash")).groupBy("phash").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
