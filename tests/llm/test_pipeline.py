"""The whole pipeline over a small table whose right result is known by construction."""

import random

import pytest

import corpus_pipeline
from pagelattice import session
from pagelattice.llm import line_dedup


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, texts, labels, benchmark, extra="", ids=None):
    """The tables of a data folder; extra columns hold the text `x`."""
    names = [x for x in extra.split(",") if x]
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or ""), *["x"] * len(names)) for k, t in enumerate(texts)]
    schema = ", ".join([SCHEMA, *(f"`{n}` string" for n in names)])
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_drops_what_it_must_and_keeps_the_rest(spark, tmp_path):
    passage, shared = words(20, 1), words(60, 3)
    texts = [words(40, 100 + k) + (" moronic" if k % 4 == 0 else "") for k in range(400)]
    short = "\n".join(words(5, 900 + k) for k in range(30))
    own = texts[7].split()
    more = {
        "near copy of one line": " ".join(own[:38] + ["changed"] + own[39:]), "leak": words(10, 5) + " " + passage, "empty": "", "missing": None,
        "short lines": short, "near copy of short lines": short + "\nand an end", "holds a passage": words(40, 6) + "\n" + shared, "holds it too": words(50, 7) + "\n" + shared,
        "only a passage": shared, "exact copy": texts[9],
    }
    names = dict(zip(more, range(400, 400 + len(more))))
    tables(spark, tmp_path, texts + list(more.values()), [(k, 1, int(k % 4 == 0)) for k in range(400)], [(1, passage)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in out}
    assert len(out) == len(sizes)
    kept = {k for k, n in names.items() if n in sizes}
    assert {k for k in range(400) if k % 4} <= set(sizes)
    assert kept == {"empty", "missing", "short lines", "holds a passage", "holds it too"}
    assert len(set(sizes) & {k for k in range(400) if k % 4 == 0}) <= 3
    assert sizes[names["holds it too"]] == 50 and sizes[names["holds a passage"]] == 100
    assert all(n == len((texts + list(more.values()))[k].split()) for k, n in sizes.items() if k not in (names["holds it too"], names["missing"]))
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_no_near_copy_survives_as_a_scrap(spark, tmp_path):
    rng = random.Random(8)
    texts = ["\n".join(words(12, 1000 * k + n) for n in range(20)) for k in range(20)]
    copies = []
    for k in range(20):
        for kind in range(4):
            lines = texts[k].split("\n")
            at = rng.randrange(20)
            if kind == 0:
                lines[at] = words(12, 90_000 + k)
            elif kind == 1:
                own = lines[at].split()
                lines[at] = " ".join([*own[:5], "changed", *own[6:]])
            elif kind == 2:
                del lines[at]
            copies.append("\n".join(lines))
    tables(spark, tmp_path, texts + copies, [], [])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(20))
    alone = line_dedup.drop_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).filter("doc_id >= 20 and n_dropped < 19")
    assert alone.count() == 0


def test_copies_of_few_long_lines_stay_whole_and_others_lose_theirs(spark):
    lines = [words(100, 40 + k) for k in range(3)]
    own = lines[1].split()
    texts = [
        "\n".join(lines), "\n".join([lines[0], " ".join(own[:50] + own[51:]), lines[2]]), "\n".join([lines[0], " ".join(["new"] + own), " ".join(lines[2].split()[:-2])]),
        "\n".join([lines[0], words(150, 60)]), "\n".join([lines[2], words(40, 61)]), lines[1],
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeats(docs, counted=False, emptied=False, copies=0.8).collect()}
    # a word less in one long line leaves two of three lines equal, but nearly all shingles
    assert {k: out.get(k) for k in range(3)} == dict(enumerate(texts[:3]))
    assert out[3] == words(150, 60) and out[4] == words(40, 61) and 5 not in out
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in out.items()], SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]


def test_pipeline_bears_odd_tables(spark, tmp_path):
    tables(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    one, two = words(40, 1), words(40, 2)
    texts, ids = [one, one, None, None, "", two, two, words(40, 3), words(40, 3)], [1, 1, 2, None, 3, None, None, 7, 7]
    clash = "n_dropped,predicted,score,held_out,n_words,n_hit,items,hits,rid,own_class,gone_lines,gone_id,n,component,stays,at_id,row,piece,n_tokens,capacity"
    docs = tables(spark, tmp_path / "odd", texts, [(1, 0, 0), (None, 1, 1), (7, None, None)], [(None, None), (1, "")], clash, ids)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path / "odd"))
        assert at.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=str) == sorted([(1, 40), (2, 0), (None, 0), (3, 0), (None, 40), (7, 40)], key=str)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:/there/"}
    assert session.shared_folder(Session()) == "hdfs:/there"


def test_near_duplicates_are_decided_row_by_row(spark):
    one, two, three = words(40, 1), words(40, 2), words(40, 3)
    near = " ".join([*one.split()[:39], "changed"])
    rows = [(1, one), (1, one), (1, two), (2, near), (2, three), (None, three), (None, three), (None, words(40, 4)), (None, words(40, 4)), (3, two), (None, None), (4, ""), (4, ""), (5, one.upper()), (1, one + " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(1, one), (1, two), (2, three), (None, words(40, 4)), (None, None), (4, ""), (4, "")], key=str)
