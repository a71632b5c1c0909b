"""The operators on texts against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import chat_format, decontaminate, jaccard_join, language_id, line_dedup, packing, token_counts, toxicity
from pagelattice.operators import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rid string"


def docs(spark, texts, langs=None):
    rows = [(k if t != "no id" else None, t, (langs or {}).get(k, "en"), "s", len(t or ""), "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed, pool=4000):
    rng = random.Random(seed)
    return " ".join("".join("abcdefghij"[int(c)] for c in str(rng.randrange(pool))) + "x" for _ in range(n))


def near(seed, edits, n=120):
    own = words(n, seed).split()
    rng = random.Random(seed * 1000 + edits)
    for _ in range(edits):
        own[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
    return " ".join(own)


def brute_components(texts, n, share, per):
    sets = []
    for t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and per * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "share"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, share):
    texts = [near(s, e) for s in range(4) for e in (0, 1, 1, 2, 3, 5)] + [None, "", " \n", "one", "ONE", "a b c", "a b  c", words(3000, 9), words(3000, 9) + " x"] + ["same text again and again here"] * 6
    texts += [words(30, 77) + " " + words(25, 200 + k) for k in range(12)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, texts), n, share, 100).collect()}
    assert found == brute_components(texts, n, share, 100)


def brute_rows(rows, n=4, share=85, per=100):
    """doc_id, set size and component of rows (doc_id, text), where ids may be null or repeat."""
    parts = brute_components([t for _, t in rows], n, share, per)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            at = parts[k][1]
            least[at] = min(least.get(at, i), i)
    return sorted(((i, parts[k][0], least.get(parts[k][1]) if parts[k][0] else i) for k, (i, _) in enumerate(rows)), key=str)


def found_rows(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def test_jaccard_links_rows_without_an_id(spark):
    own = words(120, 3).split()
    one, two, three = (" ".join(f"new{k}" if k in range(20, 20 + 20 * edits, 20) else w for k, w in enumerate(own)) for edits in (0, 2, 4))
    rows = [(None, two), (4, one), (7, three), (None, near(9, 0)), (None, near(9, 1)), (1, "x"), (None, None), (3, ""), (5, near(11, 0)), (5, near(12, 0)), (5, near(11, 1)), (5, near(11, 1))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = found_rows(jaccard_join.jaccard_components(frame))
    assert found == brute_rows(rows)
    # the row without an id is the only bridge between 4 and 7
    assert (7, 117, 4) in found and (7, 117, 7) in found_rows(jaccard_join.jaccard_components(frame.filter("text <> '" + two + "'")))


def test_jaccard_chain(spark):
    own = words(200, 50).split()
    texts = []
    for k in range(12):
        texts.append(" ".join(own))
        for at in range(k * 15, k * 15 + 3):
            own[at] = f"new{k}x{at}"
    rows = list(enumerate(texts))
    assert found_rows(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_rows(rows)
    assert {r[1] for r in brute_components(texts, 4, 85, 100).values()} == {0}


def test_jaccard_of_hot_lists_in_blocks_and_parts(spark, monkeypatch):
    # few words, so that many unlike sets share their rarest shingle
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "MERGED", 5)
    rng = random.Random(12)
    texts = ["a b c d " + " ".join(rng.choice("efgh") for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    rows = list(enumerate(texts))
    assert found_rows(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_rows(rows)


def test_jaccard_entries_against_pairs():
    rng = random.Random(13)
    rule = jaccard_join.Rule()
    rows = sorted((t, 0, 0, rng.randrange(10**9), n := rng.randrange(20, 30), rng.randrange(5), rng.randrange(3), False) for t in range(30) for _ in range(rng.choice([1, 2, 5, 90])))
    rows += [(99, 0, 1, rng.randrange(10**9), 25, 0, k, k % 2 == 0) for k in range(9)]
    arrays = [np.array(x) for x in zip(*rows)]
    entries = jaccard_join.Entries(arrays, rule)
    got = {(int(entries.rid[k]), int(entries.rid[j])) for k, j in zip(*entries.partners())}
    expected = set()
    for x in rows:
        for y in rows:
            reach = min(x[4] - x[5], y[4] - y[5])
            if x[:3] == y[:3] and x[3] > y[3] and x[6] != y[6] and (x[1] == x[2] or x[7] != y[7]) and reach >= rule.required(x[4], y[4]) and rule.sizes_fit(x[4], y[4]):
                expected.add((x[3], y[3]))
    assert got == expected and len(got) > 1000


def test_jaccard_names_every_linked_pair(spark):
    # no first components, so that all links must come from the counts
    texts = [near(seed, edits) for seed in range(3) for edits in range(6)]
    rule, table = jaccard_join.Rule(), np.zeros(1 << jaccard_join.COUNT_BITS, np.uint32)
    sets = jaccard_join.shingle_sets(texts, 4)
    for own in sets:
        np.add.at(table, (own & np.uint64(len(table) - 1)).astype(np.int64), np.uint32(1))
    lists = jaccard_join.shared_lists(jaccard_join.short_list_rows(docs(spark, texts), 4, rule, spark.sparkContext.broadcast(table)), rule)
    none = spark.createDataFrame([], "node long, component long")
    found = {(r["a"], r["b"]) for r in jaccard_join.cross_candidates(lists, none, rule).collect()}
    named = {jaccard_join.digest(own): own for own in sets}
    linked = {(a, b) for a in named for b in named if a < b and jaccard_join.probe(named[a], named[b]) >= rule.required(len(named[a]), len(named[b]))}
    assert len(linked) >= 8 and linked <= found


def test_jaccard_groups_of_near_copies(spark):
    # the text with the smallest doc_id of a list is itself a near copy, and most often too far from the others
    rng, texts = random.Random(14), []
    for size, length in ((50, 60), (50, 120), (100, 300)):
        own = words(length, size + length).split()
        for _ in range(size):
            copy = list(own)
            for _ in range(rng.randrange(length // 30 + 1)):
                copy[rng.randrange(length)] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found_rows(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_rows(rows)


def test_jaccard_of_larger_groups_beyond_its_limits(spark, monkeypatch):
    # limits as a large input fills them: counts that tell little, lists in many blocks and batches, merges in parts
    for name, most in (("COUNT_BITS", 10), ("BLOCK", 16), ("MERGED", 100)):
        monkeypatch.setattr(jaccard_join, name, most)
    monkeypatch.setattr(jaccard_join, "small_batches", lambda session: session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13"))
    monkeypatch.setattr(components, "FEW", 20)
    rng, texts = random.Random(15), []
    for size, length, edits in ((150, 60, 3), (60, 150, 6)):
        own = words(length, size, 10**6).split()
        for _ in range(size):
            copy = list(own)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
            texts += [" ".join(copy)] * rng.choice((1, 1, 2))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    try:
        assert found_rows(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_rows(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_decontamination_matches_sql_semantics(spark):
    passage = words(14, 5, 10**6)
    texts = [None, "", "x " + passage.upper() + " y", passage.replace(" ", "-") + ".", words(9, 5, 10**6), "tiny item", "a tiny, ITEM here tiny item", words(5000, 6)]
    bench = spark.createDataFrame([(1, passage), (2, "Tiny item"), (10, "tiny  item!"), (3, None), (4, "..."), (None, words(12, 8, 10**6))], "item_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs(spark, texts), bench).collect()}
    assert rows[0] == (0, 0, []) and rows[1] == (0, 0, [])
    assert rows[2] == (16, 14, ["1"]) and rows[3] == (14, 14, ["1"]) and rows[4][1:] == (0, [])
    assert rows[5] == (2, 2, ["10", "2"]) and rows[6] == (6, 4, ["10", "2"]) and rows[7][1] == 0
    again = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs(spark, texts), bench, block_windows=10).collect()}
    assert again == rows
    one = {r["doc_id"]: r for r in decontaminate.contamination_digest(decontaminate.find_contamination(docs(spark, texts), bench)).collect()}
    assert one[5]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and one[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.find_contamination(docs(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_of_items_larger_than_a_block(spark):
    item = words(60, 5, 10**6)
    texts = [item, "x " + " ".join(item.split()[20:35]), " ".join(item.split()[3:12]), words(300, 6)]
    bench = spark.createDataFrame([(1, item), (2, words(25, 9, 10**6))], "item_id long, text string")
    whole = [tuple(r) for r in decontaminate.find_contamination(docs(spark, texts), bench).orderBy("doc_id").collect()]
    for size in (1, 7, 20):
        assert [tuple(r) for r in decontaminate.find_contamination(docs(spark, texts), bench, size).orderBy("doc_id").collect()] == whole
        assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, texts), bench, size).orderBy("doc_id").collect()] == [2, 3]
    assert whole[0][2] == 60 and whole[1][2] == 15
    parts = list(decontaminate.item_parts(item, 7))
    assert sum(n for _, n in parts) == 51 and all(len(t.split()) == n + 9 for t, n in parts)
    assert list(decontaminate.item_parts("... " * 9, 3)) == []


def test_line_dedup_keeps_first_and_clean(spark):
    passage = words(60, 1)
    variant = "user 123 logged in from host alpha at noon today"
    texts = [
        f"clean one {words(20, 2)}\n{passage}", f"{passage}\n{words(20, 3)}", words(30, 4), None, "", "short line\nshort line", f"short line\n{words(20, 6)}",
        variant, variant.replace("123", "456"), variant.replace("alpha", "beta"), f"{words(20, 8)}\n{words(20, 8)}",
        "1 2 3 4 5 6 7 8 9 10", "2 3 4 5 6 7 8 9 10 11",
    ]
    out = {r["doc_id"]: r for r in line_dedup.drop_repeats(docs(spark, texts)).collect()}
    assert len(out) == len(texts)
    for k in (0, 2, 3, 4, 5, 6, 7, 10, 11, 12):
        assert out[k]["text"] == texts[k] and out[k]["n_dropped"] == 0, k
    assert out[1]["text"] == texts[1].split("\n")[1] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[8]["text"] == "" and out[9]["text"] == ""
    assert line_dedup.drop_repeats(docs(spark, [])).count() == 0


def test_line_dedup_takes_passages_of_short_lines(spark):
    wrapped = [words(5, 300 + k) for k in range(30)]
    single = [f"w{k}" for k in range(12)]
    long, tail = words(20, 400), "ends in short"
    texts = [
        "\n".join(wrapped), "\n".join(["own first", *wrapped[:10], "", *wrapped[10:], "own last"]),
        "\n".join(single), "\n\n\n".join(["x y z", *single, "z y x"]),
        f"{long}\n{tail}\none thing", f"{words(20, 401)}\n{long}\n{tail}\nother thing", f"{words(20, 402)}\n{tail}\n{words(20, 403)}",
        f"a b c d\n{chr(10) * 200}e f g h", "a b c d\ne f g h", "a b c d\ne f g i",
    ]
    out = {r["doc_id"]: r for r in line_dedup.drop_repeats(docs(spark, texts)).collect()}
    assert [out[k]["n_dropped"] for k in range(len(texts))] == [0, 30, 0, 12, 0, 2, 0, 0, 2, 0]
    assert out[1]["text"] == "own first\n\nown last" and out[3]["text"].split() == "x y z z y x".split()
    assert out[5]["text"] == f"{words(20, 401)}\nother thing" and out[8]["text"] == ""
    last = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeats(docs(spark, [texts[8], texts[7]])).collect()}
    assert last == {0: 0, 1: 2}


def test_line_dedup_takes_variants_of_few_values(spark):
    texts = [f"job started on host {a} for queue {b} and ended" for a in "abcdefghij" for b in "klmnopqrst"]
    near = words(20, 500).split()
    changed = [" ".join([*near[:4], *("cut" if k in at else near[k] for k in range(4, 20))]) for at in ((6,), (6, 9), (12,), ())]
    texts += [*changed, "one two three " + words(17, 501), "a b c d e\na b c d e f g h i j\na b c d e f g h k j", "a b c d e f g h i j", "a b c d e f g h l j", "a b c 1 2 3 4 x y z", "a b c 5 6 7 8 x y w"]
    out = {r["doc_id"]: r for r in line_dedup.drop_repeats(docs(spark, texts)).collect()}
    assert [out[k]["n_dropped"] for k in range(len(texts))] == [0] + [1] * 99 + [0, 1, 1, 1, 0, 0, 1, 1, 0, 0]


@pytest.mark.parametrize("others", [960, 2000])
def test_line_dedup_is_independent_of_the_leafs_size(spark, others):
    fill = [f"all begin alike {words(7, 10_000 + k, 10**6)}" for k in range(others)]
    variants = [f"all begin alike then stay the same up to v{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    many = [f"these begin alike {words(6, 600 + t, 10**6)} {words(1, 700 + v, 10**6)}" for t in range(60) for v in range(5)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeats(docs(spark, fill + variants + many)).collect()}
    assert [out[k] for k in range(len(out))] == [0] * others + [0] + [1] * 29 + [0, 1, 1, 1, 1] * 60


def test_variants_against_brute_force():
    rng = random.Random(9)
    for size in (8, 9, 14, 23):
        rows = sorted({(rng.randrange(60), (1, 2, 3, *(rng.choice((0, 1, 2)) if rng.random() < 0.6 else 7 for _ in range(size - 3)))) for _ in range(300)})
        kept, gone = [], []
        for lo, own in rows:
            alike = any(at < lo and sum(x == y != 0 for x, y in zip(own, other)) >= 0.7 * size for at, other in kept)
            gone.append(alike)
            kept += [] if alike else [(lo, own)]
        batch = pa.RecordBatch.from_arrays([pa.array([5] * len(rows)), pa.array(range(len(rows))), pa.array([lo for lo, _ in rows]), pa.array([w for _, w in rows], pa.list_(pa.int64()))], names=["leaf", "whole", "lo", "words"])
        found = [k for b in line_dedup.variants_of(iter([batch.slice(0, 100), batch.slice(100)]), 0.7) for k in b.column(1).to_pylist()]
        assert found == [k for k, x in enumerate(gone) if x] and 0 < len(found) < len(rows)


def test_token_counts_match_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n'st1!é\t日  ") for _ in range(rng.randrange(50))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>a<|endoftext|>", "a" * 3000, "ab" * 2000 + " x", "it's we'll  \n\n  z", "x   y", words(400, 3)]
    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(texts):
        n = len(known.encode(t or "", add_special_tokens=False).ids)
        assert (rows[k]["n_tokens"], rows[k]["n_bytes"], rows[k]["over_limit"]) == (n, len((t or "").encode()), n > 512)


def greedy_bins(lengths, capacities, overhead):
    """Bins opened one at a time over single pieces: the least-cost capacity for the longest piece left, best-fit filled, downsized."""
    left, out = sorted(lengths), []
    while left:
        options = []
        for capacity in sorted(c for c in capacities if c >= left[-1]):
            rest, held, room = list(left), [], capacity
            while any(x <= room for x in rest):
                piece = max(x for x in rest if x <= room)
                rest.remove(piece)
                held.append(piece)
                room -= piece
            fitting = min(c for c in capacities if c >= sum(held))
            runs = [(n, len(list(g))) for n, g in itertools.groupby(held)]
            options.append(((fitting + overhead) / sum(held), -sum(held), fitting, runs, held))
        _, _, capacity, _, held = min(options)
        out.append((capacity, tuple(held)))
        for x in held:
            left.remove(x)
    return sorted(out)


def test_packing_against_single_pieces():
    rng = random.Random(7)
    for case in range(60):
        capacities = rng.choice([(8,), (8, 16), (5, 9, 20), (10, 11, 12, 40)])
        lengths = [rng.randrange(1, max(capacities) + 1) for _ in range(rng.randrange(1, 40))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.make_plan(histogram, capacities, 2)
        bins = {}
        for n, count in histogram.items():
            bin_id, capacity, offset = plan.place(np.full(count, n), np.arange(count))
            for b, c, o in zip(bin_id.tolist(), capacity.tolist(), offset.tolist()):
                bins.setdefault(b, []).append((o, n, c))
        found = sorted((own[0][2], tuple(n for _, n, _ in sorted(own))) for own in bins.values())
        assert found == greedy_bins(lengths, capacities, 2), (case, lengths, capacities)
        assert len(bins) == plan.bins


def test_packing_measures_in_tokens_of_op3(spark):
    P = pytest.importorskip("public_tokenizers")
    texts = [words(300, 3), words(2000, 4), None, "", "short one"]
    counted = token_counts.count_tokens(docs(spark, texts), P.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: r["n_tokens"] for r in counted.collect()}
    placed = packing.pack(counted.select("doc_id", "n_tokens")).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in placed} == sizes and sizes[0] > 300


def test_packing_ties_and_repeats(spark):
    frame = spark.createDataFrame([(1, 512)] * 3 + [(2, 512), (None, 512), (None, None)], "doc_id long, n_tokens long")
    rows = packing.pack(frame, (512, 1024)).collect()
    assert len(rows) == 6 and len({r["bin_id"] for r in rows if r["n_tokens"]}) * 512 <= 5 * 512 + 512
    spots = [(r["bin_id"], r["bin_offset"]) for r in rows if r["n_tokens"]]
    assert len(set(spots)) == 5


def test_packing_places_every_piece_once(spark):
    rng = random.Random(4)
    lengths = [rng.choice([1, 7, 7, 7, 300, 511, 512, 513, 1500, 4096, 9000]) for _ in range(400)] + [0, 0]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)] + [(999, None)], "doc_id long, n_tokens long")
    bins, whole = {}, {}
    for r in packing.pack(frame).collect():
        if r["n_tokens"]:
            bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
        else:
            assert r["bin_id"] is None
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
    assert whole == {**dict(enumerate(lengths)), 999: 0}
    for held in bins.values():
        held.sort()
        used, capacity = sum(n for _, n, _ in held), held[0][2]
        assert [a for a, _, _ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))]
        assert used <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert sum(h[0][2] for h in bins.values()) < 1.1 * sum(lengths)


def test_chats_round_trip(spark):
    rows = [(1, 0, "system", "be <|im_end|> & kind"), (1, 1, "user", None), (1, 2, "assistant", "&lt;|ok<|"), (2, 0, "assistant", "x"), (3, 0, None, "y"), (3, 1, "us\ner", "z"), (None, 0, "user", "q"), (1, 2, "assistant", "again")]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in made.withColumn("back", chat_format.read_back(made["formatted"])).collect()}
    assert [tuple(t) for t in back[1]["back"]] == [("system", "be <|im_end|> & kind"), ("user", ""), ("assistant", "&lt;|ok<|"), ("assistant", "again")]
    assert [tuple(t) for t in back[3]["back"]] == [("", "y"), ("us\ner", "z")] and not back[3]["valid"] and not back[2]["valid"] and not back[1]["valid"]
    digest = {r["conv_id"]: r for r in chat_format.chat_digests(made).collect()}
    assert digest[1]["loss_sha256"] == hashlib.sha256(b"&lt;|ok<|again").hexdigest() and digest[1]["loss_chars"] == 14 and digest[None]["loss_chars"] == 0


def test_toxicity_learns_and_bears_odd_rows(spark):
    rng = random.Random(5)
    texts = [words(40, k) + (" moronic" if k % 3 == 0 else "") for k in range(300)] + [None, "", "!!!"]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "x") for k in range(300)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    kept_out = [k for k in range(300) if rows[k]["held_out"]]
    assert kept_out and sum(rows[k]["predicted"] == int(k % 3 == 0) for k in kept_out) >= 0.95 * len(kept_out)
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rng
    assert toxicity.score_toxicity(docs(spark, texts), labels.limit(0)).filter("predicted = 1").count() == 0


def test_languages(spark):
    kinds = {"en": "the and of ing thing", "de": "der und ung schein zwei", "fr": "le et que été eau"}
    names = list(kinds)
    texts = [" ".join(random.Random(k).choices(kinds[names[k % 3]].split(), k=30)) for k in range(240)] + [None, "", "123 !?"]
    langs = {k: (names[k % 3] if k % 7 else None) for k in range(240)}
    rows = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, texts, langs)).collect()}
    assert all(rows[k]["lang_pred"] == names[k % 3] for k in range(240))
    assert [(rows[k]["lang_pred"], rows[k]["score"]) for k in (240, 241, 242)] == [("und", 0.0)] * 3
    assert {r["lang_pred"] for r in language_id.identify_languages(docs(spark, texts, dict.fromkeys(range(300)))).collect()} == {"und"}


def test_toxicity_learns_a_pair_of_neutral_terms(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for _ in range(2500):
        own = [f"w{rng.randrange(1500)}" for _ in range(25)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own += ["wretchedly"] * a + ["foreigners"] * b
        rng.shuffle(own)
        texts.append(" ".join(own))
        toxic.append(int(a == b))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs(spark, texts), labels).filter("held_out").collect()
    assert len(rows) > 400 and sum(r["predicted"] == toxic[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_toxicity_of_repeated_texts_and_clashing_names(spark):
    texts = [words(30, k % 40) + (" moronic" if k % 4 == 0 else "") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    frame = docs(spark, texts).withColumns({"predicted": F.lit(7), "held_out": F.lit("x")})
    kept = toxicity.drop_toxic(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] % 4 for r in kept.collect()} == {1, 2, 3}
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame.repartition(7), labels.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame, labels).collect()}


def test_languages_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    kinds = ["the and of", "der und die", "le et que", "el y que"]
    texts = [" ".join(rng.choice(kinds[k % 4].split() + [f"{rng.choice('xyz')}{rng.choice('abc')}"]) for _ in range(12)) for k in range(600)]
    frame = docs(spark, texts, {k: str(k % 4) for k in range(600)})
    runs = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(frame.repartition(n), most_rows=80).collect()} for n in (1, 5, 13)]
    assert runs[0] == runs[1] == runs[2]


def test_many_languages_are_all_learnt(spark):
    kinds = 230
    texts = [" ".join([f"{chr(0x4E00 + 3 * (k % kinds))}{chr(0x4E01 + 3 * (k % kinds))}"] * 6) for k in range(kinds * 8)]
    frame = docs(spark, texts, {k: f"l{k % kinds}" for k in range(len(texts))})
    rows = language_id.identify_languages(frame).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % kinds}" for r in rows) >= 0.99 * len(rows)


def test_language_cells_count_each_gram_once(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab c!12É日 ") for _ in range(500))

    def brute():
        kept = ""
        for c in text.lower():
            c = c if c.isalpha() else " "
            if c != " " or not kept or kept[-1] != " ":
                kept += c
        return sum(len(kept) - n + 1 for n in (1, 2, 3))

    whole = language_id.counts(text)
    assert int(whole[1].sum()) == brute()
    for piece in (1, 2, 3, 7, 499, 500):
        monkeypatch.setattr(language_id, "PIECE", piece)
        at, n = language_id.counts(text)
        assert at.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist()
    monkeypatch.setattr(language_id, "SIZE", 1 << 15)
    long = text * 40
    total = np.zeros(language_id.SIZE, np.int64)
    for cell in language_id.cells(long):
        np.add.at(total, cell, 1)
    at, n = language_id.counts(long)
    assert total[at].tolist() == n.tolist() and total.sum() == n.sum()


def test_texts_of_over_a_mebibyte(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    long = words(250_000, 21, 10**6)
    own = long.split()
    passage = " ".join(own[200_000:200_040])
    lines = "\n".join(" ".join(own[k : k + 12]) for k in range(0, 250_000, 12))
    texts = [long, long + " and more", f"own words here {passage}", lines, lines + "\nlast line of this text is its own one indeed"]
    assert len(long) > 1 << 20
    frame = docs(spark, texts)
    links = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    assert links == {0: 0, 1: 0, 2: 2, 3: 0, 4: 0}
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(frame, bench).collect()} == dict.fromkeys(range(5), 40)
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeats(frame).collect()}
    # the last line has four words, so it goes only as part of a passage, and none ends in it alike
    assert {k: dropped[k] for k in range(4)} == dict.fromkeys(range(4), 0) and dropped[4] in (lines.count("\n"), lines.count("\n") + 1)
    assert {r["doc_id"]: r["n_tokens"] for r in packing.pack_documents(frame).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens")).collect()} == {k: len(t.split()) for k, t in enumerate(texts)}
    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, texts[:1]), P.path("byte_bpe_50k.json")).collect()}
    assert counted == {0: len(known.encode(long, add_special_tokens=False).ids)}
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(frame, labels).count() == 5 and language_id.identify_languages(frame).count() == 5


def test_empty_tables_and_null_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    empty, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = P.path("byte_bpe_50k.json")
    runs = {
        "op1": lambda d: line_dedup.drop_repeats(d), "op2": language_id.identify_languages, "op3": lambda d: token_counts.count_tokens(d, path), "op4": jaccard_join.jaccard_components,
        "op6": lambda d: decontaminate.find_contamination(d, bench), "op7": lambda d: toxicity.score_toxicity(d, labels), "op8": packing.pack_documents, "keep": jaccard_join.keep_one,
        "copies": lambda d: line_dedup.drop_repeats(d, counted=False, emptied=False, copies=0.8), "clean": lambda d: decontaminate.drop_contaminated(d, bench), "mild": lambda d: toxicity.drop_toxic(d, labels),
    }
    odd = spark.createDataFrame([(None, None, None, "s", None, "c", "c"), (None, "a b c d e f g h i", "en", "s", 17, "c", "c"), (1, "", None, "s", 0, "c", "c")], SCHEMA)
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        assert run(odd).count() == 3, name
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_digests(chat_format.format_chats(chats)).count() == 0
