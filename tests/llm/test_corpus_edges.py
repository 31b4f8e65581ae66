"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import glob
import math
import pickle
import random
import tempfile
import time
import types
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medallion.llm import (ann_graph, blobs, common, context_mixing, cover_tree, language,
                           line_dedup, mixing, packing, quality, sharding, simhash)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "_id string, size string, fp string, row string, key string")
A, B = "one two three\nfour five six\nseven eight", "nine ten"


@pytest.fixture(scope="module")
def docs(spark):
    def row(doc_id, text, source="s"):
        return (doc_id, text, "en", source, 0, "x", "x", "x", "x", "x")

    return spark.createDataFrame([
        row(1, A), row(2, A), row(2, A), row(3, None), row(4, ""), row(None, B), row(None, None),
        row(5, "word " * 50_000, None), row(6, " \n \n "), row(7, B, None)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1), (1, 1), (4, 0), (7, None), (None, 1)], "doc_id long, quality int")


def test_mixing(docs, nothing):
    sized = mixing.sizes(docs).cache()
    found = mixing.copies(sized).collect()
    assert len(found) == 10 and all(r.copies in (0, 1, 2) for r in found)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r.copies for r in found)
    assert mixing.copies(mixing.sizes(nothing)).count() == 0
    assert mixing.mixed(nothing).count() == 0


def test_simhash(docs, nothing):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 10
    assert {r.component_id for r in found if r.fp == 0} == {3}
    assert {r.component_id for r in found if r.id in (1, 2)} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7] and ids.count(None) == 2
    assert simhash.keep_one(nothing).count() == 0


def test_hot_variants_are_linked_without_pairs(spark, monkeypatch):
    prints = [1 << b for b in range(40)] + [0, (1 << 63) - 1 - (1 << 62)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long").cache()

    def groups():
        from medallion.llm.components import components

        return {(r.node, r.component) for r in components(simhash.links(df)).collect()}

    few = groups()
    monkeypatch.setattr(simhash, "BUCKET", 3)
    assert groups() == few and len(few) == 41


def test_packing(docs, nothing):
    found = packing.pack(docs).collect()
    assert sum(r.length for r in found if r.doc_id in (3, 4, 6)) == 3
    assert sum(r.length for r in found if r.doc_id == 5) == 50_001
    assert packing.pack(nothing).count() == 0
    odd = "a\x1cb c\x85d e  f İ <|endoftext|> it's x\n\ty"
    words = packing.WordIds(packing.tokenizer_path())
    for text in (odd, odd.replace("\x1c", " "), "".join(map(chr, range(0x3000)))):
        assert words.of(text) == words.encode(text)


def test_patterns_hold_the_histogram():
    for histogram in ({2048: 3, 700: 1000}, {1: 5000}, {n: n % 7 for n in range(1, 2049)}, {}):
        held, packs = {}, packing.patterns(histogram)
        for count, items in packs:
            assert sum(length * times for length, times in items) <= 2048
            for length, times in items:
                held[length] = held.get(length, 0) + count * times
        assert held == {k: n for k, n in histogram.items() if n}


def test_sharding(docs, nothing):
    found = sharding.sharded(docs).collect()
    assert len(found) == 10
    assert len({r.shard for r in found if r.doc_id == 2}) == 1
    assert {r.size for r in found if r.doc_id in (3, 4)} == {1}
    assert sharding.sharded(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(docs["doc_id"], [])


def test_a_changed_weight_moves_rows_only_within_its_path(spark):
    rows = spark.range(2000)
    tree = sharding.planned(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    moved = rows.select(sharding.shard_of(rows.id, tree).alias("a"),
                        sharding.shard_of(rows.id, heavier).alias("b")).filter("a != b").collect()
    assert moved and all(m.b // 8 == 0 for m in moved)  # into the region of shard 5 alone


def test_quality(docs, nothing, labels):
    found = quality.scored(docs, labels).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    none = labels.filter("quality = 5")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.accepted(nothing, labels).count() == 0


def test_line_dedup(docs, nothing):
    out = line_dedup.deduplicated(docs, removed="removed")
    assert out.columns == [*docs.columns, "removed"]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == A and texts[3] is None and texts[4] == "" and texts[6] == " \n \n "
    assert len(texts[2]) < len(A) and out.count() == 10
    assert line_dedup.deduplicated(nothing).count() == 0


def test_passages_go_in_any_surroundings(spark):
    import corpus_pipeline

    texts, wanted = [], []
    for n in range(2, 7):
        passage = [f"passage {n} line {i}" for i in range(n)]
        passage.insert(1, "")
        for copy in range(8):
            before = [f"before {n} {copy} {i}" for i in range(copy % 3)]
            after = [f"after {n} {copy} {i}" for i in range(copy % 4)]
            texts.append("\n".join([*before, *passage, *after]))
            wanted.append("\n".join([*before, *after]) if copy else texts[-1])
    long = " ".join(f"word{i}" for i in range(51))
    for name in "abc":
        texts.append(f"head {name}\nsingle\ntail {name}\n{long}\nend {name}")
        gone = "" if name != "a" else f"{long}\n"
        wanted.append(f"head {name}\nsingle\ntail {name}\n{gone}end {name}")
    texts.append("again\nagain\nagain\nagain")
    wanted.append("again\nagain")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.line_chunks(spark, docs, "").collect()}
    assert found == dict(enumerate(wanted))


def test_line_dedup_removes_in_one_pass(spark):
    shared = "\n".join(f"line {i}" for i in range(20_000))
    rows = spark.createDataFrame([(1, f"{shared}\nbetween"), (2, f"own\n{shared}")],
                                 "doc_id long, text string")
    found = line_dedup.deduplicated(rows, removed="removed")
    assert "array_contains" not in found._jdf.queryExecution().toString()  # quadratic in a text
    out = {r.doc_id: r for r in found.collect()}
    assert out[1].removed == 0 and out[2].removed > 12_000
    assert out[2].removed + out[2].text.count("\n") == 20_000


def test_context_mixing(docs, nothing):
    found = context_mixing.scored(docs).collect()
    assert len(found) == 10 and all(r.score < 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 6)} == {1}
    assert context_mixing.scored(nothing).count() == 0


def test_sizes_of_the_mixing_grow_between_their_bounds():
    within = context_mixing._power_within
    assert [within(n, (8, 64)) for n in (0, 0.5, 8, 9, 16.5, 32, 1e9)] == [8, 8, 8, 16, 32, 32, 64]


def test_larger_tables_and_more_contexts_score_better(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    texts = []
    for i in range(150):
        at = rng.randrange(600)
        text = []
        for _ in range(120):  # every word has three likely successors
            text.append(words[at])
            at = (at * 7 + rng.randrange(3)) % 600
        texts.append((i, " ".join(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def total(**sizes):
        return sum(r.score for r in context_mixing.scored(docs, **sizes).collect() if r.held_out)

    few = total(frequent=(2, 2), slots=(1 << 16, 1 << 16))
    assert total(frequent=(2, 64), slots=(1 << 16, 1 << 16)) != few  # 14,520 tokens allow four
    assert total(frequent=(512, 512), slots=(1 << 20, 1 << 20)) > few


def _chain(spark):
    rng = random.Random(4)
    texts = []
    for i in range(400):
        at = rng.randrange(5000)  # more words than symbols
        text = []
        for _ in range(120):  # every word has three likely successors
            text.append(f"w{at}")
            at = (at * 7 + rng.randrange(3)) % 5000
        texts.append((i, " ".join(text)))
    return spark.createDataFrame([*texts, (400, None), (401, texts[0][1]), (None, " \n")],
                                 "doc_id long, text string").repartition(3)


def _beyond(docs, monkeypatch, part_tokens, keys_at_once):
    """Scores where the corpus has more training tokens than a task holds slots."""
    monkeypatch.setattr(context_mixing, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(context_mixing, "KEYS_AT_ONCE", keys_at_once)
    return context_mixing.scored(docs, frequent=(16, 64), slots=(1 << 15, 1 << 15)).collect()


def test_contexts_beyond_the_slots_have_counts_of_their_own(spark, monkeypatch):
    made, real = [], context_mixing.Vocabulary
    monkeypatch.setattr(
        context_mixing, "Vocabulary", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(context_mixing, "BYTES_AT_ONCE", 1 << 15)
    docs = _chain(spark)
    found = _beyond(docs, monkeypatch, 10_000, 1 << 15)
    assert len(found) == 403
    words, tree = made[0], made[0].tree
    rank = {w: i for i, w in enumerate(words.words)}
    assert len(rank) > context_mixing.SHORT + 100 and words.frequent == 16

    def symbol_of(word):
        if rank.get(word, 9999) < words.short:
            return rank[word]
        return words.short + context_mixing.class_of(word)

    def coded(text):
        """(symbol, its contexts) of each token."""
        out, before, frequent = [], None, [None, None]
        for w in [*text.encode().split(), None]:
            symbol = words.end if w is None else symbol_of(w)
            out.append((symbol, [(0, frequent[-1]), (1, *frequent[-2:]), (2, before)]))
            before = w
            if w is not None and rank.get(w, 9999) < words.frequent:
                frequent.append(w)
        return out

    def way(symbol):
        return [(tree.node[i, symbol], tree.bit[i, symbol]) for i in range(tree.length[symbol])]

    plain = {r.doc_id: r.text or "" for r in docs.collect()}
    texts = {i: coded(text) for i, text in plain.items()}
    held_out = {r.doc_id: r.held_out for r in found}
    counts = Counter((context, node, bit) for i, text in texts.items() if not held_out[i]
                     for symbol, near in text for node, bit in way(symbol) for context in near)
    for r in found:
        moves, begins = [], []
        for table in range(3):
            begins.append([])
            for symbol, near in texts[r.doc_id]:
                begins[-1].append(len(moves))
                for node, _ in way(symbol):
                    zeros, ones = (counts[near[table], node, bit] for bit in (0, 1))
                    seen = zeros + ones
                    moves.append(seen / (seen + context_mixing.PRIOR) * (
                        math.log((ones + 0.4) / (zeros + 0.4)) - tree.odds[node]))
        symbols = np.array([symbol for symbol, _ in texts[r.doc_id]])
        mixed = context_mixing.log10_probabilities(
            [symbols], tree, [], 0, (np.array(moves, np.float32), np.array(begins)))[0]
        shares = sum(
            (words.log_counts[rank[w]] if w in rank else math.log10(0.5))
            - words.log_mass[symbol_of(w) - words.short]
            for w in plain[r.doc_id].encode().split() if symbol_of(w) >= words.short)
        assert r.score == pytest.approx(mixed + shares, rel=1e-4)


def test_joined_contexts_do_not_depend_on_parts(spark, monkeypatch):
    docs = _chain(spark)
    one = {r.doc_id: r.score for r in _beyond(docs, monkeypatch, 10_000, 1 << 15)}
    other = _beyond(docs.repartition(1), monkeypatch, 1 << 20, 1 << 23)
    assert len(other) == 403
    assert all(r.score == pytest.approx(one[r.doc_id], rel=1e-5) for r in other)


def test_counts_on_the_ways_of_keys():
    rng = np.random.default_rng(5)
    tree = context_mixing.Tree(np.array([5.0, 1, 1, 3, 0.5, 8]))
    pairs = [(int(c), int(s)) for c, s in rng.integers(0, [4, 6], (200, 2))]
    held = [(9, 2), (3, 0)]  # asked for only
    bits = context_mixing.LEAF_BITS
    found = np.array(sorted({(c << bits) | int(tree.leaf[s]) for c, s in pairs + held}), np.uint64)
    symbols = tree.by_leaf[(found & np.uint64((1 << bits) - 1)).astype(int)]
    wanted = [(int(k) >> bits, int(s)) for k, s in zip(found, symbols)]
    whole, zeros = context_mixing.ways_counted(
        found, np.array([pairs.count(w) for w in wanted]), tree)

    def way(symbol):
        return [(int(tree.node[i, symbol]), int(tree.bit[i, symbol]))
                for i in range(tree.length[symbol])]

    plain = [sum((node, 0) in way(other) for at, other in pairs if at == c)
             for c, s in wanted for node, _ in way(s)]
    assert whole.tolist() == [sum(at == c for at, _ in pairs) for c, _ in wanted]
    assert zeros.tolist() == plain


def test_answers_leave_out_what_follows_from_the_keys():
    rng = np.random.default_rng(6)
    tree = context_mixing.Tree(np.array([5.0, 1, 1, 3, 0.5, 8, 2]))
    bits = context_mixing.LEAF_BITS
    counts = Counter((int(c), int(s)) for c, s in rng.integers(0, [5, 7], (60, 2)))
    counts.update({(7, 1): 4, (8, 2): 3, (8, 4): 2, (9, 3): 0, (2, 3): 0})

    def key(pair):
        return (pair[0] << bits) | int(tree.leaf[pair[1]])

    def told(pairs):
        """Others' counts that the part with ``pairs`` is told; its moves are those counted."""
        known = np.array([np.searchsorted(found, key(p)) for p in pairs])
        times = every.take(known)
        rest, others = context_mixing.answer(
            found.take(known), whole.take(known), times,
            lambda level, at, _: zeros.take(begins.take(known.take(at)) + level), tree)
        moves = context_mixing.moves_of(found.take(known), times, rest, others, tree).tolist()
        for context, symbol in pairs:
            for level in range(tree.length[symbol]):
                node = tree.node[level, symbol]
                off, on = (sum(n for (c, s), n in counts.items() if c == context and any(
                    tree.node[i, s] == node and tree.bit[i, s] == bit
                    for i in range(tree.length[s]))) for bit in (0, 1))
                assert moves.pop(0) == pytest.approx(
                    (off + on) / (off + on + context_mixing.PRIOR)
                    * (math.log((on + 0.4) / (off + 0.4)) - tree.odds[node]), rel=1e-5, abs=1e-6)
        assert not moves
        return rest.tolist(), others.tolist()

    every = sorted(counts, key=key)
    found = np.array([key(p) for p in every], np.uint64)
    pairs, every = every, np.array([counts[p] for p in every])
    whole, zeros = context_mixing.ways_counted(found, every, tree)
    begins = context_mixing._begins(context_mixing._leaves(found, tree), tree)
    assert set(told(pairs)[0]) == {0}
    told(pairs[::2])
    told(pairs[1::3])
    assert told([(7, 1)]) == ([0], [])  # no other symbol, so no way is told; before, all of it
    assert told([(9, 3)]) == ([0], [])
    assert told([(8, 2)])[0] == [2]


def test_parts_ask_in_turns():
    words = context_mixing.Vocabulary(
        [b"a", b"b", b"c", b""], np.array([9, 8, 7, 6]), 30, 4, np.zeros(64), np.zeros(64), 4, 64)
    rng = np.random.default_rng(7)
    codes, sizes = rng.integers(0, 3, 90), np.array([40, 0, 50])
    codes[::9] = context_mixing._codes_of([b"x", b"y"], context_mixing.classes_of(
        pa.array([b"x", b"y"], pa.binary()))).take(rng.integers(0, 2, 10))
    assert context_mixing._read(*context_mixing._noted(codes)).tolist() == codes.tolist()
    held_out = np.array([0, 0, 1])
    whole = context_mixing.Part(codes, sizes, words, 8)
    counts = dict(zip(whole.keys.tolist(), whole.counts(held_out).tolist()))
    assert sum(counts.values()) == 3 * 42 and 0 in counts.values()
    found = {}
    for turn in range(2):
        part = context_mixing.Part(codes, sizes, words, 8, turn, 2)
        for bucket in range(8):
            here = slice(part.edges[bucket], part.edges[bucket + 1])
            wanted = whole.keys[whole.edges[bucket]:whole.edges[bucket + 1]]
            assert part.keys[here].tolist() == (wanted.tolist() if bucket % 2 == turn else [])
        found.update(zip(part.keys.tolist(), part.counts(held_out).tolist()))
    assert found == counts


def test_computed_rows_leave_no_shuffle_files(spark):
    folder = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())

    def files():
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, "false")
    found = common.computed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(key) == setting
    assert sum(r["count"] for r in found.collect()) == 1000


def test_packed_numbers():
    for values in ([], [0], [3, 254, 255, 256, 0, 1 << 40]):
        values = np.array(values, np.int64)
        assert blobs.unpacked_counts(blobs.packed_counts(values)).tolist() == values.tolist()
        assert blobs.unpacked_planes(blobs.packed_planes(values)).tolist() == values.tolist()


def test_words_of_odd_texts():
    texts = ["", None, " \t\n", "One\u00a0word", "\x0b a\x0cB\r\nc  ", "\u00c9t\u00e9 \x1c z", "q"]
    words, sizes = context_mixing.words_of(pa.array(texts, pa.string()).cast(pa.binary()))
    wanted = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for found in wanted for w in found]
    assert sizes.tolist() == [len(found) for found in wanted]
    assert context_mixing.classes_of(words).tolist() == [
        context_mixing.class_of(w) for w in words.to_pylist()]
    one = [context_mixing.contexts(np.array(x), 4) for x in ([1, 7, 2], [9], [3, 3, 0, 8, 1])]
    joined = context_mixing.contexts(np.array([1, 7, 2, 9, 3, 3, 0, 8, 1]), 4, np.array([0, 3, 4]))
    assert [h.tolist() for h in joined] == [np.concatenate(h).tolist() for h in zip(*one)]


def test_repeated_contexts_go_down_the_tree_once(spark, monkeypatch):
    went = []
    whole = context_mixing.Tree.descend

    class Local:  # runs a task here
        def filter(self, *_):
            return self

        select = filter

        def mapInArrow(self, run, schema):
            return run

    def counted(tree, symbols):
        went.append(len(symbols))
        return whole(tree, symbols)

    monkeypatch.setattr(context_mixing.Tree, "descend", counted)
    monkeypatch.setattr(context_mixing, "summed", lambda parts, dtype: parts)
    held = context_mixing.Vocabulary(
        [b"a", b"b", b"c", b""], np.array([30_000] * 3 + [100]), 90_100, 4, np.zeros(64),
        np.zeros(64), 4, 1 << 16)
    run = context_mixing.decision_counts(
        Local(), types.SimpleNamespace(value=pickle.dumps(held)))
    texts = pa.array([b"a b c " * 300] * 100)
    out = run(iter([pa.record_batch([texts], names=["text"])]))
    total = sum(int(context_mixing.unpacked(blob, "i8").sum())
                for batch in out for blob in batch.column(1).to_pylist())
    assert total == 3 * sum(n * held.tree.length[s] for s, n in (
        (0, 30_000), (1, 30_000), (2, 30_000), (held.end, 100)))
    assert sum(went) < 100  # 270,300 before


def test_decisions_add_up_to_one():
    import numpy as np

    tree = context_mixing.Tree(np.array([5.0, 1, 1, 3, 0.5, 8]))
    empty = [np.zeros(size, np.complex64) for size in (512, 1024, 1024)]
    for start in ([], [2, 2, 5]):
        before = context_mixing.log10_probabilities([np.array(start, int)], tree, empty, 2)[0]
        after = context_mixing.log10_probabilities(
            [np.array([*start, s]) for s in range(6)], tree, empty, 2)
        assert sum(10 ** (after - before)) == pytest.approx(1, abs=1e-4)


VECTORS = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.99, 0.01], 1),
    (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1),
    (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
    (None, [2.0, 0.0], 1), (12, [float("inf"), 0.0], 1)]
VECTOR_SCHEMA = "vec_id long, embedding array<double>, label int"


def test_cover_tree(spark):
    rows = spark.createDataFrame(VECTORS, VECTOR_SCHEMA)
    found = cover_tree.linked(rows).collect()
    assert len(found) == len(VECTORS)
    assert {(r.n_links, r.component_id) for r in found if r.vec_id in (1, 2, 3)} == {(4, 1)}
    assert all(r.n_links == 0 and r.kept for r in found
               if r.vec_id in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert cover_tree.linked(rows.limit(0)).count() == 0


def test_cover_tree_in_many_leaves(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 8))
    x = np.concatenate([c + 0.02 * draw.normal(size=(50, 8)) for c in centres]
                       + [draw.normal(size=(100, 8))])
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTOR_SCHEMA)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    monkeypatch.setattr(cover_tree, "LEAF", 20)
    found = {r.vec_id: r.n_links for r in cover_tree.linked(rows).collect()}
    assert [found[i] for i in range(len(x))] == links.tolist()


def test_graph_search(spark):
    rows = spark.createDataFrame(VECTORS, VECTOR_SCHEMA)
    asked = rows.selectExpr("vec_id AS query_id", "embedding AS query").filter("vec_id in (1, 5, 6)")
    found = ann_graph.nearest(ann_graph.index(rows), asked, k=3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, 2, 0.0), (2, 2, 0.0), (3, 4, 0.0)]
    none = rows.limit(0)
    assert ann_graph.nearest(ann_graph.index(none), asked).count() == 0


def test_graph_search_among_copies(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    x = draw.normal(size=(1000, 8))
    copies = draw.permutation(1000)[:400]
    assert len(copies) > 3 * ann_graph.QUERY_BEAM
    x[copies] = x[copies[0]]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTOR_SCHEMA)
    near = np.argsort(((x - x[copies[0]]) ** 2).sum(axis=1), kind="stable")[400:420]
    wanted = sorted({*copies[:40].tolist(), *near.tolist(), *range(20)})
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in wanted],
                                  "query_id long, query array<double>")
    found = {i: [] for i in wanted}
    for r in sorted(ann_graph.nearest(ann_graph.index(rows), asked).collect(),
                    key=lambda r: r["rank"]):
        found[r.query_id].append(r.vec_id)
    hits = 0
    for i in wanted:
        gap = ((x - x[i]) ** 2).sum(axis=1)
        gap[i] = np.inf
        best = np.lexsort((np.arange(len(x)), gap))[:10].tolist()
        if i in copies:
            assert found[i] == best
        hits += len(set(best) & set(found[i]))
    assert hits >= 0.98 * 10 * len(wanted)
    with pytest.raises(ValueError):
        ann_graph.nearest(ann_graph.index(rows, k=5), asked, k=6)


def test_language(spark, docs):
    names, model = language.learnt(docs)
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/x", "<html lang='de'><p>drei</p>"), (None, None, None),
         (2, "not an address", ""), (2, "http://b.de", "<HTML class=x lang=de>")],
        "page_id long, url string, html string")
    found = language.identified(pages, names, model).collect()
    assert len(found) == 4 and {r.lang for r in found} == {"en"}
    assert {r.declared for r in found} == {"de", ""}
    assert language.identified(pages.limit(0), names, model).count() == 0
    assert {r.lang for r in language.identified(pages, [], model).collect()} == {None}
