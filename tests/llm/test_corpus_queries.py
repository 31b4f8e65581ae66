"""The corpus queries over whole small tables, against brute force in plain Python."""

import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
from medallion.llm import line_dedup

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def table():
    def read(name):
        return duckdb.connect().execute(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetch_df()

    return read


def run(spark, name):
    return contract.queries()[name](spark, FOLDER)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def words(text):
    return (text or "").encode().lower().split()


def test_mix_meets_targets(spark, table):
    found = run(spark, "op1_pivotal_mix").collect()
    docs = table("documents")
    assert sorted(r.doc_id for r in found) == sorted(docs.doc_id)
    sizes = defaultdict(int)
    largest = defaultdict(int)
    for doc_id, text, source in zip(docs.doc_id, docs.text, docs.source):
        n = len((text or "").encode().split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:  # reshare until no source is above its limit
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= share
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(run(spark, "op1_pivotal_mix").collect()) == sorted(found)


def test_cover_tree_finds_all_links(spark, table):
    vectors = table("embeddings")
    x = np.stack(vectors.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.98) & (vectors.label.values[:, None] == vectors.label.values)
    np.fill_diagonal(close, False)
    ids = vectors.vec_id.tolist()
    groups = components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(close)])
    found = {r.vec_id: r for r in run(spark, "op2_cover_tree").collect()}
    assert len(found) == len(ids)
    for i, n in zip(ids, close.sum(axis=1)):
        assert (found[i].n_links, found[i].component_id) == (n, groups[i])
        assert found[i].kept == (groups[i] == i)


def test_context_mix_beats_single_words(spark, table):
    docs = table("documents")
    counts = Counter()
    for doc_id, text in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(doc_id).encode()) % 5 != 1:
            counts.update([*words(text), b""])
    total, distinct = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in run(spark, "op3_context_mix").collect()}
    assert len(found) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        r, seen = found[doc_id], [*words(text), b""]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in seen)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (
            len(seen), sum(counts[w] > 0 for w in seen), total)
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_hash_tree_shards(spark, table):
    docs = table("documents")
    found = {r.doc_id: r for r in run(spark, "op4_hash_tree_shards").collect()}

    def uniform(node, key):
        seed = xxhash.xxh64_intdigest(node.encode(), 42)
        bits = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed)
        return ((bits >> 11) + 0.5) * 2.0**-53

    def chosen(key, level, path, children):
        return min(children, key=lambda c: (
            -math.log(uniform(f"42/{path}/{level}/{c}", key)) / children[c], c))

    for doc_id, text in zip(docs.doc_id, docs.text):
        r, raw = found[doc_id], text.encode()
        region = chosen(doc_id, "region", "", {0: 8.0, 1: 8.0})
        rack = chosen(doc_id, "rack", f"/{region}", {0: 4.0, 1: 4.0})
        racks = range(8 * region + 4 * rack, 8 * region + 4 * rack + 4)
        shard = chosen(doc_id, "shard", f"/{region}/{rack}", dict.fromkeys(racks, 1.0))
        assert (r.shard, r.size, r.text_crc32) == (shard, len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (shard, 16)
    for shard in {r.shard for r in found.values()}:
        slots = sorted(r.slot for r in found.values() if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert any(r.grown_shard == 16 for r in found.values())


def test_languages_are_those_of_the_addresses(spark, table):
    pages = table("pages")
    truth = pages.url.str.extract(r"://[^/]*/([a-z]{2})/")[0]
    found = {r.page_id: r.lang for r in run(spark, "op5_evidence_fusion").collect()}
    assert len(found) == len(pages)
    right = [found[p] == t for p, t in zip(pages.page_id, truth) if t]
    assert sum(right) >= 0.95 * len(right)


def test_graph_search_recall(spark, table):
    vectors = table("embeddings")
    x, ids = np.stack(vectors.embedding).astype(float), vectors.vec_id.values
    found = defaultdict(list)
    for r in sorted(run(spark, "op6_pruned_graph").collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    asked = [i for i, v in enumerate(ids) if v % 100 == 0]
    assert sorted(found) == sorted(ids[asked])
    hits = 0
    for i in asked:
        gap = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        best = set(ids[np.lexsort((ids, gap))[:10]])
        got = found[ids[i]]
        assert got == sorted(got, key=lambda g: (g[1], g[0])) and len(got) == 10
        for vec_id, score in got:
            assert score == pytest.approx(gap[ids.tolist().index(vec_id)], abs=1e-12)
        hits += len(best & {g[0] for g in got})
    assert hits >= 0.9 * 10 * len(asked)


def test_fingerprints_and_groups(spark, table):
    docs = table("documents")
    prints = {}
    for doc_id, text in zip(docs.doc_id, docs.text):
        w = words(text)
        shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64)
                             if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2)
            if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = components(sorted(prints), near)
    found = run(spark, "op7_deletion_variants").collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == groups[r.doc_id]


def test_packs_hold_every_id_once(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = table("documents")
    found = run(spark, "op8_histogram_packs").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    used = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
        padding += 0 if at.bit_count() == 1 else 2048 - at
    assert padding <= 0.03 * used


def test_quality_of_held_out_texts(spark, table):
    labels = dict(zip(table("labels").doc_id, table("labels").quality))
    found = run(spark, "op9_positive_unlabelled").collect()
    assert len(found) == len(table("documents"))
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    good = [r.score for r in held if labels[r.doc_id]]
    bad = [r.score for r in held if not labels[r.doc_id]]
    assert good and bad
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def plain_chunks(text):
    """Chunks by the rolling hash, and whether each has two lines that are not blank."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    chunks, begin = [], 0
    for i in range(len(lines)):
        seed = 42
        for back in range(2):
            value = hashes[i - back] if i >= back else 0
            seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), seed)
        signed = seed - (1 << 64) if seed >> 63 else seed
        if signed % 3 == 0 or i == len(lines) - 1:
            chunks.append(lines[begin:i + 1])
            begin = i + 1
    return chunks


def test_repeated_chunks_go(spark, table):
    docs = table("documents").sort_values("doc_id")
    seen, expected = set(), {}
    for doc_id, text in zip(docs.doc_id, docs.text):
        kept, lost = [], 0
        for chunk in plain_chunks(text):
            key = "\n".join(chunk)
            if sum(bool(x.strip(" ")) for x in chunk) >= 2:
                if key in seen:
                    lost += len(chunk)
                    continue
                seen.add(key)
            kept += chunk
        expected[doc_id] = ("\n".join(kept), lost)
    rows = line_dedup.deduplicated(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"),
        removed="removed_lines").collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == expected
    assert any(lost for _, lost in expected.values())


def test_pipeline_keeps_ids_whole(spark, table):
    found = run(spark, "pipeline").collect()
    assert found and {r.doc_id for r in found} < set(table("documents").doc_id)
    for _, parts in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in found),
                                      key=lambda r: r[0]):
        at = 0
        for _, offset, length in parts:
            assert offset == at
            at += length
        assert at <= 2048
