"""Fitted scores, the posterior of languages and the pipeline's stages, computed in plain Python."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import __spark_entry__ as contract
from medallion.llm import line_dedup

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


def read(path):
    return duckdb.connect().execute(f"SELECT * FROM '{path}'").fetch_df()


@pytest.fixture(scope="module")
def docs():
    return read(f"{FOLDER}/documents.parquet").sort_values("doc_id")


def plain_measures(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 16
    size, tokens = len(raw), raw.split()
    n = len(tokens) or 1

    def share(pattern):
        return len(re.findall(pattern, raw)) / size

    upper, lower = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[a-z]", raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    often = Counter(tokens).most_common(1)
    kinds = [rb"[0-9]", rb"""[.,;:'"()\-]""", rb"[!?]", rb"\|",
             rb"[#$%&*+/<=>@\[\\\]^_`{}~]", rb"[\x80-\xff]", rb"[\x00-\x08\x0e-\x1f\x7f]"]
    return [
        size, len(tokens), upper / max(1, upper + lower), *[share(k) for k in kinds],
        (size - n) / n, len(set(tokens)) / n,
        sum(a == b for a, b in zip(tokens, tokens[1:])) / n,
        often[0][1] / n if n >= 20 and often else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, n / max(1, len(lines))]


@pytest.fixture(scope="module")
def quality(docs):
    """doc_id -> score: descent on the risk of all training rows, not on their moments."""
    from medallion.llm.quality import EDGES, MEASURES, RIDGE

    order = ["bytes", "words", "upper", "digits", "stops", "marks", "bars", "symbols", "high",
             "other", "word_bytes", "distinct", "repeats", "top_word", "line_repeats", "line_words"]
    assert order == MEASURES
    marks = read(f"{FOLDER}/labels.parquet").dropna(subset=["doc_id", "quality"])
    good = defaultdict(list)
    for doc_id, label in zip(marks.doc_id, marks.quality):
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            good[doc_id].append(label)
    good = {k: min(v) == 1 for k, v in good.items()}
    x = np.array([[1.0] + [float(v >= e) for v, name in zip(plain_measures(t), MEASURES)
                           for e in EDGES[name]] for t in docs.text])
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id])
    trusted = np.array([good.get(i, False) for i in docs.doc_id]) & ~held
    u, p, prior = x[~held], x[trusted], np.mean(list(good.values()))
    free = np.diag([0.0] + [1.0] * (x.shape[1] - 1))

    def risk_of_bad(w):
        return np.mean((1 + u @ w) ** 2) / 4 - prior * np.mean((1 + p @ w) ** 2) / 4

    def slope_of_bad(w):
        return ((1 + u @ w) @ u / len(u) - prior * (1 + p @ w) @ p / len(p)) / 2

    w = np.linalg.solve(u.T @ u / len(u) + 4 * RIDGE * free + 1e-9 * np.eye(x.shape[1]),
                        2 * prior * p.mean(axis=0) - u.mean(axis=0))
    step = 1 / sum(np.linalg.norm(rows, 2) ** 2 / len(rows) for rows in (u, p))
    for _ in range(2000):
        if risk_of_bad(w) < 0:
            w = w + step * slope_of_bad(w)
            continue
        slope = slope_of_bad(w) - prior * (1 - p @ w) @ p / len(p) / 2 + 2 * RIDGE * free @ w
        if np.abs(slope).max() < 1e-9:
            break
        w = w - step * slope
    return dict(zip(docs.doc_id, (np.clip(x @ w, -1, 1) + 1) / 2))


def test_quality_scores(spark, quality):
    found = contract.queries()["op9_positive_unlabelled"](spark, FOLDER).collect()
    assert {r.doc_id for r in found} == set(quality) and len(found) == len(quality)
    for r in found:
        assert r.score == pytest.approx(quality[r.doc_id], abs=1e-5)


def test_posterior_of_languages(spark, docs):
    from medallion.llm import language

    def grams(text):
        letters = re.sub(rb"[^a-z\x80-\xff]", b" ", (text or "").encode().lower())
        padded = b" " + b" ".join(letters.split()) + b" "
        slots = 14
        return Counter((int.from_bytes(padded[i:i + 3], "big") * 2654435761 % 2**32) >> 32 - slots
                       for i in range(len(padded) - 2))

    learnt = defaultdict(Counter)
    for text, lang in docs[["text", "lang"]].dropna().itertuples(index=False):
        learnt[lang].update(grams(text))
    names = sorted(learnt)
    total = [sum(learnt[n].values()) + 0.5 * 2**14 for n in names]
    pages = read(f"{FOLDER}/pages.parquet")
    rows = []
    for page_id, url, page in zip(pages.page_id, pages.url, pages.html):
        counts = grams(language.visible(page))
        n = sum(counts.values())
        ll = [min(n, 100) / max(1, n) * sum(
            c * math.log((learnt[name][g] + 0.5) / total[k]) for g, c in counts.items())
            for k, name in enumerate(names)]
        ll = [x - max(ll) for x in ll]
        p = [math.exp(x) / sum(map(math.exp, ll)) for x in ll]
        host = (urlsplit(url or "").hostname or "").lower()
        tag = re.search(r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", page or "")
        rows.append((page_id, ll, p, host, (tag[1] if tag else "").lower()))
    levels = [lambda host: host.split(".")[-1], lambda host: ".".join(host.split(".")[-2:]),
              lambda host: host]
    sums, sizes = defaultdict(lambda: [0.0] * len(names)), Counter()
    for _, _, p, host, said in rows:
        for key in [("all",), ("said", said), *[(i, f(host)) for i, f in enumerate(levels)]]:
            sizes[key] += 1
            sums[key] = [a + b for a, b in zip(sums[key], p)]
    kinds = len({said for *_, said in rows})
    expected = {}
    for page_id, ll, p, host, said in rows:
        scores = []
        for k in range(len(names)):
            prior = (sums["all",][k] + 1) / (sizes["all",] + len(names))
            for i, f in enumerate(levels):
                key = (i, f(host))
                prior = (max(sums[key][k] - p[k], 0) + 5 * prior) / (sizes[key] - 1 + 5)
            trust = (max(sums["said", said][k] - p[k], 0) + 0.5) / (
                max(sums["all",][k] - p[k], 0) + 0.5 * kinds)
            scores.append(ll[k] + math.log(prior) + math.log(trust))
        best = max(range(len(names)), key=lambda k: (scores[k], -k))
        expected[page_id] = (names[best], 1 / sum(math.exp(s - scores[best]) for s in scores))
    found = contract.queries()["op5_evidence_fusion"](spark, FOLDER).collect()
    assert len(found) == len(expected)
    for r in found:
        lang, confidence = expected[r.page_id]
        assert r.confidence == pytest.approx(confidence, rel=1e-6)
        assert r.lang == lang


def without_passages(docs):
    """Texts without later occurrences of two filled lines in a row or of one of over 50 words."""
    first, kept = {}, {}
    for number, (doc_id, text) in enumerate(docs):
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" ")]
        chunks = [*zip(filled, filled[1:]),
                  *[(i, i) for i in filled if len(lines[i].encode().split()) > 50]]
        gone = set()
        for begin, end in sorted(chunks):
            seen = first.setdefault("\n".join(lines[begin:end + 1]), (number, begin, end))
            if seen != (number, begin, end):
                after = seen[2] + 1 if seen[0] == number else 0
                gone.update(range(max(begin, after), end + 1))
        kept[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept


def test_repeated_passages_go(spark, docs):
    rows = contract.queries()["op10_line_chunks"](spark, FOLDER).collect()
    texts = dict(zip(docs.doc_id, docs.text))
    assert {r.doc_id: r.text for r in rows} == without_passages(sorted(texts.items()))
    lines = lambda text: text.count("\n") + 1
    assert all(r.removed_lines == (lines(texts[r.doc_id]) - lines(r.text) if r.text else
                                   lines(texts[r.doc_id])) or not texts[r.doc_id] for r in rows)
    assert sum(r.removed_lines > 0 for r in rows) > 20


@pytest.mark.parametrize("window, divisor", [(1, 1), (1, 2), (3, 4), (2, 1000)])
def test_boundaries_do_not_change_passages(spark, shuffled, window, divisor):
    rows, expected = shuffled
    found = line_dedup.deduplicated(rows, passages=True, window=window, divisor=divisor).collect()
    assert {r.doc_id: r.text for r in found} == expected


def test_chunks_that_share_a_hash_are_told_apart(spark, shuffled, monkeypatch):
    monkeypatch.setattr(line_dedup, "_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(37)))
    rows, expected = shuffled
    found = line_dedup.deduplicated(rows, passages=True).collect()
    assert {r.doc_id: r.text for r in found} == expected


@pytest.fixture(scope="module")
def shuffled(spark):
    """Texts of few different lines, with blank ones, so that runs of all lengths repeat."""
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(60)] + ["", " ", "word " * 51]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 25))) for _ in range(60)]
    texts += ["\n".join(rng.sample(t.split("\n"), 1) + t.split("\n")[2:]) for t in texts[:20]]
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string"), without_passages(rows)


def fingerprint(text):
    tokens = text.encode().lower().split()
    shingles = [b" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_stage_by_stage(spark, docs, quality, tmp_path, monkeypatch):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(corpus_pipeline, "work_folder", lambda *_: str(tmp_path))
    final = corpus_pipeline.run(spark, FOLDER).collect()
    stages = [read(f"{tmp_path}/{i}/*.parquet") for i in range(4)]
    columns = list(docs.columns)
    assert all(sorted(stage.columns) == sorted(columns) for stage in stages)
    texts = [dict(zip(stage.doc_id, stage.text)) for stage in stages]

    original = dict(zip(docs.doc_id, docs.text))
    assert texts[0] == {i: original[i] for i, score in quality.items() if score >= 0.7}
    assert texts[1] == without_passages(sorted(texts[0].items()))

    prints = {i: fingerprint(t) for i, t in texts[1].items()}
    group = {i: i for i in prints}
    links = [(a, b) for a, b in combinations(sorted(prints), 2)
             if (prints[a] ^ prints[b]).bit_count() <= 2]
    changed = True
    while changed:  # smallest id reachable
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    assert texts[2] == {i: t for i, t in texts[1].items() if group[i] == i}

    source = dict(zip(stages[2].doc_id, stages[2].source))
    size = {i: len(t.encode().split()) for i, t in texts[2].items()}
    copies = Counter(stages[3].doc_id)
    assert max(copies.values()) <= 2 and texts[3] == {i: texts[2][i] for i in copies}
    all_of, taken, largest = Counter(), Counter(), Counter()
    for i, n in size.items():
        all_of[source[i]] += n
        taken[source[i]] += copies[i] * n
        largest[source[i]] = max(largest[source[i]], n)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(all_of))}
    left, free, target = 1.5 * sum(all_of.values()), set(all_of), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * all_of[s]]
        if not full:
            break
        target |= {s: 2.0 * all_of[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= set(full)
    target |= share
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    covered = {}
    for r in final:
        if r.doc_id not in covered:
            ids = tokenizer.encode(texts[3][r.doc_id], add_special_tokens=False).ids
            covered[r.doc_id] = (np.array([*ids, 1], "<u4"), np.zeros(len(ids) + 1, int))
        ids, times = covered[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        times[r.start:r.start + r.length] += 1
    assert set(covered) == set(copies)
    assert all((times == copies[i]).all() for i, (_, times) in covered.items())
