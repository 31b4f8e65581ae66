"""Graph search on offset and far-out vectors, stripping of odd pages, shards that are added."""

import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medallion.llm import ann_graph, language, sharding


@pytest.mark.parametrize("offset, outlier", [(0, None), (1e4, None), (1e9, None), (0, 1e30),
                                             (-1e4, 1e300)])
def test_recall_in_several_shards(spark, monkeypatch, offset, outlier):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(2400, 24)) + offset
    if outlier:
        x[::600] = draw.normal(size=(4, 24)) * outlier
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    index = ann_graph.index(rows, shard=800)
    assert index.select("part").distinct().count() == 3
    asked = rows.filter("vec_id % 20 = 7").selectExpr("vec_id AS query_id", "embedding AS query")
    found = {}
    for r in ann_graph.nearest(index, asked).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, ids in found.items():
        with np.errstate(over="ignore"):
            far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(ids & set(np.argsort(far, kind="stable")[:10].tolist()))
        total += 10
    assert len(found) == 120 and hits / total >= 0.95


def plain_visible(page):
    hidden = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
    return html.unescape(re.sub("<[^>]*>", " ", hidden.sub(" ", page)))


def test_stripping_equals_the_patterns():
    pick = random.Random(8)
    parts = ["<script>", "</script >", "</SCRIPT>", "<Style x>", "</style>", "<!--", "-->", "<!-->",
             "<", ">", "a", " b&amp;c ", "<p>", "<scripts>", "</script", "\n", "<template", "</template>"]
    for _ in range(30_000):
        page = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert language.visible(page) == plain_visible(page), page


def test_stripping_is_linear():
    began = time.process_time()
    for unit in ("<", "<script>", "<!--", "<style><!--", "</script", "<p ", "<template></script "):
        language.visible(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 7


def test_a_shard_more_takes_rows_only_into_itself(spark):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"))
    for low in range(1, 41, 10):
        found = rows.select(*[sharding.shard_of(rows.key, sharding.planned(n)).alias(f"n{n}")
                              for n in range(low, low + 11)]).collect()
        for n in range(low, low + 10):
            before, after = [r[f"n{n}"] for r in found], [r[f"n{n + 1}"] for r in found]
            assert all(b in (a, n) for a, b in zip(before, after))
            sizes = Counter(after)
            mean = len(found) / (n + 1)
            assert sorted(sizes) == list(range(n + 1))
            assert all(abs(size - mean) < 6 * mean**0.5 for size in sizes.values())


def test_places_to_be_filled_keep_weights(spark):
    tree = [sharding.Leaf(0, 0, 0, 3.0), sharding.Leaf(0, 0, 1), sharding.Leaf(0, 1, 2, 2.0),
            sharding.Leaf(0, 1, 3, 9.0, filled=False), sharding.Leaf(1, 0, 4, 2.0)]
    rows = spark.range(8000)
    sizes = Counter(r[0] for r in rows.select(sharding.shard_of(rows.id, tree)).collect())
    for leaf in tree:
        wanted = leaf.weight * 1000 if leaf.filled else 0
        assert abs(sizes[leaf.shard] - wanted) <= 6 * wanted**0.5
    with pytest.raises(ValueError):
        sharding.shard_of(rows.id, [sharding.Leaf(0, 0, 0, filled=False)])
