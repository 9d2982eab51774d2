"""Queries that go to a shard together, with what other shards have found as their thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.llm import search

from .test_models_and_stores import made_shard


def together(shard, texts):
    """Queries for all of which a shard is asked at once: ends, terms, weights; and how many postings their terms have."""
    bags = [np.unique(t, return_counts=True) for t in texts]
    at = [shard.find(t.astype(np.uint64)) for t, _ in bags]
    df = [np.where(a >= 0, shard.df[a], 0) for a in at]
    weights = [np.log(1 + (shard.n_docs - n + 0.5) / (n + 0.5)) * c for n, (_, c) in zip(df, bags, strict=True)]
    return np.cumsum([len(a) for a in at]), np.concatenate(at), np.concatenate(weights), sum(int(n.sum()) for n in df)


@pytest.mark.parametrize("n", [3, 63, 200])
def test_thresholds_leave_the_best(n):
    shard, texts = made_shard(3000)
    *asked, _ = together(shard, [*texts[:n], np.array([99_999]), texts[0][:0], texts[5]])
    query, ids, score = shard.best(*asked, 10, np.zeros(n + 3), prune=False)
    tenth = np.array([score[query == q][-1] if (query == q).sum() == 10 else 0 for q in range(n + 3)])
    assert tenth[:n].all()
    for least in (np.zeros(n + 3), tenth, np.where(np.arange(n + 3) % 2, 1.2 * tenth, 0), np.full(n + 3, 1e9)):
        stay = score >= least[query]
        got = shard.best(*asked, 10, least)
        assert [x.tolist() for x in got] == [x[stay].tolist() for x in (query, ids, score)]


def test_queries_that_go_together_share_what_is_read():
    shard, texts = made_shard(8000)
    *asked, n = together(shard, texts[:300])
    query, _, score = shard.best(*asked, 10, np.zeros(300))
    tenth = score[query.searchsorted(np.arange(300), "right") - 1]
    shard.read = 0
    shard.best(*asked, 10, tenth)
    assert 0 < shard.read < 0.2 * n


def test_every_shard_is_asked_once(spark):
    for n_parts, each, n_tasks in ((1, 1, 4), (1, 9, 4), (5, 1, 4), (40, 3, 2), (614, 2, 6)):
        shards = spark.range(n_parts * each).select((F.col("id") % each).cast("int").alias("place"), F.expr(f"cast(id div {each} as int)").alias("part"))
        rounds = [shards.where(c).count() for c in search._rounds(n_parts * each, n_parts, n_tasks)]
        assert sum(rounds) == n_parts * each
        assert len(rounds) == 1 or 0 < rounds[0] <= n_tasks
        assert all(b <= 16 * a for a, b in zip(rounds[1:], rounds[2:], strict=False))


def test_shards_that_follow_one_another(spark):
    """Shards of ten documents in many rounds find what one shard does."""
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words, 30))) for i in range(400)], "doc_id long, text string").repartition(40)
    asked = docs.where("doc_id % 8 = 0").withColumnRenamed("doc_id", "query_id")
    found = lambda index: sorted(map(tuple, search.search(index, asked, 5).collect()))
    many = search.build_index(docs, docs_per_shard=10)
    assert many.count() > 30
    assert found(many) == found(search.build_index(docs.coalesce(1)))
