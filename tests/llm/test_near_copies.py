"""The pipeline's near copies against brute force over the Jaccard similarity of five-word shingles."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutloom.llm import simhash

SCHEMA = "doc_id long, text string"


def jaccard_groups(texts, similarity=0.8, words=5):
    """The smallest index that every text reaches over pairs of the similarity or more."""
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def found_groups(spark, texts, **kw):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), **kw).collect()}
    return [got[i] for i in range(len(texts))]


def changed(r, words, k, vocabulary):
    w = list(words)
    for i in r.sample(range(len(w)), k):
        w[i] = r.choice(vocabulary)
    return w


def dense(seed=5):
    """Long texts over a few frequent words, whose word SimHashes are all near each other, each with a near copy."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(40):
        w = [r.choice(vocabulary) for _ in range(400)]
        texts += [w, changed(r, w, 6, vocabulary)]
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("limit", [3, 2048])
def test_dense_vocabulary(spark, limit):
    texts = dense()
    want = jaccard_groups(texts)
    assert len(set(want)) == 40
    assert found_groups(spark, texts, bucket_limit=limit) == want


@pytest.mark.parametrize("limit", [2, 2048])
def test_reordered_texts(spark, limit):
    """Texts of the same distinct words in other orders: equal word SimHashes, but few of them are near copies."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(25):
        w = r.sample(base, len(base))
        i = r.randrange(len(w) - 1)
        texts += [" ".join(w), " ".join([*w[:i], w[i + 1], w[i], *w[i + 2 :]])]
    want = jaccard_groups(texts)
    assert len(set(want)) == 25
    assert found_groups(spark, texts, bucket_limit=limit) == want


def test_short_texts(spark):
    """A word more, a last word changed, one changed in the middle: on either side of 0.8, decided as brute force does."""
    r = random.Random(7)
    texts, n_pairs = [], 0
    for n in (5, 6, 9, 12, 15, 20, 30, 50):
        for _ in range(12):
            w = [f"v{r.randrange(5000)}" for _ in range(n)]
            texts += [w, [*w, "more"], [*w[:-1], "other"], [*w[: n // 2], "middle", *w[n // 2 + 1 :]]]
            n_pairs += 1
    # A sure near miss: one of fifty words changed twice over, 36 of 56 shingles shared.
    w = [f"v{i}" for i in range(50)]
    texts += [w, [*w[:15], "x", *w[16:35], "y", *w[36:]]]
    texts = [" ".join(t) for t in texts]
    want = jaccard_groups(texts)
    assert found_groups(spark, texts) == want
    assert want[-1] == len(texts) - 1


@pytest.mark.parametrize("limit", [2, 7, 2048])
def test_brute_force(spark, limit):
    """A mixture with chains of copies, boilerplate that most texts share, repeats and small limits."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    shared = [r.choice(vocabulary) for _ in range(25)]
    texts = []
    for i in range(60):
        w = [r.choice(vocabulary[: 20 + i * 3]) for _ in range(r.choice([1, 4, 8, 20, 60, 150]))]
        w = w + shared if i % 2 else w
        for _ in range(r.choice([1, 1, 2, 6])):
            texts.append(" ".join(w))
            w = changed(r, w, min(len(w), r.randint(0, 2)), vocabulary)
    want = jaccard_groups(texts)
    assert len(set(want)) < len(texts)
    assert found_groups(spark, texts, bucket_limit=limit) == want


def test_repeated_ids(spark):
    """An id that comes with a copy and with a text of its own loses only the copy."""
    word = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    copy = word("a") + " more"
    rows = [(1, word("a")), (2, copy), (2, word("b")), (3, word("c")), (3, word("d")), (4, word("e")), (4, word("e") + " more"), (4, word("e")), (None, word("a"))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert got == [(0, "a0"), (1, "a0"), (2, "b0"), (3, "c0"), (3, "d0"), (4, "e0")]


def test_frequent_keys_make_no_square(spark):
    """100,000 sets that share their least hash, and some of them more: rows stay in proportion, and no pair's meeting is lost."""
    ids = spark.range(100_000)
    hashes = F.array_sort(F.array_append(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.xxhash64("id", i)), F.lit(-(2**63)).cast("long")))
    nodes = ids.select(F.col("id").alias("node"), F.lit(300).cast("long").alias("n"), hashes.alias("keys"))
    keys = simhash._chosen_keys(nodes, 0.8, 2048).cache()
    met = simhash._in_cells(keys.select("node", F.explode("keys").alias("bucket")), 2048)
    assert keys.where(F.array_contains("keys", F.lit(-(2**63)).cast("long"))).count() == 0
    assert 20 * 100_000 <= met.count() <= 28 * 100_000
    keys.unpersist()


@pytest.mark.parametrize("limit", [5, 40])
def test_copies_among_texts_of_one_passage(spark, limit):
    """Texts that are a shared passage for a tenth, a half, or nearly all of them, each with a near copy."""
    r = random.Random(limit)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(100)]
    texts = []
    for own in (900, 400, 200, 100, 60, 30, 20, 8):
        for _ in range(12):
            w = [r.choice(vocabulary) for _ in range(own)]
            w = w[: own // 2] + passage + w[own // 2 :]
            texts += [" ".join(w), " ".join(changed(r, w, max(1, len(w) // 60), vocabulary))]
    want = jaccard_groups(texts)
    assert 60 < len(set(want)) < 140
    assert found_groups(spark, texts, bucket_limit=limit) == want
