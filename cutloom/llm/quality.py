"""Quality classifier: a sparse rule ensemble that is compiled into Spark columns.

Shallow boosted trees are grown over text statistics of a bounded, labelled sample; every path from a
root becomes a rule, a conjunction of comparisons; a logistic regression with an L1 penalty over all
rules keeps a few of them (Friedman and Popescu, 2008). The rules that stay are one Column expression.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import unused, utf8

#: Statistics of a text, all between 0 and 1 or logarithms; an empty text has zero everywhere.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "exclaims", "bars", "spaces", "non_ascii", "log_lines", "line_length", "ended_lines", "repeated_lines", "distinct_words", "top_word",
    "doubled_words", "shouted_words", "marked_words", "short_words", "longest_word", "bare_words", "distinct_pairs",
)

_CLASS = np.zeros((256, 8), np.float64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|", b" \t\n\r\x0b\x0c")):
    _CLASS[list(_set), _i] = 1


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, mark, symbol, exclaim, bar, space = (counts @ _CLASS).tolist()
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    often = Counter(words)
    last = Counter(w[-1] for w in words)
    sign = sum(v for c, v in last.items() if c in b"#$%&*+/<=>@[\\]^_`{}~!|")
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k / 20, upper / max(1, upper + lower), digit / n, mark / n, symbol / n, exclaim / n, bar / n, space / n, int(counts[128:].sum()) / n,
        np.log1p(len(lines)), np.log1p(n / m), sum(x.rstrip()[-1] in b".!?:\"" for x in lines) / m, 1 - len(set(lines)) / m, len(often) / k, max(often.values(), default=0) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, sum(map(bytes.isupper, words)) / k, sign / k, sum(len(w) <= 3 for w in words) / k, np.log1p(max(map(len, words), default=0)), sum(map(bytes.isalpha, words)) / k,
        len(set(zip(words, words[1:], strict=False))) / k,
    ]


def _all_statistics(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(t) for t in utf8(texts)], np.float64).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))


def text_statistics(text: str) -> Column:
    """The statistics of a text column as a struct."""
    kind = "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">"
    return F.arrow_udf(_all_statistics, kind)(F.col(text))


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(trees: list[boost.Tree]) -> list[Rule]:
    """Every path of every tree as (statistic, above, threshold) terms; only the tightest term on each side counts."""
    found: dict[Rule, None] = {}
    for t in trees:
        paths: dict[int, Rule] = {0: ()}
        for i in range(len(t.feature)):
            if i not in paths:
                continue
            if i:
                tight: dict[tuple[int, bool], float] = {}
                for f, above, v in paths[i]:
                    tight[f, above] = (max if above else min)(v, tight.get((f, above), v))
                found[tuple(sorted((f, a, v) for (f, a), v in tight.items()))] = None
            if t.feature[i] >= 0:
                term = int(t.feature[i]), float(t.threshold[i])
                paths[2 * i + 1] = (*paths[i], (term[0], False, term[1]))
                paths[2 * i + 2] = (*paths[i], (term[0], True, term[1]))
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, above, v in rule:
            out[:, j] *= (x[:, f] > v) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean log loss plus penalty * |w|; the intercept is free."""
    n, k = z.shape
    mean = z.mean(0)
    scale = np.maximum(z.std(0), 0.05)
    a = (z - mean) / scale
    lip = 0.25 * (np.linalg.norm(a, 2) ** 2 / max(1, n) + 1)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        w2 = v - a.T @ r / n / lip
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / lip, 0)
        b2 = c - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    return b - float(w @ mean), w


class RuleEnsemble:
    def __init__(self, base: float, rules: list[tuple[Rule, float]]):
        self.base, self.rules = base, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.001) -> RuleEnsemble:
        if len(y) == 0 or y.min() == y.max():
            p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
            return cls(float(np.log(p / (1 - p))), [])
        rules = tree_rules(boost.fit(x, y, trees, depth, 0.15, least=max(1.0, len(y) / 2000), share=0.7)[1])
        z = holds(rules, x)
        varied = np.flatnonzero(z.std(0) > 0)
        base, w = lasso_logistic(z[:, varied], y, penalty)
        return cls(base, [(rules[varied[j]], float(w[j])) for j in np.flatnonzero(np.abs(w) > 1e-4)])

    def column(self, stats: str) -> Column:
        """The score as one Spark expression over a struct column of statistics."""
        total = F.lit(self.base)
        for rule, w in self.rules:
            test = None
            for f, above, v in rule:
                c = F.col(f"{stats}.{STATISTICS[f]}")
                one = c > v if above else c <= v
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text is divisible by 5. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000) -> RuleEnsemble:
    """Fits the ensemble on a sample of about `sample_rows` labelled ids, drawn by a hash of the id.

    Held-out ids, null ids and null labels are not used; an id with several labels takes their majority,
    one with several texts the least of their statistics. Without labels, or with labels of one kind, all
    texts score alike. Only the sample's statistics reach the driver, a row for each id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("y", "doc_id", text_statistics("text").alias("s")).select("y", "doc_id", "s.*")
    one = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(*STATISTICS)).alias("s")).select("y", "doc_id", "s.*")
    got = one.toPandas().sort_values(["doc_id", *STATISTICS])
    return RuleEnsemble.fit(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= threshold).

    Only the text is looked at, whole, however long. Null and empty texts get the score of all-zero
    statistics; repeated rows score alike; columns named score or predicted are replaced; an empty table stays empty.
    """
    inner = unused("statistics", docs)
    marked = docs.drop("score", "predicted").withColumn(inner, text_statistics("text")).withColumn("score", model.column(inner))
    return marked.drop(inner).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
