"""Quality, main text, search, rollups and fixity against plain versions."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutloom.llm import boost, fixity, html, quality, rollups, search
from cutloom.llm.decontaminate import tokens

from .pages_by_hand import PAGES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# Quality.


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 9)))
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.8
        w = [word() for _ in range(r.randint(5, 80))]
        if not good:
            w = r.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "###" for x in w], lambda w: [w[0]] * len(w)])(w)
        rows.append((i, (" ".join(w) + ".")))
        labels.append((i, int(good), "x"))
    rows += [(900, None), (901, ""), (902, "y" * 100_000), (None, "no id"), (3, rows[3][1])]
    labels += [(900, None, "x"), (None, 1, "x"), (5, labels[5][1], "x"), (5000, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("mine"), "predicted": F.lit(0)}), spark.createDataFrame(labels, "doc_id long, quality int, score string"), labels


def test_quality_held_out(graded):
    docs, labels, truth = graded
    model = quality.train(docs, labels)
    got = quality.score(docs.withColumn("held_out", quality.held_out(F.col("doc_id"))), model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    want = {i: y for i, y, _ in truth if i is not None}
    held = [(want[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and want.get(r["doc_id"]) is not None and r["doc_id"] is not None]
    assert len(held) > 40
    assert np.mean([a == b for a, b in held]) > 0.95
    assert model.rules
    assert len(model.rules) < 200


def test_quality_column_is_the_model(graded, spark):
    docs, labels, _ = graded
    model = quality.train(docs, labels)
    for r in quality.score(docs.where("doc_id < 40"), model).collect():
        x = np.array([quality.statistics((r["text"] or "").encode())])
        total = model.base + sum(w * quality.holds([rule], x)[0, 0] for rule, w in model.rules)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def plain_statistics(text):
    """The statistics of a text, worked out character by character and word by word."""
    raw = text.encode()
    n, words = len(raw), raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    share = lambda chars: sum(raw.count(c) for c in chars.encode()) / n
    upper, lower = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122)))
    signs = b"#$%&*+/<=>@[\\]^_`{}~!|"
    pairs = [(words[i], words[i + 1]) for i in range(len(words) - 1)]
    return {
        "log_bytes": math.log(n + 1), "log_words": math.log(len(words) + 1), "word_length": sum(len(w) for w in words) / k / 20, "upper": upper / max(1, upper + lower), "digits": share("0123456789"),
        "marks": share(".,;:?'\"()-"), "symbols": share("#$%&*+/<=>@[\\]^_`{}~"), "exclaims": share("!"), "bars": share("|"), "spaces": share(" \t\n\r\x0b\x0c"), "non_ascii": sum(c > 127 for c in raw) / n,
        "log_lines": math.log(len(lines) + 1), "line_length": math.log(n / m + 1), "ended_lines": sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / m, "repeated_lines": 1 - len(set(lines)) / m,
        "distinct_words": len(set(words)) / k, "top_word": max((words.count(w) for w in set(words)), default=0) / k, "doubled_words": sum(a == b for a, b in pairs) / k, "shouted_words": sum(w.isupper() for w in words) / k,
        "marked_words": sum(w[-1] in signs for w in words) / k, "short_words": sum(len(w) < 4 for w in words) / k, "longest_word": math.log(max((len(w) for w in words), default=0) + 1), "bare_words": sum(w.isalpha() for w in words) / k,
        "distinct_pairs": len(set(pairs)) / k,
    }


def test_quality_against_plain_statistics(graded):
    """Scores out of statistics and rules that are worked out here."""
    docs, labels, _ = graded
    model = quality.train(docs, labels)
    for r in quality.score(docs.where("doc_id < 60 or doc_id in (900, 901)"), model).collect():
        got = plain_statistics(r["text"]) if r["text"] else dict.fromkeys(quality.STATISTICS, 0.0)
        assert list(got.values()) == pytest.approx(quality.statistics((r["text"] or "").encode()))
        total = model.base
        for rule, weight in model.rules:
            if all((got[quality.STATISTICS[f]] > v) == above for f, above, v in rule):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_quality_without_labels(graded):
    docs, labels, _ = graded
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert quality.score(docs, quality.train(docs, few)).count() == docs.count()
    assert quality.score(docs.limit(0), quality.train(docs, labels, sample_rows=50)).count() == 0


def test_rules_and_lasso():
    r = np.random.default_rng(2)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.7)).astype(float)
    _, trees = boost.fit(x, y, 20, 3, 0.2)
    assert np.mean((boost.predict(0.0, trees, x) > 0.5) == y) > 0.97
    model = quality.RuleEnsemble.fit(x, y, penalty=0.002)
    z = quality.holds([r for r, _ in model.rules], x) @ np.array([w for _, w in model.rules]) + model.base
    assert np.mean((z > 0) == y) > 0.97
    assert len(quality.RuleEnsemble.fit(x, y, penalty=0.05).rules) < len(model.rules)


# Main text.

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><script>var a="</p>"; if (a<b) {}</script><style>p{}</style></head>
<body><div class="cookie-banner">We use cookies. <button>OK</button></div><header class="masthead"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li><li><a href="/c">Gamma</a></li></ul></nav>
<article class="post"><h1>A title &amp; more</h1><p>First <b>bold</b>word, with  two   spaces &eacute; here. It goes on for a while, so that it is long.</p>
<p>Second paragraph<br>after a break, that has quite some words in it, too.<p>Third one is never closed, but has enough words to be text.
<aside class="related"><h3>Related</h3><a href="/x">Other article</a></aside></article>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree at all with what was written here.</p></div></div>
<footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""


def test_main_text_of_a_page():
    text = html.main_texts([PAGE], html.model())[0]
    assert text.startswith("A title & more First boldword, with two spaces é here.")
    assert "Second paragraph after a break" in text
    assert "Third one is never closed" in text
    for gone in ("Not this", "cookies", "Alpha", "agree", "rights", "Related", "var a"):
        assert gone not in text


def test_pages_by_hand():
    """Words of the main text of pages that people wrote; no page may go far wrong."""
    same = got_all = want_all = 0
    for source, want in PAGES:
        want, got = Counter(want.split()), Counter(html.main_texts([source], html.model())[0].split())
        n = sum((want & got).values())
        assert n > 0.85 * sum(want.values())
        assert n > 0.85 * sum(got.values())
        same, got_all, want_all = same + n, got_all + sum(got.values()), want_all + sum(want.values())
    assert same > 0.96 * got_all
    assert same > 0.96 * want_all


ROW = "<p>A sentence of the article stands here, and it has a few words more.</p>"


@pytest.mark.parametrize(
    "inner",
    [
        "<script src=/a.js/>var tracker=1;</script>", "<script>if (a<b) document.write('<p>tracker</p>')</SCRIPT >", "<style/>p{tracker}</style>", '<img alt="' + "<p>tracker</p>" * 80_000 + '">', "<a title='x>tracker' href=y>" + ROW + "</a>",
        "<iframe src=x/>tracker</iframe>", "<!-- <p>tracker</p> -->", "<svg/>", "<svg><title>tracker</title></svg>", "<!-->", "<!--->", "<select><option>tracker</select>", "</tracker x='>", '<p data-x = "a>tracker">',
    ],
)
def test_markup_stays_out(inner):
    page = html.Page(f"<article class=post>{ROW}{inner}{ROW}</article>")
    text = html.assemble(page, np.ones(len(page.tag), bool))
    assert "tracker" not in text
    assert text.count("stands here") == 2 + inner.count("stands here")


FRAMES = (
    "<html><body><nav><a href=1>Home</a><a href=2>News</a></nav><article class=post>%s</article><footer>Copyright</footer></body></html>",
    "<html><body><article>%s</article></body></html>",
    "<html><body><div id=nav><a href=1>Home</a></div><div class=content>%s</div><div class=footer>Copyright 2020</div></body></html>",
)


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<!-->after", "after"), ("<!--->", ""), ("<math><mi>x</mi><mo>=</mo><mn>5</mn><mspace/></math>", "x=5"), ("<object data=x>fallback words</object>", "fallback words"), ("<xmp>a <b> &amp; c</xmp>", "a <b> &amp; c"),
        ("<noscript>plain</noscript>", "plain"), ("<div>word</div>", "word"), ("<div>two words</div>", "two words"), ("<div><div><div>deep</div></div></div>", "deep"), ("<section>one</section>", "one"), ("<p>1</p>", "1"),
        ("<div class=q7>word</div>", "word"), ("<listing>ab</listing>", "ab"), ("<details><summary>more</summary>Text is here.</details>", "more Text is here."),
    ],
)
def test_nothing_of_an_article_is_lost(inner, want):
    """Short blocks, formulas, fallbacks, raw text and comments that end at once."""
    sentence = ROW[3:-4]
    for frame in FRAMES:
        for before, after in ((2, 2), (1, 4)):
            text = html.main_texts([frame % (ROW * before + inner + ROW * after)], html.model())[0]
            assert text.count(sentence) == before + after
            assert " ".join(text.replace(sentence, " ").split()) == want


class Plain(HTMLParser):
    """The text of a page by the standard library's parser."""

    HIDDEN = ("script", "style", "title", "textarea", "select", "svg")

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.hidden, self.stack, self.blocks = 0, [], [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in html._BLOCK:
            self.blocks.append("")
        if tag not in html._VOID:
            self.stack.append(tag)
            self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in html._BLOCK:
            self.blocks.append("")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                self.hidden -= sum(t in self.HIDDEN for t in self.stack[k:])
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not self.hidden:
            self.blocks[-1] += data

    def text(self):
        return " ".join(filter(None, (" ".join(b.split()) for b in self.blocks)))


def test_parse_and_assemble_against_a_plain_parser(spark):
    """All text of the smallest table's pages and of composed ones, and the article of each page by `extract`."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in pages:
        page = html.Page(r["html"])
        assert html.assemble(page, np.ones(len(page.tag), bool)) == Plain(r["html"]).text()
        article = re.search("<article.*</article>", r["html"], re.S)[0]
        assert got[r["page_id"]] == Plain(article).text()
    rng, n = random.Random(12), 0
    while n < 60:
        source = html._compose(rng)
        if re.search("<!-->|<xmp>", source):  # what the standard library reads otherwise
            continue
        n += 1
        page = html.Page(source)
        assert html.assemble(page, np.ones(len(page.tag), bool)) == Plain(source).text()


def test_deep_and_hostile_pages():
    deep = html.Page("<div>" * 5000 + ROW + "</div>" * 5000)
    assert max(html.features([deep])[:, 8 + html.N_TAGS + 3 * html.N_WORDS]) == 5002
    nested = "<article>" + "<section>" * 2000 + ROW + "</section>" * 2000 + "</article>"
    assert "stands here" in html.main_texts([nested], html.model())[0]
    for text in ("<a '" * 200_000 + ">", "<a " * 200_000, "<div>" * 50_000 + "</p>" * 50_000, "<" * 100_000, '<a b="' * 50_000, "<!--" * 50_000, "</" * 50_000):
        html.Page(text)


def test_features_of_many_pages_are_those_of_each():
    rng = random.Random(3)
    pages = [html.Page(html._compose(rng)) for _ in range(20)] + [html.Page("")]
    assert np.allclose(html.features(pages), np.concatenate([html.features([p]) for p in pages]))


def test_features_against_walks_over_the_tree():
    rng = random.Random(4)
    for _ in range(10):
        page = html.Page(html._compose(rng))
        got, n = html.features([page]), len(page.tag)
        under = [[j for j in range(n) if i in up(page, j)] for i in range(n)]
        for i in range(n):
            texts = [page.text[j].strip() for j in [i, *under[i]] if page.text[j] is not None]
            linked = [page.text[j].strip() for j in [i, *under[i]] if page.text[j] is not None and any(page.tag[k] == "a" for k in up(page, j))]
            assert got[i, 0] == pytest.approx(math.log1p(sum(map(len, texts))))
            assert got[i, 4] == pytest.approx(sum(map(len, linked)) / max(1, sum(map(len, texts))))
            assert got[i, 7] == pytest.approx(math.log1p(1 + len(under[i])))
            assert got[i, 8 + html.N_TAGS + 3 * html.N_WORDS] == len(up(page, i))
            sisters = [j for j in range(n) if page.parent[j] == page.parent[i]]
            assert got[i, 9 + html.N_TAGS + 3 * html.N_WORDS] == (sisters.index(i) if i else 0)


def up(page, i):
    out = []
    while (i := page.parent[i]) >= 0:
        out.append(i)
    return out


def test_held_out_pages():
    rng, tp, fp, fn = random.Random(77), 0, 0, 0
    fitted = html.model()
    for _ in range(120):
        source = html._compose(rng)
        page = html.Page(source)
        y, _ = html.truth(page)
        want, got = Counter(html.assemble(page, y).split()), Counter(html.main_texts([source], fitted)[0].split())
        same = sum((want & got).values())
        tp, fp, fn = tp + same, fp + sum(got.values()) - same, fn + sum(want.values()) - same
    assert tp / (tp + fp) > 0.93
    assert tp / (tp + fn) > 0.97


def test_decoding_has_no_contradictions():
    rng = random.Random(6)
    for seed in range(40):
        page = html.Page(html._compose(rng))
        keep = html.decode(page, np.random.default_rng(seed).random(len(page.tag)))
        below = [t is not None for t in page.text]
        some = [k and t is not None for k, t in zip(keep, page.text, strict=True)]
        for i in range(len(keep) - 1, 0, -1):
            assert not keep[i] or keep[page.parent[i]]
            below[page.parent[i]] |= below[i]
            some[page.parent[i]] |= some[i]
        assert all(some[i] or not keep[i] or not below[i] for i in range(1, len(keep)))


def test_extract_edge_cases(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>just some text without any frame around it, but a sentence.</p>"), (4, "x", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "y", "<a href=\"unclosed <p>text &am"), (6, "z", "<p>" + "long words here. " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("a")})
    got = html.extract(df).collect()
    assert [r["page_id"] for r in got] == [r[0] for r in rows]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert got[0]["text"] == got[1]["text"]
    assert got[2]["text"] == got[3]["text"] == ""
    assert html.extract(df.limit(0)).count() == 0


# Search.


TOKEN = re.compile("[぀-ヿ㐀-鿿]|[^\\W_぀-ヿ㐀-鿿]+")


def plain_bm25(rows, queries, k):
    bag = [(i, Counter(TOKEN.findall((t or "").lower()))) for i, t in rows]
    n, mean = len(bag), sum(sum(b.values()) for _, b in bag) / len(bag)
    df = Counter(w for _, b in bag for w in b)
    out = {}
    for q, t in queries:
        ask = Counter(TOKEN.findall((t or "").lower()))
        scores = []
        for i, b in bag:
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, c in ask.items() if w in b)
            if s > 0:
                scores.append((-round(s, 6), i if i is not None else -1))
        out[q] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize(("shard", "block"), [({}, 16 << 20), ({"docs_per_shard": 40}, 300), ({"tokens_per_shard": 500}, 16 << 20)])
def test_search(spark, docs, rows, shard, block):
    plain = [(i, t) for i, t, *_ in rows]
    asked = [(i, t) for i, t in plain if i is not None and i % 13 == 0] + [(1001, None), (1002, "zzzz nothing"), (1003, rows[3][1].split()[0])]
    queries = spark.createDataFrame([*asked, (0, asked[0][1]), (None, "one")], "query_id long, text string")
    got = defaultdict(list)
    index = search.build_index(docs.withColumns({"n_docs": F.lit(1), "terms": F.lit("x")}), **shard)
    assert index.agg(F.sum("n_docs")).first()[0] == len(rows)
    for r in search.search(index, queries, 7, block).collect():
        got[r["query_id"]].append((r["rank"], -round(r["score"], 6), r["doc_id"] if r["doc_id"] is not None else -1))
    want = plain_bm25(plain, asked, 7)
    for q, best in want.items():
        assert [x[1:] for x in sorted(got.get(q, []))] == best, q
    assert set(got) == {q for q, b in want.items() if b}


def shard_of(texts, ids):
    lengths = np.array([len(t) for t in texts])
    return search.Shard(search._index_shard(ids, np.concatenate(texts).astype(np.uint64), lengths), lengths.mean())


def made_shard(n=4000, seed=4):
    """Texts of words drawn by Zipf's law, most of a topic's own range, as one shard."""
    r = np.random.default_rng(seed)
    topics = r.integers(0, 40, n)
    texts = [np.where(r.random(60) < 0.5, r.zipf(1.3, 60) % 5000, 10_000 + 300 * t + r.zipf(1.5, 60) % 300) for t in topics]
    return shard_of(texts, r.permutation(n)), texts


def asked_of(shard, text):
    q, c = np.unique(text, return_counts=True)
    df = np.array([shard.df[np.searchsorted(shard.terms, t)] if t in shard.terms else 0 for t in q])
    order = np.lexsort((q, df))
    return q[order].astype(np.uint64), (np.log(1 + (shard.n_docs - df + 0.5) / (df + 0.5)) * c)[order], df.sum()


def searched(shard, queries):
    """Share of the queries' postings that are read, lists of frequent terms included; every answer is that of a full scan."""
    total = 0
    for text in queries:
        q, w, n = asked_of(shard, text)
        before, total = shard.read, total + n
        a = shard.top(q, w, 10)
        read = shard.read
        b = shard.top(q, w, 10, prune=False)
        shard.read = read
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        assert read > before
    return shard.read / total


def test_pruning_keeps_the_best():
    shard, texts = made_shard()
    assert searched(shard, [np.append(t, 99_999) for t in texts[:60]]) < 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_pruning_on_the_tables():
    """Whole documents as queries, over all documents of the bench: under half of their terms' postings are read."""
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    tok, ends = tokens(table.column("text").combine_chunks())
    ids = table.column("doc_id").to_numpy()
    texts = np.split(tok, ends[:-1])
    shard = search.Shard(search._index_shard(ids, tok.copy(), np.diff(ends, prepend=0)), len(tok) / len(ids))
    assert searched(shard, [texts[i] for i in np.flatnonzero(ids % 100 == 0)]) < 0.5


def test_block_maxima_bound_all_impacts():
    shard, _ = made_shard(900)
    at, n = shard._postings(np.arange(len(shard.n)))
    doc, impact, entry = shard.doc[at], shard.impact[at], np.repeat(np.arange(len(shard.n)), n)
    assert (impact <= shard.most[entry] + 1e-12).all()
    assert (doc // search.BLOCK == shard.block[entry]).all()
    r = shard.rows(np.array([np.argmax(shard.df)]))[0]
    x, top = shard.dense[r], shard.tops[r]
    assert (np.maximum.reduceat(x, np.arange(0, len(x), search.BLOCK)) <= top + 1e-12).all()
    assert (x > 0).sum() == shard.df.max()


def test_one_text_has_one_score_in_all_shards():
    r = np.random.default_rng(7)
    same = r.choice(60, 80)
    found = []
    for n in (50, 700, 3000):
        texts = [same, *(r.choice(np.arange(20 + n // 10), 80) for _ in range(n))]
        shard = search.Shard(search._index_shard(np.arange(n + 1), np.concatenate(texts).astype(np.uint64), np.full(n + 1, 80)), 80.0)
        ids, scores = shard.top(np.arange(60, dtype=np.uint64), np.sqrt(np.arange(60) + 2.0)[::-1], 5)
        found.append(scores[ids.tolist().index(0)])
    assert found[0] == found[1] == found[2]


def test_search_of_nothing(docs, empty):
    q = docs.select(F.col("doc_id").alias("query_id"), "text")
    assert search.search(search.build_index(empty), q, 3).count() == 0
    assert search.search(search.build_index(docs), q.limit(0), 3).count() == 0


# Rollups.


def test_rollups(spark, docs, rows, tmp_path):
    book = rollups.TokenRollup(spark, f"{tmp_path}/book")
    assert book.totals().count() == 0
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    known = {}
    for i, t, la, s, _ in rows:
        if i is not None:  # of a repeated id the largest count, then the last key
            known[i] = max(known.get(i, ((-1, "", "", ""), "")), ((words(t or ""), s or "", la or "", ""), (t, la, s)))
    known = [(i, *v[1]) for i, v in known.items()]
    assert book.commit("1", rollups.word_counts(docs))

    def totals():
        return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in book.totals().collect()}

    def plain(count, version, gone=()):
        out = defaultdict(lambda: [0, 0])
        for i, t, la, s in known:
            if i not in gone:
                out[s, la, version][0] += 1
                out[s, la, version][1] += count(t or "")
        return {k: tuple(v) for k, v in out.items()}

    unique = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert totals() == plain(words, "words-1")
    assert not book.commit("1", rollups.word_counts(docs))
    inner = Tokenizer.from_file(TOKENIZER)
    ids = lambda t: len(inner.encode(t, add_special_tokens=False).ids)
    chosen = spark.createDataFrame([(i, t, la, s) for i, t, la, s in known], "doc_id long, text string, lang string, source string")
    for _ in range(2):
        book.commit("2", rollups.tokenizer_counts(chosen, TOKENIZER, "bpe"))
    assert totals() == plain(ids, "bpe")
    gone = spark.createDataFrame([("delete", 3, None, None, None, 0), ("delete", 99999, None, None, None, 0), ("revise", 4, "hot", "en", "bpe", None), ("other", 5, None, None, None, 1), ("insert", None, "a", "b", "c", 1)], "op string, doc_id long, source string, lang string, version string, tokens long")
    book.commit("3", gone)
    want = plain(ids, "bpe", {3, 4})
    want["hot", "en", "bpe"] = (want.get(("hot", "en", "bpe"), (0, 0))[0] + 1, want.get(("hot", "en", "bpe"), (0, 0))[1])
    assert totals() == want
    spark.range(1).select(F.lit(1).alias("x")).write.parquet(f"{tmp_path}/book/entries/4")
    assert book.commit("4", gone.limit(0))
    assert book.committed() == ["1", "2", "3", "4"]
    assert book.compact("5")
    assert not book.compact("5")
    assert totals() == want
    assert not book.commit("2", gone)
    assert book.commit("6", spark.createDataFrame([("delete", 4)], "op string, doc_id long").select("*", *[F.lit(None).alias(c) for c in ("source", "lang", "version", "tokens")]))
    assert totals() == plain(ids, "bpe", {3, 4})
    with pytest.raises(ValueError, match="name"):
        book.commit("../x", gone)


# Fixity.


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'é' * (i % 50)} {i}</p>") for i in range(1500)] + [(None, None, None), (7, "http://x/7", "<p>again</p>"), (8, None, "")], "page_id long, url string, html string").withColumn("record", F.lit("mine"))
    records = fixity.warc_records(pages, 512)
    places = fixity.manifest(records).cache()
    assert records.count() == places.count() == 1503
    want = defaultdict(list)
    for r in records.collect():
        assert r["record"].startswith("WARC/1.0\r\n")
        want[r["segment"]].append((-1 if r["page_id"] is None else r["page_id"], hashlib.sha256(r["record"].encode()).hexdigest(), len(r["record"].encode())))
    got = defaultdict(list)
    for r in places.orderBy("segment", "position").collect():
        got[r["segment"]].append((r["position"], -1 if r["page_id"] is None else r["page_id"], r["digest"], r["offset"], r["length"]))
    for seg, found in got.items():
        at, plain = 0, []
        for i, (page, digest, n) in enumerate(sorted(want[seg])):
            plain.append((i, page, digest, at, n))
            at += n
        assert found == plain
    same, compared = fixity.audit(places, places)
    assert same.count() == 0
    assert max(compared[1:]) == 0
    hurt = places.withColumn("digest", F.when(F.col("page_id") == 700, F.lit("0")).when(F.col("page_id") == 701, F.lit(None)).otherwise(F.col("digest"))).withColumn("hash", F.lit("mine"))
    hurt = hurt.withColumn("offset", F.when(F.col("page_id") == 900, F.col("offset") + 1).otherwise(F.col("offset"))).where("page_id is null or page_id <> 1200").drop("hash")
    hurt = hurt.union(spark.createDataFrame([(9, 0, 5000, 0, 3, "new")], "segment long, position long, page_id long, offset long, length long, digest string"))
    found, compared = fixity.audit(places, hurt)
    got = {r["page_id"]: r for r in found.collect()}
    assert {k: r["finding"] for k, r in got.items()} == {700: "corrupt", 701: "corrupt", 900: "moved", 1200: "missing", 5000: "extra"}
    record = records.where("page_id = 700").first()["record"]
    assert got[700]["expected_digest"] == hashlib.sha256(record.encode()).hexdigest()
    assert got[700]["actual_digest"] == "0"
    assert got[701]["actual_digest"] is None
    assert sum(compared) < 250
    assert fixity.audit(places.limit(0), places.limit(0))[0].count() == 0
    assert fixity.audit(places.limit(0), places.where("segment = -1"))[0].count() == 1
    assert fixity.manifest(records.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        fixity.audit(places, places.union(places.where("page_id = 3")))


def test_one_segment_over_many_tasks(spark):
    """One segment holds all records, a third of them repeats of one row without an id."""
    pages = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("html"))
    places = fixity.manifest(fixity.warc_records(pages, segment=F.lit(4))).orderBy("position").collect()
    assert [r["position"] for r in places] == list(range(3000))
    ends = np.cumsum([r["length"] for r in places])
    assert [r["offset"] for r in places] == [0, *ends[:-1].tolist()]
    ids = [-1 if r["page_id"] is None else r["page_id"] for r in places]
    assert ids == sorted(ids)


def test_leaf_and_parent_hashes(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    places = spark.createDataFrame([(0, i, i, i * 2, 2, h(f"r{i}")) for i in range(20)], "segment long, position long, page_id long, offset long, length long, digest string")
    levels = fixity.tree(fixity.leaves(places), 2, 0)
    leaf = [h(f"{i * 2}:{i * 2 + 2}:{h(f'r{i}')}") for i in range(20)]
    mid = [h(",".join(f"{i}:{i * 2}:{i * 2 + 2}:{leaf[i]}" for i in part)) for part in (range(16), range(16, 20))]
    assert {r["hash"] for r in levels[1].collect()} == set(mid)
    assert levels[2].first()["hash"] == h(f"0:0:32:{mid[0]},1:32:40:{mid[1]}")


def test_utf8_arrow_roundtrip():
    from cutloom.llm.common import slices, utf8

    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "é" * 100, ""] * 50)], names=["text"])
    parts = list(slices(iter([batch]), "text", 7, 300))
    assert [x for p in parts for x in utf8(p.column("text"))] == [b"a", b"", ("é" * 100).encode(), b""] * 50
    assert max(p.num_rows for p in parts) <= 7
