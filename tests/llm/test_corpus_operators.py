"""Jaccard join, suffix tree and page text against brute force; the pipeline stage by stage."""

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, ODD_TEXTS, documents, lower_words
from tests.oracle import expected, rows
from twinweave.llm import html_blocks, jaccard_join, shingles, suffix_tree
from twinweave.llm.common import table
from twinweave.llm.components import components
from twinweave.llm.oracles import ORACLE_SQL
from twinweave.llm.queries import QUERIES

# ---- Jaccard join


def plain_set(text):
    w = lower_words(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_force(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed=0):
    """Groups of edited copies with similarities on both sides of the limit, and passages that many share."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    passage = rng.choice(vocab, 60).tolist()
    for size in (5, 9, 24, 60, 150, 400):
        base = rng.choice(vocab, size).tolist()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, size // 8, size // 5):
            text = list(base)
            for _ in range(edits):
                text[rng.integers(0, size)] = str(rng.choice(vocab))
            out.append(" ".join(text))
            out.append(" ".join(text[: max(1, size - edits)]).upper())
        out.append(" ".join(passage + rng.choice(vocab, size).tolist()))
    return out


def test_join_equals_brute_force(spark):
    texts = [*near_copies(), *ODD_TEXTS]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(documents(spark, texts, extra=["node", "sig", "sketch", "n", "component"])).collect()}
    assert got == brute_force(texts)


def test_hot_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 300, 60)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(0, 60))] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(t))
    texts += [texts[0]] * 40
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(documents(spark, texts)).collect()}
    assert got == brute_force(texts)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in (6, 7, 8, 13, 20, 27, 33, 60, 100, 250, 900):
        for _ in range(12):
            a = set(rng.integers(0, 2**63, size).tolist())
            gone = int(rng.integers(0, size // 6 + 1))
            b = set(list(a)[gone:]) | set(rng.integers(0, 2**63, int(rng.integers(0, size // 6 + 1))).tolist())
            if shingles.linked(len(a), len(b), len(a & b)) and a != b:
                value = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
                row, sig = shingles.signatures(value, np.array([0, len(a), len(a) + len(b)]))
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_join_against_sql(spark, sf):
    name = "op10_jaccard_join"
    assert rows(QUERIES[name](spark, sf).toPandas()) == expected(ORACLE_SQL[name], sf)


def test_join_edges(spark):
    assert jaccard_join.join(documents(spark, ODD_TEXTS).limit(0)).count() == 0
    text = "one two three four five six"
    same = documents(spark, [text, "other words that stand alone here", text, text], ids=[5, 5, None, 3])
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.join(same).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (None, 3)]
    kept = jaccard_join.keep_one(documents(spark, [text, text, "", None, "x", "x"], extra=["w", "p", "hit"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 100), (100, 300), (9, 9)], "a long, b long")
    assert dict(components(edges).collect()) == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def five_word_groups(texts):
    """The smallest index of each text's group: 5-word shingles, Jaccard 0.8."""
    sets = []
    for t in texts:
        w = lower_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return sets, root


def test_stage_joins_by_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "new", *base[31:]]  # 51 of 61 shingles, 0.836; of four words 53 of 61
    nearer = [*base[:-6], *(f"v{i}" for i in range(6))]  # 50 of 62, 0.806; of four words 51 of 63, 0.810
    texts = [*near_copies(3), " ".join(base), " ".join(near), " ".join(nearer)]
    sets, root = five_word_groups(texts)
    assert root[-1] == root[-2] == root[-3] == len(texts) - 3
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, corpus_pipeline.STAGE_MEASURE).collect()}
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, r in enumerate(root) if r == i or not sets[i])
    # the query's own measure stays
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()} == brute_force(texts)


# ---- suffix tree


def test_base_scores_and_gain(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in suffix_tree.score(docs).collect()}
    texts = {r["doc_id"]: lower_words(r["text"]) + ["\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_distributions_sum_to_one(spark, sf):
    """In every retained state, the probabilities of all training words and of one unknown word."""
    tree, words = suffix_tree.train(table(spark, sf, "documents"))
    counts = words.toPandas()["c"].to_numpy()
    rare = counts[counts < max(1.0, suffix_tree.FREQUENT * tree.total)]
    frequent = np.arange(len(tree.words))
    rest = (rare.sum() + len(rare) + 1) / (tree.total + tree.kinds + 1)
    rng = np.random.default_rng(0)
    checked = 0
    for c in rng.permutation(np.flatnonzero(tree.weight[1] > 0))[:20]:
        inner = tree.contexts[1][c] & ((1 << 20) - 1)
        first = suffix_tree.find(tree.contexts[0], np.array([inner]))[0]
        states = [np.full(len(frequent) + 1, first), np.full(len(frequent) + 1, c)]
        p = tree.probability(2, np.append(frequent, -1), states)
        assert p[:-1].sum() + p[-1] * rest == pytest.approx(1.0)
        checked += 1
    assert checked


def test_suffix_tree_edges(spark):
    docs = documents(spark, [*ODD_TEXTS, "the cat sat on the mat"] * 3, extra=["h", "m", "rid", "c"], ids=[*range(40), None, 7, 7, 7, None, 3, 3, 3])
    got = suffix_tree.score(docs).collect()
    assert len(got) == 48 and all(r["score"] <= 1e-9 and r["base_score"] <= 0 for r in got)
    assert suffix_tree.score(docs.limit(0)).count() == 0
    none = documents(spark, ["a b", None], ids=[None, None])
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in suffix_tree.score(none).collect()} == {(0, 0.0, 0.0)}


def plain_scores(texts, held, depth):
    """The scores with all counts in dictionaries."""
    counts = [Counter() for _ in range(depth + 1)]
    for i, t in texts.items():
        for k in range(depth + 1):
            counts[k].update(tuple(t[j : j + k + 1]) for j in range(len(t) - k) if not held[i])
    n, v = sum(counts[0].values()), len(counts[0])
    weights, after = {}, defaultdict(dict)
    for k in range(1, depth + 1):
        for gram, c in counts[k].items():
            if c >= suffix_tree.LEAST:
                after[gram[:-1]][gram[-1]] = c

    def p(context, w):
        if not context:
            return (counts[0][(w,)] + 1) / (n + v + 1)
        inner = p(context[1:], w)
        if not weights.get(context):
            return inner
        return weights[context] * after[context].get(w, 0) / sum(after[context].values()) + (1 - weights[context]) * inner

    for context in sorted(after, key=len):
        follow, size = after[context], counts[len(context) - 1][context]
        stored, types = sum(follow.values()), len(follow)
        weight = stored / (size + types)
        gain = 2 * sum(c * math.log(weight * c / stored / p(context[1:], w) + 1 - weight) for w, c in follow.items()) + 2 * (size - stored) * math.log1p(-weight)
        if gain > types + 3 * math.sqrt(2 * types):
            weights[context] = weight
    assert any(len(c) == depth for c in weights)
    return {i: sum(math.log10(p(tuple(t[max(0, j - depth) : j]), w)) for j, w in enumerate(t)) for i, t in texts.items()}


@pytest.mark.parametrize("frequent", [1e-6, 3e-3])
def test_rare_contexts_count_as_frequent_ones_do(spark, monkeypatch, frequent):
    """Whether a gram is broadcast or joined makes no difference; nothing below a share of the corpus is left out."""
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    phrases = [" ".join(f"w{x}" for x in rng.integers(0, 40, 6)) for _ in range(12)]
    docs = documents(spark, [" ".join(phrases[x] if x < 12 else f"w{rng.integers(0, 60)}" for x in rng.integers(0, 40, 30)) for _ in range(80)])
    texts = {r["doc_id"]: lower_words(r["text"]) + ["\n"] for r in docs.collect()}
    want = plain_scores(texts, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}, 3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, 3).collect()}
    assert got == {i: pytest.approx(s) for i, s in want.items()}


# ---- pages


def test_training_table_is_learned():
    x, y = html_blocks.table_of(html_blocks.labelled_pages())
    tree = html_blocks.default_tree()
    assert sum(tree.predict(r) == v for r, v in zip(x.tolist(), y.tolist(), strict=True)) > 0.995 * len(y)


def article_text(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner[1])]
    return "\n\n".join(p for p in parts if p)


def test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    got = html_blocks.extract_pages(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_page_edges(spark):
    cases = {
        None: "",
        "": "",
        "<html><head><title>t</title><script>if (a < b) '</p>'</script></head></html>": "",
        "<article><p>Tom &amp; Jerry&nbsp;\n are &lt;b&gt; here</p><p>second": "Tom & Jerry are <b> here\n\nsecond",
        "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
        '<article><h1>T</h1><p>one</p><section class="comments"><p>first!</p></section></article>': "T\n\none",
        '<nav><a href="#">x</a></nav><article><p>main text</p></article><aside><p>other</p></aside><footer>f</footer>': "main text",
        "<article><p>a<!-- hidden <p>no</p> -->b</p><style>p{}</style><form><p>Name</p></form></article>": "ab",
        '<div class="cookie-banner"><p>We use cookies</p></div><main><p>the text</p></main>': "the text",
    }
    frame = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract_pages(frame).collect()}
    assert got == dict(enumerate(cases.values()))
    assert html_blocks.extract_pages(frame.limit(0)).count() == 0
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    assert html_blocks.extract(long).count("\n\n") == 19999


@pytest.mark.parametrize(
    "tag",
    [
        """<p title="it's">""",
        """<p title='say "hi'>""",
        """<p data-x=it's>""",
        """<p data-x = "a > b" title="it's > that">""",
        '<p data-x="' + "a > b, it's " * 1000 + '">',
    ],
)
def test_quotes_in_attributes(tag):
    """Quotes of the other kind inside a value, and values of any length, neither swallow text nor leak into it."""
    assert html_blocks.extract(f"<article>{tag}Hello don't go</p><p>second</p></article>") == "Hello don't go\n\nsecond"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><body><article><p>one</p><p>two</p></article>",
        "<html><head><title>t</title><meta charset=x><article><p>one</p><p>two</p></article>",
        "<html><head><title>t</title><noscript><style>x{}</style><body><article><p>one</p><p>two</p></article>",
        *(f"<article><div><{x}>gone</div><p>one</p><p>two</p></article>" for x in ("noscript", "svg", "select", "button", "object", "canvas", "audio", "video", "iframe", "template")),
        "<article><p>one</p><svg><path d='M0'><text>gone</text><p>two</p></article>",
        "<article><p>one</p><svg><foreignObject><p>gone</p></foreignObject></svg><p>two</p></article>",
        "<article><p>one</p><noscript><p>gone</p><noscript>gone</noscript></noscript><script>'</p>'</script><p>two</p></article>",
        "<article><p>one</p><video><source src=x><p>gone</video><p>two</p></article>",
    ],
)
def test_unclosed_silent_elements_end_with_their_parent(page):
    assert html_blocks.extract(page) == "one\n\ntwo"


def test_a_quote_that_never_closes_loses_no_text():
    assert html_blocks.extract('<article><p title="open>Hello</p><p>second</p></article>') == "Hello\n\nsecond"


# ---- pipeline


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and result on a table with copies, junk and secrets."""
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    clean = docs.orderBy("doc_id").limit(5)
    more = clean.withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" token = Zk3vQ9xR7tLw2Bn8YcJ5")))
    docs = docs.select(*docs.columns).unionByName(more.select(*docs.columns))
    out, now = {}, docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, sf_dir).cache()
        out[name] = (now, made)
        now = made
    return out


def test_stages_return_documents(stages):
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.dtypes == before.dtypes, name


def test_quality_stage_keeps_good_ones(spark, stages):
    before, after = stages["quality"]
    labels = table(spark, "/root/testdata/sf0.001", "labels").where("quality = 1").select("doc_id")
    good = before.join(labels, "doc_id", "left_semi").count()
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.95 * good and after.count() < before.count()


def test_duplicates_stage_leaves_one_of_each(stages):
    before, after = stages["near_duplicates"]
    rows_ = sorted((r["doc_id"], r["text"]) for r in before.collect())
    found = brute_force([t for _, t in rows_])
    ids = [i for i, _ in rows_]
    want = {ids[k] for k, (n, root) in found.items() if n == 0 or root == k}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_secret_stage_and_tokens(stages):
    before, after = stages["secrets"]
    assert after.count() == before.count() and after.where("text like '%Zk3vQ9xR7tLw2Bn8YcJ5%'").count() == 0
    mixed, tokens = stages["tokens"]
    assert tokens.count() == mixed.count() and tokens.where("size(ids) <> n_tokens").count() == 0
    taken = defaultdict(int)
    for r in stages["mix"][1].groupBy("doc_id").count().collect():
        taken[r["doc_id"]] = r["count"]
    assert max(taken.values()) <= 2


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 100


def _template(n, share, size=900, seed=3):
    """Texts of one template: each keeps a share of its words; neighbours are near, none is linked."""
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    out = []
    for k in range(n):
        words, at = list(base), 0
        while at < size:  # single words replaced, a few shingles each
            words[at] = f"own{k}x{at}"
            at += rng.randrange(int(share / 2), int(share * 1.5))
        out.append(" ".join(words))
    return out


def test_near_but_unlinked_texts_leave_no_pairs(spark, monkeypatch):
    """Of texts of one template that stay below the limit, candidates grow in proportion to the texts, not to their pairs."""
    from twinweave.llm import shingles

    left = []
    kept = jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *a: left.append(kept(*a).count()) or kept(*a))
    for n in (100, 200):
        texts = _template(n, 66)
        sets = [set(zip(*[t.split()[i:] for i in range(4)], strict=False)) for t in texts[:6]]
        likeness = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
        assert 0.7 < min(likeness) and max(likeness) < shingles.NUM / shingles.DEN
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert all(r["component_id"] == r["doc_id"] for r in jaccard_join.join(frame).collect())
    assert left[1] <= 2 * left[0] + 200, left
