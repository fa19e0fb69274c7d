import itertools
import math
import random

from rivermark.llm import html_extract, html_pages, tokens, toxicity
from tests.llm.conftest import ODD


def best_cut(word, scores, floor):
    """Best (score, tokens) over all ways to cut a word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * floor, -(best[end - 1][1] + size))]
        options += [(best[b][0] + scores[word[b:end]], -(best[b][1] + 1)) for b in range(end) if word[b:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark, rows_of):
    scores = tokens.zipf_scores(tokens.default_vocabulary())
    floor = min(scores.values()) - 1.0
    pairs = ODD + [(40, "thinking thinker think the thinkable 東京 naïve"), (41, "a" * 300)]
    want = []
    for i, t in pairs:
        words = [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        cost = {w: best_cut(tokens.MARK + w, scores, floor) for w in set(words)}
        want.append((i, sum(cost[w] for w in words), len(words)))
    got = tokens.count_tokens(rows_of(pairs), tokens.default_vocabulary()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokens.count_tokens(rows_of([]), tokens.default_vocabulary()).count() == 0


def test_token_scores_are_a_parameter(monkeypatch):
    import pyarrow as pa

    scores = {"▁a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -1.9, "c": -2.0, "abc": -9.0, "▁": -3.0}
    monkeypatch.setattr(tokens, "KNOWN", 2)
    counter = tokens.Counter(scores)
    words = ["ab", "abc", "b", "a", "abab", "zé"]
    want = [best_cut(tokens.MARK + w, scores, -10.0) for w in words]
    for _ in range(2):
        assert counter.count(pa.array(words))[0].tolist() == want


def toxic_set(spark, n=400):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{r.choice('abcdefghij')}{r.choice('klmnop')}" for _ in range(30)]
        toxic = r.random() < 0.3
        if toxic:
            words[:2] = r.sample(["idiot", "scum", "trash", "moron"], 2)
        # The group is named in toxic examples far more often than in others.
        if r.random() < (0.8 if toxic else 0.05):
            words[2] = "muslim"
        elif r.random() < 0.3:
            words[2] = "christian"
        r.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_free_neutral_mentions(spark):
    docs, labels = toxic_set(spark)
    neutral = spark.createDataFrame([(1, "the muslim neighbour wak wal"), (2, "the christian neighbour wak wal"), (3, "idiot scum trash")], "doc_id long, text string")
    plain, fair = (toxicity.train(docs, labels, swap=s) for s in (0.0, toxicity.SWAP))
    gap = {}
    for name, model in (("plain", plain), ("fair", fair)):
        s = {r.doc_id: r.score for r in toxicity.score(neutral, model).collect()}
        gap[name] = abs(math.log(s[1] / (1 - s[1])) - math.log(s[2] / (1 - s[2])))
        assert s[3] > 0.9
    assert gap["fair"] < 0.2 * gap["plain"] and gap["plain"] > 1


def test_toxicity_odd_rows(spark, rows_of):
    docs, labels = toxic_set(spark)
    model = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    got = toxicity.score(rows_of(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 < r.score < 1 for r in got)
    none = toxicity.toxicity(rows_of(ODD), labels.limit(0)).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in none) and not [r for r in none if r.doc_id is None and r.held_out]
    assert toxicity.score(rows_of([]), model).count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


def marginals_by_hand(parents, unary, joint):
    n, total, ones = len(parents), 0.0, [0.0] * len(parents)
    for states in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u for u, s in zip(unary, states) if s) + sum(joint[2 * states[p] + s] for p, s in zip(parents, states) if p >= 0))
        total += w
        for v, s in enumerate(states):
            ones[v] += w * s
    return [x / total for x in ones]


def test_messages_give_exact_marginals():
    r = random.Random(8)
    for _ in range(20):
        n = r.randint(1, 9)
        parents = [-1] + [r.randrange(v) for v in range(1, n)]
        unary, joint = [r.gauss(0, 2) for _ in range(n)], [r.gauss(0, 1) for _ in range(4)]
        odds, _, _ = html_extract.marginals(parents, unary, joint)
        for a, b in zip(odds, marginals_by_hand(parents, unary, joint)):
            assert abs(1 / (1 + math.exp(-a)) - b) < 1e-9


def test_pages_it_was_not_trained_on():
    model, wrong, n = html_extract.train(), 0, 0
    for runs in html_pages.labelled_pages(80, seed=77):
        source, spans = "", []
        for part, content in runs:
            spans.append((len(source), len(source) + len(part), content))
            source += part
        page = html_extract.parse(source)
        want = [t for t, at in zip(page.texts, page.places) if any(c for a, b, c in spans if a <= at < b)]
        got = html_extract.main_text(source, model).split("\n")
        wrong += len(set(want) ^ set(got))
        n += len(page.texts)
    assert wrong <= 0.02 * n


def test_extract_odd_pages(spark):
    article = "<article><h1>A title</h1><p>First  one &amp; more&nbsp;text here.<br>Next line.<p>Second <b>bold</b> one &lt;tag&gt;.</article>"
    pages = [
        (1, "u", None), (2, "u", ""), (3, None, "plain < text"), (None, "u", "<p>" * 2000), (4, "u", f"<html><body><nav><ul><li><a href='x'>Home</a></ul></nav><!-- x <p> -->{article}<script>var t = '</p>';</script><footer>&copy; Site</footer>"),
        (4, "u", f"<html><body><nav><ul><li><a href='x'>Home</a></ul></nav><!-- x <p> -->{article}<script>var t = '</p>';</script><footer>&copy; Site</footer>"),
        (5, "u", "<article><p>Cut off he"), (6, "u", "<a href=\"unclosed><p>x</p>"), (7, "u", "<div>" * 3000 + "deep"),
    ]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(frame).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    texts = [r.text for r in got if r.page_id == 4]
    assert texts == ["A title\nFirst one & more text here. Next line.\nSecond bold one <tag>."] * 2
    assert html_extract.extract(frame.limit(0)).count() == 0
