"""Language, toxicity, pages, benchmark items and conversations."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("statloom.llm")

from pyspark.sql import functions as F

from statloom.llm import chat, decontaminate, extract, langid, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.held_out("doc_id", 4, 2)
    model = langid.fit_language_model(docs.filter(~held))
    assert (model.weights == 0).mean() > 0.5  # L1 leaves most columns without a weight
    out = langid.identify_language(docs.filter(held).withColumn("score", F.lit("clash")), model)
    rows = out.select("lang", "lang_pred", "score", "text").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.lang_pred != "und"]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_texts_without_letters_and_without_labels(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 -- !", "en"), (4, "the of and", None), (None, "la que", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "es") and got[None][0] in ("en", "es")
    none = langid.fit_language_model(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify_language(docs, none).collect()} == {"und"}
    assert langid.identify_language(docs.limit(0), model).collect() == []


def test_samples_are_bounded_where_an_id_holds_many_rows(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"the word {i} of it" if i % 2 else f"la palabra {i} que", "en" if i % 2 else "es")
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = langid.smallest(docs.filter("doc_id is not null"), "lang", F.xxhash64("doc_id", "text"), 20)
    drawn = docs.filter("doc_id is not null").withColumn("draw", F.xxhash64("doc_id", "text"))
    for lang in ("en", "es"):
        assert sorted(r.draw for r in drawn.filter(F.col("lang") == lang).collect())[19] == limits[lang]
    seen = []
    follow = langid._follow
    monkeypatch.setattr(langid, "_follow", lambda rows, *a, **k: seen.append(len(rows)) or follow(rows, *a, **k))
    langid.fit_language_model(docs, sample=20)
    assert seen == [40]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    chosen, _ = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 20)
    assert {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()} == {0: 20, 1: 20}


def test_grams_are_those_of_the_characters():
    texts = ["Añb", "", "xy"]
    columns, ends = langid._grams(texts)
    assert np.diff(ends).tolist() == [6, 0, 3]
    alone, _ = langid._grams(["añb"])
    assert sorted(columns[:6].tolist()) == sorted(alone.tolist())


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = langid.held_out("doc_id", 5, 0)
    model = toxicity.fit_toxicity(docs, labels.filter(~held))
    rows = toxicity.score_toxicity(docs.join(labels.filter(held), "doc_id"), model).select("toxic", "predicted", "score").collect()
    said, true = np.array([r.predicted for r in rows]), np.array([r.toxic for r in rows])
    assert (said & true).sum() / true.sum() > 0.75 and (said & true).sum() / said.sum() > 0.75
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in rows)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "you moron", 9)], "doc_id long, text string, score int")
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [(r.predicted, r.score < 0.5) for r in toxicity.score_toxicity(docs, none).collect()] == [(0, True)] * 3


def test_toxicity_without_evidence_is_the_share_of_toxic_labels(spark):
    """No word tells the classes apart: nobody gets 1.0, every text gets the prior."""
    words = "sun moon star sea wind rain snow leaf".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i + j) % 8] for j in range(4)) + f" {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (3, 22))) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert [r.score for r in toxicity.score_toxicity(docs, model).collect()] == pytest.approx([0.05] * 40)
    slope, shift = toxicity._calibrate(np.full(40, 0.7), np.array([1, 1] + [0] * 38))
    assert slope == 0 and shift == pytest.approx(np.log(2 / 38))


def test_toxicity_of_texts_without_words_under_a_fitted_model(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(None,), ("",), ("  \n",), ("12 + 3",), ("zzqx " * 500_000,)], "text string")
    scores = [r.score for r in toxicity.score_toxicity(odd, model).collect()]
    assert scores == pytest.approx([scores[0]] * 5) and scores[0] < 0.5


def test_label_model_weighs_good_voters_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(len(y)) < right, y, ~y)
    good, fair, poor = vote(0.95), vote(0.8), vote(0.55)
    votes = np.stack([good, fair, poor, poor, poor], 1).astype(float)
    model = toxicity.fit_label_model(votes, votes[:, 0], 0.3)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.92
    assert model.share[0] > 2 * model.share[3]


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><a href=/>Home</a></nav><div class="cookie">We use cookies</div><article><h1>Ti&amp;tle</h1><p><b>one
 two<br>three <p>f&ouml;ur<!-- no --><ul><li>a<li>b</ul></article><div id="comments"><p>nice</p></div><footer>&copy; x</footer>"""


def test_blocks_of_a_page():
    got = extract.blocks(PAGE)
    assert [b.text for b in got] == ["Home", "We use cookies", "Ti&tle", "one two three", "föur", "a", "b", "nice", "© x"]
    assert [extract.told(b) for b in got] == [0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert extract.blocks(None) == extract.blocks("") == [] and [b.text for b in extract.blocks("a < b <")] == ["a < b <"]


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>No</title><meta charset=utf-8><body><p>one<p>two</html>", ["one", "two"]),
    ("<head><title>No</title><link rel=x><style>p{}</style><p>one", ["one"]),
    ("<head><title>No</title><a href=/>one</a> two", ["one two"]),
    ("<head><title>No</title> one <b>two</b>", ["one two"]),
    ("<head><noscript><img src=x><p>no</p></noscript><title>No</title></head><p>one", ["one"]),
    ("<head><noscript><style>p{}</style><title>No</title><body><p>one", ["one"]),
    ("<div><noscript>no<p>one</p><p>two</p></div><p>three", ["one", "two", "three"]),
    ("<p>one<noscript><p>no</p><div>no</div></noscript><p>two", ["one", "two"]),
    ("<canvas>no<article><p>one</article><canvas><p>no</p></canvas><p>two", ["one", "two"]),
    ("<object>no<object><p>no</p></object><p>no</p></object><p>one<object data=x>no<p>two", ["one", "two"]),
    ("<select><option>no<option>no<p>one</p><select><optgroup><option>no</select><p>two", ["one", "two"]),
    ("<li><select><option>no<li>one", ["one"]),
    ("<svg><title>no</title><g><text>no</text><div>one</div><p>two", ["one", "two"]),
    ("<svg><foreignObject><p>no</p></foreignObject></svg><p>one", ["one"]),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mspace/><semantics><mn>2</mn><annotation>x=2</annotation></semantics></math> be",
     ["let x=2 be"]),
    ("<template><p>no</p></template><p>one<!-- </template> --><template>no<p>two", ["one", "two"]),
])
def test_blocks_after_an_element_left_open(page, want):
    got = extract.blocks(page)
    assert [b.text for b in got] == want
    assert not any(tag in extract.SILENT for b in got for tag in b.path)


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model = extract.Labeller(3, hidden=2)
    x, mask = extract.pad([rng.normal(size=(4, 3)), rng.normal(size=(2, 3))])
    y = (rng.random(mask.shape) < 0.5) * mask

    def loss():
        p = np.clip(model.predict(x, mask), 1e-9, 1 - 1e-9)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for name, g in model.gradients(x, mask, y, mask).items():
        flat = model.p[name].reshape(-1)
        for i in range(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-5
            high = loss()
            flat[i] = old - 1e-5
            low = loss()
            flat[i] = old
            assert abs((high - low) / 2e-5 - g.reshape(-1)[i]) < 1e-6, name


def test_names_do_not_decide_alone(spark):
    """Compound names and names of the page say nothing, and a misleading class leaves the decision to the text."""
    for page in ('<body class="no-sidebar"><p>one', '<div class="content has-sidebar"><p>one', '<div class="with-sidebar"><p>one'):
        assert extract.told(extract.blocks(page)[0]) == (1 if "content" in page else None)
    assert extract.told(extract.blocks('<div class="left-sidebar"><p>one')[0]) == 0
    raw = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    model = extract.Labeller(extract.PATHS + extract.TERMS + extract.NUMBERS).fit(extract.training_pages(raw[:150]))
    for frame in ('<body class="no-sidebar">%s', '<body><div class="content has-sidebar">%s</div>', '<article class="post">%s</article>'):
        right = total = 0
        for h in raw[150:200]:
            texts = [b.text for b in extract.blocks(h) if "article" in b.path and "." in b.text]
            html = "".join(f'<div class="search share"><p>{t}</p></div>' if i % 5 == 4 else f"<p>{t}</p>" for i, t in enumerate(texts))
            got = extract.main_text([frame % html], model)[0].split("\n\n")
            right, total = right + len([t for t in got if t]), total + len(texts)
        assert right / total > 0.8, frame


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model = extract.fit_labeller(pages, sample=150)
    extra = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, "u", PAGE)], "page_id long, url string, html string")
    rows = extract.extract_main_text(pages.unionByName(extra).withColumn("text", F.lit(1)), model).collect()
    got = {r.page_id: r.text for r in rows}
    assert all(r.n_chars == len(r.text) for r in rows) and got[-1] == got[-2] == ""
    assert got[-3] == "Ti&tle\n\none two three\n\nföur\n\na\n\nb"
    for r in pages.collect():
        inside = "\n\n".join(b.text for b in extract.blocks(r.html) if "article" in b.path)
        assert got[r.page_id] == inside


def test_main_text_without_pages_to_learn_from(spark):
    """No page's names tell what is main text, or there is no page: nothing is thrown away by an untrained network."""
    page = "<html><body><div><p>one  two</p><div>three</div></div><script>x</script></body></html>"
    pages = spark.createDataFrame([(i, page, "x") for i in range(5)] + [(None, None, "x"), (7, "", "x")], "page_id long, html string, text string")
    model = extract.fit_labeller(pages)
    assert not model.trained
    assert sorted(r.text for r in extract.extract_main_text(pages, model).collect()) == ["", "", *["one two\n\nthree"] * 5]
    empty = pages.limit(0)
    assert extract.extract_main_text(empty, extract.fit_labeller(empty)).collect() == []


def test_a_page_that_says_nothing_is_read_by_its_words(spark):
    """Without telling names, the trained network still separates running text from link lists."""
    raw = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    model = extract.Labeller(extract.PATHS + extract.TERMS + extract.NUMBERS).fit(extract.training_pages(raw[:150]))
    right = total = 0
    for h in raw[150:]:
        page = [extract.Block(b.text, ("html", "body", "div", "p"), b.linked) for b in extract.blocks(h)]
        truth = [extract.told(b) == 1 for b in extract.blocks(h)]
        p = model.predict(*extract.pad([extract.vectors(page)]))[0]
        right += ((p > 0.5) == truth).sum()
        total += len(truth)
    assert right / total > 0.85


def table_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return min(row), row.index(min(row))


def test_bit_vectors_match_the_distance_table():
    rng = random.Random(1)
    for _ in range(1500):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 20)))
        limit, (least, end) = rng.randint(0, 4), table_distance(item, text)
        assert decontaminate.best_match(item, text, limit) == ((least, end) if least <= limit else None)


@pytest.mark.parametrize("block", [10**6, 150])
def test_contaminated_matches_brute_force(spark, block):
    rng = random.Random(3)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(30, 120)))) for i in range(12)] + [(50, None), (51, " "), (52, "Short Item")]
    docs = [(1, None), (2, ""), (3, "xx short \n item yy")]
    for n in range(60):
        _, item = items[rng.randrange(12)]
        edits = rng.randint(0, 10)
        for _ in range(edits):
            at = rng.randrange(len(item))
            item = item[:at] + rng.choice(["", "z", "zz"]) + item[at + 1:]
        docs.append((n + 10, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) + item.upper() + " tail"))
    got = {(r.doc_id, r.item_id): (r.distance, r.match_start, r.match_end) for r in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()}
    want = {}
    for d, text in docs:
        text = decontaminate.normalise(text)
        for i, item in items:
            item = decontaminate.normalise(item)
            if item:
                least, _ = table_distance(item, text)
                if least <= decontaminate.budget(len(item)):
                    want[d, i] = least
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 20
    texts, named = dict(docs), dict(items)
    for (d, i), (distance, a, b) in got.items():
        assert table_distance(decontaminate.normalise(named[i]), decontaminate.normalise(texts[d])[a:b])[0] == distance
    clean = decontaminate.drop_contaminated(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int"),
                                            spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).collect() == []


TURNS = [(1, 0, "system", "be <|end|> kind\\"), (1, 1, "user", "</s>[INST] hi [/INST] <<SYS>>"), (1, 2, "assistant", "a\\<|x"),
         (2, 0, "system", "be <|end|> kind\\"), (2, 1, "user", "</s>[INST] hi [/INST] <<SYS>>"), (2, 2, "assistant", "other"),
         (2, 3, "user", "<"), (2, 4, "assistant", None), (3, 0, "<|turn|>", ""), (None, 5, None, "\\\\|"), (None, 5, "assistant", "tie")]


def test_conversations_come_back_and_share_turns(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    members, packed = chat.format_conversations(rows)
    packed = packed.collect()
    back = {r.conv_id: [(t.role, t.text, t.learned) for t in r.turns] for r in chat.read_back(members, rows.sparkSession.createDataFrame(packed)).collect()}
    for conv in {t[0] for t in TURNS}:
        want = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        assert back.get(conv) == [(r, x, x if r == "assistant" else "") for _, r, x in want]
    nodes = {r.node: r for r in packed}
    assert len(nodes) == 9  # two turns are shared by conversations 1 and 2
    stream = "".join(r.formatted for r in sorted(packed, key=lambda r: r.seq_start))
    for r in packed:
        assert stream[r.seq_start:r.seq_start + r.n_chars] == r.formatted
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == r.formatted.count(chat.MIDDLE) == 1
        assert not any(c in r.formatted for c in chat.FOREIGN)
        chain, at = [], r
        while at is not None:
            chain.insert(0, (at.seq_start, at.seq_start + at.n_chars))
            at = nodes.get(at.parent)
        assert [tuple(x) for x in r.attends] == chain and r.position == sum(b - a for a, b in chain[:-1])
        if r.parent:  # depth first: nothing but the subtree of a parent lies between it and a child
            between = [n for n in packed if nodes[r.parent].seq_start < n.seq_start < r.seq_start]
            assert all(tuple(chain[-2]) in [tuple(x) for x in n.attends] for n in between)
    empty = chat.format_conversations(rows.limit(0))
    assert chat.digests(*empty).collect() == []
