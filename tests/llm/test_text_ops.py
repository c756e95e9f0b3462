"""Language ID, quality rules and model, HTML extraction."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from mailloom.llm import language_id, quality_model, quality_rules
from mailloom.llm.html_extract import Page, PathSettings, extract_main_text, main_text

from .helpers import DOCS, awkward, awkward_rows, plain_quality, prose


def test_quality_rules_by_hand(spark):
    r = random.Random(4)
    texts = [t for _, t, *_ in awkward_rows()] + ["".join(r.choice("ab \n\t#|é\x85.") for _ in range(r.randrange(200))) for _ in range(300)] + [" ".join(r.choice("xyz") for _ in range(60)) for _ in range(40)]
    got = quality_rules.line_clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for g in got:
        want = plain_quality(texts[g["doc_id"]])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == want, texts[g["doc_id"]]
        assert not (g["kept"] and g["base_failed"])


def test_lines_that_a_polynomial_takes_for_equal(spark):
    """The Thue-Morse word and its complement: different lines, one value of any polynomial modulo 2**64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate({97: "b", 98: "a"})
    texts = [f"{word}\n{other}", f"{word}\n{word}", " ".join([word, other, word, word, other, other] * 2)]
    got = {r["doc_id"]: r for r in quality_rules.line_clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["n_dup_lines"] for k in range(3)] == [0, 1, 0] and [got[k]["n_repeat_words"] for k in range(3)] == [0, 0, 12]


def test_equal_hashes_of_different_spans_are_told_apart():
    from mailloom.llm.common import classes_of, same_spans

    buf = np.frombuffer(b"abcabdabcxabd", np.uint8)
    start, end = np.array([0, 3, 6, 10]), np.array([3, 6, 9, 13])
    for key in (np.zeros(4, np.uint64), None, np.array([5, 5, 5, 9], np.uint64)):
        n = classes_of(buf, start, end, key)
        assert n[0] == n[2] and n[0] != n[1] and (key is not None and key[3] == 9 or n[1] == n[3])
    r = random.Random(6)
    data = np.array([r.choice(b"ab") for _ in range(4000)], np.uint8)
    a = np.array([r.randrange(3900) for _ in range(500)])
    b, n = np.array([r.randrange(3900) for _ in range(500)]), np.array([r.randrange(0, 9) for _ in range(500)])
    assert same_spans(data, a, a + n, b, b + n, room=16).tolist() == [data[x : x + k].tobytes() == data[y : y + k].tobytes() for x, y, k in zip(a, b, n, strict=True)]


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(k, prose(k, 60), "en") for k in range(30)] + [(100 + k, prose(k, 60)[::-1], "fr") for k in range(30)], "doc_id long, text string, lang string")
    model = language_id.train_language(docs)
    odd = ["😀 😀", "。、！", "１２３ ４", "\u0301\u0302", "12 !", "", None, "漢字", "ａｂ", "x"]
    got = {r["doc_id"]: r for r in language_id.predict_language(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert [got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in range(len(odd))] == [not any(c.isalpha() for c in t or "") for t in odd]


def test_features_against_plain_counts():
    """Hashed n-grams of a text: as many as letters and single spaces between them, the same for the same letters."""
    for text in ["Über 12 Äpfel!", "a", "a b", "漢 字", "x" * 50, "  a..b  "]:
        grams, bound, letters = language_id._features([text, None, text.upper() if text.isascii() else text], 12)
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        # every run of letters brings its letters and, but for a text's end, one space
        spaces = sum(1 for i, c in enumerate(text.lower()) if not c.isalpha() and i and text.lower()[i - 1].isalpha())
        assert bound[1] - bound[0] in (sum(map(len, runs)) + spaces, sum(map(len, runs)) + spaces + 1) and list(letters) == [True, False, True]
        assert (grams < 1 << 12).all()


def test_line_rules_remove_lines_then_texts(spark):
    good = [prose(k, 14).capitalize() + "." for k in range(6)]
    bad = ["Home | News | Sport | About", "!!! ### $$$ %%% buy now", prose(50, 15), "This site uses cookies to help you."]
    rows = [(0, "\n".join(good + bad[:1])), (1, "\n".join([*bad, "Shop | Cart | Help", prose(51, 15), "%% buy && now ##", *good[:1]])), (2, "\n".join(good))]
    got = {r["doc_id"]: r for r in quality_rules.line_clean(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == "\n".join(good) and got[0]["n_bad_lines"] == 1
    assert not got[1]["kept"] and not got[1]["base_failed"] and got[1]["n_bad_lines"] == 7 and got[1]["clean_text"] == good[0]
    assert got[2]["kept"] and got[2]["lost"] == 0


@pytest.mark.parametrize("extra", [True, False])
def test_awkward_tables(spark, extra):
    docs = awkward(spark, extra)
    n = docs.count()
    assert quality_rules.line_clean(docs).count() == n
    model = language_id.train_language(docs)
    langs = language_id.predict_language(docs, model).collect()
    assert len(langs) == n and {r["lang_pred"] for r in langs if r["doc_id"] in (0, 1, 2, 14)} == {"und"} and all(0 <= r["score"] <= 1 for r in langs)
    labels = spark.createDataFrame([(3, 1), (3, 1), (6, None), (15, 0), (None, 1), (99, 0)], "doc_id long, label int")
    scores = quality_model.score_quality(docs, quality_model.train_quality(docs, labels)).collect()
    assert len(scores) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scores)
    by_id = {r["doc_id"]: r["score"] for r in scores}
    assert by_id[3] == pytest.approx(by_id[4]) and by_id[0] == by_id[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality_rules.line_clean(docs).count() == 0
    model = language_id.train_language(docs)
    assert model.classes == [] and language_id.predict_language(docs, model).count() == 0
    some = awkward(spark, False)
    assert {r["lang_pred"] for r in language_id.predict_language(some, model).collect()} == {"und"}
    q = quality_model.train_quality(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality_model.score_quality(some, q).collect()} == {0.5}
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


VOCAB = {"en": "the and with that this from water", "de": "der und nicht mit eine schön straße", "fr": "le et avec dans été où être"}


def test_language_of_held_out_texts(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(VOCAB[lang].split()) for _ in range(r.randint(3, 40))), lang) for k in range(400) for lang in [r.choice(list(VOCAB))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_language(df.where("doc_id % 2 = 0"))
    got = language_id.predict_language(df.where("doc_id % 2 = 1"), model).collect()
    want = {k: lang for k, _, lang in rows}
    right = [r["lang_pred"] == want[r["doc_id"]] for r in got]
    assert np.mean(right) >= 0.98
    # calibrated: the mean score is near the share that is right
    assert abs(np.mean([r["score"] for r in got]) - np.mean(right)) < 0.08


def test_a_language_column_of_free_text(spark):
    """Only the most frequent languages are learned, however many values there are."""
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(VOCAB[lang].split()) for _ in range(30)), lang if k % 4 else f"free text {k}") for k in range(300) for lang in [r.choice(list(VOCAB))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_language(df, language_id.LanguageSettings(most_classes=len(VOCAB)))
    assert sorted(model.classes) == sorted(VOCAB)
    got = {g["doc_id"]: g["lang_pred"] for g in language_id.predict_language(df, model).collect()}
    assert len(got) == 300 and np.mean([got[k] == lang for k, _, lang in rows if k % 4]) >= 0.97
    # equal numbers: in order of name
    assert language_id.train_language(df.where("doc_id % 4 = 0"), language_id.LanguageSettings(most_classes=2)).classes == ["free text 0", "free text 100"]


def test_passages_are_spaced_over_the_whole_text():
    assert quality_model.spaced(5, 9, 4).tolist() == [5, 6, 7, 8] and quality_model.spaced(3, 3, 4).tolist() == []
    assert quality_model.spaced(10, 20, 4).tolist() == [10, 12, 15, 17]


def test_elastic_net_leaves_weights_at_zero():
    x = [(np.array([k % 2, 8]), np.array([1.0, 1.0])) for k in range(60)]
    y = np.array([k % 2 for k in range(60)])
    w, _ = language_id._ftrl(x, y, 2, language_id.LanguageSettings(bits=3, l1=0.5))
    assert (w[2:] == 0).all() and (w[0] != 0).all()


def test_attention_gradient_is_right():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, quality_model.WIDTH)) for n in (1, 3, 0, 2)]
    m = quality_model.fit([b.astype(np.float32) for b in bags], np.array([1.0, 0, 1, 0]), quality_model.QualitySettings(epochs=1, hidden=5, attention=3))
    bound = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    x, y, w = np.vstack(bags), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])

    def loss():
        s, _ = m.forward(x, bound)
        return float(-(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum())

    s, kept = m.forward(x, bound)
    grads = m.gradient(y, w, s, kept)
    for name, g in grads.items():
        p, g = m.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in range(0, len(p), max(1, len(p) // 4)):
            old = p[i]
            p[i] = old + 1e-6
            up = loss()
            p[i] = old - 1e-6
            down = loss()
            p[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5), (name, i)


def test_quality_of_held_out_texts(spark):
    r = random.Random(2)

    def junk(k):
        return " ".join(w + r.choice(["!!", "###", "$$$", " |"]) for w in prose(k, r.randint(30, 300)).split())

    rows = [(k, junk(k) if k % 5 == 0 else prose(k, r.randint(30, 300)).capitalize() + ".") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(300) if k % 3 != 1], "doc_id long, label int")
    got = quality_model.score_quality(docs, quality_model.train_quality(docs, labels)).where("doc_id % 3 = 1").collect()
    assert np.mean([g["predicted"] == int(g["doc_id"] % 5 != 0) for g in got]) >= 0.97


PAGES = [
    ("<html><body><nav><a href=x>Menu item</a></nav><article><h1>Title &amp; more</h1><p>First   paragraph, of\nsome length.</p><p>Second <b>bold<br><p>Third one, ends.</p></article><footer>&copy; foot</footer>", "Title & more\nFirst paragraph, of some length.\nSecond bold\nThird one, ends."),
    ("<body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies, sorry.</div><div class='main'><h2>Head</h2><p>Text of the story, long enough; yes.</p><ul><li>one point</li><li>two</li></ul><p>More text, with a <a href=x>link</a>, here.</p></div><div class='sidebar'><p>Popular, stuff.</p></div><section id=comments><p>Nice, thanks!</p></section><form><label>Email</label></form></body>", "Head\nText of the story, long enough; yes.\none point\ntwo\nMore text, with a link, here."),
    ("<article><p>Short.</p></article>", "Short."),
    ("<article><p>a &lt;b&gt; &nbsp; c &unknown; &amp</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- no --></article>", "a <b> c &unknown; &"),
    ("<article><p>kept</p><script>never closed <p>gone</p></article>", "kept"),
    ("plain words, no markup", "plain words, no markup"),
    ("<div hidden>no</div>", ""),
    ("<article><p>a<p>b<div class='ad'>no</div><aside>no</aside><p>c</article><div class=footer>no</div>", "a\nb\nc"),
    ("<article><p title=\"a>b\">x</p><p class='q>y</p><p>z, and more</p></article>", None),
    (None, ""),
    ("", ""),
    ("<" * 5000, None),
    # only what fails the bar goes: names alone do not remove text from an article
    ("<article><p>One real paragraph of text, with marks.</p><p class='legal'>Legal words.</p><p id='search-results'>Found words.</p><ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul></article>", "One real paragraph of text, with marks.\nLegal words.\nFound words.\nSource one\nSource two"),
    ("<article>" + "<div>" * 600 + "far down" + "</div>" * 600 + "<p>The real last paragraph.</p></article>", "far down\nThe real last paragraph."),
    ("<article><h1>T</h1><table><tr><td>5</td><td>3</td></tr></table><p>It ends, here.</p><div class='comments'><p>A reader's long comment, with marks, and more.</p></div></article>", "T\n5\n3\nIt ends, here."),
    ("<div>" * 3000 + "deep text, here" + "<b>" * 3000, "deep text, here"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(k, None, h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract_main_text(df).collect()}
    assert len(got) == len(PAGES)
    for k, (_, want) in enumerate(PAGES):
        assert want is None or got[k]["text"] == want, (k, got[k]["text"])
        assert got[k]["n_chars"] == len(got[k]["text"])


class _Plain(HTMLParser):
    """The path table of a well-formed page, text by text."""

    def __init__(self):
        super().__init__()
        self.open, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)
        self.parts.append(None)

    def handle_endtag(self, tag):
        self.open.pop()
        self.parts.append(None)

    def handle_data(self, data):
        self.parts.append(("/" + "/".join(self.open), data))

    def table(self):
        found, run = {}, []
        for part in [*self.parts, None]:
            if part:
                run.append(part)
                continue
            text = " ".join("".join(d for _, d in run).split())
            if text:
                row = found.setdefault(run[0][0], [0, 0, 0, 0])
                for k, n in enumerate((1, len(text), sum(c in ".,;:!?" for c in text), 0)):
                    row[k] += n
            run = []
        return found


def test_path_table_against_a_plain_one():
    r = random.Random(4)

    def node(depth):
        if depth == 0 or r.random() < 0.3:
            return prose(r.random(), r.randint(0, 9)) + r.choice([".", ", x!", "", " &amp; "])
        tag = r.choice(["div", "section", "article", "main"])
        return f"<{tag}>" + "".join(node(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(200):
        page = node(5)
        plain, got = _Plain(), Page(page, PathSettings())
        plain.feed(page)
        plain.close()
        assert {got.name(p): row for p, row in got.table().items()} == plain.table(), page


def test_the_ratio_decides():
    """Names aside, long punctuated paths are content and short ones are not; without the bar all would be."""
    page = "<body><div><div><span>Home</span></div><div>About</div><div>Jobs</div></div><section>" + "".join(f"<p>{prose(k, 40)}, and so on; it ends.</p>" for k in range(5)) + "</section><div>More</div></body>"
    want = "\n".join(f"{prose(k, 40)}, and so on; it ends." for k in range(5))
    assert main_text(page) == want
    assert main_text(page, PathSettings(bar=float("-inf"))).split("\n")[:3] == ["Home", "About", "Jobs"]
    for page, want in PAGES[:2]:
        assert main_text(page) == want != main_text(page, PathSettings(bar=float("-inf")))
    # a part's name gives way where nothing else is content
    assert main_text("<div class='notices'><p>" + prose(1, 200) + ", at length.</p></div>").endswith("at length.")


@pytest.mark.parametrize("piece", ["<!", "<!--", "<a title=\"", "<", "<div>", "<p><table><td><div>", "<tr><td>", "<b></i>", "<script>"])
def test_hostile_pages_take_linear_time(piece):
    import time

    spent = []
    for size in (200_000, 800_000):
        began = time.process_time()
        main_text(piece * (size // len(piece)))
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0] + 1


def test_main_text_keeps_whole_long_articles():
    paragraphs = [prose(k, 50).capitalize() + ", and so on." for k in range(500)]
    assert main_text("<nav><a href=x>m</a></nav><main>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</main>") == "\n".join(paragraphs)


def test_helper_column_names_do_not_leak(spark):
    assert quality_rules.line_clean(awkward(spark)).columns[:2] == ["doc_id", "n_words"]
