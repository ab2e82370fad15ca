"""HTML extraction, byte-level BPE, language ID, chat formatting, secret scans and the pipeline."""

import hashlib
import random
import time
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specula.llm import byte_bpe, chat_format, html_extract, language_id, secret_scan
from specula.llm.byte_bpe import ByteBpe, load_vocabulary
from specula.llm.html_extract import main_text
from tests.llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# ---------------------------------------------------------------- HTML


def page(article, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav>{article}{extra}<footer>&copy; site</footer></body></html>"


LONG = "This is a sentence of the article that goes on for a while, and then some more. " * 4


@pytest.mark.parametrize("html,want", [
    (page(f"<article><h1>Head &amp; line</h1><p>{LONG}<p>Sho<b>rt</b>.</article>"), ["Head & line", LONG.strip(), "Short."]),
    (page(f"<div class='content'><h2>Sub</h2><p>{LONG}</p><p>Two\n  lines&nbsp;here<br>on</p></div><div id='comments'><p>{LONG}</p></div>"), ["Sub", LONG.strip(), "Two lines here on"]),
    (page(f"<main><p>{LONG}</p><aside>side</aside><form><input value=x>send</form><div class='cookie-notice'>We use cookies</div><p>End</p></main>"), [LONG.strip(), "End"]),
    (page(f"<article><header><h1>In</h1></header><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "<div class=\"ad banner\">Buy</div>"), ["In", LONG.strip(), "one", "two", "c1", "c2"]),
    (page(f"<article><p>{LONG}</p><div hidden>secret</div><p style='display: none'>gone</p><!-- c > --><p>&lt;b&gt; stays &#233;</p></article>"), [LONG.strip(), "<b> stays é"]),
    (page(f"<article><p>{LONG}</p><ul><li><a href=1>link one</a><li><a href=2>link two</a><li><a href=3>link three</a></ul></article>"), [LONG.strip()]),
    ("", []), (None, []), ("plain words", ["plain words"]), ("<p>a", ["a"]), ("<html><body></body></html>", []), ("<script>x</script>", []),
    ("<p class='a>b'>q</p> < 3", ["q", "< 3"]), ("a<!-- open -->b", ["ab"]),
])
def test_main_text(html, want):
    got = main_text(html).split("\n\n") if main_text(html) else []
    assert got == [" ".join(w.split()) for w in want]


@pytest.mark.parametrize("wrap", ["div class='wrapper no-sidebar'", "div class='layout has-sidebar'", "div class='post comments-open'", "div id='page-header widget'", "form action='/x'"])
@pytest.mark.parametrize("inner", ["p", "article"])
def test_a_wrapper_of_the_whole_page_is_no_menu(wrap, inner):
    notes = "<div class='comments'><p>A reader's comment, no part of the text.</p></div>"
    page_of = f"<html><body><{wrap}><{inner}>{LONG}</{inner}>{notes}</{wrap.split()[0]}><div>end</div></body></html>"
    got = main_text(page_of)
    assert LONG.strip() in got and "comment" not in got


def test_comments_and_related_articles_stay_out():
    more = "".join(f"<article><p>Comment {i}. {LONG}</p></article>" for i in range(1))
    got = main_text(f"<html><body><div><p>{LONG}</p><p>{LONG}</p></div><div id='comments'>{more}</div></body></html>")
    assert LONG.strip() in got and "Comment" not in got


def random_tree(r, depth=0):
    tag = "body" if not depth else r.choice(["div", "div", "section", "p", "span", "a", "ul"])
    if tag in ("p", "a", "span") or depth > 4:
        return tag, ["w" * r.randrange(0, 60) + " " for _ in range(r.randrange(0, 2))]
    inner = [random_tree(r, depth + 1) if r.random() < 0.8 else "text " * r.randrange(9) for _ in range(r.randrange(5))]
    return tag, [x for k, x in enumerate(inner) if not (k and isinstance(x, str) and isinstance(inner[k - 1], str))]  # two texts in a row are one


@pytest.mark.parametrize("seed", range(25))
def test_densities_equal_a_plain_version(seed):
    tree = random_tree(random.Random(seed))
    made = html_extract._Page("<html>" + brute.dom_html(tree) + "</html>")
    density, score, chars, _ = made.densities()
    body = made.body()
    nodes = [k for k in range(len(made.tag)) if k >= body]
    want = brute.densities(tree)
    assert [made.tag[k] for k in nodes] == [w[0] for w in want]
    for k, (_, c, d, total) in zip(nodes, want):
        assert chars[k] == c and density[k] == pytest.approx(d) and score[k] == pytest.approx(total)
    if any(w[3] for w in want):
        best = max(range(len(want)), key=lambda k: (want[k][3], want[k][2]))
        root = made.article()[0]
        at = nodes[best]
        while at != root and at:  # the choice is the largest sum's subtree or grew from it
            at = made.parent[at]
        assert at == root


@pytest.mark.parametrize("inner", [
    "<section id='related-work'><h2>Related work</h2><p>{}</p></section>", "<p id='share-prices'>{}</p>", "<p class='notice-period'>{}</p>", "<div class='ad-hoc'>{}</div>",
])
def test_names_that_only_hold_a_word(inner):
    other = "Another paragraph that belongs to the text. " * 3
    assert other.strip() in main_text(page(f"<article><p>{LONG}</p>{inner.format(other)}</article>"))


@pytest.mark.parametrize("extra", ["<div class='responses'><p>{}</p></div>", "<div data-ad='7'><p>{}</p></div>", "<div data-ad-slot><p>{}</p></div>", "<div class='ad'>{}</div>", "<div id='cookie-banner'><p>{}</p></div>", "<section class='commentSection'><article><p>{}</p></article></section>", "<div class='ads box-2'>{}</div>"])
def test_what_is_named_no_article(extra):
    for shape in ("<article><p>{0}</p><p>{0}</p>{1}</article>", "<main><p>{0}</p><p>{0}</p>{1}</main>", "<div><p>{0}</p><p>{0}</p></div>{1}"):
        got = main_text(page(shape.format(LONG, extra.format("Some words from elsewhere, not of the text."))))
        assert LONG.strip() in got and "elsewhere" not in got


def test_density_decides_without_names():
    links = "".join(f"<li><a href='/{k}'>Popular story number {k}</a></li>" for k in range(8))
    got = main_text(page(f"<main><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><h3>More</h3><ul>{links}</ul></div></main>"))
    assert got.startswith("Title") and "Popular" not in got
    got = main_text(page(f"<main><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}</ul></div></main>"))
    assert got.startswith("Title") and LONG.strip() in got and "Popular" not in got
    two = main_text(page(f"<main><article><p>First. {LONG}</p></article><article><p>Second. {LONG}</p></article></main>"))
    assert "First." in two and "Second." in two
    three = main_text(page(f"<div><div><p>A1 {LONG}</p><p>A2 {LONG}</p></div><div><p>B1 {LONG}</p></div></div>"))
    assert all(x in three for x in ("A1", "A2", "B1"))


def test_broken_pages_are_read_in_linear_time():
    n = 60_000
    start = time.time()
    for html in ("<div>" * n + "</span>" * n, "<b>" * n + "<div></div>" * n, "<ul><li>" + "<b>" * n + "<li></li>" * n, "<b>" * n + "<header></header>" * n, "<div>" * n + "x" + "</p>" * n):
        main_text(html)
    assert time.time() - start < 30
    assert main_text("<div>" * n + "deep" + "</div>" * n) == "deep"
    for html in ("<" * 200_000, "<div>" * 50_000, "<a " * 100_000, '"<p class="a>b' * 20_000, "</p>" * 100_000, "<p>" * 50_000 + "x"):
        main_text(html)


def test_extract(spark, data):
    rows = [(1, "u", page(f"<article><p>{LONG}é</article>")), (1, "u", None), (None, None, "")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id LONG, url STRING, html STRING, text STRING, n_chars INT")
    got = html_extract.op1_html_extract(df)
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("", 0), (LONG + "é", len(LONG) + 1)]
    assert html_extract.op1_html_extract(df.limit(0)).count() == 0
    for r, s in zip(spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect(), html_extract.op1_html_extract(spark.read.parquet(f"{data}/pages.parquet")).orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert re.sub(r"\W", "", s["text"]) == re.sub(r"\W", "", re.sub(r"&\w+;", "", re.sub(r"<[^>]+>", "", inner)))


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(load_vocabulary(VOCABULARY), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(bpe, data, spark):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(0)
    odd = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2000), r.randrange(0x3000, 0x9FFF), 0x1F600, 9, 10, 0x85, 0x1C]))
    texts = ["", "a" * 5000, "ab" * 300, " \n\n x", "日本語" * 200, "x" * 256, "y" * 257, "<|endoftext|>", *("".join(odd() for _ in range(400)) for _ in range(30))]
    texts += [x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    ids, at = bpe.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == library.encode_ordinary_batch(texts)
    assert [bpe.decode(g).decode() for g in got] == texts


def test_wide_rows_and_matrices_agree(bpe):
    r = random.Random(2)
    pieces = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 250))).encode()[:256] for _ in range(200)]
    assert [x.tolist() for x in bpe._matrix(pieces, 256)] == [bpe._wide(p).tolist() for p in pieces]


def test_pair_table(bpe):
    import numpy as np

    assert bpe.pairs.find(np.array([-1, 5]), np.array([3, -1])).tolist() == [byte_bpe.NONE] * 2
    a, b = bpe.ranks[b"t"], bpe.ranks[b"h"]
    assert bpe.pairs.find(np.array([a]), np.array([b])).tolist() == [bpe.ranks[b"th"]]


def test_bpe_query(spark, bpe):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "z" * 400_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id LONG, text STRING, id STRING, ids STRING")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.op3_byte_bpe(df).collect()}
    for i, t in rows:
        ids = bpe.encode([t or ""])[0].tolist()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) in got
    assert byte_bpe.op3_byte_bpe(df.limit(0)).count() == 0
    assert byte_bpe.op3_byte_bpe(df).count() == 5


def test_a_forgetful_worker_encodes_the_same(bpe, monkeypatch):
    texts = [f"number {i} of words like {i * 7919:x}" for i in range(300)]
    want = bpe.encode(texts)[0].tolist()
    monkeypatch.setattr(byte_bpe, "CACHED", 10)
    assert [x for t in texts for x in bpe.encode([t])[0].tolist()] == want


# ---------------------------------------------------------------- language ID


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op7_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.98
    assert docs.select(language_id.held_out().alias("h"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("k")).filter("h <> (k = 2)").count() == 0


@pytest.fixture(scope="module")
def model(spark):
    train = [("de", "die der und nicht ein eine haus straße über schön"), ("en", "the and of that with house street over nice"), ("ru", "дом улица и над хорошо это"), ("el", "σπίτι δρόμος και πάνω καλό"), (None, "the the"), ("en", None)]
    return language_id.fit(spark.createDataFrame(train * 20, "lang STRING, text STRING"))


def test_spans_of_mixed_text(spark, model):
    text = "the house and the street with that of the house and " + "die straße und nicht ein haus über der schön die und nicht " + "это дом и улица хорошо"
    rows = [(1, text), (2, None), (3, "123 -- ½"), (4, ""), (5, "дом"), (5, "дом"), (6, "漢字")]
    df = spark.createDataFrame([(*r, "xx", "s") for r in rows], "doc_id LONG, text STRING, lang STRING, score STRING")
    got = {r["id"]: r for r in language_id.identify(df, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de", "ru"] and sum(s["n"] for s in got[1]["spans"]) == len(text.split()) and 0 < got[1]["score"] < 1
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["spans"] == [] for k in (2, 3, 4))
    assert got[5]["lang_pred"] == "ru" and got[6]["lang_pred"] in model.languages
    assert language_id.identify(df.limit(0), model).count() == 0 and language_id.identify(df, model).count() == 7
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 5, 6]


def test_rows_with_letters_are_kept(spark, model):
    rows = [(1, "²abc"), (2, "①дом 12"), (3, "² ½ 12"), (4, None), (5, "the house")]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id LONG, text STRING, lang STRING")
    assert language_id.letter_words("²abc m² ½ x1y ½cup") == ["abc", "m", "x", "y", "cup"] and language_id.letter_words("नमस्ते दुनिया ①word") == ["नमस्ते", "दुनिया", "word"]
    for m in (model, language_id.fit(df)):
        assert sorted(r["doc_id"] for r in language_id.keep_known(df, m).collect()) == [1, 2, 5]


def test_copies_of_a_text_are_learnt_once(spark):
    rows = [("en", f"the house number {i} of that street") for i in range(40)]
    copies = [("en", "the house number 7 of that street")] * 30
    schema = "lang STRING, text STRING"
    one, many = (language_id.fit(spark.createDataFrame(x, schema)) for x in (rows, rows + copies))
    assert (one.table == many.table).all()


def test_viterbi_is_exact(model):
    """The shortcut for texts of one language, and the path over several, against all paths."""
    import itertools

    import numpy as np

    r = random.Random(4)
    pool = "the house haus und straße дом σπίτι street over über xyz ein".split()
    texts = [[r.choice(pool) for _ in range(r.randrange(0, 7))] for _ in range(60)]
    label, firsts = model.label(texts)
    for k, t in enumerate(texts):
        if not t:
            continue
        s = model.scores[[model.seen[w] for w in t]]
        value = lambda p: model.prior[p[0]] + sum(s[i, x] for i, x in enumerate(p)) - language_id.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(len(model.languages)), repeat=len(t)))
        assert np.isclose(value(label[firsts[k] : firsts[k + 1]]), best, atol=1e-3)


def test_no_labelled_rows(spark):
    empty = language_id.fit(spark.createDataFrame([(None, "x")], "lang STRING, text STRING"))
    df = spark.createDataFrame([(1, "the house")], "doc_id LONG, text STRING")
    assert language_id.identify(df, empty).first()["lang_pred"] == "und"


# ---------------------------------------------------------------- chat

ODD = ["</s>[INST] ok [/INST]", "\\1\\\\0 [ROLE]", "[INST][INST]", "<</s>/s>", "[/INST", "\\", "", "plain", "[IN</s>ST]", "é\n\n"]


def test_chat_round_trip(spark):
    r = random.Random(0)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "tool [INST]", "a\\1"]), r.choice([None, *ODD]) if r.random() < 0.6 else " ".join(r.choice(ODD) for _ in range(3))) for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (50, None, "assistant", "y"), (51, 0, "user", "q"), (51, 0, "user", "q")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "conv_id LONG, turn LONG, role STRING, text STRING, turns INT")
    rendered = chat_format.render(df)
    back = {x["conv_id"]: [(p["role"], p["text"]) for p in x["p"]] for x in rendered.select("conv_id", chat_format.parse(F.col("text")).alias("p")).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    want = {}
    for x in sorted(rows, key=key):
        want.setdefault(x[0], []).append((x[2] or "", x[3] or ""))
    assert back == want
    plain = lambda s: s.replace("\\4", "[ROLE]").replace("\\3", "[/INST]").replace("\\2", "[INST]").replace("\\1", "</s>").replace("\\0", "\\")
    whole = {x["conv_id"]: x["text"] for x in rendered.collect()}
    seen, last = {}, {}
    for e in sorted(chat_format.expand(df).collect(), key=lambda e: e["nth"]):
        text = e["context"] + e["reply"]
        assert whole[e["conv_id"]].startswith(text) and e["loss_start"] == len(e["context"])
        if e["reply"]:
            assert e["reply"] == text[e["loss_start"] : e["loss_start"] + e["loss_chars"]] + "</s>"
            seen.setdefault(e["conv_id"], []).append(plain(text[e["loss_start"] : e["loss_start"] + e["loss_chars"]]))
        else:
            assert e["loss_chars"] == 0 and e["last"]
        if e["last"]:
            assert e["conv_id"] not in last and text == whole[e["conv_id"]]
            last[e["conv_id"]] = text
    assert last == whole
    assert seen == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items() if any(role == "assistant" for role, _ in turns)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat_format.digests(chat_format.expand(df)).collect():
        turns = want[r["conv_id"]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(said), len(whole[r["conv_id"]]))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns)) and r["loss_sha256"] == sha(said)


def test_chat_query(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "assistant", None)], "conv_id LONG, turn LONG, role STRING, text STRING")
    out = chat_format.op9_chat_format(df)
    got = {r["conv_id"]: r for r in out.collect()}
    probe, sha = chat_format.PROBE, lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[-7]["turns_sha256"] == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-7]["loss_sha256"] == sha(probe) and got[-7]["loss_chars"] == len(probe)
    assert got[1]["loss_chars"] == 0 and got[1]["loss_sha256"] == sha("") and got[2]["n_turns"] == 1 and got[1]["formatted_chars"] == len("[INST]hi[/INST]")
    assert [r["conv_id"] for r in chat_format.op9_chat_format(df.limit(0)).collect()] == [-7]
    # The digests come from the contexts: the plan builds them.
    assert "context" in out._jdf.queryExecution().optimizedPlan().toString()
    own = spark.createDataFrame([(-7, 0, "user", "mine")], df.schema)
    assert sorted(r["n_turns"] for r in chat_format.op9_chat_format(own).collect()) == [1, 2]


def test_chat_of_many_turns(spark):
    """An example a reply, each with all turns before it; no step beside writing them costs more than the text is long."""
    n = 3000
    df = spark.range(n).selectExpr("5L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    start = time.time()
    r = chat_format.digests(chat_format.expand(df)).first()
    assert time.time() - start < 60
    said = "".join(f"t{k}" for k in range(1, n, 2))
    assert r["n_turns"] == n and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_parse_of_what_was_never_rendered(spark):
    df = spark.createDataFrame([("",), (None,), ("[INST]a[/INST]loose text of a user",), ("\\9</s>",)], "text STRING")
    got = [r["p"] and [tuple(x) for x in r["p"]] for r in df.select(chat_format.parse(F.col("text")).alias("p")).collect()]
    assert got[:2] == [[], None] and got[2][0] == ("user", "a") and got[2][1][0] == "user" and got[3] == [("assistant", "\\9")]


# ---------------------------------------------------------------- secrets


SECRET, BENIGN = secret_scan.SECRET_WORDS, secret_scan.BENIGN_WORDS
#: Forms that no forest below learns from.
HELD_OUT = ("hex32", "prefixed_live", "short", "uuid", "file_path", "here")


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    words = "the of and house about river stone table garden window letter number under over between people water story yellow".split()
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(8, 40))) + ".") for k in range(2500)] + [(-1, None), (-2, ""), (-3, "too short")]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING").cache()


@pytest.fixture(scope="module")
def labelled(spark, texts):
    return secret_scan.written(secret_scan.labelled_findings(texts), "labelled")


@pytest.fixture(scope="module")
def forest(labelled, texts):
    return secret_scan.FalsePositives.train(labelled.filter(~F.col("form").isin(*HELD_OUT)), secret_scan.dictionary(texts))


def test_forest_on_forms_held_out(labelled, forest):
    """Precision and recall, also of forms that the forest never saw."""
    scored = forest.score(labelled)
    assert scored.filter("probability NOT BETWEEN 0 AND 1").count() == 0
    right = {r["form"]: r["right"] for r in scored.groupBy("form").agg(F.avg((F.col("secret") == (F.col("label") == 1)).cast("double")).alias("right")).collect()}
    assert set(right) == set(secret_scan.FORMS)
    unseen = scored.filter(F.col("form").isin(*HELD_OUT))
    hit, flagged, keys = (unseen.filter(x).count() for x in ("secret and label = 1", "secret", "label = 1"))
    print("held out: precision", hit / flagged, "recall", hit / keys, {k: round(right[k], 2) for k in HELD_OUT})
    assert hit / flagged > 0.95 and hit / keys > 0.8, right
    assert min(v for k, v in right.items() if k not in HELD_OUT) > 0.8, right


def test_scan_and_redact(spark, forest):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    slug = "https://www.example.com/story/about-the-house-of-people-2024/page.html"
    rows = [(1, f'we set token = "{key}" here'), (2, f"see {slug} for more"), (3, None), (4, ""), (5, f'token = "{key}"'), (5, f'token = "{key}"'), (6, "x " * 50_000 + f'password="{key}"'), (None, "nothing"), (7, "password = 'Tr0ub4dor!x'")]
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "doc_id LONG, text STRING, candidate STRING, found INT, id INT")
    found = secret_scan.scan(df, forest)
    assert sorted(r["id"] for r in found.filter("secret").collect()) == [1, 5, 5, 6, 7]
    assert {r["candidate"] for r in found.filter("secret").collect()} == {key, "Tr0ub4dor!x"}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, found).collect()}
    assert clean[1] == 'we set token = "[SECRET]" here' and slug in clean[2] and clean[3] is None and clean[7] == "password = '[SECRET]'"
    assert secret_scan.redact(df, found).columns == df.columns and secret_scan.scan(df.limit(0), forest).count() == 0
    assert secret_scan.redact(df, found).count() == len(rows)
    extra = found.withColumn("length", F.lit("mine")).withColumn("kept", F.lit(1))
    again = forest.score(extra)
    assert set(again.columns) == set(extra.columns) and again.first()["length"] == "mine"


PIECES = ["token", "=", '"', "'", "password:", "api_key=", "KEY", "the", "x" * 17, "a1" * 8, "a1" * 7, "Tr0ub4dor!", ":", "/", "longerwords", "commit", "é", "0" * 16, "ab.cd.ef.12", " ", " ", "\n"]


def test_candidates_equal_a_plain_version(spark):
    r = random.Random(7)
    rows = [(k, "".join(r.choice(PIECES) for _ in range(r.randrange(1, 14)))) for k in range(600)] + [(-1, None), (-2, ""), (-3, 'secrets = "' + "q9" * 3000 + '"')]
    got = sorted((x["id"], x["word_no"], x["nth"], x["candidate"]) for x in secret_scan.candidates(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect())
    want = sorted(brute.candidates(rows, SECRET))
    assert got == want and len(want) > 200


def test_features_equal_a_plain_version(spark, labelled):
    words = ["the", "then", "house", "hous", "key", "a" * 12]
    odd = [("f", 0.0, c, w, b, "") for c, w, b in [("Tr0ub4dor!", "'Tr0ub4dor!'", "a password ="), ("abc", "x=abc", ""), ("", "", ""), ("q", "nothing", "keys:"), ("thenhousethe", "www.a.b/thenhousethe.py),", "sha1"), ("éa1", '"éa1', "KEY")]]
    found = labelled.limit(300).unionByName(spark.createDataFrame(odd, labelled.schema))
    columns = secret_scan.features(found, words)
    for r in found.select("candidate", "word", "before", "after", *(c.alias(f"f_{k}") for k, c in columns.items())).collect():
        want = brute.secret_features(r["candidate"], r["word"], r["before"], r["after"], set(words), SECRET, BENIGN)
        assert set(want) == set(secret_scan.FEATURES)
        for k, v in want.items():
            assert r[f"f_{k}"] == pytest.approx(float(v)), (k, r)
    nothing = spark.createDataFrame([(None,) * 4], "candidate STRING, word STRING, before STRING, after STRING")
    assert None not in nothing.select(*secret_scan.features(nothing, words).values()).first()


def test_dictionary(spark):
    df = spark.createDataFrame([("The the, THEN don't 2nd",), ("then the x",), (None,)], "text STRING")
    got = secret_scan.dictionary(df, size=2)
    assert "the" in got and "then" in got and "don" not in got and "token" in got
    assert "the" not in secret_scan.dictionary(df.limit(0))


def test_secret_query(spark, texts):
    key = hashlib.sha256(b"q").hexdigest()[:40]
    more = spark.createDataFrame([(9001, f'a token = "{key}" b'), (9002, f"see commit {key} of the house")], "doc_id LONG, text STRING")
    got = {r["doc_id"]: r for r in secret_scan.op10_secret_scan(texts.unionByName(more)).collect()}
    assert set(got) == {9001, 9002} and got[9001]["secret"] and not got[9002]["secret"] and got[9001]["candidate_sha256"] == hashlib.sha256(key.encode()).hexdigest()
    assert secret_scan.op10_secret_scan(more.limit(0)).count() == 0 and secret_scan.op10_secret_scan(more).count() == 2


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_the_plain_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    told = language_id.identify(docs, language_id.fit(docs.filter(~language_id.held_out()))).collect()
    told = {r["id"]: (r["lang_pred"], r["score"]) for r in told}
    rows = [(i, t, told[i][0], source) for i, t, _, source in rows if any(c.isalpha() for c in t or "") and told[i][1] >= language_id.LEAST_SHARE]
    texts = brute.lines_kept([r[:2] for r in rows])
    groups = brute.components(list(texts.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, *_ in brute.contained(texts.items(), items)}
    bpe = ByteBpe(load_vocabulary(VOCABULARY), public_tokenizers.PATTERN)
    kept = [r for r in rows if r[0] in texts and r[0] not in bad]
    want = sorted((r[0], r[2], r[3], bpe.encode([texts[r[0]]])[0].tolist()) for r in kept)
    got = sorted((r["doc_id"], r["lang"], r["source"], r["ids"]) for r in corpus_pipeline.run(spark, data).collect())
    assert got == want and len(got) < len(rows)


def test_stages_on_odd_rows(spark, data):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 %", "en", "s", 4), (4, "the a b c d e f", None, "s", 15), (4, "the a b c d e f", "en", "s", 15), (None, "words here", "en", None, None), (5, "x " * 100_000, "en", "s", 1)]
    df = spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, id STRING, row STRING")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (df, df.limit(0)):
            out = stage(spark, d, data)
            rows_out = out.collect()
            assert k == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
            assert not (d is not df and rows_out)
            if d is df:
                ids = sorted(str(r["doc_id"]) for r in rows_out)
                want = {"language_id": ["4", "4", "5", "None"]}.get(name, ["1", "2", "3", "4", "4", "5", "None"])
                assert ids == want, name


def test_nothing_swallows_a_failed_round_trip(spark, monkeypatch):
    real = byte_bpe.encode_decode
    monkeypatch.setattr(byte_bpe, "encode_decode", lambda *a, **k: real(*a, **k).withColumn("decoded", F.lit(b"no")))
    df = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    with pytest.raises(Exception, match="no round trip"):
        corpus_pipeline.tokenize(spark, df, "").collect()


