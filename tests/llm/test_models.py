"""Language ID, toxicity, packing, extraction and the pipeline."""

import math
import random
import re
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from vellumflow.llm import op3_pack_tokens as packing
from vellumflow.llm import op6_html_extract as extract
from vellumflow.llm import op7_decontaminate as decontaminate
from vellumflow.llm import op8_toxicity as toxic
from vellumflow.llm import op9_language_id as language

D = "/root/testdata/sf0.01"


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        row = rng.randint(1, 40)
        lengths = [rng.randint(1, row) for _ in range(rng.randint(0, 60))]
        rows = packing.best_fit_decreasing(lengths, row)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [f for f in free if f >= n]
            if fit:
                free.remove(min(fit))
            free.append((min(fit) if fit else row) - n)
        assert sorted(free) == sorted(row - sum(lengths[i] for i in r) for r in rows)


@pytest.mark.parametrize("row", [64, 2048])
def test_packing_round_trip(spark, row):
    rows = [(1, "hola\n mundo "), (2, ""), (3, None), (4, "é\u200b🎉 <|endoftext|>" * 500), (5, " " * 3000), (None, "null id"), (6, "twice"), (6, "twice"), (7, "x" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rows", F.lit(1))
    packed = packing.pack_documents(df, row=row, block_tokens=500).cache()
    got = sorted(((r.doc_id, r.text) for r in packing.unpack_documents(packed).collect()), key=repr)
    assert got == sorted(((d, t) for d, t in rows if t), key=repr)
    for r in packed.collect():
        ids, places = np.frombuffer(r.input_ids, np.uint16), np.frombuffer(r.position_ids, np.uint16)
        assert len(ids) == len(places) == row and r.cu_seqlens[-1] == r.n_tokens <= row
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
    assert len({r.pack_id for r in packed.collect()}) == packed.count()
    assert packing.pack_documents(df.limit(0)).count() == 0


def page(main, wrap='<div class="post-{n} content">{main}</div>', n=1):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header><a href=/>Home</a> Site name</header>"
        f"<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class='cookie-notice'>We use cookies, a lot of them, on every page of this site.</div>"
        f"{wrap.format(main=main, n=n)}<div id='comments'><p>{'A reader said a thing or two. ' * 20}</p></div><aside>Read also</aside><form><p>Name</p><input></form><footer>&copy; all</footer></body></html>"
    )


def test_extraction(spark):
    body = "<h1>Title &amp; more</h1><p>First &eacute;  par\n agraph.<br>Same <b>block</b>.<p>Unclosed <ul><li>item<li>other</ul><!-- no --><div class='ad'>Buy</div>"
    want = "Title & more\n\nFirst é par agraph. Same block.\n\nUnclosed\n\nitem\n\nother"
    rows = [(i, f"https://h.example/{i}", page(body + "<p>" + "more words here. " * 30, n=i)) for i in range(9)]
    rows += [(20, "https://h.example/short", page("<p>Tiny.</p>", n=20)), (21, None, None), (22, "odd", ""), (23, "https://k.example/", "<p>only text<"), (24, "https://k.example/x", page("<p>x</p>", wrap="<main>{main}</main>"))]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    got = {r.page_id: r.text for r in extract.extract_pages(df).collect()}
    assert got[0] == want + "\n\n" + ("more words here. " * 30).strip()
    assert got[20] == "Tiny." and got[21] == got[22] == "" and got[24] == "x"
    assert extract.extract_pages(df).count() == len(rows) and extract.extract_pages(df.limit(0)).count() == 0


LONG = "Many words of a paragraph, one after the other. " * 12


@pytest.mark.parametrize(
    "main, want",
    [
        (f'<article class="post"><header class="entry-header"><h1>The title</h1></header><p>{LONG}</p></article>', ["The title", LONG]),
        (f'<article><h1>The title</h1><p class="lead">The lead of it.</p><div class="article-body"><p>{LONG}</p><p>End.</p></div></article>', ["The title", "The lead of it.", LONG, "End."]),
        (f'<article><section class="intro"><p>An intro, short.</p></section><section class="body"><p>{LONG}</p></section></article>', ["An intro, short.", LONG]),
        (f'<article><h1>T</h1><div class="legal-analysis"><p>{LONG}</p></div><p>After.</p></article>', ["T", LONG, "After."]),
        (f'<main><h1>Above</h1><article><p>{LONG}</p></article></main>', ["Above", LONG]),
        (f'<article><div class="notice"><p>{LONG}{LONG}</p></div><p>{LONG}</p></article>', [LONG + LONG, LONG]),
        (f'<article><p>{LONG}</p><div class="share-buttons">Tell all</div><div class="ad-300x250">Buy</div><nav>x</nav></article>', [LONG]),
    ],
)
def test_extraction_keeps_all_of_the_article(main, want):
    """No title, lead or section is left outside, no part is cut for half of a name or if it is most of the article."""
    source = page(main, wrap="{main}")
    assert extract.extract(source, []) == "\n\n".join(w.strip() for w in want)


PROSE = "<article><h1>T</h1><p>" + "Prose here and more. " * 20 + "</p>{}<p>" + "End of it all. " * 20 + "</p></article>"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        *((x, []) for x in ("<video-player></video-player>", "<iframe-x></iframe-x>", "<object-x></object-x>", "<object data=x>", "<svg width=1>", "<canvas/>", "<svg><text>no</text></svg>", "<template><p>no</p></template>")),
        ("<title-bar>x</title-bar>", ["x"]),
        ("<p>with <math><mi>x</mi><mo>+</mo><annotation>x+</annotation></math> in it</p>", ["with x+ in it"]),
        ("<p>a <label for=x>word</label> in prose</p>", ["a word in prose"]),
        ("<form><label>Name</label><p>field</p></form>", []),
        ("<section id=discussion><h2>Discussion</h2><p>" + "We discuss this. " * 9 + "</p></section>", ["Discussion", ("We discuss this. " * 9).strip()]),
        ("<section class='privacy'><h3>On privacy</h3><p>" + "It matters. " * 9 + "</p></section>", ["On privacy", ("It matters. " * 9).strip()]),
        ("<section class=comments><h2>Comments</h2><p>" + "Nice text this. " * 9 + "</p></section>", []),
        ("<section id=discussion><h2>Discussion</h2><p>" + "Nice text this. " * 9 + "</p><form>Reply</form></section>", []),
        ("<section class=privacy><p>" + "We use cookies here. " * 9 + "</p></section>", []),
        ("<div class=discussion><h2>Discussion</h2><p>" + "Nice text this. " * 9 + "</p></div>", []),
    ],
)
def test_extraction_of_custom_and_unclosed_elements_and_topics(part, kept):
    want = ["T", ("Prose here and more. " * 20).strip(), *kept, ("End of it all. " * 20).strip()]
    assert extract.extract(f"<html><body>{PROSE.format(part)}</body></html>", []).split("\n\n") == want
    if part.startswith("<title-bar"):
        assert extract.extract(part + PROSE.format(""), []).startswith("T\n\nProse")


def test_extraction_of_deep_pages():
    tracemalloc.start()
    got = extract.extract("<div>" * 60_000 + PROSE.format("") + "</section></x>" * 20_000, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.startswith("T\n\nProse") and peak < 200 << 20
    page = extract.Page("<div class='a>b'><main><p class=c9>x</p></main></div><div class=a><b></b></div>")
    paths = [page.path_of(e) for e in range(1, len(page.tag))]
    assert paths == [">div.a>b", ">div.a>b>main", ">div.a>b>main>p.c#", ">div.a"]
    assert page.numbers_of([*paths, ">div.z", ""]) == {p: page.path[e + 1] for e, p in enumerate(paths)}


def test_noise_by_whole_names():
    noise = "sidebar site-header page-footer cookie-banner comment-list comments-area related-posts socialShare ad-300x250 adBox main_nav entry-footer user-comments".split()
    clean = "entry-header article-header legal-analysis has-sidebar article-body searching adapter postTitle story notice-of-appeal-history".split()
    assert all(map(extract.is_noise, noise)) and not any(map(extract.is_noise, clean))


def test_extraction_of_two_templates(spark):
    """Half of a host's pages have the article in one container and a teaser in the other's, half the other way round."""
    both = '<div class="a"><p>{a}</p></div><div class="c"><p>{c}</p></div>'
    rows = [(i, "https://h.example/x", page(both.format(a=f"{i} {LONG}", c="teaser") if i % 2 else both.format(a="teaser", c=f"{i} {LONG}"), wrap="{main}")) for i in range(20)]
    rows += [(i, "https://k.example/x", page(f'<article><p>{i} {LONG}</p></article><div class="c"><p>teaser</p></div>' if i < 30 else f'<div class="c"><p>{i} {LONG}</p></div>', wrap="{main}")) for i in range(20, 40)]
    got = {r.page_id: r.text for r in extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i} {LONG}".strip() for i in range(40))


class _Dom(HTMLParser):
    """The article by the standard parser: text of blocks inside ``article``, without the parts that pages below mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.open, self.blocks, self.now = 0, 0, [], [], []

    def close_block(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "li", "ul", "div", "section", "article", "blockquote"):
            self.close_block()
        if tag == "br":
            self.now.append(" ")
            return
        self.open.append((tag, tag in ("nav", "script", "style", "form") or dict(attrs).get("class") in ("ad", "share")))
        self.skip += self.open[-1][1]
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.close_block() if tag not in ("b", "i", "a", "em") else None
        name, skipped = self.open.pop()
        assert name == tag
        self.skip -= skipped
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now.append(data)


def test_extraction_against_a_dom(spark):
    """Well-formed articles of random parts: the same blocks as a plain walk over the standard parser's events."""
    rng = random.Random(6)

    def words(n):
        return " ".join(rng.choice(["one", "two &amp; three", "caf&eacute;", "<b>bold</b>", "<a href='/x'>link</a>", "four\n five", "six<br>seven"]) for _ in range(n))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "div", "section", "ad", "script", "share"])
        if kind in ("div", "section") and depth < 3:
            return f"<{kind} class='k{rng.randrange(9)}'>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 3))) + f"</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(3)}</li>" for _ in range(3)) + "</ul>"
        if kind in ("ad", "share"):
            return f"<div class='{kind}'>Buy</div>"
        return f"<script>{words(2)}</script>" if kind == "script" else f"<{'h2' if kind == 'h2' else 'p'}>{words(12)}</{'h2' if kind == 'h2' else 'p'}>"

    rows = []
    for i in range(60):
        main = f"<article><h1>Title {i}</h1><p>{words(60)}</p>" + "".join(part(0) for _ in range(6)) + "</article>"
        rows.append((i, f"https://h{i % 3}.example/{i}", page(main, wrap="{main}"), main))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract_pages(df).collect()}
    for i, _, _, main in rows:
        dom = _Dom()
        dom.feed(main)
        assert got[i] == "\n\n".join(dom.blocks)


def test_extraction_never_fails():
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "<", ">", "<a href=x>", "</a>", "text ", "<td>", "</table>", "<li>", "<script>", "</b>", "<!--", '"', "&lt;", "<br/>", "<article>"]
    for _ in range(500):
        assert isinstance(extract.extract("".join(rng.choices(parts, k=30)), []), str)


def test_kneser_ney_sums_to_one(spark):
    words = {"a": "abra cadabra abba".split(), "b": "zig zag zigzag abz".split()}
    rows = []
    for name, found in words.items():
        for w in found:
            m = language.START + w + language.END
            rows += [(name, m[i : i + k], 1) for k in range(1, 4) for i in range(len(m) - k + 1)]
    merged = {}
    for name, g, n in rows:
        merged[name, g] = merged.get((name, g), 0) + n
    model = language.train(spark.createDataFrame([(a, g, n) for (a, g), n in merged.items()], "lang string, gram string, n long"), 3)
    letters = sorted({c for f in words.values() for w in f for c in w})
    # After any prefix the chances of all symbols, the end and one unseen symbol add up to 1.
    for prefix in ("a", "ab", "zi", "gza"):
        chances = [np.exp(-model.symbols([prefix + c])[0][len(prefix) + 1]) for c in [*letters, "é"]]
        end = np.exp(-model.symbols([prefix])[0][len(prefix) + 1])
        assert np.allclose(sum(chances) + end, 1, atol=1e-5)
    a, b = model.words(["abra"])[0], model.words(["zig"])[0]
    assert model.languages == ["a", "b"] and a[0] < a[1] and b[1] < b[0]


def brute_kneser_ney(counts, order, prefix, symbol, base):
    """Interpolated Kneser-Ney by the book for one language, on plain dictionaries: chance of ``symbol`` after ``prefix``."""
    def c(gram):
        if len(gram) == order or gram[0] == language.START and len(gram) > 1:
            return counts.get(gram, 0)
        return sum(g[1:] == gram for g in counts if len(g) == len(gram) + 1)

    def grams(size):
        return {g for g in counts if len(g) == size and (size == order or g[0] == language.START and size > 1)} | {g[1:] for g in counts if len(g) == size + 1 <= order}

    def chance(context):
        lower = chance(context[1:]) if context else base
        own = [g for g in grams(len(context) + 1) if g[:-1] == context and g[-1] != language.START]
        if not own:
            return lower
        sizes = [c(g) for g in grams(len(context) + 1)]
        ones, twos = sizes.count(1), sizes.count(2)
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total = sum(map(c, own))
        return max(c(context + symbol) - d, 0) / total * (context + symbol in own) + d * len(own) / total * lower

    return chance(prefix[-(order - 1) :])


def test_kneser_ney_against_the_formula(spark):
    words = {"a": "abra cadabra abba abra bar".split(), "b": "zig zag zigzag abz zag".split()}
    counts = {}
    for name, found in words.items():
        own = counts.setdefault(name, {})
        for w in found:
            m = language.START + w + language.END
            for k in range(1, 4):
                for i in range(len(m) - k + 1):
                    own[m[i : i + k]] = own.get(m[i : i + k], 0) + 1
    model = language.train(spark.createDataFrame([(a, g, n) for a, own in counts.items() for g, n in own.items()], "lang string, gram string, n long"), 3)
    for word in ("abra", "zag", "bazi", "q"):
        cost = model.symbols([word])[0]
        marked = language.START + word + language.END
        for i in range(1, len(marked)):
            for k, name in enumerate("ab"):
                want = brute_kneser_ney(counts[name], 3, marked[:i], marked[i], model.base)
                assert math.isclose(np.exp(-cost[i][k]), want, rel_tol=1e-4), (word, i, name)


def test_kneser_ney_is_estimated_before_it_is_pruned(spark):
    """With few n-grams kept, those have the chances that all counts give them, the discount is that of all counts, and sums are one."""
    rng = random.Random(2)
    counts = {}
    for w in ["".join(rng.choices("abcde", weights=[9, 5, 3, 2, 1], k=rng.randint(1, 6))) for _ in range(150)]:
        m = language.START + w + language.END
        for k in range(1, 4):
            for i in range(len(m) - k + 1):
                counts[m[i : i + k]] = counts.get(m[i : i + k], 0) + 1
    rows = spark.createDataFrame([("a", g, n) for g, n in counts.items()], "lang string, gram string, n long")
    grams = 40
    whole, pruned = language.train(rows, 3), language.train(rows, 3, grams=grams)
    size = [sum(n for g, n in counts.items() if len(g) == k) for k in (1, 2, 3)]
    strong = {g for g, n in counts.items() if len(g) == 1 or n * grams >= size[len(g) - 1]}
    kept = {g[:k] for g in strong for k in range(1, len(g) + 1)}
    assert [len(h) for h in pruned.hashes] == [len({g for g in kept if len(g) == k}) for k in (1, 2, 3)] and len(kept) < len(counts) / 2
    singles = sum(n == 1 for g, n in counts.items() if len(g) == 3)
    assert singles > 10 and not any(counts[g] == 1 for g in kept if len(g) == 3)  # a cut before would leave none to estimate by
    for prefix in ("", "a", "ab", "ca", "eb"):
        marked = language.START + prefix
        for symbol in "abcde":
            cost = pruned.symbols([prefix + symbol])[0][len(prefix) + 1]
            if marked[-2:] + symbol in kept and len(marked) > 1:
                context, full = marked[-2:], brute_kneser_ney(counts, 3, marked, symbol, pruned.base)
                below = brute_kneser_ney(counts, 3, marked[-1:], symbol, pruned.base)
                lost = sum(brute_own(counts, context + s) for s in "abcde" + language.END if context + s in counts and context + s not in kept)
                if context[1:] + symbol in kept and all(context[1:] + s in kept or context[1:] + s not in counts for s in "abcde" + language.END):
                    assert math.isclose(np.exp(-cost[0]), full + lost * below, rel_tol=1e-4)
        chances = [np.exp(-pruned.symbols([prefix + c])[0][len(prefix) + 1]) for c in "abcdeé"]
        end = np.exp(-pruned.symbols([prefix])[0][len(prefix) + 1]) if prefix else np.exp(-pruned.symbols([""])[0][1])
        assert np.allclose(sum(chances) + end, 1, atol=1e-5)
    assert whole.base == pruned.base and np.array_equal(whole.empty, pruned.empty)


def brute_own(counts, gram):
    """What the top order itself gives a gram of three symbols."""
    sizes = [n for g, n in counts.items() if len(g) == 3]
    ones, twos = sizes.count(1), sizes.count(2)
    d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    return max(counts[gram] - d, 0) / sum(n for g, n in counts.items() if len(g) == 3 and g[:2] == gram[:2])


def test_language_id(spark):
    r = language.op9_language_id(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = r.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.count_if("rejected")).first()
    assert held[0] >= 0.98 and held[1] > 100 and held[2] == 0
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language.learn(docs)
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, " ".join("".join(random.Random(i).choices("qxzjkvwp", k=9)) for i in range(60))), (5, "the and of that is"), (5, "the and of that is"), (6, "the " * 100_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit("zz")).withColumn("row", F.lit(1)).withColumn("score", F.lit("own")).withColumn("_", F.lit(2))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[1].row == 1 and got[1]["_"] == 2 and isinstance(got[5].score, float)
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"own"}
    assert got[4].rejected and not got[5].rejected and got[6].lang_pred == "en"
    assert sorted(r.doc_id for r in language.keep_identified(df, model).collect()) == [5, 5, 6]
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_grammar():
    read = toxic.Reader(toxic.seed_stems())
    most = lambda t: read.features(t)[0]
    assert most("you are an idiot") > most("an idiot") > most("not an idiot") > 0
    assert most("he said an idiot came") < most("an idiot came") and most("you said") == most("") == 0
    assert most("I will kill you") > most("time to kill")
    assert most("I will really hurt you") > most("they hurt you") > most("it hurt") and most("I hope you will burn") > most("a burn")
    one, other = toxic._span(1, (2,), 2, 0.5, 0.1), toxic._span(3, (2,), 1, 0.2, 0.0)
    both = toxic.compose(one, other)
    s = w = 0
    for symbol in (1, 3, 2):
        s, g, f, w = both.arc(s, symbol)
    assert g == 0 and math.isclose(f, 0.1) and math.isclose(w, 0.1)


def plain_clause_weight(symbols, weights):
    """The grammar as windows over the words, without any automaton."""
    total = 0.0
    for i, s in enumerate(symbols):
        def within(kind, n):
            return kind in symbols[max(0, i - n) : i]

        gain = addend = 0.0
        if s == toxic.INSULT:
            gain = 1.0
            addend += 0.2 if i and symbols[i - 1] == toxic.INSULT else 0.0
        if s == toxic.TARGET and i and symbols[i - 1] == toxic.INSULT:
            addend += 0.3
        if s == toxic.HARM:
            # Intent among the three words before, and no harm after it.
            meant = [j for j in range(max(0, i - 3), i) if symbols[j] == toxic.INTENT]
            gain = 1.5 if meant and toxic.HARM not in symbols[meant[-1] : i] else 0.5
        if s == toxic.TARGET:
            # The last harm among the three words before, with neither intent nor another target after it.
            harm = [j for j in range(max(0, i - 3), i) if symbols[j] == toxic.HARM]
            if harm and not {toxic.INTENT, toxic.TARGET} & set(symbols[harm[-1] + 1 : i]):
                j = harm[-1]
                meant = [k for k in range(max(0, j - 3), j) if symbols[k] == toxic.INTENT]
                addend += 0.7 if meant and toxic.HARM not in symbols[meant[-1] : j] else 0.3
        factor = 1.0
        if s in (toxic.INSULT, toxic.HARM):
            addend += 0.5 if within(toxic.TARGET, 4) else 0.0
            factor *= (0.4 if within(toxic.NEGATION, 3) else 1.0) * (0.6 if within(toxic.REPORT, 12) else 1.0)
        total += factor * (gain * weights[i] + addend)
    return total


def test_grammar_against_plain_windows():
    rng = random.Random(8)
    for _ in range(4000):
        symbols = [rng.randrange(toxic.CLASSES) for _ in range(rng.randint(0, 14))]
        weights = [rng.choice([0.5, 1.0, 2.0]) if s in (toxic.INSULT, toxic.HARM) else 0.0 for s in symbols]
        assert math.isclose(toxic.clause_weight(symbols, weights), plain_clause_weight(symbols, weights), abs_tol=1e-9), symbols


def test_negations_shouting_and_short_stems():
    read = toxic.Reader(toxic.seed_stems())
    most = lambda t: read.features(t)[0]
    for negated in ("I won't hurt you", "I won’t hurt you", "you cannot hurt them", "he wouldn't hurt you", "sin matar", "ohne töten"):
        assert 0 < most(negated) < most(negated.replace("won't", "will").replace("won’t", "will").replace("cannot", "must").replace("wouldn't", "would").replace("sin", "vas").replace("ohne", "wirst"))
    assert most("IDIOT!! MORON!!") == most("idiot moron") > most("idiot. moron") and most("you are an idiot! fine") == most("you are an idiot")
    stems = toxic.choose_stems({"worth": (10, 0), "worthless ": (10, 0), "wors": (12, 0), "work": (8, 60)}, 60, 60)
    assert set(stems) >= {"worthless ", "wors"} and not any(s.startswith("work") for s in stems)
    assert min(map(len, toxic._stems_of("wor worm working"))) == toxic.LEAST_STEM


def test_stems_against_longest_prefix():
    rng = random.Random(9)
    stems = {"".join(rng.choices("abé ", k=rng.randint(1, 5))): (1, float(i)) for i in range(60)}
    read = toxic.Stems(stems)
    for _ in range(2000):
        word = "".join(rng.choices("abéc", k=rng.randint(0, 7)))
        fit = [s for s in stems if (word + " ").startswith(s)]
        assert read.read(word) == (stems[max(fit, key=len)] if fit else None)


def test_toxicity(spark):
    r = toxic.op8_toxicity(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id")
    held = r.where("held_out").agg(F.count_if(F.expr("toxic = 0 and predicted = 1")), F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 1"))).first()
    assert held[0] == 0 and held[1] >= 0.7 * held[2]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 50_000), (3, "fine")], "doc_id long, text string").withColumn("predicted_", F.lit(1))
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxic.learn(docs, labels)
    got = toxic.toxicity(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score < 0.5
    assert toxic.toxicity(docs.limit(0), model).count() == 0


def test_toxicity_keeps_columns(spark):
    df = spark.createDataFrame([(1, "you idiot", 5.0, "own", 2), (1, "you idiot", 6.0, "own", 3)], "doc_id long, text string, score double, predicted string, row int")
    got = toxic.toxicity(df, toxic.Model(toxic.seed_stems()))
    assert got.columns == ["doc_id", "row", "score", "predicted"] and sorted((r.row, r.predicted) for r in got.collect())[0][0] == 2


def test_toxic_stems_by_hand(spark):
    """Stems are chosen by rows and odds over both labels: of a marked word its longest stem without other words."""
    docs = spark.createDataFrame([(i, f"w{i} blorgish {'grolk' if i % 2 else 'calm'} end") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxic.learn(docs, labels)
    learned = {s for s in model.stems if s not in toxic.seed_stems()}
    assert learned == {"grolk "}


def test_packing_of_long_white_space(spark):
    rows = [(1, " " * 1_200_000), (2, "a" + "\n\t " * 500_000 + "b"), (3, "x" * 1_000_000)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in packing.unpack_documents(packed).collect()) == rows


def test_extraction_of_ties_and_long_pages(spark):
    """Two containers with as many votes: the one with more text; and a page of a million words, whole."""
    one, two = '<div class="a"><p>{t}</p></div>', '<div class="b"><p>{t}</p></div>'
    rows = [(i, "https://h.example/x", page((one if i % 2 else two).format(t=f"{i} {LONG}"), wrap="{main}")) for i in range(6)]
    rows.append((6, "https://h.example/y", "<article>" + "<p>word word</p>" * 500_000 + "</article>"))
    got = {r.page_id: r.text for r in extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i} {LONG}".strip() for i in range(6))
    assert got[6] == "\n\n".join(["word word"] * 500_000)


def test_language_ties(spark):
    """Two languages learned from the same texts: the first in code point order."""
    rows = [(i, "la casa y el perro " + "abcdefgh"[i % 8] * 3, lang) for i in range(40) for lang in ("zz", "aa")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "el perro")], "doc_id long, text string"), model).collect()} == {"aa"}


def test_decontamination_of_long_items(spark):
    """An item far longer than any document, an item twice, and a passage of it in a long text."""
    rng = random.Random(15)
    item = [f"t{rng.randrange(10**6)}" for _ in range(20_000)]
    texts = [(1, " ".join(f"x{i}" for i in range(100_000)) + " " + " ".join(item[9000:9014])), (2, " ".join(item[5:17])), (3, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert [got[i].item_ids for i in (1, 2, 3)] == [[7], [], [7]]
    assert (got[1].first_word, got[1].end_word) == (99_998, 100_014) and (got[3].first_word, got[3].end_word) == (0, 20_000)


def brute_contaminated(texts, items, window=13, identity=0.8, least=1):
    """Texts of which any stretch agrees with any stretch of an item, at every alignment, by sets of places; with a tokenizer of its own."""
    alone = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
    words = lambda t: regex.findall(rf"[{alone}]\p{{M}}*|(?:(?![{alone}])[\p{{L}}\p{{M}}\p{{N}}])+", t.lower())
    found = set()
    tokens = [w for t in items if (w := words(t or "")) and len(w) >= least]
    for d, t in texts:
        doc = words(t or "")
        for item in tokens:
            n = min(window, len(item))
            need = math.ceil(identity * n - 1e-9)
            places = {}
            for k, w in enumerate(item):
                places.setdefault(w, []).append(k)
            hits = {}
            for i, w in enumerate(doc):
                for k in places.get(w, ()):
                    hits.setdefault(i - k, set()).add(i)
            for shift, equal in hits.items():
                starts = range(max(0, shift), min(len(doc), shift + len(item)) - n + 1)
                if len(equal) >= need and any(sum(i in equal for i in range(a, a + n)) >= need for a in starts):
                    found.add(d)
    return found


def test_decontamination_at_all_alignments(spark):
    rng = random.Random(14)
    words = [f"t{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(40)]
    texts = []
    for i in range(300):
        w = rng.choices(words, k=30)
        item = rng.choice(items).split()
        cut = item[rng.randrange(len(item)) :][: rng.randint(4, 30)]
        cut = [x if rng.random() > 0.12 else "other" for x in cut]
        texts.append((i, " ".join(w[:15] + cut + w[15:])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = brute_contaminated(texts, items)
    assert 50 < len(want) < 290
    assert {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()} == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {d for d, _ in texts} - want


def test_decontamination_of_any_script(spark):
    """Dashes, quotes and spaces of any kind, scripts without spaces, and items of few tokens, which have to be there as they are."""
    dash = "the capital of that old country is a city by the river and the sea they say"
    han, hindi, thai = "北京是中华人民共和国的首都和政治文化中心", "भारत की राजधानी नई दिल्ली है और यह यमुना नदी के किनारे", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    items = [(1, dash), (2, han), (3, hindi), (4, thai), (5, "one two three four"), (6, "Zwölf"), (7, "—…"), (8, dash.upper())]
    texts = [
        (1, "x " + dash.replace("capital of", "capital\u2014of").replace(" the ", "\u00a0the\u2003").replace("city", "\u201ccity\u201d") + " y"),
        (2, f"前文{han}。後文"),
        (3, f"यह {hindi}।"),
        (4, thai[:3] + thai),
        (5, "zero one two, three: four five"),
        (6, "zwölf."),
        (7, "one two three"),
        (8, "zwölfte — …"),
        (9, han[:8]),
        (10, "one two thre four"),
    ]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert got == {1: [1, 8], 2: [2], 3: [3], 4: [4], 5: [5], 6: [6]} and set(got) == brute_contaminated(texts, [t for _, t in items])


def test_pipeline_of_odd_tables(spark):
    """No rows; and repeated rows, a very long text, and columns with names that stages use."""
    import corpus_pipeline as p

    some = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60")
    long = some.orderBy("doc_id").limit(1).select((F.col("doc_id") + 9000).alias("doc_id"), F.repeat(F.concat("text", F.lit("\n")), 300).alias("text"), "lang", "source", "n_chars")
    odd = some.unionByName(some.limit(5)).unionByName(long).withColumns({"node": F.lit(1), "key": F.lit("k"), "size": F.lit(2), "doc": F.lit(3), "copies": F.lit(4), "sum": F.lit(5), "score": F.lit("s"), "_word": F.lit(6), "_again": F.lit(7)})
    for docs in (odd.limit(0), odd):
        kinds = docs.dtypes
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, D).cache()
            assert docs.dtypes == kinds, name
        rows = packing.unpack_documents(p.STAGES[-1][1](spark, docs, D)).collect()
        assert sorted(r.text for r in rows) == sorted(r.text for r in docs.collect() if r.text)


def test_pipeline(spark):
    """Each stage against a plain version of it: components of all pairs, all alignments, a queue; and a round trip."""
    import corpus_pipeline as p

    from vellumflow.llm import op2_mix_sources as mixing

    from .test_native import brute_mix
    from .test_similar import brute_components

    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 200")
    odd = [(-1, None, "en", "src0", 0), (-2, "", None, None, None), (-3, docs.first().text, "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kinds, rows = docs.dtypes, {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = {d for d, r in rows.items() if any(map(str.isalpha, r.text or ""))}  # the documents are all in one of the languages
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, D).cache()
        assert docs.dtypes == kinds, name
        found = docs.collect()
        assert all(tuple(rows[r.doc_id]) == tuple(r) for r in found)
        if name == "near_duplicates":
            want = {d for d, root in brute_components([(d, rows[d].text) for d in want]).items() if d == root}
        if name == "decontamination":
            want -= brute_contaminated([(d, rows[d].text) for d in want], items)
        if name == "mixing":
            placed = before.select("doc_id", "text", "source", F.struct(*mixing.shuffled_place()).alias("p")).collect()
            plain = [(r.doc_id, " ".join((r.text or "").encode().decode().split()) if r.text.isascii() else " ".join(w for w in re.split(r"[\x20\x09-\x0d]+", r.text) if w), r.source) for r in placed]
            copies = brute_mix(plain, [tuple(r.p) for r in placed])
            want = sorted(d for (d, _, _), n in zip(plain, copies, strict=True) for _ in range(n))
            assert sorted(r.doc_id for r in found) == want
        else:
            assert sorted(r.doc_id for r in found) == sorted(want), name
    packed = p.STAGES[-1][1](spark, docs, D)
    got = sorted(r.text for r in packing.unpack_documents(packed).collect())
    assert got == sorted(r.text for r in docs.collect() if r.text)


def test_pipeline_sends_texts_in_small_batches(spark):
    """After each stage that uses Python, what it returns is run in batches of a bounded number of rows; a run leaves the setting as it was."""
    import corpus_pipeline as p

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40")
    try:
        for name, stage in p.STAGES:
            spark.conf.unset(rows)
            stage(spark, docs, D)
            if name != "mixing":
                assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) <= p.BATCH_ROWS, name
        spark.conf.set(rows, 7)  # a smaller number stays
        p.language_id(spark, docs, D)
        assert spark.conf.get(rows) == "7"
    finally:
        spark.conf.set(rows, before)


def test_keep_identified_is_what_is_not_rejected(spark):
    """Rows as they were, whatever columns are named, judged by the text inside the row."""
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 150")
    odd = docs.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 34", None, None, None), (-4, "qzx " * 80, "en", "s", 0)], docs.schema))
    odd = odd.withColumns({"row": F.lit(1), "_": F.lit(None).cast("string"), "a.b": F.array(F.lit(2)), "rejected": F.lit("r")})
    model = language.learn(docs)
    judged = {r.doc_id: r.rejected for r in language.identify(odd.select("doc_id", "text"), model).collect()}
    kept = language.keep_identified(odd, model)
    assert kept.dtypes == odd.dtypes
    got, want = kept.collect(), [r for r in odd.collect() if not judged[r.doc_id]]
    assert {-1, -2, -3} <= {d for d, out in judged.items() if out} and sorted(map(repr, got)) == sorted(map(repr, want)) and got
    assert language.keep_identified(odd, language.learn(docs.limit(0))).collect() == []
