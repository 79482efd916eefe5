import pytest

from wardspark.llm import pages

PLAIN = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    "<div class='ad'>Buy now, it is cheap, really. Very cheap.</div>"
    "<article><h1>A title</h1><p><b>First &amp; best<br><p>Second\n  part, with <i>words</i>.</p><p>Ok.</p></article>"
    "<footer>&copy; site. All rights.</footer></body></html>"
)


def test_article_without_the_rest():
    assert pages.main_text(PLAIN) == "A title First & best Second part, with words. Ok."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("a < b & c", "a < b & c"),
    ("<script>var t='</p>';</script><p>One.</p>", "One."), ("<!-- hidden --><p>One.<!-- <p>no</p> --> Two.</p>", "One. Two."),
    ("<p>One <script>x", "One"), ("<p title='a>b'>One.</p>", "One."), ('<p title="broken>One.', "One."),
    ("<p title='hidden gem' data-id=ad>One.</p>", "One."), ("<div hidden>No.</div><p>One.</p>", "One."),
    ("<body><main><p>One, two, three.</p><form>Name <input></form><p>Four.</p></main></body>", "One, two, three. Four."),
    ("<article><p>Long text here, with marks.</p><section id='comments'><p>I agree, good.</p></section></article>",
     "Long text here, with marks."),
    ("<article><header>By me</header><p>Text&nbsp;here.</p><aside>See also</aside></article>", "By me Text here."),
    ("<div><p>A paragraph, rather long, of text.</p><ul><li>item one</ul></div>", "A paragraph, rather long, of text. item one"),
    ("<div class='cookie-notice'>We use cookies.</div><div id=content><p>Body of it, whole.</p></div>", "Body of it, whole."),
    ("<div class='wrap has-sidebar'><div><p>Body, of the page.</p></div></div>", "Body, of the page."),
    ("<div class='header-fixed'><article><p>Body, of it.</p></article><p>Menu</p></div>", "Body, of it."),
    ("<main><article class='post'><p>Body, of it.</p></article><article class='comment'><p>Nice, thanks.</p></article></main>",
     "Body, of it."),
    ("<article><p>Body, of it.</p><div id=comments><article><p>Well said, you.</p></article></div></article>", "Body, of it."),
    ("<div class='sidebar'><p>Aside, this.</p></div><div class=content><p>The text, all.</p><p>Ok.</p></div>", "The text, all. Ok."),
    ("<p>&lt;b&gt; &#233;&#x1F600;</p>", "<b> é😀"),
    ("<article class='post category-advertising'><p>Body, of it.</p></article>", "Body, of it."),
    ("<article class='post tag-cookies comments-open'><p>Body, of it.</p></article>", "Body, of it."),
    ("<div class='content related-enabled'><p>Body, of the page.</p></div>", "Body, of the page."),
    ("<div class='newsletter-on'><article><p>Body, of it.</p></article><p>Mail, us.</p></div>", "Body, of it."),
    ("<div><p>Body, of the page, whole.</p><div class='ad-slot'><p>Buy, now.</p></div></div>", "Body, of the page, whole."),
    ("<main><p>Body, of it.</p><article class='comment-12'><p>Nice, thanks.</p></article></main>", "Body, of it."),
])
def test_cases(page, want):
    assert pages.main_text(page) == want


LI = "A step of the list, with some words."
P = "A paragraph of the article, long enough, with marks."
SITE = "<body><nav><a href='/'>Home</a></nav>{}<footer>All rights.</footer></body>"


@pytest.mark.parametrize("body,want", [
    (f"<div class=content><p>{P}</p><ul>{f'<li>{LI}</li>' * 20}</ul><p>The end, all.</p></div>",
     " ".join([P, *[LI] * 20, "The end, all."])),
    (f"<div id=page><div class=intro><p>{P}</p><p>{P}</p></div><div class=body>{f'<p>{P}</p>' * 4}</div></div>", " ".join([P] * 6)),
    (f"<div class=intro><p>{P}</p><p>{P}</p></div><div class=body>{f'<p>{P}</p>' * 4}</div>", " ".join([P] * 6)),
    (f"<div class=head><h1>A title</h1></div><div class=body>{f'<p>{P}</p>' * 4}</div>", " ".join(["A title", *[P] * 4])),
    (f"<div class=body>{f'<p>{P}</p>' * 6}<p>Ok.</p></div><div class=note>Mind</div>", " ".join([*[P] * 6, "Ok."])),
])
def test_articles_of_several_paths(body, want):
    assert pages.main_text(SITE.format(body)) == want


def test_long_and_broken_pages_end():
    assert len(pages.main_text("<article>" + "<p>word, word." * 20000)) == 20000 * 11 + 19999
    assert pages.main_text("<" * 20000).count("<") == 20000
    assert pages.main_text('<a "' * 5000) is not None


def test_rows(spark):
    rows = [(1, "u", PLAIN, "x"), (1, "u", PLAIN, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 49), (1, 49)]
    assert pages.extract_pages(df.limit(0)).collect() == []


TWENTY = " ".join(["This is a sentence of the text, and it goes on."] * 20)


@pytest.mark.parametrize("page,want", [
    (f"<body><form><nav><a href=/>Home</a></nav><p>{TWENTY}</p><p>{P}</p></form></body>", f"{TWENTY} {P}"),
    (f"<body><div class='legal'><p>{TWENTY}</p></div><div class=ad>Buy, now.</div></body>", TWENTY),
    (f"<body><nav><a>Home</a></nav><div id='notice'><article><p>{TWENTY}</p></article></div><footer>All.</footer></body>", TWENTY),
    (f"<article class=intro><p>{P}</p></article><article class=body><p>{TWENTY}</p></article>", f"{P} {TWENTY}"),
    (f"<article><p>A teaser, of one line.</p></article><div class=story><p>{TWENTY}</p><p>{TWENTY}</p></div>", f"{TWENTY} {TWENTY}"),
    (f"<article><svg><p>{TWENTY}</p></article>", TWENTY),
    (f"<article><svg><text>drawn</text></svg><p>{TWENTY}</p></article>", TWENTY),
    (f"<article><header><h1>A title</h1><p>The lead, of it.</p></header><p>{TWENTY}</p></article>", f"A title The lead, of it. {TWENTY}"),
    ("<article><p>Take <math><mi>x</mi></math> and press <button>Go</button> now.</p></article>", "Take x and press Go now."),
    (f"<main><p>{TWENTY}</p><div class=signup><p>Sign up for our letter, now.</p></div><ul class=sitemap>"
     "<li><a>One</a></li><li><a>Two</a></li></ul></main>", TWENTY),
    ("<article><p>Ok.</p></article><footer>All rights of this long footer are reserved, for ever, by all.</footer>", "Ok."),
    (f"<article><p>{P}</p><div style='display: none'>{TWENTY}</div></article>", P),
    (f"<article><p>{P}</p><ol class=commentlist><li><p>{TWENTY}</p></li></ol></article>", P),
    (f"<body><select><option>One<option>Two</select><div>{TWENTY}</div><button>Send</button></body>", TWENTY),
])
def test_ratios_and_features(page, want):
    assert pages.main_text(page) == want


@pytest.mark.parametrize("page", [
    "".join(f"<div>t{i}, " for i in range(20_000)), "".join(f"<p class=c{i}>t " for i in range(20_000)), "<svg>" * 20_000,
    "".join(f"<ul><li>t{i}" for i in range(10_000)), "<div>" * 20_000 + "<p>x</div>" * 20_000, "<body>" * 20_000 + "x",
    "<table><tr><td>x" * 8_000, "</div>" * 20_000 + "<a>" * 20_000,
])
def test_deep_pages_take_linear_time(page):
    import time

    start = time.process_time()
    pages.main_text(page)
    assert time.process_time() - start < 3


def brute(page):
    """Text of a page by scores worked out for every block from all others."""
    read = pages.read_page(page)
    if not read.blocks:
        return ""

    def chain(number, parents):
        out = []
        while number:
            out.append(number)
            number = parents[number]
        return out[::-1]

    def steps(path):
        return tuple(read.tags[p] for p in chain(path, read.parents))

    def part(path):
        """The path around, without lists and tables."""
        around = chain(path, read.parents)[:-1]
        while around and read.tags[around[-1]] in pages.TRANSPARENT:
            around.pop()
        return around[-1] if around else 0

    total = sum(len(b[2]) for b in read.blocks)

    def inside(element):
        return sum(len(b[2]) for b in read.blocks if element in chain(b[1], read.around))

    held = {e: inside(e) for e in {e for b in read.blocks for e in chain(b[1], read.around)}}

    def feature(block):
        product = 1.0
        for element in chain(block[1], read.around):
            factor, always = read.factors[element]
            if factor >= 1 or always or 2 * held[element] <= total:
                product *= factor
        return product * (1 - block[3] / len(block[2])) ** 2

    paths = {b[0] for b in read.blocks}
    own = {p: [b for b in read.blocks if b[0] == p] for p in paths}
    size = {p: sum(len(b[2]) for b in own[p]) for p in paths}
    ratio = {
        p: sum(len(b[2]) - b[3] for b in own[p]) / len(own[p]) ** 0.5
        * (1 + sum(len(pages.PUNCTUATION.findall(b[2])) for b in own[p] if len(b[2]) > b[3]) / len(own[p])) for p in paths
    }
    fused = {
        p: sum(len(b[2]) * feature(b) for b in own[p]) / size[p] * (5 if pages.ARTICLE & set(steps(p)) else 1) for p in paths
    }

    def mean(group):
        return sum(ratio[p] * size[p] for p in group) / sum(size[p] for p in group) if group else 0

    score = {
        p: fused[p] * (
            ratio[p] + mean([q for q in paths if part(q) == part(p)]) + mean([q for q in paths if steps(q) == steps(p)])
            + mean([q for q in paths if part(q) == part(part(p))])
        ) for p in paths
    }
    lifted = dict(score)
    for p in paths:
        if read.tags[p] in pages.HEADINGS and fused[p] >= 0.3:
            heads = weight = 0
            for k, b in enumerate(read.blocks):
                if b[0] == p:
                    follows = next((c[0] for c in read.blocks[k + 1:] if read.tags[c[0]] not in pages.HEADINGS), None)
                    heads += len(b[2]) * score[follows] if follows is not None else 0
                    weight += len(b[2])
            lifted[p] = max(score[p], 0.5 * heads / weight)
    least = 0.25 * sum(lifted[b[0]] * len(b[2]) for b in read.blocks) / total
    return " ".join(b[2] for b in read.blocks if lifted[b[0]] > 0 and lifted[b[0]] >= least * (1 - 1e-12))


def given(spark, folder="sf0.01"):
    return [r.html for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("html").collect()]


def plain_tags(page):
    """The page with nothing but unnamed parts."""
    for tag, name in (("article", "c1"), ("nav", "c4"), ("footer", "c3")):
        page = page.replace(f"<{tag}", f'<div class="{name}"').replace(f"</{tag}", "</div")
    return page.replace('class="ad"', 'class="c2"')


def test_all_given_pages_against_brute_force(spark):
    for page in given(spark, "sf0.1"):
        assert pages.main_text(page) == brute(page)
        assert pages.main_text(plain_tags(page)) == brute(plain_tags(page))


def test_ratios_decide(spark, monkeypatch):
    """Without names that tell, ratios alone find the article; other ratios find other text."""
    all_pages = given(spark)
    named = [pages.main_text(p) for p in all_pages]
    found = [pages.main_text(plain_tags(p)) for p in all_pages]
    assert all(n in f for n, f in zip(named, found))
    assert sum(n == f for n, f in zip(named, found)) > 0.75 * len(named)
    ratios = pages.path_ratios
    monkeypatch.setattr(pages, "path_ratios", lambda page: ({p: 1.0 for p in ratios(page)[0]}, *ratios(page)[1:]))
    assert sum(pages.main_text(plain_tags(p)) != f for p, f in zip(all_pages, found)) > 0.7 * len(found)
    monkeypatch.undo()
    monkeypatch.setattr(pages, "path_scores", lambda page: {b[0]: 1.0 for b in page.blocks})
    assert all(pages.main_text(p) != n for p, n in zip(all_pages, named))
