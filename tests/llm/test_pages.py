from llm.conftest import rows_of
from stratakeep.llm.pages import blocks, main_text


def article(html):
    return "\n".join(b for b, where in blocks(html)[0] if where == 2)


def test_landmarks():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header>
    <nav><ul><li>A<li>B</ul></nav><div class="ad">Buy</div><main><h1>Hi &amp; bye&#33;</h1><p>One<p>Two <b>bold</b>   text<br>more
    <script>if (a<b) "</p>"</script><aside>side</aside><div id="comments">c1<p>c2</div><form><label>x</label></form>
    <div hidden>h</div><div style="display: none">n</div><!-- c --><table><tr><td>c<td>d</table><p>a &lt; b > c &nbsp; d</p></main><footer>f</footer>"""
    assert article(html) == "Hi & bye!\nOne\nTwo bold text more\nc\nd\na < b > c d"


def test_broken_pages():
    assert article("<article><p><b>x<br><p>y</article><p>out") == "x\ny"
    assert article("<article>a<script>never closed <p>b") == "a"
    assert article("<article>a <!-- open") == "a"
    assert article("<article>1 < 2 & 3 &am") == "1 < 2 & 3 &am"
    assert article("<article><div class='x' data-a=\"a>b\">t</div></article>") == "t"
    assert article("<article><p>a<article>b</article>c</p></article>") == "a\nb\nc"
    assert blocks(None) == ([], False) and blocks("") == ([], False)


def test_implied_ends_of_excluded_elements():
    """What a marked or hidden element excludes ends where the element does, with an end tag or without."""
    assert article("<article><p hidden>secret<p>visible</article>") == "visible"
    assert article("<article><ul><li class='ad'>x<li>real</ul><dl><dt hidden>a<dd>b</dl></article>") == "real\nb"
    assert article("<article><table><tr><td class=promo>x<td>y<tr hidden><td>z<tr><td>w</table>after</article>") == "y\nw\nafter"


def test_host_repeats(spark):
    menu = "<div>Home News Sport Weather Travel Money Shop</div>"
    page = lambda k: f"<body>{menu}<div>Unique text number {k} of this page w{k} x{k} y{k} z{k}</div><div>Short one</div></body>"
    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(4)] + [(0, "https://h.example/0", page(0)), (9, None, None), (10, "x", ""), (None, "https://other/", f"<p>{menu}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host", "2 AS page", "3 AS block")
    got = main_text(pages)
    want = [(k, f"Unique text number {k} of this page w{k} x{k} y{k} z{k}", 45) for k in (0, 0, 1, 2, 3)] + [(9, "", 0), (10, "", 0), (None, "Home News Sport Weather Travel Money Shop", 41)]
    assert rows_of(got, "page_id", "text", "n_chars") == sorted(want, key=str)
    assert main_text(pages.limit(0)).count() == 0


def test_marks_in_other_spellings():
    for mark in ('class="reader-comments"', 'id="google_ads_2"', 'class="cookieBanner"', 'class="cta"', 'class="SiteFooter"'):
        assert article(f"<article><p>text<div {mark}>no</div><p>more</article>") == "text\nmore"
    assert article("<article class='post hasSidebar'><p class='readerFavourite'>text</article>") == "text"


def repeats_by_counting(pages, need=3, share=0.2, n=6):
    """Of each page the blocks that substrings of n tokens don't cover which enough of the pages' contents have, by plain search."""
    from stratakeep.llm.pages import blocks as found

    contents = {}
    for host, html in pages:
        contents.setdefault(host, set()).add(tuple(b for b, where in found(html)[0] if where < 2))
    out = []
    for host, html in pages:
        kept = []
        for b, where in found(html)[0]:
            words, covered = b.split(" "), set()
            for i in range(max(1, len(words) - n + 1)):
                window = words[i : i + n]
                of = lambda c: any(w[k : k + n] == window and (len(window) == n or len(w) == len(window)) for w in (x.split(" ") for x in c) for k in range(len(w)))  # noqa: B023, E731
                hits = sum(of(c) for c in contents[host])
                if hits >= need and hits >= share * len(contents[host]):
                    covered.update(range(i, i + len(window)))
            if where == 1 and len(covered) < len(words):
                kept.append(b)
        out.append("\n".join(kept))
    return out


def test_repeats_are_those_counted(spark):
    import random

    rng = random.Random(1)
    words = "one two three four five six seven eight nine ten".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, pages = [sentence(n) for n in (3, 5, 7, 9, 12)], []
    for k in range(40):
        host = rng.choice("aab")
        body = [rng.choice(common) if rng.random() < 0.5 else rng.choice(common) + " " + sentence(4) if rng.random() < 0.3 else sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 6))]
        pages.append((host, "".join(f"<p>{b}</p>" for b in body)))
    pages += pages[:3]
    df = spark.createDataFrame([(k, f"https://{h}.example/{k}", html) for k, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in sorted(main_text(df).collect(), key=lambda r: r.page_id)] == repeats_by_counting(pages)


def test_articles_without_landmarks_stay_whole(spark):
    menu = "<div>Home News Sport Weather Travel Money Shop</div>"
    article_ = "<p>He said that the council met on Monday to vote on something else entirely.</p>"
    pages = [menu + f"<p>Story {k} a{k} b{k} c{k} d{k} e{k} f{k}.</p>" for k in range(12)] + [menu + article_] * 4 + [menu + "<p>Nobody knew that the council met on Monday to vote on it.</p>"]
    df = spark.createDataFrame([(k, f"https://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got[0] == "Story 0 a0 b0 c0 d0 e0 f0." and got[12] == got[15] == "He said that the council met on Monday to vote on something else entirely."
    assert got[16] == "Nobody knew that the council met on Monday to vote on it."


def test_long_page(spark):
    html = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    got = main_text(spark.createDataFrame([(1, "https://h/", html)], "page_id long, url string, html string")).first()
    assert got.n_chars == 5 * 100_000 - 1


def test_route_by_parser(spark):
    """A landmark's tag that isn't one, and marks on or around landmarks, lose no article."""
    body = "<div class='entry-content'>The body of page {} w{} x{} y{}</div>"
    pages = [
        "<!-- <article> -->" + body,
        "<script>s = '<main>'</script>" + body,
        body + "<div class=comments><article>me too</article></div>",
        "<article class='post has-sidebar'>" + body + "<div class='related-posts'>see</div></article>",
        "<div class='layout-with-sidebar'><main class='no-sidebar'>" + body + "</main></div>",
        "<div class='page sidebar'><main>" + body + "</main></div>",
        "<div class='page sidebar'><article class='notice'>" + body + "</article></div>",
        "<main>" + body + "<article class='comment'>me too</article></main>",
    ]
    rows = [(k, "https://h.example/", p.format(k, k, k, k)) for k, p in enumerate(pages)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert rows_of(got, "page_id", "text") == [(k, f"The body of page {k} w{k} x{k} y{k}") for k in range(len(pages))]


def landmarks_by_counting(pages, n=6):
    """The texts of (host, html), by plain search: pages with landmarks by what repeats inside and outside of them."""
    from stratakeep.llm.pages import INSIDE_PAGES, INSIDE_SHARE, LEAST_PAGES, LEAST_SHARE
    from stratakeep.llm.pages import blocks as found

    windows = lambda b: [tuple(b.split(" ")[i : i + n]) for i in range(b.count(" ") + 2 - n)]
    parsed = [(host, *found(html)) for host, html in pages]
    outside, inside = {}, {}
    for host, bs, landmark in parsed:
        outside.setdefault(host, set()).add(tuple(b for b, w in bs if w < 2))
        if landmark:
            inside.setdefault(host, set()).add(tuple(b for b, w in bs if w == 2))

    def repeated(contents, least, share):
        seen = {}
        for c in contents:
            for w in {w for b in c for w in windows(b)}:
                seen[w] = seen.get(w, 0) + 1
        return {w for w, k in seen.items() if k >= least and k >= share * len(contents)}

    out = []
    for (host, bs, landmark), counted in zip(parsed, repeats_by_counting(pages)):
        if not landmark:
            out.append(counted)
            continue
        again = repeated(outside[host], LEAST_PAGES, LEAST_SHARE) | repeated(inside[host], INSIDE_PAGES, INSIDE_SHARE)
        open_ = [b for b, w in bs if w == 2]
        begun = sum(b.count(" ") + 1 for b in open_ if windows(b) and windows(b)[0] in again)
        covered = lambda b: {k for i, w in enumerate(windows(b)) if w in again for k in range(i, i + n)}  # noqa: B023, E731
        copy = 2 * begun > sum(b.count(" ") + 1 for b in open_)
        out.append("\n".join(b for b in open_ if copy or len(covered(b)) <= b.count(" ")))
    return out


def texts_of(spark, pages):
    df = spark.createDataFrame([(k, f"https://{h}.example/{k}", html) for k, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(main_text(df).collect(), key=lambda r: r.page_id)]


def test_repeats_decide_inside_of_landmarks_too(spark):
    """An unmarked notice in a host's articles goes, wherever it repeats; quotations, copies of an article and short blocks stay."""
    words = lambda k, n=20: " ".join(f"w{k}x{i}" for i in range(n))
    notice, footer, quoted = "Subscribe to our weekly newsletter for more stories", "All rights reserved by the makers of this site", "To be or not to be that is the question"
    pages = [("h", f"<article><p>{words(k)}</p><p>Short.</p><p>{notice}</p><p>{words(-k - 1)}</p>{f'<p>{quoted}</p>' if k < 4 else ''}</article><footer>{footer}</footer><div>Page {k}</div>") for k in range(9)]
    pages += [("h", f"<article><p>{words(50)}</p><p>{footer}</p></article>")]
    copy = [f"<p>{words(60 + i)}</p>" for i in range(5)]
    pages += [("g", "<article>" + "".join(copy[:k] + [f"<p>{words(70 + k)}</p>"] + copy[k + 1 :]) + "</article>") for k in range(5)]
    pages += [("g", f"<article><p>{words(80 + k)}</p></article>") for k in range(3)]
    got = texts_of(spark, pages)
    assert got[0] == f"{words(0)}\nShort.\n{words(-1)}\n{quoted}" and got[8] == f"{words(8)}\nShort.\n{words(-9)}" and got[9] == words(50)
    assert all(t.count("\n") == 4 for t in got[10:15])
    assert got == landmarks_by_counting(pages)


def test_landmarks_are_those_counted(spark):
    import random

    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(n))
    common, pages = [sentence(n) for n in (3, 6, 7, 9, 12)], []
    for _ in range(60):
        body = [rng.choice(common) + (" " + sentence(3) if rng.random() < 0.3 else "") if rng.random() < 0.45 else sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 9))]
        around = "".join(f"<p>{rng.choice(common)}</p>" for _ in range(rng.randint(0, 2)))
        body = "".join(f"<p>{b}</p>" for b in body)
        pages.append((rng.choice("aabc"), around + (f"<article>{body}</article>" if rng.random() < 0.8 else body)))
    pages += pages[:3]
    want, got = landmarks_by_counting(pages), texts_of(spark, pages)
    plain = [article(html) for _, html in pages]
    assert got == want and sum(w != p and p != "" for w, p in zip(want, plain)) > 5
