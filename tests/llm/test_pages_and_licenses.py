import random
import re
import time

from quillmere.llm import license_scan as ls
from quillmere.llm import main_text as mt
from quillmere.llm.main_text import extract, main_text

PAGES = {
    1: (
        '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home, sweet</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies, as all do. Accept them, please.</div><article><h1>A  title &amp; more</h1><p><b>First para,\n with &eacute;.<br>line'
        "<p>Second <a href='#'>linked</a> para.<aside>Aside text, long enough, with marks.</aside><ul><li>One<li>Two</ul><form>Name: <input></form></article>"
        '<section id="comments"><p>Great article, thanks, really, so good. So very good, indeed!</p></section><footer>&copy; x</footer></body></html>',
        "A title & more First para, with é. line Second linked para. One Two",
    ),
    2: (
        '<body><div id="sidebar"><p>Menu, text, here.</p></div><div class="page"><div class="post-body"><p>Long enough sentence, with commas, and so on.</p><p>Short.</p>'
        '<p>Another sentence, that also has commas, too.</p></div><div class="social-share">Share this, now!</div></div><div><a href="a">x</a> <a href="b">y</a></div></body>',
        "Long enough sentence, with commas, and so on. Short. Another sentence, that also has commas, too.",
    ),
    3: ("", ""),
    4: (None, ""),
    5: ("plain text &lt;only&gt;", "plain text <only>"),
    6: ("<p>" + "word, " * 30000 + "</p>", ("word, " * 30000).strip()),
    7: ("<script>x</script><!-- c --><style>p{}</style>", ""),
}


def test_main_text(spark):
    for html, want in PAGES.values():
        assert extract(html) == want
    df = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in PAGES.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text(df, keep=["page_id", "url"]).collect()}
    assert {k: (r.text, r.n_chars) for k, r in got.items()} == {k: (w, len(w)) for k, (_, w) in PAGES.items()}
    assert main_text(df.limit(0)).count() == 0


KEPT = [
    # words of class and id inside an article don't drop its text
    (
        '<article><h1>T</h1><p>Some text, with marks, here and there.</p><div class="legal-analysis"><p>A legal analysis, of some length, follows here.</p></div>'
        '<section id="search">How we search, and find, things.</section></article>',
        "T Some text, with marks, here and there. A legal analysis, of some length, follows here. How we search, and find, things.",
    ),
    ('<p>Seen text, that is long enough.</p><div hidden="hidden">Hidden text, not shown, at all.</div><p hidden>No.</p>', "Seen text, that is long enough."),
    ("<body><div class='content has-sidebar'><article><p>One text, here, in it.</p></article></div></body>", "One text, here, in it."),
    ("<body><form id='with-header'><p>One text, here, in it.</p><p>More of it, still.</p><input></form></body>", "One text, here, in it. More of it, still."),
    ("<div id='search-results'><p>All text, here, on the page.</p></div><div class='ad'>Buy now, or never!</div>", "All text, here, on the page."),
    ("<main><p>Body text, of a page, in here.</p><div class='comments'><p>Nice, really, so nice!</p></div></main><footer>A long footer, with marks, and more, than the body, has.</footer>", "Body text, of a page, in here."),
]


def test_weights_and_exceptions():
    for html, want in KEPT:
        assert extract(html) == want


def test_time_grows_with_depth_only():
    for page in ("<div>" * 8000 + "deep, text." + "</div>" * 8000, "<p><b>" * 4000 + "deep, text.", "<a><div>" * 4000 + "deep, text." + "</a></div>" * 4000, "<ul><li>" * 4000 + "deep, text."):
        began = time.perf_counter()
        assert extract(page) in ("deep, text.", "")
        assert time.perf_counter() - began < 2  # 0.2 s on a free machine


def _tree(rng, depth, named):
    """(tag, class, children); children are trees or words."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        if depth and rng.random() < 0.7:
            kids.append(_tree(rng, depth - 1, named))
        else:
            kids.append(rng.choice(["Some words, in a row, with marks. ", "short ", "one more line of text, here; and so on, ", "& < "]) * rng.choice((1, 1, 3, 9)))
    tag = rng.choice(["div", "div", "section", "b", "a", "nav", "footer", "h2", "li", "script", "aside"] + (["article"] if named else []))
    if tag == "script":
        return tag, "", ["if (x) y();"]
    return tag, rng.choice(["", "", "", "x", "ad", "comments", "legal", "sidebar left", "related-work"]), kids


def _html(node):
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, name, kids = node
    return f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>' + "".join(map(_html, kids)) + f"</{tag}>"


def _brute_text(root):
    """The definition, by recursion over the tree with paths as tuples of tags and weights."""
    talk_names = {"comments"}

    def has_article(node):
        return not isinstance(node, str) and node[1] not in talk_names and (node[0] == "article" or any(map(has_article, node[2])))

    # first blocks with the elements around them, then what depends on their text
    found = []  # (elements around, text, linked)

    def walk(node, around, linked):
        if isinstance(node, str):
            if not found or found[-1][0] is not None and found[-1][3]:
                found.append([None, "", 0, False])
            if found[-1][0] is None:
                found[-1][0] = around
            found[-1][1] += node
            found[-1][2] += len(node) if linked else 0
            return
        tag, name, kids = node
        nodes[id(node)] = node
        inside[id(node)] = any(nodes[i][0] == "article" for i in around)
        breaks = tag in mt.BLOCKS or tag == "script" or name in talk_names or bool(name and weight_of(node) < 1)
        if breaks and found:
            found[-1][3] = True
        if tag != "script":
            for k in kids:
                walk(k, around + (id(node),), linked or tag == "a")
        if breaks and found:
            found[-1][3] = True

    def weight_of(node):
        tag, name = node[:2]
        if tag == "article":
            return 1.0
        return {"ad": 1 / 32, "comments": 1 / 32, "legal": 1 / 2, "sidebar left": 1 / 32, "related-work": 1.0 if inside[id(node)] else 1 / 8}.get(name, 1.0)

    nodes, inside = {}, {}
    walk(root, (), False)
    rows = [(around, re.sub(r"\s+", " ", text).strip(), linked) for around, text, linked, _ in found if around is not None]
    rows = [r for r in rows if r[1]]
    whole = sum(len(t) for _, t, _ in rows)
    any_article = has_article(root)

    def talks(around):
        return any(nodes[i][1] in talk_names for i in around)

    def keeps(i, around):
        inner = sum(len(t) for a, t, _ in rows if i in a)
        return has_article(nodes[i]) and not talks(around[: around.index(i)]) or not any_article and 2 * inner >= whole

    kept = []
    for around, text, linked in rows:
        path, w, out, marked, first = [], 1.0, False, False, None
        for at, i in enumerate(around):
            tag = nodes[i][0]
            own = 1.0 if keeps(i, around) else weight_of(nodes[i])
            out = out or tag in mt.ASIDE and not keeps(i, around) and nodes[i][1] not in talk_names
            marked = marked or own < 1
            article = tag == "article" and not talks(around[: at + 1])
            if tag in mt.BLOCKS or own < 1:
                path.append((tag, own))
                w *= own * (8 if article and first is None else 1)
            first = i if article and first is None else first
        if not out:
            kept.append((tuple(path), text, linked, w, around, marked, first))
    kept = [r for r in kept if not talks(r[4])] or kept
    if not kept:
        return ""
    paths = {r[0]: [t for q, t, *_ in kept if q == r[0]] for r in kept}
    links = {p: sum(min(r[2], len(r[1])) for r in kept if r[0] == p) / sum(map(len, paths[p])) for p in paths}
    length = [sum(map(len, paths[r[0]])) / len(paths[r[0]]) for r in kept]
    marks = [(1 + sum(sum(c in ".,;:!?" for c in t) for t in paths[r[0]])) / len(paths[r[0]]) for r in kept]
    near = lambda v, k: (2 * v[k] + v[max(k - 1, 0)] + v[min(k + 1, len(v) - 1)]) / 4
    value = {}
    for k, (p, _, _, w, *_) in enumerate(kept):
        x = (near(length, k) * near(marks, k)) ** 0.5 * (1 - links[p]) * w * (1 / 4 if links[p] > 0.5 else 1)
        value[p] = max(value.get(p, 0), x)
    bar = 0.2 * max(value.values())
    good = [k for k, r in enumerate(kept) if value[r[0]] >= bar]
    articles = {i for k in good for i in kept[k][4] if nodes[i][0] == "article" and not talks(kept[k][4][: kept[k][4].index(i) + 1])}
    common = [i for i in kept[good[0]][4] if all(i in kept[k][4] for k in good)]
    begin = good[0]
    while begin and kept[begin - 1][4] and nodes[kept[begin - 1][4][-1]][0] == "h2":
        begin -= 1

    def stays(k):
        p, _, _, _, around, marked, _ = kept[k]
        if value[p] >= bar:
            return True
        if articles:
            return not marked and any(i in articles for i in around)
        return not marked and (not common or common[-1] in around) and begin <= k <= good[-1] and links[p] <= 0.5

    return " ".join(r[1] for k, r in enumerate(kept) if stays(k))


def test_pages_equal_brute_force():
    rng = random.Random(5)
    some = 0
    for k in range(400):
        root = ("body", "", [_tree(rng, rng.randint(1, 4), k % 2) for _ in range(rng.randint(1, 4))])
        # an a within an a, or a block within an inline, closes what is around it: not in this test's pages
        page = _html(root)
        if re.search(r"<a\b(?:(?!</a>).)*<(a|div|section|li|h2|nav|footer|aside|article)\b", page) or re.search(r"<b\b(?:(?!</b>).)*<(div|section|li|h2|nav|footer|aside|article|b)\b", page) or re.search(r"<li\b(?:(?!</li>).)*<li\b", page):
            continue
        some += 1
        assert extract(page) == _brute_text(root), page
    assert some > 100


PARTS = [
    "<p>A paragraph {}, with some words, and marks in it, as they come.</p>", "<h2>Part {}</h2>", "<ul><li>item {}</li><li>more</li></ul>", "<ol><li>first {}<li>second</ol>", "<table><tr><th>k {}</th><td>v</td></tr></table>",
    "<blockquote>Said {}</blockquote>", "<pre>x = f({})</pre>", "<section class='related-work'><p>Others {} did so.</p></section>", "<div class='comments-summary'><p>In sum {}.</p></div>", "<dl><dt>term {}</dt><dd>what it is</dd></dl>",
    "<figure><img src=x><figcaption>Figure {}</figcaption></figure>", "<p>See <a href='#r'>reference {}</a></p>", "<div>Short {}</div>",
]
NOISE = [
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<header><p>The site, of us all, where texts are read.</p></header>", "<footer>All rights, of course, are reserved.</footer>", "<aside><p>Read this, too, and that, and more.</p></aside>",
    "<div class='sidebar'><p>Side text, of length, with marks, to read.</p></div>", "<div class='cookie-notice'>We use cookies, as others do, so accept.</div>", "<div class='ad'>Buy now, or never, so cheap!</div>", "<form>Your name: <input></form>",
    "<script>var a = '<p>no</p>';</script>", "<div class='comment'><article><p>Great, really great, thanks, so much, for it!</p></article></div>", "<article class='comment-body'><p>Me too, as a reader, of long standing.</p></article>", "<section id='comments'><p>So nice, and so true, and so well put!</p></section>",
]


def test_articles_keep_all_that_was_put_in():
    """Pages made of parts that are known to be article or not; nothing is taken from the operator."""
    rng = random.Random(12)
    for _ in range(300):
        inner = [rng.choice(PARTS).format(rng.randint(0, 99)) for _ in range(rng.randint(3, 12))]
        inner.insert(rng.randint(0, len(inner)), PARTS[0].format(7))
        want = " ".join(re.sub(r"\s+", " ", t).strip() for t in re.sub(r"</?(?:p|h2|li|ul|ol|tr|th|td|table|blockquote|pre|section|div|dl|dt|dd|figure|figcaption)\b[^>]*>", "\n", re.sub(r"</?a\b[^>]*>|<img[^>]*>", "", "".join(inner))).split("\n") if t.strip())
        noisy = [x for x in inner]
        for x in rng.sample(NOISE[3:9], 2):  # some of it within the article
            noisy.insert(rng.randint(0, len(noisy)), x if "<article" not in x else "")
        tag = rng.choice(["article", "main"])
        around = rng.sample(NOISE, 5)
        cut = rng.randint(0, 5)
        page = f"<html><body>{''.join(around[:cut])}<{tag}>{''.join(noisy)}</{tag}>{''.join(around[cut:])}</body></html>"
        assert extract(page) == want, page
    # without an article element: what lies between its paragraphs stays, what is marked or before goes
    page = "<body><div>Skip</div><div class='post'><h2>T</h2>" + PARTS[0].format(1) + PARTS[2].format(2) + PARTS[6].format(3) + "<div class='ad'>Buy, now!</div>" + PARTS[0].format(4) + "</div><div class='comments'><p>Great, as ever, so great, and so on, and on!</p></div></body>"
    assert extract(page) == "T A paragraph 1, with some words, and marks in it, as they come. item 2 more x = f(3) A paragraph 4, with some words, and marks in it, as they come."


def longest_rising(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_rising_run_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 25)
        pairs = list(zip(range(n), rng.sample(range(100), n)))
        run = ls.rising(pairs)
        assert len(run) == longest_rising(pairs)
        assert all(x < y for (_, x), (_, y) in zip(run, run[1:]))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abcdefghijklmnop", k=rng.randint(0, 30)) for _ in range(2))
        out = []
        ls.patience(a, b, 0, len(a), 0, len(b), out)
        out.sort()
        assert all(a[i] == b[j] for i, j in out)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(out, out[1:]))


def test_licenses(spark):
    rng = random.Random(3)
    body = lambda n: " ".join(rng.choices(["the", "under", "version", "alpha", "license", "été"], k=n))
    rows, want = [], {}
    notices = [(name, re.sub("[{}]", "", t)) for name, texts in ls.NOTICES.items() for t in texts]
    told = [{w for i, w in enumerate(ls.template(t)[0]) if i in ls.template(t)[1]} for texts in ls.NOTICES.values() for t in texts]
    for i, (name, t) in enumerate(notices):
        lead = body(rng.randint(0, 3000))
        rows.append((i, f"{lead}. {t} {body(50)}"))
        want[i] = [name]
        words = t.split()
        if len(words) > 20:  # an edited copy still covers enough
            for _ in range(len(words) // 12):
                at = rng.randrange(len(words))
                if told[i].isdisjoint(ls._WORD.findall(words[at].lower())):
                    words[at] = "edited"
        rows.append((1000 + i, f"{body(40)}\n{' '.join(words).upper()}\n{body(40)}"))
        want[1000 + i] = [name]
        rows.append((2000 + i, f"{t} {t}"))
        want[2000 + i] = [name, name]
    for i, t in enumerate([None, "", "license", body(5000), "İ" * 10 + " Licensed under CC BY 4.0."]):
        rows.append((3000 + i, t))
        want[3000 + i] = ["CC-BY-4.0"] if i == 4 else []
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in ls.scan_licenses(df, keep=["doc_id"]).collect()}
    texts = dict(rows)
    for i, names in want.items():
        found = [x.split(":") for x in got[i].licenses.split(",") if x]
        assert [x[0] for x in found] == names, (i, got[i])
        assert got[i].n_licenses == len(names)
        if i < 1000:
            a, b = int(found[0][1]), int(found[0][2])
            assert ls._WORD.findall(texts[i][a:b].lower()) == ls._WORD.findall(notices[i][1].lower())
    assert ls.scan_licenses(df.limit(0)).count() == 0


def test_near_misses_and_insertions():
    known = ls.Notices(ls.NOTICES)
    names = lambda t: [x[0] for x in known.find(t)]
    clean = lambda name, k: re.sub("[{}]", "", ls.NOTICES[name][k])
    for t in ("Licensed under the Foo License.", "Licensed under the Apache License.", "Released under the X License.", "Licensed under the EUPL.", "This work is licensed under the GNU General Public License."):
        assert names(t) == []
    assert names("Licensed under the BSD 2-Clause License.") == ["BSD-2-Clause"]
    for name, texts in ls.NOTICES.items():  # every text of every license is told from all others
        for k in range(len(texts)):
            assert names(f"before it, {clean(name, k)} and after") == [name]
    for name, k in (("Apache-2.0", 1), ("MIT", 3), ("GPL-3.0", 2), ("BSD-3-Clause", 1)):
        words = clean(name, k).split()
        for n in (40, 80, 400, 20_000):
            for at in (len(words) // 3, len(words) // 2):
                found = known.find(" ".join(["x", *words[:at], *[f"w{i % 977}" for i in range(n)], *words[at:], "y"]))
                assert [(f[0], f[3]) for f in found] == [(name, 1.0)]


def brute_align(a, b, a0, a1, b0, b1):
    """Patience alignment by its definition."""
    if a0 >= a1 or b0 >= b1:
        return []
    if a[a0] == b[b0]:
        return [(a0, b0), *brute_align(a, b, a0 + 1, a1, b0 + 1, b1)]
    if a[a1 - 1] == b[b1 - 1]:
        return [*brute_align(a, b, a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
    pairs = [(i, j) for i in range(a0, a1) for j in range(b0, b1) if a[i] == b[j] and a[a0:a1].count(a[i]) == 1 and b[b0:b1].count(b[j]) == 1]
    anchors = ls.rising(pairs)  # which is held against all runs in a test of its own
    out, x, y = [], a0, b0
    for i, j in [*anchors, (a1, b1)]:
        out += brute_align(a, b, x, i, y, j) if anchors else []
        out += [(i, j)] if i < a1 else []
        x, y = i + 1, j + 1
    return out


def brute_scan(text, notices, share=0.8):
    words = re.findall(r"[^\W_]+", text.lower())
    found = []
    for k, (name, t) in enumerate((name, t) for name, ts in notices.items() for t in ts):
        plain = re.findall(r"[^\W_]+", re.sub("[{}]", "", t).lower())
        must = {w for part in re.findall("{(.*?)}", t.lower()) for w in re.findall(r"[^\W_]+", part)}
        ok = lambda pairs: len(pairs) >= share * len(plain) - 1e-9 and must <= {plain[j] for _, j in pairs}  # noqa: B023, E731
        keys = sorted(range(len(plain)), key=lambda i: (-len(plain[i]), i))[: int((1 - share) * len(plain) + 1e-9) + 1]
        own, slack = [], len(plain) // 2 + 4
        for i in keys:
            for p in [p for p, w in enumerate(words) if w == plain[i]]:
                lo, hi = max(0, p - i - slack), min(len(words), p + len(plain) - i + slack)
                pairs = [*brute_align(words, plain, lo, p, 0, i), (p, i), *brute_align(words, plain, p + 1, hi, i + 1, len(plain))]
                own += [pairs] if ok(pairs) else []
        taken = {p for pairs in own for p, _ in pairs}
        runs = []
        if len(plain) >= 2 * ls.RUN and any(plain[i] in words for i in keys):
            for p in range(len(words)):
                for i in range(len(plain)):
                    n = 0
                    while p + n < len(words) and i + n < len(plain) and words[p + n] == plain[i + n]:
                        n += 1
                    if n >= ls.RUN and not (p and i and words[p - 1] == plain[i - 1]):
                        runs.append((p, i, n))
        runs = sorted(r for r in runs if r[0] not in taken and r[0] + r[2] - 1 not in taken)
        while runs:
            best = []
            for x, (p, i, n) in enumerate(runs):
                before = max((best[y][:3] + (y,) for y, (q, j, m) in enumerate(runs[:x]) if q + m <= p and j + m <= i), default=(0, p, -1, -1))
                best.append((before[0] + n, before[1], x, before[3]))
            x, chain = max(best)[2], []
            while x >= 0:
                chain.append(runs[x])
                x = best[x][3]
            chain.reverse()
            pairs = [(p + y, i + y) for p, i, n in chain for y in range(n)]
            for (p, i, n), (q, j, _) in zip(chain, chain[1:]):
                pairs += brute_align(words, plain, p + n, q, i + n, j)
            (p, i, _), (q, j, n) = chain[0], chain[-1]
            pairs += brute_align(words, plain, max(0, p - 2 * i), p, 0, i) + brute_align(words, plain, q + n, min(len(words), q + n + 2 * (len(plain) - j - n)), j + n, len(plain))
            if not ok(pairs):
                break
            own.append(sorted(pairs))
            runs = [r for r in runs if r not in chain]
        found += [(-len(pairs), -len(pairs) / len(plain), pairs[0][0], pairs[-1][0], k, n, name, {p for p, _ in pairs}) for n, pairs in enumerate(own)]
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text.lower())]
    out, taken = [], set()
    for _, cover, a, b, _, _, name, places in sorted(found, key=lambda x: x[:6]):
        if places.isdisjoint(taken):
            taken |= places
            out.append((name, spans[a][0], spans[b][1], -cover))
    return sorted(out, key=lambda x: x[1:])


def test_scan_equals_brute_force():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    notices = {"A": ["{ax} by az cx dz", "gx hy {bz} ax ay cz dx ez fx gy hz ay bx cx dz ex fy gz hx ay"], "B": ["gx hy bz ax ay cz dx ez fx gy hz ay bx cx dz {by} fy gz hx ay cz az"], "C": ["hz hy hx gz gy gx fz fy fx ez ey ex dz"]}
    known = ls.Notices(notices)
    some = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = re.sub("[{}]", "", rng.choice(rng.choice(list(notices.values())))).split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.choice((0, 1, 1, 30)))
            parts += t + rng.choices(vocab, k=rng.choice((0, 3, 40)))
        text = rng.choice((" ", ", ", "\n")).join(parts)
        want = brute_scan(text, notices)
        some += bool(want)
        assert known.find(text) == want, text
    assert some > 200
