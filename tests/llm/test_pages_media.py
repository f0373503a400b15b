"""Main text of pages, and the archive source."""

import hashlib
import json
import os
import zlib

import pytest
from data import awkward, frame
from pyspark.sql import functions as F

from shoebox.llm import html, media
from shoebox.llm.common import texts_of

TEXT = "The story of the town is told in this part of the page and it is long enough."


@pytest.mark.parametrize(
    "page,expected",
    [
        ("", ""), ("<p>", ""), (f"<nav>The menu of the page is here and it is as long as an article of the day</nav><article><h1>T</h1><p>{TEXT}<p>Short.</article><footer>&copy; x</footer>", f"T {TEXT} Short."),
        (f"<body><div class='sidebar'>{TEXT}</div><p>{TEXT}</p><p>End.</p><div id=comments>{TEXT}</div></body>", f"{TEXT} End."),
        (f"<article><p>a&amp;b &lt;c&gt; &am</p><p>{TEXT}\n\n  x</p><script>var a='</p>';</script><form>{TEXT}</form></article>", f"a&b <c> &am {TEXT} x"),
        (f"<article><header><h1>Head</h1></header><p>{TEXT}</p><aside>no</aside><div class='ad'>Buy</div></article>", f"Head {TEXT}"),
        ("<article><ul><li><a href=x>one two</a></li></ul><p>A b.</p></article><!-- <p>c</p>", "A b."), ("<article>cut <b", "cut"), (f"<style>p</style><p>{TEXT}", TEXT),
    ],
)
def test_main_text(page, expected):
    assert html.main_text(page) == expected


WORDS = "the of and a to in is it for on with that river stone window market letter garden winter music teacher harbour".split()


def labelled(seed):
    """A page without telling tags or names, as blocks of (markup, text, whether it belongs to the article)."""
    import random

    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize()
    rare = lambda n: " ".join(r.choice(WORDS[11:]) for _ in range(n)).capitalize()
    links = lambda n: "".join(f"<li><a href='/{k}'>{rare(2)}</a></li>" for k in range(n))
    out = [(f"<div><ul>{links(6)}</ul></div>", "", False), ("<div>", "", True)]
    for k in range(r.randint(3, 6)):
        title, long, short = f"{rare(3)} {k}", f"{some(r.randint(30, 60))}.", f"{rare(r.randint(2, 6))}."
        out += [(f"<h2>{title}</h2>", title, True), (f"<p>{long}</p>", long, True), (f"<p>{short}</p>", short, True)]
    item = rare(4)
    out += [(f"<ul><li>{item}</li></ul>", item, True), ("</div>", "", True)]
    more = rare(2)
    return [*out, (f"<div><h3>{more}</h3><ul>{links(5)}</ul></div>", more, False), (f"<div><a href='/'>{rare(3)}</a> {rare(1)}</div>", "", False)]


@pytest.mark.parametrize("seed", range(8))
def test_both_passes_decide_on_pages_without_telling_tags(seed, monkeypatch):
    blocks = labelled(seed)
    page = f"<body>{''.join(m for m, _, _ in blocks)}</body>"
    expected = " ".join(t for _, t, keep in blocks if keep and t)
    assert html.main_text(page) == expected
    # Without any one rule the text is another one.
    for name, value in (("LINK_SHARE", 2.0), ("STOP_SHARE", 2.0)):
        with monkeypatch.context() as m:
            m.setattr(html, name, value)
            assert html.main_text(page) != expected
    with monkeypatch.context() as m:
        m.setattr(html, "second_pass", lambda blocks, labels: [label == html.GOOD for label in labels])
        assert html.main_text(page) != expected


def test_given_pages_without_their_article_tags():
    """The tag is no shortcut: the text is the same without it, and link density alone drops menus that are no longer marked."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    for page in pages:
        whole = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        expected = html.main_text(f"<article>{whole}</article>")
        bare = re.sub(r"</?article>", "", page)
        assert html.main_text(page) == html.main_text(bare) == expected
        assert html.main_text(re.sub(r"<(/?)nav>", r"<\1div>", bare)) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<div class='content has-sidebar'><p>{TEXT}</p></div>", TEXT), (f"<article><div class='entry-header'><h1>Head</h1></div><p>{TEXT}</p></article>", f"Head {TEXT}"),
        (f"<div class=pageHeader><p>{TEXT}</p></div><div class=adUnit>{TEXT}</div><div id=mainSidebar>{TEXT}</div>", TEXT),
        (f"<p>Press <button>here<p>{TEXT}</p>", f"Press {TEXT}"), (f"<p>{TEXT}</p><select><option>One</option><option>Two</option></select><p>End.</p>", f"{TEXT} End."),
        (f"<p>{TEXT}</p><iframe src=x><p>More.</p>", f"{TEXT} More."), (f"<p>{TEXT}<svg><g><text>no</text></g></svg></p><audio><p>End.</p>", f"{TEXT} End."),
        (f"<p>{TEXT} <span class=ad>Buy <span>this</span> now</span> x</p>", f"{TEXT} x"), ("<p>漢字の文です。</p><p>短い。</p>", "漢字の文です。 短い。"),
        (f"<p>{TEXT}</p><a href=x><div>A linked block of the page that is one long link to somewhere else.</div></a>", TEXT), ("<p>Short one.</p><p>Short two.</p>", "Short one. Short two."),
    ],
)
def test_markup_edges(page, expected):
    assert html.main_text(page) == expected


MORE = "It is the second part of the story and it was told by the people of the town to a friend."


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<body><form id=aspnetForm action=x><nav><a href=/>Home of the page</a></nav><h1>Title</h1><p>{TEXT}</p><p>{MORE}</p><div id=comments><p>{TEXT}</p></div></form></body>", f"Title {TEXT} {MORE}"),
        (f"<form><p>{TEXT}</p></form>", TEXT), (f"<div class='layout sidebar-right'><article><p>{TEXT}</p></article><div class=sidebar>{MORE}</div></div>", TEXT),
        (f"<div class='page menu-open'><p>{TEXT}</p><div class=cookie-notice>{MORE}</div></div>", TEXT), (f"<div id='search-theory'><p>{TEXT}</p></div>", TEXT),
        (f"<article><p>{TEXT}</p><section class='related-work'><h2>Work</h2><p>{MORE}</p></section></article>", f"{TEXT} Work {MORE}"),
        (f"<article><p>{TEXT}</p><div class='related-posts'><h2>Others</h2><p>{MORE}</p></div></article>", TEXT),
        (f"<article><p>{TEXT} where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{TEXT} where x=2 holds."),
        (f"<header class=page-header><div class=header><h1>Title</h1><p>{TEXT}</p></div></header>", f"Title {TEXT}"),
        # Comments, adverts and notices stay chrome, however long they are.
        (f"<article><h1>T</h1><p>Short.</p></article><div id=comments><article><p>{TEXT}</p><p>{MORE}</p></article></div>", "T Short."), (f"<div class=ad>{TEXT}</div><footer>{MORE}</footer>", ""),
        (f"<div class=newsletter><h1>News</h1><p>{TEXT}</p></div>", ""), (f"<p>{TEXT}</p><form><p>{MORE}</p></form>", TEXT),
    ],
)
def test_wrappers_are_no_chrome(page, expected):
    assert html.main_text(page) == expected


@pytest.mark.parametrize("piece", ["<iframe>x", "</div></p>", "</section>x", "<div class=menu>", "<form>", "<div class=ad><p>x", "<noscript>", "<ul><li>", "<p>a<h1>", "&am", "<a href=x>y"])
def test_time_is_in_proportion(piece):
    import time

    def taken(n):
        page = f"<p>{TEXT}</p>" + piece * n
        best = 9.0
        for _ in range(2):
            began = time.process_time()
            html.main_text(page)
            best = min(best, time.process_time() - began)
        return best

    assert taken(16_000) < 8 * max(taken(4000), 0.05)


def test_pages(spark):
    rows = [(1, "u", f"<article>{TEXT}</article>"), (1, "u", f"<article>{TEXT}</article>"), (2, None, None), (None, "v", ""), (3, "w", "<article><p>é\U0001f642</p>" + "<div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.text, r.n_chars) for r in html.extract(df).collect())
    assert got == sorted([(TEXT, len(TEXT)), (TEXT, len(TEXT)), ("", 0), ("", 0), ("é\U0001f642", 2)])
    assert html.extract(df.limit(0)).collect() == []
    clash = df.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "doc_id")})
    assert sorted((r.text, r.n_chars) for r in html.extract(clash).collect()) == got and html.extract(clash).columns == ["page_id", "url", "text", "n_chars"]


def test_images_are_lossless():
    for raw in (b"", b"a", bytes(range(256)) * 3, b"x" * 192, b"y" * 193):
        samples, n = media.from_png(media.to_png(raw))
        assert n == len(raw) and samples.tobytes() == raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    image = bytearray(media.to_png(b"abc"))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


def test_archives(spark, tmp_path):
    path = str(tmp_path / "archive")
    docs = texts_of(frame(spark, extra=True)).repartition(3)
    media.write_archive(media.texts_to_images(docs), path)
    members = media.read_archive(spark, path, range_bytes=4096)
    assert members.rdd.getNumPartitions() > 3 or sum(os.path.getsize(f"{path}/{n}") for n, _ in (x for f in os.listdir(path) if f.endswith(".manifest") for x in json.load(open(f"{path}/{f}")))) < 4096 * 4
    got = sorted((r.payload_sha256, r.n_bytes) for r in media.image_columns(members).collect())
    expected = []
    for _, t, *_ in awkward():
        raw = (t or "").encode()
        expected.append((hashlib.sha256(raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")).hexdigest(), len(raw)))
    assert got == sorted(expected)
    # A file that no commit named isn't read.
    (tmp_path / "archive/stray.tar").write_bytes(b"x" * 9999)
    assert media.read_archive(spark, path).count() == len(awkward())


def test_image_columns_are_those_of_brute_force(spark, tmp_path):
    import math

    path = str(tmp_path / "archive")
    rows = [(k, t, None, None, None) for k, (_, t, *_) in enumerate(awkward())]
    media.write_archive(media.texts_to_images(texts_of(frame(spark, rows, extra=True))), path)
    got = {r.doc_id: r for r in media.image_columns(media.read_archive(spark, path)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for k, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        image = media.to_png(raw)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        mean = sum(full) / len(full)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in full) / len(full))
        cuts = [b * len(full) // 64 for b in range(65)]
        sums = [sum(full[a:b]) for a, b in zip(cuts, cuts[1:])]
        bits = "".join("1" if 64 * s * 64 >= 64 * sum(sums) else "0" for s in sums)
        shown = r.feature.split(":")
        assert abs(float(shown[0]) - mean) < 1e-3 and abs(float(shown[1]) - deviation) < 1e-3 and shown[2] == f"{int(bits, 2):016x}"
    same = [r.doc_id for r in got.values() if r.payload_sha256 == got[8].payload_sha256]
    assert len({(got[k].media_sha256, got[k].feature) for k in same}) == 1


@pytest.mark.parametrize("name", ["", "a", "n" * 100, "n" * 101, "é" * 50 + "n", "漢" * 33, "漢" * 34, "x" * 5000, "nul\0inside\0"])
def test_names_of_any_length(name):
    raw = media.header(name, b"12345") + b"12345"
    assert len(media.header(name, b"")) % 512 == 0
    assert media.member(lambda at, n: raw[at : at + n], 0) == (name, b"12345")


def test_damaged_members_raise_what_is_retried(tmp_path):
    whole = media.header("a", b"12345") + b"12345" + bytes(507)
    for at, byte in ((124, b"9"), (125, b"x"), (257, b"?"), (512, b"!"), (170, b"z")):
        damaged = whole[:at] + byte + whole[at + 1 :]
        with pytest.raises(OSError):
            media.member(lambda at, n, d=damaged: d[at : at + n], 0)
        # Read again from a handle that gives it whole, it is there.
        path, seen = tmp_path / f"{at}.tar", []
        path.write_bytes(whole)

        def handle():
            seen.append(1)
            import io

            return io.BytesIO(damaged) if len(seen) < 2 else open(path, "rb")

        assert media.retried(handle, 0) == ("a", b"12345") and len(seen) == 2


def test_no_members(spark, tmp_path):
    path = str(tmp_path / "none")
    media.write_archive(spark.createDataFrame([], "name string, payload binary"), path)
    assert media.read_archive(spark, path).collect() == []


def test_members_are_retried_alone(tmp_path):
    one, two = media.header("a", b"12345") + b"12345" + bytes(507), media.header("b", b"") + b""
    file = tmp_path / "x.tar"
    file.write_bytes(one + two)
    tries = []

    class Flaky:
        def __init__(self):
            tries.append(1)
            self.f = open(file, "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            if len(tries) < 3:
                raise OSError("gone")
            return self.f.read(n)

    assert media.retried(Flaky, 0) == ("a", b"12345") and len(tries) == 3
    assert media.retried(lambda: open(file, "rb"), len(one)) == ("b", b"")
    file.write_bytes(one.replace(b"12345" + bytes(507), b"12346" + bytes(507)) + two)
    with pytest.raises(OSError, match="damaged"):
        media.retried(lambda: open(file, "rb"), 0, retries=0)


def test_appending_keeps_and_overwriting_replaces(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = lambda a, b: spark.createDataFrame([(f"n{k}", bytearray([k] * k)) for k in range(a, b)], "name string, payload binary").repartition(2)
    names = lambda: sorted(r.name for r in media.read_archive(spark, path).collect())
    media.write_archive(rows(0, 5), path)
    media.write_archive(rows(5, 10), path)
    assert names() == [f"n{k}" for k in range(10)]
    media.write_archive(rows(20, 22), path, "overwrite")
    assert names() == ["n20", "n21"] and sum(n.endswith(".tar") for n in os.listdir(path)) <= 2
