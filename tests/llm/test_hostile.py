"""Inputs made to be costly, and rows that share an id."""

import itertools
import json
import random
import time
import zlib
from html.parser import HTMLParser

import pytest

from lodestrata.llm import decontaminate, quality, secrets, warc

# ---- decontamination


def judged(items, docs):
    test = decontaminate.TestSlice(items)
    shard = decontaminate._indexed([((i, 0), b" ".join(w), len(w)) for i, w in enumerate(docs)], test)
    return decontaminate._hits(shard, test)


def test_one_word_over_and_over_takes_no_pairs():
    begin = time.perf_counter()
    hit, items, best = judged([("x", [b"la"] * 2000), ("w", [b"la"] * 1999)], [[b"la"] * 300_000, [b"so"] * 5])
    assert hit.sum() == 300_000 and items == [("w", "x"), ()] and best == [(-2000, 0, "x", 0), None]
    assert time.perf_counter() - begin < 30


def test_a_template_that_all_items_share():
    template = [b"t%d" % i for i in range(30)]
    items = [(f"i{k:05}", [*template, b"q%d" % k]) for k in range(10_000)]
    docs = [[*template, b"q%d" % k] if k % 2 else [b"x", *template] for k in range(300)]
    begin = time.perf_counter()
    _, found, best = judged(items, docs)
    assert all(len(x) == 10_000 for x in found) and found[0] is found[2]
    assert best[3] == (-31, 0, "i00003", 0) and best[2] == (-30, 1, "i00000", 0)
    assert time.perf_counter() - begin < 30


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_of_texts_with_many_repeats(seed):
    rng = random.Random(seed)
    text = lambda n: [bytes([97 + rng.randrange(2)]) for _ in range(n)]
    items = [(f"i{k}", text(rng.choice([1, 3, 12, 13, 20, 40]))) for k in range(12)]
    docs = [text(rng.randrange(1, 120)) for _ in range(10)] + [items[-1][1] * 3]
    hit, found, best = judged(items, docs)
    at = 0
    for d, doc in enumerate(docs):
        want_hit, want_items, want = set(), set(), None
        for name, own in items:
            n = min(13, len(own))
            places = [(i, j) for i in range(len(doc) - n + 1) for j in range(len(own) - n + 1) if doc[i:i + n] == own[j:j + n]]
            for i, j in places:
                want_hit.update(range(i, i + n))
                want_items.add(name)
                m = n
                while i + m < len(doc) and j + m < len(own) and doc[i + m] == own[j + m]:
                    m += 1
                want = min(filter(None, (want, (-m, i, name, j))))
        assert {i for i in range(len(doc)) if hit[at + i]} == want_hit
        assert (list(found[d]), best[d]) == (sorted(want_items), want)
        at += len(doc) + 1


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    bad = " ".join(f"w{i}" for i in range(20))
    rows = [(None, bad, "a"), (None, "clean words only", "b"), (None, None, "c"), (7, bad, "d"), (7, "as clean", "e"), (8, bad + " " + "other " * 500, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __b string")
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and sorted(r["__b"] for r in left.collect()) == ["b", "c", "e", "f"]


def test_quality_keeps_rows_by_their_own_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    good = [r.text for r in quality.keep(docs).limit(3).collect()]
    rows = [(None, good[0], "en"), (None, "too short", "en"), (None, None, "en"), (10**9, good[1], "en"), (10**9, "x " * 60, "en")]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = quality.keep(more).where("doc_id is null or doc_id = 1000000000").collect()
    assert {(r.doc_id, r.text) for r in kept} <= {(None, good[0]), (10**9, good[1])}


# ---- secrets


HOSTILE = {
    "assign": ["secret", "token  ", "api_key \"", "secret=a", "password: "], "access": ["AKIA", "AKIAA "], "hex": ["0123456789abcdef012345 ", "abcdef"], "github": ["ghp_", "ghp_aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa_"],
    "slack": ["xoxb-", "xoxb- "], "google": ["AIza", "AIza0-"], "stripe": ["sk_live_", "rk_live_a"], "jwt": ["eyJ", ".eyJ", "eyJaaaaaaaa.", ".eyJaaaaaaaa.eyJ"], "pem": ["-----BEGIN ", "-----BEGIN PRIVATE "], "url": ["://", "://a:", "://a:b@"]}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_of_every_rule_is_linear(spark, name):
    """Ten times the text takes no more than about ten times as long; quadratic time would be a hundred."""
    assert set(HOSTILE) == {k.name for k in secrets.KINDS}
    for unit in HOSTILE[name]:
        took = []
        for n in (200_000, 2_000_000):
            df = spark.createDataFrame([(1, ".eyJ " + unit * (n // len(unit)))], "doc_id long, text string")
            begin = time.perf_counter()
            df.selectExpr(f"size(regexp_extract_all(text, '{next(k.pattern for k in secrets.KINDS if k.name == name)}', 0))".replace("\\", "\\\\").replace("[\"'", "[\"\\'")).collect()
            took.append(time.perf_counter() - begin)
        assert took[1] < 25 * max(took[0], 0.2), (unit, took)


def test_tokens_of_three_parts(spark):
    a, b, c = "eyJ" + "a" * 9, "eyJ" + "b" * 9, "c" * 9
    texts = [f"{a}.{b}.{c}", f"x{a}.{b}.{c}", f"{a}.{a}.{b}.{c}", f"{a} {b}.{c}", f"{a}.{b}", f"eyJeyJ{a}.{b}.{c}.d", f"{a}.eyJ.{b}.{b}.{c}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import re
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    for r in secrets.detect(df).collect():
        want = [f"jwt:{m.start()}:{m.end()}" for m in plain.finditer(texts[r.doc_id])]
        assert [s for s in r.spans.split(",") if s.startswith("jwt")] == want, texts[r.doc_id]


# ---- pages


class Plain(HTMLParser):
    LINKING = {"a", "area", "link", "img", "iframe", "frame", "source", "form"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = [v.strip() for k, v in attrs if k in ("href", "src", "action") and v and v.strip()]
        if tag in self.LINKING:
            self.links += found[:1]

    def handle_data(self, data):
        self.text.append(data)


def test_generated_pages_match_another_parser():
    rng = random.Random(4)
    value = ["/x", "a b", "1 > 0", "<b>", "it's", 'say "x"', "?x=1&amp;copy=2", "&lt;p&gt;", "", "a=b", "?a&#61;1"]
    for _ in range(400):
        page = ""
        for _ in range(rng.randrange(1, 7)):
            attrs = ""
            for name in rng.sample(["href", "title", "data-href", "src", "class", "DATA-x", "disabled"], rng.randrange(4)):
                v = rng.choice(value)
                quote = "'" if '"' in v else '"'
                space = rng.choice(["", " "])
                attrs += rng.choice([" ", "\n", "  "]) + (name if name == "disabled" else f"{name}{space}={space}{quote}{v}{quote}")
            tag = rng.choice(["a", "p", "img", "span", "td", "div", "h1", "link"])
            page += f"<{tag}{attrs}>" + rng.choice(["text", " a &amp; b ", "1 &lt; 2", ""]) + rng.choice([f"</{tag}>", f"</{tag} >", ""])
        plain = Plain(page)
        assert "".join(warc.visible_text(page).split()) == "".join("".join(plain.text).split()), page
        assert [x["url"] for x in warc.links(page, None)] == plain.links, page


def test_attribute_values():
    for text, want in {"?x=1&copy=2": "?x=1&copy=2", "a&amp;b": "a&b", "&copy": "©", "&copyx": "&copyx", "&#65;&#x42": "AB", "&nosuch;": "&nosuch;", "&lt=1": "&lt=1", "&": "&"}.items():
        assert warc.attribute_value(text) == want
    assert warc.visible_text('<a title="1 > 0" href="/x">hi</a><p data-x="a>b">para</p>') == "hi\npara"


@pytest.mark.parametrize("unit", ['<a ="<a "', '<a b="', "<a b='", "<p <p ", "<!--", "<script ", "<td x=", "=", '<a href= "', "&copy", "</p", "<title"])
def test_no_page_takes_quadratic_time(unit):
    took = []
    for n in (20_000, 200_000):
        page, begin = "<a " + unit * n, time.perf_counter()
        warc.visible_text(page), warc.links(page, None), warc.TITLE.search(page)
        took.append(time.perf_counter() - begin)
    assert took[1] < 30 * max(took[0], 0.01), took


def test_unpacking_is_bounded_and_reads_all_members():
    def packed(data, bits=31):
        z = zlib.compressobj(9, zlib.DEFLATED, bits)
        return z.compress(data) + z.flush()

    gzip = {"content-encoding": "gzip"}
    assert warc.unpacked(packed(b"ab") + packed(b"cd") + b"junk", gzip) == b"abcd"
    assert warc.unpacked(packed(bytes(3000)), gzip, 2999) is None and warc.unpacked(packed(bytes(3000)), gzip, 3000) == bytes(3000)
    assert warc.unpacked(packed(packed(bytes(5000))), {"content-encoding": "gzip, gzip"}, 4000) is None
    assert warc.unpacked(packed(b"cut short" * 50)[:-9], gzip) is not None and warc.unpacked(b"none", gzip) is None
    assert warc.unpacked(packed(b"raw", -15), {"content-encoding": "deflate"}) == b"raw"


def test_a_page_that_unpacks_to_too_much_has_metadata_only(spark, monkeypatch):
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    body = z.compress(b"<p>x" + bytes(warc.MOST_BYTES)) + z.flush()
    rows = [(1, "<urn:1>", "response", "http://h/", None, "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n", body, None)]
    got = warc.derive(spark.createDataFrame(rows, warc.RESPONSE)).collect()
    assert [r.warc_type for r in got] == ["metadata"] and json.loads(got[0].block)["payload_length"] == len(body)
    assert list(itertools.chain(got))
