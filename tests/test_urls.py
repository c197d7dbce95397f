import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.hosts import encoded_label
from pagemill.operators.policy import classify_addresses, resolve_policy
from pagemill.operators.urls import (
    canonicalize_urls, classify_sources, dedupe_by_fingerprint, fingerprint_groups,
)

# (url, normalized or None, reject reason or None)
URLS = [
    ("HTTP://Shop.Example:80/a?utm_medium=x&q=1&r=2#part", "http://shop.example/a?q=1&r=2", None),
    ("http://shop.example/a?q=1&r=2", "http://shop.example/a?q=1&r=2", None),
    ("https://e.org", "https://e.org/", None),
    ("https://e.org?", "https://e.org/", None),
    ("https://e.org/?a=1&&b=2", "https://e.org/?a=1&&b=2", None),
    ("https://e.org/?%67clid=1", "https://e.org/", None),
    ("https://e.org/?GCLID=1", "https://e.org/?GCLID=1", None),
    ("https://e.org/x/./y/../z", "https://e.org/x/z", None),
    ("https://e.org/ü x", "https://e.org/%C3%BC%20x", None),
    ("http://e.org:443/", "http://e.org:443/", None),
    ("http://[2001:DB8::0:1]/", "http://[2001:db8::1]/", None),
    ("http://10.1.2.3/", "http://10.1.2.3/", None),
    ("https://e.org/" + "y" * 8200, None, "too_long"),
    ("https:/nohost", None, "missing_host"),
    ("plain words", None, "missing_host"),
    ("http://bad host/", None, "invalid"),
    ("http://e.org:70000/", None, "invalid"),
    ("http://1.2.3.999/", None, "invalid"),
    ("http://[1::2::3]/", None, "invalid"),
    ("gopher://e.org/", None, "unsupported_scheme"),
    ("http://me:pw@e.org/", None, "user_information"),
    ("http://e.org:0/", None, "port_zero"),
    ("http://e.org:8443/", None, "port_denied"),
    ("http://3232235777/", None, "ambiguous_numeric_host"),
    ("http://0xc0.0xa8.1.1/", None, "ambiguous_numeric_host"),
    ("http://0300.0250.1.1/", None, "ambiguous_numeric_host"),
]


@pytest.fixture(scope="module")
def canonical(spark):
    frame = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    return canonicalize_urls(frame).cache()


def test_canonical_forms_and_reject_reasons(canonical):
    rows = {r.page_id: r for r in canonical.collect()}
    for i, (url, normalized, reason) in enumerate(URLS):
        assert (rows[i].normalized, rows[i].reject_reason) == (normalized, reason), url
        assert rows[i].original == url
        assert (rows[i].fingerprint is None) == (normalized is None)


def test_equal_pages_share_a_fingerprint_and_keep_their_spellings(canonical):
    groups = {r.original: r for r in fingerprint_groups(canonical).collect()}
    shared = groups[URLS[0][0]]
    assert (shared.n_pages, shared.n_originals, shared.first_page) == (2, 2, 0)
    assert dedupe_by_fingerprint(canonical).count() == canonical.where("fingerprint is not null").count()


def test_routes_need_an_exact_host_or_a_dot(spark):
    cases = {
        "https://github.com/a": "github", "https://gist.github.com/a": "github",
        "https://twitter.com/a": "x", "https://m.instagram.com/": "instagram",
        "https://threads.net/t": "threads", "https://redd.it/1": "reddit",
        "https://news.ycombinator.com/": "hacker_news", "https://m.youtube.com/v": "youtube",
        "https://e.org/Paper.PDF": "pdf", "https://e.org/paper.pdf?x": "pdf",
        "https://mygithub.com/": "generic_web", "https://github.com.e.org/": "generic_web",
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    rows = classify_sources(canonicalize_urls(frame)).collect()
    assert {r.url: r.route for r in rows} == cases


ADDRESSES = {
    "0.0.0.0": "unspecified", "127.8.8.8": "loopback", "169.254.170.2": "metadata",
    "172.16.0.9": "private", "172.32.0.9": None, "100.127.1.1": "shared", "100.128.1.1": None,
    "169.254.9.9": "link_local", "203.0.113.77": "documentation", "198.19.255.255": "benchmarking",
    "239.1.1.1": "multicast", "255.255.255.255": "reserved", "192.88.99.1": "reserved",
    "0.1.2.3": "reserved", "9.9.9.9": None, "::": "unspecified", "::1": "loopback",
    "fd00:ec2::254": "metadata", "fd12::1": "private", "febf::1": "link_local", "ff05::2": "multicast",
    "2001:db8:1::": "documentation", "3fff::1": "documentation", "2001:2:0:9::": "benchmarking",
    "100::1": "reserved", "64:ff9b:1::": "reserved", "2002:1::": "reserved", "fec0::1": "reserved",
    "4000::1": "reserved", "2001:20::1": "reserved", "2620:fe::fe": None,
    "::ffff:192.168.0.1": "private", "::FFFF:8.8.4.4": None, "nonsense": "unparsed", "1.2.3": "unparsed",
}


def test_every_address_class(spark):
    frame = spark.createDataFrame([(a,) for a in ADDRESSES], "address string")
    rows = {r.address: r for r in classify_addresses(frame).collect()}
    assert {a: rows[a].blocked_class for a in ADDRESSES} == ADDRESSES
    assert rows["nonsense"].address_hex is None


def test_one_blocked_answer_blocks_the_lookup(spark):
    lookups = spark.createDataFrame(
        [("ok", False), ("mixed", False), ("none", False), ("down", True)],
        "lookup_id string, failed boolean",
    )
    answers = spark.createDataFrame(
        [("ok", 1, "9.9.9.9"), ("mixed", 1, "9.9.9.9"), ("mixed", 3, "10.0.0.1"),
         ("mixed", 2, "127.0.0.1")],
        "lookup_id string, ordinal int, address string",
    )
    rows = resolve_policy(lookups, answers)
    assert "address" not in rows.columns
    assert {r.lookup_id: (r.outcome, r.blocked_class) for r in rows.collect()} == {
        "ok": ("allow", None), "mixed": ("policy", "loopback"), "none": ("empty", None),
        "down": ("dns", None),
    }


def test_label_codes_equal_the_standard_library(spark):
    draw = random.Random(3)
    letters = "abcxyz019-äöüßéñçøåλдж日本語中文ελ한국어😀ğşıשלום"
    labels = ["bücher", "правда", "ü" * 30, "x" * 50 + "ü"]
    labels += ["".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(200)]
    labels = [x for x in labels if not x.isascii()]
    frame = spark.createDataFrame([(x,) for x in labels], "x string")
    found = frame.select("x", encoded_label(F.col("x")).alias("code")).collect()
    assert {r.x: r.code for r in found} == {x: x.encode("punycode").decode() for x in labels}


def test_spellings_of_a_host_share_a_fingerprint(spark):
    same = [
        "https://bücher.example/a", "https://BÜCHER.example/a", "https://bücher.example/a",
        "https://ｂücher。example/a", "https://xn--bcher-kva.example/a", "https://b%C3%BCcher.example/a",
        "https://bü­cher.example/a",
    ]
    rows = [*enumerate(same), (90, "https://bucher.example/a"), (91, "https://a.日本語.jp:443")]
    found = {r.page_id: r for r in canonicalize_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {found[k].normalized for k in range(len(same))} == {"https://xn--bcher-kva.example/a"}
    assert len({found[k].fingerprint for k in range(len(same))}) == 1
    assert found[90].fingerprint != found[0].fingerprint
    assert found[91].host == "a.xn--wgv71a119e.jp" and found[91].reject_reason is None


def test_absent_urls_have_no_host_and_long_paths_stay_whole(spark):
    long_path = "/a/.." * 4000 + "/b" * 9000
    rows = [(1, None), (2, "https://example.com" + long_path)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r for r in canonicalize_urls(frame, max_url_bytes=100_000).collect()}
    assert found[1].reject_reason == "missing_host"
    assert found[2].path == "/b" * 9000
