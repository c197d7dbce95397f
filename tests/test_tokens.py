from pagemill.operators.spans import element_spans
from pagemill.operators.tokens import enforce_limits, token_arrays, tokenize


def _pages(spark, *bodies):
    rows = list(enumerate(bodies))
    return spark.createDataFrame(rows, "page_id long, html string")


def _tokens(spark, html):
    rows = tokenize(_pages(spark, html)).orderBy("pos").collect()
    return [(r.kind, r.name, r.text) for r in rows]


def test_raw_text_hides_tags_and_entities_are_decoded(spark):
    html = '<title>A &amp; B</title><script>if (a<b) "</p>"</script><p>x &lt; y &#233; &hellip;</p>'
    assert _tokens(spark, html) == [
        ("raw", "title", "A & B"), ("end", "title", None),
        ("raw", "script", 'if (a<b) "</p>"'), ("end", "script", None),
        ("start", "p", None), ("text", None, "x < y é …"), ("end", "p", None),
    ]


def test_quoted_angle_brackets_stay_in_their_tag(spark):
    assert _tokens(spark, "<a title='1 > 0' href=x>go</a>") == [
        ("start", "a", None), ("text", None, "go"), ("end", "a", None),
    ]


def test_stray_brackets_are_text_and_comments_split_it(spark):
    assert _tokens(spark, "1<2 <!-- c --> 3 </4>z") == [
        ("text", None, "1<2"), ("comment", None, None), ("text", None, "3"),
        ("comment", None, None), ("text", None, "z"),
    ]


def test_a_tag_cut_off_by_the_end_of_the_page_is_dropped(spark):
    assert _tokens(spark, "a<p class='x") == [("text", None, "a")]
    assert _tokens(spark, "a<p class='x>") == [("text", None, "a")]


def test_unclosed_title_swallows_the_rest(spark):
    assert _tokens(spark, "<title>T<body><p>x") == [("raw", "title", "T<body><p>x")]


def test_unicode_whitespace_and_legacy_references(spark):
    html = "a  b&nbsp;c &copy2 &unknown; &#x80; &#xD800;"
    assert _tokens(spark, html) == [("text", None, "a b c ©2 &unknown; € �")]


def test_a_reference_cut_before_its_semicolon_is_decoded(spark):
    assert _tokens(spark, "<title>a&amp;&amp</title><h1>a&amp;&amp</h1>b &am") == [
        ("raw", "title", "a&&"), ("end", "title", None),
        ("start", "h1", None), ("text", None, "a&&"), ("end", "h1", None), ("text", None, "b &am"),
    ]


def test_spans_follow_the_recovery_rules(spark):
    html = "<div><h1>T<p>one<p>two<ul><li>x</ul></div><footer>f"
    rows = element_spans(token_arrays(_pages(spark, html))).orderBy("start").collect()
    found = {(r.name, r.start): r.end for r in rows}
    # 0 div 1 h1 2 T 3 p 4 one 5 p 6 two 7 ul 8 li 9 x 10 /ul 11 /div 12 footer
    assert found[("div", 0)] == 11
    assert found[("h1", 1)] == 11
    assert found[("p", 3)] == 5
    assert found[("p", 5)] == 7
    assert found[("footer", 12)] is None
    assert all(r.recovery for r in rows)  # the footer never closes


def test_crossing_containers_are_reported(spark):
    pages = _pages(spark, "<section><div>x</section></div>", "<section><div>x</div></section>")
    flags = {r.page_id: r.recovery for r in element_spans(token_arrays(pages)).collect()}
    assert flags == {0: True, 1: False}


def test_limits_at_and_over_each_bound(spark):
    html = "<html><head></head><body><p>ab</p></body></html>"  # 1 + 4 elements + 1 text = 6
    size = len(html)

    def outcome(max_bytes, max_nodes):
        return enforce_limits(_pages(spark, html), max_bytes, max_nodes).first().parse_failure

    assert outcome(size, 6) is None
    assert outcome(size - 1, 6) == "resource_limit"
    assert outcome(size, 5) == "resource_limit"
    implied = enforce_limits(_pages(spark, "<p>ab"), 100, 100).first()
    assert implied.n_nodes == 6
