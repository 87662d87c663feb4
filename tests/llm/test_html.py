import re
from html import unescape

import numpy as np
import pytest

from wordframe.llm import html_text as H

CASES = [
    ("<article><p>a&amp;b  <b>c</b>\n d</p><p>&eacute; &#65;</p></article>", "a&b c d\né A"),
    ("<body><nav><ul><li>menu</li></ul></nav><main><h1>T</h1><p>one<p>two</main><footer>&copy; x</footer>", "T\none\ntwo"),
    ("<article><h1>T</h1><div class='ad banner'>buy</div><p>x</p><aside>y</aside><section id=comments><p>nice</p></section></article>", "T\nx"),
    ("<article><p>x</p><form><input><button>go</button></form><script>var a='</p>';</script><style>p{}</style><p>y</p></article>", "x\ny"),
    ("<article><p>x<!-- not here --></p><p hidden>no</p><p>y</p></article><div class=cookie-notice>We use cookies</div>", "x\ny"),
    ("<article><p><b>open <br><p>next</article><p>outside</p>", "open\nnext"),
    ("<article><ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr></table></article>", "a\nb\nc\nd"),
    ("<p>only a paragraph</p>", "only a paragraph"),
    ("no tags at all", "no tags at all"),
    (None, ""), ("", ""), ("<div></div>", ""), ("<script>x</script>", ""),
]


@pytest.mark.parametrize("html,want", CASES)
def test_cases(html, want):
    assert H.main_text(html) == want


def test_smoothing_is_a_weighted_mean():
    ratios = np.array([1.0, 5.0, 2.0, 8.0])
    got = H.smoothed(ratios, 1.0)
    w = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    padded = np.concatenate([[1.0] * 3, ratios, [8.0] * 3])
    assert np.allclose(got, [(padded[i:i + 7] * w).sum() / w.sum() for i in range(4)])


def test_clusters_without_an_article_element():
    body = "".join(f"<p>{'long content words ' * 12}{i}</p>" for i in range(4))
    links = "".join(f"<p><a href=x>l</a> <a href=y>m</a> <a href=z>n</a></p>" for _ in range(12))
    got = H.main_text(f"<body>{links}<h2>Heading</h2>{body}{links}</body>")
    assert got.count("long content words") == 48 and got.count("l m n") <= 4


def test_whole_table_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["page_id"]: r for r in H.op3_tag_ratio_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("</?b>", "", b))).strip() for b in re.split("</?(?:p|h1|br)>", article)]
        want = "\n".join(b for b in blocks if b)
        row = found[p["page_id"]]
        assert row["text"] == want and row["n_chars"] == len(want) and row["url"] == p["url"]


def test_odd_and_empty_tables(spark):
    long = "<article>" + "<p>some words &amp; more</p>" * 30_000
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", long, None), (2, "u", long, None), (3, "u", "<b>é</b>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.extracted(pages).toPandas()
    assert list(found.columns) == ["page_id", "url", "text", "n_chars"] and sorted(found.n_chars) == [0, 0, 1, 539_999, 539_999]
    assert H.extracted(pages.limit(0)).count() == 0
