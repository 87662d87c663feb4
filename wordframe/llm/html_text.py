"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and threshold clustering."""
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0         # width of the Gaussian over neighbouring lines
THRESHOLD = 0.5     # of the standard deviation of the smoothed ratios
_SPACE = re.compile(r"\s+")
_WORD_END = re.compile(r"[a-z]+")

# Elements of the HTML standard.
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p".split())
HIDDEN = frozenset((
    "script style noscript template head title nav header footer aside form button select option textarea menu dialog "
    "iframe object embed svg canvas audio video map").split())
# Words of class, id and role that name what is not the article.
BOILERPLATE = frozenset((
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar sidenav aside complementary "
    "contentinfo notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup login form search searchbox comment comments commentlist disqus replies reply respond related recommended "
    "recommendations share sharing social toolbar pagination pager widget skip dialog").split())
ARTICLE = frozenset("article main".split())


class _Line:
    __slots__ = ("parts", "tags", "inside", "outside", "heading")

    def __init__(self, inside: int, hidden: bool, heading: bool):
        self.parts, self.tags, self.inside, self.outside, self.heading = [], 0, inside, hidden, heading


class _Events(HTMLParser):
    """Lines of text with the tags that stand in them; a line ends where a block begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, bool, bool]] = []        # tag, hides, holds the article
        self.hiding = self.holding = self.articles = 0
        self.line = None

    def _next(self):
        self.line = None

    def _now(self) -> _Line:
        if self.line is None:
            self.line = _Line(self.articles if self.holding else 0, self.hiding > 0, any(t in ("h1", "h2") for t, _, _ in self.open[-3:]))
            self.lines.append(self.line)
        return self.line

    def _close(self, at: int):
        for _, hides, holds in self.open[at:]:
            self.hiding -= hides
            self.holding -= holds
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block and tag != "br":                           # a paragraph ends where another block begins
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in CLOSED_BY_BLOCK:
                    self._close(at)
                    break
                if self.open[at][0] in BLOCKS:
                    break
        if block:
            self._next()
        elif tag not in VOID or tag in ("img", "input", "wbr"):
            self._now().tags += 1
        if tag in VOID:
            return
        hides = tag in HIDDEN and not (tag == "header" and self.holding)      # an article's own header holds its title
        for name, value in attrs:
            if name in ("class", "id", "role") and value and not hides:
                hides = tag not in ("html", "body", *ARTICLE) and not BOILERPLATE.isdisjoint(_WORD_END.findall(value.lower()))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hides = True
        holds = tag in ARTICLE
        self.articles += holds and not self.holding         # numbers the outermost article or main elements
        self.open.append((tag, hides, holds))
        self.hiding += hides
        self.holding += holds
        if hides:
            self._next()

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                hides = self.open[at][1]
                if tag in BLOCKS or hides:
                    self._next()
                else:
                    self._now().tags += 1
                self._close(at)
                return
        if tag in BLOCKS:
            self._next()

    def handle_data(self, data):
        if data.strip() or self.line is not None:
            self._now().parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines; beyond the page the edge lines go on."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), mode="valid")


def main_text(html: str | None) -> str:
    """Blocks of the article, white space inside each as one space, joined by a line break.

    Lines of hidden elements and of parts named as boilerplate never count. Of the others, lines whose smoothed
    text-to-tag ratio reaches the threshold form the content clusters. A cluster in an article element stands for that
    whole element, short lines included; without such an element the clusters and the headings right above them count.
    """
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    lines = []
    for line in events.lines:
        if not line.outside:
            text = _SPACE.sub(" ", "".join(line.parts)).strip()
            if text:
                lines.append((text, line.tags, line.inside, line.heading))
    if not lines:
        return ""
    smooth = smoothed(np.array([len(text) / (1 + tags) for text, tags, _, _ in lines]))
    region = smooth >= min(THRESHOLD * smooth.std(), smooth.max())
    inside = np.array([x[2] for x in lines])
    articles = np.unique(inside[region & (inside > 0)])
    if len(articles):
        region = np.isin(inside, articles)
    else:
        for i in range(len(lines) - 2, -1, -1):
            if lines[i][3] and region[i + 1]:
                region[i] = True
    return "\n".join(x[0] for x, keep in zip(lines, region) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"])


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars`` (code points) in place of the html.

    Each page is parsed once in the task that reads it. A missing or empty page has empty text; broken mark-up is read
    as the parser recovers from it; repeated rows give equal texts. Input columns named like the result are replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("_html"))
    schema = type(source.schema)(source.schema.fields[:-1]).add("text", "string").add("n_chars", "long")
    return source.mapInArrow(_extract, schema)


def op3_tag_ratio_extraction(spark, sf_dir):
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
