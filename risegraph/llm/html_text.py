"""Main text of web pages: streamed parser events, text-to-tag ratio, Gaussian smoothing.

The standard library's parser streams tags and text into lines: one for each block of running
text. A line's ratio is its characters against its tags, characters inside links counting as
tags do. Lines of menus and the like (elements that never hold an article) get no ratio; blocks
that only a form or their class, id or role mark as no content come second: they count where the
page has nothing else. The ratios are smoothed by a Gaussian over neighbouring lines, and lines
above the threshold, the deviation of the smoothed ratios, seed the content. Content is clustered by
region, the outermost article or main element or else the run of lines between boilerplate. An
article with a seed is kept whole, so a short paragraph stays with it; a run without markup is
kept from its first seed to its last, so the ratios alone cut off what stands around a text.
Where articles exist, only they are regions; an article or main element starts afresh inside a
marked block, and counts if no other stands outside of one.

Defined cases: null or empty html gives an empty text; a null url or page_id is carried;
repeated rows are extracted again; unclosed, stray and cut-off tags are taken as a browser
would; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

EXTRACTED = "page_id long, url string, text string, n_chars long"
#: Standard deviation of the smoothing, in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3
#: Share of the ratios' deviation that a content line reaches.
THRESHOLD = 0.5

# fixed values: elements of HTML
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p "
                   "pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
SKIPPED = frozenset("script style noscript template head title nav footer aside menu dialog button select "
                    "textarea iframe object svg canvas audio video".split())
#: Elements that hold an article.
REGIONS = frozenset(("article", "main"))
#: What an element's text is: content, marked as none, or never content.
CONTENT, MARKED, NEVER = 0, 1, 2
#: Words of a class, id or role that mark a block as no content.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                  "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
                  "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies "
                  "share sharing social related recommended recommendations widget pagination pager toolbar "
                  "complementary contentinfo search".split())
#: An end tag closes these only up to the nearest of its own kind.
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


class LineEvents(HTMLParser):
    """Turns parser events into lines: (text, tags, characters in links, region, CONTENT or not)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, int, int]] = []  # name, CONTENT or not, region
        self.wrapped: set[int] = set()  # regions inside a marked block
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.regions = self.run = 0

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip() if self.text else ""
        if text:
            _, out, region = self.open[-1] if self.open else ("", CONTENT, 0)
            if out:
                self.run += 1  # content before and after it are different runs
            self.lines.append((text, self.tags, self.linked, region or -1 - self.run, out))
            self.tags = self.linked = 0
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
            if tag in CLOSES_P:
                self._close("p")
            elif tag == "li":
                self._close(tag, "ul ol menu dir")
            elif tag in ("dd", "dt"):
                self._close("dd", "dl")
                self._close("dt", "dl")
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        _, out, region = self.open[-1] if self.open else ("", CONTENT, 0)
        before = out
        if tag in REGIONS and not region and out < NEVER:
            self.regions += 1
            region = self.regions
            if out:
                self.wrapped.add(region)
            out = CONTENT
        if out < NEVER:
            out = max(out, self._kind(tag, attrs, region))
        if tag in BLOCKS or out != before:
            self._end_line()
        if tag == "a":
            self.links += 1
        self.open.append((tag, out, region))

    @staticmethod
    def _kind(tag, attrs, region: int) -> int:
        if tag in SKIPPED or tag == "header" and not region:
            return NEVER
        kind = MARKED if tag == "form" else CONTENT
        if tag in ("body", "html", "article", "main"):
            return kind
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return NEVER
            # a marked word inside a sentence is a part of it
            if tag in BLOCKS and name in ("class", "id", "role") and value and not MARKS.isdisjoint(_PARTS.findall(value.lower())):
                kind = MARKED
        return kind

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, within: str = "") -> None:
        """Ends the nearest open ``tag``, unless one of ``within`` stands before it."""
        stops = within.split() or REGIONS | {"div", "section", "td", "li", "body", "blockquote"}
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.links -= sum(x[0] == "a" for x in self.open[i:])
                del self.open[i:]
                return
            if name in stops:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if at < 0:
            return
        if tag not in BLOCKS and any(x[0] in BLOCKS for x in self.open[at + 1:]):
            # an inline end tag doesn't end blocks: only its own element goes
            if tag == "a":
                self.links -= 1
            del self.open[at]
            return
        if tag in BLOCKS or self.open[at][1] != (self.open[at - 1][1] if at > 0 else CONTENT):
            self._end_line()
        self.tags += 1
        self.links -= sum(x[0] == "a" for x in self.open[at:])
        del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, int, int]]:
        self.close()
        self._end_line()
        return self.lines


_KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-REACH, REACH + 1)]


def smoothed(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        lo, hi = max(0, i - REACH), min(n, i + REACH + 1)
        kernel = _KERNEL[lo - i + REACH:hi - i + REACH]
        out.append(sum(k * v for k, v in zip(kernel, values[lo:hi])) / sum(kernel))
    return out


def main_text(html: str) -> str:
    """The blocks of the page's content, joined by an empty line."""
    if not html:
        return ""
    events = LineEvents()
    events.feed(html)
    lines = events.finish()
    inside = [x for x in lines if x[4] == CONTENT and x[3] > 0]
    if any(x[3] not in events.wrapped for x in inside):
        inside = [x for x in inside if x[3] not in events.wrapped]
    proper = {x[3] for x in inside}
    # what may be content: articles, else unmarked lines, else marked ones
    level = next((k for k in (CONTENT, MARKED) if any(x[4] == k and _ratio(x) for x in lines)), NEVER)
    may = [x[4] == CONTENT and x[3] in proper if proper else x[4] <= level < NEVER for x in lines]
    ratios = [_ratio(x) if ok else 0.0 for x, ok in zip(lines, may)]
    if not any(ratios):
        return ""
    soft = smoothed(ratios)
    mean = sum(soft) / len(soft)
    threshold = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in soft) / len(soft))
    seeds = [i for i, (r, s) in enumerate(zip(ratios, soft)) if r > 0 and s >= threshold]
    if not seeds:  # content, but short: its best line
        seeds = [max((s, -i, i) for i, (r, s) in enumerate(zip(ratios, soft)) if r > 0)[2]]
    first, last = {}, {}
    for i in seeds:
        region = lines[i][3]
        first.setdefault(region, 0 if region in proper else i)
        last[region] = len(lines) if region in proper else i
    return "\n\n".join(x[0] for i, (x, ok) in enumerate(zip(lines, may)) if ok and first.get(x[3], len(lines)) <= i <= last.get(x[3], -1))


def _ratio(line: tuple[str, int, int, int, int]) -> float:
    text, tags, linked, *_ = line
    return max(0, len(text) - 2 * linked) / max(1, tags)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [main_text(h) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole_text("html").alias("html")).mapInArrow(
        run, EXTRACTED)
