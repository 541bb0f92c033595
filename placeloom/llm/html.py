"""HTML extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A leaf block is a stretch of text between the borders of block-level elements; inline elements
and line breaks do not end it. Character references are decoded, white space inside a block
becomes one space, and the ends are trimmed. Scripts, styles and what else is never shown are no
text. Each block has features of its ancestors (tags, the innermost words of class, id and role), of
its text (size, share of links, punctuation, words) and of its place; how these combine (an aside in
an article, say) is for the CRF to learn: the rule that labels the training pages is no feature. It tags it as article or
other, decoded by Viterbi, and the article blocks are joined in page order by one newline.

Training. Labelled pages are at most ``TRAIN_PAGES`` pages of smallest hash among those that mark
their article with an ``article`` or ``main`` element (blocks in it, outside navigation, asides,
forms and the like, are article), and ``MADE_UP`` pages drawn with a set seed from several
layouts, with and without such elements.

Edge cases: null or empty html gives an empty text; unclosed and truncated markup is read as far
as it goes, past unknown declarations too; a body, text or any other flow content ends a head that
was left open, and ``/>`` closes svg, math and
other elements whose text is never shown; text outside any element is a block; the work for a block
does not grow with the depth it stands at; a page without article blocks gives an empty
text; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .crf import LinearChainCRF, bucket

TRAIN_PAGES, MADE_UP, BUCKETS, SEED = 300, 400, 1 << 13, 17
OTHER, ARTICLE = 0, 1
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown.
HIDDEN = frozenset("script style template noscript head title iframe object svg math canvas audio video".split())
#: Elements that an opening tag of the same kind, or of the kinds named, ends.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: What may stand in a head; anything else ends a head that was left open.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements whose text is not shown that "/>" closes; a reader that did not close them would lose the page's rest.
SELF_CLOSED = frozenset("svg math iframe object canvas audio video template".split())
#: Tags with a digit, and how many tags and labels of ancestors are features, the innermost labels first.
HEADINGS, TAGS, LABELS = frozenset(f"h{i}" for i in range(1, 7)), 48, 32
_SECTION = re.compile(r"<!\[(temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-zA-Z0-9])", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_ASIDE_TAGS = frozenset("nav aside footer form button select textarea dialog menu".split())
_ASIDE_WORDS = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie notice consent nav menu sidebar footer comment comments related share social newsletter subscribe breadcrumb breadcrumbs popup modal".split())


class Element:
    """An open element, with what its descendants inherit. It holds as much at any depth."""

    __slots__ = ("aside", "kin", "labels", "marked", "tag", "tags", "up", "words")

    def __init__(self, tag: str, words: tuple[str, ...], up: Element | None) -> None:
        self.tag, self.words, self.up = tag, words, up
        plain = tag if tag.isalpha() and len(tag) <= 10 or tag in HEADINGS else "other"
        self.tags = (up.tags if up else frozenset()) | {plain} if not up or plain not in up.tags else up.tags
        self.labels = tuple(dict.fromkeys((*words, *(up.labels if up else ()))))[:LABELS]
        self.aside = (bool(up and up.aside[0]) or tag in _ASIDE_TAGS, bool(up and up.aside[1]) or not _ASIDE_WORDS.isdisjoint(words))
        self.marked = bool(up and up.marked) or tag in ("article", "main")
        self.kin: list[str] | None = None

    def features(self) -> list[str]:
        """Features of the blocks that stand right in it; made once."""
        if self.kin is None:
            self.kin = [f"own {self.tag}", f"parent {self.up.tag if self.up else 'none'}"]
            self.kin += [f"in {t}" for t in sorted(self.tags)[:TAGS]] + [f"label {w}" for w in self.labels] + [f"own label {w}" for w in self.words[:LABELS]]
            self.kin += ["aside tag"] * self.aside[0] + ["aside label"] * self.aside[1]
        return self.kin


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, Element | None]] = []  # tags, with the block-level element that is open there
        self.blocks: list[tuple[str, int, Element | None]] = []  # text, characters of links, innermost element
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0
        self.links = 0

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked, self.path[-1][1] if self.path else None))
        self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for tag, _ in self.path[to:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.path[to:]

    def _end_head(self, tag: str | None = None) -> None:
        """Close an open head before what cannot stand in it; a body closes it from any depth."""
        if tag == "body":
            for i, (name, _) in enumerate(self.path):
                if name == "head":
                    self._pop(i)
                    return
        elif self.path and self.path[-1][0] == "head" and tag not in HEAD:
            self._pop(len(self.path) - 1)

    def handle_starttag(self, tag: str, attrs) -> None:
        self._end_head(tag)
        if tag not in INLINE:
            self._end_block()
            if closes := _CLOSES.get(tag, {"p"} if tag not in INLINE else None):
                for i in range(len(self.path) - 1, -1, -1):
                    if self.path[i][0] in closes:
                        self._pop(i)
                    elif self.path[i][0] not in INLINE:
                        break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        inner = self.path[-1][1] if self.path else None
        if tag not in INLINE:
            inner = Element(tag, tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORDS.findall(v.lower())), inner)
        self.path.append((tag, inner))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SELF_CLOSED:
            self._pop(len(self.path) - 1)

    def parse_html_declaration(self, i: int) -> int:
        """Sections of an unknown or missing key word are bogus comments; the parser gives up on them."""
        if self.rawdata.startswith("<![", i) and not _SECTION.match(self.rawdata, i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.path[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[tuple[str, int, Element | None]]:
    """The leaf blocks in page order: text, characters inside links, the innermost block-level element."""
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    reader._end_block()
    return reader.blocks


def _few(x: float, *limits: float) -> int:
    return sum(x >= limit for limit in limits)


def features(found: list[tuple[str, int, Element | None]]) -> list[list[str]]:
    out, n = [], len(found)
    for i, (text, linked, inner) in enumerate(found):
        words = text.count(" ") + 1
        size = len(text)
        links = linked / size
        one = ["bias", f"size {_few(size, 15, 40, 80, 160, 400)}", f"words {_few(words, 3, 8, 20, 60)}", f"links {_few(links, 0.01, 0.3, 0.7, 0.95)}", f"ends {text[-1] if text[-1] in '.!?:,;' else 'a'}", f"commas {_few(text.count(',') / words, 0.01, 0.05, 0.2)}", f"place {_few(i / n, 0.1, 0.3, 0.7, 0.9)}", f"first {i == 0} last {i == n - 1}", f"mark {'©' in text or '|' in text or '·' in text}"]
        one.append(f"own {inner.tag if inner else 'none'} links {_few(links, 0.3, 0.9)}")
        out.append(one + (inner.features() if inner else ["own none", "parent none"]))
    return out


def marked(found: list[tuple[str, int, Element | None]]) -> list[int]:
    """The labels of a page that marks its article."""
    return [ARTICLE if x is not None and x.marked and not any(x.aside) else OTHER for _, _, x in found]


def made_up(n: int, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages in several layouts, with the texts of their article blocks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(1, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda: phrase(4, 14) + rng.choice([".", ".", ", " + phrase(2, 6).lower() + ".", "?"])
    para = lambda: " ".join(sentence() for _ in range(rng.randint(1, 5)))
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul>"
    out = []
    for _ in range(n):
        body, texts = [], []
        for i in range(rng.randint(1, 9)):
            t = phrase(2, 9) if i == 0 or rng.random() < 0.15 else para()
            tag = "h1" if i == 0 else "h2" if t[-1].isalpha() else rng.choice(["p", "p", "p", "blockquote", "li"])
            texts.append(t)
            inner = t if rng.random() < 0.8 else f"<b>{t}"
            body.append(f"<{tag}>{inner}</b></{tag}>" if inner != t else f"<{tag}>{t}</{tag}>")
            if rng.random() < 0.1:
                body.append(rng.choice([f'<div class="ad">{para()}</div>', f"<aside>{para()}</aside>", f'<div class="share">{links(3)}</div>']))
        before = [rng.choice(["", f"<nav>{links(rng.randint(2, 7))}</nav>", f'<div class="menu">{links(4)}</div>', f'<div id="nav">{links(5)}</div>'])]
        before += [f"<header><p>{phrase(1, 6)}</p></header>"] * (rng.random() < 0.4) + [f'<div class="ad">{rng.choice([para, sentence])()}</div>'] * (rng.random() < 0.5) + [f'<div class="{rng.choice(["cookie", "notice", "banner", "consent"])}"><p>{sentence()}</p></div>'] * (rng.random() < 0.4)
        after = [f'<section class="comments"><p>{para()}</p><p>{sentence()}</p></section>'] * (rng.random() < 0.4) + [f'<div id="comments"><ol><li>{sentence()}</li><li>{para()}</li></ol></div>'] * (rng.random() < 0.2)
        after += [rng.choice([f"<aside>{links(3)}<p>{sentence()}</p></aside>", f'<div class="sidebar"><p>{para()}</p>{links(4)}</div>', f'<div class="related">{links(3)}</div>'])] * (rng.random() < 0.5)
        after += [f"<form><label>{phrase(1, 4)}</label><input name=q><button>{word()}</button><p>{sentence()}</p></form>"] * (rng.random() < 0.3)
        after += [f"<footer><p>&copy; {word()} {sentence()}</p></footer>"] * (rng.random() < 0.7) + [f'<div class="footer">&copy; {word()} &middot; {sentence()}</div>'] * (rng.random() < 0.3)
        rng.shuffle(after)
        wrap = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post"><div class="entry">{}</div></div>', "<main><article>{}</article></main>", "<div>{}</div>"])
        inside, outside = after[: len(after) // 2], after[len(after) // 2 :]
        if not wrap.startswith(("<article", "<main")) or rng.random() < 0.7:
            inside, outside = [], after
        out.append((f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>" + "".join(before) + wrap.format("".join(body + inside)) + "".join(outside) + "</body></html>", texts))
    return out


def _made_up_rows(n: int, seed: int) -> Iterator[tuple[list[list[str]], list[int]]]:
    for html, texts in made_up(n, seed):
        found, left = blocks(html), list(texts)
        tags = []
        for text, _, _ in found:
            hit = bool(left) and text == left[0]
            tags.append(ARTICLE if hit else OTHER)
            if hit:
                left.pop(0)
        yield features(found), tags


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, n_made_up: int = MADE_UP, seed: int = SEED) -> LinearChainCRF:
    html = F.col("html").cast("string")
    ids = [r.page_id for r in pages.filter(html.contains("<article") | html.contains("<main")).select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(text)
                if found:
                    rows.append((page, json.dumps([features(found), marked(found)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["page_id", "row"])

    data = []
    if ids:
        sample = pages.filter(F.col("page_id").isin(ids)).select(F.col("page_id").cast("long"), html).mapInArrow(read, "page_id long, row string")
        data = [tuple(json.loads(r.row)) for r in sample.orderBy("page_id", "row").limit(train_pages).collect()]
    data += list(_made_up_rows(n_made_up, seed))
    rows = [([[bucket(f, BUCKETS) for f in one] for one in feats], tags) for feats, tags in data if feats]
    return LinearChainCRF.fit(rows, BUCKETS, 2, epochs=6, seed=seed)


def main_text(html: str | None, model: LinearChainCRF) -> str:
    found = blocks(html)
    if not found:
        return ""
    path = model.viterbi([model.ids(f) for f in features(found)])
    return "\n".join(b[0] for b, state in zip(found, path, strict=True) if state == ARTICLE)


def extract(pages: DataFrame, model: LinearChainCRF) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_main_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
