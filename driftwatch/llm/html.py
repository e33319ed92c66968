"""Main text of web pages as the maximum-scoring run of words and tags.

Words score positive and tags negative, with weights learned from labelled pages (those that mark their main part with an
`article`, `main` or equal role). One linear scan finds the contiguous run with the best sum; elements that are never part
of an article (menus, adverts, forms, scripts, comments ...) score nothing for their words and are left out of the run.
"""

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.sampling import bounded

LABELLED = 3000  # labelled pages that the weights are learned from, at most about
LEAST, BOUNDARY = 0.02, 10.0  # the least and the most that one tag takes away

# fixed values: HTML element names, and names that sites give to parts that are not the article
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr",
          "script", "style", "template", "noscript", "button", "input", "select", "textarea", "svg", "canvas", "object",
          "audio", "video", "iframe"}
OFF_NAMES = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "noscript",
             "template", "svg", "canvas", "object", "menu", "dialog", "head", "fieldset", "audio", "video", *RAW}
OFF_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "promo",
             "banner", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "footer", "header",
             "masthead", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "newsletter",
             "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments",
             "reply", "replies", "disqus", "widget", "toolbar", "pagination", "pager", "copyright", "overlay", "paywall"}
# words that say nothing about what a part holds; a class name names such a part only if all its other words do
PLAIN_WORDS = {"box", "bar", "block", "wrap", "wrapper", "container", "area", "list", "section", "inner", "outer", "slot", "unit", "top",
               "bottom", "left", "right", "main", "site", "page", "global", "links", "buttons", "form", "item", "items", "icon", "icons"}
# elements of the running text, which no class name takes out of a marked main part
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption"}
OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
KEPT = {"html", "body", "main", "article"}
MAIN = {"article", "main"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[a-z0-9]+")


def _attributes(text):
    return {m[1].lower(): references.unescape((m[2] or "").strip("\"'")).lower() for m in _ATTRIBUTE.finditer(text)} if text else {}


def _named_off(names):
    """Whether one of the class names or ids says that a part is not the article: "cookie-notice", but not "social-science"."""
    for name in names.split():
        telling = [w for w in _NAME.findall(name) if w not in PLAIN_WORDS and not w.isdigit()]
        if telling and all(w in OFF_WORDS for w in telling):
            return True
    return False


def _off(name, attributes, in_main):
    if name in OFF_NAMES:
        return True
    if name in KEPT or not attributes:
        return False
    if (attributes.get("role") in OFF_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "")):
        return True
    if name in INLINE or in_main and name in RUNNING:  # part of a sentence, or running text
        return False
    return _named_off(attributes.get("class", "") + " " + attributes.get("id", ""))


def events(page: str):
    """The page as a list of (kind, text, off, main): kind is "text" or the class of a tag, off says that the place is
    inside an element that is left out, main that it is inside a marked main part."""
    out, stack, at, end = [], [], 0, len(page)
    off = main = 0

    def pop():
        nonlocal off, main
        _, is_off, is_main = stack.pop()
        off -= is_off
        main -= is_main

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if not m[0].startswith(("<!", "<?")):
                out.append(("text", references.unescape(m[0]), off > 0, main > 0))
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                inside = (off > 0, main > 0)
                pop()
                out.append((f"/{name}", "", *inside))
            else:
                out.append((f"/{name}", "", off > 0, main > 0))
            continue
        raw = m[3] if m[2] else m[6]
        attributes = _attributes(raw)
        if name not in INLINE and stack:  # a block ends an open paragraph, an item the item before
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name == "li":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        first = _NAME.search(attributes.get("class", ""))
        if name not in VOID and not raw.rstrip().endswith("/"):
            state = (name, _off(name, attributes, main > 0), name in MAIN or attributes.get("role") == "main")
            stack.append(state)
            off += state[1]
            main += state[2]
        out.append((f"{name}.{first[0]}" if first else name, "", off > 0, main > 0))
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = close.start() if close else end
    return out


def _tag(kind):
    return kind.lstrip("/").split(".")[0]


def _counts(page):
    """[(class, inside, outside)] of one labelled page, nothing for others."""
    found = events(page)
    if not any(main for _, _, _, main in found):
        return []
    out = {}
    for kind, text, off, main in found:
        n = len(text.split()) if kind == "text" else 1
        if off:
            names = []
        elif kind == "text":
            names = ["word"]
        else:
            edge = _tag(kind) in MAIN
            names = {kind, _tag(kind)}
            main = main and not edge
        for k in names:
            pair = out.setdefault(k, [0, 0])
            pair[not main] += n
    return [(k, *v) for k, v in out.items()]


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights of words (positive) and tags (negative), from at most about `labelled` pages, chosen by hash of page_id."""
    def run(batches):
        for batch in batches:
            rows = [r for page in batch.column(0).to_pylist() for r in _counts(page or "")]
            kind, inside, outside = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(inside, pa.int64()),
                                              pa.array(outside, pa.int64())], ["kind", "inside", "outside"])

    marked = pages.where(F.lower("html").rlike(r"<(article|main)\b|role=.?main"))
    sample = bounded(marked.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")),
                     "page_id", labelled)
    counts = (sample.select("html").mapInArrow(run, "kind string, inside long, outside long")
              .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    out = {}
    for r in counts.collect():  # as many rows as tag classes in the sample
        odds = math.log((r.inside + 0.5) / (r.outside + 0.5))
        out[r.kind] = min(3.0, max(0.5, odds)) if r.kind == "word" else -min(BOUNDARY, max(LEAST, LEAST - 2 * odds))
    return out


def best_run(scores) -> tuple[int, int]:
    """(from, to) of the contiguous run with the largest sum, the first one at ties; empty if no sum is positive."""
    best, start, total, found = 0.0, 0, 0.0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = events(page or "")
    word = weights.get("word", 1.0)
    scores = [(0.0 if kind == "text" else -LEAST) if off else word * len(text.split()) if kind == "text"
              else weights.get(kind, weights.get(_tag(kind), -0.5)) for kind, text, off, _ in found]
    start, end = best_run(scores)
    blocks, block = [], []
    for kind, text, off, _ in found[start:end]:
        if kind == "text":
            if not off:
                block.append(text)
        elif _tag(kind) not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    A null, empty or wordless page has an empty text. page_id and url are passed on, also when null; repeated rows are
    extracted each; other columns do not matter; an empty table gives an empty result. Broken markup is read as far as it goes:
    unclosed elements end with their parent, an end tag without a start is a tag like others.
    """
    def run(batches):
        for batch in batches:
            for sub in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                texts = [main_text(page, weights) for page in sub.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), sub.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
