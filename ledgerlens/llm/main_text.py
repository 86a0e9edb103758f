"""Main text of web pages: the best-scoring contiguous region of words and tags.

Words score by the log odds of their place (enclosing block, link, furniture) and tags cost, both learned from pages
that label their own content (one article, main or articleBody element). One linear scan finds the region of greatest sum; blocks
of page furniture inside it are left out, and those amid the text cost nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import pick, with_columns
from ledgerlens.llm.markup import INLINE, VOID, attributes, tidy, tokens

#: Elements that hold no main text wherever they stand; a header inside the content element does.
FURNITURE = frozenset("nav footer aside button dialog menu head datalist fieldset legend".split())
#: Class, id and role words of page furniture, notices, adverts and reader comments.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banner|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar"
    r"|comments?|comment-?\w*|respond|replies|reply|disqus\w*|discussion|cookies?|consent|gdpr|notice\w*|alert\w*|warning|popup|pop-?over|modal|overlay|newsletter\w*|subscri\w*|signup|login"
    r"|share|sharing|social\w*|related\w*|recommend\w*|widgets?|pagination|pager|skip\w*|complementary|contentinfo|search|toc)(?=$|[\s_-])"
)
LABELS = frozenset(("article", "main"))
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
#: Elements that text is made of, unlike the ones that lay out a page.
FLOW = frozenset("address blockquote caption center dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary details table tbody td tfoot th thead tr ul".split())
#: Weights of places and tags never seen in labelled pages, and bounds of the learned ones.
WORD, LINK_WORD, FURNITURE_WORD, TAG, MOST, LEAST_TAG = 0.5, -0.5, -1.0, 0.2, 3.0, 0.05
#: Class words that begin so speak of the page around an element, not of the element.
ABOUT = ("has-", "with-", "without-", "no-")
#: A form of more words than the rest of the page, and of so many at least, is a page within a form.
PAGE_FORM_WORDS = 50


def parse(page: str | None):
    """(items, number of content elements): an item is ('tag', name, inside, free) or ('block', place, inside, text, furniture, free).

    ``inside`` tells whether it stands within an element that labels content. Names of tags within furniture end in "!",
    so that the lists of menus say nothing about lists in articles. ``free`` furniture stands amid the text: in an element
    that labels content, or between two blocks of text of the parent of the furniture. A class, id or role word does
    not make furniture of an element that holds the page's own content, nor is a form furniture that holds it, or most
    words of the page. Time follows the length of the page, however deep its elements are nested.
    """
    wrappers: frozenset[int] = frozenset()
    while True:
        items, labels, found = _parse(page, wrappers)
        if not found:
            return items, labels
        wrappers |= found


class _Open:
    """An open element. ``marked`` is the chain (length, element, rest) of marked elements around its inside, None if
    it is furniture for another reason; ``article`` is the one it is in, as an index of candidates; ``block`` names the
    nearest element that is not inline, ``at`` is its place on the stack; ``anchor`` is the nearest one that lays out.
    """

    __slots__ = ("name", "owner", "content", "number", "marked", "article", "block", "at", "anchor")

    def __init__(self, name, owner, content, number, marked, article, block, at, anchor):
        self.name, self.owner, self.content, self.number, self.marked = name, owner, content, number, marked
        self.article, self.block, self.at, self.anchor = article, block, at, anchor


_NONE_MARKED = (0, 0, None)
#: The page around all elements.
_ROOT = _Open("", 0, False, 0, _NONE_MARKED, None, "body", -1, 0)


def _chain(marked, found: set[int]) -> set[int]:
    """Add the elements of a chain; one that was added has brought those around it."""
    while marked[0] and marked[1] not in found:
        found.add(marked[1])
        marked = marked[2]
    return found


def _wrappers(candidates: list[list], rest: int, forms: dict[int, int]) -> set[int]:
    """The marked elements around the page's own content; ``rest`` words stand outside all furniture.

    Those around main and articleBody are. Articles can be comments and teasers too: if all of them have marked elements
    around them, it is the one with the fewest, then the longest, unless the rest of the page has more words. Without
    such a label it is a form of more words (``forms``) than all outside of furniture.
    """
    found: set[int] = set()
    for strong, _, marked, _ in candidates:
        if strong:
            _chain(marked, found)
    articles = [(marked[0], -n, marked) for _, article, marked, n in candidates if article]
    if not found and articles:
        around, n, marked = min(articles, key=lambda x: x[:2])
        if around and -n >= rest:
            return _chain(marked, found)
    if not candidates:
        return {form for form, n in forms.items() if n > max(rest, PAGE_FORM_WORDS - 1)}
    return found


def _parse(page: str | None, wrappers: frozenset[int]):
    """Items and number of content elements, and the elements to be taken for wrappers in another pass."""
    stack: list[_Open] = [_ROOT]
    names: Counter = Counter()  # open elements by name
    numbers: set[int] = {0}  # and by number
    candidates: list[list] = []  # labels: is it content for certain, is it an article or its body, marked elements around, words of an article
    forms: dict[int, int] = {}  # words of the forms that are furniture
    rest = 0
    items, owners, now, place, labels, opened = [], [], [], "", 0, 0
    amid: dict[int, bool] = {}  # furniture elements: do they stand amid the text
    waiting: list[tuple[int, int, int]] = []  # furniture elements after a block of text of their parent; the parent, its anchor
    home = (-1, -1)  # element and anchor of the last block of text: it is part of the elements between them

    def part_of(parent: int, anchor: int) -> bool:
        # What was opened after an element that is still open is inside of it.
        return home[1] == anchor and home[0] >= parent and parent in numbers

    def end_block():
        nonlocal now, home, waiting, rest
        text = tidy(now)
        if text:
            last, n = stack[-1], text.count(" ") + 1
            items.append(("block", place, last.content, text, last.owner > 0))
            owners.append(last.owner)
            if last.article is not None:
                candidates[last.article][3] += n
            if last.owner in forms:
                forms[last.owner] += n
            if not last.owner:
                rest += n
                home = (last.number, last.anchor)
                amid.update((f, True) for f, parent, anchor in waiting if part_of(parent, anchor))
                waiting = []
        now = []

    def pop() -> _Open:
        last = stack.pop()
        names[last.name] -= 1
        numbers.discard(last.number)
        return last

    for kind, name, inner in tokens(page or ""):
        if kind == "text":
            if not now:
                block = stack[-1].block
                place = (block if block in BLOCKS else "other") + ("/a" if names["a"] else "")
            now.append(name)
            continue
        if kind == "dead" or name == "br":
            now.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            end_block()
        last = stack[-1]
        items.append(("tag", (name if name in BLOCKS or inline else "other") + ("!" if last.owner else ""), last.content))
        owners.append(last.owner)
        if kind == "close":
            if names[name]:
                while (gone := pop()).name != name:
                    pass
                owners[-1] = gone.owner
            continue
        if name in VOID or inner.rstrip().endswith("/"):
            continue
        if not inline:
            # An open paragraph ends where a block begins, with the inline elements left open in it.
            at = last.at
            if at >= 0 and (stack[at].name == "p" or stack[at].name == name == "li"):
                while len(stack) > at:
                    pop()
            elif last.name in INLINE and last.name != "a":
                while stack[-1].name in INLINE:
                    pop()
            last = stack[-1]
        owner, content, marked, article = last.owner, last.content, last.marked, last.article
        marks = attributes(inner)
        # An article within an article is a reader's comment or a teaser, as HTML itself says; a form within a form is none.
        nested = name == "article" and names["article"] > 0
        form = name == "form" and not names["form"]
        label = (name in LABELS and not nested) or marks.get("itemprop") == "articlebody" or marks.get("role") == "main"
        words = " ".join((marks.get("class", ""), marks.get("id", ""), marks.get("role", "")))
        words = " ".join(w for w in words.split() if not w.startswith(ABOUT))
        hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
        opened += 1
        fixed = nested or name in FURNITURE or (name == "header" and not content) or hidden
        mark = not label and name not in ("html", "body") and opened not in wrappers and (form or bool(MARKS.search(words)))
        if fixed:
            marked = None
        elif marked is not None and mark:
            marked = (marked[0] + 1, opened, marked)
        elif marked is not None and label:
            body = marks.get("itemprop") == "articlebody"
            strong = name != "article" or body or marks.get("role") == "main"
            if not strong:
                article = len(candidates)
            candidates.append([strong, body or not strong, marked, 0])
        if not owner and (fixed or mark):
            owner = opened
            owners[-1] = opened
            amid[owner] = content
            if form and not fixed:
                forms[owner] = 0
            if part_of(last.number, last.anchor):
                waiting.append((owner, last.number, last.anchor))
        if label and not owner and not content:
            labels += 1
        lays_out = name not in FLOW and not inline
        stack.append(_Open(
            name, owner, content or (label and not owner), opened, marked, article, last.block if inline else name,
            last.at if inline else len(stack), opened if lays_out else last.anchor,
        ))
        names[name] += 1
        numbers.add(opened)
    end_block()
    return [(*item, owner > 0 and amid[owner]) for item, owner in zip(items, owners)], labels, _wrappers(candidates, rest, forms)


def _features(items):
    for item in items:
        if item[0] == "tag":
            yield f"<{item[1]}>", item[2], 1
        else:
            yield item[1] + ("!" if item[4] else ""), item[2], item[3].count(" ") + 1


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights by place and tag, from all pages with exactly one content element; the names are a closed set."""

    def count(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(html_col).to_pylist():
                items, labels = parse(page)
                if labels == 1:
                    for feature, within, n in _features(items):
                        (inside if within else outside)[feature] += n
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["feature", "n_in", "n_out"])

    counted = pick(pages, html_col).mapInArrow(count, "feature string, n_in long, n_out long").groupBy("feature").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    weights = {}
    for r in counted.collect():
        # Furniture is never put out, so it gains nothing.
        odds = max(-MOST, min(0.0 if r["feature"].endswith("!") else MOST, math.log((r["n_in"] + 1) / (r["n_out"] + 1))))
        tag = r["feature"].startswith("<")
        weights[r["feature"]] = min(-LEAST_TAG, odds) if tag else odds
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    items, _ = parse(page)
    best, best_range, total, start = 0.0, None, 0.0, 0
    for i, (feature, _, n) in enumerate(_features(items)):
        if feature[0] == "<":
            default = -TAG
        elif feature[-1] == "!":
            default = FURNITURE_WORD
        else:
            default = LINK_WORD if feature.endswith("/a") and feature != "p/a" else WORD
        if items[i][-1]:  # furniture amid the text
            continue
        if total <= 0:
            total, start = 0.0, i
        total += n * weights.get(feature, default)
        if total > best:
            best, best_range = total, (start, i)
    if best_range is None:
        return ""
    region = items[best_range[0] : best_range[1] + 1]
    return " ".join(x[3] for x in region if x[0] == "block" and not x[4])


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the html of each page by ``text``, its main text ('' if it has none).

    Null and empty pages give ''. Repeated rows get a row each. Without labelled pages the fixed weights hold. Other
    columns stay, but for one that is named ``text`` itself. Pages are read twice, once to learn; the weights are one
    number for each tag and place name.
    """
    held = pages.sparkSession.sparkContext.broadcast(learn(pages, html_col))
    pages = pages.select(*[c for c in pages.columns if c == html_col or c.lower() != "text"])
    kept = [f for f in pages.schema.fields if f.name != html_col]

    def scan(batches):
        for batch in batches:
            texts = [extract(x, held.value) for x in batch.column(html_col).to_pylist()]
            yield with_columns(batch, (html_col,), text=pa.array(texts, pa.string()))

    return pages.mapInArrow(scan, T.StructType([*kept, T.StructField("text", T.StringType())]))
