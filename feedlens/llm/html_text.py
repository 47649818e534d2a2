"""Main text of HTML pages as the best-scoring contiguous run of words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML by how they act on the text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: Their content is never text of the page.
RAW = frozenset("script style template textarea noscript iframe svg math object audio video canvas noframes xmp".split())
#: Elements that are not part of an article wherever they stand.
ASIDE = frozenset("nav aside footer form menu dialog select button fieldset head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, role or id that mark an element which isn't part of an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie "
    "cookies copyright dialog disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification paywall popup popular "
    "promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget complementary alert".split()
)
#: Words that may stand beside one of them in a name; with any other word a name tells nothing (``has-sidebar``, ``related-work``).
HINT_PARTS = frozenset(
    "active area articles bar block body bottom box btn button buttons col column container content desktop dfp entry fixed global google group "
    "header holder icon icons id inline inner item items js label left link links list lists main message mobile module notices outer page panel "
    "placeholder post posts primary region right row secondary section site slot sticky stories text thread title top unit wp wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A word under a hinting id weighs this on pages without an article element: the region ends there unless more follows.
DOUBTFUL = -0.1

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+>|</?[a-zA-Z][^>]*(?:>|\Z)"
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_HINT_ATTRIBUTE = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class Run:
    """A tag or a stretch of text in page order."""

    feature: tuple[str, str]  # "tag" and a name, or "word" and a kind of place
    words: int  # 0 for a tag
    text: str  # raw text, or empty
    breaks: bool  # a block begins or ends here
    element: int  # number of the article element around it, or -1
    aside: bool
    hint: int = -1  # number of the innermost hinting element around it, or -1
    doubtful: bool = False  # an id around it hints


@dataclass
class Hint:
    """An element whose class, role or id hints that it isn't part of an article."""

    parent: int  # the hinting element around it, or -1
    element: int  # the article element around it, or -1
    sure: bool  # by class or role; an id may be made from a title and only lowers scores
    words: int = 0


@dataclass
class Page:
    runs: list[Run] = field(default_factory=list)
    article: int = -1  # number of the main article element, or -1

    def place(self, run: Run) -> str:
        """``in`` or ``out`` of the main article; ``none`` where a page has no article element."""
        return "none" if self.article < 0 else "in" if run.element == self.article else "out"


def hinting(value: str) -> bool:
    """Whether one of the names in a class, role or id is made of hints and the words that go with them."""
    for token in value.split():
        words = [w.lower() for w in _HINT_WORD.findall(token)]
        if any(w in HINTS for w in words) and all(w in HINTS or w in HINT_PARTS or len(w) == 1 for w in words):
            return True
    return False


def hinted(tag: str, name: str, within: bool) -> str:
    """``sure`` where class or role name something that isn't part of an article, ``id`` where the id alone does, or empty.

    ``within`` an article or main element, sections and paragraphs have ids made from their titles: there only
    those of a ``div`` that isn't marked as a section count.
    """
    if name in ("html", "body", "main") or name in HEADINGS:
        return ""
    values: dict[str, str] = {}
    for match in _HINT_ATTRIBUTE.finditer(tag):
        values.setdefault(match.group(1).lower(), next(v for v in match.groups()[1:] if v is not None))
    if hinting(values.get("class", "")) or hinting(values.get("role", "")):
        return "sure"
    if within and (name != "div" or "section" in values.get("class", "").lower().split()):
        return ""
    return "id" if hinting(values.get("id", "")) else ""


def parse(source: str) -> Page:
    """Tags and texts of a page with their surroundings, in one pass that tolerates unclosed elements."""
    page, pos = Page(), 0
    # open elements that matter: (name, aside from here on, article number from here on, in a link, hint from here on)
    stack: list[tuple[str, bool, int, bool, int]] = [("", False, -1, False, -1)]
    articles: list[tuple[str, int, int]] = []  # name, number of the main element around it or -1, hint
    hints: list[Hint] = []
    runs = page.runs

    def add_text(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        count = len(text.split())
        _, aside, number, link, hint = stack[-1]
        runs.append(Run(("word", "link" if link else "plain"), count, text, False, number, aside, hint))

    while pos < len(source):
        match = _TOKEN.search(source, pos)
        if match is None:
            add_text(source[pos:])
            break
        if match.start() > pos:
            add_text(source[pos : match.start()])
        tag, pos = match.group(), match.end()
        found = _NAME.match(tag)
        if found is None:  # comment, doctype or processing instruction
            continue
        name, closing = found.group(1).lower(), tag[1] == "/"
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                end = _RAW_END[name].search(source, pos)
                pos = end.end() if end else len(source)
            continue
        block = name in BLOCKS
        if closing:
            if name != "br" and any(e[0] == name for e in stack[1:]):
                while stack.pop()[0] != name:
                    pass
        else:
            if block and name != "li":
                _close(stack, ("p",), BLOCKS - {"p"})
            if name == "li":
                _close(stack, ("li", "p"), frozenset(("ul", "ol", "menu")))
        _, aside, number, link, hint = stack[-1]
        if not closing and name not in VOID and not tag.endswith("/>"):
            outer, around = number, hint
            kind = hinted(tag, name, outer >= 0)
            if kind:
                hints.append(Hint(hint, outer, kind == "sure"))
                hint = len(hints) - 1
            if name in ("article", "main") and not aside:
                own = outer >= 0 and (name == "main" or articles[outer][0] == "article")  # an article within an article is a part of it
                articles.append((name, outer if outer >= 0 and not own else -1, hint))
                number = outer if own else len(articles) - 1
            page_header = name == "header" and number < 0
            aside = aside or name in ASIDE or page_header
            if block or name == "a" or aside != stack[-1][1] or hint != around:
                stack.append((name, aside, number, link or name == "a", hint))
        known = name if block or name in INLINE else "other"
        runs.append(Run(("tag", known), 0, "", block, number, aside, hint))
    _settle(page, articles, hints)
    return page


def _close(stack: list, names: tuple[str, ...], barrier: frozenset[str]) -> None:
    """End an open ``p`` or ``li`` that the next start tag ends by itself."""
    for at in range(len(stack) - 1, 0, -1):
        if stack[at][0] in names:
            del stack[at:]
            return
        if stack[at][0] in barrier:
            return


def _settle(page: Page, articles: list[tuple[str, int, int]], hints: list[Hint]) -> None:
    """Choose the main article element, decide which hints hold and mark the runs accordingly.

    A hint holds if its element has less than half of the page's words and the main article isn't in it.
    """
    total = 0
    for run in page.runs:
        if run.words and not run.aside:
            total += run.words
            if run.hint >= 0:
                hints[run.hint].words += run.words
    for hint in reversed(hints):  # an element comes after those around it
        if hint.parent >= 0:
            hints[hint.parent].words += hint.words
    holds = [2 * h.words < total or not h.words for h in hints]

    def under(sure: bool) -> list[bool]:
        found: list[bool] = []
        for h, hold in zip(hints, holds, strict=True):
            found.append((hold and h.sure == sure) or (h.parent >= 0 and found[h.parent]))
        return [*found, False]  # the last for -1

    left = under(True)
    left_within: list[bool] = []  # by a hint within the same article element
    for h, hold in zip(hints, holds, strict=True):
        up = h.parent >= 0 and hints[h.parent].element == h.element and left_within[h.parent]
        left_within.append((hold and h.sure) or up)
    words_in: Counter[int] = Counter()
    plain = 0
    for run in page.runs:
        if run.words and not run.aside:
            plain += 0 if left[run.hint] else run.words
            if run.hint < 0 or hints[run.hint].element != run.element or not left_within[run.hint]:
                words_in[run.element] += run.words
    page.article = _choose_article(articles, words_in, left, plain)
    chosen = page.article
    if chosen >= 0:
        at = articles[chosen][2]
        while at >= 0:
            holds[at], at = False, hints[at].parent
    sure, doubtful = under(True), under(False)
    for run in page.runs:
        run.aside = run.aside or sure[run.hint]
        run.doubtful = doubtful[run.hint] and not run.aside
        if run.element >= 0 and chosen >= 0 and articles[run.element][1] == chosen:
            run.element = chosen  # articles within the main element are parts of it
        if run.aside and run.feature[0] == "word":
            run.feature = ("word", "aside")


def _choose_article(articles: list[tuple[str, int, int]], words_in: Counter[int], left: list[bool], plain: int) -> int:
    """The article or main element with the most words of its own, an article among equals; -1 without one.

    An element that is left out by a hint counts if it has more words than all that isn't left out.
    """
    some = [n for n, (_, _, hint) in enumerate(articles) if words_in[n] and (not left[hint] or words_in[n] > plain)]
    return max(some, key=lambda n: (words_in[n], articles[n][0] == "article", -n), default=-1)


# ---- weights ----

#: Weights of what no labelled page shows: (words, tags) by place.
UNSEEN = {"in": (1.0, -0.02), "out": (-0.5, -0.5), "none": (0.6, -0.3)}
#: A tag costs this at most and at least.
TAG_COST = (-0.6, -0.02)

Weights = dict[tuple[str, str, str], float]


def label_counts(page: Page) -> Counter[tuple[str, str, str, bool]]:
    """Tokens of a labelled page, one with an article element, by place, feature and whether they are main text.

    Each counts twice: where it stands, and as it would look on a page without an article element.
    """
    counts: Counter[tuple[str, str, str, bool]] = Counter()
    if page.article < 0:
        return counts
    for run in page.runs:
        main = run.element == page.article and not run.aside
        if run.doubtful:
            continue
        for place in (page.place(run), "none"):
            counts[(place, *run.feature, main)] += run.words or run.feature[0] == "tag"
    return counts


def weights_of(counts: dict[tuple[str, str, str, bool], int]) -> Weights:
    """Words weigh up to 1 where they are main text as a rule, and less than 0 where they aren't; tags always cost."""
    out: Weights = {}
    for key in {k[:3] for k in counts}:
        yes, no = counts.get((*key, True), 0), counts.get((*key, False), 0)
        share = (yes + 1) / (yes + no + 2)
        word = key[1] == "word"
        out[key] = 2 * share - 1 if word else min(TAG_COST[1], max(TAG_COST[0], share - 1))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the highest positive sum, the first and shortest among equals."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best + 1e-9:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(source: str, weights: Weights) -> str:
    """Blocks of the best region, white space folded, one per line; parts that are marked as aside are left out."""
    page = parse(source)
    scores = []
    for run in page.runs:
        place = page.place(run)
        word = run.feature[0] == "word"
        unseen = min(0.0, UNSEEN[place][0]) if run.feature == ("word", "aside") else UNSEEN[place][0 if word else 1]
        weight = weights.get((place, *run.feature), unseen)
        if run.aside and place != "out" and run.element >= 0:
            weight = 0.0 if word else TAG_COST[1]  # left out of the text anyhow: no reason to end the region here
        elif run.doubtful and place != "out":
            weight = (0.0 if place == "in" else DOUBTFUL) if word else TAG_COST[1]  # kept where more of the text follows
        scores.append(weight * run.words if word else weight)
    begin, end = best_region(scores)
    blocks, parts = [], []
    for run in page.runs[begin:end]:
        if run.breaks:
            blocks.append("".join(parts))
            parts = []
        elif run.feature == ("tag", "br"):
            parts.append(" ")
        elif run.text and not run.aside:
            parts.append(run.text)
    blocks.append("".join(parts))
    folded = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in folded if b)


# ---- tables ----


def fit_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages: those with an article element. Counts are summed per task and only they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str, str, bool]] = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                total.update(label_counts(parse(source)))
        if total:
            place, kind, name, main = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(kind), pa.array(name), pa.array(main), pa.array(total.values(), pa.int64())], names=["place", "kind", "name", "main", "n"]
            )

    labelled = pages.select(F.col(html_col).cast("string").alias("html")).where(F.lower("html").contains("<article"))
    counts = labelled.mapInArrow(count, "place string, kind string, name string, main boolean, n bigint")
    summed = counts.groupBy("place", "kind", "name", "main").agg(F.sum("n").alias("n")).collect()  # at most 3 x known names x 2
    return weights_of({(r["place"], r["kind"], r["name"], r["main"]): r["n"] for r in summed})


def extract_main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``(id, keep..., text, n_chars)``, one row per input row, in one narrow pass over whole pages.

    ``text`` holds the main text's blocks in page order, joined by line feeds, with character
    references decoded and white space folded; ``n_chars`` its code points. A null or empty page,
    or one without main text, has an empty text. A null id stays null, repeated rows get equal
    texts, very long pages cost one linear pass and columns that aren't kept are ignored.
    """
    kinds = dict(pages.dtypes)
    kept = [id_col, *(keep or [])]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s, weights) if s else "" for s in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"]
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", text string, n_chars bigint"
    return pages.select(*[F.col(c) for c in kept], F.col(html_col).cast("string").alias("_html")).mapInArrow(extract, schema)
