"""Main text of web pages by equivalence classes of tokens, a nested template and its slots.

Pages of one host are dealt with together, in blocks of about GROUP pages. Tokens are start tags, end tags and text
blocks, told apart by their path in the page. Tokens with the same occurrence vector (how often they occur on each
page of the block) form an equivalence class. A class that is on enough pages is valid if its tokens keep their order
in every repetition on every page, and if its repetitions nest in, or lie apart from, those of the other valid
classes, everywhere. Valid classes, nested, are the template; what lies between two neighbouring tokens of a class is
a slot. Text blocks that are tokens of the template are the site's own words; all other text fills slots.

Slots are chosen by where their text lies over all pages of the block: in the main region, which is `article` or
`main` where pages have one, else found from the template: from the root down, into an element of the template that
holds most of the running text in slots, as long as there is one. A slot that mostly lies in the main region is the
article's on every page; other slots never are. Parts that are marked as menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments are never taken. A host's only page has no template: it is one slot.

A host with more than GROUP pages or GROUP_BYTES of markup is cut into salted blocks. Which hosts are is read from
counts over all pages; at most 2**20 hosts can be above the threshold that applies, so that table is sent to all
tasks. Blocks of a host that is below that threshold are cut in the task, by the same hash.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Hashable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP, GROUP_BYTES = 128, 16 << 20
MOST_HOSTS = 1 << 20
#: A class is on so many pages of a block, and on this share of them.
CLASS_PAGES, CLASS_SHARE = 2, 0.2
#: A text block is the template's if it is on this share of the pages that have its element; in a main region it must
#: be on so many pages as well, as few pages may have paragraphs in common that are the articles' own.
SHARE, MAIN_PAGES = 0.8, 5
#: Classes of so many tokens that are once on a page tell layouts apart.
LAYOUT_TOKENS = 6
#: The main region goes on in an element that holds this share of the running text.
HOLDS = 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
#: Words in class, id and role that mark parts of a page which aren't its article.
MARKS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottombar contentinfo sidebar aside complementary rail ad ads adv advert adverts advertisement "
    "advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup signin login share sharing social related recommended recommendations comment comments commentlist discussion replies reply respond disqus "
    "breadcrumb breadcrumbs widget widgets toolbar pagination pager search skip copyright legal form hidden".split()
)
#: Words that go with a mark in the name of a part of an article which isn't its own text.
BESIDE = frozenset("bar bars box block button buttons container content form icon icons inner item items link links list module outer panel post posts row section top bottom left right unit wrap wrapper".split())
#: Marks that a main region inside does not lift.
FIRM = frozenset("comment comments commentlist discussion replies reply respond disqus related recommended recommendations footer nav menu navigation aside sidebar hidden".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "thead": frozenset(["tr", "td", "th"]), "tbody": frozenset(["tr", "td", "th", "thead"]),
}
FENCES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])} | {k: frozenset(["table"]) for k in ("tr", "td", "th", "thead", "tbody")}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
#: Elements that a main region may be, and headings that go with it.
HOLDERS = frozenset("html body div section main article center table tbody tr td span".split())
HEADINGS = frozenset("h1 h2".split())


@dataclass
class Block:
    text: str
    path: int
    at: int  # place among the page's tokens
    outside: bool  # in a part that isn't the article's
    main: int  # 2: in article, 1: in main, 0: neither
    plain: int  # characters that are not in links


class Names:
    """Numbers of paths (0: the page) and tokens of a block of pages; a path is its parent and its own name."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.parents, self.tags = [0], [""]
        self.tokens: dict[tuple[str, int, str], int] = {}

    def path(self, parent: int, tag: str, name: str) -> int:
        key = (parent, name)
        got = self.paths.get(key)
        if got is None:
            got = self.paths[key] = len(self.parents)
            self.parents.append(parent)
            self.tags.append(tag)
        return got

    def token(self, kind: str, path: int, text: str = "") -> int:
        return self.tokens.setdefault((kind, path, text), len(self.tokens))


@dataclass
class _Open:
    tag: str
    path: int
    outside: str  # why it is outside the article ('' if it isn't)
    main: int
    block: _Open | None = None  # the innermost element around that is not inline; None: itself
    link: bool = False


def _mark(values: list[str], tag: str, inside: int, main: int) -> str:
    """The mark in class, id and role values, if there is one that counts here."""
    for value in values:
        for name in value.lower().split():
            words = _WORDS.findall(name)
            if main and not inside:  # in an article only names that say nothing else
                found = [w for w in words if w in MARKS]
                if found and all(w in MARKS or w in BESIDE for w in words):
                    return found[0]
            else:
                found = [w for w in words if w in (FIRM if inside else MARKS)]
                if found:
                    return found[0]
    return ""


def parse(page: str | None, names: Names) -> tuple[list[int], list[Block]]:
    """Tokens of a page, and its blocks of text, in order."""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack: list[_Open] = [_Open("", 0, "", 0)]
    opened: Counter[str] = Counter()
    said: list[str] = []
    plain = 0
    where = stack[-1]

    def flush() -> None:
        nonlocal plain
        text = " ".join("".join(said).split()) if said else ""
        said.clear()
        if text:
            blocks.append(Block(text, where.path, len(tokens), bool(where.outside), where.main, plain))
            tokens.append(names.token("text", where.path, text))
        plain = 0

    def close(k: int) -> None:
        nonlocal where
        if any(x.block is None for x in stack[k:]):
            flush()
        for x in reversed(stack[k:]):
            opened[x.tag] -= 1
            tokens.append(names.token("end", x.path))
        del stack[k:]
        if not said:
            where = block_of(stack[-1])

    def block_of(x: _Open) -> _Open:
        return x.block or x

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                top = stack[-1]
                if not said:
                    where = block_of(top)
                    if top.outside and not where.outside:
                        where = _Open(where.tag, where.path, top.outside, where.main)
                elif bool(top.outside) != bool(where.outside):  # an inline part that is marked, or its end
                    flush()
                    x = block_of(top)
                    where = _Open(x.tag, x.path, top.outside, x.main)
                text = html.unescape(m[0])
                said.append(text)
                plain += 0 if top.link else len(text)
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        close(k)
                        break
                    if name == "p" and stack[k].block is None:
                        break
            continue
        if name == "br":
            said.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name not in INLINE and name in ("title", "textarea"):
                flush()
            continue
        if name not in INLINE:
            flush()
            if opened["p"]:
                for k in range(len(stack) - 1, 0, -1):  # a block ends a paragraph
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].block is None:
                        break
        ends, fence = CLOSED_BY.get(name), FENCES.get(name, frozenset())
        if ends and any(opened[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in fence:
                    break
                if stack[k].tag in ends:
                    close(k)
                    break
        top = stack[-1]
        outside, main = top.outside, top.main
        attributes = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(m[3] or m[6] or "")} if (m[3] or m[6]) else {}
        said_names = [attributes[k] for k in ("class", "id", "role") if attributes.get(k)]
        words = _WORDS.findall(" ".join(said_names).lower())
        path = names.path(top.path, name, name + ("." + ".".join(words) if words else ""))
        role = attributes.get("role", "")
        inside = 2 if name == "article" else 1 if name == "main" or role == "main" else 0
        if inside and not main and outside and outside not in FIRM:
            outside = ""
        if not outside and name not in ("html", "body"):
            if name in OUTSIDE and not (name == "header" and main):
                outside = name
            elif "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
                outside = "hidden"
            else:
                outside = _mark(said_names, name, inside, main)
        tokens.append(names.token("start", path))
        if name not in VOID:
            stack.append(_Open(name, path, outside, max(main, inside), block_of(top) if name in INLINE else None, top.link or name == "a"))
            opened[name] += 1
    flush()
    close(1)
    return tokens, blocks


@dataclass
class Class:
    """A valid equivalence class: its tokens in order, and where each repetition lies on each page."""

    tokens: list
    rows: dict[int, list[list[int]]]  # by page: places of the tokens, a list for each repetition


class Template:
    """Valid classes of pages, each a list of tokens in page order, and the slots between their tokens."""

    def __init__(self, pages: list[list[Hashable]]) -> None:
        n = len(pages)
        self.classes: list[Class] = []
        #: Innermost repetition at each place of each page: number of the class and of the row, or -1.
        self.owner = [np.full(len(p), -1, np.int64) for p in pages]
        self.spans: list[tuple[int, int, int]] = []  # class, page, repetition
        if n < 2:
            return
        spots: dict[Hashable, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, tokens in enumerate(pages):
            for at, t in enumerate(tokens):
                spots[t][i].append(at)
        least = max(CLASS_PAGES, CLASS_SHARE * n)
        classes: dict[tuple, list[Hashable]] = defaultdict(list)
        for t, by in spots.items():
            if len(by) >= least:
                classes[tuple((i, len(x)) for i, x in by.items())].append(t)
        # On more pages, of more tokens, less often repeated first; of equals the one that begins first.
        def rank(x):
            vector, tokens = x
            page = vector[0][0]
            return -len(vector), -len(tokens), sum(c for _, c in vector), page, min(spots[t][page][0] for t in tokens)

        for vector, tokens in sorted(classes.items(), key=rank):
            page = vector[0][0]
            tokens.sort(key=lambda t: spots[t][page][0])  # noqa: B023
            rows = self._rows(tokens, vector, spots)
            if rows is None and all(c == 1 for _, c in vector):
                tokens = self._in_order(tokens, vector, spots)
                rows = self._rows(tokens, vector, spots)
            if rows is not None and self._fits(rows):
                self._accept(tokens, rows)

    @staticmethod
    def _rows(tokens, vector, spots) -> dict[int, list[list[int]]] | None:
        """Places of the repetitions, if the tokens keep their order everywhere."""
        out = {}
        for i, _ in vector:
            at = np.array([spots[t][i] for t in tokens]).T
            flat = at.ravel()
            if (flat[1:] <= flat[:-1]).any():
                return None
            out[i] = at.tolist()
        return out

    @staticmethod
    def _in_order(tokens, vector, spots) -> list:
        """Of tokens that are once on each page, those in the order that most pages have."""
        orders = Counter(tuple(sorted(tokens, key=lambda t: spots[t][i][0])) for i, _ in vector)  # noqa: B023
        most = max(orders.values())
        first = {t: k for k, t in enumerate(tokens)}
        order = min((o for o, c in orders.items() if c == most), key=lambda o: [first[t] for t in o])
        place, moved = {t: k for k, t in enumerate(order)}, set()
        for other in orders:
            low = -1
            for t in other:
                if place[t] < low:
                    moved.add(t)
                low = max(low, place[t])
        return [t for t in order if t not in moved] or list(order[:1])

    def _fits(self, rows) -> bool:
        """Whether no repetition crosses one that is accepted: both its ends lie in the same innermost one."""
        return all(self.owner[i][row[0]] == self.owner[i][row[-1]] for i, each in rows.items() for row in each)

    def _accept(self, tokens, rows) -> None:
        number = len(self.classes)
        self.classes.append(Class(tokens, rows))
        for i, each in rows.items():
            owner = self.owner[i]
            for k, row in enumerate(each):
                part = owner[row[0] : row[-1] + 1]
                part[part == owner[row[0]]] = len(self.spans)
                self.spans.append((number, i, k))

    def tokens(self) -> set:
        return {t for c in self.classes for t in c.tokens}

    def slot(self, page: int, at: int) -> tuple[int, int]:
        """The slot around a place of a page: number of the class (-1: none), and of the gap between its tokens."""
        own = int(self.owner[page][at])
        if own < 0:
            return -1, 0
        number, i, k = self.spans[own]
        return number, int(np.searchsorted(self.classes[number].rows[i][k], at))


def _region(names: Names, weight: dict[int, int], descends) -> np.ndarray:
    """Flags of the paths in the main region: the deepest holder that has most of the weight at each step."""
    n = len(names.parents)
    total = np.zeros(n, np.int64)
    for p, w in weight.items():
        total[p] += w
    children: dict[int, list[int]] = defaultdict(list)
    for p in range(n - 1, 0, -1):  # children have higher numbers than their parents
        total[names.parents[p]] += total[p]
        children[names.parents[p]].append(p)
    at = 0
    while total[at]:
        best = max((p for p in children[at] if names.tags[p] in HOLDERS and descends(p)), key=lambda p: (total[p], -p), default=0)
        if not best or total[best] < HOLDS * total[at]:
            break
        at = best
    inside = np.zeros(n, bool)
    inside[at] = True
    for p in range(at + 1, n):
        inside[p] = inside[names.parents[p]]
    return inside


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of a block of pages of one host. Equal pages count as one: they do not tell what varies."""
    distinct = list(dict.fromkeys(p or "" for p in pages))
    if len(distinct) < len(pages):
        texts = dict(zip(distinct, extract(distinct)))
        return [texts[p or ""] for p in pages]
    names = Names()
    parsed = [parse(p, names) for p in pages]
    frame = Template([t for t, _ in parsed])
    fixed, once = set(), set()
    for c in frame.classes:
        fixed.update(c.tokens)
        if all(len(each) == 1 for each in c.rows.values()):
            once.update(c.tokens)
    # Text blocks of the template, by the share of the pages with their element that have them.
    has, of = Counter(), Counter()
    for _, blocks in parsed:
        of.update({b.path for b in blocks})
        has.update({(b.path, b.text) for b in blocks})

    def own_words(b: Block) -> bool:
        n = has[b.path, b.text]
        return names.token("text", b.path, b.text) in fixed and n >= SHARE * of[b.path] and n >= (MAIN_PAGES if b.main else CLASS_PAGES)

    slots = []  # for each page: blocks that are in slots, and their slots
    for i, (_, blocks) in enumerate(parsed):
        free = [b for b in blocks if not b.outside]
        rest = [b for b in free if not own_words(b)]
        if any(b.main for b in free) and not any(b.main for b in rest):
            rest = free  # an article of nothing but common words is an article all the same
        slots.append([(b, frame.slot(i, b.at)) for b in rest])
    # Pages of one layout, those in the same larger classes, have one main region.
    layouts = [[] for _ in pages]
    for number, c in enumerate(frame.classes):
        if len(c.tokens) >= LAYOUT_TOKENS and all(len(each) == 1 for each in c.rows.values()):
            for i in c.rows:
                layouts[i].append(number)
    weights: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for layout, page in zip(map(tuple, layouts), slots):
        for b, _ in page:
            weights[layout][b.path] += b.plain
    regions = {x: _region(names, w, lambda p: names.token("start", p) in once) for x, w in weights.items()} if len(pages) > 1 else {}
    chosen: list[list[bool]] = []
    for i, page in enumerate(slots):
        main = max((b.main for b, _ in page), default=0)
        if main:
            chosen.append([b.main == main for b, _ in page])
            continue
        here = regions.get(tuple(layouts[i]))
        if here is None or not any(here[b.path] for b, _ in page):  # no page beside it, or another layout
            counts = Counter(parsed[i][0])
            only = defaultdict(int)
            for b, _ in page:
                only[b.path] += b.plain
            here = _region(names, only, lambda p: counts[names.token("start", p)] == 1)  # noqa: B023
        mine = [bool(here[b.path]) for b, _ in page]
        if not any(x and names.tags[b.path] in HEADINGS for (b, _), x in zip(page, mine)):
            first = mine.index(True) if any(mine) else 0
            for k in range(first - 1, -1, -1):  # the heading right before it
                if names.tags[page[k][0].path] not in HEADINGS:
                    break
                mine[k] = True
        chosen.append(mine)
    # A slot is the article's, or isn't, by its text on all pages.
    held: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for page, mine in zip(slots, chosen):
        for (b, slot), x in zip(page, mine):
            held[slot][x] += len(b.text)
    out = []
    for page, mine in zip(slots, chosen):
        said = []
        for (b, slot), x in zip(page, mine):
            no, yes = held[slot]
            if slot[0] < 0 or len(pages) == 1:
                take = x
            else:
                take = x and yes >= no or yes >= 9 * no
            if take:
                said.append(b.text)
        out.append("\n".join(said))
    return out


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages(page_id, url, html): one row per input row.

    A null or empty page, or one without an article, gives an empty text. Null urls, and those without a host, are
    one group of their own; repeated rows are each a page; null ids are kept; other columns are ignored; an empty
    table gives an empty result. Broken markup is read as browsers do: open elements end where they must.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    plain = plain.withColumn("host", _host(F.col("url")))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    counts = plain.groupBy("host").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    total, most = plain.agg(F.count("*"), F.sum(size)).first()
    above = (F.col("n") > max(GROUP, total // MOST_HOSTS)) | (F.col("b") > max(GROUP_BYTES, (most or 0) // MOST_HOSTS))
    large = counts.where(above).select("host", F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("b") / GROUP_BYTES)).alias("groups"))
    salted = plain.join(F.broadcast(large), "host", "left")  # at most 2 MOST_HOSTS rows
    salted = salted.withColumn("place", F.xxhash64("page_id", "url", "html"))
    salted = salted.withColumn("salt", F.pmod("place", F.coalesce("groups", F.lit(1))))

    def run(key, table):
        # Blocks go by a hash of the page, never by the order in which pages arrive.
        table = table.sort_by([("place", "ascending"), ("page_id", "ascending")])
        source, out = table["html"].to_pylist(), []
        sizes = np.cumsum([max(len(x or "") / GROUP_BYTES, 1 / GROUP) for x in source])
        cuts = np.searchsorted(sizes, np.linspace(0, sizes[-1], max(round(sizes[-1]), 1) + 1)[1:-1]) if len(source) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(source)]):
            out += extract(source[lo:hi])
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    schema = "page_id long, url string, text string, n_chars long"
    return salted.select("host", "salt", "place", "page_id", "url", "html").groupBy("host", "salt").applyInArrow(run, schema)


def op2_template_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
