"""Main-text extraction with per-host wrappers (operator 9).

Wrapper inference: the pages of a host become token streams (block tags and
text; inline markup is part of the text), nested by their tags.  A wrapper is a
union-free regular expression over such streams: a tag with an expression for
its content, a text slot, an optional or a repeated group.  Inference folds page
after page into the wrapper by aligning the two sequences at every level: equal
tokens merge, differing texts become a slot, a mismatched token becomes an
optional, and adjacent repetitions of one to ``MAX_PERIOD`` siblings become a
repeated group.  Aligning a wrapper with a wrapper is the same operation, so
tasks fold the pages they read, and the partial wrappers of a host are merged in
two rounds (a host's partials are first spread over ``MERGE_GROUPS`` groups): no
task sees all pages of a host, and every page takes part.

Extraction: the wrapper's slots are judged once per host, in layers, one for each
kind of page.  On a page with an article (``article``, ``main`` or their ARIA and
microdata equivalents) content is what lies in it, less what the wrapper tells to
be furniture: texts that never vary and are mostly links (share bars, standing
promotions), and those of a container with a suspect name that never vary or are
mostly links.  For pages without one the next layer is the container that holds most of the varying, unlinked text
outside articles, the one after it the container that holds most of what is then
left, and the last is all that is left.  Slots under boilerplate tags, roles or
names (menus, headers, footers, sidebars, notices, adverts, forms, comments) are
dropped.  A name says so clearly if all its words do, or are words of layout
(``ad-box``); with other words in it (``share-analysis``) it is suspect and the
slots decide.  A ``header`` with a heading inside an article stays.  And outside an article so are texts that never vary over ``MIN_PAGES``
different pages (copies of a page count once).  Each page is then aligned with
its wrapper, and the texts that meet a content slot of the first layer it has
are its blocks.

Edge cases: null or empty html gives an empty text; pages without a host (null
or odd urls) share one wrapper; unclosed and misnested tags follow the usual
implied-end rules, and a page cut off anywhere keeps what it has; repeated pages
are extracted row by row; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, release_memory, without, written

MAX_PERIOD = 3
MERGE_GROUPS = 32
#: Hosts whose partial wrapper a task holds before it passes them on.
HELD_HOSTS = 2000
#: Different pages a host needs before a text that never varies counts as boilerplate.
MIN_PAGES = 3
#: Elements nested deeper than this are read as part of the one around them
#: (their closing tags are matched, and boilerplate among them is dropped).
MAX_DEPTH = 150
#: Pages of one host that a task extracts with one copy of the wrapper, about.
GROUP_PAGES = 20_000
MIN_GROUPS = 16
#: Longest-subsequence table; longer sequences are aligned greedily.
MAX_ALIGN_CELLS = 1_000_000

# Fixed values of HTML: elements by the role they play here.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "button", "option", "optgroup"}
#: An opening tag ends an open sibling of these names, unless one of the scopes lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE_TAGS = frozenset("aside button dialog fieldset footer form header menu nav search select".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer foot bottombar "
    "sidebar sidebars aside rail widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "reply replies respond disqus discussion copyright legal disclaimer toolbar".split()
)
#: Words that say where a container stands or how it is built, not what it holds.
LAYOUT_NAMES = frozenset(
    "a area bar block body bottom box btn button center col column container content cta element fixed float full grid group holder icon "
    "image img inline inner item items large left link links list main mini module outer page panel primary right row secondary section "
    "site slot small sticky title top unit wrap wrapper x".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are one block of a text, never the container of a whole one.
TEXT_BLOCKS = HEADINGS | frozenset("address blockquote caption dd dt figcaption p pre summary".split())
MAIN_TAGS = frozenset(["article", "main"])
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: One attribute: whole name, then its value (in a page that is cut off, to the end).
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_MARKS = frozenset("class id role itemprop hidden".split())
_WORDS = re.compile(r"[a-z]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes) and ('close', name, '')."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        close = html.startswith("</", lt)
        name = _NAME.match(html, lt + 1 + close)
        if name is None:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a bare "<" is text
                yield "text", "<", ""
                at = lt + 1
            continue
        end = html.find(">", name.end())
        while end >= 0 and _open_quote(html, name.end(), end):
            end = html.find(">", end + 1)
        stop = n if end < 0 else end
        low = name.group().lower()
        at = min(stop + 1, n)
        if close:
            yield "close", low, ""
        elif low in RAW and not html.startswith("/", stop - 1):
            found = re.compile(f"</{re.escape(low)}[\\s>]", re.I).search(html, at)
            if found:
                end = html.find(">", found.start())
                at = n if end < 0 else end + 1
            elif low != "head":  # unclosed: the rest is its content
                at = n
        else:
            yield "open", low, html[name.end() : stop]


def _open_quote(html: str, a: int, b: int) -> bool:
    """Whether position ``b`` lies in a quoted attribute value of a tag that began before ``a``."""
    part = html[a:b]
    if '"' not in part and "'" not in part:
        return False
    quote = ""
    before = ""
    for c in part:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and before == "=":
            quote = c
        if not c.isspace():
            before = c
    return bool(quote)


def tag_key(name: str, attributes: str) -> str:
    """Tag name with its class, id, role and itemprop, digits unified."""
    if not attributes.strip():
        return name
    marks = []
    for m in _ATTR.finditer(attributes):
        kind, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if kind not in _MARKS:
            continue
        marks += [f"{kind}={re.sub('[0-9]+', '0', v)}" for v in value.split()] if value else ([kind] if kind == "hidden" else [])
    return " ".join([name, *sorted(set(marks))])


class Node:
    """An element: key and children (nodes, or [text, linked characters])."""

    __slots__ = ("key", "name", "items")

    def __init__(self, key: str, name: str):
        self.key, self.name, self.items = key, name, []


def parse(html: str) -> Node:
    """Block elements as a tree; a run of text and inline markup is one text item."""
    root = Node("", "")
    stack = [root]
    run: list[str] = []
    deep: list[tuple[str, bool]] = []  # open elements below MAX_DEPTH: name, whether it is boilerplate
    linked = link_depth = 0

    def end_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                stack[-1].items.append([text, min(linked, len(text))])
            run.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], scopes: set[str]) -> None:
        """End the innermost open element of ``names``, and all that is open inside it."""
        for k in range(len(deep) - 1, -1, -1):
            if deep[k][0] in names:
                end_run()
                del deep[k:]
                return
            if deep[k][0] in scopes:
                return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                end_run()
                del stack[k:], deep[:]
                return
            if stack[k].name in scopes:
                return

    for kind, value, attributes in tokens(html):
        if kind == "text":
            if any(gone for _, gone in deep):
                continue
            run.append(value)
            if link_depth:
                linked += len(value.strip())
        elif value == "a":
            link_depth = kind == "open"
        elif value == "br":
            run.append(" ")
        elif value not in BLOCKS:
            continue
        elif kind == "close":
            close({value}, {"article", "main", "body"} - {value} if value not in ("html", "body") else set())
        else:
            end_run()
            link_depth = 0
            if value in CLOSES_P:
                close({"p"}, {"button", "td", "th", "li", "table"})
            if value in IMPLIED_END:
                names, scopes = IMPLIED_END[value]
                while any(name in names for name in _above([x.name for x in stack] + [name for name, _ in deep], scopes)):
                    close(names, scopes)
            if value in VOID or value in ("html", "body"):
                continue
            if len(stack) > MAX_DEPTH:
                deep.append((value, is_boilerplate(tag_key(value, attributes))))
                continue
            node = Node(tag_key(value, attributes), value)
            stack[-1].items.append(node)
            stack.append(node)
    end_run()
    return root


def _above(names: list[str], scopes: set[str]) -> Iterator[str]:
    for name in reversed(names):
        if name in scopes:
            return
        yield name


# A wrapper is a list of parts.  A part is a dict: "k" its key (a tag key, "#" for
# text, or "(a|b)" for a repeated group of several siblings), "o" 1 if some page
# lacks it, "r" 1 if it repeats, "c" the parts inside; a text part has "t" (its
# text while it never varied, else null), "d" the least digests of the pages with
# that text (MIN_PAGES at most), "s" characters and "l" linked characters over all
# pages.


def collapse(items: list) -> list[tuple[str, list[list]]]:
    """(key, occurrences) of a sequence, adjacent repetitions gathered."""
    keys = [x.key if isinstance(x, Node) else "#" for x in items]
    out: list[tuple[str, list[list]]] = []
    i, n = 0, len(items)
    while i < n:
        best, times = 1, 1
        for p in range(1, MAX_PERIOD + 1):
            k = 1
            while i + (k + 1) * p <= n and keys[i + k * p : i + (k + 1) * p] == keys[i : i + p]:
                k += 1
            if k > 1 and k * p > best * times:
                best, times = p, k
        key = keys[i] if best == 1 else "(" + "|".join(keys[i : i + best]) + ")"
        out.append((key, [items[i + j * best : i + (j + 1) * best] for j in range(times)]))
        i += best * times
    return out


def page_digest(items: list) -> str:
    """Equal for pages of equal texts."""
    found = hashlib.blake2b(digest_size=8)

    def add(xs: list) -> None:
        for x in xs:
            if isinstance(x, Node):
                add(x.items)
            else:
                found.update(x[0].encode("utf-8", "surrogatepass") + b"\n")

    add(items)
    return found.hexdigest()


def page_wrapper(items: list, digest: str | None = None) -> list[dict]:
    """The wrapper of one page's sequence."""
    if digest is None:
        digest = page_digest(items)
    parts = []
    for key, times in collapse(items):
        part: dict = {"k": key, "o": 0, "r": int(len(times) > 1)}
        if key == "#":
            texts = {t[0][0] for t in times}
            same = len(texts) == 1
            part |= {"t": texts.pop() if same else None, "d": [digest] if same else [], "s": sum(len(t[0][0]) for t in times), "l": sum(t[0][1] for t in times)}
        elif key[0] == "(":
            folded: list[dict] = []
            for k, group in enumerate(times):
                inner = [page_wrapper([x], digest)[0] for x in group]
                folded = inner if not k else [merge_part(a, b) for a, b in zip(folded, inner)]
            part["c"] = folded
        else:
            inner = page_wrapper(times[0][0].items, digest)
            for t in times[1:]:
                inner = merge(inner, page_wrapper(t[0].items, digest))
            part["c"] = inner
        parts.append(part)
    return parts


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    pairs = [(i, i) for i in range(head)]
    a, b = a[head:], b[head:]
    if not a or not b:
        return pairs
    if len(a) * len(b) > MAX_ALIGN_CELLS:
        return pairs + [(head + i, head + j) for i, j in _next_equal(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _next_equal(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """A common subsequence in linear time: each of ``b`` takes the next equal of ``a``.

    All of ``b`` when ``b`` is a subsequence of ``a``.
    """
    places: dict[str, list[int]] = {}
    for i, k in enumerate(a):
        places.setdefault(k, []).append(i)
    at = 0
    for j, k in enumerate(b):
        ps = places.get(k, [])
        n = bisect.bisect_left(ps, at)
        if n < len(ps):
            yield ps[n], j
            at = ps[n] + 1


def merge_part(x: dict, y: dict) -> dict:
    out = {"k": x["k"], "o": x["o"] | y["o"], "r": x["r"] | y["r"]}
    if "s" in x:
        same = x["t"] is not None and x["t"] == y["t"]
        pages = sorted({*x["d"], *y["d"]})[:MIN_PAGES] if same else []
        return out | {"t": x["t"] if same else None, "d": pages, "s": x["s"] + y["s"], "l": x["l"] + y["l"]}
    return out | {"c": merge(x["c"], y["c"])}


def merge(a: list[dict], b: list[dict]) -> list[dict]:
    """Fold wrapper ``b`` into ``a``; what only one of them has becomes optional."""
    out: list[dict] = []
    i = j = 0
    for p, q in [*align([x["k"] for x in a], [x["k"] for x in b]), (len(a), len(b))]:
        out += [x | {"o": 1} for x in a[i:p]] + [x | {"o": 1} for x in b[j:q]]
        if p < len(a):
            out.append(merge_part(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def named(value: str) -> int:
    """2 if a class or id clearly names boilerplate, 1 if it is suspect, else 0."""
    words = _WORDS.findall(value)
    told = sum(w in BOILERPLATE_NAMES for w in words)
    if not told:
        return 0
    return 2 if all(w in BOILERPLATE_NAMES or w in LAYOUT_NAMES for w in words) else 1


def suspicion(key: str) -> int:
    """2 for an element that is boilerplate by its tag, role or name, 1 if its name is suspect, else 0."""
    name, *marks = key.split(" ")
    if name in BOILERPLATE_TAGS or "hidden" in marks:
        return 2
    found = 0
    for m in marks:
        kind, _, value = m.partition("=")
        if kind == "role" and value in BOILERPLATE_ROLES:
            return 2
        if kind in ("class", "id"):
            found = max(found, named(value))
    return found


def is_boilerplate(key: str) -> bool:
    return suspicion(key) == 2


def has_heading(parts: list[dict]) -> bool:
    return any("c" in p and (p["k"].split(" ")[0] in HEADINGS or has_heading(p["c"])) for p in parts)


def is_main(key: str) -> bool:
    return key.split(" ")[0] in MAIN_TAGS or "role=main" in key or "itemprop=articlebody" in key


def judge(wrapper: list[dict]) -> list[dict]:
    """The wrapper with ``v`` set on text parts: bit k is 1 if the text is content of layer k.

    Layer 0 is the articles (their parts have ``m`` set), the others are for pages without one.
    """

    def varies(p: dict) -> bool:
        return p["t"] is None or len(p["d"]) < MIN_PAGES

    def largest() -> dict | None:
        """Go down while one container holds most of the text that has no layer yet."""
        known: dict[int, int] = {}

        def mass(p: dict) -> int:
            """Characters of varying text outside links, twice the linked ones taken off."""
            if "s" in p:
                return max(p["s"] - 3 * p["l"], 0) if varies(p) else 0
            if id(p) not in known:
                out = id(p) in taken or is_main(p["k"]) or is_boilerplate(p["k"])
                known[id(p)] = 0 if out else sum(map(mass, p["c"]))
            return known[id(p)]

        chosen, parts = None, wrapper
        while True:
            total = sum(map(mass, parts))
            inner = [p for p in parts if "c" in p and not p["r"] and p["k"].split(" ")[0] not in TEXT_BLOCKS and 10 * mass(p) >= 7 * total > 0]
            if not inner:
                return chosen
            chosen, parts = inner[0], inner[0]["c"]

    # Each container holds most of what the ones before it left, so there are few.
    taken: dict[int, int] = {}
    while (chosen := largest()) is not None:
        taken[id(chosen)] = 2 << len(taken)
    rest = 2 << len(taken)

    def mark(parts: list[dict], layers: int, main: bool = False, dead: bool = False, suspect: bool = False) -> list[dict]:
        """``dead``: inside boilerplate, where nothing is content any more."""
        out = []
        for p in parts:
            if "s" in p:
                linked = 2 * p["l"] > p["s"]
                plain = varies(p) and not linked
                # in an article one sign is not enough, unless the container is suspect
                kept = plain if suspect or not main else varies(p) or not linked
                out.append({"k": "#", "v": 0 if dead or not kept else 1 if main else layers})
            else:
                here, doubt = main or is_main(p["k"]), suspicion(p["k"])
                if doubt == 2 and main and p["k"].split(" ")[0] == "header" and "role=" not in p["k"] and has_heading(p["c"]):
                    doubt = 0  # the head of an article
                gone = dead or doubt == 2
                inner = {"k": p["k"], "c": mark(p["c"], layers | taken.get(id(p), 0), here, gone, suspect or doubt == 1)}
                out.append(inner | {"m": 1} if here and not main and not gone else inner)
        return out

    return mark(wrapper, rest)


def content_blocks(items: list, wrapper: list[dict]) -> Iterator[str]:
    """The texts of a page that meet content slots of its first layer, in page order."""
    met = [(v, text) for v, text in _met(items, wrapper) if v]
    layer = min((v & -v for v, _ in met), default=0)
    yield from (text for v, text in met if v & layer and text)


def _met(items: list, wrapper: list[dict]) -> Iterator[tuple[int, str]]:
    """The texts of a page with the layers of the slots they meet; an article gives an empty one of layer 0.

    Folding keeps the order of every page's keys, so the page is a subsequence
    of the wrapper and each of its parts meets one of the wrapper's.
    """
    groups = collapse(items)
    for j, i in _next_equal([p["k"] for p in wrapper], [k for k, _ in groups]):
        (key, times), part = groups[i], wrapper[j]
        for group in times:
            if key == "#":
                yield part["v"], group[0][0]
            else:
                for x, inner in zip(group, part["c"] if key[0] == "(" else [part]):
                    if isinstance(x, Node):
                        if "m" in inner:
                            yield 1, ""
                        yield from _met(x.items, inner["c"])
                    else:
                        yield inner["v"], x[0]


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _dumps(wrapper: list[dict]) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and its judged ``wrapper`` (JSON), from all pages."""
    bounded_batches(pages.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])
            held.clear()
            return out

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = page_wrapper(parse(html or "").items)
                held[host] = merge(held[host], w) if host in held else w
            if len(held) >= HELD_HOSTS:
                yield flush()
        if held:
            yield flush()
        release_memory()

    def combine(last: bool):
        def run(key, table):
            wrappers = [json.loads(w) for w in sorted(table.column("wrapper").to_pylist())]
            total = wrappers[0]
            for w in wrappers[1:]:
                total = merge(total, w)
            return pa.table({"host": [key[0].as_py()], "wrapper": [_dumps(judge(total) if last else total)]})

        return run

    partial = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(fold, "host string, wrapper string")
    spread = partial.withColumn("g", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_GROUPS)))
    halfway = spread.groupBy("host", "g").applyInArrow(combine(False), "host string, wrapper string")
    return halfway.groupBy("host").applyInArrow(combine(True), "host string, wrapper string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages that have ``url`` and ``html``.

    Pages are dealt by host and a hash of the page into groups of about
    ``GROUP_PAGES`` of a large host's pages; a group's wrapper comes first in it,
    so a task holds one wrapper and rows do not carry it.
    """
    wrappers = written(infer_wrappers(pages), "wrappers")
    names = ["text", "n_chars"]
    kept = without(pages, names)
    kept_names = kept.columns
    groups = max(MIN_GROUPS, -(-pages.count() // GROUP_PAGES))
    salt = F.pmod(F.xxhash64(F.col("url"), F.col("html")), F.lit(groups))
    dealt = kept.select(host_of().alias("_host"), salt.alias("_salt"), F.struct(*[F.col(f"`{c}`") for c in kept_names]).alias("_row"), F.lit(None).cast("string").alias("_wrapper"))
    # a wrapper goes only to groups that have a page
    wanted = pages.select(host_of().alias("_host"), salt.alias("_salt")).distinct()
    heads = wanted.hint("merge").join(wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")).hint("merge"), "_host")
    heads = heads.select("_host", "_salt", F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), "_wrapper")
    both = dealt.union(heads).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", F.col("_wrapper").asc_nulls_last())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: list[dict] = []
        for b in batches:
            wrapper, row = b.column(b.schema.get_field_index("_wrapper")).to_pylist(), b.column(b.schema.get_field_index("_row"))
            at = [i for i, w in enumerate(wrapper) if w is None]
            rows = row.take(pa.array(at, pa.int64()))
            html = iter(pc.struct_field(rows, [kept_names.index(html_name)]).to_pylist())
            texts = []
            for w in wrapper:
                if w is not None:
                    judged = json.loads(w)
                else:
                    texts.append("\n".join(content_blocks(parse(next(html) or "").items, judged)))
            cols = [pc.struct_field(rows, [k]) for k in range(len(kept_names))]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=kept_names + names
            )
        release_memory()

    html_name = next(c for c in kept_names if c.lower() == "html")
    return both.mapInArrow(run, schema)


def op9_html_extract(spark, sf_dir):
    return extract_main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
