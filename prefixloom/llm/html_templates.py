"""Main text of pages by equivalence-class template deduction (operator 5).

A page is a row of tokens: its containers (start tags by their path of tags, class, id and role names)
and its text blocks. A container token that stands up to ``ROLES`` times on a page is told apart by its
place among them, so equal tags in different roles are different tokens. Over the pages of a host every
token has an occurrence vector, how often it stands on each page; tokens with the same vector form an
equivalence class. Vectors are compared by number of pages and the exclusive-or of a hash of (page,
occurrences), where each row is a page of its own, so a host of any size is summed by many tasks and no
task holds its pages.

``deduced`` keeps the valid classes of a host (on nearly all pages, several tokens or on every page),
orders each by place and nests it into the slot that its nearest container of another class opens.
Text tokens of valid classes are fixed; what remains is the slots' own text. A slot's weight is the open, unlinked text that all pages have
below it. Slots decide:

* a slot is left out if most of its text over the host's pages is linked (a menu), or if its tag or names say
  menu, header, footer, sidebar, notice, advert, form or comments (whole names; parts of names like
  ``top-ads`` count outside articles, and inside them only for containers of the template);
* main slots are those of ``article`` and ``main``; without such, the innermost layout container that
  holds ``HELD`` of the open weight. All their remaining text is taken, and level-one headings before them.

Where a main slot holds more fixed than own text over the host's pages, its articles are copies of one
another, exact or edited: none of its text is fixed. A page whose main slots hold fixed text only keeps it, and first-level
headings within main slots are kept always. Pages of hosts without a template, and pages without their host's main slots, are decided by the same rules over
the page's own containers.

Templates are broadcast if all hosts' tokens together are at most ``BROADCAST_TOKENS`` (counted
first), else joined by host through a shuffle, whose hot hosts adaptive execution splits. What is gathered
by host is a token list: at most a page's tokens over ``SUPPORT``.

Defined results: null and empty html give an empty text; a null or odd url is a host of its own;
broken and unclosed markup is read as far as it goes; repeated rows and null ids are pages like any
other; very long pages are read whole, in linear time; an empty table gives an empty result; extra
columns pass through, but for those named like RESULTS, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import others, written

#: A template token stands on this share of a host's pages at least; hosts of fewer pages have no template.
SUPPORT, MIN_PAGES = 0.9, 4
#: Occurrences up to which equal containers of a page are told apart.
ROLES = 6
#: The main slot holds this share of the open text; a slot with this share of links is a menu.
HELD, LINKED = 0.9, 0.5
BROADCAST_TOKENS = 2_000_000
RESULTS = ("text", "n_chars")

# Elements and names that hold no main text.
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
RAW = frozenset("script style noscript template iframe textarea title svg select noembed noframes".split())
ASIDE = frozenset("head nav aside form button menu dialog footer header fieldset".split())
BLOCKS = (
    frozenset(
        "html body div center section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre xmp figure figcaption address"
        " details summary hgroup search dir legend optgroup option frameset".split()
    )
    | ASIDE
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe"
    " subscription sidebar widget menu navbar nav navigation breadcrumb breadcrumbs pagination comment comments disqus respond replies share sharing social related"
    " recommended login signup search complementary contentinfo dialog".split()
)
OUTSIDE = frozenset("header footer masthead topbar toolbar".split())
MAIN = frozenset(("article", "main"))
LAYOUT = frozenset("html body div center".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[-_]+")
#: What is known of a container, as bits.
IS_MAIN, IS_ASIDE, IS_PERHAPS, IS_LAYOUT, IS_TITLE, IS_TEXT = 1, 2, 4, 8, 16, 32
#: Roles of template tokens.
FIXED, MAIN_SLOT, LEFT_OUT, OPEN = 0, 1, 2, 3


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


class Page:
    """Containers in order (path token, parent, bits) and text blocks (container, text, characters in links)."""

    def __init__(self, html: str | None):
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.bits: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html or "")
        count, seen = Counter(self.paths), Counter()
        self.tokens = []
        for p in self.paths:
            c = count[p]
            self.tokens.append(_hash("tag", p, seen[p], c) if c <= ROLES else _hash("tags", p))
            seen[p] += 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, str, int, bool]] = []  # tag, path, container, in a main element
        pieces: list[str] = []
        links = [0, 0]  # open anchors, characters under them
        closers: dict[str, re.Pattern] = {}

        def flush() -> None:
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.blocks.append((stack[-1][2] if stack else -1, text, min(len(text), links[1])))
            links[1] = 0

        at, end = 0, len(html)
        while at < end and (m := _TOKEN.match(html, at)):
            at = m.end()
            closing, tag, attributes, text = m.groups()
            if text is not None:
                pieces.append(text)
                if links[0]:
                    links[1] += len(text)
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag == "a":
                    links[0] = max(0, links[0] - 1)
                elif tag in BLOCKS or "-" in tag:
                    flush()
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                        if stack[k][0] in MAIN and tag not in ("body", "html", "main", "article"):
                            break  # a stray end tag doesn't close the article
                continue
            if tag in RAW:
                # Raw contents run to their own end tag, or to the end of the page; they don't part a word.
                if tag not in closers:
                    closers[tag] = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>?", re.I)
                close = None if attributes.endswith("/") and tag == "svg" else closers[tag].search(html, at)
                at = close.end() if close else at if attributes.endswith("/") and tag == "svg" else end
                continue
            if tag in BREAKS:
                flush()
                continue
            if tag not in BLOCKS and "-" not in tag:
                links[0] += tag == "a"
                continue
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()  # a block ends an open paragraph
                if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                    stack.pop()
            _, path, parent, main = stack[-1] if stack else ("", "", -1, False)
            names = {n for found in _NAMED.findall(attributes) for n in "".join(found).lower().split()} if attributes else ()
            bits = IS_MAIN if tag in MAIN else IS_LAYOUT if tag in LAYOUT else IS_TITLE if tag == "h1" else 0
            inside = main or tag in MAIN
            if tag in ASIDE and not (tag == "header" and inside):
                bits |= IS_ASIDE
            if names and tag not in ("html", "body", "article", "main"):
                if not NAMES.isdisjoint(names) or not main and not OUTSIDE.isdisjoint(names):
                    bits |= IS_ASIDE
                elif any(p in NAMES for n in names for p in _PART.split(n)[:: max(1, len(_PART.split(n)) - 1)]):
                    bits |= IS_PERHAPS if inside else IS_ASIDE
            path = f"{path}/{tag}"
            self.paths.append(path + "".join(f".{n}" for n in sorted(names)))
            self.parents.append(parent)
            self.bits.append(bits)
            stack.append((tag, path, len(self.paths) - 1, inside))
        flush()

    def weighed(self) -> tuple[list[int], list[int]]:
        """Characters of text below each container, and those in links."""
        chars, linked = [0] * len(self.paths), [0] * len(self.paths)
        for c, text, n in self.blocks:
            if c >= 0:
                chars[c] += len(text)
                linked[c] += n
        for i in range(len(self.paths) - 1, 0, -1):
            if (p := self.parents[i]) >= 0:
                chars[p] += chars[i]
                linked[p] += linked[i]
        return chars, linked

    def rows(self) -> dict[int, list]:
        """By token: occurrences, place, parent token, bits, characters, those in links."""
        chars, linked = self.weighed()
        out: dict[int, list] = {}
        n = len(self.paths) + len(self.blocks) or 1
        for i, t in enumerate(self.tokens):
            r = out.setdefault(t, [0, i / n, self.tokens[self.parents[i]] if self.parents[i] >= 0 else 0, self.bits[i], 0, 0])
            r[0] += 1
            r[4] += chars[i]
            r[5] += linked[i]
        for c, text, k in self.blocks:
            r = out.setdefault(_hash("text", text), [0, (c + 0.5) / n, self.tokens[c] if c >= 0 else 0, IS_TEXT, 0, 0])
            r[0] += 1
            r[4] += len(text)
            r[5] += k
        return out


def nested(rows: list[dict], pages: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """Valid classes of a host, each ordered by place; and by class the slot it is nested in: (class, index of the token that opens it)."""
    by: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows:
        by[r["pages"], r["vector"]].append(r)
    valid = [sorted(c, key=lambda r: (r["place"], r["token"])) for (n, _), c in by.items() if len(c) > 1 or n == pages]
    valid.sort(key=lambda c: (c[0]["place"], -len(c), c[0]["token"]))
    classes = [[r["token"] for r in c] for c in valid]
    where = {t: (i, k) for i, c in enumerate(classes) for k, t in enumerate(c)}
    parent = {r["token"]: r["parent"] for r in rows}
    slots = {}
    for i, c in enumerate(classes):
        at, steps = parent[c[0]], 0
        while at and (at not in where or where[at][0] == i) and steps < 10_000:
            at, steps = parent.get(at, 0), steps + 1
        if at in where:
            slots[i] = where[at]
    return classes, slots


def deduced(rows: list[dict], pages: int) -> dict[int, int]:
    """The role of each template token of a host, by its slots."""
    classes, slots = nested(rows, pages)
    known = {r["token"]: r for r in rows}
    opened: dict[int, list[int]] = defaultdict(list)  # the containers in each slot, by the token that opens it; 0: the page
    owner: dict[int, int] = {}
    mine = {t for c in classes for t in c}
    for i, c in enumerate(classes):
        outer = classes[slots[i][0]][slots[i][1]] if i in slots else 0
        for t in c:
            at, steps = known[t]["parent"], 0
            while at and at not in mine and steps < 10_000:
                at, steps = known[at]["parent"] if at in known else 0, steps + 1
            owner[t] = at if at in mine and at != t else outer if outer != t else 0
            if not known[t]["bits"] & IS_TEXT:
                opened[owner[t]].append(t)
    fixed: Counter = Counter()  # fixed text below each container
    for t in mine:
        if known[t]["bits"] & IS_TEXT:
            at, steps = owner[t], 0
            while at and steps < 10_000:
                fixed[at] += known[t]["chars"]
                at, steps = owner.get(at, 0), steps + 1
    roles: dict[int, int] = {}
    weight: dict[int, float] = {}
    for t in mine:
        r = known[t]
        if r["bits"] & IS_TEXT:
            roles[t] = FIXED
            continue
        weight[t] = max(0.0, r["chars"] - r["linked"] - fixed[t])
        menu = r["chars"] > 0 and r["linked"] >= LINKED * r["chars"] and not r["bits"] & (IS_MAIN | IS_TITLE)
        roles[t] = LEFT_OUT if menu or r["bits"] & (IS_ASIDE | IS_PERHAPS) else OPEN
    # What is left out weighs nothing, in its slot and in all that hold it.
    lost: Counter = Counter()
    for t in sorted(weight, key=lambda t: known[t]["place"]):
        outer, steps = owner[t], 0
        chain = []
        while outer and steps < 10_000:
            chain.append(outer)
            outer, steps = owner.get(outer, 0), steps + 1
        if any(roles[a] == LEFT_OUT for a in chain):
            roles[t] = LEFT_OUT
        elif roles[t] == LEFT_OUT:
            for a in chain:
                lost[a] += weight[t]
    weight = {t: 0.0 if roles[t] == LEFT_OUT else max(0.0, w - lost[t]) for t, w in weight.items()}
    named = [t for t in weight if known[t]["bits"] & IS_MAIN and roles[t] == OPEN]
    if named:
        for t in named:
            roles[t] = MAIN_SLOT
        return _kept_where_most_is_fixed(roles, known, owner, weight)
    total, at = sum(weight[t] for t in opened[0]), 0
    while inner := [t for t in opened[at] if total and weight[t] >= HELD * total and known[t]["bits"] & IS_LAYOUT]:
        at = max(inner, key=lambda t: (weight[t], t))
    if at:
        roles[at] = MAIN_SLOT
    return _kept_where_most_is_fixed(roles, known, owner, weight)


def _kept_where_most_is_fixed(roles: dict[int, int], known: dict[int, dict], owner: dict[int, int], weight: dict[int, float]) -> dict[int, int]:
    """Text tokens are no template in a main slot that holds more fixed than own text over the host's pages: its articles are copies of one another."""
    under: dict[int, list[int]] = defaultdict(list)
    for t, role in roles.items():
        if role != FIXED:
            continue
        at, steps, main = owner[t], 0, 0
        while at and steps < 10_000 and roles[at] != LEFT_OUT:
            main = at if roles[at] == MAIN_SLOT else main
            at, steps = owner.get(at, 0), steps + 1
        if main and not at:
            under[main].append(t)
    for m, texts in under.items():
        if sum(known[t]["chars"] for t in texts) > weight[m]:
            roles |= dict.fromkeys(texts, OPEN)
    return roles


def own_roles(page: Page) -> dict[int, int]:
    """The roles that a page's own containers have without a template: every container is a slot, no text is fixed."""
    chars, linked = page.weighed()
    rows = [
        {"token": i + 1, "parent": page.parents[i] + 1, "bits": b & ~IS_PERHAPS, "place": i, "pages": 1, "vector": i, "chars": chars[i], "linked": linked[i]}
        for i, b in enumerate(page.bits)
    ]
    return deduced(rows, 1)


def main_text(html: str | None, template: dict[int, int] | None = None) -> str:
    """The main text; ``template``: the roles of the host's template tokens."""
    page = Page(html)
    n = len(page.tokens)
    template = template or {}
    left: list[bool] = [False] * n
    main: list[bool] = [False] * n
    role = [template.get(t) for t in page.tokens]
    named = any(b & IS_MAIN for b in page.bits)
    if not (MAIN_SLOT in role) or named and not any(r == MAIN_SLOT and b & IS_MAIN for r, b in zip(role, page.bits)):
        own = own_roles(page)
        role = [LEFT_OUT if r == LEFT_OUT else own[i + 1] if i + 1 in own else r for i, r in enumerate(role)]
    whole = MAIN_SLOT not in role
    for i in range(n):
        p = page.parents[i]
        outer = main[p] if p >= 0 else False
        left[i] = (p >= 0 and left[p]) or role[i] == LEFT_OUT or bool(page.bits[i] & IS_ASIDE)
        main[i] = outer or role[i] == MAIN_SLOT or named and bool(page.bits[i] & IS_MAIN)
    first = next((i for i in range(n) if main[i] and not left[i]), n)
    taken, titles = [], set()  # a heading of the main text is no notice, though it be the same everywhere
    for c, text, links in page.blocks:
        if c < 0:
            if whole:
                taken.append(text)
        elif not left[c] and (main[c] or whole or page.bits[c] & IS_TITLE and c < first):
            # Outside of main elements a block of links is a menu even without a slot of its own.
            if named or links < LINKED * len(text):
                if main[c] and page.bits[c] & IS_TITLE:
                    titles.add(len(taken))
                taken.append(text)
    own = [template.get(_hash("text", t)) != FIXED for t in taken] if template else [True] * len(taken)
    return " ".join(t for k, t in enumerate(taken) if own[k] or k in titles or not any(own))


_COUNTED = "host string, token long, pages long, vector long, place double, parent long, bits int, chars long, linked long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``_COUNTED``, added up within each batch; token 0 counts the host's pages."""
    for batch in batches:
        rows: dict[tuple, list] = {}
        for host, page, html in zip(batch["host"], batch["page"], batch["html"]):
            rows.setdefault((host, 0), [0, 0, 0.0, 0, 0, 0, 0])[0] += 1
            for token, (n, place, parent, bits, chars, linked) in Page(html).rows().items():
                r = rows.setdefault((host, token), [0, 0, 0.0, parent, 0, 0, 0])
                r[0] += 1
                r[1] ^= _hash(page, n)
                r[2] += place
                r[3] = min(r[3], parent)
                r[4] |= bits
                r[5] += chars
                r[6] += linked
        yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=[c.split()[0] for c in _COUNTED.split(", ")])


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, roles): of ``pages`` (host, page, html), the template of each host; ``page`` tells rows apart."""
    counts = pages.mapInPandas(_counted, _COUNTED)
    sums = [F.sum(c).alias(c) for c in ("pages", "place", "chars", "linked")]
    t = counts.groupBy("host", "token").agg(*sums, F.bit_xor("vector").alias("vector"), F.min("parent").alias("parent"), F.bit_or("bits").alias("bits"))
    # Tokens of a few pages are no template; they go before anything is gathered by host.
    t = written(t.where((F.col("pages") >= MIN_PAGES) | (F.col("token") == 0)))
    total = t.where("token = 0").select(F.col("host").alias("_h"), F.col("pages").alias("all_pages"))
    often = t.where("token <> 0").join(total, F.col("host") == F.col("_h"))
    often = often.where((F.col("all_pages") >= MIN_PAGES) & (F.col("pages") >= SUPPORT * F.col("all_pages")))
    own = F.struct("token", "pages", "vector", (F.col("place") / F.col("pages")).alias("place"), "parent", "bits", "chars", "linked")
    by_host = often.groupBy("host").agg(F.max("all_pages").alias("n"), F.array_sort(F.collect_list(own)).alias("own"))

    def run(own: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = [deduced([r if isinstance(r, dict) else r.asDict() for r in rows], k) for rows, k in zip(own, n)]
        return pd.DataFrame({"tokens": [list(f) for f in found], "roles": [list(f.values()) for f in found]})

    run.__annotations__ = {"own": pd.Series, "n": pd.Series, "return": pd.DataFrame}
    return by_host.select("host", pandas_udf(run, "tokens array<long>, roles array<int>")("own", "n").alias("t")).select("host", "t.*")


def extracted(pages: DataFrame, html: str = "html", url: str = "url", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``pages`` without ``html``, with text and n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = written(templates(pages.select(host.alias("host"), F.monotonically_increasing_id().alias("page"), F.col(html).alias("html"))))
    size = own.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    kept = others(pages, html, *RESULTS)
    rows = pages.select(*kept, host.alias("_hx_host"), F.col(html).alias("_hx_html"))
    side = own.select(F.col("host").alias("_hx_h"), F.col("tokens").alias("_hx_tokens"), F.col("roles").alias("_hx_roles"))
    rows = rows.join(F.broadcast(side) if size <= broadcast_tokens else side, F.col("_hx_host") == F.col("_hx_h"), "left")

    def run(texts: pd.Series, tokens: pd.Series, roles: pd.Series) -> pd.Series:
        made: dict[bytes, dict[int, int]] = {}

        def one(t: np.ndarray | None, r: np.ndarray | None) -> dict[int, int] | None:
            if t is None:
                return None
            key = np.asarray(t).tobytes()
            if key not in made:
                made[key] = dict(zip(np.asarray(t).tolist(), np.asarray(r).tolist()))
            return made[key]

        return pd.Series([main_text(h, one(t, r)) for h, t, r in zip(texts, tokens, roles)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "tokens": pd.Series, "roles": pd.Series, "return": pd.Series}
    text = F.pandas_udf(run, "string")(F.col("_hx_html"), F.col("_hx_tokens"), F.col("_hx_roles"))
    return rows.select(*kept, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
