"""A small reader of HTML: elements, text and block borders in page order, with the usual implied end tags."""

from __future__ import annotations

import html as references
import re

import xxhash

#: Element names with a meaning of their own in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends: the open element of these names, up to the nearest of the names after the bar.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}

#: Elements that are never the article's text (of formulas, the annotations that no browser shows); words of class, id or role that say the same wherever they
#: stand (adverts, notices, comments, forms); words that say it outside articles and main only; and words that may stand beside these in a name of several words.
DROPPED = frozenset(
    "head script style template noscript iframe svg annotation annotation-xml canvas audio video nav footer aside form button select textarea input dialog menu title".split()
)
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal"
    " comment comments commentlist respond disqus replies reader-comments newsletter subscribe paywall login signup".split()
)
HINTS = frozenset(
    "banner alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead contentinfo complementary search related share sharing"
    " social widget pagination".split()
)
#: As the id of an element in an article or main, only these words say it alone: other ids are made from headings as often.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
#: What shows that an element in main content, named by its id as a form or as comments, is one.
_FORM_OR_REPLIES = frozenset("form input textarea select button iframe article".split())
_BESIDE = HINTS | PLAIN | frozenset("area bar block box container form list overlay panel section slot unit wrap wrapper".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _named(word: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the names, or is made of one of them and words or numbers that may stand beside it."""
    parts = [part for part in _PARTS.split(word) if part]
    return word in names or (bool(parts) and parts[0] in names and all(part in _BESIDE or part.isdigit() for part in parts))


def _hinted(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is unwanted wherever it stands; whether it is outside articles and main; and whether it is unwanted by its id only, which may be
    that of a section of the article. The id of a heading says nothing."""
    words: dict[str, list[str]] = {"class": [], "id": [], "role": []}
    for kind, value in _NAMED.findall(attributes):
        words[kind.lower()] += value.strip("\"'").lower().split()
    ids = words["id"] if name not in _HEADINGS else []
    said = [*words["class"], *words["role"]]
    plain = bool(_HIDDEN.search(attributes)) or any(_named(w, PLAIN) for w in said) or any(_named(w, _ADVERTS) for w in ids)
    return plain, any(_named(w, HINTS) for w in (*said, *ids)), any(_named(w, PLAIN) for w in ids)


class Page:
    """Elements in page order (``names``, ``parents``, ``unwanted``, ``hinted``, ``by_id``) and ``events``: (element, text) or (element, None) for a block border."""

    def __init__(self, text: str):
        self.names, self.parents, self.unwanted, self.hinted, self.by_id = [""], [0], [False], [False], [False]
        self.events: list[tuple[int, str | None]] = []
        stack = [0]
        depths: dict[str, list[int]] = {}  # of the open elements of each name

        def opened(element: int) -> None:
            depths.setdefault(self.names[element], []).append(len(stack))
            stack.append(element)

        def close_until(depth: int) -> None:
            while len(stack) > depth:
                if self.names[stack[-1]] in BLOCK:
                    self.events.append((stack[-1], None))
                depths[self.names[stack.pop()]].pop()

        def deepest(names) -> int:
            return max((depths[name][-1] for name in names if depths.get(name)), default=0)

        def last_open(wanted, barrier) -> int:
            depth = deepest(wanted)
            return depth if depth and depth > deepest(barrier) else 0

        at = 0
        while m := _TAG.search(text, at):
            if m.start() > at:
                self.events.append((stack[-1], text[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if depth := last_open({name}, ()):
                    close_until(depth)
                continue
            if name in _ENDS and (depth := last_open(*_ENDS[name])):
                close_until(depth)
            if name in BLOCK and (depth := last_open({"p"}, {"table", "td", "th", "button", "object"})):
                close_until(depth)
            attributes = m[3] or m[6] or ""
            self.names.append(name)
            self.parents.append(stack[-1])
            spared = name in ("html", "body", "main") or (name == "article" and not last_open({"article"}, ()))
            plain, hinted, by_id = _hinted(name, attributes) if attributes and not spared else (False, False, False)
            self.unwanted.append(name in DROPPED or plain)
            self.hinted.append(hinted)
            self.by_id.append(by_id)
            own = len(self.names) - 1
            if name in BLOCK:
                self.events.append((own, None))
            if name == "br":
                self.events.append((own, " "))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(text, at)
                self.events.append((own, text[at : end.start() if end else len(text)]))
                at = end.start() if end else len(text)
                opened(own)
            elif name not in VOID:
                opened(own)
        if at < len(text):
            self.events.append((stack[-1], text[at:]))
        close_until(1)

        self.held = [name in _FORM_OR_REPLIES for name in self.names]  # a form or replies, here or below
        for i in range(len(self.names) - 1, 0, -1):
            self.held[self.parents[i]] |= self.held[i]
        self.content = self._content()

    def _content(self, removed: list[bool] | None = None) -> list[bool]:
        """Elements that lie in the page's main content and in nothing unwanted or ``removed``: in articles, else in main, else anywhere but in a header.

        Where there is a main element, articles are the content only if they hold three quarters of its text.
        """
        articles, main, page = (self._inside(wanted, removed) for wanted in ("article", "main", ""))
        if not any(main):
            return articles if any(articles) else page
        lengths = [0] * len(self.names)
        for node, text in self.events:
            lengths[node] += len(" ".join(text.split())) if text else 0
        whole, within = self._inside("main", removed, self.hinted), [i and a and m for i, (a, m) in enumerate(zip(articles, main))]
        of = lambda inside: sum(n for n, own in zip(lengths, inside) if own)
        return articles if any(within) and 4 * of(within) >= 3 * of(whole) else main

    def _inside(self, wanted: str, removed: list[bool] | None = None, besides: list[bool] | None = None) -> list[bool]:
        """Elements that lie in an element of the ``wanted`` name and in nothing unwanted, ``removed`` or ``besides``."""
        gone, inside = [False] * len(self.names), [False] * len(self.names)
        inside[0] = not wanted
        for i in range(1, len(self.names)):
            parent = self.parents[i]
            within = bool(wanted) and inside[parent]
            hinted = self.by_id[i] and self.held[i] if within else self.hinted[i] or self.by_id[i]
            gone[i] = gone[parent] or self.unwanted[i] or hinted or bool(removed and removed[i] or besides and besides[i]) or (not wanted and self.names[i] == "header")
            inside[i] = (inside[parent] or self.names[i] == wanted) and not gone[i]
        return inside

    def hashes(self) -> list[int]:
        """A hash of each element's subtree: its name, its texts with white space as one space, then its children."""
        parts: list[list[str]] = [[] for _ in self.names]
        for node, text in self.events:
            if text is not None and (words := " ".join(text.split())):
                parts[node].append(words)
        out = [0] * len(self.names)
        for i in range(len(self.names) - 1, -1, -1):  # children stand behind their parents
            out[i] = xxhash.xxh3_64_intdigest("\0".join([self.names[i], *parts[i]])) >> 1
            if i:
                parts[self.parents[i]].append(f"\1{out[i]}")
        return out

    def main(self) -> list[bool]:
        """Elements of the main content that lie in an article or main."""
        named = any(name in ("article", "main") for name in self.names)
        return [named and own for own in self.content]

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks of the main content of what is left without elements whose subtree is one of ``templates``, joined by an empty line.

        If templates make up more than half of the blocks in article or main, and more than half of their text, the page is a near copy of
        others and not what a template leaves to fill in: then they go outside article and main only.
        """
        kept = self.content
        if templates:
            removed = [i > 0 and h in templates for i, h in enumerate(self.hashes())]
            inside = self.main()
            if any(r and i for r, i in zip(removed, inside)):
                whole, left = self._blocks(inside), self._blocks([i and not r for i, r in zip(inside, self._below(removed))])
                if 2 * len(left) < len(whole) and 2 * sum(map(len, left)) < sum(map(len, whole)):
                    removed = [r and not i for r, i in zip(removed, inside)]
            kept = self._content(removed)
        return "\n\n".join(self._blocks(kept))

    def _below(self, marked: list[bool]) -> list[bool]:
        """Elements that are marked or lie in one that is."""
        out = list(marked)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out

    def _blocks(self, kept: list[bool]) -> list[str]:
        blocks, held = [], []
        for node, text in self.events:
            if text is None:
                if held:
                    blocks.append(held)
                    held = []
            elif kept[node]:
                held.append(text)
        blocks.append(held)
        done = (" ".join(references.unescape("".join(b)).split()) for b in blocks)
        return [b for b in done if b]
