"""Per-page helper of the extraction job: one pass of the standard HTML tokenizer with an element stack.

The walk is linear in the page: open elements are counted by tag, implied ends pop the stack, and text goes to the few open
headings, links, titles and scripts only.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN_TAGS = {"head", "script", "style", "noscript", "template", "svg"}
HIDDEN_STYLE = re.compile(r"(display|visibility|content-visibility):(none|hidden)")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_PARAGRAPH = {"p", "div", "ul", "ol", "table", "section", "article", "nav", "header", "footer", "main", "form", "blockquote", "pre"} | HEADINGS
BARRIERS = {"table", "caption", "td", "th", "html", "template", "object", "button", "marquee", "applet"}
GATHERING = HEADINGS | {"a", "title", "script", "summary", "button"}
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)
# fixed values: what marks a search form and a list of results
SEARCH_INPUTS = {"s", "q", "query", "search"}
SEARCH_ACTION = re.compile(r"/(search|suche|site-search)(?:/|$)|[?&](s|q|query|search)=", re.IGNORECASE)
RESULT_LIST = re.compile(r"search-results|search-result-list")
SEARCH_MARKUP = re.compile(r"[\"']@type[\"']\s*:\s*[\"']SearchAction[\"']", re.IGNORECASE)
# fixed values: what marks dates, bylines, regions of sources, questions and players in class names, ids and addresses
DATE_NAMES = re.compile(r"date|publish")
BYLINE_NAMES = re.compile(r"author|byline")
SOURCE_NAMES = re.compile(r"source|reference|citation|bibliograph|footnote", re.IGNORECASE)
FAQ_NAMES = re.compile(r"faq|FAQ")
PLAYERS = re.compile(r"youtube|youtu\.be|vimeo|wistia|loom")
NONE: frozenset[str] = frozenset()
NOWHERE = {"content": False, "navigation": False, "details": False, "region": False, "faq": False, "noted": NONE}
QUESTION_TAGS = {"h2", "h3", "h4", "summary", "button"}


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class PageWalk(HTMLParser):
    """Collects head values, headings, links, images, resources, JSON-LD blocks, landmarks and the text kinds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.open_tags: Counter[str] = Counter()
        #: positions in the stack of open paragraphs, and of elements that a paragraph's implied end does not pass
        self.paragraphs: list[int] = []
        self.barriers: list[int] = []
        #: open elements that gather text: headings, links, titles, scripts
        self.gathering: list[dict] = []
        self.forms: list[dict] = []
        self.titles: list[str] = []
        self.meta: list[dict] = []
        self.rels: list[dict] = []
        self.html_lang: str | None = None
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.scripts: list[str] = []
        self.blocks: list[str] = []
        self.inline: list[str] = []
        self.counts: dict[str, int] = {}
        #: visible dates and bylines of the content, outermost elements only, and links of the content that may name sources
        self.notes: dict[str, list[str]] = {"date": [], "byline": []}
        self.sources: list[dict] = []
        self.raw: list[str] = []
        self.visible: list[str] = []
        self.main: list[str] = []

    def handle_starttag(self, tag, attrs):
        attributes = {name: (value or "") for name, value in attrs}
        if tag in CLOSES_PARAGRAPH and self.paragraphs and (not self.barriers or self.barriers[-1] < self.paragraphs[-1]):
            self._pop_to(self.paragraphs[-1])
        if tag == "a" or tag in HEADINGS:
            self._end_gathering(HEADINGS if tag in HEADINGS else {"a"})
        parent = self.stack[-1] if self.stack else None
        hidden = bool(
            tag in HIDDEN_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true" or ("style" in attributes and HIDDEN_STYLE.search(re.sub(r"\s+", "", attributes["style"].lower())))
            or (tag == "dialog" and "open" not in attributes) or (parent and parent["hidden"])
        )
        folded = bool(parent and (parent["folded"] or (parent["tag"] == "details" and "open" not in parent["attrs"])) and tag != "summary")
        role = attributes.get("role", "")
        item = {
            "tag": tag, "attrs": attributes, "hidden": hidden, "folded": folded, "text": [], "alts": [], "done": False,
            "main": bool(tag in ("main", "article") or role == "main" or (parent and parent["main"])), "body": bool(tag == "body" or (parent and parent["body"])),
            "chrome": bool(tag in ("header", "nav", "footer") or (parent and parent["chrome"])),
        }
        self._context(tag, attributes, role, item, parent)
        self._count(tag)
        if role:
            self._count(f"role:{role}")
        self._note(tag, attributes, item)
        if tag not in VOID:
            position = len(self.stack)
            self.stack.append(item)
            self.open_tags[tag] += 1
            if tag == "p":
                self.paragraphs.append(position)
            elif tag in BARRIERS:
                self.barriers.append(position)
            if tag in GATHERING or item["notes"]:
                self.gathering.append(item)

    def _context(self, tag: str, attributes: dict, role: str, item: dict, parent: dict | None) -> None:
        """What an element inherits from those around it: content, navigation, a region of sources, a list of questions, an open date or byline."""
        outer = parent or NOWHERE
        item["content"] = outer["content"] or tag in ("main", "article")
        item["navigation"] = outer["navigation"] or tag in ("nav", "footer") or role in ("navigation", "contentinfo")
        item["details"] = outer["details"] or tag == "details"
        item["region"], item["faq"], item["in_faq"], item["notes"], item["noted"] = outer["region"], outer["faq"], outer["faq"], NONE, outer["noted"]
        if tag == "time":
            self._mark(item, outer, "date")
        if not attributes:
            return
        names, ids, rel = attributes.get("class", ""), attributes.get("id", ""), attributes.get("rel", "")
        if names or ids:
            item["region"] = item["region"] or bool(SOURCE_NAMES.search(names) or SOURCE_NAMES.search(ids))
            if FAQ_NAMES.search(names) or FAQ_NAMES.search(ids):
                self._count("faq:containers")
                item["faq"] = True
            if DATE_NAMES.search(names):
                self._mark(item, outer, "date")
        if "author" in rel.split() or BYLINE_NAMES.search(names):
            self._mark(item, outer, "byline")

    @staticmethod
    def _mark(item: dict, outer: dict, kind: str) -> None:
        """Notes a visible date or byline of the content, unless an open element has it already."""
        if outer["content"] and not item["hidden"] and kind not in outer["noted"]:
            item["notes"], item["noted"] = item["notes"] | {kind}, item["noted"] | {kind}

    def _count(self, key: str) -> None:
        self.counts[key] = self.counts.get(key, 0) + 1

    def _note(self, tag: str, attributes: dict, item: dict) -> None:
        if tag == "html" and self.html_lang is None:
            self.html_lang = attributes.get("lang", "").strip() or None
        elif tag == "meta":
            self.meta.append(attributes)
        elif tag == "link":
            self.rels.append(attributes)
        elif tag == "script" and attributes.get("src"):
            self.scripts.append(attributes["src"])
        elif tag == "img":
            self.images.append(attributes | {"_hidden": item["hidden"]})
            for outer in self.gathering:
                if (outer["tag"] in HEADINGS or outer["notes"]) and "alt" in attributes:
                    outer["alts"].append(attributes["alt"])
        elif tag == "form":
            action = attributes.get("action", "").strip()
            search = attributes.get("role", "").lower() == "search" or bool(SEARCH_ACTION.search(action))
            self.forms.append({"search": search, "main": item["main"] and not item["chrome"], "chrome": item["chrome"]})
        elif tag == "input" and self.forms and self.open_tags["form"]:
            kind, role, name = (attributes.get(key, "").lower() for key in ("type", "role", "name"))
            self.forms[-1]["search"] |= kind == "search" or role == "searchbox" or name in SEARCH_INPUTS
        if tag == "video" or (tag == "iframe" and PLAYERS.search(attributes.get("src", ""))):
            self._count("videos")
        if attributes and (RESULT_LIST.search(f"{attributes.get('class', '')} {attributes.get('id', '')}") or "data-search-results" in attributes):
            self._count("search:result_lists")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            position = len(self.stack) - 1
            while self.stack[position]["tag"] != tag:
                position -= 1
            self._pop_to(position)

    def _pop_to(self, position: int) -> None:
        """Closes the elements from the top of the stack down to a position."""
        while len(self.stack) > position:
            item = self.stack.pop()
            self.open_tags[item["tag"]] -= 1
            for places in (self.paragraphs, self.barriers):
                if places and places[-1] == len(self.stack):
                    places.pop()
            self._close(item)

    def _end_gathering(self, tags: set[str]) -> None:
        """A link ends at the next link and a heading at the next heading, even if its end tag is missing."""
        for item in [x for x in self.gathering if x["tag"] in tags]:
            self._close(item)

    def handle_data(self, data):
        inside = self.stack[-1] if self.stack else None
        for outer in self.gathering:
            if not (outer["tag"] in HEADINGS and inside["hidden"] and not outer["hidden"]):
                outer["text"].append(data)
        if inside is None or not inside["body"]:
            return
        self.raw.append(data)
        closed = inside["tag"] == "details" and "open" not in inside["attrs"]
        if not inside["hidden"] and not inside["folded"] and not closed:
            self.visible.append(data)
            if inside["main"]:
                self.main.append(data)

    def _close(self, item):
        if item["done"] or not (item["tag"] in GATHERING or item["notes"]):
            return
        item["done"] = True
        self.gathering = [x for x in self.gathering if x is not item]
        tag, attributes, text = item["tag"], item["attrs"], "".join(item["text"])
        for kind in item["notes"]:
            if found := squeeze(text) or (squeeze(" ".join(item["alts"])) if kind == "byline" else ""):
                self.notes[kind].append(found)
        if "?" in text:
            if tag == "summary":
                self._count("questions:summary")
                if item["details"]:
                    self._count("questions:details")
            if tag in QUESTION_TAGS and item["in_faq"]:
                self._count("questions:faq")
        if tag == "title" and not item["body"]:
            self.titles.append(squeeze(text))
        elif tag == "a" and "href" in attributes:
            self.links.append({"href": attributes["href"], "anchor": squeeze(text), "rel": attributes.get("rel", "").strip()})
            if item["content"] and not item["navigation"] and not item["hidden"]:
                self.sources.append({"href": attributes["href"], "anchor": squeeze(text), "region": item["region"]})
        elif tag == "script" and attributes.get("type", "").strip().lower() == "application/ld+json":
            self.blocks.append(text)
        elif tag == "script":
            self.inline.append(text)
        elif tag in HEADINGS:
            shown, label, alt = squeeze(text), squeeze(attributes.get("aria-label", "")), squeeze(" ".join(item["alts"]))
            source = "visible_text" if shown else "aria_label" if label else "image_alt" if alt else "none"
            self.headings.append({"level": int(tag[1]), "name": shown or label or alt, "name_source": source, "visible": not item["hidden"]})

    def finish(self) -> "PageWalk":
        self.close()
        self._pop_to(0)
        searching = [form for form in self.forms if form["search"]]
        self.counts |= {"search:forms": len(searching), "search:main_forms": sum(form["main"] for form in searching), "search:chrome_forms": sum(form["chrome"] for form in searching)}
        return self

    def charset(self) -> str | None:
        """Declared encoding: a charset attribute, or the one in an http-equiv content type."""
        for item in self.meta:
            if item.get("charset", "").strip():
                return item["charset"].strip()
            if item.get("http-equiv", "").lower() == "content-type" and (found := CHARSET.search(item.get("content", ""))):
                return found[1]
        return None

    def first_meta(self, key: str, name: str) -> str | None:
        for item in self.meta:
            if item.get(key, "").lower() == name and item.get("content", "").strip():
                return item["content"].strip()
        return None

    def rel(self, name: str) -> list[dict]:
        return [item for item in self.rels if name in item.get("rel", "").lower().split()]


def walk(html: str) -> PageWalk:
    page = PageWalk()
    page.feed(html or "")
    if SEARCH_MARKUP.search(html or ""):
        page.counts["search:actions"] = 1
    return page.finish()
