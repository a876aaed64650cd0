"""Captured pages as people would keep them: without what frameworks and bundlers put there."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from bundlelens import rules
from bundlelens.operators.generate import generate
from bundlelens.operators.html import VOID

# Inline scripts that frameworks add to pages, links that only warm caches, comments that mark components.
FRAMEWORK_INLINE = re.compile(r"self\.__next_[fs]|__next_f|\$R[CSTX]\s*[(=]|__NEXT_DATA__|__NEXT_P|__nuxt|window\.__NUXT__|__remixContext|__sveltekit|requestAnimationFrame\(function\(\)\{\$RT")
WARMING = re.compile(r"\b(preload|modulepreload|prefetch|preconnect|dns-prefetch)\b", re.I)
MARKER = re.compile(r"^\s*(/?\$[?!~]?|/?&|)\s*$")
RAW = frozenset(("script", "style", "noscript", "textarea"))


def email(code: str) -> str | None:
    """The address that a protected one stands for."""
    if not re.fullmatch(r"(?:[0-9a-fA-F]{2}){2,}", code):
        return None
    octets = bytes.fromhex(code)
    try:
        found = bytes(b ^ octets[0] for b in octets[1:]).decode()
    except UnicodeDecodeError:
        return None
    return found if re.fullmatch(r'[^\s<>"]+@[^\s<>"]+', found) else None


def with_emails(page: str) -> str:
    """Protected addresses written out: links become mail links, other marks the plain address."""
    if "data-cfemail" not in page and "/cdn-cgi/l/email-protection" not in page:
        return page
    plain = lambda code: escape(found, quote=False) if (found := email(code)) else None

    def link(m: re.Match) -> str:
        code = re.search(r'data-cfemail="([0-9a-fA-F]+)"', m[0])
        found = plain(code[1]) if code else None
        return f'<a href="mailto:{found}">{found}</a>' if found else m[0]

    page = re.sub(r'(?is)<a\b[^>]*href="/cdn-cgi/l/email-protection"[^>]*>.*?</a>', link, page)
    page = re.sub(r'(?is)<(span|template)\b[^>]*data-cfemail="([0-9a-f]+)"[^>]*>.*?</\1>', lambda m: plain(m[2]) or m[0], page)
    return re.sub(r"""(?i)(["'])/cdn-cgi/l/email-protection#([0-9a-f]+)\1""", lambda m: f"{m[1]}mailto:{found}{m[1]}" if (found := plain(m[2])) else m[0], page)


def service(place: str) -> str:
    host = place.split("/")[0]
    name = next((name for pattern, name in rules.THIRD_PARTIES if re.search(pattern, place)), None)
    return f"{host} ({name})" if name else host


class _Cleaner(HTMLParser):
    """Copies a page's source but for what is dropped: what is kept is cut from the source as it is written there."""

    def __init__(self, own_host: str, sheets: frozenset[str]):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.host, self.sheets = own_host, sheets
        self.removed = 0
        self.third: list[str] = []
        self.kind = ""
        self.dropping: str | None = None
        self.depth = 0
        self.script: list[str] | None = None
        self.kept: tuple[list[str], int] | None = None  # where the piece goes that began there and ends with the next one

    def copy(self, page: str) -> str:
        self.source, self.lines = page, [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        self.cut(len(page))
        return "".join(self.out + (self.script or []))

    def cut(self, at: int) -> None:
        if self.kept:
            target, start = self.kept
            target.append(self.source[start:at])
        self.kept = None

    def begin(self) -> int:
        """Where what is handled begins: the piece before it ends there."""
        line, column = self.getpos()
        at = self.lines[line - 1] + column
        self.cut(at)
        return at

    def keep(self, at: int) -> None:
        self.kept = (self.script if self.script is not None else self.out, at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.begin()
        own = {k: v or "" for k, v in reversed(attrs)}
        if self.dropping:
            self.depth += tag == self.dropping and tag not in VOID
            return
        if tag == "link" and (WARMING.search(own.get("rel", "")) or "stylesheet" in own.get("rel", "").lower() and own.get("href") in self.sheets):
            return
        if tag == "template" and re.match("[BPS]:", own.get("id", "")):
            self.dropping, self.depth = tag, 1
            return
        if tag == "script":
            if "src" in own:
                m = re.match(r"(?:https?:)?//([^/?#]+)([^?#]*)", own["src"])
                if m and m[1] != self.host:
                    self.third.append(own["src"])
                    self.out.append(f"<!-- third-party script: {service(m[1] + m[2])} -->")
                    self.keep(at)
                    return
                self.removed += 1
                self.dropping, self.depth = tag, 1
                return
            self.script = []
            self.kind = own.get("type", "").lower()
        self.keep(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "link" or self.dropping:
            self.handle_starttag(tag, attrs)
        else:
            self.keep(self.begin())

    def handle_endtag(self, tag: str) -> None:
        at = self.begin()
        if self.dropping:
            if tag == self.dropping:
                self.depth -= 1
                if self.depth == 0:
                    self.dropping = None
            return
        if tag == "script" and self.script is not None:
            whole, self.script = self.script, None
            if self.kind != "application/ld+json" and (FRAMEWORK_INLINE.search("".join(whole[1:])) or "json" in self.kind):
                self.removed += 1
                return
            self.out += whole
        self.keep(at)

    def handle_data(self, data: str) -> None:
        at = self.begin()
        if not self.dropping:
            self.keep(at)

    def handle_comment(self, data: str) -> None:
        at = self.begin()
        if not self.dropping and not MARKER.match(data):
            self.keep(at)

    def handle_decl(self, decl: str) -> None:
        self.keep(self.begin())

    def handle_pi(self, data: str) -> None:
        self.handle_data(data)

    def unknown_decl(self, data: str) -> None:
        self.handle_data(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(name)

    def handle_charref(self, name: str) -> None:
        self.handle_data(name)


def clean(page: str | None, url: str | None, sheets: list[str] | None = None) -> tuple[str | None, int, list[str]]:
    """(page, scripts removed, third-party scripts) of a captured page; null pages stay null."""
    if page is None:
        return None, 0, []
    m = re.match(r"https?://([^/?#]+)", url or "")
    cleaner = _Cleaner(m[1] if m else "", frozenset(sheets or ()))
    copied = cleaner.copy(with_emails(page))
    return re.sub(r"<div\b[^>]*\bhidden\b[^>]*>\s*</div>", "", copied), cleaner.removed, cleaner.third


def readable_pages(pages: DataFrame) -> DataFrame:
    """(page_id, html, removed, third_party) of pages (page_id, url, html)."""
    return generate(pages, ["page_id"], ["html", "url"], lambda h, u: [clean(h, u)], "html string, removed int, third_party array<string>")


def attribute_urls(page: str | None) -> list[tuple[str, str, str]]:
    """(tag, attribute, value) of everything in a page that is a URL, for rewriting it as a document of its own."""
    found: list[tuple[str, str, str]] = []

    class Urls(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            found.extend((tag, k, v) for k, v in attrs if v and k in ("href", "src", "srcset", "action", "poster", "data-src"))

        handle_startendtag = handle_starttag

    parser = Urls()
    parser.feed(page or "")
    return found


def url_attributes(pages: DataFrame) -> DataFrame:
    return generate(pages, ["page_id"], ["html"], attribute_urls, "tag string, attribute string, value string")
