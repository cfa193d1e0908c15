"""A scanner of Markdown: the languages of a text's fenced blocks, and the addresses that its links lead to.

Blocks are found line by line, with quotes and list items as containers; inline text is read for code spans, links, images,
autolinks and bare addresses. HTML is text, as it is where raw HTML is off. The cells of a table are read with the line that
they stand in.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from urllib.parse import quote

FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
HEADING = re.compile(r"#{1,6}(?=\s|$)")
UNDERLINE = re.compile(r"(=+|-+)\s*$")
RULE = re.compile(r"(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=\s|$)")
PREFIX = re.compile(r"[\s>*+\-0-9.)]*")
TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
DEFINITION = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]*\n[ \t]*|[ \t]+)(?:{TITLE}))?[ \t]*(?:\n|$)", re.S)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
LINK_END = re.compile(rf"(?:\s+(?:{TITLE}))?\s*\)", re.S)
SPECIAL = re.compile(r"[\\`<\[\]!]")
TICKS = re.compile("`+")
ANGLED = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
AUTOLINK = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^<>\x00-\x20]*)>")
AUTOMAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)*)>")
_HOST = r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+([^\W\d_]{2,})"
BARE = re.compile(rf"(?i)(?<!\w)((?:https?|ftp)://[^\s<>]+|mailto:[^\s<>@]+@[^\s<>]+)|(?<![\w.@+-])([\w.+-]+@{_HOST})(?![\w@-])|(?<![\w.:/@\\-])({_HOST}(?::\d{{1,5}})?(?:[/?#][^\s<>]*)?)(?![\w@-])")
#: Endings of hosts that are taken for addresses without a scheme, beside those of countries (fixed values).
ENDINGS = "biz com edu gov net org pro web xxx aero asia coop info museum name shop рф".split()
#: Depth to which brackets in a destination may nest.
NESTED = 32


class Blocks:
    """The blocks of a text, fed line by line: `languages` of its fences, `inlines` (paragraphs and headings), `labels` of its link definitions."""

    def __init__(self, text: str) -> None:
        self.languages: list[str] = []
        self.inlines: list[str] = []
        self.labels: dict[str, str] = {}
        self.containers: list[int | None] = []  # a quote, or the columns that an item's content is indented by
        self.bare_item = False  # the innermost item has no content yet
        self.paragraph: list[str] = []
        self.fence: tuple[str, int] | None = None
        for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            self.feed(line)
        self.end_paragraph()

    def feed(self, line: str) -> None:
        if "\t" in line:
            prefix = PREFIX.match(line).group()
            line = prefix.expandtabs(4) + line[len(prefix) :]
        rest, matched = self.inside(line)
        if self.fence:
            if matched == len(self.containers):
                mark, length = self.fence
                body = rest.strip(" \t")
                if len(rest) - len(rest.lstrip(" ")) <= 3 and len(body) >= length and not body.strip(mark):
                    self.fence = None
                return
            self.fence = None
        opened = False
        while True:
            body = rest.lstrip(" ")
            indent = len(rest) - len(body)
            if not body.strip():
                self.end_paragraph()
                del self.containers[matched:]
                if self.bare_item and not opened:
                    self.containers.pop()
                self.bare_item = opened and bool(self.containers) and self.containers[-1] is not None
                return
            running = bool(self.paragraph) and not opened
            if indent >= 4:
                if not running:
                    self.close(matched)  # indented code
                    return
                break
            if body[0] == ">":
                self.close(matched)
                self.containers.append(None)
                rest = body[2:] if body[1:2] == " " else body[1:]
            elif fence := FENCE.match(body):
                self.close(matched)
                mark = fence[1] or fence[3]
                self.fence = mark[0], len(mark)
                self.languages.append((unescaped(fence[2] or fence[4] or "").split() or [""])[0])
                return
            elif heading := HEADING.match(body):
                self.close(matched)
                self.inlines.append(body[heading.end() :].strip())
                return
            elif running and matched == len(self.containers) and UNDERLINE.match(body):
                self.close(matched)
                return
            elif RULE.match(body):
                self.close(matched)
                return
            elif (item := ITEM.match(body)) and not (running and matched == len(self.containers) and (not body[item.end() :].strip() or item[1][:-1] not in ("", "1"))):
                self.close(matched)
                after = body[item.end() :]
                spaces = len(after) - len(after.lstrip(" "))
                wide = 1 if not after.strip() or spaces >= 5 else spaces
                self.containers.append(indent + item.end() + wide)
                rest = after[wide:]
            else:
                break
            opened, matched = True, len(self.containers)
        if not (self.paragraph and not opened):
            self.close(matched)
        self.bare_item = False
        self.paragraph.append(rest.strip())

    def inside(self, line: str) -> tuple[str, int]:
        """The line within the containers that go on, and how many do."""
        rest = line
        for n, container in enumerate(self.containers):
            body = rest.lstrip(" ")
            indent = len(rest) - len(body)
            if container is None:
                if indent > 3 or body[:1] != ">":
                    return rest, n
                rest = body[2:] if body[1:2] == " " else body[1:]
            elif body.strip():
                if indent < container:
                    return rest, n
                rest = rest[container:]
        return rest, len(self.containers)

    def close(self, matched: int) -> None:
        self.end_paragraph()
        del self.containers[matched:]
        self.bare_item = False

    def end_paragraph(self) -> None:
        text, self.paragraph = "\n".join(self.paragraph), []
        while (found := DEFINITION.match(text)) and found[1].strip():
            self.labels.setdefault(label_key(found[1]), found[2][1:-1] if found[2][0] == "<" else found[2])
            text = text[found.end() :]
        if text.strip():
            self.inlines.append(text)


def unescaped(text: str) -> str:
    return unescape(re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: f"&#{ord(m[1])};", text))


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def address(text: str) -> str | None:
    """An address as it stands in a page, characters that it may not hold percent-encoded; None for schemes that aren't let through."""
    href = quote(re.sub(r"%(?![0-9A-Fa-f]{2})", "%25", text.strip()), safe="%;/?:@&=+$,-_.!~*'()#")
    low = href.lower()
    if re.match(r"(?:vbscript|javascript|file|data):", low) and not re.match(r"data:image/(?:gif|png|jpeg|webp);", low):
        return None
    return href


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(address, end) of the round brackets that open at `at`: a destination with at most one title behind it."""
    at += 1
    while text[at : at + 1] and text[at] in " \t\n":
        at += 1
    start = at
    if text[at : at + 1] == "<":
        found = ANGLED.match(text, at)
        if not found:
            return None
        raw, at = found[1], found.end()
    else:
        depth = 0
        while at < len(text) and text[at] > " " and text[at] != "\x7f":
            if text[at] == "\\" and text[at + 1 : at + 2] > " ":
                at += 1
            elif text[at] == "(":
                depth += 1
                if depth > NESTED:
                    return None
            elif text[at] == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        if depth:
            return None
        raw = text[start:at]
    end = LINK_END.match(text, at)
    href = address(unescaped(raw))
    return (href, end.end()) if end and href is not None else None


def trimmed(text: str) -> str:
    """A bare address without the punctuation and closing brackets behind it that aren't its own."""
    while text:
        last = text[-1]
        if last in ".,;:!?'\"*_~" or (last in ")]}" and text.count(last) > text.count("([{"[")]}".index(last)])):
            text = text[:-1]
        else:
            break
    return text


def links(text: str, labels: dict[str, str], endings: frozenset[str]) -> list[str]:
    """The addresses of the links of one inline text; images aren't links."""
    found: list[tuple[int, str]] = []
    apart: list[tuple[int, int]] = []  # what isn't plain text
    openers: list[list] = []  # place, whether of an image, whether it may still open a link
    ticks = defaultdict(list)
    for run in TICKS.finditer(text):
        ticks[run.end() - run.start()].append(run.start())
    at = 0
    while special := SPECIAL.search(text, at):
        at, mark = special.start(), special.group()
        if mark == "\\":
            apart.append((at, at + 2))
            at += 2
        elif mark == "`":
            size = TICKS.match(text, at).end() - at
            own = ticks[size]
            close = bisect_left(own, at + size)
            if close < len(own):
                apart.append((at, own[close] + size))
                at = own[close] + size
            else:
                at += size
        elif mark == "<":
            if (auto := AUTOLINK.match(text, at)) and (href := address(auto[1])) is not None:
                found.append((at, href))
            elif auto := AUTOMAIL.match(text, at):
                found.append((at, address(f"mailto:{auto[1]}")))
            if auto:
                apart.append((at, auto.end()))
            at = auto.end() if auto else at + 1
        elif mark == "!":
            if text[at + 1 : at + 2] == "[":
                openers.append([at, True, True])
                at += 1
            at += 1
        elif mark == "[":
            openers.append([at, False, True])
            at += 1
        else:
            opener = openers.pop() if openers else None
            hit = closed(text, opener, at, labels) if opener and opener[2] else None
            if not hit:
                at += 1
                continue
            start, image, _ = opener
            if image:
                while found and found[-1][0] >= start:
                    found.pop()
            else:
                found.append((start, hit[0]))
                for other in openers:
                    other[2] = other[2] and other[1]
            apart.append((start, hit[1]))
            at = hit[1]
    hrefs, low = [href for _, href in found], 0
    for start, end in [*sorted(apart), (len(text), len(text))]:
        if start > low:
            hrefs += bare(text[low:start], endings)
        low = max(low, end)
    return hrefs


def closed(text: str, opener: list, at: int, labels: dict[str, str]) -> tuple[str, int] | None:
    """(address, end) of the link or image whose text ends at `at`, if it is one."""
    if text[at + 1 : at + 2] == "(" and (found := destination(text, at + 1)):
        return found
    inner, end = text[opener[0] + 1 + opener[1] : at], at + 1
    if (full := LABEL.match(text, at + 1)) and text[at + 1 : at + 2] == "[":
        end = full.end()
        inner = full[1] if full[1].strip() else inner
    if len(inner) > 999 or not LABEL.fullmatch(f"[{inner}]"):
        return None
    target = labels.get(label_key(inner))
    href = address(unescaped(target)) if target is not None else None
    return (href, end) if href is not None else None


def bare(text: str, endings: frozenset[str]) -> list[str]:
    """The addresses in plain text: with a scheme, of mail, or a host with a known ending."""
    hrefs = []
    if "." not in text and "://" not in text:
        return hrefs
    for m in BARE.finditer(text):
        if m[1]:
            href = trimmed(m[1])
            if re.fullmatch(r"(?i)(?:https?|ftp)://|mailto:", href) or not re.search(r"\w", href.partition(":")[2]):
                continue
        elif m[2]:
            if m[3].lower() not in endings:
                continue
            href = f"mailto:{m[2]}"
        else:
            if m[5].lower() not in endings:
                continue
            href = f"http://{trimmed(m[4])}"
        hrefs.append(address(href))
    return hrefs


def scan(text: str | None, endings: frozenset[str]) -> tuple[list[str], list[str]]:
    """(languages of the fenced blocks, addresses of the links) of one text."""
    blocks = Blocks((text or "").replace("\x00", "\ufffd"))
    return blocks.languages, [href for inline in blocks.inlines for href in links(inline, blocks.labels, endings)]
