"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi.

A leaf block is the text between two tags of block elements. Its features are the tags, classes and ids of its
ancestors, its share of links and the shape of its text. The field is trained on labelled pages that ``labelled_pages``
makes from layout rules.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.llm import crf
from newstide.llm.worker import kept

SIZE = 1 << 15
NAME = r"[a-zA-Z][^\s/>]*"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<{NAME}[^>]*(?:>|\Z)|[^<]+|<", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
#: Elements without text of their own, elements that stand inside a line, and those without an end tag.
RAW = frozenset("script style noscript template iframe object svg canvas audio video select textarea title head annotation annotation-xml".split())
#: Those of RAW whose content is not markup, and the marks that decide where a script ends.
PLAIN = frozenset("script style noscript iframe textarea title".split())
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in PLAIN}
SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>]|\Z)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br img input button math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom merror menclose mfenced msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element and those that its start tag closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SECTIONS = frozenset("article main section nav aside header footer form ul ol table figure dialog".split())
NAMES = 64  # so many distinct tags, and marks, of the ancestors nearest to a block are features of it


@dataclass(frozen=True)
class Place:
    """An open element with what its blocks know of their ancestors; equal parts are shared with the parent."""

    name: str
    tags: tuple[str, ...] = ()  # distinct tags, outermost first
    marks: tuple[str, ...] = ()  # distinct words of classes, ids and roles
    nearest: tuple[str, ...] = ("",)  # the tag, and the marks, of the innermost section or marked ancestor
    above: str = ""  # the tag of the parent

    def inner(self, name: str, marks: tuple[str, ...]) -> Place:
        more = lambda known, new: known if not (fresh := tuple(x for x in dict.fromkeys(new) if x not in known)) else (known + fresh)[-NAMES:]
        nearest = (name, *marks) if marks or name in SECTIONS else self.nearest
        return Place(name, more(self.tags, (name,)), more(self.marks, marks), nearest, self.name)


ROOT = Place("")


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


def _after(page: str, name: str, at: int) -> int | None:
    """Where a page goes on after the content, from ``at``, and the end tag of an element of PLAIN; None without an end tag.

    A script inside a comment of a script has an end tag of its own, unless none would be left.
    """
    end = CLOSERS[name].search(page, at)
    if name == "script" and end and page.find("<!--", at, end.start()) >= 0:
        hidden = inner = False
        place = at
        while mark := SCRIPT.search(page, place):
            place = mark.end()
            if mark.group() == "<!--":
                place -= 2  # its dashes may be those of the end
                hidden = True
            elif mark.group() == "-->":
                hidden = inner = False
            elif not mark.group(1):
                inner = hidden
            elif inner:
                inner = False
            else:
                end = CLOSERS[name].match(page, mark.start())
                break
    return end.end() if end else None


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[Place] = []
    held: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    linked, in_link = 0, False
    skip, inside = "", Counter()  # the element that is passed over and the elements opened in it

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else ROOT, min(linked, len(text))))
            parts.clear()
        linked, in_link = 0, False

    def close(name: str) -> None:
        """Everything down to the innermost open element of that name, which is open."""
        while True:
            gone = stack.pop().name
            held[gone] -= 1
            if gone == name:
                return

    ends: dict[str, int] = {}  # by element, the last end tag of it that was looked up

    def has_end(name: str, at: int) -> bool:
        if ends.get(name, -1) < at and ends.get(name) != len(page):
            found = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            ends[name] = found.start() if found else len(page)
        return ends[name] < len(page)

    at = 0
    endless: set[str] = set()  # elements of PLAIN without an end tag in the rest of the page
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        name = token.group(2)
        if name is None:
            raw = token.group()
            if not skip and (raw[0] != "<" or raw == "<"):
                text = entities.unescape(raw)
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        name, end = name.lower(), token.group(1)
        if skip and end:
            if inside[name] > 0:
                inside[name] -= 1
                continue
            if name == skip or not held[name]:
                skip = "" if name == skip else skip
                continue
            skip = ""  # the end of an element around it
        if skip:
            if name in ("script", "style") and not end and not token.group(3).endswith("/") and name not in endless:
                if (after := _after(page, name, at)) is None:
                    endless.add(name)
                else:
                    at = after
            elif name not in VOID and not token.group(3).endswith("/"):
                inside[name] += 1
            continue
        if name in RAW:
            if not end and not token.group(3).endswith("/"):
                if name in PLAIN:
                    parts.append(" ")
                    after = _after(page, name, at)
                    at = len(page) if after is None else after
                elif name != "head":
                    parts.append(" ")
                    if has_end(name, at):
                        skip, inside = name, Counter()
                else:
                    flush()
            continue
        if name in INLINE:
            if name == "a":
                in_link = not end
            elif name in ("br", "img", "input", "button"):
                parts.append(" ")
            continue
        flush()
        if end:
            if held[name] > 0:
                close(name)
        elif name not in VOID:
            closes = CLOSES.get(name, {"p"})
            while stack and stack[-1].name in closes:
                held[stack.pop().name] -= 1
            found = tuple(w for m in MARKS.findall(token.group(3)) for w in WORDS.findall("".join(m).lower())) if token.group(3) else ()
            stack.append((stack[-1] if stack else ROOT).inner(name, found))
            held[name] += 1
    flush()
    return out


def block_features(block: Block, at: int, n: int) -> list[str]:
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    share = block.linked / size if size else 0.0
    place = block.place
    last = place.name
    out = ["a:" + t for t in place.tags] + ["m:" + w for w in place.marks]
    return out + ["i:" + w for w in place.nearest] + [
        "b:" + (f"{place.above}>{last}" if place.above else last), "t:" + last, "l:" + str(min(size.bit_length(), 10)), "k:" + str(int(share * 4)), "w:" + str(min(words.bit_length(), 6)),
        "e:" + (text[-1] if not text[-1].isalnum() else "x"), "c:" + str(min(sum(map(text.count, ".,;:")), 4)), "r:" + str("©" in text or "copyright" in text.lower()),
        "f:" + str(at == 0), "z:" + str(at == n - 1),
    ]


class Features:
    """Rows of hashed features padded with a number of no weight, for as many as a block has."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def rows(self, pages: list[list[Block]]) -> np.ndarray:
        rows = [[self._of(f) for f in block_features(b, k, len(p))] for p in pages for k, b in enumerate(p)]
        width = max(map(len, rows), default=1)
        return np.array([r + [SIZE] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)

    def _of(self, feature: str) -> int:
        if feature not in self.number:
            if len(self.number) > 100_000:
                self.number.clear()
            self.number[feature] = crf.hashed([feature], SIZE)[0]
        return self.number[feature]


#: Words that layouts use as classes, ids or headings, by the part of a page.
PARTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination", "pager", "tabs"],
    "header": ["header", "masthead", "banner", "logo", "site", "top", "head", "brand"],
    "footer": ["footer", "foot", "copyright", "legal", "bottom", "colophon"],
    "side": ["sidebar", "aside", "widget", "related", "rail", "popular", "trending", "recommended", "more", "tags"],
    "notice": ["cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense"],
    "form": ["form", "login", "search", "signup", "contact", "share", "social"],
    "comment": ["comments", "comment", "reply", "replies", "discussion", "respond", "disqus", "commentlist", "reader"],
    "main": ["content", "article", "post", "entry", "story", "body", "main", "text", "page"],
}
SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()


def labelled_pages(pages: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks, made from layout rules: the training set."""
    dice = random.Random(seed)

    def word() -> str:
        return "".join(dice.choice(SYLLABLES) for _ in range(dice.randint(1, 4)))

    def sentence(low: int = 1, high: int = 14) -> str:
        text = " ".join(word() for _ in range(dice.randint(low, high)))
        return text[:1].upper() + text[1:] + dice.choice("....!?")

    def prose(most: int = 5) -> str:
        return " ".join(sentence() for _ in range(dice.randint(1, most)))

    def mark(part: str, sure: bool = False) -> str:
        if not sure and dice.random() < 0.15:
            return ""
        return f' {dice.choice(["class", "class", "id"])}="{" ".join(dice.sample(PARTS[part], dice.choice([1, 1, 2])))}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))

    def boiler(part: str) -> str:
        if part == "nav":
            tag = dice.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{mark(part, tag != 'nav')}><ul>{links(dice.randint(2, 8))}</ul></{tag}>"
        if part == "header":
            tag = dice.choice(["header", "div"])
            return f"<{tag}{mark(part, tag == 'div')}>{dice.choice([f'<h1>{word()}</h1>', f'<p>{sentence()}</p>', f'<div>{word()} {word()}</div>', sentence()])}</{tag}>"
        if part == "footer":
            tag = dice.choice(["footer", "footer", "div"])
            inner = dice.choice([f"&copy; 2020 {word()} &middot; {prose(2)}", f"<p>&copy; {word()}</p><p>{prose(2)}</p>", f"<ul>{links(3)}</ul>{sentence()}", prose(2)])
            return f"<{tag}{mark(part, tag == 'div')}>{inner}</{tag}>"
        if part == "side":
            tag = dice.choice(["aside", "aside", "div", "section"])
            inner = dice.choice([f"<h3>{word()}</h3><ul>{links(4)}</ul>", f"<h2>{word()}</h2><p>{prose(2)}</p>", f"<p>{sentence()}</p>", sentence()])
            return f"<{tag}{mark(part, tag != 'aside')}>{inner}</{tag}>"
        if part == "form":
            tag = dice.choice(["form", "form", "div"])
            return f'<{tag}{mark(part, tag == "div")}><label>{word()}</label><input name="q"><button>{word()}</button>{dice.choice(["", f"<p>{sentence()}</p>"])}</{tag}>'
        if part == "comment":
            tag, item = dice.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("section", "article")])
            inner = "".join(f"<{item}{mark(part, item == 'article')}>{dice.choice([f'<p>{prose(3)}</p>', f'<b>{word()}</b> {prose(2)}', f'<p>{word()}:</p><p>{prose(2)}</p>'])}</{item}>" for _ in range(dice.randint(1, 4)))
            return f"<{tag}{mark(part, True)}>{dice.choice(['', f'<h3>{word()}</h3>'])}{inner}</{tag}>"
        tag = dice.choice(["div", "div", "section", "p"])
        return f"<{tag}{mark(part, True)}>{dice.choice([prose(2), sentence()]) if tag == 'p' else dice.choice([prose(2), sentence(), f'<p>{prose(2)}</p>', f'<span>{sentence()}</span>'])}</{tag}>"

    def main_blocks() -> tuple[str, list[str]]:
        out, texts = [], []

        def add(markup: str, *held: str) -> None:
            out.append(markup)
            texts.extend(held)

        if dice.random() < 0.8:
            title = sentence(1, 8)[:-1]
            add(f"<h1>{title}</h1>", title)
        for _ in range(dice.randint(0, 9)):
            text = prose() if dice.random() < 0.7 else word()
            kind = dice.random()
            if kind < 0.6:
                add(f"<p>{text}</p>", text)
            elif kind < 0.72:
                add(f"<p><b>{text}<br>", text)
            elif kind < 0.78:
                inside = word()
                add(f'<p>{text} <a href="/{word()}">{inside}</a></p>', f"{text} {inside}")
            elif kind < 0.83:
                add(f"<h2>{word()}</h2>", "")
                texts[-1] = out[-1][4:-5]
            elif kind < 0.88:
                items = [sentence() for _ in range(dice.randint(1, 4))]
                add("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>", *items)
            elif kind < 0.92:
                add(f"<blockquote>{text}</blockquote>", text)
            elif kind < 0.95:
                add(f"<table><tr><td>{text}</td><td>{(other := sentence())}</td></tr></table>", text, other)
            else:
                add(boiler(dice.choice(["ad", "side", "form", "notice", "comment"])))
        return "".join(out), texts

    made = []
    for _ in range(pages):
        tag = dice.choice(["article"] * 5 + ["main", "main", "div", "div", "section"])
        inner, texts = main_blocks()
        body = f"<{tag}{mark('main', True) if tag in ('div', 'section') or dice.random() < 0.3 else ''}>{inner}</{tag}>"
        if dice.random() < 0.25:
            body = f"<{(outer := dice.choice(['main', 'div', 'section']))}{mark('main') if dice.random() < 0.5 else ''}>{body}</{outer}>"
        much = dice.choice([0.0, 0.15, 0.5, 0.5, 0.5])
        before = [boiler(p) for p in ("header", "nav", "ad", "notice", "form", "side") if dice.random() < much]
        after = [boiler(p) for p in ("side", "comment", "form", "ad", "notice", "footer") if dice.random() < much]
        dice.shuffle(before)
        end = "</body></html>" if dice.random() < 0.8 else ""
        made.append((f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}<!-- {word()} -->{body}{''.join(after)}{end}", texts))
    return made


def fit(pages: list[tuple[str, list[str]]] | None = None, rounds: int = 120) -> crf.Chain:
    """The field from labelled pages: a block is main text if it is the next of the page's texts."""
    pages = labelled_pages() if pages is None else pages
    parsed, gold = [], []
    for page, texts in pages:
        found, at = blocks(page), 0
        for b in found:
            hit = at < len(texts) and b.text == texts[at]
            gold.append(int(hit))
            at += hit
        parsed.append(found)
    rows = Features().rows(parsed)
    return crf.train(rows, np.arange(len(rows)), np.array(gold), np.array([len(p) for p in parsed]), 2, SIZE + 1, rounds, decay=1e-5)


def main_text(pages: list[str | None], chain: crf.Chain, features: Features) -> list[str]:
    parsed = [blocks(p or "") for p in pages]
    lengths = np.array([len(p) for p in parsed], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    label = crf.viterbi(chain, crf.emissions(chain, features.rows(parsed)), lengths)
    out, at = [], 0
    for p in parsed:
        out.append("\n".join(b.text for b, y in zip(p, label[at : at + len(p)], strict=True) if y))
        at += len(p)
    return out


def extract(pages: DataFrame, chain: crf.Chain | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each whole page: its blocks in page order, joined by one newline.

    Character references are decoded, white space inside a block becomes one space, and nothing else is dropped. A
    null or empty page, and one without main text, has an empty text. A column called ``out`` is replaced, all others
    stay. Rows are independent of each other.
    """
    chain = chain or fit()
    chain = crf.Chain(chain.weights.astype(np.float32), chain.moves, chain.begins)
    chain.weights[SIZE] = 0

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = kept(("html features",), Features)
        for part in parts:
            texts: list[str] = []
            for at in range(0, len(part), 128):
                texts += main_text(part.slice(at, 128).to_pylist(), chain, features)
            yield pa.array(texts, pa.string())

    return pages.withColumn(out, run(F.col(html)))
