"""Markup residue: find it and turn pages into clean text that keeps headings, lists, tables, code and formulas.

A page is cut into the leaf blocks of its document tree: pieces of text and pieces that may be markup, each with the path
of elements, environments, tables or fences that are open around it; end tags that may be left out are implied. A linear-chain conditional random field labels the sequence from the block's form, its
surroundings and its ancestors; Viterbi picks the best labels. The field is trained on generated pages whose labels are
known: prose with HTML, Markdown, wiki text and LaTeX in many combinations, and prose with signs that people type.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.tables import of_last_delivery

#: TEXT: prose. MARK: markup to drop. ENTITY: a character reference. INLINE: emphasis or link, its words stay. The rest
#: is content by its role.
LABELS = ("TEXT", "MARK", "ENTITY", "INLINE", "TITLE", "ITEM", "CODE", "FORMULA", "CELL", "QUOTE")
BUCKETS = 1 << 12
#: Attributes that stand without a value. Other bare words after a name are prose between two signs.
_BARE = "checked|disabled|hidden|selected|readonly|required|multiple|async|defer|controls|loop|muted|autoplay|nowrap|noshade|compact|open|ismap|novalidate|autofocus"
#: An attribute with its value.
_VALUED = r"[A-Za-z_:@][\w:.@-]*\s*=\s*(?:\"[^\"<>\n]*\"|'[^'<>\n]*'|[^\s<>\"'|]+)"
_PIECES = (
    ("fence", r"(?m:^[ \t]*(?:```|~~~)[^\n`]*$)"),
    ("comment", r"<!--.*?(?:-->|$)|<!\[CDATA\[|<![A-Za-z][^>]*>|<\?[a-z][^>]*\?>"),
    ("tag", rf"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+)|(?:{_BARE})(?=[\s/>])))*\s*/?>"),
    ("cut_tag", r"<[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"<>\n]*\"|'[^'<>\n]*'|[\"'][\w:/.#-]*|[^\s<>\"']+))+|</[A-Za-z][A-Za-z0-9]*|<(?:br|hr|p|div|span|li|ul|ol|img|a|b|i|td|tr|table|font|pre|code|h[1-6])\b(?=\s*(?:/?$|/|\n))"),
    ("entity", r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"),
    ("template", r"\{\{[^{}\n]*\}\}"),
    ("wiki_link", r"\[\[[^\[\]\n]*\]\]"),
    ("ext_link", r"\[(?:https?|ftp)://[^\]\s]+(?:\s[^\]\n]*)?\]"),
    ("image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("link", r"\[[^\[\]\n]+\]\((?:[^()\s]+)(?:\s\"[^\"\n]*\")?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    ("tick", r"``[^\n]+?``|`[^`\n]+`"),
    ("strong", r"\*\*[^*\n]+\*\*|(?<!\w)__[^_\n]+__(?!\w)|~~[^~\n]+~~"),
    ("quotes", r"'{2,5}(?=\S)[^'\n]+(?:'(?!')[^'\n]+)*'{2,5}"),
    ("formula", r"\$\$[^$]+\$\$|\$(?!\s)[^$\n]*[\\^_{}][^$\n]*(?<!\s)\$(?![0-9])|\\\((?:(?!\\\()[^\n])*?\\\)|\\\[(?:(?!\\\[).)*?\\\]"),
    ("environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    ("heading_command", r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|title)\*?\{[^{}]*\}"),
    ("text_command", r"\\(?:text[a-z]{2}|emph|underline|mbox|footnote|href\{[^{}]*\}|url)\{[^{}]*\}"),
    ("command", r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+|\\(?:item|maketitle|centering|newline|noindent|par|ldots|dots|LaTeX|TeX|hline|label|quad|cdot|times)\b"),
    ("escape", r"\\[%&$#_{}](?=\W|$|\w)"),
    ("setext", r"(?m:^(?![ \t]*[-=|>#*+])[^\n<>|]{1,120}\n[ \t]*(?:={3,}|-{3,})[ \t]*$)"),
    ("heading", r"(?m:^[ \t]*#{1,6}[ \t]+(?=\S))"),
    ("wiki_heading", r"(?m:^[ \t]*(={2,6})[^=\n]+\1[ \t]*$)"),
    ("marker", r"(?m:^[ \t]*(?:[-*+]|[0-9]{1,3}[.)])[ \t]+(?=\S))"),
    ("quote", r"(?m:^[ \t]*>+[ \t]?(?=\S))"),
    ("table_mark", rf"(?m:^[ \t]*(?:(?:\{{\||\|-+)(?:[ \t]*{_VALUED})*|\|\}})[ \t]*$)"),
    ("row", r"(?m:^[ \t]*\|[^\n]*\|[ \t]*$)"),
    ("cell", r"(?m:^[ \t]*[|!][ \t+]*(?=\S))"),
    ("rule", r"(?m:^[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$)"),
    ("slant", r"(?<![\w*])\*[^\s*][^*\n]*[^\s*]\*(?![\w*])|(?<![\w_])_[^\s_][^_\n]*[^\s_]_(?![\w_])"),
    ("sign", r"[<>&*_#`\[\]{}\\|~=^]+"),
)
#: The backreference of wiki_heading is by name, as the pieces share one pattern.
#: A page without any of this holds no piece: signs that every piece but a few needs, and the others' line starts and quotes.
TRIGGER = r"[<>&*_#`\[\]{}\\|~=^]|''|\$\$|(?m:^[ \t]*(-{3}|[-+!][ \t+]*[^ \t\n]|[0-9]{1,3}[.)][ \t]))"
PIECE = re.compile("|".join(f"(?P<{n}>{p.replace('(={2,6})', '(?P<eq>={2,6})').replace(chr(92) + '1', '(?P=eq)')})" for n, p in _PIECES), re.DOTALL)
_FENCE = re.compile(_PIECES[0][1])
_TAG_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source"}
#: Open elements that a start tag ends, as their own end tags may be left out: fixed values.
_CELLS = ("td", "th", "p")
_IMPLIED = {"li": ("li", "p"), "p": ("p",), "td": _CELLS, "th": _CELLS, "tr": ("tr", *_CELLS), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), **dict.fromkeys(("div", "ul", "ol", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"), ("p",))}
_WORD = re.compile(r"\w+")
#: Elements and environments that give their content a role.
ROLES = {
    "pre": "CODE", "code": "CODE", "verbatim": "CODE", "lstlisting": "CODE", "fence": "CODE", "tt": "CODE", "kbd": "CODE",
    "li": "ITEM", "itemize": "ITEM", "enumerate": "ITEM", "td": "CELL", "th": "CELL", "tabular": "CELL", "h1": "TITLE", "h2": "TITLE", "h3": "TITLE",
    "h4": "TITLE", "h5": "TITLE", "h6": "TITLE", "title": "TITLE", "blockquote": "QUOTE", "quote": "QUOTE", "equation": "FORMULA", "align": "FORMULA", "math": "FORMULA",
}


@dataclass
class Block:
    kind: str
    text: str
    start: int
    ancestors: tuple[str, ...]
    line_start: bool
    before: str
    after: str


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; together they are the page."""
    out: list[Block] = []
    opened: list[str] = []
    line_role = ""
    at = 0

    def add(kind: str, start: int, end: int) -> None:
        around = (*opened, line_role) if line_role else tuple(opened)
        before, after = page[start - 1 : start], page[end : end + 1]
        out.append(Block(kind, page[start:end], start, tuple(around), start == 0 or before == "\n", before, after))

    def prose(start: int, end: int) -> None:
        nonlocal line_role
        while start < end:
            cut = page.find("\n", start, end) if line_role else -1
            stop = end if cut < 0 else cut + 1
            add("prose", start, stop)
            if cut >= 0:
                line_role = ""
            start = stop

    for match in PIECE.finditer(page):
        kind, (start, end) = match.lastgroup, match.span()
        if start < at:  # inside a fence
            continue
        if kind == "eq":
            kind = "wiki_heading"
        prose(at, start)
        if "\n" in page[max(0, start - 1) : start]:
            line_role = ""
        if kind == "fence":
            add(kind, start, end)
            if closing := _FENCE.search(page, end):
                opened.append("fence")
                add("prose", end, closing.start())
                opened.pop()
                add(kind, *closing.span())
                end = closing.end()
        elif kind in ("tag", "cut_tag"):
            add(kind, start, end)
            name = _TAG_NAME.match(match[0])
            closing, tag = (name[1], name[2].lower()) if name else ("", "")
            if closing and tag in opened:
                while opened.pop() != tag:
                    pass
            elif name and not closing and tag not in _VOID and not match[0].endswith("/>") and kind == "tag":
                ends = _IMPLIED.get(tag, ())
                while opened and opened[-1] in ends:
                    opened.pop()
                opened.append(tag)
        elif kind == "environment":
            add(kind, start, end)
            name = match[0][match[0].index("{") + 1 : match[0].index("}")].rstrip("*")
            if match[0].startswith("\\begin"):
                opened.append(name)
            elif name in opened:
                while opened.pop() != name:
                    pass
        elif kind == "table_mark":
            add(kind, start, end)
            if "{|" in match[0]:
                opened.append("wikitable")
            elif "|}" in match[0] and "wikitable" in opened:
                while opened.pop() != "wikitable":
                    pass
        else:
            add(kind, start, end)
            if kind in ("heading", "marker", "quote", "cell"):
                line_role = kind
        at = end
    prose(at, len(page))
    return out


def _shape(text: str) -> str:
    return "".join(dict.fromkeys("a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c for c in text[:40]))[:8]


def _class(c: str) -> str:
    return "^" if not c else "a" if c.isalpha() else "9" if c.isdigit() else "n" if c == "\n" else " " if c.isspace() else c


@lru_cache(maxsize=200_000)
def _bucket(name: str) -> int:
    value = 2166136261
    for byte in name.encode("utf-8"):
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value % BUCKETS


def features(page: list[Block]) -> list[list[int]]:
    """Hashed features of each block: form, neighbours, ancestors, frequency on the page."""
    counts: dict[str, int] = {}
    for b in page:
        counts[b.kind] = counts.get(b.kind, 0) + 1
    out = []
    for i, b in enumerate(page):
        kind = b.kind
        role = next((a for a in reversed(b.ancestors) if a in ROLES or a in ("heading", "marker", "quote", "cell", "wikitable")), "")
        names = ["bias", f"kind {kind}", f"kind {kind} role {role}", f"role {role}", f"kind {kind} line {b.line_start}", f"kind {kind} many {min(3, counts[kind])}", f"path {kind} {' '.join(b.ancestors[-2:])}"]
        names += [f"before {page[i - 1].kind if i else ''} {kind}", f"after {page[i + 1].kind if i + 1 < len(page) else ''} {kind}", f"up {b.ancestors[-1] if b.ancestors else ''} {kind}"]
        if kind != "prose":
            names += [f"shape {kind} {_shape(b.text)}", f"edges {kind} {_class(b.before)}{_class(b.after)}", f"first {kind} {b.text[:1]} {_class(b.before)}{_class(b.after)}"]
            if kind in ("tag", "cut_tag") and (m := _TAG_NAME.match(b.text)):
                names.append(f"tag {m[2].lower()} {kind}")
        else:
            words = len(_WORD.findall(b.text))
            names += [f"words {min(4, words)} {role}", f"end {_class(b.text.rstrip()[-1:])}"]
        out.append([_bucket(n) for n in names])
    return out


@dataclass(frozen=True)
class ChainField:
    """Weights of a linear-chain conditional random field: (bucket, label) and (label, next label)."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in page])

    def decode(self, page: list[list[int]]) -> list[int]:
        """The best label sequence (Viterbi)."""
        emit = self.scores(page)
        best, back = emit[0], []
        for row in emit[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        labels = [int(best.argmax())]
        for pointers in reversed(back):
            labels.append(int(pointers[labels[-1]]))
        return labels[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.2, penalty: float = 1e-3) -> ChainField:
    """Maximum conditional likelihood by gradient steps (Adam) over all pages at once, padded to the longest."""
    size, count = len(LABELS), len(pages)
    lengths = np.array([len(f) for f, _ in pages])
    longest = int(lengths.max())
    mask = np.arange(longest) < lengths[:, None]
    gold = np.zeros((count, longest), int)
    gold[mask] = [label for _, y in pages for label in y]
    per_block = np.array([len(x) for f, _ in pages for x in f])
    used, flat = np.unique([b for f, _ in pages for x in f for b in x], return_inverse=True)
    first = np.concatenate(([0], np.cumsum(per_block)[:-1]))
    owner = np.repeat(np.arange(len(per_block)), per_block)
    by_feature = np.argsort(flat, kind="stable")
    edges = np.searchsorted(flat[by_feature], np.arange(len(used)))
    owner = owner[by_feature]
    weights = [np.zeros((len(used), size)), np.zeros((size, size))]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    wanted = np.zeros((count, longest, size))
    wanted[np.arange(count)[:, None], np.arange(longest), gold] = mask
    seen_moves = np.zeros((size, size))
    np.add.at(seen_moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1.0)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        emit, move = weights
        scores = np.zeros((count, longest, size))
        scores[mask] = np.add.reduceat(emit[flat], first, axis=0)
        forward, backward = scores.copy(), np.zeros_like(scores)
        for t in range(1, longest):
            on = mask[:, t]
            forward[~on, t] = forward[~on, t - 1]
            forward[on, t] += logsum(forward[on, t - 1, :, None] + move, 1)
        expected = np.zeros_like(move)
        total = logsum(forward[:, -1], 1)
        for t in range(longest - 1, 0, -1):
            on = mask[:, t]
            ahead = move + (scores[on, t] + backward[on, t])[:, None, :]
            backward[on, t - 1] = logsum(ahead, 2)
            expected += np.exp(forward[on, t - 1, :, None] + ahead - total[on, None, None]).sum(axis=0)
        node = np.exp(np.minimum(0.0, forward + backward - total[:, None, None]))
        residual = (wanted - node)[mask]
        grads = (np.add.reduceat(residual[owner], edges, axis=0), seen_moves - expected)
        for weight, grad, (mean, square) in zip(weights, grads, state, strict=True):
            grad = grad / count - penalty * weight
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            weight += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros((BUCKETS, size))
    whole[used] = weights[0]
    return ChainField(whole, weights[1])


class PageMaker:
    """Labelled pages: (text, label of each character)."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.parts: list[tuple[str, str]] = []

    def word(self) -> str:
        syllables = ("ka", "lo", "mi", "ter", "ran", "sol", "ve", "den", "pur", "ist", "on", "ge")
        return "".join(self.rng.choice(syllables) for _ in range(self.rng.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(3, 12).capitalize() + self.rng.choice((".", ".", ".", "!", "?"))
        if self.rng.random() < 0.15:
            text = self.words(1, 4) + f" ${self.rng.randint(1, 99)} " + text
        return text.upper() if self.rng.random() < 0.05 else text

    def typed_sign(self) -> str:
        """Signs as people type them, in words."""
        a, b, n, m = self.word(), self.word(), self.rng.randint(1, 99), self.rng.randint(1, 99)
        return self.rng.choice((
            f"{a} <{n} {b}", "I <3 it.", f"{a} < {b} and {b} > {a}.", f"under < {n} or > {m}.", f"{a[0].upper()}&{b[0].upper()} {a}", f"{a} & {b} {a}.", f"{n} * {m} {a}",
            f"{n}* {a}", f"{a}* {b}", f"#{n} {a}", f"{a} #{n}", f"{a}_{b}_{n} {a}", f"c:\\{a}\\{b}", f"\\o/ {a}", f"{{{a}}} {b}", f"[{a} {b}: {a}]", f"[{a}] {b}", f"[{n}] {a}",
            f"~{n} {a}", f"~ {a}", f"{a} >> {b}.", f"{a} -> {b}", f"{a} => {b}", f"{a} = {b}", f"{n}={m}", f"{a} == {b}", "(^_^)", "^^ " + a, f"{a} | {b}", f"{a}|{b}", f"-- {a}", f"*{a}", f"{a} *_* {b}",
            f"${n}.{m}", f"${n}-${m}", f"$$$ {a}", f"{n} ^ {m}", f"{n}^{m}", f"<{a}@{b}>", f"<-- {a}", f"<< {a} >>", f"<{a}, {b}", f"a<b {a}", f"{a}&{b}", f"`{a}", f"''{a}", f"{n}'' {a}", f"'{a}' {b}", f"@{a} {b}", f"100% {a}",
            f"\\{a}/", f"\\{n}", f"{a}\\{b}", f"{{{n}}}", f"{{{a}", f"]{a}[", f">.< {a}", f":> {a}", f"#{a}", f"{a}#", "***", f"*** {a}", f"**{n}", f"_{a}", f"{a}_",
            f"{a} <{b} or {b}> {a}.", f"! {a}", f"| {a}", f"{a} {{| {b}", f"--- {a}", f"{a} ---", f"{n} * {m} * {n}",
        ))

    def add(self, label: str, text: str) -> None:
        self.parts.append((label, text))

    def prose(self, sentences: int) -> None:
        for _ in range(sentences):
            self.add("TEXT", self.typed_sign() + " " if self.rng.random() < 0.3 else self.sentence() + " ")

    def construct(self) -> None:
        rng, add = self.rng, self.add
        url = f"http{rng.choice(('', 's'))}://{self.word()}.{self.word()}/{self.word()}"
        pick = rng.randint(0, 34)
        if pick == 0:
            add("MARK", rng.choice(("<br>", "<br />", "<BR/>", "<hr>", "<br/><br/>"[:5])))
        elif pick == 1:
            for _ in range(rng.randint(1, 3)):
                add("MARK", "<p>")
                add("TEXT", self.sentence())
                add("MARK", "</p>")
        elif pick == 2:
            tag = rng.choice(("b", "i", "em", "strong", "u", "span", "font", "small", "ref", "sup"))
            add("MARK", f"<{tag}>")
            add("TEXT", self.words(1, 3))
            add("MARK", f"</{tag}>")
        elif pick == 3:
            add("MARK", rng.choice(("<ul>", "<ol>")))
            for _ in range(rng.randint(1, 4)):
                add("MARK", "<li>")
                add("ITEM", self.sentence())
                add("MARK", "</li>")
            add("MARK", "</ul>")
        elif pick == 4:
            tag = rng.choice(("h1", "h2", "h3", "h4"))
            add("MARK", f"<{tag}>")
            add("TITLE", self.words(1, 3))
            add("MARK", f"</{tag}>")
        elif pick == 5:
            add("MARK", "<table>")
            add("MARK", "<tr>")
            for _ in range(rng.randint(1, 3)):
                add("MARK", "<td>")
                add("CELL", self.words(1, 2))
                add("MARK", "</td>")
            add("MARK", "</tr>")
            add("MARK", "</table>")
        elif pick == 6:
            add("MARK", "<pre>")
            add("MARK", "<code>")
            add("CODE", f"{self.word()} {self.word()} {rng.randint(1, 99)}\n{self.word()}")
            add("MARK", "</code>")
            add("MARK", "</pre>")
        elif pick == 7:
            add("MARK", f'<a href="{url}">')
            add("TEXT", self.words(1, 3))
            add("MARK", "</a>")
        elif pick in (8, 9):
            add("ENTITY", rng.choice(("&amp;", "&nbsp;", "&quot;", "&lt;", "&gt;", "&#39;", "&#34;", "&mdash;", "&hellip;", "&eacute;", "&#x27;", "&ldquo;", "&euro;")))
        elif pick == 10:
            add("MARK", rng.choice((f'<div class="{self.word()}-{self.word()}', '<font size="2"', f"<a href='{self.word()}'", f'<img src="{url}"', f'<span style="{self.word()}:{self.word()}"', f"<td width={rng.randint(1, 99)}")))
            add("TEXT", " " + self.sentence())
        elif pick == 11:
            add("MARK", rng.choice(("</div>", "</span>", "</p>", "</font>", "</td>", "<div>", "<!-- " + self.word() + " -->")))
        elif pick == 12:
            self.line("MARK", "#" * rng.randint(1, 4) + " ", "TITLE")
        elif pick in (13, 14):
            mark = rng.choice(("- ", "* ", "+ ", None))
            for i in range(rng.randint(1, 5)):
                self.line("MARK", mark or f"{i + 1}. ", "ITEM")
        elif pick == 15:
            add("INLINE", rng.choice((f"**{self.words(1, 3)}**", f"__{self.words(1, 2)}__", f"~~{self.word()}~~")))
        elif pick == 16:
            add("INLINE", rng.choice((f"[{self.words(1, 3)}]({url})", f"[{url} {self.words(1, 3)}]", f"[[{self.word()}]]", f"[[{self.word()}|{self.words(1, 2)}]]")))
        elif pick == 17:
            add("MARK", rng.choice((f"![{self.word()}]({url})", f"{{{{{self.word()}|{rng.randint(1, 5)}|{self.word()}={self.word()}}}}}", f"{{{{{self.word()}}}}}")))
        elif pick == 18:
            add("CODE", f"`{self.words(1, 2)}`")
        elif pick == 19:
            self.new_line()
            add("MARK", "```")
            add("CODE", "\n" + f"{self.word()} = {rng.randint(1, 99)}\n{self.word()} = {self.word()}\n")
            add("MARK", "```")
            add("TEXT", "\n\n")
        elif pick == 20:
            self.new_line()
            add("CELL", f"| {self.word()} | {self.word()} |")
            add("TEXT", "\n")
            add("CELL", "|---|---|")
            add("TEXT", "\n")
            add("CELL", f"| {self.word()} | {rng.randint(1, 9)} |")
            add("TEXT", "\n\n")
        elif pick == 21:
            self.line("MARK", "> ", "QUOTE")
        elif pick == 22:
            add("INLINE", rng.choice((f"'''{self.words(1, 2)}'''", f"''{self.words(1, 3)}''")))
        elif pick == 23:
            self.new_line()
            add("TITLE", f"== {self.words(1, 2)} ==")
            add("TEXT", "\n")
        elif pick in (24, 25):
            n, m, x = rng.randint(1, 99), rng.randint(1, 99), self.word()[0]
            add("FORMULA", rng.choice((f"$\\frac{{{n}}}{{{m}}}$", f"${x}_{{{n}}} \\leq \\sqrt{{{m}}}$", f"\\({n} \\div {m}\\)", f"\\[ {x} = {n} \\cdot {m}^{{2}} \\]", f"${x}^2$", f"$${x} = {n}^{m}$$")))
        elif pick == 26:
            self.new_line()
            add("MARK", "\\begin{itemize}")
            for _ in range(rng.randint(1, 4)):
                add("ITEM", "\n")
                add("MARK", "\\item")
                add("ITEM", " " + self.sentence())
            add("ITEM", "\n")
            add("MARK", "\\end{itemize}")
            add("TEXT", "\n")
        elif pick == 27:
            add("TITLE", f"\\{rng.choice(('section', 'subsection', 'title'))}{{{self.words(1, 2)}}}")
            add("TEXT", " ")
        elif pick == 28:
            add("INLINE", f"\\{rng.choice(('textbf', 'emph', 'textit', 'underline'))}{{{self.words(1, 2)}}}")
        elif pick in (30, 31):
            add("INLINE", rng.choice((f"*{self.words(1, 3)}*", f"_{self.words(1, 3)}_")))
            add("TEXT", rng.choice((" ", ". ", ", ")) + self.words(0, 3) + " ")
        elif pick == 32:
            self.new_line()
            add("MARK", rng.choice(("", "", " ", "  ")) + rng.choice(("---", "-----", "***", "___", "----------", "=====")))
            add("TEXT", "\n" + self.sentence())
        elif pick == 33:
            self.new_line()
            title = self.words(1, 4).capitalize()
            add("TITLE", title + "\n" + rng.choice("=-") * rng.choice((3, 5, len(title))))
            add("TEXT", "\n" + self.sentence())
        elif pick == 34:
            self.new_line()
            add("MARK", rng.choice(("{|", '{| class="wikitable"', f'{{| border="{rng.randint(1, 9)}"')))
            add("TEXT", "\n")
            for _ in range(rng.randint(1, 3)):
                if rng.random() < 0.8:
                    add("MARK", "|-")
                    add("TEXT", "\n")
                for _ in range(rng.randint(1, 3)):
                    add("MARK", rng.choice(("| ", "| ", "! ", "|")))
                    add("CELL", self.words(1, 3))
                    add("TEXT", "\n")
            add("MARK", "|}")
            add("TEXT", "\n")
        else:
            add("MARK", rng.choice((f"~\\cite{{{self.word()}{rng.randint(1, 99)}}}", f"\\ref{{{self.word()}}}", "\\%", "\\&", "\\_", f"\\label{{{self.word()}}}")))

    def new_line(self) -> None:
        if self.parts:
            self.add("TEXT", "\n")

    def line(self, label: str, mark: str, content: str) -> None:
        self.new_line()
        self.add(label, mark)
        self.add(content, self.sentence())
        self.add(content, "\n")

    def page(self) -> tuple[str, list[str]]:
        self.parts = []
        for _ in range(self.rng.randint(1, 4)):
            if self.rng.random() < 0.7:
                self.prose(self.rng.randint(1, 2))
            if self.rng.random() < 0.6:
                self.construct()
        self.prose(self.rng.randint(0, 2))
        if not self.parts:
            self.prose(1)
        text = "".join(t for _, t in self.parts)
        return text, [label for label, t in self.parts for _ in t]


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[Block], list[int]]]:
    """Generated pages with a label for each block: that of most of its visible characters."""
    maker, out = PageMaker(seed), []
    for _ in range(count):
        text, labels = maker.page()
        page = blocks(text)
        gold = []
        for b in page:
            held = [label for label, c in zip(labels[b.start : b.start + len(b.text)], b.text, strict=True) if not c.isspace()] or labels[b.start : b.start + 1]
            gold.append(LABELS.index(max(LABELS, key=held.count)))
        out.append((text, page, gold))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 600, seed: int = 11) -> ChainField:
    """The field of `count` generated pages; the same pages for the same seed."""
    return fit([(features(page), gold) for _, page, gold in labelled_pages(count, seed)])


_INLINE = {"setext", "wiki_heading", "heading_command", "strong", "quotes", "wiki_link", "ext_link", "link", "image", "text_command", "slant"}


def _inner(b: Block) -> str:
    """The words of an inline construct."""
    text = b.text
    if b.kind == "ext_link":
        return text[1:-1].partition(" ")[2] or text[1:-1]
    if b.kind == "wiki_link":
        return text[2:-2].rpartition("|")[2]
    if b.kind in ("link", "image"):
        return text[text.index("[") + 1 : text.index("]")]
    if b.kind == "setext":
        return text.partition("\n")[0].strip()
    if b.kind in ("text_command", "heading_command", "command"):
        return text[text.rindex("{") + 1 : -1] if text.endswith("}") else ""
    return text.strip("*_~'=`# \t")


_BREAKING = {"br", "p", "div", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "blockquote"}


def render(page: list[Block], labels: list[int]) -> str:
    """Clean text: '# ' before headings, '- ' before list items, '> ' before quotes, code between back ticks, formulas in
    their notation, cells of a row divided by ' | '."""
    out: list[str] = []

    def newline() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    previous = ""
    for b, label in zip(page, map(LABELS.__getitem__, labels), strict=True):
        text = b.text
        if label == "TEXT":
            out.append(text)
        elif label == "ENTITY":
            out.append(html.unescape(text).replace("\xa0", " "))
        elif label == "INLINE":
            out.append(text if b.kind in ("prose", "sign", "row", "cell") else _inner(b))
        elif label == "MARK":
            name = _TAG_NAME.match(text)
            if b.kind in ("tag", "cut_tag") and name and name[2].lower() in _BREAKING:
                newline()
            elif b.kind == "escape":
                out.append(text[1:])
            elif b.kind in _INLINE or b.kind in ("row", "prose"):
                out.append(_inner(b) if b.kind in _INLINE else text)  # words of the page stay whatever their label
        elif label == "CODE":
            body = text.strip("`")
            if "\n" in body.strip("\n"):
                newline()
                out.append("```\n" + body.strip("\n") + "\n```\n")
            else:
                out.append(f"`{body.strip()}`" if body.strip() else "")
        elif label == "FORMULA":
            out.append(text)
        elif label == "CELL":
            cells = [c.strip() for c in text.strip().strip("|").split("|")]
            if not all(set(c) <= set("-: ") for c in cells):
                if previous == "CELL" and out and not out[-1].endswith("\n") and b.kind != "row":
                    out.append(" | ")
                out.append(" | ".join(cells))
        elif text.strip():
            sign = {"TITLE": "# ", "ITEM": "- ", "QUOTE": "> "}[label]
            if previous != label:
                newline()
                out.append(sign)
            out.append((_inner(b) if b.kind in _INLINE else text).lstrip() if previous != label else text)
            if label == "TITLE":
                newline()
        else:
            out.append(text)
        if label != "MARK" or b.kind in ("tag", "marker", "command", "environment"):
            previous = label if label != "MARK" or b.kind != "tag" or "td" in text.lower() and previous != "CELL" else previous if "td" in text.lower() else label
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", "".join(out))).strip()


def clean(page: str, field: ChainField) -> tuple[list[str], str]:
    """(roles found apart from TEXT, clean text)."""
    cut = blocks(page)
    if not cut:
        return [], page
    labels = field.decode(features(cut))
    found = sorted({LABELS[i] for i in labels} - {"TEXT"})
    return found, render(cut, labels) if found else page


def residue(texts: DataFrame, pages: int = 600, seed: int = 11) -> DataFrame:
    """(doc_id, roles, cleaned) of the texts with at least one block that is no plain text.

    texts: doc_id and text; received_at is passed on where it is there, other columns are ignored. Null and empty texts
    have none. The field is trained once, on the driver, on generated pages.
    """
    field = trained(pages, seed)
    sent = texts.sparkSession.sparkContext.broadcast((field.emit.astype(np.float32), field.move.astype(np.float32)))

    def run(batches):
        import pyarrow as pa

        field = ChainField(*sent.value)
        for batch in batches:
            rows = [(i, *clean(t, field)) for i, t in enumerate(batch.column("text").to_pylist())]
            rows = [r for r in rows if r[1]]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [*(batch.column(c).take(at) for c in kept), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "roles", "cleaned"])

    kept = [c for c in ("doc_id", "received_at") if c in texts.columns]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept) + ", roles array<string>, cleaned string"
    return texts.select(*kept, "text").where(F.col("text").rlike(TRIGGER)).mapInArrow(run, schema)


def review_residue(reviews: DataFrame, cleaned: bool = True) -> DataFrame:
    """(doc_id, roles, cleaned) of the reviews whose last delivery has residue, or doc_id alone; every delivery is looked
    through."""
    found = residue(reviews.select("doc_id", "received_at", "text"))
    return of_last_delivery(found if cleaned else found.select("doc_id", "received_at"), reviews)
