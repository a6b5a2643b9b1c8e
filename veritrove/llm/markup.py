"""Clean text from HTML, Markdown, wiki and LaTeX markup, whatever the media type says.

Each language's marks are recognised by their syntax and replaced by the plain
form of what they mean: headings, lists, code, tables and formulas stay, in one
notation. Then two-pass block rules decide what is content: stop-word density,
length and link density classify the blocks of text, and short ones in between
inherit the label of their nearest decided neighbours. Headings, lists, code and
tables are content however many links they hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.parallel import spread

LANGUAGES = ("html", "markdown", "wiki", "latex")

# The element names of HTML.
_ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup"
    " dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html"
    " i iframe img input ins kbd label legend li link main map mark menu meta nav noframes noscript object ol optgroup option p param picture pre"
    " progress q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead"
    " time title tr track tt u ul var video wbr"
)
_TAG = re.compile(r"<(/?)(" + "|".join(_ELEMENTS.split()) + r")(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype\b[^<>]*>|<!\[CDATA\[.*?\]\]>|<\?xml\b[^<>]*\?>", re.S | re.I)
_NAV_PART = re.compile(r"</?(?:li|ul|ol|h[1-6]|table|tr|t[dh])\b[^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+(?:\n[^`\n]+)?)(?<!`)\1(?!`)")
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\(([^()\s]*)(?:\s+\"[^\"]*\")?\)")
_LINK = re.compile(r"\[([^\[\]]+)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)")
_REFERENCE = re.compile(r"\[([^\[\]\n]+)\]\[[\w .-]*\]")
_FOOTNOTE = re.compile(r"\[\^[\w-]+\]:?")
_DEFINITION = re.compile(r"^[ \t]{0,3}\[[^\[\]\n^]+\]:[ \t]+\S+[^\n]*$", re.M)


def _marked(*forms: tuple[str, str, str, str]) -> re.Pattern:
    """A span between two equal marks within a paragraph; each form has the mark, its character, and what may not stand before and after."""
    # the span ends at the next mark character or with the paragraph, hence possessive
    return re.compile("|".join(rf"(?<![{before}]){mark}(?=[^\s{c}])((?:[^{c}\n]++|\n(?![^\S\n]*(?:\n|\Z)))*+)(?<=[^\s{c}]){mark}(?![{after}])" for mark, c, before, after in forms))


_TRIPLE = _marked((r"\*{3}", "*", r"*\w", r"*\w"), ("_{3}", "_", r"_\w", r"_\w"))
_STRONG = _marked((r"\*{2}", "*", r"*\w", r"*\w"), ("__", "_", r"_\w", r"_\w"))
_EMPHASIS = _marked((r"\*", "*", r"*\w\\/", r"*\w/"), ("_", "_", r"_\w\\/", r"_\w/"))
_STRIKE = _marked(("~~", "~", r"~\w", r"~\w"))
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(?=[^\n]*[^\W\d_])([^\n]*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^([^\n]*[^\W_][^\n]*)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", re.M)
_TASK = re.compile(r"^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+", re.M)
_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]+(?=[^\W\d_])", re.M)
_RULER = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$", re.M)

_WIKI_LINK = re.compile(r"\[\[(?=[^\s\"'\[\{])(?![-\d.,eE\s]*\]\])([^\[\]{}\n]+?)\]\]")
_TEMPLATE = re.compile(r"\{\{(?=[^\s\"'{])([^{}]+?)\}\}")
_RUN = re.compile(r"(?<![\d'])('{2,3}|'{5})(?=[^\s'])([^'\n`]+(?:'[^'\n`]+)*)\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n][^\n]*?[^=\n]|[^=\n])[ \t]*\1[ \t]*$", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)(?:^[ \t]*\|\}[^\n]*$|\Z)", re.M | re.S)

_ENVIRONMENT = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*\n?(.*?)\\end\{\1\}", re.S)
_DISPLAY = re.compile(r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|displaymath|math|eqnarray\*?)\}(.*?)\\end\{\1\}|\\\[(.+?)\\\]|(?<!\\)\$\$([^$]+?)\$\$", re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\\\w$])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])", re.S)
_COMMAND = re.compile(r"(?<!\\)\\([a-zA-Z]{2,})\*?((?:\[[^\[\]\n]*\])*)\{([^{}]*)\}")
# Commands that stand without an argument.
_BARE = re.compile(r"(?<![\w:\\/.])\\(item|maketitle|tableofcontents|newline|newpage|clearpage|noindent|hline|par|centering|bigskip|medskip|smallskip|LaTeX|TeX|ldots|dots|quad|qquad|textbackslash|appendix)\b(?!\\)")
_MATHS = re.compile(r"[\\^_={}<>+]|^[A-Za-z]$")
_ESCAPE = re.compile(r"(?<![\\\w:])\\([%&#${}])|(?<=\w)\\(_)(?=\w)|(?<=\w)\\([%&#$])|\\([{}])(?=\W|$)")
_TEX_LINE = re.compile(r"^[ \t]*%[^\n]*$", re.M)

#: Stands for the # of a heading that is already converted.
_HEAD = "\ue002"

_BREAKS = re.compile(r"\n(?:[^\S\n]*\n)+")
_SPACES = re.compile(r"[^\S\n]+")


_HELD = re.compile("\ue000(\\d+)\ue001")


class _Text:
    """A text under conversion; verbatim parts wait behind private code points."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: set[str] = set()
        self.held: list[str] = []

    def hold(self, what: str) -> str:
        self.held.append(what)
        return f"\ue000{len(self.held) - 1}\ue001"

    def swap(self, pattern: re.Pattern, kind: str, to) -> None:
        new, n = pattern.subn(to, self.text)
        if n:
            self.text = new
            self.kinds.add(kind)

    def done(self) -> str:
        parts: list[str] = []

        def back(m: re.Match) -> str:
            return parts[int(m[1])] if int(m[1]) < len(parts) else ""

        for part in self.held:  # a held part may hold earlier ones
            parts.append(_HELD.sub(back, part))
        return _HELD.sub(back, self.text)


def _code(block: str) -> str:
    return "\n\n" + "\n".join("    " + line for line in block.strip("\n").splitlines()) + "\n\n"


def _from_html(t: _Text) -> None:
    if "<" in t.text:
        t.swap(_COMMENT, "html", " ")
        if _TAG.search(t.text):
            t.kinds.add("html")
            t.text = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", " ", t.text, flags=re.S | re.I)
            t.text = re.sub(r"<pre\b[^<>]*>(.*?)</pre\s*>", lambda m: t.hold(_code(html.unescape(_TAG.sub("", m[1])))), t.text, flags=re.S | re.I)
            t.text = re.sub(r"<nav\b[^<>]*>(.*?)</nav\s*>", lambda m: "\n\n" + _NAV_PART.sub("\n", m[1]) + "\n\n", t.text, flags=re.S | re.I)
            t.text = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", lambda m: f"\n\n{_HEAD * int(m[1])} {m[2]}\n\n" if m[2].strip() else " ", t.text, flags=re.S | re.I)
            t.text = re.sub(r"<a\b[^<>]*?>(.*?)</a\s*>", "\ue010\\1\ue011", t.text, flags=re.S | re.I)
            t.text = re.sub(r"<title\b[^<>]*>.*?</title\s*>", " ", t.text, flags=re.S | re.I)
            t.text = re.sub(r"</tr\s*>\s*", "", t.text, flags=re.I)
            t.text = re.sub(r"</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t.text, flags=re.I)

            def tag(m: re.Match) -> str:
                name, ending = m[2].lower(), m[1]
                if name == "li":
                    return "" if ending else "\n- "
                if name in ("br", "tr"):
                    return "\n"
                if name in ("p", "div", "ul", "ol", "table", "blockquote", "section", "article", "header", "footer", "nav", "body", "dl", "form", "main", "aside"):
                    return "\n\n"
                return ""

            t.text = _TAG.sub(tag, t.text)
    if "&" in t.text:

        def entity(m: re.Match) -> str:
            plain = html.unescape(m[0])
            if plain != m[0] and not plain.endswith(";"):
                t.kinds.add("html")
                return plain.replace("\xa0", " ")
            return m[0]

        t.text = _ENTITY.sub(entity, t.text)


def _from_latex(t: _Text) -> None:
    if "\\" in t.text:
        t.swap(_ENVIRONMENT, "latex", lambda m: t.hold(_code(m[2])))
        t.swap(_DISPLAY, "latex", lambda m: t.hold("\n\n" + next(x for x in m.groups()[1:] if x is not None).strip() + "\n\n"))
    if "\\" in t.text or "$" in t.text:

        def inline(m: re.Match) -> str:
            inner = m[1] if m[1] is not None else m[2]
            if m[1] is None and not _MATHS.search(inner):
                return m[0]
            t.kinds.add("latex")
            return t.hold(inner.strip())

        if "$$" in t.text:
            t.swap(_DISPLAY, "latex", lambda m: t.hold("\n\n" + next(x for x in m.groups()[1:] if x is not None).strip() + "\n\n"))
        t.text = _INLINE.sub(inline, t.text)
    if "\\" not in t.text:
        return

    def command(m: re.Match) -> str:
        name, inner = m[1], m[3]
        t.kinds.add("latex")
        if name in ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "title"):
            return f"\n\n{_HEAD * 2} {inner}\n\n"
        if name in ("begin", "end"):
            return "\n\n"
        if name in ("cite", "citep", "citet", "ref", "eqref", "pageref", "label", "documentclass", "usepackage", "includegraphics", "bibliography", "bibliographystyle", "input", "include", "vspace", "hspace", "pagestyle"):
            return ""
        return f" ({inner})" if name == "footnote" else inner

    while True:  # arguments may hold commands; each turn takes the innermost ones
        t.text, n = _COMMAND.subn(command, t.text)
        if not n:
            break
    t.swap(_BARE, "latex", lambda m: "\n- " if m[1] == "item" else "\n")
    if "latex" in t.kinds:
        t.text = re.sub(r"\n[^\S\n]*\n- ", "\n- ", t.text)
        t.text = _TEX_LINE.sub("", t.text)
    t.swap(_ESCAPE, "latex", lambda m: next(x for x in m.groups() if x))


def _from_wiki(t: _Text) -> None:
    if "{|" in t.text:

        def cells(m: re.Match) -> str:
            rows = re.split(r"^[ \t]*\|-[^\n]*$", m[1], flags=re.M)
            lines = [" | ".join(c.strip() for c in re.split(r"\|\||!!|\n[ \t]*[|!]", "\n" + r.strip()) if c.strip()) for r in rows]
            return "\n\n" + "\n".join(x for x in lines if x) + "\n\n"

        t.swap(_WIKI_TABLE, "wiki", cells)
    if "[[" in t.text:
        t.swap(_WIKI_LINK, "wiki", lambda m: "\ue010" + m[1].rpartition("|")[2] + "\ue011")
    if "{{" in t.text:
        t.swap(_TEMPLATE, "wiki", lambda m: m[1].partition("|")[2].split("|")[0])
    if "''" in t.text:
        while True:  # runs may hold shorter ones
            t.text, n = _RUN.subn(r"\2", t.text)
            if not n:
                break
            t.kinds.add("wiki")
    if "=" in t.text:
        t.swap(_WIKI_HEADING, "wiki", lambda m: f"\n\n{_HEAD * len(m[1])} {m[2]}\n\n")


def _from_markdown(t: _Text) -> None:
    text = t.text
    if "```" in text or "~~~" in text:
        t.swap(_FENCE, "markdown", lambda m: t.hold(_code(m[2])))
    if "`" in text:
        t.swap(_CODE, "markdown", lambda m: t.hold(m[2]))
    if "](" in text:
        t.swap(_IMAGE, "markdown", r"\1")
        t.swap(_LINK, "markdown", "\ue010\\1\ue011")
    if "][" in text:
        t.swap(_REFERENCE, "markdown", "\ue010\\1\ue011")
    if "[^" in text:
        t.swap(_FOOTNOTE, "markdown", "")
    if "]: " in text:
        t.swap(_DEFINITION, "markdown", "")
    if "#" in text:
        t.swap(_ATX, "markdown", lambda m: f"\n\n{_HEAD * len(m[1])} {m[2]}\n\n")
    if "===" in text or "---" in text:
        t.swap(_SETEXT, "markdown", "\n\n\ue002 \\1\n\n")
    if "---" in text:
        t.swap(_RULER, "markdown", "")
    if "] " in text:
        t.swap(_TASK, "markdown", r"\1- ")
    if "> " in text:
        t.swap(_QUOTE, "markdown", "")
    if "~~" in text:
        t.swap(_STRIKE, "markdown", r"\1")
    if "***" in text or "___" in text:
        t.swap(_TRIPLE, "markdown", lambda m: m[1] or m[2])
    if "**" in text or "__" in text:
        t.swap(_STRONG, "markdown", lambda m: m[1] or m[2])
    if "*" in text or "_" in text:
        t.swap(_EMPHASIS, "markdown", lambda m: m[1] or m[2])


def convert(text: str) -> tuple[str, list[str]]:
    """Plain text with links between U+E010 and U+E011, and the markup languages found, in order of ``LANGUAGES``."""
    if not any(c in text for c in "<&\\`*_[{|='#~$>") and "---" not in text:
        return text, []
    t = _Text(text.replace("\r\n", "\n").replace("\r", "\n"))
    # code first, as it may hold any other mark; HTML's own code is taken with its tags
    if "`" in t.text or "~~~" in t.text:
        t.swap(_FENCE, "markdown", lambda m: t.hold(_code(m[2])))
        t.swap(_CODE, "markdown", lambda m: t.hold(m[2]))
    _from_html(t)
    _from_latex(t)
    _from_wiki(t)
    _from_markdown(t)
    return (t.done().replace(_HEAD, "#"), [k for k in LANGUAGES if k in t.kinds]) if t.kinds else (text, [])


#: Block rules: densities of stop words, share of linked code points, and lengths in code points.
STOP_LOW, STOP_HIGH, LINK_HIGH, SHORT, LONG = 0.15, 0.28, 0.3, 70, 200
_ITEM = re.compile(r"\s*(?:[-*+•–·]|\(?\d{1,3}[.)])\s")
_WORD = re.compile(r"[^\W\d_]+")
_URL = r"(?:https?://|www\.)\S+"
_BAR = re.compile(rf"[\s|]*(?:\ue010[^\ue010\ue011]*\ue011|{_URL})(?:[^\S\n]*\|[^\S\n]*(?:\ue010[^\ue010\ue011]*\ue011|{_URL}))+[\s|]*")


def _kind(block: str) -> str:
    lines = block.splitlines()
    if block.startswith("#"):
        return "heading"
    if all(x.startswith("    ") for x in lines):
        return "code"
    if sum(" | " in x for x in lines) * 2 > len(lines):
        return "table"
    if sum(bool(_ITEM.match(x)) for x in lines) * 2 > len(lines):
        return "list"
    return "text"


def classify(blocks: list[str], common: frozenset[str]) -> list[str]:
    """``content`` or ``rest`` for each block."""
    labels: list[str] = []
    kinds = [_kind(block) for block in blocks]
    for i, (block, kind) in enumerate(zip(blocks, kinds)):
        size = max(1, len(block))
        linked = sum(len(x) for x in re.findall("\ue010([^\ue011]*)\ue011", block)) + sum(map(len, re.findall(_URL, block)))
        words = _WORD.findall(block.lower())
        stop = sum(w in common for w in words) / max(1, len(words))
        # one line of links between bars is navigation, unless it is the head or the only row of a table in two blocks
        bar = kind == "table" and "table" not in (*kinds[max(0, i - 1) : i], *kinds[i + 1 : i + 2]) and _BAR.fullmatch(block)
        if kind in ("code", "table") and not bar:
            labels.append("content")
        elif kind in ("heading", "list"):
            labels.append("kept")
        elif linked / size > LINK_HIGH and stop < STOP_HIGH:
            labels.append("rest")
        elif size < SHORT:
            labels.append("short")
        elif stop >= STOP_HIGH:
            labels.append("content" if size > LONG else "near")
        else:
            labels.append("near" if stop >= STOP_LOW else "short")
    # second pass: what is undecided takes the label of the nearest decided blocks, content winning a tie; one sweep either way
    before, after = _nearest(labels), [d and (len(labels) - 1 - d[0], d[1]) for d in reversed(_nearest(labels[::-1]))]
    out = []
    for i, label in enumerate(labels):
        if label in ("content", "rest", "kept"):
            out.append("content" if label == "kept" else label)
            continue
        sides = [d for d in (before[i], after[i]) if d]
        least = min((abs(at - i) for at, _ in sides), default=0)
        near = {found for at, found in sides if label == "near" or abs(at - i) == least}
        out.append("rest" if near == {"rest"} and label == "short" else "content")
    return out


def _nearest(labels: list[str]) -> list[tuple[int, str] | None]:
    """For each place the place and label of the last decided block before it."""
    out, last = [], None
    for i, label in enumerate(labels):
        out.append(last)
        if label in ("content", "rest"):
            last = (i, label)
    return out


def clean(text: str, common: frozenset[str]) -> tuple[str, list[str], int]:
    """Clean text, markup languages, and how many blocks were dropped."""
    plain, kinds = convert(text)
    if not kinds:
        if "://" not in text and "www." not in text:
            return text, [], 0  # without a link no block is one of links
        # what stays of a text without markup stays as it is, between its own breaks
        parts = _BREAKS.split(text)
        there = [i for i, x in enumerate(parts) if x.strip()]
        # a single link is a reference rather than navigation
        gone = {i for i, x in zip(there, classify([parts[i].strip("\n") for i in there], common)) if x == "rest" and len(re.findall(_URL, parts[i])) > 1}
        return ("\n\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text), [], len(gone)
    blocks = [b for b in (re.sub(r"[ \t]+$", "", x.strip("\n"), flags=re.M) for x in _BREAKS.split(plain)) if b.strip()]
    labels = classify(blocks, common)
    kept = [b.replace("\ue010", "").replace("\ue011", "") for b, x in zip(blocks, labels) if x == "content"]
    tidy = [b if _kind(b) == "code" else "\n".join(_SPACES.sub(" ", line).strip() for line in b.splitlines()) for b in kept]
    return "\n\n".join(tidy), kinds, len(blocks) - len(kept)


def clean_documents(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (clean), ``markup`` (languages found), ``dropped`` (number of blocks).

    ``words`` (column ``word``) holds common words of all languages; it is a
    fixed table and refused beyond 10,000 rows. The block rules
    hold for every text; blocks of a text without markup stay as they are, and only
    those with several links can go. Null texts stay null, with no markup; rows without an id stay; of
    repeated ids each row stays. Headings come out as ``#`` lines, lists as
    ``-`` lines, code indented by four, table rows as cells parted by ``|``,
    formulas in their own notation; all of these are kept, with links or without.
    Dropped are other blocks that consist mainly of links: paragraphs, single
    lines of links between bars, and what stands in ``nav`` elements; and short
    paragraphs with no nearer content than these. Further columns are ignored;
    an empty table gives an empty result.
    No shuffle.
    """
    listed = [r["word"] for r in words.select("word").where("word is not null").distinct().limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("the table of common words is not a short list")
    common = frozenset(w.lower() for w in listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, [], 0) if t is None else clean(t, common) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.int32())],
                ["doc_id", "text", "markup", "dropped"],
            )

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, text string, markup array<string>, dropped int")
