"""Source text made fit for line patterns: comments and strings are masked, brackets are closed on their line.

Every line keeps its number: what is blanked leaves its line feeds, and a
statement that is joined onto its first line is followed by empty lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_TRIPLE = r"\"\"\"(?:\\.|[^\\])*?\"\"\""
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_CHARACTER = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
#: Comments (c), strings that may span lines (m) and strings on one line (s) of each language.
TOKENS = {
    "python": rf"(?P<c>#[^\n]*)|(?P<m>{_TRIPLE}|'''(?:\\.|[^\\])*?''')|(?P<s>{_QUOTED})",
    "typescript": rf"(?P<c>{_SLASHES})|(?P<m>`(?:\\.|[^`\\])*`)|(?P<s>{_QUOTED})",
    "rust": rf"(?P<c>{_SLASHES})|(?P<m>\br(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\")|(?P<s>{_CHARACTER})",
    "go": rf"(?P<c>{_SLASHES})|(?P<m>`[^`]*`)|(?P<s>\"(?:\\.|[^\"\\\n])*\"|{_CHARACTER})",
    "java": rf"(?P<c>{_SLASHES})|(?P<m>{_TRIPLE})|(?P<s>\"(?:\\.|[^\"\\\n])*\"|{_CHARACTER})",
    "kotlin": rf"(?P<c>{_SLASHES})|(?P<m>{_TRIPLE})|(?P<s>\"(?:\\.|[^\"\\\n])*\"|{_CHARACTER})",
    "ruby": rf"(?P<c>^=begin\b.*?^=end\b[^\n]*|(?<![\w\"'/])#[^\n]*)|(?P<m><<[~-]?[\"']?(?P<h>[A-Z_]+)[\"']?[^\n]*\n.*?^\s*(?P=h)\b)|(?P<s>{_QUOTED})",
}
TOKENS |= {name: TOKENS["typescript"] for name in ("tsx", "javascript", "jsx")}
_COMPILED = {name: re.compile(pattern, re.DOTALL | re.MULTILINE) for name, pattern in TOKENS.items()}
#: The characters that a token begins with.
STARTS = {name: "[#\"']" if name == "python" else "[=<#\"']" if name == "ruby" else "[r/\"']" if name == "rust" else "[`/\"']" for name in TOKENS}
_STARTS = {name: re.compile(pattern) for name, pattern in STARTS.items()}
_MARKS = str.maketrans(dict.fromkeys("{}()[]#;", " "))
_BRACKETS = re.compile(r"[()\[\]{}\n]")
#: By whether braces are brackets: a bracket that closes on its line and holds none, and what tells that a text may have lines to join.
_CLOSED = {False: r"[(\[][^()\[\]{}\n]*[)\]]", True: r"[(\[{][^()\[\]{}\n]*[)\]}]"}
_OPEN = {False: r"[()\[\]]", True: r"[()\[\]{}]|\\\n"}
#: A Go group of declarations, which has one a line.
_GROUP = re.compile(r"^\s*(?:import|const|var|type)\s*$")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, language: str) -> str:
    """The text with comments and strings of several lines blanked, and without brackets in other strings."""

    def cover(m: re.Match) -> str:
        found = m.group()
        if m.lastgroup == "c" or m.group("c") is not None:
            return _blank(found)
        if m.group("s") is not None or "\n" not in found:
            return found.translate(_MARKS)
        if language == "ruby":  # the line that a heredoc begins on goes on
            head, _, body = found.partition("\n")
            return head + "\n" + _blank(body)
        return '"' + _blank(found[1:-1]) + '"'

    starts, token, out, done = _STARTS[language], _COMPILED[language], [], 0
    found = starts.search(text)
    while found:
        m = token.match(text, found.start())
        if m:
            out += (text[done : m.start()], cover(m))
            done = m.end()
        found = starts.search(text, m.end() if m else found.start() + 1)
    return "".join((*out, text[done:])) if out else text


def joined(text: str, language: str) -> str:
    """The text with each bracket's content on the line on which it opens.

    A bracket that holds a brace stays as it is, as blocks are told by lines;
    in Python, braces are brackets. So do Go's groups of declarations.
    """
    braces = language == "python"
    spans, depth, start, plain = [], 0, 0, True
    for m in _BRACKETS.finditer(text):
        c = m.group()
        if c in "([" or (braces and c == "{"):
            if depth == 0:
                start, plain = m.start(), not (language == "go" and c == "(" and _GROUP.match(text[text.rfind("\n", 0, m.start()) + 1 : m.start()]))
            depth += 1
        elif c in ")]" or (braces and c == "}"):
            if depth == 1 and plain:
                spans.append((start, m.start()))
            depth = max(0, depth - 1)
        elif c in "{}" and depth:
            depth = 0  # a block: what was open isn't joined
    out, at, waiting = [], 0, 0
    ends = iter([*spans, (len(text), len(text))])
    lo, hi = next(ends)
    for m in re.finditer(r"\\?\n", text):
        while m.start() > hi:
            lo, hi = next(ends)
        out.append(text[at : m.start()])
        at = m.end()
        if lo < m.start() < hi or (braces and len(m.group()) == 2):
            out.append(" ")
            waiting += 1
        else:
            out.append(m.group() + "\n" * waiting)
            waiting = 0
    return "".join([*out, text[at:], "\n" * waiting])


def _scanned(texts: pa.Array, language: str) -> pa.Array:
    """Texts of a language, masked and joined. Most have few tokens and close their brackets on their lines, so only those that may change are scanned."""
    if not len(texts):
        return texts
    texts = pc.replace_substring(texts, "\r\n", "\n")

    def changed(where: pa.Array, change: Callable[[str, str], str]) -> pa.Array:
        where = pc.fill_null(where, False)
        return pc.replace_with_mask(texts, where, pa.array([change(t, language) for t in texts.filter(where).to_pylist()], texts.type))

    texts = changed(pc.match_substring_regex(texts, STARTS[language]), masked)
    braces, left = language == "python", texts
    for _ in range(3):
        left = pc.replace_substring_regex(left, _CLOSED[braces], "")
    return changed(pc.match_substring_regex(left, _OPEN[braces]), joined)


def _prepared(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, languages in rows:
        of, parts, places = languages.cast(pa.string()), [], []
        for language in of.unique().to_pylist():
            at = pc.indices_nonzero(pc.is_null(of) if language is None else pc.fill_null(pc.equal(of, language), False))
            some = texts.take(at).cast(pa.string())
            parts.append(_scanned(some, language) if language in TOKENS else some)
            places.append(at)
        yield pa.concat_arrays(parts).take(pc.sort_indices(pa.concat_arrays(places))) if parts else texts


def prepared(content: Column, language: Column) -> Column:
    """A file's text, masked and joined; as it is, if the language is unknown."""
    return F.arrow_udf("string")(_prepared)(content, language)
