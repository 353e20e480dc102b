"""Markdown as blocks of plain text under their headings.

Lines are taken apart into containers (quotes, list items, however nested) and what they hold: headings,
paragraphs, code, rules, raw HTML. Text goes to a buffer that becomes a block where a heading begins, where a list,
also a nested one, ends, and at the end. A paragraph and a list item end a line of the buffer, but not a
paragraph of a list without blank lines; code is kept as it stands; HTML and rules are left out.
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[^`]*$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r" {0,3}>[ \t]?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+(?=\S)|[ \t]*$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:\s+\S")


def plain(text: str) -> str:
    """Inline markup as the text that it shows."""
    out = []
    for k, part in enumerate(re.split(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", text)):
        if k % 3 == 2:
            out.append(part[1:-1] if len(part) > 2 and part[0] == part[-1] == " " else part)
        elif k % 3 == 0:
            out.append(_marks(part))
    return "".join(out)


def _marks(text: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[1])
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"\\([!-/:-@\[-`{-~])", keep, text)
    text = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*|[\w.+-]+@[\w.-]+)>", keep, text)
    text = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", "", text)
    before = None
    while before != text:  # the innermost first
        before = text
        text = re.sub(r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])", r"\1", text)
        text = re.sub(r"(\*{1,3})(?=[^\s*])((?:[^*])*?[^\s*])\1", r"\2", text)
        text = re.sub(r"(?<!\w)(_{1,3})(?=[^\s_])((?:[^_])*?[^\s_])\1(?!\w)", r"\2", text)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], html.unescape(text))


class _Blocks:
    def __init__(self):
        self.done: list[tuple[str, list[str]]] = []
        self.stack: list[tuple[int, str]] = []
        self.held = ""

    def flush(self) -> None:
        if self.held.strip():
            self.done.append((self.held.strip(), [h for _, h in self.stack]))
        self.held = ""

    def heading(self, depth: int, title: str) -> None:
        self.flush()
        self.stack = [h for h in self.stack if h[0] < depth] + [(depth, plain(title).strip())]


def _starts(line: str) -> bool:
    """Whether a line begins something else than a paragraph, also within one."""
    item = _ITEM.match(line)
    listed = item and line[item.end() :].strip() and (not item[2][0].isdigit() or int(item[2][:-1]) == 1)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or listed)


def _quote(lines: list[str], i: int) -> tuple[list[str], int]:
    """The lines of a quote without their marks, and where it ends; a paragraph's last lines may lack the mark."""
    out = []
    while i < len(lines):
        mark = _QUOTE.match(lines[i])
        if not mark and (not lines[i].strip() or _starts(lines[i]) or not out or not out[-1].strip()):
            break
        out.append(lines[i][mark.end() :] if mark else lines[i])
        i += 1
    return out, i


def _item(lines: list[str], i: int) -> tuple[list[str], int]:
    """The lines of a list item without their indent, and where it ends."""
    mark = _ITEM.match(lines[i])
    width = mark.end() if mark[3].strip(" \t") == "" and lines[i][mark.end() :].strip() else mark.end(2) + 1
    if len(mark[3]) > 4:  # code within the item
        width = mark.end(2) + 1
    out, i = [lines[i][width:]], i + 1
    while i < len(lines):
        line = lines[i]
        if line.strip() and len(line) - len(line.lstrip(" ")) < width and (not out[-1].strip() or _starts(line) or _ITEM.match(line)):
            break
        out.append(line[width:] if line[:width].strip() == "" else line)
        i += 1
    while len(out) > 1 and not out[-1].strip():
        out.pop()
        i -= 1
    return out, i


def _read(lines: list[str], to: _Blocks, tight: bool = False) -> None:
    i = 0
    while i < len(lines):
        line = lines[i]
        fence, heading = _FENCE.match(line), _HEADING.match(line)
        if not line.strip() or _RULE.match(line):
            i += 1
        elif fence:
            end = next((k for k in range(i + 1, len(lines)) if re.match(rf" {{0,3}}{fence[1][0]}{{{len(fence[1])},}}[ \t]*$", lines[k])), len(lines))
            to.held += "".join(x + "\n" for x in lines[i + 1 : end])
            i = end + 1
        elif heading:
            to.heading(len(heading[1]), heading[2] or "")
            i += 1
        elif _QUOTE.match(line):
            own, i = _quote(lines, i)
            _read(own, to)
        elif _ITEM.match(line):
            kind, items, loose = _ITEM.match(line)[2][-1], [], False
            while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
                own, i = _item(lines, i)
                items.append(own)
                after = next((k for k in range(i, len(lines)) if lines[k].strip()), len(lines))
                follows = after < len(lines) and (m := _ITEM.match(lines[after])) and m[2][-1] == kind and not _RULE.match(lines[after])
                loose = loose or any(not x.strip() and y.strip() and not y.startswith(" ") for x, y in zip(own, own[1:], strict=False)) or bool(follows and after > i)
                i = after if follows else i
            for own in items:
                _read(own, to, not loose)
                to.held += "\n"
            to.flush()
        elif line.startswith("    "):
            end = next((k for k in range(i, len(lines)) if lines[k].strip() and not lines[k].startswith("    ")), len(lines))
            to.held += "\n".join(x[4:] for x in lines[i:end]).rstrip() + "\n"
            i = end
        elif _HTML.match(line):
            i = next((k for k in range(i, len(lines)) if not lines[k].strip()), len(lines))
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or _UNDERLINE.match(lines[k]) or _starts(lines[k])), len(lines))
            under = _UNDERLINE.match(lines[end]) if end < len(lines) else None
            text = " ".join(re.sub(r"\\$", "", x.strip()) for x in lines[i:end] if not _DEFINITION.match(x))
            if under:
                to.heading(1 if under[1][0] == "=" else 2, text)
                end += 1
            elif text:
                to.held += plain(text) + ("" if tight else "\n")
            i = end


def blocks(text: str) -> list[tuple[str, list[str]]]:
    """(text, headings from the outermost) of the blocks of a document."""
    to = _Blocks()
    _read(text.replace("\t", "    ").splitlines(), to)
    to.flush()
    return to.done
