"""Several values packed in one field: a parsing expression grammar over single cells.

    cell    <- placeholder / list
    list    <- (gap value?)*
    gap     <- (blank / separator / mark / joiner)*
    value   <- quoted / bracketed / known / bare
    bracketed <- open list close                                       # else backtrack: a stray bracket
    quoted  <- open (escape / doubled / !close .)* close &boundary     # else backtrack: a stray mark
    known   <- a usual label, longest first, &boundary
    bare    <- (!(separator / bracket / blank known) .)+

Alternatives are tried in the order written. A quotation mark that is never closed fails
`quoted`; the parser goes back, drops the mark, reads on with the other alternatives and
flags the value. A bracket that is never closed fails `bracketed` and flags the value after
it, one that closes nothing (or another kind) flags the value before it. Lists in brackets
may be nested; their values come out in order.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Cells that say that there is no label, in small letters.
PLACEHOLDERS = {"", "-", "--", "---", "–", "—", "none", "n/a", "na", "n.a.", "nan", "null", "nil", "no label", "no labels", "no error", "no errors", "nothing", "?", ".", "_", "0", "x", "unlabelled", "unlabeled", "not applicable", "[]", "{}", "()", "<>", "<na>"}
# Marks that open a quotation, and what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "”": "”", "„": "“”", "‘": "’", "’": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹", "`": "`´", "´": "´", "「": "」", "『": "』", "＂": "＂"}
OPEN, CLOSE = "([{<（［｛【〔", ")]}>）］｝】〕"
SEPARATORS = ",;|/\\+&\n\r\t·•‧∙●▪◦→⇒＞＜，、；｜／＋＆‖¦:"
BLANK = "".join(map(chr, [0x20, 0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF]))

_gap = re.compile(
    rf"(?:[\s{BLANK}]|[{re.escape(SEPARATORS)}]"
    r"|[-–—―*~]+(?=[\s\u00a0]|$)|--+|=>|->"
    # list marks: "1." "2)" "(a)" "iv." and, with a blank after it, "a." "b:"
    r"|(?<![\w])(?:\(?(?:\d{1,3}|[A-Za-z]|[ivx]{1,4})\)|\d{1,3}\.|(?:\d{1,3}|[A-Za-z]|[ivx]{1,4})[.:](?=[\s\u00a0]))(?![\w)]*\()(?=[\s\u00a0]*\S)"
    r"|(?<![\w])(?i:and|or|plus|und|y|et)(?=[\s\u00a0]))"
)
_boundary = re.compile(rf"[\s{BLANK}]*(?:$|[{re.escape(SEPARATORS + OPEN + CLOSE)}.])|[\s{BLANK}]+")
_stop = re.compile(rf"[{re.escape(SEPARATORS + OPEN + CLOSE)}]|[\s{BLANK}]+(?:[-–—―]+|->|=>|(?i:and|or|plus|&))(?=[\s{BLANK}])|[\s{BLANK}]{{2,}}|[\s{BLANK}]+(?=[{"".join(QUOTES)}])|[\s{BLANK}]+(?=\(?(?:\d{{1,3}}|[a-z])[.):][\s{BLANK}])|$")
_entity = re.compile(r"&(?:amp|nbsp|quot|apos|lt|gt|#0*39|#x0*27|#0*34);", re.I)
_entities = {"amp": "&", "nbsp": "\u00a0", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}


class Item(NamedTuple):
    label: str
    start: int  # offset in the cell, after entities outside quotations are resolved
    kind: str  # quoted, known, bare
    malformed: bool  # a quotation mark or bracket beside it has no partner


class CellGrammar:
    """The grammar for one set of usual labels (which may hold blanks, hyphens and separators)."""

    def __init__(self, known: list[str]):
        longest_first = sorted({k for k in known if k}, key=lambda k: (-len(k), k))
        end = rf"(?=[\s{BLANK}]|$|[{re.escape(SEPARATORS + OPEN + CLOSE)}.\"“”'’`»–—])"
        words = "|".join(map(re.escape, longest_first)) or r"(?!)"
        self._known = re.compile(rf"(?i:{words}){end}")
        self._known_next = re.compile(rf"[\s{BLANK}]+(?=(?i:{words}){end})")

    def parse(self, cell: str | None) -> list[Item]:
        """The values of a cell in order; none for a null, blank or placeholder cell."""
        if cell is None or cell.strip(" \t\r\n\u00a0").lower() in PLACEHOLDERS:
            return []
        text = _entity.sub(lambda m: _entities.get(m[0][1:-1].lower(), "'" if "39" in m[0] or "27" in m[0] else '"'), cell) if "&" in cell else cell
        items, at, stray = [], 0, False
        last_angle = text.rfind(">")
        opened: list[tuple[str, int]] = []  # brackets not closed yet, with the number of values before them
        while True:
            at = self._skip(text, at)
            if at >= len(text):
                for _, k in opened:
                    if k < len(items):
                        items[k] = items[k]._replace(malformed=True)
                return items
            if text[at] in OPEN and text[at] != "<":
                opened.append((CLOSE[OPEN.index(text[at])], len(items)))
                at += 1
                continue
            if text[at] in CLOSE:
                if any(c == text[at] for c, _ in opened):
                    while opened[-1][0] != text[at]:  # brackets opened inside and never closed
                        k = opened.pop()[1]
                        if k < len(items):
                            items[k] = items[k]._replace(malformed=True)
                    opened.pop()
                elif text[at] == ">":
                    pass  # an arrow between values
                elif items:
                    items[-1] = items[-1]._replace(malformed=True)
                else:
                    stray = True
                at += 1
                continue
            if text[at] == "<":
                if at < last_angle:
                    opened.append((">", len(items)))
                at += 1
                continue
            if text[at] in QUOTES:
                if (q := self._quoted(text, at)) is not None:
                    label, end = q
                    if label:
                        items.append(Item(label, at, "quoted", stray))
                    at, stray = end, False
                else:
                    at, stray = at + 1, True
                continue
            if m := self._known.match(text, at):
                items.append(Item(m[0], at, "known", stray))
                at, stray = m.end(), False
                continue
            end = self._bare_end(text, at)
            label = text[at:end].strip(" \u00a0\t.")
            if stray:
                label = label.rstrip("".join(QUOTES))
            if label and label.lower() not in PLACEHOLDERS:
                parts = label.split()
                again = len(parts) > 1 and len(set(parts)) == 1  # one word again and again is a list of it
                items += [Item(p, at + label.find(p) + k * (len(p) + 1), "bare", stray) for k, p in enumerate(parts)] if again else [Item(label, at, "bare", stray)]
            at, stray = max(end, at + 1), False

    @staticmethod
    def _skip(text: str, at: int) -> int:
        while m := _gap.match(text, at):
            at = m.end()
        return at

    @staticmethod
    def _quoted(text: str, at: int) -> tuple[str, int] | None:
        """The quotation that opens at `at`, plain, and where it ends; None if it is malformed."""
        mark, closers = text[at], QUOTES[text[at]]
        out, i = [], at + 1
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text):
                if text[i + 1] == "u" and re.match(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                    out.append(chr(int(text[i + 2 : i + 6], 16)))
                    i += 6
                else:
                    out.append(text[i + 1])
                    i += 2
            elif c in closers:
                if text[i + 1 : i + 2] == c and mark == c and i > at + 1:
                    out.append(c)
                    i += 2
                elif _boundary.match(text, i + 1):
                    return "".join(out).strip(" \u00a0\t\r\n"), i + 1
                else:
                    out.append(c)
                    i += 1
            else:
                out.append(c)
                i += 1
        return None

    def _bare_end(self, text: str, at: int) -> int:
        ends = [m.start() for rx in (_stop, self._known_next) if (m := rx.search(text, at))]
        return min(ends, default=len(text))
