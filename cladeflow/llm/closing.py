"""How a commit record closes: what its last lines leave open, and how often its closing word closes a line.

A record is a commit header, a message and a diff, in one of three layouts: ``git`` (``commit <id>``), ``svn``
(``r<number> | author | date``) or ``mail`` (``From <id>``, closed by a signature ``-- `` and a version).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.M)
SIGNATURE = re.compile(r"\n-- \r?\n\d+(?:\.\d+){2}\s*\Z")
#: Marks that stand for the rest of a text.
MARK = re.compile(r"(?: ?\[\.\.\.\]| ?\(cut\)| ?…|\.\.\.)\Z")
FILE_HEAD = re.compile(r"^(?:diff --git |Index: )", re.M)
TRAILER = re.compile(r"^([A-Z][A-Za-z-]+):(?=\s|\Z)")
HEAD_LINE = re.compile(r"^(?:Author|Date|Merge|From|Subject|Commit|AuthorDate|CommitDate|Parent|Parents)\b", re.I)
_HEX = re.compile(r"(?=[a-f]*[0-9])[0-9a-f]{6,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Close:
    layout: str
    #: done, open (the structure itself lacks something), word (up to the closing word's terminality)
    state: str
    region: str
    token: str


def layout_of(text: str) -> str:
    if text.startswith("commit "):
        return "git"
    if text.startswith("From "):
        return "mail"
    return "svn" if re.match(r"r\d+ \| ", text) else "other"


def normal(token: str) -> str:
    """Digits and long hexadecimal numbers, character by character, so that a part stays a prefix of the whole."""
    token = _HEX.sub(lambda m: "h" * len(m.group()), token)
    return _DIGIT.sub("9", token)


def shape(token: str) -> str:
    return _WORD.sub("w", token)


def message_lines(text: str, layout: str) -> list[tuple[str, str]]:
    """(region, line) of the commit message; regions are header, title, body and trailer:<key>."""
    cut = FILE_HEAD.search(text)
    lines = (text[: cut.start()] if cut else text).split("\n")
    out, titled, heading = [], False, layout != "other"
    for i, raw in enumerate(lines):
        line = raw.strip()
        if heading:
            if layout == "mail" and line.startswith("Subject:"):
                out.append(("title", line))
                titled = True
            elif not line and i:
                heading = False
                out.append(("", line))
            else:
                out.append(("header", line))
        elif not line:
            out.append(("", line))
        elif not titled:
            titled = True
            out.append(("title", line))
        else:
            key = TRAILER.match(line)
            out.append((f"trailer:{key[1]}" if key else "body", line))
    return out


def count_tokens(texts: list[str | None]) -> Counter:
    """(region, token, closes a line?) over the message lines that a line break ends."""
    seen: Counter = Counter()
    for text in texts:
        if not text or not text.strip():
            continue
        layout = layout_of(text)
        lines = message_lines(text, layout)
        if FILE_HEAD.search(text) is None and lines:
            lines = lines[:-1]  # the open last line
        for region, line in lines:
            if not region or region == "header":
                continue
            tokens = [normal(t) for t in line.split()]
            for t in tokens[:-1]:
                seen[(region, t, False)] += 1
            if tokens:
                seen[(region, tokens[-1], True)] += 1
        if layout == "mail":
            seen[("layout:mail", "signature", bool(SIGNATURE.search(text)))] += 1
    return seen


def _base85_line(line: str) -> bool:
    """Whether a line of a binary patch is as long as its first character says."""
    c = line[:1]
    n = ord(c) - 64 if "A" <= c <= "Z" else ord(c) - 70 if "a" <= c <= "z" else 0
    return n > 0 and len(line) - 1 == -(-n // 4) * 5


def _open_lines(text: str, head: re.Match) -> tuple[bool, int]:
    """(does the hunk lack lines, where it ends)."""
    old, new = (int(x) if x else 1 for x in head.groups())
    at = text.find("\n", head.end())
    if at < 0:
        return True, len(text)
    at += 1
    while (old > 0 or new > 0) and at < len(text):
        c = text[at]
        if c == "-":
            old -= 1
        elif c == "+":
            new -= 1
        elif c in " \n\r\t":
            old, new = old - 1, new - 1
        elif c != "\\":
            return False, at  # another part begins; what is open lies before it
        at = text.find("\n", at) + 1 or len(text)
    return old > 0 or new > 0, at


def close_of(text: str | None) -> Close | None:
    """How the text closes; None for null and blank texts."""
    if not text or not text.strip():
        return None
    layout = layout_of(text)
    signed = layout == "mail" and SIGNATURE.search(text)
    if signed:
        return Close(layout, "done", "layout:mail", "signature")
    ended = text.endswith(("\n", "\r"))
    files = None
    for files in FILE_HEAD.finditer(text):
        pass
    if files is None:
        if layout == "mail":
            return Close(layout, "unsigned", "layout:mail", "signature")
        if ended:
            return Close(layout, "done", "message", "")
        plain = MARK.sub("", text)
        lines = message_lines(plain, layout)
        region, line = lines[-1]
        tokens = line.split()
        if region == "header":
            return Close(layout, "open", "header", normal(tokens[-1]) if tokens else "")
        marked = len(plain) < len(text)
        if not region or not tokens:
            return Close(layout, "open" if marked else "done", "message", "")
        return Close(layout, "word", region, normal(tokens[-1]))
    hunk = None
    for hunk in HUNK.finditer(text, files.start()):
        pass
    tail = text[files.start() :]
    if hunk is not None:
        lacks, at = _open_lines(text, hunk)
        if lacks:
            return Close(layout, "open", "hunk", "")
        tail = text[at:]
    if layout == "mail":
        return Close(layout, "unsigned", "layout:mail", "signature")
    lines = [x.rstrip("\r") for x in tail.split("\n")]
    while lines and not lines[-1].strip():
        lines.pop()
    if hunk is not None and not any(x.strip() for x in lines):
        return Close(layout, "done", "hunk", "")
    if "GIT binary patch" in lines:
        data = lines[lines.index("GIT binary patch") + 1 :]
        full = len(data) > 1 and _base85_line(data[-1]) and data[-1][0] != "z"
        return Close(layout, "done" if full else "open", "binary", "")
    last = lines[-1] if lines else ""
    if last.startswith("Binary files "):
        return Close(layout, "done" if last.endswith(" differ") else "open", "binary", "")
    if last.startswith("\\ No newline"):
        return Close(layout, "done", "hunk", "")
    if re.match(r"^(?:new mode|rename to|copy to|deleted file mode|new file mode) ", last) or (last.startswith("index ") and any(x.startswith(("deleted file", "new file")) for x in lines)):
        return Close(layout, "done", "file", "")
    if hunk is None or FILE_HEAD.match(tail) or last.startswith(("index ", "--- ", "+++ ", "diff ", "@@")):
        return Close(layout, "open", "file", "")
    return Close(layout, "done", "hunk", "")


def state_of(text: str | None) -> str | None:
    """done, open, unsigned or word, as the exact check of ``truncation.judge``."""
    close = close_of(text)
    return close.state if close else None
