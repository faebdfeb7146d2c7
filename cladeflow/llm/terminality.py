"""How readily a word closes a line: counts over all lines of a corpus, and what they say of a text's last word.

Words are counted by the *kind of line* that they stand in (its first character, or its first word if that is a label such as
``Subject:``, and whether a blank line comes before it), with digits and hexadecimal numbers made alike. Words that
look like encoded data count by their first character and length: within such data lines end at few lengths.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cladeflow.llm.minhash import Words

#: Marks that stand for the rest of a text.
MARK = re.compile(r"(?: ?\[\.\.\.\]| ?\(cut\)| ?…|\.\.\.)\Z")
OPAQUE = "\x00"
_HEX = re.compile(r"(?=[a-f]*[0-9])[0-9a-f]{6,}")
_DIGIT = re.compile(r"[0-9]")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")


def normal(word: str) -> str:
    """Character by character, so that a part stays a beginning of the whole."""
    if len(word) >= 6 and not word.islower() and not word.isupper() and 2 * (len(_RUNS.findall(word)) - 1) >= len(word) and word.lower() != word.upper():
        return f"{OPAQUE}{word[0]}{len(word)}"
    return _DIGIT.sub("9", _HEX.sub(lambda m: "h" * len(m.group()), word))


def strip_mark(text: str) -> str:
    """``text`` without a mark for the rest at its end."""
    m = MARK.search(text[-8:])
    return text[: len(text) - len(m.group())] if m else text


def kind_of(line: str, first_word: str, after_blank: bool) -> str:
    if len(first_word) > 1 and first_word[-1] == ":" and first_word[0].isalpha():
        kind = first_word
    else:
        kind = "a" if line[:1].isalnum() else line[:1]
    return "^" + kind if after_blank else kind


def count_tokens(words: Words) -> list[tuple[str, str, int, int]]:
    """(kind of line, token, seen, closing) over all lines that a line break ends."""
    n_lines = len(words.lines) - 1
    if not len(words.codes):
        return []
    size = np.diff(words.lines)
    whole = np.ones(n_lines, bool)
    whole[words.texts[1:][np.diff(words.texts) > 0] - 1] = False  # the last line of a text
    after_blank = np.zeros(n_lines, bool)
    after_blank[1:] = size[:-1] == 0
    after_blank[words.texts[:-1][np.diff(words.texts) > 0]] = False
    tokens = [normal(w) for w in words.vocabulary]
    label = np.array([len(w) > 1 and w[-1] == ":" and w[0].isalpha() for w in words.vocabulary], bool)
    chars = pc.utf8_slice_codeunits(words.raw, 0, 1).dictionary_encode()
    char_code, char = chars.indices.to_numpy(), chars.dictionary.to_pylist()
    used = np.flatnonzero(size > 0)
    kind = np.zeros(n_lines, np.int64)
    first = words.codes[words.lines[used]]
    kind[used] = np.where(label[first], len(char) + first, char_code[used]) * 2 + after_blank[used]
    names, codes = np.unique(np.array(tokens, object), return_inverse=True)
    owner = np.repeat(np.arange(n_lines), size)
    closes = np.zeros(len(words.codes), bool)
    closes[words.lines[1:][used] - 1] = True
    counted = whole[owner]
    key = kind[owner][counted] * len(names) + codes[words.codes[counted]]
    found, where = np.unique(key, return_inverse=True)
    seen, closing = np.bincount(where, minlength=len(found)), np.bincount(where, closes[counted], len(found))
    out: dict[tuple[str, str], list[int]] = {}
    for k, a, b in zip(found.tolist(), seen.tolist(), closing.tolist()):
        line, token = divmod(k, len(names))
        line, blank = divmod(line, 2)
        if line < len(char):
            name = "a" if char[line].isalnum() else char[line]
        else:
            name = words.vocabulary[line - len(char)]
        entry = out.setdefault(("^" + name if blank else name, names[token]), [0, 0])
        entry[0] += a
        entry[1] += int(b)
    return [(line, token, a, b) for (line, token), (a, b) in out.items()]


def close_of(text: str) -> tuple[str, str | None] | None:
    """(kind of line, token) of the last word, a mark aside; None where a line break comes last. Blanks alone in the last line, or
    a mark alone, have no token."""
    shown = strip_mark(text)
    at = shown.rfind("\n")
    last = shown[at + 1 :]
    found = last.split()
    if not found:
        return ("", None) if last or len(shown) < len(text) else None
    if shown.endswith("\r"):
        return None
    after_blank = at >= 0 and not shown[shown.rfind("\n", 0, at) + 1 : at].strip()
    return kind_of(last, found[0], after_blank), normal(found[-1])
