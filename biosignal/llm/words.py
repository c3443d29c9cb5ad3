"""Words of a text for comparing wording: markup, case, quote marks, invisible and variant characters make no difference."""

from __future__ import annotations

import html
import re
import unicodedata

#: Lower-case letters of other scripts that look like a Latin one (or whose capital does).
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
})
#: Markup that ends a word, and markup that may stand inside one.
BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|blockquote|h[1-6]|hr)\b[^<>]*>|\[/?(?:quote|list|img|url|code|\*)(?:=[^\[\]]*)?\]", re.I)
INLINE = re.compile(r"</?[a-z][^<>]*>|\[/?[a-z]+(?:=[^\[\]]*)?\]", re.I)
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text without markup, in one form of every character, folded to lower case and without accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = INLINE.sub("", BLOCK.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
        text = text.casefold().translate(LOOKALIKES)
        return text
    return text.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text."""
    return WORD.findall(plain(text)) if text else []


#: What html.unescape takes for a character reference.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of words(text) begins and ends in the text as it is written."""
    chars, start, end = list(text), list(range(len(text))), list(range(1, len(text) + 1))

    def replaced(pattern: re.Pattern, by) -> None:
        """Put by(match) in the place of every match; each of its characters stands for the whole match."""
        nonlocal chars, start, end
        whole, at = "".join(chars), 0
        c, s, e = [], [], []
        for m in pattern.finditer(whole):
            new = by(m.group())
            c += chars[at : m.start()] + list(new)
            s += start[at : m.start()] + [start[m.start()]] * len(new)
            e += end[at : m.start()] + [end[m.end() - 1]] * len(new)
            at = m.end()
        chars, start, end = c + chars[at:], s + start[at:], e + end[at:]

    if "&" in text:
        replaced(REFERENCE, html.unescape)
    if "<" in chars or "[" in chars:
        replaced(BLOCK, lambda _: " ")
        replaced(INLINE, lambda _: "")
    out, s, e = [], [], []
    for c, a, b in zip(chars, start, end):
        if c.isascii():
            new = c.lower()
        else:
            new = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Cf")).casefold().translate(LOOKALIKES)
        if not new and e:  # a mark belongs to the character before it
            e[-1] = max(e[-1], b)
        out.append(new)
        s += [a] * len(new)
        e += [b] * len(new)
    return [(s[m.start()], e[m.end() - 1]) for m in WORD.finditer("".join(out))]
