"""Pages of repeated keywords, lists of links and product tags instead of sentences.

The body of a page (without quotes and signature) is cut into tokens: words, numbers, links, and single characters of scripts
that write no spaces. The repeated substrings of a page are the classes of its suffix automaton that occur more than once.
They are taken from sorted suffixes with common prefixes, which hold the same classes as the automaton and, unlike it, are
built for a whole batch of pages at once in array operations. What repeated maximal substrings cover is one measure.

Coverage alone also finds talk in set phrases, so it is combined with what a sentence has and a list has not. No list of words
is needed for that, and no language: a clause ends with a stop, its words are joined by few commas and signs, and it says
something that is not said again on the page. Characters of a line count as stuffing when it is no clause and is made of links,
tags or repeated phrases, or when, clause or not, a phrase that recurs all over the page fills it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTES = re.compile(r"\[quote[^\]]*\]|\[/quote\]|<blockquote[^>]*>|</blockquote>", re.I)
# a line after a pipe is a quote, but for the row of a table, with pipes between its cells
QUOTE_LINE = re.compile(r"^\s*(?:>|&gt;).*$|^[^\S\n]*\|[^\S\n](?:[^\S\n]|[|>]|&gt;)*[^|\n]*$|^.{0,200}\b(?:wrote|schrieb|escribió|a écrit)\s*:\s*$", re.M | re.I)
#: What every such line has, and what every link has.
QUOTE_SIGN = re.compile(r"[>|]|&gt;|:[^\S\n]*$", re.M | re.I)
LINK_SIGN = re.compile(r"\[(?:url|img)|<a\s|://|www|\.[^\W\d_]{2}| \[dot\] ", re.I)
SIGNATURE = re.compile(r"\n[ \t]*(?:--|—|_{3,}|~{3,}|-{3,}|={3,})[ \t]*\r?\n(?:.*\n?){0,4}\Z")
LINK = re.compile(r"\[(?:url|img)=?[^\]]*\]|<a\s[^>]*>|\[img\][^\[]*\[/img\]|(?:h(?:tt|xx)ps?://|www\.|www \[dot\] )\S*(?: \[dot\] \S+)*|\b[\w-]+(?:(?:\.| \[dot\] )[\w-]+)*(?:\.| \[dot\] )[a-z]{2,}(?:/\S*|\b(?=[\s,|*\]<]|$))", re.I)
MARKUP = re.compile(r"</?[a-z][^<>]*>|\[/?[a-z*]+(?:=[^\[\]]*)?\]", re.I)
BREAK = re.compile(r"<\s*(?:br|/?p|/?div|/?li|/?tr)\b[^>]*>[ \t]*\n?", re.I)
JOINT = re.compile(r"\s[|/•·>*-]+\s|[|;•·]|\.\.\.")
LISTED = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s|#[^\W\d]")
SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\W\d_]|[¿¡\"'\x01])|(?<=[。！？｡؟।])\s*(?=\S)")
#: Scripts without spaces between words: Thai to Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
LETTER = rf"[^\W\d_{UNSPACED}]"
TOKEN = re.compile(rf"\x01|#[^\W\d]\w*|[{UNSPACED}]|{LETTER}+(?:['’]{LETTER}+)*|\d+(?:[.,:]\d+)*")
STOPS, CLOSING = frozenset(".!?…。！？｡؟।"), " \t\r\n\"'’”»)]*"
COMMA = re.compile("[,;:、，；،]")
#: Letters of a run that is cut into single ones: no word is that long.
LONGEST = 40


def body(text: str) -> str:
    """The text without quotes (of any nesting) and without a signature at its end. An opening tag without its closing
    tag, or a closing one without its opening tag, makes no quote: only the tag itself is cut."""
    text = text.replace("\r\n", "\n")
    if "[quote" in text.lower() or "<blockquote" in text.lower():
        tags = list(QUOTES.finditer(text))
        step, open_ = [0] * len(tags), {"[": [], "<": []}
        for k, m in enumerate(tags):
            of = open_[m.group()[0]]
            if m.group()[1] != "/":
                of.append(k)
            elif of:
                step[of.pop()], step[k] = 1, -1
        out, depth, at = [], 0, 0
        for m, s in zip(tags, step):
            if not depth:
                out.append(text[at : m.start()])
            depth += s
            at = m.end()
        out.append(text[at:])
        text = "\n".join(out)
    text = SIGNATURE.sub("", BREAK.sub("\n", text) if "<" in text else text)
    text = QUOTE_LINE.sub("", text) if QUOTE_SIGN.search(text) else text
    return html.unescape(text) if "&" in text else text


def suffix_classes(page: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
    """Of tokens in order of page the class of the substring of 1, 2, 4, ... tokens that begins at each, as far as any
    substring of that length recurs in its page; one that reaches over the end of its page is in a class of its own kind."""
    n = len(token)
    _, rank = np.unique(page * (int(token.max(initial=0)) + 1) + token, return_inverse=True)
    out, k = [rank], 1
    while len(rank) and np.bincount(rank).max() > 1:
        second = np.full(n, -1)
        same = np.flatnonzero(page[k:] == page[: max(0, n - k)])
        second[same] = rank[same + k]
        _, rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)
        out.append(rank)
        k *= 2
    return out


def longest_repeats(page: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """At each token the length of the longest substring that begins there and occurs elsewhere in its page: the longer of the
    common prefixes with its neighbours among the sorted suffixes."""
    n = len(page)
    if n < 2:
        return np.zeros(n, int)
    order = np.argsort(classes[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    left = np.r_[np.flatnonzero(page[1:] != page[:-1]) + 1, n][np.cumsum(np.r_[0, page[1:] != page[:-1]])]  # where each page ends
    end_a, end_b, common = left[a], left[b], np.zeros(n - 1, int)
    for level in range(len(classes) - 1, -1, -1):
        step = 1 << level
        fits = (a + step <= end_a) & (b + step <= end_b)
        equal = np.zeros(n - 1, bool)
        equal[fits] = classes[level][a[fits]] == classes[level][b[fits]]
        common += equal * step
        a, b = np.where(equal, a + step, a), np.where(equal, b + step, b)
    out = np.zeros(n, int)
    np.maximum.at(out, order[:-1], common)
    np.maximum.at(out, order[1:], common)
    return out


def covered(length: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """True for the tokens in one of the substrings that begin at each token, of those that are ok."""
    n = len(length)
    step = np.zeros(n + 1, int)
    at = np.flatnonzero(ok & (length > 0))
    np.add.at(step, at, 1)
    np.add.at(step, at + length[at], -1)
    return np.cumsum(step)[:n] > 0


def keywords(page: np.ndarray, pages: int, size: np.ndarray, allowed: np.ndarray, edge: np.ndarray, classes: list[np.ndarray], often: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, phrase, times): of each page the substring of up to four tokens whose occurrences cover most characters, at
    least `often` of them: where it begins, the tokens it covers, and how often it occurs. It holds allowed tokens only, and
    edge ones at both ends."""
    n = len(page)
    begins, phrase, times = np.zeros(n, bool), np.zeros(n, bool), np.zeros(pages, int)
    upto, blocked = np.r_[0.0, np.cumsum(size)], np.r_[0, np.cumsum(~allowed)]
    best = np.zeros(pages)
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    for k in (1, 2, 3, 4):
        if k > n or (k > 1 and len(classes) < 2) or (k == 4 and len(classes) < 3):
            break
        at = np.arange(n - k + 1)
        at = at[(page[at] == page[at + k - 1]) & (blocked[at + k] == blocked[at]) & edge[at] & edge[at + k - 1]]
        if k == 3:
            _, of = np.unique(classes[1][at] * (n + 1) + classes[0][at + 2], return_inverse=True)
        else:
            of = classes[{1: 0, 2: 1, 4: 2}[k]][at]
        if not len(at):
            continue
        count = np.bincount(of)[of]
        gain = np.where(count >= often, count * (upto[at + k] - upto[at]), 0.0)
        top = np.zeros(pages)
        np.maximum.at(top, page[at], gain)
        better = top > best
        # one class a page: that of the first of equal ones
        mine = np.flatnonzero(better[page[at]] & (gain > 0) & (gain == top[page[at]]))
        _, first = np.unique(page[at][mine], return_index=True)
        wanted = np.full(pages, -1)
        wanted[page[at][mine[first]]] = of[mine[first]]
        own = at[(of == wanted[page[at]])]
        times[page[at][mine[first]]] = count[mine[first]]
        best = np.maximum(best, top)
        chosen.append((better, own, k))
    for rank, (better, own, k) in enumerate(chosen):
        later = np.zeros(pages, bool)
        for other, _, _ in chosen[rank + 1 :]:
            later |= other
        own = own[~later[page[own]]]
        begins[own] = True
        for j in range(k):
            phrase[own + j] = True
    return begins, phrase, times


def sentences(marked: str) -> list[str]:
    """Lines and sentences of a text in which links are \\x01. Lines of plain words that end without a stop go on in the next."""
    out: list[str] = []
    held = ""
    for line in marked.split("\n"):
        letters = sum(map(str.isalpha, line))
        plain = 2 * letters > len(line.strip()) > 0 and "\x01" not in line and not JOINT.search(line) and not LISTED.search(line)
        if held and (not plain or held.rstrip()[-1] in ".!?:"):
            out += SENTENCE.split(held)
            held = ""
        if plain:
            held = f"{held} {line.strip()}" if held else line.strip()
        elif line.strip():
            out += SENTENCE.split(line)
    return [s for s in out + (SENTENCE.split(held) if held else []) if s and not s.isspace()]


IS_LINK, IS_NUMBER, IS_TAG, IS_LONG = 1, 2, 4, 8
UNSPACED_SIGN = re.compile(f"[{UNSPACED}]")


class Facts(dict):
    """What a worker knows of the tokens it has seen: the place of each in lists of (key, characters, bits of IS_LINK ...).

    Spellings of a tag with and without a joint have one key, and all numbers.
    """

    def __init__(self) -> None:
        super().__init__()
        self.key, self.size, self.bits, self.number = [], [], [], {}

    def __missing__(self, token: str) -> int:
        low = token.lower()
        link, number, tag = low == "\x01", low[0].isdigit(), low[0] == "#" and len(low) > 1
        key = low if link else "0" if number else low.replace("_", "").replace("#", "")
        spaced = not (len(low) == 1 and UNSPACED_SIGN.match(low))
        self[token] = len(self.key)
        self.key.append(self.number.setdefault(key, len(self.number)))
        self.size.append(len(token) + spaced)
        self.bits.append(link | number << 1 | tag << 2 | (len(token) > LONGEST and not number and not tag) << 3)
        return self[token]


class Pages:
    """The lines and tokens of a batch of pages, side by side: what is counted is counted for all of them at once."""

    def __init__(self) -> None:
        self.page, self.chars, self.links, self.joints, self.commas, self.stops, self.count = [], [], [], [], [], [], []  # of each line
        self.tokens, self.total = [], []  # of each token; of each page

    def add(self, text: str | None) -> None:
        page = len(self.total)
        self.total.append(0)
        if not text:
            return
        marked = unicodedata.normalize("NFKC", body(text))
        if LINK_SIGN.search(marked):
            marked = LINK.sub(lambda m: "\x01" + "\x02" * (len(m.group()) - 1), marked)
        lines = sentences(MARKUP.sub(" ", marked) if "<" in marked or "[" in marked else marked)
        found = [TOKEN.findall(line) for line in lines]
        for f in found:
            self.tokens += f
        self.count += [len(f) for f in found]
        chars = [len(s.strip()) for s in lines]
        self.page += [page] * len(lines)
        self.chars += chars
        self.links += [s.count("\x01") + s.count("\x02") for s in lines]
        self.joints += [len(JOINT.findall(s)) for s in lines]
        self.commas += [len(COMMA.findall(s)) for s in lines]
        self.stops += [s.rstrip(CLOSING)[-1:] in STOPS for s in lines]
        self.total[page] = sum(chars)

    def numbered(self, known: Facts) -> tuple[np.ndarray, ...]:
        """(line, key, characters, bits) of every token; runs of letters that are too long for a word letter by letter."""
        line = np.repeat(np.arange(len(self.page)), self.count)
        at = np.fromiter(map(known.__getitem__, self.tokens), int, len(self.tokens))
        long = np.flatnonzero(np.array(known.bits, int)[at] & IS_LONG) if len(at) else []
        if len(long):
            whole = set(long.tolist())
            parts = [list(t) if k in whole else [t] for k, t in enumerate(self.tokens)]
            line = np.repeat(line, [len(p) for p in parts])
            at = np.array([known[c] for p in parts for c in p], int)
        return line, np.array(known.key, int)[at], np.array(known.size, float)[at], np.array(known.bits, int)[at]

    def measures(self, known: Facts) -> dict[str, np.ndarray]:
        pages, n = len(self.total), len(self.page)
        page, chars, link_chars, joints = np.array(self.page, int), np.array(self.chars, float), np.array(self.links, float), np.array(self.joints, int)
        of, key, size, bits = self.numbered(known)
        owner = page[of]
        is_link, word = bits & IS_LINK > 0, bits & (IS_LINK | IS_NUMBER) == 0
        classes = suffix_classes(owner, key)
        length = longest_repeats(owner, classes)
        begins, phrase, times = keywords(owner, pages, size, word, word & (size > 2), classes)
        cover = covered(length, np.ones(len(length), bool)) & ~is_link
        # said again: phrases of words, and words that come a third time
        others, at = np.r_[0, np.cumsum(~word)], np.arange(len(length))
        phrases = (length >= 2) & (others[at + length] == others[at])
        often = np.bincount(classes[0])[classes[0]] if len(key) else np.zeros(0, int)
        again = covered(np.where(phrases, length, 1), phrases | (often >= 3) & word & (size > 4))
        count = lambda m: np.bincount(of, m, n)
        words, links, tags = count(word), count(is_link), count(bits & IS_TAG > 0)
        letters, held, kept = count(np.where(word, size, 0)), count(np.where(again & word, size, 0)), count(np.where(phrase, size, 0))
        wordy = letters >= 0.4 * (chars - link_chars)
        jointed = (joints >= 3) & (words <= 7 * (joints + 1))  # a row of a table, or items with something between them
        breaks = np.array(self.commas, int) + joints
        clause = np.array(self.stops, bool) & (words >= 4) & (words >= 2.5 * (breaks + 1)) & ~jointed & ((times[page] < 6) | (kept < 0.5 * letters))
        linked = link_chars >= 0.4 * chars
        listed = ~clause & (linked | (tags >= 3) | (links >= 2) | (wordy & (letters > 0) & (held >= 0.5 * letters)) | (wordy & jointed))
        # link after link, with a few words on each
        listed |= linked & (np.bincount(page, links, pages)[page] >= 5) & (words <= 6 * links)
        # sentences written around the keyword
        filled = wordy & (words >= 4) & (kept >= 0.3 * letters) & (count(begins) >= 2) & (times[page] >= 6)
        stuffed = listed | filled
        total = np.array(self.total, int)
        share = lambda x: np.bincount(page, x, pages) / np.maximum(1, total)
        covers = np.bincount(owner, np.where(cover, size, 0), pages) / np.maximum(1, np.bincount(owner, size, pages))
        tokens = np.bincount(owner, minlength=pages)
        return {"chars": total, "tokens": tokens, "stuffing": share(chars * stuffed), "repeated": covers, "clauses": share(chars * (clause & ~stuffed))}


def measures(text: str | None) -> tuple[int, float, float, float]:
    """(characters of the body, share of them in stuffing, share covered by repeated phrases, share in lines with a clause)."""
    pages = Pages()
    pages.add(text)
    m = pages.measures(Facts())
    return int(m["chars"][0]), float(m["stuffing"][0]), float(m["repeated"][0]), float(m["clauses"][0])


def stuffed_pages(docs: DataFrame, id: str = "doc_id", text: str = "text", *, most: float = 0.5, least_chars: int = 40, least_tokens: int = 5) -> DataFrame:
    """(id, chars, stuffing, repeated, clauses, is_stuffed): the measures of each page, and whether more than `most` of its
    body is stuffing.

    NULL and empty texts, and bodies of fewer than `least_chars` characters and fewer than `least_tokens` tokens, are not
    stuffed; rows without an id take no
    part; repeated rows give repeated rows; whole texts are read, however long. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Facts()
        for f in frames:
            parts = []
            chars = np.cumsum([len(t) if t else 0 for t in f.text])
            a = 0
            while a < len(f):  # some hundred pages at once, and of long ones fewer
                end = max(a + 1, min(a + 500, int(np.searchsorted(chars, (chars[a - 1] if a else 0) + 1_000_000))))
                pages = Pages()
                for t in f.text.iloc[a:end]:
                    pages.add(t)
                parts.append(pd.DataFrame(pages.measures(known)))
                a = end
                if len(known) > 200_000:  # what is known of tokens speeds up a worker's next pages
                    known = Facts()
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out.insert(0, "id", f.id.to_numpy())
                out["is_stuffed"] = (out.stuffing > most) & ((out.chars >= least_chars) | (out.tokens >= least_tokens))
                yield out.drop(columns="tokens")

    d = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"id {kind}, chars bigint, stuffing double, repeated double, clauses double, is_stuffed boolean")
