"""Evaluation texts in training text: find, report and remove.

The n-grams of the normalised items form a hash set that every worker holds; a worker turns a batch of documents into
word numbers, looks all its windows up at once, and only documents with hits are looked at word by word. A hit is
extended along the item to both sides, over single words that are altered, dropped or added, and verified: at least
`exact` words in a row, or at least `fuzzy` words in order with at least `run` words on average between edits.

Windows are as long as a passage allows: of words with `run` on average between edits, some `run` stand in a row.

The set is broadcast only up to `max_grams` n-grams. More items are scanned in blocks of items of that size, each a
pass of its own over the documents: a stated query set against all rows. The corpus itself is never moved: spans are cut
where they are found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.llm.words import word_spans, words

#: Words of a window, at most.
GRAM = 5


class Index:
    """The n-grams of a block of items as sorted numbers, with the places where each occurs."""

    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM):
        self.ids, self.gram = [i for i, _ in items], gram
        texts = [words(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.items = [[self.vocabulary[w] for w in t] for t in texts]
        codes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, t in enumerate(self.items):
            c = self.codes(np.array(t, np.int64))[0]
            codes.append(c)
            item.append(np.full(len(c), k))
            place.append(np.arange(len(c)))
        code, item_, place_ = np.concatenate(codes), np.concatenate(item), np.concatenate(place)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item_[order], place_[order]

    @classmethod
    def of(cls, parts: dict) -> "Index":
        """An index out of its parts: these are plain values, and a broadcast of them needs no package on the executors."""
        index = cls.__new__(cls)
        index.__dict__.update(parts)
        return index

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each window of words, and whether all its words are in the vocabulary; others have the number -1. What
        has the same hash is compared word by word when the hit is extended."""
        n = len(numbers) - self.gram + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.gram):
            part = numbers[k : n + k]
            out = (out + (part + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            known &= part >= 0
        return out, known


def extend(doc: list[int], item: list[int], i: int, j: int, step: int) -> tuple[int, int, int, int]:
    """From a match of doc[i] with item[j], go on in one direction: (matched words, edits, last i, first run).

    An edit alters, drops or adds a single word; two words must match after it.
    """
    matched, edits, last, first = 0, 0, i, None
    n, m = len(doc), len(item)

    def fits(a: int, b: int) -> bool:
        return 0 <= a < n and 0 <= b < m and doc[a] == item[b]

    while True:
        if fits(i, j):
            matched += 1
            last = i
            i, j = i + step, j + step
            continue
        first = matched if first is None else first
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            a, b = i + step * di, j + step * dj
            if fits(a, b) and fits(a + step, b + step):
                i, j, edits = a, b, edits + 1
                break
        else:
            return matched, edits, last, first


def leaks_of(doc: list[int], hits: dict[int, list[tuple[int, int]]], index: Index, exact: int, fuzzy: int, run: float) -> list[tuple[int, int, int, int, int]]:
    """(item, words, edits, first word, last word) of every match of each item that leaks into a document, but for those
    that lie inside another of the same item; the longest is always there."""
    out = []
    for item, places in hits.items():
        text, found, seen = index.items[item], {}, set()
        for i, j in places:
            if (i, j) in seen:
                continue
            right, e1, end, first = extend(doc, text, i, j, 1)
            left, e2, start, before = extend(doc, text, i - 1, j - 1, -1) if i and j else (0, 0, i, 0)
            start = start if left else i
            row = first + before  # words in a row around the hit
            # later hits of the same run need no second look
            seen.update((i + k, j + k) for k in range(first))
            total, edits = left + right, e1 + e2
            if row >= exact or (total >= fuzzy and total >= run * (edits + 1)):
                found[start, end] = max(found.get((start, end), (0, 0)), (total, -edits))
        if not found:
            continue
        longest, upto = max(found, key=lambda s: found[s][0]), -1
        for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
            if end > upto or (start, end) == longest:
                total, edits = found[start, end]
                out.append((item, total, -edits, start, end))
                upto = max(upto, end)
    return out


def _scan(texts: list[str], index: Index, exact: int, fuzzy: int, run: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, words, edits, first word, last word) of every passage in a batch of texts; items by their number."""
    lookup, grams, gram = index.vocabulary, np.unique(index.code), index.gram
    docs = [[lookup.get(w, -1) for w in words(t)] for t in texts]
    length = np.array([len(d) for d in docs], np.int64)
    if not length.sum() or not len(grams):
        return
    codes, known = index.codes(np.fromiter((w for d in docs for w in [*d, -1]), np.int64, int(length.sum()) + len(docs)))
    at = np.searchsorted(grams, codes)
    hit = np.flatnonzero(known & (grams[np.minimum(at, len(grams) - 1)] == codes))
    first = np.cumsum(length + 1) - (length + 1)
    owner = np.searchsorted(first, hit, side="right") - 1
    # windows that a passage has: of `exact` words in a row, and of `fuzzy` words in runs of `run` on average
    least = max(1, min(exact - gram + 1, int(np.ceil(fuzzy * (1 - (gram - 1) / run)))))
    for d, own in pd.Series(hit).groupby(owner):
        own = own.to_numpy()
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lo, hi = np.searchsorted(index.code, codes[own]), np.searchsorted(index.code, codes[own], side="right")
        for p, a, b in zip((own - first[d]).tolist(), lo.tolist(), hi.tolist()):
            for k in range(a, b):
                hits[int(index.item[k])].append((p, int(index.place[k])))
        hits = {i: p for i, p in hits.items() if len(p) >= least}
        for item, total, edits, start, end in leaks_of(docs[d], hits, index, exact, fuzzy, run):
            yield d, item, total, edits, start, end


def _blocks(docs: DataFrame, items: DataFrame, item: str, prompt: str, exact: int, run: float, max_grams: int) -> list:
    """Broadcast indexes of the items, which are a stated query set, each of a bounded number of words."""
    rows = items.where(F.col(item).isNotNull() & F.col(prompt).isNotNull()).select(F.col(item).alias("i"), F.col(prompt).alias("p")).distinct()
    gram = max(1, min(GRAM, exact, int(run)))
    out, block, held = [], [], 0
    share = lambda b: out.append(docs.sparkSession.sparkContext.broadcast(vars(Index(b, gram))))
    for r in rows.orderBy("i").toLocalIterator():
        grams = len(r.p.split()) * 2
        if held and held + grams > max_grams:
            share(block)
            block, held = [], 0
        block.append((r.i, r.p))
        held += grams
    share(block)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt", *, exact: int = 12, fuzzy: int = 30, run: float = 5.0, max_grams: int = 2_000_000) -> DataFrame:
    """(id, item_id, words, edits, first_word, last_word): each document and item of which at least `exact` words in a
    row or `fuzzy` words in order stand in it, a row for every such passage with its place in words of the document.
    Passages of an item may overlap, but none lies inside another unless it is the one with most words.

    NULL and empty texts hold nothing; rows without an id take no part; repeated rows give repeated rows; items that
    share a passage all count. Other columns of either input are ignored. Empty in, empty out.
    """
    kinds = dict(docs.dtypes)[id], dict(items.dtypes)[item]
    d = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run_over(shared):
        def scan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index.of(shared.value)
            for f in frames:
                rows = [(f.id.iloc[d], index.ids[i], *rest) for d, i, *rest in _scan(list(f.text), index, exact, fuzzy, run)]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "item_id", "words", "edits", "first_word", "last_word"])

        return d.mapInPandas(scan, f"id {kinds[0]}, item_id {kinds[1]}, words int, edits int, first_word int, last_word int")

    out = None
    for shared in _blocks(docs, items, item, prompt, exact, run, max_grams):
        out = run_over(shared) if out is None else out.unionByName(run_over(shared))
    return out


def cut_words(text: str, spans: Iterable[tuple[int, int]], most: float) -> tuple[str, int, bool]:
    """(text, words cut, keep) without the spans (first and last word): from the first character of a span's first word to
    the last one of its last word; all other characters stay as they are. keep: not more than `most` of the words are cut."""
    at = word_spans(text)
    gone = np.zeros(len(at), bool)
    for a, b in spans:
        gone[a : b + 1] = True
    out, kept, k = [], 0, 0
    while k < len(at):
        if gone[k]:
            e = k
            while e + 1 < len(at) and gone[e + 1]:
                e += 1
            out.append(text[kept : at[k][0]])
            kept, k = at[e][1], e
        k += 1
    return "".join(out) + text[kept:], int(gone.sum()), bool(gone.sum() <= most * len(at))


def remove_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt", *, most: float = 0.5, exact: int = 12, fuzzy: int = 30, run: float = 5.0, max_grams: int = 2_000_000) -> DataFrame:
    """The documents without what leaked: a document of whose words more than `most` leaked is dropped, of the others all
    passages that find_leaks reports are cut out of the text as it is written. Adds `removed_words`.

    Documents without a leak and NULL and empty texts stay as they are; rows without an id are cleaned, too. Nothing is
    shuffled: every block of items adds its spans to the documents it scans, and the last one cuts.
    """
    spans = "__spans"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shares = _blocks(docs, items, item, prompt, exact, run, max_grams)

    def pass_over(shared, first: bool, last: bool):
        def scan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index.of(shared.value)
            for f in frames:
                own = [[] if first else [tuple(s) for s in held] for held in (f[text] if first else f[spans])]
                texts = list(f[text])
                for d, _, _, _, start, end in _scan(texts, index, exact, fuzzy, run):
                    own[d].append((start, end))
                if not last:
                    yield f.assign(**{spans: [[list(s) for s in o] for o in own]})
                    continue
                cut = [cut_words(t, o, most) if o else (t, 0, True) for t, o in zip(texts, own)]
                f = f.drop(columns=[] if first else [spans]).assign(**{text: [c[0] for c in cut], "removed_words": [c[1] for c in cut]})
                yield f[np.array([c[2] for c in cut], bool)]

        return scan

    out = docs
    for k, shared in enumerate(shares):
        last = k == len(shares) - 1
        out = out.mapInPandas(pass_over(shared, k == 0, last), f"{fields}, " + ("removed_words int" if last else f"{spans} array<array<int>>"))
    return out
