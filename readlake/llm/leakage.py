"""Problem 9: held-out passages in the corpus.

Rare word bigrams of the items seed pairs of document and item: hits are counted by diagonal (position in the text less position in the
item), and Smith-Waterman alignment over words scores each band of diagonals with as many hits as the worst true case has, so that
disguised or edited copies count and sentences of similar manner don't. A stated query set against all rows: the index of the items is
built once, broadcast in blocks of bounded size and looked up in sorted arrays, a batch of texts at a time; the corpus is read once per
block, whole texts, without any shuffle, and a popular passage is just many independent rows.
"""

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.session import spread

#: Items whose texts may share a seed and it still is rare; commoner seeds are taken where an item has too few rare ones.
RARE_ITEMS = (3, 10, 30, 100)
#: Share (tenths) of an item's words that a passage spans at least, and share of the spanned words that are unchanged.
SPAN, IDENTITY = 4, 7
#: Seeds that are enough of a hint: commoner ones are left out as far as so many are sure to be left.
ENOUGH = 3
#: Items that one block broadcasts at most, and characters of their texts.
BLOCK_ITEMS, BLOCK_CHARS = 100_000, 16 << 20
#: Words of a text that are searched at a time, and matches that are counted at a time.
WINDOW, MATCHES = 50_000, 2_000_000
_TAG = re.compile(r"<[^<>]{0,300}>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text: entities and markup undone, compatibility characters folded, invisible characters and accents cut, lower case."""
    if not text:
        return []
    t = _TAG.sub(" ", html.unescape(text)) if "<" in text or "&" in text else text
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) not in ("Cf", "Mn"))
    return _WORD.findall(t.lower())


def least_span(n: int) -> int:
    """Words that a passage of an item of n words spans at least."""
    return max(2, -(-SPAN * n // 10))


def _changes(span: int) -> int:
    """Words of a passage of that span that may be changed."""
    return span - -(-IDENTITY * span // 10)


class Items:
    """The items of a block with the index of their seeds, as plain arrays."""

    def __init__(self, ids, vocabulary, flat, starts, codes, first, item, at, needed) -> None:
        self.ids, self.vocabulary, self.flat, self.starts, self.codes, self.first, self.item, self.at, self.needed = ids, vocabulary, flat, starts, codes, first, item, at, needed

    def parts(self) -> tuple:
        """Plain values, as broadcasts are pickled by reference."""
        return self.ids, self.vocabulary, self.flat, self.starts, self.codes, self.first, self.item, self.at, self.needed

    @classmethod
    def index(cls, items: list[tuple[int, str]]) -> "Items":
        vocabulary: dict[str, int] = {}
        texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in words(t)] for _, t in items]
        v = max(1, len(vocabulary))
        n = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        flat = np.fromiter((w for t in texts for w in t), np.int64, int(starts[-1]))
        item = np.repeat(np.arange(len(texts)), n)
        inner = np.flatnonzero(item[:-1] == item[1:]) if len(item) else np.zeros(0, np.int64)
        code, item, at = flat[inner] * v + flat[inner + 1], item[inner], inner - starts[item[inner]]
        # texts that hold a seed; items of equal text count once
        same: dict[tuple, int] = {}
        kind = np.array([same.setdefault(tuple(t), len(same)) for t in texts], np.int64)
        _, where = np.unique(code, return_inverse=True)
        held = np.unique(where * max(1, len(same)) + kind[item]) // max(1, len(same))
        share = np.bincount(held, minlength=1)[where] if len(where) else np.zeros(0, np.int64)
        needed, keep = np.ones(len(texts), np.int64), np.ones(len(code), bool)
        ends = np.searchsorted(item, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            a, b = ends[i], ends[i + 1]
            if b > a:
                span = least_span(int(n[i]))
                for most in (*RARE_ITEMS, np.inf):
                    rare = share[a:b] <= most
                    # each changed word spoils two bigrams: the fewest that any passage keeps
                    sure = int(np.convolve(rare, np.ones(span - 1, np.int64), "valid").min()) - 2 * _changes(span)
                    if sure >= min(ENOUGH, span - 1 - 2 * _changes(span)):
                        break
                needed[i], keep[a:b] = max(1, sure), rare
        order = np.argsort(code[keep], kind="stable")
        code, item, at = code[keep][order], item[keep][order], at[keep][order]
        codes, first = np.unique(code, return_index=True)
        return cls(np.array([i for i, _ in items], np.int64), vocabulary, flat, starts, codes, np.append(first, len(code)), item, at, needed)

    def found(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of the text, item_id) of the passages that the texts hold, each once."""
        get, longest = self.vocabulary.get, int(np.diff(self.starts).max(initial=0))
        step = max(WINDOW, 4 * longest)
        out: set[tuple[int, int]] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, t in enumerate(texts):
            w = words(t)
            for a in range(0, max(1, len(w)), step - 2 * longest):
                part = np.fromiter((get(x, -1) for x in w[a : a + step]), np.int64)
                held.append((k, part))
                size += len(part)
                if size >= step:
                    out |= self._windows(held)
                    held, size = [], 0
                if a + step >= len(w):
                    break
        out |= self._windows(held)
        return sorted(out)

    def _windows(self, held: list[tuple[int, np.ndarray]]) -> set[tuple[int, int]]:
        if not held or not len(self.codes):
            return set()
        lens = np.array([len(p) for _, p in held])
        begin = np.concatenate([[0], np.cumsum(lens)])
        flat = np.concatenate([p for _, p in held])
        own = np.repeat(np.arange(len(held)), lens)
        k = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0) & (own[:-1] == own[1:])) if len(flat) else np.zeros(0, np.int64)
        code = flat[k] * len(self.vocabulary) + flat[k + 1]
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[slot] == code
        k, slot = k[ok], slot[ok]
        out: set[tuple[int, int]] = set()
        fan = self.first[slot + 1] - self.first[slot]
        reach = np.cumsum(fan)
        a = 0
        while a < len(k):  # whole windows, about MATCHES matches at a time
            b = int(np.searchsorted(reach, (reach[a - 1] if a else 0) + MATCHES)) + 1
            b = int(np.searchsorted(own[k], own[k[min(b, len(k)) - 1]], "right"))
            out |= self._candidates(held, begin, own, flat, k[a:b], slot[a:b], fan[a:b])
            a = b
        return out

    def _candidates(self, held, begin, own, flat, k, slot, fan) -> set[tuple[int, int]]:
        m = np.repeat(np.arange(len(k)), fan)
        entry = self.first[slot][m] + np.arange(len(m)) - np.repeat(np.cumsum(fan) - fan, fan)
        i = self.item[entry]
        w = own[k[m]]
        diagonal = k[m] - begin[w] - self.at[entry]
        n = np.diff(self.starts)
        # the shortest stretch that is a passage has less than twice the least span and drifts by its changed words at most, so it lies
        # within one of two overlapping bands
        half = np.maximum(4, (3 * np.minimum(n, 2 * -(-SPAN * n // 10))) // 10 + 1)[i]
        out: set[tuple[int, int]] = set()
        for shift in (0, 1):
            band = (diagonal + n[i] + shift * half) // (2 * half)
            order = np.lexsort((band, i, w))
            x = [c[order] for c in (w, i, band, diagonal, m, self.at[entry])]
            new = np.ones(len(order), bool)
            new[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(order)))
            for g in np.flatnonzero(count >= self.needed[x[1][at]]):
                s, j = at[g], int(x[1][at[g]])
                key = (held[x[0][s]][0], int(self.ids[j]))
                if key not in out:
                    d, size = x[3][s : s + count[g]], int(n[j])
                    # each seed of a passage is at a place of its own in the text and in the item
                    if min(len(np.unique(x[4][s : s + count[g]])), len(np.unique(x[5][s : s + count[g]]))) < self.needed[j]:
                        continue
                    lo, hi = begin[x[0][s]], begin[x[0][s] + 1]
                    part = flat[max(lo, lo + d.min() - size // 2) : min(hi, lo + d.max() + size + size // 2)]
                    if holds(self.flat[self.starts[j] : self.starts[j + 1]], part):
                        out.add(key)
        return out


def _alike(same: np.ndarray, span: int) -> bool:
    """Whether some stretch of at least span entries has enough ones."""
    if len(same) < span:
        return False
    gain = np.concatenate([[0], np.cumsum(10 * same.astype(np.int64) - IDENTITY)])
    return bool((gain[span:] >= np.minimum.accumulate(gain)[: len(gain) - span]).any())


def holds(item: np.ndarray, part: np.ndarray) -> bool:
    """Whether a stretch of the best local alignment spans enough of the item's words, enough of them unchanged.

    Words of the item that stand nowhere in the part are changed in any alignment, which spares most pairs the alignment."""
    span = least_span(len(item))
    return _alike(np.isin(item, part), span) and _alike(align(item, part), span)


def align(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Best local alignment by Smith-Waterman (match 2, other word -1, gap -1) of the words x and y, coded as numbers: for each word of x
    that it spans, 1 where it is unchanged and 0 where it isn't."""
    h = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    ramp = np.arange(1, len(y) + 1)
    for i in range(1, len(x) + 1):
        row = np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], 2, -1), h[i - 1, 1:] - 1)
        # a gap in the item costs one a word: a running maximum on a ramp
        row = np.maximum.accumulate(np.maximum(row, 0) + ramp) - ramp
        h[i, 1:] = row
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    path: list[int] = []
    while h[i, j] > 0:
        same = x[i - 1] == y[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (2 if same else -1):
            path.append(int(same))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            path.append(0)
            i -= 1
        else:
            j -= 1
    return np.array(path[::-1], np.int64)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks that fit in a broadcast, however many there are."""
    i = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = i.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    n = max(1, -(-size["n"] // (BLOCK_ITEMS // 2)), -(-size["c"] // (BLOCK_CHARS // 2)))
    for k in range(n):
        part = i if n == 1 else i.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document that holds a passage of the item: at least four tenths of its words in its order (two at least).

    Letter case, punctuation, spacing, line marks, markup, invisible characters and up to three in ten changed words don't matter. Null
    and empty texts hold nothing; items with a null id or text, or of fewer than two words, are found nowhere; equal items are found
    together. Each row of documents gives its rows, repeated rows repeated ones; empty tables give an empty result; other columns are
    ignored; texts may be of any length.
    """
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null"))
    out = None
    for block in _blocks(items):
        rows = docs.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(Items.index(block).parts())), "doc_id bigint, item_id bigint")
        out = rows if out is None else out.unionByName(rows)
    return out


def _searcher(block):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        items = Items(*block.value)
        for b in batches:
            got = items.found(b.column(1).to_pylist())
            docs = b.column(0).take(pa.array([k for k, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in got], pa.int64())], names=["doc_id", "item_id"])

    return run
