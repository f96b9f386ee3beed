"""Mapping of whole tables of reads to many contigs, without a table of words.

Three exchanges of packed blocks: stretches of reads and words of contigs meet by the word's smallest part, matches meet their read, candidates meet their
reference. Rows are blocks of columns, a bucket is held in memory at once and has a bounded share of the input."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.phred import sum_of
from readlake.mapping.align import CODES, Aligner, align, base_probabilities, codes, phred, seed_quality
from readlake.mapping.index import IndexSpec
from readlake.mapping.mapper import SLACK

BLOCK = "bucket int, kind int, block binary"
MAPPED = "read_id long, reason string, back boolean, start long, stop long, score double, cigar array<struct<op:string,len:int>>, sequence string, start_pos long"
_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
_MAPPED = pa.schema(
    [("read_id", pa.int64()), ("reason", pa.string()), ("back", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]
    + [("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("sequence", pa.string()), ("start_pos", pa.int64())]
)
#: Bytes of reads, by the planner's estimate, for one bucket.
BUCKET_BYTES = 6 << 20
#: Bases, words or matches that are worked on at once.
BASES, WORDS, MATCHES = 1 << 21, 1 << 20, 1 << 21
#: Bytes of rows, and bases of candidates, that are dealt out together.
ROWS, HELD = 1 << 25, 1 << 23
#: Cells, and pairs, of the batched alignment that are held at once.
CELLS, BATCH = 1 << 23, 64
#: Kinds of blocks: the side that is looked up in, the side that looks up, reads that are done.
PLACES, READS, DONE = 0, 1, 2
REASONS = ["no_seeds", "repeats_only", "too_many_seeds"]
U = np.uint64


def pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block, byte by byte of their values, so that like bytes lie together."""
    head = ",".join(f"{c.dtype.str}:{len(c)}" for c in columns).encode()
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return head + b"\n" + pa.compress(body, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    head, body = block.split(b"\n", 1)
    shapes = [(np.dtype(t), int(n)) for t, n in (x.split(":") for x in head.decode().split(","))]
    raw = np.frombuffer(pa.decompress(body, sum(t.itemsize * n for t, n in shapes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t, n in shapes:
        out.append(np.ascontiguousarray(raw[at : at + t.itemsize * n].reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += t.itemsize * n
    return out


def merged(blocks: list[bytes]) -> list[np.ndarray]:
    """The columns of several blocks."""
    return [np.concatenate(c) for c in zip(*map(unpack, blocks), strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U) * U(0x9E3779B97F4A7C15)
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(32)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x) % U(buckets)).astype(np.int32)


def dealt(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Blocks of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    sorted_ = [c[order] for c in columns]
    blocks = [pack(*[c[i:j] for c in sorted_]) for i, j in zip(cuts, np.r_[cuts[1:], len(b)][: len(cuts)], strict=True)]
    return pa.record_batch([pa.array(b[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int32()), pa.array(blocks, pa.binary())], schema=_BLOCK)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def dealt_texts(bucket: np.ndarray, kind: int, columns: list[np.ndarray], texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """dealt for rows with texts (starts, lengths, values); the lengths stand among columns."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    blocks = []
    for i, j in zip(cuts, np.r_[cuts[1:], len(b)][: len(cuts)], strict=True):
        o = order[i:j]
        blocks.append(pack(*[c[o] for c in columns], *[v[ragged(s[o], n[o])] for s, n, v in texts]))
    return pa.record_batch([pa.array(b[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int32()), pa.array(blocks, pa.binary())], schema=_BLOCK)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """Blocks by kind of each bucket; rows come in order of buckets."""
    now, got = None, {}
    for batch in batches:
        for bucket, kind, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != now and got:
                yield got
                got = {}
            now = bucket
            got.setdefault(kind, []).append(block)
    if got:
        yield got


# --- words -----------------------------------------------------------------------------------------------------------------------------------

_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _i
_SPREAD = {c: [b for b, bit in (("A", 1), ("C", 2), ("T", 4), ("G", 8)) if i & bit] for i, c in enumerate(CODES) if i}


def windows(c: np.ndarray, k: int) -> np.ndarray:
    """All stretches of k bases as numbers, two bits a base, the first base highest."""
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, step, size = np.zeros(n, U), 0, c.astype(U), 1
    while have < k:
        if k & size:
            out = (out << U(2 * size)) | step[have : have + n]
            have += size
        if have < k:
            step = (step[:-size] << U(2 * size)) | step[size:]
            size *= 2
    return out


def backward(w: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of stretches of k bases."""
    x = ~w
    for bits, mask in ((U(2), U(0x3333333333333333)), (U(4), U(0x0F0F0F0F0F0F0F0F))):
        x = ((x >> bits) & mask) | ((x & mask) << bits)
    return x.byteswap() >> U(64 - 2 * k)


def part_size(k: int) -> int:
    return max(1, k // 2)


def parts(w: np.ndarray, m: int) -> np.ndarray:
    """Order of parts of m bases, the same on both strands."""
    return mix(np.minimum(w, backward(w, m)))


def smallest_parts(words: np.ndarray, k: int) -> np.ndarray:
    """The smallest part of each word."""
    m = part_size(k)
    mask, out = U((1 << 2 * m) - 1), None
    for i in range(k - m + 1):
        h = parts((words >> U(2 * i)) & mask, m)
        out = h if out is None else np.minimum(out, h)
    return out


def stretches(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of words, bases and smallest part of the stretches of words that share it; c is 4 where no base is."""
    m = part_size(k)
    clean = np.where(c < 4, c, 0)
    bad = np.r_[0, np.cumsum(c > 3)]
    at = np.flatnonzero(bad[k:] == bad[:-k]) if len(c) >= k else np.zeros(0, int)
    if not len(at):
        return at, at, np.zeros(0, U), np.zeros(0, U)
    w, h, n = windows(clean, k), parts(windows(clean, m), m), len(c) - k + 1
    least, have, need = h, 1, k - m + 1
    while have < need:
        more = min(have, need - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    g = least[:n][at]
    new = np.r_[True, (np.diff(at) != 1) | (g[1:] != g[:-1])]
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    first = np.flatnonzero(within % min(k - m + 1, 33 - k) == 0)
    n = np.diff(np.r_[first, len(at)])
    more = (2 * (n - 1)).astype(U)
    bases = (w[at[first]] << more) | (w[at[first + n - 1]] & ((U(1) << more) - U(1)))
    return at[first], n, bases, g[first]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a line end after each as codes; starts and lengths."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    return raw, starts_of(n + 1), n


def _latin(x: str | None) -> bytes:
    return b"" if x is None else x.upper().encode("latin-1", "replace")


def gathered(rows: Iterator[tuple[int, bytes]], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids, texts, size = [], [], 0
    for i, t in rows:
        ids.append(i)
        texts.append(t)
        size += len(t) + 1
        if size >= most:
            yield np.array(ids, np.int64), texts
            ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that blocks are not many and small."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def read_stretches(k: int, buckets: int):
    """Stretches of words of reads (read_id, sequence)."""

    def run(batches):
        rows = ((i, _latin(s)) for b in batches for i, s in zip(*[c.to_pylist() for c in b.columns], strict=True) if s is not None)
        for ids, texts in gathered(rows, BASES):
            raw, starts, _ = joined(texts)
            at, n, bases, part = stretches(_BASE[raw], k)
            r = np.searchsorted(starts, at, "right") - 1
            yield dealt(bucket_of(part, buckets), READS, ids[r], (at - starts[r]).astype(np.uint32), n.astype(np.uint8), bases)

    return run


def contig_words(spec: IndexSpec, buckets: int):
    """Words of contigs (offset, bases) as genome_words makes them."""
    k = spec.k

    def pieces(batches):
        for b in batches:
            for o, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                t = _latin(s)
                for i in range(0, len(t) - k + 1, BASES):
                    yield o + i, t[i : i + BASES + k - 1]

    def run(batches):
        for offsets, texts in gathered(pieces(batches), BASES):
            raw, starts, _ = joined(texts)
            c = _BASE[raw]
            r = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(raw)]))
            pos = offsets[r] + np.arange(len(raw)) - starts[r]
            at = np.flatnonzero(pos[: max(0, len(raw) - k + 1)] % spec.stride == 0)
            bad, ends = np.r_[0, np.cumsum(c > 3)], np.r_[0, np.cumsum(raw == 10)]
            at = at[ends[at + k] == ends[at]]
            plain = bad[at + k] == bad[at]
            words, places = [windows(np.where(c < 4, c, 0), k)[at[plain]]], [pos[at[plain]]]
            for i in at[~plain]:
                options = [_SPREAD.get(x, []) for x in raw[i : i + k].tobytes().decode("latin-1").replace("U", "T")]
                size = int(np.prod([float(len(x)) for x in options]))
                if size and (spec.expansions is None or size <= spec.expansions):
                    w = np.frombuffer("".join("".join(p) for p in product(*options)).encode(), np.uint8).reshape(-1, k)
                    words.append(np.concatenate([windows(_BASE[x], k) for x in w]))
                    places.append(np.full(size, pos[i]))
            w, p = np.concatenate(words), np.concatenate(places)
            same = np.zeros(len(w), bool)
            for n in range(1, (k // 2 if spec.repeat is None else spec.repeat) + 1):
                same |= (w >> U(2 * n)) == (w & U((1 << 2 * (k - n)) - 1))
            w, p = w[~same], p[~same]
            yield dealt(bucket_of(smallest_parts(w, k), buckets), PLACES, w, p)

    return run


def matches(spec: IndexSpec, buckets: int):
    """Matches (read_id, position, offset as read_words has it) by read, and reads with words at cutoff or more places."""
    k, mask = spec.k, U((1 << 2 * spec.k) - 1)

    def run(batches):
        kept, size = [], 0

        def flushed():
            got = [np.concatenate(c) for c in zip(*kept, strict=True)]
            return dealt(bucket_of(got[0], buckets), PLACES, *got)

        for blocks in by_bucket(batches):
            if PLACES not in blocks or READS not in blocks:
                continue
            w, p = merged(blocks[PLACES])
            order = np.argsort(w, kind="stable")
            w, p = w[order], p[order]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            known, n = w[first], np.diff(np.r_[first, len(w)])
            useless = np.zeros(len(n), bool) if spec.cutoff is None else n >= spec.cutoff
            hot = []
            ids, offs, words, bases = merged(blocks[READS])
            words = words.astype(np.int64)
            for a in np.array_split(np.arange(len(ids)), -(-int(words.sum()) // WORDS)):
                e = np.repeat(a, words[a])
                i = np.arange(len(e)) - np.repeat(starts_of(words[a]), words[a])
                one = (bases[e] >> (2 * (words[e] - 1 - i)).astype(U)) & mask
                at = offs[e].astype(np.int64) + i
                for x, off in ((one, at + 1), (backward(one, k), -at - k)):
                    f = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    hit = np.flatnonzero(known[f] == x)
                    f = f[hit]
                    hot.append(np.unique(ids[e[hit[useless[f]]]]))
                    hit, f = hit[~useless[f]], f[~useless[f]]
                    # a word's places are many at most where there is no cutoff
                    for cut in np.split(np.arange(len(hit)), np.searchsorted(np.cumsum(n[f]), np.arange(MATCHES, int(n[f].sum()), MATCHES))):
                        g, m = f[cut], n[f[cut]]
                        kept.append((np.repeat(ids[e[hit[cut]]], m), p[ragged(first[g], m)], np.repeat(off[hit[cut]], m).astype(np.int32)))
                        size += len(kept[-1][0])
                        if size >= MATCHES:
                            yield flushed()
                            kept, size = [], 0
            if any(len(x) for x in hot):
                x = np.unique(np.concatenate(hot))
                yield dealt(bucket_of(x, buckets), DONE, x)
        if kept:
            yield flushed()

    return run


# --- candidates -------------------------------------------------------------------------------------------------------------------------------


def read_blocks(buckets: int):
    """Reads (read_id, sequence, quality) by read."""

    def run(batches):
        for b in larger(batches):
            ids = b.column(0).to_numpy()
            texts = [_latin(s) for s in b.column(1).to_pylist()]
            n = np.array([len(t) for t in texts], np.int64)
            q = b.column(2).combine_chunks()
            q = q if isinstance(q, pa.Array) else q.chunk(0)
            # the values of those present
            values = q.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            m = np.array([-1 if x is None else x for x in pc.list_value_length(q).to_pylist()], np.int32)
            if (m[m >= 0] != n[m >= 0]).any():
                raise ValueError("a quality has not the length of its sequence")
            have = np.maximum(m, 0).astype(np.int64)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            yield dealt_texts(bucket_of(ids, buckets), READS, [ids, n.astype(np.int32), m], [(starts_of(n), n, raw), (starts_of(have), have, values)])

    return run


def seeds_of(read: np.ndarray, pos: np.ndarray, off: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """read, diagonal, offset and size of the seeds, as combine_seeds makes them."""
    diag = pos - off
    order = np.lexsort((-off, diag, read))
    read, diag, off = read[order], diag[order], off[order]
    if len(read):
        same = np.r_[False, (read[1:] == read[:-1]) & (diag[1:] == diag[:-1])]
        gap = np.r_[0, off[:-1] - off[1:]]
        first = np.flatnonzero(~(same & (gap <= k)))
        last = np.r_[first[1:], len(read)] - 1
        size = off[first] - off[last] + k
        keep = size >= least
        read, diag, off, size = read[first][keep], diag[first][keep], off[last][keep], size[keep]
    else:
        size = off
    order = np.lexsort((size, -off, -diag, off < 0, read))
    read, diag, off, size = read[order], diag[order], off[order], size[order]
    near = np.r_[False, (read[1:] == read[:-1]) & ((off[1:] < 0) == (off[:-1] < 0)) & (diag[:-1] - diag[1:] <= 8)] if len(read) else np.zeros(0, bool)
    keep = np.ones(len(read), bool)
    last = -1
    # runs of neighbours: the last one kept stands against the next
    for i in np.flatnonzero(near):
        if not near[i - 1]:
            last = i - 1
        if diag[last] - diag[i] > 8:
            last = i
        elif size[i] > size[last]:
            keep[last], last = False, i
        else:
            keep[i] = False
    return read[keep], diag[keep], off[keep], size[keep]


def candidates(k: int, least: int, repeat_threshold: int | None, chunk: int, buckets: int):
    """Candidates by the piece of reference they start in, and the reads that are done, with their reason."""

    def run(batches):
        held, bases = [], 0

        def flushed():
            *columns, raw, quality = [np.concatenate(c) for c in zip(*held, strict=True)]
            n, m = columns[-2].astype(np.int64), np.maximum(columns[-1], 0).astype(np.int64)
            return dealt_texts(bucket_of(columns[1] // chunk, buckets), READS, columns, [(starts_of(n), n, raw), (starts_of(m), m, quality)])

        for blocks in by_bucket(batches):
            if READS not in blocks:
                continue
            ids, n, m, raw, quality = merged_reads(blocks[READS])
            order = np.argsort(ids, kind="stable")
            text_at, quality_at = starts_of(n)[order], starts_of(np.maximum(m, 0))[order]
            ids, n, m = ids[order], n[order], m[order]
            reason = np.zeros(len(ids), np.int8)
            if DONE in blocks:
                reason[np.searchsorted(ids, merged(blocks[DONE])[0])] = 1
            r, p, o = merged(blocks[PLACES]) if PLACES in blocks else (np.zeros(0, np.int64),) * 3
            r, d, o, size = seeds_of(np.searchsorted(ids, r), p, o.astype(np.int64), k, least)
            clumps = np.bincount(r, minlength=len(ids))
            reason[clumps > 0] = -1
            if repeat_threshold is not None:
                reason[clumps >= repeat_threshold] = 2
                few = reason[r] < 0
                r, d, o, size = r[few], d[few], o[few], size[few]
            done = reason >= 0
            if done.any():
                yield dealt(bucket_of(ids[done], buckets), DONE, ids[done], reason[done])
            if not len(r):
                continue
            back, ref = o < 0, d + o
            begin = np.where(back, ref - (n[r] + o), ref - o + 1)
            start, end = np.maximum(0, begin - SLACK), begin + n[r] + SLACK
            # seeds of one neighbourhood have one window
            order = np.lexsort((start, back, r))
            r, back, start, end, ref, o, size = (x[order] for x in (r, back, start, end, ref, o, size))
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (back[1:] != back[:-1]) | (start[1:] != start[:-1])])
            end = np.repeat(np.maximum.reduceat(end, first), np.diff(np.r_[first, len(r)]))
            columns = [ids[r], start, np.maximum(0, end - start).astype(np.int32), (ref - start).astype(np.int32), o.astype(np.int32), size.astype(np.int32), n[r].astype(np.int32), m[r].astype(np.int32)]
            held.append([*columns, raw[ragged(text_at[r], n[r])], quality[ragged(quality_at[r], np.maximum(m[r], 0))]])
            bases += len(held[-1][-2])
            if bases >= HELD:
                yield flushed()
                held, bases = [], 0
        if held:
            yield flushed()

    return run


def merged_reads(blocks: list[bytes]) -> list[np.ndarray]:
    ids, n, m, raw, quality = merged(blocks)
    return [ids, n.astype(np.int64), m.astype(np.int64), raw, quality]


def contig_blocks(chunk: int, reach: int, buckets: int):
    """Contigs (sequence, offset, range_start, range_end, bases) by the pieces of chunk positions they touch; a piece goes on for reach positions."""

    def run(batches):
        for b in larger(batches):
            names, offsets, lo, hi, bases = (c.to_pylist() for c in b.columns)
            texts, names = [_latin(s) for s in bases], [(x or "").encode() for x in names]
            n, o = np.array([len(t) for t in texts], np.int64), np.array(offsets, np.int64)
            first, last = np.maximum(0, (o - reach) // chunk), (o + n - 1) // chunk
            count = np.where(n > 0, np.maximum(0, last - first + 1), 0)
            r = np.repeat(np.arange(len(n)), count)
            piece = np.repeat(first, count) + np.arange(len(r)) - np.repeat(starts_of(count), count)
            a, z = np.maximum(o[r], piece * chunk), np.minimum(o[r] + n[r], (piece + 1) * chunk + reach)
            r, piece, a, z = (x[z > a] for x in (r, piece, a, z))
            m = np.array([len(x) for x in names], np.int64)
            raw, name = np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(b"".join(names), np.uint8)
            columns = [piece, o[r], np.array(lo, np.int64)[r], np.array(hi, np.int64)[r], a, (z - a).astype(np.int32), m[r].astype(np.int32)]
            yield dealt_texts(bucket_of(piece, buckets), PLACES, columns, [(starts_of(n)[r] + a - o[r], z - a, raw), (starts_of(m)[r], m[r], name)])

    return run


# --- alignment ----------------------------------------------------------------------------------------------------------------------------------

_COMPLEMENT = bytes.maketrans(b"ACGTUMRWSYKVHDBN", b"TGCAAKYWSRMBDHVN")


def penalties(mat: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Penalty by score (an index into values), letter of the read and letter of the reference, both as codes; mat is one of the aligner's matrices."""
    return np.stack([-10 * np.log10(np.maximum(mat @ base_probabilities(CODES, [q] * 16).T, 1e-300)).T for q in values.tolist()])


def stacked(reads: list[np.ndarray], refs: list[np.ndarray], batch: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reads and references of a batch as rows, filled up with 0; their lengths."""
    n, m = (np.array([len(y[i]) for i in batch]) for y in (reads, refs))
    x, r = np.zeros((len(batch), n.max()), np.int64), np.zeros((len(batch), m.max()), np.int64)
    for b, i in enumerate(batch):
        x[b, : n[b]] = reads[i]
        r[b, : m[b]] = refs[i]
    return x, r, n, m


def without_gaps(reads: list[np.ndarray], refs: list[np.ndarray], pen: np.ndarray, opn: float, gap: float, limits: np.ndarray, batch: list[int], out: list) -> None:
    """Alignments without gaps into out, where none with a gap can be as good: it costs a gap, and the least of all bases but one."""
    x, r, n, m = stacked(reads, refs, batch)
    shifts = np.arange(max(0, int((m - n).max()) + 1))
    if not len(shifts):
        return
    inside = np.arange(x.shape[1]) < n[:, None]
    least, flat = np.where(inside, pen.min(axis=1)[x], 0), pen.reshape(-1)
    total = np.zeros((len(batch), len(shifts)))
    for i in range(x.shape[1]):
        total += np.where(inside[:, i : i + 1], flat[x[:, i : i + 1] * 16 + r[:, np.minimum(i + shifts, r.shape[1] - 1)]], 0)
    total[shifts > (m - n)[:, None]] = np.inf
    best = total.argmin(axis=1)
    score = total[np.arange(len(batch)), best]
    sure = (score < opn + least.sum(axis=1) - least.max(axis=1) - 1e-6) & (least.max(axis=1) <= gap) & (pen.min() >= 0)
    for b in np.flatnonzero(sure & (score <= limits[batch])).tolist():
        out[batch[b]] = (float(score[b]), int(best[b]), int(best[b] + n[b]), [("M", int(n[b]))])


def align_many(reads: list[np.ndarray], refs: list[np.ndarray], pen: np.ndarray, opn: float, ext: float, limits: np.ndarray) -> list[tuple[float, int, int, list[tuple[str, int]]] | None]:
    """What align gives without single-stranded ends, for many pairs at once. reads index the rows of pen, refs are codes; opn and ext are penalties of gaps."""
    out: list = [None] * len(reads)
    inf = 1e30
    flat_pen = pen.reshape(-1)
    order = sorted((i for i in range(len(reads)) if len(reads[i]) and len(refs[i])), key=lambda i: (len(reads[i]), len(refs[i])))
    for i in range(0, len(order), 8 * BATCH):
        without_gaps(reads, refs, pen, opn, min(opn, ext), limits, order[i : i + 8 * BATCH], out)
    order = [i for i in order if out[i] is None]
    while order:
        # the last, longest pair of a batch tells how many fit
        take = max(1, min(BATCH, CELLS // (len(reads[order[-1]]) * (len(refs[order[-1]]) + 1) * 3)))
        batch, order = order[-take:], order[:-take]
        n, size = len(reads[batch[-1]]), len(batch)
        m = max(len(refs[i]) for i in batch)
        x, r, length, _ = stacked(reads, refs, batch)
        x *= 16
        ramp = ext * np.arange(m + 1)
        one, ins, gap = np.zeros((size, m + 1)), np.full((size, m + 1), inf), np.full((size, m + 1), inf)
        back = np.zeros((n, 3, size, m + 1), np.int8)
        last, shifted, flat = np.zeros((size, 2, m + 1)), np.full((size, m + 1), inf), np.empty((size, m + 1))
        for i in range(n):
            value = np.minimum(one, ins)
            np.less(ins[:, :-1], one[:, :-1], out=back[i, 0, :, 1:], casting="unsafe")
            np.copyto(back[i, 0, :, 1:], 2, where=gap[:, :-1] < value[:, :-1])
            np.minimum(value, gap, out=value)
            new = np.empty((size, m + 1))
            new[:, 0] = inf
            np.add(value[:, :-1], flat_pen[x[:, i : i + 1] + r], out=new[:, 1:])
            u, v = one + opn, ins + ext
            np.less(v, u, out=back[i, 1], casting="unsafe")
            ins = np.minimum(u, v)
            shifted[:, 1:] = new[:, :-1] + opn
            shifted[:, 1:] -= ramp[1:]
            np.minimum.accumulate(shifted, axis=1, out=flat)
            gap = flat + ramp
            np.copyto(back[i, 2], 2, where=shifted > flat)
            one = new
            ends = length == i + 1
            if ends.any():
                last[ends, 0], last[ends, 1] = one[ends], ins[ends]
        best, pair = last.reshape(size, -1).argmin(axis=1), np.arange(size)
        s, j = np.divmod(best, m + 1)
        total, stop, left, path = last[pair, s, j], j.copy(), length.copy(), []
        while (going := left > 0).any():
            path.append(np.where(going, s, 3))
            come = back[left - 1, s, pair, j]
            left -= going & (s != 2)
            j -= going & (s != 1)
            s = np.where(going, come, s)
        ways = np.array(path, np.uint8)[::-1].T
        plain = ((ways == 0) | (ways == 3)).all(axis=1)
        for b, i in enumerate(batch):
            if total[b] >= inf or total[b] > limits[i]:
                continue
            cigar = [("M", len(reads[i]))] if plain[b] else [("MID"[o], len(list(g))) for o, g in groupby(ways[b].tolist()) if o < 3]
            out[i] = (float(total[b]), int(j[b]), int(stop[b]), cigar)
    return out


def alignments(a: Aligner, least: int, chunk: int, reach: int):
    """Alignments of candidates with the contig they begin in, rows without a score for those beyond the limit, and the reads that are done."""
    opn, ext = phred(a.gap_extension if a.gap_open is None else a.gap_open), phred(a.gap_extension)
    # an aligner's cached method would need the package on the executors, so it travels only where it is called
    mat, most, single = a.matrices()[0], a.max_penalty_per_nuc, None if a.mean_overhang is None else partial(align, a=a)

    def aligned(blocks):
        ids, start, width, ref_at, o, size, n, m, raw, quality = merged(blocks[READS])
        n, m = n.astype(np.int64), m.astype(np.int64)
        values, q = np.unique(np.r_[quality, 30], return_inverse=True)
        pen = penalties(mat, values)
        none = q[-1]
        c = codes(raw.tobytes().decode("latin-1"))
        at = starts_of(n)
        # scores of all bases; reads without have 30
        score = np.full(len(raw), none)
        have = m >= 0
        score[ragged(at[have], m[have])] = q[:-1]
        own = np.diagonal(pen, axis1=1, axis2=2)
        sure = ((pen <= own[:, :, None] + 1e-9).sum(axis=2) == 1) & (own < min(opn, ext))
        sure[:, [x for x in range(16) if x not in (1, 2, 4, 8)]] = False
        total = np.add.reduceat(own[score, c], at)
        exact = np.logical_and.reduceat(sure[score, c], at) & (total <= most * n) & (single is None)
        pen_rows, x = pen.reshape(-1, 16), score * 16 + c
        where = contigs_of(blocks.get(PLACES, []))
        rows: list = [None] * len(ids)
        left, reads, refs = [], [], []
        now, bases, marks, piece_of = None, None, [], (start // chunk).tolist()
        for i in np.argsort(start // chunk, kind="stable").tolist():
            if piece_of[i] != now:
                now = piece_of[i]
                bases, marks = where(now)
            s = raw[at[i] : at[i] + n[i]].tobytes()
            lo = int(start[i]) - now * chunk
            ref = bases[lo : lo + width[i]].tobytes()
            is_back = o[i] < 0
            strand = s.translate(_COMPLEMENT)[::-1] if is_back else s
            first = len(s) + int(o[i]) if is_back else int(o[i]) - 1
            u, v = ref[ref_at[i] :][: size[i]].replace(b"U", b"T"), strand[first:][: size[i]]
            rows[i] = [bool(is_back), None, marks]
            if (u != v or len(u) < least) and not seed_quality(u.decode("latin-1"), v.decode("latin-1"), 0, least):
                continue
            if is_back:
                ref = ref.translate(_COMPLEMENT)[::-1]
            j = ref.find(s) if exact[i] else -1
            if j >= 0:
                rows[i][1] = (float(total[i]), j, j + len(s), [("M", len(s))])
            elif single is not None:
                q_ = None if m[i] < 0 else values[score[at[i] : at[i] + n[i]]].tolist()
                rows[i][1] = single(s.decode("latin-1"), q_, ref.decode("latin-1"), limit=most * len(s))
            else:
                left.append(i)
                reads.append(x[at[i] : at[i] + n[i]])
                refs.append(codes(ref.decode("latin-1")))
        for i, got in zip(left, align_many(reads, refs, pen_rows, opn, ext, most * n[left]), strict=True):
            rows[i][1] = got
        out = []
        for i, (is_back, got, marks) in enumerate(rows):
            if got is None:
                out.append((int(ids[i]), None, is_back, None, None, None, None, None, None))
                continue
            value, j, e, cigar = got
            lo, hi = (int(start[i] + width[i]) - e, int(start[i] + width[i]) - j) if is_back else (int(start[i]) + j, int(start[i]) + e)
            mark = max((x for x in marks if x[0] <= lo), default=None)
            name, pos = (mark[1], lo - mark[0] + mark[2]) if mark and lo - mark[0] < mark[3] - mark[2] else (None, None)
            out.append((int(ids[i]), None, is_back, lo, hi, value, [{"op": y, "len": z} for y, z in cigar], name, pos))
        return out

    def contigs_of(blocks):
        if not blocks:
            return lambda p: (np.full(chunk + reach, ord("N"), np.uint8), [])
        piece, offset, lo, hi, begin, n, m, raw, name = merged(blocks)
        at, name_at = starts_of(n.astype(np.int64)), starts_of(m.astype(np.int64))
        order = np.lexsort((offset, piece))
        piece_, name = piece[order], name.tobytes()
        rows = list(zip(*[x[order].tolist() for x in (offset, lo, hi, begin - piece * chunk, at, n, name_at, m)], strict=True))

        def where(p):
            """Letters of the piece, and its contigs as (offset, name, range_start, range_end)."""
            bases, marks = np.full(chunk + reach, ord("N"), np.uint8), []
            for o, x, y, first, i, size, j, length in rows[np.searchsorted(piece_, p) : np.searchsorted(piece_, p, "right")]:
                there = bases[first : first + size]
                # several contigs may lie there: the letters of all are laid over each other
                np.copyto(there, raw[i : i + size], where=there == 78)
                marks.append((o, name[j : j + length].decode(), x, y))
            return bases, marks

        return where

    def run(batches):
        for blocks in by_bucket(batches):
            rows = aligned(blocks) if READS in blocks else []
            if DONE in blocks:
                ids, reason = merged(blocks[DONE])
                rows += [(i, REASONS[r], None, None, None, None, None, None, None) for i, r in zip(ids.tolist(), reason.tolist(), strict=True)]
            for i in range(0, len(rows), 1 << 15):
                columns = zip(*rows[i : i + (1 << 15)], strict=True)
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _MAPPED, strict=True)], schema=_MAPPED)

    return run


def map_all(reads: DataFrame, contigs: DataFrame, genome: str, spec: IndexSpec, aligner: Aligner | None = None, least: int = 16, repeat_threshold: int | None = None, chunk: int = 1 << 14) -> DataFrame:
    """What mapper.map_reads gives for one genome, of contigs that lie beside each other, with words of up to 31 bases, none changed.

    reads: read_id (unique), sequence, quality; contigs: genome_name, sequence, offset, range_start, range_end, bases. Reads and contigs are read twice each; what is exchanged
    grows with the reads, the words kept of the contigs, and the matches. One small job finds the longest read. chunk is the length of a piece of reference: a few times the distance of contigs where they are
    short and many."""
    if not 1 <= spec.k <= 31:
        raise ValueError(f"words of {spec.k}: 1 to 31 bases fit")
    a = aligner or Aligner()
    r = reads.select("read_id", "sequence", F.col("quality").cast("array<int>").alias("quality"))
    c = contigs.where((F.col("genome_name") == genome) & F.col("bases").isNotNull()).select("sequence", F.col("offset").cast("bigint").alias("offset"), F.col("range_start").cast("bigint").alias("range_start"), F.col("range_end").cast("bigint").alias("range_end"), "bases")
    size = max(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in (reads, contigs))
    buckets = max(4 * reads.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    reach = (reads.agg(F.max(F.length("sequence"))).first()[0] or 0) + 2 * SLACK
    chunk = max(chunk, reach)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.unionByName(y).repartition("bucket").sortWithinPartitions("bucket")

    words = met(r.select("read_id", "sequence").mapInArrow(read_stretches(spec.k, buckets), BLOCK), c.select("offset", "bases").mapInArrow(contig_words(spec, buckets), BLOCK))
    found = met(words.mapInArrow(matches(spec, buckets), BLOCK), r.mapInArrow(read_blocks(buckets), BLOCK))
    placed = met(found.mapInArrow(candidates(spec.k, least, repeat_threshold, chunk, buckets), BLOCK), c.mapInArrow(contig_blocks(chunk, reach, buckets), BLOCK))
    m = placed.mapInArrow(alignments(a, least, chunk, reach), MAPPED)
    ok = F.col("score").isNotNull()
    g = m.groupBy("read_id").agg(
        F.max("reason").alias("r__"),
        F.min(F.when(ok, F.struct("score", "start", "stop", "back", "cigar", "sequence", "start_pos"))).alias("b"),
        F.collect_list(F.when(ok, F.struct("back", "start", "stop", "score"))).alias("all"),
    )
    place = lambda x: F.struct(x["back"], x["start"], x["stop"])
    every = F.array_sort("all")
    # alignments that end in one place count once; the share of all but the best, in the log domain
    g = g.withColumn("all", every).withColumn("scores", F.array_sort(F.transform(F.filter("all", lambda x, i: (i == 0) | (place(x) != place(F.get(F.col("all"), i - 1)))), lambda x: x["score"])))
    share = sum_of(F.slice("scores", 2, 1 << 30)) - sum_of(F.col("scores"))
    mapq = F.when(F.size("scores") > 1, F.least(F.lit(a.max_mapq), F.floor(share + 0.5))).cast("int")
    length = F.when(F.col("b.back"), F.col("b.start") - F.col("b.stop")).otherwise(F.col("b.stop") - F.col("b.start")).cast("int")
    reason = F.coalesce("r__", F.when(F.col("b").isNull(), "bad_alignment").otherwise("aligned"))
    return g.select("read_id", F.lit(genome).alias("genome_name"), "b.sequence", "b.start_pos", length.alias("aln_length"), F.floor(F.col("b.score") + 0.5).cast("int").alias("score"), mapq.alias("map_quality"), "b.cigar", reason.alias("reason"))
