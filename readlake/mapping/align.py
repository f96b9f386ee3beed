"""Alignment of a read to a stretch of reference by dynamic programming over probabilities, with single-stranded damaged ends."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Ambiguity letters by the bits of A=1, C=2, T=4, G=8. Fixed values.
CODES = "-ACMTWYHGRSVKDBN"


@dataclass(frozen=True)
class Aligner:
    """Rates of substitution and gaps, deamination within double and single strands, mean overhang (None: no single-stranded ends), acceptance."""

    transversions: float = 0.0024
    transitions: float | None = None
    gap_extension: float = 0.004
    gap_open: float | None = None
    ds_deamination: float = 0.0
    ss_deamination: float = 0.0
    mean_overhang: float | None = None
    max_penalty_per_nuc: float = 15.0
    max_mapq: int = 254

    @cache  # noqa: B019 - few aligners, each small
    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the read base (A, C, T, G) given an ambiguity code of the reference, in double and in single strands."""
        tv, ts = self.transversions, self.transversions if self.transitions is None else self.transitions
        out = []
        for d in (self.ds_deamination, self.ss_deamination):
            m = np.full((4, 4), tv)
            np.fill_diagonal(m, 1 - ts - 2 * tv)
            m[0, 3] = m[3, 0] = m[1, 2] = m[2, 1] = ts
            m[1, 1] -= d
            m[1, 2] += d
            m[3, 3] -= d
            m[3, 0] += d
            full = np.zeros((16, 4))
            for code in range(1, 16):
                full[code] = m[[b for b in range(4) if code >> b & 1]].mean(axis=0)
            full[0] = 1e-12  # beyond the reference
            out.append(full)
        return out[0], out[1]


def phred(p: float) -> float:
    return -10 * math.log10(max(p, 1e-300))


def codes(sequence: str) -> np.ndarray:
    table = np.zeros(256, np.int8)
    for i, c in enumerate(CODES):
        table[ord(c)] = table[ord(c.lower())] = i
    table[ord("-")] = 0
    table[ord("U")] = table[ord("u")] = 4
    return table[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]


def base_probabilities(sequence: str, quality: list[int] | None) -> np.ndarray:
    """Rows of probabilities of A, C, T, G by called letter and score (30 without)."""
    c = codes(sequence)
    e = 10.0 ** (-np.asarray(quality if quality is not None else [30] * len(c), float) / 10)
    bits = (c[:, None] >> np.arange(4)) & 1
    n = bits.sum(axis=1)
    out = np.where(bits == 1, ((1 - e) / np.maximum(n, 1))[:, None], (e / np.maximum(4 - n, 1))[:, None])
    out[(n == 0) | (n == 4)] = 0.25
    return out


def seed_quality(reference: str, read: str, mismatches: int, least: int) -> bool:
    """Whether some stretch of least matches with at most so many mismatches in between exists at equal offsets."""
    runs = [0] * (mismatches + 1)
    for a, b in zip(reference.upper(), read.upper(), strict=False):
        if a == b:
            runs = [r + 1 for r in runs]
        else:
            runs = [0] + [runs[i - 1] + 1 for i in range(1, len(runs))]
        if runs[-1] >= least:
            return True
    return False


def align_exact(read: str, quality: list[int] | None, reference: str, a: Aligner, limit: float | None = None) -> tuple[float, int, int, list[tuple[str, int]]] | None:
    """What align gives, where the read itself stands in reference and no other alignment can be as good: every base costs least at its own letter, and
    no more than a gap. None wherever that isn't certain."""
    j = reference.find(read)
    if j < 0 or a.mean_overhang is not None or not read or set(read) - set("ACGT"):
        return None
    pen = -10 * np.log10(np.maximum(a.matrices()[0] @ base_probabilities(read, quality).T, 1e-300))
    own = pen[codes(read), np.arange(len(read))]
    gap = min(phred(a.gap_extension), phred(a.gap_extension if a.gap_open is None else a.gap_open))
    if ((pen <= own + 1e-9).sum(axis=0) > 1).any() or own.max() >= gap or (limit is not None and own.sum() > limit):
        return None
    return float(own.sum()), j, j + len(read), [("M", len(read))]


def align(read: str, quality: list[int] | None, reference: str, a: Aligner, limit: float | None = None) -> tuple[float, int, int, list[tuple[str, int]]] | None:
    """Phred penalty, start and end in reference, and cigar of the best alignment of the whole read to any part of reference.

    States are match, insert and deletion in each of up to three phases: single-stranded start, double strand, single-stranded end. Scores
    of a row of reference positions are computed at once; deletions are a running minimum on a ramp. None beyond limit."""
    x, r = base_probabilities(read, quality), codes(reference)
    n, m = len(x), len(r)
    if not n or not m:
        return None
    ds, ss = a.matrices()
    ext = phred(a.gap_extension)
    opn = phred(a.gap_extension if a.gap_open is None else a.gap_open)
    over = a.mean_overhang is not None
    stay = phred(1 - 1 / (2 * a.mean_overhang + 1)) if over else 0.0
    phases = [(ss, stay), (ds, 0.0), (ss, stay)] if over else [(ds, 0.0)]
    pen = [-10 * np.log10(np.maximum(mat @ x.T, 1e-300))[r].T + extra for mat, extra in phases]  # n x m each
    k, inf = len(phases), 1e30
    ramp = ext * np.arange(m + 1)
    # score[state][phase]: arrays over reference positions 0..m; states M, I, D
    score = np.full((3, k, m + 1), inf)
    score[0, : min(2, k)] = 0.0  # free start anywhere, in the first phase or in the double strand
    back = np.zeros((n + 1, 3, k, m + 1), np.int8)  # state * 4 + phase before
    for i in range(n):
        new = np.full((3, k, m + 1), inf)
        for p in range(k):
            cand = [(score[s, p], s * 4 + p) for s in range(3)]
            if p:
                cand += [(score[s, p - 1], s * 4 + p - 1) for s in range(3)]
            stack = np.stack([c for c, _ in cand])
            best = stack.argmin(axis=0)
            value = np.take_along_axis(stack, best[None], 0)[0]
            come = np.array([c for _, c in cand], np.int8)[best]
            new[0, p, 1:] = value[:-1] + pen[p][i]
            back[i + 1, 0, p, 1:] = come[:-1]
            # insert: a read base without reference
            ins = np.stack([score[0, p] + opn, score[1, p] + ext])
            which = ins.argmin(axis=0)
            new[1, p] = np.take_along_axis(ins, which[None], 0)[0] + phases[p][1]
            back[i + 1, 1, p] = which * 4 + p
            if i < n - 1:  # deletion: reference without a read base, not at the end
                shifted = np.concatenate([[inf], new[0, p, :-1] + opn])
                flat = np.minimum.accumulate(shifted - ramp)
                new[2, p] = flat + ramp
                back[i + 1, 2, p] = np.where(shifted - ramp <= flat, p, 2 * 4 + p)
        score = new
        if limit is not None and score.min() > limit:
            return None
    flat = score[:2].reshape(-1)
    at = int(flat.argmin())
    total = float(flat[at])
    if total >= inf or (limit is not None and total > limit):
        return None
    s, p, j = at // (k * (m + 1)), at // (m + 1) % k, at % (m + 1)
    i, end, ops = n, j, []
    while i > 0:
        come = int(back[i, s, p, j])
        ops.append("MID"[s])
        if s == 0:
            i, j = i - 1, j - 1
        elif s == 1:
            i -= 1
        else:
            j -= 1
        s, p = come // 4, come % 4
    cigar: list[tuple[str, int]] = []
    for o in reversed(ops):
        if cigar and cigar[-1][0] == o:
            cigar[-1] = (o, cigar[-1][1] + 1)
        else:
            cigar.append((o, 1))
    return total, j, end, cigar
