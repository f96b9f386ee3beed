"""Parsers of single files and byte ranges; they run in Python workers and yield plain dicts."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

NUMBERS = re.compile(rb"^\s*[+-]?\d+(\s+[+-]?\d+)*\s*$")
OPS = "MIDNSHP=X"
COMPLEMENT = str.maketrans("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")


def _numeric(lines: list[bytes]) -> bool:
    """Whether quality lines hold numbers apart by blanks; digits without a blank are characters."""
    return all(NUMBERS.match(x) for x in lines) and any(b" " in x.strip() for x in lines)


def _scores(lines: list[bytes], n: int, origin: int, solexa: bool) -> list[int]:
    """Scores of n bases from the lines of a quality."""
    chars = b"".join(x.strip() for x in lines)
    alone = n == 1 != len(chars) and bool(NUMBERS.match(chars))
    raw = [int(x) for x in b" ".join(lines).split()] if alone or _numeric(lines) else [b - origin for b in chars]
    return [math.floor(10 * math.log10(1 + 10 ** (q / 10)) + 0.5) for q in raw] if solexa else raw


def _record(lines: list[bytes], at: int, origin: int, solexa: bool) -> tuple[dict | None, int]:
    """The record that starts at a header line, and the line after it; None where no whole record starts there."""
    head = lines[at]
    fastq = head[:1] == b"@"
    name, _, description = head[1:].decode("latin-1").strip().partition(" ")
    i = at + 1
    while i < len(lines) and lines[i][:1] == b";":
        description = f"{description} {lines[i][1:].decode('latin-1').strip()}".strip()
        i += 1
    seq: list[str] = []
    while i < len(lines) and lines[i][:1] not in (b"@", b">", b"+"):
        seq.append(lines[i].decode("latin-1").removeprefix("SQ ").strip())
        i += 1
    sequence = "".join(seq)
    out = {"seqid": name, "description": description or None, "sequence": sequence, "quality": None, "trim_left": None, "trim_right": None, "hit": []}
    if i < len(lines) and lines[i][:1] == b"+":
        i += 1
        q: list[bytes] = []
        while i < len(lines) and (not q or (len(b" ".join(q).split()) if _numeric(q) else sum(map(len, q))) < len(sequence)):
            q.append(lines[i].strip(b"\r\n"))
            i += 1
        out["quality"] = _scores(q, len(sequence), origin, solexa) if q else []
    elif fastq and not sequence:
        return None, at + 1
    return out, i


def fastq_lines(lines: Iterable[bytes], origin: int = 33, solexa: bool = False) -> Iterator[dict]:
    """Records of FastA, FastQ and 4Q from a stream of lines without their ends; holds a few thousand lines, or one record."""
    source = iter(lines)
    held: list[bytes] = []
    size, more = 4096, True
    while more:
        got = list(islice(source, size))
        more = len(got) == size
        held += got
        i = 0
        while i < len(held):
            if held[i][:1] not in (b"@", b">"):
                i += 1
                continue
            r, end = _record(held, i, origin, solexa)
            if end >= len(held) and more:  # the record may go on
                break
            if r:
                yield r
            i = end
        held = held[i:]
        size = max(4096, len(held))


def _starts(lines: list[bytes], i: int, mark: bytes) -> bool:
    """Whether a record starts at line i for certain. In FastA (mark >) that is any header; in FastQ (mark @), where qualities may begin with either
    mark, a header whose qualities are as long as its sequence and are followed by a header or the end."""
    if lines[i][:1] != mark:
        return False
    if mark == b">":
        return True
    r, j = _record(lines, i, 33, False)
    return r is not None and r["quality"] is not None and len(r["quality"]) == len(r["sequence"]) > 0 and (j >= len(lines) or lines[j][:1] in (b"@", b">") or not lines[j])


def fastq_range(f: BinaryIO, start: int, end: int, origin: int, solexa: bool) -> Iterator[dict]:
    """Records of one byte range of an uncompressed file: from the first certain start at or after start to the first at or after end. Ranges that
    meet agree on that start, so each record comes once."""
    f.seek(0)
    mark = b"@" if f.read(1) == b"@" else b">"
    at = start
    if start:  # a line that starts exactly at start is whole
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    else:
        f.seek(0)
    lines: list[bytes] = []
    offsets: list[int] = []

    def more(n: int) -> bool:
        nonlocal at
        for _ in range(n):
            x = f.readline()
            if not x:
                return False
            lines.append(x.rstrip(b"\r\n"))
            offsets.append(at)
            at += len(x)
        return True

    checked, open_ = 0, True
    while open_:
        open_ = more(64)
        ahead = 64
        while checked < len(lines):
            if offsets[checked] >= end and lines[checked][:1] == mark:
                # look as far ahead as a certain answer may take
                while open_ and not _starts(lines[: checked + ahead], checked, mark) and ahead < 1 << 14:
                    open_ = more(ahead)
                    ahead *= 2
                if _starts(lines[: checked + ahead], checked, mark):
                    open_ = False
                    break
            checked += 1
    i = 0
    if start:
        while i < len(lines) and not _starts(lines, i, mark):
            i += 1
    while i < len(lines):
        if offsets[i] >= end and _starts(lines, i, mark):
            return
        if lines[i][:1] in (b"@", b">"):
            r, i = _record(lines, i, origin, solexa)
            if r:
                yield r
        else:
            i += 1


def _read(f: BinaryIO, n: int) -> bytes:
    b = f.read(n)
    if len(b) != n:
        raise ValueError("file ends within a record")
    return b


def bam(f: BinaryIO) -> Iterator[dict]:
    """Records of a BAM stream, already decompressed. Reverse alignments are turned to the read's own direction."""
    if _read(f, 4) != b"BAM\1":
        raise ValueError("no BAM file")
    _read(f, *struct.unpack("<i", _read(f, 4)))
    names = []
    for _ in range(*struct.unpack("<i", _read(f, 4))):
        names.append(_read(f, *struct.unpack("<i", _read(f, 4)))[:-1].decode())
        _read(f, 4)
    while size := f.read(4):
        b = _read(f, *struct.unpack("<i", size))
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", b)
        at = 32
        name = b[at : at + l_name - 1].decode("latin-1")
        at += l_name
        cigar = [{"op": OPS[c & 15] if c & 15 < 9 else "M", "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", b, at)]
        at += 4 * n_cigar
        packed = b[at : at + (l_seq + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[x >> 4] + "=ACMGRSVTWYHKDBN"[x & 15] for x in packed)[:l_seq]
        at += len(packed)
        qual: list[int] | None = list(b[at : at + l_seq])
        at += l_seq
        if all(q == 255 for q in qual):
            qual = None
        tags = dict(_tags(b, at))
        back = bool(flag & 16)
        span = sum(c["len"] for c in cigar if c["op"] in "MDN=X")
        if back:
            seq, cigar = seq.translate(COMPLEMENT)[::-1], cigar[::-1]
            qual = qual[::-1] if qual else qual
        hit = {"sequence": names[ref] if 0 <= ref < len(names) else None, "start_pos": pos, "aln_length": -span if back else span, "score": tags.get("UQ", tags.get("AS")), "map_quality": mapq if mapq < 255 else None, "cigar": cigar}
        yield {"seqid": name, "description": None, "sequence": seq, "quality": qual, "trim_left": None, "trim_right": None, "hit": [] if flag & 4 else [hit]}


def _tags(b: bytes, at: int) -> Iterator[tuple[str, object]]:
    one = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at < len(b):
        tag, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            yield tag, b[at:end].decode("latin-1")
            at = end + 1
        elif kind == "B":
            sub, n = one[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            at += 5 + n * struct.calcsize(sub)
        else:
            (v,) = struct.unpack_from("<" + one[kind], b, at)
            at += struct.calcsize("<" + one[kind])
            yield tag, v


def sff(f: BinaryIO) -> Iterator[dict]:
    """Records of a flowgram file. Clip points are 1-based; trim_left is the bases before the left one, trim_right the right one."""
    magic, version, _, _, n, head, _, flows, code = struct.unpack(">4sIQIIHHHB", _read(f, 31))
    if magic != b".sff" or version != 1 or code != 1:
        raise ValueError("no flowgram file of version 1")
    _read(f, head - 31)
    for _ in range(n):
        hl, nl, bases, ql, qr, al, ar = struct.unpack(">HHIHHHH", _read(f, 16))
        name = _read(f, hl - 16)[:nl].decode("latin-1")
        _read(f, flows * 2 + bases)
        seq, qual = _read(f, bases).decode("latin-1"), list(_read(f, bases))
        _read(f, -(flows * 2 + bases * 3) % 8)
        left, right = max(ql, al), min([x for x in (qr, ar) if x], default=0)
        yield {"seqid": name, "description": None, "sequence": seq, "quality": qual, "trim_left": left - 1 if left else None, "trim_right": right or None, "hit": []}


def genome_fasta(f: BinaryIO, genome: str, maxn: int = 2, piece: int = 1 << 20) -> Iterator[dict]:
    """Pieces of contigs: a sequence is split at runs of more than maxn Ns, which belong to no contig; contigs follow each other in the genome with one
    position between them. Streams; holds one piece."""
    offset, contig = 0, 0
    name = description = None
    pos = 0  # within the sequence
    buf: list[str] = []
    size, start, ns = 0, 0, 0

    def emit(last: bool):
        nonlocal size, start, offset, contig, buf
        if size:
            text = "".join(buf)
            yield {"genome_name": genome, "sequence": name, "description": description, "contig": contig, "offset": offset, "range_start": start, "range_end": start + size, "bases": text}
            offset += size
            start += size
            buf, size = [], 0
        if last and contig_open[0]:
            offset += 1
            contig += 1
            contig_open[0] = False

    contig_open = [False]
    for line in f:
        s = line.decode("latin-1").strip()
        if s[:1] in (">", ";"):
            if s[0] == ">":
                yield from emit(True)
                head, _, description = s[1:].strip().partition(" ")
                name, description, pos, ns = head, description or None, 0, 0
            continue
        for run in re.findall(r"[Nn-]+|[^Nn-]+", s):
            if run[0] in "Nn-":
                ns += len(run)
            else:
                if ns and contig_open[0] and ns <= maxn:
                    buf.append("N" * ns)
                    size += ns
                elif ns and contig_open[0]:
                    yield from emit(True)
                if not contig_open[0]:
                    contig_open[0], start = True, pos
                ns = 0
                buf.append(run.upper())
                size += len(run)
                if size >= piece:
                    yield from emit(False)
            pos += len(run)
    yield from emit(True)
