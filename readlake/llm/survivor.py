"""Problem 6: the best representative of each group of duplicate reads.

Reads are copies of one molecule where hits of theirs lie at equal coordinates. Their records are fused in the manner of Bayesian truth
discovery with copy detection, the runs being the sources and the bases the values: a first vote weighs each base by its quality; it
gives each run an accuracy, and from the false bases that two runs share the probability that one copies the other; a second vote weighs
by accuracy and discounts copied votes. Fields of the survivor are those of maximum posterior, and the best read is the member whose
record has the greatest posterior over all its fields.

Groups are never collected: coordinates and choices are map-side combined aggregates, and evidence is added up within each task before it
is shuffled, so that a hot group costs a task at most one profile per run. A group is a row per run; the first vote holds the profiles of
one group, 16 bytes a base and run, the second only its sum. A false base is charged to the pair of a run and the run that gives it with
the most evidence, so pairs within a group are as many as its runs, not their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators.quality_units import normalize_quality
from readlake.session import clean_genome, clean_sequence, durable

#: Prior probability that a run copies another, and share of its values that a copier copies.
COPY_PRIOR, COPY_SHARE = 0.1, 0.8
#: Phred score of a base without quality, and the cap of a posterior.
DEFAULT_PHRED, MAX_PHRED = 30, 93
#: What an unknown base takes from the posterior of a record, in Phred: its two bits.
UNKNOWN = 6
#: A group by its smallest read_id and the combined hash of all.
GROUP = ["group_read_id", "fingerprint"]


def duplicate_members(hits: DataFrame) -> DataFrame:
    """group_read_id, n_members, fingerprint, read_id, map_quality: members of every group of two or more reads.

    A group is the set of reads with a hit at one coordinate (genome in clean form, sequence, start_pos, aln_length, none null); equal
    sets at several coordinates are one group. map_quality is the highest at the shared coordinates, null if all are. A read listed
    twice at a coordinate counts once; hits without read_id are left out.
    """
    at = ["g", "s", "start_pos", "aln_length"]
    h = hits.select(clean_genome("genome_name").alias("g"), clean_sequence("sequence").alias("s"), "start_pos", "aln_length", "read_id", "map_quality").where(
        " and ".join(f"{c} is not null" for c in [*at, "read_id"])
    )
    per = h.groupBy(*at, "read_id").agg(F.max("map_quality").alias("map_quality"))
    sets = (
        per.groupBy(*at)
        .agg(F.min("read_id").alias("group_read_id"), F.count(F.lit(1)).alias("n_members"), F.bit_xor(F.xxhash64("read_id")).alias("fingerprint"))
        .where("n_members > 1")
    )
    return per.join(sets, at).groupBy(*GROUP, "n_members", "read_id").agg(F.max("map_quality").alias("map_quality"))


def evidence(members: DataFrame) -> DataFrame:
    """The evidence of each source for each base at each position of a group, and what the first vote makes of it; kind tells rows apart.

    Rows of kind 'profile': GROUP, source, profile, a float32 matrix of positions by A, C, G, T, in Phred; Ns give none. Rows of kind
    'count': source, n_right and n_wrong values by the first vote (leader null), or n_shared false values that the source shares with the
    leader, the source that gives them with the most evidence. Each task first adds up its own rows per (group, source), so that a hot
    group leaves it as one profile per source; those stream, sorted, through the task of the group.
    """
    default, bases, stack = DEFAULT_PHRED, "ACGT", _stack
    held_most = 20_000
    schema = "group_read_id bigint, fingerprint bigint, source bigint, profile binary"

    def matrix(sequence, phred, map_quality):
        import numpy as np

        codes = np.full(256, 4, np.int8)
        for i, c in enumerate(bases):
            codes[ord(c)] = codes[ord(c.lower())] = i
        base = codes[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]
        q = np.full(len(base), default, np.float32) if phred is None else phred.astype(np.float32)
        if map_quality is not None:
            q = np.minimum(q, map_quality)
        # evidence of a call against one of the three other bases
        q = np.maximum(q, 0.1) + 4.77
        out = np.zeros((len(base), 5), np.float32)
        out[np.arange(len(base)), base] = q
        return out[:, :4]

    def add(x, y):
        if len(x) < len(y):
            x, y = y, x
        x = x.copy()
        x[: len(y)] += y
        return x

    def first(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def flush():
            keys = list(held)
            for i in range(0, len(keys), 5000):
                part = keys[i : i + 5000]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k[j] for k in part], pa.int64()) for j in range(3)), pa.array([held[k].tobytes() for k in part], pa.binary())],
                    names=["group_read_id", "fingerprint", "source", "profile"],
                )
            held.clear()

        for b in batches:
            g, f, source, sequence, mq = (b.column(c).to_pylist() for c in ("group_read_id", "fingerprint", "source", "sequence", "map_quality"))
            phred = b.column("phred")
            offs, flat, there = np.asarray(phred.offsets), np.asarray(phred.values), phred.is_valid().to_pylist()
            for i in range(b.num_rows):
                if sequence[i]:
                    m = matrix(sequence[i], flat[offs[i] : offs[i + 1]] if there[i] else None, mq[i])
                    k = (g[i], f[i], source[i])
                    held[k] = add(held[k], m) if k in held else m
            if len(held) >= held_most:
                yield from flush()
        yield from flush()

    def second(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        columns = [("kind", pa.string()), ("group_read_id", pa.int64()), ("fingerprint", pa.int64()), ("source", pa.int64()), ("profile", pa.binary())]
        columns += [(c, pa.int64()) for c in ("leader", "n_right", "n_wrong", "n_shared")]
        group, sources, profiles, rows = None, [], [], []
        counts: dict = {}

        def close():
            if group is None:
                return
            rows.extend(("profile", *group, s, m.tobytes(), None, None, None, None) for s, m in zip(sources, profiles, strict=True))
            x = stack(profiles)
            said = x > 0
            at = np.arange(x.shape[1])
            truth = x.sum(axis=0).argmax(axis=1)
            right = said[:, at, truth].sum(axis=1)
            false = said
            false[:, at, truth] = False
            wrong = false.sum(axis=(1, 2))
            leader = np.where(false, x, -1).argmax(axis=0)
            who, p, v = np.nonzero(false)
            lead = leader[p, v]
            pair, n = np.unique((who * len(sources) + lead)[who != lead], return_counts=True)
            for s, r, w in zip(sources, right, wrong, strict=True):
                c = counts.setdefault((s, None), [0, 0, 0])
                c[0] += int(r)
                c[1] += int(w)
            for k, m in zip(pair, n, strict=True):
                counts.setdefault((sources[k // len(sources)], sources[k % len(sources)]), [0, 0, 0])[2] += int(m)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)], names=[c for c, _ in columns])
            rows.clear()
            return out

        def tell():
            rows.extend(("count", None, None, s, None, t, *c) for (s, t), c in counts.items())
            counts.clear()

        for b in batches:
            for g, f, source, p in zip(*(b.column(c).to_pylist() for c in ("group_read_id", "fingerprint", "source", "profile")), strict=True):
                m = np.frombuffer(p, np.float32).reshape(-1, 4)
                if (g, f) != group:
                    close()
                    group, sources, profiles = (g, f), [], []
                    if len(counts) > held_most:
                        tell()
                    if len(rows) >= 5000:
                        yield flush()
                if sources and sources[-1] == source:
                    profiles[-1] = add(profiles[-1], m)
                else:
                    sources.append(source)
                    profiles.append(m)
        close()
        tell()
        yield flush()

    e = members.select("group_read_id", "fingerprint", F.coalesce("run_id", F.lit(-1)).cast("bigint").alias("source"), "sequence", "phred", F.col("map_quality").cast("int").alias("map_quality"))
    spread = e.mapInArrow(first, schema).repartition(*GROUP).sortWithinPartitions(*GROUP, "source")
    return spread.mapInArrow(second, "kind string, " + schema + ", leader bigint, n_right bigint, n_wrong bigint, n_shared bigint")


def _stack(profiles):
    """Sources x positions x bases; positions that a source doesn't reach hold no evidence."""
    import numpy as np

    out = np.zeros((len(profiles), max(map(len, profiles)), 4), np.float32)
    for i, p in enumerate(profiles):
        out[i, : len(p)] = p
    return out


def source_pairs(counted: DataFrame) -> DataFrame:
    """source, leader, n_shared, copying: the probability that source copies leader, for each pair that shares a false value.

    Each false base that both give speaks for copying by the odds of sharing it as a copier and by chance, each false base of the source
    that no other gives speaks against it. counted: the rows of kind 'count' of evidence."""
    own = source_accuracies(counted).select(F.col("source").alias("s"), "accuracy", F.col("n_wrong").alias("wrong"))
    pairs = counted.where("leader is not null").groupBy("source", "leader").agg(F.sum("n_shared").alias("n_shared"))
    shared = pairs.groupBy(F.col("source").alias("s")).agg(F.sum("n_shared").alias("all_shared"))
    j = pairs.join(own.join(shared, "s"), F.col("source") == F.col("s"))
    p = (1 - F.col("accuracy")) / 3
    for_ = F.col("n_shared") * F.log((COPY_SHARE + (1 - COPY_SHARE) * p) / p)
    against = (F.col("wrong") - F.col("all_shared")) * F.log(F.lit(1 - COPY_SHARE))
    odds = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(math.log(COPY_PRIOR / (1 - COPY_PRIOR))) + for_ + against))
    return j.select("source", "leader", "n_shared", (1 / (1 + F.exp(-odds))).alias("copying"))


def source_accuracies(counted: DataFrame) -> DataFrame:
    """source, accuracy, n_wrong: how often a source agrees with the first vote, smoothed by nine right values in ten."""
    t = counted.where("leader is null").groupBy("source").agg(F.sum("n_right").alias("n_right"), F.sum("n_wrong").alias("n_wrong"))
    return t.select("source", ((F.col("n_right") + 9) / (F.col("n_right") + F.col("n_wrong") + 10)).alias("accuracy"), "n_wrong")


def source_statistics(counted: DataFrame) -> DataFrame:
    """source, accuracy, copying: the accuracy of each source and the probability that it copies any other."""
    any_ = source_pairs(counted).groupBy(F.col("source").alias("s")).agg((1 - F.exp(F.sum(F.log(1 - F.col("copying") * 0.999999)))).alias("copying"))
    a = source_accuracies(counted)
    return a.join(any_, F.col("source") == F.col("s"), "left").select("source", "accuracy", F.coalesce("copying", F.lit(0.0)).alias("copying"))


def fuse(members: DataFrame) -> DataFrame:
    """GROUP, fused (the bases of maximum posterior), fused_phred array<int>: the consensus of each group after copy detection.

    members has GROUP, run_id, sequence, phred, map_quality. Positions where no member has a base are N with score 0; ties go to the
    first of A, C, G, T."""
    share, most = COPY_SHARE, MAX_PHRED
    e = durable(evidence(members))
    stats = source_statistics(e.where("kind = 'count'").select("source", "leader", "n_right", "n_wrong", "n_shared"))
    # the most accurate source of a group leads, the others may have copied what it gives
    j = e.where("kind = 'profile'").select(*GROUP, "source", "profile").join(stats, "source")
    j = j.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("accuracy"), "source")

    def vote(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, w, given, rows = None, None, None, []

        def close():
            if group is not None:
                best = w.argmax(axis=1)
                top = w[np.arange(len(w)), best]
                odds = np.maximum(1e-10, (10 ** ((w - top[:, None]) / 10)).sum(axis=1) - 1)
                q = np.minimum(most, np.floor(-10 * np.log10(odds / (1 + odds)) + 0.5)).astype(int)
                rows.append((*group, "".join("ACGT"[i] if t > 0 else "N" for i, t in zip(best, top, strict=True)), np.where(top > 0, q, 0).tolist()))

        def flush():
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["group_read_id", "fingerprint", "fused", "fused_phred"])
            rows.clear()
            return out

        for b in batches:
            for g, f, p, a, c in zip(*(b.column(x).to_pylist() for x in ("group_read_id", "fingerprint", "profile", "accuracy", "copying")), strict=True):
                x = np.frombuffer(p, np.float32).reshape(-1, 4)
                if (g, f) != group:
                    close()
                    group, w, given = (g, f), np.zeros((0, 4)), np.zeros((0, 4), bool)
                    if len(rows) >= 1000:
                        yield flush()
                if len(x) > len(w):
                    w, given = np.vstack([w, np.zeros((len(x) - len(w), 4))]), np.vstack([given, np.zeros((len(x) - len(given), 4), bool)])
                trust = math.log10(3 * a / (1 - a)) / math.log10(3 * 0.99 / 0.01)
                # a value that a source before gave may be a copy
                w[: len(x)] += x * trust * np.where(given[: len(x)], 1 - share * c, 1.0)
                given[: len(x)] |= x > 0
        close()
        yield flush()

    return j.select(*GROUP, "profile", "accuracy", "copying").mapInArrow(vote, "group_read_id bigint, fingerprint bigint, fused string, fused_phred array<int>")


def best_representatives(reads: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per group: group_read_id, best_read_id, n_members, sequence, phred, map_quality (the fused record),
    is_exact (the exact check decided), posterior_agrees (the member of maximum posterior is the same).

    The fused sequence and phred are the bases of maximum posterior (N, 0 where no member has a base), map_quality the members' highest.
    The best read is the member of maximum posterior, in Phred over the fields of its record: its Phred total, its map_quality, less
    UNKNOWN for each N, and the probability that a base of it is true by the fused record. An exact check follows: where one
    member is at least equal to all others in Ns, valid Phred total and map_quality, it is the best read; posterior_agrees tells whether
    the posterior had picked it, or the check repaired the choice. Ties go to the smallest read_id. A missing quality or
    map_quality is lowest, a missing sequence has more Ns than any. Reads that are delivered twice under one read_id count once (the
    one with the greatest sequence, then quality). Empty tables give an empty result; other columns are ignored.
    """
    members = duplicate_members(hits)
    mine = reads.select("read_id", "run_id", "description", "sequence", "quality").join(members, "read_id")
    once = mine.groupBy("read_id", *GROUP, "n_members", "map_quality").agg(F.max(F.struct("sequence", "quality", "run_id", "description")).alias("r"))
    once = once.select("read_id", *GROUP, "n_members", "map_quality", "r.run_id", "r.description", "r.sequence", "r.quality")
    q = normalize_quality(once, runs, evidence=reads, keep=[*GROUP, "n_members", "map_quality"])
    m = durable(q.select(*GROUP, "n_members", "read_id", "run_id", "sequence", F.col("phred").cast("array<tinyint>").alias("phred"), "phred_total", "map_quality"))
    j = m.join(fuse(m), GROUP, "left")
    n_unknown = F.coalesce(F.length("sequence") - F.length(F.translate("sequence", "Nn", "")), F.lit(2**31 - 1))
    true = F.aggregate(
        F.arrays_zip(F.split(F.upper("sequence"), "").alias("b"), F.split("fused", "").alias("t"), F.col("fused_phred").alias("q")),
        F.lit(0.0),
        lambda a, x: a + F.when((x["b"] == x["t"]) & (x["t"] != "N"), 1 - F.pow(F.lit(10.0), -x["q"] / 10)).otherwise(F.coalesce(F.pow(F.lit(10.0), -x["q"] / 10) / 3, F.lit(0.0))),
    ) / F.greatest(F.length("sequence"), F.lit(1))
    quality, mapq = F.coalesce("phred_total", F.lit(-1)), F.coalesce("map_quality", F.lit(-1))
    posterior = quality + mapq - n_unknown * F.lit(float(UNKNOWN)) + 10 * F.log10(F.greatest(F.coalesce(true, F.lit(0.0)), F.lit(1e-9)))
    j = j.select(*GROUP, "n_members", "read_id", "fused", "fused_phred", (-n_unknown).alias("known"), quality.alias("total"), mapq.alias("mq"), posterior.alias("posterior"))
    least = -F.col("read_id")
    got = j.groupBy(*GROUP).agg(
        F.max("n_members").alias("n_members"),
        F.max(F.struct("posterior", least.alias("k"))).alias("likely"),
        F.max(F.struct("known", "total", "mq", least.alias("k"))).alias("first"),
        F.max("known").alias("known"),
        F.max("total").alias("total"),
        F.max("mq").alias("mq"),
        F.first("fused").alias("fused"),
        F.first("fused_phred").alias("fused_phred"),
    )
    exact = (F.col("first.known") == F.col("known")) & (F.col("first.total") == F.col("total")) & (F.col("first.mq") == F.col("mq"))
    return got.select(
        "group_read_id",
        F.when(exact, -F.col("first.k")).otherwise(-F.col("likely.k")).alias("best_read_id"),
        "n_members",
        F.coalesce("fused", F.lit("")).alias("sequence"),
        F.coalesce("fused_phred", F.array().cast("array<int>")).alias("phred"),
        F.when(F.col("mq") >= 0, F.col("mq")).alias("map_quality"),
        exact.alias("is_exact"),
        (F.col("likely.k") == F.col("first.k")).alias("posterior_agrees"),
    )
