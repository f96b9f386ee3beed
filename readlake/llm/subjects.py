"""Problem 10: the subjects that each text treats.

Terms are weighted by how unevenly they fall on the subjects, texts are embedded by truncated singular value decomposition of the
weighted term matrix (subspace iteration), and subjects are assigned by cosine similarity to centroids that start at the hand-labelled
texts and are refined from the confident assignments. Sentences are folded into the same space: a text treats a subject if two of its
sentences do, or if it is the foremost one; a single comparing sentence is no subject.

The classifier is fitted on a bounded sample of the labelled texts (SAMPLE_TEXTS texts and SAMPLE_CHARS characters at most, an equal
share of each subject, whole texts), as the share of labelled texts is a matter of hands, not of the corpus. The corpus itself is read
once: each text, whole, is cut into sentences and assigned in one pass of Arrow batches, without a shuffle and without a table between.
The model holds the words that the sample makes telling, as words, so that no other word of the corpus is taken for one of them.
"""

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.session import collect_bounded, durable, spread

#: Labelled texts that the fit takes at most, and characters of them all.
SAMPLE_TEXTS, SAMPLE_CHARS = 24_000, 64 << 20
#: Dimensions of the embedding, power iterations of the decomposition, refinements of the centroids.
DIMENSIONS, POWER, REFINE = 64, 2, 2
#: Texts of the sample that a term must occur in, least weight of an active term, and weight (squared, summed) that a sentence with a subject has.
MIN_TEXTS, MIN_WEIGHT, MIN_MASS = 3, 0.05, 0.3
#: Share of the text's own vector that helps to tell an ambiguous sentence, and sentences that make a further subject.
CONTEXT, SENTENCES = 0.3, 2
#: Rows of the subject table, which the driver holds; a centroid of 256 bytes each.
MAX_SUBJECTS = 100_000
#: Terms and similarities that are worked on at a time.
BLOCK_TERMS, BLOCK_CELLS = 250_000, 8_000_000
_CODE = re.compile(r"```.*?```|<pre>.*?</pre>|(?:^|\n)(?: {4}|\t)[^\n]*|https?://\S+", re.S)
_TAG = re.compile(r"<[^<>]{0,300}>")
_PART = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])|(?<=[.!?])\s+|\n\s*\n")


def sentences(text: str | None, take=None) -> list[list]:
    """Distinct words of each sentence outside code and links, without digits and single letters, in lower case without accents.

    With take, the values that it gives for the words, other than None. Sentences without any are left out."""
    import unicodedata

    t = text or ""
    if "```" in t or "<pre>" in t or "http" in t or "    " in t or "\t" in t:
        t = _CODE.sub(" ", t)
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", html.unescape(t))
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) not in ("Cf", "Mn"))
    out: list[list] = []
    now: set = set()
    for w in _PART.findall(t.lower()):
        if w[0].isspace():
            if now:
                out.append(sorted(now))
                now = set()
        elif take is None:
            now.add(w)
        elif (x := take(w)) is not None:
            now.add(x)
    if now:
        out.append(sorted(now))
    return out


class Rows:
    """Flat terms of some texts, with the text and the sentence of each, and the text of each sentence."""

    def __init__(self, texts: list[list[list[int]]]) -> None:
        self.n = len(texts)
        self.terms = np.fromiter((w for t in texts for s in t for w in s), np.int64)
        self.sizes = np.fromiter((len(s) for t in texts for s in t), np.int64)
        self.owner = np.repeat(np.arange(self.n), np.fromiter(map(len, texts), np.int64, self.n))
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.text = self.owner[self.sentence]

    @staticmethod
    def blocks(texts: list[list[list[int]]]) -> Iterator[tuple[int, "Rows"]]:
        """The texts in blocks of about BLOCK_TERMS terms: the first text of the block and its rows."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += sum(map(len, t))
            if size >= BLOCK_TERMS:
                yield start, Rows(texts[start : i + 1])
                start, size = i + 1, 0
        if start < len(texts):
            yield start, Rows(texts[start:])


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row; rows are ascending."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _sentence_sums(r: Rows, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each sentence's terms: sentences of one length at a time, term by term, which runs along whole rows."""
    out = np.zeros((len(r.sizes), vectors.shape[1]), np.float32)
    start = np.cumsum(r.sizes) - r.sizes
    for n in np.unique(r.sizes):
        at = np.flatnonzero(r.sizes == n)
        if n > 64:
            for i in at:
                out[i] = vectors[r.terms[start[i] : start[i] + n]].sum(axis=0)
        else:
            total = np.zeros((len(at), vectors.shape[1]), np.float32)
            for k in range(n):
                total += vectors[r.terms[start[at] + k]]
            out[at] = total
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Telling words, their weights and vectors, and the centroids with the subject of each."""

    def __init__(self, words: list[str], weight: np.ndarray, vectors: np.ndarray, centroids: np.ndarray | None = None, subject: np.ndarray | None = None) -> None:
        self.words, self.weight, self.vectors, self.centroids, self.subject = words, weight, vectors, centroids, subject
        self.weighted = vectors * weight[:, None]

    def parts(self) -> tuple:
        """Plain values, as broadcasts are pickled by reference."""
        return self.words, self.weight, self.vectors, self.centroids, self.subject

    def texts(self, r: Rows) -> np.ndarray:
        """Unit vectors of the texts."""
        return _unit(_row_sums(r.owner, _sentence_sums(r, self.weighted), r.n))

    def assign(self, r: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, subject, sentences of it and first (the foremost subject of its text), one entry for each subject with a sentence."""
        x = _sentence_sums(r, self.weighted)
        text = _unit(_row_sums(r.owner, x, r.n))
        mass = np.bincount(r.sentence, self.weight[r.terms] ** 2, len(r.owner))
        # unit vectors, as terms that the decomposition holds less of are shorter, and a long text would drown its sentences
        s = _unit(x) + CONTEXT * text[r.owner]
        ok = np.flatnonzero(mass > MIN_MASS)
        step = max(1, BLOCK_CELLS // max(1, len(self.centroids)))
        best = [(_unit(s[ok[k : k + step]]) @ self.centroids.T).argmax(axis=1) for k in range(0, len(ok), step)]
        subject = self.subject[np.concatenate(best)] if best else np.zeros(0, np.int64)
        n = int(self.subject.max()) + 1
        pair, at, count = np.unique(r.owner[ok] * n + subject, return_inverse=True, return_counts=True)
        masses = np.bincount(at, mass[ok], len(pair))
        # the foremost: most sentences, then most mass
        order = np.lexsort((pair, -masses, -count, pair // n))
        owner = (pair // n)[order]
        return owner, (pair % n)[order], count[order], np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)

    def confident(self, r: Rows) -> np.ndarray:
        """The subject of each text that clearly treats one, else -1."""
        text, subject, count, first = self.assign(r)
        all_ = np.bincount(text, count, r.n)
        out = np.full(r.n, -1, np.int64)
        ok = first & (count >= 2) & (count >= 0.8 * all_[text])
        out[text[ok]] = subject[ok]
        return out


def _weights(texts: list[list[list[int]]], subject: np.ndarray, n_terms: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each term: one less the relative entropy of the subjects of its texts, smoothed by the subjects' shares; 0 below
    MIN_TEXTS. Whether it has as many."""
    pairs = [np.unique(r.text * n_terms + r.terms) + start * n_terms for start, r in Rows.blocks(texts)]
    pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    text, term = pair // max(1, n_terms), pair % max(1, n_terms)
    seen = np.bincount(term, minlength=n_terms)
    cell, c = np.unique(term * n + subject[text], return_counts=True)
    t, s = cell // n, cell % n
    base = np.bincount(s, c, n) / max(1, c.sum())
    k = max(2, int((base > 0).sum()))
    total = np.bincount(t, c, n_terms)
    # a subject that a term never falls on has the share 1 / (total + 1), any other 1 / (total + 1) + c / base / (total + 1)
    some = (c / base[s] + 1) / (total[t] + 1)
    none = np.maximum(0, (base > 0).sum() - np.bincount(t, minlength=n_terms)) / (total + 1)
    z = np.bincount(t, some, n_terms) + none
    p, q = some / z[t], 1 / (total + 1) / np.maximum(z, 1e-12)
    h = -(np.bincount(t, p * np.log(p), n_terms) + none / np.maximum(z, 1e-12) * np.log(np.maximum(q, 1e-12))) / np.log(k)
    return np.where((seen >= MIN_TEXTS) & (1 - h >= MIN_WEIGHT), np.clip(1 - h, 0, 1), 0).astype(np.float32), seen >= MIN_TEXTS


def _decompose(texts: list[list[list[int]]], weight: np.ndarray, dims: int) -> np.ndarray:
    """Right singular vectors (terms x dims) of the matrix of unit texts, by subspace iteration."""
    n = len(weight)
    dims = min(dims, n)
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(n, dims)))[0].astype(np.float32)
    for _ in range(POWER + 1):
        z = np.zeros((n, dims))
        for _, r in Rows.blocks(texts):
            x = weight[r.terms]
            x = x / np.sqrt(np.maximum(_row_sums(r.text, x**2, r.n), 1e-12))[r.text]
            y = _row_sums(r.text, q[r.terms] * x[:, None], r.n)
            order = np.argsort(r.terms, kind="stable")
            z += _row_sums(r.terms[order], y[r.text[order]] * x[order, None], n)
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q


def _centroids(texts: list, model: Model, cell: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids per subject and language that has any, and their numbers. cell holds the language of each text; judge gives the subjects of a block."""
    langs = int(cell.max()) + 1
    keys, sums = [], []
    for start, r in Rows.blocks(texts):
        subject = judge(start, r)
        ok = np.flatnonzero(subject >= 0)
        k = subject[ok] * langs + cell[start + ok]
        order = np.argsort(k, kind="stable")
        there, at = np.unique(k[order], return_inverse=True)
        keys.append(there)
        sums.append(_row_sums(at, model.texts(r)[ok[order]], len(there)))
    there, at = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(at, kind="stable")
    total = _row_sums(at[order], np.concatenate(sums)[order], len(there))
    real = np.linalg.norm(total, axis=1) > 1e-6
    return _unit(total[real]), there[real] // langs


def fit(sample: list[tuple[str, str, int]], described: list[tuple[str, str, int]] = (), dims: int = DIMENSIONS) -> Model | None:
    """The model of (text, language, number of the subject) rows; None where nothing tells subjects apart. The described rows are no
    running text: that they lack the common words tells nothing, so what the sample has weighs no more than in the sample alone."""
    real = len(sample)
    sample = [*sample, *described]
    number: dict[str, int] = {}
    raw = [[[number.setdefault(w, len(number)) for w in s] for s in sentences(t)] for t, _, _ in sample]
    subject = np.array([s for _, _, s in sample], np.int64)
    if not number:
        return None
    n = int(subject.max()) + 1
    weight, _ = _weights(raw, subject, len(number), n)
    if described and real:
        alone, seen = _weights(raw[:real], subject[:real], len(number), n)
        weight = np.where(seen, np.minimum(weight, alone), weight)
    active = np.flatnonzero(weight)
    if not len(active):
        return None
    at = np.full(len(number), -1)
    at[active] = np.arange(len(active))
    texts = [[y for s in t if (y := [int(at[w]) for w in s if at[w] >= 0])] for t in raw]
    lang: dict[str, int] = {}
    cell = np.array([lang.setdefault(x, len(lang)) for _, x, _ in sample], np.int64)
    words = list(number)
    model = Model([words[i] for i in active], weight[active], _decompose(texts, weight[active], dims))
    model.centroids, model.subject = _centroids(texts, model, cell, lambda start, r: subject[start : start + r.n])
    if not len(model.subject):
        return None
    for _ in range(REFINE):
        c, s = _centroids(texts, model, cell, lambda start, r: model.confident(r))
        # a subject without a confident text keeps its centroids
        old = ~np.isin(model.subject, s)
        model.centroids, model.subject = np.concatenate([c, model.centroids[old]]), np.concatenate([s, model.subject[old]])
    return model


def _sample(documents: DataFrame, labels: DataFrame, names: list[str]) -> list[tuple[str, str, int]]:
    """text, lang, number of the subject: the labelled texts of the fit, an equal share of each subject, in a fixed order."""
    spark = documents.sparkSession
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set("subject").alias("s"))
    one = one.where(F.size("s") == 1).select("doc_id", F.col("s")[0].alias("subject"))
    number = {s: i for i, s in enumerate(names)}
    sizes = {r["subject"]: r["count"] for r in one.groupBy("subject").count().collect() if r["subject"] in number}  # a row for each subject
    if not sizes:
        return []
    each = max(1, SAMPLE_TEXTS // len(sizes))
    share = spark.createDataFrame([(s, number[s], min(1.0, each / n)) for s, n in sizes.items()], "subject string, number int, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # SAMPLE_TEXTS ids, or a few more by chance
    drawn = one.join(F.broadcast(share), "subject").where(draw < F.col("share")).select("doc_id", "number")
    lang = F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit(""))
    lang = F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(F.col("text").cast("string").alias("text"), lang.alias("lang")).alias("t")).where("t.text is not null")
    got = durable(texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "number").agg(F.max("t").alias("t")).select("doc_id", "number", "t.text", "t.lang"))
    order = F.xxhash64("doc_id")
    size, most = 0, None
    for r in got.select(order.alias("o"), F.length("text").alias("n")).orderBy("o").collect():
        size += r["n"]
        if size > SAMPLE_CHARS:
            most = r["o"]
            break
    rows = got.where(order < most) if most is not None else got
    return [(r["text"], r["lang"], r["number"]) for r in rows.orderBy(order, "doc_id").collect()]


def _described(subjects: list, known: list[int]) -> list[tuple[str, str, int]]:
    """Rows that stand for the subjects without a labelled text (known has the subject of each): the words of name and description that
    no other subject's hold, as often as a known subject has texts, lest the decomposition pass over them."""
    there = set(known)
    copies = max(MIN_TEXTS, min(len(known) // max(1, len(there)), SAMPLE_TEXTS // max(1, len(subjects))))
    words = [{w for s in sentences(f"{r['subject']}. {r['description'] or ''}") for w in s} for r in subjects]
    shared = Counter(w for ws in words for w in ws)
    return [(" ".join(sorted(w for w in ws if shared[w] == 1)), "", i) for i, ws in enumerate(words) if i not in there for _ in range(copies)]


def treated_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    """doc_id, subject: one row for each subject that a text treats.

    labels (doc_id, subject) of texts with exactly one distinct subject are the seeds; labels of unknown subjects or texts, nulls and
    repeated labels don't matter, and a few wrong ones neither. A subject without any labelled text is seeded by the words of its name and
    description (where subjects has one) that no other subject has. Null, empty and blank texts, and texts without subject matter, have no
    row; without subjects, or with one only, of which nothing tells it apart, the result is empty. Each row of documents gives its rows;
    other columns are ignored; texts may be of any length. lang only separates centroids; null or wrong codes do no harm.
    """
    spark = documents.sparkSession
    described = F.max(F.col("description").cast("string")) if "description" in subjects.columns else F.lit(None).cast("string")
    table = sorted(collect_bounded(subjects.where("subject is not null").groupBy("subject").agg(described.alias("description")), MAX_SUBJECTS, "subject table"))
    names = [r["subject"] for r in table]
    sample = _sample(documents, labels, names) if names else []
    described = _described(table, [s for _, _, s in sample])
    model = fit(sample, described, dims) if sample or described else None
    if model is None:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    final = spark.sparkContext.broadcast(model.parts())

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        m = Model(*final.value)
        number = {w: i for i, w in enumerate(m.words)}.get
        for b in batches:
            texts = [sentences(t, number) if t else [] for t in b.column("text").to_pylist()]
            for start, r in Rows.blocks(texts):
                text, subject, count, first = m.assign(r)
                take = first | (count >= SENTENCES)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(start + text[take])), pa.array([names[i] for i in subject[take]], pa.string())], names=["doc_id", "subject"])

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(src).mapInArrow(run, "doc_id bigint, subject string")
