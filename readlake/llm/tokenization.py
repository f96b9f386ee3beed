"""Problem 8: token ids of every text by a public tokenizer, and back.

One pass over Arrow batches with the tokenizers library, no shuffle. The vocabulary file is read on the driver and broadcast (its size
is checked), so executors need no copy of it. Decoding reverses the byte table of byte-level vocabularies and joins bytes before
it reads characters, so that characters split over tokens come back whole.
"""

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.session import spread

VOCABULARY = "byte_bpe_50k.json"
#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Texts that the library encodes at once.
AT_ONCE = 256


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies: $READLAKE_TOKENIZERS, the installed package, or /opt/tokenizers."""
    if folder := os.environ.get("READLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _vocabulary(df: DataFrame, path: str | None):
    path = path or vocabulary_path()
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {size} bytes; {MAX_VOCABULARY_BYTES} at most are broadcast")
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encode_texts(documents: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with offsets also starts, ends array<int>: the characters (code points) that each token covers.

    No special tokens are added, and their strings within a text are ordinary text. Null and empty texts have empty lists. A token that
    is part of a character covers that whole character. Repeated rows give repeated rows; an empty table gives an empty table; other
    columns are ignored; texts may be of any length.
    """
    vocabulary = _vocabulary(documents, path)
    fields = f"{key} bigint, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    step = AT_ONCE

    def run(batches: Iterable) -> Iterator:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.value)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()

        def lists(of):
            ends = np.cumsum([0, *map(len, of)], dtype=np.int32)
            flat = np.fromiter((v for x in of for v in x), np.int32, int(ends[-1]))
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                got = (t.encode_batch if offsets else t.encode_batch_fast)([x or "" for x in part.column(1).to_pylist()], add_special_tokens=False)
                out = [part.column(0), lists([e.ids for e in got])]
                if offsets:
                    out += [lists([[o[k] for o in e.offsets] for e in got]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, names=[key, "ids", "starts", "ends"][: len(out)])

    return spread(documents.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("text"))).mapInArrow(run, fields)


def decode_ids(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, text: the texts of lists of ids by a byte-level vocabulary.

    Bytes of all tokens are joined first; what isn't UTF-8 (a list cut within a character) becomes U+FFFD. A null list gives null, an
    empty list the empty text, an unknown id nothing.
    """
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.value)
        table = byte_characters()
        added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
        known = {i: added.get(i) or bytes(table[c] for c in s) for s, i in t.get_vocab(with_added_tokens=True).items()}
        for b in batches:
            texts = [None if ids is None else b"".join(known.get(i, b"") for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("bigint").alias(key), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"{key} bigint, text string")
