"""Packing: tokenized documents into fixed-length sequences by harmonic classes."""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geodemand.llm.common import pick, prepare

_FLUSH = 4 << 20


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@functools.cache
def encoder(path: str):
    """``text -> uint32 ids`` of the byte-level BPE at ``path`` (the ``tokenizers`` file).

    Where the same vocabulary lies beside it as a ``.tiktoken`` rank file, that
    library encodes (about four times faster, same ids; ``tests/llm`` compares
    them); texts that its pattern engine refuses, such as runs of millions of
    blanks, and those that hold an added token go to ``tokenizers``.
    """
    @functools.cache
    def plain():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(plain().encode(text, add_special_tokens=False).ids, dtype="<u4")

    ranks_file = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_file):
        return slow
    import public_tokenizers
    import tiktoken
    with open(ranks_file, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    with open(path, encoding="utf-8") as fh:
        added = [x["content"] for x in json.load(fh).get("added_tokens") or []]
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in added):
            return slow(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as error:  # the engine panics with an exception that is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return slow(text)

    return encode


def pieces(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(class, size) of the cuts of a document, in order; class k holds k pieces in each bin.

    Whole bins first. A rest of ``r`` belongs to class ``k = capacity // r``; it
    is kept whole if k of it fill a bin but for ``slack``, else a piece of
    ``capacity // (k + 1)``, which fills bins of class k + 1, is cut off.
    """
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * k >= (1 - slack) * capacity:
            out.append((k, rest))
            break
        size = capacity // (k + 1)
        out.append((k + 1, size))
        rest -= size
    return out


def _close(open_bins: dict[int, list], capacity: int) -> Iterator[list]:
    """Sequences of what is left in unfilled bins: cut at the capacity, the last one at powers of two."""
    left = [p for k in sorted(open_bins) for p in open_bins[k]]
    total = sum(len(p[2]) for p in left)
    sizes = [capacity] * (total // capacity)
    sizes += [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    queue = iter(left)
    piece = None
    for size in sizes:
        seq, room = [], size
        while room:
            if piece is None:
                piece = next(queue)
            doc, start, ids, n = piece
            take = min(room, len(ids))
            seq.append((doc, start, ids[:take], n))
            piece = (doc, start + take, ids[take:], n) if take < len(ids) else None
            room -= take
        yield seq


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, slack: float,
                   worker: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = np.array([end_id], dtype="<u4")
    open_bins: dict[int, list] = {}
    rows: list[tuple] = []
    held, seq_id = 0, worker << 40

    def emit(seq):
        nonlocal held, seq_id
        offset = 0
        for doc, start, ids, n in seq:
            rows.append((doc, start, len(ids), n, seq_id, offset, ids.tobytes()))
            offset += len(ids)
        held += 4 * offset
        seq_id += 1

    def flush():
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        held = 0
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.concatenate((encode(text.as_py() or ""), end))
            start = 0
            for k, size in pieces(len(ids), capacity, slack):
                bin_ = open_bins.setdefault(k, [])
                bin_.append((doc, start, ids[start:start + size], len(ids)))
                start += size
                if len(bin_) == k:
                    emit(bin_)
                    del open_bins[k]
            if held >= _FLUSH:
                yield flush()
    for seq in _close(open_bins, capacity):
        emit(seq)
    if rows:
        yield flush()


def pack_documents(docs: DataFrame, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str | None = None, end_id: int = 1, slack: float = 0.01) -> DataFrame:
    """Pieces of tokenized documents in sequences of at most ``capacity`` (a power of two) ids.

    Each document is its ids and ``end_id``. Lengths fall in reciprocal classes:
    a bin of class k holds k pieces of about ``capacity / k`` ids, so every task
    fills bins by counting, without looking at other tasks. What a task has left
    in unfilled bins is run together and its tail cut at powers of two, which
    need no padding; each class holds less than one bin, so memory stays at a few
    hundred bins besides the current batch. No shuffle.

    Null text is empty: the document is ``end_id`` alone. Null and repeated ids
    are kept as they are; each row is a document. An empty table gives no rows.
    Other columns are ignored.

    Returns id, start, length, doc_tokens, sequence_id, offset and the ids as
    little-endian unsigned 32-bit values (``ids``). ``sequence_id`` is the task's
    number times 2**40 plus a count, so it repeats when a lost task is run again.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path()
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    plain = pick(docs, id=id_col, text=text_col)
    kind = plain.schema["id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        schema = pa.schema([("id", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                            ("ids", pa.binary())])
        return pack_partition(batches, path, end_id, capacity, slack, TaskContext.get().partitionId(), schema)

    packed = plain.mapInArrow(run, f"id {kind.simpleString()}, start long, length long, doc_tokens long, "
                                   "sequence_id long, offset long, ids binary")
    return packed.withColumnRenamed("id", id_col)
