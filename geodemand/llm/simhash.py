"""SimHash near-duplicates: fingerprints joined through Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import mix64, pick, prepare, ragged
from geodemand.llm.components import Forest, connected_components

#: (shift, bits) of the three segments; each fits a 23-bit Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_PART, _PARTS = 26, 45  # bit places in a bucket key: pair and codewords below, block, number of blocks


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each message, message bits of the error with each syndrome) of the (23, 12) code."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - 11)
        return word

    parity = np.array([syndrome(m << 11) for m in range(4096)], dtype=np.int32)
    error = np.zeros(2048, dtype=np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[syndrome(e)] = e >> 11
    return parity, error


_PARITY, _ERROR = _golay()


def codeword(v: np.ndarray) -> np.ndarray:
    """Index of the Golay codeword nearest to each 23-bit word (the code is perfect: at most 3 bits away)."""
    message = v >> 11
    return message ^ _ERROR[(v & 2047) ^ _PARITY[message]]


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, bits = SEGMENTS[k]
    return (fp >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)


def home_keys(fp: np.ndarray) -> np.ndarray:
    """The three bucket keys of each fingerprint itself, one row for each segment pair."""
    own = [codeword(_segment(fp, k)) for k in range(3)]
    return np.stack([np.int64(p << 24) + own[x] * 4096 + own[y] for p, (x, y) in enumerate(PAIRS)])


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, bucket key): the codewords of every word within one bit in both segments of a pair.

    Three errors over three segments leave two segments with at most one error
    each. A segment value and its one-bit neighbours decode to one codeword (two
    errors or fewer) or to six, so a fingerprint has 3 to 108 keys.
    """
    first, values = [], []
    for k, (_, bits) in enumerate(SEGMENTS):
        v = _segment(fp, k)
        near = np.stack([v, *(v ^ (1 << b) for b in range(bits))], axis=1)
        near = np.sort(codeword(near), axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        values.append(near[new])
        first.append(np.concatenate(([0], np.cumsum(new.sum(axis=1)))))
    who, keys = [], []
    for p, (x, y) in enumerate(PAIRS):
        nx, ny = np.diff(first[x]), np.diff(first[y])
        of = np.repeat(np.arange(len(fp)), nx)  # a row for each value of x
        left = np.repeat(values[x], ny[of])
        right = values[y][ragged(first[y][of], ny[of])]
        who.append(np.repeat(of, ny[of]))
        keys.append((np.int64(p) << 24) + left * 4096 + right)
    return np.concatenate(who), np.concatenate(keys)


def fingerprint(text: bytes, words_each: int, seed: int) -> int:
    words = text.lower().split()  # ASCII only, for bytes: A-Z, and blanks 0x20, 0x09-0x0D
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(flat, seed)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps[:len(words) - words_each] + 1).tolist()]
    ends = [*gaps[words_each - 1:].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 18):
        part = hashes[i:i + (1 << 18)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3,
            seed: int = 42) -> DataFrame:
    """(id, fp): 64-bit fingerprint of each text as a signed long."""
    plain = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode(), words_each, seed) for t in batch.column(1)]
            out = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "fp"])

    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp long")


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            fp = batch.column(0).slice(i, 2048).to_numpy().view(np.uint64)
            who, keys = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys + (1 << _PARTS)), pa.array(fp[who].view(np.int64))], names=["key", "fp"])


def _emit_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(home_keys(batch.column(0).to_numpy().view(np.uint64)).ravel())], names=["key"])


def _link(batches: Iterator[pa.RecordBatch], most_bits: int, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Spanning links of the pairs within ``most_bits`` in the buckets of a partition.

    A bucket compares the fingerprints at home in it with all in it; pairs are
    made ``step`` at a time and only unions are kept.
    """
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    key, fp = table["key"].to_numpy(), table["fp"].to_numpy()
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    nodes, node = np.unique(fp, return_inverse=True)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    bucket, part, parts = key & ((1 << _PART) - 1), key >> _PART & ((1 << (_PARTS - _PART)) - 1), key >> _PARTS
    at_home = (home_keys(fp) == bucket).any(axis=0) & (mix64(fp) % parts.astype(np.uint64) == part.astype(np.uint64))
    home = np.flatnonzero(at_home & (np.diff(edge)[run] > 1))
    size = np.diff(edge)[run[home]]
    forest = Forest(len(nodes))
    done = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(home):
        j = max(i + 1, int(np.searchsorted(done, done[i] + step, side="right")) - 1)
        a = np.repeat(home[i:j], size[i:j])
        b = ragged(edge[run[home[i:j]]], size[i:j])
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= most_bits) & (node[a] != node[b])
        forest.union(node[a[near]], node[b[near]])
        i = j
    root, member = forest.links()
    if len(root):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root].view(np.int64)), pa.array(nodes[member].view(np.int64))], names=["a", "b"])


def fingerprint_components(prints: DataFrame, most_bits: int = 3, *, hot: int = 8192, rows_each: int = 1 << 20) -> DataFrame:
    """(fp, root) of the distinct fingerprints that have a link of at most ``most_bits`` (3 or fewer) bits.

    Buckets with more than ``hot`` fingerprints at home are dealt in blocks: each
    block holds some of those at home and all other members.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the keys meet every pair within 3 bits, not beyond")
    spark = prints.sparkSession
    prints = prints.select("fp").distinct().checkpoint()
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * 85 // rows_each + 1)
    keys = prints.repartition(wide).mapInArrow(_emit_keys, "key long, fp long")  # 85 rows out of each
    crowded = (prints.mapInArrow(_emit_homes, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > hot)
               .select((F.col("key") + F.lit(1 << _PARTS)).alias("key"), F.ceil(F.col("n") / hot).cast("long").alias("parts"))
               .checkpoint())
    if not crowded.isEmpty():
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
        keys = keys.join(crowded, "key", "left").select("key", "fp", "parts", part.alias("part")).select(
            (F.col("key") + F.col("part") * (1 << _PART)
             + (F.coalesce("parts", F.lit(1)) - 1) * F.lit(1 << _PARTS)).alias("key"), "fp")
    links = keys.repartition(wide, "key").mapInArrow(lambda batches: _link(batches, most_bits), "a long, b long")
    return connected_components(links).withColumnsRenamed({"node": "fp"})


def simhash_groups(docs: DataFrame, most_bits: int = 3, *, id_col: str = "doc_id", text_col: str = "text",
                   words_each: int = 3, seed: int = 42) -> DataFrame:
    """Each row's SimHash fingerprint and the smallest id of its component.

    Words are runs without blanks of the text with A-Z lower-cased; a shingle is
    ``words_each`` of them joined by blanks (all words, if fewer), hashed by XXH64.
    Fingerprints within ``most_bits`` bits link. Equal fingerprints are compared
    once, whatever their number. Each fingerprint is cut in three segments; a
    bucket joins those whose segments decode, with at most one bit changed, to
    the same pair of Golay codewords, and its pairs are verified by their bits.
    Buckets emit spanning links only, so a group of m near copies gives m - 1
    links a bucket and not all pairs.

    Null and wordless texts have fingerprint 0, which links like any other. A
    null id is never the smallest; a component of null ids alone has a null
    component. Repeated rows are kept. An empty table gives no rows; other
    columns are ignored. Returns id, fingerprint (16 hex digits), component_id.
    """
    spark = docs.sparkSession
    prepare(spark)
    prints = simhash(docs, id_col=id_col, text_col=text_col, words_each=words_each, seed=seed).checkpoint()
    return prints.join(_groups(prints, most_bits), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _groups(prints: DataFrame, most_bits: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (id, fp)."""
    roots = fingerprint_components(prints, most_bits)
    least = prints.groupBy("fp").agg(F.min("id").alias("first")).join(roots, "fp", "left")
    least = least.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    return least.select("fp", "root").join(ids, "root").select("fp", "root", "component_id").checkpoint()


def drop_near_copies(docs: DataFrame, most_bits: int = 3, *, id_col: str = "doc_id", text_col: str = "text",
                     words_each: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component of :func:`simhash_groups`: that with the smallest id. Columns stay as they are.

    Of rows that repeat this id, one stays. In a component of null ids alone, a
    row with the smallest text digest stays. Only the kept ids meet the texts, in
    a semi join that does not sort them.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    tag = F.coalesce(F.md5(F.encode(F.col(text), "UTF-8")), F.lit(""))
    prints = simhash(rows.select(F.struct(F.col(own).alias("own"), F.when(F.col(own).isNull(), tag).alias("tag")).alias("id"), text),
                     id_col="id", text_col=text, words_each=words_each, seed=seed)
    prints = prints.select(F.col("id.own").alias("id"), F.col("id.tag").alias("tag"), "fp").checkpoint()
    groups = prints.join(_groups(prints, most_bits), "fp")
    kept = groups.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    once = kept.where("n = 1").select(F.col("id").alias(own)).hint("shuffle_hash")
    out = rows.join(once, own, "left_semi")
    more = kept.where("n > 1").select(F.col("id").alias(own))
    if not more.isEmpty():
        out = out.unionByName(rows.join(more, own, "left_semi").dropDuplicates([own]))
    if not prints.where("id is null").isEmpty():
        tags = groups.where("component_id is null").groupBy("root").agg(F.min("tag").alias("tag")).select("tag")
        unnamed = rows.where(F.col(own).isNull()).withColumn("tag", tag)
        out = out.unionByName(unnamed.join(tags, "tag", "left_semi").dropDuplicates(["tag"]).drop("tag").select(*names))
    return out.select(*names).toDF(*docs.columns)
