"""SimHash near-duplicate detection by bit-sliced comparison.

1. *Fingerprints*: one map-only pass over whole texts.  Every word shingle (repeats included) is hashed with XXH64; a bit
   of the fingerprint is set when more than half of the hashes have it.
2. *Candidate blocks*: distinct fingerprints only, so a group of copies of any size is one row.  The 64 bits are cut into
   ``s`` segments; two fingerprints within radius ``r`` agree on at least ``s - r`` of them, so joining on every choice of
   ``s - r`` segments loses no link.  ``s`` grows with the number of fingerprints and changes the cost, not the result.
   Blocks over ``BLOCK`` rows are dealt to chunk pairs, so no task holds an unbounded group.
3. *Bit-sliced comparison*: a task stores the rows of its blocks once as vertical bit planes and compares each row with
   the one ``d`` places on by shifting the planes, 64 pairs in each machine word.  Differences are counted with
   carry-save bitwise counters, plane after plane, and words are dropped as soon as all of their pairs exceed the radius.
4. *Components*: each task reduces its links to a spanning forest; star contraction joins the forests.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle of all words; repeated rows each get a result row; a null ``doc_id`` keeps its row and takes the smallest
known id of its component (null if there is none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoplane.checkpoints import cut
from isoplane.operators.components import connected_components

from .common import map_slices, own_name, quoted, small

#: Most rows of a candidate block that are compared in one task.
BLOCK = 4096
#: Aimed-at mean size of a candidate block, from which the number of segments follows.
MEAN_BLOCK = 16
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, row, fp)`` for every row; ``fp`` holds the unsigned value's bits in a long, ``row`` is the row's key."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "row", "fp"])

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row", "fp")])
    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")), schema, one)


def plan_segments(rows: int, radius: int) -> int:
    """Fewest segments whose keys leave about ``MEAN_BLOCK`` rows or fewer in a block."""
    for s in range(radius + 1, 17):
        if rows <= MEAN_BLOCK * 2 ** (64 * (s - radius) // s):
            return s
    return 16


def linked_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of all rows of one block key within ``radius`` bits; see ``pair_batches``."""
    found = list(pair_batches(keys, fps, radius))
    none = np.empty(0, np.int64)
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (none, none)


def pair_batches(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one block key within ``radius`` bits, in batches; ``keys`` must be sorted.

    ``fps`` has one 64-bit word for each row, or several (a matrix).  The planes are built once, with the rows of larger
    blocks first: row ``i`` is bit ``i mod 64`` of word ``i div 64``, and the rows that have a partner ``d`` places on
    are a prefix.  The partners' planes are the same planes shifted by ``d`` rows.  Up to 64 distances are worked on at
    once.  Planes are added two at a time by a carry-save adder to vertical counters that start at ``2 ** k - radius - 1``
    and so overflow exactly when the radius is passed; words all of whose pairs have overflowed are dropped.
    """
    if len(fps) < 2:
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    by_size = np.argsort(-sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 1]
    if not len(by_size):
        return
    sizes = sizes[by_size]
    size_of = np.repeat(sizes, sizes)
    place = np.arange(len(size_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(starts[by_size], sizes) + place
    words = -(-len(rows) // 64)
    values = np.zeros((words * 64, fps.size // len(fps)), np.uint64)
    values[: len(rows)] = fps.reshape(len(fps), -1)[rows]
    # a row of zero words behind the last one, so that shifted reads need no test
    planes = np.concatenate([np.pad(_planes(np.ascontiguousarray(v)), ((0, 0), (0, int(sizes[0]) // 64 + 2))) for v in values.T])
    after = np.zeros(words * 64, np.int64)
    after[: len(rows)] = size_of - place
    high = max(1, radius.bit_length())
    d = 1
    while d < sizes[0]:
        ds = np.arange(d, min(d + max(1, min(64, d // 4)), int(sizes[0])))
        used = -(-int(np.searchsorted(-size_of, -d, "left")) // 64)
        alive = np.packbits(after[None, : used * 64] > ds[:, None], axis=1, bitorder="little").view(np.uint64)
        at, word = np.nonzero(alive)
        alive, shift, other = alive[at, word], (ds % 64).astype(np.uint64)[at], word + (ds // 64)[at]
        counter = [np.full(len(alive), ~np.uint64(0) if (2**high - radius - 1) >> k & 1 else np.uint64(0)) for k in range(high)]
        for b in range(0, len(planes), 2):
            x, y = (p[word] ^ (p[other] >> shift | p[other + 1] << np.uint64(1) << (np.uint64(63) - shift)) for p in planes[b : b + 2])
            half = counter[0] ^ x
            carry = counter[0] & x | half & y
            counter[0] = half ^ y
            for k in range(1, high):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            alive = alive & ~carry
            if b % 8 == 6:
                keep = alive != 0
                if 4 * np.count_nonzero(keep) < 3 * len(keep):
                    at, word, other, shift, alive = at[keep], word[keep], other[keep], shift[keep], alive[keep]
                    counter = [c[keep] for c in counter]
                    if not len(alive):
                        break
        if alive.any():
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            lane, bit = np.nonzero(bits)
            first = word[lane] * 64 + bit
            yield rows[first], rows[first + ds[at[lane]]]
        d = int(ds[-1]) + 1


def _planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of 64-bit values, 64 rows in each word: shape (64, rows / 64)."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, as (value, root) pairs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, r) for x in up if (r := top(x)) != x]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(a, b)`` edges that connect exactly the fingerprints (column ``fp``, distinct) linked within ``radius`` bits."""
    rows = fps.count()
    s = plan_segments(rows, radius)
    edges = [64 * i // s for i in range(s + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(s), s - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")))
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.t", "key.v", "fp")
    placed = deal(dealt, ["t", "v"], "fp")
    # one task holds many small blocks; links are checked on the whole fingerprint, so two blocks that share a hash can
    # only repeat work, never make a wrong link

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches):
            fp = pdf["fp"].to_numpy()
            i, j = linked_pairs(pdf["block"].to_numpy(), fp.view(np.uint64), radius)
            if len(i):
                found = spanning_forest(fp[i], fp[j])
                yield pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    return sorted_blocks(placed.select("block", "fp")).mapInPandas(compare, "a long, b long")


def deal(rows: DataFrame, key: list[str], by: str, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """The rows of all keys that have several, dealt to ``block``s; a block holds a whole key or two chunks of a large one.

    Chunks have about ``most`` rows, or a total ``weight`` of ``most``.  ``chunk`` is the row's own chunk and ``same`` is
    true in the block of a chunk with itself.
    """
    weight, most = F.lit(1) if weight is None else weight, most or BLOCK // 2
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(weight).alias("weight")).where("rows > 1")
    chunks = F.least("rows", F.ceil(F.col("weight") / F.lit(most))).cast("int")
    return (
        rows.join(sizes.select(*key, chunks.alias("chunks")), key)
        .withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
        .withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("same", F.col("chunk") == F.col("meets"))
        .withColumn("block", F.xxhash64(*key, F.least("chunk", "meets"), F.greatest("chunk", "meets")))
        .drop("chunks", "meets")
    )


def sorted_blocks(placed: DataFrame) -> DataFrame:
    """Rows of a block in one task, one after the other."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "block").sortWithinPartitions("block")


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut anew, so that each holds whole blocks."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        block = pdf["block"].to_numpy()
        done = int(np.searchsorted(block, block[-1]))
        if rest and block[0] != rest[-1]["block"].iloc[-1]:
            yield pd.concat(rest, ignore_index=True)
            rest = []
        if done:
            yield pd.concat([*rest, pdf.iloc[:done]], ignore_index=True)
            rest = []
        rest.append(pdf.iloc[done:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id, row)`` for every row of ``docs``."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    roots = connected_components(links(groups.select("fp"), radius))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    many = named.where("copies > 1 or root <> fp").select("root").union(roots.select("root")).distinct()
    inner = cut(named.join(many, "root", "left_semi").select("fp", "root", "low"))
    lowest = inner.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = inner.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), "row")


def fingerprint_hex(fp: Column) -> Column:
    """Sixteen lower-case hex digits of the unsigned value."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row for each component: the one with the smallest ``doc_id``; see ``only``."""
    found = cut(components(docs, width=width, radius=radius))
    first = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row"))
    return only(docs, first.select(F.col("component_id").alias("doc_id"), "row"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's own key: rows that share an id are told apart by their text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``(doc_id, row)`` of ``keep``.

    Of several rows with that id and text the one that comes first as JSON stays.  Rows without an id cannot be named by
    any result and stay as they are.
    """
    row, cols = own_name("row", docs.columns), quoted(docs.columns)
    wanted = small(keep.select(F.col("doc_id").alias(row + "_id"), F.col("row").alias(row + "_key")))
    keyed = docs.where("doc_id is not null").withColumn(row, row_key())
    kept = keyed.join(wanted, (F.col("doc_id") == F.col(row + "_id")) & (F.col(row) == F.col(row + "_key")), "left_semi")
    repeated = cut(kept.groupBy(row).count().where("count > 1").select(row))
    if not repeated.isEmpty():
        repeated = small(repeated)
        several = kept.join(repeated, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*cols), F.to_json(F.struct(*cols))).alias("kept"))
        kept = kept.join(repeated, row, "left_anti").select(*cols).unionByName(several.select("kept.*"))
    return kept.select(*cols).unionByName(docs.where("doc_id is null"))
