"""Near copies by SimHash at a similarity: at least 0.8 of the five-word shingles (Jaccard).

The contract of ``simhash`` fixes a radius of 2 of 64 bits, which finds hardly any near copy.  At a similarity of 0.8
about 39 of 256 bits differ, which segments cannot index, so here blocks come from smallest hashes, the bit-sliced
comparison of ``simhash`` finds the pairs worth checking in them, and every link is checked on the whole shingle sets.

1. *Sets*: one map-only pass over whole texts gives, for each distinct shingle set, its digest, a fingerprint of ``WORDS``
   words and ``BANDS`` keys, each of the smallest values under ``ROWS`` hash functions.  Two sets of similarity ``j``
   share a key with probability ``1 - (1 - j ** ROWS) ** BANDS``: 0.999997 at 0.8.  Only distinct sets move, so copies are
   one row.
2. *Comparison*: the sets of a key are a block (large ones are dealt to chunk pairs), in which fingerprints are compared
   bit-sliced at ``RADIUS``, 5.7 standard deviations above the mean at 0.8.  A pair is worked on under the first key that
   it shares only.  The result is the rows with a partner, not the pairs, so it cannot grow with a group's square.
3. *Check*: the texts of those rows are sent to their blocks, the comparison is done again, and the exact similarity of
   the sets decides; pairs that a block has connected already are left out, and a spanning forest of the links comes out.
4. *Components*: star contraction joins the forests.

Edge cases: null and wordless texts have the empty set and are copies of each other; fewer words than a shingle make one
shingle of all words; words compare without ASCII case; rows that share an id are told apart by their text; rows without
an id stay; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoplane.checkpoints import cut
from isoplane.operators.components import connected_components

from .common import map_slices, small
from .simhash import _LOWER, BLOCK, SEED, deal, only, pair_batches, row_key, sorted_blocks, whole_blocks

WIDTH = 5
BANDS, ROWS = 32, 5
WORDS, RADIUS = 4, 72
#: Most shingles of a chunk of a block (8 bytes each, and the text).
CHUNK_SHINGLES = 1_000_000
_ODD = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(words)} if len(words) <= width else set(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, of the smallest hashes under its functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(_ODD[0], hashes[at : at + 1024]).min(axis=1), out=least)
    return (least * _ODD[1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words; a bit is set when more than half of the hashes have it, each word after another mixing."""
    total = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096]
        for k in range(WORDS):
            total[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            x = (x ^ x >> np.uint64(31)) * _ODD[0, k]
            x ^= x >> np.uint64(32)
    return np.packbits(total * 2 > len(hashes), axis=1, bitorder="little").reshape(-1).view("<u8")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, sig, n, fp, bands)`` of every row: the digest, size, fingerprint and keys of its set."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
        sig = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        fps = pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())
        bands = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(sig), pa.array([len(s) for s in sets], pa.int32()), fps, bands]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "sig", "n", "fp", "bands"])

    schema = T._parse_datatype_string("doc_id long, row long, sig long, n int, fp binary, bands array<long>")
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text"), schema, one)


def _candidates(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows worth checking, each under the first key that it shares and once for a chunk."""
    n, k, chunk, same = (pdf[c].to_numpy() for c in ("n", "k", "chunk", "same"))
    bands = np.frombuffer(b"".join(pdf["heads"]), np.int32).reshape(len(pdf), BANDS)
    fps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), WORDS)
    for i, j in pair_batches(pdf["block"].to_numpy(), fps, RADIUS):
        ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & ((chunk[i] != chunk[j]) | same[i])
        i, j = i[ok], j[ok]
        shared = bands[i] == bands[j]
        ok = shared.argmax(axis=1) == k[i]
        if ok.any():
            yield i[ok], j[ok]


def _portions(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Whole blocks with about half a chunk's shingles together, or one larger block."""
    portion = np.cumsum(pdf["n"].to_numpy()) // (CHUNK_SHINGLES // 2)
    block = pdf["block"].to_numpy()
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    firsts = starts[np.r_[True, np.diff(portion[starts]) > 0]]
    for at, to in zip(firsts, np.r_[firsts[1:], len(pdf)]):
        yield pdf.iloc[at:to]


def _with_partner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of blocks that have a pair worth checking."""
    for pdf in whole_blocks(batches):
        hit = np.zeros(len(pdf), bool)
        for i, j in _candidates(pdf):
            hit[i] = hit[j] = True
        if hit.any():
            yield pdf[hit]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest ``(a, b)`` of the links in each block, after the exact check."""
    for pdf in itertools.chain.from_iterable(map(_portions, whole_blocks(batches))):
        sig = pdf["sig"].to_numpy()
        sets = [shingle_set(t) for t in pdf["text"]]
        starts = np.r_[0, np.cumsum([len(s) for s in sets])]
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if starts[-1] else np.empty(0, np.int64)
        mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
        size = np.diff(starts)
        root = np.arange(len(sets))
        a, b = [], []
        for i, j in _candidates(pdf):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else []
            for at, to in zip(cuts[:-1], cuts[1:]):
                x = i[at]
                others = j[at:to]
                others = others[root[others] != root[x]]
                if not len(others):
                    continue
                own = codes[starts[x] : starts[x + 1]]
                mark[own] = True
                both = np.array([np.count_nonzero(mark[codes[starts[y] : starts[y + 1]]]) for y in others])
                mark[own] = False
                for y in others[5 * both >= 4 * (size[x] + size[others] - both)]:
                    if root[y] != root[x]:
                        a.append(sig[x])
                        b.append(sig[y])
                        root[root == root[y]] = root[x]
        if a:
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)`` edges that connect the sets (``sig``, distinct) whose similarity is 0.8 or more; ``texts`` has ``(row, text)``."""
    # only key, digest and size meet by key; what the comparison needs joins the few rows that share one
    keyed = sets.select("sig", "n", F.posexplode("bands").alias("k", "v")).select("sig", "n", "k", F.xxhash64("k", "v").alias("key"))
    dealt = deal(keyed, ["key"], "sig", F.greatest(F.col("n"), F.lit(CHUNK_SHINGLES // (BLOCK // 2))), CHUNK_SHINGLES).drop("key")
    # keys are compared as 32-bit heads within a block
    heads = F.unhex(F.array_join(F.transform("bands", lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))
    placed = dealt.join(sets.select("sig", "row", "fp", heads.alias("heads")), "sig").select("block", "k", "chunk", "same", "sig", "row", "n", "fp", "heads")
    found = cut(sorted_blocks(placed).mapInPandas(_with_partner, placed.schema))
    wanted = cut(texts.join(small(found.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"]))
    return sorted_blocks(found.join(wanted, "row")).mapInPandas(_linked, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component of near copies: the one with the smallest ``doc_id``; see ``simhash.only``."""
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    sets = cut(shingle_sets(docs).groupBy("sig").agg(low.alias("low"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")]))
    roots = connected_components(links(sets, docs.select(row_key().alias("row"), "text"))).withColumnRenamed("node", "sig")
    low = sets.select("sig", "low").join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("low").alias("low"))
    return only(docs, low.where("low is not null").select("low.*"))
