"""Importance resampling towards a target distribution.

1. *Gains*: words and word pairs of whole texts are hashed to buckets; one array of a gain per bucket says how much more
   often the target (a benchmark, a clean corpus) uses that bucket than the documents do.  Counts are summed per task
   before the shuffle: a task sends one row for each bucket.
2. *Array-scored weights*: a map-only pass looks every feature up in that array.  The weight is the mean gain; seeded Gumbel
   noise of the id makes the highest scores a draw without replacement in proportion to ``exp(weight / 1000)``.
3. *Runs*: each task sorts its eligible rows in runs of ``RUN`` rows.  Scores are whole thousandths in a narrow range, so a
   counted table of scores gives the exact rank at which each score begins; rows that cannot be drawn are never sorted.
4. *External merge*: the drawn scores are cut into groups of about ``GROUP`` rows (a heavy score also between ids), and
   runs into blocks at the groups' borders.  A task gets its group's blocks in the order of their first entries, so it
   opens a block only when the merge reaches it, whatever the number of runs, and merges the open ones with a tournament
   tree.  The last group stops at the exact draw count.  A group's first rank is known, so no task waits for another.

Rows with equal id, score, weight and length are one entry with a count, so repeated rows do not make a group large.

Edge cases: a null or wordless text has no features and weight 0; a null id gives a null score and is never drawn nor
counted; ties go to the smaller id, then to the fewer features (rows that agree in all of it are interchangeable);
repeated rows are drawn each; an empty table gives no rows, an empty target gains from smoothing only; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .common import SLICE_ROWS

#: Rows of a sorted run, entries of one of its blocks, and rows that one merging task is meant to get.
RUN, BLOCK, GROUP = 1 << 18, 4096, 1 << 18
#: A group costs a task; fewer rows than this are not worth another one.
LEAST_GROUP = 1 << 10
BUCKETS = 10_000

# bytes of words stay, A-Z become lower case, all others part words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def feature_buckets(found: list[bytes], width: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``width`` words; the hash of a longer run continues that of the shorter one."""
    crc = zlib.crc32
    hashes = [crc(w) for w in found]
    parts = [np.array(hashes, np.int64)]
    spaced = [b" " + w for w in found] if width > 1 else []
    for k in range(1, width):
        hashes = [crc(w, h) for h, w in zip(hashes, spaced[k:])]
        parts.append(np.array(hashes, np.int64))
    return np.concatenate(parts) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how often the features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                found = words(value.as_py())
                if found:
                    total += np.bincount(feature_buckets(found, width, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths of a natural logarithm; ``buckets`` numbers, whatever the input."""
    found = corpus.withColumn("s", F.col("n")).select("bucket", "s", F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in found.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)]


def noise(doc_id: int, seed: int = 7) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", width: int = 2, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``(doc_id, n_features, weight, score, eligible)`` for every row; map-only."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows = []
                for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = words(value.as_py())
                    of = feature_buckets(found, width, len(table))
                    weight = int(table[of].sum()) // len(of) if len(of) else 0
                    rows.append((i, len(of), weight, None if i is None else weight + noise(i, seed), i is not None and len(found) >= least_words))
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_features", "weight", "score", "eligible"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")


# --- the merge -----------------------------------------------------------------------------------------------------

Entry = tuple[int, int, int, int, int]  # -score, doc_id, n_features, weight, count


class Tournament:
    """A tournament tree over sorted runs: each node holds the leaf that wins below it.

    The leaf of a finished run can be given to another one, and the tree doubles when it is full.
    """

    def __init__(self):
        self.size, self.runs, self.heads, self.winners, self.free = 1, [None], [None], [0, 0], [0]

    def _play(self, node: int) -> None:
        a, b = self.winners[2 * node], self.winners[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self.winners[node] = a if y is None or (x is not None and x <= y) else b

    def _replay(self, leaf: int) -> None:
        """Play the matches from a changed leaf up to the root."""
        node = (leaf + self.size) // 2
        while node:
            self._play(node)
            node //= 2

    def _double(self) -> None:
        old, self.size = self.size, 2 * self.size
        self.free += range(old, self.size)
        self.heads += [None] * old
        self.runs += [None] * old
        self.winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._play(node)

    def add(self, block: list[Entry]) -> None:
        """Another sorted run, not empty, at a free leaf."""
        if not self.free:
            self._double()
        leaf = self.free.pop()
        self.runs[leaf] = iter(block)
        self.heads[leaf] = next(self.runs[leaf])
        self._replay(leaf)

    @property
    def head(self) -> Entry | None:
        return self.heads[self.winners[1]]

    def pop(self) -> Entry:
        """The smallest head; its run moves on."""
        leaf = self.winners[1]
        entry = self.heads[leaf]
        self.heads[leaf] = next(self.runs[leaf], None)
        if self.heads[leaf] is None:
            self.runs[leaf] = None
            self.free.append(leaf)
        self._replay(leaf)
        return entry

    def rest(self) -> Iterator[Entry]:
        """What is left of all runs, in no order."""
        for head, run in zip(self.heads, self.runs):
            if head is not None:
                yield head
                yield from run


def merge(blocks: Iterable[list[Entry]], most: int) -> Iterator[Entry]:
    """Entries of all sorted ``blocks`` in order, until they stand for ``most`` rows; then the rest, unmerged.

    Blocks come by their first entries and are opened when they are due.
    """
    tree, waiting, rows = Tournament(), iter(blocks), 0
    block = next(waiting, None)
    while rows < most and (block is not None or tree.head is not None):
        while block is not None and (tree.head is None or block[0] <= tree.head):
            tree.add(block)
            block = next(waiting, None)
        entry = tree.pop()
        rows += entry[4]
        yield entry
    yield from tree.rest()
    while block is not None:
        yield from block
        block = next(waiting, None)


def sorted_entries(pdf: pd.DataFrame) -> list[Entry]:
    """A run: the rows in order, equal ones as one entry with their count."""
    sums = pdf.assign(key=-pdf["score"]).groupby(["key", "doc_id", "n_features", "weight"], sort=True).size()
    return [(*key, n) for key, n in zip(sums.index.tolist(), sums.tolist())]


def plan(counts: list[tuple[int, int | None, int]], draw: int, group: int) -> list[tuple[int, int, int]]:
    """``(-score, id, first rank)`` of each group's lower border, and one border more behind the last group.

    ``counts`` are ``(-score, first id or None, rows)`` in order; a border without an id comes before all ids.
    """
    borders, rank, size = [], 0, None
    for key, start, rows in counts:
        lowest = -(1 << 63) if start is None else start
        if rank >= draw:
            return [*borders, (key, lowest, rank)]
        if size is None or size + rows > group:
            borders.append((key, lowest, rank))
            size = 0
        size += rows
        rank += rows
    return [*borders, (counts[-1][0] + 1, -(1 << 63), rank)]


def _counted(eligible: DataFrame, draw: int, group: int) -> list[tuple[int, int | None, int]]:
    """Rows of each score down to the last drawn one, heavy scores by ranges of ids.

    Scores are whole thousandths between bounds that logarithms of counts and of the noise set (some 1e5 values at most),
    and a heavy score has ranges in proportion to its rows, so this stays small beside the rows.
    """
    sums = eligible.groupBy("score").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy(F.desc("score")).collect()
    rank, found, heavy = 0, [], {}
    for row in sums:
        found.append((-row["score"], None, row["n"]))
        if row["n"] > group and row["b"] > row["a"]:
            slots, shift = 4 * -(-row["n"] // group), 0
            while (row["b"] >> shift) - (row["a"] >> shift) >= slots:
                shift += 1
            heavy[row["score"]] = shift
        rank += row["n"]
        if rank >= draw:
            break
    if not heavy:
        return found
    shifts = F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv])
    some = eligible.where(F.col("score").isin(list(heavy))).withColumn("shift", F.element_at(shifts, F.col("score").cast("int")))
    ranges = some.groupBy("score", "shift", F.expr("shiftright(doc_id, shift)").alias("slot")).count().collect()
    split = [(-r["score"], int(r["slot"]) << int(r["shift"]), r["count"]) for r in ranges]
    return sorted([x for x in found if -x[0] not in heavy] + split, key=lambda x: (x[0], x[1] or 0))


def ranked(rows: DataFrame, draw: int, group: int | None = None, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``rows`` of ``scored`` with ``rank`` 1, 2, 3 … for the ``draw`` eligible rows of the highest scores, null for others.

    ``rows`` is read several times: cut it first.  ``group`` and ``run`` change tasks and memory, never the result.
    """
    keep = ["doc_id", "n_features", "weight", "score"]
    if draw <= 0:
        return rows.select(*keep, F.lit(None).cast("long").alias("rank"))
    if group is None:
        tasks = rows.sparkSession.sparkContext.defaultParallelism
        group = min(GROUP, max(LEAST_GROUP, draw // (2 * tasks)))
    eligible = rows.where("eligible")
    borders = plan(_counted(eligible, draw, group), draw, group)
    starts, (end, end_id, _) = [b[:2] for b in borders[:-1]], borders[-1]
    ranks = [b[2] for b in borders[:-1]]
    due = (F.col("score") > -end) | ((F.col("score") == -end) & (F.col("doc_id") < end_id))

    def cut_run(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, at, blocks = sorted_entries(part), 0, []
        while at < len(found):
            g = bisect.bisect_right(starts, found[at][:2]) - 1
            to = bisect.bisect_left(found, starts[g + 1], at) if g + 1 < len(starts) else len(found)
            for k in range(at, to, block):
                piece = found[k : min(k + block, to)]
                blocks.append((g, *piece[0][:4], *[np.array(c, np.int64) for c in zip(*piece)]))
            at = to
        if blocks:
            yield pd.DataFrame(blocks, columns=["g", *_FIRST, *_ENTRY])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= run:
                yield from cut_run(pd.concat(held))
                held, n = [], 0
        if n:
            yield from cut_run(pd.concat(held))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, blocks in _groups(batches):
            yield from _numbered(merge(blocks, draw - ranks[g]), ranks[g], draw)

    arrays = ", ".join(f"{c} array<long>" for c in _ENTRY)
    pieces = eligible.where(due).select(*keep).mapInPandas(runs, "g int, " + ", ".join(f"{c} long" for c in _FIRST) + ", " + arrays)
    dealt = pieces.repartition(max(1, len(starts)), "g").sortWithinPartitions("g", *_FIRST)
    drawn = dealt.mapInPandas(merged, "doc_id long, n_features long, weight long, score long, rank long")
    rest = rows.where(~(F.col("eligible") & F.coalesce(due, F.lit(False))))
    return drawn.unionByName(rest.select(*keep, F.lit(None).cast("long").alias("rank")))


_FIRST = ["first_key", "first_id", "first_features", "first_weight"]
_ENTRY = ["key", "id", "features", "weights", "counts"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator[list[Entry]]]]:
    """The groups of a sorted partition, each with its blocks as a stream that must be read to its end."""
    rows = ((r.g, list(zip(*(getattr(r, c).tolist() for c in _ENTRY)))) for pdf in batches for r in pdf.itertuples(index=False))
    now = next(rows, None)

    def blocks(g: int) -> Iterator[list[Entry]]:
        nonlocal now
        while now is not None and now[0] == g:
            block, now = now[1], next(rows, None)
            yield block

    while now is not None:
        g = now[0]
        yield g, blocks(g)


def _numbered(entries: Iterator[Entry], rank: int, draw: int) -> Iterator[pd.DataFrame]:
    """Rows of the merged entries from ``rank`` on; the first ``draw`` of all groups have ranks, the rest null."""
    names = ["doc_id", "n_features", "weight", "score"]
    held, n = [], 0

    def frame() -> pd.DataFrame:
        table = np.array(held, np.int64)
        one = np.repeat(table, table[:, 4], axis=0)
        found = pd.DataFrame(one[:, [1, 2, 3]], columns=names[:3]).assign(score=-one[:, 0])
        at = np.arange(rank + 1, rank + 1 + len(one))
        return found.assign(rank=pd.array(np.where(at <= draw, at, 0), dtype="Int64")).assign(rank=lambda d: d["rank"].mask(at > draw))

    for entry in entries:
        held.append(entry)
        n += entry[4]
        if n >= BLOCK:
            yield frame()
            held, rank, n = [], rank + n, 0
    if held:
        yield frame()


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, width: int = 2, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``percent`` of those with ``least_words`` are drawn."""
    gain = gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, target_text_col, width, buckets), buckets)
    rows = cut(scored(docs, gain, id_col, text_col, width, least_words, seed))
    return ranked(rows, percent * rows.where("eligible").count() // 100)


def oracle() -> str:
    """DuckDB SQL of the registered query; the CRC-32 table comes from its polynomial."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = f"xor(c >> 8, list_extract({table}, CAST(xor(c & 255, b) AS INTEGER) + 1))"
    bits = "list_transform(range(0, strlen(w)), lambda i: CAST(('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), texts AS (SELECT r, text FROM d UNION ALL SELECT -1 - row_number() OVER (), text FROM benchmark),
ws AS (SELECT r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM texts),
f AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[CAST(i AS BIGINT)] || ' ' || ws[CAST(i + 1 AS BIGINT)]))) AS w FROM ws),
n AS (SELECT r, w, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, b: {step}), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM n)),
b AS (SELECT r, bucket, CAST(sum(n) AS BIGINT) AS n FROM n JOIN h USING (w) GROUP BY ALL),
k AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (r > 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (r < 0), 0) AS DOUBLE) AS t FROM b GROUP BY bucket),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln((k.t + 1) * (a.s + 10000) / ((k.s + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM k CROSS JOIN a),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS nf, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM b JOIN g USING (bucket) GROUP BY r),
s AS (SELECT d.doc_id, coalesce(nf, 0) AS n_features, coalesce(weight, 0) AS weight, doc_id IS NOT NULL AND len(ws) >= 20 AS eligible,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || left(sha256('7:' || CAST(doc_id AS VARCHAR)), 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d JOIN ws USING (r) LEFT JOIN m USING (r)),
p AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= floor(25 * n / 100) THEN place END AS rank FROM p"""
