"""Toxic spans by a linear-chain conditional random field.

The chain runs over the words of a sentence with two states, *toxic* and *other*.  Emissions sum the weights of a word's
features (the word, its prefixes and suffixes), so inflected and compounded forms of an offending stem are found too.
Training needs labelled tokens; where only documents are labelled, they are projected onto tokens first: a greedy
multi-cover picks the word features that explain the toxic documents and are all but absent from the others.  The chain
is fitted by its exact gradient (forward-backward), and a two-feature logistic model maps a document's marginals to its
score.

Scoring is one map-only pass over whole texts: no shuffle, memory bounded by a slice of rows, and a lost executor only
repeats its partitions.  Training looks at a bounded sample of labelled rows (``max_positive``, ``max_negative``,
``max_chars``), chosen by a hash of the id, and its model is a table of bounded size.

Edge cases: a null or empty text has no evidence and gets the lowest score; ids that carry both labels, null labels and
labels without a document are not learned from; without both classes the score is the share of toxic labels (0 if there
are none); repeated rows are scored each; other columns pass through or are ignored as said below.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, held_out

TOKEN = re.compile(r"\w+|[.!?\n]+")
#: A word counts as tagged from this marginal on.
SPAN_P = 0.5
#: Longest chain while training, in words; longer sentences are trained on in several parts.
TRAIN_CHAIN = 48
#: Most words a worker remembers the emissions of.
CACHE_WORDS = 400_000


#: Lengths of the prefixes that are features of a word.
PREFIXES = (3, 4, 5, 6, 7)


def lexicon_features(word: str) -> list[str]:
    """The word and its prefixes: what one entry of a lexicon can name."""
    return ["w" + word] + ["p" + word[:k] for k in PREFIXES if len(word) >= k]


def word_features(word: str) -> list[str]:
    found = lexicon_features(word)
    if len(word) > 4:
        found.append("s" + word[-4:])
    return found


@dataclass
class ToxicModel:
    """Feature weights of the chain's emissions, its transitions, and the document calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    #: log potentials: from state, to state (0 other, 1 toxic)
    transitions: tuple = ((0.0, 0.0), (0.0, 0.0))
    calibration: tuple[float, float, float] | None = None
    base_rate: float = 0.0

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))

    def document_score(self, top: float, mass: float) -> float:
        if self.calibration is None:
            return self.base_rate
        return float(_sigmoid(np.dot(self.calibration, _evidence(top, mass))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _evidence(top, mass):
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.array([np.ones_like(top), np.log(top / (1 - top)), np.log1p(mass)])


def marginals(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word and the summed pair marginals, for chains at ``starts`` with ``lengths`` words.

    Chains are sorted by length, so step ``t`` of all chains is one vector operation.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    a = np.exp(np.asarray(transitions, float))
    odds = np.exp(np.clip(emissions, -30, 30))
    n = len(emissions)
    fwd = np.zeros((2, n))
    bwd = np.ones((2, n))
    pairs = np.zeros((2, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            o, x = np.ones(len(at)), odds[at]
        else:
            po, px = fwd[0, at - 1], fwd[1, at - 1]
            o, x = po * a[0, 0] + px * a[1, 0], (po * a[0, 1] + px * a[1, 1]) * odds[at]
        z = o + x
        fwd[0, at], fwd[1, at] = o / z, x / z
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        no, nx = bwd[0, at + 1], bwd[1, at + 1] * odds[at + 1]
        o, x = a[0, 0] * no + a[0, 1] * nx, a[1, 0] * no + a[1, 1] * nx
        z = o + x
        bwd[0, at], bwd[1, at] = o / z, x / z
        joint = np.array([[fwd[0, at] * a[0, 0] * no, fwd[0, at] * a[0, 1] * nx], [fwd[1, at] * a[1, 0] * no, fwd[1, at] * a[1, 1] * nx]])
        pairs += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    p = fwd * bwd
    return p[1] / np.maximum(p[0] + p[1], 1e-300), pairs


def _grouped(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A representative document for each: the first one with the same two smallest hashes of five-word runs.

    That joins most near copies, so that a group of copies does not pass for many independent witnesses.
    """
    mix = np.random.default_rng(5).integers(1, 2**62, int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64)[ids]
    run = mix.copy()
    for k in range(1, 5):
        run[: len(run) - k] += mix[k:] * np.uint64(2 * k + 1)
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    first: dict[tuple, int] = {}
    out = np.empty(docs, np.int64)
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        own = run[lo : max(lo + 1, hi - 4)] if hi > lo else run[:0]
        least = np.partition(own, 1)[:2] if len(own) > 2 else own
        out[i] = first.setdefault(tuple(sorted(least.tolist())), i)
    return out


def token_lexicon(vocab: np.ndarray, word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, covers: int = 3, ratio: float = 25.0) -> set[str]:
    """Word features that explain the toxic documents: a greedy cover in which each is to be explained ``covers`` times.

    ``(word, doc)`` are distinct pairs, ``toxic`` is by document.  A word is explained once: when a feature is chosen,
    its words no longer count for other features.
    """
    p, q = int(toxic.sum()), int((~toxic).sum())
    least = max(5, round(0.01 * p))
    good: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    bad_pair = toxic[doc]
    for k in (0, *PREFIXES):
        names = [("w" + w if not k else "p" + w[:k] if len(w) >= k else "") for w in vocab]
        feature, named = pd.factorize(np.array(names, object))
        at = feature[word]
        pair = np.unique(at.astype(np.int64) * len(toxic) + doc)
        of, where = pair // len(toxic), pair % len(toxic)
        pos = np.bincount(of[toxic[where]], minlength=len(named))
        neg = np.bincount(of[~toxic[where]], minlength=len(named))
        chosen = (pos >= least) & ((pos + 0.5) / (p + 1) >= ratio * (neg + 0.5) / (q + 1)) & (named != "")
        rows = np.flatnonzero(chosen[at] & bad_pair)
        rows = rows[np.argsort(at[rows], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(at[rows])) + 1):
            if len(part):
                good[named[at[part[0]]]] = (doc[part], word[part])
    open_, free = np.full(len(toxic), covers), np.ones(len(vocab), bool)
    lexicon: set[str] = set()
    while good:
        gains = {f: len(set(d[(open_[d] > 0) & free[w]].tolist())) for f, (d, w) in good.items()}
        # of features that explain the same documents the longest is the least likely to catch innocent words
        gain, _, best = max((n, len(f), f) for f, n in gains.items())
        if gain < least:
            break
        lexicon.add(best)
        docs, words = good.pop(best)
        open_[np.unique(docs[free[words]])] -= 1
        free[words] = False
        good = {f: d for f, d in good.items() if gains[f] >= least}
    return lexicon


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets in it are offsets in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def fit(
    toxic_texts: list[str], other_texts: list[str], weights: tuple[float, float] = (1.0, 1.0), steps: int = 70, l2: float = 0.02, max_near: int = 12_000, max_other: int = 2000
) -> ToxicModel:
    """Fit the chain and its calibration; ``weights`` undo the classes' sampling rates.

    The chain learns from all sentences with a labelled word, from ``max_near`` others with a word that shares a prefix
    with a labelled one, and from as many of the rest as there are labelled ones and ``max_other`` more.
    """
    total = weights[0] * len(toxic_texts) + weights[1] * len(other_texts)
    model = ToxicModel(base_rate=weights[0] * len(toxic_texts) / total if total else 0.0)
    if not toxic_texts or not other_texts:
        return model
    texts = [*toxic_texts, *other_texts]
    label = np.arange(len(texts)) < len(toxic_texts)
    # token numbers instead of strings: the driver holds each distinct word once
    number: dict[str, int] = {}
    parts = [np.fromiter((number.setdefault(w, len(number)) for w in [*TOKEN.findall(lowered(text)), "\n"]), np.int32) for text in texts]
    ids = np.concatenate(parts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    vocab = np.array(list(number), object)
    del parts, number
    breaks = np.array([w[0] in ".!?\n" for w in vocab])
    word = ~breaks[ids]
    first = _grouped(ids[word], doc[word], len(texts))
    apart = first == np.arange(len(texts))
    usable = word & apart[doc]
    pair = np.unique(ids[usable].astype(np.int64) * len(texts) + doc[usable])
    lexicon = token_lexicon(vocab, pair // len(texts), pair % len(texts), label)
    if not lexicon:
        return model
    hit = np.array([not b and any(f in lexicon for f in lexicon_features(w)) for w, b in zip(vocab, breaks)])

    # chains: sentences with a labelled word, and others as a contrast
    begins = np.flatnonzero(usable & np.r_[True, ~usable[:-1]])
    finish = np.flatnonzero(usable & np.r_[~usable[1:], True]) + 1
    pieces = -(-(finish - begins) // TRAIN_CHAIN)
    ends_of = np.repeat(finish, pieces)
    begins = np.repeat(begins, pieces) + TRAIN_CHAIN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    finish = np.minimum(begins + TRAIN_CHAIN, ends_of)
    marked = hit[ids] & label[doc] & usable
    # words that share a prefix with a labelled one teach where the prefix stops being an offence: keep all of them
    shared = {f for w in vocab[hit] for f in lexicon_features(w)}
    close = np.array([not b and any(f in shared for f in lexicon_features(w)[1:][1:]) for w, b in zip(vocab, breaks)])
    has, near = (np.add.reduceat(x & usable, begins) > 0 if len(begins) else np.zeros(0, bool) for x in (marked, close[ids]))
    rng = np.random.default_rng(17)
    groups = [(has, len(has)), (near & ~has, max_near), (~near & ~has, int(has.sum()) + max_other)]
    take = np.sort(np.concatenate([rng.permutation(np.flatnonzero(g))[:most] for g, most in groups]))
    lengths = finish[take] - begins[take]
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    at = np.repeat(begins[take] - starts, lengths) + np.arange(lengths.sum())
    y = marked[at].astype(float)
    own, chain_vocab = pd.factorize(ids[at])
    words = [vocab[k] for k in chain_vocab]
    seen = Counter(f for w in words for f in word_features(w))
    hot = {f for k, w in zip(chain_vocab, words) if hit[k] for f in word_features(w)}
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3 or f in hot))}
    del seen
    row, col = array("i"), array("i")
    for k, w in enumerate(words):
        own_features = [index[f] for f in word_features(w) if f in index]
        row.extend([k] * len(own_features))
        col.extend(own_features)
    row, col = np.frombuffer(row, np.int32), np.frombuffer(col, np.int32)
    size = len(index)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    nxt = np.flatnonzero(inner)
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[nxt - 1].astype(int), y[nxt].astype(int)), 1)
    # one vector: feature weights, bias, transitions; ascent by Adam on the exact gradient of the mean log-likelihood
    theta = np.r_[np.zeros(size), -3.0, np.zeros(4)]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emission = theta[size] + np.bincount(row, theta[col], len(words))
        p, pairs = marginals(emission[own], starts, lengths, theta[size + 1 :].reshape(2, 2))
        per_word = np.bincount(own, y - p, len(words))
        grad = np.r_[np.bincount(col, per_word[row], size), per_word.sum(), (truth - pairs).ravel()] - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        theta += 0.12 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-3)
    names = list(index)
    model.weights = {names[k]: float(theta[k]) for k in np.flatnonzero(np.abs(theta[:size]) > 0.01)}
    model.bias, model.transitions = float(theta[size]), tuple(map(tuple, theta[size + 1 :].reshape(2, 2).tolist()))

    scorer = Scorer(model)
    parts = [scorer.evidence(texts[i : i + SLICE_ROWS])[:2] for i in range(0, len(texts), SLICE_ROWS)]
    x = _evidence(np.concatenate([t for t, _ in parts]), np.concatenate([s for _, s in parts]))
    w = np.where(label, weights[0], weights[1])
    w = w / w.mean()
    beta = np.zeros(3)
    for _ in range(60):
        q = _sigmoid(beta @ x)
        grad = x @ (w * (label - q)) - np.array([0, 0.1, 0.1]) * beta
        hess = (x * (w * q * (1 - q))) @ x.T + np.diag([1e-6, 0.1, 0.1])
        move = np.linalg.solve(hess, grad)
        beta = beta + move / max(1.0, float(np.abs(move).max()))
    model.calibration = tuple(float(b) for b in beta)
    return model


class Scorer:
    """Scores texts with a model; remembers the emissions of words it has met."""

    def __init__(self, model: ToxicModel):
        self.model, self.known = model, {}

    def _emissions(self, words) -> np.ndarray:
        known, emission = self.known, self.model.emission
        if len(known) > CACHE_WORDS:
            known.clear()
        out = np.empty(len(words))
        for k, w in enumerate(words):
            e = known.get(w)
            if e is None:
                e = known[w] = -1e9 if w[0] in ".!?\n" else emission(w)
            out[k] = e
        return out

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text the largest and the summed marginal, and the positions of tagged tokens with their marginals."""
        flat: list[str] = []
        ends = []
        for text in texts:
            flat += TOKEN.findall(lowered(text)) if text else ()
            flat.append("\n")
            ends.append(len(flat))
        ids, vocab = pd.factorize(np.array(flat, object))
        e = self._emissions(vocab)[ids]
        stop = e == -1e9
        begins = np.flatnonzero(~stop & np.r_[True, stop[:-1]])
        finish = np.flatnonzero(stop & np.r_[False, ~stop[:-1]])
        p = np.zeros(len(flat))
        if len(begins):
            got, _ = marginals(np.where(stop, 0, e), begins, finish - begins, self.model.transitions)
            p = np.where(stop, 0, got)
        first = np.r_[0, ends[:-1]].astype(int)
        top, mass = np.maximum.reduceat(p, first), np.add.reduceat(p, first)
        tagged = np.flatnonzero(p >= SPAN_P)
        cut = np.searchsorted(tagged, np.r_[first, len(flat)])
        return top, mass, [np.c_[tagged[a:b] - s, p[tagged[a:b]]] for a, b, s in zip(cut[:-1], cut[1:], first)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        top, mass, tagged = self.evidence(texts)
        if self.model.calibration is None:
            scores = np.full(len(texts), self.model.base_rate)
        else:
            scores = _sigmoid(np.asarray(self.model.calibration) @ _evidence(top, mass))
        spans = []
        for text, marks in zip(texts, tagged):
            found = []
            if len(marks):
                where = [m.span() for m in TOKEN.finditer(lowered(text))]
                found = [{"start": where[int(k)][0], "end": where[int(k)][1], "p": float(p)} for k, p in marks]
            spans.append(found)
        return scores, spans


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_negative: int = 4000, max_chars: int = 20_000_000) -> ToxicModel:
    """Fit on the rows of ``docs`` that ``labels.toxic`` marks and that are not held out.

    At most about ``max_positive`` and ``max_negative`` documents are taken, in the order of a hash of their id, and
    whole texts as far as they fit into ``max_chars`` characters; that is the bound of what reaches the driver.  A class
    of which no text fits counts as absent: the model then has learned nothing.
    """
    known = (
        labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic")).where("low = toxic").select("doc_id", "toxic")
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ToxicModel()
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1_000_003))
    share = {y: min(1.0, most / max(1, counts.get(y, 0))) for y, most in ((1, max_positive), (0, max_negative))}
    sample = known.withColumn("h", rank).where(F.col("h") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * 1_000_003)
    # the sample is bounded, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null").select("h", "toxic", "text")
    groups: dict[int, list[str]] = {0: [], 1: []}
    chars = 0
    for r in chosen.orderBy("h", "text").toLocalIterator():
        if chars + len(r["text"]) > max_chars:
            continue
        chars += len(r["text"])
        groups[r["toxic"]].append(r["text"])
    undo = tuple(counts.get(y, 0) / max(1, len(groups[y])) for y in (1, 0))
    return fit(groups[1], groups[0], undo)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, spans)`` of every row; ``spans`` has the character offsets of the tagged words."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                scores, spans = scorer(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicModel, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay as they are, in one map-only pass.

    A model that has learned nothing keeps all rows.
    """
    if model.calibration is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                top, mass, _ = scorer.evidence(part.column(part.schema.names.index("text")).to_pylist())
                scores = _sigmoid(np.asarray(scorer.model.calibration) @ _evidence(top, mass))
                yield part.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)
