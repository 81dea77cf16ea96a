"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the sum over all
ways to cut it into pieces, which the forward algorithm finds in one sweep; pieces do not span white space, so a text's
likelihood is the product over its words, and the prediction is the language with the largest posterior under a uniform
prior.  Characters outside the vocabulary are spelled in its byte pieces, so every text has a probability.

The piece probabilities are learned by expectation maximisation (forward-backward over the words' segmentations), on a
bounded sample of about ``sample`` documents per language, chosen by a hash of the id.  Only sums over pieces, as many as
vocabulary times languages, reach the driver.  Prediction is one map-only pass over whole texts in which every worker
remembers the words it has met, up to ``CACHE_WORDS``.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is everything when nothing could be
learned; empty strings are the same; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .common import SLICE_ROWS, held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_WORDS = 300_000
#: Words of more characters are scored one by one with rescaling, and are not learned from.
LONG_WORD = 40
#: Of sums below this, what was lost to underflow on the way could matter.
TINY = 1e-150
_SPACE = "▁"


class Pieces:
    """The fixed vocabulary: piece strings, the pieces of single bytes, and a trie as sorted arrays."""

    def __init__(self, names: list[str]):
        self.ids = {n: k for k, n in enumerate(names)}
        self.size = len(names)
        self.longest = max(map(len, names), default=1)
        self.bytes = [self.ids[f"<0x{b:02X}>"] for b in range(256)]
        node = {p: k for k, p in enumerate(sorted({n[:k] for n in names for k in range(len(n) + 1)}))}
        # an edge of the trie is (node, character) in one number; node 0 is the root
        edge = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.int64)
        child = np.array([k for p, k in node.items() if p], np.int32)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]
        self.piece_at = np.full(len(node), -1, np.int32)
        self.piece_at[[node[n] for n in names]] = np.arange(self.size)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie nodes that follow ``node`` by ``char``; -1 where there is none."""
        wanted = node.astype(np.int64) << 21 | char
        at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
        return np.where(self.edge[at] == wanted, self.child[at], -1)

    @staticmethod
    def load(path: str = VOCABULARY) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Pieces([model.id_to_piece(k) for k in range(model.get_piece_size()) if not model.is_control(k) and not model.is_unknown(k)])


class Lattice:
    """All segmentations of a list of words, as edges sorted by end position and word."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.words, self.pieces = words, pieces
        self.lengths = np.array([len(w) + 1 for w in words])
        code = np.frombuffer("".join([_SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        start = np.arange(len(code)) - np.repeat(first, self.lengths)
        left = self.lengths[word] - start
        # all positions walk the trie together, one character in each round
        parts = []
        at, node = np.arange(len(code)), np.zeros(len(code), np.int32)
        for k in range(1, pieces.longest + 1):
            node = pieces.step(node, code[at + k - 1])
            on = node >= 0
            piece = np.where(on, pieces.piece_at[node], -1)
            if k == 1:
                strange = at[piece < 0]
            hit = piece >= 0
            parts.append((at[hit], np.full(int(hit.sum()), k), piece[hit]))
            more = on & (left[at] > k)
            at, node = at[more], node[more]
            if not len(at):
                break
        # characters that are no piece stand for themselves
        spelled, which = np.unique(code[strange], return_inverse=True)
        parts.append((strange, np.ones(len(strange), int), pieces.size + which))
        at, span, piece = (np.concatenate(x) for x in zip(*parts))
        self.word, self.start, self.piece = word[at], start[at], piece
        self.end = self.start + span
        #: byte pieces of the characters that the vocabulary lacks
        self.spelled = [[pieces.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in spelled]

    def extended(self, logp: np.ndarray) -> np.ndarray:
        """Piece log-probabilities with rows for the spelled characters."""
        return np.concatenate([logp, [logp[b].sum(axis=0) for b in self.spelled]]) if self.spelled else logp

    def _sweep(self, order: np.ndarray, into: np.ndarray, out_of: np.ndarray, p: np.ndarray, values: np.ndarray, at: range) -> None:
        """values[word, into] += values[word, out_of] * p, position by position."""
        into, out_of, word, p = into[order], out_of[order], self.word[order], p[order]
        bounds = np.searchsorted(into if at.step > 0 else -into, np.array(at) if at.step > 0 else -np.array(at))
        bounds = np.r_[bounds, len(into)]
        for lo, hi, j in zip(bounds[:-1], bounds[1:], at):
            if hi > lo:
                w = word[lo:hi]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                values[w[first], j] = np.add.reduceat(values[w, out_of[lo:hi]] * p[lo:hi], first, axis=0)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Forward sums; ``p`` has each edge's probability (edges, languages)."""
        top = int(self.lengths.max(initial=0))
        alpha = np.zeros((len(self.lengths), top + 1, p.shape[1]))
        alpha[:, 0] = 1
        self._sweep(np.lexsort((self.word, self.end)), self.end, self.start, p, alpha, range(1, top + 1))
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        top = int(self.lengths.max(initial=0))
        beta = np.zeros((len(self.lengths), top + 1, p.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        self._sweep(np.lexsort((self.word, -self.start)), self.start, self.end, p, beta, range(top - 1, -1, -1))
        return beta

    def log_totals(self, logp: np.ndarray) -> np.ndarray:
        """log P(word) by language; a word that comes near the end of the range of doubles is summed in log space."""
        # a fixed factor for each character keeps the sums near one
        scale = 6.0
        edge = np.exp(self.extended(logp)[self.piece] + scale * (self.end - self.start)[:, None])
        total = self.forward(edge)[np.arange(len(self.lengths)), self.lengths]
        bad = np.flatnonzero((total < TINY).any(axis=1))
        total[bad] = 1
        found = np.log(total) - scale * self.lengths[:, None]
        for k in bad:
            found[k] = long_word(self.words[k], self.pieces, logp)
        return found


def long_word(word: str, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """log P(word) of a word of any length: the same forward sums, rescaled at every position."""
    w = _SPACE + word
    n, span = len(w), pieces.longest
    ring = np.full((span + 1, logp.shape[1]), -np.inf)
    ring[0] = 0.0
    for j in range(1, n + 1):
        terms = []
        for i in range(max(0, j - span), j):
            p = pieces.ids.get(w[i:j])
            if p is not None:
                terms.append(ring[i % (span + 1)] + logp[p])
            elif i == j - 1:
                terms.append(ring[i % (span + 1)] + logp[[pieces.bytes[b] for b in w[i].encode("utf-8", "surrogatepass")]].sum(axis=0))
        terms = np.array(terms)
        top = terms.max(axis=0)
        ring[j % (span + 1)] = top + np.log(np.exp(terms - top).sum(axis=0))
    return ring[n % (span + 1)]


def long_uses(word: str, pieces: Pieces, logp: np.ndarray) -> list[tuple[list[int], float]]:
    """Expected uses of pieces in a word by one language's ``logp``, in log space."""
    w = _SPACE + word
    n = len(w)
    edges = []
    for i in range(n):
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            p = pieces.ids.get(w[i:j])
            if p is not None:
                edges.append((i, j, [p]))
            elif j == i + 1:
                edges.append((i, j, [pieces.bytes[b] for b in w[i].encode("utf-8", "surrogatepass")]))
    cost = [logp[own].sum() for _, _, own in edges]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for (i, j, _), c in zip(edges, cost):
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + c)
    for (i, j, _), c in zip(reversed(edges), reversed(cost)):
        beta[i] = np.logaddexp(beta[i], beta[j] + c)
    return [(own, float(np.exp(alpha[i] + c + beta[j] - alpha[n]))) for (i, j, own), c in zip(edges, cost)]


class Model:
    """Piece log-probabilities (pieces, languages) over a vocabulary."""

    def __init__(self, pieces: Pieces, languages: list[str], logp: np.ndarray):
        self.pieces, self.languages, self.logp = pieces, languages, logp


class Identifier:
    """Predicts with a model; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.known = np.empty((0, len(model.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """log P of each of the distinct ``words``."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.known = {}, self.known[:0]
        new = [w for w in words if w not in self.index]
        rows = np.empty((len(new), self.known.shape[1]))
        short = [k for k, w in enumerate(new) if len(w) <= LONG_WORD]
        short.sort(key=lambda k: len(new[k]))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            rows[part] = Lattice([new[k] for k in part], self.model.pieces).log_totals(self.model.logp)
        for k, w in enumerate(new):
            if len(w) > LONG_WORD:
                rows[k] = long_word(w, self.model.pieces, self.model.logp)
        self.index.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.known = np.concatenate([self.known, rows])
        return self.known[[self.index[w] for w in words]]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        flat: list[str] = []
        ends = []
        for t in texts:
            if t and any(map(str.isalpha, t)):
                flat += t.lower().split()
            ends.append(len(flat))
        ends = np.array(ends)
        begins = np.r_[0, ends[:-1]]
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        if flat and self.model.languages:
            ids, vocab = pd.factorize(np.array(flat, object))
            some = np.flatnonzero(ends > begins)
            total = np.zeros((len(texts), self.known.shape[1]))
            total[some] = np.add.reduceat(self.words(list(vocab))[ids], begins[some], axis=0)
            post = np.exp(total - total.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            for k in some:
                labels[k], scores[k] = self.model.languages[best[k]], post[k, best[k]]
        return labels, scores


def expected_counts(words: list[str], lang: np.ndarray, count: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, over the words' segmentations (the E step)."""
    lattice = Lattice(words, pieces)
    own = lang[lattice.word]
    scale = 6.0
    edge = np.exp(lattice.extended(logp)[lattice.piece, own] + scale * (lattice.end - lattice.start))[:, None]
    alpha, beta = lattice.forward(edge), lattice.backward(edge)
    total = alpha[np.arange(len(words)), lattice.lengths, 0]
    bad = total < TINY
    share = np.where(bad, 0, count / np.where(bad, 1, total))
    use = alpha[lattice.word, lattice.start, 0] * edge[:, 0] * beta[lattice.word, lattice.end, 0] * share[lattice.word]
    rows = np.zeros((len(logp) + len(lattice.spelled), logp.shape[1]))
    np.add.at(rows, (lattice.piece, own), use)
    for k, spelled in enumerate(lattice.spelled):
        np.add.at(rows, spelled, rows[len(logp) + k])
    for k in np.flatnonzero(bad):
        for own_pieces, n in long_uses(words[k], pieces, logp[:, lang[k]]):
            np.add.at(rows, (own_pieces, lang[k]), n * count[k])
    return rows[: len(logp)]


def train(docs: DataFrame, pieces: Pieces | None = None, sample: int = 1200, rounds: int = 3, smoothing: float = 0.1) -> Model:
    """Learn from the text and language of rows that are not held out, about ``sample`` documents of each language.

    Runs without a blank that are longer than ``LONG_WORD`` characters are learned from in parts of that length.
    """
    pieces = pieces or Pieces.load()
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model(pieces, [], np.zeros((pieces.size, 0)))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / counts[lang]) * 1_000_003)])
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_003))
    words = (
        known.where(rank < share[F.col("lang")])
        .select(number[F.col("lang")].alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?U)\S{{1,{LONG_WORD}}}"), 0)).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    words = cut(words)
    logp = np.full((pieces.size, len(languages)), -np.log(pieces.size))
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], logp=logp) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(logp)
            for pdf in batches:
                pdf = pdf.sort_values("word", key=lambda s: s.str.len())
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    total += expected_counts(part["word"].tolist(), part["lang"].to_numpy(), part["n"].to_numpy(float), pieces, logp)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        uses = np.full((pieces.size, len(languages)), smoothing)
        uses[sums["piece"], sums["lang"]] += sums["n"]
        logp = np.log(uses / uses.sum(axis=0))
    return Model(pieces, languages, logp)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                labels, scores = identify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
