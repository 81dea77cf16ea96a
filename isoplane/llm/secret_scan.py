"""Secret scanning with a random forest that removes false positives.

Candidates come from four rules: a value assigned to a name that speaks of a secret, a token with the shape of a known
credential, a password inside a URL, and a long run of mixed characters.  A forest trained on labelled findings decides which of them are
secrets, from length, character classes and transitions, entropy, dictionary coverage, the document's path and the words
next to the candidate.

The labelled findings are a parameter; by default they are made by ``labelled_findings`` from seeded rules (keys,
passwords and tokens against commit ids, checksums, identifiers and placeholders).  The dictionary is the set of
alphabetic pieces of a public vocabulary file, also a parameter.  Both are of bounded size and travel with the code; the
scan itself is one map-only pass over whole texts.

Edge cases: null and empty texts have no candidate; a null path has no path words; where candidates overlap the more
specific rule wins, then the earlier and longer one; repeated rows are scanned each; other columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Words that name a secret, words that name something harmless, and words of throw-away values.
SECRET_WORDS = "password passwd pwd secret token apikey api_key api-key access_key private_key credential auth bearer client_secret key".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid revision build version integrity fingerprint id ref".split()
PLACEHOLDER_WORDS = "example sample dummy placeholder changeme your test fake redacted xxxx todo none null insert replace".split()
TEST_PATH_WORDS = "test tests example examples sample docs doc fixture fixtures mock lock vendor dist".split()
SECRET_PATH_WORDS = "env config conf settings deploy secrets credentials prod terraform".split()

_NAMES = "|".join(re.escape(w) for w in sorted(SECRET_WORDS, key=len, reverse=True))
ASSIGNED = re.compile(rf"(?i)(?:{_NAMES})[\w-]*[\"']?\s{{0,3}}(?:=>|:=|[:=]|\s(?=\S{{16}}))\s{{0,3}}[\"']?([^\s\"'<>(){{}}\[\],;]{{6,}})")
IN_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"'<>]*:([^\s/@\"'<>]{3,})@")
SHAPED = re.compile(
    r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|sk[-_][A-Za-z0-9_-]{20,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|glpat-[\w-]{20}|npm_[A-Za-z0-9]{36})"
)
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_TRAIL = "#$%&*.!?,;:"


def dictionary(path: str = VOCABULARY, least: int = 4) -> frozenset[str]:
    """Lower-case alphabetic pieces of ``least`` to 12 letters of a ranked vocabulary file (base64 and rank per line)."""
    found = set()
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).strip().lower()
            if least <= len(piece) <= 12 and piece.isascii() and piece.isalpha():
                found.add(piece.decode())
    return frozenset(found)


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, rule)`` of the candidates of one text, in order and without overlaps."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(w in low for w in ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")):
        spans += [(0, m.start(1), m.start(1) + len(m[1].rstrip(_TRAIL)), "assigned") for m in ASSIGNED.finditer(text)]
    spans += [(1, *m.span(), "shaped") for m in SHAPED.finditer(text)]
    if "://" in text:
        spans += [(1, *m.span(1), "url") for m in IN_URL.finditer(text)]
    for m in LONG_RUN.finditer(text):
        value = m[0].strip("=-_/+")
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            at = m.start() + m[0].index(value)
            spans.append((2, at, at + len(value), "run"))
    taken: list[tuple[int, int, str]] = []
    level = -1
    done: list[tuple[int, int, str]] = []
    for rank, a, b, rule in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if rank != level:
            done, level = sorted(done + taken), rank
            taken = []
        if (b - a >= 6 or rule == "url") and not _overlaps(done, a, b) and not (taken and taken[-1][1] > a):
            taken.append((a, b, rule))
    return sorted(done + taken)


def _overlaps(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        if spans[mid][1] <= a:
            lo = mid + 1
        else:
            hi = mid
    return lo < len(spans) and spans[lo][0] < b


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that a greedy cover by dictionary words takes."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(low)


FEATURES = (
    "length transitions entropy lower upper digit symbol hex coverage distinct longest_repeat assigned shaped run "
    "secret_before harmless_before placeholder_near placeholder_in uuid path_test path_secret quoted in_url password_before"
).split()
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")


def features(value: str, rule: str, before: str, after: str, path: str | None, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = Counter(kinds)
    counts = Counter(value)
    repeat = longest = 1
    for a, b in zip(value, value[1:]):
        repeat = repeat + 1 if a == b else 1
        longest = max(longest, repeat)
    near = set(re.findall(r"[a-z0-9]+", before.lower()))
    around = near | set(re.findall(r"[a-z0-9]+", after.lower()))
    low, tail = value.lower(), before.lower()[-40:]
    places = set(re.findall(r"[a-z]+", (path or "").lower()))
    return [
        min(n, 200),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        share[0] / n,
        share[1] / n,
        share[2] / n,
        share[3] / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        _coverage(value, words),
        len(counts) / min(n, 64),
        longest,
        rule == "assigned",
        rule == "shaped",
        rule == "run",
        any(w in tail for w in SECRET_WORDS),
        any(w in near for w in HARMLESS_WORDS),
        any(w in around for w in PLACEHOLDER_WORDS),
        any(w in low for w in PLACEHOLDER_WORDS),
        bool(_UUID.search(value)),
        any(w in places for w in TEST_PATH_WORDS),
        any(w in places for w in SECRET_PATH_WORDS),
        before[-1:] in ("'", '"'),
        rule == "url",
        any(w in tail for w in ("pass", "pwd", "credential")),
    ]


def labelled_findings(count: int = 4000, seed: int = 7) -> list[tuple[str, str, int]]:
    """``(text, path, label)`` with one finding each, half of them secrets, made from seeded rules."""
    rng = random.Random(seed)
    letters, hexa = string.ascii_letters + string.digits, "0123456789abcdef"

    def run(chars: str, n: int) -> str:
        return "".join(rng.choice(chars) for _ in range(n))

    def words(n: int) -> list[str]:
        return ["".join(rng.choice(("the", "an", "er", "ing", "ou", "data", "user", "list", "name", "value", "on", "re")) for _ in range(rng.randint(1, 3))) for _ in range(n)]

    def assigned(value: str) -> str:
        name = rng.choice([w.upper() if rng.random() < 0.3 else w for w in SECRET_WORDS])
        quote = rng.choice(['"', "'", ""])
        return f"{name}{rng.choice([' = ', '=', ': ', ':'])}{quote}{value}{quote}"

    def name() -> str:
        return rng.choice(("Anna", "summer", "Dragon", "monkey", "letmein", "hunter", "Berlin", "qwerty", "blue", "tiger", "Winter", "ninja"))

    def chosen() -> str:
        """A password as people choose them."""
        return rng.choice((f"{name()}{rng.randrange(2100)}{rng.choice('!$#?*')}", f"{name()}{rng.choice('!_-.')}{name()}{rng.randrange(100)}", f"{rng.randrange(100)}{name()}{rng.choice('!@%')}", name().replace("e", "3").replace("a", "4") + run(string.digits, 4)))

    def secret() -> str:
        kind = rng.randrange(10)
        value = (
            run(hexa, rng.choice((16, 18, 20, 24, 32, 40, 48, 64))) if kind < 3 else run(letters, rng.randint(16, 44)) if kind == 3
            else run(letters + "!@%^_-+", rng.randint(8, 24)) if kind == 4 else run(letters + "+/", rng.choice((32, 40, 64))) + "=" if kind == 5
            else rng.choice(("AKIA" + run(string.ascii_uppercase + string.digits, 16), "ghp_" + run(letters, 36), "AIza" + run(letters, 35), "sk-" + run(letters, 32), "xoxb-" + run(string.digits, 11) + "-" + run(letters, 24))) if kind < 8
            else chosen()
        )
        if kind == 8:
            return f"{rng.choice(('postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb+srv'))}://{rng.choice(('', 'admin', 'app', 'root', 'svc'))}:{rng.choice((chosen(), run(letters, 14)))}@{rng.choice(('db', 'host.internal', '10.0.0.7'))}:{rng.randrange(9999)}/x"
        if kind == 9:
            return f"{rng.choice(('password', 'passwd', 'pwd', 'db_password', 'PASSWORD'))}{rng.choice((' = ', '=', ': '))}{value}"
        return value if kind > 5 and rng.random() < 0.5 else assigned(value)

    def harmless() -> str:
        kind = rng.randrange(11)
        if kind == 0:
            return f"{rng.choice(HARMLESS_WORDS)} {run(hexa, rng.choice((32, 40, 64)))}"
        if kind == 1:
            return f"{rng.choice(('uuid', 'id', 'guid', 'request'))}={run(hexa, 8)}-{run(hexa, 4)}-{run(hexa, 4)}-{run(hexa, 4)}-{run(hexa, 12)}"
        if kind == 2:
            return assigned(rng.choice(("changeme", "your-api-key-here", "example_token_123", "xxxxxxxxxxxxxxxx", "<insert>", "placeholder1", "dummy-secret", "test1234")))
        if kind == 3:
            return assigned(rng.choice(("", "get")) + "_".join(words(2)) + rng.choice(("", "()", ".value", "Provider")))
        if kind == 4:
            return "".join(w.title() for w in words(4)) + str(rng.randrange(100))
        if kind == 5:
            return "-".join(words(5)) + f"-{rng.randrange(10_000)}"
        if kind == 6:
            return f"/{'/'.join(words(4))}/v{rng.randrange(9)}/{'_'.join(words(2))}"
        if kind == 7:
            return f"https://{rng.choice(('user', 'name'))}:{rng.choice(('password', 'example', 'xxxx', '<insert>', 'your-password'))}@example.com/{words(1)[0]}"
        if kind == 8:
            return f"{rng.choice(('monkey', 'keyboard', 'key', 'tokens', 'author', 'secretary', 'passage'))}{rng.choice((': ', ' = '))}{words(1)[0]}{words(1)[0]}"
        if kind == 9:
            return f"{rng.choice(('key', 'auth', 'token', 'password'))}{rng.choice(('=', ': '))}{rng.choice(('os.environ', 'config.get', 'request.form', 'process.env.NAME', 'settings.value', 'required', 'optional', 'undefined'))}"
        return assigned(" ".join(words(3)))

    # the path says something, but it does not give the label away
    places = [*(["src7", "web/page.html", None] * 6), *SECRET_PATH_WORDS, *TEST_PATH_WORDS, "src/main.py", "README.md", "app/models.rb"]
    found = []
    while len(found) < count:
        label = len(found) % 2
        likely = SECRET_PATH_WORDS if label else TEST_PATH_WORDS
        text = " ".join([*words(rng.randint(0, 6)), secret() if label else harmless(), *words(rng.randint(0, 6))])
        if candidates(text):
            found.append((text, rng.choice(likely if rng.random() < 0.15 else places), label))
    return found


class Forest:
    """A random forest of Gini trees, kept as flat arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, leaf: int = 4, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, round(math.sqrt(x.shape[1])))
        return Forest([Forest._tree(x[rows], y[rows], depth, leaf, tries, rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))])

    @staticmethod
    def _tree(x, y, depth, leaf, tries, rng) -> tuple[np.ndarray, ...]:
        feature, limit, left, value = [], [], [], []

        def add() -> int:
            for part in (feature, limit, left, value):
                part.append(0.0)
            return len(value) - 1

        todo = [(add(), np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            value[node] = y[rows].mean()
            feature[node] = -1
            if level == depth or len(rows) < 2 * leaf or value[node] in (0.0, 1.0):
                continue
            best = (1e-9, None, None)
            for f in rng.permutation(x.shape[1])[:tries]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, positive = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(v) + 1)
                ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= leaf) & (len(v) - n[:-1] >= leaf))
                if len(ok):
                    a, b = positive[ok] / n[ok], (positive[-1] - positive[ok]) / (len(v) - n[ok])
                    p = value[node]
                    gain = p * (1 - p) - (n[ok] * a * (1 - a) + (len(v) - n[ok]) * b * (1 - b)) / len(v)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, (v[ok[k]] + v[ok[k] + 1]) / 2)
            if best[1] is None:
                continue
            feature[node], limit[node] = int(best[1]), float(best[2])
            down = x[rows, best[1]] <= best[2]
            left[node] = add()
            add()
            todo += [(left[node], rows[down], level + 1), (left[node] + 1, rows[~down], level + 1)]
        return np.array(feature, int), np.array(limit), np.array(left, int), np.array(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, value in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = left[at] + (x[inner, feature[at]] > limit[at])
            total += value[node]
        return total / len(self.trees)


def finding_features(text: str, path: str | None, words: frozenset[str]) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    spans = candidates(text)
    return spans, np.array([features(text[a:b], rule, text[max(0, a - 60) : a], text[b : b + 40], path, words) for a, b, rule in spans], float)


def train(findings: Iterable[tuple[str, str | None, int]] | None = None, vocabulary: str = VOCABULARY) -> tuple[Forest, frozenset[str]]:
    """The forest and the dictionary; a text's label holds for its first candidate."""
    words = dictionary(vocabulary)
    x, y = [], []
    for text, path, label in labelled_findings() if findings is None else findings:
        spans, rows = finding_features(text, path, words)
        if spans:
            x.append(rows[0])
            y.append(float(label))
    return Forest.fit(np.array(x), np.array(y)), words


def judge(texts: list[str | None], paths: list[str | None], model: tuple[Forest, frozenset[str]]) -> list[list[tuple[int, int, str, float]]]:
    """``(start, end, rule, probability)`` of each text's candidates."""
    forest, words = model
    found = [finding_features(t, p, words) if t else ([], None) for t, p in zip(texts, paths)]
    rows = [x for _, x in found if x is not None and len(x)]
    scores = iter(forest.predict(np.concatenate(rows)).tolist() if rows else ())
    return [[(a, b, rule, next(scores)) for a, b, rule in spans] for spans, _ in found]


SCHEMA = "doc_id long, start int, length int, rule string, digest string, probability double, is_secret int"


def scan(docs: DataFrame, model: tuple[Forest, frozenset[str]], limit: float = 0.5, path_col: str = "source") -> DataFrame:
    """One row for each candidate; the secret itself is shown only as a SHA-256 digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                ids, texts, paths = (c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)
                rows = [
                    (i, a, b - a, rule, hashlib.sha256(t[a:b].encode()).hexdigest(), p, int(p >= limit))
                    for i, t, found in zip(ids, texts, judge(texts, paths, model))
                    for a, b, rule, p in found
                ]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(path_col).alias("path")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: tuple[Forest, frozenset[str]], limit: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mask``; ``n_chars``, if there, follows the new text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(names.index("text")).to_pylist()
                paths = part.column(names.index("source")).to_pylist() if "source" in names else [None] * len(texts)
                changed = {}
                for k, found in enumerate(judge(texts, paths, model)):
                    secret = [(a, b) for a, b, _, p in found if p >= limit]
                    if secret:
                        changed[k] = True
                        ends = [0, *(b for _, b in secret)]
                        texts[k] = mask.join(texts[k][x:y] for x, y in zip(ends, [*(a for a, _ in secret), len(texts[k])]))
                columns = list(part.columns)
                if changed:
                    columns[names.index("text")] = pa.array(texts, part.schema.field(names.index("text")).type)
                    if "n_chars" in names:
                        c = names.index("n_chars")
                        sizes = columns[c].to_pylist()
                        columns[c] = pa.array([len(texts[k]) if k in changed else n for k, n in enumerate(sizes)], columns[c].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
