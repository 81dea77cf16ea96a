"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Entities (mail addresses, phone numbers, IP addresses, payment cards, social security numbers, IBANs and person names)
get replacements made with a keyed hash.  A replacement keeps the entity's type and format: separators, length, letter
case, country prefix, Luhn and IBAN check digits where the original's are right, and for names the gender, the script
(Latin or Cyrillic) and hyphens.  The same entity, in whatever format it is written, always gets the same replacement;
given names, surnames and mail domains are entities of their own, so *Mr Smith* and *Anna Smith* stay related, and so do
two addresses of one house.  A given name is one entity whatever title it bears; its gender is the one it is seen with,
or neither if it is seen with both.

Distinctness is checked on the whole corpus: distinct entities are one distributed table, their surrogates are grouped,
and where two entities share one, or a surrogate equals a real entity, all but the first draw again; given names and
surnames are checked together.  Names and domains grow with the draws.  Where the numbers of a kind are so many that its
format has no unused ones, real numbers may be drawn from round ``REAL_ROUNDS`` on (still distinct); after
``MAX_ROUNDS`` the operator raises, as then there are more entities than the format has values.

Texts are searched twice: once for the rows with entities, which are written to the shared folder with their spans, and
once for the rows without, which pass straight through.  Only the former are shuffled, by a key of their own, to meet
their replacements.  An entity found in a third of all documents is one row of the entity table, and its occurrences are
split by the adaptive skew join, as are the copies of one text.

Edge cases: null and empty texts stay; a null ``doc_id`` is no obstacle; repeated rows get equal texts; other columns
pass through; the key is a parameter, and the same key gives the same surrogates unless collisions differ; a run of 13
to 19 digits is a card if its check digit is right, if it is written in groups, or if it has 16 digits and starts with 3
to 6.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoplane.checkpoints import cut

from .common import SLICE_ROWS, own_name

# Titles by gender (m, f, or n for either), and given names by gender and script.
TITLES = {
    "m": "Mr Mr. Herr Herrn Monsieur Señor Sr. Sir Lord господин".split(),
    "f": "Mrs Mrs. Ms Ms. Miss Frau Madame Mme Mademoiselle Señora Sra. Señorita Lady госпожа".split(),
    "n": "Dr Dr. Prof. Professor доктор".split(),
}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Paul Peter George Hans Karl Klaus Jürgen Wolfgang Stefan Jean Pierre Jacques Michel Henri José Juan Carlos Luis Miguel Pedro".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Anna Emma Laura Julia Ursula Helga Petra Sabine Monika Ingrid Marie Jeanne Sophie Claire Camille María Carmen Ana Isabel Lucía Sofía".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Владимир Михаил Олег".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
# Syllables and endings that surrogate names are put together from.
SYLLABLES = {"latin": "ba be da de fi ga jo ka la le li lo ma mi na ne no pa ra ri ro sa se ta te ti va ve vi za".split(), "cyrillic": "ба ве га да зи ка ла ле ми на но па ра ри ро са та ти фе ша".split()}
ENDINGS = {
    ("m", "latin"): "bert ric mund win ron dan".split(), ("f", "latin"): "lina rina nia lia tta sa".split(), ("n", "latin"): "ley man son field wood berg".split(),
    ("m", "cyrillic"): "мир слав ид ан".split(), ("f", "cyrillic"): "ина ия ета ала".split(), ("n", "cyrillic"): "ов ин енко ский".split(),
}

_GENDER_OF = {name.lower(): gender for (gender, _), names in GIVEN.items() for name in names}
_UPPER = "[A-ZÀ-ÖØ-ÞА-ЯЁ" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper()) + "]"
_CAPITAL = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)*"
#: Rounds of drawing after which a surrogate may be a real entity, and after which the format is exhausted.
REAL_ROUNDS, MAX_ROUNDS = 20, 60
_TITLE = re.compile(r"\b(?:" + "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True)) + rf")\s({_CAPITAL}(?:\s{_CAPITAL})*)")
_RUN = re.compile(rf"\b{_CAPITAL}(?:\s{_CAPITAL})+")
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
EMAIL = re.compile(r"[A-Za-z0-9_](?:[\w.+%-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IPV4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
CARD = re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}\d|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _iban_ok(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, norm)`` of the entities, in order and without overlaps; ``norm`` names the entity."""
    if not text:
        return []
    found: list[tuple[int, int, int, str, str]] = []
    if "@" in text:
        found += [(0, *m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if re.search(r"\d", text):
        for m in IBAN.finditer(text):
            if _iban_ok(norm := m[0].replace(" ", "")):
                found.append((1, *m.span(), "iban", norm))
        found += [(2, *m.span(), "ip", m[0]) for m in IPV4.finditer(text) if all(int(o) < 256 for o in m[0].split("."))]
        found += [(3, *m.span(), "ssn", _digits(m[0])) for m in SSN.finditer(text)]
        found += [(5, *m.span(), "phone", _digits(m[0])) for m in PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
        found += [(4, *m.span(), "card", d) for m in CARD.finditer(text) if (d := _digits(m[0])) != m[0] or _luhn(d) or len(d) == 16 and "3" <= d[0] <= "6"]
    if any(t in text for t in _TITLE_GENDER):
        for m in _TITLE.finditer(text):
            gender = _TITLE_GENDER.get(text[m.start() : m.start(1)].strip(), "n")
            found += [(7, *x) for x in _names(m[1], m.start(1), gender)]
    for m in _RUN.finditer(text):
        found += [(6, *x) for x in _names(m[0], m.start(), None)]
    found.sort()
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text) if found else 0)
    for _, a, b, kind, norm in found:
        if used.find(1, a, b) < 0:
            used[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind, norm))
    return sorted(taken)


def _listed(word: str) -> str | None:
    """The gender of a listed given name; of a double name the first part counts."""
    return _GENDER_OF.get(word.lower()) or _GENDER_OF.get(word.lower().split("-")[0])


def _names(run: str, at: int, gender: str | None) -> list[tuple[int, int, str, str]]:
    """Names in a run of capitalised words: the last word is the surname, those before it are given names.

    With a title's ``gender`` they begin with the run, otherwise with the first listed given name.  A title ends them.
    """
    found: list[tuple[int, int, str, str]] = []
    own: list[tuple[int, int, str]] = []
    titled = gender is not None
    words = [(at + w.start(), at + w.end(), w[0]) for w in re.finditer(r"\S+", run)]
    for a, b, word in [*words, (0, 0, "")]:
        if word and word not in _TITLE_GENDER:
            listed = _listed(word)
            if own or listed or gender:
                gender = gender or listed
                own.append((a, b, word))
            continue
        if len(own) > 1 or own and titled:
            found += [(x, y, "given-" + (_listed(w) or gender), w.lower()) for x, y, w in own[:-1]]
            found.append((own[-1][0], own[-1][1], "surname", own[-1][2].lower()))
        own, gender, titled = [], None, False
    return found


def who(kind: str) -> str:
    """The kind under which an entity is one and the same: given names of any gender are."""
    return "given" if kind.startswith("given") else kind


def domain_of(norm: str) -> str:
    return norm.rsplit("@", 1)[1]


class _Draw:
    """A keyed stream of choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.count, self.pool = f"{kind}|{norm}|{attempt}".encode(), 0, 0
        self.key, self.left = key, 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.pool = int.from_bytes(hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.count, self.left = self.count + 1, 256
        value = self.pool % n
        self.pool //= n
        self.left -= n.bit_length()
        return value


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The ``attempt``-th replacement of an entity, in the same canonical form as ``norm``."""
    draw = _Draw(key, kind, norm, attempt)

    def digits(n: int, first: str = "") -> str:
        out = [str(draw.below(10)) for _ in range(n)]
        if out and first not in ("", "0") and out[0] == "0":
            out[0] = str(1 + draw.below(9))
        return "".join(out)

    def shaped(text: str) -> str:
        return "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in text)

    if kind == "email":
        # the domain is an entity of its own, and is replaced when the address is put together
        local, domain = norm.rsplit("@", 1)
        return f"{shaped(local)}{shaped('a' * (attempt // 4))}@{domain}"
    if kind == "domain":
        *labels, last = norm.split(".")
        return ".".join([*map(shaped, labels[:-1]), shaped(labels[-1]) + shaped("a" * (attempt // 4)), last])
    if kind == "ip":
        own = [int(o) for o in norm.split(".")]
        keep = 1 if own[0] in (10, 127) else 2 if own[:2] == [192, 168] or own[0] == 172 and 16 <= own[1] < 32 else 0
        return ".".join(str(o) if k < keep else str(1 + draw.below(223) if k == 0 else draw.below(256)) for k, o in enumerate(own))
    if kind == "card":
        body = norm[0] + digits(len(norm) - 1)
        if not _luhn(norm):
            return body
        return next(x for d in range(10) if _luhn(x := body[:-1] + str(d)))
    if kind == "phone":
        lead = 1 if norm.startswith("1") and len(norm) == 11 else 2 if len(norm) > 11 else 0
        return norm[:lead] + digits(len(norm) - lead, norm[lead])
    if kind == "iban":
        body = "".join(c if c.isalpha() else str(draw.below(10)) for c in norm[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{check:02d}{body}"
    if kind.startswith("given") or kind == "surname":
        script = script_of(norm)
        gender = kind[-1] if kind.startswith("given") else "n"
        ends = ENDINGS[(gender, script)]

        def name() -> str:
            return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 3)) + ends[draw.below(len(ends))]

        return "-".join(name() for _ in norm.split("-"))
    return digits(len(norm), norm[0])


def render(original: str, kind: str, replacement: str) -> str:
    """The replacement in the original's separators and letter case."""
    if kind in ("phone", "card", "ssn", "iban"):
        marks = iter(replacement)
        return "".join(next(marks) if c.isalnum() else c for c in original)
    if kind == "email":
        local, domain = replacement.rsplit("@", 1)
        was_local, was_domain = original.rsplit("@", 1)
        cased = lambda was, new: new.upper() if was.isupper() else "".join(r.upper() if o.isupper() else r for o, r in zip(was.ljust(len(new)), new))
        return f"{cased(was_local, local)}@{cased(was_domain, domain)}"
    if kind.startswith("given") or kind == "surname":
        return replacement.upper() if original.isupper() else "-".join(p[:1].upper() + p[1:] for p in replacement.split("-"))
    return replacement


def entity_map(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, norm, surrogate)`` of distinct entities ``(kind, norm)``, without collisions; given names are one kind."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(surrogate=[surrogate(k if g is None else f"given-{g}", n, a, key) for k, g, n, a in zip(pdf["kind"], pdf["gender"], pdf["norm"], pdf["attempt"])])

    schema = "kind string, space string, norm string, gender string, attempt int, surrogate string"
    given = F.col("kind").startswith("given")
    seen = F.collect_set(F.when(given & (F.col("kind") != "given-n"), F.right("kind", F.lit(1))))
    folded = (
        entities.groupBy(F.when(given, "given").otherwise(F.col("kind")).alias("one"), "norm").agg(seen.alias("seen"))
        .select(F.col("one").alias("kind"), F.when(F.col("one").isin("given", "surname"), "name").otherwise(F.col("one")).alias("space"), "norm",
                F.when(F.col("one") == "given", F.when(F.size("seen") == 1, F.get("seen", F.lit(0))).otherwise("n")).alias("gender"))
    )
    folded = cut(folded)
    real = folded.select("space", F.col("norm").alias("surrogate")).distinct()
    done, pending = None, folded.withColumn("attempt", F.lit(0))
    for attempt in range(MAX_ROUNDS):
        drawn = cut(pending.select("kind", "space", "norm", "gender", "attempt").mapInPandas(draw, schema))
        free = drawn if attempt >= REAL_ROUNDS else drawn.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["space", "surrogate"], "left_anti")
        # of entities that draw the same, the first in the order of a hash keeps it
        first = free.groupBy("space", "surrogate").agg(F.min_by(F.struct("kind", "norm"), F.struct(F.xxhash64("kind", "norm"), "kind", "norm")).alias("owner"))
        new = cut(first.select("owner.kind", "owner.norm", "space", "surrogate"))
        pending = cut(drawn.join(new.select("kind", "norm"), ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        done = new if done is None else done.unionByName(new)
        if pending.isEmpty():
            return done.select("kind", "norm", "surrogate")
    raise RuntimeError(f"more entities than values of their format, after {MAX_ROUNDS} rounds: {[r['kind'] for r in pending.select('kind').distinct().collect()]}")


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))


def replaced(text: str, spans: list[dict], new: dict[tuple[str, str], str]) -> str:
    """``text`` with the surrogates of its spans."""
    out, at = [], 0
    for s in spans:
        own = new[(who(s["kind"]), s["norm"])]
        if s["kind"] == "email":
            own = own.rsplit("@", 1)[0] + "@" + new[("domain", domain_of(s["norm"]))]
        out += [text[at : s["start"]], render(text[s["start"] : s["end"]], s["kind"], own)]
        at = s["end"]
    return "".join([*out, text[at:]])


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and ``n_entities`` (a free name), the number of replaced spans."""
    names = docs.columns
    at = names.index(text_col)
    found_col, key_col, count_col = own_name("entities", names), own_name("row_key", names), own_name("n_entities", names)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                found = [[dict(zip(("start", "end", "kind", "norm"), x)) for x in detect(t)] for t in part.column(at).to_pylist()]
                tagged = pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _SPAN)], names=[*part.schema.names, found_col])
                yield tagged.filter(pa.array([bool(f) for f in found], pa.bool_()))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                part = part.filter(pa.array([not detect(t) for t in part.column(at).to_pylist()], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([0] * part.num_rows, pa.int32())], names=[*names, count_col])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts, counts = [], []
                for text, spans, pairs in zip(*(part.column(k).to_pylist() for k in (at, len(names), len(names) + 1))):
                    texts.append(replaced(text, spans, {(p["kind"], p["norm"]): p["surrogate"] for p in pairs}))
                    counts.append(len(spans))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*names, count_col])

    out = T.StructType([*docs.schema.fields, T.StructField(count_col, T.IntegerType())])
    tagged = docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(found_col, SPAN)]))
    dirty = cut(tagged.withColumn(key_col, F.struct(F.xxhash64(text_col), F.sha1(F.col(text_col).cast("binary")))))
    found = dirty.select(F.col(key_col).alias("k"), F.col(found_col).alias("found")).dropDuplicates(["k"]).select("k", F.inline("found"))
    domains = found.where("kind = 'email'").select("k", F.lit("domain").alias("kind"), F.substring_index("norm", "@", -1).alias("norm"))
    uses = cut(found.select("k", "kind", "norm").unionByName(domains).distinct())
    one = uses.select("k", F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("kind"), "norm")
    mapped = one.join(entity_map(uses.select("kind", "norm"), key), ["kind", "norm"])
    per_text = mapped.groupBy("k").agg(F.collect_list(F.struct("kind", "norm", "surrogate")).alias("pairs"))
    met = dirty.join(per_text, F.col(key_col) == F.col("k")).select(*[F.col(f"`{c}`") for c in names], found_col, "pairs")
    return docs.mapInArrow(untouched, out).unionByName(met.mapInArrow(put, out))
