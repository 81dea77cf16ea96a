"""Benchmark decontamination on canonical templates.

A text becomes two aligned token arrays: the lower-cased words, and the *template*, in which numbers, units and names are
typed placeholders.  Windows of five tokens are hashed and joined with those of the benchmark items: literal windows,
and template windows that hold a placeholder and at least two literal words; where five tokens hold fewer, the template
window has ten.  A document leaks an item when at least 0.8 of the item's windows are found in it on *consistent*
diagonals: alignments on which every value of the item's slots stands for one value of the document's.  A question with
other numbers or names is caught, a chance meeting of templates is not, and an inconsistent variant elsewhere in the text
does not hide a leak.  Two values of an item may become one value of the document.

Everything is DataFrame code in the JVM.  Documents are never shuffled: their windows stream past the benchmark's hash
table.  That is broadcast when counted to be at most ``BROADCAST_WINDOWS`` rows; beyond, windows are first held against a
bitmap of the benchmark's hashes (8 MB at any size), and only those that pass are shuffled.  Matching windows are grouped
by row and item.

Edge cases: null and empty texts have no window; texts of under five tokens form one window of all their tokens, which
matches items of exactly those tokens; items of three or four tokens are also found inside longer texts, literally;
items of which no window can match as a template are found literally; rows are told apart by id and text, so rows that
share an id (or have none) are judged each, and equal rows count once; items that share an id are told apart by their
text; other columns are ignored by ``leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .common import own_name, quoted

#: Words in a window, and the share of an item's windows that makes a leak.
WIDTH = 5
COVERAGE = 0.8
#: Fewest literal words of a template window, and the tokens of one that needs more room for them.
LITERALS = 2
WIDE = 10
#: Lengths of short items that are found inside texts.
SHORT = (3, 4)
#: Most benchmark windows that are broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 200_000
#: Bits (as a power of two) of the bitmap that stands in for a larger benchmark.
BITMAP_BITS = 26

# Words read as numbers, as units of measure and as given names.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half "
    "zwei drei vier fünf sechs sieben acht zehn elf zwölf zwanzig dreißig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix douze vingt trente mille dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta mil"
).split()
# German function words; where an eighth of the tokens are such, capital letters do not mark names.
GERMAN = "der die das den dem des und ist ein eine einem einen einer nicht mit von zu auf für im sich wie wird aus bei nach hat auch gibt wenn kann sind".split()
UNITS = (
    "% $ € £ ° mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour "
    "hours day days week weeks month months year years mph kmh kph hz khz mhz ghz kb mb gb tb watt watts kw volt volts "
    "dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers"
).split()
GIVEN_NAMES = (
    "alice bob carol dave eve frank grace heidi ivan judy mallory oscar peggy trent victor walter john james robert michael "
    "william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
    "lisa nancy betty sandra ashley emily anna maria peter paul george henry jack tom tim sam ben max leo emma olivia sophia "
    "mia ella lily lucy jane kate laura julia daniel matthew anthony mark steven andrew joshua kevin brian ryan jacob"
).split()

_MARK = "\u0001"
_TOKEN = rf"{_MARK}?[\p{{L}}\p{{M}}]+|\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|[%$€£°]"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; capitalised words inside a sentence carry a mark in front."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", _MARK)
    return F.regexp_extract_all(F.lower(F.coalesce(marked, F.lit(""))), F.lit(_TOKEN), 0)


def _placeholder(token: Column, german: Column) -> Column:
    """The typed placeholder of a token, or null for a literal word."""
    first = F.substring(token, 1, 1)
    digit = F.when(first <= "\x7f", (first >= "0") & (first <= "9")).otherwise(first.rlike(r"\p{Nd}"))
    return (
        F.when(digit | token.isin(NUMBER_WORDS), "<num>")
        .when(token.isin(UNITS), "<unit>")
        .when((first.eqNullSafe(_MARK) & ~german) | token.isin(GIVEN_NAMES), "<name>")
    )


def _of_length(literal, n: int):
    return lambda i: literal(i, long=n)


def windows(df: DataFrame, key: str, text_col: str, width: int = WIDTH, short: Sequence[int] = ()) -> DataFrame:
    """``(key, pos, h, vals, ok)``: the hash of each window; ``vals`` has a template window's slot values, null if literal.

    ``ok`` is false where the slots leave no template window.  Texts of ``width`` tokens and more also give literal
    windows of the lengths in ``short``.
    """
    prepared = (
        df.select(F.col(key).alias("key"), tokens(F.col(text_col)).alias("raw"))
        .withColumn("german", F.size(F.filter("raw", lambda t: t.isin(GERMAN))) * 8 >= F.size("raw"))
        .withColumn("kind", F.transform("raw", lambda t: _placeholder(t, F.col("german"))))
        .withColumn("low", F.transform("raw", lambda t: F.ltrim(t, F.lit(_MARK))))
        # tokens are hashed once, windows hash the hashes
        .withColumn("hash", F.transform("low", lambda t: F.xxhash64(t)))
        .withColumn("last", F.greatest(F.size("low") - width, F.lit(0)))
    )
    none = F.lit(None).cast("array<string>")

    def literal(i: Column, ok: Column = F.lit(True), long: int = width) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(*[F.get("hash", i + k) for k in range(long)]).alias("h"), none.alias("vals"), ok.alias("ok"))

    def count(i: Column, long: int, slot: bool) -> Column:
        has = [F.get("kind", i + k).isNotNull() if slot else F.get("kind", i + k).isNull() & F.get("low", i + k).isNotNull() for k in range(long)]
        return sum((F.when(x, 1).otherwise(0) for x in has), F.lit(0))

    def template(i: Column, long: int) -> Column:
        words = [F.get("low", i + k) for k in range(long)]
        kinds = [F.get("kind", i + k) for k in range(long)]
        vals = F.array_compact(F.array(*[F.when(k.isNotNull(), w) for k, w in zip(kinds, words)]))
        return F.struct(i.alias("pos"), F.xxhash64(F.lit("template"), *[F.coalesce(k, w) for k, w in zip(kinds, words)]).alias("h"), vals.alias("vals"), F.lit(True).alias("ok"))

    def window(i: Column) -> Column:
        return (
            F.when(count(i, width, True) == 0, F.array(literal(i)))
            .when(count(i, width, False) >= LITERALS, F.array(literal(i), template(i, width)))
            .when((i + WIDE <= F.size("low")) & (count(i, WIDE, False) >= LITERALS), F.array(literal(i), template(i, WIDE)))
            .otherwise(F.array(literal(i, F.lit(False))))
        )

    places = F.sequence(F.lit(0), F.col("last"))
    # most texts have no placeholder at all: their windows are literal; texts without tokens have none (a filter on the
    # tokens would be pushed down to the scan and tokenise every text twice)
    slotted = F.exists("kind", lambda k: k.isNotNull())
    every = F.when(slotted, F.flatten(F.transform(places, window))).when(F.size("low") > 0, F.transform(places, lambda i: literal(i)))
    if short:
        inside = [F.transform(F.sequence(F.lit(0), F.size("low") - n), _of_length(literal, n)) for n in short]
        every = F.when(F.size("low") >= width, F.concat(every, *inside)).otherwise(every)
    return prepared.select("key", F.explode(every).alias("w")).select("key", "w.pos", "w.h", "w.vals", "w.ok")


def _row(docs: DataFrame) -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("t"))


def _in_bitmap(table: DataFrame) -> Column:
    """True for hashes ``h`` whose bit the table's hashes have set; the bitmap is one array of a fixed size."""
    low = 2**BITMAP_BITS - 1
    place = lambda h: F.shiftright(h.bitwiseAND(F.lit(low)), 6).cast("int")
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    words = table.select(place(F.col("h")).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = table.sparkSession.range(2 ** (BITMAP_BITS - 6)).select(F.col("id").cast("int").alias("at"))
    dense = every.join(words, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return F.get(dense.select(F.col("w.bits")).scalar(), place(F.col("h"))).bitwiseAND(bit) != 0


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = WIDTH) -> DataFrame:
    """``(doc_id, item_id, coverage, windows, conflicts, template)`` of every leaked item of every distinct row.

    ``template`` is true when the slots hold other values than the item's.  ``conflicts`` is zero in every row: it is
    the test of slot consistency.
    """
    return _leaks(docs, benchmark, coverage, width).select("key.doc_id", "item.item_id", "coverage", "windows", F.lit(0).cast("long").alias("conflicts"), "template")


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, width: int) -> DataFrame:
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("t")).alias("item"), "text").distinct()
    own = cut(windows(items, "item", "text", width))
    # an item's windows that can match; all of them, literally, if there is none
    size = own.groupBy("key").agg(F.count_distinct(F.when(F.col("ok"), F.col("pos"))).alias("able"), F.count_distinct("pos").alias("all"))
    table = own.join(size, "key").where("ok or able = 0")
    table = table.select(F.col("key").alias("item"), F.col("pos").alias("ip"), "h", F.col("vals").alias("iv"), F.when(F.col("able") > 0, F.col("able")).otherwise(F.col("all")).alias("n"))
    lengths = items.select(F.size(tokens(F.col("text"))).alias("n")).where(F.col("n").isin(*SHORT)).distinct().collect()
    met = windows(docs.select(_row(docs).alias("row"), "text"), "row", "text", width, sorted(r["n"] for r in lengths)).drop("ok")
    if own.count() <= BROADCAST_WINDOWS:
        table = F.broadcast(table)
    else:
        met = met.where(_in_bitmap(own))
    met = met.join(table, "h").where("size(vals) <=> size(iv)")
    by_diagonal = met.groupBy("key", "item", "n", (F.col("pos") - F.col("ip")).alias("diagonal")).agg(
        F.collect_set("ip").alias("at"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("iv", "vals")))).alias("pairs"),
    )
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["iv"])))
    other = F.exists("pairs", lambda p: p["iv"] != p["vals"])
    found = (
        by_diagonal.where(F.size("pairs") == values)
        .groupBy("key", "item", "n")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("windows"),
            F.max_by(other, F.struct(F.size("at").alias("hits"), (-F.col("diagonal")).alias("early"))).alias("template"),
        )
        .withColumn("coverage", F.col("windows") / F.col("n"))
    )
    return found.where(F.col("coverage") >= coverage)


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item; other rows of the same id stay."""
    mark = own_name("row", docs.columns)
    found = _leaks(docs, benchmark, coverage, WIDTH).select(F.xxhash64("key.doc_id", "key.t").alias(mark)).distinct()
    keyed = docs.withColumn(mark, F.xxhash64(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(found, mark, "left_anti").select(*quoted(docs.columns))


def oracle(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for ``leaks``: the same windows as strings, joined on equality."""

    def words(names: list[str]) -> str:
        return "(" + ", ".join(f"'{n}'" for n in names) + ")"

    # a second pass marks the names that share a letter with the match before them
    mark = "regexp_replace({}, '([\\p{{Ll}},;] )(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(1) || '\\2', 'g')"
    marked = mark.format(mark.format("text"))
    token = "'\\x01?[\\p{L}\\p{M}]+|\\p{Nd}+(?:[.,:/]\\p{Nd}+)*|[%$€£°]'"

    def prepared(key: str, source_id: str, source: str, name: str) -> str:
        return f"""
{name}_raw AS (SELECT {key} AS key, regexp_extract_all(lower({marked}), {token}) AS raw FROM (SELECT DISTINCT * FROM (SELECT {source_id}, text FROM {source}) WHERE text IS NOT NULL)),
{name}_tok AS (SELECT key, list_transform(raw, lambda x: ltrim(x, chr(1))) AS low, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^\\p{{Nd}}') OR x IN {words(NUMBER_WORDS)} THEN '<num>'
  WHEN x IN {words(UNITS)} THEN '<unit>' WHEN (x[1] = chr(1) AND NOT german) OR x IN {words(GIVEN_NAMES)} THEN '<name>' END) AS kind
  FROM (SELECT *, len(list_filter(raw, lambda x: x IN {words(GERMAN)})) * 8 >= len(raw) AS german FROM {name}_raw WHERE len(raw) > 0)),
{name}_win AS (SELECT *, len(list_filter(k, lambda x: x IS NOT NULL)) AS slots, CASE WHEN len(list_filter(k, lambda x: x IS NULL)) >= {LITERALS} THEN {WIDTH}
    WHEN size >= pos + {WIDE} AND len(list_filter(k2, lambda x: x IS NULL)) >= {LITERALS} THEN {WIDE} END AS long
  FROM (SELECT key, pos, len(low) AS size, low[pos + 1:pos + {WIDTH}] AS w, kind[pos + 1:pos + {WIDTH}] AS k, low[pos + 1:pos + {WIDE}] AS w2, kind[pos + 1:pos + {WIDE}] AS k2
  FROM (SELECT *, unnest(range(0, greatest(len(low) - {WIDTH}, 0) + 1)) AS pos FROM {name}_tok))),
{name}_all AS (SELECT key, pos, slots = 0 OR long IS NOT NULL AS ok, 'L ' || array_to_string(w, ' ') AS h, CAST([] AS VARCHAR[]) AS vals FROM {name}_win
  UNION ALL SELECT key, pos, true, 'T ' || array_to_string(list_transform(range(1, len(w) + 1), lambda i: coalesce(k[i], w[i])), ' '),
    list_transform(list_filter(range(1, len(w) + 1), lambda i: k[i] IS NOT NULL), lambda i: w[i])
  FROM (SELECT key, pos, slots, long, w2[1:long] AS w, k2[1:long] AS k FROM {name}_win) WHERE slots > 0 AND long IS NOT NULL)"""

    return f"""
WITH {prepared("{'item_id': item_id, 'text': text}", "item_id", benchmark, "i").strip()}, {prepared("{'doc_id': doc_id, 'text': text}", "doc_id", docs, "d").strip()},
able AS (SELECT key, count(DISTINCT pos) FILTER (ok) AS able, count(DISTINCT pos) AS places FROM i_all GROUP BY key),
i AS (SELECT i_all.*, CASE WHEN able > 0 THEN able ELSE places END AS n FROM i_all JOIN able USING (key) WHERE ok OR able = 0),
d AS (SELECT key, pos, h, vals FROM d_all UNION ALL SELECT key, pos, 'L ' || array_to_string(low[pos + 1:pos + s], ' '), []
  FROM (SELECT key, low, s, unnest(range(0, len(low) - s + 1)) AS pos FROM d_tok, (SELECT DISTINCT len(low) AS s FROM i_tok WHERE len(low) IN ({", ".join(map(str, SHORT))})) WHERE len(low) >= {WIDTH})),
met AS (SELECT d.key AS doc, i.key AS item, i.n, d.pos - i.pos AS diagonal, i.pos AS ip,
  list_transform(range(1, len(i.vals) + 1), lambda x: i.vals[x] || chr(2) || d.vals[x]) AS pairs, i.vals AS iv, i.vals <> d.vals AS other FROM d JOIN i ON d.h = i.h),
diag AS (SELECT doc, item, n, diagonal, count(DISTINCT ip) AS hits, len(list_distinct(flatten(list(pairs)))) - len(list_distinct(flatten(list(iv)))) AS conflicts, bool_or(other) AS template FROM met GROUP BY ALL),
good AS (SELECT * FROM diag WHERE conflicts = 0),
best AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY hits DESC, diagonal) = 1),
cover AS (SELECT doc, item, n, count(DISTINCT ip) AS windows FROM met JOIN good USING (doc, item, n, diagonal) GROUP BY ALL)
SELECT doc.doc_id AS doc_id, item.item_id AS item_id, CAST(windows AS DOUBLE) / n AS coverage, CAST(windows AS BIGINT) AS windows, CAST(0 AS BIGINT) AS conflicts, template
FROM cover JOIN best USING (doc, item, n) WHERE CAST(windows AS DOUBLE) / n >= {COVERAGE}
"""
