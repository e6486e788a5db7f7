"""Secrets in texts: three fixed patterns, and a battery of randomness tests. DataFrame functions only.

Base kinds, each leftmost and non-overlapping by itself: `assign` (a key word, a separator, a value of 12 or more characters),
`access` (AKIA...) and `hex` (16 or more digits). Spans are code points, end exclusive, and cover the whole match.

The battery looks at every maximal run of 20 or more letters, digits and +/_- . Its alphabet is inferred (decimal, letters of one case, hexadecimal,
base32, letters of one case and digits, base64). The null hypothesis is ordinary writing; three statistics speak against it:

* chi-squared uniformity over the alphabet, as the number of coinciding pairs of symbols: writing has many, its letters
  being unevenly used;
* runs of a class of characters: upper (but for the capital of a word), digit, or lower and the signs that join words, which writing changes seldom; in letters of one case,
  vowels and consonants, which writing changes often;
* serial correlation of the class at lag one: high in writing, of vowels and consonants below 0, near 0 in random strings.

The last two look at one sequence and depend on each other, so their mean counts as one normal score; it is combined with the first
(Stouffer). Runs are grouped by length (powers of two). The scores of each group are counted over all texts, in tenths (at most 601 a
group), and the counts give what is needed: the score's centre and spread, by which it is standardised where they are above those of the
null hypothesis (the middle of the scores is taken for writing, so a corpus of other habits raises the bar), the p-value of the normal
tail, and by the Benjamini-Hochberg rule the least score that holds the share of false discoveries below `fdr`. A run that overlaps
a base span adds nothing; the others are spans of kind `random`.

Cases: null text counts as empty; texts without a match have no spans; any length, ties and repeated rows are treated alike;
an empty table has no thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run is taken whole or not at all, so the least length may stand in the pattern
HEX = "[0-9a-f]{16,}"
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 12
FDR = 1e-3
#: A capital that begins a word is of the class of the word.
CAPITAL = "[A-Z](?=[a-z]{2})"
#: Of writing: share of coinciding pairs, sum of cubed shares less its square; changes of class per place and serial correlation, of kinds of
#: characters, and of vowels and consonants.
WRITING = {"pairs": 0.065, "cubes": 0.0012, "changes": 0.2, "serial": 0.5, "vowel_changes": 0.62, "vowel_serial": -0.3}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, size of the group, match) of the pattern's leftmost non-overlapping matches."""
    empty = F.array().cast("array<struct<start:int,end:int,size:int,match:string>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.regexp_extract_all(text, F.lit(pattern), group).alias("v"), F.split(text, pattern, -1).alias("g"))

    def walk(x: Column) -> Column:
        # full lists of 256 are set aside, so that many matches cost no quadratic copying
        state = F.struct(F.lit(0).alias("pos"), empty.alias("own"), F.array().cast("array<array<struct<start:int,end:int,size:int,match:string>>>").alias("full"))

        def step(a: Column, i: Column) -> Column:
            start = a["pos"] + F.length(F.get(x["g"], i))
            end = start + F.length(F.get(x["m"], i))
            item = F.array(F.struct(start.alias("start"), end.alias("end"), F.length(F.get(x["v"], i)).alias("size"), F.get(x["m"], i).alias("match")))
            more = F.size(a["own"]) < 256
            return F.struct(end.alias("pos"), F.when(more, F.concat(a["own"], item)).otherwise(item).alias("own"), F.when(more, a["full"]).otherwise(F.concat(a["full"], F.array(a["own"]))).alias("full"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), state, step, lambda a: F.concat(F.flatten(a["full"]), a["own"]))

    return F.when(text.rlike(pattern), _let(found, walk)).otherwise(empty)


def _as_kind(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end), sorted."""
    parts = []
    for rank, (pattern, group) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0))):
        spans = located(text, pattern, group)
        if rank == 0:
            spans = F.filter(spans, lambda s: s["size"] >= MIN_VALUE)
        parts.append(_as_kind(spans, rank))
    return F.array_sort(F.concat(*parts))


def evidence(run: Column) -> Column:
    """Combined normal score of one run against writing."""
    words = run.rlike("^([a-z+/_-]+|[A-Z+/_-]+)$")  # letters of one case: their order is told by vowels

    def battery(c: Column) -> Column:
        n = F.size(c).cast("double")
        counts = F.transform(F.array_distinct(c), lambda s: F.size(F.filter(c, lambda y: y == s)).cast("double"))
        pairs = F.aggregate(counts, F.lit(0.0), lambda a, o: a + o * (o - 1) / 2)
        alphabet = (
            F.when(run.rlike("^[0-9]+$"), 10.0).when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(run.rlike("^([a-z]+|[A-Z]+)$"), 26.0).when(run.rlike("^[A-Z2-7]+$"), 32.0)
            .when(run.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36.0).otherwise(64.0)
        )
        # in a small alphabet even random symbols coincide often: writing must coincide more often than that
        share = F.greatest(F.lit(WRITING["pairs"]), 1.5 / alphabet)
        expected = n * (n - 1) / 2 * share
        chi = (expected - pairs) / F.sqrt(expected + n * n * n * WRITING["cubes"])
        kinds = F.when(words, F.transform(F.filter(c, lambda s: s.rlike("[A-Za-z]")), lambda s: F.when(s.rlike("[aeiouyAEIOUY]"), 1.0).otherwise(0.0))).otherwise(F.transform(F.regexp_extract_all(F.regexp_replace(run, CAPITAL, "a"), F.lit("."), 0), lambda s: F.when(s.between("A", "Z"), 1.0).when(s.between("0", "9"), 2.0).otherwise(0.0)))

        def order(k: Column) -> Column:
            m = F.size(k).cast("double")
            rest = F.greatest(F.lit(0), F.size(k) - 1)  # a run may hold no letter
            later, earlier = F.slice(k, F.lit(2), rest), F.slice(k, F.lit(1), rest)
            changes = F.aggregate(F.zip_with(earlier, later, lambda a, b: F.when(a == b, 0.0).otherwise(1.0)), F.lit(0.0), lambda a, b: a + b)
            spread = lambda rate: F.sqrt((m - 1) * rate * (1 - rate))
            rate, vowel_rate = WRITING["changes"], WRITING["vowel_changes"]
            runs = F.when(words, ((m - 1) * vowel_rate - changes) / spread(vowel_rate)).otherwise((changes - (m - 1) * rate) / spread(rate))
            mean = F.aggregate(k, F.lit(0.0), lambda a, b: a + b) / m

            def correlation(u: Column) -> Column:  # with the mean at hand; it would else be summed anew for each symbol
                square = F.aggregate(k, F.lit(0.0), lambda a, b: a + (b - u) * (b - u))
                lag = F.aggregate(F.zip_with(earlier, later, lambda a, b: (a - u) * (b - u)), F.lit(0.0), lambda a, b: a + b)
                return _let(square, lambda v: F.when(v > 0, lag / v).otherwise(F.when(words, -1.0).otherwise(1.0)))

            r = _let(mean, correlation)
            serial = F.when(words, r - WRITING["vowel_serial"]).otherwise(WRITING["serial"] - r) * F.sqrt(m)
            return F.when(m >= 8, (chi + (runs + serial) / 2) / F.sqrt(F.lit(2.0))).otherwise(F.lit(0.0))

        return _let(kinds, order)

    return _let(F.regexp_extract_all(run, F.lit("."), 0), battery)


def candidates(text: Column) -> Column:
    """Array of (start, end, stratum, tenths of the score) of all runs."""

    def grade(s: Column) -> Column:
        tenths = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(40.0), evidence(s["match"]))) * 10).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2(F.length(s["match"]).cast("double"))).cast("int").alias("stratum"), tenths.alias("tenths"))

    return F.transform(located(text, RUN), grade)


def least_score(counts: dict[int, int], fdr: float = FDR) -> int | None:
    """counts: of runs of one stratum, by tenths of their score. The least number of tenths that is a discovery, or None."""
    total, seen, middle = sum(counts.values()), 0, {}
    for tenths in sorted(counts):
        for share in (0.5, 0.84):
            if seen < share * total <= seen + counts[tenths]:
                middle[share] = tenths / 10
        seen += counts[tenths]
    centre, spread = max(0.0, middle[0.5]), max(1.0, middle[0.84] - middle[0.5])
    above, least = 0, None
    for tenths in sorted(counts, reverse=True):
        above += counts[tenths]
        z = max(0.0, (tenths / 10 - centre) / spread)
        if math.erfc(z / math.sqrt(2)) / 2 <= fdr * above / total:
            least = tenths
    return least


def thresholds(df: DataFrame, text_col: str, fdr: float = FDR) -> dict[int, int]:
    """For each stratum of length the least number of tenths that is a discovery; strata without one are left out."""
    runs = df.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c")).groupBy("c.stratum", "c.tenths").count()
    seen: dict[int, dict[int, int]] = {}
    for r in runs.collect():  # at most 601 rows a stratum, and a stratum for each power of two
        seen.setdefault(r["stratum"], {})[r["tenths"]] = r["count"]
    found = {stratum: least_score(counts, fdr) for stratum, counts in seen.items()}
    return {stratum: tenths for stratum, tenths in found.items() if tenths is not None}


def with_spans(df: DataFrame, text_col: str, least: dict[int, int]) -> DataFrame:
    """df and two columns: _base and _spans, arrays of (start, kind, end), sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_base", base_spans(text))
    if not least:
        return out.withColumn("_spans", F.col("_base"))
    bar = F.lit(None).cast("int")

    def found(c: Column) -> Column:
        need = bar
        for stratum, tenths in sorted(least.items()):
            need = F.when(c["stratum"] == stratum, F.lit(tenths)).otherwise(need)
        return F.coalesce(c["tenths"] >= need, F.lit(False))

    clear = lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.transform(F.filter(F.filter(candidates(text), found), clear), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return out.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), more)))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str, text_col: str, fdr: float = FDR) -> DataFrame:
    """One row for each row of df: id, n_assign, n_access, n_hex, base_sha256, spans (all, as text), n_random."""
    rows = with_spans(df.select(id_col, text_col), text_col, thresholds(df, text_col, fdr))
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        id_col,
        *(count(F.col("_base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.col("_spans")).alias("spans"),
        count(F.col("_spans"), 3).alias("n_random"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by the mark."""

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        part = F.concat(F.substr(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit(mark))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(a["parts"], F.array(part))).otherwise(a["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["pos"] + 1, F.length(text)))))
