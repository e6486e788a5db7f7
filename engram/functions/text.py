"""Text functions: classification markers, keywords, boilerplate, links, hashes and previews."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# In the order of the alphabet; each is looked for anywhere in the lower-cased text, also inside words.
NEGATIONS = tuple(sorted("not never failed missed stopped unable cannot can't didn't doesn't won't isn't aren't wasn't weren't shouldn't unreliable unsuccessful inadequate insufficient declined dropped decreased reduced lost".split() + ["no longer"]))
REVISIONS = tuple(sorted("previously updated changed now revised corrected reconsidered".split() + ["used to", "no longer think", "on second thought", "after further", "in retrospect"]))
ANTONYMS = tuple(sorted(
    [(w, f"un{w}") for w in ("available", "reliable", "safe", "stable")]
    + [(w, f"in{w}") for w in ("accurate", "complete", "consistent", "correct", "effective", "efficient", "sufficient", "valid")]
    + [(w, f"dis{w}") for w in ("agree", "approve")]
    + [("possible", "impossible"), ("success", "failure"), ("increase", "decrease"), ("improve", "worsen"), ("accept", "reject"), ("positive", "negative"), ("fast", "slow"), ("good", "bad"), ("high", "low"), ("strong", "weak"), ("easy", "difficult")]
))
STOP_WORDS = tuple(sorted(set(
    "her his its our them their these they this those you your she him who whom whose what which where when how if because just very too than same own only such some other most more few any all every each neither either both yet so nor or but and down up about under over off out between below above after before during through into as from by at with on for in of to can shall might may should could would will does did do had has have being been be were was are is the an a not that".split()
)))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (text.contains(w) for w in words))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numeric_disagreement(a: Column, b: Column) -> Column:
    """Both have tokens with digits, they share three tokens or more, and no token with a digit is in both. Texts are only split if both
    hold a digit, and once."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    numbers = lambda t: F.filter(t, lambda w: w.rlike("[0-9]"))
    differ = lambda p: (F.size(F.array_intersect(p["a"], p["b"])) >= 3) & ~F.arrays_overlap(numbers(p["a"]), numbers(p["b"]))
    return F.when(a.rlike("[0-9]") & b.rlike("[0-9]"), _let(F.struct(words(a).alias("a"), words(b).alias("b")), differ)).when(a.isNotNull() & b.isNotNull(), False)


def heuristic_classify(a: Column, b: Column) -> Column:
    """Struct (verdict: contradiction, revision or neutral; confidence)."""
    a, b = F.lower(a), F.lower(b)
    revision = sum((F.when(a.contains(w) | b.contains(w), 1).otherwise(0) for w in REVISIONS), F.lit(0)) * 0.3
    asymmetry = F.when(_any(a, NEGATIONS) != _any(b, NEGATIONS), 0.35).otherwise(0.0)
    antonyms = sum((F.when((a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x)), 1).otherwise(0) for x, y in ANTONYMS), F.lit(0)) * 0.25
    numbers = F.when(numeric_disagreement(a, b), 0.2).otherwise(0.0)
    score = F.least(F.lit(0.75), asymmetry + antonyms + numbers)
    verdict = F.when(revision > 0.2, "revision").when(F.round(score, 9) >= 0.35, "contradiction").otherwise("neutral")
    confidence = F.when(revision > 0.2, F.least(F.lit(0.75), revision * 0.75)).when(F.round(score, 9) >= 0.35, score).otherwise(0.0)
    return F.struct(verdict.alias("verdict"), confidence.alias("confidence"))


def keywords(text: Column) -> Column:
    """Lower-cased words of three bytes or more that are no stop words, in order, repeats kept."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w))


_PLACEHOLDER = r"(?i)^(tbd|todo|n/a|fixme|placeholder|coming soon|---)\.?$"
_TEMPLATE = r"^(\{\{.*\}\}|\[[^\]]*\]|<[^>]*>)$"


def strip_boilerplate(text: Column) -> Column:
    """Drop lines that only hold a place; the other lines stay as they were."""
    keep = lambda line: ~F.trim(line).rlike(_PLACEHOLDER) & ~F.trim(line).rlike(_TEMPLATE)
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def without_code(text: Column) -> Column:
    """The text without fenced blocks and code spans."""
    return F.regexp_replace(text, r"(?s)```.*?(```|$)|`[^`\n]*`", "")


def wiki_links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(without_code(text), F.lit(r"\[\[([^\]|#]+)"), 1), lambda x: F.trim(x))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(without_code(text), F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/-]*)"), 1))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


#: The spaces of Unicode (category Zs); trim() of DuckDB takes all of them off, that of Spark only the first.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def proposition_hash(text: Column) -> Column:
    return content_hash(F.trim(text))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    """The characters of the text that begin within its first n bytes."""
    # a string of the first bytes counts a character that they cut as one
    count = F.length(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) > n, F.substr(text, F.lit(1), count)).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def primary_entity(text: Column, names: Column) -> Column:
    """Of the names, lower-cased, that which occurs first in the text, whatever its case."""
    found = F.filter(F.transform(names, lambda n: F.struct(F.instr(F.lower(text), F.lower(n)).alias("at"), F.lower(n).alias("name"))), lambda s: s["at"] > 0)
    return F.array_min(found)["name"]


def synthetic_cue(entity: str, context: dict) -> str:
    return " ".join([entity, *(f"{k}: {context[k]}" for k in sorted(context))])


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for ignore patterns like those of .gitignore, without negation."""
    parts = [fnmatch.translate(p.strip().rstrip("/")) for p in patterns if p.strip() and not p.startswith("#")]
    return "|".join(re.sub(r"\\Z$|\\z$", "", p) for p in parts) or r"(?!)"
