"""Text, path and hash functions as Column builders: JVM-side, null in, null out unless said."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c: Column | str) -> Column:
    """Lower case, runs of other than a-z and 0-9 as "_", none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def safe_slug(c: Column | str, cap: int = 180) -> Column:
    return F.substring(F.btrim(F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, cap)


def options(c: Column | str) -> Column:
    """"A. x, B. y" as a map from letter to text."""
    at = lambda g: F.regexp_extract_all(_c(c), F.lit(r"([A-Z])\. *([^,]*)"), F.lit(g))
    return F.map_from_arrays(at(1), F.transform(at(2), lambda x: F.trim(x)))


def path_name(c: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(_c(c), r"\\", "/"), "/", -1)


def path_stem(c: Column | str) -> Column:
    return F.regexp_replace(path_name(c), r"(.)\.[^.]*$", "$1")


def path_suffix(c: Column | str) -> Column:
    return F.regexp_extract(path_name(c), r".(\.[^.]*)$", 1)


def path_part(c: Column | str, i: int) -> Column:
    """The i-th part (from 1; negative from the end); null beyond the ends."""
    return F.try_element_at(F.split(_c(c), "/"), F.lit(i))


def strip_trailing_digits(c: Column | str, typos: dict[str, str] | None = None) -> Column:
    out = F.regexp_replace(_c(c), "[0-9]+$", "")
    for a, b in (typos or {}).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def named_groups(c: Column | str, pattern: str, names: list[str]) -> Column:
    """A struct of a pattern's groups, in order; groups that don't match are empty."""
    return F.struct(*[F.regexp_extract(_c(c), pattern, i).alias(n) for i, n in enumerate(names, 1)])


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def prefixed(c: Column | str, role: str) -> Column:
    """The text as an asymmetric encoder takes it: "query: " or "passage: " before it."""
    return F.concat(F.lit(f"{role}: "), collapse(c))


def ellipsis(c: Column | str, limit: int) -> Column:
    """At most `limit` characters, cut texts ending in "..."."""
    return F.when(F.length(_c(c)) <= limit, _c(c)).otherwise(F.concat(F.rtrim(F.substring(_c(c), 1, limit - 3)), F.lit("...")))


def template(pattern: str, *cols: Column | str) -> Column:
    return F.format_string(pattern, *[_c(c) for c in cols])


def compact_json(*cols: Column | str) -> Column:
    """A struct as JSON, keys in order of name."""
    return F.to_json(F.struct(*sorted((_c(c) for c in cols), key=str)))


def json_get(c: Column | str, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(_c(c), path), F.lit(default))


def map_text(c: Column | str) -> Column:
    """A map as "k: v, ..." in the order of keys."""
    entries = F.array_sort(F.map_entries(_c(c)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def safe_int(c: Column | str, default: int | None = None) -> Column:
    """A whole number, or null (or the default) where there is none: both of the rules in use."""
    out = _c(c).try_cast("bigint")
    return out if default is None else F.coalesce(out, F.lit(default).cast("bigint"))


def safe_float(c: Column | str) -> Column:
    return _c(c).try_cast("double")


def hex_sha(*parts: Column | str, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *[_c(p).cast("string") for p in parts]), 256)


def hash_int(hexed: Column, digits: int = 15) -> Column:
    """The first hex digits as a number: 15 fit a long; 16 make a decimal."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint" if digits <= 15 else "decimal(20,0)")


def hash_unit(hexed: Column) -> Column:
    """A number from 0 to 1 from the first eight bytes."""
    return hash_int(hexed, 16).cast("double") / F.lit(18446744073709551615.0)


def hash_mod(hexed: Column, n: int) -> Column:
    """All 256 bits modulo n, digit by digit."""
    digit = lambda c: F.conv(c, 16, 10).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.length(hexed)), F.lit(0).cast("bigint"), lambda a, i: F.pmod(a * 16 + digit(F.substring(hexed, i, F.lit(1))), F.lit(n)))


def words(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit("[A-Za-z0-9']+"))


def repeated_ngrams(c: Column | str, n: int = 4) -> Column:
    """1 - distinct / all of a text's word n-grams; 0 where it has none. Lambdas bind words and n-grams: as plain columns they
    would be formed again for each n-gram."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    share = lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)
    of = lambda w: F.when(F.size(w) < n, F.lit(0.0)).otherwise(F.get(F.transform(F.array(grams(w)), share), F.lit(0)))
    return F.get(F.transform(F.array(words(c)), of), F.lit(0))


def affirmed(c: Column | str, concept: str, negation: str = "(no|not|without|never)") -> Column:
    """Whether any sentence holds the concept without a negation up to five words before or four after it."""
    before, after = rf"(?i)\b{negation}\b(\W+\w+){{0,5}}\W+({concept})", rf"(?i)({concept})(\W+\w+){{0,4}}\W+\b{negation}\b"
    return F.exists(F.split(_c(c), "[.;!?]"), lambda s: s.rlike(rf"(?i)({concept})") & ~s.rlike(before) & ~s.rlike(after))


def leaks(c: Column | str, tokens: list[str]) -> Column:
    return _c(c).rlike("(?i)" + "|".join(tokens))


def clean_caption(c: Column | str) -> Column:
    """Without code fences, a leading label and quotes, white space collapsed."""
    out = F.regexp_replace(_c(c), "```[a-z]*", "")
    out = F.regexp_replace(out, r"^\s*(?i:caption|description)\s*:\s*", "")
    return collapse(F.regexp_replace(out, '["`]', ""))


def choice_letter(c: Column | str) -> Column:
    """The first of A to D, else "?"."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(_c(c)), "[ABCD]", 0), F.lit("")), F.lit("?"))


def yes_no(c: Column | str) -> Column:
    t = F.lower(F.trim(_c(c)))
    return F.when(t.rlike("^(yes|y|true)"), "yes").when(t.rlike("^(no|n|false)"), "no").otherwise("?")


def json_in_text(c: Column | str, schema: str) -> Column:
    """The first to the last brace of a text, parsed leniently; null where that fails."""
    return F.from_json(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def front_matter_stripped(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(_c(c), F.lit("\r\n"), F.lit("\n")), r"(?s)^---\n.*?\n---\n", ""))


def norm(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


def first_rule(c: Column | str, rules: list[tuple[str, str]], default: str, how: str = "contains") -> Column:
    """The value of the first rule whose string the text contains, or starts with."""
    out, test = None, (lambda s: F.contains(_c(c), F.lit(s))) if how == "contains" else (lambda s: F.startswith(_c(c), F.lit(s)))
    for s, v in rules:
        out = F.when(test(s), v) if out is None else out.when(test(s), v)
    return F.lit(default) if out is None else out.otherwise(default)


def category_code(c: Column | str, values: list[str]) -> Column:
    """A value's place among the sorted values, -1 for a missing one."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in sorted(values)]), _c(c)), F.lit(0)) - 1, F.lit(-1)).cast("int")


def set_text(c: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(_c(c)), sep)


def chunk_paragraphs(c: Column | str, least: int = 40, most: int = 800) -> Column:
    """Paragraphs, those shorter than `least` merged into the next, those longer than `most` split: an array of texts.

    A fold over the paragraphs; merging needs the state of what is held, so no window does it.
    """
    paragraphs = F.filter(F.transform(F.split(_c(c), r"\n+"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(a: Column, p: Column) -> Column:
        whole = F.when(a["held"] == "", p).otherwise(F.concat(a["held"], F.lit(" "), p))
        short = F.length(whole) < least
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / most).cast("int")), lambda i: F.substring(whole, i * most + 1, F.lit(most)))
        return F.struct(F.when(short, a["done"]).otherwise(F.concat(a["done"], pieces)).alias("done"), F.when(short, whole).otherwise("").alias("held"))

    end = lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"])))
    return F.aggregate(paragraphs, start, step, end)


def slug_attributes(c: Column | str) -> Column:
    """place, weather, count of a slug: whether it names the inside, a weather word, and its last number (null if none)."""
    place = F.when(_c(c).rlike("(^|_)(indoor|inside|store)(_|$)"), "inside").otherwise("outside")
    weather = F.coalesce(F.nullif(F.regexp_extract(_c(c), "(rain|snow|fog|clear)", 1), F.lit("")), F.lit("unknown"))
    return F.struct(place.alias("place"), weather.alias("weather"), F.nullif(F.regexp_extract(_c(c), "([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("bigint").alias("count"))


def changed_facts(old: Column | str, new: Column | str) -> Column:
    """Runs of words that a revision replaced, with the new text's eight words around each and the changed run blanked.

    A diff of two token lists is a sequence alignment, which no built-in function makes.
    """

    @F.pandas_udf("array<struct<old:string,new:string,cloze:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_changes(x, y) for x, y in zip(a, b)], dtype=object)

    return diff(_c(old), _c(new))


def _changes(a: str | None, b: str | None) -> list[dict] | None:
    if a is None or b is None:
        return None
    x, y = a.split(), b.split()
    ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [{"old": " ".join(x[i:j]), "new": " ".join(y[k:m]), "cloze": " ".join([*y[max(0, k - 4) : k], "____", *y[m : m + 4]])} for op, i, j, k, m in ops if op == "replace"]
