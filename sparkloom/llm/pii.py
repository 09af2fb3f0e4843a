"""Personal data: base patterns and bootstrapped contextual extraction, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Kinds in order, and for each a pattern that finds the base pattern's matches in one pass without backtracking over long
#: runs: a local part or number begins where a run begins or the last match ended (\G), for the rest of a run fails as the
#: run does; a card is a whole chain of digits and single separators, of which other lengths fail anyway.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What each text must hold to be searched at all.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be an identifier of some kind: a run with a digit or @, and groups of digits that go on after a blank.
CANDIDATE = r"(?<![^\s,;:=#])[^\s,;:=#0-9@]*+[0-9@][^\s,;:=#]*+(?:\x20[0-9()-]++(?![^\s,;:=#]))*+"

#: A word of a context with the marks that end it, so that "ip=" is one whatever follows; code points of a word of a pattern
#: at most, and of the text beside a value that holds its words.
TOKEN, LONGEST = r"[^\s,;:=#]+[,;:=#]*", 40
REACH = 2 * LONGEST + 2


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)
    worth = lambda i: (F.substring(d, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2))))
    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i) - F.when(worth(i) > 9, 9).otherwise(0)), F.lit(10)) == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    return {"email": F.lit(True), "card": n.between(16, 19) & _luhn(v), "phone": n.between(8, 15)}[kind]


def _could_be(kind: str, v: Column) -> Column:
    """Whether a candidate has the shape of an unseen identifier of the kind."""
    n = F.length(_digits(v))
    return {
        "email": v.rlike(r"^[^@\s]+@[^@\s]+[A-Za-z0-9]$"),
        "ip": v.rlike(r"^[0-9A-Fa-f]{1,4}(?:\.[0-9A-Fa-f]{1,4}){3,7}$"),
        "card": n.between(12, 19) & v.rlike(r"^[0-9](?:[\x20.-]?[0-9])+$"),
        "phone": n.between(7, 15) & v.rlike(r"^[(+]{0,2}[0-9][\x20().0-9-]*[0-9]$"),
    }[kind]


def _located(df: DataFrame, regex: str, hint: Column | None, out: str) -> DataFrame:
    """df (with _text) with `out`: array of start, end, value, before, after of all matches; before and after: the REACH code
    points beside the match, or fewer where another match is nearer.

    Places are sums of the lengths of matches and of what lies between them, in blocks of about sqrt(matches), so a text of
    very many matches isn't summed over and over.
    """
    m, g, n, b, pre = (f"_{x}_{out}" for x in "mgnbp")
    found = F.regexp_extract_all("_text", F.lit(regex), F.lit(0))
    df = df.withColumn(m, F.when(hint, found) if hint is not None else found)
    some = F.coalesce(F.size(m) > 0, F.lit(False))
    df = df.withColumn(g, F.when(some, F.split("_text", regex, -1)))
    df = df.withColumn(n, F.zip_with(F.transform(m, lambda v: F.length(v).cast("bigint")), F.transform(F.slice(g, F.lit(1), F.size(m)), lambda v: F.length(v).cast("bigint")), lambda a, c: F.struct(c.alias("gap"), (a + c).alias("both"))))
    df = df.withColumn(b, F.ceil(F.sqrt(F.size(m))).cast("int"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["both"])
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(m) / F.col(b)).cast("int") - 1), lambda k: total(F.slice(n, k * F.col(b) + 1, F.col(b))))
    df = df.withColumn(pre, F.when(some, blocks))
    add = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def span(v: Column, i: Column) -> Column:
        k = F.floor(i / F.col(b)).cast("int")
        at = add(F.slice(pre, F.lit(1), k)) + total(F.slice(n, k * F.col(b) + 1, i - k * F.col(b))) + F.get(n, i)["gap"]
        return F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"), F.right(F.get(g, i), F.lit(REACH)).alias("before"), F.left(F.get(g, i + 1), F.lit(REACH)).alias("after"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")
    return df.withColumn(out, F.when(some, F.transform(m, span)).otherwise(empty)).drop(m, g, n, b, pre)


def _plain(c: Column) -> Column:
    """Lower case, digits as 0: what patterns are compared in."""
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a value: "LL " and the two words before it, "L " and the one, "R " and the word after it."""
    left = F.regexp_extract_all(_plain(before), F.lit(TOKEN), F.lit(0))
    right = F.regexp_extract(_plain(after), rf"^[\s,;:=#]*({TOKEN})", 1)
    one, two = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2)
    fits = lambda w: F.length(w).between(1, LONGEST)
    found = F.array(F.when(fits(one) & fits(two), F.concat(F.lit("LL "), two, F.lit(" "), one)), F.when(fits(one), F.concat(F.lit("L "), one)), F.when(fits(right), F.concat(F.lit("R "), right)))
    return F.filter(found, lambda x: x.isNotNull())


def _of_kind(located: Column, k: int, test) -> Column:
    """The located matches that pass the test for kind k, as spans of that kind."""
    kept = F.filter(located, lambda s: test(list(KINDS)[k], s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _patterns(s["before"], s["after"]).alias("patterns")))


def _count(spans_: Column, k: int) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == k)).cast("long")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _base and _maybe: base spans, and candidates that touch none of them, each kind, start, end, value and
    patterns (of the words beside it)."""
    df = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    parts = []
    for k, (kind, regex) in enumerate(KINDS.items()):
        df = _located(df, regex, F.contains("_text", F.lit(_HINT[kind])) if _HINT[kind] else None, f"_k{k}")
        parts.append(_of_kind(F.col(f"_k{k}"), k, _valid))
    df = df.withColumn("_base", F.concat(*parts)).drop(*[f"_k{k}" for k in range(len(KINDS))])
    df = _located(df, CANDIDATE, None, "_c")
    free = F.filter("_c", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.withColumn("_free", F.when(F.size("_c") > 0, free).otherwise(F.col("_c")))
    shaped = [_of_kind(F.col("_free"), k, _could_be) for k in range(len(KINDS))]
    return df.withColumn("_maybe", F.concat(*shaped)).drop("_text", "_c", "_free")


def _pattern_counts(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often the words of each pattern stand in all texts, whatever stands beside them."""
    words = F.regexp_extract_all(_plain(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))
    singles = docs.select(words.alias("w")).select(F.explode("w").alias("w"), F.lit(None).cast("string").alias("p"))
    pairs = docs.select(words.alias("w")).select(F.explode(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("w"), F.get("w", i).alias("p")))).alias("s")).select("s.w", "s.p")
    asked = cut(patterns.select("pattern").distinct().select("pattern", F.substring_index("pattern", " ", 1).alias("side"), F.expr("substring(pattern, instr(pattern, ' ') + 1)").alias("words")))
    met = lambda words, ask: words.join(ask.select("words", "pattern"), "words").groupBy("pattern").agg(F.count("*").alias("total"))  # noqa: E731  words that nobody asks for go no further
    counted = singles.groupBy(F.col("w").alias("words")).agg(F.count("*").alias("total"))  # a common word would be joined as often as it stands
    one = counted.join(asked.where("side <> 'LL'").select("words", "pattern"), "words").select("pattern", "total")
    return one.unionByName(met(pairs.select(F.concat("p", F.lit(" "), "w").alias("words")), asked.where("side = 'LL'")))


def bootstrap(found: DataFrame, docs: DataFrame, text: str = "text", support: int = 3, least: float = 0.8) -> DataFrame | None:
    """kind, value of unseen identifiers: those that high-confidence patterns of known ones discover; None if there is none.

    Seeds are the values of base spans. A pattern is a word after a value, or one or two words before it, by kind. In each
    round patterns are induced anew from what is known by then: seeds, and candidates accepted in earlier rounds, but for those
    that the pattern itself brought in. `support` different known values must hold a pattern, and its confidence is their
    number of occurrences over all occurrences of its words in the corpus; so candidates that aren't accepted
    count against it. A candidate's score joins the best pattern before it (two words, or one where two aren't induced) and
    the best after it, 1 - (1 - a)(1 - b); it is accepted at `least`, once and for all, by those patterns. What is accepted
    only grows, so rounds go on until one accepts nothing: as many as the longest chain of patterns has links. Patterns
    and values meet in joins and sums; no group is gathered.
    """
    flat = lambda c, seed: found.select(F.explode(c).alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"), F.lit(seed).alias("seed"))
    graph = cut(flat("_base", 1).unionByName(flat("_maybe", 0)).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    live = graph.groupBy("kind", "pattern").agg(F.count("*").alias("values"), F.sum("n").alias("held"), F.min("seed").alias("all_seeds")).where((F.col("values") >= support) & (F.col("all_seeds") == 0))
    live = cut(live.select("kind", "pattern", "held"))  # patterns that could be induced and have something to find
    if not live.limit(1).count():
        return None
    totals = live.join(_pattern_counts(docs, text, live), "pattern", "left").select("kind", "pattern", F.greatest(F.coalesce("total", F.lit(0)), F.col("held")).alias("total"))
    totals = cut(totals)
    graph = cut(graph.join(live.select("kind", "pattern"), ["kind", "pattern"]))
    seeds = graph.groupBy("kind", "value").agg(F.max("seed").alias("seed")).where("seed = 1")
    known = seeds.select("kind", "value", F.array().cast("array<string>").alias("via"))
    accepted = None
    while True:
        held = graph.join(known, ["kind", "value"]).where(~F.array_contains("via", F.col("pattern")))
        induced = held.groupBy("kind", "pattern").agg(F.sum("n").alias("hits"), F.count("*").alias("known")).where(F.col("known") >= support)
        sure = induced.join(totals, ["kind", "pattern"]).select("kind", "pattern", (F.col("hits") / F.col("total")).alias("sure"))
        best = lambda side: F.max(F.when(F.substring_index("pattern", " ", 1) == side, F.struct("sure", "pattern")))
        open_ = graph.where("seed = 0").join(known.select("kind", "value"), ["kind", "value"], "left_anti")
        each = open_.join(sure, ["kind", "pattern"]).groupBy("kind", "value").agg(F.coalesce(best("LL"), best("L")).alias("before"), best("R").alias("after"))
        miss = lambda side: 1 - F.coalesce(F.col(f"{side}.sure"), F.lit(0.0))
        via = F.filter(F.array("before.pattern", "after.pattern"), lambda p: p.isNotNull())
        new = cut(each.where(1 - miss("before") * miss("after") >= least).select("kind", "value", via.alias("via")))
        if not new.limit(1).count():
            return accepted
        accepted = new.select("kind", "value") if accepted is None else accepted.unionByName(new.select("kind", "value"))
        known = cut(known.unionByName(new))


def added_spans(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame | None:
    """_id, _hash, _added: the spans that the method adds to rows of that id and text hash, if any."""
    new = bootstrap(found, docs, text)
    if new is None:
        return None
    rows = found.select("_id", "_hash", F.explode("_maybe").alias("s")).select("_id", "_hash", "s.kind", "s.start", "s.end", "s.value")
    hit = rows.join(new, ["kind", "value"]).select("_id", "_hash", F.struct("kind", "start", "end").alias("s")).distinct()
    return cut(hit.groupBy("_id", "_hash").agg(F.collect_list("s").alias("_added")))  # a text's spans are bounded by the text


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumn("_id", F.col(f"`{doc_id}`").cast("string")).withColumn("_hash", F.xxhash64(F.col(f"`{text}`").cast("string")))


def _with_added(df: DataFrame, added: DataFrame | None) -> DataFrame:
    """df (with _id, _hash, _base) with _spans: base and added ones, by kind, then start."""
    base = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if added is None:
        return df.withColumn("_spans", F.array_sort(base))
    more = added.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.transform("_added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("_more"))
    joined = df.join(more, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    return joined.withColumn("_spans", F.array_sort(F.array_distinct(F.concat(base, F.coalesce("_more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))))).drop("_i", "_h", "_more")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans of each whole text: arrays of kind, start, end, value (spans: without value), in the order of
    kind and start.

    A null text is empty. Rows of one doc_id (a null one too) and text have the same spans and are repeated; an empty table
    gives none; other columns are left out.
    """
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = cut(find(_keyed(picked, "doc_id", "text")).drop("text"))
    return _with_added(found, added_spans(found, picked)).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and lists of `spans`; n_spans counts base and added ones."""
    of = [_count(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    plain = F.array_sort(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", *of, F.sha2(_listed(plain), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _reach(spans_: Column) -> Column:
    """For each span the greatest end of all spans before it, 0 if there is none; in blocks of about sqrt(spans), as in
    _located. The blocks' greatest ends are bound by a lambda: as a column they would be formed again for each span."""
    ends = F.transform(spans_, lambda s: s["end"])
    b = F.greatest(F.ceil(F.sqrt(F.size(spans_))).cast("int"), F.lit(1))
    tops = lambda e: F.transform(F.sequence(F.lit(0), F.ceil(F.size(e) / b).cast("int") - 1), lambda k: F.array_max(F.slice(e, k * b + 1, b)))

    def before(e: Column, top: Column, i: Column) -> Column:
        k = F.floor(i / b).cast("int")
        return F.greatest(F.lit(0).cast("bigint"), F.array_max(F.slice(top, F.lit(1), k)), F.array_max(F.slice(e, k * b + 1, i - k * b)))

    bound = F.transform(F.array(ends), lambda e: F.struct(e.alias("e"), tops(e).alias("top")))
    return F.when(F.size(spans_) > 0, F.get(F.transform(bound, lambda x: F.transform(x["e"], lambda _, i: before(x["e"], x["top"], i))), F.lit(0)))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; all columns stay, `chars` (if there) is set to
    the new length where the text changed. Overlapping spans are replaced as one, by the kind of the first. A null text
    stays null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name of docs clashes
    given = F.col("_row")[text].cast("string")
    keyed = rows.select("_row", F.col("_row")[doc_id].cast("string").alias("_id"), F.xxhash64(given).alias("_hash"))
    own = keyed.select("_id", "_hash", given.alias("_own")).where("_own IS NOT NULL")
    narrow = cut(find(own, "_own").drop("_own")).where("size(_base) > 0 OR size(_maybe) > 0")  # a filter before the cut would repeat the search
    new = added_spans(narrow, docs, text)
    whole = _with_added(narrow, new).select(F.col("_id").alias("_d"), F.col("_hash").alias("_t"), F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("_s"))
    one = cut(whole.where("size(_s) > 0").groupBy("_d", "_t").agg(F.min("_s").alias("_s")))
    joined = keyed.join(one, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    joined = joined.withColumn("_reach", _reach(F.col("_s")))
    piece = lambda s, i: F.when(s["start"] < F.coalesce(F.get("_reach", i), F.lit(0)), F.lit("")).otherwise(F.concat(F.substring(given, (F.coalesce(F.get("_reach", i), F.lit(0)) + 1).cast("int"), (s["start"] - F.coalesce(F.get("_reach", i), F.lit(0))).cast("int")), F.get(names, s["kind"])))
    last = F.coalesce(F.array_max(F.transform("_s", lambda s: s["end"])), F.lit(0))
    clean = F.concat(F.array_join(F.transform("_s", piece), ""), F.substring(given, (last + 1).cast("int"), F.length(given)))
    out = joined.withColumn("_clean", F.when(F.col("_s").isNotNull(), clean).otherwise(given))
    kept = lambda c: F.col("_row")[c].alias(c)
    return out.select(*[F.col("_clean").alias(c) if c == text else F.when(F.col("_s").isNotNull(), F.length("_clean").cast(t)).otherwise(F.col("_row")[c]).alias(c) if c == chars else kept(c) for c, t in docs.dtypes])
