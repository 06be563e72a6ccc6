"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. These seeds induce lexical
patterns: the words before, and around, each of them. Identifier-like tokens that no base pattern took are the unknown
instances. Patterns and instances form a graph: a pattern's confidence for a kind is its share of that kind's
instances, an unknown instance's score for a kind comes from the confidences of its patterns; both are computed in turn.
Unknown instances that confident patterns vouch for become spans too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheaf.llm.common import q, release, settle, without

KINDS = ("email", "ip", "card", "phone")
#: Leftmost non-overlapping matches of the base patterns. Possessive forms match the same and keep no stack; the
#: lookbehinds only skip starts within a run of characters whose own start has failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a valid match of a kind.
HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Signs of an address within an identifier-like token; others hold seven digits and more.
ADDRESS = r"@|[(\[{]at[)\]}]"

SETTLED = 1e-3  # change of the sum of all scores, as a share of it, from which on rounds end
SUPPORT = 5  # seeds that a confident pattern has at least
CONFIDENT = 0.8


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[^\x20\x09-\x0D]++"


def _last_words(gap: Column) -> Column:
    """The last two words of a text, joined by one space."""
    none = F.array(F.lit(""), F.lit(""))
    parts = F.filter(F.slice(F.concat(none, F.split(gap, rf"{SPACE}++")), -3, 3), lambda w: w != "")
    return F.concat_ws(" ", F.slice(F.concat(none, parts), -2, 2))


def _spans(kind: str, matches: Column, gaps: Column) -> Column:
    """Valid matches with their places (code points) and what stands before and after: array of structs."""
    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>>").alias("got"))

    def step(acc: Column, i: Column) -> Column:
        m = F.get(matches, i)
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(m)
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("text"),
            _last_words(F.get(gaps, i)).alias("before"), F.regexp_extract(F.get(gaps, i + 1), rf"^{SPACE}*+({TOKEN})", 1).alias("after"),
        )
        return F.struct(end.alias("at"), F.when(_valid(kind, m), F.concat(acc["got"], F.array(span))).otherwise(acc["got"]).alias("got"))

    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), whole, step)["got"]


def base_spans(df: DataFrame, col: str) -> DataFrame:
    """df with __base: the base spans of col in order of start and kind, each with its context."""
    text = F.coalesce(F.col(q(col)), F.lit(""))
    df = df.withColumn("__text", text)
    df = df.withColumns({f"__m_{k}": F.when(HINTS[k](F.col("__text")), F.regexp_extract_all("__text", F.lit(BASE[k]), F.lit(0))) for k in KINDS})
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__text", BASE[k], -1)) for k in KINDS})
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>>")
    found = {f"__s_{k}": F.when(F.size(f"__m_{k}") > 0, _spans(k, F.col(f"__m_{k}"), F.col(f"__g_{k}"))).otherwise(empty) for k in KINDS}
    df = df.withColumns(found).drop(*(f"__{x}_{k}" for x in "mg" for k in KINDS))
    return df.withColumn("__base", F.array_sort(F.concat(*(F.col(f"__s_{k}") for k in KINDS)))).drop(*found)


def unknown_tokens(df: DataFrame) -> DataFrame:
    """df with __unknown: identifier-like tokens that touch no base span, with places and context."""
    spaces = r"[\x20\x09-\x0D]++"
    like = F.col("__text").rlike(rf"(?i){ADDRESS}") | F.col("__text").rlike(r"[0-9](?:[^\x20\x09-\x0D0-9]*[0-9]){6}")
    df = df.withColumn("__tokens", F.when(like, F.regexp_extract_all("__text", F.lit(TOKEN), F.lit(0))))
    df = df.withColumn("__gaps", F.when(F.size("__tokens") > 0, F.split("__text", TOKEN, -1)))
    # where tokens are: only the identifier-like ones are gathered
    tokens, gaps = F.col("__tokens"), F.col("__gaps")
    kind = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("got"))

    def step(acc: Column, i: Column) -> Column:
        t = F.get(tokens, i)
        at = acc["at"] + F.length(F.get(gaps, i))
        core = F.regexp_replace(t, r"^[(\[{<\"']+|[)\]}>\"'.,;:!?]+$", "")
        lead = F.length(F.regexp_extract(t, r"^[(\[{<\"']*", 0))
        good = t.rlike(rf"(?i){ADDRESS}") | (F.length(_digits(t)) >= 7)
        near = lambda j: F.coalesce(F.get(tokens, j), F.lit(""))
        got = F.struct(
            (at + lead).alias("start"), (at + lead + F.length(core)).alias("end"), core.alias("text"),
            F.concat_ws(" ", near(i - 2), near(i - 1)).alias("before"), near(i + 1).alias("after"),
        )
        more = F.when(good & (F.length(core) > 0), F.concat(acc["got"], F.array(got))).otherwise(acc["got"])
        return F.struct((at + F.length(t)).alias("at"), more.alias("got"))

    found = F.when(F.size(tokens) > 0, F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step)["got"]).otherwise(F.array().cast(kind))
    df = df.withColumn("__all", found).drop("__tokens", "__gaps")
    free = F.filter("__all", lambda u: ~F.exists("__base", lambda b: (b["start"] < u["end"]) & (u["start"] < b["end"])))
    return df.withColumn("__unknown", free).drop("__all")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: the two words before it, and the words around it, in lower case with
    digits levelled."""
    level = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    two = level(F.regexp_extract(before, rf"({word}{space}+{word}){space}*$", 1))
    one = level(F.regexp_extract(before, rf"({word}){space}*$", 1))
    next_ = level(F.regexp_extract(after, rf"^{space}*({word})", 1))
    found = F.array(F.when(two != "", F.concat(F.lit("before: "), two)), F.when((one != "") & (next_ != ""), F.concat_ws(" ", F.lit("around:"), one, next_)))
    return F.filter(found, lambda p: p.isNotNull())


def _edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind): each occurrence with its patterns; kind is null for unknown instances."""
    seen = found.select(F.explode("__base").alias("s")).select("s.text", "s.before", "s.after", "s.kind")
    new = found.select(F.explode("__unknown").alias("s")).select("s.text", "s.before", "s.after", F.lit(None).cast("string").alias("kind"))
    rows = seen.union(new)
    return rows.select(F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"), F.lower("text").alias("instance"), "kind").distinct()


def confident_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the graph, for patterns with seeds enough. Scores and confidences only grow from
    round to round, and are shares, so they settle."""
    edges = settle(_edges(found))
    # a pattern matters only if it has seeds; those that are few or mixed can't become confident
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    known = settle(seeds.where(F.col("seeds") >= SUPPORT).join(sizes, "pattern"))
    unknown = settle(edges.where(F.col("kind").isNull()).drop("kind").join(known.select("pattern", F.col("kind")), "pattern"))
    scores, total = None, -1.0
    while True:
        if scores is None:
            confidence = known.withColumn("confidence", F.col("seeds") / (F.col("size") + 1))
        else:
            vouched = unknown.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            all_ = known.join(vouched, ["pattern", "kind"], "left")
            confidence = all_.withColumn("confidence", (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("size") + 1)).drop("more")
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
        before, last = scores, total
        seen = Observation()
        new = unknown.join(confidence, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        scores = settle(new.observe(seen, F.coalesce(F.sum("score"), F.lit(0.0)).alias("total")))
        total = seen.get["total"]
        if total - last <= SETTLED * total:
            break
        if before is not None:
            release(before)
    return confidence.where(F.col("confidence") >= CONFIDENT).select("pattern", "kind", "confidence")


SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def find_personal(df: DataFrame, col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with base_spans and spans, arrays of (start, rank, end, kind): places in code points, end exclusive, by start
    and kind. spans holds the base ones and those that the method adds.

    Null and empty texts have no span. Rows are independent but for what patterns learn from all of them; repeated
    rows get equal spans, and an instance seen in one context many times counts once. An empty table gives an empty one.
    Columns of df with one of the new names, in any case, are replaced. Without keep_text, col is left out.
    """
    keep = [c for c in without(df, ["base_spans", "spans"]) if keep_text or c != col]
    own = [f"__keep{i}" for i in range(len(keep))]  # no name of the caller's meets one of ours
    base = unknown_tokens(base_spans(df.select(*(F.col(q(c)).alias(o) for c, o in zip(keep, own, strict=True)), F.col(q(col)).alias("__whole")), "__whole"))
    found = settle(base.select(*own, "__base", "__unknown", F.monotonically_increasing_id().alias("__row")))
    patterns = settle(confident_patterns(found))
    place = F.col("u")
    rows = found.where(F.size("__unknown") > 0).select("__row", F.explode("__unknown").alias("u"))
    keyed = rows.withColumn("pattern", F.explode(_patterns(place["before"], place["after"])))
    hits = keyed.join(patterns, "pattern").groupBy("__row", place["start"].alias("start"), place["end"].alias("end")).agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    added = hits.select("__row", F.struct("start", rank.alias("rank"), "end", "kind").cast(SPAN).alias("s")).groupBy("__row").agg(F.collect_list("s").alias("__added"))
    plain = F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    both = found.join(added, "__row", "left")
    spans = F.array_sort(F.concat(plain, F.coalesce("__added", F.array().cast(f"array<{SPAN}>"))))
    return both.select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), plain.alias("base_spans"), spans.alias("spans"))


def shown(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(col: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in square brackets; spans that overlap become one, the first's kind."""
    text = F.col(q(col))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
