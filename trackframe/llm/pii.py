"""Personal data by fixed forms, and by contexts that are learned from them.

Seeds are what the fixed forms find (mail and network addresses, card and phone numbers, long hexadecimal keys).
The words around seeds are patterns; other identifier-like tokens that stand in the same patterns are unknown
instances. Pattern and instance scores are computed from each other in a few rounds of joins over the graph of
distinct (pattern, instance) pairs, and instances whose score is high are added as found.

Everything is column expressions. Possessive groups and look-behinds keep the expressions linear on long texts
and give the same leftmost matches as the plain forms in `FORMS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackframe.llm.texts import text_of
from trackframe.session import cut_lineage

# The order of kinds at one place, and their forms for java.util.regex.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KEY = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"  # seeds of the method alone
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"   # unknown identifiers hold a digit or an @
EDGES = r"^[^0-9A-Za-z@+]+|[^0-9A-Za-z]+$"
NEAR = 48          # characters on either side from which context words are taken
ROUNDS = 3
SEEDS = 3          # distinct seeds a pattern needs
SURE = 0.8         # score from which an unknown instance is added
PRIOR = 1.0        # unknown instances that every pattern is taken to have had

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    n = F.length(x)
    digit = lambda i: F.substr(x, n - i + 1, F.lit(1)).cast("int")  # noqa: E731  from the right, 1 first
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(
            "^(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, form: str, kind: str) -> Column:
    """All matches of a form as spans in code points. What lies between matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    placed = F.aggregate(
        F.zip_with(found, F.split(text, form, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"),
                (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("spans"))),
        lambda acc: acc["spans"])
    return F.when(text.rlike(form), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed form that pass its test."""
    def passing(kind):
        return F.filter(matches(text, FORMS[kind], kind), lambda s: _passes(kind, s["value"]))

    return {kind: passing(kind) for kind in FORMS}


def _ordered(spans: Column) -> Column:
    """By start, then kind in the order of the forms, then end."""
    place = lambda s: F.coalesce(F.array_position(F.lit([*FORMS, "key"]), s["kind"]), F.lit(9))
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(F.array_distinct(keyed))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, the text, and _id, _key that rows of equal id and text share."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return source.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("_id"), F.xxhash64("text").alias("_key"), "text")


def mentions(docs: DataFrame) -> DataFrame:
    """Seeds (with their kind) and unknown tokens of keyed docs, with up to three patterns: the two words before,
    the word before, and the words on both sides. Tokens that touch a seed are part of it."""
    base = docs.filter(F.col("text").rlike("[0-9@]")).select("_id", "_key", "text", *[
        v.alias(k) for k, v in base_spans(F.col("text")).items()], matches(F.col("text"), KEY, "key").alias("key"))
    base = base.withColumn("seeds", F.concat(*FORMS, "key")).drop(*FORMS, "key")
    trimmed = F.transform(matches(F.col("text"), TOKEN, "?"), lambda s: F.struct(
        F.lit("?").alias("kind"), (s["start"] + F.length(F.regexp_extract(s["value"], "^[^0-9A-Za-z@+]*", 0))).alias("start"),
        (s["end"] - F.length(F.regexp_extract(s["value"], "[^0-9A-Za-z]*$", 0))).alias("end"),
        F.regexp_replace(s["value"], EDGES, "").alias("value")))
    free = F.filter(trimmed, lambda t: (F.length(t["value"]) >= 6) & ~F.exists(
        "seeds", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    rows = base.select("_id", "_key", "text", F.explode(F.concat("seeds", free)).alias("s")).select("_id", "_key", "text", "s.*")
    before = F.lower(F.substr("text", F.greatest(F.col("start") - NEAR + 1, F.lit(1)), F.least(F.col("start"), F.lit(NEAR))))
    after = F.lower(F.substr("text", F.col("end") + 1, F.lit(NEAR)))
    words = lambda c: F.array_remove(F.split(c, r"[^\p{L}=:#]+"), "")
    rows = rows.select("_id", "_key", "kind", "start", "end", F.lower("value").alias("value"),
                       words(before).alias("_left"), words(after).alias("_right"))
    left, right = F.col("_left"), F.col("_right")
    patterns = F.array(
        F.when(F.size(left) >= 2, F.concat_ws(" ", F.slice(left, -2, 2))),
        F.when(F.size(left) >= 1, F.concat(F.lit("< "), F.try_element_at(left, F.lit(-1)))),
        F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat(
            F.try_element_at(left, F.lit(-1)), F.lit(" | "), F.try_element_at(right, F.lit(1)))))
    return rows.select("_id", "_key", "kind", "start", "end", "value",
                       F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))


def found_values(seen: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, sure: float = SURE) -> DataFrame:
    """kind, value and score of the unknown values that the pattern-instance graph is sure of."""
    pairs = cut_lineage(seen.select("kind", "value", F.explode("patterns").alias("pattern"))
                        .groupBy("pattern", "value").agg(F.max(F.when(F.col("kind") != "?", F.col("kind"))).alias("kind")))
    known = pairs.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    of_pattern = (known.groupBy("pattern").agg(F.sum("n").alias("seeds"), F.max_by("kind", F.struct("n", "kind")).alias("pattern_kind"),
                                               F.max("n").alias("agree")).filter((F.col("seeds") >= seeds) & (F.col("agree") == F.col("seeds"))))
    live = cut_lineage(pairs.join(of_pattern, "pattern").select(
        "pattern", "value", F.col("kind").isNotNull().alias("seed"), "pattern_kind"))
    scored = live.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("trust"))
        values = (live.join(patterns, "pattern").groupBy("value", "pattern_kind").agg(
            F.max("seed").alias("_seed"), F.sum(F.log1p(-F.least("trust", F.lit(0.999)))).alias("_doubt")))
        values = values.select("value", "pattern_kind", F.when(F.col("_seed"), 1.0).otherwise(
            F.round(1.0 - F.exp("_doubt"), 9)).alias("score"), "_seed")
        scored = cut_lineage(live.select("pattern", "value", "pattern_kind").join(values, ["value", "pattern_kind"]))
    new = scored.filter(~F.col("_seed") & (F.col("score") >= sure)).select("value", "pattern_kind", "score").distinct()
    return new.groupBy("value").agg(F.max_by("pattern_kind", F.struct("score", "pattern_kind")).alias("kind"), F.max("score").alias("score"))


def added_spans(docs: DataFrame) -> DataFrame:
    """_id, _key and the spans that the method adds to keyed docs: keys, and places of found values."""
    seen = cut_lineage(mentions(docs))
    new = found_values(seen)
    places = seen.filter("kind = '?'").drop("kind").join(new.select("value", "kind"), "value").unionByName(
        seen.filter("kind = 'key'"), allowMissingColumns=True)
    return places.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct(
        "kind", "start", "end", "value"))).alias("_added"))


def with_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _id, _key, text, a column of spans for each form, and `added`, the method's own.

    A null text counts as empty. Rows that repeat id and text are each kept.
    """
    source = keyed(docs, id_column, text)
    added = added_spans(source)
    base = source.select("doc_id", "_id", "_key", "text", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    return base.join(added, ["_id", "_key"], "left").withColumn(
        "added", F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))).drop("_added")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    Counts and base_sha256 are of the fixed forms; spans holds those and the added ones, as kind:start:end by
    start, kind, end. Null and empty texts have none. An empty table gives no rows.
    """
    source = keyed(docs, id_column, text)
    base = source.select("doc_id", "_id", "_key", *[v.alias(k) for k, v in base_spans(F.col("text")).items()]).select(
        "doc_id", "_id", "_key", *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS], F.concat(*FORMS).alias("_base"))
    added = added_spans(source)
    return base.join(added, ["_id", "_key"], "left").select(
        "doc_id", *[f"n_{k}" for k in FORMS], F.sha2(spelled(_ordered(F.col("_base"))), 256).alias("base_sha256"),
        spelled(_ordered(F.concat("_base", F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    end = F.aggregate(
        _ordered(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(F.struct(
                s["end"].alias("at"), F.concat(acc["parts"], F.array(
                    F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"))))
    whole = F.concat(F.array_join(end["parts"], ""), F.substr(text, end["at"] + 1))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
