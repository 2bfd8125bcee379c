"""Sentence ends by a model that is learned from a corpus, without labels.

Counting tokens with and without a full stop, by language, tells three kinds of types. Abbreviations
nearly always carry the stop, and are short, or hold stops inside: a log-likelihood ratio against
the chance of any stop, weighted by both and by the occurrences without one. Starters follow ends
more often than chance has it, and collocations go with the token before them. A stop ends a
sentence unless its token is an abbreviation, an initial or a number that the next token, by
starters, collocations and case, shows to go on.

Learning is aggregation over tokens: texts are read once and tokens counted as they stand, so
patterns meet only different ones. `sentence_counts` puts every type found to the texts, by joins.
`learn` makes a model that column expressions hold: of each kind it has only types that account for
a share of the stops of their language, so it is small whatever the corpus, and less than the whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.text import BLANK
from lexmill.session import stash

#: Scores from which on a type is an abbreviation, a starter, a collocation; share of stops it has to account for.
ABBREVIATION, STARTER, COLLOCATION, SHARE = 0.3, 30.0, 7.88, 1e-4
#: Chance of a stop after an abbreviation.
ALWAYS = 0.99
#: Marks around tokens, at ends of sentences, and those that types are without.
OPENING, CLOSING, TERMINAL, TRAILING = "\"'“‘«([", "\"'”’»)]", ".!?…", ".,;:!?…"
#: The end of tokens after which a sentence may end.
MARKED = r"[.!?…][\"'”’»)\]]*$"
#: In a text: such ends, with the end of the last token; tokens with a full stop, as group 1 together with the next one.
ENDS, PAIRS = r"(?U)[.!?…][\"'”’»)\]]*(?!\S)|\S(?=\s*\z)", r"(?U)(?<!\S)(?=(\S*\.[\"'”’»)\]]*\s+\S+))\S"
NUMBER = "#"


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BLANK), "")


def core(token: Column) -> Column:
    """A token without opening and closing marks."""
    return F.ltrim(F.rtrim(token, F.lit(CLOSING)), F.lit(OPENING))


def has_stop(bare: Column) -> Column:
    """Whether a token ends in one full stop, which may belong to it."""
    return F.endswith(bare, F.lit(".")) & (F.length(bare) > 1) & (F.length(F.rtrim(bare, F.lit(TERMINAL))) == F.length(bare) - 1)


def type_of(bare: Column) -> Column:
    """Lower case without the last stop and commas; numbers are one type."""
    low = F.lower(F.rtrim(bare, F.lit(TRAILING)))
    return F.when(low.rlike(r"^[0-9][0-9.,/-]*$"), NUMBER).otherwise(low)


def pairs(text: Column) -> Column:
    """Tokens that may have a stop, each as one string with the blanks and the token after it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PAIRS), 1)


def token_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, t, times): occurrences of each token, and of each of `pairs`, which are told by their blanks."""
    each = docs.select(F.col(lang).alias("lang"), F.explode(F.concat(tokens(F.col(text)), pairs(F.col(text)))).alias("t"))
    return each.groupBy("lang", "t").agg(F.count("*").alias("times"))


def typed(known: DataFrame) -> DataFrame:
    """Token counts with (type, stop, next, upper, lower): next is the type of the token after and null
    but for pairs; upper and lower tell the case that token begins in."""
    parts = known.withColumn("p", F.split("t", BLANK))
    bare = parts.withColumns({"bare": core(F.get("p", 0)), "after": core(F.get("p", 1))})
    next = F.when(F.col("after").isNotNull(), type_of(F.col("after"))).alias("next")
    cases = [F.col("after").rlike(rf"^\p{{{case}}}").alias(name) for case, name in (("Lu", "upper"), ("Ll", "lower"))]
    return bare.select("lang", "t", "times", type_of(F.col("bare")).alias("type"), has_stop(F.col("bare")).alias("stop"), next, *cases)


def rows_of(made: DataFrame) -> DataFrame:
    """What `type_rows` returns, of typed token counts. What has a next type is taken from occurrences without one."""
    own, less = F.struct("next", "times"), F.struct(F.lit(None).cast("string").alias("next"), (-F.col("times")).alias("times"))
    each = made.where("lang is not null and (next is null or stop)").select("lang", "type", "stop", F.inline(F.when(F.col("next").isNull(), F.array(own)).otherwise(F.array(own, less))))
    return each.groupBy("lang", "type", "stop", "next").agg(F.sum("times").alias("times")).where("times > 0")


def type_rows(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, type, stop, next, times): occurrences of each type with and without a stop; next is the
    type after a stop, null at the end of a text and where there is no stop. Texts without a language
    are left out."""
    return rows_of(typed(token_counts(docs.where(F.col(lang).isNotNull()), text, lang)))


def _ln(n: Column, p: Column) -> Column:
    """n * ln(p), 0 for no occurrences."""
    return F.when((n <= 0) | (p <= 0), 0.0).otherwise(n * F.ln(p))


def abbreviation_score(n: Column, stops: Column, total: Column, total_stops: Column, type: Column) -> Column:
    """How far a type with n occurrences, `stops` of them with a stop, is an abbreviation."""
    p, rest = total_stops / total, n - stops
    chance = _ln(stops, p) + _ln(rest, 1 - p)
    always = _ln(stops, F.lit(ALWAYS)) + _ln(rest, F.lit(1 - ALWAYS))
    letters = F.length(F.replace(type, F.lit("."), F.lit(""))).cast("double")
    inner = F.length(type) - letters + 1
    return -2 * (chance - always) * F.exp(-letters) * inner * F.pow(letters, -rest.cast("double"))


def together(first: Column, second: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events of which `both` occurrences coincide."""
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    apart = _ln(both, p) + _ln(first - both, 1 - p) + _ln(second - both, p) + _ln(total - first - second + both, 1 - p)
    own = _ln(both, p1) + _ln(first - both, 1 - p1) + _ln(second - both, p2) + _ln(total - first - second + both, 1 - p2)
    return -2 * (apart - own)


def type_counts(rows: DataFrame) -> DataFrame:
    """(lang, type, n, stops) and the sums of the language (total, total_stops)."""
    counts = rows.groupBy("lang", "type").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("stop"), F.col("times")).otherwise(0)).alias("stops"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("stops").alias("total_stops"))
    return counts.join(F.broadcast(sums), "lang")


def abbreviations(counts: DataFrame, least: float = ABBREVIATION, share: float = SHARE) -> DataFrame:
    """(lang, type, n, stops, score) of abbreviations: at most 1 / share a language, all with a share of 0."""
    scored = counts.where((F.col("stops") >= share * F.col("total_stops")) & (F.col("stops") > 1) & F.col("type").rlike(r"\p{L}"))
    scored = scored.withColumn("score", abbreviation_score(*map(F.col, ("n", "stops", "total", "total_stops", "type"))))
    return scored.where(F.col("score") >= least).select("lang", "type", "n", "stops", "score")


def starters(rows: DataFrame, counts: DataFrame, short: DataFrame, least: float = STARTER, share: float = SHARE) -> DataFrame:
    """(lang, type, after, score) of types that follow sentence ends more often than chance has it."""
    ends = rows.where(F.col("stop") & (F.length("type") > 1) & (F.col("type") != NUMBER)).join(short.select("lang", "type"), ["lang", "type"], "left_anti")
    after = ends.groupBy("lang", "next").agg(F.sum("times").alias("after"))
    breaks = after.groupBy("lang").agg(F.sum("after").alias("breaks"))
    often = after.join(F.broadcast(breaks), "lang").where(F.col("next").rlike(r"^\p{L}") & (F.col("after") >= share * F.col("breaks")))
    joined = often.withColumnRenamed("next", "type").join(counts, ["lang", "type"])
    scored = joined.withColumn("score", together(F.col("breaks"), F.col("n"), F.col("after"), F.col("total")))
    more = F.col("after") * F.col("total") > F.col("breaks") * F.col("n")
    return scored.where(more & (F.col("score") >= least)).select("lang", "type", "after", "score")


def collocations(rows: DataFrame, counts: DataFrame, short: DataFrame, least: float = COLLOCATION, share: float = SHARE) -> DataFrame:
    """(lang, type, next, both, score) of pairs that go together across a stop: of an abbreviation, an
    initial or a number with the type after it."""
    stops = rows.where("stop and next is not null and times > 1").select("lang", "type", "next", F.col("times").alias("both"))
    pairs = stops.where(F.length("type") == 1).union(stops.where(F.length("type") != 1).join(short.select("lang", "type"), ["lang", "type"], "left_semi"))
    following = counts.select("lang", F.col("type").alias("next"), F.col("n").alias("n_next"))
    joined = pairs.join(counts, ["lang", "type"]).join(following, ["lang", "next"])
    scored = joined.withColumn("score", together(F.col("n"), F.col("n_next"), F.col("both"), F.col("total")))
    more = (F.col("both") >= share * F.col("total_stops")) & (F.col("both") * F.col("total") > F.col("n") * F.col("n_next"))
    return scored.where(more & (F.col("score") >= least)).select("lang", "type", "next", "both", "score")


@dataclass
class Boundaries:
    """Types by language; a language that isn't known has none, and every stop but initials' ends."""

    abbreviations: dict[str, list[str]] = field(default_factory=dict)
    starters: dict[str, list[str]] = field(default_factory=dict)
    collocations: dict[str, list[str]] = field(default_factory=dict)

    def closes(self, token: Column, next: Column, lang: str) -> Column:
        """Whether a sentence ends at a token, before the next one or null. Tokens without a mark are
        told by one pattern."""
        known = lambda c, types: c.isin(*types) if types else F.lit(False)

        def told(bare: Column) -> Column:
            def plain(type: Column) -> Column:
                after = core(next)
                starts = F.coalesce(after.rlike(r"^\p{Lu}") & known(type_of(after), self.starters.get(lang)), after.isNull())
                pair = known(F.concat_ws(" ", type, type_of(after)), self.collocations.get(lang)) & after.isNotNull()
                short = known(type, self.abbreviations.get(lang)) | ((F.length(type) == 1) & type.rlike(r"^\p{L}$"))
                return F.when(short, starts & ~pair).when(type == NUMBER, ~pair & ~F.coalesce(after.rlike(r"^\p{Ll}"), F.lit(False))).otherwise(True)

            return F.when(has_stop(bare), F.transform(F.array(type_of(bare)), plain)[0]).otherwise(True)

        # Bound as variables, the bare token and its type are made once.
        return F.when(token.rlike(MARKED), F.transform(F.array(core(token)), told)[0]).otherwise(False)

    def ends(self, text: Column, lang: str) -> Column:
        """An array of structs (token, end): whether a sentence ends at each token."""

        def decided(ts: Column) -> Column:
            return F.transform(ts, lambda t, i: F.struct(t.alias("token"), self.closes(t, F.get(ts, i + 1), lang).alias("end")))

        return F.transform(F.array(tokens(text)), decided)[0]

    def count(self, text: Column, lang: str) -> Column:
        """Number of sentences; words after the last end are one more."""

        def counted(ts: Column) -> Column:
            return F.size(F.filter(ts, lambda t, i: (i == F.size(ts) - 1) | self.closes(t, F.get(ts, i + 1), lang)))

        return F.transform(F.array(tokens(text)), counted)[0].cast("long")

    def count_by(self, text: Column, lang: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(0).cast("long"))
        for known in sorted({*self.abbreviations, *self.starters, *self.collocations}):
            chain = chain.when(lang == known, self.count(text, known))
        return chain.otherwise(self.count(text, ""))

    def sentences(self, text: Column, lang: str) -> Column:
        """Sentences, with single blanks between their words."""
        marked = F.array_join(F.transform(self.ends(text, lang), lambda x: F.concat(x.token, F.when(x.end, "\u0001").otherwise(" "))), "")
        return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most_langs: int = 200, **shares: float) -> Boundaries:
    """The bounded model of a corpus, for column expressions; more than `most_langs` languages are refused, as the model holds lists for each."""
    if docs.select(lang).where(F.col(lang).isNotNull()).distinct().limit(most_langs + 1).count() > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    rows = stash(type_rows(docs, text, lang), "types")
    counts = stash(type_counts(rows), "counts")
    short = abbreviations(counts, **shares)
    model = Boundaries()
    for r in short.orderBy("lang", "type").collect():
        model.abbreviations.setdefault(r["lang"], []).append(r["type"])
    for r in starters(rows, counts, short, **shares).orderBy("lang", "type").collect():
        model.starters.setdefault(r["lang"], []).append(r["type"])
    for r in collocations(rows, counts, short, **shares).orderBy("lang", "type", "next").collect():
        model.collocations.setdefault(r["lang"], []).append(f"{r['type']} {r['next']}")
    return model


def going_on(made: DataFrame, short: DataFrame, begin: DataFrame, together: DataFrame) -> DataFrame:
    """(lang, t) of pairs in typed token counts at whose stop no sentence ends, by tables of abbreviations,
    starters and collocations."""
    stops = made.where("stop and next is not null").select("lang", "t", "type", "next", "upper", "lower")
    initial, number = F.col("type").rlike(r"^\p{L}$"), F.col("type") == NUMBER
    told = stops.where(initial | number).unionByName(stops.where(~initial & ~number).join(short.select("lang", "type"), ["lang", "type"], "left_semi"))
    told = told.join(begin.select("lang", F.col("type").alias("next"), F.lit(True).alias("starts")), ["lang", "next"], "left")
    told = told.join(together.select("lang", "type", "next", F.lit(True).alias("pair")), ["lang", "type", "next"], "left")
    starts, pair = F.col("upper") & F.coalesce("starts", F.lit(False)), F.coalesce("pair", F.lit(False))
    return told.where(F.when(number, pair | F.col("lower")).otherwise(~starts | pair)).select("lang", "t")


def sentence_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, n_sentences) of each row by the whole model of all rows, of any number of types and languages:
    ends of tokens, less the stops that go on. Decided once for each pair of tokens, they are joined to the
    pairs of the rows."""
    made = stash(typed(token_counts(docs, text, lang)), "tokens")
    rows = stash(rows_of(made), "types")
    counts = stash(type_counts(rows), "counts")
    short = stash(abbreviations(counts, share=0.0), "abbreviations")
    on = going_on(made, short, starters(rows, counts, short, share=0.0), collocations(rows, counts, short, share=0.0))
    ends = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENDS), 0)).cast("long")
    each = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(lang).alias("lang"), ends.alias("n"), pairs(F.col(text)).alias("pairs")), "ends")
    met = each.select("row", "lang", F.explode("pairs").alias("t")).alias("e").join(on.alias("o"), F.col("e.lang").eqNullSafe(F.col("o.lang")) & (F.col("e.t") == F.col("o.t")), "left_semi")
    less = met.groupBy("row").agg(F.count("*").alias("less"))
    return each.join(less, "row", "left").select(F.col("key").alias(key), (F.col("n") - F.coalesce("less", F.lit(0))).alias("n_sentences"))
