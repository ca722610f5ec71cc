"""Personal data, and the terms that give it away.

Four kinds are found by pattern: e-mail and IP addresses, card numbers passing
Luhn's check, phone numbers. Each value found is a protected entity. A term that
stands in an entity's documents and nearly nowhere else tells the entity even
where its own characters are gone: with n(e, t) documents that hold both term t
and entity e, and n(t) documents that hold t at all, a reader of t is left with
H = -log2(n(e, t) / (n(t) + 1)) bits about e; the information that t discloses is
IC(e) - H, so the less is left, the more is told. The one document more is the
next one, which may hold t without e: a term seen once leaves a whole bit, and
only more documents make it less. Terms that leave at most GENERALISE_BITS become
a general word, and terms that leave at most REMOVE_BITS go, wherever they stand,
in documents without the entity too. Both counts cover the whole of all documents.

Everything is DataFrame expressions. The patterns are possessive and start only
where a match can, so a long run of characters costs no more than its length;
lists of matches are worked in chunks of the root of their length, so texts with
very many matches stay cheap. Stored tables hold places and hashes, no values.

Defined results: a null text is an empty one; rows repeated in the input are
each returned and count each; a null key is kept; ties don't arise, as spans
have an order and terms are judged each; texts are read whole, however long;
other columns stay as they are in `sanitise`, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .thinning import thinned

KINDS = ("email", "ip", "card", "phone")
#: The kind of the spans that the method adds.
TERM = "term"

# The contract's patterns, written so that matching never goes back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single separators between, of 14 digits at least.
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A term: a run of two letters or more.
TERM_PATTERN = r"\p{L}{2,}"
GENERALISE_BITS = 0.9
REMOVE_BITS = 0.25
#: Documents of a pair that can leave so little: below, n / (n + 1) leaves more than GENERALISE_BITS.
LEAST_TOGETHER = 2

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _in_chunks(items: Column, first: Column, after: Callable[[Column, Column], Column], body: Callable[[Column, Column], Column]) -> Column:
    """The list of `body(chunk, state before it)` over the chunks of a list.

    `after(chunk, state)` is the state behind a chunk. Chunks are as long as there
    are many, so what grows with a list's copies is bounded by its root.
    """

    def with_states(chunks: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("all"))
        step = lambda s, c: F.struct(after(c, s["now"]).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all"))
        return F.zip_with(chunks, F.aggregate(chunks, start, step, lambda s: s["all"]), body)

    def chunked(whole: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(whole))).cast("int"))
        number = F.ceil(F.size(whole) / width).cast("int")
        cut = F.transform(F.sequence(F.lit(1), number), lambda i: F.slice(whole, (i - 1) * width + 1, width))
        return F.when(F.size(whole) > 0, _let(cut, with_states))

    return _let(items, chunked)


def _positions(text: Column, pattern: str) -> Column:
    """start, end (code points) and value of all matches: what lies between them gives their places."""
    kind = "array<struct<start:int,end:int,value:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = _let(found, lambda m: F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("value"))))

    def after(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, at, lambda s, x: s + x["gap"] + x["n"])

    def placed(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + x["gap"]
            one = F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value")))
            return F.struct((begin + x["n"]).alias("at"), F.concat(s["out"], one).alias("out"))

        return F.aggregate(chunk, start, step, lambda s: s["out"])

    return F.coalesce(F.flatten(_in_chunks(pieces, F.lit(0), after, placed)), F.array().cast(kind))


def _without(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans replaced; `instead(span, at)` stands for one that begins when all before `at` is done.

    Of overlapping spans the first gives the word. Each chunk of spans works on its own part of the text.
    """

    def last(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, at, lambda s, x: F.greatest(s, x["end"]))

    def rewritten(chunk: Column, base: Column) -> Column:
        def on(part: Column) -> Column:
            start = F.struct(base.alias("at"), F.lit("").alias("out"))

            def step(s: Column, x: Column) -> Column:
                gap = F.substring(part, s["at"] - base + 1, F.greatest(F.lit(0), x["start"] - s["at"]))
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap, instead(x, s["at"])).alias("out"))

            return F.aggregate(chunk, start, step, lambda s: s["out"])

        return _let(F.substring(text, base + 1, last(chunk, base) - base), on)

    end = F.aggregate(spans, F.lit(0), lambda s, x: F.greatest(s, x["end"]))
    done = F.array_join(_in_chunks(spans, F.lit(0), last, rewritten), "")
    return F.when(F.size(spans) > 0, F.concat(done, F.substring(text, end + 1, F.length(text)))).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the doubled sum over the digits, from the last, is divisible by 10."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Without leading zeros a part of at most 255 has three digits at most.
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _spans_of(text: Column, kind: str, number: int) -> Column:
    valid = F.filter(_positions(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def _number_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, with their values, by start, then kind as in KINDS."""
    lists = []
    for i, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
        lists.append(F.when(hint, _spans_of(text, kind, i)).otherwise(F.array().cast(_FOUND)))
    return F.array_sort(F.concat(*lists))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks for its spans: nothing else moves."""
    return _without(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), x["end"] - F.greatest(at, x["start"]))))


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), lambda m: F.xxhash64(F.lower(m))))


def _places(text: Column, wanted: Column) -> Column:
    """The spans of the wanted terms (a map from hashes to kinds), each time they occur."""
    spans = F.transform(_positions(text, TERM_PATTERN), lambda x: F.struct(x["start"].alias("start"), F.try_element_at(wanted, F.xxhash64(F.lower(x["value"]))).alias("kind"), x["end"].alias("end")))
    return F.filter(spans, lambda x: x["kind"].isNotNull())


def _written(spans: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(spans: Column) -> Column:
    """Spans without their values."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc_key, h (a hash of the text), base (spans), entities and terms (hashes; of texts with spans, outside them); one text pass."""
    words = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_key"), F.xxhash64(F.col(text)).alias("h"), words.alias("words"))
    found = plain.withColumn("found", base_spans(F.col("words")))
    entities = F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    terms = F.when(F.size("found") > 0, _terms(_blanked(F.col("words"), F.col("found")))).otherwise(F.array().cast("array<long>"))
    return found.select("row", "doc_key", "h", _plain(F.col("found")).alias("base"), entities.alias("entities"), terms.alias("terms"))


def disclosing_terms(docs: DataFrame, facts: DataFrame, text: str = "text") -> DataFrame:
    """entity, term (hashes), bits: the pairs that leave at most GENERALISE_BITS, from counts over all documents."""
    entities = facts.where(F.size("entities") > 0).select("row", F.explode("entities").alias("entity"))
    # An entity of fewer documents has no pair that leaves so little.
    often = entities.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TOGETHER).select("entity")
    entities = scratch.store(entities.join(often, "entity"), "private-entities")
    together = entities.join(facts.where(F.size("terms") > 0).select("row", "terms"), "row").select("entity", F.explode("terms").alias("term"))
    together = together.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= LEAST_TOGETHER)
    together = scratch.store(together, "private-together")
    # Terms that are in no pair are put aside before they are dealt out, and the others counted before the join.
    terms = thinned(docs.select(F.explode(_terms(F.col(text))).alias("term")), together, "term")
    counts = terms.groupBy("term").agg(F.count("*").alias("n_term"))
    bits = -F.log2(F.col("n_both") / (F.greatest("n_term", "n_both") + 1))
    return together.join(counts, "term").select("entity", "term", bits.alias("bits")).where(F.col("bits") <= GENERALISE_BITS)


def _extra(docs: DataFrame, disclosing: DataFrame, key: str, text: str) -> DataFrame:
    """doc_key, h, extra: the spans of disclosing terms in all documents, outside of the base ones; kind 4 generalises, kind 5 removes."""
    kind = F.when(F.col("bits") <= REMOVE_BITS, F.lit(5)).otherwise(F.lit(4))
    telling = scratch.store(disclosing.groupBy("term").agg(F.max(kind).alias("kind")), "private-telling")
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("words"))
    terms = own.select("doc_key", "h", F.explode(_terms(F.col("words"))).alias("term"))
    hits = thinned(terms, telling, "term").join(telling, "term").groupBy("doc_key", "h").agg(F.collect_set(F.struct("term", "kind")).alias("wanted"))
    hits = scratch.store(hits, "private-hits").select(F.col("doc_key").alias("hit_key"), F.col("h").alias("hit_h"), F.map_from_entries("wanted").alias("wanted"))
    thin = thinned(own, hits.select(F.col("hit_h").alias("h")), "h")
    found = thin.join(hits, F.col("doc_key").eqNullSafe(F.col("hit_key")) & (F.col("h") == F.col("hit_h")))
    found = found.withColumn("base", base_spans(F.col("words"))).withColumn("rest", _blanked(F.col("words"), F.col("base")))
    places = found.select("doc_key", "h", _places(F.col("rest"), F.col("wanted")).alias("extra")).where(F.size("extra") > 0)
    # Rows with the same key and text have the same spans.
    return places.groupBy("doc_key", "h").agg(F.first("extra").alias("extra"))


def _all_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_key, h, base, extra of every document."""
    with scratch.temporary(docs.sparkSession):
        facts = scratch.store(_facts(docs, key, text), "private-facts", keep=True)
        extra = scratch.store(_extra(docs, disclosing_terms(docs, facts, text), key, text), "private-terms", keep=True)
    rows = facts.alias("f").join(extra.alias("e"), F.col("f.doc_key").eqNullSafe(F.col("e.doc_key")) & (F.col("f.h") == F.col("e.h")), "left")
    return rows.select("f.doc_key", "f.h", "base", F.coalesce("extra", F.array().cast(_SPAN)).alias("extra"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    all_rows = _all_spans(docs, key, text)
    names = (*KINDS, TERM, TERM)
    spans = F.array_sort(F.concat("base", "extra"))
    counts = [_number_of(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return all_rows.select(
        F.col("doc_key").alias(key),
        *counts,
        F.size("extra").cast("long").alias("n_term"),
        F.sha2(_written(F.col("base"), names), 256).alias("base_sha256"),
        _written(spans, names).alias("spans"),
    )


#: What stands for a span, by kind.
INSTEAD = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")


def _rewritten(text: Column, spans: Column, words: tuple[str, ...] = INSTEAD) -> Column:
    """The text with each span replaced by its kind's word."""
    instead = F.array(*map(F.lit, words))
    return _without(text, spans, lambda x, at: F.when(x["start"] >= at, F.element_at(instead, x["kind"] + 1)).otherwise(""))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, personal data and disclosing terms replaced in the text."""
    with scratch.temporary(docs.sparkSession):
        found = _all_spans(docs, key, text).where((F.size("base") > 0) | (F.size("extra") > 0))
        spans = found.select(F.col("doc_key").alias("span_key"), F.col("h").alias("span_h"), F.array_sort(F.concat("base", "extra")).alias("spans"))
        # Rows with the same key and text have the same spans.
        spans = scratch.store(spans.groupBy("span_key", "span_h").agg(F.first("spans").alias("spans")), "private-spans", keep=True)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("own_key"), F.xxhash64(F.col(text)).alias("own_h"))
    out = whole.join(spans, F.col("own_key").eqNullSafe(F.col("span_key")) & (F.col("own_h") == F.col("span_h")), "left")
    words = F.col("row").getField(text)
    clean = F.when(F.col("spans").isNull() | words.isNull(), words).otherwise(_rewritten(words, F.col("spans")))
    return out.select(*(clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
