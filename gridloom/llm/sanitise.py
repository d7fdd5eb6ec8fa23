"""Personal data and the terms that give it away.

Protected entities are e-mail addresses, IP addresses, card and phone numbers. The words of the
documents that hold an entity form its context. Over the corpus, the pointwise mutual information of an
entity and a context term, as a share of the entity's own information content, says how much of the
entity the term discloses: 1 if the term never occurs without it. Terms at or above
`REMOVE` are removed, those at or above `GENERALISE` replaced by a general name; both need
`SUPPORT` documents in which they stand together. A disclosing term goes wherever it stands, in documents
without the entity too; one that discloses several entities goes by the highest share.

All counts are by document and cover all documents. Co-occurrence is counted for the entities
of `SUPPORT` documents or more, as no other can reach it, and disclosing terms are placed in the documents that hold
one. Partial sums are taken before each shuffle, so a frequent term or entity sends one row a task.

A term is a whole run of letters of any length; a script without spaces gives its runs between marks.

Defined results: null text is empty and has no span. Words that overlap an entity's place are no terms there.
Rows equal in id and text count as so many documents, and get the same spans. Of entities that tie for a term the share is the same. Nulls and
columns of any other name pass through; an empty table gives an empty one. Very long texts and texts of very many matches are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, met, written
from .spans import TAGGED, apart, count_of, joined, last_end, none, places, replaced, running, tagged

KINDS = ("email", "ip", "card", "phone", "term", "removed_term")
#: Patterns (fixed values). `\G|(?<!...)` starts a match only where a run of the class starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])"

SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Up to this many disclosing terms (16 bytes each) may be broadcast.
BROADCAST_TERMS = 500_000


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled (less 9 if over 9); the sum ends in 0."""
    at = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    octet = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.expr("0") + q.try_cast("int") <= 255))
    ip = F.filter(places(text, IP), lambda x: F.forall(F.split(x["v"], r"\."), octet))
    card = F.filter(
        places(text, CARD),
        lambda x: let(_digits(x["v"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))),
    )
    phone = F.filter(places(text, PHONE), lambda x: F.length(_digits(x["v"])).between(10, 15))
    return F.sort_array(
        F.concat(
            tagged(F.when(text.contains("@"), places(text, EMAIL)).otherwise(none()), 0),
            tagged(F.when(text.contains("."), ip).otherwise(none()), 1),
            tagged(card, 2),
            tagged(F.when(text.contains("+"), phone).otherwise(none()), 3),
        )
    )


def _entity(x: Column) -> Column:
    """The entity of a span, however it is written."""
    return F.concat_ws(":", x["k"].cast("string"), F.when(x["k"] == 0, F.lower(x["v"])).when(x["k"] == 1, x["v"]).otherwise(_digits(x["v"])))


def outside(text: Column, spans: Column) -> Column:
    """text without its spans (sorted by start). A mark keeps words that touch or overlap a span from being read as whole."""

    def mark(i: Column) -> Column:
        return F.when((i > 0) & F.substring(text, i, F.lit(1)).rlike(r"[\p{L}\p{N}_]"), "0").otherwise(" ")

    def step(p: Column, i: Column):
        x = F.get(spans, i)
        gap = F.concat(mark(p), F.substring(text, p + 1, x["s"] - p), mark(x["s"] + 1))
        return F.greatest(p, x["e"]), F.when(x["s"] >= p, gap).otherwise(" ")

    end = last_end(spans)
    return F.concat(F.array_join(running(F.size(spans), F.lit(0), step, "string"), " "), mark(end), F.substring(text, end + 1, F.length(text)))


def words(text: Column) -> Column:
    """The terms of text as they are written, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _term(w: Column) -> Column:
    """The term of a word, however it is written."""
    return F.xxhash64(F.lower(w))


def context(text: Column, spans: Column) -> Column:
    """The terms of a text that lie in no base span; none where there is no span."""
    return F.when(F.size(spans) == 0, none("bigint")).otherwise(F.array_distinct(F.transform(words(outside(text, spans)), _term)))


def document_frequency(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, df): in how many of all documents each wanted term stands."""
    terms = F.array_distinct(F.transform(words(F.coalesce(F.col("text"), F.lit(""))), _term))
    counts = docs.select(F.explode(terms).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(wanted, "t")  # wanted is distinct; a semi join would be pushed below the aggregation


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(c, t, ratio) of the terms that disclose at least GENERALISE of an entity."""
    n = found.count()
    held = found.where(F.size("base") > 0).select(
        F.explode(F.array_distinct(F.transform("base", lambda x: F.xxhash64(_entity(x))))).alias("c"),
        "ctx",
    )
    entities = written(held.groupBy("c").agg(F.count(F.lit(1)).alias("c_df")).where(F.col("c_df") >= SUPPORT), "pii-entities")
    # an entity may stand in a third of all documents, each with its whole context
    both = met(held, entities.select("c"), "c").select("c", F.explode("ctx").alias("t"))
    both = written(both.groupBy("c", "t").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT), "pii-pairs")
    terms = written(document_frequency(docs, both.select("t").distinct()), "pii-frequencies")
    joint = met(met(both, entities, "c"), terms, "t")
    pmi = F.log(F.lit(float(n)) * F.col("both") / (F.col("c_df").cast("double") * F.greatest(F.col("df"), F.col("both"))))
    own = F.log(F.lit(float(n)) / F.col("c_df"))
    return joint.select("c", "t", F.when(own > 0, pmi / own).otherwise(F.lit(0.0)).alias("ratio")).where(F.col("ratio") >= GENERALISE)


def term_spans(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """(__k, terms): the places of the terms of bad (t, ratio) in each text of rows (__k, text) that has any, sorted."""
    few = bad.count() <= BROADCAST_TERMS
    removed = F.collect_set(F.when(F.col("ratio") >= REMOVE, F.col("w"))).alias("removed")
    held = rows.select("__k", *(["text"] if few else []), F.explode(words(F.col("text"))).alias("w")).withColumn("t", _term(F.col("w")))
    if few:  # the words meet bad where they are read, and only texts that hold one are shuffled
        some = held.join(F.broadcast(bad), "t").groupBy("__k").agg(F.collect_set("w").alias("ws"), removed, F.first("text").alias("text"))
    else:
        some = held.join(bad, "t").groupBy("__k").agg(F.collect_set("w").alias("ws"), removed)
        some = rows.join(some, "__k").dropDuplicates(["__k"])
    # whole words of letters alone, so the pattern needs no quoting and no order
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join("ws", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    kind = lambda x: F.when(F.array_contains("removed", x["v"]), F.lit(5)).otherwise(F.lit(4))
    at = F.transform(
        places(F.col("text"), pattern),
        lambda x: F.struct(x["s"].alias("s"), kind(x).alias("k"), x["e"].alias("e"), F.lit("").alias("v")),
    )
    return some.select("__k", at.alias("terms"))


def _row(t: Column) -> Column:
    """A key of 128 bits for rows of equal id and text."""
    return F.struct(F.xxhash64("doc_id", t).alias("a"), F.xxhash64(t, "doc_id", F.lit("b")).alias("b"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, terms) for each row of docs: base spans and disclosing terms, sorted, as (s, k, e, v)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        _row(t).alias("key"),
        let(t, lambda x: let(base_spans(x), lambda b: F.struct(b.alias("base"), context(x, b).alias("ctx")))).alias("f"),
    )
    found = written(found.select("doc_id", "key", "f.base", "f.ctx"), "pii")
    bad = written(disclosures(docs.select("text"), found).groupBy("t").agg(F.max("ratio").alias("ratio")), "pii-terms")
    terms = term_spans(docs.select(_row(t).alias("__k"), t.alias("text")), bad)
    out = found.join(terms, found["key"] == F.col("__k"), "left")
    terms = F.when(F.col("terms").isNull(), none(TAGGED)).otherwise(apart(F.col("terms"), F.col("base")))
    return out.select("doc_id", "key", "base", terms.alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms in `text` replaced by the names of their kinds, or removed."""
    key, spans = fresh(docs, "key_of_row", "spans_of_row")
    found = scan(docs.select("doc_id", "text")).select(
        F.col("key").alias(key),
        F.sort_array(F.concat("base", "terms")).alias(spans),
    ).where(F.size(spans) > 0).dropDuplicates([key])
    names = F.array(*[F.lit("" if k == "removed_term" else f"[{k}]") for k in KINDS])
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, _row(t)).join(found, key, "left")
    return rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(replaced(t, F.col(spans), names))).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(base, "terms")), KINDS).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
