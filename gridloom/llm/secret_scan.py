"""Secret scan: known forms, and a battery of randomness tests for the rest.

A candidate is a maximal run of 20 or more characters of the common encodings. Its encoding is inferred from
its characters; in that alphabet, three tests ask whether it looks like independent uniform draws:
chi-squared over the alphabet, runs about the alphabet's middle, and serial correlation at lag 1.
Fisher's rule combines their p-values; a token that fails is not random.

A discovery is a token that no ordinary one looks like. Ordinary tokens (long words, identifiers) change between lower case,
upper case and digits rarely: how improbable a token's number of changes is for its length is one p-value. The tokens
of the corpus that change no more than that are the null of the battery: of them, by encoding and length band, the share
that looks as random as the token or more is the other. Fisher's rule combines the two, and over all candidates of a length band the
Benjamini-Hochberg rule sets the limit. All of it comes from one histogram of bounded size, counted over all texts.

Defined results: null text is empty and has no span. Rows are judged one by one, repeated rows alike. An empty table gives an empty
one. Candidates of one bin tie, and pass or fail together. Very long texts and texts of very many matches are taken whole. Columns but the text pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, written
from .spans import count_of, joined, none, places, replaced, tagged, uncovered

#: Patterns and alphabets (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
KINDS = ("assign", "access", "hex", "random")

#: Share of false discoveries, least combined p-value of a random token, changes of class per character in ordinary tokens.
FDR, LEAST_P, ORDINARY = 0.01, 0.001, 0.1
BANDS = (20, 32, 48, 80)
#: Bins a decade and decades of the histogram: of the battery's p-value (down to LEAST_P) and of that of the changes.
RANDOM_BINS, PLAIN_BINS, DEEPEST = 8, 4, 40
#: A token whose changes are at least so probable is ordinary.
ORDINARY_FROM = 0.1


def base_spans(text: Column) -> Column:
    assign = F.filter(places(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 12)
    either = text.contains("=") | text.contains(":")
    return F.sort_array(
        F.concat(
            tagged(F.when(either, assign).otherwise(none()), 0),
            tagged(F.when(text.contains("AKIA"), places(text, ACCESS)).otherwise(none()), 1),
            tagged(places(text, HEX), 2),
        )
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic fit (within 0.0002), held off 0 and 1."""
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """Struct of encoding, p_random (of the three tests together) and p_plain (of the changes of class)."""
    kind = F.coalesce(*[F.when(token.rlike(rx), F.lit(k)) for k, (rx, _) in ALPHABETS.items()])
    alphabet = F.coalesce(*[F.when(token.rlike(rx), F.lit(a)) for rx, a in ALPHABETS.values()])
    folded = F.when(kind == "hex", F.lower(token)).otherwise(token)

    def tests(x: Column, k: Column) -> Column:
        n = F.size(x).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
        squares = total(F.transform(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0))))
        z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.sequence(F.lit(0), F.size(x) - 2)
        above = F.transform(x, lambda v: (v * 2 >= k).cast("int"))
        n1 = total(F.transform(x, lambda v: (v * 2 >= k).cast("double")))
        runs = let(above, lambda b: total(F.transform(pairs, lambda i: (F.get(b, i) != F.get(b, i + 1)).cast("double")))) + 1
        mu = 2 * n1 * (n - n1) / n + 1
        z_runs = F.when((n1 == 0) | (n1 == n) | (mu <= 2), -F.sqrt(n)).otherwise((runs - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1)))
        mean = total(F.transform(x, lambda v: v.cast("double"))) / n

        def serial(d: Column) -> Column:
            var = total(F.transform(d, lambda v: v * v))
            cov = total(F.transform(pairs, lambda i: F.get(d, i) * F.get(d, i + 1)))
            return F.when(var == 0, F.sqrt(n)).otherwise(cov / var * F.sqrt(n))

        z_serial = let(mean, lambda m: let(F.transform(x, lambda v: v - m), serial))
        ps = [_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial))]
        half = -(F.log(F.least(ps[0], F.lit(1.0))) + F.log(F.least(ps[1], F.lit(1.0))) + F.log(F.least(ps[2], F.lit(1.0))))
        return F.exp(-half) * (1 + half + half * half / 2)

    values = F.transform(F.split(folded, "(?!^)(?!$)"), lambda c: F.instr(alphabet, c) - 1)
    p_random = F.when(kind.isNull(), F.lit(0.0)).otherwise(let(values, lambda x: tests(x, F.length(alphabet).cast("double"))))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(classes) - F.length(F.regexp_replace(classes, r"(.)\1++", "$1"))
    n = F.length(token) - 1
    rate = F.greatest(F.least((n - changes) / n, F.lit(1 - 1e-9)), F.lit(1e-9))
    apart = rate * F.log(rate / ORDINARY) + (1 - rate) * F.log((1 - rate) / (1 - ORDINARY))
    p_plain = F.when(rate <= ORDINARY, F.lit(1.0)).otherwise(F.exp(-F.least(n * apart, F.lit(600.0))))
    return F.struct(kind.alias("encoding"), p_random.alias("p_random"), p_plain.alias("p_plain"))


def _band(token: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(BANDS):
        out = F.when(F.length(token) >= low, F.lit(i)).otherwise(out)
    return out


def _bins(tests: Column) -> tuple[Column, Column]:
    """The bins of a token's two p-values: parts of decades of their negative logarithms; the battery's last bin is below LEAST_P."""
    deep = lambda p, most, each: F.floor(F.least(-F.log10(F.greatest(p, F.lit(1e-300))), F.lit(float(most))) * each).cast("int")
    last = round(-math.log10(LEAST_P))
    random = F.when(
        tests["p_random"] >= LEAST_P,
        F.least(deep(tests["p_random"], last, RANDOM_BINS), F.lit(last * RANDOM_BINS - 1)),
    ).otherwise(last * RANDOM_BINS)
    return random, deep(tests["p_plain"], DEEPEST, PLAIN_BINS)


def _fisher(p: float, q: float) -> float:
    x = max(p * q, 1e-300)
    return x * (1 - math.log(x))


def tested(text: Column) -> Column:
    """The candidates of a text with their places, encoding (empty for none), length band and bins."""

    def judged(x: Column) -> Column:
        def bins(tests: Column) -> Column:
            random, plain = _bins(tests)
            encoding = F.coalesce(tests["encoding"], F.lit(""))
            names = {"encoding": encoding, "band": _band(x["v"]), "random": random, "plain": plain}
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), *[c.alias(n) for n, c in names.items()])

        return let(battery(x["v"]), bins)

    return F.transform(places(text, TOKEN), judged)


def limits(tokens: DataFrame) -> dict[tuple[str, int], list[int]]:
    """By encoding and length band, for each bin of the battery the least bin of the changes that is a discovery; from rows of one column, tested().

    The histogram on the driver has at most encodings x bands x 25 x 161 rows, for any input.
    """
    rows = tokens.select(F.explode(tokens.columns[0]).alias("x")).groupBy("x.encoding", "x.band", "x.random", "x.plain").count().collect()
    return accepted([tuple(r) for r in rows])


def accepted(rows: list[tuple[str, int, int, int, int]]) -> dict[tuple[str, int], list[int]]:
    """limits() from (encoding, band, random, plain, count)."""
    last = round(-math.log10(LEAST_P)) * RANDOM_BINS
    ordinary: dict[tuple[str | None, int | None], list[int]] = {}
    for encoding, band, random, plain, n in rows:
        if plain <= -math.log10(ORDINARY_FROM) * PLAIN_BINS:
            for k in ((encoding, band), (encoding, None), (None, None)):
                ordinary.setdefault(k, [0] * (last + 1))[random] += n
    as_random = {k: [(1 + sum(by[: r + 1])) / (1 + sum(by)) for r in range(last + 1)] for k, by in ordinary.items()}

    def p_of(k: tuple[str, int], random: int, plain: int) -> float:
        # without ordinary tokens of the encoding and band, those of the encoding, then all
        null = next((as_random[x] for x in (k, (k[0], None), (None, None)) if x in as_random), None)
        return _fisher(null[random] if null else 1.0, 10 ** (-plain / PLAIN_BINS))

    out: dict[tuple[str, int], list[int]] = {}
    for band in range(len(BANDS)):
        ps = sorted((1.0 if random == last else p_of((encoding, band), random, plain), n) for encoding, b, random, plain, n in rows if b == band)
        m, upto, limit = sum(n for _, n in ps), 0, -1.0
        for p, n in ps:
            upto += n
            if p <= FDR * upto / m:
                limit = p
        if limit < 0:
            continue
        for encoding in {e for e, b, *_ in rows if b == band and e}:
            out[encoding, band] = [
                next(
                    (q for q in range(DEEPEST * PLAIN_BINS + 1) if p_of((encoding, band), r, q) <= limit),
                    DEEPEST * PLAIN_BINS + 1,
                ) for r in range(last)
            ]
    return out


def all_spans(base: Column, tokens: Column, limit: dict[tuple[str, int], list[int]]) -> Column:
    """base_spans() and those of tested() within the limits that no base span covers, sorted."""

    def accept(x: Column) -> Column:
        need = F.lit(None).cast("array<int>")
        for (encoding, band), by_random in limit.items():
            need = F.when((x["encoding"] == encoding) & (x["band"] == band), F.array(*map(F.lit, by_random))).otherwise(need)
        return F.coalesce(x["plain"] >= F.get(need, x["random"]), F.lit(False))

    found = tagged(F.filter(tokens, accept if limit else lambda x: F.lit(False)), 3)
    return let(
        base,
        lambda own: let(found, lambda extra: F.when(F.size(extra) == 0, own).otherwise(F.sort_array(F.concat(own, uncovered(extra, own))))),
    )


def secrets_of(docs: DataFrame, text: str = "text") -> Column:
    """Expression of the spans of docs' texts, by limits over all of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return all_spans(base_spans(t), tested(t), limits(docs.select(tested(t).alias("tokens"))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`, an array of (s, k, e, v): start, index into KINDS, end and value."""
    return docs.withColumn(fresh(docs, "secrets")[0], secrets_of(docs, text))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """scan() without the text: that is read once, and what it holds is written before the limits are known."""
    base, tokens, secrets = fresh(docs, "base", "tokens", "secrets")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.withColumns({base: base_spans(t), tokens: tested(t)}).drop(text), "secrets")
    return rows.withColumn(secrets, all_spans(F.col(base), F.col(tokens), limits(rows.select(tokens)))).drop(base, tokens)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret in its text replaced by the kind's name."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(
        text,
        let(secrets_of(docs, text), lambda x: F.when(F.size(x) == 0, F.col(text)).otherwise(replaced(t, x, names))),
    )


def op2(docs: DataFrame) -> DataFrame:
    spans = F.col("secrets")
    return found(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.filter(spans, lambda x: x["k"] < 3), KINDS), 256).alias("base_sha256"),
        joined(spans, KINDS).alias("spans"),
    )
