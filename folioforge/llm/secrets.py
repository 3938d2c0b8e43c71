"""Secrets in texts: fixed patterns, and tokens that a character Markov model of random strings explains better than one of identifiers.

DataFrame functions only. The JVM scans a text for each pattern; what is kept of it is its matches, whose places come from sums in
a logarithm of passes, so the cost of a very long text grows with its length and no square. Null and empty texts give no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order in which spans that start together are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: What the model judges: runs of these characters, this long or longer, with a digit, outside the base spans.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SEPARATOR = r"[/_=-]+"

#: Labelled ordinary identifiers, next to which words of the corpus are taken as ordinary too.
ORDINARY = (
    "customer_address_line2 max_retry_count getUserName2 readTimeoutSeconds session-cookie-name build/output/main.o "
    "docs/2024/05/release-notes index_page_3 org/apache/commons/lang3 user-profile-image-large node_modules/react "
    "checkout_total_amount parseRequestHeaders background-color-primary test_case_0012_login item_price_with_tax "
    "application/x-www-form-urlencoded text/html python3-dev-package v2/accounts/settings Chapter12Section4Figure3 "
    "section-heading-level-2 image_width_1024_height_768 utf8mb4_unicode_ci linux-x86_64-gnu 2024-05-17T12-30-00 "
    "listing-page-number-15 month/day/year street-and-house-number telephone-extension-204 last_modified_timestamp"
).split()


def _pairs(text: Column) -> Column:
    """Each pair of neighbouring characters of an ASCII string as code * 128 + code."""
    return _let(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.lit(0), F.length(text) - 1)), F.slice(c, 2, F.greatest(F.lit(0), F.length(text) - 1)), lambda x, y: x * 128 + y))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _running(x: Column, best) -> Column:
    """For each place of an array of numbers of zero and more, the sum or greatest of all up to it, in a logarithm of passes over it."""

    def step(acc, k):
        shifted = F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2.0), k).cast("int")), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, shifted, best)

    return F.when(F.size(x) > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int")), x, step)).otherwise(x)


def markov_table(documents: DataFrame, sample_docs: int = 400, random_strings: int = 4000) -> list[float]:
    """Log-likelihood ratio of each character pair, code * 128 + code (nats; above zero: rather random).

    Labelled samples: random are random_strings digests each in base64, lower and upper hexadecimal; ordinary are
    ORDINARY and the words of six letters or more in about sample_docs documents, drawn by a hash. What comes to the driver is at
    most 128 * 128 pairs of two labels.
    """
    spark = documents.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(digest)), "=", "")
    drawn = spark.range(random_strings).select(F.explode(F.array(mixed, F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 32)))).alias("s")).withColumn("label", F.lit(1))
    share = min(1.0, sample_docs / max(1, documents.count()))
    drawn_docs = documents.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 32)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    words = drawn_docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{6,}"), 0)).alias("s")).groupBy("s").agg(F.first(F.lit(0)).alias("label"))
    fixed = spark.createDataFrame([(w, 0) for w in ORDINARY for _ in range(200)], "s string, label int")
    counts = drawn.unionByName(words).unionByName(fixed).select("label", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("label", "pair").count().collect()
    n = {0: [0.25] * 16384, 1: [0.25] * 16384}
    for label, pair, count in counts:
        n[label][pair] += count
    out = [0.0] * 16384
    for a in range(128):
        row = {k: sum(n[k][a * 128 : a * 128 + 128]) for k in n}
        for b in range(128):
            i = a * 128 + b
            out[i] = math.log(n[1][i] / row[1]) - math.log(n[0][i] / row[0])
    return out


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches, by the lengths of what lies between them: (start, end, kind, found), code points."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>")

    def spans(x):
        taken = F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["found"])), x["found"], lambda b, f: F.length(b) + F.length(f))
        return F.zip_with(_running(taken, lambda a, b: a + b), x["found"], lambda end, f: F.struct((end - F.length(f)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), f.alias("found")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), _let(both, spans)).otherwise(none)


def _free(tokens: Column, base: Column) -> Column:
    """The tokens, which don't overlap each other, that overlap no base span.

    With the tokens' ends sorted among the base spans' starts, the furthest end of the spans before a token's end tells.
    """
    marks = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("later"), b["end"].alias("reach"))),
        F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("later"), F.lit(0).alias("reach"))),
    )

    def reaches(m):
        met = F.zip_with(m, _running(F.transform(m, lambda x: x["reach"]), lambda a, b: F.greatest(a, b)), lambda x, r: F.struct(x["later"].alias("later"), r.alias("reach")))
        return F.filter(met, lambda x: x["later"] == 0)

    tried = F.zip_with(tokens, _let(F.array_sort(marks), reaches), lambda t, r: F.struct(t.alias("token"), r["reach"].alias("reach")))
    return F.transform(F.filter(tried, lambda x: x["reach"] <= x["token"]["start"]), lambda x: x["token"])


def find_secrets(documents: DataFrame, table: list[float], min_ratio: float = 0.35) -> DataFrame:
    """(doc_id, spans): spans as array of (start, end, kind) by start, then kind in the order of KINDS.

    Base kinds keep all their spans. A token with a digit and a letter that overlaps no base span is added as markov if the mean
    log-likelihood ratio a character pair is min_ratio or more, over the token or over one of its parts between separators
    that could be a token itself: a key at the end of a path counts.
    One row for each row of documents, null and repeated ids included, each judged by its own text; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    ratios = F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in table) + "]"), "array<double>")
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    spans = documents.select(
        "doc_id",
        F.filter(_found(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 6).alias("assign"),
        F.filter(_found(text, ACCESS, "access"), lambda s: F.length(s["found"]) >= 20).alias("access"),
        _found(text, HEX, "hex").alias("hex"),
        F.filter(_found(text, TOKEN, "markov"), lambda s: mixed(s["found"])).alias("tokens"),
    ).withColumn("base", F.concat("assign", "access", "hex"))
    both = (F.size("tokens") > 0) & (F.size("base") > 0)
    spans = spans.withColumn("free", F.when(both, _free(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens")))

    def mean_ratio(s):
        return _let(_pairs(s), lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(ratios, i + 1)) / F.size(pairs))

    def likely(s):
        parts = F.filter(F.split(s, SEPARATOR), lambda p: (F.length(p) >= 20) & mixed(p))
        return (mean_ratio(s) >= min_ratio) | F.exists(parts, lambda p: mean_ratio(p) >= min_ratio)

    spans = spans.withColumn("markov", F.when(F.size("free") > 0, F.filter("free", lambda s: likely(s["found"]))).otherwise(F.col("free")))
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(F.concat("base", "markov"), lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("rank"), s["end"], s["kind"])))
    return spans.select("doc_id", F.transform(ranked, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_secrets(), one row for each row; rows that repeat a doc_id stay apart."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
