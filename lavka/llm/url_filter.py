"""URL filter: fixed rules, then logistic regression on hashed character n-grams of host and path.

DataFrame operations only. The regression is trained on a small labelled table of
URLs (``url``, ``blocked``), by gradient descent over the whole table: one pass per
step, in which every URL's margin and its n-grams' part of the gradient are computed
and summed on the executors. Only the weights, ``2**bits`` numbers, come to the
driver, and they go back as a constant of the next step's expression. Gradients are
summed as whole numbers, so that the result does not depend on the order of rows.

A null URL, or one without ``://``, has an empty host and an empty path; it gets a
verdict like any other. Repeated URLs are judged alike. Without labelled rows every
weight is 0 and the verdict is ``allow``.
"""

import math
from typing import NamedTuple

from pyspark.sql import functions as F

from lavka.llm.tables import lower_ascii
from lavka.session import cut

ALLOW, BLOCK = "allow", "block"
# Gradients are summed in units of 2**-SCALE, larger ones where there are 2**32 rows or more.
SCALE = 30


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self):
        return self.host + self.path


class Model(NamedTuple):
    weights: list
    bias: float
    bits: int
    sizes: tuple


def url_parts(url):
    """Columns (host, path) of a URL column."""
    after = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    rest = F.when(after.isNotNull(), F.substr(url, F.length(after) + 4))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw_host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw_host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host, path, rules):
    """(name, verdict) of the longest rule that fits; null if none does. For a short list of rules."""
    longest = sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == BLOCK), reverse=True)
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(longest):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_features(host, path, sizes=(3, 4, 5), bits=12):
    """Array of the hash buckets of all character n-grams, host and path told apart, each bucket once."""
    def grams(mark, text, n):
        # The ends are marked, so that "starts with" and "ends with" are features.
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        count = F.length(marked) - (n - 1)
        bucket = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.pmod(
            F.xxhash64(F.lit(f"{mark}{n}"), F.substr(marked, i, F.lit(n))), F.lit(2 ** bits)).cast("int"))
        return F.when(count > 0, bucket).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*[grams(m, t, n) for m, t in (("h", host), ("p", path)) for n in sizes]))


def _margin(features, model):
    """Weights and bias are one constant array, so that every step runs the same compiled code.

    Their number is fixed by the model's bits.
    """
    numbers = F.split(F.lit(",".join(map(repr, [*model.weights, model.bias]))), ",").cast("array<double>")
    total = F.aggregate(features, F.lit(0.0), lambda sum_, f: sum_ + F.element_at(numbers, f + 1))
    return total / F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double")) + F.element_at(numbers, -1)


def _probability(features, model):
    return 1.0 / (1.0 + F.exp(-_margin(features, model)))


def train(labelled, sizes=(3, 4, 5), bits=12, steps=20, rate=2.0, ridge=1e-4, max_rows=4096):
    """Logistic regression from ``labelled`` (url, blocked).

    Rows alike in host, path and label are one URL that counts as often as it is there.
    At most ``max_rows`` URLs of each label are used: those with the smallest hashes.
    Rows without a label are left out. Steps are scaled per weight by the gradients so far.
    """
    host, path = url_parts(F.col("url"))
    urls = cut(
        labelled.where("blocked is not null")
        .select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"))
        .groupBy("host", "path", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    allowed, blocked = (
        urls.where(F.col("y") == y).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows) for y in (0, 1))
    rows = cut(allowed.unionByName(blocked).select(
        url_features(F.col("host"), F.col("path"), sizes, bits).alias("features"), "y", "n"))
    model = Model([0.0] * 2 ** bits, 0.0, bits, tuple(sizes))
    n = rows.agg(F.sum("n")).first()[0]
    if not n:
        return model
    scale = min(SCALE, 62 - n.bit_length())  # sums stay below 2**62
    squares = [0.0] * (2 ** bits + 1)
    for _ in range(steps):
        off = (_probability(F.col("features"), model) - F.col("y"))
        unit = F.round(off / F.sqrt(F.greatest(F.size("features"), F.lit(1)).cast("double")) * 2.0 ** scale).cast("long")
        whole = F.round(off * 2.0 ** scale).cast("long")
        # A row's error is found once, then goes to each of its buckets; bucket -1 is the bias.
        sums = rows.select(
            "features", (unit * F.col("n")).alias("unit"), (whole * F.col("n")).alias("whole"),
        ).select(
            F.explode(F.concat(F.array(F.lit(-1)), F.col("features"))).alias("f"), "unit", "whole",
        ).groupBy("f").agg(F.sum(F.when(F.col("f") < 0, F.col("whole")).otherwise(F.col("unit"))).alias("g"))
        weights, bias = list(model.weights), model.bias
        for f, g in sums.collect():  # 2**bits + 1 rows at most
            gradient = g / 2.0 ** scale / n + (ridge * weights[f] if f >= 0 else 0.0)
            squares[f] += gradient * gradient
            step = rate * gradient / (math.sqrt(squares[f]) + 1e-9)
            if f >= 0:
                weights[f] -= step
            else:
                bias -= step
        model = model._replace(weights=weights, bias=bias)
    return model


def judge(pages, rules, model, keep=("page_id",)):
    """Per page: ``keep``, host, path, rule, score (probability of block), verdict."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({
        "rule": name, "score": _probability(url_features(F.col("host"), F.col("path"), model.sizes, model.bits), model),
    }).withColumn("verdict", F.coalesce(
        verdict, F.when(F.col("score") > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))))


def labels_from_rules(pages, rules):
    """A labelled URL table: the pages that a rule decides."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    _, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.where(verdict.isNotNull()).select("url", (verdict == BLOCK).alias("blocked"))
