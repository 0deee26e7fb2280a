"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for URLs without a rule.

The trees learn from the URLs that rules label. Training runs as aggregations: for each level of a tree one query sums
gradients and second derivatives by node, feature and bin, over a bounded sample of labelled URLs; the driver sees only those
sums and picks the splits. A finished model is one SQL expression, so judging URLs is a scan with projections.

Defined results: a null URL or one without `://` has an empty host and path and goes to the trees like any other; without
labelled URLs, or with labels of one kind only, there are no trees and the more frequent label (allow if none) is the verdict;
rows are judged one by one, so repeated rows agree; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.storage import stage

#: Labelled URLs that fit() takes at most: those of the smallest hashes.
TRAIN_ROWS = 20_000
#: Host suffixes share so many buckets of statistics, however many there are.
SUFFIX_BUCKETS = 1024
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "query_length", "labels", "hyphens", "longest_label", "top_rate", "domain_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass
class Model:
    """rates: statistics of suffix buckets by kind; trees: nested (feature, threshold, left, right) or a leaf's weight."""

    base: float = 0.0
    rates: dict[str, dict[int, float]] = field(default_factory=dict)
    prior: float = 0.5
    trees: list = field(default_factory=list)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(rules: list[Rule]) -> Column:
    """The longest rule whose host is `host` or a parent domain and whose path starts `path`; null if none."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last to fit is the longest
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def _bucket(suffix: Column) -> Column:
    return F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_BUCKETS)).cast("int")


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the features but for the suffix rates, and the buckets of the suffixes."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    each = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    bits = F.aggregate(each, F.lit(0.0), lambda a, k: a + F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0))
    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": F.log2(n.cast("double")) - bits / n,
            "params": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double"),
            "query_length": F.length(query).cast("double"),
            "labels": F.size(labels).cast("double"),
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "top_bucket": _bucket(F.substring_index("host", ".", -1)),
            "domain_bucket": _bucket(F.substring_index("host", ".", -2)),
        }
    )


def _rates(df: DataFrame, model: Model) -> DataFrame:
    out = {}
    for kind in ("top", "domain"):
        rate = F.lit(model.prior)
        if model.rates.get(kind):
            known = F.create_map(*(F.lit(x) for pair in sorted(model.rates[kind].items()) for x in pair))
            rate = F.coalesce(F.try_element_at(known, F.col(f"{kind}_bucket")), rate)
        out[f"{kind}_rate"] = rate
    return df.withColumns(out)


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, threshold, left, right = tree
    return F.when(F.col(name) <= threshold, _value(left)).otherwise(_value(right))


def margin(model: Model) -> Column:
    out = F.lit(model.base)
    for tree in model.trees:
        out = out + _value(tree)
    return out


def _node(tree, number: int = 1) -> Column:
    """Number of the leaf: the children of k are 2k and 2k + 1."""
    if not isinstance(tree, tuple):
        return F.lit(number)
    name, threshold, left, right = tree
    return F.when(F.col(name) <= threshold, _node(left, 2 * number)).otherwise(_node(right, 2 * number + 1))


def _grown(tree, splits: dict[int, tuple], number: int = 1):
    if isinstance(tree, tuple):
        return (*tree[:2], _grown(tree[2], splits, 2 * number), _grown(tree[3], splits, 2 * number + 1))
    return splits.get(number, tree)


def best_split(sums: list[tuple[int, float, float]], l2: float, least: float) -> tuple[float, int, float, float] | None:
    """(gain, last bin of the left side, weight left, weight right) from (bin, gradient, second derivative) of a node's feature."""
    total_g, total_h = sum(s[1] for s in sums), sum(s[2] for s in sums)
    best, g, h = None, 0.0, 0.0
    for number, dg, dh in sorted(sums)[:-1]:
        g, h = g + dg, h + dh
        rest_g, rest_h = total_g - g, total_h - h
        if h < least or rest_h < least:
            continue
        gain = g * g / (h + l2) + rest_g * rest_g / (rest_h + l2) - total_g * total_g / (total_h + l2)
        if gain > 1e-9 and (best is None or gain > best[0]):
            best = gain, number, -g / (h + l2), -rest_g / (rest_h + l2)
    return best


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, l2: float = 1.0, least: float = 1.0, weight: float = 20.0) -> Model:
    """Learn from (url, host, path, allowed) with a boolean label; `weight` rows of the prior smooth each suffix rate."""
    sample = _lexical(labelled.orderBy(F.xxhash64("url"), "url").limit(rows)).withColumn("y", F.col("allowed").cast("double"))
    sample = stage(sample.drop("url", "host", "path", "allowed"), "urls")
    n, ones = sample.agg(F.count("*"), F.sum("y")).first()
    model = Model()
    if not n:
        return model
    model.prior = ones / n
    if ones in (0, n):
        model.base = 1.0 if ones else -1.0
        return model
    model.base = math.log(ones / (n - ones))
    for kind in ("top", "domain"):
        sums = sample.groupBy(f"{kind}_bucket").agg(F.sum("y"), F.count("*")).collect()  # SUFFIX_BUCKETS rows at most
        model.rates[kind] = {b: (s + weight * model.prior) / (c + weight) for b, s, c in sums}
    sample = stage(_rates(sample, model).select("y", *FEATURES), "urls")
    quantiles = [k / bins for k in range(1, bins)]
    found = sample.agg(*(F.percentile(f, F.array(*map(F.lit, quantiles))).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES}
    binned = [F.struct(F.lit(i).alias("feature"), sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("bin")) for i, f in enumerate(FEATURES)]
    for _ in range(rounds):
        tree, p = 0.0, 1 / (1 + F.exp(-margin(model)))
        for _ in range(depth):
            each = sample.select(_node(tree).alias("node"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.explode(F.array(*binned)).alias("x"))
            sums = each.groupBy("node", "x.feature", "x.bin").agg(F.sum("g"), F.sum("h")).collect()  # nodes x features x bins rows at most
            by: dict[tuple[int, int], list] = {}
            for node, feature, number, g, h in sums:
                by.setdefault((node, feature), []).append((number, g, h))
            splits: dict[int, tuple] = {}
            for (node, feature), own in sorted(by.items()):
                if (s := best_split(own, l2, least)) and s[0] > splits.get(node, (0.0,))[0] + 1e-9:
                    splits[node] = s[0], (FEATURES[feature], cuts[FEATURES[feature]][s[1]], rate * s[2], rate * s[3])
            if not splits:
                break
            tree = _grown(tree, {k: v[1] for k, v in splits.items()})
        if not isinstance(tree, tuple):
            break
        model.trees.append(tree)
    return model


def parsed(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule)."""
    out = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"))
    return out.withColumns({"host": host("url"), "path": path("url")}).withColumn("rule", matching_rule(rules))


def labelled(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The URLs of parsed() that a rule judges, with its verdict as the label."""
    allowed = F.col("rule").isin([r.text for r in rules if r.verdict == "allow"])
    return df.filter("rule is not null").select("url", "host", "path", allowed.alias("allowed"))


def judge(df: DataFrame, rules: list[Rule], model: Model) -> DataFrame:
    """Rows of parsed() with verdict (the rule's, else the trees') and score, the trees' probability of allow."""
    score = 1 / (1 + F.exp(-margin(model)))
    by_rule = F.when(F.col("rule").isin([r.text for r in rules if r.verdict == "allow"]), "allow").when(F.col("rule").isNotNull(), "block")
    full = _rates(_lexical(df), model).withColumn("score", score)
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
