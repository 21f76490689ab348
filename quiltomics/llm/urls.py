"""URL filter: listed rules first, else gradient-boosted trees on lexical features of the URL.

Native: rules, features, training and scoring are DataFrame expressions and aggregates.

Rules (``host/path`` with an action) label URLs: a rule fits its host and all subdomains where the path starts
with the rule's path, the longest one wins.  The labelled URLs teach the trees, which judge the rest.  A URL's
features: lengths of URL, host and path, host and path depth, share of digits, entropy of its characters,
number of parameters, and two statistics of its host suffix (the last two labels): how often it is blocked
among the labelled URLs, smoothed, and how often it occurs there.  Boosting minimises the logistic loss: a
round grows one tree level by level from the sums of gradient and curvature per node, feature and bin, which
Spark aggregates; the driver sees only these sums, at most ``2^depth x features x BINS`` rows.

The fit takes about ``SAMPLE`` distinct labelled URLs (chosen by a hash), a documented bound; scoring takes
every row and whole URLs.  The suffix statistics come from that sample, so the side that is broadcast has
at most about ``SAMPLE`` rows of a suffix and two numbers.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the
trees as any other; with no labelled URL, or labels of one kind only, the trees are a constant (allow where
nothing is labelled); repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.session import settled

#: Rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that a fit takes, about.
SAMPLE = 20_000
BINS = 16
FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_share", "entropy",
    "parameters", "suffix_blocked", "suffix_count",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    after = rest.substr(F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null.  ``rules`` is a short stated list."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def action_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Action of a rule's name."""
    action = F.lit(None).cast("string")
    for name, what in rules:
        action = F.when(rule == name, F.lit(what)).otherwise(action)
    return action


def suffix_of(host: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that need the URL alone."""
    whole = F.coalesce(url, F.lit(""))
    length = F.length(whole)
    each = F.transform(F.array_distinct(F.split(whole, "")), lambda c: length - F.length(F.replace(whole, c, F.lit(""))))
    entropy = F.aggregate(
        each, F.lit(0.0), lambda total, n: total - F.when(n > 0, n / length * F.log2(n / length)).otherwise(0.0)
    )
    digits = length - F.length(F.translate(whole, "0123456789", ""))
    query = F.when(F.instr(whole, "?") > 0, F.substring_index(_after(whole, "?"), "#", 1)).otherwise("")
    return {
        "url_length": length.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "digit_share": F.when(length > 0, digits / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
    }


def _after(text: Column, mark: str) -> Column:
    return text.substr(F.instr(text, mark) + 1, F.length(text))


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, mark, ""))).cast("double")


@dataclass
class Tree:
    """A node's split, or its value; a node without a split is a leaf."""

    feature: str = ""
    limit: float = 0.0
    value: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def column(self) -> Column:
        """Value of a row, as an expression."""
        if self.below is None or self.above is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) < self.limit, self.below.column()).otherwise(self.above.column())


@dataclass
class Filter:
    """Fitted filter: base score, trees, suffix statistics (a bounded table, none where nothing was learned)."""

    base: float
    trees: list[Tree] = field(default_factory=list)
    suffixes: DataFrame | None = None
    rate: float = 0.0

    def score(self) -> Column:
        """Chance that a row with feature columns is to be blocked."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.column()
        return 1 / (1 + F.exp(-total))


def _described(rows: DataFrame, suffixes: DataFrame | None, rate: float) -> DataFrame:
    """Add the feature columns to ``url, host, path``."""
    featured = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path"))).withColumn("suffix", suffix_of(F.col("host")))
    if suffixes is None:
        return featured.withColumns({"suffix_blocked": F.lit(rate), "suffix_count": F.lit(0.0)})
    # Bounded by the sample: one row for each suffix in it.
    return featured.join(F.broadcast(suffixes), "suffix", "left").withColumns(
        {"suffix_blocked": F.coalesce("suffix_blocked", F.lit(rate)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))}
    )


def _grown(rows: DataFrame, limits: dict[str, list[float]], depth: int, rate: float, penalty: float) -> Tree:
    """One tree on gradients ``_g`` and curvatures ``_h``; one aggregate for each level."""
    root = Tree()
    leaves: dict[int, tuple[Tree, list[tuple[str, float, bool]]]] = {0: (root, [])}
    for level in range(depth + 1):
        node = F.lit(None).cast("int")
        for name, (_, path) in leaves.items():
            inside = F.lit(True)
            for feature, limit, below in path:
                inside = inside & ((F.col(feature) < limit) if below else (F.col(feature) >= limit))
            node = F.when(inside, F.lit(name)).otherwise(node)
        binned = F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"_bin_{f}").alias("bin")) for f in limits
        ])
        sums = (
            rows.withColumn("_node", node).where(F.col("_node").isNotNull())
            .select("_node", "_g", "_h", F.explode(binned).alias("b"))
            .groupBy("_node", "b.feature", "b.bin")
            .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n"))
            .collect()  # at most 2^depth nodes x features x bins
        )
        following: dict[int, tuple[Tree, list[tuple[str, float, bool]]]] = {}
        for name, (leaf, path) in leaves.items():
            mine = [r for r in sums if r["_node"] == name]
            one = [r for r in mine if r["feature"] == next(iter(limits))]
            total_g, total_h = math.fsum(r.g for r in one), math.fsum(r.h for r in one)
            leaf.value = -rate * total_g / (total_h + penalty)
            if level == depth:
                continue
            best: tuple[float, str, int] | None = None
            for feature in limits:
                g = h = 0.0
                bins = sorted((r for r in mine if r["feature"] == feature), key=lambda r: r.bin)
                for row in bins[:-1]:
                    g, h = g + row.g, h + row.h
                    gain = g * g / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - total_g**2 / (total_h + penalty)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, feature, row.bin)
            if best is not None:
                _, leaf.feature, place = best
                leaf.limit = limits[leaf.feature][place]
                leaf.below, leaf.above = Tree(), Tree()
                following[2 * name + 1] = (leaf.below, [*path, (leaf.feature, leaf.limit, True)])
                following[2 * name + 2] = (leaf.above, [*path, (leaf.feature, leaf.limit, False)])
        leaves = following
        if not leaves:
            break
    return root


def fit_filter(
    urls: DataFrame, label: Column, trees: int = 8, depth: int = 3, rate: float = 0.5, penalty: float = 1.0, sample: int = SAMPLE
) -> Filter:
    """Boosted trees from rows ``url, host, path`` whose ``label`` is true (block) or false; null labels are left out."""
    labelled = urls.select("url", "host", "path", label.cast("double").alias("_y")).where(F.col("_y").isNotNull())
    count = labelled.count()
    share = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) / float(1 << 20)
    chosen = settled(labelled.where(share < min(1.0, sample / max(1, count))).dropDuplicates(), "url-sample")
    seen, blocked = chosen.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not seen or blocked in (0, seen):
        return Filter(base=20.0 if seen and blocked else -20.0)
    mean = blocked / seen
    suffixes = settled(
        chosen.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(
            ((F.sum("_y") + 2 * mean) / (F.count(F.lit(1)) + 2)).alias("suffix_blocked"), F.count(F.lit(1)).cast("double").alias("suffix_count")
        ),
        "url-suffixes",
    )
    model = Filter(math.log(mean / (1 - mean)), [], suffixes, mean)
    rows = _described(chosen, suffixes, mean)
    places = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(f, places, 10_000).alias(f) for f in FEATURES]).first()
    limits = {f: sorted(set(cuts[f])) for f in FEATURES}
    bins = {f"_bin_{f}": sum((F.col(f) >= x).cast("int") for x in limits[f]) for f in FEATURES}
    rows = settled(rows.select("_y", *FEATURES).withColumns(bins), "url-features")
    for _ in range(trees):
        chance = model.score()
        step = rows.withColumn("_p", chance).withColumns({"_g": F.col("_p") - F.col("_y"), "_h": F.col("_p") * (1 - F.col("_p"))})
        model.trees.append(_grown(step, limits, depth, rate, penalty))
    return model


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; the score is the trees' chance of block."""
    host, path = url_parts(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    action = action_of(F.col("rule"), rules)
    model = fit_filter(rows, action == "block")
    judged = _described(rows, model.suffixes, model.rate).withColumn("score", model.score())
    verdict = F.coalesce(action, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
