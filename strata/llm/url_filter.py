"""URL filter: rules on hosts and paths, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fits, written

#: (rule, verdict): a rule is a host, with all its subdomains, and a prefix of the path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["n_chars", "n_host", "n_path", "depth", "n_labels", "digit_share", "mark_share", "entropy", "n_params", "suffix_share", "suffix_weight"]


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[tuple[str, str], ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); null without one. The rules are a short list in the call."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.find("/") if "/" in text else len(text)
        fits = ((F.col(host) == text[:at]) | F.col(host).endswith("." + text[:at])) & F.col(path).startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Lexical features of ``url`` (with ``host`` and ``path``): lengths, depth, shares of digits and marks,
    entropy of the characters in bits, number of parameters, and ``suffix`` (the last two host labels)."""
    url, n = F.coalesce(F.col("url"), F.lit("")), F.greatest(F.length(F.coalesce(F.col("url"), F.lit(""))), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: s - (n - F.length(F.replace(url, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(url, c, F.lit("")))) / n))
    return pages.select(
        "*",
        F.length(url).cast("double").alias("n_chars"), F.length("host").cast("double").alias("n_host"), F.length("path").cast("double").alias("n_path"),
        F.length(F.regexp_replace("path", "[^/]", "")).cast("double").alias("depth"), F.size(F.split("host", r"\.")).cast("double").alias("n_labels"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_share"), (F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / n).alias("mark_share"),
        bits.alias("entropy"), F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0).alias("n_params"),
        F.substring_index("host", ".", -2).alias("suffix"))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7,
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every page.

    The longest fitting rule gives the verdict. URLs that a rule labels also train gradient-boosted trees
    (on at most ``train_rows`` of them, in the order of a hash of the URL), which judge the others: block from
    a probability of 0.5 on. Suffix statistics, the smoothed share of blocked URLs for each of the last two
    host labels, are taken over all labelled URLs, pre-aggregated; they stay a distributed table, and are broadcast where
    their counted rows fit, so a very common suffix is no single task's join. Training URLs get theirs from the other
    folds of URLs, judged ones from all.

    Everything runs in the JVM. A null or unparsable URL has an empty host and path and is judged by the trees;
    rows with equal or null ids each get their row; other columns are not used; an empty table gives no
    rows. With labels of fewer than two kinds there is nothing to learn: the only kind (allow without any) is
    the verdict of the rest, and the score is null.
    """
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("*", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = rule_of(rules)
    judged = lexical(own.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    known = judged.where("by_rule IS NOT NULL").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    kinds = [r["by_rule"] for r in known.select("by_rule").distinct().limit(2).collect()]
    result = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        return judged.select(*result, F.coalesce("by_rule", F.lit(kinds[0] if kinds else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    # Labelled URLs for each suffix and fold of URLs, and of all folds.
    parts = written(known.groupBy("suffix", fold_of("url")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("seen")), "suffixes")
    whole = parts.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    sample = known.orderBy(F.xxhash64("url"), "page_id").limit(train_rows).select("*", fold_of("url"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=seed).fit(vector.transform(training_suffixes(sample, parts)).select("features", "label"))
    suffixes = written(whole.select("suffix", *suffix_statistics(F.col("blocked"), F.col("seen"))), "suffix-shares")
    every = judged.join(fits(suffixes, SUFFIX_BYTES), "suffix", "left").fillna({"suffix_share": 0.5, "suffix_weight": 0.0})
    scored = model.transform(vector.transform(every))
    blocked = vector_to_probability("probability")
    return scored.select(*result, F.coalesce("by_rule", F.when(blocked >= 0.5, "block").otherwise("allow")).alias("verdict"), blocked.alias("score"))


#: Parts that labelled URLs are dealt to, and bytes that a suffix with its statistics takes (a host has 253 characters at most).
FOLDS, SUFFIX_BYTES = 5, 300


def fold_of(url: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(url)), F.lit(FOLDS)).alias("fold")


def suffix_statistics(blocked: Column, seen: Column) -> tuple[Column, Column]:
    """The smoothed share of blocked URLs, and how many there are."""
    return ((blocked + 1) / (seen + 2)).alias("suffix_share"), F.log1p(seen).alias("suffix_weight")


def training_suffixes(sample: DataFrame, parts: DataFrame) -> DataFrame:
    """``sample`` (with suffix and fold) with the suffix statistics of the other folds only, so that neither a URL's own label
    nor that of an equal URL is in its features. ``parts``: blocked and seen for each (suffix, fold)."""
    whole = parts.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    own = parts.withColumnsRenamed({"blocked": "own_blocked", "seen": "own_seen"})
    others = sample.select("suffix", "fold").distinct().join(own, ["suffix", "fold"]).join(whole, "suffix")
    return sample.join(others.select("suffix", "fold", *suffix_statistics(F.col("blocked") - F.col("own_blocked"), F.col("seen") - F.col("own_seen"))), ["suffix", "fold"])


def vector_to_probability(column: str) -> Column:
    """The second entry of a vector column."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[1]
