"""Quality by hierarchical empirical Bayes.

A logistic regression on character-class shares, repetition and word statistics gives each
document its own evidence. Hosts and the paths below them get posteriors from the sums of that
evidence over all their documents: a host's mean is shrunk towards the global mean, a path's
towards its host's, each by a weight that the spread between sites sets (method of moments), so a
site with few documents says little. A document's posterior is its own odds times the odds of its
path over the global odds.

Sums are grouped aggregations, combined before the shuffle, so a host with a third of all rows
weighs no more than another. Only the model's fit is on a bounded sample of labelled rows
(``limit``); site statistics and scores cover all rows.

Null or empty text has no evidence but its length. A null host or path is a site of its own.
Repeated keys are one document (least text, host and path). Without both labels the model gives
each document the same odds. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areametrics.llm import rules
from areametrics.llm.labels import both, fold, sample
from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

#: Rejected below this posterior: losing a good document counts twice as much as keeping a bad one.
THRESHOLD = 1 / 3
#: A document's own odds and a site's are kept this far from certainty.
LIMIT = 0.001

_FEATURES = [f"class_{i}" for i in range(rules.CLASS_BINS)] + [
    "repeated", "lines", "length", "word_length", "common_share",
]


def features(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key`` and one column per feature, all shares or logarithms."""
    measured = rules.measure(df, key, text, lang)
    chars = "greatest(1L, aggregate(classes, 0L, (s, v) -> s + v))"
    n_words = "greatest(1L, n_words)"
    return measured.select(
        key,
        *[F.expr(f"classes[{i}] / {chars}").alias(f"class_{i}") for i in range(rules.CLASS_BINS)],
        F.expr(f"n_repeat_words / {n_words}").alias("repeated"),
        F.expr("log1p(n_dup_lines)").alias("lines"),
        F.expr("log1p(n_words)").alias("length"),
        F.expr(f"log1p(word_chars / {n_words})").alias("word_length"),
        F.expr(f"1 - common[{rules.WORD_BINS - 1}] / {n_words}").alias("common_share"),
    )


def _logit(p: str | Column) -> Column:
    p = F.expr(p) if isinstance(p, str) else p
    p = F.greatest(F.lit(LIMIT), F.least(F.lit(1 - LIMIT), p))
    return F.log(p / (1 - p))


def document_evidence(
    df: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``key`` and ``evidence``: the model's probability of label 1 from the text alone."""
    found = stored(features(df, key, text, lang), "quality")
    chosen = sample(labels, label, key, limit)
    vectors = VectorAssembler(inputCols=_FEATURES, outputCol="features")
    # At most ``limit`` rows: a bounded broadcast.
    train = vectors.transform(found.join(F.broadcast(chosen), key)).select("features", "label").cache()
    try:
        if not both(train):
            return found.select(key, F.lit(0.5).alias("evidence"))
        model = LogisticRegression(maxIter=60, regParam=1e-3).fit(train)
    finally:
        train.unpersist()
    scored = model.transform(vectors.transform(found))
    return scored.select(key, vector_to_array("probability")[1].alias("evidence"))


def concentration(sites: DataFrame, towards: str) -> float:
    """How many documents the mean above is worth: from the spread of the sites' means ``s / n``
    around it beyond what their sizes explain."""
    row = sites.agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"),
        F.sum(F.expr(f"n * pow(s / n - {towards}, 2)")).alias("between"),
        F.sum(F.expr(f"n * {towards} * (1 - {towards})")).alias("within"),
    ).first()
    if not row["n"] or row["sites"] < 2 or row["n"] <= row["sites"]:
        return 100.0
    within = row["within"] / row["n"]
    # E[between] = sites * within + (n - sites) * spread, nearly.
    spread = (row["between"] - row["sites"] * within) / (row["n"] - row["sites"])
    return float(min(10_000.0, max(1.0, within / spread - 1))) if spread > 0 else 10_000.0


def site_posteriors(rows: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """``host``, ``path`` and ``site``, the shrunken mean evidence; and the global mean.

    ``rows`` has ``host``, ``path`` (never null) and ``evidence``.
    """
    paths = rows.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    paths = stored(paths, "sites")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float((total["s"] + 0.5) / (total["n"] + 1)) if total["n"] else 0.5
    weight = concentration(hosts, f"{mean!r}D")
    hosts = hosts.select(host, F.expr(f"(s + {weight * mean!r}D) / (n + {weight!r}D)").alias("host_mean"))
    joined = stored(sized_join(paths, hosts, [host], how="inner").selectExpr("l.*", "host_mean"), "sites")
    weight = concentration(joined, "host_mean")
    return joined.select(
        host, path, F.expr(f"(s + {weight!r}D * host_mean) / (n + {weight!r}D)").alias("site")
    ), mean


def judge(
    df: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000,
    key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
) -> DataFrame:
    """``key``, ``held_out``, ``evidence``, ``site``, ``score`` (the posterior) and ``kept``."""
    evidence = stored(document_evidence(df, labels, label, limit, key, text, path), "evidence")
    sites = df.groupBy(key).agg(F.min(host).alias("host"), F.min(path).alias("path")).select(
        F.col(key).alias("_key"),
        *[F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) for c in ("host", "path")],
    )
    rows = evidence.join(sites, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    means, overall = site_posteriors(rows, "host", "path")
    joined = sized_join(rows, means, ["host", "path"]).selectExpr("l.*", "site")
    odds = _logit(F.col("evidence")) + _logit(F.col("site")) - _logit(F.lit(overall))
    score = 1 / (1 + F.exp(-odds))
    return joined.withColumn("score", score).select(
        key, (fold(key) == 0).alias("held_out"), "evidence", "site", "score",
        (F.col("score") >= THRESHOLD).alias("kept"),
    )
