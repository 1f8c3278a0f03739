"""Mixing to target weights with soft memberships.

A classifier, fitted on labelled documents, predicts for each document the probabilities of its domains. Rates, the expected
numbers of copies, are then fitted so that the expected words per domain, sum of rate x words x probability, match the
targets: least squares on the relative residuals plus a slight pull to one copy. The rate at which the projected gradient of a
document vanishes follows from its probabilities and the residuals alone, one number per domain; these are found by damped
Newton steps, each one pass over all documents, until the gradient is within `tolerance`. Rates stay distributed. They are
nonnegative, and at least one for documents that belong to a protected domain. The residuals reached are logged.

DataFrame functions and the DataFrame-based classifier only. The classifier is fitted on at most `labelled` rows (those of
least id hash), which bounds its training whatever the size of the tables; everything else covers all documents.

Defined results: null or empty texts have no words and get their predicted rate; documents without label are predicted
like all others; labels with null ids or values are left out, repeated labels count once (the worst); with labels of fewer
than two domains, all documents belong to the labelled domain, or to the first one if there is none; repeated rows are rated
as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

DOMAINS = ("clean", "low", "toxic")
#: Partitions of the rows that the classifier is fitted on, whose number is bounded: each step of the fit is one stage then, and
#: the driver gets as many gradients.
_TRAINING_PARTS = 2


@dataclass(frozen=True)
class Mix:
    """weights: target shares of the words. The total is such that the protected domain keeps its words."""

    weights: tuple[float, ...] = (0.95, 0.05, 0.0)
    protected: int = 0
    labelled: int = 20000
    terms: int = 1 << 16
    least_documents: int = 20
    iterations: int = 50
    regularisation: float = 0.01
    tolerance: float = 1e-9
    pull: float = 1e-3


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2.0).when(quality == 1, 0.0).otherwise(1.0)


def _share(part: Column, pattern: str, text: Column) -> Column:
    return F.char_length(F.regexp_replace(part, pattern, "")) / F.greatest(F.char_length(text), F.lit(1))


def with_terms(docs: DataFrame) -> DataFrame:
    """Adds n_words, terms (distinct stretches of letters, lower case), and shares of kinds of characters."""
    text, rest = F.coalesce("text", F.lit("")), F.col("rest")
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    d = docs.withColumns({"words": F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""), "rest": F.regexp_replace(text, r"[\p{Ll}\s]+", "")})
    return d.withColumns({
        "n_words": F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long"), "terms": F.array_distinct("words"), "symbols": _share(rest, r"[\p{L}\p{N}.,]+", text),
        "upper": _share(rest, r"[^\p{Lu}]+", text), "figures": _share(rest, r"[^\p{N}]+", text)}).drop("text", "words", "rest")


def with_features(termed: DataFrame, model: CountVectorizerModel) -> DataFrame:
    d = model.transform(termed)
    return VectorAssembler(inputCols=["counted", "symbols", "upper", "figures"], outputCol="features").transform(d).drop("terms", "counted", "symbols", "upper", "figures")


def posteriors(docs: DataFrame, labels: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, mark, n_words and p (probabilities by domain) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(mix.labelled).select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("label"))
    # the sample has a proven bound, which is the parameter
    training = written(with_terms(rows.join(F.broadcast(known), "doc_id")), "labelled")
    classes = [r[0] for r in training.select("label").distinct().collect()]
    every = with_terms(rows)
    if len(classes) < 2:
        only = int(classes[0]) if classes else 0
        return every.select("doc_id", "mark", "n_words", F.array(*(F.lit(float(k == only)) for k in range(len(DOMAINS)))).alias("p"))
    terms = CountVectorizer(inputCol="terms", outputCol="counted", vocabSize=mix.terms, minDF=mix.least_documents, binary=True).fit(training)
    features = written(with_features(training, terms).select("features", "label"), "training").coalesce(_TRAINING_PARTS)
    fitted = LogisticRegression(maxIter=mix.iterations, regParam=mix.regularisation, family="multinomial").fit(features)
    fitted.setRawPredictionCol("").setPredictionCol("")
    p = vector_to_array("probability")
    n = fitted.numClasses
    return fitted.transform(with_features(every, terms)).select("doc_id", "mark", "n_words", F.array(*(p[k] if k < n else F.lit(0.0) for k in range(len(DOMAINS)))).alias("p"))


def rates(members: DataFrame, mix: Mix) -> DataFrame:
    """Adds rate. `members` is read in every step and should be a table."""
    d = range(len(DOMAINS))
    own = F.col("p")[mix.protected] >= 0.5
    least = F.when(own, 1.0).otherwise(0.0)
    total, *sums = members.agg(F.coalesce(F.sum("n_words"), F.lit(0)), *(F.coalesce(F.sum(F.col("n_words") * F.col("p")[k]), F.lit(0.0)) for k in d)).first()
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    aim = sums[mix.protected] / mix.weights[mix.protected]
    targets = np.array([w * aim for w in mix.weights])
    scale = np.maximum(sums, total * 1e-9)

    def free(residuals):
        # as one array, which stands beside the generated code: numbers in it would have every step compile its own
        pulls = F.lit([float(r / mix.pull) for r in residuals])
        return 1 - F.aggregate(F.zip_with("p", pulls, lambda share, pull: share * pull), F.lit(0.0), lambda total, x: total + x)

    def gradient(residuals):
        """What the residuals miss those of the rates that they give, and its derivatives."""
        words, moves = F.col("n_words") * F.greatest("least", "free"), F.when(F.col("free") > F.col("least"), F.col("n_words")).otherwise(0)
        rated = members.select("n_words", "p", least.alias("least"), free(residuals).alias("free"))
        found = rated.agg(*(F.sum(words * F.col("p")[k]) for k in d), *(F.sum(moves * F.col("p")[k] * F.col("p")[j]) for k in d for j in d)).first()
        at, bend = np.array(found[:len(DOMAINS)]), np.array(found[len(DOMAINS):]).reshape(len(DOMAINS), -1)
        return residuals - (at - targets) / scale, np.eye(len(DOMAINS)) + bend / (mix.pull * scale[:, None])

    residuals = np.zeros(len(DOMAINS))
    off, slopes = gradient(residuals)
    while np.abs(off).max() > mix.tolerance:
        step, share = np.linalg.solve(slopes, off), 1.0
        after = gradient(residuals - step)
        while np.linalg.norm(after[0] * np.sqrt(scale)) >= np.linalg.norm(off * np.sqrt(scale)):
            share /= 2
            if share < 1e-9:
                raise ArithmeticError(f"rates: gradient {off} stays above the tolerance {mix.tolerance}")
            after = gradient(residuals - share * step)
        residuals, (off, slopes) = residuals - share * step, after
    logging.getLogger(__name__).info("relative residuals of %s: %s", DOMAINS, residuals)
    return members.withColumn("rate", F.greatest(least, free(residuals)))


def mixed(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, mark, n_words, p, rate and copies (the rate, its fraction decided by a hash of id and text) of every row."""
    r = rates(written(posteriors(docs, labels, mix), "posteriors"), mix)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "mark"), F.lit(1 << 32)) / float(1 << 32)
    return r.withColumn("copies", F.floor(F.round("rate", 6) + chance).cast("long"))
