"""Document quality by hierarchical empirical Bayes.

A logistic model of text features, fitted on a bounded sample of labelled documents, gives each document its evidence.
Evidence is added up by host and by path below the host in one grouped aggregation. A host's rate of good documents is
shrunk toward the global rate, a path's toward its host's, each with a strength that the spread of the rates one level
up decides (method of moments); sparse sites therefore take the prior of the level above. A document's score is its own
likelihood ratio times the prior odds of its site, from which its own evidence has been left out.

Defined results: a null text is empty; null hosts and paths are sites of their own; repeated rows are scored each; an
empty table gives no rows; without labels, or with labels of one kind, the evidence is the smoothed share of good labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .labels import MAX_LABELLED, labelled_sample
from .words import Words, slices, summed

KEEP_AT = 0.5
RIDGE = 1.0
ROUNDS = 25
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
CLIP = 1e-4
#: Sites are broadcast up to this many rows (about 150 bytes each); beyond it they are joined over salted keys.
MAX_BROADCAST_SITES = 500_000
SALTS = 64
FEATURES = ["log_words", "mean_length", "upper", "digits", "symbols", "shouts", "bars", "distinct", "repeats", "lines"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text (no nulls)."""
    words = Words(texts)
    counts, owner = words.lengths(), words.owner()
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)

    def share(pattern: str, of: np.ndarray) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / np.maximum(of, 1)

    own = owner * (len(words.vocabulary) + 1) + words.codes
    distinct = np.bincount(np.unique(own) // (len(words.vocabulary) + 1), minlength=len(texts)) if len(own) else counts
    again = np.zeros(len(own), np.int64)
    again[1:] = own[1:] == own[:-1]
    n = np.maximum(counts, 1)
    return np.column_stack([
        np.log1p(counts), np.minimum(chars / n, 30), share(r"\p{Lu}", chars), share(r"\p{Nd}", chars),
        share(r"[#*$%&<>]", n), share("!", n), share(r"\|", n), distinct / n, summed(again, words.starts) / n,
        share("\n", n)]).astype(float)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        good = (y.sum() + 1.0) / (len(y) + 2.0)
        self.prior = float(np.log(good / (1 - good)))
        self.mean, self.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        self.weights = np.r_[self.prior, np.zeros(x.shape[1])]
        if 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            z = self._design(x)
            penalty = np.r_[1e-6, np.full(x.shape[1], RIDGE)]
            for _ in range(ROUNDS):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
                step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * self.weights)
                self.weights += step
                if np.abs(step).max() < 1e-8:
                    break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def text_blocks(texts: pa.Array):
    """Slices of bounded size of a column of texts, without nulls."""
    yield from (b.column(0) for b in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> Logistic:
    sample = labelled_sample(docs, labels, label, key, text, max_rows)

    def read(batches):
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(c) for c in x.T]], ["label", *FEATURES])

    rows = sample.mapInArrow(read, ", ".join(["label int", *[f"{n} double" for n in FEATURES]])).toPandas()
    return Logistic(rows[FEATURES].to_numpy(float), rows["label"].to_numpy(float))


def evidence(model: Logistic):
    """Column function: probability that a text is good by the text alone."""
    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        parts = [model.probability(features(block)) for block in text_blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return probability


def strength(n, rate, good) -> F.Column:
    """Prior strength from the spread of the rates of sites (weighted): mean (1 - mean) / between-site variance - 1."""
    mean = F.sum(good) / F.sum(n)
    spread = F.sum(n * rate * rate) / F.sum(n) - mean * mean
    within = mean * (1 - mean) * F.count(F.lit(1)) / F.sum(n)
    between = F.greatest(spread - within, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          path: str = "lang", label: str = "quality", keep_at: float = KEEP_AT, max_labelled: int = MAX_LABELLED,
          out: str = "verdict", max_broadcast_sites: int = MAX_BROADCAST_SITES) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out`` of evidence, host_rate, path_rate, score and kept.

    A column of ``docs`` that already has the name ``out`` is replaced.
    """
    judge = evidence(fit(docs, labels, key, text, label, max_labelled))
    own = F.least(F.greatest(judge(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(CLIP)), F.lit(1 - CLIP))
    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (host, path)]

    paths = (docs.select(site[0].alias("host"), site[1].alias("path"), own.alias("p")).groupBy("host", "path")
             .agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    rate = F.col("good") / F.col("n")
    overall = hosts.agg(
        F.sum("host_n").alias("all_n"), F.sum("host_good").alias("all_good"),
        strength(F.col("host_n"), F.col("host_good") / F.col("host_n"), F.col("host_good")).alias("host_strength"))
    below = paths.agg(strength(F.col("n"), rate, F.col("good")).alias("path_strength"))
    totals = overall.crossJoin(below)       # one row each
    sites = materialize(paths.join(hosts, "host").crossJoin(F.broadcast(totals)), "sites")
    sites = sites.select(*[F.col(c).alias(f"_{c}") for c in sites.columns])

    kept_columns = [c for c in docs.columns if c != out]
    scored = docs.select(F.struct(*kept_columns).alias("_row"), site[0].alias("_h"), site[1].alias("_s"), own.alias("_p"))
    same = (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_path"))
    if sites.count() <= max_broadcast_sites:
        joined = scored.join(F.broadcast(sites), same)
    else:       # a hot site's documents are dealt to SALTS tasks
        content = F.xxhash64(F.col(f"_row.{key}").cast("string"), F.col(f"_row.{text}").cast("string"))
        salted = scored.withColumn("_salt", F.pmod(content, F.lit(SALTS)).cast("int"))
        copies = sites.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col("_salt") == F.col("_copy")))
    p = F.col("_p")
    prior = F.col("_all_good") / F.col("_all_n")
    host_rate = ((F.col("_host_good") - p + F.col("_host_strength") * prior)
                 / (F.col("_host_n") - 1 + F.col("_host_strength")))
    path_rate = ((F.col("_good") - p + F.col("_path_strength") * F.col("_host_rate"))
                 / (F.col("_n") - 1 + F.col("_path_strength")))

    def logit(x):
        x = F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP))
        return F.log(x / (1 - x))

    joined = joined.withColumn("_host_rate", host_rate).withColumn("_path_rate", path_rate)
    total = 1 / (1 + F.exp(-(logit(p) + logit(F.col("_path_rate")) - logit(prior))))
    verdict = F.struct(p.alias("evidence"), F.col("_host_rate").alias("host_rate"),
                       F.col("_path_rate").alias("path_rate"), total.alias("score"), (total >= keep_at).alias("kept"))
    return joined.select("_row.*", verdict.alias(out))
