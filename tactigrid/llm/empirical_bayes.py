"""Quality classifier: a document's own evidence, corrected by what its path and host are like.

1. One pass over the texts measures each document (shares of character classes, word and line statistics).
2. A logistic regression on a bounded sample of labelled rows turns the measures into the document's evidence.
3. Grouped sums over all documents give each host's and each path's mean quality. A path's posterior shrinks toward its
   host's, a host's toward the global mean, the more the fewer documents it has (Beta priors; their strengths are
   estimated by moments from the spread of host and path means, which is the empirical part).
4. The site's log odds, relative to the global ones, are added to the document's with a weight; below the threshold the
   document is rejected.

Hosts are the `source` column, paths are `source` and `lang`. Sums are combined before they are shuffled; a host with a
third of all rows is one row of sums.

Defined results: null text is empty; null hosts or paths are one group of their own; without labels the evidence is the
constant 0.5 and everything is kept; labels of one id count once, by their majority (a tie is bad), and so do documents of
one id in the fit; a document without labels is scored like any
other; other columns are kept by `kept_documents` and ignored by `score`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tactigrid.llm.common import checkpointed, join_small, python_ready, quoted

FEATURES = ("upper", "digit", "mark", "symbol", "space", "bar", "high_byte", "log_words", "word_length", "short_share", "repeat_words", "repeat_lines", "line_words")


@dataclass(frozen=True)
class BayesParams:
    #: About so many labelled rows are read for the fit, chosen by a hash of the id.
    sample: int = 20_000
    ridge: float = 1e-3
    steps: int = 40
    #: Bounds of the priors' strengths, in documents.
    least_strength: float = 20.0
    most_strength: float = 5000.0
    site_weight: float = 0.5
    threshold: float = 0.4
    seed: int = 3


_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#*$%&<>", b" \t\n\x0b\x0c\r", b"|", bytes(range(128, 256))), 1):
    _KIND[list(_chars)] = _k


def measures(text: bytes) -> list[float]:
    """FEATURES of a text."""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)[1:8] / max(1, len(text))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    return [*kinds.tolist(), np.log1p(n), len(b"".join(words)) / n if n else 0.0, sum(len(w) <= 3 for w in words) / n if n else 0.0, 1 - len(set(words)) / n if n else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(n / len(lines)) if lines else 0.0]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and features: array<double>."""
    python_ready(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t or b"") for t in batch.column("text_").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features_"])

    picked = docs.select(*keep, F.col("text").cast("string").alias("text_"))
    return picked.mapInArrow(measure, StructType([*picked.drop("text_").schema.fields]).add("features_", ArrayType(DoubleType())))


@dataclass(frozen=True)
class Logistic:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept


def fit(features: np.ndarray, labels: np.ndarray, params: BayesParams = BayesParams()) -> Logistic | None:
    """By iteratively reweighted least squares; None if there is one class only."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-9)
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], params.ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(params.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def train(table: DataFrame, labels: DataFrame, params: BayesParams = BayesParams()) -> Logistic | None:
    """table: doc_id and features_ of all documents; labels: doc_id and quality."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col("quality").cast("int")) > 0.5).cast("int").alias("quality"))
    share = min(1.0, params.sample / max(1, known.count()))
    unit = (F.xxhash64("doc_id", F.lit(params.seed)).cast("double") / 2.0**64) + 0.5
    chosen = table.select("doc_id", "features_").join(known.where(unit < share), "doc_id")
    rows = chosen.groupBy("doc_id").agg(F.min(F.struct("features_", "quality")).alias("r")).select("doc_id", "r.*").collect()  # one row per chosen id: bounded by the sample
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["features_"]))
    return fit(np.array([r["features_"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["quality"]) for r in rows]), params)


def evidence(model: Logistic | None) -> F.Column:
    """Probability of good quality from the column features_."""
    if model is None:
        return F.lit(0.5)
    terms = zip(model.mean, model.scale, model.weights, strict=False)
    z = sum(((F.col("features_")[i] - m) / s * w for i, (m, s, w) in enumerate(terms)), F.lit(model.weights[-1]))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _strength(within: float, between: float, params: BayesParams) -> float:
    """Of the Beta prior whose groups spread by `between` about a mean with Bernoulli variance `within`."""
    found = within / between - 1 if between > 0 else params.most_strength
    return float(min(params.most_strength, max(params.least_strength, found)))


def _moments(groups: DataFrame, n: str, mean: str, about: str) -> float:
    """Weighted variance of group means about another column, less what sampling alone makes."""
    r = groups.agg(F.sum(F.col(n) * (F.col(mean) - F.col(about)) ** 2).alias("s"), F.sum(n).alias("n"), F.sum(F.col(mean) * (1 - F.col(mean))).alias("v")).first()
    return max(0.0, (r["s"] - r["v"]) / r["n"]) if r["n"] else 0.0


def posteriors(scored: DataFrame, params: BayesParams = BayesParams()) -> DataFrame:
    """From host, path and p of all documents: host, path, n, host_posterior, path_posterior and the global mean."""
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy(F.col("host").alias("of_host")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (total["s"] / total["n"]) if total["n"] else 0.5
    within = mean * (1 - mean)
    spread = hosts.select("host_n", (F.col("host_s") / F.col("host_n")).alias("m"), F.lit(mean).alias("about"))
    top = _strength(within, _moments(spread, "host_n", "m", "about"), params)
    hosts = hosts.withColumn("host_posterior", (F.col("host_s") + top * mean) / (F.col("host_n") + top))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).select("host", "path", "n", "s", "host_n", "host_posterior")
    below = joined.select("n", (F.col("s") / F.col("n")).alias("m"), F.col("host_posterior").alias("about"))
    low = _strength(within, _moments(below, "n", "m", "about"), params)
    return joined.select("host", "path", "n", "host_n", "host_posterior", ((F.col("s") + low * F.col("host_posterior")) / (F.col("n") + low)).alias("path_posterior"), F.lit(mean).alias("global_mean"))


def _logit(p: F.Column) -> F.Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def score(docs: DataFrame, labels: DataFrame, params: BayesParams = BayesParams()) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, kept; one row per row of docs."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), "text")
    table = checkpointed(measured(keyed, ["doc_id", "host", "path"]))
    model = train(table, labels, params)
    if model is None:
        return table.select("doc_id", F.lit(0.5).alias("evidence"), F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    scored = table.select("doc_id", "host", "path", evidence(model).alias("p"))
    key = F.struct(F.coalesce("host", F.lit("")), F.col("host").isNull(), F.coalesce("path", F.lit("")), F.col("path").isNull())
    sites = checkpointed(posteriors(scored, params).withColumn("key_", key).drop("host", "path"))
    joined = join_small(scored.withColumn("key_", key), sites, "key_", "inner")
    final = 1 / (1 + F.exp(-(_logit(F.col("p")) + params.site_weight * (_logit(F.col("path_posterior")) - _logit(F.col("global_mean"))))))
    return joined.select("doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", final.alias("score")).withColumn("kept", F.col("score") >= params.threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, params: BayesParams = BayesParams()) -> DataFrame:
    """The rows of docs that aren't rejected. Rows with one doc_id stay or go together; a null doc_id is kept."""
    gone = score(docs, labels, params).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
