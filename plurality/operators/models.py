"""Simple probabilistic baselines: the prior and soft-target multinomial regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def prior(train: DataFrame, k: int = 6) -> list[Column]:
    """Mean vote share of the training rows, as scalar subqueries usable in any projection."""
    one = train.agg(*[F.avg(f"q{i}").alias(f"b{i}") for i in range(k)])
    return [one.select(f"b{i}").scalar() for i in range(k)]


@dataclass
class SoftRegression:
    """Fitted weights on standardised features; scoring is arithmetic on columns."""

    features: list[str]
    mean: list[float]
    sd: list[float]
    weight: list[list[float]]  # class by feature
    bias: list[float]

    def standard(self) -> list[Column]:
        return [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.sd)]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Class probabilities by softmax of the linear terms."""
        k = len(self.bias)
        df = df.withColumns({f"__x{i}": x for i, x in enumerate(self.standard())})
        df = df.withColumns({f"__z{c}": fn.total([F.col(f"__x{i}") * w for i, w in enumerate(self.weight[c])]) + self.bias[c] for c in range(k)})
        top = F.greatest(*fn.cols("__z", k))
        df = df.withColumns({f"__e{c}": F.exp(F.col(f"__z{c}") - top) for c in range(k)})
        mass = fn.total(fn.cols("__e", k))
        df = df.withColumns({f"{out}{c}": F.col(f"__e{c}") / mass for c in range(k)})
        return df.drop(*[f"__x{i}" for i in range(len(self.features))], *[f"__z{c}" for c in range(k)], *[f"__e{c}" for c in range(k)])


def fit_soft_regression(train: DataFrame, features: Sequence[str], l2: float = 1e-3, max_iter: int = 300, k: int = 6) -> SoftRegression:
    """Multinomial regression on fractional targets.

    A row with shares q becomes up to k weighted rows (label j, weight q_j); the weighted loss is
    then the soft cross-entropy, and regParam = 2 l2 gives the penalty l2 |W|^2.
    """
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = [float(stats[f"m_{f}"]) for f in features]
    sd = [float(stats[f"s_{f}"]) + 1e-6 for f in features]
    z = train.select(*[f"q{i}" for i in range(k)], *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, sd)])
    z = VectorAssembler(inputCols=list(features), outputCol="x").transform(z)
    pairs = F.array(*[F.struct(F.lit(float(i)).alias("label"), F.col(f"q{i}").alias("weight")) for i in range(k)])
    ex = z.select("x", F.explode(F.filter(pairs, lambda p: p["weight"] > 0)).alias("p")).select("x", "p.label", "p.weight")
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", standardization=False,
                            regParam=2 * l2, elasticNetParam=0.0, maxIter=max_iter, tol=1e-8)
    m = lr.fit(ex)
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    fill = k - len(b)
    weight = [list(map(float, r)) for r in w] + [[0.0] * len(features)] * fill
    return SoftRegression(list(features), mean, sd, weight, [float(x) for x in b] + [-1e9] * fill)


def predict_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's own model over Arrow batches; the key column travels along, so order does not matter."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)
