"""Model families on pyspark.ml, and what chooses among models: bench, permutation importance, elimination, search, final fit."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import TWEEDIE_LEVELS, Profile
from tallyframe.operators import metrics

SEED = 42


@dataclass(frozen=True)
class Family:
    """A kind of model: how to make its estimator, what may be searched, and whether it is a tree ensemble."""

    make: Callable[[dict], Estimator]
    space: dict[str, tuple] = field(default_factory=dict)
    tree: bool = True
    categories: bool = True


FAMILIES = {
    "gbt": Family(lambda p: GBTRegressor(labelCol="label", seed=SEED, **{"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "maxBins": 256} | p), {"maxDepth": (3, 4, 5, 6), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.85, 1.0), "minInstancesPerNode": (1, 5, 20)}),
    "gbt_absolute": Family(lambda p: GBTRegressor(labelCol="label", seed=SEED, lossType="absolute", **{"maxIter": 20, "maxDepth": 5, "stepSize": 0.2, "maxBins": 256} | p), {"maxDepth": (3, 4, 5, 6), "stepSize": (0.1, 0.2, 0.4)}),
    "forest": Family(lambda p: RandomForestRegressor(labelCol="label", seed=SEED, **{"numTrees": 20, "maxDepth": 8, "maxBins": 256} | p), {"maxDepth": (6, 8, 10), "featureSubsetStrategy": ("onethird", "sqrt"), "minInstancesPerNode": (1, 5, 20)}),
    "ridge": Family(lambda p: LinearRegression(labelCol="label", **{"regParam": 1.0, "elasticNetParam": 0.0} | p), {"regParam": (0.1, 1.0, 10.0)}, tree=False, categories=False),
    "tweedie": Family(lambda p: GeneralizedLinearRegression(labelCol="label", family="tweedie", variancePower=1.5, linkPower=0.0, **{"regParam": 0.1, "maxIter": 15} | p), {"regParam": (0.01, 0.1, 1.0)}, tree=False, categories=False),
}


def prepare(features: list[str], categories: list[str], family: Family) -> list:
    """Stages before a model: categories as indexes with one for the unknown, gaps filled by the median, one vector."""
    used = [c for c in categories if c in features and family.categories]
    numbers = [c for c in features if c not in categories]
    stages: list = []
    if used:
        stages.append(StringIndexer(inputCols=used, outputCols=[f"{c}__i" for c in used], handleInvalid="keep", stringOrderType="alphabetAsc"))
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__n" for c in numbers]))
    vector = "features" if family.tree else "raw"
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in used] + [f"{c}__n" for c in numbers], outputCol=vector))
    if not family.tree:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return stages


def _ready(df: DataFrame, features: list[str], categories: list[str], target: str) -> DataFrame:
    """Doubles for numbers (a column without any value is 0) and a word for a missing category."""
    new = {c: F.coalesce(F.col(c), F.lit("missing")) if c in categories else F.col(c).cast("double") for c in features}
    out = df.withColumns(new)
    return out.withColumn("label", F.col(target).cast("double")) if target in df.columns else out


def usable(df: DataFrame, features: list[str], categories: list[str] = ()) -> list[str]:
    """Features with a value in some row: a median needs one."""
    counts = df.agg(*(F.count(c).alias(c) for c in features)).first()
    return [c for c in features if c in categories or counts[c]]


def fit(train: DataFrame, features: list[str], categories: list[str], family: str = "gbt", params: dict | None = None, target: str = "sales") -> PipelineModel:
    kind = FAMILIES[family]
    return Pipeline(stages=[*prepare(features, categories, kind), kind.make(params or {})]).fit(_ready(train, features, categories, target))


def predict(model: PipelineModel, df: DataFrame, features: list[str], categories: list[str]) -> DataFrame:
    """df with forecast, at least 0 and 0 where the store is closed."""
    rows = model.transform(_ready(df, features, categories, "__none"))
    keep = [c for c in df.columns if c not in features]
    own = rows.select(*keep, *[c for c in features if c not in keep], F.greatest("prediction", F.lit(0.0)).alias("forecast"))
    return metrics.clip_closed(own)


def score(df: DataFrame, objective: str = "rmse") -> float:
    return df.agg(metrics.objective(objective).alias("s")).first().s


def objective_of(level: int) -> str:
    """What a level's models are judged by: the sparsest levels by Tweedie deviance, the others by the root of the mean square."""
    return "tweedie" if level in TWEEDIE_LEVELS else "rmse"


def bench(train: DataFrame, valid: DataFrame, features: list[str], categories: list[str], families: tuple[str, ...] = tuple(FAMILIES), objective: str = "rmse", params: dict | None = None) -> list[dict]:
    """One row for each family with its defaults (or params): family, score, wape, seconds."""
    out = []
    for name in families:
        began = time.time()
        done = predict(fit(train, features, categories, name, params), valid, features, categories)
        row = done.agg(metrics.objective(objective).alias("score"), metrics.point()["wape"].alias("wape")).first()
        out.append({"family": name, "score": row.score, "wape": row.wape, "seconds": time.time() - began})
    return out


def winner(results: list[dict]) -> str:
    """The tree family with the least score; a linear one only where no tree ran."""
    trees = [r for r in results if FAMILIES[r["family"]].tree] or results
    return min(trees, key=lambda r: (r["score"], r["family"]))["family"]


def naive_table(train: DataFrame, valid: DataFrame, grain: str) -> DataFrame:
    """Every naive forecaster with each of its windows: model, wape, rmse."""
    from tallyframe.config import AVERAGE_WINDOWS, NAIVE_SEASONS
    from tallyframe.operators import forecast as f

    runs = {f"seasonal_naive_{w}": f.seasonal_naive(train, valid, w) for w in NAIVE_SEASONS[grain]}
    runs |= {f"moving_average_{w}": f.moving_average(train, valid, w) for w in AVERAGE_WINDOWS[grain]}
    runs |= {"drift": f.drift(train, valid), "historical_mean": f.historical_mean(train, valid)}
    measures = metrics.point()
    rows = [metrics.clip_closed(df).agg(measures["wape"].alias("wape"), measures["rmse"].alias("rmse")).select(F.lit(name).alias("model"), "wape", "rmse") for name, df in runs.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def permutation_importance(model: PipelineModel, valid: DataFrame, features: list[str], categories: list[str], rows: int = 15_000, repeats: int = 5, objective: str = "rmse") -> dict[str, float]:
    """How much worse the score gets when a column's values change rows. valid is sampled by a hash of its key, so the work is bounded.

    A column is shuffled by joining two orders of the sample: its own numbering and one by a seeded hash.
    """
    own = valid.orderBy(F.xxhash64("series_id", "date", F.lit(SEED)), "series_id", "date").limit(rows)
    numbered = own.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("series_id", "date"))).cache()
    base = score(predict(model, numbered, features, categories), objective)
    copies = numbered.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))  # all repeats of a column in one pass
    out = {}
    for name in features:
        order = Window.partitionBy("__rep").orderBy(F.xxhash64("series_id", "date", F.col("__rep") + SEED + 1, F.lit(name)), "series_id", "date")
        moved = copies.select("__rep", F.row_number().over(order).alias("__k"), F.col(name).alias("__moved"))
        mixed = copies.join(moved, ["__rep", "__k"]).withColumn(name, F.col("__moved")).drop("__moved")
        scores = predict(model, mixed, features, categories).groupBy("__rep").agg(metrics.objective(objective).alias("s"))
        out[name] = scores.agg(F.avg("s").alias("s")).first().s - base
    numbered.unpersist()
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def eliminate(features: list[str], importance: dict[str, float], evaluate: Callable[[list[str]], float], tolerance: float = 0.02, batch: int = 16) -> tuple[list[str], float, list[dict]]:
    """Greedy backward elimination: the least important features go in batches while the score stays within tolerance of the best.

    A batch that is refused is tried one feature at a time. Passes repeat until one removes nothing. Of all sets seen, the one with the
    least score is returned, with its score and a log of the attempts.
    """
    current = list(features)
    best = evaluate(current)
    log = [{"n_features": len(current), "score": best, "removed": "", "n_removed": 0, "accepted": True}]
    top = (best, current)

    def attempt(gone: list[str]) -> bool:
        nonlocal current, best, top
        rest = [f for f in current if f not in gone]
        if not rest:
            return False
        value = evaluate(rest)
        taken = value <= best * (1 + tolerance)
        log.append({"n_features": len(rest), "score": value, "removed": ";".join(gone), "n_removed": len(gone), "accepted": taken})
        if taken:
            current, best = rest, min(best, value)
            if value < top[0]:
                top = (value, rest)
        return taken

    removed = True
    while removed and len(current) > 1:
        removed = False
        waiting = sorted(current, key=lambda f: (importance.get(f, 0.0), f))
        while waiting and len(current) > 1:
            gone, waiting = waiting[:batch], waiting[batch:]
            if attempt(gone):
                removed = True
            elif len(gone) > 1:
                removed |= any([attempt([f]) for f in gone])
    return top[1], top[0], log


def _proposal(space: dict[str, tuple], log: list[dict], rnd: random.Random, good: float = 0.25, draws: int = 24) -> dict:
    """A tree-structured Parzen estimate: of some draws from the better trials' distribution, the one that they favour most over the rest."""
    ranked = sorted(log, key=lambda r: r["score"])
    cut = max(1, round(good * len(ranked)))

    def shares(trials: list[dict], name: str) -> dict:
        times = {v: 1.0 for v in space[name]}  # one of each, so that no value is ruled out
        for t in trials:
            if t["params"].get(name) in times:
                times[t["params"][name]] += 1
        return {v: n / sum(times.values()) for v, n in times.items()}

    better = {k: shares(ranked[:cut], k) for k in sorted(space)}
    worse = {k: shares(ranked[cut:], k) for k in sorted(space)}
    drawn = [{k: rnd.choices(list(p), list(p.values()))[0] for k, p in better.items()} for _ in range(draws)]
    return max(drawn, key=lambda pick: sum(math.log(better[k][v] / worse[k][v]) for k, v in pick.items()))


def search(space: dict[str, tuple], evaluate: Callable[[dict], float], trials: int, seed: int = SEED, startup: int = 10, seconds: float | None = None) -> tuple[dict, float, list[dict]]:
    """Seeded Bayesian search without repeats: the defaults (no parameters), some random trials, then proposals by what went well.

    It ends after ``trials``, or ``seconds``, or when the space is used up.
    """
    rnd, began = random.Random(seed), time.time()
    seen, log = set(), []
    size = math.prod(map(len, space.values())) if space else 0
    pick: dict = {}
    while True:
        seen.add(tuple(pick.items()))
        log.append({"params": pick, "score": evaluate(pick)})
        if len(log) >= min(trials, size + 1) or seconds is not None and time.time() - began > seconds:
            break
        for tried in itertools.count():
            # a proposal that was tried before gives way to a random one
            pick = {k: rnd.choice(v) for k, v in sorted(space.items())} if len(log) <= startup or tried % 2 else _proposal(space, log, rnd)
            if tuple(pick.items()) not in seen:
                break
    best = min(log, key=lambda r: r["score"])
    return best["params"], best["score"], log


def cross_validated(folds: list[tuple[DataFrame, DataFrame]], features: list[str], categories: list[str], family: str, params: dict, objective: str = "rmse") -> float:
    """Mean score over rolling folds."""
    values = [score(predict(fit(a, features, categories, family, params), b, features, categories), objective) for a, b in folds]
    return sum(values) / len(values)


def final_fit(train: DataFrame, valid: DataFrame, folds: list, features: list[str], categories: list[str], family: str, tuned: dict, objective: str = "rmse", base: dict | None = None) -> tuple[PipelineModel, dict, float]:
    """The tuned parameters if they beat the defaults over the folds, else the defaults; refitted on train and valid. base: of both."""
    base = base or {}
    values = {"default": cross_validated(folds, features, categories, family, base, objective)}
    if tuned:
        values["tuned"] = cross_validated(folds, features, categories, family, base | tuned, objective)
    params = base | (tuned if tuned and values["tuned"] < values["default"] else {})
    return fit(train.unionByName(valid), features, categories, family, params), params, min(values.values())


def training_run(train: DataFrame, valid: DataFrame, folds: list, features: list[str], categories: list[str], profile: Profile, level: int = 1, families: tuple[str, ...] = ("gbt", "forest", "ridge", "tweedie"), trees: int | None = None) -> dict:
    """What a profile asks for: bench, selection, search, and the final fit of the winner.

    folds: rolling (train, validation) pairs; the newest ``profile.folds`` are used. trees: a bound on the profile's trees, for trials.
    """
    objective = objective_of(level)

    def of(family: str, count: int) -> dict:
        count = min(count, trees or count)
        return {"maxIter": count} if family.startswith("gbt") else {"numTrees": count} if family == "forest" else {}

    results = [r for f in families for r in bench(train, valid, features, categories, (f,), objective, of(f, profile.bench_trees))]
    best = winner(results)
    chosen, log, importance = features, [], {}
    if profile.selection:
        evaluate = lambda names: score(predict(fit(train, names, [c for c in categories if c in names], best, of(best, profile.bench_trees)), valid, names, [c for c in categories if c in names]), objective)
        model = fit(train, features, categories, best, of(best, profile.bench_trees))
        importance = permutation_importance(model, valid, features, categories, profile.permutation_rows, profile.permutation_repeats, objective)
        chosen, _, log = eliminate(features, importance, evaluate, profile.tolerance, profile.batch)
    own = [c for c in categories if c in chosen]
    tuned: dict = {}
    if profile.search:
        evaluate_params = lambda p: score(predict(fit(train, chosen, own, best, of(best, profile.search_trees) | p), valid, chosen, own), objective)
        tuned, _, _ = search(FAMILIES[best].space, evaluate_params, profile.trials, seconds=profile.seconds)
    final = of(best, profile.final_trees)
    model, params, value = final_fit(train, valid, folds[-profile.folds :], chosen, own, best, tuned, objective, final)
    return {"family": best, "bench": results, "features": chosen, "importance": importance, "elimination": log, "params": params, "score": value, "model": model}


def feature_importance(model: PipelineModel, features: list[str], categories: list[str]) -> dict[str, float]:
    """A tree model's own importances by feature."""
    order = [c for c in categories if c in features] + [c for c in features if c not in categories]
    values = model.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(order, map(float, values)), key=lambda x: (-x[1], x[0])))


def tabular_inputs(train: DataFrame, df: DataFrame, numbers: list[str], categories: list[str], target: str = "sales") -> DataFrame:
    """df as an embedding network reads it: each category's place in train's sorted values (0 if unknown), numbers with train's median
    for gaps and train's mean and deviation taken out, and the logarithm of the target. A missing category is a value of its own.

    Each column's values in train are one short array, so the places are a lookup and not a join.
    """
    word = {c: F.coalesce(F.col(c), F.lit("__MISSING__")) for c in categories}
    stats = train.agg(*(F.median(c).alias(f"{c}__m") for c in numbers), *(F.sort_array(F.collect_set(word[c])).alias(f"{c}__v") for c in categories))
    filled = train.join(F.broadcast(stats)).agg(*(f(F.coalesce(F.col(c), F.col(f"{c}__m"))).alias(f"{c}__{n}") for c in numbers for n, f in (("a", F.avg), ("d", F.stddev_pop))))
    rows = df.join(F.broadcast(stats)).join(F.broadcast(filled))  # one row each
    codes = [F.array_position(f"{c}__v", word[c]).cast("int").alias(c) for c in categories]
    scaled = [F.coalesce(F.try_divide(F.coalesce(F.col(c), F.col(f"{c}__m")) - F.col(f"{c}__a"), F.col(f"{c}__d")), F.lit(0.0)).alias(c) for c in numbers]
    return rows.select("series_id", "date", *codes, *scaled, F.log1p(F.greatest(target, F.lit(0.0))).alias("target"))
