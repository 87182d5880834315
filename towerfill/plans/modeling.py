"""Model training (N2-N6) and the model registry (K3).

Two models per target: ALL on every selected feature and TIME on the calendar
features.  There are two families.  The MLlib pipelines (``rf``, ``gbt``) refuse NaN
(T20), so their ALL trains on the rows whose ALL features are all present; rows that
lack one are filled by TIME anyway (M6).  The histogram trees of
:mod:`towerfill.plans.trees` (``xgboost``: regularised boosting, ``forest``) learn
where missing features go, so their ALL trains on every row that has a target, and
can score rows that lack features.  Hyperparameters default to the reference's
effective constants and ``params`` really overrides them (T21).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.plans.features import FeatureSpec
from towerfill.plans.trees import FOREST_DEFAULTS, TreeModel, fit_trees
from towerfill.session import cut_lineage

# Effective constants of the reference's two model types.
RF_DEFAULTS = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="sqrt",
                   bootstrap=True, seed=42)
# Execution knobs (same trees, fewer passes over the data): bigger node groups per pass and
# cached node ids, so deep levels do not re-walk every tree from the root.
RF_EXEC = dict(maxMemoryInMB=1024, cacheNodeIds=True)
GBT_EXEC = dict(cacheNodeIds=True)
GBT_DEFAULTS = dict(maxIter=100, stepSize=0.05, maxDepth=4, minInstancesPerNode=3, subsamplingRate=0.7,
                    featureSubsetStrategy="0.7", seed=42)


#: MLlib's tasks read their cached rows whole in every pass (some 800 bytes a row with 100 trees): rows of one task.
ROWS_PER_TASK = 500_000

#: Defaults of the model types whose trees accept missing features.
TREE_TYPES = {"xgboost": {}, "boosted": {}, "forest": FOREST_DEFAULTS}


def all_present(cols: Sequence[str], df: DataFrame):
    """Every column non-null (and not NaN for floating columns)."""
    cond = F.lit(True)
    for c in cols:
        x = F.col(f"`{c}`")
        ok = x.isNotNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            ok = ok & ~F.isnan(x)
        cond = cond & ok
    return cond


def make_regressor(model_type: str, label: str, features_col: str, pred_col: str,
                   params: Mapping | None = None):
    t = model_type.lower()
    if t in ("rf", "random forest", "random_forest"):
        return RandomForestRegressor(labelCol=label, featuresCol=features_col, predictionCol=pred_col,
                                     checkpointInterval=10, **{**RF_DEFAULTS, **RF_EXEC, **(params or {})})
    if t in ("gbt", "gradient boosting"):
        return GBTRegressor(labelCol=label, featuresCol=features_col, predictionCol=pred_col,
                            checkpointInterval=10, **{**GBT_DEFAULTS, **GBT_EXEC, **(params or {})})
    raise ValueError(f"unknown model type {model_type!r}")


@dataclass
class TrainedModels:
    model_type: str
    target: str
    all_features: list[str]
    time_features: list[str]
    model_all: PipelineModel | TreeModel | None
    model_time: PipelineModel | TreeModel
    spec: FeatureSpec
    encoding: dict
    params: dict = field(default_factory=dict)

    @property
    def accepts_missing(self) -> bool:
        """Whether ALL can score rows that lack some of its features."""
        return isinstance(self.model_all, TreeModel)

    def metadata(self) -> dict:
        return dict(model_type=self.model_type, target=self.target, all_features=self.all_features,
                    time_features=self.time_features, has_all=self.model_all is not None, trees=isinstance(self.model_time, TreeModel),
                    spec=self.spec.to_json(), encoding=self.encoding, params=self.params)


def _pipeline(model_type, target, feats, tag, params):
    va = VectorAssembler(inputCols=list(feats), outputCol=f"_f_{tag}", handleInvalid="keep")
    return Pipeline(stages=[va, make_regressor(model_type, target, f"_f_{tag}", f"_pred_{tag}", params)])


def train_models(features: DataFrame, target: str, all_features: Sequence[str], time_features: Sequence[str],
                 spec: FeatureSpec, encoding: Mapping, model_type: str = "rf",
                 params: Mapping | None = None, materialize: bool = True) -> TrainedModels:
    """N2-N6 for one target: drop null targets (P10), fit ALL and TIME.

    ``materialize`` writes the training rows to the checkpoint folder first (both fits
    and the count reuse them, and a lost executor does not recompute the feature
    windows); pass False when ``features`` is already a written table."""
    rows = features.filter(F.col(target).isNotNull()).select(target, *sorted(set(all_features) | set(time_features)))
    if materialize:
        rows = cut_lineage(rows, "train")
    # Drop ALL features with no value among the training rows (one small aggregate).
    n, *counts = rows.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in all_features]).first()
    feats = [c for c, present in zip(all_features, counts) if present > 0]
    complete = rows.filter(all_present(feats, rows))
    tfeats = list(time_features)
    if model_type.lower() in TREE_TYPES:
        both = {**TREE_TYPES[model_type.lower()], **(params or {})}
        sets = [(feats, "_pred_all"), (tfeats, "_pred_time")][0 if feats else 1:]
        with ThreadPoolExecutor(max_workers=2) as pool:
            fitted = list(pool.map(lambda x: fit_trees(rows, target, x[0], both, x[1]), sets))
        return TrainedModels(model_type, target, feats, tfeats, fitted[0] if feats else None, fitted[-1], spec, dict(encoding),
                             dict(params or {}))
    fit_all = bool(feats) and complete.limit(1).count() > 0
    # Parts of equal size: as many as bound a task's rows, and one for every core at least.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    # The two fits are independent: submit them from two driver threads so their
    # jobs share the cluster instead of running one after the other.
    with ThreadPoolExecutor(max_workers=2) as pool:
        fut_all = pool.submit(_pipeline(model_type, target, feats, "all", params).fit, complete.select(target, *feats).repartition(parts)) if fit_all else None
        fut_time = pool.submit(_pipeline(model_type, target, tfeats, "time", params).fit, rows.select(target, *tfeats).repartition(parts))
        model_all = fut_all.result() if fut_all else None
        model_time = fut_time.result()
    return TrainedModels(model_type, target, feats, tfeats, model_all, model_time, spec, dict(encoding),
                         dict(params or {}))


def train_targets(features: DataFrame, targets: Sequence[str], feature_sets: Mapping[str, tuple[list, list]],
                  spec: FeatureSpec, encoding: Mapping, model_type: str = "rf",
                  params: Mapping | None = None) -> dict[str, TrainedModels]:
    """Models for several targets from one feature frame (built for all of them, T22).

    ``feature_sets`` maps each target to its (ALL, TIME) feature lists.  Each fit is a
    distributed MLlib job; the loop only walks the (few) targets."""
    from towerfill.session import cut_lineage
    feats = cut_lineage(features, "train-features")
    return {t: train_models(feats, t, *feature_sets[t], spec, encoding, model_type, params, materialize=False)
            for t in targets}


class ModelRegistry:
    """K3: model pairs under ``root/{type}/{target}``; lookup by exact ``(type, target)`` (T16: no suffix matching).

    A save writes ALL, TIME and the metadata into a folder of its own under ``versions``
    that nothing ever writes again, and then commits it: a small file that names the
    version is renamed into ``commits``. Readers follow the last commit, so they see
    one whole save or the one before it, never parts of two; a save that stops half-way
    leaves a folder that no commit names. Of two savers at one time both versions stay and
    the later name counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _dir(self, model_type: str, target: str) -> str:
        return f"{self.root}/{model_type.lower()}/{target}"

    def _files(self, path: str):
        """The file system and Hadoop path of ``path``."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commits(self, model_type: str, target: str) -> list[str]:
        """The names of the commits, oldest first: a number, and the version they name."""
        files, path = self._files(f"{self._dir(model_type, target)}/commits")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def save(self, tm: TrainedModels) -> str:
        d, version = self._dir(tm.model_type, tm.target), uuid.uuid4().hex
        at = f"{d}/versions/{version}"
        for model, name in ((tm.model_all, "ALL"), (tm.model_time, "TIME")):
            if isinstance(model, TreeModel):
                model.save(self.spark, f"{at}/{name}")
            elif model is not None:
                model.save(f"{at}/{name}")
        meta = json.dumps({**tm.metadata(), "saved_at": time.time()})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{at}/metadata")
        self._commit(d, version, self.commits(tm.model_type, tm.target))
        return f"{tm.model_type}_{tm.target}"

    def _commit(self, d: str, version: str, before: list[str]) -> None:
        number = int(before[-1].split("-")[0]) + 1 if before else 0
        files, draft = self._files(f"{d}/commits/_{version}")
        files.create(draft).close()
        if not files.rename(draft, self._files(f"{d}/commits/{number:012d}-{version}")[1]):
            raise OSError(f"could not commit {version} under {d}")

    def exists(self, model_type: str, target: str) -> bool:
        return bool(self.commits(model_type, target))

    def _metadata(self, at: str) -> dict:
        return json.loads(self.spark.read.text(f"{at}/metadata").first()[0])

    def _version(self, model_type: str, target: str, commit: str | None = None) -> str:
        commits = self.commits(model_type, target)
        if not commits or (commit is not None and commit not in commits):
            raise KeyError(f"no model of type {model_type!r} for target {target!r}")
        return f"{self._dir(model_type, target)}/versions/{(commit or commits[-1]).split('-')[1]}"

    def latest(self, target: str, model_types: Sequence[str] = ("rf", "gbt", "xgboost", "forest")) -> TrainedModels:
        """The newest saved model pair for ``target`` when no type is given."""
        found = [(self._metadata(self._version(t, target))["saved_at"], t) for t in model_types if self.exists(t, target)]
        if not found:
            raise KeyError(f"no model for target {target!r}")
        return self.load(max(found)[1], target)

    def load(self, model_type: str, target: str, commit: str | None = None) -> TrainedModels:
        """The last committed pair, or that of an older ``commit`` (a name of :meth:`commits`)."""
        at = self._version(model_type, target, commit)
        meta = self._metadata(at)
        read = (lambda p: TreeModel.load(self.spark, p)) if meta["trees"] else PipelineModel.load
        return TrainedModels(meta["model_type"], meta["target"], meta["all_features"], meta["time_features"],
                             read(f"{at}/ALL") if meta["has_all"] else None, read(f"{at}/TIME"), FeatureSpec(**meta["spec"]),
                             meta["encoding"], meta["params"])
