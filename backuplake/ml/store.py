"""Versions of trained models: load or train, and retraining with a champion and a challenger.

A model is saved to a folder of its own first; it becomes version n when the small file `versions/n.json` is put there,
complete and only if there is none. So of several writers that reach for one version one wins, the others take what won,
and a version never changes. Old versions stay and can be loaded.

Models are Spark ML pipelines. What is on the driver is one record per version. Quality is measured on rows that training
never saw (`holdout`), by root mean square error: less is better.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.sources.committed import _store, put_if_absent

Train = Callable[[DataFrame], PipelineModel]


@dataclass
class Version:
    number: int
    folder: str
    rows: int
    error: float


@dataclass
class Retrained:
    """What a round of retraining found and did."""

    drifted: bool
    promoted: bool
    version: Version
    champion_error: float
    challenger_error: float | None


class ModelStore:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}"
        self.files, self.top = _store(self.root)

    def versions(self) -> list[Version]:
        """All versions, oldest first."""
        from pyarrow import fs

        found = []
        for info in self.files.get_file_info(fs.FileSelector(f"{self.top}/versions", allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as f:
                    found.append(Version(**json.loads(f.read())))
        return sorted(found, key=lambda v: v.number)

    def current(self) -> Version | None:
        return (self.versions() or [None])[-1]

    def load(self, number: int | None = None) -> PipelineModel:
        """The model of a version, or of the newest."""
        found = {v.number: v for v in self.versions()}
        if not found or (number is not None and number not in found):
            raise KeyError(f"no version {number or 1} below {self.root}")
        return PipelineModel.load(found[number or max(found)].folder)

    def put(self, model: PipelineModel, number: int, rows: int, error: float) -> Version | None:
        """Makes the model version `number`; None if another writer did so first."""
        version = Version(number, f"{self.root}/models/{uuid.uuid4().hex}", rows, error)
        model.write().save(version.folder)
        done = put_if_absent(self.files, f"{self.top}/versions", f"{number}.json", json.dumps(asdict(version)).encode())
        return version if done else None

    def load_or_train(self, history: DataFrame, train: Train, label: str, prediction: str, holdout: Column) -> tuple[PipelineModel, Version] | None:
        """The newest model; without one it is trained on `history` and becomes the first version.

        None if there is neither a model nor a row to train on: predictions then are the defaults of untrained models.
        """
        now = self.current()
        if now is None:
            parts = _split(history, label, holdout)
            if not parts:
                return None
            model = train(parts[0])
            now = self.put(model, 1, parts[2], rmse(model, parts[1], label, prediction))
            if now:
                return model, now
            now = self.current()
        return PipelineModel.load(now.folder), now

    def retrain(
        self, recent: DataFrame, train: Train, label: str, prediction: str, holdout: Column, drift: float = 1.25, gain: float = 0.98
    ) -> Retrained | None:
        """Trains a challenger where the newest model has drifted, and promotes it if it is better.

        Drifted: its error on the recent rows held out is more than `drift` times what it was when it was promoted.
        Better: the challenger's error on the same rows is below `gain` times the champion's. None without a model or rows.
        """
        champion = self.current()
        parts = champion and _split(recent, label, holdout)
        if not parts:
            return None
        error = rmse(PipelineModel.load(champion.folder), parts[1], label, prediction)
        if error <= drift * champion.error:
            return Retrained(False, False, champion, error, None)
        model = train(parts[0])
        challenge = rmse(model, parts[1], label, prediction)
        promoted = self.put(model, champion.number + 1, parts[2], challenge) if challenge < gain * error else None
        return Retrained(True, promoted is not None, promoted or self.current(), error, challenge)


def _split(history: DataFrame, label: str, holdout: Column) -> tuple[DataFrame, DataFrame, int] | None:
    """Rows to train on, rows held out, and how many the first are; None if either is empty."""
    known = history.filter(F.col(label).isNotNull())
    train, held = known.filter(~holdout), known.filter(holdout)
    rows = train.count()
    return (train, held, rows) if rows and not held.isEmpty() else None


def rmse(model: PipelineModel, rows: DataFrame, label: str, prediction: str) -> float:
    square = F.pow(F.col(prediction) - F.col(label), 2)
    return float(model.transform(rows).agg(F.sqrt(F.avg(square))).first()[0])
