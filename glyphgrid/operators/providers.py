"""Functions from outside as steps on tables: annotators, reward backends, mappers, evaluators. What they compute is theirs; this fixes schemas, order and failures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a text spotter returns for an image.
SPOTTED = "file_name string, ord long, text string, bbox array<double>, score double"


def provided(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``call`` on Arrow batches of the rows, one after the other; its result must have the schema's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(call, batches)

    return df.mapInPandas(run, schema)


def spotted(images: DataFrame, spot: Callable[[str], Iterable[tuple[str, list[float], float]]]) -> DataFrame:
    """Annotations (SPOTTED) of images (file_name): ``spot`` gives text, box and score of each word; an image without any gives no row."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(name, k, *word) for name in batch["file_name"] for k, word in enumerate(spot(name))]
        return pd.DataFrame(rows, columns=["file_name", "ord", "text", "bbox", "score"])

    return provided(images.select("file_name"), call, SPOTTED)


def recognised(crops: DataFrame, has_text: Callable[[str], bool], read: Callable[[str], str], empty: str = "") -> DataFrame:
    """Crops (path, may be null) with has_text and VLM: a crop is read only if the first stage finds text in it. Crops without a path go."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        found = [bool(has_text(p)) for p in batch["path"]]
        return batch.assign(has_text=found, VLM=[read(p) if ok else empty for p, ok in zip(batch["path"], found, strict=True)])

    kept = crops.where("path IS NOT NULL")
    return provided(kept, call, kept.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", has_text boolean, VLM string")


def classified(images: DataFrame, path: str, classify: Callable[[str], str], failed: str = "Error: Processing Failed") -> DataFrame:
    """Adds label: a failure of the classifier is a label of its own, never a lost row."""

    def safe(p: str) -> str:
        try:
            return classify(p)
        except Exception:  # whatever an outside model raises
            return failed

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(label=[safe(p) for p in batch[path]])

    return provided(images, call, images.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", label string")


def constant_rewards(value: float) -> Callable[[DataFrame], DataFrame]:
    """A backend that gives every image one reward."""
    return lambda images: images.select("image_id").withColumn("reward", F.lit(float(value)))


def matched_rewards(rows: DataFrame, variant: str) -> Callable[[DataFrame], DataFrame]:
    """A backend that takes a variant of composed rewards (image_id, variant); an image without any has 0."""
    return lambda images: images.select("image_id").join(rows.select("image_id", F.col(variant).alias("reward")), "image_id", "left").na.fill(0.0, ["reward"])


def reward_backend(name: str, **options: object) -> Callable[[DataFrame], DataFrame]:
    """The backend of that name; another name raises."""
    backends = {"constant": constant_rewards, "matched": matched_rewards}
    if name not in backends:
        raise ValueError(f"no reward backend {name!r}")
    return backends[name](**options)


def mapped_rows(df: DataFrame, key: str, value: str, mapper: Callable[[str], str | None]) -> DataFrame:
    """Adds mapped, what ``mapper`` makes of the value; rows for which it gives None go (no other row is drawn in their place)."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(mapped=[mapper(v) for v in batch[value]])

    own = df.select(key, F.col(value).cast("string").alias(value))
    return provided(own, call, f"`{key}` {dict(own.dtypes)[key]}, `{value}` string, mapped string").where("mapped IS NOT NULL")


def in_sequence(df: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Results that came in any order, back in the order of what they were asked for; a missing one stays as a null."""
    return df.join(results, order, "left").orderBy(order)


@dataclass
class Evaluation:
    """An evaluator: ``partial`` turns rows into partial sums by key, ``final`` the merged sums into measures. ``process`` takes any number of tables, ``evaluate`` merges them."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    parts: list[DataFrame] = field(default_factory=list)

    def reset(self) -> None:
        self.parts = []

    def process(self, rows: DataFrame) -> None:
        self.parts.append(self.partial(rows))

    def evaluate(self) -> DataFrame:
        if not self.parts:
            raise ValueError("nothing was processed")
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return self.merge(out)


@dataclass
class Evaluations:
    """Several evaluators over the same tables; ``evaluate`` gives (evaluator, measure, value) of all."""

    members: dict[str, Evaluation]

    def reset(self) -> None:
        for e in self.members.values():
            e.reset()

    def process(self, rows: DataFrame) -> None:
        for e in self.members.values():
            e.process(rows)

    def evaluate(self) -> DataFrame:
        out = None
        for name, e in self.members.items():
            measures = e.evaluate()
            pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures.columns])
            rows = measures.select(F.lit(name).alias("evaluator"), F.inline(pairs))
            out = rows if out is None else out.unionByName(rows)
        return out
