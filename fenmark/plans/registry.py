"""Assessments and assignments by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from fenmark.operators import overlay


class Assessment(Protocol):
    """Gives named results for sites; catalog is anything that an assessment reads its layers from."""

    def __call__(self, spark: SparkSession, sites: DataFrame, catalog: object) -> dict[str, DataFrame]: ...


class Sink(Protocol):
    """Takes the named results of one run."""

    def __call__(self, results: dict[str, DataFrame], run: str) -> None: ...


class Validator(Protocol):
    """Gives what is wrong with sites; nothing if all is right."""

    def __call__(self, sites: DataFrame) -> list[str]: ...


class Registry:
    """Assessments by name, each behind the validators that it needs."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Assessment, list[Validator]]] = {}

    def add(self, name: str, assessment: Assessment, validators: list[Validator] | None = None) -> None:
        self.known[name] = assessment, list(validators or [])

    def run(self, name: str, spark: SparkSession, sites: DataFrame, catalog: object, sinks: list[Sink] | None = None, run: str = "") -> dict[str, DataFrame]:
        """The results of one assessment, handed to each sink. An unknown name is a KeyError; bad sites, an assessment that fails, and
        results that are no frames are a ValueError."""
        if name not in self.known:
            raise KeyError(f"unknown assessment: {name}")
        assessment, validators = self.known[name]
        if wrong := [e for v in validators for e in v(sites)]:
            raise ValueError("; ".join(wrong))
        try:
            found = assessment(spark, sites, catalog)
        except Exception as e:
            raise ValueError(f"assessment {name} failed") from e
        if not isinstance(found, dict) or not all(isinstance(df, DataFrame) for df in found.values()):
            raise ValueError(f"assessment {name} must give a dict of frames")
        for sink in sinks or []:
            sink(found, run)
        return found


def _majority(left: DataFrame, layer: DataFrame, attr: str, fid: str, key: str, name: str, default: object = None, touching: bool = True) -> DataFrame:
    return overlay.majority_overlap(left, {name: (layer, attr, fid, default)}, key, touching)


def _intersection(left: DataFrame, layer: DataFrame, attr: str, fid: str, key: str, name: str, grid: float | None = None) -> DataFrame:
    return overlay.overlay_intersection(left, layer.selectExpr(f"`{attr}` AS `{name}`", "geom AS r_geom"), grid)


ASSIGNMENTS: dict[str, Callable[..., DataFrame]] = {"majority_overlap": _majority, "any_intersection": overlay.any_intersection, "nearest": overlay.nearest, "intersection": _intersection}


def assign(kind: str, left: DataFrame, layer: DataFrame, attr: str, fid: str, key: str, name: str, **more: object) -> DataFrame:
    """left with column `name` from layer's attr by one of ASSIGNMENTS; an unknown kind is a ValueError."""
    if kind not in ASSIGNMENTS:
        raise ValueError(f"unknown assignment: {kind}; known: {', '.join(ASSIGNMENTS)}")
    return ASSIGNMENTS[kind](left, layer, attr, fid, key, name, **more)
