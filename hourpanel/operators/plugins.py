"""User extensions: correction and monitor functions run by name and order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Named DataFrame functions kept in order of registration.

    ``validate`` may raise on a frame the function cannot handle.
    """

    entries: dict[str, tuple[Transform, Callable[[DataFrame], None] | None]] = field(default_factory=dict)

    def register(self, name: str, fn: Transform, validate: Callable[[DataFrame], None] | None = None, replace: bool = False) -> None:
        if not name:
            raise ValueError("a plug-in needs a name")
        if name in self.entries and not replace:
            raise ValueError(f"plug-in {name!r} is already registered")
        self.entries[name] = (fn, validate)

    def unregister(self, name: str) -> None:
        if name not in self.entries:
            raise KeyError(name)
        del self.entries[name]

    def names(self) -> list[str]:
        return list(self.entries)

    def _pick(self, names: Sequence[str] | None):
        chosen = self.names() if names is None else list(names)
        unknown = [n for n in chosen if n not in self.entries]
        if unknown:
            raise KeyError(f"unknown plug-ins: {unknown}")
        return [(n, *self.entries[n]) for n in chosen]


class Corrections(Registry):
    def run(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Corrections in order; each sees the output of the one before."""
        for _, fn, validate in self._pick(names):
            if validate:
                validate(df)
            df = df.transform(fn)
        return df


class Monitors(Registry):
    def run(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Stacked (monitor, metric, value) rows; monitors return (metric, value) frames, keys are kept."""
        out = None
        for name, fn, validate in self._pick(names):
            if validate:
                validate(df)
            part = fn(df).withColumn("monitor", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no monitor registered")
        return out


def run_pipeline(
    sources: Sequence[DataFrame], corrections: Corrections, monitors: Monitors | None = None, write: Callable[[DataFrame], None] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Union the sources, correct, monitor, write."""
    from ..sources.adapters import union_manifest

    fixed = corrections.run(union_manifest(sources))
    report = monitors.run(fixed) if monitors and monitors.names() else None
    if write:
        write(fixed)
    return fixed, report
