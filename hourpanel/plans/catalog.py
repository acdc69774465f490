"""All registered queries; importing a ``queries_*`` module registers its own."""

from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as _here
from .registry import REGISTRY, Query


def load() -> dict[str, Query]:
    for info in sorted(pkgutil.iter_modules(_here), key=lambda m: m.name):
        if info.name.startswith("queries_"):
            importlib.import_module(f"{__package__}.{info.name}")
    return REGISTRY
