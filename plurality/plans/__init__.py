"""Registered queries: each wires library operators to the stand-in views."""

from importlib import import_module
from importlib.util import find_spec

MODULES = ("rows", "gates", "groups", "ranking", "resampling", "temporal", "spectral", "splits",
           "joins", "scans", "perturbation", "modelling", "releases")


def load_all() -> None:
    for name in MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
