"""Named loggers on standard output: core, runtime, backend and compiler; set up once."""

from __future__ import annotations

import logging
import sys

NAMES = ("core", "runtime", "backend", "compiler")


def setup(level: int | str = logging.INFO) -> dict[str, logging.Logger]:
    out = {}
    for name in NAMES:
        logger = logging.getLogger(f"strataflow.{name}")
        logger.setLevel(level)
        if not logger.handlers:
            handler = logging.StreamHandler(sys.stdout)
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            logger.addHandler(handler)
            logger.propagate = False
        out[name] = logger
    return out
