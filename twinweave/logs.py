"""A daily log file, seven of which are kept."""

from __future__ import annotations

import logging
import os
from logging.handlers import TimedRotatingFileHandler

KEPT = 7


def log_to(folder: str, name: str = "twinweave", level: int = logging.INFO) -> logging.Logger:
    """The package's logger, writing to a file that is begun anew each day; a second call for a folder changes nothing."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.abspath(os.path.join(folder, f"{name}.log"))
    logger = logging.getLogger(name)
    if not any(getattr(h, "baseFilename", None) == path for h in logger.handlers):
        handler = TimedRotatingFileHandler(path, when="midnight", backupCount=KEPT, encoding="utf-8", utc=True)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
