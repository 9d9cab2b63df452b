"""Messages of the package to the console and to a file."""

from __future__ import annotations

import logging

NAME = "voxelloom"
LINE = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def configure_logging(log_file: str | None = "voxelloom.log", level: int = logging.INFO) -> logging.Logger:
    """The package's logger with one console and at most one file handler;
    calling again changes the level and adds nothing."""
    logger = logging.getLogger(NAME)
    logger.setLevel(level)
    kinds = {type(h) for h in logger.handlers}
    wanted: list[logging.Handler] = []
    if logging.StreamHandler not in kinds:
        wanted.append(logging.StreamHandler())
    if log_file and logging.FileHandler not in kinds:
        wanted.append(logging.FileHandler(log_file, delay=True))
    for handler in wanted:
        handler.setFormatter(logging.Formatter(LINE))
        logger.addHandler(handler)
    return logger
