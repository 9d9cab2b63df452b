import logging

from voxelloom.logs import configure_logging


def test_handlers_are_added_once(tmp_path):
    path = tmp_path / "run.log"
    logger = configure_logging(str(path))
    assert configure_logging(str(path), logging.DEBUG) is logger and len(logger.handlers) == 2
    logger.debug("a line")
    assert path.read_text().endswith("voxelloom: a line\n")
    for handler in list(logger.handlers):
        handler.close()
        logger.removeHandler(handler)
