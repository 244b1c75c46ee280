"""Sessions and retries."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

log = logging.getLogger("pathloom")

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def start_session(app: str = "pathloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | (conf or {})).getOrCreate()


class ResilientRunner:
    """Runs functions of a session; on lost connections it starts a new session and tries again."""

    def __init__(self, make: Callable[[], SparkSession] = start_session, max_restarts: int = 20, active_hours: tuple[int, int] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.make, self.max_restarts, self.active_hours, self.sleep = make, max_restarts, active_hours, sleep
        self.spark: SparkSession | None = None

    def wait_until_active(self, now: datetime | None = None) -> float:
        """Seconds that were waited for the hours in which work may run."""
        if not self.active_hours:
            return 0.0
        first, last = self.active_hours
        now = now or datetime.now()
        inside = first <= now.hour < last if first <= last else now.hour >= first or now.hour < last
        if inside:
            return 0.0
        start = now.replace(hour=first, minute=0, second=0, microsecond=0)
        start += timedelta(days=start <= now)
        self.sleep(wait := (start - now).total_seconds())
        return wait

    def run(self, function: Callable, *args, **kwargs):
        from py4j.protocol import Py4JError, Py4JNetworkError

        for attempt in range(self.max_restarts + 1):
            self.wait_until_active()
            if self.spark is None:
                self.spark = self.make()
            try:
                return function(self.spark, *args, **kwargs)
            except (Py4JNetworkError, Py4JError, ConnectionError):
                log.exception("attempt %d failed", attempt + 1)
                if attempt == self.max_restarts:
                    raise
                try:
                    self.spark.stop()
                except Exception:  # the session may be gone already
                    log.info("the session could not be stopped")
                self.spark = None


def timed(function: Callable) -> Callable:
    """Logs how long a call took."""

    @functools.wraps(function)
    def inner(*args, **kwargs):
        began = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", function.__name__, time.perf_counter() - began)

    return inner


def setup_logger(name: str = "pathloom", level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        handler = logging.FileHandler(path) if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    return logger
