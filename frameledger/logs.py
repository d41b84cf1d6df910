"""Logging without secrets."""

from __future__ import annotations

import logging
import re
import sys
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose values are secret.
SECRET = r"token|secret|password|authorization|bearer|api_key"
REDACTED = "<redacted>"
_PAIR = re.compile(rf"(?i)([\w-]*(?:{SECRET})[\w-]*)(['\"]?\s*[=:]\s*['\"]?)(?:bearer\s+)?([^\s'\",;}}]+)")


def redacted(event: dict[str, Any]) -> dict[str, Any]:
    """event with the values of secret keys replaced, at any depth of mappings."""
    hide = lambda k, v: REDACTED if re.search(SECRET, str(k), re.IGNORECASE) else redacted(v) if isinstance(v, dict) else v
    return {k: hide(k, v) for k, v in event.items()}


def redacted_value(key: Column, value: Column) -> Column:
    """The same for rows of keys and values."""
    return F.when(key.rlike(f"(?i){SECRET}"), F.lit(REDACTED)).otherwise(value)


class SecretFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        if isinstance(record.args, dict):
            record.args = redacted(record.args)
        record.msg, record.args = _PAIR.sub(rf"\1\2{REDACTED}", record.getMessage()), None
        return True


def configure(level: str = "WARNING") -> None:
    """Log lines of this library to stderr."""
    log = logging.getLogger("frameledger")
    log.handlers = [logging.StreamHandler(sys.stderr)]
    log.handlers[0].addFilter(SecretFilter())
    log.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log.setLevel(level)
