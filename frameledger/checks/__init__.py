"""The sixteen integrity checks; importing this package registers them in report order."""

from frameledger.checks import semantic, statistical, structural, temporal, video  # noqa: F401
from frameledger.checks.engine import Check, CheckContext, CheckEngine, CheckRegistry, registry

__all__ = ["Check", "CheckContext", "CheckEngine", "CheckRegistry", "registry"]
