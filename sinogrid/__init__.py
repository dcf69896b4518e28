"""DataFrame operators for keyed record streams and detector streams."""

from sinogrid.config import KvConfig, TomoConfig

__all__ = ["KvConfig", "TomoConfig"]
