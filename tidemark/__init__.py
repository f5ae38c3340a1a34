"""Version change, reference data and audit jobs for whole fleets of schemas."""

from tidemark.session import build_session

__all__ = ["build_session"]
