"""Find, mask and verify sensitive data in document collections with Spark."""

from inkveil.plans.options import RedactOptions

__all__ = ["RedactOptions"]
