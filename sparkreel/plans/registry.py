"""All queries of the library by name, with their SQL counterparts."""

from __future__ import annotations

from sparkreel.plans import charts, claimwork, filework, frames, layouts, mediawork, messages, output, picture, pixels, scanwork, sequence, shapes, sheetwork, written  # noqa: F401  (they register their queries)
from sparkreel.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
