"""All named queries; importing the modules fills the registry."""

from . import (  # noqa: F401
    cleaning, etl, exploring, grouping, joining, modelling, scanning, seriesops, streams,
)
from .registry import ORACLES, QUERIES  # noqa: F401
