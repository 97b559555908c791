"""panelloom: daily-count panel analytics written as PySpark DataFrame operators.

Every operator is ``(DataFrame..., config) -> DataFrame`` and lazy; see README.md for the map.
"""

from panelloom.config import (
    AnomalyConfig,
    Columns,
    EndemicConfig,
    FeatureConfig,
    ForecastConfig,
    IngestConfig,
    PanelConfig,
    ReportConfig,
    RiskConfig,
)

__all__ = [
    "AnomalyConfig",
    "Columns",
    "EndemicConfig",
    "FeatureConfig",
    "ForecastConfig",
    "IngestConfig",
    "PanelConfig",
    "ReportConfig",
    "RiskConfig",
]
