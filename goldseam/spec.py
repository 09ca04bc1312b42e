"""Source descriptors, service levels, and naming rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Audit columns and control tables, as the reference names them.
AUDIT_COLUMNS = ("_ingested_at", "_source_name", "_pipeline_run_id")
DEAD_LETTER_TABLE = "DEAD_LETTER"
WATERMARK_TABLE = "INGESTION_WATERMARKS"
LAYERS = ("bronze", "silver", "gold")
SOURCE_TYPES = ("csv", "sqlite", "jdbc", "api_json")

# Thresholds of the reference.
NULLABLE_THRESHOLD = 0.05
DEAD_LETTER_MAX_PCT = 5.0
RETENTION_DAYS = 90
MIN_ROWS = {
    "historical_results": 45000,
    "historical_goals": 1000,
    "historical_shootouts": 100,
    "worldcup_api": 1,
    "national_teams": 48,
    "player_profiles": 1248,
}


@dataclass(frozen=True)
class SourceSpec:
    """One source: where it lies and which Bronze tables it fills."""

    source_name: str
    source_type: str
    location: str
    db_table: str | None = None
    table_name: str | None = None
    secondary_table_name: str | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.source_type not in SOURCE_TYPES:
            raise ValueError(f"unknown source type {self.source_type!r}; known: {SOURCE_TYPES}")
        if self.source_type in ("sqlite", "jdbc") and not self.db_table:
            raise ValueError(f"{self.source_name}: a database source needs db_table")

    @property
    def target(self) -> str:
        return self.table_name or bronze_table_name(self.source_name)

    @property
    def secondary_target(self) -> str:
        return self.secondary_table_name or bronze_table_name(self.source_name, secondary=True)


@dataclass(frozen=True)
class Slo:
    """Service levels of one source."""

    min_rows: int = 0
    max_dead_pct: float = DEAD_LETTER_MAX_PCT


def slo_for(source_name: str) -> Slo:
    return Slo(min_rows=MIN_ROWS.get(source_name, 0))


def column_name(name: str) -> str:
    """Bronze column name: upper case, with space, hyphen and dot as ``_``."""
    return name.upper().translate(str.maketrans(" -.", "___"))


def bronze_table_name(source_name: str, secondary: bool = False) -> str:
    return f"RAW_{column_name(source_name)}" + ("_SECONDARY" if secondary else "")


def staging_model_name(source_name: str) -> str:
    return "stg_" + source_name.lower().translate(str.maketrans(" -", "__"))


def qualified_name(table: str, catalog: str = "spark_catalog", layer: str = "bronze") -> str:
    """Complete a bare or two-part table name; a three-part name stays."""
    parts = table.split(".")
    if len(parts) >= 3:
        return table
    return ".".join([catalog, *([layer] if len(parts) == 1 else []), *parts])
