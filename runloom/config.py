"""Settings of a table, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

#: The codecs that runs can be written with.
CODECS = ("uncompressed", "gzip", "lz4", "snappy", "zstd")


@dataclass(frozen=True)
class TableConfig:
    """All sizes are in bytes. ``compaction_ratio`` is how many more runs each deeper level holds.

    ``data_block_size`` is a Parquet page, ``run_partition_bytes`` a row group, ``block_cache_size`` the most that
    a view kept by Store.cache() may hold.
    """

    memtable_threshold: int = 1 << 20
    data_block_size: int = 4096
    bloom_false_positive_rate: float = 0.01
    compression: str = "zstd"
    block_cache_size: int = 64 << 20
    enable_block_cache: bool = True
    level0_trigger: int = 4
    compaction_ratio: float = 10.0
    max_levels: int = 7
    run_partition_bytes: int = 128 << 20

    def __post_init__(self) -> None:
        for name in ("memtable_threshold", "data_block_size", "level0_trigger", "max_levels", "run_partition_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.bloom_false_positive_rate < 1:
            raise ValueError("bloom_false_positive_rate must lie between 0 and 1")
        if self.block_cache_size < 0:
            raise ValueError("block_cache_size must not be negative")
        if self.compaction_ratio <= 1:
            raise ValueError("compaction_ratio must be over 1")
        if self.compression not in CODECS:
            raise ValueError(f"compression must be one of {', '.join(CODECS)}")

    def trigger(self, level: int) -> int:
        """Runs from which a level is merged into the next."""
        return self.level0_trigger if level == 0 else int(self.compaction_ratio) ** level
