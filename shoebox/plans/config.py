"""Settings that queries depend on, each forced into its range."""

from __future__ import annotations

from dataclasses import dataclass

# Limits of pages and requests.
PAGE = (1, 200)
CLUSTERS = (1, 50)
CANDIDATES = (1, 300)
BULK = 500
MARKER_FILES = 200
STALE_SECONDS = 180
CLEANUP_SECONDS = 300
MAX_FAILURES = 5
KIB, MIB = 1 << 10, 1 << 20


def clamp(value, least, most):
    return max(least, min(most, value))


def page_of(limit: int, offset: int) -> tuple[int, int]:
    return clamp(int(limit), *PAGE), max(0, int(offset))


def normal_scope(scope: str | None) -> str:
    """``photos`` is the only narrow scope; anything else means all."""
    return "photos" if scope == "photos" else "all"


@dataclass(frozen=True)
class EngineConfig:
    """Values out of range are moved to its nearer end, as all readers expect."""

    ml_enabled: bool = False
    ml_retries: int = 1
    ml_timeout_seconds: int = 15
    ml_max_file_bytes: int = 12 * MIB
    ml_min_confidence: float = 0.45
    people_max_file_bytes: int = 50 * MIB
    people_min_face_confidence: float = 0.35
    people_min_similarity: float = 0.74
    people_min_margin: float = 0.01
    exif_read_bytes: int = 2 * MIB
    embedding_dims: int = 128
    min_face_size: int = 48

    # The range of each setting.
    RANGES = {
        "ml_retries": (0, 3),
        "ml_timeout_seconds": (2, 120),
        "ml_max_file_bytes": (512 * KIB, 100 * MIB),
        "ml_min_confidence": (0.0, 1.0),
        "people_max_file_bytes": (512 * KIB, 100 * MIB),
        "people_min_face_confidence": (0.0, 1.0),
        "people_min_similarity": (0.5, 0.99),
        "people_min_margin": (0.0, 0.2),
        "exif_read_bytes": (256 * KIB, 16 * MIB),
        "embedding_dims": (32, 128),
        "min_face_size": (24, 1 << 30),
    }

    def __post_init__(self) -> None:
        for name, (least, most) in self.RANGES.items():
            object.__setattr__(self, name, clamp(getattr(self, name), least, most))
