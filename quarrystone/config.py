"""Settings, with the limits in force where a value is out of range and the defaults where it is missing."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any, Self


class _FromDict:
    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Self:
        """Reads known keys; missing ones get their defaults and unknown ones are ignored."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})  # type: ignore[arg-type]


@dataclass(frozen=True)
class ChunkingConfig(_FromDict):
    max_chunk_bytes: int = 8192
    overlap_bytes: int = 64
    break_characters: tuple[str, ...] = ("\n", " ", "\t")

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_chunk_bytes", max(256, self.max_chunk_bytes))
        object.__setattr__(self, "overlap_bytes", max(0, self.overlap_bytes))


@dataclass(frozen=True)
class MemoryBudget(_FromDict):
    """What an index may hold; an index beyond it is refused before it is published."""

    max_resident_bytes: int = 32 << 20
    max_mapped_bytes: int = 64 << 20
    max_chunks: int = 50_000
    max_chunk_bytes: int = 8192

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_chunk_bytes", max(256, self.max_chunk_bytes))


# Names of ignore files, and folders that a crawl leaves out.
IGNORE_FILES = (".gitignore", ".frgignore")
SKIPPED = (".build", ".frg", ".git", ".swiftpm", "DerivedData")


@dataclass(frozen=True)
class IndexConfig(_FromDict):
    max_gram_length: int = 128
    max_covering_grams: int | None = None
    include_hidden: bool = False
    follow_symlinks: bool = False
    respect_ignore_files: bool = True
    ignore_files: tuple[str, ...] = IGNORE_FILES
    max_file_bytes: int = 10 << 20
    skipped_directories: tuple[str, ...] = SKIPPED

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_gram_length", max(2, self.max_gram_length))
        if self.max_covering_grams is not None:
            object.__setattr__(self, "max_covering_grams", max(1, self.max_covering_grams))


class Mode(str, Enum):
    LITERAL = "literal"
    REGEX = "regex"


@dataclass(frozen=True)
class RecordQuery(_FromDict):
    text: str
    mode: Mode = Mode.LITERAL
    collections: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    required_tags: tuple[str, ...] = ()
    max_results: int = 20
    case_insensitive: bool = False
    smart_case: bool = True
    prefilter: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", Mode(self.mode))
        object.__setattr__(self, "max_results", max(1, self.max_results))


@dataclass(frozen=True)
class FileQuery(_FromDict):
    """Options of a file search. max_results None is unlimited, a negative one 0; a cap below 1 is refused."""

    max_results: int | None = 200
    prefilter: bool = True
    literal: bool = False
    case_insensitive: bool = False
    smart_case: bool = False
    files_only: bool = False
    count_matches: bool = False
    quiet: bool = False
    max_count_per_file: int | None = None
    context_lines: int = 0
    glob: str | None = None
    file_type: str | None = None

    def __post_init__(self) -> None:
        if self.max_count_per_file is not None and self.max_count_per_file < 1:
            raise ValueError("max_count_per_file must be at least 1")
        if self.max_results is not None:
            object.__setattr__(self, "max_results", max(0, self.max_results))
        object.__setattr__(self, "context_lines", max(0, self.context_lines))


class Recovery(str, Enum):
    FAIL = "fail"
    DISCARD = "discard"
    REBUILD = "rebuild"


@dataclass(frozen=True)
class RecordIndexConfig(_FromDict):
    """storage None keeps the index in the shared scratch folder. Protection classes are the storage layer's matter."""

    storage: str | None = None
    recovery: Recovery = Recovery.REBUILD
    compaction_threshold: int = 4096
    compact_on_open: bool = False
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    budget: MemoryBudget | None = None
    index: IndexConfig = field(default_factory=IndexConfig)

    def __post_init__(self) -> None:
        object.__setattr__(self, "recovery", Recovery(self.recovery))
        object.__setattr__(self, "compaction_threshold", max(1, self.compaction_threshold))


class EngineError(Exception):
    """An error with a code, so that callers can tell what is wrong."""

    def __init__(self, code: int | str, message: str):
        super().__init__(message)
        self.code = code


# Codes of errors.
NOT_PERSISTED, NO_POSTINGS, NO_INDEX, WRONG_VERSION, OTHER_CONFIG, NO_PROVIDER, NO_REUSE, NOTHING_TO_REUSE = 2, 10, 11, 12, 13, 50, 61, 62
RESIDENT_BUDGET, CHUNK_COUNT_BUDGET, CHUNK_TOO_LARGE = "residentBudgetExceeded", "chunkCountBudgetExceeded", "chunkTooLarge"
