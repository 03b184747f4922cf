"""The settings of a run, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import parsing
from ..functions import digests


@dataclass(frozen=True)
class Config:
    types: frozenset[str] = field(default_factory=lambda: parsing.lint_types("defaults"))
    size: tuple[int, int] = (1, parsing.LONG_MAX)
    max_depth: int | None = None
    hidden: str = "ignore"  # or include, partial
    symlinks: str = "see"  # or ignore, follow
    cross_devices: bool = True
    permissions: str = ""
    algorithm: str = "sha256"
    prefix_bytes: int = 16384  # of the first stage of the sieve; 0 for one stage
    clamp_low: parsing.Clamp | None = None
    clamp_high: parsing.Clamp | None = None
    match_basename: bool = False
    match_extension: bool = False
    match_stem: bool = False
    differing_basename: bool = False
    mtime_window: float = -1.0  # seconds; negative for none
    newer_than: float | None = None
    hardlinks: bool = True
    keep_hardlinked: bool = False
    must_match_tagged: bool = False
    must_match_untagged: bool = False
    keep_all_tagged: bool = False
    keep_all_untagged: bool = False
    rank: str = parsing.DEFAULT_RANK
    sort_groups: str | None = None
    merge_directories: bool = False
    honour_layout: bool = False
    write_unfinished: bool = False

    def __post_init__(self):
        bad = [
            (self.keep_all_tagged and self.keep_all_untagged, "keep-all-tagged and keep-all-untagged exclude each other"),
            (self.keep_all_tagged and self.must_match_untagged, "keep-all-tagged and must-match-untagged exclude each other"),
            (self.keep_all_untagged and self.must_match_tagged, "keep-all-untagged and must-match-tagged exclude each other"),
            (self.size[0] > self.size[1], "size range ends before it begins"),
            (self.hidden not in ("ignore", "include", "partial"), "hidden is ignore, include or partial"),
            (self.symlinks not in ("see", "ignore", "follow"), "symlinks is see, ignore or follow"),
            (self._clamps_cross(), "the low clamp is not below the high clamp"),
        ]
        for wrong, why in bad:
            if wrong:
                raise parsing.ParseError(why)
        parsing.rank(self.rank)
        if self.sort_groups:
            parsing.group_sort(self.sort_groups)
        digests.canonical_name(self.algorithm)

    def _clamps_cross(self) -> bool:
        a, b = self.clamp_low, self.clamp_high
        if not a or not b:
            return False
        return (a.share is not None and b.share is not None and a.share >= b.share) or (a.offset is not None and b.offset is not None and a.offset >= b.offset)

    def for_directories(self) -> Config:
        """Merging directories sees symlinks and hardlinks and knows of hidden files."""
        return replace(self, merge_directories=True, symlinks="see", hidden="partial" if self.hidden == "ignore" else self.hidden, hardlinks=True, types=self.types | {"duplicate_dir", "duplicate_file"})

    @property
    def needs_tagged(self) -> bool:
        return self.must_match_tagged or self.keep_all_untagged

    @property
    def needs_untagged(self) -> bool:
        return self.must_match_untagged or self.keep_all_tagged
