"""A front end's settings as a run's settings: keys with fixed choices become fields of ``Config``."""

from __future__ import annotations

from typing import Any

from . import parsing
from .config import Config

#: Choices by key; each choice is what it sets.  Fixed values.
CHOICES: dict[str, dict[Any, dict[str, Any]]] = {
    "traverse-match": {"none": {}, "basename": {"match_basename": True}, "extension": {"match_extension": True}, "without-extension": {"match_stem": True}},
    "general-find-symlinks": {"ignore": {"symlinks": "ignore"}, "see": {"symlinks": "see"}, "follow": {"symlinks": "follow"}},
    "traverse-hidden": {"ignore": {"hidden": "ignore"}, "partial": {"hidden": "partial"}, "follow": {"hidden": "include"}},
    "computation-keep-all-tagged": {"none": {}, "tagged": {"keep_all_tagged": True}, "untagged": {"keep_all_untagged": True}},
    "computation-must-match-tagged": {"none": {}, "tagged": {"must_match_tagged": True}, "untagged": {"must_match_untagged": True}},
    "general-find-hardlinks": {True: {"hardlinks": True}, False: {"hardlinks": False}},
    "traverse-cross-mounts": {True: {"cross_devices": True}, False: {"cross_devices": False}},
}
HANDLERS = {"remove": "default", "link": "link", "symlink": "symlink", "hardlink": "hardlink"}


def from_settings(settings: dict[str, Any]) -> tuple[Config, str]:
    """Settings of a run over duplicates alone, and the preset of actions.

    Besides the keys of ``CHOICES``: ``traverse-size-limits`` (least, most), ``traverse-max-depth``, ``computation-algorithm`` and ``general-handler-type``.
    An unknown key or choice is an error.
    """
    fields: dict[str, Any] = {"types": parsing.lint_types("none +duplicates")}
    preset = HANDLERS["remove"]
    for key, value in settings.items():
        if key in CHOICES:
            if value not in CHOICES[key]:
                raise parsing.ParseError(f"no choice of {key}: {value!r}")
            fields |= CHOICES[key][value]
        elif key == "traverse-size-limits":
            least, most = value
            fields["size"] = parsing.size_range(f"{least}-{most}")
        elif key == "traverse-max-depth":
            fields["max_depth"] = int(value)
        elif key == "computation-algorithm":
            fields["algorithm"] = str(value)
        elif key == "general-handler-type":
            if value not in HANDLERS:
                raise parsing.ParseError(f"no handler: {value!r}")
            preset = HANDLERS[value]
        else:
            raise parsing.ParseError(f"no setting: {key!r}")
    return Config(**fields), preset
