"""Row schemas, ranks and limits of versioned folder trees."""

from __future__ import annotations

LIVE, DELETED = "live", "deleted"
DIRECTORY, FILE, SYMLINK, NESTED = "directory", "regular_file", "symlink", "nested_root"
#: Orders of the total row order; the order of normalised request values is by name instead.
LIFECYCLE_RANK = {LIVE: 0, DELETED: 1}
KIND_RANK = {DIRECTORY: 0, FILE: 1, SYMLINK: 2, NESTED: 3}
SOURCE_RANK = {"capture_plan": 0, "version": 1}
NESTED_REASON, IGNORED_REASON, UNSUPPORTED_REASON = "nested-boundary", "capture-ignore-policy", "unsupported"
#: Kinds of what a version leaves out, with the reason that each must have.
EXCLUSION_REASONS = {NESTED: NESTED_REASON} | dict.fromkeys(("hard_link", "fifo", "socket", "block_device", "character_device", "special"), UNSUPPORTED_REASON)

MAX_PAGE, MAX_EXCLUSIONS, MAX_VALUES = 1000, 1000, 256
MAX_ENTRIES = 16_384
MAX_OBJECT_BYTES = 1 << 40
MAX_PATH_BYTES, MAX_COMPONENT_BYTES, MAX_DEPTH = 4096, 255, 128
LARGE_BYTES = 100 << 20

QUERY_ROW = "path string, kind string, lifecycle string, bytes long, executable boolean, symlink_target string, object_id string, object_version_id string, version_id string, source string, boundary_reason string"
QUERY_COLUMNS = [c.split()[0] for c in QUERY_ROW.split(", ")]
DIFF_RANK = {
    "manifest_updated": 0,
    "moved": 1,
    "recreated": 2,
    "added": 3,
    "updated": 4,
    "deleted": 5,
    "tombstone_added": 6,
    "tombstone_removed": 7,
    "exclusion_added": 8,
    "exclusion_removed": 9,
}
