"""Classes of paths as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..model import LARGE_BYTES
from .paths import file_name

# Names that the classes are defined by.
RECONSTRUCTABLE = ["node_modules", ".next", ".nuxt", ".sites", ".svelte-kit", ".wrangler", "dist", "build", "coverage", ".build", ".swiftpm", ".venv", "__pycache__", ".dart_tool", "Pods", "DerivedData", "target"]
GENERATED_EXTENSIONS = ["class", "o", "obj", "pyc", "pyo", "wasm", "xcuserstate"]
SECRET_NAMES = [".env", "credentials", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc"]
SECRET_PARTS = ["secret", "credential", "password", "private_key", "private-key", "api_key", "api-key", "access_token", "access-token"]
SECRET_EXTENSIONS = ["key", "pem", "p12", "pfx"]
TEMPORARY_DIRECTORIES = [".analysis", ".cache", ".codex-spreadsheet-work", "temp", "tmp", "worktrees"]
TEMPORARY_EXTENSIONS = ["bak", "cache", "part", "swp", "swo", "temp", "tmp"]
VERSION_WORDS = ["draft", "revised", "revision", "redline", "final", "copy"]
CONTEXT_NAMES = ["agents.md", "claude.md", "context.md", "gemini.md", "hermes.md", "memory.md", "project.md", ".cursorrules", "readme"]
PERMISSION_WORDS = ["agreement", "agreements", "client", "clients", "commercial", "company", "confidential", "contract", "contracts", "credential", "credentials", "customer", "customers", "email", "emails", "finance", "financial", "hr", "internal", "invoice", "invoices", "legal", "people", "personal", "private", "project", "restricted", "security", "secret", "secrets", "vapt"]
LIFECYCLE_WORDS = ["archive", "archives", "archived", "draft", "drafts", "evidence", "final", "finals", "output", "outputs", "raw", "temp", "tmp", "worktree", "worktrees"]
#: Order of classes in reports, and their bits.
CLASSES = ["generated", "secret_shaped", "temporary", "large", "versioned"]


def _any(conditions):
    return reduce(lambda a, b: a | b, conditions)


def extension(path):
    """What follows the last dot of the name, in lower case; empty for names without or with only a leading dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def stem(path):
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def is_generated(path):
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, RECONSTRUCTABLE))) | extension(path).isin(GENERATED_EXTENSIONS) | (file_name(path) == ".DS_Store")


def is_secret_shaped(path):
    name = F.lower(file_name(path))
    sample = _any([name.endswith(x) for x in (".example", ".sample", ".template")]) | name.contains("example.")
    return ~sample & (name.isin(SECRET_NAMES) | name.startswith(".env.") | _any([name.contains(x) for x in SECRET_PARTS]) | extension(path).isin(SECRET_EXTENSIONS))


def is_temporary(path):
    name = file_name(path)
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, TEMPORARY_DIRECTORIES))) | name.startswith("~$") | name.endswith("~") | extension(path).isin(TEMPORARY_EXTENSIONS)


def is_versioned(path):
    s = F.lower(stem(path))
    return F.exists(words(s), lambda w: w.isin(VERSION_WORDS) | w.rlike("^(v|copy)[0-9]+$")) | s.rlike(r"\([0-9]*\)$")


def is_large(size):
    return F.coalesce(size >= LARGE_BYTES, F.lit(False))


def is_context_file(path, own: tuple[str, ...] = ()):
    name = F.lower(file_name(path))
    return name.isin([*CONTEXT_NAMES, *own]) | name.startswith("readme.")


def boundary_hint(path):
    """`permission` or `lifecycle` for directory names that suggest a boundary, else null."""
    w = words(file_name(path))
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, PERMISSION_WORDS))), "permission").when(F.arrays_overlap(w, F.array(*map(F.lit, LIFECYCLE_WORDS))), "lifecycle")


def class_mask(path, size):
    tests = [is_generated(path), is_secret_shaped(path), is_temporary(path), is_large(size), is_versioned(path)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])
