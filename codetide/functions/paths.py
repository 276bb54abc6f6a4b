"""Predicates and lookups on file paths."""

from pyspark.sql import Column, functions as F

from . import rules

# File types the symbol job understands.
LANGUAGE_BY_EXTENSION = {
    "py": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "go": "go",
    "rs": "rust",
}
# Further file types that are indexed without symbols.
TEXT_EXTENSIONS = ("html", "css", "scss", "json", "yaml", "yml", "toml", "md")
# Directories left out of the index.
SKIPPED_DIRECTORIES = (
    "node_modules", "venv", ".venv", "__pycache__", ".git", "dist", "build",
    "target", ".idea", ".vscode", "vendor", "packages", ".next", ".nuxt",
)
MAX_FILE_BYTES = 100 * 1024

_INDEXED = tuple(LANGUAGE_BY_EXTENSION) + TEXT_EXTENSIONS
_SKIPPED_DIR_RE = "(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRECTORIES) + ")/"


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the whole path; NULL without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.create_map(*pairs)[extension(path)]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_skipped_directory(path: Column) -> Column:
    return path.rlike(_SKIPPED_DIR_RE)


def is_indexed_type(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*_INDEXED), F.lit(False))


def is_test(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


def is_sensitive(path: Column) -> Column:
    hit = basename(path).isin(*rules.SENSITIVE_NAMES)
    for suffix in rules.SENSITIVE_SUFFIXES:
        hit = hit | F.endswith(path, F.lit(suffix))
    return hit | path.rlike("(?iUd)" + "|".join(rules.SENSITIVE_PATH_PATTERNS))


def is_manifest(path: Column) -> Column:
    return path.isin(*rules.MANIFESTS)
