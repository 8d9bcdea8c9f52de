"""Path and module predicates as Column expressions; paths use forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mark tests and configuration.
TEST_DIRECTORIES = ("test", "tests")
CONFIG_STEMS = ("config", "settings", "setup", "conf")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory, "." at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """a/b.py and a/b/__init__.py are both a.b."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def path_order(path: Column) -> Column:
    """Sorts as paths do, component by component."""
    return F.split(path, "/")


def dotted_prefixes(module: Column) -> Column:
    """a.b.c to [a, a.b, a.b.c]."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def absolute_base(package_parts: Column, level: Column) -> Column:
    """Package parts that a relative import of a level starts from; null above the top."""
    left = F.size(package_parts) - (level - 1)
    return F.when(left >= 0, F.slice(package_parts, F.lit(1), F.greatest(left, F.lit(0))))


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.startswith(file_name(path), F.lit("test_")) | F.endswith(path, F.lit("_test.py")) | F.arrays_overlap(parts, F.array(*[F.lit(d) for d in TEST_DIRECTORIES]))


def is_config(path: Column) -> Column:
    return stem(path).isin(*CONFIG_STEMS) | (file_name(path) == "setup.py")


def tests_module(test_path: Column, leaf: Column) -> Column:
    """Whether a test file's name points to a module's leaf name."""
    name = file_name(test_path)
    return (
        (name == F.concat(F.lit("test_"), leaf, F.lit(".py"))) | (name == F.concat(leaf, F.lit("_test.py")))
        | F.startswith(name, F.concat(F.lit("test_"), leaf, F.lit("_")))
    )


def singular(word: Column) -> Column:
    """Lower case without one final s, of words over two letters."""
    low = F.lower(word)
    return F.when((F.length(low) > 2) & F.endswith(low, F.lit("s")), F.left(low, F.length(low) - 1)).otherwise(low)
