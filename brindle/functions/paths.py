"""Path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders whose changes are ignored.
IGNORED_FOLDERS = (".git", "__pycache__", ".pytest_cache", "node_modules", ".venv", "venv", ".env", "dist", "build", ".idea", ".vscode")


def parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def normalized(path: Column) -> Column:
    """The path without empty and ``.`` steps."""
    return F.array_join(F.filter(parts(path), lambda p: (p != "") & (p != ".")), "/")


def in_folders(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether any folder of the path is one of ``folders``."""
    steps = parts(path)
    return F.arrays_overlap(F.slice(steps, 1, F.size(steps) - 1), F.array(*map(F.lit, folders))) if folders else F.lit(False)


def watched(path: Column, extensions: tuple[str, ...] = (".py", ".pyi"), ignored: tuple[str, ...] = IGNORED_FOLDERS) -> Column:
    """Whether changes of the path count: an extension that is watched, and no ignored folder."""
    return path.rlike("(" + "|".join(map(re.escape, extensions)) + ")$") & ~in_folders(path, ignored)


def is_test(path: Column) -> Column:
    """test_*, *_test.py, or anything in a folder ``test`` or ``tests``."""
    return basename(path).startswith("test_") | path.endswith("_test.py") | in_folders(path, ("test", "tests"))


def is_source(path: Column) -> Column:
    return path.endswith(".py") & ~is_test(path) & (basename(path) != "__init__.py") & ~in_folders(path, ("__pycache__",))


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` don't, ``{a,b}`` is a choice."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{":
            depth += 1
        choice = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")" if depth else r"\}", ",": "|" if depth else ","}
        if c == "}" and depth:
            depth -= 1
        out.append(choice.get(c, re.escape(c)))
        i += 1
    return "^" + "".join(out) + "$"
