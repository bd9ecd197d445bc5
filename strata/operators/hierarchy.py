"""Directory-size rollups over a file manifest.

A manifest row is ``path`` (relative to the root, ``/``-separated), ``size``
(bytes), ``is_symlink`` and ``kind`` (``file`` or ``dir``; ``dir`` rows let
empty directories appear).  Every directory gets the byte total of the files
below it.  The rollup explodes each file into its ancestor directories and
sums per directory; Spark's partial aggregation combines on the map side, so
the root (which every file reaches) never concentrates in one task.
"""

from __future__ import annotations

import posixpath
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.sizes import human_size, whole_mb
from strata.operators.ordering import running_totals

HIDDEN_MODES = ("prune", "basename", "keep")


def _components() -> Column:
    return F.split(F.col("path"), "/")


def _hidden(c: Column) -> Column:
    return c.startswith(".")


def size_rollup(manifest: DataFrame, root: str = ".", hidden: str = "prune") -> DataFrame:
    """``dir, depth, bytes`` for the root (depth 0) and every directory below.

    hidden="prune": a directory with a hidden component anywhere in its path
    is not reported, but its bytes still count in its reported ancestors.
    hidden="basename": only directories whose own name is hidden are dropped.
    hidden="keep": nothing is dropped.  Symbolic links count 0 bytes and a
    linked directory is not reported; a directory with unreadable files only is
    reported with 0 bytes, and so is the root of an empty manifest.
    """
    if hidden not in HIDDEN_MODES:
        raise ValueError(f"hidden must be one of {HIDDEN_MODES}")
    link = F.coalesce(F.col("is_symlink"), F.lit(False))
    # an unreadable file (NULL size) counts 0 bytes
    bytes_ = F.when((F.col("kind") == "file") & ~link, F.coalesce("size", F.lit(0))).otherwise(F.lit(0)).cast("long")
    # split each path once; the levels and directory names below reuse it
    base = manifest.select(_components().alias("_c"), bytes_.alias("_b"),
                           ((F.col("kind") == "dir") & ~link).alias("_is_dir"))
    comps = F.col("_c")
    n = F.size(comps)
    deepest = F.when(F.col("_is_dir"), n).otherwise(n - 1)
    if hidden == "prune":
        first_hidden = F.array_position(F.transform(comps, _hidden), True)
        deepest = F.when(first_hidden > 0, F.least(deepest, (first_hidden - 1).cast("int"))).otherwise(deepest)
    levels = F.sequence(F.lit(0), deepest.cast("int"))
    if hidden == "basename":
        levels = F.filter(levels, lambda i: (i == 0) | ~_hidden(F.element_at(comps, i)))
    exploded = base.select("_c", "_b", F.explode(levels).alias("depth"))
    d = F.col("depth")
    rel = F.array_join(F.slice(F.col("_c"), F.lit(1), d), "/")
    dir_ = F.when(d == 0, F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), rel))
    found = exploded.select(dir_.alias("dir"), d.alias("depth"), "_b")
    the_root = manifest.sparkSession.range(1).select(
        F.lit(root).alias("dir"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("_b"))
    out = found.unionByName(the_root).groupBy("dir", "depth").agg(F.sum("_b").alias("bytes"))
    root_name = posixpath.basename(root.rstrip("/")) or root
    drop_root = ((hidden == "prune" and root_name.startswith(".") and root_name not in (".", ".."))
                 or (hidden == "basename" and root_name.startswith(".")))
    if drop_root:
        out = out.where(F.col("depth") > 0)
    return out


def size_filter(rollup: DataFrame, min_mb: float = 0.0) -> DataFrame:
    """Directories of at least ``min_mb`` MiB, largest first (ties by name)."""
    min_bytes = int(min_mb * 1024 * 1024)
    return rollup.where(F.col("bytes") >= min_bytes).orderBy(F.desc("bytes"), F.asc("dir"))


def size_topk(rollup: DataFrame, max_depth: int = 2, k: int = 10) -> DataFrame:
    """The ``k`` largest directories at most ``max_depth`` below the root, with
    whole MiB rounded up.  Ties are broken by directory name."""
    top = rollup.where(F.col("depth") <= max_depth).orderBy(F.desc("bytes"), F.asc("dir")).limit(k)
    return top.withColumn("mb", whole_mb("bytes"))


def format_listing(rollup: DataFrame, style: str = "tree") -> DataFrame:
    """Adds ``line``: the text listing line of each directory.

    tree  : two blanks per depth level, tight size padded to 10, a blank, path.
    mb    : ``%8d MB  path`` with whole MiB rounded up.
    plain : two blanks per ``/`` in the path, integer-style size, two blanks, path.
    """
    d = F.col("dir")
    if style == "tree":
        h = human_size("bytes", "tight")
        padded = F.when(F.length(h) < 10, F.rpad(h, 10, " ")).otherwise(h)
        line = F.concat(F.repeat(F.lit("  "), F.col("depth")), padded, F.lit(" "), d)
    elif style == "mb":
        line = F.format_string("%8d MB  %s", whole_mb("bytes"), d)
    elif style == "plain":
        slashes = F.size(F.split(d, "/")) - 1
        line = F.concat(F.repeat(F.lit("  "), slashes), human_size("bytes", "integer"), F.lit("  "), d)
    else:
        raise ValueError(f"unknown listing style {style!r}")
    return rollup.withColumn("line", line)


def clean_excludes(excludes, root: str) -> list[str]:
    """Normalise an exclusion list (a short driver-side parameter list).

    Blank entries are dropped; an absolute entry becomes relative to ``root``
    (entries outside the root -- relative form starting with ``..`` -- are
    skipped with a warning); other entries are kept as given.
    """
    root_abs = posixpath.abspath(root)
    kept = []
    for raw in excludes:
        entry = raw.strip()
        if not entry:
            continue
        if not posixpath.isabs(entry):
            kept.append(entry)
            continue
        rel = posixpath.relpath(entry, root_abs)
        if rel.startswith(".."):
            warnings.warn(f"exclude path {entry!r} is outside {root_abs!r}; skipped")
            continue
        kept.append(rel)
    return kept


def excluded(excludes: list[str]) -> Column:
    """True for manifest rows below an excluded directory.

    An entry with ``/`` names a directory by relative path; one without names
    a directory anywhere by its own name.  Only directories match -- a file
    named like an entry stays."""
    names = [e for e in excludes if "/" not in e]
    paths = [e for e in excludes if "/" in e]
    if not (names or paths):
        return F.lit(False)

    def hit(row: Column) -> Column:
        n = F.size(row["comps"])
        dirs = F.slice(row["comps"], F.lit(1), F.when(row["kind"] == "dir", n).otherwise(n - 1))
        cond = F.lit(False)
        if names:
            cond = cond | F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in names]))
        if paths:
            parent = F.concat(F.array_join(dirs, "/"), F.lit("/"))  # below a path: begins with it and a slash
            cond = cond | F.exists(F.array(*[F.lit(p + "/") for p in paths]), lambda p: parent.startswith(p))
        return cond

    # named by the lambda: a filter is pushed down to where the path is computed, which must happen once
    return F.exists(F.array(F.struct(_components().alias("comps"), F.col("kind").alias("kind"))), hit)


def exclude_paths(manifest: DataFrame, excludes, root: str) -> DataFrame:
    return manifest.where(~excluded(clean_excludes(excludes, root)))


def clean_entries(entries: DataFrame, root: str) -> DataFrame:
    """``clean_excludes`` for a table with a column ``entry``: distinct ``key``,
    ``n:`` and a directory's name or ``p:`` and a relative path.  An absolute
    entry is normalised (``.``, ``..`` and empty parts) and made relative to
    ``root``; the root itself is the name ``.``, which no directory has."""
    base = [c for c in posixpath.abspath(root).split("/") if c]

    def up_or_down(done: Column, c: Column) -> Column:
        above = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(c == "..", above).otherwise(F.concat(done, F.array(c)))

    def relative(parts: Column) -> Column:
        inside = (F.slice(parts, 1, len(base)) == F.array(*[F.lit(c) for c in base])) if base else F.lit(True)
        rest = F.array_join(F.slice(parts, F.lit(len(base) + 1), F.greatest(F.size(parts) - len(base), F.lit(0))), "/")
        return F.when(inside & ~rest.startswith(".."), F.when(rest == "", ".").otherwise(rest))

    def named(entry: Column) -> Column:
        steps = F.filter(F.split(entry, "/"), lambda c: ~c.isin("", "."))
        walked = F.aggregate(steps, F.array().cast("array<string>"), up_or_down)
        return F.when(entry.startswith("/"), F.transform(F.array(walked), relative)[0]).when(entry != "", entry)

    # lambdas name the steps, so that each is computed once wherever the filters are pushed
    entry = F.regexp_replace("entry", r"^\s+|\s+$", "")
    kept = entries.select(F.transform(F.array(entry), named)[0].alias("named")).where("named IS NOT NULL")
    return kept.select(F.concat(F.when(F.col("named").contains("/"), "p:").otherwise("n:"), F.col("named")).alias("key")).distinct()


def exclude_by_table(manifest: DataFrame, entries: DataFrame, root: str) -> DataFrame:
    """``exclude_paths`` for a list of any length, as a table (column ``entry``).

    Each different directory of the manifest is exploded into its own and its
    ancestors' names and paths once, and those that meet an entry are found by
    an equi-join; rows below them go by an anti-join on their directory, so a
    directory that holds many files is one row until then, and its files may be
    split over tasks.  The order of rows is not kept."""
    whole = F.concat("path", F.when(F.col("kind") == "dir", "/").otherwise(""))  # the path is used once: it may be an expression
    directory = F.regexp_replace(whole, "/?[^/]*$", "")
    rows = manifest.withColumn("_dir", directory)
    parts = F.split("_dir", "/")
    names = F.transform(parts, lambda c: F.concat(F.lit("n:"), c))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    keys = rows.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(F.concat(names, paths))).alias("key"))
    # not made distinct: the anti-join doesn't ask for it, and so is one of two shuffles, which AQE may split
    hit = keys.join(clean_entries(entries, root), "key", "left_semi").select("_dir")
    return rows.join(hit, "_dir", "left_anti").select(*manifest.columns)


# ---- patterns ------------------------------------------------------------------------------

_POSIX_CLASS = re.compile(r"\[:(alpha|digit|alnum|upper|lower|punct|space|xdigit|blank|cntrl|graph|print):\]")


def _class_regex(body: str) -> str:
    """The inside of a bracket expression (without its negation) for a Java regex."""
    out, i = [], 0
    while i < len(body):
        named = _POSIX_CLASS.match(body, i)
        if named:
            name = named[1]
            out.append(r"\p{XDigit}" if name == "xdigit" else rf"\p{{{name.capitalize()}}}")
            i = named.end()
            continue
        if body[i] == "\\" and i + 1 < len(body):
            i += 1
        out.append(body[i] if body[i] == "-" and 0 < i < len(body) - 1 else re.sub(r"([\\\[\]^&\-])", r"\\\1", body[i]))
        i += 1
    return "".join(out)


def glob_regex(pattern: str, across: bool) -> str:
    """A glob as a Java regex: ``*``, ``?``, ``[...]`` (``!`` or ``^`` negates) and
    backslash; with ``across`` they match slashes, else only ``**`` does.  A
    bracket left open stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            out.append(".*" if across or stars > 1 else "[^/]*")
            i += stars
            continue
        if c == "[":
            start = i + 1 + (pattern[i + 1:i + 2] in ("!", "^"))
            end = start + (pattern[start:start + 1] == "]")  # a bracket that comes first is a member
            while end < len(pattern) and pattern[end] != "]":
                named = _POSIX_CLASS.match(pattern, end)
                end = named.end() if named else end + 2 if pattern[end] == "\\" else end + 1
            if end < len(pattern):
                negated = "^" if start > i + 1 else ""
                out.append(("" if across else "(?!/)") + f"[{negated}{_class_regex(pattern[start:end])}]")
                i = end + 1
                continue
        if c == "?":
            out.append("." if across else "[^/]")
            i += 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            i += 1
        out.append(re.sub(r"([^\w/ ])", r"\\\1", pattern[i]))
        i += 1
    return "".join(out)


GLOB_FORMS = ("find", "rsync")


def excluded_by_glob(excludes: list[str], root: str, form: str) -> Column:
    """True for manifest rows that a copy with these patterns leaves out, either
    because they match themselves (files too) or lie below a directory that does.

    form="find": an entry with ``/`` is matched against the whole relative path,
    one without against any name, the root's own included; wildcards match
    slashes.  form="rsync": an entry with ``/`` or ``**`` is matched against the
    end of a path, at a name's beginning, one without against any name; only
    ``**`` matches slashes, a trailing ``/`` means directories alone, and a
    trailing ``/***`` a directory with all below it."""
    if form not in GLOB_FORMS:
        raise ValueError(f"form must be one of {GLOB_FORMS}")
    anything, only_dirs = [], []
    for entry in excludes:
        if form == "find":
            if "/" in entry:
                anything.append(glob_regex(entry, True))
            else:
                name = glob_regex(entry, False)
                if re.fullmatch(name.replace(r"\p{", r"\w{"), posixpath.basename(posixpath.abspath(root))):
                    return F.lit(True)
                anything.append(f"(?:.*/)?{name}")
            continue
        body, start = entry.rstrip("/"), "(?:.*/)?"
        if body.endswith("/***"):
            body = body[:-4]
            only_dirs.append(start + glob_regex(body, False))
        else:
            (only_dirs if entry.endswith("/") else anything).append(start + glob_regex(body, False))
    # a directory row is tested with a slash at its end, so that directories alone can be asked for
    path = F.concat("path", F.when(F.col("kind") == "dir", "/").otherwise(""))
    tests = [rf"(?:{'|'.join(anything)})(?:/.*)?"] if anything else []
    tests += [rf"(?:{'|'.join(only_dirs)})/.*"] if only_dirs else []
    return path.rlike(rf"(?s)^(?:{'|'.join(tests)})\z") if tests else F.lit(False)


def exclude_globs(manifest: DataFrame, excludes, root: str, form: str = "rsync") -> DataFrame:
    return manifest.where(~excluded_by_glob(clean_excludes(excludes, root), root, form))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Number of regular files (symbolic links are not files to copy) and
    their total bytes; an unreadable file (NULL size) adds no bytes."""
    regular = (F.col("kind") == "file") & ~F.coalesce(F.col("is_symlink"), F.lit(False))
    return manifest.agg(
        F.count(F.when(regular, 1)).alias("files"),
        F.coalesce(F.sum(F.when(regular, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def running_share(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per regular file in path order: files and bytes done so far and their
    percentage of the totals (0 when the total is 0).  A NULL size (an
    unreadable file) counts 0 bytes.

    Equal (path, size) rows are first counted, map-side, so a path repeated on a
    third of the rows is one row in the running totals and only its count is
    expanded at the end.  Range partitions are Spark's (``partitions`` of them,
    by default as many as a shuffle has).
    """
    files = manifest.where((F.col("kind") == "file") & ~F.coalesce(F.col("is_symlink"), F.lit(False)))
    keys = files.groupBy("path", "size").agg(F.count(F.lit(1)).alias("_n"))
    keys = keys.withColumn("_bytes", F.coalesce("size", F.lit(0)) * F.col("_n"))
    placed = running_totals(keys, ["path", "size"], {"_n": "_n0", "_bytes": "_b0"}, partitions)
    # a select of its own: the totals count keys, not the rows they stand for
    expanded = placed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    done = expanded.select(
        "path", "size", (F.col("_n0") + F.col("_i")).alias("files_done"),
        (F.col("_b0") + F.col("_i") * F.coalesce("size", F.lit(0))).alias("bytes_done"),
        F.col("_n0_all").alias("total_files"), F.col("_b0_all").alias("total_bytes"))
    pct = F.lit(100.0)
    return done.select(
        "path", "size", "files_done",
        (pct * F.col("files_done") / F.col("total_files")).alias("files_pct"),
        "bytes_done",
        F.when(F.col("total_bytes") > 0, pct * F.col("bytes_done") / F.col("total_bytes"))
         .otherwise(F.lit(0.0)).alias("bytes_pct"))
