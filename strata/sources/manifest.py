"""File manifests: ``path, size, is_symlink, kind`` rows, taken from a table.

Listing a file tree belongs to whatever walks the store: a listing made by one
Spark driver would pass every file's status through it, and Spark's own file
index leaves out names that begin with ``.`` or ``_`` and follows links.  A
manifest is therefore read from a table of listed files, hidden ones and links
included.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "path string, size bigint, is_symlink boolean, kind string"


def manifest_from_table(files: DataFrame, root: str) -> DataFrame:
    """Listed files (``path``, ``size``, optional ``is_symlink`` and ``kind``) as
    manifest rows: absolute paths become relative to ``root``, paths outside it
    are not of this manifest, trailing slashes go and mark a directory; what is
    not said to be a link or a directory is a plain file.  An unreadable file
    (NULL size) stays, with its NULL."""
    prefix = re.escape(root.rstrip("/") + "/")
    path = F.col("path")
    # a path that is itself an expression is inlined wherever it is used: so it is used once in each
    # column and once in the filter, which keeps relative paths and those inside, but for the root
    inside = path.rlike(rf"^(?:{prefix}/*[^/]|[^/])")
    rel = F.rtrim(F.regexp_replace(path, f"^{prefix}", ""), F.lit("/"))
    link = F.coalesce(F.col("is_symlink"), F.lit(False)) if "is_symlink" in files.columns else F.lit(False)
    kind = F.col("kind") if "kind" in files.columns else F.lit(None).cast("string")
    return files.where(inside).select(
        rel.alias("path"), F.col("size").cast("long").alias("size"), link.alias("is_symlink"),
        F.coalesce(kind, F.when(path.endswith("/"), "dir").otherwise("file")).alias("kind"))
