"""Text-file and image-file sources.

Every function returns ``path, length, content, error``. Selection works on path and length; files
over the size limit are listed without being opened, and a file that cannot be read has an error in place of its content. Where tasks can
reach the storage themselves (see ``tree``), files of every name are taken. Elsewhere Spark's ``binaryFile`` reader is used: the limit is
a pushed ``length`` filter and ``pathGlobFilter`` keeps unwanted names out of the listing, which leaves out names starting with ``.`` or ``_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import tree

DEFAULT_TEXT_LIMIT = 1024 * 1024
DEFAULT_IMAGE_LIMIT = 25 * 1024 * 1024


def select_files(
    files: DataFrame,
    root: str,
    file_pattern: str = "*.*",
    extensions: Sequence[str] | None = None,
    exclude_patterns: Sequence[str] | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Keep the rows whose ``path`` passes pattern, extensions (F3) and exclusions."""
    path = F.col("path")
    pattern = f"**/{file_pattern}" if recursive else file_pattern
    keep = P.relative_to(path, root).rlike(P.glob_regex(pattern))
    if extensions:
        keep &= P.suffix(path).isin([e if e.startswith(".") else f".{e}" for e in extensions])
    if exclude_patterns:
        keep &= ~P.matches_any(path, [P.right_anchored_regex(p) for p in exclude_patterns])
    return files.where(keep)


def _binary_files(spark: SparkSession, root: str, glob: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def _with_size_limit(files: DataFrame, limit: int, choose) -> DataFrame:
    """Contents of the files within the limit; larger ones keep ``content`` NULL."""
    plain = P.plain_path(F.col("path")).alias("path")
    small = choose(files.where(F.col("length") <= limit).select(plain, "length", "content"))
    large = choose(files.where(F.col("length") > limit).select(plain, "length"))
    both = small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))
    return both.withColumn("error", F.lit(None).cast("string"))


def read_text_files(
    spark: SparkSession,
    root: str,
    file_pattern: str = "*.*",
    extensions: Sequence[str] | None = None,
    exclude_patterns: Sequence[str] | None = None,
    recursive: bool = True,
    max_file_size: int = DEFAULT_TEXT_LIMIT,
    open_file: tree.Opener = tree.open_path,
) -> DataFrame:
    """Text files below a folder."""
    if tree.reachable(root):
        found = tree.walk(spark, root, recursive or "/" in file_pattern)
        chosen = select_files(found, root, file_pattern, extensions, exclude_patterns, recursive)
        return tree.read(chosen, max_file_size, open_file)
    glob = file_pattern.rsplit("/", 1)[-1]
    files = _binary_files(spark, root, glob, recursive or "/" in file_pattern)
    return _with_size_limit(
        files,
        max_file_size,
        lambda df: select_files(df, root, file_pattern, extensions, exclude_patterns, recursive),
    )


def read_images(
    spark: SparkSession,
    root: str,
    file_pattern: str | None = None,
    max_image_size: int = DEFAULT_IMAGE_LIMIT,
    open_file: tree.Opener = tree.open_path,
) -> DataFrame:
    """Images of a folder, or one image file (S5). Their order is that of their paths (L4).

    Without a pattern: the known extensions in any case, not recursive. A pattern may recurse and
    may hold one brace group (U2); a single file is taken as it is.
    """
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(root)
    fs = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(location).isFile():
        return _with_size_limit(_binary_files(spark, root, None, False), max_image_size, lambda d: d)
    path = F.col("path")
    if file_pattern is None:
        known = F.lower(P.extension(path)).isin(list(P.IMAGE_MIME_TYPES))
        keep = known & ~F.contains(P.relative_to(path, root), F.lit("/"))
    else:
        keep = P.matches_any(P.relative_to(path, root), [P.glob_regex(p) for p in P.expand_braces(file_pattern)])
    recursive = file_pattern is not None and "/" in file_pattern
    if tree.reachable(root):
        return tree.read(tree.walk(spark, root, recursive).where(keep), max_image_size, open_file)
    return _with_size_limit(_binary_files(spark, root, None, recursive), max_image_size, lambda d: d.where(keep))
