"""File trees: directories of an index, links to their ends, local files that stay, and plans of actions."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import paths as p
from tidewater.operators.lineage import cut
from tidewater.operators.routing import ancestors, bare, minimal, within

ENTRY = "path string, ctime long, size long, type string, target string"
#: What a walk needs besides: the folder that an entry is, or that a link leads to, by its real path, device and inode.
_WALK = f"{ENTRY}, real string, dev long, ino long"


def _entry(path: str, name: str | None = None) -> tuple:
    s = os.lstat(path)
    kind = "link" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    real, own = None, s
    if kind == "dir":
        real = os.path.realpath(path)
    elif kind == "link":
        try:
            own = os.stat(path)
            real = os.path.realpath(path) if stat.S_ISDIR(own.st_mode) else None
        except OSError:  # leads nowhere, or in a circle
            pass
    # Devices and inodes are unsigned.
    where = [n - (1 << 64) if n >= 1 << 63 else n for n in (own.st_dev, own.st_ino)] if real else [None, None]
    return path, int(s.st_ctime), s.st_size if kind == "file" else 0, kind, os.readlink(path) if kind == "link" else None, real, *where


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the folders of ``path`` hold, in slices; a folder that cannot be read is an entry of type ``error``."""
    names = [f.split()[0] for f in _WALK.split(", ")]
    made = lambda rows: pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("ctime", "size", "dev", "ino")})
    rows: list[tuple] = []
    for x in parts:
        for folder in x.path:
            try:
                with os.scandir(folder) as found:
                    for e in found:
                        try:
                            rows.append(_entry(e.path))
                        except FileNotFoundError:  # gone since it was listed
                            continue
                        if len(rows) >= 10_000:
                            yield made(rows)
                            rows = []
            except OSError as e:
                rows.append((folder, None, None, "error", e.strerror, None, None, None))
    yield made(rows)


def scan(spark: SparkSession, roots: Sequence[str], follow: bool = False, anywhere: bool = False) -> DataFrame:
    """path, ctime, size, type, target of all under the roots: folders are listed side by side, a level at a time.

    A root under another one is not listed twice. With ``follow`` the folders that links lead to are listed
    under their real paths; a folder, told by device and inode, is listed once however many ways lead to it. Links out of the roots, by where
    they really lead, are followed only with ``anywhere``. The folders must be where all executors see them.
    """
    found = spark.createDataFrame([], ENTRY)
    front = minimal(spark.createDataFrame([(r,) for r in roots], "prefix string")).select(F.col("prefix").alias("path"))
    own = sorted({os.path.realpath(r).rstrip("/") for r in roots})
    inside = F.lit(False)
    for r in own:
        inside |= within(F.col("real"), r)
    seen = None
    if follow:
        # Every folder of a level is looked at once more by its own name, so roots have a device and inode too.
        seen = cut(front.repartition("path").mapInPandas(_named, "real string, dev long, ino long")).where("real IS NOT NULL")
        front = seen.groupBy("dev", "ino").agg(F.min("real").alias("path")).select("path")
        seen = seen.select("dev", "ino").distinct()
    while True:
        level = cut(front.repartition("path").mapInPandas(_entries, _WALK))
        found = found.unionByName(level.select(*(f.split()[0] for f in ENTRY.split(", "))))
        if follow:
            ahead = level.where("real IS NOT NULL").where((F.col("type") == "dir") | F.lit(anywhere) | inside)
            ahead = ahead.groupBy("dev", "ino").agg(F.min("real").alias("path"))
            ahead = cut(ahead.join(seen, ["dev", "ino"], "left_anti"))
            seen = seen.unionByName(ahead.select("dev", "ino"))
            front = ahead.select("path")
        else:
            front = level.where("type = 'dir'").select("path")
        if not front.limit(1).count():
            return found


def _named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in parts:
        rows = []
        for path in x.path:
            try:
                rows.append(_entry(os.path.realpath(path))[5:])
            except OSError:
                rows.append((path, 0, 0))
        yield pd.DataFrame(rows, columns=["real", "dev", "ino"]).astype({"dev": "Int64", "ino": "Int64"})


def escaping(links: DataFrame, root: str) -> DataFrame:
    """path, target, ends: links (path, target) whose target, by its text, lies outside the root."""
    ends = p.resolved(p.dirname(F.col("path")), F.col("target"))
    return links.select("path", "target", ends.alias("ends")).where(~within(F.col("ends"), root))


def canonical(paths: DataFrame, links: DataFrame, path: str = "path") -> DataFrame:
    """Add ``canonical``: the path with every link on the way to it, and itself, followed, however many; null where that has no end.

    A round follows the topmost link of each path, found among its ancestors by an equal join. A link that is met
    again while what stood behind it is still to come leads into itself.
    """
    to = p.resolved(p.dirname(F.col("path")), F.col("target"))
    rules = links.select(bare(F.col("path")).alias("_at"), F.when(~within(to, bare(F.col("path"))), to).alias("_to"))
    none = F.array().cast("array<struct<at:string,rest:int>>")
    at = cut(paths.select(F.col(path).alias("_p"), p.normalized(F.col(path)).alias("_c"), none.alias("_open")).distinct())
    done = at.where("false").select("_p", "_c")
    while True:
        up = at.select("_p", "_c", F.explode(ancestors(F.col("_c"))).alias("_at"))
        first = up.join(rules, "_at").groupBy("_p").agg(F.min_by(F.struct("_at", "_to"), F.length("_at")).alias("m"))
        met = cut(at.join(first, "_p", "left"))
        done = done.unionByName(met.where("m IS NULL").select("_p", "_c"))
        rest = F.substring(F.col("_c"), F.length("m._at") + 1, F.length("_c"))
        opened = F.filter("_open", lambda x: x.rest <= F.length(rest))
        again = F.exists(opened, lambda x: x["at"] == F.col("m._at"))
        here = F.array(F.struct(F.col("m._at").alias("at"), F.length(rest).alias("rest")))
        at = met.where(F.col("m._to").isNotNull() & ~again).select("_p", p.normalized(F.concat("m._to", rest)).alias("_c"), F.concat(opened, here).alias("_open"))
        if not at.limit(1).count():
            break
    return paths.join(done, F.col(path) == F.col("_p"), "left").drop("_p").withColumnRenamed("_c", "canonical")


def listed_roots(wanted: DataFrame, scheduled: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``wanted`` that are no scheduled root (``prefix``) and above none, so that no folder is walked twice."""
    up = scheduled.select(F.explode(ancestors(bare(F.col("prefix")))).alias("_up")).distinct()
    return wanted.join(up, bare(F.col(path)) == F.col("_up"), "left_anti")


def blockers(wanted: DataFrame, local: DataFrame) -> DataFrame:
    """path, type, local_type, step: wanted entries (path, type) that stand where the inventory has another type.

    A file or link in the way of anything goes first (``unlink``), a folder with all in it (``rmtree``).
    """
    have = local.select("path", F.col("type").alias("local_type"))
    step = F.when(F.col("local_type") == "dir", "rmtree").otherwise("unlink")
    return wanted.join(have, "path").where(F.col("type") != F.col("local_type")).select("path", "type", "local_type", step.alias("step"))


def kept_local(wanted: DataFrame, local: DataFrame) -> DataFrame:
    """Wanted paths that may be written beside what is there: not present, no link on the way, and the nearest folder there writable.

    ``local`` has path, type and writable.
    """
    up = wanted.select("path", F.explode(ancestors(F.col("path"))).alias("_at")).where("_at <> path")
    met = up.join(local.select(bare(F.col("path")).alias("_at"), "type", "writable"), "_at")
    bad = met.groupBy("path").agg(F.max(F.col("type") == "link").alias("through_link"), F.max_by("writable", F.length("_at")).alias("may_write"))
    bad = bad.where("through_link OR NOT may_write").select("path")
    return wanted.join(local.select("path"), "path", "left_anti").join(bad, "path", "left_anti")


def flat_layout(rows: DataFrame, root: str, places: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``placed``: where each path goes in one folder, by (source, name) of the first place that is it or above it; null where none is."""
    placed = F.lit(None).cast("string")
    for source, name in reversed(places):
        rest = p.remainder(F.col("path"), F.lit(source))
        placed = F.when(rest.isNotNull(), p.joined(F.lit(f"{root.rstrip('/')}/{name}".rstrip("/")), rest)).otherwise(placed)
    return rows.withColumn("placed", placed)

def with_directories(files: DataFrame, path: str = "path") -> DataFrame:
    """path, type of all files and of every directory above them, once each; the root is '/'."""
    up = files.select(F.explode(F.slice(ancestors(F.col(path)), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))).alias("path"))
    dirs = up.select(F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), F.lit("dir").alias("type"))
    return dirs.unionByName(files.select(F.col(path).alias("path"), F.lit("file").alias("type"))).groupBy("path").agg(F.min("type").alias("type"))


def link_ends(links: DataFrame) -> DataFrame:
    """path, end, links of (path, target) rows: where a chain of links ends; cycles have a null end.

    Every round jumps to the target's own target, so a chain closes in the logarithm of its length.
    """
    most = links.count()
    at = links.select("path", F.col("target").alias("end"), F.lit(1).cast("long").alias("links"))
    jumps = 1
    # No way that ends has more links than there are.
    while jumps <= most:
        nxt = at.select(F.col("path").alias("_p"), F.col("end").alias("_e"), F.col("links").alias("_l"))
        at = cut(at.join(nxt, at["end"] == nxt["_p"], "left").select("path", F.coalesce("_e", "end").alias("end"), (F.col("links") + F.coalesce("_l", F.lit(0))).alias("links")))
        jumps *= 2
        if not at.join(at.select(F.col("path").alias("_p")), at["end"] == F.col("_p"), "left_semi").limit(1).count():
            break
    bad = at.join(links.select(F.col("path").alias("_p")), at["end"] == F.col("_p"), "left")
    return bad.select("path", F.when(F.col("_p").isNull(), F.col("end")).alias("end"), F.when(F.col("_p").isNull(), F.col("links")).alias("links"))


def keep_local(wanted: DataFrame, local: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``wanted`` that the local inventory lacks: what is there stays as it is."""
    return wanted.join(local.select(path), path, "left_anti")


def essential(path: Column, uploads: str) -> Column:
    """Which work list a file goes to; uploads are known by their folder anywhere in the path."""
    return F.when(F.contains(path, F.lit(uploads)), "uploads").otherwise("essential")


def action_of(op: Column, kind: Column) -> Column:
    """The step that a row of a snapshot diff asks for; null where there is none."""
    return F.when(op == "delete", "remove").when(op.isin("add", "change"), F.when(kind == "dir", "mkdir").when(kind == "link", "link").otherwise("fetch"))
