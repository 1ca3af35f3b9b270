"""Prefix routing: a few rules are looked up in a literal map, with no shuffle; more are met by equal joins on exploded ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewater.operators.lineage import cut

#: Most rules that go into a plan as a literal; beyond, they are joined.
FEW = 500


def ancestors(path: Column) -> Column:
    """The path and every directory above it, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def bare(path: Column) -> Column:
    """A path or rule without slashes at its end, so '/' is '' and '/a/' is '/a'."""
    return F.regexp_replace(path, "/+$", "")


def within(path: Column, root: Column | str) -> Column:
    root = bare(F.lit(root) if isinstance(root, str) else root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def _met(path: Column, keys: Sequence[str], values: Sequence[Column]) -> Column:
    """Values of the keys that are the path or above it, the topmost first."""
    known = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values))
    return F.filter(F.transform(ancestors(path), lambda a: F.try_element_at(known, a)), lambda v: v.isNotNull())


def _few(rules: DataFrame, few: int) -> list[Row] | None:
    """The rules, at least one and at most ``few``; null otherwise."""
    rows = rules.limit(few + 1).collect()
    return rows if 0 < len(rows) <= few else None


def longest_prefix(paths: DataFrame, rules: DataFrame, path: str = "path", few: int = FEW) -> DataFrame:
    """Add ``source``, ``target`` of the longest rule that is the path or above it; null where none is."""
    if found := _few(rules.select("source", "target").where("source IS NOT NULL"), few):
        last = {r.source.rstrip("/"): r for r in sorted(found, key=lambda r: (len(r.source), r.source, str(r.target)))}
        values = [F.struct(*[F.lit(r[c]).cast(rules.schema[c].dataType).alias(c) for c in ("source", "target")]) for r in last.values()]
        rule = F.try_element_at(_met(bare(F.col(path)), list(last), values), F.lit(-1))
        return paths.withColumn("_rule", rule).select(*paths.columns, F.col("_rule.source").alias("source"), F.col("_rule.target").alias("target"))
    up = paths.select(path).distinct().select(path, F.explode(ancestors(bare(F.col(path)))).alias("_at"))
    best = up.join(rules.select("source", "target", bare(F.col("source")).alias("_at")), "_at").groupBy(path).agg(F.max_by(F.struct("source", "target"), F.struct(F.length("source"), "source", "target")).alias("rule"))
    return paths.join(best, path, "left").select(*[paths[c] for c in paths.columns], F.col("rule.source").alias("source"), F.col("rule.target").alias("target"))


def remapped(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Add ``source``, ``target`` of the longest rule, and ``moved``: the target with what follows the source in the path."""
    found = longest_prefix(paths, rules, path)
    rest = F.substring(F.col(path), F.length(bare(F.col("source"))) + 1, F.length(path))
    return found.withColumn("moved", F.when(F.col("source").isNotNull(), F.concat(bare(F.col("target")), rest)))


def only(paths: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Rows that are, or lie under, a prefix; without prefixes, all rows."""
    return under_any(paths, prefixes, path) if prefixes.limit(1).count() else paths


def under_any(paths: DataFrame, prefixes: DataFrame, path: str = "path", how: str = "left_semi", few: int = FEW) -> DataFrame:
    """Rows whose path is, or lies under, a prefix (``left_anti``: none; null paths lie under none)."""
    if found := _few(prefixes.select("prefix").where("prefix IS NOT NULL"), few):
        own = sorted({r.prefix.rstrip("/") for r in found})
        hit = F.coalesce(F.arrays_overlap(ancestors(bare(F.col(path))), F.array(*map(F.lit, own))), F.lit(False))
        return paths.where(hit if how == "left_semi" else ~hit)
    hit = paths.select(path).distinct().select(path, F.explode(ancestors(bare(F.col(path)))).alias("prefix")).join(prefixes.select(bare(F.col("prefix")).alias("prefix")), "prefix", "left_semi")
    return paths.join(hit.select(path).distinct(), path, how)


def minimal(prefixes: DataFrame) -> DataFrame:
    """Prefixes that no other prefix covers."""
    own = prefixes.select(bare(F.col("prefix")).alias("prefix")).distinct()
    up = own.select("prefix", F.explode(ancestors(F.col("prefix"))).alias("above")).where("above <> prefix")
    covered = up.join(own.select(F.col("prefix").alias("above")), "above", "left_semi").select("prefix").distinct()
    return own.join(covered, "prefix", "left_anti").select(F.when(F.col("prefix") == "", "/").otherwise(F.col("prefix")).alias("prefix"))


def first_mapping(urls: DataFrame, mapping: DataFrame, url: str = "url", few: int = FEW) -> DataFrame:
    """Add ``new_url``: the URL under the first mapping (ord, from, to) by ``ord`` that is it or a parent of it at a '/'.

    Case of scheme and host, and the standard port, do not tell URLs apart, nor does a slash at a rule's end.
    """
    plain = F.regexp_replace(url_key(F.col(url)), "[?#].*$", "")
    rules = mapping.select("ord", bare(url_key(F.col("from"))).alias("from"), bare(F.col("to")).alias("to"))
    move = lambda m: F.when(m.isNotNull(), F.concat(m["to"], F.substring(url_key(F.col(url)), F.length(m["from"]) + 1, F.length(url)))).otherwise(F.col(url))
    if found := _few(rules.where("`from` IS NOT NULL"), few):
        first = {r["from"]: r for r in sorted(found, key=lambda r: r.ord, reverse=True)}
        values = [F.struct(F.lit(r.ord).alias("ord"), F.lit(k).alias("from"), F.lit(r.to).cast("string").alias("to")) for k, r in first.items()]
        return urls.withColumn("_m", F.array_min(_met(plain, list(first), values))).select(*urls.columns, move(F.col("_m")).alias("new_url"))
    up = urls.select(url).distinct().select(url, F.explode(ancestors(plain)).alias("from"))
    best = up.join(rules, "from").groupBy(url).agg(F.min_by(F.struct("from", "to"), "ord").alias("m"))
    joined = urls.join(best, url, "left")
    return joined.select(*[urls[c] for c in urls.columns], move(F.col("m")).alias("new_url"))


def url_key(url: Column) -> Column:
    """The URL with scheme and host in lower case and without the standard port."""
    head = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.concat(F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1"), rest)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that (src, dst) edges reach from roots (node), with the least number of steps; ends on cycles."""
    seen = roots.select("node", F.lit(0).alias("steps")).distinct()
    seen = cut(seen)
    front, step = seen, 0
    while True:
        step += 1
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(front.join(seen, "node", "left_anti").withColumn("steps", F.lit(step)))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def lookup_range(points: DataFrame, ranges: DataFrame, at: str, few: int = 10_000) -> DataFrame:
    """Add ``name`` of every range (start, stop, name; start in, stop out) that holds ``at``; null where none does.

    A range lies in one or two bins of the power of two that its length fills, so each goes to two rows at most, and a point
    to one row for each power that occurs: the join is one of equal bins, of any lengths. The widest powers, up to ``few``
    ranges in all, are met by broadcast, as all points may lie in one of their bins.
    """
    r = ranges.where("start < stop").select(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "name")
    # Bits of length - 1, without a logarithm's rounding.
    power = F.length(F.bin(F.col("stop") - F.col("start") - 1)).cast("int")
    r = r.withColumn("_power", F.least(power, F.lit(62)))
    first, last = F.expr("shiftright(start, _power)"), F.expr("shiftright(stop - 1, _power)")
    # One row a power, 63 at most.
    powers = {x["_power"]: x["count"] for x in r.groupBy("_power").count().collect()}
    wide, held = [], 0
    for k in sorted(powers, reverse=True):
        if held + powers[k] > few:
            break
        wide, held = [*wide, k], held + powers[k]
    narrow = sorted(set(powers) - set(wide))
    bins = r.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    name = "_point"
    while name in points.columns:
        name += "_"
    rows = points.withColumn(name, F.struct("*"))
    none = F.lit(None).cast(ranges.schema["name"].dataType).alias("name")

    def met(levels: list[int], side: DataFrame, by_broadcast: bool) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("_power"), F.expr(f"shiftright(CAST(`{at}` AS BIGINT), {k})").alias("_bin")) for k in levels]))
        p = rows.withColumn("_k", keys).select(name, F.col(at).alias("_at"), "_k.*")
        side = side.where(F.col("_power").isin(levels))
        found = p.join(F.broadcast(side) if by_broadcast else side, ["_power", "_bin"]).where("_at >= start AND _at < stop")
        return found.select(name, "name")

    parts = [met(levels, bins, b) for levels, b in ((wide, True), (narrow, False)) if levels]
    if not parts:
        return points.select("*", none)
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # A point without a hit, once for each of its rows.
    missed = rows.join(hits.select(F.col(name).alias("_hit")).distinct(), F.col(name).eqNullSafe(F.col("_hit")), "left_anti")
    return hits.select(f"{name}.*", "name").unionByName(missed.select(f"{name}.*", none))


def covering(prefixes: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Prefixes under which some path lies."""
    up = paths.select(F.explode(ancestors(bare(F.col(path)))).alias("_up")).distinct()
    return prefixes.join(up, bare(F.col("prefix")) == F.col("_up"), "left_semi")
