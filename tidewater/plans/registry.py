"""Queries by name over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import encode, nested, paths
from tidewater.operators import adaptive, exclusions, lineage, reports, routing, scans, snapshots, trees
from tidewater.sources import dump, sqltext
from tidewater.streaming import replay, stateful

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _local(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("price"), F.col("o_orderstatus").alias("status"))


def _remote(spark: SparkSession, d: str) -> DataFrame:
    """All orders as the other side has them: some keys moved, some prices changed."""
    key = F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    price = F.round("o_totalprice").cast("long") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    return _t(spark, d, "orders").select(key.alias("o_orderkey"), price.alias("price"), F.col("o_orderstatus").alias("status"))


_SIDES = """
l AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) price, o_orderstatus status FROM orders),
r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END o_orderkey, CAST(round(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END price, o_orderstatus status FROM orders),
d AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) o_orderkey,
  CASE WHEN l.o_orderkey IS NULL THEN 'add' WHEN r.o_orderkey IS NULL THEN 'delete'
       WHEN l.price IS DISTINCT FROM r.price OR l.status IS DISTINCT FROM r.status THEN 'change' ELSE 'same' END op,
  l.price local_price, l.status local_status, r.price remote_price, r.status remote_status FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey)
"""


@query(f"WITH {_SIDES} SELECT o_orderkey, op, local_price, local_status, remote_price, remote_status FROM d")
def snapshot_diff(spark, d):
    return snapshots.diff(_local(spark, d), _remote(spark, d), "o_orderkey", ["price", "status"])


@query(f"WITH {_SIDES} SELECT op, count(*) n, CAST(sum(coalesce(remote_price, local_price)) AS BIGINT) bytes FROM d GROUP BY op")
def snapshot_diff_summary(spark, d):
    rows = snapshot_diff(spark, d)
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.coalesce("remote_price", "local_price")).alias("bytes"))


@query(f"WITH {_SIDES} SELECT o_orderkey, CASE WHEN op = 'delete' AND local_status <> 'F' THEN 'keep' ELSE op END op FROM d")
def snapshot_diff_guarded_delete(spark, d):
    rows = snapshots.diff(_local(spark, d), _remote(spark, d), "o_orderkey", ["price", "status"], F.col("a.status") == "F")
    return rows.select("o_orderkey", "op")


def _log(spark, d):
    """events as a change log of users: odd ids delete now and then."""
    op = F.when(F.col("event_id") % 9 == 0, "D").otherwise("F")
    return _t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("type"), F.col("event_id").alias("size"))


_LOG = "u AS (SELECT user_id path, event_id seq, CASE WHEN event_id % 9 = 0 THEN 'D' ELSE 'F' END op, event_type type, event_id size FROM events)"


@query(f"""WITH {_LOG}, s AS (SELECT c_custkey path, c_mktsegment type, c_custkey size FROM customer),
 x AS (SELECT path, arg_max(op, seq) op, arg_max(type, seq) type, arg_max(size, seq) size FROM u GROUP BY path)
 SELECT coalesce(x.path, s.path) path, CASE WHEN x.path IS NULL THEN s.type ELSE x.type END type, CASE WHEN x.path IS NULL THEN s.size ELSE x.size END size
 FROM s FULL OUTER JOIN x ON s.path = x.path WHERE x.path IS NULL OR x.op <> 'D'""")
def changelog_merge(spark, d):
    snapshot = _t(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("size"))
    return snapshots.merge(snapshot, _log(spark, d), "path")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) nx FROM events) WHERE nx IS NULL OR nx <> event_type""")
def changelog_coalesce(spark, d):
    return snapshots.coalesce_runs(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["user_id", "event_id"])


@query("SELECT 'same' op, count(*) n FROM orders")
def merge_then_diff_is_same(spark, d):
    changes = snapshot_diff(spark, d).where("op <> 'same'")
    log = changes.select("o_orderkey", F.lit(1).alias("seq"), F.when(F.col("op") == "delete", "D").otherwise("F").alias("op"), F.col("remote_price").alias("price"), F.col("remote_status").alias("status"))
    merged = snapshots.merge(_local(spark, d), log, "o_orderkey")
    return snapshots.diff(merged, _remote(spark, d), "o_orderkey", ["price", "status"]).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 250")
def keyset_page_single(spark, d):
    return scans.keyset_page(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], [500], 250)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey > 300 OR (l_orderkey = 300 AND l_linenumber > 2) ORDER BY l_orderkey, l_linenumber LIMIT 250")
def keyset_page_composite(spark, d):
    return scans.keyset_page(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], [300, 2], 250)


@query("SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 100 OFFSET 40")
def offset_page_total_order(spark, d):
    return scans.offset_page(_t(spark, d, "documents").select("doc_id", "lang"), ["lang", "doc_id"], 40, 100)


@query("SELECT min(doc_id) doc_id, sha1(text) h FROM documents GROUP BY text")
def dedup_first_position(spark, d):
    # The text is hashed before it is shuffled; the survivor is the first by position.
    rows = _t(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) n FROM documents) WHERE n = 1")
def distinct_on_first(spark, d):
    return snapshots.first_by(_t(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])


@query("SELECT count(*) files, CAST(sum(size) AS BIGINT) bytes FROM (SELECT arg_max(n_chars, doc_id) size FROM documents GROUP BY sha1(text))")
def index_stats(spark, d):
    rows = _t(spark, d, "documents").select(F.sha1(F.col("text").cast("binary")).alias("h"), "n_chars", "doc_id")
    return snapshots.index_stats(rows, "h", "n_chars", "doc_id")


@query("SELECT count(*) n, CAST(sum(coalesce(quality, 0)) AS BIGINT) bytes FROM documents LEFT JOIN labels USING (doc_id)")
def pending_bytes_lookup(spark, d):
    return snapshots.pending(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id", "quality")


@query("SELECT l_returnflag, batch, count(*) n, min(l_orderkey) first_key FROM (SELECT *, (row_number() OVER (PARTITION BY l_returnflag, l_orderkey % 16 ORDER BY l_orderkey, l_linenumber) - 1) // 250 batch FROM lineitem) GROUP BY l_returnflag, batch")
def row_batches_250(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 16).alias("shard"))
    return scans.row_batches(rows, ["l_returnflag", "shard"], ["l_orderkey", "l_linenumber"], 250).groupBy("l_returnflag", "batch").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


@query("""WITH RECURSIVE o AS (SELECT lang, n_chars c, row_number() OVER (PARTITION BY lang ORDER BY doc_id) i FROM documents),
 w AS (SELECT lang, i, c, CAST(0 AS BIGINT) batch, c used FROM o WHERE i = 1
  UNION ALL SELECT o.lang, o.i, o.c, CASE WHEN w.used + o.c > 20000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + o.c > 20000 THEN o.c ELSE w.used + o.c END FROM w JOIN o ON o.lang = w.lang AND o.i = w.i + 1)
 SELECT lang, batch, count(*) n, CAST(sum(c) AS BIGINT) AS "cost" FROM w GROUP BY lang, batch""")
def byte_batches_greedy(spark, d):
    return scans.greedy_batches(_t(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 20000)


@query("SELECT c_custkey, CAST(length(CAST(c_custkey AS VARCHAR)) + CASE WHEN octet_length(encode(c_name)) = 0 THEN 2 ELSE 15 + 4 * ((octet_length(encode(c_name)) + 2) // 3) END + 5 AS BIGINT) size FROM customer")
def encoded_size_estimate(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return c.select("c_custkey", (encode.encoded_size(F.col("c_custkey"), T.LongType()) + encode.encoded_size(F.col("c_name"), T.StringType()) + 5).alias("size"))


@query("SELECT page_id, base64(encode(url)) b64, url AS back, base64(encode(url)) ~ '.*(aHR0|dHA6|dHBz|dHRw).*' may FROM pages")
def base64_roundtrip(spark, d):
    p = _t(spark, d, "pages").select("page_id", encode.to_base64(F.col("url")).alias("b64"))
    return p.select("page_id", "b64", F.decode(encode.from_base64(F.col("b64")), "UTF-8").alias("back"), encode.may_hold_url(F.col("b64")).alias("may"))


_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


_DENIED = ["/.git/x", "/w/wp-content/cache/x", "/a/.DS_Store", "/a/.bak", "/a/x~", "/a/.#x", "/a/#x#", "/a/node_modules/b", "/a/../b", "rel/x"]
_ALLOWED = ["/a/cache/x", "/a/gitx", "/a/x.bakery", "/a/##", "/a/Thumbs.db.txt"]
_EDGES = ", ".join(f"({-k - 1}, '{p}', {str(p in _ALLOWED).lower()})" for k, p in enumerate(_DENIED + _ALLOWED))


@query(f"SELECT page_id, {_PATH} path, {_PATH} LIKE '/%' kept FROM pages UNION ALL SELECT * FROM (VALUES {_EDGES})")
def path_deny_filter(spark, d):
    edge = spark.createDataFrame([(-k - 1, p) for k, p in enumerate(_DENIED + _ALLOWED)], "page_id long, path string")
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path")).union(edge)
    return p.select("page_id", "path", (paths.valid(F.col("path")) & ~paths.denied(F.col("path"))).alias("kept"))


@query(f"SELECT page_id, '/' || array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> '' AND x <> '.'), '/') norm, string_split({_PATH}, '/')[-1] base FROM pages")
def path_normalize(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    # A step down and up again changes nothing.
    detour = F.concat(F.lit("/x/../."), F.col("path"))
    return p.select("page_id", paths.normalized(detour).alias("norm"), paths.basename(F.col("path")).alias("base"))


_ORIGIN = "lower(regexp_extract(url, '^([Hh][Tt][Tt][Pp][Ss]?://[^/?#]+)', 1))"


@query(f"SELECT DISTINCT {_ORIGIN} origin FROM pages")
def origins_distinct(spark, d):
    return _t(spark, d, "pages").select(paths.origin(F.col("url")).alias("origin")).distinct()


@query(f"SELECT {_ORIGIN} origin, count(*) n, min(page_id) first_page FROM pages GROUP BY 1")
def origin_first_seen(spark, d):
    return _t(spark, d, "pages").groupBy(paths.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def _mapping(spark):
    rows = [(0, "https://thther.example.org", "https://new.test/a"), (1, "https://thther.example.org/en", "https://new.test/b"), (2, "http://thther.example.org", "https://new.test/a"), (3, "https://blog.tionsh.example.net/en", "https://new.test/c")]
    return spark.createDataFrame(rows, "ord int, `from` string, `to` string")


_MAPPING = "m(ord, f, t) AS (VALUES (0, 'https://thther.example.org', 'https://new.test/a'), (1, 'https://thther.example.org/en', 'https://new.test/b'), (2, 'http://thther.example.org', 'https://new.test/a'), (3, 'https://blog.tionsh.example.net/en', 'https://new.test/c'))"


@query(f"""WITH {_MAPPING}, x AS (SELECT page_id, url, arg_min(f, ord) f, arg_min(t, ord) t FROM pages LEFT JOIN m ON regexp_replace(url, '[?#].*$', '') = f OR starts_with(regexp_replace(url, '[?#].*$', ''), f || '/') GROUP BY page_id, url)
 SELECT page_id, CASE WHEN f IS NULL THEN url ELSE t || substr(url, length(f) + 1) END new_url FROM x""")
def url_first_match_mapping(spark, d):
    return routing.first_mapping(_t(spark, d, "pages").select("page_id", "url"), _mapping(spark)).select("page_id", "new_url")


_RULES = [("/en", "/data/en"), ("/fr", "/data/fr"), ("/de", "/srv/de"), ("/en/25", "/special")]
_RULES_SQL = "r(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ")"


@query(f"""WITH {_RULES_SQL}, p AS (SELECT page_id, {_PATH} path FROM pages)
 SELECT page_id, path, arg_max(source, length(source)) source, arg_max(target, length(source)) target FROM p LEFT JOIN r ON path = source OR starts_with(path, source || '/') GROUP BY page_id, path""")
def prefix_route_longest(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return routing.longest_prefix(p, spark.createDataFrame(_RULES, "source string, target string"))


@query(f"""WITH {_RULES_SQL}, p AS (SELECT page_id, {_PATH} path FROM pages), x AS (SELECT page_id, path, arg_max(source, length(source)) source, arg_max(target, length(source)) target FROM p LEFT JOIN r ON path = source OR starts_with(path, source || '/') GROUP BY page_id, path)
 SELECT page_id, path, coalesce(target || substr(path, length(source) + 1), '/rest' || path) moved FROM x""")
def remap_with_remainder(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    rules = spark.createDataFrame([(a + "/", b + "/") for a, b in _RULES] + [("/", "/rest")], "source string, target string")
    return routing.remapped(p, rules).select("page_id", "path", "moved")


@query("""SELECT '/c/' || c_custkey prefix FROM customer WHERE c_acctbal < 0
 UNION SELECT '/c/' || o_custkey || '/' || o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def prefix_minimal(spark, d):
    """Folders of orders, and of the customers that owe, without those that another one covers."""
    owing = _t(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("prefix"))
    orders = _t(spark, d, "orders").select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("prefix"))
    return routing.minimal(owing.unionByName(orders.where("prefix IS NOT NULL")))


@query(f"SELECT page_id FROM pages WHERE NOT ({_PATH} = '/en' OR starts_with({_PATH}, '/en/'))")
def uncovered_roots_anti(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return routing.under_any(p, spark.createDataFrame([("/en",)], "prefix string"), how="left_anti").select("page_id")


@query(f"SELECT page_id FROM pages WHERE {_PATH} = '/fr' OR starts_with({_PATH}, '/fr/') OR starts_with({_PATH}, '/de/')")
def only_prefix_semi(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return routing.under_any(p, spark.createDataFrame([("/fr",), ("/de",)], "prefix string")).select("page_id")


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 2 src, c_custkey dst FROM customer UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer),
 r(node, steps) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.steps + 1 FROM r JOIN e ON e.src = r.node WHERE r.steps < 30) SELECT node, min(steps) steps FROM r GROUP BY node""")
def symlink_closure(spark, d):
    c = F.col("c_custkey")
    rows = _t(spark, d, "customer")
    # A tree with edges back towards its root, so there are cycles.
    e = rows.select(F.floor(c / 2).alias("src"), c.alias("dst")).unionByName(rows.select(c.alias("src"), F.floor(c / 3).alias("dst"))).distinct()
    return routing.closure(e, spark.createDataFrame([(1,)], "node long"))


_EMA_SQL = "WITH g AS (SELECT user_id, list(CAST(event_id % 100 AS DOUBLE) ORDER BY event_id) v FROM events GROUP BY user_id)"


@query(f"{_EMA_SQL} SELECT user_id, CAST(len(v) AS BIGINT) n, round(list_reduce(v, lambda a, x: a * 0.8 + x * 0.2), 6) ema FROM g")
def throughput_ema(spark, d):
    rows = adaptive.ema(_t(spark, d, "events").select("user_id", "event_id"), "user_id", ["event_id"], F.col("event_id") % 100)
    return rows.select("user_id", "n", F.round("ema", 6).alias("ema"))


@query("""WITH RECURSIVE o AS (SELECT user_id, CAST(event_id % 100 AS DOUBLE) w, CAST(1 + event_id % 3 AS DOUBLE) el, event_id % 17 = 0 bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events),
 s AS (SELECT user_id, CAST(0 AS BIGINT) i, CAST(1000 AS DOUBLE) size, CAST(NULL AS DOUBLE) ema, CAST(0 AS BIGINT) hold FROM o GROUP BY user_id
  UNION ALL SELECT o.user_id, o.i,
   CASE WHEN bad THEN greatest(100.0, least(5000.0, round(size * 0.5))) WHEN w <= 0 OR hold > 0 OR ema IS NULL THEN size WHEN w / el / ema < 0.9 THEN greatest(100.0, least(5000.0, round(size * 0.7))) ELSE greatest(100.0, least(5000.0, size + 100)) END,
   CASE WHEN bad OR w <= 0 THEN ema WHEN ema IS NULL THEN w / el ELSE ema * 0.8 + w / el * 0.2 END,
   CASE WHEN bad THEN greatest(hold, 3) WHEN w <= 0 THEN hold ELSE greatest(hold - 1, 0) END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
 SELECT user_id, CAST(arg_max(size, i) AS BIGINT) size, arg_max(hold, i) backoff FROM s GROUP BY user_id""")
def aimd_sizes(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id")
    id_ = F.col("event_id")
    return adaptive.aimd(e, "user_id", ["event_id"], id_ % 100, 1 + id_ % 3, id_ % 17 == 0, 1000, 100, 5000, 100).select("user_id", "size", "backoff")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES))
def catalog_stats(spark, d):
    return scans.table_stats({t: _t(spark, d, t) for t in _TABLES})


@query(f"""SELECT path, CASE WHEN regexp_extract(path, '([^/]*)/*$', 1) = '' THEN 'no' WHEN path LIKE '%.mo' OR path LIKE '%.PNG' THEN 'no' WHEN path LIKE '%.weird' THEN 'unknown' ELSE 'yes' END ext
 FROM (SELECT DISTINCT {_PATH} path FROM pages UNION SELECT * FROM (VALUES ('/a/LICENSE'), ('/a/.env'), ('/a/x.PNG'), ('/a/b.mo'), ('/a/c.weird'), ('/a/d.TSX'), ('/')))""")
def compressibility(spark, d):
    edge = spark.createDataFrame([("/a/LICENSE",), ("/a/.env",), ("/a/x.PNG",), ("/a/b.mo",), ("/a/c.weird",), ("/a/d.TSX",), ("/",)], "path string")
    p = _t(spark, d, "pages").select(paths.url_path(F.col("url")).alias("path")).union(edge).distinct()
    return p.select("path", paths.compressible(F.col("path")).alias("ext"))


@query("SELECT lang, bool_or(n_chars > 10000) any_large, bool_and(n_chars > 0) all_full FROM documents GROUP BY lang")
def batch_any_true(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.bool_or(F.col("n_chars") > 10000).alias("any_large"), F.bool_and(F.col("n_chars") > 0).alias("all_full"))


@query("SELECT o_orderkey FROM orders UNION SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END FROM orders")
def union_distinct(spark, d):
    return _local(spark, d).select("o_orderkey").unionByName(_remote(spark, d).select("o_orderkey")).distinct()


@query("SELECT c_custkey + 1 path, CAST(0 AS BIGINT) e, CAST(floor(log2(c_custkey + 1.5)) + 1 AS BIGINT) links FROM customer")
def symlink_chain(spark, d):
    # Links to half of the number all end at 0.
    path = F.col("c_custkey") + 1
    return trees.link_ends(_t(spark, d, "customer").select(path.alias("path"), F.floor(path / 2).alias("target"))).select("path", F.col("end").alias("e"), "links")


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} path FROM pages), s AS (SELECT path, string_split(path, '/') w FROM p),
 u AS (SELECT array_to_string(w[1 : n], '/') path FROM (SELECT w, unnest(range(1, len(w))) n FROM s))
 SELECT path, min(type) "type" FROM (SELECT CASE WHEN path = '' THEN '/' ELSE path END path, 'dir' AS "type" FROM u UNION ALL SELECT path, 'file' FROM p) GROUP BY path""")
def tree_index(spark, d):
    return trees.with_directories(_t(spark, d, "pages").select(paths.url_path(F.col("url")).alias("path")).distinct())


@query(f"WITH {_SIDES} SELECT CASE WHEN op = 'delete' THEN 'remove' WHEN op <> 'same' THEN CASE WHEN remote_status = 'O' THEN 'mkdir' ELSE 'fetch' END END AS step, count(*) n FROM d GROUP BY 1")
def action_plan(spark, d):
    kind = F.when(F.col("remote_status") == "O", "dir").otherwise("file")
    return snapshot_diff(spark, d).groupBy(trees.action_of(F.col("op"), kind).alias("step")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey path FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def preserve_local(spark, d):
    return trees.keep_local(_t(spark, d, "orders").select(F.col("o_orderkey").alias("path")), _t(spark, d, "customer").select(F.col("c_custkey").alias("path")))


@query(f"SELECT CASE WHEN contains({_PATH}, '/en') THEN 'uploads' ELSE 'essential' END list, count(*) n FROM pages GROUP BY 1")
def essential_split(spark, d):
    return _t(spark, d, "pages").groupBy(trees.essential(paths.url_path(F.col("url")), "/en").alias("list")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type IS NULL OR (event_type <> 'click' AND event_type <> '_edit_lock')")
def exclusion_rules(spark, d):
    rows = _t(spark, d, "events").select("event_id", "event_type")
    rule = {"table_name_without_prefix": "events", "column": "event_type", "value_base64": "Y2xpY2s="}
    return exclusions.apply_rules(rows, "wp_events", [rule])


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 OR event_type IS NULL")
def transient_filter(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("option_"), "event_type")).otherwise(F.concat(F.lit("_transient_"), "event_type"))
    return _t(spark, d, "events").where(exclusions.lasting(name)).select("event_id")


_RANGES = [(1, 11, "small"), (11, 30, "medium"), (35, 51, "large")]


@query("WITH r(a, b, name) AS (VALUES " + ", ".join(f"({a}, {b}, '{n}')" for a, b, n in _RANGES) + ") SELECT p_partkey, p_size, name FROM part LEFT JOIN r ON p_size >= a AND p_size < b")
def offset_range_lookup(spark, d):
    return routing.lookup_range(_t(spark, d, "part").select("p_partkey", "p_size"), spark.createDataFrame(_RANGES, "start int, stop int, name string"), "p_size")


@query(f"WITH {_RULES_SQL} SELECT source prefix FROM r WHERE EXISTS (SELECT 1 FROM pages WHERE {_PATH} = source OR starts_with({_PATH}, source || '/'))")
def prefix_exists(spark, d):
    rules = spark.createDataFrame(_RULES, "prefix string, target string").select("prefix")
    return routing.covering(rules, _t(spark, d, "pages").select(paths.url_path(F.col("url")).alias("path")))


@query("SELECT doc_id, CAST(c AS BIGINT) chunk, CAST(least(4000, n - c * 4000) AS BIGINT) n_bytes FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 4000 + 1)) c FROM (SELECT doc_id, octet_length(encode(text)) n FROM documents) WHERE n > 4000)")
def oversized_split(spark, d):
    return encode.oversized_updates(_t(spark, d, "documents").select("doc_id", "text"), "documents", "doc_id", "text", 4000).select("doc_id", "chunk", "n_bytes")


@query("SELECT DISTINCT hex(encode(c_mktsegment)) sort_key, c_mktsegment AS name FROM customer")
def sorted_distinct_keys(spark, d):
    c = _t(spark, d, "customer").select(F.hex(F.col("c_mktsegment").cast("binary")).alias("sort_key"), F.col("c_mktsegment").alias("name"))
    return c.groupBy("sort_key").agg(F.min("name").alias("name")).orderBy("sort_key")


@query(f"SELECT page_id, array_to_string(list_filter(list_sort(list_distinct(string_split({_PATH}, '/'))), lambda x: x NOT IN ('', 'en')), ',') parts FROM pages")
def array_difference(spark, d):
    parts = F.array_except(F.array_distinct(F.split(paths.url_path(F.col("url")), "/")), F.array(F.lit(""), F.lit("en")))
    return _t(spark, d, "pages").select("page_id", F.array_join(F.array_sort(parts), ",").alias("parts"))


@query(f"""WITH t AS (SELECT text || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(12) WHEN 2 THEN chr(127) ELSE '' END || repeat('x', 70) v, doc_id % 4 k FROM (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 20), '[^ -~]', '', 'g') AS text FROM documents))
 SELECT k, count(*) n, count(*) FILTER (WHERE regexp_matches(v, '[\x00-\x08\x0B\x0E-\x1F\x7F]')) n_binary FROM t GROUP BY k""")
def text_sniff(spark, d):
    # Clean text, with a form feed (text still), with DEL (binary), each within the first 64 bytes.
    k = F.col("doc_id") % 4
    head = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 20), "[^ -~]", "")
    v = F.concat(head, F.when(k == 1, "\f").when(k == 2, "\x7f").otherwise(""), F.lit("x" * 70))
    return _t(spark, d, "documents").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_if(~encode.is_text(v)).alias("n_binary"))


@query(f"SELECT page_id, regexp_extract({_PATH}, '([^/]*)$', 1) base, CASE WHEN regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) END dir FROM pages")
def path_parts(spark, d):
    p = paths.url_path(F.col("url"))
    return _t(spark, d, "pages").select("page_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END bytes FROM part")
def parse_sizes(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("", "K", "m", "G"))), (F.col("p_size") % 4 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", encode.bytes_of(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE greatest(0.2, least(10.0, CAST(event_id % 25 AS DOUBLE))) END::DOUBLE pause FROM events")
def duty_pause(spark, d):
    elapsed = (F.col("event_id") % 25).cast("double")
    return _t(spark, d, "events").select("event_id", adaptive.pause(elapsed, F.col("event_id") % 13 == 0).alias("pause"))


@query(f"""WITH {_MAPPING}, x AS (SELECT page_id, url, arg_min(f, ord) f, arg_min(t, ord) t FROM pages LEFT JOIN m ON regexp_replace(url, '[?#].*$', '') = f OR starts_with(regexp_replace(url, '[?#].*$', ''), f || '/') GROUP BY page_id, url),
 y AS (SELECT page_id, CASE WHEN f IS NULL THEN url ELSE t || substr(url, length(f) + 1) END new_url FROM x)
 SELECT 'page_id' AS "column", 'number' kind, CAST(page_id AS VARCHAR) AS value FROM y UNION ALL SELECT 'url', 'base64', new_url FROM y""")
def rewrite_dump(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url")
    mapping = [(r["from"], r["to"]) for r in _mapping(spark).orderBy("ord").collect()]
    dump = sqltext.rewritten(encode.insert_statements(pages, "posts", ["page_id"]), mapping)
    return dump.select(F.explode(sqltext.parsed(F.col("sql"))).alias("c")).select("c.column", "c.kind", "c.value")


@query("SELECT page_id, '/php' path, 0 AS ord, url leaf FROM pages")
def php_leaves(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.concat(F.lit('a:1:{s:3:"url";s:'), F.octet_length("url"), F.lit(':"'), F.col("url"), F.lit('";}')).alias("v"))
    return p.select("page_id", F.explode(nested.string_leaves(F.col("v"))).alias("x")).select("page_id", "x.path", "x.ord", "x.leaf")


@query(f"""WITH {_MAPPING}, x AS (SELECT page_id, url, arg_min(f, ord) f, arg_min(t, ord) t FROM pages LEFT JOIN m ON regexp_replace(url, '[?#].*$', '') = f OR starts_with(regexp_replace(url, '[?#].*$', ''), f || '/') GROUP BY page_id, url),
 y AS (SELECT page_id, CASE WHEN f IS NULL THEN url ELSE t || substr(url, length(f) + 1) END new_url FROM x) SELECT page_id, '{{"url":"' || new_url || '","n":1.5}}' v FROM y""")
def rewrite_nested(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.to_json(F.struct("url", F.lit(1.5).alias("n"))).alias("v"))
    mapping = [(r["from"], r["to"]) for r in _mapping(spark).orderBy("ord").collect()]
    return p.select("page_id", nested.rewrite(F.col("v"), mapping).alias("v"))


@query(f"SELECT page_id, {_ORIGIN} origin FROM pages")
def origins_nested(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.to_json(F.struct("url")).alias("v"))
    return p.select("page_id", F.explode(nested.origins(F.col("v"))).alias("origin"))


@query()
def insert_dump(spark, d):
    return encode.insert_statements(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer", ["c_custkey"]).select("stmt_no", "sql")


@query("SELECT 'customer' AS \"table\", 'c_custkey' AS \"column\", 'number' kind, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT 'customer', 'c_name', 'base64', c_name FROM customer UNION ALL SELECT 'customer', 'c_nationkey', 'number', CAST(c_nationkey AS VARCHAR) FROM customer")
def parse_insert(spark, d):
    return insert_dump(spark, d).select(F.explode(sqltext.scanned(F.col("sql"))).alias("c")).select("c.table", "c.column", "c.kind", "c.value")


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || '; ''' END c_mktsegment FROM customer")
def dump_file_rows(spark, d):
    """The table written as a dump, its file read by splits, and its rows again, without Python but for the cut into statements."""
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit("; '"))).alias("c_mktsegment"))
    path = f"{lineage.folder(spark)}/dump-{uuid.uuid4().hex}"
    dump.write_dump(dump.fragments(rows, "customer", ["c_custkey"]), path)
    statements = sqltext.read_statements(spark, path).where("sql LIKE '%INSERT INTO `customer`%'")
    # The first row of a file may follow a line break.
    cells = statements.select(F.col("source"), F.col("stmt_no"), F.explode(sqltext.scanned(F.regexp_replace("sql", "^\\s+", ""))).alias("c"))
    wide = cells.groupBy("source", "stmt_no", "c.row_no").pivot("c.column", rows.columns).agg(F.first("c.value"))
    return wide.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])


@query("SELECT 't' AS \"table\", 'irs' shape, count(*) n, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) texts FROM customer")
def insert_shapes(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    found = sqltext.shaped(encode.insert_statements(rows, "t", ["c_custkey"]))
    return found.groupBy("table", "shape").agg(F.count("*").alias("n"), F.count(F.col("params")[2]).alias("texts"))


@query("SELECT 'customer' AS \"table\", CASE c_custkey % 3 WHEN 0 THEN 'pk=NULL' WHEN 1 THEN 'pk=' || CAST(floor(c_custkey * -1.5) + CASE WHEN floor(c_custkey * -1.5) <> c_custkey * -1.5 THEN 1 ELSE 0 END AS BIGINT) ELSE 'pk=' || c_custkey END row_id, c_name option_name FROM customer")
def insert_row_names(spark, d):
    first = F.when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") * -1.5).cast("string")).when(F.col("c_custkey") % 3 == 2, F.col("c_custkey").cast("string")).otherwise("NULL")
    sql = F.concat(F.lit("INSERT INTO `customer` (`id`, `option_name`) VALUES ("), first, F.lit(",FROM_BASE64('"), encode.to_base64(F.col("c_name")), F.lit("'));"))
    return reports.row_names(sqltext.shaped(_t(spark, d, "customer").select(sql.alias("sql"))))


@query("SELECT doc_id, text FROM documents")
def lenient_base64(spark, d):
    """Texts in base64 without padding and with other characters strewn in."""
    code = F.regexp_replace(F.regexp_replace(encode.to_base64(F.col("text")), "=", ""), "(A)", "$1!\n -_")
    return _t(spark, d, "documents").select("doc_id", encode.from_base64_lenient(code).cast("string").alias("text"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN '/f/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.css' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' ELSE '.tpl2' END END p FROM orders)
 SELECT o_custkey, bool_or(coalesce(p LIKE '%.css' OR p LIKE '%.tpl2' AND o_orderkey % 8 = 3, false)) AND count(*) = count(p) gzip FROM f GROUP BY o_custkey""")
def gzip_batches(spark, d):
    k = F.col("o_orderkey")
    ext = F.when(k % 4 == 0, ".css").when(k % 4 == 1, ".jpg").when(k % 4 == 2, ".png").otherwise(".tpl2")
    path = F.when(k % 97 != 0, F.concat(F.lit("/f/"), k.cast("string"), ext))
    files = _t(spark, d, "orders").select("o_custkey", path.alias("path"), F.when(k % 8 == 3, "<p>").otherwise("\0\0").alias("head"))
    return reports.gzip_batches(files, ["o_custkey"], head="head")


@query(f"""WITH p AS (SELECT page_id, {_PATH} path FROM pages), v AS (SELECT page_id, k, CASE k WHEN 0 THEN path || '/./../x//y/..' WHEN 1 THEN 'a' || path || '/../..' ELSE '/..//' END v,
  CASE k WHEN 0 THEN regexp_replace(rtrim(path, '/'), '/[^/]*$', '') || '/x' WHEN 1 THEN CASE WHEN len(string_split(rtrim(path, '/'), '/')) <= 3 THEN 'a' ELSE array_to_string(string_split('a' || rtrim(path, '/'), '/')[: len(string_split(rtrim(path, '/'), '/')) - 2], '/') END ELSE '' END n FROM p, range(3) t(k))
 SELECT page_id, CAST(k AS INTEGER) k, v, n FROM v""")
def path_normalize_bare(spark, d):
    path = paths.url_path(F.col("url"))
    forms = F.array(F.concat(path, F.lit("/./../x//y/..")), F.concat(F.lit("a"), path, F.lit("/../..")), F.lit("/..//"))
    return _t(spark, d, "pages").select("page_id", F.posexplode(forms).alias("k", "v")).withColumn("n", paths.normalized_bare(F.col("v")))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment || '/' || c_name v, c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
 e AS (SELECT c_nationkey, v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 i FROM c)
 SELECT n.c_nationkey, 'a:' || count(v) || ':{' || coalesce(string_agg('i:' || i || ';s:' || strlen(v) || ':"' || v || '";', '' ORDER BY i), '') || '}' lists FROM (SELECT DISTINCT c_nationkey FROM customer) n LEFT JOIN e USING (c_nationkey) GROUP BY n.c_nationkey""")
def serialized_lists(spark, d):
    """Serialized lists of a nation's customers by segment, without those of two segments, counted and numbered anew."""
    c = _t(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws("/", "c_mktsegment", "c_name").alias("v"))
    lists = c.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "v"))), lambda x: x.v).alias("v"))
    item = lambda x, i: F.concat(F.lit("i:"), i.cast("string"), F.lit(";s:"), F.octet_length(x).cast("string"), F.lit(':"'), x, F.lit('";'))
    text = F.concat(F.lit("a:"), F.size("v").cast("string"), F.lit(":{"), F.array_join(F.transform("v", item), ""), F.lit("}"))
    return lists.select("c_nationkey", nested.without(text, ["BUILDING", "MACHINERY"]).alias("lists"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) price, o_orderstatus st FROM orders WHERE o_custkey IS NOT NULL),
 l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i FROM o),
 r AS (SELECT o_custkey, o_orderkey, price + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END price, st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i FROM o WHERE o_orderkey % 11 <> 0),
 f AS (SELECT o_custkey "key", i, unnest(['.key', '.price', '.at.status']) p, unnest([CAST(o_orderkey AS VARCHAR), CAST(price AS VARCHAR), '"' || st || '"']) v FROM l),
 g AS (SELECT o_custkey "key", i, unnest(['.key', '.price', '.at.status']) p, unnest([CAST(o_orderkey AS VARCHAR), CAST(price AS VARCHAR), '"' || st || '"']) v FROM r),
 b AS (SELECT coalesce(f.key, g.key) "key", '$.orders[' || coalesce(f.i, g.i) || ']' || coalesce(f.p, g.p) path, f.v old, g.v "new" FROM f FULL OUTER JOIN g ON f.key = g.key AND f.i = g.i AND f.p = g.p)
 SELECT "key", path, CASE WHEN old IS NULL THEN 'add' WHEN "new" IS NULL THEN 'remove' ELSE 'change' END op, old, "new" FROM b WHERE old IS DISTINCT FROM "new" """)
def document_drift(spark, d):
    """Documents of a customer's orders as each side has them, and what differs, by path."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("price"), "o_orderstatus").where("o_custkey IS NOT NULL")

    def docs(rows):
        item = F.struct(F.col("o_orderkey").alias("key"), "price", F.struct(F.col("o_orderstatus").alias("status")).alias("at"))
        return rows.groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("orders"))).alias("doc"))

    moved = o.where("o_orderkey % 11 <> 0").withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return reports.drift(docs(o), docs(moved), "o_custkey", "doc")


@query("""WITH p AS (SELECT page_id, 'm' || page_id % 3 || '.example' h, coalesce(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/') t FROM pages)
 SELECT page_id, '<a href="' || CASE WHEN page_id % 3 < 2 THEN 'https&#58;//new.test/' || page_id % 3 ELSE 'https://m2.example' END || t || '?a=1&amp;b=2">x</a><img srcset="'
 || CASE WHEN page_id % 3 < 2 THEN '//new.test/' || page_id % 3 ELSE '//m2.example' END || t || ' 2x"><i title="//' || h || '/">a &lt; b</i>' v FROM p""")
def rewrite_markup(spark, d):
    """URLs written with character references, without a scheme and in candidate lists, moved in place by host."""
    path = F.when(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1) != "", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)).otherwise("")
    host = F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string"), F.lit(".example"))
    text = F.concat(F.lit('<a href="'), F.when(F.col("page_id") % 3 < 2, "https&#58;//").otherwise("https://"), host, path, F.lit('?a=1&amp;b=2">x</a><img srcset="//'), host, path, F.lit(' 2x"><i title="//'), host, F.lit('/">a &lt; b</i>'))
    mapping = [(f"https://m{k}.example", f"https://new.test/{k}") for k in range(2)]
    return _t(spark, d, "pages").select("page_id", nested.rewrite(text, mapping, "block_markup").alias("v"))


@query("""WITH r AS (SELECT p_partkey AS start, p_partkey + CASE WHEN p_partkey % 500 = 0 THEN 100000 ELSE 1 + p_size % 5 END AS stop, p_name AS name FROM part)
 SELECT o_orderkey, o_custkey AS at, name FROM orders LEFT JOIN r ON o_custkey >= start AND o_custkey < stop""")
def range_stab(spark, d):
    """Every range, of any length and lying over others, that holds a point."""
    stop = F.col("p_partkey") + F.when(F.col("p_partkey") % 500 == 0, 100000).otherwise(1 + F.col("p_size") % 5)
    ranges = _t(spark, d, "part").select(F.col("p_partkey").alias("start"), stop.alias("stop"), F.col("p_name").alias("name"))
    return routing.lookup_range(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("at")), ranges, "at", few=20)


@query("""WITH e AS (SELECT user_id, ts, event_type = 'purchase' ok FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 s AS (SELECT user_id, max(ts) t FROM e WHERE ok GROUP BY user_id)
 SELECT e.user_id "key", CAST(count(*) AS INTEGER) failures, CASE WHEN count(*) >= 3 THEN 'quarantined' ELSE 'failing' END status FROM e LEFT JOIN s USING (user_id) WHERE NOT ok AND (t IS NULL OR ts > t) GROUP BY e.user_id""")
def failing_keys(spark, d):
    e = _t(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return stateful.failing_batch(e.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok")))


@query("""WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events WHERE ts IS NOT NULL)
 SELECT start, event_type, count(*) n FROM w GROUP BY 1, 2""")
def x_sliding_windows(spark, d):
    w = replay.windowed_counts(_t(spark, d, "events"), "ts", "event_type", "1 hour", "2 hours", "30 minutes")
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


# Rows at the edges beside those of the tables.


@query("SELECT event_id, event_type FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END event_type FROM events) WHERE event_type IS NULL OR event_type <> 'click'")
def row_exclusion_null_safe(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return scans.exclude(rows, "event_type", "click")


@query("SELECT count(*) n, CAST(sum(doc_id) AS BIGINT) ids FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'http://x.test' ELSE text END AS t FROM documents) WHERE regexp_matches(base64(encode(t)), 'aHR0|dHA6|dHBz|dHRw')")
def base64_prefilter(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("http://x.test"))).otherwise(F.col("text"))
    hits = _t(spark, d, "documents").where(encode.may_hold_url(encode.to_base64(text)))
    return hits.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_PRIORITY = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END"


@query(f"""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN p IS NULL THEN 'NULL' WHEN p = '' THEN '''''' ELSE 'FROM_BASE64(''' || base64(encode(p)) || ''')' END || ',' || CASE WHEN p IS NULL THEN 'NULL' ELSE CAST(CAST(p = '' AS INT) AS VARCHAR) END row_sql
 FROM (SELECT o_orderkey, {_PRIORITY} p FROM orders)""")
def typed_literals(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.expr(_PRIORITY).alias("p"))
    parts = [(F.col("o_orderkey"), T.LongType()), (F.col("p"), T.StringType()), (F.col("p") == "", T.BooleanType())]
    return o.select("o_orderkey", F.concat_ws(",", *[encode.literal(c, kind) for c, kind in parts]).alias("row_sql"))


@query("SELECT c_custkey, '`' || replace(n, '`', '``') || '`' AS quoted, sha1(n) h1, sha256(n) h2 FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '`x' ELSE c_name END n FROM customer)")
def identifiers_and_hashes(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("`x"))).otherwise(F.col("c_name")).alias("n"))
    raw = F.col("n").cast("binary")
    return c.select("c_custkey", encode.quoted(F.col("n")).alias("quoted"), F.sha1(raw).alias("h1"), F.sha2(raw, 256).alias("h2"))


@query("SELECT c_custkey k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def x_except(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey"))


# Reports.


@query("SELECT user_id, count(*) changes FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_id % 9 = 0), -1) GROUP BY user_id")
def volatile_counts(spark, d):
    return reports.open_changes(_t(spark, d, "events"), "user_id", "event_id", F.col("event_id") % 9 == 0)


@query("""WITH n AS (SELECT source, lang, count(*) c, min(doc_id) k FROM documents GROUP BY source, lang), s AS (SELECT *, round(c / CAST(sum(c) OVER (PARTITION BY source) AS DOUBLE), 6) score FROM n)
 SELECT source, coalesce(arg_max(lang, struct_pack(a := score, b := -k)) FILTER (WHERE score >= 0.5), 'other') lang, coalesce(max(score) FILTER (WHERE score >= 0.5), 0.0) score FROM s GROUP BY source""")
def score_argmax(spark, d):
    n = _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"), F.min("doc_id").alias("k"))
    total = F.sum("c").over(Window.partitionBy("source"))
    scored = n.select("source", "lang", "k", F.round(F.col("c") / total, 6).alias("score"))
    return reports.best_scored(scored, ["source"], "lang", "score", "k")


@query(f"SELECT to_json(list(DISTINCT o ORDER BY o)) domains FROM (SELECT {_ORIGIN} o FROM pages UNION ALL SELECT 'https://known.test') WHERE o <> ''")
def domain_list(spark, d):
    return reports.sorted_domains(_t(spark, d, "pages").select(paths.origin(F.col("url")).alias("origin")), known=["https://known.test"])


@query("""SELECT doc_id, CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS "lines", CAST(len(list_filter(regexp_extract_all(substr(hex(encode(t)), 1, 1000), '..'), lambda x: x = '0A')) AS BIGINT) early FROM (SELECT doc_id, coalesce(text, '') t FROM documents)""")
def line_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", reports.newlines(F.col("text")).alias("lines"), reports.newlines(F.col("text"), 500).alias("early"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort([{'n': -length(p_name), 'i': 0, 'c': 'p_name'}, {'n': -length(p_brand), 'i': 1, 'c': 'p_brand'}, {'n': -length(p_type), 'i': 2, 'c': 'p_type'}]), lambda x: x.c), ',') AS names FROM part""")
def largest_first_columns(spark, d):
    sizes = {c: F.length(c) for c in ("p_name", "p_brand", "p_type")}
    return _t(spark, d, "part").select("p_partkey", F.array_join(reports.largest_first(sizes), ",").alias("names"))


_COLUMNS = [("wp_posts", "post_content"), ("posts", "post_title"), ("comments", "comment_content"), ("x_posts", "post_content"), ("wp_term_taxonomy", "description")]


@query("SELECT event_id, tab, col, CASE WHEN tab = 'x_posts' OR col = 'post_title' THEN NULL ELSE 'block_markup' END kind FROM (SELECT event_id, (event_id + user_id) % 5 i FROM events) JOIN (VALUES " + ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(_COLUMNS)) + ") v(i, tab, col) USING (i)")
def column_hint_join(spark, d):
    """The hint of the column that each event names."""
    at = ((F.col("event_id") + F.col("user_id")) % 5 + 1).cast("int")
    name = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in _COLUMNS]), at)
    e = _t(spark, d, "events").select("event_id", name(0).alias("tab"), name(1).alias("col"))
    return reports.hinted(e, {k: "block_markup" for k in sqltext.MARKUP})


_DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "binary": "BLOB", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, column_name col, replace(column_type, ' WITH TIME ZONE', '') kind FROM (DESCRIBE {t})" for t in _TABLES))
def column_metadata(spark, d):
    rows = [(t, c["name"], _DUCK_TYPES.get(c["type"], c["type"])) for t in _TABLES for c in scans.columns_of(_t(spark, d, t))]
    return spark.createDataFrame(rows, "name string, col string, kind string")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source, stmt_no, sql FROM (
 SELECT doc_id, CAST(0 AS BIGINT) stmt_no, '-- rows; of ' || lang || chr(10) || 'INSERT INTO `t;` (a) VALUES (''' || source || ';''''x'');' AS sql FROM documents
 UNION ALL SELECT doc_id, 1, chr(10) || '/* ; */ SELECT ";";' FROM documents)""")
def split_statements(spark, d):
    line = F.concat(F.lit("-- rows; of "), "lang", F.lit("\nINSERT INTO `t;` (a) VALUES ('"), "source", F.lit(";''x');\n/* ; */ SELECT \";\";\n# end;"))
    texts = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), line.alias("value"))
    return sqltext.statements(texts).select("source", "stmt_no", "sql")


@query("SELECT lang, 2 * count(*) AS \"statements\", count(*) inserts, count(*) payloads, CAST(sum(77 + strlen(to_base64(encode(source)))) AS BIGINT) bytes FROM documents GROUP BY lang")
def statement_counts(spark, d):
    line = F.concat(F.lit("-- a;\nINSERT INTO t (a) VALUES (FROM_BASE64('"), encode.to_base64(F.col("source")), F.lit("'));\nUPDATE t SET a = 'INSERT;';"))
    found = sqltext.statements(_t(spark, d, "documents").select(F.col("lang").alias("source"), line.alias("value")))
    return reports.statement_counts(found.withColumnRenamed("source", "lang"), ["lang"])


@query("""SELECT event_id, '/json' path, 0 AS ord, event_type leaf FROM events UNION ALL SELECT event_id, '/json', 1, CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, '/json/json', 2, 'in "' || event_type || '"' FROM events""")
def json_leaves(spark, d):
    inner = F.to_json(F.array(F.concat(F.lit('in "'), "event_type", F.lit('"'))))
    value = F.to_json(F.struct("event_type", F.col("event_id").alias("n"), F.array(F.struct(F.col("user_id").cast("string").alias("u"))).alias("list"), inner.alias("json")))
    return _t(spark, d, "events").select("event_id", F.explode(nested.string_leaves(value)).alias("x")).select("event_id", "x.path", "x.ord", "x.leaf")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) n_bytes FROM documents WHERE text IS NOT NULL")
def dump_fragments(spark, d):
    """Whole texts go out as INSERTs and the UPDATEs of oversized cells, and are measured as they come back."""
    rows = dump.fragments(_t(spark, d, "documents").select("doc_id", "text"), "documents", ["doc_id"], limit=8192)
    cells = rows.where("section = 2").select(F.explode(F.regexp_extract_all("sql", F.lit(r"\((\d+,(?:FROM_BASE64\('[^']*'\)|''|NULL))\)"), 1)).alias("c"))
    payload = r"FROM_BASE64\('([^']*)'"
    sent = cells.select(F.substring_index("c", ",", 1).alias("doc_id"), F.regexp_extract("c", payload, 1).alias("b"), F.endswith("c", F.lit("NULL")).alias("none"))
    more = rows.where("section = 3").select(F.regexp_extract("sql", r"= (\d+);$", 1).alias("doc_id"), F.regexp_extract("sql", payload, 1).alias("b"), F.lit(False).alias("none"))
    size = F.coalesce(F.octet_length(encode.from_base64(F.col("b"))), F.lit(0)).cast("long")
    return sent.unionByName(more).where("NOT none").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(size).alias("n_bytes"))


@query(f"""SELECT page_id, CASE WHEN p = '/en' OR starts_with(p, '/en/') THEN '/real/en2' || substr(p, 4) WHEN p = '/fr' OR starts_with(p, '/fr/') THEN NULL ELSE p END canonical
 FROM (SELECT page_id, '/' || array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> '' AND x <> '.'), '/') p FROM pages)""")
def canonical_paths(spark, d):
    links = spark.createDataFrame([("/en", "w/en2"), ("/w", "/real"), ("/fr", "fr2"), ("/fr2", "/fr")], "path string, target string")
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return trees.canonical(p, links).select("page_id", "canonical")


@query(f"WITH {_SIDES} SELECT o_orderkey, CASE WHEN op = 'delete' THEN 'file_missing' ELSE 'file_changed' END error, local_price expected, remote_price actual FROM d WHERE op = 'delete' OR (op <> 'add' AND local_price <> remote_price)")
def changed_while_reading(spark, d):
    return reports.changed_since(_local(spark, d), _remote(spark, d), "o_orderkey", "price")


@query("SELECT o_orderkey path, o_orderpriority AS \"type\", o_orderstatus local_type, CASE WHEN o_orderstatus = 'dir' THEN 'rmtree' ELSE 'unlink' END step FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'dir' ELSE 'file' END o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'dir' ELSE 'file' END o_orderpriority FROM orders) WHERE o_orderstatus <> o_orderpriority")
def type_swaps(spark, d):
    kind = lambda n: F.when(F.col("o_orderkey") % n == 0, "dir").otherwise("file").alias("type")
    path = F.col("o_orderkey").alias("path")
    return trees.blockers(_t(spark, d, "orders").select(path, kind(3)), _t(spark, d, "orders").select(path, kind(2)))


@query(f"""SELECT page_id, CASE WHEN p = '/en' OR starts_with(p, '/en/') THEN '/flat/english' || substr(p, 4) WHEN p = '/fr' OR starts_with(p, '/fr/') THEN '/flat' || substr(p, 4) END placed FROM (SELECT page_id, {_PATH} p FROM pages)""")
def flat_layout(spark, d):
    p = _t(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return trees.flat_layout(p, "/flat/", [("/en", "english"), ("/fr/", "")]).select("page_id", "placed")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || ' B' WHEN 1 THEN p_size || '.5 KB' ELSE p_size || '.0 GB' END AS size FROM part")
def size_texts(spark, d):
    n = F.col("p_size").cast("long")
    b = F.when(n % 3 == 0, n).when(n % 3 == 1, n * 1024 + 512).otherwise(n * (1 << 30))
    return _t(spark, d, "part").select("p_partkey", encode.size_text(b).alias("size"))


# Extensions: what Spark gives beyond the parity set.


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) sum_qty, count(*) n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) orders, CAST(sum(round(o_totalprice)) AS BIGINT) total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x_join_agg(spark, d):
    o, c, n = (_t(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(F.round("o_totalprice")).cast("long").alias("total"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) r FROM orders QUALIFY r <= 3")
def x_window_topk(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r")).where("r <= 3")


@query("SELECT user_id, count(*) sessions, CAST(max(n) AS BIGINT) longest FROM (SELECT user_id, s, count(*) n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END f FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def x_session_windows(spark, d):
    s = _t(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) n FROM events GROUP BY 1, 2")
def x_tumbling_windows(spark, d):
    w = _t(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def x_rollup(spark, d):
    return _t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey k FROM customer INTERSECT SELECT o_custkey FROM orders")
def x_intersect(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(_t(spark, d, "orders").select("o_custkey"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
