"""Databases, dumps, file trees and SQL functions."""

import base64
import hashlib
import hmac
import os
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import encode, paths, register
from tidewater.operators import reports, scans, trees
from tidewater.sources import databases, dump, records, sqltext


@pytest.fixture
def site(tmp_path):
    path = str(tmp_path / "site.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL, raw BLOB)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, None if i % 5 == 0 else f"n'{i}", i / 2, bytes([i % 256])) for i in range(-3, 500)])
    con.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.execute("INSERT INTO w VALUES ('a', 1)")
    con.execute("CREATE TABLE none (a INT)")
    con.execute("CREATE VIEW v AS SELECT id FROM t WHERE id > 490")
    con.commit()
    con.close()
    return path


def test_sqlite_tables_are_read_by_ranges(spark, site):
    df = databases.read_sqlite(spark, site, "t", parts=4)
    assert df.rdd.getNumPartitions() == 4 and df.schema["id"].metadata["pk_ordinal"] == 1
    assert sorted(tuple(r) for r in df.collect()) == sorted(sqlite3.connect(site).execute("SELECT * FROM t").fetchall())
    assert databases.read_sqlite(spark, site, "w").collect()[0].k == "a"
    assert databases.read_sqlite(spark, site, "v").count() == 9 and databases.read_sqlite(spark, site, "none").count() == 0
    assert databases.sqlite_tables(site) == ["none", "t", "w"] and databases.sqlite_tables(site, ["t", "v"]) == ["t"]
    assert [c["key"] for c in scans.columns_of(df)] == [1, None, None, None]


def test_sqlite_writes_are_whole_or_nothing(spark, site):
    rows = spark.createDataFrame([(1000 + i, f"x{i}", None, bytearray(b"\x00")) for i in range(100)], "id long, name string, x double, raw binary").repartition(5)
    databases.write_sqlite(rows, site, "t")
    databases.write_sqlite(rows, site, "fresh")
    databases.write_sqlite(rows.limit(10), site, "fresh", "overwrite")
    con = sqlite3.connect(site)
    assert con.execute("SELECT count(*), count(x) FROM t WHERE id >= 1000").fetchone() == (100, 0)
    assert con.execute("SELECT count(*) FROM fresh").fetchone() == (10,)
    bad = rows.withColumn("name", F.when(F.col("id") == 1050, F.raise_error(F.lit("stop"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="stop"):
        databases.write_sqlite(bad, site, "fresh", "overwrite")
    assert con.execute("SELECT count(*) FROM fresh").fetchone() == (10,) and databases.sqlite_tables(site) == ["fresh", "none", "t", "w"]


def test_jdbc_options():
    assert databases.jdbc_options("jdbc:x", "t", budget=30) == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "1000", "queryTimeout": "24"}
    assert databases.split_options("id", 1, 10, 4) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "11", "numPartitions": "4"}
    assert databases.split_options("id", 5, 5, 4)["numPartitions"] == "1"
    with pytest.raises(ValueError):
        databases.split_options("id", 2, 1, 4)


def test_dump_is_applied_once(spark, tmp_path):
    """A dump with oversized cells of composite and null keys, applied, applied again, and gone on with after a failure."""
    path = str(tmp_path / "target.db")
    rows = [(i, f"k{i % 7}", "x" * (i % 90) * 60, "y" * 1500 if i % 11 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, `k``k` string, a string, b string")
    out = dump.fragments(df, "t`x", ["id", "k`k"], batch=7, limit=4000)
    assert out.where("section = 2").agg(F.max(F.length("sql"))).first()[0] <= 7 * 4000 + 200
    assert out.where("section = 3").agg(F.max(F.length("sql"))).first()[0] <= 4000

    def connect():
        con = sqlite3.connect(path, timeout=60)
        con.create_function("FROM_BASE64", 1, lambda s: base64.b64decode(s).decode("latin-1"))
        con.create_function("CONCAT", 2, lambda a, b: a + b)
        return con

    def broken(cursor, sql):
        if "`a` = CONCAT" in sql and sum(sql.encode()) % 9 == 0:
            raise RuntimeError("lost")
        cursor.execute(sql)

    with pytest.raises(Exception, match="lost"):
        dump.apply(out, connect, "r'1", str(tmp_path / "stage"), every=3, session=False, execute=broken)
    # Again, parted and numbered otherwise: nothing is lost or done twice.
    for n in ("3", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        dump.apply(dump.fragments(df.repartition(int(n)), "t`x", ["id", "k`k"], batch=7, limit=4000), connect, "r'1", str(tmp_path / "stage"), every=3, session=False)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(connect().execute("SELECT * FROM `t``x`").fetchall())
    assert got == sorted(rows)
    with pytest.raises(Exception, match="no primary key"):
        dump.fragments(df, "t", [], limit=4000).where("section = 2").collect()
    assert dump.fragments(df, "t", [], limit=1 << 20).where("section = 2").count() > 0


def test_every_connection_is_set_up(spark, tmp_path):
    """A target that keeps each connection's settings: the header comes first and the footer last on every one, one statement at a time."""
    log = tmp_path / "log"
    log.mkdir()

    class Cursor:
        def __init__(self, con):
            self.con, self.real = con, con.real.cursor()

        def execute(self, sql):
            if sql.strip().rstrip(";").count(";\n") or "; " in sql.replace("'", ""):
                raise AssertionError(f"several statements: {sql}")
            word = sql.split()[0]
            if word in ("SET", "COMMIT", "COMMIT;"):
                self.con.said.append(sql.strip())
            else:
                if word == "INSERT" and "`t`" in sql and not any("UNIQUE_CHECKS=0" in s for s in self.con.said):
                    raise AssertionError("not set up")
                self.real.execute(sql)

        def fetchall(self):
            return self.real.fetchall()

    class Connection:
        def __init__(self):
            self.real, self.said = sqlite3.connect(str(tmp_path / "t.db"), timeout=60), []
            self.real.create_function("FROM_BASE64", 1, lambda s: base64.b64decode(s).decode())

        def cursor(self):
            return Cursor(self)

        def commit(self):
            self.real.commit()

        def rollback(self):
            self.real.rollback()

        def close(self):
            if any("UNIQUE_CHECKS=0" in s for s in self.said):
                assert any(s.startswith("SET UNIQUE_CHECKS=@OLD") for s in self.said)
                (log / os.urandom(6).hex()).write_text("")
            self.real.close()

    df = spark.createDataFrame([(i, f"v{i}") for i in range(90)], "id int, v string").repartition(4)
    dump.apply(dump.fragments(df, "t", ["id"], batch=5), Connection, "r", str(tmp_path / "stage"), every=4)
    assert len(list(log.iterdir())) >= 2
    assert sqlite3.connect(str(tmp_path / "t.db")).execute("SELECT count(*), min(v), max(id) FROM t").fetchone() == (90, "v0", 89)


def test_long_text_keys_fit_their_index(spark):
    df = spark.createDataFrame([("k" * 400, 1), ("s", 2)], "k string, n int")
    sql = dump.fragments(df, "t", ["k"]).where("section = 1").first().sql
    assert "`k` VARCHAR(400) NOT NULL" in sql
    assert "`k` VARCHAR(191)" in dump.create_table(df, "t", ["k"])


BITS = [
    "SELECT 'a;b'", 'INSERT INTO t VALUES ("x\\";", `y;`)', "/* ; */ SELECT 1", "-- c;\nSELECT 2", "UPDATE t SET a='it''s;'", "# x;'\n  ", "/*!40101 SET x=1 */", "  ", "SELECT 'long" + ";z\\'" * 40 + "'",
    "é'ü;'", "a - b -- c ; d\n", "'\\\\'", "--x", "/ * 3", "",
]
TAILS = ["", " ", "SELECT 9", "'open; quote", "/* open ; ", "-- open ;", " -- end", "\\"]


@pytest.mark.parametrize("size", [37, 400])
def test_one_dump_file_is_read_by_many_tasks(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {f"f{k}.sql": "".join(rng.choice(BITS) + ";" + rng.choice(["\n", "", " "]) for _ in range(60)) + tail for k, tail in enumerate(TAILS)}
    texts |= {"empty.sql": "", "one.sql": ";", "mark.sql": "\ufeffSELECT 1;SELECT 2"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.sql").write_bytes(b"SELECT '\xff\xfe;';SELECT 2;")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    read = sqltext.read_statements(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 8
    got = {}
    for r in read.select(F.substring_index("source", "/", -1).alias("name"), "stmt_no", "byte_start", "byte_end", F.col("sql").cast("binary").alias("sql")).collect():
        got.setdefault(r.name, []).append((r.stmt_no, r.byte_start, r.byte_end, bytes(r.sql)))
    for k, v in old.items():
        spark.conf.set(k, v)
    for name, text in texts.items():
        text, lead = text.removeprefix("\ufeff"), 3 * text.startswith("\ufeff")
        want = [(n, lead + len(text[:a].encode()), lead + len(text[:b].encode()), q.encode()) for n, (a, b, q) in enumerate(sqltext.split(text))]
        assert sorted(got.pop(name, [])) == want, name
    assert sorted(got.pop("bytes.sql")) == [(0, 0, 13, b"SELECT '\xff\xfe;';"), (1, 13, 22, b"SELECT 2;")] and not got


def test_a_dump_file_is_read_moved_and_applied_as_one_job(spark, tmp_path):
    b = lambda s: base64.b64encode(s.encode()).decode()
    lines = ["-- a dump\nSET NAMES utf8;", "DROP TABLE IF EXISTS `p`;", "CREATE TABLE `p` (`id` INT, `v` LONGTEXT, PRIMARY KEY (`id`));"]
    lines += [f"INSERT INTO `p` (`id`, `v`) VALUES ({i}, FROM_BASE64('{b(f'see https://old.test/{i};')}'));" for i in range(200)]
    lines += ["UPDATE `p` SET `v` = CONCAT(`v`, FROM_BASE64('" + b("!") + "')) WHERE `id` = 3;"] * 2 + ["COMMIT;"]
    (tmp_path / "d.sql").write_text("\n".join(lines))
    path = str(tmp_path / "t.db")

    def connect():
        con = sqlite3.connect(path, timeout=60)
        con.create_function("FROM_BASE64", 1, lambda s: base64.b64decode(s).decode())
        con.create_function("CONCAT", 2, lambda a, b: a + b)
        return con

    def broken(cursor, sql):
        if "(150," in sql:
            raise RuntimeError("lost")
        cursor.execute(sql)

    job = lambda **more: dump.apply_file(spark, str(tmp_path / "d.sql"), [("https://old.test", "https://new.test")], connect, "r", str(tmp_path / "stage"), every=10, session=False, stretch=4000, **more)
    with pytest.raises(Exception, match="lost"):
        job(execute=broken)
    for _ in range(2):
        job()
    want = [(i, f"see https://new.test/{i};" + "!!" * (i == 3)) for i in range(200)]
    assert connect().execute("SELECT id, v FROM p ORDER BY id").fetchall() == want


def test_producer_statements_are_scanned_in_the_jvm(spark):
    rows = [(i, None if i % 3 == 0 else f"v'{i}\n`é" if i % 5 else "", i * 1.5 if i % 2 else -1e-20, bytearray([i % 256, 255]), '{"a":%d}' % i) for i in range(400)]
    df = spark.createDataFrame(rows, "`i``d` int, t string, x double, b binary, j string")
    made = encode.insert_statements(df, "t`a", ["i`d"], json=["j"])
    plan = made.select(sqltext.scanned(F.col("sql")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    both = spark.createDataFrame(made.collect(), made.schema)
    got = both.select(sqltext.scanned(F.col("sql")).alias("a"), sqltext.parsed(F.col("sql")).alias("b")).collect()
    assert got and all(r.a == r.b and r.a for r in got)
    others = ["INSERT INTO `t` (`a`) VALUES\n(1),\n(2)", "INSERT INTO `t` (`a`) VALUES\n(1 );", "INSERT INTO `t` (`a`, `b`) VALUES\n(1,2),\n(3);", "INSERT INTO `t` (`a`) VALUES\n('x');", "UPDATE `t` SET a=1;", "x", "", None]
    texts = spark.createDataFrame([(t,) for t in others], "sql string")
    assert texts.where(sqltext.scanned(F.col("sql")).isNotNull()).count() == 0
    cells = {r.sql: [(c.row_no, c.column, c.kind, c.value) for c in r.cells] for r in sqltext.parse(texts).collect()}
    assert cells[others[3]] == [(0, "a", "string", "x")] and cells[others[1]] == [(0, "a", "number", "1")] and cells["x"] == cells[None] == []
    # Time is in proportion to the cells, and nothing is on a stack.
    row = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.concat(F.lit("("), i.cast("string"), F.lit(",FROM_BASE64('eHh4'))")))
    big = spark.range(1).select(F.concat(F.lit("INSERT INTO `t` (`a`, `b`) VALUES\n"), F.array_join(row, ",\n"), F.lit(";")).alias("sql"))
    assert big.select(F.size(sqltext.scanned(F.col("sql")))).first()[0] == 200_000


def test_splitter_takes_time_in_proportion():
    def took(n):
        splitter, text = sqltext.Splitter(), "INSERT INTO t VALUES ('" + "x;" * n + "');"
        began = time.process_time()
        for at in range(0, len(text), 4096):
            splitter.feed(text[at : at + 4096])
        return time.process_time() - began

    took(100_000)
    assert took(4_000_000) < 12 * max(took(1_000_000), 0.05)


def test_index_lines_and_file_chunks(spark, tmp_path):
    rows = [("/a/b c", 5, 10, "file"), ("/é\n", None, 0, "dir"), ("/" + "x" * 300, 1, 2, "link")]
    df = spark.createDataFrame(rows, records.INDEX)
    records.write_index(df, str(tmp_path / "i"))
    assert sorted(map(str, records.read_index(spark, str(tmp_path / "i")).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"path": "YQ==", "ctime": 1}\n{"path": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_index(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "big").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "f" / "none").write_bytes(b"")
    tree = {os.path.basename(r.path): (r.size, r.type) for r in records.read_tree(spark, str(tmp_path / "f")).collect()}
    assert tree == {"big": (2560, "file"), "none": (0, "file")}
    files = records.read_tree(spark, str(tmp_path / "f"))
    got = sorted((os.path.basename(r.path), r.offset, bytes(r.data), r.first, r.last, r.error) for r in records.contents(files, 1000, 1000).collect())
    data = bytes(range(256)) * 10
    assert got == [("big", 0, data[:1000], True, False, None), ("big", 1000, data[1000:2000], False, False, None), ("big", 2000, data[2000:], False, True, None), ("none", 0, b"", True, True, None)]
    # A file that is not as it was listed.
    listed = files.withColumn("size", F.when(F.col("path").endswith("big"), 2500).otherwise(F.col("size"))).unionByName(spark.createDataFrame([("/no/such", 1, 5, "file")], records.INDEX))
    found = records.contents(listed, 1000, 2000)
    assert {(os.path.basename(r.path), r.offset, r.error) for r in found.where("error IS NOT NULL").collect()} == {("big", 0, "file_changed"), ("big", 2000, "file_changed"), ("such", 0, "file_missing")}
    assert {os.path.basename(r.path) for r in records.whole_files(found).collect()} == {"none"}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "sparse"
    with open(path, "wb") as f:
        f.truncate(5 << 30)
        f.seek((3 << 30) + 7)
        f.write(b"mark")
    files = spark.createDataFrame([(str(path), 5 << 30, None)], "path string, size long, ctime long")
    parts = records.contents(files, 4 << 20, 64 << 20)
    found = parts.where("offset >= 3221225472 AND offset < 3225419776").select("offset", F.substring("data", 8, 4).alias("d"), "first", "last", "error").collect()
    assert [(r.offset, bytes(r.d), r.first, r.last, r.error) for r in found] == [(3 << 30, b"mark", False, False, None)]
    totals = parts.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.sum(F.octet_length("data")), F.count("error"), F.countDistinct("task")).first()
    assert totals[0] == 1280 and totals[1] == 5 << 30 and totals[2] == 0 and totals[3] > 1


def test_written_dump_reads_as_one(spark, tmp_path):
    df = spark.createDataFrame([(i, "a;'b\n" * (i % 3), i % 2 == 0) for i in range(50)], "id int, t string, ok boolean")
    dump.write_dump(dump.fragments(df, "t", ["id"], batch=4), str(tmp_path / "d"))
    text = "".join(open(p).read() for p in sorted(map(str, (tmp_path / "d").glob("part-*"))))
    assert text.startswith(dump.HEADER) and text.rstrip().endswith(dump.FOOTER.strip()) and "  `id` INT NOT NULL" in text and "PRIMARY KEY (`id`)" in text
    cells = [c for _, _, s in sqltext.split(text) for c in sqltext.cells(s) or []]
    assert [c["value"] for c in cells if c["column"] == "id"] == [str(i) for i in range(50)]
    assert {c["value"] for c in cells if c["column"] == "ok"} == {"0", "1"}


def test_only_the_largest_cells_leave_a_row(spark):
    df = spark.createDataFrame([(1, "a" * 3000, "b" * 2000, "c" * 900), (2, "a" * 1500, "b" * 1500, None), (3, "k", None, None)], "id int, a string, b string, c string")
    got = {r.id: r.out for r in df.select("id", dump.split_columns(df, ["id"], 4200, 500).alias("out")).collect()}
    assert got == {1: ["a"], 2: [], 3: []}
    got = {r.id: r.out for r in df.select("id", dump.split_columns(df, ["id"], 2100, 500).alias("out")).collect()}
    assert got == {1: ["a", "b"], 2: ["a"], 3: []}


def test_tree_scan_names_links_and_folders(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f.txt").write_text("xyz")
    (tmp_path / "a/to").symlink_to("b")
    (tmp_path / "a/loop").symlink_to("../a")
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    rows = {os.path.relpath(r.path, root): (r.type, r.size, r.target) for r in trees.scan(spark, [root, root + "/a/", root + "/missing/../missing"]).collect() if r.path}
    assert rows["a"][0] == rows["a/b"][0] == rows["empty"][0] == "dir" and rows["a/b/f.txt"] == ("file", 3, None)
    assert rows["a/to"] == ("link", 0, "b") and rows["a/loop"] == ("link", 0, "../a") and len(rows) == 6
    gone = trees.scan(spark, [root + "/nothing"]).collect()
    assert [(r.type, r.path) for r in gone] == [("error", root + "/nothing")]


def test_walks_follow_links_to_each_folder_once(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    (root / "a/b").mkdir(parents=True)
    (out / "deep").mkdir(parents=True)
    (root / "a/b/f").write_text("x")
    (out / "deep/g").write_text("yy")
    (root / "a/loop").symlink_to("..")
    (root / "one").symlink_to("a/b")
    (root / "two").symlink_to(str(root / "a/b"))
    (root / "leave").symlink_to(str(out))
    (root / "lost").symlink_to("nothing")
    (out / "back").symlink_to(str(root))

    def names(**more):
        rows = trees.scan(spark, [str(root)], **more).collect()
        assert len(rows) == len({r.path for r in rows})
        return {os.path.relpath(r.path, str(tmp_path)): r.type for r in rows}

    inside = {"root/a": "dir", "root/a/b": "dir", "root/a/b/f": "file", "root/a/loop": "link", "root/one": "link", "root/two": "link", "root/leave": "link", "root/lost": "link"}
    assert names() == names(follow=True) == inside
    assert names(follow=True, anywhere=True) == inside | {"out/deep": "dir", "out/deep/g": "file", "out/back": "link"}


def test_links_have_no_bound(spark):
    n = 60
    links = spark.createDataFrame([(f"/l{i}", f"l{i + 1}") for i in range(n)] + [("/g", "h/x"), ("/h", "g/y"), ("/t", "u"), ("/v/w", "/t/z")], "path string, target string")
    p = spark.createDataFrame([("/l0/f",), ("/g/f",), ("/v/w/a/v",), ("/l5/l6",)], "path string")
    assert {r.path: r.canonical for r in trees.canonical(p, links).collect()} == {"/l0/f": f"/l{n}/f", "/g/f": None, "/v/w/a/v": "/u/z/a/v", "/l5/l6": f"/l{n}/l6"}


def test_links_are_followed_part_by_part(spark):
    links = spark.createDataFrame([("/a", "b"), ("/b/c", "../d"), ("/x", "/y"), ("/y", "x"), ("/g", "g/h")], "path string, target string")
    p = spark.createDataFrame([("/a/c/f",), ("/x/1",), ("/plain",), ("/a",), ("/g",), (None,)], "path string")
    assert {r.path: r.canonical for r in trees.canonical(p, links).collect()} == {"/a/c/f": "/d/f", "/x/1": None, "/plain": "/plain", "/a": "/b", "/g": None, None: None}
    out = trees.escaping(links, "/b").collect()
    assert {r.path for r in out} == {"/a", "/b/c", "/x", "/y", "/g"} - {"/a"}


def test_local_files_and_roots(spark):
    wanted = spark.createDataFrame([("/a/new",), ("/a/old",), ("/l/x",), ("/r/x",), ("/n/x",)], "path string")
    local = spark.createDataFrame([("/a", "dir", True), ("/a/old", "file", True), ("/l", "link", True), ("/r", "dir", False), ("/", "dir", True)], "path string, type string, writable boolean")
    assert {r.path for r in trees.kept_local(wanted, local).collect()} == {"/a/new", "/n/x"}
    roots = spark.createDataFrame([("/srv/a/b",), ("/srv/c/",)], "prefix string")
    dirs = spark.createDataFrame([("/srv",), ("/srv/a/b",), ("/srv/a/b/c",), ("/srv/d",), ("/",)], "path string")
    assert {r.path for r in trees.listed_roots(dirs, roots).collect()} == {"/srv/a/b/c", "/srv/d"}


def test_tokens_and_path_parts(spark):
    tokens = {"home": "/srv/home/", "late": None}
    assert paths.with_tokens(":home:/x/", tokens) == "/srv/home//x" and paths.with_tokens("/plain/", tokens) == "/plain"
    for bad in ("/a/:home:", ":home:/:home:", ":late:/x", ":what:/x", "rel", "/a/../b"):
        with pytest.raises(ValueError):
            paths.with_tokens(bad, tokens)
    df = spark.createDataFrame([("/a/b/c", "/a/"), ("/a", "/a"), ("/ab", "/a"), ("/x", "/")], "p string, r string")
    rest = paths.remainder(F.col("p"), F.col("r"))
    assert [r[0] for r in df.select(rest).collect()] == ["b/c", "", None, "x"]
    assert [r[0] for r in df.where("p <> '/ab'").select(paths.joined(F.col("r"), rest)).collect()] == ["/a/b/c", "/a", "/x"]


def test_hmac_and_sizes(spark):
    df = spark.createDataFrame([("",), ("häm",), ("x" * 500,)], "m string")
    for key in (b"k", b"k" * 64, b"\x00\xff" * 50):
        assert [r[1] for r in df.select("m", encode.hmac_sha256(F.col("m"), key)).collect()] == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("", "häm", "x" * 500)]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 30,), (None,)], "n long").select(encode.size_text(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.0 GB", None]


def test_functions_under_sql_names(spark):
    register.register(spark)
    row = spark.sql("SELECT from_base64('YQ==') a, from_base64('!') b, to_base64(CAST(repeat('x', 90) AS BINARY)) c, may_hold_url('aHR0cDov') d").first()
    assert row.a == b"a" and row.b is None and row.c == base64.b64encode(b"x" * 90).decode() and row.d
    leaves = spark.sql("""SELECT path, ord, leaf FROM string_leaves('a:1:{i:0;s:7:"["q",1]";}')""").collect()
    assert [tuple(r) for r in leaves] == [("/php/json", 0, "q")]
    assert [(r.column, r.value) for r in spark.sql("SELECT * FROM parse_insert('INSERT INTO t (a, b) VALUES (1, NULL)')").collect()] == [("a", "1"), ("b", None)]
    assert [r.sql for r in spark.sql("SELECT * FROM split_statements('SELECT 1; SELECT 2')").collect()] == ["SELECT 1;", " SELECT 2"]
    assert spark.sql("SELECT * FROM string_leaves(CAST(NULL AS STRING))").count() == spark.sql("SELECT * FROM parse_insert(CAST(NULL AS STRING))").count() == 0


def test_keyset_after_a_null(spark):
    rows = [(a, b) for a in (None, 1, 2) for b in (None, 1, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    seen, last = [], None
    while page := scans.keyset_page(df, ["a", "b"], last, 2).collect():
        seen += [tuple(r) for r in page]
        last = tuple(page[-1])
    assert seen == rows


def test_folds_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, None), ("g", 3, 6), (None, 1, 20), (None, 2, 1)], "g string, o int, c int")
    assert sorted(tuple(map(str, r)) for r in scans.greedy_batches(df, "g", "o", "c", 10).collect()) == [("None", "0", "1", "20"), ("None", "1", "1", "1"), ("g", "0", "2", "5"), ("g", "1", "1", "6")]
    assert scans.greedy_batches(df.limit(0), "g", "o", "c", 10).count() == 0
    scores = spark.createDataFrame([("h", "a", 0.4, 0), ("i", "a", 0.9, 1), ("i", "b", 0.9, 0), ("j", None, None, 0)], "host string, name string, score double, o int")
    assert {r.host: (r.name, r.score) for r in reports.best_scored(scores, ["host"], "name", "score", "o").collect()} == {"h": ("other", 0.0), "i": ("b", 0.9), "j": ("other", 0.0)}


def test_splitter_on_hard_text():
    cases = {
        "a'b;''c;\\';d';e": ["a'b;''c;\\';d';", "e"],
        "x -- ;\n;y--;z": ["x -- ;\n;", "y--;", "z"],
        "a/b;/*;*/c;": ["a/b;", "/*;*/c;"],
        "`a;``b`;\"q;\\\"\";": ["`a;``b`;", "\"q;\\\"\";"],
        "ok;'open; text": ["ok;", "'open; text"],
        "ok;/* open;": ["ok;", "/* open;"],
        ";;\n# c;\n;": [],
    }
    for text, want in cases.items():
        assert [s for _, _, s in sqltext.split(text)] == want, text


def test_prepared_inserts_give_the_same_rows_from_few_templates(spark, tmp_path):
    rows = [(i, i * 0.5 if i % 2 else None, f"t{i}" if i % 3 else "", bytearray(b"ab") if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, t string, b binary")
    path = str(tmp_path / "p.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE `t` (id INTEGER PRIMARY KEY, x REAL, t TEXT, b TEXT)")
    con.commit()
    made = encode.insert_statements(df, "t", ["id"], batch=20)
    got = databases.write_prepared(sqltext.shaped(made), lambda: sqlite3.connect(path, timeout=60))
    assert got["rows"] == 500 and got["templates"] <= 2 * 4 and got["batches"] < 100
    want = [(i, x, t, b and b.decode()) for i, x, t, b in rows]
    assert con.execute("SELECT id, x, t, b FROM t ORDER BY id").fetchall() == want
    assert con.execute("SELECT DISTINCT typeof(id), typeof(x) FROM t ORDER BY 2").fetchall() == [("integer", "null"), ("integer", "real")]
    odd = spark.createDataFrame([("INSERT INTO `t` (`id`) VALUES (1 + 1);",)], "sql string")
    assert [r["shape"] for r in sqltext.shaped(odd).collect()] == [None]
    with pytest.raises(Exception, match="expression"):
        databases.write_prepared(sqltext.shaped(odd), lambda: sqlite3.connect(path, timeout=60))
