"""Statements, values, definitions and whole conversions on small dumps; one file per case."""

import dataclasses
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteferry.functions.sqltext import NAME, decode_string, encode_string, rewrite
from siteferry.operators import dump_catalog as catalog
from siteferry.operators import dump_convert, dump_statements
from siteferry.sources.dump import read_dump

# A lending library: loans point at members; a member has a card number, a photo and a balance.
MEMBER = """CREATE TABLE IF NOT EXISTS `lib`.`member` (
  `card no` bigint(20) UNSIGNED NOT NULL auto_increment,
  `surname` varchar(80) CHARACTER SET latin1 COLLATE latin1_swedish_ci DEFAULT 'n/a (none), yet' NOT NULL,
  `kind` enum('adult','child (u12)','it''s staff') COMMENT 'who, (roughly)' NOT NULL,
  `balance` numeric(12,3) ZEROFILL,
  `photo` mediumblob,
  `seen` timestamp NULL ON UPDATE CURRENT_TIMESTAMP(6),
  PRIMARY KEY (`card no`) USING BTREE,
  INDEX `by name` (`surname`(40) DESC, `kind`),
  UNIQUE INDEX (`surname`),
  SPATIAL KEY `where` (`photo`)
) ENGINE=MyISAM;"""

SHELF = """# a comment
DROP TABLE IF EXISTS `shelf`;
/* another; one */
CREATE TABLE `shelf` (`slot` smallint NOT NULL auto_increment, `label` char(30), `price` decimal(8,2), `cover` blob,
  PRIMARY KEY (`slot`), KEY `label` (`label`(12)));
REPLACE INTO `shelf` VALUES (7,'O\\'Brien; 2nd','tab\\there',3.10),(-8,NULL,.5e1,0x00FF);"""

TO_SQLITE = {
    "member": MEMBER,
    "shelf": SHELF,
    "pair": "CREATE TABLE `loan` (`who` int, `what` int, `due` date, PRIMARY KEY (`who`, `what`), "
    "CONSTRAINT `lent` FOREIGN KEY (`who`) REFERENCES `member` (`card no`) ON DELETE CASCADE);",
    "rows": "INSERT INTO `fine` (`cents`, `why`) VALUES (5,'late'), (10,'lost'),\n(15,'torn');",
    "marks": "INSERT INTO `fine` VALUES ('back\\\\slash', '\\\"', 0xBEEF, _utf8'x', 'nul\\0');",
    "nested": "INSERT INTO `fine` VALUES (1, f(g(h(i(j((2))))))),(3,4);",
    "cut": "INSERT INTO `fine` VALUES (1,'whole'),(2,'hal",
    "suffix": "INSERT INTO `fine` VALUES (1,2) AS fresh;INSERT INTO `fine` VALUES;",
    "quiet": "SET time_zone = '+00:00';\nLOCK TABLES `fine` WRITE;\nBEGIN;\nCOMMIT;\nDELIMITER $$",
    "lookalike": "INSERT INTO `my ``odd`` table` (`values`) VALUES ('(1), VALUES on duplicate key update');",
    "refused": "CREATE OR REPLACE VIEW late AS SELECT 1;ALTER TABLE `fine` DROP `why`;CREATE PROCEDURE p() SELECT 1;"
    "VACUUM;REPLACE INTO `fine` SELECT * FROM `old`;INSERT INTO `fine` VALUES (1) ON  DUPLICATE KEY UPDATE `cents` = 2;"
    "CREATE TABLE `nothing`;CREATE TABLE (`x` int);CREATE TABLE `map` (`at` polygon, `n` int);",
    "wide": "CREATE TABLE `note` (`body` longtext);INSERT INTO `note` VALUES ('" + "m" * 160 + "'),('s');"
    "INSERT INTO `note` VALUES ('" + "w" * 300 + "');",
    "blank": "\n",
}

TO_MYSQL = {
    "loan": 'CREATE TABLE "loan" ("id" INTEGER PRIMARY KEY AUTOINCREMENT, "due" TEXT NOT NULL DEFAULT \'\');',
    "kinds": 'CREATE TABLE "k" ("i" INTEGER, "t" TEXT DEFAULT NULL, "r" REAL NOT NULL, "b" BLOB, "n" NUMERIC, "v" VARCHAR(9));',
    "keyed": 'CREATE TABLE "tag" ("word" TEXT PRIMARY KEY, "uses" INTEGER);',
    "both": 'CREATE TABLE "tag" ("word" TEXT, "lang" VARCHAR(5), PRIMARY KEY ("word", "lang"), UNIQUE ("lang"));',
    "after": 'CREATE TABLE "tag" ("word" TEXT, "uses" INTEGER);\nCREATE INDEX IF NOT EXISTS main."by word" ON "tag" ("word");\n'
    'CREATE UNIQUE INDEX "by uses" ON "tag" ("uses" DESC);',
    "bytes": "INSERT INTO \"k\" VALUES (CAST(x'6E00' AS TEXT), X'', x'0a', 'a\\b', 'x''0a''');",
    "blank": "\n",
}


def convert_all(spark, tmp_path, cases, from_, to, **options):
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    dump = read_dump(spark, str(tmp_path), from_).withColumn("dump_id", F.regexp_extract("dump_id", r"([^/]+)$", 1))
    done = dump_convert.convert(dump.cache(), from_, to, **options)
    return dataclasses.replace(done, emitted=done.emitted.cache(), refusals=done.refusals.cache())


def by_dump(df, *order):
    found = {}
    for row in df.orderBy("dump_id", *order).collect():
        found.setdefault(row.dump_id, []).append(row)
    return found


@pytest.fixture(scope="module")
def to_sqlite(spark, tmp_path_factory):
    return convert_all(spark, tmp_path_factory.mktemp("my"), TO_SQLITE, "mysql", "sqlite", limit=250)


@pytest.fixture(scope="module")
def to_mysql(spark, tmp_path_factory):
    return convert_all(spark, tmp_path_factory.mktemp("lite"), TO_MYSQL, "sqlite", "mysql")


def test_into_sqlite(to_sqlite):
    out = {k: "\n".join(r.sql for r in v) for k, v in by_dump(to_sqlite.emitted, "stmt_no", "part_no").items()}
    lines = [line.strip().rstrip(",") for line in out["member"].split("\n")]
    assert lines == [
        'CREATE TABLE "member" (',
        '"card no" INTEGER PRIMARY KEY AUTOINCREMENT',
        "\"surname\" TEXT DEFAULT 'n/a (none), yet' NOT NULL",
        '"kind" TEXT NOT NULL',
        '"balance" NUMERIC',
        '"photo" BLOB',
        '"seen" TEXT NULL',
        ");",
        'CREATE INDEX "member__by name" ON "member" ("surname", "kind");',
        'CREATE UNIQUE INDEX "member__surname" ON "member" ("surname");',
    ]
    assert 'PRIMARY KEY ("who", "what")' in out["pair"]
    assert 'CONSTRAINT "lent" FOREIGN KEY ("who") REFERENCES "member" ("card no") ON DELETE CASCADE' in out["pair"]
    assert out["rows"].split("\n") == [
        f"INSERT INTO \"fine\" (\"cents\", \"why\") VALUES ({n},'{w}');" for n, w in ((5, "late"), (10, "lost"), (15, "torn"))
    ]
    assert out["marks"] == (
        "INSERT INTO \"fine\" VALUES ('back\\slash', '\"', x'BEEF', _utf8'x', CAST(x'6e756c00' AS TEXT));"
    )
    assert out["nested"].split("\n")[0] == 'INSERT INTO "fine" VALUES (1, f(g(h(i(j((2)))))));'
    assert out["nested"].count("INSERT") == 2
    assert out["cut"] == "INSERT INTO \"fine\" VALUES (1,'whole');"
    assert out["suffix"] == 'INSERT INTO "fine" VALUES (1,2);'
    assert out["lookalike"].startswith('INSERT INTO "my `odd` table" ("values") VALUES (\'(1), VALUES on')
    assert out["shelf"].split("\n")[0] == 'DROP TABLE IF EXISTS "shelf";'
    assert "REPLACE INTO \"shelf\" VALUES (7,'O''Brien; 2nd','tab\there',3.10);" in out["shelf"]
    assert "quiet" not in out and "blank" not in out


def test_refusals_and_summary(to_sqlite):
    refusals = by_dump(to_sqlite.refusals, "stmt_no")
    assert [r.reason for r in refusals["refused"]] == [
        "VIEW is not converted",
        "ALTER TABLE is not converted",
        "PROCEDURE is not converted",
        "unrecognised statement",
        "INSERT with no VALUES list",
        "INSERT ... ON DUPLICATE KEY UPDATE is not converted",
        "CREATE TABLE with no column list",
        "CREATE TABLE with no name",
        "no sqlite class for the type polygon",
    ]
    assert [(r.reason, r.preview) for r in refusals["cut"]] == [("text that is no row in the VALUES list of fine", "(2,'hal")]
    assert [(r.reason, r.preview) for r in refusals["suffix"]] == [
        ("text that is no row in the VALUES list of fine", "AS fresh"), ("INSERT with an empty VALUES list", ""),
    ]
    assert "nested" not in refusals and "rows" not in refusals
    with pytest.raises(ValueError, match="converted|too wide|no row|empty"):
        dump_convert.assert_none(to_sqlite.refusals)
    summary = {r.dump_id: r for r in to_sqlite.summary.collect()}
    rows = summary["rows"]
    assert (rows.statements, rows.rows, rows.tables, rows.skipped) == (3, 3, 0, 0)
    wide = summary["wide"]
    assert (wide.statements, wide.tables, wide.rows, wide.skipped, wide.widest) == (3, 1, 2, 1, 331)
    quiet = summary["quiet"]
    assert (quiet.statements, quiet.tables, quiet.rows, quiet.skipped, quiet.widest) == (0, 0, 0, 0, 0)
    over = to_sqlite.over_limit.collect()
    assert [(r.dump_id, r.table, r.rows, r.widest) for r in over] == [("wide", "note", 1, 331)]
    lossy = {(r.dump_id, r.subject, r.change) for r in to_sqlite.lossy.collect()}
    assert lossy == {
        ("member", "member__by name", "prefix length dropped"), ("member", "spatial", "index dropped"),
        ("member", "balance", "declared scale lost"), ("shelf", "shelf__label", "prefix length dropped"),
        ("shelf", "price", "declared scale lost"),
    }


def test_into_mysql(to_mysql):
    out = {k: "\n".join(r.sql for r in v) for k, v in by_dump(to_mysql.emitted, "stmt_no", "part_no").items()}
    assert "blank" not in out
    assert all(text.split("\n")[0] == "SET NAMES utf8mb4;" for text in out.values())
    assert "CREATE TABLE `loan` (\n\t`id` BIGINT PRIMARY KEY AUTO_INCREMENT,\n\t`due` LONGTEXT NOT NULL DEFAULT ''" in out["loan"]
    assert out["loan"].endswith("ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;")
    for column in (
        "`i` BIGINT", "`t` LONGTEXT DEFAULT NULL", "`r` DOUBLE NOT NULL", "`b` LONGBLOB", "`n` DECIMAL(30,10)", "`v` VARCHAR(9)",
    ):
        assert column in out["kinds"]
    assert "`word` LONGTEXT NOT NULL" in out["keyed"] and "PRIMARY KEY (`word`(191))" in out["keyed"]
    assert out["keyed"].count("PRIMARY KEY") == 1
    assert "PRIMARY KEY (`word`(191), `lang`)" in out["both"]
    assert "CREATE UNIQUE INDEX `tag__lang` ON `tag` (`lang`);" in out["both"]
    assert "CREATE INDEX `by word` ON `tag` (`word`(191));" in out["after"]
    assert "CREATE UNIQUE INDEX `by uses` ON `tag` (`uses`);" in out["after"]
    assert "VALUES (0x6E00, '', 0x0a, 'a\\\\b', 'x''0a''');" in out["bytes"]
    lossy = {(r.dump_id, r.subject, r.change) for r in to_mysql.lossy.collect()}
    assert ("kinds", "n", "scale invented") in lossy
    assert ("keyed", "word", "key narrowed to 191 characters") in lossy


def test_multi_row_statements_stay_whole(spark, tmp_path):
    cases = {"m": "INSERT INTO `seat` VALUES (1,'a'),(2,'b') extra;"}
    done = convert_all(spark, tmp_path, cases, "mysql", "sqlite", split_rows=False)
    rows = done.emitted.collect()
    assert [(r.sql, r.tuples) for r in rows] == [("INSERT INTO \"seat\" VALUES (1,'a'), (2,'b');", 2)]
    summary = done.summary.first()
    assert (summary.rows, summary.skipped) == (2, 1)


def test_same_dialect_is_refused(spark):
    with pytest.raises(ValueError):
        dump_convert.convert(spark.createDataFrame([], "dump_id string, stmt_no long, sql string"), "mysql", "mariadb")


def test_typed_load(spark, tmp_path):
    (tmp_path / "d.sql").write_text(SHELF + "\nINSERT INTO `shelf` (`label`,`slot`) VALUES ('by name', 9);")
    classified = dump_statements.classify(read_dump(spark, str(tmp_path)))
    mapped = catalog.map_types(catalog.schema_catalog(catalog.table_items(classified, "mysql")), "mysql", "sqlite")
    schema = [(r.column, dump_statements.spark_type(r.declared, r.type)) for r in mapped.orderBy("ordinal").collect()]
    assert schema == [("slot", "bigint"), ("label", "string"), ("price", "decimal(8,2)"), ("cover", "binary")]
    rows = dump_statements.decode_values(dump_statements.insert_rows(classified, "mysql"), "mysql")
    got = dump_statements.dump_table(rows, schema, "shelf").orderBy("slot").collect()
    assert [(r.slot, r.label, str(r.price), r.cover) for r in got] == [
        (-8, None, "5.00", bytearray(b"\x00\xff")),
        (7, "O'Brien; 2nd", "None", bytearray(b"3.10")),
        (9, "by name", "None", None),
    ]


def test_literals(spark):
    pairs = [
        (r"'one\ntwo\tthree\\four\'five\0six\Z'", "one\ntwo\tthree\\four'five\0six\x1a"),
        ("'two '' marks'''", "two ' marks'"),
        (r"'\r\b\q'", "\r\bq"),
    ]
    df = spark.createDataFrame(pairs, "lit string, value string")
    got = df.select(
        decode_string(F.col("lit"), "mysql").alias("d"),
        "value",
        decode_string(encode_string(F.col("value"), "mysql"), "mysql").alias("again"),
        rewrite(F.lit("p`q``r` 10 0xA0 'z'"), "mysql", "sqlite").alias("r"),
    ).collect()
    for row in got:
        assert row.d == row.value == row.again
        assert row.r == "p\"q`r\" 10 x'A0' 'z'"


def test_large_statement(spark, tmp_path):
    value = "\\'\\\\(),;" * 100_000
    (tmp_path / "d.sql").write_text(f"INSERT INTO t VALUES ('{value}',1);INSERT INTO t VALUES " + ",".join(["(1,'a,(b')"] * 100_000))
    classified = dump_statements.classify(read_dump(spark, str(tmp_path)))
    rows = dump_statements.decode_values(dump_statements.insert_rows(classified, "mysql"), "mysql")
    got = rows.groupBy("stmt_no").agg(
        F.count("*").alias("n"), F.max(F.size("values")).alias("k"), F.max(F.length(F.get("values", F.lit(0))["text"])).alias("w")
    )
    assert [tuple(r) for r in got.orderBy("stmt_no").collect()] == [(0, 1, 2, 600_000), (1, 100_000, 2, 1)]
    assert dump_statements.tail_refusals(classified, "mysql").count() == 0


def test_nesting_and_length_without_limit(spark):
    deep = "(" * 1000 + "7, ')'" + ")" * 1000
    long = ",".join(f"({i},'{'v' * 990}')" for i in range(100_000))
    rows = [("d", 0, f"INSERT INTO t VALUES (1,{deep}),(2,3), f(4)"), ("d", 1, f"INSERT INTO t VALUES {long};")]
    frame = spark.createDataFrame(rows, "dump_id string, stmt_no long, sql string")
    classified = dump_statements.classify(frame)
    got = dump_statements.insert_values(classified, "mysql").groupBy("stmt_no").agg(
        F.count("*").alias("n"), F.max(F.size("values")).alias("k"), F.max(F.length(F.get("values", F.lit(1))["text"])).alias("w")
    )
    assert len(long) > 99_000_000
    assert [tuple(r) for r in got.orderBy("stmt_no").collect()] == [(0, 2, 2, len(deep)), (1, 100_000, 2, 990)]
    assert [r.preview for r in dump_statements.tail_refusals(classified, "mysql").collect()] == ["f(4)"]


def test_scanner_equals_a_slow_one():
    """Tuples and values of random lists against a reader of one character at a time."""
    rng = random.Random(21)

    def slow(text, dialect):
        tuples, depth, quote, start, items, item, i = [], 0, None, 0, [], "", 0
        while i < len(text):
            c = text[i]
            item += c
            if quote:
                if dialect == "mysql" and quote != "`" and c == "\\" and i + 1 < len(text):
                    item, i = item + text[i + 1], i + 1
                elif c == quote:
                    quote = None
            elif c in "'\"`":
                quote = c
            elif c == "(":
                depth += 1
                if depth == 1:
                    start, items, item = i, [], ""
            elif c == ")":
                depth -= 1
                if depth < 0:
                    break
                if depth == 0:
                    items.append(item[:-1])
                    tuples.append((text[start : i + 1], [x.strip() for x in items if x.strip()]))
                    item = ""
            elif depth == 0 and c not in ", ":
                break
            elif depth == 1 and c == ",":
                items.append(item[:-1])
                item = ""
            i += 1
        return tuples

    pieces = ["(", ")", ",", " ", "1", "-2.5", "'a'", "'b,('", "'it''s'", "NULL", "x'0F'", "f(1,2)", "`q`", "'\\\\'", "(1,'z')", "0xAb"]
    for dialect in ("mysql", "sqlite"):
        scanner = dump_statements.Scanner(dialect)
        for _ in range(3000):
            text = "(" + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
            wanted = slow(text, dialect)
            got = [text[a:b] for a, b in scanner.tuples(text, 0)]
            # two tuples may stand without a comma between; a comma may not be doubled
            assert got == [t for t, _ in wanted][: len(got)], text
            for tuple_, items in wanted[: len(got)]:
                into = dump_statements.Literals()
                scanner.values(tuple_, into)
                alone = dump_statements.Literals()
                for item in items:
                    alone.add(*scanner.literal(item))
                assert (into.kinds, into.texts, into.raws) == (alone.kinds, alone.texts, alone.raws), tuple_


def test_a_conversion_reads_its_dump_once(to_sqlite, spark, tmp_path):
    (tmp_path / "d.sql").write_text(SHELF)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    dump = read_dump(spark, str(tmp_path)).mapInArrow(seen, "dump_id string, stmt_no long, sql string, fault string")
    done = dump_convert.convert(dump, "mysql", "sqlite")
    for frame in (done.emitted, done.over_limit, done.refusals, done.lossy, done.summary):
        frame.collect()
    assert reads.value == 3


def test_failed_casts_are_listed(spark):
    rows = [("d", 0, "INSERT INTO t (b, a, z) VALUES ('12x', 99999999999999999999, 1), (0x41, 1e2, 2)")]
    classified = dump_statements.classify(spark.createDataFrame(rows, "dump_id string, stmt_no long, sql string"))
    load = dump_statements.load_table(
        dump_statements.insert_values(classified, "mysql"), [("a", "bigint"), ("b", "decimal(4,1)"), ("c", "binary")], "t"
    )
    assert [(r.a, r.b, r.c) for r in load.rows.orderBy("row_no").collect()] == [(None, None, None), (100, None, None)]
    failed = {(r.row_no, r.column, r.raw, r.reason) for r in load.failed.collect()}
    assert failed == {
        (0, "a", "99999999999999999999", "out of the range of bigint"), (0, "b", "12x", "not a decimal"),
        (1, "b", "41", "not a decimal"), (0, "z", "1", "no column for it"), (1, "z", "2", "no column for it"),
    }
    assert dump_statements.failed_counts(load.failed).count() == 4


def test_write_and_count(spark, tmp_path, to_sqlite):
    kept, spared = dump_convert.structure_only(to_sqlite.emitted, (r"^(shelf|member)$",))
    assert {r.table for r in spared.collect()} == {"shelf", "member"}
    dump_convert.write_dump(to_sqlite.emitted, str(tmp_path / "out"))
    lines = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out" / "2-rows"))
    counts = {r.table: r.n for r in dump_convert.emitted_counts(lines, "value", by=()).collect()}
    assert counts == {"fine": 8, "note": 2, "shelf": 2, "my `odd` table": 1}
    per_dump = {(r.dump_id, r.table): r.n for r in dump_convert.emitted_counts(to_sqlite.emitted).collect()}
    assert per_dump["rows", "fine"] == 3 and per_dump["cut", "fine"] == 1
    dumps = spark.createDataFrame([("quiet",), ("rows",)], "dump_id string")
    envelope = {r.dump_id: r for r in dump_convert.export_envelope(to_sqlite.emitted, 60, dumps=dumps).collect()}
    assert (envelope["rows"].statements, envelope["rows"].chars, envelope["rows"].replayable) == (3, 166, True)
    assert (envelope["quiet"].statements, envelope["quiet"].replayable) == (0, True)
    assert not {r.dump_id: r for r in dump_convert.export_envelope(to_sqlite.emitted, 60).collect()}["member"].replayable


def test_dumps_of_one_base_name_stay_apart(spark, tmp_path):
    rows = [(f"{site}/dump.sql", i, 0, "row", "t", f"INSERT INTO `t` VALUES ({site!r});", 1) for i, site in enumerate(("s1", "s2"))]
    emitted = spark.createDataFrame(rows, "dump_id string, stmt_no long, part_no int, kind string, table string, sql string, tuples long")
    dump_convert.write_dump(emitted, str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out" / "2-rows").iterdir() if p.is_dir())
    assert len(folders) == 2 and all(f.startswith("dump=dump.sql-") for f in folders)


def test_definitions_are_taken_apart_once(spark):
    """The frames of a conversion read items, columns and keys as staged, and none cuts the statements into tokens again."""
    sql = "CREATE TABLE `a` (`id` int, `name` text, PRIMARY KEY (`id`), UNIQUE KEY (`name`))"
    dump = spark.createDataFrame([("d", 0, sql)], "dump_id string, stmt_no long, sql string")
    for from_, to, count in (("mysql", "sqlite", 2), ("sqlite", "mysql", 3)):
        done = dump_convert.convert(dump if from_ == "mysql" else dump.withColumn("sql", F.translate("sql", "`", '"')), from_, to)
        for frame in (done.emitted, done.lossy):
            assert NAME not in frame._jdf.queryExecution().optimizedPlan().toString()
        assert done.emitted.count() == count


def test_plain_rows_are_cut_together_and_alike():
    """Statements of plain rows do not go through the scanner value by value; mixed with others the rows are the scanner's."""
    plain = ["INSERT INTO `t` VALUES (1, 'a,b', NULL, -2.5e3)", "INSERT INTO `t` VALUES ('(x', ''),\n(  7 ,'é'), ( null, +.5)"]
    odd = [
        "INSERT INTO `t` VALUES (0x0F, 'it''s', 'a\\'b', f(1, 2))", "INSERT INTO `t` VALUES (1), (2", "INSERT INTO `t` VALUES",
        "INSERT INTO `t` VALUES (1) ON DUPLICATE KEY UPDATE a = 1", "INSERT INTO u (`a`) VALUES (1,,2)", "INSERT INTO `t` VALUES (12x)", None,
    ]

    def scanned(sql, scanner, values=True):
        n = len(sql)
        arrays = [["d"] * n, list(range(n)), ["insert"] * n, sql, [None] * n, [5] * n]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["dump_id", "stmt_no", "kind", "sql", "fault", "first_row"]
        batch = pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=names)
        return [r for b in dump_statements._scan(iter([batch]), scanner, True, values, True) for r in b.to_pylist()]

    for dialect in ("mysql", "sqlite"):
        unused = dump_statements.Scanner(dialect)
        unused.values = unused.tuples = None
        assert len(scanned(plain, unused)) == 4
        scanner = dump_statements.Scanner(dialect)
        for values in (True, False):
            for some in (plain, plain + odd, odd + plain, [s for pair in zip(odd, plain * 4) for s in pair]):
                # a statement that begins with a blank is the same to the scanner and is not plain beside these
                alone = [{**r, "stmt_no": i} for i, s in enumerate(some) for r in scanned([odd[4], s], scanner, values) if r["stmt_no"]]
                assert scanned(some, scanner, values) == alone


def test_steps_of_a_typed_load_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes of code uncompiled; a table of many columns stays below."""
    decoded = spark.range(1).selectExpr(
        "'d' dump_id", "id stmt_no", "'t' table", "cast(null as array<string>) columns", "0 row_no",
        "transform(sequence(1, 40), i -> struct('number' AS kind, cast(i AS string) AS text, cast(null AS binary) AS bytes)) values",
    )
    kinds = ["bigint", "double", "string", "decimal(10,2)", "binary"]
    rows = dump_statements.dump_table(decoded, [(f"c{i}", kinds[i % 5]) for i in range(40)], "t")
    plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000
    assert [rows.first()[f"c{i}"] for i in (0, 1, 2, 39)] == [1, 2.0, "3", b"40"]
