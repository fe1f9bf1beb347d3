"""Queries over dumps: given tables written as SQL text and read back, and statements made from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.functions.scale import fill_cores
from siteferry.operators import dump_catalog, dump_convert, dump_statements
from siteferry.plans.inputs import derive, folders, plain, table
from siteferry.session import staging_path
from siteferry.sources.dump import LIST_BYTES, read_dump


def _written(df, name, dialect):
    """The frame written as a dump in the shared folder; the folder's path."""
    path = staging_path(df.sparkSession, f"dump-{name}")
    dump_convert.write_dump(dump_convert.render_table(fill_cores(df), name, dialect), path)
    return path


def _read_back(spark, path, dialect):
    """The dump's row statements, classified; the schema of its one table as read from its definition."""
    defined = dump_statements.classify(read_dump(spark, f"{path}/1-definitions", dialect))
    classified = dump_statements.classify(read_dump(spark, f"{path}/2-rows", dialect))
    items = dump_catalog.table_items(defined, dialect)
    mapped = dump_catalog.map_types(
        dump_catalog.schema_catalog(items), dialect, "mysql" if dialect == "sqlite" else "sqlite"
    )
    classes = {"BIGINT": "INTEGER", "DOUBLE": "REAL", "LONGTEXT": "TEXT", "LONGBLOB": "BLOB"}
    schema = [
        (r.column, dump_statements.spark_type(r.declared, classes.get(r.type, r.type)))
        for r in mapped.orderBy("ordinal").collect()
    ]
    return classified, schema


def _roundtrip(spark, df, name, dialect):
    classified, schema = _read_back(spark, _written(df, name, dialect), dialect)
    rows = dump_statements.insert_values(classified, dialect)
    return dump_statements.dump_table(rows, schema, name).drop("dump_id", "stmt_no", "row_no")


def _roundtrip_nation(spark, sf_dir):
    return _roundtrip(spark, table(spark, sf_dir, "nation"), "nation", "mysql")


def _roundtrip_customer(spark, sf_dir):
    return _roundtrip(spark, table(spark, sf_dir, "customer"), "customer", "sqlite")


def _roundtrip_orders(spark, sf_dir):
    return _roundtrip(spark, table(spark, sf_dir, "orders"), "orders", "mysql")


def _roundtrip_lineitem(spark, sf_dir):
    return _roundtrip(spark, table(spark, sf_dir, "lineitem"), "lineitem", "mysql")


def _documents(spark, sf_dir, dialect):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").cast("binary").alias("raw"))
    back = _roundtrip(spark, documents, "documents", dialect)
    return back.select(
        "doc_id", F.md5("text").alias("digest"), F.decode("raw", "UTF-8").alias("source")
    )


def _roundtrip_documents_sqlite(spark, sf_dir):
    return _documents(spark, sf_dir, "sqlite")


def _roundtrip_documents_mysql(spark, sf_dir):
    return _documents(spark, sf_dir, "mysql")


def _dump_name():
    return F.regexp_extract("dump_id", "/dump=([^/]*)$", 1).alias("dump")


# One dump per source of the documents. All its rows are one statement over many files; its table is defined in the
# first file, its index in the last.
FILE_LINES = """
SELECT source AS dump, doc_id + 10 AS ord, concat(',(', doc_id, ',', chr(39), replace(text, chr(39), concat(chr(39), chr(39))),
  chr(39), ',', chr(39), lang, chr(39), ')') AS line FROM {documents}
UNION ALL SELECT DISTINCT source, 0, 'CREATE TABLE "doc" ("id" INTEGER, "body" TEXT, "lang" TEXT);' FROM {documents}
UNION ALL SELECT DISTINCT source, 1, concat('INSERT INTO "doc" ("id", "body", "lang") VALUES (-1, ', chr(39), chr(39), ', NULL)')
  FROM {documents}
UNION ALL SELECT DISTINCT source, 1000000000000, '; /* the end' FROM {documents}
UNION ALL SELECT DISTINCT source, 1000000000001, 'of rows; */ CREATE INDEX "by_lang" ON "doc" ("lang");' FROM {documents}"""


def _file_dump(spark, sf_dir):
    path = folders(derive(spark, sf_dir, FILE_LINES), "documents")
    return read_dump(spark, path, "sqlite", per="folder", list_bytes=LIST_BYTES)


def _dump_files(spark, sf_dir):
    rows = dump_statements.insert_values(dump_statements.classify(_file_dump(spark, sf_dir)), "sqlite")
    typed = dump_statements.dump_table(rows, [("id", "bigint"), ("body", "string"), ("lang", "string")], "doc")
    return typed.select(_dump_name(), "id", F.md5("body").alias("digest"), "lang")


def _dump_files_index(spark, sf_dir):
    done = dump_convert.convert(_file_dump(spark, sf_dir), "sqlite", "mysql")
    indexes = done.emitted.filter(F.col("kind") == "index").select(_dump_name(), F.lit("index").alias("what"), "sql")
    lossy = done.lossy.select(_dump_name(), F.lit("lossy").alias("what"), F.concat_ws(": ", "subject", "change").alias("sql"))
    return indexes.unionByName(lossy)


def _dump_bytes(spark, sf_dir):
    """Raw bytes in quotes, as a dump of binary columns has them, read back and written for the other dialect."""
    documents = table(spark, sf_dir, "documents")
    raw = F.unhex(F.concat(F.md5("text"), F.sha2("text", 256))).cast("string")
    for plain_, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0")):
        raw = F.replace(raw, F.lit(plain_), F.lit(escaped))
    line = F.concat(F.lit("INSERT INTO `raw` VALUES ("), "doc_id", F.lit(", _binary '"), raw, F.lit("');"))
    path = folders(documents.select(F.lit("one").alias("dump"), F.col("doc_id").alias("ord"), line.alias("line")), "bytes")
    emitted = dump_convert.convert(read_dump(spark, path, "mysql", per="folder"), "mysql", "sqlite").emitted
    back = dump_statements.classify(emitted.withColumn("stmt_no", F.col("stmt_no") * 2))
    rows = dump_statements.insert_values(back, "sqlite")
    typed = dump_statements.dump_table(rows, [("doc_id", "bigint"), ("raw", "binary")], "raw")
    return typed.select("doc_id", F.lower(F.hex("raw")).alias("digits"))


# Ten dumps; in one a quote is left open before its rows, which hold no other quote.
OPEN_LINES = """
SELECT concat('d', doc_id % 10) AS dump, doc_id + 10 AS ord,
  concat('INSERT INTO `t` VALUES (', doc_id, ', 0x', md5(text), md5(source), md5(lang), ');') AS line FROM {documents}
UNION ALL SELECT DISTINCT concat('d', doc_id % 10), 1, CASE doc_id % 10 WHEN 3 THEN concat('SELECT ', chr(39))
  ELSE 'SET NAMES utf8mb4;' END FROM {documents}"""

OPEN_BYTES = 1500


def _dump_open_quote(spark, sf_dir):
    path = folders(derive(spark, sf_dir, OPEN_LINES), "open")
    done = dump_convert.convert(
        read_dump(spark, path, "mysql", per="folder", max_statement_bytes=OPEN_BYTES), "mysql", "sqlite"
    )
    refused = done.refusals.groupBy("dump_id").agg(F.min("reason").alias("reason"))
    summary = done.summary.join(refused, "dump_id", "left")
    return summary.select(_dump_name(), "rows", "skipped", "reason")


# Rows of which most hold a value that is not of its column's type.
LOADED = """
SELECT c_mktsegment AS dump_id, c_custkey AS stmt_no, concat('INSERT INTO `t` VALUES (', CASE c_custkey % 8
  WHEN 0 THEN concat(c_custkey, ',1.50,0.5,~ok~,12')
  WHEN 1 THEN '9223372036854775808,1.50,0.5,~a~,1234567890123456789012345678901234567890'
  WHEN 2 THEN concat(c_custkey, ',~12.345~,1e400,~b~,0.1')
  WHEN 3 THEN '~abc~,123456789012.10,~x~,~c~,NULL'
  WHEN 4 THEN concat(c_custkey, ',NULL,NULL,0xFF,NULL')
  WHEN 5 THEN concat(c_custkey, ',5e-1,2,now(),-0.00')
  WHEN 6 THEN concat(c_custkey, '.0,12.3400,2,~d~,NULL,~extra~')
  ELSE concat(c_custkey, '.5,-7,2,~e~,1),(', c_custkey) END, ')') AS sql
FROM {customer}"""
LOADED_COLUMNS = [("id", "bigint"), ("price", "decimal(10,2)"), ("ratio", "double"), ("note", "string"), ("wide", "string")]


def _load(spark, sf_dir):
    made = derive(spark, sf_dir, LOADED).withColumn("sql", F.translate("sql", "~", "'"))
    rows = dump_statements.insert_values(dump_statements.classify(made), "mysql")
    return dump_statements.load_table(rows, LOADED_COLUMNS, "t")


def _load_rows(spark, sf_dir):
    rows = _load(spark, sf_dir).rows
    return rows.withColumn("row_no", F.col("row_no").cast("bigint")).withColumn("price", F.col("price").cast("string"))


def _load_failures(spark, sf_dir):
    failed = _load(spark, sf_dir).failed
    return failed.withColumn("row_no", F.col("row_no").cast("bigint"))


def _load_failure_counts(spark, sf_dir):
    return dump_statements.failed_counts(_load(spark, sf_dir).failed)


# One dump per customer segment; every customer adds one statement of one of nine forms.
STATEMENTS = """
SELECT c_mktsegment AS dump_id, c_custkey AS stmt_no, CASE c_custkey % 9
  WHEN 0 THEN 'SET NAMES utf8mb4'
  WHEN 1 THEN concat('CREATE TABLE `t', c_custkey, '` (`id` int(11) unsigned NOT NULL AUTO_INCREMENT, ',
    '`name` varchar(255) COLLATE utf8mb4_bin NOT NULL, `price` decimal(10,2) DEFAULT NULL, ',
    CASE WHEN c_custkey % 2 = 0 THEN '`shape` geometry, ' ELSE '' END,
    'PRIMARY KEY (`id`), UNIQUE KEY `nm` (`name`(191)), FULLTEXT KEY `ft` (`name`)) ENGINE=InnoDB')
  WHEN 2 THEN concat('INSERT INTO `t', c_nationkey, '` VALUES (', c_custkey, ',~x;y~),(NULL,~(a,b)~)',
    CASE c_custkey % 5 WHEN 1 THEN ', (f(g(h(i(j(1))))),2)' WHEN 2 THEN ',(2,~b' WHEN 3 THEN ' AS new' ELSE '' END)
  WHEN 3 THEN concat('replace into `t', c_nationkey, '` (`id`) values (0x0F)')
  WHEN 4 THEN concat('DROP TABLE IF EXISTS `t', c_custkey, '`')
  WHEN 5 THEN concat('CREATE UNIQUE INDEX `i', c_custkey, '` ON `t1` (`name`(20), `id` DESC)')
  WHEN 6 THEN concat('CREATE OR REPLACE VIEW v', c_custkey, ' AS   SELECT 1')
  WHEN 7 THEN 'ALTER TABLE `t1` ADD `b` int'
  ELSE CASE WHEN c_custkey % 2 = 0 THEN concat('GRANT ALL ON t', c_custkey, ' TO you')
    ELSE 'INSERT INTO `t` (`a`) SELECT 1' END END AS sql
FROM {customer}"""


def _statements(spark, sf_dir):
    made = derive(spark, sf_dir, STATEMENTS, heavy=True)
    return made.withColumn("sql", F.translate("sql", "~", "'"))


def _classified(spark, sf_dir):
    return dump_statements.classify(_statements(spark, sf_dir))


def _classify(spark, sf_dir):
    kinds = _classified(spark, sf_dir)
    return kinds.groupBy("dump_id", "kind").agg(F.count(F.lit(1)).alias("statements"))


def _insert_rows(spark, sf_dir):
    rows = dump_statements.insert_rows(_classified(spark, sf_dir), "mysql")
    return rows.select(
        "dump_id", "stmt_no", "table", F.array_join("columns", ",").alias("columns"),
        F.col("row_no").cast("bigint").alias("row_no"), "tuple",
    )


def _decode_values(spark, sf_dir):
    rows = dump_statements.insert_rows(_classified(spark, sf_dir), "mysql")
    values = dump_statements.decode_values(rows, "mysql").select(
        "dump_id", "stmt_no", "row_no", F.posexplode("values").alias("position", "v")
    )
    return values.select(
        "stmt_no",
        F.col("row_no").cast("bigint").alias("row_no"),
        F.col("position").cast("bigint").alias("position"),
        F.col("v.kind").alias("kind"),
        F.col("v.text").alias("text"),
        F.hex("v.bytes").alias("bytes"),
    )


def _mapped(spark, sf_dir):
    items = dump_catalog.table_items(_classified(spark, sf_dir), "mysql")
    return dump_catalog.map_types(dump_catalog.schema_catalog(items), "mysql", "sqlite")


def _keys(spark, sf_dir):
    classified = _classified(spark, sf_dir)
    return dump_catalog.key_catalog(dump_catalog.table_items(classified, "mysql"), classified, "mysql")


def _schema_catalog(spark, sf_dir):
    return _mapped(spark, sf_dir).select(
        "stmt_no", "table", F.col("ordinal").cast("bigint").alias("ordinal"), "column", "declared", "type",
        "refused", "not_null", "auto_increment", "default",
    )


def _map_types_mysql(spark, sf_dir):
    """The other direction, over declared types made from part types."""
    declared = derive(spark, sf_dir, DECLARED)
    mapped = dump_catalog.map_types(declared, "sqlite", "mysql")
    return mapped.groupBy("type", "invented").agg(F.count(F.lit(1)).alias("columns"))


DECLARED = """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'text' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'varchar(20)'
  WHEN 4 THEN 'BLOB' ELSE 'real' END AS declared FROM {part}"""


def _key_catalog(spark, sf_dir):
    return _keys(spark, sf_dir).select(
        "stmt_no", "table", "kind", "index", "unique", F.array_join("columns", ",").alias("columns"), "had_prefix"
    )


def _conversion(spark, sf_dir, **options):
    return dump_convert.convert(_statements(spark, sf_dir), "mysql", "sqlite", **options)


def _render_ddl(spark, sf_dir):
    ddl = _conversion(spark, sf_dir).emitted.filter(F.col("kind") != "row")
    return ddl.select("dump_id", "stmt_no", "kind", "sql")


def _render_values(spark, sf_dir):
    rows = _conversion(spark, sf_dir, stage_definitions=False).emitted.filter(F.col("kind") == "row")
    return rows.select("dump_id", "stmt_no", F.col("part_no").cast("bigint").alias("part_no"), "sql")


# Statements of SQLite dumps, one per part, for the way back.
LITE = r"""
SELECT concat('d', p_size % 5) AS dump_id, p_partkey AS stmt_no, CASE p_partkey % 5
  WHEN 0 THEN concat('CREATE TABLE "t', p_partkey, '" ("id" INTEGER PRIMARY KEY AUTOINCREMENT, "name" TEXT NOT NULL, "n" NUMERIC, "raw" BLOB, ',
    'UNIQUE ("name"))')
  WHEN 1 THEN concat('CREATE INDEX "i', p_partkey, '" ON "elsewhere" ("a" DESC, "b")')
  WHEN 2 THEN concat('INSERT INTO "t" ("a", "b") VALUES (', p_partkey, ', ~it~~s C:|ok~), (NULL, x~0fA0~)')
  WHEN 3 THEN concat('INSERT INTO "o""dd" VALUES (CAST(x~6100~ AS TEXT), X~~, -1.5, ~', p_partkey, '~)')
  ELSE concat('DROP TABLE IF EXISTS "t', p_partkey, '"') END AS sql
FROM {part}"""


def _lite(spark, sf_dir, **options):
    made = derive(spark, sf_dir, LITE, heavy=True).withColumn("sql", F.translate("sql", "~|", "'\\"))
    return dump_convert.convert(made, "sqlite", "mysql", **options)


def _render_ddl_mysql(spark, sf_dir):
    ddl = _lite(spark, sf_dir).emitted.filter("kind <> 'row'")
    return ddl.select("dump_id", "stmt_no", "kind", "sql")


def _render_values_mysql(spark, sf_dir):
    rows = _lite(spark, sf_dir, stage_definitions=False).emitted.filter("kind = 'row'")
    return rows.select("dump_id", "stmt_no", F.col("part_no").cast("bigint").alias("part_no"), "tuples", "sql")


def _refusals(spark, sf_dir):
    return _conversion(spark, sf_dir).refusals.select("dump_id", "stmt_no", "reason", "preview")


def _lossy_report(spark, sf_dir):
    return _conversion(spark, sf_dir).lossy.groupBy("dump_id", "change").agg(F.count(F.lit(1)).alias("times"))


def _convert_summary(spark, sf_dir):
    return _conversion(spark, sf_dir).summary


# An export of the documents, one table per source; two sources are regenerable tables.
EXPORT = """
SELECT CASE WHEN doc_id % 7 = 0 THEN 'b/site.sql' ELSE 'a/site.sql' END AS dump_id, doc_id AS stmt_no, 0 AS part_no, 'row' AS kind,
  CASE WHEN doc_id % 10 < 3 THEN concat('cache_', source) WHEN doc_id % 10 = 3 THEN 'sessions' ELSE source END AS table,
  concat('INSERT INTO "', CASE WHEN doc_id % 10 < 3 THEN concat('cache_', source) WHEN doc_id % 10 = 3 THEN 'sessions'
    ELSE source END, '" VALUES (', doc_id, ', ', chr(39), replace(text, chr(39), concat(chr(39), chr(39))), chr(39), ');') AS sql,
  CAST(1 AS BIGINT) AS tuples
FROM {documents}"""
EXPORT_SQL = EXPORT.replace(" AS table,", ' AS "table",')

WIDE = 20_000


def _width_audit(spark, sf_dir):
    return dump_convert.width_audit(derive(spark, sf_dir, EXPORT), WIDE)


def _drop_wide(spark, sf_dir):
    kept = dump_convert.drop_wide(derive(spark, sf_dir, EXPORT), WIDE, unit="utf16")
    return kept.groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


def _emitted_counts(spark, sf_dir):
    return dump_convert.emitted_counts(derive(spark, sf_dir, EXPORT))  # of two dumps


def _structure_only(spark, sf_dir):
    kept, spared = dump_convert.structure_only(derive(spark, sf_dir, EXPORT))
    counts = kept.groupBy("dump_id", "table").agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(spared.select("dump_id", "table", F.lit(0).cast("bigint").alias("rows")))


def _violating(spark, sf_dir):
    from siteferry.operators.reconcile import violating_structure_only

    export = derive(spark, sf_dir, EXPORT)
    _, spared = dump_convert.structure_only(export)
    return violating_structure_only(spared, dump_convert.emitted_counts(export), ["dump_id", "table"])


def _export_envelope(spark, sf_dir):
    return dump_convert.export_envelope(derive(spark, sf_dir, EXPORT))


QUERIES = {
    "dump_roundtrip_nation": _roundtrip_nation,
    "dump_roundtrip_customer": _roundtrip_customer,
    "dump_roundtrip_orders": _roundtrip_orders,
    "dump_roundtrip_lineitem": _roundtrip_lineitem,
    "dump_roundtrip_documents_sqlite": _roundtrip_documents_sqlite,
    "dump_roundtrip_documents_mysql": _roundtrip_documents_mysql,
    "dump_files": _dump_files,
    "dump_files_index": _dump_files_index,
    "dump_bytes": _dump_bytes,
    "dump_open_quote": _dump_open_quote,
    "load_rows": _load_rows,
    "load_failures": _load_failures,
    "load_failure_counts": _load_failure_counts,
    "dump_classify": _classify,
    "insert_rows": _insert_rows,
    "decode_values": _decode_values,
    "schema_catalog": _schema_catalog,
    "map_types_mysql": _map_types_mysql,
    "key_catalog": _key_catalog,
    "render_ddl": _render_ddl,
    "render_values": _render_values,
    "render_ddl_mysql": _render_ddl_mysql,
    "render_values_mysql": _render_values_mysql,
    "refusals": _refusals,
    "lossy_report": _lossy_report,
    "convert_summary": _convert_summary,
    "width_audit": _width_audit,
    "drop_wide": _drop_wide,
    "emitted_counts": _emitted_counts,
    "structure_only": _structure_only,
    "violating_structure_only": _violating,
    "export_envelope": _export_envelope,
}

_S = f"(SELECT dump_id, stmt_no, replace(sql, '~', chr(39)) AS sql, stmt_no % 9 AS f FROM {plain(STATEMENTS)})"
_KIND = """CASE f WHEN 0 THEN 'noise' WHEN 1 THEN 'create_table' WHEN 2 THEN 'insert' WHEN 3 THEN 'insert' WHEN 4 THEN 'drop'
  WHEN 5 THEN 'create_index' WHEN 6 THEN 'object' WHEN 7 THEN 'alter' ELSE CASE WHEN stmt_no % 2 = 0 THEN 'unrecognised'
  ELSE 'insert' END END"""
_ROWS = f"""
SELECT s.dump_id, s.stmt_no, 't' || c_nationkey AS "table", CASE f WHEN 3 THEN 'id' END AS columns, r.n AS row_no, f,
  CASE WHEN f = 3 THEN '(0x0F)' WHEN r.n = 0 THEN '(' || s.stmt_no || ',''x;y'')' WHEN r.n = 1 THEN '(NULL,''(a,b)'')'
    ELSE '(f(g(h(i(j(1))))),2)' END AS tuple
FROM {_S} s JOIN customer ON c_custkey = s.stmt_no, (VALUES (0), (1), (2)) r(n)
WHERE (f = 2 AND (r.n < 2 OR s.stmt_no % 5 = 1)) OR (f = 3 AND r.n = 0)"""
_COLUMNS = f"""
SELECT s.dump_id, s.stmt_no, 't' || stmt_no AS "table", c.* FROM {_S} s, (VALUES
  (0, 'id', 'int(11)', 'INTEGER', true, true, CAST(NULL AS VARCHAR)), (1, 'name', 'varchar(255)', 'TEXT', true, false, NULL),
  (2, 'price', 'decimal(10,2)', 'NUMERIC', false, false, 'NULL'), (3, 'shape', 'geometry', NULL, false, false, NULL))
  c(ordinal, "column", declared, type, not_null, auto_increment, "default")
WHERE f = 1 AND (c.ordinal < 3 OR stmt_no % 2 = 0)"""
_EMITTED_ROWS = f"""
SELECT dump_id, stmt_no, row_no AS part_no, CASE WHEN f = 3 THEN 'replace into "' || "table" || '" ("id") VALUES (x''0F'');'
  ELSE 'INSERT INTO "' || "table" || '" VALUES ' || tuple || ';' END AS sql FROM ({_ROWS})"""
_REFUSALS = f"""
SELECT dump_id, stmt_no, 'text that is no row in the VALUES list of t' || c_nationkey AS reason,
  CASE stmt_no % 5 WHEN 2 THEN '(2,''b' ELSE 'AS new' END AS preview
FROM {_S} JOIN customer ON c_custkey = stmt_no WHERE f = 2 AND stmt_no % 5 IN (2, 3)
UNION ALL SELECT dump_id, stmt_no, CASE WHEN f = 6 THEN 'VIEW is not converted' WHEN f = 7 THEN 'ALTER TABLE is not converted'
  WHEN f = 1 THEN 'no sqlite class for the type geometry' WHEN stmt_no % 2 = 0 THEN 'unrecognised statement'
  ELSE 'INSERT with no VALUES list' END AS reason,
  CASE WHEN f = 6 THEN replace(sql, '   ', ' ') WHEN f = 1 THEN '`shape` geometry' ELSE sql END AS preview
FROM {_S} WHERE f > 5 OR (f = 1 AND stmt_no % 2 = 0)"""
_DDL = f"""
SELECT dump_id, stmt_no, 'table' AS kind, 'CREATE TABLE "t' || stmt_no || '" (' || chr(10) || chr(9) ||
  '"id" INTEGER PRIMARY KEY AUTOINCREMENT,' || chr(10) || chr(9) || '"name" TEXT NOT NULL,' || chr(10) || chr(9) ||
  '"price" NUMERIC DEFAULT NULL' || chr(10) || ');' AS sql FROM {_S} WHERE f = 1
UNION ALL SELECT dump_id, stmt_no, 'index', 'CREATE UNIQUE INDEX "t' || stmt_no || '__nm" ON "t' || stmt_no || '" ("name");'
FROM {_S} WHERE f = 1
UNION ALL SELECT dump_id, stmt_no, 'drop', 'DROP TABLE IF EXISTS "t' || stmt_no || '";' FROM {_S} WHERE f = 4
UNION ALL SELECT dump_id, stmt_no, 'index', 'CREATE UNIQUE INDEX "i' || stmt_no || '" ON "t1" ("name", "id");'
FROM {_S} WHERE f = 5"""

_FAILED = f"""
SELECT c_mktsegment AS dump_id, c_custkey AS stmt_no, CAST(0 AS BIGINT) AS row_no, 't' AS "table", f."column",
  CASE WHEN f.raw = '?' THEN c_custkey || '.5' ELSE f.raw END AS raw, f.reason
FROM customer JOIN (VALUES
  (1, 'id', '9223372036854775808', 'out of the range of bigint'), (2, 'price', '12.345', 'more decimal places than decimal(10,2) has'),
  (2, 'ratio', '1e400', 'out of the range of double'), (3, 'id', 'abc', 'not a bigint'),
  (3, 'price', '123456789012.10', 'out of the range of decimal(10,2)'), (3, 'ratio', 'x', 'not a double'),
  (4, 'note', 'FF', 'bytes that are no text'), (5, 'note', 'now()', 'an expression'), (6, NULL, 'extra', 'no column for it'),
  (7, 'id', '?', 'more decimal places than bigint has')) f(k, "column", raw, reason) ON c_custkey % 8 = f.k"""

ORACLES = {
    "dump_files": """
SELECT source AS dump, doc_id AS id, md5(text) AS digest, lang FROM documents
UNION ALL SELECT DISTINCT source, -1, md5(''), NULL FROM documents""",
    "dump_files_index": """
SELECT dump, x.* FROM (SELECT DISTINCT source AS dump FROM documents), (VALUES
  ('index', 'CREATE INDEX `by_lang` ON `doc` (`lang`(191));'), ('lossy', 'lang: key narrowed to 191 characters')) x(what, sql)""",
    "dump_bytes": "SELECT doc_id, md5(text) || sha256(text) AS digits FROM documents",
    "dump_open_quote": f"""
SELECT 'd' || doc_id % 10 AS dump, CASE doc_id % 10 WHEN 3 THEN 0 ELSE count(*) END AS rows,
  CAST(doc_id % 10 = 3 AS BIGINT) AS skipped, CASE doc_id % 10 WHEN 3 THEN
  'a statement of more than {OPEN_BYTES} bytes; a quote or a comment may be left open' END AS reason
FROM documents GROUP BY doc_id % 10""",
    "load_rows": """
SELECT c_mktsegment AS dump_id, c_custkey AS stmt_no, CAST(0 AS BIGINT) AS row_no,
  CASE WHEN k NOT IN (1, 3, 7) THEN c_custkey END AS id,
  CASE k WHEN 0 THEN '1.50' WHEN 1 THEN '1.50' WHEN 5 THEN '0.50' WHEN 6 THEN '12.34' WHEN 7 THEN '-7.00' END AS price,
  CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 5 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 2 END AS DOUBLE) AS ratio,
  CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 6 THEN 'd' WHEN 7 THEN 'e' END AS note,
  CASE k WHEN 0 THEN '12' WHEN 1 THEN '1234567890123456789012345678901234567890' WHEN 2 THEN '0.1' WHEN 5 THEN '-0.00'
    WHEN 7 THEN '1' END AS wide
FROM (SELECT *, c_custkey % 8 AS k FROM customer)
UNION ALL SELECT c_mktsegment, c_custkey, 1, c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 8 = 7""",
    "load_failures": _FAILED,
    "load_failure_counts": f"""
SELECT dump_id, "table", "column", reason, count(*) AS "values", min(raw) AS example FROM ({_FAILED}) GROUP BY ALL""",
    "dump_roundtrip_nation": """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""",
    "dump_roundtrip_customer": """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "dump_roundtrip_orders": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
  o_orderpriority FROM orders""",
    "dump_roundtrip_lineitem": """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem""",
    "dump_roundtrip_documents_sqlite": "SELECT doc_id, md5(text) AS digest, source FROM documents",
    "dump_roundtrip_documents_mysql": "SELECT doc_id, md5(text) AS digest, source FROM documents",
    "dump_classify": f"SELECT dump_id, {_KIND} AS kind, count(*) AS statements FROM {_S} GROUP BY 1, 2",
    "insert_rows": f'SELECT dump_id, stmt_no, "table", columns, CAST(row_no AS BIGINT) AS row_no, tuple FROM ({_ROWS})',
    "decode_values": f"""
SELECT stmt_no, CAST(row_no AS BIGINT) AS row_no, CAST(0 AS BIGINT) AS position, CASE WHEN f = 3 THEN 'hex' WHEN row_no = 0
  THEN 'number' WHEN row_no = 1 THEN 'null' ELSE 'expr' END AS kind, CASE WHEN f = 2 AND row_no = 0
  THEN CAST(stmt_no AS VARCHAR) WHEN row_no = 2 THEN 'f(g(h(i(j(1)))))' END AS text,
  CASE f WHEN 3 THEN '0F' END AS bytes FROM ({_ROWS})
UNION ALL SELECT stmt_no, row_no, 1, CASE row_no WHEN 2 THEN 'number' ELSE 'string' END,
  CASE row_no WHEN 0 THEN 'x;y' WHEN 1 THEN '(a,b)' ELSE '2' END, NULL FROM ({_ROWS}) WHERE f = 2""",
    "schema_catalog": f"""
SELECT stmt_no, "table", CAST(ordinal AS BIGINT) AS ordinal, "column", declared, type, type IS NULL AS refused, not_null,
  auto_increment, "default" FROM ({_COLUMNS})""",
    "map_types_mysql": f"""
SELECT CASE upper(declared) WHEN 'INTEGER' THEN 'BIGINT' WHEN 'TEXT' THEN 'LONGTEXT' WHEN 'NUMERIC' THEN 'DECIMAL(30,10)'
  WHEN 'BLOB' THEN 'LONGBLOB' WHEN 'REAL' THEN 'DOUBLE' ELSE upper(declared) END AS type, declared = 'NUMERIC' AS invented,
  count(*) AS columns FROM {plain(DECLARED)} GROUP BY 1, 2""",
    "key_catalog": f"""
SELECT stmt_no, 't' || stmt_no AS "table", k.* FROM {_S}, (VALUES ('primary', NULL, false, 'id', false),
  ('unique', 'nm', true, 'name', true), ('fulltext', NULL, false, 'name', false)) k(kind, index, "unique", columns, had_prefix)
WHERE f = 1 AND kind <> 'unique'
UNION ALL SELECT stmt_no, 't' || stmt_no, 'unique', 't' || stmt_no || '__nm', true, 'name', true FROM {_S} WHERE f = 1
UNION ALL SELECT stmt_no, 't1', 'unique', 'i' || stmt_no, true, 'name,id', true FROM {_S} WHERE f = 5""",
    "render_ddl": _DDL,
    "render_values": f"SELECT dump_id, stmt_no, CAST(part_no AS BIGINT) AS part_no, sql FROM ({_EMITTED_ROWS})",
    "render_ddl_mysql": r"""
WITH p AS (SELECT 'd' || p_size % 5 AS dump_id, p_partkey AS stmt_no, p_partkey % 5 AS f FROM part)
SELECT DISTINCT dump_id, CAST(-1 AS BIGINT) AS stmt_no, 'charset' AS kind, 'SET NAMES utf8mb4;' AS sql FROM p
UNION ALL SELECT dump_id, stmt_no, 'table', 'CREATE TABLE `t' || stmt_no || '` (' || chr(10) || chr(9) ||
  '`id` BIGINT PRIMARY KEY AUTO_INCREMENT,' || chr(10) || chr(9) || '`name` LONGTEXT NOT NULL,' || chr(10) || chr(9) ||
  '`n` DECIMAL(30,10),' || chr(10) || chr(9) || '`raw` LONGBLOB' || chr(10) || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;' FROM p WHERE f = 0
UNION ALL SELECT dump_id, stmt_no, 'index', 'CREATE UNIQUE INDEX `t' || stmt_no || '__name` ON `t' || stmt_no || '` (`name`(191));'
FROM p WHERE f = 0
UNION ALL SELECT dump_id, stmt_no, 'index', 'CREATE INDEX `i' || stmt_no || '` ON `elsewhere` (`a`, `b`);' FROM p WHERE f = 1
UNION ALL SELECT dump_id, stmt_no, 'drop', 'DROP TABLE IF EXISTS `t' || stmt_no || '`;' FROM p WHERE f = 4""",
    "render_values_mysql": r"""
SELECT 'd' || p_size % 5 AS dump_id, p_partkey AS stmt_no, CAST(0 AS BIGINT) AS part_no, CAST(4 - p_partkey % 5 AS BIGINT) AS tuples,
  CASE p_partkey % 5 WHEN 2 THEN 'INSERT INTO `t` (`a`, `b`) VALUES (' || p_partkey || ', ''it''''s C:\\ok''), (NULL, 0x0fA0);'
  ELSE 'INSERT INTO `o"dd` VALUES (0x6100, '''', -1.5, ''' || p_partkey || ''');' END AS sql
FROM part WHERE p_partkey % 5 IN (2, 3)""",
    "refusals": _REFUSALS,
    "lossy_report": f"""
SELECT dump_id, c.change, count(*) AS times FROM {_S}, (VALUES ('index dropped'), ('prefix length dropped'),
  ('declared scale lost')) c(change) WHERE f = 1 GROUP BY 1, 2""",
    "convert_summary": f"""
SELECT d.dump_id, (SELECT count(*) FROM ({_DDL}) x WHERE x.dump_id = d.dump_id) + r.n AS statements,
  (SELECT count(*) FROM ({_DDL}) x WHERE x.dump_id = d.dump_id AND kind = 'table') AS tables,
  (SELECT count(*) FROM ({_DDL}) x WHERE x.dump_id = d.dump_id AND kind = 'index') AS indexes, r.n AS rows,
  (SELECT count(*) FROM ({_REFUSALS}) x WHERE x.dump_id = d.dump_id) AS skipped, r.widest
FROM (SELECT DISTINCT dump_id FROM {_S}) d
JOIN (SELECT dump_id, count(*) AS n, max(length(sql)) AS widest FROM ({_EMITTED_ROWS}) GROUP BY 1) r USING (dump_id)""",
    "width_audit": f"""
SELECT dump_id, "table", count(*) AS rows, max(length(sql)) AS widest FROM {plain(EXPORT_SQL)} WHERE length(sql) > {WIDE}
GROUP BY 1, 2""",
    "drop_wide": f"""
SELECT "table", count(*) AS rows FROM {plain(EXPORT_SQL)}
WHERE length(sql) + length(regexp_replace(sql, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= {WIDE} GROUP BY 1""",
    "emitted_counts": f'SELECT dump_id, "table", count(*) AS n FROM {plain(EXPORT_SQL)} GROUP BY 1, 2',
    "structure_only": f"""
SELECT dump_id, "table", count(*) FILTER (WHERE NOT regexp_matches("table", '^cache(_|$)|^sessions$')) AS rows
FROM {plain(EXPORT_SQL)} GROUP BY 1, 2""",
    "violating_structure_only": f"""
SELECT dump_id, "table", count(*) AS n FROM {plain(EXPORT_SQL)} WHERE regexp_matches("table", '^cache(_|$)|^sessions$')
GROUP BY 1, 2""",
    "export_envelope": f"""
SELECT dump_id, count(*) AS statements, CAST(sum(length(sql)) + count(*) - 1 AS BIGINT) AS chars, count(*) AS rows,
  max(length(sql)) AS max_statement_chars, max(length(sql)) <= 100000 AS replayable FROM {plain(EXPORT_SQL)} GROUP BY 1""",
}
