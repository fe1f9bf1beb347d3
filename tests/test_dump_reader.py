"""The block-wise dump reader against a plain character-by-character one."""

import random

import pytest

from siteferry.functions.text import JS_SPACE_CHARS
from siteferry.sources import dump as dump_module
from siteferry.sources.dump import OUTSIDE, STATES, Cutter, _ends_from, _strip, read_dump


def statements_one_by_one(text: str, dialect: str) -> list[str]:
    """A slow reader with one state per character, written apart from the one under test."""
    out, now, i, quote, comment = [], "", 0, None, None
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if comment == "line":
            if c == "\n":
                comment, now = None, now + c
        elif comment == "block":
            if two == "*/":
                comment, i = None, i + 1
        elif quote:
            now += c
            if dialect == "mysql" and quote != "`" and c == "\\" and i + 1 < len(text):
                now, i = now + text[i + 1], i + 1
            elif two == quote * 2:
                now, i = now + quote, i + 1
            elif c == quote:
                quote = None
        elif two == "--" or c == "#":
            comment = "line"
        elif two == "/*":
            comment, i = "block", i + 1
        elif c == ";":
            out, now = [*out, now], ""
        else:
            quote, now = (c if c in "'\"`" else None), now + c
        i += 1
    return [s for s in (x.strip(JS_SPACE_CHARS) for x in [*out, now]) if s]


CASES = [
    ("INSERT INTO t VALUES ('a;b');\nSELECT 1;", "mysql", 2),
    ("INSERT INTO t VALUES ('it\\'s; here');SELECT 1", "mysql", 2),
    ("INSERT INTO t VALUES ('it''s; here');SELECT 1", "sqlite", 2),
    ("-- a;\n# b;\n/*!40101 SET x; */;\nSELECT 1;", "mysql", 1),
    ("SELECT 'x", "mysql", 1),
    ("SELECT 1 /* x", "mysql", 1),
    ("INSERT INTO t VALUES ('C:\\');\nSELECT 2;", "sqlite", 2),
    (";;;\n;", "mysql", 0),
]


def random_text(rng: random.Random, size: int) -> str:
    return "".join(rng.choice("ab;;'\"`\\\\-/*#\n\n ,()") for _ in range(size))


def test_walk_equals_the_slow_reader():
    rng = random.Random(7)
    for dialect in ("mysql", "sqlite"):
        cutter = Cutter(dialect)
        for _ in range(4000):
            text = random_text(rng, rng.randrange(1, 80)) + "\n"
            raw = text.encode()
            out, parts = [], []
            for kind, start, stop in cutter.walk(raw, 0):
                if kind == "text":
                    parts.append(raw[start:stop].decode())
                elif kind == "end":
                    out.append("".join(parts))
                    parts = []
            out = [s for s in (x.strip(JS_SPACE_CHARS) for x in [*out, "".join(parts)]) if s]
            assert out == statements_one_by_one(text, dialect), repr(text)


def test_maps_compose_at_every_line_end():
    rng = random.Random(11)
    for dialect in ("mysql", "sqlite"):
        cutter = Cutter(dialect)
        for _ in range(2000):
            first, second = ((random_text(rng, rng.randrange(0, 40)) + "\n").encode() for _ in range(2))
            state, ends = _ends_from(cutter, first, 0, None)
            whole_state, whole_ends = _ends_from(cutter, first + second, 0, None)
            known = _ends_from(cutter, second, 0, None)
            if state == OUTSIDE:
                then = known
            else:
                at = cutter.resume(second, state)
                then = (state, []) if at < 0 else _ends_from(cutter, second, at, known)
            assert state in STATES
            assert (then[0], ends + [e + len(first) for e in then[1]]) == (whole_state, whole_ends)


def test_strip_drops_comments_only():
    out = []
    assert _strip(Cutter("mysql"), b"a /* x */ b -- c\n d", OUTSIDE, out) == OUTSIDE
    assert b"".join(out) == b"a  b \n d"


@pytest.mark.parametrize(("text", "dialect", "count"), CASES)
def test_cases(spark, tmp_path, text, dialect, count):
    (tmp_path / "d.sql").write_text(text)
    got = [r.sql for r in read_dump(spark, str(tmp_path), dialect).orderBy("stmt_no").collect()]
    assert len(got) == count
    assert got == statements_one_by_one(text, dialect)


@pytest.mark.parametrize("dialect", ["mysql", "sqlite"])
@pytest.mark.parametrize("block", ["256", "128m"])
def test_block_size_does_not_matter(spark, tmp_path, dialect, block):
    rng = random.Random(3)
    for i in range(3):
        (tmp_path / f"r{i}.sql").write_text(random_text(rng, 4000 if i else 200), newline="")
    (tmp_path / "one.sql").write_text("SELECT 1;\n" * 3 + "INSERT INTO t VALUES ('" + "x;\n" * 900 + "');\nSELECT 2")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = read_dump(spark, str(tmp_path), dialect).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({(r.dump_id, r.stmt_no) for r in rows}) == len(rows)
    for file in tmp_path.glob("*.sql"):
        got = [r.sql for r in sorted(rows, key=lambda r: r.stmt_no) if r.dump_id.endswith("/" + file.name)]
        assert got == statements_one_by_one(file.read_text(newline=""), dialect), file.name


@pytest.fixture(params=["256", "128m"])
def block(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_quote_left_open_is_a_refusal_and_the_rest_is_read(spark, tmp_path, block):
    (tmp_path / "bad.sql").write_text("SELECT 1;\nSELECT '" + "x;\n" * 2000)
    for i in range(3):
        (tmp_path / f"good{i}.sql").write_text(f"SELECT {i};\nINSERT INTO t VALUES ('{'y;' * 300}');\n" * (1 + 5 * i))
    rows = read_dump(spark, str(tmp_path), max_statement_bytes=2000).collect()
    bad = [(r.stmt_no, r.sql, r.fault is None) for r in rows if r.dump_id.endswith("bad.sql")]
    assert sorted(bad) == [(0, "SELECT 1", True), (1, None, False)]
    assert sum(r.fault is not None for r in rows) == 1 and len(rows) == 2 + 2 * (1 + 6 + 11)


def test_files_of_a_folder_are_one_dump(spark, tmp_path, block):
    """Statements, quotes and comments begin in one file and end in another; one file is empty."""
    rng = random.Random(13)
    whole = {}
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        text = "".join(f"INSERT INTO t VALUES ('{i};\n{'x' * rng.randrange(60)}');\n/* {i};\n */ SELECT `{i}\n`;\n" for i in range(60))
        lines = text.split("\n")
        cuts = sorted(rng.sample(range(1, len(lines)), 4))
        for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
            (tmp_path / folder / f"part-{n}.sql").write_text("\n".join(lines[i:j]) + "\n" * (j < len(lines)), newline="")
        (tmp_path / folder / "part-1a.sql").write_text("")
        whole[folder] = statements_one_by_one(text, "mysql")
    rows = read_dump(spark, str(tmp_path), per="folder", part_pieces=8).collect()
    for folder, wanted in whole.items():
        got = sorted((r.stmt_no, r.sql) for r in rows if r.dump_id.endswith("/" + folder))
        assert [sql for _, sql in got] == wanted
    assert len({(r.dump_id, r.stmt_no) for r in rows}) == len(rows) == sum(map(len, whole.values()))


def test_lines_are_put_in_order_where_nothing_may_be_broadcast(spark, tmp_path, monkeypatch):
    from siteferry.functions import scale

    text = "".join(f"INSERT INTO t VALUES ('{i};\n{'x' * (i % 90)}');\n" for i in range(300))
    lines = text.split("\n")
    for n in range(5):
        (tmp_path / f"p{n}.sql").write_text("\n".join(lines[n * 120 : n * 120 + 120]) + "\n" * (n < 4))
    monkeypatch.setattr(dump_module, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(dump_module, "broadcast_if_small", lambda df: scale.broadcast_if_small(df, 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = read_dump(spark, str(tmp_path), per="folder").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.sql for r in sorted(rows, key=lambda r: r.stmt_no)] == statements_one_by_one(text, "mysql")


@pytest.mark.parametrize("dialect", ["mysql", "sqlite"])
def test_bytes_that_are_no_text(spark, tmp_path, dialect, block):
    every = bytes(range(256)) * 2
    quoted = every.replace(b"\\", b"\\\\").replace(b"\0", b"\\0") if dialect == "mysql" else every
    quoted = quoted.replace(b"'", b"''")
    (tmp_path / "d.sql").write_bytes(
        b"INSERT INTO t VALUES (1, '" + quoted + b"', 'gr\xc3\xbc\xc3\x9fe');\nSELECT \xff 1;\n-- \xfe\nSELECT 2"
    )
    rows = sorted(read_dump(spark, str(tmp_path), dialect).collect(), key=lambda r: r.stmt_no)
    digits = every.hex().upper()
    literal = f"0x{digits}" if dialect == "mysql" else f"x'{digits}'"
    assert [r.sql for r in rows] == [f"INSERT INTO t VALUES (1, {literal}, 'gr\u00fc\u00dfe')", None, "SELECT 2"]
    assert [r.fault is not None for r in rows] == [False, True, False]


def test_a_statement_that_other_blocks_share_is_not_kept(spark):
    """A task holds slices of a batch; of a block it keeps no more than the statement that it gives out itself."""
    import tracemalloc

    import pyarrow as pa

    row = b",(1, '" + b"x" * 400 + b"')"
    names = {"dump_id": "d", "place": 10, "shared": True, "state": 0, "base": 5, "ends": 1}

    def batches():
        for n in range(30):
            values = [b";" if (n, i) == (15, 0) else row for i in range(2_000)]
            yield pa.RecordBatch.from_pydict({**{k: [v] * len(values) for k, v in names.items()}, "value": values})

    tracemalloc.start()
    given = [b.num_rows for b in dump_module._cut_whole(Cutter("mysql"), 10**9)(batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert given == [] and peak < 8_000_000


def test_batches_are_taken_in_slices_of_bounded_size():
    import pyarrow as pa

    from siteferry.functions.batches import sliced

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000)), "text": ["x" * 50_000] * 1000})
    slices = list(sliced([batch.slice(0, 0), batch]))
    assert [n for s in slices for n in s.column("n").to_pylist()] == list(range(1000))
    assert max(s.num_rows for s in slices) <= 20


LONG = ",\n".join(f"({i}, 'it''s); {i}\n ( ', (1 + ({i}\n)), NULL)" for i in range(120))
LISTS = {
    "rows.sql": (f"SELECT 1;\nINSERT INTO `a,b` (`x`, `y`) VALUES {LONG};\nSELECT 2", True),
    "late.sql": ("-- x" * 90 + f";\n\n/* (\n */ REPLACE INTO t VALUES\n\n{LONG} /* ( */\n ;\n", True),
    "cut.sql": (f"INSERT INTO t VALUES {LONG}, (7, 'left\nopen", True),
    "after.sql": (f"INSERT INTO t VALUES {LONG}\n AS new", True),
    "upsert.sql": (f"INSERT INTO t VALUES {LONG}\nON DUPLICATE KEY UPDATE `x` = VALUES(`x`)", False),
    "gap.sql": (f"INSERT INTO t VALUES {LONG},\n,{LONG}", False),
    "select.sql": (f"INSERT INTO t SELECT * FROM u WHERE (a) IN ({LONG})", False),
    "deep.sql": ("INSERT INTO t VALUES " + "(" * 40 + "\n" * 2000 + ")" * 40 + f",\n{LONG}", False),
    "wide.sql": ("INSERT INTO t VALUES (1, '" + "wide;\n" * 400 + f"'),\n{LONG}", True),
}


def test_a_long_list_is_cut_at_its_rows(spark, tmp_path):
    """What is read from a list in parts is what is read from it as one value; only what is odd stays one value."""
    from pyspark.sql import functions as F

    from siteferry.operators import dump_statements
    from siteferry.operators.dump_convert import convert

    for name, (text, _) in LISTS.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "raw.sql").write_bytes(b"INSERT INTO t VALUES\n" + b",\n".join(b"(%d, '\xff\xfe;')" % i for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    try:
        read = [read_dump(spark, str(tmp_path), "mysql", list_bytes=b) for b in (2500, 10**9)]
        parts, whole = (dump_statements.classify(df).coalesce(2).localCheckpoint() for df in read)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    inserts = [[r for r in df.collect() if r.kind == "insert"] for df in (parts, whole)]
    for n, cut in [*((n, cut) for n, (_, cut) in LISTS.items()), ("raw.sql", True)]:
        mine, wanted = ([r for r in rows if r.dump_id.endswith("/" + n)] for rows in inserts)
        assert len(wanted) == 1 and (len(mine) > 2) == cut, n
        if not cut:
            assert mine == wanted, n
    assert max(len(r.sql) for r in inserts[0] if r.dump_id.endswith("/rows.sql")) < 3000
    outs = []
    for df in (parts, whole):
        lite = convert(df.drop("kind"), "mysql", "sqlite")
        tables = (
            dump_statements.insert_values(df, "mysql"), dump_statements.tail_refusals(df, "mysql"),
            dump_statements.statement_refusals(df, "mysql"), lite.emitted, lite.refusals, lite.summary,
        )
        outs.append([sorted(map(repr, t.collect())) for t in tables])
    for mine, wanted in zip(*outs):
        assert mine == wanted
    assert len(outs[0][0]) > 900 and len(outs[0][1]) >= 3
    joined = convert(parts.withColumn("sql", F.translate("sql", "`", '"')).drop("kind"), "sqlite", "mysql").emitted
    numbers = joined.filter(F.col("dump_id").endswith("/rows.sql") & (F.col("kind") == "row")).select("part_no", "tuples")
    numbers = sorted((r.part_no, r.tuples) for r in numbers.collect())
    assert len(numbers) > 2 and numbers[-1][0] + numbers[-1][1] == 120
    assert all(a + n == b for (a, n), (b, _) in zip(numbers, numbers[1:]))


def test_a_list_in_parts_may_be_longer_than_one_value_may_be(spark, tmp_path, monkeypatch):
    (tmp_path / "d.sql").write_text(LISTS["rows.sql"][0] + "\n'" + "x\n" * 4000)
    monkeypatch.setattr(dump_module, "MAX_STATEMENT_BYTES", 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    try:
        rows = read_dump(spark, str(tmp_path), "mysql", list_bytes=2500).collect()
        held = read_dump(spark, str(tmp_path), "mysql", list_bytes=2500, max_statement_bytes=3000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted({r.stmt_no for r in rows if r.fault is None}) == [0, 1] and sum(r.fault is not None for r in rows) == 1
    assert sorted(r.fault is None for r in held) == [False, False, True]


def test_a_long_list_within_one_block_is_cut_as_one_over_many_is():
    """Both ways give the rows of the list in order; an odd list stays one value, to the byte."""
    import pyarrow as pa

    for name, (text, cut) in LISTS.items():
        cutter = Cutter("mysql")
        lines = [line.encode() for line in text.split("\n")]
        names = {"dump_id": "d", "place": 0, "shared": False, "state": 0, "base": 0, "ends": 0}
        batches = [
            pa.RecordBatch.from_pydict({**{k: [v] * len(lines[i : i + 9]) for k, v in names.items()}, "value": lines[i : i + 9]})
            for i in range(0, len(lines), 9)
        ]
        parts, whole = (
            [r for b in dump_module._cut_whole(cutter, 10**9, size)(iter(batches)) for r in b.to_pylist()] for size in (2500, 10**9)
        )
        if name in ("gap.sql", "select.sql", "upsert.sql"):
            assert parts == whole, name
            continue
        scanner = dump_module.Scanner("mysql")

        def rows(statements):
            found = []
            for r in statements:
                head = scanner.head.match(r["sql"])
                at = head.end() if head else 0
                for n, (begin, at) in enumerate(scanner.tuples(r["sql"], at) if head else ()):
                    found.append((r["stmt_no"], r["first_row"] + n, r["sql"][begin:at]))
                found += [] if head and scanner.rest(r["sql"], at) is None else [(r["stmt_no"], scanner.rest(r["sql"], at))]
            return found

        assert rows(parts) == rows(whole), name
        assert len(parts) > len(whole) + 1, name


def test_plain_dump_text_is_cut_by_its_marks_alike():
    """Marks looked up all at once give the ends and pieces of a walk from mark to mark, which plain text no longer takes."""
    text = b"INSERT INTO `t` VALUES (1, 'a;b', 'it''s', \"x'y\");\n;SELECT 1 - 2 / 3;\nINSERT INTO `t` VALUES ('open; "
    for dialect in ("mysql", "sqlite"):
        for given in (text, text.replace(b"open", b""), text + b"\\", text + b"' -- a; b\n;", b"a /* ; */ b;", b"", b";", b"'"):
            for at in range(min(len(given), 60)):
                plain, walked = Cutter(dialect), Cutter(dialect)
                walked.plain_ends = lambda text, at: None
                found = [[s for s in cutter.walk(given, at) if s[0] != "text"] for cutter in (plain, walked)]
                covered = [{i for s in cutter.walk(given, at) if s[0] == "text" for i in range(s[1], s[2])} for cutter in (plain, walked)]
                assert found[0] == found[1] and covered[0] == covered[1], (dialect, given, at)
        plain = Cutter(dialect)
        plain.stretch = None
        assert [s[1] for s in plain.walk(text, 0) if s[0] == "end"] == [49, 51, 68]
