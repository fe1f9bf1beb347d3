"""Exact, near and line dedup, url verdicts and components, against plain versions."""

import hashlib
import random
import re

import pytest

from siteferry.llm.components import connected_components
from siteferry.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from siteferry.llm.line_dedup import drop_duplicate_lines, duplicate_lines, line_classes
from siteferry.llm.near_dedup import drop_near_duplicates, near_duplicates
from siteferry.llm.url_filter import judge_urls, rule_table
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, item int, row string, gone int"


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns of documents and some whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "r", 2) for i, t in rows], DOCS)


def sentence(draw, n):
    return " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) + str(draw.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Originals, exact copies, near copies at many distances, chains, short, blank and long texts."""
    draw = random.Random(5)
    rows = []
    for _ in range(14):
        words = sentence(draw, draw.randint(30, 90)).split()
        rows.append(" ".join(words))
        for _ in range(draw.randint(0, 6)):
            for _ in range(draw.randint(0, 3)):  # each copy is made from the one before: chains
                words[draw.randrange(len(words))] = "new%d" % draw.randint(0, 10**6)
            rows.append(" ".join(words))
    rows += [rows[3], rows[3].upper(), "  " + rows[3].replace(" ", "\n\t"), "", None, " \n ", "one", "one two", "ONE\ttwo"]
    rows.append(sentence(draw, 20_000))
    rows.append(rows[-1] + " tail")
    ids = list(range(len(rows)))
    draw.shuffle(ids)
    return list(zip(ids, rows))


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    mixed = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)]
    pairs = chain + star + mixed + [(7, 7), (7, None), (None, 3)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    wanted = brute.components([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert {r.node: r.component for r in got.collect()} == wanted
    assert got.count() == len(wanted)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, corpus):
    rows = corpus + [(1000 + i, "hot text") for i in range(300)] + [(1000, "hot  text"), (None, "hot\ntext"), (None, "alone")]
    got = exact_duplicates(documents(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    wanted = sorted(
        str((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()))
        for t, g in groups.items()
        for i in g
    )
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == wanted
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    left = drop_exact_duplicates(documents(spark, corpus))
    assert left.columns == documents(spark, []).columns
    assert left.count() == len({norm(t) for _, t in corpus})
    assert exact_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("words, block_items", [(4, 512), (5, 3)])
def test_near_dedup(spark, corpus, words, block_items):
    got = near_duplicates(documents(spark, corpus), words=words, block_items=block_items).collect()
    wanted = brute.near_classes(corpus, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted
    assert len(got) == len(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in wanted.values()}) < len(corpus)


def test_near_dedup_edges(spark, corpus):
    assert near_duplicates(documents(spark, [])).count() == 0
    text = dict(corpus)[corpus[0][0]]
    rows = [(4, text), (4, text), (9, text), (None, text), (None, ""), (2, None)]
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_duplicates(documents(spark, rows)).collect())
    wanted = [(4, 4, True), (4, 4, True), (9, 4, False), (None, 4, False), (None, None, True), (2, 2, True)]
    assert got == sorted(map(str, wanted))
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(None, long), (7, long.replace("w60", "other")), (None, "alone in all of this")]
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == sorted(map(str, [(None, 7, False), (7, 7, True), (None, None, True)]))
    left = drop_near_duplicates(documents(spark, corpus), words=5)
    kept = {i for i, (_, c) in brute.near_classes(corpus, 5).items() if i == c}
    assert {r.doc_id for r in left.collect()} == kept and left.columns == documents(spark, []).columns


@pytest.fixture(scope="module")
def lined():
    draw = random.Random(8)
    lines = [sentence(draw, draw.randint(1, 40)) for _ in range(60)]
    texts = []
    for _ in range(50):
        own = []
        for _ in range(draw.randint(1, 8)):
            line = draw.choice(lines)
            if draw.random() < 0.4:
                words = line.split()
                words[draw.randrange(len(words))] = "odd%d" % draw.randint(0, 99)
                line = " ".join(words)
            own.append(line if draw.random() < 0.8 else "  " + line.upper().replace(" ", "  "))
        texts.append("\n".join(own))
    texts += ["", None, " \n\n", "only here\n" + lines[0], "only here\n" + lines[0], sentence(draw, 9000), "é ü\nÉ Ü"]
    return list(enumerate(texts))


def test_line_dedup(spark, lined):
    wanted = brute.line_classes(lined)
    got = {(r.doc_id, r.line_no): r for r in duplicate_lines(documents(spark, lined)).collect()}
    assert got.keys() == wanted.keys()
    found = {p: (r.keep_doc_id, r.keep_line_no) for p, r in got.items()}
    # Banding may miss a link; it never makes one.
    missed = sum(found[p] != wanted[p] for p in wanted)
    assert missed <= 0.02 * len(wanted)
    assert all(found[found[p]] == found[p] and got[p].kept == (found[p] == p) for p in found)
    assert all(wanted[found[p]] == wanted[p] for p in found)


def test_line_dedup_rewrites_documents(spark, lined):
    docs = documents(spark, lined)
    kept = {(r.doc_id, r.line_no) for r in duplicate_lines(docs).filter("kept").collect()}
    wanted = {}
    for i, text in lined:
        lines = (text or "").split("\n")
        rest = [x for n, x in enumerate(lines) if not x.strip() or (i, n) in kept]
        lost = len(rest) < len(lines)
        if not lost or "".join(rest).strip():
            wanted[i] = "\n".join(rest) if lost else text
    left = drop_duplicate_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == wanted
    assert all(r.n_chars == len(r.text or "") for r in left.collect())


def test_line_dedup_edges(spark):
    assert duplicate_lines(documents(spark, [])).count() == 0
    assert drop_duplicate_lines(documents(spark, [])).count() == 0
    rows = [(None, "same line"), (3, "same line"), (3, "same line"), (5, "Same  line\nother"), (None, "same line")]
    left = sorted(str((r.doc_id, r.text)) for r in drop_duplicate_lines(documents(spark, rows)).collect())
    wanted = [(None, "same line"), (None, "same line"), (3, "same line"), (3, "same line"), (5, "other")]
    assert left == sorted(map(str, wanted))


def test_line_dedup_sees_text_beyond_the_eighth_character_of_a_word(spark):
    apart = ["https://one.example/a/b/c", "https://two.example/x/y/z", "2024-01-15", "2024-01-17", "andththwhes.", "andththwhwh."]
    apart += ["那天下午我们一起去了海边看日落", "那天下午我们一起读完了那本旧书", "ab", "abc", "🙂👍🏽🙂👍🏽🙂👍🏽x", "🙂👍🏽🙂👍🏽🙂👍🏽y"]
    long = "".join(chr(0x4E00 + 7 * i) for i in range(300))
    rows = [*enumerate(apart), (50, long), (51, "始" + long), (52, long[:150] + "中" + long[150:]), (60, "x" * 9), (61, "x" * 12)]
    found = {r.doc_id: r.keep_doc_id for r in duplicate_lines(documents(spark, rows)).collect()}
    assert found == {i: i for i in range(len(apart))} | {50: 50, 51: 50, 52: 50, 60: 60, 61: 60}


def test_line_dedup_finds_the_links_of_one_template(spark):
    """Lines that share buckets with very many lines that are not near them, in blocks smaller than the buckets."""
    draw = random.Random(11)
    template = sentence(draw, 50).split()
    lines = []
    for _ in range(300):
        words = list(template)
        for at in draw.sample(range(50), 6):
            words[at] = "w%05d" % draw.randint(0, 99999)
        lines.append(" ".join(words))
        words[draw.randrange(50)] = "v%05d" % draw.randint(0, 99999)
        lines.append(" ".join(words))
    draw.shuffle(lines)
    rows = list(enumerate(lines))
    sets = [brute.line_sets(x) for x in lines]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a + 1, len(sets))
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    wanted = brute.line_classes(rows)
    for block_lines in (512, 64):
        classes = line_classes(documents(spark, rows), block_lines=block_lines)
        keys = {hashlib.md5(x.encode()).digest(): i for i, x in rows}
        found = {i: i for i, _ in rows} | {keys[bytes(r.key)]: r.keep_doc_id for r in classes.collect()}
        joined = sum(found[a] == found[b] for a, b in links)
        assert len(links) > 250 and joined >= 0.97 * len(links)
        assert all(wanted[i, 0] == wanted[found[i], 0] for i in found)


RULES = (("org", "/", "allow"), ("bad.org", "/x", "block"), ("com", "/de/", "block"), ("evil.com", "/", "block"))
URLS = [
    (1, "https://Sub.BAD.org/x/1?q#f", None, "sub.bad.org", "/x/1", "bad.org/x", "block"),
    (2, "http://notbad.org/x", "", "notbad.org", "/x", "org/", "allow"),
    (3, "ftp://a.com/de/", "<p>", "a.com", "/de/", "com/de/", "block"),
    (4, None, "x", "", "", None, "allow"),
    (5, "no scheme", "x", "", "", None, "allow"),
    (6, "http://org", "x", "org", "", None, "allow"),
    (7, "http://n.net/a?b=1#c", '<link href="//evil.com/q" rel="canonical">', "n.net", "/a", None, "block"),
    (8, "https://n.net/b", "<META http-equiv='Refresh' content='0; url=/a?b=1'>", "n.net", "/b", None, "block"),
    (9, "https://n.net/a?b=1", "", "n.net", "/a", None, "block"),
    (10, "https://n.net/a", "<!-- <link rel=canonical href=http://evil.com/> -->", "n.net", "/a", None, "allow"),
    (11, "https://good.org/p", "<link rel=canonical href=http://evil.com/>", "good.org", "/p", "org/", "allow"),
    (12, "http://m.net/d/e", "<link rel=canonical href='f'>", "m.net", "/d/e", None, "allow"),
    (12, "http://m.net/d/e", "<link rel=canonical href='f'>", "m.net", "/d/e", None, "allow"),
]


def test_urls(spark):
    made = [(i, u, h, "x", "y") for i, u, h, *_ in URLS]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, host string, _spread string")
    rules = rule_table(spark, RULES)
    got = judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(u[0], *u[3:]) for u in URLS], key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0
    more = spark.createDataFrame([("m.net/d/f", "x.com/de/1")], "a string, b string")
    assert {r.verdict for r in judge_urls(pages, rules, more).filter("page_id = 12").collect()} == {"block"}
