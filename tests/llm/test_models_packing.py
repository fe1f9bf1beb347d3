"""Packing, mixing, classifiers, page texts and search, against plain versions and on edge rows."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteferry.llm import packing, quality, toxicity
from siteferry.llm.html_text import extract_text, main_text
from siteferry.llm.mixing import mix, mixed_stream, period, whole_weights
from siteferry.llm.packing import best_fit, pack
from siteferry.llm.tokens import TokenIds
from siteferry.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bin int, slot string, score string"
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows):
    """Rows (doc_id, text, source) with other columns, some with names that the operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "s", "x") for i, t, s in rows], DOCS)


ODD_TEXTS = [
    "It's a   TEST, isn't it? 123 4,56 x", "naïve Ÿ İstanbul ΣΑΣ é ﬁ", "a\x1cb\x00c\x85d", "日本語 текст", "x" * 3000,
    "<|endoftext|> and <|startoftext|>", "", "\n\t ", "don't've'll'd'm're's", "½²³ ªº ŉ ſ ß", "🙂👍🏽 ok", "a​b­c",
]


def test_token_ids_equal_the_library():
    whole, own = Tokenizer.from_file(VOCAB), TokenIds(VOCAB)
    assert own.by_part
    for text in ODD_TEXTS + ["".join(chr(c) for c in range(32, 0x250)), " ".join(chr(c) for c in range(0x180))]:
        wanted = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own(text) == wanted == own(text)


def test_best_fit():
    bins, offsets, fills = best_fit(np.array([5, 5, 4, 6, 10, 3, 7]), 10)
    assert sorted(fills.tolist()) == [10, 10, 10, 10]
    assert offsets.tolist()[4] == 0 and bins[3] == bins[2] and bins[5] == bins[6]


def test_bins_that_fit_meet_wherever_they_were_made(spark):
    """At production values: all bins of 1,100 lie in one half of the partitions, all of 900 in the other."""
    rows = spark.range(40_000).selectExpr(
        "(id div 4000) * 4294967296 + id % 4000 AS bin", "(id div 4000) * 4294967296 + id % 4000 AS head", "0L AS base",
        "CASE WHEN id < 20000 THEN 1100L ELSE 900L END AS fill",
    )
    for node_bins in (packing.NODE_BINS, 3000):
        merged = packing._merge_bins(rows, packing.CAPACITY, packing.SLACK, node_bins)
        placed = merged.join(rows.select("bin", "fill"), "bin").groupBy("head").agg(
            F.sum("fill").alias("sum"), F.max(F.col("base") + F.col("fill")).alias("end"), F.count("*").alias("n")
        )
        got = placed.agg(F.count("*"), F.sum("n"), F.max("end"), F.count_if(F.col("sum") != F.col("end"))).first()
        assert got[0] <= 20_200 and tuple(got)[1:] == (40_000, 2000, 0)


@pytest.mark.parametrize("capacity, parts, node_bins, block_bytes", [(2048, 1, 32768, 1 << 25), (64, 9, 32768, 1 << 25), (64, 9, 5, 900)])
def test_pack(spark, capacity, parts, node_bins, block_bytes):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["alpha", "beta,", "Gamma"]) for _ in range(draw.randint(0, 90))), "s") for i in range(150)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(ODD_TEXTS)] + [(7, "twice", "s"), (7, "twice", "s"), (None, None, "s")]
    rows.append((5000, "long " * 6000, "s"))
    whole = Tokenizer.from_file(VOCAB)
    wanted = Counter()
    for i, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted[i, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), tuple(part)] += 1
    docs = documents(spark, rows).repartition(parts, "doc_id")
    got = pack(docs, VOCAB, capacity=capacity, slack=2, node_bins=node_bins, block_bytes=block_bytes, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == wanted
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= (1.03 * least + 1 if node_bins > 5 else 1.3 * least)
    assert pack(documents(spark, []), VOCAB).count() == 0


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 1, 1], [7, 5, 2, 1], [97, 2, 1], [10] * 7 + [1]])
def test_period_stays_within_a_block(weights):
    total, slots = sum(weights), period(weights)
    assert sorted(s for own in slots for s in own) == list(range(total))
    for w, own in zip(weights, slots):
        for t in range(total + 1):
            assert abs(Fraction(w * t, total) - sum(s < t for s in own)) < 1
    assert sum(whole_weights({"a": 0.5, "b": 1e-9, "c": 0.25}, 100).values()) in (100, 101)


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, "x" * draw.choice([0, 1, 50, 120, 700]), draw.choice("aaaaaabbc")) for i in range(400)]
    rows += [(1, "same", "a"), (1, "same", "a"), (None, None, None), (None, "t", "b"), (900, None, "c")]
    docs = documents(spark, rows)
    weights = {"a": 1, "b": 2, "c": 1, "": 0.5}
    got = mix(docs, weights, block_chars=100, resolution=18, buckets=7).collect()
    assert Counter((r.doc_id, r.source, r.n_chars) for r in got) == Counter((i, s or "", len(t or "")) for i, t, s in rows)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        own.sort(key=lambda r: (r.position, r.slot))
        assert sum(r.n_chars for r in own) == max(r.position + r.n_chars for r in own)
        slots = [r.slot for r in own]
        assert slots == sorted(slots) and all(r.block <= r.position // 100 for r in own)
    # No slot serves two blocks, and till the first source ends each is less than a block from its share.
    blocks = {(r.source, r.block): r.slot for r in got}
    taken = {}
    for (source, _), slot in blocks.items():
        assert taken.setdefault(slot, source) == source
    sizes = {s: -(-sum(r.n_chars for r in own) // 100) or 1 for s, own in by_source.items()}
    share = {s: Fraction(w) / sum(map(Fraction, whole_weights(weights, 18).values())) for s, w in whole_weights(weights, 18).items()}
    first_end = min(int(n / share[s]) for s, n in sizes.items()) - 1
    schedule = {r.slot: r for r in got}
    for r in schedule.values():
        if r.slot < first_end:
            assert r.release <= r.slot < r.deadline
    assert mix(documents(spark, [])).count() == 0
    again = mixed_stream(docs, weights=weights, block_chars=100, resolution=18, buckets=7)
    assert again.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in again.collect()) == Counter(rows)
    place = {(r.doc_id, r.source, r.n_chars): r.slot for r in got}
    order = [place[r.doc_id, r.source or "", len(r.text or "")] for r in again.collect()]
    assert order == sorted(order)
    with pytest.raises(ValueError):
        mix(docs, resolution=2)


BAD = "idiot scum trash worthless".split()


def labelled(n, seed):
    draw = random.Random(seed)
    syllables = ["ba", "do", "ri", "ten", "mo", "lus", "ka", "ver", "is", "on"]
    rows = []
    for i in range(n):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(5, 120))]
        bad, low = i % 5 == 0, i % 4 == 1
        for _ in range(3 * bad):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        text = " ".join(words).capitalize() + "."
        rows.append((i, "!! ".join(text.upper().split()) if low else text, int(bad), int(not low)))
    return rows


@pytest.mark.parametrize(
    "label, build, score", [
        ("toxic", toxicity.toxicity_model, toxicity.score_toxicity), ("quality", quality.quality_network, quality.score_quality),
    ],
)
def test_classifiers(spark, label, build, score):
    rows = labelled(700, 1)
    docs = documents(spark, [(i, t, "s") for i, t, *_ in rows])
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = build(docs, labels, max_rows=400)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    right = [got[i].predicted == (x if label == "toxic" else q) for i, _, x, q in rows if got[i].held_out]
    assert sum(right) >= 0.95 * len(right) > 100
    assert all(0 <= r.score <= 1 for r in got.values())
    # Odd rows have scores, the same wherever they stand, and whole texts count.
    odd = documents(spark, [(None, None, "s"), (1, "", "s"), (2, "a" * 300_000 + " !", "s"), (2, "x y", "s"), (2, "x y", "s")])
    found = score(odd, model).collect()
    assert len(found) == 5 and found[3].score == found[4].score and not found[0].held_out
    assert found[0].score == found[1].score
    tail = "ba do ri. " * 20_000 + (" idiot scum " if label == "toxic" else "")
    late = score(documents(spark, [(1, tail, "s"), (2, "ba do ri. " * 20_000, "s")]), model).collect()
    assert label == "quality" or late[0].score > late[1].score
    assert score(documents(spark, []), model).count() == 0
    # Nothing to learn from.
    empty = build(docs, labels.limit(0))
    assert {r.score for r in score(docs, empty).collect()} <= {0.0, 0.5}


def test_drop_toxic_keeps_all_columns(spark):
    rows = labelled(400, 2)
    model = toxicity.train([(t, x) for _, t, x, _ in rows])
    docs = documents(spark, [(i, t, "s") for i, t, *_ in rows])
    kept = {r.doc_id for r in toxicity.score_toxicity(docs, model).filter("predicted = 0").collect()}
    left = toxicity.drop_toxic(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == kept
    assert sum(x for i, _, x, _ in rows if i in kept) <= 4


def test_network_slopes():
    """One step's pooled values do not depend on how a text is laid out among others."""
    net = quality.train([("good text, here. " * 40, 1), ("BAD!! " * 90, 0)] * 6)
    texts = [b"", b"a", b"good text, " * 60, "é".encode() * 700, b"BAD!! " * 3000]
    together = quality.predict(net, texts)
    assert np.allclose(together, [quality.predict(net, [t])[0] for t in texts])
    assert together[2] > 0.5 > together[4]


PAGES = [
    ("<article><h1>T &amp; U</h1><p>One  two,\n three. More words here.<p>Last, one. And more.</article><footer>&copy; x</footer>",
     "T & U\n\nOne two, three. More words here.\n\nLast, one. And more."),
    ("<body><nav><a href=/>Home</a></nav><div class=cookie-notice>Accept, please.</div><div id=main><p>Real text, with sense. Yes."
     "<div class='ad'>Buy it now!</div><ul><li>first point<li>second point</ul></div><div class=comments><p>Nice, thanks. A lot.</div>"
     "<form>Name <input></form><script>var a='<p>no</p>';</script><style>p{}</style><aside>See also</aside></body>",
     "Real text, with sense. Yes.\n\nfirst point\n\nsecond point"),
    ("<p>a<br>b &lt;i&gt; &#233;&nbsp;c", "a b <i> é c"),
    ("no tags < here & there", "no tags < here & there"),
    ("<!-- only --><script>x", ""), ("", ""), (None, ""), ("<p>cut <b", "cut <b"), ("<title>t</title>", ""),
]


def test_page_texts(spark):
    rows = [(i, "u", page, "t") for i, (page, _) in enumerate(PAGES)] + [(None, None, "<p>x", None)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got] == [text for _, text in PAGES] + ["x"]
    assert all(r.n_chars == len(r.text) for r in got) and got[-1].page_id is None
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("open_tag, close_tag", [
    ("<div class='content has-sidebar'>", "</div>"), ("<div id=page class='header-fixed'>", "</div>"), ("<form id=aspnetForm>", "</form>"),
    ("<div class='post no-comments'>", "</div>"), ("<div class='sidebar layout'><div class=widget>", "</div></div>"),
    ("<article><div class='post related'>", "</div></article>"), ("<h1>T</h1><div class='sidebar-left'>", "</div>"),
])
def test_page_text_in_a_wrapper_with_a_listed_word(open_tag, close_tag):
    story = [f"Sentence {i} of the story, which goes on. And on." for i in range(12)]
    body = "".join(f"<p>{p}</p>" for p in story)
    text = main_text(f"<body><nav><a href=/>Home</a></nav>{open_tag}{body}<div class=share>Share it.</div>{close_tag}<footer>f</footer></body>")
    assert text.removeprefix("T\n\n") == "\n\n".join(story)


def test_page_text_without_long_comments():
    talk = "".join(f"<article class=comment><p>I say, number {i}. Yes, indeed.</p></article>" for i in range(40))
    page = f"<body><article><h1>T</h1><p>Short, but whole.</p></article><div id=comments>{talk}</div></body>"
    assert main_text(page) == "T\n\nShort, but whole."


def test_page_text_is_linear_and_whole():
    body = "".join(f"<p>Paragraph {i}, which says something. Again.</p>" for i in range(20_000))
    text = main_text(f"<html><body><nav>{'<a>x</a>' * 500}</nav><article>{body}</article></body></html>")
    assert text.count("\n\n") == 19_999 and text.endswith("Again.")
    assert main_text("<" * 50_000 + "p>x") and main_text("<p a='" + "<b>" * 20_000 + "x") is not None


def search(rows, k=5):
    whole = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = set()
    for q, v in sorted({(i, tuple(v)) for i, v in whole if i % 5 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return found


@pytest.mark.parametrize("blocks", [(16_384, 1024), (40, 7)])
def test_top_k(spark, blocks):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 340)]  # many equal vectors: ties
    rows += [(400, None), (405, [0.1, None]), (410, [float("nan")] * 12), (415, [float("inf")] * 12), (420, []), (None, [0.1] * 12)]
    rows += [(500, [0.5, -0.25]), (505, [1.0, 1.0]), (510, [3.0]), (5001, [9.0] * 12)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, codes int")
    got = top_k(frame, F.col("vec_id") % 5 == 0, block_vectors=blocks[0], block_queries=blocks[1]).collect()
    assert {tuple(r) for r in got} == search(rows) and len(got) == len(search(rows))
    assert top_k(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_with_repeated_identifiers(spark):
    draw = random.Random(16)
    rows = [(i % 40, [draw.gauss(0, 0.3) for _ in range(6)]) for i in range(160)]
    rows += [(5, rows[0][1])] * 4 + [(41, rows[0][1]), (10, rows[10][1])]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    wanted = set()
    for query in {i for i, _ in rows if i % 10 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for n, q in whole if n == query for i, v in whole if i != query)
        wanted |= {(query, rank, i, -score) for rank, (score, i) in enumerate(scores[:5], 1)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in ((1000, 1000), (30, 2)):
        got = top_k(frame, F.col("vec_id") % 10 == 0, block_vectors=blocks[0], block_queries=blocks[1]).collect()
        assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_word_pattern_is_one_word():
    assert toxicity.windows("Don't go, Ünï_co 12ab") == re.findall("[a-zäöüï]+", "don t go ünï co ab")


def test_workers_give_back_and_cache_little(spark, monkeypatch):
    """A small cache of parts changes no row and holds no more than it may; a task that ends gives its memory back."""
    from siteferry.functions import batches
    from siteferry.llm.queries import word_tokenizer
    from siteferry.llm.tokens import TokenIds, token_ids

    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}x{chr(97 + (i * j) % 26)}y" for j in range(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    small, usual = (sorted(map(tuple, pack(docs, word_tokenizer(), **o).select(*columns).collect())) for o in ({"cache_bytes": 4000}, {}))
    assert small == usual and len(small) >= 60
    encode, whole = token_ids(word_tokenizer(), 4000), TokenIds(word_tokenizer())
    assert [encode(text) for _, text in rows] == [whole(text) for _, text in rows]
    assert encode.parts.held <= 2000 + 400 < whole.parts.held
    token_ids(word_tokenizer()).forget()

    given = []
    monkeypatch.setattr(batches, "give_back", lambda: given.append(1))
    assert list(batches.giving_back(lambda found: (x + 1 for x in found))(iter([1, 2]))) == [2, 3] and given == [1]
