"""Conversation repair, repeated spans and spelling variants against plain versions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siteferry.functions.scan import entry_states
from siteferry.llm import conversation_repair as repair
from siteferry.llm import repeated_spans as repeats
from siteferry.llm import spelling
from tests.llm import brute_new as brute

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

TURN = "conv_id bigint, turn bigint, role string, text string, key string, place int"


def repaired(spark, rows, **sizes):
    """Summary rows by key, of rows as they are, with clashing extra columns."""
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURN)
    return {r.key: r.asDict() for r in repair.repair_summary(repair.repair_conversations(frame, **sizes)).collect()}


def wanted(rows):
    turns = {}
    for conv, turn, role, text in rows:
        key = "" if conv is None else f"={conv}"
        turns.setdefault(key, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {key: {"key": key, **brute.repaired(t)} for key, t in turns.items()}


LITERAL = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"),
    (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "user", "what"),
    (3, None, "assistant", None), (3, None, None, "x."), (3, 5, "", ""), (3, 9, "tool", "y. \n"),
    (None, 0, "user", "A."), (None, 1, "user", "B."), (None, 2, "assistant", "C"), (None, 7, "system", "D."),
    (4, 0, "assistant", "A."), (5, 0, "system", "A."), (6, 0, "user", " \t"),
]


def test_repair_of_literal_rows(spark):
    assert repaired(spark, LITERAL) == wanted(LITERAL)
    assert repaired(spark, []) == {}


def test_repair_across_segments_and_parts(spark):
    """One conversation holds most rows and lies in many segments, which are folded in several levels."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", ""]
    rows = [(1, rng.randrange(400), rng.choice(roles[:2] if rng.random() < 0.8 else roles), rng.choice("abcdefg ") + rng.choice([".", "", "!"]))
            for _ in range(600)]
    rows += [(i, t, rng.choice(roles), f"{t}.") for i in range(2, 30) for t in range(rng.randrange(1, 5))]
    assert repaired(spark, rows, segment_rows=5, part_pieces=8) == wanted(rows)


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["user", "assistant", "system", "tool"]),
                          st.sampled_from(["a.", "b", "", "c!"])), max_size=25), st.integers(1, 4))
def test_repair_of_any_rows(spark, rows, size):
    assert repaired(spark, rows, segment_rows=size, part_pieces=4) == wanted(rows)


def test_repaired_turns(spark):
    frame = spark.createDataFrame([(2, 0, "user", "Hi."), (2, 1, "user", "Yes.")], "conv_id int, turn int, role string, text string")
    turns = repair.repaired_turns(repair.repair_conversations(frame)).orderBy("place", "number")
    assert [(r.role, r.text) for r in turns.collect()] == [("user", "Hi."), ("assistant", "Yes.")]


def test_damage(spark):
    rows = [(i % 7, i, ["user", None][i % 3 == 0], [f"{i}. a? b!", None][i % 5 == 0]) for i in range(200)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = [tuple(r) for r in repair.damage(frame).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute.damaged(rows)))


def test_entry_states_of_long_sequences(spark):
    rng = random.Random(1)
    pieces = [(key, place * 7 - 50, [rng.randrange(3) for _ in range(3)], [rng.randrange(5) for _ in range(3)])
              for key, size in (("a", 300), ("b", 1), ("c", 40), ("", 2)) for place in range(size)]
    expected = set()
    for key in {p[0] for p in pieces}:
        state, base = 1, 0
        for _, place, to, add in sorted(p for p in pieces if p[0] == key):
            expected.add((key, place, state, base))
            state, base = to[state], base + add[state]
    rng.shuffle(pieces)
    frame = spark.createDataFrame(pieces, "key string, place bigint, to array<int>, add array<bigint>")
    for size in (1000, 60, 16):
        assert {tuple(r) for r in entry_states(frame, 1, size).collect()} == expected
    assert entry_states(frame.limit(0), 1).collect() == []


def removed(spark, texts, **sizes):
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id int, text string, id int, mark string")
    found = {r.doc_id: r for r in repeats.remove_repeats(frame, **sizes).collect()}
    assert len(found) == len(texts)
    return found


def check_removed(found, texts, length=200):
    data = [(t or "").encode() for t in texts]
    for i, (d, mark) in enumerate(zip(data, brute.repeats(data, length))):
        assert bytes(found[i].kept) == bytes(b for b, m in zip(d, mark) if not m), i
        inside = bytearray(len(d))
        for s in found[i].spans:
            inside[s.start : s.end] = b"\1" * (s.end - s.start)
        assert bytes(inside) == mark and found[i].n_bytes == len(d)


def some_text(rng, size):
    return "".join(rng.choice("abcdefgh éü") for _ in range(size))


def copies(rng):
    base = [some_text(rng, 500) for _ in range(4)]
    texts = [None, "", "short", base[0], base[0], base[1][:199], base[1][:200] + "x", base[1][:201], "y" * 450, "ab" * 130]
    texts += [some_text(rng, rng.randrange(300)) + base[k % 4][k : k + 260 + k] + some_text(rng, 90) for k in range(24)]
    near = list(base[2])
    near[250] = "#"
    return [*texts, "".join(near), base[3] + base[3], "é" * 120]


def test_repeats(spark):
    texts = copies(random.Random(3))
    check_removed(removed(spark, texts), texts)


def test_repeats_with_split_landmarks_and_many_shards(spark):
    """Groups far beyond the size of one are split to their strings; shards hold a text or two."""
    texts = copies(random.Random(4))
    check_removed(removed(spark, texts, shard_bytes=300, group_bytes=700, task_bytes=2000), texts)


def test_repeats_of_another_length_and_no_rows(spark):
    texts = copies(random.Random(9))
    check_removed(removed(spark, texts, length=61), texts, 61)
    assert removed(spark, []) == {}
    with pytest.raises(ValueError):
        removed(spark, texts, length=20)


def test_long_text_and_repeated_identifiers(spark):
    rng = random.Random(2)
    text = some_text(rng, 200_000)
    twice = text[100_000:100_900]
    rows = [(7, text + twice), (7, "short"), (None, twice[100:400]), (None, twice[100:400])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in repeats.remove_repeats(frame).collect())
    size = len(twice.encode())
    cut = len(twice[100:400].encode())
    assert found == sorted([("7", len((text + twice).encode()), 2 * size), ("7", 5, 0), ("None", cut, cut), ("None", cut, cut)])


def test_merge_alone_equals_counting():
    """The merge of shards on texts that overlap in every way."""
    rng = random.Random(8)
    base = some_text(rng, 400).encode()
    texts = [base[a : a + rng.randrange(60, 300)] for a in (rng.randrange(90) for _ in range(60))] + [b"z" * 200]
    shards = repeats.Shards(texts, 60, 500)
    import numpy as np

    got = shards.repeated(np.ones(len(texts)))
    from collections import Counter

    strings = [t[i : i + 60] for t in texts for i in range(len(t) - 59)]
    times = Counter(strings)
    assert got.tolist() == [times[s] > 1 for s in strings]


DOC = "doc_id bigint, text string, word string, n int"


def variants(spark, rows, **given):
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], DOC)
    return {tuple(r) for r in spelling.spelling_variants(spelling.word_counts(frame), **given).collect()}


def misspelt(rng, words, size):
    out = []
    for _ in range(size):
        word = rng.choice(words)
        at, kind = rng.randrange(len(word)), rng.randrange(12)
        if kind == 0:
            word = word[:at] + word[at + 1 :]
        elif kind == 1:
            word = word[:at] + rng.choice("aéß") + word[at:]
        elif kind == 2:
            word = word[:at] + rng.choice("abÀ") + word[at + 1 :]
        out.append(word)
    return " ".join(out)


def test_spelling(spark):
    rng = random.Random(6)
    words = ["colour", "favourite", "Straße", "aaaaa", "aaaaaa", "Überzeugung", "letter", "better", "butter", "bitter"]
    rows = [(i, misspelt(rng, words, 120)) for i in range(60)] + [(None, "Hello hello HELLO hellö, jello"), (3, None), (4, ""), (5, "l'été 12")]
    counts = brute.words(rows)
    expected = brute.spellings(counts)
    assert {w for w, *_ in expected} >= {"colour", "straße"}
    assert variants(spark, rows) == expected
    assert variants(spark, rows, group_pairs=1) == expected
    assert variants(spark, rows * 2) == brute.spellings(brute.words(rows * 2))
    assert variants(spark, []) == set()


def test_spelling_narrows_common_chunks(spark):
    """Very many words share their first half and many their last."""
    rng = random.Random(7)
    counts = {"anfang" + "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 7))): rng.randrange(3, 99) for _ in range(900)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    expected = brute.spellings(counts)
    for bound in (spelling.GROUP_PAIRS, 30):
        assert {tuple(r) for r in spelling.spelling_variants(frame, group_pairs=bound).collect()} == expected


def test_runs_are_not_cut_by_blocks():
    import re

    run = re.compile(spelling.RUN)
    text = "ab cde " * 50 + "x" * 100 + " yz"
    assert [w for b in spelling._blocks(text, run, 13) for w in run.findall(b)] == run.findall(text)
