"""Plain versions of the conversation, repeat and spelling operators."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    """(conv, turn, role, text) after damage."""
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def repaired(turns):
    """The result row of one conversation from its damaged (turn, role, text)."""
    sys.setrecursionlimit(20_000)
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}:{t[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in turns:
        end = text.rstrip(SPACE)
        faults.append(
            "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, edits, lines) of the cheapest way to finish; at most three insertions in a row."""
        options = []
        to = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[to]
        if i == len(turns) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            cost, edits, lines = best(i, to, inserted + 1)
            options.append((cost + 2, "I" + edits, (f"{full}:", *lines)))
        if i < len(turns):
            cost, edits, lines = best(i + 1, state, 0)
            options.append((cost + 3, "D" + edits, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                _, role, text = turns[i]
                if (state, role[:1]) in NEXT:
                    cost, edits, lines = best(i + 1, NEXT[state, role[:1]], 0)
                    options.append((cost + extra, "K" + edits, (f"{role}:{text}", *lines)))
                cost, edits, lines = best(i + 1, to, 0)
                options.append((cost + 2 + extra, "R" + edits, (f"{full}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    cost, edits, lines = best(0, "", 0)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations(rows):
    """conv_id to its result row, for all conversations of `rows`."""
    rows = list(rows)
    kept = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        kept[conv].append((turn, role, text))
    return {conv: repaired(kept[conv]) for conv in {r[0] for r in rows}}


def repeats(texts, length=200):
    """Per text (bytes): which bytes lie in a string of `length` bytes that also starts elsewhere."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    marks = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        marks.append(bytes(mark))
    return marks


def words(documents, every=97, least=5, often=3):
    """Word to count over (doc_id, text)."""
    found = Counter()
    for i, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            digest = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if digest % every == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(counts):
    """Result rows (word, form, root, n, n_near, form_n) from a comparison of words with all others of like length."""
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    near = {w: [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        if others and counts[best := min(others, key=lambda o: (-counts[o], o))] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}
