"""Token ids of whole texts by a public tokenizer file, with a cache of parts.

The tokenizer of this file kind lower-cases, splits at white space and at letter, digit and symbol borders, and
then merges within each such part. So a text of plain Latin letters is looked up part by part, and only new parts
are merged. Any other text, and any other tokenizer, goes through the library whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

# Characters that composition leaves alone, whose lower case does not depend on what stands around them, and of which
# Python and the tokenizer agree whether they are letters, digits or neither.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ]")

# The parts of such a text, as `_SPLIT` has them.
_PARTS = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")

# How a tokenizer file must normalise and split for the cache of parts to hold.
_NORMALIZER = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Bytes of parts and ids that the cache holds, with what Python adds to an entry.
CACHE_BYTES = 96 << 20
_ENTRY_BYTES = 200

END_ID = 0


def _held() -> dict:
    """What one Python worker keeps between tasks. Functions sent by value have no globals that last."""
    return sys.modules.setdefault("_siteferry_worker", types.ModuleType("_siteferry_worker")).__dict__


class _Parts(dict):
    """Part to its ids as little-endian unsigned 32-bit bytes, filled on demand.

    When half of the room is taken, what is held becomes the older half; of that only what is asked for again stays.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.room = CACHE_BYTES
        self.forget()

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.make(part)
        # a very long part would take the room of many
        if len(part) < 100:
            self.held += _ENTRY_BYTES + len(part) + len(found)
            if self.held > self.room // 2:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[part] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older: dict[str, bytes] = {}
        self.held = 0


class TokenIds:
    """Encodes texts to the bytes of their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_part = _splits_into_parts(spec)
        self.marks = [token["content"].lower() for token in spec.get("added_tokens", [])]
        letters = _byte_letters()
        model = self.whole.model

        def merge(part: str) -> bytes:
            shown = part.encode().decode("latin-1").translate(letters)
            return np.array([t.id for t in model.tokenize(shown)], dtype="<u4").tobytes()

        self.parts = _Parts(merge)

    def forget(self) -> None:
        """Empties the cache, as at the end of a task: the next may be of another job."""
        self.parts.forget()

    def __call__(self, text: str) -> bytes:
        if self.by_part and (text.isascii() or _PLAIN.search(text) is None) and not _CONTROL.search(text):
            lower = text.lower()
            if not any(mark in lower for mark in self.marks):
                return b"".join(map(self.parts.__getitem__, _PARTS.findall(lower)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# Python takes some of these for white space and the tokenizer does not.
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def _splits_into_parts(spec: dict) -> bool:
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    steps = [
        (n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in normalizers
    ]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == _NORMALIZER
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"].get("Regex") == _SPLIT
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def token_ids(path: str, cache_bytes: int = CACHE_BYTES) -> TokenIds:
    """The encoder of this worker for the file, loaded once; its cache of parts holds `cache_bytes` from now on."""
    held = _held()
    if ("tokens", path) not in held:
        held["tokens", path] = TokenIds(path)
    held["tokens", path].parts.room = cache_bytes
    return held["tokens", path]


register_pickle_by_value(sys.modules[__name__])
