"""Reading a public byte-level BPE file, and fast encoding with it inside tasks."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass
from pathlib import Path

import regex
import tiktoken

#: Fixed value: how byte-level BPE cuts text into words, with the Unicode property for white space spelled out.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Runs of white space from this length on are cut out before tiktoken, whose matcher fails on very long ones.
LONG = 10_000
LONG_SPACE = regex.compile(r"\p{White_Space}{%d,}" % LONG)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class ByteBpe:
    """Token bytes by id, merges as (left, right, merged) ids in order of rank, and the strings of added tokens."""

    labels: list[bytes]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]

    @functools.cached_property
    def added_pattern(self):
        strings = sorted(self.added, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, strings))) if strings else None

    @functools.cached_property
    def library(self) -> tiktoken.Encoding:
        """The same vocabulary in tiktoken, whose ranks are the ids because ids grow with the merges."""
        ids = [merged for _, _, merged in self.merges]
        if ids != sorted(ids):
            raise ValueError("the ids do not follow the order of the merges")
        special = set(self.added.values())
        ranks = {label: k for k, label in enumerate(self.labels) if k not in special}
        return tiktoken.Encoding(
            "file", pat_str=WORD_PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"),
            mergeable_ranks=ranks, special_tokens=dict(self.added))

    def _cut(self, text: str, encode) -> list[int]:
        """``encode`` around long runs of white space. Such a run is one word, all but its last character where more
        text follows; that character begins the next word, if a space, or is a word."""
        out, done = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += encode(text[done: run.start()])
            out += self.library._encode_single_piece(text[run.start(): end])
            done = end
        return out + encode(text[done:])

    def encode(self, text: str) -> list[int]:
        """Ids as the tokenizers library gives them: strings of added tokens in the text are those tokens."""
        def plain(part):
            return self._cut(part, self.library.encode_ordinary)

        if not LONG_SPACE.search(text):
            return self.library.encode(text, allowed_special="all", disallowed_special=())
        if not self.added:
            return plain(text)
        out, done = [], 0
        for found in self.added_pattern.finditer(text):
            out += [*plain(text[done: found.start()]), self.added[found[0]]]
            done = found.end()
        return out + plain(text[done:])

    def encode_plain(self, text: str) -> list[int]:
        """Ids of the text where the strings of added tokens are ordinary text."""
        return self._cut(text, self.library.encode_ordinary)


def read(path: str) -> str:
    """The file's content, to be handed to tasks; its size does not depend on the data."""
    return Path(path).read_text(encoding="utf-8")


@functools.lru_cache(maxsize=2)
def parse(content: str) -> ByteBpe:
    spec = json.loads(content)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or spec.get("normalizer") or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE files are read")
    alphabet = byte_alphabet()
    vocab = model["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, k in vocab.items():
        labels[k] = bytes(alphabet[c] for c in token)
    for token, k in added.items():
        labels[k] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return ByteBpe(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], added)
