"""Token ids of many short strings with a public word-level BPE file, batch by batch.

The file's tokenizer cuts at white space first, so a text's ids are those of its blank-separated chunks in turn;
chunks are kept in a bounded table. Plain Latin chunks are merged by a byte-pair engine that is given the same
vocabulary with the word end as a zero byte (merge ranks are the ids); all others go to the tokenizer itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

#: Fixed values of the tokenizer file: its pre-tokenizer's pattern and special strings' first sign pair.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The printable sign that byte-level BPE files use for each byte: itself where printable, else 256 onward."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, keep: int = 150_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet, ranks = byte_alphabet(), {}
        for token, rank in vocab.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            body = token[: -len(WORD_END)] if ends else token
            ranks[bytes(alphabet[c] for c in body) + (b"\0" if ends else b"")] = rank
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.endswith(b"\0") and len(token) > 1
        self.merge = tiktoken.Encoding("word-end", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile("[\x01-įı-ɏ]*").fullmatch
        self.pieces = regex.compile(PATTERN + r"|\n").findall
        # A line end closes each chunk; it is a word of its own, of one id.
        self.mark = ranks[b"\n\0"]
        self.keep, self.known = keep, {"": b""}

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks to the table."""
        if len(self.known) + len(chunks) > self.keep:
            self.known = {"": b""}
        fast, text = chunks, "\n".join(chunks)
        if not self.plain(text) or "<|" in text:
            fast = [c for c in chunks if self.plain(c) and "<|" not in c]
            done = set(fast)
            for c in chunks:
                if c not in done:
                    self.known[c] = np.array(self.exact.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes()
            text = "\n".join(fast)
        if not fast:
            return
        # All chunks in one go: no word crosses a line end, and chunks hold none.
        words = self.pieces(text.lower() + "\n")
        words.append("")
        ids = np.array(self.merge.encode_ordinary("\0".join(words)), dtype="<u4")
        stops = np.flatnonzero(ids == self.mark)
        if len(stops) != len(fast) or np.count_nonzero(self.ends[ids]) != len(words) - 1:
            raise RuntimeError("word ends went astray")
        data, begins, ends = ids.tobytes(), [0, *(stops[:-1] * 4 + 4).tolist()], (stops * 4).tolist()
        self.known.update((c, data[a:b]) for c, a, b in zip(fast, begins, ends, strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        rows = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set()
        for row in rows:
            new.update(row)
        new.difference_update(self.known)
        if new:
            if len(self.known) + len(new) > self.keep:
                new = {c for row in rows for c in row}
                self.known = {"": b""}
                new.discard("")
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in rows]


@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a file; a Python worker keeps it, with the chunks it knows, for its later tasks."""
    return Encoder(path)
