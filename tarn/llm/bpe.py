"""Byte-level BPE by backtracking over longest matches.

A text is split by the tokenizer's pattern; each part's bytes are read as Latin-1, so that one
character is one byte, and an Aho-Corasick automaton over the vocabulary finds the longest
token that starts at each byte. From there the encoder goes ahead greedily and steps back to
shorter tokens where two neighbours would not stand side by side after the merges. Whether
they would is read off the merges that formed both tokens, and memoised. Each position is
given up at most once, so the time is linear in the part's length, and the tokens are those
that merging by rank gives.

The vocabulary is a rank file (base64 token, rank); it is read on the driver, below 2 MB, and
broadcast. Null and empty texts have no tokens; their digests are those of an empty string.
Rows are independent: repeated rows and null ids get a row each.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_rows, per_worker

MAX_VOCABULARY_BYTES = 32 << 20
#: Parts and pairs that a worker remembers; beyond it starts anew.
PARTS, PAIRS = 300_000, 500_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return raw


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, raw: bytes):
        import ahocorasick

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.matches = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.matches.add_word(t.decode("latin-1"), (len(t), i))
        self.matches.make_automaton()
        self.shorter = {i: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            left = self.shorter[i]
            while left is not None:
                right = ranks.get(t[self.length[left] :])
                if right is not None and left < i and right < i and self._apart(left, right):
                    self.merged[left, right] = i
                    self.parts[i] = (left, right)
                    break
                left = self.shorter[left]

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens before both are complete.

        Undoing the merges of the two, latest first, shows every pair that ever stood at the
        border; a merge of such a pair that ranks below the step that replaced it would have
        happened first.
        """
        merged, parts, bound = self.merged, self.parts, float("inf")
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < bound:
                return False
            undo_left = left in parts and (left > right or right not in parts)
            if not undo_left and right not in parts:
                return True
            if undo_left:
                bound, left = left, parts[left][1]
            else:
                bound, right = right + 1, parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            known = self.beside[left, right] = self._apart(left, right)
        return known

    def encode(self, part: bytes) -> list[int]:
        """Token ids of one part."""
        n = len(part)
        longest: list = [None] * n
        reach = [0] * n
        for end, (size, i) in self.matches.iter(part.decode("latin-1")):
            if size > reach[end + 1 - size]:
                reach[end + 1 - size] = size
                longest[end + 1 - size] = i
        if reach and reach[0] == n:
            return [longest[0]]
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else None
        while at < n:
            end = at + self.length[token]
            if open_[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            elif self.shorter[token] is not None:
                token = self.shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class _Known(dict):
    """part -> (decimal ids, decoded bytes, number of ids), as far as it fits."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, part: str) -> tuple[bytes, bytes, int]:
        ids = self.bpe.encode(part.encode("utf-8", "surrogatepass"))
        found = (" ".join(map(str, ids)).encode(), self.bpe.decode(ids), len(ids))
        if len(part) <= 40:
            if len(self) >= PARTS:
                self.clear()
            self[part] = found
        return found


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids (joined by a blank) and of the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        def build():
            import regex

            return regex.compile(pattern), _Known(Bpe(shared.value))

        find, known = per_worker(("bpe", hashlib.sha256(shared.value).digest(), pattern), build)
        get = known.__getitem__

        def one(doc_id, text):
            got = list(map(get, find.findall(text))) if text else []
            ids, decoded = b" ".join([g[0] for g in got]), b"".join([g[1] for g in got])
            return doc_id, sum([g[2] for g in got]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        import regex

        find, bpe = regex.compile(pattern), per_worker(("bpe only", hashlib.sha256(shared.value).digest()), lambda: Bpe(shared.value))
        return lambda doc_id, text: (doc_id, [i for part in find.findall(text or "") for i in bpe.encode(part.encode("utf-8", "surrogatepass"))])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and text for each row of tokens (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def make():
        bpe = per_worker(("bpe only", hashlib.sha256(shared.value).digest()), lambda: Bpe(shared.value))
        return lambda doc_id, ids: (doc_id, bpe.decode(ids or []).decode("utf-8", "replace"))

    return map_rows(tokens.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, text string")
