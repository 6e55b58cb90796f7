"""Language-model scores by subword lattices.

A word (after A-Z are lower-cased) is a path through all its segmentations into pieces of an
existing vocabulary; its probability is the sum over the paths of the product of the pieces'
probabilities, by a forward recursion in log space. A text is its words and one end; its score
is the log10 of the product, which is the marginal over all segmentations of the whole text.
Pieces' probabilities start from the vocabulary's own scores and are re-estimated once by the
expected counts of all training words (one EM step). A character that is no piece can be spelled
in bytes, each of which has a probability of its own: pieces, bytes and the end sum to 1, so a
score is the log probability of one distribution over texts.

Beside the score, base_score is the add-one unigram score of the words themselves.

The corpus is read twice. First every word is counted, in each worker before the shuffle;
the counts, and then each distinct word's marginal, are written to the shared folder. Then each
text is scored: the most frequent words, so many of each length as FREQUENT says, which bounds their
bytes, are known to every worker; all other words join the marginals by a shuffle, so any vocabulary
is scored in full.

Null and empty texts are one end. Rows are independent: repeated rows and null ids get a row
each; a null id belongs to the training rows. Without training rows N and V are 0, and the base
is log10(1 / 1) = 0 for each token. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import held_out, keep, map_rows, per_worker, small_batches

#: (fewest bytes, most bytes, words): what every worker knows is at most 16 MB.
FREQUENT = ((0, 64, 120_000), (65, 8192, 1000))
#: Distinct words that a worker counts before it passes them on.
HELD = 400_000
#: Characters of a word whose matches are held at once.
PART = 4096
SMOOTH = 0.1
_BOUNDARY = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) from a SentencePiece file.

    Files of BPE kind have minus the rank as score; their probabilities start as 1 / (rank + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in ids])
    weights = np.exp(scores) if (scores > -50).all() else 1 / (10 - scores)
    return list(zip((sp.id_to_piece(i) for i in ids), np.log(weights / weights.sum()).tolist()))


def with_bytes(pieces: list[tuple[str, float]]) -> tuple[list[tuple[str, float]], list[float]]:
    """(pieces, the 256 bytes' scores), together of probability 1; a byte starts as the least likely piece."""
    least = min((score for _, score in pieces), default=0.0)
    total = math.log(sum(math.exp(score - least) for _, score in pieces) + 256) + least
    return [(p, score - total) for p, score in pieces], [least - total] * 256


class Lattice:
    """Forward and backward sums over segmentations."""

    def __init__(self, pieces: list[tuple[str, float]], byte_scores: list[float]):
        import ahocorasick

        self.bytes = byte_scores
        self.find = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        for i, (p, score) in enumerate(pieces):
            self.find.add_word(p, (len(p), score, i))
        self.find.make_automaton()

    def _spelled(self, character: str) -> float:
        return sum(self.bytes[b] for b in character.encode("utf-8", "surrogatepass"))

    def _forward(self, word: str) -> array:
        """Log sum over the segmentations of each prefix."""
        log1p, exp = math.log1p, math.exp
        out = array("d", bytes(8 * (len(word) + 1)))
        at, acc, single = 1, -math.inf, self.single

        def unknown(i: int) -> float:
            return out[i] + self._spelled(word[i])

        for end, (size, score, _) in self.find.iter(word):
            while at < end + 1:
                if word[at - 1] not in single:
                    u = unknown(at - 1)
                    acc = u if acc == -math.inf else max(u, acc) + log1p(exp(-abs(u - acc)))
                out[at] = acc
                at, acc = at + 1, -math.inf
            s = out[at - size] + score
            if acc == -math.inf:
                acc = s
            elif s > acc:
                acc = s + log1p(exp(acc - s))
            else:
                acc += log1p(exp(s - acc))
        while at <= len(word):
            if word[at - 1] not in single:
                u = unknown(at - 1)
                acc = u if acc == -math.inf else max(u, acc) + log1p(exp(-abs(u - acc)))
            out[at] = acc
            at, acc = at + 1, -math.inf
        return out

    def log10(self, word: str) -> float:
        """log10 of the word's marginal probability; a boundary sign stands before it."""
        word = _BOUNDARY + word
        return self._forward(word)[-1] / math.log(10)

    def expect(self, word: str, times: float, counts: np.ndarray, byte_counts: np.ndarray) -> None:
        """Adds the expected uses of each piece and byte in `times` such words."""
        ahead = self._forward(word)
        back = array("d", [-math.inf]) * len(word)
        back.append(0.0)
        total = ahead[-1]
        matches, start = [], len(word)
        k = -1
        for at in range(len(word), 0, -1):
            if at - 1 < start:  # the matches that end in the part before
                end, start = start, max(0, start - PART)
                matches = [m for m in self.find.iter(word, max(0, start - self.longest + 1), end) if m[0] >= start]
                k = len(matches) - 1
            b = back[at]
            if word[at - 1] not in self.single:
                u = b + self._spelled(word[at - 1])
                for x in word[at - 1].encode("utf-8", "surrogatepass"):
                    byte_counts[x] += times * math.exp(min(0.0, ahead[at - 1] + u - total))
                back[at - 1] = u if back[at - 1] == -math.inf else float(np.logaddexp(back[at - 1], u))
            while k >= 0 and matches[k][0] == at - 1:
                size, score, i = matches[k][1]
                s = score + b
                counts[i] += times * math.exp(min(0.0, ahead[at - size] + s - total))
                old = back[at - size]
                back[at - size] = s if old == -math.inf else max(s, old) + math.log1p(math.exp(-abs(s - old)))
                k -= 1


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, held: str) -> DataFrame:
    """word (binary), c (in rows that are not held out), seen (in all rows): one row for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            keys = list(all_)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([own[k] for k in keys], pa.int64()), pa.array(list(all_.values()), pa.int64())], names=["word", "c", "seen"])

        own, all_ = Counter(), Counter()
        for batch in batches:
            for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = tokens(text)
                all_.update(got)
                if not out:
                    own.update(got)
                if len(all_) >= HELD:
                    yield rows()
                    own.clear()
                    all_.clear()
        if all_:
            yield rows()

    parts = docs.select("text", held).mapInArrow(run, "word binary, c long, seen long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit(words: DataFrame, pieces: list[tuple[str, float]], byte_scores: list[float], ends: int) -> tuple[list[tuple[str, float]], list[float], float]:
    """(pieces, bytes' scores, log10 probability of the end), with new log probabilities, after one EM step over words (word, c)."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, byte_scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared.value)
        n = len(shared.value[0])
        counts = np.zeros(n + 256)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(_BOUNDARY + word.decode("utf-8", "surrogatepass"), c, counts[:n], counts[n:])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.float64())], names=["piece", "n"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(pieces) + 256, SMOOTH)
    counts[sums["piece"].to_numpy()] += sums["n"].to_numpy()
    total = counts.sum() + ends + SMOOTH
    scores = np.log(counts / total).tolist()
    return list(zip((p for p, _ in pieces), scores)), scores[len(pieces) :], math.log10((ends + SMOOTH) / total)


def _lattice(model: tuple[list[tuple[str, float]], list[float]]) -> Lattice:
    """The worker's lattice of a model."""
    return per_worker(("lattice", hash((tuple(model[0]), tuple(model[1])))), lambda: Lattice(*model))


def score(docs: DataFrame, pieces: list[tuple[str, float]], modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text", held_out(modulus, remainder).alias("held_out"))
    ends = rows.where(~F.col("held_out")).count()
    words = keep(count_words(rows, "held_out"))
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train, kinds = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    less = math.log10(train + kinds + 1)
    pieces, byte_scores, end = fit(words, *with_bytes(pieces), ends)
    shared = context.broadcast((pieces, byte_scores))

    def make():
        lattice = _lattice(shared.value)
        return lambda word, c, seen: (word, c, seen, lattice.log10(word.decode("utf-8", "surrogatepass")))

    words = keep(map_rows(words, make, "word binary, c long, seen long, piece_score double"))
    size = F.octet_length("word")
    top = [words.where(size.between(low, high)).orderBy(F.desc("seen"), "word").limit(n) for low, high, n in FREQUENT]
    known = pa.concat_tables([t.select("word", "c", "piece_score").toArrow() for t in top])
    frequent = context.broadcast((known["word"].to_pylist(), known["c"].to_numpy(), known["piece_score"].to_numpy()))
    schema = "key long, doc_id long, held_out boolean, word binary, times long, n long, known long, base double, piece_sum double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build():
            names, c, lattice = frequent.value
            return dict(zip(names, zip(np.log10(c + 1.0).tolist(), lattice.tolist(), (c > 0).tolist())))

        table = per_worker(("frequent words", id(frequent), hash(frequent.value[1].tobytes()), hash(frequent.value[2].tobytes())), build)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["key", "doc_id", "held_out", "word", "times", "n", "known", "base", "piece_sum"]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key, doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                seen = Counter(tokens(text))
                n, base, pieces_, here = 1, math.log10(ends + 1), end, int(ends > 0)
                rare = []
                for w, k in seen.items():
                    n += k
                    got = table.get(w)
                    if got is None:
                        rare.append((w, k))
                    else:
                        base += k * got[0]
                        pieces_ += k * got[1]
                        here += k * got[2]
                # a key that is no word: it holds a blank
                for c, x in zip(out, (key, doc_id, held, b" %d" % key, 0, n, here, base, pieces_)):
                    c.append(x)
                m = len(rare)
                out[0] += [key] * m
                out[1] += [None] * m
                out[2] += [None] * m
                out[3] += [w for w, _ in rare]
                out[4] += [k for _, k in rare]
                for c in out[5:]:
                    c += [None] * m
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                    out = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    parts = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "held_out").mapInArrow(run, schema)
    both = parts.join(words.select("word", "c", "piece_score"), "word", "left").select(
        "key",
        "doc_id",
        "held_out",
        "n",
        F.coalesce("known", F.when(F.col("c") > 0, F.col("times"))).alias("known"),
        F.coalesce("base", F.col("times") * F.log10(F.col("c") + 1)).alias("base"),
        F.coalesce("piece_sum", F.col("times") * F.col("piece_score")).alias("piece_sum"),
    )
    sums = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("piece_sum").alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(less)).alias("base_score"), "score")
