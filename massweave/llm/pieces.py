"""SentencePiece encoding and decoding: shared-prefix Viterbi over the distinct marked words."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import doc_key

MARK = "▁"
#: Characters of text handled at a time, words and piece pairs a task remembers.
CHUNK, WORDS, PAIRS = 1 << 21, 150_000, 300_000


class Model:
    """Pieces of a model file and the forward pass over its words.

    kind "unigram": the forward score of a prefix is its best sum of piece
    scores. kind "bpe": merging is not a sum of scores; a prefix has exactly
    one last piece, that which merging would also leave standing next to the
    last piece before it. Either way a prefix's state depends on the prefix
    alone, which is what words of a trie share.
    """

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.kind = kind
        self.id, self.score, self.bytes, self.out = {}, {}, [0] * 256, [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.out[i] = bytes([int(p[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.out[i] = p.replace(MARK, " ").encode()
        self.longest = max(map(len, self.id))
        inner = set("".join(p for p in self.id if len(p) > 1))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans words")
        alone = "".join(c for c in "\n\t\r" if c not in inner)     # never part of a longer piece
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0

    # ---- merging, for kind "bpe" ------------------------------------------------
    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge is last to make `piece`; None for one character."""
        if piece not in self.parts:
            p = list(piece)
            while len(p) > 2:
                at = max(range(len(p) - 1), key=lambda i: (self.score.get(p[i] + p[i + 1], -np.inf), -i))
                if p[at] + p[at + 1] not in self.score:
                    break
                p[at:at + 2] = [p[at] + p[at + 1]]
            self.parts[piece] = (p[0], p[1]) if len(p) == 2 else None
        return self.parts[piece]

    def rank(self, piece: str) -> float:
        return -self.score.get(piece, -np.inf) if len(piece) > 1 else -1.0

    def stand(self, a: str, b: str) -> bool:
        """Whether merging leaves `a` and `b` as they are where they meet.

        Undo the later of the two last merges again and again; where the pieces
        at the seam make a piece that would have been merged before the merge
        just undone, the seam does not hold.
        """
        x, y, limit, got = a, b, (np.inf, 0), True
        while True:
            joined = self.score.get(x + y)
            if joined is not None and (-joined, 0.5) < limit:
                got = False
                break
            sx, sy = self.halves(x), self.halves(y)
            if sx is None and sy is None:
                break
            # of equal merges the left one comes first
            if sy is None or (sx is not None and self.rank(x) > self.rank(y)):
                limit, x = (self.rank(x), 0), sx[1]
            else:
                limit, y = (self.rank(y), 1), sy[0]
        if self.n_fits >= PAIRS:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        self.fits.setdefault(a, {})[b] = got
        return got

    # ---- the forward pass over a trie ------------------------------------------
    def merged(self, word: str, last: list, best: list, start: int) -> None:
        """Kind "bpe": the last piece of each prefix longer than `start`."""
        fits, score, longest = self.fits, self.score, self.longest
        for at in range(start + 1, len(word) + 1):
            pick = None
            for j in range(at - 1, max(-1, at - longest - 1), -1):         # one piece fits, most often a short one
                p = word[j:at]
                if p in score:
                    q = last[j]
                    if q is None:
                        pick = p
                        break
                    of = fits.get(q)
                    ok = of.get(p) if of is not None else None
                    if ok or (ok is None and self.stand(q, p)):
                        pick = p
                        break
            last.append(pick or word[at - 1])              # a character without a piece: its bytes

    def summed(self, word: str, last: list, best: list, start: int) -> None:
        """Kind "unigram": the last piece and the score of each prefix longer than `start`."""
        for at in range(start + 1, len(word) + 1):
            pick, top = word[at - 1], best[at - 1] - 1e6
            for j in range(max(0, at - self.longest), at):
                s = self.score.get(word[j:at])
                if s is not None and best[j] + s > top:
                    pick, top = word[j:at], best[j] + s
            last.append(pick)
            best.append(top)

    def learn(self, words: list[str]) -> None:
        """Encode distinct words: in sorted order, so that a word goes on from the prefix it shares with the one before."""
        step = self.merged if self.kind == "bpe" else self.summed
        last, best, before = [None], [0.0], ""
        for w in sorted(words):
            n = len(commonprefix((before, w)))
            del last[n + 1:], best[n + 1:]
            step(w, last, best, n)
            ids, at = [], len(w)
            while at:
                p = last[at]
                i = self.id.get(p)
                if i is None:
                    ids.extend(self.bytes[b] for b in reversed(p.encode()))
                else:
                    ids.append(i)
                at -= len(p)
            ids.reverse()
            self.known[w] = array("i", ids).tobytes()
            before = w

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; the words of all of them are encoded once."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > WORDS:                        # words not met since are forgotten
            self.older, self.known = self.known, {}
        new = []
        for w in {w for s in split for w in s}:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        self.learn(new)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, s)), dtype=np.int32) for s in split]
        for w in [w for w in new if len(w) > 256]:
            del self.known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark put before the first word goes."""
        b = b"".join(map(self.out.__getitem__, ids.tolist()))
        return (b[1:] if b[:1] == b" " else b).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str, kind: str) -> Model:
    return Model(path, kind)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK characters, one text at least."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= CHUNK:
            yield run
            run, n = [], 0
    if run:
        yield run


def listed(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """One row per row of `docs`: doc_id, key (names the text), ids (array of int), back (what decoding gives).

    One narrow pass: a task encodes each distinct marked word once and keeps a
    bounded number of them. Null and empty texts have no ids and decode to the
    empty text. A literal U+2581 comes back as a space. Characters without a
    piece become bytes. Repeated rows encode alike, a null doc_id stays null,
    other columns are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for b in batches:
            at = 0
            for texts in chunks([t or "" for t in b.column("text").to_pylist()]):
                ids = m.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), b.column("key").slice(at, len(texts)),
                     listed(ids),
                     pa.array([m.decode(i) for i in ids], pa.string())], names=["doc_id", "key", "ids", "back"])
                at += len(texts)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("key"), "text")
    return src.mapInArrow(run, "doc_id long, key long, ids array<int>, back string")


def digest(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit) and round_trip of every row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.asarray(x.values, dtype="<i4") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), b.column("back_key")],
                names=["doc_id", "key", "n_pieces", "ids_crc32", "back_key"])

    plain = docs.select("*", F.translate(F.coalesce("text", F.lit("")), MARK, " ").alias("plain"))
    e = encode(plain.select("doc_id", F.col("plain").alias("text")), path, kind)
    e = e.select("doc_id", "key", "ids", doc_key(F.col("back")).alias("back_key"))
    return (e.mapInArrow(run, "doc_id long, key long, n_pieces long, ids_crc32 long, back_key long")
            .select("doc_id", "n_pieces", "ids_crc32", (F.col("key") == F.col("back_key")).alias("round_trip")))


def encode_rows(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, lang, source, ids and n_pieces of every row of `docs`, in one narrow pass."""
    path = path or default_path()
    kept = ["doc_id", "lang", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for b in batches:
            at = 0
            for texts in chunks([t or "" for t in b.column("text").to_pylist()]):
                ids = m.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(at, len(texts)) for c in kept], listed(ids), pa.array([len(i) for i in ids], pa.int64())],
                    names=[*kept, "ids", "n_pieces"])
                at += len(texts)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return src.mapInArrow(run, "doc_id long, lang string, source string, ids array<int>, n_pieces long")
