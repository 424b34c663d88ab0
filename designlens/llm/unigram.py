"""Unigram segmentation with a public SentencePiece vocabulary: token counts, encoding, decoding.

The vocabulary, its scores and its byte pieces come from a SentencePiece model
file and are read as a unigram model. Texts are marked as SentencePiece does
(a dummy space in front, spaces shown as U+2581) and cut into marked words: a
run of marks, then other characters. A line feed is a word of its own where it
has no piece. No piece crosses such a border, so the best segmentation of a
text is that of its words, and every distinct word is solved once.

Tie rules of the tokenizer, for each end position: pieces are tried from the
earliest start to the latest, a candidate replaces the present one only if its
score is strictly larger, path scores are kept as 32-bit floats, and a
character without a piece of its own is tried last, at the unknown score. An
unknown character becomes the byte pieces of its UTF-8 form.

``token_counts`` finds the pieces with an Aho-Corasick automaton and carries the
best score and its piece count, no paths. ``encode`` sorts distinct words and
walks them as the paths of a trie, depth first: the forward scores of a word's
prefix are those of the word before it as far as the two agree.

Defined results: null and empty texts have no pieces. A U+2581 in a text is
decoded as a space; every other text is decoded exactly. Rows are judged one by
one, so repeated rows and null keys get results of their own; an empty table
gives an empty one. Words and texts of any length are solved whole, a long text
in a slice of its own. Only ``doc_id`` and ``text`` (or ``ids``) are read, so
further columns and their names have no effect.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import Memo, Words, arrow_map, gather, run_sums, slices

MARK = "▁"
#: Bytes of solved words that a worker remembers.
CACHE = 32 << 20
#: Below the least score of a piece, for a character without one.
UNKNOWN_PENALTY = 10.0
MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Integers up to this size are exact as 32-bit floats.
EXACT = float(1 << 24)


def as_float32(x: float) -> float:
    return x if -EXACT <= x <= EXACT and x == int(x) else float(np.float32(x))


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.names = [p.piece for p in model.pieces]
        kind = pb.ModelProto.SentencePiece
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = float(np.float32(np.float32(min(s for _, s in self.pieces.values())) - np.float32(UNKNOWN_PENALTY)))
        self.trie: dict = {}
        for piece, found in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.ids, self.counts = Memo(CACHE), Memo(CACHE)
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, (_, score) in self.pieces.items():
                self._automaton.add_word(piece, (len(piece), score))
            self._automaton.make_automaton()
        return self._automaton

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a marked word."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, single, done = [0] * (n + 1), [False] * (n + 1), 0

        def close(upto: int) -> None:
            # a character without a piece of its own is tried after all pieces that end with it
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    score = as_float32(self.unknown + best[done - 1])
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        pieces[done] = pieces[done - 1] + len(word[done - 1].encode())

        for last, (length, score) in self.automaton().iter(word):
            end = last + 1
            if end - 1 > done:
                close(end - 1)
            score = as_float32(score + best[end - length])
            if best[end] is None or score > best[end]:
                best[end] = score
                pieces[end] = pieces[end - length] + 1
            if length == 1:
                single[end] = True
        close(n)
        return pieces[n]

    def segment(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Piece ids of marked words, shared prefixes once."""
        best: list[float] = [0.0]
        start, piece_id = [0], [-1]
        # for each prefix, the starts from which a piece may go on, with their places in the trie of pieces
        alive: list[list[tuple[int, dict]]] = [[(0, self.trie)]]
        before, out = "", {}
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], start[same + 1 :], piece_id[same + 1 :], alive[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                c, score, at, which, piece, going = word[end - 1], None, 0, -1, None, []
                for s, node in alive[end - 1]:
                    piece = None
                    node = node.get(c)
                    if node is None:
                        continue
                    going.append((s, node))
                    piece = node.get("")
                    if piece is not None:
                        candidate = as_float32(piece[1] + best[s])
                        if score is None or candidate > score:
                            score, at, which = candidate, s, piece[0]
                if piece is None:  # the last start is the character's own
                    candidate = as_float32(self.unknown + best[end - 1])
                    if score is None or candidate > score:
                        score, at, which = candidate, end - 1, -1
                going.append((end, self.trie))
                best.append(score)
                start.append(at)
                piece_id.append(which)
                alive.append(going)
            ids: list[int] = []
            end = len(word)
            while end:
                if piece_id[end] < 0:
                    ids.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode()))
                else:
                    ids.append(piece_id[end])
                end = start[end]
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def units(self, word: str) -> list[str]:
        """A marked word without the line feeds in it, and those."""
        if "\n" not in word or "\n" in self.pieces:
            return [word]
        return [u for u in re.split("(\n)", word) if u]

    def solve_ids(self, words: list[str]) -> list[bytes]:
        """Ids of marked words, as bytes of unsigned 32-bit integers."""
        solved = self.segment(list({u for w in words for u in self.units(w)}))
        return [array("I", solved[w] if w in solved else [i for u in self.units(w) for i in solved[u]]).tobytes() for w in words]

    def solve_counts(self, words: list[str]) -> list[int]:
        return [sum(map(self.count, self.units(w))) for w in words]

    def piece_bytes(self) -> np.ndarray:
        """The bytes that each piece stands for."""
        return np.array([self.names[i].encode() if i not in self.bytes_of else bytes([self.bytes_of[i]]) for i in range(len(self.names))], object)

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            out.append(self.names[i])
        out.append(raw.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")[1:]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def marked_words(texts: pa.Array) -> Words:
    """The marked words of each text."""
    texts = texts.fill_null("")
    # texts in which a space doesn't stand alone between two other characters are cut one by one
    odd = pc.match_substring_regex(texts, f"  |^ | $|^$|{MARK}").to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    flat = pc.binary_join_element_wise(MARK, parts.flatten(), "")
    lists = pa.ListArray.from_arrays(pc.subtract(parts.offsets, parts.offsets[0]), flat)
    if odd.any():
        cut = [MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        place = np.arange(len(texts))
        place[odd] = len(texts) + np.arange(len(cut))
        lists = pa.concat_arrays([lists, pa.array(cut, pa.list_(pa.string()))]).take(pa.array(place))
    return Words.pieces(lists)


def encode_slice(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end, and the bounds of each text's run."""
    w = marked_words(texts)
    runs = vocab.ids.solve(w, vocab.solve_ids)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
    flat = np.frombuffer(b"".join(runs), np.int32)
    ids = gather(flat, np.cumsum(lengths) - lengths, lengths, w.codes)
    return ids, np.concatenate(([0], np.cumsum(run_sums(lengths[w.codes], w.bounds))))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row of ``docs``."""

    def run(batches):
        vocab = vocabulary(model)
        for batch in slices(batches, "text"):
            ids, bounds = encode_slice(vocab, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids)."""

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoded_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and whether decoding gives the text back."""

    def run(batches):
        vocab = vocabulary(model)
        pieces = vocab.piece_bytes()
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("")
            ids, bounds = encode_slice(vocab, texts)
            wide = ids.astype("<u4")
            crc, same = [], []
            for text, a, b in zip(texts.to_pylist(), bounds[:-1], bounds[1:]):
                crc.append(zlib.crc32(wide[a:b].tobytes()))
                # the bytes of the pieces, in order, are what decode() turns into text
                same.append(b"".join(pieces.take(ids[a:b]).tolist()).decode(errors="replace").replace(MARK, " ")[1:] == text)
            cols = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_marked_words of each row of ``docs``, without paths or ids."""

    def run(batches):
        vocab = vocabulary(model)
        for batch in slices(batches, "text"):
            w = marked_words(batch.column("text"))
            counts = np.array(vocab.counts.solve(w, vocab.solve_counts), np.int64)
            cols = [batch.column("doc_id"), pa.array(run_sums(counts[w.codes], w.bounds)), pa.array(w.counts().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_marked_words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, n_marked_words long")
