"""SentencePiece byte-pair models: encoding by a table of each prefix's last piece, and decoding.

Merging greedily leaves, for every prefix of a string, one possible last piece: the piece that ends
there and that merging would also leave apart from the last piece of the prefix before it.  One pass
of an automaton over all pieces therefore fills a table with one piece for each prefix, and the ids
are read from its end backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.batches import small_batches

SPACE = "▁"
#: Entries that a worker remembers: of words in two generations of this size, the older of which is
#: forgotten when the younger is full; of pairs until there are as many.  Results never depend on
#: them.
REMEMBERED = 1 << 18
#: Longer stretches without a space are not remembered.
LONGEST_REMEMBERED = 48
_UNKNOWN = -1


class PieceModel:
    """The vocabulary of one model file.  Pieces that merge are those of normal type; characters
    without a piece become byte pieces.  Only models as the public ones are taken: merges by score,
    byte fallback, no normalisation, a dummy space in front, no piece with a space inside."""

    def __init__(self, model: bytes):
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text, self.score, self.id_of, self.byte_id = [], [], {}, {}
        for i in range(vocabulary.get_piece_size()):
            piece = vocabulary.id_to_piece(i)
            self.text.append(piece)
            self.score.append(vocabulary.get_score(i))
            if vocabulary.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i)):
                self.id_of[piece] = i
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a model with byte fallback and spaces only in front is needed")
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.length = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        # Merges never cross from a word to the next space, nor a line end that no longer piece has.
        lines = "" if any("\n" in p for p in self.id_of if len(p) > 1) else "\n"
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + (r"|\n" * bool(lines)))
        self._apart: dict[int, bool] = {}
        self._words: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._other: dict[str, str] = {}

    def _merged(self, text: str) -> list[str]:
        """Greedy merging by score, leftmost first; for strings of two pieces at most."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces as they are when they meet.  ``left`` may be
        unknown or missing (_UNKNOWN): then only ``right`` must come out whole."""
        first = [] if left == _UNKNOWN else [self.text[left]]
        whole = [*first, self.text[right]]
        return self._merged("".join(whole)) == whole

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix of ``text`` the id of its last piece; a character without a piece is
        _UNKNOWN."""
        table = [_UNKNOWN] * (len(text) + 1)
        length, remembered, size = self.length, self._apart, len(self.text)
        done = -1
        for end, piece in self.automaton.iter(text):
            if end == done:
                continue
            left = table[end + 1 - length[piece]]
            pair = left * size + piece
            apart = remembered.get(pair)
            if apart is None:
                apart = remembered[pair] = self.stays_apart(left, piece)
            if apart:
                table[end + 1] = piece
                done = end
        if len(remembered) > REMEMBERED:
            remembered.clear()
        return table

    def encode_stretch(self, text: str) -> list[int]:
        table, ids, end = self.last_pieces(text), [], len(text)
        while end:
            piece = table[end]
            if piece == _UNKNOWN:
                end -= 1
                ids += [self.byte_id[b] for b in reversed(text[end].encode())]
            else:
                ids.append(piece)
                end -= self.length[piece]
        ids.reverse()
        return ids

    def _stretches(self, text: str) -> list[str]:
        return self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self._stretches(text) for i in self.encode_stretch(part)]

    def _joined(self, ids: list[int]) -> str:
        """The pieces' text; runs of byte pieces are UTF-8, a damaged byte is U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids)).replace(SPACE, " ")
        out, run = [], b""
        for i in ids:
            if i in self.byte_of:
                run += self.byte_of[i]
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = b""
            out.append(self.text[i])
        return "".join(out).replace(SPACE, " ") + run.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        return self._joined(ids).removeprefix(" ")

    def _learn(self, part: str) -> str:
        """Ids of a stretch, joined by commas.  Only those that decode to the stretch again are
        remembered; what others decode to is put aside for :meth:`round_trip`."""
        known = self._older.get(part)
        if known is None:
            ids = self.encode_stretch(part)
            known = ",".join(map(str, ids))
            decoded = self._joined(ids)
            if len(part) > LONGEST_REMEMBERED or decoded != part.replace(SPACE, " "):
                self._other[part] = decoded
                return known
        self._words[part] = known
        return known

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and what they decode to.

        A character's bytes lie in one stretch, so stretches decode one by one, those that are
        remembered to themselves.
        """
        if len(self._words) >= REMEMBERED:
            self._older, self._words = self._words, {}
        get, learn = self._words.get, self._learn
        other = self._other
        other.clear()
        parts = self._stretches(text)
        joined = ",".join([get(part) or learn(part) for part in parts])
        texts = [other.get(part, part) for part in parts] if other else parts
        decoded = "".join(texts).replace(SPACE, " ").removeprefix(" ")
        return joined.count(",") + bool(joined), joined, decoded


@lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    return PieceModel(model)


def read_model(path: str) -> bytes:
    """The model file, read on the driver; it goes to the executors with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every row of ``docs`` (doc_id, text)."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_model(model)
        for batch in batches:
            ids = [table.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids,
                                "decoded": [table.decode(i) for i in ids]})

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(
        encoded, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text).

    Whole texts; a null text counts as empty, and an empty text has no ids.  Repeated rows and rows
    without doc_id are returned as they come, an empty table gives an empty result, other columns
    are not looked at.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_model(model)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                count, ids, decoded = table.round_trip(text or "")
                rows.append((count, hashlib.sha256(ids.encode()).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest()))
            found = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            found.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(), True)
            yield found

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
