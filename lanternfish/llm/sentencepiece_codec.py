"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all pieces.  One pass over the text follows its output
links: at each position every piece that ends there relaxes the best score of
the prefix, so the segmentation with the largest total score falls out at the
end (Viterbi).  Characters that no piece covers become byte pieces.

Where no piece of a model goes on past the blank that starts the next word, a
text's best segmentation is that of its words side by side, and the pass over a
word is made once and kept in a bounded table.  For any other model the pass
goes over the whole text.

The segmentation is the one of the largest total score, as in SentencePiece's
unigram models.  The scores of a BPE model are the order of its merges, and
SentencePiece encodes with such a model by merging, so its ids differ from
these; decoding either gives the text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
_KEEP = 200_000
_STEPS = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may be matched (text, score, id), byte pieces, and all ids' bytes.

    ``by_words`` tells that no piece goes on past the start of a word.
    """

    pieces: list[tuple[str, float, int]]
    byte_ids: list[int]
    spelled: list[bytes]
    by_words: bool


def load(model_path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    pieces, byte_ids, spelled = [], [0] * 256, []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            spelled.append(bytes([int(text[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelled.append(b"")
        else:
            pieces.append((text, sp.get_score(i), i))
            spelled.append(text.replace(BLANK, " ").encode())
    return Vocabulary(pieces, byte_ids, spelled, not any(BLANK in text.lstrip(BLANK) for text, _, _ in pieces))


class Automaton:
    """Goto, failure and output links over the pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float, int] | None] = [None]
        for text, score, number in pieces:
            state = 0
            for c in text:
                state = self.goto[state].setdefault(c, len(self.goto))
                if state == len(self.goto):
                    self.goto.append({})
                    self.ends.append(None)
            self.ends[state] = (len(text), score, number)
        self.fail = [0] * len(self.goto)
        #: The nearest state on the failure path where a piece ends.
        self.output = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:
            for c, after in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[after] = self.goto[back].get(c, 0)
                queue.append(after)
            back = self.fail[state]
            self.output[state] = back if self.ends[back] else self.output[back]
        #: Steps taken lately, failure links followed.
        self.steps: dict[tuple[int, str], int] = {}
        #: The pieces that end in each state: its output links followed once for all.
        self.found = [tuple(self._follow(s)) for s in range(len(self.goto))]

    def _follow(self, state: int):
        here = state if self.ends[state] else self.output[state]
        while here:
            yield self.ends[here]
            here = self.output[here]

    def best(self, text: str, unknown: float) -> list[tuple[int, int, int]]:
        """(start, end, piece id or -1) of the best segmentation; of equal scores the longest last piece wins.

        A character that is no piece costs ``unknown``.
        """
        n, goto, fail, found = len(text), self.goto, self.fail, self.found
        score = [0.0] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        state, steps = 0, self.steps
        for i, c in enumerate(text):
            after = steps.get((state, c))
            if after is None:
                here = state
                while here and c not in goto[here]:
                    here = fail[here]
                after = goto[here].get(c, 0)
                if len(steps) >= _STEPS:
                    steps.clear()
                steps[state, c] = after
            state = after
            end = i + 1
            top, what = score[i] + unknown, (1, -1)
            for length, gain, number in found[state]:
                value = score[end - length] + gain
                if value > top:
                    top, what = value, (length, number)
            score[end], back[end] = top, what
        out, at = [], n
        while at:
            length, number = back[at]
            out.append((at - length, at, number))
            at -= length
        return out[::-1]


class Codec:
    """Encode texts to ids and back.  A blank is put before every text, as in training.

    A word is a run of blanks and of characters that pieces join, the blanks first.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = Automaton(vocabulary.pieces)
        self.unknown = min((s for _, s, _ in vocabulary.pieces), default=0.0) - 10.0
        # Pieces join these characters only; any other is a unit of its own, such as the end of a line.
        joined = {c for text, _, _ in vocabulary.pieces if len(text) > 1 for c in text} - {BLANK}
        some = "".join(map(re.escape, sorted(joined)))
        self._words = re.compile(f"{BLANK}*[{some}]+|{BLANK}+|[^{BLANK}]" if some else f"{BLANK}+|[^{BLANK}]", re.DOTALL)
        #: Words seen lately, in two generations of bounded size.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = array("I")
        for start, end, number in self.automaton.best(word, self.unknown):
            if number >= 0:
                ids.append(number)
            else:
                ids.extend(self.vocabulary.byte_ids[b] for b in word[start:end].encode())
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``; an empty text has none."""
        if not text:
            return np.zeros(0, np.uint32)
        whole = BLANK + text.replace(" ", BLANK)
        if not self.vocabulary.by_words:
            return np.frombuffer(self._word(whole), dtype=np.uint32)
        words = self._words.findall(whole)
        found = list(map(self._known.get, words))
        if None in found:
            for i, (word, ids) in enumerate(zip(words, found)):
                if ids is None:
                    found[i] = self._learned(word)
        return np.frombuffer(b"".join(found), dtype=np.uint32)

    def _learned(self, word: str) -> bytes:
        """The ids of a word, which is kept unless it is long."""
        ids = self._known.get(word) or self._older.get(word) or self._word(word)
        if len(word) < 64:
            if len(self._known) >= _KEEP:
                self._known, self._older = {}, self._known
            self._known[word] = ids
        return ids

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        spelled = self.vocabulary.spelled
        return b"".join(map(spelled.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")[1:]


def _encode(batches, vocabulary):
    codec = Codec(vocabulary)
    for batch in batches:
        docs, ids, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc_id)
            ids.append(codec.encode(text or "").astype(np.int32))
            held += len(ids[-1])
            if held > 1 << 20:
                yield _rows(docs, ids)
                docs, ids, held = [], [], 0
        yield _rows(docs, ids)


def _rows(docs, ids):
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])


def _decode(batches, vocabulary):
    codec = Codec(vocabulary)
    for batch in batches:
        texts = [codec.decode(x) if x else "" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>.

    Null and empty texts have no ids.  Repeated rows and null ids each give
    their row.  Whole texts are encoded, however long.  An empty table gives an
    empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _encode(it, sent.value), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text.

    Null and empty lists give an empty text, and ids in a row may spell any
    length of text.  Repeated rows and null ids each give their row; equal
    lists give equal texts.  Bytes that are no UTF-8 become replacement
    characters.  An id outside the model, or a null one in a list, raises an
    error.  An empty table gives an empty result; other columns are ignored.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(load(model_path))
    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(lambda it: _decode(it, sent.value), "doc_id bigint, text string")


def _digest(batches, vocabulary):
    codec = Codec(vocabulary)
    for batch in batches:
        counts, sums, same = [], [], []
        for text in batch.column(1).to_pylist():
            ids = codec.encode(text or "")
            counts.append(len(ids))
            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            same.append(codec.decode(ids) == (text or "").replace(BLANK, " ") if text else True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode without sending ids on: doc_id, n_ids, ids_crc32, round_trip.

    ``round_trip`` tells whether decoding gives the text again (the model's
    blank sign itself comes back as a blank).  Rows as for ``encode``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _digest(it, sent.value), "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
