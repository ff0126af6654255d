"""Packing documents into training windows by the sum-of-squares rule.

A task packs the documents of its own input partition, so nothing is shuffled and a hot source or a
lost executor changes nothing for the others. Documents longer than a window fill whole windows; what
is left of each goes, in order of arrival, to the fill level that makes the sum of squared counts of
partially filled windows smallest. The counts live in one level array per task.

At the end of a task, or when `max_open` windows are open, the open windows are closed: the emptiest
are cut up to fill the fullest, so that at most one window per task keeps padding.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches, worker_state

WINDOW, END_ID = 4096, 2
#: Words that are one pre-token each: letters whose lower case is one letter again.
LETTERS = "a-zA-ZÀ-ÖØ-öø-į"
CACHED_WORDS = 1_000_000
PIECES = (
    "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, tokens binary"
)


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


class WordEncoder:
    """Ids of whole texts, made from the ids of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in order, and a word seen before costs one look-up. Ids are kept as little-endian 32-bit bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.plain = re.compile(f"([{LETTERS}]+)([.,;:!?#$%&*|]*)")
        self.known: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, words: set[bytes]) -> None:
        """Look up new words: letters apart from their trailing marks, all else one by one.

        A word of ASCII letters is its own normal form and one pre-token, so the model alone gives its
        ids; other letters are encoded in bulk and told apart by the tokens that end a word.
        """
        split, ascii_cores, others = [], set(), set()
        for word in words:
            text = word.decode()
            if m := self.plain.fullmatch(text):
                core = m[1].lower()
                split.append((word, core, m[2]))
                (ascii_cores if core.isascii() else others).add(core)
            else:
                self.known[word] = self.ids(text)
        cores = {c: known for c in ascii_cores | others if (known := self.known.get(c.encode())) is not None}
        model = self.tokenizer.model
        for core in ascii_cores - cores.keys():
            cores[core] = little([t.id for t in model.tokenize(core)])
        new = list(others - cores.keys())
        for at in range(0, len(new), 500):
            some = new[at : at + 500]
            encoded = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            raw, starts = ids.tobytes(), [0, *ends.tolist()]
            if len(ends) == len(some):
                cores.update((c, raw[a:b]) for c, a, b in zip(some, starts, starts[1:]))
            else:
                cores.update((c, self.ids(c)) for c in some)
        marks = {m: self.ids(m) if m else b"" for m in {m for _, _, m in split}}
        self.known.update((word, cores[core] + marks[tail]) for word, core, tail in split)
        self.known.update((c.encode(), ids) for c, ids in cores.items())

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids per text; a missing text has none."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = [(t or "").encode().split() for t in texts]
        parts = [list(map(self.known.get, w)) for w in words]
        gaps = [[i for i, p in enumerate(own) if p is None] if None in own else [] for own in parts]
        self.learn({w[i] for w, own in zip(words, gaps) for i in own})
        for w, own, missing in zip(words, parts, gaps):
            for i in missing:
                own[i] = self.known[w[i]]
            yield b"".join(own)


class LevelArray:
    """Open windows of one task by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int) -> None:
        self.window, self.open = window, 0
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level h for which moving one window from h to h + size makes the sum of squared counts
        smallest; 0 opens a window, the fullest wins ties. Full and empty windows don't count."""
        top = self.window - size
        counts = self.count[: top + 1]
        gain = 2 * (self.count[size : self.window + 1] - counts) + 2
        gain[0] = 2 * self.count[size] + 1
        gain[top] -= 2 * self.count[self.window] + 1
        if top == 0:
            return 0
        allowed = counts > 0
        allowed[0] = True
        gain[~allowed] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece (…, size) into a window; the window if that filled it."""
        size = piece[-1]
        level = self.level_for(size)
        if level:
            window = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.window:
            return window
        self.at[level + size].append(window)
        self.count[level + size] += 1
        self.open += 1
        return None

    def close(self) -> Iterator[list]:
        """Empty the array: cut the emptiest windows to fill the fullest. All but one come out full."""
        windows = [[level, w] for level in range(self.window, 0, -1) for w in self.at[level]]
        first, last = 0, len(windows) - 1
        while first <= last:
            fill, window = windows[first]
            while fill < self.window and last > first:
                donor = windows[last]
                doc, start, size = donor[1].pop()
                take = min(size, self.window - fill)
                if take < size:
                    donor[1].append((doc, start, size - take))
                window.append((doc, start + size - take, take))
                fill += take
                donor[0] -= take
                if not donor[1]:
                    last -= 1
            yield window
            first += 1
        self.__init__(self.window)


def _packer(path: str, window: int, end_id: int, max_open: int, id_column: str) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_state(f"words {path}", lambda: WordEncoder(path))
        end, levels = np.uint32(end_id).astype("<u4").tobytes(), LevelArray(window)
        sequence = TaskContext.get().partitionId() << 33
        out: list[list] = [[] for _ in range(7)]
        size = 0

        def emit(pieces: list) -> None:
            nonlocal sequence, size
            offset = 0
            for (doc_id, ids), start, length in pieces:
                tokens = ids[4 * start : 4 * (start + length)]
                for column, value in zip(out, (sequence, offset, doc_id, start, length, len(ids) // 4, tokens)):
                    column.append(value)
                offset += length
            size += 4 * offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            out, size = [[] for _ in range(7)], 0
            return batch

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                ids = rows.column(0).to_pylist()
                for doc_id, found in zip(ids, encoder.encode(rows.column(1).to_pylist())):
                    doc = (doc_id, found + end)
                    n = len(doc[1]) // 4
                    for start in range(0, n - window + 1, window):
                        emit([(doc, start, window)])
                    if rest := n % window:
                        if full := levels.place((doc, n - rest, rest)):
                            emit(full)
                        if levels.open > max_open:
                            for closed in levels.close():
                                emit(closed)
                    if size > 16_000_000:
                        yield flush()
        for closed in levels.close():
            emit(closed)
        yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of documents in windows of at most `window` tokens, with their token ids.

    One row per piece: its window and offset there, the document, the ids before it, its length, the
    document's ids in all, and its ids as little-endian unsigned 32-bit bytes. Each id of each
    document, the end id included, lies in exactly one piece.

    A missing or empty text is a document of the end id alone; equal rows are packed once each; a
    document without id is packed under null; an empty table gives no pieces. Columns other than the
    two named ones are not read. `max_open` bounds the memory of a task, not what is packed.
    """
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return in_small_batches(rows).mapInArrow(_packer(tokenizer, window, end_id, max_open, id_column), PIECES)
