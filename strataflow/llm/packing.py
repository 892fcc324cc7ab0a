"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, texts
from strataflow.llm.rolling import Words, chunks, distinct_spans

#: Texts are taken in slices of about so many bytes, a longer text in spans of them.
_SPAN = 2 << 20
#: Parts of words that a worker remembers; then it begins anew.
_REMEMBERED = 400_000
#: Parts that the vocabulary's own splitting keeps whole: Latin letters, a digit, or signs.
_PART = re.compile(rb"(?!(?s:.)*(?:\xc3[\x97\xb7]|\xc4\xb0))(?:[A-Za-z]|[\xc3-\xc9][\x80-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Bytes by which a word is left to the tokenizer as a whole: signs with a meaning of their own, controls, other scripts.
_HARD = np.zeros(256, bool)
_HARD[[*range(33), ord("'"), ord("<"), 127, *range(0xC0, 0xC3), *range(0xCA, 256)]] = True


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts under a tokenizer of lower-case words: tokens never span blanks, digits stand alone.

    A word of Latin letters, digits and signs falls into parts as the vocabulary's splitting cuts it; other
    words stay whole. Most parts of a corpus repeat, so a part's ids are remembered, in one flat table of
    bounded size. Of many texts at once the distinct parts are looked up and all parts' ids are gathered from
    the table. Parts go to the vocabulary's merges directly, whole words through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _row(self, part: bytes) -> int:
        if _PART.fullmatch(part):
            lower = part.decode().lower()
            mapped = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.letters)
            self.flat.extend([t.id for t in self.tokenizer.model.tokenize(mapped)])
        else:
            self.flat.extend(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids)
        self.starts.append(len(self.flat))
        self.rows[part] = row = len(self.rows)
        return row

    def _parts(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, word) of the parts of all words."""
        hard = _HARD[data] & (data > 32)
        pair = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        hard[:-1] |= pair
        hard |= (data < 32) & ~np.isin(data, [9, 10, 11, 12, 13])
        sums = np.concatenate([[0], np.cumsum(hard)])
        whole = sums[w.ends] > sums[w.starts]
        change = np.zeros(len(data) + 1, np.int8)
        change[w.starts[whole]] = 1
        change[w.ends[whole]] -= 1
        kind = _KIND[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins &= np.cumsum(change[:-1], dtype=np.int8) == 0
        inside = np.zeros(len(data) + 1, np.int8)
        inside[w.starts] = 1
        inside[w.ends] -= 1
        begins &= np.cumsum(inside[:-1], dtype=np.int8) > 0
        begins[w.starts] = True
        starts = np.flatnonzero(begins)
        word = np.searchsorted(w.starts, starts, "right") - 1
        return starts, np.minimum(w.ends[word], np.append(starts[1:], len(data))), word

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = Words(data, offsets, hashed=False)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin, end, word = self._parts(data, w)
        first, of = distinct_spans(data, begin, end)
        if len(self.rows) + len(first) > _REMEMBERED:
            self._forget()
        raw, known, new = data.tobytes(), self.rows.get, self._row
        parts = [raw[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        rows = np.array([new(x) if (row := known(x)) is None else row for x in parts])
        starts = np.array(self.starts)
        size = (starts[rows + 1] - starts[rows])[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[rows][of] - ends[:-1], size) + np.arange(ends[-1])
        return np.array(self.flat, np.uint32)[at], ends[np.searchsorted(word, w.first)]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each begins and the last ends)."""
        if len(data) <= 2 * _SPAN or len(offsets) > 2:
            return self._slice(data, offsets)
        parts, at = [], 0
        while at < len(data):
            blank = np.flatnonzero(data[at + _SPAN : at + 2 * _SPAN] <= 32)  # a longer word goes with its span
            end = at + _SPAN + int(blank[0]) if len(blank) else at + 2 * _SPAN
            while len(blank) == 0 and end < len(data) and data[end] > 32:
                end += 1
            parts.append(self._slice(data[at:end], np.array([0, min(end, len(data)) - at]))[0])
            at = end
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """This worker's tokenizer, with the words that it remembers from earlier tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the first bin that has room.

    A tournament tree holds the room of every bin at its leaves and the larger of two at each inner node, so
    the leftmost bin with enough room is found from the root in log2(bins) steps.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1)).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= need else 2 * at + 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, doc_no): every document's ids and end_id, cut every `capacity` ids.

    doc_no numbers the rows of docs, one after another in each task; no two rows have the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, number = tokenizer_at(tokenizer_path), TaskContext.get().partitionId() << 40
        for rows, data, offsets in chunks(batches, 1, _SPAN):
            ids, ends = tokenizer.texts(data, offsets)
            at = ends + np.arange(len(ends))  # each text's ids and end_id
            whole = np.full(at[-1], end_id, "<u4")
            whole[np.repeat(np.arange(len(ends) - 1), np.diff(ends)) + np.arange(len(ids))] = ids
            out: list[tuple] = []
            for doc_id, low, high in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for s in range(low, high, capacity):
                    part = whole[s : min(s + capacity, high)]
                    out.append((doc_id, s - low, len(part), zlib.crc32(part), high - low, number))
                number += 1
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_no"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_no long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, group_tokens: int = 1 << 21, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): documents packed into sequences.

    A document is its ids and end_id, so an empty or null text is one id. Documents longer than a sequence are
    cut at multiples of it; the last piece and all other documents are packed whole, first-fit decreasing,
    within groups of documents that a seeded hash draws. Groups have about group_tokens ids each, so a task's
    memory does not depend on the input (a document of more ids takes its own group to its own length, a few
    numbers for each 4096 of them), and the one unfilled sequence of a group costs a small share: half of one
    in group_tokens / capacity. An empty table: no rows.

    The hash is of a document's id and its row's number, fixed when the pieces are written; so equal rows, and
    rows without an id, spread over all groups like any others. Ties in length go by id, start and number.

    Only lengths and checksums are shuffled. A retried task makes the same groups and the same sequences.
    """
    parts = cut(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_no", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        first = group["part"][0].as_py() << 32
        return group.drop_columns(["part", "doc_no"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    drawn = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_no", F.lit(seed)), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return drawn.groupBy("part").applyInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
