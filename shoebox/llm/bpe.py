"""BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no token of the vocabulary can lie inside
no token of any encoding, so the text can be cut there, the fragments
encoded independently and the ids joined.  A cut is only used where it
cannot change what the pre-tokenizer sees: not behind white space (its
pattern looks ahead from there) and not before an apostrophe (which
begins a contraction only at the start of a match).  Fragments repeat,
so each worker keeps a bounded memo of them.

Edge cases: a null or empty text has no ids and decodes to the empty
string; ids outside the vocabulary, and null ids, raise ValueError;
repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import given_back, map_slices

#: Fragments that a worker remembers before it starts anew.
MEMO = 150_000
#: White space of the pre-tokenizer's pattern beyond ASCII.
WIDE_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")
#: Fragments of these characters only have the same pre-tokens in both tokenizer libraries.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*", re.DOTALL)


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: those that are printable as themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        alphabet = byte_alphabet()
        plain = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in added}
        tokens = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}

        size = max([*tokens.values(), *added.values()]) + 1
        spelled = [b""] * size
        for t, i in tokens.items():
            spelled[i] = t
        for t, i in added.items():
            spelled[i] = t.encode()
        self.lengths = np.array([len(t) for t in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

        self.cut = np.ones((256, 256), bool)
        for t in tokens:
            for a, b in zip(t, t[1:]):
                self.cut[a, b] = False
        self.cut[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        self.cut[:, ord("'")] = False
        self.cut[:, 0x80:0xC0] = False  # inside a character
        self.narrow = self.cut.copy()
        self.narrow[0x80:, :] = False  # the byte before may end a wide white space
        # The vocabulary's merges rank tokens in the order of their ids.
        self.fast = tiktoken.Encoding("fragments", pat_str=_pattern(), mergeable_ranks=tokens, special_tokens={})
        self.memo: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.special is None:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.special_ids[part])
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        seen = np.frombuffer(raw, np.uint8)
        cut = self.narrow if WIDE_SPACE.search(text) else self.cut
        at = np.flatnonzero(cut[seen[:-1], seen[1:]]) + 1
        ends = [*at.tolist(), len(raw)]
        memo = self.memo
        parts = [raw[a:b] for a, b in zip(chain((0,), ends), ends)]
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        for part in set(parts).difference(memo):
            memo[part] = self._fragment(part)
        return b"".join(map(memo.__getitem__, parts))

    def _fragment(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "surrogatepass")
        if PLAIN.fullmatch(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each list; ids are the lists' values on end, offsets where each begins and the last ends."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        out = self.blob[source].tobytes()
        at = ends[offsets].tolist()
        return [out[a:b] for a, b in zip(at, at[1:])]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def bpe(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text -> doc_id, ids array<int>, as the tokenizers library encodes without adding special tokens."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = bpe(vocabulary)
        lists = [model.encode(t) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in lists)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(lists), "<i4"))
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return map_slices(docs, work, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text -> doc_id, ids and decoded, as ``decode`` of ``encode``, with one passage through Python."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = bpe(vocabulary)
        lists = [model.encode(t) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in lists)])
        ids = np.frombuffer(b"".join(lists), "<i4")
        text = pa.array([p.decode("utf-8", "replace") for p in model.decode(ids.astype(np.int64), ends)], pa.string())
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), text], ["doc_id", "ids", "decoded"])

    return map_slices(docs, work, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, decoded string; bytes that are no UTF-8 become U+FFFD; null ids decode to the empty string."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, lists = bpe(vocabulary), batch.column(1)
        values = lists.flatten()
        if values.null_count:
            raise ValueError("an id is null")
        sizes = [0, *(n or 0 for n in lists.value_lengths().to_pylist())]
        parts = model.decode(values.to_numpy().astype(np.int64), np.cumsum(sizes))
        text = pa.array([p.decode("utf-8", "replace") for p in parts], pa.string())
        return pa.record_batch([batch.column(0), lists, text], ["doc_id", "ids", "decoded"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                yield work(batch.slice(at, 128))

    return encoded.mapInArrow(given_back(run), "doc_id long, ids array<int>, decoded string")
