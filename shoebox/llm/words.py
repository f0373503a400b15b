"""Encoding with a word-level BPE vocabulary (lower case, word ends marked, white space dropped).

The vocabulary's pre-tokens never span white space, so texts are cut
there and words are encoded on their own; so are commas and full stops
that end them.  A batch of texts is looked up at once: words of up to 15
bytes are two numbers each (of ASCII ones in lower case), which are
compared with a table of a fixed size that holds each word's ids; a word
takes the place of another one that hashes alike.  What the table lacks, and what
doesn't fit into it, goes through a byte-pair encoder in one call, with a
bounded memo: the mark of a word's end is written as a byte 0, and the
pairs of a byte with it come first, which is how such vocabularies spell
their last symbol.  Words with other characters than printable ASCII and
Latin letters are encoded by the tokenizers library itself, as are texts
that hold its special tokens.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .bpe import byte_alphabet

#: Words of a generation that a worker remembers beside its table; it keeps two.
MEMO = 100_000
#: Rows of a worker's table, as a power of two: two numbers that are the word, eight 16-bit ones that are how many ids it has and these.
SLOTS, SHORT, FEW = 20, 15, 7
#: Words that are looked up together.
HELD = 1 << 17
FAST = re.compile("[\n!-~\xa1\xa7\xab\xb0\xb7\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-įĲ-ƿ]*")
# Fixed value: the vocabulary's pre-tokens, for the characters above.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
END = "</w>"
#: The lowest bytes of a number, by how many.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A byte 1 in each place.
EACH = np.uint64(0x0101010101010101)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def lower(x: np.ndarray) -> np.ndarray:
    """Numbers of eight ASCII bytes each, with A-Z in lower case."""
    return x | ((x + EACH * np.uint64(0x80 - 0x41)) & ~(x + EACH * np.uint64(0x80 - 0x5B)) & EACH * np.uint64(0x80)) >> np.uint64(2)


class WordBPE:
    """A vocabulary file of the tokenizers library whose ids fit into 16 bits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        alphabet = byte_alphabet()

        def spelled(token: str) -> bytes:
            ends = token.endswith(END)
            return bytes(alphabet[c] for c in (token[: -len(END)] if ends else token)) + b"\0" * ends

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        tokens = sorted((i, spelled(t), t.endswith(END)) for t, i in vocabulary.items() if t not in added)
        if tokens[-1][0] >= 1 << 16:
            raise ValueError("ids over 16 bits")
        first = [x for x in tokens if len(x[1]) == 1]
        last = [x for x in tokens if len(x[1]) == 2 and x[2]]
        # Merges rank in the order of their ids.
        merged = [x for x in tokens if len(x[1]) > 1 and not (len(x[1]) == 2 and x[2])]
        order = [*first, *last, *merged]
        self.ids = np.array([i for i, _, _ in order], "<u2")
        self.ends = np.array([e for _, _, e in order])
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={b: k for k, (_, b, _) in enumerate(order)}, special_tokens={})
        self.table = np.zeros((1 << SLOTS, 4), "<u8")
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 16-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        slow = {k for k, t in enumerate(texts) if "<|" in t and self.special is not None and self.special.search(t)}
        raw = [b"" if k in slow else t.encode("utf-8", "surrogatepass") for k, t in enumerate(texts)]
        # A line break closes the last word of each text; the bytes at the end let any word be read as two numbers.
        joined = b"\n".join([*raw, bytes(16)])
        seen = np.frombuffer(joined, np.uint8)[:-16]
        inside = np.concatenate(([False], (seen != 32) & (seen - np.uint8(9) > 4)))
        before, inside = inside[:-1], inside[1:]
        # A comma or full stop between a letter and white space is a word of its own.
        stop = np.zeros(len(seen), bool)
        stop[1:-1] = ((seen[1:-1] == 44) | (seen[1:-1] == 46)) & ((seen[:-2] | 32) - np.uint8(97) < 26) & ~inside[2:]
        begins, ends = np.flatnonzero(inside & ~before | stop), np.flatnonzero(before & ~inside | stop)
        found = [self._words(joined, begins[k : k + HELD], ends[k : k + HELD]) for k in range(0, len(begins), HELD)]
        whole = b"".join(ids for ids, _ in found)
        # Where the ids of each text's words end.
        words = np.searchsorted(begins, np.cumsum([len(x) + 1 for x in raw], dtype=np.int64))
        stops = (2 * np.cumsum(np.concatenate([[0], *(counts for _, counts in found)]))[words]).tolist()
        return [self._slow(t) if k in slow else whole[a:b] for k, (t, a, b) in enumerate(zip(texts, [0, *stops], stops))]

    def _words(self, joined: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        sizes = ends - begins
        at = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        low, high = at[begins] & LOWEST[np.minimum(sizes, 8)], at[begins + 8] & LOWEST[np.clip(sizes - 8, 0, 7)]
        narrow = (low | high) & EACH * np.uint64(0x80) == 0
        low, high = np.where(narrow, lower(low), low), np.where(narrow, lower(high), high)
        # The size is part of what is compared, as words may hold bytes 0.
        high |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        mixed = low * MIX[0] ^ high * MIX[1]
        slot = ((mixed ^ (mixed >> np.uint64(32))) * MIX[2] >> np.uint64(64 - SLOTS)).astype(np.int64)
        rows = self.table.take(slot, axis=0)
        known = (rows[:, 0] == low) & (rows[:, 1] == high) & (sizes <= SHORT)
        numbers = rows.view("<u2")[:, 8:]
        counts = np.where(known, numbers[:, 0], 0).astype(np.int64)
        found = numbers[:, 1:][np.arange(FEW) < counts[:, None]]
        missing = np.flatnonzero(~known)
        if not len(missing):
            return found.tobytes(), counts
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(begins[missing].tolist(), ends[missing].tolist())])
        new = self._learned(list(number))
        lengths = np.array([len(x) // 2 for x in new])
        counts[missing] = lengths[of]
        out = np.empty(int(counts.sum()), "<u2")
        own = np.repeat(known, counts)
        out[own] = found
        out[~own] = np.frombuffer(b"".join(map(new.__getitem__, of.tolist())), "<u2")
        # One place of each new word that the table can hold.
        where = np.empty(len(new), np.int64)
        where[of] = missing
        fits = np.flatnonzero((sizes[where] <= SHORT) & (lengths <= FEW))
        few = np.zeros((len(fits), 1 + FEW), "<u2")
        few[:, 0] = lengths[fits]
        few[:, 1:][np.arange(FEW) < few[:, :1]] = np.frombuffer(b"".join(map(new.__getitem__, fits.tolist())), "<u2")
        where = where[fits]
        self.table[slot[where]] = np.column_stack((low[where], high[where], few.view("<u8")))
        return out.tobytes(), counts

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; those that the table can't hold are remembered."""
        if len(self.memo) > MEMO:
            # Words of the generation before stay known, and move on when they are met.
            self.before, self.memo = self.memo, {}
        found = {w: self.memo[w] if w in self.memo else self.before[w] for w in words if w in self.memo or w in self.before}
        unknown = [w for w in words if w not in found] if found else words
        text = b"\n".join(unknown).decode("utf-8", "surrogatepass")  # words hold no line break
        if FAST.fullmatch(text):
            fast = unknown
        else:
            fast, known = [], []
            for raw, word in zip(unknown, text.split("\n")):
                if FAST.fullmatch(word):
                    fast.append(raw)
                    known.append(word)
                else:
                    found[raw] = self._slow(word)
            text = "\n".join(known)
        if fast:
            # Each pre-token is closed by a byte 0; letters alone are one.
            closed = [w + "\0" if w.isalpha() else PRETOKEN.sub("\\g<0>\0", w) for w in text.lower().split("\n")]
            counts = np.array([x.count("\0") for x in closed])
            ranks = np.array(self.fast.encode_ordinary("".join(closed)), np.int64)
            ends = np.flatnonzero(self.ends[ranks]) + 1
            stops = (ends[np.cumsum(counts) - 1] * 2).tolist()
            ids = self.ids[ranks].tobytes()
            found.update((w, ids[a:b]) for w, a, b in zip(fast, [0, *stops], stops))
        self.memo.update((w, x) for w, x in found.items() if len(w) > SHORT or len(x) > 2 * FEW)
        return [found[w] for w in words]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)
