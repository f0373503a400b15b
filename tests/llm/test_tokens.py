"""Encoding, counting and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest
from data import awkward, frame, prose
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from shoebox.llm import bpe, counts, packing, words  # noqa: E402
from shoebox.llm.common import texts_of  # noqa: E402

BYTE, WORD, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "​", "\x1c", "\x0b", "'s", "'", "'LL", "don't", "a", "zq", "é", "é", "ß", "İ", "漢字", "\U0001f642", "1", "٢", "!?",
         "<|endoftext|>", "<|endo", "the", "क्", "\x00", "﻿", "_", "...", "ⅷ", "²", "ŉ", "Thing", "12", "▁", "a▁b", "<0x41>"]


def odd_texts(n=1500, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_fragments_give_the_ids_of_whole_texts():
    model = bpe.bpe(BYTE)
    for t in odd_texts():
        ids = np.frombuffer(model.encode(t), "<u4")
        assert ids.tolist() == model.tokenizer.encode(t, add_special_tokens=False).ids
        assert model.decode(ids.astype(np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace") == model.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_words_give_the_ids_of_whole_texts():
    model = words.word_bpe(WORD)
    for t in odd_texts():
        assert np.frombuffer(model.encode(t), "<u2").tolist() == model.tokenizer.encode(t, add_special_tokens=False).ids


def test_batches_of_words_give_the_ids_of_whole_texts(monkeypatch):
    """Texts side by side, in tables that hold all words or hardly any: bytes 0, words longer than a row, case and stops."""
    r = random.Random(6)
    more = ["Foo", "foo,", "FOO.", "foo", "e.g.,", "it's,", "a\x00", "a\x00\x00", "x" * 15, "X" * 16, "z.q.j.k.v.", "ZQJKVXW", "ÉT\u00c9,", "J\u030c", "\u01f0", "h\u0331.", "H\u0331.", "ΑΣ", "ας,", ",", ".", "\u212a", "9,", "_."]
    texts = [*odd_texts(800, 7), "", *(" ".join(r.choice(more + PARTS) for _ in range(r.randint(0, 12))) for _ in range(800)), "\n", "<|endoftext|>", "last."]
    whole = words.word_bpe(WORD).tokenizer
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for slots, held, memo in ((20, 1 << 17, 100_000), (4, 1 << 17, 5), (3, 7, 50)):
        for name, value in (("SLOTS", slots), ("HELD", held), ("MEMO", memo)):
            monkeypatch.setattr(words, name, value)
        model = words.WordBPE(WORD)
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in model.encode_all(texts)] == expected
        assert len(model.table) == 1 << slots and model.encode_all([]) == []


def test_words_are_spelled_once_whatever_their_case_and_stop():
    """What a worker hands to the pair encoder is what costs most."""
    model, asked = words.WordBPE(WORD), []

    class Told:
        def encode_ordinary(self, text, own=model.fast):
            asked.append(text.count("\0"))
            return own.encode_ordinary(text)

    model.fast = Told()
    stems = sorted({w for w in prose(11, 3000).split() if w.isalpha()})
    for form in ("{}", "{},", "{}.", "{}"):
        for spelled in (str, str.capitalize, str.upper):
            model.encode(" ".join(form.format(spelled(w)) for w in stems))
    assert sum(asked) <= 1.1 * len(stems)


def test_counts_are_those_of_a_unigram_model():
    from tokenizers import Tokenizer, models, normalizers

    pieces = counts.pieces_of(PIECE)
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    own = counts.counter(PIECE)
    for t in odd_texts():
        assert own.count(t)[0] == len(model.encode(t, add_special_tokens=False).ids)
    assert own.by_word


def test_counts_of_any_unigram_vocabulary():
    """Scores with fractions, ties, and pieces that run over the start of a word."""
    from tokenizers import Tokenizer, models, normalizers

    r = random.Random(8)
    base = [p for p, _ in counts.pieces_of(PIECE)]
    for scores, more in ((lambda: -r.random() * 12, []), (lambda: -r.choice((1.1, 2.2, 3.3)), ["the▁the", "a▁b", "▁'s▁"]), (lambda: -float(r.randint(1, 9)), [])):
        pieces = [(p, 0.0 if k < 3 else scores()) for k, p in enumerate(base + more)]
        model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
        model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        own = counts.UnigramCounter(pieces)
        for t in odd_texts(400) + ["the the a b's a b " * 30, prose(3)]:
            assert own.count(t)[0] == len(model.encode(t, add_special_tokens=False).ids), (t, own.by_word)


def test_frames_of_awkward_rows(spark):
    docs = texts_of(frame(spark, extra=True))
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.round_trip(docs, BYTE).collect()))
    assert len(got) == len(awkward())
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t, *_ in awkward())
    assert len(counts.count(docs, PIECE).collect()) == len(awkward())
    none = frame(spark, [])
    assert bpe.decode(bpe.encode(texts_of(none), BYTE), BYTE).collect() == [] and counts.count(texts_of(none), PIECE).collect() == []
    with pytest.raises(Exception, match="outside"):
        bpe.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>"), BYTE).collect()


def check_packing(rows, pieces):
    """Every id once, windows gapless, no padding but at powers of two."""
    from collections import defaultdict

    model, by_doc, by_sequence = words.word_bpe(WORD), defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    total = 0
    for doc_id, text, *_ in rows:
        ids = np.array([*model.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_OF_DOCUMENT], "<u4")
        total += len(ids)
        own = by_doc[doc_id, len(ids)]
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == zlib.crc32(p.ids) for p in own) or sum(r[0] == doc_id for r in rows) > 1
    assert sum(p.length for p in pieces) == total
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= packing.WINDOW and at & (at - 1) == 0


def test_packing(spark):
    check_packing(awkward(), packing.pack(frame(spark, extra=True), WORD).collect())
    check_packing(awkward(), packing.pack(frame(spark), WORD, shard_documents=3).collect())
    assert packing.pack(frame(spark, []), WORD).collect() == []


def topics(spread=100, groups=10, each=8, seed=1, size=1000):
    """Documents of each group draw from ids of their own."""
    r = random.Random(seed)
    return [np.array([r.randrange(t * spread, t * spread + spread) for _ in range(size)], "<u2") for t in range(groups) for _ in range(each)]


def test_neighbours_share_words():
    """Seeds find the documents of their topic."""
    docs = topics()
    mixed = 0
    for w in packing.sequences(packing.corpus_of(docs), enumerate(docs)):
        mixed += len({k // 8 for k, *_ in w}) > 2
    assert mixed <= 2


def brute_windows(corpus, docs):
    """Windows of one shard, from scores that are computed pair by pair."""
    from collections import Counter

    counts = [Counter(d.tolist()) for d in docs]

    def score(seed, other):
        out = 0.0
        for t in counts[seed]:
            if corpus.df[t] > 1 and t in counts[other]:
                tf = counts[other][t]
                raw = np.log1p((corpus.n - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[other]) / corpus.mean))
                out += round(raw * 2**24) / 2**24
        return out

    left, start, out = [len(d) for d in docs], [0] * len(docs), []
    by_length = sorted(range(len(docs)), key=lambda k: -left[k])
    place = {k: at for at, k in enumerate(by_length)}
    while sum(left) >= packing.WINDOW:
        seed = next(k for k in by_length if left[k])
        space, window = packing.WINDOW, []
        for k in [seed, *sorted((k for k in range(len(docs)) if k != seed and left[k]), key=lambda k: (-score(seed, k), place[k]))]:
            n = min(space, left[k])
            if n:
                window.append((k, start[k], n))
                start[k], left[k], space = start[k] + n, left[k] - n, space - n
        out.append(window)
    return out


def test_windows_are_those_of_brute_force():
    r = random.Random(4)
    docs = [np.array([r.choice((r.randrange(40), r.randrange(k % 7 * 100, k % 7 * 100 + 100), r.randrange(3000))) for _ in range(r.randint(20, 1500))], "<u2") for k in range(70)]
    docs = [d[:-1] if len(d) & (len(d) - 1) == 0 else d for d in docs]
    corpus = packing.corpus_of(docs)
    for held, postings, share in ((32, 1 << 21, 1 / 16), (3, 50, 1.0), (100, 1 << 21, 0.0)):
        was = packing.HELD_SEEDS, packing.HELD_POSTINGS, packing.COMMON
        packing.HELD_SEEDS, packing.HELD_POSTINGS, packing.COMMON = held, postings, share
        try:
            got = [[(k, start, n) for k, _, start, n in s] for s in packing.sequences(corpus, enumerate(docs))]
        finally:
            packing.HELD_SEEDS, packing.HELD_POSTINGS, packing.COMMON = was
        expected = brute_windows(corpus, docs)
        assert got[: len(expected)] == expected and sum(n for s in got for _, _, n in s) == sum(map(len, docs))


def test_scores_are_bm25():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3, 3], [3, 3, 4], [2, 9, 9, 9, 9], [7])]
    scores = packing.Shard(packing.corpus_of(docs), docs).scores(np.arange(4))
    mean = np.mean([len(d) for d in docs])
    for seed, d in enumerate(docs):
        expected = np.zeros(4)
        for t in set(d.tolist()):
            df = sum(t in x for x in docs)
            if df < 2:
                continue
            for k, x in enumerate(docs):
                tf = (x == t).sum()
                expected[k] += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean)) if tf else 0
        assert np.allclose(scores[seed], expected)


def test_cells_keep_topics_and_copies_together():
    """Each topic is in few cells, copies of a document in one, and deeper cells than levels are cut further."""
    docs = topics(groups=16, each=40)
    corpus = packing.corpus_of(docs)
    vectors, least = packing.projected(corpus, docs + docs[:5])
    cells = packing.Cells(vectors, 4)
    got = cells.of(vectors)
    assert (got[-5:] == got[:5]).all() and (least[-5:] == least[:5]).all() and 0 <= got.min() and got.max() < 16
    together = sum(max(np.bincount(got[t * 40 : t * 40 + 40])) for t in range(16)) / 640
    assert together > 0.8
    deeper = packing.Cells(vectors, packing.LEVELS + 3).of(vectors)
    assert deeper.max() >= 2**packing.LEVELS and deeper.max() < 2 ** (packing.LEVELS + 3)


def test_many_ranges_and_shards(spark):
    """Copies, topics and small shards: every id once, and sequences whole but for the end of a range."""
    r = random.Random(4)
    words_ = [["".join(r.choice("etaoinshrdlu") for _ in range(5)) for _ in range(30)] for _ in range(8)]
    rows = [(k, " ".join(r.choice(words_[k % 8]) for _ in range(r.randint(100, 900))), None, None, None) for k in range(64)]
    rows += [(100 + k, "same text again", None, None, None) for k in range(60)]
    was = packing.LEAST_TOKENS
    packing.LEAST_TOKENS = 4096
    try:
        pieces = packing.pack(frame(spark, rows), WORD, shard_documents=7).collect()
    finally:
        packing.LEAST_TOKENS = was
    check_packing(rows, pieces)
    assert len({p.sequence_id >> 40 for p in pieces}) == 4


def test_query_columns(spark):
    from shoebox.llm import entry

    assert set(entry.queries()) == {"op1_bpe", "op2_counts", "op3_packing", "op4_html", "op5_media", "op6_language", "op7_near", "op8_pii", "op9_lines", "op10_quality", "op11_codes", "op12_audit", "op13_chat"}
    rows = entry.op1_bpe(spark, "/root/testdata/sf0.001").where(F.length("ids_sha256") == 64).count()
    assert rows == 200
