"""Personal data, line rules, languages and quality."""

import random
import re
import unicodedata

import numpy as np
import pytest
from data import awkward, frame, prose
from pyspark.sql import functions as F

from shoebox.llm import common, language, lines, pii, quality


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PII = [
    "mail a.b@c.de_x@y.z, 1.2.3.4.5 and 300.1.1.1 or 000.0255.1.1", "card 4539 1488 0343 6467 not 4539 1488 0343 6468", "+1 (743) 555-3824 +12 +123456789 ++49-30-123456", "\U0001f642 x@y.co é 10.0.0.1",
    "9" * 5000, "1." * 3000, "a@b.c " * 400, "a" * 5000 + "@", "@@@ +++ 1-1-1 --", "4539148803436467" * 2,
]


def test_base_spans(spark):
    model = pii.learn(spark)
    rows = [(k, t) for k, t in enumerate(PII + [t for _, t, *_ in awkward()])]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        expected = base(t or "")
        assert [(s.start, s.order, s.end) for s in got[k].base] == expected
        assert [got[k][f"n_{n}"] for n in pii.KINDS[:4]] == [sum(s[1] == i for s in expected) for i in range(4)]
        assert set(got[k].base) <= set(got[k].spans)
    assert pii.find(frame(spark, [], extra=True), model).collect() == []


def test_added_spans_and_redaction(spark):
    model = pii.learn(spark)
    cases = [
        ("please call (030) 555-1234 today", "please call [PHONE] today"), ("ssn 123-45-6789.", "ssn [SSN]."), ("mail jo.doe [at] host [dot] org now", "mail [EMAIL] now"),
        ("on 2024-01-02 version 1.22.333", None), ("ISBN 978-12-345-67890", None), ("a@b.cc at 1.2.3.4", "[EMAIL] at [IP]"), (None, None), ("", ""), ("pages 1990-2010 of the report", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = pii.redact(df, model)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for k, (t, expected) in enumerate(cases):
        assert got[k] == (t if expected is None else expected)


# Sentences written by hand, not by the generator of training examples; what is in brackets is personal data.
LABELLED = """
You can reach Anna under [0171 2345678] until six.
Her mobile: [07700 900123], his office line [020 7946 0018].
Bitte rufen Sie [030/901820] an.
Appelez le [01 42 68 53 00] pour plus de details.
Customer hotline [1-800-273-8255] is free of charge.
His cell is [4155550132]; do not share it.
Text me at [(415) 555-0198] when you land.
WhatsApp [+44 7700 900] works too.
phone [555.867.5309] after work
The fax number is [212-555-0187].
Dial [0800 1111000] for help
Contact the front desk, tel [089 123456].
My social is [219-09-9999], keep it safe.
Employee SSN [078-05-1120] was exposed.
Write to [maria.lopez at example dot org] for tickets.
send a mail to [support [at] example [dot] com] today
[bob(at)example.net] is the maintainer
Reach me: [info {at} museum {dot} fr]
Transfer the rent to [GB82 WEST 1234 5698 7654 32] by Monday.
Konto: [DE89370400440532013000]
IBAN [FR14 2004 1010 0505 0001 3M02 606] is ours.
api_key=[9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]
password: [hG7kLm92QwErTy56ZxCv]
Authorization: Bearer [abcDEF123456ghiJKL789012mnoPQR]
the secret "[4e07408562bedb8b60ce05c1decfe3ad16b72230]" leaked
Born on 12/04/1987 in a small town.
The meeting is on 2023-11-05 at noon.
Invoice 2023-000451 was paid.
ISBN 978-3-16-148410-0 is out of print.
Order number 4481920557 has shipped.
The city has 8 336 817 people.
Version 10.15.7.2001 fixes the crash.
Pi is about 3.14159265 in short.
Zip code 90210-1234 is in the west.
The years 1914-1918 changed the map.
We sold 1.250.000 units in 2019.
commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixes it
sha256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855
Look at the garden. It is green.
We met at noon . Then we left.
Ticket 20231105-0017 is closed.
The file IMG_20230114_183012 is blurred.
Read doi 10.1038/171737 again.
Patent 7654321 expired last year.
timestamp 1699178400 in the log
DE00370400440532013000 is a wrong account
The score was 101-99 in the end.
Page 1234567 does not exist.
"""


def labelled_spans():
    for line in LABELLED.strip().split("\n"):
        # A bracket inside a span belongs to it: spans open after a blank, = or " and close before a blank, mark or the end.
        found = [(m.start(1), m.end(1)) for m in re.finditer(r"(?<![A-Za-z])\[(?!at\]|dot\])((?:[^\[\]]|\[(?:at|dot)\])+)\]", line)]
        text, spans, cut, at = "", [], 0, 0
        for k, (start, end) in enumerate(found):
            text += line[at : start - 1]
            spans.append((len(text), len(text) + end - start))
            text += line[start:end]
            at = end + 1
        yield text + line[at:], spans


def test_precision_and_recall_on_sentences_written_by_hand(spark):
    cases = list(labelled_spans())
    model = pii.learn(spark)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string"), model).collect()}
    found = {(k, s) for k, spans in got.items() for s in spans}
    truth = {(k, s) for k, (_, spans) in enumerate(cases) for s in spans}
    precision, recall = len(found & truth) / len(found), len(found & truth) / len(truth)
    print("precision", round(precision, 3), "recall", round(recall, 3), "missed", [cases[k][0][a:b] for k, (a, b) in sorted(truth - found)], "wrong", [cases[k][0][a:b] for k, (a, b) in sorted(found - truth)])
    assert len(truth) >= 25 and precision >= 0.85 and recall >= 0.85


def brute_added(t, model):
    """Spans that the method adds, in Python."""
    cands = []
    for index, pattern in enumerate((pii.WRITTEN, pii.DIGITS, pii.ACCOUNT, pii.SECRET)):
        ms = list(re.finditer(pattern, t, re.ASCII))
        for k, m in enumerate(ms):
            digits = re.sub("[^0-9]", "", m[0])
            if index == 1 and not 7 <= len(digits) <= 15 or index == 3 and not (digits and re.search("[A-Za-z]", m[0])):
                continue
            before = t[ms[k - 1].end() if k else 0 : m.start()][-32:]
            after = t[m.end() : ms[k + 1].start() if k + 1 < len(ms) else len(t)][:16]
            cands.append((index, m.start(), m.end(), m[0], before, after))
    spans = []
    for index, start, end, text, before, after in cands:
        has = lambda pattern, of=text: float(bool(re.search(pattern, of, re.ASCII)))
        digits, groups = re.sub("[^0-9]", "", text), [g for g in re.split("[^0-9]+", text) if g]
        number, secret = index == 1, index == 3
        valid = 0.0
        if index == 2:
            bare = text.replace(" ", "")
            valid = float(int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1)
        of = dict(
            written=index == 0, account=index == 2, secret=secret, digits=len(digits), groups=number * len(groups), first=number * (len(groups[0]) if groups else 0), last=number * (len(groups[-1]) if groups else 0),
            longest=number * max(map(len, groups), default=0), hyphens=text.count("-"), dots=text.count("."), slashes=text.count("/"), spaces=text.count(" "), bracket="(" in text, plus=text.startswith("+"), zero=has(r"^\(?0[1-9]"),
            date=number * has(r"^(19|20)[0-9]{2}[./ -][0-9]{1,2}([./ -][0-9]{1,2})?$|^[0-9]{1,2}[./ -][0-9]{1,2}[./ -](19|20)?[0-9]{2}$|^(19|20)[0-9]{2}[ -]+(19|20)?[0-9]{2}$|^(19|20)[0-9]{6}$"),
            amount=number * has(r"^[0-9]{1,3}([ .][0-9]{3})+$|^[0-9]+\.[0-9]+$|^[0-9]{5}-[0-9]{4}$"), checked=valid, dotted_at=has(r"(?i)[\[({<](at|dot)[\])}>]"), spelled_dot=has("(?i) dot "),
            social=number * has(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), length=len(text), hex=secret * has("^[0-9a-f]+$|^[0-9A-F]+$"),
            mixed=secret * len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", text)) / len(text), quoted=has("[\"'=:]\\s?$", before), unit=has(pii.UNIT, after), **{k: has(v, before) for k, v in pii.CUES.items()},
        )
        x = np.array([[float(of[f]) for f in pii.FEATURES]])
        score = 1 / (1 + np.exp(-model.trees.raw(x)[0]))
        kind = ("email", "ssn" if re.search("^[0-9]{3}-[0-9]{2}-[0-9]{4}$", text) else "phone", "iban", "secret")[index]
        if score >= model.thresholds[pii.KINDS.index(kind)]:
            spans.append((start, -end, 1, pii.KINDS.index(kind), end, score))
    done, last, reach = [], None, 0
    for x in sorted([(a, -c, 0, k, c, 2.0) for a, k, c in base(t)] + spans):
        meets = last is not None and last[4] > x[0]
        if x[2] == 0:
            reach = max(reach, x[4])
            if meets and x[4] > last[4]:
                last = None
        elif x[0] >= reach and (not meets or x[5] > last[5]):
            if not meets and last is not None:
                done.append(last)
            last = x
    return sorted((x[0], x[3], x[4]) for x in [*done, *([last] if last else [])])


def test_added_spans_are_those_of_brute_force(spark):
    r = random.Random(11)
    model = pii.learn(spark)
    parts = [t for t, _ in pii.examples(seed=3, n=300)] + [t for t, _ in labelled_spans()] + PII[:4] + ["+1 (743) 555-3824", "4539 1488 0343 6467", "token = \"45391488034364674e07a\"", "漢字 \U0001f642", "1-2-3-4-5-6-7 a@b.cc"]
    texts = [r.choice((" ", "", ", ", "\n")).join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(250)] + PII
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    added = 0
    for k, t in enumerate(texts):
        expected = brute_added(t, model)
        assert sorted((s.start, s.order, s.end) for s in got[k].spans) == sorted(base(t) + expected), t
        added += len(expected)
    assert added > 300


def test_line_statistics(spark):
    import collections

    texts = [t for _, t, *_ in awkward()] + ["a b c a b c", "a a a a a", "x y\nx y\n\n \nx y", "one two three", "q w e r q w e", prose(4) + "\n" + prose(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("clash"))
    for r in lines.clean(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert (r.cleaned is None) == (texts[r.doc_id] is None)


def test_line_rules(spark):
    good = "This is a plain sentence that nobody would want to remove, is it not."
    bad = ["Home | News | Sport | About |", "BUY NOW!! THIS IS GREAT!! BUY!!", "a*** b### c$$$ d%%%", "All rights reserved.", "12345 67890 1234567."]
    df = spark.createDataFrame([(0, "\n".join([good, *bad, good])), (1, "\n".join([prose(5) + ".", *bad])), (2, "\n".join(bad * 9))], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.clean(df).collect()}
    assert got[0].cleaned == good and got[1].kept and got[1].cleaned == prose(5) + "." and not got[2].kept and got[2].cleaned == ""


def test_line_words_are_cut_at_any_white_space(spark):
    """Indents and tabs are no words, and lines of blanks neither count as text left nor go."""
    good, blank, indent = prose(7) + ".", " " * 400, " " * 12
    tabbed = "\t".join(["Read more"] + ["word"] * 30) + "."
    texts = [f"{good}\n{indent}Home | About | Contact", f"{good}\n{indent}All rights reserved.", f"{good}\n{tabbed}", "\n".join([good, blank, *(f"{k} All rights reserved to somebody by name." for k in range(40))])]
    got = {r.doc_id: r for r in lines.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].cleaned == got[1].cleaned == good and got[2].cleaned == texts[2]
    assert got[3].cleaned == f"{good}\n{blank}" and got[3].lost == pytest.approx(1 - len(good) / (len(texts[3]) - 41 - len(blank))) and not got[3].kept


def test_lines_without_the_end_of_a_sentence_go(spark):
    """Thirty lines without a mark are no prose, short or long; wrapped prose is, and so are sentences in other scripts."""
    good = "This is a plain sentence, and it stays."
    wrapped = "\n".join(["A long sentence is wrapped over", "several lines of the text, of which", "only the last one ends in a mark."])
    texts = [
        "\n".join(prose(k, 5).capitalize() for k in range(30)), "\n".join(prose(k, 14).capitalize() for k in range(30)),
        "\n".join([good, "Home, sweet › About › Contact › Jobs.", "A short one!", "He said \u201cyes.\u201d", "版本 3.5 of it", "漢字の文です。", "Items:", "The end. Then nothing"]), wrapped, "",
    ]
    got = {r.doc_id: r for r in lines.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in (0, 1):
        assert not got[k].base_failed and not got[k].kept and got[k].cleaned == "" and got[k].lost == 1
    assert got[2].cleaned == "\n".join([good, "A short one!", "He said \u201cyes.\u201d", "漢字の文です。", "Items:", "The end. Then nothing"])
    assert got[3].cleaned == wrapped and got[3].lost == 0 and got[4].lost == 0 and got[4].cleaned == ""
    assert lines.clean(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_line_of_blanks_changes_no_verdict(spark):
    """Where all lines with a word fail, a long blank line keeps nothing."""
    menu = "\n".join(["Home | News | Sport | About | More | Less | Jobs | Help"] * 3 + [f"Item {k} | Page {k} | Next {k}" for k in range(20)])
    texts = [menu, menu + "\n" + " " * 6000, " " * 6000 + "\n" + menu]
    got = lines.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.base_failed, r.kept, r.lost) for r in got] == [(False, False, 1.0)] * 3


def test_languages(spark):
    words = {"aa": "tana mora kila", "bb": "xyz zzq qxx"}
    rows = [(k, " ".join(words[lang].split()[(k + j) % 3] for j in range(5)), lang, None, None) for k in range(60) for lang in ("aa", "bb")]
    docs = frame(spark, rows + awkward()[:5], extra=True)
    model = language.learn(docs.where("lang IN ('aa', 'bb')"))
    got = language.identify(docs, model).collect()
    truth = {r[1]: r[2] for r in rows}
    named = {t: model.predict(t)[0] for t in truth}
    assert named == truth
    und = [model.predict(t) for t in (None, "", " ", "12 !?")]
    assert und == [("und", 0.0)] * 4
    assert model.predict("tana" * 9) == model.predict("tana" * 9) and 0 <= model.predict("é")[1] <= 1
    assert len(got) == docs.count() and language.keep_identified(docs, model).columns == docs.columns
    empty = language.learn(frame(spark, []))
    assert empty.predict("abc") == ("und", 0.0)


def brute_profile(texts, most):
    """N-grams by frequency, ties by code points, of words padded by a blank."""
    from collections import Counter

    found = Counter()
    for t in texts:
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower())
        padded = " " + re.sub(" +", " ", letters).strip() + " "
        if padded.strip():
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    if padded[k : k + n] != " ":
                        found[padded[k : k + n]] += 1
    number = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], number(x[0])))][:most]


def test_profiles_and_distances_are_those_of_brute_force(spark):
    r = random.Random(2)
    words = {"xx": "tana mora kila étè ñu", "yy": "xyz zzq qxx mora ß", "zz": "漢字 文 абв где"}
    rows = [(k, " ".join(r.choice(words[lang].split()) for _ in range(r.randint(1, 40))), lang, None, None) for k in range(40) for lang in words]
    docs = frame(spark, rows + [(900 + k, t, None, None, None) for k, (_, t, *_) in enumerate(awkward())], extra=True)
    model = language.learn(docs)
    import zlib

    mine = {lang: [t for k, t, x, *_ in rows if x == lang and zlib.crc32(str(k).encode()) % 4 != 2] for lang in words}
    profiles = {lang: brute_profile(texts, language.PROFILE) for lang, texts in mine.items()}
    for t in [t for _, t, *_ in rows] + [t for _, t, *_ in awkward() if t and len(t) < 2000] + ["e\u0301", "\u0301"]:
        own = brute_profile([t], language.PROFILE)
        if not own:
            assert model.predict(t) == ("und", 0.0)
            continue
        distances = {lang: sum(abs(p.index(g) - k) if g in p else language.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best, second = sorted(distances.values())[:2]
        lang = min(x for x in sorted(distances) if distances[x] == best)  # of equal distances the first by name
        assert model.compare(t) == pytest.approx((lang, second / (best + second) if best + second else 0.5, best / (language.PROFILE * len(own))))
    limit = language.limit_of(docs, model)
    assert limit < 1
    kept = {r.text for r in language.keep_identified(docs, model, limit).collect()}
    assert {t for _, t, *_ in rows} <= kept and not kept & {None, "", " ", "1234 !!! ###"}
    assert language.keep_identified(spark.createDataFrame([(1, "ωψφ χυτ")], "doc_id long, text string"), model, limit).collect() == []


def test_out_of_place_distance():
    model = language.Profiles(["a", "b"], [[97, 98, 99], [98, 97]])
    keys, _ = language.ngrams("ab")
    distances = [sum(abs(p.index(k) - i) if k in p else language.PROFILE for i, k in enumerate(keys.tolist())) for p in ([97, 98, 99], [98, 97])]
    assert model.predict("ab")[0] == "ab"[distances.index(min(distances))]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    """Models on the corpus: rows that they didn't see."""
    from shoebox.llm import entry

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    langs = entry.op6_language(spark, sf).where("held_out").join(docs, "doc_id").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS x").first()["x"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = entry.op10_quality(spark, sf).where("held_out").join(labels, "doc_id").selectExpr("avg(CAST(quality = predicted AS INT)) AS x").first()["x"]
    assert langs > 0.97 and scores > 0.93


def test_quality_edge_cases(spark):
    docs = frame(spark, extra=True)
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.scored(docs, none).collect()} == {0.5}
    one = quality.learn(docs, spark.createDataFrame([(1, 1), (3, 1), (4, None)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in quality.scored(docs, one).collect())
    assert quality.keep_good(docs, one).columns == docs.columns


def test_rules_compile_to_what_they_mean(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    df = spark.createDataFrame([tuple(v.tolist()) for v in x], ", ".join(f"{f} double" for f in quality.FEATURES))
    got = [q.s for q in df.select(model.score({f: F.col(f) for f in quality.FEATURES}).alias("s")).collect()]
    raw = model.bias + sum(w * quality.applies(rule, x) for rule, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-raw))) and ((np.array(got) > 0.5) == y).mean() > 0.97


def brute_statistics(text):
    """The statistics of a text, in Python."""
    t = text or ""
    words, full = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    joined = "".join(words)
    letters, capitals = sum(unicodedata.category(c)[0] == "L" for c in joined), sum(unicodedata.category(c) == "Lu" for c in joined)
    chars, n, m = max(1, len(joined)), max(1, len(words)), max(1, len(full))
    of = lambda chosen: sum(joined.count(c) for c in chosen)
    return {
        "words": len(words), "mean_word": chars / n, "symbols": of("#*$%&|<>{}~^=\\@_") / chars, "marks": of(".,;:!?") / n, "digits": of("0123456789") / chars,
        "capitals": capitals / max(1, letters), "shouts": of("!") / n, "distinct": len(set(words)) / n, "repeats": n**0.5 * (1 - len(set(words)) / n), "lines": m,
        "same_lines": 1 - len(set(full)) / m, "line_words": n / m, "ends": sum(bool(re.search(r"[.!?\"')][\x20\x09\x0B-\x0D]*$", x)) for x in full) / m, "pipes": of("|") / n,
        "stops": of(".") / n, "spaces": (len(t) - len(joined)) / n, "doubled": len(re.findall(r"([!?*#$%&])\1", t)) / n, "letters": letters / chars,
    }


def test_statistics_are_those_of_brute_force(spark):
    texts = [t for _, t, *_ in awkward()] + ["A b!! c. \nD e f ?\n\n x|y {z} 12,3 \"q\"\n", " lead and trail ", "\tÉtÉ ÑU ǅx**##", "one\ntwo.\ntwo.\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("words", "reduced", "marks", "n")})
    rows, stats = quality.statistics(df, "text")
    for r in rows.select("doc_id", F.struct(*(c.alias(f) for f, c in stats.items())).alias("s")).collect():
        expected = brute_statistics(texts[r.doc_id])
        got = r.s.asDict()
        if expected["words"] == 0:
            expected |= {"distinct": 0.0, "repeats": 1.0, "same_lines": 1.0}
        assert got == pytest.approx(expected), (texts[r.doc_id], {k: (got[k], v) for k, v in expected.items() if got[k] != pytest.approx(v)})


def test_labels_and_texts_that_repeat(spark):
    """The model depends neither on repeats nor on how rows are dealt."""
    texts = {k: (prose(k, 60) + "." if k % 2 else "a*** b### " * 30) for k in range(40)}
    docs = [(k, t) for k, t in texts.items()] + [(7, texts[8]), (7, texts[7])] * 30
    labels = [(k, k % 2) for k in texts] * 3 + [(3, 0), (None, 1), (5, 7), (6, None)]
    models = [quality.learn(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), spark.createDataFrame(labels, "doc_id long, quality int").repartition(n), sample=20) for n in (1, 4)]
    assert models[0] == models[1] and models[0].rules
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.scored(empty, models[0]).collect() == [] and quality.keep_good(empty, models[0]).collect() == []
    kept = quality.keep_good(spark.createDataFrame(docs, "doc_id long, text string"), models[0])
    scored = quality.scored(spark.createDataFrame(docs, "doc_id long, text string"), models[0])
    assert kept.count() == scored.where("predicted = 1").count() and 0 < kept.count() < len(docs)


def test_lines_match_their_sql(spark):
    import duckdb

    from shoebox.llm import entry

    con = duckdb.connect()
    odd = ["x y.\n  \nz", "Ab c\nd e\nF g", "A\tb\tc d\n\n Home » x » y", "Über ALLES GEHT DIE SONNE\nÉté. là", "a\x0bb\x0c\r\nC", "SHOUT OUT LOUD NOW PLEASE", "Cookie\nREAD MORE!\nlog in."]
    odd += ["\n".join(r.choice(odd + ["w " * 60, "Yes.", " ", "a*b*c* 1%", "Next | to | me"]) for _ in range(9)) for r in map(random.Random, range(60))]
    base = con.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").df()
    import pandas as pd

    both = pd.concat([base, pd.DataFrame({"doc_id": range(100000, 100000 + len(odd)), "text": odd})])
    con.register("documents", both)
    got = lines.clean(spark.createDataFrame([(int(d), t) for d, t in zip(both.doc_id, both.text)], "doc_id long, text string")).drop("cleaned", "lost")
    expected = con.sql(entry.oracle_sql()["op9_lines"])
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(expected.select(*sorted(got.columns)).fetchall())


def test_a_repeat_goes_whatever_follows_it(spark):
    """The first of equal lines stays, with what follows it there; others go."""
    text = "The same line ends here.\nand this one goes on.\nThe same line ends here.\nOther line is here.\nno end\ngoes on.\nno end\nHere is one."
    other = "no end\nHere is one more.\nno end\ngoes on."
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    got = {r.doc_id: r.cleaned for r in lines.clean(docs).collect()}
    assert got[1] == "The same line ends here.\nand this one goes on.\nOther line is here.\nno end\ngoes on.\nHere is one."
    assert got[2] == "Here is one more.\ngoes on."
    r = random.Random(3)
    texts = ["\n".join(r.choice(["A b c.", "a b c.", "no end", "No end", "", " "]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    seen = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", lines.first_lines(F.split(F.regexp_replace("text", r"\n(?=\p{Ll})", f"{lines.GOES_ON}\n"), "\n", -1)).alias("x")).collect()
    for t, found in seen:
        plain = t.split("\n")
        want = [x + (lines.GOES_ON if k + 1 < len(plain) and plain[k + 1][:1].islower() else "") for k, x in enumerate(plain) if x not in plain[:k]]
        assert found == want


def test_a_language_of_one_repeated_id_is_learned(spark):
    """Many rows of one id, and of one id and text."""
    rows = [(1, f"hello there my friend {prose(k, 5)}", "en") for k in range(500)] + [(1, "guten tag mein freund", "de")] * 500
    found = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert found.languages == ["de", "en"]
    few = language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert sorted((r.lang, r.n) for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()) == [("de", 1), ("en", 50)]


def test_profiles_and_limits_come_from_all_rows(spark):
    """Also from those beyond the first few thousand of a language."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("aba").alias("text"), F.lit("xx").alias("lang"))
    # One row of other words in each 1000; any one may be the furthest.
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 1000 == 1, F.concat(F.lit("aba "), F.translate(F.hex(F.sha2(F.col("doc_id").cast("string"), 256)), "0123456789", "qrstuvwxyz"))).otherwise(F.col("text")))
    mine = [(r.lang, r.text) for r in rows.where(~common.held_out()).collect()]
    model = language.learn(rows)
    known, rank = model.sorted[0]
    assert known[np.argsort(rank)].tolist() == language.top(*map(np.array, zip(*sorted(grams(t for _, t in mine).items()))), language.PROFILE)[0].tolist()
    assert language.limit_of(rows, model) == (1 + max(model.compare(t)[2] for _, t in mine)) / 2


def grams(texts) -> dict[int, int]:
    out: dict[int, int] = {}
    for t in texts:
        for key, n in zip(*(x.tolist() for x in language.ngrams(t, None))):
            out[key] = out.get(key, 0) + n
    return out
