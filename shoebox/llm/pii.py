"""Personal data by candidate gradient boosting, with DataFrame functions only.

Two sets of spans.  Base spans follow fixed patterns and checks (email,
ip, card, phone).  High-recall generators propose further spans, which
may overlap one another: written-out addresses, every number of 7 to 15
digits in any grouping, account numbers, and long mixed strings.  Boosted
trees score a proposal from its format and the words around it; each kind
has a threshold calibrated on examples that the trees were not fitted on.
Of proposals over their thresholds that overlap, the one that scores
highest stays (the earlier one on a tie).  Base spans always stay: a
proposal goes that lies in one or overlaps a part of it; one that holds a
whole base span (a secret with a digit run in it) is added beside it.  The
trees are fitted on examples that this module spells itself, so they
depend on no table, and are applied as Column expressions.

Positions are code points from 0, the end exclusive.

Edge cases: a null text counts as empty and, where redacted, stays null;
an empty text has no spans; spans of different kinds may overlap, and a
redaction covers their union; an empty table gives no rows; repeated rows
give repeated results; other input columns are ignored, or kept by
``redact``, whatever their names.  Everything is one projection.
Patterns are possessive and anchored to the start of a run, contexts come
from the text between matches, and overlaps are settled in one pass over
sorted spans, so very long texts cost time in proportion to their size
and no stack.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import fresh
from .lines import bind

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
#: Share of accepted calibration examples that must be personal data.
PRECISION = 0.98

# Fixed values.  ``\G`` lets a match begin where the last one ended inside the same run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators of further spans.
WRITTEN = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|<at>| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}"
DIGITS = r"(?<![0-9A-Za-z_])\+?\(?[0-9]{1,15}+\)?(?:[ ./-]{1,2}\(?[0-9]{1,8}+\)?){0,11}(?![0-9A-Za-z_])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}"

FEATURES = (
    "written", "account", "secret", "digits", "groups", "first", "last", "longest", "hyphens", "dots", "slashes", "spaces", "bracket", "plus", "zero", "date", "amount", "checked",
    "dotted_at", "spelled_dot", "social", "length", "hex", "mixed", "quoted", "cue_phone", "cue_mail", "cue_id", "cue_bank", "cue_secret", "cue_hash", "cue_other", "unit",
)
CUES = {
    "cue_phone": r"(?i)\b(tel|phone|telephone|call|calls|called|mobil|mobile|cell|fax|whatsapp|signal|reach|dial|text|sms|ring|hotline|contact|rufen?|telefon|t\u00e9l\u00e9phone|tel\u00e9fono|handy)\b\W*(\w+\W+){0,3}$",
    "cue_mail": r"(?i)\b(e-?mail|mail|write|contact|reach|address|inbox|ping|bei)\b\W*(\w+\W+){0,4}$",
    "cue_id": r"(?i)\b(ssn|social security|tax id|social|taxpayer)\b\W*(\w+\W+){0,2}$",
    "cue_bank": r"(?i)\b(iban|account|konto|bank|transfer|pay)\b\W*(\w+\W+){0,2}$",
    "cue_secret": r"(?i)(token|api[_ -]?key|secret|passw(or)?d|passwort|bearer|credential\w*|access[_ -]?key|private[_ -]?key|auth\w*|apikey|pwd|key)\W*(\w+\W+){0,2}$",
    "cue_hash": r"(?i)(commit|sha-?\d*|md5|checksum|hash|digest|revision|etag|uuid|blob|image|file|build|https?:\S*)\W*(\w+\W+){0,1}$",
    "cue_other": r"(?i)\b(isbn|issn|version|order|invoice|ref|reference|doi|page|pages|pp|vol|score|serial|item|model|build|article|section|no|nr|number|id|timestamp|at|in|from|between|since|until|about|population|total|zip|code|ticket|case|patent|lot|part|sku|tracking|equals|is|was|costs?)\W*(\w+\W+){0,1}$",
}
UNIT = r"(?i)^\s?(km|m|kg|g|mm|cm|eur|usd|dollars?|euros?|people|years?|votes|units|bytes|mb|gb|items|hz|ms|copies|points|%|\u20ac|\$)(?![A-Za-z])"
#: Digits of a number that is proposed.
DIGIT_RANGE = (7, 15)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def hits(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """start, end and text of each match, and up to 32 and 16 characters between it and its neighbours, before and after it.

    Matches come leftmost first and don't overlap; ``gate`` false means that there is none.
    """
    empty = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")

    def placed(parts: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, f: F.length(p) + F.length(f))
        # Running sums by blocks of 64, so that many matches don't cost their square.
        blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 64).cast("int")), lambda k: F.slice(s, k * 64 + 1, F.lit(64)))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

        def ends(bs: Column, sums: Column) -> Column:
            return F.flatten(F.transform(bs, lambda b, k: bind(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(b, lambda _, i: base + total(F.slice(b, F.lit(1), i + 1))))))

        at = bind(steps, lambda s: bind(blocks(s), lambda bs: bind(F.transform(bs, total), lambda sums: ends(bs, sums))))
        gaps = F.zip_with(F.slice(parts, 1, F.size(found)), F.slice(parts, 2, F.size(found)), lambda b, a: F.struct(F.substring(b, -32, 32).alias("before"), F.substring(a, 1, 16).alias("after")))
        spans = F.zip_with(found, at, lambda f, e: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("text")))
        return F.zip_with(spans, gaps, lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), g["before"].alias("before"), g["after"].alias("after")))

    any_hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = bind(any_hit, lambda found: F.when(F.size(found) == 0, empty).otherwise(bind(F.split(text, pattern, -1), lambda parts: placed(parts, found))))
    return out if gate is None else F.when(gate, out).otherwise(empty)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def small_parts(text: Column) -> Column:
    """All four numbers are at most 255, with or without leading zeros."""
    return F.forall(F.split(text, r"\."), lambda p: bind(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def spans_of(found: Column, kind: str, holds) -> Column:
    order = KINDS.index(kind)
    kept = F.filter(found, lambda h: holds(h["text"])) if holds else found
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), F.lit(order).alias("order"), h["end"].alias("end")))


def between(text: Column, least: int, most: int) -> Column:
    n = F.length(digits_of(text))
    return (n >= least) & (n <= most)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the spans of the fixed patterns as struct(start, order, end)."""
    return {
        "email": spans_of(hits(text, EMAIL, F.contains(text, F.lit("@"))), "email", None),
        "ip": spans_of(hits(text, IP), "ip", small_parts),
        "card": spans_of(hits(text, CARD), "card", lambda t: F.when(between(t, 14, 19), bind(digits_of(t), luhn)).otherwise(F.lit(False))),
        "phone": spans_of(hits(text, PHONE, F.contains(text, F.lit("+"))), "phone", lambda t: between(t, 10, 15)),
    }


def mod97(text: Column) -> Column:
    """Whether an account number's check digits hold."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, value(c)))) == 1


def number(flag: Column) -> Column:
    return flag.cast("double")


def proposals(text: Column) -> Column:
    """Spans of the generators as struct(start, end, text, before, after, from: an index into GENERATORS)."""

    def of(index: int, pattern: str, gate: Column, holds=None) -> Column:
        found = hits(text, pattern, gate)
        found = F.filter(found, lambda h: holds(h["text"])) if holds else found
        return F.transform(found, lambda h: F.struct(*(h[c].alias(c) for c in ("start", "end", "text", "before", "after")), F.lit(index).alias("from")))

    return F.concat(
        of(0, WRITTEN, F.rlike(text, F.lit(r"(?i)[\[({< ]at[\])}> ]"))),
        of(1, DIGITS, F.rlike(text, F.lit(r"[0-9]\)?[ ./-]{0,2}\(?[0-9]")), lambda t: between(t, *DIGIT_RANGE)),
        of(2, ACCOUNT, F.rlike(text, F.lit(r"[A-Z]{2}[0-9]{2}"))),
        of(3, SECRET, F.rlike(text, F.lit(r"[0-9][A-Za-z]|[A-Za-z][0-9]")), lambda t: F.rlike(t, F.lit("[0-9]")) & F.rlike(t, F.lit("[A-Za-z]"))),
    )


GENERATORS = ("written", "digits", "account", "secret")


def features_of(p: Column) -> Column:
    text = p["text"]
    count = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    matches = lambda pattern, of=text: number(F.rlike(of, F.lit(pattern)))
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sizes = lambda: F.transform(groups, lambda g: F.length(g))
    is_from = {name: number(p["from"] == k) for k, name in enumerate(GENERATORS)}
    numeric = p["from"] == GENERATORS.index("digits")
    of_digits = lambda c: F.when(numeric, c).otherwise(F.lit(0.0))
    of_secret = lambda c: F.when(p["from"] == GENERATORS.index("secret"), c).otherwise(F.lit(0.0))
    made = {
        "written": is_from["written"],
        "account": is_from["account"],
        "secret": is_from["secret"],
        "digits": F.length(digits_of(text)).cast("double"),
        "groups": of_digits(F.size(groups).cast("double")),
        "first": of_digits(F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)).cast("double")),
        "last": of_digits(F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)).cast("double")),
        "longest": of_digits(F.coalesce(F.array_max(sizes()), F.lit(0)).cast("double")),
        "hyphens": count("-"),
        "dots": count("."),
        "slashes": count("/"),
        "spaces": count(" "),
        "bracket": number(F.contains(text, F.lit("("))),
        "plus": number(F.startswith(text, F.lit("+"))),
        "zero": matches(r"^\(?0[1-9]"),
        "date": of_digits(matches(r"^(19|20)[0-9]{2}[./ -][0-9]{1,2}([./ -][0-9]{1,2})?$|^[0-9]{1,2}[./ -][0-9]{1,2}[./ -](19|20)?[0-9]{2}$|^(19|20)[0-9]{2}[ -]+(19|20)?[0-9]{2}$|^(19|20)[0-9]{6}$")),
        "amount": of_digits(matches(r"^[0-9]{1,3}([ .][0-9]{3})+$|^[0-9]+\.[0-9]+$|^[0-9]{5}-[0-9]{4}$")),
        "checked": F.when(p["from"] == GENERATORS.index("account"), number(mod97(text))).otherwise(F.lit(0.0)),
        "dotted_at": matches(r"(?i)[\[({<](at|dot)[\])}>]"),
        "spelled_dot": matches("(?i) dot "),
        "social": of_digits(matches(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")),
        "length": F.length(text).cast("double"),
        "hex": of_secret(matches("^[0-9a-f]+$|^[0-9A-F]+$")),
        "mixed": of_secret(F.size(F.regexp_extract_all(text, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))) / F.length(text)),
        "quoted": matches("[\"'=:]\\s?$", p["before"]),
        "unit": matches(UNIT, p["after"]),
    }
    made |= {k: matches(v, p["before"]) for k, v in CUES.items()}
    return F.array(*(made[k] for k in FEATURES))


def kind_of(p: Column) -> Column:
    return (
        F.when(p["from"] == 0, KINDS.index("email"))
        .when(p["from"] == 2, KINDS.index("iban"))
        .when(p["from"] == 3, KINDS.index("secret"))
        .when(F.rlike(p["text"], F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), KINDS.index("ssn"))
        .otherwise(KINDS.index("phone"))
    )


# --- the model ---


def examples(seed: int = 7, n: int = 6000) -> list[tuple[str, int]]:
    """Spelled examples: text and 1 if its candidate is personal data.

    The same shapes occur with both labels, likelier so with words before
    them that tell, so that no single feature separates them.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    some = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    often = lambda p, a, b: a if r.random() < p else b

    def iban(good: bool) -> str:
        country, rest = r.choice(("DE", "FR", "ES", "GB", "NL")), d(r.choice((12, 14, 16, 18, 20)))
        value = "".join(str(int(c, 36)) for c in rest + country) + "00"
        check = 98 - int(value) % 97
        if not good:
            check = (check + r.randint(1, 90)) % 97 + 2
        bare = f"{country}{check:02d}{rest}"
        return " ".join(bare[k : k + 4] for k in range(0, len(bare), 4)) if r.random() < 0.5 else bare

    def grouped() -> str:
        return r.choice((
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{r.randint(1, 9)}{d(2)} {d(3)} {d(4)}",
            f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}{d(3)} {d(6)}", f"0{r.randint(1, 9)}{d(2)} {d(7)}", f"0{r.randint(1, 9)}{d(1)}-{d(7)}", f"0{r.randint(1, 9)}{d(2)}/{d(6)}", f"{d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(4)}",
        ))

    def secret() -> str:
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 64))))
        mixed = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(20, 48)))
        return r.choice((hexed, mixed, f"sk-{mixed}", f"AKIA{mixed[:16].upper()}", f"ghp_{mixed}"))

    phone_cues = ("call", "phone", "tel", "mobile", "fax:", "tel.", "dial", "phone number is", "call me at", "text me on", "whatsapp", "Telefon", "reach us under", "my number is")
    other_cues = ("version", "order", "invoice", "ref", "isbn", "doi", "pages", "score", "serial", "since", "in", "between", "id", "ticket", "timestamp", "item no", "patent", "about", "tracking number", "case", "was", "lot")

    def positive() -> str:
        kind = r.randrange(6)
        if kind == 0:
            at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), ("{at}", "{dot}"), (" AT ", " DOT "), (" at ", " dot "), (" at ", " dot "), (" [AT] ", " [DOT] ")))
            name = often(0.6, f"{word()}.{word()}", word())
            host = often(0.2, f"{word()}{dot}", "") + word()
            return f"{r.choice((some(), 'mail me', 'contact', 'write to', 'reach me under', 'e-mail:'))} {name}{at}{host}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'io'))}"
        if kind in (1, 2):
            return f"{often(0.75, r.choice(phone_cues), some())} {grouped()}" if r.random() < 0.75 else f"{r.choice(phone_cues)} {often(0.5, '0' + str(r.randint(1, 9)) + d(r.randint(7, 9)), d(10))}"
        if kind == 3:
            return f"{r.choice(('ssn', 'SSN:', 'social security number', 'tax id', some(), some()))} {r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        if kind == 4:
            return f"{r.choice(('IBAN', 'account', 'bank', 'transfer to', some()))} {iban(True)}"
        cue = r.choice(("token", "api_key", "API key", "secret", "password", "Bearer", "access key", "auth token", "PASSWORD", "client_secret"))
        return f"{cue}{r.choice((' = ', ': ', '=', ' ', ' is '))}{often(0.5, chr(34), '')}{secret()}"

    def negative() -> str:
        kind = r.randrange(14)
        cue = often(0.7, r.choice(other_cues), some())
        if kind == 0:
            return f"{cue} {r.randint(1900, 2030)}{(s := r.choice('-./'))}{r.randint(1, 12):02d}{s}{r.randint(1, 28):02d}"
        if kind == 1:
            return f"{cue} {r.randint(1, 28):02d}{(s := r.choice('-./'))}{r.randint(1, 12):02d}{s}{r.randint(1900, 2030)}"
        if kind == 2:
            return f"{cue} {d(2)}.{d(2)}.{d(2)}.{d(3)}.{d(1)}"
        if kind == 3:
            return f"{cue} {often(0.5, '978-', '')}{d(1)}-{d(3)}-{d(5)}-{d(1)}"
        if kind == 4:
            return f"{cue} {r.randint(1900, 2030)}{r.choice(('-', ' - '))}{r.randint(1900, 2030)}"
        if kind == 5:
            return f"{cue} {r.randint(1, 999)}{(s := r.choice(' .'))}{d(3)}{s}{d(3)}{r.choice(('', ' EUR', ' people', ' km', ' votes'))}"
        if kind == 6:
            return f"{some()} at {word()} . {word()} {some()}" if r.random() < 0.5 else f"{some()} looked at home. {word()} {some()}"
        if kind == 7:
            return f"{cue} {iban(False)}"
        if kind == 8:
            return f"{r.choice(other_cues)} {often(0.3, grouped(), f'{d(3)}-{d(4)}-{d(3)}')}"
        if kind == 9:
            return f"{cue} {d(r.choice((7, 8, 9, 9, 10, 12, 13, 13)))}{r.choice(('', ' bytes', ' units'))}"
        if kind == 10:
            return f"{r.choice(('zip', some(), 'code', 'part'))} {d(5)}-{d(4)}"
        if kind == 11:
            hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
            return f"{r.choice(('commit', 'sha256:', 'sha1', 'md5', 'checksum', 'hash', 'digest', 'revision', 'build'))} {hexed}"
        if kind == 12:
            return f"{some()} {r.choice((f'IMG_{d(8)}_{d(6)}', f'{word()}-{word()}-{word()}-{d(4)}', f'{word()}/{word()}/{d(4)}/{word()}', f'{word()}_{word()}_{word()}_{d(2)}'))}"
        return f"{cue} {d(r.randint(1, 6))}.{d(r.randint(6, 9))}"

    out = []
    for k in range(n):
        text = positive() if k % 2 else negative()
        out.append((f"{some()} {text} {some()}", k % 2))
    return out


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]  # by kind; over 1: none of it


_models: dict[tuple[int, int], Model] = {}


def learn(spark: SparkSession, seed: int = 7, n: int = 6000) -> Model:
    """Fit on half of the spelled examples, calibrate on the others.  Features come from the same expressions as in use."""
    if (seed, n) in _models:
        return _models[seed, n]
    frame = spark.createDataFrame(examples(seed, n), "text string, label int")
    found = frame.select("text", "label", F.explode(proposals(F.col("text"))).alias("p"))
    rows = found.select("text", "label", kind_of(F.col("p")).alias("kind"), features_of(F.col("p")).alias("x")).collect()  # n rows and a few
    rows.sort(key=lambda r: (r["text"], r["x"]))
    x = np.array([r["x"] for r in rows])
    y = np.array([r["label"] for r in rows], float)
    kinds = np.array([r["kind"] for r in rows])
    mine = np.arange(len(rows)) % 2 == 0
    trees = fit(x[mine], y[mine], rounds=40, depth=3)
    p, truth, which = 1 / (1 + np.exp(-trees.raw(x[~mine]))), y[~mine], kinds[~mine]
    thresholds = []
    for k in range(len(KINDS)):
        least = 1.1
        for t in sorted({0.5, *np.round(p[which == k], 6)}, reverse=True):
            taken = truth[(which == k) & (p >= t)]
            if t >= 0.5 and len(taken) and taken.mean() >= PRECISION:
                least = float(t)
        thresholds.append(least)
    _models[seed, n] = Model(trees, tuple(thresholds))
    return _models[seed, n]


SPAN = "struct<start:int,back:int,added:int,order:int,end:int,score:double>"


def added_spans(text: Column, base: Column, model: Model) -> Column:
    """Accepted proposals as struct(start, order, end); base: sorted spans."""
    threshold = F.array(*map(F.lit, model.thresholds))

    def scored(p: Column) -> Column:
        score = bind(features_of(p), lambda x: model.trees.column([x[k] for k in range(len(FEATURES))]))
        return bind(score, lambda v: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), F.lit(1).alias("added"), kind_of(p).alias("order"), p["end"].alias("end"), v.alias("score")))

    def settled(accepted: Column) -> Column:
        given = F.transform(base, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), F.lit(0).alias("added"), b["order"].alias("order"), b["end"].alias("end"), F.lit(2.0).alias("score")))
        # By start, the longer one first, base spans before equal proposals.
        return F.aggregate(
            F.array_sort(F.concat(given, accepted)),
            F.struct(F.array().cast("array<struct<start:int,order:int,end:int>>").alias("done"), F.lit(None).cast(SPAN).alias("last"), F.lit(0).alias("reach")),
            step,
            lambda acc: closed(acc["done"], acc["last"]),
        )

    def closed(done: Column, last: Column) -> Column:
        return F.when(last.isNull(), done).otherwise(F.concat(done, F.array(F.struct(last["start"].alias("start"), last["order"].alias("order"), last["end"].alias("end")))))

    def step(acc: Column, x: Column) -> Column:
        """last: the accepted proposal that a later one may still replace; reach: where base spans end."""
        last, reach = acc["last"], acc["reach"]
        is_base, meets = x["added"] == 0, F.coalesce(last["end"] > x["start"], F.lit(False))
        dropped = is_base & meets & (x["end"] > last["end"])  # the base span covers only a part of it
        blocked = ~is_base & (x["start"] < reach)
        taken = ~is_base & ~blocked & (~meets | (x["score"] > last["score"]))
        return F.struct(
            F.when(taken & ~meets, closed(acc["done"], last)).otherwise(acc["done"]).alias("done"),
            F.when(dropped, F.lit(None).cast(SPAN)).when(taken, x).otherwise(last).alias("last"),
            F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach).alias("reach"),
        )

    accepted = bind(F.transform(proposals(text), scored), lambda ps: F.filter(ps, lambda p: p["score"] >= threshold[p["order"]]))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    return bind(accepted, lambda ps: F.when(F.size(ps) == 0, none).otherwise(settled(ps)))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the four base counts, base and spans: arrays of struct(start, order, end), order an index into KINDS."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(c.alias(f"_{k}") for k, c in base_spans(F.col("text")).items()))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    rows = rows.select("doc_id", "text", *counts, F.array_sort(F.concat("_email", "_ip", "_card", "_phone")).alias("base"))
    rows = rows.select("*", added_spans(F.col("text"), F.col("base"), model).alias("added"))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets; spans are sorted."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, names[s["order"]])).alias("out"))

    full = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(full)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The same rows and columns, the text redacted; a null text stays null."""
    text, base, spans = fresh(docs, "full", "base", "spans")
    held = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    held = held.withColumn(base, F.array_sort(F.concat(*base_spans(F.col(text)).values())))
    held = held.withColumn(spans, F.array_sort(F.concat(base, added_spans(F.col(text), F.col(base), model))))
    clean = F.when(F.col(text_col).isNotNull(), redacted(F.col(text), F.col(spans)))
    return held.withColumn(text_col, clean).select(*docs.columns)
