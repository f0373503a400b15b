"""Scalar functions as Column builders: numbers of EXIF tags, signatures, vectors, display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import trimmed

EMBEDDING_PREFIX = "emb:v1:"
SIGNATURE_BYTES = 191
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def bind(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, as Catalyst copies an expression to each place that names it."""
    return F.transform(F.array(value), use)[0]


def is_hash(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\A[0-9a-f]{64}\z"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def blank(tag: Column) -> Column:
    """Null, empty and ``0`` count as missing in a tag."""
    return F.coalesce(tag.cast("string"), F.lit("")).isin("", "0")


def leading_number(text: Column) -> Column:
    """The number at the start of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double"), F.lit(0.0))


def exif_number(text: Column) -> Column:
    """``a/b`` as a quotient (null if b is 0), or a numeric text; else null."""
    bare = trimmed(text)
    parts = F.split(bare, "/", 2)
    low = leading_number(F.get(parts, F.lit(1)))
    quotient = F.when(low != 0, leading_number(F.get(parts, F.lit(0))) / low)
    plain = F.when(F.rlike(bare, F.lit(NUMBER)), bare.try_cast("double"))
    return F.when(bare == "", F.lit(None).cast("double")).when(F.contains(bare, F.lit("/")), quotient).otherwise(plain)


def degrees(parts: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds (an array of texts) as a signed number; null if one is missing."""
    d, m, s = (exif_number(F.get(parts, F.lit(k))) for k in range(3))
    sign = F.when(F.upper(trimmed(hemisphere)).isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(F.size(parts) >= 3, (d + m / 60.0 + s / 3600.0) * sign)


def gps(lat: Column, lat_ref: Column, lng: Column, lng_ref: Column) -> Column:
    """struct(lat, lng); null unless all four tags are there and both numbers parse."""
    there = (F.size(lat) > 0) & (F.size(lng) > 0) & ~blank(lat_ref) & ~blank(lng_ref)
    y, x = degrees(lat, lat_ref), degrees(lng, lng_ref)
    return F.when(there & y.isNotNull() & x.isNotNull(), F.struct(y.alias("lat"), x.alias("lng")))


def flat_tags(sections: Column) -> Column:
    """One map of an array of maps; a later section wins."""
    empty = F.create_map().cast("map<string,string>")
    merged = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.aggregate(sections, empty, lambda acc, m: merged(acc, F.coalesce(m, empty)))


def focal_length(in_35mm: Column, focal: Column) -> Column:
    """The 35 mm equivalent if given, else the length, which may be a quotient (null unless its divisor is positive)."""
    parts = F.split(focal, "/")
    low = leading_number(F.get(parts, F.lit(1)))
    quotient = F.when(low > 0, leading_number(F.get(parts, F.lit(0))) / low)
    own = F.when(F.contains(focal, F.lit("/")), quotient).otherwise(leading_number(focal))
    return F.when(~blank(in_35mm), leading_number(in_35mm)).when(~blank(focal), own)


def stored_signature(signature: Column) -> Column:
    """Trimmed; if over 191 bytes, its hash, which is no embedding any more."""
    bare = trimmed(signature)
    return F.when(F.octet_length(bare) <= SIGNATURE_BYTES, bare).otherwise(F.concat(F.lit("sig:v1:"), F.sha2(bare, 256)))


def cluster_id(person: Column) -> Column:
    return F.concat(F.lit("person-"), F.substring(F.sha1(person), 1, 12))


def signature_bytes(signature: Column) -> Column:
    """The signed bytes of an embedding signature as array<int>; null if it is none."""

    def raw(bare: Column) -> Column:
        code = F.translate(F.substring(bare, F.lit(len(EMBEDDING_PREFIX) + 1), F.length(bare)), "-_", "+/")
        sound = F.startswith(bare, F.lit(EMBEDDING_PREFIX)) & F.rlike(code, F.lit("^[A-Za-z0-9+/]+$")) & (F.length(code) % 4 != 1)
        padded = F.rpad(code, F.ceil(F.length(code) / 4).cast("int") * 4, F.lit("="))
        return F.try_to_binary(F.when(sound, padded), F.lit("base64"))

    def signed(digits: Column) -> Column:
        """Two hex digits a byte."""
        byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        both = F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1), byte)
        return F.when(F.length(digits) > 0, F.transform(both, lambda x: F.when(x > 127, x - 256).otherwise(x)))

    return bind(F.hex(bind(trimmed(signature), raw)), signed)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """Scaled to length 1; null for a zero or null vector."""
    return bind(vector, lambda v: bind(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size))))


def embedding(signature: Column) -> Column:
    return unit(F.transform(signature_bytes(signature), lambda b: b / F.lit(127.0)))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; -1 where their sizes differ or are 0."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(-1.0))


def encode_signature(vector: Column, dims: int = 128) -> Column:
    """An embedding signature; longer vectors become the means of ``dims`` near-equal runs.

    The first (n mod dims) runs are one longer than the others.
    """

    def shortened(v: Column) -> Column:
        n = F.size(v)
        short, longer = F.floor(n / dims).cast("int"), n % dims
        begin = lambda k: k * short + F.least(k, longer)
        mean = lambda run: F.aggregate(run, F.lit(0.0), lambda s, x: s + x) / F.size(run)
        runs = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: mean(F.slice(v, begin(k) + 1, begin(k + 1) - begin(k))))
        return F.when(n > dims, runs).otherwise(v)

    def spelled(scaled: Column) -> Column:
        whole = F.transform(scaled, lambda x: F.greatest(F.least(F.rint(x * 127.0), F.lit(127.0)), F.lit(-127.0)).cast("int"))
        code = F.base64(F.unhex(F.array_join(F.transform(whole, lambda b: F.lpad(F.hex(F.pmod(b, F.lit(256))), 2, "0")), "")))
        return F.when(scaled.isNotNull(), F.concat(F.lit(EMBEDDING_PREFIX), F.rtrim(F.translate(code, "+/\r\n", "-_"), F.lit("="))))

    return bind(unit(bind(vector.cast("array<double>"), shortened)), spelled)


def hex_distance(a: Column, b: Column) -> Column:
    """Bits by which two hex texts differ; null where one is none or lengths differ."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    sound = F.rlike(x, F.lit("^[0-9a-f]+$")) & F.rlike(y, F.lit("^[0-9a-f]+$")) & (F.length(x) == F.length(y))
    digit = lambda t, i: F.conv(F.substring(t, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    runs = F.sequence(F.lit(0), F.ceil(F.length(x) / 8).cast("int") - 1)
    return F.when(sound, F.aggregate(runs, F.lit(0), lambda s, i: s + F.bit_count(digit(x, i).bitwiseXOR(digit(y, i)))))


# Width and height of screens.
SCREENS = (
    (1920, 1080), (1080, 1920), (2560, 1440), (1440, 2560), (3840, 2160), (2160, 3840), (1366, 768), (768, 1366), (1280, 720), (720, 1280), (2048, 1536),
    (1536, 2048), (2732, 2048), (2048, 2732), (1125, 2436), (2436, 1125), (1170, 2532), (2532, 1170), (1284, 2778), (2778, 1284), (1290, 2796), (2796, 1290),
)


def screen_sized(width: Column, height: Column) -> Column:
    """Less than 5 % off a known screen in both directions."""
    screens = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in SCREENS))
    near = F.exists(screens, lambda s: (F.abs(width - s["w"]) < s["w"] * F.lit(0.05)) & (F.abs(height - s["h"]) < s["h"] * F.lit(0.05)))
    return (width != 0) & (height != 0) & near


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def box_iou(a: Column, b: Column) -> Column:
    """Of structs x, y, w, h."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when((w * h == 0) | (union <= 0), F.lit(0.0)).otherwise(w * h / union)


def face_confidence(box: Column, faces: Column, score: Column, width: Column, height: Column) -> Column:
    """From the share of the picture, the number of faces and the detector's score, in [0.3, 1], to four places (half to even)."""
    base = F.lit(0.5) + box["w"] * box["h"] / F.greatest(F.lit(1), width * height) * F.lit(2.0) + faces * F.lit(0.05)
    mixed = F.when(score.isNotNull(), base * F.lit(0.6) + score * F.lit(0.4)).otherwise(base)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.3), mixed)), 4)


# --- display forms ---


def size_text(n: Column) -> Column:
    """1024-based, whole bytes, else one place; 0 is ``0 B``."""
    units = ("B", "KB", "MB", "GB", "TB")
    step = F.least(F.floor(F.log2(n.cast("double")) / 10), F.lit(len(units) - 1)).cast("int")
    shown = n / F.pow(F.lit(1024.0), step)
    text = F.when(step == 0, F.format_string("%.0f", shown)).otherwise(F.format_string("%.1f", shown))
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(text, F.lit(" "), F.get(F.array(*map(F.lit, units)), step)))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(part * 100.0 / whole + 0.5).cast("int")))


def confidence_percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("int")


def atom_time(ts: Column) -> Column:
    """With the offset in digits, also at UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def stale(updated_at: Column, now: Column, seconds: int = 180) -> Column:
    """Older than so many seconds; empty and unreadable times are."""
    at = F.try_to_timestamp(updated_at)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) > seconds, F.lit(True))


def preview(text: Column) -> Column:
    return F.substring(text, 1, 12)


def spaced(indicator: Column) -> Column:
    return F.replace(indicator, F.lit("_"), F.lit(" "))


def total(columns: list[Column]) -> Column:
    """The sum in the order given, which matters for doubles."""
    return reduce(lambda a, b: a + b, columns)
