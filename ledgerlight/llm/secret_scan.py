"""Secret scans: three kinds of patterns, and a randomness test battery for what no pattern names.

Patterns give the base spans.  The battery looks at other long tokens, and at long pieces that base spans leave of one.  Each gets an encoding from its
characters, and two questions:

* *Could it be random?*  A chi-squared test of equal use of the alphabet, a runs test over the lower and upper half
  of the alphabet and a test of the correlation of neighbouring characters; the smallest of the three p-values,
  times three, must not fall below ``RANDOM_FLOOR``.
* *Could it be text?*  The probability that running text of the same length shows so few equal character pairs and so
  many changes between small letters, capitals, digits and signs; both depend on the length, so a short token has to be
  far stranger than a long one.

The second p-values of all tokens of the corpus go through the Benjamini-Hochberg procedure, so of the reported
tokens at most a share ``FALSE_SHARE`` is expected to be text.  Only DataFrame functions are used; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base kinds.  Runs that are too short may be left out of the second and third pattern
# at once: their matches are maximal runs (from the first AKIA on), so a short one hides no long one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN_LENGTH, SIGNS = 20, "+/_-="
TOKEN = f"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}={{0,2}}"

RANDOM_FLOOR, FALSE_SHARE = 0.001, 0.001
BINS_PER_NAT, LAST_BIN = 4, 2_800
#: Published sums of squared and cubed letter shares of English text, and the share of class changes allowed for text.
TEXT_PAIRS, TEXT_TRIPLES, TEXT_CHANGES = 0.0667, 0.0060, 0.08

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order of the tests: name, pattern of the characters, alphabet.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_capitals", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("alphanumeric", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _found(text: Column, pattern: str, kind: int, value_length: int = 0) -> Column:
    """Matches as ``(start, kind, end, token)``; with ``value_length``, those whose second group is so long."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value_length else whole
    pieces = F.zip_with(F.split(text, pattern, -1), F.zip_with(whole, value, lambda m, v: F.struct(
        m.alias("token"), F.length(v).alias("value"))), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,token:string,value:int>>)")

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["m"]["token"])
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece["m"]["token"].alias("token"),
            piece["m"]["value"].alias("value"))
        return F.when(piece["m"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")))

    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda s: s["spans"])
    kept = F.filter(spans, lambda s: s["value"] >= value_length) if value_length else spans
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"], s["token"]))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,token:string>>)")
    return F.when(text.rlike(pattern), bare).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _below(z: Column) -> Column:
    """Normal distribution function, logistic form (absolute error below 2e-4)."""
    return 1 / (1 + F.exp(-(z * 1.5976 + z * z * z * 0.070565)))


def _two_sided(z: Column) -> Column:
    return 2 * _below(-F.abs(z))


def _per_encoding(body: Column, part) -> Column:
    out = None
    for name, pattern, alphabet in ENCODINGS:
        out = F.when(body.rlike(pattern), part(name, alphabet)) if out is None else out.when(
            body.rlike(pattern), part(name, alphabet))
    return out


def _profile(body: Column) -> Column:
    """Length, alphabet size, sum of squared counts, half string and places of a token in its alphabet (null: mixed)."""

    def of(name: str, alphabet: str) -> Column:
        half = alphabet[len(alphabet) // 2:]
        halves = F.translate(F.translate(body, half, "\x01" * len(half)), alphabet[: len(alphabet) // 2], "0" * (len(alphabet) // 2))
        squares = F.aggregate(
            F.array(*[F.lit(c) for c in alphabet]), F.lit(0).cast("double"),
            lambda a, c: a + F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2)))
        places = F.transform(F.split(body, ""), lambda c: F.expr("1.0D") * F.instr(F.lit(alphabet), c))
        return F.struct(
            F.lit(name).alias("encoding"), F.length(body).cast("double").alias("n"),
            F.lit(float(len(alphabet))).alias("size"), squares.alias("squares"), halves.alias("halves"),
            places.alias("places"))

    return _per_encoding(body, of)


def _battery(p: Column) -> Column:
    """p-value of the token under *random over its alphabet*: three tests, smallest times three."""
    n, size = p["n"], p["size"]
    chi = size / n * p["squares"] - n
    uniform = _below(-(chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
    ones = F.length(F.regexp_replace(p["halves"], "0", "")).cast("double")
    runs = F.length(F.regexp_replace(p["halves"], "(.)\\1*", "r"))
    expected = 2 * ones * (n - ones) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    run_test = F.when(spread > 0, _two_sided((runs - expected) / F.sqrt(spread))).otherwise(0.0)
    mean = F.aggregate(p["places"], F.lit(0.0), lambda a, v: a + v) / n
    serial = _let(mean, lambda m: _let(
        F.transform(p["places"], lambda v: v - m),
        lambda c: F.aggregate(
            F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: a * F.coalesce(b, F.lit(0.0))),
            F.lit(0.0), lambda a, v: a + v) / F.nullif(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v), F.lit(0.0))))
    serial_test = F.coalesce(_let(serial, lambda r: _two_sided((r + 1 / n) * F.sqrt(n))), F.lit(0.0))
    return F.least(F.lit(1.0), 3 * F.least(uniform, run_test, serial_test))


def _text_surprise(body: Column, p: Column) -> Column:
    """Minus the logarithm of the probability that running text of this length looks so."""
    n = p["n"]
    pairs, triples = F.lit(TEXT_PAIRS), F.lit(TEXT_TRIPLES)
    spread = 2 * n * (n - 1) * (pairs - pairs * pairs) + 4 * n * (n - 1) * (n - 2) * (triples - pairs * pairs)
    equal = _below((p["squares"] - n - n * (n - 1) * pairs) / F.sqrt(spread))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        body, "[a-z]+", "\x01"), "[A-Z]+", "\x02"), "[0-9]+", "\x03")
    changes = (F.length(classes) - 1).cast("double")
    share = F.least(F.greatest(changes / (n - 1), F.lit(TEXT_CHANGES)), F.lit(0.999))
    apart = share * F.log(share / TEXT_CHANGES) + (1 - share) * F.log((1 - share) / (1 - TEXT_CHANGES))
    nats = (n - 1) * apart - F.log(F.greatest(equal, F.lit(1e-300)))  # of the product of two p-values
    return F.greatest(F.lit(0.0), nats - F.log(1 + nats))


def _rest(t: Column) -> Column:
    """What base spans leave of a token: pieces long enough for a token, without signs at their ends."""
    touching = F.array_sort(F.filter("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,token:string>>)")

    def gap(state: Column, end: Column) -> Column:
        text = F.substr(t["token"], state["at"] - t["start"] + 1, F.greatest(F.lit(0), end - state["at"]))
        body = F.ltrim(text, F.lit(SIGNS))
        start = state["at"] + F.length(text) - F.length(body)
        bare = F.rtrim(body, F.lit(SIGNS))
        piece = F.struct(start.alias("start"), t["kind"].alias("kind"), (start + F.length(bare)).alias("end"), bare.alias("token"))
        return F.when(F.length(bare) >= TOKEN_LENGTH, F.concat(state["pieces"], F.array(piece))).otherwise(state["pieces"])

    return F.aggregate(
        touching, F.struct(t["start"].alias("at"), none.alias("pieces")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), gap(s, b["start"]).alias("pieces")),
        lambda s: gap(s, t["end"]))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (array of ``start, kind, end``) and ``tokens`` (the same with ``bin``, and ``random``)."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(_found(text, ASSIGN, 0, ASSIGN_VALUE), _found(text, ACCESS, 1), _found(text, HEX, 2))
    named = docs.withColumns({"base": base, "tokens": _found(text, TOKEN, 3)})
    free = F.flatten(F.transform("tokens", lambda t: F.when(
        F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])), _rest(t)).otherwise(F.array(t))))

    def judged(t: Column) -> Column:
        body = F.rtrim(t["token"], F.lit("="))
        return _let(_profile(body), lambda p: F.struct(
            t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"),
            F.least(F.lit(LAST_BIN), F.floor(_text_surprise(body, p) * BINS_PER_NAT)).cast("int").alias("bin"),
            ((p["encoding"] != "decimal") & (_battery(p) >= RANDOM_FLOOR)).alias("random")))

    return named.withColumn("tokens", F.transform(free, judged)).withColumn("base", F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def cutoff(spans: DataFrame) -> int:
    """Smallest bin of text p-values that the false-discovery control lets through; above the last bin if none.

    Tokens of mixed alphabets count as tests, too.
    """
    bins = spans.select(F.explode("tokens").alias("t")).groupBy(F.coalesce("t.bin", F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy().orderBy(F.desc("bin"))  # at most LAST_BIN + 1 rows
    ranked = bins.select("bin", F.sum("n").over(down).alias("reached"), F.sum("n").over(Window.partitionBy()).alias("all"))
    edge = F.exp(-F.col("bin") / BINS_PER_NAT)
    least = ranked.where((F.col("bin") > 0) & (edge <= F.col("reached") * FALSE_SHARE / F.col("all"))).agg(F.min("bin")).first()[0]
    return LAST_BIN + 1 if least is None else least


def _flagged(least_bin: int) -> Column:
    hit = F.filter("tokens", lambda t: t["random"] & (t["bin"] >= least_bin))
    return F.transform(hit, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no spans (the digest is that of the empty string); repeated rows get equal
    results; other columns are ignored; an empty table gives no rows.
    """
    found = stage(with_spans(docs.select("doc_id", "text")).drop("text"), "secrets")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{name}": count(k) for k, name in enumerate(KINDS[:3])}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.concat("base", _flagged(cutoff(found)))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask`` and ``n_chars`` counted anew where that happened."""
    spans = with_spans(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    least = cutoff(with_spans(docs.select("text")))
    marked = spans.withColumn("_spans", F.array_sort(F.concat("base", _flagged(least))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        between = F.substr(F.col("text"), state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        return F.when(s["end"] <= state["at"], state).when(
            s["start"] < state["at"], F.struct(s["end"].alias("at"), state["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(state["out"], between, F.lit(mask)).alias("out")))

    clean = F.aggregate("_spans", start, cut, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    hit = F.size("_spans") > 0
    changed = marked.withColumn("_text", F.when(hit, clean).otherwise(F.col("text")))
    out = [F.col("_text").alias(c) if c == "text" else
           F.when(hit, F.length("_text").cast("long")).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else
           F.col("row")[c].alias(c)
           for c in docs.columns]
    return changed.select(*out)
