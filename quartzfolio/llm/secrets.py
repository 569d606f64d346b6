"""Secret scans in DataFrame functions only: three patterns and Markov models.

Base kinds, leftmost and non-overlapping, in characters, end exclusive: ``assign``
(a value given to a password, token or key), ``access`` (an access key id) and
``hex`` (a long lower-case hex run). Places come from splitting a text at the
matches: what lies between two matches and the matches themselves have known
lengths, so running sums give the starts.

The fourth kind, ``random``, is a token of 20 or more key characters that looks
drawn at random: the log-likelihood of its character pairs under a Markov model of
random strings, less that under a model of ordinary identifiers, is above a
threshold per pair. Both models are first-order chains over all 67 key characters
with add-one smoothing, trained from labelled samples. Random strings are hashes
written in base 64, its alphabet for links, letters and digits, and base 16.
Identifiers are made of successive words of a bounded sample of the corpus that no
base pattern marks, in the ways programs write them: underscores, capitals, case
changes, hyphens, paths, numbers, digit runs, rules of one character. One identifier
in ``HELD`` is kept from training, and the threshold is the value that a stated share
of those held out exceed. The counts are two matrices of 67 by 67, and with the
threshold the only data on the driver. Base spans are cut out of a token, and each
rest of 20 or more characters is scored by itself.

Null text is empty text without spans. Null or repeated ids are kept, one output
row per input row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: The base patterns, with the least length of the part that counts (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: The key characters, each a class of its own.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-=_"
CLASSES = len(ALPHABET)
#: One identifier in so many sets the threshold instead of the model; matches summed at once.
HELD, STEP = 5, 256
_SPANS = "array<struct<start:int,stop:int,word:string>>"


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of each character pair, random over identifier, and the
    mean ratio a pair above which a token counts as random."""

    ratios: list[float]
    per_pair: float


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """Sums of all sizes before each; in blocks, so that a text with very many matches
    does not copy its array for each of them."""
    none = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda k: F.slice(x, k * STEP + 1, F.lit(STEP)))
        total = lambda p: F.aggregate(p, F.lit(0), lambda acc, y: acc + y)
        return _bound(parts, lambda ps: F.flatten(F.zip_with(ps, sums(F.transform(ps, total), F.lit(0)), sums)))

    return _bound(sizes, whole)


def _places(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, stop, word>> of matches whose ``group`` has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), part.alias("part"))
    size = lambda r: F.length(r["gap"]) + F.coalesce(F.length(r["hit"]), F.lit(0))
    placed = lambda r, at: F.struct((at + F.length(r["gap"])).alias("start"), (at + size(r)).alias("stop"), r["hit"].alias("word"), (F.length(r["part"]) >= least).alias("good"))
    found = _bound(rows, lambda x: F.filter(F.zip_with(x, _running(F.transform(x, size)), placed), lambda s: F.coalesce(s["good"], F.lit(False))))
    return F.when(text.rlike(pattern), F.transform(found, lambda s: F.struct(s["start"], s["stop"], s["word"]))).otherwise(F.array().cast(_SPANS))


def _class_of(c: Column) -> Column:
    """Place of a one-character string in the alphabet."""
    code = F.ascii(c)
    letter = F.when((code >= 97) & (code <= 122), code - 97).when((code >= 65) & (code <= 90), code - 39).when((code >= 48) & (code <= 57), code + 4)
    return letter.otherwise(F.when(code == 43, 62).when(code == 47, 63).when(code == 45, 64).when(code == 61, 65).otherwise(66))


def _pairs(word: Column) -> Column:
    """Numbers of a word's character pairs: the first class times their count plus the second."""
    def pairs(k: Column) -> Column:
        n = F.greatest(F.size(k) - 1, F.lit(0))
        return F.zip_with(F.slice(k, F.lit(1), n), F.slice(k, F.lit(2), n), lambda a, b: a * CLASSES + b)

    return _bound(F.transform(F.split(word, ""), _class_of), pairs)


def _score(word: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's pairs."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i + 1)) / F.size(p)
    return _bound(_pairs(word), mean)


def _identifiers(docs: DataFrame) -> DataFrame:
    """w, held: three successive words of a text as programs write names, one way each,
    and whether they are held out of training."""
    clean = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), "[0-9a-f]{32,}|" + ACCESS, " ")
    words = docs.select(F.filter(F.regexp_extract_all(clean, F.lit(r"([A-Za-z]{2,})"), F.lit(1)), lambda w: F.length(w) <= 15).alias("ws"))
    places = F.sequence(F.lit(0), F.floor(F.size("ws") / 3).cast("int") - 1)
    threes = words.where(F.size("ws") >= 3).select(F.explode(F.transform(places, lambda k: F.slice("ws", k * 3 + 1, F.lit(3)))).alias("ws")).distinct()
    low = F.transform("ws", lambda w: F.lower(w))
    a, b, c = (F.element_at(low, i) for i in (1, 2, 3))
    h = F.sha2(F.array_join("ws", " "), 256)
    number = F.conv(F.substring(h, 1, 8), 16, 10)
    digits = F.concat(number, F.conv(F.substring(h, 9, 8), 16, 10), F.conv(F.substring(h, 17, 8), 16, 10))
    title = F.concat(*[F.initcap(x) for x in (a, b, c)])
    rule = F.repeat(F.element_at(F.array(*[F.lit(x) for x in "-=_/0"]), F.pmod(F.hash("ws"), F.lit(5)) + 1), 24)
    ways = F.array(
        F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), title, F.concat(a, F.initcap(b), F.initcap(c)),
        F.concat(a, b, c), F.concat_ws("_", a, b, number), F.concat_ws("/", a, F.substring(number, 1, 4), F.substring(number, 3, 2), b), F.concat(a, F.lit("="), b, F.lit("-"), c),
        F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 3, 2), a, b), digits, F.concat(F.upper(a), F.lit("-"), number, F.lit("/"), b), rule,
        F.concat(F.initcap(a), F.lit("/"), F.initcap(b), F.initcap(c)), F.upper(F.concat(a, b, c)),
    )
    way = F.element_at(ways, F.pmod(F.xxhash64("ws"), F.lit(16)).cast("int") + 1)
    return threes.select(way.alias("w"), (F.pmod(F.xxhash64("ws", F.lit("held")), F.lit(HELD)) == 0).alias("held")).where(F.length("w") >= 3)


def _random_strings(spark, n: int) -> DataFrame:
    h = spark.range(n).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    links = F.translate(F.base64(F.unhex(F.sha2("h", 256))), "+/=", "-_")
    plain = F.translate(F.base64(F.unhex(F.sha2(F.reverse("h"), 256))), "+/=", "")
    return h.select(F.explode(F.array(b64, links, plain, F.substring("h", 1, 28))).alias("w"))


def train_models(
    documents: DataFrame, sample_rows: int = 1500, random_strings: int = 4000, false_positives: float = 0.005, id_col: str = "doc_id", text_col: str = "text"
) -> Models:
    """Both models and the threshold that a ``false_positives`` share of held-out
    identifiers of 20 characters or more exceed (never below 0: as likely random).

    ``sample_rows`` bounds the expected number of documents that give identifiers.
    """
    spark = documents.sparkSession
    docs = id_text(documents, id_col, text_col)
    n = max(docs.count(), 1)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / n))
    made = _identifiers(docs.where(pick & F.col("text").isNotNull()))
    both = made.where("not held").select("w", F.lit(0).alias("y")).union(_random_strings(spark, random_strings).select("w", F.lit(1).alias("y")))
    counted = both.select("y", F.explode(_pairs(F.col("w"))).alias("pair")).groupBy("y", "pair").count().collect()  # 2 * 67 * 67 rows at most
    counts = [[1.0] * CLASSES**2 for _ in (0, 1)]
    for r in counted:
        counts[r.y][r.pair] += r["count"]
    chance = []
    for c in counts:
        rows = [sum(c[CLASSES * i : CLASSES * (i + 1)]) for i in range(CLASSES)]
        chance.append([math.log(c[i] / rows[i // CLASSES]) for i in range(CLASSES**2)])
    ratios = [b - a for a, b in zip(*chance, strict=True)]
    scored = made.where(F.col("held") & (F.length("w") >= 20)).select(_score(F.col("w"), ratios).alias("x"))
    limit = scored.agg(F.percentile_approx("x", 1 - false_positives, 10_000)).collect()[0][0]
    return Models(ratios, max(0.0, limit or 0.0))


def scan(documents: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text, found (an array of (kind, start, stop) by start and
    kind), and the columns named in ``carry``."""
    more = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    text = F.col("text")
    spans = docs.select(
        "*",
        _places(text, ASSIGN, 1, 8).alias("assign"), _places(text, ACCESS, 0, 16).alias("access"),
        _places(text, "[0-9a-f]{32,}", 0, 32).alias("hex"), _places(text, TOKEN, 0, 20).alias("token"),
    )
    base = F.concat("assign", "access", "hex")

    def pieces(t: Column) -> Column:
        """What no base span covers of a token, in runs that are long enough themselves."""
        empty = F.array().cast(_SPANS)
        part = lambda a, b: F.struct(a.alias("start"), b.alias("stop"), F.substr(t["word"], a - t["start"] + 1, b - a).alias("word"))
        run = lambda a, b: F.when(b - a >= 20, F.array(part(a, b))).otherwise(empty)
        begin = F.struct(t["start"].alias("at"), empty.alias("out"))

        def step(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], run(acc["at"], b["start"])).alias("out"))

        def cut(touching: Column) -> Column:
            rest = F.aggregate(F.array_sort(touching), begin, step, lambda acc: F.concat(acc["out"], run(acc["at"], t["stop"])))
            return F.when(F.size(touching) == 0, F.array(t)).otherwise(rest)

        return _bound(F.filter(base, lambda b: (b["start"] < t["stop"]) & (b["stop"] > t["start"])), cut)

    spans = spans.withColumn("piece", F.flatten(F.transform("token", pieces)))
    spans = spans.withColumn("random", F.filter("piece", lambda t: _score(t["word"], models.ratios) > models.per_pair))
    every = [F.transform(k, _tagged(i)) for i, k in enumerate(KINDS)]
    return spans.select("doc_id", "text", F.array_sort(F.concat(*every)).alias("found"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])


def _tagged(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.filter("found", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
    )


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every run of covered characters replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        first = F.when((acc["at"] == 0) & (s["start"] == 0), F.lit(mask))
        touching = F.when((s["start"] == acc["at"]) & (s["start"] > 0), F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.coalesce(before, first, touching, F.lit(""))).alias("out"))

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
