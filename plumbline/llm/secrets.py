"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters, one of random strings and one of ordinary identifiers, are counted
from labelled samples with a GROUP BY. A candidate token is a secret if the mean log-likelihood ratio of its
transitions is above a threshold that falls with its length. Expressions only; the table of ratios has a fixed size, classes x classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER

# The patterns of the base kinds, in their order, with the shortest length that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "markov")

#: Characters of candidates; any other is one further class. A candidate holds a digit and a letter, or a capital behind
#: a small letter: words of prose do neither, and the models know no prose.
ALPHABET = LOWER + UPPER + "0123456789+/_=-"
MIN_CHARS, MIN_RATIO = 16, 0.75
#: Length from which MIN_RATIO holds; shorter candidates need as much more as they are shorter.
FULL_CHARS = 24
_C = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_C})(?={_C}{{{MIN_CHARS}}})(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?={_C}*?[a-z][A-Z])){_C}++"
_SPAN = "array<struct<start:int,end:int,kind:int,size:int,text:string>>"


#: Words that ordinary identifiers of the default samples are made of.
STEMS = (
    "account action address allow amount append array attribute average background batch binary block body boolean bottom bounds branch browser buffer "
    "build button byte cache camera cancel case category cell center change channel check child class click client clock close cluster code color column "
    "command comment compare compile compute config connect context control convert copy count create current custom data database date day debug decode "
    "default define delete depth describe device dictionary difference directory display distance document domain double download dynamic edge element "
    "email empty encode engine environment equal error evaluate event exception exchange execute expand export expression external extract factory feature "
    "field file filter final first flag float folder format forward frame frequency function get graph group handler hash header height hidden hour "
    "identity image import index info initialize input insert integer internal item iterator join kernel key keyboard language last layer layout length "
    "level library limit line link list load local lock logic main manager map mask match matrix maximum memory message method minimum model module month "
    "name next node open page parse path read request response row save server service set start stop table test text time total trace tree user value "
    "video view warning width write year"
).split()


def default_samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(text, label): n random strings (1) and n ordinary identifiers (0), drawn by hash of a row number.

    Random ones are hexadecimal or base64 digits. Identifiers have three or four stems in snake, kebab, path or camel style,
    some of them all in capitals, some with a number in the middle or at the end.
    """
    draw = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most)).cast("int")
    base64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)))
    hexes = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256)
    rand = F.when(draw("r", 3) == 0, F.substring(hexes, 1, 40)).otherwise(F.substring(base64, 1, 40))
    sep = F.element_at(F.array(*map(F.lit, ("_", "-", "/", "", "=", "_"))), draw("s", 6) + 1)
    camel = (draw("u", 3) == 0) | (sep == "")
    pick = lambda salt: F.element_at(F.array(*map(F.lit, STEMS)), draw(salt, len(STEMS)) + 1)
    word = lambda salt: F.when(camel, F.initcap(pick(salt))).otherwise(pick(salt))
    number = lambda salt, share, most: F.when(draw(salt, share) == 0, F.concat(F.when(draw(salt + "s", 2) == 0, sep).otherwise(F.lit("")), draw(salt + "n", most).cast("string"))).otherwise(F.lit(""))
    first = F.when(draw("f", 2) == 0, word("a")).otherwise(pick("a"))
    fourth = F.when(draw("w", 2) == 0, F.concat(sep, word("d"))).otherwise(F.lit(""))
    styled = F.concat(first, number("x", 4, 130), sep, word("b"), number("y", 4, 130), sep, word("c"), fourth, number("z", 2, 3000))
    ids = spark.range(n)
    ordinary = F.when((draw("k", 4) == 0) & (sep != ""), F.upper(styled)).otherwise(styled)
    return ids.select(rand.alias("text"), F.lit(1).alias("label")).union(ids.select(ordinary, F.lit(0)))


def _class(char: Column) -> Column:
    """A character's place in ALPHABET, from 1; 0 for others."""
    return F.position(char, F.lit(ALPHABET))


def _classes(text: Column) -> Column:
    return F.transform(F.split(text, ""), _class)


def _steps(text: Column) -> Column:
    """The places of a text's transitions in the table of ratios."""
    size = len(ALPHABET) + 1
    codes = _classes(text)
    rest = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), rest), F.slice(codes, F.lit(2), rest), lambda a, b: a * size + b)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition, random (label 1) against ordinary (label 0).

    Counts are made by Spark; what comes to the driver has at most 2 x classes^2 rows whatever the samples' number.
    Null texts and labels and texts of fewer than two characters teach nothing; no samples give a table of zeros.
    """
    from math import log

    size = len(ALPHABET) + 1
    steps = samples.where("text is not null and label is not null").select(F.col("label").cast("int").alias("label"), F.explode(_steps(F.col("text"))).alias("step"))
    counts = {(r["label"], r["step"]): r["count"] for r in steps.groupBy("label", "step").count().collect()}
    out = [0.0] * (size * size)
    for a in range(size):
        rows = [[counts.get((label, a * size + b), 0) + smoothing for b in range(size)] for label in (0, 1)]
        for b in range(size):
            out[a * size + b] = log(rows[1][b] / sum(rows[1])) - log(rows[0][b] / sum(rows[0]))
    return out


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a text's transitions; 0 without any."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    steps = _steps(text)
    return F.aggregate(F.transform(steps, lambda s: F.get(table, s)), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(steps), F.lit(1))


def least_ratio(size: Column, min_ratio: float = MIN_RATIO) -> Column:
    """The mean ratio that a candidate of ``size`` characters must exceed."""
    return F.lit(min_ratio) * F.greatest(F.lit(1.0), F.lit(float(FULL_CHARS)) / size)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: lambdas would work out a plain expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, plus, levels: int = 3, width: int = 64) -> Column:
    """Running totals under ``plus`` (0 is neutral) of a non-empty array. Parts of ``width`` are totalled by themselves and
    then raised by what stands before them, found the same way a level up, so the cost grows with the length only."""
    fold = lambda part: F.aggregate(part, F.lit(0), plus)
    run = lambda part: F.transform(part, lambda _, i: fold(F.slice(part, F.lit(1), i + 1)))
    if not levels:
        return _let(values, run)

    def raised(parts: Column) -> Column:
        before = _let(_running(F.transform(parts, fold), plus, levels - 1, width), lambda t: F.concat(F.array(F.lit(0)), F.slice(t, F.lit(1), F.size(t) - 1)))
        return F.flatten(F.zip_with(F.transform(parts, run), before, lambda part, low: F.transform(part, lambda x: plus(low, x))))

    split = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.slice(v, k * width + 1, F.lit(width)))
    return _let(values, lambda v: _let(split(v), raised))


def _located(df: DataFrame, text: str, pattern: str, kind: int, into: str, group: int = 0) -> DataFrame:
    """``df`` with ``into``: all leftmost non-overlapping matches of ``pattern`` in the column ``text``.

    The text between them is what split() leaves, so lengths give places. Steps are columns of their own, so each is
    worked out once. ``size`` is the length of ``group`` in the match.
    """
    hits, gaps, ends = (f"{into}__{x}" for x in ("hits", "gaps", "ends"))
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(F.col(text).rlike(pattern), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.split(F.col(text), pattern, -1)).otherwise(none))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.col(hits), lambda g, h: F.length(g) + F.length(h))
    df = df.withColumn(ends, F.when(some, lengths))
    df = df.withColumn(ends, F.when(some, _running(F.col(ends), lambda a, b: a + b)))
    size = (lambda h: F.length(F.regexp_extract(h, pattern, group))) if group else F.length
    struct = lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), size(h).alias("size"), h.alias("text"))
    return df.withColumn(into, F.when(some, F.zip_with(F.col(ends), F.col(hits), struct)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)).drop(ends)


def _blanked(df: DataFrame, text: str, into: str, least: int) -> DataFrame:
    """``text`` with the matches that ``_located`` put into ``into``, those of ``least`` size, overwritten by blanks."""
    hits, gaps = f"{into}__hits", f"{into}__gaps"
    hide = F.zip_with(F.col(gaps), F.zip_with(F.col(hits), F.col(into), lambda h, s: F.when(s["size"] >= least, F.repeat(F.lit(" "), F.length(h))).otherwise(h)), lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    return df.withColumn(text, F.when(F.size(hits) > 0, F.array_join(hide, "")).otherwise(F.col(text))).drop(hits, gaps)


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", min_ratio: float = MIN_RATIO, into: str = "spans") -> DataFrame:
    """``docs`` with one more column ``into``: array<struct<start, end, kind, size, text>>, sorted by start and kind.

    Places are code points, end exclusive; kind is an index of KINDS. The base kinds come from the patterns. The base
    spans are then blanked and what is left is searched for candidates, so a token that holds one still has its rest
    judged; a candidate whose mean ratio is above ``min_ratio`` (more for short ones) is of kind markov. Null and empty texts have no spans;
    every whole text is scanned, in time that grows with its length. Repeated rows and null ids are rows like others, an
    empty table gives no rows. Other columns stay, whatever their names; an earlier column ``into`` is replaced.
    """
    own = "s"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    text, rest = f"{own}text", f"{own}rest"
    kinds = [f"{own}{k}" for k in KINDS]
    found = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(rest, F.col(text))
    for k, (name, pattern, group, least) in enumerate(zip(kinds, (ASSIGN, ACCESS, HEX), (2, 0, 0), (ASSIGN_CHARS, 0, 0))):
        found = _located(found, text, pattern, k, name, group)
        if k:  # what earlier kinds have blanked is not given back: their matches are sought in the rest once more
            found = found.drop(f"{name}__hits", f"{name}__gaps")
            found = _located(found, rest, pattern, k, f"{name}r")
            found = _blanked(found, rest, f"{name}r", 0).drop(f"{name}r")
        else:
            found = _blanked(found, rest, name, least)
    found = found.withColumn(kinds[0], F.filter(kinds[0], lambda s: s["size"] >= ASSIGN_CHARS))
    found = _located(found, rest, CANDIDATE, 3, kinds[3]).drop(f"{kinds[3]}__hits", f"{kinds[3]}__gaps")
    found = found.withColumn(kinds[3], F.when(F.size(kinds[3]) > 0, F.filter(kinds[3], lambda c: mean_ratio(c["text"], ratios) > least_ratio(c["size"], min_ratio))).otherwise(F.col(kinds[3])))
    return found.withColumn(into, F.array_sort(F.concat(*kinds))).drop(text, rest, *kinds)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text, one row per document."""
    found = scan(docs.select("doc_id", "text"), ratios)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count(3).alias("n_markov"),
    )


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``; overlapping spans become one mark.

    Texts without secrets, and nulls, stay as they are.
    """
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    found = scan(docs, ratios, text_col, into=spans)
    text = F.col(text_col)
    # A piece of text goes before every span that begins beyond all earlier ones; one join writes them all.
    reach = f"{spans}reach"
    found = found.withColumn(reach, F.when(F.size(spans) > 0, _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
    piece = lambda s, i: F.when((i > 0) & (s["start"] < before(i)), F.lit("")).otherwise(F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit(mark)))
    last = F.substring(text, F.get(reach, F.size(spans) - 1) + 1, F.length(text))
    new = F.concat(F.array_join(F.transform(spans, piece), ""), last)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, new).otherwise(text)).drop(spans, reach)
