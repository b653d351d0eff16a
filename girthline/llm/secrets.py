"""Secrets in text: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Both models hold the probability of each character after another; a run of identifier characters counts as a secret
when the log-likelihood ratio of the two is high enough. Runs are what the patterns leave; a run that isn't random as a
whole is judged again by its parts between separators. How high is enough is fitted on the labelled sample: above what
nearly all ordinary runs have. Everything is DataFrame code; the driver sees the model only (at most 68 x 68 counts a
class, and the threshold).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, let, unused, written

#: Kinds in the order that breaks ties, with pattern, the group that is the secret, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Cheap tests that hold wherever a pattern can match well; only texts that pass are searched.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Runs that the models judge, and their parts.
RUN_CHARS, RUN_LEAST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 8
RUN, PART, SEPARATORS = "[A-Za-z0-9+/_=-]", "[A-Za-z0-9+]", "[/_=-]"
#: Where the patterns match well enough, for texts in which they do: a run ends where one begins.
TAKEN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""
#: The threshold is this much above the ratio that only this share of the ordinary runs exceeds, and at least this for each character.
MARGIN, EXCEEDED, EACH = 5.0, 1e-5, 0.4
#: Training: documents whose words are ordinary identifiers, about, and made random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 6000
#: Alphabets of the made random strings: hexadecimal, base 36 in both cases, base 62, and base 64 in both forms.
ALPHABETS = tuple(RUN_CHARS[a:b] + more for a, b, more in ((52, 62, "abcdef"), (26, 62, ""), (0, 26, "0123456789"), (0, 62, ""), (0, 64, ""), (0, 62, "-_")))
MASK = "[SECRET]"
#: The rows of a keyboard, alone and one after another; and identifiers that are random by design, but public.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertyuiopasdfghjkl", "asdfghjklzxcvbnm", "qwertyuiopasdfghjklzxcvbnm", "1234567890qwertyuiop")
PUBLIC = "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def running(steps: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of ints, in blocks, so that long arrays stay near linear."""
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    sums = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    starts = lambda s: F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
    whole = lambda s: let(
        F.transform(starts(s), lambda k: sums(F.slice(s, k * block + 1, F.lit(block)))),
        lambda within: let(sums(F.transform(within, last)), lambda ends: F.flatten(F.transform(within, lambda w, k: let(F.coalesce(F.get(ends, k - 1), F.lit(0)), lambda base: F.transform(w, lambda x: x + base))))),
    )
    return let(steps, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(none))


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group is long enough: array of (start, kind, end, secret)."""

    def of(whole: Column) -> Column:
        gaps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.concat(F.array(F.lit("")), whole).alias("before"))
        steps = F.slice(F.transform(gaps, lambda x: F.length(x["gap"]) + F.length(x["before"])), F.lit(1), F.size(whole))
        part = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
        rows = F.arrays_zip(running(steps).alias("at"), whole.alias("whole"), part.alias("part"))
        found = F.transform(rows, lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["whole"])).alias("end"), x["part"].alias("secret")))
        return F.filter(found, lambda x: F.length(x["secret"]) >= least)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), of)


def none_() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,secret:string>>")


def base_spans(text: Column) -> list[Column]:
    low = F.lower(text)
    worth = [low.contains(WORDS[0]), F.contains(text, F.lit("AKIA")), text.rlike("[0-9a-f]{32}")]
    for w in WORDS[1:]:
        worth[0] = worth[0] | low.contains(w)
    # Short hex runs are dropped anyway, so the pattern itself can skip them.
    return [F.when(ok, spans(text, k, p if name != "hex" else f"[0-9a-f]{{{least},}}", g, least)).otherwise(none_()) for k, (ok, (name, p, g, least)) in enumerate(zip(worth, KINDS))]


@dataclass(frozen=True)
class Model:
    """ratios: of each character after another (or at the start), row by row, 68 x 68 whatever the sample; threshold: in all."""

    ratios: tuple[float, ...]
    threshold: float


def made_strings(spark: SparkSession, n: int, salt: str = "random") -> DataFrame:
    """(string, alphabet): n random strings of 8 to 64 characters, alphabets in turn; the same ones at each call."""
    chars = F.element_at(F.array(*map(F.lit, ALPHABETS)), (F.col("id") % len(ALPHABETS) + 1).cast("int"))
    size = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(57)).cast("int") + 8
    pick = lambda i: F.substring(chars, F.pmod(F.xxhash64(F.lit(salt), "id", i), F.length(chars)).cast("int") + 1, F.lit(1))
    return spark.range(n).select(F.array_join(F.transform(F.sequence(F.lit(1), size), pick), "").alias("string"), (F.col("id") % len(ALPHABETS)).cast("int").alias("alphabet"))


def labelled_sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(string, random): made random strings, and runs of 6 and more characters from about `most_docs` documents, without
    those that the fixed patterns take. The runs count once as they are and once in upper case, which is as ordinary; so are
    numbers, dates and times, of which some are made, rows of keys, and identifiers, which are three words of a document
    joined in one of twelve ways, some with acronyms, versions and numbers."""
    n = max(1, docs.count())
    picked = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(min(1.0, most_docs / n) * (1 << 30))))
    clean = picked.select(F.regexp_replace("text", TAKEN, " ").alias("text"))
    runs = clean.select(F.explode(F.regexp_extract_all("text", F.lit(RUN + "{6,}"), 0)).alias("run"))
    words = clean.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0).alias("w")).where("size(w) >= 3")
    one, cap = lambda i, k: F.lower(F.get("w", 3 * i + k)), lambda i, k: F.initcap(F.get("w", 3 * i + k))
    digits = lambda i, k, most: F.pmod(F.xxhash64(F.lit(k), one(i, 0), i), F.lit(most)).cast("string")
    short = lambda i, k: F.upper(F.substring(F.get("w", 3 * i + k), F.lit(1), F.lit(2) + i % 3))
    technical = lambda i: (F.concat(short(i, 0), cap(i, 1), cap(i, 2)), F.concat(cap(i, 0), short(i, 1), cap(i, 2)), F.concat(one(i, 0), digits(i, 1, 10000), F.lit("_"), one(i, 1), digits(i, 2, 100)), F.concat_ws("_", one(i, 0), digits(i, 3, 20), digits(i, 4, 40), digits(i, 5, 300)), F.concat_ws("-", one(i, 0), one(i, 1), F.concat(F.lit("v"), digits(i, 6, 30)), digits(i, 7, 2100)), F.concat_ws("-", short(i, 0), digits(i, 8, 1000000)))
    ways = lambda i: F.array(*technical(i), F.concat(one(i, 0), cap(i, 1), cap(i, 2)), F.concat(cap(i, 0), cap(i, 1), cap(i, 2)), *(F.concat_ws(c, one(i, 0), one(i, 1), one(i, 2)) for c in "_-/"), F.upper(F.concat_ws("_", one(i, 0), one(i, 1), one(i, 2))))
    joined = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), lambda i: F.get(ways(i), i % 12))).alias("string"))
    number = F.substring(F.concat(*(F.pmod(F.xxhash64(F.lit("number"), "id", F.lit(k)), F.lit(10**10)).cast("string") for k in (1, 2))), F.lit(1), F.lit(6) + (F.col("id") % 14).cast("int"))
    numbers = docs.sparkSession.range(most_random // 3).select(number.alias("string"))
    when = F.timestamp_seconds(F.pmod(F.xxhash64(F.lit("time"), "id"), F.lit(2**31)))
    forms = F.array(*(F.date_format(when, f) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd_HHmmss")))
    times = docs.sparkSession.range(most_random // 3).select(F.get(forms, (F.col("id") % 4).cast("int")).alias("string"))
    keys = docs.sparkSession.range(30).select(F.explode(F.array(*(F.lit(f(k)) for k in KEYS for f in (str, str.upper)))).alias("string"))
    numbers = numbers.unionByName(times).unionByName(keys)
    ordinary = runs.select(F.explode(F.array("run", F.upper("run"))).alias("string")).unionByName(joined).unionByName(numbers)
    return made_strings(docs.sparkSession, most_random).select("string", F.lit(True).alias("random")).unionByName(ordinary.withColumn("random", F.lit(False)))


def fit(docs: DataFrame) -> Model:
    """The model of a table: ratios and threshold from one bounded, written sample."""
    sample = written(labelled_sample(docs), "strings")
    ratios = train(sample)
    of_ordinary = sample.where(f"NOT random AND length(string) >= {RUN_LEAST}").select(ratio(F.col("string"), ratios).alias("r"))
    most = of_ordinary.agg(F.percentile_approx("r", 1 - EXCEEDED, 1_000_000)).first()[0]
    forget(sample)
    return Model(tuple(ratios), MARGIN + max(0.0, most if most is not None else 0.0))


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each character after another (or at the start), row by row.

    Transitions are counted for each class and smoothed; the result has 68 x 68 entries whatever the sample.
    """
    n = len(RUN_CHARS)
    chars = labelled.where("string <> ''").select("random", F.split("string", "").alias("c"))
    pairs = chars.select("random", F.explode(F.transform("c", lambda c, i: F.struct(F.when(i > 0, F.get("c", i - 1)).alias("a"), c.alias("b")))).alias("p"))
    place = lambda c: F.coalesce(F.instr(F.lit(RUN_CHARS), F.col(c)), F.lit(0))  # noqa: E731  0: the start
    counts = pairs.groupBy("random", place("p.a").alias("a"), place("p.b").alias("b")).agg(F.count("*").alias("n")).where("b > 0").collect()
    seen = {(r["random"], r["a"], r["b"]): r["n"] for r in counts}
    out = []
    for a in range(n + 1):
        total = [sum(seen.get((k, a, b), 0) for b in range(1, n + 1)) + smooth * n for k in (False, True)]
        out.append(0.0)
        for b in range(1, n + 1):
            p, q = ((seen.get((k, a, b), 0) + smooth) / total[k] for k in (True, False))
            out.append(round(math.log(p / q), 6))
    return out


def ratio(run: Column, model: Sequence[float]) -> Column:
    """The log-likelihood ratio of a run under the model that train() gave."""
    n = len(RUN_CHARS) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(RUN_CHARS), c))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("prev"))
    return F.aggregate(at, start, lambda acc, x: F.struct((acc["sum"] + F.get(table, acc["prev"] * n + x)).alias("sum"), x.alias("prev")), lambda acc: acc["sum"])


def judged(runs: Column, model: Model) -> Column:
    """Of (start, kind, end, secret) those that are random, or the random parts of those that aren't."""
    good = lambda x: ratio(x["secret"], model.ratios) >= F.greatest(F.lit(model.threshold), F.length(x["secret"]) * EACH)

    def parts(x: Column) -> Column:
        found = F.filter(spans(x["secret"], len(KINDS), f"{PART}{{{RUN_LEAST},}}", 0, RUN_LEAST), good)
        return F.transform(found, lambda p: F.struct((p["start"] + x["start"]).alias("start"), p["kind"].alias("kind"), (p["end"] + x["start"]).alias("end"), p["secret"].alias("secret")))

    public = lambda x: (F.length(x["secret"]) == 36) & F.rlike(x["secret"], F.lit(PUBLIC))
    return F.flatten(F.transform(runs, lambda x: F.when(public(x), none_()).when(good(x), F.array(x)).when(x["secret"].rlike(SEPARATORS), parts(x)).otherwise(none_())))


def scan(docs: DataFrame, model: Model, base: str, every: str) -> DataFrame:
    """All columns of `docs`, and two of the names given: arrays of (start, kind, end, secret), sorted, of the fixed
    patterns and of all kinds.

    Code points, end exclusive; kinds 0 to 2 are the fixed patterns, 3 the models' runs, which never touch a span of
    the patterns: where there are any, the search takes up the patterns' matches too and leaves them out, so that what
    stands beside them is judged on its own. Null text is the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(base, F.array_sort(F.concat(*base_spans(text))))
    free = spans(text, len(KINDS), f"{RUN}{{{RUN_LEAST},}}", 0, RUN_LEAST)
    beside = spans(text, len(KINDS), f"(?:{TAKEN})|((?:(?!{TAKEN}){RUN})+)", 1, RUN_LEAST)
    random = let(F.when(F.size(base) == 0, free).otherwise(beside), lambda runs: judged(runs, model))
    apart = F.filter(random, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn(every, F.array_sort(F.concat(base, apart)))


def as_text(found: str) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("markov"))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row of `docs`.

    Null text is the empty text: no spans, and the digest of nothing. Null ids and repeated rows get a row each; spans
    that begin together come in the order of the kinds; an empty table gives an empty result; other columns are ignored.
    Very long texts are searched whole, in time that grows with their length (and with the square of the number of
    patterns' matches times random runs, where a text has many of both).
    """
    found = scan(docs.select("doc_id", "text"), fit(docs) if model is None else model, "base", "every")
    count = lambda k: F.size(F.filter("every", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)), F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("every").alias("spans"), count(len(KINDS)).alias("n_markov"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with every secret replaced by a mask; of an assignment only the value.

    Overlapping secrets become one mask. Texts without secrets are unchanged, null texts stay null; null ids, repeated
    rows and other columns stay as they are; an empty table gives an empty result. Very long texts are masked whole.
    """
    base, every = unused(docs, "base", "every")
    found = scan(docs, fit(docs) if model is None else model, base, every)
    text = F.col("text")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        part = F.when(x["begin"] + 1 >= acc["at"], F.concat(acc["out"], F.array(F.concat(F.substring(text, acc["at"], x["begin"] + 1 - acc["at"]), F.lit(MASK))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"] + 1).alias("at"), part.alias("out"))

    by_secret = F.array_sort(F.transform(every, lambda x: F.struct((x["end"] - F.length(x["secret"])).alias("begin"), x["end"].alias("end"))))
    new = F.aggregate(by_secret, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"], F.length(text))))
    return found.withColumn("text", F.when(F.size(every) > 0, new).otherwise(text)).select(*docs.columns)
