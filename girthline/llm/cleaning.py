"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

Everything is DataFrame code on one row a document: a text is split into lines and words once, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, WORD, let, unused

#: The base rule's symbols.
SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence, and those that may follow them.
ENDS = ".!?…。！？"
CLOSERS = "\"'”’»)]"
#: Marks between the entries of a menu.
SEPARATORS = "|»›·•→"
#: Short lines that are nothing but a link or a button, and phrases of lines that a site prints on every page.
LINKS = ("home", "menu", "log in", "login", "sign in", "sign up", "register", "search", "share", "print", "next", "previous", "back to top", "skip to content", "read more", "click here", "contact us", "about us", "subscribe", "comments", "reply", "site map")
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "use of cookies", "uses cookies", "cookie policy", "enable javascript", "licensed under", "released under the", "copyright (c)", "©", "lorem ipsum", "click here", "powered by")

#: Words of a line from which a missing sentence mark counts, and words within which one must stand.
PUNCTUATED, SENTENCE = 4, 40
#: Marks of one kind that a line may hold however short it is; beyond, one to this many words is too many.
FEW, SPARSE = 2, 4
#: Words of the longest line that a phrase condemns, as a phrase in a long paragraph is prose about it; and of a link's name.
SHORT, LINK_WORDS = 30, 4
#: Fewest words, most percent of words in repeated windows, least percent of characters that must survive.
LEAST_WORDS, MOST_REPEATED, LEAST_KEPT = 50, 50, 50


def count_of(text: Column, marks: str) -> Column:
    """How many characters of `text` are among `marks`."""
    return F.regexp_count(text, F.lit(f"[{marks}]"))


def letters(text: Column) -> Column:
    """Code points that are not white space."""
    return F.char_length(text) - F.regexp_count(text, F.lit(f"[{SPACES}]"))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]")))


def crowded(marks: Column, words: Column) -> Column:
    return (marks > FEW) & (marks * SPARSE >= words)


def fails(line: Column) -> dict[str, Column]:
    """The rules by name, true where a line with words fails: each is one or two counts over the line.

    punctuation: four or more words and no sentence mark at the end, nor one to 40 words; or `!!` at every fourth word.
    symbols: more than two symbols, and one or more to four words.
    navigation: more than two menu marks, one or more to four words; or the line, of at most four words, is the name of a link.
    boilerplate: at most 30 words with a phrase that sites print on every page.
    """
    words = F.regexp_count(line, F.lit(WORD))
    plain = F.translate(line, UPPER, LOWER)
    shouts = F.regexp_count(line, F.lit("!!"))
    bare = ~F.rlike(line, F.lit(f"[{ENDS}:;][{SPACES}{regex_class(CLOSERS)}]*$")) & (count_of(line, ENDS) * SENTENCE < words)
    return {
        "punctuation": ((words >= PUNCTUATED) & bare) | crowded(shouts, words),
        "symbols": crowded(count_of(line, SYMBOLS), words),
        "navigation": crowded(count_of(line, SEPARATORS), words) | (words <= LINK_WORDS) & F.rlike(plain, F.lit(f"^[{SPACES}]*(?:{'|'.join(LINKS)})[{SPACES}.:>]*$")),
        "boilerplate": (words <= SHORT) & F.rlike(plain, F.lit("|".join(p.replace("(", "[(]").replace(")", "[)]") for p in PHRASES))),
    }


def regex_class(marks: str) -> str:
    return marks.replace("]", "\\]")


def any_of(rules: dict[str, Column]) -> Column:
    first, *rest = rules.values()
    for r in rest:
        first = first | r
    return first


def surviving(lines: Column) -> Column:
    """Lines that no rule fails, a repeated one once, where it comes first."""
    return F.array_distinct(F.filter(lines, lambda x: ~let(x, lambda line: any_of(fails(line)))))


def repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a window of three words found twice or more.

    Windows are compared as whole strings. Texts without a repeat, which a hash set tells, are not sorted; in others
    equal windows come together by sorting, and the words that their positions cover are added up.
    """
    w, n = F.col(words), F.size(words)
    tri, by_text, at = unused(docs, "tri", "by_text", "at")
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    x = docs.withColumn(tri, F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
    ordered = F.sort_array(F.transform(tri, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    x = x.withColumn(by_text, F.when(F.size(F.array_distinct(tri)) < F.size(tri), ordered))
    same = lambda k, other: F.get(F.col(by_text), k)["s"].eqNullSafe(F.get(F.col(by_text), other)["s"])
    repeats = F.filter(F.sequence(F.lit(0), F.size(by_text) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    x = x.withColumn(at, F.sort_array(F.transform(repeats, lambda k: F.get(F.col(by_text), k)["i"])))
    covered = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get(F.col(at), k - 1)), F.lit(3)))
    return x.withColumn(out, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop(tri, by_text, at)


def measured(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with the base counts, the survivors and the verdict under names that no column of `docs` has, and the names."""
    names = unused(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "kept", "survivors", "words", "lines", "text")
    n_words, chars, symbols, dups, repeats, failed, kept_chars, kept, survivors, words, lines, text = names
    x = docs.withColumn(text, F.coalesce("text", F.lit("")))
    x = x.withColumn(words, F.array_remove(F.split(text, f"[{SPACES}]+"), "")).withColumn(lines, lines_of(F.col(text)))
    x = x.withColumn(n_words, F.size(words).cast("long")).withColumn(chars, letters(F.col(text)).cast("long")).withColumn(symbols, count_of(F.col(text), SYMBOLS).cast("long"))
    x = x.withColumn(dups, (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    x = repeated_words(x, words, repeats).drop(words)
    x = x.withColumn(failed, (F.col(n_words) < LEAST_WORDS) | (100 * F.col(repeats) > MOST_REPEATED * F.col(n_words)))
    x = x.withColumn(survivors, surviving(F.col(lines))).withColumn(kept_chars, letters(F.array_join(survivors, "")).cast("long"))
    x = x.withColumn(kept, ~F.col(failed) & (100 * F.col(kept_chars) >= LEAST_KEPT * F.col(chars)))
    # A filter on the verdict must not be pushed below the steps above: it would put each into the next, lambdas included.
    found = F.struct(*names[:9])
    return x.select(*docs.columns, F.inline(F.array(found))), names


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars, n_kept_lines.

    A document is kept unless the base rule fails it or its surviving lines hold less than half of its characters,
    white space aside. Null and empty texts have no words, so the base rule fails them; null ids and repeated rows get a
    row each; equal lines of a text count once among the survivors; a very long text is judged whole in its row; an empty
    table gives an empty result; other columns, of any names, are ignored.
    """
    x, names = measured(docs.select("doc_id", "text"))
    n_words, chars, symbols, dups, repeats, failed, kept_chars, kept, survivors, *_ = names
    as_named = [F.col(a).alias(b) for a, b in zip((n_words, chars, symbols, dups, repeats, failed, kept, kept_chars), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"), strict=True)]
    return x.select("doc_id", *as_named, F.size(survivors).cast("long").alias("n_kept_lines"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with all their columns; the text is its surviving lines. Cases are as there."""
    x, names = measured(docs)
    kept, survivors = names[7], names[8]
    return x.where(kept).select(*(F.array_join(survivors, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def by_rule(docs: DataFrame) -> DataFrame:
    """doc_id, line (number from 0 among those with words), and the rules that it fails, for each line that fails one."""
    x = docs.select("doc_id", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("line", "text"))
    found = [F.when(hit, F.lit(name)) for name, hit in fails(F.col("text")).items()]
    return x.withColumn("rules", F.array_compact(F.array(*found))).where(F.size("rules") > 0).select("doc_id", "line", "rules")


def sql_marks(text: str, marks: str) -> str:
    return f"(length({text}) - length(translate({text}, '{marks}', '')))"


_LINK = f"^[{SPACES}]*(?:{'|'.join(LINKS)})[{SPACES}.:>]*$"
_PHRASE = "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in PHRASES)
_END = f"[{ENDS}:;][{SPACES}{regex_class(CLOSERS)}]*$".replace("'", "''")
_NO_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The same rules for DuckDB, line by line and window by window as rows.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
g AS (SELECT r, unnest(range(len(ws) - 2)) AS i, unnest([ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] FOR k IN range(1, len(ws) - 1)]) AS s FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n >= 2),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM h, (VALUES (0), (1), (2)) AS t(o) GROUP BY r),
l AS (SELECT r, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT r, string_split(t, chr(10)) AS x FROM d)),
m AS (SELECT r, k, line, len(regexp_extract_all(line, '{WORD}')) AS n, translate(line, '{UPPER}', '{LOWER}') AS plain,
        length(translate(line, {_NO_BLANKS}, '')) AS c FROM l),
j AS (SELECT r, k, line, c, (n >= {PUNCTUATED} AND NOT regexp_matches(line, '{_END}') AND {sql_marks("line", ENDS)} * {SENTENCE} < n)
    OR (len(regexp_extract_all(line, '!!')) > {FEW} AND len(regexp_extract_all(line, '!!')) * {SPARSE} >= n)
    OR ({sql_marks("line", SYMBOLS)} > {FEW} AND {sql_marks("line", SYMBOLS)} * {SPARSE} >= n)
    OR ({sql_marks("line", SEPARATORS)} > {FEW} AND {sql_marks("line", SEPARATORS)} * {SPARSE} >= n) OR (n <= {LINK_WORDS} AND regexp_matches(plain, '{_LINK}'))
    OR (n <= {SHORT} AND regexp_matches(plain, '{_PHRASE}')) AS bad FROM m WHERE n > 0),
a AS (SELECT r, count(*) - count(DISTINCT line) AS dups FROM j GROUP BY r),
o AS (SELECT r, sum(c) AS c, count(*) AS n FROM (SELECT DISTINCT r, line, c FROM j WHERE NOT bad) GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {_NO_BLANKS}, ''))::BIGINT AS word_chars, {sql_marks("t", SYMBOLS)}::BIGINT AS n_symbols,
        coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(o.c, 0)::BIGINT AS kept_chars, coalesce(o.n, 0)::BIGINT AS n_kept_lines
      FROM w LEFT JOIN p USING (r) LEFT JOIN a USING (r) LEFT JOIN o USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= {LEAST_KEPT} * word_chars AS kept, kept_chars, n_kept_lines FROM f
"""
