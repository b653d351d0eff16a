"""Line-first cleaning and the Merkle manifest against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from girthline.llm import cleaning, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dups = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside), failed


def bad_line(line):
    n, low = len(WORD.findall(line)), "".join(c.lower() if c < "\x7f" else c for c in line)
    marks = lambda group: sum(line.count(c) for c in group)
    crowded = lambda k: k > 2 and 4 * k >= n
    bare = n >= 4 and not re.search(r"[.!?…。！？:;][\x20\x09-\x0D\"'”’»)\]]*$", line) and 40 * marks(".!?…。！？") < n
    link = n <= 4 and low.strip(" \t\n\v\f\r").rstrip(" \t\n\v\f\r.:>") in cleaning.LINKS
    return bare or crowded(line.count("!!")) or crowded(marks("#*$%&|<>")) or crowded(marks("|»›·•→")) or link or (n <= 30 and any(p in low for p in cleaning.PHRASES))


def verdict(text):
    lines = list(dict.fromkeys(x for x in (text or "").split("\n") if WORD.search(x)))
    good = [x for x in lines if not bad_line(x)]
    return good, sum(len(w) for x in good for w in WORD.findall(x))


def expected(text):
    found = base(text)
    good, chars = verdict(text)
    return (*found, not found[5] and 2 * chars >= found[1], chars, len(good))


def prose(rng, words):
    return " ".join("".join(rng.choices("abcdefghiéß", k=rng.randint(2, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(words)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    clean = [prose(rng, n) for n in (49, 50, 60, 200)]
    rows = ["", None, " \t\n ", "\n\n\n", "one", "a b c", "a b c a b c", "x " * 200, "same line here.\n" * 40, *clean]
    rows += [clean[3] + "\n" + "Home | About | Contact | Log in\n" * 3 + "All rights reserved.\nRead more >", "\n".join([clean[3], "home", clean[2], "© 2020 A B C"])]
    rows += [" | ".join(prose(rng, 80).split()), " ".join(w + "###" for w in prose(rng, 90).split()), " ".join(w.upper() + "!!" for w in prose(rng, 90).split()), "no marks at all " + " ".join(prose(rng, 100).replace(".", "").split())]
    rows += [clean[3] + "\n" + " ".join(f"w{i}" for i in range(150)), clean[3][:-1] + '."', "Zitat: „ja“ (so).\r\n" + clean[3], "😀 é\x0b x" * 60 + clean[3], "a b c d " * 3 + clean[3], "we use cookies. " + clean[3]]
    rows += [prose(rng, 30_000), "z" * 1_000_000 + " " + prose(rng, 100), "\n".join(prose(rng, 3) for _ in range(2000))]
    return rows


def test_cleaning(spark, texts):
    ids = [*range(len(texts)), None, 3]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, [*texts, texts[10], texts[3]])], "doc_id long, text string, n_words int, kept string")
    got = cleaning.judge(docs).collect()
    want = [(i, *expected(t)) for i, t in zip(ids, [*texts, texts[10], texts[3]])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert cleaning.judge(docs.where("doc_id = -1")).count() == 0
    kept = cleaning.cleaned(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.select("doc_id", "text").collect()))) == sorted(str((i, "\n".join(verdict(t)[0]))) for i, t in zip(ids, [*texts, texts[10], texts[3]]) if expected(t)[6])
    rules = {(r["doc_id"], r["line"]): r["rules"] for r in cleaning.by_rule(docs).collect()}
    assert rules[13, 1] == ["punctuation", "symbols", "navigation"] and rules[13, 4] == ["boilerplate"] and rules[13, 5] == ["navigation"] and rules[14, 1] == ["navigation"]
    assert {i for i, _ in rules} == {i for i, t in zip(ids, texts) if any(bad_line(x) for x in (t or "").split("\n") if WORD.search(x))}


def test_clean_prose_stays(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "\n".join(prose(rng, rng.randint(20, 90)) for _ in range(4)) + ("\nAll rights reserved." if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    assert cleaning.judge(docs).where("NOT kept").count() == 0


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """Root, and for each node the list of (place, run) on the way up."""
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            way[k].append((i % 16, runs[i // 16]))
        at = [i // 16 for i in at]
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], way


def plain_manifest(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        x = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = x, *tree([leaf(r) for r in x])
    root, over = tree([trees[s][1] for s in order])
    for s, above in zip(order, over):
        x, sub, ways = trees[s]
        for r, way in zip(x, ways):
            cur = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                cur = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            proof = ""
            for p, run in way + above:
                proof += "".join(run[:p] + run[p + 1 :])
                cur = digest("".join([*run[:p], cur, *run[p + 1 :]]))
            out.append((r[0], leaf(r), sub, root, digest(proof), cur, cur == root))
    return out


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, d binary, i int")
    return merkle.manifest(docs)


def check(spark, rows):
    assert sorted(map(str, map(tuple, manifest_rows(spark, rows).collect()))) == sorted(map(str, plain_manifest(rows)))


def test_manifest(spark):
    rng = random.Random(2)
    rows = [(i, ["hot", "hot", "b", None, "é", ""][i % 6], "en", i, f"Text {i} É {rng.random()}") for i in range(400)]
    rows += [rows[7], rows[7], (7, "hot", None, None, None), (None, "hot", "x", 1, "No Id"), (None, None, None, None, None), (2**60 + 1, "alone", "en", -1, "A" * 3_000_000), (5, "hot", "en", 0, ""), (-3, "b", "en", 1, "Minus")]
    check(spark, rows)
    assert manifest_rows(spark, rows).where("NOT verified").count() > 50
    assert manifest_rows(spark, rows).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    check(spark, rows[:1])
    check(spark, rows[:2])
    assert manifest_rows(spark, []).count() == 0


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4096, 4097, 8200])
def test_manifest_over_blocks(spark, n):
    """One source at the edges of runs and blocks, beside small ones."""
    check(spark, [(i, "big", "en", i, f"T{i}") for i in range(n)] + [(n, "small", "en", 1, "S"), (n + 1, None, "en", 1, "S")])


def test_manifest_over_many_sources(spark):
    check(spark, [(i, f"s{i % 4500}", "en", i, f"T{i}") for i in range(4600)])


def test_ranges_do_not_matter(spark, monkeypatch):
    rows = [(i % 300, "s", "en", i, f"T{i}") for i in range(2000)]
    monkeypatch.setattr(merkle, "RANGE", 70)
    check(spark, rows)
