"""Quality rules, fill-in-the-middle and the filter audit against plain Python."""
import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from helpers import awkward, docs_of, empty
from vocalake.llm import fill_middle, filter_audit, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.escape("".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {p + i for places in at.values() if len(places) > 1 for p in places for i in range(3)}
    stop = re.compile(rf"[{MARK}]*({'|'.join(quality.STOP_WORDS.split())})[{MARK}]*", re.ASCII | re.IGNORECASE)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_stop_words": sum(bool(stop.fullmatch(w)) for w in words),
        "n_bullet_lines": sum(line.lstrip(" \t\r\x0b\x0c")[0] in "•‣▪*-" for line in lines),
        "n_ellipsis_lines": sum(line.rstrip(" \t\r\x0b\x0c").endswith(("...", "…")) for line in lines),
    }


def odd_texts():
    rng = random.Random(5)
    words = ["the", "(The)", "und", "Für,", "a", "b", "c", "x#y", "***", "...", "12", "ÄÖ", "-", "• q", "e…"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "\n", "\t", " \n"]) for _ in range(rng.randrange(90)))
             for _ in range(80)]
    return texts + ["", None, " \t\n", "a", "a a", "a a a", "a a a a", "x y z x y z", "\n\na\n\na\n\n", "word " * 20_000]


def test_quality_measures_against_plain_python(spark):
    texts = odd_texts()
    got = {r["id"]: r.asDict() for r in quality.quality_measures(docs_of(spark, texts)).collect()}
    assert {i: {k: v for k, v in row.items() if k != "id"} for i, row in got.items()} == dict(
        enumerate(map(brute_quality, texts)))


def test_quality_verdicts_follow_the_table(spark):
    texts = odd_texts()
    for row in quality.judge_quality(docs_of(spark, texts)).collect():
        m = brute_quality(texts[row["id"]])
        broken = [
            r.name for r in quality.THRESHOLDS
            if (r.at_least is not None and m[r.part] * (100 if r.whole else 1) < r.at_least * m.get(r.whole, 1))
            or (r.at_most is not None and m[r.part] * (100 if r.whole else 1) > r.at_most * m.get(r.whole, 1))
        ]
        assert row["failed"] == broken and row["kept"] == (not broken)
        assert row["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
    strict = (quality.Rule("any_symbol", "n_symbols", at_most=0),)
    kept = quality.judge_quality(docs_of(spark, ["a # b", "a b"]), thresholds=strict)
    assert [r["kept"] for r in kept.orderBy("id").collect()] == [False, True]


def test_quality_keeps_good_documents_and_needs_no_shuffle(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge_quality(docs)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not [part for part in ("Exchange", "Python", "InArrow") if part in plan]
    marked = judged.join(labels, judged["id"] == labels["doc_id"]).filter("quality = 1 OR NOT base_failed")
    shares = {r["quality"]: r["share"] for r in marked.filter("NOT base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.97 and shares.get(0, 0) < 0.1


def test_quality_of_awkward_and_empty_tables(spark):
    docs, rows = awkward(spark)
    judged = quality.judge_quality(docs)
    assert judged.count() == len(rows)
    assert judged.filter("id = 3").distinct().count() == 1
    assert judged.filter("id IS NULL AND n_words = 0").count() == 1
    assert [r["n_words"] for r in judged.filter("id IN (1, 2, 7)").collect()] == [0, 0, 0]
    assert quality.judge_quality(empty(spark)).count() == 0


def brute_middle(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", prefix, middle, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rates", [(50, 80), (100, 50), (0, 0)])
def test_fill_middle_against_plain_python(spark, rates):
    rng = random.Random(6)
    pieces = ["a", "ß", "𐐨x", "<", "P>", "<S", ">", " ", "\n", "\t ", "$1", "\\", "(x", "M>", "\x00", "\x85", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, " ", " x", "x ", "a <P> b", "a <S> b <M>", "word \n" * 100_000, "y" * 300_000]
    got = fill_middle.fill_middle(docs_of(spark, texts), rate=rates[0], spm_rate=rates[1]).withColumn(
        "back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row["id"]]
        assert (row["n"], row["form"], row["prefix"], row["middle"], row["output"]) == brute_middle(
            row["id"], text, *rates), repr(text)[:80]
        assert row["back"] == (text or "")


def test_fill_middle_of_awkward_and_empty_tables(spark):
    docs, rows = awkward(spark)
    got = fill_middle.fill_middle(docs, rate=100)
    assert got.columns == ["id", "n", "form", "prefix", "middle", "suffix", "output"]
    assert sorted((r["id"] is None, r["id"], r["n"], r["output"]) for r in got.collect() if r["id"] is not None) == sorted(
        (False, i, *[brute_middle(i, t, 100)[k] for k in (0, 4)]) for i, t, _ in rows if i is not None)
    assert sorted(r["output"] for r in got.filter("id IS NULL").collect()) == sorted(
        brute_middle(None, t, 100)[4] for i, t, _ in rows if i is None)
    assert fill_middle.fill_middle(empty(spark)).count() == 0


def brute_audit(rows, marks):
    """``rows``: (id, text, part); ``marks``: id -> (good, toxic)."""
    failing = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        letters = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        failing.append((part or "", {k for k, v in letters.items() if v}, *marks.get(i, (0, 0))))
    out, removals = [], {}
    for part in {f[0] for f in failing}:
        mine = [f[1:] for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            alive = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [f for f in alive if letter in f[0]]
                alive = [f for f in alive if letter not in f[0]]
                removals[part, letter] = removals.get((part, letter), 0) + len(gone)
                out.append((
                    part, "".join(order), step, len(alive), len(gone), sum(letter in f[0] for f in mine) - len(gone),
                    sum(f[0] == {letter} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone),
                ))
    return sorted((*row, removals[row[0], row[1][row[2] - 1]]) for row in out)


def test_audit_against_simulated_orders(spark):
    rng = random.Random(9)
    texts = [
        " ".join(rng.choice(["aa", "Bb", "CC", "d#", f"w{rng.randrange(900)}"]) for _ in range(rng.choice([3, 60, 90])))
        for _ in range(50)
    ]
    rows = [(i, rng.choice(texts + ["", None]), rng.choice(["p", "q", "r", None])) for i in range(160)]
    rows += [(7, "again", "p"), (7, "again", "q"), (8, "again", "q"), (None, "again", "p"), (None, None, "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(2, 1, 1), (None, 1, 1)]
    marks = {}
    for i, good, toxic in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], good or 0), max(old[1], toxic or 0))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, part string, id string")
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, marks)


def test_path_counts_and_edges():
    reaching, leaving = filter_audit.path_counts(4)
    for state in range(16):
        size = bin(state).count("1")
        assert reaching[state] == [1, 1, 2, 6, 24][size] and leaving[state] == [1, 1, 2, 6, 24][4 - size]
    edges = filter_audit.lattice_edges(4)
    assert len(edges) == 32 and sum(n for _, f, n in edges if f == 2) == 24
    steps = filter_audit.order_steps("WXYZ")
    assert len(steps) == 96 and len({s[0] for s in steps}) == 24


def test_audit_of_other_filters_and_empty_tables(spark):
    rows = spark.createDataFrame([("p", 1, 1, 0), ("p", 3, 0, 1), ("p", None, None, None), (None, 2, 0, 0)],
                                 "part string, fails int, good int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.filter_interactions(rows, "xy").collect()}
    assert len(got) == 8
    first, second = got["p", "xy", 1], got["p", "xy", 2]
    assert (first["kept"], first["removed"], first["redundant"], first["unique_fails"]) == (1, 2, 0, 1)
    assert (second["kept"], second["removed"], second["redundant"], second["shapley"]) == (1, 0, 1, 1)
    assert (first["good_lost"], first["toxic_lost"], first["shapley"]) == (1, 1, 3)
    assert got["", "yx", 1]["removed"] == 1
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.filter_interactions(rows, letters)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(empty(spark), labels).count() == 0
