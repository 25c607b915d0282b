"""Exact, line and near deduplication."""
import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import awkward, docs_of, empty, near_texts
from vocalake.llm.components import connected
from vocalake.llm.exact_dedup import exact_groups
from vocalake.llm.line_dedup import dedup_lines
from vocalake.llm import near_dedup
from vocalake.llm.queries import ORACLES, QUERIES


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n in ORACLES])
def test_query_matches_sql(name, spark, data):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    result = connection.execute(ORACLES[name])
    names = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == names
    assert values(df.select(*names)) == expected


def test_exact_groups_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    found = exact_groups(docs)
    assert found.columns == ["id", "keep_id", "group_size", "kept", "digest"]
    keep = {(r["id"], r["digest"]): (r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()}
    assert found.count() == len(rows)
    same = [v for (i, _), v in keep.items() if i in (3, 4)]
    assert same == [(4, 4, False), (4, 4, True)] or sorted(same) == [(4, 4, False), (4, 4, True)]
    assert {v[:2] for (i, _), v in keep.items() if i in (1, 2)} == {(2, 3)}
    assert exact_groups(empty(spark)).count() == 0


def test_exact_groups_compare_contents_when_digests_collide(spark):
    texts = ["aa", "AA", "ab", "b", "b", "c", ""]
    docs = docs_of(spark, texts)
    expected = values(exact_groups(docs).drop("digest"))
    for weak in (lambda c: F.substring(c, 1, 1), lambda c: F.lit("same")):
        assert values(exact_groups(docs, digest=weak).drop("digest")) == expected


def brute_lines(texts):
    """Ids count up, so the first occurrence is the first in order."""
    firsts, out = {}, []
    for doc, text in enumerate(texts):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            key = tuple(lines[at:at + 3])
            if not "".join(key).strip(" \t\r\n\f\x0b"):
                continue
            first = firsts.setdefault(key, (doc, at))
            if first != (doc, at):
                gone |= set(range(max(at, first[1] + 3) if first[0] == doc else at, at + 3))
        out.append((doc, len(lines), len(gone), "\n".join(l for i, l in enumerate(lines) if i not in gone)))
    return out


def test_line_windows_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += ["a\nb\nc\n" * 4000, "x\nx\nx\nx\nx\nx", "\n\n\n\n", ""]
    got = dedup_lines(docs_of(spark, texts)).select("row.doc_id", "n_lines", "n_removed", "text")
    assert values(got) == sorted(brute_lines(texts), key=repr)


def test_line_windows_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    found = dedup_lines(docs)
    assert found.count() == len(rows)
    assert found.select("row.*").columns == docs.columns
    by_id = {r["row"]["doc_id"]: r for r in found.collect() if r["row"]["doc_id"] is not None}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0
    assert by_id[2]["text"] == "" and by_id[7]["n_removed"] == 0
    assert by_id[5]["text"] == "a\nb\nc"
    assert dedup_lines(empty(spark)).count() == 0


def test_line_windows_run_without_python(spark, data):
    plan = QUERIES["op9_line_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if node in plan]


def brute_components(texts, percent=85):
    sets = []
    for text in texts:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        width = min(5, len(words))
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set())
    label = list(range(len(texts)))
    links = [
        (a, b) for a in range(len(texts)) for b in range(a)
        if (shared := len(sets[a] & sets[b])) and 100 * shared >= percent * len(sets[a] | sets[b])
    ]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((i, len(s), label[i], label[i] == i) for i, s in enumerate(sets))


def test_near_components_against_brute_force(spark):
    texts = near_texts() + ["a b", "A B", "a b c", "", "a b c d e", "a b c d e f"]
    got = near_dedup.near_components(docs_of(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_near_components_of_one_large_group(spark):
    """Copies with a few changed words link through others; no pair between components may be missed."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            copy[rng.randrange(90)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    got = near_dedup.near_components(docs_of(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_members_in_blocks_against_brute_force(spark, monkeypatch):
    import random

    for name, value in (("FEW", 2), ("BLOCK", 16), ("AT_ONCE", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(120):
        copy = list(base[:90 - rng.choice((0, 0, 5, 9))])
        for _ in range(rng.choice((0, 1, 2, 3))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    got = near_dedup.near_components(docs_of(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_blocks_of_a_hot_key_emit_only_near_pairs(spark):
    """5 000 members of one key in as many components; two pairs have equal sketches, one of them too unlike in size."""
    import numpy as np

    sketches = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63, (5_000, near_dedup.SKETCH_BITS // 64))
    sketches[4_321], sketches[17] = sketches[40], sketches[900]
    sizes = np.full(5_000, 100)
    sizes[17] = 50
    rows = [(1, i, i, 0, int(sizes[i]), sketches[i].tolist()) for i in range(5_000)]
    members = spark.createDataFrame(rows, "key long, id long, component long, main long, n long, sketch array<long>")
    assert [tuple(r) for r in near_dedup.candidates(members, 85).collect()] == [(40, 4_321)]
    assert near_dedup.candidates(members.limit(0), 85).count() == 0


def test_blocks_and_joins_allow_the_same_flips(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n, other = rng.integers(1, 5_000, 300), rng.integers(1, 5_000, 300)
    allowed = near_dedup.flips_allowed(n, other, 85)
    flips = np.clip(np.floor(allowed)[:, None] + [0, 1], 0, near_dedup.SKETCH_BITS).astype(int)
    words = near_dedup.SKETCH_BITS // 64
    rows = []
    for a, b, pair in zip(n, other, flips):
        for k in pair:
            bits = np.zeros(near_dedup.SKETCH_BITS, np.uint8)
            bits[:k] = 1
            rows.append((int(a), int(b), int(k), np.packbits(bits).view(np.int64).tolist(), [0] * words))
    frame = spark.createDataFrame(rows, "n long, m long, k long, s array<long>, t array<long>")
    told = frame.select("n", "m", "k", near_dedup.may_link(F.col("n"), F.col("s"), F.col("m"), F.col("t")).alias("near")).collect()
    for r in told:
        size = 100 * min(r["n"], r["m"]) >= 85 * max(r["n"], r["m"])
        assert r["near"] == (size and r["k"] <= near_dedup.flips_allowed(np.array([r["n"]]), np.array([r["m"]]), 85)[0])


def test_near_components_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    found = near_dedup.near_components(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["id"] is not None}
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[7] == (0, 7, True)
    assert by_id[3] == (3, 3, True) and by_id[4] == (3, 3, False) and by_id[9] == (1, 9, True)
    assert all(r["component_id"] is None and r["kept"] for r in found if r["id"] is None)
    assert near_dedup.near_components(empty(spark)).count() == 0


def test_odd_sketches_never_rule_out_small_links(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        size, shared = int(rng.integers(1, 3_000)), rng.uniform(0.85, 1.0)
        base = rng.integers(0, 2 ** 63, size).astype(np.uint64)
        keep = int(np.ceil(2 * shared / (1 + shared) * size))
        other = np.concatenate([base[:keep], rng.integers(0, 2 ** 63, size - keep).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            rows.append((len(a), near_dedup.odd_sketch(a).tolist(), len(b), near_dedup.odd_sketch(b).tolist()))
    pairs = spark.createDataFrame(rows, "n long, s array<long>, m long, t array<long>")
    assert pairs.filter(near_dedup.may_link(F.col("n"), F.col("s"), F.col("m"), F.col("t"))).count() == len(rows) > 300


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
