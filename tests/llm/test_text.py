"""Byte-pair encoding, packing, token counts, secrets, toxicity and languages."""
import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helpers import awkward, docs_of, empty
from vocalake.llm import bpe, language, packing, secrets, tokens, toxicity
from vocalake.llm.queries import QUERIES

ODD_TEXTS = [
    "", " ", "a", "don't we'll I'M 'sss", "x  y\u0085 z\x1c\x1d q　", "12345 ½²Ⅷ", "𐐨𐐩 日本語 ßäöü é", "a" * 3000,
    "\r\n\t  \n", "<|endoftext|> text", "'", "\\ \\n '", "".join(chr(c) for c in range(1, 700)), "ab " * 500,
]


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoder():
    return tokens.load_encoding(public_tokenizers.path(bpe.RANK_FILE))[0]


def test_encoding_equals_the_library(spark, data, texts, encoder):
    rows = QUERIES["op1_bpe"](spark, data).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        ids = encoder.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_of_odd_texts(spark, encoder):
    docs = docs_of(spark, ODD_TEXTS)
    encoded = bpe.encode(docs)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {i: encoder.encode_ordinary(t) for i, t in enumerate(ODD_TEXTS)}
    decoded = encoded.select("id", bpe.decode(spark, F.col("ids")).alias("data")).collect()
    assert {r["id"]: bytes(r["data"]).decode() for r in decoded} == dict(enumerate(ODD_TEXTS))
    clashing, rows = awkward(spark)
    got = bpe.encode(clashing)
    assert got.columns == ["id", "ids"] and got.count() == len(rows)
    assert got.filter("id = 1").first()["ids"] == []
    assert bpe.encode(empty(spark)).count() == 0


def packed_well(rows, capacity):
    """Sequences have no gap and no overlap and keep to the capacity; their number."""
    places = {}
    for row in rows:
        places.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_of_the_documents(spark, data, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = QUERIES["op2_best_fit_packing"](spark, data).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    total = 0
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            row = pieces.pop((doc, piece))
            assert (row["start"], row["length"], row["ids_crc32"]) == (lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
    assert not pieces
    assert packed_well(rows, 2048) <= -(-total // 2048) + 2


def test_plans_of_random_histograms():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randrange(4, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 60))]
        histogram = {n: lengths.count(n) for n in lengths}
        rows, used = [], {}
        for length, lo, hi, times, sequence, offset in packing.pack_lengths(histogram, capacity):
            assert used.get(length, 0) == lo
            used[length] = hi
            rows += [
                {"sequence_id": sequence + i // times, "offset": offset + i % times * length, "length": length}
                for i in range(hi - lo)
            ]
        assert used == histogram
        gaps = []
        for length in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((capacity if fit is None else fit) - length)
        assert packed_well(rows, capacity) <= len(gaps) + 1


def test_exact_complements_fill_every_sequence():
    runs = packing.pack_lengths({6: 5, 4: 5, 7: 2, 2: 2, 1: 2, 5: 3, 3: 3}, 10)
    assert max(run[4] + (run[2] - run[1]) // run[3] for run in runs) == (30 + 20 + 14 + 4 + 2 + 15 + 9 + 9) // 10


def test_packing_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    pieces = packing.token_pieces(docs, with_ids=True)
    assert pieces.groupBy("id").count().filter("id IN (1, 2)").collect()[0]["count"] == 1
    packed = packing.pack(pieces)
    found = packed.collect()
    assert len(found) == pieces.count() and packed_well(found, 2048)
    assert all(len(r["ids"]) == r["length"] for r in found)
    assert sorted(r["length"] for r in found if r["id"] == 6)[1:] == [2048] * (len([r for r in found if r["id"] == 6]) - 1)
    assert packing.pack(packing.token_pieces(empty(spark))).count() == 0


def brute_line_counts(text, encoder):
    ids = encoder.encode_ordinary(text)
    data, at, spans = text.encode(), 0, []
    for piece in encoder.decode_tokens_bytes(ids):
        spans.append((at, at + len(piece)))
        at += len(piece)
    lines = text.split("\n")
    parts = [l + "\n" for l in lines[:-1]] + ([lines[-1]] if lines[-1] or not lines[:-1] else [])
    out, lo, char = [], 0, 0
    for i, part in enumerate(parts):
        hi = lo + len(part.encode())
        own = [s for s in spans if lo <= s[0] < hi]
        out.append((i, char, char + len(part), len(own), sum(s[1] > hi for s in own)))
        lo, char = hi, char + len(part)
    assert lo == len(data)
    return out


def test_line_token_counts_against_brute_force(spark, data, texts):
    encoder = tokens.load_encoding(public_tokenizers.path(tokens.RANK_FILE))[0]
    got = {}
    for r in QUERIES["op6_token_counts"](spark, data).collect():
        got.setdefault(r["doc_id"], []).append(
            (r["section"], r["char_start"], r["char_end"], r["n_tokens"], r["n_crossing"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_line_counts(t or "", encoder) for k, t in texts.items()}
    odd = tokens.line_token_counts(docs_of(spark, ODD_TEXTS)).drop("id").collect()
    assert sorted(map(tuple, odd)) == sorted(row for t in ODD_TEXTS for row in brute_line_counts(t, encoder))
    docs, rows = awkward(spark)
    assert tokens.line_token_counts(docs).filter("id = 1").collect()[0]["n_tokens"] == 0
    assert tokens.line_token_counts(empty(spark)).count() == 0


def test_field_token_counts(spark):
    rows = spark.createDataFrame([(1, "user", "", None, "hello world"), (2, None, None, None, None)], "id long, a string, b string, c string, d string")
    got = tokens.field_token_counts(rows, "id", ["a", "b", "c", "d"]).orderBy("id", "section").collect()
    encoder = tokens.load_encoding(public_tokenizers.path(tokens.RANK_FILE))[0]
    assert [r["section"] for r in got] == [0, 1, 2, 3] * 2
    assert sum(r["n_tokens"] for r in got) == len(encoder.encode_ordinary("userhello world"))
    assert [r["char_end"] - r["char_start"] for r in got] == [4, 0, 0, 11, 0, 0, 0, 0]
    assert [r["n_tokens"] for r in got if r["char_start"] == r["char_end"]] == [0] * 6


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


NUMBERS = [der(2, b"\x01" * n) for n in (60, 3, 60, 30, 30, 30, 30, 30)]
OLD_KEY = der(0x30, der(2, b"\0"), *NUMBERS)
NEW_KEY = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, OLD_KEY))
CURVE_KEY = der(0x30, der(2, b"\x01"), der(4, b"k" * 32), der(0xA0, der(6, b"\x2a\x86")))
SSH_KEY = b"openssh-key-v1\0" + b"\0\0\0\x04none" + b"\0\0\0\x04none" + b"\0\0\0\0" + b"\0\0\0\x01" + b"rest" * 9


def encoded(part):
    return base64.urlsafe_b64encode(json.dumps(part).encode()).decode().rstrip("=")


def test_structures_are_confirmed():
    assert secrets.is_der_key(OLD_KEY) and secrets.is_der_key(NEW_KEY) and secrets.is_der_key(CURVE_KEY)
    assert not secrets.is_der_key(OLD_KEY[:-1]) and not secrets.is_der_key(OLD_KEY + b"\0") and not secrets.is_der_key(b"")
    assert not secrets.is_der_key(der(0x30, der(2, b"\0"), der(2, b"\x01")))
    assert secrets.is_ssh_key(SSH_KEY) and not secrets.is_ssh_key(SSH_KEY[:18])
    token = f"{encoded({'alg': 'HS256'})}.{encoded({'sub': 'someone'})}.c2lnbmF0dXJl"
    assert secrets.is_signed_token(token)
    for wrong in (f"{encoded({'typ': 'JWT'})}.{encoded({'a': 1})}.x", f"{encoded([1, 2, 3, 4])}.{encoded({'a': 1})}.x", "aaaaaaaa.bbbbbbbb.c"):
        assert not secrets.is_signed_token(wrong)
    found = [
        ("jwt", token), ("der", base64.b64encode(NEW_KEY).decode()), ("der", OLD_KEY.hex().upper()),
        ("openssh", base64.b64encode(SSH_KEY).decode()),
    ]
    for kind, secret in found:
        text = f"ä see {secret} there"
        assert (kind, 6, 6 + len(secret)) in secrets.scan(text), kind
    lines = base64.encodebytes(NEW_KEY).decode()
    block = f"-----BEGIN PRIVATE KEY-----\n{lines}-----END PRIVATE KEY-----"
    assert ("pem", 2, 2 + len(block)) in secrets.scan(f"x {block} y")
    assert "pem" not in [s[0] for s in secrets.scan(block.replace("M", "N", 1))]
    assert secrets.masked(f"x {block} y", secrets.scan(f"x {block} y")) == "x [SECRET] y"


def brute_base(text):
    """The three base patterns as the contract states them."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_query_against_brute_force(spark, data, texts):
    rows = QUERIES["op4_secret_scan"](spark, data).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = brute_base(texts[row["doc_id"]] or "")
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [
            sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_of_made_up_texts():
    rng = random.Random(2)
    words = [
        "token", "TOKEN", "ToKen", "api_key", "apikey", "password", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA",
        "0123456789abcdef", "ab", "Ab1", "é", "K", "ſecret", "secret=", "==", "/+"]
    for _ in range(3000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))
        assert [s for s in secrets.scan(text) if s[0] in secrets.BASE_KINDS] == brute_base(text)


def test_secrets_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    assert secrets.find_secrets(docs).count() == len(rows)
    masked = secrets.mask_secrets(docs)
    assert masked.schema == docs.schema and sorted(map(repr, masked.collect())) == sorted(map(repr, docs.collect()))
    assert secrets.find_secrets(empty(spark)).count() == 0 and secrets.mask_secrets(empty(spark)).count() == 0


SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, SMALL).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    area = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert area > 0.85
    assert np.mean([s >= 0.7 for s in clean]) < 0.03
    marked = [r for r in rows if r["predicted"]]
    assert marked and all(r["toxic_spans"] for r in marked)


def test_marginals_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        field = toxicity.Field({}, 0.0, rng.uniform(0.2, 3, (2, 2)).tolist(), [], 0.0)
        x = rng.uniform(0.1, 5, 6).tolist()
        weight = {}
        for path in product((0, 1), repeat=6):
            w = field.transitions[0][path[0]]
            for t, state in enumerate(path):
                w *= x[t] if state else 1
                w *= field.transitions[path[t - 1]][state] if t else 1
            weight[path] = w
        total = sum(weight.values())
        expected = [sum(w for p, w in weight.items() if p[t]) / total for t in range(6)]
        odds = field.marginals(x)
        assert np.allclose(odds / (1 + odds), expected)


def test_toxicity_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    none = toxicity.train([], {})
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    one_sided = toxicity.train([("a b", 1)], {1: 1})
    assert toxicity.score_toxicity(docs, one_sided).filter("score = 1").count() == len(rows)
    trained = toxicity.train([("bad nasty", 1), ("good", 0), (None, 0), ("", 1)] * 20, {0: 40, 1: 40})
    assert toxicity.score_toxicity(docs, trained).count() == len(rows)
    assert toxicity.without_toxic(docs, none).schema == docs.schema
    assert toxicity.without_toxic(docs, none).count() == len(rows) and toxicity.without_toxic(docs, one_sided).count() == 0
    assert toxicity.score_toxicity(empty(spark), trained).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (4, 0), (77, 1)], "doc_id long, toxic int")
    field = toxicity.train_on(docs, labels)
    assert toxicity.score_toxicity(docs, field).count() == len(rows)


def test_languages_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, SMALL).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert len(held) > 200 and np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


ENGLISH = "the cat sat on the mat and the dog went with them to that other house where they were"
FRENCH = "le chat est sur la table avec une souris et les oiseaux qui chantent dans les arbres"
GREEK = "και το σπίτι είναι μεγάλο με την πόρτα"


def test_mixed_text_is_cut_into_spans():
    model = language.train([(ENGLISH, "en"), (FRENCH, "fr"), (GREEK, "el")] * 2)
    letters = language.Letters()
    text = f"{ENGLISH}. {FRENCH}! {GREEK}"
    main, share, spans = language.label_text(text, model, letters)
    assert main == "fr" and 0.3 < share < 0.6
    assert [(s["lang"], text[s["start"]:s["end"]]) for s in spans] == [("en", ENGLISH), ("fr", FRENCH), ("el", GREEK)]
    assert language.label_text("12 ½ ... ", model, letters) == ("und", 0.0, [])
    assert language.label_text("Привет", model, letters)[:2] == ("el", 0.0)


def brute_viterbi(scores, switch):
    from itertools import product

    return max(
        sum(row[s] for row, s in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        for path in product(range(scores.shape[1]), repeat=len(scores))
    )


def test_viterbi_finds_a_best_path():
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores, switch = rng.normal(0, rng.choice([0.3, 2, 5]), (7, 3)), 4.0
        path = language.viterbi(scores, switch)
        value = scores[np.arange(7), path].sum() - switch * (np.diff(path) != 0).sum()
        assert np.isclose(value, brute_viterbi(scores, switch))


def test_languages_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    model = language.train_on(docs)
    found = language.identify_languages(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r for r in found}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[7]["lang_pred"] == "und"
    none = language.train([])
    assert {r["lang_pred"] for r in language.identify_languages(docs, none).collect()} == {"und"}
    assert language.identify_languages(empty(spark), model).count() == 0
