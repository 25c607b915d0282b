"""The whole language query against a version in plain Python, trained and run on the same small table."""
import math
import zlib
from collections import Counter, defaultdict

import pytest

from vocalake.llm import language
from vocalake.llm.queries import QUERIES


def script(char):
    return next((name for name, first, last in language.SCRIPTS if first <= ord(char) <= last), "other")


def lowered(char):
    return char.lower() if len(char.lower()) == 1 and ord(char) < 65_536 else char


def words(text):
    """The runs of letters of a text."""
    found, run = [], ""
    for char in (text or "") + " ":
        if char.isalpha():
            run += char
        elif run:
            found.append(run)
            run = ""
    return found


def triples(word):
    edged = ["", *map(lowered, word), ""]
    return [tuple(edged[i:i + 3]) for i in range(len(word))]


class Plain:
    def __init__(self, rows):
        counts, letters = defaultdict(Counter), defaultdict(Counter)
        for lang, text in set(rows):
            for word in words(text):
                counts[lang].update(triples(word))
                letters[lang][script(word[0])] += len(word)
        self.languages = sorted(counts)
        known = set().union(*counts.values())
        assert max(map(len, counts.values())) <= language.MAX_GRAMS  # no triple is left out
        total = {g: sum(counts[g].values()) + 0.5 * (len(known) + 1) for g in self.languages}
        self.log = {t: [math.log((counts[g][t] + 0.5) / total[g]) for g in self.languages] for t in known}
        self.unknown = [math.log(0.5 / total[g]) for g in self.languages]
        self.writes = {
            g: {s for s, n in letters[g].items() if n >= language.MIN_SCRIPT_SHARE * sum(letters[g].values())}
            for g in self.languages}

    def scores(self, word):
        places = range(len(self.languages))
        sums = [sum(self.log.get(t, self.unknown)[i] for t in triples(word)) for i in places]
        able = [i for i in places if script(word[0]) in self.writes[self.languages[i]]]
        if not able:
            chances = [1 / len(places)] * len(places)
        else:
            top = max(sums[i] for i in able)
            weights = [math.exp(sums[i] - top) if i in able else 0.0 for i in places]
            chances = [w / sum(weights) for w in weights]
        return [math.log((c + language.FLOOR) / (1 + len(places) * language.FLOOR)) for c in chances]

    def predict(self, text):
        found = words(text)
        if not found:
            return "und", 0.0
        places = range(len(self.languages))
        best, origins, seen = None, [], {}
        for word in found:
            if word not in seen:
                seen[word] = self.scores(word)
            if best is None:
                best = list(seen[word])
                continue
            came = [max(places, key=lambda i: (best[i] - language.SWITCH * (i != j), i == j)) for j in places]
            best = [best[came[j]] - language.SWITCH * (came[j] != j) + seen[word][j] for j in places]
            origins.append(came)
        path = [max(places, key=lambda i: best[i])]
        for came in reversed(origins):
            path.append(came[path[-1]])
        path.reverse()
        sizes = Counter()
        for word, place in zip(found, path):
            sizes[place] += len(word)
        main = max(places, key=lambda i: sizes[i])
        name = self.languages[main]
        telling = sum(len(w) for w, p in zip(found, path) if p == main and script(w[0]) in self.writes[name])
        return name, telling / sum(sizes.values())


def test_language_query_equals_plain_python(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    per_language = Counter(r["lang"] for r in rows)
    assert max(per_language.values()) <= language.SAMPLE_PER_LANGUAGE  # the sample holds the whole fold
    held_out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    model = Plain([(r["lang"], r["text"]) for r in rows if not held_out[r["doc_id"]] and r["lang"] and r["text"] is not None])
    expected = {r["doc_id"]: model.predict(r["text"]) for r in rows}
    found = QUERIES["op10_language_id"](spark, data).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(expected)
    for r in found:
        name, share = expected[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (held_out[r["doc_id"]], name)
        assert r["score"] == pytest.approx(share, abs=1e-9)
