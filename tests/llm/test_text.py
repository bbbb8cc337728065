import pickle
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinolex.llm import leaks, lookalike, sentences


def test_composition_equals_nfc():
    rng = random.Random(1)
    pool = [*range(0x41, 0x17F), *range(0x300, 0x345), *range(0x300, 0x345), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0x900, 0x9FF), *range(0x1E00, 0x1FFF), 0x3099, 0x309A, *range(0x304B, 0x3060)]
    for _ in range(500):
        texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 8))) for _ in range(4)]
        nfd = [unicodedata.normalize("NFD", t) for t in texts]
        cp = np.array([ord(c) for t in nfd for c in t], np.uint32)
        row = np.array([k for k, t in enumerate(nfd) for _ in t], int)
        got, at = lookalike.compose(cp, row)
        assert ["".join(map(chr, got[at == k])) for k in range(4)] == [unicodedata.normalize("NFC", t) for t in texts]


def test_forms():
    same = [("Ｓｔａｒ　Ｗａｒｓ", "Star Wars"), ("S​tar W­ars", "Star Wars"), ("Ⅱ ﬁn", "II fin"), ("Сорра", "Coppa"), ("café", "café"), ("ｶﾞ", "ガ"), ("half‐life️", "half-life")]
    for a, b in same:
        x, y = lookalike.same_look(pa.array([a, b])).to_pylist()
        assert x == y, (a, b)
    for a, b in [("Star", "star"), ("cafe", "café"), ("a, b", "a; b"), ("x²", "x2"), ("“a”", '"a"')]:
        x, y = lookalike.same_look(pa.array([a, b])).to_pylist()
        assert x != y, (a, b)
    assert lookalike.same_look(pa.array([None, "", "​"])).to_pylist() == [None, "", ""]


def test_same_look_pairs(spark):
    rows = [("m", 1, "Star", 0), ("m", 2, "Ｓtar", 0), ("m", 2, "Ｓtar", 0), ("m", 3, "Star", 0), ("t", 4, "Ｓtar", 0), ("m", 5, None, 0), ("m", 6, " ", 0), ("m", None, "Star", 0), ("m", 7, "x" * 100_000, 0), ("m", 8, "x" * 99_999 + "ｘ", 0)]
    df = spark.createDataFrame(rows, "g string, id int, title string, spelling int")
    assert sorted(map(tuple, lookalike.same_look_pairs(df, "g", "id", "title").collect())) == [("m", 1, 2), ("m", 2, 3), ("m", 7, 8)]
    assert lookalike.same_look_pairs(df.limit(0), "g", "id", "title").count() == 0
    assert "form" in lookalike.with_form(df, "title").columns


ITEM = " ".join(f"word{k}" for k in range(30))


def test_classes_of_one_look(spark):
    """Classes agree with the pairs; a look that a third of the rows share is counted, not paired."""
    rows = [("m", k, ["Star", "Ｓtar", "Stаr"][k % 3]) for k in range(30)] + [("m", 90, "Moon"), ("t", 1, "Star"), ("m", 91, None), ("m", 92, "\u200b")]
    df = spark.createDataFrame(rows, "g string, id int, title string")
    got = {(r.g, r.id): (r.class_id, r.links) for r in lookalike.same_look_classes(df, "g", "id", "title").collect()}
    assert got == {("m", k): (0, 20) for k in range(30)} | {("m", 90): (90, 0), ("t", 1): (1, 0)}
    assert lookalike.same_look_pairs(df, "g", "id", "title").count() == 30 * 20 // 2
    assert lookalike.same_look_classes(df.limit(0), "g", "id", "title").count() == 0


def test_leaks(spark):
    w = ITEM.split()
    texts = {
        1: "Before. " + ITEM.upper() + " After.", 2: "x " + " ".join(w[3:19]) + " y", 3: "x " + " ".join(w[3:18]) + " y",
        4: "-".join(w[:2]) + " " + " ".join(w[2:20]).replace("word9", "wo-\nrd9").replace(" word11", "\n\n  word11"), 5: None, 6: "", 7: " ".join(w[:10]) + " typo " + " ".join(w[10:20]),
        8: ("filler text. " * 20_000) + " ".join(w[5:25]), 9: "pre" + " ".join(w[:16]) + "post",
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(100, ITEM, "x"), (100, ITEM, "x"), (101, "too short to leak", "x"), (102, None, "x")], "item_id bigint, text string, doc_id string")
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == [(1, 100), (2, 100), (4, 100), (8, 100)]
    assert leaks.leaks(docs.limit(0), items).count() == 0
    assert leaks.leaks(docs, items.limit(0)).count() == 0


def test_retrieval_loses_nothing():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(20)]
    index = leaks.Index(items)
    for _ in range(300):
        k = rng.randrange(20)
        at = rng.randrange(24)
        text = " ".join([rng.choice(words) for _ in range(20)] + items[k][1].split()[at : at + 16] + [rng.choice(words) for _ in range(20)])
        _, found = index.retrieve(leaks.passages_of(index, leaks._fold(text)))
        assert k in found
        assert index.holds(*leaks.letters(text), k)


@pytest.mark.parametrize("pairs", range(9))
def test_hyphens_between_words_cost_nothing(pairs):
    rng = random.Random(pairs)
    items = [(k, " ".join(f"t{rng.randrange(3000)}" for _ in range(40))) for k in range(200)]
    index = leaks.Index(items)
    for _ in range(100):
        k, at = rng.randrange(200), rng.randrange(24)
        w = items[k][1].split()[at : at + 16]
        run = [f"{w[2 * x]}-{w[2 * x + 1]}" for x in range(pairs)] + w[2 * pairs :]
        text = leaks._fold(" ".join(["other", "words", *run, "behind"]))
        assert k in index.retrieve(leaks.passages_of(index, text))[1] and index.holds(*leaks.letters(text), k)


def test_wand_equals_all_scores():
    """Pivots and block maxima skip nothing that reaches the threshold; the index is as large as its postings."""
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(1, 900) for _ in range(3))}"
    index = leaks.Index([(k, " ".join(word() for _ in range(rng.randint(16, 60)))) for k in range(300)])
    dense = np.zeros((len(index.vocabulary), len(index.items)))
    for t in range(len(index.vocabulary)):
        span = slice(index.block_post[index.list_block[t]], index.block_post[index.list_block[t + 1]])
        dense[t, index.item[span]] = index.weight[span]
    passages = [np.unique([index.vocabulary[w] for w in (word() for _ in range(rng.randint(0, 90))) if w in index.vocabulary]).astype(np.int64) for _ in range(400)]
    want = {(p, i) for p, terms in enumerate(passages) for i in np.flatnonzero(dense[terms].sum(0) >= 1 - 1e-4)}
    assert want and set(zip(*map(list, index.retrieve(passages)))) == want
    large = leaks.Index([(k, " ".join(f"v{rng.randrange(50_000)}" for _ in range(100))) for k in range(4000)])
    assert len(pickle.dumps(large)) < 20e6


def test_leaks_in_segments(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"s{rng.randrange(500)}" for _ in range(20))) for k in range(60)]
    docs = spark.createDataFrame([(k, f"so {t} it is") for k, t in items], "doc_id bigint, text string")
    got = leaks.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), segment_chars=2000)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k, _ in items]


def _training(n=300):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice(["ba", "ko", "ri", "ne", "tu", "sa"]) for _ in range(3)).capitalize()
    noun = lambda: rng.choice(["town", "ship", "garden", "house", "letter", "storm", "village", "mayor", "paper", "harbour"])
    kinds = [
        lambda: f"Dr. {name()} left the {noun()}.", lambda: f"The {noun()} was near the {noun()}.", lambda: f"Mrs. {name()} saw the {noun()}.", lambda: f"See p. {rng.randint(1, 90)} of the {noun()}.",
        lambda: f"The {noun()} got {rng.randint(1, 9)}.5 points.", lambda: f"Nobody in {name()} knew a {noun()}!",
    ]
    return ["\n\n".join(" ".join(rng.choice(kinds)() for _ in range(rng.randint(1, 5))) for _ in range(2)) for _ in range(n)]


TRAIN = _training()


def test_sentences():
    sample, n = sentences.Sample(TRAIN), Counter()
    for t in TRAIN:
        n.update(sentences.counts_of(t, sentences.parsed(t)[3], sample.keys, sample.words))
    w = sentences.train(sample, n)
    cut = lambda t: [t[a:b] for a, b in sentences.split(t, w)]
    assert cut("Dr. Adams left the town. The ship stayed. See p. 9 of it.") == ["Dr. Adams left the town.", "The ship stayed.", "See p. 9 of it."]
    assert cut("Heading\n\n It rained. \n") == ["Heading", "It rained."]
    assert cut("He said, “Go home! Now.” The ship left the harbour.")[0].startswith("He said, “Go home! Now.”")
    assert cut("แม่ครัวพบจดหมาย นักสืบวาดแผนที่") == ["แม่ครัวพบจดหมาย", "นักสืบวาดแผนที่"]
    assert cut("It was 4.5 points") == ["It was 4.5 points"]
    assert cut(" \n ") == [] and cut("") == []


def test_sentences_cover_the_text(spark):
    rows = [(k, t, 1) for k, t in enumerate(TRAIN[:4])] + [(90, None, 1), (91, "  ", 1), (92, "A long story about the sea. " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, start_pos int")
    got = sentences.sentences(df, "doc_id", "text").collect()
    for k, t, _ in rows:
        spans = sorted((r.start_pos, r.end_pos) for r in got if r.doc_id == k)
        if not t or not t.strip():
            assert not spans
            continue
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() for a, b in spans)
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0
    assert F is not None
