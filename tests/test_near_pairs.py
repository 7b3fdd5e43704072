"""Near-duplicate pairs against every pair compared, and what they write to exchanges."""

import random
import re

from vigilframe.operators import near_pairs
from vigilframe.plans.sql import apply
from vigilframe.queries import QUERIES


def brute(rows):
    sets = {}
    for k, text in rows:
        ws = re.findall("[a-z]+", text.lower()) if k is not None and text is not None else []
        sets.setdefault(k, set()).update(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    ids, out = sorted(k for k in sets if sets[k]), set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 10 * len(x & y) >= 8 * len(x | y):
                out.add((a, b, len(x & y) / len(x | y)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def found(frame):
    out = [tuple(r) for r in frame.collect()]
    assert len(out) == len(set(out))
    return set(out)


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}"
    return " ".join(ws)


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows, k = [], 0
    for size in (3, 4, 9, 40, 90, 700):
        for _ in range(5):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, size // 30, size // 20, size // 12):
                rows.append((k, edited(rng, base, edits)))
                k += 7
    # A passage that most of several texts are made of, and a family of near copies that is larger than BIG.
    passage = [word() for _ in range(60)]
    for extra in range(0, 80):
        rows.append((k, " ".join([*passage, *(word() for _ in range(extra % 20))])))
        rows.append((k + 1, edited(rng, passage, 1 + extra % 3)))
        k += 7
    return rows


def test_pairs_are_those_of_all_sets_compared(spark, monkeypatch):
    rows = documents()
    want = brute(rows)
    assert len(want) > 2_000
    assert found(near_pairs.near_pairs(frame(spark, rows))) == want
    # Groups cut into cells, and copies into parts.
    monkeypatch.setattr(near_pairs, "BLOCK", 6)
    monkeypatch.setattr(near_pairs, "COPIES", 3)
    assert found(near_pairs.near_pairs(frame(spark, rows))) == want


def test_odd_rows(spark):
    rows = [
        (1, "One two, THREE four"), (2, "one-two three4four"), (3, "one two three"), (4, "one two"), (5, ""), (6, None), (None, "one two three four"),
        (7, "one two"), (7, "three four"), (8, "one two three"), (8, "two three four"), (8, None), (9, "été one twoé three four"), (10, "Kelvin one two"), (11, "kelvin one two"),
        *((20 + i, "alpha beta gamma delta") for i in range(150)), (-5, "alpha beta gamma delta"),
    ]
    want = brute(rows)
    assert (1, 2, 1.0) in want and (1, 8, 1.0) in want and (10, 11, 1.0) in want and not any(7 in p[:2] for p in want)
    assert found(near_pairs.near_pairs(frame(spark, rows))) == want
    assert found(near_pairs.near_pairs(frame(spark, rows[:6]))) == brute(rows[:6])
    assert near_pairs.near_pairs(frame(spark, [(1, None)])).collect() == []
    assert near_pairs.near_pairs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_never_part_similar_sets():
    rng = random.Random(2)
    import numpy as np

    for n in (5, 60, 511, 513, 1_000, 5_000):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        y = np.concatenate([x[: len(x) - n // 10], np.array([rng.getrandbits(64) for _ in range(n // 9)], np.uint64)])
        assert near_pairs._distance(near_pairs._sketch(x), near_pairs._sketch(y)) <= len(np.setxor1d(x, y))


def test_exchanges_are_smaller_than_the_texts(spark, tmp_path):
    """The plan exchanges every gram several times over."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(2_000)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1_000, texts[0]), (1_001, texts[1] + " more")]
    frame(spark, rows).repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(len(t) for _, t in rows)

    def written(run):
        jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        total = lambda: sum(s.shuffleWriteBytes() for s in (found.apply(i) for found in [stages()] for i in range(found.size())))
        before, got = total(), sorted(tuple(r) for r in run().collect())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return total() - before, got

    now, got = written(lambda: QUERIES["j4_word_gram_duplicates"](spark, str(tmp_path)))
    plan, want = written(lambda: apply(spark, "j4_word_gram_duplicates", documents=spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert got == want and len(got) == 2
    assert now < size < plan
