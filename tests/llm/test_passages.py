"""Passage dedup against plain Python over all runs of words."""

import random

import corpus_pipeline
from gridpanel.llm import line_dedup, passages, simhash

DOCS = "doc_id long, text string"


def plain_words(texts, run=50):
    """Per doc_id the words left: those in no run of `run` words that an earlier place has."""
    seen, left = set(), {}
    for i, text in sorted(texts, key=lambda x: x[0]):
        words = (text or "").split()
        gone = set()
        for p in range(len(words) - run + 1):
            key = tuple(words[p : p + run])
            if key in seen:
                gone.update(range(p, p + run))
            seen.add(key)
        left[i] = [w for k, w in enumerate(words) if k not in gone]
    return left


def test_passages_against_all_runs(spark):
    rng = random.Random(4)
    words = lambda a, b: [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(a, b))]
    shared = [words(40, 130) for _ in range(10)]
    texts = []
    for i in range(60):
        parts = []
        for s in rng.sample(shared, rng.randrange(0, 4)):
            parts += words(0, 60) + s[rng.randrange(0, 20) : len(s) - rng.randrange(0, 20)]
        texts.append((i, " ".join(parts + words(0, 30))))
    texts += [(100, None), (101, ""), (102, texts[5][1].replace(" ", "\n", 3)), (103, "  " + texts[5][1].replace(" ", "\t")), (104, "x " * 3000), (105, "x " * 3000 + "\ny"), (106, "a b\n" * 300), (107, "word " * 49)]
    out = passages.dedup_passages(spark.createDataFrame(texts, DOCS).repartition(5), removed="gone").collect()
    want = plain_words(texts)
    assert {r["doc_id"]: (r["text"] or "").split() for r in out} == want and len(out) == len(texts)
    assert all(r["gone"] == len((dict(texts)[r["doc_id"]] or "").split()) - len(want[r["doc_id"]]) for r in out)
    assert sum(r["gone"] for r in out) > 5000 and {r["doc_id"]: r["text"] for r in out}[100] is None


def test_pipeline_takes_passages_within_a_line(spark):
    """Line dedup leaves it, the stage doesn't."""
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"{k}{i}" for i in range(60)) for k in "ab"]
    texts = [(1, f"one two\nthree {passage} four\nfive {own[0]}"), (2, f"six {passage} seven eight\nnine {passage}\nten {own[1]}")]
    docs = spark.createDataFrame(texts, DOCS)
    assert {r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {t for _, t in texts}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: texts[0][1], 2: f"six seven eight\nnine\nten {own[1]}"}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, rate):
    return [f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def test_copies_stay_whole_and_go_in_the_next_stage(spark):
    """Near copies aren't cut up; what they share with other documents, and repeat within themselves, goes."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    passage = words(70)
    base, other = words(300) + passage + words(300), words(200)
    near = [" ".join(edited(rng, base, 0.01)) for _ in range(4)]
    texts = [(1, " ".join(other + passage)), (2, " ".join(base)), (3, " ".join(base)), *[(10 + i, t) for i, t in enumerate(near)], (20, " ".join(words(100) + base[:200])), (21, " ".join(other[:100])), (None, None), (22, "")]
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    got = {r["doc_id"]: r["text"] for r in passages.dedup_passages(docs, alike=0.7).collect()}
    by = dict(texts)
    assert got[1] == by[1] and got[2] == got[3] == " ".join(base[:300] + base[370:])
    for i in range(10, 14):
        assert len(got[i].split()) >= 580, i
    assert len(got[20].split()) == 100 and got[21] == "" and got[None] is None
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(got.items()), DOCS)).collect()}
    assert 3 not in kept and len(kept & {10, 11, 12, 13}) <= 1 and {1, 2, 20} <= kept
    assert passages.dedup_passages(docs.limit(0), alike=0.7).collect() == []


def test_near_copies_of_a_whole_table_go(spark, medium):
    """Recall of both stages against all pairs with a common shingle, by their similarity in the table."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rng = random.Random(5)
    long = [i for i, t in texts.items() if 120 <= len((t or "").split()) <= 3000]
    for k, i in enumerate(rng.sample(long, 120)):
        texts[100_000 + k] = " ".join(edited(rng, texts[i].split(), (0.004, 0.01, 0.02)[k % 3]))
    more = spark.createDataFrame(list(texts.items()), DOCS).repartition(8)
    cut = passages.dedup_passages(more, alike=corpus_pipeline.ALIKE)
    kept = {r["doc_id"] for r in simhash.keep_one(cut).collect()}
    sets, by = {i: shingles(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for m in by.values() if 1 < len(m) <= 30 for a in m for b in m if a < b}
    found = {}
    for a, b in pairs:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.8:
            found.setdefault(0.9 if j >= 0.9 else 0.8, []).append(not (a in kept and b in kept))
    assert all(len(x) >= 30 for x in found.values()) and sum(found[0.9]) >= 0.95 * len(found[0.9]) and sum(found[0.8]) >= 0.9 * len(found[0.8])
    alone = set(texts) - {i for p in pairs for i in p}
    assert len(alone & kept) >= 0.99 * len(alone)


def test_near_copies_that_no_group_takes_lose_their_repeats(spark):
    """Copies of any likeness with a tail of their own: after the third stage no 50 words stand at two places."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    texts = []
    for k in range(24):
        base = words(600)
        texts += [(k, " ".join(base)), (100 + k, " ".join(base[: 480 + 4 * k] + words(120 - 4 * k)))]
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    out = corpus_pipeline.dedup_documents(spark, corpus_pipeline.dedup_lines(spark, docs, ""), "").collect()
    left = {r["doc_id"]: r["text"].split() for r in out}
    assert plain_words([(i, " ".join(w)) for i, w in left.items()]) == left
    assert set(range(24)) <= set(left) and all(left[k] == dict(texts)[k].split() for k in range(24))


def test_repeats_are_all_matches_extended_both_ways(spark):
    """Against all pairs of places, each extended word by word as far as it goes."""
    rng = random.Random(8)
    pool = [[rng.choice("abcde") for _ in range(rng.randrange(5, 14))] for _ in range(6)]
    texts = {i: [w for s in rng.choices(pool, k=4) for w in (*s, rng.choice("vwxyz"))] for i in range(12)}
    run, want = 7, {i: set() for i in texts}
    for i, a in texts.items():
        for j, b in texts.items():
            for p, q in ((p, q) for p in range(len(a)) for q in range(len(b)) if (i, p) < (j, q) and a[p] == b[q]):
                low, high = 0, 1
                while p + low and q + low and a[p + low - 1] == b[q + low - 1]:
                    low -= 1
                while p + high < len(a) and q + high < len(b) and a[p + high] == b[q + high]:
                    high += 1
                if high - low >= run:
                    want[j].update(range(q + low, q + high))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS).repartition(3)
    out = passages.dedup_passages(docs, run_words=run, gram_words=3).collect()
    assert {r["doc_id"]: r["text"].split() for r in out} == {i: [w for k, w in enumerate(t) if k not in want[i]] for i, t in texts.items()}
    assert sum(map(len, want.values())) > 100
