"""Mixing and personal data against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridpanel.llm import mixing, pii
from gridpanel.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, target string, spans string"


def shares(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Sharing again and again until no target is above its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= ceiling * sizes[s]}
        if not full:
            out |= {s: w[s] * level for s in open_}
            break
        out |= {s: ceiling * sizes[s] for s in full}
        left -= sum(ceiling * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(rows):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want, took = shares(sizes), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(took[s] - want[s]) <= 3 * mixing.LEAST_BLOCK


def test_mix_of_whole_table(spark, medium):
    docs = table(spark, medium, "documents")
    run = lambda: mixing.taken(docs, ["doc_id", "source"]).collect()
    rows = run()
    assert len(rows) == 1000
    check_mix(rows)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run()))


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "x", "s1", 0, 1, 1, "", ""), (1, "a b c", "x", "s1", 0, 1, 1, "", ""), (2, None, None, None, 0, 1, 1, "", ""), (None, "w " * 5000, None, "s2", 0, 1, 1, "", ""), (3, "", "x", "é", 0, 1, 1, "", ""), (4, "x\x1cy z", "x", None, 0, 1, 1, "", "")]
    out = mixing.taken(spark.createDataFrame(rows, SCHEMA), ["doc_id", "source"]).collect()
    assert len(out) == 6
    check_mix(out)
    assert mixing.taken(spark.createDataFrame([], SCHEMA), ["doc_id"]).collect() == []


def test_points(spark):
    """The golden ratio's multiples modulo 1, also where a product of longs would overflow."""
    ks = [1, 2, 3, 1000, (1 << 40) - 1, 987654321012]
    df = spark.createDataFrame([(k,) for k in ks], "k long")
    assert {r["k"]: r["u"] for r in df.withColumn("u", mixing.point(df["k"])).collect()} == {k: k * mixing.GOLDEN % (1 << 40) for k in ks}
    assert abs(mixing.GOLDEN / (1 << 40) - 0.6180339887498949) < 1e-11


def test_schedule_is_even(spark):
    rows = spark.createDataFrame([("a", 5000), ("b", 20000), ("c", 90000), ("d", 0)], "source string, size long")
    per = mixing.targets(rows)
    n, block = mixing.shape(per, 10)
    slots = mixing.schedule(per, n).collect()
    quota = {r["sid"]: r["quota"] / block for r in per.collect()}
    assert block == 10 and sorted(r["slot"] for r in slots) == list(range(n))
    for s in quota:
        own = sorted((r["slot"], r["rank"]) for r in slots if r["sid"] == s)
        assert [k for _, k in own] == list(range(len(own)))
    for upto in (n // 7, n // 2, n):
        for s, q in quota.items():
            assert abs(sum(r["sid"] == s for r in slots if r["slot"] < upto) - q * upto / n) <= 3
    assert mixing.shape(per) == (-(-sum(r["quota"] for r in per.collect()) // 32), 32)


def test_blocks_grow_with_the_mix(spark):
    per = spark.createDataFrame([(0, 10**15), (1, 3)], "sid long, quota long")
    n, block = mixing.shape(per)
    assert n <= mixing.MOST_SLOTS < 2 * n and block % mixing.LEAST_BLOCK == 0


def test_the_schedule_decides(spark, monkeypatch):
    """With other points other words are taken."""
    docs = spark.createDataFrame([(i, "w " * (i % 50), "x", f"s{i % 4}", 0, 1, 1, "", "") for i in range(200)], SCHEMA)
    run = lambda: sorted(tuple(r) for r in mixing.taken(docs, ["doc_id"]).collect())
    one = run()
    assert one == run() and sum(r[4] for r in one) > 0
    monkeypatch.setattr(mixing, "GOLDEN", 3**24 | 1)
    assert [r[4] for r in one] != [r[4] for r in run()]


def test_running_sums_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(g, k, (k * 7 + g) % 5) for g in range(3) for k in range(40) if (k + g) % 4]
    got = {(r["g"], r["k"]): r["ahead"] for r in mixing._ahead(spark.createDataFrame(rows, "g long, k long, n long"), "g", "k", "n").collect()}
    assert got == {(g, k): sum(n for a, b, n in rows if a == g and b < k) for g, k, _ in rows}


def brute(text):
    found = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in found.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows):
    for r in rows:
        want = brute(r["text"])
        for k in pii.BASE:
            assert r[f"n_{k}"] == sum(s[0] == k for s in want), (k, r["text"][:200])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        listed = r["spans"].split(",") if r["spans"] else []
        assert [s for s in listed if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_pii_of_whole_table(spark, medium):
    docs = table(spark, medium, "documents")
    rows = pii.report(docs, ["doc_id", "text"]).collect()
    assert len(rows) == 1000 and sum(r["n_email"] for r in rows) > 0
    check_pii(rows)


def test_pii_odd_texts(spark):
    texts = [None, "", "😀é a@b.c_x@d.e a@b.c@d.e.f x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111x", "+1 (555) 010-9999 +12 34 +1234567890123456", "a" * 100_000 + "@b.c", ("q@w.e " * 1200) + "é +49 30 1234567", "1" * 40_000, "a@b" + ".c" * 30_000, "iban GB82 WEST 1234 5698 7654 32 ok, DE89370400440532013000, GB82WEST12345698765433", "ssn 123-45-6789 but 987-65-4321", "1-2 3  4", "+1()()()", "9.9.9.99999999999999999999"]
    docs = spark.createDataFrame([(i, t, "", "", 0, 0, 0, "", "") for i, t in enumerate(texts)] + [(0, texts[3], None, None, 0, 0, 0, "", "")], SCHEMA)
    rows = pii.report(docs, ["doc_id", "text"]).collect()
    assert len(rows) == len(texts) + 1
    check_pii(rows)
    by = {r["doc_id"]: r["spans"] for r in rows}
    assert by[10].count("iban") == 2 and by[11].startswith("ssn:4:15")
    assert pii.report(spark.createDataFrame([], SCHEMA), ["doc_id"]).collect() == []


def test_pii_is_native(spark, small):
    plan = pii.report(table(spark, small, "documents"), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def check_stream(rows, docs, took):
    """Stretches in order give the texts, and are what op1 says is taken."""
    by, words = {}, {}
    for r in sorted(rows, key=lambda r: (r["epoch"], r["word_from"], r["slot"])):
        by.setdefault((r["doc_id"], r["source"], r["epoch"]), []).append(r)
        words[r["doc_id"], r["source"]] = words.get((r["doc_id"], r["source"]), 0) + r["word_to"] - r["word_from"]
        assert len(r["text"].split()) == r["word_to"] - r["word_from"]
    texts = {(d["doc_id"], d["source"]): d["text"] for d in docs}
    for (i, s, _), parts in by.items():
        assert texts[i, s].startswith("".join(p["text"] for p in parts))
    want = {}
    for r in took:
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert words == {k: n for k, n in want.items() if n}


def test_mixed_stream(spark):
    rows = [(i, f"a{i} b\n c  d " + "e f g\t" * (i * 9), "x", f"s{i % 3}", 0, 1, 1, "t", "u") for i in range(30)] + [(None, "p q r", None, None, 0, 1, 1, "t", "u"), (77, None, "x", "s1", 0, 1, 1, "t", "u"), (78, " ", "x", "s1", 0, 1, 1, "t", "u")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_stream(docs)
    assert out.columns == docs.columns + ["slot", "epoch", "word_from", "word_to"]
    check_stream(out.collect(), docs.collect(), mixing.taken(docs, ["doc_id", "source"]).collect())
    parts = out.select("slot", F.spark_partition_id().alias("p")).collect()
    assert [r["slot"] for r in parts] == sorted(r["slot"] for r in parts)
    assert mixing.mixed_stream(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed_stream(docs.withColumn("slot", F.lit(1)))
    assert mixing.mixed_stream(docs.withColumn("slot", F.lit(1)), added=("at", "e", "a", "b")).columns[-4:] == ["at", "e", "a", "b"]


def test_mixed_stream_of_repeated_rows(spark):
    """Each of the rows is taken on its own, and no stretch twice by one slot."""
    rows = [(1, "a b c " * 30, "x", "s1", 0, 1, 1, "t", "u")] * 3 + [(2, "z " * 200, "x", "s2", 0, 1, 1, "t", "u")]
    docs = spark.createDataFrame(rows, SCHEMA)
    took = sum(r["taken"] for r in mixing.taken(docs, ["doc_id"]).collect())
    out = mixing.mixed_stream(docs).collect()
    assert sum(r["word_to"] - r["word_from"] for r in out) == took == sum(len(r["text"].split()) for r in out)


def test_mixed_stream_of_whole_table_is_native(spark, small):
    docs = table(spark, small, "documents")
    out = mixing.mixed_stream(docs)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
    check_stream(out.collect(), docs.collect(), mixing.taken(docs, ["doc_id", "source"]).collect())
