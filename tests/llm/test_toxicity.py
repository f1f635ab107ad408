import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import toxicity as t


def test_gradient_equals_finite_differences():
    net = t.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seen, numbers = t.split_words(["a b c bad loser", "x y z " * 30, ""])
    words, labels = t.Words.of(seen), np.array([1, 0, 0], np.float32)
    _, grad = net.gradient(words, numbers, labels)
    spots = {"word": (words.bucket[3], 2), "char": (words.chars[5], 1), "xf": (3, 4), "hb": (1, 2), "look": (2, 3), "pick": (1,), "out": (5,), "outb": (0,), "bf": (7,)}
    for name, at in spots.items():
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = net.gradient(words, numbers, labels)[0]
        net.p[name][at] = old - e
        down = net.gradient(words, numbers, labels)[0]
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-5), name


def plain_score(p, text):
    """The same score from loops over windows, words and units, in double precision."""
    import zlib

    def sig(x):
        return 1 / (1 + np.exp(-x))

    def grams(raw):
        for k in range(len(raw) - 2):
            code = (raw[k] * 0x9E3779B1 + raw[k + 1] * 0x85EBCA77 + raw[k + 2] * 0xC2B2AE3D) % 2**32
            code = ((code ^ (code >> 15)) * 0x27D4EB2F) % 2**32
            yield (code >> 8) % t.CHAR_BUCKETS

    def put(word):
        raw = b"^" + word.encode() + b"$"
        return np.r_[p["word"][zlib.crc32(raw) % t.WORD_BUCKETS], np.mean([p["char"][c] for c in grams(raw)], axis=0)].astype(float)

    words, best = text.lower().split(), -np.inf
    for a in [0] if len(words) <= t.WINDOW else [*range(0, len(words) - t.WINDOW, t.STRIDE), len(words) - t.WINDOW]:
        window, states = [put(w) for w in words[a : a + t.WINDOW]], {}
        for way in "fb":
            h, out = np.zeros(t.UNITS), []
            for x in window if way == "f" else window[::-1]:
                g, u = x @ p[f"x{way}"] + p[f"b{way}"], h @ p[f"h{way}"]
                n = t.UNITS
                z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :]) + z * h
                out.append(h)
            states[way] = out if way == "f" else out[::-1]
        both = [np.r_[f, b] for f, b in zip(states["f"], states["b"], strict=True)]
        looks = np.array([np.tanh(s @ p["look"] + p["lookb"]) @ p["pick"] for s in both])
        share = np.exp(looks - looks.max()) / np.exp(looks - looks.max()).sum() if both else []
        pooled = sum((w * s for w, s in zip(share, both, strict=True)), np.zeros(2 * t.UNITS))
        best = max(best, pooled @ p["out"] + p["outb"][0])
    return sig(best)


def test_registered_query_equals_a_plain_scorer(spark):
    """op3's rows against loops over every window and word, with the network that the query trains."""
    from larkspur.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    sample = t.training_sample(docs, labels)
    net = t.train(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, sf).collect()}
    texts = [r for r in docs.select("doc_id", "text").collect() if len(r["text"]) < 6_000]
    assert len(got) == docs.count() and len(texts) > 150
    for r in texts:
        want = plain_score(net.p, r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=2e-4), r["doc_id"]
        assert got[r["doc_id"]]["held_out"] == t.held_out(r["doc_id"]) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
    odd = ["", "one", "x " * 33, "Ünïcode wörds " * 40]
    assert np.allclose(t.score_texts(net, odd), [plain_score(net.p, x) if x else 1 / (1 + np.exp(-(net.p["outb"][0]))) for x in odd], atol=2e-4)


def test_windows_overlap_and_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        starts = t.windows_of(n)
        covered = {k for s in starts for k in range(s, min(n, s + t.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= t.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_score_is_the_worst_window_wherever_it_stands():
    rng = np.random.default_rng(0)
    clean = [" ".join(f"w{rng.integers(300)}" for _ in range(40)) for _ in range(120)]
    toxic = [c + f" vile{rng.integers(5)} scum" for c in clean[:60]]
    net = t.train([*clean, *toxic], np.r_[np.zeros(120, int), np.ones(60, int)])
    long = " ".join(f"w{rng.integers(300)}" for _ in range(5_000))
    at = long.find(" ", len(long) // 2)
    low, high, end = t.score_texts(net, [long, long[:at] + " vile3 scum" + long[at:], long + " vile1 scum"])
    assert low < 0.3 <= min(high, end)


def test_held_out_accuracy_and_edge_cases(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = t.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == docs.count()
    right = (rows["predicted"] == rows["toxic"]).mean()
    caught = rows.loc[rows["toxic"] == 1, "predicted"].mean()
    spared = 1 - rows.loc[rows["toxic"] == 0, "predicted"].mean()
    assert right > 0.95 and caught > 0.75 and spared > 0.97, (right, caught, spared)


def test_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, "")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = t.score(odd, labels).collect()
    assert len(got) == 4 and len({r["score"] for r in got}) == 1 and not any(r["predicted"] for r in got)
    assert t.drop_toxic(odd, labels).columns == odd.columns and t.drop_toxic(odd, labels).count() == 4
    assert t.score(odd.limit(0), labels).count() == 0
